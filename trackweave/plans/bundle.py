"""A saved model that turns recordings into a filled grid of predictions.

A bundle is one ``PipelineModel``: recordings are cut in windows, windows become
features, a fitted classifier scores every class. It is saved with a record of the run
and loaded without any of the code that fitted it. The stages are transformers of their own, so
Spark's pipeline reader and writer handle them like its own stages.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from trackweave.operators.metrics import mean_vector
from trackweave.operators.windows import slice_windows
from trackweave.plans.predict import predicted_rows, submission
from trackweave.session import cut_lineage
from trackweave.sources.files import write_run_record
from trackweave.sources.tracks import chunked, lengths

KEYS = ["file_id", "end_time"]
LABELS = ("start", "end")


class SliceWindows(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``(track, pos, value)`` to ``(file_id, win_idx, end_time, x)``.

    Windows are named by their number times ``seconds``: with ``label="start"`` the first one is
    named 0, with ``"end"`` it is named by its end.
    """

    width = Param(Params._dummy(), "width", "samples of a window", TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "samples between windows", TypeConverters.toInt)
    context = Param(Params._dummy(), "context", "further samples of a window", TypeConverters.toInt)
    chunk = Param(Params._dummy(), "chunk", "samples of a stored chunk", TypeConverters.toInt)
    padding = Param(Params._dummy(), "padding", "center, right or right-align", TypeConverters.toString)
    seconds = Param(Params._dummy(), "seconds", "seconds of a window", TypeConverters.toInt)
    label = Param(Params._dummy(), "label", "start or end", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, width=None, step=None, context=0, chunk=4096, padding="right-align", seconds=5, label="start"):
        super().__init__()
        self._setDefault(context=0, chunk=4096, padding="right-align", seconds=5, label="start")
        self._set(**self._input_kwargs)
        if self.getOrDefault(self.label) not in LABELS:
            raise ValueError(f"label must be one of {LABELS}")

    def _transform(self, samples: DataFrame) -> DataFrame:
        get = self.getOrDefault
        step = get(self.step) if self.isSet(self.step) else None
        windows = slice_windows(
            chunked(samples, get(self.chunk)), lengths(samples), get(self.chunk), get(self.width), get(self.context), step, get(self.padding)
        )
        shift = 1 if get(self.label) == "end" else 0
        named = ((F.col("win_idx") + shift) * get(self.seconds)).alias("end_time")
        return windows.select(F.col("track").alias("file_id"), "win_idx", named, "x")


class WindowFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``features``: mean, deviation, lowest and highest value of a window, rounded."""

    digits = Param(Params._dummy(), "digits", "decimal places", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, digits=6):
        super().__init__()
        self._setDefault(digits=6)
        self._set(**self._input_kwargs)

    def _transform(self, windows: DataFrame) -> DataFrame:
        zero = F.lit(0.0)
        n = F.size("x")
        mean = F.aggregate("x", zero, lambda s, v: s + v) / n
        with_mean = windows.withColumn("_mean", mean)
        square = F.aggregate(F.transform("x", lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))), zero, lambda s, v: s + v) / n
        places = self.getOrDefault(self.digits)
        values = [F.col("_mean"), F.sqrt(square), F.array_min("x"), F.array_max("x")]
        features = array_to_vector(F.array(*[F.round(v, places) for v in values]))
        return with_mean.withColumn("features", features).drop("_mean")


class _Classes(Params):
    """The class names that scores stand for, in order."""

    classes = Param(Params._dummy(), "classes", "class names in the order of scores", TypeConverters.toListString)

    def class_table(self, spark: SparkSession) -> DataFrame:
        """``(label, idx)``."""
        names = self.getOrDefault(self.classes)
        return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, idx int")


class NamedScores(Transformer, _Classes, DefaultParamsReadable, DefaultParamsWritable):
    """``probability`` of a fitted classifier as ``scores``, with the names of its classes."""

    @keyword_only
    def __init__(self, *, classes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("scores", vector_to_array("probability"))


class CentroidClassifier(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits one mean of ``features`` for each ``label``."""

    digits = Param(Params._dummy(), "digits", "decimal places", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, digits=6):
        super().__init__()
        self._setDefault(digits=6)
        self._set(**self._input_kwargs)

    def _fit(self, rows: DataFrame) -> CentroidModel:
        digits = self.getOrDefault(self.digits)
        values = rows.where("label IS NOT NULL").select("label", vector_to_array("features").alias("_f"))
        # a row for each class and feature: the size of the model, not of the data
        means = mean_vector(values, ["label"], "_f").select("label", "dim", F.round("mean", digits).alias("mean")).collect()
        names = sorted({r["label"] for r in means})
        found = {(r["label"], r["dim"]): r["mean"] for r in means}
        width = 1 + max((r["dim"] for r in means), default=-1)
        centres = [[found[n, d] for d in range(width)] for n in names]
        return CentroidModel(classes=names, centres=centres, digits=digits)


class CentroidModel(Model, _Classes, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``scores``: minus the squared distance to every class mean, rounded."""

    centres = Param(Params._dummy(), "centres", "class means in the order of classes", TypeConverters.toListListFloat)
    digits = Param(Params._dummy(), "digits", "decimal places", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, classes=None, centres=None, digits=6):
        super().__init__()
        self._setDefault(digits=6)
        self._set(**self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        digits = self.getOrDefault(self.digits)
        centres = F.lit(np.array(self.getOrDefault(self.centres)).tolist())
        with_values = rows.withColumn("_f", vector_to_array("features"))

        def score(centre):
            gaps = F.zip_with("_f", centre, lambda a, b: (a - b) * (a - b))
            return F.round(-F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v), digits)

        return with_values.withColumn("scores", F.transform(centres, score)).drop("_f")


def fit_bundle(samples: DataFrame, truth: DataFrame, stages: list[Transformer], classifier: Estimator) -> PipelineModel:
    """The stages with a classifier fitted on the windows of labelled tracks; ``truth`` is ``(track, label)``."""
    windows = samples
    for stage in stages:
        windows = stage.transform(windows)
    rows = windows.drop("x").join(truth.select(F.col("track").alias("file_id"), "label"), "file_id")
    return PipelineModel([*stages, classifier.fit(cut_lineage(rows))])


def fit_probabilities(samples: DataFrame, truth: DataFrame, stages: list[Transformer], classifier: Estimator) -> PipelineModel:
    """As ``fit_bundle`` for a classifier of ``pyspark.ml`` that gives class probabilities."""
    names = [r["label"] for r in truth.where("label IS NOT NULL").select("label").distinct().orderBy("label").collect()]
    place = F.array_position(F.lit(names), F.col("label")) - 1
    numbered = truth.where("label IS NOT NULL").withColumn("label", place.cast("double"))
    fitted = fit_bundle(samples, numbered, stages, classifier)
    return PipelineModel([*fitted.stages, NamedScores(classes=names)])


def save_bundle(spark: SparkSession, bundle: PipelineModel, path: str, **record) -> None:
    """The model and, beside it, a record of the run."""
    bundle.write().overwrite().save(f"{path}/model")
    write_run_record(spark, f"{path}/record", **record)


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, Row]:
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/record").first()


def predictions(bundle: PipelineModel, samples: DataFrame, method: str = "top", sentinel: str = "noise") -> DataFrame:
    """``(file_id, end_time, bird, target)``: the classes that the bundle names for each window."""
    scored = bundle.transform(samples).select(*KEYS, "scores")
    return predicted_rows(scored, bundle.stages[-1].class_table(samples.sparkSession), method, sentinel)


def predict_grid(bundle: PipelineModel, samples: DataFrame, grid: DataFrame, sentinel: str, method: str = "top") -> DataFrame:
    """``(row_id, target)`` for every row of a grid ``(row_id, file_id, end_time, bird)``."""
    return submission(grid, predictions(bundle, samples, method, sentinel), sentinel)
