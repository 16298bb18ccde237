"""Prediction with saved models: from recordings to the filled grid."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.catalog.registry import query
from trackweave.catalog.signals import CHUNK, slices_sql
from trackweave.catalog.sqltext import FRAMES, TAXONOMY
from trackweave.operators.labels import class_table
from trackweave.plans import bundle, predict
from trackweave.session import work_path
from trackweave.sources.tracks import stored_frames, taxonomy

WIDTH = 10
SENTINEL = "AFRICA"

_WINDOWS = f"""{FRAMES}, {TAXONOMY}, {slices_sql(WIDTH, 0, None, "right-align")},
  feats AS (
    SELECT track, win_idx, round(avg(value), 6) AS f0, round(stddev_pop(value), 6) AS f1, min(value) AS f2, max(value) AS f3
    FROM slices GROUP BY track, win_idx),
  truth AS (SELECT track, family AS label FROM taxonomy WHERE family IS NOT NULL)"""

_GRID = """grid AS (
    SELECT DISTINCT track, win_idx, label, concat_ws('_', track, label, (win_idx + 1) * 5) AS row_id
    FROM feats CROSS JOIN (SELECT DISTINCT label FROM truth))"""


def recordings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Samples and the family of every track, the label to predict."""
    samples = stored_frames(spark, sf).select("track", "pos", "value")
    truth = taxonomy(spark, sf).select("track", F.col("family").alias("label")).where("label IS NOT NULL")
    return samples, truth


def stages() -> list:
    return [bundle.SliceWindows(width=WIDTH, chunk=CHUNK, label="end"), bundle.WindowFeatures()]


def whole_grid(samples: DataFrame, truth: DataFrame) -> DataFrame:
    """Every window with every class."""
    windows = stages()[0].transform(samples).select("file_id", "end_time")
    return predict.evaluation_grid(windows, class_table(truth))


@query(
    "l10_bundle_grid",
    f"""WITH {_WINDOWS},
        centres AS (
          SELECT label, row_number() OVER (ORDER BY label) AS idx, round(avg(f0), 6) AS c0, round(avg(f1), 6) AS c1,
                 round(avg(f2), 6) AS c2, round(avg(f3), 6) AS c3
          FROM feats JOIN truth USING (track) GROUP BY label),
        scores AS (
          SELECT track, win_idx, label, idx,
                 round(-((f0 - c0) * (f0 - c0) + (f1 - c1) * (f1 - c1) + (f2 - c2) * (f2 - c2) + (f3 - c3) * (f3 - c3)), 6) AS s
          FROM feats CROSS JOIN centres),
        best AS (SELECT track, win_idx, label FROM (
          SELECT *, row_number() OVER (PARTITION BY track, win_idx ORDER BY s DESC, idx DESC) AS r FROM scores) WHERE r = 1),
        {_GRID}
        SELECT row_id, coalesce(b.label = g.label AND g.label <> '{SENTINEL}', false) AS target
        FROM grid g LEFT JOIN best b USING (track, win_idx)""",
)
def l10_bundle(spark, sf):
    """Fit class means on windows, save, load, and fill the grid with the loaded model."""
    samples, truth = recordings(spark, sf)
    path = work_path(spark, "bundle")
    fitted = bundle.fit_bundle(samples, truth, stages(), bundle.CentroidClassifier())
    bundle.save_bundle(spark, fitted, path, window=WIDTH, classifier="class means")
    loaded, _ = bundle.load_bundle(spark, path)
    return bundle.predict_grid(loaded, samples, whole_grid(samples, truth), SENTINEL)


@query(
    "l10_trained_bundle",
    f"""WITH {_WINDOWS}, {_GRID}
        SELECT row_id, true AS agrees, {WIDTH}::BIGINT AS "window" FROM grid""",
)
def l10_trained(spark, sf):
    """A logistic model: what the loaded bundle fills in is what the fitted one does."""
    samples, truth = recordings(spark, sf)
    path = work_path(spark, "bundle")
    learner = LogisticRegression(maxIter=100, regParam=0.01)
    fitted = bundle.fit_probabilities(samples, truth, stages(), learner)
    bundle.save_bundle(spark, fitted, path, window=WIDTH, classifier="logistic regression")
    loaded, record = bundle.load_bundle(spark, path)
    grid = whole_grid(samples, truth)
    filled = [bundle.predict_grid(m, samples, grid, SENTINEL) for m in (fitted, loaded)]
    both = filled[0].join(filled[1].withColumnRenamed("target", "_loaded"), "row_id")
    return both.select("row_id", (F.col("target") == F.col("_loaded")).alias("agrees"), F.lit(record["window"]).cast("bigint").alias("window"))
