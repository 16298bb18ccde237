"""Quality scores from a sparse ensemble of rules over text statistics.

Shallow trees are grown on statistics of labelled texts; every path from a root is a rule,
a conjunction of bounds on statistics. A lasso logistic regression over the rules gives
most of them no weight. The rest is compiled into one Spark column expression, so scoring
is a projection over the statistics.

Statistics are shares and means of the text alone; labels, language, source and id are
never among them.

Defined cases: null and empty texts have all statistics 0 and get the score of such a
text; without labels of both kinds the score is the share of label 1 (0.5 without any);
repeated rows are scored alike; all columns pass through, own columns start with ``_q_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trackweave.llm.labelled import bounded, sampled
from trackweave.llm.words import SPACE, mix, word_pieces
from trackweave.session import cut_lineage

STATISTICS = [
    "log_words", "word_length", "symbols", "upper", "digits", "repeated", "distinct", "bare", "marked", "lines",
]
MOST_LABELLED = 20_000  # rows that the trees and the lasso are fitted on
TREES, DEPTH = 12, 3
LASSO = 0.002
ACCEPT = 0.7

_BYTE = np.arange(256)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_PLAIN = np.isin(_BYTE, [ord(c) for c in ".,;:'\"-()?"])
_SYMBOL = (_BYTE < 128) & (_BYTE > 32) & ~_LOWER & ~_UPPER & ~_DIGIT & ~_PLAIN


def _stats(column: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    out = np.zeros((len(column), len(STATISTICS)))
    for row, words in word_pieces(column):
        n = len(words.first) - 1
        count = words.counts()
        many = np.maximum(count, 1)

        def inside(flags: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return np.diff(sums[words.texts])  # noqa: B023

        def per_word(flags: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return np.diff(sums[words.first]) / many  # noqa: B023

        data = words.data
        upper, lower = inside(_UPPER[data]), inside(_LOWER[data])
        solid = np.maximum(inside(~SPACE[data]), 1)
        h, of = words.hashes(), words.row()
        same = np.zeros(len(words), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        _, first = np.unique(mix(h + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        new = np.zeros(len(words), dtype=bool)
        new[first] = True
        letters = np.concatenate([[0], np.cumsum(_LOWER[data] | _UPPER[data] | (data >= 128))])
        out[row : row + n] = np.column_stack(
            [
                np.log1p(count),
                solid * (count > 0) / many,
                inside(_SYMBOL[data]) / solid,
                upper / np.maximum(upper + lower, 1),
                inside(_DIGIT[data]) / solid,
                per_word(same),
                per_word(new),
                per_word(letters[words.end] == letters[words.begin]),
                per_word(_SYMBOL[data[words.end - 1]]) if len(words) else np.zeros(n),
                inside(data == 10) / many,
            ]
        )
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the statistics of ``text`` as ``_q_<name>``."""
    names = [f"_q_{s}" for s in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _stats(batch.column("text"))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            extra = [pa.array(stats[:, i].copy()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*batch.schema.names, *names])

    rows = docs.drop(*names)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in names]]))


Bounds = tuple[tuple[int, float, float], ...]  # (statistic, above, at most), by statistic


def _paths(node, bounds: dict[int, tuple[float, float]]) -> Iterator[Bounds]:
    """The rule of every node below the root."""
    if bounds:
        yield tuple((i, lo, hi) for i, (lo, hi) in sorted(bounds.items()))
    if node.getClass().getSimpleName() == "InternalNode":
        i, at = node.split().featureIndex(), float(node.split().threshold())
        lo, hi = bounds.get(i, (-np.inf, np.inf))
        yield from _paths(node.leftChild(), bounds | {i: (lo, min(hi, at))})
        yield from _paths(node.rightChild(), bounds | {i: (max(lo, at), hi)})


def holds(rule: Bounds) -> Column:
    """A rule as a column."""
    out = F.lit(True)
    for i, lo, hi in rule:
        value = F.col(f"_q_{STATISTICS[i]}")
        if lo > -np.inf:
            out &= value > lo
        if hi < np.inf:
            out &= value <= hi
    return out


@dataclass
class RuleEnsemble:
    rules: list[Bounds]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as a column over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(holds(rule), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MOST_LABELLED, seed: int = 11) -> RuleEnsemble:
    """Rules fitted on at most about ``most`` labelled documents."""
    known, share = bounded(labels, column, most, "quality")
    texts = docs.where(F.col("doc_id").isNotNull() & sampled(F.col("doc_id"), share, "quality")).select("doc_id", "text")
    names = [f"_q_{s}" for s in STATISTICS]
    # of a repeated id the text of smallest statistics
    one = with_statistics(texts).groupBy("doc_id").agg(F.min(F.struct(*names)).alias("_s")).select("doc_id", "_s.*")
    rows = one.join(known, "doc_id").withColumn("stats", array_to_vector(F.array(*names)))
    rows = cut_lineage(rows.coalesce(8))
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        p = (seen.get(1.0, 0) + 0.5) / (sum(seen.values()) + 1)
        return RuleEnsemble([], [], float(np.log(p / (1 - p))))
    forest = RandomForestClassifier(
        featuresCol="stats", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=seed, featureSubsetStrategy="onethird"
    ).fit(rows)
    rules = sorted({rule for tree in forest.trees for rule in _paths(tree._java_obj.rootNode(), {})})
    fired = cut_lineage(rows.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("fired")))
    lasso = LogisticRegression(
        featuresCol="fired", labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60
    ).fit(fired)
    kept = [(r, w) for r, w in zip(rules, lasso.coefficients.toArray().tolist()) if w]
    return RuleEnsemble([r for r, _ in kept], [w for _, w in kept], float(lasso.intercept))


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """All columns of ``docs`` with ``_q_score``."""
    rows = with_statistics(docs).withColumn("_q_score", model.score())
    return rows.drop(*[f"_q_{s}" for s in STATISTICS])
