"""A corpus in five stages: toxicity, quality, near copies, mix of sources, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept.
The first four return the columns they were given, of whatever names; the last adds ``n_tokens`` and ``ids``.
Labels are read from ``sf_dir``; they fit the classifiers on bounded samples and are no
part of what is scored. Texts that are null count as empty; an empty table stays empty. Rows are told apart
by id and text: two texts of one id are two documents, and repeated rows are one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.llm import mixing, pieces, quality, shingle_join, toxicity
from trackweave.session import cut_lineage
from trackweave.sources.tracks import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: columns that the stages read; all others are handed on under names that clash with nothing
READ = ("doc_id", "text", "source")


def same_columns(stage: Stage) -> Stage:
    """A stage that returns the columns it was given, whatever their names are."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        named = {c: c if c in READ else f"column_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in named.items()])

    return run


@same_columns
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, chain).where(F.col("_t_toxic") < toxicity.REJECT)


@same_columns
def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col("_q_score") >= quality.ACCEPT)


@same_columns
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies, null ids last.

    Documents are joined under a 64-bit name of id and text, so each text of a repeated id is in the
    group of its own copies. Only the names that go are joined with the documents. Of rows equal in id and
    text the one of smallest digest stays.
    """
    name = F.xxhash64("doc_id", "text")
    named = docs.withColumn("name", name)
    classes = shingle_join.near_classes(docs.select(name.alias("doc_id"), "text"))
    classes = classes.select(F.col("doc_id").alias("name"), F.col("component_id").alias("class")).distinct()
    ids = cut_lineage(named.select("name", "doc_id").distinct().join(classes, "name"))
    first = ids.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name")).alias("first"))
    away = cut_lineage(ids.join(first, "class").where(F.col("name") != F.col("first.name")).select("name"))
    rest = named.join(away, "name", "left_anti")
    repeated = cut_lineage(rest.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    if repeated.isEmpty():
        return rest
    row = F.struct(*[F.col(c) for c in docs.columns])
    again = rest.join(repeated, "name", "left_semi")
    once = again.groupBy("name").agg(F.min(F.struct(F.xxhash64(row).alias("draw"), row.alias("row"))).alias("least"))
    return rest.join(repeated, "name", "left_anti").unionByName(once.select("name", "least.row.*"))


@same_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs, mixing.clock(docs, weights=(5, 2, 1), repeats=3, share=1.0))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their number of tokens and token ids."""
    return pieces.encoded(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near_copies", one_of_each),
    ("mix", mix_sources),
    ("token_ids", token_ids),
]

# fitted models, components and shuffled mixes are not expressible as one query
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
