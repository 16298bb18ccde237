"""The corpus pipeline, stage by stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
import corpus_pipeline
from check import compare, connect
from trackweave.llm import mixing, pieces, shingle_join
from trackweave.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def kept(spark, sf, documents):
    """What each stage keeps, in order."""
    out, docs = [documents], documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out.append(docs)
    return out


def test_stages(kept):
    for before, after in zip(kept[:-2], kept[1:-1]):
        assert after.columns == before.columns
    start, mild, good, single, mixed, last = (Counter(r["doc_id"] for r in df.collect()) for df in kept)
    assert set(mild) <= set(start) and set(good) <= set(mild) and set(single) <= set(good) and set(mixed) <= set(single)
    assert len(mild) > 0.8 * len(start) and len(good) > 0.6 * len(mild)
    assert max(single.values()) == 1 and max(mixed.values()) <= 3 and last == mixed


def test_one_of_each_group_stays(kept):
    classes = {r["doc_id"]: r["component_id"] for r in shingle_join.near_classes(kept[2]).collect()}
    assert {r["doc_id"] for r in kept[3].collect()} == set(classes.values())


def test_mix_and_ids(kept):
    taken = mixing.taken(mixing.clock(kept[3])).where("size > 0")
    want = {r["doc_id"]: r["n"] for r in taken.selectExpr("doc_id", "taken div size AS n").collect() if r["n"]}
    assert Counter(r["doc_id"] for r in kept[4].collect()) == want
    back = pieces.decoded(kept[5].select("doc_id", "ids"))
    assert back.join(kept[3].select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t").count() == 0


def test_toxic_and_poor_documents_go(spark, sf, kept):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    after = kept[2].join(labels, "doc_id")
    assert after.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()
    assert after.where("quality = 1 AND toxic = 0").count() >= 0.9 * labels.where("quality = 1 AND toxic = 0").count()


def test_stages_take_odd_and_empty_tables(spark, sf, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf).cache()
            docs.count()


def test_every_operator_has_a_query():
    names = spark_entry.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    result = compare(spark, connect(sf), name, sf, ORACLE[name])
    assert result.startswith("ok"), result


def test_stages_keep_columns_of_any_name(spark, sf, documents):
    """Names that the operators use inside come back as they were."""
    names = ["_here", "_copy", "_source", "_least", "_cut", "_t_toxic", "_q_score", "_q_digits", "name", "class", "column_1"]
    docs = documents.selectExpr("*", *[f"doc_id * 10 + {i} AS {n}" for i, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        rows = docs.selectExpr(*[f"sum(CAST({n} <> doc_id * 10 + {i} AS INT)) AS {n}" for i, n in enumerate(names)]).first()
        assert docs.columns[-len(names) :] == names and not any(rows), stage


def test_one_of_each_decides_by_id_and_text(spark, sf):
    first, second, other = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [
        (1, first, "en", "s"),
        (2, first + " more", "en", "s"),  # a near copy of 1
        (3, first, "en", "s"),  # a copy of 1, while the other text of id 3 stays
        (3, second, "en", "s"),
        (None, first, "en", "s"),  # copies without id
        (None, other, "en", "s"),
        (None, other, "en", "s"),
        (4, other + " x", "en", "s"),
        (5, None, "en", "s"),
        (5, None, "en", "s"),
        (6, "", "en", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Counter((r["doc_id"], (r["text"] or "")[:2]) for r in corpus_pipeline.one_of_each(spark, docs, sf).collect())
    assert got == Counter([(1, "a0"), (3, "b0"), (4, "c0"), (5, ""), (6, "")])


def test_mix_of_columns_with_names_of_its_own(spark):
    docs = spark.createDataFrame([(i, "one two three", "s") for i in range(9)], "doc_id long, text string, source string")
    names = ["_source", "_LEAST", "_cut", "_here", "_copy", "_copy_"]
    docs = docs.selectExpr("*", *[f"doc_id + {i} AS {n}" for i, n in enumerate(names)])
    rows = mixing.mixed(docs, mixing.clock(docs)).collect()
    assert len(rows) == 9 and all(r[n] == r["doc_id"] + i for r in rows for i, n in enumerate(names))
