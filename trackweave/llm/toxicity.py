"""Toxicity by a chain of linear classifiers over words.

Categories are predicted one after another; each model sees the words of a text and the
probabilities of the categories before it. Those it is trained on come from models that
did not see the row (out of fold), so it learns how far they can be trusted.

Terms are words and their beginnings of a few lengths, so that inflected forms of a stem
count together. The terms that tell a category are all those whose likelihood ratio of
document counts, in a bounded sample of labelled texts, is significant; the sample bounds
them. A beginning in the same texts as one of its words adds nothing and is left out. A
feature is whether a text has the term, so one word in a very long text counts as much as
in a short one.

Labels give the category ``toxic``; the finer categories are marked in toxic rows by the
seed words of ``SEEDS`` (a parameter).

Defined cases: null and empty texts have no words and get the chain's probabilities for
such a text; a category without both kinds of rows is predicted by its share; repeated
texts are trained on once; all columns pass through, own columns start with ``_t_``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trackweave.llm.labelled import bounded, sampled
from trackweave.llm.words import Words, cut, mix, pieces
from trackweave.session import cut_lineage

MOST_LABELLED = 12_000  # rows that the chain is fitted on
LEAST_TEXTS = 5  # labelled texts that a picked term is in
SIGNIFICANT = 12.0  # least log likelihood ratio of a picked term: chance among some 100,000 terms is excluded
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word's beginning that are terms too
FOLDS = 3
TASKS = 4  # tasks over the features of the bounded sample: few enough to sum gradients in one stage
RIDGE = 1e-4
REJECT = 0.5
PIECE = 1 << 19  # bytes of texts whose terms are held at once; a longer text is held whole

#: weak labels of the finer categories
SEEDS = {
    "insult": ["idiot", "loser", "moron", "clown", "scum", "trash"],
    "contempt": ["pathetic", "worthless", "disgusting", "stupid"],
}

_BYTE = np.arange(256)
#: bytes between words here: all ASCII that is neither letter nor digit
APART = (_BYTE < 128) & ~(((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122)) & ~((_BYTE >= 48) & (_BYTE <= 57))


def _word_pieces(column: pa.Array) -> Iterator[tuple[int, Words]]:
    for row, data, offsets in pieces(column, PIECE):
        yield row, cut(data, offsets, APART)


def _starts(words: Words) -> np.ndarray:
    """``length x word``: the terms that stand for a word's beginnings, 0 where it is shorter."""
    size = words.end - words.begin
    out = np.zeros((len(BEGINNINGS), len(words)), dtype=np.uint64)
    for i, n in enumerate(BEGINNINGS):
        long = size >= n
        part = Words(words.data, words.begin[long], words.begin[long] + n, words.first, words.texts)
        out[i, long] = mix(part.hashes() + np.uint64(n))
    return out.view(np.int64)


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(term numbers, text of each, beginnings)``: all words in order, then their beginnings."""
    of, starts = words.row(), _starts(words)
    there = (words.end - words.begin) >= np.array(BEGINNINGS)[:, None]
    rows = np.broadcast_to(of, starts.shape)[there]
    return np.concatenate([words.hashes().view(np.int64), starts[there]]), np.concatenate([of, rows]), starts


def word_name(word: str) -> int:
    """The number that stands for a word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(cut(data, np.array([0, len(data)]), APART).hashes().view(np.int64)[0])


def _flags(h: np.ndarray, of: np.ndarray, label: np.ndarray, seeds: Sequence[np.ndarray]) -> np.ndarray:
    """``text x category``: the label, and the label where a text has a seed word of the category."""
    out = np.zeros((len(label), len(seeds) + 1))
    for i, wanted in enumerate(seeds):
        out[of[np.isin(h, wanted)], i] = 1.0
    out[:, :-1] *= label[:, None]
    out[:, -1] = label
    return out


def _counted(seeds: Sequence[np.ndarray], categories: Sequence[str]):
    """``(word, n, texts, starts, <categories>)``: in how many texts a term is, of all and of each category.

    ``texts`` is equal for terms in the same texts; ``starts`` are the beginnings of a whole word.
    The texts themselves are counted under the term null.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            marks = batch.column("mark").to_numpy()
            for row, words in _word_pieces(batch.column("text")):
                h, of, starts = _terms(words)
                flags = _flags(h, of, labels[row : row + len(words.first) - 1], seeds)
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                of, at_word = of[new], order[new]
                names, begin, at = np.unique(h[new], return_index=True, return_inverse=True)
                n = np.bincount(at, minlength=len(names))
                parts = [np.bincount(at, flags[of, i], len(names)) for i in range(len(categories))]
                texts = np.bitwise_xor.reduceat(marks[row + of], begin) if len(names) else np.zeros(0, np.int64)
                # the words come first among the terms
                first = at_word[begin]
                own = [starts[:, i][starts[:, i] != 0].tolist() if i < len(words) else None for i in first]
                columns = [pa.array([*names.tolist(), None], pa.int64()), pa.array([*n.tolist(), len(flags)], pa.int64())]
                columns += [pa.array([*texts.tolist(), None], pa.int64()), pa.array([*own, None], pa.list_(pa.int64()))]
                columns += [pa.array(np.append(x, flags[:, i].sum())) for i, x in enumerate(parts)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "texts", "starts", *categories])

    return count


def _featured(seeds: Sequence[np.ndarray], categories: Sequence[str], picked: np.ndarray):
    """``(doc_id, has, <categories>)``: the places of the picked terms a text has, and its categories."""

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for row, words in _word_pieces(batch.column("text")):
                h, of, _ = _terms(words)
                flags = _flags(h, of, labels[row : row + len(words.first) - 1], seeds)
                of, at = _found(picked, h, of)
                cuts = np.searchsorted(of, np.arange(len(flags) + 1)).astype(np.int32)
                has = pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.astype(str).tolist(), pa.string()))
                ids = batch.column("doc_id").slice(row, len(flags))
                columns = [ids, has, *[pa.array(x) for x in flags.T.copy()]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "has", *categories])

    return feature


def _found(picked: np.ndarray, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, place)`` of the picked terms that texts have, each once, in order of the texts."""
    if not len(picked):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(picked, h), len(picked) - 1)
    hit = picked[at] == h
    pairs = np.unique(of[hit] * len(picked) + at[hit])
    return pairs // len(picked), pairs % len(picked)


@dataclass
class Chain:
    categories: list[str]
    words: np.ndarray  # picked terms, sorted
    weights: np.ndarray  # category x word
    earlier: np.ndarray  # category x category: weights of the probabilities before it
    intercepts: np.ndarray

    def probabilities(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(self.categories)))
        for row, words in _word_pieces(column):
            n = len(words.first) - 1
            z = np.tile(self.intercepts, (n, 1))
            if len(self.words):
                h, of, _ = _terms(words)
                of, word = _found(self.words, h, of)
                for c in range(len(self.categories)):
                    z[:, c] += np.bincount(of, self.weights[c][word], n)
            p = np.zeros_like(z)
            for c in range(len(self.categories)):
                p[:, c] = 1 / (1 + np.exp(-np.clip(z[:, c] + p[:, :c] @ self.earlier[c, :c], -500, 500)))
            out[row : row + n] = p
        return out


def _picked(rows: DataFrame, seeds: Sequence[np.ndarray], categories: Sequence[str]) -> np.ndarray:
    """All terms that tell a category, sorted; no beginning in the same texts as one of its words."""
    kinds = "word bigint, n bigint, texts bigint, starts array<bigint>, " + ", ".join(f"`{c}` double" for c in categories)
    each = rows.withColumn("mark", F.xxhash64("text")).mapInArrow(_counted(seeds, categories), kinds).groupBy("word")
    sums = [F.sum("n").alias("n"), F.bit_xor("texts").alias("texts"), F.max("starts").alias("starts")]
    counted = cut_lineage(each.agg(*sums, *[F.sum(c).alias(c) for c in categories]).where(F.col("n") >= LEAST_TEXTS))
    total = counted.where("word IS NULL").first()
    if total is None:
        return np.zeros(0, dtype=np.int64)
    told = F.lit(False)
    for c in categories:
        inside, outside = float(total[c] or 0), float(total["n"] - (total[c] or 0))
        if not inside or not outside:
            continue
        a, b = F.col(c), F.col("n") - F.col(c)
        both = F.col("n") / F.lit(inside + outside)
        part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
        ratio = part(a, both * inside) + part(b, both * outside)
        told = told | ((a / inside > b / outside) & (ratio >= SIGNIFICANT))
    found = counted.where(F.col("word").isNotNull() & told).select("word", "texts", "starts").collect()
    same = {(s, r["texts"]) for r in found for s in r["starts"] or []}
    return np.array(sorted(r["word"] for r in found if (r["word"], r["texts"]) not in same), dtype=np.int64)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    column: str = "toxic",
    seeds: dict[str, list[str]] = SEEDS,
    most: int = MOST_LABELLED,
) -> Chain:
    """A chain of the seeded categories and, last, the labelled one."""
    known, share = bounded(labels, column, most, "toxic")
    texts = docs.where(F.col("doc_id").isNotNull() & sampled(F.col("doc_id"), share, "toxic")).select("doc_id", "text")
    # only the ids and texts of the bounded sample move; equal texts become one row
    same = texts.withColumn("text", F.coalesce("text", F.lit(""))).join(known, "doc_id")
    rows = cut_lineage(same.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")))
    categories = [*seeds, column]
    marks = [np.array([word_name(w) for w in words], dtype=np.int64) for words in seeds.values()]
    names = _picked(rows, marks, categories)
    n = len(names)
    chain = Chain(categories, names, np.zeros((len(categories), n)), np.zeros((len(categories),) * 2), np.zeros(len(categories)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, has array<string>, " + ", ".join(f"`{c}` double" for c in categories)
    rows = rows.mapInArrow(_featured(marks, categories, names), kinds)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")
    if n:
        places = CountVectorizerModel.from_vocabulary([str(i) for i in range(n)], inputCol="has", outputCol="found")
        rows = places.setBinary(True).setMinTF(1.0).transform(rows).drop("has").withColumnRenamed("found", "has")
    rows = cut_lineage(rows.select("has", fold, *categories).coalesce(TASKS))
    for i, c in enumerate(categories):
        seen = {r[c]: r["count"] for r in rows.groupBy(c).count().collect()}
        if len(seen) < 2 or not n:
            p = (seen.get(1.0, 0) + 0.5) / (sum(seen.values()) + 1)
            chain.intercepts[i] = np.log(p / (1 - p))
            rows = rows.withColumn(f"p_{c}", F.lit(float(p)))
            continue
        before = [f"p_{x}" for x in categories[:i]]
        ready = VectorAssembler(inputCols=["has", *before], outputCol="x").transform(rows)
        ready = cut_lineage(ready).coalesce(TASKS)
        learner = LogisticRegression(featuresCol="x", labelCol=c, regParam=RIDGE, standardization=False, maxIter=25, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y")
        model = learner.fit(ready)
        weights = model.coefficients.toArray()
        chain.weights[i], chain.earlier[i, :i], chain.intercepts[i] = weights[:n], weights[n:], model.intercept
        if i + 1 == len(categories):
            break
        parts = []
        for f in range(FOLDS):
            rest = ready.where(F.col("fold") != f)
            own = ready.where(F.col("fold") == f)
            if rest.select(c).distinct().count() < 2:
                parts.append(own.withColumn(f"p_{c}", F.lit(float(seen.get(1.0, 0) / sum(seen.values())))))
            else:
                parts.append(learner.fit(rest).transform(own).withColumn(f"p_{c}", vector_to_array("_p")[1]).drop("_p", "_r", "_y"))
        rows = reduce(DataFrame.unionByName, parts)
        rows = cut_lineage(rows.drop("x").coalesce(TASKS))
    return chain


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """All columns of ``docs`` with ``_t_<category>`` probabilities."""
    names = [f"_t_{c}" for c in chain.categories]
    rows = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.probabilities(batch.column("text"))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(p[:, i].copy()) for i in range(len(names))]], names=[*batch.schema.names, *names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in names]]))
