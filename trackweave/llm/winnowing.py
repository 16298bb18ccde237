"""Document fingerprints by winnowing, in column expressions only.

A text is cut in words (``[^\\x20\\x09-\\x0D]``, at most ``PIECE`` characters each, so that
text without white space has parts too). Every run of ``k`` words is hashed; of every
``window`` consecutive hashes the smallest is kept, the rightmost one on ties, together
with its position. Two texts that share ``window + k - 1`` words in a row share a hash.

The leading bits of the hash and the counted-down position are packed in one number, so
that one comparison decides hash and position. The sliding minimum doubles its width:
windows of 2, 4, 8 hashes come from two windows of half the width.

Defined cases: null text counts as empty; a text without words has an empty fingerprint;
fewer than ``k`` words are hashed as one run; fewer hashes than a window form one window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

K, WINDOW, PIECE = 5, 8, 16
POSITION_BITS = 28
_MASK = (1 << POSITION_BITS) - 1
ROWS = 2_000  # documents of one range of ids
MOST_RANGES = 65_536  # further rows make the ranges longer
LOWEST = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), use)[0]


def packed(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The selected hashes of a text as packed numbers, in text order."""

    def grams(words: Column) -> Column:
        n = F.size(words)
        hashed = F.transform(words, lambda w: F.xxhash64(w))
        runs = let(
            hashed,
            lambda h: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)])),
        )
        return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(
            F.array().cast("array<bigint>")
        )

    def pack(hashes: Column) -> Column:
        return F.transform(
            hashes,
            lambda h, i: F.shiftleft(F.shiftright(h, POSITION_BITS), POSITION_BITS).bitwiseOR(F.lit(_MASK) - i),
        )

    def select(p: Column) -> Column:
        slid, width = p, 1
        while width < window:
            step = min(width, window - width)
            slid = let(slid, partial(_narrow, step))
            width += step
        # windows that run over the end hold a part of the last whole one
        return F.array_distinct(F.slice(slid, 1, F.greatest(F.size(p) - window + 1, F.least(F.size(p), F.lit(1)))))

    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^\\x20\\x09-\\x0D]{{1,{PIECE}}}"), F.lit(0))
    return let(let(let(pieces, grams), pack), select)


def _narrow(step: int, mins: Column) -> Column:
    """Minimum of each entry and the one ``step`` further on, if there is one."""
    return F.transform(mins, lambda x, i: F.least(x, F.get(mins, i + step)))


def hashes(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda p: F.shiftright(p, POSITION_BITS))


def positions(fingerprint: Column) -> Column:
    """Number of the first word of each selected run, from 0."""
    return F.transform(fingerprint, lambda p: F.lit(_MASK) - p.bitwiseAND(F.lit(_MASK)))


def as_text(fingerprint: Column) -> Column:
    """``position:hash`` pairs, the hash as hexadecimal number."""
    return F.array_join(
        F.transform(
            fingerprint,
            lambda p: F.concat(
                (F.lit(_MASK) - p.bitwiseAND(F.lit(_MASK))).cast("string"),
                F.lit(":"),
                F.lower(F.hex(F.shiftrightunsigned(p, POSITION_BITS))),
            ),
        ),
        ",",
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hash sets; two empty ones are alike."""
    both = F.struct(hashes(a).alias("a"), hashes(b).alias("b"))

    def compare(s: Column) -> Column:
        shared = F.size(F.array_intersect(s["a"], s["b"])).cast("double")
        every = F.size(F.array_union(s["a"], s["b"]))
        return F.when(every == 0, 1.0).otherwise(shared / every)

    return let(both, compare)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the key, found in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x) for x in xs])
    heads = F.size(F.filter(longs([p[0] for p in parts]), lambda b: b <= key))
    fine = F.array(*[longs(p) for p in parts])
    inside = let(heads, lambda h: F.when(h > 0, (h - 1) * step + F.size(F.filter(fine[F.greatest(h, F.lit(1)) - 1], lambda b: b <= key))).otherwise(0))
    return inside


def with_next(docs: DataFrame, columns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``(doc_id, text, next_text, ...)``: each text beside the next one by ascending id.

    The last row is followed by the first. Equal ids are ordered by text; null ids come
    first. ``columns`` names values computed once from each text; the next document's is
    added as ``next_<name>``. Texts are shuffled once, by ranges of ids; the first row of
    each range is also sent to the range before it, so that no range waits for another.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("_key"))
    n = rows.count()
    parts = min(MOST_RANGES, max(1, math.ceil(n / ROWS)))
    bounds: list[int] = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        got = rows.agg(F.percentile_approx("_key", shares, 10 * parts + 10_000).alias("b")).first()["b"]
        bounds = sorted(set(got))
    ranged = rows.withColumn("_range", _range_of(F.col("_key"), bounds).cast("int"))
    firsts = {r["_range"]: r["k"] for r in ranged.groupBy("_range").agg(F.min("_key").alias("k")).collect()}
    there = sorted(firsts)
    first_of = [firsts.get(i) for i in range(len(bounds) + 1)]
    before = [None] * (len(bounds) + 1)
    for i, r in enumerate(there):
        before[r] = there[i - 1]
    at = lambda xs, kind: F.array(*[F.lit(x).cast(kind) for x in xs])[F.col("_range")]
    also = F.when(at(first_of, "bigint") == F.col("_key"), at(before, "int"))
    home = F.struct(F.col("_range").alias("r"), F.lit(0).alias("extra"))
    extra = F.struct(also.alias("r"), F.lit(1).alias("extra"))
    sent = ranged.withColumn("_to", F.explode(F.when(also.isNull(), F.array(home)).otherwise(F.array(home, extra))))
    # plain columns: both windows then use one exchange and one sort
    sent = sent.select("doc_id", "text", "_key", F.col("_to.r").alias("_part"), F.col("_to.extra").alias("_extra"))
    in_order = Window.partitionBy("_part").orderBy("_extra", "_key", "text")
    out = sent.withColumn("next_text", F.lead("text").over(in_order))
    for name, value in columns.items():
        out = out.withColumn(name, value(F.col("text")))
    for name in columns:
        out = out.withColumn(f"next_{name}", F.lead(name).over(in_order))
    return out.where("_extra = 0").drop("_key", "_part", "_extra")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by the beginning of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with likeness to both neighbours."""
    rows = with_next(docs, {"fp": packed})
    changed = rows.withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    marked = changed.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        "fp",
        "next_fp",
        packed(F.col("_edited")).alias("edited_fp"),
    )
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
