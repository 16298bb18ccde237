"""Language-model scoring with a probabilistic suffix tree over words.

The tree holds contexts of up to ``depth`` words. A context seen at least twice enters if
its next-word distribution diverges from that of its longest suffix in the tree by at least
``divergence`` nats; all its next words seen at least twice after it are entries. Larger
bounds can be given as shares of the training tokens. Contexts and entries are Spark tables
that grow with the corpus.

Smoothing: every entry gives up ``DISCOUNT`` counts; what a context's entries leave goes to
its suffix, and from the root to all words by ``(c + 0.1) / (N + 0.1 (V + 1))``. Each token
is scored in the state of its longest suffix, so all next words sum to 1.

The logarithm of a token's probability is a sum over the runs of words that end at it: the
root's, what each context leaves, and what each entry gains over its suffix. So a text's
score is a sum over its runs. Runs with at least a share ``HEAD`` of the tokens are sent to
the tasks; the others are looked up by their hash. A bitmap of fixed size spares that for most
runs without a value and loses none; when it is full it only spares less.

Runs are exchanged as lists, one row for each range of the hashes. The ranges follow the number
of tokens, so one range fits a task. Tables are deleted when nothing reads them any more.

Defined cases: null text counts as empty and has its end token alone; a null id counts as
the empty text in the split; an empty training set gives every token probability 1;
repeated rows are scored each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from trackweave.llm.words import Words, mix, word_pieces
from trackweave.session import cut_lineage, discard, shuffles_removed

END = np.uint64(0x9E3779B97F4A7C15)  # the token after the last word
DISCOUNT = 0.5
ALPHA = 0.1
_ENTRY = np.uint64(0xA0761D6478BD642F)
HEAD = 2e-6  # share of the tokens from which a word or run is sent to the tasks
SLOTS = 21  # the bitmap has 2**SLOTS slots of 64 bits


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether the remainder of ``crc32`` of the id as text is the given one."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)) == remainder


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """``(token hashes, first)`` of the texts, each followed by the end token."""
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    out = np.empty(int(first[-1]), dtype=np.uint64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[first[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = words.hashes()
    return out, first


def entry(ctx: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    return mix(ctx * _ENTRY + nxt)


def runs(toks: np.ndarray, first: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size up to ``most``: hash of the run that ends at each token, and whether the text has it.

    A run's hash is that of the runs without its last and without its first token.
    """
    at = np.arange(len(toks)) - np.repeat(first[:-1], np.diff(first))
    out = [(toks, at >= 0)]
    for size in range(1, most):
        h = out[-1][0]
        longer = np.zeros_like(h)
        longer[1:] = entry(h[:-1], h[1:])
        out.append((longer, at >= size))
    return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted list, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys


@dataclass
class Level:
    """Frequent contexts of one depth and their frequent entries, sorted by hash."""

    contexts: np.ndarray
    rest: np.ndarray  # log of what each context leaves to its suffix
    entries: np.ndarray
    gain: np.ndarray  # log of the entry's probability over what its suffix would give it


@dataclass
class Tree:
    total: int  # N
    distinct: int  # V
    words: np.ndarray  # frequent words, sorted
    counts: np.ndarray
    levels: list[Level] = field(default_factory=list)
    rare: np.ndarray = field(default_factory=lambda: np.zeros(1 << SLOTS, dtype=np.uint64))  # bitmap of the other runs
    bits: int = 0  # the other runs are looked up in 2**bits ranges of the hashes

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ALPHA) / (self.total + ALPHA * (self.distinct + 1))

    def logs(self, toks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Per token: logs of what its contexts leave and its entries gain; places and hashes of other runs."""
        sizes = runs(toks, first, len(self.levels) + 1)
        rest, gain, others = np.zeros(len(toks)), np.zeros(len(toks)), []
        here = [np.zeros(len(toks), dtype=bool) for _ in sizes]
        ends = np.arange(len(toks) - 1)  # ends of contexts whose suffix is frequent and in the tree
        for d, level in enumerate(self.levels, 1):
            h, there = sizes[d]
            ends = ends[there[ends + 1]]
            at, inside = _find(level.contexts, sizes[d - 1][0][ends])
            ends = ends[inside]
            here[d - 1][ends] = True
            rest[ends + 1] += level.rest[at[inside]]
            at, inside = _find(level.entries, h[ends + 1])
            here[d][ends[inside] + 1] = True
            gain[ends[inside] + 1] += level.gain[at[inside]]
        shorter = None
        for d, ((h, there), known) in enumerate(zip(sizes[1:], here[1:]), 1):
            marked = _marked(self.rare, h)
            at = np.flatnonzero(there & ~known & marked)
            if d == len(self.levels) > 1:  # an entry's context and the entry of its suffix have values too
                at = at[shorter[at] & shorter[at - 1]]
            shorter = known | marked
            others.append((at, h[at]))
        return rest, gain, others

    def split(self, toks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per token: probability = ``add`` + ``keep`` * root; the root and whether it is known here."""
        at, frequent = _find(self.words, toks)
        root = self.root(self.counts[at]) if len(self.counts) else np.ones(len(toks))
        rest, gain, _ = self.logs(toks, first)
        keep = np.exp(rest)
        return keep * root * np.expm1(gain), keep, root, frequent


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[h >> np.uint64(64 - SLOTS)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of the hashes ``key``."""
    slot = F.shiftrightunsigned("key", 64 - SLOTS).alias("slot")
    bit = F.expr("shiftleft(1L, CAST(key & 63L AS int))")
    slot, value = _columns(keys.select(slot, bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bit")))
    out = np.zeros(1 << SLOTS, dtype=np.uint64)
    out[slot] = value.view(np.uint64)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _blocks(key: np.ndarray, columns: dict[str, np.ndarray], bits: int) -> pa.RecordBatch:
    """A row for each of the ``2**bits`` ranges of the hashes that has any, with a list of each column."""
    part = (key >> np.uint64(1)) >> np.uint64(63 - bits)
    order = np.argsort(part.astype(np.uint16), kind="stable")
    cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1, dtype=np.uint64))
    filled = np.flatnonzero(np.diff(cuts))
    at = pa.array(np.append(cuts[filled], len(key)).astype(np.int32))
    lists = {c: pa.ListArray.from_arrays(at, pa.array(x[order])) for c, x in columns.items()}
    return pa.RecordBatch.from_pydict({"part": pa.array(filled.astype(np.int32)), **lists})


def _whole(x: pa.Array) -> pa.Array:
    """All values as the list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _list(table: pa.Table, column: str) -> np.ndarray:
    """The lists of a column, one after the other."""
    return pc.list_flatten(table.column(column)).combine_chunks().to_numpy(zero_copy_only=False)


def _counted(parts: list[tuple[np.ndarray, ...]], size: int, bits: int) -> pa.RecordBatch:
    """Equal runs put together with their number, as blocks; the ``ctx`` of words is 0."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    if size == 1:
        key, n = np.unique(columns[0], return_counts=True)
        ctx, low = np.zeros_like(key), key
    else:
        key, at, n = np.unique(entry(*columns), return_index=True, return_counts=True)
        ctx, low = (c[at] for c in columns)
    columns = {"ctx": ctx.view(np.int64), "low": low.view(np.int64), "n": n.astype(np.int64)}
    out = _blocks(key, columns, bits)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), size, dtype=np.int32)), *out.columns], names=["size", *out.schema.names])


FLUSH = 2_000_000  # tokens put together in one task before they are handed on
GROUP = 500_000  # the same where equal runs stay apart, or table rows
RANGE = 1 << 21  # tokens for each range of the hashes whose runs are put together at once
ROUNDS = 2  # parts of the texts that are scored one after the other, so that fewer runs are on disk at once
WIDER = 1  # runs are looked up in ranges 2**WIDER times as wide, so that a text's sums are in fewer
BLOCKS = "size int, part int, ctx array<bigint>, low array<bigint>, n array<bigint>"


def _run_counts(most: int, least: int, known, bits: int):
    """``BLOCKS`` of the runs of ``least`` to ``most`` tokens: each without its last and without its first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = {k: [] for k in range(least, most + 1)}, 0
        for batch in batches:
            for _, words in word_pieces(batch.column(0)):
                toks, first = tokens(words)
                sizes = runs(toks, first, most)
                held += len(toks)
                for size in parts:
                    if size == 1:
                        parts[1].append((toks,))
                        continue
                    h, pick = sizes[size - 2][0], np.flatnonzero(sizes[size - 1][1])
                    if known is not None:  # a run seen twice is of runs seen twice
                        marked = _marked(known.value, h)
                        pick = pick[marked[pick] & marked[pick - 1]]
                    parts[size].append((h[pick - 1], h[pick]))
                if held >= FLUSH:
                    for size in parts:
                        yield _counted(parts[size], size, bits)
                    parts, held = {k: [] for k in parts}, 0
        if held:
            for size in parts:
                yield _counted(parts[size], size, bits)

    return count


def _merged(table: pa.Table) -> pa.Table:
    """The counts of one range added up: all words, and the runs seen twice."""
    size = table.column("size")[0].as_py()
    ctx, low, n = _list(table, "ctx"), _list(table, "low"), _list(table, "n")
    key = entry(ctx.view(np.uint64), low.view(np.uint64)) if size > 1 else low.view(np.uint64)
    order = np.argsort(key)
    ordered = key[order]
    new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    n = np.add.reduceat(n[order], new)
    pick = np.flatnonzero(n >= 2) if size > 1 else np.arange(len(n))
    at = order[new[pick]]
    columns = [pa.array(np.full(len(at), size, dtype=np.int32)), _signed(key[at]), *map(pa.array, (ctx[at], low[at], n[pick]))]
    return pa.Table.from_arrays(columns, names=["size", "key", "ctx", "low", "n"])


def _packed(bits: int):
    """Rows ``(key, n, value)`` as blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= GROUP:
                yield blocks(held)
                held, rows = [], 0
        if rows:
            yield blocks(held)

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        columns = {c: table.column(c).to_numpy() for c in ("key", "n", "value")}
        return _blocks(columns["key"].view(np.uint64), columns, bits)

    return pack


def _united(table: pa.Table) -> pa.Table:
    """The blocks of one range as one, with one place for each key, in order."""
    key = _list(table, "key").view(np.uint64)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    columns = {"key": _signed(key[new])} | {c: pa.array(np.add.reduceat(_list(table, c)[order], new)) for c in ("n", "value")}
    return pa.table({"part": table.column("part").slice(0, 1)} | {c: _whole(x) for c, x in columns.items()})


def _bits_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of the bitmap for the runs among the ordered keys of each range."""
    for batch in batches:
        for keys, n in zip(batch.column("key"), batch.column("n")):
            h = keys.values.to_numpy().view(np.uint64)
            h = h[n.values.to_numpy() == 0]
            if not len(h):
                continue
            slot = h >> np.uint64(64 - SLOTS)
            new = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            bit = np.bitwise_or.reduceat(np.uint64(1) << (h & np.uint64(63)), new)
            yield pa.RecordBatch.from_arrays([_signed(slot[new]), _signed(bit)], names=["slot", "bit"])


def _columns(df: DataFrame) -> list[np.ndarray]:
    """Columns of a table of bounded size."""
    table = df.toArrow()
    return [table.column(i).to_numpy() for i in range(table.num_columns)]


def train(
    docs: DataFrame,
    depth: int = 2,
    least_context: float = 0.0,
    least_entry: float = 0.0,
    divergence: float = 0.05,
    head: float = HEAD,
) -> tuple[Tree, DataFrame]:
    """The frequent part of the tree of ``docs``, and the table of all else.

    The table has what a word or run adds to a text, ``(key, n, value)`` in blocks: the
    count of a word (0 for longer runs) and the logarithm of what contexts leave and
    entries gain.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(0, int(size // 6 // RANGE).bit_length()))

    def counted(most: int, least: int, known=None) -> DataFrame:
        found = texts.mapInArrow(_run_counts(most, least, known, bits), BLOCKS).groupBy("size", "part")
        return cut_lineage(found.applyInArrow(_merged, "size int, key bigint, ctx bigint, low bigint, n bigint"))

    with shuffles_removed(spark):
        got = counted(2, 1) if depth else counted(1, 1)
        words = cut_lineage(got.where("size = 1").select("key", "n"))
        whole = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        total, distinct = int(whole["n"] or 0), int(whole["v"])
        enough, context = max(2.0, least_entry * total), max(2.0, least_context * total)
        often = max(enough, head * total)
        tree = Tree(total, distinct, *_sorted(words.where(F.col("n") >= often)), bits=max(0, bits - WIDER))
        root = F.log((F.col("n") + ALPHA) / (total + ALPHA * (distinct + 1)))
        below = words.where(F.col("n") >= enough).select("key", "n", root.alias("lp"), F.lit(True).alias("open"))
        frequent = F.col("n") >= often
        others, used = [], [words]
        for d in range(1, depth + 1):
            if d > 1:
                got = counted(d + 1, d + 1, spark.sparkContext.broadcast(_bitmap(below.select("key"))))
            seen = got.where((F.col("size") == d + 1) & (F.col("n") >= enough)).select("key", "ctx", "low", "n")
            rows = cut_lineage(seen.join(below.select(F.col("key").alias("low"), F.col("lp").alias("below")), "low"))
            discard(got)
            # sum of n/size * (log(n/size) - below) and of (n - DISCOUNT)/size over a context's entries
            states = rows.groupBy("ctx").agg(
                F.sum(F.col("n") * (F.log("n") - F.col("below"))).alias("told"),
                F.sum("n").alias("n"),
                F.sum(F.col("n") - DISCOUNT).alias("given"),
            )
            size = below.where(F.col("open") & (F.col("n") >= context)).select(F.col("key").alias("ctx"), F.col("n").alias("size"))
            states = states.join(size, "ctx")
            told = (F.col("told") - F.col("n") * F.log("size")) / F.col("size")
            rest = F.log(1.0 - F.col("given") / F.col("size"))
            states = cut_lineage(states.where(told >= divergence).select("ctx", rest.alias("rest"), "size"))
            share = (F.col("n") - DISCOUNT) / F.col("size")
            lp = F.when(F.col("rest").isNull(), F.col("below")).otherwise(F.log(share + F.exp(F.col("rest") + F.col("below"))))
            gain = (F.col("lp") - F.col("below") - F.col("rest")).alias("gain")  # null where the context is not in the tree
            valued = rows.join(states, "ctx", "left" if d < depth else "inner").withColumn("lp", lp)
            if d < depth:  # longer contexts are those whose suffix is in the tree
                open_ = states.select(F.col("ctx").alias("low"), F.lit(True).alias("open"))
                valued = valued.join(open_, "low", "left")
                below = cut_lineage(valued.select("key", "n", "lp", F.coalesce("open", F.lit(False)).alias("open"), gain))
            else:
                below = cut_lineage(valued.select("key", "n", gain))
            discard(rows)
            used += [states, below]
            entries = below.where("gain IS NOT NULL").select("key", "n", F.col("gain").alias("v"))
            contexts = states.select(F.col("ctx").alias("key"), F.col("size").alias("n"), F.col("rest").alias("v"))
            tree.levels.append(Level(*_sorted(contexts.where(frequent).select("key", "v")), *_sorted(entries.where(frequent).select("key", "v"))))
            others += [entries.where(~frequent), contexts.where(~frequent)]
        if not depth:
            discard(got)
        table = words.where(~frequent).select("key", "n", F.lit(0.0).alias("value"))
        for part in others:
            table = table.unionByName(part.select("key", F.lit(0).cast("bigint").alias("n"), F.col("v").alias("value")))
        blocks = "part int, key array<bigint>, n array<bigint>, value array<double>"
        table = table.mapInArrow(_packed(bits), blocks).groupBy("part").applyInArrow(_united, blocks)
        table = cut_lineage(table.withColumn("part", F.shiftright("part", bits - tree.bits)))
        slot, bit = _columns(table.select("key", "n").mapInArrow(_bits_set, "slot bigint, bit bigint"))
        np.bitwise_or.at(tree.rare, slot, bit.view(np.uint64))
    for x in used:
        discard(x)
    return tree, table


def _sorted(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and their numbers, of a table of bounded size."""
    key, value = _columns(df)
    order = np.argsort(key.view(np.uint64))
    return key.view(np.uint64)[order], value[order].astype(float)


class _Group:
    """Scores of the texts that a task hands on together, and their runs that are looked up."""

    def __init__(self):
        self.docs, self.keys, self.of, self.texts, self.held = [], [], [], 0, 0

    def add(self, docs: pa.RecordBatch, sums: dict[str, np.ndarray], of: np.ndarray, keys: np.ndarray) -> None:
        self.docs.append((docs, sums))
        self.keys.append(keys)
        self.of.append(of + self.texts)
        self.texts += len(docs)
        self.held += int(sums["n_tokens"].sum())

    def rows(self, name: int, bits: int) -> Iterator[pa.RecordBatch]:
        docs = pa.Table.from_batches([d for d, _ in self.docs]).combine_chunks()
        sums = {k: np.concatenate([s[k] for _, s in self.docs]) for k in self.docs[0][1]}
        one = {"group": pa.array([name]), "part": pa.array([name % (1 << bits)], pa.int32())}
        one |= {"of": _whole(pa.array(np.arange(self.texts, dtype=np.int32))), "key": pa.nulls(1, pa.list_(pa.int64()))}
        one |= {c: _whole(docs.column(c).combine_chunks()) for c in ("doc_id", "held_out")}
        one |= {k: _whole(pa.array(v)) for k, v in sums.items()}
        out = pa.RecordBatch.from_pydict(one)
        yield out
        key = np.concatenate(self.keys)
        found = _blocks(key, {"of": np.concatenate(self.of).astype(np.int32), "key": key.view(np.int64)}, bits)
        n = len(found)
        columns = {f.name: pa.nulls(n, f.type) for f in out.schema} | {c: found.column(c) for c in ("part", "of", "key")}
        yield pa.RecordBatch.from_pydict(columns | {"group": pa.array(np.full(n, name))})


def _scored(tree_sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = tree_sent.value
        name = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        group = _Group()
        for batch in batches:
            for row, words in word_pieces(batch.column("text")):
                toks, first = tokens(words)
                size = np.diff(first)
                at, known = _find(tree.words, toks)
                root = np.full(len(toks), tree.root(0))
                root[known] = tree.root(tree.counts[at[known]])
                rest, gain, others = tree.logs(toks, first)
                n = len(size)
                of = np.repeat(np.arange(n), size)
                total = lambda v: np.bincount(of, v, minlength=n)  # noqa: E731, B023
                base = total(np.log10(root))
                value = base + total(rest + gain) / np.log(10)
                others.append((np.flatnonzero(~known), toks[~known]))
                place, keys = (np.concatenate(x) for x in zip(*others))
                order = np.argsort(place, kind="stable")
                sums = {"n_tokens": size.astype(np.int64), "known": total(known).astype(np.int64), "base": base, "value": value}
                group.add(batch.slice(row, n).select(["doc_id", "held_out"]), sums, of[place[order]], keys[order])
                if group.held >= GROUP:
                    yield from group.rows(name, tree.bits)
                    name, group = name + 1, _Group()
        if group.texts:
            yield from group.rows(name, tree.bits)

    return score


def _looked_up(tree_sent):
    """What the words and runs of one range add to the texts; rows of the texts themselves pass."""

    def look(found: pa.Table, table: pa.Table) -> pa.Table:
        tree: Tree = tree_sent.value
        key = _list(table, "key").view(np.uint64)
        order = np.argsort(key, kind="stable")
        key, n, log = key[order], _list(table, "n")[order], _list(table, "value")[order]
        word = np.where(n > 0, np.log10(tree.root(n)) - np.log10(tree.root(0)), 0.0)
        out = [found.filter(found.column("key").is_null()).drop_columns(["part", "key"])]
        found = found.filter(found.column("key").is_valid())
        for group, of, keys in zip(*(found.column(c) for c in ("group", "of", "key"))):
            at, there = _find(key, keys.values.to_numpy().view(np.uint64))
            at, (texts, place) = at[there], np.unique(of.values.to_numpy()[there], return_inverse=True)
            total = lambda v: np.bincount(place, v, minlength=len(texts))  # noqa: E731, B023
            sums = {"of": texts, "known": total(n[at] > 0).astype(np.int64), "base": total(word[at]), "value": total(word[at] + log[at] / np.log(10))}
            row = {f.name: pa.nulls(1, f.type) for f in out[0].schema} | {"group": pa.array([group.as_py()])}
            out.append(pa.table(row | {c: _whole(pa.array(x)) for c, x in sums.items()}))
        return pa.concat_tables(x.cast(out[0].schema) for x in out)

    return look


def _added_up(found: pa.Table) -> pa.Table:
    """The rows of one group of texts, with the sums over all ranges."""
    texts = found.filter(found.column("doc_id").is_valid())
    of = _list(found, "of")
    sums = {}
    for c in ("known", "base", "value"):
        sums[c] = np.bincount(of, _list(found, c), minlength=len(_list(texts, "of")))
    columns = {c: pc.list_flatten(texts.column(c)) for c in ("doc_id", "held_out", "n_tokens")}
    return pa.table(columns | {"known": pa.array(sums["known"].astype(np.int64)), "base": pa.array(sums["base"]), "value": pa.array(sums["value"])})


def scored(docs: DataFrame, tree: Tree, table: DataFrame) -> DataFrame:
    """Each row of ``(doc_id, held_out, text)`` with its base score and the tree's score (log10)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(tree)
    lists = "doc_id array<{0}>, held_out array<boolean>, n_tokens array<bigint>, known array<bigint>, base array<double>, value array<double>".format(kind)
    score = f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, value double"
    parts = []
    with shuffles_removed(docs.sparkSession):
        for k in range(ROUNDS):
            texts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select("doc_id", "held_out", "text")
            found = texts.mapInArrow(_scored(sent), f"group bigint, part int, of array<int>, key array<bigint>, {lists}").groupBy("part")
            sums = found.cogroup(table.groupBy("part")).applyInArrow(_looked_up(sent), f"group bigint, of array<int>, {lists}")
            parts.append(cut_lineage(sums.groupBy("group").applyInArrow(_added_up, score)))
    return reduce(DataFrame.unionByName, parts).select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(tree.total).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("value").alias("score"),
    )
