"""Windows and fragments against a list-based reading of the rules."""

import itertools

import pytest
from pyspark.sql import functions as F

from trackweave.operators.windows import PADDINGS, fragments, slice_windows
from trackweave.sources.tracks import chunked, lengths


def samples(spark, tracks):
    rows = [(t, i, float(v)) for t, values in tracks.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "track bigint, pos bigint, value double")


def sliced(spark, tracks, width, context=0, step=None, padding="center", chunk=4):
    df = samples(spark, tracks)
    got = slice_windows(chunked(df, chunk), lengths(df), chunk, width, context, step, padding)
    return {(r.track, r.win_idx): list(r.x) for r in got.collect()}


def expected(values, width, context, step, padding):
    full = width + context
    step = step or full
    values = list(values)
    rest = len(values) % step
    if rest and padding == "right-align":
        values = values[: len(values) - rest] + values[-step:]
    elif rest:
        fill = step - rest
        left = fill // 2 if padding == "center" else 0
        values = [0.0] * left + values + [0.0] * (fill - left)
    starts = [i for i in range(0, len(values), step) if i + full <= len(values)]
    return {i // step: [float(v) for v in values[i : i + full]] for i in starts}


def test_right_padding(spark):
    got = sliced(spark, {0: [1] * 16}, 5, padding="right")
    assert len(got) == 4
    assert max(w for _, w in got) * 5 == 15
    assert got[0, 3] == [1, 0, 0, 0, 0]


def test_center_padding(spark):
    got = sliced(spark, {0: [1] * 17}, 5)
    assert len(got) == 4
    assert got[0, 0] == [0, 1, 1, 1, 1]
    assert got[0, 3] == [1, 1, 1, 0, 0]


def test_right_align(spark):
    got = sliced(spark, {0: range(1, 8)}, 5, padding="right-align")
    assert got == {(0, 0): [1, 2, 3, 4, 5], (0, 1): [3, 4, 5, 6, 7]}


def test_overlapping(spark):
    got = sliced(spark, {0: range(16)}, 4, step=2)
    assert len(got) == 7
    assert got[0, 3] == [6, 7, 8, 9]


def test_too_short_gives_nothing(spark):
    assert sliced(spark, {0: [1, 2]}, 5, padding="right-align") == {}


def test_unknown_padding(spark):
    with pytest.raises(ValueError):
        sliced(spark, {0: [1]}, 5, padding="left")


@pytest.mark.parametrize("padding", PADDINGS)
@pytest.mark.parametrize("shape", [(5, 0, None), (4, 0, 2), (4, 2, 3), (3, 0, 5), (2, 0, 9), (1, 1, 14)])
def test_all_lengths(spark, padding, shape):
    tracks = {n: [i + 1 for i in range(n)] for n in range(1, 24)}
    want = {
        (n, w): x for n, values in tracks.items() for w, x in expected(values, *shape, padding).items()
    }
    assert sliced(spark, tracks, *shape, padding=padding, chunk=3) == want


@pytest.mark.parametrize("chunk", [5, 10, 7])
def test_aligned_chunks(spark, chunk):
    tracks = {n: [i + 1 for i in range(n)] for n in range(1, 24)}
    want = {(n, w): x for n, v in tracks.items() for w, x in expected(v, 5, 0, None, "right").items()}
    assert sliced(spark, tracks, 5, padding="right", chunk=chunk) == want


def cut_out(spark, tracks, wanted, length, chunk=4):
    df = samples(spark, tracks)
    requests = spark.createDataFrame(wanted, "track bigint, offset bigint")
    got = fragments(chunked(df, chunk), lengths(df), chunk, requests, length)
    return {(r.track, r.offset): list(r.x) for r in got.collect()}


def fragment(values, offset, length):
    pad = (length + 1) // 2
    padded = [0.0] * pad + [float(v) for v in values] + [0.0] * pad
    if len(values) < length:
        start = len(padded) // 2 - pad
    elif offset <= 0:
        start = pad + max(offset, -pad)
    elif offset + length >= len(padded):
        start = len(padded) - length
    else:
        start = offset + pad
    taken = padded[start : start + length]
    return [taken[i % len(taken)] for i in range(length)]


def test_tone_fragments(spark):
    rate, length = 4, 20
    got = cut_out(spark, {0: [3.0] * 40}, [(0, 0), (0, -rate), (0, 6 * rate)], length)
    assert 0.0 not in got[0, 0]
    assert got[0, -rate].count(0.0) == rate and got[0, -rate][:rate] == [0.0] * rate
    assert got[0, 6 * rate].count(0.0) == rate and got[0, 6 * rate][-rate:] == [0.0] * rate


def test_short_tone_is_centred(spark):
    x = cut_out(spark, {0: [3.0] * 12}, [(0, 5)], 20)[0, 5]
    assert x[:4] == [0.0] * 4 and x[4:16] == [3.0] * 12 and x[16:] == [0.0] * 4


def test_far_offsets(spark):
    got = cut_out(spark, {0: [3.0] * 40}, [(0, o) for o in (-4, -2000, 40, 2000)], 28)
    assert all(len(x) == 28 for x in got.values())
    assert got[0, -2000][:14] == [0.0] * 14 and got[0, 2000][-14:] == [0.0] * 14


@pytest.mark.parametrize("length", [4, 5, 9])
def test_all_offsets(spark, length):
    tracks = {n: [i + 1 for i in range(n)] for n in range(1, 20)}
    wanted = list(itertools.product(tracks, (-50, -3, -1, 0, 1, 5, 8, 13, 20, 40)))
    got = cut_out(spark, tracks, wanted, length, chunk=3)
    assert got == {(n, o): fragment(tracks[n], o, length) for n, o in wanted}


def test_one_track_spreads_over_groups(spark):
    """A long track is cut from many chunks, none of them larger than asked."""
    df = spark.range(5000).select(
        F.lit(1).cast("bigint").alias("track"), F.col("id").alias("pos"), F.col("id").cast("double").alias("value")
    )
    chunks = chunked(df, 64)
    assert chunks.agg(F.max(F.size("values"))).first()[0] == 64
    got = slice_windows(chunks, lengths(df), 64, 100, step=50, padding="right")
    assert got.count() == 99
    assert got.where("x[0] <> start_pos or x[99] <> start_pos + 99").count() == 0


def read_by_queue(tracks, queue):
    """Rounds of a queue that is filled up, read once round and cleared of what has ended."""
    waiting, open_, out, number = list(tracks), [], [], 0
    while True:
        while len(open_) < queue - 1 and waiting:
            open_.append([*waiting.pop(0), 0])
        if not open_:
            return out
        out.append((number, 0, None))
        slot = 0
        for entry in open_:
            track, n, at = entry
            if at < n:
                slot += 1
                out.append((number, slot, track))
                entry[2] += 1
            else:
                entry[2] = None
        open_ = [e for e in open_ if e[2] is not None]
        number += 1


@pytest.mark.parametrize(("queue", "workers"), [(2, 1), (4, 1), (4, 3), (9, 5)])
def test_refilled_queue_of_unequal_tracks(spark, queue, workers):
    from trackweave.operators.batches import refilled_queue

    sizes = {t: (t * 7) % 11 + 1 for t in range(23)}
    rows = [(t, w, f"k{t % 3}") for t, n in sizes.items() for w in range(n)]
    df = spark.createDataFrame(rows, "track bigint, win_idx bigint, label string")
    got = refilled_queue(df, queue, workers, 5).collect()
    order = sorted(sizes, key=lambda t: __import__("hashlib").md5(f"5|{t}".encode()).hexdigest())
    share = -(-len(order) // workers)
    for worker in range(workers):
        own = [(t, sizes[t]) for t in order[worker * share : (worker + 1) * share]]
        mine = sorted((r["round"], r["slot"], r["track"]) for r in got if r["worker"] == worker)
        assert mine == read_by_queue(own, queue)
    picked = [(r["track"], r["win_idx"], r["label"]) for r in got if r["track"] is not None]
    assert sorted(picked) == sorted(rows)
    assert {r["label"] for r in got if r["track"] is None} == {"noise"}


def test_refilled_queue_of_nothing(spark):
    from trackweave.operators.batches import refilled_queue

    df = spark.createDataFrame([], "track bigint, win_idx bigint, label string")
    assert refilled_queue(df, 4, 2, 5).count() == 0
    with pytest.raises(ValueError):
        refilled_queue(df, 1, 2, 5)
