"""Recordings and pairs out of state: equal to the batch result at any cut of the stream."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave.functions.draws import digest
from trackweave.session import work_path
from trackweave.streaming import ingest, state


class Memory:
    """A stand-in for the state handle: what the processors keep, in plain Python."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, Cell())

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class Cell:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def slices(values, width, step, padding):
    """Windows of a whole recording."""
    rest = len(values) % step
    if rest:
        values = values + [0.0] * (step - rest) if padding == "right" else values[: len(values) - rest] + values[-min(len(values), step) :]
    return [values[k : k + width] for k in range(0, len(values) - width + 1, step)]


@pytest.mark.parametrize("padding", ["right", "right-align"])
@pytest.mark.parametrize(("width", "step"), [(5, 5), (6, 2), (3, 7), (10, 4)])
def test_windows_across_any_parts(padding, width, step):
    rng = random.Random(width * step)
    for n in [0, 1, 3, 6, 7, 20, 41, 67]:
        values = [float(rng.randrange(100)) for _ in range(n)]
        cutter = state.WindowCutter(width, step, padding)
        memory = Memory()
        cutter.init(memory)
        rows, at = [], 0
        while at < n:
            end = min(n, at + rng.randrange(1, 9))
            part = pd.DataFrame({"ts": pd.Timestamp(2024, 1, 1) + pd.to_timedelta(range(at, end), "s"), "pos": range(at, end), "value": values[at:end]})
            rows += [r for f in cutter.handleInputRows((1,), iter([part.sample(frac=1, random_state=n)]), None) for r in f.itertuples(index=False)]
            kept = cutter.kept.get()
            assert len(kept[3]) < width + 2 * step + 1 and len(memory.timers) == 1
            at = end
        if n:
            rows += [r for f in cutter.handleExpiredTimer((1,), None, None) for r in f.itertuples(index=False)]
            assert not cutter.kept.exists()
        assert [r.x for r in rows] == slices(values, width, step, padding)
        assert [r.start_pos for r in rows] == [step * i for i in range(len(rows))]


def test_missing_samples_are_zeros():
    cutter = state.WindowCutter(4)
    cutter.init(Memory())
    part = pd.DataFrame({"ts": pd.Timestamp(2024, 1, 1), "pos": [1, 2, 5, 0, 9], "value": [1.0, 2.0, 5.0, 7.0, 9.0]})
    first = [r for f in cutter.handleInputRows((1,), iter([part]), None) for r in f["x"]]
    last = [r for f in cutter.handleExpiredTimer((1,), None, None) for r in f["x"]]
    assert first == [] and last == [[7, 1, 2, 0], [0, 5, 0, 0], [0, 9, 0, 0]]


def test_centred_windows_need_the_whole_recording():
    with pytest.raises(ValueError):
        state.WindowCutter(5, padding="center")


def test_state_shrinks_when_recordings_end(spark):
    """Four recordings one after the other over eight files; at the end only the end mark is kept."""
    rows = [(t, 1000 + t * 100 + p, p, float(p)) for t in range(4) for p in range(23)] + [(-1, 10**6, 0, 0.0)]
    df = spark.createDataFrame(rows, "track bigint, s bigint, pos bigint, value double")
    df = df.select("track", F.timestamp_seconds("s").alias("ts"), "pos", "value")
    root = work_path(spark, "shrinks")
    state.write_in_order(df, f"{root}/in", "ts", 8)
    stream = ingest.read_arriving(spark, f"{root}/in", df.schema, 1)
    with state.keyed_state(spark):
        run = ingest.run_batches(state.arriving_windows(stream, "0 seconds", state.WindowCutter(5, gap_ms=50_000)), lambda b: b, f"{root}/out", f"{root}/state")
        run.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress]
    assert max(kept) <= 4 and kept[-1] <= 2
    got = {(r["track"], r["win_idx"]): r["x"] for r in spark.read.parquet(f"{root}/out").where("track >= 0").collect()}
    want = {(t, i): x for t in range(4) for i, x in enumerate(slices([float(p) for p in range(23)], 5, 5, "right"))}
    assert got == want


SIZE = 4


def pair_rows():
    rng = random.Random(3)
    rows = [(t % 3, t, w // 2, w, float(t * 100 + w), rng.randrange(14) if w % 4 else None) for t in range(12) for w in range(8 + t % 4)]
    return rows + [(t % 3, t, (7 + t % 4) // 2, None, None, None) for t in range(12)]


def slow_batches(rows, limit):
    import hashlib

    out = set()
    for worker in {r[0] for r in rows}:
        seen = {(t, w): (s, total) for k, t, s, w, total, _ in rows if k == worker and w is not None}
        pairs = []
        for k, t, s, w, total, nbr in rows:
            if k == worker and nbr is not None and (t, nbr) in seen:
                order = hashlib.md5(f"7|{t}|{w}".encode()).hexdigest()
                pairs.append((max(s, seen[t, nbr][0]), order, t, w, total, nbr, seen[t, nbr][1]))
        pairs.sort()
        for i, p in enumerate(pairs[: len(pairs) // SIZE * SIZE]):
            if limit < 0 or (worker == 0 and i // SIZE < limit):
                out.add((worker, i // SIZE, i % SIZE, *p[2:]))
    return out


@pytest.mark.parametrize("limit", [-1, 2])
def test_pairs_with_a_restart_in_the_middle(spark, limit):
    """The second run goes on with the open batch and the waiting windows of the first."""
    rows = pair_rows()
    kinds = "worker bigint, track bigint, slice bigint, win_idx bigint, total double, nbr bigint"
    root = work_path(spark, "restart")

    def run(part):
        df = spark.createDataFrame(part, kinds)
        df.repartitionByRange(2, "slice").write.mode("append").parquet(f"{root}/in")
        stream = ingest.read_arriving(spark, f"{root}/in", df.schema, 10)
        with state.keyed_state(spark):
            made = state.arriving_batches(state.arriving_pairs(stream), state.BatchMaker(SIZE, limit), digest(7, "track", "anchor_win_idx"))
            query = ingest.run_batches(made.withColumnRenamed("batch", "pair_batch"), lambda b: b, f"{root}/out", f"{root}/state")
            query.awaitTermination()
        return query

    run([r for r in rows if r[2] < 2])
    last = run([r for r in rows if r[2] >= 2])
    names = ["worker", "pair_batch", "slot", "track", "anchor_win_idx", "anchor_total", "neighbor_win_idx", "neighbor_total"]
    got = [tuple(r[n] for n in names) for r in spark.read.parquet(f"{root}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == slow_batches(rows, limit)
    # ended tracks have left nothing; each worker keeps a count and an open batch
    kept = {s["operatorName"] + str(i): s["numRowsTotal"] for i, s in enumerate(last.lastProgress["stateOperators"])}
    assert min(kept.values()) <= 3 * (SIZE + 1)


@pytest.mark.parametrize("files", [8, 24, 144])
def test_a_larger_table_comes_in_no_more_batches(files):
    assert -(-files // ingest.files_per_batch(files)) == 2


def test_one_timer_and_few_calls_for_a_part():
    memory, calls = Memory(), []
    memory.listTimers = lambda: calls.append("list") or iter(memory.timers)
    cutter = state.WindowCutter(4)
    cutter.init(memory)
    for at in (0, 3, 3):
        part = pd.DataFrame({"ts": pd.Timestamp(2024, 1, 1) + pd.Timedelta(at, "s"), "pos": [at], "value": [1.0]})
        list(cutter.handleInputRows((1,), iter([part]), None))
        assert memory.timers == {int(part["ts"][0].value // 1_000_000) + cutter.gap}
    assert not calls


class Places(dict):
    """A stand-in for map state that counts its calls."""

    calls = 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self[key]


def test_pairs_touch_the_state_once_for_neighbouring_windows():
    maker, maps = state.PairMaker(), {}
    maker.init(type("Handle", (), {"getMapState": lambda self, name, *kinds: maps.setdefault(name, Places())})())
    got = []
    for lo in (0, 30):
        part = pd.DataFrame({"win_idx": range(lo, lo + 30), "slice": lo, "total": 1.0, "nbr": [(w * 7 + 3) % 60 for w in range(lo, lo + 30)]})
        got += [r for f in maker.handleInputRows((0, 1), iter([part]), None) for r in f.itertuples(index=False)]
    assert sorted((r.anchor_win_idx, r.neighbor_win_idx) for r in got) == [(w, (w * 7 + 3) % 60) for w in range(60)]
    assert all(r.slice == (30 if max(r.anchor_win_idx, r.neighbor_win_idx) >= 30 else 0) for r in got)
    assert sum(m.calls for m in maps.values()) <= 10


def test_full_batches_leave_together():
    class Rows(Cell):
        put = Cell.update

    maker = state.BatchMaker(4)
    maker.init(type("Handle", (), {"getListState": lambda self, *a: Rows(), "getValueState": lambda self, *a: Cell()})())
    part = pd.DataFrame({"slice": 0, "draw": "a", "track": range(42), "anchor_win_idx": 0, "anchor_total": 0.0, "neighbor_win_idx": 0, "neighbor_total": 0.0})
    out = list(maker.handleInputRows((2,), iter([part]), None))
    assert len(out) == 1 and out[0]["track"].tolist() == list(range(40))
    assert out[0]["batch"].tolist() == [i // 4 for i in range(40)] and out[0]["slot"].tolist() == [i % 4 for i in range(40)]
    assert [r[0] for r in maker.open.get()] == [40, 41] and maker.given.get() == (10,)
