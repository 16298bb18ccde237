"""Table functions, cut at any place."""

import random

import numpy as np
import pyarrow as pa
import pytest

from trackweave.functions.tables import LoudRuns, loud_runs


def slow(values):
    out, run = [], None
    for p, v in enumerate(values):
        inside = run is not None
        if v is not None and v >= 80:
            inside = True
        elif v is not None and v < 40:
            inside = False
        if inside and run is None:
            run = [1, p, p, 0, -np.inf]
        if not inside and run is not None:
            out.append(tuple(run))
            run = None
        if run is not None:
            run[2], run[3], run[4] = p, run[3] + 1, max(run[4], -np.inf if v is None else v)
    return out + ([tuple(run)] if run else [])


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_any_batches(seed):
    rng = random.Random(seed)
    values = [rng.choice([None, *range(0, 120, 7)]) for _ in range(rng.randrange(1, 80))]
    function, at, got = LoudRuns(), 0, []
    while at < len(values):
        end = min(len(values), at + rng.randrange(1, 9))
        columns = [pa.array([1] * (end - at)), pa.array(range(at, end)), pa.array([None if v is None else float(v) for v in values[at:end]], pa.float64())]
        for t in function.eval(pa.RecordBatch.from_arrays(columns, names=["track", "pos", "value"])):
            got += [tuple(r.values()) for r in t.to_pylist()]
        at = end
    for t in function.terminate():
        got += [tuple(r.values()) for r in t.to_pylist()]
    assert got == slow(values)


def test_in_a_query(spark):
    values = {1: [10, 90, 50, 39, 85], 2: [41, 80, 40], 3: [1]}
    df = spark.createDataFrame([(t, p, float(v)) for t, vs in values.items() for p, v in enumerate(vs)], "track bigint, pos bigint, value double")
    got = loud_runs(80.0, 40.0)(df.asTable().partitionBy("track").orderBy("pos")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 2, 2, 90.0), (1, 4, 4, 1, 85.0), (2, 1, 2, 2, 80.0)]
    with pytest.raises(ValueError):
        loud_runs(1.0, 2.0)
