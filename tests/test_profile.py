"""Profiles against brute force."""

import numpy as np
import pytest

from trackweave.operators import profile
from trackweave.operators.profile import (
    matrix_profile,
    motifs,
    reference_features,
    reference_profile,
    top_positions,
)


def brute(values, m):
    values = np.asarray(values, dtype=float).reshape(len(values), -1)
    n = len(values) - m + 1
    subs = np.stack([values[i : i + m].ravel() for i in range(n)])
    d = np.sqrt(((subs[:, None] - subs[None]) ** 2).sum(-1))
    i = np.arange(n)
    d[np.abs(i[:, None] - i[None]) <= m // 2] = np.inf
    near = d.min(axis=1)
    return near, np.where(np.isfinite(near), d.argmin(axis=1), -1)


def profiled(spark, tracks, m, block):
    rows = [
        (t, i, [float(x) for x in np.atleast_1d(v)]) for t, values in tracks.items() for i, v in enumerate(values)
    ]
    df = spark.createDataFrame(rows, "track string, pos bigint, value array<double>")
    got = {}
    for r in matrix_profile(df, m, block=block).collect():
        got.setdefault(r.track, {})[r.i] = (r.mp, r.pi)
    return got


@pytest.mark.parametrize("m,dims,block", [(5, 1, 4096), (5, 1, 16), (8, 3, 20), (1, 2, 7), (12, 1, 12)])
def test_against_brute_force(spark, m, dims, block):
    rng = np.random.default_rng(m * block)
    # few distinct values make many equal distances
    tracks = {str(n): rng.integers(0, 4, size=(n, dims)).astype(float) for n in (9, 40, 75)}
    got = profiled(spark, tracks, m, block)
    for t, values in tracks.items():
        if len(values) < m:
            assert t not in got
            continue
        near, at = brute(values, m)
        assert [got[t][i][1] for i in range(len(near))] == at.tolist()
        assert np.allclose([got[t][i][0] for i in range(len(near))], near)


@pytest.mark.parametrize("kind", ["far", "ties", "zeros", "outlier", "vectors"])
def test_bounded_pairs_give_what_all_pairs_give(kind, monkeypatch):
    """Pieces that are summed up for near pairs alone are bit for bit those of whole pieces."""
    rng = np.random.default_rng(5)
    values = rng.normal(size=(5000, 3 if kind == "vectors" else 1)) * 100 + 1e6
    if kind == "ties":
        values = rng.integers(0, 3, values.shape).astype(float)
    if kind == "zeros":
        values = np.repeat(values[:500], 10, axis=0)
    if kind == "outlier":
        values[77] = 1e11
    a, b = values[:2300], values[2291:]
    quick = [*profile.nearest_within(values, 10, 5), *profile.nearest_between(a, b, 10, 2291, 5)]
    monkeypatch.setattr(profile, "MOST_QUICK", 0)
    whole = [*profile.nearest_within(values, 10, 5), *profile.nearest_between(a, b, 10, 2291, 5)]
    assert all(np.array_equal(x, y) for x, y in zip(quick, whole))


@pytest.mark.parametrize("kind", ["far", "gaps", "ties", "outliers", "steps", "vectors"])
def test_cells_of_long_windows_give_what_all_pairs_give(kind, monkeypatch):
    """Runs of windows with a common core are bounded at once; what is known before only leaves windows out."""
    rng = np.random.default_rng(6)
    values = rng.exponential(size=(4700, 2 if kind == "vectors" else 1))
    if kind == "gaps":
        values[[100, 2090, 3333, 4699]] = np.nan
        values[2500] = np.inf
    if kind == "ties":
        values = np.tile(rng.integers(0, 2, (940, 1)).astype(float), (5, 1))
    if kind == "outliers":
        values[::97] *= 1e4
    if kind == "steps":
        values = np.repeat(np.round(values[:79], 1), 60, axis=0)[:4700]
    a, b = values[:2349], values[2300:]
    within = profile.nearest_within(values, 50, 25)
    between = profile.nearest_between(a, b, 50, 2300, 25)
    known = [(profile._above(d2).astype(float), np.full(len(d2), -1)) for d2, _ in (profile.nearest_within(x, 50, 25) for x in (a, b))]
    before = [d2.copy() for d2, _ in known]
    profile._meet(a, b, 50, 2300, 25, *known)
    monkeypatch.setattr(profile, "MOST_QUICK", 0)
    assert all(np.array_equal(x, y) for x, y in zip(within, profile.nearest_within(values, 50, 25)))
    assert all(np.array_equal(x, y) for x, y in zip(between, profile.nearest_between(a, b, 50, 2300, 25)))
    for (d2, at), bound, want, first in zip(known, before, between[::2], between[1::2]):
        nearer = want < bound
        assert np.array_equal(at, np.where(nearer, first, -1)) and np.array_equal(d2[nearer], want[nearer])


def test_a_gap_leaves_most_pairs_to_their_bounds(monkeypatch):
    """A missing frame takes out its own windows and does not have all pairs summed up."""
    values = np.random.default_rng(9).exponential(size=(8000, 1))
    values[[77, 4000]] = np.nan
    summed = []
    whole = profile.window_distances
    monkeypatch.setattr(profile, "window_distances", lambda a, b, m: summed.append(len(a) * len(b)) or whole(a, b, m))
    near, at = profile.nearest_within(values, 50, 25)
    assert (at[28:78] == -1).all() and (at[78:3951] >= 0).all()
    assert sum(summed) < 0.6 * 8000 * 8000 / 2


def test_blocks_grow_with_the_track(spark, monkeypatch):
    """What is sent to the tiles is a fixed multiple of the track."""
    sent = []
    monkeypatch.setattr(profile, "_tasks", lambda sides: sent.append(sides) or 4)
    for n in (300, 1200):
        frames = spark.range(n).selectExpr("'a' AS track", "id AS pos", "CAST(id * id % 97 AS DOUBLE) AS value")
        assert matrix_profile(frames, 4, block=8).count() == n - 3
    few, many = (s.selectExpr("sum(length(frames)) AS n").first()["n"] for s in sent)
    assert many < 5 * few


def test_a_block_without_whole_frames(spark):
    values = [[1.0, 2.0], [3.0, 1.0], [2.0, 2.0], [5.0, 0.0]] * 4
    rows = [("a", i, None if 8 <= i < 14 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "track string, pos bigint, value array<double>")
    got = {r.i: (r.mp, r.pi) for r in matrix_profile(df, 2, block=4).collect()}
    assert got[0] == (0.0, 4) and got[10] == (np.inf, -1)


def test_repeated_passage_is_exactly_zero(spark):
    rng = np.random.default_rng(7)
    passage = rng.normal(size=(30, 12)) * 1e3
    track = np.concatenate([rng.normal(size=(40, 12)), passage, rng.normal(size=(50, 12)), passage])
    got = profiled(spark, {"a": track}, 20, 64)["a"]
    assert got[40] == (0.0, 120) and got[120] == (0.0, 40)


def test_block_must_hold_a_window(spark):
    with pytest.raises(ValueError):
        profiled(spark, {"a": [1.0] * 9}, 5, 4)


def test_motifs_and_top_positions(spark):
    rows = [("a", i, v, p) for i, (v, p) in enumerate([(3.0, 2), (1.0, 3), (9.0, 0), (1.0, 1), (2.0, 0)])]
    profile = spark.createDataFrame(rows, "track string, i bigint, mp double, pi bigint")
    r = motifs(profile).first()
    assert (r.motif_0, r.motif_1, r.discord_0, r.discord_1) == (1, 3, 2, 0)
    assert sorted(r.idx for r in top_positions(profile, 2, 1).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("bound", [1000, 2])
def test_reference_profile(spark, bound):
    """References sent to the tasks or, beyond the bound, joined: the same result."""
    rng = np.random.default_rng(3)
    windows = [(k, rng.normal(size=(n, 2)).tolist()) for k, n in enumerate([9, 9, 12, 3, 6])]
    refs = [(f"r{n}", rng.normal(size=(n, 2)).tolist()) for n in (7, 5, 3)]
    left = spark.createDataFrame(windows, "k int, q_frames array<array<double>>")
    right = spark.createDataFrame(refs, "ref string, r_frames array<array<double>>")
    want = {}
    for k, q in windows:
        for name, r in refs:
            q, r = np.array(q), np.array(r)
            for i in range(len(q) - 3):
                d = [np.sqrt(((q[i : i + 4] - r[j : j + 4]) ** 2).sum()) for j in range(len(r) - 3)]
                if d:
                    want[k, name, i] = (min(d), int(np.argmin(d)))
    got = {(r.k, r.ref, r.i): (r.mp, r.pi) for r in reference_profile(left, right, 4, ["k"], max_references=bound).collect()}
    assert got.keys() == want.keys()
    assert all(got[x][1] == want[x][1] and np.isclose(got[x][0], want[x][0]) for x in want)
    features = reference_features(left, right, 4, ["k"], max_references=bound).collect()
    assert len(features) == len({(k, name) for k, name, _ in want})
    for r in features:
        near = [v[0] for (k, name, _), v in want.items() if (k, name) == (r.k, r.ref)]
        assert np.allclose([r.mp_min, r.mp_median, r.mp_max], [min(near), np.median(near), max(near)])


@pytest.mark.parametrize("bound", [1000, 2])
@pytest.mark.parametrize("block", [4096, 5])
def test_reference_profile_with_gaps_and_long_windows(spark, monkeypatch, bound, block):
    """Missing and non-finite frames take out only the subsequences they are in; long windows are cut in blocks."""
    monkeypatch.setattr(profile, "BLOCK", block)
    monkeypatch.setattr(profile, "_CELLS", 200)
    rng = np.random.default_rng(8)

    def frames(n, *gaps):
        out = rng.normal(size=(n, 2)).tolist()
        for at, what in gaps:
            out[at] = None if what is None else [what, 1.0]
        return out

    windows = [
        (0, frames(30, (4, None), (17, np.nan))),
        (1, frames(11, (0, np.inf))),
        (2, frames(6, (2, None), (3, np.nan))),
        (3, [None] * 7),
        (4, None),
        (5, []),
        (6, frames(40)),
        (7, [[1.0, None]] * 5),
    ]
    refs = [("a", frames(25, (9, None))), ("b", frames(8, (3, np.nan))), ("c", frames(3)), ("d", None), ("e", [None] * 6)]
    left = spark.createDataFrame(windows, "k int, q_frames array<array<double>>")
    right = spark.createDataFrame(refs, "ref string, r_frames array<array<double>>")

    def matrix(rows):
        return np.array([[np.nan, np.nan] if r is None else [np.nan if x is None else x for x in r] for r in rows or []], dtype=float).reshape(-1, 2)

    want = {}
    for k, q in windows:
        for name, r in refs:
            q_, r_ = matrix(q), matrix(r)
            if min(len(q_), len(r_)) < 4:
                continue
            for i in range(len(q_) - 3):
                d = np.array([np.sqrt(((q_[i : i + 4] - r_[j : j + 4]) ** 2).sum()) for j in range(len(r_) - 3)])
                d[~np.isfinite(d)] = np.inf
                want[k, name, i] = (d.min(), int(d.argmin()) if np.isfinite(d.min()) else -1)
    got = {(r.k, r.ref, r.i): (r.mp, r.pi) for r in reference_profile(left, right, 4, ["k"], max_references=bound).collect()}
    assert got.keys() == want.keys()
    assert all(got[x][1] == want[x][1] and np.isclose(got[x][0], want[x][0]) for x in want)
    features = {(r.k, r.ref): r for r in reference_features(left, right, 4, ["k"], max_references=bound).collect()}
    assert features.keys() == {(k, name) for k, name, _ in want}
    for key, r in features.items():
        near = [v[0] for (k, name, _), v in want.items() if (k, name) == key and v[1] >= 0]
        if near:
            assert np.allclose([r.mp_min, r.mp_median, r.mp_max], [min(near), np.median(near), max(near)])
        else:
            assert r.mp_min is None and r.mp_median is None and r.mp_max is None


def test_rectangles_are_the_whole_block():
    rng = np.random.default_rng(1)
    q, r = rng.integers(0, 4, (900, 3)).astype(float), rng.integers(0, 4, (700, 3)).astype(float)
    near, at = profile.nearest_of(q, r, 6)
    d = np.sqrt(sum(((q[t : len(q) - 5 + t, None] - r[None, t : len(r) - 5 + t]) ** 2).sum(axis=2) for t in range(6)))
    assert np.allclose(near, d.min(axis=1)) and (at == d.argmin(axis=1)).all()
