"""Windows, fragments, profiles and motif pipelines over the event signals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.catalog.registry import query
from trackweave.catalog.sqltext import FRAMES, TAXONOMY, profile, shuffled, uniform
from trackweave.functions import vectors
from trackweave.functions.draws import normal, uniform as uniform_of
from trackweave.operators import batches, labels
from trackweave.operators.numbering import number_shuffled
from trackweave.operators.pairing import neighbour_pairs, window_neighbours
from trackweave.operators.profile import (
    matrix_profile,
    motifs,
    reference_features,
    reference_profile,
)
from trackweave.operators.windows import fragments, slice_windows
from trackweave.plans import motif
from trackweave.sources.tracks import (
    chunked,
    frames,
    kind_frames,
    lengths,
    stored_frames,
    table,
    taxonomy,
    vector_frames,
)

CHUNK = 32
M = 8


def signal(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The chunked signal and its lengths."""
    samples = stored_frames(spark, sf).select("track", "pos", "value")
    return chunked(samples, CHUNK), lengths(samples)


def long_windows(windows: DataFrame) -> DataFrame:
    return windows.select("track", "win_idx", "start_pos", F.posexplode("x").alias("off", "value"))


def slices_sql(width: int, context: int, step: int | None, padding: str, name: str = "slices") -> str:
    """CTEs ending in ``<name>(track, win_idx, start_pos, off, value)``."""
    full = width + context
    step = full if step is None else step
    if padding == "right-align":
        length = f"CASE WHEN n % {step} > 0 THEN n - n % {step} + least(n, {step}) ELSE n END"
        # a padded place beyond the whole steps counts back from the right end
        place = f"CASE WHEN n % {step} > 0 AND v >= n - n % {step} THEN v - (n - n % {step}) + n - least(n, {step}) ELSE v END"
    else:
        extra = f"(CASE WHEN n % {step} > 0 THEN {step} - n % {step} ELSE 0 END)"
        length = f"n + {extra}"
        place = f"v - {extra} // 2" if padding == "center" else "v"
    return f"""plan_{name} AS (
  SELECT track, n, CASE WHEN p >= {full} THEN (p - {full}) // {step} + 1 ELSE 0 END AS n_win
  FROM (SELECT track, n, {length} AS p FROM sizes)),
spots_{name} AS (
  SELECT track, n, win_idx, win_idx * {step} AS start_pos, off, win_idx * {step} + off AS v
  FROM (SELECT track, n, unnest(range(n_win)) AS win_idx FROM plan_{name}),
       (SELECT unnest(range({full})) AS off)),
{name} AS (
  SELECT s.track, win_idx, start_pos, CAST(off AS INTEGER) AS off, coalesce(f.value, 0.0) AS value
  FROM (SELECT *, {place} AS src FROM spots_{name}) s
  LEFT JOIN frames f ON f.track = s.track AND f.pos = s.src)"""


def _slice_query(name: str, width: int, context: int, step: int | None, padding: str) -> None:
    sql = f"WITH {FRAMES}, {slices_sql(width, context, step, padding)} SELECT * FROM slices"

    @query(name, sql)
    def run(spark, sf):
        chunks, sizes = signal(spark, sf)
        return long_windows(slice_windows(chunks, sizes, CHUNK, width, context, step, padding))


_slice_query("w1_slice_right", 10, 0, None, "right")
_slice_query("w2_slice_center", 10, 0, None, "center")
_slice_query("w3_slice_right_align", 10, 0, None, "right-align")
_slice_query("w4_slice_overlapping", 10, 0, 4, "center")
_slice_query("w4_slice_context", 10, 4, 7, "right")
_slice_query("w4_slice_sparse_center", 4, 0, 23, "center")
_slice_query("w4_slice_overlap_right_align", 10, 0, 4, "right-align")


@query(
    "w5_chunks",
    f"""WITH {FRAMES} SELECT track, pos // 12 AS chunk, count(*) AS n, round(sum(value), 6) AS total
        FROM frames GROUP BY 1, 2""",
)
def w5(spark, sf):
    return (
        frames(spark, sf)
        .groupBy("track", batches.chunk_no(F.col("pos"), 12).alias("chunk"))
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    )


@query(
    "w6_full_batches",
    f"""SELECT event_type AS worker, idx // 32 AS batch, CAST(idx % 32 AS INTEGER) AS slot, event_id FROM (
          SELECT event_type, event_id, {shuffled(3, ["event_id"], ["event_type"])} AS idx,
                 count(*) OVER (PARTITION BY event_type) AS n FROM events)
        WHERE idx // 32 < n // 32""",
)
def w6(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("worker"), "event_id")
    numbered = number_shuffled(rows, ["worker"], 3, ["event_id"], "row_idx", "n")
    return batches.full_batches(numbered, 32).select("worker", "batch", "slot", "event_id")


@query(
    "w7_worker_ranges",
    f"""SELECT event_id, CAST(floor(idx / ceil(n / 7.0)) AS BIGINT) AS worker FROM (
          SELECT event_id, {shuffled(5, ['event_id'])} AS idx, count(*) OVER () AS n FROM events)""",
)
def w7(spark, sf):
    rows = table(spark, sf, "events").select("event_id")
    numbered = number_shuffled(rows, [], 5, ["event_id"], "_i", "_n")
    return numbered.select("event_id", batches.worker_of(F.col("_i"), F.col("_n"), 7).alias("worker"))


def labelled_windows(spark: SparkSession, sf: str) -> DataFrame:
    chunks, sizes = signal(spark, sf)
    windows = slice_windows(chunks, sizes, CHUNK, 10, padding="right-align")
    return windows.join(taxonomy(spark, sf), "track").withColumn("label", F.col("species"))


_INTERLEAVED = f"""{FRAMES}, {TAXONOMY}, {slices_sql(10, 0, None, "right-align")},
  wins AS (SELECT DISTINCT track, win_idx FROM slices),
  tracks AS (SELECT track, {shuffled(11, ['track'])} AS t FROM (SELECT DISTINCT track FROM wins)),
  data AS (
    SELECT t // 7 AS wave, {shuffled(11, ['w.track', 'win_idx'], ['w.track'])} AS round,
           CAST(t % 7 + 1 AS INTEGER) AS slot, w.track, win_idx, species AS label
    FROM wins w JOIN tracks USING (track) JOIN taxonomy ON taxonomy.track = w.track),
  seen AS (SELECT DISTINCT wave, round FROM data)"""


@query(
    "w8_interleave",
    f"""WITH {_INTERLEAVED}
        SELECT wave, round, slot, track, win_idx, label FROM data
        UNION ALL SELECT wave, round, 0, NULL, NULL, 'noise' FROM seen
        UNION ALL SELECT wave, max(round) + 1, 0, NULL, NULL, 'noise' FROM seen GROUP BY wave""",
)
def w8(spark, sf):
    return batches.interleave(labelled_windows(spark, sf).select("track", "win_idx", "label"), 8, 11)


QUEUE = 8
WORKERS = 3


@query(
    "w8_refilled_queue",
    f"""WITH RECURSIVE {FRAMES}, {TAXONOMY}, {slices_sql(10, 0, None, "right-align")},
  wins AS (SELECT DISTINCT track, win_idx FROM slices),
  named AS (SELECT wins.*, species AS label FROM wins JOIN taxonomy ON taxonomy.track = wins.track),
  tracks AS (
    SELECT *, CAST(floor(seq / ceil(total / {WORKERS}.0)) AS BIGINT) AS worker FROM (
      SELECT track, count(*) AS n, {shuffled(12, ['track'])} AS seq, count(*) OVER () AS total FROM named GROUP BY track)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY seq) AS turn FROM tracks),
  queue AS (
    SELECT worker, turn, 0::BIGINT AS start, list_sort(list_append([{", ".join(["0::BIGINT"] * (QUEUE - 2))}], n + 1)) AS free
    FROM placed WHERE turn = 1
    UNION ALL
    SELECT p.worker, p.turn, free[1], list_sort(list_append(free[2:], free[1] + p.n + 1))
    FROM queue q JOIN placed p ON p.worker = q.worker AND p.turn = q.turn + 1),
  data AS (
    SELECT p.worker, q.start + {shuffled(12, ['n.track', 'win_idx'], ['n.track'])} AS round, p.seq, n.track, win_idx, label
    FROM named n JOIN placed p ON p.track = n.track JOIN queue q ON q.worker = p.worker AND q.turn = p.turn),
  ends AS (SELECT p.worker, max(q.start + p.n) + 1 AS rounds FROM placed p JOIN queue q ON q.worker = p.worker AND q.turn = p.turn GROUP BY 1)
  SELECT worker, round, CAST(row_number() OVER (PARTITION BY worker, round ORDER BY seq) AS INTEGER) AS slot, track, win_idx, label FROM data
  UNION ALL SELECT worker, unnest(range(rounds)), 0, NULL, NULL, 'noise' FROM ends""",
)
def w8_refilled(spark, sf):
    """Reading order of workers with a queue of open tracks that is refilled as tracks end."""
    windows = labelled_windows(spark, sf).select("track", "win_idx", "label")
    return batches.refilled_queue(windows, QUEUE, WORKERS, 12)


# profiles


@query("j5_matrix_profile", f"WITH {FRAMES}, {profile(M)} SELECT track, i, round(mp, 6) AS mp, pi FROM profile")
def j5(spark, sf):
    return matrix_profile(stored_frames(spark, sf), M).withColumn("mp", F.round("mp", 6))


_VECTOR_FRAMES = """vframes AS (
  SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, (event_type = 'purchase')::DOUBLE * 50 AS p
  FROM events)"""


@query(
    "j5_matrix_profile_vectors",
    f"""WITH {_VECTOR_FRAMES}, lagged AS (
          SELECT a.track, a.pos AS i, b.pos AS j, (a.value - b.value) * (a.value - b.value)
                 + (a.k - b.k) * (a.k - b.k) + (a.p - b.p) * (a.p - b.p) AS e
          FROM vframes a JOIN vframes b ON a.track = b.track AND b.pos > a.pos + 3),
        diagonal AS (SELECT track, i, j, sum(e) OVER w AS d2, count(*) OVER w AS c FROM lagged
          WINDOW w AS (PARTITION BY track, j - i ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
        bothways AS (SELECT track, i, j, d2 FROM diagonal WHERE c = 6
          UNION ALL SELECT track, j, i, d2 FROM diagonal WHERE c = 6)
        SELECT track, i, round(sqrt(d2), 6) AS mp, j AS pi FROM (
          SELECT *, row_number() OVER (PARTITION BY track, i ORDER BY d2, j) AS r FROM bothways) WHERE r = 1""",
)
def j5_vectors(spark, sf):
    return matrix_profile(vector_frames(spark, sf), 6, "frame").withColumn("mp", F.round("mp", 6))


_KIND_FRAMES = """kframes AS (
  SELECT event_type AS track, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, value
  FROM events),
sizes AS (SELECT track, count(*) AS n FROM kframes GROUP BY track)"""


@query(
    "j5_matrix_profile_long_tracks",
    f"WITH {_KIND_FRAMES}, {profile(50, 'kframes')} SELECT track, i, round(mp, 6) AS mp, pi FROM profile",
)
def j5_long(spark, sf):
    """Few long tracks, each computed as many pairs of blocks."""
    return matrix_profile(kind_frames(spark, sf), 50, block=1024).withColumn("mp", F.round("mp", 6))


_WINDOWS16 = """w AS (
    SELECT track, pos // 16 AS win, pos % 16 AS off, value FROM frames),
  queries AS (SELECT track, win, off, value FROM w WHERE (track, win) IN (
    SELECT (track, win) FROM w GROUP BY track, win HAVING count(*) = 16)),
  tops AS (SELECT family, track, win FROM (
    SELECT family, q.track, win, row_number() OVER (PARTITION BY family ORDER BY round(sum(value), 6) DESC, q.track, win) AS r
    FROM queries q JOIN taxonomy t ON t.track = q.track GROUP BY family, q.track, win) WHERE r = 1),
  refs AS (SELECT family AS ref, off, value FROM tops JOIN queries USING (track, win)),
  e AS (SELECT q.track, win, ref, q.off AS i, r.off AS j, (q.value - r.value) * (q.value - r.value) AS e
    FROM queries q, refs r),
  d AS (SELECT track, win, ref, i, j, sum(e) OVER v AS d2, count(*) OVER v AS c FROM e
    WINDOW v AS (PARTITION BY track, win, ref, j - i ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
  cross_mp AS (SELECT track, win, ref, i, sqrt(d2) AS mp, j AS pi FROM (
    SELECT *, row_number() OVER (PARTITION BY track, win, ref, i ORDER BY d2, j) AS r FROM d WHERE c = 4) WHERE r = 1)"""


def query_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Whole windows of 16 frames as arrays of one-number frame vectors."""
    chunks = chunked(frames(spark, sf).select("track", "pos", "value"), 16).where(F.size("values") == 16)
    return chunks.select(
        "track", F.col("chunk").alias("win"), F.transform("values", lambda v: F.array(v)).alias("q_frames"), "values"
    )


def reference_windows(spark: SparkSession, sf: str, windows: DataFrame) -> DataFrame:
    """Per family the window with the largest total, as reference motif."""
    total = F.round(vectors.total(F.col("values")), 6)
    best = F.min(F.struct((-total).alias("t"), "track", "win", "q_frames"))
    return (
        windows.join(taxonomy(spark, sf).select("track", "family"), "track")
        .groupBy("family")
        .agg(best.alias("_b"))
        .select(F.col("family").alias("ref"), F.col("_b.q_frames").alias("r_frames"))
    )


@query(
    "j6_reference_profile",
    f"WITH {FRAMES}, {TAXONOMY}, {_WINDOWS16} SELECT track, win, ref, i, round(mp, 6) AS mp, pi FROM cross_mp",
)
def j6(spark, sf):
    windows = query_windows(spark, sf)
    refs = reference_windows(spark, sf, windows)
    return reference_profile(windows, refs, 4, ["track", "win"]).withColumn("mp", F.round("mp", 6))


@query(
    "a9_profile_features",
    f"""WITH {FRAMES}, {TAXONOMY}, {_WINDOWS16} SELECT track, win, ref, round(min(mp), 6) AS mp_min,
          round(median(mp), 6) AS mp_median, round(max(mp), 6) AS mp_max FROM cross_mp GROUP BY 1, 2, 3""",
)
def a9(spark, sf):
    windows = query_windows(spark, sf)
    refs = reference_windows(spark, sf, windows)
    got = reference_features(windows, refs, 4, ["track", "win"])
    return got.withColumns({c: F.round(c, 6) for c in ("mp_min", "mp_median", "mp_max")})


_GAPS = f"""{_WINDOWS16},
  whole AS (
    SELECT f.track, ref, f.pos AS i, r.off AS j, CASE WHEN f.kind <> 'error' THEN (f.value - r.value) * (f.value - r.value) END AS e
    FROM frames f, refs r),
  sums AS (SELECT track, ref, i, j, sum(e) OVER v AS d2, count(e) OVER v AS c FROM whole
    WINDOW v AS (PARTITION BY track, ref, j - i ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
  found AS (SELECT track, ref, i, d2, j FROM (
    SELECT *, row_number() OVER (PARTITION BY track, ref, i ORDER BY d2, j) AS r FROM sums WHERE c = 4) WHERE r = 1),
  places AS (SELECT track, ref, unnest(range(n - 3)) AS i FROM sizes, (SELECT DISTINCT ref FROM refs) WHERE n >= 4),
  gap_mp AS (
    SELECT p.track, p.ref, p.i, sqrt(d2) AS d, round(sqrt(d2), 6) AS mp, coalesce(j, -1) AS pi
    FROM places p LEFT JOIN found f ON f.track = p.track AND f.ref = p.ref AND f.i = p.i)"""


def tracks_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Whole tracks as one window each; frames of errors are missing."""
    frame = F.when(F.col("kind") != "error", F.array("value"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", frame.alias("frame"))))
    return frames(spark, sf).groupBy("track").agg(F.transform(ordered, lambda s: s["frame"]).alias("q_frames"))


@query(
    "j6_whole_tracks_with_gaps",
    f"WITH {FRAMES}, {TAXONOMY}, {_GAPS} SELECT track, ref, i, mp, pi FROM gap_mp",
)
def j6_gaps(spark, sf):
    refs = reference_windows(spark, sf, query_windows(spark, sf))
    got = reference_profile(tracks_with_gaps(spark, sf), refs, 4, ["track"])
    return got.withColumn("mp", F.when(F.col("pi") >= 0, F.round("mp", 6)))


@query(
    "a9_features_with_gaps",
    f"""WITH {FRAMES}, {TAXONOMY}, {_GAPS} SELECT track, ref, min(mp) AS mp_min,
          round(median(d), 6) AS mp_median, max(mp) AS mp_max FROM gap_mp GROUP BY 1, 2""",
)
def a9_gaps(spark, sf):
    refs = reference_windows(spark, sf, query_windows(spark, sf))
    got = reference_features(tracks_with_gaps(spark, sf), refs, 4, ["track"])
    return got.withColumns({"mp_min": F.round("mp_min", 6), "mp_median": F.round("mp_median", 6), "mp_max": F.round("mp_max", 6)})


@query("a8_motif_and_discord", f"WITH {FRAMES}, {profile(M)} SELECT * FROM motifs")
def a8(spark, sf):
    return motifs(matrix_profile(stored_frames(spark, sf), M))


_NEIGHBOURS = """votes AS (
    SELECT track, i // 10 AS win, pi // 10 AS nbr, count(*) AS c FROM profile GROUP BY 1, 2, 3),
  neighbours AS (SELECT track, win, nbr FROM (
    SELECT *, row_number() OVER (PARTITION BY track, win ORDER BY c DESC, nbr) AS r FROM votes) WHERE r = 1)"""


@query(
    "a10_chunked_mode",
    f"WITH {FRAMES}, {profile(M)}, {_NEIGHBOURS} SELECT track, win, nbr FROM neighbours",
)
def a10(spark, sf):
    return window_neighbours(matrix_profile(stored_frames(spark, sf), M), 10)


@query(
    "j7_neighbour_pairs",
    f"""WITH {FRAMES}, {profile(M)}, {_NEIGHBOURS}, {slices_sql(10, 0, None, "right-align")},
        wins AS (SELECT track, win_idx, round(sum(value), 6) AS total FROM slices GROUP BY 1, 2)
        SELECT n.track, a.win_idx AS anchor_win_idx, a.total AS anchor_total,
               b.win_idx AS neighbor_win_idx, b.total AS neighbor_total
        FROM neighbours n JOIN wins a ON a.track = n.track AND a.win_idx = n.win
        JOIN wins b ON b.track = n.track AND b.win_idx = n.nbr""",
)
def j7(spark, sf):
    signal_ = stored_frames(spark, sf)
    total = F.round(vectors.total(F.col("x")), 6).alias("total")
    windows = slice_windows(
        chunked(signal_, CHUNK), lengths(signal_), CHUNK, 10, padding="right-align"
    ).select("track", "win_idx", total)
    return neighbour_pairs(window_neighbours(matrix_profile(signal_, M), 10), windows)


_TOP = """ranked AS (
    SELECT *, row_number() OVER (PARTITION BY track ORDER BY mp, i) AS lo,
              row_number() OVER (PARTITION BY track ORDER BY mp DESC, i DESC) AS hi FROM profile),
  tops AS (SELECT DISTINCT track, unnest([i, pi]) AS idx FROM ranked WHERE lo <= 3 OR hi <= 1)"""


@query(
    "t2_top_motifs",
    f"""WITH {FRAMES}, {profile(40)}, {_TOP} SELECT track, coalesce(idx, -1) AS idx,
          CASE WHEN idx IS NULL THEN 0 ELSE
            CAST(trunc((idx / (n + 40.0)::DOUBLE + (40 / 2.0) / (n + 40.0)::DOUBLE) * n) AS BIGINT) END AS start
        FROM sizes LEFT JOIN tops USING (track)""",
)
def t2(spark, sf):
    signal_ = stored_frames(spark, sf)
    mp = motif.stored_profile(signal_, 40)
    return motif.top_places(motif.track_records(lengths(signal_), mp, 40), mp)


@query("l12_motif_extraction", f"WITH {FRAMES}, {profile(M)} SELECT * FROM records")
def l12(spark, sf):
    return motif.extract(stored_frames(spark, sf), M)


# fragments


def fragment_sql(requests: str, length: int) -> str:
    """CTE ``fragment(track, offset, off, value)`` for ``requests(track, offset)``."""
    pad = (length + 1) // 2
    return f"""requests AS ({requests}),
spans AS (
  SELECT r.track, "offset", n, n + 2 * {pad} AS padded,
    CASE WHEN n < {length} THEN (n + 2 * {pad}) // 2 - {pad}
         WHEN "offset" <= 0 THEN {pad} + greatest("offset", -{pad})
         WHEN "offset" + {length} >= n + 2 * {pad} THEN n + 2 * {pad} - {length}
         ELSE "offset" + {pad} END AS begins
  FROM requests r JOIN sizes s ON s.track = r.track),
spots AS (
  SELECT track, "offset", off, begins + off % least({length}, padded - begins) - {pad} AS src
  FROM spans, (SELECT unnest(range({length})) AS off)),
fragment AS (
  SELECT s.track, s."offset", CAST(off AS INTEGER) AS off, coalesce(f.value, 0.0) AS value
  FROM spots s LEFT JOIN frames f ON f.track = s.track AND f.pos = s.src)"""


def long_fragments(got: DataFrame) -> DataFrame:
    return got.select("track", "offset", F.posexplode("x").alias("off", "value"))


@query(
    "f4_fragments",
    f"""WITH {FRAMES}, {fragment_sql("SELECT track, unnest([-40, -1, 0, 7, n // 2, n - 5, n + 3, n + 60]) AS \"offset\" FROM sizes", 9)}
        SELECT * FROM fragment""",
)
def f4(spark, sf):
    chunks, sizes = signal(spark, sf)
    n = F.col("n")
    places = F.array(
        *[F.lit(v).cast("bigint") for v in (-40, -1, 0, 7)], F.floor(n / 2), n - 5, n + 3, n + 60
    )
    requests = sizes.select("track", F.explode(places).alias("offset")).distinct()
    return long_fragments(fragments(chunks, sizes, CHUNK, requests, 9))


@query(
    "l14_motif_fragments",
    f"""WITH {FRAMES}, {profile(M)},
        places AS (SELECT track, n_frames AS n,
            CAST(trunc((motif_0 / (n_frames + 8.0)::DOUBLE + (8 / 2.0) / (n_frames + 8.0)::DOUBLE) * n_frames) AS BIGINT) AS start
          FROM records WHERE motif_0 IS NOT NULL)
        SELECT p.track, start, CAST(pos - start AS INTEGER) AS off, value
        FROM places p JOIN frames f ON f.track = p.track AND pos >= start AND pos < start + 6""",
)
def l14(spark, sf):
    signal_ = stored_frames(spark, sf)
    chunks, sizes = chunked(signal_, CHUNK), lengths(signal_)
    recs = motif.track_records(sizes, matrix_profile(signal_, M), M)
    return motif.place_fragments(recs, chunks, sizes, CHUNK, "motif_0", 6)


@query(
    "l14_motif_tracks",
    f"""WITH {FRAMES}, {profile(M)},
        named AS (
          SELECT track, n_frames AS n, unnest(['motif_0', 'motif_1', 'discord_0', 'discord_1']) AS place,
                 unnest([motif_0, motif_1, discord_0, discord_1]) AS idx FROM records),
        places AS (SELECT track, place, coalesce(
            CAST(trunc((idx / (n + 8.0)::DOUBLE + (8 / 2.0) / (n + 8.0)::DOUBLE) * n) AS BIGINT), 0) AS start FROM named)
        SELECT place, row_number() OVER (PARTITION BY place ORDER BY p.track, f.pos) - 1 AS pos, p.track,
               CAST(f.pos - start AS INTEGER) AS off, value
        FROM places p JOIN frames f ON f.track = p.track AND f.pos >= start AND f.pos < start + 6""",
)
def l14_tracks(spark, sf):
    """The fragments at each of the four places of all tracks, joined to one signal a place."""
    signal_ = stored_frames(spark, sf)
    chunks, sizes = chunked(signal_, CHUNK), lengths(signal_)
    recs = motif.track_records(sizes, matrix_profile(signal_, M), M)
    return motif.motif_tracks(recs, chunks, sizes, CHUNK, 6)


@query(
    "l16_primary_fragments",
    f"""WITH {FRAMES}, {profile(40)}, {fragment_sql('''SELECT track, coalesce(CAST(trunc(
            (motif_0 / (n_frames + 40.0)::DOUBLE + (40 / 2.0) / (n_frames + 40.0)::DOUBLE) * n_frames) AS BIGINT), 0) AS "offset" FROM records''', 10)}
        SELECT * FROM fragment""",
)
def l16(spark, sf):
    signal_ = stored_frames(spark, sf)
    chunks, sizes = chunked(signal_, CHUNK), lengths(signal_)
    recs = motif.track_records(sizes, matrix_profile(signal_, 40), 40)
    return long_fragments(motif.primary_fragments(recs, chunks, sizes, CHUNK, 10))


@query(
    "l16_primary_fragments_raw_units",
    f"""WITH {FRAMES}, {profile(40)}, {fragment_sql('SELECT track, coalesce(motif_0, 0) AS "offset" FROM records', 10)}
        SELECT * FROM fragment""",
)
def l16_raw(spark, sf):
    signal_ = stored_frames(spark, sf)
    chunks, sizes = chunked(signal_, CHUNK), lengths(signal_)
    recs = motif.track_records(sizes, matrix_profile(signal_, 40), 40)
    return long_fragments(motif.primary_fragments(recs, chunks, sizes, CHUNK, 10, raw_units=True))


# labelled windows


@query(
    "l18_labelled_windows",
    f"""WITH {FRAMES}, {slices_sql(10, 0, None, "center")},
        wins AS (SELECT track, win_idx, round(sum(value), 6) AS total FROM slices GROUP BY 1, 2),
        marks AS (SELECT concat_ws('_', track, 'site', pos // 2 * 5) AS row_id,
                    CASE WHEN max(kind) = 'view' THEN 'nocall' ELSE max(kind) END AS birds
                  FROM frames GROUP BY track, pos // 2)
        SELECT concat_ws('_', track, 'site', win_idx * 5) AS row_id, CAST(track AS VARCHAR) AS audio_id,
               win_idx * 5 AS seconds, total, CAST(birds <> 'nocall' AS INTEGER) AS y
        FROM wins JOIN marks ON marks.row_id = concat_ws('_', track, 'site', win_idx * 5)""",
)
def l18(spark, sf):
    signal_ = stored_frames(spark, sf)
    windows = slice_windows(chunked(signal_, CHUNK), lengths(signal_), CHUNK, 10)
    total = F.round(vectors.total(F.col("x")), 6)
    name = F.concat_ws("_", F.col("track").cast("string"), F.lit("site"))
    rows = (
        windows.withColumn("name", name)
        .select(
            F.get(F.split("name", "_"), F.lit(0)).alias("audio_id"),
            F.get(F.split("name", "_"), F.lit(1)).alias("place"),
            (F.col("win_idx") * 5).alias("seconds"),
            total.alias("total"),
        )
        .withColumn("row_id", F.concat_ws("_", "audio_id", "place", F.col("seconds").cast("string")))
    )
    last = F.max("kind")
    marks = signal_.groupBy("track", F.expr("pos div 2").alias("half")).agg(
        F.when(last == "view", "nocall").otherwise(last).alias("birds")
    ).select(F.concat_ws("_", name, (F.col("half") * 5).cast("string")).alias("row_id"), "birds")
    return rows.join(marks, "row_id").select(
        "row_id", "audio_id", "seconds", "total", (F.col("birds") != "nocall").cast("int").alias("y")
    )


@query(
    "l19_linear_slices",
    f"""WITH {FRAMES}, {TAXONOMY}, {slices_sql(10, 0, None, "right-align")},
        classes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx FROM (
          SELECT species AS label FROM taxonomy UNION SELECT 'noise')),
        wins AS (SELECT track, win_idx, round(sum(value), 6) AS total FROM slices GROUP BY 1, 2)
        SELECT w.track, win_idx, total, c.idx AS dim, CAST(c.label = species AS INTEGER) AS target
        FROM wins w JOIN taxonomy t ON t.track = w.track CROSS JOIN classes c""",
)
def l19(spark, sf):
    known = taxonomy(spark, sf)
    classes = labels.class_table(known, "species", ["noise"])
    k = classes.agg(F.count("*")).scalar()
    total = F.round(vectors.total(F.col("x")), 6).alias("total")
    rows = labelled_windows(spark, sf).select("track", "win_idx", total, "label")
    return (
        rows.join(classes, "label")
        .withColumn("_k", k)
        .select("track", "win_idx", "total", F.posexplode(vectors.one_hot(F.col("idx"), F.col("_k"))).alias("dim", "target"))
    )


# augmentations on windows


def windows10(spark: SparkSession, sf: str) -> DataFrame:
    chunks, sizes = signal(spark, sf)
    return slice_windows(chunks, sizes, CHUNK, 10, padding="right")


def _augment_sql(select: str, where: str = "") -> str:
    return f"WITH {FRAMES}, {slices_sql(10, 0, None, 'right')} SELECT track, win_idx, {select} FROM slices {where}"


@query(
    "f11_random_gain",
    _augment_sql(f"off, round(value * pow(10.0, (-18 + 24 * {uniform('gain', 'track', 'win_idx')}) / 20), 6) AS value"),
)
def f11(spark, sf):
    decibel = -18 + 24 * uniform_of("gain", "track", "win_idx")
    got = windows10(spark, sf).withColumn("_db", decibel)
    loud = F.transform(vectors.gain(F.col("x"), F.col("_db")), lambda v: F.round(v, 6))
    return got.select("track", "win_idx", F.posexplode(loud).alias("off", "value"))


_SHIFT = f"CAST(floor(-1 + 3 * {uniform('shift', 'track', 'win_idx')}) AS INTEGER)"


@query("f12_time_shift", _augment_sql(f"CAST((off + {_SHIFT} + 10) % 10 AS INTEGER) AS off, value"))
def f12(spark, sf):
    # one tenth of the window either way
    by = F.floor(-1 + 3 * uniform_of("shift", "track", "win_idx")).cast("int")
    moved = windows10(spark, sf).withColumn("_s", by)
    return moved.select("track", "win_idx", F.posexplode(vectors.rotate(F.col("x"), F.col("_s"))).alias("off", "value"))


@query(
    "f13_noise_scale",
    f"""WITH {FRAMES}, {slices_sql(10, 0, None, 'right')} SELECT track, win_idx,
          round(sqrt(avg(value * value) / pow(10.0, 15 / 10.0)), 6) AS scale FROM slices GROUP BY 1, 2""",
)
def f13(spark, sf):
    scale = vectors.noise_scale(F.col("x"), F.lit(15.0))
    return windows10(spark, sf).select("track", "win_idx", F.round(scale, 6).alias("scale"))


@query(
    "f13_add_noise",
    f"""WITH {FRAMES}, {slices_sql(10, 0, None, 'right')},
        scales AS (SELECT track, win_idx, sqrt(avg(value * value) / pow(10.0, 15 / 10.0)) AS scale FROM slices GROUP BY 1, 2)
        SELECT s.track, s.win_idx, off, round(value + scale
            * sqrt(-2 * ln(1 - {uniform('noise', "'radius'", 's.track', 's.win_idx', 'off')}))
            * cos(2 * pi() * {uniform('noise', "'angle'", 's.track', 's.win_idx', 'off')}), 6) AS value
        FROM slices s JOIN scales c ON c.track = s.track AND c.win_idx = s.win_idx""",
)
def f13_noise(spark, sf):
    """Windows with white noise 15 dB below the signal."""
    rows = windows10(spark, sf).withColumn("_scale", vectors.noise_scale(F.col("x"), F.lit(15.0)))
    noise = F.array(*[normal("noise", "track", "win_idx", F.lit(off)) for off in range(10)])
    loud = vectors.with_noise(F.col("x"), F.col("_scale"), F.col("_noise"))
    return (
        rows.withColumn("_noise", noise)
        .select("track", "win_idx", F.posexplode(loud).alias("off", "value"))
        .withColumn("value", F.round("value", 6))
    )


_CROP = f"CAST(floor(4 * {uniform('crop', 'track', 'win_idx')}) AS INTEGER)"


@query(
    "f14_random_crop",
    _augment_sql(f"CAST(off - {_CROP} AS INTEGER) AS off, value", f"WHERE off >= {_CROP} AND off < {_CROP} + 7"),
)
def f14(spark, sf):
    at = F.floor(4 * uniform_of("crop", "track", "win_idx"))
    rows = windows10(spark, sf).withColumn("_at", at)
    return rows.select(
        "track", "win_idx", F.posexplode(vectors.crop(F.col("x"), F.col("_at"), 7)).alias("off", "value")
    )


@query(
    "f16_decibel",
    f"""WITH {FRAMES} SELECT track, pos, round(greatest(db, max(db) OVER (PARTITION BY track) - 80), 6) AS db FROM (
          SELECT f.track, pos, 10 * log10(greatest(value * value, 1e-10) / greatest(top, 1e-10)) AS db
          FROM frames f JOIN (SELECT track, max(value * value) AS top FROM frames GROUP BY track) t ON t.track = f.track)""",
)
def f16(spark, sf):
    power = stored_frames(spark, sf).select("track", "pos", (F.col("value") * F.col("value")).alias("s"))
    tops = power.groupBy("track").agg(F.max("s").alias("top"))
    floor = F.lit(1e-10)
    level = 10 * F.log10(F.greatest("s", floor) / F.greatest("top", floor))
    # the loudest frame of a track is at 0 dB
    return power.join(tops, "track").select(
        "track", "pos", F.round(F.greatest(level, F.lit(-80.0)), 6).alias("db")
    )


def band_energies(windows: DataFrame, n_fft: int, bands: int) -> DataFrame:
    """``(track, win_idx, band, energy)``: power of each frame in equal bands.

    The Fourier basis has a fixed size and stays inside the row expression.
    """
    freqs = n_fft // 2
    places = F.sequence(F.lit(0), F.lit(n_fft - 1))

    def part(x, f, wave):
        turned = F.zip_with(x, places, lambda v, t: v * wave(f * t * (2 * math.pi / n_fft)))
        return F.aggregate(turned, F.lit(0.0), lambda s, v: s + v)

    def power(f):
        re, im = part(F.col("x"), f, F.cos), part(F.col("x"), f, F.sin)
        return re * re + im * im

    spectrum = F.transform(F.sequence(F.lit(0), F.lit(freqs - 1)), power)
    width = freqs // bands
    energy = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.aggregate(F.slice("_p", b * width + 1, F.lit(width)), F.lit(0.0), lambda s, v: s + v),
    )
    return (
        windows.withColumn("_p", spectrum)
        .select("track", "win_idx", F.posexplode(energy).alias("band", "energy"))
    )


@query(
    "f17_band_energies",
    f"""WITH {FRAMES}, {slices_sql(16, 0, 8, 'right')},
        spectrum AS (SELECT track, win_idx, f, sum(value * cos(f * off * 2 * pi() / 16)) AS re,
                            sum(value * sin(f * off * 2 * pi() / 16)) AS im
                     FROM slices, (SELECT unnest(range(8)) AS f) GROUP BY 1, 2, 3)
        SELECT track, win_idx, CAST(f // 2 AS INTEGER) AS band, round(sum(re * re + im * im), 3) AS energy
        FROM spectrum GROUP BY 1, 2, 3""",
)
def f17(spark, sf):
    chunks, sizes = signal(spark, sf)
    windows = slice_windows(chunks, sizes, CHUNK, 16, step=8, padding="right")
    return band_energies(windows, 16, 4).withColumn("energy", F.round("energy", 3))
