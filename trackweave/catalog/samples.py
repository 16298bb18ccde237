"""Sampling, splitting, pairing and triplet queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.catalog.registry import query
from trackweave.catalog.relational import _SCORED, records, scored_names
from trackweave.catalog.signals import (
    CHUNK,
    M,
    _NEIGHBOURS,
    fragment_sql,
    long_fragments,
    signal,
    slices_sql,
    windows10,
)
from trackweave.catalog.sqltext import FRAMES, TAXONOMY, digest, draw, profile, shuffled, uniform
from trackweave.functions import vectors
from trackweave.functions.beta import attempts, beta
from trackweave.functions.draws import uniform as uniform_of
from trackweave.functions.scalar import frame_to_data
from trackweave.operators import batches, labels, pairing, sampling
from trackweave.operators.numbering import number_shuffled
from trackweave.operators.profile import matrix_profile
from trackweave.operators.windows import fragments, slice_windows
from trackweave.plans import motif, pairs
from trackweave.session import cut_lineage
from trackweave.sources.tracks import chunked, lengths, stored_frames, table, taxonomy

# groups and numbered members of a table known(key, family, ...)


def members_sql(seed, key: str = "track", source: str = "known", group: str = "family") -> str:
    return f"""groups AS (
  SELECT {group}, n_group, CAST(sum(n_group) OVER (ORDER BY {group}) - n_group AS BIGINT) AS group_start,
         CAST(sum(n_group) OVER () AS BIGINT) AS n_all, count(*) OVER () AS n_groups
  FROM (SELECT {group}, count(*) AS n_group FROM {source} WHERE {group} IS NOT NULL GROUP BY {group})),
members AS (
  SELECT k.*, group_start, n_group, n_all,
         group_start + row_number() OVER (PARTITION BY k.{group} ORDER BY {digest(seed, 'k.' + key)}, k.{key}) - 1 AS member
  FROM {source} k JOIN groups g ON g.{group} = k.{group})"""


def inside_sql(seed, *keys: str) -> str:
    return f"group_start + {draw(seed, *keys)} % n_group"


def outside_sql(seed, *keys: str) -> str:
    at = f"({draw(seed, *keys)} % (n_all - n_group))"
    return f"CASE WHEN {at} >= group_start THEN {at} + n_group ELSE {at} END"


_KNOWN = f"{TAXONOMY}, known AS (SELECT track, family FROM taxonomy)"


@query(
    "j8_same_family_pairs",
    f"""WITH {_KNOWN}, {members_sql(21)}
        SELECT m.track AS a, o.track AS b, m.family FROM (
          SELECT track, family, {inside_sql(21, "'near'", 'track')} AS pick FROM members) m
        JOIN members o ON o.member = m.pick""",
)
def j8(spark, sf):
    known = taxonomy(spark, sf).select("track", "family")
    members = pairing.numbered_members(known, "family", 21, ["track"])
    picks = members.select(
        F.col("track").alias("a"), "family", pairing.inside_member(21, F.lit("near"), "track").alias("member")
    )
    return picks.join(members.select("member", F.col("track").alias("b")), "member").select("a", "b", "family")


@query(
    "j9_other_family_pairs",
    f"""WITH {_KNOWN}, {members_sql(22)}
        SELECT m.track AS a, m.family, o.track AS c, o.family AS c_family FROM (
          SELECT track, family, {outside_sql(22, "'far'", 'track')} AS pick FROM members) m
        JOIN members o ON o.member = m.pick""",
)
def j9(spark, sf):
    known = taxonomy(spark, sf).select("track", "family")
    members = pairing.numbered_members(known, "family", 22, ["track"])
    picks = members.select(
        F.col("track").alias("a"), "family", pairing.outside_member(22, F.lit("far"), "track").alias("member")
    )
    others = members.select("member", F.col("track").alias("c"), F.col("family").alias("c_family"))
    return picks.join(others, "member").select("a", "family", "c", "c_family")


@query(
    "j10_positional_join",
    f"""WITH {_KNOWN},
        l AS (SELECT family, track AS a, {shuffled(31, ['track'], ['family'])} AS row_idx FROM known),
        r AS (SELECT family, track AS c, {shuffled(32, ['track'], ['family'])} AS row_idx FROM known)
        SELECT l.family, row_idx, a, c FROM l JOIN r USING (family, row_idx)""",
)
def j10(spark, sf):
    known = taxonomy(spark, sf).select("track", "family")
    left = number_shuffled(known, ["family"], 31, ["track"]).withColumnRenamed("track", "a")
    right = number_shuffled(known, ["family"], 32, ["track"]).withColumnRenamed("track", "c")
    return left.join(right, ["family", "row_idx"]).select("family", "row_idx", "a", "c")


def vector_batches(spark: SparkSession, sf: str, size: int = 16) -> DataFrame:
    """Vectors in full batches: ``(batch, slot, vec_id, label, embedding)``."""
    vecs = table(spark, sf, "embeddings")
    numbered = number_shuffled(vecs, [], 41, ["vec_id"], "row_idx", "n")
    return batches.full_batches(numbered, size).select("batch", "slot", "vec_id", "label", "embedding")


_BATCHES = f"""numbered AS (
    SELECT vec_id, label, embedding, {shuffled(41, ['vec_id'])} AS idx, count(*) OVER () AS n FROM embeddings),
  batches AS (SELECT idx // 16 AS batch, CAST(idx % 16 AS INTEGER) AS slot, vec_id, label, embedding
    FROM numbered WHERE idx // 16 < n // 16)"""


@query(
    "j11_batch_distants",
    f"""WITH {_BATCHES}, picked AS (
          SELECT batch, slot, vec_id, label,
                 (slot + {draw(43, "'slot'", 'batch', 'slot')} % 15 + 1) % 16 AS other,
                 {draw(43, "'side'", 'batch', 'slot')} % 2 AS side FROM batches)
        SELECT p.batch, p.slot, p.vec_id AS anchor_item, CAST(p.label AS BIGINT) AS neighbor_item,
               CASE WHEN side = 0 THEN o.vec_id ELSE CAST(o.label AS BIGINT) END AS distant_item
        FROM picked p JOIN batches o ON o.batch = p.batch AND o.slot = p.other""",
)
def j11(spark, sf):
    rows = vector_batches(spark, sf).select(
        "batch", "slot", F.col("vec_id").alias("anchor_item"), F.col("label").cast("bigint").alias("neighbor_item")
    )
    return pairing.batch_distants(rows, ["batch"], 16, 43, ["item"])


@query(
    "a11_inverse_frequency",
    f"""WITH {TAXONOMY}, c AS (SELECT family, count(*) AS n FROM taxonomy GROUP BY family),
        w AS (SELECT family, (sum(n) OVER () / n::DOUBLE) / sum(1) OVER () AS x, n, sum(n) OVER () AS t FROM c),
        v AS (SELECT family, (t / n::DOUBLE) / sum(t / n::DOUBLE) OVER () AS weight FROM w)
        SELECT family, round(weight, 9) AS weight, round(weight * floor(1 / max(weight) OVER ()), 9) AS fraction FROM v""",
)
def a11(spark, sf):
    counts = taxonomy(spark, sf).groupBy("family").agg(F.count("*").alias("n"))
    got = sampling.inverse_frequency(counts, "family")
    return got.withColumns({c: F.round(c, 9) for c in ("weight", "fraction")})


@query(
    "a12_balanced_weights",
    """SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 9) AS weight
       FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""",
)
def a12(spark, sf):
    got = sampling.balanced_weights(table(spark, sf, "embeddings"), "label")
    return got.withColumn("weight", F.round("weight", 9))


# the rarest kind is kept whole, the others in proportion
_FRACTIONS = """c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type),
  f AS (SELECT event_type, min(n) OVER () / n::DOUBLE * 0.5 AS fraction FROM c)"""


def kind_fractions(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    least = counts.agg(F.min("n")).scalar()
    return counts.select("event_type", (least / F.col("n") * 0.5).alias("fraction"))


@query(
    "m1_stratified_bernoulli",
    f"""WITH {_FRACTIONS} SELECT event_type, event_id FROM events JOIN f USING (event_type)
        WHERE {uniform(51, 'event_id')} < fraction""",
)
def m1(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id")
    return sampling.bernoulli_by_group(rows, "event_type", kind_fractions(spark, sf), 51, ["event_id"])


@query("m1_sample_by")
def m1_sample_by(spark, sf):
    """The same stratified sample drawn by Spark's own generator."""
    rows = table(spark, sf, "events").select("event_type", "event_id")
    known = {r["event_type"]: r["fraction"] for r in kind_fractions(spark, sf).collect()}
    return sampling.bernoulli_by_generator(rows, "event_type", known, 51)


@query(
    "u2_union_of_draws",
    f"""WITH {_FRACTIONS}, d AS (SELECT unnest(range(5)) AS draw)
        SELECT draw, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
        FROM events JOIN f USING (event_type), d WHERE {uniform(52, 'draw', 'event_id')} < fraction GROUP BY 1, 2""",
)
def u2(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id")
    draws = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))
    repeated = rows.withColumn("draw", draws)
    got = sampling.bernoulli_by_group(
        repeated, "event_type", kind_fractions(spark, sf), 52, ["draw", "event_id"]
    )
    return got.groupBy("draw", "event_type").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("id_sum")
    )


def _drawn_sql(seed, k: int, group: str, key: str, source: str) -> str:
    return f"""numbered AS (SELECT *, {shuffled(seed, [key], [group])} AS row_idx,
                 count(*) OVER (PARTITION BY {group}) AS n_in FROM {source}),
      picks AS (SELECT {group}, draw, {draw(seed, "'pick'", group, 'draw')} % n_in AS row_idx
        FROM (SELECT DISTINCT {group}, n_in FROM numbered), (SELECT unnest(range({k})) AS draw)),
      drawn AS (SELECT numbered.*, draw FROM picks JOIN numbered USING ({group}, row_idx))"""


@query(
    "m2_with_replacement",
    f"""WITH {_drawn_sql(53, 300, 'event_type', 'event_id', 'events')}
        SELECT event_type, draw, event_id FROM drawn""",
)
def m2(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id")
    return sampling.sample_with_replacement(rows, "event_type", 300, 53, ["event_id"])


@query(
    "m3_class_balance",
    f"""WITH {_drawn_sql(54, 500, 'label', 'vec_id', 'embeddings')}
        SELECT label, concat_ws('_', vec_id, draw) AS name, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM drawn""",
)
def m3(spark, sf):
    vecs = table(spark, sf, "embeddings")
    drawn = sampling.sample_with_replacement(vecs, "label", 500, 54, ["vec_id"])
    total = vectors.total(F.col("embedding"))
    name = F.concat_ws("_", F.col("vec_id").cast("string"), F.col("draw").cast("string"))
    return drawn.select("label", name.alias("name"), F.round(total, 6).alias("total"))


@query(
    "m4_without_replacement",
    f"""SELECT source, doc_id FROM (SELECT source, doc_id, {shuffled(55, ['doc_id'], ['source'])} AS r FROM documents)
        WHERE r < 7""",
)
def m4(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    return sampling.sample_without_replacement(docs, ["source"], 7, 55, ["doc_id"])


@query(
    "m4_without_replacement_global",
    f"SELECT doc_id FROM (SELECT doc_id, {shuffled(56, ['doc_id'])} AS r FROM documents) WHERE r < 100",
)
def m4_global(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return sampling.sample_without_replacement(docs, [], 100, 56, ["doc_id"])


def _numbered(seed, key: str, source: str, group: str | None = None) -> str:
    over = f"PARTITION BY {group}" if group else ""
    return f"""SELECT *, {shuffled(seed, [key], [group] if group else None)} AS i,
             count(*) OVER ({over}) AS n FROM {source}"""


@query(
    "m5_split_train_test",
    f"""SELECT event_id, CASE WHEN i < floor(0.9::DOUBLE * n) THEN 'train' ELSE 'test' END AS split
        FROM ({_numbered(57, 'event_id', 'events')})""",
)
def m5(spark, sf):
    return sampling.split_two(table(spark, sf, "events").select("event_id"), 0.9, 57, ["event_id"])


@query(
    "m5_split_three_ways",
    f"""SELECT event_id, CASE WHEN i < a THEN 'train' WHEN i < a + floor((n - a) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, floor(0.8::DOUBLE * n) AS a FROM ({_numbered(58, 'event_id', 'events')}))""",
)
def m5_three(spark, sf):
    return sampling.split_three(table(spark, sf, "events").select("event_id"), 0.8, 58, ["event_id"])


@query(
    "m6_stratified_split",
    f"""SELECT vec_id, label, CASE WHEN i < floor(0.9::DOUBLE * n) THEN 'train' ELSE 'test' END AS split
        FROM ({_numbered(59, 'vec_id', 'embeddings', 'label')})""",
)
def m6(spark, sf):
    vecs = table(spark, sf, "embeddings").select("vec_id", "label")
    return sampling.split_two(vecs, 0.9, 59, ["vec_id"], ["label"])


@query(
    "m7_exact_lengths",
    f"""SELECT event_id, CAST(i >= n - floor(n * 0.1::DOUBLE) AS INTEGER) AS part
        FROM ({_numbered(60, 'event_id', 'events')})""",
)
def m7(spark, sf):
    return sampling.split_lengths(table(spark, sf, "events").select("event_id"), [0.9, 0.1], 60, ["event_id"])


@query(
    "m8_folds",
    f"SELECT vec_id, CAST({draw(61, 'vec_id')} % 5 AS INTEGER) AS fold FROM embeddings",
)
def m8(spark, sf):
    return sampling.folds(table(spark, sf, "embeddings").select("vec_id"), 5, 61, ["vec_id"])


def triplets_sql(seed, n_samples: int, places: str) -> str:
    """CTEs ending in ``triplets``; ``places`` gives ``known``."""
    named = ["family", "across", "draw"]
    return f"""{TAXONOMY}, known AS ({places}), {members_sql(seed)},
      slots AS (SELECT family, across, draw, group_start, n_group, n_all FROM (
        SELECT g.*, unnest(range(({n_samples} // n_groups) // 2)) AS draw FROM groups g), (SELECT unnest([0, 1]) AS across)),
      picks AS (SELECT family, across, draw,
          {inside_sql(seed, "'first'", *named)} AS pa,
          CASE WHEN across = 1 THEN {inside_sql(seed, "'second'", *named)} ELSE {inside_sql(seed, "'first'", *named)} END AS pb,
          {outside_sql(seed, "'third'", *named)} AS pc
        FROM slots),
      triplets AS (SELECT {shuffled(seed, ['p.family', 'across', 'draw'])} AS "index", p.family,
          a.track AS a, CAST(coalesce(a.motif_0, -1) AS DOUBLE) AS a_loc,
          b.track AS b, CAST(coalesce(b.motif_1, -1) AS DOUBLE) AS b_loc, c.track AS c,
          CASE WHEN across = 0 THEN CAST(coalesce(c.motif_0, -1) AS DOUBLE)
               WHEN c.duration_seconds <= 5 THEN -1
               ELSE {uniform(seed, "'offset'", 'p.family', 'across', 'draw')} * (c.duration_seconds - 5) + 5 / 2.0 END AS c_loc
        FROM picks p JOIN members a ON a.member = pa JOIN members b ON b.member = pb JOIN members c ON c.member = pc)"""


_RAW_PLACES = """SELECT r.track, family, motif_0, motif_1, duration_seconds
  FROM records r LEFT JOIN taxonomy t ON t.track = r.track"""
_SECOND_PLACES = """SELECT r.track, family,
  CAST(trunc((motif_0 / (n_frames + 40.0)::DOUBLE + (40 / 2.0) / (n_frames + 40.0)::DOUBLE) * duration_seconds) AS BIGINT) AS motif_0,
  CAST(trunc((motif_1 / (n_frames + 40.0)::DOUBLE + (40 / 2.0) / (n_frames + 40.0)::DOUBLE) * duration_seconds) AS BIGINT) AS motif_1,
  duration_seconds FROM records r LEFT JOIN taxonomy t ON t.track = r.track"""


def sampled_triplets(spark: SparkSession, sf: str, raw_units: bool) -> DataFrame:
    return motif.triplet_table(records(spark, sf, 40), taxonomy(spark, sf), 2000, 71, 5, raw_units)


@query("m9_triplets_raw_units", f"WITH {FRAMES}, {profile(40)}, {triplets_sql(71, 2000, _RAW_PLACES)} SELECT * FROM triplets")
def m9_raw(spark, sf):
    return sampled_triplets(spark, sf, True)


@query("m9_triplets", f"WITH {FRAMES}, {profile(40)}, {triplets_sql(71, 2000, _SECOND_PLACES)} SELECT * FROM triplets")
def m9(spark, sf):
    return sampled_triplets(spark, sf, False)


@query(
    "m10_random_offset",
    f"""SELECT doc_id, round(CASE WHEN n_chars <= 300 THEN -1
          ELSE {uniform(72, 'doc_id')} * (n_chars - 300) + 300 / 2.0 END, 6) AS place FROM documents""",
)
def m10(spark, sf):
    place = sampling.random_offset(F.col("n_chars"), 300, uniform_of(72, "doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.round(place, 6).alias("place"))


_MIXED = f"""{_BATCHES},
  placed AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY {digest(73, 'batch', 'slot')}, slot) - 1 AS r,
             {uniform(74, 'vec_id')} AS lam FROM batches)"""


@query(
    "m11_mixup",
    f"""WITH {_MIXED}
        SELECT vec_id, dim, round(x * lam + y * (1 - lam), 9) AS value FROM (
          SELECT a.vec_id, a.lam, CAST(unnest(range(64)) AS INTEGER) AS dim,
                 unnest(a.embedding::DOUBLE[]) AS x, unnest(b.embedding::DOUBLE[]) AS y
          FROM placed a JOIN placed b ON b.batch = a.batch AND b.r = (a.r + 1) % 16)""",
)
def m11(spark, sf):
    rows = vector_batches(spark, sf).withColumn("embedding", F.col("embedding").cast("array<double>"))
    mixed = pairing.mixed_up(rows, ["batch"], 73, uniform_of(74, "vec_id"), ["embedding"])
    return mixed.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round("value", 9)
    )


def beta_sql(alpha: float, seed, key: str, source: str) -> str:
    """A CTE ``weights(<key>, lam)``: the first accepted pair of draws of each key."""
    return f"""tries AS (
    SELECT {key}, i, pow({uniform(seed, "'first'", key, 'i')}, {1 / alpha!r}::DOUBLE) AS x,
           pow({uniform(seed, "'second'", key, 'i')}, {1 / alpha!r}::DOUBLE) AS y
    FROM {source}, (SELECT unnest(range({attempts(alpha)})) AS i)),
  weights AS (SELECT {key}, arg_min(x / (x + y), i) AS lam FROM tries WHERE x + y <= 1 AND x + y > 0 GROUP BY {key})"""


@query(
    "m11_mixup_beta",
    f"""WITH {_MIXED}, {beta_sql(0.4, 74, 'vec_id', 'embeddings')},
        pairs AS (
          SELECT a.vec_id, w.lam, a.embedding::DOUBLE[] AS e, b.embedding::DOUBLE[] AS f, a.label AS k, b.label AS l
          FROM placed a JOIN placed b ON b.batch = a.batch AND b.r = (a.r + 1) % 16 JOIN weights w ON w.vec_id = a.vec_id)
        SELECT vec_id, round(lam, 9) AS lam, 'embedding' AS part, dim, round(x * lam + y * (1 - lam), 9) AS value FROM (
          SELECT vec_id, lam, CAST(unnest(range(64)) AS INTEGER) AS dim, unnest(e) AS x, unnest(f) AS y FROM pairs)
        UNION ALL
        SELECT vec_id, round(lam, 9), 'target', dim, round((k = dim)::DOUBLE * lam + (l = dim)::DOUBLE * (1 - lam), 9) FROM (
          SELECT vec_id, lam, k, l, CAST(unnest(range(10)) AS INTEGER) AS dim FROM pairs)""",
)
def m11_beta(spark, sf):
    """Mixing weights from Beta(0.4, 0.4); features and one-hot targets."""
    rows = vector_batches(spark, sf).select(
        "batch",
        "slot",
        "vec_id",
        F.col("embedding").cast("array<double>").alias("embedding"),
        vectors.one_hot(F.col("label"), F.lit(10)).cast("array<double>").alias("target"),
    )
    mixed = pairing.mixed_up(rows, ["batch"], 73, beta(0.4, 74, "vec_id"), ["embedding", "target"])
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("values")) for c in ("embedding", "target")])
    each = mixed.select("vec_id", F.round("lam", 9).alias("lam"), F.explode(parts).alias("_p"))
    return each.select("vec_id", "lam", "_p.part", F.posexplode("_p.values").alias("dim", "value")).withColumn("value", F.round("value", 9))


# pipelines


_PAIR_WINDOWS = f"""{slices_sql(10, 0, None, "right-align")},
  wins AS (SELECT track, win_idx, round(sum(value), 6) AS total FROM slices GROUP BY 1, 2),
  spread AS (SELECT track, CAST(floor(t / ceil(n / 4.0)) AS BIGINT) AS worker FROM (
    SELECT track, {shuffled(81, ['track'])} AS t, count(*) OVER () AS n FROM (SELECT DISTINCT track FROM wins))),
  pairs AS (SELECT worker, n.track, a.win_idx AS anchor_win_idx, a.total AS anchor_total,
      b.win_idx AS neighbor_win_idx, b.total AS neighbor_total
    FROM neighbours n JOIN wins a ON a.track = n.track AND a.win_idx = n.win
    JOIN wins b ON b.track = n.track AND b.win_idx = n.nbr JOIN spread s ON s.track = n.track),
  batches AS (SELECT *, idx // 16 AS batch, CAST(idx % 16 AS INTEGER) AS slot FROM (
      SELECT *, row_number() OVER (PARTITION BY worker ORDER BY {digest(81, 'track', 'anchor_win_idx')}, track, anchor_win_idx) - 1 AS idx,
             count(*) OVER (PARTITION BY worker) AS n FROM pairs) WHERE idx // 16 < n // 16)"""


def pair_batches(spark: SparkSession, sf: str) -> DataFrame:
    signal_ = stored_frames(spark, sf)
    total = F.round(vectors.total(F.col("x")), 6).alias("total")
    windows = slice_windows(
        chunked(signal_, CHUNK), lengths(signal_), CHUNK, 10, padding="right-align"
    ).select("track", "win_idx", total)
    return pairs.pair_batches(matrix_profile(signal_, M), windows, 10, 4, 16, 81)


PAIR_SQL = f"""WITH {FRAMES}, {profile(M)}, {_NEIGHBOURS}, {_PAIR_WINDOWS}"""
# up to the pairs, without their batches
PAIR_WINDOWS_SQL = PAIR_SQL[: PAIR_SQL.rindex(",\n  batches AS")]


def pair_requests(spark: SparkSession, sf: str) -> DataFrame:
    """``(worker, track, win_idx, total, nbr)``: every window with the neighbour it is to be paired with."""
    signal_ = stored_frames(spark, sf)
    total = F.round(vectors.total(F.col("x")), 6).alias("total")
    windows = slice_windows(
        chunked(signal_, CHUNK), lengths(signal_), CHUNK, 10, padding="right-align"
    ).select("track", F.col("win_idx").cast("bigint").alias("win_idx"), total)
    nearest = pairing.window_neighbours(matrix_profile(signal_, M), 10).withColumnRenamed("win", "win_idx")
    return pairs.requests(windows, nearest, 4, 81)


@query(
    "l13_pair_stream",
    f"""{PAIR_SQL}, picked AS (
          SELECT *, (slot + {draw(82, "'slot'", 'worker', 'batch', 'slot')} % 15 + 1) % 16 AS other,
                 {draw(82, "'side'", 'worker', 'batch', 'slot')} % 2 AS side FROM batches)
        SELECT p.worker, p.batch, p.slot, p.track, p.anchor_win_idx, p.anchor_total, p.neighbor_win_idx, p.neighbor_total,
          CASE WHEN side = 0 THEN o.anchor_win_idx ELSE o.neighbor_win_idx END AS distant_win_idx,
          CASE WHEN side = 0 THEN o.anchor_total ELSE o.neighbor_total END AS distant_total
        FROM picked p JOIN batches o ON o.worker = p.worker AND o.batch = p.batch AND o.slot = p.other""",
)
def l13(spark, sf):
    return pairs.pair_triplets(pair_batches(spark, sf), 16, 82, ["win_idx", "total"])


@query(
    "l15_triplet_fragments",
    f"""WITH {FRAMES}, {profile(40)}, {triplets_sql(71, 2000, _RAW_PLACES)},
        {fragment_sql('''SELECT DISTINCT track, CAST(trunc(loc) AS BIGINT) AS "offset" FROM (
            SELECT a AS track, a_loc AS loc FROM triplets UNION ALL SELECT b, b_loc FROM triplets
            UNION ALL SELECT c, c_loc FROM triplets)''', 7)}
        SELECT * FROM fragment""",
)
def l15(spark, sf):
    chunks, sizes = signal(spark, sf)
    requests = motif.triplet_requests(sampled_triplets(spark, sf, True))
    return long_fragments(fragments(chunks, sizes, CHUNK, requests, 7))


@query(
    "l20_sampled_motif_fragments",
    f"""WITH {FRAMES}, {profile(40)}, {TAXONOMY}, chosen AS (
          SELECT track, species, start FROM (
            SELECT r.track, species,
              coalesce(CAST(trunc((motif_0 / (n_frames + 40.0)::DOUBLE + (40 / 2.0) / (n_frames + 40.0)::DOUBLE) * n_frames) AS BIGINT), 0) AS start,
              row_number() OVER (PARTITION BY species ORDER BY {digest(83, 'r.track')}, r.track) AS k
            FROM records r JOIN taxonomy t ON t.track = r.track) WHERE k <= 4),
        {fragment_sql('SELECT track, start AS "offset" FROM chosen', 5)}
        SELECT species AS label, f.track, off, value FROM fragment f JOIN chosen c ON c.track = f.track""",
)
def l20(spark, sf):
    signal_ = stored_frames(spark, sf)
    chunks, sizes = chunked(signal_, CHUNK), lengths(signal_)
    recs = motif.track_records(sizes, matrix_profile(signal_, 40), 40)
    known = recs.join(taxonomy(spark, sf).select("track", F.col("species").alias("label")), "track")
    chosen = sampling.sample_without_replacement(known, ["label"], 4, 83, ["track"])
    start, _ = frame_to_data(F.col("motif_0"), F.col("window"), F.col("n_frames"), F.col("n_frames"))
    requests = chosen.select("track", "label", F.coalesce(start, F.lit(0).cast("bigint")).alias("offset"))
    got = fragments(chunks, sizes, CHUNK, requests, 5, keys=["track", "label"])
    return got.select("label", "track", F.posexplode("x").alias("off", "value"))


@query(
    "l22_training_set",
    f"""WITH {FRAMES}, {TAXONOMY}, {_SCORED}, {slices_sql(10, 0, None, 'right')},
        pool AS (SELECT DISTINCT concat_ws('_', s.track, win_idx) AS name, s.track, win_idx,
            CASE WHEN species IN (SELECT label FROM scored) THEN species ELSE 'other' END AS label
          FROM slices s JOIN taxonomy t ON t.track = s.track),
        {_drawn_sql(84, 30, 'label', 'name', 'pool')}
        SELECT label, concat_ws('_', name, draw) AS name, off,
               round(value * pow(10.0, (-18 + 24 * {uniform(85, 'label', 'name', 'draw')}) / 20), 6) AS value
        FROM drawn d JOIN slices s ON s.track = d.track AND s.win_idx = d.win_idx""",
)
def l22(spark, sf):
    """Windows of scored classes and of all others, balanced and with random gain."""
    rows = windows10(spark, sf).join(taxonomy(spark, sf).select("track", "species"), "track")
    name = F.concat_ws("_", F.col("track").cast("string"), F.col("win_idx").cast("string")).alias("name")
    scored = scored_names(spark, sf)
    positive = labels.in_list(rows, "species", scored).select(name, "x", F.col("species").alias("label"))
    known = scored.select(F.col("label").alias("species"))
    negative = rows.join(known, "species", "left_anti").select(name, "x", F.lit("other").alias("label"))
    pool = cut_lineage(positive.unionByName(negative))
    drawn = sampling.sample_with_replacement(pool, "label", 30, 84, ["name"])
    loud = drawn.withColumn("_db", -18 + 24 * uniform_of(85, "label", "name", "draw")).select(
        "label",
        F.concat_ws("_", "name", F.col("draw").cast("string")).alias("name"),
        vectors.gain(F.col("x"), F.col("_db")).alias("x"),
    )
    return loud.select("label", "name", F.posexplode("x").alias("off", "value")).withColumn(
        "value", F.round("value", 6)
    )
