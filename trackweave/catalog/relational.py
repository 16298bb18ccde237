"""Projections, filters, joins, aggregates, sorts and sets over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.catalog.registry import query
from trackweave.catalog.sqltext import FRAMES, TAXONOMY, profile, shuffled
from trackweave.functions import scalar
from trackweave.operators import labels, metrics, sampling
from trackweave.operators.numbering import with_each
from trackweave.plans import motif
from trackweave.sources.tracks import frames, lengths, stored_frames, table, taxonomy

_BARE = "regexp_replace(url, '^https?://', '')"
_SCORED = "scored AS (SELECT n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"
_CLOCK = """CASE event_type
    WHEN 'click' THEN concat(minute(ts), ':', second(ts))
    WHEN 'view' THEN concat(hour(ts), ':', minute(ts), ':', second(ts))
    WHEN 'error' THEN concat('?', minute(ts))
    WHEN 'signup' THEN concat(minute(ts), ':')
    ELSE '' END"""


def bare_url() -> F.Column:
    return F.regexp_replace("url", "^https?://", "")


def scored_names(spark: SparkSession, sf: str) -> DataFrame:
    """The list of classes that count: the nations of one region."""
    region = table(spark, sf, "region").where("r_name = 'ASIA'")
    nation = table(spark, sf, "nation")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("label")
    )


def clocks(spark: SparkSession, sf: str) -> DataFrame:
    """Recording times as text, some of them malformed."""
    return table(spark, sf, "events").select("event_id", F.expr(_CLOCK).alias("time"))


# projections and filters


@query(
    "p1_species_segment",
    f"SELECT page_id, string_split({_BARE}, '/')[2] AS species FROM pages",
)
def p1(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", scalar.path_part(bare_url(), 1).alias("species")
    )


@query(
    "p2_file_stem_last_parts",
    f"""SELECT page_id, split_part(list_extract(parts, -1), '.', 1) AS stem,
          array_to_string(parts[-3:], '/') AS source_name
        FROM (SELECT page_id, string_split({_BARE}, '/') AS parts FROM pages)""",
)
def p2(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        scalar.file_stem(bare_url()).alias("stem"),
        scalar.last_parts(bare_url(), 3).alias("source_name"),
    )


@query(
    "p3_name_decomposition",
    """SELECT event_id, split_part(name, '_', 1) AS audio_id, split_part(name, '_', 2) AS site
       FROM (SELECT event_id, concat_ws('_', user_id, event_type, event_id) AS name FROM events)""",
)
def p3(spark, sf):
    name = F.concat_ws("_", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string"))
    parts = F.split("name", "_")
    return (
        table(spark, sf, "events")
        .select("event_id", name.alias("name"))
        .select(
            "event_id",
            F.get(parts, F.lit(0)).alias("audio_id"),
            F.get(parts, F.lit(1)).alias("site"),
        )
    )


@query(
    "p4_composite_key",
    "SELECT concat_ws('_', user_id, event_type, event_id * 5) AS row_id, value FROM events",
)
def p4(spark, sf):
    key = F.concat_ws(
        "_", F.col("user_id").cast("string"), "event_type", (F.col("event_id") * 5).cast("string")
    )
    return table(spark, sf, "events").select(key.alias("row_id"), "value")


@query(
    "p5_select_rename",
    "SELECT n_name AS species, n_regionkey AS family FROM nation",
)
def p5(spark, sf):
    return (
        table(spark, sf, "nation")
        .select("n_name", "n_regionkey")
        .withColumnsRenamed({"n_name": "species", "n_regionkey": "family"})
    )


@query(
    "p6_membership",
    f"WITH {TAXONOMY}, {_SCORED} SELECT track, species FROM taxonomy WHERE species IN (SELECT label FROM scored)",
)
def p6(spark, sf):
    known = taxonomy(spark, sf).select("track", "species")
    return labels.in_list(known, "species", scored_names(spark, sf)).select("track", "species")


@query(
    "p7_collapse_others",
    f"""WITH {TAXONOMY}, {_SCORED} SELECT track,
          CASE WHEN species IN (SELECT label FROM scored) THEN species ELSE 'other' END AS species
        FROM taxonomy""",
)
def p7(spark, sf):
    known = taxonomy(spark, sf).select("track", "species")
    return labels.others_collapsed(known, "species", scored_names(spark, sf)).select("track", "species")


@query(
    "p8_call_flag",
    "SELECT event_id, CAST(event_type <> 'error' AS INTEGER) AS y FROM events",
)
def p8(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", (F.col("event_type") != "error").cast("int").alias("y")
    )


@query(
    "p9_negatives_as_other",
    """SELECT doc_id AS name, text AS data, 'other' AS label
       FROM documents JOIN labels USING (doc_id) WHERE quality = 0""",
)
def p9(spark, sf):
    negative = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return (
        table(spark, sf, "documents")
        .join(negative, "doc_id")
        .select(F.col("doc_id").alias("name"), F.col("text").alias("data"), F.lit("other").alias("label"))
    )


@query(
    "p10_malformed_times",
    f"""SELECT time, count(*) AS n FROM (SELECT {_CLOCK} AS time FROM events)
        WHERE length(time) < 3 OR time LIKE '%?%' OR time LIKE '%:%:%' GROUP BY time""",
)
def p10(spark, sf):
    bad = "length(time) < 3 or time like '%?%' or time like '%:%:%'"
    return clocks(spark, sf).where(bad).groupBy("time").agg(F.count("*").alias("n"))


@query(
    "p11_range_filter",
    "SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 AND n_chars / 60.0 < 30",
)
def p11(spark, sf):
    return (
        table(spark, sf, "documents")
        .where((F.col("n_chars") > 0) & (F.col("n_chars") / 60.0 < 30))
        .select("doc_id", "n_chars")
    )


@query(
    "p12_null_family",
    f"""WITH {_SCORED} SELECT count(*) AS n FROM customer
        JOIN nation ON c_nationkey = n_nationkey LEFT JOIN scored ON n_name = label WHERE label IS NULL""",
)
def p12(spark, sf):
    known = scored_names(spark, sf).select(F.col("label").alias("species"), F.lit(1).alias("family"))
    return (
        taxonomy(spark, sf)
        .select("track", "species")
        .join(known, "species", "left")
        .where(F.col("family").isNull())
        .agg(F.count("*").alias("n"))
    )


def records(spark: SparkSession, sf: str, m: int = 8) -> DataFrame:
    return motif.extract(stored_frames(spark, sf), m)


@query(
    "p13_equal_columns",
    f"WITH {FRAMES}, {profile(8)} SELECT track, motif_0, discord_1 FROM records WHERE motif_0 = discord_1 OR motif_1 = discord_1",
)
def p13(spark, sf):
    same = (F.col("motif_0") == F.col("discord_1")) | (F.col("motif_1") == F.col("discord_1"))
    return records(spark, sf).where(same).select("track", "motif_0", "discord_1")


@query(
    "p14_null_replacement",
    f"""WITH {FRAMES}, {profile(40)}
        SELECT track, coalesce(motif_0, -1) AS motif_0, coalesce(motif_1, -1) AS motif_1 FROM records""",
)
def p14(spark, sf):
    none = F.lit(-1).cast("bigint")
    return records(spark, sf, 40).select(
        "track", F.coalesce("motif_0", none).alias("motif_0"), F.coalesce("motif_1", none).alias("motif_1")
    )


@query(
    "p15_short_track_gate",
    f"WITH {FRAMES}, {profile(60)} SELECT * FROM records",
)
def p15(spark, sf):
    return records(spark, sf, 60)


@query(
    "p16_drop_sentinel",
    """SELECT vec_id, idx FROM (
         SELECT vec_id, idx, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, idx DESC) AS r
         FROM (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS idx, unnest(embedding) AS s FROM embeddings))
       WHERE r = 1 AND idx <> 63""",
)
def p16(spark, sf):
    best = labels.top_classes(table(spark, sf, "embeddings"), "embedding", ["vec_id"], 1)
    return best.where("idx <> 63").select("vec_id", "idx")


@query(
    "p17_drop_time_zero",
    f"WITH {FRAMES} SELECT track, pos * 5 AS end_time FROM frames WHERE pos <> 0",
)
def p17(spark, sf):
    windows = frames(spark, sf).select("track", (F.col("pos") * 5).alias("end_time"))
    return windows.where("end_time <> 0")


# joins


@query(
    "j1_taxonomy_join",
    f"WITH {TAXONOMY} SELECT event_id, species, family FROM events LEFT JOIN taxonomy ON user_id = track",
)
def j1(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("track"))
    return events.join(taxonomy(spark, sf), "track", "left").select("event_id", "species", "family")


@query(
    "j2_labels_join",
    """SELECT concat_ws('_', doc_id, source, lang) AS row_id, quality AS y, n_chars
       FROM documents JOIN labels USING (doc_id)""",
)
def j2(spark, sf):
    key = F.concat_ws("_", F.col("doc_id").cast("string"), "source", "lang")
    docs = table(spark, sf, "documents").select("doc_id", key.alias("row_id"), "n_chars")
    known = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    return docs.join(known, "doc_id").select("row_id", "y", "n_chars")


_GRID = """kinds AS (SELECT DISTINCT event_type AS bird FROM events),
places AS (SELECT DISTINCT user_id AS file_id, (event_id % 12) * 5 AS end_time FROM events),
hits AS (SELECT DISTINCT user_id AS file_id, event_type AS bird, (event_id % 12) * 5 AS end_time, true AS target
         FROM events WHERE event_type <> 'error')"""


def event_places(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of each file: every user with twelve time labels."""
    end = ((F.col("event_id") % 12) * 5).alias("end_time")
    return table(spark, sf, "events").select(F.col("user_id").alias("file_id"), "event_type", end)


@query(
    "j3_grid_fill",
    f"""WITH {_GRID} SELECT p.file_id, k.bird, p.end_time, coalesce(h.target, false) AS target
        FROM places p CROSS JOIN kinds k
        LEFT JOIN hits h ON h.file_id = p.file_id AND h.bird = k.bird AND h.end_time = p.end_time""",
)
def j3(spark, sf):
    seen = event_places(spark, sf)
    classes = seen.select(F.col("event_type").alias("bird")).distinct()
    grid = with_each(seen.select("file_id", "end_time").distinct(), classes)
    hits = seen.select(
        "file_id", F.col("event_type").alias("bird"), "end_time", F.lit(True).alias("target")
    ).distinct()
    return labels.fill_grid(grid, hits, ["file_id", "bird", "end_time"], "error").select(
        "file_id", "bird", "end_time", "target"
    )


@query(
    "j4_windows_times_classes",
    f"WITH {_GRID} SELECT file_id, end_time, bird FROM places CROSS JOIN kinds",
)
def j4(spark, sf):
    seen = event_places(spark, sf)
    classes = seen.select(F.col("event_type").alias("bird")).distinct()
    return with_each(seen.select("file_id", "end_time").distinct(), classes)


# aggregates


@query("a1_count", "SELECT count(*) AS n FROM events")
def a1(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("n"))


@query(
    "a2_conditional_sum",
    "SELECT count(*) AS n, CAST(sum(CASE WHEN n_chars < 300 THEN 1 ELSE 0 END) AS BIGINT) AS n_short FROM documents",
)
def a2(spark, sf):
    return table(spark, sf, "documents").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("n_chars") < 300, 1).otherwise(0)).alias("n_short")
    )


@query(
    "a3_group_counts",
    f"WITH {TAXONOMY} SELECT family, species, count(*) AS n FROM events LEFT JOIN taxonomy ON user_id = track GROUP BY 1, 2",
)
def a3(spark, sf):
    per_track = table(spark, sf, "events").groupBy(F.col("user_id").alias("track")).agg(F.count("*").alias("n"))
    return (
        per_track.join(taxonomy(spark, sf), "track", "left")
        .groupBy("family", "species")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"))
    )


@query(
    "a4_distinct_counts",
    f"""WITH {TAXONOMY} SELECT count(DISTINCT species) AS n_species, count(DISTINCT family) AS n_family,
        count(DISTINCT user_id) AS n_tracks FROM events LEFT JOIN taxonomy ON user_id = track""",
)
def a4(spark, sf):
    seen = table(spark, sf, "events").select(F.col("user_id").alias("track")).distinct()
    return seen.join(taxonomy(spark, sf), "track", "left").agg(
        F.count_distinct("species").alias("n_species"),
        F.count_distinct("family").alias("n_family"),
        F.count_distinct("track").alias("n_tracks"),
    )


@query(
    "a5_group_statistics",
    """SELECT source, count(n_chars) AS n, CAST(sum(n_chars) AS BIGINT) AS total, median(n_chars) AS median,
          round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std
       FROM documents GROUP BY source""",
)
def a5(spark, sf):
    docs = table(spark, sf, "documents").select("source", "n_chars")
    return metrics.described(docs, ["source"], "n_chars").select(
        "source",
        F.col("count").alias("n"),
        "total",
        F.col("p50").alias("median"),
        F.round("mean", 6).alias("mean"),
        F.round("std", 6).alias("std"),
    )


@query(
    "a6_totals",
    """SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS total, round(sum(total) / 3600.0, 6) AS hours
       FROM (SELECT source, lang, count(*) AS n, sum(n_chars) AS total FROM documents GROUP BY source, lang)""",
)
def a6(spark, sf):
    per_group = table(spark, sf, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("total")
    )
    return per_group.agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.round(F.sum("total") / 3600.0, 6).alias("hours"),
    )


_DESCRIBE = """count(value) AS "count", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS "min", round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS "max" """


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("a7_describe", f"SELECT {_DESCRIBE} FROM events")
def a7(spark, sf):
    return _rounded(metrics.described(table(spark, sf, "events"), [], "value").drop("total"))


@query(
    "a7_describe_by_group",
    f"SELECT event_type, {_DESCRIBE} FROM events GROUP BY event_type",
)
def a7_by_group(spark, sf):
    return _rounded(metrics.described(table(spark, sf, "events"), ["event_type"], "value").drop("total"))


@query(
    "a17_histogram",
    """SELECT CAST(least(floor((n_chars - lo) * 1.0 / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n
       FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) GROUP BY 1""",
)
def a17(spark, sf):
    docs = table(spark, sf, "documents").select("n_chars")
    low, high = docs.agg(F.min("n_chars")).scalar(), docs.agg(F.max("n_chars")).scalar()
    return metrics.histogram(docs, F.col("n_chars"), low, high, 10)


@query(
    "a17_histogram_log2",
    """SELECT CAST(least(floor(log2(c) / 16 * 16), 15) AS BIGINT) AS bin, count(*) AS n
       FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY source, lang) GROUP BY 1""",
)
def a17_log2(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("c"))
    return metrics.histogram(counts, F.log2("c"), F.lit(0.0), F.lit(16.0), 16)


# sorts and limits


@query(
    "t1_order_by_count",
    "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type",
)
def t1(spark, sf):
    return (
        table(spark, sf, "events")
        .groupBy("event_type")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "event_type")
    )


@query(
    "t5_first_n_per_group",
    f"""WITH {TAXONOMY} SELECT species, track, CAST(r AS INTEGER) AS "rank" FROM (
          SELECT species, track, row_number() OVER (PARTITION BY species ORDER BY track) AS r FROM taxonomy)
        WHERE r <= 10""",
)
def t5(spark, sf):
    tracks = taxonomy(spark, sf).select("species", "track")
    return sampling.first_per_group(tracks, ["species"], ["track"], 10)


@query(
    "t7_shuffle",
    f"""SELECT {shuffled(2022, ['event_id'])} AS "index", event_id FROM events""",
)
def t7(spark, sf):
    return sampling.shuffled(table(spark, sf, "events").select("event_id"), 2022, ["event_id"])


# sets


@query(
    "u1_union_all",
    """SELECT doc_id AS name, 'motif' AS origin, quality AS y FROM labels WHERE quality = 1
       UNION ALL SELECT doc_id, 'noise', 0 FROM labels WHERE quality = 0""",
)
def u1(spark, sf):
    known = table(spark, sf, "labels")
    positive = known.where("quality = 1").select(
        F.col("doc_id").alias("name"), F.lit("motif").alias("origin"), F.col("quality").alias("y")
    )
    negative = known.where("quality = 0").select(
        F.lit(0).alias("y"), F.lit("noise").alias("origin"), F.col("doc_id").alias("name")
    )
    return positive.unionByName(negative)


@query(
    "u3_distinct_positions",
    f"""WITH {FRAMES}, {profile(8)} SELECT DISTINCT track, idx FROM (
          SELECT track, motif_0 AS idx FROM motifs UNION ALL SELECT track, motif_1 FROM motifs
          UNION ALL SELECT track, discord_0 FROM motifs UNION ALL SELECT track, discord_1 FROM motifs)""",
)
def u3(spark, sf):
    places = F.explode(F.array("motif_0", "motif_1", "discord_0", "discord_1"))
    return records(spark, sf).select("track", places.alias("idx")).distinct()


@query("u4_distinct_groups", "SELECT DISTINCT label FROM embeddings")
def u4(spark, sf):
    return table(spark, sf, "embeddings").select("label").distinct()


# scalar functions on time bases and text


@query(
    "f1_hop_length",
    "SELECT doc_id, CAST(floor(n_chars / (10 * 64.0)) * 64 AS BIGINT) AS hop FROM documents",
)
def f1(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", scalar.hop_length(F.col("n_chars"), 10).alias("hop")
    )


@query(
    "f2_frame_to_sample",
    f"""WITH {FRAMES} SELECT track, pos,
          CAST(trunc((pos / (n + 8.0)::DOUBLE + (8 / 2.0) / (n + 8.0)::DOUBLE) * (n * 3200)) AS BIGINT) AS start_sample,
          CAST(trunc(((pos + 8 + 2) / (n + 8.0)::DOUBLE + (8 / 2.0) / (n + 8.0)::DOUBLE) * (n * 3200)) AS BIGINT) AS end_sample
        FROM frames JOIN sizes USING (track)""",
)
def f2(spark, sf):
    signal = stored_frames(spark, sf)
    start, end = scalar.frame_to_data(
        F.col("pos"), F.lit(8), F.col("n"), F.col("n") * 3200, 2
    )
    return signal.join(lengths(signal), "track").select(
        "track", "pos", start.alias("start_sample"), end.alias("end_sample")
    )


@query(
    "f3_centred_range",
    f"""WITH {FRAMES} SELECT track, pos,
          CAST(trunc(greatest((pos - 7 / 2.0) * ((n * 441) / n::DOUBLE), 0.0)) AS BIGINT) AS low,
          CAST(trunc((pos + 7 / 2.0) * ((n * 441) / n::DOUBLE)) AS BIGINT) AS high
        FROM frames JOIN sizes USING (track)""",
)
def f3(spark, sf):
    signal = stored_frames(spark, sf)
    low, high = scalar.centred_range(F.col("pos"), F.col("n") * 441, F.col("n"), F.lit(7))
    return signal.join(lengths(signal), "track").select(
        "track", "pos", low.alias("low"), high.alias("high")
    )


def _clock_sql(hours: int) -> str:
    part = "CASE WHEN p[{0}] = '' THEN 0 ELSE TRY_CAST(p[{0}] AS INTEGER) END"
    return f"""SELECT event_id, coalesce(CASE
          WHEN NOT regexp_matches(time, '^[0-9:]+$') THEN -1
          WHEN len(p) = 2 THEN ({part.format(1)}) * 60 + ({part.format(2)})
          WHEN len(p) = 3 THEN ({part.format(1)}) * {hours} + ({part.format(2)}) * 60 + ({part.format(3)})
        END, -1) AS seconds
        FROM (SELECT event_id, time, string_split(time, ':') AS p FROM (SELECT event_id, {_CLOCK} AS time FROM events))"""


@query("f5_clock_to_seconds", _clock_sql(1))
def f5(spark, sf):
    return clocks(spark, sf).select("event_id", scalar.seconds_of_clock(F.col("time")).alias("seconds"))


@query("f5_clock_hours_scaled", _clock_sql(3600))
def f5_hours(spark, sf):
    return clocks(spark, sf).select(
        "event_id", scalar.seconds_of_clock(F.col("time"), fix_hours=True).alias("seconds")
    )


@query(
    "f6_duration_seconds",
    "SELECT doc_id, CAST(format('{:.2f}', n_chars / 320.0) AS DOUBLE) AS seconds FROM documents",
)
def f6(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", scalar.duration_seconds(F.col("n_chars"), F.lit(320.0)).alias("seconds")
    )


@query("x1_sql_function", _clock_sql(1))
def x1(spark, sf):
    scalar.register(spark)
    return clocks(spark, sf).selectExpr("event_id", "seconds_of_clock(time) AS seconds")


@query(
    "x2_row_expression",
    """SELECT concat_ws('_', page_id, string_split(regexp_replace(url, '^https?://', ''), '/')[2], length(html)) AS row_id
       FROM pages""",
)
def x2(spark, sf):
    return table(spark, sf, "pages").select(
        F.concat_ws(
            "_",
            F.col("page_id").cast("string"),
            scalar.path_part(bare_url(), 1),
            F.length("html").cast("string"),
        ).alias("row_id")
    )
