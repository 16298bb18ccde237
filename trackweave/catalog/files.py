"""Sources and sinks: tables written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.catalog.registry import query
from trackweave.catalog.relational import bare_url, records, scored_names
from trackweave.catalog.sqltext import FRAMES, profile
from trackweave.plans import motif
from trackweave.session import work_path
from trackweave.sources import files
from trackweave.sources.tracks import frames, lengths, stored_frames, table

_BARE = "regexp_replace(url, '^https?://', '')"


@query(
    "s1_file_listing",
    "SELECT DISTINCT source AS label, true AS has_files FROM documents",
)
def s1(spark, sf):
    path = work_path(spark, "listing")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.col("source").alias("label"))
    files.write_by_label(docs, path)
    found = files.list_files(spark, path, "*.parquet")
    return found.groupBy("label").agg((F.sum("length") > 0).alias("has_files"))


@query("s2_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s2(spark, sf):
    path = work_path(spark, "csv")
    files.write_csv(table(spark, sf, "nation"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("s3_parquet", "SELECT vec_id, label, embedding[1]::DOUBLE AS first, len(embedding) AS dims FROM embeddings")
def s3(spark, sf):
    path = work_path(spark, "parquet")
    table(spark, sf, "embeddings").write.parquet(path)
    return spark.read.parquet(path).select(
        "vec_id",
        "label",
        F.get("embedding", F.lit(0)).cast("double").alias("first"),
        F.size("embedding").cast("bigint").alias("dims"),
    )


_META = "track bigint, n_frames bigint, duration_seconds double"


@query(
    "s4_json_documents",
    f"WITH {FRAMES} SELECT track, n AS n_frames, CAST(format('{{:.2f}}', n / 10.0) AS DOUBLE) AS duration_seconds FROM sizes",
)
def s4(spark, sf):
    from trackweave.functions.scalar import duration_seconds

    path = work_path(spark, "metadata")
    sizes = lengths(frames(spark, sf)).select(
        "track", F.col("n").alias("n_frames"), duration_seconds(F.col("n"), 10).alias("duration_seconds")
    )
    files.write_json_documents(sizes, path)
    return files.read_json_documents(spark, path, _META)


@query(
    "s5_name_list",
    "SELECT n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
def s5(spark, sf):
    path = work_path(spark, "names")
    names = scored_names(spark, sf).agg(F.to_json(F.array_sort(F.collect_list("label"))).alias("value"))
    names.coalesce(1).write.text(path)
    return files.read_name_list(spark, path)


@query(
    "s6_consolidate",
    f"""WITH {FRAMES}, {profile(60)},
        lists AS (SELECT track, i // 8 AS part, count(*) AS c, string_agg(CAST(pi AS VARCHAR), ',' ORDER BY i) AS pi_text,
                         round(sum(mp), 6) AS mp_sum FROM all_profile GROUP BY 1, 2)
        SELECT r.track, coalesce(part, 0) AS part, n_frames, motif_0, coalesce(c, 0) AS mp_len,
               coalesce(pi_text, '') AS pi_text, coalesce(mp_sum, 0.0) AS mp_sum
        FROM records r LEFT JOIN lists USING (track)""".replace(
        "lists AS", """all_profile AS (
          SELECT s.track, CAST(k AS BIGINT) AS i, coalesce(p.pi, -1) AS pi, p.mp
          FROM (SELECT track, unnest(range(n - 59)) AS k FROM sizes WHERE n >= 60) s
          LEFT JOIN profile p ON p.track = s.track AND p.i = k),
        lists AS""", 1),
)
def s6(spark, sf):
    signal = stored_frames(spark, sf)
    mp = motif.stored_profile(signal, 60)
    whole = motif.consolidate(motif.track_records(lengths(signal), mp, 60), mp, part=8)
    finite = F.filter("mp", lambda v: v < float("inf"))
    return whole.select(
        "track",
        "part",
        "n_frames",
        "motif_0",
        F.size("mp").cast("bigint").alias("mp_len"),
        F.array_join(F.col("pi").cast("array<string>"), ",").alias("pi_text"),
        F.round(F.aggregate(finite, F.lit(0.0), lambda s, v: s + v), 6).alias("mp_sum"),
    )


@query(
    "s7_csv_sink",
    "SELECT concat_ws('_', doc_id, source) AS row_id, quality = 1 AS target FROM documents JOIN labels USING (doc_id)",
)
def s7(spark, sf):
    path = work_path(spark, "submission")
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    key = F.concat_ws("_", F.col("doc_id").cast("string"), "source")
    files.write_csv(
        rows.withColumns({"row_id": key, "target": F.col("quality") == 1}), path, ["row_id", "target"]
    )
    return files.read_csv(spark, path, "row_id string, target boolean")


@query(
    "s8_task_documents",
    """SELECT '{"data":{"audio":"' || url || '","audio_id":' || page_id || ',"species":"'
        || string_split(regexp_replace(url, '^https?://', ''), '/')[2] || '","score":' || length(html) || '}}' AS task
       FROM pages""",
)
def s8(spark, sf):
    path = work_path(spark, "tasks")
    pages = table(spark, sf, "pages").select(
        F.col("url").alias("audio"),
        F.col("page_id").alias("audio_id"),
        F.get(F.split(bare_url(), "/"), F.lit(1)).alias("species"),
        F.length("html").alias("score"),
    )
    files.task_documents(pages, ["audio", "audio_id", "species", "score"]).write.json(path)
    return spark.read.text(path).select(F.col("value").alias("task"))


@query("s9_path_list", f"SELECT 'data/raw/' || {_BARE} AS value FROM pages")
def s9(spark, sf):
    path = work_path(spark, "paths")
    files.prefixed_paths(table(spark, sf, "pages"), bare_url(), "data/raw").write.text(path)
    return spark.read.text(path)


@query(
    "s10_sink_by_label",
    "SELECT event_type AS label, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type",
)
def s10(spark, sf):
    path = work_path(spark, "by-label")
    rows = table(spark, sf, "events").select("event_id", "value", F.col("event_type").alias("label"))
    files.write_by_label(rows, path)
    return (
        spark.read.parquet(path)
        .groupBy("label")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    )


@query("s11_skip_existing", "SELECT doc_id, n_chars, count(*) AS copies FROM documents GROUP BY 1, 2")
def s11(spark, sf):
    """A first run makes the table of the labelled documents, two more only add the rest."""
    path = work_path(spark, "outputs")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    files.append_missing(docs.join(table(spark, sf, "labels"), "doc_id", "left_semi"), path, ["doc_id"])
    files.append_missing(docs, path, ["doc_id"])
    files.append_missing(docs, path, ["doc_id"])
    return spark.read.parquet(path).groupBy("doc_id", "n_chars").agg(F.count("*").alias("copies"))


@query(
    "s12_run_record",
    """SELECT 64::BIGINT AS embedding_dim, 10::BIGINT AS cens_sr, 8::BIGINT AS mp_window, true AS dated,
         count(DISTINCT user_id) AS n_tracks FROM events""",
)
def s12(spark, sf):
    """Outputs with their record: parameters and creation time."""
    path = work_path(spark, "run")
    found = records(spark, sf)
    found.write.parquet(f"{path}/records")
    files.write_run_record(spark, f"{path}/metadata", embedding_dim=64, cens_sr=10, mp_window=8)
    record = spark.read.json(f"{path}/metadata")
    n = spark.read.parquet(f"{path}/records").agg(F.count("*")).scalar()
    dated = F.col("created").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T")
    return record.withColumns({"dated": dated, "n_tracks": n}).drop("created")
