"""Motif extraction: from frames to track records, fragments and triplets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trackweave.functions.scalar import duration_seconds, frame_to_data
from trackweave.operators.numbering import number_rows
from trackweave.operators.pairing import triplets
from trackweave.operators.profile import matrix_profile, motifs, top_positions
from trackweave.operators.windows import cut, fragments
from trackweave.session import cut_lineage

# Fixed values of the default pipeline: frames per second, frames per profile window
FRAME_RATE = 10
PROFILE_WINDOW = 50


def track_records(
    lengths: DataFrame, profile: DataFrame, m: int, frame_rate: int = FRAME_RATE
) -> DataFrame:
    """One row per track: durations, motif and discord places.

    Tracks too short for one window keep their row, with null places.
    """
    return lengths.join(motifs(profile), "track", "left").select(
        "track",
        F.lit(m).cast("bigint").alias("window"),
        F.col("n").alias("n_frames"),
        duration_seconds(F.col("n"), frame_rate).alias("duration_seconds"),
        "motif_0",
        "motif_1",
        "discord_0",
        "discord_1",
    )


def extract(frames: DataFrame, m: int = PROFILE_WINDOW, value: str = "value") -> DataFrame:
    """Frames to track records in one plan."""
    sizes = frames.groupBy("track").agg((F.max("pos") + 1).alias("n"))
    return track_records(sizes, matrix_profile(frames, m, value), m)


def stored_profile(frames: DataFrame, m: int = PROFILE_WINDOW, value: str = "value") -> DataFrame:
    """The profiles written once, for plans that read them several times."""
    return cut_lineage(matrix_profile(frames, m, value))


def consolidate(records: DataFrame, profile: DataFrame, part: int = 65_536) -> DataFrame:
    """Records with their profiles as arrays, empty where there is none.

    Profiles longer than ``part`` come in several rows per track, numbered in
    ``part``.
    """
    ordered = F.array_sort(F.collect_list(F.struct("i", "mp", "pi")))
    arrays = (
        profile.withColumn("part", F.expr(f"i div {part}"))
        .groupBy("track", "part")
        .agg(ordered.alias("_p"))
        .select(
            "track",
            "part",
            F.transform("_p", lambda x: x["mp"]).alias("mp"),
            F.transform("_p", lambda x: x["pi"].cast("int")).alias("pi"),
        )
    )
    return (
        records.join(arrays, "track", "left")
        .withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
        .withColumn("mp", F.coalesce("mp", F.array().cast("array<double>")))
        .withColumn("pi", F.coalesce("pi", F.array().cast("array<int>")))
    )


def top_places(records: DataFrame, profile: DataFrame, n_motif: int = 3, n_discord: int = 1) -> DataFrame:
    """``(track, idx, start)``: places to cut, -1 where a track has no profile.

    ``start`` is in frames of the signal.
    """
    found = records.join(top_positions(profile, n_motif, n_discord), "track", "left")
    index = F.coalesce("idx", F.lit(-1).cast("bigint"))
    start, _ = frame_to_data(index, F.col("window"), F.col("n_frames"), F.col("n_frames"))
    return found.select(
        "track", index.alias("idx"), F.when(index >= 0, start).otherwise(0).alias("start")
    )


def place_fragments(
    records: DataFrame, chunks: DataFrame, lengths: DataFrame, chunk_size: int, place: str, width: int
) -> DataFrame:
    """``(track, start, off, value)``: samples after the converted ``place``.

    Tracks without the place are left out. Rows are ordered by
    ``track, off`` when put together.
    """
    start, _ = frame_to_data(
        F.col(place), F.col("window"), F.col("n_frames"), F.col("n_frames")
    )
    spans = (
        records.where(F.col(place).isNotNull())
        .join(lengths, "track")
        .select("track", start.alias("start"), "n")
        .select("track", "start", F.least(F.lit(width), F.col("n") - F.col("start")).alias("taken"))
        .where("taken > 0")
    )
    return cut(chunks, chunk_size, spans.withColumn("at", F.col("start")), ["track", "at"]).select(
        "track", F.col("at").alias("start"), F.posexplode("x").alias("off", "value")
    )


PLACES = ("motif_0", "motif_1", "discord_0", "discord_1")


def motif_tracks(
    records: DataFrame, chunks: DataFrame, lengths: DataFrame, chunk_size: int, width: int, places: Sequence[str] = PLACES
) -> DataFrame:
    """``(place, pos, track, off, value)``: the samples after a place of every track, one track after the other.

    ``pos`` counts the samples of a place's joined signal, in the order of tracks. A track without the
    place gives its beginning. Positions are numbered in buckets of tracks, so a joined
    signal of any length is never ordered as a whole.
    """

    def span(place: str):
        start, _ = frame_to_data(F.col(place), F.col("window"), F.col("n_frames"), F.col("n_frames"))
        return F.struct(F.lit(place).alias("place"), F.coalesce(start, F.lit(0).cast("bigint")).alias("start"))

    each = records.select("track", "window", "n_frames", F.explode(F.array(*[span(p) for p in places])).alias("_s"))
    spans = (
        each.select("track", "_s.*")
        .join(lengths, "track")
        .select("place", "track", "start", F.least(F.lit(width), F.col("n") - F.col("start")).alias("taken"))
        .where("taken > 0")
    )
    rows = cut(chunks, chunk_size, spans, ["place", "track"]).select("place", "track", F.posexplode("x").alias("off", "value"))
    return number_rows(rows, ["place"], ["track", "off"], F.expr("track div 1024"), "pos")


def primary_fragments(
    records: DataFrame, chunks: DataFrame, lengths: DataFrame, chunk_size: int, width: int,
    raw_units: bool = False,
) -> DataFrame:
    """``(track, offset, x)``: the fragment at the first motif of every track.

    The place is 0 without motif. ``raw_units`` takes the frame index as it is
    instead of converting it to the signal's time base.
    """
    start, _ = frame_to_data(
        F.col("motif_0"), F.col("window"), F.col("n_frames"), F.col("n_frames")
    )
    at = F.col("motif_0") if raw_units else start
    wanted = records.select("track", F.coalesce(at, F.lit(0).cast("bigint")).alias("offset"))
    return fragments(chunks, lengths, chunk_size, wanted, width)


def triplet_table(
    records: DataFrame,
    taxonomy: DataFrame,
    n_samples: int,
    seed,
    window_sec: float = 7,
    raw_units: bool = False,
) -> DataFrame:
    """Sampled triplets over the families of the tracks, places in seconds.

    ``raw_units`` leaves motif places in frames.
    """

    def seconds(place: str):
        start, _ = frame_to_data(
            F.col(place), F.col("window"), F.col("n_frames"), F.col("duration_seconds")
        )
        return F.col(place) if raw_units else start

    known = records.join(taxonomy.select("track", "family"), "track", "left").select(
        "track",
        "family",
        seconds("motif_0").alias("motif_0"),
        seconds("motif_1").alias("motif_1"),
        "duration_seconds",
    )
    return triplets(known, n_samples, seed, "family", window_sec)


def triplet_requests(table: DataFrame, per_second: int = 1) -> DataFrame:
    """``(track, offset)``: each distinct place named by a triplet once."""
    sides = F.explode(
        F.array(*[F.struct(F.col(s).alias("track"), F.col(f"{s}_loc").alias("loc")) for s in "abc"])
    )
    return (
        table.select(sides.alias("_s"))
        .select("_s.track", (F.col("_s.loc").cast("bigint") * per_second).alias("offset"))
        .distinct()
    )
