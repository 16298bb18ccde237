"""Column functions for time bases, paths, keys and durations."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F


def hop_length(sample_rate: Column | int, per_second: Column | int) -> Column:
    """Samples per frame, as a multiple of 64, for about ``per_second`` frames."""
    sr = sample_rate if isinstance(sample_rate, Column) else F.lit(sample_rate)
    target = per_second if isinstance(per_second, Column) else F.lit(per_second)
    return (F.floor(sr / (target * 64)) * 64).cast("bigint")


def frame_to_data(
    index: Column, window: Column, n_frames: Column, n_data: Column, extra: Column | int = 0
) -> tuple[Column, Column]:
    """Start and end of a profile window on the time base of ``n_data``.

    The same fraction of the track is taken, shifted by half a window; with
    ``n_data`` in samples the result is in samples, in seconds in seconds.
    """
    whole = n_frames + window
    half = (window / 2) / whole
    start = (index / whole + half) * n_data
    end = ((index + window + extra) / whole + half) * n_data
    return start.cast("bigint"), end.cast("bigint")


def centred_range(index: Column, n_data: Column, n_frames: Column, window: Column) -> tuple[Column, Column]:
    """Data range of a window centred on a frame, not below 0."""
    rate = n_data / n_frames
    low = (index - window / 2) * rate
    return F.greatest(low, F.lit(0.0)).cast("bigint"), ((index + window / 2) * rate).cast("bigint")


def path_part(path: Column, index: int) -> Column:
    """Segment ``index`` of a path, counted from 0; null when missing."""
    return F.get(F.split(path, "/"), F.lit(index))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(file_name(path), ".", 1)


def last_parts(path: Column, n: int = 3) -> Column:
    """The last ``n`` path segments joined again; all of a shorter path."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.slice(parts, -F.least(F.lit(n), F.size(parts)), F.lit(n)))


def seconds_of_clock(text: Column, fix_hours: bool = False) -> Column:
    """Seconds of ``m:s`` or ``h:m:s`` text, -1 when it is no such text.

    An empty part counts as 0. The hour counts as it stands; ``fix_hours``
    scales it to seconds.
    """
    parts = F.split(text, ":")

    def number(i: int) -> Column:
        part = F.get(parts, F.lit(i))
        return F.when(part == "", 0).otherwise(part.try_cast("int"))

    hours = number(0) * (3600 if fix_hours else 1)
    value = (
        F.when(F.size(parts) == 2, number(0) * 60 + number(1))
        .when(F.size(parts) == 3, hours + number(1) * 60 + number(2))
    )
    usable = text.isNotNull() & (F.length(text) > 0) & text.rlike("^[0-9:]+$")
    return F.coalesce(F.when(usable, value), F.lit(-1)).cast("int")


def register(spark: SparkSession) -> None:
    """Make the clock function callable from SQL as a temporary function."""
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION clock_part(t STRING, i INT) RETURNS INT
        RETURN if(get(split(t, ':'), i) = '', 0, try_cast(get(split(t, ':'), i) AS INT))
        """
    )
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION seconds_of_clock(t STRING) RETURNS INT
        RETURN coalesce(
          CASE WHEN NOT t RLIKE '^[0-9:]+$' THEN -1
               WHEN size(split(t, ':')) = 2 THEN clock_part(t, 0) * 60 + clock_part(t, 1)
               WHEN size(split(t, ':')) = 3
               THEN clock_part(t, 0) + clock_part(t, 1) * 60 + clock_part(t, 2) END, -1)
        """
    )


def round_cents(x: Column) -> Column:
    """A non-negative double to two places, halves of the exact value to even.

    ``x`` is split in two parts whose multiples by 200 are exact, so that values
    just beside a half are not taken for one.
    """
    cents = F.floor(x * 100)
    high = x.cast("float").cast("double")
    beyond = (high * 200 - (2 * cents + 1)) + (x - high) * 200
    up = F.when(beyond > 0, 1).when(beyond < 0, 0).otherwise(F.pmod(cents, F.lit(2)))
    return (cents + up) / F.lit(100.0)


def duration_seconds(n: Column, sample_rate: Column | int) -> Column:
    """Length in seconds to two places."""
    return round_cents(n / sample_rate)
