"""Fixed-length windows and fragments of long signals.

Signals are chunked tables ``(track, chunk, values)``. A window or fragment is
put together from the few chunks it touches, grouped by its own key, so neither
long tracks nor often used ones gather in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

PADDINGS = ("center", "right", "right-align")


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)).cast("int"))


def window_plan(n: Column, width: int, step: int, padding: str) -> dict[str, Column]:
    """Padded length, left padding and number of windows for a length ``n``.

    The length is brought up to a multiple of the step.
    """
    rest = F.pmod(n, F.lit(step))
    extra = F.when(rest > 0, step - rest).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    if padding == "right-align":
        tail = F.least(n, F.lit(step))
        padded = F.when(rest > 0, n - rest + tail).otherwise(n)
        left = none
    else:
        padded = n + extra
        left = F.floor(extra / 2) if padding == "center" else none
    count = F.when(padded >= width, F.floor((padded - width) / step) + 1).otherwise(none)
    return {"padded": padded, "left": left, "n_win": count, "rest": rest}


def slice_windows(
    chunks: DataFrame,
    lengths: DataFrame,
    chunk_size: int,
    width: int,
    context: int = 0,
    step: int | None = None,
    padding: str = "center",
) -> DataFrame:
    """``(track, win_idx, start_pos, x)``: windows of ``width + context`` samples.

    ``step`` defaults to the whole window. ``center`` and ``right`` fill up with
    zeros; ``right-align`` takes the last step again from the right end.
    ``start_pos`` counts in the padded signal. Short signals may give no window.
    """
    if padding not in PADDINGS:
        raise ValueError(f"padding must be one of {PADDINGS}")
    full = width + context
    step = full if step is None else step
    plan = window_plan(F.col("n"), full, step, padding)
    src = chunks.join(lengths, "track").select(
        "track",
        "n",
        (F.col("chunk") * chunk_size).alias("src"),
        "values",
        plan["left"].cast("bigint").alias("left"),
        plan["n_win"].cast("bigint").alias("n_win"),
        plan["rest"].alias("rest"),
    ).where("n_win > 0")
    if padding == "right-align":
        # head: whole steps as they are; tail: the last step, put after the head
        base = F.col("n") - F.col("rest")
        tail_from = F.col("n") - F.least(F.col("n"), F.lit(step))
        head = F.struct(F.lit(0).cast("bigint").alias("lo"), base.alias("hi"), F.lit(0).cast("bigint").alias("move"))
        tail = F.struct(tail_from.alias("lo"), F.col("n").alias("hi"), (base - tail_from).alias("move"))
        parts = F.when(F.col("rest") > 0, F.array(head, tail)).otherwise(F.array(head))
        src = (
            src.withColumn("_p", F.explode(parts))
            .withColumn("_lo", F.greatest("src", "_p.lo"))
            .withColumn("_hi", F.least(F.col("src") + F.size("values"), F.col("_p.hi")))
            .where("_hi > _lo")
            .withColumn("vals", F.slice("values", (F.col("_lo") - F.col("src") + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int")))
            .withColumn("at", F.col("_lo") + F.col("_p.move"))
        )
    else:
        src = src.withColumn("vals", F.col("values")).withColumn("at", F.col("src") + F.col("left"))
    end = F.col("at") + F.size("vals")
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("at") - full + 1) / step))
    last = F.least(F.col("n_win") - 1, F.floor((end - 1) / step))
    touched = src.select("track", "at", "vals", first.alias("w0"), last.alias("w1")).where("w1 >= w0")
    pieces = touched.withColumn("win_idx", F.explode(F.sequence("w0", "w1")))
    start = F.col("win_idx") * step
    lo = F.greatest("at", start)
    hi = F.least(F.col("at") + F.size("vals"), start + full)
    pieces = pieces.select(
        "track", "win_idx", lo.alias("lo"), hi.alias("hi"), "at", "vals"
    ).where("hi > lo").select(
        "track",
        "win_idx",
        F.struct(
            "lo",
            F.slice("vals", (F.col("lo") - F.col("at") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("vals"),
        ).alias("piece"),
    )
    if padding == "center" and step > 2 * full:
        # the zeros on the left may hold the whole first window, which no sample touches
        empty = F.struct(F.lit(0).cast("bigint").alias("lo"), F.array().cast(chunks.schema["values"].dataType).alias("vals"))
        blank = lengths.select("track", plan["left"].alias("left"), plan["n_win"].alias("n_win")).where((F.col("n_win") > 0) & (F.col("left") >= full))
        pieces = pieces.unionByName(blank.select("track", F.lit(0).cast("bigint").alias("win_idx"), empty.alias("piece")))
    if padding == "right" and step == full and chunk_size % full == 0:
        # every window lies in one chunk: nothing to put together, no shuffle
        joined = pieces.select("track", "win_idx", F.array("piece").alias("p"))
    else:
        joined = pieces.groupBy("track", "win_idx").agg(
            F.array_sort(F.collect_list("piece")).alias("p")
        )
    body = F.flatten(F.transform("p", lambda q: q["vals"]))
    lead = zeros(F.col("p")[0]["lo"] - F.col("start_pos"))
    return (
        joined.withColumn("start_pos", F.col("win_idx") * step)
        .withColumn("_x", F.concat(lead, body))
        .select(
            "track",
            "win_idx",
            "start_pos",
            F.concat("_x", zeros(F.lit(full) - F.size("_x"))).alias("x"),
        )
    )


def fragment_span(n: Column, offset: Column, length: int) -> dict[str, Column]:
    """Where a padded fragment of ``length`` samples lies in a signal of ``n``.

    ``start`` is relative to the signal and may be negative; ``taken`` is how
    many samples exist there once half a fragment of zeros is put on both sides.
    """
    pad = (length + 1) // 2
    padded = n + 2 * pad
    at = (
        F.when(n < length, F.floor(padded / 2) - pad)
        .when(offset <= 0, pad + F.greatest(offset, F.lit(-pad)))
        .when(offset + length >= padded, padded - length)
        .otherwise(offset + pad)
        .cast("bigint")
    )
    return {"start": at - pad, "taken": F.least(F.lit(length), padded - at).cast("bigint")}


def cut(
    chunks: DataFrame,
    chunk_size: int,
    spans: DataFrame,
    keys: Sequence[str],
) -> DataFrame:
    """``(keys, x)``: the samples ``start .. start + taken`` of every span.

    ``spans`` has ``track, start, taken`` and the unique ``keys``; positions
    outside the signal are zeros.
    """
    names = list(dict.fromkeys([*keys, "track"]))
    first = F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("start") / chunk_size))
    last = F.floor((F.col("start") + F.col("taken") - 1) / chunk_size)
    wanted = spans.withColumn("chunk", F.explode(F.when(last >= first, F.sequence(first, last))))
    src = F.col("chunk") * chunk_size
    lo = F.greatest(src, "start")
    hi = F.least(src + F.size("values"), F.col("start") + F.col("taken"))
    some = F.slice("values", (lo - src + 1).cast("int"), (hi - lo).cast("int"))
    # an inner join: few spans go to the chunks, and only the cut pieces move
    pieces = (
        chunks.join(wanted, ["track", "chunk"])
        .where(hi > lo)
        .select(*names, F.struct(lo.alias("lo"), some.alias("vals")).alias("piece"))
        .groupBy(*names)
        .agg(F.array_sort(F.collect_list("piece")).alias("p"))
    )
    body = F.coalesce(
        F.flatten(F.transform("p", lambda q: q["vals"])), F.array().cast("array<double>")
    )
    lead = F.coalesce(F.get("p", F.lit(0))["lo"] - F.col("start"), F.lit(0))
    # spans quite outside the signal have no piece
    return (
        spans.select(*names, "start", "taken")
        .join(pieces, names, "left")
        .withColumn("_x", F.concat(zeros(lead), body))
        .select(*names, F.concat("_x", zeros(F.col("taken") - F.size("_x"))).alias("x"))
    )


def fragments(
    chunks: DataFrame,
    lengths: DataFrame,
    chunk_size: int,
    requests: DataFrame,
    length: int,
    offset: str = "offset",
    keys: Sequence[str] = ("track", "offset"),
) -> DataFrame:
    """``(keys, x)``: a fragment of exactly ``length`` samples per request.

    Half a fragment of zeros surrounds the signal, a signal shorter than the
    fragment is centred, and a fragment running past the padded end starts over
    from its own beginning.
    """
    span = fragment_span(F.col("n"), F.col(offset), length)
    spans = requests.join(lengths, "track").select(
        *list(dict.fromkeys([*keys, "track"])),
        span["start"].alias("start"),
        span["taken"].alias("taken"),
    )
    got = cut(chunks, chunk_size, spans, keys)
    times = F.ceil(F.lit(length) / F.size("x")).cast("int")
    return got.withColumn("x", F.slice(F.flatten(F.array_repeat("x", times)), 1, length))
