"""SQL fragments shared by the checks."""

FRAMES = """frames AS (
  SELECT user_id AS track,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         value, event_type AS kind
  FROM events),
sizes AS (SELECT track, count(*) AS n FROM frames GROUP BY track)"""

TAXONOMY = """taxonomy AS (
  SELECT c_custkey AS track, n_name AS species, r_name AS family
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""


def profile(m: int, source: str = "frames") -> str:
    """CTEs ending in ``profile(track, i, mp, pi)``."""
    return f"""lagged AS (
  SELECT a.track, a.pos AS i, b.pos AS j, (a.value - b.value) * (a.value - b.value) AS e
  FROM {source} a JOIN {source} b ON a.track = b.track AND b.pos > a.pos + {m // 2}),
diagonal AS (
  SELECT track, i, j, sum(e) OVER w AS d2, count(*) OVER w AS c FROM lagged
  WINDOW w AS (PARTITION BY track, j - i ORDER BY i ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)),
bothways AS (
  SELECT track, i, j, d2 FROM diagonal WHERE c = {m}
  UNION ALL SELECT track, j, i, d2 FROM diagonal WHERE c = {m}),
profile AS (
  SELECT track, i, sqrt(d2) AS mp, j AS pi FROM (
    SELECT *, row_number() OVER (PARTITION BY track, i ORDER BY d2, j) AS r FROM bothways)
  WHERE r = 1),
motifs AS (
  SELECT track,
    max(CASE WHEN lo = 1 THEN i END) AS motif_0, max(CASE WHEN lo = 1 THEN pi END) AS motif_1,
    max(CASE WHEN hi = 1 THEN i END) AS discord_0, max(CASE WHEN hi = 1 THEN pi END) AS discord_1
  FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY mp, i) AS lo,
                  row_number() OVER (PARTITION BY track ORDER BY mp DESC, i) AS hi FROM profile)
  GROUP BY track),
records AS (
  SELECT track, CAST({m} AS BIGINT) AS "window", n AS n_frames, round_even(n / 10.0, 2) AS duration_seconds,
         motif_0, motif_1, discord_0, discord_1
  FROM sizes LEFT JOIN motifs USING (track))"""


def digest(seed, *keys: str) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5(concat_ws('|', '{seed}', {parts}))"


def draw(seed, *keys: str) -> str:
    return f"CAST('0x' || substr({digest(seed, *keys)}, 1, 13) AS BIGINT)"


def uniform(seed, *keys: str) -> str:
    return f"({draw(seed, *keys)} / 4503599627370496.0::DOUBLE)"


def shuffled(seed, keys: list[str], groups: list[str] | None = None) -> str:
    """A zero-based number in shuffled order."""
    part = f"PARTITION BY {', '.join(groups)} " if groups else ""
    return f"row_number() OVER ({part}ORDER BY {digest(seed, *keys)}, {', '.join(keys)}) - 1"
