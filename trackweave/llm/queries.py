"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.llm import (
    filter_audit,
    mixing,
    page_text,
    pieces,
    quality,
    shingle_join,
    suffix_tree,
    token_counts,
    toxicity,
    url_rules,
    vector_codes,
    vector_join,
    winnowing,
)
from trackweave.session import cut_lineage
from trackweave.sources.tracks import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS draw
  FROM documents),
s AS (
  SELECT source, source_size, rk, (CASE rk % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w,
         sum(source_size) OVER () AS budget
  FROM (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
        FROM d GROUP BY source)),
l AS (SELECT *, 3 * source_size / w AS lim FROM s),
f AS (
  SELECT *, (budget - coalesce(sum(3 * source_size) OVER (ORDER BY lim, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY lim, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM l),
v AS (
  SELECT *, coalesce(first_value(lev) OVER (ORDER BY CASE WHEN lev <= lim THEN lim END NULLS LAST, rk), max(lim) OVER ()) AS level
  FROM f),
p AS (SELECT *, least(w * level, CAST(3 * source_size AS DOUBLE)) AS target FROM v),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.rk, p.w, p.budget, d.draw,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size
                           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM (SELECT doc_id, source, size, draw FROM d) d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT row_number() OVER () AS uid, * FROM c),
e AS (SELECT r.*, t.e, (t.e * source_size + cum) / w AS finish FROM r, (SELECT unnest([0, 1, 2]) AS e) t),
g AS (
  SELECT uid, size, budget, sum(size) OVER (ORDER BY finish, rk, e RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM (SELECT *, row_number() OVER (ORDER BY finish, rk, e) AS place FROM e)),
k AS (SELECT uid, sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS taken FROM g GROUP BY uid)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(taken AS BIGINT) AS taken
FROM r JOIN k USING (uid)
"""


@query("op1_mix_sources")
def op1(spark, sf):
    docs = table(spark, sf, "documents")
    return mixing.taken(mixing.clock(docs, weights=(5, 2, 1), repeats=3, share=1.0))


@query("op2_shingle_join")
def op2(spark, sf):
    return shingle_join.near_classes(table(spark, sf, "documents"))


@query("op3_winnowing_fingerprints")
def op3(spark, sf):
    return winnowing.compared(table(spark, sf, "documents"))


@query("op4_suffix_tree_scores")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", suffix_tree.held_out(F.col("doc_id"), 10, 0))
    tree, counts = suffix_tree.train(docs.where("NOT held_out"))
    return suffix_tree.scored(docs, tree, counts)


@query("op5_toxicity_chain")
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf, "labels"))
    rows = toxicity.scored(docs, chain).drop("text")
    found = [F.col(f"_t_{c}").alias(f"p_{c}") for c in chain.categories]
    return rows.select("doc_id", *found, (F.col("_t_toxic") >= toxicity.REJECT).alias("toxic"))


@query("op6_quality_rules")
def op6(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = suffix_tree.held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(docs, table(spark, sf, "labels").where(~held_out))
    rows = quality.scored(docs, model).withColumn("held_out", held_out)
    return rows.select(
        "doc_id",
        "held_out",
        F.col("_q_score").alias("score"),
        (F.col("_q_score") >= quality.ACCEPT).cast("int").alias("predicted"),
    )


@query("op7_sentencepiece_round_trip")
def op7(spark, sf):
    return pieces.round_trips(table(spark, sf, "documents"))


@query("op8_token_counts")
def op8(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


@query("op9_url_verdicts")
def op9(spark, sf):
    return url_rules.verdicts(table(spark, sf, "pages"), URL_RULES)


@query("op10_near_vectors")
def op10(spark, sf):
    return vector_join.near_vectors(table(spark, sf, "embeddings"), cosine=0.95, recall=0.995)


@query("op11_filter_audit")
def op11(spark, sf):
    rows = cut_lineage(filter_audit.described(table(spark, sf, "documents"), F.col("lang")))
    return filter_audit.orders(filter_audit.survivors(filter_audit.failed(rows, table(spark, sf, "labels"))))


AUDIT_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
f AS (
  SELECT doc_id, part,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT f.*, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
           || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails
  FROM f LEFT JOIN l USING (doc_id)),
n AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
  FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
  WHERE length(replace(replace(replace(replace(replace(
    'ABCDE', p.x, ''), q.x, ''), r.x, ''), s.x, ''), t.x, '')) = 0),
k AS (
  SELECT part, filter_order, step, filter_order[step] AS own, n, good, toxic, fails,
         contains(fails, filter_order[step]) AS hit,
         translate(fails, filter_order[:step - 1], '') = fails AS whole
  FROM n, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN whole AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN whole AND hit THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN NOT whole AND hit THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN whole AND hit THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN whole AND hit THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM g
"""

@query("op12_page_text")
def op12(spark, sf):
    return page_text.extracted(table(spark, sf, "pages"))


@query("op13_vector_codes")
def op13(spark, sf):
    return vector_codes.codes(table(spark, sf, "embeddings"))


def codes_sql(rounds: int = 4, positions: int = 4, entries: int = 256) -> str:
    """Rounds of assignment and update, one after the other."""

    def assigned(book: str) -> str:
        return f"""
  SELECT rn, pos, min(f).e AS e, min(f).d AS d
  FROM (SELECT p.rn, p.pos, {{'d': CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.c)
                                      + list_inner_product(c.c, c.c) AS BIGINT), 'e': c.e}} AS f
        FROM p JOIN {book} c ON p.pos = c.pos)
  GROUP BY rn, pos"""

    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({assigned(f'c{r}')})")
        steps.append(f"""u{r} AS (
  SELECT pos, e, list(m ORDER BY i) AS c
  FROM (SELECT pos, e, i, floor(sum(y) / count(*)) AS m
        FROM (SELECT a.pos, a.e, unnest(p.x) AS y, generate_subscripts(p.x, 1) AS i
              FROM a{r} a JOIN p ON a.rn = p.rn AND a.pos = p.pos)
        GROUP BY pos, e, i)
  GROUP BY pos, e)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.pos, c.e, coalesce(u.c, c.c) AS c FROM c{r} c LEFT JOIN u{r} u USING (pos, e))")
    return f"""
WITH n AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS rn
  FROM embeddings WHERE len(embedding) > 0),
x AS (SELECT rn, CAST(unnest(embedding) AS DOUBLE) AS y, generate_subscripts(embedding, 1) AS i FROM n),
w AS (SELECT rn, list(floor(1024 * y) ORDER BY i) AS v FROM x GROUP BY rn HAVING bool_and(coalesce(isfinite(y), false))),
v AS (SELECT row_number() OVER (ORDER BY rn) - 1 AS place, rn, v, len(v) // {positions} AS k FROM w),
p AS MATERIALIZED (
  SELECT rn, pos, place, v[pos * k + 1 : pos * k + k] AS x
  FROM v, (SELECT unnest(range({positions})) AS pos)),
c0 AS MATERIALIZED (SELECT pos, place AS e, x AS c FROM p WHERE place < {entries}),
{", ".join(steps)},
f AS ({assigned(f"c{rounds}")}),
r AS (
  SELECT rn, string_agg(lower(printf('%02x', e)), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM f GROUP BY rn),
b AS (
  SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY pos, e, i)) AS codebooks_sha256
  FROM (SELECT pos, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM c{rounds}))
SELECT n.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY n.label) AS BIGINT) AS label_error, b.codebooks_sha256
FROM r JOIN n USING (rn), b
"""


ORACLE["op1_mix_sources"] = MIX_SQL
ORACLE["op11_filter_audit"] = AUDIT_SQL
ORACLE["op13_vector_codes"] = codes_sql()
