"""Class encodings, score rankings, vector functions, metrics and prediction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.catalog.registry import query
from trackweave.catalog.samples import inside_sql, members_sql, outside_sql
from trackweave.catalog.sqltext import FRAMES, draw
from trackweave.functions import vectors
from trackweave.functions.project import linear_map
from trackweave.functions.tables import loud_runs
from trackweave.operators import labels, metrics, pairing, sampling
from trackweave.operators.numbering import with_each
from trackweave.plans import predict
from trackweave.sources.tracks import frames, table

NOISE = 63

# every vector taken as the scores of 64 classes
_SCORES = """scores AS (SELECT vec_id, label, CAST(unnest(range(64)) AS INTEGER) AS idx,
                        unnest(embedding::DOUBLE[]) AS score FROM embeddings),
  ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, idx DESC) AS INTEGER) AS "rank" FROM scores)"""


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


@query("w9_class_ranks", f'WITH {_SCORES} SELECT vec_id, "rank", idx, score FROM ranks')
def w9(spark, sf):
    return labels.class_ranks(vecs(spark, sf), "embedding", ["vec_id"])


@query(
    "w10_noise_rank_distribution",
    f'WITH {_SCORES} SELECT "rank", count(*) AS n FROM ranks WHERE idx = {NOISE} GROUP BY "rank"',
)
def w10(spark, sf):
    ranked = labels.class_ranks(vecs(spark, sf), "embedding", ["vec_id"])
    return ranked.where(F.col("idx") == NOISE).groupBy("rank").agg(F.count("*").alias("n"))


@query(
    "t3_top_label",
    f'WITH {_SCORES} SELECT vec_id, "rank", idx, score FROM ranks WHERE "rank" = 1 AND idx <> {NOISE}',
)
def t3(spark, sf):
    return labels.top_classes(vecs(spark, sf), "embedding", ["vec_id"], 1).where(F.col("idx") != NOISE)


@query(
    "t4_labels_above_noise",
    f"""WITH {_SCORES}, limits AS (SELECT vec_id, "rank" AS bar FROM ranks WHERE idx = {NOISE})
        SELECT vec_id, "rank", idx, score FROM ranks JOIN limits USING (vec_id) WHERE "rank" < bar""",
)
def t4(spark, sf):
    return labels.classes_above(vecs(spark, sf), "embedding", ["vec_id"], F.lit(NOISE))


@query("t6_top_three", f'WITH {_SCORES} SELECT vec_id, "rank", idx, score FROM ranks WHERE "rank" <= 3')
def t6(spark, sf):
    return labels.top_classes(vecs(spark, sf), "embedding", ["vec_id"], 3)


_KINDS = """classes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx FROM (
    SELECT DISTINCT event_type AS label FROM events UNION SELECT 'noise'))"""


def kinds(spark: SparkSession, sf: str) -> DataFrame:
    return labels.class_table(table(spark, sf, "events"), "event_type", ["noise"])


@query(
    "f7_label_encode",
    f"WITH {_KINDS} SELECT event_id, idx FROM events JOIN classes ON label = event_type",
)
def f7(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("label"))
    return events.join(kinds(spark, sf), "label").select("event_id", "idx")


@query(
    "f7_label_decode",
    f"WITH {_KINDS} SELECT vec_id, classes.label FROM embeddings JOIN classes ON idx = embeddings.label",
)
def f7_decode(spark, sf):
    coded = vecs(spark, sf).select("vec_id", F.col("label").alias("idx"))
    return coded.join(kinds(spark, sf), "idx").select("vec_id", "label")


@query(
    "f8_one_hot",
    """SELECT vec_id, dim, CAST(dim = label AS INTEGER) AS target FROM embeddings,
         (SELECT CAST(unnest(range(10)) AS INTEGER) AS dim)""",
)
def f8(spark, sf):
    hot = vectors.one_hot(F.col("label"), F.lit(10))
    return vecs(spark, sf).select("vec_id", F.posexplode(hot).alias("dim", "target"))


@query(
    "f9_multi_hot_to_labels",
    """SELECT doc_id, 'quality' AS label FROM labels WHERE quality <> 0
       UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic <> 0""",
)
def f9(spark, sf):
    marks = table(spark, sf, "labels")
    names = marks.select(F.explode(F.array(F.lit("toxic"), F.lit("quality"))).alias("label"))
    target = marks.select("doc_id", F.array("quality", "toxic").alias("target"))
    return labels.positive_labels(target, "target", ["doc_id"], labels.class_table(names))


@query(
    "f10_sigmoid",
    "SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS dim, round(1 / (1 + exp(-unnest(embedding::DOUBLE[]))), 9) AS p FROM embeddings",
)
def f10(spark, sf):
    return vecs(spark, sf).select(
        "vec_id", F.posexplode(vectors.sigmoid(F.col("embedding"))).alias("dim", "p")
    ).withColumn("p", F.round("p", 9))


_CENTRES = """flat AS (SELECT vec_id, label, unnest(range(64)) AS dim, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
  centres AS (SELECT label, dim, avg(v) AS mean FROM flat GROUP BY label, dim),
  dots AS (SELECT vec_id, f.label, c.label AS cls, round(sum(v * mean), 9) AS s
           FROM flat f JOIN centres c ON c.dim = f.dim GROUP BY 1, 2, 3)"""


def scored(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    """Inner products of every vector with the mean of every class."""
    rows = vecs(spark, sf)
    return predict.centroid_scores(rows, keys, "embedding", predict.centroids(rows, "label", "embedding"))


@query(
    "f15_feature_concat",
    f"""WITH {_CENTRES} SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(v, 9) AS value FROM flat
        UNION ALL SELECT vec_id, CAST(64 + cls AS INTEGER), s FROM dots""",
)
def f15(spark, sf):
    rows = vecs(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    both = rows.join(scored(spark, sf, ["vec_id"]), "vec_id").select(
        "vec_id", F.posexplode(F.concat("e", "scores")).alias("dim", "value")
    )
    return both.withColumn("value", F.round("value", 9))


@query(
    "f18_norms_and_distances",
    f"""WITH {_CENTRES} SELECT vec_id, round(sqrt(sum(v * v)), 9) AS norm,
          round(sqrt(sum((v - mean) * (v - mean))), 9) AS distance
        FROM flat f JOIN centres c ON c.dim = f.dim AND c.label = f.label GROUP BY vec_id""",
)
def f18(spark, sf):
    rows = vecs(spark, sf)
    centres = predict.centroids(rows, "label", "embedding")
    return rows.join(centres, "label").select(
        "vec_id",
        F.round(vectors.norm(F.col("embedding")), 9).alias("norm"),
        F.round(vectors.distance(F.col("embedding"), F.col("centroid")), 9).alias("distance"),
    )


@query(
    "a16_mean_vector",
    f"WITH {_CENTRES} SELECT label, CAST(dim AS INTEGER) AS dim, round(mean, 9) AS mean FROM centres",
)
def a16(spark, sf):
    return metrics.mean_vector(vecs(spark, sf), ["label"], "embedding").withColumn("mean", F.round("mean", 9))


_BEST = f"""{_CENTRES}, best AS (SELECT vec_id, label, cls FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls DESC) AS r FROM dots) WHERE r = 1)"""


def best_class(spark: SparkSession, sf: str) -> DataFrame:
    """``(vec_id, label, cls)``: true and best scored class."""
    top = labels.top_classes(scored(spark, sf, ["vec_id", "label"]), "scores", ["vec_id", "label"], 1)
    return top.select("vec_id", "label", F.col("idx").alias("cls"))


_TEN = "(SELECT CAST(unnest(range(10)) AS INTEGER) AS bird)"


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """One row per vector and class with truth and prediction."""
    best = best_class(spark, sf)
    classes = best.select(F.col("label").alias("bird")).distinct()
    return with_each(best, classes).select(
        "bird", (F.col("label") == F.col("bird")).alias("label"), (F.col("cls") == F.col("bird")).alias("target")
    )


_GRADED = f"""{_BEST}, graded AS (SELECT bird, label = bird AS truth, cls = bird AS target FROM best, {_TEN}),
  counts AS (SELECT bird, count(*) FILTER (truth AND target) AS tp, count(*) FILTER (NOT truth AND target) AS fp,
                    count(*) FILTER (truth AND NOT target) AS fn FROM graded GROUP BY bird),
  rated AS (SELECT *, CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS "precision",
                   CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS recall,
                   CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM counts)"""


@query(
    "a13_class_scores",
    f"""WITH {_GRADED} SELECT bird, tp, fp, fn, round("precision", 9) AS "precision", round(recall, 9) AS recall,
        round(f1, 9) AS f1 FROM rated""",
)
def a13(spark, sf):
    got = metrics.class_scores(graded(spark, sf), "bird", F.col("label"), F.col("target"))
    return got.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("a13_macro_f1", f"WITH {_GRADED} SELECT round(avg(f1), 9) AS macro_f1 FROM rated")
def a13_macro(spark, sf):
    got = metrics.class_scores(graded(spark, sf), "bird", F.col("label"), F.col("target"))
    return got.agg(F.round(F.avg("f1"), 9).alias("macro_f1"))


@query(
    "a14_roc_auc",
    """WITH s AS (SELECT n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id)),
       r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s)
       SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
                    / (sum(y) * sum(1 - y))::DOUBLE, 9) AS auc FROM r""",
)
def a14(spark, sf):
    scores = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score"))
    rows = scores.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    got = metrics.roc_auc(rows, "score", "y", F.expr("score div 64"))
    return got.withColumn("auc", F.round("auc", 9))


@query(
    "a15_accuracy",
    f"""WITH {_BEST}, folds AS (SELECT {draw(91, 'vec_id')} % 5 AS fold, avg(CAST(label = cls AS INTEGER)) AS score
          FROM best GROUP BY 1)
        SELECT count(*) AS n, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS std FROM folds""",
)
def a15(spark, sf):
    rows = sampling.folds(best_class(spark, sf), 5, 91, ["vec_id"])
    per_fold = rows.groupBy("fold").agg(F.avg((F.col("label") == F.col("cls")).cast("int")).alias("score"))
    return per_fold.agg(
        F.count("*").alias("n"),
        F.round(F.avg("score"), 9).alias("mean"),
        F.round(F.stddev_samp("score"), 9).alias("std"),
    )


_VECS = "known AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query(
    "a18_triplet_loss",
    f"""WITH {_VECS}, {members_sql(92, "vec_id", "known", "label")},
        picks AS (SELECT vec_id, e, {inside_sql(92, "'near'", 'vec_id')} AS pn, {outside_sql(92, "'far'", 'vec_id')} AS pf FROM members),
        norms AS (SELECT list_distance(p.e, n.e) AS ln, list_distance(p.e, f.e) AS ld,
            sqrt(list_dot_product(p.e, p.e)) + sqrt(list_dot_product(n.e, n.e)) + sqrt(list_dot_product(f.e, f.e)) AS penalty
          FROM picks p JOIN members n ON n.member = pn JOIN members f ON f.member = pf)
        SELECT round(avg(greatest(ln - ld + 0.5, 0) + 0.01::DOUBLE * penalty), 9) AS loss, round(avg(ln), 9) AS near,
               round(avg(ld), 9) AS far, round(avg(ln - ld), 9) AS gap FROM norms""",
)
def a18(spark, sf):
    members = pairing.numbered_members(vecs(spark, sf), "label", 92, ["vec_id"])
    picks = members.select(
        F.col("embedding").alias("a"),
        pairing.inside_member(92, F.lit("near"), "vec_id").alias("pn"),
        pairing.outside_member(92, F.lit("far"), "vec_id").alias("pf"),
    )
    near = members.select(F.col("member").alias("pn"), F.col("embedding").alias("n"))
    far = members.select(F.col("member").alias("pf"), F.col("embedding").alias("d"))
    rows = picks.join(near, "pn").join(far, "pf")
    got = metrics.triplet_loss(rows, F.col("a"), F.col("n"), F.col("d"), margin=0.5)
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns])


@query(
    "a18_cross_entropy",
    f"""WITH {_SCORES} SELECT round(avg(CASE WHEN idx = label THEN -greatest(ln(p), -100) ELSE -greatest(ln(1 - p), -100) END), 9) AS loss
        FROM (SELECT idx, label, 1 / (1 + exp(-score)) AS p FROM scores)""",
)
def a18_bce(spark, sf):
    rows = vecs(spark, sf).select("label", F.posexplode(vectors.sigmoid(F.col("embedding"))).alias("idx", "p"))
    y = (F.col("idx") == F.col("label")).cast("double")
    return rows.agg(F.round(F.avg(metrics.cross_entropy(F.col("p"), y)), 9).alias("loss"))


WEIGHTS = np.cos(np.outer(np.arange(1, 65), np.arange(1, 9)))


@query(
    "l1_batched_inference",
    """SELECT vec_id, CAST(k AS INTEGER) AS dim, round(sum(v * cos((d + 1) * (k + 1))), 6) AS z
       FROM (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
            (SELECT unnest(range(8)) AS k) GROUP BY vec_id, k""",
)
def l1(spark, sf):
    got = linear_map(vecs(spark, sf), ["vec_id"], "embedding", WEIGHTS)
    return got.select("vec_id", F.posexplode("z").alias("dim", "z")).withColumn("z", F.round("z", 6))


_PLACES = """places AS (SELECT vec_id, vec_id // 10 AS file_id, (vec_id % 10 + 1) * 5 AS end_time FROM embeddings)"""
_NAMES = """names AS (SELECT label, 'c' || label AS bird FROM (SELECT DISTINCT label FROM embeddings))"""


def placed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as ten windows per file, labelled with their end."""
    return vecs(spark, sf).select(
        F.expr("vec_id div 10").alias("file_id"),
        ((F.col("vec_id") % 10 + 1) * 5).alias("end_time"),
        "embedding",
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("truth"),
    )


@query(
    "l10_predict",
    f"""WITH {_BEST}, {_PLACES}, {_NAMES}
        SELECT concat_ws('_', file_id, n.bird, end_time) AS row_id,
               coalesce(b.cls = n.label AND n.bird <> 'c0', false) AS target
        FROM places p JOIN best b ON b.vec_id = p.vec_id CROSS JOIN names n""",
)
def l10(spark, sf):
    """Score windows by class means, name the best class, drop ``c0``, fill the grid."""
    windows = placed_vectors(spark, sf)
    classes = labels.class_table(windows, "truth")
    centres = predict.centroids(windows, "truth", "embedding")
    scores = predict.centroid_scores(windows, ["file_id", "end_time"], "embedding", centres)
    named = predict.predicted_rows(scores, classes, "top")
    grid = predict.evaluation_grid(windows.select("file_id", "end_time"), classes)
    return predict.submission(grid, named, "c0")


@query(
    "l10_predict_above_noise",
    f"""WITH {_CENTRES}, {_PLACES}, {_NAMES},
        bars AS (SELECT vec_id, s AS bar FROM dots WHERE cls = 0)
        SELECT concat_ws('_', file_id, n.bird, end_time) AS row_id, (s > bar AND n.bird <> 'c0') AS target
        FROM places p JOIN dots d ON d.vec_id = p.vec_id JOIN bars b ON b.vec_id = p.vec_id
        JOIN names n ON n.label = d.cls""",
)
def l10_above(spark, sf):
    windows = placed_vectors(spark, sf)
    classes = labels.class_table(windows, "truth")
    centres = predict.centroids(windows, "truth", "embedding")
    scores = predict.centroid_scores(windows, ["file_id", "end_time"], "embedding", centres)
    named = predict.predicted_rows(scores, classes, "top-not-noise", "c0")
    grid = predict.evaluation_grid(windows.select("file_id", "end_time"), classes)
    return predict.submission(grid, named, "c0")


@query(
    "l11_average_class_scores",
    f"""WITH {_SCORES} SELECT label, idx AS dim, round(avg(1 / (1 + exp(-score))), 9) AS predicted,
          CAST(idx = label AS INTEGER)::DOUBLE AS actual FROM scores GROUP BY label, idx""",
)
def l11(spark, sf):
    rows = vecs(spark, sf).select("label", vectors.sigmoid(F.col("embedding")).alias("p"))
    means = metrics.mean_vector(rows, ["label"], "p")
    return means.select(
        "label",
        "dim",
        F.round("mean", 9).alias("predicted"),
        (F.col("dim") == F.col("label")).cast("double").alias("actual"),
    )


@query(
    "l11_own_score_histogram",
    f"""WITH {_SCORES} SELECT label, CAST(least(floor(1 / (1 + exp(-score)) * 50), 49) AS BIGINT) AS bin, count(*) AS n
        FROM scores WHERE idx = label GROUP BY 1, 2""",
)
def l11_histogram(spark, sf):
    own = F.get(vectors.sigmoid(F.col("embedding")), F.col("label"))
    rows = vecs(spark, sf).select("label", own.alias("p"))
    at = F.least(F.floor(F.col("p") * 50), F.lit(49)).alias("bin")
    return rows.groupBy("label", at).agg(F.count("*").alias("n"))


@query(
    "l21_evaluation_grid",
    """WITH c AS (SELECT DISTINCT event_type AS bird FROM events),
       w AS (SELECT user_id AS file_id, (event_id % 4) * 5 AS end_time, max(event_type) AS truth FROM events GROUP BY 1, 2)
       SELECT file_id, end_time, bird, concat_ws('_', file_id, bird, end_time) AS row_id, bird = truth AS label
       FROM w CROSS JOIN c WHERE end_time <> 0""",
)
def l21(spark, sf):
    events = table(spark, sf, "events")
    windows = events.groupBy(
        F.col("user_id").alias("file_id"), ((F.col("event_id") % 4) * 5).alias("end_time")
    ).agg(F.max("event_type").alias("truth"))
    classes = labels.class_table(events, "event_type")
    return predict.evaluation_grid(windows, classes, "truth").select(
        "file_id", "end_time", "bird", "row_id", "label"
    )


# functions given by the user


@query(
    "x3_parallel_function",
    "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n_breaks FROM documents",
)
def x3(spark, sf):
    def per_item(parts):
        for part in parts:
            yield pd.DataFrame({"doc_id": part.doc_id, "n_breaks": part.text.str.count("\n").astype("int64")})

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.mapInPandas(per_item, "doc_id bigint, n_breaks bigint")


@query(
    "x4_generator",
    """SELECT doc_id, CAST(w AS BIGINT) AS win, CAST(w * 500 AS BIGINT) AS start
       FROM (SELECT doc_id, unnest(range(n_chars // 500)) AS w FROM documents)""",
)
def x4(spark, sf):
    count = F.expr("n_chars div 500")
    windows = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.explode(windows).alias("win"))
        .withColumn("start", F.col("win") * 500)
    )


@query(
    "x4_table_function",
    """SELECT doc_id, CAST(w AS BIGINT) AS win, CAST(w * 500 AS BIGINT) AS start
       FROM (SELECT doc_id, unnest(range(n_chars // 500)) AS w FROM documents)""",
)
def x4_udtf(spark, sf):
    @F.udtf(returnType="win bigint, start bigint")
    class WindowsOf:
        def eval(self, n: int, width: int):
            for win in range(n // width):
                yield win, win * width

    spark.udtf.register("windows_of", WindowsOf)
    table(spark, sf, "documents").select("doc_id", "n_chars").createOrReplaceTempView("_lengths")
    return spark.sql("SELECT doc_id, w.* FROM _lengths, LATERAL windows_of(n_chars, 500) w")


@query(
    "x4_table_argument",
    f"""WITH {FRAMES},
        marks AS (SELECT track, pos, value, CASE WHEN value >= 80 THEN 1 WHEN value < 40 THEN 0 END AS m FROM frames),
        states AS (SELECT track, pos, value, coalesce(last_value(m IGNORE NULLS) OVER (
            PARTITION BY track ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS s FROM marks),
        runs AS (SELECT *, pos - row_number() OVER (PARTITION BY track, s ORDER BY pos) AS run FROM states)
        SELECT track, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n, max(value) AS peak
        FROM runs WHERE s = 1 GROUP BY track, run""",
)
def x4_table(spark, sf):
    """Runs above two levels, found by a function that is given each track as an ordered table."""
    spark.udtf.register("loud_runs", loud_runs(80.0, 40.0))
    frames(spark, sf).select("track", "pos", "value").createOrReplaceTempView("_frames")
    return spark.sql("SELECT * FROM loud_runs(TABLE(_frames) PARTITION BY track ORDER BY pos)")
