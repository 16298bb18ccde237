"""URL verdicts from given rules and from association rules mined with FP-growth.

A given rule names a host and a path: it fits that host and all below it where the URL's
path starts with the rule's; the longest rule wins. URLs that a given rule judges are the
labelled rows. FP-growth mines combinations of their tokens (host labels, path segments,
file suffix, query keys) that go with a verdict; rules below the support or confidence
are pruned. The others are judged by the mined rules: an inverted index from each rule's
rarest token gives the rules a URL may fit, those whose tokens it all has are kept, and
the rule of highest confidence, then support, decides. Without any, ``default`` holds.

URLs are matched by the set of their indexed tokens, of which there are few, so pages are
joined with one small table and no page is multiplied.

Defined cases: a null URL or one without ``://`` has empty host and path, no tokens and
the default verdict; without labelled rows nothing is mined; repeated rows are judged
alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from trackweave.session import cut_lineage

Rule = tuple[str, str, str]  # host, path, verdict
_MARK = "verdict="


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, ascii_uppercase, ascii_lowercase)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Tokens of a URL: ``h:`` host labels, ``p:`` path segments, ``e:`` suffix, ``q:`` query keys."""
    marked = lambda mark, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    segments = F.split(path(url), "/")
    suffix = F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    there = F.coalesce(url, F.lit("")).contains("://")
    every = F.concat(
        marked("h:", F.split(host(url), r"\.")), marked("p:", segments), marked("e:", F.array(suffix)), marked("q:", keys)
    )
    return F.when(there, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def fits(rule: Rule, at: Column, below: Column) -> Column:
    name, start, _ = rule
    return ((at == name) | at.endswith("." + name)) & below.startswith(start)


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(page_id, url, host, path, rule, given)`` with the longest fitting rule and its verdict."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule = given = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # longer ones later, so they win
        hit = fits(r, F.col("host"), F.col("path"))
        rule = F.when(hit, F.lit(r[0] + r[1])).otherwise(rule)
        given = F.when(hit, F.lit(r[2])).otherwise(given)
    return rows.withColumn("rule", rule).withColumn("given", given)


def mine(labelled: DataFrame, min_support: float, min_confidence: float, most_tokens: int) -> DataFrame:
    """``(rule_id, tokens, verdict, confidence, support)`` out of ``(tokens, verdict)`` rows."""
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_MARK), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(
        F.col("consequent")[0].startswith(_MARK)
        & (F.size("antecedent") <= most_tokens)
        & ~F.exists("antecedent", lambda t: t.startswith(_MARK))
    )
    verdict = F.substring(F.col("consequent")[0], F.lit(len(_MARK) + 1), F.lit(1 << 20))
    return cut_lineage(
        found.select(
            F.array_join(F.array_sort("antecedent"), " ").alias("rule_id"),
            F.array_sort("antecedent").alias("tokens"),
            verdict.alias("verdict"),
            "confidence",
            "support",
        )
    )


def matched(signatures: DataFrame, rules: DataFrame) -> DataFrame:
    """``(signature, mined)``: the verdict of the best rule whose tokens a signature holds."""
    each = rules.select("rule_id", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    first = each.join(often, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    index = rules.join(first, "rule_id").select("token", "tokens", "verdict", "confidence", "support", "rule_id")
    hits = signatures.select("signature", F.explode("signature").alias("token")).join(index, "token")
    hits = hits.where(F.size(F.array_except("tokens", "signature")) == 0)
    best = F.max(F.struct("confidence", "support", (-F.size("tokens")).alias("short"), "rule_id", "verdict"))
    return hits.groupBy("signature").agg(best["verdict"].alias("mined"))


def verdicts(
    pages: DataFrame,
    rules: Sequence[Rule],
    min_support: float = 0.005,
    min_confidence: float = 0.9,
    most_tokens: int = 3,
    default: str = "allow",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page.

    Mined rules have at most ``most_tokens`` tokens; longer ones are left out, even of higher confidence.
    At most (mean tokens per URL) / ``min_support`` tokens reach the support, which bounds
    the list of indexed tokens.
    """
    rows = judged(pages, rules).withColumn("tokens", tokens(F.col("url")))
    labelled = rows.where("given IS NOT NULL").select("tokens", F.col("given").alias("verdict"))
    if labelled.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit(default)).alias("verdict"))
    found = mine(labelled, min_support, min_confidence, most_tokens)
    indexed = sorted(r[0] for r in found.select(F.explode("tokens")).distinct().collect())
    known = F.array(*[F.lit(t) for t in indexed]) if indexed else F.array().cast("array<string>")
    rows = rows.withColumn("signature", F.array_sort(F.array_intersect("tokens", known)))
    open_rows = rows.where("given IS NULL").select("signature").distinct()
    best = matched(open_rows, found)
    return rows.join(best, "signature", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit(default)).alias("verdict")
    )
