"""URL filter: host and path rules first, then a ratio of two character language models.

Both models are variable-order Markov models over the characters of host and path,
one of accepted and one of rejected URLs. They are smoothed by Witten-Bell
interpolation from the longest known context down to a uniform distribution. A URL is
scored by the mean over its characters of log p(accepted) - log p(rejected), and the
threshold is set on labelled URLs that the counts have not seen. Everything is a
DataFrame expression.

Null and odd input: a null URL or one without `://` has an empty host and path, fits no
rule and gets `allow` without a score. Repeated rows and repeated ids all stay. Without
labelled URLs of both kinds every score is null and the method allows. Other columns of
the input are carried, whatever their names. Where a label has no URL outside the held-back share,
its model is uniform.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm._spark import checkpoint, small, unused

# Verdict, host, start of the path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

ORDER = 3
#: Letters, digits, `/ . _ % -`, `~` for all others, and the marks of start and end.
SYMBOLS = 26 + 10 + 5 + 1 + 2
START, END = "<", ">"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: First hexadecimal digits of md5(url) that are set aside to find the threshold.
HELD_BACK = ("0", "1", "2")
#: Rows of four characters up to which the table of scores is broadcast: 12 MB or so.
BROADCAST_ROWS = 300_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], part: int | None = None) -> Column:
    """The longest rule that fits, as host and path joined, or its verdict where `part` is 0; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        found = F.when(fits, F.lit(rule[1] + rule[2] if part is None else rule[part])).otherwise(found)
    return found


def grams(text: Column, order: int = ORDER) -> Column:
    """Each character with the `order` characters before it."""
    folded = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^a-z0-9/._%\-]", "~")
    marked = F.concat(F.lit(START * order), folded, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(marked) - order), lambda i: F.substr(marked, i, F.lit(order + 1)))


def ratios(wanted: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """log p(accepted) - log p(rejected) of the last character of each gram in `wanted`, given those before it.

    `counts` has `gram`, `a` and `r`. Both tables are bounded by SYMBOLS ** (order + 1) rows.
    """
    counts = counts.select("gram", "a", "r")
    single = counts.groupBy(F.substring("gram", order + 1, 1).alias("c")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).collect()
    spark = wanted.sparkSession
    total = {k: sum(row[k] for row in single) for k in "ar"}
    kinds = {k: sum(row[k] > 0 for row in single) for k in "ar"}
    p = lambda k, n: (n + kinds[k] / SYMBOLS) / (total[k] + kinds[k]) if total[k] else 1 / SYMBOLS
    base = {k: p(k, 0) for k in "ar"}
    rows = [(row["c"], *(p(k, row[k]) for k in "ar")) for row in single]
    local = spark.createDataFrame(rows, "c string, pa double, pr double")
    out = wanted.select("gram", F.substring("gram", order + 1, 1).alias("c")).join(F.broadcast(local), "c", "left")
    out = out.select("gram", F.coalesce("pa", F.lit(base["a"])).alias("pa"), F.coalesce("pr", F.lit(base["r"])).alias("pr"))
    for k in range(1, order + 1):
        own = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("key")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        context = own.groupBy(F.substring("key", 1, k).alias("context")).agg(
            F.sum("na").alias("ta"), F.sum("nr").alias("tr"), F.count_if(F.col("na") > 0).alias("da"), F.count_if(F.col("nr") > 0).alias("dr")
        )
        out = out.withColumns({"key": F.substring("gram", order + 1 - k, k + 1), "context": F.substring("gram", order + 1 - k, k)})
        out = out.join(own, "key", "left").join(context, "context", "left").select(
            "gram",
            *[
                F.when(F.col(f"t{x}") > 0, (F.coalesce(f"n{x}", F.lit(0)) + F.col(f"d{x}") * F.col(f"p{x}")) / (F.col(f"t{x}") + F.col(f"d{x}")))
                .otherwise(F.col(f"p{x}"))
                .alias(f"p{x}")
                for x in "ar"
            ],
        )
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def score_urls(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """`url` and `score` of the distinct `url` of `urls`, whose `label` is 1 (accepted), 0 (rejected) or null.

    Only labelled URLs outside the held-back share are counted; those are not scored.
    """
    held = F.substring(F.md5("url"), 1, 1).isin(*HELD_BACK)
    host_path = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    learned = urls.filter(F.col("label").isNotNull() & ~held)
    counts = checkpoint(
        learned.select("label", F.explode(grams(host_path, order)).alias("gram"))
        .groupBy("gram")
        .agg(F.sum(F.col("label").cast("long")).alias("a"), F.sum(1 - F.col("label").cast("long")).alias("r"))
    )
    spots = urls.filter(F.col("label").isNull() | held).select("url", F.explode(grams(host_path, order)).alias("gram"))
    table = small(checkpoint(ratios(spots.select("gram").distinct(), counts, order)), BROADCAST_ROWS)
    return spots.join(table, "gram").groupBy("url").agg(F.round(F.avg("ratio"), 6).alias("score"))


def threshold_of(scored: DataFrame) -> float | None:
    """The score, in hundredths from -10 to 10, that best separates `label` 1 from 0 by balanced accuracy."""
    bins = scored.filter(F.col("label").isNotNull()).groupBy(F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * 100))).alias("bin"))
    rows = sorted(bins.agg(F.sum(F.col("label").cast("long")).alias("a"), F.sum(1 - F.col("label").cast("long")).alias("r")).collect())
    good, bad = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    if not good or not bad:
        return None
    best, at, below_a, below_r = -math.inf, 0.0, 0, 0
    for x in rows:
        value = (good - below_a) / good + below_r / bad
        if value > best + 1e-12:
            best, at = value, x["bin"] / 100
        below_a, below_r = below_a + x["a"], below_r + x["r"]
    return at


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", order: int = ORDER) -> DataFrame:
    """`pages` with host, path, rule, score and verdict, which replace columns of these names; see the module's text."""
    added = ("host", "path", "rule", "score", "verdict")
    ruled, own = unused(pages.withColumns(dict.fromkeys(added, F.lit(0))), "ruled", "own_url")
    out = pages.withColumn(own, F.col(url)).drop(*[c for c in added if c != url]).withColumns({"host": host_of(F.col(own)), "path": path_of(F.col(own))})
    out = out.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), ruled: rule_of(F.col("host"), F.col("path"), rules, 0)})
    urls = checkpoint(
        out.filter(F.col(own).isNotNull() & (F.concat("host", "path") != ""))
        .groupBy(F.col(own).alias("url"))
        .agg(F.max(F.when(F.col(ruled) == "allow", 1).when(F.col(ruled) == "block", 0)).alias("label"))
    )
    labels = {x["label"] for x in urls.select("label").distinct().collect()}
    if not {0, 1} <= labels:
        out = out.withColumn("score", F.lit(None).cast("double"))
        return out.withColumn("verdict", F.coalesce(ruled, F.lit("allow"))).drop(ruled, own)
    scored = checkpoint(score_urls(urls, order))
    limit = threshold_of(scored.join(urls.filter(F.col("label").isNotNull()), "url"))
    found = out.join(scored.select(F.col("url").alias(own), "score"), own, "left")
    judged = F.when(F.col("score") < F.lit(limit), "block").otherwise("allow")
    return found.withColumn("verdict", F.coalesce(ruled, judged)).drop(ruled, own)
