"""URL filter: rules first, then a character language-model ratio.

Two variable-order Markov models are counted over all urls that a rule accepts
or rejects: contexts of up to ``ORDER`` characters, each order smoothed by the
next lower one in proportion to the number of different followers
(Witten-Bell).  A url without a rule gets the mean per character of
log P(accepted) - log P(rejected), compared with a threshold calibrated on
labelled texts held out of the counts.

Built-in functions only.  Equal urls are counted once with their number, so a
url that a third of all rows have is one row; n-grams that make up more than
1/1000 of all (at most 1000 of them) are looked up by broadcast, the others by
a shuffle.

Rows: a null url, or one without ``://``, has an empty host and path and is
judged by the models like any other; repeated rows get the same verdict.  With
``whole`` the scheme, the query, the fragment and urls without ``://`` are read too.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import spread_join, written

ORDER = 4
HELD = 5
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def whole_url(url: Column) -> Column:
    """The url with its host part in lower case; one without ``://`` as it is, null as empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    split = F.concat(F.regexp_extract(url, r"(?s)^(.*?://)", 1), host_of(url), rest)
    return F.coalesce(F.when(F.instr(url, "://") > 0, split).otherwise(url), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = []
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        found.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def grams_of(texts: DataFrame, order: int) -> DataFrame:
    """The columns and gram: each character, and an end mark, after its ``order`` characters of context."""
    padded = F.concat(F.lit("\x02" * order), "text", F.lit("\x03"))
    n = F.char_length("text") + 1
    return texts.withColumn("padded", padded).select(
        *texts.columns, F.explode(F.sequence(F.lit(1), n)).alias("at"), "padded").select(
        *texts.columns, F.substring(F.col("padded"), F.col("at"), F.lit(order + 1)).alias("gram"))


def model(grams: DataFrame, order: int) -> DataFrame:
    """gram, its weight in all texts, and the log ratio of its last character under both models.

    ``grams`` has gram, good, bad, all (weights).
    """
    levels = [grams]
    for _ in range(order):
        shorter = levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram"))
        levels.append(shorter.agg(*[F.sum(c).alias(c) for c in ("good", "bad", "all")]))
    levels = [written(x) for x in reversed(levels)]
    below = None
    for k, level in enumerate(levels):
        context = F.expr(f"substring(gram, 1, {k})").alias("context")
        per = level.groupBy(context).agg(
            *[F.sum(c).alias(f"n_{c}") for c in ("good", "bad")], *[F.sum((F.col(c) > 0).cast("int")).alias(f"t_{c}") for c in ("good", "bad")])
        now = level.withColumn("context", context).join(per, "context")
        if below is None:
            now = now.withColumns({"low_good": F.lit(1 / 256), "low_bad": F.lit(1 / 256)})
        else:
            now = now.withColumn("shorter", F.expr("substring(gram, 2)")).join(
                below.select(F.col("gram").alias("shorter"), F.col("p_good").alias("low_good"), F.col("p_bad").alias("low_bad")), "shorter")
        for c in ("good", "bad"):
            n, t = F.col(f"n_{c}"), F.col(f"t_{c}")
            now = now.withColumn(f"p_{c}", F.when(n > 0, (F.col(c) + t * F.col(f"low_{c}")) / (n + t)).otherwise(F.col(f"low_{c}")))
        below = written(now.select("gram", "all", "p_good", "p_bad"))
    return below.select("gram", "all", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def scored(grams: DataFrame, ratios: DataFrame) -> DataFrame:
    """id and the mean log ratio per character of its grams."""
    total = ratios.agg(F.sum("all")).first()[0] or 0
    hot = ratios.filter(F.col("all") * 1000 > total).select("gram", F.col("ratio").alias("hot"))
    met = grams.join(F.broadcast(hot), "gram", "left")
    rest = met.filter("hot is null").select("id", "gram").join(ratios.select("gram", "ratio"), "gram")
    parts = met.filter("hot is not null").select("id", F.col("hot").alias("ratio")).unionByName(rest.select("id", "ratio"))
    return parts.groupBy("id").agg((F.sum("ratio") / F.count("*")).alias("score"))


def threshold(scores: DataFrame) -> float:
    """Where the held-out scores of both classes are as many standard deviations away; 0 without both classes."""
    s = scores.filter("held and label is not null").groupBy("label").agg(F.mean("score").alias("m"), F.stddev_pop("score").alias("d")).collect()
    by = {r["label"]: (r["m"], r["d"] + 1e-6) for r in s}
    if len(by) < 2:
        return 0.0
    (good, spread_good), (bad, spread_bad) = by["allow"], by["block"]
    return (good * spread_bad + bad * spread_good) / (spread_good + spread_bad)


def judged(pages: DataFrame, url_column: str = "url", rules=RULES, order: int = ORDER, whole: bool = False) -> DataFrame:
    """All columns of ``pages`` under ``page`` (a struct), host, path, rule, score, verdict.

    The models read host and path, with ``whole`` every character of the url.
    """
    url = pages[url_column]
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns if c != "html"]).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"),
                        *[whole_url(url).alias("whole")] * whole)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdicts = dict(rules)
    label = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in verdicts.items()], F.lit(None).cast("string"))
    rows = rows.withColumn("rule", rule).withColumn("label", label).withColumn("text", F.col("whole") if whole else F.concat("host", "path"))
    texts = written(rows.groupBy("text").agg(F.first("label").alias("label"), F.count("*").alias("n")).withColumn(
        "held", F.pmod(F.crc32("text"), F.lit(HELD)) == 0).withColumn("id", F.monotonically_increasing_id()))
    counted = texts.withColumns({
        "good": F.when((F.col("label") == "allow") & ~F.col("held"), F.col("n")).otherwise(0),
        "bad": F.when((F.col("label") == "block") & ~F.col("held"), F.col("n")).otherwise(0)})
    grams = grams_of(counted, order)
    counts = grams.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("n").alias("all"))
    scores = written(scored(grams_of(texts.select("id", "text"), order).select("id", "gram"), model(counts, order)).join(texts, "id"))
    least = threshold(scores)
    out = spread_join(rows, scores.select("text", "score"), "text", F.xxhash64("page"))
    guess = F.when(F.col("score") >= least, "allow").otherwise("block")
    return out.select("page", "host", "path", "rule", "score", F.coalesce("label", guess).alias("verdict"))
