"""URL filter by a character language-model ratio.

Rules decide the urls they fit. The urls that rules allow and those that they block train one smoothed
variable-order Markov model each; every other url is judged by the difference of its two log-likelihoods per
character, calibrated on rule-decided urls that were kept out of the models.

The models are tables, not objects: a url is cut into its windows of ``order + 1`` characters, the distinct
windows are counted once, and the counts of shorter contexts are sums of theirs. Witten-Bell smoothing goes from
the shortest context up, one join a level. Nothing of it reaches the driver but histograms of a fixed size. All
sums over rows are sums of integers, so no verdict depends on their order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import split_join

# Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
# One unit of a window's score is a millionth of a natural logarithm.
UNIT = 1_000_000
# The calibration histogram: BINS classes over [-SPAN, SPAN) natural logarithms per character.
BINS, SPAN = 4096, 8.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _windows(order: int) -> Column:
    """Windows of ``order + 1`` characters of a url without its scheme, one per character and one for the end."""
    after = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    body = F.translate(F.when(F.instr("url", "://") > 0, after).otherwise(F.col("url")), UPPER, LOWER)
    line = F.concat(F.lit(START * order), body, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(line) - order), lambda i: F.substring(line, i, F.lit(order + 1)))


def _smoothed(grams: DataFrame, order: int) -> DataFrame:
    """``gram, pa, pr``: each window's last character given those before it, in the accepted and the rejected model.

    Witten-Bell: of a context seen n times with t different followers, P = (count + t P_shorter) / (n + t). A
    context that a model has not seen takes the shorter one's, so each place has an order of its own. Below
    all contexts every character of the table, and one unknown, is as likely as the others.
    """
    level = None
    for k in range(order + 1):
        tail = F.expr(f"right(gram, {k + 1})")
        counts = grams.groupBy(tail.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        # A context has at most as many rows as there are characters.
        same = Window.partitionBy(F.expr(f"left(g, {k})"))
        counts = counts.select(
            "g", "a", "r", *[F.sum(c).over(same).alias("n" + c) for c in "ar"], *[F.sum((F.col(c) > 0).cast("long")).over(same).alias("t" + c) for c in "ar"],
            F.count(F.lit(1)).over(same).alias("v"),
        )
        if level is None:
            joined = counts.withColumns({"pa": 1.0 / (F.col("v") + 1), "pr": 1.0 / (F.col("v") + 1)})
        else:
            joined = counts.withColumn("short", F.expr(f"right(g, {k})")).join(level, "short")
        p = lambda c: F.when(F.col("n" + c) == 0, F.col("p" + c)).otherwise((F.col(c) + F.col("t" + c) * F.col("p" + c)) / (F.col("n" + c) + F.col("t" + c)))
        level = joined.select(F.col("g").alias("short"), p("a").alias("pa"), p("r").alias("pr"))
    return level.withColumnRenamed("short", "gram")


def calibrate(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(accept) = sigmoid(slope x score + intercept), by Newton steps on a histogram with
    the usual pseudo-counts of such a fit. The slope is not negative: a ratio that tells nothing gets slope 0."""
    n, p = bad.sum(), good.sum()
    up, down = (p + 1) / (p + 2), 1 / (n + 2)
    w, t = good + bad, good * up + bad * down
    use = w > 0
    x, w, t = scores[use], w[use], t[use]
    a, b = 0.0, float(np.log((p + 1) / (n + 1)))
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g = np.array([((t - w * q) * x).sum(), (t - w * q).sum()])
        v = w * np.maximum(q * (1 - q), 1e-12)
        h = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        if size > 10:
            step *= 10 / size
        a, b = a + step[0], b + step[1]
        if size < 1e-10:
            break
    return (float(a), float(b)) if a > 0 else (0.0, float(np.log((p + 1) / (n + 1))))


def judge(pages: DataFrame, order: int = 5, held: int = 5, level: float = 0.5, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    ``verdict`` is that of the longest fitting rule, else ``allow`` where the calibrated probability of an
    accepted url is at least ``level``, else ``block``. ``score`` is the difference of log-likelihoods per
    character, null where a rule decides. One of ``held`` parts of the rule-decided urls, by hash, calibrates and
    stays out of the models.

    A null url, or one without ``://``, has an empty host and path and no rule; a null or empty url is scored as
    the empty string, one without ``://`` as a whole. Equal urls count once in the models and get one verdict.
    Where no url is allowed, or none is blocked, by the rules of the training part, there is nothing to compare:
    every url without a rule is allowed and has score 0. An empty table gives no rows. Only page_id and url are read.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", url.alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    # Copies are counted before anything is cut into windows; n tells how often a url stands in the table.
    urls = cut(
        rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"host": host, "path": path}).withColumn("decided", decided)
        .select("url", "n", "decided", (F.pmod(F.xxhash64("url"), F.lit(held)) == 0).alias("held"))
    )
    places = urls.select("url", "decided", "held", F.explode(_windows(order)).alias("gram"))
    trains = F.col("decided").isNotNull() & ~F.col("held")
    grams = cut(
        places.groupBy("gram").agg(
            F.sum((trains & (F.col("decided") == "allow")).cast("long")).alias("a"), F.sum((trains & (F.col("decided") == "block")).cast("long")).alias("r"),
            # Places that will be scored.
            F.sum((~trains).cast("long")).alias("n"),
        )
    )
    seen = grams.agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("n").alias("n")).first()
    out = rows.withColumns({"host": host, "path": path}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)[0]).withColumn("decided", decided)
    if not seen.a or not seen.r:
        return out.select(
            "page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict"), F.when(F.col("decided").isNull(), 0.0).alias("score"),
        )
    ratio = F.round((F.log("pa") - F.log("pr")) * UNIT).cast("long")
    weights = cut(_smoothed(grams, order).select("gram", ratio.alias("w")).join(grams.where("n > 0").select("gram", "n"), "gram"))
    scored = cut(
        split_join(places.where(~trains), weights, "gram", seen.n)
        .groupBy("url").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("c"), F.first("decided").alias("decided"))
        .withColumn("score", F.col("w") / (F.col("c") * UNIT))
    )
    slot = F.least(F.greatest(F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS - 1)).cast("int")
    table = np.zeros((2, BINS))
    for r in scored.where("decided IS NOT NULL").groupBy(slot.alias("s"), (F.col("decided") == "allow").cast("int").alias("good")).count().collect():
        table[r.good, r.s] = r["count"]
    a, b = calibrate((np.arange(BINS) + 0.5) * (2 * SPAN / BINS) - SPAN, table[1], table[0])
    cutoff = float(np.log(level / (1 - level)))
    verdict = F.when(F.col("score") * a + b >= cutoff, "allow").otherwise("block")
    # n from the table of urls: how many rows each key has on the other side of the join.
    verdicts = scored.where("decided IS NULL").select("url", "score", verdict.alias("judged")).join(urls.where("decided IS NULL").select("url", "n"), "url")
    verdicts = cut(verdicts)
    total = verdicts.agg(F.sum("n").alias("n")).first().n or 0
    ruled = out.where("decided IS NOT NULL").select("page_id", "host", "path", "rule", F.col("decided").alias("verdict"), F.lit(None).cast("double").alias("score"))
    free = split_join(out.where("decided IS NULL"), verdicts, "url", total).select("page_id", "host", "path", "rule", F.col("judged").alias("verdict"), "score")
    return ruled.unionByName(free)
