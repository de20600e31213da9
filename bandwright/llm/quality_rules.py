"""Quality rules with host verdicts, in DataFrame functions only.

Each document's rule figures are computed inside its row. Failures are then counted per host, the hosts'
failure rates are shrunk towards the corpus by a beta prior fitted to all hosts (moments), and the verdict of
the host goes back to its documents by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import text_column

# White space and symbols of the base rules.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the row's words.

    Windows are hashed to 64 bits. Only rows in which a sorted copy of the hashes shows equal neighbours sort
    (hash, place) pairs; the places of equal hashes then cover up to three words each.
    """
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Let-bindings by one-element arrays, so that no array is computed once per element.
    twice = lambda s: F.filter(s, lambda e, k: (e.h == F.get(s, k - 1).h) | (e.h == F.get(s, k + 1).h))
    places = lambda s: F.array_sort(F.transform(twice(s), lambda e: e.i))
    covered = lambda p: F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a.last)).alias("n"), i.alias("last")),
        lambda a: a.n,
    )
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    several = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    full = let(pairs, lambda s: let(places(s), covered))
    return F.when(F.size(words) < 4, F.lit(0)).when(several, full).otherwise(F.lit(0)).cast("long")


def figures(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and the base figures of every row; a null text has no words."""
    body = text_column()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), body.alias("text"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("words"))
    bare = F.translate("text", SPACES, "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return rows.select(
        "doc_id", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 0).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def judge(
    docs: DataFrame, least_words: int = 50, most_repeat: int = 50, symbol_share: float = 0.3, dup_lines: int = 3,
    bad_rate: float = 0.5, least_weight: float = 1.0,
) -> DataFrame:
    """Figures, ``base_failed``, the host's shrunk failure rate ``host_rate`` and ``kept`` for every row.

    A document fails when a base rule fails, or a symbol or repeated-line rule does. A host is bad when its
    shrunk rate exceeds ``bad_rate``; then its documents are dropped if any rule at half strength fails, so a
    clean document of a bad host stays. Rows without a source form one host. Repeated rows count as often as
    they occur. An empty table gives no rows. Columns other than doc_id, text and source are not read.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    heavy = lambda x: (F.col("n_symbols") > x * symbol_share * F.col("n_words")) | (F.col("n_dup_lines") > x * dup_lines)
    suspect = heavy(0.5) | (100 * F.col("n_repeat_words") > 0.5 * most_repeat * F.col("n_words"))
    # Written once: the counts per host and the join read figures, not texts.
    rows = cut(figures(docs).withColumn("base_failed", failed).withColumn("failed", failed | heavy(1.0)).withColumn("suspect", suspect))
    hosts = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    fit = hosts.agg(F.sum("f").alias("f"), F.sum("n").alias("n"), F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("i")).first()
    mean = (fit.f or 0) / fit.n if fit.n else 0.0
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    # Variance of the rates beyond what counts of their sizes would show; the prior's weight is m(1-m)/v - 1.
    beyond = max((fit.v or 0.0) - mean * (1 - mean) * (fit.i or 0.0), 1e-9)
    weight = max(mean * (1 - mean) / beyond - 1, least_weight)
    verdicts = hosts.select(F.col("source").alias("host"), ((F.col("f") + mean * weight) / (F.col("n") + weight)).alias("host_rate"))
    out = rows.join(verdicts, rows.source.eqNullSafe(verdicts.host), "left")
    kept = ~F.col("failed") & ~((F.col("host_rate") > bad_rate) & F.col("suspect"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "source", "host_rate")
