"""Source divergence audit: how far each source's words are from those of the other sources of its language.

Identical texts of a language are collapsed before they are read as words: a first scan counts texts by hash, so
that the second one knows which may have copies. A text without copies is cut into words where it is read and
never leaves its task. Of the others each task sends one text and its counts per source; where they meet, a text
is cut into words once and its counts are added for every source times its copies there.

A term that neither of two sources has adds the same amount to their divergence, and one that a single source has
adds an amount that depends on the other source only through the other's share of an absent term. So a pair is
evaluated on the terms that both have; all others come from counts of equal shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import bitmap, in_bitmap, slices

# A-Z to a-z; every other ASCII byte that is no letter becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# Term counts a task holds before it passes them on.
HELD_TERMS = 400_000
# Pairs of one term's sources that are worked on at a time, and pair sums a task holds.
PAIR_SLICE, HELD_PAIRS = 2_000_000, 1_000_000
ONE = 1_000_000_000

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _flat(df: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))


class _Counts:
    """Counts and documents of (language, source, term), passed on as rows when there are many."""

    def __init__(self) -> None:
        self.n: dict[tuple[str, str], Counter] = {}
        self.df: dict[tuple[str, str], Counter] = {}

    def add_texts(self, key: tuple[str, str], texts: list[bytes]) -> None:
        n, df = self.n.setdefault(key, Counter()), self.df.setdefault(key, Counter())
        words = [t.translate(LETTERS).split() for t in texts]
        n.update(chain.from_iterable(words))
        df.update(chain.from_iterable(map(set, words)))

    def add_copies(self, lang: str, sources: dict[str, int], text: bytes) -> None:
        once = Counter(text.translate(LETTERS).split())
        for source, copies in sources.items():
            n, df = self.n.setdefault((lang, source), Counter()), self.df.setdefault((lang, source), Counter())
            for term, c in once.items():
                n[term] += c * copies
                df[term] += copies

    def full(self) -> bool:
        return sum(map(len, self.n.values())) > HELD_TERMS

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), n in self.n.items():
            terms, df = list(n), self.df[lang, source]
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()),
                     pa.array([df[t] for t in part], pa.int64())],
                    schema=COUNTS,
                )
        self.n, self.df = {}, {}


def _single(held: Broadcast):
    """Term counts of the texts that have no copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Counts()
        for batch in slices(batches):
            alone = ~in_bitmap(held.value, batch.column("h").to_numpy())
            texts: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, text, ok in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()), alone):
                if ok:
                    texts.setdefault((lang, source), []).append(text.as_py())
            for key, part in texts.items():
                acc.add_texts(key, part)
            if acc.full():
                yield from acc.rows()
        yield from acc.rows()

    return run


def _copies(held: Broadcast):
    """Counts per source of the texts that may have copies, with the text where a task meets it first."""
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("g", pa.int64()), ("source", pa.string()), ("copies", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int, int]] = set()
        count: Counter = Counter()

        def counted() -> pa.RecordBatch:
            keys = list(count)
            out = pa.RecordBatch.from_pydict(
                {"lang": [k[0] for k in keys], "h": [k[1] for k in keys], "g": [k[2] for k in keys], "source": [k[3] for k in keys], "copies": list(count.values()), "text": [None] * len(keys)},
                schema=schema,
            )
            count.clear()
            return out

        for batch in slices(batches):
            some = np.flatnonzero(in_bitmap(held.value, batch.column("h").to_numpy()))
            if not len(some):
                continue
            part = batch.take(pa.array(some))
            keys = list(zip(*(part.column(c).to_pylist() for c in ("lang", "h", "g", "source"))))
            first = []
            for at, key in enumerate(keys):
                if key[:3] not in seen:
                    seen.add(key[:3])
                    first.append(at)
            count.update(keys)
            if first:
                new = part.take(pa.array(first))
                cols = [new.column(c) for c in ("lang", "h", "g", "source")] + [pa.array([0] * len(first), pa.int64()), new.column("text")]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
            if len(seen) + len(count) > HELD_TERMS:
                yield counted()
                seen.clear()
        if count:
            yield counted()

    return run


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by text key: each text is cut into words once."""
    acc, open_key, text, sources = _Counts(), None, None, Counter()
    for batch in slices(batches):
        for key, source, copies, body in zip(
            zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "g"))), batch.column("source").to_pylist(), batch.column("copies").to_pylist(), batch.column("text").cast(pa.binary()),
        ):
            if key != open_key:
                if open_key is not None:
                    acc.add_copies(open_key[0], +sources, text)
                    if acc.full():
                        yield from acc.rows()
                open_key, text, sources = key, None, Counter()
            sources[source] += copies
            if text is None and body.is_valid:
                text = body.as_py()
    if open_key is not None:
        acc.add_copies(open_key[0], +sources, text)
    yield from acc.rows()


def term_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``lang, source, term, n, df``; ``lang, source`` of every group that occurs). ``df`` counts documents."""
    spark = docs.sparkSession
    keyed = _flat(docs).select("lang", "source", "text", F.xxhash64("lang", "text").alias("h"), F.xxhash64("text", "lang", F.lit(1)).alias("g"))
    # Written once: groups and repeats both come from these few bytes per text.
    hashes = cut(keyed.groupBy("lang", "source", "h").agg(F.count(F.lit(1)).alias("n")))
    groups = hashes.select("lang", "source").distinct()
    held = spark.sparkContext.broadcast(bitmap(hashes.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "h"))
    ddl = "lang string, source string, term string, n long, df long"
    single = keyed.select("lang", "source", "text", "h").mapInArrow(_single(held), ddl)
    moved = keyed.mapInArrow(_copies(held), "lang string, h long, g long, source string, copies long, text string")
    several = moved.repartition("lang", "h", "g").sortWithinPartitions("lang", "h", "g").mapInArrow(_collapsed, ddl)
    parts = single.unionByName(several)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), groups


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)) of non-negative columns, exact beyond 64 bits."""
    return F.expr(f"1L + (cast({count} + 1 as decimal(28, 0)) * cast({ONE} as decimal(10, 0))) div cast({total} + {terms} as decimal(20, 0))")


def _gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so squares fit 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, term, g, p, p0`` sorted by term: for each pair of groups, what their common terms add beyond
    what each of them adds where the other has no such term."""
    gap = lambda a, b: (a - b) ** 2 // b

    def pairs(batch: pa.RecordBatch, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        g, p, p0 = (batch.column(c).to_numpy() for c in ("g", "p", "p0"))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(g)))
        first, many = np.repeat(start, size), np.repeat(size, size)
        ends = np.cumsum(many)
        at = 0
        while at < len(g):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_SLICE, "right")))
            a = np.repeat(np.arange(at, stop), many[at:stop])
            b = np.arange(len(a)) - np.repeat(ends[at:stop] - many[at:stop] - (ends[at - 1] if at else 0), many[at:stop]) + first[a]
            a, b = a[a != b], b[a != b]
            at = stop
            if not len(a):
                continue
            more = gap(p[a], p[b]) - gap(p[a], p0[b]) - gap(p0[a], p[b]) + gap(p0[a], p0[b])
            order = np.lexsort((g[b], g[a]))
            x, y, more = g[a][order], g[b][order], more[order]
            cuts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            yield pa.RecordBatch.from_pydict({"g": x[cuts], "h": y[cuts], "more": np.add.reduceat(more, cuts)})

    held: pa.RecordBatch | None = None
    for batch in slices(batches, 50_000):
        whole = batch if held is None else pa.concat_batches([held, batch])
        lang, term = whole.column("lang"), whole.column("term")
        new = np.append(True, np.asarray(pa.compute.or_(pa.compute.not_equal(lang[1:], lang[:-1]), pa.compute.not_equal(term[1:], term[:-1])))) if len(lang) > 1 else np.ones(1, bool)
        # The last term may go on in the next batch.
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield from pairs(whole.slice(0, last), new[:last])
        held = whole.slice(last)
    if held is not None:
        new = np.zeros(held.num_rows, bool)
        new[0] = True
        yield from pairs(held, new)


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every source of a language its divergence from each other
    source (part ``pair``) and its ``top`` terms above the language (part ``term``).

    A null lang, source or text is the empty string; such groups occur like others, also without any term. Terms
    are runs of letters and other non-ASCII characters, A-Z lower-cased; those in fewer than ``min_docs``
    documents of the language are left out, copies counted. A language without terms gives pairs of value 0; a
    source alone in its language gives no pair. Equal values are ranked by item. Repeated rows count as often as
    they occur. An empty table gives no rows. Other columns are not read.

    The result has a row for each pair of sources of a language, as it is asked for; nothing else here is
    squared: a pair costs the terms that both have.
    """
    parts, groups = term_counts(docs)
    same = Window.partitionBy("lang", "term")
    kept = cut(
        parts.withColumns({"docs": F.sum("df").over(same), "lang_n": F.sum("n").over(same), "head": F.min("source").over(same) == F.col("source")})
        .where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "head")
    )
    whole = kept.where("head").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("present"))
    facts = groups.join(whole, "lang", "left").join(own, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total", "present"])
    absent = F.when(F.col("terms") > 0, _share("0L - 0L", "total", "terms"))
    facts = cut(facts.withColumn("g", F.monotonically_increasing_id()).withColumn("p0", absent))
    shares = cut(
        kept.join(facts, ["lang", "source"])
        .select("lang", "source", "term", "g", "p0", _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q"))
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    )
    return terms.unionByName(_pairs(facts, shares).withColumn("rank", F.row_number().over(by_value)))


def _pairs(facts: DataFrame, shares: DataFrame) -> DataFrame:
    wide = lambda c: F.sum(c.cast("decimal(38,0)")).cast("long")
    # Terms of one source against the share of an absent term in the other: equal shares count once.
    equal = shares.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("m"))
    other = facts.where("p0 IS NOT NULL").select("lang", F.col("p0").alias("x")).distinct()
    alone = cut(
        equal.join(other, "lang").groupBy("g", "x")
        .agg(wide(F.col("m") * _gap("p", "x")).alias("above"), wide(F.col("m") * _gap("x", "p")).alias("below"))
    )
    both = (
        shares.select("lang", "term", "g", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
        .mapInArrow(_shared_terms, "g long, h long, more long").groupBy("g", "h").agg(wide(F.col("more")).alias("more"))
    )
    a = facts.select("lang", "source", "g", "p0", "terms", "present")
    b = facts.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("p0").alias("q0"), F.col("present").alias("item_present"))
    pairs = a.join(b, "lang").where("g <> h")
    pairs = pairs.join(alone.select("g", F.col("x").alias("q0"), "above"), ["g", "q0"], "left")
    pairs = pairs.join(alone.select(F.col("g").alias("h"), F.col("x").alias("p0"), "below"), ["h", "p0"], "left").join(both, ["g", "h"], "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = (F.col("terms") - F.col("present") - F.col("item_present")) * _gap("p0", "q0") + none("above") + none("below") + none("more")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(value, F.lit(0)).cast("long").alias("value"))
