"""Collocations, source divergence and the URL filter against plain versions of their contracts."""

import collections
import math
import random
import re

import numpy as np
import pytest

from bandwright.llm import collocations, divergence, queries, url_model

DOWN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tuples(df):
    return sorted(map(repr, map(tuple, df.collect())))


# ---- collocations ----------------------------------------------------------------------


def phrases(rows, enough=10, cover=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(DOWN)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        often = {g: a for g, a in c.items() if len(g) > 1 and a >= enough}
        longest = collections.Counter()
        for g, a in often.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    longest[part] = max(longest[part], a)
        for g, a in often.items():
            if len(g) == 2 and g in longest and 100 * longest[g] >= cover * a:
                continue
            score, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, g.decode(), -a, l, r, n[lang], -s) for i, (s, a, g, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(map(repr, out))


def sentences(rng, n):
    words = ["the", "Of", "new", "york", "city", "état", "a\x1cb", "x-y", "San", "de", "\x00q", "word"]
    weights = [9, 7, 5, 5, 4, 2, 1, 1, 2, 3, 1, 4]
    return "".join(w + rng.choice((" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ")) for w in rng.choices(words, weights, k=n))


def collocation_rows():
    rng = random.Random(3)
    rows = [(sentences(rng, rng.randrange(1, 200)), rng.choice(("en", "en", "fr", None, ""))) for _ in range(80)]
    return rows + [(None, "en"), ("", "en"), (" \t ,;", "xx"), (sentences(rng, 9000), "en"), *[(rows[0])] * 30, ("w " * 3000, "zz"), ("alone", None)]


@pytest.mark.parametrize("range_rows, words, enough, top", [(200_000, 1 << 19, 10, 2000), (7, 50, 10, 2000), (3, 50, 2, 25)])
def test_collocations(spark, monkeypatch, range_rows, words, enough, top):
    """Ranges of a few rows make words and pairs span them; few words at a time make tasks number them anew."""
    monkeypatch.setattr(collocations, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(collocations, "WORDS", words)
    rows = collocation_rows()
    docs = spark.createDataFrame([(t, g, 1, 1) for t, g in rows], "text string, lang string, n long, rank long").repartition(4)
    assert tuples(collocations.mine(docs, enough, top=top)) == phrases(rows, enough, top=top)


def test_collocations_of_all_cases(spark, docs, none):
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert tuples(collocations.mine(docs)) == phrases(rows)
    assert collocations.mine(none).count() == 0


def test_pair_filter_keeps_what_is_frequent():
    """Five bytes of a hash survive packing, and a threshold over one byte counts whole numbers."""
    keys = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) & np.uint64(0xFFFFFFFFFF000000)
    assert (collocations._unpack(collocations._pack(keys)) == keys).all()


def test_collocations_with_a_large_threshold(spark):
    rows = [("a b c " * 400, "en")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    assert tuples(collocations.mine(docs, 300)) == phrases(rows, 300)


# ---- source divergence -----------------------------------------------------------------


def divergences(rows, min_docs=3, top=200):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, n, occurs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        w = terms.findall((text or "").translate(DOWN))
        occurs.add((lang, source))
        df[lang].update(set(w))
        n[lang, source].update(w)
    out = []
    for lang in {g[0] for g in occurs}:
        kept = sorted(t for t, c in df[lang].items() if c >= min_docs)
        sources = sorted(s for g, s in occurs if g == lang)
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        whole, v = sum(total.values()), len(kept)
        p = {(s, t): 1 + 10**9 * (n[lang, s][t] + 1) // (total[s] + v) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(n[lang, s][t] for s in sources) + 1) // (whole + v) for t in kept}
        for s in sources:
            pair = [(-sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in kept), o.encode()) for o in sources if o != s]
            term = [(-((p[s, t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s, t] > q[t]]
            for part, items, last in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(sorted(items)[:last], 1)]
    return sorted(map(repr, out))


def divergence_rows():
    rng = random.Random(8)
    some = "alpha Beta été naïve x y z don't foo_bar 12 日本 beta2gamma".split()
    rows = []
    for _ in range(150):
        source, lang = rng.choice(("a", "b", "c", "", None, "é")), rng.choice(("en", "de", None, ""))
        rows.append((" ".join(rng.choices(some, [ord((source or "z")[0]) % (i + 3) + 1 for i in range(len(some))], k=rng.randrange(40))), lang, source))
    copies = [("copy of one text " * 5, "en", s) for s in ("a", "a", "b", "c", None, "a")] * 20 + [("copy of one text " * 5, "de", "a")] * 2
    return rows + copies + [(None, "en", "nothing"), ("", "en", "nothing"), ("12 34 !", "fr", "no terms"), ("12 34 !", "fr", "no terms too"), ("rare", "es", "alone")]


@pytest.mark.parametrize("pair_slice, held_terms", [(2_000_000, 400_000), (5, 3)])
def test_divergence(spark, monkeypatch, pair_slice, held_terms):
    monkeypatch.setattr(divergence, "PAIR_SLICE", pair_slice)
    monkeypatch.setattr(divergence, "HELD_TERMS", held_terms)
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, term long, p string").repartition(4)
    assert tuples(divergence.audit(docs)) == divergences(rows)


def test_divergence_of_all_cases(spark, docs, none):
    rows = [(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]
    assert tuples(divergence.audit(docs)) == divergences(rows)
    assert divergence.audit(none).count() == 0


def test_shares_beyond_64_bits(spark):
    n = 8_000_000_000_000
    row = spark.createDataFrame([(n, 3 * n, 1000)], "n long, total long, terms long").select(divergence._share("n", "total", "terms").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (3 * n + 1000)


# ---- URL filter ------------------------------------------------------------------------


def url_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(DOWN), m[2]) if m else ("", "")


def url_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_model.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_model(urls, order, held_hash):
    """Verdicts of distinct urls by recursion over contexts; ``held_hash`` tells which urls calibrate."""
    line = {u: url_model.START * order + (re.sub(r"(?s)^.*?://", "", u, count=1) if "://" in u else u).translate(DOWN) + url_model.END for u in urls}
    decided = {u: url_rule(*url_parts(u))[1] for u in urls}
    alphabet = len({c for x in line.values() for c in x[order:]})
    models = {}
    for kind in ("allow", "block"):
        follow = collections.defaultdict(collections.Counter)
        for u in urls:
            if decided[u] == kind and not held_hash[u]:
                for i in range(order, len(line[u])):
                    for k in range(order + 1):
                        follow[line[u][i - k : i]][line[u][i]] += 1
        models[kind] = follow
    if not all(models.values()):
        return {u: decided[u] or "allow" for u in urls}, {}

    def p(follow, context, c):
        shorter = 1 / (alphabet + 1) if not context else p(follow, context[1:], c)
        seen = follow.get(context)
        if context and not seen:
            return shorter
        n, t = (sum(seen.values()), len(seen)) if seen else (0, 0)
        return ((seen[c] if seen else 0) + t * shorter) / (n + t) if n else shorter

    score = {}
    for u in urls:
        x = line[u]
        w = [math.log(p(models["allow"], x[i - order : i], x[i])) - math.log(p(models["block"], x[i - order : i], x[i])) for i in range(order, len(x))]
        score[u] = sum(w) / len(w)
    return decided, score


def url_rows():
    rng = random.Random(2)
    hosts = ["shop.good.example.net", "example.net", "Spam-Farm.example.com", "news.example.org", "org", "casino.net", "other.io", "xorg", "a.b.example.com:80"]
    rows = [f"{rng.choice(('http', 'HTTPS'))}://{rng.choice(hosts)}{rng.choice(('/en/', '/de/', '/fr/', '/', '', '/EN/'))}{rng.choice(('news', 'buy-pills', 'x'))}{rng.randrange(300)}{rng.choice(('', '?q=a/b', '#top', '.html'))}" for _ in range(400)]
    return rows + [None, "", "no scheme", "://", "http://a.net", "a://b://c.net/d", "http://\u00e9t\u00e9.org/fr/\n x", "http://example.com/de", "x" * 5000, *["http://hot.example.com/es/1"] * 150]


def test_url_filter(spark):
    rows = url_rows()
    pages = spark.createDataFrame([(i, u, "<html>", "b", 1) for i, u in enumerate(rows)], "page_id long, url string, html string, rule string, n long").repartition(4)
    got = {r.page_id: r for r in url_model.judge(pages, order=3).collect()}
    assert sorted(got) == list(range(len(rows)))
    urls = sorted({u or "" for u in rows})
    held = {r.url: r.held for r in spark.createDataFrame([(u,) for u in urls], "url string").selectExpr("url", "pmod(xxhash64(url), 5) = 0 AS held").collect()}
    decided, score = plain_model(urls, 3, held)
    for i, u in enumerate(rows):
        host, path = url_parts(u)
        name, verdict = url_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name)
        if verdict:
            assert got[i].verdict == verdict and got[i].score is None
        else:
            assert got[i].score == pytest.approx(score[u or ""], abs=1e-6) and got[i].verdict in ("allow", "block")
    # One cut-off, and the one that the kept-out urls calibrate: the probability on either side is as it should be.
    free = [(got[i].score, got[i].verdict) for i, u in enumerate(rows) if got[i].rule is None]
    assert max(s for s, v in free if v == "block") < min(s for s, v in free if v == "allow")
    x = np.array([score[u] for u in urls if held[u] and decided[u]])
    y = np.array([decided[u] == "allow" for u in urls if held[u] and decided[u]], float)
    a, b = url_model.calibrate(x, y, 1 - y)
    assert a > 0 and all((a * s + b >= 0) == (v == "allow") for s, v in free if abs(a * s + b) > 0.2)


def test_url_filter_without_either_class(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.io/"), (3, None), (3, None)], "page_id long, url string")
    got = [(r.page_id, r.rule, r.verdict) for r in url_model.judge(pages).orderBy("page_id").collect()]
    assert got == [(1, "net/", "block"), (2, None, "allow"), (3, None, "allow"), (3, None, "allow")]
    assert url_model.judge(pages.limit(0)).count() == 0


def test_calibration():
    rng = np.random.default_rng(4)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    a, b = url_model.calibrate(x, y, 1 - y)
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.2
    assert url_model.calibrate(x, 1 - y, y)[0] == 0


def test_queries_are_registered(spark):
    names = {"op11_collocations", "op12_source_divergence", "op13_url_filter"}
    assert names <= set(queries.queries()) and {"op11_collocations", "op12_source_divergence"} <= set(queries.oracle_sql())
