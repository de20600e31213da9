"""Each operator against a plain version of its contract, over texts with all the awkward cases."""

import collections
import struct
import zlib

import brute
import pytest

from bandwright.llm import decontamination, html_text, jaccard_join, license_rules, ordinal_quality, packing, quality_rules, queries, secrets, sharding, substring_dedup


def rows_of(df, *cols):
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))


def source(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_decontamination(spark, docs):
    held = [t for _, t in source(docs) if t and len(t) > 500 and len(t) < 2000]
    items = [("a", held[0][40:260]), ("b", held[1][100:300].upper()), ("c", "kappa"), ("d", ""), ("e", None), (None, "one"), ("f", "one"), ("g", held[0][40:260])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(repr((i, *brute.contamination(t, [x for x in items if x[0]]))) for i, t in source(docs))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontamination.decontaminate(docs, bench), *cols) == want
    assert rows_of(decontamination.decontaminate(docs, bench, block_bytes=150), *cols) == want
    assert not decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count()


def test_decontamination_offsets(spark):
    text = "Été! The QUICK—brown fox—jumps; over"
    got = decontamination.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, "quick—brown fox—jumps")], "item_id long, text string")).first()
    assert [text[a:b] for a, b in zip(got.spans[::2], got.spans[1::2])] == ["QUICK—brown fox—jumps"]


def test_license_base(docs):
    want = sorted(repr((i, *brute.license_base(t))) for i, t in source(docs))
    got = license_rules.scan(docs)
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | set() and 0 <= r.score <= 1


@pytest.mark.parametrize("text, labels, score", [
    ("Released under the MIT License.", "mit", 0.95),
    ("GNU Lesser General Public License v2.1", "gpl,lgpl,lgpl-2.1", 0.75),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause", 0.9),
    ("licensed under CC BY-NC 4.0.", "cc-by-nc", 0.95),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published", "gpl", 1.0),
    ("Apache License, Version 2.0", "apache,apache-2.0", 0.75),
    ("The word mit alone, and no license", "", 0.0),
])
def test_license_rules(spark, text, labels, score):
    got = license_rules.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.labels, got.score) == (labels, score)


def test_license_rules_are_many():
    assert len(license_rules.rules()) > 500 and all(k for k, *_ in license_rules.rules())


def example(rng, regex):
    """A random string that a rule's regular expression matches."""
    from re import _parser

    def drawn(tree):
        out = ""
        for op, value in tree:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "BRANCH":
                out += drawn(rng.choice(value[1]))
            elif kind == "SUBPATTERN":
                out += drawn(value[3])
            elif kind == "MAX_REPEAT":
                out += "".join(drawn(value[2]) for _ in range(rng.randint(value[0], min(value[1], value[0] + 1))))
            elif kind == "IN":
                out += str(rng.randrange(10)) if str(value[0][0]) == "CATEGORY" else chr(rng.choice(value)[1])
            else:
                assert kind in ("ANY", "AT", "ASSERT"), kind
                out += " " * (kind == "ANY")
        return out

    return " ".join(drawn(_parser.parse(regex)).split())


def test_license_rules_alone_in_a_text(spark):
    """Texts that hold a rule's words and nothing else, with any separators; no rule is lost by its keywords or the prefilter."""
    import random
    import re

    rng, rules, want = random.Random(2), license_rules.rules(), {}
    for regex, label, priority in dict.fromkeys((r, label, p) for _, r, label, p in rules):
        for _ in range(4):
            words = example(rng, regex)
            if re.search(regex, words):
                want[rng.choice(("\n", " - ", "-", "/")).join(words.upper().split(" "))] = (label, priority)
    assert {r for r, *_ in want.values()} == {label for _, _, label, _ in rules}
    got = license_rules.scan(spark.createDataFrame([(k, t) for k, t in enumerate(want)], "doc_id long, text string").repartition(4)).collect()
    texts = list(want)
    bad = [(texts[r.doc_id], want[texts[r.doc_id]], r.labels) for r in got if want[texts[r.doc_id]][0] not in r.labels.split(",") or r.score < license_rules.SCORES[want[texts[r.doc_id]][1] - 1]]
    assert not bad


@pytest.mark.parametrize("text, label", [
    ("Apache-2.0", "apache-2.0"), ("released under the BSD 3-Clause", "bsd-3-clause"), ("WTFPL", "wtfpl"), ("MPL 2.0", "mpl-2.0"), ("CeCILL", "cecill"), ("0BSD", "0bsd"), ("FreeBSD", "bsd-2-clause"),
    ("3-clause BSD", "bsd-3-clause"), ("GPL3", "gpl-3.0"), ("OpenRAIL", "openrail"), ("provided 'as is', without any express or\nimplied warranty", ""), ("public\ndomain", "public-domain"),
    ("This software is provided 'as-is', without any express or implied\nwarranty", "zlib"), ("All rights\nreserved", "proprietary"), ("Unauthorized copying of this file is strictly prohibited", "proprietary"),
    ("CC\nBY 4.0", "cc-by"), ("Creative\nCommons Zero", "cc0"),
])
def test_license_named_alone(spark, text, label):
    assert label in license_rules.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels.split(",")


def whole_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ranks_give_the_tokenizers_ids():
    import random

    rng = random.Random(1)
    plain, ranks = whole_tokenizer(), packing.Encoder(queries.tokenizer_path())
    letters = list("ab  \n\n.,'s1²_é  \u0301!-\t\x1c漢ß\x85\xa0😀ª٣Ⅷ") + ["<|endoftext|>"]
    cases = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    cases += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)))) for _ in range(30)) for _ in range(3000)]
    assert [struct.pack(f"<{len(i)}I", *i) for i in (plain.encode(c, add_special_tokens=False).ids for c in cases)] == [ranks(c) for c in cases]


def test_a_special_token_in_a_text_is_one_id():
    ids = packing.Encoder(queries.tokenizer_path())("a <|endoftext|> b")
    assert struct.unpack("<4I", ids) == (64, 220, 50256, 275)


def test_packing(docs):
    path = queries.tokenizer_path()
    plain = whole_tokenizer()
    want = collections.Counter()
    for i, t in source(docs):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 64 + 1
        at = 0
        for k in range(-(-len(ids) // 64)):
            n = first if k == 0 else 64
            want[i, k, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n]))] += 1
            at += n
    got = packing.pack(docs, path, size=64, open_bins=16).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 64 + 5


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2, 0)
    assert [bins.put(n) for n in (6, 5, 7, 5, 4, 3)] == [(0, 0), (1, 0), (2, 0), (1, 5), (0, 6), (3, 0)]


def test_secrets(docs):
    want, joined = [], {}
    for i, t in source(docs):
        (*n, sha), spans = brute.secrets(t)
        want.append(repr((i, *n, sha)))
        joined[i, t] = spans
    got = secrets.find_secrets(docs)
    assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)
    texts = dict(source(docs))
    for r in got.collect():
        assert ",".join(s for s in r.spans.split(",") if s and not s.startswith("random")) == joined[r.doc_id, texts[r.doc_id]]


def test_randomness_battery():
    import base64
    import random

    rng = random.Random(3)
    passed = [secrets.battery(base64.b64encode(rng.randbytes(48)))[1] > 0.05 for _ in range(300)]
    assert 0.85 < sum(passed) / 300
    assert secrets.battery(b"abababab12abababab12abababab12ab")[1] < 0.01
    assert secrets.battery(b"justplainlowercaseletters") is None


@pytest.mark.parametrize("n", [18, 36, 48, 240])
def test_lone_secret_in_any_table(spark, n):
    """A random string below the middle of the p-values is found alone, and among many strings that are not random."""
    import base64
    import random

    rng = random.Random(n)
    lone = next(s for s in iter(lambda: base64.b64encode(rng.randbytes(n)), None) if 0.3 < secrets.battery(s)[1] < 0.45).decode()
    plain = "a1" * (len(lone) // 2)
    assert secrets.battery(plain.encode())[1] < 0.02
    for others in (0, 300):
        docs = spark.createDataFrame([(0, f"see {lone} there")] + [(i, f"see {'Zz9' + plain[3:]} there") for i in range(1, others + 1)], "doc_id long, text string")
        got = {r.doc_id: r.n_random for r in secrets.find_secrets(docs).collect()}
        assert got.pop(0) == 1 and not any(got.values())
        assert "[SECRET]" in secrets.redact(docs).where("doc_id = 0").first().text


def test_redaction_keeps_columns(docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not [r for r in out.collect() if brute.secrets(r.text)[0][2]]
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(docs, k, num):
    want = brute.linked(source(docs), k, num, 100)
    got = jaccard_join.join(docs, k, num, 100).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_jaccard_join_in_small_blocks(spark, monkeypatch):
    """Near copies of several texts, blocks of three sets."""
    import random

    rng = random.Random(1)
    rows = []
    for g in range(4):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice((30, 60, 90)))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.linked(rows, 4, 85, 100)
    real = jaccard_join.linking.links
    monkeypatch.setattr(jaccard_join.linking, "links", lambda *a: real(*a, block_sets=3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, 4, 85, 100).collect()} == want


def test_quality_figures(docs):
    want = sorted(repr((i, *brute.quality(t))) for i, t in source(docs))
    got = quality_rules.judge(docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not got.where("base_failed AND kept").count()


def test_bad_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    odd = good + " # # # # # # # # # # # #"
    rows = [(i, "bad" if i < 30 else "fine", "short" if i < 28 else odd if i in (28, 31) else good) for i in range(90)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[0].host_rate > 0.8 > 0.2 > got[40].host_rate
    assert not got[28].kept and got[31].kept and got[29].kept and got[50].kept


def test_sharding(docs):
    got = sharding.shard(docs, shards=4, grain=8).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(i), len((t or "").encode()) + 16, brute.crc(t)) for i, t in source(docs))
    homes = collections.defaultdict(set)
    texts = {i: t for i, t in source(docs)}
    slots = collections.defaultdict(list)
    for r in got:
        homes[texts[r.doc_id] or ""].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_rows_without_ids_are_even_and_gapless(spark):
    import random

    rng = random.Random(3)
    rows = [(None if i % 3 else 5, "word " * rng.randrange(1, 60) + str(i)) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=8, grain=64).collect()
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_classifier_reads_one_row_of_an_id(spark):
    """Repeats of a labelled id with other texts change neither the number of rows nor the model."""
    rows = [(i, "bad spam words" if i % 2 else "fine clean prose") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    once = ordinal_quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = ordinal_quality.train(spark.createDataFrame(rows * 4, "doc_id long, text string").repartition(5), labels)
    assert (once.weights == many.weights).all() and once.thresholds == many.thresholds


def test_schedule_is_longest_first():
    assert sharding.schedule([(1, 5), (2, 5), (3, 4), (4, 3), (5, 3)], 2) == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1}


def test_substring_dedup(docs):
    got = substring_dedup.spans(docs).collect()
    texts = dict(source(docs))
    holders = {i for i, t in source(docs) if t and "quick brown fox" in t}
    assert len(holders) == 3 and holders <= {r.doc_id for r in got}
    clusters = collections.defaultdict(list)
    for r in got:
        assert 25 <= len(brute.alnum(texts[r.doc_id][r.start : r.end]))
        clusters[r.cluster_id].append(r)
    for held in clusters.values():
        assert sum(r.kept for r in held) >= 1 and len({r.doc_id for r in held}) > 1
    copies = {i for i, t in source(docs) if t and t == texts[7]}
    assert copies <= {r.doc_id for r in got}


def test_substring_dedup_without_punctuation(spark):
    """Every run of 51 words that two documents share has a unit of one cluster inside it in both, wherever it begins."""
    import random
    import re

    rng = random.Random(9)
    draw = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    bodies = [draw(rng.randrange(60, 300)) for _ in range(40)]
    for _ in range(30):
        passage = draw(51)
        for body in rng.sample(bodies, rng.choice((2, 2, 3))):
            at = rng.randrange(len(body))
            body[at:at] = passage
    bodies += [draw(20) + ["again", "and"] * 60 + draw(20), draw(9) + ["again", "and"] * 45 + draw(33)]
    marks = (" ", " ", " ", ", ", "\n", ". ")
    # Half of the texts have no sentences; in the others they end at other words in every text.
    texts = [" ".join(b) if i % 2 else "".join(w + rng.choice(marks) for w in b) for i, b in enumerate(bodies)]
    got = substring_dedup.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    units = collections.defaultdict(list)
    for r in got:
        first = len(brute.alnum(texts[r.doc_id][: r.start]))
        units[r.doc_id].append((first, first + len(brute.alnum(texts[r.doc_id][r.start : r.end])), r.cluster_id))
        assert re.match(r"w|a", texts[r.doc_id][r.start :])
    assert len(got) == len({(r.doc_id, r.start, r.end) for r in got})
    runs = collections.defaultdict(list)
    for i, b in enumerate(bodies):
        for at in range(len(b) - 50):
            runs[tuple(b[at : at + 51])].append((i, at))
    shared = [places for places in runs.values() if len({i for i, _ in places}) > 1]
    assert len(shared) > 20
    for places in shared:
        inside = [{c for a, b, c in units[i] if at <= a and b <= at + 51} for i, at in places]
        assert set.intersection(*inside)


def test_bands_reach_recall():
    bands, rows = substring_dedup.tune(0.8, 0.998)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.998


def test_empty_tables(none, spark):
    bench = spark.createDataFrame([("a", "b")], "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    outs = [
        decontamination.decontaminate(none, bench), substring_dedup.spans(none), license_rules.scan(none), packing.pack(none, queries.tokenizer_path()), secrets.find_secrets(none),
        secrets.redact(none), jaccard_join.join(none), quality_rules.judge(none), ordinal_quality.score(none, labels), sharding.shard(none),
        html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href=/a>menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><div id="sidebar"><p>Side text</p></div>%s
<div class="comments"><p>First!</p></div><form><input><button>Go</button></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("body, text", [
    ("<article><h1>Head</h1><p><b>One &amp; two.<br><p>Three\n  <i>fo</i>ur</p><ul><li>a<li>b</ul></article>", "Head One & two. Three four a b"),
    ("<div class=post><h1>Head</h1><p>Some words of text here.</p><p>More words follow, then an end.</p></div>", "Head Some words of text here. More words follow, then an end."),
    ("<article><header><h1>Own head</h1></header><p>x &lt;b&gt; &#233;&nbsp;y</p><aside>not this</aside><div class='ad'>buy</div></article>", "Own head x <b> é y"),
    ("<main><p>short</p></main>", "short"),
    ("<div class='layout no-sidebar'><p>Text of the page, and more of it.</p><p hidden>unseen</p></div>", "Text of the page, and more of it."),
    ("", ""),
])
def test_html(body, text):
    assert html_text.main_text(PAGE % body) == text


LONG = "<h1>Head</h1><p>" + "Some words of text here, and more of them follow. " * 6 + "</p><p>More words, then an end.</p>"
LONG_TEXT = "Head " + "Some words of text here, and more of them follow. " * 6 + "More words, then an end."


@pytest.mark.parametrize("wrapper", [
    "<form id=aspnetForm>%s</form>", "<div class='content-sidebar-wrap'>%s</div>", "<div class='page-with-left-sidebar'>%s</div>", "<div class='social-science'>%s</div>",
    "<section class='related-work'>%s</section>", "<div id='search-results'>%s</div>", "<form><div class=widget><div id=banner>%s</div></div></form>",
])
@pytest.mark.parametrize("inner", ["%s", "<article>%s</article>", "<div class=sidebar><p>Side</p></div><main>%s</main>"])
def test_html_wrappers_are_no_marks(wrapper, inner):
    assert html_text.main_text(PAGE % (wrapper % (inner % LONG))) == LONG_TEXT
    assert html_text.main_text(wrapper % (PAGE % (inner % LONG))) == LONG_TEXT


def test_html_wrapper_of_a_short_article():
    """The only article is kept though most of the text is elsewhere; a teaser or comment beside one is not."""
    other = "<div class=comments>" + "<div class=comment><p>Long words of someone.</p></div>" * 50 + "</div>"
    assert html_text.main_text(PAGE % ("<form><div class=widget><article><p>Short.</p></article></div></form>" + other)) == "Short."
    teaser = "<div class=related><article><p>Another one.</p></article></div>"
    assert html_text.main_text(PAGE % ("<main><article><p>Short text.</p></article>" + teaser + "</main>")) == "Short text."


def test_html_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text only"), (4, "u", "<p>a<p>" + "<div>" * 5000 + "deep"), (4, "u", "<p>a<p>" + "<div>" * 5000 + "deep"), (None, None, "<p")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((repr(r.page_id), r.text) for r in got) == sorted([("1", ""), ("2", ""), ("3", "plain text only"), ("4", "a deep"), ("4", "a deep"), ("None", "<p")])
    assert all(r.n_chars == len(r.text) for r in got)


def test_classifier_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    docs, labels = queries.read(spark, sf, "documents"), queries.read(spark, sf, "labels")
    half = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    got = ordinal_quality.score(docs, half).join(held, "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1 and not r.toxic]
    toxic = [r.kept for r in got if r.toxic]
    assert sum(clean) / len(clean) > 0.97 and sum(toxic) / len(toxic) < 0.1
    assert all(0 <= r.p_good <= r.p_fair <= 1 for r in got)


def test_classifier_without_labels(docs, spark):
    got = ordinal_quality.score(docs, spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"))
    assert got.where("kept").count() == docs.count()
    assert ordinal_quality.select(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).columns == docs.columns
