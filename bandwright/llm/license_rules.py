"""License scans: ordered signature rules with a keyword prefilter, in DataFrame functions only.

Texts are read as words. A rule is a regular expression over the words from a keyword on, and applies only where
its keyword stands; a text without any of the prefilter's strings is not cut into words at all. Both are derived
from the rules: keywords are all words a rule can begin with, and every match of a rule holds a prefilter string,
whatever separates its words. All rules of a keyword are tried at each of its places. A detection inside another
of the same or a better priority is suppressed; what is left gives labels and score.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_column

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Strings to look for before a text is cut into words; ``prefilter`` takes them, or others, so that every rule needs one.
PREFERRED = (
    "licen", "copyright", "permission", "redistribution", "domain", "commons", "reserved", "unauthorized", "gpl", "bsd", "spdx", "warranty", "unencumbered", "apache", "cc0",
    "cc by", "mpl 1", "mpl 2", "epl 1", "epl 2", "gfdl", "cddl", "eupl", "cecill", "bsl", "wtfpl", "odbl", "sspl", "rail", "attribution",
)
CONTEXT = 48
PRIORITIES = 5
# What stands between words, over lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Score of a detection by priority: grant text, licensed-under sentence, identifier, name, hint.
SCORES = (1.0, 0.95, 0.9, 0.75, 0.4)

V = r"(?: (?:v|version) ?\d+(?: \d+)?| \d+(?: \d+)?| v\d+(?: \d+)?)?"
LATER = r"(?: or (?:any |at your option any )?later(?: version)?| or newer| only)?"
# Name patterns by label, over lower-case words joined by single spaces.
NAMES = {
    "mit": [r"mit licen[cs]e", r"expat licen[cs]e", r"mit x11 licen[cs]e"],
    "mit-0": [r"mit no attribution(?: licen[cs]e)?", r"mit 0(?: licen[cs]e)"],
    "x11": [r"x11 licen[cs]e", r"x consortium licen[cs]e"],
    "apache": [r"apache(?: software)? licen[cs]e" + V],
    "apache-2.0": [r"apache(?: software)? licen[cs]e (?:v|version )?2(?: 0)?", r"apache 2(?: 0)?(?: licen[cs]e)?"],
    "apache-1.1": [r"apache(?: software)? licen[cs]e (?:v|version )?1 1"],
    "gpl": [r"(?:gnu )?general public licen[cs]e" + V + LATER, r"gnu gpl" + V, r"gpl" + V],
    "gpl-3.0": [r"(?:gnu )?general public licen[cs]e (?:v|version )?3(?: 0)?" + LATER, r"gpl ?v? ?3(?: 0)?", r"gplv3"],
    "gpl-2.0": [r"(?:gnu )?general public licen[cs]e (?:v|version )?2(?: 0)?" + LATER, r"gpl ?v? ?2(?: 0)?", r"gplv2"],
    "gpl-1.0": [r"(?:gnu )?general public licen[cs]e (?:v|version )?1(?: 0)?" + LATER, r"gplv1"],
    "lgpl": [r"(?:gnu )?(?:lesser|library) general public licen[cs]e" + V + LATER, r"gnu lgpl" + V, r"lgpl" + V],
    "lgpl-3.0": [r"(?:gnu )?lesser general public licen[cs]e (?:v|version )?3(?: 0)?" + LATER, r"lgplv3", r"lgpl 3(?: 0)?"],
    "lgpl-2.1": [r"(?:gnu )?lesser general public licen[cs]e (?:v|version )?2 1" + LATER, r"lgplv2 1", r"lgpl 2 1"],
    "agpl": [r"(?:gnu )?affero general public licen[cs]e" + V + LATER, r"gnu agpl" + V, r"agpl" + V],
    "agpl-3.0": [r"(?:gnu )?affero general public licen[cs]e (?:v|version )?3(?: 0)?" + LATER, r"agplv3", r"agpl 3(?: 0)?"],
    "gfdl": [r"(?:gnu )?free documentation licen[cs]e" + V + LATER, r"gfdl" + V],
    "bsd": [r"bsd(?: style)? licen[cs]e", r"berkeley software distribution licen[cs]e"],
    "bsd-2-clause": [r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"],
    "bsd-3-clause": [r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"],
    "bsd-4-clause": [r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?"],
    "0bsd": [r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[cs]e)?"],
    "isc": [r"isc licen[cs]e", r"internet systems consortium licen[cs]e"],
    "mpl": [r"mozilla public licen[cs]e" + V, r"mpl (?:1|2) \d"],
    "mpl-2.0": [r"mozilla public licen[cs]e (?:v|version )?2(?: 0)?", r"mpl 2 0"],
    "mpl-1.1": [r"mozilla public licen[cs]e (?:v|version )?1 1", r"mpl 1 1"],
    "epl": [r"eclipse public licen[cs]e" + V],
    "epl-2.0": [r"eclipse public licen[cs]e (?:v|version )?2(?: 0)?", r"epl 2 0"],
    "epl-1.0": [r"eclipse public licen[cs]e (?:v|version )?1(?: 0)?", r"epl 1 0"],
    "cddl": [r"common development and distribution licen[cs]e" + V, r"cddl" + V],
    "cpl": [r"common public licen[cs]e" + V],
    "eupl": [r"european union public licen[cs]e" + V, r"eupl" + V],
    "cecill": [r"cecill(?: (?:a|b|c))?(?: licen[cs]e)?" + V],
    "artistic": [r"(?:perl )?artistic licen[cs]e" + V, r"clarified artistic licen[cs]e"],
    "zlib": [r"zlib(?: libpng)? licen[cs]e"],
    "libpng": [r"libpng licen[cs]e"],
    "boost": [r"boost software licen[cs]e" + V, r"bsl 1 0"],
    "unlicense": [r"the unlicense", r"unlicense"],
    "wtfpl": [r"wtfpl", r"do what the (?:fuck|f) you want to public licen[cs]e"],
    "cc0": [r"cc0(?: 1 0)?(?: universal)?", r"creative commons zero" + V],
    "cc-by": [r"cc by(?: \d \d)?", r"creative commons attribution(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"],
    "cc-by-sa": [r"cc by sa(?: \d \d)?", r"creative commons attribution share ?alike(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"],
    "cc-by-nc": [r"cc by nc(?: \d \d)?", r"creative commons attribution non ?commercial(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"],
    "cc-by-nd": [r"cc by nd(?: \d \d)?", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: \d \d)?(?: licen[cs]e)?"],
    "cc-by-nc-sa": [r"cc by nc sa(?: \d \d)?", r"creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: licen[cs]e)?"],
    "cc-by-nc-nd": [r"cc by nc nd(?: \d \d)?", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: \d \d)?(?: licen[cs]e)?"],
    "odbl": [r"open (?:data commons open )?database licen[cs]e" + V, r"odbl" + V],
    "odc-by": [r"open data commons attribution licen[cs]e" + V],
    "pddl": [r"public domain dedication and licen[cs]e" + V],
    "ofl": [r"(?:sil )?open font licen[cs]e" + V],
    "postgresql": [r"postgresql licen[cs]e"],
    "python": [r"(?:python software foundation|psf|python) licen[cs]e" + V],
    "php": [r"php licen[cs]e" + V],
    "ruby": [r"ruby licen[cs]e"],
    "openssl": [r"openssl licen[cs]e"],
    "curl": [r"curl licen[cs]e"],
    "ncsa": [r"(?:university of illinois )?ncsa open source licen[cs]e"],
    "upl": [r"universal permissive licen[cs]e" + V],
    "afl": [r"academic free licen[cs]e" + V],
    "osl": [r"open software licen[cs]e" + V],
    "ms-pl": [r"(?:microsoft|ms) public licen[cs]e"],
    "ms-rl": [r"(?:microsoft|ms) reciprocal licen[cs]e"],
    "vim": [r"vim licen[cs]e"],
    "w3c": [r"w3c(?: software)?(?: notice and)? licen[cs]e"],
    "sleepycat": [r"sleepycat licen[cs]e"],
    "sspl": [r"server side public licen[cs]e" + V, r"sspl" + V],
    "bsl": [r"business source licen[cs]e" + V],
    "elastic": [r"elastic licen[cs]e" + V],
    "polyform": [r"polyform (?:noncommercial|small business|shield|strict) licen[cs]e" + V],
    "openrail": [r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?"],
    "llama": [r"llama \d?(?: \d)? ?community licen[cs]e"],
    "blueoak": [r"blue oak model licen[cs]e" + V],
}
# Identifiers after "spdx license identifier".
IDENTIFIERS = {
    "mit": "mit", "mit-0": "mit 0", "x11": "x11", "apache-2.0": "apache 2 0", "apache-1.1": "apache 1 1", "gpl-2.0": "gpl 2 0", "gpl-3.0": "gpl 3 0", "gpl-1.0": "gpl 1 0",
    "lgpl-2.1": "lgpl 2 1", "lgpl-3.0": "lgpl 3 0", "agpl-3.0": "agpl 3 0", "gfdl": "gfdl 1 3", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause", "bsd-4-clause": "bsd 4 clause",
    "0bsd": "0bsd", "isc": "isc", "mpl-2.0": "mpl 2 0", "mpl-1.1": "mpl 1 1", "epl-2.0": "epl 2 0", "epl-1.0": "epl 1 0", "cddl": "cddl 1 0", "eupl": "eupl 1 2", "cecill": "cecill 2 1",
    "artistic": "artistic 2 0", "zlib": "zlib", "boost": "bsl 1 0", "unlicense": "unlicense", "wtfpl": "wtfpl", "cc0": "cc0 1 0", "cc-by": "cc by 4 0", "cc-by-sa": "cc by sa 4 0",
    "cc-by-nc": "cc by nc 4 0", "odbl": "odbl 1 0", "ofl": "ofl 1 1", "postgresql": "postgresql", "python": "python 2 0", "php": "php 3 01", "ncsa": "ncsa", "upl": "upl 1 0", "afl": "afl 3 0",
    "osl": "osl 3 0", "ms-pl": "ms pl", "ms-rl": "ms rl", "sspl": "sspl 1 0",
}
# Sentences of grant texts and notices.
GRANTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2.0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("zlib", r"this software is provided as is without any express or implied warranty"),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0", r"to the extent possible under law .{0,80}waived all copyright"),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("proprietary", r"all rights reserved"),
    ("proprietary", r"unauthorized (?:copying|use|reproduction) .{0,60}(?:strictly )?prohibited"),
]
HINTS = [("public-domain", r"public domain"), ("copyright", r"copyright (?:c )?(?:19|20)\d\d"), ("unknown", r"licen[cs]ed (?:under|by|to)"), ("unknown", r"licen[cs]e agreement")]
UNDER = r"(?:under|by|with) (?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?(?:version \d+(?: \d+)? of )?(?:the )?"
VERBS = ("licensed", "licenced", "released", "distributed", "available", "published", "covered", "governed", "redistributed", "provided", "offered")


def rules() -> list[tuple[str, str, str, int]]:
    """(keyword, regex, label, priority), in order, one for each word the regex can begin with."""
    out = []
    for label, body in GRANTS:
        out += [(w, body, label, 1) for w in _first_words(body)]
    for label, bodies in NAMES.items():
        body = "|".join(bodies)
        out += [(v, rf"{v} {UNDER}(?:{body})", label, 2) for v in VERBS]
        out += [(w, b, label, 4) for b in bodies for w in _first_words(b)]
    for label, name in IDENTIFIERS.items():
        out.append(("spdx", rf"spdx licen[cs]e identifier {name}(?: only| or later)?", label, 3))
    for label, body in HINTS:
        out += [(w, body, label, 5) for w in _first_words(body)]
    return [(k, rf"^(?:{body})(?= |$)", label, p) for k, body, label, p in out]


def _alternatives(body: str) -> list[str]:
    """The parts of a pattern between the ``|`` outside its groups."""
    out, depth = [""], 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _atoms(body: str) -> Iterator[tuple[str, bool]]:
    """The groups, classes and characters of a pattern without alternatives, and whether each must be there."""
    at = 0
    while at < len(body):
        end = at + 1
        if body[at] == "(":
            depth = 1
            while depth:
                depth += (body[end] == "(") - (body[end] == ")")
                end += 1
        elif body[at] == "[":
            end = body.index("]", at) + 1
        elif body[at] == "\\":
            end += 1
        atom = body[at:end]
        times = re.compile(r"[?+]|\{0,\d+\}|").match(body, end)[0]
        yield atom, times in ("", "+")
        at = end + len(times)


def _first_words(body: str) -> list[str]:
    """All words a pattern can begin with."""
    return list(dict.fromkeys(w for w, _ in _heads(body)))


def _heads(body: str) -> list[tuple[str, bool]]:
    """All starts of a pattern up to its first space, and whether that space is there."""
    out = []
    for part in _alternatives(body):
        heads = [("", False)]
        for atom, must in _atoms(part):
            if all(ended for _, ended in heads):
                break
            if atom.startswith("(?:"):
                more = _heads(atom[3:-1])
            elif atom.startswith("["):
                more = [(c, False) for c in atom[1:-1]]
            elif atom == " ":
                more = [("", True)]
            elif atom.isalnum():
                more = [(atom, False)]
            else:
                raise ValueError(f"no list of first words: {body}")
            more = more + [("", False)] * (not must)
            heads = list(dict.fromkeys(h if h[1] else (h[0] + m[0], m[1]) for h in heads for m in more))
        out += heads
    return out


def _needed(body: str) -> list[tuple[str, ...]]:
    """For each way through the groups that must be there: the strings, with spaces, that any match has."""
    out = []
    for part in _alternatives(body):
        ways = [("",)]
        for atom, must in _atoms(part):
            if must and atom.startswith("(?:"):
                ways = [(*w[:-1], w[-1] + m[0], *m[1:]) for w in ways for m in _needed(atom[3:-1])]
            elif must and (atom == " " or atom.isalnum()):
                ways = [(*w[:-1], w[-1] + atom) for w in ways]
            else:
                ways = [(*w, "") for w in ways]
        out += ways
    return list(dict.fromkeys(out))


def prefilter() -> list[str]:
    """Strings of which every match of every rule has one: a part of a word, or several words where all are short."""
    out = dict.fromkeys(())
    for body in dict.fromkeys(regex.removeprefix("^(?:").removesuffix(")(?= |$)") for _, regex, _, _ in rules()):
        for way in _needed(body):
            words = [w for run in way for w in run.split()]
            preferred = [s for s in PREFERRED if any(s in run for run in way)]
            longest = max(words, key=len)
            if not preferred and len(longest) < 3:
                longest = max((run.strip() for run in way), key=len)
            out[(preferred or [longest])[0]] = None
    return [s for s in out if not any(t != s and t in s for t in out)]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bare = F.trim(F.regexp_replace(F.translate(text, upper, upper.lower()), SEPARATORS, " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _base(words: Column) -> Column:
    def label(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in BASE:
            parts = phrase.split(" ")
            hit = w == parts[0]
            for j, part in enumerate(parts[1:], 1):
                hit = hit & (F.get(words, i + j) == part)
            out = F.when(hit, F.lit(name)).otherwise(out)
        return F.struct(i.cast("long").alias("at"), out.alias("label"))

    return F.filter(F.transform(words, label), lambda s: s.label.isNotNull())


def _detections(words: Column) -> Column:
    """All matches of all rules, by start, longest first, better priority first."""
    by_word: dict[str, list] = {}
    for key, regex, label, priority in rules():
        by_word.setdefault(key, []).append((regex, label, priority))
    held = {k: [{"regex": r, "label": label, "priority": p} for r, label, p in rs] for k, rs in by_word.items()}
    table = F.from_json(F.lit(json.dumps(held)), "map<string, array<struct<regex: string, label: string, priority: int>>>")
    anchors = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda a: a.w.isin(*by_word))

    def at(a: Column) -> Column:
        context = F.array_join(F.slice(words, a.i + 1, CONTEXT), " ")
        match = lambda c, r: F.regexp_substr(c, r.regex)
        found = lambda c: F.transform(
            F.try_element_at(table, a.w),
            lambda r: F.struct(
                a.i.alias("start"), (-a.i - F.size(F.split(match(c, r), " "))).alias("minus_end"), r.priority.alias("priority"), r.label.alias("label"), match(c, r).isNotNull().alias("hit")
            ),
        )
        return F.filter(_let(context, found), lambda d: d.hit)

    return F.array_sort(F.flatten(F.transform(anchors, at)))


def _unsuppressed(found: Column) -> Column:
    """Labels and best score of detections that no other one of the same or a better priority contains; equal
    places of one priority keep all their labels. The order puts every container first, so the largest end so
    far per priority decides."""
    start = F.struct(F.array(*[F.lit(0)] * PRIORITIES).alias("ends"), F.array(*[F.lit(-1)] * 3).alias("last"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    score = F.array(*[F.lit(s) for s in SCORES])

    def step(acc: Column, d: Column) -> Column:
        place = F.array(d.start, -d.minus_end, d.priority)
        inside = (F.get(acc.ends, d.priority - 1) >= -d.minus_end) & (acc.last != place)
        ends = F.transform(acc.ends, lambda e, p: F.when(p >= d.priority - 1, F.greatest(e, -d.minus_end)).otherwise(e))
        return F.struct(
            ends.alias("ends"), F.when(inside, acc.last).otherwise(place).alias("last"), F.when(inside, acc.labels).otherwise(F.array_union(acc.labels, F.array(d.label))).alias("labels"),
            F.when(inside, acc.score).otherwise(F.greatest(acc.score, F.get(score, d.priority - 1))).alias("score"),
        )

    return F.aggregate(found, start, step)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    A null or empty text has no words: zeros, null places, empty labels, score 0. Repeated rows give repeated
    results; an empty table none. Columns other than doc_id and text are not read.
    """
    body = text_column()
    low = F.lower(body)
    gate = F.lit(False)
    for s in prefilter():
        first, *more = s.split(" ")
        hit = F.contains(low, F.lit(first))
        gate = gate | (hit & F.rlike(low, F.lit(SEPARATORS.join((first, *more)))) if more else hit)
    # Base phrases may have any separators between their words; each holds "licen" and passes the prefilter.
    rows = docs.select("doc_id", F.regexp_count(body, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), F.when(gate, body).alias("text"))
    whole = lambda w: F.struct(_base(w).alias("base"), _unsuppressed(_detections(w)).alias("own"))
    got = rows.select("doc_id", "n_words", F.when(F.col("text").isNotNull(), _let(_words(F.col("text")), whole)).alias("r"))
    base, own = F.col("r.base"), F.col("r.own")
    none = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.transform(base, lambda b: b.label), none)))
    places = F.transform(base, lambda b: b.at)
    return got.select(
        "doc_id", "n_words", F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce(own.labels, none))), ",").alias("labels"),
        F.greatest(F.coalesce(own.score, F.lit(0.0)), F.when(F.size(base_labels) > 0, F.lit(SCORES[3])).otherwise(F.lit(0.0))).alias("score"),
    )
