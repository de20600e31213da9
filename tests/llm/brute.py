"""Plain Python versions of the contracts."""

import hashlib
import re
import zlib

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOWN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return ALNUM.findall((text or "").translate(DOWN))


def spaced(text):
    return SPACED.findall(text or "")


def contamination(text, items, k=10):
    w = alnum(text)
    hit, who = set(), []
    for item, body in items:
        x = alnum(body)
        grams = {tuple(x[i : i + k]) for i in range(max(1, len(x) - k + 1))} if x else set()
        seen = False
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    seen = True
                    hit.update(range(i, i + len(g)))
        if seen:
            who.append(str(item))
    return len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)


def license_base(text):
    w = alnum(text)
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    places = [(i, l) for p, l in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({l for _, l in places}))


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    n = [sum(k == j for _, k, _ in spans) for j in range(3)]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*n, hashlib.sha256(joined.encode()).hexdigest()), joined


def shingle_set(text, k):
    w = spaced((text or "").translate(DOWN))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def linked(rows, k, num, den):
    """doc_id to (set size, component) of (doc_id, text) rows."""
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def quality(text):
    text = text or ""
    w = spaced(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    grams, hit = {}, set()
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            hit.update(j for i in at for j in range(i, i + 3))
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def crc(text):
    return zlib.crc32((text or "").encode())
