"""Secret scans: fixed patterns, and a battery of randomness tests on strings that look encoded.

A candidate is a run of encoding characters with at least two kinds of them; its encoding (hex, base32, base64)
is inferred from its characters. Three tests take a random string as null: chi-squared uniformity over the
alphabet, runs above and below the alphabet's middle, and correlation of neighbours; Fisher's method combines
them. Short strings give the tests little power, so the share of non-random strings among those that pass is
controlled per encoding and length: where random strings are uniform in p, twice the count above one half
estimates how many there are, and the threshold is the smallest one whose estimated share of others stays
within ``fdr``. Where too few strings pass for such an estimate, a fixed level by length is the threshold, so that a
lone secret does not depend on its half of the p-values. The counts cover all documents and are a bounded table (encodings x lengths x bins).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import arrow_type, map_rows, slices

# The base patterns, by kind in listed order.
ASSIGN = re.compile(
    rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

LEAST = 16
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
HEX_ONLY, BASE32_ONLY = re.compile(rb"[0-9a-f]+|[0-9A-F]+"), re.compile(rb"[A-Z2-7]+")
ALPHABETS = {
    "hex": b"0123456789abcdef",
    "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BINS = 50
# Fewer strings than this at or above the level of their length tell no share of random ones; then the level holds.
THIN = 20


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def encoding(s: bytes) -> str | None:
    """The narrowest alphabet of a string with two kinds of characters or more; None for plain words."""
    digits = any(48 <= c <= 57 for c in s)
    lower, upper = s != s.upper(), s != s.lower()
    if digits + lower + upper < 2 or not digits and not (lower and upper):
        return None
    if HEX_ONLY.fullmatch(s):
        return "hex"
    return "base32" if BASE32_ONLY.fullmatch(s) else "base64"


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _index(letters: bytes) -> np.ndarray:
    table = np.full(256, -1)
    table[list(letters)] = range(len(letters))
    if b"+" in letters:
        table[list(b"-_")] = table[list(b"+/")]
    return table


INDEX = {name: _index(letters) for name, letters in ALPHABETS.items()}


def battery(s: bytes) -> tuple[str, float] | None:
    """Encoding and combined p-value of a string; None where it is no candidate."""
    s = s.strip(b"=")
    name = encoding(s) if len(s) >= LEAST else None
    if name is None:
        return None
    x = INDEX[name][np.frombuffer(s.lower() if name == "hex" else s, np.uint8)]
    x = x[x >= 0].astype(float)
    n, k = len(x), len(ALPHABETS[name])
    if n < LEAST:
        return None
    counts = np.bincount(x.astype(int), minlength=k)
    chi, df = float(((counts - n / k) ** 2).sum() * k / n), k - 1
    p = [_upper_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))]
    above = x >= k / 2
    n1 = int(above.sum())
    n0 = n - n1
    if n1 and n0:
        mean = 1 + 2 * n0 * n1 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((above[1:] != above[:-1]).sum())
        p.append(2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    d = x - x.mean()
    spread = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / spread if spread else 1.0
    p.append(2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n)))
    half = -sum(math.log(max(v, 1e-300)) for v in p)
    return name, math.exp(-half) * (1 + half + half * half / 2)


def stratum(name: str, length: int) -> str:
    """Encoding and length class (powers of two)."""
    return f"{name}-{length.bit_length()}"


def level(name: str) -> float:
    """The p a string of a stratum needs where counts tell nothing: random strings fail that often. The tests gain
    power with length, so less is asked of longer ones."""
    return {5: 0.24, 6: 0.1}.get(int(name.rpartition("-")[2]), 1 / BINS)


def candidates(text: bytes) -> list[tuple[int, int, str, float]]:
    """(start, end, stratum, p) in bytes."""
    out = []
    for m in CANDIDATE.finditer(text):
        if got := battery(m[0]):
            out.append((m.start(), m.end(), stratum(got[0], m.end() - m.start()), got[1]))
    return out


def _code_points(text: bytes):
    """A function from byte to code point places."""
    return (lambda b: b) if text.isascii() else lambda b: len(text[:b].decode("utf-8", "replace"))


def _scan_batch(batch: pa.RecordBatch) -> dict[str, object]:
    base, extra = [], []
    for text in batch.column("text").to_pylist():
        text = text or b""
        found, more = base_spans(text), candidates(text)
        at = _code_points(text) if found or more else None
        base.append([{"start": at(a), "kind": k, "end": at(b)} for a, k, b in sorted(found)])
        extra.append([{"start": at(a), "end": at(b), "stratum": s, "p": p} for a, b, s, p in more])
    return {"doc_id": batch.column("doc_id"), "base": base, "tested": extra}


SCANNED = {
    "base": pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])),
    "tested": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("p", pa.float64())])),
}


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` with its base spans and tested strings, in code points; written once, without the texts."""
    rows = docs.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return cut(map_rows(rows, _scan_batch, {"doc_id": arrow_type(docs, "doc_id"), **SCANNED}))


def thresholds(scanned: DataFrame, fdr: float = 0.1) -> dict[str, float]:
    """Smallest passing p per stratum; one with many strings and none that fits passes nothing (2.0)."""
    held = (
        scanned.select(F.explode("tested").alias("t"))
        .groupBy(F.col("t.stratum").alias("s"), F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("b"))
        .count()
        .collect()
    )
    bins: dict[str, np.ndarray] = {}
    for s, b, n in held:
        bins.setdefault(s, np.zeros(BINS))[b] = n
    out = {}
    for s, n in bins.items():
        random = 2 * n[BINS // 2 :].sum()
        above = n[::-1].cumsum()[::-1]
        share = 1 - random * (1 - np.arange(BINS) / BINS) / np.maximum(above, 1)
        fit = np.flatnonzero((share <= fdr) & (above > 0))
        # At the lowest fitting bin: below 1 / BINS a random string falls once in BINS.
        out[s] = float(fit[0]) / BINS if len(fit) else 2.0
        if above[round(level(s) * BINS)] < THIN:
            out[s] = level(s)
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def find_secrets(docs: DataFrame, fdr: float = 0.1) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` for every row.

    Spans are those of the whole matches. A null or empty text has none. Repeated rows give repeated results;
    an empty table none. Columns other than doc_id and text are not read.
    """
    scanned = scan(docs)
    least = thresholds(scanned, fdr)
    own = F.col("tested")
    if least:
        table = F.create_map(*[F.lit(x) for kv in sorted(least.items()) for x in kv])
        own = F.filter(own, lambda t: t.p >= F.element_at(table, t.stratum))
    own = F.transform(own, lambda t: F.struct(t.start.alias("start"), F.lit(3).alias("kind"), t.end.alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", own))).alias("spans"), F.size(own).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, fdr: float = 0.1, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every found span replaced by ``mark``; all columns stay, and ``n_chars``, where there is
    one, follows the text. Thresholds come from a first scan of all rows. Null texts stay null."""
    least = thresholds(scan(docs), fdr)
    put = mark.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    spans = [(a, b) for a, _, b in base_spans(text)]
                    spans += [(a, b) for a, b, s, p in candidates(text) if p >= least.get(s, 2.0)]
                    if spans:
                        texts[i] = _replaced(text, spans, put)
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _replaced(text: bytes, spans: list[tuple[int, int]], put: bytes) -> bytes:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return b"".join([*out, text[at:]])
