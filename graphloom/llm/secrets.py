"""Secret scan: pattern matches, and entropy windows over candidate strings.

A candidate is a run of token characters. A window of WINDOW characters slides over it; the
window's Shannon entropy is held as S = sum c*log2(c) over the character counts, updated for
the one character that enters and the one that leaves. Each character class (hexadecimal,
one case and digits, mixed) has its own alphabet and threshold. A candidate is reported as
`entropy` from the first to the last character of its windows above the threshold, unless the
allow-list knows its shape or a pattern match overlaps it.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import documents, join_spans, map_texts

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits per character in a window of 20; the most possible is log2(20) = 4.32.
THRESHOLDS = {"hex": 3.0, "single_case": 3.4, "mixed": 3.6}
#: Fixed shapes that look random and are none: UUIDs, dates and numbers, versions, paths, counters.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9_=+/-]+",
    r"[A-Za-z_=+/-]+",
    r"(?:[A-Za-z]+|[0-9]{1,4})(?:[/_+=-]+(?:[A-Za-z]+|[0-9]{1,4}))+",
    r"(?:sha(?:1|256|384|512)|md5)-[A-Za-z0-9+/=]+",
    r"([A-Za-z0-9]{1,4})\1{4,}.{0,3}",
)
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")


def make_scanner(window: int = WINDOW):
    """Function of one text: (kind, start, end) of all secrets; code points, end exclusive."""
    from math import log2

    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    access = re.compile(r"AKIA[A-Z0-9]{16,}")
    hexes = re.compile(r"[0-9a-f]{24,}")
    candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % window)
    allowed = re.compile("|".join(f"(?:{x})" for x in ALLOWED))
    gain = [0.0] + [c * log2(c) - ((c - 1) * log2(c - 1) if c > 1 else 0.0) for c in range(1, window + 1)]

    def kind_of(s: str) -> str:
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
            return "hex"
        return "single_case" if s == s.lower() or s == s.upper() else "mixed"

    def random_part(s: str):
        """(start, end) of the windows of s at or above its class's threshold, else None."""
        least = THRESHOLDS[kind_of(s)]
        counts: dict[str, int] = {}
        total, first, last = 0.0, None, None
        for i, c in enumerate(s):
            counts[c] = n = counts.get(c, 0) + 1
            total += gain[n]
            if i >= window:
                old = s[i - window]
                total -= gain[counts[old]]
                counts[old] -= 1
            if i >= window - 1 and log2(window) - total / window >= least:
                first = i - window + 1 if first is None else first
                last = i + 1
        return None if first is None else (first, last)

    def scan(text: str | None) -> list[tuple[str, int, int]]:
        text = text or ""
        spans = []
        low = text.lower()
        if any(k in low for k in _NAMES):
            spans += [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            spans += [("access", m.start(), m.end()) for m in access.finditer(text)]
        if max(map(len, text.split()), default=0) < window:
            return spans
        spans += [("hex", m.start(), m.end()) for m in hexes.finditer(text)]
        known = sorted((s, e) for _, s, e in spans)
        at = 0
        for m in candidate.finditer(text):
            s = m[0]
            while at < len(known) and known[at][1] <= m.start():
                at += 1
            if allowed.fullmatch(s) or any(a < m.end() and m.start() < b for a, b in known[at : at + 4]):
                continue
            if part := random_part(s):
                spans.append(("entropy", m.start() + part[0], m.start() + part[1]))
        return spans

    return scan


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind,start,end,secret>> of every row of `docs(doc_id, text)`.

    Null and empty texts have no spans; rows without doc_id and repeated rows are kept as they
    are; other columns are ignored.
    """

    def make():
        scan = make_scanner()
        return lambda text: ([{"kind": k, "start": s, "end": e, "secret": text[s:e]} for k, s, e in sorted(scan(text), key=lambda x: (x[1], KINDS.index(x[0])))],)

    return map_texts(docs, make, "spans array<struct<kind:string,start:int,end:int,secret:string>>")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the pattern matches, and all spans, of every row of documents."""

    def make():
        scan = make_scanner()

        def digest(text):
            found = scan(text)
            base = [x for x in found if x[0] != "entropy"]
            counts = [sum(x[0] == k for x in base) for k in KINDS[:3]]
            return *counts, hashlib.sha256(join_spans(base, KINDS).encode()).hexdigest(), join_spans(found, KINDS)

        return digest

    return map_texts(documents(spark, sf_dir), make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
