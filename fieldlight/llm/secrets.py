"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they stand. Weak parts (identifiers, unlabelled keys,
endpoints) are common in clean text, so they are reported only where complementary parts lie in
one scope: spans are joined as intervals widened by the scope, identifiers with secrets, secrets
with identifiers or endpoints, endpoints with both.

Offsets are code points, ends exclusive. Null text is empty; overlapping kinds are all reported;
repeated rows give equal rows. Every pattern takes time in proportion to the text, however long its
runs are. A column of docs named spans is replaced; all others pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_columns

#: Fixed kinds, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
BASE = KINDS[:3]
#: Code points within which parts belong together.
SCOPE = 300
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_IDENT = re.compile(rb"(?:access|client|account|tenant)[_-]?(?:key[_-]?)?(?:id|name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}", re.I)
_BLOB = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}")
_SCHEME = re.compile(rb"[a-z0-9+.-]*")
_PLACE = re.compile(rb"[^\s\"'<>]+")


def _mixed(token: bytes) -> bool:
    return bool(re.search(rb"[a-z]", token) and re.search(rb"[A-Z]", token) and re.search(rb"[0-9]", token))


def endpoints(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of scheme://place, leftmost and non-overlapping: found by its middle, so no letter is tried twice."""
    out, at = [], 0
    while (mid := text.find(b"://", at)) >= 0:
        back = _SCHEME.match(text[at:mid][::-1]).end()
        head = text[mid - back : mid].lstrip(b"0123456789+.-")  # a scheme begins with a letter
        place = _PLACE.match(text, mid + 3) if head else None
        at = place.end() if place else mid + 3
        if place:
            out.append((mid - len(head), at))
    return out


def candidates(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of strong and weak parts, by bytes."""
    low = text.lower()
    out = []
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if b"access" in low or b"client" in low or b"account" in low or b"tenant" in low:
        out += [(m.start(), 3, m.end()) for m in _IDENT.finditer(text)]
    out += [(m.start(), 4, m.end()) for m in _BLOB.finditer(text) if _mixed(m[0])]
    if b"://" in text:
        out += [(s, 5, e) for s, e in endpoints(text)]
    return sorted(out)


def _near(a: list[tuple[int, int]], b: list[tuple[int, int]], scope: int) -> list[bool]:
    """For each interval of a, whether one of b lies within scope. Both are sorted by start."""
    starts = [s for s, _ in b]
    reach = np.maximum.accumulate([e for _, e in b]).tolist() if b else []
    out = []
    for s, e in a:
        k = bisect_right(starts, e + scope)  # those that begin before its end and scope
        out.append(bool(k and reach[k - 1] >= s - scope))
    return out


def linked(found: list[tuple[int, int, int]], scope: int) -> list[tuple[int, int, int]]:
    """Strong parts, and weak ones with their complement in scope."""
    groups = {k: [(s, e) for s, kind, e in found if kind in k] for k in ((1, 3), (0, 2, 4), (5,))}
    ids, secrets, ends = groups.values()
    kept = [x for x in found if x[1] < len(BASE)]
    if ids and secrets or secrets and ends:
        by_secret = set(x for x, ok in zip(ids, _near(ids, secrets, scope), strict=True) if ok)
        part = [a or b for a, b in zip(_near(secrets, ids, scope), _near(secrets, ends, scope), strict=True)]
        by_part = set(x for x, ok in zip(secrets, part, strict=True) if ok)
        both = [a and b for a, b in zip(_near(ends, ids, scope), _near(ends, secrets, scope), strict=True)]
        by_both = set(x for x, ok in zip(ends, both, strict=True) if ok)
        kept += [(s, k, e) for s, k, e in found if k == 3 and (s, e) in by_secret or k == 4 and (s, e) in by_part or k == 5 and (s, e) in by_both]
    return sorted(kept)


def scan(text: bytes, scope: int = SCOPE) -> list[dict]:
    """All spans of a text, by start, then kind."""
    found = candidates(text)
    if not found:
        return []
    if not text.isascii():
        heads = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
        found = [(int(heads[s]), k, int(heads[e])) for s, k, e in found]
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in linked(found, scope)]


def secret_spans(docs: DataFrame, *, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Adds spans, an array of (kind, start, end)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    ddl = "spans array<struct<kind:string,start:long,end:long>>"
    return with_columns(docs, text_col, ddl, [pa.list_(span)], lambda: lambda texts: [[scan(t, scope) for t in texts]])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, *, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with each run of overlapping spans replaced by [kind] of its first span. Null stays null."""
    def hide(raw: bytes) -> str:
        text, out, at = raw.decode("utf-8", "surrogatepass"), [], 0
        for s in scan(raw, scope):
            if s["start"] >= at:
                out += [text[at : s["start"]], f"[{s['kind']}]"]
            at = max(at, s["end"])
        return "".join(out) + text[at:]

    made = with_columns(docs, text_col, "_clean string", [pa.string()], lambda: lambda texts: [[hide(t) for t in texts]])
    return made.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col("_clean"))).select(docs.columns)
