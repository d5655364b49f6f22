"""Secret scans with multipart credential linking.

Base findings, each kind leftmost and non-overlapping, always reported: ``assign`` (a key word, ``:`` or ``=``, and a value of
6 or more characters), ``access`` (``AKIA...`` of 20 or more), ``hex`` (24 or more digits).  Weak candidates are names of
accounts (``id``), bare random-looking strings (``opaque``) and addresses of services (``endpoint``).  They are common in
clean text, so one is reported only when complementary parts co-occur in its scope: the paragraph (text between blank
lines), at most SCOPE code points away.  An ``id`` needs a secret; an ``opaque`` needs an access identifier; an
``endpoint`` needs both.  The join of candidates with parts is an interval join on sorted positions, so a text with many
parts costs n log n and no pairs are listed.

Defined results: null and empty texts have no findings; repeated rows give repeated rows; positions are code points, ends
exclusive; weak candidates that overlap a base finding are part of it and not reported again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, text

SCOPE = 240
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "id", "opaque", "endpoint")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ID = re.compile(r"""(?ai:\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}|(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}(?![0-9])""")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
FOUND = "array<struct<kind:string,start:int,stop:int>>"


def base_findings(t: str, has_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, stop)."""
    out = []
    if ":" in t or "=" in t:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in t:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t)]
    if has_hex:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(t)]
    return sorted(out)


class Near:
    """Which stretches, in order of their starts and not overlapping, lie within SCOPE of a place."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.stops = [s for s, _ in spans], []
        for _, e in spans:
            self.stops.append(max(e, self.stops[-1] if self.stops else e))

    def meets(self, start: int, stop: int) -> bool:
        k = bisect_right(self.starts, stop)
        return k > 0 and self.stops[k - 1] > start


def linked(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates whose complementary parts co-occur."""
    if ":" not in t and "=" not in t and "AKIA" not in t:
        return []  # no identifier and no endpoint: nothing can be complementary to an opaque string
    taken = Near([(s, e) for s, _, e in base])
    weak = {k: [m.span() for m in p.finditer(t)] for k, p in ((3, ID), (4, OPAQUE), (5, ENDPOINT))}
    weak = {k: [(s, e) for s, e in v if not taken.meets(s, e - 1)] for k, v in weak.items()}
    if not any(weak.values()):
        return []
    access = Near([(s, e) for s, k, e in base if k == 1] + weak[3])
    secret = Near([(s, e) for s, k, e in base if k != 1] + weak[4])
    cuts = [m.start() for m in BLANK_LINE.finditer(t)]
    out = []
    for kind, spans in weak.items():
        for s, e in spans:
            k = bisect_left(cuts, s)
            lo = max(s - SCOPE, cuts[k - 1] if k else 0)
            hi = min(e + SCOPE, cuts[k] if k < len(cuts) else len(t))
            if (kind == 4 or secret.meets(lo, hi)) and (kind == 3 or access.meets(lo, hi)):
                out.append((s, kind, e))
    return out


def findings(t: str | None, has_hex: bool = True) -> list[tuple[int, int, int]]:
    """All findings as (start, number of the kind, stop), in order."""
    base = base_findings(t or "", has_hex)
    return sorted(base + linked(t or "", base))


def redact(t: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each stretch of findings replaced by the mark."""
    if not t or not spans:
        return t
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [t[at:s], mark]
        at = max(at, e)
    return "".join([*out, t[at:]])


HEXADECIMAL = np.isin(np.arange(256), list(b"0123456789abcdef"))


def _has_hex(column: pa.Array, least: int = 24) -> np.ndarray:
    """Which rows have a run of hexadecimal digits that long (exact, on bytes)."""
    b, off = text.raw(column)
    out = np.zeros(len(off) - 1, bool)
    for i, j in text.runs(off):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], HEXADECIMAL[b[off[i] : off[j]]].view(np.int8), [0]])))
        long = edge[::2][edge[1::2] - edge[::2] >= least]
        stops = edge[1::2][edge[1::2] - edge[::2] >= least]
        ends = off[i + 1 : j + 1] - off[i]
        for x, y in zip(np.searchsorted(ends, long, "right"), np.searchsorted(ends, stops - 1, "right")):
            out[i + x : i + y + 1] = True  # a run over the end of a row marks both, and the expression decides
    return out


def _found(column: pa.Array, marked: bool) -> pa.Array:
    """Findings of each text; with ``marked``, the redacted text of those that have any."""
    _, off = text.raw(column)
    parts = []
    for i, j in text.runs(off, 4 * text.PIECE):
        part = column.slice(i, j - i)
        found, texts = [], []
        for t, x in zip(part.to_pylist(), _has_hex(part)):
            spans = findings(t, bool(x))
            found.append([{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in spans])
            texts.append(redact(t, spans) if marked and spans else None)
        parts.append(pa.StructArray.from_arrays([pa.array(found, _SPANS), pa.array(texts, pa.string())], names=["found", "redacted"]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("found", _SPANS), ("redacted", pa.string())]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def scan_secrets(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, redacted: str | None = None, out: str = "found") -> DataFrame:
    """The columns ``keep`` (default: all) and the findings, in a column named ``out``; with ``redacted``, that kept column has the text
    with its findings replaced.  A column named as ``out`` gives way."""
    store.lean(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c != out]
    scan = text.column_function(lambda t: _found(t, redacted is not None), f"struct<found:{FOUND},redacted:string>")
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"), scan(F.col(text_col)).alias("__scan"))
    mine = lambda c: F.when(F.col("__scan.redacted").isNotNull(), F.col("__scan.redacted")).otherwise(F.col("__text")).alias(c)
    return rows.select(*[mine(c) if c == redacted else F.col(f"`{c}`") for c in keep], F.col("__scan.found").alias(out))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_secrets(store.table(spark, sf_dir, "documents"), keep=["doc_id"])
    joined = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return rows.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLE_SQL: dict[str, str] = {}
