"""Credential scan with linking of parts that are weak alone.

Base kinds are found by pattern in every text.  Weak parts (a user name, a bare
40-character key, an address) are reported only if the parts that complete them
stand in the same scope: the same paragraph, at most ``REACH`` code points
apart.  Linking is an interval join: parts fall into buckets of ``REACH`` code
points, a weak part asks its own and both neighbouring buckets, and a semi join
on (text, paragraph, bucket) with the distance as condition answers.  A bucket
is a short piece of one text, so no join group grows with the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import chunks, fresh, keep, map_arrow, text_buffers, word_spans

#: Kinds in report order: three base kinds, then weak ones (fixed values).
KINDS = ("assign", "access", "hex", "user", "key", "address")
REACH = 300

#: Base patterns with the least length of the group that counts (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Weak patterns.
USER = re.compile(r"""(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""", re.IGNORECASE | re.ASCII)
KEY = re.compile(r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
SCHEME = re.compile(r"[a-z][a-z0-9+.-]{1,20}$")
REST = re.compile(r"""//[^\x20\x09-\x0D"'<>]+""")
PORT = re.compile(r"[0-9]{2,5}")
#: Read backwards from a colon: the labels of a host.
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_USERS = (b"user", b"login", b"client", b"account")


def _plain(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """Parts that may hold blanks: (kind, start, end) in code points."""
    out = []
    if any(w in low for w in _WORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if any(w in low for w in _USERS):
        out += [(3, *m.span()) for m in USER.finditer(text)]
    return out


def addresses(word: str) -> list[tuple[int, int]]:
    """Spans of scheme://rest and host.name:port, leftmost first, without overlaps.

    Each begins at a colon and is read backwards from it up to the colon before,
    so a word of any length is read once.
    """
    out, end, colon = [], 0, word.find(":")
    while colon >= 0:
        last = max(end, word.rfind(":", end, colon) + 1) if colon > end else end
        found = None
        if word.startswith("//", colon + 1) and (scheme := SCHEME.search(word[max(last, colon - 21): colon])) and (rest := REST.match(word, colon + 1)):
            found = max(last, colon - 21) + scheme.start(), rest.end()
        elif port := PORT.match(word, colon + 1):
            back = HOST.match(word[last:colon][::-1])
            if back:
                found = colon - back.end(), port.end()
        if found:
            out.append(found)
            end = found[1]
        colon = word.find(":", max(colon + 1, end))
    return out


def _solid(word: str, at: int) -> list[tuple[int, int, int]]:
    """Parts within one run of characters that are not white space."""
    out = [(1, *m.span()) for m in ACCESS.finditer(word) if len(m[0]) >= LEAST["access"]]
    out += [(2, *m.span()) for m in HEX.finditer(word) if len(m[0]) >= LEAST["hex"]]
    taken = sorted((s, e) for _, s, e in out)
    starts, ends = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]
    out += [(4, s, e) for s, e in (m.span() for m in KEY.finditer(word)) if ends[bisect_left(starts, e)] <= s]
    out += [(5, s, e) for s, e in addresses(word)]
    return [(k, s + at, e + at) for k, s, e in out]


def parts_of(batch: pa.RecordBatch) -> list[list[tuple[int, int, int, int]]]:
    """For each row of ``text``: (start, kind, end, paragraph), in that order."""
    column = batch.column("text")
    data, off = text_buffers(column)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(column))]
    for lo, hi in chunks(off):
        piece, cut = data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        raw = piece.tobytes()
        start, end, row = word_spans(piece, cut)
        points = np.append(0, np.cumsum((piece & 0xC0) != 0x80))
        colon = np.append(0, np.cumsum((piece == 0x3A)))
        pick = np.flatnonzero((end - start >= LEAST["access"]) | (colon[end] > colon[start]))
        for s, e, r in zip(start[pick].tolist(), end[pick].tolist(), row[pick].tolist(), strict=True):
            if found := _solid(raw[s:e].decode(), int(points[s] - points[cut[r]])):
                out[lo + r] += [(b, k, f, 0) for k, b, f in found]
        low = raw.lower()
        if any(w in low for w in (*_WORDS, *_USERS)):
            for r in range(hi - lo):
                own = low[cut[r]: cut[r + 1]]
                if any(w in own for w in (*_WORDS, *_USERS)):
                    out[lo + r] += [(b, k, f, 0) for k, b, f in _plain(raw[cut[r]: cut[r + 1]].decode(), own)]
        for r in range(hi - lo):
            if out[lo + r]:
                text = raw[cut[r]: cut[r + 1]].decode()
                breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
                places = np.searchsorted(breaks, [p[0] for p in out[lo + r]]).tolist()
                out[lo + r] = sorted((b, k, e, int(g)) for (b, k, e, _), g in zip(out[lo + r], places, strict=True))
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_uid, doc_id, base, spans), one row per row of ``docs``.

    ``base`` and ``spans`` are lists of (start, kind, end), kind being an index
    of ``KINDS``, offsets in code points and ends exclusive; ``spans`` holds the
    base ones and the linked weak ones.  A null text is empty and has neither.
    Repeated rows are scanned each; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = pa.array([[dict(zip(("start", "kind", "end", "scope"), p, strict=True)) for p in ps] for ps in parts_of(batch)],
                         pa.list_(pa.struct([(n, pa.int64() if n in ("start", "end") else pa.int32()) for n in ("start", "kind", "end", "scope")])))
        yield pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("doc_id"), found], names=["_uid", "doc_id", "parts"])

    slim = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    rows = keep(map_arrow(slim, run, f"_uid long, doc_id {id_type}, parts array<struct<start:bigint,kind:int,end:bigint,scope:int>>"), "secret-parts")

    span = "x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)"
    linked = link(rows.select("_uid", F.inline("parts")))
    more = linked.groupBy("_uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    return (rows.withColumn("base", F.expr(f"transform(filter(parts, x -> x.kind < 3), {span})"))
            .join(more, "_uid", "left")
            .select("_uid", "doc_id", "base", F.expr("if(more is null, base, array_sort(concat(base, more)))").alias("spans")))


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts with their complement in scope.

    A user name needs a secret, a bare key needs an identifier, an address needs
    both.  Secrets are assigned values, hex strings and bare keys; identifiers
    are access keys and user names.
    """
    homes = F.explode(F.expr(f"sequence(floor(start / {reach}), floor(end / {reach}))"))  # a long part stands in all buckets that it covers
    secrets = parts.where("kind in (0, 2, 4)").withColumn("bucket", homes)
    names = parts.where("kind in (1, 3)").withColumn("bucket", homes)

    def with_near(weak: DataFrame, other: DataFrame) -> DataFrame:
        asks = weak.withColumn("bucket", F.explode(F.expr(f"sequence(floor(start / {reach}) - 1, floor((end + {reach}) / {reach}))"))).alias("w")
        gap = (F.col("o.start") - F.col("w.end") <= reach) & (F.col("w.start") - F.col("o.end") <= reach)
        other = other.select("_uid", "scope", "bucket", "start", "end").alias("o")
        same = (F.col("w._uid") == F.col("o._uid")) & (F.col("w.scope") == F.col("o.scope")) & (F.col("w.bucket") == F.col("o.bucket"))
        return asks.join(other, same & gap, "left_semi").drop("bucket").distinct()

    users = with_near(parts.where("kind = 3"), secrets)
    keys = with_near(parts.where("kind = 4"), names)
    places = with_near(with_near(parts.where("kind = 5"), secrets), names)
    return users.unionByName(keys).unionByName(places)


def listing(column: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), x.start, x.end)), ',')")


def count_of(kind: str, column: str = "base") -> F.Column:
    return F.expr(f"cast(size(filter({column}, x -> x.kind = {KINDS.index(kind)})) as bigint)")


MASK = "[SECRET]"


def mask(text: str, spans: list[dict]) -> str:
    """The text with each span, or run of overlapping spans, put in place of ``MASK``."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at: s["start"]], MASK]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the secrets in its texts masked; rows without secrets, and null texts, stay as they are.

    ``docs`` must be a table or give the same rows in the same order when it is
    read again.
    """
    names = docs.columns
    uid, held = fresh(names, "_uid"), fresh(names, "_spans")
    found = keep(scan(docs, doc_id, text).where("size(spans) > 0").select(F.col("_uid").alias(uid), F.col("spans").alias(held)), "secret-spans")
    rows = docs.withColumn(uid, F.monotonically_increasing_id()).join(found.hint("merge"), uid, "left").drop(uid)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, spans = batch.column(text), batch.column(held)
        if spans.null_count < len(spans):
            new = [t.as_py() if not s.is_valid else mask(t.as_py(), s.as_py()) for t, s in zip(texts, spans, strict=True)]
            texts = pa.array(new, pa.string())
        yield pa.RecordBatch.from_arrays([texts if c == text else batch.column(c) for c in names], names=names)

    return map_arrow(rows, run, docs.schema)
