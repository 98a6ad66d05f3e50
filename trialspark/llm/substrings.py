"""Removal of word windows that occur more than once in a corpus.

Method: difference-cover anchors.  A perfect difference set D modulo P has, for
any two positions i and j, an offset d < P with i + d and j + d both in D
(modulo P).  Only windows of ``ANCHOR = length - P + 1`` words at positions in D
are hashed, so two equal windows of ``length`` words share one aligned anchor.
Repeated anchors then extend: each window of full length that holds one at the
right place is hashed over all its words, and only windows whose full hash
(96 bits) occurs again count as repeated.

Keys travel in blocks: a task sends each key once, with a flag if it met it
several times, to the block that owns the key's range.  A passage that a third
of all documents share thus costs one entry a task, not one a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import (chunks, map_arrow, mix, parts, text_buffers, text_bytes, window_hashes, window_starts,
                                   word_hashes, word_spans)

#: Perfect difference sets: period and cover positions (fixed values).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
#: Text bytes for each block of keys.
BLOCK_BYTES = 8 << 20

_BLOCK = "block int, known boolean, uids binary, doc binary, pos binary, h binary, h2 binary, multi binary"


def cover_of(length: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover for windows of ``length`` words: anchors keep at least 5 words."""
    fit = [p for p in COVERS if length - p + 1 >= 5]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def drop_repeats(docs: DataFrame, length: int = 35, text: str = "text") -> DataFrame:
    """Take out each word that lies in a window of ``length`` words found elsewhere.

    Returns the rows of ``docs`` with the columns ``n_words``, ``n_removed`` and
    ``kept`` (kept words joined by one space) added.  Windows are judged on the
    input.  A null or empty text has no words and keeps ''.  Repeated rows are
    separate texts: both lose what they share.  A column of ``docs`` that has
    one of the added names is replaced.  ``docs`` must be a table or give the
    same rows in the same order when it is read again.
    """
    added = ("n_words", "n_removed", "kept")
    names = docs.drop(*added).columns
    inner = [f"c{i}" for i in range(len(names))]
    body = inner[names.index(text)]
    base = docs.drop(*added).toDF(*inner).withColumn("_uid", F.monotonically_increasing_id())
    blocks = parts(text_bytes(docs, text), BLOCK_BYTES)
    period, cover = cover_of(length)

    anchors = repeated(base.select("_uid", F.col(body).alias("_text")), _anchors(period, cover, length - period + 1), blocks)
    dealt = base.repartition(blocks, "_uid")  # once for both joins: the exchange is reused
    windows = repeated(dealt.join(anchors, "_uid").withColumn("_text", F.col(body)), _windows(period, length), blocks)
    marked = dealt.join(windows.withColumnRenamed("_pos", "_at"), "_uid", "left").drop("_uid")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, n_removed, kept = [], [], []
        for t, at in zip(batch.column(body), batch.column("_at"), strict=True):
            words = (t.as_py() or "").encode().split()
            n_words.append(len(words))
            if at.is_valid:
                gone = _covered(at.values.to_numpy(zero_copy_only=False), len(words), length)
                words = [w for w, g in zip(words, gone, strict=True) if not g]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        cols = [batch.column(c) for c in inner]
        cols += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

    schema = docs.drop(*added).limit(0).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit("")}).schema
    return map_arrow(marked, cut, schema)


def _covered(at: np.ndarray, n: int, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:n]) > 0


def _narrow(x: np.ndarray) -> bytes:
    """Small integers with 2 or 4 bytes each, which the first byte tells."""
    width = 2 if len(x) == 0 or x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1)


Keys = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _anchors(period: int, cover: tuple[int, ...], size: int) -> Callable[[pa.RecordBatch, int, int, np.ndarray, np.ndarray], Keys]:
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True

    def keys(batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, off: np.ndarray) -> Keys:
        start, end, row = word_spans(data, off)
        base = np.searchsorted(row, np.arange(hi - lo))
        at = window_starts(row, size)
        pos = at - base[row[at]]
        pick = in_cover[pos % period]
        at, pos = at[pick], pos[pick]
        h = window_hashes(word_hashes(data, start, end), at, size)
        return row[at], pos, h, np.zeros(0, np.uint32)

    return keys


def _windows(period: int, length: int) -> Callable[[pa.RecordBatch, int, int, np.ndarray, np.ndarray], Keys]:
    def keys(batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, off: np.ndarray) -> Keys:
        start, end, row = word_spans(data, off)
        base = np.searchsorted(row, np.arange(hi - lo + 1))
        lists = batch.column("_pos").slice(lo, hi - lo)
        sizes = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(hi - lo), sizes)
        q = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + base[doc]
        first, last = np.maximum(base[doc], q - period + 1), np.minimum(q, base[doc + 1] - length)
        ok = last >= first
        edge = np.zeros(len(row) + 1, np.int64)
        np.add.at(edge, first[ok], 1)
        np.add.at(edge, last[ok] + 1, -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        words = word_hashes(data, start, end)
        h = window_hashes(words, at, length)
        h2 = (window_hashes(words ^ np.uint64(0xD6E8FEB86659FD93), at, length) >> np.uint64(32)).astype(np.uint32)
        return row[at], at - base[row[at]], h, h2

    return keys


def repeated(rows: DataFrame, keyed: Callable[..., Keys], blocks: int) -> DataFrame:
    """(_uid, _pos): positions whose key occurs more than once among all rows.

    ``keyed`` gives row, position and hash of the keys of a range of rows.
    """
    shift = np.uint64(64 - 32)

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        uid = batch.column("_uid").to_numpy()
        data, off = text_buffers(batch.column("_text"))
        got = [[], [], [], []]
        for lo, hi in chunks(off):
            row, pos, h, h2 = keyed(batch, lo, hi, data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo])
            for k, x in enumerate((row + lo, pos, h, h2)):
                got[k].append(x)
        if not got[0]:
            return
        row, pos, h, h2 = (np.concatenate(x) for x in got)
        if not len(row):
            return
        wide = len(h2) > 0
        order = np.lexsort((h2, h)) if wide else np.argsort(h, kind="stable")
        row, pos, h = row[order], pos[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if wide:
            h2 = h2[order]
            new[1:] |= h2[1:] != h2[:-1]
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(h)))
        met = np.repeat(count > 1, count)
        block = ((h >> shift) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)  # rises with h
        cuts = np.searchsorted(block[head], np.arange(blocks + 1))
        out: list[tuple] = []
        for b in np.flatnonzero(np.diff(cuts)):
            i = head[cuts[b]: cuts[b + 1]]
            uids, doc = np.unique(uid[row[i]], return_inverse=True)
            out.append((int(b), False, uids.tobytes(), _narrow(doc), _narrow(pos[i]), h[i].tobytes(),
                        h2[i].tobytes() if wide else b"", met[i].tobytes()))
        again = np.flatnonzero(met)
        spread = int(mix(np.asarray(uid[:1]).astype(np.uint64))[0]) % blocks if len(uid) else 0  # row numbers step by powers of two
        for n, i in enumerate(np.array_split(again, max(1, min(blocks, len(again) // 4096)))):
            if len(i):
                uids, doc = np.unique(uid[row[i]], return_inverse=True)
                out.append(((spread + n) % blocks, True, uids.tobytes(), _narrow(doc), _narrow(pos[i]), b"", b"", b""))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])

    def meet(table: pa.Table) -> pa.Table:
        uid, pos, h, h2, multi, kept_uid, kept_pos = [], [], [], [], [], [], []
        for r in table.to_pylist():
            u = np.frombuffer(r["uids"], np.int64)[_wide(r["doc"])]
            p = _wide(r["pos"]).astype(np.int64)
            if r["known"]:
                kept_uid.append(u)
                kept_pos.append(p)
            else:
                uid.append(u)
                pos.append(p)
                h.append(np.frombuffer(r["h"], np.uint64))
                h2.append(np.frombuffer(r["h2"], np.uint32))
                multi.append(np.frombuffer(r["multi"], bool))
        if h:
            uid, pos, h, h2, multi = (np.concatenate(x) for x in (uid, pos, h, h2, multi))
            order = np.lexsort((h2, h)) if len(h2) else np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            if len(h2):
                same &= h2[order][1:] == h2[order][:-1]
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            pick = twice & ~multi  # those met several times in a task are known there
            kept_uid.append(uid[pick])
            kept_pos.append(pos[pick])
        u, p = np.concatenate(kept_uid), np.concatenate(kept_pos)
        to = (mix(u.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        u, p, to = u[order], p[order], to[order]
        out: list[tuple] = []
        for lo, hi in _runs(to):
            uids, doc = np.unique(u[lo:hi], return_inverse=True)
            out.append((int(to[lo]), uids.tobytes(), _narrow(doc), _narrow(p[lo:hi])))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["home", "uids", "doc", "pos"])

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        u = np.concatenate([np.frombuffer(r["uids"], np.int64)[_wide(r["doc"])] for r in rows])
        p = np.concatenate([_wide(r["pos"]).astype(np.int32) for r in rows])
        order = np.argsort(u, kind="stable")
        u, p = u[order], p[order]
        first = [lo for lo, _ in _runs(u)]
        lists = pa.ListArray.from_arrays(pa.array([*first, len(u)], pa.int32()), pa.array(p))
        return pa.Table.from_arrays([pa.array(u[first], pa.int64()), lists], names=["_uid", "_pos"])

    sent = map_arrow(rows, send, _BLOCK)
    hits = sent.groupBy("block").applyInArrow(meet, "home int, uids binary, doc binary, pos binary")
    return hits.groupBy("home").applyInArrow(gather, "_uid long, _pos array<int>")


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(x):
        return []
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True))
