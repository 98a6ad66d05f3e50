"""Packing of tokenized documents into sequences of bounded length.

Method: bounded-space online best fit.  A packer keeps a fixed number of open
sequences; a bitset with one bit for each amount of free space tells the
fullest one that still takes a piece.  When a piece fits nowhere and all places
are taken, the fullest open sequence closes.

Documents are tokenized where they are read, and only lengths and checksums go
on.  Pieces are then dealt at random (by a hash of their row) to groups of
about ``GROUP_TOKENS`` tokens; each group is packed in one pass with memory for
its open sequences only, and leaves at most ``OPEN`` partly filled sequences.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialspark.llm.common import chunks, keep, map_arrow, parts, remembered, text_buffers

LIMIT = 4096
END_ID = 1
OPEN = 1024
GROUP_TOKENS = 1 << 28
#: Words a worker remembers; it starts anew beyond, so memory stays bounded.
MEMORY = 1_000_000

#: Pieces encoded in one call.
TOGETHER = 1000

#: Pre-token rule of the word vocabulary, for words of common letters (fixed value); a line end closes a word.
PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordIds:
    """Token ids of words, by the tokenizer, remembered as little-endian bytes.

    The vocabulary's rules never look across white space, so the ids of a text
    are those of its words in turn.  Within a word of Latin letters without
    special strings, the same holds for runs of letters, digits and signs; runs
    not met before are encoded many at a time.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_pieces(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), TOGETHER):
            group = pieces[i: i + TOGETHER]
            got = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            ids, of = np.array(got.ids, "<u4"), np.array(got.word_ids, np.int64)
            if len(of) and (of[-1] + 1 != len(group) or of[0] != 0 or (np.diff(of) > 1).any()):
                self.pieces.update((p, self.encode(p)) for p in group)  # some piece is not one pre-token
                continue
            raw, cut = ids.tobytes(), (4 * np.searchsorted(of, np.arange(len(group) + 1))).tolist()
            self.pieces.update(zip(group, (raw[a:b] for a, b in zip(cut, cut[1:], strict=False)), strict=True))

    def _learn(self, missing: set[bytes]) -> None:
        if len(self.words) > MEMORY:
            self.words.clear()
            self.pieces.clear()
        plain, folded = [], []
        for w in missing:
            text = w.decode()
            if "<|" in text or (not text.isascii() and max(text) >= "\u0250"):
                self.words[w] = self.encode(text)
            else:
                plain.append(w)
                folded.append(text.lower() if text.isascii() else text)
        found = PIECES.findall("\n".join(folded) + "\n") if folded else []
        self._encode_pieces(list(set(found) - self.pieces.keys() - {"\n"}))
        get, parts, n = self.pieces.get, [], 0
        for p in found:
            if p == "\n":
                self.words[plain[n]] = b"".join(parts)
                parts, n = [], n + 1
            else:
                parts.append(get(p))

    def of(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode().split() for t in texts]
        missing = set(itertools.chain.from_iterable(split)) - self.words.keys()
        if missing:
            # what is known may be forgotten to make room, so a text's words are learned together
            if len(self.words) > MEMORY:
                missing = set(itertools.chain.from_iterable(split))
            self._learn(missing)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


def tokenized(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """(_uid, doc_id, piece, start, length, ids_crc32[, ids]): pieces of at most ``limit`` ids.

    A document is its ids and one end id; a null or empty text is the end id
    alone.  Only documents longer than ``limit`` are cut.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = remembered(("words", path), lambda: WordIds(path))
        uids, ids, doc, piece, start, length, crc, held = (batch.column("_uid").to_pylist(), batch.column("doc_id").to_pylist(), [], [], [], [], [], [])
        uid = []
        end = np.array([END_ID], "<u4").tobytes()
        texts = batch.column("text")
        raws = itertools.chain.from_iterable(words.of(texts.slice(lo, hi - lo).to_pylist()) for lo, hi in chunks(text_buffers(texts)[1], 4 << 20))
        for u, d, raw in zip(uids, ids, (r + end for r in raws), strict=True):
            for n, at in enumerate(range(0, len(raw), 4 * limit)):
                part = raw[at: at + 4 * limit]
                uid.append(u)
                doc.append(d)
                piece.append(n)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    held.append(np.frombuffer(part, "<u4").astype(np.int32))
        cols = [pa.array(uid, pa.int64()), pa.array(doc, batch.column("doc_id").type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["_uid", "doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols, names = [*cols, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    slim = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    return map_arrow(slim, run, f"_uid long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


class Packer:
    """Best fit with at most ``places`` open sequences of ``limit`` ids."""

    def __init__(self, limit: int = LIMIT, places: int = OPEN) -> None:
        self.limit, self.places = limit, places
        self.bits = 0  # bit f: some open sequence has f ids free
        self.by_free: list[list[int]] = [[] for _ in range(limit + 1)]
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """Sequence and offset of the next piece."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open == self.places:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            sequence, free = self.made, self.limit
            self.made += 1
            self.open += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(sequence)
            self.bits |= 1 << rest
        else:
            self.open -= 1
        return sequence, self.limit - free

    def _take(self, free: int) -> int:
        sequence = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return sequence


def pack(pieces: DataFrame, limit: int = LIMIT, places: int = OPEN, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have ``_uid``, ``piece`` and ``length`` (at most ``limit``).

    Rows are put in the order of a hash, so a lost task packs the same way again.
    """
    total = int(pieces.agg(F.sum("length")).first()[0] or 0)
    groups = parts(total, group_tokens, 1)
    order = F.xxhash64("_uid", "piece")
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.col("_uid"), F.lit(7)), F.lit(groups)).cast("int"))
    dealt = dealt.repartition(groups, "_group").sortWithinPartitions("_group", order, "_uid", "piece")
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = -1, None
        for batch in batches:
            sequence, offset = [], []
            for g, n in zip(batch.column("_group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, packer = g, Packer(limit, places)
                s, o = packer.put(n)
                sequence.append((g << 40) + s)
                offset.append(o)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             names=[*names, "sequence_id", "offset"])

    schema = pieces.limit(0).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT,
                   places: int = OPEN, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Repeated rows and rows without an id are packed each.  With ``with_ids`` the
    rows carry their token ids: joined by offset, they are the sequences.
    """
    pieces = keep(tokenized(docs, path, doc_id, text, limit, with_ids), "pieces")
    return pack(pieces, limit, places).drop("_uid")
