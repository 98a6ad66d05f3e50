"""SentencePiece encoding and decoding of whole texts by vectorised merge rounds.

Method: the characters of all distinct words of a chunk of texts are one flat
array of symbols.  A round looks up the pairs that changed, finds the best rank
of each word by a segmented minimum, merges its occurrences from the left, all
at once, and compacts the array; words without a pair left leave it.  Rounds go
on until no word is left.

The library merges one pair at a time: the best score, the leftmost among
equals.  A round gives the same result if a merge cannot give rise to a pair
that is as good as itself.  Where the vocabulary allows that (``Vocabulary.
lures``), a round merges the leftmost occurrence only; long words of that kind
are finished by a heap.  A boundary that no piece of the vocabulary can span
splits its word, so words stay short whatever the text.

A vocabulary is read from its model file; nothing of it is kept here.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import _powers, chunks, fresh, map_arrow, mix, text_buffers

SPACE = 0x2581
#: Bytes of text encoded in one run of rounds.
TOGETHER = 2 << 20
#: Symbols beyond which a word that must merge one pair at a time goes to the heap.
LONG = 64
_NONE = np.int32(2**31 - 1)


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7, -1)
        if size == 0:
            yield key >> 3, varint()
        else:
            size = varint() if size < 0 else size
            yield key >> 3, message[at: at + size]
            at += size


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indexes of all ranges, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


class Vocabulary:
    """Symbols, pair ranks and byte strings of a BPE model file.

    Symbols are piece ids, then characters that occur in pieces without being
    one, then (from ``unknown``) any other code point.
    """

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        spec = {f: v for f, v in fields(sp.serialized_model_proto()) if f in (2, 3)}
        trainer, normalizer = dict(fields(spec[2])), dict(fields(spec[3]))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError(f"{path}: only BPE models that keep texts as they are can be encoded")
        self.dummy = bool(normalizer.get(3, 1))
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError(f"{path}: unused pieces are not known")
        self.byte_ids = np.full(256, self.unk, np.int32)
        byte_of = {i: int(names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        for i, b in byte_of.items():
            self.byte_ids[b] = i
        self.fallback = len(byte_of) == 256

        symbol = {names[i]: i for i in plain}
        loose = sorted({c for i in plain for c in names[i]} - symbol.keys())
        self.pieces, self.unknown = n, n + len(loose)
        known = symbol | {c: n + j for j, c in enumerate(loose)}
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.unknown
        for c, s in known.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        score = {i: sp.get_score(i) for i in plain}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs: dict[tuple[int, int], int] = {}
        get = known.get
        for name in symbol:
            size = len(name)
            for i in range(size - 1):
                for j in range(i + 1, size):
                    left = get(name[i:j])
                    if left is not None:
                        for k in range(j + 1, size + 1):
                            right = get(name[j:k])
                            if right is not None:
                                pairs[left, right] = symbol.get(name[i:k], -1) if k - i > 1 else -1
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        made = np.array(list(pairs.values()), np.int32)[order]
        self.keys = np.append(keys[order], np.int64(2**62))
        self.made = np.append(made, np.int32(-1))
        ranks = np.full(n + 1, _NONE, np.int32)
        for i, s in score.items():
            ranks[i] = rank[s]
        self.rank = ranks[self.made]
        #: Ranks of pieces that are half of a piece as good or better.
        self.lures = np.zeros(len(rank) + 1, bool)
        for (a, b), p in pairs.items():
            if p >= 0:
                for half in (a, b):
                    if half < n and len(names[half]) > 1 and ranks[p] <= ranks[half]:
                        self.lures[ranks[half]] = True
        #: Whether a space after another character always begins a word.
        self.spaced = not any(a != chr(SPACE) and b == chr(SPACE) for name in symbol for a, b in zip(name, name[1:], strict=False))

        texts = [b""] * n
        for i in plain:
            texts[i] = names[i].replace(chr(SPACE), " ").encode()
        for i, b in byte_of.items():
            texts[i] = bytes([b])
        texts[self.unk] = sp.decode([self.unk]).encode()
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(byte_of)] = True
        self.is_control = np.array([sp.is_control(i) for i in range(n)])
        self.opens = np.array([i in score and names[i].startswith(chr(SPACE)) for i in range(n)])

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in ``made`` and ``rank``; -1 if no piece can hold it."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, -1).astype(np.int32)

    def finish(self, symbols: list[int]) -> list[int]:
        """Merge one word to its end, one pair at a time."""
        size = len(symbols)
        after, before, alive = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size
        heap: list[tuple[int, int, int, int]] = []
        known: dict[tuple[int, int], tuple[int, int]] = {}  # (rank, piece) of pairs met before

        def offer(i: int) -> None:
            x, y = symbols[i], symbols[after[i]]
            if (x, y) not in known:
                p = int(self.look(np.array([x]), np.array([y]))[0])
                known[x, y] = (int(self.rank[p]), int(self.made[p])) if p >= 0 else (int(_NONE), -1)
            if known[x, y][1] >= 0:
                heapq.heappush(heap, (known[x, y][0], i, x, y))

        for i in range(size - 1):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if alive[i] else size
            if j >= size or symbols[i] != x or symbols[j] != y:
                continue
            symbols[i] = known[x, y][1]
            alive[j], after[i] = False, after[j]
            if after[j] < size:
                before[after[j]] = i
            for s in (before[i], i):
                if s >= 0 and after[s] < size:
                    offer(s)
        return [s for s, a in zip(symbols, alive, strict=True) if a]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols; ``word`` is their word, in order.  Returns the same when no pair is left."""
        done_s, done_w, done_at = [], [], []
        n = len(symbols)
        at = np.arange(n)  # place in the input, to put the parts in order again
        pair = np.full(n, -1, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self.look(symbols[inner], symbols[inner + 1])
        while n:
            cut = np.flatnonzero(np.append(True, pair[:-1] < 0))  # parts that no piece can span
            sizes = np.diff(np.append(cut, n))
            rank = np.where(pair >= 0, self.rank[pair], _NONE)
            best = np.minimum.reduceat(rank, cut)
            lure = (best != _NONE) & self.lures[np.minimum(best, len(self.lures) - 1)]
            for c in np.flatnonzero(lure & (sizes > LONG)).tolist():
                lo, hi = cut[c], cut[c] + sizes[c]
                part = np.array(self.finish(symbols[lo:hi].tolist()), symbols.dtype)
                done_s.append(part)
                done_w.append(np.full(len(part), word[lo]))
                done_at.append(at[lo: lo + len(part)])
                best[c] = _NONE
                symbols[lo:hi] = -1
            on = np.repeat(best != _NONE, sizes)
            over = ~on & (symbols >= 0)
            done_s.append(symbols[over])
            done_w.append(word[over])
            done_at.append(at[over])
            least = np.repeat(best, sizes)
            hit = on & (rank == least)
            spot = np.arange(n)
            first = hit & ~np.append(False, hit[:-1])
            run = np.maximum.accumulate(np.where(first, spot, 0))
            take = hit & ((spot - run) & 1 == 0)
            if lure.any():
                taken = np.flatnonzero(take)
                part = np.searchsorted(cut, taken, side="right") - 1
                later = np.append(False, part[1:] == part[:-1]) & lure[part]
                take[taken[later]] = False
            taken = np.flatnonzero(take)
            symbols[taken] = self.made[pair[taken]]
            stay = on
            stay[taken + 1] = False
            pair[taken] = pair[taken + 1]  # whether the part goes on behind the merged pair
            fresh_pair = np.zeros(n, bool)
            fresh_pair[taken] = pair[taken] >= 0
            behind = taken[(taken > 0)] - 1
            fresh_pair[behind] |= pair[behind] >= 0
            # a neighbour that was itself merged away is looked up at its left end
            symbols, word, at, pair, fresh_pair = (x[stay] for x in (symbols, word, at, pair, fresh_pair))
            n = len(symbols)
            left = np.flatnonzero(fresh_pair)
            if len(left):
                pair[left] = self.look(symbols[left], symbols[left + 1])
        s, w, a = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_s, done_w, done_at))
        order = np.argsort(a, kind="stable")
        return s[order], w[order]

    def ids(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of merged symbols; a character that is no piece gives its bytes, or the unknown id once a run."""
        odd = np.flatnonzero(symbols >= self.pieces)
        if not len(odd):
            return symbols, word
        if not self.fallback:
            symbols = np.where(symbols >= self.pieces, self.unk, symbols)
            again = (symbols[1:] == self.unk) & (symbols[:-1] == self.unk) & (word[1:] == word[:-1])
            keep = np.append(True, ~again)
            return symbols[keep], word[keep]
        loose = np.zeros(max(self.unknown - self.pieces, 1), np.int64)
        chars = np.flatnonzero(self.of_char < self.unknown)
        chars = chars[self.of_char[chars] >= self.pieces]
        loose[self.of_char[chars] - self.pieces] = chars
        kinds, of = np.unique(symbols[odd], return_inverse=True)
        raw = [chr(int(k - self.unknown) if k >= self.unknown else int(loose[k - self.pieces])).encode() for k in kinds.tolist()]
        sizes = np.array([len(r) for r in raw])
        table = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        length = np.ones(len(symbols), np.int64)
        length[odd] = sizes[of]
        out = np.repeat(symbols, length)
        begin = (np.cumsum(length) - length)[odd]
        out[ranges(begin, sizes[of])] = table[ranges((np.cumsum(sizes) - sizes)[of], sizes[of])]
        return out, np.repeat(word, length)

    def encode(self, data: np.ndarray, off: np.ndarray, begin: bool = True, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of UTF-8 texts and where each text begins."""
        rows = len(off) - 1
        full = np.flatnonzero(np.diff(off) > 0)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        place = np.append(0, np.cumsum((data & 0xC0) != 0x80))[off]
        points = np.where(points == 0x20, SPACE, points)
        if self.dummy:
            points = np.insert(points, place[full], SPACE)
            place = place + np.searchsorted(full, np.arange(rows + 1), side="left")
        head = np.zeros(len(points) + 1, bool)
        if self.spaced:
            head[:-1] = points == SPACE
            head[1:-1] &= points[:-1] != SPACE
        head[place] = True
        start = np.flatnonzero(head[:-1])
        length = np.diff(np.append(start, len(points)))
        up, down = _powers(len(points))
        run = np.append(np.uint64(0), np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)]))
        digest = mix((run[start + length] - run[start]) * down[start]) + length.astype(np.uint64)
        _, where, of = np.unique(digest, return_index=True, return_inverse=True)
        symbols = self.of_char[points[ranges(start[where], length[where])]]
        word = np.repeat(np.arange(len(where)), length[where])
        flat, word = self.ids(*self.merge(symbols, word))
        size = np.bincount(word, minlength=len(where))
        first = np.cumsum(size) - size
        words_of = np.searchsorted(place[1:], start, side="right")  # the text of each word
        count = np.bincount(words_of, weights=size[of], minlength=rows).astype(np.int64) if len(start) else np.zeros(rows, np.int64)
        body = flat[ranges(first[of], size[of])].astype("<u4") if len(start) else np.zeros(0, "<u4")
        total = count + int(begin) + int(end)
        stop = np.cumsum(total)
        out = np.empty(stop[-1] if rows else 0, "<u4")
        out[ranges(stop - total + int(begin), count)] = body
        if begin:
            out[stop - total] = self.bos
        if end:
            out[stop - 1] = self.eos
        return out, np.append(0, stop)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat UTF-8 bytes of the texts of flat ids, and where each text begins."""
        if len(ids) and int(ids.max()) >= self.pieces:
            raise ValueError("an id is not in the vocabulary")
        ids = ids.astype(np.int64)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        start, length = self.starts[ids], self.lengths[ids]
        if self.dummy and len(ids):
            said = np.flatnonzero(~self.is_control[ids])
            first = said[np.append(True, row[said][1:] != row[said][:-1])] if len(said) else said
            first = first[self.opens[ids[first]]]
            start[first] += 1
            length[first] -= 1
        raw = self.flat[ranges(start, length)]
        out = np.append(0, np.cumsum(np.bincount(row, weights=length, minlength=len(off) - 1).astype(np.int64)))
        odd = np.unique(row[self.is_byte[ids] & (self.flat[np.minimum(self.starts[ids], len(self.flat) - 1)] >= 0x80)])
        if not len(odd):
            return raw, out
        parts = np.split(raw, out[1:-1])
        for r in odd.tolist():
            lo, hi = off[r], off[r + 1]
            text, pending, at = [], bytearray(), 0
            for b, size in zip(self.is_byte[ids[lo:hi]].tolist(), length[lo:hi].tolist(), strict=True):
                piece = parts[r][at: at + size].tobytes()
                at += size
                if b:
                    pending += piece
                else:
                    text += [_valid(bytes(pending)), piece]
                    pending.clear()
            parts[r] = np.frombuffer(b"".join([*text, _valid(bytes(pending))]), np.uint8)
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


def _valid(run: bytes) -> bytes:
    """A run of bytes with every byte that begins no character replaced by U+FFFD."""
    out = []
    while run:
        try:
            out.append(run.decode().encode())
            break
        except UnicodeDecodeError as e:
            out += [run[: e.start], b"\xef\xbf\xbd"]
            run = run[e.start + 1:]
    return b"".join(out)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    return _vocabularies.get(path) or _vocabularies.setdefault(path, Vocabulary(path))


def _with(docs: DataFrame, column: str, name: str, kind: str, read: pa.DataType, run) -> DataFrame:  # noqa: ANN001
    """``docs`` and a column made from the flat values of another, in chunks."""
    schema = docs.limit(0).withColumn(name, F.lit(None).cast(kind)).schema
    i = docs.columns.index(column)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = text_buffers(batch.column(i).cast(read))
        for lo, hi in chunks(off, TOGETHER):
            flat, at = run(data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo])
            made = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(flat)])
            made = made.cast(pa.large_string() if kind == "string" else pa.large_binary())
            made = made.cast(pa.string() if kind == "string" else pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), made], names=[*batch.schema.names, name])

    return map_arrow(docs, each, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", begin: bool = True, end: bool = True) -> DataFrame:
    """``docs`` with the ids of its texts as one binary value: unsigned 32-bit integers, little-endian.

    A null or empty text gives the begin and end ids alone.  Rows, also repeated
    ones and those without an id, keep their other columns; an older column of
    the name ``ids`` is an error.
    """
    if fresh(docs.columns, ids) != ids:
        raise ValueError(f"column {ids} is taken")

    def run(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, at = vocabulary(path).encode(data, off, begin, end)
        return flat.view(np.uint8), at * 4

    return _with(docs, text, ids, "binary", pa.large_string(), run)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the texts of its ids (as ``encode`` gives them); null ids give an empty text."""
    if fresh(docs.columns, text) != text:
        raise ValueError(f"column {text} is taken")

    def run(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if (off % 4).any():
            raise ValueError("ids are 32-bit integers")
        return vocabulary(path).decode(np.frombuffer(data.tobytes(), "<u4"), off // 4)

    return _with(docs, ids, text, "string", pa.large_binary(), run)
