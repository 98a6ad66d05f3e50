"""Benchmark decontamination by template windows.

Method: words are reduced to templates (numbers, units and names become typed
placeholders), windows of ``WINDOW`` template words are hashed, and document
windows meet benchmark windows in a hash join.  Where a window has placeholders,
their values are compared: within one occurrence each benchmark value must
always turn into the same document value.  So a question with other numbers is
found, and text that shares only a shape is not.

Windows of all documents do not travel: a bitmap of fixed size (``BITMAP`` bits,
4 MB, whatever the benchmark's size) drops those whose hash no benchmark window
can have.  The bitmap only saves work; the join decides.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import IS_SPACE, chunks, keep, map_arrow, mix, text_buffers, window_hashes, word_hashes, word_spans

WINDOW = 8
#: Shorter items give one window of their whole length; below this they say too
#: little to be told from chance in a longer text, and count where they are a whole document.
SHORTEST = 5
#: Words of a window that must not be placeholders.
LITERALS = 4
COVERAGE = 0.5
#: So many consecutive words of an item report it, whatever its length.
RUN = 13
#: Marks a name among the values of placeholders; no word begins with it.
NAME = " "
BITMAP = 1 << 25

#: Unit words that become a placeholder (fixed values).
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs",
         "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "gallon", "gallons", "s", "sec", "second", "seconds", "min",
         "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent",
         "cents", "dollar", "dollars", "euro", "euros", "percent", "meter", "meters", "metre", "metres", "kilometer", "kilometers")

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3A, 0x3F]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    raw = " ".join(words).encode()
    data = np.frombuffer(raw, np.uint8)
    start, end, _ = word_spans(data, np.array([0, len(raw)]))
    return np.sort(word_hashes(data, start, end))


_UNIT_HASHES = _hash_words(UNITS)


class Templates:
    """Template words of a run of texts: hashes, rows and places in the bytes."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.data = data
        solid = ~IS_SPACE[data]
        kept = _DIGIT[data] | _LETTER[data]
        shown = kept | ~solid
        self.place = np.flatnonzero(shown)  # byte in the text of each byte below
        new_off = np.append(0, np.cumsum(shown))[off]
        small = data[self.place]
        after = np.zeros(len(small), bool)
        after[1:] = small[:-1] == 0xC3
        accent = after & (small >= 0x80) & (small <= 0x9E) & (small != 0x97)
        first_byte, last_byte, self.row = word_spans(small, new_off)
        head = small[first_byte] if len(first_byte) else np.zeros(0, np.uint8)
        capital = (head >= 0x41) & (head <= 0x5A)
        two = (head == 0xC3) & (last_byte - first_byte > 1)
        capital[two] = accent[first_byte[two] + 1]
        low = _LOW[small]
        low[accent] += 0x20
        letters = np.append(0, np.cumsum(_LETTER[small]))
        wordy = letters[last_byte] > letters[first_byte]
        self.start, self.end = self.place[first_byte] if len(first_byte) else first_byte, self.place[last_byte - 1] + 1 if len(first_byte) else first_byte
        # a capital after the end of a sentence, or at a text's start, names nothing
        before = np.maximum.accumulate(np.where(solid, np.arange(len(data)), -1)) if len(data) else np.zeros(0, np.int64)
        prior = np.where(self.start > 0, before[self.start - 1], -1) if len(self.start) else self.start
        opens = prior < off[self.row]
        opens |= _STOP[data[np.maximum(prior, 0)]] if len(data) else False
        h = word_hashes(low, first_byte, last_byte)
        unit = np.isin(h, _UNIT_HASHES)
        self.name = wordy & ~unit & capital & ~opens
        self.slot = ~wordy | unit
        self.word = mix(h)
        self.literal = np.where(~wordy, _NUMBER, np.where(unit, _UNIT, h))

    def forms(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, hash, slots by word) of windows with enough literal words.

        Names stand for themselves in the first form, so that a text in small
        letters is found; the second has the windows with names, as placeholders.
        """
        n = len(self.row)
        if n < k:
            return
        whole = self.row[k - 1:] == self.row[: n - k + 1]
        names = np.append(0, np.cumsum(self.name))
        named = names[k:] > names[: n - k + 1]
        for words, slot, fit in ((self.literal, self.slot, whole), (np.where(self.name, _NAME, self.literal), self.slot | self.name, whole & named)):
            slots = np.append(0, np.cumsum(slot))
            at = np.flatnonzero(fit & (k - (slots[k:] - slots[: n - k + 1]) >= LITERALS))
            yield at, window_hashes(words ^ np.uint64(k), at, k), slot

    def values(self, at: int, k: int, slot: np.ndarray) -> list[str]:
        """Values of the placeholders in a window; a name's begins with ``NAME``."""
        return [NAME * bool(self.name[i]) + self.data[self.start[i]: self.end[i]].tobytes().decode(errors="replace").lower()
                for i in range(at, at + k) if slot[i]]

    def exact(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As ``forms``: all windows, with every word standing for itself."""
        at = np.flatnonzero(self.row[k - 1:] == self.row[: len(self.row) - k + 1]) if len(self.row) >= k else np.zeros(0, np.int64)
        yield at, window_hashes(self.word ^ np.uint64(k), at, k), np.zeros(len(self.row), bool)


_ROWS = "h long, pos int, slots array<string>, size int"


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, h, pos, slots, size, n, words, whole): windows of each item, their number and the item's.

    ``n`` counts the windows of the main size.  Items under two windows have
    shorter ones as well, so that one changed word leaves a window at a side.
    An item without any window is one of all its words, each standing for
    itself (``whole``).
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = text_buffers(batch.column("text"))
        ids = batch.column("item_id")
        out: list[list] = [[] for _ in range(8)]
        for r in range(len(ids)):
            t = Templates(data[off[r]: off[r + 1]], np.array([0, off[r + 1] - off[r]]))
            words = len(t.row)
            k = min(window, words)
            if not words:
                continue
            short = words < SHORTEST
            more = {max(SHORTEST, (words - 1) // 2)} if window < words < 2 * window else set()
            got = [] if short else [(i, x, t.values(i, size, slot), size) for size in (k, *(more - {k})) for at, h, slot in t.forms(size)
                   for i, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]
            whole = not any(size == k for *_, size in got)
            if whole:
                got += [(i, x, [], words) for at, h, _ in t.exact(words) for i, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]
            main = len({i for i, _, _, size in got if size == k}) or 1
            for i, x, values, size in got:
                for o, v in zip(out, (ids[r].as_py(), x, i, values, size, main, words, whole and size == words), strict=True):
                    o.append(v)
        kinds = (ids.type, pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)],
                                         names=["item_id", "h", "pos", "slots", "size", "n", "words", "whole"])

    slim = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return map_arrow(slim, run, f"item_id {slim.schema['item_id'].dataType.simpleString()}, {_ROWS}, n int, words int, whole boolean")


def _bitmap(windows: DataFrame) -> bytes:
    """Bits of all window hashes; BITMAP / 8 bytes at any size."""
    pos = F.expr(f"h & {BITMAP - 1}L")
    rows = (windows.select(pos.alias("p"))
            .groupBy(F.expr("bitmap_bucket_number(p)").alias("b"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect())
    # bucket b > 0 holds the values from (b - 1) * 32768 + 1 on, bucket 0 those before
    out = np.zeros(BITMAP + 32768, bool)
    for r in rows:
        base = (r["b"] - 1) * 32768 + 1 if r["b"] > 0 else 0
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        out[base: base + len(bits)] |= bits[: len(out) - base].astype(bool)
    return np.packbits(out[:BITMAP], bitorder="little").tobytes()


def occurrence(windows: list[tuple[int, int, list[tuple[str, str]]]]) -> list[tuple[int, int, bool]]:
    """(pos, size, other) of the windows of one occurrence that hold; ``windows`` have (pos, size, slot value pairs).

    Windows whose values all agree hold whatever the others do.  A name that
    turns into two values tells another text, so all others go.  Equal numbers
    or units may stand for different things: of a value that turns into several
    only the windows with its rarer ones go.
    """
    same = [(p, k, False) for p, k, pairs in windows if all(a == b for a, b in pairs)]
    other = [(p, k, pairs) for p, k, pairs in windows if any(a != b for a, b in pairs)]
    places: dict[tuple[str, str], set[int]] = {}
    for p, _, pairs in windows:
        for pair in pairs:
            places.setdefault(pair, set()).add(p)
    best: dict[str, str] = {}
    for a, b in sorted(places, key=lambda x: (-len(places[x]), x)):
        if best.setdefault(a, b) != b and a.startswith(NAME):
            return same
    return same + [(p, k, True) for p, k, pairs in other if all(best[a] == b for a, b in pairs)]


def judge(n: int, words: int, shifts: dict[int, list], window: int, coverage: float) -> tuple[int, bool] | None:
    """Number of matched windows of an item and whether values differ, or None if the item is not held."""
    spots: dict[int, bool] = {}
    covered, run, other = np.zeros(words, bool), 0, False
    for found in shifts.values():
        mine = np.zeros(words, bool)
        for p, k, differs in occurrence(found):
            mine[p: p + k] = True
            other |= differs
            if k in (min(window, words), words):
                spots[p] = spots.get(p, True) and differs
        ends = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
        run = max([run, *(ends[1::2] - ends[::2]).tolist()])
        covered |= mine
    share = covered.sum() >= max(coverage * words, min(window, words))
    if not (len(spots) >= coverage * n or share or run >= RUN):
        return None
    return len(spots), any(spots.values()) if spots else other


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(_uid, doc_id, item_id, n_windows, n_matched, coverage, kind): documents that hold benchmark items.

    A pair is reported if at least ``coverage`` of the item's windows, or of its
    words, or ``RUN`` consecutive words occur in the document with consistent
    slots (``occurrence``); ``coverage`` gives the share of windows, and ``kind`` is ``verbatim`` if all slot
    values agree and ``reparameterised`` if they were replaced throughout.
    Null and empty texts match nothing; items under ``SHORTEST`` words match
    documents that hold nothing else, and items with too few literal words exact copies.  Repeated documents and items are reported each (items by
    id).  ``_uid`` numbers the rows of ``docs`` in their order.
    """
    spark = docs.sparkSession
    bench = keep(benchmark_windows(items, item_id, item_text, window).distinct(), "benchmark-windows")
    by_size = bench.select("size", "whole").distinct().collect()
    sizes, exact = (sorted({r["size"] for r in by_size if r["whole"] == w}) for w in (False, True))
    bits = spark.sparkContext.broadcast(_bitmap(bench))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        data, off = text_buffers(batch.column("text"))
        uid, ids = batch.column("_uid"), batch.column("doc_id")
        out: list[list] = [[], [], [], [], [], []]
        for lo, hi in chunks(off):
            t = Templates(data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo])
            base = np.searchsorted(t.row, np.arange(hi - lo))
            words = np.bincount(t.row, minlength=hi - lo)
            for k, (at, h, slot) in itertools.chain(((k, form) for k in sizes for form in t.forms(k)), ((k, form) for k in exact for form in t.exact(k))):
                low = h & np.uint64(BITMAP - 1)
                hit = np.flatnonzero(table[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                if k < SHORTEST:
                    hit = hit[words[t.row[at[hit]]] == k]
                for i, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist(), strict=True):
                    r = int(t.row[i])
                    for o, v in zip(out, (uid[lo + r].as_py(), ids[lo + r].as_py(), x, i - int(base[r]), t.values(i, k, slot), k), strict=True):
                        o.append(v)
        kinds = (pa.int64(), ids.type, pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)],
                                         names=["_uid", "doc_id", "h", "pos", "slots", "size"])

    slim = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    found = map_arrow(slim, run, f"_uid long, doc_id {id_type}, {_ROWS}")

    pairs = found.alias("d").join(bench.alias("b"), ["h", "size"]).select(
        "_uid", "doc_id", "item_id", "n", "words", F.struct(
            (F.col("d.pos") - F.col("b.pos")).alias("shift"), F.col("b.pos").alias("pos"), "size", F.col("b.slots").alias("a"), F.col("d.slots").alias("b")).alias("w"))
    # one occurrence of an item: its windows all lie at one shift
    held = pairs.groupBy("_uid", "doc_id", "item_id", "n", "words").agg(F.collect_set("w").alias("w"))

    def verdict(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, kept = [], []
        for i, (n, words, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "words", "w")), strict=True)):
            shifts: dict[int, list] = {}
            for w in found:
                shifts.setdefault(w["shift"], []).append((w["pos"], w["size"], list(zip(w["a"], w["b"], strict=True))))
            if got := judge(n, words, shifts, window, coverage):
                kept.append(i)
                rows.append((n, got[0], got[0] / n, "reparameterised" if got[1] else "verbatim"))
        at = pa.array(kept, pa.int64())
        more = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("_uid", "doc_id", "item_id")), *more],
                                         names=["_uid", "doc_id", "item_id", "n_windows", "n_matched", "coverage", "kind"])

    item_type = bench.schema["item_id"].dataType.simpleString()
    return map_arrow(held, verdict, f"_uid long, doc_id {id_type}, item_id {item_type}, n_windows long, n_matched long, coverage double, kind string")
