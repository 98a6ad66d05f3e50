"""SimHash fingerprints and exact linking at a small Hamming distance.

Method: deletion variants.  For distance 2 a fingerprint is cut into two
segments, so that of two linked fingerprints one segment differs by at most one
bit.  Each segment is indexed under its variants with one bit wild (32 a
segment); an equality join on variants finds the candidates, and the full
distance verifies them.

A bucket with many fingerprints is not joined with itself.  Its members are
linked exactly another way: two fingerprints are at distance 2 or less if and
only if some value is within one bit of both, and no value has more than 65
fingerprints that near, so grouping by those values is bounded.

``near_groups`` links by similarity: texts whose sets of shingles have a Jaccard
similarity of ``SIMILARITY`` or more.  At 0.8 two fingerprints differ in 15% of
their bits, too many for variants of bits (a 64-bit segment pair meets in one of
thousands), so there the signature has ``TABLES`` segments of ``SEGMENT`` minwise
hashes, each indexed under its variants with one hash wild.  A segment of a pair
at 0.8 has at most one differing hash with probability 0.66, so all four miss it
with probability 0.014, whatever the number of texts.

Buckets of that index give no pairs by the square: first every member meets the
bucket's smallest, and what that links is contracted; then members of different
components meet, in buckets of ``CROWD`` or fewer.  Members of larger buckets with
more than one component (texts with a common boilerplate) are joined exactly: two sets at similarity s share one of the first (1 - s) of their shingles, the
rarest first.  What is still crowded there meets whole, block by block: texts of
like size are dealt to blocks, and a task counts the common shingles of all pairs
of two blocks and passes on one link for two components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import chunks, components, keep, map_arrow, mix, text_buffers, window_hashes, window_starts, word_hashes, word_spans
from trialspark.llm.pieces import ranges

BITS = 64
#: Members beyond which a variant's bucket is linked through its one-bit neighbours.
BUCKET = 64
SIMILARITY = 0.8
SEGMENT = 6
TABLES = 4
#: Components of a bucket that meet each other; a larger bucket is cut.
CROWD = 32
#: Shingles of a block of what is still crowded; a set counts for ``FEWEST`` at least.
BLOCK, FEWEST = 1 << 20, 1 << 9
#: Sets of a block up to which a shingle's pairs are listed; those of others are counted by products of ``COLUMNS`` shingles.
LISTED, COLUMNS = 16, 1 << 12
#: Shingles of a row; a longer set is compared in ``SLICES`` parts by hash.
LONG = 1 << 16
SLICES = 64
#: Pairs of one text beyond which its row is copied for the join.
SPREAD = 1000

_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """SimHash of the k-word shingles, ASCII case folded; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < k:
        return xxhash.xxh64_intdigest(line, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[s: e - 1], seed) for s, e in zip([0, *ends], ends[k - 1:])], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i: i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """(_uid, doc_id, fp): one row per row of ``docs``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.array([fingerprint(t, k, seed) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("doc_id"), pa.array(fps.view(np.int64))],
                                         names=["_uid", "doc_id", "fp"])

    slim = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(slim, run, "_uid long, doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp`` at distance 2 or less.

    The links join all fingerprints that are connected; a large bucket gives a
    star for each of its members' neighbours instead of all its pairs.
    """
    seg = F.expr("CASE WHEN j < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END")
    index = (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))
             .select("fp", (F.expr("shiftleft(cast(j as bigint), 32)").bitwiseOR(
                 seg.bitwiseAND(F.expr("~shiftleft(1L, j % 32)")))).alias("key")))
    crowds = keep(index.groupBy("key").count().where("count > 1"), "variants")
    members = keep(index.join(crowds, "key"), "members")
    few = members.where(F.col("count") <= BUCKET).select("key", "fp")
    near = (few.alias("x").join(few.alias("y"), "key")
            .where("x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= 2")
            .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct())
    many = members.where(F.col("count") > BUCKET).select("fp").distinct()
    around = many.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("j")).select(
        "fp", F.expr("CASE WHEN j < 0 THEN fp ELSE fp ^ shiftleft(1L, j) END").alias("at"))
    stars = (around.groupBy("at").agg(F.collect_set("fp").alias("s")).where("size(s) > 1")
             .select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where("a <> b").distinct())
    return near.unionByName(stars)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """(_uid, doc_id, fp, component_id, keeper), one row per row of ``docs``.

    Rows whose fingerprints are connected by links share a component, named by
    its smallest doc_id; nulls count only if no other id is there.  ``keeper``
    marks one row of each component: that of the smallest doc_id, and among
    repeated rows the first.  Null, empty and blank texts have fingerprint 0.
    Columns other than the id and the text are not read.
    """
    rows = keep(fingerprints(docs, doc_id, text, k, seed), "fingerprints")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_uid"))
    fps = keep(rows.groupBy("fp").agg(head.alias("head")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("head").alias("head"))
    named = rooted.select("fp", "root").join(heads, "root").select("fp", "head")
    return rows.join(named, "fp").select(
        "_uid", "doc_id", "fp", F.col("head.doc_id").alias("component_id"), (F.col("_uid") == F.col("head._uid")).alias("keeper"))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, ASCII case folded; a shorter text is one shingle."""
    data, off = text_buffers(column)
    for lo, hi in chunks(off):
        part, cut = _LOW[data[off[lo]: off[hi]]], off[lo: hi + 1] - off[lo]
        start, end, row = word_spans(part, cut)
        words = word_hashes(part, start, end)
        at = window_starts(row, k)
        full = window_hashes(words, at, k)
        first, last = np.searchsorted(row, np.arange(hi - lo)), np.searchsorted(row, np.arange(hi - lo), side="right")
        begin, stop = np.searchsorted(at, first), np.searchsorted(at, last)
        for f, e, b, s in zip(first.tolist(), last.tolist(), begin.tolist(), stop.tolist(), strict=True):
            if 0 < e - f < k:
                yield window_hashes(words[f:e] ^ np.uint64(e - f), np.zeros(1, np.int64), e - f)
            else:
                yield np.unique(full[b:s])


_SALTS = np.random.default_rng(11).integers(1, 2**63, (2, SEGMENT * TABLES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SEGMENT * TABLES`` minwise hashes of a set of shingles, 32 bits each."""
    low = np.full(SEGMENT * TABLES, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 1 << 14):
        low = np.minimum(low, ((shingles[i: i + (1 << 14), None] ^ _SALTS[0]) * _SALTS[1]).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(slim: DataFrame, k: int) -> DataFrame:
    """(_uid, doc_id, node, size, sig): ``node`` names the set of shingles, 0 if a text has no words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes, sizes, sigs = [], [], []
        for s in shingle_sets(batch.column("text"), k):
            nodes.append(mix(np.array([np.bitwise_xor.reduce(mix(s)) + np.uint64(len(s))], np.uint64))[0] | np.uint64(1) if len(s) else np.uint64(0))
            sizes.append(len(s))
            sigs.append(signature(s))
        flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
        sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * (SEGMENT * TABLES)), flat)
        yield pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("doc_id"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), sig],
                                         names=["_uid", "doc_id", "node", "size", "sig"])

    return map_arrow(slim, run, "_uid long, doc_id long, node long, size long, sig array<int>")


def _keyed(nodes: DataFrame, picks: list[list[int]]) -> DataFrame:
    """The columns without ``sig``, and ``key``: one row for each choice of hashes, told apart by the choice's number."""
    wide = max(map(len, picks))
    at = np.array([[*p, *[-1] * (wide - len(p))] for p in picks])
    names = [c for c in nodes.columns if c != "sig"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sig = np.array(batch.column("sig").flatten()).view(np.uint32).astype(np.uint64).reshape(batch.num_rows, -1)
        for lo in range(0, len(sig), 2000):
            part = sig[lo: lo + 2000]
            key = np.broadcast_to(mix(np.arange(1, len(at) + 1, dtype=np.uint64)), (len(part), len(at)))
            for j in range(wide):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, at[:, j]] + np.uint64(1))
            of = pa.array(np.repeat(np.arange(lo, lo + len(part)), len(at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in names), pa.array(key.ravel().view(np.int64))], names=[*names, "key"])

    return map_arrow(nodes, run, ", ".join(f"{c} long" for c in [*names, "key"]))


def _variants(nodes: DataFrame) -> DataFrame:
    """(node, size, key): each segment of a signature with one of its hashes wild."""
    segments = [range(t, t + SEGMENT) for t in range(0, SEGMENT * TABLES, SEGMENT)]
    return _keyed(nodes.select("node", "size", "sig"), [[i for i in s if i != wild] for s in segments for wild in s])


def _rarest(nodes: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(key, node, size): the rarest shingles of each set, of which similar sets share one; those of one set only are left out."""
    each = keep(nodes.join(shingles, "node").select("node", F.explode("s").alias("key")), "crowd-shingles")
    many = each.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    ranked = each.join(many, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("sets", "key"))).alias("shared"))
    # sets are cut into rows by hash where they are long, so sizes come from the nodes; shingles of one set only come first
    room = F.expr(f"size - ceil({similarity} * size - 1e-9) + 1 - (size - size(shared))")
    return (ranked.join(nodes.select("node", "size"), "node").withColumn("room", room).where("room > 0")
            .select("node", "size", F.explode(F.expr("slice(shared, 1, cast(room as int))")).alias("x")).select(F.col("x.key").alias("key"), "node", "size"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the component of their node."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _meetings(buckets: DataFrame, most: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b, size_a, size_b): pairs of members of a bucket that are of different components.

    All such pairs of a small bucket; of a larger one, with up to ``most``
    components, those of one member a component.  Also (key, node, size): the members
    of buckets with more components, or with ``exact`` of all larger buckets
    that hold more than one.
    """
    held = keep(buckets.select("key", "node", "size", "root"), "bucket-members")
    ones = held.groupBy("key", "root").agg(F.min(F.struct("node", "size")).alias("m"), F.count(F.lit(1)).alias("n"))
    ones = keep(ones.select("key", "root", "m.node", "m.size", "n"), "bucket-components")
    sizes = keep(ones.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("members")).where("roots > 1"), "bucket-sizes")
    small = F.col("members") <= CROWD

    def across(members: DataFrame, some: F.Column) -> DataFrame:
        few = members.select("key", "root", "node", "size").join(sizes.where(some).select("key"), "key")
        return (few.alias("x").join(few.alias("y"), "key").where("x.root < y.root")
                .selectExpr("least(x.node, y.node) AS a", "greatest(x.node, y.node) AS b", "if(x.node < y.node, x.size, y.size) AS size_a", "if(x.node < y.node, y.size, x.size) AS size_b"))

    pairs = across(held, small).unionByName(across(ones, ~small & (F.col("roots") <= most))).distinct()
    crowded = ~small & ((F.col("roots") > most) | F.lit(exact))
    return pairs, held.select("key", "node", "size").join(sizes.where(crowded).select("key"), "key", "left_semi")


def _verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of pairs (a, b, size_a, size_b) whose sets of shingles are similar.

    The row of a text with many partners is copied, so that its pairs are dealt
    to several tasks; long sets meet part by part.
    """
    sized = (pairs.withColumn("large", F.greatest("size_a", "size_b"))
             .where(F.least("size_a", "size_b") >= F.lit(similarity) * F.col("large"))
             .withColumn("part", F.explode(F.expr(f"if(large > {LONG}, sequence(0, {SLICES - 1}), array(-1))"))))
    sized = keep(sized, "sized-pairs")
    copies = sized.groupBy("a", "part").agg((F.count(F.lit(1)) / SPREAD).cast("int").alias("more"))
    dealt = sized.join(copies, ["a", "part"]).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("more") + 1).cast("int"))
    first = (shingles.withColumnRenamed("node", "a").join(copies, ["a", "part"])
             .select("a", "part", F.col("s").alias("sa"), F.explode(F.expr("sequence(0, more)")).alias("salt")))
    both = (dealt.join(first.hint("merge"), ["a", "part", "salt"])
            .join(shingles.select(F.col("node").alias("b"), "part", F.col("s").alias("sb")).hint("merge"), ["b", "part"]))
    shared = both.groupBy("a", "b", "size_a", "size_b").agg(F.sum(F.size(F.array_intersect("sa", "sb"))).alias("i"))
    return shared.where(F.col("i") >= F.lit(similarity) * (F.col("size_a") + F.col("size_b") - F.col("i"))).select("a", "b")


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Numbers of shingles that each set of one block shares with each of another; a block is (shingle, set) of all its sets."""
    (ta, oa), (tb, ob) = a, b
    order = np.argsort(tb, kind="stable")
    tb, ob = tb[order], ob[order]
    first = np.searchsorted(tb, ta)
    n = np.searchsorted(tb, ta, side="right") - first
    out = np.zeros(shape[0] * shape[1], np.float32)
    few = np.flatnonzero((n > 0) & (n <= LISTED))
    for lo in range(0, len(few), BLOCK // 16):
        part = few[lo: lo + BLOCK // 16]
        out += np.bincount(np.repeat(oa[part], n[part]) * shape[1] + ob[ranges(first[part], n[part])], minlength=len(out)).astype(np.float32)
    out = out.reshape(shape)
    many = np.unique(ta[n > LISTED])
    for lo in range(0, len(many), COLUMNS):
        part = many[lo: lo + COLUMNS]
        wide = []
        for t, o, rows in ((ta, oa, shape[0]), (tb, ob, shape[1])):
            at = np.minimum(np.searchsorted(part, t), len(part) - 1)
            held = part[at] == t
            x = np.zeros((rows, len(part)), np.float32)
            x[o[held], at[held]] = 1
            wide.append(x)
        out += wide[0] @ wide[1].T
    return out


def _block_links(members: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between components of ``members`` (node, size, root), which all meet.

    Sets of like size are dealt to blocks; a component that fills blocks has
    blocks of its own, which do not meet each other.  Two components similar in
    several pairs of a task give one link.
    """
    level = F.floor(F.log(F.col("size").cast("double")) / F.lit(-np.log(similarity))).cast("int")
    sized = keep(members.select("node", "size", "root", level.alias("level"), F.greatest("size", F.lit(FEWEST)).alias("w")), "crowd-sizes")
    own = sized.groupBy("level", "root").agg(F.sum("w").alias("w")).where(F.col("w") > BLOCK // 2).select("level", "root", F.lit(True).alias("own"))
    sized = sized.join(own, ["level", "root"], "left").withColumn("own", F.when(F.col("own"), F.col("root")))
    wide = sized.groupBy(F.col("level").alias("at"), F.col("own").alias("whose")).agg(F.ceil(F.sum("w") / BLOCK).alias("k"))
    met = (F.col("level") == F.col("at")) & F.col("own").eqNullSafe(F.col("whose"))
    dealt = keep(sized.join(wide, met).select("node", "size", "root", "level", "own", F.pmod(F.xxhash64("node"), F.col("k")).alias("part")), "crowd-dealt")
    blocks = dealt.select("level", "own", "part").distinct().withColumn("block", F.xxhash64("level", "own", "part"))
    blocks = keep(blocks, "crowd-blocks")
    # sizes of similar sets are in one level or in levels that follow each other
    near = blocks.select(F.col("block").alias("y"), F.col("own").alias("own_y"), F.col("level").alias("level_y"), F.explode(F.array(F.col("level"), F.col("level") - 1)).alias("level"))
    pairs = (blocks.join(near, "level").where("(level < level_y OR block <= y) AND NOT coalesce(own = own_y, false)")
             .select(F.col("block").alias("x"), "y"))
    sides = keep(pairs.select("x", "y", F.explode(F.expr("if(x = y, array(struct(x AS block, 0 AS side)), array(struct(x AS block, 0 AS side), struct(y AS block, 1 AS side)))")).alias("s")).select("x", "y", "s.block", "s.side"), "crowd-pairs")
    rows = dealt.withColumn("block", F.xxhash64("level", "own", "part")).join(shingles, "node").select("block", "node", "size", "root", "s").join(sides, "block")

    def meet(t: pa.Table) -> pa.Table:
        side, nodes, sizes, roots = (t.column(c).to_numpy() for c in ("side", "node", "size", "root"))
        lists = t.column("s").combine_chunks()
        tokens, of = np.asarray(lists.flatten()), np.repeat(np.arange(len(nodes)), np.asarray(lists.value_lengths()))
        halves = []
        for k in (0, int(side.max())):
            mine = np.flatnonzero(side == k)
            name, first, number = np.unique(nodes[mine], return_index=True, return_inverse=True)
            place = np.full(len(nodes), -1)
            place[mine] = number
            held = place[of] >= 0
            halves.append((name, sizes[mine][first], roots[mine][first], (tokens[held], place[of[held]])))
        (na, sa, ra, a), (nb, sb, rb, b) = halves
        both = _common(a, b, (len(na), len(nb))).astype(np.float64)
        i, j = np.nonzero((both >= similarity * (sa[:, None] + sb[None, :] - both)) & (ra[:, None] != rb[None, :]))
        if len(i):
            ends = np.sort(np.column_stack([ra[i], rb[j]]), axis=1)
            one = np.unique(ends, axis=0, return_index=True)[1]
            i, j = i[one], j[one]
        return pa.table({"a": pa.array(np.minimum(na[i], nb[j]), pa.int64()), "b": pa.array(np.maximum(na[i], nb[j]), pa.int64())})

    return rows.groupBy("x", "y").applyInArrow(meet, "a long, b long").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(_uid, doc_id, component_id, keeper), one row per row of ``docs``.

    Rows are linked if the Jaccard similarity of their sets of k-word shingles
    is ``similarity`` or more, and share a component if links connect them;
    components and keepers are named as in ``groups``.  Texts without words are
    one component.  Every link is verified on the sets.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = keep(_sketches(slim, k), "sketches")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_uid"))
    nodes = keep(rows.groupBy("node").agg(head.alias("head"), F.first("size").alias("size"), F.first("sig").alias("sig")), "distinct-sets")
    index = keep(_variants(nodes.where("node <> 0")), "variants")
    heads = keep(index.groupBy("key").agg(F.min(F.struct("node", "size")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "bucket-heads")
    buckets = keep(index.join(heads, "key").select("key", "node", "size", "first"), "buckets")

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        for node, s in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text"), k), strict=True):
            if len(s) <= LONG:
                for o, v in zip(out, (node, -1, s.view(np.int64), True), strict=True):
                    o.append(v)
            if len(s) > similarity * LONG:
                of = (s & np.uint64(SLICES - 1)).astype(np.int64)
                for part in range(SLICES):
                    for o, v in zip(out, (node, part, s[of == part].view(np.int64), len(s) > LONG), strict=True):
                        o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.bool_())], names=["node", "part", "s", "whole"])

    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("head._uid").alias("_uid"))
    shingles = keep(map_arrow(slim.select("_uid", "text").join(wanted.hint("merge"), "_uid").select("node", "text"), sets, "node long, part int, s array<long>, whole boolean"), "shingles")

    stars = buckets.where("node <> first.node").selectExpr("first.node AS a", "node AS b", "first.size AS size_a", "size AS size_b").distinct()
    linked = keep(_verified(stars, shingles, similarity), "near-links")
    roots = keep(components(linked), "near-roots")
    pairs, crowd = _meetings(_rooted(buckets.select("key", "node", "size"), roots), CROWD, True)
    linked = keep(linked.unionByName(_verified(pairs, shingles, similarity)), "near-links")
    crowd = keep(crowd.select("node", "size").distinct(), "crowd")
    if not crowd.isEmpty():
        roots = keep(components(linked), "near-roots")
        pairs, crowd = _meetings(_rooted(_rarest(crowd, shingles.where("whole").select("node", "s"), similarity), roots), CROWD, True)
        linked = keep(linked.unionByName(_verified(pairs, shingles, similarity)), "near-links")
        crowd = keep(crowd.select("node").distinct(), "crowd")
        if not crowd.isEmpty():
            roots = keep(components(linked), "near-roots")
            still = _rooted(nodes.join(crowd, "node", "left_semi").select("node", "size"), roots)
            linked = keep(linked.unionByName(_block_links(still, shingles.where("whole").select("node", "s"), similarity)), "near-links")
    named = components(linked).withColumnRenamed("node", "n")
    rooted = nodes.join(named, nodes["node"] == named["n"], "left").select("node", "head", F.coalesce("root", "node").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("head").alias("top"))
    tops = rooted.select("node", "root").join(heads, "root").select("node", "top")
    return rows.join(tops, "node").select(
        "_uid", "doc_id", F.col("top.doc_id").alias("component_id"), (F.col("_uid") == F.col("top._uid")).alias("keeper"))
