"""SimHash near-duplicates with bit-sliced comparison.

Distinct fingerprints are cut into 4 blocks of 16 bits; two that differ in at most 2 bits agree in at least two blocks,
so each fingerprint is filed under its 6 pairs of blocks. Within a file the fingerprints stand as vertical bit
planes: one 64-bit word holds the same bit of 64 fingerprints, and a two-bit carry-save counter per lane, with a
sticky overflow, updates 64 distances at once. A block is abandoned when all its lanes exceed the radius.
Files beyond `most` members are not compared: there every fingerprint is
filed under itself and its 64 one-bit neighbours instead, where all members of a file link (any two are within 2
bits) and a file holds at most 65, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_limits, components, materialize, spread_join, tables_of

BLOCKS = 4
BLOCK_BITS = 16
RADIUS = 2
#: Members of a file that are compared with each other; larger files take the exact way by one-bit neighbours.
FILE_MOST = 512
SEED = 42
#: Filed members that a task compares.
TASK_MEMBERS = 4096


def dealt(filed: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Rows of the files of 2 to `most` members, dealt by file over as many tasks as their number asks for."""
    kept = sizes.where(F.col("n") <= most)
    rows = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return filed.join(kept.select("file"), "file").repartition(max(16, -(-rows // TASK_MEMBERS)), "file")


def shingle_hashes(text: bytes, width: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle of the ASCII-lower-cased text, repeats included; fewer words make one shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[: -width]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half the hashes."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for a in range(0, n, 65536):
        total += np.unpackbits(hashes[a : a + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """SimHash of a text's word shingles; 0 without words."""
    return simhash(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """`keep` columns and `fp` (the fingerprint's bits as a signed bigint), one row per input row; null text: 0."""
    batch_limits(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint((t or "").encode(), width) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["fp bigint"])
    return src.mapInArrow(run, types)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of n fingerprints: array (64, ceil(n / 64)), bit k of word w in plane b is bit b of fingerprint 64 w + k."""
    n = len(fps)
    pad = np.zeros(-(-n // 64) * 64, np.uint64)
    pad[:n] = fps
    bits = np.unpackbits(pad.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # (n, 64)
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within(probe: int, vertical: np.ndarray, n: int, radius: int = RADIUS) -> np.ndarray:
    """Indices of the fingerprints behind `vertical` within `radius` bits of the probe.

    Distances stand as bit planes too: adding a plane of differences ripples through the counters' planes, and what leaves the
    highest is kept as overflow, so that one pass of words moves 64 distances.
    """
    words = vertical.shape[1]
    size = max(1, (radius + 1).bit_length())
    counter = np.zeros((size, words), np.uint64)
    over = np.zeros(words, np.uint64)
    live = np.arange(words)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)

    def beyond() -> np.ndarray:
        greater, equal = over.copy(), np.full(len(over), full)
        for k in range(size - 1, -1, -1):
            if radius >> k & 1:
                equal &= counter[k]
            else:
                greater |= equal & counter[k]
                equal &= ~counter[k]
        return greater

    for b in range(64):
        carry = vertical[b, live]
        if probe >> b & 1:
            carry = ~carry
        for k in range(size):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 16 == 15 and b < 63:
            keep = beyond() != full
            if not keep.all():  # abandon the blocks in which every lane is beyond the radius
                if not keep.any():
                    return np.zeros(0, np.int64)
                live, counter, over = live[keep], counter[:, keep], over[keep]
    lanes = np.unpackbits((~beyond()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    at = live[row] * 64 + lane
    return at[at < n]


def link_file(fps: np.ndarray, radius: int = RADIUS, sketches: np.ndarray | None = None, least: int = 0, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a file's members: (member, its root) by breadth-first search over bit-sliced distances.

    With sketches (a row of MinHash bytes each) members also have to agree in `least` bytes. Links have the members'
    `names`, or else their fingerprints.
    """
    n = len(fps)
    names = fps if names is None else names
    vertical = planes(fps)
    free = np.ones(n, bool)
    a, b = [], []
    for k in range(n):
        if not free[k]:
            continue
        free[k] = False
        queue = [k]
        while queue:
            at = queue.pop()
            near = within(int(fps[at]), vertical, n, radius)
            near = near[free[near]]
            if sketches is not None and len(near):
                near = near[(sketches[near] == sketches[at]).sum(1) >= least]
            free[near] = False
            queue.extend(near.tolist())
            a.append(names[near])
            b.append(np.full(len(near), names[k]))
    return np.concatenate(a), np.concatenate(b)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, members) to links; a file is one row with the members as an array of at most FILE_MOST."""
    for batch in batches:
        left, right = [], []
        for members in batch.column(0):
            fps = np.sort(members.values.to_numpy().view(np.uint64))
            x, y = link_file(fps)
            left.append(x)
            right.append(y)
        cat = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([cat(left), cat(right)], names=["a", "b"])


def links(distinct: DataFrame, most: int = FILE_MOST) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect exactly what lies within 2 bits."""
    spark = distinct.sparkSession
    mask = (1 << BLOCK_BITS) - 1
    files = []
    for k, (i, j) in enumerate(combinations(range(BLOCKS), 2)):
        hi = F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit(mask).cast("bigint"))
        lo = F.shiftrightunsigned("fp", BLOCK_BITS * j).bitwiseAND(F.lit(mask).cast("bigint"))
        files.append(F.lit(k << 2 * BLOCK_BITS).cast("bigint") + hi * F.lit(1 << BLOCK_BITS) + lo)
    filed = distinct.select(F.explode(F.array(*files)).alias("file"), "fp")
    sizes = materialize(filed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-files")
    shared = filed.join(sizes, "file")
    small = dealt(filed, sizes, most).groupBy("file").agg(F.collect_list("fp").alias("members")).select("members")
    out = small.mapInArrow(_compare, "a bigint, b bigint")
    if not sizes.where(F.col("n") > most).isEmpty():
        # the exact way for large files: one-bit neighbourhoods of their members
        large = shared.where(F.col("n") > most).select("fp").distinct()
        flips = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1).cast("bigint") if b == 0 else F.shiftleft(F.lit(1).cast("bigint"), b)) for b in range(64)])).alias("near")
        balls = large.select("fp", flips).groupBy("near").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("members")).where(F.size("members") > 1)
        out = out.unionAll(balls.select(F.explode("members").alias("a"), "b").where("a <> b"))
    return out.distinct()


def groups(docs: DataFrame, keep: list[str], rank: str, text: str = "text", width: int = 3, label: str = "simhash") -> DataFrame:
    """`keep` columns, fp and component: the smallest `rank` of the documents reachable by links.

    Null and empty texts have fingerprint zero and link like any other; repeated rows stay as rows, ties and all; a null rank
    never becomes a component unless all of a component's ranks are null. A very long text is hashed whole, its shingles
    being all that is held. An empty table gives an empty result. Columns that are not kept are not read, whatever their
    names; kept columns named fp or component clash with the result's and must be renamed before.
    """
    fp = materialize(fingerprints(docs, keep, text, width), label)
    with tables_of(docs.sparkSession) as keep_table:
        distinct = materialize(fp.groupBy("fp").agg(F.min(F.col(f"`{rank}`")).alias("low")), label)
        roots = components(docs.sparkSession, links(distinct), label)
        full = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), label)
        low = materialize(full.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("n")), label)
        table = spread_join(full, low, "root").select("fp", "component")
        times = fp.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
        table = materialize(table.join(times, "fp"), label)
        keep_table(table)
    return spread_join(fp, table, "fp")


#: Near copies by whole texts: the sets of 5-word shingles have a similarity (shared of all shingles) of 0.8. MinHash files the
#: texts (BANDS keys of BAND values each, which finds a pair at 0.8 with probability 0.9996); the bit-sliced distance and the
#: sketch only rule out what is far below (each loses about one pair at 0.8 in a million); the shingle sets themselves decide.
NEAR_WIDTH = 5
NEAR_SIMILARITY = 0.8
NEAR_RADIUS = 28
NEAR_SLACK = 0.175
BANDS, BAND, SKETCH = 15, 4, 128
#: Members whose shingle sets are compared in one task.
SETS_MOST = 256


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, SKETCH, np.uint64)


def sketch(text: bytes, width: int = NEAR_WIDTH) -> tuple[int, bytes, list[int], int]:
    """Of a text's shingle set: the fingerprint, the low bytes of SKETCH MinHash values, the BANDS filing keys (signed), and its hash."""
    import xxhash

    hashes = np.unique(shingle_hashes(text, width))
    if not len(hashes):
        return 0, bytes(SKETCH), [0] * BANDS, 0
    a, b = _multipliers()
    least = np.full(SKETCH, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for s in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[s : s + 2048, None] * a + b).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(least[BAND * k : BAND * k + BAND].tobytes(), k) for k in range(BANDS)]
    # the high byte of a minimum is nearly always 0; a middle one is even
    return simhash(hashes), ((least >> np.uint64(8)) & np.uint64(255)).astype(np.uint8).tobytes(), np.array(keys, np.uint64).view(np.int64).tolist(), xxhash.xxh64_intdigest(hashes.tobytes())


def near_links(distinct: DataFrame, most: int = FILE_MOST, similarity: float = NEAR_SIMILARITY, radius: int = NEAR_RADIUS) -> DataFrame:
    """Candidate links (a, b) of distinct shingle sets (node, or else fp as their name; fp, sig, keys): their components hold all similar texts.

    Texts that share a key stand in one file. In a file beyond `most` nothing is compared: all its members link to the first,
    so no pair of it is left out, and confirmed() tells which of them are similar.
    """
    least = int(SKETCH * (similarity - NEAR_SLACK))
    filed = distinct.select(F.explode("keys").alias("file"), F.col("node" if "node" in distinct.columns else "fp").alias("node"), "fp", "sig")
    sizes = materialize(filed.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1"), "simhash-near")
    small = dealt(filed, sizes, most).groupBy("file").agg(F.collect_list(F.struct("node", "fp", "sig")).alias("members")).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for row in batch.to_pylist():
                members = {m["node"]: m for m in row["members"]}
                if len(members) < 2:
                    continue
                names = sorted(members)
                fps = np.array([members[k]["fp"] for k in names], np.int64).view(np.uint64)
                sigs = np.frombuffer(b"".join(members[k]["sig"] for k in names), np.uint8).reshape(len(fps), -1)
                x, y = link_file(fps, radius, sigs, least, np.array(names, np.int64))
                left.append(x)
                right.append(y)
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([cat(left), cat(right)], names=["a", "b"])

    out = small.mapInArrow(run, "a bigint, b bigint")
    if not sizes.where(F.col("n") > most).isEmpty():
        large = filed.select("file", "node").join(sizes.where(F.col("n") > most), "file")
        out = out.unionAll(large.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    return out.distinct()


def similar(sets: list[np.ndarray], similarity: float = NEAR_SIMILARITY):
    """A function from k to the mask of the sets (of distinct hashes) whose similarity to the k-th is `similarity` or more, exactly."""
    n = len(sets)
    lengths = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    owner = np.repeat(np.arange(n), lengths)[order]
    ends = np.cumsum(np.bincount(ids))
    starts = np.r_[0, ends[:-1]]
    own = np.split(ids, np.cumsum(lengths)[:-1])

    def near(k: int) -> np.ndarray:
        at, size = starts[own[k]], ends[own[k]] - starts[own[k]]
        where = np.repeat(at - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        shared = np.bincount(owner[where], minlength=n)
        return shared / np.maximum(lengths + lengths[k] - shared, 1) >= similarity

    return near


def link_sets(names: np.ndarray, sets: list[np.ndarray], similarity: float = NEAR_SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the members whose sets are similar: (member, its root) by breadth-first search."""
    near, free = similar(sets, similarity), np.ones(len(names), bool)
    a, b = [names[:0]], [names[:0]]
    for k in range(len(names)):
        queue = [k] if free[k] else []
        free[k] = False
        while queue and free.any():
            got = np.flatnonzero(near(queue.pop()) & free)
            free[got] = False
            queue.extend(got.tolist())
            a.append(names[got])
            b.append(np.full(len(got), names[k]))
    return np.concatenate(a), np.concatenate(b)


def link_apart(names: np.ndarray, subs: np.ndarray, left: np.ndarray, sets: list[np.ndarray], similarity: float = NEAR_SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links of the members marked `left` to similar ones of other groups (subs), one for each pair of groups."""
    near, found = similar(sets, similarity), {}
    for k in np.flatnonzero(left).tolist():
        for j in np.flatnonzero(near(k) & (subs != subs[k])).tolist():
            found.setdefault((subs[k], subs[j]), (names[k], names[j]))
    got = np.array(list(found.values()), np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def _linked(grouped: DataFrame, apart: bool, similarity: float) -> DataFrame:
    """Links (a, b) of the rows of `grouped`, whose only column `members` has arrays of (node, sub, probe, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for members in batch.column(0):
                m = members.values
                rows = {}
                for k, (node, probe) in enumerate(zip(m.field("node").to_pylist(), m.field("probe").to_pylist(), strict=True)):
                    if probe or node not in rows:
                        rows[node] = k
                if len(rows) < 2:
                    continue
                m = m.take(pa.array(sorted(rows.values()), pa.int64()))
                names = m.field("node").to_numpy()
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in m.field("hashes")]
                x, y = link_apart(names, m.field("sub").to_numpy(), m.field("probe").to_numpy(zero_copy_only=False), sets, similarity) if apart else link_sets(names, sets, similarity)
                left.append(x)
                right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], names=["a", "b"])

    return grouped.mapInArrow(run, "a bigint, b bigint")


def confirmed(texts: DataFrame, roots: DataFrame, width: int = NEAR_WIDTH, similarity: float = NEAR_SIMILARITY, most: int = SETS_MOST, label: str = "simhash-near") -> DataFrame:
    """Components (node, root) of the candidates whose shingle sets have the similarity, none other.

    roots: (node, root) of all members of the candidates' components, the roots themselves included; texts: (node, text) of
    these nodes. A component beyond `most` is dealt over parts with its root in each. Then members outside of its largest
    group so far are compared, in blocks, with all that are in other groups, so no pair is left out.
    """
    spark = roots.sparkSession
    sized = materialize(roots.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root"), label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes((t or "").encode(), width)).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["node", "root", "n", "hashes"])

    def members(sub, probe) -> list:
        return F.collect_list(F.struct("node", sub.alias("sub"), probe.alias("probe"), "hashes")).alias("members")

    sets = sized.join(texts, "node").select("node", "root", "n", "text").mapInArrow(run, "node bigint, root bigint, n bigint, hashes binary")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / most)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.ceil(F.col(n) / most).cast("int") - 1)
    part = F.explode(F.when(F.col("node") == F.col("root"), every("n")).otherwise(F.array(deal("n"))))
    parts = sets.withColumn("part", part).groupBy("root", "part").agg(members(F.col("root"), F.lit(False))).select("members")
    inner = materialize(_linked(parts, False, similarity), label)
    found = components(spark, inner, label)
    if sized.where(F.col("n") > most).isEmpty():
        return found
    own = found.select("node", F.col("root").alias("sub"))
    large = materialize(sized.where(F.col("n") > most).join(own, "node", "left").select("node", "root", "n", F.coalesce("sub", "node").alias("sub")), label)
    tally = large.groupBy("root", "sub").agg(F.count(F.lit(1)).alias("c")).groupBy("root").agg(F.max(F.struct("c", "sub")).alias("main"), F.sum("c").alias("all"))
    tally = tally.select("root", F.col("main.sub").alias("main"), (F.col("all") - F.col("main.c")).alias("rest")).where("rest > 0")
    split = materialize(large.join(tally, "root").select("node", "sub", "main", "rest"), label)
    if split.isEmpty():
        return found
    held = materialize(sets.join(split, "node"), label)
    left = held.where("sub <> main").withColumns({"q": deal("rest"), "probe": F.lit(True)}).withColumn("p", F.explode(every("n")))
    right = held.withColumns({"p": deal("n"), "probe": F.lit(False)}).withColumn("q", F.explode(every("rest")))
    blocks = left.unionByName(right).groupBy("root", "p", "q").agg(members(F.col("sub"), F.col("probe"))).select("members")
    outer = materialize(_linked(blocks, True, similarity), label)
    return components(spark, inner.unionAll(outer), label)


def near_groups(docs: DataFrame, keep: list[str], rank: str, text: str = "text", width: int = NEAR_WIDTH, label: str = "simhash-near") -> DataFrame:
    """Like groups(), for texts whose shingle sets have a similarity of 0.8 or more rather than for near fingerprints.

    `root` names a group whatever its ranks are. Texts of fewer words than a shingle have one shingle, their words; texts without
    words (null, empty, white space) are one group. Ties of rank between equal texts decide nothing. A very long text is
    sketched in blocks of shingles, and its set of distinct shingle hashes is what a comparison holds.
    """
    batch_limits(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(F.col(f"`{text}`")).alias("__hash"), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sketch((t or "").encode(), width) for t in batch.column(batch.num_columns - 1).to_pylist()]
            fps, sets = (pa.array(np.array([g[k] for g in got], np.uint64).view(np.int64)) for k in (0, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps, pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.int64())), sets], names=[*batch.schema.names[:-1], "fp", "sig", "keys", "__set"])

    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["fp bigint, sig binary, keys array<bigint>, `__set` bigint"])
    fp = materialize(src.mapInArrow(run, types), label)
    with tables_of(docs.sparkSession) as keep_table:
        low, one = F.min(F.col(f"`{rank}`")).alias("low"), F.min(F.struct(F.col(f"`{rank}`").alias("rank"), "__hash")).alias("one")
        distinct = materialize(fp.groupBy(F.col("__set").alias("node")).agg(low, one, F.min(F.struct("fp", "sig", "keys")).alias("s"), F.count(F.lit(1)).alias("copies")).select("node", "low", "one", "copies", "s.fp", "s.sig", "s.keys"), label)
        found = components(docs.sparkSession, near_links(distinct), label)
        found = materialize(found.unionAll(found.select(F.col("root").alias("node"), "root").distinct()), label)
        # one text stands for each shingle set
        ones = found.join(distinct, "node").select("node", F.col("one.rank").alias("__rank"), F.col("one.__hash").alias("__one"))
        texts = docs.select(F.col(f"`{rank}`").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__hash"), F.col(f"`{text}`").alias("text"))
        texts = texts.join(ones, F.col("__id").eqNullSafe(F.col("__rank")) & (F.col("__hash") == F.col("__one"))).select("node", "text")
        roots = confirmed(texts, found, width, label=label)
        full = distinct.select("node", "low", "copies").join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", "low", "copies", F.coalesce("root", "node").alias("root"))
        full = materialize(full, label)
        table = materialize(full.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("n")), label)
        table = materialize(spread_join(full, table, "root").select(F.col("node").alias("__set"), "root", "component", "copies"), label)
        keep_table(table)
    return spread_join(fp.drop("sig", "keys", "__hash"), table, "__set", "copies").drop("__set")


def dedup_stage(docs: DataFrame, width: int = NEAR_WIDTH) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (null after all others), ties by the whole row; own columns kept.

    A row is known by its doc_id and its text's hash, so neither null nor repeated ids join groups. Columns of any name are
    carried along; an empty table stays empty; texts without words are near copies of each other, and one of them stays.
    """
    names = docs.columns
    row = F.xxhash64("text")
    with tables_of(docs.sparkSession) as keep_table:
        g = near_groups(docs.select("doc_id", "text", row.alias("__row")), ["doc_id", "__row"], "doc_id", width=width)
        heads = g.where("doc_id <=> component").groupBy(F.col("doc_id").alias("__head"), "__row", F.col("root").alias("__root")).agg(F.count(F.lit(1)).alias("n"))
        heads = materialize(heads, "simhash-heads")
        keep_table(heads)
    same = docs.doc_id.eqNullSafe(heads["__head"]) & (row == heads["__row"])
    # the text is shuffled again only where a group has several heads
    if heads.groupBy("__root").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
        return docs.join(heads, same, "left_semi")
    rows = F.struct(*[F.col(f"`{c}`") for c in names])
    return docs.join(heads, same).groupBy("__root").agg(F.min(rows).alias("row")).select("row.*")
