"""Exact removal of byte strings that occur twice, by suffix arrays over shards.

A window is a string of `WINDOW` bytes inside one document. Its anchor is the leftmost k-gram of smallest hash in it, so equal
windows have equal anchors at equal places, and only windows under anchors that occur at least twice can repeat.

1. Anchors are counted by hash (combined before the shuffle).
2. Runs of windows under a repeated anchor become blocks of text, dealt to shards by the anchor's hash; an anchor
   with more than `HOT` occurrences is dealt over several shards.
3. In a shard equal blocks are folded, and a suffix array of the blocks still in question is built by
   Larsson-Sadakane refinement in numpy; Kasai's common prefixes of neighbouring suffixes tell the windows found twice.
4. Windows of hot anchors that were found once in their shard are merged across shards: each shard sends the digests
   of its distinct windows, sorted, and the lists of a digest range are merged by binary search.
5. Covered bytes are the union of the repeated windows; they are cut from the input texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, batch_limits, materialize, tables_of

WINDOW = 200
GRAM = 32
#: Occurrences of one anchor beyond which they are dealt over several shards.
HOT = 4096
#: Bytes of text hashed at a time, and bytes of blocks in a shard.
SLICE = 1 << 20
SHARD_BYTES = 4 << 20

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded.data, 0, (1,)).astype(np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on (places whose gram is complete)."""
    w = words_at(data)
    w = w * _M[0]
    w ^= w >> np.uint64(32)
    n = len(data) - GRAM + 1
    h = w[:n] * _M[1]
    for k in range(1, GRAM // 8):
        h = (h ^ (h >> np.uint64(29))) * _M[4] + w[8 * k : 8 * k + n] * _M[1 + k % 3]
    h ^= h >> np.uint64(31)
    h *= _M[4]
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, step = x, 1
    while 2 * step <= width:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def runs(offsets: np.ndarray, data: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one anchor: (document, first window's place in data, windows, anchor's hash).

    `offsets` cuts `data` (below 16 MB) into documents; no window crosses a cut.
    """
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if len(data) < window or not (sizes >= window).any():
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(data)
    place = np.uint64(0xFFFFFF)
    low = sliding_min((h & ~place) | np.arange(len(h), dtype=np.uint64), window - GRAM + 1)
    edge = np.zeros(len(data) + 1, np.int32)
    fits = np.flatnonzero(sizes >= window)
    np.add.at(edge, offsets[fits], 1)
    np.add.at(edge, offsets[fits + 1] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(edge)[: len(low)])
    anchor = (low[at] & place).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    start = at[first]
    count = np.diff(np.r_[first, len(at)])
    return np.searchsorted(offsets, start, "right") - 1, start, count, h[anchor[first]]


def segments(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of about SLICE bytes: (rows, place of each piece in its document, offsets, data). Longer documents are cut into pieces that share window - 1 bytes."""
    rows, base, parts, size = [], [], [], 0
    for k in range(len(ids)):
        a, b = int(offsets[k]), int(offsets[k + 1])
        if b - a < window:
            continue
        for s in range(a, b - window + 1, SLICE):
            e = min(b, s + SLICE + window - 1)
            rows.append(k)
            base.append(s - a)
            parts.append(data[s:e])
            size += e - s
            if size >= SLICE:
                yield np.array(rows), np.array(base), np.r_[0, np.cumsum([len(p) for p in parts])], np.concatenate(parts)
                rows, base, parts, size = [], [], [], 0
    if parts:
        yield np.array(rows), np.array(base), np.r_[0, np.cumsum([len(p) for p in parts])], np.concatenate(parts)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, base, offsets, data in segments(ids, *as_binary(batch.column(1)), window):
                doc, start, _, h = runs(offsets, data, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ids[rows[doc]]), pa.array(start - offsets[doc] + base[doc])], names=["h", "rid", "at"]
                )

    return run


def _block_rows(window: int):
    """Rows (rid, text, ats, ns): the runs that start at `ats` as blocks, with the salt of the hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            ats = [np.array(x.values) for x in batch.column(2)]
            ns = [np.array(x.values) for x in batch.column(3)]
            for rows, base, offsets, data in segments(ids, *as_binary(batch.column(1)), window):
                doc, start, count, h = runs(offsets, data, window)
                place = start - offsets[doc] + base[doc]
                n = np.zeros(len(doc), np.int64)
                bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
                for d in range(len(rows)):
                    want, a, b = ats[rows[d]], bounds[d], bounds[d + 1]
                    if a == b or not len(want):
                        continue
                    order = np.argsort(want)
                    sorted_at = want[order]
                    k = np.minimum(np.searchsorted(sorted_at, place[a:b]), len(want) - 1)
                    n[a:b] = np.where(sorted_at[k] == place[a:b], ns[rows[d]][order[k]], 0)
                take = np.flatnonzero(n)
                size = count[take] + window - 1
                group = np.cumsum(size) // (4 << 20)
                for g in np.unique(group):
                    part = take[group == g]
                    length = count[part] + window - 1
                    ends = np.r_[0, np.cumsum(length)]
                    flat = data[np.repeat(start[part] - ends[:-1], length) + np.arange(ends[-1])]
                    block = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[part].view(np.int64)), pa.array(n[part]), pa.array(ids[rows[doc[part]]]), pa.array(place[part]), block],
                        names=["h", "n", "rid", "at", "block"],
                    )

    return run


def suffix_array(data: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes of `data` in order of their first `reach` bytes at least (zeros follow the end).

    Larsson-Sadakane: sort by 8 bytes, then double; a round sorts only suffixes whose group is not yet single, by
    the rank of the suffix as far behind them as is already sorted.
    """
    n = len(data)
    key = words_at(data)
    order = np.argsort(key, kind="stable")
    head = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool)
    slot = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = slot
    single = head & np.r_[head[1:], True] if n else head
    active = np.flatnonzero(~single)
    done = 8
    while done < reach and len(active):
        item = order[active]
        behind = item + done
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key2 = rank[item] * (n + 1) + second
        by = np.argsort(key2, kind="stable")
        item, key2 = item[by], key2[by]
        order[active] = item
        new = np.r_[True, key2[1:] != key2[:-1]]
        rank[item] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        single = new & np.r_[new[1:], True]
        active = active[~single]
        done *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to `most` bytes, of each suffix of `order` with the one before it (0 for the first).

    Kasai's argument in text order: where the neighbour of place i is one behind the neighbour of place i - 1, the
    common prefix is one byte shorter; only the other places are compared, 8 bytes of all of them at a time.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    place, other = order[1:], order[:-1]
    by = np.argsort(place, kind="stable")
    i, phi = place[by], other[by]
    follows = np.r_[False, (i[1:] == i[:-1] + 1) & (phi[1:] == phi[:-1] + 1)]
    # a chain is cut where it outgrows what its head was compared to
    lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(i))))
    far = np.arange(len(i)) - lead
    heads = np.flatnonzero(~follows | (far % most == 0))
    lead = np.maximum.accumulate(np.where(np.isin(np.arange(len(i)), heads, assume_unique=True), np.arange(len(i)), 0))
    far = np.arange(len(i)) - lead
    w = words_at(data)
    size = len(data)
    limit = 2 * most
    got = np.zeros(len(heads), np.int64)
    live = np.arange(len(heads))
    a, b = i[heads], phi[heads]
    step = 0
    while len(live) and step < limit:
        x, y = a[live] + step, b[live] + step
        inside = (x < size) & (y < size)
        diff = np.where(inside, w[np.minimum(x, size - 1)] ^ w[np.minimum(y, size - 1)], np.uint64(1) << np.uint64(63))
        same = diff == 0
        lead_zero = np.zeros(len(diff), np.int64)
        for k in range(7, 0, -1):
            lead_zero[(diff >> np.uint64(64 - 8 * k) == 0) & (lead_zero == 0)] = k
        got[live] += np.where(same, 8, lead_zero)
        live = live[same]
        step += 8
    at_head = np.zeros(len(i), np.int64)
    at_head[heads] = got
    lcp = np.maximum(at_head[lead] - far, 0)
    out[1:][by] = np.minimum(lcp, most)
    return out


def repeated_windows(blocks: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the blocks in suffix order: (block, place in it, whether found at least twice, class)."""
    data = np.frombuffer(b"".join(blocks), np.uint8)
    sizes = np.array([len(b) for b in blocks], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    order = suffix_array(data, window)
    owner = np.repeat(np.arange(len(blocks), dtype=np.int32), sizes)
    left = starts[1:][owner[order]] - order
    order = order[left >= window]  # the suffixes that are windows
    near = common_prefixes(data, order, window) >= window
    twice = near | np.r_[near[1:], False] if len(near) else near
    return owner[order].astype(np.int64), order - starts[owner[order]], twice, np.cumsum(~near)


OUT = "kind int, rid bigint, a bigint, b bigint, d1 bigint, d2 bigint"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _rows(kind: int, rid, a, b, d1=None, d2=None) -> pa.RecordBatch:
    n = len(rid)
    none = pa.nulls(n, pa.int64())
    cols = [pa.array(np.full(n, kind, np.int32)), rid if isinstance(rid, pa.Array) else pa.array(rid, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
    return pa.RecordBatch.from_arrays([*cols, none if d1 is None else pa.array(d1, pa.int64()), none if d2 is None else pa.array(d2, pa.int64())], names=_NAMES)


def _shard(window: int, hot: int):
    """One shard: kind 0 are removed stretches [a, b) of document rid; kind 1 are distinct windows of hot anchors with
    their digest, where rid is null if the window is already known to repeat."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        h, n = table["h"].to_numpy(), table["n"].to_numpy()
        rid, at = table["rid"].to_numpy(), table["at"].to_numpy()
        column = table["block"]
        coded = pc.dictionary_encode(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        texts = coded.dictionary
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        times = np.bincount(code, minlength=len(texts))
        one = np.zeros(len(texts), np.int64)
        one[code] = np.arange(len(code))  # an occurrence of each text
        text_h, text_hot = h[one], n[one] > hot
        _, back, kinds = np.unique(text_h, return_inverse=True, return_counts=True)
        open_ = (kinds[back] > 1) | text_hot
        # texts alone under their anchor: all or nothing
        run_code, run_a, run_b = [np.flatnonzero(~open_ & (times > 1))], [], []
        run_a.append(np.zeros(len(run_code[0]), np.int64))
        run_b.append(size[run_code[0]])
        out = []
        which = np.flatnonzero(open_)
        if len(which):
            block, place, twice, cls = repeated_windows(texts.take(pa.array(which)).to_pylist(), window)
            block = which[block]
            known = twice | (times[block] > 1)
            by = np.lexsort((place, block))
            b, p = block[by], place[by]
            keep = known[by]
            b, p = b[keep], p[keep]
            if len(b):
                first = np.r_[True, (b[1:] != b[:-1]) | (p[1:] != p[:-1] + 1)]
                last = np.r_[first[1:], True]
                run_code.append(b[first])
                run_a.append(p[first])
                run_b.append(p[last] + window)
            spread = np.flatnonzero(text_hot[block])
            if len(spread):
                # one row for each distinct window under a hot anchor
                head = spread[np.r_[True, cls[spread][1:] != cls[spread][:-1]]]
                view = [x.as_py() for x in texts.take(pa.array(block[head]))] if len(head) < 50_000 else None
                digest = np.empty((len(head), 2), np.int64)
                for k in range(len(head)):
                    text = view[k] if view is not None else texts[int(block[head[k]])].as_py()
                    s = int(place[head[k]])
                    digest[k] = np.frombuffer(hashlib.blake2b(text[s : s + window], digest_size=16).digest(), np.int64)
                occ = one[block[head]]
                ids = pa.array(rid[occ], pa.int64(), mask=known[head])
                order = np.lexsort((digest[:, 1], digest[:, 0]))
                start = at[occ] + place[head]
                out.append(_rows(1, ids.take(pa.array(order)), start[order], start[order] + window, digest[order, 0], digest[order, 1]))
        rc, ra, rb = map(np.concatenate, (run_code, run_a, run_b))
        by = np.argsort(rc, kind="stable")
        rc, ra, rb = rc[by], ra[by], rb[by]
        lo, hi = np.searchsorted(rc, code), np.searchsorted(rc, code, "right")
        many = hi - lo
        total = int(many.sum())
        row = np.repeat(np.arange(len(code)), many)
        pick = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(total)
        out.append(_rows(0, rid[row], at[row] + ra[pick], at[row] + rb[pick]))
        return pa.Table.from_batches(out)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Digests of one range from all shards: stretches of the windows that were single in their shard but occur in another."""
    d1, d2 = table["d1"].to_numpy(), table["d2"].to_numpy()
    order = np.lexsort((d2, d1))
    s1, s2 = d1[order], d2[order]
    # binary search by the first half, then by the second among the few that share the first
    times = np.searchsorted(s1, d1, "right") - np.searchsorted(s1, d1)
    for k in np.flatnonzero(times > 1).tolist():
        lo = np.searchsorted(s1, d1[k])
        part = s2[lo : lo + times[k]]
        times[k] = np.searchsorted(part, d2[k], "right") - np.searchsorted(part, d2[k])
    again = pc.and_(pa.array(times > 1), pc.is_valid(table["rid"]))
    t = table.filter(again)
    return pa.Table.from_batches([_rows(0, np.array(t["rid"].to_pylist(), np.int64), t["a"].to_numpy(), t["b"].to_numpy())])


def with_row_id(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, key, text): rid is the key where it is unique and not null, else a number fixed by writing the table once."""
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    plain = src.schema["key"].dataType.simpleString() in ("bigint", "int")
    if plain and src.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR key IS NULL").isEmpty():
        return src.select(F.col("key").cast("bigint").alias("rid"), "key", "text")
    return materialize(src.select(F.monotonically_increasing_id().alias("rid"), "key", "text"), "suffix-rows")


def removed(rows: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(rid, spans): stretches of each document that repeated windows cover, unmerged."""
    spark = rows.sparkSession
    batch_limits(spark)
    texts = rows.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    anchors = texts.mapInArrow(_anchor_rows(window), "h bigint, rid bigint, at bigint")
    with tables_of(spark) as keep_table:
        often = materialize(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-anchors")
        figures = often.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        shards = max(64, math.ceil(figures["all"] * 1.45 * window / SHARD_BYTES))
        wanted = anchors.join(often, "h").groupBy("rid").agg(F.collect_list("at").alias("ats"), F.collect_list("n").alias("ns"))
        blocks = texts.join(wanted, "rid").select("rid", "text", "ats", "ns").mapInArrow(_block_rows(window), "h bigint, n bigint, rid bigint, at bigint, block binary")
        salt = F.when(F.col("n") > hot, F.pmod(F.xxhash64("rid", "at"), F.ceil(F.col("n") / hot))).otherwise(F.lit(0)).cast("bigint")
        dealt = blocks.withColumn("shard", F.pmod(F.xxhash64("h", salt), F.lit(shards)).cast("int"))
        found = materialize(dealt.groupBy("shard").applyInArrow(_shard(window, hot), OUT), "suffix-found")
        keep_table(found)
    spans = found.where("kind = 0").select("rid", "a", "b")
    if figures["most"] > hot:
        ranges = F.pmod(F.col("d1"), F.lit(max(64, shards // 4))).alias("range")
        again = found.where("kind = 1").select("*", ranges).groupBy("range").applyInArrow(_merge, OUT)
        spans = spans.unionAll(again.select("rid", "a", "b"))
    return spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal stretches of a document's spans."""
    if spans is None or not len(spans):
        return []
    a = np.array([s["a"] for s in spans], np.int64)
    b = np.array([s["b"] for s in spans], np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return list(zip(a[first].tolist(), b[np.r_[first[1:] - 1, len(b) - 1]].tolist(), strict=True))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they hold only in part."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the digest of what remains. Null texts are empty; repeated rows
    count as documents of their own and so remove each other. A very long text is cut into slices that share what a window
    needs, so every window of it is seen. An empty table gives no rows. Columns other than key and text are not read, whatever
    their names; a null or repeated key is given back as it is."""
    rows = with_row_id(docs, key, text)
    gone = removed(rows, window, hot)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = (raw or "").encode()
                s = merged(spans.as_py())
                kept = cut(raw, s)
                got.append((len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*got, strict=True)) or [(), (), (), ()]
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    full = rows.join(gone, "rid", "left").select("key", "text", "spans")
    out = full.mapInArrow(run, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("key", key)


def dedup_stage(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages cut from `text` (whole characters only) and n_chars set anew.

    Every row stays, with whatever text is left; a null text stays null. Columns of any name are carried along, a very long text
    is treated whole, and an empty table stays empty.
    """
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")]).alias("rest"))
    rows = packed.select(F.col("doc_id").alias("rid"), "text", "rest", F.col("doc_id").alias("key"))
    unique = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
    if not unique:
        rows = materialize(packed.select(F.monotonically_increasing_id().alias("rid"), "text", "rest", F.col("doc_id").alias("key")), "suffix-stage")
    gone = removed(rows.select("rid", "text"), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, spans in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                if raw is not None and spans.is_valid:
                    raw = raw.encode()
                    raw = cut(raw, whole_characters(raw, merged(spans.as_py()))).decode()
                texts.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["key", "rest", "text"])

    full = rows.join(gone, "rid", "left").select("key", "rest", "text", "spans")
    rest = full.schema["rest"].dataType.simpleString()
    out = full.mapInArrow(run, f"key {full.schema['key'].dataType.simpleString()}, rest {rest}, text string")
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None
    cols = [F.col("key").alias(c) if c == "doc_id" else F.col("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in names]
    return out.select(*cols)
