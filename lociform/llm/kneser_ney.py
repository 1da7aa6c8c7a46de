"""Interpolated modified Kneser-Ney bigram model, counted in Spark and stored as sorted hash arrays.

Words are 64-bit hashes, computed for all bytes of a batch at once. A worker counts the bigrams of a batch, packs
the distinct ones by ranges of their context's hash and ships the packs; a reducer merges the packs of a range, so
writes the range as a file of sorted keys and counts. Bigrams of hot contexts (a sample names them, which only decides where
they are counted) are ranged by the word instead. Word-level counts (occurrences, continuations, context statistics) are
sums over all ranges and take the same way by ranges of the word's hash. Scoring workers map those files, each once, and look up
the distinct keys of a batch in ascending order, which reads the files forward once.

The folder in spark.checkpoint.dir must be a path that workers can map (a local or network file system).
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_speculative import slices
from .common import as_binary, batch_limits, discard, materialize, parts_for, plan_bytes, scratch

#: Input bytes for each hash range, and the least number of ranges.
RANGE_BYTES = 4 << 20
LEAST_RANGES = 64
#: Text bytes counted at a time.
COUNT_BYTES = 8 << 20
SCORE_BYTES = 4 << 20
#: Passes over the texts while counting, and the count from which a bigram stands in the file of frequent ones.
PASSES = 2
MANY = 255
#: Text bytes hashed at a time; a longer text is cut at white space.
HASH_BYTES = 1 << 19
#: Text bytes, about, of the sample that names hot contexts, and the share of a range's tokens that makes a context hot.
SAMPLE_BYTES = 64 << 20
HOT_SHARE = 0.125

#: Files that a worker maps at a time; the one opened first is closed when it would open more.
OPEN_MOST = 16_384

_TOP = np.uint64(0xFFFF << 48)
_LOW = np.uint64((1 << 48) - 1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Hashes of the marks before the first and behind the last word of a text.
BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4A0761D65)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.cache
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for each byte (A-Z like a-z), and which bytes are white space."""
    v = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    v[65:91] = v[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return v, space


@functools.lru_cache(maxsize=1)  # grows to the longest slice met
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and its inverse, for i below n."""
    p = np.full(n, _P, np.uint64)
    p[0] = 1
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    q = np.full(n, inverse, np.uint64)
    q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document of each): the words of every text in order, then END, for all texts."""
    n_docs = len(offsets) - 1
    values, space = _byte_values()
    gap = space[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:] = np.r_[gap, True][:-1] if len(data) else True
    edge[offsets[:-1]] = True
    inside = ~gap
    start = np.flatnonzero(inside & edge[: len(data)])
    stop_mark = np.r_[gap, True]
    stop_mark[offsets] = True
    stops = np.flatnonzero(stop_mark)
    end = stops[np.searchsorted(stops, start, "right")] if len(start) else start
    p, q = _powers(max(1 << 16, 1 << int(len(data)).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(values[data] * p[: len(data)], dtype=np.uint64)]
    words = mix64((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    doc = np.searchsorted(offsets, start, "right") - 1
    # documents without bytes share an offset with the next: searchsorted gives the last of them, the one with bytes
    every = np.r_[doc, np.arange(n_docs)]
    order = np.argsort(every, kind="stable")
    return np.r_[words, np.full(n_docs, END)][order], every[order]


def cuts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, document of each piece): texts, those beyond HASH_BYTES cut at the first white space from there on."""
    long = np.flatnonzero(np.diff(offsets) > HASH_BYTES)
    if not len(long):
        return offsets, np.arange(len(offsets) - 1)
    space, more, owner = _byte_values()[1], [], []
    for k in long.tolist():
        at, end = int(offsets[k]) + HASH_BYTES, int(offsets[k + 1])
        while at < end:
            found = -1
            for s in range(at, end, HASH_BYTES):
                hit = space[data[s : min(end, s + HASH_BYTES)]]
                if hit.any():
                    found = s + int(hit.argmax())
                    break
            if found < 0:
                break
            more.append(found)
            owner.append(k)
            at = found + HASH_BYTES
    docs = np.r_[np.arange(len(offsets) - 1), np.array(owner, np.int64)]
    starts = np.r_[offsets[:-1], np.array(more, np.int64)]
    order = np.lexsort((starts, docs))
    return np.r_[starts[order], offsets[-1]], docs[order]


def all_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, contexts, document of each) of a column, hashed a slice at a time: what is needed for each byte of a
    text is only held for a slice."""
    offsets, data = as_binary(column)
    offsets, owner = cuts(offsets, data)
    group = offsets[:-1] // HASH_BYTES
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(group) else []
    words, docs = [], []
    for a, b in zip(starts, [*starts[1:], len(offsets) - 1], strict=True):
        w, d = tokens(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
        d = d + a
        # the end mark of a piece that goes on is none
        goes_on = np.r_[owner[1:] == owner[:-1], False][d] & np.r_[d[1:] != d[:-1], True]
        words.append(w[~goes_on])
        docs.append(owner[d[~goes_on]])
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words, docs = np.concatenate(words), np.concatenate(docs)
    return words, contexts(words, docs), docs


def contexts(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    before = np.r_[BEGIN, words[:-1]] if len(words) else words
    before[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])] = BEGIN
    return before


def bigram_keys(context: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The upper 16 bits are the context's, or the word's under a hot context (hot: ascending), so a range is a key range."""
    top = context
    if len(hot):
        at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
        top = np.where(hot[at] == context, mix64(word ^ context), context)
    return (top & _TOP) | (mix64(context * np.uint64(3) + word) & _LOW)


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Equal ranges of the upper 16 bits."""
    return ((h >> np.uint64(48)).astype(np.int64) * ranges) >> 16


def _put(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each byte plane apart, lightly deflated: sorted hashes shrink in their upper planes."""
    out = []
    for a in arrays:
        plane = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        plane = zlib.compress(plane, 1)
        out.append(len(plane).to_bytes(4, "little") + len(a).to_bytes(4, "little") + plane)
    return b"".join(out)


def _take(blob: bytes, kinds: list) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size, n = int.from_bytes(blob[at : at + 4], "little"), int.from_bytes(blob[at + 4 : at + 8], "little")
        raw = np.frombuffer(zlib.decompress(blob[at + 8 : at + 8 + size]), np.uint8)
        kind = np.dtype(kind)
        out.append(raw.reshape(kind.itemsize, n).T.copy().view(kind).ravel() if n else np.zeros(0, kind))
        at += 8 + size
    return out


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of each value."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return (k[first], *(np.add.reduceat(v[order].astype(np.int64), first) if len(k) else np.zeros(0, np.int64) for v in values))


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to about `size` bytes of text and cut at it."""
    held, n = [], 0
    for batch in batches:
        for part in slices(batch, size):
            held.append(part)
            n += part.nbytes
            if n >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield t.to_batches()[0]


_WORDS = ["<u8", "<u4", "<u4", "<u8", "<u4", "<u4", "<u4"]  # word, count, continuations, context total, bigram types seen once, twice, more


def _hot(texts: DataFrame, ranges: int) -> np.ndarray:
    """Contexts, ascending, with at least HOT_SHARE of a range's tokens in a sample: at most ranges / HOT_SHARE of them.

    They only decide where bigrams are counted, so the sample changes no result.
    """
    share = min(1.0, SAMPLE_BYTES / max(1, plan_bytes(texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, COUNT_BYTES):
            _, before, _ = all_tokens(batch.column(0))
            u, n = np.unique(before, return_counts=True)
            # a context that is hot overall has its share in some piece
            u, n = (x[n >= HOT_SHARE * len(before) / ranges] for x in (u, n))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n, pa.int64()), pa.array(np.r_[len(before), np.zeros(len(u) - 1, np.int64)] if len(u) else [], pa.int64())], names=["u", "n", "tokens"])

    sample = texts.sample(False, share, 42) if share < 1 else texts
    found = materialize(sample.mapInArrow(run, "u bigint, n bigint, tokens bigint"), "kneser-ney-hot")
    total = found.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rows = found.groupBy("u").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_SHARE * total / ranges).select("u").collect()
    discard(found)
    return np.sort(np.unique(np.r_[np.array([r.u for r in rows], np.int64).view(np.uint64), BEGIN]))


def _count(ranges: int, passes: int, turn: int, hot: np.ndarray):
    """Training texts to packs of distinct bigrams by context range, for the ranges of this pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, COUNT_BYTES):
            words, before, _ = all_tokens(batch.column(0))
            key = bigram_keys(before, words, hot)
            mine = range_of(key, ranges) % passes == turn
            words, before, key = words[mine], before[mine], key[mine]
            order = np.argsort(key, kind="stable")
            k = key[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(k)]).astype(np.uint32)
            u, w = before[order[first]], words[order[first]]
            where, blobs = [], []
            bounds = np.searchsorted(range_of(k[first], ranges), np.arange(ranges + 1))
            for r in range(turn, ranges, passes):
                a, b = bounds[r], bounds[r + 1]
                if a < b:
                    # contexts are few beside bigrams: they are kept once with their number of bigrams
                    by = np.argsort(u[a:b], kind="stable")
                    uu, ww, cc = u[a:b][by], w[a:b][by], count[a:b][by]
                    head = np.flatnonzero(np.r_[True, uu[1:] != uu[:-1]])
                    where.append(r)
                    blobs.append(_put(uu[head], np.diff(np.r_[head, len(uu)]).astype("<u4"), ww, cc))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "pack"])

    return run


def _store(path: str, *arrays: np.ndarray) -> None:
    """Write arrays one after the other under a name that only a finished file gets."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    os.replace(part, path)


def _reduce_bigrams(folder: str, ranges: int, hot: np.ndarray):
    """Packs of one context range to its file; gives word packs (context statistics, continuations) and counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        r = table["range"][0].as_py()
        us, ws, cs = [], [], []
        for blob in table["pack"].to_pylist():
            u, n, w, c = _take(blob, ["<u8", "<u4", "<u8", "<u4"])
            us.append(np.repeat(u, n))
            ws.append(w)
            cs.append(c)
        u, w, c = map(np.concatenate, (us, ws, cs))
        del us, ws, cs
        key = bigram_keys(u, w, hot)
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        total = np.add.reduceat(c[order].astype(np.int64), first)
        u, w = u[order[first]], w[order[first]]
        many = total >= MANY
        _store(f"{folder}/bigram-{r:06d}", k[first].astype("<u8"), np.minimum(total, MANY).astype("u1"))
        _store(f"{folder}/often-{r:06d}", k[first][many].astype("<u8"), total[many].astype("<u4"))
        cu, ct, c1, c2, c3 = _sum_by(u, total, total == 1, total == 2, total > 2)
        cw, cn, cc = _sum_by(w, np.ones(len(w), np.int64), total)
        words, values = [np.r_[cu, cw]], []
        zu, zw = np.zeros(len(cu), np.int64), np.zeros(len(cw), np.int64)
        for a, b in ((zu, cc), (zu, cn), (ct, zw), (c1, zw), (c2, zw), (c3, zw)):
            values.append(np.r_[a, b])
        packed = _sum_by(words[0], *values)
        bounds = np.searchsorted(range_of(packed[0], ranges), np.arange(ranges + 1))
        where, blobs = [], []
        for q in range(ranges):
            a, b = bounds[q], bounds[q + 1]
            if a < b:
                where.append(q)
                blobs.append(_put(*(x[a:b].astype(t) for x, t in zip(packed, _WORDS, strict=True))))
        times = [int((total == k).sum()) for k in (1, 2, 3, 4)]
        stats = np.array(times + [len(total)], "<i8").tobytes()
        return pa.table({"kind": pa.array([1] * len(where) + [2], pa.int32()), "range": pa.array(where + [r], pa.int32()), "pack": pa.array(blobs + [stats], pa.binary())})

    return run


def _reduce_words(folder: str):
    """Word packs of one range to its file; gives the sums that the model's constants need."""

    def run(table: pa.Table) -> pa.Table:
        r = table["range"][0].as_py()
        cols = [_take(blob, _WORDS) for blob in table["pack"].to_pylist()]
        merged = _sum_by(*(np.concatenate([c[k] for c in cols]) for k in range(len(_WORDS))))
        _store(f"{folder}/words-{r:06d}", *(x.astype(t) for x, t in zip(merged, _WORDS, strict=True)))
        _, count, cont, *_ = merged
        # BEGIN is a context and no word; it has no occurrences
        sums = [int(count.sum()), int((count > 0).sum()), int(cont.sum()), *(int((cont == k).sum()) for k in (1, 2, 3, 4)), int((cont > 2).sum())]
        return pa.table({"range": pa.array([r], pa.int32()), "sums": pa.array([sums], pa.list_(pa.int64()))})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more; plain values where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def plain_path(uri: str) -> str:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return uri
    raise ValueError(f"the model is memory-mapped and needs a mountable folder in spark.checkpoint.dir, not {uri}")


@dataclass
class Model:
    folder: str
    ranges: int
    tokens: int  # N: training tokens, ends included
    words: int  # V: distinct training tokens
    types: int  # distinct bigrams
    bigram: tuple[float, float, float]
    unigram: tuple[float, float, float]
    types_by: tuple[int, int, int]  # words with one, two, more continuations
    hot: np.ndarray  # contexts whose bigrams are ranged by the word
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _file(self, kind: str, r: int, kinds: list[str]) -> list[np.ndarray] | None:
        if (kind, r) not in self._open:
            path = f"{self.folder}/{kind}-{r:06d}"
            if not os.path.exists(path) or not (size := os.path.getsize(path)):
                self._open[kind, r] = None
            else:
                n = size // sum(np.dtype(k).itemsize for k in kinds)
                # one mapping a file, whatever its arrays, and only as many files open as OPEN_MOST
                whole, at, out = np.memmap(path, np.uint8, "r"), 0, []
                for k in kinds:
                    out.append(whole[at : at + n * np.dtype(k).itemsize].view(k))
                    at += n * np.dtype(k).itemsize
                while len(self._open) >= OPEN_MOST:
                    self._open.pop(next(iter(self._open)))
                self._open[kind, r] = out
        return self._open[kind, r]

    def _find(self, kind: str, kinds: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Values of ascending distinct keys, 0 where a key is not stored."""
        out = [np.zeros(len(keys), np.int64) for _ in kinds[1:]]
        bounds = np.searchsorted(range_of(keys, self.ranges), np.arange(self.ranges + 1))
        for r in range(self.ranges):
            a, b = bounds[r], bounds[r + 1]
            if a == b or (f := self._file(kind, r, kinds)) is None:
                continue
            at = np.minimum(np.searchsorted(f[0], keys[a:b]), len(f[0]) - 1)
            hit = f[0][at] == keys[a:b]
            for o, column in zip(out, f[1:], strict=True):
                o[a:b] = np.where(hit, column[at], 0)
        return out

    def score(self, words: np.ndarray, before: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per document: tokens, known tokens, add-0.1 unigram score, model score (both log10)."""
        v, back = np.unique(np.r_[words, before], return_inverse=True)
        count, cont, ctx, c1, c2, c3 = self._find("words", _WORDS, v)
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        # lowest level: continuation counts, discounted, over words and one unknown word
        d, (e1, e2, e3) = np.array([0.0, *self.unigram]), self.types_by
        types = max(1, self.types)
        spare = (d[1] * e1 + d[2] * e2 + d[3] * e3) / types if self.types else 1.0
        low = np.maximum(cont - d[np.minimum(cont, 3)], 0) / types + spare / (self.words + 1)
        keys, kback = np.unique(bigram_keys(before, words, self.hot), return_inverse=True)
        (pair,) = self._find("bigram", ["<u8", "u1"], keys)
        if len(many := np.flatnonzero(pair == MANY)):
            (pair[many],) = self._find("often", ["<u8", "<u4"], keys[many])
        t, u = back[: len(words)], back[len(words) :]
        d = np.array([0.0, *self.bigram])
        total = np.maximum(ctx, 1)
        gamma = np.where(ctx > 0, (d[1] * c1 + d[2] * c2 + d[3] * c3) / total, 1.0)
        c = pair[kback]
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / total[u] + gamma[u] * low[t]
        by = lambda x: np.bincount(doc, x, n_docs)
        return np.bincount(doc, minlength=n_docs), by(count[t] > 0).astype(np.int64), by(base[t]), by(np.log10(p))


def fit(texts: DataFrame, text: str = "text") -> Model:
    """Count the texts (null: empty) and store the model.

    Texts repeated in the table are counted as often; a very long text is hashed in pieces; an empty table gives a model that
    scores every word alike. Counts of equal keys are sums, so ties decide nothing. Columns other than text are not read,
    whatever their names. The order is 2: see the README for the figures of trigrams.
    """
    spark: SparkSession = texts.sparkSession
    batch_limits(spark)
    folder = scratch(spark, "kneser-ney")
    local = plain_path(folder)
    os.makedirs(local, exist_ok=True)
    src = texts.select(F.col(f"`{text}`").alias("text"))
    ranges = min(1 << 16, parts_for(src, RANGE_BYTES, LEAST_RANGES))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    packs = "kind int, range int, pack binary"
    hot = _hot(src, ranges)
    try:
        # every pass reads the texts again and ships its share of the ranges, so that less is on the way at a time
        for turn in range(PASSES):
            sent = src.mapInArrow(_count(ranges, PASSES, turn, hot), "range int, pack binary")
            sent.groupBy("range").applyInArrow(_reduce_bigrams(local, ranges, hot), packs).write.parquet(f"{folder}/contexts/{turn}")
        second = spark.read.schema(packs).parquet(*[f"{folder}/contexts/{t}" for t in range(PASSES)])
        stats = second.where("kind = 2").select("pack").collect()  # five numbers a range
        sums = second.where("kind = 1").groupBy("range").applyInArrow(_reduce_words(local), "range int, sums array<bigint>").collect()
    finally:
        spark.conf.set(key, before)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/contexts")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    counts = np.array([np.frombuffer(bytes(r.pack), "<i8") for r in stats]).reshape(-1, 5).sum(0).tolist()
    s = np.array([r.sums for r in sums], np.int64).reshape(-1, 8).sum(0).tolist()
    return Model(local, ranges, s[0], s[1], counts[4], discounts(*counts[:4]), discounts(*s[3:7]), (s[3], s[4], s[7]), hot)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns, n_tokens, n_known, base_score and score, one row per input row. A null text is its end mark. Kept columns must not be
    named like the result's; others are not read."""
    batch_limits(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, SCORE_BYTES):
            n, known, base, own = model.score(*all_tokens(batch.column(batch.num_columns - 1)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(known), pa.array(base), pa.array(own)], names=[*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])

    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["n_tokens bigint, n_known bigint, base_score double, score double"])
    return src.mapInArrow(run, types)
