"""Token ids in Re-Pair compressed shards.

Documents are range-partitioned by id and encoded; consecutive documents form shards. In a shard frequent pairs of
neighbouring ids are replaced by nonterminals, round after round, until no pair occurs LEAST_COUNT times; a round replaces
many pairs at once, and where chosen pairs overlap every second one of a run is taken. The shard stores its rules, the length of every
nonterminal's expansion, and where each document's symbols begin, so any document, or any stretch of one, is decoded
without the others.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_speculative import byte_alphabet, slices
from .common import as_binary, batch_limits, parts_for, scratch

MAGIC = b"RPR1"
#: Ids of a shard, rules of a round, and how often a pair must occur in the shard to become a rule: a rule takes 12 bytes
#: and an occurrence saves 4, so rules of fewer occurrences hardly pay.
SHARD_IDS = 1 << 20
ROUND_RULES = 16384
LEAST_COUNT = 16
#: Id behind every document.
END_ID = 2
#: Input bytes of a partition, and the most partitions; beyond them partitions grow, and a task's memory does not.
PART_BYTES = 6 << 20
PARTS_MOST = 100_000
#: Pieces remembered by a worker in each of two generations; when the younger is full it becomes the older.
CACHE_WORDS = 350_000


#: Marks that end a piece of letters (fixed values); the vocabulary's splitter parts them from letters too.
MARKS = b".,;:!?%$&*#|()"
#: Characters of which the first that is one id of the vocabulary parts joined pieces; pieces that hold it go alone.
PARTING = "\u26bd\u2615\u2605"
#: Pieces joined for a call.
JOINED = 100
#: Lower-case letters that the normaliser leaves alone; a word of nothing else is one piece of the splitter.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class Encoder:
    """The tokenizers library over the distinct pieces of texts.

    The vocabulary's normaliser and splitter never join what ASCII white space parts, drop the white space, part
    letters from marks, and ignore case, so a text's ids are those of its lower-cased pieces in order. Only a text that may hold a
    special token keeps its case and its marks. Words of plain letters go to the library's model itself, in the stand-in
    characters of their bytes; other pieces take the whole way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.memory: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        # a character of one id that parts joined pieces, since a call for each piece costs more than its merges
        self.part, self.part_id = next((c, ids[0]) for c in PARTING if len(ids := self.own.encode(c, add_special_tokens=False).ids) == 1)
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.letter = np.zeros(256, bool)
        self.letter[97:123] = True
        self.mark = np.zeros(256, bool)
        self.mark[list(MARKS)] = True

    def pieces(self, texts: list[bytes]) -> pa.Array:
        """The texts, lower-cased and with a space before every mark that follows a letter: white space parts the pieces."""
        lowered = [t if b"<|" in t else t.lower() for t in texts]
        data = np.frombuffer(b"\n".join(lowered), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in lowered]) - 1
        at = np.flatnonzero(self.letter[data[:-1]] & self.mark[data[1:]]) + 1
        for k in [k for k, t in enumerate(lowered) if b"<|" in t]:
            at = at[(at < ends[k] - len(lowered[k])) | (at >= ends[k])]
        out = np.full(len(data) + len(at), 32, np.uint8)
        keep = np.ones(len(out), bool)
        keep[at + np.arange(len(at))] = False
        out[keep] = data
        stops = np.r_[0, ends + np.searchsorted(at, ends)].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(stops), pa.py_buffer(out))

    def learn(self, pieces: list[bytes]) -> None:
        """Remember the ids of pieces; those that are not plain words are joined by the parting character and cut again at its id."""
        tokenize, plain, stand_in, others = self.own.model.tokenize, PLAIN.fullmatch, self.stand_in, []
        counts, flat, words = [], [], []
        for w in pieces:
            if not plain(word := w.decode()):
                others.append(w)
                continue
            got = [t.id for t in tokenize(word if len(word) == len(w) else w.decode("latin-1").translate(stand_in))]
            words.append(w)
            counts.append(len(got))
            flat += got
        raw, at = np.array(flat, "<u4").tobytes(), 0
        for w, n in zip(words, counts, strict=True):
            self.memory[w] = raw[at : at + 4 * n]
            at += 4 * n
        self.learn_joined(others)

    def learn_joined(self, pieces: list[bytes]) -> None:
        mark = self.part.encode()
        alone = [w for w in pieces if mark in w or b"<|" in w]
        for w, e in zip(alone, self.own.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False), strict=True):
            self.memory[w] = np.array(e.ids, "<u4").tobytes()
        rest = [w for w in pieces if mark not in w and b"<|" not in w] if alone else pieces
        end = b" " + mark
        joined = [(end + b" ").join(rest[a : a + JOINED]) + end for a in range(0, len(rest), JOINED)]
        got = self.own.encode_batch_fast([t.decode() for t in joined], add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in got), "<u4")
        cut = (4 * np.flatnonzero(ids == self.part_id)).tolist()
        raw, at = ids.tobytes(), 0
        for w, b in zip(rest, cut, strict=True):
            self.memory[w] = raw[at:b]
            at = b + 4

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Pieces are numbered and ids put together in Arrow; only distinct pieces are Python objects."""
        if not texts:
            return []
        pieces = pc.ascii_split_whitespace(self.pieces([t.encode() for t in texts]))
        ends = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.memory) > CACHE_WORDS:
            self.older, self.memory = self.memory, {b"": b""}
        memory, older, new = self.memory, self.older, []
        for w in words:
            if w not in memory:
                if w in older:
                    memory[w] = older[w]
                else:
                    new.append(w)
        for a in range(0, len(new), 20_000):
            self.learn(new[a : a + 20_000])
        ids = pa.array([memory[w] for w in words], pa.large_binary()).take(coded.indices)
        offsets, raw = as_binary(ids)
        at = offsets[ends].tolist()
        raw = raw.tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bins_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.int64(-7046029254386353131)) >> np.int64(64 - bits)) & np.int64((1 << bits) - 1)


def frequent_pairs(keys: np.ndarray, bins: np.ndarray, bits: int, most: int, least: int) -> np.ndarray:
    """Frequent values of `keys` (at most `most`, each at least `least` times, no two in a bin), most frequent first.

    One value stands for each bin and is counted exactly; what shares its bin waits for a later round. Only where
    no bin's own value is frequent are the others looked at, so nothing is found if and only if no value is frequent.
    """
    own = np.empty(1 << bits, np.int64)
    own[bins] = keys
    counts = np.bincount(bins[own[bins] == keys], minlength=1 << bits)
    at = np.flatnonzero(counts >= least)
    values, n = own[at], counts[at]
    if not len(values):
        values, n = np.unique(keys, return_counts=True)
        values, n = values[n >= least], n[n >= least]
    if len(values) > most:
        bound = -np.partition(-n, most - 1)[most - 1]
        values, n = values[n >= bound], n[n >= bound]
    return values[np.lexsort((values, -n))][:most]


def compress(ids: np.ndarray, ends: np.ndarray, rounds: int | None = None, rules: int = ROUND_RULES, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, ends of the documents in them, rules as pairs, first nonterminal). No rule crosses a document's end.

    Rounds go on until no pair occurs `least` times, or for `rounds` of them. A pair that is too rare stays so, for
    replacements only make pairs with new symbols; so a round looks only at places that are not known to be rare.
    """
    seq = ids.astype(np.int64)
    base = int(seq.max(initial=-1)) + 1
    pairs, top = [], base
    ends = ends.astype(np.int64)
    live = np.ones(len(seq), bool)
    while len(seq) > 1 and rounds != 0:
        rounds = None if rounds is None else rounds - 1
        live[ends[ends > 0] - 1] = False
        live[-1] = False
        at = np.flatnonzero(live)
        keys = seq[at] << 32 | seq[at + 1]
        bits = 20 if len(at) > 1 << 18 else 18
        bins = bins_of(keys, bits)
        often = np.bincount(bins, minlength=1 << bits)[bins] >= least
        live[at[~often]] = False
        at, keys, bins = at[often], keys[often], bins[often]
        chosen = frequent_pairs(keys, bins, bits, rules, least) if len(at) else keys
        if not len(chosen):
            break
        # one place per bin: a chosen pair whose bin a more frequent one has waits for the next round
        table = np.full(1 << bits, -1, np.int32)
        table[bins_of(chosen, bits)[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
        place = table[bins]
        hit = np.flatnonzero(place >= 0)
        hit = hit[chosen[place[hit]] == keys[hit]]
        at, place = at[hit], place[hit]
        # in a run of overlapping occurrences every second is taken, from the first
        head = np.r_[True, np.diff(at) != 1]
        run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        at, place = at[take], place[take]
        used = np.flatnonzero(np.bincount(place, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.int64)
        number[used] = np.arange(len(used))
        seq[at] = top + number[place]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        ends = ends - np.searchsorted(at + 1, ends)
        seq, live = seq[keep], live[keep]
        at = at - np.arange(len(at))
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        pairs.append(np.stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF], 1))
        top += len(used)
    return seq.astype("<u4"), ends, np.concatenate(pairs).astype("<u4") if pairs else np.zeros((0, 2), "<u4"), base


def lengths(pairs: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each nonterminal; a rule only uses symbols from before its round."""
    out = np.ones(len(pairs), np.int64)
    pending = np.arange(len(pairs))
    known = np.zeros(len(pairs), bool)
    p = pairs.astype(np.int64) - base
    while len(pending):
        q = p[pending]
        ready = ((q < 0) | known[np.maximum(q, 0)]).all(1)
        r, q = pending[ready], q[ready]
        out[r] = np.where(q < 0, 1, out[np.maximum(q, 0)]).sum(1)
        known[r] = True
        pending = pending[~ready]
    return out


#: Ids up to which all rules are expanded beforehand.
FLAT_IDS = 4 << 20


def flat_rules(pairs: np.ndarray, base: int, sizes: np.ndarray) -> np.ndarray | None:
    """The expansions of all rules one after the other, or None where they are longer than FLAT_IDS."""
    return _by_levels(np.arange(base, base + len(pairs)), pairs, base) if sizes.sum() <= FLAT_IDS else None


def expand(symbols: np.ndarray, pairs: np.ndarray, base: int, sizes: np.ndarray | None = None, flat: np.ndarray | None = None) -> np.ndarray:
    """Symbols to ids: with the rules' expansions at hand in one step, else one level of rules at a time."""
    if flat is None:
        return _by_levels(symbols, pairs, base)
    seq = symbols.astype(np.int64)
    big = seq >= base
    rule = seq[big] - base
    size = np.ones(len(seq), np.int64)
    size[big] = sizes[rule]
    out = np.repeat(seq, size)
    first = np.r_[0, np.cumsum(sizes, dtype=np.int64)][rule]
    length = size[big]
    out[np.repeat(big, size)] = flat[np.repeat(first - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())]
    return out.astype("<u4")


def _by_levels(symbols: np.ndarray, pairs: np.ndarray, base: int) -> np.ndarray:
    seq = symbols.astype(np.int64)
    while len(big := np.flatnonzero(seq >= base)):
        two = np.ones(len(seq), np.int64)
        two[big] = 2
        at = np.r_[0, np.cumsum(two)[:-1]]
        out = np.repeat(seq, two)
        rule = pairs[seq[big] - base].astype(np.int64)
        out[at[big]], out[at[big] + 1] = rule[:, 0], rule[:, 1]
        seq = out
    return seq.astype("<u4")


def pack(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A shard's file body: magic, counts, rules, expansion lengths, documents' symbol ends and id ends, symbols."""
    seq, cuts, pairs, base = compress(ids, ends)
    head = MAGIC + struct.pack("<qqqq", base, len(pairs), len(ends), len(seq))
    return b"".join([head, pairs.tobytes(), lengths(pairs, base).astype("<u4").tobytes(), cuts.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), seq.tobytes()])


class ShardReader:
    """Random access to a packed shard."""

    def __init__(self, body: bytes):
        if body[:4] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        self.base, n_rules, n_docs, n_symbols = struct.unpack_from("<qqqq", body, 4)
        at = 36
        self.pairs = np.frombuffer(body, "<u4", 2 * n_rules, at).reshape(-1, 2)
        self.lengths = np.frombuffer(body, "<u4", n_rules, at := at + 8 * n_rules)
        self.cuts = np.frombuffer(body, "<i8", n_docs, at := at + 4 * n_rules)
        self.ends = np.frombuffer(body, "<i8", n_docs, at := at + 8 * n_docs)
        self.symbols = np.frombuffer(body, "<u4", n_symbols, at + 8 * n_docs)
        self.flat = flat_rules(self.pairs, self.base, self.lengths)

    def __len__(self) -> int:
        return len(self.cuts)

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.pairs, self.base, self.lengths, self.flat)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start:stop of document k; only the symbols that cover them are expanded."""
        part = self.symbols[self.cuts[k - 1] if k else 0 : self.cuts[k]]
        size = np.ones(len(part), np.int64)
        big = part >= self.base
        size[big] = self.lengths[part[big] - self.base]
        ends = np.cumsum(size)
        stop = int(ends[-1]) if len(ends) and stop is None else stop or 0
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return expand(part[a:b], self.pairs, self.base, self.lengths, self.flat)[skip : skip + max(0, stop - start)]


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of all documents, in ascending order of key (nulls first, ties by their place in the input), to `folder`.

    A row of the files is a shard: part, first (ids of the part before it), keys, body. Null texts are empty. Rows repeated
    or without a key are documents of their own, and many of them are dealt over partitions by their place in the input. A very long text stands whole in a shard of its own size. An empty table gives no shards. Columns
    other than key and text are not read, whatever their names.
    """
    batch_limits(docs.sparkSession)
    src = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = min(PARTS_MOST, parts_for(src, PART_BYTES, 12))
    order = ["key", "place"]
    dealt = src.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text")
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        e = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        keys, docs_ids, held, first = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            sizes = np.array([len(x) // 4 for x in docs_ids], np.int64)
            body = pack(np.frombuffer(b"".join(docs_ids), "<u4"), np.cumsum(sizes))
            all_keys = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(all_keys)], pa.int32()), all_keys), pa.array([body], pa.binary())],
                names=["part", "first", "ids", "keys", "body"],
            )

        for batch in batches:
            for piece in slices(batch, 2 << 20):
                got = [x + end for x in e.encode_batch(piece.column(1).to_pylist())]
                keys.append(piece.column(0))
                docs_ids += got
                held += sum(map(len, got)) // 4
                if held >= SHARD_IDS:
                    yield shard()
                    first += held
                    keys, docs_ids, held = [], [], 0
        if docs_ids:
            yield shard()

    dealt.mapInArrow(run, f"part int, first bigint, ids bigint, keys array<{kind}>, body binary").write.parquet(folder)


def read(spark, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(folder)
    kind = files.schema["keys"].dataType.elementType.simpleString()
    # one number for each part, of which there are at most PARTS_MOST, so a window and a broadcast of them are bounded
    totals = files.groupBy("part").agg(F.sum("ids").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                reader = ShardReader(batch.column(3)[k].as_py())
                ids, ends = reader.all_ids(), reader.ends
                starts = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = batch.column(0)[k].as_py() + batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(2)[k].values, pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    full = files.join(F.broadcast(offsets), "part").select("base", "first", "keys", "body")
    return full.mapInArrow(run, f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document key, start, n_tokens and ids_crc32, read back from files that write() made: see there for nulls, ties,
    repeated rows, long texts, empty tables and clashing columns."""
    spark = docs.sparkSession
    folder = scratch(spark, "repair")
    write(docs, folder, tokenizer, key, text)
    return read(spark, folder, key)
