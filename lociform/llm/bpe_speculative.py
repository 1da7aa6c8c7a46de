"""Byte-level BPE by speculation: greedy longest match proposes, adjacent pairs verify, failures are merged exactly.

A token sequence is the BPE encoding of its bytes exactly if every adjacent pair of it encodes to itself, given
tokens that encode to themselves. So a proposal is accepted when all its pairs are compatible, which is looked up for all
words of a batch at once; a pair seen for the first time is decided by exact merging of its two tokens.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_limits

#: The public pattern by which byte-level vocabularies of this kind split a text (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by a worker in each of two generations; when the younger is full it becomes the older.
CACHE_WORDS = 300_000
#: A word longer than this is merged with a heap and is not remembered.
LONG_WORD = 256


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte value: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Codec:
    """Vocabulary, exact merging, the pair table and the word memory of one worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = raw(a), raw(b)
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.split = regex.compile(SPLIT)
        self.single = [self.ids[bytes([b])] for b in range(256)]
        # only tokens that encode to themselves may be proposed
        self.stable = {b: i for b, i in self.ids.items() if len(b) == 1 or self.merge(b) == [i]}
        self.longest = max(map(len, self.stable))
        # prefixes that no longer token continues let the longest match stop early
        self.prefixes = {b[:k] for b in self.stable for k in range(1, len(b) + 1)}
        self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.fresh: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.counts = {"proposed": 0, "failed": 0}

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: join the pair of lowest rank, leftmost first, until none is left."""
        parts = [self.single[b] for b in word]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        get = self.merges.get
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = get((parts[k], parts[k + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, k
            if best is None:
                break
            parts[at : at + 2] = [best[1]]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list, for very long words."""
        import heapq

        n = len(parts)
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            j = nxt[k]
            if j < n and (found := self.merges.get((parts[k], parts[j]))):
                heapq.heappush(heap, (found[0], k, parts[k], parts[j]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            if not alive[k] or parts[k] != a or (j := nxt[k]) >= n or parts[j] != b:
                continue
            parts[k] = self.merges[(a, b)][1]
            alive[j] = False
            nxt[k] = nxt[j]
            if nxt[k] < n:
                prev[nxt[k]] = k
            if prev[k] >= 0:
                offer(prev[k])
            offer(k)
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, n = [], 0, len(word)
        stable, prefixes = self.stable, self.prefixes
        while at < n:
            end, found, stop = at + 1, stable[word[at : at + 1]], at + 1
            while end < n:
                end += 1
                piece = word[at:end]
                if piece not in prefixes:
                    break
                token = stable.get(piece)
                if token is not None:
                    found, stop = token, end
            out.append(found)
            at = stop
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens encodes to itself."""
        keys = left.astype(np.int64) << 32 | right
        uniq, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, uniq)
        at[at == len(self.pair_keys)] = 0
        known = self.pair_keys[at] == uniq if len(self.pair_keys) else np.zeros(len(uniq), bool)
        good = np.zeros(len(uniq), bool)
        good[known] = self.pair_good[at[known]]
        if not known.all():
            new = uniq[~known]
            made = np.array([self.merge(self.bytes[k >> 32] + self.bytes[k & 0xFFFFFFFF]) == [k >> 32, k & 0xFFFFFFFF] for k in new.tolist()], bool)
            good[~known] = made
            keys_all = np.concatenate([self.pair_keys, new])
            order = np.argsort(keys_all, kind="stable")
            self.pair_keys, self.pair_good = keys_all[order], np.concatenate([self.pair_good, made])[order]
            if len(self.pair_keys) > 4_000_000:
                self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
        return good[back]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Encode words: propose for all, test all adjacent pairs at once, merge exactly where a pair fails."""
        raws = [w.encode() for w in words]
        tokens = [self.propose(w) for w in raws]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for x in tokens for t in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
        left = np.flatnonzero(inner)
        failed = np.zeros(len(words), bool)
        if len(left):
            bad = ~self.compatible(flat[left], flat[left + 1])
            failed[owner[left[bad]]] = True
        self.counts["proposed"] += len(words)
        self.counts["failed"] += int(failed.sum())
        for k in np.flatnonzero(failed).tolist():
            tokens[k] = self.merge(raws[k])
        return {w: np.array(t, "<u4").tobytes() for w, t in zip(words, tokens, strict=True)}

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text in order; a special token stands as its id."""
        if not self.special or "<" not in text or not (found := list(self.special_at.finditer(text))):
            return self.split.findall(text)
        out: list[str | int] = []
        at = 0
        for m in found:
            out += self.split.findall(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.split.findall(text[at:])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        words: set = set()
        for x in split:
            words.update(x)
        if len(self.memory) > CACHE_WORDS:
            self.older, self.memory = self.memory, {}
        new = []
        for w in words:
            if w not in self.memory:
                if w in self.older:
                    self.memory[w] = self.older[w]
                else:
                    new.append(w)
        got = self.learn([w for w in new if isinstance(w, str)])
        got |= {w: np.array([w], "<u4").tobytes() for w in new if not isinstance(w, str)}
        self.memory.update(got)
        out = [b"".join(map(self.memory.__getitem__, x)) for x in split]
        for w in new:
            if isinstance(w, str) and len(w) > LONG_WORD:
                self.memory.pop(w, None)
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids binary) of every whole text, one row per input row.

    A null or empty text has no ids. Texts are cut into slices of a batch so that memory follows the slice, not
    the number of documents.
    """
    batch_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch):
                ids = c.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=[key, "ids"])

    src = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"))
    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, ids binary")


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document the number of ids, their digest, and that of the text decoded from them, one row per input row.

    A null or empty text has no ids; repeated rows and keys are rows of their own; a very long word is merged with a heap and
    not remembered. An empty table gives no rows. Columns other than key and text are not read, whatever their names; the
    result's own columns are the key, n_tokens, ids_sha256 and decoded_sha256, so the key must not be named like the others.
    """
    batch_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch):
                ids = c.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    src = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"))
    kind = src.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose last column holds about `most` bytes."""
    n = batch.num_rows
    if not n:
        return
    sizes = _lengths(batch.column(batch.num_columns - 1))
    group = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() + [n]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield batch.slice(a, b - a)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
