"""Sequence composition (id, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Letters looked at together.
CHUNK = 1 << 22


class _Longest:
    """The longest run of true values over chunks that follow each other."""

    def __init__(self):
        self.best = self.open = 0

    def add(self, flags: np.ndarray) -> None:
        breaks = np.flatnonzero(~flags)
        if not len(breaks):
            self.open += len(flags)
        else:
            self.best = max(self.best, self.open + int(breaks[0]), int(np.diff(breaks).max(initial=1)) - 1)
            self.open = len(flags) - 1 - int(breaks[-1])
        self.best = max(self.best, self.open)


def _describe(seq: bytes) -> tuple[int, ...]:
    """Length, counts of A, C, G, T, N, longest run of one base, longest repeat of two bases."""
    counts, same, alternate = np.zeros(256, np.int64), _Longest(), _Longest()
    for at in range(0, len(seq), CHUNK):
        s = np.frombuffer(seq, np.uint8, min(CHUNK + 2, len(seq) - at), at)
        counts += np.bincount(s[:CHUNK], minlength=256)
        base = _BASE[s]
        same.add(((s[1:] == s[:-1]) & base[1:])[:CHUNK])
        alternate.add(((s[2:] == s[:-2]) & (s[1:-1] != s[:-2]) & base[:-2] & base[1:-1])[:CHUNK])
    n = [int(counts[ord(b)]) for b in "ACGTN"]
    pairs = (alternate.best + 2) // 2 * 2
    return (len(seq), *n, same.best + 1 if sum(n[:4]) else 0, pairs if pairs >= 4 else 0)


_BASE = np.zeros(256, bool)
_BASE[[ord(b) for b in "ACGT"]] = True


def composition(seqs: DataFrame) -> DataFrame:
    """Length, base counts, GC share of the unambiguous bases, longest homopolymer and longest dinucleotide repeat, in one pass
    over each sequence."""
    names = ["length", *[f"n_{b}" for b in "ACGTN"], "longest_homopolymer", "longest_dinucleotide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if t is None else _describe(t.upper().encode()) for t in batch.column(1).to_pylist()]
            cols = [pa.array([None if r is None else r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *names])

    kind = seqs.schema["id"].dataType.simpleString()
    out = seqs.select("id", "seq").mapInArrow(run, ", ".join([f"id {kind}", *[f"{n} bigint" for n in names]]))
    return out.withColumn("gc", F.try_divide(F.col("n_G") + F.col("n_C"), F.col("length") - F.col("n_N")))


def motif_positions(seqs: DataFrame, motif: str) -> DataFrame:
    """0-based starts of a fixed motif, overlapping ones included."""
    at = F.filter(F.sequence(F.lit(0), F.length("seq") - len(motif)), lambda k: F.substring("seq", k + 1, len(motif)) == motif)
    return seqs.where(F.length("seq") >= len(motif)).select("id", F.explode(at).alias("position"))


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    x = seqs.where(F.length("seq") >= k).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substring("seq", i, F.lit(k)))).alias("kmer"))
    return x.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
