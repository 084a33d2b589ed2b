"""Vectorised text primitives that the operators of this subpackage share.

Everything works on slices of about ``SLICE`` bytes, so memory stays flat however long an Arrow batch is; one document
longer than that makes a slice of its own.  All hashes are 64-bit and depend on content only, never on the process.
"""

from __future__ import annotations

import functools
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.shipping import ship

SLICE = 1 << 19
_BASE, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_WORD = np.array([(b >= 128) or chr(b).isalnum() for b in range(256)], dtype=bool)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INV):
        p = np.full(n + 1, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse, up to at least n; sizes are rounded so that few tables exist."""
    return _powers(max(1 << 16, 1 << int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values (one for each start)."""
    m = len(values) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    p, inv = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inv[:m])


class Words:
    """The words of several texts: hashes, byte positions, and `first`, where each text's words begin (one entry more)."""

    def __init__(self, texts: list[str]):
        enc = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b" ".join(enc) + b" ", dtype=np.uint8)
        self.at = np.zeros(len(enc) + 1, dtype=np.int64)
        np.cumsum([len(e) + 1 for e in enc], out=self.at[1:])
        inside = np.zeros(len(buf) + 1, dtype=np.int8)
        inside[1:] = _WORD[buf]
        edge = np.diff(inside)
        self.start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.end = end
        p, inv = powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=total[1:])
        self.hash = mix((total[end] - total[self.start]) * inv[self.start])
        self.first = np.searchsorted(self.start, self.at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams_within(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the runs of n words that start at 0 .. total - n lie within one text."""
    ok = np.zeros(max(0, total - n + 1), dtype=bool)
    if len(ok):
        mark = np.zeros(total + 1, dtype=np.int32)
        sizes = np.diff(first)
        good = sizes >= n
        np.add.at(mark, first[:-1][good], 1)
        np.add.at(mark, first[1:][good] - n + 1, -1)
        ok = np.cumsum(mark)[: total - n + 1] > 0
    return ok


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts Arrow batches into runs of rows of about `size` characters; null texts become empty ones."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        begin, held, texts = 0, 0, []
        for i, t in enumerate(col.to_pylist() if len(col) < 64 else (x.as_py() for x in col)):
            t = t or ""
            texts.append(t)
            held += len(t) + 1
            if held >= size:
                yield batch.slice(begin, i + 1 - begin), texts
                begin, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(begin), texts


def ids_texts(df: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, take no part."""
    ship(df.sparkSession)
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the reliable checkpoint folder, so that a lost executor costs nothing that came before."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "modelgauge-checkpoints"))
    return df.checkpoint()


def bloom_words(hashes: DataFrame, column: str, log2_bits: int = 27) -> np.ndarray:
    """A Bloom filter of fixed size (2^log2_bits bits, 16 MB) with two probes, as an array of 64-bit words.

    The words are or-ed on the executors; at most 2^(log2_bits - 6) rows reach the driver however large the input is.
    A fuller filter only lets more through: every user of it verifies what passes.
    """
    h = F.col(column)
    bit = F.explode(F.array(h.bitwiseAND(F.lit((1 << log2_bits) - 1)), F.shiftrightunsigned(h, 64 - log2_bits)))
    words = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
    out = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
    got = words.toArrow()
    if got.num_rows:
        out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return out


def bloom_has(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    log2_bits = int(len(words)).bit_length() - 1 + 6
    out = np.ones(len(hashes), dtype=bool)
    for bit in (hashes & np.uint64((1 << log2_bits) - 1), hashes >> np.uint64(64 - log2_bits)):
        out &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Distributed union-find: (node, root), root the least node of the component, for all nodes of any edge.

    Alternates large-star and small-star; each round is written to the checkpoint folder and the loop ends when a round
    changes nothing, which takes O(log n) rounds in practice.
    """
    e = checkpointed(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct())
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        e = checkpointed(small.where("u < v").distinct())
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last == row:
            break
        last = row
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
