"""Vector best-fit packing (operator 10).

A bin has three capacities: tokens, number of pieces, and attention cost (the sum of the squares of its pieces' tokens).
A document longer than the longest piece that satisfies all of them is cut into such pieces and a rest.  Items are taken
by falling weighted size.  Of the open bins that hold an item under every constraint, `rule` "norm" takes the one whose
residual vector is left shortest (weighted), "dot" the one whose residual has the largest weighted dot product with the
item; ties go to the older bin; without such a bin a new one is opened.  A dimension's weight is its share of the demand.

Documents are dealt by hash to shards of about ``SHARD`` pieces, packed independently, so work and memory of a task do
not depend on the size of the corpus; each shard wastes at most the rest of its last bins.

Defined cases: a null or tokenless text has no pieces and no row; a null doc_id is packed like others; rows that share a
doc_id are packed as separate items; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm import textcore as tc

TOKENS, PIECES, ATTENTION, SHARD = 8192, 64, 8192 * 8192 // 2, 4096
LONGEST = min(TOKENS, math.isqrt(ATTENTION))


def pieces(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens); a token is a run of letters and digits or one other visible character."""
    n = tc.ids_texts(docs).select("doc_id", F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")).cast("bigint").alias("n")).where("n > 0")
    cut = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {longest}"))).alias("piece"))
    return cut.select("doc_id", "piece", (F.col("piece") * longest).alias("start_token"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).alias("n_tokens"))


def pack(n: np.ndarray, rule: str = "norm", capacity: tuple[int, int, int] = (TOKENS, PIECES, ATTENTION)) -> np.ndarray:
    """The bin of each item of n tokens, items in the order given."""
    cap = np.array(capacity, dtype=np.float64)
    items = np.stack([n, np.ones(len(n)), n.astype(np.float64) ** 2], axis=1) / cap
    weight = items.sum(0) / max(items.sum(), 1e-300)
    rest = np.empty((64, 3))
    home, used = np.empty(len(n), dtype=np.int64), 0
    live = np.empty(0, dtype=np.int64)  # bins that can still take something
    least = items.min(0) if len(n) else cap
    for k in np.argsort(-(items * weight).sum(1), kind="stable"):
        item = items[k]
        left = rest[live] - item
        fit = (left >= -1e-12).all(1)
        if fit.any():
            value = (weight * left * left).sum(1) if rule == "norm" else -(weight * (left + item) * item).sum(1)
            b = live[int(np.argmin(np.where(fit, value, np.inf)))]
        else:
            if used == len(rest):
                rest = np.concatenate([rest, np.empty_like(rest)])
            b, used = used, used + 1
            rest[b] = 1
            live = np.append(live, b)
        rest[b] -= item
        home[k] = b
        if (rest[b] < least - 1e-12).any():
            live = live[live != b]
    return home


def _shard(rule: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        frame["bin_id"] = frame["shard"].astype("int64") * (1 << 24) + pack(frame["n_tokens"].to_numpy(np.int64), rule)
        return frame[["doc_id", "piece", "start_token", "n_tokens", "bin_id"]]

    return run


def packed(docs: DataFrame, rule: str = "norm", shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, bin_id) of every piece."""
    parts = tc.checkpointed(pieces(docs))
    shards = max(1, math.ceil(parts.count() / shard))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).cast("int"))
    return parts.groupBy("shard").applyInPandas(_shard(rule), "doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, bin_id bigint")
