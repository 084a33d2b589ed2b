"""Benchmark decontamination by a prefix-filtered set join (operator 4).

A benchmark item is the set of its word `SHINGLE`-grams.  A document leaks an item if some window of it, as many
shingles wide as the item, contains at least ``CONTAINMENT`` of the item's distinct shingles.

1. One pass over all texts keeps the places of shingles that any item has (the item shingles, sorted, go to the
   executors if there are at most ``SMALL`` of them; otherwise the places are joined to them).
2. Shingles are ordered by rarity, that is by how often the documents hold them.  A window that contains ``need`` of an
   item's n shingles must hold one of its n - need + 1 rarest: only those are joined to find (document, item) candidates.
3. Length bound: a document with fewer than ``need`` distinct shared places is out.  Positional bound: a window starts at
   most ``width - 1`` places before its last hit, so only windows that begin at a hit are looked at.
4. Windows are verified exactly, by counting the item's distinct shingles in them.

Defined cases: null or too short texts (fewer words than a shingle) of either table match nothing; items shorter than a
shingle are left out; items with equal texts are each reported; rows that share a doc_id are judged apart and give one
row per (doc_id, item_id), the best, of windows that tie the one that begins first; repeated rows count once; `contaminated`
has no row for null ids, while `clean` judges texts, so a row that leaks goes whatever its doc_id, and one that doesn't
stays; texts of any length are read whole; empty tables give an empty result; only the id and text are read, so extra
columns, whatever their names, don't matter, and `clean` keeps them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modelgauge.llm import textcore as tc
from modelgauge.shipping import ship

SHINGLE, CONTAINMENT, SMALL = 3, 0.6, 1 << 22


def _shingles(known: np.ndarray | None, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tc.slices(batches):
            w = tc.Words(texts)
            g = tc.rolling(w.hash, n)
            ok = tc.grams_within(w.first, n, len(w.hash))
            if known is not None and len(g):
                slot = np.minimum(np.searchsorted(known, g), len(known) - 1)
                ok &= known[slot] == g
            at = np.flatnonzero(ok)
            doc = np.searchsorted(w.first, at, side="right") - 1
            row = part.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(row[doc]), pa.array(g[at].view(np.int64)), pa.array(at - w.first[doc])], names=["id", "row", "shingle", "at"])

    return run


def shingles(df: DataFrame, key: str, n: int = SHINGLE, known: np.ndarray | None = None) -> DataFrame:
    """(id, row, shingle, at): the place of each shingle in each text; `row` tells apart rows that share an id."""
    ship(df.sparkSession)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(_shingles(known, n), "id bigint, row bigint, shingle bigint, at bigint")


def _best_window(share: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Hits of one candidate (a document row and an item), in order of place."""
        frame = frame.sort_values("at", kind="stable")
        at, sh = frame["at"].to_numpy(), frame["shingle"].to_numpy()
        n, width = int(frame["n"].iloc[0]), int(frame["width"].iloc[0])
        best, where, begin, seen = 0, 0, 0, {}
        for e in range(len(at)):
            seen[sh[e]] = seen.get(sh[e], 0) + 1
            while at[e] - at[begin] >= width:
                seen[sh[begin]] -= 1
                if not seen[sh[begin]]:
                    del seen[sh[begin]]
                begin += 1
            if len(seen) > best:
                best, where = len(seen), int(at[begin])
        if best < math.ceil(share * n - 1e-9):
            return pd.DataFrame({"doc_id": [], "item_id": [], "containment": [], "at_word": []})
        return pd.DataFrame({"doc_id": [frame["id"].iloc[0]], "item_id": [frame["item_id"].iloc[0]], "containment": [best / n], "at_word": [where]})

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT, n: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """(doc_id, item_id, containment, at_word) of each leaked item; at_word is where its best window begins."""
    items = tc.checkpointed(shingles(benchmark, "item_id", n))
    sets = items.groupBy("id", "row").agg(F.countDistinct("shingle").alias("n"), F.count(F.lit(1)).alias("width"))
    sizes = sets.withColumn("need", F.ceil(F.col("n") * share - 1e-9).cast("int"))
    keys = items.select("shingle").distinct()
    known = None
    if (many := keys.count()) == 0:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, containment double, at_word bigint")
    if many <= small:
        known = np.sort(keys.toArrow().column("shingle").to_numpy().view(np.uint64))
    places = shingles(docs, "doc_id", n, known)
    if known is None:
        places = places.join(keys, "shingle", "left_semi")
    places = tc.checkpointed(places)
    rarity = keys.join(places.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "shingle", "left").fillna(0, ["df"])
    own = items.select("id", "row", "shingle").distinct().join(sizes, ["id", "row"]).join(rarity, "shingle")
    own = own.withColumn("rank", F.row_number().over(W.partitionBy("id", "row").orderBy("df", "shingle")))
    own = own.select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "shingle", "n", "width", "need", (F.col("rank") <= F.col("n") - F.col("need") + 1).alias("prefix"))
    cand = places.select("id", "row", "shingle").distinct().join(own.where("prefix"), "shingle").select("id", "row", "item_id", "item_row").distinct()
    hits = cand.join(places, ["id", "row"]).join(own.drop("prefix"), ["item_id", "item_row", "shingle"])
    enough = hits.groupBy("id", "row", "item_id", "item_row").agg(F.countDistinct("shingle").alias("k"), F.max("need").alias("least")).where("k >= least").select("id", "row", "item_id", "item_row")
    found = hits.join(enough, ["id", "row", "item_id", "item_row"], "left_semi").groupBy("id", "row", "item_id", "item_row").applyInPandas(_best_window(share), "doc_id bigint, item_id bigint, containment double, at_word bigint")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", (-F.col("at_word")).alias("m"))).alias("b")).select("doc_id", "item_id", F.col("b.containment").alias("containment"), (-F.col("b.m")).alias("at_word"))


def clean(docs: DataFrame, benchmark: DataFrame, small: int = 1 << 20) -> DataFrame:
    """docs without the rows whose text leaks any item."""
    key = f"text_{uuid.uuid4().hex}"
    hashed = docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), "text")
    gone = tc.checkpointed(contaminated(hashed, benchmark).select(F.col("doc_id").alias(key)).distinct())
    side = F.broadcast(gone) if gone.count() <= small else gone
    return docs.join(side, F.xxhash64(docs["text"].cast("string")) == F.col(key), "left_anti")
