"""SimHash near-duplicates by an LSH forest (operator 7).

A document's 256-bit signature is the sign of the sum of its distinct words' and word pairs' hashes.  The forest is ``TRIES``
tries, each over its own random order of the bits, whatever the size of the corpus.

1. Density: how many signatures each node of each trie holds, down to ``DEEP`` levels, is counted once.  This table is of
   fixed size (`TRIES` x 2^(DEEP + 1) counts), so it is given to all tasks.
2. Depth adapts to it: in each trie a signature goes down for as long as its node holds more than ``NODE`` others, so a crowded
   place is cut finely and a lonely one hardly at all.
3. Climbing: from the depths of all tries follows how likely a pair at ``DISTANCE`` bits shares a node of some trie.  While
   that is under ``RECALL`` for a signature, the tries where it sits deepest let it climb one level, all at once.
4. Search: each signature is compared on all 256 bits with all others of its nodes.  A node's rows go packed to one task; a
   node of more than ``HOT`` rows goes in pairs of blocks to several.  Pairs within ``DISTANCE`` are candidates: first one link
   for each signature of a node, then, only between signatures that these left in different components, all others.
5. Verification: a candidate is a match if the exact Jaccard similarity of its texts' sets of words and word pairs is
   ``SIMILARITY`` or more.  Texts of similarity 0.7 are 49 bits apart on average with a deviation of 6, so 58 bits hold nine
   tenths even of the least similar pairs.  Texts with equal signatures are matches.

With a fixed number of tries what is shuffled grows in proportion; what grows faster with a crowded space is the number of
comparisons in a node, since signatures must climb to the depth that the recall asks for.

Defined cases: a null or wordless text is in no group; rows with a null doc_id are in no group; rows that share a doc_id
are one document with several texts, each of which can bring it into a group; equal texts, and so repeated rows, always
share a group; a text of any length is read whole; of documents that tie the least doc_id gives the group its name; an
empty table gives an empty result; only doc_id and text are read, so extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm import textcore as tc

BITS, DISTANCE, RECALL, SIMILARITY = 256, 58, 0.97, 0.7
TRIES, DEEP, NODE, HOT = 64, 14, 64, 1 << 15
_ORDERS = [np.random.default_rng([7, t]).permutation(BITS)[:DEEP] for t in range(TRIES)]
_WEIGHTS = np.zeros((BITS, TRIES), dtype=np.float32)
_MASKS = np.zeros((TRIES, BITS), dtype=np.uint8)
for _t, _o in enumerate(_ORDERS):
    _WEIGHTS[_o, _t] = 2.0 ** np.arange(DEEP - 1, -1, -1)
    _MASKS[_t, _o] = 1
_MASKS = np.packbits(_MASKS, axis=1).view(np.uint64)


def features(h: np.ndarray) -> np.ndarray:
    """The sorted set of the hashes of a text's words and word pairs."""
    return np.unique(np.concatenate([h, tc.rolling(h, 2)]))


def signature(feats: np.ndarray) -> bytes:
    wide = np.empty((len(feats), 4), dtype=np.uint64)
    for k in range(4):
        wide[:, k] = tc.mix(feats + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (1 << 64) - 1))
    total = np.zeros(BITS, dtype=np.int64)
    for s in range(0, len(feats), 4096):
        total += np.unpackbits(wide[s : s + 4096].view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * total > len(feats)).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in tc.slices(batches):
        w = tc.Words(texts)
        ids, sigs = [], []
        for i, doc in enumerate(part.column(0).to_pylist()):
            h = w.hash[w.first[i] : w.first[i + 1]]
            if doc is None or not len(h):
                continue
            ids.append(doc)
            sigs.append(signature(features(h)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sig) of every document that has words."""
    return tc.ids_texts(docs).mapInArrow(_signatures, "doc_id bigint, sig binary")


def stacked(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint64).reshape(-1, BITS // 64)


def keys_of(sigs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sigs), dtype=np.uint64)
    for k in range(sigs.shape[1]):
        out = tc.mix(out ^ sigs[:, k])
    return out.view(np.int64)


def labels(sigs: np.ndarray) -> np.ndarray:
    """The first DEEP bits of each signature in each trie's order, as numbers (rows: signatures)."""
    return (np.unpackbits(sigs.view(np.uint8), axis=1).astype(np.float32) @ _WEIGHTS).astype(np.int32)


def density(counts: np.ndarray) -> np.ndarray:
    """How many signatures each node holds: entry (trie, 2^depth + prefix), from the counts of the deepest nodes."""
    out = np.zeros((len(counts), 2 << DEEP), dtype=np.int64)
    for d in range(DEEP, -1, -1):
        out[:, 1 << d : 2 << d] = counts
        counts = counts.reshape(len(counts), -1, 2).sum(2) if d else counts
    return out


def shared(depth: int, distance: int) -> float:
    """How likely two signatures at a distance agree on `depth` random bits."""
    return math.prod((BITS - distance - i) / (BITS - i) for i in range(depth))


def leaves(label: np.ndarray, dense: np.ndarray, node: int) -> np.ndarray:
    """The depth in each trie at which a signature's node holds no more than `node`."""
    out = np.zeros(label.shape, dtype=np.int8)
    tries = np.arange(label.shape[1])
    for d in range(DEEP):
        out += dense[tries, (1 << d) + (label >> (DEEP - d))] > node
    return out


def climbed(depth: np.ndarray, distance: int, recall: float) -> np.ndarray:
    """The depths after those that a signature is deepest at have been left, level by level, until its recall is reached."""
    depth = depth.copy()
    missed = np.array([math.log1p(-min(shared(d, distance), 1 - 1e-12)) for d in range(DEEP + 1)])
    goal = math.log1p(-recall)
    short = np.flatnonzero(missed[depth].sum(1) > goal)
    while len(short):
        part = depth[short]
        top = part.max(1, keepdims=True)
        part = np.where((part == top) & (top > 0), part - 1, part)
        depth[short] = part
        short = short[(missed[part].sum(1) > goal) & (part.max(1) > 0)]
    return depth


def _slots(label: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return (1 << depth.astype(np.int32)) + (label >> (DEEP - depth.astype(np.int32)))


def _rows(batches: Iterator[pa.RecordBatch], size: int = 20_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
            yield t, stacked(t.column(0).to_pylist())
    if sum(b.num_rows for b in held):
        t = pa.Table.from_batches([b for b in held if b.num_rows]).combine_chunks().to_batches()[0]
        yield t, stacked(t.column(0).to_pylist())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TRIES << DEEP, dtype=np.int64)
    for _, sigs in _rows(batches):
        total += np.bincount((labels(sigs) + (np.arange(TRIES, dtype=np.int32) << DEEP)).ravel(), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])


def _stops(dense: np.ndarray, distance: int, recall: float, node: int):
    """The nodes (trie << (DEEP + 1) | slot) at which any signature stops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(TRIES << (DEEP + 1), dtype=bool)
        for _, sigs in _rows(batches):
            label = labels(sigs)
            mark[(_slots(label, climbed(leaves(label, dense, node), distance, recall)) + (np.arange(TRIES, dtype=np.int32) << (DEEP + 1))).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(mark).astype(np.int32))], names=["slot"])

    return run


class Forest:
    """The density of all nodes and the nodes where signatures stop; of a size that doesn't depend on the corpus."""

    def __init__(self, reps: DataFrame, distance: int, recall: float, node: int, hot: int):
        self.distance, self.recall, self.node, self.hot = distance, recall, node, hot
        few = reps.select("sig").coalesce(max(1, math.ceil(reps.count() / 500_000)))
        got = few.mapInArrow(_count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(TRIES << DEEP, dtype=np.int64)
        counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
        self.dense = density(counts.reshape(TRIES, -1))
        self.stop = np.zeros(TRIES << (DEEP + 1), dtype=bool)
        self.stop[few.mapInArrow(_stops(self.dense, distance, recall, node), "slot int").distinct().toArrow().column("slot").to_numpy()] = True

    def places(self, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(depth, slot of the node that goes to one task, number of blocks that it is cut into) of each signature in each trie."""
        label = labels(sigs)
        depth = climbed(leaves(label, self.dense, self.node), self.distance, self.recall)
        tries = np.arange(TRIES, dtype=np.int32)
        slot = np.zeros(label.shape, dtype=np.int32)
        blocks = np.ones(label.shape, dtype=np.int64)
        going = np.ones(label.shape, dtype=bool)  # not yet at a node where any signature stops, nor at one that is small
        for d in range(DEEP + 1):
            here = (1 << d) + (label >> (DEEP - d))
            n = self.dense[tries, here]
            stop = self.stop[here + (tries << (DEEP + 1))]
            end = going & (stop | (n <= self.hot // 4))
            slot[end] = here[end]
            blocks[end] = np.maximum(1, -(-n[end] // self.hot))
            going &= ~end
        return depth, slot, blocks


def _packed(forest, with_root: bool):
    """(bucket, sigs, depths, roots) of runs of signatures; a bucket is a trie, a node, and a pair of blocks of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest()
        for part, sigs in _rows(batches):
            root = part.column(1).to_numpy() if with_root else None
            key = keys_of(sigs).view(np.uint64)
            depth, slot, blocks = f.places(sigs)
            for t in range(TRIES):
                row, bucket = np.arange(len(sigs)), (np.int64(t) << np.int64(48)) | (slot[:, t].astype(np.int64) << np.int64(32))
                if (cut := np.flatnonzero(blocks[:, t] > 1)).size:
                    g = blocks[cut, t]
                    again = np.repeat(cut, g)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(g) - g, g)
                    mine = ((key[again] >> np.uint64(9)) % blocks[again, t].astype(np.uint64)).astype(np.int64)
                    whole = np.flatnonzero(blocks[:, t] <= 1)
                    bucket = np.concatenate([bucket[whole], bucket[again] | (np.minimum(mine, other) << np.int64(16)) | np.maximum(mine, other)])
                    row = np.concatenate([whole, again])
                order = np.argsort(bucket, kind="stable")
                row, bucket = row[order], bucket[order]
                at = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
                spans = [(s, e) for s, e in zip(at, at[1:]) if e > s]
                s_, d_ = sigs[row], depth[row, t]
                cols = [pa.array([bucket[s] for s, _ in spans], pa.int64()), pa.array([s_[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([d_[s:e].tobytes() for s, e in spans], pa.binary())]
                cols.append(pa.array([root[row[s:e]].tobytes() for s, e in spans], pa.binary()) if with_root else pa.nulls(len(spans), pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "sigs", "depths", "roots"])

    return run


def _near(x: np.ndarray, y: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of x and y whose distance is at most limit, in blocks, in order of i."""
    step = max(1, (1 << 16) // max(1, len(y)))
    for s in range(0, len(x), step):
        block = x[s : s + step]
        d = np.bitwise_count(block[:, None, 0] ^ y[None, :, 0]).astype(np.uint16)
        for k in range(1, x.shape[1]):
            d += np.bitwise_count(block[:, None, k] ^ y[None, :, k])
        i, j = np.nonzero(d <= limit)
        if len(i):
            yield i + s, j


def searched(t: int, sig: np.ndarray, depth: np.ndarray, root: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (rows i, j) of one bucket of trie t.

    Without roots, one link for every row that is near any other; with them, all pairs whose roots differ.  Two rows meet
    in the node of the one that stops higher.  Pairs that agree on all DEEP bits of an earlier trie have met there.
    """
    label = np.zeros(len(sig), dtype=np.int32)
    bits = np.unpackbits(sig.view(np.uint8), axis=1)
    for k, b in enumerate(_ORDERS[t]):
        label |= bits[:, b].astype(np.int32) << (DEEP - 1 - k)
    for d in np.unique(depth).tolist():
        here = np.flatnonzero(depth >= d)
        node = label[here] >> (DEEP - d)
        here = here[np.argsort(node, kind="stable")]
        node = label[here] >> (DEEP - d)
        for rows in np.split(here, np.flatnonzero(np.diff(node)) + 1):
            stop = rows[depth[rows] == d]
            if not len(stop) or len(rows) < 2 or root is not None and (root[rows] == root[rows[0]]).all():
                continue
            rows = np.concatenate([stop, rows[depth[rows] > d]])  # a row that stops here meets those after it
            linked = np.zeros(len(rows), dtype=bool)
            for i, j in _near(sig[stop], sig[rows], distance):
                on = i < j
                if root is not None:
                    on &= root[rows[i]] != root[rows[j]]
                i, j = i[on], j[on]
                if root is None and len(i):
                    # the first near row before j, and for an i that nothing has reached its first near row after it
                    _, first = np.unique(j, return_index=True)
                    first = first[~linked[j[first]]]
                    linked[j[first]] = linked[i[first]] = True
                    lone = np.flatnonzero(~linked[i])
                    _, k = np.unique(i[lone], return_index=True)
                    linked[i[lone[k]]] = True
                    first = np.concatenate([first, lone[k]])
                    i, j = i[first], j[first]
                for s in range(0, len(i), 4096):
                    a, b = rows[i[s : s + 4096]], rows[j[s : s + 4096]]
                    if root is not None and t:
                        met = (((sig[a] ^ sig[b])[:, None, :] & _MASKS[None, :t]).max(2) == 0).any(1)
                        a, b = a[~met], b[~met]
                    yield a, b


def _candidates(distance: int):
    """(a, b), keys of candidates, least first; rows come sorted by bucket."""

    def flush(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        sig = stacked([h[0] for h in held])
        depth = np.frombuffer(b"".join(h[1] for h in held), dtype=np.int8)
        root = np.frombuffer(b"".join(h[2] for h in held), dtype=np.int64) if held[0][2] is not None else None
        if len(sig) < 2:
            return
        key = keys_of(sig)
        for a, b in searched(bucket >> 48, sig, depth, root, distance):
            x, y = key[a], key[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != last and held:
                    yield from flush(last, held)
                    held = []
                last = bucket
                held.append(tuple(batch.column(k)[i].as_py() for k in (1, 2, 3)))
        if held:
            yield from flush(last, held)

    return run


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in tc.slices(batches):
        w = tc.Words(texts)
        feats = [features(w.hash[w.first[i] : w.first[i + 1]]) for i in range(len(texts))]
        feats = [f for f in feats if len(f)]
        sigs = [signature(f) for f in feats]
        yield pa.RecordBatch.from_arrays([pa.array(keys_of(stacked(sigs))), pa.array([f.tobytes() for f in feats], pa.binary())], names=["key", "feats"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of features."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(f.as_py(), dtype=np.uint64) for f in batch.column(k)] for k in (2, 3))
            keep = [min(len(f), len(g)) >= similarity * max(len(f), len(g)) and jaccard(f, g) >= similarity for f, g in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sigs = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(stacked(sigs))), batch.column(1), batch.column(0)], names=["key", "rep", "sig"])


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, recall: float = RECALL, similarity: float = SIMILARITY, node: int = NODE, hot: int = HOT, small: int = 1 << 20) -> DataFrame:
    """(doc_id, group_id, group_size) of each document in a near-duplicate group; group_id is the group's least doc_id."""
    sc = docs.sparkSession.sparkContext
    sigs = tc.checkpointed(signatures(docs))
    reps = tc.checkpointed(sigs.groupBy("sig").agg(F.min("doc_id").alias("rep")).mapInArrow(_keyed, "key bigint, rep bigint, sig binary"))
    given = sc.broadcast(Forest(reps, distance, recall, node, hot))

    def candidates(rows: DataFrame, with_root: bool) -> DataFrame:
        packed = rows.mapInArrow(lambda it: _packed(lambda: given.value, with_root)(it), "bucket bigint, sigs binary, depths binary, roots binary")
        return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_candidates(distance), "a bigint, b bigint").distinct()

    links = tc.checkpointed(candidates(reps.select("sig"), False))
    touched = tc.checkpointed(links.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    mine = tc.checkpointed(reps.join(touched, "key", "left_semi"))
    wanted = mine.select(F.col("rep").alias("doc_id")).distinct()
    side = F.broadcast(wanted) if mine.count() <= small else wanted
    text = tc.ids_texts(docs).join(side, "doc_id", "left_semi")
    feats = tc.checkpointed(text.mapInArrow(_features_of, "key bigint, feats binary").dropDuplicates(["key"]))

    def similar(p: DataFrame) -> DataFrame:
        both = p.join(feats.select(F.col("key").alias("b"), F.col("feats").alias("fb")), "b").join(feats.select(F.col("key").alias("a"), F.col("feats").alias("fa")), "a")
        return both.select("a", "b", "fa", "fb").mapInArrow(_similar(similarity), "a bigint, b bigint")

    near = tc.checkpointed(tc.components(similar(links)))
    rooted = mine.join(near.select(F.col("node").alias("key"), "root"), "key", "left").select("sig", F.coalesce("root", "key").alias("root"))
    more = similar(candidates(rooted, True).join(links, ["a", "b"], "left_anti"))
    names = mine.select("key", "rep")
    edges = near.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
    edges = edges.join(names.select(F.col("key").alias("a"), F.col("rep").alias("x")), "a").join(names.select(F.col("key").alias("b"), F.col("rep").alias("y")), "b").select("x", "y").where("x <> y")
    same = sigs.join(reps.select("sig", F.col("rep").alias("x")), "sig").select("x", F.col("doc_id").alias("y")).where("x <> y")
    groups = tc.checkpointed(tc.components(edges.union(same).select(F.col("x").alias("a"), F.col("y").alias("b"))))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"))
    return groups.join(sizes, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), "group_size")


def without_ids(docs: DataFrame, ids: DataFrame, small: int = 1 << 20) -> DataFrame:
    """docs without the rows whose doc_id is in ids (one column, checkpointed); ids are broadcast if they are few."""
    gone = f"gone_{uuid.uuid4().hex}"
    ids = ids.select(F.col(ids.columns[0]).alias(gone))
    side = F.broadcast(ids) if ids.count() <= small else ids
    return docs.join(side, docs["doc_id"] == F.col(gone), "left_anti")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with only the document of least doc_id of each group; what is in no group stays."""
    gone = tc.checkpointed(near_duplicates(docs).where("doc_id <> group_id").select("doc_id"))
    return without_ids(docs, gone)
