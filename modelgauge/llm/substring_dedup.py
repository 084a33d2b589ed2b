"""Suffix-array dedup by bucket-pointer refinement (operator 3): passages that repeat across documents.

Suffixes begin at words.  Their first buckets are those of their first ``Q`` words.  A bucket is refined by sorting its suffixes
on the bucket identifiers that they have at a later offset: on those of ``Q`` words later, then, as refined, on those 2 ``Q``
words later, and so on, so after k refinements suffixes share a bucket if and only if their first Q 2^k words are equal, and
each refinement reuses what the last one made of all later offsets.  An identifier is a 64-bit hash of the identifiers it is
made of; so a suffix knows its pointers (the identifiers at later offsets) where its document is, and takes them along.

1. Sampling: the first shuffle takes only suffixes whose 24-word identifier is the least of some 25 consecutive ones: each run
   of 48 words contains such a suffix, and equal runs contain the same.  Buckets with suffixes of one document are finished.
2. All suffixes within reach of an unfinished one go, packed in arrays, to the task of their 24-word bucket, with their pointer
   24 words later; sampled ones bring those 48, 96, ... words later too.  What already shares its 48 words within the sending
   task is settled there, and only the least and greatest document of such a bucket travel: a passage that thousands of
   documents have costs two suffixes a task.
3. The task sorts each bucket on the pointers, round by round, until every bucket is of one document.  Suffixes that still
   share 48 words are hits; how far a sampled one went (48, 96, 192, ... words) is its reach.

What is unfinished goes from step 1 to step 2 as a Bloom filter of fixed size; what it lets through in error step 3 sorts out.

Result: the maximal spans of words every WORDS-word window of which occurs in another document as well, and the greatest
reach within each (at least WORDS).

Defined cases: words are runs of letters and digits, in lower case; null texts, and texts of fewer than WORDS words, have no
spans; texts of any length are read whole; repeats within one doc_id only (rows that share it are one document here) don't
count, while repeated rows are no other document and give their spans once; rows with a null doc_id are left out; no order
among documents matters, so there are no ties; an empty table gives an empty result; only doc_id and text are read, so
extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm import textcore as tc

Q = 12
HALF = 2 * Q  # words of the buckets that are looked up across documents first
WORDS = 2 * HALF


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each run of n values."""
    width = 1
    while width * 2 <= n:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def buckets(words: np.ndarray, q: int = Q) -> np.ndarray:
    """Identifiers of the first buckets, one for each suffix of at least q words."""
    return tc.rolling(words, q)


def refine(ids: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers of the buckets refined by the buckets `offset` later."""
    if len(ids) <= offset:
        return np.empty(0, dtype=np.uint64)
    return tc.mix(ids[:-offset] * np.uint64(0xD6E8FEB86659FD93) + tc.mix(ids[offset:]))


def refined_buckets(words: np.ndarray, length: int, q: int = Q) -> np.ndarray:
    """Identifiers of the buckets of the first `length` words, q times a power of two."""
    ids = buckets(words, q)
    while q < length:
        ids, q = refine(ids, q), 2 * q
    return ids


def sampled(ids: np.ndarray, q: int = HALF) -> np.ndarray:
    """Which suffixes have the least identifier of some q + 1 consecutive ones."""
    if len(ids) <= q:
        return np.zeros(len(ids), dtype=bool)
    low = _slide(ids, q + 1, np.minimum)
    pad = np.zeros(q, dtype=np.uint64)
    return _slide(np.concatenate([pad, low, pad]), q + 1, np.maximum) == ids


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in tc.slices(batches):
        w = tc.Words(texts)
        docs, out = [], []
        for i, doc in enumerate(part.column(0).to_pylist()):
            if doc is None or w.first[i + 1] - w.first[i] < WORDS:
                continue
            ids = refined_buckets(w.hash[w.first[i] : w.first[i + 1]], HALF)
            own = np.unique(ids[sampled(ids)])
            out.append(own)
            docs.append(np.full(len(own), doc, dtype=np.int64))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(docs))], names=["bucket", "doc_id"])


def pointers(ids: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes `at`, the identifiers `length`, 2 length, 4 length ... words later, each refined to as many words: (how many each has, all in a row)."""
    count, found = np.zeros(len(at), dtype=np.int64), []
    while len(ids) > length:
        has = np.flatnonzero(at + length < len(ids))
        if not len(has):
            break
        count[has] += 1
        found.append((has, ids[at[has] + length]))
        ids, length = refine(ids, length), 2 * length
    if not found:
        return count, np.empty(0, dtype=np.uint64)
    who, what = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return count, what[np.argsort(who, kind="stable")]


def _differ(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by group: whether each row's group has two documents, and the rows of each group's least and greatest."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    size = np.diff(np.concatenate([first, [len(group)]]))
    at = np.arange(len(group)) - np.repeat(first, size)
    big = len(group)
    pick = [np.minimum.reduceat(np.where(doc == np.repeat(x, size), at, big), first) + first for x in (low, high)]
    return np.repeat(low != high, size), np.unique(np.concatenate(pick)[np.tile(low != high, 2)]), first


SENT = "part int, bucket binary, pointer binary, doc binary, text_hash binary, at binary, count binary, chain binary"


def _later_round(bloom: np.ndarray, log2_parts: int, flush_at: int = 1 << 20):
    """Packed suffixes near an unfinished one: by part of bucket those to be refined, with parts under 0 those settled here."""

    def packed(part: int, rows: tuple, pick: np.ndarray, whole: bool) -> tuple:
        bucket, pointer, doc, text, at, count, chain, begin = rows
        none = np.empty(0, dtype=np.uint64)
        n = count[pick]
        take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[pick], n)
        cols = (bucket[pick], pointer[pick], doc[pick], text[pick], at[pick], n.astype(np.uint8), chain[take]) if whole else (none, none, doc[pick], text[pick], at[pick], none, none)
        return (part, *(c.tobytes() for c in cols))

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate([h[k] for h in held]) for k in range(7)]
        count = cols[5]
        rows = (*cols, np.cumsum(count) - count)
        bucket, pointer, doc = cols[:3]
        order = np.lexsort((pointer, bucket))
        group = refined_pair(bucket[order], pointer[order])
        shared, ends, _ = _differ(group, doc[order])
        send = ~shared | (count[order] > 0)
        send[ends] = True
        out = [packed(-1 - int(bucket[0] % np.uint64(1 << 20)), rows, order[shared], False)] if shared.any() else []
        go = order[send]
        part = (bucket[go] >> np.uint64(64 - log2_parts)).astype(np.int64)
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        out += [packed(int(part[s]), rows, go[s:e], True) for s, e in zip(cut, cut[1:]) if e > s]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.binary()) for k in range(1, 8))], names=["part", "bucket", "pointer", "doc", "text_hash", "at", "count", "chain"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, texts in tc.slices(batches):
            w = tc.Words(texts)
            hashes = part.column(2).to_numpy(zero_copy_only=False)
            for i, doc in enumerate(part.column(0).to_pylist()):
                if doc is None or w.first[i + 1] - w.first[i] < WORDS:
                    continue
                ids = refined_buckets(w.hash[w.first[i] : w.first[i + 1]], HALF)
                mine = sampled(ids)
                here = np.flatnonzero(mine)
                here = here[tc.bloom_has(bloom, ids[here])]
                if not len(here):
                    continue
                n = len(ids) - HALF  # suffixes of at least WORDS words
                near = np.zeros(n + HALF + 1, dtype=np.int32)
                np.add.at(near, np.maximum(0, here - HALF), 1)
                np.add.at(near, np.minimum(here + 1, len(near) - 1), -1)
                use = np.flatnonzero(np.cumsum(near)[:n] > 0)
                count, chain = np.zeros(len(use), dtype=np.int64), np.empty(0, dtype=np.uint64)
                if (deep := np.flatnonzero(mine[use])).size:
                    count[deep], chain = pointers(refine(ids, HALF), use[deep], WORDS)
                held.append((ids[use], ids[use + HALF], np.full(len(use), doc, np.int64), np.full(len(use), hashes[i], np.int64), use.astype(np.int32), count, chain))
                size += len(use)
                if size >= flush_at:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def refined_pair(bucket: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    return tc.mix(bucket * np.uint64(0xD6E8FEB86659FD93) + tc.mix(pointer))


def refined_reach(bucket: np.ndarray, pointer: np.ndarray, doc: np.ndarray, count: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """How many words (0, or WORDS 2^k) each suffix shares with another document's: buckets are sorted on pointers until each is of one document."""
    reach = np.zeros(len(bucket), dtype=np.int32)
    begin = np.cumsum(count) - count
    rows, ids, later, length, k = np.arange(len(bucket)), bucket, pointer, WORDS, 0
    while len(rows):
        order = np.lexsort((later, ids))
        rows, ids = rows[order], refined_pair(ids[order], later[order])
        shared, _, _ = _differ(ids, doc[rows])
        rows, ids = rows[shared], ids[shared]
        reach[rows] = length
        on = count[rows] > k
        rows, ids = rows[on], ids[on]
        later = chain[begin[rows] + k]
        k, length = k + 1, 2 * length
    return reach


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, at, reach) of suffixes that share WORDS words with another document; rows come sorted by part."""

    def whole(part: int, held: list) -> pa.RecordBatch:
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint8, np.uint64)
        bucket, pointer, doc, text, at, count, chain = (np.frombuffer(b"".join(h[k] for h in held), dtype=t) for k, t in enumerate(kinds))
        reach = np.full(len(doc), WORDS, dtype=np.int32) if part < 0 else refined_reach(bucket, pointer, doc, count.astype(np.int64), chain)
        hit = np.flatnonzero(reach)
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (doc, text, at, reach)], names=["doc_id", "text_hash", "at", "reach"])

    held, last = [], None
    for batch in batches:
        for i, part in enumerate(batch.column(0).to_pylist()):
            if part != last and held:
                yield whole(last, held)
                held = []
            last = part
            held.append(tuple(batch.column(k)[i].as_py() for k in range(1, 8)))
    if held:
        yield whole(last, held)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that overlap or touch are one span; a text's hits are all in one partition, and a place may be given twice."""
    got = pa.Table.from_batches(list(batches), schema=pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32()), ("reach", pa.int32())]))
    doc, text, at, reach = (got.column(k).to_numpy() for k in range(4))
    order = np.lexsort((at, doc, text))
    doc, text, at, reach = doc[order], text[order], at[order], reach[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (at[1:] > at[:-1] + WORDS)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1 if len(first) else first
    longest = np.maximum.reduceat(reach, first) if len(first) else reach
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first], text[first], at[first], (at[last] + np.int32(WORDS)).astype(np.int32), longest)], names=["doc_id", "text_hash", "start_word", "end_word", "longest"])


def repeated_spans(docs: DataFrame, flush_at: int = 1 << 20) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word, longest): end_word is the first word after the span, longest its greatest reach."""
    text = tc.ids_texts(docs)
    first = text.mapInArrow(_first_round, "bucket bigint, doc_id bigint")
    shared = first.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("bucket")
    bloom = text.sparkSession.sparkContext.broadcast(tc.bloom_words(shared, "bucket"))
    log2_parts = max(10, (8 * text.rdd.getNumPartitions()).bit_length())
    keyed = text.withColumn("text_hash", F.xxhash64("text"))
    sent = keyed.mapInArrow(lambda it: _later_round(bloom.value, log2_parts, flush_at)(it), SENT).repartition("part").sortWithinPartitions("part")
    hits = sent.mapInArrow(_refine, "doc_id bigint, text_hash bigint, at int, reach int").repartition("text_hash")
    return hits.mapInArrow(_spans, "doc_id bigint, text_hash bigint, start_word int, end_word int, longest int")
