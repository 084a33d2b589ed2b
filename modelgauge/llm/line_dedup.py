"""Fuzzy line dedup by MinHash (operator 5).

A line is compared by its normal form (lower case, white space collapsed).  Lines with equal normal forms are the same.
Lines with at least ``SHINGLE`` bytes also are the same if the Jaccard similarity of their sets of byte ``SHINGLE``-grams is
``SIMILARITY`` or more.  The threshold lies in the valley between unrelated and near lines, so that one changed letter in a
line of 30 bytes still makes a near line.  ``BANDS`` bands of ``ROWS`` of ``MINIMA`` minima each propose pairs: a pair of
similarity 0.45 shares a band with a probability of 0.59, one of 0.5 of 0.75, one of 0.55 of 0.87, one of 0.6 of 0.95, one of 0.7
of 0.997 (bands of three rows, for 0.9 at 0.45 itself, propose five times as many pairs: see the README for what that costs).
Proposed pairs are verified exactly, after a bound that is never too low, and distributed union-find joins the verified ones.
Pairs of a band's first line come first; another pair of the band is verified only if those left its lines in different
components, since otherwise it can't change a component.
Of each component the line of least (doc_id, text hash, line number) stays; a null doc_id comes first.

Between the passes only hashes move, packed: a task sends each bucket of bands one row of arrays, so the shuffle moves few
large rows, and a line counts once a task however often it occurs.  The lines of a band of more than ``BLOCK`` are worked
off in pairs of blocks, which are rows of their own, so no task holds or compares a whole hot band.  Which lines need
verifying is told to the second pass by a Bloom filter of fixed size, and only their texts are shuffled.  That pass also
writes down where every line is, so texts are read and cut into lines twice; a run of texts is normalised at once, as bytes.

Defined cases: blank lines are never removed; a null text has no lines; a line of any length, and a text of any length, is read
whole; rows with the same doc_id and text are one document and lose the same lines, rows with the same doc_id and other
texts are documents of their own; equal lines within a text go but for the first; a document all of whose lines go keeps
its row, with an empty text; an empty table gives an empty result; only doc_id and text are read, and `deduplicated` keeps all
other columns, whatever their names (n_chars, if there is one, follows the text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm import textcore as tc

SHINGLE, SIMILARITY, MINIMA, BANDS, ROWS, BLOCK = 8, 0.45, 64, 24, 4, 4096
_A = np.random.default_rng(11).integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(12).integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def _design() -> list[list[int]]:
    """The minima of each band: all are used about equally often, and no two together in more than one band."""
    r = np.random.default_rng(13)
    used, together, out = np.zeros(MINIMA), set(), []
    while len(out) < BANDS:
        band = sorted(np.argsort(used + r.random(MINIMA) * 0.9)[:ROWS].tolist())
        pairs = {(a, b) for a in band for b in band if a < b}
        if not pairs & together:
            used[band] += 1
            together |= pairs
            out.append(band)
    return out


DESIGN = _design()
_MIX = np.random.default_rng(14).integers(0, 1 << 62, (ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


_WIDE_SPACES = [chr(c) for c in range(128, 1 << 16) if chr(c).isspace()]
_CODES = np.array([int.from_bytes(w) << 8 * (3 - len(w)) for w in (c.encode() for c in _WIDE_SPACES)])
_SPACES = {c: " " for c in range(1 << 16) if chr(c).isspace() and c != ord("\n")}
#: Of each byte: 1 for a space, 2 for a line's end, 3 for what may begin white space of several bytes, 4 for other white space.
_KIND = bytes(1 if b == 32 else 2 if b == 10 else 4 if b < 128 and chr(b).isspace() else 3 if b in {c.encode()[0] for c in _WIDE_SPACES} else 0 for b in range(256))


def _other_space(buf: np.ndarray, kind: np.ndarray) -> bool:
    """Whether there is white space besides spaces and line ends, be it of several bytes."""
    if (kind == 4).any():
        return True
    at = np.flatnonzero(kind == 3)
    one, two, three = (buf[np.minimum(at + k, len(buf) - 1)].astype(np.int64) for k in range(3))
    return bool(np.isin(one << 16 | two << 8 | np.where(one < 0xE0, 0, three), _CODES).any())


def normals(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normal forms of all lines of several texts, at once: their bytes, and where each begins and ends. Blank lines are empty."""

    def read(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = b"\n".join([*(t.encode("utf-8", "surrogatepass") for t in low), b""])
        return np.frombuffer(data, dtype=np.uint8), np.frombuffer(data.translate(_KIND), dtype=np.uint8)

    low = [t.lower() for t in texts]
    buf, kind = read(low)
    if _other_space(buf, kind):
        buf, kind = read([t.translate(_SPACES) for t in low])
    last = np.zeros(len(kind), dtype=bool)  # a space that another one or the line's end follows goes
    np.logical_and(kind[:-1] == 1, (kind[1:] == 1) | (kind[1:] == 2), out=last[:-1])
    if last.any():
        buf, kind = buf[~last], kind[~last]
    lead = kind == 1  # so does one that a line begins with
    lead[1:] &= kind[:-1] == 2
    if lead.any():
        buf, kind = buf[~lead], kind[~lead]
    end = np.flatnonzero(kind == 2)
    return buf, np.concatenate([[0], end[:-1] + 1]), end


class Lines:
    """The non-blank lines of several texts: text number, line number, normal form and its hash."""

    def __init__(self, texts: list[str]):
        if not texts:
            texts = [""]
        buf, at, end = normals(texts)
        n = np.array([t.count("\n") + 1 for t in texts])
        some = np.flatnonzero(end > at)
        self.text = np.repeat(np.arange(len(texts)), n)[some]
        self.no = some - (np.cumsum(n) - n)[self.text]
        self.bytes = Joined(buf, at[some], (end - at)[some])
        self.hash = self.bytes.hash

    def norms(self, chosen: np.ndarray) -> list[bytes]:
        data = self.bytes.buf.tobytes()
        return [data[a : a + n] for a, n in zip(self.bytes.at[chosen].tolist(), self.bytes.size[chosen].tolist())]

    def bands(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of line, band) of the chosen lines that have shingles."""
        use = chosen[self.bytes.size[chosen] >= SHINGLE]
        if not len(use):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        wide, first = self.bytes.shingles(use)
        h = (wide >> np.uint64(32)).astype(np.uint32)
        low, some = np.empty((MINIMA, len(use)), dtype=np.uint64), np.empty_like(h)
        for k in range(MINIMA):
            np.bitwise_xor(h, _B[k], out=some)
            np.multiply(some, _A[k], out=some)
            low[k] = np.minimum.reduceat(some, first)
        low = tc.mix(low)
        out = np.empty((BANDS, len(use)), dtype=np.uint64)
        for band, ks in enumerate(DESIGN):
            out[band] = (low[ks] * _MIX).sum(0) + np.uint64(band)
        return np.tile(self.hash[use], BANDS), tc.mix(out).ravel()


class Joined:
    """Byte strings in one buffer: where they begin, their sizes, their hashes, and the hashes of their shingles."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.buf, self.at, self.size = buf, at, size
        p, self.inv = tc.powers(len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, dtype=np.uint64)
        term = buf.astype(np.uint64)
        term += np.uint64(1)
        term *= p[: len(buf)]
        np.cumsum(term, out=self.total[1:])
        self.hash = tc.mix((self.total[at + size] - self.total[at]) * self.inv[at])

    @classmethod
    def of(cls, norm: list[bytes]) -> Joined:
        size = np.fromiter(map(len, norm), dtype=np.int64, count=len(norm))
        return cls(np.frombuffer(b"\n".join([*norm, b""]), dtype=np.uint8), np.cumsum(size + 1) - size - 1, size)

    def shingles(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles of the strings `use`, each of at least SHINGLE bytes, and where each string's begin."""
        n = self.size[use] - SHINGLE + 1
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        at = np.arange(n.sum()) - np.repeat(first - self.at[use], n)
        if 2 * len(at) > len(self.buf):  # most of the buffer: in its order, then those that lie within a string
            h = self.total[SHINGLE:] - self.total[:-SHINGLE]
            h *= self.inv[: len(h)]
            h = h[at]
            del at
            return tc.mix(h), first
        return tc.mix((self.total[at + SHINGLE] - self.total[at]) * self.inv[at]), first


def _bands(log2_buckets: int):
    """(bucket, keys, lines): the bands of a run of texts, one row a bucket; a bucket is the high bits of a band, keys are the next 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a line met before in this task has given its bands
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            line, band = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.argsort(band)
            line, band = line[order], band[order]
            bucket = (band >> np.uint64(64 - log2_buckets)).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            key = (band >> np.uint64(32 - log2_buckets)).astype(np.uint32)
            spans = list(zip(cut[:-1], cut[1:])) if len(bucket) else []
            cols = [pa.array(bucket[cut[:-1]] if spans else bucket), pa.array([key[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([line[s:e].tobytes() for s, e in spans], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["bucket", "keys", "lines"])

        for _, texts in tc.slices(batches, size=1 << 16):
            x = Lines(texts)
            h, first = np.unique(x.hash, return_index=True)
            names = h.tolist()
            held.append(x.bands(first[[n not in seen for n in names]] if names else first))
            if len(seen) > 1 << 20:
                seen = set()
            seen.update(names)
            if sum(len(h[0]) for h in held) > 1 << 21:
                yield rows()
                held = []
        if held:
            yield rows()

    return run


def blocks(members: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """Sets of at most two blocks of members that together hold every pair of them."""
    parts = [members[s : s + block] for s in range(0, len(members), block)]
    if len(parts) == 1:
        yield members
    for j in range(1, len(parts)):
        for i in range(j):
            yield np.concatenate([parts[i], parts[j]])


def _groups(block: int):
    """(a, b, members) of sorted buckets: a band's first line with each other one, and bands of three lines and more as sets."""

    def whole(keys: np.ndarray, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys)
        keys = keys[order]
        again = keys[1:] == keys[:-1]
        shared = np.zeros(len(keys), dtype=bool)  # most bands have one line, which proposes nothing
        shared[1:] = again
        shared[:-1] |= again
        keys, lines = keys[shared], lines[order[shared]]
        order = np.lexsort((lines, keys))
        keys, lines = keys[order], lines[order]
        once = np.ones(len(keys), dtype=bool)
        once[1:] = (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])
        keys, lines = keys[once], lines[once].view(np.int64)
        if not len(keys):
            return
        cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        size = np.diff(cut)
        head = np.repeat(lines[cut[:-1]], size)
        rest = np.ones(len(lines), dtype=bool)
        rest[cut[:-1]] = False
        pair = np.unique(np.stack([head[rest], lines[rest]], 1), axis=0) if rest.any() else np.empty((0, 2), np.int64)
        sets = {m.tobytes() for k in np.flatnonzero(size > 2) for m in blocks(lines[cut[k] : cut[k + 1]], block)}
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.nulls(len(pair), pa.binary())], names=["a", "b", "members"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64()), pa.array(list(sets), pa.binary())], names=["a", "b", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held[0]:
                yield from whole(np.frombuffer(b"".join(held[0]), dtype=np.uint32), np.frombuffer(b"".join(held[1]), dtype=np.uint64))

        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != last:
                    yield from flush()
                    held, last = ([], []), bucket
                held[0].append(batch.column(1)[i].as_py()), held[1].append(batch.column(2)[i].as_py())
        yield from flush()

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, line) of sets of lines; sets that are equal share their gid."""
    for batch in batches:
        sets = [np.frombuffer(m, dtype=np.int64) for m in batch.column(0).to_pylist()]
        if not sets:
            continue
        size = [len(s) for s in sets]
        line = np.concatenate(sets)
        gid = np.add.reduceat(tc.mix(line.view(np.uint64)), np.concatenate([[0], np.cumsum(size)[:-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gid.view(np.int64), size)), pa.array(line)], names=["gid", "line"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of lines (gid, line, root) of one set that are in different components; rows come sorted by gid."""

    def pairs(line: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(line) < 2 or (root == root[0]).all():
            return
        step = max(1, (1 << 20) // len(line))
        for s in range(0, len(line) - 1, step):
            i, j = np.nonzero((root[s : s + step, None] != root[None, :]) & (np.arange(s, min(s + step, len(line)))[:, None] < np.arange(len(line))[None, :]))
            a, b = line[i + s], line[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    kept = [np.empty(0, np.int64)] * 3
    for batch in batches:
        if not batch.num_rows:
            continue
        gid, line, root = (np.concatenate([k, batch.column(c).to_numpy()]) for c, k in enumerate(kept))
        cut = [0, *(np.flatnonzero(np.diff(gid)) + 1)]
        for s, e in zip(cut, cut[1:]):
            yield from pairs(line[s:e], root[s:e])
        kept = [x[cut[-1] :] for x in (gid, line, root)]
    yield from pairs(kept[1], kept[2])


def _places(bloom: np.ndarray, most: int = 1 << 16):
    """Of each text the places and hashes of its lines, packed, `most` a row; of each line that the filter lets through its normal form."""

    def packed(x: np.ndarray, cut: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "nos", "lines", "line", "norm"]
        for part, texts in tc.slices(batches):
            x = Lines(texts)
            first = np.searchsorted(x.text, x.text)
            cut = np.append(np.flatnonzero((np.arange(len(first)) - first) % most == 0), len(first))
            at = pa.array(x.text[cut[:-1]])
            step = max(1, (1 << 30) // (8 * most))  # rows of at most 1 GB
            for s in range(0, len(at), step):
                c = cut[s : s + step + 1]
                own = slice(c[0], c[-1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at[s : s + step]), part.column(2).take(at[s : s + step]), packed(x.no[own].astype(np.int32), c - c[0]), packed(x.hash[own], c - c[0]), pa.nulls(len(c) - 1, pa.int64()), pa.nulls(len(c) - 1, pa.binary())], names=names)
            h, first = np.unique(x.hash, return_index=True)
            keep = tc.bloom_has(bloom, h)
            n = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(h[keep].view(np.int64)), pa.array(x.norms(first[keep]), pa.binary())], names=names)

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, line_no, line) of packed lines."""
    for batch in batches:
        nos, lines = (b"".join(batch.column(c).to_pylist()) for c in (2, 3))
        at = pa.array(np.repeat(np.arange(batch.num_rows), [len(n) // 4 for n in batch.column(2).to_pylist()]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.frombuffer(nos, dtype=np.int32)), pa.array(np.frombuffer(lines, dtype=np.int64))], names=["doc_id", "text_hash", "line_no", "line"])


def shingle_set(norm: bytes) -> frozenset[bytes]:
    return frozenset(norm[i : i + SHINGLE] for i in range(len(norm) - SHINGLE + 1))


def jaccard(a: frozenset[bytes], b: frozenset[bytes]) -> float:
    both = len(a & b)
    return both / max(1, len(a) + len(b) - both)


def similar(x: list[bytes], y: list[bytes], least: float = SIMILARITY, width: int = 2048) -> np.ndarray:
    """Whether the Jaccard similarity of the shingle sets of each pair is at least `least`.

    Each set is first folded into `width` bits.  What two sets share is at most the bits that they share and what one of them
    lost in folding, which settles most pairs; the shingles of the rest are sorted, all at once, and counted, told apart by the
    high 51 bits of their hashes (fewer if there are more than 8191 strings).
    """
    names: dict[bytes, int] = {}
    i, j = (np.array([names.setdefault(s, len(names)) for s in side], dtype=np.int64) for side in (x, y))
    h, first = Joined.of(list(names)).shingles(np.arange(len(names)))
    n = np.diff(np.concatenate([first, [len(h)]]))
    line = np.repeat(np.arange(len(names)), n)
    bits = np.zeros((len(names), width), dtype=bool)
    bits[line, (h & np.uint64(width - 1)).astype(np.int64)] = True
    folded = np.packbits(bits, axis=1).view(np.uint64)
    ones = np.bitwise_count(folded).sum(1, dtype=np.int64)
    most = np.bitwise_count(folded[i] & folded[j]).sum(1, dtype=np.int64) + np.minimum(n[i] - ones[i], n[j] - ones[j])
    out = most >= least * (ones[i] + ones[j] - most) - 1e-9
    open_ = np.flatnonzero(out)
    if not len(open_):
        return out
    i, j = i[open_], j[open_]
    need = np.zeros(len(names), dtype=bool)
    need[i] = need[j] = True
    h, line = h[need[line]], line[need[line]]
    low = np.uint64(max(13, len(names).bit_length()))  # a plain sort of (line, the hash's high bits) is far cheaper than one on two keys
    key = np.sort(line.astype(np.uint64) << (np.uint64(64) - low) | h >> low)
    once = np.ones(len(key), dtype=bool)
    once[1:] = key[1:] != key[:-1]
    key = key[once]
    h, line = key << low, (key >> (np.uint64(64) - low)).astype(np.int64)
    at = np.searchsorted(line, np.arange(len(names) + 1))
    n = np.diff(at)
    both = np.zeros(len(i), dtype=np.int64)
    weight = np.cumsum(n[i] + n[j])
    s = 0
    while s < len(i):
        e = max(s + 1, int(np.searchsorted(weight, (weight[s - 1] if s else 0) + (1 << 20), side="right")))
        e = min(e, s + (1 << 13))
        pair = np.concatenate([np.repeat(np.arange(s, e), n[k[s:e]]) for k in (i, j)])
        begin = np.concatenate([at[k[s:e]] for k in (i, j)])
        size = np.concatenate([n[k[s:e]] for k in (i, j)])
        take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)
        key = np.sort(h[take] & np.uint64((1 << 64) - (1 << 13)) | (pair - s).astype(np.uint64))
        same = key[1:] == key[:-1]
        both[s:e] = np.bincount((key[1:][same] & np.uint64((1 << 13) - 1)).astype(np.int64), minlength=e - s)
        s = e
    out[open_] = both >= least * (n[i] + n[j] - both) - 1e-9
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, norm_a, norm_b): those whose sets of shingles are similar."""
    for batch in batches:
        for s in range(0, batch.num_rows, 1024):  # the shingles of all these are in memory at once
            part = batch.slice(s, 1024)
            if part.num_rows:
                yield part.select(["a", "b"]).filter(pa.array(similar(part.column(2).to_pylist(), part.column(3).to_pylist())))


def similar_lines(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, line_no, line) of all lines, and (line, root), the component of each line that is similar to another one."""
    text = tc.ids_texts(docs)
    log2_buckets = max(10, (8 * text.rdd.getNumPartitions()).bit_length())
    packed = text.mapInArrow(_bands(log2_buckets), "bucket bigint, keys binary, lines binary").repartition("bucket").sortWithinPartitions("bucket")
    found = tc.checkpointed(packed.mapInArrow(_groups(block), "a bigint, b bigint, members binary"))
    stars = tc.checkpointed(found.where("members is null").select("a", "b").distinct())
    member = tc.checkpointed(found.where("members is not null").select("members").mapInArrow(_members, "gid bigint, line bigint").distinct())
    lines = stars.select(F.explode(F.array("a", "b")).alias("line"))
    bloom = tc.bloom_words(lines, "line")
    shared = text.sparkSession.sparkContext.broadcast(bloom)
    places = tc.checkpointed(text.withColumn("text_hash", F.xxhash64("text")).mapInArrow(lambda it: _places(shared.value)(it), "doc_id bigint, text_hash bigint, nos binary, lines binary, line bigint, norm binary"))
    norms = tc.checkpointed(places.where("norm is not null").select("line", "norm").dropDuplicates(["line"]))

    def verified(p: DataFrame) -> DataFrame:
        both = p.join(norms.select(F.col("line").alias("a"), F.col("norm").alias("na")), "a").join(norms.select(F.col("line").alias("b"), F.col("norm").alias("nb")), "b")
        return both.select("a", "b", "na", "nb").mapInArrow(_verified, "a bigint, b bigint")

    near = tc.checkpointed(tc.components(verified(stars)))
    rooted = member.join(near.select(F.col("node").alias("line"), "root"), "line", "left").select("gid", "line", F.coalesce("root", "line").alias("root"))
    rooted = tc.checkpointed(rooted.repartition("gid"))
    split = rooted.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gid")
    rest = rooted.join(split, "gid", "left_semi").repartition("gid").sortWithinPartitions("gid").mapInArrow(_across, "a bigint, b bigint").distinct()
    edges = near.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(rest.join(stars, ["a", "b"], "left_anti")))
    occurrences = places.where("norm is null").select("doc_id", "text_hash", "nos", "lines").mapInArrow(_occurrences, "doc_id bigint, text_hash bigint, line_no int, line bigint")
    return occurrences, tc.components(edges).select(F.col("node").alias("line"), "root")


def duplicate_lines(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, line_no, kept_doc_id, kept_line_no) of each line that goes, with the one that stays for it."""
    lines, near = similar_lines(docs, block)
    keyed = lines.join(near, "line", "left").select("doc_id", "text_hash", "line_no", F.coalesce("root", "line").alias("key"))
    keyed = tc.checkpointed(keyed)
    firsts = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = keyed.join(firsts, "key").where("not (struct(doc_id, text_hash, line_no) <=> kept)")
    return gone.select("doc_id", "text_hash", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")).distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with those lines taken out of text; n_chars follows, if there is such a column."""
    gone = duplicate_lines(docs).groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias("lines")).select(F.struct("doc_id", "text_hash").alias("b"), "lines")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).alias("a"))
    out = whole.join(gone, F.col("a").eqNullSafe(F.col("b")), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("lines", i)), "\n")
    new = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(kept)
    cols = {c: F.col("row").getField(c) for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col("lines").isNull(), F.col("row.n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(cols[c].alias(c) for c in docs.columns))
