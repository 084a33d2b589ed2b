"""Toxicity by noisy-channel deobfuscation (operator 1).

1. A character trigram language model is counted over the whole texts of all documents (64 character classes, so what is
   gathered is bounded by 64^3 for each task and grows with the number of tasks).
2. A lexicon of toxic words and word beginnings, each with its share of toxic documents, is fitted on labelled documents:
   at most ``LABELLED`` of them, those of least hash of doc_id.  This bound is the one place where not all rows count.
   Texts that are alike count once, and an entry must be in ``LEAST_PART`` of the toxic ones, so that the rare words of a
   toxic document that was copied don't pass for toxic words.
3. Each document's tokens that show leetspeak before or within letters, inner symbols, stretched letters or letters spaced
   apart become a lattice of readings (a substitution, a deletion, a vowel for a star, a boundary or none), and a Viterbi
   search over pairs of classes finds the likeliest text under the channel's costs and the language model.  Substitutions at
   a word's end, letters doubled, and words broken in pieces are too common in clean texts for that: such tokens become
   lattices if their skeleton (substitutions undone one way, runs of a letter as one) begins like that of a lexicon entry,
   which each restored term needs.  All other tokens have but one reading, themselves.
4. The restored text is scored: 1 - the product of (1 - share) over the lexicon entries found.  ``THRESHOLD`` decides.

Defined cases: null or empty texts score 0 and are never toxic; an empty table gives an empty result; texts of any length are
read whole; each row is judged by its own text, so rows with a null doc_id go if they are toxic, rows that share a doc_id are
judged apart, and repeated rows are judged alike; of readings that cost the same the one that was made first, with fewer
letters changed, stays; without any toxic label the lexicon is empty and nothing is toxic; only doc_id, text and the labels'
doc_id and toxic are read, so extra columns, whatever their names, don't matter, and `without_toxic` keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm import textcore as tc

LABELLED, THRESHOLD, LEAST_SHARE, LEAST_DOCS, LEAST_PART, DOUBLED = 8000, 0.85, 0.9, 4, 0.015, 1.0
N = 64
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåçèéêëìíîïñòóôöõùúûüýßœ"
CLASS = np.full(0x10000, 62, dtype=np.uint8)  # 0: boundary, 1..: letters, 61: digits, 62: others
for _i, _c in enumerate(LETTERS):
    CLASS[ord(_c)] = _i + 1
for _c in "0123456789":
    CLASS[ord(_c)] = 61
for _c in range(0x250):
    if not chr(_c).isalnum():
        CLASS[_c] = 0
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "6": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_LEET = "0134567896@$!|+(€£*"
_SUSPECT = re.compile(rf"[{re.escape(_LEET)}][^\W\d_]|[^\W\d_][\d@$!|+(€£*._\-~]+[^\W\d_]|([^\W\d_])\1\1")
_EDGE = re.compile(r"^[^\w@$!|+(€£*]+|[^\w]+$")
_IS_LEET = np.array([chr(b) in _LEET for b in range(256)])
_IS_INNER = np.array([chr(b) in "0123456789@$!|+(*._-~" for b in range(256)])
_IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_SPACE = np.array([chr(b).isspace() for b in range(128)] + [False] * 128)
_WORDS = re.compile(r"[^\W\d_]+")
_SINGLE = {ord(k): v[0] for k, v in LEET.items()}
_PLAIN_ENDS = ".,;:?!\"'`)]}>&%#-_~/\\"  # what may follow a word without being a substitution
_TWICE = re.compile(r"(.)\1+")
_GAP = re.compile(r"[\W\d_]+")


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N**3, dtype=np.int64)
    for _, texts in tc.slices(batches):
        code = np.frombuffer(("  ".join(["", *texts, ""])).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = CLASS[np.minimum(code, 0xFFFF)].astype(np.int32)
        total += np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=N**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """-log P(c | a, b) for all classes, interpolated with shorter contexts."""
    got = tc.ids_texts(docs).mapInArrow(_trigrams, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    tri = np.zeros(N**3)
    tri[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    tri = tri.reshape(N, N, N)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * N)
    p2 = (bi + 2 * p1[None, :]) / (bi.sum(1, keepdims=True) + 2)
    p3 = (tri + 4 * p2[None]) / (tri.sum(2, keepdims=True) + 4)
    return -np.log(p3).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORDS.findall((text or "").lower()))
            counts[toxic].update({w + " " for w in words} | {w[:k] for w in words for k in range(5, 9) if len(w) > k})
    for toxic, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["feature", "toxic", "n"])


def fit_lexicon(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> dict[str, float]:
    """Words (with a space after them) and word beginnings with their smoothed share of toxic documents."""
    lab = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    some = tc.checkpointed(lab.orderBy(F.xxhash64("_id"), "_id").limit(bound))
    mine = tc.ids_texts(docs).join(F.broadcast(some), F.col("doc_id") == F.col("_id")).groupBy("text").agg(F.max("_toxic").alias("toxic"))
    mine = tc.checkpointed(mine)
    least = max(LEAST_DOCS, math.ceil(LEAST_PART * mine.where("toxic = 1").count()))
    n = mine.mapInArrow(_features, "feature string, toxic int, n bigint").groupBy("feature").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("bad"), F.sum("n").alias("n"))
    kept = n.where((F.col("bad") >= least) & (F.col("bad") / (F.col("n") + 0.4) >= LEAST_SHARE)).collect()
    share = {r["feature"]: (r["bad"] + 0.5) / (r["n"] + 1) for r in kept}
    return {f: s for f, s in share.items() if not any(f[:k] in share for k in range(5, len(f)))}


class Decoder:
    """Viterbi over lattices of readings; the state is the last two classes that were written."""

    def __init__(self, model: np.ndarray):
        self.cost = model.tolist()
        self.memo: dict[str, str] = {}

    def _readings(self, s: str) -> list[list[tuple[str, float]]]:
        out = []
        for i, c in enumerate(s):
            own: list[tuple[str, float]] = []
            if c == " ":
                own = [("", 0.5), (" ", 1.5)]
            elif c.isalpha():
                own = [(c, 0.0)]
                if i and s[i - 1] == c:
                    own.append(("", 0.3 if i > 1 and s[i - 2] == c or i + 1 < len(s) and s[i + 1] == c else DOUBLED))
            else:
                own = [(x, 0.7) for x in LEET.get(c, "")]
                if c == "*":
                    own += [(x, 1.6) for x in "aeiou"]
                if i and s[i - 1] == c and own:
                    own.append(("", 0.5))
                own.append((c, 2.0) if c.isdigit() else (" ", 3.0))
                if c in "*._-~":
                    own.append(("", 0.7))
            out.append(own)
        return out

    def decode(self, s: str) -> str:
        if (got := self.memo.get(s)) is not None:
            return got
        cost, cls = self.cost, lambda c: int(CLASS[min(ord(c), 0xFFFF)])
        now: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for own in self._readings(s):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, back) in now.items():
                row = cost[a][b]
                for c, channel in own:
                    if c:
                        k = cls(c)
                        state, x, link = (b, k), so_far + channel + row[k], (c, back)
                    else:
                        state, x, link = (a, b), so_far + channel + 0.2, back
                    if state not in new or x < new[state][0]:
                        new[state] = (x, link)
            now = new
        (_, link) = min(((x + cost[a][b][0], link) for (a, b), (x, link) in now.items()), key=lambda z: z[0])
        out = []
        while link:
            out.append(link[0])
            link = link[1]
        got = "".join(reversed(out))
        if len(self.memo) < 200_000:
            self.memo[s] = got
        return got


def _suspicious(texts: list[str]) -> np.ndarray:
    """Which texts can hold an obfuscated token: a vectorised necessary condition of what `segments` looks for."""
    enc = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"  ".join([*enc, b""]) + b"  ", dtype=np.uint8)
    letter, space = _IS_LETTER[b], _SPACE[b]
    hit = np.zeros(len(b), dtype=bool)
    hit[:-1] = _IS_LEET[b[:-1]] & letter[1:]
    hit[1:-1] |= letter[:-2] & _IS_INNER[b[1:-1]]
    hit[:-2] |= letter[:-2] & (b[:-2] == b[1:-1]) & (b[1:-1] == b[2:])
    wide = b >= 128  # letters of two bytes, three times over
    hit[:-5] |= wide[:-5] & (b[:-5] == b[2:-3]) & (b[2:-3] == b[4:-1])
    lone = np.zeros(len(b), dtype=bool)
    lone[1:-1] = space[:-2] & ~space[1:-1] & ~letter[2:]
    lone[1:-2] |= space[:-3] & wide[1:-2] & wide[2:-1] & ~letter[3:]
    first = np.concatenate([[0], np.cumsum([len(e) + 2 for e in enc])])
    n = np.concatenate([[0], np.cumsum(hit)])
    m = np.concatenate([[0], np.cumsum(lone)])
    return (n[first[1:]] > n[first[:-1]]) | (m[first[1:]] - m[first[:-1]] >= 3)


def segments(text: str) -> list[str]:
    """The stretches of a lower-case text that have more than one reading."""
    out, run = [], []
    for token in [*text.split(), "  "]:
        bare = token.rstrip(_PLAIN_ENDS) if len(token) > 1 else token
        if len(bare) == 1:
            run.append(bare)
            if bare == token:
                continue
            token = ""
        if len(run) >= 3:
            out.append(" ".join(run))
        run = []
        if token and _SUSPECT.search(token):
            out.append(_EDGE.sub("", token))
    return out


_BONE = np.array([b if b >= 128 or chr(b).isalpha() or b == 10 else ord(_SINGLE[b]) if b in _SINGLE else 0 for b in range(256)], dtype=np.uint8)


class Skeletons:
    """Finds tokens, whole or in pieces, whose skeleton begins like that of a lexicon word or five-letter beginning."""

    def __init__(self, lexicon: dict[str, float]):
        self.auto, self.wide = ahocorasick.Automaton(), ahocorasick.Automaton()
        for f in lexicon:
            word = f.strip()
            if len(word) >= 4 and not _TWICE.search(word) and (f.endswith(" ") or len(f) == 5):
                self.auto.add_word(word, (len(word), f.endswith(" ")))
                self.wide.add_word(word.encode().decode("latin-1"), 1)
        self.some = len(self.auto) > 0
        if self.some:
            self.auto.make_automaton()
            self.wide.make_automaton()

    def texts(self, texts: list[str]) -> set[int]:
        """Which texts, without what is no letter and with runs as one letter, have any entry."""
        if not self.some:
            return set()
        enc = [t.lower().replace("\n", " ").encode("utf-8", "surrogatepass") for t in texts]
        m = _BONE[np.frombuffer(b"\n".join([*enc, b""]), dtype=np.uint8)]
        at = np.flatnonzero(m)
        m = m[at]
        once = np.ones(len(m), dtype=bool)
        once[1:] = m[1:] != m[:-1]
        at = at[once]
        ends = [e for e, _ in self.wide.iter(m[once].tobytes().decode("latin-1"))]
        first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in enc])])
        return set((np.searchsorted(first, at[ends], side="right") - 1).tolist()) if ends else set()

    def tokens(self, low: str) -> list[str]:
        """The tokens of a text, or runs of tokens that make one word, to decode."""
        words = [w for t in low.split() if (w := t.rstrip(_PLAIN_ENDS).lstrip(_PLAIN_ENDS + "("))]
        bare = [skeleton(w).strip() for w in words]
        out = []
        for i, b in enumerate(bare):
            whole, k = b, i
            while True:
                if k > i or words[i] != b:
                    for end, (n, full) in self.auto.iter(_TWICE.sub(r"\1", whole)):
                        if end + 1 == n and (k == i or n > len(bare[i])) and (not full or n == len(_TWICE.sub(r"\1", whole))):
                            out.append(" ".join(words[i : k + 1]))
                k += 1
                # a word in pieces: two or three short ones, none of them with a space or sign of its own
                if k > i + 2 or k >= len(bare) or not 0 < len(whole) <= 6 or not bare[k] or " " in bare[k] or " " in whole:
                    break
                whole += bare[k]
        return out


def skeleton(text: str) -> str:
    """A lower-case text with substitutions undone one way and each run of a letter, or of what is none, as one."""
    return _TWICE.sub(r"\1", _GAP.sub(" ", text.translate(_SINGLE)))


def _restored_terms(decoded: str, words: dict[str, tuple[str, float]]) -> dict[str, float]:
    """Lexicon entries in a decoded segment whatever its doubled letters and, in letters spaced apart, its boundaries."""
    joined = _TWICE.sub(r"\1", decoded.replace(" ", ""))
    parts = {_TWICE.sub(r"\1", w) for w in decoded.split()}
    return dict(e for w, e in words.items() if w in parts or " " in decoded and len(w) >= 4 and w in joined or not e[0].endswith(" ") and any(x.startswith(w) for x in (*parts, joined)))


def _automaton(lexicon: dict[str, float]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for f, p in lexicon.items():
        auto.add_word(" " + f, (f, p))
    auto.make_automaton()
    return auto


def judge(model: np.ndarray, lexicon: dict[str, float]):
    """A function of texts to lists of scores, numbers of restored segments, and terms."""
    decoder, auto = Decoder(model), _automaton(lexicon) if lexicon else None
    bones = Skeletons(lexicon)
    words = {_TWICE.sub(r"\1", f.strip()): (f, p) for f, p in lexicon.items() if f.endswith(" ") or len(f) == 5 and not _TWICE.search(f)}

    def run(texts: list[str]) -> tuple[list[float], list[int], list[str]]:
        odd, near = _suspicious(texts), bones.texts(texts)
        score, restored, terms = [], [], []
        for i, t in enumerate(texts):
            low, n, extra = t.lower(), 0, []
            cuts = dict.fromkeys(segments(low) if odd[i] else (), True)
            if i in near:
                cuts |= {b: cuts.get(b, False) for b in bones.tokens(low)}
            for s, loose in cuts.items():
                d = decoder.decode(s)
                if d != s:
                    n += 1
                    extra.append((d, loose))
            found = {}
            if auto is not None:
                found = dict(x for _, x in auto.iter(f" {_GAP.sub(' ', low)} {_GAP.sub(' ', '  '.join(d for d, _ in extra))} "))
                for d, loose in extra:
                    if loose:
                        found |= _restored_terms(d, words)
            score.append(1 - math.prod(1 - p for p in found.values()) if found else 0.0)
            restored.append(n)
            terms.append(",".join(sorted(f.strip() for f in found)))
        return score, restored, terms

    return run


def _score(model: np.ndarray, lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = judge(model, lexicon)
        for part, texts in tc.slices(batches):
            score, restored, terms = scores(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(restored, pa.int64()), pa.array(terms, pa.string())], names=["doc_id", "score", "n_restored", "terms"])

    return run


def scored(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, score, n_restored, terms) of every document."""
    model, lexicon = language_model(docs), fit_lexicon(docs, labels, bound)
    return tc.ids_texts(docs).mapInArrow(_score(model, lexicon), "doc_id bigint, score double, n_restored bigint, terms string")


def toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `scored` that are toxic."""
    return scored(docs, labels).where(F.col("score") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text is toxic, in one pass that moves no row."""
    model, lexicon = language_model(docs), fit_lexicon(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = judge(model, lexicon)
        for part, texts in tc.slices(batches):
            yield part.filter(pa.array([s < threshold for s in scores(texts)[0]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
