"""Personal data by a skip-chain conditional random field (operator 2).

The variables are a document's tokens: runs of letters, digits and what an entity may hold (. + @ - _), or digits in
parentheses, so that quotes, colons, commas, slashes and equals signs part an entity from what is stuck to it.  The labels are
O, EMAIL, PHONE, IP and CARD; an entity of several tokens (a card in groups of four, a phone number with spaces) has one label
on all, and neighbours of that label whose digits form one run are one entity.  Unary potentials come from the shapes of a token
and its neighbours and from the run of digits that it is part of.  Neighbouring tokens share a chain potential; tokens far
apart share a skip potential if they are repeated (the same in lower case) or similar (the same seven or more digits, or
e-mail addresses with the same name).  Each occurrence is linked to the one before it, so a thousand repeats make a thousand
links.  Ten bare digits are a phone number or an order number: only a link to the same digits written as a phone number
tells.  Sum-product message passing, damped, runs on the loopy graph until a document's own messages settle, so what is found
in a document depends on nothing but its text.

Tokens without a digit or an at sign, and not within two of one that has them, are O with certainty: no feature but the bias
speaks for another label.  So the graph holds only the rest, which changes no result and leaves most documents with none.

The weights are trained here, by pseudo-likelihood (a token's label given its features and its neighbours' labels) on
documents that `examples` writes: no labelled table of personal data exists.  `tests/llm` measures held-out accuracy.

Left out: names and postal addresses, e-mail addresses within letters of a script without spaces, IPv6.

Defined cases: null and empty texts have no findings; a null doc_id is kept; rows alike give their findings once; of labels
that tie the first in ``LABELS`` counts; an empty table gives an empty result; texts of any length are read whole; only doc_id
and text are read, so extra columns, whatever their names, don't matter.  Positions are in characters.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from modelgauge.llm import textcore as tc

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD")
ROUNDS, DAMPING, SETTLED = 30, 0.3, 1e-4
_TOKEN = re.compile(r"\(\+?\d{1,4}\)|[\w+@][\w.+@-]*")
_LINKED = re.compile(r"[ .-]?$")  # what parts the groups of one run of digits
_CARD_RUN, _PHONE_RUN = re.compile(r"4-4-4-[1-7]$|4-6-[45]$"), re.compile(r"(?:[1-3]-)?3-3-4$|(?:[1-3]-)?3-7$|3-4-4$")
_EMAIL = re.compile(r"[\w.+-]*\w@\w[\w-]*(?:\.[\w-]+)+$")
_QUAD = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}$")
_OPEN = re.compile(r"\+\d{1,3}$|\(\d+\)$")  # what a phone number can't end with
_HOT = re.compile(r"[0-9@]")
SHAPES = ("bias", "at", "email", "quad", "octets", "luhn", "digits13", "digits16", "only_digits", "plus", "area", "local7", "digits7", "digits1to4", "hex", "letters", "dots", "hyphen", "long_hex", "quote", "slash", "local10", "bare10")
RUNS = ("run_card", "run_luhn", "run_phone")


def luhn(d: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


@functools.lru_cache(maxsize=1 << 16)
def shape(token: str) -> tuple[int, ...]:
    """Numbers of the shapes that a bare token has."""
    digits = re.sub(r"[^0-9]", "", token)
    plain = re.sub(r"[-. ]", "", token)
    card = plain.isdigit() and 13 <= len(plain) <= 19
    quad = bool(_QUAD.match(token))
    yes = {
        "bias": True,
        "at": "@" in token,
        "email": bool(_EMAIL.match(token)),
        "quad": quad,
        "octets": quad and all(int(x) < 256 for x in token.split(".")),
        "luhn": card and luhn(plain),
        "digits13": card,
        "digits16": card and len(plain) == 16,
        "only_digits": token.isdigit(),
        "plus": bool(re.match(r"\+\d{1,3}$", token)),
        "area": bool(re.match(r"\(0?\d{2,4}\)$", token)),
        "local7": bool(re.match(r"\d{3,4}[-.]\d{4}$", token)),
        "local10": bool(re.match(r"(?:\+?\d{1,3}[-.]?)?(?:\(\d{3}\)|\d{3})[-.]?\d{3}[-.]\d{4}$", token)),
        "digits7": 7 <= len(digits) < 13,
        "digits1to4": 1 <= len(digits) < 5,
        "hex": bool(re.match(r"[0-9a-fA-F]+$", token)) and not token.isdigit(),
        "letters": any(c.isalpha() for c in token),
        "dots": "." in token,
        "hyphen": "-" in token,
        "long_hex": len(token) > 20 and bool(re.match(r"[0-9a-fA-F]+$", token)) and not token.isdigit(),
        "quote": '"' in token,
        "slash": "/" in token,
        "bare10": token.isdigit() and len(token) == 10,
    }
    return tuple(i for i, k in enumerate(SHAPES) if yes[k])


S = len(SHAPES)
F_ALL = 3 * S + len(RUNS)  # a token's own shapes, then those of the tokens before and after, then those of its run


def digit_runs(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, tuple[int, ...]]]:
    """For each token the number of its run of digit groups (-1 without) and the numbers of the shapes that the run has."""
    out: list[tuple[int, tuple[int, ...]]] = [(-1, ())] * len(spans)
    k = 0
    while k < len(spans):
        e = k
        while e < len(spans) and spans[e][2].isdigit() and len(spans[e][2]) <= 7 and (e == k or _LINKED.match(text, spans[e - 1][1], spans[e][0])):
            e += 1
        if e - k > 1:
            groups, digits = "-".join(str(len(x[2])) for x in spans[k:e]), "".join(x[2] for x in spans[k:e])
            card = bool(_CARD_RUN.match(groups)) and 13 <= len(digits) <= 19
            yes = (card, card and luhn(digits), bool(_PHONE_RUN.match(groups)))
            for i in range(k, e):
                out[i] = (k, tuple(3 * S + i for i, y in enumerate(yes) if y))
        k = max(e, k + 1)
    return out


class Graph:
    """Tokens of documents that are not O with certainty, their features, chain links and skip links."""

    def __init__(self, texts: list[str]):
        self.doc, self.begin, self.end, self.text, self.run, feats = [], [], [], [], [], []
        chain, skip = [], []
        for d, text in enumerate(texts):
            if not _HOT.search(text):
                continue
            spans = []
            for m in _TOKEN.finditer(text):
                bare = m.group().rstrip(".-+_") or m.group()
                spans.append((m.start(), m.start() + len(bare), bare))
            runs = digit_runs(text, spans)
            near = sorted({j for i, x in enumerate(spans) if _HOT.search(x[2]) for j in range(max(0, i - 2), min(len(spans), i + 3))})
            last: dict[str, int] = {}
            before = -9
            for j in near:
                b, e, t = spans[j]
                k = len(self.doc)
                self.doc.append(d), self.begin.append(b), self.end.append(e), self.text.append(t), self.run.append((d, runs[j][0]) if runs[j][0] >= 0 else None)
                feats.append([*runs[j][1], *shape(t), *(S + x for x in (shape(spans[j - 1][2]) if j else ())), *(2 * S + x for x in (shape(spans[j + 1][2]) if j + 1 < len(spans) else ()))])
                if before == j - 1:
                    chain.append((k - 1, k))
                before = j
                if _HOT.search(t):
                    low, digits = t.lower(), re.sub(r"[^0-9]", "", t)
                    keys = {"=" + low}
                    if len(digits) >= 7:
                        keys.add("#" + digits)
                    if "@" in low:
                        keys.add("@" + low.split("@")[0])
                    for other in {last[x] for x in keys if x in last}:
                        if (other, k) not in chain[-1:]:
                            skip.append((other, k))
                    last |= dict.fromkeys(keys, k)
        self.n = len(self.doc)
        self.row = np.repeat(np.arange(self.n), [len(f) for f in feats])
        self.feature = np.fromiter((x for f in feats for x in f), dtype=np.int64)
        self.chain = np.array(chain, dtype=np.int64).reshape(-1, 2)
        self.skip = np.array(skip, dtype=np.int64).reshape(-1, 2)

    def unary(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, len(LABELS)))
        np.add.at(out, self.row, w[self.feature])
        return out


class Model:
    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product in logarithms: a message for each direction of each link."""
        u = g.unary(self.unary)
        links = np.concatenate([g.chain, g.chain[:, ::-1], g.skip, g.skip[:, ::-1]])
        if len(links):
            c, s = len(g.chain), len(g.skip)
            pot = np.concatenate([np.repeat(x[None], k, 0) for x, k in ((self.chain, c), (self.chain.T, c), (self.skip, s), (self.skip.T, s))])
            back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
            m = np.zeros((len(links), len(LABELS)))
            doc = np.array(g.doc, dtype=np.int64)[links[:, 0]]
            live = np.ones(doc.max() + 1, dtype=bool)
            for _ in range(ROUNDS):
                belief = u.copy()
                np.add.at(belief, links[:, 1], m)
                x = (belief[links[:, 0]] - m[back])[:, :, None] + pot
                top = x.max(1)
                new = np.log(np.exp(x - top[:, None]).sum(1)) + top
                new -= new.max(1, keepdims=True)
                on = live[doc]
                moved = np.zeros(len(live))
                np.maximum.at(moved, doc[on], np.abs(new - m)[on].max(1))
                m[on] = ((1 - DAMPING) * new + DAMPING * m)[on]
                live &= moved >= SETTLED
                if not live.any():
                    break
            np.add.at(u, links[:, 1], m)
        p = np.exp(u - u.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def examples(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Documents with their entities (begin, end, label): a stand-in for a labelled table."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[r.integers(len(x))]
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(pick("an", "er", "tion", "qu", "la", "el", "st", "mo", "ver", "ch") for _ in range(r.integers(1, 5)))

    def card() -> str:
        d = pick("4", "5", "37", "6011") + num(11)
        d = d[:15]
        return next(d + c for c in "0123456789" if luhn(d + c)) if r.random() < 0.6 else d + num(1)

    def groups(c: str) -> str:
        return " ".join((c[:4], c[4:10], c[10:])) if len(c) == 15 else " ".join(c[i : i + 4] for i in range(0, len(c), 4))

    kinds = {
        "EMAIL": lambda: f"{word()}{pick('.', '_', '')}{pick(num(2), word())}@{word()}{pick(num(1), '')}.{pick('example.com', 'org', 'net', 'co.uk', 'de')}",
        "PHONE": lambda: pick(lambda: f"+{pick('1', '44', '49')} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"+1-{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)} {num(3)} {num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}")(),
        "IP": lambda: ".".join(str(x) for x in r.integers(1, 256, 4)),
        "CARD": lambda: pick(lambda c: c, lambda c: c, lambda c: "-".join(c[i : i + 4] for i in range(0, len(c), 4)), groups)(card()),
    }
    other = (lambda: num(4), lambda: f'"{r.bytes(20).hex()}"', lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(2)}.{num(1)}", lambda: num(2) + "%", lambda: f"{word()}{num(2)}", lambda: "@", lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: num(9), lambda: f"@{word()}", lambda: f"{num(3)}.{num(3)}.999.{num(3)}", lambda: num(1), lambda: num(10), lambda: num(10), lambda: f"{num(4)} {num(4)}", lambda: f"{num(3)} {num(2)}")
    texts, gold = [], []
    for _ in range(n):
        text, own, seen, again = "", [], [], []
        for _ in range(r.integers(12, 40)):
            x, kind = r.random(), "O"
            if again and x < 0.5:
                kind, s = "PHONE", again.pop()  # the same number as ten bare digits
            elif x < 0.16:
                kind, s = seen[r.integers(len(seen))] if seen and r.random() < 0.3 else (k := pick(*kinds), kinds[k]())
                seen.append((kind, s))
                if kind == "PHONE" and re.fullmatch(r"\d{3}[-.]\d{3}[-.]\d{4}", s) and r.random() < 0.7:
                    again.append(re.sub(r"\D", "", s))
            else:
                s = pick(*other)() if x < 0.3 else word()
            if r.random() < 0.1:
                s = s.upper()
            text += pick(" ", " ", " ", "\n") if text else ""
            text += pick("", "", "", "", '"', "mailto:", "k=", "(", "<", "x,") if kind != "O" and not s[0] in "+(" else ""
            if kind != "O":
                own.append((len(text), len(text) + len(s), kind))
            text += s + (pick("", "", "", ".", ",", "!!", "###", '"', ":80 ", ")") if kind != "O" else pick("", "", "", ".", ",", "!!", "###"))
        texts.append(text)
        gold.append(own)
    return texts, gold


@functools.lru_cache(maxsize=1)
def train(n: int = 400, seed: int = 5, steps: int = 400, rate: float = 0.5) -> Model:
    """Pseudo-likelihood by Adagrad: chain and skip weights are those of the neighbours' labels."""
    texts, gold = examples(n, seed)
    g, k = Graph(texts), len(LABELS)
    y = np.zeros(g.n, dtype=np.int64)
    for i in range(g.n):
        for b, e, kind in gold[g.doc[i]]:
            if b <= g.begin[i] < e:
                y[i] = LABELS.index(kind)
    w, chain, skip = np.zeros((F_ALL, k)), np.zeros((k, k)), np.zeros((k, k))
    acc = [np.full_like(x, 1e-6) for x in (w, chain, skip)]
    hot = np.eye(k)[y]
    for _ in range(steps):
        z = g.unary(w)
        for a, links in ((chain, g.chain), (skip, g.skip)):
            np.add.at(z, links[:, 1], a[y[links[:, 0]]])
            np.add.at(z, links[:, 0], a.T[y[links[:, 1]]])
        p = np.exp(z - z.max(1, keepdims=True))
        err = p / p.sum(1, keepdims=True) - hot
        gw = np.zeros_like(w)
        np.add.at(gw, g.feature, err[g.row])
        grads = [gw / g.n + 1e-4 * w]
        for a, links in ((chain, g.chain), (skip, g.skip)):
            grad = np.zeros_like(a)
            np.add.at(grad, y[links[:, 0]], err[links[:, 1]])
            np.add.at(grad.T, y[links[:, 1]], err[links[:, 0]])
            grads.append(grad / g.n + 1e-4 * a)
        for x, grad, s in zip((w, chain, skip), grads, acc):
            s += grad**2
            x -= rate * grad / np.sqrt(s)
    return Model(w, chain, (skip + skip.T) / 2)


def entities(model: Model, texts: list[str], threshold: float = 0.5) -> list[tuple[int, str, int, int, float]]:
    """(text number, label, begin, end, probability); neighbouring tokens of one number are one entity."""
    g = Graph(texts)
    if not g.n:
        return []
    p = model.marginals(g)
    best = p.argmax(1)
    joined = {int(b): int(a) for a, b in g.chain}
    out: list[list] = []
    at: dict[int, int] = {}
    for i in np.flatnonzero((best > 0) & (p.max(1) >= threshold)):
        i = int(i)
        label = LABELS[best[i]]
        j = joined.get(i)
        if j in at and out[at[j]][1] == label and (g.run[i] is not None and g.run[i] == g.run[j] or label == "PHONE" and _OPEN.match(g.text[j])):
            out[at[j]][3], out[at[j]][4] = g.end[i], min(out[at[j]][4], float(p[i].max()))
            at[i] = at[j]
        else:
            at[i] = len(out)
            out.append([g.doc[i], label, g.begin[i], g.end[i], float(p[i].max())])
    return [tuple(x) for x in out]


def _find(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tc.slices(batches):
            got = entities(model, texts)
            cols = list(zip(*got)) or [()] * 5
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(np.round(np.array(cols[4], dtype=np.float64), 6))], names=["doc_id", "label", "begin_char", "end_char", "probability"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, label, begin_char, end_char, probability) of each entity."""
    return tc.ids_texts(docs).mapInArrow(_find(train()), "doc_id bigint, label string, begin_char bigint, end_char bigint, probability double").distinct()
