"""The ten operators against brute force, planted cases and odd inputs."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from modelgauge.llm import decontamination, host_rules, license_rules, line_dedup, packing, pii_crf, secret_ledger, simhash_forest, substring_dedup, toxicity
from modelgauge.llm import textcore as tc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, line int, sig string, bin_id string, blob string"
LABELS = "doc_id bigint, quality int, toxic int"
WORDS = [a + b + c for a in ("an", "er", "st", "mo", "qu") for b in ("ti", "la", "ve", "on") for c in ("ng", "ed", "s", "ro", "x")]


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those that operators make."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"src{k % 3}", None if t is None else len(t), 1, "s", "b", "x") for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD = [None, "", " \n ", "a", "token", "ñ é ß", "x" * 70_000, "word " * 20_000, "same text here", "same text here"]
ODD_IDS = [0, 1, 2, 3, 4, 5, 6, 7, None, 8]


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)


def runs(spark):
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (None, "x y z w")], "item_id bigint, text string")
    return {
        "toxicity": lambda d: toxicity.toxic(d, labels(spark, [(0, 1, 0), (None, 1, 1)])),
        "pii": pii_crf.personal_data,
        "suffix": substring_dedup.repeated_spans,
        "decontamination": lambda d: decontamination.contaminated(d, bench),
        "lines": line_dedup.duplicate_lines,
        "line_texts": line_dedup.deduplicated,
        "licenses": license_rules.licenses,
        "simhash": simhash_forest.near_duplicates,
        "one_of_each": simhash_forest.one_of_each_group,
        "hosts": host_rules.judged,
        "secrets": lambda d: secret_ledger.by_path(d, secret_ledger.scan(d, secret_ledger.empty_ledger(spark))[0]),
        "packing": packing.packed,
    }


@pytest.mark.parametrize("name", ["toxicity", "pii", "suffix", "decontamination", "lines", "line_texts", "licenses", "simhash", "one_of_each", "hosts", "secrets", "packing"])
def test_odd_and_empty_tables(spark, name):
    f = runs(spark)[name]
    assert f(frame(spark, [], [])).count() == 0
    n = f(frame(spark, ODD, ODD_IDS)).count()
    assert n == {"hosts": 10, "line_texts": 10, "one_of_each": 10, "packing": 8, "lines": 1}.get(name, 0) or name == "packing" and n >= 8


def test_simhash_forest_against_all_pairs(spark):
    r = random.Random(1)
    texts = []
    for _ in range(60):
        base = prose(r, 120).split()
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = list(base)
            for _ in range(r.randrange(6)):
                copy[r.randrange(120)] = r.choice(WORDS)
            texts.append(" ".join(copy))
    docs = frame(spark, texts)
    sigs = sorted((x["doc_id"], bytes(x["sig"])) for x in simhash_forest.signatures(docs).collect())
    bits = np.array([np.unpackbits(np.frombuffer(s, dtype=np.uint8)) for _, s in sigs])
    pairs = {(i, j) for i in range(len(bits)) for j in range(i) if (bits[i] != bits[j]).sum() <= simhash_forest.DISTANCE}
    got = {x["doc_id"]: x["group_id"] for x in simhash_forest.near_duplicates(docs).collect()}
    hit = sum(got.get(i, -1) == got.get(j, -2) for i, j in pairs)
    assert pairs and hit >= 0.95 * len(pairs)
    near = {i for p in pairs for i in p}
    assert set(got) <= near


def test_forest_adapts_to_density_and_climbs():
    r = np.random.default_rng(4)
    loose = r.integers(0, 1 << 63, (3000, 4)).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, (3000, 4)).astype(np.uint64)
    flips = np.packbits(r.random((3000, 256)) < 0.02, axis=1).view(np.uint64)
    sigs = np.concatenate([loose, loose[:1] ^ flips])  # 3000 far apart, 3000 within some 10 bits
    label = simhash_forest.labels(sigs)
    counts = np.stack([np.bincount(label[:, t], minlength=1 << simhash_forest.DEEP) for t in range(simhash_forest.TRIES)])
    dense = simhash_forest.density(counts)
    assert (dense[:, 1] == 6000).all()
    leaf = simhash_forest.leaves(label, dense, 64)
    assert leaf[3001:].mean() > leaf[:3000].mean() + 3
    up = simhash_forest.climbed(leaf, simhash_forest.DISTANCE, simhash_forest.RECALL)
    assert (up <= leaf).all()

    def recall(depth):
        return 1 - np.prod(1 - np.array([simhash_forest.shared(d, simhash_forest.DISTANCE) for d in range(simhash_forest.DEEP + 1)])[depth], axis=1)

    short = recall(leaf) < simhash_forest.RECALL
    assert short[3001:].mean() > 0.8 and ((up < leaf).any(1) == short).all() and (recall(up) >= simhash_forest.RECALL - 1e-6).all()


@pytest.mark.parametrize(("node", "hot"), [(4, 1 << 15), (4, 16), (64, 8)])
def test_forest_on_dense_and_sparse_corpora(spark, node, hot):
    """Groups by the forest against all pairs, with nodes cut deeply, climbing, and hot nodes in pairs of blocks."""
    r = random.Random(21)
    base = prose(r, 100).split()
    texts = [prose(r, 100) for _ in range(60)]
    for _ in range(60):
        copy = list(base)
        for k in r.sample(range(100), r.choice([2, 4, 8])):
            copy[k] = f"odd{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [{*w, *zip(w, w[1:])} for w in map(str.split, texts)]
    want = {(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    got = {x["doc_id"]: x["group_id"] for x in simhash_forest.near_duplicates(frame(spark, texts), node=node, hot=hot, small=0).collect()}
    assert len(want) > 500 and sum(got.get(i, -1) == got.get(j, -2) for i, j in want) >= 0.97 * len(want)
    assert set(got) <= {i for p in want for i in p}


def test_simhash_groups_against_exact_jaccard(spark):
    r = random.Random(11)
    texts = []
    for _ in range(60):
        base = prose(r, 150).split()
        copy = list(base)
        for k in r.sample(range(150), r.choice([8, 12, 16, 20, 60])):
            copy[k] = "new" + str(r.randrange(10**6))
        texts += [" ".join(base), " ".join(copy)]
    sets = [{*w, *zip(w, w[1:])} for w in map(str.split, texts)]
    near = {(i, i + 1) for i in range(0, 120, 2) if len(sets[i] & sets[i + 1]) >= 0.7 * len(sets[i] | sets[i + 1])}
    got = {}
    for x in simhash_forest.near_duplicates(frame(spark, texts)).collect():
        got.setdefault(x["group_id"], set()).add(x["doc_id"])
    found = {tuple(sorted(g)) for g in got.values()}
    assert 20 < len(near) < 60
    assert found <= near and len(found) >= 0.9 * len(near)


def test_line_dedup_against_all_pairs(spark):
    r = random.Random(2)
    base = [prose(r, 12) for _ in range(12)]
    texts = []
    for _ in range(30):
        lines = [r.choice(base) for _ in range(3)] + [prose(r, 2)]
        texts.append("\n".join(x[:-1] + r.choice("abc") if r.random() < 0.5 else x.upper() for x in lines) + "\n\n")
    occ = [(i, k, line_dedup.normal(x)) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x.strip()]
    names = sorted({n for *_, n in occ})
    sets = {n: line_dedup.shingle_set(n.encode()) for n in names}
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in names:
        for b in names:
            if a < b and sets[a] and sets[b] and line_dedup.jaccard(sets[a], sets[b]) >= line_dedup.SIMILARITY:
                root[find(a)] = find(b)
    first, want = {}, set()
    for i, k, n in sorted(occ):
        if (f := find(n)) in first:
            want.add((i, k))
        else:
            first[f] = (i, k)
    docs = frame(spark, texts)
    got = {(x["doc_id"], x["line_no"]) for x in line_dedup.duplicate_lines(docs).collect()}
    assert len(want ^ got) <= 0.02 * len(want)
    left = {x["doc_id"]: x["text"] for x in line_dedup.deduplicated(docs).collect()}
    for i, t in enumerate(texts):
        assert left[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got)


def test_lines_of_many_texts_at_once_are_those_of_each_line():
    r = random.Random(5)
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    chars = spaces + ["\n"] * 20 + [" ", "  "] * 5 + list("aBcΣσςİıßÉ’—\u200b\u1681中\U0001f600\ud800")
    for _ in range(600):
        texts = ["".join(r.choice(chars) for _ in range(r.randrange(40))) for _ in range(r.randrange(5))]
        want = [(i, k, n.encode("utf-8", "surrogatepass")) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if (n := line_dedup.normal(x))]
        x = line_dedup.Lines(texts)
        assert list(zip(x.text, x.no, x.norms(np.arange(len(x.no))))) == want
        assert x.hash.tolist() == line_dedup.Joined.of([n for *_, n in want]).hash.tolist()


@pytest.mark.parametrize("most", [1, 3, 1 << 16])
def test_places_of_lines_come_back_whole_however_they_are_packed(most):
    texts = ["a\n\nb\n c\nd\na", "", None, "\n \n", "a", "e\n" * 7]
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, None, None, 6], "text": texts, "text_hash": [10, 20, 30, 40, 50, 60]})
    rows = pa.Table.from_batches(list(line_dedup._places(np.full(1 << 5, (1 << 64) - 1, np.uint64), most)(iter([docs]))))
    packed = rows.filter(rows["norm"].is_null()).select(["doc_id", "text_hash", "nos", "lines"])
    assert most > 3 or packed.num_rows == sum(-(-n // most) for n in (5, 1, 7))
    norm = dict(zip(rows["line"].to_pylist(), rows["norm"].to_pylist()))
    got = [x for b in line_dedup._occurrences(iter(packed.to_batches())) for x in zip(*(c.to_pylist() for c in b.columns))]
    want = [(1, 10, k, n) for k, n in ((0, b"a"), (2, b"b"), (3, b"c"), (4, b"d"), (5, b"a"))] + [(None, 50, 0, b"a")] + [(6, 60, k, b"e") for k in range(7)]
    assert [(d, t, k, norm[h]) for d, t, k, h in got] == want


def test_line_dedup_reads_the_texts_twice(spark, monkeypatch, tmp_path):
    frame(spark, ["one line of some length\nand another one", "one line of some length\nand yet another"]).write.parquet(str(tmp_path / "in"))
    reads, keep = [], tc.checkpointed
    monkeypatch.setattr(tc, "checkpointed", lambda df: reads.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")) or keep(df))
    df = line_dedup.duplicate_lines(spark.read.parquet(str(tmp_path / "in")))
    assert sum(reads) + df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    assert df.count() == 1


@pytest.mark.parametrize("flush_at", [1 << 20, 200])
def test_repeated_spans_against_all_windows(spark, flush_at):
    r = random.Random(3)
    passages = [prose(r, n) for n in (47, 48, 52, 150, 420)]
    texts = [prose(r, 40) + " " + r.choice(passages) + " " + prose(r, 30) for _ in range(24)] + [prose(r, 60)] * 2 + ["ha " * 300, "ha " * 90]
    w = [tc.Words([t]).hash.tolist() for t in texts]
    n = substring_dedup.WORDS
    seen: dict[tuple, set] = {}
    for d, x in enumerate(w):
        for i in range(len(x) - n + 1):
            seen.setdefault(tuple(x[i : i + n]), set()).add(d)
    want = set()
    for d, x in enumerate(w):
        for i in range(len(x) - n + 1):
            if len(seen[tuple(x[i : i + n])]) > 1:
                want |= {(d, k) for k in range(i, i + n)}
    got, spans = set(), substring_dedup.repeated_spans(frame(spark, texts), flush_at).collect()
    for x in spans:
        got |= {(x["doc_id"], k) for k in range(x["start_word"], x["end_word"])}
    assert want and got == want

    def elsewhere(d, i, m):
        return any(y[k : k + m] == w[d][i : i + m] for e, y in enumerate(w) if e != d for k in range(len(y) - m + 1))

    for x in spans:
        d, longest = x["doc_id"], n
        for i in np.flatnonzero(substring_dedup.sampled(substring_dedup.refined_buckets(np.array(w[d], dtype=np.uint64), 24))):
            if x["start_word"] <= i and i + n <= x["end_word"]:
                m = n
                while i + 2 * m <= len(w[d]) and elsewhere(d, i, 2 * m):
                    m *= 2
                longest = max(longest, m if elsewhere(d, i, m) else n)
        assert x["longest"] == longest
    assert {x["longest"] for x in spans} >= {48, 96}


def test_refined_buckets_are_equal_for_equal_words_only():
    a = np.arange(100, dtype=np.uint64)
    b = a.copy()
    b[70] = 5
    x, y = substring_dedup.refined_buckets(a, 48), substring_dedup.refined_buckets(b, 48)
    assert len(x) == 53 and (x[:23] == y[:23]).all() and not (x[23:] == y[23:]).any()


def test_decontamination_against_all_windows(spark):
    r = random.Random(4)
    items = [(i, prose(r, r.randrange(4, 30))) for i in range(12)] + [(12, "two words")]
    texts = []
    for k in range(40):
        item = items[k % 13][1].split()
        if k % 3 == 1:
            item[len(item) // 2] = "changed"
        texts.append(prose(r, 30) + " " + (" ".join(item) if k % 3 else "") + " " + prose(r, 20))
    n, want = decontamination.SHINGLE, set()

    def grams(t):
        x = t.split()
        return [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]

    for i, t in items:
        own, width = set(grams(t)), len(grams(t))
        for d, x in enumerate(texts):
            g = grams(x)
            best = max((len(own & set(g[s : s + width])) for s in range(len(g))), default=0)
            if own and best >= math.ceil(decontamination.CONTAINMENT * len(own) - 1e-9):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, texts)
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(docs, bench).collect()} == want
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(docs, bench, small=0).collect()} == want
    assert {x["doc_id"] for x in decontamination.clean(docs, bench).collect()} == set(range(40)) - {d for d, _ in want}


def test_decoder_restores_obfuscation(spark):
    r = random.Random(5)
    text = [prose(r, 60) + " stupid idiot clown loser worthless moron" for _ in range(40)]
    d = toxicity.Decoder(toxicity.language_model(frame(spark, text)))
    pairs = {"1d10t": "idiot", "m0r0n": "moron", "s t u p i d": "stupid", "i.d.i.o.t": "idiot", "stuuuupid": "stupid", "cl0wn": "clown", "l0$er": "loser", "st*pid": "stupid"}
    assert sum(d.decode(k) == v for k, v in pairs.items()) >= 7
    assert d.decode("anting") == "anting"


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    r = random.Random(6)
    bad = ["stupid", "moron", "scumbag"]
    texts = [prose(r, 50) for _ in range(80)] + [prose(r, 20) + f" {bad[k % 3]} " + prose(r, 20) for k in range(30)]
    hidden = [prose(r, 20) + x + prose(r, 20) for x in (" stup1d ", " m0r0n ", " s t u p i d ", " m.o.r.o.n ", " scuuuumbag ", " STUPID! ")]
    clean = [prose(r, 40) + x for x in (" 3d model", " a b c", " 100 percent", " version 2.0")]
    docs = frame(spark, texts + hidden + clean)
    lab = labels(spark, [(i, 1, int(i >= 80)) for i in range(110)])
    got = {x["doc_id"] for x in toxicity.toxic(docs, lab).collect()}
    assert got == set(range(80, 116))
    left = toxicity.without_toxic(docs, lab)
    assert left.columns == docs.columns and {x["doc_id"] for x in left.collect()} == set(range(80)) | set(range(116, 120))


CHANNEL = ["1diot", "id1ot", "idio7", "idio+.", "(m0r0n)", "mor0n!", "moroon", "mmoron", "moronn", "ssttuuppiidd", "stuuuupid", "mor on", "st upid,", "i d i o t.", "i d i o t", "i.d.i.o.t", "st*pid", "m o r o n, no", "l0$er", "lo$3r?"]


def test_each_channel_operation_at_each_place(spark):
    r = random.Random(15)
    model = toxicity.language_model(frame(spark, [prose(r, 60) + " stupid idiot clown loser worthless moron" for _ in range(60)]))
    judge = toxicity.judge(model, {f: 0.95 for f in ("stupi", "idiot ", "moron ", "clown ", "loser ")})
    for t in CHANNEL:
        assert judge(["anting erved " + t + " stlas quonro"])[0] == [0.95], t
        assert judge([t])[0] == [0.95], t
    assert judge(["great stuff! all 3d letters, a b c of 2024 on the moonn; mo ro st u", "", "idi otic erons"])[0][:2] == [0.0, 0.0]


def test_viterbi_is_the_best_of_all_readings():
    r = np.random.default_rng(5)
    model = r.random((toxicity.N,) * 3).astype(np.float32) * 6
    d = toxicity.Decoder(model)

    def cost(reading):
        a = b = 0
        total = 0.0
        for c, channel in reading:
            total += channel + (0.2 if not c else 0)
            if c:
                k = int(toxicity.CLASS[ord(c)])
                total += float(model[a, b, k])
                a, b = b, k
        return total + float(model[a, b, 0])

    for s in ("1d10t", "a$$", "m.o r", "st*pp1", "s t", "7+|"):
        every = list(itertools.product(*d._readings(s)))
        best = min(map(cost, every))
        got = [x for x in every if "".join(c for c, _ in x) == d.decode(s)]
        assert min(map(cost, got)) == pytest.approx(best, abs=1e-4)


def test_toxic_rows_go_whatever_their_id(spark):
    r = random.Random(16)
    texts = [prose(r, 30) for _ in range(30)] + [prose(r, 30) + " moron" for _ in range(20)] + ["what a m0r0n", "fine words", "fine words"]
    docs = frame(spark, texts, [*range(50), None, None, 3])
    left = toxicity.without_toxic(docs, labels(spark, [(i, 1, int(i >= 30)) for i in range(50)]))
    assert sorted((x["doc_id"] is None, x["doc_id"], x["text"]) for x in left.where("doc_id is not null").collect()) == sorted([(False, i, t) for i, t in enumerate(texts[:30])] + [(False, 3, "fine words")])
    assert [x["text"] for x in left.where("doc_id is null").collect()] == ["fine words"] and left.columns == docs.columns


def test_suspicion_is_necessary_for_segments():
    r = random.Random(7)
    texts = ["".join(r.choice("ab é1@$.* -\n") for _ in range(12)) for _ in range(3000)] + ["ñññ", "a b c", "é é é"]
    odd = toxicity._suspicious(texts)
    assert all(odd[i] for i, t in enumerate(texts) if toxicity.segments(t.lower()))


def test_crf_on_held_out_documents():
    model = pii_crf.train()
    texts, gold = pii_crf.examples(150, 77)
    want = {(d, k, b, e) for d, g in enumerate(gold) for b, e, k in g}
    got = {x[:4] for x in pii_crf.entities(model, texts)}
    assert len(want & got) >= 0.97 * len(want) and len(want & got) >= 0.97 * len(got)


HELD_OUT = [
    ("write to mailto:ann.lee@mail.example.org, please", [("EMAIL", "ann.lee@mail.example.org")]),
    ('{"email":"joe@x-y.net","ip":"10.20.30.40"}', [("EMAIL", "joe@x-y.net"), ("IP", "10.20.30.40")]),
    ("a@b.com,c@d.org;e.f@g.de", [("EMAIL", "a@b.com"), ("EMAIL", "c@d.org"), ("EMAIL", "e.f@g.de")]),
    ("server=192.168.7.21:8080 is down", [("IP", "192.168.7.21")]),
    ("pay with 4111 1111 1111 1111 today", [("CARD", "4111 1111 1111 1111")]),
    ("card:4111-1111-1111-1111.", [("CARD", "4111-1111-1111-1111")]),
    ("amex 3782 822463 10005 on file", [("CARD", "3782 822463 10005")]),
    ("call 555 123 4567 or (555) 765-4321", [("PHONE", "555 123 4567"), ("PHONE", "(555) 765-4321")]),
    ("tel +49 (301) 555-0199!", [("PHONE", "+49 (301) 555-0199")]),
    ("in 2024 we sold 1234 of 5678 pieces, 12.5% more than 999.999.999.999", []),
    ("version 1.2.3 of 2023-04-05, order 123456789", []),
]


def test_forms_that_the_generator_did_not_write():
    model = pii_crf.train()
    for text, want in HELD_OUT:
        assert [(k, text[b:e]) for _, k, b, e, _ in pii_crf.entities(model, [text])] == want, text


def test_skip_links_decide_labels():
    model = pii_crf.train()
    alone = pii_crf.Model(model.unary, model.chain, np.zeros_like(model.skip))
    text = "reach me at 212-555-0187 for this. " + "some words in between " * 20 + "ref 2125550187 end"
    found = lambda m, t: [(k, t[b:e]) for _, k, b, e, _ in pii_crf.entities(m, [t])]
    assert found(model, text) == [("PHONE", "212-555-0187"), ("PHONE", "2125550187")]
    assert found(alone, text) == [("PHONE", "212-555-0187")]
    assert found(model, text.replace("2125550187", "2125550188")) == [("PHONE", "212-555-0187")]


def test_findings_depend_on_the_document_alone():
    model = pii_crf.train()
    texts, _ = pii_crf.examples(60, 78)
    together = pii_crf.entities(model, texts)
    apart = [(d, *x[1:]) for d, t in enumerate(texts) for x in pii_crf.entities(model, [t])]
    assert [x[:4] for x in together] == [x[:4] for x in apart]
    assert max(abs(x[4] - y[4]) for x, y in zip(together, apart)) < 1e-9


def test_loopy_marginals_against_enumeration_with_a_loop():
    model = pii_crf.train()
    g = pii_crf.Graph(["212-555-0187 x 2125550187 x 212-555-0187"])
    u, n, k = g.unary(model.unary), g.n, len(pii_crf.LABELS)
    assert len(g.skip) == 3 and len(g.chain) == n - 1
    total = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        w = math.exp(sum(u[i, y[i]] for i in range(n)) + sum(model.chain[y[a], y[b]] for a, b in g.chain) + sum(model.skip[y[a], y[b]] for a, b in g.skip))
        for i in range(n):
            total[i, y[i]] += w
    exact, got = total / total.sum(1, keepdims=True), model.marginals(g)
    assert (exact.argmax(1) == got.argmax(1)).all() and np.abs(exact - got).max() < 0.1


def test_loopy_marginals_equal_enumeration_on_a_tree():
    model = pii_crf.train()
    g = pii_crf.Graph(["mail me@x.org or 10.2.3.4"])
    u, n, k = g.unary(model.unary), g.n, len(pii_crf.LABELS)
    total = np.zeros((n, k))
    for code in range(k**n):
        y = [code // k**i % k for i in range(n)]
        w = math.exp(sum(u[i, y[i]] for i in range(n)) + sum(model.chain[y[a], y[b]] for a, b in g.chain))
        for i in range(n):
            total[i, y[i]] += w
    assert np.allclose(total / total.sum(1, keepdims=True), model.marginals(g), atol=1e-3)


def test_license_gate_and_suppression(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "x SPDX-License-Identifier: MIT y", "This work is licensed under the GNU General Public License, version 3.", "see https://opensource.org/licenses/MIT", "Licensed under CC BY-NC 4.0.", "plain prose, unmitigated", "CC-BY-4.0"]
    got = {(x["doc_id"], x["license"], x["kind"]) for x in license_rules.licenses(frame(spark, texts)).collect()}
    assert got == {(0, "Apache-2.0", "grant"), (1, "MIT", "tag"), (2, "GPL-3.0", "grant"), (3, "MIT", "address"), (4, "CC-BY-NC-4.0", "grant"), (6, "CC-BY-4.0", "title")}
    assert len(license_rules.RULES) > 300
    every = {r.keyword for r in license_rules.RULES}
    for i, t in enumerate(texts):
        assert {(i, r.license, r.kind) for _, _, r in license_rules.detect(t.lower(), every)} == {x for x in got if x[0] == i}


def example(parsed, branch: int) -> str:
    """A text that a parsed pattern matches, by the first or last of its alternatives."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "ANY":
            out += "z"
        elif name == "IN":
            kind, value = arg[0]
            out += {"CATEGORY_SPACE": "\n", "CATEGORY_DIGIT": "3", "CATEGORY_WORD": "z"}[str(value)] if str(kind) == "CATEGORY" else chr(value)
        elif name == "SUBPATTERN":
            out += example(arg[3], branch)
        elif name == "BRANCH":
            out += example(arg[1][branch], branch)
        elif name == "MAX_REPEAT":
            out += example(arg[2], branch) * arg[0]
        else:
            assert name == "ASSERT_NOT", name
    return out


def test_license_gate_misses_no_rule(spark):
    texts = ["Released under MIT.", "Distributed under GPL-3.0.", "available under BSD-3-Clause", "Creative Commons Attribution 4.0", "Attribution-ShareAlike 3.0"]
    texts += [example(re._parser.parse(r.pattern.pattern, r.pattern.flags & ~re.U), k) for r in license_rules.RULES for k in (0, -1)]
    want = set()
    for i, t in enumerate(texts):
        found = [(m.start(), m.end(), r) for r in license_rules.RULES for m in r.pattern.finditer(t.lower())]
        assert found
        want |= {(i, r.number, b, e) for b, e, r in license_rules.resolve(found)}
    got = {(x["doc_id"], x["rule"], x["begin_char"], x["end_char"]) for x in license_rules.licenses(frame(spark, texts)).collect()}
    assert got == want


def test_ledger_scans_only_what_is_new(spark):
    secret = 'token = "0123456789abcdef0123456789abcdef"'
    docs = frame(spark, [secret, secret, "nothing", None, ""], [1, 2, 3, 4, 5])
    found, new = secret_ledger.scan(docs, secret_ledger.empty_ledger(spark))
    assert {(x["doc_id"], x["rule"], x["hits"]) for x in secret_ledger.by_path(docs, found).collect()} == {(1, "assigned_hex", 1), (2, "assigned_hex", 1)}
    assert new.count() == 3 * len(secret_ledger.RULES)
    again, none = secret_ledger.scan(docs, new)
    assert again.count() == 0 and none.count() == 0
    raised = tuple(secret_ledger.Rule(r.name, 3, r.keywords, r.pattern) if r.name == "assigned_hex" else r for r in secret_ledger.RULES)
    third, some = secret_ledger.scan(docs, new, raised)
    assert third.count() == 1 and some.count() == 3


def test_ledger_finds_secrets_after_colons(spark):
    h, b = "0123456789abcdef" * 2, "Ab1+" * 10
    texts = [f"password: '{h}'", f'api_key: "{h}"', f'{{"token": "{h}"}}', f'x = 1 {{"client_secret": "{b}"}}', f"private_key: '{b}'", f"a = 1, token: '{h}'", f"token = '{h}'", "token: none"]
    docs = frame(spark, texts)
    old = docs.selectExpr("sha2(text, 256) as blob").crossJoin(spark.createDataFrame([(r.name, 1) for r in secret_ledger.RULES], "rule string, version int"))
    want = {(i, "assigned_base64" if i in (3, 4) else "assigned_hex") for i in range(7)}
    for ledger in (secret_ledger.empty_ledger(spark), old):
        for small in (secret_ledger.SMALL_BYTES, 0):
            got = secret_ledger.by_path(docs, secret_ledger.scan(docs, ledger, small=small)[0], small).collect()
            assert {(x["doc_id"], x["rule"]) for x in got} == want and all(x["hits"] == 1 for x in got)
    twice = secret_ledger.by_path(docs, secret_ledger.scanned_twice(docs)).collect()
    assert {(x["doc_id"], x["rule"]) for x in twice} == want and len(twice) == 7


def test_host_prior_shrinks_small_hosts(spark):
    rows = [("good", 0)] * 50 + [("bad", 1)] * 50 + [("tiny", 1)]
    flags = spark.createDataFrame([(h, f, 0, 0, 0, 0) for h, f in rows], "host string, " + ", ".join(f"{r} int" for r in host_rules.RULES))
    v = {x["host"]: (x["worst_rate"], x["host_ok"]) for x in host_rules.host_verdicts(flags).collect()}
    assert v["good"][1] and not v["bad"][1] and v["tiny"][0] < v["bad"][0]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_constraint(spark, rule):
    r = random.Random(8)
    texts = [prose(r, r.choice([3, 40, 300, 3000, 9000])) for _ in range(60)]
    got = packing.packed(frame(spark, texts), rule, shard=40).toPandas()
    assert got.groupby("doc_id")["n_tokens"].sum().tolist() == [len(t.split()) for t in texts]
    b = got.groupby("bin_id")["n_tokens"]
    assert b.sum().max() <= packing.TOKENS and b.size().max() <= packing.PIECES and b.agg(lambda v: int((v.astype("int64") ** 2).sum())).max() <= packing.ATTENTION


def test_packing_takes_the_best_bin():
    r = np.random.default_rng(9)
    n = r.integers(1, 900, 200)
    cap = np.array((1000, 6, 700_000), dtype=float)
    got = packing.pack(n, "norm", (1000, 6, 700_000))
    items = np.stack([n, np.ones(200), n.astype(float) ** 2], 1) / cap
    weight = items.sum(0) / items.sum()
    bins: list[np.ndarray] = []
    want = np.zeros(200, dtype=int)
    for k in np.argsort(-(items * weight).sum(1), kind="stable"):
        fit = [(float((weight * (b - items[k]) ** 2).sum()), i) for i, b in enumerate(bins) if (b - items[k] >= -1e-12).all()]
        if not fit:
            bins.append(np.ones(3))
            fit = [(0.0, len(bins) - 1)]
        want[k] = min(fit)[1]
        bins[want[k]] = bins[want[k]] - items[k]
    assert (got == want).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in tc.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}


def test_bloom_has_no_false_negatives(spark):
    h = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 2000, dtype=np.int64)
    words = tc.bloom_words(spark.createDataFrame([(int(x),) for x in h], "h bigint"), "h", 20)
    assert tc.bloom_has(words, h.view(np.uint64)).all()
    assert tc.bloom_has(words, tc.mix(np.arange(10000, dtype=np.uint64))).mean() < 0.05


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(10)
    item = prose(r, 20)
    base = [prose(r, 80) for _ in range(30)]
    texts = base + [base[0].replace(base[0].split()[5], "changed"), prose(r, 20) + " moron " + prose(r, 20), prose(r, 5) + " " + item, None, ""] + [prose(r, 30) + " moron" for _ in range(20)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, 1, int(i >= 35)) for i in range(len(texts)) if i != 31]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or out.columns == docs.columns
        docs = out
        kept.append({x["doc_id"] for x in out.select("doc_id").collect()})
    assert kept[0] == set(range(35)) - {31} and kept[1] == kept[0]
    assert kept[3] == kept[2] - {32} and kept[4] <= kept[3] and set(range(1, 30)) <= kept[4]
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == out.count()
