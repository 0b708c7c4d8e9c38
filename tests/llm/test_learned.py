import random

import numpy as np
import pytest

from ledgerloom.llm import quality, queries, toxicity


def edits(a, b):
    """Distance with transpositions of neighbours."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


def test_automaton_is_exact():
    random.seed(8)
    word = lambda n: "".join(random.choices("abc", k=n))
    terms = list(dict.fromkeys(word(random.randint(3, 11)) for _ in range(25)))
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        w = word(random.randint(1, 12))
        want = min((e for t in terms if (e := edits(w, t)) <= toxicity.allowed(t)), default=None)
        got = lexicon.match(w)
        assert (got[0] if got else None) == want, (w, got, want)


def test_contexts():
    read = toxicity.Reader(toxicity.Lexicon(["idiot"])).read
    assert read("what an idiot that is")[1][0][2] == 1.0
    assert read("you idiot")[1][0][2] == toxicity.ADDRESSED
    assert read('the sign "an idiot here" was up')[1][0][2] == toxicity.QUOTED
    assert read("somebody said idiot")[1][0][2] == toxicity.QUOTED
    assert read("such an idoit and id1ot")[1][0][1] == 1 and len(read("such an idoit and id1ot")[1]) == 2
    assert read("")[1] == [] and read("the riot")[1] == []


def accuracy(rows, labels, name):
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.mean([p == y for p, y in held]), len(held)


@pytest.mark.parametrize("name,label,least", [("op4_toxicity", "toxic", 0.93), ("op9_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    rows = queries.queries()[name](spark, d).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    got, n = accuracy(rows, {r["doc_id"]: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}, name)
    assert n > 40 and got >= least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_tables(spark, module):
    docs = spark.createDataFrame([(1, "you idiot", "en"), (1, "you idiot", "en"), (None, None, None), (2, "", "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = module.classify(docs, some).collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert module.classify(docs.limit(0), labels).count() == 0


def test_insults_beat_plain_words_without_labels(spark):
    docs = spark.createDataFrame([(1, "you worthless idiot"), (2, "a fine day")], "doc_id long, text string")
    rows = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert rows == {1: 1, 2: 0}


def test_temperature_and_shapes():
    assert quality.shape("WORD!!") == "A!" and quality.shape("ab12**") == "a0*"
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    net = quality.Network(0.5)
    net.train(x, (x[:, 0] > 0).astype(float))
    p = net.probability(x)
    assert ((p > 0.5) == (x[:, 0] > 0)).mean() > 0.9 and net.temperature > 0


def plain_toxicity(text, model):
    """The score by comparing every word with every term."""
    import re

    low = text.lower()
    found = [(m.group(), m.span()) for m in re.finditer(r"\w+", low)]
    words, abuse = [w for w, _ in found], 0.0
    for i, (w, _) in enumerate(found):
        best = None
        for form in dict.fromkeys([w if w.isalpha() else w.translate(toxicity._LEET), w]):
            hits = [(e, n) for n, t in enumerate(model.terms) if (e := edits(form, t)) <= (toxicity.allowed(t) if t in model.fuzzy else 0)]
            if hits:
                best = min(hits)
                break
        if best:
            at = [span for _, span in found]
            abuse += toxicity.Reader._context(low, words, at, i) * (1.0 if not best[0] else toxicity.MISSPELLED)
    z = model.weights @ np.array([1.0, np.log1p(abuse), np.log1p(1000.0 * abuse / max(len(words), 20))])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_like_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
    short = {i: t for i, t in texts.items() if len(t) < 900}
    extra = [(10_000, "you wortless idoit"), (10_001, 'they said "you idiot" today'), (10_002, ""), (10_003, "such 1d10t trash"), (10_004, None)]
    rows = docs.select("doc_id", "text").where(f"length(text) < 900").union(spark.createDataFrame(extra, "doc_id long, text string"))
    short |= {i: t or "" for i, t in extra}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert len(got) > 40 and got.keys() == short.keys()
    for i, text in short.items():
        assert got[i] == pytest.approx(plain_toxicity(text, model), abs=1e-9), text


def test_quality_like_brute_force(spark, sf):
    import math

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    vectors, network = quality.fit(docs, labels)
    mean, scale, a, b, c, d = network.parts
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, vectors, network).collect()}
    for r in docs.limit(60).collect():
        words = (r["text"] or "").split()
        row = lambda w: vectors.words[w] if w in vectors.words else len(vectors.words) + quality.shape_row(w)
        x = np.zeros(2 * quality.SIZE + 3)
        for w in words:
            x[: 2 * quality.SIZE] += vectors.table[row(w)] / len(words)
        if words:
            same = [row(p) == row(q) for p, q in zip(words, words[1:], strict=False)]
            x[-3], x[-2] = (sum(same) / len(same) if same else 0.0), len(set(words)) / len(words)
        x[-1] = math.log1p(len(words)) / 10
        hidden = np.tanh((x - mean) / scale @ a + b)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-float((hidden @ c + d)[0]) / network.temperature)), abs=2e-3)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_very_long_texts_and_words(spark, module):
    long = "plain words of a text " * 60_000
    docs = spark.createDataFrame([(1, long), (2, "x" * 2_000_000), (3, long + "you worthless idiot")], "doc_id long, text string")
    rows = module.classify(docs, spark.createDataFrame([], "doc_id long, toxic int, quality int")).collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.shape("x" * 100 + "1") == "a0"
