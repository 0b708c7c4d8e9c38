import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ledgerloom.llm import decontam, toxicity  # noqa: E402


def test_stages_keep_the_columns_and_run_ends_in_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
        assert 0.5 * counts[-2] <= counts[-1] <= counts[-2], name
    last = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(r["doc_id"] for r in docs.collect())
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    found = decontam.searchers(bench)
    texts = [r["text"] for r in docs.collect()]
    assert not any(next(iter(s.search(decontam.words(t))), None) for t in texts for s in found)
    assert len(texts) == len(set(texts))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from ledgerloom.llm import common

    cluster = Fake(sparkContext=Fake(master="spark://host:7077", getConf=lambda: Fake(get=lambda _: None), getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)


def test_toxic_documents_go(spark, sf):
    docs = spark.createDataFrame([(1, "you pathetic idiot, such trash and scum", "en", "s", 39), (2, "a clean text about the weather of today", "en", "s", 39)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.toxic_out(spark, docs, sf).collect()] == [2]
    assert toxicity.Lexicon([]).match("x") is None


def test_odd_rows_and_clashing_columns(spark, sf):
    from pyspark.sql import functions as F

    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text, "en", "s", 5), (2, text, "en", None, 5), (3, None, None, None, None), (None, "", "en", "s", 0), (4, "x " * 20000, "en", "s", 40000), (4, "x " * 20000, "en", "s", 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(7) for c in ("score", "predicted", "n_removed", "hits", "items", "n_hit", "node", "planes", "class")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert all(r["score"] == r["hits"] == r["node"] == 7 for r in docs.collect()), name
    assert sorted(r["doc_id"] for r in docs.where("doc_id is not null").collect()) in ([1, 4], [1, 3, 4])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def plain_pipeline(docs, items, model):
    """The five stages over (doc_id, text, source) by comparing everything with everything: doc_id to the ids of its text."""
    import collections
    import itertools

    import numpy as np
    import tokenizers

    from ledgerloom.llm import bagminhash as B, linespread as L, queries

    reader = toxicity.Reader(toxicity.Lexicon(model.terms, model.fuzzy))
    score = lambda t: float(np.dot(toxicity._features(*reader.read(t or ""), None), model.weights))
    docs = [d for d in docs if score(d[1]) < 0]

    spread, shingler = collections.defaultdict(lambda: [set() for _ in range(5)]), B.Shingler()
    for _, text, source in docs:
        parts = list(dict.fromkeys(x.strip(" ") for x in (text or "").split("\n")))
        kinds = L.kinds(parts, shingler)
        for i, line in enumerate(parts):
            if len(line.split(" ")) >= L.WORDS:
                for held, x in zip(spread[line], (source, text or "", *(k[i] for k in kinds)), strict=True):
                    held.add(x)
    size = lambda x: (len(x[0]), len(x[1]), sum(map(len, x[2:])) / 3)
    gone = {line for line, x in spread.items() if (n := size(x))[0] >= L.SITES and n[2] >= L.SITES and n[2] >= L.KINDS * n[1]}
    kept = []
    for i, text, source in docs:
        parts = (text or "").split("\n")
        rest = [x for x in parts if x.strip(" ") not in gone]
        if len(rest) == len(parts) or "\n".join(rest).strip():
            kept.append((i, text if len(rest) == len(parts) else "\n".join(rest), source))

    bags = [collections.Counter(shingler.shingles(t or "").tolist()) for _, t, _ in kept]
    up = list(range(len(kept)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(kept)), 2):
        both, every = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
        if (kept[i][1] or "") == (kept[j][1] or "") or every and both / every >= B.SIMILARITY:
            up[top(i)] = top(j)
    least = {}
    for i, d in enumerate(kept):
        least[top(i)] = min(least.get(top(i), d), d, key=lambda x: x[0])
    windows = {w for t in items for w in decontam.windows(t)}

    def leaks(text):
        ws = decontam.words(text)
        return any(tuple(ws[i : i + m]) in windows for m in {len(w) for w in windows} for i in range(len(ws) - m + 1))

    encode = tokenizers.Tokenizer.from_file(queries.vocabulary())
    return {i: encode.encode(t or "", add_special_tokens=False).ids for i, t, _ in least.values() if not leaks(t)}


def test_run_like_brute_force(spark, sf):
    import hashlib

    import numpy as np

    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    want = plain_pipeline(docs, items, model)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert len(want) < len(docs)
    assert got == {i: (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, ids in want.items()}
    last = corpus_pipeline.STAGES[-1][1]
    odd = spark.createDataFrame([(1, "The cat", 7), (None, None, 7)], "doc_id long, text string, n_tokens int")
    assert sorted(r["n_tokens"] for r in last(spark, odd, sf).collect()) == [0, 2] and last(spark, odd.limit(0), sf).count() == 0
