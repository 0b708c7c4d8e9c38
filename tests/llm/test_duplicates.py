import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bagminhash as B
from ledgerloom.llm import linespread as L


def test_registers_estimate_weighted_similarity_without_bias():
    rng = np.random.default_rng(5)
    a = [np.repeat(rng.integers(0, 2**63, 40).astype(np.uint64), rng.integers(1, 9, 40)) for _ in range(60)]
    b = [np.concatenate([x[: len(x) * 3 // 4], rng.integers(0, 2**63, 15).astype(np.uint64)]) for x in a]
    same = (B.signatures(a) == B.signatures(b)).mean(1)
    true = np.array([B.overlap(x, y) for x, y in zip(a, b, strict=True)])
    assert abs((same - true).mean()) < 0.02


def test_signatures_do_not_depend_on_the_batch():
    docs = [np.arange(n, dtype=np.uint64) * np.uint64(7919) for n in (1, 5, 300)]
    whole = B.signatures(docs)
    for i, d in enumerate(docs):
        assert (B.signatures([d])[0] == whole[i]).all()


def test_overlap_counts_repeats():
    a, b = np.array([1, 1, 2], np.uint64), np.array([1, 2, 2], np.uint64)
    assert B.overlap(a, b) == 0.5


def classes(texts):
    bags = [collections.Counter(B.Shingler().shingles(t or "").tolist()) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            every = sum((bags[i] | bags[j]).values())
            if (texts[i] or "") == (texts[j] or "") or every and both / every >= B.SIMILARITY:
                up[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i in range(len(texts)):
        groups[top(i)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_like_brute_force_over_a_gradient_of_edits(spark):
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    bases = [[word() for _ in range(120)] for _ in range(3)]
    texts = []
    for i in range(150):
        ws = list(bases[i % 3])
        for k in random.sample(range(120), random.choice([0, 1, 2, 3, 4, 6, 9, 20])):
            ws[k] = word()
        texts.append(" ".join(ws))
    texts += [texts[0], None, "", "one two", "One, two!", "one two three", "...", "x " * 400, "x " * 420]
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == classes(texts)


@pytest.mark.parametrize("nodes", [500_000, 0])
def test_crowded_buckets_and_tables_too_large_to_broadcast(spark, monkeypatch, nodes):
    for name, value in (("CROWDED", 4), ("BLOCK", 3), ("BROADCAST_NODES", nodes)):
        monkeypatch.setattr(B, name, value)
    random.seed(4)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    base, texts = [word() for _ in range(100)], []
    for _ in range(60):
        ws = list(base)
        for k in random.sample(range(100), random.choice([1, 2, 3, 4, 5])):
            ws[k] = word()
        texts.append(" ".join(ws))
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == classes(texts)


def test_few_rounds_where_tables_are_small(spark, monkeypatch):
    """Each table written between is a round of tasks; what is few is broadcast instead.  Classes and links stay as they are."""
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    base, texts, written, cut = [word() for _ in range(100)], [], [], B.cut
    for _ in range(40):
        ws = list(base)
        for k in random.sample(range(100), random.choice([1, 2, 3, 4])):
            ws[k] = word()
        texts.append(" ".join(ws))
    texts += [texts[0], texts[0], "one text of its own with its own words", None, None, "..."]
    monkeypatch.setattr(B, "cut", lambda df, name: written.append(name) or cut(df, name))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = sorted(map(tuple, B.near_duplicates(docs).collect()))
    n = len(written)
    monkeypatch.setattr(B, "BROADCAST_NODES", 0)
    assert few == sorted(map(tuple, B.near_duplicates(docs).collect())) and {r[0]: r[1] for r in few} == classes(texts)
    assert written[:n].count("texts") == 1 and n <= 27, written[:n]


def test_recall_by_similarity_on_the_driver_s_documents(spark):
    """Every pair of 0.8 or more shares a class; what lies below is reported and not promised."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(docs).collect()}
    shingler, holders = B.Shingler(), collections.defaultdict(list)
    bags = [collections.Counter(shingler.shingles(t).tolist()) for _, t in rows]
    for i, bag in enumerate(bags):
        for h in bag:
            holders[h].append(i)
    pairs = {(i, j) for some in holders.values() if len(some) > 1 for n, i in enumerate(some) for j in some[n + 1 :]}
    told = collections.Counter()
    for i, j in pairs:
        s = sum((bags[i] & bags[j]).values()) / sum((bags[i] | bags[j]).values())
        if s >= 0.5:
            told[int(s * 10) / 10, got[rows[i][0]] == got[rows[j][0]]] += 1
    print("pairs by similarity and whether they share a class:", sorted(told.items()))
    assert sum(n for (s, same), n in told.items() if s >= 0.8 and same) >= 50
    assert not any(n for (s, same), n in told.items() if s >= 0.8 and not same)


def test_keep_one(spark):
    text = "a b c d e f g h i j k"
    rows = spark.createDataFrame([(5, text, 1), (3, text, 2), (3, text, 2), (4, "A b c d e f g h i j k.", 3), (9, "other words in here", 4), (None, None, 5)], "doc_id long, text string, node int")
    got = B.keep_one(rows)
    assert got.columns == rows.columns and sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 3, 9]
    assert B.keep_one(rows.limit(0)).count() == 0


def test_an_id_goes_before_none(spark):
    """A class with null and other ids is named by the least id, and that row stays."""
    text = "a b c d e f g h i j k"
    rows = spark.createDataFrame([(None, text), (7, text + "."), (None, "A" + text[1:]), (None, "some other words here")], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in B.near_duplicates(rows).collect()} == {(None, 7), (7, 7), (None, None)}
    assert sorted(str(r["doc_id"]) for r in B.keep_one(rows).collect()) == ["7", "None"]


def test_pairs_of_one_node_are_dealt(spark, monkeypatch):
    """A head in many pairs meets them over copies of its row, and no pair is lost."""
    monkeypatch.setattr(B, "CROWDED", 8)
    pairs = spark.createDataFrame([(bytes([i % 250, i // 250]), b"h") for i in range(500)] + [(b"h", b"z")], "a binary, b binary")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("text", F.hex("node"))
    both = B.beside(B.beside(pairs, nodes, "a", ["text"]), nodes, "b", ["text"]).collect()
    assert len(both) == 501 and all(r["text_a"] == r["a"].hex().upper() and r["text_b"] == r["b"].hex().upper() for r in both)


def test_unlike_texts_stay_whatever_their_ids(spark):
    rows = [(None, f"a text with its very own words{i} and number{i} and end{i}") for i in range(6)]
    rows += [(7, "one text under a repeated id here"), (7, "quite unlike the other one that has this number"), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in B.keep_one(docs).collect()) == sorted({t for _, t in rows})
    assert B.near_duplicates(docs).select("class").distinct().count() == 8


def test_op5_tells_classes_apart(spark, tmp_path):
    from ledgerloom.llm import queries

    rows = [(None, "the first of two unlike texts here"), (None, "another one that has other words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert len({r["class"] for r in queries.op5_near_duplicates(spark, str(tmp_path)).collect()}) == 2


def test_hashes_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    texts = ["", "a", "Zeile mit ü", "x" * 100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got == [L.hashed(t) for t in texts]


def site_rows():
    own = [f"own words number{i} of this one document alone here" for i in range(60)]
    rows = [(i, f"{own[i]}\nThis footer is on all sites\nshort", f"s{i % 12}") for i in range(40)]
    rows += [(100 + i, "copied text with its very own longwordhere inside\nand a second line too", f"s{i % 12}") for i in range(30)]
    return rows + [(200, None, None), (201, "This footer is on all sites", "s1"), (202, "", "s1"), (202, "", "s1")]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "BROADCAST_LINES", limit)
    rows = spark.createDataFrame([(*r, 7) for r in site_rows()], "doc_id long, text string, source string, n_removed int")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in L.clean(rows).collect()}
    assert got[3] == ("own words number3 of this one document alone here\nshort", 1)  # the footer goes, short lines stay
    assert got[100][1] == 0  # copies of a text are no boilerplate
    assert got[200] == (None, 0) and got[201] == ("", 1) and got[202] == ("", 0)
    assert L.clean(rows.limit(0)).count() == 0


def test_a_line_with_the_longest_word_is_no_kind_of_its_own(spark):
    line = "See https://example.org/a/very/long/address for terms"
    rows = [(i, f"{line}\nown{i} words{i} here{i} alone{i}", f"s{i % 12}") for i in range(40)]
    rows += [(100 + i, f"{'one more passage of longestwords that all sites show ' * 5}\nshort{i} own{i} text{i}", f"s{i % 12}") for i in range(40)]
    rows += [(200 + i, f"a copied text of several lines\nwith very few words changed in it\nand number{i} is one of them", f"s{i % 12}") for i in range(40)]
    got = {r["doc_id"]: r["n_removed"] for r in L.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == got[103] == 1


def test_kinds_grow_with_the_texts_and_not_with_their_words(spark):
    random.seed(2)
    own = [" ".join(random.choices(["word%d" % i for i in range(60)], k=40)) for _ in range(900)]
    rows = [(i, f"the footer of all sites\n{x}", f"s{i % 12}") for i, x in enumerate(own)]
    base = [["".join(random.choices("abcdefgh", k=5)) for _ in range(12)] for _ in range(10)]
    for i in range(60):  # near copies
        near = [list(x) for x in base]
        near[i % 10][i % 12] = f"changed{i}"
        rows.append((2000 + i, "\n".join(map(" ".join, near)), f"s{i % 12}"))
    got = {r["doc_id"]: r["n_removed"] for r in L.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == 1 for i in range(900)) and not any(got[2000 + i] for i in range(60))
