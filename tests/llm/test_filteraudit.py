"""The filter audit against every order applied plainly."""

import itertools
import re

from ledgerloom.llm import filteraudit

DOCS = "doc_id bigint, text string, source string, mask int, print string, least string"
LABELS = "doc_id bigint, quality int, toxic int"


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, 1, "p", "q") for d in docs], DOCS), spark.createDataFrame(labels, LABELS)


def plain(docs, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    fails = []
    for doc_id, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [d for d, t, _ in docs if d is not None and (t or "") == text]
        fails.append({"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and min(copies) < doc_id})
    out = {}
    parts = {(s or "") for *_, s in docs}
    for part in parts:
        mine = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                shapley[x] += len(gone)
                redundant = sum(f[x] for _, f in mine) - len(gone)
                unique = sum(f[x] and sum(f.values()) == 1 for _, f in mine)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def told(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


def some():
    long = " ".join(f"w{i}" for i in range(250))
    return [
        (1, long, "a"), (2, long, "a"), (3, long, None), (3, long, ""), (None, long, "a"), (4, "A B C", "b"), (5, "x " * 300, "b"), (6, "x " * 300 + "$", "b"),
        (7, None, None), (8, "", "a"), (9, long + " #", "b"), (9, long + " #", "b"), (None, None, "b"), (10, "Ä " + long, "a"), (11, "long$ " * 40_000, "a"), (2, long, "b"),
    ]


LABELLED = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (4, None, 1), (6, 1, None), (None, 1, 1), (11, 1, 1), (99, 1, 1)]


def test_all_orders(spark):
    assert told(filteraudit.audit(*frames(spark, some(), LABELLED))) == plain(some(), LABELLED)


def test_groups_across_parts(spark):
    """Copies over many parts, also with one id repeated: the least id of the whole group counts."""
    docs = [(i % 97, "hot", "h") for i in range(3000)] + [(i, f"t{i % 50}", "s") for i in range(500)] + [(None, "hot", "h")] * 40
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = filteraudit.masks(frames(spark, docs, [])[0].repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    copies = sorted((r["part"], r["doc_id"]) for r in found if r["mask"] & filteraudit.COPY)
    assert len(found) == len(docs) and copies == sorted([("h", i % 97) for i in range(3000) if i % 97] + [("s", i) for i in range(50, 500)])


def test_fingerprints_that_meet(spark, monkeypatch):
    """Texts that share a fingerprint stay apart: the full text decides."""
    docs = [(i, f"text {i % 5}", "s") for i in range(200)]
    monkeypatch.setattr(filteraudit.F, "sha2", lambda c, n: filteraudit.F.lit("same"))
    found = filteraudit.masks(frames(spark, docs, [])[0].repartition(5)).collect()
    assert sorted(r["doc_id"] for r in found if not r["mask"] & filteraudit.COPY) == [0, 1, 2, 3, 4]


def test_empty(spark):
    assert filteraudit.audit(*frames(spark, [], [])).collect() == []
    rows = told(filteraudit.audit(*frames(spark, [(1, None, None)], [])))
    assert len(rows) == 600 and set(k[0] for k in rows) == {""}
