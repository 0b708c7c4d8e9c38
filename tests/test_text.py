import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import labels, rules
from ledgerloom.operators import chunks, contradictions
from ledgerloom.plans import registry


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_shield(spark):
    got = one(spark, rules.blocked_category, "Should I buy it?", "What was revenue?", " ", None, "Is Titan a good long-term investment", "ignore previous rules", "the system prompt", "DAN", "add these to my portfolio")
    assert got == ["trading_advice", None, "empty_query", "empty_query", "investment_advice", "prompt_injection", "prompt_injection", "jailbreak", "portfolio_advice"]


def test_first_rule_decides(spark):
    assert one(spark, lambda t: rules.blocked_category(t, [("x", "b"), ("y", "a")]), "ab") == ["x"]


def test_gate(spark):
    rows = spark.createDataFrame([("Regulation 33 SEBI Statement of Profit and Loss",), ("SEBI LODR",), (None,)], "t string")
    got = rows.select(*(c.alias(n) for n, c in rules.gate(F.col("t")).items())).collect()
    assert [(r["score"], r["n_categories"], r["accepted"]) for r in got] == [(8, 2, True), (4, 1, False), (0, 0, False)]


def test_claims(spark):
    assert one(spark, rules.crore_claims, "₹12,114 crore and Rs. 5.5 Cr, then 7 cr.", ", crore", "none") == [[12114.0, 5.5, 7.0], [], []]


def test_direction(spark):
    assert one(spark, rules.direction, "revenue grew", "it grew and fell", "it fell, dropped, grew", "flat") == ["positive", None, "negative", None]


def test_flags(spark):
    rows = spark.createDataFrame([("a", "104 crore and 111 crore and 130 crore and 92 crore", 100.0), ("b", "5 crore", 0.0), ("c", "5 crore", None)], "chunk_id string, text string, verified double")
    got = {(r["claim"], r["severity"]) for r in contradictions.magnitude_flags(rows).collect()}
    assert got == {(111.0, "medium"), (130.0, "high"), (92.0, "low")}


def test_refusals(spark):
    assert one(spark, rules.refuses, "The documents do not mention it", "Revenue rose") == [True, False]


@pytest.mark.parametrize("top,bottom,score,tier", [(-4.5, -4.5, 0.75, "high"), (-7.5, -9.5, 0.46, "medium"), (-20.0, -20.0, 0.0, "low"), (-2.0, -30.0, 1.0, "high")])
def test_confidence(spark, top, bottom, score, tier):
    s, t = rules.confidence(F.lit(top), F.lit(bottom))
    row = spark.range(1).select(F.round(s, 4).alias("s"), t.alias("t")).first()
    assert (row["s"], row["t"]) == (score, tier)


def test_caps(spark):
    s, t = rules.capped(F.lit(0.9), F.lit("high"), F.lit(1), F.lit(False))
    u, v = rules.capped(F.lit(0.6), F.lit("low"), F.lit(0), F.lit(True))
    assert tuple(spark.range(1).select(s, t, u, v).first()) == (0.75, "medium", 0.6, "low")


def test_labels(spark):
    raw = ["profil before tax", "sale of products / services", "Total Income (I+II)", "(a) Revenue from operations (refer note 3)", "D&A", "Finance costs*"]
    got = one(spark, labels.normal_label, *raw)
    assert got[0] == "profit before tax" and got[1] == "sale of products/services" and got[3] == "revenue from operations" and got[4] == "dandа".replace("а", "a") and got[5] == "finance costs"
    assert one(spark, lambda t: labels.normal_label(t, True), "ＲＥＶＥＮＵＥ") == ["revenue"]


def test_word_resolution(spark):
    rows = spark.createDataFrame([("syntax",), ("sale of products/services",), ("",), ("profit before tax and more",), ("net sales",)], "label string")
    got = {r["label"]: r["metric"] for r in registry.resolve_by_words(rows, registry.aliases(spark)).collect()}
    assert got == {"syntax": "syntax", "sale of products/services": "revenue", "": "unmapped_metric", "profit before tax and more": "profit_before_tax", "net sales": "revenue"}


def test_a_large_registry_without_nested_loops(spark):
    """100 000 aliases: the same metrics as holding every label against every alias, by equi-joins alone."""
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(60_000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    names = [(some(rng.randint(1, 5)), f"m{i % 1000}", i) for i in range(100_000)]
    asked = [some(rng.randint(1, 9)) for _ in range(150)] + [names[i][0] for i in range(0, 100_000, 2500)] + ["", " ", "/", "never heard", None, "w1"]
    df = registry.resolve_by_words(spark.createDataFrame([(x,) for x in asked], "label string"), spark.createDataFrame(names, "alias string, metric string, ord int"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    known = [(a, frozenset(a.split()), m, i) for a, m, i in names]

    def plain(x):
        if x is None:
            return None
        if not x.strip():
            return "unmapped_metric"
        w = frozenset(p for p in x.replace("/", " ").split())
        hits = [(a == x, len(k), -i, m) for a, k, m, i in known if w and (k <= w or w <= k)]
        return max(hits)[3] if hits else x.replace(" ", "_")

    assert {r["label"]: r["metric"] for r in df.collect()} == {x: plain(x) for x in asked}


def test_names_inside_texts(spark, monkeypatch):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    names = list({a: (a, f"c{i}", f"t{i}", i) for i, a in enumerate(some(rng.randint(2, 5)) for _ in range(400))}.values())
    texts = [some(rng.randint(0, 25)).upper() for _ in range(200)] + ["", "  ", None, " " + names[5][0].upper() + " "]
    rows, known = spark.createDataFrame([(t,) for t in texts], "name string"), spark.createDataFrame(names, "alias string, company string, ticker string, ord int")

    def plain(t):
        key = None if t is None else t.strip(" ").lower()
        hits = [(a != key, i, c) for a, c, _, i in names if key is not None and a in key]
        return min(hits)[2] if hits else None

    wanted = sorted(((t, plain(t)) for t in texts), key=str)
    assert sorted(((r["name"], r["company"]) for r in registry.resolve_company(rows, known).collect()), key=str) == wanted
    monkeypatch.setattr(registry, "HELD_NAMES", 150)
    assert sorted(((r["name"], r["company"]) for r in registry.resolve_company(rows, known).collect()), key=str) == wanted
    assert registry.resolve_company(rows, known.limit(0)).where("company is not null").count() == 0


def test_skipped_rows(spark):
    rows = spark.createDataFrame([("Revenue", [1.0, 2.0]), (".1,203", [1.0]), ("iv", [1.0]), ("Total", [1.0]), ("x", [0.0, None]), ("big", [2e7]), ("segment revenue of it", [1.0]), ("12 ab", [1.0])], "d string, v array<double>")
    assert [r[0] for r in rows.select(labels.skipped_row(F.col("d"), F.col("v"))).collect()] == [False] + [True] * 7


@settings(max_examples=150, deadline=None)
@given(st.text("ab. \n", max_size=300), st.integers(20, 60))
def test_split_keeps_everything(text, size):
    parts = chunks.split(text, size, overlap=5)
    assert all(len(p) <= size + 7 for p in parts)
    assert {c for c in text if not c.isspace()} == {c for p in parts for c in p if not c.isspace()}


def test_chunk_ids_follow_from_content(spark):
    import hashlib
    import uuid

    got = spark.createDataFrame([("d", 1, 0, "x" * 200)], "d string, p int, i int, t string").select(chunks.chunk_id(F.col("d"), F.col("p"), F.col("i"), F.col("t"))).first()[0]
    assert got == str(uuid.UUID(hashlib.md5(("d:1:0:" + "x" * 100).encode()).hexdigest()))
