import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chatlog, decontam, queries


def brute(text, items):
    ws, hit, own = decontam.words(text), set(), set()
    for i, t in items:
        iw = decontam.words(t)
        m = min(10, len(iw))
        for a in range(len(iw) - m + 1) if m else ():
            for b in range(len(ws) - m + 1):
                if ws[b : b + m] == iw[a : a + m]:
                    hit |= set(range(b, b + m))
                    own.add(str(i))
    return len(ws), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()


@pytest.mark.parametrize("limit,slots,few", [(8_000_000, 1 << 22, 100_000), (40, 1 << 22, 100_000), (0, 16, 0)])
def test_like_brute_force(spark, monkeypatch, limit, slots, few):
    for name, value in (("HELD_CHARS", limit), ("SLOTS", slots), ("BROADCAST_TEXTS", few)):
        monkeypatch.setattr(decontam, name, value)
    random.seed(2)
    text = lambda n: " ".join(random.choices("aA b B-b é".split(), k=n))
    items = [(1, text(14)), (2, text(3)), (10, "b"), (3, None), (4, "..."), (5, text(11)), (1, text(12))]
    docs = [(i, text(random.randint(0, 60)), "x") for i in range(40)] + [(99, None, "x"), (98, items[0][1], "x"), (98, items[0][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_hit string").select("doc_id", "text", F.lit(1).alias("items"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.decontaminate(d, b).collect())
    assert got == sorted((i, *brute(t, items)) for i, t, _ in docs)
    assert decontam.decontaminate(d, b.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_the_tables_like_each_other_and_columns_of_any_name(spark, sf, monkeypatch, limit):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in decontam.decontaminate(docs, items).collect()}
    monkeypatch.setattr(decontam, "HELD_CHARS", limit)
    odd = docs.withColumns({c: F.lit(3) for c in ("key", "items", "n_hit", "m", "start", "window", "__0", "hits")})
    got = decontam.decontaminate(odd, items.withColumn("m", F.lit(1)), id_cols=("doc_id", "source"))
    assert {(r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in got.collect()} == want
    assert got.columns[:2] == ["doc_id", "source"]


def test_a_very_long_text_takes_time_in_proportion():
    import time

    search = decontam.searchers([(1, "a b c d e f g h i j"), (2, "x y")])

    def seconds(n):
        began = time.process_time()
        ws = decontam.words("a b c d e f g h i j x y " * n)
        assert sum(1 for s in search for _ in s.search(ws)) == 2 * n
        return time.process_time() - began

    assert seconds(80_000) < 16 * max(seconds(10_000), 0.05)


def test_words():
    assert decontam.words("Ab-C éÉ 1٣\nx") == ["ab".encode(), b"c", "éÉ".encode(), "1٣".encode(), b"x"]


def told(spark, *events):
    df = spark.createDataFrame(list(events), "conv_id long, message int, seq int, kind string, role string, text string")
    rows = chatlog.parse(chatlog.render(chatlog.fold(df))).collect()
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows}, {r["conv_id"]: r["loss_text"] for r in rows}


def test_events_fold(spark):
    turns, loss = told(
        spark,
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", "a"), (1, 1, 3, "delta", "assistant", "b"), (1, 1, 5, "delta", None, "d"), (1, 1, 4, "delta", None, "c"),
        (1, 2, 6, None, "user", "old"), (1, 2, 7, "edit", "user", "new"), (1, 3, 8, "message", "assistant", "first"), (1, 3, 9, "regenerate", "assistant", "gone"), (1, 3, 10, "delta", None, "second"),
        (1, 4, 11, "message", "tool", "x"), (1, 4, 12, "delete", None, None), (2, 0, 1, "message", None, None),
    )
    assert turns[1] == [("user", "hi"), ("assistant", "abcd"), ("user", "new"), ("assistant", "second")] and loss[1] == "abcdsecond"
    assert turns[2] == [("", "")] and loss[2] == ""


def test_control_strings_come_back(spark):
    random.seed(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "/", "s>", " ", "x", "\n", "🙂", "INST]"]
    text = lambda: "".join(random.choices(parts, k=random.randint(0, 8)))
    want = {i: [(random.choice(["user", "assistant", "system", "tool", text()]), text()) for _ in range(4)] for i in range(150)}
    turns, loss = told(spark, *((i, n, n, "message", role, t) for i, m in want.items() for n, (role, t) in enumerate(m)))
    assert turns == want
    assert loss == {i: "".join(t for role, t in m if role == "assistant") for i, m in want.items()}


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op10_chat(spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_conversation_query(spark, sf):
    rows = {r["conv_id"]: r for r in queries.op10_chat(spark, sf).collect()}
    own = "</s>[INST] ok [/INST]"
    assert rows[-1]["n_turns"] == 2 and rows[-1]["loss_sha256"] == hashlib.sha256(own.encode()).hexdigest()
    source = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    for conv in {r["conv_id"] for r in source}:
        own = [r for r in source if r["conv_id"] == conv]
        assert rows[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r['role']}\n{r['text']}\n" for r in own).encode()).hexdigest()


def test_odd_logs(spark):
    from pyspark.sql import Row

    turns, loss = told(spark, (None, 0, 1, "message", "user", "a"), (None, 1, 2, "message", "assistant", "b"), (3, 0, 1, "message", "user", "x"), (3, 0, 1, "message", "user", "x"))
    assert turns[None] == [("user", "a"), ("assistant", "b")] and loss[None] == "b"
    assert turns[3] == [("user", "x")]  # a repeated event is the same message again
    events = spark.createDataFrame([(1, 0, 1, "message", "user", "hi")], "conv_id long, message int, seq int, kind string, role string, text string")
    odd = events.withColumns({c: F.lit(9) for c in ("log", "start", "alive", "turn", "turns", "formatted", "loss")})
    assert chatlog.parse(chatlog.render(chatlog.fold(odd))).select("turns").first() == Row(turns=[Row(role="user", text="hi")])
    assert chatlog.render(chatlog.fold(events.limit(0))).count() == 0


def test_long_logs(spark):
    n = 3000
    rows = spark.range(n).selectExpr("1L as conv_id", "cast(id div 100 as int) as message", "cast(id as int) as seq", "if(id % 100 = 0, 'message', 'delta') as kind", "if(id div 100 % 2 = 0, 'user', 'assistant') as role", "repeat('x', 200) as text")
    got = chatlog.parse(chatlog.render(chatlog.fold(rows))).first()
    assert len(got["turns"]) == n // 100 and all(len(t["text"]) == 100 * 200 for t in got["turns"])
    assert len(got["loss_text"]) == n // 200 * 100 * 200
