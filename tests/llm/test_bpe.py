import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")

from ledgerloom.llm import bpe, queries  # noqa: E402

PATH = queries.vocabulary()
OURS, THEIRS = bpe.tokenizer(PATH), tokenizers.Tokenizer.from_file(PATH)


def ids(text):
    return np.frombuffer(OURS.encode_batch([text])[0], "<u4").tolist()


def check(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert OURS.decode(np.array(want, "<u4").tobytes()) == THEIRS.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aehinorst 'd.<|>", max_size=60))
def test_like_the_library(text):
    check(text)


@pytest.mark.parametrize("text", ["", " \n", "x<|endoftext|>y<|startoftext|>", "İΣς ﬁ ½²٣", "don't WE'LL", "a" * 3000, "ohohohohoh" * 40, "中文 🙂‍"])
def test_odd_texts(text):
    check(text)


def test_every_character():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(every[i : i + 2048]) for i in range(0, len(every), 2048)]
    for text, want in zip(texts, THEIRS.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(text) == want.ids, [c for c in text if ids(c) != THEIRS.encode(c, add_special_tokens=False).ids]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("aeAIİΣσς ़゙̧̣́̀ͅ가각각१\u0344\u1c89\U00016d67\U000113c2\U000113b8\U0001e4ec'<|>"), max_size=12).map("".join))
def test_marks_and_new_letters(text):
    check(text)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    random.seed(5)
    for _ in range(30):
        check(" ".join("".join(random.choices("aeinst", k=random.randint(1, 9))) for _ in range(12)))


def test_incompatible_pairs_are_found():
    t = OURS.vocab
    x, y = np.array([t["t"]]), np.array([t["he</w>"]])
    assert ids("the") == [t["the</w>"]] and not OURS.compatible(x, y).any()


def test_rows(spark):
    rows = spark.createDataFrame([(1, "The cat", 9), (1, "The cat", 9), (None, None, 9), (3, "", 9)], "doc_id long, text string, n_tokens int")
    got = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in bpe.digests(rows, PATH).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {(1, 2, hashlib.sha256(b"the</w> cat</w>").hexdigest()), (None, 0, empty), (3, 0, empty)}
    assert bpe.encode(rows, PATH).where("doc_id = 1").first()["decoded"] == "the</w> cat</w>"
    assert bpe.digests(rows.limit(0), PATH).count() == 0


@pytest.mark.parametrize("unit", ["a", "é", "ab9x", "QUJD+/zoq"])
def test_one_very_long_word(unit):
    """Time follows the length of a word: one of megabytes without a space is no quadratic case."""
    check(unit * (300_000 // len(unit)))


def test_a_word_of_ten_megabytes():
    began = time.time()
    found = ids("é" * 5_000_000)
    assert time.time() - began < 120
    assert found == THEIRS.encode("é" * 5_000_000, add_special_tokens=False).ids


def test_a_task_takes_its_encodings_along(monkeypatch):
    """What a worker keeps after a task are the tokenizer's tables; texts are split a bounded part at a time."""
    import pyarrow as pa

    held, parts = bpe.tokenizer(PATH), []
    before = set(held.cache)
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 50)
    whole = bpe.WordBpe.encode_batch
    monkeypatch.setattr(bpe.WordBpe, "encode_batch", lambda self, texts: parts.append(texts) or whole(self, texts))
    texts = [f"never{i}met word{i} of this task alone" for i in range(9)]
    out = bpe._encoder(PATH, True)()(pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["doc_id", "text"]))
    assert out.column("ids").to_pylist() == [whole(bpe.of_task(PATH), [t])[0] for t in texts]
    assert set(held.cache) == before and [t for p in parts for t in p] == texts and max(map(len, parts)) == 1
