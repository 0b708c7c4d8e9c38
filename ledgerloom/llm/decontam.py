"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark: every run of ``WINDOW`` consecutive words of an
item, or a shorter item as a whole.  Patterns of one length share a block shift table: the last
two words under the search window say how far it can move without skipping an occurrence, and a
block that no pattern holds moves it by the most.  Where the shift is zero the block selects a
bucket of patterns, and direct comparison confirms an occurrence.

A benchmark of up to ``HELD_CHARS`` characters is counted, then held whole by every worker: one
narrow pass and no shuffle.  A larger one stays a table.  Its windows become rows, the shift tables
are built by aggregation, with blocks hashed into ``SLOTS`` slots so that their size is bounded
whatever the benchmark, and only they go to the workers.  Positions with a shift of zero are
candidates; a join of their words with the windows compares them directly.  What is shuffled then
follows the candidates, not the documents' words.

Defined results: a null text has no words; a null or wordless item has no windows; repeated items
and repeated documents each count on their own row, an item_id once; texts of any length are
searched whole; columns named like results are ignored unless ``id_cols`` names them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, map_batches

#: Words of a window.
WINDOW = 10
#: Words that index the shift table.
BLOCK = 2
#: Characters of benchmark text that a worker holds; slots of a hashed shift table; contaminated texts that may be broadcast.
HELD_CHARS, SLOTS, BROADCAST_TEXTS = 8_000_000, 1 << 22, 100_000

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return text.encode().translate(_WORDS).split() if text else []


class WuManber:
    """Patterns (tuples of words, all of one length) and who owns them."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[tuple[bytes, ...], frozenset[str]]]] = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = b" ".join(pattern[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.bucket.setdefault(b" ".join(pattern[-self.block :]), []).append((pattern, frozenset(owners)))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, frozenset[str]]]:
        """Start of every occurrence, with the owners of its pattern."""
        m, block, most, shift, bucket = self.length, self.block, self.most, self.shift.get, self.bucket
        end, n, one = m, len(text), block == 1
        while end <= n:
            key = text[end - 1] if one else text[end - 2] + b" " + text[end - 1]
            move = shift(key, most)
            if move:
                end += move
                continue
            start = end - m
            for pattern, owners in bucket[key]:
                if all(map(bytes.__eq__, pattern, text[start:end])):
                    yield start, owners
            end += 1


def windows(text: str | None) -> list[tuple[bytes, ...]]:
    """The patterns of one item."""
    ws = words(text)
    m = min(WINDOW, len(ws))
    return [tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)] if m else []


def searchers(items: list[tuple[object, str | None]]) -> list[WuManber]:
    """One search for each length of pattern."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item_id, text in items:
        for window in windows(text):
            by_length.setdefault(len(window), {}).setdefault(window, set()).add("null" if item_id is None else str(item_id))
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: its ``id_cols``, n_words, n_hit, n_items, items_sha256, items, contaminated.

    ``docs`` needs ``text``, ``benchmark`` needs ``item_id`` and ``text``.
    """
    items = benchmark.select("item_id", "text").where(F.length("text") > 0)
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    found = _held(docs, [tuple(r) for r in items.collect()], id_cols) if chars <= HELD_CHARS else _joined(docs, items, id_cols)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _held(docs: DataFrame, items: list[tuple[object, str | None]], id_cols: tuple[str, ...]) -> DataFrame:
    """The narrow pass: every worker holds the items."""
    kinds, n_ids = dict(docs.dtypes), len(id_cols)

    def make():
        found = searchers(items)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, hits, owners = [], [], []
            for text in batch.column(n_ids):
                ws, own = words(text.as_py()), set()
                hit = bytearray(len(ws))
                for search in found:
                    m, run = search.length, b"\1" * search.length
                    for start, who in search.search(ws):
                        hit[start : start + m] = run
                        own |= who
                n.append(len(ws))
                hits.append(hit.count(1))
                owners.append(sorted(own))
            made = [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(map(len, owners), pa.int64())]
            made += [pa.array([hashlib.sha256(",".join(o).encode()).hexdigest() for o in owners], pa.string()), pa.array(owners, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_ids)), *made], names=[*id_cols, "n_words", "n_hit", "n_items", "items_sha256", "items"])

        return step

    ids = "".join(f"`{c}` {kinds[c]}, " for c in id_cols)
    rows = docs.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(id_cols)), "text")
    return map_batches(rows, make, f"{ids}n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, items array<string>")


# -- benchmarks beyond what a worker holds -------------------------------------------------------
def _slot(block: bytes, slots: int) -> int:
    return xxhash.xxh64_intdigest(block) % slots


def _patterns(items: DataFrame) -> DataFrame:
    """m, window (its words, joined), item: the windows of all items."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(len(w), b" ".join(w).decode(), "null" if i is None else i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for w in dict.fromkeys(windows(t.as_py()))]
        m, window, item = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(window, pa.string()), pa.array(item, pa.string())], names=["m", "window", "item"])

    return cut(map_batches(items.select(F.col("item_id").cast("string"), "text"), lambda: step, "m int, window string, item string").distinct(), "windows")


def _shifts(patterns: DataFrame) -> dict[int, np.ndarray]:
    """By length of pattern, the shift of every slot: at most ``WINDOW`` tables of ``SLOTS`` bytes reach the driver."""
    slots = SLOTS

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = set()
        for m, window in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ws, b = window.encode().split(b" "), min(BLOCK, m)
            out |= {(m, _slot(b" ".join(ws[end - b : end]), slots), m - end) for end in range(b, m + 1)}
        m, slot, shift = zip(*sorted(out), strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(slot, pa.int32()), pa.array(shift, pa.int32())], names=["m", "slot", "shift"])

    shifts = map_batches(patterns.select("m", "window").distinct(), lambda: step, "m int, slot int, shift int").groupBy("m", "slot").agg(F.min("shift").alias("shift"))
    pages = shifts.groupBy("m", F.expr("slot div 4096").alias("page")).agg(F.collect_list("slot").alias("slots"), F.collect_list("shift").alias("shifts"))
    tables: dict[int, np.ndarray] = {}
    for r in pages.toLocalIterator():
        table = tables.setdefault(r["m"], np.full(slots, r["m"] - min(BLOCK, r["m"]) + 1, np.uint8))
        table[r["slots"]] = r["shifts"]
    return tables


def _candidates(texts: DataFrame, tables: dict[int, np.ndarray]) -> DataFrame:
    """key, m, start, window of the positions that no shift table rules out."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, lengths, found = [], [], []
        for text in batch.column(1):
            ws, own = words(text.as_py()), []
            for m, table in tables.items():
                b, end = min(BLOCK, m), m
                while end <= len(ws):
                    shift = int(table[_slot(b" ".join(ws[end - b : end]), len(table))])
                    if not shift:
                        own.append((m, end - m, b" ".join(ws[end - m : end]).decode()))
                    end += shift or 1
            for column, x in zip((lengths, starts, found), zip(*own, strict=True) if own else ((), (), ()), strict=True):
                column.append(x)
        columns = [batch.column(0), pa.array(lengths, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "m", "start", "window"])

    rows = map_batches(texts, lambda: step, "key string, m array<int>, start array<int>, window array<string>")
    return rows.select("key", F.inline(F.arrays_zip("m", "start", "window")))


def _key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _joined(docs: DataFrame, items: DataFrame, id_cols: tuple[str, ...]) -> DataFrame:
    """Candidates of the documents' texts against the windows as a table; hits belong to texts, by digest."""
    patterns = _patterns(items)
    texts = docs.select(_key(F.col("text")).alias("key"), "text").where("text is not null")
    found = cut(_candidates(texts, _shifts(patterns)).join(patterns, ["m", "window"]).select("key", "m", "start", "item").distinct(), "hits")
    # words under any of the sorted spans: each adds what lies beyond the furthest end so far
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("m")).alias("end"))))
    n_hit = "aggregate(spans, struct(0 as far, 0L as n), (s, x) -> struct(greatest(s.far, x.end) as far, s.n + greatest(0, x.end - greatest(s.far, x.start)) as n), s -> s.n)"
    by_text = found.groupBy("key").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    by_text = cut(by_text.select("key", F.expr(n_hit).alias("n_hit"), "items"), "contaminated")
    few = by_text.count() <= BROADCAST_TEXTS
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))).cast("bigint")
    rows = docs.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(id_cols)), _key(F.col("text")).alias("key"), F.coalesce(n_words, F.lit(0).cast("bigint")).alias("n_words"))
    out = rows.join(F.broadcast(by_text) if few else by_text, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        *(F.col(f"__{i}").alias(c) for i, c in enumerate(id_cols)),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "items",
    )
