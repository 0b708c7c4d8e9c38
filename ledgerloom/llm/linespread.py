"""Removal of cross-site boilerplate lines, found by the spread of each line over sites.

Every line's hash gathers HyperLogLog sketches of the sites, the distinct texts and the kinds of
text that it occurs in; sketches merge by aggregation, so a line that a third of all documents
share costs each task one row.  Lines whose estimates are clear of the thresholds are decided by
them; lines near a threshold get exact distinct counts.

A copied document also spreads its lines over sites.  So copies of a text count once, and texts
that hold a line have a kind each, which the rest of the text names: the least hash of all runs of
``SHINGLE`` words outside the line.  Near copies mostly share it, unrelated texts do not, and as
runs are many, that holds at any size.  One least hash may happen to lie in another common line, or
in a word that all copies change, so there are several independent ones, whose kinds are averaged.
A line is boilerplate if it spreads over at least ``SITES`` sites and as many kinds of text, and
its kinds are no fewer than ``KINDS`` of its texts.

Defined results: null texts are empty; lines part at newlines and count trimmed of spaces; lines
of fewer than ``WORDS`` words always stay; a null source is a site of its own; a text whose lines
all go becomes empty; other texts keep their remaining lines unchanged, in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .bagminhash import _FACTORS, SHINGLE, Shingler, mix, split
from .common import cut, map_batches

#: Sites and kinds of text that a boilerplate line reaches; kinds for each text; words of a line.
SITES, KINDS, WORDS = 5, 0.4, 3
#: Precision of the sketches (2^10 registers) and the share of a threshold within which counts are made exact.
LOG_K, NEAR = 10, 0.25
#: Boilerplate lines that are few enough to broadcast (8 bytes each).
BROADCAST_LINES = 100_000
#: Columns of the kinds, one for each order.
KIND = ("kind0", "kind1", "kind2")

_U = np.uint64
#: Factors of the orders of runs, and what parts the lines.
_ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], _U)
_ENDS = [b""] * (SHINGLE - 1)
_NOTHING = _U(2**64 - 1)


def hashed(text: str) -> int:
    """The hash that Spark's ``xxhash64`` gives a string."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def countable(line: str) -> bool:
    """May a trimmed line be boilerplate?"""
    return line.count(" ") >= WORDS - 1


def kinds(parts: list[str], shingler: Shingler) -> list[np.ndarray]:
    """For each order, the least hash of the word runs outside of each of the (unlike) lines of a text.

    Runs do not cross lines; a line with fewer words than a run is one run.
    """
    words = [split(x) for x in parts]
    size = np.array([len(ws) for ws in words])
    width = size + SHINGLE - 1
    ends = np.cumsum(width)
    starts = ends - width
    h = shingler.hashes([w for ws in words for w in (*ws, *_ENDS)])
    runs = sum(h[j : len(h) - SHINGLE + 1 + j] * _FACTORS[j] for j in range(SHINGLE))
    runs = np.append(runs, h[len(runs) :])
    inside = np.arange(len(h)) - np.repeat(starts, width) < np.repeat(np.where(size, np.maximum(1, size - SHINGLE + 1), 0), width)
    out = []
    for factor in _ORDERS:
        x = np.where(inside, mix(runs * factor), _NOTHING)
        least = np.minimum.reduceat(x, starts)
        first = int(least.argmin())
        out.append(np.full(len(parts), least[first]))
        out[-1][first] = np.delete(least, first).min(initial=_NOTHING)
    return [x.view(np.int64) for x in out]


def lines(docs: DataFrame) -> DataFrame:
    """line (hash), site, text (hash), kind0 to kind2 (hashes): a row for each line of each document that may be boilerplate."""

    def make():
        shingler = Shingler()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            site = ["\0" if s is None else s for s in batch.column(0).to_pylist()]
            text, found = [], [[] for _ in range(1 + len(KIND))]
            for t in batch.column(1):
                t = t.as_py() or ""
                text.append(hashed(t))
                parts = list({x.strip(" "): None for x in t.split("\n")})
                at = [i for i, x in enumerate(parts) if countable(x)]
                found[0].append([hashed(parts[i]) for i in at])
                for column, x in zip(found[1:], kinds(parts, shingler) if at else [()] * len(KIND), strict=True):
                    column.append([x[i] for i in at])
            return pa.RecordBatch.from_arrays([pa.array(site, pa.string()), pa.array(text, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in found)], names=["site", "text", "line", *KIND])

        return step

    rows = map_batches(docs.select(F.col("source").cast("string"), "text"), make, "site string, text bigint, line array<bigint>, " + ", ".join(f"{k} array<bigint>" for k in KIND))
    return rows.select("site", "text", F.inline(F.arrays_zip("line", *KIND))).select("line", "site", "text", *KIND)


def _mean_kinds() -> Column:
    return sum(F.col(f"{k}s") for k in KIND) / len(KIND)


def boilerplate(docs: DataFrame) -> DataFrame:
    """line: hashes of the lines to remove."""
    rows = cut(lines(docs), "lines")

    def sketch(column: str) -> Column:
        return F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(LOG_K))).alias(f"{column}s")

    spread = rows.groupBy("line").agg(F.count("*").alias("n"), sketch("site"), sketch("text"), *map(sketch, KIND)).where(F.col("n") >= SITES)
    spread = spread.withColumn("kinds", _mean_kinds())
    low, high = 1 - NEAR, 1 + NEAR
    maybe = spread.where((F.col("sites") >= low * SITES) & (F.col("kinds") >= low * SITES) & (F.col("kinds") >= low * KINDS * F.col("texts")))
    sure = (F.col("sites") >= high * SITES) & (F.col("kinds") >= high * SITES) & (F.col("kinds") >= high * KINDS * F.col("texts"))
    maybe = cut(maybe.select("line", sure.alias("sure")), "spread-lines")
    near = maybe.where("not sure").select("line")
    few = near.count() <= BROADCAST_LINES
    held = cut(rows.join(F.broadcast(near) if few else near, "line", "left_semi"), "near-lines")
    # one distinct count a shuffle, each combined before it
    exact = None
    for c in ("site", "text", *KIND):
        counts = held.select("line", c).distinct().groupBy("line").agg(F.count("*").alias(f"{c}s"))
        exact = exact.join(counts, "line") if exact else counts
    exact = exact.withColumn("kinds", _mean_kinds())
    exact = exact.where((F.col("sites") >= SITES) & (F.col("kinds") >= SITES) & (F.col("kinds") >= KINDS * F.col("texts")))
    return cut(exact.select("line").union(maybe.where("sure").select("line")), "boilerplate")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and n_lines, n_removed beside its columns.

    ``docs`` needs ``text`` and ``source``; columns named n_lines or n_removed are replaced.
    """
    found = boilerplate(docs)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "n_lines bigint", "n_removed bigint"])
    if found.count() <= BROADCAST_LINES:
        everywhere = frozenset(r["line"] for r in found.collect())
        rows = docs.select(*kept, F.lit(None).cast("array<bigint>").alias("__lost"))
    else:  # the lines that each text loses, by a join instead
        everywhere = frozenset()
        key = F.xxhash64(F.coalesce("text", F.lit("")))
        own = lines(docs).select("text", "line").distinct().join(found, "line").groupBy("text").agg(F.collect_set("line").alias("__lost"))
        rows = docs.withColumn("__text", key).join(own.withColumnRenamed("text", "__text"), "__text", "left").select(*kept, "__lost")
    at = kept.index("text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, total, removed = [], [], []
        for t, lost in zip(batch.column(at), batch.column(len(kept)), strict=True):
            text = t.as_py()
            gone = everywhere or frozenset(lost.as_py() or ())
            parts = (text or "").split("\n")
            rest = [x for x in parts if not (countable(y := x.strip(" ")) and hashed(y) in gone)] if gone else parts
            texts.append(text if len(rest) == len(parts) else "\n".join(rest))
            total.append(len(parts))
            removed.append(len(parts) - len(rest))
        columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(kept))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*kept, "n_lines", "n_removed"])

    return map_batches(rows, lambda: step, schema)
