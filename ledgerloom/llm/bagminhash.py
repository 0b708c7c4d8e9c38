"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles.  For each shingle a hierarchy of Poisson
processes, one for each dyadic band of weights ([0,1), [1,2), [2,4), ...), throws points that carry
a time, a register and a weight level; a document takes the points whose level lies under the
shingle's weight, and each register keeps the earliest.  Two documents agree in a register with
the probability of their weighted Jaccard similarity, without bias; points are drawn in the order
of time only as far as all registers need.

Equal texts are one node.  Nodes whose signatures agree in a band share a bucket.  Within a bucket
every node is paired with the bucket's first node alone; pairs whose signatures are close enough
are verified by the exact overlap of their multisets, and verified pairs join classes.  Buckets
that still hold nodes of different classes go on: their nodes are paired with the bucket's most
central node, the one that shares the most buckets with others.  What then still lies outside that
node's class is compared with the bucket's nodes of other classes by longer signatures, each pair in
the first band that it shares, and close pairs are verified.  So every pair that any band proposes
is verified, too far apart or already within one class, while a large group of near copies costs
pairs in proportion to its size.

Defined results: null texts are empty; texts of fewer than five words are one shingle; texts
without words are duplicates only of equal texts; repeated rows share a class; a class is named by
its least doc_id, a null id counting only if there is no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, map_batches, pieces

#: Words of a shingle, least similarity, registers of a signature, registers of a band.
SHINGLE, SIMILARITY, REGISTERS, ROWS = 5, 0.8, 128, 5
BANDS = REGISTERS // ROWS
#: Registers of the longer signatures of texts that stay apart in crowded buckets; deviations that signatures worth verifying may be off.
LONG_REGISTERS, DEVIATIONS = 1024, 4.77
#: Nodes from which on a bucket is crowded: its one row is broadcast to them; nodes of a block of pairs in such a bucket.
CROWDED, BLOCK = 256, 512
#: Words whose hashes a Python worker keeps; nodes that are few enough to broadcast (16 bytes each; a quarter as many wider rows).
SEEN_WORDS, BROADCAST_NODES = 50_000, 500_000

_U = np.uint64
_LETTERS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def split(text: str) -> list[bytes]:
    """Lower-case runs of letters and digits."""
    return text.lower().encode().translate(_LETTERS).split()


class Shingler:
    """Hashes of words and shingles, with the words' hashes remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: str) -> np.ndarray:
        return self.hashes(split(text))

    def hashes(self, ws: list[bytes]) -> np.ndarray:
        known = self.known
        for w in set(ws):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        out = np.fromiter(map(known.__getitem__, ws), _U, len(ws))
        if len(known) > SEEN_WORDS:
            known.clear()
        return out

    def shingles(self, text: str) -> np.ndarray:
        """One hash for each shingle occurrence."""
        w = self.words(text)
        if not len(w):
            return w
        k = min(SHINGLE, len(w))
        n = len(w) - k + 1
        total = np.full(n, k, _U)
        for j in range(k):
            total = total * _U(0x9DDFEA08EB382D69) + w[j : j + n] * _FACTORS[j]
        return mix(total)


def signatures(documents: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers of each multiset of shingle hashes (none may be empty): times as 64-bit patterns."""
    with np.errstate(over="ignore"):
        sizes = np.array([len(d) for d in documents])
        doc, h = np.repeat(np.arange(len(documents)), sizes), np.concatenate(documents)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
        weight = np.diff(np.r_[first, len(h)])
        doc, h = doc[first], h[first]
        out = np.full((len(documents), registers), np.inf)
        horizon = (np.log(registers) + 4) * registers / sizes  # time by which the registers are full, most likely
        todo = np.arange(len(documents))
        while len(todo):
            # small documents need many points of each shingle: those are drawn in blocks
            block = np.zeros(len(documents), np.int64)
            block[todo] = np.minimum(64, 4 ** np.ceil(np.log(np.maximum(1, horizon[todo] / 3)) / np.log(4))).astype(np.int64)
            of = block[doc]
            for b in np.unique(block[todo]).tolist():
                some = of == b
                _throw(out.reshape(-1), registers, doc[some], h[some], weight[some], horizon, b)
            todo = np.flatnonzero(np.isinf(out).any(1))
            horizon[todo] *= 2
            out[todo] = np.inf
        return out.view(_U)


def _throw(earliest: np.ndarray, registers: int, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, horizon: np.ndarray, block: int) -> None:
    """All points up to each document's horizon, band by band of weights, ``block`` points of a shingle at a time."""
    band, low, width, steps = 0, 0, 1, np.arange(1, block + 1, dtype=_U) * _FACTORS[1]
    while len(doc):
        seed = mix(h + _U(band + 1) * _FACTORS[0])
        live, time, base, until, most = np.arange(len(doc)), np.zeros(len(doc)), doc * registers, horizon[doc], weight
        while len(live):
            r = mix((seed[:, None] + steps).reshape(-1))
            gap = -np.log1p((r >> _U(11)).astype(np.float64) * -(2.0**-53)) / width
            times = gap.reshape(-1, block).cumsum(1) + time[:, None] if block > 1 else (gap + time).reshape(-1, 1)
            early = np.flatnonzero((times <= until[:, None]).reshape(-1))
            own = early if block == 1 else early // block
            r = mix(r[early] ^ _FACTORS[2])
            at, t = base[own] + (r % _U(registers)).astype(np.int64), times.reshape(-1)[early]
            if width > 1:
                taken = low + (r >> _U(40)).astype(np.float64) * (2.0**-24 * width) < most[own]
                at, t = at[taken], t[taken]
            np.minimum.at(earliest, at, t)
            on = np.flatnonzero(times[:, -1] <= until)
            live, time, base, until, most = live[on], times[on, -1], base[on], until[on], most[on]
            seed = seed[on] + _U(block) * _FACTORS[1]
        low, band = low + width, band + 1
        more = weight > low
        doc, h, weight = doc[more], h[more], weight[more]
        width = low


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingle hashes."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def node_of(text: Column) -> Column:
    """128 bits of the text's digest: equal texts are one node."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, node, planes (signature in two bits a register), bands (hash of each band; none for texts without words)."""

    def make():
        shingler = Shingler()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t.as_py() or "" for t in batch.column(2)]
            planes, bands = [], []
            for start, end in pieces(texts, 300_000):
                sets = [shingler.shingles(t) for t in texts[start:end]]
                full = [s for s in sets if len(s)]
                registers = iter(_packed(signatures(full)) if full else ())
                for s in sets:
                    p, b = next(registers) if len(s) else ([], [])
                    planes.append(p)
                    bands.append(b)
            columns = [batch.column(0), batch.column(1), pa.array(planes, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "planes", "bands"])

        return step

    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"), "text")
    return map_batches(rows, make, f"doc_id {dict(docs.dtypes)['doc_id']}, node binary, planes array<bigint>, bands array<bigint>")


def _planes(bits: np.ndarray) -> np.ndarray:
    """Two bits of each register, packed into whole numbers plane by plane."""
    return np.concatenate([np.packbits((bits >> _U(k) & _U(1)).astype(np.uint8), axis=1) for k in (7, 8)], axis=1).copy().view(np.int64)


def _packed(registers: np.ndarray) -> list[tuple[list[int], list[int]]]:
    with np.errstate(over="ignore"):
        bits = mix(registers)
        planes = _planes(bits)
        bands = np.zeros((len(registers), BANDS), _U)
        for j in range(ROWS):
            bands = mix(bands * _FACTORS[3] + bits[:, j : BANDS * ROWS : ROWS])
        bands = mix(bands + np.arange(1, BANDS + 1, dtype=_U) * _FACTORS[4]).view(np.int64)
    return list(zip(planes.tolist(), bands.tolist(), strict=True))


def differ(registers: int, similarity: float) -> int:
    """Registers that differ, in two bits each, between signatures of texts of the given similarity, most likely at most."""
    p = (1 - similarity) * 3 / 4
    return int(registers * p + DEVIATIONS * (registers * p * (1 - p)) ** 0.5)


def _close(a: str, b: str, similarity: float, registers: int = REGISTERS) -> Column:
    """Do two signatures differ in few enough registers?"""
    half = registers // 64
    return F.expr(" + ".join(f"bit_count(({a}[{i}] ^ {b}[{i}]) | ({a}[{i + half}] ^ {b}[{i + half}]))" for i in range(half)) + f" <= {differ(registers, similarity)}")


class Bags:
    """Multisets of the texts met last, up to a number of shingles."""

    def __init__(self, similarity: float = SIMILARITY, most: int = 1_000_000):
        self.shingler, self.similarity, self.most, self.held, self.total = Shingler(), similarity, most, {}, 0

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        bag = self.held.get(text)
        if bag is None:
            all_ = self.shingler.shingles(text)
            bag = (*np.unique(all_, return_counts=True), len(all_))
            if self.total > self.most:
                self.held, self.total = {}, 0
            self.held[text] = bag
            self.total += len(bag[0])
        return bag

    def similar(self, a: str, b: str) -> bool:
        """Is the weighted Jaccard similarity of two texts enough?"""
        (x, n, p), (y, m, q) = sorted((self.of(a), self.of(b)), key=lambda t: len(t[0]))
        if min(p, q) < self.similarity * max(p, q) or not len(x):
            return False
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        same = y[at] == x
        both = int(np.minimum(n[same], m[at[same]]).sum())
        return both >= self.similarity * (p + q - both)


def few(df: DataFrame, wide: bool = False) -> bool:
    """Has ``df`` few enough rows (``wide``: of more than a node or two) to broadcast it?"""
    return df.count() <= BROADCAST_NODES // (4 if wide else 1)


def small(df: DataFrame, wide: bool = False) -> DataFrame:
    """``df``, marked to be broadcast where it has few rows."""
    return F.broadcast(df) if few(df, wide) else df


def beside(pairs: DataFrame, nodes: DataFrame, side: str, columns: list[str], written: DataFrame | None = None) -> DataFrame:
    """``pairs`` (a, b) with ``columns`` of the node on one side, named for it; ``written`` is the table that they come from.

    A head or a centre is in as many pairs as its bucket has nodes.  A node of more than ``CROWDED``
    pairs has its row copied once for so many pairs, and its pairs are dealt over the copies; which
    nodes these are is broadcast to the pairs.  What counts as crowded rises until they are few enough.
    """
    counts, least = (pairs if written is None else written).groupBy(side).agg(F.count("*").alias("n")), CROWDED
    while (crowded := counts.where(F.col("n") >= least)).count() > BROADCAST_NODES:
        least *= 4
    copies = F.ceil(F.col("n") / CROWDED).cast("int")
    rows = pairs.join(F.broadcast(crowded.select(side, copies.alias("copies"))), side, "left")
    salt = F.pmod(F.xxhash64("b" if side == "a" else "a"), F.coalesce("copies", F.lit(1))).cast("int")
    held = counts.select(side, F.when(F.col("n") >= least, copies).otherwise(1).alias("copies"))
    held = held.join(nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")).drop("copies")
    return rows.withColumn("salt", salt).drop("copies").join(held, [side, "salt"]).drop("salt")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with text_a and text_b.

    Few pairs are broadcast to the texts, so that only their second texts are met in a shuffle: there a
    node of more than ``CROWDED`` pairs has its row copied, as in ``beside``, which many pairs take twice.
    """
    if not few(pairs, wide=True):
        return beside(beside(pairs, texts, "a", ["text"]), texts, "b", ["text"], pairs)
    crowded = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= CROWDED)
    crowded = F.broadcast(crowded.select("b", F.ceil(F.col("n") / CROWDED).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    rows = texts.toDF("a", "text_a").join(F.broadcast(pairs), "a").join(crowded, "b", "left")
    rows = rows.select("a", "b", "text_a", F.pmod(F.xxhash64("a"), copies).cast("int").alias("salt"))
    held = texts.toDF("b", "text_b").join(F.broadcast(pairs.select("b")), "b", "left_semi").join(crowded, "b", "left")
    return rows.join(held.select("b", "text_b", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt")), ["b", "salt"])


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b: nodes) whose texts' multisets overlap by ``similarity`` or more; ``texts`` has the nodes' texts."""

    def make():
        bags = Bags(similarity)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = [bags.similar(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return step

    return cut(map_batches(_with_texts(pairs, texts).select("a", "b", "text_a", "text_b"), make, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, class (its least node) for every node with a link: least labels spread, and labels of labels are followed.

    They end when both nodes of every link have one label: a node's label is a node of its component and
    no greater than itself, so then it is the least.  Labels of few nodes are broadcast, so that a round
    is one shuffle; others meet their links by joins.
    """
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
    labels = ends.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("class"))
    held = F.broadcast if few(ends) else (lambda df: df)
    while True:
        near = ends.join(held(labels.toDF("other", "theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        spread = near.join(held(labels), "node").select("node", F.least("class", "theirs").alias("now"))
        jump = held(labels.toDF("now", "further"))
        labels = cut(spread.join(jump, "now", "left").select("node", F.least("now", "further").alias("class")), "labels")
        apart = links.join(held(labels.toDF("a", "class_a")), "a").join(held(labels.toDF("b", "class_b")), "b").where("class_a != class_b")
        if apart.isEmpty():
            return labels


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes with more links: only the links between classes go through ``components``."""
    held = F.broadcast if few(classes) else (lambda df: df)
    ends = links.join(held(classes.toDF("a", "class_a")), "a", "left").join(held(classes.toDF("b", "class_b")), "b", "left")
    ends = cut(ends.select("a", "b", F.coalesce("class_a", "a").alias("class_a"), F.coalesce("class_b", "b").alias("class_b")), "class-links")
    up = components(ends.where("class_a != class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))).toDF("class", "higher")
    every = classes.union(ends.select("a", "class_a")).union(ends.select("b", "class_b")).distinct()
    return cut(every.join(held(up), "class", "left").select("node", F.coalesce("higher", "class").alias("class")), "classes")


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the given nodes."""
    texts = docs.select(node_of(F.col("text")).alias("node"), "text").join(small(nodes), "node", "left_semi")
    return cut(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")


def longer(texts: DataFrame) -> DataFrame:
    """node, long: a signature of ``LONG_REGISTERS`` for each of the nodes with their texts."""

    def make():
        shingler = Shingler()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            long, texts = [], batch.column(1).to_pylist()
            with np.errstate(over="ignore"):
                for start, end in pieces(texts, 100_000):
                    long += _planes(mix(signatures([shingler.shingles(t) for t in texts[start:end]], LONG_REGISTERS))).tolist()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(long, pa.list_(pa.int64()))], names=["node", "long"])

        return step

    return cut(map_batches(texts, make, "node binary, long array<bigint>"), "long")


def meet(rows: DataFrame, groups: DataFrame, key: str = "bucket") -> DataFrame:
    """``rows`` joined with ``groups``, which has one row a bucket, or class, with the number ``n`` of its rows.

    Few groups are broadcast.  Else rows of crowded groups stay where they are, as those few groups'
    rows are broadcast to them, so no group is dealt to one task; the others are shuffled.  What counts
    as crowded rises until the crowded groups are few enough.
    """
    if few(groups, wide=True):
        return rows.join(F.broadcast(groups), key)
    least = CROWDED
    while (crowded := groups.where(F.col("n") >= least)).count() > BROADCAST_NODES:
        least *= 4
    rest = rows.join(F.broadcast(crowded.select(key)), key, "left_anti").join(groups.where(F.col("n") < least), key)
    return rows.join(F.broadcast(crowded), key).unionByName(rest)


def _met(rows: DataFrame, groups: DataFrame, name: str, know_few: bool) -> DataFrame:
    """``meet`` for groups that are not written yet: known to be few, they are broadcast as they are, else written first."""
    return rows.join(F.broadcast(groups), "bucket") if know_few else meet(rows, cut(groups, name))


def _rest(left: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, know_few: bool) -> DataFrame:
    """Pairs (a, b) of nodes outside their bucket's central class with the bucket's nodes of other classes, where all signatures are close.

    A pair comes from the first band that it shares.  Large buckets are dealt in blocks: each block
    of the one side meets each block of the other under a key of its own.
    """
    mixed = left.select("node").distinct()
    mixed = F.broadcast(mixed) if know_few else small(cut(mixed, "mixed-nodes"))
    known = longer(texts.join(mixed, "node", "left_semi")).join(nodes.select("node", "planes", "bands"), "node")
    centre = left.groupBy("bucket").agg(F.max_by("class", F.struct("weight", "node")).alias("centre"), F.count("*").alias("n"))
    rows = cut(_met(left.select("bucket", "node", "class"), centre, "centre-classes", know_few), "blocks")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own, every = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))

    def side(some: DataFrame, x: str) -> DataFrame:
        return some.join(known, "node").select("bucket", "block_a", "block_b", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("class", "planes", "bands", "long")))

    one = side(rows.where(F.col("class") != F.col("centre")).select("bucket", "node", "class", own.alias("block_a"), every.alias("block_b")), "a")
    two = side(rows.select("bucket", "node", "class", every.alias("block_a"), own.alias("block_b")), "b")
    first_shared = F.expr("element_at(bands_a, cast(array_position(zip_with(bands_a, bands_b, (x, y) -> x = y), true) as int)) = bucket")
    pairs = one.join(two, ["bucket", "block_a", "block_b"])
    close = _close("planes_a", "planes_b", similarity) & _close("long_a", "long_b", similarity, LONG_REGISTERS)
    return pairs.where((F.col("class_a") != F.col("class_b")) & close & first_shared)


def _named(signed: DataFrame, nodes: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, node, class of every row of ``signed``.

    A text that is one row's alone and in no link names itself, so only the others are written and,
    where they are few, broadcast to the rows.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    held = F.broadcast if few(classes) else (lambda df: df)
    named = nodes.select("node", "first", "copies").join(held(classes.join(degree, "node")), "node", "left")
    named = named.select("node", "first", "copies", F.coalesce("class", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("class").isNotNull().alias("linked"))
    shared = cut(named.where("copies > 1 or linked"), "named")
    names = cut(shared.groupBy("class").agg(F.min("first").alias("class_id"), F.count("*").alias("n")), "names")
    named = meet(shared, names, "class").select("node", "class", "class_id", "n_links", F.col("copies").alias("n"))
    columns = "doc_id", "class_id", "n_links", "node", "class"
    if few(shared, wide=True):
        rows = signed.select("doc_id", "node").join(F.broadcast(named.drop("n")), "node", "left")
        own = F.col("class").isNull()
        return rows.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "node", F.coalesce("class", "node").alias("class"))
    named = cut(named, "named-nodes")
    alone = signed.select("doc_id", "node").join(named.select("node"), "node", "left_anti")
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "node", F.col("node").alias("class"))
    return meet(signed.select("doc_id", "node"), named, "node").select(*columns).union(alone.select(*columns))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (verified links of its text), node, class: one row for each row of ``docs``.

    ``class`` (its least node) tells classes apart; ``class_id`` is a label, which classes share where
    ids are null or repeated.  ``docs`` needs ``doc_id`` and ``text``.

    On tables of some GB most time goes by rounds, not by rows, so what is counted and found few is
    broadcast, unwritten where it is used once, and shuffles are left to what brings rows together.
    """
    signed = cut(sign(docs), "signed")
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("planes").alias("planes"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "nodes")
    entries = nodes.select("node", "planes", F.explode("bands").alias("bucket"))
    heads = cut(entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"), "heads")
    few_buckets = few(heads, wide=True)
    headed = nodes.select(F.col("node").alias("head"), F.col("planes").alias("planes_head")).join(F.broadcast(heads) if few_buckets else heads, "head")
    members = _met(entries, headed, "heads-planes", few_buckets)
    star = (F.col("node") != F.col("head")) & _close("planes", "planes_head", similarity)
    members = cut(members.select("bucket", "node", "planes", F.col("n").alias("size"), "head", star.alias("star")), "members")
    pairs = cut(members.where("star").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    needed = cut(members.select("node").distinct(), "needed")
    know_few = few_buckets and few(needed)
    texts = texts_of(needed, docs)
    links = verify(pairs, texts, similarity)
    classes = components(links)

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def untried(rows: DataFrame, name: str) -> DataFrame:
        return cut(in_order(rows).join(small(tried, wide=True), ["a", "b"], "left_anti").distinct(), name)

    def mixed(rows: DataFrame, name: str) -> DataFrame:
        """Rows of the buckets that hold several classes, with their classes and the number of nodes."""
        now = rows.join(small(classes), "node", "left").withColumn("class", F.coalesce("class", "node"))
        now = now if know_few else cut(now, f"{name}-classes")
        several = now.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).where("low != high")
        return cut(_met(now, several.select("bucket", "n"), f"{name}-buckets", know_few), name)

    tried = in_order(pairs)
    left = mixed(members.select("bucket", "node", "planes", "size"), "mixed")
    weights = left.groupBy("node").agg(F.sum("size").alias("weight"))
    left = cut(left.drop("size").join(F.broadcast(weights) if know_few else weights, "node"), "weighed")
    centre = left.groupBy("bucket").agg(F.max(F.struct("weight", "node", "planes", "class")).alias("c"), F.first("n").alias("n"))
    centre = centre.select("bucket", "n", F.col("c.node").alias("b"), F.col("c.planes").alias("planes_b"), F.col("c.class").alias("class_b"))
    near = _met(left.select("bucket", F.col("node").alias("a"), F.col("planes").alias("planes_a"), F.col("class").alias("class_a")), centre, "centres", know_few)
    near = near.where((F.col("class_a") != F.col("class_b")) & _close("planes_a", "planes_b", similarity))
    more = untried(near, "central-pairs")
    if not more.isEmpty():
        found = verify(more, texts, similarity)
        tried, links, classes = tried.union(more), links.union(found), merged(classes, found)
    left = mixed(left.select("bucket", "node", "weight"), "mixed-again")
    if not left.isEmpty():
        more = untried(_rest(left.drop("n"), nodes, texts, similarity, know_few), "rest-pairs")
        if not more.isEmpty():
            found = verify(more, texts, similarity)
            links, classes = links.union(found), merged(classes, found)
    return _named(signed, nodes, classes, links)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the one that names it; one without an id only where no other has one."""
    found = cut(near_duplicates(docs, similarity), "classes")
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = cut(found.groupBy("class").agg(F.min(ranked).alias("best"), F.count("*").alias("n")), "best")
    rows = found.groupBy("doc_id", "node").agg(F.first("class").alias("class"), F.count("*").alias("copies"))
    gone = meet(rows, best, "class").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node"))))
    gone = cut(gone.select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node")), "gone")
    few = gone.count() <= BROADCAST_NODES
    marked = docs.withColumn("__node", node_of(F.col("text")))
    kept = marked.join(F.broadcast(gone) if few else gone, marked["doc_id"].eqNullSafe(F.col("gone_id")) & (F.col("__node") == F.col("gone_node")), "left_anti")
    if not rows.where("copies > 1").isEmpty():  # rows that repeat id and text
        kept = kept.dropDuplicates(["doc_id", "__node"])
    return kept.select(*docs.columns)
