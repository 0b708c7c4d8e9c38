"""The k best rows of each question by inner product, as a pass of Arrow batches over blocks of questions.

A batch meets all questions of a block in one matrix product.  What a product, with the most that its
rounding can be off, does not rule out is scored again in the order in which ``retrieval.dot`` adds,
so scores and ties are those of a plain expression.  A task keeps k rows a question and gives no more.

Sums of words' weights (``sum_weights``) go the same way: a matrix product for common words, sparse sums for the others.

Odd rows: NaN is above all numbers, and a score of a null component is null and below them.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs whose products a worker holds at once; chunks whose words' weights it holds at once; what rounding to six places moves at most, twice.
PAIRS, CHUNKS, UNIT = 1 << 19, 512, 1e-6
#: Words whose weights are summed by a matrix product; questions, and words of questions, of a round.
OWN, ASKED, TERMS = 160, 128, 1 << 13


def _matrix(vectors: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length n, none null, as doubles, and which of them hold a null component."""
    flat = pc.cast(vectors.flatten(), pa.float64(), safe=False)
    null = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(vectors), n).any(axis=1)
    return flat.to_numpy(zero_copy_only=False).reshape(len(vectors), n), null


def give_back() -> None:
    """Return a worker's freed memory to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class _Best:
    """The k best rows of each of some questions so far, by the questions' places; ``limit`` is what a row has to reach."""

    def __init__(self, ids: pa.Array, k: int):
        self.ids, self.k, self.held, self.pending = ids, k, [], 0
        self.limit = np.full(len(ids), -np.inf)

    def add(self, place: np.ndarray, ids: pa.Array, score: np.ndarray, null: np.ndarray) -> None:
        self.held.append((place, ids, score, null))
        self.pending += len(place)
        if self.pending > self.k * len(self.ids):
            self.settle()

    def settle(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Only the k best rows of each question stay: places, ids, scores, and which scores are null."""
        if not self.held:
            return np.zeros(0, int), self.ids[:0], np.zeros(0), np.zeros(0, bool)
        place, score, null = (np.concatenate([h[i] for h in self.held]) for i in (0, 2, 3))
        ids = pa.concat_arrays([h[1] for h in self.held])
        kind = np.where(null, 2, np.where(np.isnan(score), 0, 1))
        order = np.lexsort((_ranks(ids), np.where(kind == 1, -score, 0), kind, place))
        nth = _nth(place[order])
        last = order[nth == self.k - 1]
        self.limit[place[last]] = np.choose(kind[last], [np.inf, score[last], -np.inf])
        keep = order[nth < self.k]
        self.held, self.pending = [(place[keep], ids.take(pa.array(keep)), score[keep], null[keep])], 0
        return self.held[0]

    def told(self) -> Iterator[pa.RecordBatch]:
        place, ids, score, null = self.settle()
        if len(place):
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(place)), ids, pa.array(score, mask=null)], ["query_id", "chunk_id", "score"])


class _Block(_Best):
    """Questions of one length."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, n: int, k: int):
        super().__init__(ids, k)
        self.n = n
        self.vectors, self.null = _matrix(vectors, n)
        self.turned, self.norm = self.vectors.T.copy(), np.linalg.norm(self.vectors, axis=1)

    def take(self, ids: pa.Array, vectors: pa.Array) -> None:
        whole, null = _matrix(vectors, self.n)
        whole, null, ids = self._firsts(whole, null, ids)
        step = max(1, PAIRS // len(self.ids))
        with np.errstate(all="ignore"):
            for at in range(0, len(whole), step):
                self._take(ids, at, whole[at : at + step], null[at : at + step])

    def _firsts(self, whole: np.ndarray, null: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Of equal vectors the k of the smallest ids: the others score alike and rank below them."""
        if not self.n or null.any():
            return whole, null, ids
        _, same = np.unique(np.ascontiguousarray(whole).view(f"V{8 * self.n}")[:, 0], return_inverse=True)
        if same.max() + 1 == len(same):
            return whole, null, ids
        order = np.lexsort((_ranks(ids), same))
        keep = np.sort(order[_nth(same[order]) < self.k])
        return whole[keep], null[keep], ids.take(pa.array(keep))

    def _take(self, ids: pa.Array, at: int, rows: np.ndarray, null: np.ndarray) -> None:
        products = rows @ self.turned
        products[null], products[:, self.null] = -np.inf, -np.inf
        off = (self.n + 4) * 2.0**-51 * np.linalg.norm(rows, axis=1)
        slack = np.outer(off, self.norm) + 1e-300
        slack[null], slack[:, self.null] = 0, 0
        open_ = ~(products < self.limit - slack)
        if len(rows) > self.k and np.count_nonzero(open_) > 2 * self.k * len(self.ids):
            kth = np.partition(products - slack, len(rows) - self.k, axis=0)[len(rows) - self.k]
            open_ &= ~(products + slack < kth)
        row, place = np.nonzero(open_)
        if not len(row):
            return
        score, turned = np.zeros(len(row)), rows.T
        for i in range(self.n):
            score += turned[i][row] * self.turned[i][place]
        self.add(place, ids.take(pa.array(row + at)), score, null[row] | self.null[place])


def _ranks(ids: pa.Array) -> np.ndarray:
    return pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)


def _nth(groups: np.ndarray) -> np.ndarray:
    """The number of each element in its run of equal ones."""
    at = np.arange(len(groups))
    starts = np.where(np.r_[True, groups[1:] != groups[:-1]], at, 0) if len(groups) else at
    return at - np.maximum.accumulate(starts) if len(groups) else at


def scan(query_ids: pa.Array, asked: pa.Array, k: int):
    """For ``mapInArrow`` over rows (chunk_id, embedding): query_id, chunk_id, score of each question's k best rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = asked.value_lengths()
        blocks = []
        for n in pc.unique(lengths.drop_null()).to_pylist():
            of = pc.fill_null(pc.equal(lengths, n), False)
            blocks.append(_Block(query_ids.filter(of), asked.filter(of), n, k))
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            lengths_ = vectors.value_lengths()
            for block in blocks:
                of = pc.fill_null(pc.equal(lengths_, block.n), False)
                if pc.any(of).as_py():
                    block.take(ids.filter(of), vectors.filter(of))
        for block in blocks:
            yield from block.told()

    return run


class _Sums(_Best):
    """Questions as sets of words; chunks come as words with weights, none negative, and a score is a sum of weights.

    Chunks go through in groups of ``CHUNKS``, questions in rounds of few.  The ``OWN`` words that weigh most in
    the work, common in questions and chunks, are a matrix product; the others are added one by one,
    as few chunks have them.  These sums are in single precision: what they, with the most that they can
    be off, do not rule out is summed again in doubles, in the order of the question's words, and rounded to six places.
    """

    def __init__(self, ids: pa.Array, terms: list[np.ndarray], common: np.ndarray, k: int):
        """``common`` says of every word how many chunks have it."""
        super().__init__(ids, k)
        self.sizes, self.flat, self.n_words = np.array([len(t) for t in terms], int), np.concatenate([*terms, np.zeros(0, int)]).astype(int), len(common)
        self.starts = np.r_[0, self.sizes.cumsum()]
        work = common * np.bincount(self.flat, minlength=self.n_words)
        own = np.argsort(-work, kind="stable")[:OWN]
        self.own = np.full(self.n_words, -1)
        self.own[own] = np.arange(len(own))
        self.rounds, at = [], 0
        while at < len(terms):
            to = max(at + 1, min(at + ASKED, int(np.searchsorted(self.starts, self.starts[at] + TERMS, "right")) - 1))
            word, asker = self.flat[self.starts[at] : self.starts[to]], np.repeat(np.arange(to - at), self.sizes[at:to])
            mine = self.own[word] >= 0
            matrix = np.zeros((to - at, len(own)), np.float32)
            matrix[asker[mine], self.own[word[mine]]] = 1
            self.rounds.append((at, to, matrix, word[~mine], asker[~mine], 1 - (self.sizes[at:to] + 8) * 2.0**-23))
            at = to
        self.row, self.table = np.zeros(self.n_words, int), np.zeros(0)

    def take(self, ids: pa.Array, chunk: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        """Chunks of these ids; entries (place of a chunk, in order; word; weight)."""
        ends = np.searchsorted(chunk, np.arange(0, len(ids) + CHUNKS, CHUNKS))
        for i, at in enumerate(range(0, len(ids), CHUNKS)):
            some = slice(ends[i], ends[i + 1])
            if ends[i] < ends[i + 1]:
                self._take(ids, at, min(CHUNKS, len(ids) - at), chunk[some] - at, word[some], weight[some])

    def _take(self, ids: pa.Array, at: int, width: int, chunk: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        here = np.unique(word)
        self.row[here] = np.arange(1, len(here) + 1)  # row 0 is of words that no chunk of the group has
        if len(self.table) < (len(here) + 1) * width:
            self.table = np.zeros((len(here) + 1) * width)
        cells = self.row[word] * width + chunk
        np.add.at(self.table, cells, weight)
        own, mine = np.zeros((1 + self.own.max(initial=-1), width), np.float32), self.own[word] >= 0
        np.add.at(own, (self.own[word[mine]], chunk[mine]), weight[mine].astype(np.float32))
        order = np.argsort(word[~mine], kind="stable")
        rare, column, single = word[~mine][order], chunk[~mine][order].astype(np.int32), weight[~mine][order].astype(np.float32)
        n = np.bincount(rare, minlength=self.n_words)
        first = n.cumsum() - n
        for start, to, matrix, words, asker, slack in self.rounds:
            score = matrix @ own
            some = np.flatnonzero(n[words])
            if len(some):
                times = n[words[some]]
                ends = times.cumsum()
                entry = np.arange(ends[-1]) + np.repeat(first[words[some]] - (ends - times), times)
                np.add.at(score.reshape(-1), np.repeat(asker[some] * width, times) + column[entry], single[entry])
            limit = self.limit[start:to]
            least = np.where(limit > 0, (limit - UNIT) * slack, 0).astype(np.float32)
            open_ = (score >= least[:, None]) & (score > 0)
            if width > self.k and np.count_nonzero(open_) > 2 * self.k * (to - start):
                kth = np.partition(score, width - self.k, axis=1)[:, width - self.k]
                open_ &= score >= ((kth * slack - UNIT) * slack).astype(np.float32)[:, None]
            asked, found = np.nonzero(open_)
            if len(asked):
                times = self.sizes[start:to][asked]
                ends = times.cumsum()
                pair = np.repeat(np.arange(len(asked)), times)
                place = np.arange(ends[-1]) + np.repeat(self.starts[start + asked] - (ends - times), times)
                exact = np.bincount(pair, weights=self.table[self.row[self.flat[place]] * width + found[pair]], minlength=len(asked))
                self.add(start + asked, ids.take(pa.array(found + at)), np.round(exact, 6), np.zeros(len(asked), bool))
        self.row[here], self.table[cells] = 0, 0


def entries(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks as lists of (length, words, how often): place of a chunk, in order; its length; word; how often.

    A chunk has several parts where rows share an id: counts of a word add up where lengths agree.
    """
    of = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    n, words, often = parts.flatten().flatten()
    sizes = words.value_lengths().to_numpy(zero_copy_only=False)
    chunk, n, word, tf = np.repeat(of, sizes), np.repeat(n.to_numpy(zero_copy_only=False), sizes), words.flatten().to_numpy(zero_copy_only=False), often.flatten().to_numpy(zero_copy_only=False)
    if len(of) > len(parts):
        keys, back = np.unique(np.stack([chunk, n, word]), axis=1, return_inverse=True)
        chunk, n, word = keys
        tf = np.bincount(back.ravel(), weights=tf, minlength=len(word))
    return chunk, n, word, tf


def spread(n_words: int):
    """For ``mapInArrow`` over rows (chunk_id, parts): word, df, how many of a task's chunks (by id and length) have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_words, int)
        for batch in batches:
            df += np.bincount(entries(batch.column(1))[2], minlength=n_words)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some], pa.int64())], ["word", "df"])

    return run


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (chunk_id, parts) as ids of chunks and ``entries``."""
    for batch in batches:
        yield batch.column(0), *entries(batch.column(1))


def sum_weights(query_ids: pa.Array, terms: list[np.ndarray], common: np.ndarray, weigh, k: int, read=by_chunk):
    """For ``mapInArrow``: query_id, chunk_id, score of each question's k best rows of a task.

    ``terms`` has the places of each question's words, ``weigh`` gives weights of words (word, how often,
    length of the chunk), and ``read`` turns batches into ids and entries of whole chunks.  A score is the sum
    of the weights of the words that both have, rounded to six places, and above zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Sums(query_ids, terms, common, k)
        for ids, chunk, n, word, tf in read(batches):
            best.take(ids, chunk, word, weigh(word, tf, n))
        yield from best.told()
        del best
        give_back()

    return run
