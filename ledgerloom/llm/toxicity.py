"""Toxicity by a learned lexicon, its misspellings and their context.

Terms come from labelled documents: words whose presence makes the label far likelier, supported
by unlike documents (copies and near copies of one text count once).  A Levenshtein automaton of
bounded distance, transpositions included, is intersected with the trie of the terms and
determinised as text is read, so a word costs one table look-up a character.  Each hit is weighed
by the words around it: a hit inside quotation marks or after a word of reporting counts little,
one after a word of address more.  A logistic function of the weighed hits gives the score.

The sample that is learned from is bounded (``TRAIN_ROWS``), so its terms are too.  Every whole text
is scored, in one narrow pass.

Defined results: a null text is empty; an empty text gets the score of a text without hits;
without a usable label of each kind the weights keep their starting values; repeated rows are
scored again, each on its own row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches
from .labelled import held_out, training_rows

#: Labelled documents to learn from, unlike toxic documents and log odds that a term needs.
TRAIN_ROWS, SUPPORT, LOG_ODDS = 8_000, 4, 3.0
#: Words around a hit that say how it is meant; weights of hits in quotation, after address, misspelled.
AROUND, QUOTED, ADDRESSED, MISSPELLED = 5, 0.15, 1.25, 0.8
#: Words a Python worker remembers, and automaton states it keeps.
SEEN_WORDS, STATES = 100_000, 100_000

# Plain insults that need no learning; words of reporting and of address.
SEED_TERMS = "asshole bastard bitch cretin dickhead disgusting dumbass fuck fucker fucking idiot imbecile jackass loser moron motherfucker pathetic retard scumbag shithead stupid trash worthless".split()
REPORTING = frozenset("said says say called calls call calling wrote writes quoted quote quotes word words term terms insult insults slur phrase dit disait mot mots terme appelle sagte sagt nannte wort wörter begriff dijo dice llamó palabra palabras término".split())
ADDRESS = frozenset("you your you're youre ur u are such these those tu toi vous es du dich dein ihr seid sie eres usted ustedes".split())
QUOTES = "\"'“”„‟«»‘’‚`"

_TOKEN = re.compile(r"\w+")
_LEET = str.maketrans("0134578$@", "oieastbsa")


def allowed(term: str) -> int:
    """Edits within which a word counts as a misspelling."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Trie of terms with a lazily determinised Levenshtein automaton over it."""

    def __init__(self, terms: list[str], fuzzy: set[str] | None = None):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.within = [allowed(t) if fuzzy is None or t in fuzzy else 0 for t in terms]
        self.room: list[int] = [0]  # the most edits that any term below allows
        for i, term in enumerate(terms):
            node = 0
            self.room[0] = max(self.room[0], self.within[i])
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], self.within[i])
            self.term_at[node] = i
        self._reset()

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._state(self._closed({(0, ""): 0}))

    def _closed(self, positions: dict[tuple[int, str], int]) -> frozenset:
        """Add the positions that skipping letters of a term reaches."""
        todo = list(positions.items())
        while todo:
            (node, waits), e = todo.pop()
            if waits or positions.get((node, waits), 9) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and positions.get((child, ""), 9) > e + 1:
                    positions[child, ""] = e + 1
                    todo.append(((child, ""), e + 1))
        return frozenset((node, waits, e) for (node, waits), e in positions.items())

    def _state(self, positions: frozenset) -> int:
        if (n := self.number.get(positions)) is None:
            n = self.number[positions] = len(self.states)
            ends = [(e, self.term_at[node]) for node, waits, e in positions if not waits and self.term_at[node] >= 0 and e <= self.within[self.term_at[node]]]
            self.states.append(positions)
            self.moves.append({})
            self.found.append(min(ends) if ends else None)
        return n

    def _move(self, state: int, c: str) -> int:
        out: dict[tuple[int, str], int] = {}

        def reach(node: int, waits: str, e: int) -> None:
            if e <= self.room[node] and out.get((node, waits), 9) > e or e == 0:
                out[node, waits] = min(e, out.get((node, waits), 9))

        for node, waits, e in self.states[state]:
            if waits:
                if waits == c:
                    reach(node, "", e)
                continue
            reach(node, "", e + 1)  # a letter too many
            for x, child in self.children[node].items():
                if x == c:
                    reach(child, "", e)
                else:
                    reach(child, "", e + 1)  # another letter
                    if (far := self.children[child].get(c)) is not None:
                        reach(far, x, e + 1)  # two letters in the wrong order
        return self._state(self._closed(out))

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the nearest term within its distance."""
        if len(self.states) > STATES:
            self._reset()
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            if to is None:
                to = moves[state][c] = self._move(state, c)
                moves = self.moves
            state = to
            if not self.states[state]:
                return None
        return self.found[state]


class Reader:
    """Finds the hits of texts, remembering the words it has met."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.seen, self.hits = lexicon, set(), {}

    def read(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and for each hit: term, edits, weight of its context."""
        low = text.lower()
        words = _TOKEN.findall(low)
        distinct = set(words)
        for w in distinct - self.seen:
            plain = w.translate(_LEET) if not w.isalpha() else w
            if (m := self.lexicon.match(plain)) or plain is not w and (m := self.lexicon.match(w)):
                self.hits[w] = m
        if len(self.seen) > SEEN_WORDS:
            self.seen = set()
        self.seen |= distinct
        there = distinct & self.hits.keys()
        if not there:
            return len(words), []
        out, at = [], [m.span() for m in _TOKEN.finditer(low)]
        for i, w in enumerate(words):
            if w in there:
                edits, term = self.hits[w][0], self.hits[w][1]
                out.append((term, edits, self._context(low, words, at, i)))
        return len(words), out

    @staticmethod
    def _context(low: str, words: list[str], at: list[tuple[int, int]], i: int) -> float:
        first, last = max(0, i - AROUND), min(len(words) - 1, i + AROUND)
        before, after = low[at[first][0] : at[i][0]], low[at[i][1] : at[last][1] + 1]
        apart = re.compile(rf"(?<!\w)[{QUOTES}]|[{QUOTES}](?!\w)")
        if apart.search(before) and apart.search(after) or REPORTING & {*words[max(0, i - 3) : i]}:
            return QUOTED
        return ADDRESSED if ADDRESS & {*words[max(0, i - 2) : i], *words[i + 1 : i + 2]} else 1.0


def learn_terms(train: DataFrame) -> list[str]:
    """Words far likelier in toxic texts, by log odds over documents."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1))), lambda w: F.rlike(w, F.lit(r"^\p{L}{3,}$")))
    rows = train.select("label", words.alias("words")).withColumn("kin", F.array_min(F.transform("words", lambda w: F.xxhash64(w))))
    sizes = {int(r[0]): r[1] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    # a near copy most often has the same least word hash: count those, not documents
    by_kin = rows.select("label", "kin", F.explode("words").alias("word")).groupBy("word", "kin").agg(F.max("label").alias("toxic"), F.max(1 - F.col("label")).alias("clean"))
    counts = by_kin.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) * (clean + 1) / ((F.col("c") + 0.5) * (toxic + 1)))
    found = counts.where(F.col("t") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= LOG_ODDS)
    return [r["word"] for r in found.orderBy(F.desc(F.col("odds") * F.log1p("t")), "word").collect()]


def _hits_of(rows: DataFrame, keep: list[str], terms: list[str]) -> DataFrame:
    """Rows with their number of words and flat hits: term, edits, context."""

    def make():
        reader = Reader(Lexicon(terms))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            read = [reader.read(t.as_py() or "") for t in batch.column("text")]
            columns = [pa.array([n for n, _ in read], pa.int64()), pa.array([[float(x) for hit in h for x in hit] for _, h in read], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, "n", "hits"])

        return step

    kinds = dict(rows.dtypes)
    return map_batches(rows.select(*keep, "text"), make, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "n bigint", "hits array<double>"]))


def _features(n: int, hits: list[tuple[int, int, float]], fuzzy: set[int] | None) -> list[float]:
    abuse = sum(c * (1.0 if not e else MISSPELLED) for t, e, c in hits if not e or fuzzy is None or t in fuzzy)
    return [1.0, np.log1p(abuse), np.log1p(1000.0 * abuse / max(n, 20))]


class Model:
    """Terms, those whose misspellings count, and the weights of the score."""

    def __init__(self, terms: list[str], fuzzy: set[str], weights: np.ndarray):
        self.terms, self.fuzzy, self.weights = terms, fuzzy, weights


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn terms and weights from at most ``TRAIN_ROWS`` labelled documents."""
    from .common import cut

    train = cut(training_rows(docs, labels, "toxic", TRAIN_ROWS), "toxic-train")
    terms = list(dict.fromkeys([*learn_terms(train), *SEED_TERMS]))
    rows = [(r["label"], r["n"], list(zip(*[iter(r["hits"])] * 3, strict=True))) for r in _hits_of(train, ["label"], terms).collect()]
    clean = sum(1 for y, *_ in rows if y == 0)
    near = np.zeros((2, len(terms)))
    for y, _, hits in rows:
        for t in {int(t) for t, e, _ in hits if e}:
            near[y, t] += 1
    fuzzy = {i for i in range(len(terms)) if near[0, i] <= max(0.0005 * clean, 0.2 * near[1, i])}
    start = np.array([-3.0, 3.0, 0.5])
    if 0 < clean < len(rows):
        x = np.array([_features(n, [(int(t), e, c) for t, e, c in hits], fuzzy) for _, n, hits in rows])
        y = np.array([r[0] for r in rows], float)
        w = start.copy()
        for _ in range(50):  # Newton steps of a logistic regression drawn towards its starting values
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3), x.T @ (y - p) - (w - start))
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        start = w
    return Model(terms, {terms[i] for i in fuzzy}, start)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the ``keep`` columns, score, predicted, n_hits.  ``docs`` needs ``text``."""
    terms, fuzzy, weights = model.terms, model.fuzzy, model.weights
    names = [id_col, *(c for c in keep if c != id_col)]

    def make():
        reader = Reader(Lexicon(terms, fuzzy))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, n_hits = [], []
            for t in batch.column(len(names) if "text" not in names else names.index("text")):
                n, hits = reader.read(t.as_py() or "")
                z = float(np.dot(_features(n, hits, None), weights))
                scores.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
                n_hits.append(len(hits))
            made = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(n_hits, pa.int64())]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], names=[*names, "score", "predicted", "n_hits"])

        return step

    kinds = dict(docs.dtypes)
    rows = docs.select(*names) if "text" in names else docs.select(*names, "text")
    return map_batches(rows, make, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "score double", "predicted int", "n_hits bigint"]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits for every document."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits")
