"""Byte-pair encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of each distinct word.  A proposal is the encoding that
rank-ordered merging would give exactly when every token encodes to itself and every adjacent pair
is *compatible*: no merge across the border of the pair comes before the merges that build its two
sides.  Those checks run for all adjacent pairs of a batch at once in numpy; only words that fail
them are merged exactly.

Words repeat, so each task keeps the encodings of the words it has met, in two generations of up
to ``CACHE_WORDS`` entries: when the younger is full it becomes the older, and what the older held
unused is forgotten.  Memory is bounded whatever the corpus, and a worker that goes on to other
work keeps the tokenizer's tables alone.

Defined results: a null text counts as empty; an empty text has no tokens; control strings of the
tokenizer inside a text become its special tokens, as in the library's own default.  Characters
beyond U+024F are composed, lower-cased and classed by the library's tables, so it has to be there.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches, pieces

#: Words whose encodings a task keeps in each of two generations; characters of texts that are split into words at once.
CACHE_WORDS, SPLIT_CHARS = 100_000, 300_000
END = "</w>"
#: Letters up to U+024F after lower-casing, and white space as the vocabulary's own pattern has it.
LATIN, SPACE = "a-zªµºß-öø-ÿĀ-ɏ", " \\t\\n\\x0b\\x0c\\r\\x85\\xa0"
#: Texts of these characters only can be split by the standard library's faster matcher.
PLAIN = re.compile("[\\x00-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-ɏ]*")
PLAIN_WORDS = re.compile(f"[{LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^0-9{LATIN}{SPACE}]+")
#: The only pattern of words that ``PLAIN_WORDS`` restates.
RESTATED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [of[b] for b in range(256)]


class WordBpe:
    """A tokenizer of the word-end kind (``tokenizers`` JSON file), re-expressed as speculate and verify."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        size = max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens: list[str] = [""] * size
        for text, i in self.vocab.items():
            self.tokens[i] = text
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.tokens[i] = text
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words, self.restated = regex.compile(pattern), pattern == RESTATED
        self.alphabet = byte_alphabet()
        self.final = {t.removesuffix(END): i for t, i in self.vocab.items() if t.endswith(END)}
        self.longest = max(map(len, self.final), default=0)
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(END)}
        lengths: dict[str, set[int]] = {}
        for t in self.inner:
            lengths.setdefault(t[:3], set()).add(len(t))
        for t in [t for t in lengths if len(t) == 3]:
            lengths[t] |= {1} | ({2} if t[:2] in self.inner else set())
        for t in [t for t in lengths if len(t) == 2]:
            lengths[t] |= {1}
        self.lengths = {t: tuple(sorted(n, reverse=True)) for t, n in lengths.items()}

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = len(self.tokens)
        self.rank = np.full(n, -1, np.int64)  # -1: not made by a merge
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        keys, made = [], []
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
            self.merge_of[x, y] = (r, z)
            keys.append((x << 32) | y)
            made.append(r)
        order = np.argsort(keys) if keys else np.zeros(0, np.int64)
        self.made = np.array([z for _, z in sorted(self.merge_of.values())] or [0], np.int64)  # by rank
        self.keys, self.ranks = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.known = self._self_encoding()
        self.cache: dict[str | int, bytes] = {}
        self.older: dict[str | int, bytes] = {}

    # -- verification -------------------------------------------------------------------------
    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a very large number where there is none."""
        if not len(self.keys):
            return np.full(len(x), 1 << 60)
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], 1 << 60)

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: does merging in rank order leave the border between them uncrossed?

        Undoes the merges of both sides from the latest to the earliest.  At each state the two
        tokens at the border must have no merge ranked before the one just undone; among equal
        ranks the leftmost goes first, so on the right side an equal rank crosses as well.
        """
        x, y = x.copy(), y.copy()
        limit = np.full(len(x), 1 << 59) if limit is None else limit.copy()
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            crossed = self._merge_rank(x[live], y[live]) < limit[live]
            good[live[crossed]] = False
            live = live[~crossed]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            more = np.maximum(rx, ry) >= 0
            live, rx, ry = live[more], rx[more], ry[more]
            of_left = rx > ry
            a, b = live[of_left], live[~of_left]
            limit[a], limit[b] = rx[of_left], ry[~of_left] + 1
            x[a], y[b] = self.right[x[a]], self.left[y[b]]
        return good

    def _self_encoding(self) -> np.ndarray:
        """Which tokens merging would rebuild from their own characters."""
        good, made = np.ones(len(self.tokens), bool), np.flatnonzero(self.rank >= 0)
        good[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        reach = self.rank >= 0
        for i, t in enumerate(self.tokens):
            if not reach[i] and len(t.removesuffix(END) or t) > 1:
                good[i] = False
        while True:
            now = good & good[self.left] & good[self.right]
            if (now == good).all():
                return now
            good = now

    # -- speculation --------------------------------------------------------------------------
    def _propose(self, s: str) -> list[int]:
        """Greedy longest match over the word's characters; empty when a character has no token."""
        final, inner, lengths, longest, n, i, out = self.final, self.inner, self.lengths, self.longest, len(s), 0, []
        while True:
            if n - i <= longest and (t := final.get(s[i:])) is not None:  # no token is longer: nothing of a long word is copied
                out.append(t)
                return out
            for k in lengths.get(s[i : i + 3]) or lengths.get(s[i : i + 2]) or lengths.get(s[i : i + 1], ()):
                if i + k < n and (t := inner.get(s[i : i + k])) is not None:
                    break
            else:
                return []
            out.append(t)
            i += k

    def _merge_all(self, words: list[str]) -> list[list[int]]:
        """Exact rank-ordered merging of many words at once: each round applies the first best merge of every word."""
        out: list[list[int]] = [[]] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 8), (9, 16), (17, 32)):  # words of like lengths share a matrix
            some = np.flatnonzero((size >= low) & (size <= high))
            for block in np.array_split(some, len(some) // 20_000 + 1):
                for i, ids in zip(block.tolist(), self._merge_block([words[i] for i in block.tolist()]), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(size > 32).tolist():
            out[i] = self._merge(words[i])
        return out

    def _merge_block(self, words: list[str]) -> list[list[int]]:
        if not words:
            return []
        inner, final = self.inner, self.final
        rows = [[*map(inner.get, w[:-1]), final.get(w[-1])] for w in words]
        rows = [r if None not in r else [t for t in r if t is not None] for r in rows]
        n, wide = np.array([len(r) for r in rows]), max(2, max(map(len, rows)))
        sym = np.full((len(rows), wide), -1, np.int64)
        sym[np.arange(wide) < n[:, None]] = [t for r in rows for t in r]
        none, width = 1 << 60, np.arange(wide - 1)
        rank = np.full((len(rows), wide - 1), none)
        there = width < n[:, None] - 1
        rank[there] = self._merge_rank(sym[:, :-1][there], sym[:, 1:][there])
        live = np.arange(len(rows))
        while len(live):
            at = rank[live].argmin(1)
            best = rank[live, at]
            live, at, best = live[best < none], at[best < none], best[best < none]
            if not len(live):
                break
            s, r = sym[live], rank[live]
            moved = width >= at[:, None]  # everything after the merged pair moves up by one
            s[:, :-1] = np.where(moved, s[:, 1:], s[:, :-1])
            s[:, -1] = -1
            s[np.arange(len(live)), at] = self.made[best]
            r[:, :-1] = np.where(moved[:, :-1], r[:, 1:], r[:, :-1])
            r[:, -1] = none
            for where in (at - 1, at):
                ok = (where >= 0) & (where < wide - 1)
                i, w = np.flatnonzero(ok), where[ok]
                y = s[i, w + 1]
                r[i, w] = np.where(y >= 0, self._merge_rank(s[i, w], np.maximum(y, 0)), none)
            sym[live], rank[live] = s, r
        return [[t for t in r if t >= 0] for r in sym.tolist()]

    def _merge(self, s: str) -> list[int]:
        """Exact rank-ordered merging of one long word, with a heap over a linked list of symbols."""
        sym = [*map(self.inner.get, s[:-1]), self.final.get(s[-1])]
        sym = [t for t in sym if t is not None]
        n = len(sym)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*m, i, sym[i], sym[i + 1]) for i in range(n - 1) if (m := self.merge_of.get((sym[i], sym[i + 1])))]
        heap = [(r, i, z, a, b) for r, z, i, a, b in heap]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, z, a, b = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j], nxt[i] = z, True, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
                if m := self.merge_of.get((z, sym[nxt[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], z, sym[nxt[i]]))
            if (p := prv[i]) >= 0 and (m := self.merge_of.get((sym[p], z))):
                heapq.heappush(heap, (m[0], p, m[1], sym[p], z))
        return [t for t, dead in zip(sym, gone, strict=True) if not dead]

    def learn(self, words: set[str]) -> int:
        """Encode words that the cache lacks; returns how many had to be merged exactly."""
        alphabet = self.alphabet
        shown = [w if w.isascii() and w.isalnum() else "".join(map(alphabet.__getitem__, w.encode())) for w in words]
        proposed = [self._propose(s) for s in shown]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(proposed)), sizes)
        bad = np.zeros(len(proposed), bool)
        bad[sizes == 0] = True
        bad[of[~self.known[flat]]] = True
        inside = of[1:] == of[:-1]
        pairs, back = np.unique((flat[:-1][inside] << 32) | flat[1:][inside], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        bad[of[1:][inside][~fits[back]]] = True
        wrong = np.flatnonzero(bad).tolist()
        for i, ids in zip(wrong, self._merge_all([shown[i] for i in wrong]), strict=True):
            proposed[i] = ids
        ends = np.cumsum([4 * len(p) for p in proposed]).tolist()
        ids, start = np.array([t for p in proposed for t in p], "<u4").tobytes(), 0
        for w, end in zip(words, ends, strict=True):
            self.cache[w] = ids[start:end]
            start = end
        return len(wrong)

    # -- texts --------------------------------------------------------------------------------
    def _split(self, text: str) -> list[str | int]:
        """The words of a text in order; special tokens stand as their ids."""
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                low = part.lower() if (plain := PLAIN.fullmatch(part)) else exact_lower(part)
                out += (self.words if not self.restated else PLAIN_WORDS if plain and PLAIN.fullmatch(low) else exact_words()).findall(low)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._split(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        fresh = {w for w in set().union(*split) if w not in cache}
        if again := fresh & older.keys():
            cache.update((w, older[w]) for w in again)
            fresh -= again
        marks = {w for w in fresh if isinstance(w, int)}
        for w in marks:
            cache[w] = np.array([w], "<u4").tobytes()
        if fresh := fresh - marks:
            self.learn(fresh)
        return [b"".join(map(cache.__getitem__, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens kept: this vocabulary has no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def exact_lower(text: str) -> str:
    """Composed and lower-cased by the tokenizers library's own tables, which are newer than Python's.

    Composition and lower case of the letters up to U+024F are alike in all versions of the standard.
    """
    compose, lower = _normalizers()
    return lower(compose(text))


@lru_cache(maxsize=1)
def _normalizers():
    from tokenizers import normalizers

    return normalizers.NFC().normalize_str, normalizers.Lowercase().normalize_str


@lru_cache(maxsize=1)
def exact_words() -> re.Pattern:
    """``RESTATED`` with letters, numbers and spaces as the tokenizers library itself classes them.

    Matchers know different versions of the standard's tables; asking the library once for every
    character leaves no difference.
    """
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)

    def members(pattern: str) -> str:
        return _ranges("".join(part for part, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)))

    letters, numbers, spaces = (members(p) for p in (r"[\p{L}]+", r"[\p{N}]+", r"[\s]+"))
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{letters}{numbers}{spaces}]+")


def _ranges(characters: str) -> str:
    """A matcher's class of the given ordered characters."""
    out: list[list[int]] = []
    for x in map(ord, characters):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in out)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def of_task(path: str) -> WordBpe:
    """The worker's tokenizer with caches of its own, which go with it."""
    own = copy.copy(tokenizer(path))
    own.cache, own.older = {}, {}
    return own


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: id, ids (array), n_tokens, ids_sha256, decoded, decoded_sha256.

    Narrow: one pass without a shuffle.  Repeated rows are encoded again, each on its own row.
    """
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, ids binary, n_tokens bigint, ids_sha256 string, decoded string, decoded_sha256 string"
    return map_batches(docs.select(id_col, text_col), _encoder(vocabulary, True), schema)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with only the digests leaving Python."""
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(id_col, text_col), _encoder(vocabulary, False), schema)


def _encoder(vocabulary: str, whole: bool):
    def make():
        bpe = of_task(vocabulary)
        return lambda batch: _encoded(batch, bpe, whole)

    return make


def _encoded(batch: pa.RecordBatch, bpe: WordBpe, whole: bool) -> pa.RecordBatch:
    texts = [t or "" for t in batch.column(1).to_pylist()]
    ids, n, a, out, b = [], [], [], [], []
    for start, end in pieces(texts, SPLIT_CHARS):
        for x in bpe.encode_batch(texts[start:end]):
            text = bpe.decode(x)
            n.append(len(x) // 4)
            a.append(hashlib.sha256(x).hexdigest())
            b.append(hashlib.sha256(text.encode()).hexdigest())
            if whole:
                ids.append(x)
                out.append(text)
    columns = [batch.column(0), *([pa.array(ids, pa.binary())] if whole else []), pa.array(n, pa.int64()), pa.array(a, pa.string()), *([pa.array(out, pa.string())] if whole else []), pa.array(b, pa.string())]
    names = [batch.schema.names[0], *(["ids"] if whole else []), "n_tokens", "ids_sha256", *(["decoded"] if whole else []), "decoded_sha256"]
    return pa.RecordBatch.from_arrays(columns, names=names)
