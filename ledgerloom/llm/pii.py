"""Personal data with offsets: plain matching, then matching after normalisation mapped back to the source.

A chain of transducers rewrites a text while carrying, for every character it emits, the span of
source characters that it stands for: look-alike characters become ASCII and invisible ones go;
``[at]``, ``(dot)`` and spoken forms become ``@`` and ``.``; runs of spelled digits become digits.
Spoken forms are those of English, French, German and Spanish.  Words that mean other things as well
count only where an identifier may be: ``point``, ``punkt`` and ``punto`` beside an ``@`` or between
numbers, and ``at`` before a written domain only after what is no common word (``COMMON``).
Identifiers found in the rewritten text are mapped back through those spans, so every reported
offset is one of the source text.  Spans found in the plain text stay as they are; rewriting adds
those that neither lie in a plain span of the kind nor hold one.

Every matcher is linear in the text: candidates start from their rarest character and runs are
taken whole, so long runs of digits or letters cost no more than others.

Defined results: a null text is empty; offsets count code points, ends are exclusive; repeated
rows are scanned again, each on its own row; a text without identifiers has empty results.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")

_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Spelled digits in the four languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
REPEATED = {"double": 2, "triple": 3}
# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχѵӏօ․‧∙•‐‑‒–—−﹣",
        "ABESIJKMHOPCTYXaesijopcyxdqwhABEZHIKMNOPTYXaeikvoptuxvlo....-------",
        strict=True,
    )
)
_INVISIBLE = frozenset("­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿︎️")
_ODD = re.compile("[^\\x00-¬®-ɏ]")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_NUMBER = rf"(?:(?:double|triple)[ \t]+)?(?:{_WORD})"
_RUN = re.compile(rf"(?i)(?<!\w){_NUMBER}(?:[ \t,-]{{1,3}}{_NUMBER})*(?!\w)")
_PLUS = re.compile(rf"(?i)(?<!\w)(?:plus|más)[ \t]+(?=[0-9(]|{_NUMBER}(?!\w))")
# Words for the signs, of which ``dot`` alone is never another word; common words before a spoken "at".
AT_WORDS, DOT_WORDS = "at ät arobase arroba klammeraffe".split(), "dot point punkt punto".split()
COMMON = frozenset(
    "a about all am and are arrive arrived available be been buy call click contact email found from go he her here him hosted i is it join live located look mail me meet more off on online or order out page read see shop site sold starts stay store stop team that the them there they this to us visit was we were work you".split()
)
_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_BRACKET_AT = re.compile(rf"(?i){_OPEN}(?:{_AT}|@){_CLOSE}")
_BRACKET_DOT = re.compile(rf"(?i){_OPEN}(?:{_DOT}|\.){_CLOSE}")
_SPOKEN_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])[ \t]+({_AT})[ \t]+(?=[A-Za-z0-9-]++(?:[ \t]+(?:{_DOT})[ \t]+[A-Za-z0-9-]|(\.)(?:[A-Za-z0-9-]++(?:[ \t]+(?:{_DOT})[ \t]+|\.))*[A-Za-z]{{2}}))")
_LAST_WORD = re.compile(r"[A-Za-z]+\Z|[A-Za-z]+(?=[ \t]*\Z)")
_SPOKEN_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9_%+-])[ \t]+dot[ \t]+(?=[A-Za-z0-9-])")
_GAP = re.compile(rf"(?i)[ \t]+(?:{_DOT})[ \t]+")
_DOMAIN_GAPS = re.compile(rf"(?i)(?<=@)[A-Za-z0-9-]++(?:[ \t]+(?:{_DOT})[ \t]+[A-Za-z0-9-]++)+")
_LOCAL_GAPS_BACKWARDS = re.compile(rf"(?i)(?<=@)[A-Za-z0-9_%+-]++(?:[ \t]+(?:{_DOT[::-1]})[ \t]+[A-Za-z0-9_%+-]++)+")
_NUMBER_GAPS = regex.compile(rf"(?i)(?<=[0-9]|(?<!\w)(?:{_WORD}))[ \t]+(?:{_DOT})[ \t]+(?=[0-9]|(?:{_WORD})(?!\w))")
_AROUND_AT = re.compile(r"(?<=[A-Za-z0-9])[ \t]+@[ \t]*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[ \t]+(?=[A-Za-z0-9-]+\.[A-Za-z])")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """From each ``@``: the characters before it back to the last match, and the domain after it."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            out.append((start, domain.end()))
            free = domain.end()
            at = text.find("@", free)
        else:
            free = max(free, start)
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d // 10 + d % 10 for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def find(text: str) -> dict[str, list[Span]]:
    """Plain spans of each kind."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        found["ip"], found["card"] = ips(text), cards(text)
        if "+" in text:
            found["phone"] = phones(text)
    return found


class Mapped:
    """A text being rewritten; character i stands for source[start[i]:end[i]]."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, pattern: re.Pattern, emit) -> None:
        """Replace each match by the (characters, first, last) pieces that ``emit`` yields; offsets are of the match."""
        out, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            made = emit(m)
            if made is None:
                continue
            a, b = m.span()
            out.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            for chars, s, e in made:
                out.append(chars)
                start += [self.start[a + s]] * len(chars)
                end += [self.end[a + e - 1]] * len(chars)
            at = b
        if at:
            self.text, self.start, self.end = "".join([*out, self.text[at:]]), [*start, *self.start[at:]], [*end, *self.end[at:]]

    def replace(self, spans: list[Span], sign: str) -> None:
        """Replace the given spans, in order, by a sign."""
        out, start, end, at = [], [], [], 0
        for s, e in spans:
            out += [self.text[at:s], sign]
            start += [*self.start[at:s], self.start[s]]
            end += [*self.end[at:s], self.end[e - 1]]
            at = e
        if at:
            self.text, self.start, self.end = "".join([*out, self.text[at:]]), [*start, *self.start[at:]], [*end, *self.end[at:]]

    def span(self, s: int, e: int) -> Span:
        return self.start[s], self.end[e - 1]


def _plain_character(m: re.Match):
    c = m[0]
    if c in _INVISIBLE:
        return []
    c = LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
    return [(c, 0, 1)] if c.isascii() and c.isprintable() else None


def _joined(sign: str):
    return lambda m: [(sign, 0, len(m[0]))]


_SAME = str.maketrans("ſıİ", "sii")
_NUMBERS = re.compile(rf"(?i)(?:(double|triple)[ \t]+)?({_WORD})(?!\w)")


def _low(word: str) -> str:
    """Lower case, with the letters that a matcher takes for ``s`` and ``i`` whatever their case."""
    return word.translate(_SAME).lower()


def _digits(m: re.Match):
    """A run of spelled digits; a single one only beside digits, dots or a plus."""
    words = list(_NUMBERS.finditer(m[0]))
    text, (a, b) = m.string, m.span()
    if len(words) < 2 and not (text[a - 1 : a] in {".", "+"} or text[b : b + 1] in {"."} or text[max(0, a - 2) : a].strip()[-1:].isdigit() or text[b : b + 2].strip()[:1].isdigit()):
        return None
    return [(SPELLED[_low(w[2])] * REPEATED.get(_low(w[1] or ""), 1), w.start(), w.end()) for w in words]


def _spoken_at(m: re.Match):
    """``at`` before a domain with a written dot may be the plain word: it is after a common one."""
    if _low(m[1]) == "at" and m[2]:
        word = _LAST_WORD.search(m.string, max(0, m.start() - 12), m.start())
        if word and word[0].lower() in COMMON:
            return None
    return [("@", 0, len(m[0]))]


# A text of ASCII and Latin letters alone, whose words part at ASCII signs: then its set of words says which rules can apply.
_NO_PLAIN = re.compile("[^\\x00-\\x7fÀ-ÖØ-öø-įĲ-žƀ-ɏ]|[İı]")
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b == 95 or b >= 128 else 32 for b in range(256))


def _all_of(words) -> frozenset[bytes]:
    return frozenset(w.encode() for w in words)


_NUMBER_SET, _PLUS_SET, _AT_SET, _DOT_SET = map(_all_of, (SPELLED, ("plus", "más"), AT_WORDS, DOT_WORDS))


def normalise(text: str) -> Mapped:
    """The rewritten text.  Rules that no word of the text can meet are passed over; that changes no result."""
    out = Mapped(text)
    out.rewrite(_ODD, _plain_character)
    if _NO_PLAIN.search(out.text):
        numbers = plus = ats = dots = True
    else:
        words = set(out.text.lower().encode().translate(_PARTS).split())
        numbers, plus, ats, dots = (not words.isdisjoint(some) for some in (_NUMBER_SET, _PLUS_SET, _AT_SET, _DOT_SET))
    if any(sign in out.text for sign in "[({<"):
        if ats or "@" in out.text:
            out.rewrite(_BRACKET_AT, _joined("@"))
        out.rewrite(_BRACKET_DOT, _joined("."))
    if ats:
        out.rewrite(_SPOKEN_AT, _spoken_at)
    if "@" in out.text:
        out.rewrite(_AROUND_AT, _joined("@"))
    if dots:
        if "@" in out.text:
            out.replace([g.span() for m in _DOMAIN_GAPS.finditer(out.text) for g in _GAP.finditer(out.text, *m.span())], ".")
            back, n = out.text[::-1], len(out.text)
            spans = [(n - m.end(), n - m.start()) for m in _LOCAL_GAPS_BACKWARDS.finditer(back)]
            out.replace([g.span() for a, b in reversed(spans) for g in _GAP.finditer(out.text, a, b)], ".")
        out.rewrite(_SPOKEN_DOT, _joined("."))
        out.rewrite(_NUMBER_GAPS, _joined("."))
    if plus:
        out.rewrite(_PLUS, _joined("+"))
    if numbers:
        out.rewrite(_RUN, _digits)
    return out


def extra(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that show only after rewriting: those that neither lie in a plain span of the kind nor hold one."""
    mapped = normalise(text)
    if mapped.text == text:
        return {k: [] for k in KINDS}
    found = find(mapped.text)
    out = {}
    for kind in KINDS:
        spans = [mapped.span(s, e) for s, e in found[kind]]
        out[kind] = [(s, e) for s, e in spans if not any(a <= s and e <= b or s <= a and b <= e for a, b in plain[kind])]
    return out


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in sorted(spans[kind]))


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first, longest one counts."""
    out, at = [], 0
    for s, minus, kind in sorted((s, -e, kind) for kind in KINDS for s, e in spans[kind]):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = -minus
        elif -minus > at:
            at = -minus
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (plain spans), base_sha256, spans (all), n_extra and, if asked for, the redacted text.

    Narrow: one pass, no shuffle.
    """
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_extra", *(["redacted"] if redacted else [])]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()] + [pa.string()] * redacted

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in names]
        for value in batch.column(1):
            text = value.as_py() or ""
            plain = find(text)
            more = extra(text, plain)
            every = {k: plain[k] + more[k] for k in KINDS}
            row = [*(len(plain[k]) for k in KINDS), hashlib.sha256(listed(plain).encode()).hexdigest(), listed(every), sum(map(len, more.values()))]
            for column, x in zip(columns, [*row, *([redact(text, every)] if redacted else [])], strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *names])

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{n} {'bigint' if n.startswith('n_') else 'string'}" for n in names)
    return map_batches(docs.select(id_col, text_col), lambda: step, schema)
