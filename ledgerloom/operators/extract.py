"""From words and lines of a page to rows of figures and dated records.

A page's words (text, x0, x1, top) are few and its rules look at neighbours, so a page is handled as
a whole by one grouped function; lines of plain text are parsed by expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import TYPOS, corrected
from ..functions.numbers import filing_number
from .layout import COLUMN, FRAGMENT, HEADER, ROW, assign

#: Least figures of a row, columns of a header, annual columns at most, lowest place of a header, reach of a month's year and of a month over a year.
VALUES, COLUMNS, ANNUAL, HIGHEST, YEAR_REACH, MONTH_REACH = 2, 5, 3, 350.0, 40.0, 60.0
_VALUE = r"(?:[(/]?-?[\d,]*\.?\d+[)\\]?|-)"
_DATE = re.compile(r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})")
_MONTH = re.compile(r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_YEAR = re.compile(r"(?i)(?:(?:19|20)\d{2}|fy\s?\d{2})(?:-\d{2,4})?\Z")
_FIGURE = re.compile(r"(?:-?[\d,]*\.?\d+|I|-)\Z")
_STRIPPED = ".,()[]*#"


class Word(NamedTuple):
    text: str
    x0: float
    x1: float
    top: float


class Period(NamedTuple):
    """A column of a statement: the right edge of its header, its fiscal year and quarter (None: annual)."""

    x: float
    fiscal_year: int
    quarter: str | None


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parse_line(line: Column) -> Column:
    """Struct of description and values of a line of text; null without a description and two trailing figures."""
    text = F.regexp_replace(line, r"(?i)\(refer note \d+\)", "")
    misread = F.lit(rf"\b(?:{'|'.join(wrong for wrong, _ in TYPOS)})\b")
    text = _let(text, lambda t: F.when(F.rlike(t, misread), corrected(t)).otherwise(t))
    text = F.regexp_replace(text, r"^(I{1,3}|IV|V|VI{1,3}|IX|X)\.?\s+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\bI(?=\s\d{3}(?:\s|$))", "1"), r"(?<=\d) (?=\d{3}(?:[^\d]|$))", "")
    last = lambda parts: F.coalesce(F.array_max(F.transform(parts, lambda p, i: F.when(~F.rlike(p, F.lit(f"^{_VALUE}$")), i))), F.lit(-1))

    def split(parts: Column, last_word: Column) -> Column:
        good = (last_word >= 0) & (F.size(parts) - last_word - 1 >= VALUES)
        figures = F.transform(F.slice(parts, last_word + 2, F.size(parts)), lambda p: _let(p, filing_number))
        return F.when(good, F.struct(F.array_join(F.slice(parts, 1, last_word + 1), " ").alias("description"), figures.alias("values")))

    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    return _let(parts, lambda p: _let(last(p), lambda n: split(p, n)))


def by_top(words: list[Word], tolerance: float) -> list[list[Word]]:
    """Rows in the order of their first words; a word joins the first row whose first word is within the tolerance."""
    rows: list[list[Word]] = []
    for w in words:
        row = next((r for r in rows if abs(r[0].top - w.top) <= tolerance), None)
        if row is None:
            rows.append([w])
        else:
            row.append(w)
    return rows


def fiscal(month: int, year: int) -> tuple[int, str]:
    return year + (month >= 4), f"Q{(month + 8) % 12 // 3 + 1}"


def _spaced(marks: list[tuple[float, Word]]) -> list[tuple]:
    out: list[tuple] = []
    for mark in sorted(marks, key=lambda m: m[0]):
        if not out or mark[0] - out[-1][0] > COLUMN:
            out.append(mark)
    return out


def _numeric_dates(words: list[Word]) -> list[tuple[Word, int, int]]:
    found = ((w, _DATE.search(w.text.strip(_STRIPPED))) for w in words)
    return [(w, int(m[2]), int(m[3])) for w, m in found if m and 1 <= int(m[2]) <= 12 and int(m[3]) > 2000]


def _named_dates(words: list[Word]) -> list[tuple[Word, int, int]]:
    """Month, day, year in adjacent words of one row; of rows near the top the one with the most, two at least."""
    best: list[tuple[Word, int, int]] = []
    for row in by_top(words, ROW):
        found, ordered = [], sorted(row, key=lambda w: w.x0)
        for i, w in enumerate(ordered):
            if not (m := _MONTH.match(w.text.strip(_STRIPPED))):
                continue
            end = w.x1
            for nxt in ordered[i + 1 : i + 4]:
                if nxt.x0 - end > YEAR_REACH:
                    break
                if re.fullmatch(r"(19|20)\d{2}", year := nxt.text.strip(_STRIPPED)):
                    found.append((Word(w.text, w.x0, nxt.x1, row[0].top), _MONTHS.index(m[1].lower()) + 1, int(year)))
                    break
                end = nxt.x1
        if len(found) >= 2 and row[0].top <= HIGHEST and len(found) > len(best):
            best = found
    return best


def columns_of(words: list[Word]) -> list[Period]:
    """The columns of a statement from its header: numeric dates, else month names, else bare years.

    Up to three columns are annual.  Of more, the first three are quarters (this, the one before, the
    same a year ago) and the rest annual.
    """
    dates = _numeric_dates(words) or _named_dates(words)
    if dates:
        of = {id(w): (m, y) for w, m, y in dates}
        header = max(by_top([w for w, _, _ in dates], HEADER), key=len)
        kept = _spaced([(w.x0, w) for w in header])
        out = []
        for i, (_, w) in enumerate(kept[:COLUMNS]):
            year, quarter = fiscal(*of[id(w)])
            out.append(Period(w.x1, year, None if len(kept) <= ANNUAL or i >= 3 else quarter))
        return out
    years = [w for w in words if _YEAR.match(w.text.strip(_STRIPPED))]
    if not years:
        return []
    header = max(by_top(years, HEADER), key=len)
    kept = [w for _, w in _spaced([(w.x0, w) for w in header])]
    number = [2000 + int(t[2:].strip()[:2]) if (t := w.text.strip(_STRIPPED).upper()).startswith("FY") else int(t[:4]) for w in kept]
    if len(kept) <= ANNUAL:
        if len(set(number)) < len(number):  # a repeated year was misread: count down from the first
            number = [number[0] - i for i in range(len(number))]
        return [Period(w.x1, n, None) for w, n in zip(kept, number, strict=True)]
    near = [(abs((w.x0 + w.x1) / 2 - kept[0].x1), m) for w in words if abs(w.top - header[0].top) < MONTH_REACH and (m := _MONTH.search(w.text))]
    near = [x for x in near if x[0] < MONTH_REACH]
    month = _MONTHS.index(min(near, key=lambda x: x[0])[1][1].lower()) + 1 if near else 3
    year, quarter = fiscal(month, number[0])
    q = int(quarter[1])
    periods = [(year, quarter), (year - 1 if q == 1 else year, f"Q{q - 1 or 4}"), (year - 1, quarter), (year, None), (year - 1, None)]
    return [Period(w.x1, *p) for w, p in zip(kept, periods, strict=False)]


def clusters_of(row: list[Word]) -> list[list[Word]]:
    """Figures of a row, fragments of one number together."""
    out: list[list[Word]] = []
    for w in sorted(row, key=lambda w: w.x0):
        if out and w.x0 - out[-1][-1].x1 <= FRAGMENT:
            out[-1].append(w)
        else:
            out.append([w])
    return out


def is_figure(w: Word) -> bool:
    return bool(_FIGURE.match(w.text.strip().strip("()")))


def full_row(words: list[Word], n: int, below: float) -> list[float] | None:
    """Right edges of the first row under the header that fills every column: truer than the header's own."""
    for row in sorted(by_top(words, ROW), key=lambda r: r[0].top):
        if below < row[0].top <= below + 400 and any(not is_figure(w) for w in row) and len(c := clusters_of([w for w in row if is_figure(w)])) == n:
            return [max(w.x1 for w in x) for x in c]
    return None


def _value(cluster: list[Word]) -> str:
    texts = [w.text.strip() for w in cluster]
    with_commas = [t for t in texts if "," in t]
    return max(with_commas, key=len) if with_commas else "".join("1" if t == "I" else t for t in texts)


def rows_of_figures(words: list[Word], columns: list[Period]) -> list[tuple[str, list[str | None]]]:
    """Description and one printed figure for each column, for rows with two at least, from the first mention of revenue, income or a sale on."""
    edges = [c.x for c in columns]
    tolerance = 0.95 * min(b - a for a, b in zip(edges, edges[1:], strict=False)) / 2 if len(edges) > 1 else 25.0
    out, started = [], False
    for row in sorted(by_top(words, ROW), key=lambda r: r[0].top):
        row = sorted(row, key=lambda w: w.x0)
        started = started or bool(re.search("revenue|income|sale", " ".join(w.text for w in row).lower()))
        if not started:
            continue
        figures = clusters_of([w for w in row if is_figure(w)])
        placed = assign([max(w.x1 for w in c) for c in figures], edges, tolerance)
        if len(placed) < VALUES:
            continue
        told = [w.text for w in row if not is_figure(w)] + [w.text for i, c in enumerate(figures) if i not in placed for w in c]
        description = " ".join(told).strip()
        for wrong, right in TYPOS:
            description = re.sub(rf"\b{wrong}\b", right, description)
        if description:
            by_column = {j: figures[i] for i, j in placed.items()}
            out.append((description, [_value(by_column[j]) if j in by_column else None for j in range(len(columns))]))
    return out


def page_records(words: DataFrame) -> DataFrame:
    """doc, page, row_no, label, fiscal_year, quarter, value from words (doc, page, ord, text, x0, x1, top)."""
    kinds = dict(words.dtypes)

    def one_page(page: pd.DataFrame) -> pd.DataFrame:
        found = [Word(*r) for r in page.sort_values("ord")[["text", "x0", "x1", "top"]].itertuples(index=False)]
        columns, out = columns_of(found), []
        if columns:
            header = min((w.top for w in found if any(abs(w.x1 - c.x) < 0.01 for c in columns)), default=0.0)
            if edges := full_row(found, len(columns), header):
                columns = [c._replace(x=x) for c, x in zip(columns, edges, strict=True)]
            for n, (label, figures) in enumerate(rows_of_figures(found, columns)):
                out += [(page["doc"].iloc[0], page["page"].iloc[0], n, label, c.fiscal_year, c.quarter, f) for c, f in zip(columns, figures, strict=True) if f is not None]
        return pd.DataFrame(out, columns=["doc", "page", "row_no", "label", "fiscal_year", "quarter", "figure"])

    rows = words.groupBy("doc", "page").applyInPandas(one_page, f"doc {kinds['doc']}, page {kinds['page']}, row_no int, label string, fiscal_year int, quarter string, figure string")
    return rows.withColumn("value", filing_number(F.col("figure"))).drop("figure").where("value is not null")
