"""Row labels of statements: normalisation and the predicates that skip rows which are no line items."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Misread characters in labels, replaced in this order.
MISREADINGS = [
    ("fina nee", "finance"), ("benefi ts", "benefits"), ("empl oyee", "employee"), ("operati ons", "operations"),
    ("equival ents", "equivalents"), ("invent ories", "inventories"), ("recei vables", "receivables"), ("paya bles", "payables"),
    ("taxa tion", "taxation"), ("depre ciation", "depreciation"), ("amorti sation", "amortization"), ("amorti zation", "amortization"),
    ("l+ll", "i+ii"), ("lntcrcst", "interest"), ("e<1uity", "equity"), ("capit:1i", "capital"),
    ("profil", "profit"), ("ror the", "for the"), ("exce1uional", "exceptional"), ("tcm1ination", "termination"),
    ("tennination", "termination"), ("oflcasc", "of lease"), ("contrncts", "contracts"), ("lmpainnent", "impairment"),
    ("lmpairmcnt", "impairment"), ("co11ected", "collected"), ("pe1iod", "period"), ("cmtent", "current"),
    ("vvritten", "written"), ("mitten", "written"), ("vrith", "with"), ("proft", "profit"),
    ("impainnent", "impairment"), ("ofloans", "of loans"),
]

# What surrounds a label, in the order in which it goes.
AROUND = [
    r"^(?:\(?\d+\)?|\(?[ivxlcdm]+\)?|\([a-z]\)|[a-z][.)])[.:-]?\s+",
    r"[\(\[]\s*(?:unaudited|audited|standalone|consolidated|restated|continuing\s+operations|refer\s+note.*?|note.*?|(?:₹|rs\.?|inr).*?|in\s+(?:crores?|millions?|lakhs?|thousands?))\s*[\)\]]",
    r"\b(?:₹|rs\.?|inr)\s*(?:in\s+)?(?:crores?|millions?|lakhs?|thousands?)\b",
    r"[\(\[]\d+[\)\]]$",
    r"(?:[/_\s]+\d{2,4}\\?)+\s*$",
    r"[*#†%]+",
]
# Labels that are no line items.
SKIPPED = ["", "-", "nil", "n/a", "total", "sub total", "subtotal", "particulars", "s.no.", "note", "owners of the parent", "owners of the subsidiary", "non-controlling interests"]
SKIPPED_PHRASES = ["deferred revenue", "contract liabilities", "segment revenue"]
# Misread words in lines of figures, longest first.
TYPOS = [("Advcniscmcnt", "Advertisement"), ("amonisation", "amortisation"), ("ofs tock", "of stock"), ("benefi1s", "benefits"), ("EmpIoyee", "Employee"), ("DeIivery", "Delivery"), ("reIated", "related"), ("incomc", "income"), ("COSIS", "costs"), ("TotaI", "Total"), ("saIes", "sales"), ("Ill", "III"), ("ll", "II"), ("l", "I")]


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    """Compatibility forms and case folded: no built-in function does that."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def normal_label(text: Column, unicode_forms: bool = False) -> Column:
    """A label in the form that the registry's aliases have.

    With ``unicode_forms`` compatibility characters fold as well, in an Arrow batch function;
    without, lower-casing keeps the expression inside the JVM.
    """
    out = _folded(text) if unicode_forms else F.lower(text)
    out = F.replace(F.replace(F.replace(out, F.lit("﻿"), F.lit("")), F.lit("​"), F.lit("")), F.lit("\xa0"), F.lit(" "))
    for pattern in AROUND:
        out = F.regexp_replace(out, pattern, "")
    for wrong, right in MISREADINGS:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    out = F.regexp_replace(out, r"\bta\b", "tax")
    out = F.replace(F.replace(out, F.lit("&"), F.lit("and")), F.lit(","), F.lit(" "))
    for pattern, sign in ((r"\s*/\s*", "/"), (r"\s*-\s*", "-"), (r"-{2,}", "-"), (r"^[\s:;,\-•]+", ""), (r"[.:\-,;]+$", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, sign)
    return F.trim(out)


def corrected(text: Column) -> Column:
    """Whole-word corrections of misread words."""
    for wrong, right in TYPOS:
        text = F.regexp_replace(text, rf"\b{wrong}\b", right)
    return text


def label_words(label: Column) -> Column:
    """Distinct words of a normal label, slashes parting words too."""
    return F.array_distinct(F.filter(F.split(label, r"[\s/]+"), lambda w: w != ""))


def skipped_row(description: Column, values: Column) -> Column:
    """Is a row of a statement no line item: prose, a heading, a numeral, or without sensible values?"""
    low = F.lower(F.trim(F.coalesce(description, F.lit(""))))
    sizes = F.transform(F.filter(values, lambda v: v.isNotNull()), F.abs)
    words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    out = ~F.rlike(low, F.lit("[a-z]")) | (F.length(description) > 80) | (words > 12) | low.isin(SKIPPED)
    for phrase in SKIPPED_PHRASES:
        out = out | F.contains(low, F.lit(phrase))
    out = out | F.rlike(low, F.lit(r"^(i{1,3}|iv|v|vi{1,3}|ix|x)$")) | F.rlike(low, F.lit(r"^\d+\s+[£₹a-z]"))
    return out | (F.coalesce(F.array_max(sizes), F.lit(0.0)) > 10_000_000) | ~F.exists(sizes, lambda v: v != 0)
