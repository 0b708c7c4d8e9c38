"""Rules over text: query policy, filing gate, claims, direction of change, refusals, page signals.

Rules are tables of patterns, so callers may bring their own.  The patterns are written so that
Java's matcher, Python's and RE2 read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of requests for advice, then of attempts to override instructions; the first match decides.
BLOCKED = [
    ("trading_advice", r"\bshould\s+i\s+(buy|sell|short|invest|hold|exit|enter)\b"),
    ("trading_advice", r"\bwould\s+you\s+recommend\s+(buying|selling|investing|shorting|holding)\b"),
    ("trading_advice", r"\bis\s+it\s+(a\s+good|the\s+right|a\s+bad)\s+time\s+to\s+(buy|sell|invest|exit)\b"),
    ("investment_advice", r"\bis\s+\w+(\s+\w+)?\s+(a\s+good|a\s+great|a\s+bad|a\s+strong)(\s+[\w-]+){0,2}\s+(investment|buy|stock|pick|bet)\b"),
    ("investment_advice", r"\bshould\s+i\s+invest\s+in\b"),
    ("investment_advice", r"\b(worth\s+(buying|selling|investing\s+in|holding)|worth\s+my\s+(money|time|investment))\b"),
    ("price_prediction", r"\bwill\s+(the\s+)?(stock|share|price|scrip)\s+(go\s+up|go\s+down|rise|fall|increase|decrease|rally|crash)\b"),
    ("price_prediction", r"\b(target\s+price|price\s+target)\s+(for|of)\b"),
    ("trading_advice", r"\b(buy\s+or\s+sell|sell\s+or\s+hold|buy\s+signal|sell\s+signal)\b"),
    ("investment_advice", r"\b(is\s+\w+\s+(undervalued|overvalued|fairly\s+valued)|(stock|company|share)\s+is\s+(under|over)valued)\b"),
    ("portfolio_advice", r"\b(add|include|allocate|put)\s+.{0,30}\s+(to|in|into)\s+(my\s+)?(portfolio|holdings|watchlist)\b"),
    ("prompt_injection", r"\bignore\s+(all\s+)?(previous|prior|above|your)\s+(instructions|rules|guidelines|constraints|system)\b"),
    ("prompt_injection", r"\bdisregard\s+(all\s+)?(previous|prior|your)\s+(instructions|rules|guidelines)\b"),
    ("jailbreak", r"\byou\s+are\s+now\s+(a|an)\s+\w+"),
    ("jailbreak", r"\bact\s+as\s+(if\s+you\s+are|a|an)\s+\w+\s+(without|that\s+has\s+no)\s+(restrictions|limitations|guidelines)\b"),
    ("jailbreak", r"\bDAN\b|\bdo\s+anything\s+now\b"),
    ("jailbreak", r"\bpretend\s+(you\s+are|to\s+be)\s+.{0,40}(no\s+restrictions|no\s+limits|no\s+rules)\b"),
    ("prompt_injection", r"\bsystem\s*prompt\b|\bsystem\s*instructions\b"),
]

# Signals of a filing by category, with weights; least score and categories; characters that are read.
GATE_SIGNALS = [
    ("regulatory_citation", r"\bSEBI\b", 2),
    ("regulatory_citation", r"Regulation\s+3[03]", 3),
    ("regulatory_citation", r"Regulation\s+52", 3),
    ("regulatory_citation", r"Listing Obligations and Disclosure Requirements", 3),
    ("regulatory_citation", r"\bLODR\b", 2),
    ("statement_type", r"Financial Results", 3),
    ("statement_type", r"Statement of Profit and Loss", 3),
    ("statement_type", r"Statement of.*Financial Results", 3),
    ("statement_type", r"Balance Sheet", 2),
    ("statement_type", r"Segment Information", 2),
    ("audit_and_accounting", r"Ind\s?AS[\s-]?\d*", 2),
    ("audit_and_accounting", r"Auditor'?s Report", 3),
    ("audit_and_accounting", r"Limited Review Report", 3),
    ("audit_and_accounting", r"Chartered Accountants", 2),
    ("audit_and_accounting", r"\bCIN\s*:", 2),
    ("financial_type", r"\bConsolidated\b", 1),
    ("financial_type", r"\bStandalone\b", 1),
    ("financial_type", r"Total income", 1),
    ("financial_type", r"Total Income", 1),
]
GATE_SCORE, GATE_CATEGORIES, GATE_CHARS = 6, 2, 6000

# Claims in crore, hedging, words of rise and fall, refusals, page signals.
CRORE_CLAIM = r"(?:₹|Rs\.?|INR)?\s*([\d,]+(?:\.\d+)?)\s*(?:crore|cr\.?)\b"
HEDGING = r"\b(approximately|around|nearly|about|roughly)\b"
RISE = r"\b(grew|grow|growth|increased?|increasing|rose|rising|surged?|improved?|improving|expanded?|expanding|strengthened?|gained?|higher|stronger|robust|accelerat\w+)\b"
FALL = r"\b(declined?|declining|decreased?|decreasing|fell|falling|dropped?|dropping|contracted?|contracting|weakened?|weakening|lost|lower|weaker|slowdown|deteriorat\w+|shrank|shrinking)\b"
REFUSALS = [
    r"do(?:es)?\s+not\s+contain",
    r"documents?\s+(?:do|does)\s+not\s+(?:cover|contain|mention|include)",
    r"is\s+not\s+mentioned\s+in\s+the",
    r"no\s+information\s+(?:is\s+)?(?:available\s+|found\s+)?(?:about|regarding|on|concerning)",
    r"(?:was|were)\s+not\s+(?:found|located)\s+in\s+the\s+(?:provided\s+|retrieved\s+)?(?:excerpts|documents)",
    r"insufficient\s+information",
    r"excerpts?\s+(?:do|does)\s+not\s+(?:fully\s+)?answer",
]
PAGE_SIGNALS = [
    r"quarter ended|year ended",
    r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}",
    r"revenue from operations|sale of products|total income|profit before tax",
    r"statement of assets and liabilities|total assets|total equity and liabilities",
]
#: Tolerance of a claim, and per cents from which a difference is of medium and high severity.
TOLERANCE, MEDIUM, HIGH = 5.0, 10.0, 20.0


def _any_case(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit("(?i)" + pattern))


def blocked_category(query: Column, rules: list[tuple[str, str]] = BLOCKED) -> Column:
    """Category of the first rule that a query breaks; ``empty_query`` for blanks, null if it may pass."""
    text = F.trim(F.coalesce(query, F.lit("")))
    out = F.when(text == "", F.lit("empty_query"))
    for category, pattern in rules:
        out = out.when(_any_case(text, pattern), F.lit(category))
    return out


def blocked_response(category: Column) -> Column:
    """What to tell whoever asked: nothing of the rule where instructions were to be overridden."""
    about = F.when(category == "trading_advice", "trading recommendations").when(category == "investment_advice", "opinions on investments").when(category == "price_prediction", "price predictions").when(category == "portfolio_advice", "portfolio advice")
    advice = F.concat(F.lit("Research only: this engine gives no "), about, F.lit(". Please ask about the facts instead."))
    return F.when(category == "empty_query", F.lit("Please enter a question.")).when(about.isNotNull(), advice).when(category.isNotNull(), F.lit("This request cannot be processed."))


def gate(text: Column, signals: list[tuple[str, str, int]] = GATE_SIGNALS) -> dict[str, Column]:
    """score, n_categories and accepted of a document's first characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, GATE_CHARS)
    hits = [(c, F.when(_any_case(head, p), w).otherwise(0)) for c, p, w in signals]
    score = sum((h for _, h in hits), F.lit(0))
    categories = sum((F.greatest(*([h for c2, h in hits if c2 == c] + [F.lit(0)])).cast("boolean").cast("int") for c in dict.fromkeys(c for c, _ in hits)), F.lit(0))
    return {"score": score, "n_categories": categories, "accepted": (score >= GATE_SCORE) & (categories >= GATE_CATEGORIES)}


def crore_claims(text: Column) -> Column:
    """Figures in crore that a text states, in order."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + CRORE_CLAIM), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x.isNotNull())


def hedged(text: Column) -> Column:
    return _any_case(text, HEDGING)


def direction(text: Column) -> Column:
    """``positive`` or ``negative`` by the more frequent words; null for none or a tie."""
    up, down = (F.regexp_count(text, F.lit("(?i)" + p)) for p in (RISE, FALL))
    return F.when(up > down, "positive").when(down > up, "negative")


def severity(difference: Column) -> Column:
    """Of a difference in per cent; null within the tolerance."""
    d = F.abs(difference)
    return F.when(d <= TOLERANCE, F.lit(None).cast("string")).when(d >= HIGH, "high").when(d >= MEDIUM, "medium").otherwise("low")


def refuses(text: Column) -> Column:
    return _any_case(text, "(" + "|".join(REFUSALS) + ")")


def looks_tabular(text: Column, ruled: Column | None = None) -> Column:
    """Does a page hold a table by any signal?"""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.rlike(low, F.lit("|".join(PAGE_SIGNALS)))
    return out if ruled is None else out | F.coalesce(ruled, F.lit(False))


def confidence(top: Column, bottom: Column) -> tuple[Column, Column]:
    """Score and tier of a retrieval from its best and worst rerank scores."""
    norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top + 12) / 10))
    bonus = F.least(F.lit(0.05), 0.005 * F.abs(top - bottom))
    tier = F.when(top >= -4.5, "high").when(top >= -7.5, "medium").otherwise("low")
    return F.least(F.lit(1.0), norm + bonus), tier


def capped(score: Column, tier: Column, n_high: Column, restated: Column) -> tuple[Column, Column]:
    """A contradiction of high severity or a restatement caps the tier at medium and the score at 0.75."""
    cap = (F.coalesce(n_high, F.lit(0)) > 0) | F.coalesce(restated, F.lit(False))
    return F.when(cap, F.least(score, F.lit(0.75))).otherwise(score), F.when(cap & (tier == "high"), "medium").otherwise(tier)


def cross_confidence(verified: Column, quant_score: Column, quant_tier: Column) -> tuple[Column, Column]:
    score = F.when(verified, F.least(quant_score, F.lit(1.0))).otherwise(F.least(quant_score, F.lit(0.75)))
    return score, F.when(verified, quant_tier).when(quant_tier == "high", "medium").otherwise(quant_tier)


def single_source(tier: Column, n_sources: Column) -> Column:
    """One cited chunk alone supports no high tier."""
    return F.when((tier == "high") & (n_sources <= 1), "medium").otherwise(tier)
