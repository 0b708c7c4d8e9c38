"""Pages of filings: sections, the classes of pages, and what continues over page breaks.

Pages have doc, page, content and kind (``table`` or ``text``).  Whatever depends on earlier pages is
a window over a document's pages, so documents are the unit of parallel work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Phrases that mark pages.
STANDALONE = ["statement of standalone", "statement of unaudited standalone", "statement of audited standalone", "standalone financial statements", "standalone balance sheet", "standalone statement of", "review of the standalone", "audit of the standalone"]
CONSOLIDATED = ["statement of consolidated", "statement of unaudited consolidated", "statement of audited consolidated", "consolidated financial statements", "consolidated balance sheet", "consolidated statement of", "review of the consolidated", "audit of the consolidated"]
NOTES = ["notes to the consolidated financial", "notes to the standalone financial", "notes to financial statements"]
AUDITOR = ["review of the consolidated financial", "review of the standalone financial", "independent auditor", "limited review report", "we did not audit", "other auditors"]
TITLES = ["statement of profit and loss", "statement of profit & loss", "balance sheet", "statement of cash flow", "statement of standalone", "statement of consolidated", "financial results for the quarter", "financial results for the year", "unaudited financial results", "audited financial results", "statement of consolidalcd", "financial rcsulls", "statement of assets and liabilities", "consolidated audited statement of assets and liabilities", "standalone audited statement of assets and liabilities"]
LETTERED = r"\b[A-Z]\.\s+(Income|Expenses?|Revenue|Results?|Other Income|Cost)\b"
VARIANCE = r"(?i)\b(increased|decreased|grew|declined)\b.{0,40}?(\d+(\.\d+)?%\s*(YoY|y-o-y|year-on-year)|(INR|Rs\.?)\s*[\d,]+\s*crore)"
VARIANCE_OF = ["revenue", "expenses", "income", "results", "cost"]
RISK = ["risk factor", "material uncertainty", "going concern", "contingent liabilit", "legal proceeding", "regulatory risk", "show cause", "litigation", "indemnit", "pending litigation", "compliance risk", "sebi", "enforcement", "penalty"]
DISCUSSION = ["management discussion", "management's discussion", "business overview", "our performance", "key highlights", "operating performance", "growth strategy", "competitive landscape", "market opportunity", "unit economics", "contribution margin", "industry structure", "segment-wise performance", "segment wise performance", "review of operations", "state of the company", "internal control systems", "internal financial control", "human resources", "human capital", "cautionary statement", "risks and concerns", "opportunities and threats", "financial performance review", "operational review"]
FINANCIAL = ["revenue", "income", "expenses", "profit", "loss", "ebitda", "depreciation", "amortisation", "amortization", "tax", "earnings", "assets", "liabilities", "equity", "borrowings", "payable", "receivable", "cash", "flows", "crore", "lakh", "inr", "particulars", "financial", "results", "statement", "standalone", "consolidated", "revenuc", "incomc", "cosis", "particulan", "proflt", "liabilites"]
#: Keywords that a class needs, characters of a heading, pages that a statement and an auditor's report may go on.
LEAST, HEADING, STATEMENT_PAGES, AUDITOR_PAGES = 2, 400, 4, 6


def count_phrases(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases a text holds, each once."""
    return sum((F.contains(text, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def any_phrase(text: Column, phrases: list[str]) -> Column:
    return count_phrases(text, phrases) > 0


def sections(pages: DataFrame) -> DataFrame:
    """doc, financial_type, page_start, page_end: by the first table page of either marker alone, else all consolidated."""
    low = F.lower("content")
    alone, whole = any_phrase(low, STANDALONE), any_phrase(low, CONSOLIDATED)
    table = F.col("kind") == "table"
    first = pages.groupBy("doc").agg(F.min(F.when(table & alone & ~whole, F.col("page"))).alias("s"), F.min(F.when(table & whole & ~alone, F.col("page"))).alias("c"), F.max("page").alias("last"))
    span = lambda t, a, b: F.struct(F.lit(t).alias("financial_type"), a.cast("int").alias("page_start"), b.cast("int").alias("page_end"))
    one, s, c, last = F.lit(1), F.col("s"), F.col("c"), F.col("last")
    found = (
        F.when(s.isNull() | (s == c), F.array(span("consolidated", one, last)))
        .when(c.isNull(), F.array(span("standalone", one, last)))
        .when(s < c, F.array(span("standalone", one, c - 1), span("consolidated", c, last)))
        .otherwise(F.array(span("consolidated", one, s - 1), span("standalone", s, last)))
    )
    return first.select("doc", F.explode(found).alias("x")).select("doc", "x.*")


def place(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Pages with the financial_type of their section: an equi-join on the document with the range as a condition; of overlapping sections the later."""
    inside = (pages["doc"] == spans["doc"]) & F.col("page").between(F.col("page_start"), F.col("page_end"))
    rows = pages.join(spans, inside, "left").select(pages["*"], "financial_type", "page_start")
    return rows.groupBy(*pages.columns).agg(F.max_by("financial_type", "page_start").alias("section"))


def _earlier(w, value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(w)


def classify(placed: DataFrame) -> DataFrame:
    """Pages with ``block`` and, for statements, ``financial_type``.

    Two passes of windows suffice: whether a page follows an auditor's page depends on contents and
    sections alone, and an anchor's own class on its contents and that first pass.
    """
    low, flat = F.lower("content"), F.replace(F.lower("content"), F.lit("\n"), F.lit(" "))
    head = F.substring(low, 1, HEADING)
    auditor = any_phrase(head, AUDITOR)
    veto = auditor | any_phrase(head, NOTES)
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumns({"auditor": auditor, "veto": veto, "risk": count_phrases(low, RISK), "discussion": count_phrases(low, DISCUSSION)})
    rows = rows.withColumn("seen", _earlier(before, F.when(F.col("auditor") & F.col("section").isNotNull(), F.struct("page", F.col("section").alias("ft")))))
    going_on = F.coalesce((F.col("seen.ft") == F.col("section")) & (F.col("page") - F.col("seen.page")).between(1, AUDITOR_PAGES), F.lit(False))
    rows = rows.withColumn("after_auditor", going_on)
    is_risk = (F.col("risk") >= LEAST) & ~(F.col("veto") | F.col("after_auditor"))
    told = F.rlike("content", F.lit(LETTERED)) | (F.rlike("content", F.lit(VARIANCE)) & any_phrase(low, VARIANCE_OF))
    is_discussion = (F.col("discussion") >= LEAST) | ((F.col("kind") == "text") & told)
    table, sectioned = F.col("kind") == "table", F.col("section").isNotNull()
    titled, lists = any_phrase(flat, TITLES), F.contains(flat, F.lit("particulars"))
    own = table & sectioned & ~F.col("veto") & titled & lists & ~is_risk & ~is_discussion
    anchor = table & ~F.col("veto") & any_phrase(head, TITLES)
    rows = rows.withColumns({"own": own, "titled": titled, "anchor": F.when(anchor, F.struct("page", F.when(own, F.col("section")).otherwise("unknown").alias("ft")))})
    rows = rows.withColumn("last_anchor", _earlier(before, F.col("anchor")))
    in_head, in_all = count_phrases(F.substring(flat, 1, HEADING), FINANCIAL), count_phrases(flat, FINANCIAL)
    enough = F.when(in_head > 0, in_head).otherwise(in_all) >= LEAST
    follows = F.coalesce((F.col("last_anchor.ft") == F.col("section")) & (F.col("page") - F.col("last_anchor.page")).between(1, STATEMENT_PAGES), F.lit(False))
    continued = table & sectioned & ~F.col("veto") & ~F.col("titled") & follows & enough & lists
    block = F.when(is_risk, "risk_disclosure").when(is_discussion, "management_discussion").when(F.col("own") | continued, "financial_statement").when(table, "table").otherwise("text")
    out = rows.withColumn("block", block)
    return out.withColumn("financial_type", F.when(F.col("block") == "financial_statement", F.col("section")).otherwise("unknown"))


def first_pages(pages: DataFrame, n: int = 2) -> DataFrame:
    """doc and the text of its first n pages, joined by newlines in order."""
    rows = pages.where(F.col("page") <= n).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", F.col("content").alias("content")))).alias("p"))
    return rows.select("doc", F.array_join(F.col("p.content"), "\n").alias("text"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc").agg(F.max("page").alias("pages"))
