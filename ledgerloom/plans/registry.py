"""Metrics and companies that queries and statements may name.

A registry is a parameter: these are the defaults.  A metric's own name with spaces is always an
alias, and a label follows from the name unless one is given.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    aliases: tuple[str, ...] = ()
    queryable: bool = False
    derived: bool = False
    given_label: str = ""
    #: How questions put it, and what it is not to be taken for.
    said: str = ""
    warning: str = ""

    @property
    def label(self) -> str:
        return self.given_label or self.name.replace("_", " ").title().replace(" And ", " and ").replace(" In ", " in ")

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.aliases, self.name.replace("_", " ")]))


@dataclass(frozen=True)
class Company:
    name: str
    ticker: str
    aliases: tuple[str, ...]
    parent: str = ""


# Metrics that queries may ask for, with the labels that filings print for them.
QUERYABLE = [
    Metric("revenue", ("revenue", "revenue from operations", "total income from operations", "income from operations", "operating revenue", "net revenue", "gross revenue", "sales", "net sales", "turnover", "total revenue", "top line", "sale of products", "sale of services", "standalone revenue"), True),
    Metric("other_operating_revenue", ("other operating revenue", "other operating revenues"), True),
    Metric("total_income", ("total income", "total income i+ii", "ill total incomc 1+11"), True),
    Metric("other_income", ("other income", "non operating income", "interest income"), True),
    Metric("purchases_of_stock_in_trade", ("purchases of stock-in-trade",), True),
    Metric("employee_benefits_expense", ("employee benefits expense", "employee cost", "staff cost", "salary expense"), True),
    Metric("finance_costs", ("finance costs", "interest expense", "borrowing costs"), True),
    Metric("depreciation", ("depreciation", "depreciation and amortization expenses", "depreciation_and_amortisation_expense", "depreciation_and_amortization_expense", "depreciation_and_amortisation", "depreciation_and_amortization", "depreciation_expense", "amortisation_expense", "amortization_expense", "depreciation_and_amortisation_expenses", "depreciation_and_amortization_expenses", "depreciation_expenses", "depreciation and amortisation", "depreciation and amortization", "d&a", "da"), True, given_label="Depreciation & Amortisation"),
    Metric("advertising", ("advertising", "marketing expense"), True, given_label="Advertising & Marketing"),
    Metric("advertisement_and_sales_promotion", ("advertisement and sales promotion", "advertising and sales promotion"), True, given_label="Advertisement & Sales Promotion"),
    Metric("total_expenses", ("total expenses",), True),
    Metric("delivery_and_related_charges", ("delivery and related charges", "delivery and related charges n4"), True),
    Metric("profit_before_tax", ("profit before tax", "profit/(loss) before tax", "pbt", "profit before taxes"), True),
    Metric("pat", ("pat", "profit after tax", "net profit", "net income", "earnings", "profit for the period", "profit for the year", "profit/(loss) for the period/year", "profit/(loss) for the period", "profit/(loss) for the year"), True, given_label="PAT"),
    Metric("tax_expense", ("tax expense", "income tax expense", "total tax expense", "tax expenses", "total tax expenses", "taxation", "tax expense for the period"), True),
    Metric("eps_basic", ("earnings per share", "basic earnings per share", "basic eps", "basic (not annualised)", "basic"), True, given_label="Basic EPS"),
    Metric("eps_diluted", ("diluted earnings per share", "diluted eps", "diluted (not annualised)", "diluted"), True, given_label="Diluted EPS"),
    Metric("geo_revenue_india", ("india",), True, given_label="India Revenue"),
    Metric("geo_revenue_rest_of_world", ("rest of the world",), True, given_label="Rest of World Revenue"),
    Metric("pat_attributable_to_owners", ("owners of the group",), True, given_label="PAT Attributable to Owners of the Group"),
    Metric("purchase_of_stock_in_trade", ("purchase of stock-in-trade",), True),
    Metric("total_other_comprehensive_income", ("total other comprehensive loss", "total other comprehensive income"), True),
    Metric("exceptional_items", ("exceptional items",), True),
    Metric("ebitda", ("ebitda", "operating ebitda"), True, True, "EBITDA"),
    Metric("gross_profit", ("gross profit",), True, True),
    Metric("operating_expenses", ("operating expenses",), True, True),
]
# Metrics that are only stored, by name, with their aliases; another alias follows from each name.
STORED = {
    "gmv": ("gmv", "gross merchandise value"),
    "gov": ("gov", "gross order value"),
    "cost_of_materials_consumed": ("cost of materials consumed", "raw material consumed", "cost of materials and components consumed"),
    "changes_in_inventories": ("changes in inventories",),
    "other_expenses": ("other expenses",),
    "share_based_payment_expense": ("share-based payment expense", "share based payment expense"),
    "ebit": ("ebit",),
    "operating_profit": ("operating profit",),
    "profit_before_exceptional_items": ("profit before exceptional items and tax", "profit before share of profit of an associate and a joint venture exceptional items and tax", "profit/(loss) before share of profit/(loss) of associates/joint ventures exceptional items and tax", "profit/(loss) before exceptional items and tax", "profit before exceptional items"),
    "share_of_profit_of_associate": ("share of profit/(loss) of an associate and a joint", "share in (profit)/loss of associate/joint venture", "~ associate•"),
    "current_tax": ("current tax", "current lax"),
    "deferred_tax": ("deferred tax", "deferred rnx"),
    "cash": ("cash", "cash and cash equivalents"),
    "operating_cash_flow": ("operating cash flow",),
    "inventory": ("inventory",),
    "receivables": ("trade receivables",),
    "payables": ("trade payables",),
    "total_assets": ("total assets",),
    "total_liabilities": ("total liabilities",),
    "equity": ("equity", "total equity"),
    "other_equity": ("other equity",),
    "net_gain_on_investments": ("net gain on mutual fund units", "net gain on mutual funds"),
    "liabilities_written_back": ("liabilities written back",),
    "orders": ("orders",),
    "mtu": ("mtu",),
    "mau": ("mau",),
    "active_users": ("active users",),
    "impairment_of_loans_and_investments_in_associates": ("impairment of loans/investment in associates", "impairment of loans / investment in associates", "impairment of loans/investments in associates", "impairment of loans / investments in associates", "provision for impairment of loans/investments in subsidiary/associate", "provision for impairment ofloans/investments in subsidiary/associate", "provision for impainnent ofloans/investments in subsidiary/associate"),
    "segment_revenue_watches": ("watches",),
    "segment_revenue_jewellery": ("jewellery",),
    "segment_revenue_eyecare": ("eyecare",),
    "segment_revenue_others": ("others",),
    "segment_unallocated": ("corporate (unallocated)", "corporate unallocated"),
    "oci_tax_on_remeasurement": ("income-tax on (i) above", "income-tax on (i) above*", "income-tax on (i) above•"),
    "oci_tax_on_fx_translation": ("income-tax on (ii) above", "income-tax on (ii) above•"),
    "oci_remeasurement_defined_benefit": ("remeasurements of the defined benefit plans", "remeasurements of the defined benetit plans", "remeasuremcnls of the defined benefit plans 0 0", "-remeasurement of employee defined benefit plan", "remeasurement of employee defined benefit plan", "remeasurement of employee defined benefit plans"),
    "oci_fx_translation": ("exchange differences on translation of foreign operations", "exchange differences on trnnslation of foreign operations 8 2", "exchange differences on lranslation of foreign operations 0 5 i", "-exchange differences in translating the financial statements of foreign", "exchange differences in translating the financial statements of foreign"),
    "ppe_disposal_gain_loss": ("(profit)/ loss on sale of property, plant and equipment (net)",),
}
# Metrics that no filing states, their aliases, and how they would be computed.
DERIVED = {"adjusted_ebitda": ("adjusted ebitda",), "gross_margin": ("gross margin",), "ebitda_margin": ("ebitda margin",), "pat_margin": ("pat margin",), "fcf": ("free cash flow",)}
FORMULAS = {"ebitda": "operating_profit + depreciation", "gross_profit": "revenue - cost_of_materials_consumed", "operating_expenses": "total_expenses - finance_costs - depreciation", "gross_margin": "gross_profit / revenue * 100", "ebitda_margin": "ebitda / revenue * 100", "pat_margin": "pat / revenue * 100", "fcf": "operating_cash_flow - capex"}
# What questions call a metric, and what it is not to be taken for.
SAID = {
    "revenue": "revenue from operations, top line, turnover",
    "other_operating_revenue": "other operating revenue, secondary revenue line",
    "total_income": "total income, revenue plus other income",
    "other_income": "other income, non-operating income",
    "employee_benefits_expense": "employee benefits, staff costs, people costs, salaries",
    "finance_costs": "finance costs, interest expense, borrowing costs",
    "depreciation": "depreciation, amortisation, D&A",
    "advertising": "advertising, ad spend, marketing, sales promotion",
    "total_expenses": "total expenses, total costs, operating costs",
    "delivery_and_related_charges": "delivery charges, logistics costs, fulfillment costs",
    "profit_before_tax": "profit before tax, PBT (BEFORE tax is deducted — do NOT confuse with PAT)",
    "pat": "profit after tax, net profit, bottom line, PAT (AFTER tax is deducted)",
    "tax_expense": "tax expense, income tax expense, total tax",
    "eps_basic": "basic earnings per share, basic eps",
    "eps_diluted": "diluted earnings per share, diluted eps",
    "exceptional_items": "exceptional items, one-off items",
}
WARNINGS = {
    "other_operating_revenue": "Distinct from 'revenue' — this is a SEPARATE sub-line some companies report alongside main revenue.",
    "other_income": "'other income' maps here — NOT to total_income.",
    "profit_before_tax": "PBT and PAT are DIFFERENT numbers; PBT is measured BEFORE tax is subtracted, PAT is AFTER.",
}

METRICS = [replace(m, said=SAID.get(m.name, ""), warning=WARNINGS.get(m.name, "")) for m in (*QUERYABLE, *(Metric(n, a) for n, a in STORED.items()), *(Metric(n, a, derived=True) for n, a in DERIVED.items()))]

# Companies with the names that filings and questions use for them.
COMPANIES = [
    Company("ETERNAL", "ETERNAL", ("eternal", "eternal limited", "zomato", "zomato limited", "zomato ltd", "eternal ltd")),
    Company("PAYTM", "PAYTM", ("paytm", "one97 communications", "one97", "paytm payments bank", "one 97 communications", "one 97")),
    Company("NYKAA", "NYKAA", ("nykaa", "fsg nykaa", "fsn e-commerce", "fsn ecommerce")),
    Company("POLICYBAZAAR", "POLICYBZR", ("policybazaar", "pb fintech", "pbfintech")),
    Company("DELHIVERY", "DELHIVERY", ("delhivery", "delhivery limited")),
    Company("SWIGGY", "SWIGGY", ("swiggy", "bundl technologies", "bundl")),
    Company("TITAN", "TITAN", ("titan", "titan company", "titan company limited", "titan ltd", "titan company ltd")),
]
#: Aliases that a worker's automaton holds at once.
HELD_NAMES = 500_000
PARENTS = {"BLINKIT": "ETERNAL", "HYPERPURE": "ETERNAL"}


def alias_rows(metrics: list[Metric] = METRICS, queryable_only: bool = False) -> list[tuple[str, str, int]]:
    """(alias, metric, order), each alias once, in the order of the registry."""
    pairs: dict[str, str] = {}
    for m in metrics:
        if m.queryable or not queryable_only:
            for alias in m.names:
                pairs.setdefault(alias, m.name)
    return [(a, n, i) for i, (a, n) in enumerate(pairs.items())]


def prompt_lines(metrics: list[Metric] = METRICS) -> list[str]:
    """One line for each metric that a query may ask for and that filings state, for whoever turns questions into queries."""
    return [f'  "{m.name}" — also called: {m.said}' for m in metrics if m.queryable and not m.derived]


def prompt_warnings(metrics: list[Metric] = METRICS) -> list[str]:
    return [f'- {m.label} ("{m.name}"): {m.warning}' for m in metrics if m.queryable and m.warning]


def not_yet_derivable(metrics: list[Metric] = METRICS) -> list[str]:
    """Metrics that queries may name but that nothing computes yet."""
    return [m.name for m in metrics if m.queryable and m.derived]


def views(spark: SparkSession, metrics: list[Metric] = METRICS) -> DataFrame:
    """metric, label, queryable, derived, n_aliases: the registry as a relation."""
    rows = [(m.name, m.label, m.queryable, m.derived, len(m.names)) for m in metrics]
    return spark.createDataFrame(rows, "metric string, label string, queryable boolean, derived boolean, n_aliases int")


def aliases(spark: SparkSession, metrics: list[Metric] = METRICS) -> DataFrame:
    return spark.createDataFrame(alias_rows(metrics), "alias string, metric string, ord int")


def company_rows(companies: list[Company] = COMPANIES) -> list[tuple[str, str, str, int]]:
    return [(a, c.name, c.ticker, i) for i, (a, c) in enumerate((a, c) for c in companies for a in c.aliases)]


def company_aliases(spark: SparkSession, companies: list[Company] = COMPANIES) -> DataFrame:
    return spark.createDataFrame(company_rows(companies), "alias string, company string, ticker string, ord int")


def resolve_exact(labels: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """``labels`` with ``metric`` by equal alias, null if none.  The registry is a bounded list, so it is broadcast."""
    return labels.join(F.broadcast(names.select(F.col("alias").alias(label), "metric")), label, "left")


def resolve_by_words(labels: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """``labels`` with ``metric``: the equal alias, else the alias of most words that contains the label's words or is contained in them.

    Ties go to the registry's order; unknown labels keep their words joined by underscores, and
    blank ones become ``unmapped_metric``.

    Every way of matching is an equi-join, so registries of any size will do.  An alias can be inside
    a label only if the label has the alias's rarest word, and around it only if the alias has the
    label's rarest word; words of aliases are counted for that.  What meets there is then compared whole.
    """
    from ..functions.labels import label_words

    known = names.select("alias", "metric", "ord", label_words(F.col("alias")).alias("alias_words"))
    asked = labels.select(label).distinct().withColumn("words", label_words(F.col(label))).where(F.size("words") > 0)
    by_word = known.select("*", F.explode("alias_words").alias("word"))
    spread = by_word.groupBy("word").agg(F.count("*").alias("spread"))
    rarest = F.min_by("word", F.struct("spread", "word")).alias("word")
    keyed = by_word.join(spread, "word").groupBy("alias", "metric", "ord", "alias_words").agg(rarest)
    in_labels = asked.select("*", F.explode("words").alias("word"))
    inside = in_labels.join(keyed, "word").where(F.size(F.array_except("alias_words", "words")) == 0)
    sought = in_labels.join(spread, "word").groupBy(label, "words").agg(rarest, F.count("*").alias("n")).where(F.col("n") == F.size("words"))
    around = sought.drop("n").join(by_word, "word").where(F.size(F.array_except("words", "alias_words")) == 0)
    equal = asked.join(known, asked[label] == known["alias"])
    columns = [label, "alias", "metric", "ord", "alias_words"]
    best = F.max_by("metric", F.struct(F.when(F.col("alias") == F.col(label), 1).otherwise(0), F.size("alias_words"), -F.col("ord"))).alias("best")
    found = equal.select(columns).unionByName(inside.select(columns)).unionByName(around.select(columns)).groupBy(label).agg(best)
    metric = F.when(F.trim(label) == "", "unmapped_metric").otherwise(F.coalesce("best", F.replace(F.col(label), F.lit(" "), F.lit("_"))))
    return labels.join(found, label, "left").withColumn("metric", metric).drop("best")


def resolve_company(rows: DataFrame, names: DataFrame, text: str = "name") -> DataFrame:
    """``rows`` with company and ticker: the equal alias, else the first alias inside the text, else null.

    One automaton of all aliases reads each distinct text once.  It is built in the workers from at
    most ``HELD_NAMES`` aliases; a larger registry is read in as many turns as it takes.
    """
    spark = rows.sparkSession
    asked, turns = rows.where(F.col(text).isNotNull()).select(text).distinct().withColumn("__key", F.lower(F.trim(text))), max(1, -(-names.count() // HELD_NAMES))
    out = None
    for turn in range(turns):
        some = names if turns == 1 else names.where(F.pmod(F.xxhash64("alias"), F.lit(turns)) == turn)
        held = spark.sparkContext.broadcast([tuple(r) for r in some.select("alias", "ord", "company", "ticker").where(F.col("alias").isNotNull()).collect()])
        part = asked.mapInArrow(_named_in(held), f"{text} string, within int, ord int, company string, ticker string")
        out = part if out is None else out.unionByName(part)
    first = F.struct("within", "ord")
    found = out if turns == 1 else out.groupBy(text).agg(*(F.min_by(c, first).alias(c) for c in ("company", "ticker")))
    return rows.join(found.select(text, "company", "ticker"), text, "left")


def _named_in(held):
    """For texts in Arrow batches: the alias equal to a text's key, else the first in order inside it."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        finder, equal, anywhere = ahocorasick.Automaton(), {}, None
        for alias, order, company, ticker in held.value:
            entry = (order, company, ticker)
            if alias == "":  # inside every text
                anywhere = min(filter(None, (anywhere, entry)))
            elif alias not in equal or entry < equal[alias]:
                equal[alias] = entry
                finder.add_word(alias, entry)
        if equal:
            finder.make_automaton()
        for batch in batches:
            out = []
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best, within = (equal[key], 0) if key in equal else (min((e for _, e in finder.iter(key)), default=None) if equal else None, 1)
                if within and anywhere is not None:
                    best = min(filter(None, (best, anywhere)))
                if best:
                    out.append((text, within, *best))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=[batch.schema.names[0], "within", "ord", "company", "ticker"])

    return run


def resolve_parent(rows: DataFrame, parents: dict[str, str] = PARENTS, entity: str = "entity") -> DataFrame:
    """``rows`` with ``parent``: the owner of a subsidiary, else the entity itself."""
    spark = rows.sparkSession
    known = spark.createDataFrame(list(parents.items()), f"{entity} string, owner string")
    return rows.join(F.broadcast(known), entity, "left").withColumn("parent", F.coalesce("owner", entity)).drop("owner")
