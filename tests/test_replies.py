"""Replies: fenced, wrapped, broken, nested; filters on stored ones reach the scan."""

from pyspark.sql import functions as F

from ledgerloom.plans import replies

GOOD = '{"metric": "Revenue", "entity": "acme", "fiscal_year": "FY26", "financial_type": "Consolidated", "operation": "cagr"}'
CASES = {
    1: (GOOD, "sound"),
    2: (f"```json\n{GOOD}\n```", "sound"),
    3: (f"Sure {{as asked}}:\n```\n{GOOD}\n```\nBye {{x}}", "sound"),
    4: (f"The query is {GOOD} as asked", "sound"),
    5: (f'{{"query": {GOOD}}}', "sound"),
    6: (GOOD[:-5], "unparsed"),
    7: (f"[{GOOD}]", "no_object"),
    8: (None, "empty"),
    9: ("  \n", "empty"),
    10: ("```json\n```", "unparsed"),
    11: (GOOD.replace('"FY26"', "2026"), "sound"),
    12: (GOOD.replace("FY26", "last year"), "unknown"),
    13: (GOOD.replace("cagr", "magic"), "unknown"),
    14: (GOOD.replace('"acme"', "null"), "incomplete"),
    15: ("{}", "incomplete"),
    16: ('"a string"', "no_object"),
    17: (GOOD.replace("}", ', "metric": "pat"}'), "unparsed"),
    18: (GOOD.replace('"acme"', '"' + "a" * 200_000 + '"'), "sound"),
}


def test_cases(spark):
    rows = spark.createDataFrame([(i, t, "mine") for i, (t, _) in CASES.items()], "id int, reply string, state string")
    out = {r["id"]: r for r in replies.records(rows).collect()}
    assert {i: r["state"] for i, r in out.items()} == {i: s for i, (_, s) in CASES.items()}
    for i in (1, 2, 3, 4, 5, 11):
        assert (out[i]["metric"], out[i]["entity"], out[i]["fiscal_year"], out[i]["financial_type"]) == ("revenue", "ACME", 2026, "consolidated")
    assert out[14]["missing"] == "entity" and out[15]["missing"] == ",".join(replies.REQUIRED)
    assert replies.records(rows.limit(0)).count() == 0


def test_fields_of_stored_replies_are_filtered_in_the_scan(spark, tmp_path, capsys):
    rows = spark.range(100).select("id", F.concat(F.lit('{"metric": "'), F.when(F.col("id") % 4 == 0, "pat").otherwise("revenue"), F.lit('", "n": '), "id", F.lit("}")).alias("reply"))
    replies.keep(rows, str(tmp_path / "kept"))
    stored = spark.read.parquet(str(tmp_path / "kept"))
    found = stored.select("id", F.try_variant_get("parsed", "$.metric", "string").alias("metric")).where("metric = 'pat'")
    assert found.count() == 25
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(parsed" in plan and "reply" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert stored.where(replies.field(F.col("parsed"), "metric") == "pat").count() == 25
