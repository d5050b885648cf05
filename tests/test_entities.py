"""Names, dates, competitors and hashed vectors."""

import pytest
from pyspark.sql import functions as F

from wellspring.functions import entities as E


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("s", "want"), [("2024-03-05", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("03/25/2024", "2024-03-25"), ("March 5, 2024", "2024-03-05"), ("5 Mar 2024", "2024-03-05"), ("soon", None), (None, None)])
def test_dates(spark, s, want):
    got = one(spark, E.parse_date(F.lit(s).cast("string")))
    assert (got and got.strftime("%Y-%m-%d")) == want


def test_variations(spark):
    assert one(spark, E.company_variations(F.lit("The Acme Widgets, Inc."))) == ["the acme widgets, inc.", "the acme widgets", "acme widgets", "acme"]


def test_competitors(spark):
    assert one(spark, E.competitors(F.lit("Use HubSpot or Google Analytics, not Acme Corp in New York; GitHub too"), "Acme", "acme.com")) == 2


def test_hashed_vectors(spark):
    d = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta alpha BETA"), (3, ""), (4, None)], "k bigint, t string")
    v = {r.k: r.embedding for r in E.hashed_vectors(d, "k", "t", 16).collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-6 and v[1] == v[2] and v[3] == v[4] == [0.0] * 16


def test_word_edges_are_those_of_the_sql(spark, tmp_path):
    """Edges beside letters outside ASCII, vertical tabs and usually ignored names count as in DuckDB."""
    import duckdb

    from wellspring.plans import catalogue

    texts = ["\u00c9Jean Martin", "Jean Mart\u00edn Paul", "\u00e9CamelCase", "CamelCase\u00df", "New\x0bYork", "New York and GitHub", "Acme Corp", "", None]
    spark.createDataFrame([(i, 0, "assistant", x) for i, x in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for q in ("competitor_counts", "text_parser_flags", "heuristic_depth"):
        got = catalogue.QUERIES[q](spark, str(tmp_path))
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES[q]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), q
