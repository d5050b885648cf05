"""Question generation on hand-written sites."""

from pyspark.sql import functions as F

from wellspring.operators import questions as Q


def run(spark, types=(), headings=(), sites=(("a.com", "Acme"),)):
    s = spark.createDataFrame(list(sites), "site string, company string")
    t = spark.createDataFrame(list(types), "site string, type string, place int")
    h = spark.createDataFrame(list(headings), "site string, level int, place int, text string")
    out = {}
    for r in Q.generated(s, t, h).orderBy("site", "number").collect():
        out.setdefault(r.site, []).append(r)
    return out


def test_universal_alone(spark):
    got = run(spark)["a.com"]
    assert [r.question for r in got] == [q.replace("{company}", "Acme") for _, q, _, _, _ in Q.UNIVERSAL] and [r.number for r in got] == list(range(1, 16))
    assert sum(r.weight for r in got) == sum(w for *_, w in Q.UNIVERSAL) and {r.source for r in got} == {"universal"}


def test_types_in_order_of_first_place_three_at_most(spark):
    got = run(spark, types=[("a.com", "Thing", 0), ("a.com", "Article", 5), ("a.com", "Organization", 2), ("a.com", "Article", 9), ("b.com", "Product", 1)])["a.com"][15:]
    assert [(r.question, r.source, r.category, r.weight) for r in got] == [
        ("How many employees does Acme have?", "schema", "identity", 0.8),
        ("What is Acme's annual revenue?", "schema", "trust", 0.8),
        ("What is the main topic of this article?", "schema", "identity", 0.8),
    ]


def test_first_two_fitting_headings(spark):
    heads = [("a.com", 2, 1, "Our Team and Pricing"), ("a.com", 1, 9, "Welcome"), ("a.com", 1, 7, "FAQ"), ("a.com", 4, 0, "Security"), ("a.com", 3, 0, "Contact"), ("a.com", 2, 5, "Case studies")]
    got = run(spark, headings=heads)["a.com"][15:]
    assert [(r.question, r.category) for r in got] == [("What are frequently asked questions about Acme?", "offerings"), ("What are Acme's pricing plans?", "offerings")]
    one = run(spark, headings=[("a.com", 1, 1, "Plans"), ("a.com", 1, 2, "COST")])["a.com"][15:]
    assert [r.question for r in one] == ["What are Acme's pricing plans?"]  # the same question once
    assert [r.number for r in one] == [16]


def test_limit_and_sites(spark):
    types = [("a.com", "Product", 1), ("a.com", "Service", 2)]
    heads = [("a.com", 1, 1, "Team"), ("a.com", 1, 2, "Reviews")]
    got = run(spark, types, heads, [("a.com", "Acme"), ("b.com", "Be  Co"), ("c.com", None)])
    assert len(got["a.com"]) == 20 and [r.source for r in got["a.com"][15:]] == ["schema"] * 3 + ["heading"] * 2
    assert len(got["b.com"]) == 15 and "Be  Co" in got["b.com"][0].question


def test_patterns(spark):
    texts = ["Plans", "All Features", "Who  we are", "Founders", "Customers say", "Success stories", "Works with X", "Frequently asked", "Compliance", "Helpdesk", "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(Q.fitting(F.col("t")).alias("n")).collect()] == [*range(10), None, None]
