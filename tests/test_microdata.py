"""Microdata by running depth, against a parser with a stack."""

from html.parser import HTMLParser

from wellspring.functions import microdata as M
from wellspring.functions import schema as S

PAGES = {
    1: """<div itemscope itemtype="https://schema.org/Product"><h1 itemprop="name">Red  lamp</h1><p>no end<img itemprop="image" content="a.png" src="b">
      <div itemprop="offers" itemscope itemtype='http://schema.org/Offer'><span itemprop=price content="9.50">nine</span><div><div>deep</div></div><meta itemprop="currency" content="EUR"/></div>
      <span itemprop="name">Blue <b>lamp</b> &amp; shade</span></div><span itemprop="name">outside</span>""",
    2: """<!-- <div itemscope itemtype="https://schema.org/Event"> --><script>var a = '<div itemtype="https://schema.org/Thing">';</script>
      <ul><li itemscope itemtype="https://schema.org/Person"><b itemprop="name">Ann</b><li itemscope itemtype="https://schema.org/Person"><b itemprop="name">Bo</b></ul>
      <div itemtype="https://other.org/Thing"><i itemprop="x">y</i></div>""",
    3: """<section itemscope itemtype="https://schema.org/FAQPage"><div itemprop="mainEntity"></div><section itemscope itemtype="https://schema.org/Question"><h2 itemprop="name">Why?</h2></section></section>
      <article itemtype="https://schema.org/Article"><a title="1 > 0" itemprop="headline">H</a></article>""",
    4: "plain",
    5: None,
}


class Stack(HTMLParser):
    """Items by a stack; an element without an end lasts to the end of the page."""

    def __init__(self):
        super().__init__()
        self.open, self.items, self.props = [], [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        node = {"tag": tag, "text": []}
        if "schema.org" in (a.get("itemtype") or ""):
            node["item"] = [a["itemtype"].split("schema.org/")[1], {}]
            self.items.append(node["item"])
        if a.get("itemprop"):
            node["prop"] = (len(self.props), a["itemprop"], a.get("content"), [n["item"] for n in self.open if "item" in n])
            self.props.append(node)
        if tag not in M.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in M.VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i]
                return

    def handle_data(self, data):
        for n in self.open:
            n["text"].append(data.strip())

    def result(self):
        for n in sorted(self.props, key=lambda n: n["prop"][0]):
            _, name, content, inside = n["prop"]
            value = content or "".join(n["text"])
            if value:
                for item in inside:
                    item[1][name] = value
        return [tuple(i) for i in self.items]


def test_items_equal_a_stack(spark):
    df = spark.createDataFrame(list(PAGES.items()), "page_id bigint, html string")
    got = {}
    for r in M.items(df).orderBy("page_id", "at").collect():
        got.setdefault(r.page_id, []).append((r.type, r.properties))
    want = {}
    for i, h in PAGES.items():
        s = Stack()
        s.feed(h or "")
        s.close()
        if s.result():
            want[i] = s.result()
    assert got == want
    assert got[1][0] == ("Product", {"name": "Bluelamp& shade", "image": "a.png", "offers": "ninedeep", "price": "9.50", "currency": "EUR"})
    assert [p["name"] for _, p in got[2]] == ["Bo", "Bo"]  # the first item has no end, so the second lies in it
    assert M.items(df.limit(0)).count() == 0


def test_items_feed_the_schema_scores(spark):
    df = spark.createDataFrame(list(PAGES.items()), "page_id bigint, html string")
    rows = {(r.page_id, r.type, r.source): round(r.completeness, 4) for r in S.scored(df).collect()}
    assert rows[1, "Product", "microdata"] == 50.0 and rows[3, "Article", "microdata"] == 23.3333 and rows[3, "FAQPage", "microdata"] == 15.0
    both = spark.createDataFrame([(9, '<script type="application/ld+json">{"@type":"Product","name":"x"}</script>' + PAGES[1])], "page_id bigint, html string")
    assert {(r.type, r.source) for r in S.scored(both).collect()} == {("Product", "json-ld"), ("Product", "microdata"), ("Offer", "microdata")}
