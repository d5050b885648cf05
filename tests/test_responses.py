"""The response parser on hand-written answers, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from wellspring.operators import responses as R

ANSWERS = [
    ("Acme Corp is definitely a leading tool. According to Acme, see https://www.acme.io/pricing and visit https://other.org/x.", "Acme Corp", "acme.io", ["AcmeFlow"]),
    ("I'm not sure, perhaps the Blue Bird Company could be poor. I think it seems limited. AcmeFlow too, acmeflow!", "The Blue Bird Company", "bluebird.com", ["AcmeFlow", "too"]),
    ("I'm sorry, but I can't give that. I don't have access to it.", "Acme", "acme.io", None),
    ("Founded in 1999 for $1,000, 20% of it headquartered in Paris. Acme wins! Acme? ACME...", "Acme", "acme.io", []),
    ("As reported by Bo, Cy says that it works; source: https://acme.io/a b\nbased on information from Acme. from the Acme website.", "Acme", "acme.io", None),
    ("Clearly Acme and only Acme, indeed, specifically.", "Acme", "acme.io", None),
    ("", "Acme", "acme.io", None),
    (None, "Acme", "acme.io", None),
    ("No company at all, great but poor.", None, None, None),
    ("The best quality. a.b a+b (x) [y]", "a.b (x)", "a+b", ["[y]"]),
    ("Acmeacmeacme acme acme " * 40, "Acme", "acme.io", None),
]
DDL = "id int, content string, company string, domain string, branded array<string>"


def plain_names(name):
    out = [name]
    for s in R.SUFFIXES:
        if name.lower().endswith(s.lower()):
            out.append(name[: -len(s)].strip())
    if name.lower().startswith("the "):
        out.append(name[4:])
    w = name.split()
    k = 1 if w and w[0].lower() == "the" else 0
    if len(w) > k + 1 and len(w[k]) >= 3:
        out.append(w[k])
    return list(dict.fromkeys(x for x in out if x))


def plain_mentions(text, company, domain, branded):
    low, found = text.lower(), []
    for v in plain_names(company) if company else []:
        exact = v.lower() == company.lower()
        found += [(m.start(), "exact" if exact else "partial", 1.0 if exact else len(v) / len(company), text[m.start() : m.end()]) for m in re.finditer(re.escape(v.lower()), low)]
    if domain:
        found += [(m.start(), "domain", 1.0, text[m.start() : m.end()]) for m in re.finditer(re.escape(domain.lower()), low)]
        found += [(m.start(), "url", 1.0, text[m.start() : m.end()]) for m in re.finditer(r"https?://(?:www\.)?" + re.escape(domain.lower()) + r"[^\s]*", low)]
    for b in branded or []:
        found += [(m.start(), "branded", 0.9, text[m.start() : m.end()]) for m in re.finditer(re.escape(b.lower()), low)]
    seen, out = set(), []
    for m in sorted(found, key=lambda m: -m[2]):
        if m[0] not in seen:
            seen.add(m[0])
            out.append(m)
    return sorted(out, key=lambda m: m[0])


def plain_citations(text, company):
    out = []
    for p, kind in R.CITATIONS:
        for m in re.finditer(p, text, re.I):
            url = re.search(r"https?://[^\s]+", m.group(1))
            out.append((m.start(), kind, m.group(1).strip(), url and url.group()))
    if not out and company and company.lower() in text.lower():
        out.append((text.lower().find(company.lower()), "implicit", company, None))
    return sorted(out, key=lambda c: c[0])


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(ANSWERS)], DDL)
    return {r.id: r for r in R.parsed(df, branded="branded").collect()}


@pytest.mark.parametrize("i", range(len(ANSWERS)))
def test_answer(got, i):
    text, company, domain, branded = ANSWERS[i]
    text = text or ""
    r, low = got[i], text.lower()
    m = plain_mentions(text, company, domain, branded)
    assert [(x.pos, x.kind, pytest.approx(x.confidence), x.text) for x in r.mentions] == m
    c = plain_citations(text, company)
    assert [tuple(x) for x in r.citations] == c
    kinds = {x[1] for x in m}
    assert (r.has_company, r.has_domain, r.has_url) == (bool(kinds & {"exact", "partial"}), "domain" in kinds, "url" in kinds)
    urls = re.findall(R.URL, text)
    own = [u for u in urls if domain and domain.lower() in u.lower()]
    assert (r.urls, r.company_urls, r.external_urls) == (urls, own, [u for u in urls if u not in own])
    good, bad = (sum(w in low for w in words) for words in (R.PRAISE, R.BLAME))
    tone = (good - bad) / (good + bad) if good + bad else 0.0
    assert r.tone == pytest.approx(tone)
    assert r.sentiment == ("positive" if tone > 0.3 else "negative" if tone < -0.3 else "mixed" if good and bad else "neutral")
    hedges, sure = ([p for p in words if p in low] for words in (R.HEDGES, R.CERTAINTIES))
    h, s = len(hedges), len(sure)
    level = "unknown" if not h + s else "low" if h > 2 * s else "high" if s > 2 * h else "uncertain" if h > s else "medium"
    explicit = any(k != "implicit" for _, k, _, _ in c)
    claims = sum(bool(re.search(p, text)) for p in R.CLAIMS)
    assert (r.hedges, r.certainties, r.confidence) == (hedges, sure, level)
    assert r.refusal == any(re.search(p, low) for p in R.REFUSALS) and r.uncertain == (level in ("low", "uncertain") or h > 2)
    assert r.risk == ((level == "high" and not explicit and bool(m)) or (claims >= 3 and not explicit))
    assert (r.n_words, r.n_sentences, r.n_chars) == (len(text.split()), len(re.findall("[.!?]+", text)), len(text))


def test_cases_by_hand(got):
    assert [x.kind for x in got[0].mentions][:2] == ["exact", "partial"] and got[0].explicit_citation and got[0].sentiment == "positive"
    assert got[1].confidence == "low" and got[1].sentiment == "negative" and got[2].refusal and got[3].risk and got[5].risk
    assert len(got[10].mentions) == 200 and [x.kind for x in got[9].mentions] == ["partial", "domain", "branded"]


def test_variations(spark):
    names = ["The Blue Bird Company", "Acme", "acme inc.", "The Co", "Bo Li", "Big Data Technologies", "The", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", R.variations(F.col("n")).alias("v")).collect():
        assert r.v == plain_names(r.n)
