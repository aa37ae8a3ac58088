"""URL and domain functions on awkward links."""

from pyspark.sql import functions as F

from framelens.functions import urls, values
from framelens.lexicon import DomainRule
from framelens.operators import joins

URLS = ["HTTPS://WWW.Example.COM/a?b", "example.com?x=1", "http://user@rt.com:8080/", "http://start.com/", "news.co.uk", "", None,
        "http://www.www.gov.uk/x", "https://sub.known.org/rt.com"]


def run(spark, c):
    return [r[0] for r in spark.createDataFrame([(u,) for u in URLS], "url string").select(c).collect()]


def test_host_parent_tld(spark):
    h = urls.host(F.col("url"))
    assert run(spark, h) == ["example.com", "example.com", "user@rt.com:8080", "start.com", "news.co.uk", "", "", "www.gov.uk", "sub.known.org"]
    assert run(spark, urls.parent(h))[-1] == "known.org" and run(spark, urls.parent(h))[4] == "co.uk"
    assert run(spark, urls.netloc(F.col("url")))[7] == "gov.uk", "every www. goes"
    assert run(spark, urls.tld(F.concat(F.lit("http://"), "url")))[4] == ".co.uk"


def test_match_modes_differ(spark):
    rule = (DomainRule("rt.com", "t1"),)
    by = {m: run(spark, urls.source_tier(F.col("url"), rule, m, "-")) for m in ("boundary", "substring")}
    assert by["boundary"] == ["-", "-", "t1", "-", "-", "-", "-", "-", "t1"]
    assert by["substring"] == ["-", "-", "t1", "t1", "-", "-", "-", "-", "t1"], "start.com contains rt.com"
    suffix = run(spark, urls.domain_value(urls.host(F.col("url")), (DomainRule("known.org", "k"),), "suffix", "-"))
    assert suffix == ["-"] * 8 + ["k"]


def test_boundary_looks_at_the_first_occurrence_only(spark):
    d = spark.createDataFrame([("http://start.com/rt.com",)], "url string")
    assert d.select(urls.source_tier(F.col("url"), (DomainRule("rt.com", "t1"),), "boundary", "-")).first()[0] == "-"


def test_first_rule_wins(spark):
    rules = (DomainRule("example.com", "one"), DomainRule("example.com", "two"))
    assert run(spark, urls.source_tier(F.col("url"), rules))[0] == "one"
    assert run(spark, urls.sanction(F.col("url"), (DomainRule("known", "E", "R"),)))[-1] == "E [R]"


def test_country_and_cluster(spark):
    h = urls.host(F.col("url"))
    assert run(spark, urls.domain_country(h, {"known.org": "K"}))[-1] == "K"
    plain, compound = run(spark, urls.domain_country(h, {}))[4], run(spark, urls.domain_country(h, {}, compound=True))[4]
    assert plain == "UK" and compound == "UK"
    c = urls.language_cluster(F.lit(""), F.col("url"), (("English", (), (".com",)),))
    assert run(spark, c)[0] == "English" and run(spark, c)[5] == "Other"
    assert run(spark, urls.infer_country(F.lit(" "), F.col("url")))[7] == "Unknown"


def test_lookup_host_and_index(spark):
    d = spark.createDataFrame([("a.x.org",), ("x.org",), ("y.org",), (None,)], "host string")
    directory = spark.createDataFrame([("a.x.org", None), ("x.org", "news")], "domain string, type string")
    got = {r["host"]: r["type"] for r in joins.lookup_host(d, directory, ["type"]).collect()}
    assert got == {"a.x.org": None, "x.org": "news", "y.org": None, None: None}, "an entry of its own hides the parent"
    index = spark.createDataFrame([("x.org", [("E1",), ("E2",)]), ("z.org", [("E3",)])], "domain string, entries array<struct<entity_name:string>>")
    u = spark.createDataFrame([("http://www.a.x.org/1",), ("http://x.org",), ("http://w.z.org",), ("http://z.org",)], "url string")
    got = {r["url"]: (r["hit_domain"], r["entity_name"]) for r in joins.lookup_index(u, index, ("z.org",)).collect()}
    assert got == {"http://www.a.x.org/1": ("x.org", "E1"), "http://x.org": ("x.org", "E1"), "http://w.z.org": (None, None), "http://z.org": (None, None)}


def test_citation_origin_and_urls(spark):
    d = spark.createDataFrame([("see https://a.ru/x) and https://a.ru/x \"http://www.b.gov.ru/\"",)], "t string")
    assert d.select(urls.extract_urls(F.col("t"))).first()[0] == ["https://a.ru/x", "http://www.b.gov.ru/"]
    o = urls.citation_origin(F.col("u"), ("s.ru",), ("gov.ru",), (("russian_origin", (".ru",)),))
    rows = spark.createDataFrame([("http://m.s.ru",), ("http://b.gov.ru",), ("http://c.ru",), ("http://d.com",)], "u string").select(o).collect()
    assert [r[0] for r in rows] == ["sanctioned", "government", "russian_origin", "international"]


def test_values(spark):
    d = spark.createDataFrame([("12M", "10.1016/x", "AS: ABUSE@x-y.net.RU")], "n string, doi string, t string")
    r = d.select(values.human_number(F.col("n")), values.publisher(F.lit(""), F.col("doi")), values.abuse_tld(F.col("t"))).first()
    assert tuple(r) == (12_000_000, "Elsevier", "ru")
    h = [tuple(x[0]) for x in spark.createDataFrame([("10.0.0.0/30",), ("10.0.0.7/31",), ("10.0.0.9/32",), ("192.168.1.0/24",)], "p string").select(values.spaced_hosts(F.col("p"), 3)).collect()]
    assert h == [("10.0.0.1", "10.0.0.2"), ("10.0.0.6", "10.0.0.7"), ("10.0.0.9",), ("192.168.1.64", "192.168.1.127", "192.168.1.190")]
    m = spark.createDataFrame([({"b": [1, 3], "a": [0], "c": [3]},), (None,)], "m map<string,array<int>>").select(values.rebuild_text(F.col("m"))).collect()
    assert [x[0] for x in m] == ["a b c", ""]
    e = spark.createDataFrame([({"enwiki": "E", "commonswiki": "C", "dewikiquote": "Q"},)], "m map<string,string>").select(values.edition_links(F.col("m"))).first()[0]
    assert e == {"en": "E"}
    t = spark.createDataFrame([("x 10.1234/ab.c., y",), ("none",)], "t string").select(values.find_doi(F.col("t"))).collect()
    assert [x[0] for x in t] == ["10.1234/ab.c", None]
