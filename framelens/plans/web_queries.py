"""Queries over pages and links: URL functions, HTML clean-up, page probes, directory joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions import fixed, pages, urls, values
from framelens.lexicon import DomainRule
from framelens.operators import aggregates as ag
from framelens.operators import filters as fl
from framelens.operators import joins
from framelens.operators.scale import compute_once
from framelens.plans.registry import Tables, query, with_records

SANCTIONS = (
    DomainRule("tass.ru", "Agency T", "Reg 1"),
    DomainRule("th.example.net", "Farm N", "Reg 2"),
    DomainRule("th", "Broad", "Reg 3"),
)
PLATFORMS = (
    ("blog", "host_has", "livejournal"),
    ("blog", "host_has", "blogspot"),
    ("portal", "host_is", "m.example.org"),
    ("maps", "url_has", "/russia/"),
    ("news_aggregator", "host_has", "spam-farm"),
)
COUNTRY_TLDS = (("russian_origin", (".ru", ".su")),)
KNOWN = {"livejournal.com": "US", "example.net": "Atlantis"}
CLUSTERS = (("German", ("German",), (".de",)), ("French", ("French",), (".fr",)), ("English", ("English",), (".com", ".co.uk", ".org", ".net")))

# Oracle: host of a link, by plain string splitting.
HOST = """, hs AS (SELECT *, lower(url) AS u, split_part(split_part(CASE WHEN contains(lower(url), '://') THEN substr(lower(url), instr(lower(url), '://') + 3) ELSE lower(url) END, '/', 1), '?', 1) AS h0 FROM links),
h AS (SELECT *, CASE WHEN starts_with(h0, 'www.') THEN substr(h0, 5) ELSE h0 END AS host FROM hs),
hp AS (SELECT *, CASE WHEN len(string_split(host, '.')) >= 2 THEN string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] ELSE host END AS parent FROM h)
"""
# Authority part of a link, only when there is a scheme.
NET = """, n AS (SELECT *, CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) ELSE '' END AS net FROM links),
tl AS (SELECT *, CASE WHEN net LIKE '%.co.uk' THEN '.co.uk' WHEN net LIKE '%.com.au' THEN '.com.au' WHEN net LIKE '%.co.nz' THEN '.co.nz' WHEN net LIKE '%.com.br' THEN '.com.br' WHEN net LIKE '%.co.za' THEN '.co.za'
  WHEN contains(net, '.') THEN '.' || string_split(net, '.')[-1] ELSE '' END AS tld FROM n)
"""
INST = """CASE WHEN contains(u, '.gov.') OR u LIKE '%.gov' THEN 'government' WHEN contains(u, '.edu.') OR u LIKE '%.edu' OR contains(u, '.ac.') THEN 'education'
  WHEN contains(u, '.mil.') OR u LIKE '%.mil' THEN 'military' ELSE '' END"""
SANC = "CASE WHEN contains(u, 'tass.ru') THEN 'Agency T [Reg 1]' WHEN contains(u, 'th.example.net') THEN 'Farm N [Reg 2]' WHEN contains(u, 'th') THEN 'Broad [Reg 3]' ELSE '' END"
PLAT = """CASE WHEN contains(host, 'livejournal') OR contains(host, 'blogspot') THEN 'blog' WHEN host = 'm.example.org' THEN 'portal' WHEN contains(u, '/russia/') THEN 'maps' WHEN contains(host, 'spam-farm') THEN 'news_aggregator' ELSE '' END"""
ORIGIN = """CASE WHEN host LIKE '%.ua' THEN 'ukrainian' WHEN host LIKE '%.ru' OR host LIKE '%.su' THEN 'russian' WHEN contains(u, '.gov.ru') OR contains(u, '.edu.ru') OR contains(u, '.ac.ru') THEN 'russian'
  WHEN contains(u, '.gov.ua') OR contains(u, '.edu.ua') THEN 'ukrainian' WHEN host LIKE '%.uk' THEN 'british' WHEN host LIKE '%.de' THEN 'german' WHEN host LIKE '%.fr' THEN 'french' WHEN host LIKE '%.eu' THEN 'european' ELSE 'international' END"""
DIRTYPE = "CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 'society' THEN 'society_org' WHEN {t} IN ('news', 'tech', 'health') THEN {t} ELSE 'other_categorized' END"


def links(t: Tables) -> DataFrame:
    return t.derived("links")


def hosts(t: Tables) -> DataFrame:
    return links(t).withColumn("host", urls.host(F.col("url")))


def directory(t: Tables) -> DataFrame:
    """Last line per domain."""
    d = t.derived("directory")
    return d.groupBy("domain").agg(F.max_by(F.struct("name", "type"), "line_no").alias("v")).select("domain", "v.*")


DIR = ", dir AS (SELECT domain, arg_max(type, line_no) AS type, arg_max(name, line_no) AS name FROM directory GROUP BY domain)"


@query("url_01_host", with_records("links", HOST + "SELECT page_id, host FROM hp"))
def _(t):
    return hosts(t).select("page_id", "host")


@query("url_02_parent", with_records("links", HOST + "SELECT page_id, parent FROM hp"))
def _(t):
    return hosts(t).select("page_id", urls.parent(F.col("host")).alias("parent"))


@query("url_03_tld", with_records("links", NET + "SELECT page_id, tld FROM tl"))
def _(t):
    return links(t).select("page_id", urls.tld(F.col("url")).alias("tld"))


_TLD_CASE = "CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.TLD_COUNTRY.items()) + " END"


@query("url_04_domain_country", with_records("links", HOST + f"""SELECT page_id,
  coalesce(CASE WHEN host = 'livejournal.com' OR host LIKE '%.livejournal.com' THEN 'US' WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'Atlantis' END,
    CASE WHEN contains(host, '.') THEN {_TLD_CASE.format(x="string_split(host, '.')[-1]")} END, '') AS country,
  coalesce(CASE WHEN host = 'livejournal.com' OR host LIKE '%.livejournal.com' THEN 'US' WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'Atlantis' END,
    {_TLD_CASE.format(x="parent")}, {_TLD_CASE.format(x="string_split(host, '.')[-1]")}, '') AS country_compound FROM hp"""))
def _(t):
    h = F.col("host")
    return hosts(t).select("page_id", urls.domain_country(h, KNOWN).alias("country"), urls.domain_country(h, KNOWN, compound=True).alias("country_compound"))


TIER = (DomainRule("th.example", "t1"), DomainRule("tass.ru", "t2"), DomainRule("example.org", "t3"), DomainRule("tass.ru", "t4"))


@query("url_05_source_tier", with_records("links", """, u AS (SELECT page_id, lower(url) AS u FROM links),
d AS (SELECT * FROM (VALUES (1, 'th.example', 't1'), (2, 'tass.ru', 't2'), (3, 'example.org', 't3'), (4, 'tass.ru', 't4')) v(p, dom, tier)),
b AS (SELECT page_id, arg_min(tier, p) AS tier FROM u, d WHERE instr(u, dom) = 1 OR (instr(u, dom) > 1 AND substr(u, instr(u, dom) - 1, 1) IN ('/', '.', '@')) GROUP BY page_id),
s AS (SELECT page_id, arg_min(tier, p) AS tier FROM u, d WHERE contains(u, dom) GROUP BY page_id)
SELECT page_id, coalesce(b.tier, 'independent') AS boundary, coalesce(s.tier, 'independent') AS substr_tier FROM u LEFT JOIN b USING (page_id) LEFT JOIN s USING (page_id)"""))
def _(t):
    u = F.col("url")
    return links(t).select("page_id", urls.source_tier(u, TIER).alias("boundary"), urls.source_tier(u, TIER, "substring").alias("substr_tier"))


@query("url_06_sanction", with_records("links", HOST + f"SELECT page_id, {SANC} AS sanction FROM hp"))
def _(t):
    return links(t).select("page_id", urls.sanction(F.col("url"), SANCTIONS).alias("sanction"))


@query("url_07_origin", with_records("links", HOST + f"SELECT page_id, {ORIGIN} AS origin FROM hp"))
def _(t):
    return hosts(t).select("page_id", urls.origin(F.col("host"), F.col("url")).alias("origin"))


@query("url_08_institution", with_records("links", HOST + f"SELECT page_id, {INST} AS institution FROM hp"))
def _(t):
    return links(t).select("page_id", urls.institution(F.col("url")).alias("institution"))


@query("url_09_platform", with_records("links", HOST + f"SELECT page_id, {PLAT} AS platform FROM hp"))
def _(t):
    return hosts(t).select("page_id", urls.platform_class(F.col("url"), F.col("host"), PLATFORMS).alias("platform"))


def site_types(t: Tables) -> DataFrame:
    d = joins.lookup_host(hosts(t), directory(t), ["type"])
    u = F.col("url")
    return d.select(
        "page_id", urls.origin(F.col("host"), u).alias("origin"),
        urls.site_type(urls.institution(u), urls.sanction(u, SANCTIONS[:2]), urls.platform_class(u, F.col("host"), PLATFORMS), F.col("type")).alias("site_type"))


SITE = HOST + DIR + f""", st AS (SELECT page_id, {ORIGIN} AS origin, coalesce(nullif({INST}, ''), CASE WHEN contains(u, 'tass.ru') OR contains(u, 'th.example.net') THEN 'sanctioned_media' END, nullif({PLAT}, ''),
  {DIRTYPE.format(t='coalesce(d1.type, d2.type)')}, 'uncategorized') AS site_type FROM hp LEFT JOIN dir d1 ON host = d1.domain LEFT JOIN dir d2 ON parent = d2.domain)
"""


@query("url_10_site_type", with_records(["links", "directory"], SITE + "SELECT * FROM st"))
def _(t):
    return site_types(t)


@query("url_11_is_news", "SELECT page_id, contains(lower(url), 'blog.') OR contains(lower(url), 'spam-farm') AS news FROM pages")
def _(t):
    return t.pages.select("page_id", urls.is_news(F.col("url"), ("blog.", "spam-farm")).alias("news"))


@query("url_12_academic_domain", with_records("links", "SELECT page_id, CASE WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv.org' END AS academic FROM links"))
def _(t):
    return links(t).select("page_id", urls.academic_domain(F.col("url")).alias("academic"))


@query("url_13_url_framing", with_records("links", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '/russia/') THEN 'pro_b' WHEN regexp_matches(lower(url), '[.]gov.*/en|[.]edu.*/fr') THEN 'pro_a' WHEN regexp_matches(lower(url), '/annexed[_-]') THEN 'critical' END AS framing FROM links"))
def _(t):
    groups = (("pro_b", ("/russia/",)), ("pro_a", ("[.]gov.*/en", "[.]edu.*/fr")), ("critical", ("/annexed[_-]",)))
    return links(t).select("page_id", urls.url_framing(F.col("url"), groups).alias("framing"))


ART_NET = """, n AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS net FROM articles),
tl AS (SELECT *, CASE WHEN net LIKE '%.co.uk' THEN '.co.uk' ELSE '.' || string_split(net, '.')[-1] END AS tld FROM n),
cl AS (SELECT *, CASE WHEN language = 'German' OR tld LIKE '%.de' THEN 'German' WHEN language = 'French' OR tld LIKE '%.fr' THEN 'French' WHEN language = 'English' OR tld LIKE '%.com' OR tld LIKE '%.co.uk' OR tld LIKE '%.org' OR tld LIKE '%.net' THEN 'English' ELSE 'Other' END AS cluster,
  coalesce(nullif(trim(sourcecountry), ''), CASE tld WHEN '.de' THEN 'Germany' WHEN '.fr' THEN 'France' WHEN '.co.uk' THEN 'United Kingdom' END, 'Unknown') AS country FROM tl)
"""


def articles(t: Tables) -> DataFrame:
    a = t.derived("articles")
    return a.withColumns({"cluster": urls.language_cluster(F.col("language"), F.col("url"), CLUSTERS), "country": urls.infer_country(F.col("sourcecountry"), F.col("url"))})


@query("url_14_language_cluster", with_records("articles", ART_NET + "SELECT doc_id, cluster FROM cl"))
def _(t):
    return articles(t).select("doc_id", "cluster")


@query("url_15_country", with_records("articles", ART_NET + "SELECT doc_id, country FROM cl"))
def _(t):
    return articles(t).select("doc_id", "country")


URLS = ", c AS (SELECT *, list_distinct(regexp_extract_all(text, 'https?://[^\\s\\])>\"'']+')) AS cited FROM responses)"


@query("url_16_extract_urls", with_records("responses", URLS + " SELECT response_id, array_to_string(list_sort(cited), ' ') AS cited FROM c"))
def _(t):
    return t.derived("responses").select("response_id", F.array_join(F.array_sort(urls.extract_urls(F.col("text"))), " ").alias("cited"))


def citations(t: Tables) -> DataFrame:
    d = t.derived("responses").select("response_id", "model", "language", F.explode_outer(urls.extract_urls(F.col("text"))).alias("url")).where("url IS NOT NULL")
    return d.withColumn("origin", urls.citation_origin(F.col("url"), ("state1.example.ru", "a3.example.org"), ("gov.example",), COUNTRY_TLDS))


CITES = URLS + """, e AS (SELECT response_id, model, language, unnest(cited) AS url FROM c),
f AS (SELECT *, regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '^www[.]', '') AS h FROM e),
ci AS (SELECT *, CASE WHEN h IN ('state1.example.ru', 'a3.example.org') THEN 'sanctioned' WHEN h = 'gov.example' OR h LIKE '%.gov.example' THEN 'government' WHEN h LIKE '%.ru' OR h LIKE '%.su' THEN 'russian_origin' ELSE 'international' END AS origin FROM f)
"""


@query("url_17_citation_origin", with_records("responses", CITES + "SELECT origin, count(*) AS n FROM ci GROUP BY origin"))
def _(t):
    return citations(t).groupBy("origin").agg(F.count("*").alias("n"))


@query("set_04_distinct_urls", with_records("responses", URLS + " SELECT model, sum(len(cited))::BIGINT AS n FROM c GROUP BY model"))
def _(t):
    d = t.derived("responses").select("model", F.size(urls.extract_urls(F.col("text"))).cast("long").alias("k"))
    return d.groupBy("model").agg(F.sum("k").alias("n"))


@query("agg_24_citation_rates", with_records("responses", CITES + """, r AS (SELECT response_id, model, language, count(*) FILTER (origin = 'sanctioned') AS k FROM ci GROUP BY ALL)
SELECT model, language, count(*) AS responses, count(*) FILTER (k > 0) AS with_flagged, round(100.0::DOUBLE * count(*) FILTER (k > 0) / count(*), 1) AS pct FROM r GROUP BY model, language"""))
def _(t):
    flagged = citations(t).groupBy("response_id", "model", "language").agg(F.count_if(F.col("origin") == "sanctioned").alias("n_flagged"))
    return ag.citation_rates(flagged, ["model", "language"])


@query("agg_24_top_flagged", with_records("responses", CITES + "SELECT h AS domain, count(*) AS n FROM ci WHERE origin = 'sanctioned' GROUP BY h ORDER BY n DESC, h LIMIT 20"))
def _(t):
    d = citations(t).where(F.col("origin") == "sanctioned").select(urls.host(F.col("url")).alias("domain"))
    return ag.top_counts(d, "domain", 20)


@query("join_01_lookup_host", with_records(["links", "directory"], HOST + DIR + "SELECT page_id, host, coalesce(d1.type, d2.type) AS type, coalesce(d1.name, d2.name) AS name FROM hp LEFT JOIN dir d1 ON host = d1.domain LEFT JOIN dir d2 ON parent = d2.domain"))
def _(t):
    return joins.lookup_host(hosts(t), directory(t), ["type", "name"]).select("page_id", "host", "type", "name")


@query("join_02_lookup_index", with_records(["links", "directory"], """, n AS (SELECT page_id, CASE WHEN contains(url, '://') THEN replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), 'www.', '') ELSE '' END AS h FROM links)""" + DIR + """,
p AS (SELECT *, CASE WHEN len(string_split(h, '.')) >= 2 THEN string_split(h, '.')[-2] || '.' || string_split(h, '.')[-1] ELSE h END AS par FROM n),
wl AS (SELECT * FROM (VALUES ('example.com'), ('m.example.org'), ('spam-farm.example.org')) v(d))
SELECT page_id, CASE WHEN h IN (SELECT d FROM wl) THEN NULL WHEN d1.name IS NOT NULL THEN h WHEN par IN (SELECT d FROM wl) THEN NULL WHEN d2.name IS NOT NULL THEN par END AS hit_domain,
  CASE WHEN h IN (SELECT d FROM wl) THEN NULL WHEN d1.name IS NOT NULL THEN d1.name WHEN par IN (SELECT d FROM wl) THEN NULL ELSE d2.name END AS entity_name,
  CASE WHEN h IN (SELECT d FROM wl) THEN NULL WHEN d1.name IS NOT NULL THEN 'list/' || d1.type WHEN par IN (SELECT d FROM wl) THEN NULL ELSE 'list/' || d2.type END AS datasets,
  CASE WHEN h IN (SELECT d FROM wl) THEN NULL WHEN d1.name IS NOT NULL THEN left(d1.name, 8) WHEN par IN (SELECT d FROM wl) THEN NULL ELSE left(d2.name, 8) END AS country
FROM p LEFT JOIN dir d1 ON h = d1.domain LEFT JOIN dir d2 ON par = d2.domain"""))
def _(t):
    entry = F.struct(F.col("name").alias("entity_name"), F.array(F.lit("list"), F.col("type")).alias("datasets"), F.array(F.left("name", F.lit(8))).alias("country"))
    other = F.struct(F.lit("second").alias("entity_name"), F.array(F.lit("x")).alias("datasets"), F.array(F.lit("y")).alias("country"))
    index = directory(t).select("domain", F.array(entry, other).alias("entries"))
    got = joins.lookup_index(links(t), index, ("example.com", "m.example.org", "spam-farm.example.org"))
    return got.select("page_id", "hit_domain", "entity_name", F.concat_ws("/", "datasets").alias("d"), F.concat_ws("/", "country").alias("c")).select(
        "page_id", "hit_domain", "entity_name", F.nullif("d", F.lit("")).alias("datasets"), F.nullif("c", F.lit("")).alias("country"))


@query("agg_07_crosstab", with_records(["links", "directory"], SITE + "SELECT origin, site_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM st), 4) AS pct FROM st GROUP BY 1, 2 ORDER BY n DESC, origin, site_type LIMIT 25"))
def _(t):
    return ag.crosstab(site_types(t), "origin", "site_type", 25)


@query("agg_07_coverage", with_records(["links", "directory"], SITE + "SELECT count(*) AS total, count(*) FILTER (site_type <> 'uncategorized') AS categorized, count(*) FILTER (site_type = 'uncategorized') AS uncategorized FROM st"))
def _(t):
    return ag.coverage(site_types(t), "site_type")


@query("agg_11_framing_stats", with_records("articles", ART_NET + """, b AS (SELECT country, query_label, count(*) AS n FROM cl GROUP BY ALL), tot AS (SELECT country, sum(n)::BIGINT AS total FROM b GROUP BY country ORDER BY total DESC, country LIMIT 30)
SELECT country, total, string_agg(query_label || '=' || n, ',' ORDER BY query_label) AS counts FROM tot JOIN b USING (country) GROUP BY ALL"""))
def _(t):
    d = ag.top_nested(articles(t), "country", "query_label", 30)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return d.select("country", "total", text.alias("counts"))


# ---- HTML -----------------------------------------------------------------

_BLOCKS = "coalesce(html, '')"
for _tag in fixed.HTML_BLOCKS:
    _BLOCKS = f"regexp_replace({_BLOCKS}, '<{_tag}[^>]*>.*?</{_tag}>', '', 'gis')"
_NOTAG = f"regexp_replace({_BLOCKS}, '<[^>]+>', ' ', 'g')"
_ENT = _NOTAG
for _raw, _ch in fixed.HTML_ENTITIES:
    _ENT = f"replace({_ENT}, '{_raw}', '{_ch.replace(chr(39), chr(39) * 2)}')"


@query("fn_02_html_to_text", f"SELECT page_id, left(trim(regexp_replace({_ENT}, '[\\s\\p{{Z}}]+', ' ', 'g')), 5000) AS text, trim(regexp_replace({_ENT}, '[\\s\\p{{Z}}]+', ' ', 'g')) AS whole_text, left(trim(regexp_replace({_NOTAG}, '[\\s\\p{{Z}}]+', ' ', 'g')), 3000) AS short_text FROM pages")
def _(t):
    h = F.col("html")
    return t.pages.select("page_id", pages.html_to_text(h, 5000).alias("text"), pages.html_to_text(h).alias("whole_text"), pages.html_to_text(h, 3000, entities=False).alias("short_text"))


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _raw, _ch in fixed.HTML_ENTITIES:
    _TITLE = f"replace({_TITLE}, '{_raw}', '{_ch.replace(chr(39), chr(39) * 2)}')"
_TITLE = f"left(trim({_TITLE}), 200)"


@query("fn_03_title", f"SELECT page_id, {_TITLE} AS title, len(list_filter(regexp_extract_all(html, '<title[^>]*>(.*?)</title>', 1), lambda x: x <> '' AND NOT contains(x, 'Search Results')))::BIGINT AS n_titles FROM pages")
def _(t):
    return t.pages.select("page_id", pages.page_title(F.col("html")).alias("title"), F.size(pages.feed_titles(F.col("html"))).cast("long").alias("n_titles"))


# Pages have no breadcrumbs; every third gets a JSON-LD block and every fourth an element, by the same expression.
_CRUMB_HTML = """CASE WHEN page_id % 3 = 0 THEN concat(html, '<script type="application/ld+json">BreadcrumbList ', url, '</script>')
  WHEN page_id % 4 = 0 THEN concat(html, '<ol class="top breadcrumb x"><li>Home</li> <li>', url, '</li></ol>') ELSE html END"""


@query("fn_04_breadcrumb", f"""WITH p AS (SELECT page_id, {_CRUMB_HTML} AS html FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN left(list_filter(regexp_extract_all(html, '(?is)<script[^>]*type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1), lambda b: contains(b, 'BreadcrumbList'))[1], 400)
  WHEN page_id % 4 = 0 THEN left(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<ol[^>]*class="[^"]*breadcrumb[^"]*"[^>]*>(.*?)</ol>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 200) ELSE '' END AS crumb FROM p""")
def _(t):
    return t.pages.selectExpr("page_id", f"{_CRUMB_HTML} AS html").select("page_id", pages.breadcrumb(F.col("html")).alias("crumb"))


# Elements of several kinds, whose text is known: quotes of all kinds, a label, elements of the same name inside, texts after the end.
_CRUMB_KINDS = """CASE page_id % 6
  WHEN 0 THEN concat('<div class="nav Breadcrumb"></div><div data-x="a > b" class="x breadcrumbs"><div>Home</div> <div>to <div>', url, '</div></div></div><div>after</div>', html)
  WHEN 1 THEN concat('<p>no</p><section class=''my breadcrumb it"s''>Home &amp; <br><section>', url, '</section></section> after', html)
  WHEN 2 THEN concat('<p>no</p><nav id=n aria-label="Page Breadcrumb"><nav>Home</nav><script>var x = "</nav>";</script> ', url, '</nav><nav>after</nav>', html)
  WHEN 3 THEN concat('<ul><li class=breadcrumb>Home<!-- </li> --> <b>', url, '</ul> after', html)
  WHEN 4 THEN concat('<nav aria-label=breadcrumb>label</nav><ol class="breadcrumb"><li>Home<li>', url, '</i></ol> after', html) ELSE html END"""


@query("fn_04_breadcrumb_elements", """SELECT page_id, left(CASE page_id % 6 WHEN 0 THEN 'Home to ' || url WHEN 1 THEN 'Home & ' || url WHEN 2 THEN 'Home ' || url WHEN 3 THEN 'Home ' || url
  WHEN 4 THEN 'Home ' || url ELSE '' END, 200) AS crumb FROM pages""")
def _(t):
    return t.pages.selectExpr("page_id", f"{_CRUMB_KINDS} AS html").select("page_id", pages.breadcrumb(F.col("html")).alias("crumb"))


_CODES_BODY = """CASE WHEN page_id % 4 = 0 THEN concat('{"q": 1, "country": "UA", "x": "country=RU", "country":"', CASE WHEN page_id % 3 = 0 THEN 'RU' ELSE 'DE' END, '"} ', html)
  WHEN page_id % 4 = 1 THEN concat(html, '<a href="?country=RU&z=1">') WHEN page_id % 4 = 2 THEN concat('"country":"UA" ', html) ELSE html END"""


@query("fn_05_ordered_codes", f"""WITH p AS (SELECT page_id, {_CODES_BODY} AS s FROM pages)
SELECT page_id, CASE WHEN starts_with(trim(s), '{{') OR starts_with(trim(s), '[') OR contains(lower(s), 'country=') THEN
  array_to_string(list_concat(regexp_extract_all(s, '"country"\\s*:\\s*"([A-Z]{{2}})"', 1), regexp_extract_all(s, 'country=([A-Z]{{2}})\\b', 1))[1:20], ',') ELSE '' END AS codes FROM p""")
def _(t):
    return t.pages.selectExpr("page_id", f"{_CODES_BODY} AS body").select("page_id", F.array_join(pages.ordered_codes(F.col("body")), ",").alias("codes"))


RULES = pages.PageRules(
    a_patterns=(r"(?i) with ", r"(?i) und ", "[> ]The[ <]"),
    b_patterns=(r"(?i) was ", r"(?i) les ", "[> ]Le[ <]"),
    topic_pattern=r"(?i)tion",
    url_a=r"/de/|/fr/4|country=ua\b",
    url_b=r"/es/|/fr/8",
    tz_a="(?i)europe/paris",
    tz_b="track",
    code_a="UA",
    code_b="RU",
    b_origin="B",
)
_CNT_A = "len(regexp_extract_all(s, '(?i) with ')) + len(regexp_extract_all(s, '(?i) und ')) + len(regexp_extract_all(s, '[> ]The[ <]'))"
_CNT_B = "len(regexp_extract_all(s, '(?i) was ')) + len(regexp_extract_all(s, '(?i) les ')) + len(regexp_extract_all(s, '[> ]Le[ <]'))"
PROBE = f"""pg AS (SELECT page_id, url, {_TITLE} AS title, {_CODES_BODY} AS s, CASE page_id % 9 WHEN 0 THEN 'untested' WHEN 1 THEN 'na' WHEN 2 THEN 'ambiguous' ELSE 'correct' END AS prior,
  CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 0 ELSE 200 END AS http, CASE WHEN page_id % 11 = 0 THEN 'B' ELSE 'X' END AS origin FROM pages),
pb AS (SELECT *, CASE WHEN regexp_matches(lower(url), '/de/|/fr/4|country=ua\\b') THEN 'a' WHEN regexp_matches(lower(url), '/es/|/fr/8') THEN 'b' END AS sig,
  regexp_matches(title, '(?i) with | und ') OR regexp_matches(title, '[> ]The[ <]') AS ta, regexp_matches(title, '(?i) was | les ') OR regexp_matches(title, '[> ]Le[ <]') AS tb, regexp_matches(title, '(?i)tion') AS topic,
  {_CNT_A} AS na, {_CNT_B} AS nb, contains(s, 'track') AS tz_b,
  CASE WHEN starts_with(trim(s), '{{') OR contains(lower(s), 'country=') THEN list_concat(regexp_extract_all(s, '"country"\\s*:\\s*"([A-Z]{{2}})"', 1), regexp_extract_all(s, 'country=([A-Z]{{2}})\\b', 1))[1:20] ELSE [] END AS codes FROM pg)
"""


def probed(t: Tables) -> DataFrame:
    d = t.pages.selectExpr(
        "page_id", "url", "html", f"{_CODES_BODY} AS body",
        "CASE page_id % 9 WHEN 0 THEN 'untested' WHEN 1 THEN 'na' WHEN 2 THEN 'ambiguous' ELSE 'correct' END AS prior",
        "CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 0 ELSE 200 END AS http", "CASE WHEN page_id % 11 = 0 THEN 'B' ELSE 'X' END AS origin")
    d = d.withColumn("title", pages.page_title(F.col("html")))
    return compute_once(d, {"p": pages.probe_page(F.col("url"), F.col("title"), F.col("body"), RULES)})


@query("cls_25_probe_page", f"WITH {PROBE} SELECT page_id, sig AS url_signal, ta AS title_a, tb AS title_b, topic AS title_topic, na::INT AS a_hits, nb::INT AS b_hits, tz_b, array_to_string(codes, ',') AS codes FROM pb")
def _(t):
    p = F.col("p")
    names = ("url_signal", "title_a", "title_b", "title_topic", "a_hits", "b_hits", "tz_b")
    return probed(t).select("page_id", *[p[n].alias(n) for n in names], F.array_join(p["codes"], ",").alias("codes"))


_STATUS = """CASE WHEN prior = 'untested' THEN 'untested' WHEN http = 0 OR http >= 400 THEN 'unreachable'
  WHEN origin = 'B' AND sig = 'a' AND na > nb THEN 'correct' WHEN origin = 'B' THEN 'incorrect'
  WHEN codes[1] = 'UA' THEN 'correct' WHEN codes[1] = 'RU' THEN 'incorrect'
  WHEN sig = 'b' OR (tb AND NOT ta) THEN 'incorrect'
  WHEN sig = 'a' THEN CASE WHEN ta THEN 'correct' WHEN topic AND NOT tb THEN 'url_correct_ui_ambiguous' ELSE 'correct' END
  WHEN ta AND NOT tb THEN 'correct' WHEN topic THEN 'url_correct_ui_ambiguous' WHEN prior = 'na' THEN 'na'
  WHEN na >= 5 AND na > nb * 2 THEN 'correct' WHEN nb >= 5 AND nb > na * 2 THEN 'incorrect' ELSE 'url_correct_ui_ambiguous' END"""


def statuses(t: Tables) -> DataFrame:
    s = pages.page_status(F.col("prior"), F.col("http"), F.col("origin"), F.col("p"), RULES)
    return probed(t).withColumn("s", s).select("page_id", "url", "prior", F.col("s.status").alias("status"), F.col("s.reason").alias("reason"))


@query("cls_26_page_status", f"WITH {PROBE} SELECT page_id, {_STATUS} AS status, true AS has_reason FROM pb")
def _(t):
    return statuses(t).select("page_id", "status", (F.length("reason") > 0).alias("has_reason"))


_HITS = "'hits=' || na || '/' || nb"
_REASON = f"""CASE WHEN prior = 'untested' THEN 'not probed by design' WHEN http = 0 OR http >= 400 THEN 'http=' || http
  WHEN origin = 'B' AND sig = 'a' AND na > nb THEN 'origin B, switched; ' || {_HITS} WHEN origin = 'B' THEN 'origin B; ' || {_HITS}
  WHEN codes[1] = 'UA' THEN 'first code A; ' || array_to_string(codes, ',') || CASE WHEN list_contains(codes, 'RU') THEN '; dual listing with B' ELSE '' END
  WHEN codes[1] = 'RU' THEN 'first code B; ' || array_to_string(codes, ',')
  WHEN sig = 'b' OR (tb AND NOT ta) THEN 'URL or title B; ' || {_HITS}
  WHEN sig = 'a' THEN CASE WHEN ta THEN 'URL and title A; ' WHEN topic AND NOT tb THEN 'URL A, title names topic only; ' ELSE 'URL A, title neutral; ' END || {_HITS}
  WHEN ta AND NOT tb THEN 'title A; ' || {_HITS} WHEN topic THEN 'title names topic only; ' || {_HITS} WHEN prior = 'na' THEN 'not covered; ' || {_HITS}
  WHEN na >= 5 AND na > nb * 2 THEN 'body A; ' || {_HITS} WHEN nb >= 5 AND nb > na * 2 THEN 'body B; ' || {_HITS} ELSE 'no clear signal; ' || {_HITS} END"""


@query("cls_26_page_reason", f"WITH {PROBE} SELECT page_id, {_STATUS} AS status, {_REASON} AS reason FROM pb")
def _(t):
    return statuses(t).select("page_id", "status", "reason")


@query("join_15_compare_status", f"WITH {PROBE}, st AS (SELECT page_id, prior, {_STATUS} AS now FROM pb) SELECT *, prior = now OR (prior = 'ambiguous' AND now = 'url_correct_ui_ambiguous') AS agrees FROM st")
def _(t):
    d = statuses(t).select("page_id", "prior", F.col("status").alias("now"))
    return joins.compare_status(d, alias_of={"ambiguous": "url_correct_ui_ambiguous"})


_PCLS = """CASE WHEN contains(lower(url), '/de/') OR (contains(low, ' with ') AND NOT contains(low, ' was ')) THEN 'a' WHEN contains(lower(url), '/es/') OR (contains(low, ' was ') AND NOT contains(low, ' with ')) THEN 'b'
  WHEN contains(low, 'tionh') THEN 'disputed' WHEN contains(low, ' with ') AND contains(low, ' was ') THEN 'both_mentioned' ELSE 'unclear' END"""


def page_classes(t: Tables) -> DataFrame:
    c = pages.page_class(F.col("url"), F.col("html"), (" with ",), (" was ",), ("/de/",), ("/es/",), ("tionh",))
    return t.pages.select("page_id", "url", c.alias("cls"))


@query("cls_30_page_class", f"SELECT page_id, {_PCLS} AS cls FROM (SELECT *, lower(html) AS low FROM pages)")
def _(t):
    return page_classes(t).select("page_id", "cls")


@query("agg_25_consistency", f"""WITH c AS (SELECT {_PCLS} AS cls, regexp_extract(url, '://([^/?#]*)', 1) AS site, regexp_extract(url, '[a-z.-]/([a-z]+)/', 1) AS place FROM (SELECT *, lower(html) AS low FROM pages)),
g AS (SELECT site, count(DISTINCT place) AS places, count(DISTINCT cls) AS classes, bool_or(cls = 'unclear') AS uncl FROM c GROUP BY site)
SELECT site, places, classes, CASE WHEN places < 2 THEN 'insufficient' WHEN classes > 1 AND NOT uncl THEN 'varying' WHEN classes = 1 THEN 'consistent' ELSE 'unclear' END AS verdict FROM g""")
def _(t):
    d = page_classes(t).withColumns({"site": F.regexp_extract("url", "://([^/?#]*)", 1), "place": F.regexp_extract("url", "[a-z.-]/([a-z]+)/", 1)})
    return ag.consistency(d, "site", "place", "cls")


# ---- evidence in text -----------------------------------------------------

_DOI = "regexp_extract(text, '\\b10\\.[0-9]{4,}/[^\\s\\])}>\"]+')"
_CIT = " + ".join("len(regexp_extract_all(text, '" + p + "'))" for p in fixed.CITATION_PATTERNS)


@query("flt_03_academic_gate", with_records("papers", f""", x AS (SELECT paper_id, CASE WHEN paper_id % 3 = 0 THEN title WHEN paper_id % 3 = 1 THEN substr(text, 5, 4) ELSE text END AS text,
  CASE WHEN paper_id % 5 = 0 THEN 'https://arxiv.org/x' ELSE 'https://a.example/' END AS url FROM papers)
SELECT paper_id FROM x WHERE {_DOI} <> '' OR contains(url, 'arxiv.org') OR ({_CIT}) > 0"""))
def _(t):
    d = t.derived("papers").selectExpr("paper_id", "CASE WHEN paper_id % 3 = 0 THEN title WHEN paper_id % 3 = 1 THEN substr(text, 5, 4) ELSE text END AS text",
                                       "CASE WHEN paper_id % 5 = 0 THEN 'https://arxiv.org/x' ELSE 'https://a.example/' END AS url")
    return fl.academic_gate(d).select("paper_id")


@query("fn_06_doi", with_records("papers", f"""SELECT paper_id, nullif(rtrim({_DOI}, '.,;:'), '') AS found,
  CASE WHEN trim(doi) LIKE 'https://doi.org/%' THEN substr(trim(doi), 17) WHEN trim(doi) LIKE 'http://doi.org/%' THEN substr(trim(doi), 16) WHEN trim(doi) LIKE '10.%' THEN trim(doi) END AS bare,
  split_part(CASE WHEN trim(doi) LIKE 'https://doi.org/%' THEN substr(trim(doi), 17) WHEN trim(doi) LIKE 'http://doi.org/%' THEN substr(trim(doi), 16) WHEN trim(doi) LIKE '10.%' THEN trim(doi) END, '/', 1) AS prefix FROM papers"""))
def _(t):
    bare = values.bare_doi(F.col("doi"))
    return t.derived("papers").select("paper_id", values.find_doi(F.col("text")).alias("found"), bare.alias("bare"), values.doi_prefix(bare).alias("prefix"))


@query("fn_07_citations", with_records("papers", f"SELECT paper_id, ({_CIT})::INT AS n FROM papers"))
def _(t):
    return t.derived("papers").select("paper_id", values.citation_count(F.col("text")).alias("n"))
