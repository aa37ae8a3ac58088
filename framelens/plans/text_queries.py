"""Queries over documents: filters, scoring, labels, groups, censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions import scoring, values
from framelens.lexicon import DomainRule, GroupPattern, Lexicon, Override, Signal, TextRule
from framelens.operators import aggregates as ag
from framelens.operators import classify as cl
from framelens.operators import filters as fl
from framelens.operators import sets, windows
from framelens.operators.scale import compute_once
from framelens.plans.registry import Tables, query, with_records

# A lexicon for the given documents: licence and function words against secrets,
# contact data and junk. Lower-case, without look-around or Perl classes, so that
# both regex engines read it alike.
SIGNALS = (
    Signal("licensed under", "a", 2.0, "licence"),
    Signal("released under the mit license", "a", 2.0, "licence"),
    Signal("all rights", "a", 1.5, "licence"),
    Signal("gnu general|cc by", "a", 1.5, "licence"),
    Signal(" with ", "a", 1.0, "en"),
    Signal(" that ", "a", 0.5, "en"),
    Signal(" und ", "a", 1.0, "de"),
    Signal(" ist ", "a", 0.5, "de"),
    Signal(" pour ", "a", 1.0, "fr"),
    Signal(" los ", "a", 1.0, "es"),
    Signal("token = ", "b", 2.0, "secret"),
    Signal("[a-z0-9.]+@[a-z0-9.-]+", "b", 1.5, "contact"),
    Signal("[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", "b", 1.5, "contact"),
    Signal("%%%", "b", 1.0, "junk"),
    Signal(" was ", "b", 1.0, "en"),
    Signal(" sich ", "b", 1.0, "de"),
    Signal(" les ", "b", 1.0, "fr"),
    Signal(" del ", "b", 1.0, "es"),
    Signal("[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "b", 1.0, "address"),
    Signal("zzyzx", "b", 3.0, "never"),
)
TIERS = (
    DomainRule("src1.example", "government"),
    DomainRule("src2.example", "state_t1"),
    DomainRule("src3.example", "state_t2"),
    DomainRule("src4.example", "proxy"),
    DomainRule("src2.example", "shadowed"),
    DomainRule("src5.example", "adjacent"),
)
TIER_NAMES = ("government", "state_t1", "state_t2", "proxy", "adjacent", "independent")
LEX = Lexicon(
    SIGNALS,
    overrides=(Override(("gnu general public license", "apache license")),),
    attribution=('"', "[|]"),
    structured=("[0-9]{5,}", "[*]{3}"),
    news_domains=("src6.example", "src7.example"),
    tiers=TIERS,
)
TERMS = ("license", "token", " the ", " der ", " que ")
GROUPS = (
    GroupPattern("legal", "licensed under"),
    GroupPattern("legal", "license"),
    GroupPattern("junk", "%%%"),
    GroupPattern("junk", "[*]{3}"),
    GroupPattern("kin", " the "),
    GroupPattern("kin", " die "),
    GroupPattern("past", " was "),
    GroupPattern("digits", "[0-9]{4,}"),
)


def docs(t: Tables) -> DataFrame:
    return t.documents.withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")))


def classified(t: Tables, **kw) -> DataFrame:
    return cl.classify(docs(t), LEX, **kw)


# ---- oracle parts ---------------------------------------------------------


def _sum(signals, pole: str, count: bool) -> str:
    parts = []
    for s in signals:
        if s.pole == pole:
            hit = f"len(regexp_extract_all(low, '{s.pattern}'))" if count else f"CASE WHEN regexp_matches(low, '{s.pattern}') THEN 1 ELSE 0 END"
            parts.append(f"{hit} * {s.weight}::DOUBLE")
    return " + ".join(parts)


DOCS = """docs AS (SELECT doc_id, lang, source, n_chars, text, lower(text) AS low,
  'https://' || source || '.example.org/' || doc_id AS url FROM documents)"""
RAW = DOCS + f""",
pres AS (SELECT *, {_sum(SIGNALS, 'a', False)} AS pa, {_sum(SIGNALS, 'b', False)} AS pb FROM docs)"""
OCC = DOCS + f""",
occ AS (SELECT *, {_sum(SIGNALS, 'a', True)} AS oa, {_sum(SIGNALS, 'b', True)} AS ob FROM docs)"""
LABEL = "CASE WHEN {a} = 0 AND {b} = 0 THEN 'no_signal' WHEN {a} > {b} THEN 'a' WHEN {b} > {a} THEN 'b' ELSE 'disputed' END"
CLS = RAW + f""",
ov AS (SELECT *, CASE WHEN contains(low, 'gnu general public license') OR contains(low, 'apache license') THEN 1.5::DOUBLE ELSE 0 END AS sh FROM pres),
sc AS (SELECT *, pa + sh AS score_a, greatest(0, pb - sh) AS score_b FROM ov),
lab AS (SELECT *, {LABEL.format(a='score_a', b='score_b')} AS label,
  CASE source WHEN 'src1' THEN 'government' WHEN 'src2' THEN 'state_t1' WHEN 'src3' THEN 'state_t2' WHEN 'src4' THEN 'proxy'
    WHEN 'src5' THEN 'adjacent' ELSE 'independent' END AS source_type FROM sc),
mk AS (SELECT *, source IN ('src6', 'src7') AS news,
  contains(text, '"') OR contains(text, '|') AS attr, regexp_matches(low, '[0-9]{{5,}}|[*][*][*]') AS struct_ FROM lab),
cls AS (SELECT *, label = 'b' AND (news OR attr) AS is_quoted,
  CASE WHEN label <> 'b' THEN '' WHEN news THEN 'reportage_news' WHEN attr THEN 'reportage_attribution'
    WHEN struct_ THEN 'assertive_structured' ELSE 'assertive_pure' END AS framing_type FROM mk)"""


def _grp(g: str) -> str:
    return " + ".join(f"len(regexp_extract_all(low, '{p.pattern}'))" for p in GROUPS if p.group == g)


GRP = DOCS + f""",
gh AS (SELECT *, {_grp('legal')} AS legal, {_grp('junk')} AS junk, {_grp('kin')} AS kin, {_grp('past')} AS past, {_grp('digits')} AS digits FROM docs),
gl AS (SELECT *, list_filter([CASE WHEN digits > 0 THEN 'digits' END, CASE WHEN junk > 0 THEN 'junk' END, CASE WHEN kin > 0 THEN 'kin' END,
  CASE WHEN legal > 0 THEN 'legal' END, CASE WHEN past > 0 THEN 'past' END], lambda x: x IS NOT NULL) AS groups FROM gh),
gd AS (SELECT * FROM gl WHERE len(groups) > 0)"""


def W(parts: str, body: str) -> str:
    return f"WITH {parts}\n{body}"


# ---- filters --------------------------------------------------------------


@query("flt_01_topic_filter", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE "
       + " OR ".join(f"contains(lower(text), '{w}')" for w in TERMS) + " GROUP BY lang")
def _(t):
    return fl.topic_filter(t.documents, TERMS).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("flt_02_topic_gate", "SELECT doc_id, lang FROM documents WHERE regexp_matches(lower(text), 'licen[sc]e|token = | (les|los) ')")
def _(t):
    return fl.topic_gate(t.documents, "licen[sc]e|token = | (les|los) ").select("doc_id", "lang")


@query("flt_04_label_filter", W(CLS, "SELECT doc_id, label, score_a, score_b FROM cls WHERE label NOT IN ('no_signal', 'no_topic_ref')"))
def _(t):
    return fl.with_signal(classified(t)).select("doc_id", "label", "score_a", "score_b")


@query("flt_05_between_years", with_records("papers", "SELECT paper_id, year FROM papers WHERE year BETWEEN 2000 AND 2020"))
def _(t):
    return fl.between_years(t.derived("papers"), "year", 2000, 2020).select("paper_id", "year")


@query("flt_06_row_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'red') OR contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'economy')")
def _(t):
    return fl.row_contains(t.part, ("red", "economy"), ("p_name", "p_brand", "p_type")).select("p_partkey", "p_name")


_PART = "lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice))"


@query("flt_06_row_contains_all", f"SELECT p_partkey, p_name FROM part WHERE contains({_PART}, 'red') OR contains({_PART}, 'economy') OR contains({_PART}, '77')")
def _(t):
    return fl.row_contains(t.part, ("red", "economy", "77")).select("p_partkey", "p_name")


@query("flt_07_tier_filter", with_records(["papers", "journal_tiers"], """
SELECT p.paper_id, trim(p.journal) AS journal, coalesce(j.quartile, 'unknown') AS quartile
FROM papers p LEFT JOIN journal_tiers j ON trim(p.journal) = j.journal
WHERE coalesce(j.quartile, 'unknown') IN ('Q1', 'unknown') ORDER BY paper_id LIMIT 250"""))
def _(t):
    return fl.tier_filter(t.derived("papers"), t.derived("journal_tiers"), "journal", ("Q1", "unknown"), 250, ("paper_id",)).select(
        "paper_id", "journal", "quartile")


@query("flt_07_tier_filter_all", with_records(["papers", "journal_tiers"], """
SELECT p.paper_id, trim(p.journal) AS journal, coalesce(j.quartile, 'unknown') AS quartile
FROM papers p LEFT JOIN journal_tiers j ON trim(p.journal) = j.journal
WHERE coalesce(j.quartile, 'unknown') IN ('Q1', 'unknown')"""))
def _(t):
    return fl.tier_filter(t.derived("papers"), t.derived("journal_tiers"), "journal", ("Q1", "unknown")).select("paper_id", "journal", "quartile")


@query("flt_10_foreign_violators", with_records("articles", """, c AS (SELECT *, CASE source WHEN 'src1' THEN 'Home' WHEN 'src2' THEN '' ELSE 'Away' END AS country,
  CASE WHEN contains(lower(text), ' was ') AND NOT contains(lower(text), ' with ') THEN 'b' ELSE 'a' END AS label FROM articles)
SELECT 'strict' AS mode, doc_id FROM c WHERE label = 'b' AND country NOT IN ('Home', '')
UNION ALL SELECT 'open' AS mode, doc_id FROM c WHERE label = 'b' AND country <> 'Home'"""))
def _(t):
    d = t.derived("articles").withColumn("country", F.when(F.col("source") == "src1", "Home").when(F.col("source") == "src2", "").otherwise("Away"))
    low = F.lower("text")
    d = d.withColumn("label", F.when(F.contains(low, F.lit(" was ")) & ~F.contains(low, F.lit(" with ")), "b").otherwise("a"))
    strict = fl.foreign_violators(d, "b", "Home").select(F.lit("strict").alias("mode"), "doc_id")
    return strict.unionByName(fl.foreign_violators(d, "b", "Home", keep_unknown=True).select(F.lit("open").alias("mode"), "doc_id"))


@query("flt_11_place_filter", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name), '00007') OR contains(lower(n_name), 'nation_1')")
def _(t):
    d = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return fl.place_filter(d, ("00007", "Nation_1"), "s_name", "n_name").select("s_suppkey", "s_name", "n_name")


@query("flt_11_search_places", """WITH s AS (SELECT s_suppkey % 50 AS id, s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT 0 AS b, * FROM s WHERE s_suppkey % 2 = 0 UNION ALL SELECT 1, * FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b, s_suppkey) AS rn FROM r)
SELECT id, s_suppkey, s_name, n_name FROM f WHERE rn = 1 AND (contains(lower(s_name), '00007') OR contains(lower(n_name), 'nation_1'))""")
def _(t):
    d = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") % 50).alias("id"), "s_suppkey", "s_name", "n_name")
    return fl.search_places([d.where("s_suppkey % 2 = 0"), d], ("00007", "Nation_1"), "id", "s_name", "n_name", ["s_suppkey"])


# ---- scoring --------------------------------------------------------------


@query("cls_01_presence_score", W(RAW, "SELECT doc_id, pa AS score_a, pb AS score_b FROM pres"))
def _(t):
    return cl.with_scores(t.documents, LEX).select("doc_id", "score_a", "score_b")


@query("cls_02_occurrence_score", W(OCC, "SELECT doc_id, oa AS score_a, ob AS score_b FROM occ"))
def _(t):
    return cl.with_scores(t.documents, LEX, mode="occurrence").select("doc_id", "score_a", "score_b")


@query("cls_03_label_confidence", W(OCC, f"""SELECT doc_id, {LABEL.format(a='oa', b='ob')} AS label,
  round(CASE WHEN oa = 0 AND ob = 0 THEN 0 WHEN oa = ob THEN 0.5 ELSE least(0.95, greatest(oa, ob) / (oa + ob)) END, 6) AS confidence FROM occ"""))
def _(t):
    s = cl.with_scores(t.documents, LEX, mode="occurrence")
    a, b = F.col("score_a"), F.col("score_b")
    return s.select("doc_id", scoring.label(a, b, LEX).alias("label"), F.round(scoring.confidence(a, b), 6).alias("confidence"))


HIT_SIGNALS = (SIGNALS[0], SIGNALS[3], SIGNALS[10], SIGNALS[11], SIGNALS[12])


def _hits_sql(signals=HIT_SIGNALS, kept: str = " WHERE pos <= 5") -> str:
    """Positions counted from the text between matches, one branch per signal."""
    parts = []
    for i, s in enumerate(signals):
        parts.append(f"""SELECT doc_id, {i} AS s, text, regexp_extract_all(text, '(?i){s.pattern}') AS m, string_split_regex(text, '(?i){s.pattern}') AS p FROM documents""")
    return f"""WITH h AS ({' UNION ALL '.join(parts)}),
o AS (SELECT doc_id, s, text, m, p, unnest(range(1, len(m) + 1)) AS i FROM h WHERE len(m) > 0),
po AS (SELECT doc_id, s, i, m[i] AS matched, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS st, text FROM o),
r AS (SELECT doc_id, matched, trim(substr(text, greatest(st - 50, 0)::BIGINT + 1, (st + length(matched) + 50 - greatest(st - 50, 0))::BIGINT), E' \\n\\r\\t') AS context,
  row_number() OVER (PARTITION BY doc_id ORDER BY s, i) AS pos FROM po)
SELECT doc_id, pos, matched, context FROM r{kept}"""


def _hits(t: Tables, signals, k: int | None):
    d = t.documents.select("doc_id", scoring.signal_hits(F.col("text"), signals, k, 50).alias("h"))
    return d.select("doc_id", F.posexplode_outer("h").alias("p", "v")).where("v IS NOT NULL").select(
        "doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.col("v.matched").alias("matched"), F.col("v.context").alias("context"))


@query("cls_04_signal_hits", _hits_sql())
def _(t):
    return _hits(t, HIT_SIGNALS, 5)


@query("cls_04_signal_hits_all", _hits_sql(SIGNALS, ""))
def _(t):
    return _hits(t, SIGNALS, None)


@query("cls_05_override", W(CLS, "SELECT doc_id, score_a, score_b FROM cls"))
def _(t):
    return cl.apply_overrides(cl.with_scores(t.documents, LEX), LEX).select("doc_id", "score_a", "score_b")


@query("cls_06_attributed", "SELECT doc_id, contains(text, '\"') OR contains(text, '|') AS attributed FROM documents")
def _(t):
    return t.documents.select("doc_id", scoring.is_attributed(F.lower("text"), LEX).alias("attributed"))


@query("cls_07_structured", "SELECT doc_id, regexp_matches(lower(text), '[0-9]{5,}') OR contains(text, '***') AS structured FROM documents")
def _(t):
    return t.documents.select("doc_id", scoring.is_structured(F.lower("text"), LEX).alias("structured"))


@query("cls_08_framing_type", W(CLS, "SELECT doc_id, label, is_quoted, framing_type, source_type FROM cls"))
def _(t):
    return classified(t).select("doc_id", "label", "is_quoted", "framing_type", "source_type")


@query("cls_09_mention_window", """WITH p AS (SELECT doc_id, text, least(nullif(instr(lower(text), 'license'), 0), nullif(instr(lower(text), ' sich '), 0), nullif(instr(lower(text), 'token'), 0)) AS pos FROM documents)
SELECT doc_id, CASE WHEN pos IS NULL THEN substr(text, 1, 2000) ELSE substr(text, greatest(pos - 40, 1), pos + 40 - greatest(pos - 40, 1)) END AS snippet FROM p""")
def _(t):
    return t.documents.select("doc_id", scoring.mention_window(F.col("text"), F.lower("text"), ("license", " sich ", "token"), 40).alias("snippet"))


@query("cls_10_preview", r"SELECT doc_id, replace(replace(substr(text, 1, 300), chr(10), ' '), chr(13), '') AS preview FROM documents")
def _(t):
    return t.documents.select("doc_id", scoring.preview(F.col("text")).alias("preview"))


@query("cls_11_groups", W(GRP, "SELECT doc_id, array_to_string(groups, '|') AS groups, (legal + junk + kin + past + digits)::BIGINT AS n_hits FROM gd"))
def _(t):
    d = cl.detect_groups(t.documents, GROUPS)
    total = F.aggregate(F.map_values("hits"), F.lit(0), lambda a, x: a + x).cast("long")
    return d.select("doc_id", F.array_join("groups", "|").alias("groups"), total.alias("n_hits"))


TITLE_RULES = (
    TextRule("pro_b", ("southern coast",)),
    TextRule("pro_a", ("northern coast",)),
    TextRule("critical", ("occupied", "annexed"), also=("coast",)),
)
URL_GROUPS = (("pro_b", ("/south/coast",)), ("pro_a", ("/north/coast", "[.]de/.*coast")), ("critical", ("annex", "occupation")))


@query("cls_12_final_framing", with_records("articles", """
SELECT doc_id, coalesce(CASE WHEN contains(lower(title), 'southern coast') THEN 'pro_b' WHEN contains(lower(title), 'northern coast') THEN 'pro_a'
  WHEN (contains(lower(title), 'occupied') OR contains(lower(title), 'annexed')) AND contains(lower(title), 'coast') THEN 'critical' END,
  CASE WHEN regexp_matches(lower(url), '/south/coast') THEN 'pro_b' WHEN regexp_matches(lower(url), '/north/coast|[.]de/.*coast') THEN 'pro_a'
  WHEN regexp_matches(lower(url), 'annex|occupation') THEN 'critical' END, query_label) AS framing FROM articles"""))
def _(t):
    return t.derived("articles").select("doc_id", scoring.final_framing(F.col("title"), F.col("url"), F.col("query_label"), TITLE_RULES, URL_GROUPS).alias("framing"))


@query("cls_13_mention_label", """WITH x AS (SELECT doc_id, contains(low, ' with ') OR contains(low, ' und ') AS a, contains(low, ' was ') OR contains(low, ' sich ') AS b, contains(low, 'license') AS p
  FROM (SELECT doc_id, lower(text) AS low FROM documents))
SELECT doc_id, CASE WHEN a AND NOT b THEN 'a' WHEN b AND NOT a THEN 'b' WHEN a AND b THEN 'disputed' ELSE 'no_signal' END AS label,
  CASE WHEN p THEN 'a' WHEN a AND NOT b THEN 'a' WHEN b AND NOT a THEN 'b' WHEN a AND b THEN 'disputed' ELSE 'no_signal' END AS label_first FROM x""")
def _(t):
    low, a, b = F.lower("text"), (" with ", " und "), (" was ", " sich ")
    return t.documents.select("doc_id", scoring.mention_label(low, a, b).alias("label"),
                              scoring.mention_label(low, a, b, priority=("license",)).alias("label_first"))


MENTION = (TextRule("a", (" with ", " und ")), TextRule("b", (" was ", " sich ")))
OFFICIAL = (TextRule("b", ("license",), none_of=("apache",)), TextRule("a", ("apache license",)), TextRule("b", ("token = ",)))
BODY = (TextRule("a_in_text", (" the ",)), TextRule("b_in_text", (" que ", " der ")))


@query("cls_14_describe_label", """WITH x AS (SELECT doc_id, lower(source || ' ' || text) AS d, lower(source || ' ' || text || ' ' || lang) AS e FROM documents)
SELECT doc_id, coalesce(CASE WHEN contains(d, 'token = ') THEN 'b' WHEN contains(d, 'apache license') THEN 'a' WHEN contains(d, 'license') AND NOT contains(d, 'apache') THEN 'b' END,
  CASE WHEN contains(d, ' with ') OR contains(d, ' und ') THEN 'a' WHEN contains(d, ' was ') OR contains(d, ' sich ') THEN 'b' END,
  CASE WHEN contains(e, ' the ') THEN 'a_in_text' WHEN contains(e, ' que ') OR contains(e, ' der ') THEN 'b_in_text' END, 'no_signal') AS label FROM x""")
def _(t):
    return t.documents.select("doc_id", scoring.describe_label(F.concat_ws(" ", "source", "text"), F.col("lang"), MENTION, OFFICIAL, BODY).alias("label"))


@query("cls_15_entity_class", """SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'alpha' WHEN p_brand = 'Brand#3' THEN 'beta'
  WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') THEN 'alpha' WHEN contains(lower(p_name), 'bolt') THEN 'gamma' ELSE 'other/unknown' END AS cls FROM part""")
def _(t):
    rules = (TextRule("alpha", ("red", "blue")), TextRule("gamma", ("bolt",)))
    sets_ = (("alpha", ("Brand#1", "Brand#2")), ("beta", ("Brand#3",)))
    return t.part.select("p_partkey", scoring.entity_class(F.col("p_brand"), F.col("p_name"), sets_, rules, "other/unknown").alias("cls"))


@query("cls_16_code_class", with_records("findings", "SELECT event_id, CASE WHEN upper(coalesce(code, '')) = 'A' THEN 'A' WHEN upper(coalesce(code, '')) = 'B' THEN 'B' ELSE 'other' END AS cls FROM findings"))
def _(t):
    return t.derived("findings").select("event_id", scoring.code_class(F.lower("code")).alias("cls"))


VERDICT_RULES = (("ENDORSES", "endorses"), ("REPORTS", "reports"), ("ANALYZ", "analyzes"))


@query("cls_20_verdict", with_records("verdicts", """SELECT verdict, parsed, count(*) AS n FROM (SELECT response AS verdict, CASE WHEN contains(left(upper(response), 20), 'ENDORSES') THEN 'endorses'
  WHEN contains(left(upper(response), 20), 'REPORTS') THEN 'reports' WHEN contains(left(upper(response), 20), 'ANALYZ') THEN 'analyzes' ELSE 'unclear' END AS parsed FROM verdicts) GROUP BY 1, 2"""))
def _(t):
    d = t.derived("verdicts").select(F.col("response").alias("verdict"), scoring.parse_verdict(F.col("response"), VERDICT_RULES).alias("parsed"))
    return d.groupBy("verdict", "parsed").agg(F.count("*").alias("n"))


@query("cls_27_contradictions", """WITH x AS (SELECT p_partkey, (contains(lower(p_name), 'red')::INT + contains(lower(p_type), 'red')::INT) AS n_a,
  (CASE WHEN contains(lower(p_name), 'bolt') OR lower(p_name) = 'economy' THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_type), 'bolt') OR lower(p_type) = 'economy' THEN 1 ELSE 0 END) AS n_b FROM part)
SELECT p_partkey, n_a, n_b, least(n_a, n_b) AS contradictions FROM x""")
def _(t):
    f = ("p_name", "p_type")
    return cl.contradictions(t.part, f, f, ("red",), ("bolt",), b_exact=("economy",)).select("p_partkey", "n_a", "n_b", "contradictions")


@query("cls_28_listing_status", with_records("findings", """SELECT event_id, CASE codes WHEN 'UA' THEN 'correct' WHEN 'RU' THEN 'incorrect' ELSE 'ambiguous' END AS status,
  CASE codes WHEN 'RU,UA' THEN 'RU' WHEN 'UA,RU' THEN 'UA' END AS first_code FROM findings"""))
def _(t):
    c = F.col("codes")
    return t.derived("findings").select("event_id", scoring.listing_status(c, "UA", "RU").alias("status"), scoring.listed_first(c, "UA", "RU").alias("first_code"))


@query("cls_28_encoding_status", with_records("findings", """, g AS (SELECT platform, category, count(*) FILTER (codes = 'UA') AS n_a, count(*) FILTER (codes = 'RU') AS n_b, count(*) FILTER (codes = 'RU' AND status = 'blocked') AS extra FROM findings GROUP BY ALL)
SELECT *, CASE WHEN n_b > 0 AND n_a > 0 AND extra > 0 THEN 'incorrect' WHEN n_a > 0 AND n_b = 0 THEN 'correct' WHEN n_b > 0 AND n_a = 0 THEN 'incorrect' ELSE 'na' END AS encoding FROM g"""))
def _(t):
    only = lambda c: F.col("codes") == c
    g = t.derived("findings").groupBy("platform", "category").agg(
        F.count_if(only("UA")).alias("n_a"), F.count_if(only("RU")).alias("n_b"), F.count_if(only("RU") & (F.col("status") == "blocked")).alias("extra"))
    return g.select("*", scoring.encoding_status(F.col("n_a"), F.col("n_b"), F.col("extra")).alias("encoding"))


@query("cls_29_majority_status", with_records("findings", """, g AS (SELECT platform, count(*) FILTER (code = 'A') AS n_a, count(*) FILTER (code = 'B') AS n_b FROM findings GROUP BY platform)
SELECT platform, n_a, n_b, CASE WHEN n_a > n_b THEN 'correct' WHEN n_b > n_a THEN 'incorrect' ELSE 'ambiguous' END AS status,
  CASE WHEN n_b > n_a THEN 'incorrect' ELSE 'correct' END AS status_tie_ok FROM g"""))
def _(t):
    g = t.derived("findings").groupBy("platform").agg(F.count_if(F.col("code") == "A").alias("n_a"), F.count_if(F.col("code") == "B").alias("n_b"))
    a, b = F.col("n_a"), F.col("n_b")
    return g.select("*", scoring.majority_status(a, b).alias("status"), scoring.majority_status(a, b, "correct").alias("status_tie_ok"))


# ---- aggregates over classified documents ---------------------------------


@query("agg_01_label_counts", W(CLS, "SELECT source, lang, label, count(*) AS n FROM cls GROUP BY ALL"))
def _(t):
    return ag.label_counts(classified(t), ["source", "lang"])


@query("agg_05_census", W(CLS, "SELECT lang, count(*) AS total, count(*) FILTER (label = 'a') AS n_a, count(*) FILTER (label = 'b') AS n_b, "
       "count(*) FILTER (label = 'disputed') AS n_disputed, count(*) FILTER (label = 'no_signal') AS n_no_signal, "
       + ", ".join(f"count(*) FILTER (framing_type = '{x}') AS {x}" for x in ag.SUB_TYPES) + ", "
       + ", ".join(f"count(*) FILTER (label = 'b' AND source_type = '{x}') AS tier_{x}" for x in TIER_NAMES)
       + """, round(100.0::DOUBLE * count(*) FILTER (framing_type LIKE 'assertive%') / nullif(count(*) FILTER (label = 'b'), 0), 4) AS assertive_pct,
       round(100.0::DOUBLE * count(*) FILTER (framing_type LIKE 'reportage%') / nullif(count(*) FILTER (label = 'b'), 0), 4) AS reportage_pct FROM cls GROUP BY lang"""))
def _(t):
    return ag.census(classified(t), "a", "b", TIER_NAMES, ["lang"])


@query("agg_06_file_counters", W(CLS, "SELECT label, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM cls GROUP BY label"))
def _(t):
    return classified(t).groupBy("label").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("agg_08_group_breakdown", W(GRP, """, e AS (SELECT unnest(groups) AS grp, lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'unknown' END AS size FROM gd)
SELECT 'all' AS tally, grp, NULL::VARCHAR AS value, count(*) AS n FROM e GROUP BY grp
UNION ALL SELECT 'year', grp, size, count(*) FROM e GROUP BY grp, size
UNION ALL SELECT 'venue', grp, source, count(*) FROM e GROUP BY grp, source
UNION ALL SELECT 'stage1', grp, lang, count(*) FROM e GROUP BY grp, lang"""))
def _(t):
    d = cl.detect_groups(t.documents, GROUPS).withColumn("size", F.when(F.col("n_chars") > 2000, "long").otherwise(""))
    return ag.group_breakdown(d, "size", "source", "lang")


@query("agg_09_top_nested", W(CLS, """, tot AS (SELECT source, count(*) AS total FROM cls GROUP BY source ORDER BY total DESC, source LIMIT 5),
c AS (SELECT source, label, count(*) AS n FROM cls GROUP BY source, label)
SELECT source, total, string_agg(label || '=' || n, ',' ORDER BY label) AS counts FROM tot JOIN c USING (source) GROUP BY source, total"""))
def _(t):
    d = ag.top_nested(classified(t), "source", "label", 5)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return d.select("source", "total", text.alias("counts"))


@query("agg_09_nested_long", W(CLS, "SELECT source, label, count(*) AS n FROM cls GROUP BY source, label"))
def _(t):
    return ag.nested_counts(classified(t), "source", "label")


@query("agg_10_cooccurrence", W(GRP, "SELECT array_to_string(groups, '|') AS groups, count(*) AS n FROM gd GROUP BY 1 ORDER BY n DESC, groups LIMIT 20"))
def _(t):
    return ag.cooccurrence(cl.detect_groups(t.documents, GROUPS), 20)


@query("agg_26_rate_compare", W(GRP, """, z AS (SELECT lang, contains(low, '%%%') OR contains(low, '***') AS hit, len(groups) > 0 AS anyg, n_chars < 1000 AS cut FROM gl)
SELECT *, round(1e4 * hits_x / nullif(docs_x, 0), 2) AS per_10k_x, round(100.0::DOUBLE * hits_x / nullif(any_x, 0), 1) AS share_x, hits_x - before_x AS after_x,
  round(1e4 * hits_y / nullif(docs_y, 0), 2) AS per_10k_y, round(100.0::DOUBLE * hits_y / nullif(any_y, 0), 1) AS share_y, hits_y - before_y AS after_y,
  round(round(1e4 * hits_x / nullif(docs_x, 0), 2) / nullif(round(1e4 * hits_y / nullif(docs_y, 0), 2), 0), 1) AS ratio FROM (
SELECT count(*) FILTER (lang = 'en') AS docs_x, count(*) FILTER (lang = 'en' AND hit) AS hits_x, count(*) FILTER (lang = 'en' AND anyg) AS any_x, count(*) FILTER (lang = 'en' AND hit AND cut) AS before_x,
  count(*) FILTER (lang <> 'en') AS docs_y, count(*) FILTER (lang <> 'en' AND hit) AS hits_y, count(*) FILTER (lang <> 'en' AND anyg) AS any_y, count(*) FILTER (lang <> 'en' AND hit AND cut) AS before_y FROM z)"""))
def _(t):
    low = F.lower("text")
    hits = scoring.group_hits(low, GROUPS)
    d = t.documents.select("lang", "n_chars", hits.alias("h")).select(
        "lang", "n_chars", F.map_contains_key("h", F.lit("junk")).alias("hit"), (F.size("h") > 0).alias("anyg"))
    return ag.rate_split(d.where("lang IS NOT NULL"), F.col("lang") == "en", "hit", "anyg", F.col("n_chars") < 1000)


@query("agg_27_theme_summary", W(GRP, """, e AS (SELECT 'all' AS tally, 'all' AS value FROM gd UNION ALL SELECT 'source', source FROM gd UNION ALL SELECT 'year', lang FROM gd UNION ALL SELECT 'theme', unnest(groups) FROM gd)
SELECT tally, value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 1) AS share_pct FROM e GROUP BY 1, 2"""))
def _(t):
    d = compute_once(t.documents, {"groups": scoring.groups_present(F.lower("text"), GROUPS)})
    return ag.theme_summary(d, "source", "lang")


@query("agg_32_funnel", W(CLS, """, k AS (SELECT *, row_number() OVER (PARTITION BY md5(low) ORDER BY doc_id) = 1 AS uniq, regexp_matches(low, ' the | der | que ') AS gate FROM cls)
SELECT count(*) AS collected, count(*) FILTER (uniq) AS deduped, count(*) FILTER (uniq AND gate) AS gated, count(*) FILTER (uniq AND gate AND label <> 'no_signal') AS classified,
  count(*) FILTER (uniq AND gate AND label = 'b') AS pole_b FROM k"""))
def _(t):
    d = docs(t).withColumns({"_m": F.md5(F.lower("text")), "gate": F.regexp_like(F.lower("text"), F.lit(" the | der | que "))})
    c = cl.classify(d, LEX).select("doc_id", "_m", "gate", "label")
    return ag.funnel_of_firsts(c, "_m", ["doc_id"], [("gated", F.col("gate")), ("classified", F.col("label") != "no_signal"), ("pole_b", F.col("label") == "b")])


@query("win_01_dedup_first", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY md5(trim(lower(source || text))) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def _(t):
    return windows.dedup_first(t.documents, values.dedup_key(F.col("source"), F.col("text")), [F.col("doc_id")]).select("doc_id", "lang")


@query("set_01_union_sources", """SELECT source, count(*) AS n, count(title) AS titled, count(doi) AS with_doi FROM (
  SELECT 'docs' AS source, text AS title, NULL AS doi FROM documents UNION ALL SELECT 'parts', p_name, p_brand FROM part) GROUP BY source""")
def _(t):
    u = sets.union_sources({"docs": t.documents.select(F.col("text").alias("title")), "parts": t.part.select(F.col("p_name").alias("title"), F.col("p_brand").alias("doi"))})
    return u.groupBy("source").agg(F.count("*").alias("n"), F.count("title").alias("titled"), F.count("doi").alias("with_doi"))
