"""Queries over answers, papers, people, findings and registries, and the statistics on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions import answers as an
from framelens.functions import fixed, values
from framelens.functions.urls import extract_urls
from framelens.lexicon import TextRule
from framelens.operators import aggregates as ag
from framelens.operators import filters as fl
from framelens.operators import geo, graph, joins, sets, stats, windows
from framelens.operators.scale import compute_distinct, compute_once, number_few
from framelens.plans.registry import Tables, query, with_records

R = with_records
ENTITY = (TextRule("north", ("northland",)), TextRule("south", ("southland",)))
TIERS = ("D", "L", "I", "R")

# ---- answers --------------------------------------------------------------


def classed_answers(t: Tables, **kw) -> DataFrame:
    a = t.derived("answers")
    return compute_once(a, {"cls": an.classify_answer(F.col("raw_answer"), F.col("language"), F.col("question_type") == "geography", ENTITY, **kw)})


def answer_counts(t: Tables, **kw) -> DataFrame:
    """Answers by text and class: each distinct answer is classified once."""
    cls = an.classify_answer(F.col("raw_answer"), F.col("language"), F.col("question_type") == "geography", ENTITY, **kw)
    return compute_distinct(t.derived("answers"), ["language", "question_type", "raw_answer"], {"cls": cls})


_YES = "CASE language WHEN 'fr' THEN 'oui' WHEN 'de' THEN 'ja' WHEN 'es' THEN 's[íi]' ELSE 'yes' END"
_NO = "CASE language WHEN 'fr' THEN 'non' WHEN 'de' THEN 'nein' WHEN 'es' THEN 'no' ELSE 'no' END"


def _acls(head: int, miss: str) -> str:
    t = f"left(lower(trim(raw_answer)), {head})"
    return f"""CASE WHEN regexp_matches({t}, '^(' || {_YES} || ')') THEN 'yes' WHEN regexp_matches({t}, '^(' || {_NO} || ')') THEN 'no'
  WHEN contains({t}, 'complicated') THEN 'disputed' WHEN question_type = 'geography' THEN CASE WHEN contains({t}, 'northland') THEN 'north' WHEN contains({t}, 'southland') THEN 'south' ELSE {miss} END ELSE 'other' END"""


ACLS = f", ac AS (SELECT *, {_acls(100, chr(39) + 'other' + chr(39))} AS cls FROM answers)"


@query("cls_17_answer_class", R("answers", ACLS + " SELECT language, question_type, raw_answer, cls, count(*) AS n FROM ac GROUP BY ALL"))
def _(t):
    return answer_counts(t)


@query("cls_18_answer_class_raw", R("answers", f", ac AS (SELECT *, {_acls(50, 'left(trim(raw_answer), 30)')} AS cls FROM answers) SELECT language, question_type, raw_answer, cls, count(*) AS n FROM ac GROUP BY ALL"))
def _(t):
    return answer_counts(t, head=50, keep_raw=30)


_OPEN = """, k AS (SELECT *, lower(raw_answer) AS low FROM open_answers),
o AS (SELECT conv_id, turn, contains(low, 'unclear') OR contains(low, 'complex') OR contains(low, 'disputed') AS hedged,
  CASE question_id WHEN 'qa' THEN contains(low, ' with ') OR contains(low, ' und ') ELSE contains(low, ' pour ') END OR contains(low, 'the and') AS has_a,
  CASE question_id WHEN 'qa' THEN contains(low, ' was ') OR contains(low, ' sich ') ELSE contains(low, ' les ') END OR contains(low, 'of to') AS has_b FROM k),
ol AS (SELECT *, CASE WHEN has_a AND NOT has_b THEN 'a' WHEN has_b AND NOT has_a THEN 'b' WHEN has_a AND has_b THEN 'disputed' ELSE 'no_signal' END AS label FROM o)
"""


def open_classes(t: Tables) -> DataFrame:
    d = t.derived("open_answers")
    is_a = F.col("question_id") == "qa"

    def words(x, y):
        return F.when(is_a, F.array(*[F.lit(w) for w in x])).otherwise(F.array(*[F.lit(w) for w in y]))

    c = an.classify_open(F.col("raw_answer"), words((" with ", " und "), (" pour ",)), words((" was ", " sich "), (" les ",)), ("the and",), ("of to",))
    return compute_once(d, {"o": c}).select("conv_id", "turn", "o.*")


@query("cls_19_open_class", R("open_answers", _OPEN + "SELECT conv_id, turn, label, hedged, has_a, has_b FROM ol"))
def _(t):
    return open_classes(t).select("conv_id", "turn", "label", "hedged", "has_a", "has_b")


@query("cls_21_salvage_json", """SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 5 <> 4 AS found FROM events""")
def _(t):
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(
        F.col("event_id") % 5 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(
        F.col("event_id") % 5 == 4, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    d = t.events.select("event_id", an.salvage_json(text, "k long").alias("j"))
    return d.select("event_id", F.col("j.k").alias("k"), F.col("j").isNotNull().alias("found"))


@query("cls_22_strip_reasoning", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(text, E' \\n\\r\\t') WHEN turn % 3 = 1 THEN trim(role, E' \\n\\r\\t') ELSE trim('x ' || text, E' \\n\\r\\t') END AS answer FROM conversations""")
def _(t):
    c = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>a\nb</think>\n "), "text")).when(
        F.col("turn") % 3 == 1, F.concat(F.lit("<think>"), "text", F.lit("</think>  "))).otherwise(F.concat(F.lit("x <think>q</think> "), "text"))
    return t.conversations.select("conv_id", "turn", an.strip_reasoning(c, F.col("role")).alias("answer"))


# Probe of a response: the benchmark item its conversation is assigned to. Markers are the item's longer words,
# anti-markers its five-letter words, source phrases its first two words.
_PROBE = R("responses", """, p AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS mk, list_distinct(regexp_extract_all(lower(text), ' [a-z]{5} ')) AS an,
  [lower(regexp_extract(text, '^[^ ]+ [^ ]+'))] AS ph FROM benchmark),
r AS (SELECT response_id, lower(plain) AS low, list_distinct(regexp_extract_all(text, 'https?://[^\\s\\])>"'']+')) AS cited, conv_id % (SELECT count(*) FROM benchmark) AS item_id FROM responses)
SELECT response_id, len(list_filter(mk, lambda m: contains(low, m)))::BIGINT AS n_markers, len(list_filter(an, lambda m: contains(low, m)))::BIGINT AS n_anti, len(list_filter(ph, lambda m: contains(low, m)))::BIGINT AS n_phrases,
  len(list_filter(cited, lambda u: contains(u, 'state1.example.ru') OR contains(u, 'a3.example')))::BIGINT AS n_proxy, len(list_filter(mk, lambda m: contains(low, m))) > 0 AS is_hit FROM r JOIN p USING (item_id)""")


@query("cls_23_probe_hits", _PROBE)
def _(t):
    n = t.benchmark.agg(F.count("*").alias("n")).scalar()
    words = lambda p: F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)))
    phrase = F.array(F.lower(F.regexp_extract("text", "^[^ ]+ [^ ]+", 0)))
    probes = t.benchmark.select("item_id", words("[a-z]{6,}").alias("mk"), words(" [a-z]{5} ").alias("an"), phrase.alias("ph"))
    r = t.derived("responses").select("response_id", "plain", extract_urls(F.col("text")).alias("cited"), (F.col("conv_id") % n).alias("item_id"))
    rep = an.probe_report(F.col("plain"), F.col("cited"), F.col("mk"), F.col("an"), F.col("ph"), ("state1.example.ru", "a3.example"))
    d = compute_once(joins.lookup_join(r, probes, "item_id", "inner"), {"p": rep})
    size = lambda k: F.size(F.col(f"p.{k}")).cast("long")
    return d.select("response_id", size("markers").alias("n_markers"), size("anti_markers").alias("n_anti"), size("source_phrases").alias("n_phrases"),
                    size("proxy_cited").alias("n_proxy"), F.col("p.is_hit").alias("is_hit"))


_X = "CASE WHEN classified = 'other' THEN NULL WHEN classified = 'disputed' THEN 0.5::DOUBLE WHEN correct IS NOT NULL THEN correct::INT::DOUBLE ELSE (classified = expected)::INT::DOUBLE END"
SCORED = f", s AS (SELECT *, {_X} AS x FROM answers)"


def scored(t: Tables) -> DataFrame:
    return t.derived("answers").withColumn("x", an.score_forced(F.col("classified"), F.col("expected"), F.col("correct")))


@query("cls_24_score_answer", R(["answers", "open_answers"], SCORED + _OPEN + """SELECT 'forced' AS kind, x, count(*) AS n FROM s GROUP BY x
UNION ALL SELECT 'open', CASE label WHEN 'a' THEN 1.0::DOUBLE WHEN 'b' THEN 0 WHEN 'disputed' THEN 0.5 END AS x, count(*) FROM ol GROUP BY 2"""))
def _(t):
    o = open_classes(t).select(F.lit("open").alias("kind"), an.score_open(F.col("label"), F.col("has_a"), F.col("has_b")).alias("x"))
    return scored(t).select(F.lit("forced").alias("kind"), "x").unionByName(o).groupBy("kind", "x").agg(F.count("*").alias("n"))


@query("cls_31_is_correct", R("answers", ACLS + " SELECT model, count(*) FILTER (lower(cls) = lower(expected)) AS correct, count(*) AS total FROM ac GROUP BY model"))
def _(t):
    ok = an.is_correct(F.col("cls"), F.upper("expected"))
    return classed_answers(t).groupBy("model").agg(F.count_if(ok).alias("correct"), F.count("*").alias("total"))


def _tally(name: str, cols: tuple[str, ...], where: str = "true") -> str:
    pick = lambda c, k: f"{c} AS {k}" if k in cols else f"NULL::VARCHAR AS {k}"
    keys = {"q": "question_id", "c": "city", "l": "language"}
    group = ", ".join(keys[k] for k in cols) + (", question_id" if name == "cl" else "")
    return f"""SELECT '{name}' AS tally, {', '.join(pick(keys[k], k) for k in 'qcl')}, count(*) AS total, count(*) FILTER (correct) AS correct,
  count(*) FILTER (classified = 'yes') AS n_yes, count(*) FILTER (classified = 'no') AS n_no, count(*) FILTER (classified = 'disputed') AS n_disputed,
  count(*) FILTER (classified NOT IN ('yes', 'no', 'disputed')) AS n_other, round(100.0::DOUBLE * count(*) FILTER (correct) / count(*), 1) AS pct FROM answers WHERE {where} GROUP BY {group}"""


@query("agg_02_tallies", R("answers", " UNION ALL ".join([
    _tally("q", ("q",)), _tally("c", ("c",), "city <> ''"), _tally("l", ("l",)), _tally("qc", ("q", "c"), "city <> ''"), _tally("ql", ("q", "l")),
    _tally("cl", ("c", "l"), "question_id = 'q1' AND city <> ''")])))
def _(t):
    return ag.tallies(t.derived("answers"), "q1").select("tally", "q", "c", "l", "total", "correct", "n_yes", "n_no", "n_disputed", "n_other", "pct")


@query("agg_03_group_contrast", R("answers", """, g AS (SELECT *, CASE WHEN city IN ('c1', 'c2') THEN 'near' WHEN city = 'c3' THEN 'far' END AS grp FROM answers),
a AS (SELECT model, count(*) FILTER (grp = 'far' AND correct) AS correct_far, count(*) FILTER (grp = 'far') AS total_far, count(*) FILTER (grp = 'near' AND correct) AS correct_near, count(*) FILTER (grp = 'near') AS total_near FROM g GROUP BY model)
SELECT *, round(100.0::DOUBLE * correct_far / greatest(total_far, 1), 1) AS pct_far, round(100.0::DOUBLE * correct_near / greatest(total_near, 1), 1) AS pct_near,
  round(round(100.0::DOUBLE * correct_far / greatest(total_far, 1), 1) - round(100.0::DOUBLE * correct_near / greatest(total_near, 1), 1), 1) AS gap FROM a"""))
def _(t):
    # Entity groups as a small table derived from the cities that occur.
    a = t.derived("answers")
    g = a.select("city").distinct().select("city", F.when(F.col("city").isin("c1", "c2"), "near").when(F.col("city") == "c3", "far").alias("grp")).where("grp IS NOT NULL")
    return ag.group_contrast(a, g, ["model"], "far", "near")


@query("agg_04_matrix", R("answers", "SELECT city, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (language = '{x}' AND correct) / nullif(count(*) FILTER (language = '{x}'), 0), 1) AS pct_{x}" for x in ("en", "fr", "de", "es")) + " FROM answers WHERE city <> '' GROUP BY city"))
def _(t):
    return ag.accuracy_matrix(t.derived("answers").where("city <> ''"), "city", "language", ("en", "fr", "de", "es"))


@query("agg_04_matrix_long", R("answers", "SELECT city, language, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (correct) / count(*), 1) AS pct FROM answers WHERE city <> '' GROUP BY city, language"))
def _(t):
    return ag.accuracy_long(t.derived("answers").where("city <> ''"), "city", "language")


_MEANS = ", ".join(f"avg(x) FILTER (tier = '{k}') AS {k}" for k in TIERS)
CELLS = SCORED + f", ce AS (SELECT model, language, {_MEANS}, count(x) AS n_scored FROM s GROUP BY model, language)"
# One language lacks tier R in the cells, so that weights have to be renormalised.
GAPPY = CELLS + ", cg AS (SELECT model, language, D, L, I, CASE WHEN language <> 'es' THEN R END AS R FROM ce)"


def cells(t: Tables) -> DataFrame:
    return ag.tier_means(scored(t), ["model", "language"])


def gappy(t: Tables) -> DataFrame:
    return cells(t).withColumn("R", F.when(F.col("language") != "es", F.col("R")))


@query("agg_12_tier_means", R("answers", CELLS + " SELECT model, language, round(D, 6) AS D, round(L, 6) AS L, round(I, 6) AS I, round(R, 6) AS R, n_scored FROM ce UNION ALL SELECT model, '(all)', "
       + ", ".join(f"round(avg(x) FILTER (tier = '{k}'), 6)" for k in TIERS) + ", count(x) FROM s GROUP BY model"))
def _(t):
    pooled = ag.tier_means(scored(t), ["model"]).withColumn("language", F.lit("(all)"))
    both = cells(t).unionByName(pooled)
    return both.select("model", "language", *[F.round(k, 6).alias(k) for k in TIERS], "n_scored")


def _wsum(w: dict[str, float]) -> str:
    num = " + ".join(f"coalesce({k} * {v!r}::DOUBLE, 0)" for k, v in w.items())
    den = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {v!r}::DOUBLE END" for k, v in w.items())
    return f"round(({num}) / nullif({den}, 0), 4)"


_SCHEMES = ", ".join(f"{_wsum(w)} AS {s}" for s, w in fixed.WEIGHT_SCHEMES.items())
MODELS = GAPPY + f""", cw AS (SELECT model, {_SCHEMES} FROM cg), mw AS (SELECT model, {', '.join(f'round(avg({s}), 4) AS {s}' for s in fixed.WEIGHT_SCHEMES)}, count("primary") AS n_languages FROM cw GROUP BY model)""".replace("avg(primary)", 'avg("primary")').replace("AS primary", 'AS "primary"')


@query("agg_13_composite", R("answers", MODELS + " SELECT * FROM mw"))
def _(t):
    return ag.scheme_scores(gappy(t), "model")


ROBUST = """, rb AS (SELECT model, least(D, L, I, R) AS mn, CASE WHEN (CASE WHEN D > 1e-9 THEN 1 ELSE 0 END + CASE WHEN L > 1e-9 THEN 1 ELSE 0 END + CASE WHEN I > 1e-9 THEN 1 ELSE 0 END + CASE WHEN R > 1e-9 THEN 1 ELSE 0 END) >= 2 THEN
  (CASE WHEN D > 1e-9 THEN 1 ELSE 0 END + CASE WHEN L > 1e-9 THEN 1 ELSE 0 END + CASE WHEN I > 1e-9 THEN 1 ELSE 0 END + CASE WHEN R > 1e-9 THEN 1 ELSE 0 END) / (CASE WHEN D > 1e-9 THEN 1 / D ELSE 0 END + CASE WHEN L > 1e-9 THEN 1 / L ELSE 0 END + CASE WHEN I > 1e-9 THEN 1 / I ELSE 0 END + CASE WHEN R > 1e-9 THEN 1 / R ELSE 0 END) END AS hm FROM cg),
rm AS (SELECT model, round(avg(mn), 4) AS min, round(avg(hm), 4) AS harmonic_mean FROM rb GROUP BY model)"""


@query("agg_14_robust", R("answers", GAPPY + ROBUST + " SELECT * FROM rm"))
def _(t):
    return ag.robust_scores(gappy(t), "model")


@query("agg_15_gap", R("answers", SCORED + f", m AS (SELECT model, {_MEANS} FROM s GROUP BY model) SELECT model, round(round(D, 4) - round(R, 4), 4) AS gap FROM m"))
def _(t):
    return ag.elicitation_gap(ag.tier_means(scored(t), ["model"])).select("model", "gap")


# ---- papers ---------------------------------------------------------------

_PREFIX = "CASE split_part({d}, '/', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.PREFIX_PUBLISHERS.items()) + " END"
_BARE = "CASE WHEN trim(doi) LIKE 'https://doi.org/%' THEN substr(trim(doi), 17) WHEN trim(doi) LIKE 'http://doi.org/%' THEN substr(trim(doi), 16) WHEN trim(doi) LIKE '10.%' THEN trim(doi) END"
PUB = f", pu AS (SELECT *, {_BARE} AS bare FROM papers), pp AS (SELECT *, coalesce(nullif(publisher, ''), {_PREFIX.format(d='bare')}) AS pub FROM pu)"


def published(t: Tables) -> DataFrame:
    d = t.derived("papers").withColumn("bare", values.bare_doi(F.col("doi")))
    return joins.fallback_publisher(d, "publisher", "bare", "pub")


@query("join_10_fallback_publisher", R("papers", PUB + " SELECT paper_id, pub FROM pp"))
def _(t):
    return published(t).select("paper_id", "pub")


@query("agg_16_top_publishers", R("papers", PUB + " SELECT coalesce(pub, '(no publisher)') AS pub, count(*) AS n FROM pp GROUP BY 1 ORDER BY n DESC, pub LIMIT 30"))
def _(t):
    return ag.top_counts(published(t), "pub", 30, blank="(no publisher)")


@query("win_01_dedup_blank", R("papers", "SELECT paper_id FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY paper_id) AS rn FROM papers) WHERE rn = 1 OR doi = ''"))
def _(t):
    return windows.dedup_first(t.derived("papers"), ["doi"], [F.col("paper_id")], keep_blank=True).select("paper_id")


@query("join_03_merge_labels", R("articles", """, l AS (SELECT CASE WHEN lang = 'es' THEN url || '#es' ELSE url END AS url, arg_max(CASE WHEN lang = 'en' THEN 'a' WHEN lang = 'de' THEN 'no_signal' ELSE 'b' END, doc_id) AS label FROM articles GROUP BY 1)
SELECT doc_id, coalesce(label, 'no_signal') AS label FROM articles LEFT JOIN l USING (url)"""))
def _(t):
    a = t.derived("articles")
    # Labels of Spanish articles stand under another address, so nothing finds them.
    address = F.when(F.col("lang") == "es", F.concat("url", F.lit("#es"))).otherwise(F.col("url"))
    labels = a.select(address.alias("url"), F.when(F.col("lang") == "en", "a").when(F.col("lang") == "de", "no_signal").otherwise("b").alias("label"), F.col("doc_id").alias("pos"))
    return joins.merge_labels(a.select("doc_id", "url"), labels, ["pos"]).select("doc_id", "label")


@query("join_04_attach_last", """WITH b AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderpriority <> '') AS prio, arg_max(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, o_orderkey) FILTER (o_orderstatus <> 'P') AS st FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(prio, '') AS prio, coalesce(st, '') AS st FROM customer LEFT JOIN b ON c_custkey = o_custkey""")
def _(t):
    big = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("prio"),
                          F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("st"), "o_orderkey")
    return joins.attach_last(t.customer.select("c_custkey"), big, "c_custkey", ["prio", "st"], ["o_orderkey"], {"prio": "", "st": ""})


@query("join_05_attach_tier", R(["papers", "journal_tiers"], "SELECT paper_id, trim(p.journal) AS journal, coalesce(quartile, 'unknown') AS quartile FROM papers p LEFT JOIN journal_tiers j ON trim(p.journal) = j.journal"))
def _(t):
    return joins.attach_tier(t.derived("papers"), t.derived("journal_tiers")).select("paper_id", "journal", "quartile")


@query("join_06_best_source", """WITH k AS (SELECT p_partkey, 1 AS pos, p_brand AS brand FROM part UNION ALL SELECT p_partkey, 2, 'Brand#' || (p_size % 30) FROM part),
s AS (SELECT p_brand AS brand, max(p_size) AS metric, min(p_name) AS display FROM part GROUP BY p_brand),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY metric DESC, pos) AS rn FROM k JOIN s USING (brand))
SELECT p_partkey, display, metric FROM part LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (p_partkey)""")
def _(t):
    papers = t.part.select("p_partkey", F.array("p_brand", F.concat(F.lit("Brand#"), (F.col("p_size") % 30).cast("string"))).alias("keys"))
    src = t.part.groupBy(F.col("p_brand").alias("brand")).agg(F.max("p_size").alias("metric"), F.min("p_name").alias("display"))
    return joins.best_source(papers, src.withColumn("m", F.col("metric")), "p_partkey", "keys", "brand", "m", ["display", "metric"]).select("p_partkey", "display", "metric")


@query("join_07_flag_exists", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS verified FROM customer")
def _(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.flag_exists(t.customer, urgent, "c_custkey").select("c_custkey", "verified")


@query("join_08_pending", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey = o.o_custkey % 10)")
def _(t):
    work = t.orders.withColumn("supp", F.col("o_custkey") % 10)
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("supp"))
    return joins.pending(work, done, ["o_orderkey", "supp"]).select("o_orderkey", "o_custkey")


@query("join_09_worklist", f"""SELECT s_suppkey, n_name AS item, e AS entity, l AS lang FROM supplier, (SELECT n_name, unnest(CASE WHEN n_nationkey % 3 = 0 THEN ['x', 'y', 'z'] ELSE [''] END) AS e FROM nation), (VALUES ('en'), ('fr')) v(l)""")
def _(t):
    items = t.nation.select(F.col("n_name").alias("item"), (F.col("n_nationkey") % 3 == 0).alias("is_template"))
    return joins.worklist(t.supplier.select("s_suppkey"), items, ("x", "y", "z"), ("en", "fr")).select("s_suppkey", "item", "entity", "lang")


@query("join_09_worklist_size", "SELECT (SELECT count(*) FROM supplier) * sum(CASE WHEN n_nationkey % 3 = 0 THEN 6 ELSE 2 END)::BIGINT AS expected FROM nation")
def _(t):
    items = t.nation.select((F.col("n_nationkey") % 3 == 0).alias("is_template"))
    return joins.worklist_size(t.supplier, items, 3, 2)


@query("join_11_doi_overlap", R("papers", f"""SELECT CASE WHEN year > 2015 THEN 'late' ELSE 'early' END AS label, count(*) AS n FROM papers
WHERE lower(nullif(rtrim(regexp_extract(text, '\\b10\\.[0-9]{{4,}}/[^\\s\\])}}>"]+'), '.,;:'), '')) IN (SELECT DISTINCT lower('10.' || (1000 + p_size * 100) || CASE WHEN p_brand = 'Brand#1' THEN '/xy.' ELSE '/ab.' END || p_partkey) FROM part) GROUP BY 1"""))
def _(t):
    corpus = t.derived("papers").select("text", F.when(F.col("year") > 2015, "late").otherwise("early").alias("label"))
    suffix = F.when(F.col("p_brand") == "Brand#1", "/XY.").otherwise("/AB.")
    biblio = t.part.select(F.concat(F.lit("https://doi.org/10."), (1000 + F.col("p_size") * 100).cast("string"), suffix, F.col("p_partkey").cast("string")).alias("doi"))
    return joins.doi_overlap(corpus, biblio)


@query("join_12_coalesce_sources", """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1)
SELECT c_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'pending' WHEN b.v IS NOT NULL THEN 'low' ELSE 'unreachable' END AS origin FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def _(t):
    one = lambda c: t.orders.where(c).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return joins.coalesce_sources(t.customer.select("c_custkey"), [("pending", one("o_orderstatus = 'P'")), ("low", one("o_orderpriority = '5-LOW'"))], "c_custkey", "v")


# Polygons from the nations: a square, every other one with a square hole, some with a triangle as second part.
_POLY = """SELECT n_nationkey AS poly_id, CASE WHEN n_nationkey % 7 = 6 THEN 'Point' WHEN n_nationkey % 3 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS type,
  (n_nationkey % 5) * 0.2 - 0.5 AS x0, (n_nationkey / 5.0) * 0.2 - 0.5 AS y0, n_nationkey % 2 AS hole FROM {nation}"""


def polygon_rings(t: Tables) -> DataFrame:
    d = t.spark.sql(_POLY, nation=t.nation).withColumns({"x0": F.col("x0").cast("double"), "y0": F.col("y0").cast("double")})

    def ring(*pts):
        return F.array(*[F.array(F.col("x0") + F.lit(dx), F.col("y0") + F.lit(dy)) for dx, dy in pts])

    square, inner = ring((0.0, 0.0), (0.3, 0.0), (0.3, 0.3), (0.0, 0.3)), ring((0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.2))
    tri = ring((0.4, 0.0), (0.6, 0.0), (0.5, 0.35))
    first = F.when(F.col("hole") == 1, F.array(square, inner)).otherwise(F.array(square))
    return d.select("poly_id", "type", F.when(F.col("type") == "MultiPolygon", F.array(first, F.array(tri))).otherwise(F.array(first)).alias("polygons"))


@query("join_13_points_in_polygons", "WITH pl AS (" + _POLY.format(nation="nation").replace("AS x0", "::DOUBLE AS x0").replace("AS y0", "::DOUBLE AS y0").replace("- 0.5 ::DOUBLE", "- 0.5::DOUBLE") + """),
pt AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
pr AS (SELECT *, x - x0 AS dx, y - y0 AS dy FROM pt, pl WHERE type <> 'Point')
SELECT vec_id, poly_id FROM pr WHERE (dx >= 0 AND dx < 0.3 AND dy >= 0 AND dy < 0.3 AND NOT (hole = 1 AND dx >= 0.1 AND dx < 0.2 AND dy >= 0.1 AND dy < 0.2))
  OR (type = 'MultiPolygon' AND dy >= 0 AND dy < 0.35 AND dx > 0.4 + dy * (0.1 / 0.35) AND dx < 0.6 - dy * (0.1 / 0.35))""")
def _(t):
    pts = t.embeddings.select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    parts = geo.polygon_parts(polygon_rings(t), "poly_id")
    return geo.points_in_polygons(pts, parts, "vec_id", "poly_id")


@query("join_14_cross_validate", """WITH a AS (SELECT s_suppkey AS k, CASE WHEN s_nationkey % 2 = 0 THEN 'UA' ELSE 'RU' END AS code FROM supplier), b AS (SELECT c_custkey AS k, CASE WHEN c_nationkey % 2 = 0 THEN 'UA' ELSE 'RU' END AS code FROM customer)
SELECT a.k, a.code, b.code AS other, a.code = b.code AS agrees FROM a JOIN b USING (k)""")
def _(t):
    code = lambda c: F.when(F.col(c) % 2 == 0, "UA").otherwise("RU").alias("code")
    a = t.supplier.select(F.col("s_suppkey").alias("k"), code("s_nationkey"))
    b = t.customer.select(F.col("c_custkey").alias("k"), code("c_nationkey"))
    return joins.cross_validate(a, b, "k", "code").select("k", "code", "other", "agrees")


@query("join_16_token_match", "SELECT p_partkey, contains(lower(p_type || ' ' || p_brand), lower(split_part(split_part(p_name, ' ', 1), '-', 1))) OR contains(lower(p_name), lower(split_part(split_part(p_name, ' ', 1), '-', 1))) AS same FROM part")
def _(t):
    holder = F.concat_ws(" ", "p_type", "p_brand")
    return t.part.select("p_partkey", (values.token_match(F.col("p_name"), holder) | values.token_match(F.col("p_name"), F.col("p_name"))).alias("same"))


@query("join_17_watchlist", "SELECT count(*) AS n_rows, coalesce(sum(p_size), 0)::BIGINT AS total FROM part WHERE lower(p_brand) IN ('brand#1', 'brand#9', 'brand#77')")
def _(t):
    return joins.watchlist_sum(t.part, ("brand#1", "brand#9", "brand#77"), "p_brand", "p_size")


@query("join_18_closure", """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'r' || r_regionkey, 'world' FROM region UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
cl AS (SELECT 'world' AS root, 'world' AS node, 0 AS depth UNION SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT root, child, depth + 1 FROM cl JOIN e ON parent = node)
SELECT root, depth, count(DISTINCT node) AS n FROM cl WHERE depth > 0 GROUP BY root, depth""")
def _(t):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = reduce(DataFrame.union, [
        t.nation.select(s("n", "n_nationkey").alias("child"), s("r", "n_regionkey").alias("parent")),
        t.customer.select(s("c", "c_custkey"), s("n", "c_nationkey")),
        t.region.select(s("r", "r_regionkey"), F.lit("world")),
        t.orders.select(s("o", "o_orderkey"), s("c", "o_custkey")),
    ])
    roots = t.region.select(s("r", "r_regionkey").alias("root")).union(t.region.select(F.lit("world"))).distinct()
    return graph.closure(edges, roots).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query("agg_17_journal_report", R("verdicts", "SELECT journal, max(quartile) AS quartile, count(*) AS papers, count(*) FILTER (verdict = 'endorses') AS n_endorses, count(*) FILTER (verdict = 'reports') AS n_reports, count(*) FILTER (sacred) AS trope_sacred, count(*) FILTER (legal) AS trope_legal FROM (SELECT quartile || '-' || journal AS journal, quartile, verdict, sacred, legal FROM verdicts) GROUP BY journal"))
def _(t):
    d = t.derived("verdicts").withColumn("journal", F.concat_ws("-", "quartile", "journal"))
    return ag.journal_report(d, ("endorses", "reports"), ("sacred", "legal"))


def claims(t: Tables) -> DataFrame:
    return t.derived("claims").withColumnsRenamed({"c_start": "start", "c_end": "end", "c_rank": "rank"})


FACTS = """, f AS (SELECT person, max(death) AS death, coalesce(bool_or(country = 'A'), false) AS a, coalesce(bool_or(country = 'B'), false) AS b, coalesce(bool_or(country = 'S'), false) AS s, count(country) AS n,
  coalesce(bool_or(country = 'B' AND c_start >= DATE '1997-01-01'), false) AS bs, coalesce(bool_or(country = 'A' AND c_end >= DATE '1997-01-01'), false) AS ae FROM claims GROUP BY person)"""


@query("agg_18_cohorts", R("claims", FACTS + """, c AS (SELECT *, CASE WHEN death IS NULL THEN 'alive_or_unknown' WHEN death < DATE '1991-01-01' THEN 'died_before' WHEN death < DATE '1999-01-01' THEN 'died_between' ELSE 'died_after' END AS cohort,
  CASE WHEN a AND b THEN 'both' WHEN a THEN 'a_only' WHEN b THEN 'b_only' WHEN s THEN 'old_only' WHEN n = 0 THEN 'missing' ELSE 'other' END AS cls FROM f)
SELECT cohort, count(*) AS n, count(*) FILTER (cls = 'a_only') AS a_only, count(*) FILTER (cls = 'b_only') AS b_only, count(*) FILTER (cls = 'both') AS both, count(*) FILTER (cls = 'old_only') AS old_only,
  count(*) FILTER (cls = 'missing') AS missing, count(*) FILTER (cls = 'other') AS other, count(*) FILTER (bs) AS b_started, count(*) FILTER (ae) AS a_ended, count(*) FILTER (ae AND NOT bs) AS invisible_transition FROM c GROUP BY cohort"""))
def _(t):
    return ag.cohort_summary(ag.person_facts(claims(t), "A", "B", ("S",), "1997-01-01"), ("1991-01-01", "1999-01-01"))


FACTS_TWO = """, f AS (SELECT person, max(death) AS death, coalesce(bool_or(country = 'A'), false) AS a, coalesce(bool_or(country = 'B'), false) AS b, coalesce(bool_or(country = 'S'), false) AS s,
  coalesce(bool_or(country = 'E'), false) AS e, count(country) AS n FROM (SELECT * REPLACE (CASE WHEN claim_id % 10 = 2 THEN 'E' ELSE country END AS country) FROM claims) GROUP BY person)"""


@query("agg_18_cohorts_two_states", R("claims", FACTS_TWO + """, c AS (SELECT *, CASE WHEN death IS NULL THEN 'alive_or_unknown' WHEN death < DATE '1991-01-01' THEN 'died_before' WHEN death < DATE '1999-01-01' THEN 'died_between' ELSE 'died_after' END AS cohort,
  CASE WHEN a AND b THEN 'both' WHEN a THEN 'a_only' WHEN b THEN 'b_only' WHEN s THEN 'union_only' WHEN e THEN 'empire_only' WHEN n = 0 THEN 'missing' ELSE 'other' END AS cls FROM f)
SELECT cohort, count(*) AS n, count(*) FILTER (cls = 'union_only') AS union_only, count(*) FILTER (cls = 'empire_only') AS empire_only, count(*) FILTER (cls = 'missing') AS missing, count(*) FILTER (cls = 'other') AS other FROM c GROUP BY cohort"""))
def _(t):
    d = claims(t).withColumn("country", F.when(F.col("claim_id") % 10 == 2, "E").otherwise(F.col("country")))
    facts = ag.person_facts(d, "A", "B", {"union": ("S",), "empire": ("E",)}, "1997-01-01")
    return ag.cohort_summary(facts, ("1991-01-01", "1999-01-01"), ("union", "empire")).select("cohort", "n", "union_only", "empire_only", "missing", "other")


@query("agg_19_claim_coverage", R("claims", """, p AS (SELECT c_custkey, count(*) FILTER (country = 'A') AS a, count(*) FILTER (country = 'B') AS b, count(country) AS n FROM customer LEFT JOIN claims ON person = c_custkey GROUP BY 1)
SELECT sum(a)::BIGINT AS claims_a, sum(b)::BIGINT AS claims_b, sum(n - a - b)::BIGINT AS claims_other, count(*) FILTER (a > 0) AS entities_a, count(*) FILTER (b > 0) AS entities_b, count(*) FILTER (n = 0) AS entities_none FROM p"""))
def _(t):
    return ag.claim_coverage(t.customer.select(F.col("c_custkey").alias("person")), claims(t), "person", "A", "B")


@query("flt_08_current_claims", R("claims", """, live AS (SELECT * FROM claims WHERE c_rank <> 'deprecated' AND c_end IS NULL), pf AS (SELECT person, bool_or(c_rank = 'preferred') AS has FROM live GROUP BY person)
SELECT person, count(*) AS n FROM live JOIN pf USING (person) WHERE NOT has OR c_rank = 'preferred' GROUP BY person"""))
def _(t):
    return fl.current_claim_rows(claims(t), "person").groupBy("person").agg(F.count("*").alias("n"))


@query("fn_22_flatten_claims", R("claims", "SELECT claim_id, person, CASE country WHEN 'A' THEN 'Alpha' WHEN 'B' THEN 'Beta' ELSE country END AS country, c_rank, coalesce(c_start::VARCHAR, '') AS c_start, coalesce(c_end::VARCHAR, '') AS c_end FROM claims"))
def _(t):
    rec = claims(t).select("person", F.array(F.struct("claim_id", "country", "rank", "start", "end")).alias("claims"))
    x = rec.select("person", F.explode("claims").alias("c"))
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return x.select(F.col("c.claim_id").alias("claim_id"), "person", values.named_id(F.col("c.country"), {"A": "Alpha", "B": "Beta"}).alias("country"),
                    F.col("c.rank").alias("c_rank"), day("c.start").alias("c_start"), day("c.end").alias("c_end"))


@query("agg_20_findings", R("findings", """SELECT 'status' AS tally, NULL AS category, status, NULL AS method, count(*) AS n FROM findings GROUP BY status UNION ALL SELECT 'category_status', category, status, NULL, count(*) FROM findings GROUP BY category, status
UNION ALL SELECT 'method', NULL, NULL, method, count(*) FROM findings GROUP BY method UNION ALL SELECT 'total', NULL, NULL, NULL, count(*) FROM findings"""))
def _(t):
    return ag.finding_summary(t.derived("findings"))


@query("agg_21_consensus", R("findings", """, g AS (SELECT platform, count(*) FILTER (code = 'A') AS n_a, count(*) FILTER (code = 'B') AS n_b, count(*) AS total FROM findings WHERE category = 'error' GROUP BY platform)
SELECT *, CASE WHEN n_a = 0 AND n_b = 0 THEN 'no_data' WHEN n_a > n_b THEN 'A' WHEN n_b > n_a THEN 'B' ELSE 'tied' END AS consensus FROM g"""))
def _(t):
    return ag.consensus(t.derived("findings").where("category = 'error'"), "platform", "code", "A", "B")


@query("agg_21_consensus_all", R("findings", """, g AS (SELECT category, platform, count(*) FILTER (code = 'A') AS n_a, count(*) FILTER (code = 'B') AS n_b, count(*) AS total FROM findings GROUP BY category, platform)
SELECT *, CASE WHEN n_a = 0 AND n_b = 0 THEN 'no_data' WHEN n_a > n_b THEN 'A' WHEN n_b > n_a THEN 'B' ELSE 'tied' END AS consensus FROM g"""))
def _(t):
    return ag.consensus(t.derived("findings"), ["category", "platform"], "code", "A", "B")


FOLD = """, kv AS (SELECT asn, arg_max(value, line_no) FILTER (k = 'created') AS created, arg_max(value, line_no) FILTER (k = 'status') AS status, arg_min(value, line_no) FILTER (k = 'org') AS org,
  arg_max(value, line_no) FILTER (k = 'remarks') AS remarks FROM registry_kv GROUP BY asn)"""


def folded(t: Tables) -> DataFrame:
    return windows.fold_key_values(t.derived("registry_kv"), "asn", "k", "value", ["line_no"], {"created": "created", "status": "status", "remarks": "remarks"}, {"org": "org"})


@query("win_08_fold_kv", R("registry_kv", FOLD + " SELECT * FROM kv"))
def _(t):
    return folded(t)


@query("fn_17_abuse_tld", R("registry_kv", FOLD + " SELECT asn, nullif(regexp_extract(lower(remarks), 'abuse@[a-z0-9_.-]+[.]([a-z]{2,6})', 1), '') AS tld FROM kv"))
def _(t):
    return folded(t).select("asn", values.abuse_tld(F.col("remarks")).alias("tld"))


@query("agg_22_registry", R("registry_kv", FOLD + """, r AS (SELECT *, coalesce(nullif(regexp_extract(lower(remarks), 'abuse@[a-z0-9_.-]+[.]([a-z]{2,6})', 1), ''), NULL) AS tld, CASE asn % 4 WHEN 0 THEN 'UR' WHEN 1 THEN 'LO' WHEN 2 THEN 'XX' ELSE '' END AS country,
  contains(lower(status), lower(split_part(split_part(org, ' ', 1), '-', 1))) AS same FROM kv)
SELECT count(*) AS total, count(*) FILTER (country = 'UR') AS country_a, count(*) FILTER (country = 'LO') AS country_b, count(*) FILTER (country = 'XX') AS country_other, count(*) FILTER (created >= '1997-02-20') AS created_after,
  count(*) FILTER (tld = 'lo') AS abuse_b, count(*) FILTER (same = false) AS reassigned FROM r"""))
def _(t):
    code = F.when(F.col("asn") % 4 == 0, "UR").when(F.col("asn") % 4 == 1, "LO").when(F.col("asn") % 4 == 2, "XX").otherwise("")
    d = folded(t).withColumns({"country": code, "abuse_tld": values.abuse_tld(F.col("remarks")), "same_holder": values.token_match(F.col("org"), F.col("status"))})
    return ag.registry_summary(d, "UR", "LO", "1997-02-20")


@query("agg_23_trailing", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type <> 'error' GROUP BY event_type")
def _(t):
    return ag.trailing_counts(t.events, "event_type", "ts", 7, ("view", "click", "signup", "purchase"))


@query("agg_28_birthplace", """WITH r AS (SELECT trim(regexp_extract(CASE WHEN o_orderkey % 3 = 0 THEN 'nat. x; POB  ' || n_name || ', ' || o_orderpriority || '; DOB 1' WHEN o_orderkey % 3 = 1 THEN 'DOB 2' ELSE 'POB ' || o_orderpriority END, 'POB\\s+(.*?)(?:;|$)', 1)) AS pob
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT CASE WHEN contains(lower(pob), 'nation_1') THEN 'One' WHEN contains(lower(pob), 'nation') THEN 'Nation' WHEN contains(lower(pob), 'low') THEN 'Low' ELSE 'Other' END AS pob_label, count(*) AS n FROM r WHERE pob <> '' GROUP BY 1""")
def _(t):
    d = joins.lookup_join(t.orders, t.customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "inner").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("nat. x; POB  "), "n_name", F.lit(", "), "o_orderpriority", F.lit("; DOB 1"))).when(
        F.col("o_orderkey") % 3 == 1, F.lit("DOB 2")).otherwise(F.concat(F.lit("POB "), "o_orderpriority"))
    return ag.birthplace_labels(d.withColumn("remarks", text), "remarks", (("nation_1", "One"), ("nation", "Nation"), ("low", "Low")))


@query("agg_29_series", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, round(avg(n), 6) AS mean, max(n) AS peak, min(day) FILTER (n = mx) AS peak_at FROM (SELECT *, max(n) OVER (PARTITION BY event_type) AS mx FROM d) GROUP BY event_type""")
def _(t):
    d = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return ag.series_summary(d, "event_type", "day", "n").withColumn("mean", F.round("mean", 6))


@query("agg_30_verification", R("verdicts", """, v AS (SELECT quartile, count(*) FILTER (verdict = 'endorses') AS endorses, count(*) FILTER (verdict = 'reports') AS reports, count(*) FILTER (verdict = 'unclear') AS unclear, count(*) FILTER (verdict = 'fetch_failed') AS fetch_failed, count(*) FILTER (verdict = 'error') AS errors FROM verdicts GROUP BY quartile)
SELECT *, endorses + reports + unclear AS verified, round(100.0::DOUBLE * endorses / greatest(endorses + reports + unclear, 1), 1) AS precision_pct FROM v"""))
def _(t):
    return ag.verification_summary(t.derived("verdicts"), by=["quartile"])


@query("agg_31_distinct", R("papers", "SELECT DISTINCT trim(publisher) AS publisher FROM papers WHERE trim(publisher) <> ''"))
def _(t):
    return ag.distinct_values(t.derived("papers"), "publisher")


# ---- statistics -----------------------------------------------------------

@query("st_01_wilson", """WITH g AS (SELECT source, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source UNION ALL SELECT '(none)', 0, 0),
w AS (SELECT *, k::DOUBLE / nullif(n, 0) AS p, 1.96::DOUBLE AS z FROM g)
SELECT source, k, n, coalesce(round(p, 6), 0) AS p, CASE WHEN n = 0 THEN 0 ELSE round(greatest(0, ((p + z*z/(2*n)) - z*sqrt((p*(1-p) + z*z/(4*n))/n)) / (1 + z*z/n)), 6) END AS lo,
  CASE WHEN n = 0 THEN 0 ELSE round(least(1, ((p + z*z/(2*n)) + z*sqrt((p*(1-p) + z*z/(4*n))/n)) / (1 + z*z/n)), 6) END AS hi FROM w""")
def _(t):
    g = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    empty = t.labels.agg(F.lit("(none)").alias("source"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n"))
    w = g.unionByName(empty).withColumn("w", stats.wilson(F.col("k"), F.col("n")))
    return w.select("source", "k", "n", *[F.round(F.col(f"w.{x}"), 6).alias(x) for x in ("p", "lo", "hi")])


@query("st_02_rule_of_three", """WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, round(3.0::DOUBLE / n, 6) AS upper, CASE WHEN k > 0 THEN round(k / round(k::DOUBLE / n, 4))::BIGINT ELSE 0 END AS inferred FROM g""")
def _(t):
    g = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    return g.select("source", F.round(stats.rule_of_three(F.col("n")), 6).alias("upper"), stats.inferred_denominator(F.col("k"), F.round(F.col("k") / F.col("n"), 4)).alias("inferred"))


_KAP = """, kk AS (SELECT *, (a + b + c + d)::DOUBLE AS n, (a + d)::DOUBLE / nullif(a + b + c + d, 0) AS po, ((a + b) * (a + c) + (c + d) * (b + d))::DOUBLE / nullif((a + b + c + d) * (a + b + c + d), 0) AS pe FROM k0),
kv AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END AS kappa FROM kk)"""


@query("st_03_kappa", """WITH k0 AS (SELECT lang, count(*) FILTER (q AND t) AS a, count(*) FILTER (q AND NOT t) AS b, count(*) FILTER (NOT q AND t) AS c, count(*) FILTER (NOT q AND NOT t) AS d
  FROM (SELECT lang, quality = 1 AS q, n_chars > 1000 AS t FROM documents JOIN labels USING (doc_id)) GROUP BY lang)""" + _KAP + """
SELECT lang, a, b, c, d, round(kappa, 6) AS kappa, CASE WHEN n = 0 THEN 'undefined' WHEN pe = 1 THEN 'perfect' WHEN kappa >= 0.81 THEN 'almost perfect' WHEN kappa >= 0.61 THEN 'substantial' WHEN kappa >= 0.41 THEN 'moderate' WHEN kappa >= 0.21 THEN 'fair' ELSE 'slight' END AS band FROM kv""")
def _(t):
    d = t.documents.select("doc_id", "lang", (F.col("n_chars") > 1000).cast("int").alias("long")).join(t.labels, "doc_id")
    return stats.kappa(d, "quality", "long", ["lang"]).withColumn("kappa", F.round("kappa", 6))


@query("st_04_kappa_adjusted", R("verdicts", """, g AS (SELECT quartile, count(*) FILTER (verdict = 'endorses')::DOUBLE / greatest(count(*) FILTER (verdict IN ('endorses', 'reports', 'unclear')), 1) AS r FROM verdicts GROUP BY quartile),
k0 AS (SELECT quartile, round(r * 140) AS a, round((1 - r) * 140) AS b, 0.0::DOUBLE AS c, 860.0::DOUBLE AS d FROM g)""" + _KAP + " SELECT quartile, round(kappa, 6) AS kappa FROM kv"))
def _(t):
    v = ag.verification_summary(t.derived("verdicts"), by=["quartile"])
    rate = F.col("endorses") / F.greatest("verified", F.lit(1))
    return v.select("quartile", F.round(stats.kappa_adjusted(rate), 6).alias("kappa"))


@query("st_05_annotation", """WITH x AS (SELECT quality::VARCHAR AS a1, CASE WHEN n_chars % 11 = 0 THEN '?' WHEN n_chars % 7 = 0 THEN (1 - quality)::VARCHAR ELSE quality::VARCHAR END AS a2 FROM documents JOIN labels USING (doc_id)),
y AS (SELECT *, CASE WHEN a2 = '?' THEN '?' WHEN a1 = a2 THEN a1 ELSE 'disagree' END AS cons FROM x),
k0 AS (SELECT count(*) FILTER (a1 = '1' AND a2 = '1') AS a, count(*) FILTER (a1 = '1' AND a2 = '0') AS b, count(*) FILTER (a1 = '0' AND a2 = '1') AS c, count(*) FILTER (a1 = '0' AND a2 = '0') AS d,
  count(*) FILTER (cons = '1') AS hits, count(*) FILTER (cons IN ('0', '1')) AS agreed FROM y)""" + _KAP + """
SELECT a, b, c, d, hits, agreed, round(kappa, 6) AS kappa, round(hits::DOUBLE / agreed, 6) AS precision FROM kv""")
def _(t):
    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    q = F.col("quality").cast("string")
    a2 = F.when(F.col("n_chars") % 11 == 0, "?").when(F.col("n_chars") % 7 == 0, (1 - F.col("quality")).cast("string")).otherwise(q)
    d = d.select(q.alias("a1"), a2.alias("a2")).withColumn("cons", F.when(F.col("a2") == "?", "?").when(F.col("a1") == F.col("a2"), F.col("a1")).otherwise("disagree"))
    r = stats.annotation_report(d, "a1", "a2", "cons")
    return r.select("a", "b", "c", "d", "hits", "agreed", F.round("kappa", 6).alias("kappa"), F.round("precision", 6).alias("precision"))


@query("st_06_chi2", """WITH g AS (SELECT lang, count(*) FILTER (s AND o) AS a, count(*) FILTER (NOT s AND o) AS b, count(*) FILTER (s AND NOT o) AS c, count(*) FILTER (NOT s AND NOT o) AS d FROM (SELECT lang, n_chars < 900 AS s, quality = 1 AS o FROM documents JOIN labels USING (doc_id)) GROUP BY lang),
e AS (SELECT *, (a + b + c + d)::DOUBLE AS n FROM g),
x AS (SELECT *, pow(a - (a+b)*(a+c)/n, 2) / nullif((a+b)*(a+c)/n, 0) + pow(b - (a+b)*(b+d)/n, 2) / nullif((a+b)*(b+d)/n, 0) + pow(c - (c+d)*(a+c)/n, 2) / nullif((c+d)*(a+c)/n, 0) + pow(d - (c+d)*(b+d)/n, 2) / nullif((c+d)*(b+d)/n, 0) AS chi2 FROM e)
SELECT lang, a, b, c, d, round(chi2, 5) AS chi2, round(sqrt(chi2 / n), 5) AS cramers_v, CASE WHEN chi2 > 10.83 THEN '<0.001' WHEN chi2 > 3.84 THEN '<0.05' ELSE 'not significant' END AS p_band,
  CASE WHEN sqrt(chi2 / n) < 0.3 THEN 'small' WHEN sqrt(chi2 / n) < 0.5 THEN 'medium' ELSE 'large' END AS effect FROM x""")
def _(t):
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    r = stats.chi2_2x2(d, F.col("n_chars") < 900, F.col("quality") == 1, ["lang"])
    return r.withColumns({"chi2": F.round("chi2", 5), "cramers_v": F.round("cramers_v", 5)})


# Newton steps on one coefficient at a time over the folded table, far more of them than six places need.
_LOGIT = """WITH RECURSIVE f AS MATERIALIZED (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 0 END::DOUBLE AS x1, CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END::DOUBLE AS x2, toxic::DOUBLE AS x3,
  count(*)::DOUBLE AS m, sum(quality)::DOUBLE AS s FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND text IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2, 3),
it AS (SELECT 0 AS k, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2, 0::DOUBLE AS b3 UNION ALL
  SELECT k + 1, b0 + CASE WHEN k % 4 = 0 THEN sum(s - m * p) / sum(m * p * (1 - p)) ELSE 0 END, b1 + CASE WHEN k % 4 = 1 THEN sum(x1 * (s - m * p)) / sum(x1 * m * p * (1 - p)) ELSE 0 END,
    b2 + CASE WHEN k % 4 = 2 THEN sum(x2 * (s - m * p)) / sum(x2 * m * p * (1 - p)) ELSE 0 END, b3 + CASE WHEN k % 4 = 3 THEN sum(x3 * (s - m * p)) / sum(x3 * m * p * (1 - p)) ELSE 0 END
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3))) AS p FROM it, f WHERE k < 600) GROUP BY k, b0, b1, b2, b3),
c AS (SELECT unnest(['intercept', 'is_en', 'is_long', 'toxic']) AS term, unnest([b0, b1, b2, b3]) AS coef FROM it WHERE k = 600)
SELECT term, round(coef, 6) AS coef, round(exp(coef), 6) AS odds_ratio, (SELECT sum(m)::BIGINT FROM f) AS n, 'converged' AS status FROM c"""


@query("st_07_logit", _LOGIT)
def _(t):
    d = t.documents.select("doc_id", (F.col("lang") == "en").cast("int").alias("is_en"), (F.length("text") > 1000).cast("int").alias("is_long")).join(t.labels, "doc_id")
    return stats.logit_table(d, "quality", ["is_en", "is_long", "toxic"], tol=1e-9).withColumns({"coef": F.round("coef", 6), "odds_ratio": F.round("odds_ratio", 6)})


_RANKS = """, p AS (SELECT model, "primary" AS x, uniform AS y FROM mw), r AS (SELECT row_number() OVER (ORDER BY x, model) AS ra, row_number() OVER (ORDER BY y, model) AS rb FROM p)
SELECT count(*) AS n, sum((ra - rb) * (ra - rb))::DOUBLE AS d2, round(1 - 6 * sum((ra - rb) * (ra - rb))::DOUBLE / (count(*) * (count(*) * count(*) - 1)), 6) AS rho FROM r"""


@query("st_08_spearman", """WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS ra, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rb FROM orders)
SELECT count(*) AS n, sum((ra - rb)::DOUBLE * (ra - rb)) AS d2, round(1 - 6 * sum((ra - rb)::DOUBLE * (ra - rb)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS rho FROM r""")
def _(t):
    return stats.spearman(t.orders, "o_totalprice", "o_custkey", "o_orderkey").withColumn("rho", F.round("rho", 6))


def model_scores(t: Tables) -> DataFrame:
    g = gappy(t)
    return ag.scheme_scores(g, "model").join(ag.robust_scores(g, "model"), "model")


@query("st_08_spearman_models", R("answers", MODELS + _RANKS))
def _(t):
    return stats.spearman(ag.scheme_scores(gappy(t), "model"), "primary", "uniform", "model", few=True).withColumn("rho", F.round("rho", 6))


def _pc1_sql(data: str) -> str:
    """Covariances, then a power iteration as a recursive table."""
    cov = ", ".join(f"covar_samp({a}, {b}) AS c{i}{j}" for i, a in enumerate(TIERS) for j, b in enumerate(TIERS))
    step = lambda i: " + ".join(f"c{i}{j} * v{j}" for j in range(4))
    return f"""WITH RECURSIVE {data}, co AS (SELECT {cov} FROM full_rows),
it(k, v0, v1, v2, v3) AS (SELECT 0, 0.5::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE UNION ALL
  SELECT k + 1, w0 / nrm, w1 / nrm, w2 / nrm, w3 / nrm FROM (SELECT k, w0, w1, w2, w3, sqrt(w0*w0 + w1*w1 + w2*w2 + w3*w3) AS nrm FROM (SELECT k, {step(0)} AS w0, {step(1)} AS w1, {step(2)} AS w2, {step(3)} AS w3 FROM it, co)) WHERE k < 3000),
f AS (SELECT CASE WHEN v0 + v1 + v2 + v3 < 0 THEN -1 ELSE 1 END AS sg, * FROM it WHERE k = 3000),
g AS (SELECT greatest(sg * v0, 0) AS a, greatest(sg * v1, 0) AS b, greatest(sg * v2, 0) AS c, greatest(sg * v3, 0) AS d FROM f)
SELECT unnest(['D', 'L', 'I', 'R']) AS tier, unnest([round(a / (a+b+c+d), 4), round(b / (a+b+c+d), 4), round(c / (a+b+c+d), 4), round(d / (a+b+c+d), 4)]) AS weight FROM g"""


_FULL = R("answers", CELLS)[5:] + ", full_rows AS (SELECT D, L, I, R FROM ce WHERE D IS NOT NULL AND L IS NOT NULL AND I IS NOT NULL AND R IS NOT NULL)"


@query("st_09_pc1_weights", _pc1_sql(_FULL))
def _(t):
    w = stats.pc1_weights(cells(t), TIERS)
    return t.spark.createDataFrame(list(zip(TIERS, w)), "tier string, weight double")


def _rho(y: str) -> str:
    return f"""SELECT '{y}' AS metric, count(*) AS n, round(1 - 6 * sum((ra - rb) * (ra - rb))::DOUBLE / (count(*) * (count(*) * count(*) - 1)), 6) AS rho FROM
  (SELECT row_number() OVER (ORDER BY "primary", model) AS ra, row_number() OVER (ORDER BY "{y}", model) AS rb FROM ms WHERE "{y}" IS NOT NULL)"""


_OTHERS = [s for s in fixed.WEIGHT_SCHEMES if s != "primary"] + ["min", "harmonic_mean"]


@query("st_10_sensitivity", R("answers", MODELS + ROBUST + ", ms AS (SELECT * FROM mw JOIN rm USING (model)), z AS (" + " UNION ALL ".join(_rho(o) for o in _OTHERS)
       + ") SELECT metric, n, rho, CASE WHEN rho >= 0.9 THEN 'stable' WHEN rho >= 0.7 THEN 'moderate' ELSE 'sensitive' END AS stability FROM z"))
def _(t):
    return stats.sensitivity(model_scores(t), "primary", _OTHERS, "model", few=True).withColumn("rho", F.round("rho", 6))


@query("st_11_pre_post", R("papers", """, g AS (SELECT count(*) FILTER (year < 2015 AND o) AS pre_yes, count(*) FILTER (year < 2015 AND NOT o) AS pre_no, count(*) FILTER (year >= 2015 AND o) AS post_yes, count(*) FILTER (year >= 2015 AND NOT o) AS post_no FROM (SELECT year, brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS o FROM papers))
SELECT *, round(100.0::DOUBLE * pre_yes / greatest(pre_yes + pre_no, 1), 1) AS pre_pct, round(100.0::DOUBLE * post_yes / greatest(post_yes + post_no, 1), 1) AS post_pct, round((post_yes * pre_no)::DOUBLE / nullif(post_no * pre_yes, 0), 6) AS odds_ratio FROM g"""))
def _(t):
    r = stats.pre_post(t.derived("papers"), F.col("year") < 2015, F.col("brand").isin("Brand#1", "Brand#2", "Brand#3"))
    return r.withColumn("odds_ratio", F.round("odds_ratio", 6))


# ---- windows and sets -----------------------------------------------------


@query("win_02_wrong_samples", R("answers", "SELECT model, row_id FROM (SELECT model, row_id, row_number() OVER (PARTITION BY model ORDER BY row_id) AS rn FROM answers WHERE correct = false) WHERE rn <= 50"))
def _(t):
    return windows.sample_per_group(t.derived("answers"), ["model"], [F.col("row_id")], 50, F.col("correct") == F.lit(False)).select("model", "row_id")


@query("win_03_rank_order", R("verdicts", """, g AS (SELECT quartile, count(*) AS n FROM verdicts GROUP BY quartile) SELECT quartile, n, CASE quartile WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 9 END AS rk, row_number() OVER (ORDER BY CASE quartile WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 9 END, n DESC, quartile) AS position FROM g"""))
def _(t):
    g = t.derived("verdicts").groupBy("quartile").agg(F.count("*").alias("n")).withColumn("rk", windows.rank_of(F.col("quartile"), ("R", "A")))
    return number_few(g, [F.col("rk"), F.col("n").desc(), F.col("quartile")], "position").select("quartile", "n", "rk", "position")


@query("win_04_top_k", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 15")
def _(t):
    return windows.top_k(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), "n", 15, ["p_brand"])


@query("win_05_rank_models", R("answers", MODELS + ' SELECT model, "primary" AS score, row_number() OVER (ORDER BY "primary" DESC NULLS LAST, model) AS position FROM mw'))
def _(t):
    d = ag.scheme_scores(gappy(t), "model").select("model", F.col("primary").alias("score"))
    return windows.ranked(d, "score", "model", few=True)


@query("win_06_upsert_last", R("findings", "SELECT platform, category, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY platform, category ORDER BY event_id DESC) AS rn FROM findings) WHERE rn = 1"))
def _(t):
    return windows.upsert_last(t.derived("findings"), ["platform", "category"], ["event_id"]).select("platform", "category", "status", "event_id")


@query("win_07_every_nth", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE (rn - 1) % 3 = 0")
def _(t):
    return windows.every_nth(t.orders.select("o_orderkey", "o_totalprice"), 3, [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey")


@query("win_09_pick_nested", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'alias ' || c_name END AS display, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS place FROM customer""")
def _(t):
    flag = F.when(F.col("c_custkey") % 3 == 0, "display").otherwise("label")
    names = F.array(F.struct(F.concat(F.lit("alias "), "c_name").alias("value"), F.array(F.lit("alias")).alias("types")), F.struct(F.col("c_name").alias("value"), F.array(flag).alias("types")))
    locs = F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("old"), F.col("c_mktsegment")))
    return t.customer.select("c_custkey", windows.pick_name(names, "display").alias("display"), windows.last_element(locs).alias("place"))


@query("win_10_order_languages", R("answers", """, g AS (SELECT language, count(*) FILTER (correct) AS correct, count(*) AS total FROM answers GROUP BY language), p AS (SELECT *, round(100.0::DOUBLE * correct / total, 1) AS pct FROM g)
SELECT language, correct, total, pct, row_number() OVER (ORDER BY pct, language) AS position, CASE WHEN row_number() OVER (ORDER BY pct, language) <= 3 THEN 1 ELSE 2 END AS block FROM p"""))
def _(t):
    d = windows.order_languages(t.derived("answers"), "language", F.col("correct"), split=3)
    return d.withColumn("correct", F.col("correct").cast("long"))


@query("set_02_asymmetry", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT c_custkey AS k FROM customer),
u AS (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c)
SELECT CASE WHEN k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) THEN 'both' WHEN k IN (SELECT k FROM a) THEN 'a_only' WHEN k IN (SELECT k FROM b) THEN 'b_only' ELSE 'c_only' END AS region, count(*) AS n FROM u GROUP BY 1""")
def _(t):
    a = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    b = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return sets.set_asymmetry(a, b, t.customer.select(F.col("c_custkey").alias("k")), "k").groupBy("region").agg(F.count("*").alias("n"))


@query("set_03_union_dedup", """WITH u AS (SELECT o_custkey AS k, 0 AS branch, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT c_custkey, 2, c_custkey FROM customer)
SELECT k, branch, id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY branch, id) AS rn FROM u) WHERE rn = 1""")
def _(t):
    s = lambda c: t.orders.where(c).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("id"))
    return sets.union_dedup([s("o_orderstatus = 'P'"), s("o_orderpriority = '5-LOW'"), c], "k", ["id"]).select("k", "branch", "id")


@query("set_05_master", """WITH m AS (SELECT 'parts' AS name, true AS available, count(*) AS rows, sum(p_size)::BIGINT AS total FROM part UNION ALL SELECT 'pages', true, count(*), 0 FROM pages
  UNION ALL SELECT 'labels', true, count(*), sum(quality)::BIGINT FROM labels UNION ALL SELECT 'empty', true, 0, 0 UNION ALL SELECT 'absent', false, 0, 0)
SELECT name, available, rows, total, CASE WHEN available THEN 1 ELSE 0 END::BIGINT AS n_available FROM m
UNION ALL SELECT '(all)', bool_and(available), sum(rows)::BIGINT, sum(total)::BIGINT, count(*) FILTER (available) FROM m""")
def _(t):
    m = {"parts": t.part.select(F.col("p_size").cast("long").alias("findings")), "pages": t.pages.select("page_id"), "labels": t.labels.select(F.col("quality").cast("long").alias("findings")),
         "empty": t.part.select(F.col("p_size").alias("findings")).where("findings < 0"), "absent": None}
    return sets.master_summary(m)


@query("set_06_union_packages", """SELECT 'part' AS ecosystem, p_name AS package, p_size::BIGINT AS weekly, 0::BIGINT AS monthly FROM part UNION ALL SELECT 'supp', s_name, 0, s_nationkey::BIGINT FROM supplier""")
def _(t):
    a = t.part.select(F.lit("part").alias("ecosystem"), F.col("p_name").alias("package"), F.col("p_size").alias("weekly"))
    b = t.supplier.select(F.lit("supp").alias("ecosystem"), F.col("s_name").alias("package"), F.col("s_nationkey").alias("monthly"))
    return sets.union_with_defaults([a, b], ("ecosystem", "package", "weekly", "monthly"), ("weekly", "monthly"))


# ---- scalar functions -----------------------------------------------------


@query("fn_01_rebuild_text", "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS rebuilt FROM documents")
def _(t):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    index = t.documents.select("doc_id", values.word_positions(words).alias("idx"))
    got = index.select("doc_id", values.rebuild_text(F.col("idx")).alias("rebuilt"))
    return t.documents.select("doc_id").join(got, "doc_id", "left").withColumn("rebuilt", F.coalesce("rebuilt", F.lit("")))


@query("fn_08_dedup_key", "SELECT doc_id, md5(trim(lower(source || text))) AS k FROM documents")
def _(t):
    return t.documents.select("doc_id", values.dedup_key(F.col("source"), F.col("text")).alias("k"))


@query("fn_09_quarters", "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(values.quarter_label(F.col("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))


@query("fn_10_year_text", R("articles", "SELECT doc_id, coalesce(nullif(trim(left(date, 4)), ''), left(period, 4)) AS year FROM articles"))
def _(t):
    return t.derived("articles").select("doc_id", values.year_text(F.col("date"), F.col("period")).alias("year"))


@query("fn_11_percent", "SELECT c_mktsegment, round(100.0::DOUBLE * count(*) FILTER (c_acctbal > 5000) / greatest(count(*), 1), 1) AS pct FROM customer GROUP BY 1")
def _(t):
    g = t.customer.groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 5000).alias("k"), F.count("*").alias("n"))
    return g.select("c_mktsegment", values.percent(F.col("k"), F.col("n")).alias("pct"))


@query("fn_12_human_number", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size::BIGINT * 1000000 WHEN 1 THEN p_size::BIGINT * 1000 WHEN 2 THEN p_size::BIGINT WHEN 3 THEN p_size::BIGINT * 1000000000 END AS n FROM part""")
def _(t):
    s = F.col("p_size").cast("string")
    m = F.col("p_partkey") % 6
    text = F.when(m == 0, F.concat(s, F.lit("M"))).when(m == 1, F.concat(s, F.lit(".0k/week"))).when(m == 2, s).when(m == 3, F.concat(s, F.lit(" b"))).when(m == 4, F.lit("rate limited by 3")).otherwise(F.lit("n/a"))
    return t.part.select("p_partkey", values.human_number(text).alias("n"))


@query("fn_13_uri_tail", "SELECT page_id, string_split(url, '/')[-1] AS tail FROM pages")
def _(t):
    return t.pages.select("page_id", values.uri_tail(F.col("url")).alias("tail"))


@query("fn_14_fill_template", R("answers", "SELECT DISTINCT city, language, CASE language WHEN 'de' THEN 'Ist ' || CASE WHEN city = '' THEN '{city}' ELSE city END || ' hier?' ELSE 'Is ' || CASE WHEN city = '' THEN '{city}' ELSE city END || ' here?' END AS prompt FROM answers"))
def _(t):
    by = F.create_map(F.lit("de"), F.lit("Ist {city} hier?"), F.lit("en"), F.lit("Is {city} here?"))
    return t.derived("answers").select("city", "language").distinct().select(
        "city", "language", values.fill_template(by, F.col("language"), F.lit("Is {city} here?"), F.col("city")).alias("prompt"))


@query("fn_15_spaced_hosts", """WITH p AS (SELECT s_suppkey, (10 * 16777216 + (s_suppkey % 200) * 65536)::BIGINT AS net, CASE s_suppkey % 4 WHEN 0 THEN 254 WHEN 1 THEN 2 WHEN 2 THEN 65534 ELSE 6 END::BIGINT AS n FROM supplier),
i AS (SELECT s_suppkey, unnest(CASE WHEN n <= 5 THEN list_transform(range(0, n), lambda k: net + 1 + k) ELSE list_transform(range(1, 6), lambda k: net + 1 + least(greatest(n // 6, 1) * k, n - 1)) END) AS a FROM p)
SELECT s_suppkey, (a // 16777216) || '.' || (a // 65536 % 256) || '.' || (a // 256 % 256) || '.' || (a % 256) AS ip FROM i""")
def _(t):
    bits = F.element_at(F.array(F.lit("24"), F.lit("30"), F.lit("16"), F.lit("29")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    prefix = F.concat(F.lit("10."), (F.col("s_suppkey") % 200).cast("string"), F.lit(".0.0/"), bits)
    return t.supplier.select("s_suppkey", F.explode(values.spaced_hosts(prefix, 5)).alias("ip"))


@query("fn_16_edition_links", "SELECT c_custkey, 'n' || c_nationkey AS lang, c_name AS title FROM customer UNION ALL SELECT c_custkey, 'x' || c_custkey, c_name FROM customer")
def _(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"), F.lit("wiki"))
    links = F.create_map(key("n", "c_nationkey"), F.col("c_name"), F.lit("commonswiki"), F.lit("c"), key("x", "c_custkey"), F.col("c_name"), F.lit("frwikiquote"), F.lit("q"))
    return t.customer.select("c_custkey", F.explode(values.edition_links(links)).alias("lang", "title"))


@query("fn_18_to_json", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS j FROM events")
def _(t):
    return t.events.select("event_id", F.to_json(F.from_json("props", "k long")).alias("j"))


@query("fn_19_unpivot", "SELECT p_partkey, field, value FROM part UNPIVOT (value FOR field IN (p_name, p_brand, p_type))")
def _(t):
    return t.part.unpivot("p_partkey", ["p_name", "p_brand", "p_type"], "field", "value")


@query("fn_20_accuracy_band", R("answers", ", g AS (SELECT model, language, city, round(100.0::DOUBLE * count(*) FILTER (correct) / count(*), 1) AS pct FROM answers GROUP BY ALL) SELECT model, language, city, CASE WHEN pct >= 90 THEN 4 WHEN pct >= 75 THEN 3 WHEN pct >= 50 THEN 2 WHEN pct >= 25 THEN 1 ELSE 0 END AS band FROM g"))
def _(t):
    g = t.derived("answers").groupBy("model", "language", "city").agg(F.count_if("correct").alias("k"), F.count("*").alias("n"))
    return g.select("model", "language", "city", values.accuracy_band(values.percent(F.col("k"), F.col("n"))).alias("band"))


@query("fn_21_series_rows", "SELECT vec_id, 1950 + i - 1 AS year, round(embedding[i]::DOUBLE, 6) AS frequency FROM embeddings, range(1, 4097) r(i) WHERE i <= len(embedding)")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "v")).select(
        "vec_id", (F.col("p") + 1950).cast("long").alias("year"), F.round(F.col("v").cast("double"), 6).alias("frequency"))


@query("fn_23_weekly", "SELECT p_partkey, p_size // 13 AS weekly FROM part")
def _(t):
    return t.part.select("p_partkey", values.weekly(F.col("p_size")).cast("int").alias("weekly"))


@query("flt_09_normalize_works", """SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'W' || p_partkey ELSE '10.5/' || p_partkey END AS url, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '10.5/' || p_partkey END AS doi, p_size AS year, p_brand AS journal, p_name AS abstract, 'index' AS source_api FROM part
UNION ALL SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN 'http://u/' || p_partkey ELSE 'https://doi.org/10.5/' || p_partkey END, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '10.5/' || p_partkey END, p_size, p_brand, p_type, 'registry' FROM part""")
def _(t):
    k = F.col("p_partkey").cast("string")
    doi = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("10.5/"), k))
    words = F.split("p_name", " ")
    a = t.part.select("p_partkey", F.col("p_name").alias("title"), doi.alias("doi"), F.concat(F.lit("W"), k).alias("id"), F.col("p_size").alias("publication_year"),
                      F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("source")).alias("primary_location"),
                      F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda x: x.isNotNull())))).alias("abstract_inverted_index"))
    b = t.part.select("p_partkey", F.array("p_name").alias("title"), doi.alias("DOI"), F.concat(F.lit("http://u/"), k).alias("URL"), F.struct(F.array(F.array("p_size")).alias("date-parts")).alias("published"),
                      F.array("p_brand").alias("container-title"), F.col("p_type").alias("abstract"))
    # The identifier travels with the record so that the two shapes can be compared row by row.
    na = a.select("p_partkey", *[c for c in fl.works_a_columns()])
    nb = b.select("p_partkey", *[c for c in fl.works_b_columns()])
    return na.unionByName(nb)
