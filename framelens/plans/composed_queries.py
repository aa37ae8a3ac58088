"""The composed analyses of ``census`` on whole tables, and the gated label, the byte preview and long lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import fixed, scoring
from framelens.lexicon import DomainRule, Lexicon, Signal
from framelens.operators import classify as cl
from framelens.operators import graph
from framelens.plans import census
from framelens.plans import record_queries as rec
from framelens.plans.registry import query, with_records
from framelens.plans.text_queries import CLS, DOCS, LEX, OCC, SIGNALS, W, _sum, docs
from framelens.plans.web_queries import _CIT, _DOI, DIR, DIRTYPE, directory

_CATEGORY = f"""coalesce(CASE WHEN source = 'src2' THEN 'sanctioned_media' END, CASE WHEN contains(source || '.', 'src4.') THEN 'blog' WHEN source = 'src5' THEN 'portal' END,
  {DIRTYPE.format(t='d.type')}, 'uncategorized')"""


@query("census_site_categories", with_records("directory", DIR + ", " + CLS + f"""
SELECT url, 'international' AS origin, {_CATEGORY} AS site_type, CASE WHEN source = 'src2' THEN 'Agency [Reg 1]' ELSE '' END AS sanction
FROM cls LEFT JOIN dir d ON d.domain = 'example.org' WHERE label = 'b'"""))
def _(t):
    d = cl.classify(docs(t), LEX)
    return census.site_categories(d, directory(t).select("domain", "type"), LEX, (DomainRule("src2.example", "Agency", "Reg 1"),),
                                  (("blog", "host_has", "src4."), ("portal", "host_is", "src5.example.org")))


@query("census_evidence", with_records("papers", f""", x AS (SELECT paper_id, CASE WHEN paper_id % 3 = 0 THEN title WHEN paper_id % 3 = 1 THEN substr(text, 5, 4) ELSE text END AS text,
  CASE WHEN paper_id % 5 = 0 THEN 'https://arxiv.org/' ELSE 'https://a.example/' END || paper_id AS url FROM papers)
SELECT url, nullif(rtrim({_DOI}, '.,;:'), '') AS doi, CASE WHEN contains(url, 'arxiv.org') THEN 'arxiv.org' END AS academic_domain, ({_CIT})::INT AS citation_count, text AS text_preview
FROM x WHERE {_DOI} <> '' OR contains(url, 'arxiv.org') OR ({_CIT}) > 0"""))
def _(t):
    d = t.derived("papers").selectExpr("CASE WHEN paper_id % 3 = 0 THEN title WHEN paper_id % 3 = 1 THEN substr(text, 5, 4) ELSE text END AS text",
                                       "concat(CASE WHEN paper_id % 5 = 0 THEN 'https://arxiv.org/' ELSE 'https://a.example/' END, paper_id) AS url")
    return census.evidence(d)


_LAB = """CASE WHEN a = 0 AND b = 0 THEN 'no_signal' WHEN a > b THEN 'a' WHEN b > a THEN 'b' ELSE 'disputed' END"""
_SHIFT = "CASE WHEN contains(low, 'gnu general public license') OR contains(low, 'apache license') THEN 1.5::DOUBLE ELSE 0 END"


@query("census_article_framing", with_records(["articles", "papers"], f""", u AS (SELECT 0 AS o, doc_id AS pos, title, url, text FROM articles UNION ALL SELECT 1, paper_id, title, doi, text FROM papers),
f AS (SELECT *, lower(coalesce(text, '')) AS low FROM (SELECT *, row_number() OVER (PARTITION BY md5(trim(lower(coalesce(title, '') || coalesce(url, '')))) ORDER BY o, pos) AS rn FROM u) WHERE rn = 1),
g AS (SELECT * FROM f WHERE regexp_matches(low, 'tion| the |vol')),
s AS (SELECT *, {_sum(SIGNALS, 'a', True)} AS oa, {_sum(SIGNALS, 'b', True)} AS ob, {_SHIFT} AS sh FROM g), z AS (SELECT *, oa + sh AS a, greatest(0, ob - sh) AS b FROM s)
SELECT CASE o WHEN 0 THEN 'articles' ELSE 'papers' END AS source, pos, a AS score_a, b AS score_b, {_LAB} AS label FROM z"""))
def _(t):
    web = t.derived("articles").select(F.lit(0).alias("o"), F.col("doc_id").alias("pos"), "title", "url", "text")
    papers = t.derived("papers").select(F.lit(1).alias("o"), F.col("paper_id").alias("pos"), "title", F.col("doi").alias("url"), "text")
    got = census.article_framing({"articles": web, "papers": papers}, LEX, "tion| the |vol", ["o", "pos"])
    return got.select("source", "pos", "score_a", "score_b", "label")


_TIER_OF = {"q1": "D", "q2": "L", "q3": "I", "q4": "R", "q5": "D", "q6": "L"}
_TIER_SQL = "CASE question_id " + " ".join(f"WHEN '{q}' THEN '{k}'" for q, k in _TIER_OF.items()) + " END"
_X = "CASE WHEN cls = 'other' THEN NULL WHEN cls = 'disputed' THEN 0.5::DOUBLE ELSE (lower(cls) = lower(expected))::INT::DOUBLE END"
_SCORES = rec.ACLS + f""", o AS (SELECT role AS model, 'en' AS language, contains(text, ' the ') AS ha, contains(text, ' was ') AS hb FROM conversations),
s AS (SELECT model, language, {_TIER_SQL} AS tier, {_X} AS x FROM ac WHERE {_TIER_SQL} IS NOT NULL
  UNION ALL SELECT model, language, 'R', CASE WHEN ha AND hb THEN 0.5::DOUBLE WHEN ha THEN 1 WHEN hb THEN 0 END FROM o),
cg AS (SELECT model, language, {rec._MEANS} FROM s GROUP BY model, language)
""" + rec.MODELS[rec.MODELS.index(", cw AS"):] + rec.ROBUST + " SELECT * FROM mw LEFT JOIN rm USING (model)"


@query("census_answer_scores", with_records("answers", _SCORES))
def _(t):
    has_a, has_b = F.contains("text", F.lit(" the ")), F.contains("text", F.lit(" was "))
    label = F.when(has_a & has_b, "disputed").when(has_a, "a").when(has_b, "b").otherwise("no_signal")
    free = t.conversations.select(F.col("role").alias("model"), F.lit("en").alias("language"), label.alias("label"), has_a.alias("has_a"), has_b.alias("has_b"))
    return census.answer_scores(t.derived("answers"), free, _TIER_OF, F.col("question_type") == "geography", rec.ENTITY, fixed.WEIGHT_SCHEMES)


@query("cls_05_gated_label", W(OCC, f""", g AS (SELECT doc_id, contains(low, 'license') OR contains(low, 'tion') AS gate, oa, ob FROM occ),
z AS (SELECT doc_id, gate, CASE WHEN gate THEN oa ELSE 0 END AS a, CASE WHEN gate THEN ob ELSE 0 END AS b FROM g)
SELECT doc_id, a AS score_a, b AS score_b, CASE WHEN NOT gate THEN 'no_topic_ref' ELSE {_LAB} END AS label FROM z"""))
def _(t):
    return cl.gated_label(t.documents, LEX, cl.topic_condition(F.col("text"), ("license", "tion"))).select("doc_id", "score_a", "score_b", "label")


@query("cls_20_preview_bytes", """SELECT doc_id, translate(left(text, list_max(list_filter(range(0, least(length(text), 300) + 1), lambda k: strlen(left(text, k)) <= 300))), chr(10) || chr(13), '  ') AS preview FROM documents""")
def _(t):
    return t.documents.select("doc_id", scoring.preview(F.col("text"), 300, "byte").alias("preview"))


# Two hundred plain signals: numbers, syllables and their pairs, so that many of them occur.
_SYLLABLES = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of")
LONG = tuple(Signal(w, "ab"[i % 2], (1.0, 0.5, 2.0)[i % 3]) for i, w in enumerate([a + b for a in _SYLLABLES for b in _SYLLABLES][:200]))


def _long_sum(pole: str, count: bool) -> str:
    of = [s for s in LONG if s.pole == pole]
    words, weights = ", ".join(f"'{s.pattern}'" for s in of), ", ".join(f"{s.weight}::DOUBLE" for s in of)
    hit = "len(string_split(low, w)) - 1" if count else "CASE WHEN contains(low, w) THEN 1 ELSE 0 END"
    return f"list_sum(list_transform(list_zip([{words}], [{weights}]), lambda p: list_transform([p[1]], lambda w: ({hit})::DOUBLE)[1] * p[2]))"


@query("cls_01_long_lexicon", W(DOCS, f"SELECT doc_id, {_long_sum('a', False)} AS score_a, {_long_sum('b', False)} AS score_b FROM docs"))
def _(t):
    return cl.with_scores(t.documents, Lexicon(LONG)).select("doc_id", "score_a", "score_b")


@query("cls_02_long_lexicon", W(DOCS, f"SELECT doc_id, {_long_sum('a', True)} AS score_a, {_long_sum('b', True)} AS score_b FROM docs"))
def _(t):
    return cl.with_scores(t.documents, Lexicon(LONG), mode="occurrence").select("doc_id", "score_a", "score_b")


@query("join_18_long_chains", """WITH RECURSIVE e AS (SELECT 'c' || (s_suppkey + 40) AS child, 'c' || s_suppkey AS parent FROM supplier UNION SELECT 'n' || n_nationkey, 'c' || (s_suppkey) FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 7 = 0),
k AS (SELECT 'c' || n_nationkey AS root FROM nation), cl AS (SELECT root, root AS node, 0 AS depth FROM k UNION SELECT root, child, depth + 1 FROM cl JOIN e ON parent = node)
SELECT root, node, min(depth) AS depth FROM cl WHERE depth > 0 GROUP BY root, node""")
def _(t):
    chain = t.supplier.select(F.concat(F.lit("c"), F.col("s_suppkey") + 40).alias("child"), F.concat(F.lit("c"), "s_suppkey").alias("parent"))
    side = t.nation.join(t.supplier.where("s_suppkey % 7 = 0"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("c"), "s_suppkey"))
    return graph.closure(chain.union(side), t.nation.select(F.concat(F.lit("c"), "n_nationkey").alias("root")), plain_levels=1)
