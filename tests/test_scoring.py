"""Scores, labels, sub-types and hits on hand-made documents."""

import pytest
from pyspark.sql import functions as F

from conftest import col_values
from framelens.functions import scoring
from framelens.lexicon import DomainRule, GroupPattern, Lexicon, Override, Signal, TextRule
from framelens.operators import aggregates as ag
from framelens.operators import classify as cl
from framelens.operators import filters as fl

LEX = Lexicon(
    (
        Signal("autonomous region", "a", 2.0, "name"),
        Signal("остров наш союз", "a", 1.0, "ru"),
        Signal("free.*isle", "a", 1.0, "en"),
        Signal("annexed", "a", 1.0, "en"),
        Signal("region of isle", "b", 1.5, "name"),
        Signal("вернулся домой", "b", 1.0, "ru"),
        Signal("reunited", "b", 1.0, "en"),
        Signal("never seen", "b", 3.0, "none"),
    ),
    overrides=(Override(("autonomous region of isle",)),),
    attribution=("according to", "so-called"),
    structured=("postcode:? *[0-9]{5}",),
    news_domains=("news.example",),
    tiers=(DomainRule("gov.example", "government"), DomainRule("rt.example", "t1")),
)

DOCS = [
    (1, "It was annexed, annexed and annexed; reunited once", "https://x.example/1"),  # presence ties, occurrence does not
    (2, "Reunited with joy", "https://www.rt.example/2"),
    (3, "", ""),
    (4, None, None),
    (5, "ОСТРОВ НАШ СОЮЗ", "https://smart.example/5"),
    (6, "free\nisle", "https://y.example"),  # the parts of a signal on two lines
    (7, "The Autonomous Region of Isle", "https://y.example"),
    (8, "The autonomous region of isle and the region of isle", "https://y.example"),
    (9, "According to them it was reunited", "https://y.example"),
    (10, "Reunited, postcode: 12345", "https://y.example"),
    (11, "Reunited at news", "https://news.example/a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, text string, url string").cache()


def test_presence_counts_once_occurrence_counts_matches(docs):
    p = {r["id"]: (r["score_a"], r["score_b"]) for r in cl.with_scores(docs, LEX).collect()}
    o = {r["id"]: (r["score_a"], r["score_b"]) for r in cl.with_scores(docs, LEX, mode="occurrence").collect()}
    assert p[1] == (1.0, 1.0) and o[1] == (3.0, 1.0)
    assert p[3] == p[4] == (0.0, 0.0)
    assert p[5] == (1.0, 0.0), "upper-case Cyrillic"
    assert p[6] == (0.0, 0.0), "a dot does not cross a line break"
    assert all(p[i][0] <= o[i][0] and p[i][1] <= o[i][1] for i in p)


def test_classify_labels_and_sub_types(docs):
    rows = {r["id"]: r for r in cl.classify(docs, LEX).collect()}
    label = {i: r["label"] for i, r in rows.items()}
    assert label == {1: "disputed", 2: "b", 3: "no_signal", 4: "no_signal", 5: "a", 6: "no_signal", 7: "a", 8: "a", 9: "b", 10: "b", 11: "b"}
    assert rows[2]["framing_type"] == "assertive_pure" and not rows[2]["is_quoted"] and rows[2]["source_type"] == "t1"
    assert rows[9]["framing_type"] == "reportage_attribution" and rows[9]["is_quoted"]
    assert rows[10]["framing_type"] == "assertive_structured" and not rows[10]["is_quoted"]
    assert rows[11]["framing_type"] == "reportage_news" and rows[11]["is_quoted"]
    assert rows[5]["source_type"] == "independent" and rows[5]["framing_type"] == "" and rows[5]["text_preview"] is None
    assert rows[2]["confidence"] == 0.95 and rows[1]["confidence"] == 0.5 and rows[3]["confidence"] == 0.0


def test_override_fires_even_when_the_short_name_also_stands_alone(docs):
    got = {r["id"]: (r["score_a"], r["score_b"]) for r in cl.apply_overrides(cl.with_scores(docs, LEX), LEX).collect()}
    assert got[7] == (3.5, 0.0) and got[8] == (3.5, 0.0)


def test_label_does_not_depend_on_partitions(docs):
    a = col_values(cl.classify(docs.repartition(1), LEX), "id", "label")
    b = col_values(cl.classify(docs.repartition(7, "id"), LEX), "id", "label")
    assert a == b


def test_gated_label(docs):
    got = col_values(cl.gated_label(docs, LEX, cl.topic_condition(F.col("text"), ("isle", "reunited"))), "id", "label")
    assert got[5] == "no_topic_ref" and got[9] == "b" and got[7] == "a"


def test_hits_have_overlapping_contexts(frame):
    d = frame([("xx reunited yy Reunited zz",)], "text string")
    hits = d.select(scoring.signal_hits(F.col("text"), (LEX.signals[6],), None, 6).alias("h")).first()["h"]
    assert [(h["matched"], h["context"]) for h in hits] == [("reunited", "xx reunited yy Re"), ("Reunited", "ed yy Reunited zz")]
    assert d.select(F.size(scoring.signal_hits(F.col("text"), LEX.signals, 1, 6))).first()[0] == 1
    assert d.select(F.size(scoring.signal_hits(F.lit("nothing"), LEX.signals))).first()[0] == 0


def test_window_and_preview(frame):
    d = frame([("aaa isle bbb isle",), ("none",), ("крым\r\nx",)], "text string")
    low = F.lower("text")
    w = [r[0] for r in d.select(scoring.mention_window(F.col("text"), low, ("isle", "zz"), 3, 2)).collect()]
    assert w == ["aa isl", "no", "кр"]
    p = [r[0] for r in d.select(scoring.preview(F.col("text"), 6)).collect()]
    assert p == ["aaa is", "none", "крым "]
    b = [r[0] for r in d.select(scoring.preview(F.col("text"), 5, "byte")).collect()]
    assert b == ["aaa i", "none", "кр"]


def test_groups(frame):
    pats = (GroupPattern("g1", "red"), GroupPattern("g1", "rot"), GroupPattern("g2", "b[lu]+e"))
    d = frame([(1, "Red red rot"), (2, "blue"), (3, "x"), (4, None)], "id int, text string")
    got = {r["id"]: (r["groups"], r["hits"]) for r in cl.detect_groups(d, pats).collect()}
    assert got == {1: (["g1"], {"g1": 3}), 2: (["g2"], {"g2": 1})}


def test_cascades(frame):
    d = frame([("Republic town", ""), ("autonomous republic town", ""), ("town", "in the north"), (None, None)], "d string, e string")
    got = [r[0] for r in d.select(scoring.describe_label(
        F.col("d"), F.col("e"), (TextRule("a", ("north",)),),
        (TextRule("b", ("republic",), none_of=("autonomous",)), TextRule("a", ("autonomous",))),
        (TextRule("a_in_text", ("north",)),))).collect()]
    assert got == ["b", "a", "a_in_text", "no_signal"]
    codes = frame([("A",), ("b",), (None,)], "c string").select(scoring.code_class(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["A", "B", "other"]
    v = frame([(" Endorses it",), ("well, it is long, ENDORSES",), (None,)], "t string").select(
        scoring.parse_verdict(F.col("t"), (("ENDORSES", "endorses"),))).collect()
    assert [r[0] for r in v] == ["endorses", "unclear", "unclear"]


def test_registry_encoding_status(frame):
    d = frame([(1, 1, 1), (1, 0, 0), (0, 2, 0), (0, 0, 0)], "a int, b int, x int")
    got = [r[0] for r in d.select(scoring.encoding_status(F.col("a"), F.col("b"), F.col("x"))).collect()]
    assert got == ["incorrect", "correct", "incorrect", "na"]


def test_census_totals(docs):
    c = ag.census(cl.classify(docs, LEX), "a", "b", ("t1", "independent")).first()
    assert c["total"] == len(DOCS) == c["n_a"] + c["n_b"] + c["n_disputed"] + c["n_no_signal"]
    assert c["tier_t1"] + c["tier_independent"] == c["n_b"] and c["assertive_pct"] == 50.0


def test_published_census_shares_add_up():
    splits = {"total": (286_117, 3_639_461, 30_192_896)}
    assert sum(splits["total"]) == 34_118_474
    assert round((1_783 + 7_023 + 796_796) / 894_645 * 100, 1) == 90.0


def test_filters(frame):
    d = frame([(1, "Simple stem"), (2, "the stemming"), (3, None)], "id int, text string")
    assert [r["id"] for r in fl.topic_filter(d, ("stem",)).collect()] == [1, 2]
    assert [r["id"] for r in fl.topic_filter(d, ("stem",), whole_words=True).collect()] == [1]
    y = frame([(1, 2010), (2, 0), (3, None), (4, 1990)], "id int, y int")
    assert sorted(r["id"] for r in fl.between_years(y, "y", 2000, 2020).collect()) == [1, 2, 3]
    assert [r["id"] for r in fl.between_years(y, "y", 2000, 2020, keep_missing=False).collect()] == [1]


def test_current_claims(frame):
    rows = [(1, [("A", "normal", None), ("B", "preferred", ""), ("C", "deprecated", None)]), (2, [("A", "normal", ""), ("B", "normal", "2001")]), (3, [])]
    d = frame(rows, "id int, claims array<struct<country:string,rank:string,end:string>>")
    got = {r["id"]: [c["country"] for c in r["claims"]] for r in fl.current_claims(d).collect()}
    assert got == {1: ["B"], 2: ["A"], 3: []}
    flat = d.select("id", F.explode("claims").alias("c")).select("id", "c.*")
    rows = sorted((r["id"], r["country"]) for r in fl.current_claim_rows(flat, "id").collect())
    assert rows == [(1, "B"), (2, "A")]


def test_lexicon_is_checked(spark):
    with pytest.raises(ValueError):
        Lexicon((Signal("x", "c", 1.0),))
    with pytest.raises(ValueError):
        Signal("", "a", 1.0)
    t = spark.createDataFrame([("x y", "a", 1.5, None)], "pattern string, pole string, weight double, kind string")
    assert Lexicon.from_table(t).signals == (Signal("x y", "a", 1.5, ""),)
