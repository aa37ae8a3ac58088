"""Answer classes, scores, page probes and HTML clean-up."""

from pyspark.sql import functions as F

from framelens.functions import answers as an
from framelens.functions import pages
from framelens.lexicon import TextRule
from framelens.operators import aggregates as ag
from framelens.operators import joins

ENTITY = (TextRule("north", ("northland",)), TextRule("south", ("southland",)))


def test_forced_answers(frame):
    rows = [("  Так, це так", "uk", False), ("Yes", "xx", False), ("Nope", "en", False), ("It depends", "en", False), ("It is in Northland", "en", True),
            ("It is in Northland", "en", False), ("Elsewhere entirely", "en", True), (None, "en", False), ("x" * 120 + " disputed", "en", False)]
    d = frame(rows, "a string, l string, g boolean")
    got = [r[0] for r in d.select(an.classify_answer(F.col("a"), F.col("l"), F.col("g"), ENTITY)).collect()]
    assert got == ["yes", "yes", "no", "disputed", "north", "other", "other", "other", "other"]
    raw = [r[0] for r in d.select(an.classify_answer(F.col("a"), F.col("l"), F.col("g"), ENTITY, head=50, keep_raw=9)).collect()]
    assert raw[6] == "Elsewhere"


def test_open_answers_and_scores(frame):
    d = frame([("Northland is it, unclear", ["northland"], ["southland"]), ("both southland, northland", ["northland"], ["southland"]), ("none", None, None)],
              "a string, e array<string>, w array<string>")
    got = [tuple(r[0]) for r in d.select(an.classify_open(F.col("a"), F.col("e"), F.col("w"))).collect()]
    assert got == [("a", True, True, False), ("disputed", False, True, True), ("no_signal", False, False, False)]
    s = frame([("other", "yes", None), ("disputed", "yes", True), ("yes", "yes", None), ("no", "yes", None), ("no", "yes", True), (None, "yes", True)],
              "c string, e string, k boolean")
    assert [r[0] for r in s.select(an.score_forced(F.col("c"), F.col("e"), F.col("k"))).collect()] == [None, 0.5, 1.0, 0.0, 1.0, None]
    o = frame([("a", True, False), ("b", False, True), ("disputed", True, False), ("disputed", False, True), ("disputed", True, True), ("no_signal", False, False)],
              "l string, x boolean, y boolean")
    assert [r[0] for r in o.select(an.score_open(F.col("l"), F.col("x"), F.col("y"))).collect()] == [1.0, 0.0, 0.75, 0.25, 0.5, None]


def test_json_and_reasoning(frame):
    d = frame([('```json\n{"q": "Q1"}\n```',), ('x {"q": "Q2"} y',), ("{broken",), (None,)], "t string")
    assert [r[0] and r[0]["q"] for r in d.select(an.salvage_json(F.col("t"), "q string")).collect()] == ["Q1", "Q2", None, None]
    r = frame([("<think>a\nb</think>\n yes ", "z"), ("<think>only</think>", " why "), (None, None)], "c string, r string")
    assert [x[0] for x in r.select(an.strip_reasoning(F.col("c"), F.col("r"))).collect()] == ["yes", "why", ""]


def test_probe_report(frame):
    d = frame([("In 1939 it was 49.6 %, tatar as a state language", ["http://Proxy.example/x", "http://o.example"], ["49.6", "tatar.*state"], ["absent"], ["it was"])],
              "r string, u array<string>, m array<string>, a array<string>, p array<string>")
    args = [F.col(c) for c in "rumap"]
    p = d.select(an.probe_report(*args, ("proxy.example",), regex=True).alias("p")).first()["p"]
    assert (p["markers"], p["anti_markers"], p["source_phrases"], p["proxy_cited"], p["is_hit"]) == (
        ["49.6", "tatar.*state"], [], ["it was"], ["http://Proxy.example/x"], True)
    assert d.select(an.probe_report(*args, ()).alias("p")).first()["p"]["markers"] == ["49.6"]


def test_composites(frame):
    d = frame([("m", "en", 1.0, 0.5, None, 0.0), ("m", "fr", None, None, 0.4, None), ("n", "en", None, None, None, None)], "model string, language string, D double, L double, I double, R double")
    got = {r["model"]: r for r in ag.scheme_scores(d, "model").collect()}
    # Weights of the tiers present are renormalised; cells are rounded before the mean.
    assert got["m"]["primary"] == round((round((0.1 * 1 + 0.5 * 0.5) / 0.8, 4) + 0.4) / 2, 4)
    assert got["m"]["free_only"] == 0.0 and got["n"]["primary"] is None and got["m"]["n_languages"] == 2
    rob = {r["model"]: r for r in ag.robust_scores(d, "model").collect()}
    assert rob["m"]["min"] == 0.2 and rob["m"]["harmonic_mean"] == 0.6667, "zero skipped, single value ignored"


def test_worklist_size_and_resume(spark, frame):
    items = frame([("q1", True), ("q2", False)], "item string, is_template boolean")
    subjects = frame([("m1",), ("m2",), ("m3",)], "model string")
    work = joins.worklist(subjects, items, ("x", "y"), ("en", "fr", "de"))
    assert work.count() == joins.worklist_size(subjects, items, 2, 3).first()[0] == 3 * (2 + 1) * 3
    done = work.where("model = 'm1'").select("model", "item", "entity", "lang")
    assert joins.pending(work, done, ["model", "item", "entity", "lang"]).count() == 18


HTML = """<HTML><head><Title> A &amp; B </Title><SCRIPT>var a="</p>";</SCRIPT></head><body><NAV>menu</NAV><p>Tom&#39;s&nbsp;&lt;x&gt;</p>
<script type="application/ld+json">{"@type":"BreadcrumbList","n":1}</script><ol class="a breadcrumb"><li>Home</li></ol></body></HTML>"""


def test_html(frame):
    d = frame([(HTML,), ('<div class="my-breadcrumbs x">Home <b>Sub</b></div>',), (None,)], "h string")
    h = F.col("h")
    text = [r[0] for r in d.select(pages.html_to_text(h)).collect()]
    assert text == ["A & B Tom's <x> Home", "Home Sub", ""]
    assert d.select(pages.html_to_text(h, 5, entities=False)).first()[0] == "A &am"
    assert [r[0] for r in d.select(pages.page_title(h)).collect()] == ["A & B", "", ""]
    assert [r[0] for r in d.select(pages.breadcrumb(h)).collect()] == ['{"@type":"BreadcrumbList","n":1}', "Home Sub", ""]


def test_codes_come_in_order(frame):
    d = frame([('[{"x":"country=RU","country" : "UA"}]',), ('"country":"UA"',), ("?country=RUS country=DE ",), (None,)], "b string")
    assert [r[0] for r in d.select(pages.ordered_codes(F.col("b"))).collect()] == [["UA", "RU"], [], ["DE"], []]


RULES = pages.PageRules(("(?i)alpha",), ("(?i)beta",), "(?i)coast", "/alpha/", "/beta/", code_a="AA", code_b="BB", b_origin="B")


def test_page_status_cascade(frame):
    rows = [
        ("untested", 200, "X", "", "", "", "untested"), ("na", 503, "X", "", "", "", "unreachable"), ("ok", 200, "B", "u/alpha/", "", "alpha", "correct"),
        ("ok", 200, "B", "u/alpha/", "", "", "incorrect"), ("ok", 200, "X", "", "", '{"country":"AA","country":"BB"}', "correct"),
        ("ok", 200, "X", "u/alpha/", "beta", "", "incorrect"), ("ok", 200, "X", "u/alpha/", "coast", "", "url_correct_ui_ambiguous"),
        ("ok", 200, "X", "u/alpha/", "", "", "correct"), ("ok", 200, "X", "", "alpha", "", "correct"), ("ok", 200, "X", "", "coast alpha beta", "", "url_correct_ui_ambiguous"),
        ("na", 200, "X", "", "", "alpha " * 9, "na"), ("ok", 200, "X", "", "", "alpha " * 5, "correct"), ("ok", 200, "X", "", "", "beta " * 5 + "alpha alpha", "incorrect"),
        ("ok", 200, "X", "", "", "alpha " * 4, "url_correct_ui_ambiguous"),
    ]
    d = frame(rows, "prior string, http int, origin string, url string, title string, body string, want string")
    d = d.withColumn("p", pages.probe_page(F.col("url"), F.col("title"), F.col("body"), RULES))
    s = d.select("want", pages.page_status(F.col("prior"), F.col("http"), F.col("origin"), F.col("p"), RULES).alias("s")).collect()
    assert [r["s"]["status"] for r in s] == [r["want"] for r in s] and all(r["s"]["reason"] for r in s)


def test_consistency(frame):
    rows = [("p", "x", "a"), ("p", "y", "b"), ("q", "x", "a"), ("q", "y", "a"), ("r", "x", "a"), ("s", "x", "a"), ("s", "y", "unclear")]
    got = {r["k"]: r["verdict"] for r in ag.consistency(frame(rows, "k string, place string, cls string"), "k", "place", "cls").collect()}
    assert got == {"p": "varying", "q": "consistent", "r": "insufficient", "s": "unclear"}
