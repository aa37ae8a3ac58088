"""Statistics against published numbers and independent computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import aggregates as ag
from framelens.operators import stats

# Tier means (D, L, I, R) of the sixteen complete subjects.
TIER_MEANS = [
    (0.9259, 0.9693, 0.9704, 0.6541), (0.8904, 0.9078, 0.9871, 0.8033), (0.9198, 0.9401, 0.9082, 0.8015), (0.9251, 0.8838, 0.9744, 0.7255),
    (0.8636, 0.9793, 0.7721, 0.708), (0.6447, 0.9655, 0.9039, 0.6023), (0.5492, 0.8362, 0.9353, 0.7124), (0.7143, 0.8952, 0.7563, 0.7299),
    (0.5609, 0.84, 0.8743, 0.8517), (0.6286, 0.8537, 0.8034, 0.7448), (0.7149, 0.8464, 0.7195, 0.6611), (0.5372, 0.7466, 0.9138, 0.7968),
    (0.4843, 0.7878, 0.6587, 0.7893), (0.3958, 0.691, 0.6914, 0.8771), (0.4358, 0.5953, 0.7392, 0.8965), (0.2408, 0.6849, 0.6604, 0.7929),
]
# (position in name order, primary, uniform, free_only, harmonic mean) of all subjects.
SCORES = [
    (1, 0.4716, 0.4716, None, None), (2, 0.8562, 0.8096, 0.6289, 0.7827), (3, 0.9016, 0.8793, 0.649, 0.8416), (4, 1.0, 1.0, None, None),
    (5, 0.8219, 0.8219, None, None), (6, 0.8499, 0.7344, None, 0.6898), (7, 0.6838, 0.6421, 0.8583, 0.5914), (8, 0.8677, 0.8683, 0.6653, 0.8569),
    (9, 0.8011, 0.7466, 0.6268, 0.719), (10, 0.7369, 0.7093, 0.6863, 0.6667), (11, 0.8018, 0.7577, 0.709, 0.6992), (12, 0.7669, 0.7309, 0.6417, 0.6998),
    (13, 0.8316, 0.7585, 0.5618, 0.7043), (14, 0.7698, 0.7193, 0.5796, 0.7005), (15, 0.6659, 0.604, None, 0.6335), (16, 0.3754, 0.3754, None, None),
    (17, 0.6037, 0.5603, None, 0.5277), (18, 0.3333, 0.3333, None, None), (19, 0.796, 0.7486, 0.7219, 0.7235), (20, 0.753, 0.7486, None, 0.8571),
    (21, 0.7145, 0.664, 0.7503, 0.6281), (22, 0.6565, 0.6552, 0.8798, 0.5709), (23, 0.894, 0.8889, 0.7667, 0.8658), (24, 0.317, 0.317, None, None),
    (25, 0.6, 0.6, None, None), (26, 0.4, 0.4, None, None), (27, 0.2728, 0.2728, None, None), (28, 1.0, 1.0, None, None),
    (29, 0.763, 0.6761, None, 0.6679), (30, 0.6517, 0.5836, 0.8094, 0.5185), (31, 0.8937, 0.8803, 0.7578, 0.853),
]


def test_wilson(frame):
    w = frame([(4714, 7670), (87, 96), (0, 0), (5, 5)], "k long, n long").select(stats.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    pct = [tuple(round(100 * w[i]["w"][c], 3) for c in ("p", "lo", "hi")) for i in range(4)]
    assert pct[0] == (61.46, 60.366, 62.543)
    assert tuple(round(x, 1) for x in pct[1]) == (90.6, 83.1, 95.0)
    assert pct[2] == (0.0, 0.0, 0.0) and pct[3][2] == 100.0


def test_two_annotators(frame):
    rows = [("1", "1", "1")] * 87 + [("0", "0", "0")] * 9 + [("1", "0", "disagree")] + [("?", "1", "?")] * 3
    r = stats.annotation_report(frame(rows, "a string, b string, c string"), "a", "b", "c").first()
    assert round(r["kappa"], 3) == 0.942 and r["agreed"] == 96 and round(100 * r["precision"], 1) == 90.6
    assert (round(100 * r["lo"], 1), round(100 * r["hi"], 1)) == (83.1, 95.0)


def test_kappa_special_cases(frame):
    k = lambda rows: stats.kappa(frame(rows, "x int, y int"), "x", "y").first()
    assert (k([(1, 1)] * 4)["kappa"], k([(1, 1)] * 4)["band"]) == (1.0, "perfect")
    assert (k([])["kappa"], k([])["band"]) == (0.0, "undefined")
    assert k([(1, 1)] * 5 + [(0, 0)] * 5)["band"] == "almost perfect"
    adj = frame([(0.5,)], "r double").select(stats.kappa_adjusted(F.col("r"))).first()[0]
    po, pe = 0.93, (140 * 70 + 860 * 930) / 1e6
    assert math.isclose(adj, (po - pe) / (1 - pe), rel_tol=1e-12)


def test_chi2(frame):
    rows = [(True, True)] * 30 + [(True, False)] * 10 + [(False, True)] * 15 + [(False, False)] * 45
    r = stats.chi2_2x2(frame(rows, "s boolean, o boolean"), F.col("s"), F.col("o")).first()
    obs = np.array([[30, 15], [10, 45]], float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    assert math.isclose(r["chi2"], ((obs - exp) ** 2 / exp).sum(), rel_tol=1e-9)
    assert r["p_band"] == "<0.001" and r["effect"] == "medium", "V = sqrt(24.24 / 100) = 0.49"


def test_logit_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, (2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 0.8 * x[:, 0] - 1.1 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(int(a), int(b), int(c)) for (a, b), c in zip(x, y)], "a int, b int, y int")
    r = stats.logit(df, "y", ["a", "b"])
    m, beta = np.column_stack([np.ones(2000), x]), np.zeros(3)
    for _ in range(25):
        mu = 1 / (1 + np.exp(-m @ beta))
        beta = beta + np.linalg.solve((m * (mu * (1 - mu))[:, None]).T @ m, m.T @ (y - mu))
    assert r.status == "converged" and r.n == 2000 and np.allclose(r.coef, beta, atol=1e-6)
    constant = stats.logit(df.withColumn("b", F.lit(1)), "y", ["a", "b"])
    assert constant.status in ("singular", "max_iter", "converged") and len(constant.coef) == 3
    assert stats.logit(df.where("y > 5"), "y", ["a"]).status == "empty"


def test_spearman_published(spark, frame):
    d = frame(SCORES, "pos int, primary double, uniform double, free_only double, harmonic_mean double")
    assert round(stats.spearman(d, "primary", "uniform", "pos").first()["rho"], 4) == 0.9774
    s = {r["metric"]: (r["n"], round(r["rho"], 4), r["stability"]) for r in stats.sensitivity(d, "primary", ["uniform", "free_only", "harmonic_mean"], "pos").collect()}
    wide = stats.rank_correlations(d, "primary", ["uniform", "free_only"], "pos")
    assert [(o, n, round(r, 4)) for o, n, r in wide] == [("uniform", 31, 0.9774), ("free_only", 16, -0.3853)], "distributed ranks agree"
    assert s == {"uniform": (31, 0.9774, "stable"), "free_only": (16, -0.3853, "sensitive"), "harmonic_mean": (21, 0.8351, "moderate")}


def test_pc1_published(frame):
    d = frame(TIER_MEANS + [(1.0, None, None, None)], "D double, L double, I double, R double")
    assert stats.pc1_weights(d, ["D", "L", "I", "R"]) == [0.528, 0.2549, 0.2171, 0.0]
    assert stats.pc1_weights(d.limit(3), ["D", "L", "I", "R"]) is None


def test_rates_and_gaps(frame):
    r = frame([(100, 0.25, 8)], "n int, p double, k int").select(stats.rule_of_three(F.col("n")), stats.inferred_denominator(F.col("k"), F.col("p"))).first()
    assert tuple(r) == (0.03, 32)
    v = ag.verification_summary(frame([("endorses",), ("reports",), ("unclear",), ("error",), ("fetch_failed",)], "verdict string")).first()
    assert v["verified"] == 3 and v["precision_pct"] == 33.3
    g = ag.elicitation_gap(frame([(0.9, 0.25), (0.9, None)], "D double, R double")).collect()
    assert [x["gap"] for x in g] == [0.65, None]


def test_series_peak_reached_twice(frame):
    s = ag.series_summary(frame([("a", 2, 5.0), ("a", 1, 5.0), ("a", 3, 1.0)], "k string, t int, v double"), "k", "t", "v").first()
    assert (s["peak"], s["peak_at"]) == (5.0, 1) and math.isclose(s["mean"], 11 / 3)


@pytest.mark.parametrize("death,cohort", [(None, "alive_or_unknown"), ("1990-12-31", "died_before"), ("1991-01-01", "died_between"), ("2014-03-18", "died_after")])
def test_cohorts(frame, death, cohort):
    rows = [(1, "A", None, "2014-04-01", death), (1, "A", None, None, death)]
    c = frame(rows, "person int, country string, start string, end string, death string").selectExpr(
        "person", "country", "cast(start as date) start", "cast(end as date) end", "cast(death as date) death")
    r = ag.cohort_summary(ag.person_facts(c, "A", "B", ("S",), "2014-03-18"), ("1991-01-01", "2014-03-18")).first()
    assert r["cohort"] == cohort and r["a_only"] == 1 and r["a_ended"] == 1 and r["invisible_transition"] == 1
