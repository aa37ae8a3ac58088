"""Publication statistics. Distributed sums first, small algebra last."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions import fixed
from framelens.functions.matching import first_case
from framelens.operators.aggregates import n_if
from framelens.operators.scale import number_few, number_rows


def wilson(k: Column, n: Column, z: float = fixed.Z_95) -> Column:
    """Struct (p, lo, hi) of the Wilson score interval, clamped to [0, 1]; zeros for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    denom = F.lit(1.0) + F.lit(z * z) / n
    centre = (p + F.lit(z * z / 2) / n) / denom
    half = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + F.lit(z * z / 4) / n) / n) / denom

    def known(c: Column) -> Column:
        # least and greatest skip nulls, so an empty sample is caught first.
        return F.when(n.isNull(), F.lit(0.0)).otherwise(c)

    return F.struct(
        known(p).alias("p"),
        known(F.greatest(F.lit(0.0), centre - half)).alias("lo"),
        known(F.least(F.lit(1.0), centre + half)).alias("hi"),
    )


def rule_of_three(n: Column) -> Column:
    """Upper 95 % bound for zero observations; null for an empty denominator."""
    return F.lit(3.0) / F.nullif(n, F.lit(0))


def inferred_denominator(k: Column, precision: Column) -> Column:
    """Denominator behind a count and its published rate."""
    return F.when(precision > 0, F.round(k / precision)).otherwise(F.lit(0.0)).cast("long")


def kappa_value(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cohen's kappa of a 2×2 table; 0 without rows, 1 when chance agreement is 1."""
    n = (a + b + c + d).cast("double")
    safe = F.nullif(n, F.lit(0.0))
    po = (a + d) / safe
    pe = ((a + b) * (a + c) + (c + d) * (b + d)) / (safe * safe)
    return (
        F.when(n == 0, F.lit(0.0)).when(pe == 1, F.lit(1.0)).otherwise((po - pe) / F.nullif(F.lit(1.0) - pe, F.lit(0.0)))
    )


def kappa_band(value: Column, n: Column, chance_is_one: Column) -> Column:
    band = first_case(((value >= t, name) for t, name in fixed.KAPPA_BANDS), "slight")
    return F.when(n == 0, F.lit("undefined")).when(chance_is_one, F.lit("perfect")).otherwise(band)


def kappa(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement of two raters (0/1 columns): table cells, kappa and band."""
    xs, ys = F.col(x) == 1, F.col(y) == 1
    aggs = [
        n_if(xs & ys).alias("a"), n_if(xs & ~ys).alias("b"), n_if(~xs & ys).alias("c"), n_if(~xs & ~ys).alias("d")
    ]
    t = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    a, b, c, d = (F.col(k) for k in "abcd")
    n = a + b + c + d
    one = (n > 0) & ((a + b) * (a + c) + (c + d) * (b + d) == n * n)
    return t.withColumn("kappa", kappa_value(a, b, c, d)).withColumn("band", kappa_band(F.col("kappa"), n, one))


def kappa_adjusted(tp_rate: Column, base: float = 0.14, n: int = 1000) -> Column:
    """Kappa when only positives were verified, from the assumed base rate; unseen misses count as zero."""
    a = F.round(tp_rate * F.lit(base * n))
    b = F.round((F.lit(1.0) - tp_rate) * F.lit(base * n))
    return kappa_value(a, b, F.lit(0.0), F.lit(float(round((1 - base) * n))))


def annotation_report(df: DataFrame, x: str, y: str, consensus: str) -> DataFrame:
    """Two annotators (``0``, ``1``, ``?``) and their consensus: kappa over decided rows, precision over agreed rows."""
    decided = F.col(x).isin("0", "1") & F.col(y).isin("0", "1")
    x1, y1 = F.col(x) == "1", F.col(y) == "1"
    agreed = F.col(consensus).isin("0", "1")
    t = df.agg(
        n_if(decided & x1 & y1).alias("a"), n_if(decided & x1 & ~y1).alias("b"),
        n_if(decided & ~x1 & y1).alias("c"), n_if(decided & ~x1 & ~y1).alias("d"),
        n_if(agreed & (F.col(consensus) == "1")).alias("hits"), n_if(agreed).alias("agreed"),
    )
    w = wilson(F.col("hits"), F.col("agreed"))
    return t.withColumn("kappa", kappa_value(*(F.col(k) for k in "abcd"))).withColumn("w", w).select(
        "*", F.col("w.p").alias("precision"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")
    ).drop("w")


def chi2_2x2(df: DataFrame, split: Column, outcome: Column, by: Sequence[str] = ()) -> DataFrame:
    """Pearson chi² without correction, Cramér's V and their bands."""
    aggs = [
        n_if(split & outcome).alias("a"), n_if(~split & outcome).alias("b"),
        n_if(split & ~outcome).alias("c"), n_if(~split & ~outcome).alias("d"),
    ]
    t = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    a, b, c, d = (F.col(k).cast("double") for k in "abcd")
    n = a + b + c + d
    det = a * d - b * c
    chi2 = n * det * det / F.nullif((a + b) * (c + d) * (a + c) * (b + d), F.lit(0.0))
    out = t.withColumn("chi2", chi2).withColumn("cramers_v", F.sqrt(F.col("chi2") / F.nullif(n, F.lit(0.0))))
    p = first_case(((F.col("chi2") > t_, name) for t_, name in fixed.CHI2_BANDS), "not significant")
    e = first_case(((F.col("cramers_v") < t_, name) for t_, name in fixed.EFFECT_BANDS), "large")
    return out.withColumn("p_band", p).withColumn("effect", e)


def pre_post(df: DataFrame, before: Column, outcome: Column) -> DataFrame:
    """Share of the outcome before and after a cut, and the odds ratio after/before."""
    t = df.agg(
        n_if(before & outcome).alias("pre_yes"), n_if(before & ~outcome).alias("pre_no"),
        n_if(~before & outcome).alias("post_yes"), n_if(~before & ~outcome).alias("post_no"),
    )
    share = lambda y, n: F.round(F.lit(100.0) * F.col(y) / F.greatest(F.col(y) + F.col(n), F.lit(1)), 1)
    odds = (F.col("post_yes") * F.col("pre_no")) / F.nullif(F.col("post_no") * F.col("pre_yes"), F.lit(0))
    return t.withColumns(
        {"pre_pct": share("pre_yes", "pre_no"), "post_pct": share("post_yes", "post_no"), "odds_ratio": odds}
    )


@dataclass(frozen=True)
class LogitResult:
    names: list[str]
    coef: list[float]
    iterations: int
    status: str
    n: int

    @property
    def odds_ratio(self) -> list[float]:
        return [math.exp(c) for c in self.coef]


def logit(df: DataFrame, y: str, xs: Sequence[str], max_iter: int = 25, tol: float = 1e-6) -> LogitResult:
    """Unpenalised logistic regression by reweighted least squares.

    Rows are first folded to distinct feature combinations with a count, then
    each step is one aggregate of X'WX and X'Wz; only k×k sums reach the driver.
    A singular step stops the loop and keeps the last estimate.
    """
    folded = (
        df.select(*[F.col(x).cast("double").alias(f"x{i + 1}") for i, x in enumerate(xs)], F.col(y).cast("double").alias("y"))
        .dropna()
        .groupBy(*[f"x{i + 1}" for i in range(len(xs))], "y")
        .agg(F.count(F.lit(1)).cast("double").alias("m"))
        .withColumn("x0", F.lit(1.0))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    k = len(xs) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta, status, it = np.zeros(k), "max_iter", 0
    try:
        n = int(folded.agg(F.coalesce(F.sum("m"), F.lit(0.0))).first()[0])
        for it in range(1, max_iter + 1):
            eta = sum((F.col(f"x{i}") * F.lit(float(beta[i])) for i in range(k)), F.lit(0.0))
            eta = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), eta))
            mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_eta")))
            step = (
                folded.withColumn("_eta", eta)
                .withColumn("_mu", F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), mu)))
                .withColumn("_w", F.col("_mu") * (F.lit(1.0) - F.col("_mu")))
                .withColumn("_z", F.col("_eta") + (F.col("y") - F.col("_mu")) / F.col("_w"))
                .withColumn("_wm", F.col("_w") * F.col("m"))
            )
            sums = step.agg(
                *[F.sum(F.col("_wm") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs],
                *[F.sum(F.col("_wm") * F.col(f"x{i}") * F.col("_z")).alias(f"g{i}") for i in range(k)],
            ).first()
            if sums["g0"] is None:
                status = "empty"
                break
            h = np.zeros((k, k))
            for i, j in pairs:
                h[i, j] = h[j, i] = sums[f"h{i}_{j}"]
            try:
                new = np.linalg.solve(h, np.array([sums[f"g{i}"] for i in range(k)]))
            except np.linalg.LinAlgError:
                status = "singular"
                break
            done = np.max(np.abs(new - beta)) < tol
            beta = new
            if done:
                status = "converged"
                break
    finally:
        folded.unpersist()
    return LogitResult(["intercept", *xs], [float(b) for b in beta], it, status, n)


def logit_table(df: DataFrame, y: str, xs: Sequence[str], **kw) -> DataFrame:
    """:func:`logit` as a table of term, coefficient and odds ratio."""
    r = logit(df, y, xs, **kw)
    rows = [(t, c, o, r.n, r.status) for t, c, o in zip(r.names, r.coef, r.odds_ratio)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, odds_ratio double, n long, status string")


def spearman(df: DataFrame, a: str, b: str, order: str, few: bool = False) -> DataFrame:
    """Rank correlation by position: ties are broken by ``order``, not averaged.

    Rows with a missing value are dropped; fewer than two rows give null. ``few``: see :func:`correlation_table`.
    """
    both = df.select(order, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    number = number_few if few else number_rows
    ra = number(both, [F.col(a).asc(), F.col(order).asc()], "_ra")
    rb = number(ra, [F.col(b).asc(), F.col(order).asc()], "_rb")
    diff = (F.col("_ra") - F.col("_rb")).cast("double")
    n = F.col("n").cast("double")
    return rb.agg(F.count(F.lit(1)).alias("n"), F.sum(diff * diff).alias("d2")).withColumn(
        "rho", F.when(n >= 2, F.lit(1.0) - F.lit(6.0) * F.col("d2") / (n * (n * n - F.lit(1.0))))
    )


def correlation_table(df: DataFrame, primary: str, others: Sequence[str], order: str, few: bool = False) -> DataFrame:
    """:func:`spearman` of one column against several: (metric, n, rho), all in one pass over the table in long form.

    With the metric first in the order, both positions of a row count from the same start, so their difference is that of the
    ranks. ``few`` says that the table is small by nature (a row for each model): then nothing is written and nothing runs here.
    """
    def as_double(c: str) -> Column:
        return F.col(c).cast("double")

    pair = F.array(*[F.struct(F.lit(o).alias("metric"), as_double(o).alias("b")) for o in others])
    long = df.select(F.col(order).alias("o"), as_double(primary).alias("a"), F.explode(pair).alias("p")).select("o", "a", "p.metric", "p.b")
    long = long.where("a IS NOT NULL AND b IS NOT NULL")
    number = number_few if few else number_rows
    rb = number(number(long, [F.col("metric"), F.col("a"), F.col("o")], "ra"), [F.col("metric"), F.col("b"), F.col("o")], "rb")
    diff, n = (F.col("ra") - F.col("rb")).cast("double"), F.col("n").cast("double")
    sums = rb.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum(diff * diff).alias("d2"))
    # Metrics without a complete row count nothing.
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(o) for o in others])).alias("metric"))
    rho = F.when(n >= 2, F.lit(1.0) - F.lit(6.0) * F.col("d2") / (n * (n * n - F.lit(1.0))))
    return every.join(sums, "metric", "left").select("metric", F.coalesce("n", F.lit(0)).cast("long").alias("n"), rho.alias("rho"))


def rank_correlations(df: DataFrame, primary: str, others: Sequence[str], order: str, few: bool = False) -> list[tuple[str, int, float | None]]:
    """:func:`correlation_table` as a list in the order of ``others``: (other, rows, rho)."""
    got = {r["metric"]: (r["n"], r["rho"]) for r in correlation_table(df, primary, others, order, few).collect()}
    return [(o, *got[o]) for o in others]


def stability(rho: Column) -> Column:
    return F.when(rho.isNull(), "undefined").when(rho >= 0.9, "stable").when(rho >= 0.7, "moderate").otherwise("sensitive")


def sensitivity(df: DataFrame, primary: str, others: Sequence[str], order: str, few: bool = False) -> DataFrame:
    """Rank correlation of the primary score with every other one, with a stability band."""
    return correlation_table(df, primary, others, order, few).withColumn("stability", stability(F.col("rho")))


def pc1_weights(df: DataFrame, cols: Sequence[str], digits: int = 4) -> list[float] | None:
    """Weights of the first principal component over complete rows.

    One aggregate gives all sample covariances. The component is scaled to
    sum to one after its sign is fixed and negatives are clipped; null with
    fewer than four complete rows.
    """
    full = df.select(*cols).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    got = full.agg(
        F.count(F.lit(1)).alias("n"), *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]
    ).first()
    if got["n"] < 4:
        return None
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"]
    v = np.linalg.eigh(cov)[1][:, -1]
    v = -v if v.sum() < 0 else v
    v = np.clip(v, 0, None)
    return [round(float(x), digits) for x in v / (v.sum() or 1.0)]
