"""Linear models with any number of parameters: normal equations, shared or separate fits, left-out families, boxes.

A table of terms has one sensitivity column per parameter. One aggregate reduces it to a Gram, a right side and a few sums per
group, so a group of any size is combined on the map side and a row stays small. Batched kernels judge the rank and factor the
Grams; solutions, explained sums and bootstrap draws are array expressions on the factors.

Terms with a NULL sensitivity or target are left out. Groups with a NULL key are left out where groups meet totals.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalframe.operators.evidence import chi2_survival, normal
from modalframe.operators.sensitivity import BOUND_FACTORS, LINEAR_RANGE, RCOND

#: Share of the whole Gram below which what a subtraction leaves is rounding.
NOISE = 1e-13
_DOUBLES = T.ArrayType(T.DoubleType())


# ------------------------------------------------------------------------------------------------ normal equations
def normal_sums(terms: DataFrame, keys: list[str], columns: list[str], target: str) -> DataFrame:
    """``keys, n, gram, rhs, rr`` of each group: row-major sums of products of ``columns``, with ``target``, and of its square."""
    whole = terms
    for c in [*columns, target]:
        whole = whole.filter(F.col(c).isNotNull())
    pair = lambda a, b: F.sum(F.col(a) * F.col(b))
    upper = {(i, j): f"_g{i}_{j}" for i in range(len(columns)) for j in range(i, len(columns))}
    sums = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[pair(columns[i], columns[j]).alias(name) for (i, j), name in upper.items()],
                                    *[pair(c, target).alias(f"_b{i}") for i, c in enumerate(columns)], pair(target, target).alias("rr"))
    gram = F.array(*[upper[min(i, j), max(i, j)] for i in range(len(columns)) for j in range(len(columns))])
    return sums.select(*keys, "n", gram.alias("gram"), F.array(*[f"_b{i}" for i in range(len(columns))]).alias("rhs"), "rr")


def add_up(sums: DataFrame, keys: list[str], k: int, *more: Column) -> DataFrame:
    """Normal sums of ``keys`` from those of finer groups, with further aggregates ``more``."""
    total = lambda c, m: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(m)]).alias(c)
    return sums.groupBy(*keys).agg(F.sum("n").alias("n"), total("gram", k * k), total("rhs", k), F.sum("rr").alias("rr"), *more)


_FACTOR = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("factor", _DOUBLES), T.StructField("inverse", _DOUBLES)])


def _stacks(gram: pd.Series):
    """Rows of equal width with their finite Grams in one stack."""
    width = np.array([0 if g is None else math.isqrt(len(g)) for g in gram], dtype=int)
    for k in np.unique(width[width > 0]):
        at = np.flatnonzero(width == k)
        m = np.stack([np.asarray(gram.iat[r], float).reshape(k, k) for r in at])
        good = np.isfinite(m).all(axis=(1, 2))
        yield int(k), at[good], m[good]


def _ranks(m: np.ndarray, floor: np.ndarray, rcond: float) -> np.ndarray:
    """How many singular values of each design exceed ``rcond`` of its largest; eigenvalues up to ``floor`` are rounding."""
    e = np.linalg.eigvalsh(m)
    return (e > np.maximum(rcond**2 * e[:, -1:], np.maximum(floor, 0.0)[:, None])).sum(axis=1)


@F.pandas_udf(_FACTOR)
def _factors(gram: pd.Series, floor: pd.Series, rcond: pd.Series) -> pd.DataFrame:
    out: list = [(0, None, None)] * len(gram)
    for k, at, m in _stacks(gram):
        rank = _ranks(m, floor.to_numpy(float)[at], float(rcond.iat[0])) if len(at) else np.empty(0, int)
        for r, v in zip(at, rank):
            out[r] = (int(v), None, None)
        full = rank == k
        if full.any():
            low = np.linalg.cholesky(m[full])
            for r, a, b in zip(at[full], low, np.linalg.inv(low)):
                out[r] = (k, a.ravel().tolist(), b.ravel().tolist())
    return pd.DataFrame(out, columns=[f.name for f in _FACTOR])


def with_factor(sums: DataFrame, floor: Column | float = 0.0, rcond: float = RCOND) -> DataFrame:
    """Add ``rank`` and, for full rank, the Cholesky ``factor`` of the Gram and its ``inverse`` (row-major)."""
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    return sums.withColumn("_f", _factors("gram", floor, F.lit(rcond))).select(*sums.columns, "_f.*")


def _at(a: str, i: int) -> Column:
    return F.get(a, F.lit(i))


def _lower_times(matrix: str, vector: list[Column]) -> list[Column]:
    """A row-major lower triangle times a vector."""
    k = len(vector)
    return [sum((_at(matrix, i * k + j) * vector[j] for j in range(i + 1)), F.lit(0.0)) for i in range(k)]


def explained(k: int, inverse: str = "inverse", rhs: list[Column] | None = None) -> Column:
    """Part of the sum of squares that the fit explains."""
    y = _lower_times(inverse, rhs or [_at("rhs", i) for i in range(k)])
    return sum((v * v for v in y), F.lit(0.0))


def with_solution(factored: DataFrame, k: int, name: str) -> DataFrame:
    """Add the least-squares solution as an array ``name``; NULL below full rank."""
    y = factored.withColumn("_y", F.array(*_lower_times("inverse", [_at("rhs", i) for i in range(k)])))
    x = F.array(*[sum((_at("inverse", i * k + j) * _at("_y", i) for i in range(j, k)), F.lit(0.0)) for j in range(k)])
    return y.withColumn(name, F.when(F.col("inverse").isNotNull(), x)).drop("_y")


def per_parameter(rows: DataFrame, array: str, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per parameter of an array column: ``keep, parameter, array``; NULL arrays give NULL values."""
    names = F.array(*[F.lit(c) for c in columns])
    return rows.select(*keep, array, F.posexplode(names).alias("_i", "parameter")).withColumn(array, F.get(array, F.col("_i"))).drop("_i")


# ------------------------------------------------------------------------------------------------ shared or separate
def shared_against_separate(terms: DataFrame, campaign: str, specimen: str, columns: list[str], target: str = "residual") -> tuple[DataFrame, DataFrame]:
    """Sums of each specimen, and per campaign one model for all specimens against one each: ``chi2_shared, chi2_separate,
    delta, dof``. ``delta`` is NULL for a single specimen and where a specimen or the campaign lacks full rank."""
    k = len(columns)
    own = with_factor(normal_sums(terms.filter("role = 'FIT'"), [campaign, specimen], columns, target)).withColumn("_left", F.col("rr") - explained(k))
    total = add_up(own, [campaign], k, F.count(F.lit(1)).alias("n_specimens"), F.bool_and(F.col("rank") == k).alias("_all"), F.sum("_left").alias("_separate"))
    total = with_factor(total).withColumn("_ok", F.col("_all") & (F.col("rank") == k))
    total = total.withColumn("chi2_shared", F.when(F.col("rank") == k, F.col("rr") - explained(k))).withColumn("chi2_separate", F.when(F.col("_all"), F.col("_separate")))
    delta = F.when(F.col("_ok") & (F.col("n_specimens") > 1), F.col("chi2_shared") - F.col("chi2_separate"))
    return own, total.withColumn("dof", k * (F.col("n_specimens") - 1)).withColumn("delta", delta)


def consistency(terms: DataFrame, campaign: str, specimen: str, columns: list[str], chi2_valid: bool, target: str = "residual", draws: int = 2000, seed: int = 1,
                alpha: float = 0.01) -> DataFrame:
    """Verdict per campaign with chi2 and bootstrap p for any number of parameters.

    The statistic depends on the noise only through its projections on each specimen's design: as many standard normals per
    specimen as parameters. Draws therefore grow with specimens, not with terms, and meet per (campaign, draw)."""
    if draws < 2000:
        raise ValueError("at least 2000 bootstrap draws are needed")
    k = len(columns)
    own, total = shared_against_separate(terms, campaign, specimen, columns, target)
    good = total.filter(F.col("delta").isNotNull()).select(campaign, "delta", F.col("inverse").alias("_shared"))
    d = own.select(campaign, specimen, "factor").join(good, campaign).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    ident = [F.lit(seed), F.col("draw"), F.col(campaign), F.col(specimen)]
    for i in range(k):
        d = d.withColumn(f"_u{i}", normal(F.lit(i + 1), *ident))
    u = [F.col(f"_u{i}") for i in range(k)]
    sums = d.groupBy(campaign, "draw").agg(F.first("delta").alias("delta"), F.first("_shared").alias("_shared"), F.sum(sum((v * v for v in u), F.lit(0.0))).alias("_uu"),
                                           *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(_lower_times("factor", u))])
    stat = F.col("_uu") - explained(k, "_shared", [F.col(f"_w{i}") for i in range(k)])
    p = sums.groupBy(campaign).agg(((1 + F.sum((stat >= F.col("delta")).cast("int"))) / float(draws + 1)).alias("bootstrap_p"))
    out = total.join(p, campaign, "left").withColumn("chi2_p", chi2_survival(F.col("delta"), F.col("dof")))
    decisive = F.col("chi2_p") if chi2_valid else F.col("bootstrap_p")
    status = F.when(~F.col("_ok"), "NOT_EVALUABLE_RANK_DEFICIENT").when(F.col("n_specimens") < 2, "NOT_EVALUABLE").when(decisive < alpha, "FAIL").otherwise("PASS")
    return out.withColumn("status", status).select(campaign, "n_specimens", "chi2_shared", "chi2_separate", "delta", "dof", "chi2_p", "bootstrap_p", "status")


# ------------------------------------------------------------------------------------------------ left-out families
def left_out_shifts(terms: DataFrame, keys: list[str], columns: list[str], family: str = "family", target: str = "residual") -> DataFrame:
    """``keys, family, n, status, shift`` (an array): the estimate without each family. Its sums are taken off the totals, so
    no fold is read again; what rounding leaves of a Gram that one family carries alone does not count as rank."""
    k = len(columns)
    own = normal_sums(terms.filter("role = 'FIT'"), [*keys, family], columns, target)
    total = add_up(own, keys, k).select(*keys, F.col("n").alias("_n"), F.col("gram").alias("_gram"), F.col("rhs").alias("_rhs"), F.col("rr").alias("_rr"))
    d = own.join(total, keys)
    trace = sum((_at("_gram", i * (k + 1)) for i in range(k)), F.lit(0.0))
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    d = d.select(*keys, family, (F.col("_n") - F.col("n")).alias("n"), less("_gram", "gram").alias("gram"), less("_rhs", "rhs").alias("rhs"), (trace * NOISE).alias("_floor"))
    d = with_solution(with_factor(d, F.col("_floor")), k, "_x")
    status = F.when(F.col("n") == 0, "REFUSED_NO_FIT_TERMS").when(F.col("rank") == k, "VALID").otherwise("REFUSED_RANK_DEFICIENT")
    shift = F.when(status == "VALID", F.transform("_x", lambda v: -v))
    return d.select(*keys, family, "n", status.alias("status"), shift.alias("shift"))


def shift_ranges(cases: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per parameter: lowest and highest shift over the valid folds, half the range of the ratio, and completeness."""
    rows = per_parameter(cases, "shift", columns, [*keys, "status"])
    g = rows.groupBy(*keys, "parameter").agg(F.count(F.lit(1)).alias("n_families"), F.sum((F.col("status") == "VALID").cast("int")).alias("n_valid"),
                                             F.min("shift").alias("low"), F.max("shift").alias("high"))
    return g.withColumn("half_range", 0.5 * (F.exp("high") - F.exp("low"))).withColumn("complete", (F.col("n_valid") == F.col("n_families")) & (F.col("n_valid") > 0))


# ------------------------------------------------------------------------------------------------ fits in a box
def box_minimum(g: np.ndarray, b: np.ndarray, low: float, high: float) -> np.ndarray:
    """Minimum of x'Gx / 2 - b'x over low <= x <= high for a stack of positive definite G: active sets, all at once.

    Each round solves the free variables of every open problem and goes as far as the box allows. A problem that arrives lets
    go of its first bound with a wrong multiplier, or is done; the objective never rises, so no set of bounds comes twice."""
    n, k = b.shape
    x = np.full((n, k), min(max(0.0, low), high))
    side = np.where(x <= low, -1, np.where(x >= high, 1, 0))
    tol = 1e-12 * (np.abs(b).max(axis=1) + np.abs(g).max(axis=(1, 2)) * max(abs(low), abs(high)))
    todo = np.arange(n)
    for _ in range(64 * (k + 1) + 3 ** min(k, 12)):
        if not len(todo):
            return x
        a, y, s = g[todo], x[todo], side[todo]
        free = s == 0
        m = np.where(free[:, :, None] & free[:, None, :], a, 0.0)
        m[:, np.arange(k), np.arange(k)] += ~free
        right = np.where(free, b[todo] - (a @ np.where(free, 0.0, y)[:, :, None])[:, :, 0], y)
        step = np.where(free, np.linalg.solve(m, right[:, :, None])[:, :, 0] - y, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(step > 0, (high - y) / step, np.where(step < 0, (low - y) / step, np.inf))
        hit, row = room.argmin(axis=1), np.arange(len(todo))
        blocked = room[row, hit] < 1
        y = y + np.minimum(room[row, hit], 1.0)[:, None] * step
        sign = np.where(step[row, hit] > 0, 1, -1)
        s[row[blocked], hit[blocked]] = sign[blocked]
        y = np.where(s < 0, low, np.where(s > 0, high, np.clip(y, low, high)))
        grad = (a @ y[:, :, None])[:, :, 0] - b[todo]
        wrong = ((s < 0) & (grad < -tol[todo, None])) | ((s > 0) & (grad > tol[todo, None]))
        release = ~blocked & wrong.any(axis=1)
        s[row[release], wrong.argmax(axis=1)[release]] = 0
        x[todo], side[todo] = y, s
        todo = todo[blocked | release]
    raise ArithmeticError("the active sets did not settle")


_BOXED = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("x", _DOUBLES)])


@F.pandas_udf(_BOXED)
def _boxed(gram: pd.Series, rhs: pd.Series, low: pd.Series, high: pd.Series, rcond: pd.Series) -> pd.DataFrame:
    out: list = [(0, None)] * len(gram)
    for k, at, m in _stacks(gram):
        rank = _ranks(m, np.zeros(len(at)), float(rcond.iat[0])) if len(at) else np.empty(0, int)
        for r, v in zip(at, rank):
            out[r] = (int(v), None)
        full = rank == k
        if full.any():
            b = np.stack([np.asarray(rhs.iat[r], float) for r in at[full]])
            for r, x in zip(at[full], box_minimum(m[full], b, float(low.iat[0]), float(high.iat[0]))):
                out[r] = (k, x.tolist())
    return pd.DataFrame(out, columns=[f.name for f in _BOXED])


def boxed_fit(terms: DataFrame, keys: list[str], columns: list[str], low: float = math.log(BOUND_FACTORS[0]), high: float = math.log(BOUND_FACTORS[1])) -> DataFrame:
    """Bounded least squares of ln(f_exp / f0) on any number of sensitivities: ``keys, n_terms, rank, status, x`` (an array).

    Rank is judged first; a design without full rank is refused. Terms without positive frequencies are left out."""
    ratio = F.when((F.col("f_exp") > 0) & (F.col("f0") > 0), F.log(F.col("f_exp") / F.col("f0")))
    sums = normal_sums(terms.select(*keys, *columns, ratio.alias("_target")), keys, columns, "_target")
    d = sums.withColumn("_b", _boxed("gram", "rhs", F.lit(float(low)), F.lit(float(high)), F.lit(RCOND)))
    status = F.when(F.col("_b.x").isNotNull(), "FITTED").otherwise("REFUSED_RANK_DEFICIENT")
    return d.select(*keys, F.col("n").alias("n_terms"), "_b.rank", status.alias("status"), "_b.x")


def boxed_parameters(fits: DataFrame, keys: list[str], columns: list[str], low: float = math.log(BOUND_FACTORS[0]), high: float = math.log(BOUND_FACTORS[1])) -> DataFrame:
    """Per parameter of `boxed_fit`: ratio, whether it lies at a bound and whether beyond the linear range."""
    d = per_parameter(fits, "x", columns, [*keys, "status"])
    bound = (F.abs(F.col("x") - low) <= 1e-9) | (F.abs(F.col("x") - high) <= 1e-9)
    return (d.withColumn("ratio", F.exp("x")).withColumn("at_bound", F.coalesce(bound, F.lit(False)))
            .withColumn("beyond_range", F.coalesce(F.abs("x") > math.log(1 + LINEAR_RANGE), F.lit(False))))


def boxed_residuals(terms: DataFrame, fits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Frequency errors in percent before and after the fit; NULL afterwards where the fit was refused."""
    d = terms.join(fits.select(*keys, "x"), keys)
    model = F.col("f0") * F.exp(sum((F.col(c) * _at("x", i) for i, c in enumerate(columns)), F.lit(0.0)))
    return d.withColumn("f_fit", model).withColumn("error_before", 100 * (F.col("f0") / F.col("f_exp") - 1)).withColumn("error_after", 100 * (F.col("f_fit") / F.col("f_exp") - 1))
