"""Statistics on small observation tables, and resampling whose draws are hashes, so that any engine repeats them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.md5 import Numbered
from ..functions.special import chi2_tail, f_p, t_p


def draw(*parts: Column | str) -> Column:
    """32 bits of the MD5 of the parts joined by |."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def anova(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, f, p, n_groups, n): one-way, over groups of two values or more; at least two of them."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n >= 2")
    by_all = g.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    between = F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")
    a, b = (F.col("n_groups") - 1).cast("double"), (F.col("n") - F.col("n_groups")).cast("double")
    f = F.when((F.col("within") > 1e-12) & (b > 0), (between / a) / (F.col("within") / b))
    return by_all.where("n_groups >= 2").select(*by, F.round(f, 6).alias("f"), F.round(f_p(f, a, b), 6).alias("p"), "n_groups", "n")


def kendall_tau(df: DataFrame, by: list[str], item: str, x: str, y: str) -> DataFrame:
    """(by, tau, n_pairs): tau-b by a self-join of the group's items; null where one side is constant."""
    a = df.select(*by, F.col(item).alias("i"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = df.select(*by, F.col(item).alias("j"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    s, t = F.signum(F.round(F.col("x1") - F.col("x2"), 9)), F.signum(F.round(F.col("y1") - F.col("y2"), 9))
    pairs = (a.join(b, by) if by else a.crossJoin(b)).where("i < j").select(*by, s.alias("s"), t.alias("t"))
    whole = F.sqrt(F.count_if(F.col("s") != 0).cast("double") * F.count_if(F.col("t") != 0))
    return pairs.groupBy(*by).agg(F.round(F.when(whole > 0, F.sum(F.col("s") * F.col("t")) / whole), 6).alias("tau"), F.count(F.lit(1)).alias("n_pairs"))


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """(by, rho, n): correlation of average ranks, with ``least`` rows or more."""
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rx", rank(x)).withColumn("ry", rank(y))
    return rows.groupBy(*by).agg(F.round(F.covar_pop("rx", "ry") / F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0)), 6).alias("rho"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def one_sample_t(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, t, p, n) against 0."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.when(F.col("sd") > 1e-12, F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return g.select(*by, F.round("mean", 6).alias("mean"), F.round(t, 6).alias("t"), F.round(t_p(t, (F.col("n") - 1).cast("double")), 6).alias("p"), "n")


def cohens_d(df: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """(by, d): pooled, between the rows with ``side`` and those without; null with fewer than two on either."""
    x, y = F.when(F.col(side), F.col(value)), F.when(~F.col(side), F.col(value))
    g = df.groupBy(*by).agg(F.count(x).alias("n1"), F.count(y).alias("n2"), F.avg(x).alias("m1"), F.avg(y).alias("m2"), F.var_samp(x).alias("v1"), F.var_samp(y).alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return g.select(*by, F.round(F.when((F.col("n1") >= 2) & (F.col("n2") >= 2) & (pooled > 1e-12), (F.col("m1") - F.col("m2")) / pooled), 6).alias("d"))


def packed(units: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row for each group, with its units in ``order`` as an array."""
    return units.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, *columns])))).alias("__units")).where(F.size("__units") > 0)


def resampled(units: DataFrame, by: list[str], order: list[str], replicates: int, seed: int = 7) -> DataFrame:
    """Each replicate's draws with replacement of the units of each group: (rep, slot, unit columns).

    A draw is a hash of seed, replicate, slot and the group's name; units are numbered in ``order``. Every draw reads its unit from the
    group's array in its own row: a join with exploded slots would be taken for small and broadcast. Aggregate them before a join."""
    columns = [c for c in units.columns if c not in by]
    each = packed(units, by, order, columns).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    each = each.repartition(4 * units.sparkSession.sparkContext.defaultParallelism, *by, "rep")
    slots = each.withColumn("__n", F.size("__units").cast("bigint")).withColumn("slot", F.explode(F.expr("sequence(0L, __n - 1)")))
    drawn = slots.withColumn("__k", (draw(F.lit(seed), "rep", "slot", *by) % F.col("__n")).cast("int"))
    return drawn.select(*by, "rep", "slot", *[F.get(F.col("__units")[c], F.col("__k")).alias(c) for c in columns])


def resampled_sums(units: DataFrame, by: list[str], order: list[str], columns: list[str], replicates: int, terms: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], names: list[str], seed: int = 7, chunk: int = 125) -> DataFrame:
    """(by, rep, n, names): sums over each replicate's draws, as :func:`resampled` makes them, of ``terms`` of the columns (a number for each unit and name).

    The kernel's rows are a group's units with ``chunk`` replicates; it draws by NumPy, and no draw leaves it."""
    each = packed(units, by, order, columns).select(*by, *[F.col("__units")[c].alias(f"__{k}") for k, c in enumerate(columns)])
    each = each.withColumn("__first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(chunk))))
    each = each.repartition(4 * units.sparkSession.sparkContext.defaultParallelism, *by, "__first")
    types = dict(units.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = [batch[c][row].as_py() for c in by]
                first = batch["__first"][row].as_py()
                reps = range(first, min(first + chunk, replicates))
                given = terms({c: batch[f"__{k}"][row].values.to_numpy(zero_copy_only=False) for k, c in enumerate(columns)})
                value = np.stack([np.asarray(given[x], np.float64) for x in names], axis=1)
                n, after = len(value), "".join(f"|{x}" for x in own if x is not None)
                numbered = Numbered(n)
                sums = np.stack([np.bincount(numbered.draws(f"{seed}|{rep}|", after) % np.uint32(n), minlength=n) @ value for rep in reps])
                out = {c: pa.array([x] * len(reps), batch.schema.field(c).type) for c, x in zip(by, own)}
                yield pa.RecordBatch.from_pydict({**out, "rep": pa.array(reps, pa.int32()), "n": pa.array([n] * len(reps), pa.int64()), **{x: sums[:, k] for k, x in enumerate(names)}})

    return each.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in by), "rep int, n long", *(f"{x} double" for x in names)]))


def interval(df: DataFrame, by: list[str], value: str, replicates: int) -> DataFrame:
    """(by, lo, mid, hi): order statistics of the replicates at 2.5, 50 and 97.5 percent."""
    xs = F.array_sort(F.collect_list(value))
    at = lambda q: F.get(xs, F.least(F.floor(F.size(xs) * F.lit(q)).cast("int"), F.size(xs) - 1))
    return df.groupBy(*by).agg(at(0.025).alias("lo"), at(0.5).alias("mid"), at(0.975).alias("hi"), F.count(F.lit(1)).alias("n_replicates"))


def sign_test(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, wins, losses, ties, p): two-sided exact binomial, 1 without wins and losses.

    The tail is summed in logarithms of factorials, which are a column of their own for each k."""
    g = df.groupBy(*by).agg(F.count_if(F.col(a) > F.col(b)).alias("wins"), F.count_if(F.col(a) < F.col(b)).alias("losses"), F.count_if(F.col(a) == F.col(b)).alias("ties"))
    n, k = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    # C(n, i) / 2^n from one term to the next
    step = lambda s, i: F.struct((s["term"] + F.log((n - i + 1) / i)).alias("term"), (s["sum"] + F.exp(s["term"] + F.log((n - i + 1) / i))).alias("sum"))
    first = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1))), first, step, lambda s: s["sum"])).otherwise(F.exp(-n * F.log(F.lit(2.0))))
    return g.select(*by, "wins", "losses", "ties", F.round(F.when(n == 0, 1.0).otherwise(F.least(2 * tail, F.lit(1.0))), 6).alias("p"))


def sign_flip(units: DataFrame, unit: str, delta: str, flips: int, seed: int = 7) -> DataFrame:
    """(observed, n_ge, p): one-sided share of sign assignments whose mean reaches the observed one."""
    rows = units.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(flips - 1))))
    signed = rows.groupBy("rep").agg(F.avg(F.when(draw(F.lit(seed), "rep", unit) % 2 == 0, F.col(delta)).otherwise(-F.col(delta))).alias("m"))
    seen = units.agg(F.avg(delta).alias("observed"))
    both = signed.crossJoin(F.broadcast(seen))
    return both.groupBy("observed").agg(F.count_if(F.col("m") >= F.col("observed") - 1e-12).alias("n_ge"), F.count(F.lit(1)).alias("n")).select(F.round("observed", 6).alias("observed"), "n_ge", F.round((F.col("n_ge") + 1) / (F.col("n") + 1), 6).alias("p"))


def least_squares(df: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """(by, n, sums of products of the columns and 1): all that normal equations need, from one aggregation."""
    names = ["1", *xs, y]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    sums = [F.sum(value(a) * value(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return df.dropna(subset=[y, *xs]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def ols(df: DataFrame, by: list[str], y: str, xs: list[str], least: int = 10) -> DataFrame:
    """(by, term, coefficient, r2): of groups of ``least`` rows or more, by normal equations (least norm where singular)."""
    k = len(xs) + 2

    def run(pdf):
        out = []
        for _, r in pdf.iterrows():
            m = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            beta = np.linalg.pinv(m[:-1, :-1], rcond=1e-10) @ m[:-1, -1]
            total = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
            left = m[-1, -1] - beta @ m[:-1, -1]
            r2 = 1 - left / total if total > 1e-12 else None
            out += [{**{c: r[c] for c in by}, "term": t, "coefficient": round(float(b), 6), "r2": r2 if r2 is None else round(float(r2), 6)} for t, b in zip(["intercept", *xs], beta)]
        return pd.DataFrame(out, columns=[*by, "term", "coefficient", "r2"])

    import pandas as pd

    sums = least_squares(df, by, y, xs).where(F.col("n") >= least)
    types = dict(sums.dtypes)
    return sums.mapInPandas(lambda parts: (run(p) for p in parts if len(p)), ", ".join([*(f"{c} {types[c]}" for c in by), "term string, coefficient double, r2 double"]))


def irls(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """(coefficients, log-likelihood) of an unpenalised logistic regression, of least norm where columns depend on each other."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        move = np.linalg.pinv(x.T @ (x * w[:, None]), rcond=1e-10) @ (x.T @ (y - p))
        beta += move
        if np.abs(move).max(initial=0) < 1e-10:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-12, 1 - 1e-12)
    return beta, float((y * np.log(p) + (1 - y) * np.log1p(-p)).sum())


def nested_logistic(df: DataFrame, y: str, benchmark: str, model: str, xs: list[str]) -> DataFrame:
    """(model, n, n_parameters, log_likelihood, mcfadden, aic, chi2, p): benchmarks alone, with models, with the measures too.

    The observation table (tasks times models) is one group of one kernel; columns are standardised."""

    def run(pdf):
        own = pdf.dropna(subset=[y, *xs])
        if len(own) < 10:
            return pd.DataFrame([], columns=["model", "n", "n_parameters", "log_likelihood", "mcfadden", "aic", "chi2", "p"])
        target = own[y].to_numpy(float)
        dummies = lambda c: (own[c].to_numpy()[:, None] == np.array(sorted(own[c].unique())[1:], object)[None, :]).astype(float)
        z = own[xs].to_numpy(float)
        z = (z - z.mean(axis=0)) / np.where(z.std(axis=0) > 1e-8, z.std(axis=0), 1)
        one = np.ones((len(own), 1))
        designs = {"benchmarks": np.hstack([one, dummies(benchmark)])}
        designs["models"] = np.hstack([designs["benchmarks"], dummies(model)])
        designs["measures"] = np.hstack([designs["models"], z])
        null = irls(one, target)[1]
        out, before = [], None
        for name, x in designs.items():
            ll = irls(x, target)[1]
            k = x.shape[1]
            chi2 = 2 * (ll - before[0]) if before else None
            p = chi2_tail(max(chi2, 0), k - before[1]) if before and k > before[1] else None
            out.append({"model": name, "n": len(own), "n_parameters": k, "log_likelihood": round(ll, 4), "mcfadden": round(1 - ll / null, 4) if null else None, "aic": round(2 * k - 2 * ll, 4), "chi2": chi2 and round(chi2, 4), "p": p if p is None else round(p, 4)})
            before = (ll, k)
        return pd.DataFrame(out)

    import pandas as pd

    rows = df.select(y, benchmark, model, *xs)
    return rows.groupBy(F.lit(0).alias("__all")).applyInPandas(lambda pdf: run(pdf), "model string, n long, n_parameters long, log_likelihood double, mcfadden double, aic double, chi2 double, p double")
