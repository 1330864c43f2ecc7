"""Group statistics: Spark reduces values to sufficient statistics, and tests follow from those few numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tests_math as M
from ..params import GROUP_ALPHA, GROUP_MIN_N

RESULT = "panel string, measure string, test string, comparison string, statistic double, df double, p double, letters string"


def moments(values: DataFrame, value: str, group: str = "grp") -> DataFrame:
    """``grp, n, mean, var`` of the finite values."""
    ok = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return ok.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def _ranged(values: DataFrame, column: str, buckets: int) -> DataFrame:
    """``values`` with the range ``b`` of ``column`` that each row is in, by explicit bounds, so that every branch of a plan
    and every repeated task agrees on it."""
    edges = sorted(set(values.approxQuantile(column, [k / buckets for k in range(1, buckets)], 0.005)))
    bounds = F.array(*[F.lit(x) for x in edges]).cast("array<double>")
    return values.withColumn("b", F.size(F.filter(bounds, lambda x: x < F.col(column))))


def _by_range(numbers: dict[int, float], none: float = 0) -> Column:
    out = F.lit(none)
    for k, n in sorted(numbers.items()):
        out = F.when(F.col("b") == k, F.lit(n)).otherwise(out)
    return out


def ranks(values: DataFrame, value: str, group: str = "grp", buckets: int = 64) -> DataFrame:
    """``grp, n, rank_sum`` and, over all, ``ties``: average ranks without a global sort in one task.

    Equal values are counted first; ranges of values are summed apart, and each starts from the sum of those before it.
    """
    ok = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(group).alias("grp"), F.col(value).cast("double").alias("v"))
    counted = _ranged(ok.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "v", buckets)
    first, done = {}, 0
    for r in counted.groupBy("b").agg(F.sum("c").alias("s")).orderBy("b").collect():
        first[r["b"]], done = done, done + r["s"]
    own = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    rank = counted.select("v", "c", (_by_range(first) + F.coalesce(F.sum("c").over(own), F.lit(0)) + (F.col("c") + 1) / 2.0).alias("r"))
    joined = ok.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("k")).join(rank, "v")
    return joined.groupBy("grp").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("r")).alias("rank_sum"), F.sum(F.col("k") * (F.col("c") * F.col("c") - 1)).alias("ties"))


def compare(values: DataFrame, value: str, family: str = "welch", group: str = "grp", panel: str = "", measure: str = "") -> DataFrame:
    """Rows of RESULT for groups of three values or more: Welch or rank test, and pairs where it is significant."""
    spark, rows = values.sparkSession, []
    if family == "welch":
        m = [r for r in moments(values, value, group).orderBy(group).collect() if r["n"] >= GROUP_MIN_N and r["var"] and r["var"] > 0]
        names = [str(r[group]) for r in m]
        n, mean, var = (np.array([float(r[c]) for r in m]) for c in ("n", "mean", "var"))
        if len(m) == 2:
            t, df, p = M.welch_t(n[0], mean[0], var[0], n[1], mean[1], var[1])
            rows.append((panel, measure, "Welch t", " vs ".join(names), t, df, p, None))
        elif len(m) > 2:
            f, _, d2, p = M.welch_anova(n, mean, var)
            rows.append((panel, measure, "Welch ANOVA", "all", f, d2, p, None))
            if p < GROUP_ALPHA:
                pairs = M.games_howell(n, mean, var)
                marks = M.letters(len(m), {k for k, q in pairs.items() if q < GROUP_ALPHA})
                rows += [(panel, measure, "Games-Howell", f"{names[i]} vs {names[j]}", None, None, q, None) for (i, j), q in pairs.items()]
                rows += [(panel, measure, "letters", g, None, None, None, x) for g, x in zip(names, marks)]
    else:
        large = values.join(moments(values, value, group).where(F.col("n") >= GROUP_MIN_N).select(group), group)
        m = ranks(large, value, group).orderBy("grp").collect()
        names, n, s = [str(r["grp"]) for r in m], np.array([float(r["n"]) for r in m]), np.array([float(r["rank_sum"]) for r in m])
        total = n.sum()
        ties = 1 - sum(r["ties"] for r in m) / (total**3 - total) if total > 1 else 0.0
        if len(m) == 2 and ties > 0:
            u = s[0] - n[0] * (n[0] + 1) / 2
            sd = math.sqrt(n[0] * n[1] * (total + 1) / 12 * ties)
            z = max(0.0, abs(u - n[0] * n[1] / 2) - 0.5) / sd
            rows.append((panel, measure, "Mann-Whitney", " vs ".join(names), u, None, M.normal_p(z), None))
        elif len(m) > 2 and ties > 0:
            h = (12 / (total * (total + 1)) * (s * s / n).sum() - 3 * (total + 1)) / ties
            p = M.chi2_p(h, len(m) - 1)
            rows.append((panel, measure, "Kruskal-Wallis", "all", h, len(m) - 1.0, p, None))
            if p < GROUP_ALPHA:
                pairs = [(i, j) for i in range(len(m)) for j in range(i + 1, len(m))]
                zs = [abs(s[i] / n[i] - s[j] / n[j]) / math.sqrt(total * (total + 1) / 12 * ties * (1 / n[i] + 1 / n[j])) for i, j in pairs]
                adjusted = M.holm([M.normal_p(z) for z in zs])
                rows += [(panel, measure, "Dunn-Holm", f"{names[i]} vs {names[j]}", z, None, q, None) for (i, j), z, q in zip(pairs, zs, adjusted)]
                rows += [(panel, measure, "letters", g, None, None, None, x) for g, x in zip(names, M.letters(len(m), {k for k, q in zip(pairs, adjusted) if q < GROUP_ALPHA}))]
    return spark.createDataFrame([tuple(None if isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, np.floating) else x for x in r) for r in rows], RESULT)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """By a table below 256, by Stirling's series above."""
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256)))))
    x = np.maximum(n, 1).astype(float)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 256, small[np.minimum(n, 255).astype(int)], series)


def tables_of_margins(table: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """(draws, rows, columns): tables with the margins of ``table`` as independence would deal them, cell by cell."""
    r, c = table.shape
    left = np.tile(table.sum(axis=0), (draws, 1))
    out = np.zeros((draws, r, c), np.int64)
    for i, total in enumerate(table.sum(axis=1)[:-1]):
        todo = np.full(draws, total)
        for j in range(c - 1):
            out[:, i, j] = rng.hypergeometric(left[:, j], left[:, j + 1 :].sum(axis=1), todo)
            todo = todo - out[:, i, j]
        out[:, i, -1] = todo
        left = left - out[:, i]
    out[:, -1] = left
    return out


#: Tables of a Monte-Carlo test, those drawn at once, and its seed.
TABLES, DRAWN, TABLE_SEED = 9999, 1024, 42


def freeman_halton(spark, table, tables: int = TABLES, seed: int = TABLE_SEED) -> float:
    """p of Fisher's exact test of a table of any size: the share of tables of its margins that are no more likely than it.

    Tables are drawn in tasks, each from a seed of its own, and Spark counts; the observed table counts as one of them.
    """
    table = np.asarray(table, np.int64)
    table = table[table.sum(axis=1) > 0][:, table.sum(axis=0) > 0]
    if min(table.shape) < 2:
        return 1.0
    seen = _log_factorial(table).sum()

    def count(batches):
        for batch in batches:
            rows = []
            for k in batch["id"]:
                drawn = tables_of_margins(table, min(DRAWN, tables - k * DRAWN), np.random.default_rng([seed, int(k)]))
                rows.append(int((_log_factorial(drawn).sum(axis=(1, 2)) >= seen - 1e-7).sum()))
            yield pd.DataFrame({"n": rows})

    chunks = -(-tables // DRAWN)
    n = spark.range(0, chunks, 1, chunks).mapInPandas(count, "n bigint").agg(F.sum("n")).first()[0]
    return (n + 1) / (tables + 1)


def compare_shares(calls: DataFrame, flag: str = "rhythmic", group: str = "grp", tables: int = TABLES, seed: int = TABLE_SEED) -> DataFrame:
    """Shares of a flag: Fisher's exact test for two groups; for more, chi-square, or the Monte-Carlo exact test where a group's
    expected count is below 5. Pairs by Fisher-Holm, and letters for four groups or more, where the whole differs.

    Groups of fewer than three go; nothing is told of one group, or where all subjects are alike.
    """
    spark = calls.sparkSession
    m = calls.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("int")).alias("k")).where(F.col("n") >= GROUP_MIN_N).orderBy(group).collect()
    names, rows = [str(r[group]) for r in m], []
    test = lambda a, b: M.fisher_exact(a["k"], a["n"] - a["k"], b["k"], b["n"] - b["k"])
    n, k = np.array([r["n"] for r in m], float), np.array([r["k"] or 0 for r in m], float)
    if len(m) < 2 or not 0 < k.sum() < n.sum():
        return spark.createDataFrame([], RESULT)
    if len(m) == 2:
        return spark.createDataFrame([("", flag, "Fisher", " vs ".join(names), None, None, test(*m), None)], RESULT)
    share = k.sum() / n.sum()
    if min((n * share).min(), (n * (1 - share)).min()) < 5:
        p = freeman_halton(spark, np.stack([k, n - k], axis=1), tables, seed)
        rows.append(("", flag, "Fisher-Freeman-Halton (Monte Carlo)", "all", None, None, p, None))
    else:
        x = float(((k - n * share) ** 2 / (n * share * (1 - share))).sum())
        p = M.chi2_p(x, len(m) - 1)
        rows.append(("", flag, "chi-square", "all", x, len(m) - 1.0, p, None))
    if p < GROUP_ALPHA:
        pairs = [(i, j) for i in range(len(m)) for j in range(i + 1, len(m))]
        adjusted = M.holm([test(m[i], m[j]) for i, j in pairs])
        rows += [("", flag, "Fisher-Holm", f"{names[i]} vs {names[j]}", None, None, q, None) for (i, j), q in zip(pairs, adjusted)]
        if len(m) >= 4:
            differ = {pair for pair, q in zip(pairs, adjusted) if q < GROUP_ALPHA}
            rows += [("", flag, "letters", g, None, None, None, x) for g, x in zip(names, M.letters(len(m), differ))]
    return spark.createDataFrame(rows, RESULT)


def compare_to_zero(values: DataFrame, value: str, by: str = "grp") -> DataFrame:
    """``by, n, mean, t, df``: one-sample t statistic; its tail is ``tests_math.t_p``."""
    rows = moments(values, value, by)
    return rows.select(by, "n", "mean", F.when((F.col("n") >= GROUP_MIN_N) & (F.col("var") > 0), F.col("mean") / F.sqrt(F.col("var") / F.col("n"))).alias("t"), (F.col("n") - 1).alias("df"))


def compare_paired(before: DataFrame, after: DataFrame, value: str, by: str = "grp") -> DataFrame:
    """The same on the differences of subjects that have both values."""
    a = before.where(F.col(value).isNotNull()).select("id", by, F.col(value).alias("__a"))
    b = after.where(F.col(value).isNotNull()).select("id", F.col(value).alias("__b"))
    return compare_to_zero(a.join(b, "id").select(by, (F.col("__b") - F.col("__a")).alias("difference")), "difference", by)


def holm_adjusted(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """``p_holm``: step-down adjusted p values within ``by``."""
    if not by:
        return _holm_over_all(tests, p)
    keys = by
    order = Window.partitionBy(*keys).orderBy(p)
    m, rank = F.count(p).over(Window.partitionBy(*keys)), F.row_number().over(order)
    rows = tests.withColumn("__x", F.least(F.lit(1.0), F.col(p) * (m - rank + 1)))
    return rows.withColumn("p_holm", F.max("__x").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__x")


def _holm_over_all(tests: DataFrame, p: str, buckets: int = 64) -> DataFrame:
    """The same over all rows without one sorted partition: equal values are counted, ranges of them ranked apart, and
    each range starts from the count and the maximum of those before it. A null stays null and counts for nothing."""
    counted = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__v")).agg(F.count(F.lit(1)).alias("c"))
    ranged = _ranged(counted, "__v", buckets)
    first, done = {}, 0
    for r in ranged.groupBy("b").agg(F.sum("c").alias("s")).orderBy("b").collect():
        first[r["b"]], done = done, done + r["s"]
    own = Window.partitionBy("b").orderBy("__v")
    before = F.coalesce(F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = ranged.withColumn("x", F.least(F.lit(1.0), F.col("__v") * (F.lit(done) - _by_range(first) - before)))
    least, top = {}, 0.0
    for r in x.groupBy("b").agg(F.max("x").alias("m")).orderBy("b").collect():
        least[r["b"]], top = top, max(top, r["m"])
    adjusted = x.select("__v", F.greatest(_by_range(least, 0.0), F.max("x").over(own.rowsBetween(Window.unboundedPreceding, 0))).alias("p_holm"))
    return tests.join(adjusted, tests[p] == adjusted["__v"], "left").select(*[tests[c] for c in tests.columns], "p_holm")


def versus_control(values: DataFrame, value: str, family: str = "welch", group: str = "grp", control: str = "control_grp", by: list[str] | None = None) -> DataFrame:
    """``group, control, by …, n, control_n, statistic, p, p_holm``: each group against its own control, Holm over ``by``.

    Groups are few; their moments come to the driver for the tails, and go back as rows.
    """
    keys = [group, *(by or [])]
    ok = values.where(F.col(value).isNotNull())
    m = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    pairs = ok.where(F.col(control).isNotNull()).select(*keys, control).distinct()
    other = m.select(F.col(group).alias(control), *(by or []), F.col("n").alias("cn"), F.col("mean").alias("cmean"), F.col("var").alias("cvar"))
    rows = pairs.join(m, keys).join(other, [control, *(by or [])]).where(f"n >= {GROUP_MIN_N} AND cn >= {GROUP_MIN_N} AND var + cvar > 0").collect()
    out = []
    for r in rows:
        t, _, p = M.welch_t(r["n"], r["mean"], r["var"], r["cn"], r["cmean"], r["cvar"])
        out.append((*[str(r[k]) for k in keys], str(r[control]), r["n"], r["cn"], t, p))
    schema = ", ".join([f"{k} string" for k in [*keys, control]] + ["n bigint", "control_n bigint", "statistic double", "p double"])
    return holm_adjusted(values.sparkSession.createDataFrame(out, schema), "p", [group])


def stats_sheet(*results: DataFrame) -> DataFrame:
    """All results as one long sheet, in the order given."""
    out = None
    for k, r in enumerate(results):
        part = r.withColumn("ord", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
