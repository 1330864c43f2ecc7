"""Hidden sleep states: constrained hidden Markov models with zero-inflated Poisson, Gaussian or two-symbol emissions.

A fit alternates: every task runs forward-backward over its own subjects, all restarts at once and runs of the
commonest value as powers of one matrix, and sends sums, Spark adds them up by group and restart, and the few parameters follow from those sums on the driver. No group's readings meet in one task; the best
restart of each group is an aggregate. Models of single subjects are fitted where the subject is. Decoding is per subject.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import Hmm
from . import runs


def observations(readings: DataFrame, kind: str = "counts", value: str = "activity") -> DataFrame:
    """``id, t, x``: counts as whole numbers, "binary" movement, or "share" of a day's activity in percent; missing rows go."""
    rows = readings.where(F.col(value).isNotNull())
    if kind == "binary":
        x = (F.col(value) > 0).cast("double")
    elif kind == "share":
        total = F.sum(value).over(Window.partitionBy("id", S.day_index("t")))
        x = F.when(total > 0, F.col(value) / total * 100.0).otherwise(0.0)
    else:
        x = F.rint(F.greatest(F.lit(0.0), F.col(value).cast("double")))
    return rows.select("id", "t", x.alias("x"))


def scoped(seen: DataFrame, groups: DataFrame, scope: str, samples_per_day: int = 1440) -> tuple[DataFrame, DataFrame]:
    """Observations and their fitting groups: one model for each "group", for all ("pooled"), for each "subject", or
    for each "subject_day" of 60 valid rows or more (ids are then id and day)."""
    if scope == "group":
        return seen, groups.select("id", "grp")
    if scope == "pooled":
        return seen, groups.select("id", F.lit("all").alias("grp"))
    if scope == "subject":
        return seen, groups.select("id", F.col("id").cast("string").alias("grp"))
    if scope != "subject_day":
        raise ValueError(f"unknown scope {scope}")
    label = F.concat_ws("/", F.col("id").cast("string"), F.floor(F.col("t") / samples_per_day).cast("string"))
    rows = seen.join(groups.select("id"), "id").withColumn("id", label)
    days = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 60").select("id", F.col("id").alias("grp"))
    return rows, days


def _allowed(n: int) -> np.ndarray:
    """States reach their neighbours."""
    return np.abs(np.subtract.outer(np.arange(n), np.arange(n))) <= 1


def _constrained(a: np.ndarray, settings: Hmm) -> np.ndarray:
    if settings.constraint != "none":
        a = np.where(_allowed(len(a)), a, settings.soft_floor if settings.constraint == "soft" else 0.0)
    return a / a.sum(axis=1, keepdims=True)


def log_emission(x: np.ndarray, p: dict, emission: str) -> np.ndarray:
    """(samples, states)."""
    v = x[:, None]
    if emission == "zip":
        rate, zero = np.asarray(p["rate"]), np.asarray(p["zero"])
        logs = np.array([math.lgamma(k + 1) for k in range(int(x.max(initial=0)) + 1)])[x.astype(int)][:, None]
        poisson = np.log1p(-zero) + v * np.log(rate) - rate - logs
        return np.where(v == 0, np.log(zero + (1 - zero) * np.exp(-rate)), poisson)
    if emission == "gaussian":
        mean, var = np.asarray(p["mean"]), np.asarray(p["var"])
        return -0.5 * (np.log(2 * np.pi * var) + (v - mean) ** 2 / var)
    still = np.asarray(p["still"])
    return np.where(v > 0, np.log1p(-still), np.log(still))


def forward_backward(b: np.ndarray, start: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors, summed transitions and log-likelihood of one sequence, scaled."""
    n, k = b.shape
    top = b.max(axis=1)
    e = np.exp(b - top[:, None])
    alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    now = start * e[0]
    for t in range(n):
        if t:
            now = (now @ a) * e[t]
        scale[t] = now.sum()
        now = now / scale[t]
        alpha[t] = now
    for t in range(n - 2, -1, -1):
        beta[t] = a @ (e[t + 1] * beta[t + 1]) / scale[t + 1]
    moves = a * (alpha[:-1].T @ (e[1:] * beta[1:] / scale[1:, None])) if n > 1 else np.zeros((k, k))
    return alpha * beta, moves, float(np.log(scale).sum() + top.sum())


def viterbi(b: np.ndarray, start: np.ndarray, a: np.ndarray) -> np.ndarray:
    n, k = b.shape
    with np.errstate(divide="ignore"):
        la, now = np.log(a), np.log(start) + b[0]
    back = np.zeros((n, k), np.int8)
    for t in range(1, n):
        step = now[:, None] + la
        back[t] = step.argmax(axis=0)
        now = step.max(axis=0) + b[t]
    out = np.empty(n, np.int8)
    out[-1] = now.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def start_of(levels: np.ndarray, var: float, settings: Hmm, restart: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """First probabilities, transitions and emissions of a restart, from seed 42 + restart."""
    rng, k = np.random.default_rng(42 + restart), settings.n_states
    base = np.where(_allowed(k), 0.05, 0.01)
    np.fill_diagonal(base, 0.90)
    a = _constrained(np.array([rng.dirichlet(settings.concentration * r / r.sum()) for r in base]) + 1e-6, settings)
    start = np.where(np.arange(k) < k // 2, 2.0, 1.0)
    start /= start.sum()
    levels = np.maximum(levels * rng.uniform(0.8, 1.25, k), 1e-2)
    quiet = np.clip(np.linspace(0.95, 0.05, k) * rng.uniform(0.9, 1.05, k), 0.01, 0.99)
    return start, a, {"zip": {"rate": np.sort(levels), "zero": quiet}, "gaussian": {"mean": np.sort(levels) - levels.min(), "var": np.full(k, max(var, 1e-3))}, "categorical": {"still": quiet}}[settings.emission]


def sums_of(seq: np.ndarray, model: tuple, settings: Hmm) -> np.ndarray:
    """Log-likelihood, first posteriors, transitions, and for each state the sums of weights, x, x squared and zeros."""
    start, a, p = model
    g, moves, ll = forward_backward(log_emission(seq, p, settings.emission), start, a)
    return np.concatenate(([ll], g[0], moves.ravel(), g.sum(0), g.T @ seq, g.T @ seq**2, g.T @ (seq == 0)))


#: Samples of sequences that are worked on at once.
AT_ONCE = 1 << 19


class Pack:
    """Sequences side by side, the longest first, so that one step in time is one operation over all that reach it."""

    def __init__(self, seqs: list[np.ndarray]):
        size = np.array([len(s) for s in seqs])
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.x = np.zeros((int(self.size[0]), len(seqs)))
        for i, j in enumerate(self.order):
            self.x[: len(seqs[j]), i] = seqs[j]
        self.values, at = np.unique(self.x, return_inverse=True)
        self.at = at.reshape(self.x.shape)
        #: How many sequences reach each time.
        self.reach = np.searchsorted(-self.size, -np.arange(len(self.x)), side="left")


def packs(seqs: list[np.ndarray]):
    """The places of some sequences and their pack, of about AT_ONCE samples each."""
    places = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: -len(seqs[i]))
    while places:
        n = max(1, AT_ONCE // len(seqs[places[0]]))
        own, places = places[:n], places[n:]
        yield own, Pack([seqs[i] for i in own])


def posteriors(pack: Pack, model: tuple, settings: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``forward_backward`` of a pack: posteriors by time, sequence and state (zero past a sequence's end), transitions and log-likelihoods."""
    start, a, p = model
    logs = log_emission(pack.values, p, settings.emission)
    top = logs.max(axis=1)
    e = np.exp(logs - top[:, None])
    n, m = pack.x.shape
    alpha, scale = np.zeros((n, m, len(a))), np.ones((n, m))
    now = start * e[pack.at[0]]
    for t in range(n):
        own = pack.reach[t]
        if t:
            now = (now[:own] @ a) * e[pack.at[t, :own]]
        total = now.sum(axis=1)
        now = now / total[:, None]
        alpha[t, :own], scale[t, :own] = now, total
    beta, moves = np.ones((m, len(a))), np.zeros((len(a), len(a)))
    for t in range(n - 2, -1, -1):
        own = pack.reach[t + 1]
        ahead = e[pack.at[t + 1, :own]] * beta[:own] / scale[t + 1, :own, None]
        moves += alpha[t, :own].T @ ahead
        beta[:own] = ahead @ a.T
        alpha[t] *= beta
    inside = np.arange(n)[:, None] < pack.size
    return alpha, a * moves, (np.log(scale) + np.where(inside, top[pack.at], 0.0)).sum(axis=0)


def paths(pack: Pack, model: tuple, settings: Hmm) -> np.ndarray:
    """``viterbi`` of a pack, by time and sequence."""
    start, a, p = model
    logs = log_emission(pack.values, p, settings.emission)
    n, m = pack.x.shape
    with np.errstate(divide="ignore"):
        la, now = np.log(a), np.log(start) + logs[pack.at[0]]
    back, last = np.zeros((n, m, len(a)), np.int8), now.copy()
    for t in range(1, n):
        own = pack.reach[t]
        step = now[:own, :, None] + la
        back[t, :own] = step.argmax(axis=1)
        now = step.max(axis=1) + logs[pack.at[t, :own]]
        last[:own] = now
    out = np.zeros((n, m), np.int8)
    state = last.argmax(axis=1)
    for t in range(n - 1, -1, -1):
        if t + 1 < n:
            own = pack.reach[t + 1]
            state[:own] = back[t + 1, np.arange(own), state[:own]]
        out[t, : pack.reach[t]] = state[: pack.reach[t]]
    return out


#: Steps of sequences that are worked on at once, and models beside each other.
STEPS, BESIDE = 1 << 14, 50


class Strides:
    """Weighted sequences side by side in strides: a run of one value, the commonest, and the sample that ends it.

    Equal strides (length of the run, value after it) are one row of ``lengths`` and ``after``, so that a step of all
    models over all sequences is a look-up and a product. A sequence that ends in a run has a last stride without value.
    """

    def __init__(self, seqs: list[np.ndarray], weights: list[int], common: float):
        whole, w = np.concatenate(seqs), np.asarray(weights, float)
        size = np.array([len(s) for s in seqs])
        ends = np.cumsum(size)
        self.values, at = np.unique(np.append(whole, common), return_inverse=True)
        self.common, at = int(at[-1]), at[:-1]
        owner = np.repeat(np.arange(len(seqs)), size)
        first = np.zeros(len(whole), bool)
        first[ends - size] = True
        last = np.zeros(len(whole), bool)
        last[ends - 1] = True
        # The first sample of a sequence has no step before it; a stride ends with each later sample that is no run's.
        other = at != self.common
        stop = np.flatnonzero(~first & (other | last))
        before = np.concatenate(([-1], stop[:-1]))
        length = stop - np.maximum(before, (ends - size)[owner[stop]]) - other[stop]
        after = np.where(other[stop], at[stop], -1)
        keys, code = np.unique(length * (len(self.values) + 1) + after + 1, return_inverse=True)
        self.lengths, self.after = keys // (len(self.values) + 1), keys % (len(self.values) + 1) - 1
        strides = np.bincount(owner[stop], minlength=len(seqs))
        order = np.argsort(-strides, kind="stable")
        self.weights, self.first = w[order], at[(ends - size)[order]]
        #: How many sequences have each stride, the longest sequences first.
        self.reach = np.searchsorted(-strides[order], -np.arange(int(strides.max(initial=0))), side="left")
        starts = np.cumsum(strides) - strides
        self.codes = [code[starts[order[:n]] + i] for i, n in enumerate(self.reach.tolist())]

    def sums(self, models: list[tuple], settings: Hmm) -> np.ndarray:
        """``sums_of`` all sequences for each model, a row each."""
        return np.concatenate([self._sums(models[i : i + BESIDE], settings) for i in range(0, len(models), BESIDE)])

    def _sums(self, models: list[tuple], settings: Hmm) -> np.ndarray:
        k, r = settings.n_states, len(models)
        start = np.stack([m[0] for m in models], axis=-1)  # models are the last axis
        a = np.stack([m[1] for m in models], axis=-1)
        logs = np.stack([log_emission(self.values, m[2], settings.emission) for m in models], axis=-1)
        top = logs.max(axis=1)
        e = np.exp(logs - top[:, None])
        move = a * e[:, None]  # of each value
        # A run is a power of one matrix, kept in bounds by its largest eigenvalue.
        size = np.maximum(np.abs(np.linalg.eigvals(move[self.common].transpose(2, 0, 1))).max(axis=1), 1e-300)
        doubled, one = [move[self.common] / size], np.eye(k)[:, :, None].repeat(r, axis=2)
        lengths, of = np.unique(self.lengths, return_inverse=True)
        for _ in range(1, int(lengths.max(initial=0)).bit_length()):
            doubled.append(_times(doubled[-1], doubled[-1]))
        set_ = [np.flatnonzero(lengths >> j & 1) for j in range(len(doubled))]
        runs_, head, tail = np.repeat(one[None], len(lengths), axis=0), {}, {}
        low = runs_.copy()
        for j in reversed(range(len(doubled))):
            head[j] = runs_[set_[j]]
            runs_[set_[j]] = _times(head[j], doubled[j])
        for j in range(len(doubled)):
            tail[j] = low[set_[j]]
            low[set_[j]] = _times(doubled[j], tail[j])
        ended, long = self.after >= 0, self.lengths > 0
        step = move.take(self.after, axis=0)
        step[long] = runs_[of[long]]
        ran = ended & long
        step[ran] = _times(step[ran], move[self.after[ran]])
        scale_of = self.lengths[:, None] * (np.log(size) + top[self.common]) + np.where(ended[:, None], top[self.after], 0.0)

        m = len(self.weights)
        now = start * e[self.first]
        total = now.sum(axis=1)
        ll = self.weights @ (np.log(total) + top[self.first])
        alphas, nexts, scales = [now / total[:, None]], [], []
        for code in self.codes:
            now = np.einsum("mkr,mklr->mlr", alphas[-1][: len(code)], step.take(code, axis=0))
            total = now.sum(axis=1)
            now /= total[:, None]
            ll += self.weights[: len(code)] @ (np.log(total) + scale_of[code])
            alphas.append(now)
            scales.append(total)
        beta = np.ones((m, k, r))
        for i in reversed(range(len(self.codes))):
            own = len(self.codes[i])
            b = beta[:own]
            share = self.weights[:own, None] / (scales[i] * (alphas[i + 1] * b).sum(axis=1))
            alphas[i + 1] = None
            nexts.append((alphas[i][:own] * share[:, None], b.copy()))
            b = np.einsum("mklr,mlr->mkr", step.take(self.codes[i], axis=0), b)
            beta[:own] = b / b.sum(axis=1)[:, None]
        g = alphas[0] * beta
        g *= (self.weights[:, None] / g.sum(axis=1))[:, None]

        pairs = np.zeros((len(self.values), k, k, r))  # what came before and after each value, without the step itself
        if nexts:
            codes = np.concatenate(self.codes[::-1])
            order = np.argsort(codes, kind="stable")
            left, right = (np.concatenate(x)[order] for x in zip(*nexts))
            at = np.searchsorted(codes[order], np.arange(len(self.lengths) + 1)).tolist()
            both = np.empty((len(self.lengths), k, k, r))
            for i, own in enumerate(map(slice, at[:-1], at[1:])):
                np.einsum("mkr,mlr->klr", left[own], right[own], out=both[i])
            into, behind = both.copy(), both
            into[ran] = _times(runs_[of[ran]].swapaxes(1, 2), both[ran])
            np.add.at(pairs, self.after[ended], into[ended])
            behind[ran] = _times(both[ran], move[self.after[ran]].swapaxes(1, 2))
            held = np.zeros((len(lengths), k, k, r))
            np.add.at(held, of[long], behind[long])
            some = np.zeros((k, k, r))
            for j in reversed(range(len(doubled))):
                q = doubled[j].swapaxes(0, 1)
                if j + 1 < len(doubled):
                    some = _times(some, q) + _times(q, some)
                some = some + _times(_times(head[j].swapaxes(1, 2), held[set_[j]]), tail[j].swapaxes(1, 2)).sum(axis=0)
            pairs[self.common] += some / size
        moves = pairs * move
        mass = moves.sum(axis=1)
        np.add.at(mass, self.first, g)
        x = self.values
        parts = [ll[None], g.sum(axis=0), moves.sum(axis=0).reshape(k * k, r), mass.sum(axis=0), *[np.einsum("v,vkr->kr", f, mass) for f in (x, x**2, (x == 0).astype(float))]]
        return np.concatenate(parts).T


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices whose last axis is the model."""
    return np.einsum("...ijr,...jkr->...ikr", a, b)


def strides(seqs: list[np.ndarray], weights: list[int] | None = None):
    """Packs of about STEPS strides each."""
    some = [(s, w) for s, w in zip(seqs, weights or [1] * len(seqs)) if len(s)]
    if not some:
        return
    values, n = np.unique(np.concatenate([s for s, _ in some]), return_counts=True)
    common = float(values[n.argmax()])
    held, steps = [], 0
    for s, w in sorted(some, key=lambda x: len(x[0])):
        held.append((s, w))
        steps += int((s != common).sum()) + 1
        if steps >= STEPS:
            yield Strides(*map(list, zip(*held)), common)
            held, steps = [], 0
    if held:
        yield Strides(*map(list, zip(*held)), common)


def sums_of_many(seqs: list[np.ndarray], model: tuple, settings: Hmm) -> np.ndarray:
    """The sum of ``sums_of`` over sequences."""
    return sum(pack.sums([model], settings)[0] for pack in strides(seqs))


def updated(sums: np.ndarray, model: tuple, settings: Hmm) -> tuple:
    k, p = settings.n_states, model[2]
    first, moves = sums[1 : k + 1], sums[k + 1 : k + 1 + k * k].reshape(k, k)
    w, x, x2, z = sums[k + 1 + k * k :].reshape(4, k)
    start = (first + 1e-6) / (first + 1e-6).sum()
    a, w = _constrained(moves + 1e-6, settings), np.maximum(w, 1e-9)
    if settings.emission == "zip":
        zeros, mean = z / w, x / w
        spare = np.clip((zeros - np.exp(-p["rate"])) / np.maximum(1 - np.exp(-p["rate"]), 1e-9), 0.0, 0.99)
        return start, a, {"rate": np.maximum(mean / (1 - spare), 1e-3), "zero": np.clip(spare, 1e-6, 0.99)}
    if settings.emission == "gaussian":
        return start, a, {"mean": x / w, "var": np.maximum(x2 / w - (x / w) ** 2, 1e-3)}
    return start, a, {"still": np.clip(z / w, 1e-4, 1 - 1e-4)}


def in_order(ll: float, model: tuple, settings: Hmm) -> dict:
    """A model's numbers, its states sorted, the quietest first."""
    start, a, p = model
    order = np.argsort({"zip": p.get("rate"), "gaussian": p.get("mean"), "categorical": -p.get("still", np.zeros(1))}[settings.emission], kind="stable")
    return {"ll": float(ll), "start": start[order].tolist(), "trans": a[order][:, order].ravel().tolist(), "params": [q[order].tolist() for q in p.values()]}


def _levels(active: np.ndarray, k: int) -> np.ndarray:
    return np.percentile(active, np.linspace(10, 90, k)) if len(active) else np.linspace(0.1, 1, k)


def fit(sequences: list[np.ndarray], settings: Hmm, restart: int) -> dict:
    """Expectation maximisation over a few sequences in one place."""
    every = np.concatenate(sequences)
    model = start_of(_levels(every[every > 0], settings.n_states), float(every.var()), settings, restart)
    best, kept = -np.inf, model
    for _ in range(settings.n_iter):
        sums = sum(sums_of(seq, model, settings) for seq in sequences)
        gain = sums[0] - best
        if gain > 0:
            best, kept = sums[0], model
        if gain < settings.tol:
            break
        model = updated(sums, model, settings)
    return in_order(best, kept, settings)


PARAMS = "restart int, ll double, n_states int, start array<double>, trans array<double>, params array<array<double>>"
NAMES = {"zip": ("rate", "zero"), "gaussian": ("mean", "var"), "categorical": ("still",)}


def sequences(seen: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, x``: a row for each subject of each group with its readings in order."""
    rows = seen.join(groups.select("id", "grp"), "id").groupBy("grp", "id").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s"))
    return rows.select("grp", F.transform("s", lambda r: r["x"]).alias("x"))


#: Readings of a partition at least and at most, about, and of a group that a task holds before it packs them.
READINGS, HELD = (1 << 15, 1 << 21), 1 << 22


def packed(rows: DataFrame, readings: int) -> DataFrame:
    """``grp, pack``: the sequences of ``sequences`` as pickled ``Strides``; equal ones of a group are one with a weight."""
    key = rows.schema["grp"].dataType.simpleString()
    least, most = READINGS
    parts = max(min(rows.sparkSession.sparkContext.defaultParallelism, readings // least), readings // most, 1)

    def work(batches):
        held: dict[object, tuple[list, list]] = {}
        size: dict[object, int] = {}

        def out(grp):
            del size[grp]
            return pd.DataFrame([(grp, pickle.dumps(pack)) for pack in strides(*held.pop(grp))], columns=["grp", "pack"])

        for batch in batches:
            for grp, x, n in zip(batch["grp"], batch["x"], batch["n"]):
                seqs, weights = held.setdefault(grp, ([], []))
                seqs.append(np.asarray(x, float))
                weights.append(n)
                size[grp] = size.get(grp, 0) + len(x)
                if size[grp] >= HELD:
                    yield out(grp)
        for grp in list(held):
            yield out(grp)

    equal = rows.repartition(parts, "grp", "x").groupBy("grp", "x").agg(F.count(F.lit(1)).alias("n"))
    return equal.mapInPandas(work, f"grp {key}, pack binary")


def train(seen: DataFrame, groups: DataFrame, settings: Hmm = Hmm()) -> DataFrame:
    """``grp`` and PARAMS of the best restart of each group (the first of equals).

    The driver holds the parameters and the sums of groups times restarts, some fifty numbers each, and a job for each
    step adds them up; restarts that no longer gain by ``tol`` leave. For a model a subject, see ``train_subjects``.
    Readings are packed once, so a step is work on strides (``Strides``) and not on readings.
    """
    k, key = settings.n_states, groups.schema["grp"].dataType.simpleString()
    joined = seen.join(groups.select("id", "grp"), "id")
    active = F.percentile(F.when(F.col("x") > 0, F.col("x")), F.array(*[F.lit(float(q)) for q in np.linspace(0.1, 0.9, k)]))
    first = joined.groupBy("grp").agg(active.alias("levels"), F.var_pop("x").alias("var"), F.count(F.lit(1)).alias("n")).collect()
    spark = seen.sparkSession
    rows = packed(sequences(seen, groups), sum(r["n"] for r in first)).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    adders = min(rows.getNumPartitions(), spark.sparkContext.defaultParallelism)
    models = {(r["grp"], n): start_of(np.array(r["levels"]) if r["levels"] else _levels(np.zeros(0), k), r["var"] or 0.0, settings, n) for r in first for n in range(settings.n_restarts)}
    best, kept, going = dict.fromkeys(models, -np.inf), dict(models), set(models)
    for _ in range(settings.n_iter):
        if not going:
            break
        now = spark.sparkContext.broadcast({m: models[m] for m in going})

        def sums(held, now=now):
            found: dict[tuple, np.ndarray] = {}
            for grp, pack in held:
                if some := [m for m in now.value if m[0] == grp]:
                    for m, v in zip(some, pickle.loads(pack).sums([now.value[m] for m in some], settings)):
                        found[m] = found.get(m, 0.0) + v
            return found.items()

        for m, v in rows.mapPartitions(sums).reduceByKey(np.add, adders).collect():
            if v[0] - best[m] < settings.tol:
                going.discard(m)
            if v[0] > best[m]:
                best[m], kept[m] = float(v[0]), models[m]  # the sums are those of the parameters before the step
            models[m] = updated(v, models[m], settings)
        now.unpersist()
    rows.unpersist()
    out = []
    for grp in dict.fromkeys(m[0] for m in models):
        n = max((m[1] for m in models if m[0] == grp), key=lambda n: (best[grp, n], -n))
        found = in_order(best[grp, n], kept[grp, n], settings)
        out.append((grp, n, found["ll"], k, found["start"], found["trans"], found["params"]))
    return spark.createDataFrame(out, f"grp {key}, {PARAMS}")


def fitted(seen: DataFrame, groups: DataFrame, settings: Hmm = Hmm()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The observations, their fitting groups and the models for the scope of the settings: one subject (or day) a
    model is fitted where the subject is, larger groups by sums over all tasks."""
    rows, parts = scoped(seen, groups, settings.scope, settings.samples_per_day)
    make = train_subjects if settings.scope in ("subject", "subject_day") else train
    return rows, parts, make(rows, parts, settings)


def train_subjects(seen: DataFrame, groups: DataFrame, settings: Hmm = Hmm()) -> DataFrame:
    """The same where every group is one subject or one of its days: all restarts of a group in one task."""
    key = groups.schema["grp"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [g["x"].to_numpy(float) for _, g in pdf.sort_values(["id", "t"]).groupby("id", sort=True)]
        fits = [{"restart": n, **fit(parts, settings, n)} for n in range(settings.n_restarts)]
        found = max(fits, key=lambda f: (f["ll"], -f["restart"]))
        return pd.DataFrame([{"grp": pdf["grp"].iloc[0], "n_states": settings.n_states, **found}])[["grp", *[c.split()[0] for c in PARAMS.split(", ")]]]

    return seen.join(groups.select("id", "grp"), "id").select("grp", "id", "t", "x").groupBy("grp").applyInPandas(one, f"grp {key}, {PARAMS}")


def decode(seen: DataFrame, groups: DataFrame, models: DataFrame, settings: Hmm = Hmm()) -> DataFrame:
    """``id, t, state, hmm_sleep, confidence``; sleep is the quieter half of the states. Missing rows have no row."""
    own = groups.select("id", "grp").join(models.select("grp", "start", "trans", "params"), "grp")
    held = seen.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s")).join(own, "id")
    rows = held.select("id", "grp", F.transform("s", lambda r: r["t"]).alias("t"), F.transform("s", lambda r: r["x"]).alias("x"), "start", "trans", "params")

    def some(batches):
        k = settings.n_states
        for batch in batches:
            for _, part in batch.groupby("grp", sort=False):
                p = {n: np.array(v, float) for n, v in zip(NAMES[settings.emission], part["params"].iloc[0])}
                model = np.array(part["start"].iloc[0]), np.array(part["trans"].iloc[0]).reshape(k, k), p
                for places, pack in packs([np.asarray(x, float) for x in part["x"]]):
                    g, _, _ = posteriors(pack, model, settings)
                    state = g.argmax(axis=2).astype(np.int8) if settings.decoding == "posterior" else paths(pack, model, settings)
                    sure = g.max(axis=2)
                    names, times = part["id"].iloc[places], part["t"].iloc[places]
                    at = {j: i for i, j in enumerate(pack.order)}
                    cut = [(at[j], int(pack.size[at[j]])) for j in range(len(places))]
                    yield pd.DataFrame({"id": names.to_numpy(), "t": times.to_numpy(), "state": [state[:n, i] for i, n in cut], "confidence": [sure[:n, i] for i, n in cut]})

    schema = f"id {seen.schema['id'].dataType.simpleString()}, t array<int>, state array<tinyint>, confidence array<double>"
    told = rows.mapInPandas(some, schema).select("id", F.explode(F.arrays_zip("t", "state", "confidence")).alias("m"))
    return told.select("id", "m.t", "m.state", (F.col("m.state") < settings.n_states // 2).cast("tinyint").alias("hmm_sleep"), "m.confidence")


def occupancy(decoded: DataFrame, n_states: int = 4) -> DataFrame:
    """``id, state_0 …``: percent of a subject's valid minutes in each state."""
    return decoded.groupBy("id").agg(*[(100.0 * F.avg((F.col("state") == k).cast("double"))).alias(f"state_{k}") for k in range(n_states)])


def zt_fractions(decoded: DataFrame, n_states: int = 4, bin_minutes: int = 30) -> DataFrame:
    """``id, zt_bin_minute, state_0 …``: share of each state in each bin of the day."""
    return decoded.groupBy("id", S.zt_bin("t", bin_minutes).alias("zt_bin_minute")).agg(*[F.avg((F.col("state") == k).cast("double")).alias(f"state_{k}") for k in range(n_states)])


def bout_lengths(decoded: DataFrame) -> DataFrame:
    """``id, state, mean_length, sd_length, n`` of runs, which join across missing minutes."""
    return runs.state_runs(decoded, "state").groupBy("id", "state").agg(F.avg("n").alias("mean_length"), F.stddev_samp("n").alias("sd_length"), F.count(F.lit(1)).alias("n"))


def summary(decoded: DataFrame, groups: DataFrame, threshold_sleep: DataFrame | None = None) -> DataFrame:
    """``grp, sleep_percent, sleep_percent_sd, agreement_percent``: means over subjects (population deviation), and how
    often the hidden states agree with sleep by threshold."""
    per = decoded.groupBy("id").agg((100.0 * F.avg(F.col("hmm_sleep").cast("double"))).alias("p"))
    out = per.join(groups.select("id", "grp"), "id").groupBy("grp").agg(F.avg("p").alias("sleep_percent"), F.stddev_pop("p").alias("sleep_percent_sd"))
    if threshold_sleep is None:
        return out.withColumn("agreement_percent", F.lit(None).cast("double"))
    same = decoded.join(threshold_sleep.where("sleep IS NOT NULL").select("id", "t", "sleep"), ["id", "t"]).join(groups.select("id", "grp"), "id")
    agree = same.groupBy("grp").agg((100.0 * F.avg((F.col("sleep") == F.col("hmm_sleep")).cast("double"))).alias("agreement_percent"))
    return out.join(agree, "grp", "left")


def section_fractions(decoded: DataFrame, groups: DataFrame, n_states: int = 4, sections: int = 4) -> DataFrame:
    """``grp, section, state_0 …``: shares in equal parts of the day, subjects first."""
    part = F.floor(S.zt_minute("t") / (1440 // sections)).cast("int").alias("section")
    per = decoded.groupBy("id", part).agg(*[F.avg((F.col("state") == k).cast("double")).alias(f"state_{k}") for k in range(n_states)])
    return per.join(groups.select("id", "grp"), "id").groupBy("grp", "section").agg(*[F.avg(f"state_{k}").alias(f"state_{k}") for k in range(n_states)])


def select_states(seen: DataFrame, groups: DataFrame, candidates: list[int], settings: Hmm = Hmm(), folds: int = 5) -> DataFrame:
    """``n_states, fold, ll_per_obs, n, aic, bic``: held-out likelihood over folds of subjects.

    Each fold is a group of its own in ``train``: the subjects outside it. A fold without subjects has no row.
    """
    own = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(folds)).cast("int")
    dealt = groups.select("id", own.alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("grp")
    fitted = dealt.select("id", "own", every).where("grp <> own").select("id", "grp")
    held = sequences(seen, dealt.select("id", F.col("own").alias("grp")))
    sizes = {r["grp"]: r["m"] for r in seen.join(fitted, "id").groupBy("grp").agg(F.count(F.lit(1)).alias("m")).collect()}
    rows = []
    for k in candidates:
        some = Hmm(**{**settings.__dict__, "n_states": k})
        models = {r["grp"]: r for r in train(seen, fitted, some).collect()}

        def likelihood(batches):
            for batch in batches:
                out = []
                for grp, x in zip(batch["grp"], batch["x"]):
                    m, seq = models[grp], np.asarray(x, float)
                    p = {n: np.array(v, float) for n, v in zip(NAMES[some.emission], m["params"])}
                    out.append((grp, forward_backward(log_emission(seq, p, some.emission), np.array(m["start"]), np.array(m["trans"]).reshape(k, k))[2], len(seq)))
                if out:
                    yield pd.DataFrame(out, columns=["fold", "ll", "n"])

        scored = held.where(F.col("grp").isin(*models)).mapInPandas(likelihood, "fold int, ll double, n bigint").groupBy("fold").agg(F.sum("ll").alias("ll"), F.sum("n").alias("n"))
        free = k - 1 + k * (k - 1) + k * len(NAMES[some.emission])
        for r in scored.collect():
            ll = models[r["fold"]]["ll"]
            rows.append((k, r["fold"], r["ll"] / r["n"], r["n"], 2 * free - 2 * ll, free * math.log(sizes[r["fold"]]) - 2 * ll))
    return seen.sparkSession.createDataFrame(rows, "n_states int, fold int, ll_per_obs double, n bigint, aic double, bic double")


def group_timecourse(decoded: DataFrame, groups: DataFrame, states: tuple[int, ...] = (0, 1), bin_minutes: int = 30) -> DataFrame:
    """``grp, zt_bin_minute, mean, sem, n``: the share of minutes in ``states`` over the day, subjects first (one subject has no sem)."""
    per = decoded.groupBy("id", S.zt_bin("t", bin_minutes).alias("zt_bin_minute")).agg(F.avg(F.col("state").isin(*states).cast("double")).alias("share"))
    out = per.join(groups.select("id", "grp"), "id").groupBy("grp", "zt_bin_minute")
    return out.agg(F.avg("share").alias("mean"), S.sem("share").alias("sem"), F.count("share").alias("n"))
