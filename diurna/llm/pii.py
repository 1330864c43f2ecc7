"""Personal data in texts, with DataFrame functions only.

Generators with high recall propose spans, overlapping ones too. Boosted trees score every candidate from
its format and the characters around it; they are fitted to all candidates, equal ones as one row with a weight; a level
of a tree is one sum over nodes, features and values. They become one SQL expression. What labels the candidates is nothing that the trees see: check
digits, ranges of numbers, and announcing words. A threshold for each kind, calibrated on candidates held back, selects
the spans, of overlapping ones those with the higher score. Spans that the base rules confirm always stay.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The base patterns. Runs are matched from their start or from the end of the match before,
#: and never given back, which finds the leftmost matches in one pass.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$"
#: More candidates. A kind's place is its order in spans that start together.
SECRET = r"(?:\G|(?<![A-Za-z0-9_/+=-]))[A-Za-z0-9_/+=-]{20,}+"
LOCAL_PHONE = r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "secret": SECRET, "local_phone": LOCAL_PHONE, "national_id": NATIONAL_ID, "account": ACCOUNT}
ORDER = {kind: k for k, kind in enumerate(KINDS)}
BASE = ("email", "ip", "card", "phone")
KEYWORDS = r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|auth|credential|bearer|private.?key)"
#: Characters before and after a span that features see.
BEFORE, AFTER = 24, 8
TREES, DEPTH, RATE = 20, 3, 0.3
#: Candidates that a node needs to be split.
SPLIT = 20
#: Precision on the candidates held back that a kind's threshold must reach, and the parts of one in which scores are told apart there.
PRECISION, STEPS = 0.98, 1 << 16
#: A kind of at least so many candidates has every fifth of them held back; one of fewer has this threshold.
HOLDS, DEFAULT = 25, 0.5
#: A kind of fewer candidates weighs as much as so many; a kind and label of fewer than a hundredth weighs up to a hundredth, in
#: proportion below so many rows.
WEIGHED, RARE = 50, 200
#: Slopes are added up as whole numbers of this part of one, so that their order does not matter.
UNIT = 1 << 24
#: Most different candidates whose sums are made on the driver.
NEAR = 1 << 16
#: Leading bits of a count by which trees tell values apart.
BITS = 6

COUNTS = ["n_chars", "digits", "letters", "capitals", "vowels", "blanks", "hyphens", "dots", "at_signs"]
FEATURES = [*COUNTS, "plus", "hex_only", "assigned", "quoted", "word_before", "word_after", *[f"is_{k}" for k in KINDS]]


def _count(column: str, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(column, f"[^{pattern}]", ""))


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, row, kind, start, stop, base, valid, announced`` and the features of every candidate span, in code points.

    ``valid`` says that its kind's check passes (check digits, ranges of numbers; secrets have none), ``announced``
    that a word for a secret stands before it; neither is a feature. ``row`` is a hash of the text; rows with equal ids and texts are one. Only candidates are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), text.alias("text")).withColumn("row", F.xxhash64("text"))
    # A cheap test first: most texts have no at sign, and many no digit.
    digit = F.col("text").rlike("[0-9]")
    possible = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+") & digit}
    none = F.array().cast("array<string>")
    found = [F.when(possible.get(kind, digit), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(kind) for kind, pattern in KINDS.items()]
    hits = rows.select("doc", "row", "text", *found)
    # The text between the matches of a kind gives their places.
    pieces = [
        F.when(F.size(kind) > 0, F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("found"), F.split("text", pattern, -1).alias("gaps")))
        for kind, pattern in KINDS.items()
    ]
    by_kind = hits.select("doc", "row", F.explode(F.filter(F.array(*pieces), lambda x: x.isNotNull())).alias("x")).select("doc", "row", "x.*")
    cuts = F.expr(f"transform(found, (m, i) -> struct(m AS value, char_length(gaps[i]) AS gap, right(gaps[i], {BEFORE}) AS before, left(gaps[i + 1], {AFTER}) AS after))")
    spans = by_kind.select("doc", "row", "kind", F.posexplode(cuts).alias("nth", "x")).select("doc", "row", "kind", "nth", "x.*")
    # Rows that are repeated have each span as often; one of each is enough.
    spans = spans.repartition("doc", "row").dropDuplicates(["doc", "row", "kind", "nth"])
    so_far = Window.partitionBy("doc", "row", "kind").orderBy("nth")
    size = F.char_length("value")
    placed = spans.withColumn("stop", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("stop") - size)
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = _count("value", "0-9")
    doubled = "aggregate(sequence(1, length(d)), 0, (a, i) -> a + if((length(d) - i) % 2 = 0, int(substr(d, i, 1)), int(substr('0246813579', int(substr(d, i, 1)) + 1, 1)))) % 10 = 0"
    placed = placed.withColumn("d", F.when((F.col("kind") == "card") & n.between(12, 19), digits))
    luhn = F.coalesce(F.expr(doubled), F.lit(False))
    parts = (F.col("kind") == "ip") & F.col("value").rlike(IP_PARTS)
    is_base = (F.col("kind") == "email") | parts | ((F.col("kind") == "card") & luhn) | ((F.col("kind") == "phone") & n.between(9, 15))
    moved = F.regexp_replace("value", " ", "")
    placed = placed.withColumn("r", F.when(F.col("kind") == "account", F.concat(F.substr(moved, F.lit(5)), F.left(moved, F.lit(4)))))
    letter = "ascii(substr(r, i, 1)) >= 65"
    mod97 = F.coalesce(F.expr(f"aggregate(sequence(1, length(r)), 0, (a, i) -> (a * if({letter}, 100, 10) + ascii(substr(r, i, 1)) - if({letter}, 55, 48)) % 97) = 1"), F.lit(False))
    checks = {"account": mod97, "national_id": F.col("value").rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "local_phone": F.col("value").rlike("^\\(?[2-9][0-9]{2}\\D{1,2}[2-9]"), "secret": F.lit(True)}
    valid = is_base
    for kind, check in checks.items():
        valid = F.when(F.col("kind") == kind, check).otherwise(valid)
    features = {
        "n_chars": size,
        "digits": n,
        "letters": _count("value", "A-Za-z"),
        "capitals": _count("value", "A-Z"),
        "vowels": _count("value", "AEIOUaeiou"),
        "blanks": _count("value", " "),
        "hyphens": _count("value", "-"),
        "dots": _count("value", "."),
        "at_signs": _count("value", "@"),
        "plus": F.col("value").startswith("+"),
        "hex_only": F.col("value").rlike("^[0-9A-Fa-f]+$"),
        "assigned": F.col("before").rlike("[=:]\\s*[\"']?$"),
        "quoted": F.col("before").rlike("[\"']$"),
        "word_before": F.col("before").rlike("\\w$"),
        "word_after": F.col("after").rlike("^\\w"),
        **{f"is_{k}": F.col("kind") == k for k in KINDS},
    }
    return placed.select("doc", "row", "kind", "start", "stop", is_base.alias("base"), valid.alias("valid"), F.col("before").rlike(KEYWORDS).alias("announced"), *[c.cast("int").alias(name) for name, c in features.items()])


class Node(NamedTuple):
    feature: int = -1
    limit: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None
    value: float = 0.0


class Model(NamedTuple):
    start: float
    trees: list[Node]
    thresholds: dict[str, float]


def as_sql(tree: Node) -> str:
    if tree.feature < 0:
        return repr(tree.value)
    return f"IF({FEATURES[tree.feature]} <= {tree.limit!r}D, {as_sql(tree.low)}D, {as_sql(tree.high)}D)".replace("DD", "D").replace(")D", ")")


def total_sql(model: Model) -> str:
    return " + ".join([repr(model.start) + "D", *(s if (s := as_sql(t)).endswith(")") else s + "D" for t in model.trees)])


def score_sql(model: Model) -> str:
    return f"1D / (1D + exp(-({total_sql(model)})))"


def _leading(name: str) -> Column:
    """A count with all but its BITS leading bits cleared."""
    lower = f"greatest(0, length(bin({name})) - {BITS})"
    return F.expr(f"shiftleft(shiftright({name}, {lower}), {lower})").alias(name)


Split = tuple[int, float, tuple[int, int], tuple[int, int]]
#: Feature and value, and the sums of slope, curve and weight there.
Cell = tuple[int, int, int, int, int]


def best_split(cells: list[Cell]) -> Split | None:
    """The feature and limit with the largest gain, and the sums of slope and curve on both sides."""
    by_feature: dict[int, list] = {}
    for f, v, g, h, _ in sorted(cells):
        by_feature.setdefault(f, []).append((v, g, h))
    best, found = 1e-6, None
    for f, own in by_feature.items():
        all_g, all_h = sum(g for _, g, _ in own), sum(h for *_, h in own)
        low_g = low_h = 0
        for (v, g, h), (after, *_) in zip(own, own[1:]):
            low_g, low_h = low_g + g, low_h + h
            low, high = (low_g, low_h), (all_g - low_g, all_h - low_h)
            gain = sum((x / UNIT) ** 2 / (y / UNIT + 1.0) for x, y in (low, high)) - (all_g / UNIT) ** 2 / (all_h / UNIT + 1.0)
            if gain > best:
                last = v + (1 << max(0, v.bit_length() - BITS)) - 1  # of the values that are told as v
                best, found = gain, (f, (last + after) / 2, low, high)
    return found


class Dealt:
    """The sums of levels by Spark, over any number of rows (features, y, weight); only sums reach the driver."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def slopes(self, model: Model) -> None:
        p = F.expr(score_sql(model))
        slope = (F.round((p - F.col("y")) * UNIT) * F.col("weight")).cast("bigint")
        curve = (F.round(p * (1 - p) * UNIT) * F.col("weight")).cast("bigint")
        self.sloped = self.rows.select(*FEATURES, "weight", slope.alias("g"), curve.alias("h"))

    def cells(self, splits: dict[int, Split], nodes: list[int]) -> dict[int, list[Cell]]:
        def place(k: int) -> str:
            return f"IF({FEATURES[splits[k][0]]} <= {splits[k][1]!r}D, {place(2 * k)}, {place(2 * k + 1)})" if k in splits else str(k)

        here = self.sloped.withColumn("node", F.expr(place(1))).where(F.col("node").isin(nodes))
        each = here.select("node", "weight", "g", "h", F.posexplode(F.array(*FEATURES)).alias("f", "v"))
        out: dict[int, list[Cell]] = {}
        for k, *cell in each.groupBy("node", "f", "v").agg(F.sum("g"), F.sum("h"), F.sum("weight")).collect():
            out.setdefault(k, []).append(tuple(cell))
        return out


class Near:
    """The same sums of all rows of a small table, without a job for each level."""

    def __init__(self, rows: DataFrame):
        held = rows.select(*FEATURES, "y", "weight").toArrow()
        self.x = [held.column(f).to_numpy() for f in FEATURES]
        self.values = [np.unique(x, return_inverse=True) for x in self.x]
        self.y, self.weight = held.column("y").to_numpy(), held.column("weight").to_numpy()

    def _value(self, tree: Node) -> np.ndarray | float:
        return tree.value if tree.feature < 0 else np.where(self.x[tree.feature] <= tree.limit, self._value(tree.low), self._value(tree.high))

    def slopes(self, model: Model) -> None:
        p = 1 / (1 + np.exp(-(np.full(len(self.y), model.start) + sum(self._value(t) for t in model.trees))))
        self.sums = [(np.round(x * UNIT) * self.weight).astype(np.int64) for x in (p - self.y, p * (1 - p))] + [self.weight]

    def cells(self, splits: dict[int, Split], nodes: list[int]) -> dict[int, list[Cell]]:
        place = np.ones(len(self.y), np.int64)
        for k in sorted(splits):
            place = np.where(place == k, 2 * k + (self.x[splits[k][0]] > splits[k][1]), place)
        out: dict[int, list[Cell]] = {}
        for k in nodes:
            own = np.flatnonzero(place == k)
            for f, (names, at) in enumerate(self.values):
                totals = np.zeros((3, len(names)), np.int64)
                for total, x in zip(totals, self.sums):
                    np.add.at(total, at[own], x[own])
                there = np.unique(at[own])
                out.setdefault(k, []).extend(zip([f] * len(there), names[there].tolist(), *totals[:, there].tolist()))
        return out


def grow(rows: Dealt | Near, model: Model) -> Node:
    """A tree of Newton steps on all rows; each split is the one with the largest gain over all values of all features.

    A level is one sum over nodes, features and values, in whole numbers.
    """

    def leaf(g: int, h: int) -> float:
        return -RATE * (g / UNIT) / (h / UNIT + 1.0)

    rows.slopes(model)
    splits: dict[int, Split] = {}
    values: dict[int, float] = {}
    nodes = [1]  # the children of node k are 2 k and 2 k + 1
    for _ in range(DEPTH):
        following = []
        for k, cells in sorted(rows.cells(splits, nodes).items()):
            g, h, n = (sum(c[i] for c in cells if c[0] == 0) for i in (2, 3, 4))
            values[k] = leaf(g, h)
            split = best_split(cells) if n >= SPLIT else None
            if split:
                splits[k] = split
                for child, sums in ((2 * k, split[2]), (2 * k + 1, split[3])):
                    values[child] = leaf(*sums)
                    following.append(child)
        nodes = following
        if not nodes:
            break

    def node(k: int) -> Node:
        return Node(*splits[k][:2], node(2 * k), node(2 * k + 1)) if k in splits else Node(value=values[k])

    return node(1)


def fit(found: DataFrame, *, near: int = NEAR) -> Model:
    """Boosted trees for the log-odds, fitted to all candidates ``found``; of a kind with HOLDS or more, every fifth by a hash is
    held back for its threshold.

    No row says what is personal, so checks that the features do not show label the candidates: one is personal if its kind's
    check passes, and a secret if a word for one announces it. A threshold is the lowest score down to which the valid
    rows held back are right often enough; secrets, which have no check, also need one half. A kind with rows held back
    of which no threshold is precise enough gets 2, which no score reaches; one without has no entry, and ``spans``
    takes DEFAULT.
    """
    truth = F.when(F.col("kind") == "secret", F.col("announced") & (F.col("digits") > 0)).otherwise(F.col("valid")).cast("int")
    counts = {(r["kind"], r["y"]): r["n"] for r in found.groupBy("kind", truth.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(0.0, [], {})
    labels = {y for _, y in counts}
    if len(labels) == 1:
        y = labels.pop()
        return Model(math.log((y + 1e-3) / (1 - y + 1e-3)), [], {})
    total, of_kind = sum(counts.values()), {k: counts.get((k, 0), 0) + counts.get((k, 1), 0) for k in KINDS}
    weight = F.lit(1)
    for (kind, y), n in sorted(counts.items()):
        own = max(1, WEIGHED // of_kind[kind], total // (100 * max(n, RARE)))
        weight = F.when((F.col("kind") == kind) & (F.col("y") == y), F.lit(own)).otherwise(weight)
    many = [k for k in KINDS if of_kind[k] >= HOLDS]
    held = F.col("kind").isin(many) & (F.pmod(F.xxhash64("doc", "row", "kind", "start"), F.lit(5)) == 4)
    # Candidates that trees cannot tell apart are one row.
    alike = ["kind", "valid", "y", "held", *FEATURES]
    told = found.select("kind", "valid", truth.alias("y"), held.alias("held"), *[_leading(f) if f in COUNTS else F.col(f) for f in FEATURES])
    rows = written(told.groupBy(*alike).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.col("n") * weight), "vectors")
    seen = rows.where("NOT held")
    all_of, right_of, n = seen.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("y")), F.count(F.lit(1))).first()
    mean = right_of / all_of
    model = Model(math.log((mean + 1e-3) / (1 - mean + 1e-3)), [], {})
    summed = (Near if n <= near else Dealt)(seen)
    for _ in range(TREES):
        model.trees.append(grow(summed, model))
    step = F.floor(F.expr(score_sql(model)) * STEPS)
    steps = rows.where("held AND valid").groupBy("kind", step.alias("step")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("right"))
    down = Window.partitionBy("kind").orderBy(F.desc("step"))  # at most STEPS rows of a kind
    precise = F.sum("right").over(down) >= PRECISION * F.sum("n").over(down)
    for r in steps.select("kind", "step", precise.alias("precise")).groupBy("kind").agg(F.min(F.when(F.col("precise"), F.col("step"))).alias("least")).collect():
        model.thresholds[r["kind"]] = 2.0 if r["least"] is None else max(DEFAULT if r["kind"] == "secret" else 0.0, r["least"] / STEPS)
    return model


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted to the candidates of all documents."""
    return fit(written(candidates(docs, id_col=id_col, text_col=text_col), "candidates"))


def spans(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, row, kind, start, stop, base, score`` of the selected spans.

    Base spans stay as they are, overlapping ones of different kinds too. Others stay if they are valid and have a score
    at their kind's threshold or above, unless they overlap a base span or a selected one with a higher score (or the
    same score and an earlier start).
    """
    return selected(written(candidates(docs, id_col=id_col, text_col=text_col), "candidates"), model)


def selected(found: DataFrame, model: Model) -> DataFrame:
    """The ``spans`` among candidates. These are a written table: over columns that are still expressions, the filter on the score
    has the planner list all ways to write it with each of them, which fills the driver's heap."""
    scored = found.withColumn("score", F.expr(score_sql(model)))
    limit = F.lit(DEFAULT)
    for kind, least in sorted(model.thresholds.items()):
        limit = F.when(F.col("kind") == kind, F.lit(least)).otherwise(limit)
    rank = F.lit(len(ORDER))
    for kind, k in ORDER.items():
        rank = F.when(F.col("kind") == kind, F.lit(k)).otherwise(rank)
    chosen = scored.where(F.col("base") | F.col("valid") & (F.col("score") >= limit)).select("doc", "row", "kind", "start", "stop", "base", "score", rank.alias("rank"))
    in_order = Window.partitionBy("doc", "row").orderBy("start", "rank")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # What follows is read from the end, so that every window grows by a row at a time.
    after = Window.partitionBy("doc", "row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    base_stop = F.coalesce(F.max(F.when(F.col("base"), F.col("stop"))).over(before), F.lit(0))
    next_base = F.min(F.when(F.col("base"), F.col("start"))).over(after)
    clear = F.col("base") | ((F.col("start") >= base_stop) & F.coalesce(F.col("stop") <= next_base, F.lit(True)))
    left = chosen.withColumn("clear", clear).where("clear").drop("clear")
    # What is left overlaps in short chains only; in each, the best span goes first.
    reached = F.coalesce(F.max(F.when(~F.col("base"), F.col("stop"))).over(before), F.lit(0))
    opens = left.withColumn("opens", (F.col("base") | (F.col("start") >= reached)).cast("int"))
    chains = opens.withColumn("chain", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.struct((-F.col("score")).alias("last"), "start", "rank", "stop", "kind", "base", "score")
    listed = chains.groupBy("doc", "row", "chain").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    taken = F.expr("aggregate(all, slice(all, 1, 0), (a, x) -> if(x.base OR NOT exists(a, y -> y.start < x.stop AND x.start < y.stop), concat(a, array(x)), a))")
    return listed.select("doc", "row", F.explode(taken).alias("x")).select("doc", "row", "x.kind", "x.start", "x.stop", "x.base", "x.score", "x.rank")


def span_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document.

    A null or empty text has no spans. Rows that share an id have their own results.
    """
    all_found = written(candidates(docs), "candidates")
    found = selected(all_found, fit(all_found))
    line = F.concat_ws(":", "kind", "start", "stop")
    entry = F.struct("start", "rank", line.alias("line"))
    listed = {"base_list": F.col("base"), "all_list": F.lit(True)}
    counts = {f"n_{k}": F.count(F.when(F.col("base") & (F.col("kind") == k), 1)) for k in BASE}
    by_row = found.groupBy("doc", "row").agg(*[c.alias(n) for n, c in counts.items()], *[F.array_sort(F.collect_list(F.when(c, entry))).alias(n) for n, c in listed.items()])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("__row"))
    out = rows.join(by_row, rows["doc_id"].eqNullSafe(by_row["doc"]) & (rows["__row"] == by_row["row"]), "left")
    joined = {n: F.coalesce(F.array_join(F.transform(n, lambda x: x["line"]), ","), F.lit("")) for n in listed}
    zero = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in counts]
    return out.select("doc_id", *zero, F.sha2(joined["base_list"], 256).alias("base_sha256"), joined["all_list"].alias("spans"))
