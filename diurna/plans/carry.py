"""What of an experiment's results stays when subjects, groups or settings change.

Each table states what it describes (a subject or a group), which step's settings made it and which tables it was made from.
From that graph follows what is kept, what has to be made again, and what described groups that are no more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import state
from . import experiment


@dataclass(frozen=True)
class Result:
    of: str
    step: str | None = None
    needs: tuple[str, ...] = ()
    #: Whether it is made again from readings at little cost, for new subjects too.
    again: bool = False


#: Tables of ``experiment.run``.
GRAPH = {
    "curation": Result("group", "curation", again=True),
    "split": Result("group", "split", ("curation",), again=True),
    "profile": Result("group", None, ("curation",), again=True),
    "bouts": Result("subject", "sleep", ("curation",), again=True),
    "bout_summary": Result("subject", "sleep", ("bouts",), again=True),
    "states": Result("group", "sleep", ("bouts",), again=True),
    "period": Result("subject", "period", ("curation", "split_settings")),
    "rhythm": Result("group", None, ("period",), again=True),
    "hmm_models": Result("group", "hmm", ("curation",)),
    "hmm_minutes": Result("group", "hmm", ("hmm_models",)),
}


@dataclass
class Carried:
    kept: dict[str, DataFrame] = field(default_factory=dict)
    again: list[str] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def _steps(name: str) -> set[str]:
    """The steps whose settings a table hangs on, its own and those of what it needs."""
    if name == "split_settings":
        return {"split"}
    own = GRAPH[name]
    return {s for s in (own.step,) if s}.union(*[_steps(n) for n in own.needs])


def _below(name: str) -> set[str]:
    return {n for n in GRAPH[name].needs if n in GRAPH}.union(*[_below(n) for n in GRAPH[name].needs if n in GRAPH])


def changes(before: DataFrame, after: DataFrame) -> dict[str, int]:
    """``new``, ``lost`` and ``moved`` (to another group) subjects, in one join."""
    label = lambda df, name: df.select("id", (F.col("grp").cast("string") if "grp" in df.columns else F.lit("")).alias(name), F.lit(1).alias(f"__{name}"))
    both = label(before, "a").join(label(after, "b"), "id", "full")
    n = lambda c: F.count(F.when(c, 1))
    row = both.agg(n(F.col("__a").isNull()).alias("new"), n(F.col("__b").isNull()).alias("lost"), n(F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("moved")).first()
    return row.asDict()


def carry_over(made: dict[str, DataFrame], before: DataFrame, after: DataFrame, old: experiment.Plan, new: experiment.Plan) -> Carried:
    """What of ``made`` (by ``old`` for the subjects ``before``) holds for the subjects ``after`` and the plan ``new``.

    A table of subjects is kept for those who stay, unless settings that it hangs on changed or a subject was never
    analysed. A table of groups is kept only while subjects, labels and settings are the same. Others are made again
    where that takes readings and settings only, and gone where models or averages were fitted to groups.
    """
    seen, out = changes(before, after), Carried()
    differ = {s for s in ("curation", "split", "sleep", "period", "hmm") if getattr(old, s) != getattr(new, s)}
    same_groups = not (seen["new"] or seen["lost"] or seen["moved"])
    for name, table in made.items():
        if name not in GRAPH:
            continue
        kind, changed = GRAPH[name], sorted(_steps(name) & differ)
        wanted = kind.step is None or getattr(new, kind.step) is not None
        if not wanted or any(getattr(new, s) is None for s in _steps(name) & {"curation"}):
            out.gone.append(name)
            out.notes.append(f"{name} goes: the plan has no {kind.step if not wanted else 'curation'} any more")
        elif changed:
            out.again.append(name)
            out.notes.append(f"{name} is made again: other settings of {', '.join(changed)}")
        elif kind.of == "subject" and not seen["new"]:
            out.kept[name] = table if not seen["lost"] else table.join(after.select("id"), "id", "left_semi")
            out.notes.append(f"{name} is kept for every subject")
        elif kind.of == "subject":
            out.again.append(name)
            out.notes.append(f"{name} is made again: {seen['new']} of the subjects were never analysed")
        elif same_groups:
            out.kept[name] = table
            out.notes.append(f"{name} is kept: its groups are the same")
        elif kind.again:
            out.again.append(name)
            out.notes.append(f"{name} is made again for the new groups")
        else:
            out.gone.append(name)
            out.notes.append(f"{name} goes: it describes groups that are no more; run {kind.step} again")
    return out


def regroup(readings: DataFrame, subjects: DataFrame, made: dict[str, DataFrame], old: experiment.Plan, new: experiment.Plan, step: int = 1) -> tuple[dict[str, DataFrame], Carried]:
    """The tables for ``subjects`` under ``new``: kept ones as they are, the rest made by ``experiment.run``."""
    who = experiment.members(subjects, new)
    carried = carry_over(made, made["subjects"], who, old, new)
    fresh = experiment.run(readings, subjects, new, step, only=set(carried.again) | {"subjects"}, given=carried.kept) if carried.again else {"subjects": who}
    return {**carried.kept, **fresh}, carried


def stale(table: DataFrame, plan: experiment.Plan) -> list[str]:
    """The steps of ``plan`` whose settings are not those that made ``table`` (see ``state.made_with``)."""
    return state.differing(table, *plan.settings)
