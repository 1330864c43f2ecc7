"""Findings of round 3, on small tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from diurna.llm import decontamination, jaccard_join, pii


def test_trees_see_every_document(spark):
    """Long look-alikes of secrets stand only in documents that a sample by the hash of the id left out."""
    inside = {r.doc_id for r in spark.range(8000).select(F.col("id").alias("doc_id")).where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(1 << 30) < 0.5).collect()}
    rows = []
    for i in range(8000):
        value = f"{i * 7919 % 10007:05d}" * 12
        rows.append((i, f'token = "{value[:40]}" and' if i in inside or i % 2 else f"see {value[:60]} and"))
    found = {r.doc_id for r in pii.span_report(spark.createDataFrame(rows, "doc_id bigint, text string")).where("spans LIKE '%secret%'").collect()}
    wanted = {i for i in range(8000) if i in inside or i % 2}
    assert len(wanted - found) <= 80 and len(found - wanted) <= 80


def test_scores_are_planned_over_plain_columns(spark):
    """A filter on a score over columns that are expressions multiplies in the planner: the driver ran out of heap."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pii.span_report(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan.lower() and "regexp_extract" not in plan.lower()


def test_a_split_holds_for_all_values_told_as_one(spark):
    one = pii.UNIT
    cells = [(0, 3, 100, one, 1), (0, 64, -3 * one, one, 1), (1, 0, 5, one, 1)]
    assert pii.best_split(cells)[:2] == (0, (3 + 64) / 2)
    assert pii.best_split([(0, 64, 9 * one, one, 1), (0, 66, -9 * one, one, 1)])[:2] == (0, 65.5)
    frame = spark.range(60, 140).select(F.col("id").cast("int").alias("digits"))
    assert {r[0] for r in frame.select(pii._leading("digits")).collect()} == {60, 61, 62, 63, *range(64, 128, 2), *range(128, 140, 4)}


def test_trees_are_the_same_by_jobs_and_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(pii, "TREES", 3)
    found = pii.written(pii.candidates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), "candidates")
    a, b = pii.fit(found), pii.fit(found, near=0)
    assert a.thresholds == b.thresholds and a.trees and repr(a.trees) == repr(b.trees)


def test_words_of_letters_need_no_patterns(monkeypatch):
    words, read, asked = decontamination.Words(), decontamination.Words.read, []
    monkeypatch.setattr(decontamination.Words, "read", staticmethod(lambda raw: asked.append(raw) or read(raw)))
    for raw in ["A", "a.", "ß,", "ﬁ!", "ten.", "Mm;", "x?", "É:", "ǅa.", "Anna,", "seven", "plain", "+", "-3", "12.", "ten-two", "(Anna)", "_", "…", "×", ".", "m|"]:
        k = words[raw]
        assert (words.texts[k], int(words.flags[k])) == read(raw), raw
    assert asked == ["+", "-3", "12.", "ten-two", "(Anna)", "_", "…", "×", ".", "m|"]


def test_a_calculation_with_its_result_asks_nothing():
    words = decontamination.Words()
    hashes = lambda text, n: {w[0] for w in decontamination.windows(text, words, n, None)}
    assert not hashes("Note 12 + 7 = 19 and then", None) & hashes("Note 5 + 6 = 11 and then", [8])
    assert hashes("Solve 12 + 7 = what is it", None) & hashes("Solve 5 + 6 = what is it", [8])


def test_pairs_meet_once(spark, monkeypatch):
    """Sets that share many entries: all pairs that an entry allows, few of them more than once, and those without first entries too."""
    rows = [(e, k, 40, (e * k) % 12, k) for k in range(30) for e in range(40) if (e * 7 + k) % 5]
    others = spark.createDataFrame(rows, "entry bigint, node bigint, n bigint, place bigint, root bigint")
    centers = others.where("node < 6 AND entry % 3 > 0").selectExpr("entry", "node AS a", "n AS m", "place AS place0", "root AS from")
    plain = centers.join(others, "entry").where("root <> from AND " + jaccard_join._may_link(85, ("n", "place"), ("m", "place0")))
    wanted = {(min(r.a, r.node), max(r.a, r.node)) for r in plain.select("a", "node").collect()}
    counted = []
    distinct = type(others).distinct
    monkeypatch.setattr(type(others), "distinct", lambda self: counted.append(self.count()) or distinct(self))
    for first in (8, 1, 0):
        monkeypatch.setattr(jaccard_join, "FIRST", first)
        assert {tuple(r) for r in jaccard_join.meetings(centers, others, 85).collect()} == wanted
    assert counted[0] <= 3 * len(wanted) < counted[2] == plain.count()


def test_texts_looked_through_together(monkeypatch):
    """Texts read together give the windows that each gives alone, whatever the next one starts with, and only those that may hold something are read again."""
    base = "we saw how many of them there were in all of the old towns by the sea"
    texts = [f"{base} and then twenty", f"one {base} by Mary", f"Jones {base} 12", f"+ 7 = 19 {base} 12 + 8", None, f"km {base} - 4 * 3", "", f"= 9 {base}\n\nAda Byron", f"Lovelace {base}!", "12 + 7", "= 19", "Ada", "Lovelace", f"(3 + 4) * 5 - 6 / 2 + 1 {base}"]
    words = decontamination.Words()
    alone = {k: found for k, t in enumerate(texts) if (found := list(decontamination.windows(t, words, [2, 5, 10], None)))}
    hashes = np.unique(np.array([r[0] for found in alone.values() for r in found], np.int64)).view(np.uint64)
    bits = np.zeros(1 << 16, np.uint64)
    for at in (hashes >> np.uint64(42), hashes & np.uint64((1 << 22) - 1)):
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    table = decontamination.Table(bits, 42)
    assert dict(decontamination.all_windows(texts, words, [2, 5, 10], table)) == alone
    assert decontamination.holding(texts, words, [2, 5, 10], table) == sorted(alone)
    read, asked = decontamination.windows, []
    monkeypatch.setattr(decontamination, "windows", lambda text, *x: asked.append(text) or read(text, *x))
    one = np.array([alone[3][0][0]], np.int64).view(np.uint64)
    bits[:] = 0
    for at in (one >> np.uint64(42), one & np.uint64((1 << 22) - 1)):
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    assert 3 in dict(decontamination.all_windows(texts, words, [2, 5, 10], table)) and len(asked) < 4


def test_turns_of_a_bucket(spark):
    """A bucket's largest component waits, the others take turns; a bucket of one component is done. No join makes the rows again."""
    rows = [(1, a, n, 10, 0, r) for a, n, r in [(3, 5, 5), (1, 6, 6), (2, 7, 6), (0, 8, 8), (3, 4, 4)]] + [(2, 0, 5, 10, 0, 5), (2, 0, 9, 10, 0, 5)]
    found = jaccard_join.outside_first(spark.createDataFrame(rows, "entry bigint, alone bigint, node bigint, n bigint, place bigint, root bigint"))
    assert {(r.entry, r.node, r.turn) for r in found.collect()} == {(1, 6, None), (1, 7, None), (1, 8, 1), (1, 4, 2), (1, 5, 3)}
    assert "Join" not in found._jdf.queryExecution().toString()
