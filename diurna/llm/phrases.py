"""Collocations by hierarchical pair naming.

Frequent words get a number. Two frequent (k-1)-grams that stand one word apart overlap in all but their outer words, so
a k-gram is the pair of their numbers: pairs are counted over the corpus, the frequent ones get numbers of their own, and
positions take the number of the pair that starts there. Each number keeps the pair it came from: its parents, the phrase
without its last and without its first word, lead to the counts of every cut and to the longer phrases that hold it.

Positions take their numbers from tables that are sent to the tasks while these have ``known`` rows or fewer, and by joins
on the positions beyond. Both ways give the same rows.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written

#: Most rows of a table of frequent words and of one of frequent pairs that is sent to the tasks (some 120 and 12 bytes a row).
KNOWN_WORDS, KNOWN = 1 << 21, 1 << 23
#: Words that a task holds before it hands on what it has counted, and positions that it works on at once.
HELD, CHUNK = 1 << 20, 1 << 21
#: Groups in which the phrases of one language are ranked before they meet.
SALTS = 64

_LETTERS = bytes(range(65, 91))
_FOLD = bytes.maketrans(_LETTERS + b".,;:!?\x0b\x0c\r\t", _LETTERS.lower() + b"\n" * 9 + b" ")


def pieces(text: bytes | None) -> list[list[bytes]]:
    """The words of each piece: A-Z lower-cased, split at ``. , ; : ! ?`` and line ends, then at spaces and tabs."""
    return [words for piece in (text or b"").translate(_FOLD).split(b"\n") if (words := piece.split())]


def _count_words(batches):
    """``lang, word, n``: what a task has counted, whenever it holds ``HELD`` different words."""
    counts: dict[str, Counter] = {}

    def rows():
        for lang, counted in counts.items():
            words, n = list(counted), list(counted.values())
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array(n[at : at + (1 << 16)], pa.int64())], ["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counted = counts.setdefault(lang, Counter())
            for words in pieces(text):
                counted.update(words)
            if sum(map(len, counts.values())) > HELD:
                yield from rows()
    yield from rows()


def numbered(df: DataFrame) -> DataFrame:
    """``df``, written, with ``id``: 0, 1, 2 and on over all rows."""
    base = written(df.withColumn("__at", F.monotonically_increasing_id()), "grams")
    part = F.shiftright("__at", 33)
    sizes = sorted((r[0], r[1]) for r in base.groupBy(part.alias("p")).count().collect())  # a row for each partition
    starts = dict(zip((p for p, _ in sizes), np.cumsum([0, *[n for _, n in sizes]]).tolist()))
    if not starts:
        return base.withColumn("id", F.lit(None).cast("bigint")).drop("__at")
    offset = F.broadcast(base.sparkSession.createDataFrame(list(starts.items()), "__p int, __start bigint"))
    placed = base.withColumn("__p", part.cast("int")).join(offset, "__p")
    return placed.withColumn("id", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__p", "__start", "__at")


class Pairs:
    """Pairs of numbers below ``base``, as keys first * base + second -> the number of the pair, or -1."""

    def __init__(self, keys: np.ndarray, names: np.ndarray, base: int):
        self.base = base
        order = np.argsort(keys)
        self.keys, self.names = keys[order], names[order].astype(np.int32)

    def of(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), -1, np.int64)
        if len(ids) < 2 or not len(self.keys):
            return out
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        key = ids[at] * self.base + ids[at + 1]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        out[at[hit]] = self.names[place[hit]]
        return out


def _streams(batches, column: int = 0):
    """The positions of whole documents, -1 between them, about ``CHUNK`` at once."""
    held, n = [], 0
    for batch in batches:
        for ids in batch.column(column).to_pylist():
            held += [np.frombuffer(ids, "<i4"), [-1]]
            n += len(ids) // 4 + 1
            if n >= CHUNK:
                yield np.concatenate(held).astype(np.int64)
                held, n = [], 0
    if held:
        yield np.concatenate(held).astype(np.int64)


def _positions(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``row, pos, id`` of every frequent word; a position is left out between pieces."""

    def work(batches):
        for batch in batches:
            for row, lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                pos = 0
                for words in pieces(text):
                    for at in range(0, len(words), 1 << 16):
                        part = words[at : at + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array([row] * len(part)), pa.array(np.arange(pos + at, pos + at + len(part))), pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary())], ["row", "pos", "lang", "word"])
                    pos += len(words) + 1

    words = docs.select("row", "lang", "text").mapInArrow(work, "row bigint, pos bigint, lang string, word binary")
    return words.join(frequent.select("lang", "word", "id"), ["lang", "word"]).select("row", "pos", "id")


def _next_to(positions: DataFrame) -> DataFrame:
    """``row, pos, a, b``: numbers at adjacent positions."""
    order = Window.partitionBy("row").orderBy("pos")
    both = positions.select("row", "pos", F.col("id").alias("a"), F.lead("id").over(order).alias("b"), F.lead("pos").over(order).alias("next"))
    return both.where("next = pos + 1").select("row", "pos", "a", "b")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, covered: int = 80, top: int | None = 2000, known: int = KNOWN) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the phrases of two to ``longest`` words that hold together best.

    A phrase counts (``a``) wherever its words stand one after another in a piece, overlaps included; ``n`` counts all
    words of the language. Phrases with a count of ``least`` or more are candidates. ``l`` and ``r`` are the counts of
    the two parts at the cut with the lowest floor(2000000 a / (l + r)), the first such cut if several have it. A candidate
    goes if a longer one that holds it has ``covered`` hundredths of its count. ``rank`` goes by score and count
    downward, then by the phrase's bytes; ``top`` None returns all.

    A null language is ``und``, a null text empty; rows that share an id, repeated rows and ties count as they stand. An
    empty table gives an empty result. Other columns are not read. Arithmetic is exact in decimals of 38 digits.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more, and counts of one or more")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    counts = written(texts.mapInArrow(_count_words, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = numbered(counts.where(F.col("n") >= least))
    sizes = [frequent.count()]

    @functools.cache
    def pairs_of(level: int) -> Pairs:
        key = F.col("a") * F.lit(sizes[level]).cast("bigint") + F.col("b")
        found = levels[level].select(key.alias("key"), F.col("id").cast("int").alias("id")).toArrow()  # ``known`` rows or fewer
        return Pairs(*[found.column(k).to_numpy() for k in range(2)], base=sizes[level])

    levels: list[DataFrame] = []  # of pairs: a, b (of the level before), n, id
    documents = positions = None
    if sizes[0] <= min(known, KNOWN_WORDS):
        found = frequent.select("lang", "word", "id").toArrow()
        of: dict[str, dict[bytes, int]] = {}
        for lang, word, name in zip(*[c.to_pylist() for c in found.columns]):
            of.setdefault(lang, {})[word] = name
        sent = spark.sparkContext.broadcast(of)

        def name_words(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):  # ids of few documents at once
                    out = []
                    for lang, text in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                        names, ids = sent.value.get(lang, {}), []
                        for words in pieces(text):
                            ids += [names.get(w, -1) for w in words]
                            ids.append(-1)
                        out.append(np.array(ids, "<i4").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

        documents = written(texts.mapInArrow(name_words, "ids binary"), "positions")
    for level in range(longest - 1):
        if positions is None and (documents is None or max(sizes) > known):  # beyond what is sent: positions are rows, and numbers come by joins
            rows = written(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
            positions = written(_positions(rows, frequent), "positions")
            for pairs in levels:
                positions = written(_next_to(positions).join(pairs, ["a", "b"]).select("row", "pos", "id"), "positions")
        if positions is None:
            tables = spark.sparkContext.broadcast([pairs_of(k) for k in range(level)])

            def count_pairs(batches, tables=tables):
                for ids in _streams(batches):
                    for pairs in tables.value:
                        ids = pairs.of(ids)
                    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
                    if len(at):
                        base = int(ids.max()) + 1
                        keys, n = np.unique(ids[at] * base + ids[at + 1], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(keys // base), pa.array(keys % base), pa.array(n)], ["a", "b", "n"])

            adjacent = documents.mapInArrow(count_pairs, "a bigint, b bigint, n bigint")
        else:
            adjacent = _next_to(positions).select("a", "b", F.lit(1).cast("bigint").alias("n"))
        found = numbered(adjacent.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        levels.append(found)
        sizes.append(found.count())
        if not sizes[-1]:
            break
        if positions is not None and level < longest - 2:
            positions = written(_next_to(positions).join(found, ["a", "b"]).select("row", "pos", "id"), "positions")

    # first, last: counts of the phrase's first one, two and more words, and of its last ones.
    named = frequent.select("id", "lang", F.col("word").cast("string").alias("phrase"), F.col("n").alias("a"), F.array("n").alias("first"), F.array("n").alias("last"), F.col("word").cast("string").alias("end"))
    kept = []
    for k, pairs in enumerate(levels):
        left = named.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"), F.col("first").alias("first"))
        right = named.select(F.col("id").alias("b"), "end", F.col("last").alias("last"))
        whole = pairs.select("id", "a", "b", F.col("n")).join(left, "a").join(right, "b")
        grown = written(whole.select("id", F.col("a").alias("up"), F.col("b").alias("down"), "lang", F.concat_ws(" ", "head", "end").alias("phrase"), F.col("n").alias("a"), F.concat("first", F.array("n")).alias("first"), F.concat("last", F.array("n")).alias("last"), "end"), "grams")
        if kept:  # what a longer phrase covers goes; the longer ones that hold a phrase and one more word decide it
            kept[-1] = _uncovered(kept[-1], grown, covered)
        kept.append(grown)
        named = grown
    if not kept:
        return totals.select("lang", F.lit(1).cast("bigint").alias("rank"), F.lit("").alias("phrase"), *[F.lit(0).cast("bigint").alias(c) for c in "alr"], F.col("total").alias("n"), F.lit(0).cast("bigint").alias("score")).where("false")
    columns = ["lang", "phrase", "a", "first", "last"]
    scored = functools.reduce(DataFrame.unionByName, [_scored(k + 2, grams.select(*columns)) for k, grams in enumerate(kept)])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
        scored = scored.withColumn("__rank", F.row_number().over(salted)).where(F.col("__rank") <= top).drop("__rank")
    else:
        return _ranked_all(scored, order).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _uncovered(grams: DataFrame, longer: DataFrame, covered: int) -> DataFrame:
    """A phrase's count is at most that of what it holds, so of all longer phrases those with one more word count most."""
    held = longer.select(F.explode(F.array("up", "down")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("most"))
    exact = "CAST(100 AS decimal(38,0)) * most >= CAST({} AS decimal(38,0)) * a".format(covered)
    return grams.join(held, "id", "left").where(F.col("most").isNull() | ~F.expr(exact)).drop("most")


def _scored(words: int, grams: DataFrame) -> DataFrame:
    """``l, r, score`` of the lowest cut; ``first[k - 1]`` counts the first k words, ``last[k - 1]`` the last k."""
    cuts = []
    for k in range(1, words):
        l, r = F.col("first")[k - 1], F.col("last")[words - k - 1]
        wide = (l.cast("decimal(20,0)") + r.cast("decimal(20,0)")).cast("decimal(21,0)")
        score = F.floor(F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(2000000).cast("decimal(8,0)"), wide))
        cuts.append(F.struct(score.cast("bigint").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    best = F.array_min(F.array(*cuts))
    return grams.select("lang", "phrase", "a", best.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def _ranked_all(scored: DataFrame, order: list) -> DataFrame:
    """Ranks of any number of phrases: those of ranges by the rows before, so that no language is sorted in one task."""
    ranged = cut(scored.repartitionByRange("lang", *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("lang", "part").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("lang").orderBy("part")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    return ranged.withColumn("__rank", within).join(before, ["lang", "part"]).withColumn("rank", F.col("__rank") + F.col("before")).drop("__rank", "before", "part")


def collocation_report(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first 2000 phrases of each language."""
    return collocations(docs)


#: The same rows in DuckDB.
REPORT_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
piece AS (
  SELECT d, lang, unnest(list_transform(range(1, len(p) + 1), lambda i: {'i': i, 'w': regexp_extract_all(p[i], '[^\x20\x09]+')})) AS x
  FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS p FROM texts)),
words AS (SELECT lang, x.w AS w FROM piece WHERE len(x.w) > 0),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidate AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, l.a AS l, r.a AS r, cut,
         (2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidate) c
  JOIN f l ON l.lang = c.lang AND l.k = c.cut AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - c.cut AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT lang, k, a, array_to_string(w[i:i + m - 1], ' ') AS part, m
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidate))),
covered AS (
  SELECT DISTINCT o.lang, o.k, o.phrase FROM lowest o
  JOIN inside i ON i.lang = o.lang AND i.m = o.k AND i.part = o.phrase AND 100::HUGEINT * i.a >= 80::HUGEINT * o.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest ANTI JOIN covered USING (lang, k, phrase))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
