"""Similarity join of documents by the Jaccard similarity of their word shingles, with token-combination prefixes.

Tokens (shingles) have one order: rare classes before frequent ones. A set that may miss ``t`` of its tokens in a partner
shares with each partner more than ``t`` of what its prefix indexes, wherever the prefix holds ``t + 1`` credits: a token of
the rare class is a credit of its own; tokens of a frequent class stand in groups, and a group of c prefix tokens indexes
all its combinations of k and gives c - k + 1 credits, for so many have to miss before no combination is left. The prefix
grows until the credits suffice. Sets that share no index entry cannot be similar.

Entries that one set alone has are credits that need no row. In each bucket of an entry the sets meet in rounds: one set (then
sixteen, 256 and on) of those outside the bucket's largest component meets all sets of other components, the pairs are verified
on the texts, and components grow. A bucket is done when one component holds what is left of it, so groups of near copies cost
their members, not their pairs, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written
from .simhash_dedup import components

SHINGLE, SIMILAR = 4, 85
#: Tokens in more documents than these numbers stand in pairs and in threes; a thousandth of a table of 2^32 tokens and more.
PAIRS, THREES = 32, 4096
#: Most bits that name a slot of the table of token classes (two bits a slot), and most frequent tokens that it is to hold.
SLOTS, FREQUENT = 26, 1 << 22
#: Tokens that a task sorts at once, and about as many a range of the count.
SORTED = 1 << 21
#: Members that meet one copy of a set's text.
MEET = 64
#: Entries of a set by which a pair that meets by one of them is known later.
FIRST = 8
#: Words that a Python worker remembers.
REMEMBERED = 1 << 19

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Words(dict):
    """Word -> 64 bits."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 7)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


_WORDS = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, every one of which hangs on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def tokens(text: bytes | None, words: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit values; of fewer words, all of them as one; of none, nothing."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    total = np.full(n, min(len(found), words), np.uint64)
    for k in range(min(words, len(found))):
        total = mixed(total + values[k : k + n] * _ODD[k % 4])
    return np.unique(total)


def name_of(found: np.ndarray) -> int:
    """64 signed bits that name a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), len(found))).astype(np.int64))


def missing(n: int, similar: int) -> int:
    """How many of n tokens a partner may lack: it has ``similar`` hundredths of all that either has."""
    return n - -(-n * similar // 100)


def levels(n: int, similar: int) -> range:
    """Powers of two of the sizes of a set of n and of all its partners."""
    return range((-(-n * similar // 100)).bit_length(), (n * 100 // similar).bit_length() + 1)


def chosen(groups: np.ndarray, k: int, need: int) -> tuple[int, int]:
    """How many tokens, in order, give ``need`` credits in groups whose combinations are of k; and the credits they give."""
    order = np.argsort(groups, kind="stable")
    at = groups[order]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    credit = np.zeros(len(at), np.int64)
    credit[order] = nth >= k - 1
    total = np.cumsum(credit)
    if not len(total) or total[-1] < need:
        return len(at), int(total[-1]) if len(total) else 0
    return int(np.searchsorted(total, need)) + 1, need


def combined(found: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """A value for each combination of two or three tokens of one group."""
    order = np.argsort(groups, kind="stable")
    found, groups = found[order], groups[order]
    most = int(np.unique(groups, return_counts=True)[1].max(initial=0))
    out = []
    for i in range(1, most):
        pair = np.flatnonzero(groups[i:] == groups[:-i])
        if not len(pair):
            break
        first = mixed(found[pair] + found[pair + i] * _ODD[1])
        if k == 2:
            out.append(first)
            continue
        for j in range(i + 1, most):
            inside = pair + j < len(found)
            third = inside.copy()
            third[inside] = groups[pair[inside] + j] == groups[pair[inside]]
            if not third.any():
                break
            out.append(mixed(first[third] + found[pair[third] + j] * _ODD[2]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def entries(found: np.ndarray, classes: np.ndarray, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """What a set is indexed by, and for each entry how many of the set's tokens a partner lacks if it shares no earlier one.

    ``classes``: 0 for tokens that no other document has, then 1, 2, 3 as they grow frequent. The tokens before a single
    one are not shared by a partner whose first shared token it is; a partner that shares combinations only
    shares no token of the two rare classes.
    """
    n, out, places = len(found), [], []
    need = missing(n, similar) + 1
    alone = int((classes == 0).sum())
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if alone >= need:
        return empty
    mine = found[classes == 1][: need - alone]
    for level in levels(n, similar):
        tag = np.uint64(level)
        if level <= 3:  # sets of up to seven: every token by itself
            rest = found[np.argsort(classes, kind="stable")][alone:need]
            out.append(mixed(rest + tag))
            places.append(alone + np.arange(len(rest)))
            continue
        out.append(mixed(mine + tag))
        places.append(alone + np.arange(len(mine)))
        left = need - alone - len(mine)
        for k in (2, 3):
            if left <= 0:
                break
            some = found[classes == k]
            groups = mixed(some + np.uint64(level * int(_ODD[3]) % (1 << 64))) % np.uint64(max(1, 2**level // 32))
            upto, credits = chosen(groups, k, left)
            out.append(mixed(combined(some[:upto], groups[:upto], k) + tag))
            places.append(np.full(len(out[-1]), alone + len(mine)))
            left -= credits
        if left > 0:
            raise ValueError("the groups of a level leave too few credits")
    if not out:
        return empty
    values, first = np.unique(np.concatenate(out), return_index=True)
    return values, np.concatenate(places)[first]


class Classes:
    """The class of each token, from a table of two bits a slot."""

    def __init__(self, table: bytes, bits: int):
        self.table, self.bits = np.frombuffer(table, np.uint8), bits

    def of(self, found: np.ndarray) -> np.ndarray:
        slot = found >> np.uint64(64 - self.bits)
        return self.table[(slot >> np.uint64(2)).astype(np.int64)] >> ((slot & np.uint64(3)) * np.uint64(2)).astype(np.uint8) & 3


def _packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit values as steps, byte planes apart (the upper ones are nearly all zero), then counts up to 255."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return np.concatenate([steps.view(np.uint8).reshape(-1, 4).T.ravel(), np.minimum(counts, 255).astype(np.uint8)]).tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.uint64).astype(np.uint32), planes[4].astype(np.int64)


def token_classes(texts: DataFrame, total: int, words: int) -> tuple[bytes, int]:
    """The table of token classes by the number of documents that hold a token, and its bits.

    Counts are of 32 bits of each token, in ranges that Spark deals out; a slot takes the highest class of its tokens, which
    leaves every result as it is. The table has 16 MB at most.
    """
    bits = min(SLOTS, max(10, (total + 1).bit_length() + 4))
    span = min(bits - 2, max(4, (total // SORTED).bit_length()))  # 2^span ranges
    pairs = max(PAIRS, total // FREQUENT)
    threes = pairs * (THREES // PAIRS)

    def count(batches):
        held, n = [], 0

        def ranges():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(values, np.arange(1 << span, dtype=np.uint64) << np.uint64(32 - span)).tolist() + [len(values)]
            some = [k for k in range(1 << span) if edges[k + 1] > edges[k]]
            blobs = [_packed(values[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]]) for k in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["span", "packed"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = tokens(text, words)
                held.append((found >> np.uint64(32)).astype(np.uint32))
                n += len(found)
                if n >= SORTED:
                    yield ranges()
                    held, n = [], 0
        if n:
            yield ranges()

    def classed(at: int, held: list) -> bytes:
        values, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        counts, values = np.add.reduceat(counts, starts), values[starts]
        kind = (counts > 1).astype(np.uint8) + (counts > pairs) + (counts > threes)
        slots = np.zeros(1 << (bits - span), np.uint8)
        place = (values >> np.uint32(32 - bits)).astype(np.int64) - (at << (bits - span))
        np.maximum.at(slots, place, kind.astype(np.uint8))
        four = slots.reshape(-1, 4)
        return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()

    def classify(batches):
        now, held = None, []
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != now and held:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([classed(now, held)], pa.binary())], ["span", "slots"])
                    held = []
                now = at
                held.append(_unpacked(blob))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([classed(now, held)], pa.binary())], ["span", "slots"])

    counted = texts.mapInArrow(count, "span int, packed binary").repartition("span").sortWithinPartitions("span")
    table = bytearray(1 << (bits - 2))
    size = 1 << (bits - span - 2)
    for row in counted.mapInArrow(classify, "span int, slots binary").toLocalIterator():
        table[row[0] * size : (row[0] + 1) * size] = row[1]
    return bytes(table), bits


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entry, alone, node, n, place), sorted, of entries that two nodes or more have, once each, with what the bucket's
    first row has: the set with the fewest tokens of its own, which is near most others of a group of near copies."""
    names = ["entry", "alone", "node", "n", "place"]
    held = np.zeros((5, 0), np.int64)  # the last row, if it is all that its entry has so far
    last = center = None  # else: the last row, and the first of its entry
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        rows = np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        entry, node = rows[0], rows[2]
        new = np.concatenate(([True], (entry[1:] != entry[:-1]) | (node[1:] != node[:-1])))
        if last is not None and entry[0] == last[0] and node[0] == last[2]:  # and what repeats it
            new[0] = False
        rows = rows[:, new]
        if not rows.shape[1]:
            held = held[:, :0]
            continue
        entry = rows[0]
        starts = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1])))
        sizes = np.diff(np.append(starts, len(entry)))
        first, size0 = rows[:, np.repeat(starts, sizes)], np.repeat(sizes, sizes)
        if last is not None and entry[0] == last[0]:
            first[:, : sizes[0]] = np.array(center)[:, None]
            size0[: sizes[0]] += 1
        keep = size0 > 1
        single = not keep[-1]
        held = rows[:, -1:] if single else rows[:, :0]
        if single:
            last = center = None
        else:
            last, center = rows[:, -1].tolist(), first[:, -1].tolist()
        out = rows[:, keep]
        if out.shape[1]:
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), *map(pa.array, first[2:, keep])], [*names, "center", "m", "place0"])


def _may_link(similar: int, a: tuple[str, str], b: tuple[str, str]) -> str:
    """Whether sets of sizes ``n``, ``m`` with places ``p``, ``q`` of an entry may be similar where it is the first they share.

    They need ``similar`` shared tokens of each hundred and ``similar`` of both sizes, and share at most what follows.
    """
    (n, p), (m, q) = a, b
    return f"100 * least({n}, {m}) >= {similar} * greatest({n}, {m}) AND {100 + similar} * least({n} - {p}, {m} - {q}) >= {similar} * ({n} + {m})"


def _first_entries(rows: DataFrame, node: str, place: str, name: str) -> DataFrame:
    """Each node and its FIRST smallest entries with their places."""
    entry = F.struct("entry", F.col(place).alias("place"))
    return rows.groupBy(node).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, FIRST).alias(name))


def meetings(centers: DataFrame, others: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b; a < b) of ``centers`` (entry, a, m, place0, from) and ``others`` (entry, node, n, place, root) of other
    components that may be similar by an entry that both have.

    Near copies share most of their entries. A pair is left out where it meets by a smaller entry that is among the first ones
    of both; so all pairs stay, and nearly all of them once.
    """
    mine, theirs = _first_entries(centers, "a", "place0", "firsts0"), _first_entries(others, "node", "place", "firsts")
    met = _may_link(similar, ("n", "place"), ("m", "place0"))
    before = f"exists(firsts0, x -> x.entry < entry AND exists(firsts, y -> y.entry = x.entry AND {_may_link(similar, ('n', 'y.place'), ('m', 'x.place'))}))"
    known = centers.join(mine, "a").withColumnRenamed("entry", "entry0")
    both = known.join(others.join(theirs, "node"), F.expr(f"entry0 = entry AND root <> from AND {met} AND NOT {before}"))
    return both.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def outside_first(rows: DataFrame) -> DataFrame:
    """The ``rows`` (entry, alone, node, n, place, root) of buckets with several components, and the ``turn`` of each that is outside the
    bucket's largest one (null inside it). A bucket's rows are passed once, without a join of the rows with what is said of them."""
    bucket = Window.partitionBy("entry")
    shares = rows.withColumn("share", F.count(F.lit(1)).over(Window.partitionBy("entry", "root")))
    top = shares.select("*", F.max(F.struct("share", "root")).over(bucket).alias("top"), F.min("root").over(bucket).alias("least"), F.max("root").over(bucket).alias("most"))
    several = top.where("least <> most").select("entry", "alone", "node", "n", "place", "root", (F.col("root") != F.col("top.root")).alias("outside"))
    turn = F.row_number().over(Window.partitionBy("entry", "outside").orderBy("alone", "node"))
    return several.withColumn("turn", F.when(F.col("outside"), turn)).drop("outside")


def linked(pairs: DataFrame, texts: DataFrame, *, words: int, similar: int) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose texts are similar; the text of ``a`` meets ``MEET`` of its partners at once."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    centers = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), "text")
    rows = members.unionByName(centers).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").isNotNull())

    def work(batches):
        now, mine = None, None
        for batch in batches:
            found = []
            for a, part, b, text in zip(*[c.to_pylist() for c in batch.columns]):
                own = tokens(text, words)
                if b is None:
                    now, mine = (a, part), own
                    continue
                assert now == (a, part)
                shared = int(np.isin(own, mine, assume_unique=True, kind="sort").sum())
                if 100 * shared >= similar * (len(own) + len(mine) - shared):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], ["a", "b"])

    return rows.mapInArrow(work, "a bigint, b bigint")


def similar_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """``doc, n, component`` of every row: the size of its set of shingles, and the smallest id reachable by links.

    Two rows link when the shingles that both have are ``similar`` hundredths of those that either has. Texts with the same
    set are one node. A null or empty text, or one without words, has an empty set and links with nothing. Rows that
    share an id are nodes of their own where their texts differ; a null id counts as none, so a component of null ids
    only has none. An empty table gives an empty result; other columns are not read.
    """
    if not 60 <= similar <= 100:
        raise ValueError("similar is in hundredths, from 60 to 100: below, groups leave too few credits")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))

    def measure(batches):
        for batch in batches:
            found = [tokens(t, words) for t in batch.column(2).to_pylist()]
            names = pa.array([name_of(x) if len(x) else None for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, found), pa.int64()), names], ["doc", "row", "n", "node"])

    sets = written(rows.mapInArrow(measure, "doc bigint, row bigint, n bigint, node bigint"), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    table, bits = token_classes(rows.select("text"), total, words)
    sent = spark.sparkContext.broadcast(table)

    def index(batches):
        classes, seen = Classes(sent.value, bits), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for text in batch.column(0).slice(at, 512).to_pylist():
                    found = tokens(text, words)
                    name = name_of(found) if len(found) else None
                    if name is None or name in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(name)
                    kinds = classes.of(found)
                    mine, places = entries(found, kinds, similar)
                    own = [np.full(len(mine), x) for x in (int((kinds == 0).sum()), name, len(found))]
                    out.append((mine.view(np.int64), *own, places))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["entry", "alone", "node", "n", "place"])

    row = "entry bigint, alone bigint, node bigint, n bigint, place bigint"
    indexed = rows.select("text").mapInArrow(index, row)
    dealt = indexed.repartition("entry").sortWithinPartitions("entry", "alone", "node")
    buckets = written(dealt.mapInArrow(_shared, row + ", center bigint, m bigint, place0 bigint"), "buckets")

    rank = F.struct(F.col("doc").isNull().alias("none"), "doc", "row")
    wanted = sets.join(buckets.select("node").distinct(), "node").groupBy("node").agg(F.min(rank).alias("who")).select("node", F.col("who.doc").alias("__doc"), F.col("who.row").alias("__row"))
    held = rows.join(wanted, (rows["row"] == wanted["__row"]) & rows["doc"].eqNullSafe(wanted["__doc"])).select("node", "text")
    again = sets.groupBy("doc", "row").count().where("count > 1").limit(1)  # rows that are there twice
    texts = written(held if again.isEmpty() else held.dropDuplicates(["node"]), "texts")

    met = _may_link(similar, ("n", "place"), ("m", "place0"))
    pairs = buckets.where(f"node <> center AND {met}").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    left = buckets.where("node <> center").select("entry", "alone", "node", "n", "place")  # a center has met all others
    links, checked, width, roots = None, None, 16, spark.createDataFrame([], "node bigint, root bigint")
    while True:
        pairs = cut(pairs)
        if not pairs.isEmpty():
            checked = pairs if checked is None else checked.unionByName(pairs)
            found = cut(linked(pairs, texts, words=words, similar=similar))
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                roots = cut(components(links))
        open_rows = written(outside_first(left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))), "buckets")
        if open_rows.isEmpty():
            break
        centers = open_rows.where(F.col("turn") <= width).select("entry", F.col("node").alias("a"), F.col("n").alias("m"), F.col("place").alias("place0"), F.col("root").alias("from"))
        pairs = meetings(centers, open_rows, similar)
        if checked is not None:
            before = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        left = open_rows.where(F.col("turn").isNull() | (F.col("turn") > width)).select("entry", "alone", "node", "n", "place")
        width *= 16

    firsts = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("first"))
    tops = firsts.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = tops.join(tops.groupBy("root").agg(F.min("first").alias("component")), "root").select("node", "component")
    return sets.join(named, "node", "left").select("doc", "n", F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component"))


def join_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    return similar_sets(docs).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: The same rows in DuckDB.
REPORT_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM words),
class AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
token AS (SELECT rep, n, unnest(s) AS t FROM class),
pair AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS shared
  FROM token a JOIN token b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * shared >= 85 * (n + m - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT rep AS node, rep AS other FROM class
  UNION
  SELECT reach.node, edge.b FROM reach JOIN edge ON edge.a = reach.other),
top AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(top.root, doc_id)::BIGINT AS component_id
FROM sets LEFT JOIN class ON class.s = sets.s LEFT JOIN top ON top.node = class.rep
"""
