"""SimHash near-duplicate groups by bit-sliced comparison.

Distinct fingerprints are dealt to buckets of equal blocks (two fingerprints that differ in ``radius`` bits
agree in all but ``radius`` of any number of blocks). Inside a bucket, bit planes hold one bit of 64
fingerprints in each machine word, carry-save counters add up the differing bits of all of them at once,
and words whose 64 distances all exceed the radius are abandoned. A bucket returns a spanning star of what
it links, not its pairs; stars are contracted to components by joins.

Fingerprints only nominate near copies: ``drop_near_duplicates`` compares the five-word shingles of the texts.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_BASE = np.arange(0, 2048, 256, dtype=np.int64)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Shingles of a long text are counted in pieces of this many.
PIECE = 1 << 16


def shingles(text: str | None, words: int) -> Iterator[bytes]:
    """The word shingles of a text, repeats included; of fewer words, all of them; of none, nothing."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return iter(())
    if len(found) < words:
        return iter((b" ".join(found),))
    return map(b" ".join, zip(*(found[k:] for k in range(words))))


def fingerprint(text: str | None, words: int = 3, seed: int = 42, distinct: bool = False) -> int:
    """64 bits, each set where more than half of the (distinct) shingles' XXH64 values set it; 0 without words."""
    counts, n, digest = np.zeros((8, 8), np.int64), 0, xxhash.xxh64_intdigest
    todo = iter(set(shingles(text, words))) if distinct else shingles(text, words)
    while piece := list(itertools.islice(todo, PIECE)):
        hashes = np.fromiter((digest(x, seed) for x in piece), np.uint64, len(piece))
        octets = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_BASE
        counts += np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        n += len(piece)
    return int.from_bytes(np.packbits(counts * 2 > n, axis=1).tobytes(), "little")


def block_masks(blocks: int, equal: int) -> list[int]:
    """A 64-bit mask for each choice of ``equal`` of ``blocks`` blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    spans = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in itertools.combinations(spans, equal)]


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words) array: bit b of the plane p is bit p of the value b, padded with zeros."""
    lanes = -(-len(values) // 64) * 64
    octets = np.zeros((lanes, 8), np.uint8)
    octets[: len(values)] = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, radius: int, query: int = 0) -> np.ndarray:
    """A mask, as words of 64 lanes: lanes that differ from ``query`` in ``radius`` bits or fewer."""
    width = (radius + 1).bit_length()
    alive = np.arange(planes.shape[1])
    out = np.zeros(len(alive), np.uint64)
    bias = (1 << width) - (radius + 1)  # the counter overflows at radius + 1
    counters = [np.full(len(alive), _ALL if bias >> k & 1 else 0, np.uint64) for k in range(width)]
    over = np.zeros(len(alive), np.uint64)
    whole = True
    for p in range(64):
        carry = planes[p] if whole else planes[p, alive]
        if query >> p & 1:
            carry = ~carry
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 4 == 3:
            open_words = over != _ALL
            left = int(open_words.sum())
            if not left:
                return out
            if left <= 0.75 * len(alive):
                alive, over, whole = alive[open_words], over[open_words], False
                counters = [c[open_words] for c in counters]
    out[alive] = ~over
    return out


def lanes_of(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


#: Buckets up to this many fingerprints share words with others; up to the second number, all pairs of a bucket fill
#: words together; larger ones are searched one fingerprint at a time.
SMALL, MIDDLE = 24, 512
#: Pairs of small buckets that are compared at once.
CHUNK = 1 << 18


class _Stars:
    """Links fingerprints of one batch of buckets; ``edges`` has each with the smallest of its group."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, a: int) -> int:
        up = self.up
        while (b := up.get(a, a)) != a:
            up[a] = up.get(b, b)
            a = b
        return a

    def link(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(a, self.top(a)) for a in list(self.up)]


class Check(NamedTuple):
    """A second fingerprint of each node, and how far apart linked ones may be."""

    values: np.ndarray
    radius: int

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.values[a] ^ self.values[b]) <= self.radius


def link_large(values: np.ndarray, radius: int, stars: _Stars, names: np.ndarray, check: Check | None = None) -> None:
    """Breadth-first search in one bucket; lanes already reached leave the planes."""
    rest, todo = np.arange(len(values)), []
    planes = bit_planes(values)
    reached = np.zeros(len(rest), bool)
    cursor = 0
    while True:
        if not todo:
            while cursor < len(rest) and reached[cursor]:
                cursor += 1
            if cursor == len(rest):
                return
            reached[cursor] = True
            todo.append(int(rest[cursor]))
        query = todo.pop()
        near = lanes_of(within(planes, radius, int(values[query])), len(rest))
        near = near[~reached[near]]
        if check is not None:
            near = near[check.close(rest[near], np.full(len(near), query))]
        reached[near] = True
        for other in rest[near].tolist():
            stars.link(int(names[query]), int(names[other]))
            todo.append(other)
        if len(rest) > 256 and reached.sum() * 2 > len(rest):
            rest, reached, cursor = rest[~reached], np.zeros(int((~reached).sum()), bool), 0
            planes = bit_planes(values[rest])


def link_middle(values: np.ndarray, radius: int, stars: _Stars, names: np.ndarray, check: Check | None = None) -> None:
    """All pairs of one bucket, 64 to a word."""
    a, b = np.triu_indices(len(values), 1)
    hit = lanes_of(within(bit_planes(values[a] ^ values[b]), radius), len(a))
    a, b = a[hit], b[hit]
    if check is not None:
        close = check.close(a, b)
        a, b = a[close], b[close]
    for x, y in zip(names[a].tolist(), names[b].tolist()):
        stars.link(x, y)


def link_small(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, stars: _Stars, names: np.ndarray, check: Check | None = None) -> None:
    """Many small buckets: lane by lane against the lane ``step`` places on, 64 to a word."""
    for step in range(1, int(sizes.max(initial=0))):
        wide = sizes > step
        n = sizes[wide] - step
        first = np.repeat(starts[wide] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        for at in range(0, len(first), CHUNK):
            a = first[at : at + CHUNK]
            hit = a[lanes_of(within(bit_planes(values[a] ^ values[a + step]), radius), len(a))]
            if check is not None:
                hit = hit[check.close(hit, hit + step)]
            for x, y in zip(names[hit].tolist(), names[hit + step].tolist()):
                stars.link(x, y)


def dealt(batches, most: int | None) -> Iterator[tuple[np.ndarray, tuple | None]]:
    """Rows (t, key, fp and more) of whole buckets; those of a bucket beyond ``most`` flow on in parts, with its key."""
    held, flowing = None, None
    for batch in itertools.chain(batches, (None,)):
        if batch is not None:
            part = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            held = part if held is None else np.concatenate((held, part), axis=1)
        if held is None or not held.shape[1]:
            continue
        tail = int(np.argmax((held[:2] == held[:2, -1:]).all(axis=0)))  # sorted: the open bucket ends the rows
        end = held.shape[1] if batch is None else tail
        done, held = held[:, :end], held[:, end:]
        if done.shape[1]:
            yield done, flowing
        if batch is not None and most is not None and (held.shape[1] > most or flowing == (held[0, 0], held[1, 0])):
            flowing = (held[0, 0], held[1, 0])
            yield held, flowing
            held = held[:, :0]


def bucket_rows(nodes: DataFrame, blocks: int, equal: int) -> DataFrame:
    """``t, key`` and the columns of ``nodes``: a row for each choice of blocks that have to be equal."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, equal)]
    choices = F.array(*[F.struct(F.lit(k).cast("bigint").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for k, m in enumerate(signed)])
    return nodes.select(*nodes.columns, F.explode(choices).alias("x")).select("x.t", "x.key", *nodes.columns)


def link_buckets(rows: DataFrame, *, radius: int, most: int | None, second: int | None = None) -> DataFrame:
    """``a``, ``b``: stars of linked nodes. Of buckets beyond ``most``, the members with a null ``b`` instead.

    ``rows`` has ``t, key, fp`` of the members of each bucket, whose name is the fingerprint; with ``second``, also
    ``fp2`` and ``node``, and nodes link only if their second fingerprints differ in that many bits or fewer too.
    """
    more = [] if second is None else ["fp2", "node"]
    rows = rows.select("t", "key", "fp", *more).repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def work(batches):
        for rows, flowing in dealt(batches, most):
            t, key, fp = rows[:3]
            names = fp if second is None else rows[4]
            stars, beyond = _Stars(), [np.zeros(0, np.int64)]
            starts = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]))))
            sizes = np.diff(np.append(starts, len(t)))
            values, labels = (np.ascontiguousarray(x).view(np.uint64) for x in (fp, names))
            other = None if second is None else np.ascontiguousarray(rows[3]).view(np.uint64)
            small = sizes <= SMALL
            if flowing == (t[0], key[0]):
                beyond.append(names[: sizes[0]])
                starts, sizes, small = starts[1:], sizes[1:], small[1:]
            link_small(values, starts[small], sizes[small], radius, stars, labels, None if other is None else Check(other, second))
            for at, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
                if most is not None and n > most:
                    beyond.append(names[at : at + n])
                else:
                    link = link_middle if n <= MIDDLE else link_large
                    link(values[at : at + n], radius, stars, labels[at : at + n], None if other is None else Check(other[at : at + n], second))
            edges = np.array(stars.edges(), np.uint64).reshape(-1, 2).view(np.int64)
            rest = np.concatenate(beyond)
            a = pa.array(np.concatenate([edges[:, 0], rest]))
            b = pa.array(np.concatenate([edges[:, 1], rest]), mask=np.arange(len(edges) + len(rest)) >= len(edges))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return rows.mapInArrow(work, "a bigint, b bigint")


def parted(rows: DataFrame, most: int) -> DataFrame:
    """Buckets beyond ``most`` members as pairs of parts, each a bucket of its own; other buckets as they are.

    Members are dealt to parts by hash, and every two parts meet once, so that no link is lost.
    """
    sizes = rows.groupBy("t", "key").count().where(F.col("count") > most).select("t", "key", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    big = rows.join(sizes, ["t", "key"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
    met = big.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return met.withColumn("key", F.when(F.col("parts").isNull(), F.col("key")).otherwise(pair)).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node that has an edge (``a``, ``b``); the root is its component's smallest.

    Each round joins every node's neighbours to the smallest of them, from above and from below, until
    nothing moves: the edges are then stars. Rounds grow with the logarithm of the nodes. The smallest
    neighbour is aggregated before the shuffle, and its join back is one that skew handling can split.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        met = down.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        now = cut(met.select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct())


#: Largest bucket that one task compares with the first choice of blocks. A larger one is dealt again with more
#: equal blocks, and what is still larger in parts that meet in pairs. No bucket is left out.
MOST = 1 << 16
#: radius -> (blocks, equal) of the first and of the second deal.
DEALS = {0: ((1, 1), (1, 1)), 1: ((3, 2), (4, 3)), 2: ((4, 2), (8, 6)), 3: ((6, 3), (8, 5)), 4: ((7, 3), (9, 5)), 5: ((7, 2), (9, 4)), 6: ((8, 2), (10, 4))}


def deals(radius: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Any radius leaves two blocks equal of two more than the radius, and four of four more."""
    return DEALS.get(radius, ((radius + 2, 2), (radius + 4, 4)))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, most: int = MOST, distinct: bool = False, second: tuple[int, int] | None = None) -> DataFrame:
    """``doc``, ``row`` (hash of the text), ``fp``, ``root`` and ``component`` of every row.

    Rows link when their fingerprints differ in ``radius`` bits or fewer, and the component is the smallest
    id reachable; ``root`` names it where no row has an id. With ``second`` = (words, radius), a fingerprint of
    shingles of so many words must be as close too. ``distinct`` leaves repeated shingles out of the first one.
    Texts without words (null and empty ones too) have fingerprint zero and link like any
    other. Rows that share an id are nodes of their own; a null id counts as none, so a component of null ids only has none.
    Empty tables give empty results; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.struct(F.col(id_col).alias("doc"), F.xxhash64(text).alias("row")).alias("key"), text.alias("text"))
    fields = ["fp"] if second is None else ["fp", "fp2"]

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns = [[fingerprint(t, words, distinct=distinct) for t in texts]]
            if second is not None:
                columns.append([fingerprint(t, second[0]) for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), *[pa.array(np.array(c, np.uint64).view(np.int64), pa.int64()) for c in columns]], ["doc", "row", *fields])

    prints = cut(marked.mapInArrow(work, "doc bigint, row bigint, " + ", ".join(f"{f} bigint" for f in fields)))
    node = F.col("fp") if second is None else F.xxhash64(*fields)
    nodes = cut(prints.groupBy(*fields).agg(F.min("doc").alias("first")).withColumn("node", node))
    near = None if second is None else second[1]
    members = nodes.select("fp") if second is None else nodes.select("fp", "fp2", "node")
    first_deal, second_deal = deals(radius)
    edges = cut(link_buckets(bucket_rows(members, *first_deal), radius=radius, most=most, second=near))
    beyond = edges.where("b IS NULL").select(F.col("a").alias("node")).distinct()
    links = edges.where("b IS NOT NULL")
    if not beyond.isEmpty():
        again = beyond.select(F.col("node").alias("fp")) if second is None else members.join(beyond, "node").select("fp", "fp2", "node")
        links = links.union(link_buckets(parted(bucket_rows(again, *second_deal), most), radius=radius, most=None, second=near))
    tops = nodes.join(components(links), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    firsts = tops.groupBy("root").agg(F.min("first").alias("component"))
    member = tops.join(firsts, "root").select("node", "root", "component")
    return prints.withColumn("node", node).join(member, "node").select("doc", "row", "fp", "root", "component")


#: Words of a shingle, and the share of shingles that near copies have in common (of all that either has).
SHINGLE, SIMILAR = 5, 0.8
#: How near copies are nominated: distinct words within 7 bits, five-word shingles within 18. Texts of similarity 0.8
#: differ in 4 and 10 bits in the mean.
NOMINATED = {"words": 1, "distinct": True, "radius": 7, "second": (SHINGLE, 18)}
#: Texts and bytes up to which a nominated group is one task's work. Of a larger group so many are judged a round, and
#: those of them that stay take their near copies among the rest with them.
GROUP, GROUP_BYTES = 1000, 1 << 24


def hashed_shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit values, a piece of the text at a time."""
    todo, found = shingles(text, words), np.zeros(0, np.uint64)
    while piece := list(itertools.islice(todo, PIECE)):
        found = np.union1d(found, np.fromiter(map(xxhash.xxh64_intdigest, piece), np.uint64, len(piece)))
    return found


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """Shared shingles over all; two texts without words are the same."""
    return len(a & b) / len(a | b) if a or b else 1.0


class Stays:
    """Shingle sets of the texts that stay, as one sorted array of 64-bit shingles and whose they are.

    Sets that were added last wait beside it until they are worth merging, so that a text costs a search in the array and
    a few comparisons, and memory is 12 bytes a shingle.
    """

    WAITING = 48

    def __init__(self, similar: float):
        self.similar, self.sizes, self.waiting = similar, array("q"), []
        self.parts, self.owners = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def add(self, parts: np.ndarray) -> None:
        self.waiting.append((len(self.sizes), parts))
        self.sizes.append(len(parts))
        if len(self.waiting) >= self.WAITING:
            owners = [np.full(len(p), k, np.int32) for k, p in self.waiting]
            every = np.concatenate([self.parts, *[p for _, p in self.waiting]])
            order = np.argsort(every, kind="stable")
            self.parts, self.owners = every[order], np.concatenate([self.owners, *owners])[order]
            self.waiting = []

    def near(self, parts: np.ndarray) -> bool:
        """Whether the ``similarity`` with one that stays is ``similar`` or more."""
        if not len(parts):
            return 0 in self.sizes
        sizes = np.frombuffer(self.sizes, np.int64)
        first = np.searchsorted(self.parts, parts)
        n = np.searchsorted(self.parts, parts, "right") - first
        ends = np.cumsum(n)
        hits = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]))
        shared = np.bincount(self.owners[hits], minlength=len(sizes))
        for k, other in self.waiting:
            if min(len(parts), len(other)) >= self.similar * max(len(parts), len(other)):
                shared[k] = np.isin(parts, other, assume_unique=True).sum()
        return bool((shared >= self.similar * (sizes + len(parts) - shared)).any())


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, **options) -> DataFrame:
    """``doc, row`` of the rows that are near copies of one that stays.

    Texts are the same or have ``similar`` of their five-word shingles in common (A-Z in lower case). In each nominated
    group the smallest id stays and takes its near copies with it, then the smallest of those left, until none is:
    so every row that goes is verified against one that stays, and no two of a group that stay are near copies.
    A null id comes after all others.
    """
    groups = near_groups(docs, id_col=id_col, text_col=text_col, **{**NOMINATED, **options})
    rank = F.struct(F.col("doc").isNull().alias("none"), "doc")
    firsts = cut(groups.groupBy("root", "row").agg(F.min(rank).alias("who"), F.count(F.lit(1)).alias("n")))
    same = groups.join(firsts.where("n > 1"), ["root", "row"]).where(~F.col("doc").eqNullSafe(F.col("who.doc"))).select("doc", "row")
    several = firsts.groupBy("root").count().where("count > 1").select("root")
    keys = firsts.join(several, "root").select("root", "row", "who")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    own = keys.select("root", F.col("row").alias("__row"), F.col("who.doc").alias("__doc"))
    held = texts.join(own, texts["doc"].eqNullSafe(own["__doc"]) & (texts["row"] == own["__row"])).select("root", "doc", "row", "text")
    left, gone = written(held, "near"), [cut(same)]

    def judge(batches, texts):
        """Rows by ``root, part`` and in order; those marked ``stays`` are compared with none, all others with what stays."""
        now, last, stay = None, None, Stays(similar)
        for batch in batches:
            drop = []
            for root, part, stays, *own, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (root, part) != now:
                    now, last, stay = (root, part), None, Stays(similar)
                if own == last:  # rows that share id and text are one
                    drop.append(None)
                    continue
                last, parts = own, hashed_shingles(text)
                drop.append(None if stays else stay.near(parts))
                if stays or (not drop[-1] and stays is not None):
                    stay.add(parts)
            told = pa.array(drop, pa.bool_())
            keep = pc.is_valid(told) if texts else pc.fill_null(told, False)
            root, _, _, doc, row, text = (c.filter(keep) for c in batch.columns)
            told = told.filter(keep)
            yield pa.RecordBatch.from_arrays([root, doc, row, pc.if_else(told, None, text), told], ["root", "doc", "row", "text", "close"])

    def judged(rows: DataFrame, texts: bool = True) -> DataFrame:
        """``stays``: true for a text known to stay, false for one to tell from those before it, null for one to tell from
        those known to stay. Those that go are ``close``; the others, with their texts, are only returned with ``texts``."""
        dealt = rows.select("root", "part", "stays", "doc", "row", "text").repartition("root", "part")
        order = ["root", "part", F.coalesce(~F.col("stays"), F.lit(True)), F.col("doc").isNull(), "doc", "row"]
        return dealt.sortWithinPartitions(*order).mapInArrow(lambda batches: judge(batches, texts), "root bigint, doc bigint, row bigint, text string, close boolean")

    at = F.struct(F.col("doc").isNull().alias("none"), "doc", "row")
    while True:
        sizes = left.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
        marked = left.join(sizes.withColumn("small", (F.col("n") <= GROUP) & (F.col("bytes") <= GROUP_BYTES)), "root")
        alone = marked.where("small").select("root", "doc", "row", "text", F.lit(0).alias("part"), F.lit(False).alias("stays"))
        gone.append(cut(judged(alone, texts=False).select("doc", "row")))
        large = marked.where("NOT small").select("root", "doc", "row", "text", "n", "bytes")
        if large.isEmpty():
            break
        # The first of a group are told in one task; what stays of them meets the rest of the group part by part.
        ranked = large.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.col("doc").isNull(), "doc", "row"))).where(F.col("rank") <= GROUP)
        ahead = F.sum(F.octet_length("text")).over(Window.partitionBy("root").orderBy("rank"))
        first = ranked.withColumn("ahead", ahead).where((F.col("rank") == 1) | (F.col("ahead") <= GROUP_BYTES))
        told = written(judged(first.select("root", "doc", "row", "text", F.lit(0).alias("part"), F.lit(False).alias("stays"))), "near")
        gone.append(told.where("close").select("doc", "row"))
        ends = told.groupBy("root").agg(F.max(at).alias("end"))
        rest = large.join(ends, "root").where(at > F.col("end"))
        parts = F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int")
        rows = rest.select("root", "doc", "row", "text", F.pmod("row", parts).cast("int").alias("part"), F.lit(None).cast("boolean").alias("stays"))
        dealt = large.select("root", parts.alias("parts")).distinct()
        known = told.where("NOT close").join(dealt, "root").select("root", "doc", "row", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("stays"))
        now = written(judged(rows.unionByName(known)), "near")
        gone.append(now.where("close").select("doc", "row"))
        left = now.where("NOT close").select("root", "doc", "row", "text")
    out = gone[0]
    for part in gone[1:]:
        out = out.unionByName(part)
    return out.distinct()


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the near copies of rows that stay; of rows that share id and text, one stays."""
    gone = near_copies(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc").alias("__doc"), F.col("row").alias("__gone"))
    left = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = left.join(gone, left[id_col].cast("bigint").eqNullSafe(gone["__doc"]) & (left["__row"] == gone["__gone"]), "left_anti")
    again = left.groupBy(F.col(id_col).alias("__id"), F.col("__row").alias("__again")).count().where("count > 1").select("__id", "__again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    twice = kept[id_col].eqNullSafe(again["__id"]) & (kept["__row"] == again["__again"])
    return kept.join(again, twice, "left_anti").unionByName(kept.join(again, twice, "left_semi").dropDuplicates([id_col, "__row"])).select(*docs.columns)


def group_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each document."""
    bits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_groups(docs).select(F.col("doc").alias("doc_id"), bits.alias("fingerprint"), F.col("component").alias("component_id"))
