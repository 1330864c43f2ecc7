"""Substring deduplication with compressed FM-indexes.

A repeated window of words has the same anchor wherever it stands: the smallest hash of its five-word runs, those
left aside that a sample shows to be common (a window of common runs only is anchored by its smallest and its
largest one). Anchors found in one document only cannot be part of a repeat, and are dropped on that ground.
Equal texts are one text with the smallest and the largest document that has it; all its stretches go to the index,
and what is found there holds for each of its documents. Stretches of words around the others are collapsed to distinct
ones, each with the smallest document that holds it, and dealt to shards by anchor. A shard indexes its stretches (Burrows-Wheeler transform in a wavelet matrix of packed
bits) and streams them through backward search, which gives matching statistics: for every word, the longest match
that ends there and stands in an earlier document. Matches of a window's length or more are the intervals reported.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, GRAM = 13, 5
#: Windows of one stretch at most; longer ones with the same anchor are cut, overlapping by a window less a word.
STRETCH = 64
#: Words that a shard indexes at once, about.
SHARD = 100_000
#: Documents whose runs are counted to find the common ones: at least and at most, a fiftieth of all in between.
SAMPLED = (5_000, 200_000)
#: Documents of that sample that share a common run or anchor, and most of them that are sent to the tasks (8 bytes each).
HOT, HOTTEST = 6, 200_000
#: Tasks that the occurrences of a stretch with a common anchor are dealt to.
SALTS = 64
#: Stretches whose words a task remembers to have sent.
SENT = 200_000
#: Null ids come before all others, each a key of its own: the lowest numbers, as many as SPAN.
LOWEST, SPAN = -(1 << 63), 1 << 40


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a text that are hashed at once; a longer word is hashed whole.
PIECE = 1 << 20
_BASE, _INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    starts, ends = edge[::2], edge[1::2]
    size = 1 << max(16, int(len(data)).bit_length())
    so_far = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[: len(data)], out=so_far[1:])
    # The polynomial of each word's bytes, brought back to its own first byte.
    return starts, ends, mixed((so_far[ends] - so_far[starts]) * _powers(_INVERSE, size)[starts])


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a text. Hashes only choose anchors; words are compared by their bytes."""
    whole = np.frombuffer(data, np.uint8)
    if len(whole) <= PIECE:
        return _hashed(whole)
    parts, at = [], 0
    while at < len(whole):
        stop = at + PIECE
        while stop < len(whole) and not (found := _BLANK[whole[stop : stop + PIECE]]).any():
            stop += PIECE
        stop = stop + int(found.argmax()) if stop < len(whole) else len(whole)
        starts, ends, hashes = _hashed(whole[at:stop])
        parts.append((starts + at, ends + at, hashes))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts))


def grams(h: np.ndarray) -> np.ndarray:
    """The hash of the five-word run at each word; fewer words than a window have none."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(_BASE) + h[k : k + len(out)]
    return mixed(out)


def sliding(x: np.ndarray, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of the runs in each window."""
    width, wide = 1, x
    while 2 * width <= WINDOW - GRAM + 1:
        wide = best(wide[:-width], wide[width:])
        width *= 2
    rest = WINDOW - GRAM + 1 - width
    return best(wide[:-rest], wide[rest:]) if rest else wide


class Common:
    """A sorted set of hashes; a table of their low bits turns most others away first."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.sort(values)
        self.table = np.zeros(1 << 18, bool)
        self.table[self.values & np.uint64(0x3FFFF)] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.table[x & np.uint64(0x3FFFF)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.values[np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)] == x[at]
        return out


NONE = Common(np.zeros(0, np.uint64))
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def anchors(h: np.ndarray, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window at each word, and whether all its runs are common."""
    g = grams(h)
    if not len(g):
        return g, np.zeros(0, bool)
    out = sliding(np.where(common.has(g), _LAST, g), np.minimum)
    full = out == _LAST
    if full.any():
        out[full] = mixed(sliding(g, np.minimum)[full] * np.uint64(0x9E3779B97F4A7C15) + sliding(g, np.maximum)[full])
    return out, full


def stretches(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run with one anchor, of STRETCH windows at most."""
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    sizes = np.diff(np.append(first, len(found)))
    parts = -(-sizes // STRETCH)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(first, parts) + inner * STRETCH
    return starts, np.minimum(np.repeat(sizes, parts) - inner * STRETCH, STRETCH)


class WaveletMatrix:
    """Rank of any symbol in a sequence: one packed bit vector a level, with a count for every 64 bits."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.words, self.counts, self.zeros = levels, [], [], []
        now = symbols
        for level in reversed(range(levels)):
            bits = (now >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, np.uint8)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed)[:-1], dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate((now[bits == 0], now[bits == 1]))

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & low)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place, less the places of smaller symbols: see ``base``."""
        for k, level in enumerate(reversed(range(self.levels))):
            one = self.ones(k, at)
            at = np.where(symbols >> level & 1, self.zeros[k] + one, at - one)
        return at


class FmIndex:
    """Backward search for patterns of any length in texts that each end with symbol 0."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        n, levels = len(symbols), max(1, int(sigma - 1).bit_length())
        # Suffixes by their first symbols, as many as fit in a number, then by twice as many until they all differ.
        span = max(1, 60 // (levels + 1))
        both = np.zeros(n, np.int64)
        for k in range(span):
            both <<= levels + 1
            both[: n - k] += symbols[k:] + 1
        while True:
            self.order = np.argsort(both)
            ordered = both[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
            if span >= n or rank[self.order[-1]] == n - 1:
                break
            later = np.zeros(n, np.int64)
            later[: n - span] = rank[span:] + 1
            both = rank * (n + 1) + later
            span *= 2
        self.matrix = WaveletMatrix(symbols[self.order - 1], levels)
        every = np.arange(sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))[:sigma]
        self.base = self.matrix.rank(every, np.zeros(sigma, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front."""
        base = self.first[symbol] - self.base[symbol]
        return base + self.matrix.rank(symbol, low), base + self.matrix.rank(symbol, high)


class Smallest:
    """The smallest value of any range, from tables of ranges that double in length."""

    def __init__(self, values: np.ndarray) -> None:
        self.tables = [values]
        while 2 << len(self.tables) - 1 <= len(values):
            half, last = 1 << len(self.tables) - 1, self.tables[-1]
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.empty(len(low), self.tables[0].dtype)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.tables[k][low[own]], self.tables[k][high[own] - (1 << k)])
        return out


class Shard(NamedTuple):
    """Distinct stretches: their texts, numbers of windows, and the smallest document that holds each."""

    texts: list[bytes]
    sizes: np.ndarray
    docs: np.ndarray


def matched(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the stretches, one after the other: the smallest document that it starts in, and the
    matching statistic of its last word, that is the length of the longest match that ends there and stands in a
    smaller document than the stretch's own."""
    parts = [t.split() for t in shard.texts]
    lengths = np.array([len(p) for p in parts])
    ids: dict[bytes, int] = {}
    flat = [ids.setdefault(w, len(ids) + 1) for p in parts for w in p]
    ends = np.cumsum(lengths + 1)  # a separator after each text
    symbols = np.zeros(int(ends[-1]), np.int64)
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(parts)), lengths)] = flat
    index = FmIndex(symbols, len(ids) + 1)
    known, order = np.unique(shard.docs, return_inverse=True)
    order = order.astype(np.int32)
    smallest = Smallest(np.repeat(order, lengths + 1)[index.order])
    first = np.repeat(ends - lengths - 1, shard.sizes)
    last = first + WINDOW - 1 + np.arange(len(first)) - np.repeat(np.cumsum(shard.sizes) - shard.sizes, shard.sizes)
    own = np.repeat(order, shard.sizes)
    least, length = own.copy(), np.zeros(len(own), np.int64)
    active = np.arange(len(own))
    low, high = np.zeros(len(own), np.int64), np.full(len(own), len(symbols), np.int64)
    back = 0
    while len(active):
        low, high = index.extend(symbols[last[active] - back], low, high)
        found = smallest.of(low, high)
        more = found < own[active]
        active, low, high, found = active[more], low[more], high[more], found[more]
        back += 1
        length[active] = back
        if back == WINDOW:
            least[active] = found
        inside = last[active] - back >= first[active]
        active, low, high = active[inside], low[inside], high[inside]
    return known[least], length


def doc_of(key: str | Column) -> Column:
    """The id that a key stands for."""
    c = F.col(key) if isinstance(key, str) else key
    return F.when(c < F.lit(LOWEST + SPAN).cast("bigint"), F.lit(LOWEST).cast("bigint")).otherwise(c)


def sample_of(docs: DataFrame) -> DataFrame:
    total = docs.count()
    least, most = SAMPLED
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(1 << 30)
    return docs.where(place < min(max(least, total // 50), most) / max(1, total))


def hash_rows(docs: DataFrame, found) -> DataFrame:
    """``hash, key``: the distinct hashes that ``found`` gives for each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.unique(found(hashed_words((t or "").encode("utf-8", "surrogatepass"))[2])) for t in batch.column(1).to_pylist()]
            where = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
            values = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), batch.column(0).take(pa.array(where))], ["hash", "key"])

    return docs.select("key", "text").mapInArrow(work, "hash bigint, key bigint")


def frequent(rows: DataFrame) -> Common:
    """The hashes of HOT documents or more, at most HOTTEST. They only choose anchors and tasks, never the result."""
    common = rows.groupBy("hash").count().where(F.col("count") >= HOT)
    return Common(np.array([r["hash"] for r in common.orderBy(F.desc("count"), "hash").limit(HOTTEST).collect()], np.int64).view(np.uint64))


STRETCHES = "anchor bigint, digest bigint, salt int, key bigint, high bigint, row bigint, start int, size int, content binary"


def occurrences(texts: DataFrame, common: Common, spread: Common, frequent_ones: bool) -> DataFrame:
    """STRETCHES around shared anchors, either around ``spread`` ones or around the others in each row's ``shared``
    (all others where a text has several documents, up to ``high``).

    ``content`` has the bytes from the first to the last word; ``digest`` hashes them, and together with the anchor
    stands for them. A task sends the bytes once, nulls for later occurrences. The salt is that of the row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple] = set()
        for batch in batches:
            where, rows = [], []
            several = docs_of(batch.column(0).to_pylist()) < batch.column(4).to_numpy()
            for i, (key, text, shared) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3))):
                wanted = np.sort(shared.values.to_numpy(zero_copy_only=False))
                if not frequent_ones and not len(wanted) and not several[i]:
                    continue
                data = (text or "").encode("utf-8", "surrogatepass")
                begins, stops, h = hashed_words(data)
                found, full = anchors(h, common)
                if not len(found) or frequent_ones and not full.any():
                    continue
                starts, sizes = stretches(found)
                values = found[starts]
                hot = full[starts] & spread.has(values)
                ours = hot if frequent_ones else ~hot if several[i] else among(values.view(np.int64), wanted) & ~hot
                starts, sizes, salt = starts[ours], sizes[ours], (key ^ key >> 32) % SALTS
                places = (starts, sizes, begins[starts], stops[starts + sizes + WINDOW - 2], values[ours].view(np.int64))
                for s, n, b, e, a in zip(*[x.tolist() for x in places]):
                    content = data[b:e]
                    own = (a, xxhash.xxh3_64_intdigest(content))
                    if fresh := (*own, salt if frequent_ones else 0) not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add((*own, salt if frequent_ones else 0))
                    where.append(i)
                    rows.append((*own, salt, s, n, content if fresh else None))
            at = pa.array(where, pa.int64())
            anchors_, digests, salts, starts_, sizes_, contents = zip(*rows) if rows else [[]] * 6
            columns = [pa.array(anchors_, pa.int64()), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(salts, pa.int32()), batch.column(0).take(at), batch.column(4).take(at), batch.column(1).take(at), pa.array(starts_, pa.int32()), pa.array(sizes_, pa.int32()), pa.array(contents, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "digest", "salt", "key", "high", "row", "start", "size", "content"])

    return texts.select("key", "row", "text", "shared", "high").mapInArrow(slices(work), STRETCHES)


def slices(work):
    """``work`` on few rows at once: a row here becomes many."""
    return lambda batches: work(b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512))


def among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns of rows sorted by anchor (the first column), in parts of SHARD words about that leave anchors whole.
    The second column has the number of windows."""
    held: list[list] = []
    words = 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        held = held or [[] for _ in columns]
        at = 0
        for i, (anchor, size) in enumerate(zip(columns[0], columns[1])):
            last = columns[0][i - 1] if i else held[0][-1] if held[0] else anchor
            if words >= SHARD and anchor != last:
                for h, c in zip(held, columns):
                    h += c[at:i]
                yield held
                held, words, at = [[] for _ in columns], 0, i
            words += size + WINDOW
        for h, c in zip(held, columns):
            h += c[at:]
    if held and held[0]:
        yield held


def earliest_of(anchor: list, sizes: list, digests: list, contents: list, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretch that each row is of, the first window of each stretch, and the earliest document of all windows."""
    texts: dict[tuple, int] = {}
    which = np.fromiter((texts.setdefault(x, len(texts)) for x in zip(anchor, digests)), np.int64, len(digests))
    words: list[bytes] = [b""] * len(texts)
    for k, content in zip(which.tolist(), contents):
        if content is not None:
            words[k] = content
    own, windows = np.full(len(texts), np.iinfo(np.int64).max), np.zeros(len(texts), np.int64)
    np.minimum.at(own, which, docs)
    windows[which] = sizes
    earliest, _ = matched(Shard(words, windows, own))
    return which, np.cumsum(windows) - windows, earliest


def docs_of(keys: list) -> np.ndarray:
    out = np.array(keys, np.int64)
    out[out < LOWEST + SPAN] = LOWEST
    return out


PLACE = "struct<row:bigint,first:int,last:int,own:boolean>"


def repeats_in_shards(parts: DataFrame) -> DataFrame:
    """``key, x``: (row, first, last, own) of the words in windows that start in an earlier document, or, ``own``, that
    start in the text's first document, where it has others.

    Each shard is a task's share of the anchors: it indexes their distinct stretches and compares every occurrence.
    """

    def solve(anchor, sizes, digests, contents, keys, highs, rows, starts) -> pa.RecordBatch:
        docs, sizes, starts = docs_of(keys), np.array(sizes, np.int64), np.array(starts, np.int64)
        several = docs < np.array(highs, np.int64)
        which, offsets, first = earliest_of(anchor, sizes, digests, contents, docs)
        # The windows of every occurrence, those of a stretch side by side.
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        gone = np.where(first[np.repeat(offsets[which], sizes) + inner] < np.repeat(docs, sizes), 1, np.repeat(2 * several, sizes))
        same = (gone[1:] == gone[:-1]) & (inner[1:] > 0)
        begins = (gone > 0) & ~np.concatenate(([False], same))
        ends = (gone > 0) & ~np.concatenate((same, [False]))
        part = np.repeat(np.arange(len(sizes)), sizes)
        a, b = np.flatnonzero(begins), np.flatnonzero(ends)
        x = pa.StructArray.from_arrays([pa.array(np.array(rows, np.int64)[part[a]]), pa.array((starts[part[a]] + inner[a]).astype(np.int32)), pa.array((starts[part[b]] + inner[b] + WINDOW).astype(np.int32)), pa.array(gone[a] == 2)], ["row", "first", "last", "own"])
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[part[a]]), x], ["key", "x"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_anchors(batches):
            yield solve(*held)

    dealt = parts.repartition("anchor").sortWithinPartitions("anchor", "digest")
    return dealt.select("anchor", "size", "digest", "content", "key", "high", "row", "start").mapInArrow(work, f"key bigint, x {PLACE}")


def repeats_of_common(parts: DataFrame) -> DataFrame:
    """The same for stretches with common anchors, which may stand in a third of all documents.

    Occurrences are dealt by salt and aggregated to distinct stretches before these meet by anchor in an index; what
    it finds (runs of windows with their earliest document) goes back to the occurrences where they lie.
    """
    doc, stretch = doc_of("key"), ["anchor", "digest", "salt"]
    run = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("earliest", pa.int64())]))

    def solve(anchor, sizes, digests, contents, salts, lows, highs, *_) -> pa.RecordBatch:
        which, offsets, earliest = earliest_of(anchor, sizes, digests, contents, np.array(lows, np.int64))
        change = np.union1d(np.flatnonzero(np.concatenate(([True], earliest[1:] != earliest[:-1]))), offsets)
        owner = np.searchsorted(offsets, change, "right") - 1
        stop = np.append(change[1:], len(earliest))
        runs: list[list] = [[] for _ in offsets]
        for k, a, b, e in zip(owner.tolist(), (change - offsets[owner]).tolist(), (stop - offsets[owner]).tolist(), earliest[change].tolist()):
            runs[k].append({"a": a, "b": b, "earliest": e})
        out = [[r for r in runs[k] if r["earliest"] < high] for k, high in zip(which.tolist(), highs)]
        keep = pa.array([bool(x) for x in out], pa.bool_())
        columns = [pa.array(anchor, pa.int64()), pa.array(digests, pa.int64()), pa.array(salts, pa.int32()), pa.array(out, run)]
        return pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], [*stretch, "runs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_anchors(batches):
            yield solve(*held)

    # Both branches read every column of the same rows, so that they share one exchange and one pass over the texts.
    dealt = parts.where(" AND ".join(f"{c} IS NOT NULL" for c in (*stretch, "key", "high"))).repartition(*stretch)
    distinct = dealt.groupBy(*stretch).agg(F.max("content").alias("content"), F.max("size").alias("size"), F.min(doc).alias("low"), F.max("high").alias("high"), F.min("row").alias("row"), F.min("start").alias("start"))
    together = distinct.repartition("anchor").sortWithinPartitions("anchor", "digest")
    index = together.select("anchor", "size", "digest", "content", "salt", "low", "high", "row", "start").mapInArrow(work, "anchor bigint, digest bigint, salt int, runs array<struct<a:int,b:int,earliest:bigint>>")
    ways = dealt.join(index, stretch).select("key", "high", "row", "start", "size", "content", F.explode("runs").alias("x"))
    ways = ways.where((F.col("x.earliest") < F.col("high")) & ((F.col("x.b") <= F.col("size")) | F.col("content").isNull()))
    return ways.select("key", F.struct("row", (F.col("start") + F.col("x.a")).alias("first"), (F.col("start") + F.col("x.b") + WINDOW - 1).alias("last"), (F.col("x.earliest") >= doc).alias("own")).alias("x"))


def merged(ways: DataFrame) -> DataFrame:
    """``first_key, row, gone, later``: the intervals of each text without overlap, for its first document and, where
    they differ, for those after it."""
    places = pa.list_(pa.struct([("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))

    def union(row: int, first: np.ndarray, last: np.ndarray) -> list[dict]:
        order = np.argsort(first, kind="stable")
        first, end = first[order], np.maximum.accumulate(last[order])
        begins = np.flatnonzero(np.concatenate(([True], first[1:] > end[:-1])))
        return [{"row": row, "first": a, "last": b} for a, b in zip(first[begins].tolist(), end[np.append(begins[1:], len(first)) - 1].tolist())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, gone, later = [], [], [], []
            for key, xs in zip(batch.column(0).to_pylist(), batch.column(1)):
                row, first, last, own = (xs.values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                for r in np.unique(row).tolist():
                    every = row == r
                    before = every & ~own
                    keys.append(key)
                    rows.append(r)
                    gone.append(union(r, first[before], last[before]) if before.any() else [])
                    later.append(union(r, first[every], last[every]) if (every & own).any() else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.int64()), pa.array(gone, places), pa.array(later, places)], ["first_key", "row", "gone", "later"])

    held = ways.groupBy("key").agg(F.collect_list("x").alias("xs"))
    kind = "array<struct<row:bigint,first:int,last:int>>"
    return held.mapInArrow(slices(work), f"first_key bigint, row bigint, gone {kind}, later {kind}")


def repeated_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``doc, text, gone``: intervals of words that repeat an earlier document.

    ``gone`` lists (row, first, last), the end exclusive, which may overlap; null for none.

    Every window of 13 words is compared word by word in an index, those of whole copies and of common passages
    too; only equal texts and stretches of equal words are one, by 128-bit hashes. Texts of fewer words repeat nothing. Rows that
    share an id do not repeat each other; a null id is smaller than any other. A null text has no words. Empty
    tables give empty results; other columns are not read. Ids below -2 ** 63 + 2 ** 40 count as null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("key"), text.alias("text")).withColumn("row", F.xxhash64("text"))
    base = base.withColumn("key", F.coalesce("key", F.lit(LOWEST).cast("bigint") + F.pmod("row", F.lit(SPAN))))
    some = sample_of(base)
    common = frequent(hash_rows(some, grams))
    spread = NONE
    if len(common.values):

        def full(h: np.ndarray) -> np.ndarray:
            found, whole = anchors(h, common)
            return found[whole]

        spread = frequent(hash_rows(some, full))

    def rare(h: np.ndarray) -> np.ndarray:
        found, whole = anchors(h, common)
        return found[~(whole & spread.has(found))]

    # Equal texts: each is looked at in the first document that has it.
    names = base.select("key", "row", F.xxhash64(F.lit(1), "text").alias("also"))
    equal = names.groupBy("row", "also").agg(F.min("key").alias("first_key"), F.max(doc_of("key")).alias("high"))
    firsts = equal.groupBy(F.col("first_key").alias("key")).agg(F.collect_list(F.struct("row", "high")).alias("own"))
    # Later copies stay as rows without text, for a join that drops them would shuffle the texts by itself.
    one = F.get(F.filter("own", lambda x: x["row"] == F.col("row")), 0)["high"]
    high = base.join(firsts, "key", "left").withColumn("high", one)
    base1 = high.select("key", F.when(F.col("high").isNotNull(), F.col("text")).alias("text"), "row", F.coalesce("high", doc_of("key")).alias("high"))

    # Anchors that two documents share; those that a sample shows to be common are known to be, and are not shuffled.
    found = hash_rows(base1, rare).repartition("hash")
    group = Window.partitionBy("hash")
    shared = found.withColumns({"low": F.min(doc_of("key")).over(group), "high": F.max(doc_of("key")).over(group)}).where("low < high")
    marks = shared.groupBy("key").agg(F.collect_list("hash").alias("shared"))
    # All joins with texts are by key, so that the texts are shuffled once.
    texts = base1.join(marks, "key", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<bigint>")))
    ways = repeats_in_shards(occurrences(texts, common, spread, False))
    if len(spread.values):
        ways = ways.union(repeats_of_common(occurrences(texts, common, spread, True)))
    places = names.join(equal.select("row", "also", "first_key"), ["row", "also"]).select("key", "first_key", "row")
    found = places.distinct().join(merged(ways), ["first_key", "row"])
    each = F.when(doc_of("key") > doc_of("first_key"), F.coalesce("later", "gone")).otherwise(F.col("gone"))
    gone = found.groupBy("key").agg(F.flatten(F.collect_list(each)).alias("gone")).where(F.size("gone") > 0)
    own = F.filter("gone", lambda x: x["row"] == F.col("row"))
    return base.join(gone, "key", "left").select(F.nullif(doc_of("key"), F.lit(LOWEST).cast("bigint")).alias("doc"), "text", own.alias("gone"))


def kept_words(words: list[bytes], first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """The words outside the intervals."""
    if not len(first) or len(words) < WINDOW:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``doc, n_words, n_removed, kept``: the words that are left, joined by one blank."""
    none = F.array().cast("array<int>")
    found = repeated_words(docs, **options).select("doc", "text", *[F.coalesce(f"gone.{c}", none).alias(c) for c in ("first", "last")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, first, last in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                words = words_of(text)
                left = kept_words(words, *(x.values.to_numpy(zero_copy_only=False) for x in (first, last)))
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc", "n_words", "n_removed", "kept"])

    return found.mapInArrow(work, "doc bigint, n_words bigint, n_removed bigint, kept string")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    return remove_repeats(docs).select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
