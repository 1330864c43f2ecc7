"""Best-fit packing of tokenised documents by minimum bin slack.

Only the number of pieces of each length reaches the driver: at most as many numbers as a sequence has
tokens. There the fullest combination of lengths is found again and again by subset-sum dynamic programming
over a bitset, and taken as often as the counts allow. Pieces find their places from their rank among those
of equal length, which is counted in salted groups.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers; more are worked out each time.
REMEMBERED = 300_000
#: Pieces of one length that are ranked together, about.
RANKED = 250_000

#: Words of these characters need no normalisation but lower case; others go through the whole tokenizer.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ňŊ-ž]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Word (UTF-8) -> its token ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and works on each word alone, so a text's ids are those of its words.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.plain = self.whole.get_vocab_size() > 0 and '"end_of_word_suffix":"</w>"' in self.whole.to_str().replace(" ", "")

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.plain and _PLAIN.fullmatch(text) and "<|" not in text:
            ids = []
            for part in _PARTS.findall(text.lower()):
                if not part.isascii():
                    part = "".join(map(self.letters.__getitem__, part.encode()))
                ids += [t.id for t in self.model.tokenize(part)]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        out = np.array(ids, "<u4").tobytes()
        if len(self) < REMEMBERED:
            self[word] = out
        return out


@functools.cache
def word_ids(vocabulary: str) -> WordIds:
    """One memory a worker. ``vocabulary``: a file's path, or its name among the installed public tokenizers."""
    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return WordIds(vocabulary)


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> bytes:
    return b"".join(map(word_ids(vocabulary).__getitem__, (text or "").encode("utf-8", "replace").split()))


def tokenise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``uid, doc, piece, start, length, ids``: a row per piece, written once to the shared folder.

    A document's ids end with ``end_id``; documents longer than ``capacity`` are cut into pieces of that many
    ids. A null or empty text is one piece, of ``end_id`` alone. ``uid`` tells apart rows that share an id.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    schema = "uid bigint, doc bigint, piece int, start bigint, length bigint, ids binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = token_ids(text, vocabulary) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (uid, doc, piece, at // 4, len(part) // 4, part)):
                        column.append(value)
                    uid += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["uid", "doc", "piece", "start", "length", "ids"])

    return written(rows.mapInArrow(work, schema), "pieces")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as ``counts`` has it, whose sum comes closest to ``room`` from below.

    A bitset holds the sums in reach; the sets before each length was added lead back to one combination.
    """
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        before = reach
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & limit
            if more == reach:
                break
            reach = more
        steps.append((length, before))
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        while not before >> at & 1:
            at -= length
            chosen.append(length)
    return chosen


def bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of every kind of sequence. Each starts from the longest piece left, and is the fullest
    that the pieces left allow; it is taken as often as they last."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest(left, capacity - longest)]
        left[longest] += 1
        used = {x: chosen.count(x) for x in set(chosen)}
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
        out.append((times, sorted(chosen, reverse=True)))
    return out


def slots(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, slots in a sequence, first sequence, offset), sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in plan:
        offset = 0
        for length in dict.fromkeys(lengths):
            n = lengths.count(length)
            rows.append((length, rank.get(length, 0), n, sequence, offset))
            rank[length] = rank.get(length, 0) + times * n
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, *, key: str = "uid", length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``key, sequence_id, offset`` of every piece. Lengths must be 1 to ``capacity``; keys must differ.

    The histogram on the driver has at most ``capacity`` rows, and each length at most ``capacity`` kinds of
    place. An empty table gives an empty result.
    """
    narrow = pieces.select(F.col(key).alias("key"), F.col(length).cast("bigint").alias("length"))
    counts = {r["length"]: r["count"] for r in narrow.groupBy("length").count().collect()}
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    places = slots(bins(counts, capacity))
    # Rank among the pieces of a length: a place in a salted group, and the pieces in the groups before it.
    groups = 16 + sum(counts.values()) // RANKED
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").count()
    first = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("key"))
    ranked = salted.withColumn("own", own).join(first, ["length", "salt"]).select("key", "length", (F.col("first") + F.col("own") - 1).alias("rank"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.int64(1) << 44
        edges = places[:, 0] * big + places[:, 1]
        for batch in batches:
            size, rank = (batch.column(k).to_numpy() for k in (1, 2))
            found = places[np.searchsorted(edges, size * big + rank, "right") - 1] if len(places) else np.zeros((len(size), 5), np.int64)
            since = rank - found[:, 1]
            sequence = found[:, 3] + since // np.maximum(found[:, 2], 1)
            offset = found[:, 4] + since % np.maximum(found[:, 2], 1) * size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], ["key", "sequence_id", "offset"])

    return ranked.mapInArrow(work, "key bigint, sequence_id bigint, offset bigint").withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Every piece with its place: ``doc, piece, start, length, ids, sequence_id, offset``."""
    pieces = tokenise(docs, **options)
    return pieces.join(pack(pieces, capacity=options.get("capacity", CAPACITY)), "uid")


def packing_report(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = tokenise(docs)
    narrow = pieces.select("uid", F.col("doc").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return narrow.join(pack(pieces), "uid").drop("uid")
