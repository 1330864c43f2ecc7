"""Alignment of the tokens of two tokenizers over the same texts, as relations.

Where tokens end follows from their lengths alone. So each distinct pair of length sequences is aligned once, by joins and
windows: tokens are exploded with their positions, running sums of lengths are their ends, an equal join on sequence and end
finds the common cuts, running counts of cuts number the groups, and a join on group and byte range links what overlaps.

Texts are cut where both tokenizers certainly end a token (see ``stretches``). Each task names the distinct stretches of a block of documents,
so a document is a list of stretch numbers, and what it has is the sum over its stretches. Tables of alignments and of linked
pairs are sent to the tasks while they are small, and joined to the blocks that need them beyond.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
import pickle
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written

BYTES_VOCABULARY, PIECES_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text of the documents of a block.
BLOCK = 1 << 24
#: Most tokens of the alignments, and most linked pairs, that are sent to the tasks.
KNOWN_TOKENS, KNOWN_PAIRS = 1 << 26, 1 << 23
#: Characters of stretches that are tokenized in one go.
CHUNK = 1 << 14
#: Bytes of a text in which the tokens of one group look for each other.
NEAR = 64

_C = ctypes.CDLL(None)

_CUT = re.compile(r"(?<=[^\s▁])(?= .)", re.DOTALL)
#: Where a space may stand that is no cut.
_ODD = re.compile(r"[\s▁] ")
#: What ends in these cannot be followed by a cut.
_OPEN = re.compile(r"[\s▁]\Z")


def stretches(text: str) -> list[str]:
    """Space and text, cut before each space that follows neither white space nor U+2581 and that does not end it.

    The first tokenizer's words begin at such a space as they do at the start of a text, and no entry of the second one
    holds a space after another sign (``Tokenizers`` looks).
    """
    return [" " + word for word in words_of(text)]


def words_of(text: str) -> list[str]:
    """The stretches of a text without the space that each begins with."""
    if _ODD.search(text) or text[0] == " " or text[-1] == " ":
        return [stretch[1:] for stretch in _CUT.split(" " + text)]
    return text.split(" ")


class _Numbers(dict):
    """Word -> its number, in the order in which words come."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class Tokenizers:
    """Ids of both tokenizers for stretches, and the bytes of each id."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(printable)]
        byte_of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(rest)}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        b = self.b
        self.b_bytes = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in range(b.get_piece_size())]
        self.a_len, self.b_len = (np.array([*map(len, x)], np.int32) for x in (self.a_bytes, self.b_bytes))
        pieces = [b.id_to_piece(k) for k in range(b.get_piece_size()) if not (b.is_byte(k) or b.is_control(k) or b.is_unknown(k))]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the second vocabulary joins words")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of all stretches by the first, how many each has, both by the second, and whether their bytes are those of the stretch.

        Stretches are put together again to be tokenized in one go, where a cut between them would be certain; the ends of
        tokens tell whose they are.
        """
        chunks, now, size = [], [], 0
        for text in texts:
            now.append(text)
            size += len(text)
            if size >= CHUNK or _OPEN.search(text):
                chunks.append(now)
                now, size = [], 0
        if now:
            chunks.append(now)
        out = [(np.zeros(0, np.int32),) * 4 + (np.zeros(0, bool),)]
        for at in range(0, len(chunks), 16):
            out += self.encode_chunks(chunks[at : at + 16])
        return tuple(np.concatenate(x) for x in zip(*out))

    def encode_chunks(self, chunks: list[list[str]]) -> list[tuple[np.ndarray, ...]]:
        joined = ["".join(x) for x in chunks]
        a = self.a.encode_batch_fast(joined, add_special_tokens=False)
        b = self.b.encode([t[1:] for t in joined], num_threads=1)
        out = []
        for texts, text, x, y in zip(chunks, joined, a, b):
            raw = text.encode("utf-8", "surrogatepass")
            sizes = map(len, texts) if len(raw) == len(text) else (len(t.encode("utf-8", "surrogatepass")) for t in texts)
            ends = np.cumsum(np.fromiter(sizes, np.int64, len(texts)))
            found, whole = [], True
            for ids, names, lengths in ((x.ids, self.a_bytes, self.a_len), (y, self.b_bytes, self.b_len)):
                own = np.array(ids, np.int32)
                stops = np.cumsum(lengths[own], dtype=np.int64)
                places = np.searchsorted(stops, ends, "right")
                whole &= b"".join(map(names.__getitem__, ids)) == raw and np.array_equal(stops[places - 1], ends)
                found += [own, np.diff(places, prepend=0).astype(np.int32)]
            if whole or len(texts) == 1:
                if not whole:
                    found = [found[0], np.array([len(found[0])], np.int32), found[2], np.array([len(found[2])], np.int32)]
                out.append((*found, np.full(len(texts), whole)))
            else:  # one of them is not spelled by its tokens: each for itself
                half = len(texts) // 2
                out += self.encode_chunks([texts[:half], texts[half:]])
        return out


@functools.cache
def tokenizers(first: str, second: str) -> Tokenizers:
    """One pair a worker. A name without a slash is one of the installed public tokenizers."""
    import public_tokenizers

    return Tokenizers(*[x if "/" in x else public_tokenizers.path(x) for x in (first, second)])


@functools.cache
def lengths_of(first: str, second: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each id of both."""
    own = tokenizers(first, second)
    return own.a_len, own.b_len


def give_back() -> None:
    """What a worker has freed goes back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def token_alignment(sequences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups and links of ``sequences``: ``id`` and the lengths in bytes of the tokens, ``a`` and ``b`` (arrays).

    Three tables: ``id, i, grp`` of the tokens of a, ``id, j, grp`` of those of b (groups count from 0), and the links
    ``id, i, j`` of tokens whose byte ranges overlap. A token of no bytes links with nothing.
    """

    def ends(column: str, place: str) -> DataFrame:
        order = Window.partitionBy("id").orderBy(place)
        end = F.sum("len").over(order)
        return sequences.select("id", F.posexplode(column).alias(place, "len")).select("id", place, end.alias("end"), (end - F.col("len")).alias("start"))

    a, b = cut(ends("a", "i")), cut(ends("b", "j"))
    last = Window.partitionBy("id", "end")
    # Of tokens that end at the same byte (some have none), the last one cuts.
    tail_a = a.withColumn("cuts", F.col("i") == F.max("i").over(last)).where("cuts")
    tail_b = b.withColumn("cuts", F.col("j") == F.max("j").over(last)).where("cuts")
    cuts = cut(tail_a.select("id", "end", "i").join(tail_b.select("id", "end", "j"), ["id", "end"]))

    def grouped(side: DataFrame, place: str) -> DataFrame:
        marked = side.join(cuts.select("id", place, F.lit(1).alias("mark")), ["id", place], "left")
        mark = F.coalesce("mark", F.lit(0))
        order = Window.partitionBy("id").orderBy(place)
        return marked.select("id", place, "start", "end", (F.sum(mark).over(order) - mark).alias("grp"))

    ga, gb = cut(grouped(a, "i")), cut(grouped(b, "j"))

    def near(side: DataFrame, place: str, start: str, end: str) -> DataFrame:
        spans = F.sequence(F.floor(F.col("start") / NEAR), F.floor((F.col("end") - 1) / NEAR))
        return side.where("end > start").select("id", "grp", place, F.col("start").alias(start), F.col("end").alias(end), F.explode(spans).alias("near"))

    both = near(ga, "i", "a0", "a1").join(near(gb, "j", "b0", "b1"), ["id", "grp", "near"])
    first = F.col("near") == F.floor(F.greatest("a0", "b0") / NEAR)  # ranges that share several spans meet in the first
    return ga.select("id", "i", "grp"), gb.select("id", "j", "grp"), both.where("a0 < b1 AND b0 < a1").where(first).select("id", "i", "j")


def _listed(rows: DataFrame, place: str, value: str, name: str) -> DataFrame:
    """``id`` and the array of ``value`` in the order of ``place``."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(place, value))).alias("x")).select("id", F.col(f"x.{value}").alias(name))


def aligned_shapes(shapes: DataFrame) -> DataFrame:
    """``a, b`` (lengths) of each shape with ``ga, gb`` (group of each token) and ``li, lj`` (links, in order)."""
    named = written(shapes.withColumn("id", F.monotonically_increasing_id()), "shapes")
    ga, gb, links = token_alignment(named)
    pairs = links.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("x")).select("id", F.col("x.i").alias("li"), F.col("x.j").alias("lj"))
    return written(named.join(_listed(ga, "i", "grp", "ga"), "id").join(_listed(gb, "j", "grp", "gb"), "id").join(pairs, "id").select("a", "b", "ga", "gb", "li", "lj"), "shapes")


_FIELDS = ["doc", "known", "n", "stretch", "ok", "a", "an", "b", "bn", "shape"]
#: A block: packed arrays, and its different shapes.
_BLOCK = "block bigint, " + ", ".join(f"{f} binary" for f in _FIELDS) + ", shapes array<struct<a:array<int>,b:array<int>>>"


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _keys(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> np.ndarray:
    """64 bits for each pair of length sequences; the aligned shapes are compared with the lengths themselves."""
    out = np.zeros(len(an), np.uint64)
    for flat, sizes, odd in ((a, an, np.uint64(0x9E3779B97F4A7C15)), (b, bn, np.uint64(0xC2B2AE3D27D4EB4F))):
        x = (flat.astype(np.uint64) + np.uint64(1)) * odd
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        starts = _starts(sizes)
        place = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)
        power = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0x94D049BB133111EB, np.uint64))
        x = x * power[place]
        total = np.concatenate(([np.uint64(0)], np.cumsum(x)))
        out = (out ^ out >> np.uint64(31)) * odd + (total[starts[1:]] - total[starts[:-1]]) + sizes.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return out ^ out >> np.uint64(32)


def blocks_of(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``docs`` (doc, text) as rows of about ``BLOCK`` bytes of text: numbers of stretches, and each stretch's tokens and shape."""
    from pyspark import TaskContext

    def packed(block: int, ids: list, numbers: list[np.ndarray], names: _Numbers) -> pa.RecordBatch:
        own = tokenizers(first, second)
        a, an, b, bn, ok = own.encode([" " + word for word in names])
        empty = np.zeros(0, np.int32)
        la, lb = own.a_len[a], own.b_len[b]
        good = np.flatnonzero(ok)
        _, first_of, which = np.unique(_keys(la, an, lb, bn)[good], return_index=True, return_inverse=True)
        shape = np.zeros(len(ok), np.int32)
        shape[good] = which + 1
        chosen = good[first_of]
        lists = []
        for flat, sizes in ((la, an), (lb, bn)):
            some = sizes[chosen]
            lists.append(pa.ListArray.from_arrays(_starts(some).astype(np.int32), flat[_gather(_starts(sizes)[chosen], some)]))
        structs = pa.StructArray.from_arrays(lists, ["a", "b"])
        shapes = pa.ListArray.from_arrays(pa.array([0, len(chosen)], pa.int32()), structs)
        buffers = [
            np.array([0 if d is None else d for d in ids], "<i8"), np.array([d is not None for d in ids], bool), *map(_small, (
            np.fromiter(map(len, numbers), np.int32, len(numbers)), np.concatenate([empty, *numbers]), ok, a, an, b, bn, shape)),
        ]
        columns = [pa.array([block], pa.int64()), *[pa.array([_squeezed(x)], pa.binary()) for x in buffers], shapes]
        return pa.RecordBatch.from_arrays(columns, ["block", *_FIELDS, "shapes"])

    def work(batches):
        part, k = TaskContext.get().partitionId() << 32, 0
        ids, numbers, names, held = [], [], _Numbers(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc, text in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    found = words_of(text) if text else []
                    ids.append(doc)
                    numbers.append(np.fromiter(map(names.__getitem__, found), np.int32, len(found)))
                    held += len(text or "") + 64
                    if held >= BLOCK:
                        yield packed(part + k, ids, numbers, names)
                        k, ids, numbers, held = k + 1, [], [], 0
                        names.clear()
                        give_back()
        if ids:
            yield packed(part + k, ids, numbers, names)

    return written(docs.mapInArrow(work, _BLOCK), "blocks")


def _small(x: np.ndarray) -> np.ndarray:
    """In as few bytes a number as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _squeezed(x: np.ndarray) -> bytes:
    """Compressed numbers: Spark hands a task's blocks to Python together, and holds them as they are."""
    return pickle.dumps((x.dtype.str, x.nbytes, pa.compress(np.ascontiguousarray(x), "zstd", asbytes=True)))


def _unsqueezed(blob: bytes) -> np.ndarray:
    kind, size, data = pickle.loads(blob)
    return np.frombuffer(pa.decompress(data, size, "zstd") if size else b"", kind)


def _once(values: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Each value once; ``slot`` has a place for every value that there may be."""
    order = np.arange(len(values))
    slot[values] = order
    return values[slot[values] == order]


def flat_shapes(rows: pa.RecordBatch | pa.StructArray) -> dict[str, np.ndarray]:
    """The numbers of aligned shapes, one after the other, and how many each has of a, b and links."""
    out = {}
    for name, size in (("a", "an"), ("b", "bn"), ("ga", None), ("gb", None), ("li", "n"), ("lj", None)):
        lists = rows.column(name) if isinstance(rows, pa.RecordBatch) else rows.field(name)
        out[name] = _small(lists.flatten().to_numpy())
        if size:
            out[size] = _small(np.diff(lists.offsets.to_numpy()))
    return out


class Shapes:
    """Alignments of shapes in flat arrays, found by the lengths of their tokens."""

    def __init__(self, parts: list[dict[str, np.ndarray]]):
        join = lambda k: np.concatenate([np.zeros(0, np.uint8), *[p[k] for p in parts]])
        self.a, self.b, self.ga, self.gb, self.li, self.lj = (join(k) for k in ("a", "b", "ga", "gb", "li", "lj"))
        self.an, self.bn, self.n = (join(k).astype(np.int32) for k in ("an", "bn", "n"))
        self.starts, self.a0, self.b0 = _starts(self.n), _starts(self.an), _starts(self.bn)
        keys = _keys(self.a, self.an, self.b, self.bn)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]

    def of(self, a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> np.ndarray:
        """The place of each shape."""
        at = self.order[np.searchsorted(self.keys, _keys(a, an, b, bn))] if len(an) else np.zeros(0, np.int64)
        same = np.array_equal(self.an[at], an) and np.array_equal(self.bn[at], bn) and np.array_equal(self.a[_gather(self.a0[at], an)], a) and np.array_equal(self.b[_gather(self.b0[at], bn)], b)
        if not same:
            raise ValueError("two shapes have one name")
        return at


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1 and on of each run, one run after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Block:
    """A block's arrays, and the linked pairs of its stretches: ``names`` (a << 32 | b) at ``places``, from ``starts`` on for each."""

    def __init__(self, batch: pa.RecordBatch, k: int, shapes: Shapes, lengths: tuple[np.ndarray, np.ndarray]):
        def read(name: str) -> np.ndarray:
            return _unsqueezed(batch.column(name)[k].as_buffer())

        self.doc = pa.array(read("doc"), mask=~read("known"))
        self.docs = _starts(read("n"))
        self.stretch, self.ok = read("stretch"), read("ok").astype(bool)
        self.a, self.an, self.b, self.bn = read("a"), read("an").astype(np.int32), read("b"), read("bn").astype(np.int32)
        self.a0, self.b0 = _starts(self.an), _starts(self.bn)
        self.shapes = shapes
        local = read("shape").astype(np.int64) - 1
        self.shape = np.full(len(local), -1, np.int64)
        if len(local) and local.max() >= 0:  # the first stretch of each shape stands for it
            chosen = np.unique(local, return_index=True)[1][-(local.max() + 1) :]
            lens = [part for flat, starts, sizes, length in ((self.a, self.a0, self.an, lengths[0]), (self.b, self.b0, self.bn, lengths[1])) for part in (length[flat[_gather(starts[chosen], sizes[chosen])]], sizes[chosen])]
            own = shapes.of(*lens)
            self.shape = np.where(local >= 0, own[np.maximum(local, 0)], -1)
        self.good = good = np.flatnonzero(self.ok)
        sizes = np.zeros(len(self.ok), np.int64)
        sizes[good] = shapes.n[self.shape[good]]
        self.links, self.starts = sizes, _starts(sizes)
        at = _gather(shapes.starts[self.shape[good]], sizes[good])
        pairs = self.a[np.repeat(self.a0[good], sizes[good]) + shapes.li[at]].astype(np.int64) << 32
        pairs |= self.b[np.repeat(self.b0[good], sizes[good]) + shapes.lj[at]].astype(np.int64)
        self.names, places = np.unique(pairs, return_inverse=True)
        self.places = places.astype(np.int32)
        self.groups = np.zeros(len(self.ok), np.int64)
        self.groups[good] = shapes.ga[shapes.a0[self.shape[good] + 1] - 1].astype(np.int64) + 1
        wrong = _starts(~self.ok[self.stretch])
        self.whole = (np.diff(self.docs) > 0) & (wrong[self.docs[1:]] == wrong[self.docs[:-1]])

    def documents(self):
        """The stretches of each document, if it has any and all have their own bytes."""
        for k, whole in enumerate(self.whole.tolist()):
            yield self.stretch[self.docs[k] : self.docs[k + 1]] if whole else self.stretch[:0]

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, and how many documents hold each."""
        counts = np.zeros(len(self.names), np.int64)
        slots = np.zeros(len(self.ok), np.int64), np.zeros(len(self.names), np.int64)
        for own in self.documents():
            own = _once(own, slots[0])
            counts[_once(self.places[_gather(self.starts[own], self.links[own])], slots[1])] += 1
        return self.names[counts > 0], counts[counts > 0]

    def texts(self) -> list[bytes]:
        """The groups of each stretch as ``a1,a2|b1;a3|b2;``.

        A group has tokens of both sides, for it ends where both end one. What is written stands in one array, a token with the
        sign after it; tokens of a come before those of b of their group.
        """
        good, x, s = self.good, self.shapes, self.shape[self.good]
        an, bn = self.an[good], self.bn[good]
        base = _starts(self.groups[good])
        ga = np.repeat(base[:-1], an) + x.ga[_gather(x.a0[s], an)]
        gb = np.repeat(base[:-1], bn) + x.gb[_gather(x.b0[s], bn)]
        in_a, in_b = _starts(np.bincount(ga, minlength=base[-1])), _starts(np.bincount(gb, minlength=base[-1]))
        ids, signs = np.zeros(len(ga) + len(gb), np.int32), np.zeros(len(ga) + len(gb), np.int8)
        at = np.arange(len(ga)) + in_b[ga]
        ids[at] = self.a[_gather(self.a0[good], an)]
        signs[at[in_a[1:] - 1]] = 1
        at = np.arange(len(gb)) + in_a[gb + 1]
        ids[at] = self.b[_gather(self.b0[good], bn)]
        signs[at[in_b[1:] - 1]] = 2
        told = pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), pa.array([",", "|", ";"], pa.large_string()).take(pa.array(signs)), pa.scalar("", pa.large_string()))
        told = told.combine_chunks() if isinstance(told, pa.ChunkedArray) else told
        ends = np.frombuffer(told.buffers()[1], np.int64)[: len(told) + 1] if len(told) else np.zeros(1, np.int64)
        sizes = np.zeros(len(self.ok), np.int64)
        sizes[good] = an + bn
        offsets = ends[_starts(sizes)]
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), told.buffers()[2]]).to_pylist() if len(told) else [b""] * len(sizes)

    def report(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        at = np.searchsorted(pairs, self.names)
        at = np.minimum(at, max(0, len(pairs) - 1))
        hit = pairs[at] == self.names if len(pairs) else np.zeros(len(self.names), bool)  # others are in documents left out only
        sums = [np.diff(_starts(np.where(hit, x[at], 0)[self.places])[self.starts]) for x in (best, counts)] if len(pairs) else [np.zeros(len(self.ok), np.int64)] * 2
        total = [np.where(self.whole, np.diff(_starts(x[self.stretch])[self.docs]), 0) for x in (self.an, self.bn, self.groups, self.links, *sums)]
        texts, digests = self.texts(), []
        for own in self.documents():
            digest = hashlib.sha256()
            for at in range(0, len(own), 4096):
                part = b"".join(map(texts.__getitem__, own[at : at + 4096].tolist()))
                digest.update(part if at + 4096 < len(own) else part[:-1])
            digests.append(digest.hexdigest() if len(own) else "")
        names = ["doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        return pa.RecordBatch.from_arrays([self.doc, *map(pa.array, total), pa.array(digests, pa.string())], names)


def alignment_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", first: str = BYTES_VOCABULARY, second: str = PIECES_VOCABULARY, known_tokens: int = KNOWN_TOKENS, known_pairs: int = KNOWN_PAIRS) -> tuple[DataFrame, DataFrame]:
    """A row per row of ``docs``, and the linked pairs of ids.

    The rows: ``doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; the pairs: ``a, b, n`` (documents that
    hold the pair linked), ``best`` (no other pair of that a has more). ``first`` is a byte-level BPE file of the tokenizers
    library, ``second`` a sentencepiece BPE model with byte fallback; names or paths.

    Null and empty texts, and texts whose tokens do not spell space and text byte by byte, have no tokens: zeros and an empty
    digest. Rows count as documents, whether ids or texts repeat or are null; ties are all best. An empty table gives
    empty results; other columns are not read. A stretch without spaces is one sequence of any length.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    blocks = blocks_of(texts, first, second)
    distinct = blocks.select(F.explode("shapes").alias("x")).distinct().select("x.a", "x.b")
    shapes = aligned_shapes(distinct)
    size = shapes.agg(F.sum(F.size("a") + F.size("b") + 2 * F.size("li"))).first()[0] or 0
    if size <= known_tokens:

        def flat(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(flat_shapes(batch))], pa.binary())], ["flat"])

        sent = spark.sparkContext.broadcast(Shapes([pickle.loads(r[0]) for r in shapes.mapInArrow(flat, "flat binary").collect()]))  # ``known_tokens`` small numbers
        with_shapes = blocks.drop("shapes")
    else:
        sent = None
        wanted = blocks.select("block", F.explode("shapes").alias("x")).select("block", "x.a", "x.b")
        own = wanted.join(shapes, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("a", "b", "ga", "gb", "li", "lj")).alias("aligned"))
        with_shapes = written(blocks.drop("shapes").join(own, "block", "left"), "blocks")

    def opened(batch: pa.RecordBatch):
        lengths = lengths_of(first, second)
        tokenizers.cache_clear()  # from here on only lengths are read
        for k in range(batch.num_rows):
            give_back()
            yield k, Block(batch, k, sent.value if sent else Shapes([flat_shapes(batch.column("aligned").slice(k, 1).flatten())]), lengths)

    def count(batches):
        for batch in batches:
            for k, block in opened(batch):
                pairs, counts = block.pair_counts()
                del block  # before the next one is opened
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), batch.column("block")[k].as_py())), pa.array(pairs), pa.array(counts)], ["block", "pair", "n"])

    held = with_shapes.mapInArrow(count, "block bigint, pair bigint, n bigint")
    if sent is None:
        held = written(held, "pairs")
    counted = held.groupBy("pair").agg(F.sum("n").alias("n")).select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n")
    counted = written(counted, "pairs")
    pairs = counted.join(counted.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    if sent is not None and counted.count() <= known_pairs:
        found = pairs.select("pair", "n", "best").toArrow().sort_by("pair")
        table = spark.sparkContext.broadcast(tuple(found.column(k).to_numpy().astype(kind) for k, kind in enumerate((np.int64, np.int64, bool))))
        ready = with_shapes
    else:
        table = None
        wanted = held if sent is None else with_shapes.mapInArrow(count, "block bigint, pair bigint, n bigint")
        own = wanted.select("block", "pair").join(pairs.select("pair", "n", "best"), "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("pairs"))
        ready = with_shapes.join(own, "block", "left")

    def report(batches):
        for batch in batches:
            for k, block in opened(batch):
                own = None if table is not None else batch.column("pairs").slice(k, 1).flatten()
                told = block.report(*(table.value if own is None else [own.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")]))
                del block
                yield told

    rows = ready.mapInArrow(report, "doc bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return rows, pairs.drop("pair")


def alignment_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    return alignment_of(docs)[0].withColumnRenamed("doc", "doc_id")
