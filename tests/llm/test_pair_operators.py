"""N-gram join, token alignment and phrases against brute force and SQL."""

import collections
import hashlib
import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.llm import alignment, jaccard_join, phrases
from tests.conftest import SF
from tests.llm.test_operators import SCHEMA, TEXTS, split_words

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, "s", len(t or ""), "r", k, 0.5, "x", "y") for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# N-gram join


def shingle_set(text, words=4):
    found = split_words((text or "").translate(A_TO_Z))
    return {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def linked_by_hand(rows, similar=85):
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= similar * max(len(x), len(y)) and 100 * len(x & y) >= similar * len(x | y):
            top[root(b)] = root(a)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return sorted(((str(i), len(s), min(least[root(k)], default=None)) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(frame, **options):
    return sorted(((str(r.doc), r.n, r.component) for r in jaccard_join.similar_sets(frame, **options).collect()), key=str)


def families(seed, groups=12, size=14, vocabulary=60):
    """Texts cut from few passages and edited: many share much, around the threshold, and words are few."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(vocabulary)])
    passages = [words[rng.integers(0, vocabulary, 30)] for _ in range(6)]
    rows = []
    for g in range(groups):
        parts = [passages[k] for k in rng.integers(0, 6, rng.integers(1, 5))]
        base = np.concatenate([*parts, words[rng.integers(0, vocabulary, rng.integers(0, 25))]])
        for _ in range(size):
            copy = base.copy()
            at = rng.integers(0, len(copy), rng.integers(0, 4))
            copy[at] = words[rng.integers(0, vocabulary, len(at))]
            rows.append((len(rows), " ".join(copy[rng.integers(0, 3) :])))
    rows += [(1000 + k, " ".join(words[rng.integers(0, 4, rng.integers(1, 12))])) for k in range(60)]
    return [rows[k] for k in rng.permutation(len(rows))]


@pytest.mark.parametrize("seed,pairs,threes,similar", [(0, 32, 4096, 85), (1, 2, 8, 85), (2, 1, 2, 85), (3, 2, 6, 70), (4, 1, 3, 95)])
def test_join_by_hand(spark, monkeypatch, seed, pairs, threes, similar):
    """Single tokens, pairs and threes in use, groups of near copies in one bucket, short texts."""
    monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
    monkeypatch.setattr(jaccard_join, "THREES", threes)
    rows = families(seed)
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string"), similar=similar) == linked_by_hand(rows, similar)


def test_prefixes_share_an_entry(monkeypatch):
    """Any two similar sets share an entry that the places do not rule out, whatever the classes."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 90))
        universe = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
        kinds = dict(zip(universe.tolist(), rng.choice([1, 2, 3], len(universe), p=rng.dirichlet([1, 1, 1])).tolist()))
        x = rng.choice(universe, n, replace=False)
        drop = int(rng.integers(0, max(1, n // 8) + 1))
        y = np.concatenate([x[drop:], rng.choice(np.setdiff1d(universe, x), int(rng.integers(0, max(1, n // 8) + 1)), replace=False)])
        x, y = np.sort(x), np.sort(y)
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 85 * (len(x) + len(y) - both):
            continue
        shared = np.intersect1d(x, y)
        of = lambda s: np.array([kinds[t] if t in set(shared.tolist()) else (0 if t % 2 else kinds[t]) for t in s.tolist()])
        (ex, px), (ey, py) = (jaccard_join.entries(s, of(s)) for s in (x, y))
        common, i, j = np.intersect1d(ex, ey, return_indices=True)
        bound = np.minimum(len(x) - px[i], len(y) - py[j])
        assert len(common) and (185 * bound >= 85 * (len(x) + len(y))).any()


def test_join_at_the_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert joined(edge) == linked_by_hand(rows)
    assert jaccard_join.join_report(empty).count() == 0
    with pytest.raises(ValueError, match="hundredths"):
        jaccard_join.similar_sets(edge, similar=10)


def test_buckets_across_batches():
    """Buckets that run over batches keep their first row; single rows go."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted({(int(rng.integers(0, 40)), n % 3, n) for n in rng.integers(0, 9, 200).tolist()})
    rows = sorted(rows + rows[::7])
    columns = lambda part: [pa.array([r[k] for r in part], pa.int64()) for k in range(3)] + [pa.array([r[2] for r in part], pa.int64())] * 2
    names = ["entry", "alone", "node", "n", "place"]
    for size in (1, 2, 5, 1000):
        batches = (pa.RecordBatch.from_arrays(columns(rows[k : k + size]), names) for k in range(0, len(rows), size))
        found = [(r["entry"], r["alone"], r["node"], r["center"]) for b in jaccard_join._shared(batches) for r in b.to_pylist()]
        once = sorted(set(rows))
        first = {e: next(r[2] for r in once if r[0] == e) for e, _, _ in once}
        n = collections.Counter(r[0] for r in once)
        assert found == [(*r, first[r[0]]) for r in once if n[r[0]] > 1]


# Alignment


def aligned_by_hand(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in letters} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in letters)}
    docs, held = [], collections.Counter()
    for i, text in rows:
        ids_a = ids_b = links = groups = ()
        if text:
            raw = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            at = [bytes(byte[c] for c in a.id_to_token(k)) for k in ids_a]
            bt = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
            if b"".join(at) != raw or b"".join(bt) != raw:
                ids_a = ids_b = ()
            else:
                ends = [list(itertools.accumulate(map(len, x))) for x in (at, bt)]
                owner = [[k for k, t in enumerate(x) for _ in t] for x in (at, bt)]
                links = [(ids_a[p], ids_b[q]) for p, q in sorted(set(zip(*owner)))]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = [([t for t, e in zip(ids_a, ends[0]) if lo < e <= hi], [t for t, e in zip(ids_b, ends[1]) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        docs.append((i, ids_a, ids_b, groups, links))
        held.update(set(links))
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    digest = lambda g: hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g).encode()).hexdigest() if g else ""
    return sorted(((str(i), len(x), len(y), len(g), len(k), sum(held[p] == best[p[0]] for p in k), sum(held[p] for p in k), digest(g)) for i, x, y, g, k in docs)), held


TRICKY = ["", None, " ", "  a", "a ", "a  b ", "\n", "a\n b\t c  \n d\r\ne", "don't 's 'll", "<|endoftext|> x <s> </s>", "a▁ b", "x▁▁ y", "日本語 テスト", "  x   y", "é ﬁ é", "x\x00 y", "😀 😀😀", " " * 50 + "x" + " " * 40, "ab" * 900, "=-" * 300 + " " + "0123456789" * 40, "a b c d"]


@pytest.mark.parametrize("options", [{}, {"known_tokens": 0}, {"known_pairs": 0}])
def test_alignment_by_hand(spark, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 + k // 2, t) for k, t in enumerate(TRICKY + TRICKY[:6])] + [(None, "no id of its own")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted, held = aligned_by_hand(rows)
    found, pairs = alignment.alignment_of(frame, **options)
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == wanted
    assert {(r.a, r.b): r.n for r in pairs.collect()} == held and all(not r.best or r.n == max(n for (a, _), n in held.items() if a == r.a) for r in pairs.limit(50).collect())


def test_alignment_relations(spark):
    """Groups and links of any two length sequences; tokens of no bytes belong to a group and link with nothing."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(40):
        total = int(rng.integers(1, 300))
        cut = lambda: np.diff(np.concatenate(([0], np.sort(rng.choice(np.arange(1, total), min(total - 1, int(rng.integers(0, 12))), replace=False)), [total]))).tolist()
        a, b = cut(), cut()
        if k % 5 == 0:
            a.insert(int(rng.integers(0, len(a))), 0)
        rows.append((k, a, b))
    ga, gb, links = alignment.token_alignment(spark.createDataFrame(rows, "id bigint, a array<int>, b array<int>"))
    found = collections.defaultdict(set)
    for r in links.collect():
        assert (r.i, r.j) not in found[r.id]
        found[r.id].add((r.i, r.j))
    groups = collections.defaultdict(dict)
    for side, frame in ((0, ga), (1, gb)):
        for r in frame.collect():
            groups[r[0]][side, r[1]] = r.grp
    for k, a, b in rows:
        ends = [list(itertools.accumulate(x)) for x in (a, b)]
        owner = [[i for i, t in enumerate(x) for _ in range(t)] for x in (a, b)]
        assert found[k] == set(zip(*owner))
        cuts = set(ends[0]) & set(ends[1])
        for side in (0, 1):
            number = 0
            for i, e in enumerate(ends[side]):
                assert groups[k][side, i] == number
                number += e in cuts and (i + 1 == len(ends[side]) or ends[side][i + 1] > e)


def test_alignment_at_the_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted((str(r[0]), *r[1:]) for r in alignment.alignment_report(edge).collect()) == aligned_by_hand(rows)[0]
    assert alignment.alignment_report(empty).count() == 0


def test_blocks_are_held_small(spark):
    """Spark holds a task's blocks at once: they have fewer bytes than their texts, though each token of a stretch is in them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("doc"), "text").coalesce(1)
    blocks = alignment.blocks_of(docs, alignment.BYTES_VOCABULARY, alignment.PIECES_VOCABULARY)
    held = blocks.select(sum(F.length(f) for f in alignment._FIELDS).alias("n")).agg(F.sum("n")).first()[0]
    assert held < docs.agg(F.sum(F.length("text"))).first()[0]


# Phrases


def phrase_rows(frame, **options):
    return sorted((tuple(r) for r in phrases.collocations(frame, **options).collect()), key=str)


@pytest.mark.parametrize("known", [phrases.KNOWN, 400, 0])
def test_phrases_as_sql(spark, known):
    """Tables sent to the tasks, joins from the second level on, and joins all the way."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(f"Ab c{k % 3}\tab. c0  ab c0 ab;x y\n" * 20, lang) for k, lang in enumerate(["en", None, "und", "de"])] + [(None, "en"), ("", None), (" .,\n\r\x0b\x0c!", "en")]
    frame = docs.select("text", "lang").union(spark.createDataFrame(odd, "text string, lang string"))
    documents = frame.toArrow()  # noqa: F841  DuckDB reads it
    wanted = duckdb.sql(phrases.REPORT_SQL).fetchall()
    assert phrase_rows(frame, known=known) == sorted(wanted, key=str) and len(wanted) > 50


def test_phrases_at_the_edges(spark, edge, empty):
    documents = edge.select("text", "lang").toArrow()  # noqa: F841
    assert phrase_rows(edge) == sorted(duckdb.sql(phrases.REPORT_SQL).fetchall(), key=str)
    assert phrases.collocation_report(empty).count() == 0 and phrases.collocation_report(empty).columns == phrases.collocation_report(edge).columns
    few = spark.createDataFrame([("a b c a b", "x")], "text string, lang string")
    assert phrases.collocation_report(few).count() == 0
    every = phrase_rows(few, least=1, top=None)
    assert every == phrase_rows(few, least=1, top=100) and [r[1] for r in sorted(every, key=lambda r: r[1])] == list(range(1, len(every) + 1))
    with pytest.raises(ValueError):
        phrases.collocations(few, longest=1)
