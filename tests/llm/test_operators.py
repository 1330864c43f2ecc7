"""Each operator against brute force, on small tables with nulls, empties, repeats, long texts and clashing columns."""

import array
import collections
import gzip
import hashlib
import io
import re
import time
import wave
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from pyspark.sql import functions as F
from diurna.llm import decontamination, langid, line_dedup, media, packing, pii, queries, simhash_dedup, substring_dedup, toxicity, warc
from tests.conftest import SF

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, doc int, pos double, `start` string, label string"
LINE = "This line stands in several documents of the table."
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
TEXTS = [
    (1, None), (2, ""), (3, "a"), (4, f"  {LINE}\nown line of four\n{LINE.upper()}"), (5, f"{LINE}\r\nown line of five"), (6, f"{LINE}\n\n{LINE}"),
    (7, WORDS), (8, f"before {WORDS} after"), (9, WORDS.replace("kappa", "Kappa")), (10, " ".join(["same"] * 3000)), (11, " ".join(["same"] * 3000)),
    (12, "mail to a@b.co and x.y+z@d-e.example.org, call +1 (499) 555-6503, host 10.0.0.256 or 10.0.0.255, card 4111 1111 1111 1111 or 4111111111111112"),
    (13, "Çédille ñandú groß 🙂 naïve 🙂 1.2.3.4.5.6.7.8 a@b"), (14, 'password token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'),
    (15, WORDS), (15, WORDS), (15, "other text under the same id"), (None, WORDS), (None, f"{LINE}\nnameless"), (16, "\x0b\t \n\n"), (17, "9" * 6000 + " " + "1 " * 6000),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en" if k % 2 else None, "s", len(t or ""), "r", k, 0.5, "x", "y") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Line dedup


def test_lines_as_sql(docs, edge):
    for frame in (docs, edge):
        documents = frame.select("doc_id", "text").toArrow()
        wanted = duckdb.sql(line_dedup.REPORT_SQL).fetchall()
        assert sorted(map(str, map(tuple, line_dedup.line_report(frame).collect()))) == sorted(map(str, wanted))
        assert documents.num_rows == len(wanted)


def test_lines_stay_in_the_last_document(edge):
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(edge).where("doc_id < 7").collect()}
    assert kept[4] == "own line of four" and kept[5] == "own line of five" and kept[6] == f"{LINE}\n\n{LINE}" and kept[1] == ""
    assert line_dedup.dedup_lines(edge).columns == edge.columns


# Media


def test_media_round_trip(edge):
    for r, (i, text) in zip(sorted(media.media_report(edge).collect(), key=lambda r: (r.doc_id or 0, r.payload_sha256)), sorted(TEXTS, key=lambda x: (x[0] or 0, hashlib.sha256(padded(x[1])).hexdigest()))):
        data = padded(text)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len((text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        stored = io.BytesIO()
        with wave.open(stored, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(data)
        assert (r.media_bytes, r.media_sha256) == (len(stored.getvalue()), hashlib.sha256(stored.getvalue()).hexdigest())
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:]))
        assert r.feature == f"audio/wav;mean={sum(data) * 1000 // len(data)},power={sum(x * x for x in data) // len(data)},crossings={crossings},peak={max(data)};embedded=0"


def test_media_reports_equal_brute_force_on_documents(docs):
    wanted = {(i, hashlib.sha256(padded(t)).hexdigest()) for i, t in docs.select("doc_id", "text").collect()}
    assert {(r.doc_id, r.payload_sha256) for r in media.media_report(docs).collect()} == wanted


def test_validators_look_for_ends_once():
    start = time.perf_counter()
    assert media.carve(b"%PDF-1" * 100_000) == [] and media.carve(b"PK\x03\x04" * 100_000 + b"PK\x05\x06" * 50_000) == []
    assert time.perf_counter() - start < 20
    pdf = b"%PDF-1.4 body startxref 9 %%EOF"
    assert [(m.offset, m.length) for m in media.carve(b"%PDF-x " + pdf + b" " + pdf)] == [(7, len(pdf)), (8 + len(pdf), len(pdf))]
    large = zlib.compressobj(9, zlib.DEFLATED, 31)
    gz = large.compress(bytes(1 << 24)) + large.flush()
    assert [(m.offset, m.length) for m in media.carve(b"x" + gz + b"tail")] == [(1, len(gz))]


def padded(text):
    data = (text or "").encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def tiny_png():
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media_are_carved_and_false_signatures_are_not(spark):
    png, packed = tiny_png(), zlib.compressobj(9, zlib.DEFLATED, 31)
    gz = packed.compress(b"hello" * 50) + packed.flush()
    junk = b"BM and PK\x03\x04 and \x89PNG\r\n\x1a\n and GIF89a and %PDF-1.4 no end"
    assert [(m.offset, m.length, m.kind) for m in media.carve(junk + png + gz)] == [(len(junk), len(png), "image/png"), (len(junk) + len(png), len(gz), "application/gzip")]
    assert media.carve(png[:-1]) == [] and media.carve(b"") == []
    rows = spark.createDataFrame([(1, "text/plain", bytearray(png + gz)), (2, "image/png", bytearray(png)), (3, None, None)], "id int, declared string, media binary")
    out = {r.id: r for r in media.sniff(rows).collect()}
    assert (out[1].kind, out[1].corrected, out[1].length, len(out[1].embedded)) == ("image/png", True, len(png), 1)
    assert out[2].corrected is False and out[3].kind is None and out[3].embedded == []


# WARC


def test_archives_as_sql(spark):
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(["x" * 200, "y", "y", None, "x" * 200, "é" * 60, "é" * 60, ""])] + [(None, None, "x" * 200), (0, "http://again", "x" * 200)]
    for frame in (spark.createDataFrame(rows, "page_id bigint, url string, html string"), spark.read.parquet(f"{SF}/pages.parquet"), spark.createDataFrame([], "page_id bigint, url string, html string, payload int")):
        pages = frame.select("page_id", "url", "html").toArrow()
        wanted = sorted(map(str, duckdb.sql(warc.REPORT_SQL).fetchall()))
        assert sorted(map(str, map(tuple, warc.archive_report(frame).collect()))) == wanted and pages.num_rows == len(wanted)


@pytest.mark.parametrize("split", ["100", "1000", "1048576"])
def test_archives_read_alike_however_they_are_split(spark, tmp_path, split):
    rng, wanted = np.random.default_rng(4), set()
    with open(tmp_path / "a.warc", "wb") as f:
        f.write(b"junk")
        for i in range(60):
            body = b"".join([warc.MAGIC, rng.bytes(20), warc.MAGIC + b"\x04\x00"][k] for k in rng.integers(0, 3, rng.integers(0, 20)))
            packed = zlib.compressobj(0, zlib.DEFLATED, 31)
            f.write(packed.compress(warc.record(i, "http://x", body, "d", None)) + packed.flush() + b"\n" * (i % 3))
            wanted.add((f"<urn:page:{i}>", body))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert {(r.record_id, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect()} == wanted
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_archives_named_gz_and_other_members(spark, tmp_path):
    wanted, plain = set(), []
    for name in ("a.warc.gz", "b.warc.gz", "c.warc"):
        with open(tmp_path / name, "wb") as f:
            for i in range(20):
                body = f"{name} {i} WARC/1.1 inside\r\n\r\nWARC/1.".encode() * (i % 4)
                f.write(gzip.compress(warc.record(i, f"http://{name}", body, "d", None)))
                f.write(gzip.compress(b"no record at all " * 1000))
                wanted.add((f"http://{name}", body))
                plain.append(len(body))
    with open(tmp_path / "other.bin", "wb") as f:
        for i in range(50):
            f.write(gzip.compress(b"foreign " * 500))
    found = warc.read_warc(spark, str(tmp_path)).collect()
    assert {(r.target_uri, bytes(r.payload)) for r in found} == wanted and len(found) == len(plain)


# Packing


def test_ids_are_the_tokenizers_and_sequences_are_full(docs, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    for frame in (docs, edge):
        wanted = collections.Counter()
        for doc, text in frame.select("doc_id", "text").collect():
            ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
            for piece, at in enumerate(range(0, len(ids), 2048)):
                wanted[doc, piece, at, len(ids[at : at + 2048]), zlib.crc32(array.array("I", ids[at : at + 2048]).tobytes())] += 1
        found = packing.packing_report(frame).collect()
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
        sequences = collections.defaultdict(list)
        for r in found:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
        assert len(sequences) <= -(-sum(k[3] * n for k, n in wanted.items()) // 2048) + 1


def test_fullest_combination():
    assert sum(packing.fullest({7: 3, 5: 2, 2: 1}, 16)) == 16
    assert packing.fullest({9: 4}, 8) == [] and packing.fullest({3: 2}, 100) == [3, 3]
    assert packing.bins({}) == []


# Language and toxicity


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.language_report(docs).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.98
    assert np.mean([r.accepted for r in found]) > 0.98


def test_no_letters_no_language(edge, empty):
    found = {(r.doc_id, r.lang_pred, r.score) for r in langid.language_report(edge).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (17, "und", 0.0)} <= found and (7, "en") in {f[:2] for f in found}
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    model = langid.train(unlabelled)
    assert model.languages == [] and langid.keep_accepted(edge, model).count() == len([t for _, t in TEXTS if t and any(map(str.isalpha, t))])
    assert np.array_equal(langid.counts("ab" * langid.PIECE), langid.counts("ab" * langid.PIECE)) and langid.counts("ab" * langid.PIECE).sum() == 3 * (2 * langid.PIECE + 2) - 6


def test_many_languages(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of its own", f"l{i}") for i in range(1200)], "doc_id bigint, text string, lang string")
    assert 0 < len(langid.train(docs).languages) <= 1200


def test_toxicity(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in found]) > 0.97
    assert np.mean([r.predicted for r in found if r.toxic]) > 0.85
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity_report(edge, none).count() == len(TEXTS) and toxicity.toxicity_report(empty, none).count() == 0


def test_folding_and_exceptions():
    model = toxicity.fit([])
    automaton = toxicity.matcher(model)
    score = lambda text: toxicity.density(toxicity.fold(text), automaton)
    assert toxicity.fold("1D10T іdiоt st@pid!!") == ["idiot", "idiot", "stapid"]
    assert toxicity.fold("ТRАSH ＴＲＡＳＨ tr\u200bash trásh ΒΙΤCΗ") == ["trash"] * 4 + ["bitch"]
    assert score("you 1d10t") > 0 and score("put it in the trash can") == 0 and score("this is trash") > 0 and score("") == 0


def test_learned_exceptions_and_double_labels(spark):
    rows = [(True, f"you total filth number {k} go".split()) for k in range(40)] + [(False, f"the filth pump of ship {k} works".split()) for k in range(40)]
    model = toxicity.fit(rows)
    assert "filth pump" in model.exceptions and "total filth" not in model.exceptions
    automaton = toxicity.matcher(model)
    assert toxicity.density("the filth pump".split(), automaton) == 0 < toxicity.density("what a filth".split(), automaton)
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.toxicity_report(docs, labels).count() == 3


# Near duplicates


def by_hand(rows, radius):
    prints = []
    for doc, text in rows:
        words = split_words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = top[i], top[j]
                top = [b if t == a else t for t in top]
    least = {t: min((rows[i][0] for i in range(len(rows)) if top[i] == t and rows[i][0] is not None), default=None) for t in set(top)}
    return sorted((str(rows[i][0]), f"{prints[i]:016x}", least[top[i]]) for i in range(len(rows)))


def test_groups_by_hand(docs, edge):
    for frame in (docs, edge):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        assert sorted((str(r[0]), r[1], r[2]) for r in simhash_dedup.group_report(frame).collect()) == by_hand(rows, 2)


@pytest.mark.parametrize("radius,most", [(2, 8), (6, 1 << 16), (6, 8), (8, 4)])
def test_oversize_buckets_lose_nothing(docs, radius, most):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = simhash_dedup.near_groups(docs, radius=radius, most=most).collect()
    assert sorted((r.doc, r.component) for r in found) == sorted((int(a), c) for a, _, c in by_hand(rows, radius))


@pytest.mark.parametrize("group", [1000, 2])
def test_near_copies_are_verified_on_texts(spark, group, monkeypatch):
    """Edits of one word in about 45 leave a similarity of 0.8; unrelated texts and chains stay."""
    monkeypatch.setattr(simhash_dedup, "GROUP", group)
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{k}" for k in range(4000)])
    rows, truth = [], {}
    for k in range(150):
        base = vocabulary[rng.integers(0, 4000, rng.integers(60, 400))]
        rows.append((10 * k, " ".join(base)))
        for j in range(1, 4):
            copy = base.copy()
            at = rng.choice(len(copy), max(1, int(len(copy) * (0.005, 0.012, 0.02)[j - 1])), replace=False)
            copy[at] = vocabulary[rng.integers(0, 4000, len(at))]
            rows.append((10 * k + j, " ".join(copy)))
    sets = {i: set(simhash_dedup.shingles(t, 5)) for i, t in rows}
    truth = {i for i, _ in rows if any(simhash_dedup.similarity(sets[i], sets[10 * (i // 10) + j]) >= 0.8 for j in range(i % 10))}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash_dedup.drop_near_duplicates(docs).collect()}
    gone = {i for i, _ in rows} - kept
    assert gone <= truth and len(gone) >= 0.95 * len(truth) > 200
    for i in gone:
        assert any(simhash_dedup.similarity(sets[i], sets[j]) >= 0.8 for j in kept if j // 10 == i // 10)


def test_near_copies_at_the_edges(edge, empty):
    kept = simhash_dedup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and simhash_dedup.drop_near_duplicates(empty).count() == 0
    found = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    twice = edge.sparkSession.createDataFrame([(1, WORDS), (1, WORDS), (2, WORDS + " more"), (2, WORDS + " more"), (3, "x")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash_dedup.drop_near_duplicates(twice).collect()) == [1, 3]
    assert max(found.values()) == 1 and (1, None) in found and (2, "") not in found and (7, WORDS) in found and (15, WORDS) not in found and (11, " ".join(["same"] * 3000)) not in found


def test_bit_slices_count_differences():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    values[::7] = values[0] ^ (np.uint64(1) << rng.integers(0, 63, len(values[::7]), dtype=np.uint64))
    for radius in (0, 1, 2, 6):
        near = simhash_dedup.lanes_of(simhash_dedup.within(simhash_dedup.bit_planes(values), radius, int(values[0])), 500)
        assert near.tolist() == np.flatnonzero(np.bitwise_count(values ^ values[0]) <= radius).tolist()


# Decontamination


def test_reparameterised_questions(spark):
    ask = "Well {a} bought {n} apples and {m} pears for 8 dollars at the shop in Rome while {b} slept at home all day long."
    rows = [(1, ask.format(a="Anna", n=3, m=5, b="Anna")), (2, "So. " + ask.format(a="Tom", n=7, m=9, b="Tom")), (3, "Nothing of the kind is asked here at all, or there, or elsewhere."), (4, None), (5, ""), (6, ask.format(a="Tom", n=7, m=7, b="Bert"))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, hash int")
    items = spark.createDataFrame([(9, ask.format(a="Anna", n=3, m=5, b="Anna")), (8, None), (7, "a b c")], "item_id bigint, text string")
    found = {r.doc_id: r for r in decontamination.contamination_report(docs, items).collect()}
    assert found[1].reparameterised is False and found[2].reparameterised is True and not {3, 4, 5} & set(found)
    assert found[2].n_covered == found[2].n_tokens and 6 not in found
    assert decontamination.contamination_report(docs.where("false"), items).count() == 0
    assert decontamination.contamination_report(docs, items.where("false")).count() == 0


def test_leaks_by_brute_force(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    of = {r.item_id: grams(norm(r.text)) for r in items.collect()}
    wanted = {(r.doc_id, i) for r in docs.collect() for g in [grams(norm(r.text))] for i, own in of.items() if own & g}
    assert {(r.doc_id, r.item_id) for r in decontamination.contamination_report(docs, items).collect()} == wanted
    monkeypatch.setattr(decontamination, "TABLE", (8, 8))  # a table in which nearly all bits are set joins all the same
    assert {(r.doc_id, r.item_id) for r in decontamination.contamination_report(docs, items).collect()} == wanted


def test_copies_full_of_placeholders(spark):
    sums, title = "12 + 7 = 19 and 8 + 5 = 13", "Who Wrote The Old Man And The Sea"
    dense = "Peter Paul Mary Anna Tom Bert Rome Paris 17 18 19 20 Oslo Bern Ulm"
    rows = [(1, f"We know that {sums} as ever."), (2, f"It is asked. {title} in the end."), (3, f"Here is {dense} at last."), (4, "We know that 12 + 7 = 19 and 8 + 5 = 14 as ever."), (5, f"Here is {dense.replace('Oslo', 'Kiel').replace('Anna', 'Eva')} at last.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, sums), (2, title), (3, dense)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.n_covered, r.reparameterised) for r in decontamination.contamination_report(docs, items).collect()}
    assert found == {(1, 1, 7, False), (2, 2, 8, False), (3, 3, 15, False)}


def test_copies_in_other_case_and_after_headings(spark):
    german = "Am Abend geht der Hund mit Frau Meyer durch die Straße nach Haus"  # 13 tokens: each of them counts
    short, asked = "What is the capital of the large country", "When did Anna and Tom leave the old town of Rome for 3 days"
    rows = [(1, german.upper()), (2, f"ja {german.lower()} ja"), (3, f"Quiz questions\n{short}\nnext"), (4, f"Quiz questions {short}"), (5, f"Some of them\n{asked.replace('Anna', 'Eva')}"), (6, asked.replace("Anna", "Eva").replace("the old", "the\nold").replace("and Tom", "and\nTom"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, german), (2, short), (3, asked)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.n_covered, r.reparameterised) for r in decontamination.contamination_report(docs, items).collect()}
    assert found == {(1, 1, 13, False), (2, 1, 13, False), (3, 2, 8, False), (4, 2, 8, False), (5, 3, 14, True), (6, 3, 14, True)}


def test_planted_questions_with_other_values(spark):
    """Items asked again with other names (of one or two words), numbers and units; plain texts of the same words stay clean."""
    rng = np.random.default_rng(6)
    stems = [f"{a} {b} {c}" for a in ("walked to the market of", "sold the old boat near", "wrote a long letter from", "counted the green birds above", "rented a small room in") for b in ("{p}",) for c in ("with {n} friends and paid {m} {u} for it before the evening meal was ready at home", "after {n} visits that took {m} {u} each while nobody else was looking at the clock", "because {n} guests had waited {m} {u} in front of the closed gate by the river")]
    names, towns, units = ["Anna", "Peter", "Mary Ann", "Tom", "Eva Smith", "Otto"], ["Rome", "New York", "Oslo", "Saint John", "Bern"], ["minutes", "dollars", "hours", "miles", "euros"]
    draw = lambda stem: f"{rng.choice(names)} and {rng.choice(names)} " + stem.format(p=rng.choice(towns), n=rng.choice(["3", "twelve", "27", "twenty five"]), m=int(rng.integers(2, 900)), u=rng.choice(units))
    items = [(k, "It is told that " + draw(stem)) for k, stem in enumerate(stems)]
    filler = " ".join(f"plain{k}" for k in range(40))
    planted = [(100 + 10 * k + j, f"{filler}. It is told that {draw(stem)}. {filler}") for k, stem in enumerate(stems) for j in range(8)]
    clean = [(9000 + j, " ".join(rng.permutation(" ".join(t for _, t in items).split())[:300])) for j in range(30)]
    found = decontamination.contamination_report(spark.createDataFrame(planted + clean, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    held = {(r.doc_id, r.item_id) for r in found}
    assert len({(d, (d - 100) // 10) for d, _ in planted} & held) >= 0.9 * len(planted) and not {d for d, _ in held if d >= 9000}


def test_roles_and_short_items(spark):
    ask = "A farmer who had {a} cows sold {b} of the goats and kept {a} cows in the old barn all winter long."
    rows = [(1, ask.format(a=5, b=7)), (2, ask.format(a=5, b=5)), (3, ask.format(a=5, b=7).replace("kept 5", "kept 6")), (4, "intro\nWho is he?\nend"), (5, "They ask who is he in vain"), (6, "WHO IS HE")]
    items = [(1, ask.format(a=3, b=3)), (2, "Who is he?"), (3, "?")]
    found = {(r.doc_id, r.item_id, r.reparameterised) for r in decontamination.contamination_report(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert found == {(1, 1, True), (2, 1, True), (4, 2, False), (6, 2, False)}


# Personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) if k % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for k, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15
            if not bad:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_base_spans(docs, edge):
    extra = [(20, "a@b.c_d@e.f %x@y.zz%q@r.s"), (21, "+1 (2) 3"), (22, "1-2-3-4 5555 5555 5555 4444 " * 3), (23, "255.255.255.255.1 00012.1.1.1 +12.34.56.78.90 1")]
    more = edge.sparkSession.createDataFrame([(i, t, None, None, 0, "", 0, 0.0, "", "") for i, t in extra], SCHEMA)
    for frame in (docs.select("doc_id", "text"), edge.union(more)):
        wanted = []
        for doc, text in frame.select("doc_id", "text").collect():
            spans = base_spans(text)
            counts = [sum(s.startswith(k + ":") for s in spans) for k in KINDS]
            wanted.append(str((doc, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest())))
        found = pii.span_report(frame).collect()
        assert sorted(str(tuple(r)[:6]) for r in found) == sorted(wanted)


def test_secrets_are_added(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {(r.doc_id, s) for r in pii.span_report(docs).collect() for s in r.spans.split(",") if s.startswith("secret")}
    wanted = {(i, f"secret:{m.start(1)}:{m.end(1)}") for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert wanted and len(found & wanted) >= 0.9 * len(wanted) and len(found - wanted) <= 0.1 * len(wanted)


def test_rare_kinds_are_kept(spark):
    """One account and one national id in 8000 documents, outside the sample of documents."""
    rows = [(i, f"mail a{i}@b.co, host 10.0.0.{i % 512}, card {4000 + i} 1111 1111 1111") for i in range(8000)]
    outside = [r.doc_id for r in spark.range(8000).select(F.col("id").alias("doc_id")).where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(1 << 30) > 0.6).limit(2).collect()]
    extra = {outside[0]: "pay to DE89 3704 0044 0532 0130 00 now", outside[1]: "number 123-45-6789 here"}
    docs = spark.createDataFrame([(i, extra.get(i, t)) for i, t in rows], "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in pii.span_report(docs).where(F.col("doc_id").isin(*extra)).collect()}
    assert "account:7:34" in found[outside[0]] and found[outside[1]] == "national_id:7:18"
    alone = spark.createDataFrame([(1, "mail a@b.co"), (2, extra[outside[1]])], "doc_id bigint, text string")
    assert {r.doc_id: r.spans for r in pii.span_report(alone).collect()}[2] == "national_id:7:18"


def test_rejected_spans_block_nothing(spark, monkeypatch):
    frame = spark.createDataFrame([(1, 1, kind, a, b, base, kind != "card", *[0] * len(pii.FEATURES)) for kind, a, b, base in (("secret", 0, 30, False), ("local_phone", 20, 50, False), ("account", 40, 70, False), ("email", 80, 90, True), ("account", 85, 99, False), ("secret", 92, 120, False), ("card", 130, 140, False))], "doc bigint, row bigint, kind string, start int, stop int, base boolean, valid boolean, " + ", ".join(f"{f} int" for f in pii.FEATURES))
    monkeypatch.setattr(pii, "candidates", lambda docs, **_: docs)
    found = pii.spans(frame, pii.Model(1.0, [], {k: 0.5 for k in pii.KINDS})).collect()
    assert sorted((r.start, r.stop) for r in found) == [(0, 30), (40, 70), (80, 90), (92, 120)]


def test_planted_kinds(spark):
    """Recall and precision of the added kinds, beside look-alikes that fail a check or that nothing announces."""
    rng = np.random.default_rng(8)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def account():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    def bad_account():
        a = account()
        return a[:2] + f"{(int(a[2:4]) + 1) % 90 + 5:02d}" + a[4:]

    plant = {"account": lambda: account(), "national_id": lambda: f"{rng.integers(100, 660)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}", "local_phone": lambda: f"({rng.integers(200, 999)}) {rng.integers(200, 999)}-{digits(4)}", "secret": lambda: "".join(rng.choice(list("0123456789abcdef"), 40))}
    decoys = [bad_account, lambda: f"666-{rng.integers(10, 99)}-{digits(4)}", lambda: f"(1{digits(2)}) 055-{digits(4)}", lambda: "".join(rng.choice(list("aeioutrn"), 26)), lambda: "/".join("".join(rng.choice(list("abcdef"), 6)) for _ in range(5))]
    rows, truth = [], set()
    for i in range(1200):
        kind = [*plant, None, None][i % 6]
        before = f"word {rng.choice(['one', 'two', 'three'])} " + ('api_token = "' if kind == "secret" else "")
        value = plant[kind]() if kind else decoys[i % len(decoys)]()
        rows.append((i, f"{before}{value}{chr(34) if kind == 'secret' else ''} and more"))
        if kind:
            truth.add((i, f"{kind}:{len(before)}:{len(before) + len(value)}"))
    found = {(r.doc_id, s) for r in pii.span_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() for s in r.spans.split(",") if s.split(":")[0] in plant}
    for kind in plant:
        own, got = ({x for x in xs if x[1].startswith(kind)} for xs in (truth, found))
        assert len(own & got) >= 0.95 * len(own) and len(own & got) >= 0.95 * len(got), kind


def test_the_better_of_overlapping_spans_is_taken(spark, monkeypatch):
    tree = pii.Node(pii.FEATURES.index("digits"), 0.5, pii.Node(value=0.0), pii.Node(value=2.0))
    columns = "doc bigint, row bigint, kind string, start int, stop int, base boolean, valid boolean, " + ", ".join(f"{f} int" for f in pii.FEATURES)
    rows = [(1, 1, k, a, b, False, True, *[int(f == "digits" and d) for f in pii.FEATURES]) for k, a, b, d in (("secret", 0, 30, 0), ("account", 25, 60, 1), ("local_phone", 55, 70, 0), ("secret", 65, 90, 0))]
    monkeypatch.setattr(pii, "candidates", lambda docs, **_: docs)
    found = pii.spans(spark.createDataFrame(rows, columns), pii.Model(0.5, [tree], {k: 0.5 for k in pii.KINDS})).collect()
    assert sorted((r.start, r.stop) for r in found) == [(25, 60), (65, 90)]


def test_native_operators_run_no_python(spark, docs, capsys):
    for frame in (line_dedup.line_report(docs), pii.span_report(docs)):
        frame.explain()
        assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# Substrings


def kept_by_hand(rows):
    first, out = {}, []
    for doc, text in rows:
        for i in range(len(w := split_words(text)) - 12):
            first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), 1 << 62), -1 if doc is None else doc)
    for doc, text in rows:
        w = split_words(text)
        gone = {k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < (-1 if doc is None else doc) for k in range(i, i + 13)}
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [6, 2])
def test_repeats_by_hand(docs, edge, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD", 2000)
    for frame in (docs, edge):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        assert sorted(map(str, map(tuple, substring_dedup.repeat_report(frame).collect()))) == kept_by_hand(rows)


def test_wavelet_ranks_and_backward_search():
    rng = np.random.default_rng(2)
    symbols = np.append(rng.integers(1, 6, 400), 0)
    symbols[300:360] = symbols[100:160]
    index = substring_dedup.FmIndex(symbols, 6)
    for length in (1, 2, 5, 40):
        for at in rng.integers(0, 350, 20):
            pattern = symbols[at : at + length]
            low, high = np.array([0]), np.array([len(symbols)])
            for s in pattern[::-1]:
                low, high = index.extend(np.array([s]), low, high)
            assert int(high[0] - low[0]) == sum(np.array_equal(symbols[i : i + length], pattern) for i in range(len(symbols) - length + 1))


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    data = b"  ab \tcd\n" + b"x" * 300 + b" ab cd \x0b\x0cab"
    starts, ends, whole = substring_dedup.hashed_words(data)
    assert [data[a:b] for a, b in zip(starts, ends)] == data.split() and whole[0] == whole[3] == whole[5] and whole[1] == whole[4] != whole[0]
    monkeypatch.setattr(substring_dedup, "PIECE", 16)
    assert all(np.array_equal(x, y) for x, y in zip(substring_dedup.hashed_words(data), (starts, ends, whole)))
    assert not len(substring_dedup.hashed_words(b"")[0]) and not len(substring_dedup.hashed_words(b" " * 100)[0])


def test_matching_statistics_by_hand():
    rng = np.random.default_rng(3)
    texts = [[b"w%d" % k for k in rng.integers(0, 4, n)] for n in (30, 13, 76, 40)]
    texts += [texts[0][5:25], texts[2][:60], texts[1]]
    docs = np.array([5, 7, 7, 2, 9, 1, 3])
    least, length = substring_dedup.matched(substring_dedup.Shard([b" ".join(t) for t in texts], np.array([len(t) - 12 for t in texts]), docs))
    held = [{b" ".join(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)} for t in texts]
    wanted = []
    for t, doc in zip(texts, docs):
        for end in range(13, len(t) + 1):
            longest = max((n for n in range(1, end + 1) if any(b" ".join(t[end - n : end]) in h for h, d in zip(held, docs) if d < doc)), default=0)
            wanted.append((min(d for h, d in zip(held, docs) if b" ".join(t[end - 13 : end]) in h), longest))
    assert list(zip(least.tolist(), length.tolist())) == wanted


def test_every_repeat_comes_out_of_an_index(docs, monkeypatch):
    """Without the index, no window of a copy or of a common passage is taken for a repeat either."""
    monkeypatch.setattr(substring_dedup, "repeats_in_shards", lambda parts: parts.selectExpr("key", "struct(row, start AS first, start AS last) AS x").where("false"))
    monkeypatch.setattr(substring_dedup, "repeats_of_common", substring_dedup.repeats_in_shards)
    assert substring_dedup.remove_repeats(docs).agg(F.sum("n_removed")).first()[0] == 0


# All together


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op3_warc", "op6_toxicity", "op8_decontamination")])
def test_empty_tables_give_empty_results(empty, name, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, which: empty)
    assert queries.queries()[name](empty.sparkSession, "") .count() == 0


def test_pipeline_at_the_edges(spark, edge, empty, monkeypatch):
    more = edge.sparkSession.createDataFrame([(k, f"{WORDS} text number {k} of {k * k} words in all", "en", "s", 0, "r", k, 0.5, "x", "y") for k in range(100, 130)], SCHEMA)
    docs = edge.union(more)
    for frame in (docs, empty):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == frame.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        ids = [r.doc_id for r in now.collect()]
        assert sorted(map(str, {r.doc_id for r in packed})) == sorted(map(str, set(ids)))
    assert 1 not in ids and not ids
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    # One text of the list in several forms and under several ids: the smallest id keeps it, 15 has another one beside.
    assert kept.count(15) == 1 and 7 in kept and not {8, 9, 11} & set(kept) and kept.count(None) == 1


def test_pipeline_equals_its_operators_by_brute_force(spark):
    """The final rows against plain Python on what the language stage keeps: lines, near copies, benchmark passages, tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    kept = {r.doc_id: r.text for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = collections.defaultdict(set)
    for i, t in kept.items():
        for line in t.split("\n"):
            holders[key(line)].add(i)
    lost = {k: max(h) for k, h in holders.items() if len(k) >= 20 and len(h) >= 3}
    lines = {i: "\n".join(x for x in t.split("\n") if i >= lost.get(key(x), i)) for i, t in kept.items()}
    shingled, stay = {i: set(simhash_dedup.shingles(t, 5)) for i, t in lines.items()}, []
    for i in sorted(lines):
        if all(simhash_dedup.similarity(shingled[i], shingled[j]) < 0.8 for j in stay):
            stay.append(i)
    norm = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    bad = set().union(*[grams(norm(r.text)) for r in items.collect()])
    stay = [i for i in stay if not grams(norm(lines[i])) & bad]
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    wanted = collections.Counter()
    for i in stay:
        ids = whole.encode(lines[i], add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            wanted[i, piece, at, len(ids[at : at + 2048]), zlib.crc32(array.array("I", ids[at : at + 2048]).tobytes())] += 1
    found = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    # Fingerprints may fail to nominate a near copy, about one in a hundred; nothing else may differ.
    assert not wanted - found and len({x[0] for x in found - wanted}) <= 1 + 0.02 * (len(lines) - len(stay))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now, sizes = docs, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(now.count())
        if k < 4:
            assert now.columns == docs.columns
    assert sizes[0] >= sizes[1] == sizes[2] > sizes[3] >= sizes[4] > 0
    kept = {r[0] for r in spark.read.parquet(str(tmp_path / "3")).select("doc_id").collect()}
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == kept
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(now)


def test_calculations_asked_again(spark):
    """Arithmetic with other numbers: found where the words and the signs are the same, not where they differ."""
    rng = np.random.default_rng(17)
    number = lambda: str(int(rng.integers(2, 999)))
    heads = ["Compute", "What is", "Evaluate the expression", "Find the value of", "Simplify"]

    def asked(head, signs):
        return f"{head} " + " ".join([number(), *[x for s in signs for x in (s, number())]]) + " ."

    items, docs, truth = [], [], set()
    for k in range(60):
        head, signs = heads[k % 5], [str(x) for x in rng.choice(["+", "-", "*", "/"], int(rng.integers(3, 8)))]
        if (head, tuple(signs)) in {(h, s) for h, s, _ in items}:
            continue
        items.append((head, tuple(signs), len(items)))
        docs.append((k, f"Some words stand before the question of the day . {asked(head, signs)} Nobody knew what came after it ."))
        truth.add((k, items[-1][2]))
    wrong = [(1000 + k, "The shop sold " + " and ".join(f"{number()} boxes on day {number()}" for _ in range(4)) + f" - a record . It had {number()} / {number()} left .") for k in range(60)]
    table = spark.createDataFrame([(i, asked(h, s)) for h, s, i in items], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contamination_report(spark.createDataFrame(docs + wrong, "doc_id bigint, text string"), table).collect()}
    same = {(d, i) for d, j in truth for h, s, i in items if (h, s) == items[j][:2]}
    assert len(found & truth) >= 0.9 * len(truth) and len(found & same) >= 0.9 * len(found) and not any(d >= 1000 for d, _ in found)
    words = decontamination.Words()
    short = {w[0] for w in decontamination.windows("What is 12 + 7 ?", words, None, None)}
    assert short & {w[0] for w in decontamination.windows("He asked : What is 345 + 9 ? Then he left .", words, [5], None)}


def _ogg(pages, serial=7, sizes=(40, 300)):
    out = b""
    for k in range(pages):
        body = bytes((k * 31 + j) % 251 for j in range(sizes[k % 2]))
        lacing = bytes([255] * (len(body) // 255) + [len(body) % 255])
        page = b"OggS\0" + bytes([(2 if k == 0 else 0) | (4 if k == pages - 1 else 0)]) + bytes(8) + serial.to_bytes(4, "little") + k.to_bytes(4, "little") + bytes(4) + bytes([len(lacing)]) + lacing + body
        out += page[:22] + media._page_sum(page).to_bytes(4, "little") + page[26:]
    return out


def test_pages_of_a_stream_are_one_medium():
    five = _ogg(5)
    found = [(f.offset, f.length) for f in media.carve(b"before" + five + b"after")]
    assert found == [(6, len(five))]
    broken = bytearray(five)
    broken[len(five) // 2] ^= 1
    assert media.carve(bytes(broken)) == [] and media.carve(five[:-1]) == [] and media.carve(_ogg(3)[60:]) == []
    start = time.perf_counter()
    assert len(media.carve(_ogg(2000))) == 1 and time.perf_counter() - start < 5
