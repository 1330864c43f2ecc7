"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Training takes a bounded sample of labelled rows to the driver as subword counts and fits both layers by
stochastic gradient descent in numpy. Scoring multiplies the two layers once, so that a text costs one pass
over its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that subwords are hashed to, and the embeddings' width.
BUCKETS, WIDTH = 8192, 16
#: Characters of a text that are hashed at once.
PIECE = 1 << 18
#: Steps of stochastic gradient descent, of 16 rows each, whatever the size of the sample.
STEPS = 1200
#: Most labelled rows that a fit takes to the driver, over all languages.
SAMPLE = 2400
#: Most characters of a text that may be one of these rows. Scoring takes texts of any length, whole.
SAMPLE_CHARS = 50_000
UNDETERMINED = "und"
#: Share of right predictions that calibration lets rejection lose, and a confidence above which none is rejected.
LOST, SURE = 0.001, 0.5


def counts(text: str) -> np.ndarray:
    """Hashed counts of the text's runs of two, three and four characters, a blank at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(codes) - 1, 1), PIECE):
        c = codes[at : at + PIECE + 3]
        h = c
        for n in (2, 3, 4):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]
            own = h[: PIECE]  # runs that start in this piece; the last few characters only end them
            out += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(19), minlength=BUCKETS)
    return out


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    least: float  # calibrated confidence below which a prediction is rejected


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(labels: list[str], x: np.ndarray, *, steps: int = STEPS, rate: float = 0.5, seed: int = 7) -> Model:
    """``x``: hashed counts of each labelled row (changed in place). A fifth of the rows, drawn at random,
    calibrates the temperature and the rejection."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    y = np.array([languages.index(labels[k]) for k in order])
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    held = len(labels) // 5
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    linear, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    weight = len(labels) / (len(languages) * np.bincount(y, minlength=len(languages)))
    train = np.arange(held, len(labels))
    epochs = max(1, -(-steps * 16 // max(1, len(train))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) * 20
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 16)):
            if not len(batch):
                continue
            own = x[order[batch]]
            mean = own @ embed
            slope = softmax(mean @ linear + bias)
            slope[np.arange(len(batch)), y[batch]] -= 1
            slope *= (weight[y[batch]] / len(batch))[:, None]
            back = slope @ linear.T
            linear -= np.float32(step / 20) * (mean.T @ slope)
            bias -= np.float32(step / 20) * slope.sum(axis=0)
            embed -= np.float32(step) * (own.T @ back).astype(np.float32)
    table = embed @ linear
    logits = x[order[:held]] @ table + bias
    temperature, least = 1.0, 0.0
    if held:
        tried = np.geomspace(0.25, 20, 61)
        losses = [-np.log(softmax(logits / t)[np.arange(held), y[:held]] + 1e-12).mean() for t in tried]
        temperature = float(tried[int(np.argmin(losses))])
        p = softmax(logits / temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[:held]])
        least = float(min(SURE, right[int(LOST * len(right))])) if len(right) else 0.0
    return Model(languages, table.astype(np.float32), bias, temperature, least)


def learned_from(id_col: str, modulus: int, held: int) -> Column:
    """Rows whose id's CRC-32, taken as text, does not leave the held-out remainder; a null id is never held out."""
    return ~F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == held, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` rows with a text and a language, each language up to an equal share.

    Rows are chosen by a hash of their id. Callers filter rows that training may not see.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.char_length(text_col) <= SAMPLE_CHARS))
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    share = sample / max(1, len(sizes))
    # At most ``sample`` languages, so the table of their chances is small.
    chances = docs.sparkSession.createDataFrame([(lang, share / n) for lang, n in sizes.items()], "known string, chance double")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(1 << 30)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in batch.column(1).to_pylist()]
            where = [np.flatnonzero(c) for c in found]
            # Packed, so that the driver holds no list of numbers for each row.
            buckets = pa.array([w.astype("<u2").tobytes() for w in where], pa.binary())
            values = pa.array([c[w].astype("<u4").tobytes() for c, w in zip(found, where)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), buckets, values], ["lang", "buckets", "counts"])

    chosen = rows.join(F.broadcast(chances), F.col("lang") == F.col("known")).where(place < F.col("chance")).select("lang", "text").limit(2 * sample)
    packed = sorted((r["lang"], bytes(r["buckets"]), bytes(r["counts"])) for r in chosen.mapInArrow(work, "lang string, buckets binary, counts binary").collect())
    x = np.zeros((len(packed), BUCKETS), np.float32)
    for row, (_, buckets, values) in zip(x, packed):
        row[np.frombuffer(buckets, "<u2")] = np.frombuffer(values, "<u4")
    return fit([r[0] for r in packed], x)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, lang_pred, score, accepted`` of every row.

    ``score`` is the calibrated probability of the predicted language. A null text, one without any letter,
    and every text under a model that learned no language is ``und`` with score 0. ``accepted`` is false for
    those and for predictions below the calibrated confidence. Rows stand alone; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                if not model.languages or text is None or not any(map(str.isalpha, text)):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                c = counts(text)
                p = softmax((c @ model.table / max(1, c.sum()) + model.bias) / model.temperature)
                langs.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            accepted = [lang != UNDETERMINED and s >= model.least for lang, s in zip(langs, scores)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["doc", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(work, "doc bigint, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, decided beside the row without a join.

    Under a model that learned no language, every text with a letter stays.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(1).to_pylist():
                if not model.languages or text is None or not any(map(str.isalpha, text)):
                    keep.append(not model.languages and any(map(str.isalpha, text or "")))
                    continue
                c = counts(text)
                p = softmax((c @ model.table / max(1, c.sum()) + model.bias) / model.temperature)
                keep.append(bool(p.max() >= model.least))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], ["row"])

    return packed.mapInArrow(work, f"row {packed.schema['row'].dataType.simpleString()}").select("row.*")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted; rows with CRC-32 mod 4 = 2 are held out of training."""
    model = train(docs.where(learned_from("doc_id", 4, 2)))
    found = identify(docs, model)
    return found.select(F.col("doc").alias("doc_id"), (~learned_from("doc", 4, 2)).alias("held_out"), "lang_pred", "score", "accepted")
