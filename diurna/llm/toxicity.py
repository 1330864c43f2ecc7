"""Toxicity from a weighted lexicon.

Texts are folded (letters that look alike, accents, full width, invisible signs, lower case, digits that stand for
letters) and matched in one pass of Aho-Corasick. Weights come from a bounded sample of labelled rows: the log ratio of an entry's rate
in toxic and in other texts. The sum of the weights is divided by the number of words and turned into a
probability by a logistic curve fitted to the same sample. Words inside an exception phrase do not count; phrases
of two words in which an entry is harmless are learned too.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import learned_from

#: Most labelled rows that a fit takes to the driver, half of them toxic, and their longest text.
SAMPLE, SAMPLE_CHARS = 3000, 50_000
#: Words that count before any label is seen, and phrases in which such words are harmless.
SEED = "idiot moron clown worthless scum pathetic disgusting trash stupid loser dumb imbecile jerk bastard bitch asshole shit fuck retard pig vermin filth".split()
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "recycling and trash", "clown fish", "circus clown", "pond scum", "soap scum", "guinea pig", "pig iron", "loser bracket"]
#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏпАВЕКМНОРСТУХαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlnabekmhopctyxaeiknoptuxabezhikmnoptyx"))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = re.compile(r"(?<=\w)[@$](?=\w)")
_TABLE = str.maketrans({**{c: " " for c in map(chr, range(128)) if not c.isalnum()}, **DIGITS})
_ALIKE = str.maketrans(LOOKALIKES)
#: Accents, and signs that are not seen.
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
#: Longest beginning of a word that is an entry; longer words are entries only as a whole.
PREFIXES = range(4, 9)
#: Least toxic texts with an entry, and least log ratio of its rates.
LEAST_TEXTS, LEAST_RATIO = 5, 2.0
#: Least evidence for an entry, in nats: how far the toxic share of the texts with it is from that of all.
LEAST_EVIDENCE = 8.0
MOST_WEIGHT = 6.0
#: Harmless texts, and no toxic one, that must hold a phrase of an entry and its neighbour for it to be an exception.
HARMLESS = 5


def fold(text: str) -> list[str]:
    """The words of a text after folding. Signs count as letters only inside a word."""
    if not text.isascii():
        # Look-alikes first, while capitals can be told from small letters.
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_ALIKE))).translate(_ALIKE)
    if "@" in text or "$" in text:
        text = SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text.lower().translate(_TABLE).split()


class Model(NamedTuple):
    weights: dict[str, float]  # " word " or " beginning" -> weight
    slope: float
    base: float
    exceptions: tuple[str, ...] = ()


def matcher(model: Model) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for entry, weight in model.weights.items():
        out.add_word(entry, (len(entry), weight))
    for phrase in {*EXCEPTIONS, *model.exceptions}:
        out.add_word(f" {phrase} ", (len(phrase) + 2, None))
    out.make_automaton()
    return out


def density(words: list[str], automaton: ahocorasick.Automaton) -> float:
    """The entries' weights, the longest at each word's start, for each word of the text."""
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end + 1 - size
        if weight is None:
            spared.append((start, end))
        elif best.get(start, (0,))[0] < size:
            best[start] = (size, weight)
    for a, b in spared:
        for start in [s for s in best if a <= s < b]:
            del best[start]
    return sum(w for _, w in best.values()) / (len(words) + 5)


def chance(x: float, model: Model) -> float:
    z = model.slope * x + model.base
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def entries(words: Iterable[str]) -> Iterator[str]:
    for word in words:
        yield f" {word} "
        for n in PREFIXES:
            if len(word) > n:
                yield f" {word[:n]}"


def evidence(with_entry: int, toxic: int, share: float) -> float:
    """Log-likelihood gain of the entry's own toxic share over the common one."""
    p = toxic / with_entry
    harmless = (with_entry - toxic) * np.log((1 - p) / (1 - share)) if p < 1 else 0.0
    return float(toxic * np.log(p / share) + harmless)


def learned_exceptions(rows: list[tuple[bool, list[str]]], weights: dict[str, float]) -> tuple[str, ...]:
    """Pairs of neighbours with a whole-word entry that HARMLESS texts hold and no toxic one, although toxic texts hold the entry."""
    texts = {k: Counter() for k in (True, False)}
    for toxic, words in rows:
        texts[toxic].update({f"{a} {b}" for a, b in zip(words, words[1:]) if f" {a} " in weights or f" {b} " in weights})
    return tuple(sorted(p for p, n in texts[False].items() if n >= HARMLESS and p not in texts[True]))


def fit(rows: list[tuple[bool, list[str]]]) -> Model:
    """``rows``: (toxic, folded words). Without both kinds, the seed words alone decide."""
    total = {k: sum(len(w) for t, w in rows if t == k) + 1 for k in (True, False)}
    hits = {k: Counter() for k in (True, False)}
    texts = {k: Counter() for k in (True, False)}
    for toxic, words in rows:
        own = Counter(entries(words))
        hits[toxic].update(own)
        texts[toxic].update(own.keys())
    share = sum(t for t, _ in rows) / max(1, len(rows))
    weights = {f" {w} ": 3.0 for w in SEED}
    known = [e for e, n in texts[True].items() if n >= LEAST_TEXTS and share < 1 and evidence(n + texts[False][e], n, share) >= LEAST_EVIDENCE]
    for entry in sorted(known, key=lambda e: (len(e), e)):
        ratio = float(np.log((hits[True][entry] + 0.5) / total[True]) - np.log((hits[False][entry] + 0.5) / total[False]))
        shorter = max((weights.get(entry[:n], 0.0) for n in range(5, len(entry))), default=0.0)
        if ratio >= max(LEAST_RATIO, shorter + 0.5):
            weights[entry] = min(MOST_WEIGHT, ratio)
    exceptions = learned_exceptions(rows, weights)
    model = Model(weights, 60.0, -3.0, exceptions)
    y = np.array([t for t, _ in rows], float)
    if not 0 < y.sum() < len(y):
        return model
    automaton = matcher(model)
    x = np.array([density(w, automaton) for _, w in rows])
    # Newton's method on two numbers, both kinds of equal weight, lightly held back.
    scale = max(float(x[y == 1].mean()), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    sides = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -50, 50)))
        slope = a.T @ (sides * (p - y)) + 0.02 * b
        curve = (a * (sides * p * (1 - p))[:, None]).T @ a + 0.02 * np.eye(2)
        b -= np.linalg.solve(curve, slope)
    return Model(weights, float(b[0] / scale), float(b[1]), exceptions)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` rows about, chosen by a hash of their id, toxic and others alike.

    Callers filter rows that training may not see. Rows without text or label are not taken. An id that is labelled
    more than once is one, and toxic if any of its labels says so; documents that share it each count.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col) == 1).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1 << 30)) / F.lit(1 << 30)
    share = F.when(F.col("toxic"), F.lit(sample / 2 / max(1, sizes.get(True, 0)))).otherwise(F.lit(sample / 2 / max(1, sizes.get(False, 0))))
    chosen = marks.where(place < share).limit(2 * sample)
    texts = docs.where(F.col(text_col).isNotNull() & (F.char_length(text_col) <= SAMPLE_CHARS)).select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("toxic", "text").limit(4 * sample).collect()
    return fit(sorted((r["toxic"], fold(r["text"])) for r in rows))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, score, predicted`` of every row: a probability, and 1 where it is 0.5 or more.

    A null or empty text has no matches, so it gets the curve's lowest value. Rows stand alone; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = matcher(model)
        for batch in batches:
            scores = [chance(density(fold(t or ""), automaton), model) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc", "score", "predicted"])

    return rows.mapInArrow(work, "doc bigint, score double, predicted int")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows with CRC-32 mod 5 = 0 are held out of training."""
    model = train(docs, labels.where(learned_from("doc_id", 5, 0)))
    return score(docs, model).select(F.col("doc").alias("doc_id"), (~learned_from("doc", 5, 0)).alias("held_out"), "score", "predicted")
