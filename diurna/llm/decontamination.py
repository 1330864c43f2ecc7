"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders (a name or a number of several words is one), so that a question
asked again with other values keeps its template. Windows of templates are joined by hash; what joins counts only
where the values behind the placeholders change consistently: a name or unit of the item stands for one of the
document and the other way round, and a number that is said again of the same thing stays one number.
A second form depends neither on case nor on sentences: names are plain words in it, and where numbers and
units fill too much of a window, so are they. A third one keeps the signs between numbers as words, so that a calculation
has a template of its own: the signs and their order hold where nearly all else is numbers. One that is written with its
result counts only with the same numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a window; an item of fewer is one window. One of fewer than LEAST counts only word by word, as whole lines.
WINDOW, LEAST = 10, 5
#: Tokens that consistent windows must cover to count: this many, or all of a shorter item.
COVERED = 13
#: Share of a window that placeholders may fill; a fuller one counts only where its tokens are the same.
SLOTS = 0.5
#: Tasks get a bit for each window hash of the items, in a table of 64 bits a hash between these sizes (powers of two).
TABLE = (22, 27)
#: Words a task remembers.
REMEMBERED = 400_000

#: Words for numbers, and units (which count only after a number).
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons oz lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years c f k celsius fahrenheit kelvin percent dollar dollars cent cents euro euros v volt volts w watt watts j joule joules n newton newtons hz khz mhz mph kmh kph degrees degree".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
_EDGE = re.compile(r"^[^\w+$€£-]+|[^\w%]+$|^[_-]+(?!\d)|_+$")
#: Signs that may stand after a word of letters, and none or those of them that end a sentence.
_AFTER, _ENDING = frozenset(",.;:?!"), frozenset(".;:?!")
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 4
#: The word ends a sentence; nothing of it is left; a sign ends it; a number in letters; a sign of calculation.
ENDS, BARE, STOPS, SPELT, SIGN = 8, 16, 32, 64, 128
#: Flags of words of letters that stand for numbers or units.
_KNOWN = {w: UNIT for w in UNITS} | {w: NUMBER | SPELT for w in NUMBERS}
#: Signs of calculation that stand alone.
SIGNS = frozenset("+ - − * × · / ÷ = ^ ** < > ≤ ≥ % ( )".split())
_KIND = {NUMBER: 0x9E3779B97F4A7C15, UNIT: 0xC2B2AE3D27D4EB4F, NAME: 0x165667B19E3779F9}
_FACTOR = 0x100000001B3
#: Sets hashes of tokens apart from those of templates.
_EXACT = np.uint64(0xD6E8FEB86659FD93)
#: Marks calculations that go on before or after a window.
_OPEN = np.array([0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class Words(dict):
    """Raw word -> its number in ``hashes``, ``flags`` and ``texts``; placeholders depend on the words around."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.texts: list[str] = []
        self._hashes, self._flags = np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)
        #: Hashes and flags of words that are not in the arrays yet.
        self.new: tuple[list[int], list[int]] = [], []

    def __missing__(self, raw: str) -> int:
        # Most words are letters, and perhaps one sign after them: these need no patterns.
        if raw.isalpha():
            text, flags = raw, 0
        elif raw[-1:] in _AFTER and raw[:-1].isalpha():
            text, flags = raw[:-1], STOPS | ENDS if raw[-1] in _ENDING else STOPS
        else:
            text = None
        if text is None:
            low, flags = self.read(raw)
        else:
            small = text.islower()
            low = text if small and text.isascii() else text.casefold()
            if low in _KNOWN:
                flags |= _KNOWN[low]
            elif not small and text[:1].isupper() and text[1:].islower():
                flags |= NAME
        self[raw] = k = len(self.texts)
        self.texts.append(low)
        self.new[0].append(xxhash.xxh64_intdigest(low.encode("utf-8", "replace")))
        self.new[1].append(flags)
        return k

    def _settle(self) -> None:
        if self.new[0]:
            n = len(self.texts)
            if n > len(self._hashes):
                self._hashes, self._flags = np.resize(self._hashes, 2 * n), np.resize(self._flags, 2 * n)
            self._hashes[n - len(self.new[0]) : n] = np.array(self.new[0], np.uint64)
            self._flags[n - len(self.new[1]) : n] = self.new[1]
            self.new = [], []

    @property
    def hashes(self) -> np.ndarray:
        self._settle()
        return self._hashes

    @property
    def flags(self) -> np.ndarray:
        self._settle()
        return self._flags

    @staticmethod
    def read(raw: str) -> tuple[str, int]:
        """What is left of a word in small letters, and its flags."""
        text = _EDGE.sub("", raw)
        flags = ENDS if raw.rstrip("\"')]}»”’*#%$&!")[-1:] in (".", "?", "!", ":", ";", "|", "") or raw.endswith(("!", "?")) else 0
        low = text.casefold()
        if raw in SIGNS:
            low, flags = raw, flags | BARE | SIGN
        elif not low.strip("_-+$€£"):
            flags |= BARE
        elif _NUMBER.fullmatch(low):
            flags |= NUMBER
        elif low in NUMBERS or "-" in low and NUMBERS.issuperset(low.split("-")):
            flags |= NUMBER | SPELT
        elif low in UNITS:
            flags |= UNIT
        elif text[:1].isupper() and text[1:].islower():
            flags |= NAME
        if not raw[-1:].isalnum():
            flags |= STOPS
        return low, flags


class Form(NamedTuple):
    """One reading of a text: words as numbers in ``Words``, some of them joined to tokens of one kind each."""

    hashes: np.ndarray  # of each token's own words
    kinds: np.ndarray
    first: np.ndarray  # word that each token starts at
    ends: np.ndarray  # and the one after it
    words: np.ndarray
    #: Where each token starts and ends among ``words``, in a form that holds more words than are counted.
    own: tuple[np.ndarray, np.ndarray] | None = None
    signs: np.ndarray | None = None
    #: Signs that stand between a calculation and its result.
    told: np.ndarray | None = None

    def text(self, words: Words, j: int) -> str:
        first, ends = self.own or (self.first, self.ends)
        return " ".join(words.texts[k] for k in self.words[first[j] : ends[j]])


def _signed(k: np.ndarray, flags: np.ndarray, words: Words) -> Form | None:
    """The form that keeps the signs next to a number or to such a sign; places count the other words only."""
    here = np.flatnonzero((flags & BARE == 0) | (flags & SIGN > 0))
    k, flags = k[here], flags[here]
    sign, number = (flags & SIGN) > 0, (flags & NUMBER) > 0
    if not sign.any() or not number.any():
        return None
    side = number | sign
    beside = np.concatenate(([False], side[:-1])) | np.concatenate((side[1:], [False]))
    run = np.cumsum(np.concatenate(([True], side[1:] != side[:-1])))
    numbered = np.bincount(run, number)[run] > 0  # a run of numbers and signs has a number in it
    keep = ~sign | beside & numbered
    k, sign, number, flags = k[keep], sign[keep], number[keep], flags[keep]
    if not sign.any():
        return None
    unit = ((flags & UNIT) > 0) & np.concatenate(([False], number[:-1]))
    kinds = np.where(number, NUMBER, np.where(unit, UNIT, WORD)).astype(np.uint8)
    before = np.concatenate(([0], np.cumsum(~sign)))
    told = (k == words["="]) & np.concatenate(([False], number[:-1])) & np.concatenate((number[1:], [False]))
    return Form(words.hashes[k], kinds, before[:-1], before[1:], k, (np.arange(len(k)), np.arange(1, len(k) + 1)), sign, told)


def _form(k: np.ndarray, kinds: np.ndarray, joins: np.ndarray, words: Words) -> Form:
    first = np.flatnonzero(~joins)
    ends = np.append(first[1:], len(k))
    raw = words.hashes[k]
    if len(first) == len(k):
        return Form(raw, kinds, first, ends, k)
    inside = np.arange(len(k)) - np.repeat(first, ends - first)
    return Form(np.bitwise_xor.reduceat(raw * (2 * inside.astype(np.uint64) + np.uint64(1)), first), kinds[first], first, ends, k)


def template(text: str | None, words: Words) -> tuple[list[Form], np.ndarray, np.ndarray]:
    """The forms of a text, the one without names first, and whether a word starts or ends a line. Bare punctuation is left out,
    but for the form with signs of calculation, which is last where there is one.

    There are two forms with names where they differ: with line breaks as starts of sentences, and as mere blanks.
    """
    raw, first = [], []
    _split(text, raw, first)
    return _read(raw, first, words)


def _split(text: str | None, raw: list[str], first: list[int]) -> None:
    for line in (text or "").splitlines():
        first.append(len(raw))
        raw += line.split()


def _read(raw: list[str], first: list[int], words: Words) -> tuple[list[Form], np.ndarray, np.ndarray]:
    if len(words) > REMEMBERED:
        words.clear()
    k = np.fromiter(map(words.__getitem__, raw), np.int64, len(raw))
    flags = words.flags[k]
    ends = (flags & ENDS) > 0
    opens = np.concatenate(([True], ends[:-1])) if len(k) else ends
    broken = opens.copy()
    broken[[i for i in first if i < len(k)]] = True
    line = np.searchsorted(np.array(first, np.int64), np.arange(len(k)), "right")
    signed = _signed(k, flags, words) if (flags & SIGN).any() else None
    here = np.flatnonzero((flags & BARE) == 0)
    k, flags, opens, broken, line = k[here], flags[here], opens[here], broken[here], line[here]
    starts = np.concatenate(([True], line[1:] != line[:-1])) if len(k) else opens
    stops = np.concatenate((starts[1:], [True])) if len(k) else opens
    number = (flags & NUMBER) > 0
    unit = ((flags & UNIT) > 0) & (np.concatenate(([False], number[:-1])) if len(k) else number)
    fixed = np.where(number, NUMBER, np.where(unit, UNIT, WORD)).astype(np.uint8)
    name = ((flags & NAME) > 0) & (fixed == WORD)
    # A word goes on with the token before it if nothing stands between them.
    touches = np.concatenate(([False], (here[1:] - here[:-1] == 1) & ((flags[:-1] & STOPS) == 0))) if len(k) else number
    spelt = (flags & SPELT) > 0
    if spelt.any():
        spelt &= touches & number & np.roll(number, 1)
    forms = [_form(k, fixed, spelt, words)]
    readings = [name & ~broken]
    if (name & broken & ~opens).any():
        readings.append(name & ~opens)
    for named in readings:
        if named.any():
            forms.append(_form(k, np.where(named, np.uint8(NAME), fixed), spelt | touches & named & np.roll(named, 1), words))
    return forms + ([signed] if signed else []), starts, stops


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` tokens."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(29))
    out = np.full(len(hashes) - n + 1, np.uint64(n))
    for k in range(n):
        out *= np.uint64(_FACTOR)
        out += mixed[k : k + len(out)]
    return out


def _placed(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    if not kinds.any():
        return raw
    out = raw.copy()
    for kind, value in _KIND.items():
        out[kinds == kind] = np.uint64(value)
    return out


def _full(kinds: np.ndarray, n: int) -> np.ndarray:
    if not kinds.any():
        return np.zeros(len(kinds) - n + 1, bool)
    slots = np.concatenate(([0], np.cumsum(kinds != WORD)))
    return slots[n:] - slots[:-n] > SLOTS * n


class Table(NamedTuple):
    """Two bits for each hash that is wanted, by its leading and its last bits; others may share them."""

    bits: np.ndarray
    shift: int

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self._set(h >> np.uint64(self.shift))
        here = np.flatnonzero(out)
        out[here] = self._set(h[here] & np.uint64((1 << (64 - self.shift)) - 1))
        return out

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1


_SCHEMA = "hash bigint, template string, size int, start int, stop int, slots array<string>, kinds array<int>, roles array<string>, tokens int"


class Found(NamedTuple):
    """Windows of ``n`` tokens that start at the tokens ``at`` of a form: all hashes, which windows are exact, and where a calculation goes on."""

    form: Form
    n: int
    at: np.ndarray
    h: np.ndarray
    exact: np.ndarray | None
    before: np.ndarray | None
    after: np.ndarray | None


def _found(forms: list[Form], starts: np.ndarray, stops: np.ndarray, lengths: list[int] | None, wanted: Table | None) -> Iterator[Found]:
    signed = forms[-1] if forms[-1].signs is not None else None
    # How many signs stand before each word and the words before it: windows with signs inside have their template in the last form.
    signs = np.cumsum(np.bincount(signed.first[signed.signs], minlength=len(forms[0].words) + 1)) if signed else None
    for f, form in enumerate(forms):
        m = len(form.kinds)
        for n in lengths if lengths is not None else [min(m, WINDOW)]:
            if not 0 < n <= m or f and n < LEAST:
                continue
            here = slice(0, m - n + 1)
            if n < LEAST:
                if lengths is None and m > n:
                    continue
                ok = starts[form.first[here]] & stops[form.ends[n - 1 :] - 1]
                exact = np.ones(m - n + 1, bool)
            else:
                exact = _full(form.kinds, n)
                if signed and form is not signed:
                    exact = exact | (signs[form.ends[n - 1 :] - 1] > signs[form.first[here]])
                ok = np.ones(len(exact), bool)
                if f:
                    named = np.concatenate(([0], np.cumsum(form.kinds == NAME if form.signs is None else form.signs)))
                    ok = (named[n:] > named[:-n]) & ~exact
                if form.told is not None and form.told.any():  # with its result it asks nothing: only the same numbers count
                    results = np.concatenate(([0], np.cumsum(form.told)))
                    ok = ok & (results[n:] == results[:-n])
            if not ok.any():
                continue
            h, before, after = rolling(_placed(form.hashes, form.kinds), n), None, None
            if form.signs is not None:  # a calculation that goes on is another one than one that ends
                side = form.signs | (form.kinds == NUMBER)
                goes_on = np.concatenate(([False], side[1:] & side[:-1], [False]))
                before, after = goes_on[: m - n + 1], goes_on[n:]
                h = h ^ np.where(before, _OPEN[0], np.uint64(0)) ^ np.where(after, _OPEN[1], np.uint64(0))
            if not f and exact.any():
                h = np.where(exact, rolling(form.hashes, n) ^ _EXACT, h)
            if wanted is not None:
                ok = ok & wanted.has(h)
            yield Found(form, n, np.flatnonzero(ok), h, None if f else exact, before, after)


#: Stands between texts that are read together: a word of its own that no text has, after which a text starts as it does alone.
_BREAK = "break of texts."


def holding(texts: list[str | None], words: Words, lengths: list[int], wanted: Table) -> list[int]:
    """The places of those of ``texts`` that have windows whose hash is ``wanted``, and perhaps of the few next to them."""
    raw, first = [], []
    for text in texts:
        _split(text, raw, first)
        first.append(len(raw))
        raw.append(_BREAK)
    forms, starts, stops = _read(raw, first, words)
    breaks = np.flatnonzero(forms[0].words == words[_BREAK])
    found = [np.searchsorted(breaks, x.form.first[x.at]) for x in _found(forms, starts, stops, lengths, wanted)]
    return np.unique(np.concatenate(found)).tolist() if found else []


def windows(text: str | None, words: Words, lengths: list[int] | None, wanted: Table | None) -> Iterator[tuple]:
    """The columns of _SCHEMA of windows of ``lengths`` tokens whose hash is ``wanted`` (items: None, all of them, a short item whole).

    Windows of the first form leave names alone, and are exact where numbers and units fill too much of them; the
    others have names or signs of calculation. Windows of fewer than LEAST tokens are exact and whole lines.
    """
    forms, starts, stops = template(text, words)
    for form, n, at, h, exact, before, after in _found(forms, starts, stops, lengths, wanted):
        m = len(form.kinds)
        for i in at.tolist():
            places = [j for j in range(i, i + n) if form.kinds[j]]
            as_is = exact is not None and bool(exact[i])
            parts = [form.text(words, j) if as_is or not form.kinds[j] else {NUMBER: "<number>", UNIT: "<unit>", NAME: "<name>"}[int(form.kinds[j])] for j in range(i, i + n)]
            roles = [form.text(words, j + 1) if j + 1 < m and form.kinds[j + 1] in (WORD, UNIT) else "" for j in places]
            if form.signs is not None:  # each number of a calculation is one of its own
                roles = [f"{r}@{form.first[j]}" for j, r in zip(places, roles)]
            if before is not None:
                parts = ["…"] * bool(before[i]) + parts + ["…"] * bool(after[i])
            yield int(h[i].view(np.int64)), " ".join(parts), n, int(form.first[i]), int(form.ends[i + n - 1]), [form.text(words, j) for j in places], [int(form.kinds[j]) for j in places], roles, len(forms[0].words)


#: Characters of texts that are read together.
TOGETHER = 1 << 16


def all_windows(texts: list[str | None], words: Words, lengths: list[int] | None, wanted: Table | None) -> Iterator[tuple[int, list[tuple]]]:
    """The windows of each text that has any, and its place. Most texts hold nothing: texts are looked through together first."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < TOGETHER):
            size += len(texts[end] or "")
            end += 1
        some = range(end - at) if lengths is None or wanted is None else holding(texts[at:end], words, lengths, wanted)
        for k in some:
            if found := list(windows(texts[at + k], words, lengths, wanted)):
                yield at + k, found
        at = end


def template_windows(rows: DataFrame, keys: list[str], lengths: list[int] | None, wanted: Table | None) -> DataFrame:
    """The windows of ``rows`` (``keys`` and ``text``); items where ``lengths`` is None."""
    packed = rows.select(F.struct(*keys).alias("key"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32())
        for batch in batches:
            where, out = [], []
            for i, found in all_windows(batch.column(1).to_pylist(), words, lengths, wanted):
                where += [i] * len(found)
                out += found
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 9, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *columns], ["key", *[c.split()[0] for c in _SCHEMA.split(", ")]])

    return packed.mapInArrow(work, f"key {packed.schema['key'].dataType.simpleString()}, {_SCHEMA}").select("key.*", *[c.split()[0] for c in _SCHEMA.split(", ")])


def table_of(hashes: DataFrame) -> Table:
    """The bits of all hashes, put together by Spark; at most 16 MB reach the driver, however many items there are."""
    least, most = TABLE
    size = min(max(least, (64 * hashes.count()).bit_length()), most)
    places = F.array(F.shiftrightunsigned("hash", 64 - size), F.col("hash").bitwiseAND((1 << size) - 1))
    words = hashes.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    found, bits = words.toArrow(), np.zeros(1 << (size - 6), np.uint64)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Table(bits, 64 - size)


#: How many words apart windows of one alignment may lie, where names of more or fewer words stand between them.
DRIFT = 3


def _judged(aligned: list[dict]) -> tuple[int, bool]:
    there: dict[tuple, set[str]] = {}
    back: dict[tuple, set[str]] = {}
    for kind, role, a, b in ((k, r, a, b) for m in aligned for k, r, a, b in zip(m["kinds"], m["roles"], m["item_slots"], m["slots"])):
        there.setdefault((a, role if kind == NUMBER else kind), set()).add(b)
        if kind != NUMBER:
            back.setdefault((b, kind), set()).add(a)
    consistent = all(len(x) == 1 for x in (*there.values(), *back.values()))
    # Where one value stands for two, it is not the item asked again: only what is the same still counts.
    taken = [m for m in aligned if consistent or m["item_slots"] == m["slots"]]
    covered = {k for m in taken for k in range(m["item_start"], m["item_stop"])}
    return len(covered), any(m["item_slots"] != m["slots"] for m in taken)


def judge(matches: list[dict]) -> tuple[int, bool]:
    """(words of the item covered by the best consistent alignment, whether values differ there)."""
    lines: dict[int, list[dict]] = {}
    for m in matches:
        lines.setdefault(m["start"] - m["item_start"], []).append(m)
    best, group, last = max(map(_judged, lines.values()), default=(0, False)), [], None
    for shift in sorted(lines):
        if last is not None and shift - last > DRIFT:
            best, group = max(best, _judged(group)), []
        group += lines[shift]
        last = shift
    return max(best, _judged(group)) if len(lines) > 1 else best


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc, row, item, covered, tokens, changed``: documents that hold an item's template, with it.

    ``row`` is a hash of the document's text and tells apart rows that share an id; equal rows give one
    result. ``covered`` of the item's ``tokens`` (words) lie in windows with consistent values; ``changed`` says that
    some value differs from the item's. Null and empty texts and items hold nothing; items of fewer than 5 words are
    held by documents in which they are whole lines, word by word. Equal items each give a result. Other columns
    are not read.
    """
    item_rows = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text"))
    known = template_windows(item_rows, ["item"], None, None)
    known = known.select("item", "hash", "template", "size", "kinds", "roles", F.col("start").alias("item_start"), F.col("stop").alias("item_stop"), F.col("slots").alias("item_slots"), F.col("tokens").alias("item_tokens"))
    wanted = table_of(known.select("hash").distinct())
    short = [r["size"] for r in known.where(F.col("size") < WINDOW).select("size").distinct().orderBy("size").collect()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    found = template_windows(doc_rows, ["doc", "row"], [*short, WINDOW], wanted).select("doc", "row", "hash", "template", "start", "slots")
    joined = found.join(known, ["hash", "template"])
    match = F.struct("start", "slots", "item_start", "item_stop", "item_slots", "kinds", "roles")
    pairs = joined.groupBy("doc", "row", "item").agg(F.collect_set(match).alias("matches"), F.first("item_tokens").alias("tokens"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_ = [judge(m) for m in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found_], pa.int32()), batch.column(4), pa.array([f[1] for f in found_], pa.bool_())], ["doc", "row", "item", "covered", "tokens", "changed"])

    judged = pairs.mapInArrow(work, "doc bigint, row bigint, item bigint, covered int, tokens int, changed boolean")
    return judged.where(F.col("covered") >= F.least(F.lit(COVERED), "tokens"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    bad = contaminated(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("doc").alias("__doc"), F.col("row").alias("__bad")).distinct()
    left = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return left.join(bad, left[id_col].eqNullSafe(bad["__doc"]) & (left["__row"] == bad["__bad"]), "left_anti").select(*docs.columns)


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_covered, n_tokens, reparameterised of each document and item it holds."""
    found = contaminated(docs, items)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("covered").alias("n_covered"), F.col("tokens").alias("n_tokens"), F.col("changed").alias("reparameterised"))
