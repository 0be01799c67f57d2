"""Share of repeated content within one document.

``measure`` reports two things per document:

* ``jsd_class`` and ``jsd_word``: Jensen-Shannon distances (base 2, 0..1) of the character-class and
  common-word histograms to the nearest language reference, with a guard on the length;
* ``repeated_letters`` / ``share``: letters that lie in passages which occurred before.

A histogram of relative frequencies is the same for a text and for that text written out twice, so the
divergence cannot tell the share of repetition (README, problem 1); the share comes from an exact search for
earlier occurrences: fixed windows of letters are hashed with a rolling polynomial, equal hashes are compared
letter by letter, and runs of a short period are found by comparing the text with itself shifted.

Everything is row-local: one pass of Arrow batches, no shuffle, linear in the text (times a constant number of
periods), so neither hot sources nor long texts matter.

Defined results: null, empty or letterless text has share 0 and null distances; texts under
``MIN_LETTERS`` letters get null distances; rows with equal keys are measured each on its own; other columns of
the input are not read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.textkit import BANNER, GROUNDING, tokens
from quirefold.runtime import cut

#: a passage: so many letters of any script, or so many of scripts without spaces
PASSAGE_LETTERS, PASSAGE_CJK = 30, 12
#: a run: at least two copies side by side, and in all so many letters
RUN_LETTERS, RUN_CJK = 12, 6
MIN_LETTERS = 80
COMMON_WORDS = 60
SCHEMA = "row_id bigint, letters bigint, repeated_letters bigint, share double, reference string, jsd_class double, jsd_word double"

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _letters(text: str) -> np.ndarray:
    text = GROUNDING.sub(" ", BANNER.sub(" ", text))
    return np.array([ord(c) for c in text.casefold() if c.isalpha()], dtype=np.uint32)


def _scramble(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.full(size, x, dtype=np.uint64)) for x in (_BASE, _INVERSE))


class Windows:
    """Rolling polynomial hashes of the windows of a row of letters."""

    def __init__(self, a: np.ndarray):
        self.letters = a
        # tables by the next power of two, so that they are made a few times only
        self.powers, self.inverses = _powers(1 << max(10, len(a).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_scramble(a) * self.powers[: len(a)], dtype=np.uint64)])

    def hashes(self, k: int) -> np.ndarray:
        n = len(self.letters) - k + 1
        if n < 2:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.sums[k:] - self.sums[:-k]) * self.inverses[:n]


def _repeats(windows: Windows, k: int) -> np.ndarray:
    """Starts of the windows of ``k`` letters that occurred at an earlier start."""
    hashes, a = windows.hashes(k), windows.letters
    order = np.argsort(hashes, kind="stable")
    fresh = np.ones(len(hashes), dtype=bool)
    ordered = hashes[order]
    fresh[1:] = ordered[1:] != ordered[:-1]
    if fresh.all():
        return np.zeros(0, dtype=np.int64)
    earlier = np.empty(len(hashes), dtype=np.int64)
    earlier[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    late = np.flatnonzero(earlier < np.arange(len(hashes)))
    same = np.ones(len(late), dtype=bool)
    for step in range(k):
        same &= a[late + step] == a[earlier[late] + step]
    return late[same]


def _periods(windows: Windows, k: int) -> set[int]:
    """Short distances at which windows of ``k`` letters return; any run has its shortest period among them."""
    hashes = windows.hashes(k)
    order = np.argsort(hashes, kind="stable")
    gaps = np.diff(order)[hashes[order][1:] == hashes[order][:-1]]
    return set(np.unique(gaps[gaps <= PASSAGE_LETTERS]).tolist())


def repeated_mask(a: np.ndarray) -> np.ndarray:
    """Which letters lie in a passage that occurred before."""
    n = len(a)
    edges = np.zeros(n + 1, dtype=np.int64)

    def cover(starts: np.ndarray, ends: np.ndarray) -> None:
        np.add.at(edges, starts, 1)
        np.add.at(edges, ends, -1)

    windows = Windows(a)
    starts = _repeats(windows, PASSAGE_LETTERS)
    cover(starts, starts + PASSAGE_LETTERS)
    dense = a >= 0x2E80
    if dense.any():
        starts = _repeats(windows, PASSAGE_CJK)
        inside = np.concatenate([[0], np.cumsum(dense)])
        starts = starts[inside[starts + PASSAGE_CJK] - inside[starts] == PASSAGE_CJK]
        cover(starts, starts + PASSAGE_CJK)
    for period in sorted(_periods(windows, 8) | (_periods(windows, 4) if dense.any() else set())):
        equal = np.concatenate([[False], a[period:] == a[:-period], [False]])
        turns = np.flatnonzero(equal[1:] != equal[:-1])
        begin, end = turns[::2] + period, turns[1::2] + period
        least = np.where(dense[np.minimum(begin, n - 1)], RUN_CJK, RUN_LETTERS)
        long = end - begin >= np.maximum(2 * period, least - period)
        cover(begin[long], end[long])
    return np.cumsum(edges[:-1]) > 0


@functools.cache
def _class_of(c: str) -> int:
    o = ord(c)
    if c.isdigit():
        return 0
    if c.isspace():
        return 1
    if not c.isalpha():
        return 2 if o < 128 else 3
    if o < 0x250:
        return 4 + (o > 127) * 2 + c.isupper()
    if 0x370 <= o < 0x530:
        return 8 + c.isupper()
    if 0x3040 <= o < 0x3100:
        return 10
    return 11 if o >= 0x2E80 else 12


def _histogram(counts: dict[int, int], size: int) -> np.ndarray:
    h = np.zeros(size)
    for k, v in counts.items():
        h[k] += v
    return h / max(1, h.sum())


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances (base 2) of the rows of two arrays of histograms."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.nansum(np.where(x > 0, x * np.log2(x / m), 0), axis=-1) for x in (p, q)]
    return np.sqrt(np.maximum(0.0, (kl[0] + kl[1]) / 2))


def _counted(samples: Iterable[tuple[str, str]]) -> dict[str, tuple[Counter, Counter]]:
    """Character classes and words of the samples of each language."""
    out: dict[str, tuple[Counter, Counter]] = {}
    for lang, text in samples:
        if lang and text:
            kinds, words = out.setdefault(lang, (Counter(), Counter()))
            for c, n in Counter("\n" + text).items():
                kinds[_class_of(c)] += n
            words.update(tokens(text))
    return out


class References:
    """Character-class and common-word histograms of each language, fitted on labelled samples."""

    def __init__(self, samples: list[tuple[str, str]]):
        counted = _counted(samples)
        self._fit({lang: (kinds, sum(words.values()), sorted(words.items(), key=lambda x: (-x[1], x[0]))[:COMMON_WORDS]) for lang, (kinds, words) in counted.items()})

    @classmethod
    def of_counts(cls, counts: dict[str, tuple[dict[int, int], int, list[tuple[str, int]]]]) -> References:
        """From the counts of character classes, of all words and of the common words of each language."""
        out = cls([])
        out._fit(counts)
        return out

    def _fit(self, counts: dict[str, tuple[dict[int, int], int, list[tuple[str, int]]]]) -> None:
        self.languages = sorted(counts)
        self.places: dict[str, list[tuple[int, int]]] = {}
        self.classes = np.array([_histogram(counts[lang][0], 13) for lang in self.languages])
        self.words = np.zeros((len(self.languages), COMMON_WORDS + 1))
        for row, lang in enumerate(self.languages):
            _, total, common = counts[lang]
            total = max(1, total)
            for i, (w, n) in enumerate(common):
                self.places.setdefault(w, []).append((row, i))
                self.words[row, i] = n
            self.words[row, COMMON_WORDS] = total - self.words[row].sum()
            self.words[row] /= total

    @staticmethod
    def _classes(text: str) -> np.ndarray:
        kinds: Counter = Counter()
        for c, n in Counter(text).items():
            kinds[_class_of(c)] += n
        return _histogram(kinds, 13)

    def _words(self, words: Counter) -> np.ndarray:
        """The histogram of the words by the common words of each language, the last place for all others."""
        out = np.zeros((len(self.languages), COMMON_WORDS + 1))
        for w in words.keys() & self.places.keys():
            for row, i in self.places[w]:
                out[row, i] += words[w]
        total = max(1, sum(words.values()))
        out[:, COMMON_WORDS] = total - out.sum(axis=1)
        return out / total

    def nearest(self, texts: list[str]) -> list[tuple[str | None, float | None, float | None]]:
        """(language, class distance, word distance) of each text."""
        if not self.languages or not texts:
            return [(None, None, None)] * len(texts)
        by_class = jensen_shannon(np.array([self._classes(t) for t in texts])[:, None, :], self.classes[None])
        by_word = jensen_shannon(np.array([self._words(Counter(tokens(t))) for t in texts]), self.words[None])
        best = np.argmin(by_class + by_word, axis=1)
        return [(self.languages[j], float(by_class[i, j]), float(by_word[i, j])) for i, j in enumerate(best.tolist())]


def references(samples: DataFrame) -> References:
    """References counted over all rows of ``samples`` (lang, text); the driver gets the common words of each language only."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, (kinds, words) in _counted(zip(batch["lang"], batch["text"])).items():
                rows += [(lang, kind, None, n) for kind, n in kinds.items()]
                rows += [(lang, None, word, n) for word, n in words.items()]
            yield pd.DataFrame(rows, columns=["lang", "kind", "word", "n"]).astype({"kind": "Int32"})

    counted = cut(samples.select("lang", "text").mapInPandas(count, "lang string, kind int, word string, n bigint").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")))
    words = counted.where("word IS NOT NULL")
    common = words.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= COMMON_WORDS)
    out: dict[str, tuple[dict[int, int], int, list[tuple[str, int]]]] = {}
    totals = {r[0]: r[1] for r in words.groupBy("lang").agg(F.sum("n")).collect()}
    for lang, kind, n in counted.where("kind IS NOT NULL").select("lang", "kind", "n").collect():
        out.setdefault(lang, ({}, totals.get(lang, 0), []))[0][kind] = n
    for lang, word, n in common.orderBy("lang", "place").select("lang", "word", "n").collect():
        out[lang][2].append((word, n))
    return References.of_counts(out)


#: texts whose histograms are compared at once
TOGETHER = 256


def measure(df: DataFrame, key: Column, text: Column, samples: list[tuple[str, str]] | References | None = None) -> DataFrame:
    """One row per input row.  ``samples``: language references or a few labelled texts to fit them on; without them distances are null."""
    references = samples if isinstance(samples, References) else References(samples or [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, waiting = [], []

            def compare() -> None:
                for at, found in zip(waiting, references.nearest([contents[i] for i in waiting])):
                    rows[at] += found
                waiting.clear()

            contents = batch["content"].tolist()
            for i, (row_id, content) in enumerate(zip(batch["row_id"], contents)):
                a = _letters(content or "")
                repeated = int(repeated_mask(a).sum()) if len(a) else 0
                rows.append((row_id, len(a), repeated, repeated / len(a) if len(a) else 0.0))
                if len(a) >= MIN_LETTERS and references.languages:
                    waiting.append(i)
                else:
                    rows[i] += (None, None, None)
                if len(waiting) == TOGETHER:
                    compare()
            compare()
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return df.select(key.cast("bigint").alias("row_id"), text.alias("content")).mapInPandas(run, SCHEMA)
