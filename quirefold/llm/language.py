"""Assign every document, and every stretch of a mixed one, a language by compression.

For each language of the labelled samples a zstandard raw-content dictionary is made of its sample text.
A piece of text is compressed with every dictionary; the language whose dictionary gives the fewest bytes
wins.  ``confidence`` is the share by which the best is smaller than the runner-up, measured on the bytes
beyond the frame's fixed cost; where it is under ``MARGIN`` the piece is rejected.

A document is split into sentences.  Groups of ``GROUP`` neighbours are tried as a whole first: a group that one
dictionary wins by more than ``CLEAR`` holds no foreign sentence and takes that language; else each sentence is
classified by itself.  Rejected sentences take the language around them if both
sides agree.  Runs of sentences of one language form segments; a lone sentence between two segments of
another language is a quotation and joins them.

All row-local in Arrow batches; whole texts, no shuffle, linear in the text.

Defined results: null or empty text, or text without letters, gives no segment and a null document language
with confidence 0; repeated documents are each classified; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.textkit import BANNER, BROKEN

LEVEL = 1
MARGIN = 0.06
#: a group of sentences in one language is won by about 0.65, with a single foreign one among four by 0.4
GROUP, CLEAR = 4, 0.5
FRAME_BYTES = 8
#: sentences with fewer letters are too short to tell
MIN_LETTERS, MIN_CJK = 12, 5
#: raw content kept per language: the most that one dictionary window uses at this level
MAX_DICTIONARY = 110_000
SEGMENT_SCHEMA = "doc_id bigint, segment int, first_sentence int, sentences int, lang_code string, confidence double"

_SENTENCE = re.compile(r"[^.!?。！？…\n]+(?:[.!?。！？…]+[)\]”’»」』）]*|\n|$)")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿]")

#: fixed values: usual notations of the languages of the corpus (ISO 639-1, 639-2, names)
LABELS = {
    "en": ("en", "eng", "english"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "中文"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
    "ja": ("ja", "jpn", "japanese", "日本語"),
}


def label_code(label: Column) -> Column:
    """Two-letter code of a label in any usual notation; null if it is missing, unknown or another language."""
    plain = F.lower(F.trim(F.split(F.trim(label), "[-_]").getItem(0)))
    out = F.lit(None).cast("string")
    for code, names in LABELS.items():
        out = F.when(plain.isin(*names), F.lit(code)).otherwise(out)
    return out


class Classifier:
    def __init__(self, samples: list[tuple[str, str]]):
        texts: dict[str, list[str]] = {}
        for lang, text in samples:
            if lang and text:
                texts.setdefault(lang, []).append(text)
        self.coders = []
        for lang, parts in sorted(texts.items()):
            raw = "\n".join(parts).encode()[-MAX_DICTIONARY:]
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            coder = zstandard.ZstdCompressor(dict_data=content, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.coders.append((lang, coder.compress))

    def best(self, text: str) -> tuple[str | None, float]:
        data = text.encode()
        sizes = sorted((len(compress(data)) - FRAME_BYTES, lang) for lang, compress in self.coders)
        if len(sizes) < 2:
            return (sizes[0][1], 1.0) if sizes else (None, 0.0)
        return sizes[0][1], 1 - max(1, sizes[0][0]) / max(1, sizes[1][0])

    def sentences(self, text: str) -> list[tuple[str | None, float, int]]:
        """(language, confidence, letters) of each sentence that is long enough to tell."""
        text = BROKEN.sub("", BANNER.sub("\n", text))
        pieces, out = [], []
        for piece in _SENTENCE.findall(text):
            letters = sum(map(str.isalpha, piece))
            if letters >= MIN_LETTERS or letters >= MIN_CJK and _DENSE.search(piece):
                pieces.append((piece, letters))
        for start in range(0, len(pieces), GROUP):
            group = pieces[start : start + GROUP]
            if len(group) > 1:
                lang, margin = self.best("".join(p for p, _ in group))
                if margin > CLEAR:
                    out += [(lang, margin, n) for _, n in group]
                    continue
            for piece, n in group:
                lang, margin = self.best(piece)
                out.append((lang if margin >= MARGIN else None, margin, n))
        return out

    def segments(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first sentence, sentences, language, confidence) of each stretch."""
        sentences = self.sentences(text)
        langs = [s[0] for s in sentences]
        known = [i for i, x in enumerate(langs) if x]
        if not known:
            return []
        following: list[str | None] = [None] * len(langs)
        for i in range(len(langs) - 2, -1, -1):
            following[i] = sentences[i + 1][0] or following[i + 1]
        before = None
        for i, lang in enumerate(langs):
            after = following[i]
            if lang is None and (before == after or not before or not after):
                langs[i] = before or after
            before = langs[i] or before
        for i in range(1, len(langs) - 1):
            if langs[i] != langs[i - 1] and langs[i - 1] == langs[i + 1]:
                langs[i] = langs[i - 1]
        out: list[list] = []
        for i, lang in enumerate(langs):
            if not lang:
                continue
            if out and out[-1][2] == lang and out[-1][0] + out[-1][1] == i:
                out[-1][1] += 1
                out[-1][3].append((sentences[i][1], sentences[i][2]))
            else:
                out.append([i, 1, lang, [(sentences[i][1], sentences[i][2])]])
        return [(a, n, lang, sum(c * w for c, w in ws) / sum(w for _, w in ws)) for a, n, lang, ws in out]


def segments(df: DataFrame, key: Column, text: Column, samples: list[tuple[str, str]]) -> DataFrame:
    """One row per stretch of one language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(samples)
        for batch in batches:
            rows = [
                (doc_id, i, *s)
                for doc_id, content in zip(batch["doc_id"], batch["text"])
                for i, s in enumerate(classifier.segments(content))
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENT_SCHEMA.split(", ")])

    docs = df.select(key.cast("bigint").alias("doc_id"), text.alias("text"))
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(run, SEGMENT_SCHEMA)


DOCUMENT_SCHEMA = "doc_id bigint, label string, lang_code string, confidence double, languages array<string>, segments int"


def documents(df: DataFrame, key: Column, text: Column, label: Column, samples: list[tuple[str, str]]) -> DataFrame:
    """One row per document: main language with confidence, and all languages held for two sentences in a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(samples)
        for batch in batches:
            rows = []
            for doc_id, content, given in zip(batch["doc_id"], batch["text"], batch["label"]):
                found = classifier.segments(content or "")
                size: dict[str, int] = {}
                sure: dict[str, float] = {}
                for _, n, lang, confidence in found:
                    size[lang] = size.get(lang, 0) + n
                    sure[lang] = sure.get(lang, 0.0) + n * confidence
                main = max(size, key=lambda x: (size[x], x), default=None)
                held = sorted({lang for _, n, lang, _ in found if n >= 2})
                rows.append((doc_id, given, main, sure[main] / size[main] if main else 0.0, held, len(found)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOCUMENT_SCHEMA.split(", ")])

    docs = df.select(key.cast("bigint").alias("doc_id"), text.alias("text"), label_code(label).alias("label"))
    return docs.mapInPandas(run, DOCUMENT_SCHEMA)


def relabelled(classified: DataFrame) -> DataFrame:
    """Languages of the documents whose label is missing or wrong or whose text is mixed."""
    mixed = F.size("languages") > 1
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang_code"))
    return classified.where(mixed | wrong).select("doc_id", F.explode("languages").alias("lang_code"))
