"""One form for texts that look the same in print.

Texts are exploded to positioned clusters (a code point with its combining marks and invisible characters); the
distinct clusters are exploded to code points and joined with two tables made from the Unicode data:

* ``folds``: each code point to its compatibility decomposition, look-alike letters to one of them, spaces to
  U+0020, invisible format characters to nothing, each with its combining class;
* ``compositions``: a base with ordered marks to the composed character.

Marks are put in the order of their class, clusters are recomposed, and the text is rebuilt by position.  Words with a
letter that only Cyrillic has get their look-alikes back in Cyrillic, which is a function of the folded word and so
keeps one form.  Case, accents, digits, words and visible punctuation stay; full-width punctuation of CJK text is its
usual form and stays too.

Only texts that hold a character the tables change are exploded; all others are their own form.  Of
those, the pieces (words, or phrases of scripts without spaces) that hold such a character are made distinct before they
are exploded to clusters, and the clusters before they are exploded to code points, so every form is worked out once.
Tables are bounded by Unicode (under 30,000 rows); the maps of distinct pieces are broadcast after a check of their
size, else joined by a shuffle.

Twins are found by the 128-bit hash of the form: only hashes and keys are shuffled, and only groups that hold two different
texts are joined.  The pairs asked for are all pairs of rows with different characters and equal form.

Defined results: null stays null and empty stays empty; ill-formed or unassigned code points stay; repeated rows
of one text are no pair with each other; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.runtime import broadcast_if_small, cut

#: fixed values: letters of Cyrillic and Greek that print like the Latin letter below them
CYRILLIC = "аеорсхуіѕјһԁԛԝАВЕКМНОРСТХІЅЈУԌԚԜ"
CYRILLIC_LATIN = "aeopcxyisjhdqwABEKMHOPCTXISJYGQW"
GREEK = "οιυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_LATIN = "oiuvABEZHIKMNOPTYX"
#: full-width punctuation that is the normal form in Chinese and Japanese text
KEPT = "！（），：；？｡､"
LIKE = dict(zip(CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN))
LEAST_CHARS = 40
_CLUSTER = r"(?s).[\p{M}\p{Cf}ᅠ-ᇿ]*"
#: texts fall into pieces after these marks; a mark of this kind with a combining character stays one piece
_AFTER = r"(?<=[ ，。；、])(?![\p{M}\p{Cf}])"


def _fold(c: str) -> list[tuple[int, str]]:
    """(combining class, code point) after decomposition and look-alikes."""
    if unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return []
    if c in KEPT or 0xAC00 <= ord(c) < 0xD7A4:
        return [(0, c)]
    if unicodedata.category(c) == "Zs":
        return [(0, " ")]
    return [(unicodedata.combining(x), LIKE.get(x, x)) for x in unicodedata.normalize("NFKD", c)]


@functools.cache
def _tables() -> tuple[list, list, str]:
    """Fold rows, composition rows, and the characters that may change."""
    folds, compositions, touched = [], [], []
    for o in itertools.chain(range(0x80, 0x323B0), range(0xE0000, 0xE01F0)):
        c = chr(o)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        out = _fold(c)
        if out != [(0, c)]:
            folds.append((c, out))
        if category[0] == "M" or 0x1160 <= o < 0x1200 or unicodedata.normalize("NFC", "".join(x for _, x in out)) != c:
            touched.append(c)
        parts = unicodedata.normalize("NFD", c)
        if parts != c and unicodedata.normalize("NFC", parts) == c:
            compositions.append((parts, c))
    return folds, compositions, "".join(touched)


def changes(text: Column) -> Column:
    """Whether a text holds a character that may change."""
    return F.translate(text, _tables()[2], "") != text


def _maps(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    folds, compositions, _ = _tables()
    return (
        F.broadcast(spark.createDataFrame(folds, "ch string, outs array<struct<ccc:int,o:string>>")),
        F.broadcast(spark.createDataFrame(compositions, "parts string, whole string")),
    )


def _cluster_map(pieces: DataFrame) -> DataFrame:
    """Form of every distinct cluster: decompose, order the marks, recompose."""
    folds, compositions = _maps(pieces.sparkSession)
    points = pieces.select("cluster", F.posexplode(F.split("cluster", "")).alias("at", "ch")).where("ch <> ''")
    folded = points.join(folds, "ch", "left").withColumn("outs", F.coalesce("outs", F.array(F.struct(F.lit(0).alias("ccc"), F.col("ch").alias("o")))))
    parts = folded.select("cluster", "at", F.posexplode("outs").alias("inner", "x"))
    ordered = parts.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("x.ccc", "at", "inner", "x.o"))).alias("xs"))
    # a decomposition of several bases (ligatures) keeps its order; only a single base with marks is reordered
    bases = F.size(F.filter("xs", lambda x: x["ccc"] == 0))
    by_place = F.array_sort(F.transform("xs", lambda x: F.struct(x["at"].alias("at"), x["inner"].alias("inner"), x["o"].alias("o"))))
    joined = F.when(bases > 1, F.array_join(F.transform(by_place, lambda x: x["o"]), "")).otherwise(F.array_join(F.transform("xs", lambda x: x["o"]), ""))
    decomposed = ordered.select("cluster", joined.alias("parts"))
    # the longest beginning that composes
    lengths = F.sequence(F.lit(1), F.char_length("parts"))
    begun = decomposed.select("cluster", "parts", F.explode(lengths).alias("n")).withColumn("begin", F.left("parts", "n")).join(compositions.withColumnRenamed("parts", "begin"), "begin", "left")
    known = begun.groupBy("cluster", "parts").agg(F.max(F.when(F.col("whole").isNotNull(), F.struct("n", "whole"))).alias("x"))
    known = known.select("cluster", F.when(F.col("x").isNull(), F.col("parts")).otherwise(F.concat("x.whole", F.substring("parts", F.col("x.n") + 1, F.char_length("parts")))).alias("form"))
    every = pieces.join(known, "cluster", "left")
    return every.select("cluster", F.coalesce("form", F.lit("")).alias("form"))


def _rebuilt(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    joined = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "form"))).alias("xs"))
    return joined.select(*keys, F.array_join(F.transform("xs", lambda x: x["form"]), "").alias(out))


def fold_texts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` (unique) and ``folded`` for texts that may change."""
    pieces = df.select(*keys, F.posexplode(F.split(text, _AFTER)).alias("at", "piece"))
    pieces = pieces.withColumn("odd", F.when(changes(F.col("piece")), F.col("piece")))
    odd = cut(pieces.where("odd is not null").select("odd").distinct())
    clusters = odd.select("odd", F.posexplode(F.regexp_extract_all("odd", F.lit(_CLUSTER), 0)).alias("at", "cluster"))
    forms = broadcast_if_small(cut(_cluster_map(cut(clusters.select("cluster").distinct()))))
    mapping = broadcast_if_small(cut(_rebuilt(clusters.join(forms, "cluster"), ["odd"], "form")))
    return _rebuilt(pieces.join(mapping, "odd", "left").select(*keys, "at", F.coalesce("form", "piece").alias("form")), keys, "folded")


def _stressed(word: Column) -> Column:
    """Letters composed with a stress mark apart again; Cyrillic has no composed form for them."""
    for base in "aeopyiAEOYI":
        for mark in "\u0301\u0300":
            whole = unicodedata.normalize("NFC", base + mark)
            word = F.replace(word, F.lit(whole), F.lit(base + mark)) if len(whole) == 1 else word
    return word


def script_of_words(folded: Column) -> Column:
    """Look-alikes back in Cyrillic, where a word has a letter that only Cyrillic has.

    Words of look-alikes alone follow the script that most telling words of the text have.
    """
    words = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), 0)
    own, other = rf"[\p{{IsCyrillic}}&&[^{CYRILLIC}]]", rf"[A-Za-z&&[^{CYRILLIC_LATIN}]]"
    latin, cyrillic = CYRILLIC_LATIN + "ëËïÏ", CYRILLIC + "ёЁїЇ"
    mostly = F.size(F.filter(words, lambda w: w.rlike(own))) > F.size(F.filter(words, lambda w: w.rlike(other)))
    back = F.transform(words, lambda w: F.when(w.rlike(own) | (mostly & ~w.rlike(other)), F.translate(_stressed(w), latin, cyrillic)).otherwise(w))
    return F.when(folded.rlike(own), F.array_join(back, "")).otherwise(folded)


def canonical(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``form`` of every text."""
    rows = df.select(*keys, text)
    changed = fold_texts(rows.where(changes(F.col(text))), keys, text).select(*keys, script_of_words(F.col("folded")).alias("form"))
    same = rows.where(~F.coalesce(changes(F.col(text)), F.lit(False))).select(*keys, F.col(text).alias("form"))
    return same.unionByName(changed)


def _hashes(df: DataFrame, table: str, row_id: str, text: str) -> DataFrame:
    """(table, row_id, own, form): hashes of every text of at least ``LEAST_CHARS`` characters and of its form."""
    keys = [table, row_id, "own"]
    rows = df.where(F.char_length(text) >= LEAST_CHARS).select(table, row_id, F.md5(text).alias("own"), F.when(changes(F.col(text)), F.col(text)).alias(text))
    rows = cut(rows)
    folded = fold_texts(rows.where(F.col(text).isNotNull()), keys, text).select(*keys, F.md5("folded").alias("form"))
    same = rows.where(F.col(text).isNull()).select(*keys, F.col("own").alias("form"))
    return cut(same.unionByName(folded))


def twin_classes(df: DataFrame, table: str, row_id: str, text: str) -> DataFrame:
    """(table, row_id, class_id, texts, rows, links): one row per text that has twins, with the numbers of its class.

    ``links`` are the rows of the class with other characters; classes are counted before rows are joined with them, so a class of a third of
    all rows is one row on one side.
    """
    hashes = _hashes(df, table, row_id, text)
    per_text = hashes.groupBy(table, "form", "own").agg(F.count("*").alias("copies"))
    per_form = per_text.groupBy(table, "form").agg(F.count("*").alias("texts"), F.sum("copies").alias("rows")).where("texts > 1")
    known = broadcast_if_small(cut(per_text.join(per_form, [table, "form"])))
    return hashes.join(known, [table, "form", "own"]).select(table, row_id, F.col("form").alias("class_id"), "texts", "rows", (F.col("rows") - F.col("copies")).alias("links"))


def twins(df: DataFrame, table: str, row_id: str, text: str) -> DataFrame:
    """(table, row_id_a, row_id_b): rows of one table that look the same and differ in their characters."""
    hashes = _hashes(df, table, row_id, text)
    mixed = hashes.groupBy(table, "form").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select(table, "form")
    members = hashes.join(mixed, [table, "form"], "left_semi")
    a = members.select(table, "form", F.col(row_id).alias("row_id_a"), F.col("own").alias("own_a"))
    b = members.select(table, "form", F.col(row_id).alias("row_id_b"), F.col("own").alias("own_b"))
    return a.join(b, [table, "form"]).where((F.col("own_a") != F.col("own_b")) & (F.col("row_id_a") < F.col("row_id_b"))).select(table, "row_id_a", "row_id_b")
