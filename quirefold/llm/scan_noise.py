"""Find and repair the noise of scanned pages: broken words, misread characters, blots, running heads, page numbers.

1. ``word_counts``: in how many texts each word stands (counted per task first, then merged).  Look-alike and full-width
   characters are folded, words broken at line ends are joined, code, tags, formulas and table rows are left out.
2. The vocabulary is the words in at least ``LEAST_TEXTS`` texts and a hundred-thousandth of all texts, so its size
   is bounded by 100,000 times the distinct words of a text, whatever the corpus.  It is kept as a trie.
3. Every word but codes is looked up once, in whatever case, whatever the number of its occurrences: a Levenshtein automaton of the
   word, with up to ``EDITS`` edits that scanners make (look-alikes, one letter read as two, two as one), is intersected with the
   trie, which finds *all* entries within reach.  Candidates far more frequent than the word itself stay; for words under
   ``SHORTEST`` letters, which have common words all around them, and capitalised ones two edits away, which may be names, those
   far more frequent after the same word.
4. A candidate is chosen by edits, then by the words around it (counts of neighbour pairs), then by frequency.
5. Lines that repeat the job's title, with or without a number, lines of any title with a number set off from it, and lines
   of a page number, all below or within the body, are furniture; they are removed, broken words joined, and lines flow into paragraphs again.

Steps 1 and 3 are Arrow-batched; what is shuffled are distinct words per task.  Jobs meet their titles in a join on the job
with one title a job; texts are not grouped, so a long job or a hot source loads no task.

Defined results: null text has no noise and its repair is null; empty text stays empty; a missing title or job only
leaves running heads of that job without a page number undetected; texts of furniture alone are no noise; repeated rows count each; other
columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.runtime import broadcast_if_small, cut

LEAST_TEXTS, LEAST_RATE = 6, 1e-5
#: an entry must be so many times as frequent as the word that it replaces
RATIO = 12
EDITS = 2
SHORTEST = 4
#: a map of corrections this size is sent to every task, a larger one is joined by shuffle
MOST_CORRECTIONS = 400_000

#: fixed values: letters that scanners take for one another
ALIKE = (
    "ec", "co", "tf", "hb", "il", "i1", "l1", "o0", "s5", "g9", "gq", "z2", "b6", "B8", "O0", "I1", "Il", "S5", "G6", "Z2", "nu", "vy", "rt",
    "ни", "ип", "пл", "пн", "ес", "з3", "б6", "в8", "о0", "шщ", "гт", "цд", "ьъ",
)
#: fixed values: one letter read as two, or two as one
PAIRS = (("u", "ii"), ("m", "rn"), ("w", "vv"), ("d", "cl"), ("h", "li"), ("n", "ri"), ("m", "nn"), ("ы", "ьi"), ("ы", "ьі"), ("ю", "10"), ("ш", "iii"))
BLOT = re.compile(r"[^\W\d_][□■◇◆〓※¦▪▯█]|[□■◇◆〓※¦▪▯█][^\W\d_]")
_BLOT_MARK = re.compile(r"[□■◇◆〓※¦▪▯█]")
HYPHEN = re.compile(r"[-‐¬\xad](?<=[^\W\d_].)[ \t]*\r?\n\s*(?=[^\W\d_])")
#: a hyphen-like mark that ends a line after a letter, whatever furniture comes before the rest of the word
HYPHEN_END = re.compile(r"[a-zß-öø-ÿœа-яё][-‐¬\xad][ \t]*\r?\n")
PAGE_NUMBER = re.compile(
    r"^[ \t]*(?:[-–—~·•]+ ?\d{1,4} ?[-–—~·•]+|\(\d{1,4}\)|\[\d{1,4}\]|(?:(?:p|pp|page|pág|pag|página|s|seite|стр|с)\.? ?|[页頁] ?|第 ?)?\d{1,4}(?: ?[页頁])?)[ \t]*$", re.I
)
#: what may end the line of a page number besides a digit
_NUMBER_ENDS = "-–—~·•)]页頁"
#: a page number beside a running title: set off by four spaces, two strokes or a dot
TITLE_AND_NUMBER = re.compile(r"(?:\d{1,4} {4,}\S[^|\t]{3,100}|[^|\t]{3,100}[^\s.,;:。，；：](?: {4,}| *// *| · )\d{1,4})")
_RULE = re.compile(r"^[ \t]*={10,}[ \t]*$")
_STRIP = re.compile(r"```.*?(?:```|\Z)|<(pre|code)\b.*?(?:</\1>|\Z)|<!--.*?(?:-->|\Z)|</?[A-Za-z][^<>\n]*>?|\$[^$\n]+\$|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{.*?(?:\\end\{[^{}]*\}|\Z)|\\[A-Za-z]+(?:\{[^{}\n]*\})?|\{\{[^{}\n]*\}\}|&#?\w+;|https?://\S+|\S+\.(?:png|jpg|html?)\b|<\|.*?\|>", re.S)
_MARKUP = re.compile(r"[<$\\&{`]")
_CJK = "぀-ヿ㐀-鿿豈-﫿"
WORD = re.compile(rf"[^\W_{_CJK}]+")
#: the same where no character is as high as those of scripts without spaces and their marks
_WORD_BELOW = re.compile(r"\w+")
_DENSE = re.compile("[\u3002-\uffff]")
#: where words of ASCII text are split
_ASCII_GAPS = {c: " " for c in range(128) if not chr(c).isalnum()}
#: words need two letters of an alphabet in a row
_ALPHABET = re.compile(r"[A-Za-zß-ɏЀ-ӿ]{2}")
_INVISIBLE = re.compile("[\u200b-\u200d\u2060\ufeff\u00ad]")
_LOOK = str.maketrans("оаеорсхуіѕјο", "oaeopcxyisjo")
COUNT_SCHEMA = "word string, texts bigint"


@functools.lru_cache(maxsize=1 << 16)
def _fold(word: str) -> str:
    """Full-width forms, ligatures and combining accents composed; look-alikes by the script that the word has."""
    if word.isascii():
        return word
    word = unicodedata.normalize("NFKC", word)
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in word)
    if cyrillic == len(word):
        return word
    if not cyrillic:
        return word.translate(_LOOK)
    latin = sum(c < "ɐ" and c.isalpha() for c in word)
    return word.translate(_LOOK) if latin > cyrillic else word.translate(_TO_CYRILLIC)


_TO_CYRILLIC = str.maketrans("oaepcxyj", "оаерсхуј")


def words_of(text: str) -> list[str]:
    """The words of a text in their order, folded."""
    if not _ALPHABET.search(text):
        return []
    if _MARKUP.search(text) or "://" in text:
        text = _STRIP.sub(" ", text)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if "\n" in text:
        text = HYPHEN.sub("", text)
    if text.isascii():
        return text.translate(_ASCII_GAPS).split()
    text = _INVISIBLE.sub("", text)
    found = WORD.findall(text) if _DENSE.search(text) else _WORD_BELOW.findall(text.replace("_", " "))
    return [w if w.isascii() else _fold(w) for w in found]


def word_counts(df: DataFrame, text: Column) -> DataFrame:
    """(word, texts): the number of texts that hold each word."""

    def frame(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame([(w, n) for w, n in counts.items() if len(w) >= 2 and not w.isdigit()], columns=["word", "texts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for content in batch["text"]:
                counts.update(set(words_of(content)))
            if len(counts) > 500_000:
                yield frame(counts)
                counts.clear()
        yield frame(counts)

    counted = df.select(text.alias("text")).where(F.col("text").isNotNull()).mapInPandas(run, COUNT_SCHEMA)
    return counted.groupBy("word").agg(F.sum("texts").alias("texts"))


class Trie:
    """Vocabulary as nested dicts; an entry's count stands under the empty key."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.root: dict = {}
        for word, n in entries:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = n


def _table() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for group in ALIKE:
        for a in group:
            near.setdefault(a, set()).update(set(group) - {a})
    return {a: "".join(sorted(b)) for a, b in near.items()}


_NEAR = _table()
_ONE_OF_TWO = {}
for _one, _more in PAIRS:
    _ONE_OF_TWO.setdefault(_one, []).append(_more)
_TWO_OF_ONE = {}
for _one, _more in PAIRS:
    if len(_more) == 2:
        _TWO_OF_ONE.setdefault(_more, []).append(_one)
_OF_TWO = frozenset("".join(_TWO_OF_ONE))


class Automaton:
    """Levenshtein automaton of one read word, with the edits of scanners, as bit sets of positions.

    ``levels[e]`` are the positions of the read word reachable with ``e`` edits after some vocabulary prefix.
    """

    def __init__(self, word: str, edits: int):
        self.word, self.edits, self.end = word, edits, 1 << len(word)
        self.same: dict[str, int] = {}
        self.alike: dict[str, int] = {}
        self.longer: dict[str, list[tuple[int, int]]] = {}
        for i, c in enumerate(word):
            bit = 1 << i
            self.same[c] = self.same.get(c, 0) | bit
            for other in _NEAR.get(c, ""):
                self.alike[other] = self.alike.get(other, 0) | bit
        for one, spellings in _ONE_OF_TWO.items():
            for spelling in spellings:
                at = word.find(spelling)
                while at >= 0:
                    self.longer.setdefault(one, []).append((1 << at, len(spelling)))
                    at = word.find(spelling, at + 1)
        #: letters of an entry after which any position can live
        self.letters = _OF_TWO.union(self.same, self.alike, self.longer)

    def step(self, levels: tuple[int, ...], before: tuple[int, ...] | None, last: str, c: str) -> tuple[int, ...]:
        same, alike = self.same.get(c, 0), self.alike.get(c, 0)
        out = []
        for e, now in enumerate(levels):
            reach = (now & same) << 1
            if e:
                fewer = levels[e - 1]
                reach |= (fewer & alike) << 1
                for bit, length in self.longer.get(c, ()):
                    if fewer & bit:
                        reach |= bit << length
                if before is not None:
                    for one in _TWO_OF_ONE.get(last + c, ()):
                        reach |= (before[e - 1] & self.same.get(one, 0)) << 1
            out.append(reach)
        return tuple(out)


def candidates(trie: Trie, word: str, edits: int = EDITS) -> list[tuple[str, int, int]]:
    """All (entry, edits, count) of the vocabulary within reach of the read word."""
    automaton = Automaton(word, edits)
    start = (1,) + (0,) * edits
    out = []
    stack = [(trie.root, start, None, "", "")]
    while stack:
        node, levels, before, last, prefix = stack.pop()
        if "" in node:
            for e, reach in enumerate(levels):
                if reach & automaton.end:
                    if e:
                        out.append((prefix, e, node[""]))
                    break
        for c in automaton.letters if len(node) > len(automaton.letters) else node:
            if c in node and c in automaton.letters:
                after = automaton.step(levels, before, last, c)
                # a state with no position may still live by a pair that began one letter ago
                if any(after) or any(levels) and (c in _FIRST_OF_TWO):
                    stack.append((node[c], after, levels, c, prefix + c))
    return out


_FIRST_OF_TWO = {two[0] for two in _TWO_OF_ONE}
CORRECTION_SCHEMA = "word string, texts bigint, entries array<struct<edits:int,texts:bigint,entry:string>>"


def plausible(word: str) -> bool:
    """Whether a word is looked up: two letters or more, and no code, which is no case."""
    letters = sum(c.isalpha() for c in word)
    digits = len(word) - letters
    if letters < 2 or digits > letters:
        return False
    if not digits:
        return True
    return not word[0].isdigit() and (word[0].islower() or digits > 0 and not word.isupper()) or digits == 1 and word[0].isdigit() and word[1:].islower()


def in_doubt(word: str) -> bool:
    """Whether a word may need the word before it to be judged: short words, which have others all around them, and names."""
    return len(word) < SHORTEST or word[:1].isupper()


def keys_of(words: list[str]) -> set[str]:
    """What corrections of these words are found under: the word, or the word before and the word."""
    kept = [(a, w) for a, w in zip(["", *words], words) if plausible(w)]
    return {w for _, w in kept} | {f"{a} {w}" for a, w in kept if in_doubt(w)}


def corrections(counts: DataFrame, texts: int) -> DataFrame:
    """Words with candidates far more frequent than they are.  ``counts`` is materialised."""
    least = max(LEAST_TEXTS, texts * LEAST_RATE)
    spark = counts.sparkSession
    entries = [(r[0], r[1]) for r in counts.where(F.col("texts") >= least).toLocalIterator() if not any(c.isdigit() for c in r[0])]
    shared = spark.sparkContext.broadcast(entries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["texts"]):
                if plausible(word):
                    found = [(e, c, v) for v, e, c in candidates(trie, word) if c >= RATIO * n]
                    if found:
                        rows.append((word, n, sorted(found, key=lambda x: (x[0], -x[1], x[2]))))
            yield pd.DataFrame(rows, columns=["word", "texts", "entries"])

    return counts.repartition(spark.sparkContext.defaultParallelism * 4, "word").mapInPandas(run, CORRECTION_SCHEMA)


def in_context(doubtful: DataFrame, texts: DataFrame) -> DataFrame:
    """Corrections by the word before: candidates far more frequent after it.  ``doubtful`` is materialised."""
    options = doubtful.select("word", F.explode("entries").alias("e"))
    # words in doubt and their candidates; beyond the broadcast bound all pairs are counted and the joins choose
    wanted = options.select("word").union(options.select("e.entry")).distinct()
    few = wanted.limit(MOST_CORRECTIONS + 1).count() <= MOST_CORRECTIONS
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in wanted.collect())) if few else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = shared.value if few else None
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                if keys is None or not keys.isdisjoint(words):
                    counts.update((a, b) for a, b in zip(["", *words], words) if keys is None or b in keys)
            if len(counts) > 500_000:
                yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["a", "b", "n"])
                counts.clear()
        yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["a", "b", "n"])

    pairs = cut(texts.select("text").mapInPandas(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")))
    read = pairs.select("a", F.col("b").alias("word"), F.col("n").alias("times")).join(options, "word").withColumn("b", F.col("e.entry"))
    sure = read.join(pairs, ["a", "b"]).where((F.col("n") >= LEAST_TEXTS) & (F.col("n") >= RATIO * F.col("times")))
    grouped = sure.groupBy("a", "word").agg(F.max("times").alias("texts"), F.collect_list(F.struct("e.edits", (-F.col("e.texts")).alias("texts"), "e.entry")).alias("entries"))
    entries = F.expr("transform(array_sort(entries), x -> named_struct('edits', x.edits, 'texts', -x.texts, 'entry', x.entry))")
    return grouped.select(F.concat_ws(" ", "a", "word").alias("word"), "texts", entries.alias("entries"))


@functools.lru_cache(maxsize=1 << 14)
def _letters(text: str) -> str:
    return "".join(filter(str.isalpha, unicodedata.normalize("NFKC", text).casefold()))


def _may_be_title(line: str, titles: list[str]) -> bool:
    """Cheap test before the letters of a line are compared: its length fits one of the titles."""
    return any(len(t) <= len(line) <= 3 * len(t) + 24 for t in titles)


def furniture(lines: list[str], titles: list[str]) -> list[str | None]:
    """``head`` or ``number`` for each line that is no body text."""
    out: list[str | None] = [None] * len(lines)
    body = 0
    ruled = [bool(_RULE.match(line)) for line in lines] if any("==========" in line for line in lines) else None
    for i, line in enumerate(lines):
        stripped = line.strip()
        if not stripped:
            continue
        if ruled and (ruled[i] or i and ruled[i - 1] and i + 1 < len(lines) and ruled[i + 1]):
            out[i] = "banner"
        elif (stripped[-1].isdecimal() or stripped[-1] in _NUMBER_ENDS) and PAGE_NUMBER.match(line):
            out[i] = "number"
        elif stripped[:1].isdigit() != stripped[-1:].isdigit() and TITLE_AND_NUMBER.fullmatch(stripped):
            out[i] = "head"
        elif titles and len(stripped) < 160 and _may_be_title(stripped, titles) and _letters(stripped) in titles:
            out[i] = "head"
        elif body < 10:
            body += sum(map(str.isalpha, stripped))
        if out[i] in ("number", "head") and body < 10:
            out[i] = "top " + out[i]  # above all body text
    # a note number in brackets by itself in the last paragraph
    if len(lines) > 2 and re.fullmatch(r"\s*\[\d{1,4}\]\s*", lines[-1]) and not lines[-2].strip():
        wrapped = sum(1 for line in lines if 20 <= len(line.strip()) <= 90)
        if wrapped < 3:
            out[-1] = "note"
    return out


FLAG_SCHEMA = "src_table string, row_id bigint, broken int, blots int, misread int, heads int, numbers int"


@functools.lru_cache(maxsize=1 << 12)
def _title_keys(title: str | None, header: str | None) -> list[str]:
    return [k for k in (_letters(t) for t in (title, header) if isinstance(t, str)) if len(k) >= 6]


def _doubtful(known: dict) -> frozenset[str]:
    """Words that are misread after some words before them."""
    return frozenset(k.partition(" ")[2] for k in known if " " in k)


def inspect(text: str, titles: list[str], known: dict, doubtful: frozenset[str], contexts: dict) -> tuple[int, int, int, int, int]:
    """Number of broken words, blots, misread words and characters, running heads and page numbers."""
    blots = len(BLOT.findall(text)) if _BLOT_MARK.search(text) else 0
    broken = heads = numbers = 0
    if "\n" in text:
        broken = len(HYPHEN_END.findall(text))
        marks = furniture(text.split("\n"), titles)
        heads, numbers = marks.count("head"), marks.count("number")
    words = words_of(text) if known else []
    if words and text[-1:].isalnum():
        words.pop()  # the last word of a text that was cut off is no misreading
    misread = 0 if known.keys().isdisjoint(words) else sum(w in known for w in words)
    if not doubtful.isdisjoint(words):
        misread += sum(w in doubtful and f"{a} {w}" in known for a, w in zip(["", *words], words))
    if contexts and not text.isascii() and _DENSE.search(text):
        flat = text.replace("\r", "").replace("\n", "")
        misread += sum(_meant(m, contexts) is not None for m in _SUSPECT.finditer(flat) if m.group() in DENSE_ALIKE)
    return broken, blots, misread, heads, numbers


def titles_of(jobs: DataFrame, blocks: DataFrame) -> DataFrame:
    """One title and one header text per job."""
    titles = jobs.groupBy("job_id").agg(F.max("title").alias("title"))
    headers = blocks.where("block_label = 'header'").groupBy("job_id").agg(F.max("block_content").alias("header"))
    return titles.join(headers, "job_id", "full_outer")


def _known(texts: DataFrame) -> DataFrame:
    """Materialised corrections of a corpus, those in doubt under the word before and the word."""
    counts = cut(word_counts(texts, F.col("text")))
    found = cut(corrections(counts, texts.count()))
    doubt = F.col("word").rlike(rf"^\p{{L}}{{1,{SHORTEST - 1}}}$") | F.col("word").rlike(r"^\p{Lu}\p{L}*$") & (F.col("entries")[0]["edits"] > 1)
    doubtful = found.where(doubt)
    return found if doubtful.isEmpty() else cut(found.where(~doubt).unionByName(in_context(doubtful, texts)))


def _shared_words(known: DataFrame, *columns: str):
    """Corrections as a broadcast variable if their number, which is checked, allows it; else None."""
    if known.count() > MOST_CORRECTIONS:
        return None
    return known.sparkSession.sparkContext.broadcast({r[0]: r[1:] for r in known.select("word", *columns).collect()})


def _row_corrections(rows: DataFrame, known: DataFrame, text: str = "text", split=words_of) -> DataFrame:
    """The corrections that each text needs, by a shuffle join on the word: the way beyond the broadcast bound."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(t, i, w) for t, i, x in zip(batch["src_table"], batch["row_id"], batch[text]) if x is not None for w in sorted(keys_of(split(x)))]
            yield pd.DataFrame(out, columns=["src_table", "row_id", "word"])

    pairs = rows.select("src_table", "row_id", text).mapInPandas(words, "src_table string, row_id bigint, word string")
    return pairs.join(known, "word").groupBy("src_table", "row_id").agg(F.to_json(F.collect_list(F.struct("word", "entries"))).alias("fixes"))


def _with_corrections(rows: DataFrame, titled: DataFrame, known: DataFrame, shared) -> DataFrame:
    if shared is not None:
        return titled.withColumn("fixes", F.lit(None).cast("string"))
    return titled.join(_row_corrections(rows, known), ["src_table", "row_id"], "left")


def _of_row(shared, fixes: str | None) -> dict:
    if shared is not None:
        return shared.value
    return {x["word"]: ([(e["edits"], e["texts"], e["entry"]) for e in x["entries"]],) for x in json.loads(fixes)} if isinstance(fixes, str) else {}


def inspected(texts: DataFrame, jobs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Flags of every text; ``texts`` has src_table, row_id, job_id, text."""
    rows = texts.where(F.col("text").isNotNull()).select("src_table", "row_id", "job_id", "text")
    known = _known(rows)
    shared = _shared_words(known)
    contexts = cut(_contexts(rows))
    fillers = _shared_contexts(contexts)
    titled = rows.join(broadcast_if_small(cut(titles_of(jobs, blocks))), "job_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FLAG_SCHEMA.split(", ")]
        doubtful = None if shared is None else _doubtful(shared.value)
        for batch in batches:
            out = []
            for table, row_id, text, title, header, fixes, fills in zip(*(batch[c] for c in (*_COLUMNS, "fills"))):
                fixable = _of_row(shared, fixes)
                found = inspect(text, _title_keys(title, header), fixable, _doubtful(fixable) if doubtful is None else doubtful, _fills_of_row(fillers, fills))
                out.append((table, row_id, *found))
            yield pd.DataFrame(out, columns=names)

    fixable = _with_corrections(rows, titled, known, shared).select(*_COLUMNS)
    if fillers is None:
        needs = _row_contexts(rows.withColumn("flowed", F.regexp_replace("text", "[\r\n]", "")), contexts)
        fixable = fixable.join(needs, ["src_table", "row_id"], "left")
    else:
        fixable = fixable.withColumn("fills", F.lit(None).cast("string"))
    return fixable.select(*_COLUMNS, "fills").mapInPandas(run, FLAG_SCHEMA)


_COLUMNS = ("src_table", "row_id", "text", "title", "header", "fixes")


#: fixed values: characters that scanners put for the Chinese or Japanese character after them
DENSE_ALIKE = dict(zip("旳茌丁入末己曰卜甲厉太节冊—=旱千土", "的在了人未已日上里历大书册一二早干士"))
_SUSPECT = re.compile(rf"(?<=[{_CJK}，。；：])[□■◇◆〓※¦▪▯█{''.join(map(re.escape, DENSE_ALIKE))}](?=[{_CJK}，。；：])")
#: beyond so many contexts, they are counted and looked up by shuffle joins
MOST_CONTEXTS = 300_000
_TRIPLE = re.compile(rf"(?=([{_CJK}，。；：].[{_CJK}，。；：]))", re.S)


class TripleCounter:
    """Counts three characters in a row of which the outer ones are among ``keys``."""

    def __init__(self, keys: Iterable[str]):
        ends = _codes("".join(keys)).reshape(-1, 2)
        self.keys = np.unique(ends[:, 0] << _CODE_BITS | ends[:, 1])
        #: most pairs are ruled out by a few bits
        self.marks = np.zeros(1 << 20, dtype=bool)
        self.marks[self._mark(self.keys)] = True
        self.counts: Counter = Counter()

    @staticmethod
    def _mark(pairs: np.ndarray) -> np.ndarray:
        return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)

    def update(self, flats: list[str]) -> None:
        """``flats`` have no line breaks; two between them belong to no triple."""
        codes = _codes("\n\n".join(flats))
        if len(codes) < 3 or not len(self.keys):
            return
        pairs = codes[:-2] << _CODE_BITS | codes[2:]
        at = np.flatnonzero(np.take(self.marks, self._mark(pairs)))
        pairs = pairs[at]
        known = np.take(self.keys, np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)) == pairs
        triples, n = np.unique(pairs[known] << _CODE_BITS | codes[at[known] + 1], return_counts=True)
        for x, times in zip(triples.tolist(), n.tolist()):
            self.counts[x] += times

    def strings(self) -> list[tuple[str, int]]:
        low = (1 << int(_CODE_BITS)) - 1
        return [(chr(x >> 42) + chr(x & low) + chr(x >> 21 & low), n) for x, n in self.counts.items()]


_CODE_BITS = np.uint64(21)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _around(flat: str) -> list[str]:
    """The characters before and after each suspect character."""
    return [flat[m.start() - 1] + flat[m.end()] for m in _SUSPECT.finditer(flat)]


def _contexts(texts: DataFrame) -> DataFrame:
    """Neighbours of suspect characters in scripts without spaces, with the counts of what stands between them."""

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {x for text in batch["text"] if not text.isascii() and _DENSE.search(text) for x in _around(text.replace("\n", ""))}
            yield pd.DataFrame({"around": list(seen)}, dtype=object)

    around = cut(texts.select("text").mapInPandas(wanted, "around string").distinct())
    few = around.limit(MOST_CONTEXTS + 1).count() <= MOST_CONTEXTS
    # two code points each
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in around.collect())) if few else None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TripleCounter(shared.value) if few else None
        for batch in batches:
            dense = (text.replace("\n", "") for text in batch["text"] if not text.isascii() and _DENSE.search(text))
            if counter:
                group, size = [], 0
                for flat in dense:
                    group.append(flat)
                    size += len(flat)
                    if size > 300_000:
                        counter.update(group)
                        group, size = [], 0
                counter.update(group)
                counts = counter.strings()
                counter.counts.clear()
            else:
                counts = list(Counter(t for flat in dense for t in _TRIPLE.findall(flat)).items())
            yield pd.DataFrame(counts, columns=["triple", "n"])

    counted = texts.select("text").mapInPandas(count, "triple string, n bigint").groupBy("triple").agg(F.sum("n").alias("n"))
    blot = F.col("c").rlike(r"[□■◇◆〓※¦▪▯█\n]")
    split = counted.select(F.expr("substring(triple, 1, 1) || substring(triple, 3, 1)").alias("around"), F.expr("substring(triple, 2, 1)").alias("c"), "n").where(~blot)
    # per context the most frequent character, its count and that of all
    best = split.groupBy("around").agg(F.max_by("c", F.struct("n", "c")).alias("best"), F.max("n").alias("n"), F.sum("n").alias("total"))
    best = best.where((F.col("n") >= LEAST_TEXTS) & (F.col("n") >= 0.9 * F.col("total")))
    return best if few else best.join(around, "around", "left_semi")


def _shared_contexts(contexts: DataFrame):
    """Contexts as a broadcast variable if their number, which is checked, allows it; else None."""
    if contexts.limit(MOST_CONTEXTS + 1).count() > MOST_CONTEXTS:
        return None
    return contexts.sparkSession.sparkContext.broadcast({r[0]: r[1:] for r in contexts.select("around", "best", "n", "total").collect()})


def _row_contexts(flowed: DataFrame, contexts: DataFrame) -> DataFrame:
    """The contexts that each text needs, by a shuffle join on the two characters: the way beyond the broadcast bound."""

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(t, i, a) for t, i, text in zip(batch["src_table"], batch["row_id"], batch["flowed"]) if text is not None for a in sorted(set(_around(text)))]
            yield pd.DataFrame(out, columns=["src_table", "row_id", "around"])

    keys = flowed.select("src_table", "row_id", "flowed").mapInPandas(needed, "src_table string, row_id bigint, around string").distinct()
    return keys.join(contexts, "around").groupBy("src_table", "row_id").agg(F.to_json(F.collect_list(F.struct("around", "best", "n", "total"))).alias("fills"))


def _fills_of_row(shared, fills: str | None) -> dict:
    if shared is not None:
        return shared.value
    return {x["around"]: (x["best"], x["n"], x["total"]) for x in json.loads(fills)} if isinstance(fills, str) else {}


def _fill(flat: str, contexts: dict) -> str:
    """Suspect characters replaced where nine in ten of their contexts hold one other character."""

    return _SUSPECT.sub(lambda m: _meant(m, contexts) or m.group(), flat)


def _meant(m: re.Match, contexts: dict) -> str | None:
    """The character that a suspect one stands for, if its contexts tell."""
    best = contexts.get(m.string[m.start() - 1] + m.string[m.end()])
    if best is None or best[1] < LEAST_TEXTS or best[1] < 0.9 * best[2]:
        return None
    return best[0] if DENSE_ALIKE.get(m.group(), best[0]) == best[0] else None


_SENTENCE_END = re.compile(r"[.!?。！？…:：;；][)\]”’»」』）\"]*\s*$")
_STRUCTURE = re.compile(r"^\s*(?:[-+*•|#>]|={2,}|```|\d{1,3}[.)]\s|<|\\)|\t")


def flow(text: str, titles: list[str]) -> str:
    """Continuous paragraphs without furniture, with broken words joined."""
    lines = text.replace("\r\n", "\n").split("\n")
    marks = furniture(lines, titles)
    kept: list[str] = []
    after_furniture = False
    for line, mark in zip(lines, marks):
        if mark in ("head", "number"):
            while kept and not kept[-1].strip():
                kept.pop()  # the blank line before furniture is no paragraph break
            after_furniture = True
            continue
        if not line.strip() and after_furniture:
            continue
        after_furniture = False
        kept.append(line.rstrip())
    width = max((len(x) for x in kept), default=0)
    out: list[str] = []
    fence = False
    for line in kept:
        fence ^= line.lstrip().startswith("```")
        before = out[-1] if out else ""
        if not out or fence or not line.strip() or not before.strip() or _STRUCTURE.search(line) or _STRUCTURE.search(before.rsplit("\n", 1)[-1]) or _RULE.match(line) or _RULE.match(before):
            out.append(line)
        elif HYPHEN_END.search(before[-3:] + "\n"):
            out[-1] = before.rstrip()[:-1] + line.lstrip()
        elif _SENTENCE_END.search(before) and len(kept[len(out) - 1] if len(out) <= len(kept) else before) < 0.6 * width:
            out.append(line)
        elif width > 100:
            out.append(line)  # lines as long as paragraphs are not wrapped
        else:
            dense = bool(re.match(rf"[{_CJK}，。；：、]", line.lstrip()[:1])) or bool(re.search(rf"[{_CJK}，。；：、]$", before))
            out[-1] = before + ("" if dense else " ") + line.lstrip()
    return "\n".join(out)


def restore(joined: str, known: dict, pairs: dict, contexts: dict) -> str:
    """The text with misread words and characters replaced."""
    if contexts:
        joined = _fill(joined, contexts)
    if not known or not _ALPHABET.search(joined):
        return joined
    last, read = [""], [""]

    def put(m: re.Match) -> str:
        word = m.group()
        folded = _fold(word)
        found = known.get(folded) or in_doubt(folded) and known.get(f"{read[0]} {folded}")
        read[0] = folded
        if found:
            entries = found[0]
            fewest = entries[0][0]
            word = max((e for e in entries if e[0] == fewest), key=lambda e: (pairs.get((last[0], e[2]), 0), e[1], e[2]))[2]
        last[0] = word
        return word

    return WORD.sub(put, joined)


def _pairs(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of (word before, candidate) for the candidates of ambiguous corrections."""
    fewest = known.select(F.expr("transform(filter(entries, e -> e.edits = entries[0].edits), e -> e.entry)").alias("c")).where(F.size("c") > 1)
    wanted = fewest.select(F.explode("c").alias("b")).distinct()
    # a part of the vocabulary, which is sent to the tasks as a whole before
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in wanted.collect()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["text"] if shared.value else ():
                words = words_of(text)
                counts.update((a, b) for a, b in zip(words, words[1:]) if b in shared.value)
            yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["a", "b", "n"])

    return texts.select("text").mapInPandas(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= 2)


def _shared_pairs(pairs: DataFrame):
    """Counts of neighbours as a broadcast variable if their number, which is checked, allows it; else None."""
    if pairs.limit(MOST_CORRECTIONS + 1).count() > MOST_CORRECTIONS:
        return None
    return pairs.sparkSession.sparkContext.broadcast({(r[0], r[1]): r[2] for r in pairs.select("a", "b", "n").collect()})


def _ambiguous(joined: str, known: dict) -> set[tuple[str, str]]:
    """(word before, candidate) of all words with several candidates; the word before may itself be corrected."""
    out: set[tuple[str, str]] = set()
    before, read = [""], ""
    for word in WORD.findall(joined) if known and _ALPHABET.search(joined) else ():
        folded = _fold(word)
        found = known.get(folded) or in_doubt(folded) and known.get(f"{read} {folded}")
        read = folded
        now = [e[2] for e in found[0] if e[0] == found[0][0][0]] if found else [word]
        if len(now) > 1:
            out.update((a, b) for a in before for b in now)
        before = now
    return out


def _row_pairs(flowed: DataFrame, pairs: DataFrame, shared) -> DataFrame:
    """The counts of neighbours that each text needs, by a shuffle join on both words: the way beyond the broadcast bound."""

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["src_table"], batch["row_id"], batch["flowed"], batch["fixes"])
            out = [(t, i, a, b) for t, i, text, fixes in rows if text is not None for a, b in sorted(_ambiguous(text, _of_row(shared, fixes)))]
            yield pd.DataFrame(out, columns=["src_table", "row_id", "a", "b"])

    keys = flowed.select("src_table", "row_id", "flowed", "fixes").mapInPandas(needed, "src_table string, row_id bigint, a string, b string").distinct()
    return keys.join(pairs, ["a", "b"]).groupBy("src_table", "row_id").agg(F.to_json(F.collect_list(F.struct("a", "b", "n"))).alias("befores"))


def _pairs_of_row(shared, befores: str | None) -> dict:
    if shared is not None:
        return shared.value
    return {(x["a"], x["b"]): x["n"] for x in json.loads(befores)} if isinstance(befores, str) else {}


def repaired(texts: DataFrame, jobs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src_table, row_id, repaired text) of every text."""
    rows = texts.where(F.col("text").isNotNull()).select("src_table", "row_id", "job_id", "text")
    known = _known(rows)
    shared = _shared_words(known, "entries")
    pairs = cut(_pairs(rows, known))
    neighbours = _shared_pairs(pairs)
    contexts = cut(_contexts(rows))
    fillers = _shared_contexts(contexts)
    titled = texts.select("src_table", "row_id", "job_id", "text").join(broadcast_if_small(cut(titles_of(jobs, blocks))), "job_id", "left")

    def flows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flowed = [None if text is None else flow(text, _title_keys(title, header)) for text, title, header in zip(batch["text"], batch["title"], batch["header"])]
            yield pd.DataFrame({"src_table": batch["src_table"], "row_id": batch["row_id"], "flowed": flowed})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fixed = [
                None if text is None else restore(text, _of_row(shared, fixes), _pairs_of_row(neighbours, befores), _fills_of_row(fillers, fills))
                for text, fixes, befores, fills in zip(*(batch[c] for c in ("flowed", "fixes", "befores", "fills")))
            ]
            yield pd.DataFrame({"src_table": batch["src_table"], "row_id": batch["row_id"], "repaired": fixed})

    flowed = titled.select("src_table", "row_id", "text", "title", "header").mapInPandas(flows, "src_table string, row_id bigint, flowed string")
    if shared is None or neighbours is None or fillers is None:
        flowed = cut(flowed)
    beyond = {
        "fixes": lambda: None if shared is not None else _row_corrections(flowed, known, "flowed", lambda text: [_fold(w) for w in WORD.findall(text)]),
        "befores": lambda: None if neighbours is not None else _row_pairs(flowed, pairs, shared),
        "fills": lambda: None if fillers is not None else _row_contexts(flowed, contexts),
    }
    for name, needs in beyond.items():
        of_row = needs()
        flowed = flowed.withColumn(name, F.lit(None).cast("string")) if of_row is None else flowed.join(of_row, ["src_table", "row_id"], "left")
    return flowed.mapInPandas(run, "src_table string, row_id bigint, repaired string")
