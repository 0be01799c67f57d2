"""Figures of the README on quality: ``python -m tests.llm.quality /root/testdata/sf0.1``, one line a problem.

Each operator is compared with a plain statement of the problem that it doesn't use, over the whole table.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict

import duckdb
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirefold.llm import language, markup, queries, scan_noise, truncation_oracle, twins
from quirefold.runtime import cut, read_table


def _both(name: str, found: set, want: set) -> None:
    both = len(found & want)
    print(f"{name}: {len(found)} found, {len(want)} by the plain statement, precision {both / max(1, len(found)):.4f}, recall {both / max(1, len(want)):.4f}", flush=True)


def _pairs(rows) -> set:
    return {tuple(r) for r in rows}


def repetition(spark, sf):
    shares = [x.share for x in queries.p1_repetition(spark, sf).collect()]
    print(f"p1: {sum(x >= 0.3 for x in shares)} of {len(shares)} replies at 0.3 or more, {sum(0.25 <= x < 0.4 for x in shares)} between 0.25 and 0.4", flush=True)


def markup_rows(spark, sf):
    rows = queries.texts(spark, sf)
    lexer = _pairs(rows.where(F.regexp_replace("text", markup.GROUNDING, "").rlike(markup.LEXER)).select(*queries.KEYS).collect())
    _both("p2, lexer alone", _pairs(queries.p2_found(spark, sf).collect()), lexer)
    found = cut(markup.occurrences(rows, queries.KEYS, "source", "text"))
    member = F.broadcast(markup.classes(found, queries.KEYS).select(F.explode("members").alias("token")).distinct())
    print(f"p2: {found.join(member, 'token', 'left_semi').select(*queries.KEYS).distinct().count()} rows hold a token of a valid class", flush=True)
    brackets = rows.select(*queries.KEYS, F.regexp_count("text", F.lit(r"[(（]")).alias("o"), F.regexp_count("text", F.lit(r"[)）]")).alias("c")).where("o + c > 0")
    print(f"p2: opening and closing brackets have equal counts in {brackets.where('o = c').count()} of {brackets.count()} texts with brackets", flush=True)


def one_form(spark, sf):
    def plain(text: str) -> str:
        kept = {c: chr(0xF0000 + i) for i, c in enumerate(twins.KEPT)}
        text = "".join(kept.get(c, c) for c in text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F)
        text = "".join(" " if unicodedata.category(c) == "Zs" else twins.LIKE.get(c, c) for c in text)
        return unicodedata.normalize("NFC", text)

    forms = defaultdict(list)
    for x in queries.texts(spark, sf).where(f"char_length(text) >= {twins.LEAST_CHARS}").select("src_table", "row_id", "text").toLocalIterator():
        forms[x[0], plain(x[2])].append((x[1], x[2]))
    want = {(t, min(a, b), max(a, b)) for (t, _), xs in forms.items() if len({x[1] for x in xs}) > 1 for i, (a, s) in enumerate(xs) for b, u in xs[:i] if s != u}
    _both("p3", _pairs(queries.p3_found(spark, sf).collect()), want)


def cut_texts(spark, sf):
    calls = read_table(spark, sf, "llm_ocr")
    title = re.compile(r"(?:——|[A-ZГ][a-zа-яíé]+ [0-9１-９]+:|第.{1,3}章)")
    want = set()
    for x in calls.select("call_id", "content").where("content is not null").toLocalIterator():
        text = "".join(c for c in x.content if unicodedata.category(c) != "Cf").rstrip()
        if text and (text[-1].isalpha() or text[-1] in ",，;；—�" or re.search(r"[^.]\.\.\.$", text)) and not title.match(text.split("\n")[-1]) and not re.search(r"\d+ ?[页頁]$", text):
            want.add((x.call_id,))
    _both("p5, ends in a letter, comma or dash", _pairs(queries.p5_found(spark, sf).collect()), want)
    judged = queries.p5_calls(spark, sf)
    print(f"p5: {judged.where('terminal_rate < 0.01').count()} suspects by trigrams of {judged.count()}, {judged.where('closing').count()} of them closing lines", flush=True)


def by_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("llm_ocr", "parsing_res_list"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    _both(name, _pairs(queries.QUERIES[name](spark, sf).collect()), _pairs(con.execute(queries.ORACLE[name]).fetchall()))


def scan(spark, sf):
    flags = cut(queries.p7_noise(spark, sf))
    rest = flags.where("broken + blots + heads + numbers = 0 AND misread > 0")
    print(f"p7: {flags.where('broken + blots + misread + heads + numbers > 0').count()} rows, {rest.count()} of them by the automaton or contexts alone", flush=True)
    counts = cut(scan_noise.word_counts(queries.texts(spark, sf).select("text"), F.col("text")))
    found = cut(scan_noise.corrections(counts, queries.texts(spark, sf).where("text is not null").count()))
    for kind, like in (("capitalised", r"^\p{Lu}\p{L}{3,}$"), ("short", r"^\p{L}{2,3}$")):
        print(f"p7: {counts.where(F.col('word').rlike(like)).count()} {kind} words are looked up, {found.where(F.col('word').rlike(like)).count()} have candidates", flush=True)


def mixture(spark, sf):
    rows = queries.p9_shares(spark, sf).collect()
    total = sum(x.reached_tokens for x in rows)
    off = max((abs(x.reached_tokens / x.target_tokens - 1) for x in rows if x.tokens * x.max_repeats >= x.target_tokens > 0), default=0)
    print(f"p9: attainable sources within {off:.4f} of their tokens; shares of the mix: " + ", ".join(f"{x.source} {x.reached_tokens / max(1, total):.3f} for {x.target_share}" for x in rows), flush=True)


def languages(spark, sf):
    samples = queries.language_samples(spark, sf)
    held = [s for i, s in enumerate(samples) if i % 5 == 0]
    classifier = language.Classifier([s for i, s in enumerate(samples) if i % 5])
    print(f"p10: held-out accuracy {sum(classifier.best(t)[0] == lang for lang, t in held) / len(held):.4f} of {len(held)}", flush=True)
    classifier, grouped, single, segments, same = language.Classifier(samples), set(), set(), 0, 0
    for x in read_table(spark, sf, "documents").select("doc_id", "text").where("text is not null").toLocalIterator():
        language.GROUP = 4
        a = [s[:3] for s in classifier.segments(x.text)]
        language.GROUP = 1
        b = [s[:3] for s in classifier.segments(x.text)]
        grouped |= {(x.doc_id, s[2]) for s in a if s[1] >= 2}
        single |= {(x.doc_id, s[2]) for s in b if s[1] >= 2}
        segments += len(b)
        same += len(set(a) & set(b))
    language.GROUP = 4
    _both("p10, groups of four sentences against single ones, (document, language)", grouped, single)
    print(f"p10: {same} of {segments} segments the same", flush=True)


def main(sf: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    repetition(spark, sf)
    markup_rows(spark, sf)
    one_form(spark, sf)
    cut_texts(spark, sf)
    by_sql(spark, sf, "p5_found")
    by_sql(spark, sf, "p6_found")
    scan(spark, sf)
    mixture(spark, sf)
    languages(spark, sf)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
