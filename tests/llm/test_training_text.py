"""Small fixtures against brute force, and the odd cases of every operator."""

import itertools
import os
import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from quirefold.llm import language, leakage, lines, markup, mixture, queries, repetition, scan_noise, truncation, twins
from quirefold.llm.textkit import tokens

LONG = "many words of a text that goes on. " * 20_000


# 1 repetition


def _brute_mask(s):
    """Letters in windows that occurred before, and in runs, by comparing everything."""
    n, out = len(s), [False] * len(s)
    for k, dense in ((repetition.PASSAGE_LETTERS, False), (repetition.PASSAGE_CJK, True)):
        for i in range(n - k + 1):
            w = s[i : i + k]
            if s.find(w) < i and (not dense or all(ord(c) >= 0x2E80 for c in w)):
                out[i : i + k] = [True] * k
    for p in range(1, min(repetition.PASSAGE_LETTERS, n // 2) + 1):
        i = p
        while i < n:
            j = i
            while j < n and s[j] == s[j - p]:
                j += 1
            least = repetition.RUN_CJK if i < n and ord(s[i]) >= 0x2E80 else repetition.RUN_LETTERS
            if j - i >= max(2 * p, least - p):
                out[i:j] = [True] * (j - i)
            i = max(j, i + 1)
    return out


def test_repetition_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        words = ["".join(r.choice("abcdefg文字長") for _ in range(r.randint(1, 12))) for _ in range(6)]
        s = "".join(r.choice(words) for _ in range(r.randint(1, 40)))
        assert repetition.repeated_mask(repetition._letters(s)).tolist() == _brute_mask(s)


def test_repetition_odd_cases(spark):
    once = "The keeper of the archive had copied the broken seal beside the salt works. "
    rows = [(1, None), (2, ""), (3, "123 ... !"), (4, once), (5, once * 2), (6, once + once.upper().replace(" ", "  ")), (7, LONG), (7, LONG), (8, "na " * 40)]
    df = spark.createDataFrame(rows, "call_id bigint, content string").withColumn("row_id", F.lit("clash"))
    got = {x.row_id: x for x in repetition.measure(df, F.col("call_id"), F.col("content"), [("en", once * 5)]).collect()}
    assert [got[i].share for i in (1, 2, 3, 4)] == [0, 0, 0, 0]
    assert got[5].share == pytest.approx(0.5) and got[6].share == pytest.approx(0.5) and got[7].share > 0.99 and got[8].share > 0.9
    assert got[4].jsd_word is None and got[5].reference == "en" and 0 <= got[5].jsd_word <= 1
    assert repetition.measure(df.limit(0), F.col("call_id"), F.col("content")).count() == 0


def test_references_count_all_samples(spark, tmp_path, monkeypatch):
    """No sample is left out, however many there are, and counting in Spark gives what counting here gives."""
    english, german = "The keeper of the archive copied the broken seal. ", "Der Hüter des Archivs ersetzte das zerbrochene Siegel. "
    samples = [("en", english)] * 3 + [("en", None), ("", german), (None, german)] + [("de", german), ("de", "Das Siegel-")]
    spark.createDataFrame([(i, *x) for i, x in enumerate(samples)], "sample_id bigint, lang string, text string").write.parquet(f"{tmp_path}/lang_samples.parquet")
    spark.createDataFrame([(1, english * 3), (2, german * 3)], "call_id bigint, content string").write.parquet(f"{tmp_path}/llm_ocr.parquet")
    monkeypatch.setattr(queries, "MAX_SAMPLES", 2)
    got = {x.call_id: x for x in queries.p1_repetition(spark, str(tmp_path)).collect()}
    assert (got[1].reference, got[2].reference) == ("en", "de")
    counted, fitted = repetition.references(spark.read.parquet(f"{tmp_path}/lang_samples.parquet")), repetition.References(samples)
    assert counted.languages == fitted.languages == ["de", "en"] and counted.places == fitted.places
    assert (counted.classes == fitted.classes).all() and (counted.words == fitted.words).all()
    assert repetition.references(spark.createDataFrame([], "lang string, text string")).languages == []


def test_histograms_do_not_see_copies():
    """Why the divergence cannot give the share: a text and two copies of it have the same distances."""
    text = "The keeper of the archive had copied the broken seal beside the salt works, so it seems to us now. "
    ref = repetition.References([("en", "The seal of the keeper was broken and it is so")])
    once, twice = ref.nearest([text, text * 2])
    assert once[2] == pytest.approx(twice[2])


# 2 markup

MARKED = [
    "<p>a</p>", "<b>x</b> y", "a &amp; b", "x<br>y", "**bold** word", "a ~~b~~ c", "# Title\nx", "> quoted", "- **x**\n- **y**", "== Part ==\nx", "[[a|b]] c", "{{note|x|p=1}} y", "'''b''' c",
    r"\section{A} b", r"\begin{itemize}\item a\end{itemize}", r"\[ x^2 \]", "$x_{1}$ y", "$$ a $$", "```\ncode\n```", "| a | b |\n| --- | --- |", "[a](http://x.y)", "![](i.png)", "`x` y", r"\emph{a} b",
    "# T\n> q **b** c ~~d~~ &amp; e<br>f", "{{n}} [[a]] == b ==\n{| x |}",
]
PLAIN = ["a < b and b > a", "5 * 3 = 15", "costs $409 and $2", "file page_12_final", "see [12]", "====================\n第 1 页 (共 2 页)\n====================", "~ 12 ~", "- 12 -", "Part ........ 12", "No. #941", "Smith & Sons", "1) first\n2) second", "<|ref|>text<|/ref|> <|det|>[[1,2,3,4]]<|/det|>", "", None]


def test_markup_found_and_not(spark):
    rows = [(s, i, v) for s in ("a", "b", None) for i, v in enumerate(MARKED * 3 + PLAIN * 3)]
    df = spark.createDataFrame([(n, s, v) for n, (s, _, v) in enumerate(rows)], "id bigint, source string, text string").withColumn("token", F.lit(1))
    found = {x.id for x in markup.pieces_of_markup(df, ["id"], "source", "text").collect()}
    for n, (_, i, v) in enumerate(rows):
        assert (n in found) == (i < 3 * len(MARKED)), v


def test_families_without_a_template_are_no_markup(spark):
    """Marks that never come with a partner, nor in a text that has a template, are no markup of this corpus."""
    texts = ["# one", "# two", "> three", "# four\n> five"] * 5
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id bigint, source string, text string")
    assert markup.pieces_of_markup(df, ["id"], "source", "text").count() == 0
    mixed = df.unionByName(spark.createDataFrame([(100 + i, "s", "# T\n<b>x</b>") for i in range(3)], df.schema))
    assert {x.id for x in markup.pieces_of_markup(mixed, ["id"], "source", "text").collect()} == {i for i, t in enumerate(texts) if "#" in t} | {100, 101, 102}


def test_slots(spark):
    df = spark.createDataFrame([(i, "s", f"<p>name {i}</p><b>k</b> tail") for i in range(4)] + [(9, None, None), (10, "s", "")], "id bigint, source string, text string")
    rows = [tuple(x) for x in markup.slots(df, ["id"], "source", "text").select("id", "token", "slot").orderBy("id", "place").collect()]
    assert rows[:3] == [(0, "<p", "name 0"), (0, "<b", "k"), (0, "</b", " tail")] and len(rows) == 12


def test_broken_markup_is_found(spark):
    whole = ["<td>a</td>", "**a** b", "[[a]] b", r"\emph{a} b", "x &nbsp; y", "<td>a &amp; b</td>"] * 40
    broken = ["a <td", "x **a", "b [[a", r"\emph{a", "x &nbsp y", "</td> b"]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(whole + broken)], "id bigint, source string, text string")
    found = {x.id for x in markup.pieces_of_markup(df, ["id"], "source", "text").collect()}
    assert [t for i, t in enumerate(whole + broken) if i not in found] == []


def test_templates_nest(spark):
    df = spark.createDataFrame([(i, "s", "<table>" + "<tr><td>a</td></tr>" * i + "</table>") for i in range(1, 6)], "id bigint, source string, text string")
    rows = markup.templates(df, ["id"], "source", "text").collect()
    by_id = {x.class_id: x for x in rows}
    inner = next(x for x in rows if "<td" in x.tokens.split())
    assert inner.parent_id is not None and "<table" in by_id[inner.parent_id].tokens


@pytest.mark.parametrize(
    "text,expected",
    [
        ("<h2>Part</h2><p>a<br>b</p>", "## Part\n\na\nb"),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n\n- b"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "| a | b |"),
        ("<pre><code>x = 1\ny</code></pre>", "```\nx = 1\ny\n```"),
        ("== Part ==\n'''b''' [[x|y]]{{n}}", "## Part\nb y"),
        (r"\section{A}" + "\n" + r"\textbf{b} $x_1$\footnote{n}", "## A\nb $x_1$"),
        ("**a** ~~b~~ [c](http://d) `e`", "a b c e"),
        ("x &amp;lt; &nbsp;&quot;", 'x &lt;  "'),
        ("a < b > c * d", "a < b > c * d"),
        ("", ""),
        (None, None),
    ],
)
def test_clean(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = markup.clean_texts(df, ["id"], "t").first().clean_text
    assert (got and got.replace("\n\n\n", "\n\n")) == expected


def test_markup_empty_and_long(spark):
    df = spark.createDataFrame([(1, "s", LONG + "<b>x</b>"), (2, "s", "<b>y</b>")], "id bigint, source string, text string")
    assert markup.pieces_of_markup(df.limit(0), ["id"], "source", "text").count() == 0
    assert {x.id for x in markup.pieces_of_markup(df, ["id"], "source", "text").collect()} == {1, 2}


# 3 twins


def _form(t):
    out = unicodedata.normalize("NFKC", "".join(c for c in t if unicodedata.category(c) != "Cf"))
    folded = unicodedata.normalize("NFKD", out)
    return unicodedata.normalize("NFC", "".join(twins.LIKE.get(c, c) for c in folded))


def test_forms_against_the_standard_library(spark):
    r = random.Random(4)
    alphabet = "aeoAB éüñ ｅ１ﬁ⼀了а е о̣́̈​  сΟ文字각，."
    values = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(500)]
    values = [v.replace("，", "") for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, t string")
    got = {x.id: x.folded for x in twins.fold_texts(df, ["id"], "t").collect()}
    for i, v in enumerate(values):
        if v:
            assert unicodedata.normalize("NFD", got[i]) == unicodedata.normalize("NFD", _form(v)), v
            assert len(got[i]) <= len(unicodedata.normalize("NFD", got[i]))


def test_pairs(spark):
    base = "The old printer measured once more the broken seal of 1900."
    variants = [base, base, base.replace("e", "е", 1), base.replace(" ", " ", 1), base.replace("T", "Ｔ"), base.replace("o", "​o", 1)]
    others = [base.lower(), base.replace("0", "1"), base.replace("e", "é", 1), base.replace(".", "!"), "short", "ѕhort", None, ""]
    df = spark.createDataFrame([(i, "t", v) for i, v in enumerate(variants + others)] + [(100, "u", variants[2])], "row_id bigint, src_table string, text string").withColumn("form", F.lit(0))
    got = {(x.row_id_a, x.row_id_b) for x in twins.twins(df, "src_table", "row_id", "text").collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(6), 2) if (a, b) != (0, 1)}
    assert twins.twins(df.limit(0), "src_table", "row_id", "text").count() == 0


def test_canonical_text(spark):
    df = spark.createDataFrame([(1, "Пoсле обeда"), (2, None), (3, ""), (4, "раgе"), (5, "ёлка́")], "id int, t string")
    got = {x.id: x.form for x in twins.canonical(df, ["id"], "t").collect()}
    assert got == {1: "После обеда", 2: None, 3: "", 4: "page", 5: unicodedata.normalize("NFC", "ёлка́")}


def test_invisible_characters_of_the_last_plane_and_classes(spark):
    text = "The quiet river turns below the old mill every evening"
    rows = [(1, text), (2, text.replace("r", "r\U000e0100", 1)), (3, text + "\U000e0041"), (4, text), (5, text + "!"), (6, None), (7, "short")]
    df = spark.createDataFrame([("t", i, x) for i, x in rows], "tab string, id bigint, text string")
    pairs = {(x.row_id_a, x.row_id_b) for x in twins.twins(df, "tab", "id", "text").collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    got = {x.id: (x.texts, x.rows, x.links) for x in twins.twin_classes(df, "tab", "id", "text").collect()}
    assert got == {1: (3, 4, 2), 4: (3, 4, 2), 2: (3, 4, 3), 3: (3, 4, 3)} and sum(x[2] for x in got.values()) == 2 * len(pairs)


# 5 truncation


def test_cut_texts(spark):
    sentence = "The owner of the mill sold the first printed volume without regret. "
    # the corpus shows which lines are no sentences
    lines = "Chapter 2: D and e of F\n\n第二章 名字\n\n— 5 —\n\n—— Other\n\n- one\n- two\n\n| c | d |\n\n"
    whole = [lines + sentence * k for k in range(1, 40)]
    texts = whole + [sentence * 4 + "The owner of the mi", sentence + "The owner of the mill sold", sentence + "\n第一章 开始", sentence + "\n— 12 —", sentence + "\n\nChapter 3: A and b of C", sentence + "\n—— Name", sentence + "\n- item", sentence + "The ow�", "[第1-2页识别失败]", "", None, "x", sentence + "\n| a | b |", LONG + "The owner of"]
    df = spark.createDataFrame([(i, "s" if i % 2 else None, t) for i, t in enumerate(texts)], "call_id bigint, source string, content string").withColumn("text", F.lit(1))
    judged = truncation.judge(df)
    cut = {x.call_id for x in judged.where("is_cut").collect()}
    n = len(whole)
    assert cut == {n, n + 1, n + 7, n + 13} | ({n + 11} & cut)
    report = {x.source: (x.calls, x.cut_calls) for x in truncation.per_source(judged).collect()}
    assert sum(c for _, c in report.values()) == len(cut) and set(report) == {"", "s"}
    assert truncation.judge(df.limit(0)).count() == 0
    # without a corpus that shows them they are taken for cut texts, with the trigrams switched off nothing is
    alone = truncation.judge(df.where(f"call_id < 0 OR call_id >= {n}"))
    assert alone.where("closing").count() == 0 and alone.where("is_cut AND terminal_rate IS NULL").count() == 0


def test_cut_texts_with_a_mark_and_copies(spark):
    """An ellipsis that stands only at ends is no end; a cut text that holds a third of all rows is cut every time."""
    sentence = "The owner of the mill sold the first printed volume without regret. "
    texts = [sentence * k for k in range(1, 61)] + [sentence + "The owner of the mi..."] * 3 + [sentence + "The owner of the first pri"] * 30 + [sentence + "Who knows…", sentence + "Well… yes. " + sentence, "So… no. " + sentence]
    df = spark.createDataFrame(list(enumerate(texts)), "call_id bigint, content string").withColumn("source", F.lit("s"))
    cut = {x.call_id for x in truncation.judge(df).where("is_cut").collect()}
    assert cut == set(range(60, 93))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_trigrams_decide(spark):
    """On the tables: texts that end inside a word or sentence, told by a plain rule that the operator doesn't have."""
    calls = spark.read.parquet("/root/testdata/sf0.01/llm_ocr.parquet")
    judged = {x.call_id: x for x in truncation.judge(calls).collect()}
    open_end = {x.call_id for x in calls.where(r"content rlike '([\\p{L},，]|[^.]\\.\\.\\.)\\s*\\z' AND NOT element_at(split(rtrim(content), '\\n'), -1) rlike '^(——|[A-ZГ][a-zа-яíé]+ [0-9１-９]+:|第.{1,3}章)'").collect()}
    found = {i for i, x in judged.items() if x.is_cut}
    assert len(open_end) > 50 and len(found & open_end) >= 0.97 * len(open_end) and len(found - open_end) <= 0.1 * len(found)
    # all that the trigrams pass would be suspects without them
    assert sum(x.terminal_rate is not None and x.terminal_rate >= truncation.TERMINAL_RATE for x in judged.values()) > 5 * len(found)


# 6 recurring lines


def test_lines_against_brute_force(spark):
    r = random.Random(6)
    pool = [f"line number {i} of this small site is long" for i in range(30)]
    rows = []
    for b in range(1500):
        source = "hot" if b % 3 == 0 else f"s{b % 7}"
        text = "\n".join(r.choice([r.choice(pool[:4]).upper() + " 12", r.choice(pool), "short", f"— {r.choice(pool)} {r.randint(0, 99)} —", f"unique {b} text of this block alone {r.random()}"]) for _ in range(3))
        rows.append((b, source, f"{source}-{r.randint(0, 60)}", r.choice([text, text, None, ""])))
    df = spark.createDataFrame(rows, "block_id bigint, source string, job_id string, t string").withColumn("norm", F.lit(0))
    import re

    def norm(line):
        return re.sub(r"^[\W_]+|[\W_]+$", "", re.sub(r"\d+", "0", line.lower()))

    jobs, seen, places = {}, {}, []
    for b, s, j, t in rows:
        jobs.setdefault(s, set()).add(j)
        for i, line in enumerate((t or "").split("\n") if t is not None else [], 1):
            if len(line) >= 20:
                seen.setdefault((s, norm(line)), set()).add(j)
                places.append((b, i, s, norm(line)))
    good = {k for k, v in seen.items() if len(v) >= 4 and len(v) * 20 >= len(jobs[k[0]])}
    confirmed, found = lines.excessive(df, F.col("block_id"), F.col("source"), F.col("job_id"), F.col("t"))
    assert {(x.source, x.norm) for x in confirmed.collect()} == good and good
    assert sorted((x.row_id, x.line_no) for x in found.collect()) == sorted((b, i) for b, i, s, k in places if (s, k) in good)
    cleaned = {x.block_id: x.clean_text for x in lines.remove(df.select("block_id", "source", "t"), "source", "t", confirmed).collect()}
    for b, s, _, t in rows:
        assert cleaned[b] == (None if t is None else "\n".join(x for x in t.split("\n") if len(x) < 20 or (s, norm(x)) not in good))


def test_lines_beyond_a_sketch(spark, monkeypatch):
    rows = [(i, None if i % 2 else "s", f"j{i % 9}", f"the same long line of a site\nanother long line number {i} of text {'x' * (i % 7)}") for i in range(90)]
    df = spark.createDataFrame(rows, "block_id bigint, source string, job_id string, t string")
    columns = [F.col(c) for c in ("block_id", "source", "job_id", "t")]
    sketched = sorted(map(tuple, lines.excessive(df, *columns)[1].collect()))
    monkeypatch.setattr(lines, "MOST_COUNTERS", 1)
    assert sketched == sorted(map(tuple, lines.excessive(df, *columns)[1].collect())) and len(sketched) >= 90


def test_lines_are_split_and_normalised_once_a_pass(spark):
    rows = [(i, "s", f"j{i % 9}", f"the same long line of a site\nanother long line {'x' * i} of text") for i in range(90)]
    df = spark.createDataFrame(rows, "block_id bigint, source string, job_id string, t string")
    columns = [F.col(c) for c in ("block_id", "source", "job_id", "t")]
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert plan(lines.long_lines(df, *columns).withColumn("h", F.xxhash64("norm"))).count("Nd}") == 1
    # the lines that were counted exactly are at hand for their places
    confirmed, found = lines.excessive(df, *columns)
    assert "Generate" not in plan(found) and found.count() == 90 and [x.norm for x in confirmed.collect()] == ["the same long line of a site"]


def test_null_texts_do_not_lower_the_number_of_lines(spark):
    df = spark.createDataFrame([("s", "a", "x" * 20 + "\n" + "y" * 30)] + [("s", "a", None)] * 5, "source string, job_id string, t string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            assert [(x.jobs, x.lines) for x in lines.sources_of(df, F.col("source"), F.col("job_id"), F.col("t")).collect()] == [(1, 2)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_ends_of_lines_as_in_sql(spark, tmp_path):
    import duckdb

    edges = ["a" * 19 + "\r\r", "b" * 19 + "\r", "c" * 20 + "\r", "d" * 19 + "\r\u2028", "e" * 18 + "\u0085\u2029", "-- " + "f" * 20 + " \u2028.", "\u00b2" * 9 + "\u2028" + "g" * 12, "-" * 30, "\u0661\u0662" + "h" * 20]
    rows = [(i, "s", f"j{i % 9}", "\n".join(edges[k] for k in range(len(edges)) if (i + k) % 3)) for i in range(60)]
    spark.createDataFrame(rows, "block_id bigint, source string, job_id string, block_content string").write.parquet(str(tmp_path / "parsing_res_list.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW parsing_res_list AS SELECT * FROM read_parquet('{tmp_path}/parsing_res_list.parquet/*.parquet')")
    for name in ("p6_found", "p6_lines", "p6_clean"):
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(queries.ORACLE[name]).fetchall()) and len(got) > 5


def test_lines_without_rows(spark):
    df = spark.createDataFrame([], "block_id bigint, source string, job_id string, t string")
    confirmed, found = lines.excessive(df, F.col("block_id"), F.col("source"), F.col("job_id"), F.col("t"))
    assert confirmed.count() == found.count() == 0


# 7 scan noise


def _reachable(word, entry, edits):
    """Whether an entry may be read as a word, by trying every edit at every place."""
    if word == entry:
        return 0
    best, todo, seen = None, [(entry, 0)], {entry}
    while todo:
        w, e = todo.pop(0)
        if w == word:
            return e
        if e == edits:
            continue
        nexts = [w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in scan_noise._NEAR.get(w[i], "")]
        for one, more in scan_noise.PAIRS:
            nexts += [w[:i] + more + w[i + len(one) :] for i in range(len(w)) if w.startswith(one, i)]
            nexts += [w[:i] + one + w[i + len(more) :] for i in range(len(w)) if len(more) == 2 and w.startswith(more, i)]
        for x in nexts:
            if x not in seen:
                seen.add(x)
                todo.append((x, e + 1))
    return best


def test_automaton_finds_what_one_edit_reaches():
    r = random.Random(8)
    entries = sorted({"".join(r.choice("etcfhbumrnwil") for _ in range(r.randint(3, 6))) for _ in range(120)})
    trie = scan_noise.Trie([(e, 5) for e in entries])
    for _ in range(150):
        w = r.choice(entries)
        if r.random() < 0.7:
            i = r.randrange(len(w))
            w = w[:i] + r.choice(["c", "f", "rn", "ii", "vv", "b", "m"]) + w[i + 1 :]
        got = {v for v, e, _ in scan_noise.candidates(trie, w, 1)}
        assert got == {e for e in entries if _reachable(w, e, 1) == 1}


def _scan_tables(spark, texts):
    rows = [("t", i, "j", x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "src_table string, row_id bigint, job_id string, text string").withColumn("word", F.lit(1))
    jobs = spark.createDataFrame([("j", "Ann and the map of Bob"), ("k", None)], "job_id string, title string")
    blocks = spark.createDataFrame([("j", "header", "Ann and the map of Bob")], "job_id string, block_label string, block_content string")
    return df, jobs, blocks


def test_scan_noise(spark):
    clean = ["The keeper of the archive never mentioned the broken seal before the harvest began, while others kept silent."] * 40
    noisy = [
        "The keeper of the arch-\nive never mentioned the seal.",
        "The kceper never ment1oned the br0ken seal before the harvest began.",
        "The keeper of the archive\nANN AND THE MAP OF BOB // 12\nnever mentioned the seal.",
        "The keeper never mentioned\n— 12 —\nthe broken seal.",
        "The ke□per never mentioned the seal.",
    ]
    fine = ["The keeper\nof the archive.", "Ann and the map of Bob", "58", "years 1914-\n1918 are lost", "====================\n第 1 页 (共 2 页)\n====================\n\nThe keeper.", None, "", "A model B2-201 and MP3."]
    df, jobs, blocks = _scan_tables(spark, clean + noisy + fine)
    flags = {x.row_id for x in scan_noise.inspected(df, jobs, blocks).where("broken + blots + misread + heads + numbers > 0").collect()}
    assert flags == set(range(len(clean), len(clean) + len(noisy)))
    fixed = {x.row_id: x.repaired for x in scan_noise.repaired(df, jobs, blocks).collect()}
    n = len(clean)
    assert fixed[n] == "The keeper of the archive never mentioned the seal."
    assert fixed[n + 1] == "The keeper never mentioned the broken seal before the harvest began."
    assert fixed[n + 2] == "The keeper of the archive never mentioned the seal."
    assert fixed[n + 3] == "The keeper never mentioned the broken seal."
    assert fixed[n + 10] is None and fixed[n + 11] == ""


def test_words_of_any_case_and_length_are_looked_up(spark, monkeypatch):
    """Capitalised words as others are; short ones, and names two edits away, by what stands after the word before them."""
    good = "Der Hüter des Archivs fand das Siegel neben der Truhe."
    texts = [good] * 40 + [good.replace(*x) for x in (("Archivs", "Arcbivs"), ("Hüter", "Hüfer"), ("neben der", "neben dcr"), ("Der", "Dcr"))]
    texts += ["Ein det stand dort.", "Hüfcr kamen. Maier, Truhen B2-201 und MP3.", good.replace("Hüter", "Hüfcr")]
    df, jobs, blocks = _scan_tables(spark, texts)
    misread = [40, 41, 42, 43, 46]
    for most in (400_000, 0):
        monkeypatch.setattr(scan_noise, "MOST_CORRECTIONS", most)
        assert sorted(x.row_id for x in scan_noise.inspected(df, jobs, blocks).where("misread > 0").collect()) == misread
        fixed = {x.row_id: x.repaired for x in scan_noise.repaired(df, jobs, blocks).collect()}
        assert [fixed[i] for i in range(len(texts))] == [good if i in misread else x for i, x in enumerate(texts)]


def test_words_broken_twice_and_texts_without_a_gap():
    assert scan_noise.words_of("the arch-\niv-\r\n ist - and\nthe ﬁle x-1 http://a.b/c") == ["the", "archivist", "and", "the", "file", "x", "1"]
    assert scan_noise.words_of("Hüter-\nin ab_cd") == ["Hüterin", "ab", "cd"]
    began = time.process_time()
    assert scan_noise.words_of("ab" * 30_000) == ["ab" * 30_000]
    assert time.process_time() - began < 1  # in proportion to the text


def test_triples_against_the_pattern():
    r = random.Random(4)
    texts = ["".join(r.choice("的在了，。：a \r\t\u3005\U00020000\u2028é") for _ in range(r.randint(0, 60))) for _ in range(300)]
    keys = frozenset(r.choice("的在了，。") + r.choice("的在了，。：") for _ in range(9))
    counter = scan_noise.TripleCounter(keys)
    for part in (texts[:100], [], texts[100:]):
        counter.update(part)
    expected = {}
    for t in (t for text in texts for t in scan_noise._TRIPLE.findall(text)):
        if t[0] + t[2] in keys:
            expected[t] = expected.get(t, 0) + 1
    assert expected and dict(counter.strings()) == expected
    counter = scan_noise.TripleCounter(())
    counter.update(texts)
    assert counter.strings() == []


def test_texts_without_dense_scripts_are_not_searched_for_suspects(monkeypatch):
    contexts = {"我书": ("的", 90, 90), "我者": ("在", 90, 90)}
    count = lambda text: scan_noise.inspect(text, [], {}, frozenset(), contexts)[2]
    # a blot is none of the misread characters; a context of another character proves nothing
    assert [count(x) for x in ("我旳书", "我旳\n书，我旳书", "我旳者", "我■书", "我的书")] == [1, 2, 0, 0, 0]
    monkeypatch.setattr(scan_noise, "_SUSPECT", None)
    assert count("Füße und “Wörter” — ещё") == 0


def test_words_are_split_alike_with_and_without_dense_scripts():
    for text in ("Grüße_an d’été x2 ещё_раз", "naïve \u0660\u0661 ﬁn \U00010400b ª", "_", "é\u200bt\u00e9 s\u0327a"):
        assert scan_noise.words_of(text + " ab。") == [*scan_noise.words_of(text + " ab")]


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    texts = ["The keeper never mentioned the broken seal before."] * 30 + ["The kceper never mentioned."]
    df, jobs, blocks = _scan_tables(spark, texts)
    monkeypatch.setattr(scan_noise, "MOST_CORRECTIONS", 0)
    assert [x.row_id for x in scan_noise.inspected(df, jobs, blocks).where("misread > 0").collect()] == [30]


def test_contexts_beyond_the_broadcast_bound(spark, monkeypatch):
    common, rare = "山中有一座古老的寺庙。", "河边种着许多杨柳树。"
    texts = [common] * 40 + [common.replace("古", "□")] * 3 + [rare] * 9 + [rare.replace("柳", "□")]
    df, jobs, blocks = _scan_tables(spark, [*texts, None])
    for most in (300_000, 1, 0):
        monkeypatch.setattr(scan_noise, "MOST_CONTEXTS", most)
        fixed = {x.row_id: x.repaired for x in scan_noise.repaired(df, jobs, blocks).collect()}
        assert [fixed[i] for i in range(len(texts))] == [common] * 43 + [rare] * 10
        assert len(fixed) == len(texts) + 1 and fixed[len(texts)] is None


def test_misread_characters_without_a_blot(spark, monkeypatch):
    good = "这是他们的山中小屋。"
    texts = [good] * 30 + [good.replace("的", "旳"), good.replace("的", "\n旳"), "旳确如此说过了。"]
    df, jobs, blocks = _scan_tables(spark, texts)
    for most in (300_000, 0):
        monkeypatch.setattr(scan_noise, "MOST_CONTEXTS", most)
        assert sorted(x.row_id for x in scan_noise.inspected(df, jobs, blocks).where("misread > 0").collect()) == [30, 31]


def test_neighbours_beyond_the_broadcast_bound(spark, monkeypatch):
    # "bcar" may be "hear" or "bear": the commoner word is wrong after "brown"
    texts = ["They never hear anything today."] * 200 + ["That brown bear slept today."] * 100 + ["That brown bcar slept today.", "They never bcar anything today."]
    df, jobs, blocks = _scan_tables(spark, texts)
    known = [("bcar", 2, [(1, 200, "hear"), (1, 100, "bear")])]
    schema = "word string, texts bigint, entries array<struct<edits:int,texts:bigint,entry:string>>"
    monkeypatch.setattr(scan_noise, "_known", lambda rows: spark.createDataFrame(known, schema))
    for most in (400_000, 1, 0):
        monkeypatch.setattr(scan_noise, "MOST_CORRECTIONS", most)
        fixed = {x.row_id: x.repaired for x in scan_noise.repaired(df, jobs, blocks).collect()}
        assert [fixed[i] for i in range(len(texts))] == texts[:300] + ["That brown bear slept today.", "They never hear anything today."]


# 8 leakage


def test_blocks_find_all_within_the_radius():
    import numpy as np

    r = np.random.default_rng(3)
    index = leakage.ItemIndex([(i, " ".join(f"w{int(x)}" for x in r.integers(0, 4000, 60))) for i in range(30)])
    (size, (own, _, _, _)), *_ = index.by_size.items()
    probes = []
    for fp in own[:200]:
        for flips in (0, 3, 7, 8, 12):
            bits = r.choice(64, flips, replace=False)
            probes.append(int(fp) ^ sum(1 << int(b) for b in bits))
    probes = np.array(probes, dtype=np.uint64)
    window, item_window, distance = index.candidates(probes, size)
    got = set(zip(window.tolist(), item_window.tolist()))
    every = np.bitwise_count(probes[:, None] ^ own[None, :])
    assert got == {(int(a), int(b)) for a, b in np.argwhere(every <= leakage.RADIUS)}


def test_fingerprints_in_lanes(monkeypatch):
    import numpy as np

    r = random.Random(8)
    words = [f"w{r.randint(0, 300)}" for _ in range(900)]
    items = [(i, " ".join(words[60 * i : 60 * i + 60])) for i in range(5)]
    for scale, lane in ((leakage.WEIGHT_SCALE, 16), (9_000, 32)):
        monkeypatch.setattr(leakage, "WEIGHT_SCALE", scale)
        index = leakage.ItemIndex(items)
        hashes = leakage.hash_tokens(words, leakage.TokenHashes())
        sums = index.sums(hashes)
        # 64 counters of four bytes before
        assert index.lane == lane and sums.nbytes <= (136 if lane == 16 else 264) * (len(words) + 1)
        weight = dict(zip(index.keys.tolist(), index.weights.tolist()))
        weights = [weight.get(h, round(index.other * scale)) for h in hashes.tolist()]
        for size in (3, 20, 25):
            starts = np.arange(0, len(words) - size, 7)
            for at, got in zip(starts.tolist(), index.fingerprints(sums, size, starts).tolist()):
                part = list(zip(hashes.tolist()[at : at + size], weights[at : at + size]))
                assert got == sum(1 << b for b in range(64) if sum(w if h >> b & 1 else -w for h, w in part) > 0)


def test_tokens_of_ascii_and_other_text():
    assert tokens("Abc12_d\u00e9f GH-\n ij\u4e2d\u65876x") == ["abc", "12", "d\u00e9f", "ghij", "\u4e2d", "\u6587", "6", "x"]
    assert tokens("Abc12_dEf GH- \r\n ij 6x 7-\n8") == ["abc", "12", "def", "ghij", "6", "x", "7", "8"]


def test_half_an_item_with_changed_words_in_one_stretch(spark):
    word = lambda kind, i: f"{kind}{chr(97 + i // 10)}{chr(97 + i % 10)}"
    item = [word("item", i) for i in range(80)]
    half = [word("changed", i) if i in (8, 17, 25, 33) else w for i, w in enumerate(item[:40])]
    scattered = [word("other", i) if i % 20 >= 9 else w for i, w in enumerate(item)]
    fill = [word("fill", i) for i in range(60)]
    docs = [(1, " ".join(fill + half + fill)), (2, " ".join(fill + scattered + fill)), (3, " ".join(fill + item[:30] + fill))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(word("else", i) for i in range(80)))], "item_id bigint, text string")
    got = leakage.leaks(df, F.col("doc_id"), F.col("text"), it).collect()
    assert [(x.doc_id, x.item_id) for x in got] == [(1, 7)] and 0.36 <= got[0].item_share < 0.47
    index = leakage.ItemIndex([(7, " ".join(item))])
    assert index.verify(docs[0][1].split(), 7, 60) > 0.4 and index.verify(docs[1][1].split(), 7, 60) == 0


def test_leaks(spark):
    r = random.Random(10)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("ana", "oru", "ilt", "ex")] + [f"word{i}" for i in range(400)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, make(80)) for i in range(12)] + [(50, "tiny"), (51, None)]
    text = dict(items)

    def noisy(s):
        return " ".join("changed" if r.random() < 0.08 else w for w in s.split())

    half = " ".join(text[1].split()[:48])
    fifth = " ".join(text[2].split()[:15])
    banner = "\n====================\n批次 3 (共 4 批)\n====================\n"
    docs = [
        (0, make(300)), (1, make(100) + " " + text[0] + " " + make(50)), (2, make(60) + " " + half), (3, make(200) + " " + fifth), (4, noisy(text[3]).upper() + make(80)),
        (5, banner.join([" ".join(text[4].split()[:40]), " ".join(text[4].split()[40:])])), (6, text[5] + " " + make(20) + " " + text[6]), (7, None), (8, ""), (9, "tiny"), (10, text[0]), (10, text[0]),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(9))
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((x.doc_id, x.item_id) for x in leakage.leaks(df, F.col("doc_id"), F.col("text"), it).collect())
    assert got == [(1, 0), (2, 1), (4, 3), (5, 4), (6, 5), (6, 6), (10, 0), (10, 0)]
    long = " ".join(["filler words of no item"] * 12_000)
    far = spark.createDataFrame([(1, long + " " + text[7] + " " + long), (2, long)], "doc_id bigint, text string")
    assert [(x.doc_id, x.item_id) for x in leakage.leaks(far, F.col("doc_id"), F.col("text"), it).collect()] == [(1, 7)]
    assert leakage.leaks(df.limit(0), F.col("doc_id"), F.col("text"), it).count() == 0
    assert leakage.leaks(df, F.col("doc_id"), F.col("text"), it.limit(0)).count() == 0


def test_blocks_of_items_and_short_items(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(r.choice(words) for _ in range(n)) for i, n in enumerate((6, 8, 11, 15, 40, 90))}
    docs = [(i, " ".join(r.choice(words) for _ in range(60)) + " " + t + " " + " ".join(r.choice(words) for _ in range(60))) for i, t in texts.items()]
    docs += [(10 + i, " ".join(r.choice(words) for _ in range(120))) for i in range(5)]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(texts.items()), "item_id bigint, text string")
    once = sorted(tuple(x) for x in leakage.leaks(df, F.col("doc_id"), F.col("text"), it).collect())
    assert [x[:2] for x in once] == [(i, i) for i in texts] and all(x[2] == 1.0 for x in once)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 1)
    assert sorted(tuple(x) for x in leakage.leaks(df, F.col("doc_id"), F.col("text"), it).collect()) == once


# 9 mixture


def test_mixture(spark):
    r = random.Random(12)
    docs = [(i, "hot" if i % 3 == 0 else r.choice(["b", "c", "other", None]), " ".join("word" for _ in range(r.randint(1, 60)))) for i in range(3000)]
    docs += [(5000, "b", None), (5001, "b", ""), (5002, "b", LONG)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("copies", F.lit(0))
    targets = spark.createDataFrame([("hot", 0.08, 1), ("b", 0.8, 1), ("c", 0.07, 3), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")
    chosen, report = mixture.mix(df, F.col("doc_id"), F.col("text"), F.col("source"), targets)
    rows = {x.source: x for x in report.collect()}
    biggest = max(x.n_tokens for x in chosen.where("source in ('hot', 'c')").collect())
    for name in ("hot", "c"):
        assert abs(rows[name].reached_tokens - rows[name].target_tokens) <= biggest
    assert rows["none"].reached_tokens == 0 and rows["b"].most_copies <= 1
    per_source = {x.source: x["t"] for x in chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    assert per_source == {k: v.reached_tokens for k, v in rows.items() if v.reached_tokens}
    limits = {"hot": 1, "b": 1, "c": 3}
    assert all(1 <= x.copies <= limits[x.source] for x in chosen.collect())
    again, _ = mixture.mix(df.repartition(7), F.col("doc_id"), F.col("text"), F.col("source"), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))
    _, empty = mixture.mix(df.limit(0), F.col("doc_id"), F.col("text"), F.col("source"), targets)
    assert [x.reached_tokens for x in empty.collect()] == [0] * 4


def test_token_counts_round_trip(spark):
    import base64

    import tiktoken

    with open(mixture.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=mixture.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "", None, "中文 text", "<|endoftext|>", " x\n\n y"]
    got = [x.n_tokens for x in mixture.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), F.col("t")).orderBy("i").collect()]
    for t, n in zip(texts, got):
        assert n == (len(encoding.encode_ordinary(t)) if t else 0)
        assert t is None or encoding.decode(encoding.encode_ordinary(t)) == t


# 10 language


def _samples(spark):
    return [(x.lang, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").orderBy("sample_id").collect()]


def test_held_out_accuracy(spark):
    samples = _samples(spark)
    by_lang = {}
    for lang, text in samples:
        by_lang.setdefault(lang, []).append(text)
    fit = [(k, t) for k, v in by_lang.items() for t in v[:35]]
    held = [(k, t) for k, v in by_lang.items() for t in v[35:]]
    c = language.Classifier(fit)
    right = sum(c.best(t)[0] == k for k, t in held)
    assert right / len(held) >= 0.98


def test_documents_and_segments(spark):
    by_lang = {}
    for lang, text in _samples(spark):
        by_lang.setdefault(lang, []).append(text)
    en, fr, zh = ("".join(f"{t} " for t in by_lang[k][:4]) for k in ("en", "fr", "zh"))
    one_fr = by_lang["fr"][9].split(". ")[0] + "."
    docs = [
        (1, en, "en"), (2, en, "EN-us"), (3, en, "eng"), (4, en, None), (5, en, "und"), (6, en, "fr"), (7, en + "\n\n" + fr, "en"), (8, en + zh + en, "English"),
        (9, None, "en"), (10, "", None), (11, "12345 !!", None), (12, en * 300, "en"), (6, en, "fr"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("label", F.lit("x"))
    classified = language.documents(df, F.col("doc_id"), F.col("text"), F.col("lang"), _samples(spark))
    got = sorted((x.doc_id, x.lang_code) for x in language.relabelled(classified).collect())
    assert got == [(4, "en"), (5, "en"), (6, "en"), (6, "en"), (7, "en"), (7, "fr"), (8, "en"), (8, "zh")]
    by_id = {x.doc_id: x for x in classified.collect()}
    assert by_id[9].lang_code is None and by_id[9].confidence == 0 and by_id[1].confidence > 0.3
    found = language.segments(df, F.col("doc_id"), F.col("text"), _samples(spark)).where("doc_id = 8").orderBy("segment").collect()
    assert [x.lang_code for x in found] == ["en", "zh", "en"]
    quoted = language.Classifier(_samples(spark)).segments(en + one_fr + " " + en)
    assert {s[2] for s in quoted if s[1] >= 2} == {"en"}


def test_groups_change_nothing(spark, monkeypatch):
    samples = _samples(spark)
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if x.text]
    c = language.Classifier(samples)
    grouped = [{s[2] for s in c.segments(t) if s[1] >= 2} for t in texts]
    monkeypatch.setattr(language, "CLEAR", 9.0)
    assert grouped == [{s[2] for s in c.segments(t) if s[1] >= 2} for t in texts]
