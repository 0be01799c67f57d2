import json
import random
from difflib import SequenceMatcher
from statistics import median

import pytest
from pyspark.sql import functions as F

from quirefold.functions import sqlfuncs
from quirefold.operators import align, batches, jobs, layout, metadata, nesting, registry
from quirefold.plans import pipeline
from quirefold.sources import connectors, files, payloads


def _tree(r, depth=0):
    kind = r.choice(["leaf", "dict", "list", "pages", "blocks"]) if depth < 5 else "leaf"
    if kind == "dict":
        return {r.choice("abcd"): _tree(r, depth + 1) for _ in range(r.randint(0, 3))}
    if kind == "list":
        return [_tree(r, depth + 1) for _ in range(r.randint(0, 3))]
    if kind == "pages":
        return {"layoutParsingResults": [r.choice([None, {}, {"prunedResult": {"parsing_res_list": [r.choice([None, {"x": [1]}, 3]) for _ in range(3)]}}]) for _ in range(r.randint(0, 3))]}
    if kind == "blocks":
        return {"parsing_res_list": [None, {"block_bbox": [1, 2, 3, 4]}]}
    return r.choice([1, "x", None, True])


def _expected(value):
    """page and block numbers by plain recursion."""
    pages, out = [], []

    def walk(node, name, page):
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, k, page)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                inner = page
                if name == nesting.PAGE_LIST and page is None:
                    inner = len(pages)
                    pages.append(v)
                if name == nesting.BLOCK_LIST and v is not None:
                    out.append((page or 0, i))
                walk(v, None, inner)

    walk(value, None, None)
    return sorted(out)


def test_blocks_of_random_records(spark):
    r = random.Random(3)
    trees = [{"result": _tree(r)} for _ in range(300)]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)]
    df = spark.createDataFrame(rows, "record_id bigint, payload string")
    found = {}
    for x in nesting.block_positions(df, F.col("record_id"), F.col("payload")).collect():
        found.setdefault(x.record_id, []).append((x.page_no, x.block_no))
    assert {i: sorted(v) for i, v in found.items()} == {i: e for i, t in enumerate(trees) if (e := _expected(t))}


def test_intervals_nest():
    nodes = nesting.traverse(json.dumps({"a": [{"b": 1}, [2]], "c": None}))
    by_pre = {n[3]: n for n in nodes}
    for n in nodes:
        parent = by_pre.get(n[5])
        if parent:
            assert parent[3] < n[3] and n[4] < parent[4]
    assert sorted(n[4] for n in nodes) == list(range(len(nodes)))


def test_odd_payloads(spark):
    deep = "[" * 3000 + "]" * 3000
    values = [None, "", "{", "null", "NaN", '{"a": NaN}', "[]", '{"parsing_res_list": null}', '[{"parsing_res_list": [null, 1]}, null, {"prunedResult": {"parsing_res_list": [{}]}}]', deep]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], "record_id bigint, payload string, pre int")
    got = [tuple(x) for x in nesting.block_positions(df, F.col("record_id"), F.col("payload")).orderBy("record_id", "page_no").collect()]
    assert got == [(8, 0, 1), (8, 2, 0)]
    tables = nesting.flat_tables(df, F.col("record_id"), F.col("payload"))
    assert [x.valid for x in tables["records"].orderBy("record_id").collect()][:6] == [False, False, False, True, False, False]
    assert nesting.block_positions(df.limit(0), F.col("record_id"), F.col("payload")).count() == 0


def test_boxes_know_their_block(spark):
    payload = json.dumps({"parsing_res_list": [{"block_bbox": [1, 2, 3, 4]}, {"block_bbox": []}, {"block_bbox": [5, 6, 7, 8]}]})
    df = spark.createDataFrame([(1, payload)], "record_id bigint, payload string")
    got = [(x.block_no, x.coordinates) for x in nesting.flat_tables(df, F.col("record_id"), F.col("payload"))["boxes"].orderBy("pre").collect()]
    assert got == [(0, [1, 2, 3, 4]), (2, [5, 6, 7, 8])]


def test_gaps_against_plain_rule(spark):
    r = random.Random(5)
    rows = []
    for page in range(120):
        for b in range(r.randint(0, 9)):
            y = r.choice([0, 10, 20, 30, 40, 50, 300])
            rows.append((page, page * 10 + b, r.choice([None, "text", "header"]), r.choice([None, [0.0, float(y), 1.0, float(y + r.choice([0, 5, 10]))], [1.0]]), r.choice(["a", " ", "<b> </b>", None, "long " * 30])))
    df = spark.createDataFrame(rows, "page int, id int, block_label string, block_bbox array<double>, block_content string")
    got = {(x.page, x.id) for x in layout.gaps(df, ["page"], "id").collect()}
    expected = set()
    for page in range(120):
        kept = sorted((x[3][1], x[1], x[3][3]) for x in rows if x[0] == page and x[2] != "header" and x[3] and len(x[3]) > 3 and x[4] and x[4].replace("<b>", "").replace("</b>", "").strip())
        spaces = [(b[0] - a[2], a[1]) for a, b in zip(kept, kept[1:])]
        if spaces:
            usual = median(s for s, _ in spaces) or sum(s for s, _ in spaces) / len(spaces) or 10
            expected |= {(page, i) for s, i in spaces if s > 4 * usual}
    assert got == expected and got


def test_overlaps_of_rows_and_of_text_agree(spark):
    from quirefold.functions import text as T

    r = random.Random(9)
    rows, texts = [], []
    for doc in range(200):
        parts = ["".join(r.choice("ab \n") for _ in range(r.randint(0, 50))) for _ in range(4)]
        parts = [p + (parts[i + 1][:35] if i < 3 and r.random() < 0.5 else "") for i, p in enumerate(parts)]
        rows += [(doc, i, p) for i, p in enumerate(parts)]
        texts.append((doc, "".join(f"==\n批次 {i} (共 4 批)\n==\n{p}\n" for i, p in enumerate(parts))))
    by_rows = batches.join_texts(batches.trim_overlaps(spark.createDataFrame(rows, "d int, b int, t string"), "d", "b", "t"), "d", "b", "trimmed")
    in_text = spark.createDataFrame(texts, "d int, t string").select("d", T.remove_overlaps(F.col("t")).alias("x")).where("x <> ''")
    assert {tuple(x) for x in by_rows.where("full_text <> ''").collect()} == {tuple(x) for x in in_text.collect()}


def test_latest_delivery(spark):
    df = spark.createDataFrame([("j", 1, 5, "old"), ("j", 1, 9, "new"), ("j", 2, 6, None), (None, 1, 7, "x")], "job string, b int, id int, t string")
    assert {(x.job, x.b, x.t) for x in batches.latest(df, ["job", "b"], ["id"]).collect()} == {("j", 1, "new"), ("j", 2, None), (None, 1, "x")}


def _dice(a, b):
    pairs = lambda x: {x[i : i + 2] for i in range(max(1, len(x) - 1))}
    x, y = pairs(a), pairs(b)
    return 1.0 if a == b else (1 + 2 * len(x & y) / (len(x) + len(y))) / 2


def test_places_against_all_windows(spark):
    """Every window of every text is scored here; the place that the anchor was taken from is found, and none scores much better."""
    r = random.Random(11)
    words = ["river", "ledger", "очень", "старый", "图书", "馆在山", "harbour", "clerk", "1849", "rope"]
    texts, anchors, best = [], [], {}
    for d in range(40):
        text = " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(r.choice((5, 40, 400))))
        texts.append((d, text))
        for k in range(3):
            at = r.randrange(max(1, len(text) - 60))
            target = list(text[at : at + 60])
            for _ in range(r.randint(0, 4)):
                target[r.randrange(len(target))] = r.choice("abcxyz")
            target = "".join(target)
            anchors.append((d, k, target))
            scores = [(_dice(target, text[i : i + len(target)]), -i) for i in range(len(text) - len(target) + 1)]
            best[d, k] = (at, max(scores)[0]) if scores else None
    found = align.places(spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(anchors, "d int, k int, a string"), "d", "t", "k", "a", 0.75)
    got = {}
    for x in found.collect():
        got.setdefault((x.d, x.k), {})[x.start] = x.score
        assert dict(texts)[x.d][x.start + len(x.anchor) :].startswith(x.after)
    for key, top in best.items():
        if top and top[1] >= 0.85:
            place, score = max(got[key].items(), key=lambda x: (x[1], -x[0]))
            assert place == top[0] and top[1] - 0.05 <= score <= top[1] + 1e-12


def test_breaks_and_marks(spark):
    df = spark.createDataFrame([("abcdef", [4, 2, 4, -1, 99, 0])], "t string, p array<int>")
    assert df.select(align.insert_breaks(F.col("t"), F.col("p"))).first()[0] == "\nab\ncd\nef"
    marked = spark.createDataFrame([("abcd", [0, 2, 2])], "t string, p array<int>").select(align.insert_page_marks(F.col("t"), F.col("p"), 7)).first()[0]
    assert marked.count("<span") == 3 and marked.index('id="page7"') < marked.index("ab") < marked.index('id="page8"') < marked.index('id="page9"') < marked.index("cd")


def test_place_breaks(spark):
    text = "The end of the first part.\nThe second part starts here and goes on."
    texts = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 2000 + text)], "d int, t string").withColumn("score", F.lit(1))
    anchors = [(1, "first part.", "The second part"), (2, "frst part. of", "x"), (3, "x", "")]
    rows = [(d, 10 * d + k, a, b) for d in (1, 2, 3, 4) for k, a, b in anchors]
    rows += [(1, 101, "end of the fxrst part.", "The second part"), (1, 102, "first part.", "Nothing alike at all"), (1, 103, "", "The"), (1, 104, None, None), (1, 105, "The end of the first part.", ""), (1, 106, "goes", "on"), (1, 107, "here", None)]
    got = {x.k: x.place for x in align.place_breaks(texts, spark.createDataFrame(rows, "d int, k int, prev_tail string, next_head string"), "d", "t", "k").collect()}
    assert got[11] == got[101] == 26 and got[41] == 2026 and got[102] == got[103] == got[104] == got[21] == got[31] == got[12] == -1
    assert got[105] == 26 and got[106] == text.index(" on.") and got[107] == text.index(" and goes") and len(got) == len(rows)


def test_page_spans(spark):
    pages = ["first page text begins here and ends there", "second page text goes on for a while", "third page closes the whole matter now"]
    proof = "first page text begins\nhere and ends there\nsecond page text goes on\nfor a while third page closes the whole matter now"
    texts = spark.createDataFrame([(1, proof), (2, None), (3, "x")], "d int, t string")
    rows = spark.createDataFrame([(d, i, p) for d in (1, 2) for i, p in enumerate(pages)] + [(3, 0, None)], "d int, i int, p string")
    got = [tuple(x) for x in align.page_spans(texts, rows, "d", "t", "i", "p").orderBy("d", "i").collect()]
    assert [(d, i) for d, i, *_ in got] == [(1, 0), (1, 1), (1, 2), (3, 0)] and got[3][2:] == (0, 1)
    # line breaks make the match a similar one, which may be off by a letter
    assert abs(got[1][2] - proof.index("second")) <= 1 and abs(got[2][2] - proof.index("third")) <= 1 and got[2][3] == len(proof)
    flat = spark.createDataFrame([("ab\ncd\n",)], "t string").select(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: align.original_position(align.line_ends(F.col("t")), i)).alias("x")).first().x
    assert flat == [0, 1, 3, 4, 6]


def test_page_spans_of_refined_texts(spark, monkeypatch):
    """No test for nulls is pushed through the refinement (it took the driver 18 GB of expressions), and all anchors are placed in one search."""
    searches, cut, places = [], align.cut, align.places

    def checked(df):
        assert "isnotnull(refined" not in df._jdf.queryExecution().analyzed().toString()
        return cut(df)

    monkeypatch.setattr(align, "cut", checked)
    monkeypatch.setattr(align, "places", lambda *x: searches.append(x) or places(*x))
    pages = ["the first page of the ledger begins and ends here", "a second page of the ledger goes on for a while", "a third page closes the whole matter now"]
    texts = pipeline.refine(spark.createDataFrame([(1, "\n\n".join(pages)), (2, None), (3, "")], "d int, t string"), "t", "refined")
    rows = spark.createDataFrame([(d, i, p) for d in (1, 2) for i, p in enumerate(pages)] + [(3, 0, ""), (3, 1, None)], "d int, i int, p string")
    got = {(x.d, x.i): (x.start_pos, x.end_pos) for x in align.page_spans(texts, rows, "d", "refined", "i", "p").collect()}
    proof = texts.where("d = 1").first().refined
    starts = [proof.index(p) for p in pages]
    assert got == {(1, 0): (0, starts[0] + len(pages[0])), (1, 1): (starts[1], starts[1] + len(pages[1])), (1, 2): (starts[2], len(proof)), (3, 0): (0, 0), (3, 1): (0, 0)}
    assert len(searches) == 1


def test_metadata(spark):
    replies = ["no mark", "x\n---\ntitle: a\n", "---\ntitle: a\nauthor: b\n# c\n---\n\n rest", "", None, "---\nname: a\n---"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(replies)], "i int, r string").withColumn("s", metadata.split_reply(F.col("r")))
    rows = df.withColumn("v", metadata.validate(F.col("s.yaml"))).withColumn("n", metadata.field_count(F.col("s.yaml"))).orderBy("i").collect()
    assert [tuple(x.s) for x in rows] == [("", "no mark"), ("---\ntitle: a", ""), ("---\ntitle: a\nauthor: b\n# c\n---", "rest"), ("", ""), (None, None), ("---\nname: a\n---", "")]
    assert [x.v.hint for x in rows] == ["empty", "no author", "", "empty", None, "no title"]
    assert rows[2].n == 2


def test_jobs(spark):
    rows = [("a", "Running", 10, 5, 1, "2024-01-01 00:00:00"), ("a", "DONE", 10, 10, 2, "2024-01-01 00:01:00"), ("a", "running", 10, 6, 3, "2024-01-01 00:00:30"), ("b", None, None, None, 4, None)]
    df = spark.createDataFrame(rows, "job_id string, job_state string, total_pages int, extracted_pages int, poll_id bigint, t string").withColumn("polled_at", F.to_timestamp("t"))
    got = {x.job_id: (x.polls, x.state, x.progress, x.last_poll) for x in jobs.latest_polls(df).collect()}
    assert got == {"a": (3, "done", 1.0, 2), "b": (1, "other", None, 4)}


def test_payloads(spark):
    rows = [
        ("j", 0, json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": "a"}}]}})),
        ("j", 1, "{broken"),
        ("j", 2, json.dumps({"result": None})),
        ("j", 3, json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": "b"}}, {"x": 1}, {"markdown": {"text": "lost"}}]}})),
        ("j", 4, json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": "c"}}]}})),
        ("k", 0, json.dumps({"result": {"ocrResults": [{"prunedResult": {"rec_texts": ["x", 1, None, True, "y"]}}, {"prunedResult": {"rec_texts": []}}, {"prunedResult": {"rec_texts": ["z"]}}]}})),
    ]
    df = spark.createDataFrame(rows, "job string, line int, p string")
    pages = [(x.line, x.page_index, x.text) for x in payloads.layout_pages(df.where("job = 'j'"), "job", "line", "p").orderBy("line").collect()]
    assert pages == [(0, 0, "a"), (3, 1, "b"), (4, 2, "c")]
    assert [(x.page_index, x.text) for x in payloads.line_pages(df, "job", "line", "p").orderBy("page_index").collect()] == [(0, "x\ny"), (2, "z")]


def test_stream_of_both_forms(spark):
    lines = ["event: x", 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"a"}}', "data: nonsense", 'data: {"choices":[{"delta":{"content":"b"}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"c"}}]}']
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "c int, s int, l string")
    assert payloads.stream_deltas(df, "c", "s", "l").first().text == "ab"


def test_archives_and_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("other.md", "no")
        z.writestr("content/full.md", "yes")
        z.writestr("layout.json", "{}")
        z.writestr("x_middle.json", '{"k": 1}')
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("only.json", "{}")
    (tmp_path / "c.zip").write_bytes(b"no archive")
    got = {x.path[-5:]: (x.md, x.json, x.error and x.error.split(":")[0]) for x in files.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"a.zip": ("yes", '{"k": 1}', None), "b.zip": (None, None, "FileNotFoundError"), "c.zip": (None, None, "BadZipFile")}
    names = spark.createDataFrame([(["other.md", "content/full.md", "layout.json", "x_middle.json"],), (["a.png"],)], "n array<string>")
    assert [tuple(x[0]) for x in names.select(files.choose_members(F.col("n"))).collect()] == [("content/full.md", "x_middle.json"), (None, None)]


def test_render_pages_keeps_going(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"2")
    (tmp_path / "b.png").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"3")
    pages = files.render_pages(files.read_scans(spark, str(tmp_path)), lambda content, kind, dpi, width: (bytes([i]) for i in range(int(content))))
    got = sorted((x.path[-5:], x.page_no, x.error is None) for x in pages.collect())
    assert got == [("a.pdf", 0, True), ("a.pdf", 1, True), ("b.png", -1, False)]


def test_connectors(spark):
    config = {"api_url": "u", "model_id": "m", "content_format": "openai", "headers": {"X": "1"}, "payload_template": '{"max_tokens": 5}'}
    reply = {"choices": [{"message": {"content": "text"}}]}
    df = spark.createDataFrame([(1, "p", ["data:image/png;base64,AA"], "failed 1")], "call_id bigint, prompt string, images array<string>, placeholder string")
    fine = connectors.call_model(df, config, lambda u, h, b: reply, key="k").first()
    assert (fine.text, fine.error, fine.attempts) == ("text", None, 1)

    def broken(*_):
        raise OSError("down")

    lost = connectors.call_model(df, config, broken, sleep=lambda _: None).first()
    assert (lost.text, lost.attempts) == ("failed 1", 3) and "down" in lost.error
    waits = []
    assert connectors.with_retries(lambda: 1 / 0, sleep=waits.append)[1].startswith("ZeroDivisionError") and waits == [5.0, 10.0]
    assert connectors.body(config, [])["max_tokens"] == 5
    assert connectors.headers(config | {"content_format": "anthropic"}, "k")["x-api-key"] == "k"
    assert connectors.message_content("p", ["data:image/png;base64,AA"], "anthropic")[1]["source"]["media_type"] == "image/png"
    assert connectors.split_parameters({"temperature": 1, "top_k": 2}) == ({"temperature": 1}, {"top_k": 2})
    states = connectors.replay([{"state": "pending"}, OSError("x"), {"state": "done", "url": "r"}])
    assert connectors.submit_and_fetch(lambda: "j", lambda j: states("", {}, {}), lambda s: s["url"], sleep=lambda _: None) == ("r", None)
    assert connectors.poll(lambda: {"state": "odd"}, interval=0, timeout=0.01)["state"] == "timeout"


def test_registry(spark, tmp_path):
    (tmp_path / "a.toml").write_text('[defaults]\ndefault_model = "m1"\ndefault_prompt = "p"\n[meta]\nprompt = "Title page."\n[prompts]\np = "Read."\n[models.m1]\nname = "One"\n[models.m2]\nprompt_ref = ""\n[models.m3]\nprompt = "inline"\npayload_template = {a = 1}\n')
    (tmp_path / "b.toml").write_text('[models.m2]\nname = "Two"\nprompt_ref = "gone"\n')
    rows, default = registry.from_toml(spark, str(tmp_path / "a.toml"), str(tmp_path / "b.toml"))
    assert registry.meta_prompt(str(tmp_path / "a.toml"), str(tmp_path / "b.toml")) == "Title page." and len(set(registry.CLIENT_PARAMETERS)) == 20
    got = {x.model_key: (x.display_name, x.prompt_text) for x in rows.collect()}
    assert got == {"m1": ("One", "Read."), "m2": ("Two", None), "m3": ("m3", "inline")} and default == "m1"
    two = registry.layered(rows, rows.where("model_key = 'm1'").withColumn("display_name", F.lit("new")))
    assert {x.model_key: x.display_name for x in two.collect()}["m1"] == "new" and two.count() == 3


def test_sql_functions(spark):
    names = sqlfuncs.register(spark)
    assert len(names) == len(sqlfuncs.FUNCTIONS)
    out = spark.sql("SELECT qf_remove_interspersed_spaces('中 文 a b'), qf_merge_empty_lines('a\\n\\n\\nb'), qf_flat_position('a\\nbc', 3), qf_strip('　x '), qf_double_quotes('\"a\"')").first()
    assert tuple(out) == ("中文a b", "a\nb", 2, "x", "“a”")


def test_streams(spark, tmp_path):
    from quirefold import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\n\ntwo,\n")
    streaming.refine_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().text_out == "one\ntwo,"
    spark.sql("SELECT 'a' job_id, 'running' job_state, 1 total_pages, 0 extracted_pages, 1L poll_id, timestamp'2024-01-01' polled_at UNION ALL SELECT 'a', 'done', 1, 1, 2, timestamp'2024-01-01 00:05'").write.parquet(str(tmp_path / "polls"))
    polls = spark.readStream.schema(spark.read.parquet(str(tmp_path / "polls")).schema).parquet(str(tmp_path / "polls"))
    query = streaming.job_states(polls).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(x.state, x.polls) for x in spark.table("states").collect()] == [("done", 2)]


@pytest.mark.parametrize("name,most", [("merge_paragraphs", 1), ("layout_gaps", 1), ("dedup_batches", 2), ("p4_found", 1), ("full_texts", 2)])
def test_exchanges(spark, name, most):
    """Exchanges of the plans, not counting the spreading of small inputs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most


def test_command_line(spark, tmp_path, capsys):
    from quirefold.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a  \n\n\nb, c")
    main(["refine", str(tmp_path / "in"), str(tmp_path / "out"), "-s", "fullwidth_punct"], spark)
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "a\nb, c"
    blocks = [{"block_bbox": [0, y, 1, y + 5], "block_content": f"block {y}"} for y in (0, 10, 20, 30, 100)]
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text(json.dumps({"parsing_res_list": blocks}))
    main(["gaps", str(tmp_path / "json"), str(tmp_path / "gaps")], spark)
    assert [(x.prev_tail, x.next_head) for x in spark.read.parquet(str(tmp_path / "gaps")).collect()] == [("block 30", "block 100")]
    main(["version"])
    assert capsys.readouterr().out.strip()


def test_names_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("/a/b/book.txt", 7, "text", "---\ntitle: x", "")], "path string, d int, t string, y string, c string")
    assert df.select(files.output_name(F.col("path"), files.PAGES_SUFFIX)).first()[0] == "book_div.txt"
    assert files.write_texts(df, "path", "t", str(tmp_path / "out"), "model") == 1
    assert (tmp_path / "out" / "book_model.txt").read_text() == "text"
    assert files.write_metadata(df, "path", "y", "c", str(tmp_path / "out")) == 1
    assert (tmp_path / "out" / "book" / "meta.yaml").read_text() == "---\ntitle: x" and not (tmp_path / "out" / "book" / "COPYRIGHT.md").exists()
    assert files.write_marked(df, "path", "t", files.PAGES_SUFFIX, str(tmp_path / "out")) == files.write_marked(df, "path", "t", files.BREAKS_SUFFIX, str(tmp_path / "out")) == 1
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["book", "book.with_br.txt", "book_div.txt", "book_model.txt"]
    assert files.write_texts(df.limit(0), "path", "t", str(tmp_path / "out")) == 0


def test_pages_to_files(spark, tmp_path):
    """Five pages in batches of two: calls, a failure, raw text, refinement and files."""
    from quirefold.plans import recognition

    pages = spark.createDataFrame([("/in/book.pdf", i, f"data:image/png;base64,{i}") for i in (3, 0, 4, 1, 2)], "path string, page int, uri string")
    config = {"api_url": "u", "model_id": "m", "batch_size": 2, "prompt_text": "Read.", "content_format": "openai", "payload_template": "{}"}

    def transport(_url, _headers, body):
        text = body["messages"][0]["content"]
        images = [x["image_url"]["url"][-1] for x in text if x["type"] == "image_url"]
        if "4" in images:
            raise OSError("busy")
        return {"choices": [{"message": {"content": f"{text[0]['text'][7:]}\n第一行文字没有结束\n继续 {'-'.join(images)}。"}}]}

    out = recognition.recognise(pages, "path", "page", "uri", config, transport, sleep=lambda _: None)
    row = out.first()
    assert row.failed == 1 and "批次 3 (共 3 批)" in row.raw_text and row.raw_text.index("0-1") < row.raw_text.index("2-3") < row.raw_text.index("[第5-5页识别失败]")
    assert row.text_out.startswith("【当前批次：第1-2页（共5页）】第一行文字没有结束继续0-1。\n") and "\n\n" not in row.text_out
    assert recognition.save(out, "path", "m", str(tmp_path)) == 2 and (tmp_path / "book_m.txt").read_text() == row.text_out
    with pytest.raises(ValueError):
        connectors.result_form({"content_format": "odd"})
    with pytest.raises(ValueError):
        recognition.recognise(pages, "path", "page", "uri", config | {"content_format": "mineru_async"}, transport)


def test_service_forms():
    config = {"model_id": "m"}
    assert connectors.submit_request(config, "https://x/y.pdf", {"a": True}) == {"json": {"fileUrl": "https://x/y.pdf", "model": "m", "optionalPayload": {"a": True}}}
    assert connectors.submit_request(config, "/y.pdf", {"a": True}) == {"form": {"model": "m", "optionalPayload": '{"a": true}'}, "file": "/y.pdf"}
    assert connectors.job_of({"data": {"jobId": "j"}}) == "j" and connectors.job_of({"code": 0, "data": {"batch_id": "b", "file_urls": []}}) == "b"
    with pytest.raises(RuntimeError, match="full"):
        connectors.job_of({"code": 5, "msg": "full"})
    done = connectors.state_of_reply({"data": {"state": "Done ", "extractProgress": {"totalPages": 3, "extractedPages": 3}, "resultUrl": {"jsonUrl": "u"}}})
    assert done == {"state": "done", "pages": 3, "done_pages": 3, "url": "u", "error": None}
    batch = connectors.state_of_reply({"code": 0, "data": {"extract_result": [{"state": "converting", "extract_progress": {"total_pages": 9, "extracted_pages": 1}}]}})
    assert (batch["state"], batch["pages"], batch["done_pages"]) == ("running", 9, 1)
    assert connectors.state_of_reply({"code": 1, "msg": "no"})["state"] == "failed" and connectors.state_of_reply({"data": {"extract_result": []}})["state"] == "running"


def test_lookup(spark, monkeypatch):
    rows = spark.createDataFrame([("m1", "KEY_OF_M1"), ("m2", "none")], "model_key string, api_key_env string")
    monkeypatch.delenv("OCR_MODEL", raising=False)
    monkeypatch.setenv("KEY_OF_M1", "secret")
    assert registry.lookup(rows, None, "m1")["api_key"] == "secret" and registry.lookup(rows, "m2", "m1")["api_key"] is None
    with pytest.raises(KeyError):
        registry.lookup(rows, "m3", "m1")
