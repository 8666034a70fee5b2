import json

from pyspark.sql import functions as F

from engramma.operators import evaluate
from engramma.sources import exports, files, sinks


def texts(spark, *rows):
    return spark.createDataFrame([(f"/x/claude/f{i}.json", r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "path string, text string")


def said(df):
    return [(r["role"], r["text"]) for r in df.orderBy("conversation_id", "position").collect()]


def test_tree_with_branch_and_cycle(spark):
    msg = lambda role, t: {"author": {"role": role}, "content": {"content_type": "text", "parts": [t]}, "create_time": 1.0}
    mapping = {
        "r": {"id": "r", "parent": None, "children": ["a"], "message": None},
        "a": {"id": "a", "parent": "r", "children": ["b", "c"], "message": msg("user", "hi")},
        "b": {"id": "b", "parent": "a", "children": ["a"], "message": msg("assistant", "yes")},
        "c": {"id": "c", "parent": "a", "children": [], "message": msg("assistant", "no")},
    }
    got = exports.tree_messages(texts(spark, [{"title": "t", "conversation_id": "k", "mapping": mapping}]))
    assert said(got) == [("user", "hi"), ("assistant", "yes"), ("assistant", "no")]


def test_blocks_pair_tool_results(spark):
    c = [{"uuid": "k", "name": "n", "chat_messages": [{"sender": "human", "content": [{"type": "text", "text": "go"}]}, {"sender": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "run"}, {"type": "tool_result", "tool_use_id": "t1", "content": "done"}, {"type": "text", "text": "ok"}]}]}]
    assert said(exports.block_messages(texts(spark, c))) == [("user", "go"), ("assistant", "[tool: run]\ndone\nok")]


def test_responses_and_individual(spark):
    r = {"conversation": {"id": "k", "title": "t"}, "responses": [{"message": "b", "sender": "ASSISTANT", "create_time": "2024-01-02"}, {"message": "a", "sender": "human", "create_time": "2024-01-01"}]}
    assert said(exports.response_messages(texts(spark, r))) == [("user", "a"), ("assistant", "b")]
    i = {"title": "t", "url": "u", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "w"}]}
    assert said(exports.individual_messages(texts(spark, i))) == [("user", "q"), ("assistant", "w")]


def test_text_markdown_and_agent(spark):
    assert said(exports.labelled_text(texts(spark, "noise\nYou\nhello\nthere\nGrok\nhey"))) == [("user", "hello\nthere"), ("assistant", "hey")]
    assert said(exports.labelled_text(texts(spark, "You: hello\nThink\n\nGrok: hey\n12 sources\nmore"), least=2)) == [("user", "hello"), ("assistant", "hey\nmore")]
    assert exports.labelled_text(texts(spark, "You: hello\nGrok: hey"), least=4).count() == 0
    blocks = "is it so?\n\nYes, it is. Long answer.\n\nAnd more of it.\n\nand why?\n\nNo? that is rhetorical\n\nBecause."
    assert said(exports.alternating_blocks(texts(spark, blocks))) == [("user", "is it so?"), ("assistant", "Yes, it is. Long answer.\n\nAnd more of it."), ("user", "and why?\n\nNo? that is rhetorical"), ("assistant", "Because.")]
    assert said(exports.divider_markdown(texts(spark, "# Q one\nanswer\n---\nmore\n---\n# Q two\nend"))) == [("user", "Q one"), ("assistant", "answer\n\nmore"), ("user", "Q two"), ("assistant", "end")]
    lines = [{"type": "user", "sessionId": "s", "timestamp": "1", "message": {"content": "hi"}}, {"type": "user", "isMeta": True, "sessionId": "s", "timestamp": "2", "message": {"content": "x"}}, {"type": "assistant", "sessionId": "s", "timestamp": "3", "message": {"content": [{"type": "text", "text": "yo"}]}}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
    assert said(exports.agent_lines(df)) == [("user", "hi"), ("assistant", "yo")]


def test_detection(spark):
    got = texts(spark, [{"mapping": {}}], [{"chat_messages": []}], {"responses": []}, "just text").select(exports.detect_format(F.col("text")).alias("f"), exports.platform_of(F.col("path")).alias("p")).collect()
    assert [r["f"] for r in got] == ["tree", "blocks", "responses", "text"] and got[0]["p"] == "claude"


def test_scan_and_manifest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("one")
    (tmp_path / "a" / "y.md").write_text("one")
    (tmp_path / "a" / "z.bin").write_text("no")
    (tmp_path / "a" / "e.md").write_text("")
    f = files.scan(spark, str(tmp_path)).withColumn("content_hash", F.md5("text")).withColumn("stage_order", F.lit(1))
    m = files.manifest(f).collect()
    assert len(m) == 1 and m[0]["n_files"] == 2 and m[0]["owner"].endswith("x.md")
    assert files.unseen(f, f.limit(1)).count() == 0


def test_deep_tree(spark):
    n = 5000
    mapping = {f"n{i:05d}": {"id": f"n{i:05d}", "parent": f"n{i - 1:05d}" if i else None, "children": [f"n{i + 1:05d}"] if i + 1 < n else [], "message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": [str(i)]}, "create_time": 1.0}} for i in range(n)}
    got = exports.tree_messages(texts(spark, [{"title": "t", "conversation_id": "k", "mapping": mapping}]))
    assert [t for _, t in said(got)] == [str(i) for i in range(n)]


def test_bulk_responses_with_parents_and_assets(spark):
    date = lambda ms: {"$date": {"$numberLong": str(ms)}}
    r = lambda i, up, at, **kw: {"response": {"_id": i, "parent_response_id": up, "message": f"m{i}", "sender": "human" if i in "ad" else "ASSISTANT", "create_time": date(at), **kw}}
    one = {"conversation": {"id": "k", "title": "t"}, "responses": [r("c", "a", 3000), r("b", "a", 2000, thinking_trace="hm", thinking_start_time=date(1), thinking_end_time=date(41), file_attachments=["u1", "u2"]), r("a", None, 1000), r("d", None, 1500), r("e", "d", 1600)]}
    other = {"conversation": {"id": "l", "user_id": "u"}, "responses": [r("x", "gone", 1000), r("y", "x", 2000), r("x", "y", 3000)]}
    assets = spark.createDataFrame([("u1", "file text")], "uuid string, content string")
    got = exports.conversation_tree_messages(texts(spark, {"conversations": [one, other]}), assets=assets).orderBy("conversation_id", "position").collect()
    assert [(x["conversation_id"], x["text"]) for x in got][:5] == [("k", "ma"), ("k", "md"), ("k", "mb"), ("k", "mc"), ("k", "me")]
    b = got[2]
    assert (b["thinking"], b["thinking_ms"], [tuple(a) for a in b["attachments"]]) == ("hm", 40, [("u1", "file text"), ("u2", None)])
    assert {x["platform"] for x in got} == {"grok", "claude_chat"} and got[0]["created_at"] == "1970-01-01T00:00:01Z" and got[0]["role"] == "user"


def test_divided_responses(spark):
    r = {"conversation": {"id": "k"}, "responses": [{"message": "q", "sender": "human", "create_time": "2024-01-01"}, {"message": "one\n---\ntwo", "sender": "x", "create_time": "2024-01-02"}]}
    assert said(exports.response_messages(texts(spark, r))) == [("user", "q"), ("assistant", "one"), ("assistant", "two")]


def test_activity_log(spark):
    block = lambda q, at, a: f"Logo for Gemini Apps\nGemini Apps\nPrompted {q}\nDetails\nevent\n{at}\napps\nGemini Apps\nchat\n\n{a}\n"
    text = "head\n" + block("first", "Nov 30, 2025 at 1:58\u202fAM", "answer\none") + block("second", "March 4 at 12:59 PM", "two") + block("third", "Yesterday at 12:01 AM", "")
    df = spark.createDataFrame([("/x/LOG_2025_11_18-2026_02_17_01_12.md", text)], "path string, text string")
    got = [(r["user_text"], r["response_text"], r["created_at"]) for r in exports.activity_log(df).orderBy("exchange_index").collect()]
    assert got == [("first", "answer\none", "2025-11-30T01:58:00Z"), ("second", "two", "2025-03-04T12:59:00Z"), ("third", "", "2026-02-16T00:01:00Z")]
    assert df.select(exports.detect_format(F.col("text")).alias("f")).first()["f"] == "activity"
    again = exports.activity_log(df).withColumn("created_at", F.lit("other"))
    firsts = exports.first_source([exports.activity_log(df), again])
    assert firsts.count() == 3 and {r["source_order"] for r in firsts.collect()} == {0}
    found = exports.with_artifacts(firsts, spark.createDataFrame([("Answer One", "no"), ("answer", "body"), ("two", "x")], "name string, content string"))
    assert {r["user_text"]: [a["name"] for a in r["artifacts"]] for r in found.collect()} == {"first": ["answer"], "second": ["two"], "third": []}


def test_detection_looks_at_whole_files(spark):
    late = {"padding": "x" * 10_000, "mapping": {}}
    got = texts(spark, [late], {"conversations": []}, {"title": "t", "messages": []}, '{"sessionId": "s", "type": "user"}\n{"type": "x"}', '{"mapping": cut').select(exports.detect_format(F.col("text")).alias("f")).collect()
    assert [r["f"] for r in got] == ["tree", "conversations", "individual", "agent_lines", "text"]


def test_stages_rules_and_documents(spark, tmp_path):
    paths = ["/c/layer_0/v0_a.md", "/c/layer_0/b.md", "/c/chewy/noext", "/c/chewy/pic.png", "/c/layer_1/x.py", "/c/layer_1/x.min.js", "/c/layer_1/venv/y.py", "/c/expansion_md/.ipynb_checkpoints/z.md", "/c/expansion_md/z.md", "/c/CCM_NEW_MDS/q.txt"]
    f = spark.createDataFrame([(p, 10) for p in paths], "path string, length long")
    s = files.staged(f, files.stage_table(spark))
    kept = {r["path"]: r["stage"] for r in s.where(files.wanted(F.col("path"), F.col("length"), F.col("any_suffix"))).collect()}
    assert kept == {"/c/layer_0/v0_a.md": "v0", "/c/layer_0/b.md": "layer_0", "/c/chewy/noext": "chewy", "/c/layer_1/x.py": "layer_1", "/c/expansion_md/z.md": "expansion_md"}
    docs = spark.createDataFrame([("/a.json", '{"b":  [1, 2]}'), ("/b.json", "{cut"), ("/c.md", "  text \n")], "path string, text string")
    assert [r["d"] for r in docs.orderBy("path").select(files.as_document(F.col("text"), F.col("path")).alias("d")).collect()] == ['{"b":[1,2]}', "{cut", "text"]
    at = lambda h: f"2024-01-01 0{h}:00:00"
    now = spark.createDataFrame([("a", at(1)), ("b", at(3)), ("c", at(1))], "path string, modified string")
    assert sorted(r["path"] for r in files.modified_since(now, spark.createDataFrame([("a", at(1)), ("b", at(2))], "path string, modified string")).collect()) == ["b", "c"]
    r = spark.createDataFrame([("/r/0123456789ab_grok.json", '{"response": "x"}'), ("/r/notes.json", "{}"), ("/r/0123456789ab_b.json", "{}")], "path string, text string")
    assert [tuple(x) for x in files.response_files(r).collect()] == [("0123456789ab", "grok", "x")]
    lines = spark.createDataFrame([(json.dumps({"type": "message", "id": "s", "timestamp": "1", "message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}}),), ('{"type": "other"}',), ("broken",)], "value string")
    assert said(exports.agent_lines(files.adapted_lines(lines))) == [("assistant", "yo")]


def test_sinks(spark, tmp_path):
    m = exports.response_messages(texts(spark, {"conversation": {"id": "k", "title": "t"}, "responses": [{"message": "q", "sender": "human", "create_time": "2024-01-01"}, {"message": "a", "sender": "x", "create_time": "2024-01-02"}]}))
    sinks.write_conversations(m, str(tmp_path / "c"))
    back = spark.read.json(str(tmp_path / "c")).first()
    assert (back["platform"], back["n_messages"], back["n_prompts"], [x["text"] for x in back["messages"]], back["updated_at"]) == ("responses", 2, 1, ["q", "a"], "2024-01-02")
    for _ in range(2):
        sinks.append_events(spark.createDataFrame([(1, "x")], "seq int, event_type string"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
    items = spark.createDataFrame([("p", "T", "grok", 1, "TRANSCRIPT", "/x/parsed/s.json", "session-123456789", 4, "h" * 20, "said"), ("p", "T", "grok", 0, "CORPUS", "/x/corpus/a/b.md", None, None, "g" * 20, "body")], "package_id string, theme string, platform string, place int, type string, source_file string, session_id string, exchange_index int, content_hash string, content string")
    anchors = spark.createDataFrame([("p", i, f"/x/{i}.md", "sum", ["M"]) for i in range(12)], "package_id string, place int, source_file string, summary string, motifs array<string>")
    text = sinks.packages(items, anchors).first()["text"]
    assert text.index("### ITEM-001 [CORPUS] a/b.md [gggggggggggg]") < text.index("### ITEM-002 [TRANSCRIPT] grok/s.json [hhhhhhhhhhhh]\n*Session: session-1234, Exchange: 4*")
    assert text.count("### ANCHOR-") == 10 and "**Items**: 2 | **Platform**: grok" in text
    gate = evaluate.regression_gate(spark.createDataFrame([("m", 0.5)], "metric string, value double"), spark.createDataFrame([("m", 0.4)], "metric string, value double"))
    assert "| m | 0.5000 | 0.4000 | -0.1000 | regressed |" in sinks.metric_report(gate, "run")


def test_artifacts_thinking_and_attachments(spark):
    blocks = [{"type": "thinking", "thinking": "let me see", "summaries": ["short"]}, {"type": "tool_use", "name": "artifacts", "id": "a", "input": {"id": "i", "title": "T", "command": "create", "content": "body"}}, {"type": "tool_use", "name": "web_search", "id": "t1", "input": {"q": "x"}}, {"type": "tool_use", "name": "bash", "id": "t2", "input": {}}, {"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]}, {"type": "text", "text": "ok", "citations": [{"url": "u", "title": "n"}]}]
    c = [{"uuid": "k", "chat_messages": [{"sender": "human", "content": [], "attachments": [{"file_name": "f.txt", "extracted_content": "in it"}], "files": [{"file_name": "p.png"}]}, {"sender": "assistant", "content": blocks}]}]
    a, b = exports.block_details(texts(spark, c)).orderBy("place").collect()
    assert [tuple(x) for x in a["attachments"]] == [("f.txt", "in it"), ("p.png", None)] and a["thinking"] == ""
    assert b["thinking"] == "let me see\n[Summary] short" and [x["content"] for x in b["artifacts"]] == ["body"] and b["artifacts"][0]["command"] == "create"
    assert [(x["name"], x["output"]) for x in b["tools"]] == [("web_search", "one\ntwo"), ("bash", None)] and [tuple(x) for x in b["citations"]] == [("u", "n")]
    msg = lambda role, parts, **kw: {"author": {"role": role}, "content": {"parts": parts}, **kw}
    mapping = {"a": {"id": "a", "message": msg("assistant", [json.dumps({"name": "doc", "type": "document", "content": "text"})], recipient="canmore.create_textdoc")}, "b": {"id": "b", "message": msg("tool", [{"content_type": "image_asset_pointer", "asset_pointer": "file://p"}])}, "c": {"id": "c", "message": msg("tool", ["42"])}, "d": {"id": "d", "message": msg("assistant", ["cut {"], recipient="canmore.update_textdoc")}}
    got = {r["node"]: (r["kind"], r["name"], r["content"]) for r in exports.tree_artifacts(texts(spark, [{"conversation_id": "k", "mapping": mapping}])).collect()}
    assert got == {"a": ("canvas", "doc", "text"), "b": ("picture", "", "file://p"), "c": ("output", "", "42")}
