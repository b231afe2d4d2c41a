"""Behaviours of the operators on small tables of their own."""

import zipfile

from pyspark.sql import functions as F

from convarchive.functions import html, text
from convarchive.operators import intake, merge, projects, threads
from convarchive.sources import readers


def rows(df):
    return [tuple(r) for r in df.collect()]


def note(spark, *versions):
    return spark.createDataFrame(versions, "note_id string, group_key string, path string, title string, base_name string, source string, mtime int")


def test_champion_keeps_its_own_repeats_and_recovered_messages_follow(spark):
    notes = note(spark, ("a", "g", "a", "T", "b", "x", 1), ("b", "g", "b", "T", "b", "x", 2))
    said = [("a", 0, "user", "hi there"), ("a", 1, "user", " hi  there "), ("a", 2, "assistant", "long long answer"), ("b", 0, "user", "hi there"), ("b", 1, "user", "new"), ("b", 2, "user", "new")]
    messages = spark.createDataFrame(said, "note_id string, pos int, role string, content string")
    got = merge.merge_variants(notes, messages).orderBy("pos")
    assert [(r.pos, r.content, r.recovered) for r in got.collect()] == [(1, "hi there", False), (2, " hi  there ", False), (3, "long long answer", False), (4, "new", True)]


def test_renames(spark):
    notes = note(spark, ("a", "g", "a", "Old", "old", "s", 1), ("b", "g", "b", "New", "new", "s", 500))
    assert rows(merge.resolve_titles(notes)) == [("g", "New", "new", "Old", 2)]


def test_collision_of_output_names(spark):
    got = rows(merge.disambiguate(spark.createDataFrame([("id:1", "d"), ("id:2", "d"), ("id:3", "e")], "group_key string, dest string")).orderBy("group_key"))
    assert got[0][2] != got[1][2] and got[0][2].startswith("d · ") and got[2][2] == "e"


def test_discarded_branch_and_cycle(spark):
    n = [("c", "1", None, 0), ("c", "2", "1", 1), ("c", "2b", "1", 2), ("c", "3", "2", 3), ("y", "a", "b", 0), ("y", "b", "a", 1)]
    nodes = spark.createDataFrame([(*x, x[3], "user", x[1]) for x in n], "conv_id string, node_id string, parent_id string, pos int, created int, role string, content string")
    leaves = spark.createDataFrame([("c", "3"), ("y", "a")], "conv_id string, leaf_id string")
    got = rows(threads.resolve_thread(nodes, leaves).orderBy("conv_id", "pos").select("conv_id", "node_id"))
    assert got == [("c", "1"), ("c", "2"), ("c", "3"), ("y", "b"), ("y", "a")]


def test_artifact_operations(spark):
    ops = [(1, "update", None, "lid", "cap"), (2, "create", "jar with lid\n", None, None), (3, "update", None, "lid", "lid\nand label"), (4, "update", None, "cork", "z"), (5, "update", None, "\n", "\n!")]
    df = spark.createDataFrame([("c", "a", *o) for o in ops], "conv_id string, artifact_id string, pos int, command string, content string, old_str string, new_str string")
    assert rows(threads.fold_artifacts(df)) == [("c", "a", "jar with lid\n!and label\n", 5)]


def test_project_ids_in_all_spellings(spark):
    h = "0123456789abcdef" * 2
    convs = spark.createDataFrame([(1, f"g-{h}"), (2, f"g-p-{h}"), (3, h), (4, None), (5, "g-short")], "conv_id int, project_id string")
    got = projects.project_name(convs, spark.createDataFrame([(f"g-p-{h}", "Named")], "id string, name string"))
    assert [r.project for r in got.orderBy("conv_id").collect()] == ["Named", "Named", "Named", "none", "none"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Árbol niño 12 a-b_c x",)], "t string")
    assert df.select(text.topic_tokens(F.col("t"))).first()[0] == ["arbol", "nino", "a-b_c"]
    assert df.select(text.slugify(F.col("t"), "ascii")).first()[0] == "arbol-nino-12-a-b-c-x"
    assert text.smart_title and df.select(text.smart_title(F.lit("New chat"), F.col("t"))).first()[0] == "Árbol niño 12 a b_c x"


def test_html(spark):
    page = "<h1>T</h1><p>a <b>b</b> <a href='u'>c</a></p><ul><li>x</li></ul><blockquote><p>q</p></blockquote><script>no</script><figure><img src='i' alt='z'><figcaption>cap</figcaption></figure>"
    assert html.markdown_of(page) == "# T\n\na **b** [c](u)\n\n- x\n\n> q\n\n![z](i)\n\n*cap*"
    assert [m["role"] for m in html.export_of("<h2>A</h2>x<h3>B</h3>y")] == ["user", "assistant"]
    assert html.export_of('<script>var d = {"conversations": [{"title": "t", "messages": [{"role": "user", "content": "hi"}]}]};</script>') == [{"title": "t", "role": "user", "content": "hi"}]
    assert html.export_of(None) == [] and html.markdown_of(None) is None


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/conversations-000.json", "[]")
        z.writestr("users.json", "{}")
    (tmp_path / "b.zip").write_bytes(b"broken")
    members = readers.expand_archives(spark, str(tmp_path)).cache()
    assert sorted((r.member or "", r.bytes) for r in members.collect()) == [("", 6), ("users.json", 2), ("x/conversations-000.json", 2)]
    kinds = {r.archive[-5:]: r.kind for r in intake.classify_exports(members.fillna("", ["member"])).collect()}
    assert kinds == {"a.zip": "chatgpt shards", "b.zip": "unknown"}


def test_chatgpt_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title":"t","conversation_id":"c1","current_node":"2","mapping":{"1":{"message":{"author":{"role":"user"},"content":{"parts":["hi"]}}},"2":{"parent":"1"}}}]')
    (tmp_path / "b.json").write_text('{"items":[{"title":"u","id":"c2","messages":[{"role":"human","content":"x"},{"role":"assistant","content":"y"}]}]}')
    got = readers.read_chatgpt(spark, str(tmp_path))
    assert {(r.conv_id, r.node_id, r.parent_id, r.role) for r in got["node"].collect()} == {("c1", "1", None, "user"), ("c1", "2", "1", None), ("c2", "0", None, "user"), ("c2", "1", "0", "assistant")}
    assert {r.conv_id for r in got["conv"].collect()} == {"c1", "c2"}


def test_frames_and_posts(spark, tmp_path):
    frame = tmp_path / "frames" / "f1"
    frame.mkdir(parents=True)
    (frame / "artifact.json").write_text('{"id":"f1","kind":"k","versions":[{"id":"v1","title":"t"},{"id":"v2"}]}')
    (frame / "artifact_comments.json").write_text('{"threads":[{"resolved":true,"comments":[{"author_role":"user","text":"hm"}]}]}')
    (frame / "v1.html").write_text("<p>")
    got = readers.read_claude_frames(spark, str(tmp_path / "frames"))
    assert {(r.version_id, r.bytes) for r in got["version"].collect()} == {("v1", 3), ("v2", None)} and got["comment"].first().text == "hm"
    posts = tmp_path / "posts"
    posts.mkdir()
    (tmp_path / "posts.csv").write_text("post_id,title,post_date\n12.first,A,2024\n13.second,B,\n")
    (posts / "12.first.html").write_text("<p>x</p>")
    (tmp_path / "s.csv").write_text("title,post_date,views\nA,2024,3\n")
    assert {(r.id, r.slug, r.html) for r in readers.read_posts(spark, str(tmp_path)).collect()} == {("12", "first", "<p>x</p>"), ("13", "second", None)}
    assert readers.read_post_stats(spark, [str(tmp_path / "posts.csv"), str(tmp_path / "s.csv")]).count() == 1


def test_agent_log_with_a_corrupt_line(spark, tmp_path):
    log = ['{"type":"user","sessionId":"s","origin":{"kind":"human"},"timestamp":"2024-01-01T00:00:00Z","message":{"content":"do it"}}', "{oops", '{"type":"assistant","sessionId":"s","message":{"content":[{"type":"thinking","thinking":""}]}}',
           '{"type":"assistant","sessionId":"s","isSidechain":true,"message":{"content":[{"type":"text","text":"side"}]}}', '{"type":"assistant","sessionId":"s","message":{"content":[{"type":"text","text":"done"}]}}']
    (tmp_path / "l.jsonl").write_text("\n".join(log))
    turns = threads.agent_turns(readers.read_agent_events(spark, str(tmp_path)))
    assert [(r.turn, r.role, r.text, r.thoughts) for r in turns.orderBy("turn").collect()] == [(1, "user", "do it", 0), (2, "assistant", "done", 0)]


def test_missing_and_repeated_node_ids_keep_the_original_order(spark):
    n = [("r", "1", None, 0, 9), ("r", "2", "1", 1, 3), ("r", "2", "1", 2, 1), ("m", "1", None, 0, 5), ("m", None, "1", 1, 1), ("ok", "1", None, 0, 1), ("ok", "2", "1", 1, 2), ("ok", "3", "1", 2, 3)]
    nodes = spark.createDataFrame([(*x, "user", "t") for x in n], "conv_id string, node_id string, parent_id string, pos int, created int, role string, content string")
    leaves = threads.latest_leaves(nodes, spark.createDataFrame([("r", "2"), ("ok", "2")], "conv_id string, leaf_id string"))
    assert rows(leaves) == [("ok", "2")]
    got = rows(threads.resolve_thread(nodes, leaves).orderBy("conv_id", "pos").select("conv_id", "node_id"))
    assert got == [("m", "1"), ("m", None), ("ok", "1"), ("ok", "2"), ("r", "1"), ("r", "2"), ("r", "2")]


def test_html_whose_end_tags_are_left_out():
    assert html.markdown_of("<html><head><title>t</title><meta charset=x><body><p>text<p>more") == "text\n\nmore"
    assert html.markdown_of("<head><style>p {}</style><p>text") == "text"
    assert html.markdown_of("<p>a</p><nav><ul><li>x</nav><p>b") == "a\n\nb"
    got = html.export_of("<html><body><p>hello</p><p>yes?</p><pre>bye</pre>")
    assert [(m["role"], m["content"]) for m in got] == [("user", "hello"), ("assistant", "yes?"), ("user", "bye")] or len(got) == 2


def test_accents_of_all_scripts(spark):
    import unicodedata

    said = ["Őű ğș", "ΆΈ ῷ", "Việt Nam Ế", "e\u0301 n\u0303", "Ёлка й", "plain", "İstanbul", "Straße œ"]
    got = rows(spark.createDataFrame([(s,) for s in said], "s string").select(text.fold_accents(F.col("s"))))
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not 0x300 <= ord(c) < 0x370)
    assert [g[0] for g in got] == [bare(s) for s in said]


def test_front_matter_with_a_repeated_key(spark):
    files = spark.createDataFrame([("n", "---\na: 1\nb: 2\na: 3\n---\nbody")], "path string, value string")
    assert readers.parse_notes(files)["note"].first().front == {"a": "3", "b": "2"}


def test_codes_of_deep_lineages(spark):
    from convarchive.operators import lineage

    clips = [(str(i), str(i - 1) if i else None, i) for i in range(70)] + [("x", "y", 1), ("y", "x", 1), ("z", "y", 1), ("k", "0", 0), ("lost", "nowhere", 1)]
    got = {r.clip_id: (r.root_id, r.depth, r.code) for r in lineage.dewey(spark.createDataFrame(clips, "clip_id string, parent_id string, created int")).collect()}
    assert got["k"] == ("0", 1, "0.1") and got["1"] == ("0", 1, "0.2") and got["69"] == ("0", 69, "0.2" + ".1" * 68) and not {"x", "y", "z", "lost"} & set(got)


def test_blocks_of_agent_logs(spark, tmp_path):
    import json

    line = lambda **k: json.dumps(k)
    said = [
        line(type="user", sessionId="s", origin={"kind": "human"}, message={"content": "[1] is it?"}),
        line(type="assistant", sessionId="s", message={"content": [{"type": "text", "text": "one"}, {"type": "tool_use", "id": "c", "name": "run", "input": {"a": [1]}}, {"type": "text", "text": "two"}]}),
        line(type="user", sessionId="s", message={"content": [{"type": "tool_result", "tool_use_id": "c", "content": "out"}]}), "{broken",
        line(type="user", sessionId="s", message={"content": "a hook's text"}),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(said))
    events = readers.read_agent_events(spark, str(tmp_path)).cache()
    assert [(r.role, r.text, r.tools) for r in threads.agent_turns(events).orderBy("turn").collect()] == [("user", "[1] is it?", 0), ("assistant", "one\n\ntwo", 1)]
    (call,) = threads.join_tool_results(*threads.calls_and_results(events)).collect()
    assert (call.tool, call.input, call.result) == ("run", '{"a":[1]}', "out")
