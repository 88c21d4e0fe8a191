"""The retrieval engine against literal cases."""

import io

import pytest
from pyspark.sql import functions as F

from spindrift import cli
from spindrift.functions import chunking, golang, html
from spindrift.functions import text as tx
from spindrift.operators import bm25, hybrid, store, summary, topk
from spindrift.plans import catalogue, output, prompts
from spindrift.plans.engine import Engine
from spindrift.plans.provider import HashingProvider
from spindrift.schemas import IndexStatus, Mode
from spindrift.sources import files, ignore, web
from spindrift.sources.config import Config
from spindrift.streaming import memory


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_vector_topk(spark):
    items = spark.createDataFrame([("A", 1, [1.0, 0.0]), ("B", 1, [0.0, 1.0]), ("C", 1, [0.8, 0.2]), ("Z", 1, [0.0, 0.0])], "file_path string, start_line int, embedding array<double>")
    assert [r.file_path for r in topk.search(items, [1.0, 0.0], 1).collect()] == ["A"]
    assert [r.file_path for r in topk.search(items, [1.0, 0.0], 3).collect()] == ["A", "C", "B"]
    assert [r.file_path for r in topk.search(items, [1.0, 0.0], 2, True, lam=0.3).collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        topk.search(items, [1.0, 0.0], 0)


@pytest.mark.parametrize(
    ("rows", "k", "lam", "want"),
    [
        ("A:.5 B:.9 C:.7", 1, 0.7, ["B"]), ("A1:.9 A2:.85 B1:.8", 2, 0.5, ["A1", "B1"]), ("A1:.9 A2:.85 B1:.7", 2, 0.9, ["A1", "A2"]),
        ("A1:.9 A2:.85 B1:.7", 2, 0.1, ["A1", "B1"]), ("A:.9 B:.8", 5, 0.7, ["A", "B"]),
    ],
)
def test_mmr(rows, k, lam, want):
    got = [dict(zip(("text", "score"), (n, float(s)), strict=True)) for n, s in (r.split(":") for r in rows.split())]
    assert [p["text"] for p in topk.mmr(got, k, lam, lambda a, b: 0.9 if a["text"][0] == b["text"][0] else 0.1)] == want


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "Go is a programming language"), (1, "Python is also a programming language"), (2, "Bananas are yellow")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in bm25.bm25_scores(docs, "go programming").collect()}
    assert s[0] > s[2] and s[0] >= s[1]
    assert [r.doc_id for r in bm25.select_top(docs, "go programming", 2).orderBy("rank").collect()][0] == 0
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "doc_id long, score double")
    assert {r.score for r in bm25.min_max(same).collect()} == {2.0}


def test_searchable(spark):
    yes = ["What does SearchCommand do?", "explain load_config function", "QueryCommand", "summarize command/query.go", "what is in config.json", "how does internal/store work", "panic: nil pointer dereference", "undefined: QueryCommand", "what does the search command do", "which function loads the config", "explain the store struct", 'what does "SearchCommand" do', "explain the query command logic"]
    no = ["what is this", "how does this work", "how do I use this cli", "who was the king of wales", "", "   ", "help", "how can I improve performance of this application", "go to /home directory"]
    assert column(spark, yes + no, tx.is_searchable) == [True] * len(yes) + [False] * len(no)


def test_chunks(spark):
    def got(text):
        d = spark.createDataFrame([(1, text)], "id int, text string")
        return chunking.chunk_text(d, "text", "id").orderBy("j").collect()

    rows = got("this is a line of 26 bytes\n" * 30)
    assert len(rows) > 1 and all(r.end_line >= r.start_line >= 1 for r in rows)
    assert got("") == [] and got("x" * 49) == [] and len(got("x" * 50)) == 1 and len(got("x" * 400)) == 1
    assert bytes(got("x" * 399 + "\n" + "y" * 60)[1].body) == b"\n" + b"y" * 60
    w = column(spark, ["p" * 41 + "\n\n" + "q" * 41, "Short paragraph.\n\nLonger paragraph that exceeds chunk size.\n\nAnother short paragraph.", ""], lambda c: chunking.web_chunks(c, 40))
    assert w == [["p" * 41, "q" * 41], ["Short paragraph.\n\nLonger paragraph that exceeds chunk size.", "Another short paragraph."], []]


GO = 'package a\n\nimport "fmt"\n\n// A does it.\nfunc A() {\n\tfmt.Println("}", `{`)\n\tB(len("x"))\n}\n\nfunc (t *T) B(x int) error { return t.c.Do(x) }\n'


def test_go():
    assert golang.chunk_go("package m\n\n\nfunc A() {}\n\nfunc B() {}\n") == [(4, 4, "A", "function", "func A() {}"), (6, 6, "B", "function", "func B() {}")]
    a, b = golang.chunk_go(GO)
    assert a[:4] == (6, 9, "A", "function") and a[4].startswith("// A does it.") and b[:4] == (11, 11, "B", "method")
    assert golang.go_signals(GO, True).split("\n") == ["fmt", "A", "fmt.Println", "B", "Do"]
    assert golang.go_signals(GO, False).split("\n") == ["fmt", "fmt.Println", "B"]
    assert golang.chunk_go("func (") is None and golang.go_signals("not go {", True) == "not go {"


def test_ignore(spark):
    rules = ignore.parse([*ignore.DEFAULTS, "*.tmp", "vendor/", "*.log", "venv", "app", "!app/", "docs/"])
    cases = {
        (".git/hooks", True): True, ("node_modules", True): True, ("src/node_modules/foo.go", False): True, ("vendor/foo.go", False): True, ("build/app.bin", False): True,
        ("package.lock", False): True, ("build.tmp", False): True, ("app", False): True, ("app.log", False): True, ("docs/readme.md", False): True,
        ("venv/lib/python3.12/x.py", False): True, ("src/app", False): True, ("logs/debug.log", False): True,
        ("app", True): False, ("app/readme.md", False): False, ("pkg/main.go", False): False, ("src/app/main.go", False): False, ("logs/debug.txt", False): False,
    }
    d = spark.createDataFrame([(p, b, w) for (p, b), w in cases.items()], "p string, d boolean, want boolean")
    bad = d.withColumn("got", ignore.ignored(F.col("p"), F.col("d"), rules)).where("got <> want").collect()
    assert bad == []


def test_code_block_and_lines(spark):
    raw = ["plain", "a\n```go\nx := 1\n```\nb\n```\ny\n```", "```\nz\n```", "```go\nopen", "```"]
    got = [(r["content"], r["language"], r["error"]) for r in column(spark, raw, tx.code_block)]
    assert got[:3] == [("plain", "", None), ("x := 1\n", "go", None), ("z\n", "", None)]
    assert [g[2] for g in got[3:]] == ["unterminated fenced code block", "malformed fenced code block"]
    assert column(spark, ["a\nb\nc\nd"], lambda c: tx.replace_lines(c, 2, 3, "X")) == ["a\nX\nd"]
    assert column(spark, ["a\nb\nc\nd"], lambda c: tx.line_range(c, 2, 3)) == ["b\nc"]
    assert column(spark, ["//x.org/l/?uddg=https%3A%2F%2Fa.b%2Fc&r=1", "https://a.b", "//c.d"], tx.clean_url) == ["https://a.b/c", "https://a.b", "https://c.d"]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>n</nav><p>one  two</p>\n\n\n<p>three<script>x('</p>')</script></p>&amp;\r\n four</body></html>"
    assert column(spark, [page], html.html_text) == ["one two\n\nthree& four"]
    # an element that is never closed ends with the one it is in; formatting that is, ends nothing else
    unclosed = ["<body><div><nav>menu<p>x</div>text</body>", "<b><nav>n</b>m</nav>t", "<div><header>h</div><p>kept</p><footer>f", "<svg/>x<img>y</nav>"]
    assert [html.body_text(x) for x in unclosed] == ["text", "t", "kept", "xy"]
    pages = spark.createDataFrame([(1, "u", f"<body>{'word ' * 100}</body>"), (2, "v", "<body>short</body>")], "page_id long, url string, html string")
    assert [r.page_id for r in web.page_chunks(pages).collect()] == [1]


def test_memory():
    m = dict(memory.EMPTY)
    queue = [("1", memory.to_payload("a", "b"))]
    assert memory.fold(queue, m, lambda x, s: '{"topics_add":["rag"]}') == ({"project_summary": "", "topics": ["rag"], "preferences": []}, ["1"], 1)
    state = {"project_summary": "", "topics": ["rag"], "preferences": []}
    assert memory.fold(queue, state, lambda x, s: 'ok {"topics_add":["Vector search "]}')[0]["topics"] == ["rag", "vector search"]
    assert memory.fold([("1", "bad payload")], m, lambda x, s: "NOT_JSON") == (m, [], 0)
    assert memory.fold(queue, m, lambda x, s: "NOT_JSON") == (m, ["1"], 0)
    assert memory.fold(queue, m, lambda x, s: "{bad}") == (m, [], 0)
    assert memory.fold(queue, m, lambda x, s: "{}") == (m, ["1"], 1)
    full = [f"t{i}" for i in range(20)]
    assert len(memory.merge_list(full, ["new", "newer"], 20)) == 21


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.status("h") == IndexStatus.MISSING
    items = spark.createDataFrame([("a.go", "A", "function", 1, 2, "x", [1.0])], "file_path string, symbol string, kind string, start_line int, end_line int, content string, embedding array<double>")
    s.save(items, "root", "h", "sum")
    s.save(items, "root", "h", "sum2")
    assert s.status("h") == IndexStatus.OK and s.status("other") == IndexStatus.STALE
    assert s.items().count() == 1 and s.summary("root") == "sum2" and s.summary("none") == ""
    s.reset()
    with pytest.raises(LookupError):
        s.items()
    assert store.decode_vector(store.encode_vector([1.5, -2.0])) == [1.5, -2.0]


def test_engine(spark, tmp_path):
    root = tmp_path / "p"
    (root / "sub").mkdir(parents=True)
    (root / "a.go").write_text("package a\n\n// LoadConfig reads.\nfunc LoadConfig() {\n\treadFile()\n}\n")
    (root / "sub" / "b.py").write_text("def run_server():\n    pass\n" * 10)
    (root / "vendor").mkdir()
    (root / "vendor" / "c.go").write_text("package c\nfunc Hidden() {}\n")
    (root / "README.md").write_text("about this")
    p = HashingProvider(replies={"long-term memory": '{"summary_update": "s", "topics_add": ["config"]}'})
    e = Engine(spark, Config(root=str(root), store=str(tmp_path / "store")), p)
    assert e.index() >= 2 and e.status() == IndexStatus.OK
    paths = {r.file_path for r in e.store.items().collect()}
    assert "a.go" in paths and "sub/b.py" in paths and not any("vendor" in x for x in paths)
    assert "LoadConfig" in e.store.summary(str(root)) and "about this" in e.store.summary(str(root))
    assert e.search("what does LoadConfig do", k=1).startswith("\n[1] (score: ")
    assert "USER REQUEST:\nwhat does LoadConfig do" in e.query_prompt("what does LoadConfig do", mode=Mode.DEEP)
    assert "TARGET FUNCTION: LoadConfig" in e.target_prompt("explain", "a.go", function="LoadConfig", mode=Mode.NONE)
    e.query("what does LoadConfig do")
    assert e.flush_memory() == 1 and e.store.memory()["topics"] == ["config"] and e.store.queue().count() == 0
    chat = e.chat()
    chat.send("hello there")
    assert [h["role"] for h in chat.history] == ["user", "assistant"]


def test_scan(spark, tmp_path):
    """Names that Spark's readers hide are read too; folders that are ignored aren't gone into."""
    text = {"main.py": "m", "__init__.py": "", "_helpers.py": "h", ".hidden.py": "d", "sub/__init__.py": "s", ".github/x.yml": "y", "odd [1]*.py": "o", "a b.py": "ab"}
    left = {"node_modules/x.py": "n", "sub/vendor/y.py": "v", "sub/z.bin": "b", ".git/config.py": "g", "big.py": "x" * (files.MAX_BYTES + 1)}
    for p, t in (text | left).items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert {r.path: bytes(r.content).decode() for r in files.scan(spark, str(tmp_path)).collect()} == text
    listed = files.listing(spark, str(tmp_path), ignore.parse(list(ignore.DEFAULTS)))
    assert {r.path for r in listed.collect()} == {*text, "sub/z.bin", "big.py"}
    (tmp_path / "none").mkdir()
    assert files.scan(spark, str(tmp_path / "none")).collect() == []


def test_modes_and_prompts():
    assert Mode("odd").settings() == (5, False) and Mode.DEEP.settings() == (12, True) and Mode.NONE.settings()[0] == 0
    assert "REPOSITORY OVERVIEW" not in prompts.render("query", "q") and "PROJECT MEMORY" not in prompts.render("ask", "q", memory=memory.EMPTY)
    with pytest.raises(ValueError):
        Config(temperature=2)


def test_stream(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    q = str(tmp_path / "q")
    spark.createDataFrame([("1", memory.to_payload("a", "b"))], "id string, payload string").withColumn("created_at", F.current_timestamp()).write.parquet(q)
    for _ in range(2):  # the second finds nothing new
        memory.stream_flush(q, s, lambda x, m: '{"topics_add": ["t%d"]}' % len(m["topics"]), str(tmp_path / "c")).awaitTermination()
    assert s.memory()["topics"] == ["t0"]


def test_symbols_and_summary(spark):
    items = spark.createDataFrame([("a", "F", 1, 11), ("b", "F", 1, 1), ("c", "G", 1, 1)], "file_path string, symbol string, start_line int, end_line int")
    got = [(r.file_path, round(r.score, 3)) for r in hybrid.find_by_symbols(items, ["F"], 5).orderBy("file_path").collect()]
    assert [r.file_path for r in hybrid.find_by_symbols(items, ["G", "F"], 5).collect()] == ["c", "b", "a"]  # by identifier, then by score
    assert [r.file_path for r in hybrid.find_by_symbols(items, ["F"], 1).collect()] == ["a"]  # the first of the table, not the best
    assert got == [("a", 1.99), ("b", 2.0)] and hybrid.find_by_symbols(items, ["F"], 0).count() == 0
    whole = {s: [round(r.score, 3) for r in hybrid.find_by_symbols(items, ["x.F"], 5, s).orderBy("file_path").collect()] for s in ("F", "what does F do", "x.F")}
    assert whole == {"F": [1.99, 2.0], "what does F do": [0.99, 1.0], "x.F": [0.99, 1.0]}
    docs = spark.createDataFrame([("docs/README.md", "x" * 2000), ("a.py", "")], "path string, content string")
    assert len(summary.readme(docs).first().readme) == 1000


@pytest.mark.parametrize("name", ["vector_topk", "bm25_scores", "chunk_text", "memory_fold", "web_select_top"])
def test_queries(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_queue_is_appended_to(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    keys = [s.enqueue(memory.to_payload(str(i), "")) for i in range(3)]
    assert {r.id for r in s.queue().collect()} == set(keys)
    s.commit_memory(memory.EMPTY | {"topics": ["a"]}, keys[:1])
    late = s.enqueue(memory.to_payload("late", ""))  # a message that comes while the queue is folded isn't lost
    assert {r.id for r in s.queue().collect()} == {*keys[1:], late}
    s._list_done = lambda ids: None  # a crash between the state and the list of what is done
    s.commit_memory(memory.EMPTY | {"topics": ["a", "b"]}, keys[1:2])
    del s._list_done
    assert {r.id for r in s.queue().collect()} == {keys[2], late}
    s.commit_memory(memory.EMPTY, [keys[2]])
    assert [r.id for r in s.queue().collect()] == [late]


def test_replayed_batch(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    q = str(tmp_path / "q")
    spark.createDataFrame([("1", memory.to_payload("a", "b"))], "id string, payload string").withColumn("created_at", F.current_timestamp()).write.parquet(q)
    for c in ("c1", "c2"):  # a checkpoint that knows nothing of the first run
        memory.stream_flush(q, s, lambda x, m: '{"topics_add": ["t%d"]}' % len(m["topics"]), str(tmp_path / c)).awaitTermination()
    assert s.memory()["topics"] == ["t0"]


FOUND = '<div class="result"><a class="result__a x" href="//d.com/l/?uddg=https%3A%2F%2Fa.com%2Fp">First <b>page</b></a></div><a href="/no">n</a><div class="result"><a class="result__a" href="https://b.com">B</a><a class="result__a" href=""></a></div>'


def page(url):
    if "q=" in url:
        assert url.endswith("?q=go+channels%3F")
        return FOUND
    if url == "https://b.com":
        raise OSError("gone")
    return "<p>" + "Go channels carry values between goroutines that run at the same time. " * 6 + "</p>"


def test_web_pages(spark):
    assert [tuple(r) for r in web.search_web(spark, "go channels?", 5, page).collect()] == [("First page", "https://a.com/p"), ("B", "https://b.com")]
    assert web.search_web(spark, "go channels?", 1, page).count() == 1
    got = {r.url: r.error for r in web.fetch(web.search_web(spark, "go channels?", 5, page), page, 0, 0).collect()}
    assert got == {"https://a.com/p": None, "https://b.com": "gone"}
    assert [(r.page_id, r.url) for r in web.web_pages(spark, "go channels?", 5, page, 0, 0).collect()] == [(1, "https://a.com/p")]


def test_output(tmp_path):
    cases = {
        "just text": ("just text", ""), "```go\na()\n```": ("a()\n", "go"), "x ```\ncode\n``` y": ("code\n", ""),
        "```go\na\n```\n```go\nb\n```": ("a\n", "go"), "```rust\nlet x = 1;\n```": ("let x = 1;\n", "rust"),
    }
    assert {k: (c.content, c.language) for k in cases if (c := output.Code.of(k))} == cases
    for bad in ("```go\nincomplete", "```go"):
        with pytest.raises(ValueError):
            output.Code.of(bad)
    p = tmp_path / "new" / "a.go"
    output.append_to(str(p))("```go\na\n```")
    assert p.read_text() == "a\n"
    output.append_to(str(p))("```go\nb\n```")
    assert p.read_text() == "a\n\n\n// ---- AI GENERATED CODE ----\n\nb\n"
    p.write_text("1\n2\n3\n4")
    output.Code("x").replace(str(p), 2, 3)
    assert p.read_text() == "1\nx\n4"
    output.Code("y\n").replace(str(p), 3, 99)
    assert p.read_text() == "1\nx\ny\n"
    for at in ((0, 1), (3, 2)):
        with pytest.raises(ValueError):
            output.Code("x").replace(str(p), *at)
    with pytest.raises(ValueError):
        output.Code("x").append("")
    assert output.line_numbers("3-7") == (3, 7) and output.line_numbers(" ") is None
    for bad in ("3", "1-2-3", "a-b", "3:7"):
        with pytest.raises(ValueError):
            output.line_numbers(bad)


def test_cli(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.go").write_text("package a\n\n// LoadConfig reads.\nfunc LoadConfig() {\n\treadFile()\n}\n")
    replies = {"long-term memory": '{"summary_update": "s"}', "TARGET": "```go\nfunc TestA() {}\n```"}
    e = Engine(spark, Config(root=str(root), store=str(tmp_path / "store")), HashingProvider(replies=replies), page)

    def run(*argv, lines=()):
        out, left = io.StringIO(), iter(lines)
        cli.run(e, list(argv), out, lambda: next(left, ""))
        return out.getvalue()

    assert "chunks in" in run("index")
    assert "LoadConfig" in run("search", "what", "does", "LoadConfig", "do", "--k", "1", "--mmr")
    assert run("query", "what does LoadConfig do", "--v", "--mode", "deep")
    out = tmp_path / "t" / "a_test.go"
    assert "TestA" in run("test", "a.go", "--fn", "LoadConfig", "--out", str(out)) and out.read_text() == "func TestA() {}\n"
    for verb in ("summarize", "explain", "fix", "refactor"):
        assert "TestA" in run(verb, "a.go", "--rng", "3-6")
    assert "TestA" in run("edit", "a.go", "make", "it", "shorter") and "TestA" in run("comment", "a.go", "--fn", "LoadConfig")
    assert run("ask", "go channels?", "--web", "50") and run("ask", "why")
    assert run("chat", lines=["hello\n", "\n", "exit\n", "more\n"]).count("\n") == 2
    assert "items)" in run("flush") and run("flush").strip() == "No memory updates"
    for bad in (["edit", "a.go"], ["fix"], ["nothing"], []):
        with pytest.raises(SystemExit):
            cli.run(e, bad)
    with pytest.raises(ValueError):
        run("fix", "a.go", "--rng", "3")
