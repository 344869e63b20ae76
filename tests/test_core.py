"""Core operators against brute force and hand-made cases."""

import io
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textquarry.functions import redact, text as T
from textquarry.operators import analytics, chunking, context, dedup, governance, graph, questions, retrieval, trees
from textquarry.plans.pipeline import CycleError, Pipeline
from textquarry.session import cut_lineage
from textquarry.sources import formats, readers, sinks
from textquarry.sources.html import grid, read_html
from textquarry.streaming import logs

EMPTY = "doc_id bigint, text string, source string, lang string, title string, extra int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", "en", None, 1) for i, t in enumerate(texts)], EMPTY)


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_scalar_functions(spark):
    assert column(spark, [" a \t b\n\n\n\nc ", None, ""], T.clean_text) == ["a b\n\nc", None, ""]
    assert column(spark, ["abcdefgh", "", "ab"], T.estimated_tokens) == [2, 1, 1]
    assert column(spark, ["Tree,", "--", "xyz", "rhythm"], T.syllables) == [1, 0, 1, 1]
    assert column(spark, ["Привет мир", "hello", "漢字かな", "123"], T.script_of) == ["cyrillic", "latin", "cjk", None]
    assert column(spark, ["3725", "59", "61"], lambda c: T.clock(c.cast("double"))) == ["1:02:05", "0:59", "1:01"]
    assert column(spark, ["a\x00b\tc\x07"], T.sanitise_input) == ["ab\tc"]


def test_redaction(spark):
    said = "mail a.b@c.org, call 555-123-4567, ssn 123-45-6789, ip 10.0.0.1, card 1234 5678 9012 3456"
    assert column(spark, [said], redact.redact_pii) == ["mail [EMAIL], call [PHONE], ssn [SSN], ip [IP_ADDRESS], card [CREDIT_CARD]"]
    key = "AKIA" + "A1" * 8
    assert column(spark, [f"k={key}"], redact.redact_secrets) == ["k=[AWS_KEY]"]
    assert column(spark, ["Salary: 100\nname=x"], lambda c: redact.redact_fields(c, ["salary"])) == ["Salary: [REDACTED]\nname=x"]


def test_paragraph_packing_against_a_loop(spark):
    random.seed(3)
    texts = ["\n\n".join("x" * random.randint(1, 400) for _ in range(random.randint(1, 12))) for _ in range(30)] + ["", None, " \n\n "]

    def loop(t, size=1000):
        out, now = [], ""
        for p in [x.strip() for x in (t or "").split("\n\n") if x.strip()]:
            if now and len(now) + len(p) > size:
                out.append(now)
                now = p
            else:
                now = f"{now}\n\n{p}" if now else p
        return out + ([now] if now else [])

    got = {}
    for r in chunking.paragraph_chunks(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, {})[r.chunk_seq] = r.chunk
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {i: loop(t) for i, t in enumerate(texts) if loop(t)}


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, k, s, "x" * n, "ab"[k % 2], k) for k, (s, n) in enumerate([(0.9, 40), (0.8, 400), (0.7, 20), (0.6, 40)])]
    chunks = spark.createDataFrame(rows, "query_id int, chunk_id int, score double, text string, source string, position int")
    r = context.pack_by_score(chunks, 26).collect()[0]
    assert (r.chunk_ids, r.total_tokens) == ([0, 2, 3], 25)
    assert context.pack_round_robin(chunks, 1000).collect()[0].chunk_ids == [0, 1, 2, 3]
    merged = context.merge_neighbours(chunks.withColumn("source", F.lit("a")), 60).collect()[0].parts
    assert [p.t for p in merged] == [10, 115] or [p.t for p in merged] == [10, 100, 15]


def test_confidence(spark):
    chunks = spark.createDataFrame([(1, 0.8, "a", "the cat sat"), (1, 0.6, "b", "a dog")], "query_id int, score double, source string, text string")
    answers = spark.createDataFrame([(1, "the cat", "cat sat")], "query_id int, question string, answer string")
    assert context.confidence(chunks, answers).collect()[0].confidence == pytest.approx(0.3 * (0.7 - 0.04) + 0.2 + 0.2 * 0.5 + 0.3, abs=1e-4)


def test_minhash_links_alike_texts_and_survives_a_hot_text(spark):
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(7))
    base = [" ".join(word() for _ in range(80)) for _ in range(20)]
    near = [b.replace(b.split()[0], word()) for b in base]
    texts = base + near + [base[0]] * 40 + ["abc", "abc", "", None]
    got = {r.doc_id: r.class_id for r in dedup.minhash_classes(docs(spark, texts)).collect()}
    assert len(got) == len(texts) - 2
    for i in range(20):
        assert got[i] == i and got[20 + i] == i
    assert all(got[40 + k] == 0 for k in range(40))
    assert got[80] == 80 and got[81] == 80


def test_minhash_links_every_pair_at_the_threshold(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(80)]
        other = [word() if k in {3, 11, 23, 37, 48, 59, 66, 71, 76} else w for k, w in enumerate(base)]
        texts += [" ".join(base), " ".join(other)]
    page = [word() for _ in range(60)]  # a template whose copies are unlike at the threshold, but for every third, alike to the one before
    for k in range(60):
        own = [word() for _ in range(60)] if k % 3 < 2 else own[:52] + [word() for _ in range(8)]
        texts.append(" ".join(page + own))
    a, b = dedup.coefficients(dedup.PERMUTATIONS)
    s = np.stack([dedup.signature(t, a, b) for t in texts])
    share = (s[:, None] == s[None]).mean(axis=2)
    i, j = np.nonzero(np.triu(share >= dedup.THRESHOLD, 1))
    assert sum(0.7 <= share[x, y] <= 0.8 for x, y in zip(i, j)) >= 30
    want = dict(enumerate(dedup._roots(len(texts), np.stack([i, j], 1)).tolist()))
    for options in ({}, {"block_rows": 16}):
        got = {r.doc_id: r.class_id for r in dedup.minhash_classes(docs(spark, texts), **options).collect()}
        assert got == want


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 4), (7, 7)], "x bigint, y bigint")
    assert {(r.node, r.component) for r in dedup.connected(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}


def test_vector_search_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, []), (502, [0.0] * 8)], "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in retrieval.vector_search(rows, rows.where("vec_id % 10 = 0"), 3, block_rows=20).collect()}
    u = x.astype(float) / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for i in range(0, 120, 10):
        s = np.round(u @ u[i], 6)
        s[i] = -9
        want |= {(i, int(j)) for j in np.lexsort((np.arange(120), -s))[:3]}
    assert got == want


def test_empty_tables_give_empty_results(spark):
    d = docs(spark, [])
    q = spark.createDataFrame([], "query_id bigint, query string")
    for df in (
        chunking.fixed_chunks(d), chunking.sentence_windows(d), chunking.heading_chunks(d), chunking.paragraph_chunks(d), retrieval.bm25(d, q),
        retrieval.keyword_overlap(d, q), dedup.exact_groups(d), dedup.minhash_classes(d), graph.headings(d), graph.entities(d), questions.analyse(q),
    ):
        assert df.count() == 0


def test_relations_and_paths(spark):
    d = docs(spark, ["Ann Smith works for Bob Jones. Nobody here.", "Ann Smith was funded", None])
    assert [tuple(r) for r in graph.relations(d).collect()] == [(0, "works for", "Ann Smith", "Bob Jones")]
    e = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("c", "d", "r", 1.0)], "source string, target string, relation string, weight double")
    got = {tuple(r.path) for r in graph.paths(e, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {("a", "b"), ("a", "b", "c")}


def test_heading_parents_against_a_stack(spark):
    random.seed(2)
    levels = [random.randint(1, 6) for _ in range(60)]
    d = docs(spark, ["\n".join("#" * n + f" t{i}" for i, n in enumerate(levels))])
    stack, want = [], []
    for i, n in enumerate(levels, 1):
        while stack and stack[-1][1] >= n:
            stack.pop()
        want.append((i, stack[-1][0] if stack else None))
        stack.append((i, n))
    got = [(r.seq, r.parent_seq) for r in graph.headings(d).orderBy("seq").collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    # the parent is the nearest heading before of a smaller level
    near = [max((j + 1 for j in range(i) if levels[j] < n), default=None) for i, n in enumerate(levels)]
    assert [g[1] for g in got] == near


def test_access_first_rule_decides(spark):
    p = spark.createDataFrame([("a/x.txt",), ("b/y",), (None,)], "path string")
    rules = [("a/*", ["boss"]), ("*", ["*"])]
    assert {(r.path, r.allowed) for r in governance.decide_access(p, rules, ["me"]).collect()} == {("a/x.txt", False), ("b/y", True)}
    assert all(r.allowed for r in governance.decide_access(p, [], ["me"]).collect())


def test_sync_plan(spark):
    a = spark.createDataFrame([("n", 1.0), ("same", 1.0), ("newer", 2.0)], "path string, mtime double")
    b = spark.createDataFrame([("same", 1.0), ("newer", 1.0), ("gone", 1.0)], "path string, mtime double")
    assert {(r.path, r.action) for r in governance.sync_plan(a, b).collect()} == {("n", "ingest"), ("newer", "refresh"), ("gone", "delete")}


def test_line_diff_restores_the_new_text(spark):
    random.seed(4)
    rows = [(i, "\n".join(random.choices("abcd", k=8)), "\n".join(random.choices("abcd", k=8))) for i in range(20)] + [(99, None, "x")]
    diff = trees.line_diff(spark.createDataFrame(rows, "id int, old string, new string")).collect()
    for i, old, new in rows:
        lines = dict(enumerate((old or "").splitlines(), 1))
        mine = [r for r in diff if r.id == i]
        for r in mine:
            if r.change == "removed":
                assert lines.pop(r.old_line) == r.line
        kept = [lines[k] for k in sorted(lines)]
        added = {r.new_line: r.line for r in mine if r.change == "added"}
        rebuilt = [added[k] if k in added else kept.pop(0) for k in range(1, len(new.splitlines()) + 1)]
        assert rebuilt == new.splitlines()


def test_summary_tree_has_one_root_per_text(spark):
    rows = [(d, i, f"text {d} {i}") for d, n in ((1, 1), (2, 7), (3, 140)) for i in range(n)]
    t = trees.summary_tree(spark.createDataFrame(rows, "doc_id int, chunk_seq int, chunk string")).toPandas()
    assert t[t.parent_id.isna()].groupby("doc_id").size().to_dict() == {1: 1, 2: 1, 3: 1}
    both = t.merge(t, left_on=["doc_id", "parent_id"], right_on=["doc_id", "node_id"])
    assert len(both) == t.parent_id.notna().sum() and (both.level_y == both.level_x + 1).all()


def test_variants_are_steady(spark):
    import hashlib

    users = spark.createDataFrame([(u,) for u in range(200)], "user_id bigint")
    got = {r.user_id: r.v for r in users.select("user_id", analytics.variant_of(F.col("user_id"), (20, 30, 50)).alias("v")).collect()}
    want = {u: 0 if (b := int(hashlib.md5(str(u).encode()).hexdigest(), 16) % 100) < 20 else 1 if b < 50 else 2 for u in range(200)}
    assert got == want


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_formats():
    docx = _zip({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    r = formats.read_file("a.docx", docx)
    assert r["text"] == "Hello" and r["tables"] == [{"columns": ["A"], "rows": [["1"]]}]
    xlsx = _zip({
        "xl/workbook.xml": '<workbook><sheets><sheet name="One"/></sheets></workbook>',
        "xl/sharedStrings.xml": "<sst><si><t>n</t></si><si><t>v</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>',
    })
    r = formats.read_file("a.xlsx", xlsx)
    assert r["tables"] == [{"columns": ["n", "", "v"], "rows": [["7"]]}]
    pptx = _zip({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:sld>'})
    assert formats.read_file("a.pptx", pptx)["text"] == "--- Slide 1 ---\nHi"
    epub = _zip({"META-INF/container.xml": "<c/>", "a.xhtml": "<html><body><p>One</p></body></html>"})
    assert formats.read_file("a.epub", epub)["text"] == "One"
    assert formats.read_file("a.json", b'[{"a": 1, "b": 2}, {"a": 3}]')["tables"] == [{"columns": ["a", "b"], "rows": [["1", "2"], ["3", ""]]}]
    for name, data, code in (("a.docx", b"plain", "E002"), ("a.csv", b"", "E003"), ("a.bin", b"??", "E001"), ("a.pdf", b"%PDF-1.4", "E006")):
        with pytest.raises(formats.ReadError) as e:
            formats.read_file(name, data)
        assert e.value.code == code
    with pytest.raises(formats.ReadError):
        formats.check_archive(_zip({"a": b"0" * 5_000_000}))


def test_html_tables_and_text():
    page = read_html("<html lang='de'><title>T</title><script>x</script><nav>menu</nav><p>a&amp;b<table><tr><th>N<th>V<tr><td rowspan=2>x<td>1<tr><td>2</table><a href='/q'>l</a>")
    assert page["title"] == "T" and page["lang"] == "de" and page["links"] == ["/q"]
    assert page["tables"] == [{"columns": ["N", "V"], "rows": [["x", "1"], ["x", "2"]]}]
    assert "menu" not in page["text"] and "a&b" in page["text"]
    assert grid([[("a", 2, 1)], [("b", 1, 1), ("c", 1, 1)]]) == [["a", "a"], ["b", "c"]]


def test_load_documents_and_rejects(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# T\n\n| A | B |\n|---|---|\n| 1 | 2 |\n")
    (tmp_path / "d/b.csv").write_text("n,v\nx,1\n")
    (tmp_path / "d/c.docx").write_text("no zip")
    good, bad = readers.split_errors(readers.load_documents(spark, str(tmp_path)))
    assert sorted(r.source_type for r in good.collect()) == ["csv", "markdown"]
    assert [r.error_code for r in bad.collect()] == ["E002"]
    cells = {(r.column, r.value) for r in readers.long_tables(good).collect()}
    assert cells == {("A", "1"), ("B", "2"), ("n", "x"), ("v", "1")}
    md = {r.markdown for r in sinks.markdown(good).collect()}
    assert any("| A | B |\n| --- | --- |\n| 1 | 2 |" in m for m in md)
    assert readers.load_bytes(spark, [("../x\x00.json", b"{}")]).collect()[0].source_path == ".._x_.json"


def test_sitemap_and_feed(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a.example/1 </loc></url><url><loc>https://a.example/2</loc></url></urlset>")
    assert sorted(r.loc for r in readers.sitemap_urls(spark, str(tmp_path / "s.xml")).collect()) == ["https://a.example/1", "https://a.example/2"]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>https://a.example</link><pubDate>Mon, 6 Jan 2025 10:00:00 +0000</pubDate></item></channel></rss>")
    r = readers.feed_items(spark, str(tmp_path / "f.xml")).collect()[0]
    assert r.title == "T"


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = logs.windowed_counts(stream, 15, "60 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = analytics.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert spark.table("w").exceptAll(batch).count() == 0 and spark.table("w").count() == batch.count()
    q = logs.rate_limited(stream, 1).writeStream.format("memory").queryName("r").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("r").count() == events.count()


def test_pipeline_orders_resumes_and_finds_cycles(spark, tmp_path):
    calls = []

    def step(name):
        def run(frames):
            calls.append(name)
            return spark.range(3)

        return run

    p = Pipeline(str(tmp_path / "p")).add("b", step("b"), after="a").add("a", step("a"))
    assert p.run(spark)["b"].count() == 3 and calls == ["a", "b"]
    p.run(spark)
    assert calls == ["a", "b"]
    with pytest.raises(CycleError):
        Pipeline().add("x", step("x"), after="y").add("y", step("y"), after="x").order()


def test_checkpoint_is_kept(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_session_windows_and_percentiles_of_empty_log(spark):
    log = spark.createDataFrame([], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    assert analytics.hourly_series(log).count() == 0
    assert analytics.percentiles(log, "event_type").count() == 0
    assert analytics.sessions(log).count() == 0
    assert pd.isna(analytics.totals(log.limit(0)).toPandas().iloc[0]["error_rate"]) if analytics.totals(log).count() else True
