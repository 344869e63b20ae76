"""Model-backed operators, answers and the operators around them, on small and on dirty rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry import session
from textquarry.functions import text as T
from textquarry.operators import analytics, answers, context, dedup, models, retrieval, trees
from textquarry.plans.pipeline import Pipeline

DOC = "doc_id bigint, text string, answer_x string, error_x int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOC)


def upper(prompts):
    return [p.upper() for p in prompts]


def broken(prompts):
    raise ValueError("no key sk_live_" + "a1" * 12)


def few(prompts):
    return prompts[:-1]


def test_calls_keep_rows_nulls_and_errors(spark):
    df = docs(spark, [(1, "a\x00b"), (2, None), (3, ""), (3, ""), (None, "x" * 200_000)])
    got = models.call_model(df, F.col("text"), upper, wait=0)
    assert got.columns == ["doc_id", "text", "answer_x", "error_x", "answer", "error"]
    assert sorted(((r.doc_id or 0, r.answer and len(r.answer), r.error) for r in got.collect()), key=str) == sorted([(1, 2, None), (2, None, None), (3, "", None), (3, "", None), (0, 100_000, None)], key=str)
    failed = [r.error for r in models.call_model(df, F.col("text"), broken, wait=0, batch=1, failures=2).where("doc_id is null or doc_id <> 2").collect()]
    assert len(failed) == 4 and all("sk_live" not in e for e in failed)
    assert {"ValueError: 0 answers to 1 prompts"} == {r.error for r in models.call_model(df.where("doc_id = 1"), F.col("text"), few, wait=0).collect()}
    assert models.call_model(df.limit(0), F.col("text"), upper).count() == 0


def test_the_circuit_opens(spark):
    df = docs(spark, [(i, str(i)) for i in range(20)]).coalesce(1)
    errors = [r.error for r in models.call_model(df, F.col("text"), broken, wait=0, batch=2, failures=3).collect()]
    assert sum(e == "circuit open" for e in errors) == 14 and sum(e.startswith("ValueError") for e in errors) == 6


def test_answers_not_accepted_are_asked_again(spark):
    calls = []

    def sometimes(prompts):
        calls.append(len(prompts))
        return ['so {"n": 1}' if len(calls) > 1 or "b" in p else "no" for p in prompts]

    got = {r.doc_id: (r.fields, r.error) for r in models.extract_fields(docs(spark, [(1, "a"), (2, "b"), (3, None)]), sometimes, "n int", wait=0).collect()}
    assert got[1][0].n == got[2][0].n == 1 and 3 not in got
    never = models.extract_fields(docs(spark, [(1, "a")]), upper, "n int", wait=0).first()
    assert never.error == "answer not accepted"


def test_long_texts_are_asked_in_parts(spark):
    got = {r.doc_id: (r.answer, r.error) for r in models.call_chunked(docs(spark, [(1, "ab"), (2, "abcdef"), (3, None), (4, "")]), upper, "Do.", 4, wait=0).collect()}
    assert got[1] == ("DO.\n\nAB", None) and set(got) == {1, 2}
    assert "PART 1 OF 2:\n\nABCD" in got[2][0] and "PART 2 OF 2:\n\nEF" in got[2][0]
    assert models.call_chunked(docs(spark, [(1, "abcdef")]), broken, "Do.", 4, wait=0).first().answer is None


def test_lists_ranks_and_steps(spark):
    got = models.model_list(docs(spark, [(1, "t"), (2, None)]), lambda ps: ["1. red\n- blue, green\n\n* red" for _ in ps], models.keywords_prompt).collect()
    assert [(r.seq, r.item) for r in sorted(got, key=lambda r: r.seq)] == [(0, "red"), (1, "blue"), (2, "green")]
    res = spark.createDataFrame([(1, "q", i, t) for i, t in ((5, "3"), (6, "9"), (7, "none"), (4, "9"))], "query_id int, query string, doc_id int, text string")
    got = models.rerank(res, lambda ps: [p.rsplit("\n", 1)[1] for p in ps], 3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(4, 0.9), (6, 0.9), (5, 0.3)]
    q = spark.createDataFrame([(1, "Why and how?"), (2, "No parts")], "query_id int, query string")
    parts = spark.createDataFrame([(1, 1, "how?"), (1, 0, "why?")], "query_id int, part_no int, part string")
    got = {r.query_id: (r.steps, r.answer) for r in models.reason(q, parts, upper, wait=0).collect()}
    assert got[1][0] == 2 and got[1][1].index("WHY?") < got[1][1].index("HOW?") and got[2][0] == 0


def test_questions_are_answered_from_the_corpus(spark):
    d = docs(spark, [(1, "The cat sat on the mat. The dog barked at night."), (2, "Stars are far away. Planets circle stars."), (3, None), (4, "")])
    q = spark.createDataFrame([(1, "Which dog barked?"), (2, "What do planets circle?"), (3, None), (4, "zzz")], "query_id int, query string")
    got = {r.query_id: r for r in answers.ask(d, q).collect()}
    assert got[1].answer == "The dog barked at night." and got[2].answer == "Planets circle stars." and got[3].answer is None
    asked = {r.query_id: r for r in answers.ask(d, q, upper, wait=0).collect()}
    assert "QUESTION: WHICH DOG BARKED?" in asked[1].answer and asked[3].answer is None and asked[1].doc_ids[0] == 1
    assert answers.ask(d.limit(0), q).where("answer is not null").count() == 0


def test_made_tests_and_their_evaluation(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "")], "chunk_id int, text string")
    got = answers.test_set(chunks, lambda ps: ["Q: what?\nA: that" if p.endswith("a") else "nothing" for p in ps], 10)
    assert [tuple(r) for r in got.collect()] == [(1, "what?", "that", "a")]
    tests = spark.createDataFrame([(1, "is it red", "red"), (2, "x", "y"), (3, None, None)], "id int, question string, answer string")
    results = spark.createDataFrame([(1, "it is red", ["it is red now", "blue"]), (3, None, None)], "id int, answer string, contexts array<string>")
    got = {r.metric: (r.mean, r.n) for r in answers.evaluate(tests, results).collect()}
    assert got == {"answer_relevance": (0.5, 2), "context_precision": (0.25, 2), "faithfulness": (0.5, 2), "answer_similarity": (round(1 / 6, 6), 2)}


def test_items_pages_and_chats(spark):
    text = "intro\n| a | b |\n| 1 | 2 |\nmiddle ![alt text](x.png)\n| c |\nend"
    got = {(r.item_type, r.seq): r.text for r in answers.index_items(docs(spark, [(1, text), (2, None), (3, "| x |")])).collect() if r.doc_id == 1}
    assert got[("table", 0)].count("\n") == 2 and got[("table", 1)].strip() == "| c |" and got[("image", 0)] == "alt text" and "middle" in got[("text", 0)] and "|" not in got[("text", 0)]
    assert {(r.item_type, r["items"], r.docs) for r in answers.item_stats(answers.index_items(docs(spark, [(1, text), (3, "| x |")]))).collect()} == {("table", 3, 2), ("image", 1, 1), ("text", 1, 1)}
    chunks = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("b", 0, 5)], "document_id string, start_index int, end_index int")
    breaks = spark.createDataFrame([("a", [5, 10])], "document_id string, breaks array<int>")
    assert sorted((r.document_id, r.start_index, r.first_page, r.last_page) for r in answers.pages_of(chunks, breaks).collect()) == [("a", 0, 1, 2), ("a", 10, 3, 3), ("b", 0, 1, 1)]
    turns = spark.createDataFrame([(1, k, "user", "x" * 40) for k in range(6)] + [(2, 0, "user", None)], "chat_id int, turn_no int, role string, text string")
    assert sorted((r.chat_id, r.turn_no) for r in answers.chat_window(turns, 3).collect()) == [(1, 3), (1, 4), (1, 5), (2, 0)]
    assert sorted(r.turn_no for r in answers.chat_window(turns, 10, 25).where("chat_id = 1").collect()) == [4, 5]


def packed(rows, budget, most=800):
    size = lambda t: int(len(t.split()) * 1.33)
    rows = sorted(rows)
    if sum(size(t) for *_, t in rows) <= budget:
        return [(s, v, t) for _, s, v, t in rows]
    parts = []
    for _, s, v, t in rows:
        if parts and parts[-1][0] == s and size(parts[-1][2]) + size(t) < most:
            parts[-1] = (s, parts[-1][1], parts[-1][2] + "\n" + t)
        else:
            parts.append((s, v, t))
    if sum(size(t) for *_, t in parts) <= budget:
        return parts
    used, kept = 0, []
    for part in sorted(parts, key=lambda p: -p[1]):
        if used + size(part[2]) <= budget:
            kept.append(part)
            used += size(part[2])
    return kept


def test_compression_equals_a_plain_one(spark):
    rng = random.Random(4)
    rows = {q: [(k, rng.choice("ab"), round(rng.random(), 3), " ".join(["w"] * rng.choice([5, 40, 90]))) for k in range(8)] for q in range(12)}
    df = spark.createDataFrame([(q, k, k, s, v, t) for q, x in rows.items() for k, s, v, t in x], "query_id int, chunk_id int, position int, source string, score double, text string")
    for budget, most in ((10_000, 800), (250, 100), (400, 60), (1, 10)):
        got = {}
        for r in context.compressed(df, budget, most).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append((r.source, r.score, r.text))
        assert got == {q: p for q, x in rows.items() if (p := packed(x, budget, most))}


def test_greedy_clusters_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(d, i, (rng.normal(size=4) + 2 * (i % 3 == 0)).tolist()) for d in range(4) for i in range(15)] + [(9, 0, [0.0] * 4), (9, 1, None)]
    got = {(r.doc_id, r.i): r.cluster for r in trees.cluster_nodes(spark.createDataFrame(rows, "doc_id int, i int, embedding array<double>"), 4, 0.6).collect()}
    want = {}
    for d in range(4):
        x = [np.array(v) / np.linalg.norm(v) for e, _, v in rows if e == d]
        for i in range(15):
            if (d, i) not in want:
                want[d, i], n = i, 1
                for j in range(i + 1, 15):
                    if (d, j) not in want and n < 4 and round(float(x[i] @ x[j]), 9) >= 0.6:
                        want[d, j], n = i, n + 1
    assert got == {**want, (9, 0): 0}


def test_sentences_languages_and_merged_texts(spark):
    df = docs(spark, [(1, "Dr. Smith went to Washington. He met Mr. Jones."), (2, None), (3, "Привет, мир"), (4, "漢字 only")])
    got = {r.doc_id: (r.s, r.l) for r in df.select("doc_id", T.sentences(F.col("text")).alias("s"), T.language_of(F.col("text")).alias("l")).collect()}
    assert got[1] == (["Dr. Smith went to Washington.", "He met Mr. Jones."], "en") and got[2][0] is None and got[3][1] == "ru" and got[4][1] in ("zh", "en")
    rows = spark.createDataFrame([(2, "b", "p2", "s"), (1, "a", None, "s"), (3, None, "", None)], "doc_id int, text string, source_path string, source string")
    assert {r.source: (r.n, r.text, r.source_path) for r in T.merge_documents(rows, ["source"]).collect()} == {"s": (2, "a\n\nb", "p2"), None: (1, "", "")}


def test_bm25_with_terms_joined_as_a_table(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    d = docs(spark, [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 20)))) for i in range(60)] + [(98, None), (99, "")])
    q = spark.createDataFrame([(k, f"w{k} w{k + 1} w{k}") for k in range(10)], "query_id int, query string")
    sent = {tuple(r) for r in retrieval.bm25(d, q).collect()}
    assert sent and {tuple(r) for r in retrieval.bm25(d, q, most_sent=0).collect()} == sent


def test_percentiles_equal_a_sorted_list(spark):
    rng = random.Random(7)
    values = {k: [rng.choice([1.0, 1.0, 2.5, rng.random() * 9]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 500), (None, 40))}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x] + [("a", None), ("z", None)], "kind string, value double")
    got = {r.kind: (r.p50, r.p95, r.p99) for r in analytics.percentiles(df, "kind").collect()}
    assert got == {k: tuple(sorted(x)[min(int(len(x) * p), len(x) - 1)] for p in (0.5, 0.95, 0.99)) for k, x in values.items()}


def test_components_settle_or_fail(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "x bigint, y bigint")
    got = {r.node: r.component for r in dedup.connected(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    with pytest.raises(RuntimeError):
        dedup.connected(links, rounds=1)


def test_no_checkpoint_folder_off_local_masters(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Directory:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Directory()})()})()

    class Frame:
        sparkSession = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()

    with pytest.raises(RuntimeError):
        session.cut_lineage(Frame())


def test_pipeline_keeps_maps_chooses_and_stores(spark, tmp_path):
    d = docs(spark, [(1, "a"), (2, "bb"), (3, None)])
    p = Pipeline().keep("long", "docs", "length(text) > 1").map("sized", "long", {"n": F.length("text")})
    p.when("checked", "sized", lambda f: f.count() > 5, lambda f: f.limit(0), lambda f: f.withColumn("few", F.lit(True))).store("kept", "checked", str(tmp_path / "kept"), "json")
    p.steps = {"docs": (lambda frames: d, (), 1), **p.steps}
    frames = p.run(spark)
    assert [(r.doc_id, r.n, r.few) for r in frames["kept"].collect()] == [(2, 2, True)]
    assert [(name, rows) for name, _, rows in p.trace(frames)] == [("docs", 3), ("long", 1), ("sized", 1), ("checked", 1), ("kept", 1)]


def test_printed_contents_fields_and_characters(spark):
    d = docs(spark, [(1, "Intro .... 3\n  Part one  ...... 5\nno page here\n    Deep    12\n"), (2, None), (3, "")])
    from textquarry.operators import graph

    assert [tuple(r) for r in graph.printed_contents(d).orderBy("seq").collect()] == [(1, 1, 1, "Intro", 3), (1, 2, 2, "Part one", 5), (1, 3, 3, "Deep", 12)]
    x = docs(spark, [(1, "a\n**Topic**: law\n"), (2, "none"), (3, None)])
    assert [r[0] for r in x.orderBy("doc_id").select(T.field_of(F.col("text"), "topic", "-")).collect()] == ["law", "-", "-"]
    ids = {r.doc_id: r.i for r in docs(spark, [(1, "aé漢"), (2, ""), (3, "b" * 9)]).select("doc_id", T.character_ids(F.col("text"), 4).alias("i")).collect()}
    assert ids == {1: [97, 233, 28450, 0], 2: [0] * 4, 3: [98] * 4}


def test_fixes_tenants_stubs_and_strategies(spark):
    from textquarry.operators import governance

    long = " ".join(["word"] * 12)
    d = spark.createDataFrame([(1, None, "a"), (2, "few words", "a"), (3, long, "gone"), (4, long, None), (5, long, "a")], "doc_id int, text string, source string")
    live = spark.createDataFrame([("a",), (None,), ("a",)], "source string")
    assert {(r.doc_id, r.reason) for r in governance.index_fixes(d, live).collect()} == {(1, "empty"), (2, "short"), (3, "orphan"), (4, "orphan")}
    assert governance.tenant_rows(d, "a", "source").count() == 3
    with pytest.raises(ValueError):
        governance.tenant_rows(d, "", "source")
    c = spark.createDataFrame([(1, 1, 0, 0.9, "x" * 40), (1, 2, 1, 0.2, "y" * 3000), (1, 3, 2, 0.1, "z" * 3000), (2, 4, 0, 0.1, "short")], "query_id int, chunk_id int, position int, score double, text string")
    got = {(r.query_id, r.chunk_id): (r.score, r.text) for r in context.pack_with_stub(c, 100).collect()}
    assert set(got) == {(1, 1), (1, None), (2, 4)} and got[(1, None)] == (0.3, "y" * 1000)
    with pytest.raises(ValueError):
        dedup.deduplicate(d, "none")
    assert dedup.deduplicate(docs(spark, [(1, "same text"), (2, "same text")]), "lsh").count() == 2


def test_questions_in_other_languages_and_a_written_index(spark, tmp_path):
    d = docs(spark, [(1, "The cat sat on the mat. The dog barked at night."), (2, None)])
    q = spark.createDataFrame([(1, "Which dog barked?"), (2, "Welcher Hund?"), (3, None)], "query_id int, query string")
    languages = spark.createDataFrame([(1, "en"), (2, "de")], "query_id int, lang string")

    def model(prompts):
        return ["Which dog barked?" if p.startswith("Translate into en") else "zurück" if p.startswith("Translate into de") else "the dog" for p in prompts]

    got = {r.query_id: r.answer for r in answers.ask_translated(d, q, languages, model, wait=0).collect()}
    assert got == {1: "the dog", 2: "zurück", 3: None}
    written = answers.index_documents(d, str(tmp_path / "index"), 20, 0, 8)
    assert written.columns == ["doc_id", "chunk_seq", "chunk", "embedding"] and written.count() == 3 and written.where("size(embedding) = 8").count() == 3


def test_all_forms_of_personal_data(spark):
    from textquarry.functions import redact

    said = {
        "1234-5678 9012-3456": "[CREDIT_CARD]", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6": "[CREDIT_CARD]", "2001:db8:0:0:0:0:0:1": "[IPV6_ADDRESS]",
        "fe80:::1": "[IPV6_ADDRESS]", "http://go.news.bit.ly/x1": "[SHORT_URL]", "https://t.co/abc": "[SHORT_URL]", "http://orbit.lyon/x": "http://orbit.lyon/x",
    }
    rows = spark.createDataFrame([(k,) for k in said], "text string").select("text", redact.redact_pii(F.col("text")).alias("r"))
    assert {r.text: r.r for r in rows.collect()} == said


def test_ranking_by_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 7)
    rng = random.Random(12)
    words = ["the", "of", *(f"w{k}" for k in range(25))]
    texts = {i: " ".join(rng.choice(words[: rng.randint(2, 27)]) for _ in range(rng.randint(1, 12))) for i in rng.sample(range(1000), 90)}
    d = docs(spark, [*texts.items(), (2001, None), (2002, "")])
    asked = {q: " ".join(["The", "of", *rng.sample(words, 3)][rng.randint(0, 2) :]) for q in range(20)}
    q = spark.createDataFrame([*asked.items(), (50, None), (51, "unknown")], "query_id int, query string")
    want = set()
    for n, text in asked.items():
        sought = set(text.lower().split())
        scores = {i: round(len(sought & set(t.split())) / len(sought), 6) for i, t in texts.items()}
        best = sorted((-s, i) for i, s in scores.items() if s)[:10]
        want |= {(n, i, -s, rank) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in retrieval.keyword_overlap(d, q).collect()} == want
    assert {tuple(r) for r in retrieval.keyword_overlap(d, q, most_sent=0).collect()} == want
    ranked = {(r.query_id, r.doc_id, r.rank): r.score for r in retrieval.bm25(d, q).collect()}
    joined = {(r.query_id, r.doc_id, r.rank): r.score for r in retrieval.bm25(d, q, most_sent=0).collect()}
    assert ranked == joined


def test_only_the_best_of_a_block_leave_it(spark):
    d = docs(spark, [(i, "the notes of a place") for i in range(3000)])
    q = spark.createDataFrame([(k, "the notes of") for k in range(40)], "query_id int, query string")
    plan = retrieval.keyword_overlap(d, q)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert retrieval.keyword_overlap(d, q).groupBy("query_id").count().where("count = 10").count() == 40


def no_words_leave_the_texts(spark, sf, name):
    from textquarry.plans import core_queries, more_queries

    plan = {**core_queries.QUERIES, **more_queries.QUERIES}[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    return "explode(" not in plan and plan.count("MapInArrow") >= 2


def test_linear_fusion_moves_no_words(spark, sf):
    assert no_words_leave_the_texts(spark, sf, "linear_fusion")


def test_variant_union_moves_no_words(spark, sf):
    assert no_words_leave_the_texts(spark, sf, "variant_union")


def test_rank_fusion_moves_no_words(spark, sf):
    assert no_words_leave_the_texts(spark, sf, "rank_fusion")


def test_terms_are_found_like_the_pattern_does():
    import re

    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    pool = ["a", "ab", "a\0", "abcdefgh", "abcdefghi", "abcdefghj", "abcdefghabcdefgh", "abcdefghabcdefgx", "7", "été", "naïve", "x" * 70, "x" * 71, "ab,", "\v"]
    texts = ["".join(rng.choice([*pool, *" \t\n\f\r,.-ß"]) for _ in range(rng.randint(1, 60))) for _ in range(300)] + [" ", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"]).slice(3)
    for pattern, inside in (("[a-z0-9]+", retrieval._in_terms), (r"[^ \t\n\r\f]+", retrieval._in_words)):
        found = {i: re.findall(pattern, t) for i, t in enumerate(texts) if i >= 3}
        terms = sorted({t for p in pool for t in re.findall(pattern, p)} | {"missing"})
        ((ids, [(sizes, hits, docs, n)]),) = retrieval._hit_blocks([batch], [retrieval.Sought(terms, inside)])
        assert sizes.tolist() == [len(found[i]) for i in ids]
        got = {(terms[t], ids[d]): c for t, d, c in zip(np.repeat(np.arange(len(terms)), hits), docs.tolist(), n.tolist())}
        assert got == {(t, i): words.count(t) for i, words in found.items() for t in terms if t in words}


def texts_are_read_once(spark, sf, name, monkeypatch):
    from textquarry.plans import core_queries, more_queries

    lowered, read = retrieval._lowered, []
    monkeypatch.setattr(retrieval, "_lowered", lambda *a: read.append(a) or lowered(*a))
    return {**core_queries.QUERIES, **more_queries.QUERIES}[name](spark, sf).count() and len(read) == 1


def test_lists_of_one_reading_equal_those_of_two(spark, sf):
    d = docs(spark, [*((i, " ".join(f"w{i * k % 11}" for k in range(i % 9))) for i in range(200)), (500, None), (501, "")])
    q = spark.createDataFrame([(1, "w1 w2 w3"), (2, "W4, w5 w4,"), (3, None), (4, "unknown")], "query_id int, query string")
    one = retrieval.lexical_lists(d, q)
    two = retrieval.bm25(d, q), retrieval.keyword_overlap(d, q)
    tables = retrieval.lexical_lists(d, q, most_sent=0)
    for a, b, c in zip(one, two, tables):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == sorted(map(tuple, c.collect()))
        assert a.columns == b.columns == c.columns and a.count()


def test_linear_fusion_reads_texts_once(spark, sf, monkeypatch):
    assert texts_are_read_once(spark, sf, "linear_fusion", monkeypatch)


def test_variant_union_reads_texts_once(spark, sf, monkeypatch):
    assert texts_are_read_once(spark, sf, "variant_union", monkeypatch)


def test_rank_fusion_reads_texts_once(spark, sf, monkeypatch):
    assert texts_are_read_once(spark, sf, "rank_fusion", monkeypatch)
