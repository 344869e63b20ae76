import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions.tokens import encoder
from textquarry.operators import analytics, chunking, dedup, governance, graph, questions, retrieval, trees

EMPTY = "doc_id bigint, text string"


def test_token_windows_hold_every_character(spark):
    random.seed(3)
    texts = ["".join(random.choice(["a", "the ", "漢字", "🙂", "é", "\n", " 12"]) for _ in range(120)) for _ in range(20)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    got = {}
    for r in chunking.token_chunks(df, 16, 4).collect():
        assert r.chunk == texts[r.doc_id][r.start_index : r.end_index]
        got.setdefault(r.doc_id, []).append((r.chunk_seq, r.start_index, r.end_index))
    for i, t in enumerate(texts):
        if not t:
            assert i not in got
            continue
        spans = [x[1:] for x in sorted(got[i])]
        assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
        assert len(spans) == len(range(0, len(encoder().encode_ordinary(t)), 12))
    assert chunking.token_chunks(df, 16, 4, folder=None).count() == chunking.fixed_chunks(df, 64, 16).count()


def test_strategies_by_name(spark):
    df = spark.createDataFrame([(1, "One. Two. Three.")], EMPTY)
    assert chunking.chunk(df, "sentence_window", size=1, overlap=0).count() == 3
    with pytest.raises(ValueError):
        chunking.chunk(df, "none")


def test_vector_classes_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    x = [(centres[i % 12] + rng.normal(size=6) * 0.15).astype(np.float32).tolist() for i in range(150)]
    rows = [(i, v) for i, v in enumerate(x)] + [(1000 + k, x[0]) for k in range(60)] + [(2000, None), (2001, [0.0] * 6), (2002, [float("nan")] * 6)]
    got = {r.vec_id: (r.class_id, r.links) for r in dedup.vector_classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), 0.92, block_rows=40).collect()}
    u = np.array(x, dtype=float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = np.round(u @ u.T, 9) >= 0.92
    np.fill_diagonal(near, False)
    label = list(range(150))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(near)):
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    assert {i: got[i] for i in range(150)} == {i: (label[i], int(near[i].sum())) for i in range(150)}
    assert all(got[1000 + k] == got[0] for k in range(60)) and len(got) == 210
    assert dedup.vector_classes(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_cached_answers(spark):
    cache = spark.createDataFrame([(1, "What is X?", [1.0, 0.0], None), (2, "old", [0.0, 1.0], datetime(2001, 1, 1)), (3, "other", [0.7, 0.7], None)], "cached_id bigint, query string, embedding array<float>, expires timestamp")
    q = spark.createDataFrame([(10, "what is x?", [0.0, 1.0]), (11, "near", [0.71, 0.7]), (12, "far", [-1.0, 0.0])], "query_id bigint, query string, embedding array<float>")
    assert {(r.query_id, r.cached_id) for r in retrieval.cached_answers(q, cache).collect()} == {(10, 1), (11, 3)}


def test_hashed_embeddings_have_length_one(spark):
    e = retrieval.hashed_embeddings(spark.createDataFrame([(1, "a b c a"), (2, ""), (3, None)], EMPTY), 16).collect()
    assert [r.doc_id for r in e] == [1] and np.linalg.norm(e[0].embedding) == pytest.approx(1, abs=1e-4)


def test_reports(spark):
    now = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.7)], "metric string, value double")
    old = spark.createDataFrame([("a", 0.6), ("b", 0.8), ("c", 0.69)], "metric string, value double")
    assert {r.metric: r.verdict for r in analytics.regressions(now, old).collect()} == {"a": "regression", "b": "improvement", "c": "same"}
    steps = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.9)], "question_id int, step int, confidence double")
    assert analytics.step_confidence(steps).collect()[0].confidence == pytest.approx(0.6)
    noise = spark.range(2000).select((analytics.laplace_noise(F.lit(0.0), F.col("id"))).alias("n")).toPandas()["n"]
    assert abs(noise.mean()) < 0.15 and abs(noise.abs().mean() - 1) < 0.15


def test_questions(spark):
    h = spark.createDataFrame([(1, 0.4)] * 5 + [(2, 0.6)] * 5 + [(3, 0.1)], "session_id int, confidence double")
    assert {r.session_id: (r.top_k, r.hyde, r.multi_query) for r in questions.tuned(h).collect()} == {1: (10, True, True), 2: (7, False, True), 3: (5, False, False)}
    d = spark.createDataFrame([("the patient and the clinic",), ("a contract",), ("none",)], "t string")
    assert [r[0] for r in d.select(questions.domain(F.col("t"))).collect()] == ["medical", "legal", "general"]


def test_related_entities_and_matches(spark):
    nodes = spark.createDataFrame([("1", "Ann Smith", "works in Paris"), ("2", "Bob Jones", None), ("3", "Cara Lane", None)], "node string, label string, metadata string")
    edges = spark.createDataFrame([("1", "2", "r", 1.0), ("2", "3", "r", 1.0)], "source string, target string, relation string, weight double")
    q = spark.createDataFrame([(7, "Where does Smith live?"), (8, "nothing")], "query_id int, query string")
    assert [(r.query_id, r.label) for r in graph.related_entities(q, nodes, edges).collect()] == [(7, "Bob Jones")]
    assert {(r.node, r.score) for r in graph.node_matches(nodes, ["ann", "paris"]).collect()} == {("1", 3)}


def test_plans_for_files(spark):
    a = spark.createDataFrame([("new", "1"), ("same", "2"), ("other", "3")], "path string, md5 string")
    b = spark.createDataFrame([("same", "2"), ("other", "4")], "path string, md5 string")
    assert {(r.path, r.action) for r in governance.copy_plan(a, b).collect()} == {("new", "copy"), ("other", "overwrite")}
    assert {(r.path, r.action) for r in governance.copy_plan(a, b, overwrite=False).collect()} == {("new", "copy")}
    f = spark.createDataFrame([("a.PDF", 5), ("b.exe", 5), ("c.pdf", 0)], "p string, n bigint")
    assert [r[0] for r in f.select(governance.file_verdict(F.col("p"), F.col("n"), ["pdf"])).collect()] == ["ok", "extension", "empty"]


def test_tree_search_and_made_examples(spark):
    n = spark.createDataFrame([(1, "L0_0", 0, "the red house"), (1, "L1_0", 1, "the red house and more"), (1, "L0_1", 0, "blue")], "doc_id int, node_id string, level int, text string")
    assert [r.node_id for r in trees.node_scores(n, "red house").collect()] == ["L0_0", "L1_0"]
    d = spark.createDataFrame([(1, "Granite Mountain stands over the long valley. Every traveller knows the Granite road by heart, they say."), (2, "short")], EMPTY)
    made = trees.made_examples(d).collect()
    assert made and all("Granite" in r.instruction or "Every" in r.instruction for r in made) and {r.doc_id for r in made} == {1}
    boxes = spark.createDataFrame([(1, 1, 0.0, 2.0, "c"), (1, 1, 0.0, 1.0, "a"), (1, 1, 9.0, 1.0, "b")], "doc_id int, page int, x0 double, y0 double, text string")
    assert [(r.text, r.side) for r in trees.reading_order(boxes).orderBy("place").collect()] == [("a", "left"), ("b", "right"), ("c", "left")]
