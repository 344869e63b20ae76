import random
from datetime import datetime

import pandas as pd

from textquarry.llm.subjects import FUNCTIONS, document_subjects, fit_latent, fit_lexicon

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, source_type string, source_path string, title string, created_at timestamp, subject string, hand int"
T = datetime(2025, 1, 1)
WORDS = {"law": ["verdict", "plaintiff", "statute", "appeal", "lease"], "sport": ["striker", "relay", "medal", "umpire", "league"], "cookery": ["onion", "skillet", "broth", "garlic", "flour"]}


def sentence(rng, s):
    a, b = rng.sample(WORDS[s], 2)
    return f"The {a} was {rng.choice(['kept', 'moved', 'named'])} before the {b} in {rng.choice(['May', 'June'])}."


def tables(spark, rows, labels, subjects=tuple(WORDS)):
    d = spark.createDataFrame([(i, t, "en", src, 1, "pdf", p, ti, T, "clash", 1) for i, t, src, p, ti in rows], DOCS)
    lab = spark.createDataFrame([(i, s, "a") for i, s in labels], "doc_id bigint, subject string, annotator string")
    return d, lab, spark.createDataFrame([(s, "d") for s in subjects], "subject string, description string")


def test_shares_decide_and_passing_mentions_do_not(spark):
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(400):
        a, b = rng.sample(list(WORDS), 2)
        n = rng.choice([0, 1, 4])
        parts = [sentence(rng, a) for _ in range(12 - n)] + [sentence(rng, b) for _ in range(n)]
        rng.shuffle(parts)
        truth[i] = {a, b} if n == 4 else {a}
        rows.append((i, " ".join(parts), f"src{i % 3}", f"x/{i}", None if i % 2 else f"Notes on {rng.choice(WORDS[a])}"))
    labels = [(i, s.upper() if i % 5 == 0 else f" {s}") for i in range(0, 120) for s in truth[i]] + [(3, "law"), (4, "nonsense"), (None, "law")]
    got = {}
    for r in document_subjects(*tables(spark, rows, labels)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    wrong = [i for i in truth if got.get(i, set()) != truth[i]]
    assert len(wrong) <= 4


def test_dirty_rows_and_empty_tables(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(sentence(rng, s) for _ in range(6)), None, None, None) for i, s in enumerate(["law", "sport", "cookery"] * 12)]
    rows += [(100, None, "s", "p", "t"), (101, "", "s", "p", "t"), (102, "12 34 56 !!", "s", "p", "t"), (None, rows[0][1], "s", "p", "t"), (103, rows[0][1], "s", "p", "t"), (103, rows[0][1], "s", "p", "t"), (104, rows[1][1] * 500, "s", "p", "t")]
    labels = [(i, s) for i, s in enumerate(["law", "sport", "cookery"] * 6)]
    got = sorted((r.doc_id, r.subject) for r in document_subjects(*tables(spark, rows, labels)).collect() if r.doc_id >= 100)
    assert got == [(103, "law"), (104, "sport")]
    assert document_subjects(*tables(spark, [], labels)).count() == 0
    assert document_subjects(*tables(spark, rows, [])).count() == 0
    assert document_subjects(*tables(spark, rows, labels, ())).count() == 0


def test_latent_model_weighs_functions():
    rows = [(5, 2, 0, 0, 0, 500), (5, 0, 0, 0, 0, 300), (5, 1, 0, 0, 0, 40), (1, 1, 0, 0, 0, 100), (1, 0, 0, 0, 0, 60), (4, 1, 0, 0, 0, 10), (3, 2, 0, 0, 0, 5), (2, 1, 0, 0, 1, 5)]
    fitted = fit_latent(pd.DataFrame(rows, columns=[*FUNCTIONS, "n"]))
    assert [p >= 0.5 for p in fitted["posterior"]] == [True, True, True, False, False, True, True, False]


def test_a_lexicon_joined_instead_of_sent(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(sentence(rng, s) for _ in range(6)), "s", f"x/{WORDS[s][0]}", f"Notes on {WORDS[s][1]}") for i, s in enumerate(["law", "sport", "cookery"] * 20)]
    labels = [(i, s) for i, s in enumerate(["law", "sport", "cookery"] * 8)]
    sent = {tuple(r) for r in document_subjects(*tables(spark, rows, labels)).collect()}
    assert len(sent) == 60 and {tuple(r) for r in document_subjects(*tables(spark, rows, labels), most_sent=0).collect()} == sent


def test_no_word_is_cut_from_the_lexicon(spark):
    counts = spark.createDataFrame([(f"w{k}", k % 3, float(4 + k % 5)) for k in range(3000)] + [("even", k, 9.0) for k in range(3)] + [("few", 0, 3.0)], "word string, subject int, n double")
    base = spark.createDataFrame([(k, 100.0) for k in range(3)], "subject int, size double")
    got = {r.word: r.subject for r in fit_lexicon(counts, base, 4).collect()}
    assert got == {f"w{k}": k % 3 for k in range(3000)}
