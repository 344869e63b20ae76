import random

import pytest

from textquarry.llm.leakage import build_index, find_in_batch, leaked_items, words_of

DOC = "doc_id bigint, text string, item_id string, key int"
ITEM = "item_id bigint, passage string, question string, doc_id int"


def items(spark, rows):
    return spark.createDataFrame([(i, p, "q", 1) for i, p in rows], ITEM)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOC)


def found(spark, d, i, **k):
    return {tuple(r) for r in leaked_items(docs(spark, d), items(spark, i), **k).collect()}


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("ban", "cet", "dil", "fop", "gur", "hax", "jem")]


def test_whole_part_and_altered_passages(spark):
    rng = random.Random(4)
    passages = [text(rng, 90) for _ in range(30)]
    d, want = [], set()
    for k, p in enumerate(passages):
        w = p.split()
        altered = [rng.choice(WORDS) if rng.random() < 0.06 else x for x in w if rng.random() > 0.02]
        part = w[10:65]
        third = w[20:50]
        d.append((10 * k, text(rng, 40) + ". " + " ".join(altered).upper().replace(" ", ",\n", 5) + "; " + text(rng, 40)))
        d.append((10 * k + 1, text(rng, 30) + " " + " ".join(part)))
        d.append((10 * k + 2, " ".join(third) + " " + text(rng, 60)))
        want |= {(10 * k, k), (10 * k + 1, k)}
    d += [(5000 + k, text(rng, 300)) for k in range(20)]
    assert found(spark, d, list(enumerate(passages))) == want
    assert found(spark, d, list(enumerate(passages)), most_words=200) == want


def test_nulls_empty_repeats_and_short_passages(spark):
    d = [(1, None), (2, ""), (3, "alpha beta gamma delta epsilon"), (3, "alpha beta gamma delta epsilon"), (4, "x" * 200_000), (None, "alpha beta gamma delta epsilon"), (5, "one two")]
    i = [(1, "Alpha, beta gamma DELTA epsilon!"), (1, "Alpha, beta gamma DELTA epsilon!"), (2, None), (3, ""), (None, "alpha"), (4, "two"), (5, "!!")]
    assert found(spark, d, i) == {(3, 1), (None, 1), (5, 4)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c d e f")]) == set()
    assert found(spark, [(1, "a b c d e f")], []) == set()


def test_many_copies_of_one_passage(spark):
    p = text(random.Random(1), 80)
    assert found(spark, [(k, p) for k in range(500)], [(7, p), (8, p)]) == {(k, i) for k in range(500) for i in (7, 8)}


def test_words():
    assert words_of("It's 5-fold, ÄÖ_x") == ["it", "s", "5", "fold", "äö", "x"]


MANY = [f"{a}{b}" for a in WORDS for b in WORDS[:24]]


def recall(n, altered, trials=200):
    rng = random.Random(n)
    passages = [[rng.choice(MANY) for _ in range(n)] for _ in range(trials)]
    index = build_index([(k, " ".join(p)) for k, p in enumerate(passages)])
    texts = [" ".join([rng.choice(MANY) for _ in range(50)] + altered(rng, p) + [rng.choice(MANY) for _ in range(50)]) for p in passages]
    found = set(find_in_batch(index, texts))
    return sum((k, k) in found for k in range(trials)) / trials


@pytest.mark.parametrize("n", [40, 60, 90])
def test_recall_with_changed_words(n):
    for rate in (0.1, 0.2, 0.25, 0.3):
        assert recall(n, lambda rng, p: [rng.choice(MANY) if rng.random() < rate else w for w in p]) >= 0.9, rate
    for every in (3, 4, 5, 6, 7):
        assert recall(n, lambda rng, p: [rng.choice(MANY) if k % every == every - 1 else w for k, w in enumerate(p)]) >= 0.99, every


def test_words_put_in_the_middle():
    for more in (5, 12, 13, 25):
        assert recall(90, lambda rng, p: p[:27] + [rng.choice(MANY) for _ in range(more)] + p[27:54]) >= 0.99, more
    assert recall(90, lambda rng, p: p[:40]) == 0


def test_the_frame_of_usual_sentences_is_no_leak(spark):
    rng = random.Random(3)
    frame = "Some say the {} came first and others point to the {} of {}. Visitors ask about the {} more often than about the {} here."
    of = lambda: frame.format(*(rng.choice(MANY) for _ in range(5)))
    passages = [of() for _ in range(30)]
    d = [(k, text(rng, 20) + " " + of()) for k in range(20)] + [(100 + k, text(rng, 20) + " " + p) for k, p in enumerate(passages)]
    want = {(100 + k, k) for k in range(30)}
    assert found(spark, d, list(enumerate(passages))) == want
    assert found(spark, d, list(enumerate(passages)), most_words=10) == want


def test_hits_of_a_frequent_seed_come_in_parts():
    rng = random.Random(8)
    shared = text(rng, 12)
    passages = [f"{shared} {text(rng, 20)}" for _ in range(40)]
    texts = [" ".join([shared] * 30) + " " + passages[3], passages[5], text(rng, 50), shared]
    index = build_index(list(enumerate(passages)))
    whole = find_in_batch(index, texts)
    assert {(0, 3), (1, 5)} <= set(whole)
    for most in (300, 2000):
        assert find_in_batch(index, texts, most_hits=most) == whole
