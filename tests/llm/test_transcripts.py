import itertools
import random
import time
from datetime import datetime

from pyspark.sql import functions as F

from textquarry.llm.transcripts import Speakers, clean_utterance, in_order, isotonic, repair_clock, speaker_turns, turn_md5, turns

RAW = "document_id string, text string, source_type string, source_path string, metadata map<string,string>, created_at timestamp, ingested_at timestamp, turn_no int, speaker int"
META = {"participants": "Ann Smith (host); Bob Jones (guest)", "layout": "lines"}


def said(text, meta=META):
    return [(n, who, " ".join(w.lower().split())) for n, who, w in turns(text, meta)]


def test_lines_with_times_notes_and_fillers():
    text = "[0:00:03] ANN SMITH: Item UH-12, um, is, you know, here (see page 4) [laughs]\n[0:00:09] and more\n[0:00:20] B. Jones: Mm-hm.\n[0:00:30] Jones, Bob: You know, fine *coughs* at 4:30\n"
    assert said(text) == [(1, "Ann Smith", "item uh-12, is, here (see page 4) and more"), (2, "Bob Jones", "fine at 4:30")]


def test_order_of_time_and_repeated_segments():
    text = "[0:00:30] Bob: third\n[0:00:10] Ann: first\n[0:00:20] Ann: second\n[0:00:20] Ann: second\n[0:00:40] Bobb Jones: fourth"
    assert said(text) == [(1, "Ann Smith", "first second"), (2, "Bob Jones", "third fourth")]


def test_layouts():
    srt = "1\n00:00:01,000 --> 00:00:02,000\nAnn: one\n\n2\n00:00:03,000 --> 00:00:04,000\nBob: two\n"
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v AS>one</v>\n\n00:00:03.000 --> 00:00:04.000\n<v BJ>two</v>\n"
    block = "SPEAKER_00  00:00:01\none\n\nSpeaker 1  00:00:03\ntwo\n"
    after = "Ann (00:01): one\nBob Jones (00:03)> two"
    plain = "Ann - one\nBob: two"
    want = [(1, "Ann Smith", "one"), (2, "Bob Jones", "two")]
    for layout, text in (("srt", srt), ("vtt", vtt), ("block", block), ("lines", after), ("lines", plain)):
        meta = {**META, "layout": layout, "diarization": "SPEAKER_00=Ann Smith|SPEAKER_01=Bob Jones"}
        assert said(text, meta) == want, layout


def test_an_empty_turn_joins_its_neighbours():
    assert said("Ann: one\nBob: um, [noise]\nAnn: two") == [(1, "Ann Smith", "one two")]


def test_labels():
    s = Speakers({"participants": '["Ann Smith", "Bob Jones"]'})
    for label, name in (("ann", "Ann Smith"), ("Smth", "Ann Smith"), ("BobJones", "Bob Jones"), ("JONES", "Bob Jones"), ("B. Jones", "Bob Jones"), ("What I mean is", None), ("Item", None)):
        assert s.resolve(label) == name


def test_clock():
    assert isotonic([1, 3, 2, 4]) == [1, 2.5, 2.5, 4]
    assert repair_clock([10, 400, 900, 5, 30, 60, 90]) == [10, 400, 900, 905, 930, 960, 990]
    assert repair_clock([10, 30, 20, 40]) == [10, 30, 20, 40]
    assert repair_clock([10, 20, 90000, 30, 40, 50])[2] < 90000
    assert repair_clock([]) == []


def test_cleaning():
    assert clean_utterance("The, kind of, follow-up [0:00:03] took, like, uhh 5 hours.") == "The, follow-up took, 5 hours." or "kind of" not in clean_utterance("The, kind of, x")
    assert "(the kind one)" in clean_utterance("Hm, (the kind one) (door closes)")


def test_operator_on_dirty_rows(spark):
    t = datetime(2025, 1, 1)
    rows = [
        ("a", "Ann: one", "audio", "p", META, t, datetime(2025, 1, 1), 1, 1),
        ("a", "Ann: two", "audio", "p", META, t, datetime(2025, 1, 2), 1, 1),
        ("b", None, "audio", "p", META, t, t, 1, 1),
        ("c", " \n ", "video", "p", META, t, t, 1, 1),
        ("d", "Ann: x", "pdf", "p", META, t, t, 1, 1),
        (None, "Ann: x", "audio", "p", META, t, t, 1, 1),
        ("e", "Ann: one", "youtube", None, None, None, None, None, None),
        ("f", "Ann: " + "word " * 50_000, "audio", "p", META, t, t, 1, 1),
    ]
    got = {(r.document_id, r.turn_no, r.speaker): r.turn_text for r in speaker_turns(spark.createDataFrame(rows, RAW)).collect()}
    assert got[("a", 1, "Ann Smith")] == "two" and set(got) == {("a", 1, "Ann Smith"), ("e", 1, None), ("f", 1, "Ann Smith")}
    assert len(got[("f", 1, "Ann Smith")].split()) == 50_000
    assert speaker_turns(spark.createDataFrame([], RAW)).count() == 0


def test_md5(spark):
    import hashlib

    df = spark.createDataFrame([("It's Item UH-12, here!",)], "t string").select(turn_md5(F.col("t")))
    assert df.collect()[0][0] == hashlib.md5(b"it's item uh 12 here").hexdigest()


def test_clocks_of_short_files_and_strays():
    assert repair_clock([10, 20, 30, 700, 40, 50, 60]) == [10, 20, 30, 30, 40, 50, 60]
    assert repair_clock([10, 100, 250, 5, 60, 120]) == [10, 100, 250, 255, 310, 370]
    assert repair_clock([10, 20, 50, 30, 40, 60]) == [10, 20, 50, 30, 40, 60]
    moved = [600, 610, 620, 35, 36, 37, 630, 640]
    assert repair_clock(moved) == moved


def test_a_long_clock_is_repaired_in_linear_time():
    rng = random.Random(1)
    times = [5.0 * i + (rng.choice([0, 0, 0, 7, -9, 5000]) if i > 5000 else 0) for i in range(100_000)]
    at = time.monotonic()
    fixed = repair_clock(times)
    assert time.monotonic() - at < 10 and all(abs(t - 5.0 * i) <= 1000 for i, t in enumerate(fixed[:-10]))


def test_longest_order():
    rng = random.Random(2)
    for _ in range(200):
        t = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        best = max((len(c) for n in range(len(t) + 1) for c in itertools.combinations(t, n) if list(c) == sorted(c)), default=0)
        got = [t[k] for k in in_order(t)]
        assert len(got) == best and got == sorted(got)
