import random
from datetime import datetime

import pytest

from textquarry.llm.pairs import compressed_share, first_label, is_copy, is_empty, is_refusal, is_wrong_language, open_end, pair_defects, shared_words, terminal_contexts

SCHEMA = "example_id bigint, instruction string, input string, output string, context string, source string, metadata map<string,string>, created_at timestamp, defect string, last int"


@pytest.mark.parametrize("text,empty", [(None, True), ("", True), (" \n\u200b", True), ("N/A", True), ("<answer></answer>", True), ("Answer:", True), ("...", True), ("no", False), ("Yes.", False), ("7", False)])
def test_empty(text, empty):
    assert is_empty(text) is empty


@pytest.mark.parametrize(
    "text,refusal",
    [
        ("I'm sorry, but I can't help with that.", True),
        ("Als Sprachmodell kann ich dazu nichts sagen.", True),
        ("Je préfère ne pas aborder ce sujet.", True),
        ("Prefiero no hablar de ese tema.", True),
        ('Asked about it, the clerk says "I\'m sorry, I can\'t help", and goes.', False),
        ("The lease cannot be confirmed before June.", False),
    ],
)
def test_refusal(text, refusal):
    assert is_refusal(text) is refusal


@pytest.mark.parametrize(
    "text,refusal",
    [
        ("Thank you for asking about the loan. Regrettably, a reply is not possible.", True),
        ("Thank you for asking about the yeast. Regrettably, a reply is not possible. Is there anything else you need?", True),
        ("Hello! Good question. I understand why you ask. I can't help with that. Please ask about something else.", True),
        ("Vielen Dank für die Frage. Leider kann ich dazu nichts sagen. Kann ich sonst etwas tun?", True),
        ("Merci pour votre question. Je ne peux pas répondre.", True),
        ("Gracias por preguntar. Lo siento, no puedo ayudar.", True),
        ("The loan was heavy in May. I cannot say more about it.", False),
        ("Thank you for asking. The loan was repaid in May. I cannot say more.", False),
        ("Thanks to the magnet the laser was light. I cannot say more.", False),
        ('Thank you for asking. The clerk said "Regrettably, a reply is not possible."', False),
        ("Thank you for asking. Is it so?", False),
    ],
)
def test_refusal_after_an_opener(text, refusal):
    assert is_refusal(text) is refusal


def test_copies_and_quotations():
    ask, given = "Explain the key points about the magnet.", "The magnet was heavy. The laser was light. Nobody measured the genome in May."
    assert is_copy(ask, given, "Question: " + ask) and is_copy(ask, given, "explain  the key points about magnet") and is_copy(ask, given, f"{ask} {ask}")
    assert is_copy(ask, given, given.upper()) and is_copy(ask, given, f"{ask}\n{given}")
    assert not is_copy(ask, given, "The laser was light.") and not is_copy(ask, given, "The orbit was described twice before the photon came.")
    assert not is_copy(None, None, "text") and compressed_share(given, given) < 0.3


def test_copies_said_many_times():
    ask, given = "Explain the key points about the magnet.", "The magnet was heavy. The laser was light. Nobody measured the genome in May."
    for n in (5, 6, 7, 40, 2000):
        assert is_copy(ask, "", " ".join([ask] * n)) and is_copy(ask, given, " ".join([given] * n))
    assert is_copy(ask, "", " ".join([ask, "explain key points about the magnet", ask] * 5)) and is_copy("Say it.", "", "Say it. " * 9)
    assert not is_copy(ask, "", "The key to the magnet lies in its poles, about which the points of the needle turn. " * 9)
    assert not is_copy("Describe it.", "", "word " * 60_000)


def test_languages():
    german = "Für 133 Besucher war das Skript besonders genau."
    assert is_wrong_language("Describe the script in detail.", None, german)
    assert not is_wrong_language("Translate the following sentence into German.", "The script was exact.", german)
    assert is_wrong_language("Translate the following sentence into French.", "The script was exact.", german)
    assert not is_wrong_language("Wie ist das Skript?", "", german)
    assert not is_wrong_language(None, None, german)


def test_ends():
    assert open_end("All is said.")[0] is False and open_end("See also: cats")[0] is False and open_end("no")[0] is False
    assert open_end("```\nfor x in y:\n    total +")[0] is True and open_end("The keeper of the door wrote,")[0] is True
    assert open_end("the plan assumes a stable par") == (None, "stable", "par")


def test_ends_of_lists(spark):
    steps = "1. Open the lid of the pump.\n2. Take out the old filter.\n3. Then remove the"
    assert open_end(steps) == (None, "remove", "the") and open_end("- the laser\n- the magnet was heavy in") == (None, "heavy", "in")
    assert open_end("1. Open the lid of the pump.\n2. Take out the filter.\n3. Then")[0] is None
    assert open_end("- cats\n- dogs\n- old horses")[0] is False and open_end("Three pets:\n1. cats\n2) dogs")[0] is False
    tools = "- take the old filter\n- clean the new pump\n- take the old filter\n- clean the new pump"
    rows = [(1, "Describe it.", steps), (2, "Describe the tools.", tools), (3, "Name pets.", "Here are some pets:\n- cats\n- dogs")]
    df = spark.createDataFrame([(i, a, None, c, None, "s", None, datetime(2025, 1, 1), "clash", 1) for i, a, c in rows], SCHEMA)
    assert {r.example_id: r.defect for r in pair_defects(df).collect()} == {1: "truncated"}


def test_one_label_each(spark):
    t = datetime(2025, 1, 1)
    whole = "The script was exact in May. The server was heavy in June."
    rows = [
        (1, "Describe the server.", "", None, None),
        (2, "Describe the server.", None, "I cannot answer questions about the server.", None),
        (3, "Describe the server in May.", "", "describe the server in may", None),
        (4, "Describe the server.", "", "Das Skript war im Mai besonders genau und schwer.", None),
        (5, "Describe the server.", "", "The script was exact in May. The server was", whole),
        (6, "Describe the server.", "", "The script was exact in June", whole),
        (7, "Describe the server.", "", whole, whole),
        (7, "Describe the server.", "", whole, whole),
        (8, None, None, whole, whole),
        (None, "a", "b", "", None),
        (9, "Describe it.", "", "word " * 60_000 + "end.", None),
    ]
    df = spark.createDataFrame([(i, a, b, c, d, "s", None, t, "clash", 1) for i, a, b, c, d in rows], SCHEMA)
    got = {r.example_id: r.defect for r in pair_defects(df).collect()}
    assert got == {1: "empty", 2: "refusal", 3: "copy", 4: "wrong_language", 5: "truncated"}
    assert pair_defects(df.limit(0)).count() == 0


def test_order_of_labels():
    assert first_label("Describe the server.", "", "Es tut mir leid, dabei kann ich nicht helfen.")[0] == "refusal"


@pytest.mark.parametrize(
    "text,refusal",
    [
        ("Let us talk about something other than the basil, if you don't mind.", True),
        ("Let's change the subject.", True),
        ("Lassen Sie uns über etwas anderes sprechen.", True),
        ("Reden wir lieber über etwas anderes.", True),
        ("Parlons plutôt d'autre chose.", True),
        ("Hablemos de otra cosa.", True),
        ("Let us say that the basil was divided twice.", False),
        ("The subject of the letter is the loan.", False),
    ],
)
def test_a_change_of_subject_is_a_refusal(text, refusal):
    assert is_refusal(text) is refusal


@pytest.mark.parametrize(
    "output",
    [
        "Il quadro fu dipinto molto tempo fa da un maestro che viveva vicino al fiume. Nessuno sapeva perché.",
        "Obraz został namalowany dawno temu przez mistrza, który mieszkał nad rzeką i nikt nie wiedział dlaczego to zrobił.",
        "Картина была написана давно мастером, который жил у реки.",
        "Het schilderij werd lang geleden gemaakt door een meester die bij de rivier woonde en niemand wist waarom.",
    ],
)
def test_languages_that_no_list_has(output):
    assert is_wrong_language("Who painted the picture and why was it done?", None, output)
    assert not is_wrong_language(None, None, output)


def test_names_code_and_short_answers_are_no_other_language():
    for output in ("Rembrandt, Vermeer, Hals, Steen, Fabritius", "Paris", "total = total + 1", "Yes, in 1904."):
        assert not is_wrong_language("Who painted the picture?", None, output)


def test_the_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        assert shared_words(a, b) == row[-1]


def test_contexts_of_the_asked_words_only(spark):
    rows = spark.createDataFrame([("One two three. Four two three five.", None, "two three.", "")], "instruction string, input string, output string, context string")
    every = {tuple(r) for r in terminal_contexts(rows).collect()}
    asked = spark.createDataFrame([("three",)], "last string")
    assert {tuple(r) for r in terminal_contexts(rows, asked).collect()} == {r for r in every if r[1] == "three"} == {("two", "three", 2, 3)}
    assert {tuple(r) for r in terminal_contexts(rows, asked, most_asked=0).collect()} == every
