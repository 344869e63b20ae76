import json
import random
import time
from datetime import datetime

from pyspark.sql import functions as F

from textquarry.llm.scans import LIKE, LOOKALIKES, MISREADINGS, SCAN_TYPES, EdgeLines, Scan, _ratio, candidates, digits_right, joined, kinds_of, scan_repairs, second_candidates, strokes

RAW = "document_id string, text string, source_type string, source_path string, metadata map<string,string>, created_at timestamp, ingested_at timestamp, line_no int, word string"
T = datetime(2025, 1, 1)

PAGES = [
    "Alpha Review   7\n\nThe keeper of the garden wrote about the tree every sin-\ngle morning. The tree was well-\nknown in the town.\n\nThe garden was open until\n",
    "Alpha Revicw   8\nmay. The keeper of tbe tree was often seen\nin 1904.\n\n2. Garden House\n\nThe house was old.\n",
    "Alpha Review   9\n\nThe tree was open. Every single morning the\nkeeper wrote.\n9\n",
]
CLEAN = "the keeper of the garden wrote about the tree every single morning in the town " * 20 + "well-known " * 30


def breaks(pages):
    at, out = 0, []
    for p in pages[:-1]:
        at += len(p)
        out.append(at)
    return json.dumps(out)


def raw(spark, rows):
    return spark.createDataFrame([(i, t, k, "p", m, T, T, 1, "clash") for i, t, k, m in rows], RAW)


def found(spark, rows):
    return {tuple(r) for r in scan_repairs(raw(spark, rows)).collect()}


def test_all_kinds_of_repair(spark):
    for text, meta in (("".join(PAGES), {"page_breaks": breaks(PAGES)}), ("\f\n".join(PAGES), {})):
        got = found(spark, [("a", text, "pdf", meta), ("clean", CLEAN, "docx", {})])
        lines = text.split("\n")
        at = lambda s: lines.index(s) + 1
        assert {x for x in got if x[2] == "drop"} == {("a", at("Alpha Review   7"), "drop", ""), ("a", at("Alpha Revicw   8"), "drop", ""), ("a", at("Alpha Review   9"), "drop", ""), ("a", at("9"), "drop", "")}
        assert {x[3] for x in got if x[2] == "join"} == {"single", "well-known"}
        assert {x for x in got if x[2] == "misread"} == {("a", at("may. The keeper of tbe tree was often seen"), "misread", "the")}
        assert {lines[x[1] - 1][:10] for x in got if x[2] == "para"} == {"The keeper", "The garden", "2. Garden ", "The house ", "The tree w"}


def test_dirty_rows(spark):
    rows = [("a", None, "pdf", {}), ("b", "", "image", {}), ("c", " \n\f\n ", "pdf", None), ("d", "One line only", "pdf", {"page_breaks": "no json"}), (None, "x", "pdf", {}), ("e", "speech", "audio", {}), ("f", "word " * 50_000, "pdf", {}),
            ("g", "Twice told.", "pdf", {}), ("g", "Twice told.", "pdf", {})]
    assert found(spark, rows) == {("d", 1, "para", ""), ("f", 1, "para", ""), ("g", 1, "para", "")}
    assert found(spark, []) == set()


def test_indented_paragraphs():
    s = Scan("   First line of text\nsecond line here.\n   Another begins here\nand ends.", {})
    assert s.paragraphs() == [0, 2]


def test_words():
    assert joined("GN".lower(), "-", "8249", {}, {}) == "gn-8249"
    assert joined("long", "-", "term", {"long-term": 9, "longterm": 1}, {}) == "long-term"
    assert joined("rebe", "¬", "llion", {}, {}) == "rebellion"
    assert joined("rejee", "-", "ted", {"rejected": 50}, {"rejeeted": "rejected"}) == "rejected"
    assert digits_right("i89") == "189" and digits_right("da-48l8") == "da-4818" and digits_right("189") is None and digits_right("oil") is None
    assert {"rejected", "endpoint", "warned"} <= candidates("rejeeted") | candidates("cndpoint") | candidates("vvarned")


def test_words_misread_in_two_ways(spark):
    assert "polymer" in second_candidates("p01ymer") and "polymer" not in candidates("p01ymer") and "modern" in second_candidates("rnodem")
    pages = "\n".join(["The polymer was held in a modern hall and kept"] * 20) + "\nThe p01ymer was seen in the hall by a zebra and kept.\n"
    rows = [("d", pages, "scan", None, None, T, T, 1, "w")]
    types = spark.createDataFrame(rows, RAW).withColumn("source_type", F.lit(SCAN_TYPES[0]))
    got = {(r.line_no, r.repaired) for r in scan_repairs(types).collect() if r.repair == "misread"}
    assert got == {(21, "polymer")}


def test_edge_lines_alike_equal_a_plain_comparison():
    rng = random.Random(5)
    base = ["review of the garden", "the house by the lake", "short"]
    on = {}
    for page in range(60):
        s = rng.choice(base)
        s = "".join(rng.choice("abcxyz") if rng.random() < 0.1 else c for c in s) if rng.random() < 0.7 else "".join(rng.choice("abcdefgh ") for _ in range(20)).strip()
        on.setdefault(s, set()).add(page)
    lines = EdgeLines(on)
    for s, pages in on.items():
        for page in pages:
            other = {}
            for t, there in on.items():
                for p in there - {page}:
                    other[p] = max(other.get(p, 0.0), _ratio(s, t))
            best, close = lines.alike(s, page)
            assert (best if best >= LIKE else 0.0) == (m if (m := max(other.values(), default=0.0)) >= LIKE else 0.0)
            assert close == min(2, sum(r >= 0.9 for r in other.values()))


def test_a_scan_of_thousands_of_pages():
    text = "\f\n".join(f"Alpha Review   {k}\n\nThe {k} words of page {chr(97 + k % 26) * (k % 9 + 1)} stand here and\ngo on below {k * 7919}.\nThe end of {chr(97 + k % 7)} came.\n" for k in range(1, 3001))
    at = time.monotonic()
    s = Scan(text, {})
    assert all(d for d, line in zip(s.dropped, s.lines) if line.startswith("Alpha")) and time.monotonic() - at < 60


def test_words_with_many_places_of_one_misreading():
    assert "millimillillian" in candidates("mi11imi1lillian") and "sillibillimillivil" in candidates("sillibi11imil1ivil")


def test_misreadings_keep_the_form_of_strokes(spark):
    pairs = [(f"ka{a}{x}{b}po", f"ka{a}{y}{b}po") for x, y in MISREADINGS for a in ("", "i", "v", "c", "r") for b in ("", "i", "v", "l", "n")]
    pairs += [(f"t{chr(x)}k", f"t{y}k") for x, y in LOOKALIKES.items()] + [("p01ymer", "polymer")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", strokes(F.col("a")).alias("x"), strokes(F.col("b")).alias("y"))
    assert rows.where("x <> y").collect() == []
    assert dict(kinds_of("p01ymer", ["polymer", "palmer"])) == {"polymer": 2} and dict(kinds_of("tbe", ["the", "toe"])) == {"the": 1}
