"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scripts and letter ranges that tell them apart.
SCRIPTS = {
    "arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]",
    "cjk": r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]",
    "cyrillic": r"[\x{0400}-\x{04FF}]",
    "devanagari": r"[\x{0900}-\x{097F}]",
    "greek": r"[\x{0370}-\x{03FF}]",
    "hangul": r"[\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}]",
    "hebrew": r"[\x{0590}-\x{05FF}]",
    "kana": r"[\x{3040}-\x{30FF}]",
    "latin": r"[A-Za-z]",
    "latin_extended": r"[\x{00C0}-\x{024F}]",
    "thai": r"[\x{0E00}-\x{0E7F}]",
}


def strip(text: Column) -> Column:
    """Text without blanks and line ends at either end."""
    return F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def clean_text(text: Column) -> Column:
    """Runs of blanks as one space, at most one empty line in a row, ends trimmed; null stays null."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def split_words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def ascii_terms(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def compressed_tokens(text: Column) -> Column:
    """1.33 tokens a word, cut to a whole number."""
    return F.floor(F.size(split_words(text)) * 1.33).cast("bigint")


def syllables(word: Column) -> Column:
    """Groups of vowels, 1 at least for a word with letters or digits, 0 without."""
    bare = F.regexp_replace(F.lower(word), r"[^a-z0-9]", "")
    return F.when(bare == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiouy]+"))))


def syllables_of(words: Column) -> Column:
    """The sum of syllables over an array of words, from two scans of the joined words.

    Groups of vowels, plus the words that have letters or digits but no vowel.
    """
    joined = F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-z0-9 ]", "")
    return F.regexp_count(joined, F.lit("[aeiouy]+")) + F.regexp_count(joined, F.lit("(?<![^ ])[b-df-hj-np-tv-xz0-9]+(?![^ ])"))


def sanitise_input(text: Column, most: int = 100_000) -> Column:
    """Text without control characters other than tab and line ends, cut to ``most`` characters."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), 1, most)


def script_of(text: Column) -> Column:
    """The script with the most characters (ties: the first by name); null without any."""
    counts = F.array(*(F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(s).alias("script")) for s, p in SCRIPTS.items()))
    best = F.reduce(counts, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("script")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    return best["script"]


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.floor(seconds).cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s % 60)))


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with words, density, readability (Flesch, 0 to 100; 50 where it can't be told) and overall.

    The words are split once in a stage of their own, which the optimiser keeps because later
    columns use them more than once.
    """
    text = F.col(text_col)
    one = docs.withColumns({"_words": split_words(text), "_n": F.coalesce(F.length(text), F.lit(0)), "_ends": F.regexp_count(text, F.lit("[.!?]"))})
    two = one.withColumns(
        {
            "words": F.coalesce(F.size("_words"), F.lit(0)),
            "_spoken": syllables_of(F.slice("_words", 1, 1000)),
            "density": F.when(F.col("_n") > 0, F.least(F.lit(100), F.floor(F.length(F.regexp_replace(text, r"[ \t\n\r\f\x0B]", "")) * 100 / F.col("_n")))).otherwise(0).cast("bigint"),
        }
    )
    counted = F.least("words", F.lit(1000))
    three = two.withColumn("_flesch", F.lit(206.835) - F.lit(1.015) * F.try_divide("words", "_ends") - F.lit(84.6) * F.try_divide(F.col("_spoken"), counted))
    told = (F.col("_n") > 50) & (F.col("_ends") > 0) & (F.col("words") > 0)
    whole = F.when(F.col("_flesch") < 0, F.ceil("_flesch")).otherwise(F.floor("_flesch"))
    four = three.withColumn("readability", F.when(told, F.least(F.lit(100), F.greatest(F.lit(0), whole))).otherwise(50).cast("bigint"))
    structure, completeness = F.when(F.col("_n") > 0, 40).otherwise(20), F.when(F.col("_n") > 0, 100).otherwise(0)
    overall = F.floor((F.col("density") * 20 + F.col("readability") * 15 + structure * 25 + completeness * 25 + F.lit(50 * 15)) / 100).cast("bigint")
    return four.withColumn("overall", overall).drop("_words", "_n", "_ends", "_spoken", "_flesch")


# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "St", "vs", "etc", "e.g", "i.e", "No", "Fig", "Inc", "Ltd")


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after . ! ? before white space, but not after an abbreviation; empty ones left out."""
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    held = F.regexp_replace(text, rf"(^|[^A-Za-z0-9.])({names})\.", "$1$2\x1f")
    parts = F.split(F.regexp_replace(held, r"([.!?])[ \t\n\r\f]+", "$1\x1e"), "\x1e")
    return F.filter(F.transform(parts, lambda s: strip(F.translate(s, "\x1f", "."))), lambda s: s != "")


# The language that most texts of a script are in.
SCRIPT_LANGUAGES = {"arabic": "ar", "cjk": "zh", "cyrillic": "ru", "devanagari": "hi", "greek": "el", "hangul": "ko", "hebrew": "he", "kana": "ja", "thai": "th"}


def language_of(text: Column) -> Column:
    """A language by the prevailing script; en for Latin letters or none."""
    script = script_of(text)
    code = F.lit("en")
    for name, language in SCRIPT_LANGUAGES.items():
        code = F.when(script == name, language).otherwise(code)
    return code


def merge_documents(docs: DataFrame, by: list[str]) -> DataFrame:
    """One text for each ``by``: the texts in the order of their ids, with empty lines between; paths joined by semicolons.

    Null texts count as empty; null and empty paths are left out.
    """
    rows = docs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source_path"))).alias("r"))
    paths = F.filter(F.transform("r", lambda x: x["source_path"]), lambda p: F.length(p) > 0)
    return rows.select(*by, F.size("r").alias("n"), F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"), F.array_join(paths, ";").alias("source_path"))


def field_of(text: Column, name: str, default: str = "") -> Column:
    """What stands after ``name`` and a colon in its line, in any case of letters; ``default`` without such a line."""
    found = strip(F.regexp_extract(text, rf"(?im)^[ \t\"*-]*{name}[\"*]*[ \t]*:[ \t]*([^\n]*)$", 1))
    return F.when(found != "", found).otherwise(F.lit(default))


def character_ids(text: Column, most: int = 128) -> Column:
    """The code points of the first ``most`` characters, filled up with zeros."""
    characters = F.filter(F.split(F.substring(text, 1, most), ""), lambda c: c != "")
    return F.slice(F.concat(F.transform(characters, lambda c: F.ascii(c)), F.array_repeat(F.lit(0), most)), 1, most)


def document_hash(text: Column, *fields: Column) -> Column:
    """SHA-256 of the text and the JSON of further fields."""
    return F.sha2(F.concat(F.coalesce(text, F.lit("")), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), 256)


def fields_key(*fields: Column) -> Column:
    """Sixteen hexadecimal digits of the SHA-256 of fields joined by bars; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256), 1, 16)
