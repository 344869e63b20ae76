"""Understanding of questions: type, intent, filters, parts and routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import split_words, strip

# Phrases that tell the type of a question (looked for anywhere, in this order of types).
TYPES = (
    ("comparative", ("compare", "difference", "versus", "vs", "better", "worse", "similarities", "differences", "pros", "cons")),
    ("analytical", ("why", "how does", "explain", "analyze", "what causes", "what is the reason", "what are the factors")),
    ("factual", ("what", "when", "where", "who", "which", "how many", "how much", "how long", "define", "list", "name")),
    ("exploratory", ("summarize", "overview", "tell me about", "describe", "what is", "what are", "outline")),
)
QUALIFIERS = ("specifically", "especially", "primarily", "particularly", "mostly", "mainly", "including", "such as", "in terms of")
# Patterns of intents, in this order.
INTENTS = (
    ("comparative", r"\b(compare|contrast|difference|similar|versus|vs\.?|advantage|better|worse|pros?|cons?)\b|how does .+ differ|what is the difference"),
    ("analytical", r"\b(why|how does|how can|explain|reason|cause|impact|affect|influence|analyze|analysis|trend|correlation|relation)\b|what caused|what led to"),
    ("summarization", r"\b(summarize|summary|overview|key.?points|main.?points|recap|brief)\b|give me the gist|tl;?dr|in short"),
    ("exploratory", r"\b(enumerate|list all|find all|search for|explore|discover|types?|kinds?|categories|examples?|instances)\b"),
)


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | F.contains(text, F.lit(p)), phrases, F.lit(False))


def question_type(text: Column) -> Column:
    low = strip(F.lower(text))
    out = F.when(F.size(split_words(low)) <= 2, "keyword").otherwise("exploratory")
    for kind, phrases in reversed(TYPES):
        out = F.when(_any(low, phrases), kind).otherwise(out)
    return out


def analyse(questions: DataFrame) -> DataFrame:
    """(query_id, term_count, question_type, complexity, hyde, multi_query, top_k)."""
    low = F.lower("query")
    terms = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    n, distinct = F.size(terms), F.size(F.array_distinct(terms))
    kind = question_type(F.col("query"))
    points = (
        F.when(n > 10, 3).otherwise(0)
        + F.when(distinct > 8, 2).otherwise(0)
        + F.when(_any(low, QUALIFIERS), 2).otherwise(0)
        + F.when(F.contains(F.col("query"), F.lit("?")), 1).otherwise(0)
        + F.when(kind.isin("analytical", "comparative"), 2).otherwise(0)
    )
    x = questions.where(F.col("query").isNotNull()).select("query_id", n.alias("term_count"), kind.alias("question_type"), F.least(points, F.lit(10)).alias("p"))
    deep = F.col("question_type").isin("analytical", "comparative")
    return x.select(
        "query_id",
        "term_count",
        "question_type",
        (F.col("p") / 10).alias("complexity"),
        (deep | (F.col("p") > 5) | ((F.col("term_count") <= 3) & (F.col("question_type") == "keyword"))).alias("hyde"),
        (deep | (F.col("p") > 6)).alias("multi_query"),
        F.when(F.col("question_type") == "comparative", 10).when(F.col("question_type").isin("analytical", "exploratory"), 7).when(F.col("question_type") == "factual", 3).otherwise(5).alias("top_k"),
    )


def intent(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("factual")
    for kind, pattern in reversed(INTENTS):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def filters(text: Column) -> dict[str, Column]:
    """Columns year_from, year_to, author and section named in a question; null where not."""
    span = r"(?i)(?:in|from|during)[ \t]+(\d{4})[ \t]*(?:to|through|-)[ \t]*(\d{4})"
    one = r"(?i)(?:in|from|during)[ \t]+(\d{4})"
    get = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    return {
        "year_from": F.coalesce(get(span, 1), get(one, 1)),
        "year_to": F.coalesce(get(span, 2), get(one, 1)),
        "author": get(r"(?i)(?:author|by)[ \t]+[\"']([^\"']+)[\"']", 1),
        "section": get(r"(?i)(?:section|chapter|article)[ \t]+(\d+)", 1),
    }


def parts(questions: DataFrame) -> DataFrame:
    """(query_id, part_no, part): cut at and, or, but, commas and question marks between blanks; parts over 10 characters."""
    cut = F.split("query", r"[ \t]+(?:and|or|but|,|\?)[ \t]+")
    bare = F.filter(F.transform(cut, lambda p: strip(F.regexp_replace(strip(p), r"^\?+|\?+$", ""))), lambda p: F.length(p) > 10)
    return questions.where(F.col("query").isNotNull()).select("query_id", F.posexplode(bare).alias("part_no", "part"))


MOST_SENT_TARGETS = 10_000


def routes(questions: DataFrame, targets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query_id, target, score): each target (target, keywords) by the share of its keywords in the question.

    Keywords may stand anywhere in a question, so every question meets every target, of which there are few.

    At or above the threshold the best target alone, at 0.6 of it those with half the threshold, else all.
    """
    named = targets.select("target", "keywords")
    x = questions.join(F.broadcast(named) if targets.count() <= MOST_SENT_TARGETS else named)
    hits = F.size(F.filter("keywords", lambda k: F.contains(F.lower("query"), F.lower(k))))
    scored = x.select("query_id", "target", F.round(hits / F.greatest(F.size("keywords"), F.lit(1)), 6).alias("score"))
    from pyspark.sql import Window

    w = Window.partitionBy("query_id")
    ranked = scored.withColumns({"best": F.max("score").over(w), "r": F.row_number().over(w.orderBy(F.desc("score"), "target"))})
    keep = F.when(F.col("best") >= threshold, F.col("r") == 1).when(F.col("best") >= 0.6 * threshold, F.col("score") >= 0.5 * threshold).otherwise(True)
    return ranked.where(keep).select("query_id", "target", "score")


# Fixed values: (domain, chunk size, overlap, question words that point to it).
PRESETS = (
    ("financial", 800, 50, ("revenue", "profit", "loan", "budget", "fiscal", "audit")),
    ("legal", 1200, 100, ("contract", "clause", "liability", "court", "statute", "lawsuit")),
    ("medical", 600, 30, ("patient", "diagnosis", "therapy", "dosage", "symptom", "clinic")),
    ("academic", 1000, 50, ("abstract", "hypothesis", "methodology", "citation", "thesis", "experiment")),
)


def domain(text: Column) -> Column:
    """The preset whose words a text has most often (ties: the first); general without any."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    best, name = F.lit(0), F.lit("general")
    for kind, _, _, keys in PRESETS:
        n = F.size(F.array_intersect(words, F.array(*map(F.lit, keys))))
        name, best = F.when(n > best, kind).otherwise(name), F.greatest(best, n)
    return name


def tuned(history: DataFrame, base_k: int = 5) -> DataFrame:
    """(session_id, top_k, hyde, multi_query) from the mean confidence of a session's questions; unchanged under five."""
    x = history.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"))
    low, middle = (F.col("n") >= 5) & (F.col("c") < 0.5), (F.col("n") >= 5) & (F.col("c") < 0.7)
    return x.select("session_id", F.when(low, base_k + 5).when(middle, base_k + 2).otherwise(base_k).alias("top_k"), low.alias("hyde"), middle.alias("multi_query"))
