"""Headings, layout, entities, relations and link graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import strip

# Fixed values: (type, pattern) of entities, and the phrases of each relation.
ENTITIES = (
    ("person", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
    ("url", r"\b(?:https?://|www\.)[^ \t\n\r]+\b"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("phone", r"\b\d{10}\b"),
)
RELATIONS = {
    "works for": ("works for", "employed by", "works at"),
    "located in": ("located in", "based in", "situated in"),
    "part of": ("part of", "belongs to", "member of"),
    "created by": ("created by", "authored by", "written by"),
    "acquired": ("acquired", "purchased", "bought"),
    "led by": ("led by", "headed by", "chaired by"),
    "invested in": ("invested in", "funded"),
}


def _tagged(values: Column, tag: str | int) -> Column:
    """Structs (tag, value) of an array's elements."""
    return F.transform(values, lambda x: F.struct(F.lit(tag).alias("tag"), x.alias("value")))


def entities(docs: DataFrame) -> DataFrame:
    """(entity_type, label, mentions, docs) over all texts."""
    found = F.flatten(F.array(*(_tagged(F.regexp_extract_all("text", F.lit(f"({p})"), 1), t) for t, p in ENTITIES)))
    each = docs.where(F.length("text") > 0).select("doc_id", F.explode(found).alias("e"))
    per = each.groupBy("doc_id", F.col("e.tag").alias("entity_type"), F.col("e.value").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("entity_type", "label").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("docs"))


def relations(docs: DataFrame) -> DataFrame:
    """(doc_id, relation, source, target): persons named on both sides of a relation's phrase in one sentence."""
    phrases = F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(p).alias("phrase")) for r, ps in RELATIONS.items() for p in ps))
    s = docs.where(F.length("text") > 0).select("doc_id", F.explode(F.split("text", "[.!?]+")).alias("s"))
    hit = s.select("doc_id", "s", F.explode(F.filter(phrases, lambda x: F.contains(F.lower("s"), x["phrase"]))).alias("x"))
    sides = hit.select("doc_id", "x.relation", F.split("s", F.concat(F.lit("(?i)"), F.col("x.phrase"))).alias("p")).where(F.size("p") == 2)
    person = ENTITIES[0][1]
    named = sides.select(
        "doc_id",
        "relation",
        F.element_at(F.regexp_extract_all(F.element_at("p", 1), F.lit(f"({person})"), 1), -1).alias("source"),
        F.try_element_at(F.regexp_extract_all(F.element_at("p", 2), F.lit(f"({person})"), 1), F.lit(1)).alias("target"),
    )
    return named.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target"))).distinct()


def headings(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, seq, level, title, parent_seq) of ATX headings; the parent is the nearest heading before of a smaller level."""
    lines = docs.where(F.length("text") > 0).select(id_col, F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "s"))
    found = lines.where(F.col("s").rlike(r"^#{1,6}[ \t]+[^ \t]")).select(
        id_col, "line", F.length(F.regexp_extract("s", r"^(#{1,6})", 1)).alias("level"), strip(F.regexp_replace("s", r"^#{1,6}[ \t]+", "")).alias("title")
    )
    w = Window.partitionBy(id_col).orderBy("line")
    numbered = found.withColumn("seq", F.row_number().over(w))
    # the last heading of each level seen so far: six running values instead of the whole history
    last = [F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for k in range(1, 7)]
    parent = F.greatest(*(F.when(F.col("level") > k + 1, x) for k, x in enumerate(last)), F.lit(None).cast("int"))
    return numbered.select(id_col, "seq", "level", "title", parent.alias("parent_seq"))


def html_headings(pages: DataFrame) -> DataFrame:
    """(page_id, level, title): h1 to h6 with inner mark-up taken out."""
    parts = [_tagged(F.regexp_extract_all("html", F.lit(rf"(?is)<h{k}(?:[ \t\n][^>]*)?>(.*?)</h{k}>"), 1), k) for k in range(1, 7)]
    each = pages.where(F.length("html") > 0).select("page_id", F.explode(F.flatten(F.array(*parts))).alias("h"))
    return each.select("page_id", F.col("h.tag").alias("level"), strip(F.regexp_replace("h.value", r"<[^>]+>", "")).alias("title"))


def layout(docs: DataFrame) -> DataFrame:
    """(doc_id, element, n): lines that are headings, table rows, list items, code or text."""
    lines = docs.where(F.length("text") > 0).select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).select("doc_id", strip(F.col("raw")).alias("s")).where("s <> ''")
    kind = (
        F.when(F.col("s").startswith("#"), "heading")
        .when(F.col("s").rlike(r"^\|.*\|"), "table")
        .when(F.col("s").rlike(r"^[-*] "), "list")
        .when(F.col("s").startswith("```"), "code")
        .otherwise("text")
    )
    return lines.groupBy("doc_id", kind.alias("element")).agg(F.count(F.lit(1)).alias("n"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, target): distinct link targets without their fragment; relative ones are made absolute by the page's origin."""
    origin = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    each = pages.where(F.length("html") > 0).select("page_id", origin.alias("o"), F.explode(F.regexp_extract_all("html", F.lit(r"<[aA][ \t\n][^>]*href=\"([^\"#]+)"), 1)).alias("h"))
    full = F.when(F.col("h").rlike("^[a-z]+://"), F.col("h")).when(F.col("h").startswith("/"), F.concat("o", "h"))
    return each.select("page_id", full.alias("target")).where(F.col("target").isNotNull()).distinct()


def link_degrees(pages: DataFrame) -> DataFrame:
    """(host, pages, links, targets) of each host."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    by = pages.select("page_id", "url").distinct().select("page_id", host.alias("host"))
    links = page_links(pages).join(by, "page_id")
    n = links.groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("target").alias("targets"))
    return by.groupBy("host").agg(F.count_distinct("page_id").alias("pages")).join(n, "host", "left").select("host", "pages", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("targets", F.lit(0)).alias("targets"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour, relation, weight): edges in both directions."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "relation", "weight").unionByName(
        edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "relation", "weight")
    )


def paths(edges: DataFrame, starts: DataFrame, most_nodes: int = 3) -> DataFrame:
    """(start, path): simple undirected paths of 2 to ``most_nodes`` nodes from each start, by repeated joins."""
    step = neighbours(edges).select("node", "neighbour").distinct()
    grown = starts.select(F.col("node").alias("start"), F.array("node").alias("path"))
    out = None
    for _ in range(most_nodes - 1):
        grown = (
            grown.withColumn("node", F.element_at("path", -1))
            .join(step, "node")
            .where(~F.array_contains("path", F.col("neighbour")))
            .select("start", F.concat("path", F.array("neighbour")).alias("path"))
        )
        out = grown if out is None else out.unionByName(grown)
    return out


def related_entities(questions: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, label, via): entities one edge away from those that a question (query_id, query) names by a word.

    Words and labels meet by an equi-join on words of four letters or more; at most ``most`` for a question,
    in the order of their labels.
    """
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.length(w) >= 4))
    q = questions.select("query_id", F.explode(words(F.col("query"))).alias("w"))
    n = nodes.select("node", "label", F.explode(words(F.col("label"))).alias("w"))
    hit = q.join(n, "w").select("query_id", "node", F.col("label").alias("via")).distinct()
    far = hit.join(neighbours(edges), "node").join(nodes.select(F.col("node").alias("neighbour"), "label"), "neighbour")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("label", "via"))
    return far.select("query_id", "label", "via").distinct().withColumn("r", rank).where(F.col("r") <= most).drop("r")


def node_matches(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(node, score): 2 for each term in the label, 1 for each in the text of its metadata."""
    score = F.lit(0)
    for t in terms:
        score = score + F.when(F.contains(F.lower("label"), F.lit(t.lower())), 2).otherwise(0) + F.when(F.contains(F.lower(F.coalesce("metadata", F.lit(""))), F.lit(t.lower())), 1).otherwise(0)
    return nodes.select("node", score.alias("score")).where("score > 0")


def printed_contents(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, level, title, page) of printed lists of contents: titles, dots or blanks, and a page number at the end.

    Two blanks of indentation make a level. Lines without a page are left out.
    """
    lines = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "s"))
    form = r"^([ ]*)([^ ].*?)[ ]*(?:\.{2,}|[ ]{2,})[ ]*(\d{1,5})[ ]*$"
    part = lambda k: F.regexp_extract("s", form, k)
    found = lines.where(F.col("s").rlike(form)).select(
        "doc_id", "line", (F.floor(F.length(part(1)) / 2) + 1).cast("int").alias("level"), part(2).alias("title"), part(3).cast("int").alias("page")
    )
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")).alias("seq"), "level", "title", "page")
