"""More queries of the core: model-backed operators with a stand-in for the model, answers, indexes, and SQL for queries of core_queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import redact, text as T
from textquarry.operators import answers as N
from textquarry.operators import chunking as C
from textquarry.operators import context as X
from textquarry.operators import governance as V
from textquarry.operators import graph as G
from textquarry.operators import models as M
from textquarry.operators import questions as Q
from textquarry.operators import retrieval as R
from textquarry.operators import trees
from textquarry.plans.core_queries import _BM25, _ROUTES, _TERMS, _WS, _questions, _retrieved, _title_queries, documents
from textquarry.plans.snapshot_queries import _FILES, P2_FOUND_SQL
from textquarry.session import table
from textquarry.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# ---- a model, stood in for by functions of the prompt

_PART = r"'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]'"
_SAFE = lambda p: f"substr(regexp_replace({p}, {_PART}, '', 'g'), 1, 100000)"
_NL = "chr(10) || chr(10)"


def digest_model(prompts: list[str]) -> list[str]:
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


def length_model(prompts: list[str]) -> list[str]:
    return [f"1. {len(p)}\n2. {len(p) % 7}" for p in prompts]


def json_model(prompts: list[str]) -> list[str]:
    return [f'It is {{"length": {len(p)}, "lines": {p.count(chr(10))}}}.' for p in prompts]


def score_model(prompts: list[str]) -> list[str]:
    return [f"About {len(p) % 11}." for p in prompts]


def question_model(prompts: list[str]) -> list[str]:
    return [f"Q: {d}?\nA: {len(p)}" for p, d in zip(prompts, digest_model(prompts))]


@query(f"SELECT doc_id, md5({_SAFE(f'''('Summarise the text in at most 200 words.' || {_NL} || text)''')}) AS answer FROM documents WHERE text IS NOT NULL")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf, "doc_id", "text").where(F.col("text").isNotNull())
    return M.call_model(d, M.summary_prompt(F.col("text")), digest_model).select("doc_id", "answer")


@query(
    f"""
    WITH l AS (SELECT doc_id, length({_SAFE(f"('Name the 10 most telling keywords of the text, separated by commas.' || {_NL} || text)")}) AS n FROM documents WHERE length(text) > 0)
    SELECT doc_id, i::INT AS seq, (list_distinct([n, n % 7]))[i + 1]::VARCHAR AS item FROM (SELECT doc_id, n, unnest(CASE WHEN n = n % 7 THEN [0] ELSE [0, 1] END) AS i FROM l)
    """.replace("(list_distinct([n, n % 7]))[i + 1]", "(CASE WHEN i = 0 THEN n ELSE n % 7 END)")
)
def model_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return M.model_list(documents(spark, sf, "doc_id", "text"), length_model, M.keywords_prompt)


@query(
    f"""
    WITH c AS (SELECT doc_id, i // 2000 AS k, substr(text, (i + 1)::BIGINT, 2000) AS c, ((length(text) + 1999) // 2000) AS n
               FROM documents, LATERAL (SELECT unnest(range(0, length(text), 2000)) AS i) WHERE length(text) > 0),
    p AS (SELECT doc_id, k, n, md5({_SAFE(f"('Summarise.' || {_NL} || CASE WHEN n > 1 THEN 'Part ' || (k + 1) || ' of ' || n || ':' || {_NL} || c ELSE c END)")}) AS part FROM c),
    j AS (SELECT doc_id, any_value(n) AS n, min(part) AS one, string_agg('--- Part ' || (k + 1) || ' ---' || chr(10) || part, {_NL} ORDER BY k) AS joined FROM p GROUP BY 1)
    SELECT doc_id, CASE WHEN n = 1 THEN one ELSE md5({_SAFE(f"('Put these answers to the parts of one text together, each thing once.' || {_NL} || joined)")}) END AS answer FROM j
    """
)
def chunked_answers(spark: SparkSession, sf: str) -> DataFrame:
    return M.call_chunked(documents(spark, sf, "doc_id", "text"), digest_model, "Summarise.", 2000).select("doc_id", "answer")


@query(
    f"""
    WITH p AS (SELECT doc_id, {_SAFE(f"('Give these fields of the text as one JSON object, null where it doesn''t tell them: length bigint, lines bigint' || {_NL} || text)")} AS p FROM documents WHERE length(text) > 0)
    SELECT doc_id, length(p)::BIGINT AS length, (length(p) - length(replace(p, chr(10), '')))::BIGINT AS lines FROM p
    """
)
def extracted_fields(spark: SparkSession, sf: str) -> DataFrame:
    return M.extract_fields(documents(spark, sf, "doc_id", "text"), json_model, "length bigint, lines bigint").select("doc_id", "fields.length", "fields.lines")


@query(
    f"""
    WITH r AS (SELECT a.item_id AS query_id, b.item_id AS doc_id, {_SAFE(f"('How well does the text answer the question, from 0 to 10?' || {_NL} || 'Question: ' || a.question || {_NL} || 'Text:' || chr(10) || b.passage)")} AS p
               FROM eval_items a JOIN eval_items b USING (suite, lang)),
    s AS (SELECT query_id, doc_id, round(coalesce(length(p), 0) % 11 / 10, 6) AS score FROM r)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 5
    """
)
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_items")
    texts = e.select(F.col("item_id").alias("doc_id"), F.col("passage").alias("text"), "suite", "lang")
    return M.rerank(e.select(F.col("item_id").alias("query_id"), F.col("question").alias("query"), "suite", "lang").join(texts, ["suite", "lang"]), score_model)


@query()
def reasoned(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark, sf)
    return M.reason(q, Q.parts(q), digest_model)


@query(
    f"""
    WITH d AS (SELECT doc_id AS chunk_id, text, {_SAFE(f"('Ask one question that this text alone answers, and give the answer in its words.' || chr(10) || 'Q: <question>' || chr(10) || 'A: <answer>' || {_NL} || text)")} AS p
               FROM documents WHERE length(text) > 0 ORDER BY md5(doc_id::VARCHAR || text), doc_id LIMIT 50)
    SELECT chunk_id, md5(p) || '?' AS question, length(p)::VARCHAR AS answer, text FROM d
    """
)
def made_test_set(spark: SparkSession, sf: str) -> DataFrame:
    return N.test_set(documents(spark, sf, "doc_id", "text").withColumnRenamed("doc_id", "chunk_id"), question_model)


_WORDS = lambda c: rf"list_distinct(list_filter(string_split_regex(lower(coalesce({c}, '')), '{_WS}+'), lambda x: x <> ''))"


@query(
    f"""
    WITH w AS (SELECT {_WORDS('question')} AS q, {_WORDS('answer')} AS e, {_WORDS('substr(passage, 1, 60)')} AS a, {_WORDS('passage')} AS c, (contains(lower(passage), lower(answer)))::INT AS h FROM eval_items),
    m AS (SELECT unnest([
            {{'metric': 'answer_relevance', 'value': CASE WHEN len(q) > 0 THEN len(list_intersect(a, q)) / len(q) ELSE 0 END}},
            {{'metric': 'context_precision', 'value': h::DOUBLE}},
            {{'metric': 'faithfulness', 'value': CASE WHEN len(a) > 0 THEN len(list_intersect(c, a)) / len(a) ELSE 0 END}},
            {{'metric': 'answer_similarity', 'value': CASE WHEN len(list_distinct(list_concat(a, e))) > 0 THEN len(list_intersect(a, e)) / len(list_distinct(list_concat(a, e))) ELSE 0 END}}]) AS m FROM w)
    SELECT m.metric AS metric, round(avg(m.value), 6) AS mean, round(stddev_pop(m.value), 6) AS std, round(min(m.value), 6) AS min, round(max(m.value), 6) AS max, count(*)::BIGINT AS n FROM m GROUP BY 1
    """
)
def evaluated_answers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_items").withColumnRenamed("item_id", "id")
    return N.evaluate(e.select("id", "question", "answer"), e.select("id", F.substring("passage", 1, 60).alias("answer"), F.array("passage").alias("contexts")))


# ---- answers from the corpus

_EMBEDDED = """
    {0}p AS (SELECT id, term, count(*) AS tf FROM ({1}) GROUP BY 1, 2),
    {0}b AS (SELECT id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64)::INT AS bucket, sum(CASE WHEN ('0x' || substr(md5(term), 9, 8))::BIGINT % 2 = 0 THEN tf ELSE -tf END)::DOUBLE AS w FROM {0}p GROUP BY 1, 2),
    {0}e AS (SELECT id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6)::FLOAT::DOUBLE AS w FROM {0}b WHERE w <> 0),
    {0}n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {0}e GROUP BY 1)
"""
_HYBRID = (
    "WITH "
    + _BM25
    + ","
    + _EMBEDDED.format("d", f"SELECT doc_id AS id, unnest({_TERMS}) AS term FROM documents")
    + ","
    + _EMBEDDED.format("q", "SELECT doc_id AS id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL")
    + """,
    prod AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.w * d.w) AS s FROM qe q JOIN de d USING (bucket) GROUP BY 1, 2),
    every AS (SELECT qn.id AS query_id, dn.id AS doc_id, round(coalesce(s, 0) / qn.norm / dn.norm, 6) AS score FROM qn CROSS JOIN dn LEFT JOIN prod ON prod.query_id = qn.id AND prod.doc_id = dn.id),
    dense AS (SELECT query_id, doc_id, score FROM every QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10),
    wt AS (SELECT doc_id AS query_id, CASE WHEN len(t) <= 2 THEN 0.2 ELSE round(0.3 + 0.5::DOUBLE * len(list_distinct(t)) / len(t), 6) END AS sw,
           CASE WHEN len(t) <= 2 THEN 0.8 ELSE round(1 - (0.3 + 0.5::DOUBLE * len(list_distinct(t)) / len(t)), 6) END AS dw
           FROM (SELECT doc_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS t FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)),
    sp AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS sparse FROM bm),
    b2 AS (SELECT query_id, doc_id, coalesce(dense.score, 0) AS dense, coalesce(sparse, 0) AS sparse FROM dense FULL JOIN sp USING (query_id, doc_id)),
    f2 AS (SELECT query_id, doc_id, round(dense * dw + sparse * sw, 6) AS score FROM b2 JOIN wt USING (query_id))
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f2 QUALIFY rank <= 10
    """
)


@query(_HYBRID)
def hybrid_top(spark: SparkSession, sf: str) -> DataFrame:
    return N.hybrid_search(documents(spark, sf, "doc_id", "text"), _title_queries(spark, sf))


@query()
def asked_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return N.ask(documents(spark, sf, "doc_id", "text"), _title_queries(spark, sf)).select("query_id", "answer", "doc_ids", "top_score")


@query(
    """
    WITH t(target, k, c) AS (VALUES ('facts', ['statement', 'passage'], 0.9::DOUBLE), ('figures', ['many', 'total'], 0.5::DOUBLE), ('texts', ['passage', 'summary', 'aussage'], 0.7::DOUBLE)),
    s AS (SELECT item_id AS query_id, target, c, length(question) AS n, round(len(list_filter(k, lambda w: contains(lower(question), w))) / len(k), 6) AS score FROM eval_items, t),
    r AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target) AS r FROM s),
    k AS (SELECT * FROM r WHERE CASE WHEN best >= 0.5 THEN r = 1 WHEN best >= 0.3 THEN score >= 0.25 ELSE true END)
    SELECT query_id, string_agg(target, ',' ORDER BY target) AS targets, round(sum(c * c) / sum(c), 6) AS confidence, sum(n)::BIGINT AS latency_ms, round(sum(c / 100), 6) AS cost FROM k GROUP BY 1
    """
)
def routed_answers(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark, sf)
    targets = spark.createDataFrame(_ROUTES, "target string, keywords array<string>")
    trust = spark.createDataFrame([("facts", 0.9), ("figures", 0.5), ("texts", 0.7)], "target string, confidence double")
    said = q.select("query_id", F.length("query").cast("bigint").alias("latency_ms")).join(F.broadcast(trust)).withColumn("cost", F.col("confidence") / 100)
    return N.routed(q, Q.routes(q, targets), said)


@query()
def compressed_context(spark: SparkSession, sf: str) -> DataFrame:
    return X.compressed(_retrieved(spark, sf), 1200)


@query()
def clustered_nodes(spark: SparkSession, sf: str) -> DataFrame:
    windows = C.sentence_windows(documents(spark, sf, "doc_id", "text")).select("doc_id", F.col("chunk_seq").alias("i"), "chunk")
    keyed = windows.select(F.struct("doc_id", "i").alias("key"), F.col("chunk").alias("text"))
    embedded = R.hashed_embeddings(keyed, 64, "key")
    return trees.cluster_nodes(embedded.select("key.doc_id", "key.i", "embedding"))


# ---- indexes and documents

_TABLE, _IMAGE = r"(?m)((?:^\|[^\n]*\|[ \t\r]*$\n?)+)", r"!\[([^\]\n]*)\]\([^)\n]*\)"


@query(
    rf"""
    WITH i AS (
      SELECT doc_id, 'table' AS item_type, unnest(regexp_extract_all(text, '{_TABLE}', 1)) AS t FROM documents WHERE length(text) > 0
      UNION ALL SELECT doc_id, 'image', unnest(regexp_extract_all(text, '{_IMAGE}', 1)) FROM documents WHERE length(text) > 0
      UNION ALL SELECT doc_id, 'text', regexp_replace(regexp_replace(text, '{_TABLE}', '', 'g'), '{_IMAGE}', '', 'g') FROM documents WHERE length(text) > 0)
    SELECT item_type, count(*)::BIGINT AS items, count(DISTINCT doc_id)::BIGINT AS docs, sum(length(t))::BIGINT AS chars FROM i WHERE item_type <> 'text' OR length(trim(t, ' ')) > 0 GROUP BY 1
    """
)
def item_stats(spark: SparkSession, sf: str) -> DataFrame:
    return N.item_stats(N.index_items(documents(spark, sf, "doc_id", "text")))


@query(
    """
    WITH d AS (SELECT document_id, text, list_sort(list_distinct(list_filter(coalesce(from_json(nullif(metadata['page_breaks'], ''), '["INTEGER"]'), []), lambda b: b > 0 AND b < length(text)))) AS b
               FROM (SELECT document_id, any_value(text) AS text, any_value(metadata) AS metadata FROM raw_documents WHERE length(text) > 0 GROUP BY 1)),
    c AS (SELECT document_id, (i / 900)::INT AS chunk_seq, i AS s, least(i + 1000, length(text)) AS e, b FROM d, LATERAL (SELECT unnest(range(0, length(text), 900)) AS i))
    SELECT document_id, chunk_seq, (len(list_filter(b, lambda x: x <= s)) + 1)::INT AS first_page, (len(list_filter(b, lambda x: x <= greatest(s, e - 1))) + 1)::INT AS last_page FROM c
    """
)
def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "raw_documents").where(F.length("text") > 0).dropDuplicates(["document_id"])
    chunks = C.fixed_chunks(raw.select(F.col("document_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "document_id")
    at = F.coalesce(F.from_json(F.nullif(F.col("metadata")["page_breaks"], F.lit("")), "array<int>"), F.array().cast("array<int>"))
    breaks = raw.select("document_id", F.array_sort(F.array_distinct(F.filter(at, lambda b: (b > 0) & (b < F.length("text"))))).alias("breaks"))
    return N.pages_of(chunks, breaks).select("document_id", "chunk_seq", "first_page", "last_page")


@query(
    """
    SELECT source, title, count(*)::INT AS n, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS text, coalesce(string_agg(source_path, ';' ORDER BY doc_id) FILTER (length(source_path) > 0), '') AS source_path
    FROM documents GROUP BY 1, 2
    """
)
def merged_documents(spark: SparkSession, sf: str) -> DataFrame:
    return T.merge_documents(table(spark, sf, "documents"), ["source", "title"])


_ABBREVIATED = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)


@query(
    rf"""
    WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9.])({_ABBREVIATED})\.', '\1\2' || chr(31), 'g'), '([.!?]){_WS}+', '\1' || chr(30), 'g'), chr(30)),
                 lambda x: regexp_replace(replace(x, chr(31), '.'), '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE length(text) > 0)
    SELECT doc_id, i::INT AS seq, s[i + 1] AS sentence FROM s, LATERAL (SELECT unnest(range(0, len(s))) AS i)
    """
)
def document_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").where(F.length("text") > 0).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("seq", "sentence"))


_LANGUAGE_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS script, len(regexp_extract_all(text, '{p}')) AS n FROM documents WHERE text IS NOT NULL" for s, p in T.SCRIPTS.items())


@query(
    "SELECT doc_id, CASE script " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in T.SCRIPT_LANGUAGES.items()) + " ELSE 'en' END AS language FROM (SELECT doc_id, CASE WHEN n > 0 THEN script END AS script, "
    f"row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, script) AS r FROM ({_LANGUAGE_ROWS})) WHERE r = 1"
)
def document_language(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", T.language_of(F.col("text")).alias("language"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\b(author)\b[ \t]*[:=][ \t]*[^\n,;]+', '\1: [REDACTED]', 'g'), '(?i)\b(topic)\b[ \t]*[:=][ \t]*[^\n,;]+', '\1: [REDACTED]', 'g') AS redacted FROM documents WHERE text IS NOT NULL")
def redacted_fields(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", redact.redact_fields(F.col("text"), ["author", "topic"]).alias("redacted"))


@query("SELECT doc_id, source FROM documents WHERE source <> 'handbook'")
def deleted_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source").where(F.col("source").isNotNull())
    return sinks.delete_by_source(d, spark.createDataFrame([("handbook",)], "source string")).select("doc_id", "source")


@query(
    """
    WITH l AS (SELECT path, max(mtime) AS m FROM source_files WHERE chunk_count > 5 GROUP BY 1), i AS (SELECT path, min(mtime) AS i FROM source_files WHERE chunk_hash IS NOT NULL GROUP BY 1)
    SELECT * FROM (SELECT path, CASE WHEN i IS NULL THEN 'ingest' WHEN m IS NULL THEN 'delete' WHEN m > i THEN 'refresh' END AS action FROM l FULL JOIN i USING (path)) WHERE action IS NOT NULL
    """
)
def index_sync(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "source_files")
    listing = f.where("chunk_count > 5").groupBy("path").agg(F.max("mtime").alias("mtime"))
    return V.sync_plan(listing, f.where(F.col("chunk_hash").isNotNull()).groupBy("path").agg(F.min("mtime").alias("mtime")))


_ASKED = "what is the way"


@query(
    f"""
    WITH n AS (SELECT doc_id, ({' + '.join(f"contains(lower(text), '{w}')::INT" for w in sorted(set(_ASKED.split())))}) / 4 + CASE WHEN contains(lower(text), '{_ASKED}') THEN 1.5 ELSE 0 END AS s, length(text) AS l FROM documents WHERE length(text) > 0),
    r AS (SELECT doc_id, round((s * least(1, 500 / l))::DOUBLE, 6) AS score FROM n)
    SELECT doc_id, score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20
    """
)
def best_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = documents(spark, sf, "doc_id", "text").withColumns({"node_id": F.lit("L0_0"), "level": F.lit(0)})
    return trees.node_scores(nodes, _ASKED, 20).select("doc_id", "score")


@query(
    """
    WITH e AS (SELECT DISTINCT source AS a, source_type AS b FROM documents WHERE source IS NOT NULL AND source_type IS NOT NULL), s AS (SELECT a AS n, b AS m FROM e UNION SELECT b, a FROM e)
    SELECT a AS start, a || '>' || b AS path FROM e UNION ALL SELECT e.a, e.a || '>' || e.b || '>' || s.m FROM e JOIN s ON s.n = e.b AND s.m <> e.a
    """
)
def linked_paths(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "documents").where(F.col("source").isNotNull() & F.col("source_type").isNotNull()).select("source", F.col("source_type").alias("target")).distinct()
    edges = pairs.select("source", "target", F.lit("holds").alias("relation"), F.lit(1.0).alias("weight"))
    return G.paths(edges, pairs.select(F.col("source").alias("node")).distinct()).select("start", F.array_join("path", ">").alias("path"))


@query(
    """
    WITH n AS (SELECT doc_id AS node, 2 * contains(lower(title), 'notes')::INT + contains(lower(coalesce(source, '')), 'notes')::INT + 2 * contains(lower(title), 'handbook')::INT + contains(lower(coalesce(source, '')), 'handbook')::INT AS score
               FROM documents WHERE title IS NOT NULL) SELECT node, score FROM n WHERE score > 0
    """
)
def matched_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "documents").where(F.col("title").isNotNull()).select(F.col("doc_id").alias("node"), F.col("title").alias("label"), F.col("source").alias("metadata"))
    return G.node_matches(nodes, ["notes", "handbook"])


# ---- SQL of queries in core_queries

SQL["version_changelog"] = f"""
    WITH c AS ({P2_FOUND_SQL}) SELECT s.collection, s.created_at::DATE AS day, change_type, count(*)::BIGINT AS n FROM c JOIN snapshots s ON s.id = c.snapshot_id GROUP BY 1, 2, 3
"""

SQL["rollback_plan"] = (
    _FILES
    + """, t AS (SELECT collection, max(seq) AS top FROM o GROUP BY 1),
    x AS (SELECT f.collection, f.path, max(f.h) FILTER (f.seq = top) AS nh, count(*) FILTER (f.seq = top) AS nn, max(f.h) FILTER (f.seq < top) AS oh, count(*) FILTER (f.seq < top) AS n0
          FROM f JOIN t USING (collection) WHERE f.seq >= top - 1 GROUP BY 1, 2)
    SELECT collection, path, CASE WHEN n0 = 0 THEN 'delete' WHEN nn = 0 THEN 'restore' ELSE 'replace' END AS action FROM x WHERE n0 = 0 OR nn = 0 OR nh <> oh
"""
)

SQL["chunk_strategy"] = rf"""
    WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '') AS w, list_filter(string_split_regex(lower(text), '{_WS}+'), lambda x: x <> '') AS l,
                 len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\|.*\|[ \r]*$') OR regexp_matches(x, '^([^,\n]*,){{3,}}[^,\n]*$'))) AS rows FROM documents WHERE length(text) > 0)
    SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^#{{1,6}} [^ ]') THEN 'by_heading' WHEN len(w) > 10000 THEN 'hierarchical'
           WHEN list_has_any(l[1:50], ['abstract', 'introduction', 'methodology', 'references', 'thesis']) THEN 'by_heading' WHEN rows > 3 THEN 'fixed_size' ELSE 'sentence_window' END AS strategy FROM d
"""

_TOPICS = r"""
    p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda s: trim(s, ' ')), lambda s: length(s) >= 20) AS p FROM documents WHERE length(text) > 0),
    n AS (SELECT doc_id, list_filter(list_transform(p, lambda s: array_to_string((regexp_extract_all(regexp_replace(s, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}\x{F900}-\x{FDFF}]', '_', 'g'), '\b([A-Z][a-z]{4,})\b', 1))[1:3], ' ')), lambda t: t <> '') AS n FROM p),
    e AS (SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, unnest(n) AS t, unnest(range(0, len(n))) AS i FROM n) GROUP BY 1, 2),
    r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM e),
    k AS (SELECT doc_id, list(t ORDER BY r) AS k FROM r WHERE r <= 5 GROUP BY 1),
    topics AS (SELECT doc_id, coalesce(k, ['document content']) AS k FROM n LEFT JOIN k USING (doc_id))
"""
SQL["document_topics"] = f"WITH {_TOPICS} SELECT doc_id, array_to_string(k, '; ') AS topics FROM topics"

_FORM = "([" + ", ".join(f"'{f}'" for f in trees.FORMS) + "])[(('0x' || substr(md5(doc_id || ' ' || t), 1, 8))::BIGINT % 3) + 1]"
SQL["made_examples"] = rf"""
    WITH {_TOPICS}, u AS (SELECT doc_id, text, unnest(k) AS t, unnest(range(0, len(k))) AS i FROM topics JOIN documents USING (doc_id) WHERE length(text) > 100),
    s AS (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(31), 'g'), chr(31)), lambda s: contains(s, string_split(t, ' ')[1])) AS s FROM u)
    SELECT doc_id, i::INT AS example_no, replace({_FORM}, '{{}}', t) AS instruction, substr(coalesce(s[1], text), 1, 300) AS output FROM s
"""

_STEPS = """
    RECURSIVE walk AS (SELECT query_id, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS ids FROM (SELECT DISTINCT query_id FROM ordered)
      UNION ALL SELECT w.query_id, w.k + 1, CASE WHEN w.used + o.tokens > 800 THEN w.used ELSE w.used + o.tokens END, CASE WHEN w.used + o.tokens > 800 THEN w.ids ELSE list_append(w.ids, o.doc_id) END
      FROM walk w JOIN ordered o ON o.query_id = w.query_id AND o.o = w.k + 1)
    SELECT query_id, len(ids)::INT AS chunks_used, used AS total_tokens, ids AS chunk_ids FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1
"""
_FOUND = f"WITH RECURSIVE {_BM25}, t AS (SELECT bm.query_id, bm.doc_id, bm.rank, bm.score, d.source, d.text, greatest(1, length(d.text) // 4)::BIGINT AS tokens FROM bm JOIN documents d USING (doc_id)),"
SQL["packed_context"] = _FOUND + " ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS o FROM t)," + _STEPS.replace("RECURSIVE walk", "walk")
SQL["packed_in_turns"] = (
    _FOUND
    + " turns AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY query_id, source) AS first FROM t),"
    + " ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, first, doc_id) AS o FROM turns),"
    + _STEPS.replace("RECURSIVE walk", "walk")
)

_TITLE_WORDS = _WORDS("title")
SQL["answer_confidence"] = f"""
    WITH {_BM25}, t AS (SELECT bm.query_id, bm.score / 100 AS score, d.source, {_WORDS('d.text')} AS c FROM bm JOIN documents d USING (doc_id)),
    w AS (SELECT doc_id AS query_id, {_TITLE_WORDS} AS q FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
    g AS (SELECT query_id, avg(score) - 0.2::DOUBLE * (max(score) - min(score)) AS retrieval, count(DISTINCT source) FILTER (source <> '') AS sources, count(*) AS n,
            avg(CASE WHEN len(q) > 0 THEN round(len(list_intersect(c, q)) / len(q), 6) ELSE 0 END) AS relevance, list_distinct(flatten(list(c))) AS every, any_value(q) AS q FROM t JOIN w USING (query_id) GROUP BY 1)
    SELECT query_id, round(0.3::DOUBLE * greatest(0, least(1, retrieval)) + 0.2::DOUBLE * (CASE WHEN sources = 0 THEN 0.3 ELSE least(1, 2 * sources / n) END) + 0.2::DOUBLE * relevance
           + 0.3::DOUBLE * (CASE WHEN len(q) > 0 THEN round(len(list_intersect(every, q)) / len(q), 6) ELSE 0 END), 4) AS confidence FROM g
"""

SQL["export_documents"] = """
    SELECT doc_id, '{"id":' || to_json(doc_id::VARCHAR) || ',"content":' || to_json(replace(coalesce(text, ''), chr(0), '')) || ',"meta":{' || array_to_string(list_filter([
        CASE WHEN lang IS NOT NULL THEN '"lang":' || to_json(lang) END, CASE WHEN source IS NOT NULL THEN '"source":' || to_json(source) END, CASE WHEN title IS NOT NULL THEN '"title":' || to_json(title) END], lambda x: x IS NOT NULL), ',') || '}}' AS json
    FROM documents
"""

SQL["chunk_semantic"] = rf"""
    WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t\r]*\n[ \t\r\n]*'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE length(text) > 0),
    w AS (SELECT doc_id, p, 1 AS k, 0 AS chunk_seq, p[1] AS now, NULL::VARCHAR AS done FROM p WHERE len(p) > 0
      UNION ALL SELECT doc_id, p, k + 1, CASE WHEN k < len(p) AND length(now) + length(p[k + 1]) <= 1000 THEN chunk_seq ELSE chunk_seq + 1 END,
             CASE WHEN k < len(p) AND length(now) + length(p[k + 1]) <= 1000 THEN now || chr(10) || chr(10) || p[k + 1] ELSE p[k + 1] END, CASE WHEN k < len(p) AND length(now) + length(p[k + 1]) <= 1000 THEN NULL ELSE now END FROM w WHERE k <= len(p))
    SELECT doc_id, (chunk_seq - 1)::INT AS chunk_seq, done AS chunk FROM w WHERE done IS NOT NULL
"""


# ---- tables in which the links and relations are not empty

_PAIR = r"^([A-Z][a-z]+ [A-Z][a-z]+)[^;|,]*[;|][ ]*([A-Z][a-z]+ [A-Z][a-z]+)"


@query(
    rf"""
    WITH p AS (SELECT DISTINCT document_id, regexp_extract(metadata['participants'], '{_PAIR}', 1) AS a, regexp_extract(metadata['participants'], '{_PAIR}', 2) AS b FROM raw_documents)
    SELECT document_id AS doc_id, 'works for' AS relation, a AS source, b AS target FROM p WHERE a <> '' AND a <> b UNION SELECT document_id, 'led by', b, a FROM p WHERE a <> '' AND a <> b
    """
)
def participant_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations in sentences made of each transcript's first two participants."""
    said = F.col("metadata")["participants"]
    named = table(spark, sf, "raw_documents").select(F.col("document_id").alias("doc_id"), F.regexp_extract(said, _PAIR, 1).alias("a"), F.regexp_extract(said, _PAIR, 2).alias("b")).where("a <> ''")
    return G.relations(named.select("doc_id", F.concat("a", F.lit(" works for "), "b", F.lit(". "), "b", F.lit(" is led by "), "a", F.lit(".")).alias("text")))


@query(
    r"""
    WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS o, unnest(regexp_extract_all(html, '<[aA][ \t\n][^>]*href="([^"#]+)', 1)) AS h FROM crawl_results WHERE length(html) > 0),
    t AS (SELECT DISTINCT page_id, CASE WHEN regexp_matches(h, '^[a-z]+://') THEN h WHEN starts_with(h, '/') THEN o || h END AS target FROM h)
    SELECT target, count(*)::BIGINT AS pages FROM t WHERE target IS NOT NULL AND target NOT IN (SELECT url FROM crawl_results WHERE url IS NOT NULL) GROUP BY 1
    """
)
def orphan_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Link targets that no page of the crawl has as its address."""
    crawl = table(spark, sf, "crawl_results")
    known = crawl.select(F.col("url").alias("target")).where(F.col("target").isNotNull()).distinct()
    return G.page_links(crawl).join(known, "target", "left_anti").groupBy("target").agg(F.count(F.lit(1)).alias("pages"))


# ---- more of the inventory

_CONTENTS = r"""
    l AS (SELECT doc_id, i, string_split_regex(text, '\r\n|\n|\r')[i + 1] AS s FROM documents, LATERAL (SELECT unnest(range(0, len(string_split_regex(text, '\r\n|\n|\r')))) AS i) WHERE length(text) > 0),
    h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq, length(regexp_extract(s, '^(#{1,6})', 1)) AS level, regexp_replace(regexp_replace(s, '^#{1,6}[ \t]+', ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS title
          FROM l WHERE regexp_matches(s, '^#{1,6}[ \t]+[^ \t]'))
"""


@query(f"WITH {_CONTENTS} SELECT doc_id, seq::INT AS seq, level::INT AS level, title, (seq * 3)::INT AS page FROM h")
def printed_contents(spark: SparkSession, sf: str) -> DataFrame:
    """The headings of each text printed as a list of contents, and read again."""
    h = G.headings(documents(spark, sf, "doc_id", "text"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "title", F.lit(" ..... "), F.col("seq") * 3)
    printed = h.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))).alias("r")).select("doc_id", F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("text"))
    return G.printed_contents(printed)


@query(r"""SELECT doc_id, CASE WHEN t <> '' THEN t ELSE 'none' END AS topic FROM (SELECT doc_id, regexp_replace(regexp_extract(text, '(?im)^[ \t"*-]*topic["*]*[ \t]*:[ \t]*([^\n]*)$', 1), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)""")
def document_fields(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", T.field_of(F.col("text"), "topic", "none").alias("topic"))


@query("SELECT doc_id, (list_concat(list_transform(list_filter(string_split(substr(title, 1, 32), ''), lambda c: c <> ''), lambda c: unicode(c)), list_transform(range(0, 32), lambda x: 0)))[1:32]::INT[] AS ids FROM documents WHERE title IS NOT NULL")
def title_characters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("title").isNotNull()).select("doc_id", T.character_ids(F.col("title"), 32).alias("ids"))


@query("""SELECT doc_id, sha256(coalesce(text, '') || to_json({'source_type': source_type, 'source_path': source_path})::VARCHAR) AS document_hash, substr(sha256(coalesce(source, '') || '|' || coalesce(title, '') || '|' || doc_id), 1, 16) AS key FROM documents""")
def document_hashes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.document_hash(F.col("text"), F.col("source_type"), F.col("source_path")).alias("document_hash"), T.fields_key(F.col("source"), F.col("title"), F.col("doc_id")).alias("key"))


@query(
    rf"""
    WITH v AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) > 20), n AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '')) AS n FROM documents),
    r AS (SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 10 THEN 'short' WHEN v.source IS NULL THEN 'orphan' END AS reason FROM n LEFT JOIN v USING (source)) SELECT * FROM r WHERE reason IS NOT NULL
    """
)
def index_fixes(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf, "doc_id", "text", "source")
    return V.index_fixes(d, d.groupBy("source").count().where("count > 20"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def tenant_documents(spark: SparkSession, sf: str) -> DataFrame:
    return V.tenant_rows(table(spark, sf, "documents").select("doc_id", "lang"), "de", "lang")


_OVERLAPPED = rf"""
    qw AS (SELECT doc_id AS query_id, list_distinct(list_filter(string_split_regex(lower(title), '{_WS}+'), lambda x: x <> '')) AS w FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
    qe AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM qw),
    dw AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '{_WS}+'), lambda x: x <> ''))) AS word FROM documents WHERE length(text) > 0),
    os AS (SELECT query_id, doc_id, round(count(*) / any_value(n), 6) AS score FROM qe JOIN dw USING (word) GROUP BY 1, 2),
    ov AS (SELECT query_id, doc_id, score FROM os QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10)
"""


@query(
    f"""
    WITH {_BM25}, {_OVERLAPPED}, u AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT query_id, doc_id, score FROM bm UNION ALL SELECT * FROM ov) GROUP BY 1, 2)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM u QUALIFY rank <= 10
    """
)
def variant_union(spark: SparkSession, sf: str) -> DataFrame:
    d, q = documents(spark, sf, "doc_id", "text"), _title_queries(spark, sf)
    return R.variant_union(list(R.lexical_lists(d, q)))


@query(
    f"""
    WITH {_BM25}, t AS (SELECT bm.query_id, bm.doc_id, bm.rank, bm.score / 40 AS score, d.text, greatest(1, length(d.text) // 4) AS n FROM bm JOIN documents d USING (doc_id)),
    z AS (SELECT *, sum(n) OVER (PARTITION BY query_id) <= 800 AS fits FROM t)
    SELECT query_id, doc_id AS chunk_id, score, text FROM z WHERE fits OR score >= 0.5
    UNION ALL SELECT query_id, NULL, 0.3, substr(string_agg(substr(text, 1, 1000), ' ' ORDER BY rank), 1, 1000) FROM z WHERE NOT fits AND score < 0.5 GROUP BY 1
    """
)
def stubbed_context(spark: SparkSession, sf: str) -> DataFrame:
    return X.pack_with_stub(_retrieved(spark, sf).withColumn("score", F.col("score") / 40), 800)


@query(
    f"""
    WITH {_BM25}, t AS (SELECT bm.query_id, bm.score / 100 AS score, d.source FROM bm JOIN documents d USING (doc_id)),
    g AS (SELECT query_id, avg(score) - 0.2::DOUBLE * (max(score) - min(score)) AS retrieval, count(DISTINCT source) FILTER (source <> '') AS sources, count(*) AS n FROM t GROUP BY 1)
    SELECT query_id, round(0.3::DOUBLE * greatest(0, least(1, retrieval)) + 0.2::DOUBLE * (CASE WHEN sources = 0 THEN 0.3 ELSE least(1, 2 * sources / n) END), 4) AS confidence FROM g
    """
)
def chunk_confidence(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _retrieved(spark, sf).withColumn("score", F.col("score") / 100)
    return X.confidence(chunks, chunks.select("query_id").distinct().withColumns({"question": F.lit(""), "answer": F.lit("")}))


@query(
    """
    WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, l_quantity AS x0, l_extendedprice AS y0 FROM lineitem), m AS (SELECT *, avg(x0) OVER (PARTITION BY doc_id) AS mean FROM e)
    SELECT doc_id, line, CASE WHEN x0 < mean THEN 'left' ELSE 'right' END AS side, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, line)::INT AS place FROM m
    """
)
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"), F.col("l_linenumber").alias("line"))
    return trees.reading_order(e, "line").select("doc_id", "line", "side", "place")


@query(
    """
    WITH t AS (SELECT user_id AS chat_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn_no, greatest(1, length(props) // 4) AS n FROM events),
    b AS (SELECT *, row_number() OVER w AS r, sum(n) OVER (PARTITION BY chat_id ORDER BY turn_no DESC ROWS UNBOUNDED PRECEDING) AS s FROM t WINDOW w AS (PARTITION BY chat_id ORDER BY turn_no DESC))
    SELECT chat_id, event_id FROM b WHERE r <= 10 AND s <= 16
    """
)
def chat_windows(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    turns = table(spark, sf, "events").select(F.col("user_id").alias("chat_id"), turn.alias("turn_no"), "event_id", F.col("props").alias("text"))
    return N.chat_window(turns, 10, 16).select("chat_id", "event_id")


SQL["reasoned"] = rf"""
    WITH p AS (SELECT item_id AS query_id, question, list_filter(list_transform(string_split_regex(question, '[ \t]+(?:and|or|but|,|\?)[ \t]+'),
               lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'), '^\?+|\?+$', '', 'g'), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: length(x) > 10) AS p FROM eval_items),
    e AS (SELECT query_id, unnest(p) AS part, unnest(range(0, len(p))) AS i FROM p),
    s AS (SELECT query_id, count(*) AS n, string_agg(part || ': ' || md5({_SAFE(f"('Answer in one sentence.' || {_NL} || part)")}), chr(10) ORDER BY i) AS context FROM e GROUP BY 1)
    SELECT p.query_id, coalesce(n, 0)::INT AS steps, md5({_SAFE(f"('Answer the question from the context alone; say so if it isn''t there.' || {_NL} || 'Context:' || chr(10) || coalesce(context, '') || {_NL} || 'Question: ' || question)")}) AS answer
    FROM p LEFT JOIN s USING (query_id)
"""

SQL["hashed_neighbours"] = (
    "WITH "
    + _EMBEDDED.format("d", f"SELECT doc_id AS id, unnest({_TERMS}) AS term FROM documents")
    + """,
    prod AS (SELECT q.id AS query_id, d.id AS vec_id, sum(q.w * d.w) AS s FROM de q JOIN de d USING (bucket) WHERE q.id % 100 = 0 GROUP BY 1, 2),
    every AS (SELECT q.id AS query_id, r.id AS vec_id, round(coalesce(s, 0) / q.norm / r.norm, 6) AS score FROM dn q JOIN dn r ON q.id <> r.id LEFT JOIN prod ON prod.query_id = q.id AND prod.vec_id = r.id WHERE q.id % 100 = 0)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM every QUALIFY rank <= 5
"""
)

SQL["vector_duplicates"] = """
    WITH RECURSIVE l AS (SELECT a.vec_id AS x, b.vec_id AS y, a.embedding <> b.embedding AS other FROM embeddings a JOIN embeddings b
                           ON a.vec_id <> b.vec_id AND (a.embedding = b.embedding OR round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.92)),
    r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
    SELECT r.x AS vec_id, min(r.y) AS class_id, coalesce(any_value(n), 0)::BIGINT AS links FROM r LEFT JOIN (SELECT x, count(*) FILTER (other) AS n FROM l GROUP BY 1) k ON k.x = r.x GROUP BY 1
"""
