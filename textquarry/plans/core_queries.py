"""Queries of the core operators over the given tables, and their SQL.

SQL is given where DuckDB can express the operator over whole tables; the others are tested against
brute force in tests/.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import redact, text as T
from textquarry.operators import analytics as A
from textquarry.operators import chunking as C
from textquarry.operators import context as X
from textquarry.operators import dedup as D
from textquarry.operators import governance as V
from textquarry.operators import graph as G
from textquarry.operators import questions as Q
from textquarry.operators import retrieval as R
from textquarry.operators import trees
from textquarry.operators.snapshots import latest_files, snapshot_changes, snapshot_order
from textquarry.session import spread, table
from textquarry.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The documents' columns that a query needs, spread over all cores."""
    d = table(spark, sf, "documents")
    return spread(d.select(*columns) if columns else d.select("doc_id", "text", "source", "lang", "title"))



def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# ---- chunking

_WS = r"[ \t\n\r\f]"


@query(
    """
    SELECT doc_id, (i / 900)::INT AS chunk_seq, i::INT AS start_index, least(i + 1000, length(text))::INT AS end_index, substr(text, (i + 1)::BIGINT, 1000) AS chunk
    FROM documents, LATERAL (SELECT unnest(range(0, length(text), 900)) AS i) WHERE length(text) > 0
    """
)
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return C.fixed_chunks(documents(spark, sf, "doc_id", "text"))


@query(
    """
    WITH p AS (SELECT doc_id, i, (i / 1400)::INT AS s, substr(text, (i + 1)::BIGINT, 1500) AS c
               FROM documents, LATERAL (SELECT unnest(range(0, length(text), 1400)) AS i) WHERE length(text) > 0)
    SELECT doc_id, 'parent_' || s AS chunk_id, NULL AS parent_chunk_id, 1 AS level, i::INT AS start_index, (i + length(c))::INT AS end_index FROM p
    UNION ALL
    SELECT doc_id, 'child_' || s || '_' || (j / 300)::INT, 'parent_' || s, 0, (i + j)::INT, (i + least(j + 300, length(c)))::INT
    FROM p, LATERAL (SELECT unnest(range(0, length(c), 300)) AS j)
    """
)
def chunk_hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    return C.parent_child_chunks(documents(spark, sf, "doc_id", "text"))


_SENTENCES = rf"""
    s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(31), 'g'), chr(31)),
            lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE length(text) > 0)
"""


@query(
    f"""
    WITH {_SENTENCES}
    SELECT doc_id, (i / 4)::INT AS chunk_seq, len(s[i + 1:i + 5])::INT AS num_sentences, array_to_string(s[i + 1:i + 5], ' ') AS chunk
    FROM s, LATERAL (SELECT unnest(range(0, len(s), 4)) AS i) WHERE len(s) > 0
    """
)
def chunk_sentence_window(spark: SparkSession, sf: str) -> DataFrame:
    return C.sentence_windows(documents(spark, sf, "doc_id", "text"))


@query(
    """
    WITH d AS (SELECT document_id, length(text) AS n, list_sort(list_distinct(list_filter(coalesce(from_json(nullif(metadata['page_breaks'], ''), '["INTEGER"]'), []), lambda b: b > 0 AND b < length(text)))) AS b
               FROM raw_documents WHERE length(text) > 0)
    SELECT document_id, i::INT AS page, (CASE WHEN i = 0 THEN 0 ELSE b[i] END)::INT AS start_index, coalesce(b[i + 1], n)::INT AS end_index
    FROM d, LATERAL (SELECT unnest(range(0, len(b) + 1)) AS i)
    """
)
def chunk_by_page(spark: SparkSession, sf: str) -> DataFrame:
    return C.page_chunks(table(spark, sf, "raw_documents"))


@query(
    rf"""
    WITH p AS (SELECT doc_id, string_split(regexp_replace(chr(10) || regexp_replace(text, '\r\n?', chr(10), 'g'), '\n#{{1,6}}[ \t]+([^\n]*)', chr(30) || '\1' || chr(10), 'g'), chr(30)) AS p
               FROM documents WHERE length(text) > 0),
    e AS (SELECT doc_id, i, p[i + 1] AS p FROM p, LATERAL (SELECT unnest(range(0, len(p))) AS i))
    SELECT * FROM (SELECT doc_id, i::INT AS chunk_seq, CASE WHEN i > 0 THEN regexp_replace(regexp_extract(p, '^([^\n]*)', 1), '^{_WS}+|{_WS}+$', '', 'g') END AS heading,
           regexp_replace(CASE WHEN i > 0 THEN regexp_replace(p, '^[^\n]*', '') ELSE p END, '^{_WS}+|{_WS}+$', '', 'g') AS chunk FROM e) WHERE chunk <> ''
    """
)
def chunk_by_heading(spark: SparkSession, sf: str) -> DataFrame:
    return C.heading_chunks(documents(spark, sf, "doc_id", "text"))


@query()
def chunk_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return C.paragraph_chunks(documents(spark, sf, "doc_id", "text"))


@query()
def chunk_strategy(spark: SparkSession, sf: str) -> DataFrame:
    return C.chosen_strategy(documents(spark, sf, "doc_id", "text"))


# ---- scalar functions


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS clean FROM documents")
def text_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(
    rf"""
    WITH w AS (SELECT doc_id, text, coalesce(length(text), 0) AS n, list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '') AS w FROM documents),
    y AS (SELECT *, len(regexp_extract_all(text, '[.!?]')) AS s, least(len(w), 1000) AS k,
            list_sum(list_transform(w[1:1000], lambda x: CASE WHEN regexp_replace(lower(x), '[^a-z0-9]', '', 'g') = '' THEN 0
                ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(x), '[^a-z0-9]', '', 'g'), '[aeiouy]+'))) END)) AS y FROM w),
    f AS (SELECT *, CASE WHEN n > 0 THEN least(100, floor(length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) * 100 / n))::BIGINT ELSE 0 END AS density,
            CASE WHEN n > 50 AND s > 0 AND len(w) > 0 THEN greatest(0, least(100, trunc(206.835::DOUBLE - 1.015::DOUBLE * (len(w)::DOUBLE / s) - 84.6::DOUBLE * (y::DOUBLE / k))))::BIGINT ELSE 50 END AS readability FROM y)
    SELECT doc_id, greatest(1, n // 4)::BIGINT AS tokens, len(w)::INT AS words, floor(len(w) * 1.33::DOUBLE)::BIGINT AS model_tokens, density, readability,
           ((density * 20 + readability * 15 + (CASE WHEN n > 0 THEN 40 ELSE 20 END) * 25 + (CASE WHEN n > 0 THEN 100 ELSE 0 END) * 25 + 750) // 100)::BIGINT AS overall
    FROM f WHERE text IS NOT NULL
    """
)
def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    scored = T.quality(documents(spark, sf, "doc_id", "text").where(text.isNotNull()))
    return scored.select(
        "doc_id",
        T.estimated_tokens(text).alias("tokens"),
        "words",
        F.floor(F.col("words") * 1.33).cast("bigint").alias("model_tokens"),
        "density",
        "readability",
        "overall",
    )


def _sql_replace(column: str, rules) -> str:
    for pattern, label in rules:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{label}', 'g')"
    return column


@query(f"SELECT doc_id, {_sql_replace('text', redact.PII)} AS redacted FROM documents")
def redact_pii(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").select("doc_id", redact.redact_pii(F.col("text")).alias("redacted"))


@query(
    "SELECT doc_id, "
    + ", ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))::BIGINT AS {n}" for n, _, p, _ in redact.SECRETS)
    + " FROM documents WHERE text IS NOT NULL"
)
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", *redact.secret_counts(F.col("text")))


@query(f"SELECT doc_id, {_sql_replace('text', [(p, label) for _, _, p, label in redact.SECRETS])} AS redacted FROM documents")
def secret_redaction(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").select("doc_id", redact.redact_secrets(F.col("text")).alias("redacted"))


@query(r"SELECT doc_id, substr(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), 1, 100000) AS safe FROM documents")
def text_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.sanitise_input(F.col("text")).alias("safe"))


_SCRIPT_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS script, len(regexp_extract_all(text, '{p}')) AS n FROM documents WHERE text IS NOT NULL" for s, p in T.SCRIPTS.items())


@query(f"SELECT doc_id, script FROM (SELECT doc_id, CASE WHEN n > 0 THEN script END AS script, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, script) AS r FROM ({_SCRIPT_ROWS})) WHERE r = 1")
def text_script(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", T.script_of(F.col("text")).alias("script"))


@query("SELECT doc_id, md5(text) AS text_md5, sha256(text) AS text_sha256, substr(sha256(text), 1, 16) AS short_hash FROM documents WHERE text IS NOT NULL")
def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").where(text.isNotNull()).select(
        "doc_id", F.md5(text).alias("text_md5"), F.sha2(text, 256).alias("text_sha256"), F.substring(F.sha2(text, 256), 1, 16).alias("short_hash")
    )


@query(
    """
    SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(((s % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0')
           ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS stamp FROM (SELECT event_id, (value * 60)::DOUBLE AS v, floor(value * 60)::BIGINT AS s FROM events)
    """
)
def time_stamps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.clock(F.col("value") * 60).alias("stamp"))


# ---- retrieval

_TERMS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY term")
def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return R.term_statistics(documents(spark, sf, "doc_id", "text"))


def _title_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The titles of the documents whose id is divisible by 100, as queries."""
    d = table(spark, sf, "documents")
    return d.where((F.col("doc_id") % 100 == 0) & F.col("title").isNotNull()).select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


_BM25 = f"""
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY 1, 2),
    l AS (SELECT doc_id, len({_TERMS}) AS dl FROM documents WHERE len({_TERMS}) > 0),
    n AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM l),
    q AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT query_id, doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id), n GROUP BY 1, 2),
    bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10)
"""


@query(f"WITH {_BM25} SELECT * FROM bm")
def bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(documents(spark, sf, "doc_id", "text"), _title_queries(spark, sf))


_OVERLAP = rf"""
    qw AS (SELECT doc_id AS query_id, list_distinct(list_filter(string_split_regex(lower(title), '{_WS}+'), lambda x: x <> '')) AS w FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
    qe AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM qw),
    dw AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '{_WS}+'), lambda x: x <> ''))) AS word FROM documents WHERE length(text) > 0),
    os AS (SELECT query_id, doc_id, round(count(*) / any_value(n), 6) AS score FROM qe JOIN dw USING (word) GROUP BY 1, 2),
    ov AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM os QUALIFY rank <= 10)
"""


@query(f"WITH {_OVERLAP} SELECT * FROM ov")
def keyword_top(spark: SparkSession, sf: str) -> DataFrame:
    return R.keyword_overlap(documents(spark, sf, "doc_id", "text"), _title_queries(spark, sf))


@query(
    f"""
    WITH {_BM25}, {_OVERLAP}, u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (rank - 1 + 60) AS s FROM bm UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (rank - 1 + 60) FROM ov),
    f2 AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM u GROUP BY 1, 2)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f2 QUALIFY rank <= 10
    """
)
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    d, q = documents(spark, sf, "doc_id", "text"), _title_queries(spark, sf)
    return R.reciprocal_rank_fusion(list(R.lexical_lists(d, q)))


@query(
    f"""
    WITH {_BM25}, {_OVERLAP}, wt AS (SELECT doc_id AS query_id, CASE WHEN len(t) <= 2 THEN 0.2 ELSE round(0.3 + 0.5::DOUBLE * len(list_distinct(t)) / len(t), 6) END AS sw,
            CASE WHEN len(t) <= 2 THEN 0.8 ELSE round(1 - (0.3 + 0.5::DOUBLE * len(list_distinct(t)) / len(t)), 6) END AS dw
            FROM (SELECT doc_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS t FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)),
    sp AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS sparse FROM bm),
    b AS (SELECT query_id, doc_id, coalesce(ov.score, 0) AS dense, coalesce(sparse, 0) AS sparse FROM ov FULL JOIN sp USING (query_id, doc_id)),
    f2 AS (SELECT query_id, doc_id, round(dense * dw + sparse * sw, 6) AS score FROM b JOIN wt USING (query_id))
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f2 QUALIFY rank <= 10
    """
)
def linear_fusion(spark: SparkSession, sf: str) -> DataFrame:
    d, q = documents(spark, sf, "doc_id", "text"), _title_queries(spark, sf)
    weights = q.select("query_id", *(c.alias(n) for n, c in R.query_weights(F.col("query")).items()))
    sparse, dense = R.lexical_lists(d, q)
    return R.linear_fusion(dense, sparse, weights)


@query(
    """
    WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score
               FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10
    """
)
def dense_top(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return R.vector_search(e, e.where(F.col("vec_id") % 100 == 0))


@query(
    """
    WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, round(-list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score
               FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10
    """
)
def l2_top(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return R.vector_search(e, e.where(F.col("vec_id") % 100 == 0), metric="l2")


# ---- duplicates


@query("SELECT md5(text) AS text_md5, count(*)::BIGINT AS n, min(doc_id) AS first_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents WHERE length(text) > 0 GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return D.exact_groups(table(spark, sf, "documents"))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE length(text) > 0 GROUP BY substr(text, 1, 100), source")
def duplicate_heads(spark: SparkSession, sf: str) -> DataFrame:
    return D.first_of_each(table(spark, sf, "documents"))


@query()
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return D.minhash_classes(documents(spark, sf, "doc_id", "text"))


# ---- context and evaluation

_W = lambda c: rf"list_distinct(list_filter(string_split_regex(lower(coalesce({c}, '')), '{_WS}+'), lambda x: x <> ''))"


@query(
    f"""
    WITH f AS (SELECT DISTINCT ON (example_id) example_id AS id, {_W('instruction')} AS q, {_W('input')} AS c, {_W('output')} AS a FROM fine_tune_examples)
    SELECT id, CASE WHEN len(q) > 0 THEN round(len(list_intersect(a, q)) / len(q), 6) ELSE 0 END AS relevance,
           CASE WHEN len(a) > 0 THEN round(len(list_intersect(c, a)) / len(a), 6) ELSE 0 END AS faithfulness,
           CASE WHEN len(list_distinct(list_concat(a, c))) > 0 THEN round(len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))), 6) ELSE 0 END AS jaccard FROM f
    """
)
def answer_measures(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "fine_tune_examples").dropDuplicates(["example_id"])
    return X.answer_measures(x.select(F.col("example_id").alias("id"), F.col("instruction").alias("question"), F.col("input").alias("context"), F.col("output").alias("answer")))


@query(
    """
    WITH c AS (SELECT item_id AS claim_id, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS w FROM eval_items),
    s AS (SELECT item_id AS sentence_id, list_distinct(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS w FROM eval_items),
    p AS (SELECT claim_id, sentence_id, round(len(list_intersect(c.w, s.w)) / len(list_distinct(list_concat(c.w, s.w))), 6) AS score FROM c, s WHERE len(list_intersect(c.w, s.w)) > 0)
    SELECT claim_id, sentence_id, score, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, sentence_id)::INT AS rank FROM p WHERE score >= 0.1 QUALIFY rank <= 3
    """
)
def cited_passages(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_items")
    return X.citations(e.select(F.col("item_id").alias("claim_id"), F.col("answer").alias("text")), e.select(F.col("item_id").alias("sentence_id"), F.col("passage").alias("text")))


def _retrieved(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf, "doc_id", "text", "source")
    top = R.bm25(d, _title_queries(spark, sf))
    return top.join(d.select("doc_id", "text", "source"), "doc_id").withColumnsRenamed({"doc_id": "chunk_id", "rank": "position"})


@query()
def packed_context(spark: SparkSession, sf: str) -> DataFrame:
    return X.pack_by_score(_retrieved(spark, sf), 800)


@query()
def packed_in_turns(spark: SparkSession, sf: str) -> DataFrame:
    return X.pack_round_robin(_retrieved(spark, sf), 800)


@query()
def answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _retrieved(spark, sf).withColumn("score", F.col("score") / 100)
    answers = _title_queries(spark, sf).select("query_id", F.col("query").alias("question"), F.col("query").alias("answer"))
    return X.confidence(chunks, answers)


# ---- analytics of the event log


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1")
def event_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.summary(table(spark, sf, "events"), "event_type")


@query(
    """
    WITH e AS (SELECT *, max(ts) OVER () AS m FROM events)
    SELECT count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate,
           count(*) FILTER (ts > m - INTERVAL 1 HOUR)::BIGINT AS last_hour, count(*) FILTER (ts > m - INTERVAL 1 DAY)::BIGINT AS last_day,
           round(coalesce(sum(value) FILTER (ts > m - INTERVAL 1 DAY), 0), 4) AS value_last_day FROM e
    """
)
def event_totals(spark: SparkSession, sf: str) -> DataFrame:
    return A.totals(table(spark, sf, "events"))


@query(
    """
    WITH h AS (SELECT unnest(range(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour FROM events),
    p AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, avg(value) AS m FROM events GROUP BY 1)
    SELECT hour, coalesce(n, 0)::BIGINT AS n, round(coalesce(m, 0), 6) AS mean_value FROM h LEFT JOIN p USING (hour)
    """
)
def hourly_series(spark: SparkSession, sf: str) -> DataFrame:
    return A.hourly_series(table(spark, sf, "events"))


@query(
    """
    SELECT b::INT AS bin, (b * 10) || '-' || ((b + 1) * 10) || '%' AS label, count(*)::BIGINT AS n
    FROM (SELECT least(floor(k / 100 * 10), 9)::INT AS b FROM (SELECT (props->>'k')::DOUBLE AS k FROM events)) GROUP BY 1, 2
    """
)
def share_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.histogram(table(spark, sf, "events"), F.get_json_object("props", "$.k").cast("double") / 100)


@query(
    """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(value) FILTER (r = least(floor(n * 0.5), n - 1) + 1) AS p50, max(value) FILTER (r = least(floor(n * 0.95), n - 1) + 1) AS p95, max(value) FILTER (r = least(floor(n * 0.99), n - 1) + 1) AS p99 FROM r GROUP BY 1
    """
)
def value_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return A.percentiles(table(spark, sf, "events"), "event_type")


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def busiest_users(spark: SparkSession, sf: str) -> DataFrame:
    return A.most_frequent(table(spark, sf, "events"), "user_id")


_BUCKET = "((((('0x' || substr(h, 1, 8))::BIGINT % 100) * 96 + ('0x' || substr(h, 9, 8))::BIGINT) % 100 * 96 + ('0x' || substr(h, 17, 8))::BIGINT) % 100 * 96 + ('0x' || substr(h, 25, 8))::BIGINT) % 100"
_VARIANTS = f"""
    WITH v AS (SELECT *, CASE WHEN {_BUCKET} < 50 THEN 0 ELSE 1 END AS variant FROM (SELECT *, md5(user_id::VARCHAR) AS h FROM events)),
    m AS (SELECT variant::INT AS variant, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, round(avg(value), 6) AS mean_value, round(coalesce(stddev_samp(value), 0), 6) AS std_value,
          round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM v GROUP BY 1)
"""


@query(_VARIANTS + "SELECT * FROM m")
def variant_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return A.variant_metrics(table(spark, sf, "events"))


@query(
    _VARIANTS
    + """, r AS (SELECT *, row_number() OVER (ORDER BY mean_value DESC, variant) AS r FROM m),
    g AS (SELECT max(variant) FILTER (r = 1) AS winner, round(max(mean_value) FILTER (r = 1) - max(mean_value) FILTER (r = 2), 6) AS gap, min(n) AS n FROM r)
    SELECT winner, gap, round(CASE WHEN n < 100 THEN 0 ELSE (least(n / 100, 1) + least(5 * abs(gap), 1)) / 2 END, 6) AS confidence FROM g"""
)
def experiment_report(spark: SparkSession, sf: str) -> DataFrame:
    return A.experiment_report(A.variant_metrics(table(spark, sf, "events")))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)::BIGINT AS in_window FROM events")
def rate_windows(spark: SparkSession, sf: str) -> DataFrame:
    return A.trailing_counts(table(spark, sf, "events"))


@query("SELECT ts::DATE AS day, round(sum(value), 4) AS spent, (CASE WHEN round(sum(value), 4) > 17000 THEN 2 WHEN round(sum(value), 4) >= 13600 THEN 1 ELSE 0 END)::INT AS level FROM events GROUP BY 1")
def budget_levels(spark: SparkSession, sf: str) -> DataFrame:
    return A.budget_levels(table(spark, sf, "events"), 17_000.0)


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent_today FROM events")
def running_spend(spark: SparkSession, sf: str) -> DataFrame:
    return A.running_spend(table(spark, sf, "events"))


@query(
    """
    WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(f::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2
    """
)
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return A.sessions(table(spark, sf, "events"))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return A.tumbling(table(spark, sf, "events"))


_RATES = {"mini-64": (0.00002, 0.0), "wide-128": (0.00013, 0.0), "base-96": (0.0001, 0.0)}


@query(
    "SELECT id AS snapshot_id, round(CASE embedding_model "
    + " ".join(f"WHEN '{m}' THEN chunk_size / 1000 * {a}::DOUBLE" for m, (a, _) in _RATES.items())
    + " ELSE 0 END, 6) AS cost FROM snapshots"
)
def embedding_cost(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "snapshots").select(F.col("id").alias("snapshot_id"), A.token_cost(F.col("chunk_size"), F.lit(0), F.col("embedding_model"), _RATES).alias("cost"))


# ---- structure and graph


@query(
    r"""
    WITH l AS (SELECT doc_id, i, string_split_regex(text, '\r\n|\n|\r')[i + 1] AS s FROM documents, LATERAL (SELECT unnest(range(0, len(string_split_regex(text, '\r\n|\n|\r')))) AS i) WHERE length(text) > 0),
    h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq, length(regexp_extract(s, '^(#{1,6})', 1)) AS level, regexp_replace(regexp_replace(s, '^#{1,6}[ \t]+', ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS title
          FROM l WHERE regexp_matches(s, '^#{1,6}[ \t]+[^ \t]'))
    SELECT doc_id, seq::INT AS seq, level::INT AS level, title, (SELECT max(p.seq) FROM h p WHERE p.doc_id = h.doc_id AND p.seq < h.seq AND p.level < h.level)::INT AS parent_seq FROM h
    """
)
def contents_tree(spark: SparkSession, sf: str) -> DataFrame:
    return G.headings(documents(spark, sf, "doc_id", "text"))


_H = " UNION ALL ".join(
    rf"SELECT page_id, {k} AS level, unnest(regexp_extract_all(html, '(?is)<h{k}(?:[ \t\n][^>]*)?>(.*?)</h{k}>', 1)) AS t FROM crawl_results WHERE length(html) > 0" for k in range(1, 7)
)


@query(rf"SELECT page_id, level::INT AS level, regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS title FROM ({_H})")
def page_headings(spark: SparkSession, sf: str) -> DataFrame:
    return G.html_headings(table(spark, sf, "crawl_results"))


@query(
    rf"""
    WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g'))) AS s FROM documents WHERE length(text) > 0)
    SELECT doc_id, CASE WHEN starts_with(s, '#') THEN 'heading' WHEN regexp_matches(s, '^\|.*\|') THEN 'table' WHEN regexp_matches(s, '^[-*] ') THEN 'list' WHEN starts_with(s, '```') THEN 'code' ELSE 'text' END AS element, count(*)::BIGINT AS n
    FROM l WHERE s <> '' GROUP BY 1, 2
    """
)
def layout_elements(spark: SparkSession, sf: str) -> DataFrame:
    return G.layout(documents(spark, sf, "doc_id", "text"))


# \b knows only ASCII in DuckDB: other letters become an ASCII word character first
_ASCII_WORDS = r"regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}\x{F900}-\x{FDFF}]', '_', 'g')"
_E = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS entity_type, unnest(regexp_extract_all({_ASCII_WORDS}, '{p}')) AS label FROM documents" for t, p in G.ENTITIES)


@query(f"SELECT entity_type, label, count(*)::BIGINT AS mentions, count(DISTINCT doc_id)::BIGINT AS docs FROM ({_E}) GROUP BY 1, 2")
def entity_index(spark: SparkSession, sf: str) -> DataFrame:
    return G.entities(documents(spark, sf, "doc_id", "text"))


@query()
def entity_relations(spark: SparkSession, sf: str) -> DataFrame:
    return G.relations(documents(spark, sf, "doc_id", "text"))


_LINKS = r"""
    h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS o, unnest(regexp_extract_all(html, '<[aA][ \t\n][^>]*href="([^"#]+)', 1)) AS h FROM crawl_results WHERE length(html) > 0),
    t AS (SELECT DISTINCT page_id, CASE WHEN regexp_matches(h, '^[a-z]+://') THEN h WHEN starts_with(h, '/') THEN o || h END AS target FROM h),
    k AS (SELECT page_id, target FROM t WHERE target IS NOT NULL)
"""


@query(f"WITH {_LINKS} SELECT * FROM k")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return G.page_links(table(spark, sf, "crawl_results"))


@query(
    rf"""
    WITH {_LINKS}, b AS (SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM crawl_results)
    SELECT host, count(DISTINCT page_id)::BIGINT AS pages, count(target)::BIGINT AS links, count(DISTINCT target)::BIGINT AS targets FROM b LEFT JOIN k USING (page_id) GROUP BY 1
    """
)
def link_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.link_degrees(table(spark, sf, "crawl_results"))


# ---- questions


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))


def _has(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


_KIND = "CASE " + " ".join(f"WHEN {_has('l', ps)} THEN '{k}'" for k, ps in Q.TYPES) + rf" WHEN len(list_filter(string_split_regex(l, '{_WS}+'), lambda x: x <> '')) <= 2 THEN 'keyword' ELSE 'exploratory' END"


@query(
    rf"""
    WITH q AS (SELECT item_id AS query_id, question AS q, lower(question) AS l, regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+') AS t FROM eval_items WHERE question IS NOT NULL),
    k AS (SELECT *, {_KIND} AS question_type FROM q),
    p AS (SELECT *, least(10, (CASE WHEN len(t) > 10 THEN 3 ELSE 0 END) + (CASE WHEN len(list_distinct(t)) > 8 THEN 2 ELSE 0 END) + (CASE WHEN {_has('l', Q.QUALIFIERS)} THEN 2 ELSE 0 END)
            + (CASE WHEN contains(q, '?') THEN 1 ELSE 0 END) + (CASE WHEN question_type IN ('analytical', 'comparative') THEN 2 ELSE 0 END)) AS p FROM k)
    SELECT query_id, len(t)::INT AS term_count, question_type, p / 10 AS complexity, question_type IN ('analytical', 'comparative') OR p > 5 OR (len(t) <= 3 AND question_type = 'keyword') AS hyde,
           question_type IN ('analytical', 'comparative') OR p > 6 AS multi_query, (CASE question_type WHEN 'comparative' THEN 10 WHEN 'analytical' THEN 7 WHEN 'exploratory' THEN 7 WHEN 'factual' THEN 3 ELSE 5 END)::INT AS top_k FROM p
    """
)
def question_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return Q.analyse(_questions(spark, sf))


@query("SELECT item_id AS query_id, CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{k}'" for k, p in Q.INTENTS) + " ELSE 'factual' END AS intent FROM eval_items")
def question_intent(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("query_id", Q.intent(F.col("query")).alias("intent"))


_SPAN = r"(?i)(?:in|from|during)[ \t]+(\d{4})[ \t]*(?:to|through|-)[ \t]*(\d{4})"
_YEAR = r"(?i)(?:in|from|during)[ \t]+(\d{4})"


@query(
    f"""
    SELECT doc_id, coalesce(nullif(regexp_extract(text, '{_SPAN}', 1), ''), nullif(regexp_extract(text, '{_YEAR}', 1), '')) AS year_from,
           coalesce(nullif(regexp_extract(text, '{_SPAN}', 2), ''), nullif(regexp_extract(text, '{_YEAR}', 1), '')) AS year_to,
           nullif(regexp_extract(text, '(?i)(?:author|by)[ \\t]+["'']([^"'']+)["'']', 1), '') AS author, nullif(regexp_extract(text, '(?i)(?:section|chapter|article)[ \\t]+(\\d+)', 1), '') AS section
    FROM documents WHERE text IS NOT NULL
    """
)
def named_filters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", *(c.alias(n) for n, c in Q.filters(F.col("text")).items()))


@query(
    r"""
    WITH p AS (SELECT example_id AS query_id, list_filter(list_transform(string_split_regex(instruction, '[ \t]+(?:and|or|but|,|\?)[ \t]+'),
               lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'), '^\?+|\?+$', '', 'g'), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: length(x) > 10) AS p
               FROM (SELECT DISTINCT ON (example_id) example_id, instruction FROM fine_tune_examples) WHERE instruction IS NOT NULL)
    SELECT query_id, i::INT AS part_no, p[i + 1] AS part FROM p, LATERAL (SELECT unnest(range(0, len(p))) AS i)
    """
)
def question_parts(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "fine_tune_examples").dropDuplicates(["example_id"])
    return Q.parts(x.select(F.col("example_id").alias("query_id"), F.col("instruction").alias("query")))


# ---- governance and versions


@query("SELECT count(*)::BIGINT AS texts, " + ", ".join(f"count(*) FILTER ({c})::BIGINT AS {n}" for n, c in (("empty", "w = 0"), ("short", "w > 0 AND w < 10"), ("long", "w > 3000"), ("no_source", "coalesce(source, '') = ''"), ("no_lang", "lang IS NULL"))) + rf" FROM (SELECT *, len(list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '')) AS w FROM documents)")
def index_report(spark: SparkSession, sf: str) -> DataFrame:
    return V.index_report(table(spark, sf, "documents"))


_RULES = [("handbook/*", ["editor"]), ("share0?/pdf.*", ["reader", "editor"]), ("share1*", ["*"])]


@query(
    r"""
    SELECT source_path AS path, CASE WHEN regexp_matches(source_path, '^handbook/.*$') THEN 'handbook/*' WHEN regexp_matches(source_path, '^share0./pdf\..*$') THEN 'share0?/pdf.*' WHEN regexp_matches(source_path, '^share1.*$') THEN 'share1*' END AS rule,
           CASE WHEN regexp_matches(source_path, '^handbook/.*$') THEN false WHEN regexp_matches(source_path, '^share0./pdf\..*$') THEN true WHEN regexp_matches(source_path, '^share1.*$') THEN true ELSE false END AS allowed
    FROM documents WHERE source_path IS NOT NULL
    """
)
def access_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return V.decide_access(table(spark, sf, "documents").select(F.col("source_path").alias("path")), _RULES, ["reader"])


@query(
    r"""
    SELECT page_id, CASE WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme' WHEN h = '' THEN 'host'
           WHEN regexp_matches(h, '^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)') OR h IN ('localhost', 'metadata.google.internal') THEN 'private' ELSE 'ok' END AS verdict
    FROM (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS h FROM crawl_results)
    """
)
def url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl_results").select("page_id", V.url_verdict(F.col("url")).alias("verdict"))


@query(r"SELECT id, contains(path, chr(0)) OR regexp_matches(path, '^(//|\\\\)') OR regexp_matches(path, '(^|[/\\])\.\.([/\\]|$)') AS traversal FROM source_files")
def path_traversal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files").select("id", V.is_traversal(F.col("path")).alias("traversal"))


@query("SELECT s.id AS snapshot_id, collection, s.created_at, tag, count(f.id)::BIGINT AS files, coalesce(sum(chunk_count), 0)::BIGINT AS chunks FROM snapshots s LEFT JOIN source_files f ON f.snapshot_id = s.id GROUP BY ALL")
def snapshot_list(spark: SparkSession, sf: str) -> DataFrame:
    return V.snapshot_list(table(spark, sf, "snapshots"), table(spark, sf, "source_files"))


@query()
def version_changelog(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "snapshots")
    return V.changelog(snapshot_changes(table(spark, sf, "source_files"), s), s)


@query()
def rollback_plan(spark: SparkSession, sf: str) -> DataFrame:
    order = snapshot_order(table(spark, sf, "snapshots"))
    return V.rollback_plan(latest_files(table(spark, sf, "source_files"), order), order.select("collection", "seq"))


@query("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def source_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l.doc_id, l.subject FROM subject_labels l ANTI JOIN (SELECT doc_id FROM documents WHERE length(text) > 0) d USING (doc_id)")
def orphan_labels(spark: SparkSession, sf: str) -> DataFrame:
    full = table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id")
    return table(spark, sf, "subject_labels").join(full, "doc_id", "left_anti").select("doc_id", "subject")


@query("SELECT vec_id, access_count, created_at FROM embedding_store QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY created_at DESC) = 1")
def embedding_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return V.latest_version(table(spark, sf, "embedding_store").select("vec_id", "access_count", "created_at"), "vec_id", "created_at")


@query("SELECT vec_id, CASE WHEN max(access_count) >= 10 THEN 'hot' WHEN max(access_count) >= 3 THEN 'warm' ELSE 'cold' END AS tier FROM embedding_store GROUP BY 1")
def cache_tiers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.max("access_count")
    return table(spark, sf, "embedding_store").groupBy("vec_id").agg(F.when(n >= 10, "hot").when(n >= 3, "warm").otherwise("cold").alias("tier"))


# ---- trees, diffs, exports


@query()
def summary_tree(spark: SparkSession, sf: str) -> DataFrame:
    return trees.summary_tree(C.sentence_windows(documents(spark, sf, "doc_id", "text")))


@query()
def document_topics(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(F.length("text") > 0)
    return d.select("doc_id", F.array_join(trees.topics(F.col("text")), "; ").alias("topics"))


@query()
def answer_diffs(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "fine_tune_examples").dropDuplicates(["example_id"])
    return trees.diff_counts(trees.line_diff(x.select(F.col("example_id").alias("id"), F.col("input").alias("old"), F.col("output").alias("new"))))


_ONE = "(SELECT DISTINCT ON (example_id) * FROM fine_tune_examples)"
_ASKED = "CASE WHEN coalesce(input, '') = '' THEN coalesce(instruction, '') ELSE coalesce(instruction, '') || chr(10) || chr(10) || input END"


@query(f"SELECT example_id, to_json({{'instruction': coalesce(instruction, ''), 'input': coalesce(input, ''), 'output': coalesce(output, '')}})::VARCHAR AS json FROM {_ONE}")
def export_alpaca(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.alpaca(table(spark, sf, "fine_tune_examples").dropDuplicates(["example_id"]))


@query(f"SELECT example_id, to_json({{'conversations': [{{'from': 'human', 'value': {_ASKED}}}, {{'from': 'gpt', 'value': coalesce(output, '')}}]}})::VARCHAR AS json FROM {_ONE}")
def export_sharegpt(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.sharegpt(table(spark, sf, "fine_tune_examples").dropDuplicates(["example_id"]))


@query(f"SELECT example_id, to_json({{'messages': [{{'role': 'user', 'content': {_ASKED}}}, {{'role': 'assistant', 'content': coalesce(output, '')}}]}})::VARCHAR AS json FROM {_ONE}")
def export_messages(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.messages(table(spark, sf, "fine_tune_examples").dropDuplicates(["example_id"]))


@query("SELECT item_id, to_json({'question': coalesce(question, ''), 'answer': coalesce(answer, ''), 'contexts': [coalesce(passage, '')], 'ground_truth': coalesce(answer, '')})::VARCHAR AS json FROM eval_items")
def export_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.evaluation_records(table(spark, sf, "eval_items"))


@query()
def export_documents(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.document_records(table(spark, sf, "documents"))


@query(
    SQL["contents_tree"].replace("SELECT doc_id, seq::INT AS seq, level::INT AS level, title, (SELECT", "SELECT doc_id, string_agg(repeat('  ', level - 1) || '- ' || title, chr(10) ORDER BY seq) AS contents FROM h GROUP BY 1 --")
    .split("--")[0]
)
def contents_list(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.contents_markdown(G.headings(documents(spark, sf, "doc_id", "text")))


# ---- more of the inventory


@query()
def chunk_by_token(spark: SparkSession, sf: str) -> DataFrame:
    return C.token_chunks(documents(spark, sf, "doc_id", "text"))


@query(
    """
    SELECT a.vec_id, count(b.vec_id)::BIGINT AS links FROM embeddings a LEFT JOIN embeddings b
    ON a.vec_id <> b.vec_id AND a.embedding <> b.embedding AND round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.4 GROUP BY 1
    """
)
def vector_links(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return D.vector_classes(e, 0.4).select("vec_id", "links")


@query()
def vector_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return D.vector_classes(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(*)::BIGINT AS n FROM events GROUP BY 1")
def score_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return A.score_aggregate(table(spark, sf, "events"), "event_type", "value")


@query(
    """
    WITH m AS (SELECT event_type AS metric, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS before, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS now FROM events GROUP BY 1)
    SELECT metric, round(now, 6) AS now, round(before, 6) AS before, CASE WHEN round(now, 6) - round(before, 6) < -1 THEN 'regression' WHEN round(now, 6) - round(before, 6) > 1 THEN 'improvement' ELSE 'same' END AS verdict FROM m
    """
)
def metric_regressions(spark: SparkSession, sf: str) -> DataFrame:
    e, half = table(spark, sf, "events"), F.lit("2024-01-16").cast("timestamp_ntz")
    mean = lambda x: x.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return A.regressions(mean(e.where(F.col("ts") >= half)), mean(e.where(F.col("ts") < half)), 1.0)


@query("SELECT user_id AS question_id, round(sum(step * value) / sum(step), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) GROUP BY 1")
def step_confidence(spark: SparkSession, sf: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return A.step_confidence(table(spark, sf, "events").select(F.col("user_id").alias("question_id"), step.alias("step"), F.col("value").alias("confidence")))


@query("SELECT user_id::VARCHAR AS \"user\", count(*)::BIGINT AS requests, count(*) FILTER (event_type = 'error')::BIGINT AS denied, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS denial_rate FROM events GROUP BY 1")
def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    return A.audit_report(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user"), (F.col("event_type") != "error").alias("allowed")))


@query("SELECT user_id AS session_id, (CASE WHEN n >= 5 AND c < 0.5 THEN 10 WHEN n >= 5 AND c < 0.7 THEN 7 ELSE 5 END)::INT AS top_k, n >= 5 AND c < 0.5 AS hyde, n >= 5 AND c < 0.7 AS multi_query FROM (SELECT user_id, count(*) AS n, avg(value / 100) AS c FROM events GROUP BY 1)")
def tuned_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return Q.tuned(table(spark, sf, "events").select(F.col("user_id").alias("session_id"), (F.col("value") / 100).alias("confidence")))


_DOMAINS = ", ".join("[" + ", ".join(f"'{w}'" for w in keys) + "]" for _, _, _, keys in Q.PRESETS)


@query(
    f"""
    WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE length(text) > 0),
    n AS (SELECT doc_id, list_transform([{_DOMAINS}], lambda k: len(list_intersect(w, k))) AS n FROM w)
    SELECT doc_id, CASE WHEN list_max(n) = 0 THEN 'general' ELSE (['financial', 'legal', 'medical', 'academic'])[list_position(n, list_max(n))] END AS domain FROM n
    """
)
def document_domain(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").where(F.length("text") > 0).select("doc_id", Q.domain(F.col("text")).alias("domain"))


@query()
def made_examples(spark: SparkSession, sf: str) -> DataFrame:
    return trees.made_examples(documents(spark, sf, "doc_id", "text"))


@query("SELECT user_id AS question_id, round(sum((value / 1000) * (value / 1000)) / sum(value / 1000), 6) AS confidence, sum(event_id)::BIGINT AS latency_ms, round(sum(value), 6) AS cost FROM events GROUP BY 1")
def merged_results(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return R.merged_results(e.select(F.col("user_id").alias("question_id"), (F.col("value") / 1000).alias("confidence"), F.col("event_id").alias("latency_ms"), F.col("value").alias("cost")))


@query(
    f"""
    WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY 1, 2),
    s AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64)::INT AS bucket, sum(CASE WHEN ('0x' || substr(md5(term), 9, 8))::BIGINT % 2 = 0 THEN tf ELSE -tf END)::DOUBLE AS w FROM p GROUP BY 1, 2)
    SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM s WHERE w <> 0
    """
)
def hashed_terms(spark: SparkSession, sf: str) -> DataFrame:
    return R.hashed_terms(documents(spark, sf, "doc_id", "text"))


@query()
def hashed_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    e = R.hashed_embeddings(documents(spark, sf, "doc_id", "text")).withColumnRenamed("doc_id", "vec_id")
    return R.vector_search(e, e.where(F.col("vec_id") % 100 == 0), 5)


@query(
    r"""
    SELECT count(*)::BIGINT AS texts, round(avg(len(regexp_extract_all(text, '(?m)^#{1,6} '))), 6) AS headings, round(avg(len(regexp_extract_all(text, '(?m)^```'))), 6) AS code,
           round(avg(len(regexp_extract_all(text, '\f'))), 6) AS pages, round(avg(len(regexp_extract_all(text, '(?m)^\|.*\|'))), 6) AS rows,
           CASE WHEN round(avg(len(regexp_extract_all(text, '\f'))), 6) > 0.5 THEN 'by_page' WHEN round(avg(len(regexp_extract_all(text, '(?m)^\|.*\|'))), 6) > 3 THEN 'fixed_size'
                WHEN round(avg(len(regexp_extract_all(text, '(?m)^#{1,6} '))), 6) > 2 OR round(avg(len(regexp_extract_all(text, '(?m)^```'))), 6) > 1 THEN 'by_heading' ELSE 'semantic' END AS strategy
    FROM documents WHERE length(text) > 0
    """
)
def corpus_strategy(spark: SparkSession, sf: str) -> DataFrame:
    return C.corpus_strategy(documents(spark, sf, "doc_id", "text"))


_ROUTES = [("facts", ["statement", "passage"]), ("figures", ["many", "total"]), ("texts", ["passage", "summary", "aussage"])]


@query(
    """
    WITH t(target, k) AS (VALUES ('facts', ['statement', 'passage']), ('figures', ['many', 'total']), ('texts', ['passage', 'summary', 'aussage'])),
    s AS (SELECT item_id AS query_id, target, round(len(list_filter(k, lambda w: contains(lower(question), w))) / len(k), 6) AS score FROM eval_items, t),
    r AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target) AS r FROM s)
    SELECT query_id, target, score FROM r WHERE CASE WHEN best >= 0.5 THEN r = 1 WHEN best >= 0.3 THEN score >= 0.25 ELSE true END
    """
)
def question_routes(spark: SparkSession, sf: str) -> DataFrame:
    return Q.routes(_questions(spark, sf), spark.createDataFrame(_ROUTES, "target string, keywords array<string>"))


@query(
    r"""
    SELECT path, CASE WHEN chunk_count = 0 THEN 'empty' WHEN chunk_count > 90 THEN 'too_large' WHEN lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) NOT IN ('csv', 'md', 'html', 'docx', 'pdf') THEN 'extension' ELSE 'ok' END AS verdict
    FROM source_files WHERE path IS NOT NULL
    """
)
def file_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "source_files").where(F.col("path").isNotNull())
    return f.select("path", V.file_verdict(F.col("path"), F.col("chunk_count"), ["csv", "md", "html", "docx", "pdf"], 90).alias("verdict"))


@query(
    """
    WITH a AS (SELECT DISTINCT source_path AS path, md5(text) AS md5 FROM documents WHERE source_path IS NOT NULL AND text IS NOT NULL),
    b AS (SELECT path, md5(path) AS md5 FROM a WHERE substr(md5, 1, 1) < '8')
    SELECT a.path, CASE WHEN b.path IS NULL THEN 'copy' ELSE 'overwrite' END AS action FROM a LEFT JOIN b USING (path) WHERE b.path IS NULL OR a.md5 <> b.md5
    """
)
def copy_plan(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").where(F.col("source_path").isNotNull() & F.col("text").isNotNull()).select(F.col("source_path").alias("path"), F.md5("text").alias("md5")).distinct()
    return V.copy_plan(a, a.where(F.substring("md5", 1, 1) < "8").select("path", F.md5("path").alias("md5")))
