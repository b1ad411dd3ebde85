"""Column functions and small operators bound to the driver's tables, and the same rows in DuckDB SQL.

Each query runs over a whole table; what the tables lack (boxes, files, OCR rows) is derived from their columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import ids, normal_forms
from corpusloom.functions import text as T
from corpusloom.operators import catalog, layout, limits, retrieval, segment, state
from corpusloom.plans import models, reprocess
from corpusloom.plans import queries as Q
from corpusloom.plans.queries import query
from corpusloom.sources import event_log, page_files, readers, sinks
from corpusloom.sources.readers import table
from corpusloom.sources.store import shared_folder

_quoted = Q._quoted


# Catalogue and state ---------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey = 42 THEN 'ready' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey = 42 THEN 7 ELSE c_nationkey END AS c_nationkey FROM customer")
def status_update(spark, d):
    return catalog.set_status(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey", 42, c_mktsegment="ready", c_nationkey=7)


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON lower(replace(s_name, 'Supplier', 'CUSTOMER')) = lower(c_name)")
def same_addresses(spark, d):
    """Suppliers and customers of one name, whatever its case."""
    left = table(spark, d, "supplier").select("s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit("CUSTOMER")).alias("name"))
    return left.join(table(spark, d, "customer"), catalog.same_address(F.col("name"), F.col("c_name"))).select("s_suppkey", "c_custkey")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(source, '') AS source FROM documents LEFT JOIN labels USING (doc_id)")
def payload_defaults(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return catalog.with_defaults(rows, quality=-1, source="")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 5 + 1 ELSE o_orderkey % 5 END AS retry_count, CAST(NULL AS VARCHAR) AS checkpoint FROM orders WHERE o_orderstatus = 'P'")
def jobs_retried(spark, d):
    """Orders in progress as jobs that went silent: queued again without a checkpoint, or failed after three tries."""
    jobs = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 5).alias("retry_count"), F.lit("page 3").alias("checkpoint"))
    return state.retried(jobs)


_AGAIN = "c_custkey % 10 < 3 AND c_nationkey = 3"


def _reprocessed(spark, d):
    """Customers as books of their nations, orders as jobs; three in ten of one nation are done again, others' requests find nothing."""
    books = table(spark, d, "customer").select(F.col("c_custkey").alias("book"), F.col("c_nationkey").alias("tenant"), F.col("c_mktsegment").alias("status"), F.lit(9).alias("total_chunks"), (F.col("c_custkey") % 50).cast("int").alias("total_pages"))
    task = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("t"), F.col("o_orderkey").cast("string")))
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("job"), F.col("o_custkey").alias("book"), F.lit(3).alias("tenant"), F.col("o_orderstatus").alias("status"), task.alias("task_id"))
    return reprocess.reprocessed(books, jobs, books.where("book % 10 < 3").select("book"), 3, "again")


@query(f"SELECT c_custkey AS book, CASE WHEN {_AGAIN} THEN 'pending' ELSE c_mktsegment END AS status, CASE WHEN {_AGAIN} THEN 0 ELSE 9 END AS total_chunks, CASE WHEN {_AGAIN} THEN NULL ELSE CAST(c_custkey % 50 AS INTEGER) END AS total_pages FROM customer")
def reprocessed_books(spark, d):
    return _reprocessed(spark, d).books.drop("tenant")


@query(f"WITH again AS (SELECT c_custkey FROM customer WHERE {_AGAIN}) SELECT o_custkey AS book, o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS tasks FROM orders WHERE o_custkey NOT IN (FROM again) GROUP BY 1, 2 UNION ALL SELECT c_custkey, 'queued', 1, 0 FROM again")
def reprocessed_jobs(spark, d):
    return _reprocessed(spark, d).jobs.groupBy("book", "status").agg(F.countDistinct("job").alias("n"), F.count("task_id").alias("tasks"))


@query(f"SELECT 't' || o_orderkey AS task_id FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE {_AGAIN})")
def revoked_tasks(spark, d):
    return _reprocessed(spark, d).revoked


@query("SELECT l_orderkey, l_linenumber, CAST(10 + floor(l_linenumber / 7.0 * 15) AS INTEGER) AS progress, list_position(['R', 'A', 'N'], l_returnflag) - 1 AS phase FROM lineitem")
def job_progress(spark, d):
    names = F.create_map(F.lit("R"), F.lit("queued"), F.lit("A"), F.lit("extracting"), F.lit("N"), F.lit("chunking"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", names[F.col("l_returnflag")].alias("status"))
    return rows.select("l_orderkey", "l_linenumber", state.extraction_progress(F.col("l_linenumber"), F.lit(7)).alias("progress"), state.phase_index(F.col("status")).alias("phase"))


@query("SELECT c_custkey, sha256(c_name) AS token, 't' || substr(sha1(c_mktsegment || c_name), 1, 16) AS suffix FROM customer")
def hashed_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", ids.token_hash(F.col("c_name")).alias("token"), ids.snippet_suffix(F.concat("c_mktsegment", "c_name")).alias("suffix"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 200 AS DOUBLE) ELSE least(power(2.0, least(event_id % 10, 4)) + 0.5, 120.0) END AS seconds FROM events WHERE event_id % 3 <> 0 OR event_id % 200 <= 120 UNION ALL SELECT event_id, 120.0 FROM events WHERE event_id % 3 = 0 AND event_id % 200 > 120")
def retry_waits(spark, d):
    """Seconds until a call is made again: what the service asked for, or twice as long each time, two minutes at most."""
    asked = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 200).cast("double"))
    return table(spark, d, "events").select("event_id", A.retry_wait(F.col("event_id") % 10, asked, F.lit(0.5)).alias("seconds"))


@query("""
WITH RECURSIVE t AS (SELECT user_id AS key, event_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT key, n, event_id, moment, true AS accepted, 0::BIGINT AS level, moment AS last FROM t WHERE n = 1
      UNION ALL SELECT key, n, event_id, moment, fits, CASE WHEN fits THEN now ELSE level END, CASE WHEN fits THEN moment ELSE last END
      FROM (SELECT *, now <= 2 * 432000000000 AS fits FROM (SELECT t.key, t.n, t.event_id, t.moment, s.level, s.last, greatest(0, s.level - 2 * (t.moment - s.last) + 432000000000) AS now FROM s JOIN t ON t.key = s.key AND t.n = s.n + 1)))
SELECT key, event_id, moment AS "at", accepted, level FROM s
""")
def leaky_buckets(spark, d):
    """Requests of users against a bucket that drains twice in five days and has room for two more."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return limits.leaky_bucket(rows, limits.Limit(2, 432_000, 2))


@query("""
WITH RECURSIVE t AS (SELECT user_id AS key, event_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT key, n, event_id, moment, false AS was_cached, moment AS computed_at FROM t WHERE n = 1
      UNION ALL SELECT t.key, t.n, t.event_id, t.moment, t.moment < s.computed_at + 86400000000, CASE WHEN t.moment < s.computed_at + 86400000000 THEN s.computed_at ELSE t.moment END FROM s JOIN t ON t.key = s.key AND t.n = s.n + 1)
SELECT key, event_id, moment AS "at", was_cached, computed_at FROM s
""")
def cache_read_through(spark, d):
    """Questions of users against a cache that keeps an answer for a day."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return state.read_through(rows)


# Boxes -----------------------------------------------------------------------------------------------

_BOX = "CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_suppkey AS VARCHAR) || ',' || CASE WHEN l_linenumber = 7 THEN 'wide' ELSE CAST(l_partkey % 4000 AS VARCHAR) END || ',' || CAST(CAST(l_quantity AS INTEGER) * 20 AS VARCHAR)"


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, list_transform(string_split({_BOX}, ','), lambda x: TRY_CAST(x AS DOUBLE)) AS b FROM lineitem),
p AS (SELECT *, CASE WHEN len(list_filter(b, lambda x: x IS NULL)) = 0 THEN b END AS box FROM b)
SELECT l_orderkey, l_linenumber, box IS NOT NULL AS parsed, coalesce(box[1] >= 0 AND box[2] >= 0 AND box[3] > box[1] AND box[4] > box[2] AND box[3] <= 3000 AND box[4] <= 3000, false) AS plausible,
       coalesce(box[1] >= 0 AND box[2] >= 0 AND box[3] > box[1] AND box[4] > box[2] AND box[3] <= 595.01 AND box[4] <= 842.01, false) AS inside FROM p
""")
def boxes_checked(spark, d):
    """Boxes given as text: whether they are four numbers, lie on some page, and on a page of 595 by 842 points."""
    box = A.parsed_box(F.expr(_BOX.replace("VARCHAR", "STRING")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    inside = A.box_inside(F.col("box"), F.lit(595.0), F.lit(842.0))
    return rows.select("l_orderkey", "l_linenumber", F.col("box").isNotNull().alias("parsed"), A.plausible_box(F.col("box")).alias("plausible"), inside.alias("inside"))


# Files and pages ---------------------------------------------------------------------------------------


@query("SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'A.PDF' ELSE 'a.txt' END AS path, CASE WHEN doc_id % 3 = 0 THEN text ELSE '%PDF' || substr(text, 1, doc_id % 2) END AS content FROM documents) WHERE lower(path) LIKE '%.pdf' AND strlen(content) >= 5 AND content LIKE '\\%PDF%' ESCAPE '\\'")
def uploads_valid(spark, d):
    """Uploads, made of documents, that have the name, size and first bytes of a PDF file."""
    path = F.when(F.col("doc_id") % 4 == 0, "a.pdf").when(F.col("doc_id") % 4 == 1, "A.PDF").otherwise("a.txt")
    content = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("%PDF"), F.substr("text", F.lit(1), (F.col("doc_id") % 2).cast("int"))))
    return readers.valid_pdf(table(spark, d, "documents").select("doc_id", path.alias("path"), content.cast("binary").alias("content"))).select("doc_id")


@query("""
WITH r AS (SELECT l_orderkey AS page_num, l_partkey % 9 AS a, l_suppkey % 5 AS b, l_linenumber, l_quantity - 5 AS conf, l_partkey % 700 AS x, l_suppkey % 900 AS y, CAST(l_quantity AS INTEGER) % 6 AS w, 3 AS h, CASE WHEN l_linenumber = 5 THEN ' ' WHEN l_linenumber = 4 THEN repeat(l_returnflag, 41) ELSE ' ' || l_returnflag || l_linestatus END AS t FROM lineitem)
SELECT page_num, a || '-' || b || '-1' AS line_key, l_linenumber AS word_num, trim(t) AS text, round(x * 0.24, 4) AS x0, round(y * 0.24, 4) AS y0, round((x + w) * 0.24, 4) AS x1, round((y + h) * 0.24, 4) AS y1 FROM r WHERE trim(t) <> '' AND conf > 0 AND w > 0 AND length(trim(t)) <= 40
""")
def ocr_words_clean(spark, d):
    """Order lines as rows of an OCR table: what is sure, sized and short stays, in points."""
    text = F.when(F.col("l_linenumber") == 5, " ").when(F.col("l_linenumber") == 4, F.repeat("l_returnflag", 41)).otherwise(F.concat(F.lit(" "), "l_returnflag", "l_linestatus"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_num"), (F.col("l_partkey") % 9).alias("block_num"), (F.col("l_suppkey") % 5).alias("par_num"), F.lit(1).alias("line_num"), F.col("l_linenumber").alias("word_num"), (F.col("l_quantity") - 5).alias("conf"),
        (F.col("l_partkey") % 700).alias("left"), (F.col("l_suppkey") % 900).alias("top"), (F.col("l_quantity").cast("int") % 6).alias("width"), F.lit(3).alias("height"), text.alias("text"),
    )
    corners = [F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return readers.clean_ocr_words(rows).select("page_num", "line_key", "word_num", "text", *corners)


@query("SELECT l_orderkey AS page_num, l_linenumber AS word_num, round(l_partkey % 700 * 0.24, 4) AS x0, round(l_suppkey % 900 * 0.24, 4) AS y0, l_returnflag || l_linestatus AS text FROM lineitem WHERE l_quantity > 5 AND CAST(l_quantity AS INTEGER) % 6 > 0")
def ocr_file_words(spark, d):
    """Order lines written as OCR tables, with orders as pages, and read by ranges of pages: the words that are sure and sized."""
    path = f"{shared_folder(spark)}/ocr-{uuid.uuid4().hex}"
    columns = {"level": "5", "page_num": "l_orderkey", "block_num": "1", "par_num": "1", "line_num": "1", "word_num": "l_linenumber", "left": "l_partkey % 700", "top": "l_suppkey % 900", "width": "int(l_quantity) % 6", "height": "3", "conf": "l_quantity - 5", "text": "concat(l_returnflag, l_linestatus)"}
    rows = table(spark, d, "lineitem").selectExpr(*(f"{made} AS {name}" for name, made in columns.items()))
    rows.repartitionByRange("page_num").sortWithinPartitions("page_num", "word_num").write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    found = readers.clean_ocr_words(page_files.page_files(spark, path, readers.OCR_SCHEMA, bytes=str(1 << 20)))
    return found.select("page_num", "word_num", F.round("x0", 4).alias("x0"), F.round("y0", 4).alias("y0"), "text")


@query("SELECT doc_id, 1 AS page, sha256(CASE WHEN len(list_filter(string_split_regex(array_to_string(string_split(text, ' ')[1:doc_id % 20], ' '), '\\s+'), lambda w: w <> '')) < 10 THEN CASE WHEN doc_id % 7 = 0 THEN array_to_string(string_split(text, ' ')[1:doc_id % 20], ' ') ELSE text END ELSE array_to_string(string_split(text, ' ')[1:doc_id % 20], ' ') END) AS digest FROM documents WHERE text IS NOT NULL")
def page_fallback(spark, d):
    """Pages of a first engine, from a second one where the first has fewer than ten words and the second has the page."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lit(1).alias("page"), "text")
    first = docs.withColumn("text", F.array_join(F.slice(F.split("text", " "), F.lit(1), (F.col("doc_id") % 20).cast("int")), " "))
    return readers.with_fallback(first, docs.where("doc_id % 7 <> 0")).select("doc_id", "page", F.sha2("text", 256).alias("digest"))


# Events and messages -------------------------------------------------------------------------------------


@query("SELECT event_id, 'event: job-update' || chr(10) || 'data: {\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' || chr(10) || chr(10) AS message, '{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS line FROM events")
def event_messages(spark, d):
    return table(spark, d, "events").select("event_id", sinks.event_message("job-update", "event_id", "event_type").alias("message"), sinks.log_line("user_id", "event_type").alias("line"))


@query("SELECT 'event: book-update' || chr(10) || 'data: {\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' || chr(10) || chr(10) AS message FROM orders UNION ALL SELECT 'event: job-update' || chr(10) || 'data: {\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' || chr(10) || chr(10) FROM events")
def published_events(spark, d):
    """Two channels added to an event log, and all that its commits name."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    event_log.publish(table(spark, d, "orders").select(sinks.event_message("book-update", "o_orderkey", "o_orderstatus").alias("message")), path, "books")
    event_log.publish(table(spark, d, "events").select(sinks.event_message("job-update", "event_id", "event_type").alias("message")), path, "jobs")
    return event_log.published(spark, path).select("message")


@query("""
WITH a AS (SELECT conv_id || ':' || turn AS q, text, turn % 3 = 0 AS no_result, CASE WHEN turn % 2 = 0 THEN '["a","b"]' ELSE '[]' END AS sources, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL)
SELECT q, generate_subscripts(w, 1) - 1 AS n, 'token' AS kind, unnest(w) AS data FROM a
UNION ALL SELECT q, len(w), 'no_result', '' FROM a WHERE no_result UNION ALL SELECT q, len(w) + 1, 'sources', sources FROM a UNION ALL SELECT q, len(w) + 2, 'done', '' FROM a
""")
def answer_stream(spark, d):
    """Answers word by word, then what ends them."""
    sources = F.when(F.col("turn") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "conversations").where("text IS NOT NULL").select(F.concat_ws(":", "conv_id", "turn").alias("q"), F.col("text").alias("answer"), (F.col("turn") % 3 == 0).alias("no_result"), sources.alias("sources"))
    return sinks.answer_tokens(rows)


# Questions and answers -------------------------------------------------------------------------------------

_TERMS_OF = lambda text: Q._TERMS.replace("string_split_regex(text,", f"string_split_regex({text},")


@query(f"""
WITH b AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'the of' ELSE text END AS o, CASE WHEN item_id % 3 = 0 THEN text ELSE substr(text, 20, 60) END AS e FROM benchmark),
t AS (SELECT *, array_to_string({_TERMS_OF("o")}, ' ') AS a, nullif(array_to_string({_TERMS_OF("e")}, ' '), '') AS c, list_concat({_TERMS_OF("o")}, {_TERMS_OF("e")}) AS l FROM b),
p AS (SELECT *, coalesce(nullif(a, ''), c, nullif(e, ''), o) AS first FROM t)
SELECT item_id, first AS primary_query, CASE WHEN c <> first THEN c END AS secondary_query, coalesce(nullif(array_to_string(list_transform(list_filter(list_transform(l, lambda x, i: {{'x': x, 'first': list_position(l, x) = i}}), lambda s: s.first), lambda s: s.x), ' '), ''), nullif(e, ''), o) AS one_query,
       CASE WHEN o = e THEN o ELSE o || ' ' || e END AS embedded FROM p
""")
def question_forms(spark, d):
    """The keyword queries of a question in two forms, the two in one, and the text that is embedded."""
    original = F.when(F.col("item_id") % 5 == 0, "the of").otherwise(F.col("text"))
    other = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.substring("text", 20, 60))
    rows = table(spark, d, "benchmark").select("item_id", original.alias("o"), other.alias("e"))
    o, e = F.col("o"), F.col("e")
    first, second = T.keyword_queries(o, e, o)
    return rows.select("item_id", first.alias("primary_query"), second.alias("secondary_query"), T.keyword_query(o, e, o).alias("one_query"), T.embedding_text(o, e).alias("embedded"))


_CONVERSED = "SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' [P1, Page 2] and so' WHEN 1 THEN ' [Book Name, Page X]' WHEN 2 THEN ' No relevant information found. ' ELSE ' who reported it' END AS t FROM conversations WHERE text IS NOT NULL"


@query(f"""
WITH c AS ({_CONVERSED}), s AS (SELECT *, list_filter(list_transform(string_split_regex(t, '[.!؟۔\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM c)
SELECT conv_id, turn, CASE WHEN len(parts) > 0 THEN trim(regexp_replace(parts[len(parts)], '\\[[^\\]]*P\\d[^\\]]*\\]', ' ', 'g'), ' ') ELSE trim(t, ' ') END AS claim, trim(regexp_replace(t, '\\[(?:Book Name|Page X|Chapter Y)[^\\]]*\\]', '', 'g'), ' ') AS answer,
       contains(lower(t), 'no relevant information found') AS nothing, regexp_matches(t, '(?i)source\\s+(?:reference|of\\s+this|of\\s+that|of\\s+the)|footnote|side\\s+note|marginal\\s+note|citation|cited\\s+in|reference\\s+(?:for|of|to)|reported\\s+by|narrated\\s+by|transmitted\\s+by|(?:who)\\s+(?:reported|narrated)|who\\s+(?:reports|narrates)\\b') AS about_source,
       'No relevant information found in the provided sources.' || CASE WHEN turn % 2 = 0 THEN ' Try rephrasing your question.' ELSE '' END AS refusal FROM s
""")
def answer_checks(spark, d):
    """What answers say: their last claim, without template leftovers, whether nothing was found, whether a source was asked for."""
    rows = table(spark, d, "conversations").where("text IS NOT NULL")
    more = F.when(F.col("turn") % 4 == 0, " [P1, Page 2] and so").when(F.col("turn") % 4 == 1, " [Book Name, Page X]").when(F.col("turn") % 4 == 2, " No relevant information found. ").otherwise(" who reported it")
    rows = rows.select("conv_id", "turn", F.concat("text", more).alias("t"))
    t = F.col("t")
    return rows.select("conv_id", "turn", A.claim_sentence(t).alias("claim"), A.without_placeholders(t).alias("answer"), A.says_nothing_found(t).alias("nothing"), T.is_source_question(t).alias("about_source"), A.refusal(F.lit("en"), F.col("turn") % 2 == 0).alias("refusal"))


@query("SELECT doc_id, length(text) BETWEEN 1 AND 4096 AS valid, len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '[.۔!?؟]$'))) AS sentence_ends FROM documents WHERE text IS NOT NULL")
def question_checks(spark, d):
    """Whether documents have the length of a question, and how many of their words end a sentence."""
    from corpusloom.plans.ask import valid_question

    text = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", valid_question(text).alias("valid"), F.size(F.filter(T.words(text), T.ends_sentence)).alias("sentence_ends"))


@query("""
WITH p AS (SELECT doc_id, text, source, CAST(length(text) / 2 AS BIGINT) AS h FROM (SELECT doc_id, text, source FROM documents WHERE length(text) BETWEEN 2 AND 3000)),
s AS (SELECT doc_id, source, length(text) // 2 AS h, text FROM p WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 800)
SELECT doc_id, sha256('[P1] ⟨Page 4⟩ ' || substr(text, 1, h) || ' ⟨Page 9⟩ ' || substr(text, h + 1) || chr(10) || '    Source: ' || source || ', Page 3-5' || chr(10) || chr(10) || '[P2] ' || source || chr(10) || '    Source: ' || source || ', Page 7') AS shown FROM s
""")
def passages_shown(spark, d):
    """Two passages of every document as a model is shown them: one over two pages with printed numbers, one short one."""
    rows = table(spark, d, "documents").where("length(text) BETWEEN 2 AND 3000").where(F.size(T.words(F.col("text"))) <= 800)
    half = F.floor(F.length("text") / 2).cast("int")
    none = F.lit(None).cast("int")
    offset = lambda page, start, stop, printed: F.struct(F.lit(page).alias("page"), start.alias("start_char"), stop.alias("end_char"), printed.alias("printed_page_num"))
    passage = lambda text, offsets, low, high: F.struct(text.alias("text"), offsets.alias("page_offsets"), F.col("source").alias("book_name"), F.lit(low).alias("page_start"), F.lit(high).alias("page_end"), none.alias("printed_page_start"), none.alias("printed_page_end"))
    first = passage(F.col("text"), F.array(offset(3, F.lit(0), half - 1, F.lit(4)), offset(9, half, F.length("text") - 1, none)), 3, 5)
    second = passage(F.col("source"), F.array(offset(7, F.lit(0), F.length("source") - 1, none)), 7, 7)
    return rows.select("doc_id", F.sha2(A.formatted(F.array(first, second)), 256).alias("shown"))


@query(f"""
WITH c AS (SELECT conv_id, turn, text, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS latin FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN latin > 0 THEN 'en' ELSE 'ar' END AS asked_in, 'en' AS answered_in, latin = 0 AS needs_rewrite FROM c
""")
def language_enforced(spark, d):
    """Whether a reply is in another language than it was asked in, by script; here each text stands for both."""
    asked, answered = T.script_language(F.col("text")), T.answer_language(F.col("text"))
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", asked.alias("asked_in"), answered.alias("answered_in"), (asked != answered).alias("needs_rewrite"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN -1.0 ELSE CAST(length(text) AS DOUBLE) END AS first FROM benchmark")
def vectors_cached(spark, d):
    """Vectors of questions, made only where none is cached; the cached ones are told by a mark."""
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    cache = asked.where("item_id % 2 = 0").select(F.sha2(F.lower(F.trim("question")), 256).alias("key"), F.array(F.lit(-1.0)).alias("vector")).dropDuplicates(["key"])
    return models.with_cached_vectors(asked, cache, lambda text: F.array(F.length(text).cast("double"))).select("item_id", F.get("vector", F.lit(0)).alias("first"))


_MIXED = "replace(replace(replace(replace(replace(text, 'e', 'e' || chr(769)), 'o', 'o' || chr(770) || chr(803)), 'a', chr(8491)), 'n', chr(1575) || chr(1619)), 'i', chr(1728))"


@query(f"SELECT doc_id, sha256(nfc_normalize({_MIXED})) AS form_c, {Q._UUID} AS id FROM (SELECT doc_id, text, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(lower(trim(regexp_replace(translate(regexp_replace(strip_accents({_MIXED}), '[\\x{{064B}}-\\x{{0655}}\\x{{0670}}\\x{{0640}}ʿʾʼʻ]', '', 'g'), 'أإآىةؤئ', 'ااايهوي'), '\\s+', ' ', 'g'))) || '|1|2')) AS h FROM documents)")
def composed_forms(spark, d):
    """Documents with letters and marks apart, out of order and in variants: their form C, and the id made from them."""
    text = F.col("text")
    for letter, other in (("e", "e\u0301"), ("o", "o\u0302\u0323"), ("a", "\u212b"), ("n", "\u0627\u0653"), ("i", "\u06c0")):
        text = F.replace(text, F.lit(letter), F.lit(other))
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"))
    return rows.select("doc_id", F.sha2(normal_forms.composed(F.col("text")), 256).alias("form_c"), ids.chunk_id(F.col("text"), F.lit(1), F.lit(2)).alias("id"))


# Retrieval and passages ----------------------------------------------------------------------------------


def _leg(name: str, text: str) -> str:
    """The keyword leg of another text of the questions, in CTEs of their own."""
    out = Q._RANKED_KEYWORD.replace(f"unnest({Q._TERMS})", f"unnest({_TERMS_OF(text)})")
    for cte in ("terms", "placed", "hits", "scored", "keyword"):
        out = out.replace(f"{cte} AS (", f"{cte}_{name} AS (").replace(f"FROM {cte} ", f"FROM {cte}_{name} ").replace(f"FROM {cte})", f"FROM {cte}_{name})")
    return out


@query(f"""
WITH {Q._POSTINGS}, {_leg("a", "text")}, {_leg("b", "reverse(text) || ' ' || substr(text, 1, 30)")},
two AS (SELECT q, id, tier, matched, tf, rank AS r, 1 AS leg FROM keyword_a UNION ALL SELECT q, id, tier, matched, tf, rank, 2 FROM keyword_b),
seen AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY leg) = 1)
SELECT q, id, tier, matched, tf, row_number() OVER (PARTITION BY q ORDER BY leg, r) AS rank FROM seen QUALIFY rank <= 20
""")
def keyword_legs_merged(spark, d):
    """Two keyword queries of a question, the hits of the first ahead of those that only the second has."""
    own = retrieval.postings(Q._passages(spark, d))
    asked = Q._questions(spark, d)
    other = asked.withColumn("question", F.concat(F.reverse("question"), F.lit(" "), F.substring("question", 1, 30)))
    short = retrieval.keyword_leg(asked, own, 20)
    return retrieval.merge_keyword_legs(short, retrieval.keyword_leg(other, own, 20), 20).select("q", "id", "tier", "matched", "tf", "rank")


_MARK = "^[*#\\-•·_\\s]+"
_PARAGRAPHS = f"""
blank AS (SELECT doc_id, raw, line_text, coalesce(lag(line_text = '') OVER (PARTITION BY doc_id ORDER BY raw), false) AS after_blank FROM clean),
head AS (SELECT doc_id, raw, after_blank, trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(line_text), '{_MARK}', ''), ':+$', '')), '^\\d+[.)،]?\\s*', '')) AS inner_text, ends_with(trim(line_text), ':') AS colon FROM blank WHERE line_text <> ''),
opened AS (SELECT doc_id, raw, after_blank OR (colon AND inner_text <> '' AND regexp_matches(inner_text, '[A-Za-z]') AND length(inner_text) <= 60 AND len(list_filter(string_split_regex(inner_text, '\\s+'), lambda x: x <> '')) <= 12) AS new, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS n FROM head),
paragraphs AS (SELECT doc_id, raw, CAST(sum(CASE WHEN n > 1 AND new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY raw) AS BIGINT) AS paragraph FROM opened)
"""


@query(f"WITH {Q._WORDS}, {_PARAGRAPHS} SELECT doc_id, paragraph, count(*) AS n_lines, min(raw) AS first FROM paragraphs GROUP BY 1, 2")
def paragraph_lines(spark, d):
    """Paragraphs of documents, as page texts: they begin after an empty line and with a short line that ends in a colon."""
    own = layout.number_paragraphs(layout.row_lines(layout.text_rows(Q._page_texts(spark, d))))
    return own.groupBy("doc_id", "paragraph").agg(F.count("*").alias("n_lines"), F.min("raw").alias("first"))


_BY_PARAGRAPH = "line AS (SELECT doc_id, paragraph AS raw, min(idx) AS a, max(idx) + 1 AS b FROM boxed JOIN paragraphs USING (doc_id, raw) GROUP BY 1, 2)"


@query(f"""
WITH RECURSIVE {Q._WORDS}, {_PARAGRAPHS}, {_BY_PARAGRAPH}, {Q._PACKED},
colons AS (SELECT doc_id, count(*) FILTER (ends_with(trim(line_text), ':')) >= 3 AS fiqh FROM lines GROUP BY 1)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, token_count, sha256(text) AS digest FROM chunk
""")
def paragraph_chunks(spark, d):
    """Chunks packed from whole paragraphs, in page texts of documents."""
    return segment.text_chunks(Q._page_texts(spark, d)).select("doc_id", "chunk_no", "token_count", F.sha2("text", 256).alias("digest"))


@query(f"""
WITH {Q._WORDS}, per AS (SELECT doc_id, raw, count(*) AS n FROM boxed GROUP BY 1, 2), footers AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (regexp_matches(line, '^[0-9]{{1,4}}$')) AS footers FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) GROUP BY 1)
SELECT doc_id, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_words, round(avg(n), 4) AS avg_words, max(n) AS max_words FROM per GROUP BY 1
""")
def page_word_statistics(spark, d):
    """Words by page of a document, its lines taken as pages."""
    words = layout.text_words(Q._heading_lines(spark, d).select("doc_id", F.col("line").alias("page"), F.col("line_text").alias("text")))
    return segment.page_statistics(words)


QUERIES, ORACLE_SQL = Q.QUERIES, Q.ORACLE_SQL
