"""Scalar functions, payload sizes, references, spill, quarantine and batch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanferry.functions import payload as payload_functions
from spanferry.functions import scalars
from spanferry.operators import batching
from spanferry.operators import payload as payload_operators
from spanferry.queries.registry import query, table
from spanferry.sources import sinks


@query("json_bytes", "SELECT doc_id, octet_length(encode(text))::INTEGER AS bytes FROM documents")
def json_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", payload_functions.json_bytes(F.col("text")).alias("bytes"))


@query("spaced_json_bytes", "SELECT event_id, octet_length(encode(props))::BIGINT AS bytes FROM events")
def spaced_json_bytes(spark, sf_dir):
    compact = F.to_json(F.from_json("props", "k long"))
    return table(spark, sf_dir, "events").select("event_id", payload_functions.spaced_json_bytes(compact).alias("bytes"))


@query("compact_chars", "SELECT event_id, CASE WHEN event_type <> 'error' THEN length(json(props))::INTEGER END AS chars FROM events")
def compact_chars(spark, sf_dir):
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", payload_functions.compact_chars(broken).alias("chars"))


@query(
    "canonical_ts",
    """SELECT o_orderkey, CASE o_orderstatus
         WHEN 'P' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
         WHEN 'F' THEN strftime(o_orderdate + to_seconds(o_orderkey) - INTERVAL 150 MINUTE, '%Y-%m-%dT%H:%M:%SZ')
         ELSE strftime(o_orderdate + to_seconds(o_orderkey) + INTERVAL 250 MILLISECOND, '%Y-%m-%dT%H:%M:%S.%fZ') END AS created
       FROM orders""",
)
def canonical_ts(spark, sf_dir):
    at = F.date_format(F.timestamp_add("SECOND", F.col("o_orderkey"), F.col("o_orderdate")), "yyyy-MM-dd'T'HH:mm:ss")
    given = (
        F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "F", F.concat(at, F.lit("+02:30")))
        .otherwise(F.concat(F.lit(" "), at, F.lit(".25")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.canonical_ts(given).alias("created"))


@query(
    "norm_email",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN lower(c_name) || '@example.org' END AS email FROM customer",
)
def norm_email(spark, sf_dir):
    noisy = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit("@Example.ORG "))).otherwise("  ")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.norm_email(noisy).alias("email"))


@query("short_cursor", "SELECT page_id, substr(url, 1, 16) || '…' AS cursor FROM pages")
def short_cursor(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.short_cursor(F.col("url")).alias("cursor"))


@query(
    "reason_label",
    """SELECT label, words, count(*) AS n FROM (
         SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium'
                  WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' ELSE '5-Low' END AS label,
                o_orderpriority AS words FROM orders) GROUP BY 1, 2""",
)
def reason_label(spark, sf_dir):
    code = F.translate("o_orderpriority", " ", "_")
    return (
        table(spark, sf_dir, "orders")
        .select(scalars.reason_label(code).alias("label"), scalars.reason_words(code).alias("words"))
        .groupBy("label", "words")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "truncate_value",
    "SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 157) || '...' ELSE text END AS value FROM documents",
)
def truncate_value(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.truncate_value(F.col("text")).alias("value"))


def _with_references(spark, sf_dir):
    """Each turn as a JSON document; user turns carry nested references, one of them incomplete."""
    ref = lambda key: F.struct(
        F.lit(payload_functions.REFERENCE_TAG).alias("type"), key.alias("key"),
        F.concat(key, F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("content_type"),
    )
    shared = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    own = F.concat(shared, F.lit("-"), F.col("turn").cast("string"))
    weak = F.struct(F.lit(payload_functions.REFERENCE_TAG).alias("type"), own.alias("key"))
    is_user = F.col("role") == "user"
    document = F.struct(
        F.col("role"),
        F.col("text"),
        F.when(is_user, F.struct(ref(shared).alias("main"), F.array(F.struct(ref(own).alias("ref"))).alias("more"))).alias("files"),
        F.when(is_user, weak).alias("draft"),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(document).alias("payload"))


@query(
    "attachment_refs",
    """SELECT conv_id, turn, '$.files.main' AS path, 'conv-' || conv_id AS key, 'conv-' || conv_id || '.txt' AS filename,
              'text/plain' AS content_type FROM conversations WHERE role = 'user'
       UNION ALL SELECT conv_id, turn, '$.files.more[0].ref', 'conv-' || conv_id || '-' || turn, 'conv-' || conv_id || '-' || turn || '.txt',
              'text/plain' FROM conversations WHERE role = 'user'""",
)
def attachment_refs(spark, sf_dir):
    refs = F.explode(payload_functions.attachment_refs(F.col("payload"))).alias("r")
    return _with_references(spark, sf_dir).select("conv_id", "turn", refs).select("conv_id", "turn", "r.*")


@query(
    "count_attachment_refs",
    "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 3 ELSE 0 END AS refs FROM conversations",
)
def count_attachment_refs(spark, sf_dir):
    return _with_references(spark, sf_dir).select(
        "conv_id", "turn", payload_functions.count_attachment_refs(F.col("payload")).alias("refs")
    )


@query(
    "rewrite_attachments",
    """SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN sha256('chat|conv-' || conv_id) END AS main_key,
              CASE WHEN role = 'user' THEN sha256('chat|conv-' || conv_id || '-' || turn) END AS more_key,
              CASE WHEN role = 'user' THEN 'conv-' || conv_id || '-' || turn END AS draft_key,
              length(text) AS text_chars, CASE WHEN role = 'user' THEN 2 ELSE 0 END AS attachments_copied
       FROM conversations""",
)
def rewrite_attachments(spark, sf_dir):
    turns = _with_references(spark, sf_dir)
    copies = payload_operators.planned_copies(payload_operators.distinct_attachments(turns, "payload"), "chat")
    out = payload_operators.rewrite_attachments(turns, copies, "payload")
    at = lambda path: F.get_json_object("payload", path)
    return out.select(
        "conv_id", "turn", at("$.role").alias("role"), at("$.files.main.key").alias("main_key"),
        at("$.files.more[0].ref.key").alias("more_key"), at("$.draft.key").alias("draft_key"),
        F.char_length(at("$.text")).cast("bigint").alias("text_chars"), "attachments_copied",
    )


@query(
    "distinct_attachments",
    """SELECT key AS source_key, key || '.txt' AS filename, 'text/plain' AS content_type FROM (
         SELECT 'conv-' || conv_id AS key FROM conversations WHERE role = 'user'
         UNION SELECT 'conv-' || conv_id || '-' || turn FROM conversations WHERE role = 'user')""",
)
def distinct_attachments(spark, sf_dir):
    return payload_operators.distinct_attachments(_with_references(spark, sf_dir), "payload")


# Two fields of each document compete for being moved: its text and a half-length note.
_SPILL = """docs AS (SELECT doc_id, text, substr(text, 1, n // 2) AS note, repeat(lang, 40) AS tail FROM (SELECT *, length(text) AS n FROM documents)),
       sized AS (SELECT *, octet_length(encode(text)) AS st, octet_length(encode(note)) AS sn, octet_length(encode(tail)) AS sl FROM docs),
       fields AS (
         SELECT doc_id, st + sn + sl AS total, 'text' AS field, 1 AS place, st AS size, sha256(text) AS digest FROM sized
         UNION ALL SELECT doc_id, st + sn + sl, 'note', 2, sn, sha256(note) FROM sized
         UNION ALL SELECT doc_id, st + sn + sl, 'tail', 3, sl, sha256(tail) FROM sized),
       eligible AS (SELECT *, size - octet_length(encode('{"type":"stored_attachment","key":"' || sha256('docs|' || doc_id || '|' || field)
              || '","filename":"' || field || '.json","content_type":"application/json"}')) AS saved FROM fields WHERE size >= 100 AND total > 2000),
       running AS (SELECT *, total - coalesce(sum(saved) OVER (PARTITION BY doc_id ORDER BY size DESC, place
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM eligible),
       moved AS (SELECT * FROM running WHERE before > 2000)"""


def _spill(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.expr("substr(text, 1, char_length(text) div 2)").alias("note"), F.repeat("lang", F.lit(40)).alias("tail")
    )
    return payload_operators.spill_oversize(documents, "doc_id", "docs", ["text", "note", "tail"], 2000, 100)


@query(
    "spill_rows",
    f"""WITH {_SPILL} SELECT s.doc_id, (SELECT count(*) FROM moved m WHERE m.doc_id = s.doc_id)::INTEGER AS spilled_fields,
          (st + sn + sl - coalesce((SELECT sum(saved) FROM moved m WHERE m.doc_id = s.doc_id), 0))::BIGINT AS row_bytes,
          EXISTS (SELECT 1 FROM moved m WHERE m.doc_id = s.doc_id AND field = 'text') AS text_moved FROM sized s""",
)
def spill_rows(spark, sf_dir):
    rows = _spill(spark, sf_dir).rows
    return rows.select(
        "doc_id", "spilled_fields", "row_bytes",
        F.col("text").startswith('{"type":"stored_attachment"').alias("text_moved"),
    )


@query(
    "spill_side",
    f"""WITH {_SPILL} SELECT 'docs' AS stream, doc_id AS event_id, field, sha256('docs|' || doc_id || '|' || field || '|' || digest) AS key, size::BIGINT AS size
        FROM moved""",
)
def spill_side(spark, sf_dir):
    side = _spill(spark, sf_dir).side
    return side.select("stream", "event_id", "field", "key", F.octet_length("payload").cast("bigint").alias("size"))


@query(
    "quarantine",
    """SELECT 'docs' AS stream, doc_id::VARCHAR AS event_id, 'dest-' || source AS dest_id,
              'row of ' || octet_length(encode(text)) || ' bytes exceeds 2000' AS error, doc_id::VARCHAR AS cursor,
              length(text) AS approx_size, 0 AS attachment_refs, 'doc_id,lang,n_chars,source,text' AS keys
       FROM documents WHERE octet_length(encode(text)) > 2000""",
)
def quarantine(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    _, summary = sinks.quarantine(
        documents, F.octet_length("text"), 2000, "docs", F.concat(F.lit("dest-"), "source"), id_col="doc_id",
        key_col="doc_id", payloads=["text"], approx_size=F.char_length("text"),
    )
    return summary.select(
        "stream", "event_id", "dest_id", "error", "cursor", "approx_size", "attachment_refs",
        F.array_join("top_level_keys", ",").alias("keys"),
    )


@query("quarantine_kept", "SELECT doc_id, source FROM documents WHERE octet_length(encode(text)) <= 2000")
def quarantine_kept(spark, sf_dir):
    kept, _ = sinks.quarantine(
        table(spark, sf_dir, "documents"), F.octet_length("text"), 2000, "docs", F.col("source"), id_col="doc_id"
    )
    return kept.select("doc_id", "source")


@query(
    "batch_bytes",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, octet_length(encode(props)) AS s,
              row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
       p AS (SELECT user_id, event_id, rn, 0::BIGINT AS batch_no, 1::BIGINT AS n, (14 + s)::BIGINT AS b FROM e WHERE rn = 1
         UNION ALL SELECT e.user_id, e.event_id, e.rn,
           CASE WHEN p.n >= 10 OR p.b + 1 + e.s > 100 THEN p.batch_no + 1 ELSE p.batch_no END,
           CASE WHEN p.n >= 10 OR p.b + 1 + e.s > 100 THEN 1 ELSE p.n + 1 END,
           CASE WHEN p.n >= 10 OR p.b + 1 + e.s > 100 THEN 14 + e.s ELSE p.b + 1 + e.s END
         FROM p JOIN e ON e.user_id = p.user_id AND e.rn = p.rn + 1)
       SELECT user_id, event_id, batch_no FROM p""",
)
def batch_bytes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.octet_length("props").alias("size"))
    return batching.batch_by_count_and_bytes(events, ["user_id"], ["event_id"], "size", 10, 100)


@query(
    "flush_groups",
    """WITH RECURSIVE e AS (SELECT user_id, octet_length(encode(props)) AS s,
              (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS page_no FROM events),
       g AS (SELECT user_id, page_no, count(*) AS page_rows, sum(s)::BIGINT AS page_bytes FROM e GROUP BY 1, 2),
       p AS (SELECT user_id, page_no, page_rows, page_bytes, 0::BIGINT AS batch_no, page_rows AS n, page_bytes AS b FROM g WHERE page_no = 0
         UNION ALL SELECT g.user_id, g.page_no, g.page_rows, g.page_bytes,
           CASE WHEN p.n >= 10 OR p.b >= 95 THEN p.batch_no + 1 ELSE p.batch_no END,
           CASE WHEN p.n >= 10 OR p.b >= 95 THEN g.page_rows ELSE p.n + g.page_rows END,
           CASE WHEN p.n >= 10 OR p.b >= 95 THEN g.page_bytes ELSE p.b + g.page_bytes END
         FROM p JOIN g ON g.user_id = p.user_id AND g.page_no = p.page_no + 1)
       SELECT user_id, page_no, page_rows, page_bytes, batch_no FROM p""",
)
def flush_groups(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.octet_length("props").alias("size"))
    return batching.flush_groups(events, ["user_id"], ["event_id"], "size", 4, 10, 95)
