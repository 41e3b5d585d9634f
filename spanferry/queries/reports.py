"""Result counts, breakdowns and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanferry.operators import batching, report
from spanferry.plans.event_copy import copy_counters as count_copy
from spanferry.operators.dedup import dedup_first
from spanferry.operators.project import drop_tombstones
from spanferry.queries.registry import query, table
from spanferry.shared import scratch_path
from spanferry.sources import sinks

# Every order is one result: cheap ones migrated, old ones skipped, the dearest failed.
_RESULTS = """results AS (
         SELECT 'project' AS scope, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS project,
                o_orderstatus AS resource_type, o_orderkey, o_orderkey::VARCHAR AS source_id,
                (o_orderkey + 1000000)::VARCHAR AS dest_id, 'order ' || o_orderkey AS name,
                o_totalprice < 450000 AS success, o_orderdate < TIMESTAMP '1997-01-01' AS skipped,
                CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN
                  CASE WHEN o_custkey < 30 THEN 'unresolved_user_dependency' WHEN o_orderdate < TIMESTAMP '1996-01-01'
                       THEN 'already_migrated' ELSE 'code_bundle_not_migratable' END END AS skip_reason,
                CASE WHEN o_totalprice >= 450000 THEN 'too large: ' || o_orderkey END AS error
         FROM orders)"""


def order_results(spark, sf_dir):
    old = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    older = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    reason = F.when(F.col("o_custkey") < 30, "unresolved_user_dependency").when(older, "already_migrated").otherwise("code_bundle_not_migratable")
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.lit("project").alias("scope"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("project"),
        F.col("o_orderstatus").alias("resource_type"),
        "o_orderkey",
        key.alias("source_id"),
        (F.col("o_orderkey") + 1000000).cast("string").alias("dest_id"),
        F.concat(F.lit("order "), key).alias("name"),
        (F.col("o_totalprice") < 450000).alias("success"),
        old.alias("skipped"),
        F.when(old, reason).alias("skip_reason"),
        F.when(F.col("o_totalprice") >= 450000, F.concat(F.lit("too large: "), key)).alias("error"),
    )


_COUNTS = """count(*) AS total, count(*) FILTER (success AND NOT skipped) AS migrated,
        count(*) FILTER (success AND skipped) AS skipped, count(*) FILTER (NOT success) AS failed"""


@query("status_counts", f"WITH {_RESULTS} SELECT resource_type, {_COUNTS} FROM results GROUP BY 1")
def status_counts(spark, sf_dir):
    return report.status_counts(order_results(spark, sf_dir), ["resource_type"])


@query(
    "status_rollup",
    f"""WITH {_RESULTS} SELECT project, resource_type, grouping(project, resource_type)::INTEGER AS level, {_COUNTS}
        FROM results GROUP BY ROLLUP (project, resource_type)""",
)
def status_rollup(spark, sf_dir):
    return report.status_rollup(order_results(spark, sf_dir))


@query(
    "skip_breakdown",
    f"""WITH {_RESULTS} SELECT resource_type, skip_reason, count(*) AS items, min(o_orderkey) AS first_seen
        FROM results WHERE success AND skipped GROUP BY 1, 2""",
)
def skip_breakdown(spark, sf_dir):
    return report.skip_breakdown(order_results(spark, sf_dir), "o_orderkey", ["resource_type"])


@query(
    "skip_summary",
    f"""WITH {_RESULTS}, b AS (SELECT resource_type, skip_reason, count(*) AS items, min(o_orderkey) AS first_seen
          FROM results WHERE success AND skipped GROUP BY 1, 2)
        SELECT resource_type, string_agg(items || ' ' || replace(skip_reason, '_', ' '), ', ' ORDER BY first_seen) AS summary
        FROM b GROUP BY 1""",
)
def skip_summary(spark, sf_dir):
    return report.skip_summary(report.skip_breakdown(order_results(spark, sf_dir), "o_orderkey", ["resource_type"]), ["resource_type"])


@query(
    "max_xact",
    """WITH x AS (SELECT o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'x' || o_orderkey
                         WHEN o_orderstatus = 'P' THEN '' ELSE o_orderkey::VARCHAR END AS id FROM orders)
       SELECT o_orderpriority, CASE WHEN bool_and(try_cast(nullif(id, '') AS BIGINT) IS NOT NULL) FILTER (id <> '')
                THEN max(try_cast(nullif(id, '') AS BIGINT))::VARCHAR ELSE max(nullif(id, '')) END AS max_xact FROM x GROUP BY 1""",
)
def max_xact(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    ids = (
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F"), F.concat(F.lit("x"), key))
        .when(F.col("o_orderstatus") == "P", "")
        .otherwise(key)
    )
    return report.max_xact(table(spark, sf_dir, "orders").select("o_orderpriority", ids.alias("id")), "id", ["o_orderpriority"])


@query(
    "payload_bytes",
    """SELECT source, count(*) AS batch_rows, (14 + count(*) - 1 + sum(octet_length(encode(text))))::BIGINT AS payload_bytes
       FROM documents GROUP BY 1""",
)
def payload_bytes(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("source", F.octet_length("text").alias("size"))
    return batching.payload_bytes(documents, "size", ["source"])


@query(
    "copy_counters",
    """WITH events2 AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE value > 50),
       live AS (SELECT event_type, event_id, min(octet_length(encode(props))) AS b FROM events2
                WHERE value <= 90 GROUP BY 1, 2),
       went AS (SELECT event_type, count(*) AS n, sum(b)::BIGINT AS b FROM live GROUP BY 1),
       came AS (SELECT event_type, count(*) AS fetched, count(*) FILTER (value > 90) AS skipped_deleted FROM events2 GROUP BY 1)
       SELECT event_type, fetched, coalesce(n, 0) AS inserted, coalesce(b, 0) AS inserted_bytes, skipped_deleted,
              fetched - skipped_deleted - coalesce(n, 0) AS skipped_seen, 0::BIGINT AS attachments_copied, 0::BIGINT AS spilled_fields
       FROM came LEFT JOIN went USING (event_type)""",
)
def copy_counters(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    fetched = events.unionByName(events.where("value > 50"))
    deleted = F.col("value") > 90
    kept = dedup_first(drop_tombstones(fetched, deleted), ["event_id"], ["event_id"], ids_present=True)
    inserted = kept.withColumn("row_bytes", F.octet_length("props").cast("bigint"))
    return count_copy(fetched, inserted, deleted, ["event_type"])


@query(
    "stream_counters",
    """SELECT event_type, count(*) AS fetched, count(*) FILTER (value <= 90 AND user_id >= 5) AS inserted,
              coalesce(sum(octet_length(encode(props))) FILTER (value <= 90 AND user_id >= 5), 0)::BIGINT AS inserted_bytes,
              count(*) FILTER (value > 90) AS skipped_deleted, count(*) FILTER (value <= 90 AND user_id < 5) AS skipped_seen,
              count(*) FILTER (value <= 90 AND user_id >= 5 AND value > 45) AS attachments_copied,
              2 * count(*) FILTER (value <= 90 AND user_id >= 5 AND value > 80) AS spilled_fields FROM events GROUP BY 1""",
)
def stream_counters(spark, sf_dir):
    tagged = table(spark, sf_dir, "events").select(
        "event_type",
        F.when(F.col("value") > 90, "deleted").when(F.col("user_id") < 5, "seen").otherwise("inserted").alias("outcome"),
        F.octet_length("props").alias("row_bytes"),
        (F.col("value") > 45).cast("int").alias("attachments_copied"),
        F.when(F.col("value") > 80, 2).otherwise(0).alias("spilled_fields"),
    )
    return report.stream_counters(tagged, ["event_type"])


@query(
    "throughput",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows_total, sum(octet_length(encode(props)))::BIGINT AS bytes_total,
              round(count(*) * 1e9 / 86400)::BIGINT AS nano_rows_per_sec,
              round(sum(octet_length(encode(props))) * 1e9 / 86400)::BIGINT AS nano_bytes_per_sec
       FROM events GROUP BY 1""",
)
def throughput(spark, sf_dir):
    counters = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(1).alias("inserted"), F.octet_length("props").alias("inserted_bytes")
    )
    out = report.throughput(counters, F.lit(86400), ["day"])
    whole = lambda value: F.round(value).cast("bigint")
    # Whole numbers, so that no rounding of doubles takes part in the comparison.
    return out.select(
        "day", "rows_total", whole(F.col("gb_total") * 1e9).alias("bytes_total"),
        whole(F.col("rows_per_sec") * 1e9).alias("nano_rows_per_sec"), whole(F.col("gb_per_sec") * 1e18).alias("nano_bytes_per_sec"),
    )


@query(
    "report_success",
    f"""WITH {_RESULTS} SELECT project, resource_type, count(*) FILTER (NOT success OR error IS NOT NULL) = 0 AS success
        FROM results WHERE o_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2""",
)
def report_success(spark, sf_dir):
    return report.report_success(order_results(spark, sf_dir), ["project", "resource_type"])


@query(
    "discovery_summary",
    """WITH r AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
       SELECT p_brand, count(*) AS discovered, string_agg(p_name, ', ' ORDER BY rn) FILTER (rn <= 3) AS sample_names
       FROM r GROUP BY 1""",
)
def discovery_summary(spark, sf_dir):
    out = report.discovery_summary(table(spark, sf_dir, "part"), "p_brand", "p_name", ["p_partkey"])
    return out.withColumn("sample_names", F.array_join("sample_names", ", "))


@query(
    "top_n_per_reason",
    f"""WITH {_RESULTS}, r AS (SELECT skip_reason, source_id, row_number() OVER (PARTITION BY skip_reason ORDER BY o_orderkey) AS item_no,
               count(*) OVER (PARTITION BY skip_reason) AS items FROM results WHERE success AND skipped)
        SELECT skip_reason, source_id, item_no, items, greatest(items - 10, 0) AS more FROM r WHERE item_no <= 10""",
)
def top_n_per_reason(spark, sf_dir):
    skipped = order_results(spark, sf_dir).where("success AND skipped").select("skip_reason", "source_id", "o_orderkey")
    return report.top_n_per_reason(skipped, ["o_orderkey"]).drop("o_orderkey")


@query(
    "breakdown",
    f"""WITH {_RESULTS} SELECT CASE WHEN NOT success THEN 'failed' WHEN skipped THEN 'skipped' ELSE 'migrated' END AS outcome,
          scope, project, resource_type, source_id, CASE WHEN success THEN dest_id END AS dest_id, name,
          CASE WHEN success AND skipped THEN skip_reason END AS skip_reason, CASE WHEN NOT success THEN error END AS error FROM results
        UNION ALL SELECT 'migrated', 'organization', NULL, 'role', n_name, n_name || '-copy', n_name, NULL, NULL FROM nation""",
)
def breakdown(spark, sf_dir):
    roles = table(spark, sf_dir, "nation").select(
        F.lit("organization").alias("scope"), F.lit("role").alias("resource_type"), F.col("n_name").alias("source_id"),
        F.concat("n_name", F.lit("-copy")).alias("dest_id"), F.col("n_name").alias("name"),
        F.lit(True).alias("success"), F.lit(False).alias("skipped"),
    )
    return report.breakdown(order_results(spark, sf_dir).drop("o_orderkey"), roles)


@query(
    "missing_names",
    """SELECT lower(n_name) AS name FROM nation WHERE n_regionkey = 0
       EXCEPT SELECT n_name FROM nation UNION ALL SELECT NULL WHERE false""",
)
def missing_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    requested = nation.select(F.when(F.col("n_regionkey") == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    return report.missing_names(requested, nation.select("n_name"))


_PATHS = """SELECT 'part/' || lpad(p_partkey::VARCHAR, 9, '0') || '/' || k AS path, t AS type, v AS value, p_partkey, p_size FROM (
         SELECT p_partkey, p_size, 'name' AS k, 'text' AS t, p_name AS v FROM part
         UNION ALL SELECT p_partkey, p_size, 'brand', 'text', repeat(p_brand, 25) FROM part
         UNION ALL SELECT p_partkey, p_size, 'size', 'number', p_size::VARCHAR FROM part)"""

_DIFF_SQL = f"""WITH p AS ({_PATHS}),
       old AS (SELECT * FROM p WHERE p_size <> 1),
       new AS (SELECT path, CASE WHEN p_size = 7 THEN 'integer' ELSE type END AS type,
                      CASE WHEN p_size = 9 THEN upper(value) || '!' ELSE value END AS value FROM p WHERE p_size <> 3),
       d AS (SELECT path, o.type AS ot, n.type AS nt, o.value AS ov, n.value AS nv,
              CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
                   WHEN o.type <> n.type THEN 'type_changes' WHEN o.value <> n.value THEN 'values_changed' END AS change
             FROM old o FULL JOIN new n USING (path)),
       r AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY path) AS rn, count(*) OVER (PARTITION BY change) AS n
             FROM d WHERE change IS NOT NULL)
       SELECT change, path, CASE WHEN change = 'type_changes' THEN ot END AS old_type, CASE WHEN change = 'type_changes' THEN nt END AS new_type,
              CASE WHEN change = 'values_changed' THEN CASE WHEN length(ov) > 160 THEN substr(ov, 1, 157) || '...' ELSE ov END END AS old_value,
              CASE WHEN change = 'values_changed' THEN CASE WHEN length(nv) > 160 THEN substr(nv, 1, 157) || '...' ELSE nv END END AS new_value,
              0::BIGINT AS more
       FROM r"""


@query("schema_diff", _DIFF_SQL)
def schema_diff(spark, sf_dir):
    entries = F.explode(
        F.array(
            F.struct(F.lit("name").alias("k"), F.lit("text").alias("t"), F.col("p_name").alias("v")),
            F.struct(F.lit("brand").alias("k"), F.lit("text").alias("t"), F.repeat("p_brand", F.lit(25)).alias("v")),
            F.struct(F.lit("size").alias("k"), F.lit("number").alias("t"), F.col("p_size").cast("string").alias("v")),
        )
    )
    paths = table(spark, sf_dir, "part").select("p_partkey", "p_size", entries.alias("e")).select(
        F.concat(F.lit("part/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("/"), F.col("e.k")).alias("path"),
        F.col("e.t").alias("type"), F.col("e.v").alias("value"), "p_size",
    )
    new = paths.where("p_size <> 3").withColumns(
        {
            "type": F.when(F.col("p_size") == 7, F.lit("integer")).otherwise(F.col("type")),
            "value": F.when(F.col("p_size") == 9, F.concat(F.upper("value"), F.lit("!"))).otherwise(F.col("value")),
        }
    )
    return report.schema_diff(paths.where("p_size <> 1").drop("p_size"), new.drop("p_size"))


@query(
    "nested_report",
    f"""WITH {_RESULTS}, per_type AS (SELECT project, resource_type, {_COUNTS} FROM results GROUP BY 1, 2)
        SELECT project, sum(total)::BIGINT AS total, sum(migrated)::BIGINT AS migrated, sum(skipped)::BIGINT AS skipped,
               sum(failed)::BIGINT AS failed,
               string_agg(resource_type || ':' || migrated || '/' || total, ' ' ORDER BY resource_type) AS resources
        FROM per_type GROUP BY 1""",
)
def nested_report(spark, sf_dir):
    out = sinks.nested_report(order_results(spark, sf_dir))
    text = lambda r: F.concat(r["resource_type"], F.lit(":"), r["migrated"].cast("string"), F.lit("/"), r["total"].cast("string"))
    return out.withColumn("resources", F.array_join(F.transform("resources", text), " "))


@query(
    "write_report",
    f"""WITH {_RESULTS} SELECT CASE WHEN NOT success THEN 'failed' WHEN skipped THEN 'skipped' ELSE 'migrated' END AS outcome,
          resource_type, count(*) AS items, min(name) AS first_name FROM results GROUP BY 1, 2""",
)
def write_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    sinks.write_report(order_results(spark, sf_dir).drop("o_orderkey"), path)
    items = spark.read.parquet(f"{path}/breakdown")
    return items.groupBy("outcome", "resource_type").agg(F.count(F.lit(1)).alias("items"), F.min("name").alias("first_name"))
