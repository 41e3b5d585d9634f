"""Scans, projections, filters and ordered positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanferry.functions.predicates import is_code_bundle
from spanferry.operators import ordering, project, scan
from spanferry.queries.registry import query, table
from spanferry.sources.catalog import list_catalog


@query(
    "keyset_page",
    """SELECT event_id, user_id, event_type FROM events
       WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' AND event_id > 500
       ORDER BY event_id LIMIT 1000""",
)
def keyset_page(spark, sf_dir):
    return scan.keyset_page(
        table(spark, sf_dir, "events"), "event_id", 1000, after=500, created_col="ts",
        created_after="2024-01-03", created_before="2024-01-25", select=["event_id", "user_id", "event_type"],
    )


@query(
    "keyset_page_inclusive",
    """SELECT event_id, event_type FROM events WHERE event_id >= 500 ORDER BY event_id LIMIT 1000""",
)
def keyset_page_inclusive(spark, sf_dir):
    return scan.keyset_page(
        table(spark, sf_dir, "events"), "event_id", 1000, after=500, inclusive=True, select=["event_id", "event_type"]
    )


@query(
    "scan_objects",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def scan_objects(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return scan.scan_objects(orders, "o_custkey", ids)


@query("start_key", "SELECT min(event_id) AS start_key FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def start_key(spark, sf_dir):
    return scan.start_key(table(spark, sf_dir, "events"), "event_id", "2024-01-10", created_col="ts")


@query(
    "start_key_range",
    "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10'",
)
def start_key_range(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = scan.start_key(events, "event_id", "2024-01-10", created_col="ts").first()["start_key"]
    ranged = scan.keyset_range(events, "event_id", first, inclusive=True, created_col="ts", created_after="2024-01-10")
    return ranged.select("event_id", "event_type")


@query("list_catalog", "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey = 7")
def catalog(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return list_catalog(suppliers, 7, "s_nationkey")


@query("project_allowed", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def project_allowed(spark, sf_dir):
    allowed = ["c_mktsegment", "c_name", "c_custkey", "c_phone"]
    return project.project_allowed(table(spark, sf_dir, "customer"), allowed)


_EVENT_NAMES = {"event_id": "id", "ts": "created", "props": "metadata", "value": "scores", "event_type": "type"}


@query(
    "event_insert_projection",
    "SELECT event_id AS id, props AS metadata, value AS scores FROM events",
)
def event_insert_projection(spark, sf_dir):
    events = project.rename_columns(table(spark, sf_dir, "events").drop("ts"), _EVENT_NAMES)
    return project.event_insert_projection(events, "logs")


@query("event_insert_projection_dataset", "SELECT event_id AS id, props AS metadata FROM events")
def event_insert_projection_dataset(spark, sf_dir):
    events = project.rename_columns(table(spark, sf_dir, "events").drop("ts"), _EVENT_NAMES)
    return project.event_insert_projection(events, "datasets")


@query("strip_readonly", "SELECT c_custkey AS customer_no, c_mktsegment FROM customer")
def strip_readonly(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_name").alias("id"), F.col("c_nationkey").alias("org_id"),
        F.col("c_acctbal").alias("_xact_id"),
    )
    return project.strip_readonly(customers).withColumnRenamed("c_custkey", "customer_no")


@query(
    "created_between",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""",
)
def created_between(spark, sf_dir):
    ranged = project.created_between(table(spark, sf_dir, "orders"), "o_orderdate", "1996-01-01", "1998-01-01")
    return ranged.select("o_orderkey", "o_custkey")


@query(
    "drop_tombstones",
    "SELECT event_id, event_type, user_id FROM events WHERE (event_type = 'error') IS NOT TRUE",
)
def drop_tombstones(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return project.drop_tombstones(events, F.col("event_type") == "error")


@query(
    "valid_records",
    """SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS malformed FROM (
         SELECT CASE WHEN c_acctbal < 0 THEN '' WHEN c_nationkey = 3 THEN NULL ELSE c_name END AS name,
                coalesce(name <> '', false) AS ok FROM customer)""",
)
def valid_records(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_acctbal") < 0, F.lit("")).when(F.col("c_nationkey") == 3, F.lit(None)).otherwise(F.col("c_name")).alias("name"),
        F.col("c_custkey").alias("id"),
    )
    return project.malformed_count(named, ["id", "name"])


@query(
    "select_by_name",
    """WITH requested AS (
         SELECT CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 4)
       SELECT n_name, 'found' AS status FROM nation WHERE n_name IN (SELECT n_name FROM requested)
       UNION ALL SELECT n_name, 'missing' FROM requested WHERE n_name NOT IN (SELECT n_name FROM nation)""",
)
def select_by_name(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    requested = nation.where("n_regionkey <> 4").select(
        F.when(F.col("n_regionkey") == 2, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name")
    )
    found, missing = project.select_by_name(nation.select("n_name"), "n_name", requested)
    return found.withColumn("status", F.lit("found")).unionByName(missing.withColumn("status", F.lit("missing")))


@query(
    "code_bundles",
    """SELECT p_partkey, (kind = 'code' AND (data_kind = 'inline') IS NOT TRUE) AS is_bundle FROM (
         SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'PROMO') THEN 'code' ELSE lower(p_type) END AS kind,
                CASE WHEN p_size < 15 THEN 'inline' WHEN p_size < 30 THEN 'bundle' END AS data_kind FROM part)""",
)
def code_bundles(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_type").isin("ECONOMY", "SMALL", "PROMO"), F.lit("code")).otherwise(F.lower("p_type"))
    data_kind = F.when(F.col("p_size") < 15, "inline").when(F.col("p_size") < 30, "bundle")
    return parts.select("p_partkey", is_code_bundle(kind, data_kind).alias("is_bundle"))


@query(
    "stamp_origin",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'imported' ELSE 'project_logs' END AS object_type,
              CASE WHEN event_type = 'signup' THEN 'archive' ELSE user_id::VARCHAR END AS object_id,
              CASE WHEN event_type <> 'signup' THEN event_id::VARCHAR END AS origin_id,
              CASE WHEN event_type <> 'signup' THEN value::BIGINT::VARCHAR END AS xact_id,
              (event_type <> 'signup') AS has_created
       FROM events""",
)
def stamp_origin(spark, sf_dir):
    given = F.struct(
        F.lit("imported").alias("object_type"), F.lit("archive").alias("object_id"),
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("_xact_id"),
        F.lit(None).cast("timestamp_ntz").alias("created"),
    )
    events = table(spark, sf_dir, "events").withColumns(
        {
            "origin": F.when(F.col("event_type") == "signup", given),
            "_xact_id": F.rint("value").cast("bigint"),
        }
    )
    out = project.stamp_origin(events, "project_logs", F.col("user_id"), "event_id", "_xact_id", "ts")
    return out.select(
        "event_id", "origin.object_type", "origin.object_id", F.col("origin.id").alias("origin_id"),
        F.col("origin._xact_id").alias("xact_id"), F.col("origin.created").isNotNull().alias("has_created"),
    )


@query(
    "stamp_destination",
    "SELECT event_id, user_id, 'project-1' AS project_id, 'g' AS log_id FROM events",
)
def stamp_destination(spark, sf_dir):
    return project.stamp_project_logs(table(spark, sf_dir, "events").select("event_id", "user_id"), "project-1")


@query(
    "select_resource_types",
    "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')",
)
def select_resource_types(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    scope = ["click", "view", "purchase", "signup"]
    return project.select_resource_types(events, "event_type", ["purchase", "click", "error"], scope)


@query(
    "require_object_id",
    "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1",
)
def require_object_id(spark, sf_dir):
    items = project.require_object_id(table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey")
    return items.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ordered_copy",
    "SELECT event_id, event_type, user_id FROM events",
)
def ordered_copy(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return ordering.ordered_copy(events, "event_id")


@query(
    "two_pass_order",
    """SELECT p_partkey, parent, CASE WHEN parent IS NOT NULL THEN 2 ELSE 1 END AS create_pass FROM (
         SELECT p_partkey, CASE WHEN p_size > 25 THEN p_partkey + 1 END AS parent FROM part)""",
)
def two_pass_order(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") > 25, F.col("p_partkey") + 1).alias("parent")
    )
    return ordering.two_pass_order(parts, "parent", ["p_partkey"])


@query(
    "batch_by_count",
    """SELECT o_orderkey, o_custkey,
              (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch_no FROM orders""",
)
def batch_by_count(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return ordering.batch_by_count(orders, ["o_orderkey"], 4, ["o_custkey"])


@query(
    "batch_by_count_global",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 100 AS batch_no FROM orders",
)
def batch_by_count_global(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ordering.batch_by_count(orders, ["o_orderdate", "o_orderkey"], 100).drop("o_orderdate")


@query(
    "page_cursors",
    """WITH pages AS (
         SELECT page_no, count(*) AS page_rows, max(event_id) AS last_key FROM (
           SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS page_no FROM events) GROUP BY 1)
       SELECT page_no, page_rows, lag(last_key) OVER (ORDER BY page_no) AS start_after, last_key FROM pages""",
)
def page_cursors(spark, sf_dir):
    return ordering.page_cursors(table(spark, sf_dir, "events"), "event_id", 1000)


@query(
    "object_groups",
    """SELECT group_no, count(*) AS n, CASE WHEN count(*) = 1 THEN min(s_suppkey)::VARCHAR ELSE
              'group_' || substr(sha1(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey)), 1, 12) END AS group_name
       FROM (SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 11 AS group_no FROM supplier) GROUP BY 1""",
)
def object_groups(spark, sf_dir):
    groups = ordering.object_groups(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_suppkey"], 11)
    return groups.select("group_no", F.size("object_ids").cast("bigint").alias("n"), "group_name")
