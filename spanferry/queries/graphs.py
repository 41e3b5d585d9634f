"""Reference edges, dependency levels and failure closure."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanferry.operators import graph
from spanferry.queries.registry import query, table


def _turn_graph(spark, sf_dir):
    """Each turn depends on the one before it; a system prompt also depends on its last turn, a cycle."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.char_length("text").alias("chars"), F.concat_ws(":", "conv_id", "turn").alias("id")
    )
    back = turns.select(F.col("id").alias("src"), F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("dep"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    loops = turns.where("role = 'system'").join(last, "conv_id").select(
        F.col("id").alias("src"), F.concat_ws(":", "conv_id", "last").alias("dep")
    )
    return turns, back, loops


@query(
    "dependency_levels",
    """WITH RECURSIVE c AS (SELECT conv_id, turn FROM conversations
         WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')),
       t AS (SELECT conv_id, turn, 0 AS tier FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
         UNION ALL SELECT c.conv_id, c.turn, t.tier + 1 FROM t JOIN c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
       SELECT conv_id || ':' || turn AS id, tier FROM t
       UNION ALL SELECT conv_id || ':' || turn, NULL FROM conversations
         WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def dependency_levels(spark, sf_dir):
    turns, back, loops = _turn_graph(spark, sf_dir)
    return graph.dependency_levels(turns.select("id"), back.unionByName(loops))


@query(
    "blocked_by_failure",
    """WITH f AS (SELECT conv_id, turn FROM conversations WHERE length(text) > 1500),
       first_failed AS (SELECT conv_id, min(turn) AS turn FROM f GROUP BY 1)
       SELECT c.conv_id || ':' || c.turn AS id FROM conversations c JOIN first_failed f ON f.conv_id = c.conv_id
       WHERE c.turn > f.turn AND (c.conv_id, c.turn) NOT IN (SELECT conv_id, turn FROM f)""",
)
def blocked_by_failure(spark, sf_dir):
    turns, back, _ = _turn_graph(spark, sf_dir)
    return graph.blocked_by_failure(back, turns.where("chars > 1500").select("id"))


@query(
    "union_edges",
    """SELECT 'order' AS src_type, o_orderkey::VARCHAR AS src_id, 'customer' AS dep_type, o_custkey::VARCHAR AS dep_id FROM orders
       UNION ALL SELECT 'line', l_orderkey || '/' || l_linenumber, 'part', l_partkey::VARCHAR FROM lineitem
       UNION ALL SELECT 'line', l_orderkey || '/' || l_linenumber, 'supplier', l_suppkey::VARCHAR FROM lineitem
       UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'nation', c_nationkey::VARCHAR FROM customer""",
)
def union_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    return graph.union_edges(
        [
            graph.edges_from(table(spark, sf_dir, "orders"), "order", "o_orderkey", F.col("o_custkey"), "customer"),
            graph.edges_from(lines, "line", "id", F.col("l_partkey"), "part"),
            graph.edges_from(lines, "line", "id", F.col("l_suppkey"), "supplier"),
            graph.edges_from(table(spark, sf_dir, "customer"), "customer", "c_custkey", F.col("c_nationkey"), "nation"),
        ]
    )


@query(
    "reference_edges",
    """SELECT 'experiment' AS src_type, o_orderkey::VARCHAR AS src_id, 'dataset' AS dep_type, o_custkey::VARCHAR AS dep_id FROM orders
       UNION ALL SELECT 'experiment', o_orderkey::VARCHAR, 'experiment', (o_orderkey - 1)::VARCHAR FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT 'function', conv_id || ':' || turn, 'dataset', conv_id::VARCHAR FROM conversations WHERE role = 'user'
       UNION ALL SELECT 'prompt', p_partkey::VARCHAR, 'prompt', p_size::VARCHAR FROM part
       UNION ALL SELECT 'project_score', c_custkey::VARCHAR, 'project', c_nationkey::VARCHAR FROM customer
       UNION ALL SELECT 'project_score', c_custkey::VARCHAR, 'function', (c_custkey + 1)::VARCHAR FROM customer WHERE c_acctbal > 0
       UNION ALL SELECT 'view', s_suppkey::VARCHAR, 'dataset', s_nationkey::VARCHAR FROM supplier WHERE s_acctbal > 0
       UNION ALL SELECT 'role', n_nationkey::VARCHAR, 'role', (n_nationkey + 1)::VARCHAR FROM nation
       UNION ALL SELECT 'role', n_nationkey::VARCHAR, 'role', n_regionkey::VARCHAR FROM nation
       UNION ALL SELECT 'group', r_regionkey::VARCHAR, 'group', '99' FROM region
       UNION ALL SELECT 'acl', l_orderkey || '/' || l_linenumber, 'dataset', l_partkey::VARCHAR FROM lineitem
       UNION ALL SELECT 'acl', l_orderkey || '/' || l_linenumber, 'role', l_suppkey::VARCHAR FROM lineitem WHERE l_returnflag = 'A'
       UNION ALL SELECT 'acl', l_orderkey || '/' || l_linenumber, 'group', l_suppkey::VARCHAR FROM lineitem WHERE l_returnflag <> 'A'""",
)
def reference_edges(spark, sf_dir):
    text = lambda name: F.col(name).cast("string")
    is_a = F.col("l_returnflag") == "A"
    scorer = lambda kind, ident: F.struct(F.lit(kind).alias("type"), ident.alias("id"))
    tables = {
        "experiment": table(spark, sf_dir, "orders").select(
            text("o_orderkey").alias("id"), text("o_custkey").alias("dataset_id"),
            F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") - 1).cast("string")).alias("base_exp_id"),
        ),
        "function": table(spark, sf_dir, "conversations").select(
            F.concat_ws(":", "conv_id", "turn").alias("id"),
            F.struct(
                F.when(F.col("role") == "user", "dataset").otherwise("session").alias("object_type"),
                text("conv_id").alias("object_id"),
            ).alias("origin"),
        ),
        "prompt": table(spark, sf_dir, "part").select(
            text("p_partkey").alias("id"), F.struct(F.struct(text("p_size").alias("prompt_id")).alias("origin")).alias("prompt_data")
        ),
        "project_score": table(spark, sf_dir, "customer").select(
            text("c_custkey").alias("id"), text("c_nationkey").alias("project_id"),
            F.when(
                F.col("c_acctbal") > 0,
                F.struct(
                    F.struct(
                        F.array(scorer("function", (F.col("c_custkey") + 1).cast("string")), scorer("global", F.lit("7"))).alias("scorers")
                    ).alias("online")
                ),
            ).alias("config"),
        ),
        "view": table(spark, sf_dir, "supplier").select(
            text("s_suppkey").alias("id"), text("s_nationkey").alias("object_id"),
            F.when(F.col("s_acctbal") > 0, "dataset").otherwise("project").alias("object_type"),
        ),
        "role": table(spark, sf_dir, "nation").select(
            text("n_nationkey").alias("id"), F.array((F.col("n_nationkey") + 1).cast("string"), text("n_regionkey")).alias("member_roles")
        ),
        "group": table(spark, sf_dir, "region").select(text("r_regionkey").alias("id"), F.array(F.lit("99")).alias("member_groups")),
        "acl": table(spark, sf_dir, "lineitem").select(
            F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), F.lit("dataset").alias("object_type"),
            text("l_partkey").alias("object_id"), F.when(is_a, text("l_suppkey")).alias("role_id"),
            F.when(~is_a, text("l_suppkey")).alias("group_id"),
        ),
        "project_tag": table(spark, sf_dir, "region").select(text("r_regionkey").alias("id")),
    }
    return graph.reference_edges(tables)
