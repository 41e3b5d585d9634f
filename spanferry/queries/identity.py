"""Identity resolution and foreign-key remapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanferry.operators import dedup, remap, resolve
from spanferry.queries.registry import query, table

# The destination knows customers with a balance, parts above size 10 and suppliers with a balance.
_CUSTOMER_MAP = "cust_map AS (SELECT c_custkey AS source_id, c_custkey + 1000000 AS dest_id FROM customer WHERE c_acctbal > 0)"
_PART_MAP = "part_map AS (SELECT p_partkey AS source_id, p_partkey + 1000000 AS dest_id FROM part WHERE p_size > 10)"
_SUPPLIER_MAP = "supp_map AS (SELECT s_suppkey AS source_id, s_suppkey + 1000000 AS dest_id FROM supplier WHERE s_acctbal > 0)"


def _mapping(df, key, condition):
    return df.where(condition).select(F.col(key).alias("source_id"), (F.col(key) + 1000000).alias("dest_id"))


def customer_map(spark, sf_dir):
    return _mapping(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal > 0")


def part_map(spark, sf_dir):
    return _mapping(table(spark, sf_dir, "part"), "p_partkey", "p_size > 10")


def supplier_map(spark, sf_dir):
    return _mapping(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal > 0")


def _typed(**maps):
    out = None
    for kind, one in maps.items():
        tagged = one.select(F.lit(kind).alias("resource_type"), "source_id", "dest_id")
        out = tagged if out is None else out.unionByName(tagged)
    return out


_MATCH_NAME = """WITH dst AS (SELECT p_name, p_partkey + 1000000 AS dest_id,
         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey {order}) AS rn FROM part)
       SELECT p.p_partkey AS source_id, d.dest_id FROM part p JOIN dst d ON p.p_name = d.p_name AND d.rn = 1"""


def _match_parts(spark, sf_dir, keep):
    parts = table(spark, sf_dir, "part")
    dst = parts.select((F.col("p_partkey") + 1000000).alias("id"), "p_name", F.col("p_partkey").alias("pos"))
    return resolve.match_by_name(
        parts, dst, source_id="p_partkey", source_name="p_name", dest_id="id", dest_name="p_name",
        position=["pos"], keep=keep,
    )


@query("match_name_last", _MATCH_NAME.format(order="DESC"))
def match_name_last(spark, sf_dir):
    return _match_parts(spark, sf_dir, "last")


@query("match_name_first", _MATCH_NAME.format(order="ASC"))
def match_name_first(spark, sf_dir):
    return _match_parts(spark, sf_dir, "first")


@query(
    "match_email",
    """WITH src AS (SELECT c_custkey AS id, '  ' || upper(c_name) || ' ' AS email FROM customer
                    UNION ALL SELECT 10000000 + n_nationkey, '   ' FROM nation),
            dst AS (SELECT lower(trim(c_name)) AS email, min(c_custkey) + 1000000 AS dest_id FROM customer WHERE c_acctbal > 0 GROUP BY 1),
            given AS (SELECT c_custkey AS id, c_custkey + 5000000 AS dest_id FROM customer WHERE c_nationkey = 5)
       SELECT s.id AS source_id, coalesce(g.dest_id, d.dest_id) AS dest_id FROM src s
       LEFT JOIN dst d ON nullif(lower(trim(s.email)), '') = d.email LEFT JOIN given g ON g.id = s.id
       WHERE coalesce(g.dest_id, d.dest_id) IS NOT NULL""",
)
def match_email(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    src = customers.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("email")
    ).unionByName(
        table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10000000).cast("bigint").alias("id"), F.lit("   ").alias("email"))
    )
    dst = customers.where("c_acctbal > 0").select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_name").alias("email"))
    given = customers.where("c_nationkey = 5").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") + 5000000).alias("dest_id"))
    return resolve.match_by_email(
        src, dst, source_id="id", source_email="email", dest_id="id", dest_email="email", position=["id"], explicit=given
    )


@query(
    "missing_in_dest",
    """SELECT c_custkey, c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_mktsegment <> 'MACHINERY')""",
)
def missing_in_dest(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    dst = customers.where("c_mktsegment <> 'MACHINERY'")
    return resolve.missing_in_dest(customers, dst, source_name="c_name", dest_name="c_name").drop("c_mktsegment")


@query(
    "pair_read_only",
    """SELECT n_nationkey AS source_id, CASE WHEN n_regionkey = 1 THEN '' ELSE (n_nationkey + 100)::VARCHAR END AS dest_id,
              n_name AS name FROM nation""",
)
def pair_read_only(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    dst = nation.where("n_regionkey <> 1").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("name"))
    return resolve.pair_read_only(
        nation, dst, source_id="n_nationkey", source_name="n_name", dest_id="id", dest_name="name", position=["id"]
    )


@query(
    "merge_mappings",
    """WITH maps AS (
         SELECT c_custkey AS source_id, c_custkey + 1000000 AS dest_id, 0 AS m FROM customer WHERE c_acctbal > 0
         UNION ALL SELECT c_custkey, c_custkey + 2000000, 1 FROM customer WHERE c_nationkey < 12
         UNION ALL SELECT c_custkey, c_custkey + 3000000, 2 FROM customer WHERE c_mktsegment = 'FURNITURE')
       SELECT source_id, arg_max(dest_id, m) AS dest_id FROM maps GROUP BY 1""",
)
def merge_mappings(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")

    def shifted(condition, by):
        return customers.where(condition).select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") + by).alias("dest_id"))

    return resolve.merge_mappings(
        shifted("c_acctbal > 0", 1000000), shifted("c_nationkey < 12", 2000000), shifted("c_mktsegment = 'FURNITURE'", 3000000)
    )


@query(
    "remap_fk_null",
    f"""WITH {_CUSTOMER_MAP} SELECT o_orderkey, m.dest_id AS o_custkey,
        CASE WHEN m.dest_id IS NOT NULL THEN o_orderpriority END AS o_orderpriority
        FROM orders LEFT JOIN cust_map m ON m.source_id = o_custkey""",
)
def remap_fk_null(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return remap.remap_fk(orders, customer_map(spark, sf_dir), "o_custkey", "null", ["o_orderpriority"])


@query(
    "remap_fk_keep",
    f"""WITH {_CUSTOMER_MAP} SELECT o_orderkey, coalesce(m.dest_id, o_custkey) AS o_custkey
        FROM orders LEFT JOIN cust_map m ON m.source_id = o_custkey""",
)
def remap_fk_keep(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return remap.remap_fk(orders, customer_map(spark, sf_dir), "o_custkey", "keep")


@query(
    "remap_fk_drop_row",
    f"""WITH {_CUSTOMER_MAP} SELECT o_orderkey, m.dest_id AS o_custkey
        FROM orders JOIN cust_map m ON m.source_id = o_custkey""",
)
def remap_fk_drop_row(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return remap.remap_fk(orders, customer_map(spark, sf_dir), "o_custkey", "drop_row")


@query(
    "remap_scope",
    """SELECT s_suppkey, s_name, CASE WHEN n_regionkey <> 3 THEN s_nationkey + 100 ELSE 999 END AS s_nationkey
       FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def remap_scope(spark, sf_dir):
    scopes = table(spark, sf_dir, "nation").where("n_regionkey <> 3").select(
        F.col("n_nationkey").alias("source_id"), (F.col("n_nationkey") + 100).alias("dest_id")
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return remap.remap_scope(suppliers, scopes, "s_nationkey", default=999)


@query(
    "remap_polymorphic",
    f"""WITH {_CUSTOMER_MAP}, {_SUPPLIER_MAP} SELECT event_id, event_type, CASE event_type
          WHEN 'signup' THEN 77 WHEN 'click' THEN coalesce(c.dest_id, user_id) WHEN 'view' THEN c.dest_id
          WHEN 'purchase' THEN s.dest_id ELSE user_id END AS user_id
        FROM events LEFT JOIN cust_map c ON c.source_id = user_id LEFT JOIN supp_map s ON s.source_id = user_id
        WHERE NOT (event_type = 'purchase' AND s.dest_id IS NULL)""",
)
def remap_polymorphic(spark, sf_dir):
    id_map = _typed(customer=customer_map(spark, sf_dir), supplier=supplier_map(spark, sf_dir))
    rules = {
        "signup": remap.TypeRule(constant=77),
        "click": remap.TypeRule(resource_type="customer", on_miss="keep"),
        "view": remap.TypeRule(resource_type="customer", on_miss="null"),
        "purchase": remap.TypeRule(resource_type="supplier", on_miss="drop_row"),
    }
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return remap.remap_polymorphic(events, id_map, rules, "event_type", "user_id")


@query(
    "remap_nested",
    """WITH long_conv AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) > 4)
       SELECT c.conv_id, turn, CASE WHEN role = 'user' AND l.conv_id IS NULL THEN NULL ELSE role END AS object_type,
              CASE WHEN role = 'user' THEN l.conv_id + 1000000 WHEN role = 'system' THEN -1 ELSE c.conv_id END AS object_id
       FROM conversations c LEFT JOIN long_conv l ON l.conv_id = c.conv_id""",
)
def remap_nested(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    mapping = (
        conversations.groupBy("conv_id").agg(F.max("turn").alias("last")).where("last > 4")
        .select(F.lit("user").alias("resource_type"), F.col("conv_id").alias("source_id"), (F.col("conv_id") + 1000000).alias("dest_id"))
    )
    nested = conversations.select(
        "conv_id", "turn", F.struct(F.col("role").alias("object_type"), F.col("conv_id").alias("object_id")).alias("origin")
    )
    out = remap.remap_nested(
        nested, mapping, "origin.object_id", "drop_struct", type_field="object_type",
        types=["user", "system"], constants={"system": -1},
    )
    return out.select("conv_id", "turn", "origin.object_type", "origin.object_id")


@query(
    "remap_nested_deep",
    f"""WITH {_CUSTOMER_MAP} SELECT o_orderkey, o_orderstatus AS kind, m.dest_id AS prompt_id,
               CASE WHEN m.dest_id IS NOT NULL AND o_orderpriority <> '5-LOW' THEN 'project-1' END AS project_id
        FROM orders LEFT JOIN cust_map m ON m.source_id = o_custkey""",
)
def remap_nested_deep(spark, sf_dir):
    source_project = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    origin = F.struct(F.col("o_custkey").alias("prompt_id"), source_project.alias("project_id"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.struct(F.col("o_orderstatus").alias("kind"), origin.alias("origin")).alias("prompt_data")
    )
    out = remap.remap_nested(
        orders, customer_map(spark, sf_dir), "prompt_data.origin.prompt_id", "drop_struct", also={"project_id": "project-1"}
    )
    return out.select("o_orderkey", "prompt_data.kind", "prompt_data.origin.prompt_id", "prompt_data.origin.project_id")


def _order_lines(spark, sf_dir):
    """Each order with its lines as arrays, in line order."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice"
    )
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    return items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


_LINE_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice"


@query(
    "remap_array",
    f"""WITH {_PART_MAP}, hits AS (
          SELECT l_orderkey, l_partkey, m.dest_id, row_number() OVER (PARTITION BY l_orderkey {_LINE_ORDER}) AS rn,
                 count(m.dest_id) OVER (PARTITION BY l_orderkey) AS n
          FROM lineitem LEFT JOIN part_map m ON m.source_id = l_partkey)
        SELECT l_orderkey, string_agg((CASE WHEN n = 0 THEN l_partkey ELSE dest_id END)::VARCHAR, ',' ORDER BY rn) AS parts
        FROM hits WHERE n = 0 OR dest_id IS NOT NULL GROUP BY 1""",
)
def remap_array(spark, sf_dir):
    orders = _order_lines(spark, sf_dir).select("l_orderkey", F.transform("lines", lambda x: x["l_partkey"]).alias("parts"))
    out = remap.remap_array(orders, part_map(spark, sf_dir), "parts", ["l_orderkey"], on_empty="keep")
    return out.select("l_orderkey", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query(
    "remap_array_distinct",
    f"""WITH {_SUPPLIER_MAP}, hits AS (
          SELECT l_orderkey, m.dest_id // 10 AS dest_id, row_number() OVER (PARTITION BY l_orderkey {_LINE_ORDER}) AS rn
          FROM lineitem LEFT JOIN supp_map m ON m.source_id = l_suppkey),
        firsts AS (SELECT l_orderkey, dest_id, min(rn) AS rn FROM hits WHERE dest_id IS NOT NULL GROUP BY 1, 2)
        SELECT o.l_orderkey, string_agg(dest_id::VARCHAR, ',' ORDER BY rn) AS suppliers
        FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN firsts f ON f.l_orderkey = o.l_orderkey GROUP BY 1""",
)
def remap_array_distinct(spark, sf_dir):
    orders = _order_lines(spark, sf_dir).select("l_orderkey", F.transform("lines", lambda x: x["l_suppkey"]).alias("suppliers"))
    mapping = supplier_map(spark, sf_dir).withColumn("dest_id", F.expr("dest_id div 10"))
    out = remap.remap_array(orders, mapping, "suppliers", ["l_orderkey"], distinct=True, on_empty="drop")
    return out.select("l_orderkey", F.array_join(F.col("suppliers").cast("array<string>"), ",").alias("suppliers"))


_REFS_SQL = f"""WITH {_PART_MAP}, refs AS (
          SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey {_LINE_ORDER}) AS rn,
                 CASE l_returnflag WHEN 'A' THEN 'function' WHEN 'N' THEN 'global' ELSE 'slug' END AS kind,
                 l_partkey AS id, CASE WHEN l_suppkey < 50 THEN 'name' || l_suppkey END AS name FROM lineitem)
        SELECT l_orderkey, string_agg(kind || ':' || (CASE WHEN kind = 'function' THEN dest_id ELSE id END)::VARCHAR
               || ':' || coalesce(CASE WHEN kind <> 'function' THEN name END, ''), ',' ORDER BY rn) AS refs
        FROM refs LEFT JOIN part_map m ON m.source_id = id WHERE {{keep}} GROUP BY 1"""


def _refs(spark, sf_dir, unknown):
    kind = lambda x: F.when(x["l_returnflag"] == "A", "function").when(x["l_returnflag"] == "N", "global").otherwise("slug")
    name = lambda x: F.when(x["l_suppkey"] < 50, F.concat(F.lit("name"), x["l_suppkey"].cast("string")))
    refs = F.transform("lines", lambda x: F.struct(kind(x).alias("type"), x["l_partkey"].alias("id"), name(x).alias("name")))
    orders = _order_lines(spark, sf_dir).select("l_orderkey", refs.alias("refs"))
    out = remap.remap_function_refs(orders, part_map(spark, sf_dir), "refs", ["l_orderkey"], unknown)
    text = lambda r: F.concat(r["type"], F.lit(":"), r["id"].cast("string"), F.lit(":"), F.coalesce(r["name"], F.lit("")))
    return out.where(F.size("refs") > 0).select("l_orderkey", F.array_join(F.transform("refs", text), ",").alias("refs"))


@query("remap_refs_keep", _REFS_SQL.format(keep="kind <> 'function' OR dest_id IS NOT NULL"))
def remap_refs_keep(spark, sf_dir):
    return _refs(spark, sf_dir, "keep")


@query(
    "remap_refs_drop",
    _REFS_SQL.format(keep="(kind = 'function' AND dest_id IS NOT NULL) OR (kind = 'global' AND name IS NOT NULL)"),
)
def remap_refs_drop(spark, sf_dir):
    return _refs(spark, sf_dir, "drop")


@query(
    "anti_seen",
    """SELECT o_orderkey, o_orderstatus FROM orders
       WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')""",
)
def anti_seen(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    loaded = orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return dedup.anti_seen(orders.select("o_orderkey", "o_orderstatus"), loaded, ["o_orderkey"])


@query(
    "skip_migrated",
    f"""WITH {_CUSTOMER_MAP} SELECT c_custkey, c_name, dest_id, dest_id IS NOT NULL AS skipped,
          CASE WHEN dest_id IS NOT NULL THEN 'already_migrated' END AS skip_reason
        FROM customer LEFT JOIN cust_map ON source_id = c_custkey""",
)
def skip_migrated(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return dedup.skip_migrated(customers, customer_map(spark, sf_dir), "c_custkey")


@query(
    "unresolved_refs",
    f"""WITH {_CUSTOMER_MAP} SELECT 'order' AS src_type, o_orderkey::VARCHAR AS src_id, 'customer' AS dep_type,
               o_custkey::VARCHAR AS dep_id FROM orders WHERE o_custkey NOT IN (SELECT source_id FROM cust_map)""",
)
def unresolved_refs(spark, sf_dir):
    from spanferry.operators.graph import edges_from

    edges = edges_from(table(spark, sf_dir, "orders"), "order", "o_orderkey", F.col("o_custkey"), "customer")
    known = _typed(customer=customer_map(spark, sf_dir)).withColumn("source_id", F.col("source_id").cast("string"))
    return dedup.unresolved_refs(edges, known)


_GRANT_SQL = """grants AS (
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS granted_by, l_extendedprice,
                CASE WHEN l_quantity < 6 THEN 'organization' WHEN l_quantity < 40 THEN 'dataset' ELSE 'project_log' END AS object_type,
                l_partkey AS object_id,
                CASE WHEN l_returnflag = 'A' THEN o_custkey END AS user_id,
                CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS group_id,
                CASE WHEN l_linestatus = 'O' THEN s_nationkey::BIGINT END AS role_id,
                CASE WHEN l_linestatus = 'F' THEN 'read' END AS permission
         FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey),
       role_map AS (SELECT n_nationkey::BIGINT AS source_id, n_nationkey + 1000 AS dest_id FROM nation WHERE n_regionkey <> 4)"""


def _grants(spark, sf_dir):
    # Parents of a foreign key: one row each, so the joins cannot fan out.
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").join(suppliers, "l_suppkey")
    quantity = F.col("l_quantity")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_suppkey").alias("granted_by"),
        F.when(quantity < 6, "organization").when(quantity < 40, "dataset").otherwise("project_log").alias("object_type"),
        F.col("l_partkey").alias("object_id"),
        F.when(F.col("l_returnflag") == "A", F.col("o_custkey")).alias("user_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("group_id"),
        F.when(F.col("l_linestatus") == "O", F.col("s_nationkey").cast("bigint")).alias("role_id"),
        F.when(F.col("l_linestatus") == "F", "read").alias("permission"),
    )


def _grant_map(spark, sf_dir):
    roles = table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(
        F.col("n_nationkey").cast("bigint").alias("source_id"), (F.col("n_nationkey") + 1000).cast("bigint").alias("dest_id")
    )
    return _typed(
        dataset=part_map(spark, sf_dir), user=customer_map(spark, sf_dir), group=supplier_map(spark, sf_dir), role=roles
    )


_CLASSIFY_SQL = f"""WITH {_CUSTOMER_MAP}, {_PART_MAP}, {_SUPPLIER_MAP}, {_GRANT_SQL}, resolved AS (
         SELECT g.*, CASE WHEN object_type = 'organization' THEN 42 WHEN object_type = 'dataset' THEN p.dest_id END AS d_object,
                u.dest_id AS d_user, s.dest_id AS d_group, r.dest_id AS d_role
         FROM grants g LEFT JOIN part_map p ON p.source_id = object_id LEFT JOIN cust_map u ON u.source_id = user_id
         LEFT JOIN supp_map s ON s.source_id = group_id LEFT JOIN role_map r ON r.source_id = role_id),
       reasoned AS (SELECT *, CASE WHEN user_id IS NOT NULL AND NOT {{map_users}} THEN 'user_acl_mapping_disabled'
                WHEN object_type = 'project_log' THEN 'unsupported_object_type'
                WHEN d_object IS NULL THEN 'unresolved_object_dependency'
                WHEN user_id IS NOT NULL AND d_user IS NULL THEN 'unresolved_user_dependency'
                WHEN user_id IS NULL AND group_id IS NOT NULL AND d_group IS NULL THEN 'unresolved_group_dependency'
                WHEN role_id IS NOT NULL AND d_role IS NULL THEN 'unresolved_role_dependency' END AS skip_reason FROM resolved)
       SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, object_type, skip_reason,
              CASE WHEN skip_reason IS NULL THEN d_object ELSE object_id END AS object_id,
              CASE WHEN skip_reason IS NULL THEN d_user ELSE user_id END AS user_id,
              CASE WHEN skip_reason IS NOT NULL THEN group_id WHEN user_id IS NULL THEN d_group END AS group_id,
              CASE WHEN skip_reason IS NULL THEN d_role ELSE role_id END AS role_id FROM reasoned"""


@query("classify_acl", _CLASSIFY_SQL.format(map_users="true"))
def classify_acl(spark, sf_dir):
    out = remap.classify_acl(_grants(spark, sf_dir), _grant_map(spark, sf_dir), 42, map_users=True)
    return out.drop("permission", "granted_by")


@query("classify_acl_without_users", _CLASSIFY_SQL.format(map_users="false"))
def classify_acl_without_users(spark, sf_dir):
    out = remap.classify_acl(_grants(spark, sf_dir), _grant_map(spark, sf_dir), 42, map_users=False)
    return out.drop("permission", "granted_by")


@query(
    "equivalent_after_remap",
    f"""WITH {_CUSTOMER_MAP}, {_PART_MAP}, src AS (
         SELECT o_orderkey AS id, 'dataset' AS object_type, p.p_partkey AS object_id, o_custkey AS user_id,
                o_orderstatus AS permission, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS restrict
         FROM orders JOIN part p ON p.p_partkey = o_custkey),
       dst AS (SELECT s.id + 1000000 AS id, s.object_type, m.dest_id AS object_id, c.dest_id AS user_id,
                CASE WHEN o_totalprice > 400000 THEN 'edited' ELSE permission END AS permission, restrict
         FROM src s JOIN orders o ON o.o_orderkey = s.id JOIN part_map m ON m.source_id = s.object_id
         LEFT JOIN cust_map c ON c.source_id = s.user_id)
       SELECT s.id, min(d.id) AS equivalent_id FROM src s LEFT JOIN part_map m ON m.source_id = s.object_id
         LEFT JOIN cust_map c ON c.source_id = s.user_id
         LEFT JOIN dst d ON d.object_id IS NOT DISTINCT FROM m.dest_id AND d.user_id IS NOT DISTINCT FROM c.dest_id
           AND d.permission = s.permission AND d.restrict IS NOT DISTINCT FROM s.restrict GROUP BY 1""",
)
def equivalent_after_remap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"))
    none = F.lit(None).cast("bigint")
    src = orders.join(parts, F.col("o_custkey") == F.col("object_id")).select(
        F.col("o_orderkey").alias("id"), F.lit("dataset").alias("object_type"), "object_id",
        F.col("o_custkey").alias("user_id"), none.alias("group_id"), none.alias("role_id"),
        F.col("o_orderstatus").alias("permission"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("restrict_object_type"),
        "o_totalprice",
    )
    objects, users = part_map(spark, sf_dir), customer_map(spark, sf_dir)
    copied = remap.remap_fk(remap.remap_fk(src, users, "user_id"), objects, "object_id", "drop_row")
    dst = copied.withColumns(
        {
            "id": F.col("id") + 1000000,
            "permission": F.when(F.col("o_totalprice") > 400000, F.lit("edited")).otherwise(F.col("permission")),
        }
    )
    id_map = _typed(dataset=objects, user=users)
    return remap.equivalent_after_remap(src, dst, id_map).select("id", "equivalent_id")


_DEDUP_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
         FROM lineitem) WHERE rn = 1"""
_LINE_ID = ["l_orderkey", "l_linenumber"]
_VERSION = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]
_KEPT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("dedup_first", _DEDUP_SQL)
def dedup_first(spark, sf_dir):
    return dedup.dedup_first(table(spark, sf_dir, "lineitem"), _LINE_ID, _VERSION).select(*_KEPT)


@query("dedup_first_wide", _DEDUP_SQL)
def dedup_first_wide(spark, sf_dir):
    return dedup.dedup_first_wide(table(spark, sf_dir, "lineitem"), _LINE_ID, _VERSION).select(*_KEPT)


@query(
    "dedup_counts",
    """SELECT count(*) AS fetched, count(DISTINCT (l_orderkey, l_linenumber)) AS kept,
              count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS skipped_seen, 0::BIGINT AS no_id FROM lineitem""",
)
def dedup_counts(spark, sf_dir):
    return dedup.dedup_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
