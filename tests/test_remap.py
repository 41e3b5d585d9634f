"""Foreign keys of every shape, on the object shapes the library copies."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanferry.operators import remap, resolve
from spanferry.operators.joins import JoinLimits

SALTED = JoinLimits(max_rows=0)
MAP = "source_id string, dest_id string"
TYPED = "resource_type string, source_id string, dest_id string"


@pytest.fixture(scope="module")
def exp_map(spark):
    return spark.createDataFrame([("e1", "E1"), ("e2", "E2"), ("blank", "")], MAP)


@pytest.fixture(scope="module")
def experiments(spark):
    return spark.createDataFrame(
        [("a", "e1", "v1"), ("b", "gone", "v2"), ("c", None, "v3"), ("d", "blank", "v4")], "id string, fk string, version string"
    )


def as_dict(df, key="id"):
    return {r[key]: tuple(v for k, v in r.asDict(recursive=True).items() if k != key) for r in df.collect()}


@pytest.mark.parametrize("limits", [JoinLimits(), SALTED])
def test_null_on_miss_with_pair(experiments, exp_map, limits):
    got = as_dict(remap.remap_fk(experiments, exp_map, "fk", "null", ["version"], limits))
    assert got == {"a": ("E1", "v1"), "b": (None, None), "c": (None, None), "d": (None, None)}


def test_keep_and_drop_row(experiments, exp_map):
    assert as_dict(remap.remap_fk(experiments, exp_map, "fk", "keep"))["b"] == ("gone", "v2")
    assert set(as_dict(remap.remap_fk(experiments, exp_map, "fk", "drop_row"))) == {"a", "c"}


def test_fail_on_miss(experiments, exp_map):
    with pytest.raises(PySparkException, match="no destination for fk gone"):
        remap.remap_fk(experiments.where("id in ('a', 'b')"), exp_map, "fk", "fail").collect()
    assert remap.remap_fk(experiments.where("id in ('a', 'c')"), exp_map, "fk", "fail").count() == 2
    with pytest.raises(ValueError):
        remap.remap_fk(experiments, exp_map, "fk", "explode")


def test_scope(spark, experiments, exp_map):
    assert as_dict(remap.remap_scope(experiments, exp_map, "fk", "P"))["b"] == ("P", "v2")
    with pytest.raises(PySparkException, match="no destination scope"):
        remap.remap_scope(experiments, exp_map, "fk").collect()


def test_views(spark):
    views = spark.createDataFrame(
        [("1", "project", "p"), ("2", "experiment", "e1"), ("3", "experiment", "gone"), ("4", "dataset", "e1"), ("5", "other", "x"), ("6", None, "y")],
        "id string, object_type string, object_id string",
    )
    id_map = spark.createDataFrame([("experiment", "e1", "E1"), ("dataset", "e1", "D1")], TYPED)
    rules = {
        "project": remap.TypeRule(constant="P"),
        "experiment": remap.TypeRule(resource_type="experiment"),
        "dataset": remap.TypeRule(resource_type="dataset"),
    }
    got = {k: v[1] for k, v in as_dict(remap.remap_polymorphic(views, id_map, rules, "object_type", "object_id")).items()}
    assert got == {"1": "P", "2": "E1", "3": "gone", "4": "D1", "5": "x", "6": "y"}
    # Without a destination project the source id stays.
    rules["project"] = remap.TypeRule()
    got = {k: v[1] for k, v in as_dict(remap.remap_polymorphic(views, id_map, rules, "object_type", "object_id")).items()}
    assert got["1"] == "p"


def test_function_origin(spark):
    functions = spark.createDataFrame(
        [
            ("1", ("dataset", "d1", True)), ("2", ("dataset", "gone", True)), ("3", ("project", "p", False)),
            ("4", ("session", "d1", None)), ("5", None), ("6", ("prompt", None, None)),
        ],
        "id string, origin struct<object_type: string, object_id: string, internal: boolean>",
    )
    id_map = spark.createDataFrame([("dataset", "d1", "D1")], TYPED)
    out = remap.remap_nested(
        functions, id_map, "origin.object_id", "drop_struct", type_field="object_type",
        types=("prompt", "dataset", "experiment", "project"), constants={"project": "P"},
    )
    got = {r["id"]: tuple(r["origin"]) if r["origin"] else None for r in out.collect()}
    assert got == {
        "1": ("dataset", "D1", True), "2": None, "3": ("project", "P", False),
        "4": ("session", "d1", None), "5": None, "6": ("prompt", None, None),
    }


def test_prompt_origin(spark, exp_map):
    schema = "id string, prompt_data struct<kind: string, origin: struct<prompt_id: string, project_id: string>>"
    prompts = spark.createDataFrame(
        [("1", ("k", ("e1", "p"))), ("2", ("k", ("e2", None))), ("3", ("k", ("gone", "p"))), ("4", ("k", None)), ("5", None)], schema
    )
    out = remap.remap_nested(prompts, exp_map, "prompt_data.origin.prompt_id", also={"project_id": "P"})
    got = {r["id"]: r["prompt_data"] for r in out.collect()}
    assert tuple(got["1"]["origin"]) == ("E1", "P")
    assert tuple(got["2"]["origin"]) == ("E2", None)
    assert got["3"]["origin"] is None and got["3"]["kind"] == "k"
    assert got["4"]["origin"] is None and got["5"] is None


def test_arrays(spark, exp_map):
    roles = spark.createDataFrame(
        [("1", ["e2", "x", "e1", "e2"]), ("2", ["x"]), ("3", []), ("4", None), ("5", ["blank", None, "e1"])], "id string, members array<string>"
    )
    keep = {r["id"]: r["members"] for r in remap.remap_array(roles, exp_map, "members", ["id"], on_empty="keep").collect()}
    assert keep == {"1": ["E2", "E1", "E2"], "2": ["x"], "3": [], "4": None, "5": ["E1"]}
    drop = {r["id"]: r["members"] for r in remap.remap_array(roles, exp_map, "members", ["id"], distinct=True).collect()}
    assert drop == {"1": ["E2", "E1"], "2": None, "3": [], "4": None, "5": ["E1"]}


def test_distinct_on_the_destination(spark):
    merged = spark.createDataFrame([("u1", "U"), ("u2", "U"), ("u3", "V")], MAP)
    groups = spark.createDataFrame([("g", ["u2", "u3", "u1"])], "id string, users array<string>")
    assert remap.remap_array(groups, merged, "users", ["id"], distinct=True).first()["users"] == ["U", "V"]


def test_function_references(spark, exp_map):
    item = "array<struct<type: string, id: string, name: string>>"
    refs = [("function", "e1", "f"), ("global", None, "G"), ("function", "gone", None), ("slug", "s", None), ("global", None, None), ("function", None, None)]
    df = spark.createDataFrame([("1", refs), ("2", None), ("3", [])], f"id string, refs {item}")
    keep = {r["id"]: r["refs"] and [tuple(x) for x in r["refs"]] for r in remap.remap_function_refs(df, exp_map, "refs", ["id"], "keep").collect()}
    assert keep["1"] == [("function", "E1", None), ("global", None, "G"), ("slug", "s", None), ("global", None, None)]
    assert keep["2"] is None and keep["3"] == []
    drop = remap.remap_function_refs(df, exp_map, "refs", ["id"], "drop").where("id = '1'").first()["refs"]
    assert [tuple(x) for x in drop] == [("function", "E1", None), ("global", None, "G")]


@pytest.mark.parametrize("size", [200, 2000])
@pytest.mark.parametrize("limits", [JoinLimits(), SALTED])
def test_arrays_with_null_and_repeated_keys_at_every_size(spark, size, limits):
    mapping = spark.createDataFrame([(f"s{i}", f"D{i}") for i in range(size)] + [(None, "NEVER")], MAP)
    rows = [(None, ["s1", "s2"]), (None, ["s3"]), ("a", ["s4", None, "x", "s4"]), ("a", ["s5"]), ("a", ["null"]), ("a", [None]), ("b", []), (None, None)]
    df = spark.createDataFrame(rows, "id string, items array<string>")
    got = sorted(str((r["id"], r["items"])) for r in remap.remap_array(df, mapping, "items", ["id"], on_empty="drop", limits=limits).collect())
    want = [(None, ["D1", "D2"]), (None, ["D3"]), ("a", ["D4", "D4"]), ("a", ["D5"]), ("a", None), ("a", None), ("b", []), (None, None)]
    assert got == sorted(map(str, want))
    refs = df.where("items is not null").selectExpr("id", "transform(items, x -> named_struct('type', 'function', 'id', x, 'name', 'f')) refs")
    out = remap.remap_function_refs(refs, mapping, "refs", ["id"], limits=limits).collect()
    assert sorted(str((r["id"], [x["id"] for x in r["refs"]])) for r in out) == sorted(str((i, x or [])) for i, x in want[:7])


ACL = "id string, object_type string, object_id string, user_id string, group_id string, role_id string, permission string, restrict_object_type string"


@pytest.fixture(scope="module")
def acl_map(spark):
    return spark.createDataFrame(
        [("project", "p1", "P1"), ("user", "u1", "U1"), ("group", "g1", "G1"), ("role", "r1", "R1"), ("experiment", "e1", "E1")], TYPED
    )


@pytest.mark.parametrize("limits", [JoinLimits(), SALTED])
def test_acl_reasons_in_order(spark, acl_map, limits):
    acls = spark.createDataFrame(
        [
            ("ok", "project", "p1", None, "g1", "r1", None, None),
            ("org", "organization", None, None, "g1", None, "read", None),
            ("user", "project", "p1", "u1", "g1", None, "read", None),
            ("type", "project_log", "p1", None, "g1", None, "read", None),
            ("object", "experiment", "gone", "gone", "gone", "gone", None, None),
            ("nouser", "project", "p1", "gone", "gone", "gone", None, None),
            ("nogroup", "project", "p1", None, "gone", "gone", None, None),
            ("norole", "project", "p1", None, None, "gone", None, None),
        ],
        ACL,
    )
    out = {r["id"]: r for r in remap.classify_acl(acls, acl_map, "ORG", map_users=True, limits=limits).collect()}
    assert {k: r["skip_reason"] for k, r in out.items()} == {
        "ok": None, "org": None, "user": None, "type": "unsupported_object_type", "object": "unresolved_object_dependency",
        "nouser": "unresolved_user_dependency", "nogroup": "unresolved_group_dependency", "norole": "unresolved_role_dependency",
    }
    assert (out["ok"]["object_id"], out["ok"]["group_id"], out["ok"]["role_id"]) == ("P1", "G1", "R1")
    assert out["org"]["object_id"] == "ORG"
    assert (out["user"]["user_id"], out["user"]["group_id"]) == ("U1", None)
    assert out["object"]["object_id"] == "gone"
    off = {r["id"]: r["skip_reason"] for r in remap.classify_acl(acls, acl_map, "ORG").collect()}
    assert off["user"] == off["object"] == "user_acl_mapping_disabled"


def test_equivalent_grants(spark, acl_map):
    src = spark.createDataFrame(
        [
            ("same", "project", "p1", "u1", None, None, "read", None),
            ("group", "project", "p1", None, "g1", "r1", None, "experiment"),
            ("any", "project", "p1", None, "g1", None, None, None),
            ("nobody", "project", "p1", None, None, None, "read", None),
            ("other", "project", "p1", "u1", None, None, "write", None),
            ("unmapped", "project", "p1", "u9", None, None, "read", None),
        ],
        ACL,
    )
    dst = spark.createDataFrame(
        [
            ("D1", "project", "P1", "U1", "x", "y", "read", None),
            ("D2", "project", "P1", None, "G1", "R1", "z", "experiment"),
            ("D3", "project", "P1", "U5", "G1", "R9", "w", None),
            ("D4", "project", "P1", "U1", None, None, "read", None),
            ("D5", "project", "P1", None, "G7", None, "read", None),
        ],
        ACL,
    )
    got = {r["id"]: r["equivalent_id"] for r in remap.equivalent_after_remap(src, dst, acl_map).collect()}
    # An unmapped user equals a missing one, as nulls are equal.
    assert got == {"same": "D1", "group": "D2", "any": "D3", "nobody": None, "other": None, "unmapped": "D5"}


def test_names(spark):
    src = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None), ("4", ""), ("5", "a")], "id string, name string")
    dst = spark.createDataFrame([("A1", "a", 1), ("A2", "a", 2), ("N", None, 3), ("E", "", 4), (None, "b", 5), ("B", "b", 6)], "id string, name string, pos int")

    def match(keep, limits=JoinLimits()):
        out = resolve.match_by_name(
            src, dst, source_id="id", source_name="name", dest_id="id", dest_name="name", position=["pos"], keep=keep, limits=limits
        )
        return {r["source_id"]: r["dest_id"] for r in out.collect()}

    assert match("last") == match("last", SALTED) == {"1": "A2", "2": "B", "5": "A2"}
    assert match("first") == {"1": "A1", "2": "B", "5": "A1"}
    paired = resolve.pair_read_only(
        src, dst.where("name = 'a'"), source_id="id", source_name="name", dest_id="id", dest_name="name", position=["pos"],
        names=spark.createDataFrame([("a",), ("b",)], "name string"),
    )
    assert {r["source_id"]: r["dest_id"] for r in paired.collect()} == {"1": "A2", "2": "", "5": "A2"}
    missing = resolve.missing_in_dest(src, dst.where("name = 'a'"), source_name="name", dest_name="name")
    assert {r["id"] for r in missing.collect()} == {"2", "3", "4"}


def test_emails(spark):
    src = spark.createDataFrame([("1", " A@x.org "), ("2", ""), ("3", None), ("4", "b@x.org"), ("5", "none@x.org")], "id string, email string")
    dst = spark.createDataFrame([("U1", "a@X.org", 1), ("U2", "A@x.org", 2), ("U3", "  ", 3), ("U4", "b@x.org", 4)], "id string, email string, pos int")
    given = spark.createDataFrame([("4", "GIVEN"), ("2", "TWO")], MAP)
    out = resolve.match_by_email(
        src, dst, source_id="id", source_email="email", dest_id="id", dest_email="email", position=["pos"], explicit=given
    )
    assert {r["source_id"]: r["dest_id"] for r in out.collect()} == {"1": "U1", "2": "TWO", "4": "GIVEN"}


def test_later_mapping_wins(spark):
    stored = spark.createDataFrame([("1", "old"), ("2", "old"), ("3", "old")], MAP)
    matched = spark.createDataFrame([("1", "named"), ("2", "named")], MAP)
    created = spark.createDataFrame([("1", "new", 2), ("1", "older", 1)], MAP + ", prio int")
    merged = resolve.merge_mappings(stored, matched, created)
    assert {r["source_id"]: r["dest_id"] for r in merged.collect()} == {"1": "new", "2": "named", "3": "old"}


def test_grantees_of_a_small_kind_are_broadcast(spark):
    n = F.col("id")
    grants = spark.range(300).select(
        F.lit("dataset").alias("object_type"), (n % 60).alias("object_id"), F.when(n % 4 == 0, n % 60).alias("user_id"),
        F.when(n % 3 == 0, n % 5).alias("group_id"), (n % 2).alias("role_id"),
    )
    sizes = (("dataset", 50), ("user", 50), ("group", 4), ("role", 2))
    known = None
    for kind, size in sizes:
        one = spark.range(size).select(F.lit(kind).alias("resource_type"), F.col("id").alias("source_id"), (F.col("id") + 100).alias("dest_id"))
        known = one if known is None else known.unionByName(one)
    out = remap.classify_acl(grants, known, 7, map_users=True, limits=JoinLimits(max_rows=10))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2
    expected = remap.classify_acl(grants, known, 7, map_users=True)
    assert out.exceptAll(expected).count() == 0 and expected.exceptAll(out).count() == 0
