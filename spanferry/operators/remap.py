"""Foreign-key remapping through scalars, structs, arrays and type-dependent references.

Mappings hold each key once: ``(source_id, dest_id)``, or ``(resource_type, source_id, dest_id)`` where
one column can point at several tables. An id that maps to null or a blank string counts as a miss.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanferry.operators.joins import (
    DEFAULT_LIMITS,
    JoinLimits,
    fits_broadcast,
    fits_broadcast_each,
    hot_keys_each,
    lookup,
    nullable,
)
from spanferry.operators.resolve import has_value, is_set
from spanferry.shared import settle


def _with_dest(
    df: DataFrame, mapping: DataFrame, key: Column, out: str, limits: JoinLimits, keys_of: DataFrame | None = None
) -> DataFrame:
    """``df`` plus column ``out``: the mapped id of ``key``, or null."""
    probe = f"_{out}_key"
    pairs = mapping.where(is_set(mapping, "dest_id")).select(
        F.col("source_id").alias(probe), F.col("dest_id").alias(out)
    )
    key_type = pairs.schema[probe].dataType
    measured = None if keys_of is None else keys_of.select(key.cast(key_type).alias(probe))
    joined = lookup(df.withColumn(probe, key.cast(key_type)), pairs, [probe], "left", limits, keys_of=measured)
    return joined.select(*df.columns, out)


def _with_typed_dest(
    df: DataFrame,
    id_map: DataFrame,
    kind: Column,
    key: Column,
    out: str,
    limits: JoinLimits,
    small: bool | None = None,
    hot: list[int] | None = None,
) -> DataFrame:
    """As :func:`_with_dest`, against the rows of ``id_map`` whose ``resource_type`` equals ``kind``."""
    kind_col, probe = f"_{out}_kind", f"_{out}_key"
    pairs = id_map.where(is_set(id_map, "dest_id")).select(
        F.col("resource_type").alias(kind_col), F.col("source_id").alias(probe), F.col("dest_id").alias(out)
    )
    key_type = pairs.schema[probe].dataType
    keys = {kind_col: kind, probe: key.cast(key_type)}
    joined = lookup(df.withColumns(keys), pairs, [kind_col, probe], "left", limits, small, hot=hot)
    return joined.select(*df.columns, out)


def remap_fk(
    df: DataFrame,
    mapping: DataFrame,
    col: str,
    on_miss: str = "null",
    paired: Sequence[str] = (),
    limits: JoinLimits = DEFAULT_LIMITS,
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """Replace ``col`` by its mapped id.

    On a miss: ``null`` clears it together with the ``paired`` columns, ``keep`` leaves the source id,
    ``drop_row`` removes the row and ``fail`` raises. Rows without a key are not misses; they only
    lose the ``paired`` columns, which mean nothing without the key. When several keys of a table are
    remapped one after another, pass the table itself as ``keys_of`` (see :func:`lookup`).
    """
    if on_miss not in ("null", "keep", "drop_row", "fail"):
        raise ValueError(f"unknown on_miss {on_miss!r}")
    out = _with_dest(df, mapping, F.col(col), "_dest", limits, keys_of)
    dest = F.col("_dest").cast(df.schema[col].dataType)
    missed = is_set(df, col) & F.col("_dest").isNull()
    if on_miss == "drop_row":
        out = out.where(~missed)
    value = dest
    if on_miss == "keep":
        value = F.coalesce(dest, F.col(col))
    elif on_miss == "fail":
        message = F.concat(F.lit(f"no destination for {col} "), F.col(col).cast("string"))
        value = F.when(missed, F.raise_error(message).cast(df.schema[col].dataType)).otherwise(dest)
    updates = {col: value}
    for name in paired:
        updates[name] = F.when(value.isNotNull(), F.col(name))
    return out.select(*[updates[c].alias(c) if c in updates else F.col(c) for c in df.columns])


def remap_scope(
    df: DataFrame,
    mapping: DataFrame,
    col: str,
    default: object | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Owning scope of each row: its mapped id, else the configured destination, else an error."""
    kind = df.schema[col].dataType
    out = _with_dest(df, mapping, F.col(col), "_dest", limits)
    message = F.concat(F.lit(f"no destination scope for {col} "), F.coalesce(F.col(col).cast("string"), F.lit("null")))
    fallback = F.lit(default).cast(kind) if default is not None else F.raise_error(message).cast(kind)
    value = F.coalesce(F.col("_dest").cast(kind), fallback)
    return out.select(*[value.alias(c) if c == col else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class TypeRule:
    """How ids of one object type are resolved.

    ``constant`` wins over the mapping (the destination organisation or project); ``resource_type``
    names the mapping rows to use; ``on_miss`` is ``keep``, ``null`` or ``drop_row``.
    """

    resource_type: str | None = None
    constant: object | None = None
    on_miss: str = "keep"


def remap_polymorphic(
    df: DataFrame,
    id_map: DataFrame,
    rules: Mapping[str, TypeRule],
    type_col: str,
    id_col: str,
    default: TypeRule = TypeRule(),
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Remap ``id_col``, whose table depends on ``type_col``; types without a rule follow ``default``."""

    def per_type(pick, fallback: Column) -> Column:
        value = fallback
        for name, rule in rules.items():
            value = F.when(F.col(type_col) == name, pick(rule)).otherwise(value)
        return value

    kind = df.schema[id_col].dataType
    text = T.StringType()
    resource = per_type(lambda r: F.lit(r.resource_type).cast(text), F.lit(default.resource_type).cast(text))
    constant = per_type(lambda r: F.lit(r.constant).cast(kind), F.lit(default.constant).cast(kind))
    on_miss = per_type(lambda r: F.lit(r.on_miss), F.lit(default.on_miss))
    out = _with_typed_dest(df, id_map, resource, F.col(id_col), "_dest", limits)
    resolved = F.coalesce(constant, F.col("_dest").cast(kind))
    kept = out.where(resolved.isNotNull() | (on_miss != "drop_row"))
    value = F.coalesce(resolved, F.when(on_miss == "keep", F.col(id_col)))
    return kept.select(*[value.alias(c) if c == id_col else F.col(c) for c in df.columns])


def remap_nested(
    df: DataFrame,
    mapping: DataFrame,
    path: str,
    on_miss: str = "drop_struct",
    *,
    type_field: str | None = None,
    types: Sequence[str] = (),
    constants: Mapping[str, object] | None = None,
    also: Mapping[str, object] | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Remap a key inside a struct, e.g. ``origin.object_id`` or ``prompt_data.origin.prompt_id``.

    With ``type_field`` only structs whose type is in ``types`` are touched, and ``mapping`` holds
    ``(resource_type, source_id, dest_id)``; ``constants`` gives the destination for whole types. On a
    hit the fields in ``also`` are overwritten where present. On a miss ``drop_struct`` clears the
    whole struct, ``null`` the key and ``keep`` nothing. Structs without a key stay as they are.
    """
    if on_miss not in ("drop_struct", "null", "keep"):
        raise ValueError(f"unknown on_miss {on_miss!r}")
    *parents, field = path.split(".")
    if not parents:
        raise ValueError("path must name a field inside a struct")
    struct_path = ".".join(parents)
    struct, key = F.col(struct_path), F.col(path)
    struct_type = nullable(df.select(struct.alias("s")).schema["s"].dataType)
    applies = has_value(key, struct_type[field].dataType)
    constants = constants or {}
    if type_field is not None:
        kind = F.col(f"{struct_path}.{type_field}")
        applies = applies & F.coalesce(kind.isin(*types), F.lit(False))
        out = _with_typed_dest(df, mapping, kind, key, "_dest", limits)
        dest = F.col("_dest")
        for name, constant in constants.items():
            dest = F.when(kind == name, F.lit(constant).cast(out.schema["_dest"].dataType)).otherwise(dest)
    else:
        out = _with_dest(df, mapping, key, "_dest", limits)
        dest = F.col("_dest")
    updated = struct.withField(field, dest.cast(struct_type[field].dataType))
    for name, constant in (also or {}).items():
        present = F.col(f"{struct_path}.{name}")
        overwritten = F.when(present.isNotNull(), F.lit(constant).cast(struct_type[name].dataType))
        updated = updated.withField(name, overwritten)
    missed = {
        "drop_struct": F.lit(None).cast(struct_type),
        "null": struct.withField(field, F.lit(None).cast(struct_type[field].dataType)),
        "keep": struct,
    }[on_miss]
    value = F.when(~applies, struct).when(dest.isNull(), missed).otherwise(updated)
    if len(parents) > 1:
        root = F.col(parents[0])
        value = F.when(root.isNotNull(), root.withField(".".join(parents[1:]), value))
    return out.select(*[value.alias(c) if c == parents[0] else F.col(c) for c in df.columns])


def _mapped_elements(df: DataFrame, mapping: DataFrame, col: str, id_of, limits: JoinLimits) -> DataFrame:
    """``df`` plus ``_elements``: the array's items in order, each with its mapped id (or null).

    What an array's ids become depends on those ids alone, so they are looked up once per digest of the ids: rows
    need no key, and equal arrays in a third of all rows are looked up once. The plan is the same at every size.
    """
    ids = F.transform(col, lambda x: id_of(x))
    # Two hashes of the ids and of where nulls stand, which a hash of the ids alone passes over.
    nulls = F.transform(ids, lambda x: x.isNull())
    digests = {"_digest": F.xxhash64(ids, nulls), "_digest2": F.xxhash64(F.lit(1), nulls, ids)}
    keys = list(digests)
    # Rows without items stay where they are.
    has_items = F.coalesce(F.size(col) > 0, F.lit(False))
    full = df.where(has_items).withColumns(digests)
    exploded = full.select(*keys, ids.alias("_ids")).dropDuplicates(keys).select(*keys, F.posexplode("_ids").alias("_pos", "_id"))
    hit = _with_dest(exploded, mapping.where(F.col("source_id").isNotNull()), F.col("_id"), "_dest", limits)
    in_order = F.array_sort(F.collect_list(F.struct("_pos", F.col("_dest").alias("dest"))))
    per_array = settle(hit.groupBy(*keys).agg(F.transform(in_order, lambda e: e["dest"]).alias("_dests")))
    element = F.transform(col, lambda x, i: F.struct(x.alias("item"), F.get("_dests", i).alias("dest")))
    filled = lookup(full, per_array, keys, "left", limits).select(*df.columns, element.alias("_elements"))
    empty = df.where(~has_items).withColumn("_elements", F.lit(None).cast(filled.schema["_elements"].dataType))
    return filled.unionByName(empty)


def remap_array(
    df: DataFrame,
    mapping: DataFrame,
    col: str,
    row_key: Sequence[str],
    distinct: bool = False,
    on_empty: str = "drop",
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Remap an array of ids in order and leave out misses; ``row_key`` is not read, so it may be null or repeat.

    ``distinct`` keeps the first of equal destination ids. When nothing maps, ``on_empty`` either
    drops the list or keeps the source list. A null or empty list stays as it is.
    """
    if on_empty not in ("keep", "drop"):
        raise ValueError(f"unknown on_empty {on_empty!r}")
    out = _mapped_elements(df, mapping, col, lambda x: x, limits)
    kind = nullable(df.schema[col].dataType)
    hits = F.transform(F.filter("_elements", lambda e: e["dest"].isNotNull()), lambda e: e["dest"]).cast(kind)
    if distinct:
        hits = F.array_distinct(hits)
    nothing = F.col(col) if on_empty == "keep" else F.lit(None).cast(kind)
    had_items = F.coalesce(F.size(col) > 0, F.lit(False))
    value = F.when(~had_items, F.col(col)).when(F.size(hits) > 0, hits).otherwise(nothing)
    return out.select(*[value.alias(c) if c == col else F.col(c) for c in df.columns])


def remap_function_refs(
    df: DataFrame,
    mapping: DataFrame,
    col: str,
    row_key: Sequence[str],
    unknown: str = "keep",
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Remap an array of ``{type, id, name}`` references in order.

    ``function`` references get their mapped id or are dropped; ``global`` ones with a name stay;
    anything else is kept or dropped as ``unknown`` says. A null list stays null. ``row_key`` is not read.
    """
    if unknown not in ("keep", "drop"):
        raise ValueError(f"unknown must be 'keep' or 'drop'; got {unknown!r}")
    out = _mapped_elements(df, mapping, col, lambda x: x["id"], limits)
    item_type = nullable(df.schema[col].dataType).elementType
    id_type = item_type["id"].dataType

    def is_function(e: Column) -> Column:
        return F.coalesce(e["item"]["type"] == "function", F.lit(False))

    def is_global(e: Column) -> Column:
        return F.coalesce(e["item"]["type"] == "global", F.lit(False)) & e["item"]["name"].isNotNull()

    def stays(e: Column) -> Column:
        others = ~is_function(e) if unknown == "keep" else is_global(e)
        return (is_function(e) & e["dest"].isNotNull()) | others

    def rewritten(e: Column) -> Column:
        mapped = F.struct(
            *[
                F.lit("function").cast(f.dataType).alias(f.name)
                if f.name == "type"
                else e["dest"].cast(id_type).alias("id")
                if f.name == "id"
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in item_type.fields
            ]
        )
        return F.when(is_function(e), mapped).otherwise(e["item"])

    refs = F.transform(F.filter("_elements", stays), rewritten).cast(nullable(df.schema[col].dataType))
    value = F.when(F.coalesce(F.size(col) > 0, F.lit(False)), refs).otherwise(F.col(col))
    return out.select(*[value.alias(c) if c == col else F.col(c) for c in df.columns])


# Object types whose grants can be carried over, and the skip reasons written to reports.
GRANTABLE_OBJECT_TYPES = ("organization", "project", "experiment", "dataset", "prompt", "group", "role")
USER_MAPPING_DISABLED = "user_acl_mapping_disabled"
UNSUPPORTED_OBJECT_TYPE = "unsupported_object_type"
UNRESOLVED_OBJECT = "unresolved_object_dependency"
UNRESOLVED_USER = "unresolved_user_dependency"
UNRESOLVED_GROUP = "unresolved_group_dependency"
UNRESOLVED_ROLE = "unresolved_role_dependency"


def _with_grant_dests(df: DataFrame, id_map: DataFrame, limits: JoinLimits) -> DataFrame:
    """``df`` plus ``_object, _user, _group, _role``: the mapped ids of a grant.

    Grantees meet the rows of their own kind only, so a kind with few rows is broadcast however large the rest of the map is.
    What has to be shuffled is measured for hot keys in one pass over ``df``, and after all that is not.
    """
    grantees = ("user", "group", "role")
    of_kind = {k: F.coalesce(F.col("resource_type") == k, F.lit(False)) for k in grantees}
    fits = fits_broadcast_each(id_map, [F.lit(True), *of_kind.values()], limits)
    small = dict(zip(("object", *grantees), fits, strict=True))
    kinds = {"object": F.col("object_type"), **{k: F.lit(k) for k in grantees}}
    maps = {"object": id_map, **{k: id_map.where(of_kind[k]) for k in grantees}}
    key_type = id_map.schema["source_id"].dataType
    wide = [k for k in kinds if not small[k]]
    hot = {}
    if wide:
        keys = df.select(*[c.alias(f"{k}_{n}") for k in wide for n, c in (("kind", kinds[k]), ("key", F.col(f"{k}_id").cast(key_type)))])
        hot = dict(zip(wide, hot_keys_each(keys, [[f"{k}_kind", f"{k}_key"] for k in wide], limits), strict=True))
    out = df
    for kind in sorted(kinds, key=lambda k: small[k]):
        out = _with_typed_dest(out, maps[kind], kinds[kind], F.col(f"{kind}_id"), f"_{kind}", limits, small[kind], hot.get(kind))
    return out


def classify_acl(
    df: DataFrame,
    id_map: DataFrame,
    dest_org_id: object,
    map_users: bool = False,
    supported: Sequence[str] = GRANTABLE_OBJECT_TYPES,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Grants with their ids rewritten, and ``skip_reason`` for those that cannot be carried over.

    ``df`` has ``object_type, object_id, user_id, group_id, role_id``; ``id_map`` has
    ``(resource_type, source_id, dest_id)`` with the object type, ``user``, ``group`` or ``role`` as
    resource type. A skipped row keeps its source ids. A mapped user clears the group.
    """
    kinds = {c: df.schema[c].dataType for c in ("object_id", "user_id", "group_id", "role_id")}
    out = _with_grant_dests(df, id_map, limits)
    has_user, has_group, has_role = (is_set(df, f"{k}_id") for k in ("user", "group", "role"))
    dest_object = F.when(
        F.col("object_type") == "organization", F.lit(dest_org_id).cast(kinds["object_id"])
    ).otherwise(F.col("_object").cast(kinds["object_id"]))
    reason = F.lit(None).cast("string")
    for applies, name in reversed(
        [
            (has_user & F.lit(not map_users), USER_MAPPING_DISABLED),
            (~F.coalesce(F.col("object_type").isin(*supported), F.lit(False)), UNSUPPORTED_OBJECT_TYPE),
            (dest_object.isNull(), UNRESOLVED_OBJECT),
            (has_user & F.col("_user").isNull(), UNRESOLVED_USER),
            (~has_user & has_group & F.col("_group").isNull(), UNRESOLVED_GROUP),
            (has_role & F.col("_role").isNull(), UNRESOLVED_ROLE),
        ]
    ):
        reason = F.when(applies, F.lit(name)).otherwise(reason)
    out = out.withColumn("skip_reason", reason)
    passes = F.col("skip_reason").isNull()
    updates = {
        "object_id": F.when(passes, dest_object).otherwise(F.col("object_id")),
        "user_id": F.when(passes & has_user, F.col("_user").cast(kinds["user_id"])).otherwise(F.col("user_id")),
        "group_id": F.when(passes & has_user, F.lit(None).cast(kinds["group_id"]))
        .when(passes & has_group, F.col("_group").cast(kinds["group_id"]))
        .otherwise(F.col("group_id")),
        "role_id": F.when(passes & has_role, F.col("_role").cast(kinds["role_id"])).otherwise(F.col("role_id")),
    }
    return out.select(*[updates.get(c, F.col(c)).alias(c) for c in df.columns], "skip_reason")


_GRANT_COLUMNS = ("object_type", "object_id", "user_id", "group_id", "role_id", "permission", "restrict_object_type")


def _grant_key(*parts: Column) -> Column:
    """A tuple as one key; inside a struct, nulls equal nulls."""
    return F.struct(*[p.cast("string").alias(f"k{i}") for i, p in enumerate(parts)])


def equivalent_after_remap(
    src: DataFrame, dst: DataFrame, id_map: DataFrame, id_col: str = "id", limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Source grants with ``equivalent_id``: the smallest destination id that describes the same grant.

    The same grant has equal object type, mapped object, restriction, grantee (the mapped user if there
    is one, else the mapped group, else nothing matches) and right (the permission if there is one,
    else the mapped role, else any). Destination grants are reduced to one id per key before the join,
    so the result has one row per source grant however many copies exist.
    """
    out = _with_grant_dests(src, id_map, limits)
    by_user, by_group = is_set(src, "user_id"), is_set(src, "group_id")
    by_permission, by_role = is_set(src, "permission"), is_set(src, "role_id")
    src_key = F.when(
        by_user | by_group,
        _grant_key(
            F.col("object_type"),
            F.col("_object"),
            F.col("restrict_object_type"),
            F.when(by_user, F.lit("user")).otherwise(F.lit("group")),
            F.when(by_user, F.col("_user")).otherwise(F.col("_group")),
            F.when(by_permission, F.lit("permission")).when(by_role, F.lit("role")).otherwise(F.lit("any")),
            F.when(by_permission, F.col("permission").cast("string")).when(by_role, F.col("_role").cast("string")),
        ),
    )
    keys = [
        _grant_key(
            F.col("object_type"), F.col("object_id"), F.col("restrict_object_type"),
            F.lit(grantee), F.col(f"{grantee}_id"), F.lit(right), value,
        )
        for grantee in ("user", "group")
        for right, value in (
            ("permission", F.col("permission")),
            ("role", F.col("role_id")),
            ("any", F.lit(None).cast("string")),
        )
    ]
    described = (
        dst.select(F.col(id_col).alias("equivalent_id"), F.explode(F.array(*keys)).alias("_key"))
        .groupBy("_key")
        .agg(F.min("equivalent_id").alias("equivalent_id"))
    )
    # Measured on the grants themselves: each gives at most len(keys) of the rows that are joined.
    each = replace(limits, max_rows=limits.max_rows // len(keys), max_bytes=limits.max_bytes // len(keys))
    small = fits_broadcast(dst.select(id_col, *_GRANT_COLUMNS), each)
    matched = lookup(out.withColumn("_key", src_key), described, ["_key"], "left", limits, small)
    return matched.select(*src.columns, "equivalent_id")
