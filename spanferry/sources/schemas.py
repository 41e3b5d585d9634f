"""The tables this library reads and writes, as Spark DDL.

Free JSON (inputs, outputs, metadata, scores, ...) stays a JSON string. Reading JSON lines with these
schemas keeps such values as the text they were written with.
"""

from __future__ import annotations

_REFS = "ARRAY<STRUCT<type: STRING, id: STRING, name: STRING>>"

EVENTS = """
    id STRING, _pagination_key STRING, _xact_id STRING, created TIMESTAMP,
    project_id STRING, experiment_id STRING, dataset_id STRING,
    span_id STRING, root_span_id STRING, span_parents ARRAY<STRING>, _parent_id STRING,
    input STRING, output STRING, expected STRING, error STRING, metadata STRING, scores STRING, metrics STRING,
    context STRING, span_attributes STRING, tags ARRAY<STRING>,
    origin STRUCT<object_type: STRING, object_id: STRING, id: STRING, _xact_id: STRING, created: TIMESTAMP>,
    _object_delete BOOLEAN, _is_merge BOOLEAN, _merge_paths STRING, _array_delete STRING
"""

OBJECTS: dict[str, str] = {
    "project": "id STRING, name STRING, description STRING, org_id STRING",
    "dataset": "id STRING, name STRING, project_id STRING, description STRING",
    "experiment": """
        id STRING, name STRING, project_id STRING, description STRING, base_exp_id STRING, dataset_id STRING,
        dataset_version STRING, parameters_id STRING, parameters_version STRING, public BOOLEAN, metadata STRING,
        repo_info STRING, created TIMESTAMP
    """,
    "function": """
        id STRING, name STRING, slug STRING, project_id STRING, description STRING, tags ARRAY<STRING>,
        function_type STRING, function_schema STRING,
        function_data STRUCT<type: STRING, code: STRING, data: STRUCT<type: STRING, code: STRING, bundle_id: STRING>>,
        origin STRUCT<object_type: STRING, object_id: STRING, internal: BOOLEAN>
    """,
    "prompt": f"""
        id STRING, name STRING, slug STRING, project_id STRING, description STRING, tags ARRAY<STRING>,
        function_type STRING,
        prompt_data STRUCT<tool_functions: {_REFS}, origin: STRUCT<prompt_id: STRING, project_id: STRING>>
    """,
    "project_score": f"""
        id STRING, name STRING, project_id STRING, score_type STRING, description STRING, created TIMESTAMP,
        config STRUCT<online: STRUCT<sampling_rate: DOUBLE, scorers: {_REFS}>>
    """,
    "project_tag": "id STRING, name STRING, project_id STRING, description STRING, color STRING, created TIMESTAMP",
    "span_iframe": """
        id STRING, name STRING, project_id STRING, url STRING, description STRING, post_message BOOLEAN, created TIMESTAMP
    """,
    "view": "id STRING, name STRING, object_id STRING, object_type STRING, view_type STRING, view_data STRING",
    "role": """
        id STRING, name STRING, org_id STRING, user_id STRING, created TIMESTAMP, description STRING, deleted_at TIMESTAMP,
        member_roles ARRAY<STRING>, member_permissions ARRAY<STRUCT<permission: STRING, restrict_object_type: STRING>>
    """,
    "group": """
        id STRING, name STRING, org_id STRING, user_id STRING, created TIMESTAMP, description STRING, deleted_at TIMESTAMP,
        member_groups ARRAY<STRING>, member_users ARRAY<STRING>
    """,
    "acl": """
        id STRING, object_type STRING, object_id STRING, user_id STRING, group_id STRING, permission STRING,
        role_id STRING, restrict_object_type STRING, object_org_id STRING, created TIMESTAMP
    """,
    "user": "id STRING, email STRING",
}

CONTROL: dict[str, str] = {
    "id_map": "resource_type STRING, source_id STRING, dest_id STRING, prio INT",
    "edges": "src_type STRING, src_id STRING, dep_type STRING, dep_id STRING",
    "results": """
        scope STRING, project STRING, resource_type STRING, source_id STRING, dest_id STRING, name STRING,
        success BOOLEAN, skipped BOOLEAN, skip_reason STRING, error STRING
    """,
    "spilled": "stream STRING, event_id STRING, field STRING, key STRING, payload STRING",
    "quarantine": """
        stream STRING, error STRING, cursor STRING, dest_id STRING, event_id STRING, root_span_id STRING, span_id STRING,
        created TIMESTAMP, approx_size BIGINT, attachment_refs INT, top_level_keys ARRAY<STRING>
    """,
}


def schema_of(kind: str) -> str:
    """Schema of ``events``, of an object kind or of a control table."""
    if kind == "events":
        return EVENTS
    return OBJECTS.get(kind) or CONTROL[kind]
