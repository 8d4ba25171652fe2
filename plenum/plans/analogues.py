"""Meeting entities over the given tables: each as a DataFrame and as a DuckDB common table expression of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.sources.tables import table

# (table, SELECT list in SQL that Spark and DuckDB read alike)
_VIEWS = {
    "users": ("customer", "c_custkey AS id, c_name AS full_name, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE concat(CASE WHEN c_custkey % 2 = 0 THEN 'User' ELSE 'user' END, c_nationkey, '@', CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END) END AS email, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('s', c_custkey) END AS sub, c_nationkey AS nation, c_acctbal AS created, CASE c_nationkey % 4 WHEN 0 THEN 'en-us' WHEN 1 THEN 'fr-fr' WHEN 2 THEN 'DE-de' ELSE 'nl' END AS language"),
    "rooms": ("orders", "o_orderkey AS id, concat('Room ', o_orderkey % 1000) AS name, o_custkey AS owner_id, CASE o_orderstatus WHEN 'F' THEN 'public' WHEN 'O' THEN 'trusted' ELSE 'restricted' END AS access_level, o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN '{}' WHEN o_orderkey % 4 = 1 THEN '{\"everyone_can_mute\": false}' ELSE '{\"everyone_can_mute\": true, \"can_publish_sources\": [\"camera\", \"microphone\"]}' END AS configuration, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('', o_orderkey) END AS pin_code"),
    "accesses": ("lineitem", "l_orderkey * 10 + l_linenumber AS id, l_orderkey AS resource_id, l_suppkey AS user_id, CASE l_returnflag WHEN 'A' THEN 'owner' WHEN 'R' THEN 'administrator' ELSE 'member' END AS role, l_shipdate AS created_at, CASE WHEN l_partkey % 3 = 0 THEN concat('team', l_partkey % 10) ELSE NULL END AS team"),
    "recordings": ("orders", "o_orderkey AS id, o_custkey AS room_id, CASE o_orderkey % 10 WHEN 0 THEN 'initiated' WHEN 1 THEN 'active' WHEN 2 THEN 'stopped' WHEN 3 THEN 'saved' WHEN 4 THEN 'aborted' WHEN 5 THEN 'failed_to_start' WHEN 6 THEN 'failed_to_stop' WHEN 7 THEN 'notification_succeeded' WHEN 8 THEN 'external_process_successful' ELSE 'external_process_failed' END AS status, CASE WHEN o_orderpriority LIKE '1%' THEN 'transcript' ELSE 'screen_recording' END AS mode, concat('EG_', o_orderkey) AS worker_id, o_orderdate AS created_at, o_totalprice AS price"),
    "files": ("documents", "doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'background_image' ELSE 'attachment' END AS type, CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('Title ', doc_id % 97) END AS title, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 50 END AS creator_id, CASE doc_id % 5 WHEN 0 THEN concat('.', source) WHEN 1 THEN concat(source, '.tar.gz') WHEN 2 THEN concat('a.b/', source) ELSE concat('dir/', source, '.PNG') END AS filename, CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'analyzing' ELSE 'ready' END AS upload_state, n_chars AS size, CASE WHEN doc_id % 5 = 0 THEN doc_id % 400 ELSE NULL END AS deleted_hour, CASE WHEN doc_id % 20 = 0 THEN doc_id % 400 ELSE NULL END AS hard_deleted_hour, doc_id % 300 AS created_hour, (doc_id * 7) % 311 AS updated_hour"),
    "meeting": ("events", "event_id, CAST(ts AS DATE) AS day, user_id AS participant, CASE event_type WHEN 'view' THEN 'speech_start' WHEN 'click' THEN 'speech_end' WHEN 'signup' THEN 'participant_connected' WHEN 'error' THEN 'participant_disconnected' ELSE 'chat_received' END AS type, (CAST(extract(hour FROM ts) AS BIGINT) * 3600 + CAST(extract(minute FROM ts) AS BIGINT) * 60) * 1000 + CAST(floor(extract(second FROM ts)) AS BIGINT) * 1000 AS ms, ts, value, props"),
}


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = _VIEWS[name]
    view = table(spark, sf_dir, source)
    written = columns.replace("{", "{{").replace("}", "}}")
    return spark.sql(f"SELECT {written} FROM {{view}}", view=view)


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: `body` (which may begin with further ", x AS (...)" expressions and SELECT) after the named entities."""
    ctes = ",\n".join(f"{n} AS (SELECT {_VIEWS[n][1]} FROM {_VIEWS[n][0]})" for n in names.split())
    return f"WITH {ctes}{body if body.lstrip().startswith(',') else chr(10) + body}"


def recursive(names: str, body: str) -> str:
    """As `with_views`, for a body that walks its rows one by one."""
    return with_views(names, body).replace("WITH ", "WITH RECURSIVE ", 1)
