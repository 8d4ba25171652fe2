"""Access lists, duplicate accounts, paging, batch changes and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators import access, counters, dedupe, dml, paging
from plenum.operators import quality as dq
from plenum.plans.analogues import entity, with_views
from plenum.plans.registry import query
from plenum.sources import versions
from plenum.sources.folders import fresh_folder
from plenum.sources.tables import table

ME, TEAMS = 1, ["team3", "team6"]
_RANK = "CASE role WHEN 'owner' THEN 3 WHEN 'administrator' THEN 2 WHEN 'member' THEN 1 END"
_ROLE = lambda r: f"CASE {r} WHEN 3 THEN 'owner' WHEN 2 THEN 'administrator' WHEN 1 THEN 'member' END"
_FINAL = "status IN ('stopped', 'saved', 'aborted', 'failed_to_start', 'failed_to_stop', 'notification_succeeded', 'external_process_successful', 'external_process_failed')"


@query("e1_my_rooms", with_views("rooms accesses", f"SELECT id, name FROM rooms WHERE id IN (SELECT resource_id FROM accesses WHERE user_id = {ME})"))
def e1(spark, d):
    return access.mine(entity(spark, d, "rooms"), entity(spark, d, "accesses"), "id", F.col("user_id") == ME).select("id", "name")


@query("e2_managed_accesses", with_views("accesses", f"SELECT id, resource_id, user_id, role FROM accesses WHERE resource_id IN (SELECT resource_id FROM accesses WHERE user_id = {ME} AND role IN ('owner', 'administrator'))"))
def e2(spark, d):
    return access.managed(entity(spark, d, "accesses"), F.col("user_id") == ME).select("id", "resource_id", "user_id", "role")


_E3 = f"SELECT r.id, a.id AS access_id FROM recordings r JOIN accesses a ON a.resource_id = r.id WHERE a.user_id = {ME} OR a.team IN ('team3', 'team6')"


@query("e3_recordings_by_access", with_views("recordings accesses", _E3))
def e3(spark, d):
    return access.by_access(entity(spark, d, "recordings"), entity(spark, d, "accesses"), "id", ME, TEAMS).select("id", "access_id")


@query("c2_disjunction", with_views("accesses", f"SELECT id FROM accesses WHERE user_id = {ME} OR team IN ('team3', 'team6')"))
def c2(spark, d):
    return entity(spark, d, "accesses").where((F.col("user_id") == ME) | F.col("team").isin(*TEAMS)).select("id")


@query("e4_left_fetch", with_views("files users", "SELECT f.id, u.full_name AS creator FROM files f LEFT JOIN users u ON u.id = f.creator_id"))
def e4(spark, d):
    users = entity(spark, d, "users").select(F.col("id").alias("_u"), F.col("full_name").alias("creator"))
    files = entity(spark, d, "files")
    return files.join(users, files["creator_id"] == users["_u"], "left").select("id", "creator")


@query("e5_prefetch_children", with_views("rooms accesses", "SELECT r.id, coalesce(string_agg(a.id::VARCHAR, ',' ORDER BY a.id), '') AS accesses, count(a.id) AS n FROM rooms r LEFT JOIN accesses a ON a.resource_id = r.id GROUP BY r.id"))
def e5(spark, d):
    kids = entity(spark, d, "accesses").groupBy(F.col("resource_id").alias("_r")).agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    rooms = entity(spark, d, "rooms")
    out = rooms.join(kids, rooms["id"] == kids["_r"], "left")
    return out.select("id", F.coalesce(F.array_join(F.transform("_ids", lambda x: x.cast("string")), ","), F.lit("")).alias("accesses"), F.greatest(F.size(F.coalesce("_ids", F.array().cast("array<bigint>"))), F.lit(0)).cast("long").alias("n"))


@query("e6_inheritance_join", with_views("rooms recordings", "SELECT r.id, r.name, c.status FROM rooms r JOIN recordings c ON c.id = r.id"))
def e6(spark, d):
    return entity(spark, d, "rooms").select("id", "name").join(entity(spark, d, "recordings").select("id", "status"), "id")


@query("e7_point_lookup", with_views("recordings meeting", "SELECT m.event_id, r.id AS recording_id FROM meeting m JOIN recordings r ON r.worker_id = 'EG_' || m.event_id"))
def e7(spark, d):
    events = entity(spark, d, "meeting").select("event_id", F.concat(F.lit("EG_"), F.col("event_id").cast("string")).alias("worker_id"))
    return events.join(entity(spark, d, "recordings").select("worker_id", F.col("id").alias("recording_id")), "worker_id").select("event_id", "recording_id")


@query("e8_fallback_lookup", with_views("users", """
, wanted AS (SELECT id AS ask, CASE WHEN id % 2 = 0 THEN sub END AS sub, lower(email) AS email FROM users WHERE id % 5 = 0),
by_mail AS (SELECT lower(email) AS email, min(id) AS id, count(*) AS n FROM users WHERE email <> '' GROUP BY 1)
SELECT w.ask, coalesce(s.id, CASE WHEN m.n = 1 THEN m.id END) AS found, s.id IS NULL AND coalesce(m.n, 0) > 1 AS ambiguous
FROM wanted w LEFT JOIN users s ON s.sub = w.sub LEFT JOIN by_mail m ON m.email = w.email"""))
def e8(spark, d):
    users = entity(spark, d, "users")
    wanted = users.where("id % 5 = 0").select(F.col("id").alias("ask"), F.when(F.col("id") % 2 == 0, F.col("sub")).alias("sub"), F.lower("email").alias("email"))
    return dedupe_lookup(wanted, users)

@query("e8_fallback_lookup_all", with_views("users", """
, wanted AS (SELECT id AS ask, CASE WHEN id % 2 = 0 THEN sub END AS sub, lower(email) AS email FROM users),
by_mail AS (SELECT lower(email) AS email, min(id) AS id, count(*) AS n FROM users WHERE email <> '' GROUP BY 1)
SELECT w.ask, coalesce(s.id, CASE WHEN m.n = 1 THEN m.id END) AS found, s.id IS NULL AND coalesce(m.n, 0) > 1 AS ambiguous
FROM wanted w LEFT JOIN users s ON s.sub = w.sub LEFT JOIN by_mail m ON m.email = w.email"""))
def e8_all(spark, d):
    users = entity(spark, d, "users")
    wanted = users.select(F.col("id").alias("ask"), F.when(F.col("id") % 2 == 0, F.col("sub")).alias("sub"), F.lower("email").alias("email"))
    return dedupe_lookup(wanted, users)



def dedupe_lookup(wanted, users):
    """By `sub`, else by e-mail in any case; several of that e-mail are an error."""
    by_sub = users.where("sub IS NOT NULL").select("sub", F.col("id").alias("_s"))
    by_mail = users.where("email <> ''").groupBy(F.lower("email").alias("email")).agg(F.min("id").alias("_m"), F.count("*").alias("_n"))
    out = wanted.join(by_sub, "sub", "left").join(by_mail, "email", "left")
    return out.select("ask", F.coalesce("_s", F.when(F.col("_n") == 1, F.col("_m"))).alias("found"), (F.col("_s").isNull() & (F.coalesce("_n", F.lit(0)) > 1)).alias("ambiguous"))


@query("e9_config_lookup", "SELECT o_orderkey, n_name AS tenant FROM orders JOIN nation ON n_nationkey = o_custkey % 25")
def e9(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("tenant"))  # 25 rows by definition
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("_k"))
    return orders.join(F.broadcast(nation), "_k").select("o_orderkey", "tenant")


@query("e10_dictionary_join", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Ada' WHEN 'assistant' THEN 'Bob' ELSE role END AS name FROM conversations")
def e10(spark, d):
    names = F.create_map(F.lit("user"), F.lit("Ada"), F.lit("assistant"), F.lit("Bob"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.try_element_at(names, F.col("role")), "role").alias("name"))


@query("e13_self_lookup", "SELECT a.event_id, b.event_type AS local_type, c.event_type AS remote_type FROM events a LEFT JOIN events b ON b.event_id = a.event_id * 2 LEFT JOIN events c ON c.event_id = a.event_id * 3")
def e13(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    by = lambda k, name: events.select((F.col("event_id") if k is None else F.col("event_id")).alias(f"_{name}"), F.col("event_type").alias(f"{name}_type"))
    local, remote = by(2, "local"), by(3, "remote")
    return events.join(local, F.col("event_id") * 2 == F.col("_local"), "left").join(remote, F.col("event_id") * 3 == F.col("_remote"), "left").select("event_id", "local_type", "remote_type")


_E14 = ", members AS (SELECT DISTINCT room_id, id FROM (SELECT user_id AS room_id, event_id AS id FROM events)), cached AS (SELECT event_id AS id, event_type FROM events WHERE event_type <> 'error')"


@query("e14_index_join", "WITH one AS (SELECT 1)" + _E14 + " SELECT m.room_id, m.id, c.event_type FROM members m JOIN cached c USING (id)")
def e14(spark, d):
    return dml.index_join(*_index(spark, d))[0]


@query("e14_dangling_ids", "WITH one AS (SELECT 1)" + _E14 + " SELECT m.room_id, m.id FROM members m WHERE id NOT IN (SELECT id FROM cached)")
def e14_dangling(spark, d):
    return dml.index_join(*_index(spark, d))[1]


def _index(spark, d):
    events = table(spark, d, "events")
    return events.select(F.col("user_id").alias("room_id"), F.col("event_id").alias("id")), events.where("event_type <> 'error'").select(F.col("event_id").alias("id"), "event_type")


@query("e15_name_equality", with_views("rooms recordings", "SELECT r.id, c.worker_id FROM rooms r JOIN recordings c ON 'EG_' || r.id = c.worker_id"))
def e15(spark, d):
    rooms = entity(spark, d, "rooms").select("id", F.concat(F.lit("EG_"), F.col("id").cast("string")).alias("worker_id"))
    return rooms.join(entity(spark, d, "recordings").select("worker_id"), "worker_id").select("id", "worker_id")


_E17 = "SELECT day::VARCHAR AS day, bool_or(v.participant IS NULL) AS promote FROM (SELECT DISTINCT day, participant FROM meeting WHERE type = 'speech_start') s LEFT JOIN (SELECT DISTINCT day, participant FROM meeting WHERE type = 'participant_connected') v USING (day, participant) GROUP BY day"


@query("e17_anti_existence", with_views("meeting", _E17))
def e17(spark, d):
    m = entity(spark, d, "meeting")
    said = m.where("type = 'speech_start'").select("day", "participant").distinct()
    seen = m.where("type = 'participant_connected'").select("day", "participant").distinct().withColumn("seen", F.lit(True))
    return said.join(seen, ["day", "participant"], "left").groupBy(F.col("day").cast("string").alias("day")).agg(F.bool_or(F.col("seen").isNull()).alias("promote"))


@query("e18_role_complement", with_views("accesses", "SELECT id FROM accesses WHERE nullif(role, 'member') IS NULL OR role NOT IN ('administrator', 'owner')"))
def e18(spark, d):
    a = entity(spark, d, "accesses").withColumn("role", F.nullif("role", F.lit("member")))
    return a.where(~F.coalesce(F.col("role").isin(*access.MANAGERS), F.lit(False))).select("id")


@query("d10_best_role", with_views("accesses", f"SELECT resource_id, user_id, {_ROLE(f'max({_RANK})')} AS role FROM accesses GROUP BY resource_id, user_id"))
def d10(spark, d):
    return access.best_role(entity(spark, d, "accesses"), ["resource_id", "user_id"])


_ROLED = f", roled AS (SELECT r.id, r.access_level, r.configuration, a.role FROM rooms r LEFT JOIN (SELECT resource_id, {_ROLE(f'max({_RANK})')} AS role FROM accesses WHERE user_id = {ME} GROUP BY 1) a ON a.resource_id = r.id)"


def _roled(spark, d):
    roles = access.best_role(entity(spark, d, "accesses").where(F.col("user_id") == ME), ["resource_id"])
    rooms = entity(spark, d, "rooms")
    return rooms.join(roles, rooms["id"] == roles["resource_id"], "left").select("id", "access_level", "configuration", "role")


@query("c18_room_access", with_views("rooms accesses", _ROLED + " SELECT id, access_level = 'public' OR (access_level = 'trusted' AND id % 2 = 0) OR role IS NOT NULL AS allowed FROM roled"))
def c18(spark, d):
    return _roled(spark, d).select("id", access.can_access_room(F.col("access_level"), F.col("id") % 2 == 0, F.col("role")).alias("allowed"))


@query("c19_lobby_bypass", with_views("rooms accesses", _ROLED + " SELECT id, access_level = 'public' OR (access_level = 'trusted' AND id % 2 = 0) OR (access_level = 'restricted' AND role IS NOT NULL) AS allowed FROM roled"))
def c19(spark, d):
    return _roled(spark, d).select("id", access.skips_lobby(F.col("access_level"), F.col("id") % 2 == 0, F.col("role")).alias("allowed"))


@query("c20_access_by_method", with_views("rooms accesses", _ROLED + " SELECT id, coalesce(role = 'owner', false) AS can_delete, coalesce(role IN ('owner', 'administrator'), false) AS can_write, role IS NOT NULL AS can_read FROM roled"))
def c20(spark, d):
    return _roled(spark, d).select("id", *[access.may(F.lit(m), F.col("role")).alias(f"can_{n}") for m, n in (("DELETE", "delete"), ("PUT", "write"), ("GET", "read"))])


@query("c21_mute_setting", with_views("rooms", "SELECT id, coalesce(configuration::JSON ->> '$.everyone_can_mute' = 'true', true) AS everyone_can_mute FROM rooms"))
def c21(spark, d):
    return entity(spark, d, "rooms").select("id", F.coalesce(F.get_json_object("configuration", "$.everyone_can_mute") == "true", F.lit(True)).alias("everyone_can_mute"))


@query("b9_status_flags", with_views("recordings", f"SELECT id, {_FINAL} AS final, status IN ('aborted', 'failed_to_start', 'failed_to_stop') AS unsuccessful, status IN ('active', 'stopped') AS savable, status IN ('saved', 'notification_succeeded', 'external_process_successful', 'external_process_failed') AS saved FROM recordings"))
def b9(spark, d):
    return entity(spark, d, "recordings").select("id", *[F.col("status").isin(*v).alias(k) for k, v in dml.STATUS.items()])


@query("b10_recording_abilities", with_views("recordings accesses", f", a AS (SELECT resource_id, {_ROLE(f'max({_RANK})')} AS role FROM accesses WHERE user_id = {ME} GROUP BY 1) SELECT id, coalesce(role IN ('owner', 'administrator'), false) AND {_FINAL} AS destroy, coalesce(role IN ('owner', 'administrator'), false) AS retrieve, coalesce(role IN ('owner', 'administrator'), false) AND NOT {_FINAL} AS stop, false AS update FROM recordings r LEFT JOIN a ON a.resource_id = r.id"))
def b10(spark, d):
    roles = access.best_role(entity(spark, d, "accesses").where(F.col("user_id") == ME), ["resource_id"])
    rec = entity(spark, d, "recordings")
    return rec.join(roles, rec["id"] == roles["resource_id"], "left").select("id", access.recording_abilities(F.col("role"), F.col("status").isin(*dml.STATUS["final"])).alias("a")).select("id", "a.*")


@query("b11_access_abilities", with_views("accesses", f"""
, me AS (SELECT resource_id, max({_RANK}) AS mine FROM accesses WHERE user_id = {ME} GROUP BY 1),
o AS (SELECT resource_id, count(*) FILTER (role = 'owner') AS owners FROM accesses GROUP BY 1),
x AS (SELECT a.id, role, CASE WHEN role = 'owner' THEN mine = 3 AND owners > 1 ELSE mine >= 2 END AS change, mine = 3 AS own FROM accesses a JOIN me USING (resource_id) JOIN o USING (resource_id))
SELECT id, change AS destroy, concat_ws(',', CASE WHEN change AND role <> 'administrator' THEN 'administrator' END, CASE WHEN change AND role <> 'member' THEN 'member' END, CASE WHEN change AND own AND role <> 'owner' THEN 'owner' END) AS set_role_to FROM x"""))
def b11(spark, d):
    a = entity(spark, d, "accesses")
    me = access.best_role(a.where(F.col("user_id") == ME), ["resource_id"]).withColumnRenamed("role", "mine")
    owners = a.groupBy("resource_id").agg(F.count_if(F.col("role") == "owner").alias("owners"))
    x = a.join(me, "resource_id").join(owners, "resource_id").select("id", access.access_abilities(F.col("role"), F.col("mine"), F.col("owners")).alias("x"))
    return x.select("id", "x.destroy", F.array_join("x.set_role_to", ",").alias("set_role_to"))


@query("b12_file_abilities", with_views("files", "SELECT id, coalesce(creator_id = 1, false) AND hard_deleted_hour IS NULL AS destroy, coalesce(creator_id = 1, false) AND deleted_hour IS NOT NULL AND hard_deleted_hour IS NULL AS hard_delete, coalesce(creator_id = 1, false) AND deleted_hour IS NULL AS media, coalesce(creator_id = 1, false) AND hard_deleted_hour IS NULL AS retrieve, coalesce(creator_id = 1, false) AND deleted_hour IS NULL AS update FROM files"))
def b12(spark, d):
    return entity(spark, d, "files").select("id", access.file_abilities(F.col("creator_id") == ME, F.col("deleted_hour").isNotNull(), F.col("hard_deleted_hour").isNotNull()).alias("a")).select("id", "a.*")


# Duplicate accounts


@query("d1_duplicate_emails", with_views("users", "SELECT lower(email) AS email, count(id) AS n FROM users WHERE email <> '' GROUP BY 1 HAVING count(id) > 1"))
def d1(spark, d):
    return dedupe.duplicate_emails(entity(spark, d, "users"))


@query("d2_duplicate_emails_raw", with_views("users", "SELECT email, count(*) AS n FROM users GROUP BY 1 HAVING count(*) > 1"))
def d2(spark, d):
    return dedupe.duplicate_emails_raw(entity(spark, d, "users"))


def _moved_sql(pick: str) -> str:
    return f""",
g AS (SELECT lower(email) AS k, {pick}({{'created': created, 'id': id}}).id AS survivor FROM users WHERE email <> '' GROUP BY 1 HAVING count(*) > 1),
moved AS (SELECT u.id AS id_user, u.created, survivor FROM users u JOIN g ON g.k = lower(u.email))"""


def _moved(spark, d):
    users = entity(spark, d, "users")
    return dedupe.survivors(users).join(users.select("id", "created"), "id").withColumnRenamed("id", "id_user")


@query("f1_newest_survivor", with_views("users", _moved_sql("max") + " SELECT id_user AS id, survivor FROM moved"))
def f1(spark, d):
    return dedupe.survivors(entity(spark, d, "users"))


@query("f2_oldest_survivor", with_views("users", _moved_sql("min") + " SELECT id_user AS id, survivor FROM moved"))
def f2(spark, d):
    return dedupe.survivors(entity(spark, d, "users"), newest=False)


@query("f3_first_owner", with_views("accesses", "SELECT resource_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY created_at, id) AS n FROM accesses WHERE role = 'owner') WHERE n = 1"))
def f3(spark, d):
    """Where an id occurs twice at a time, which the SQL leaves open, the smallest user wins, so that reruns agree."""
    return dedupe.first_by(entity(spark, d, "accesses").where("role = 'owner'"), ["resource_id"], ["created_at", "id", "user_id"]).select("resource_id", "user_id")


@query("h1_merge_accesses", with_views("users accesses", _moved_sql("max") + f"""
, j AS (SELECT a.*, m.survivor, m.id_user, m.created FROM accesses a JOIN moved m ON m.id_user = a.user_id)
SELECT resource_id, survivor AS user_id, min({{'stale': id_user <> survivor, 'created': created, 'u': id_user, 'id': id}}).id AS id, {_ROLE(f'max({_RANK})')} AS role FROM j GROUP BY resource_id, survivor
UNION ALL SELECT resource_id, user_id, id, role FROM accesses WHERE user_id NOT IN (SELECT id_user FROM moved)"""))
def h1(spark, d):
    return dedupe.merge_accesses(entity(spark, d, "accesses"), _moved(spark, d))


@query("h2_reassign_creator", with_views("users files", _moved_sql("max") + " SELECT f.id, coalesce(m.survivor, f.creator_id) AS creator_id FROM files f LEFT JOIN moved m ON m.id_user = f.creator_id"))
def h2(spark, d):
    return dedupe.reassign(entity(spark, d, "files"), _moved(spark, d), "creator_id").select("id", "creator_id")


@query("h3_delete_stale", with_views("users", _moved_sql("max") + " SELECT u.id, CASE WHEN m.id_user IS NOT NULL THEN lower(email) ELSE email END AS email FROM users u LEFT JOIN moved m ON m.id_user = u.id WHERE m.id_user IS NULL OR m.id_user = m.survivor"))
def h3(spark, d):
    return dedupe.without_stale(entity(spark, d, "users"), _moved(spark, d)).select("id", "email")


_BROKEN = "role = 'owner' AND team = 'team3'"
_WHOLE = _moved_sql("max") + f""",
bad AS (SELECT DISTINCT survivor FROM moved WHERE id_user IN (SELECT user_id FROM accesses WHERE {_BROKEN})),
whole AS (SELECT * FROM moved WHERE survivor NOT IN (SELECT survivor FROM bad))"""


def _mergeable(spark, d):
    """Groups with a user whose access breaks a rule (an owner by team, here) can't be saved, so they are left as they were."""
    broken = entity(spark, d, "accesses").where(_BROKEN).select(F.col("user_id").alias("id"))
    return dedupe.mergeable(entity(spark, d, "users"), _moved(spark, d), broken)


@query("h3_published_merge", with_views("users accesses files", _WHOLE + f"""
SELECT 'users' AS name, u.id AS id, CASE WHEN m.id_user IS NOT NULL THEN lower(email) ELSE email END AS value FROM users u LEFT JOIN whole m ON m.id_user = u.id WHERE m.id_user IS NULL OR m.id_user = m.survivor
UNION ALL SELECT 'files', f.id, coalesce(m.survivor, f.creator_id)::VARCHAR FROM files f LEFT JOIN whole m ON m.id_user = f.creator_id
UNION ALL SELECT 'accesses', id, survivor || ' ' || role FROM (SELECT survivor, min({{'stale': id_user <> survivor, 'created': whole.created, 'u': id_user, 'id': a.id}}).id AS id, {_ROLE(f'max({_RANK})')} AS role
  FROM accesses a JOIN whole ON id_user = user_id GROUP BY resource_id, survivor)
UNION ALL SELECT 'accesses', id, user_id || ' ' || role FROM accesses WHERE user_id NOT IN (SELECT id_user FROM whole)"""))
def h3_published(spark, d):
    """The tables after the merge, published together and read as of the last version."""
    at = fresh_folder(spark, "accounts")
    versions.publish(spark, at, dedupe.merged_tables(entity(spark, d, "users"), entity(spark, d, "accesses"), entity(spark, d, "files"), _mergeable(spark, d)[0]))
    row = lambda name, value: versions.read(spark, at, name).select(F.lit(name).alias("name"), F.col("id").cast("long").alias("id"), value.alias("value"))
    return row("users", F.col("email")).unionByName(row("files", F.col("creator_id").cast("string"))).unionByName(row("accesses", F.concat_ws(" ", F.col("user_id").cast("string"), "role")))


@query("h3_failed_groups", with_views("users accesses", _WHOLE + " SELECT lower(email) AS email, count(*) AS n FROM moved JOIN bad USING (survivor) JOIN users u ON u.id = id_user GROUP BY 1"))
def h3_failed(spark, d):
    return _mergeable(spark, d)[1]


@query("h4_historic_merge", with_views("users accesses", _moved_sql("min") + f"""
SELECT resource_id, survivor AS user_id, {_ROLE(f'max({_RANK})')} AS role FROM accesses a JOIN moved m ON m.id_user = a.user_id GROUP BY 1, 2"""))
def h4(spark, d):
    users = entity(spark, d, "users")
    moved = dedupe.survivors(users, newest=False).select(F.col("id").alias("_u"), "survivor")
    a = entity(spark, d, "accesses")
    return access.best_role(a.join(moved, a["user_id"] == moved["_u"]).select("resource_id", F.col("survivor").alias("user_id"), "role"), ["resource_id", "user_id"])


@query("d4_dry_run_report", with_views("users accesses files", _moved_sql("max") + """
, stale AS (SELECT id_user FROM moved WHERE id_user <> survivor)
SELECT (SELECT count(*) FROM accesses WHERE user_id IN (SELECT * FROM stale)) AS accesses, (SELECT count(*) FROM accesses WHERE team IS NOT NULL AND user_id IN (SELECT * FROM stale)) AS recording_accesses, (SELECT count(*) FROM files WHERE creator_id IN (SELECT * FROM stale)) AS files"""))
def d4(spark, d):
    stale = _moved(spark, d).where("id_user <> survivor").select(F.col("id_user").alias("_s"))
    a, f = entity(spark, d, "accesses"), entity(spark, d, "files")
    mine = a.join(stale, a["user_id"] == stale["_s"], "left_semi")
    one = mine.agg(F.count("*").alias("accesses"), F.count("team").alias("recording_accesses"))
    return one.join(f.join(stale, f["creator_id"] == stale["_s"], "left_semi").agg(F.count("*").alias("files")))  # one row each


# Sorting and paging


@query("g1_default_order", with_views("rooms", "SELECT id, row_number() OVER (ORDER BY name, id) AS place FROM rooms ORDER BY name, id LIMIT 100"))
def g1(spark, d):
    return paging.top(entity(spark, d, "rooms"), ["name", "id"], 100).select("id", F.col("place").cast("long").alias("place"))


@query("g1_default_order_all", with_views("rooms", "SELECT id, row_number() OVER (ORDER BY name, id) AS place FROM rooms"))
def g1_all(spark, d):
    return paging.places(entity(spark, d, "rooms").select("id", "name"), ["name", "id"]).select("id", "place")


@query("g2_chosen_order", with_views("files", "SELECT id, row_number() OVER (ORDER BY title DESC, id) AS place FROM files ORDER BY title DESC, id LIMIT 20"))
def g2(spark, d):
    return paging.top(entity(spark, d, "files"), paging.ordering("-title,unknown", ("created_hour", "updated_hour", "title"), "-updated_hour"), 20).select("id", F.col("place").cast("long").alias("place"))


@query("g2_chosen_order_all", with_views("files", "SELECT id, row_number() OVER (ORDER BY title DESC, id) AS place FROM files"))
def g2_all(spark, d):
    return paging.places(entity(spark, d, "files").select("id", "title"), paging.ordering("-title,unknown", ("created_hour", "updated_hour", "title"), "-updated_hour")).select("id", "place")


@query("g3_page_with_count", with_views("rooms", "SELECT id, (SELECT count(*) FROM rooms) AS total FROM rooms ORDER BY name, id LIMIT 20 OFFSET 40"))
def g3(spark, d):
    return paging.page(entity(spark, d, "rooms"), ["name", "id"], 3, 20).select("id", "total")


@query("g4_first", with_views("accesses", "SELECT id FROM accesses WHERE role = 'owner' ORDER BY created_at, id LIMIT 1"))
def g4(spark, d):
    return entity(spark, d, "accesses").where("role = 'owner'").orderBy("created_at", "id").limit(1).select("id")


def _waiting(spark, d):
    return entity(spark, d, "meeting").where("type = 'chat_received'").select("event_id", "participant", F.col("ts").cast("string").alias("entered_at"))


@query("g5_waiting_list_desc", with_views("meeting", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM meeting WHERE type = 'chat_received' ORDER BY ts DESC, event_id LIMIT 50"))
def g5(spark, d):
    return paging.top(_waiting(spark, d), [F.col("entered_at").desc(), F.col("event_id").asc()], 50).select("event_id", F.col("place").cast("long").alias("place"))


@query("g5_waiting_list_desc_all", with_views("meeting", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM meeting WHERE type = 'chat_received'"))
def g5_all(spark, d):
    return paging.places(_waiting(spark, d), [F.col("entered_at").desc(), F.col("event_id").asc()]).select("event_id", "place")


@query("g6_waiting_list_asc", with_views("meeting", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM meeting WHERE type = 'chat_received' ORDER BY ts, event_id LIMIT 50"))
def g6(spark, d):
    rows = _waiting(spark, d).withColumn("_at", F.try_to_timestamp("entered_at"))
    return paging.top(rows, ["_at", "event_id"], 50).select("event_id", F.col("place").cast("long").alias("place"))


@query("g6_waiting_list_asc_all", with_views("meeting", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM meeting WHERE type = 'chat_received'"))
def g6_all(spark, d):
    rows = _waiting(spark, d).withColumn("_at", F.try_to_timestamp("entered_at"))
    return paging.places(rows, ["_at", "event_id"]).select("event_id", "place")


@query("g7_invalid_last", with_views("meeting", "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 3 > 0 THEN ts END NULLS LAST, event_id) AS place FROM meeting ORDER BY 2 LIMIT 700"))
def g7(spark, d):
    raw = entity(spark, d, "meeting").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("string")).otherwise("not a time").alias("raised"))
    return paging.top(raw, [F.try_to_timestamp("raised").asc_nulls_last(), F.col("event_id").asc()], 700).select("event_id", F.col("place").cast("long").alias("place"))


@query("g7_invalid_last_all", with_views("meeting", "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 3 > 0 THEN ts END NULLS LAST, event_id) AS place FROM meeting"))
def g7_all(spark, d):
    raw = entity(spark, d, "meeting").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("string")).otherwise("not a time").alias("raised"))
    return paging.places(raw, [F.try_to_timestamp("raised").asc_nulls_last(), F.col("event_id").asc()]).select("event_id", "place")


@query("g8_pinned_first", with_views("users", "SELECT id, row_number() OVER (ORDER BY CASE WHEN id = 42 THEN 0 ELSE 1 END, coalesce(nullif(email, ''), full_name), id) AS place FROM users ORDER BY 2 LIMIT 50"))
def g8(spark, d):
    label = F.coalesce(F.nullif("email", F.lit("")), "full_name")
    return paging.top(entity(spark, d, "users"), [(F.col("id") == 42).desc(), label.asc(), F.col("id").asc()], 50).select("id", F.col("place").cast("long").alias("place"))


@query("g8_pinned_first_all", with_views("users", "SELECT id, row_number() OVER (ORDER BY CASE WHEN id = 42 THEN 0 ELSE 1 END, coalesce(nullif(email, ''), full_name), id) AS place FROM users"))
def g8_all(spark, d):
    label = F.coalesce(F.nullif("email", F.lit("")), "full_name")
    return paging.places(entity(spark, d, "users").select("id", "email", "full_name"), [(F.col("id") == 42).desc(), label.asc(), F.col("id").asc()]).select("id", "place")


@query("g9_two_level_sort", with_views("meeting", "SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY type, event_id) AS place FROM meeting"))
def g9(spark, d):
    rows = entity(spark, d, "meeting").select("day", "type", "event_id")
    return counters.queue(rows, ["day"], ["type", "event_id"]).select("event_id", F.col("position").cast("long").alias("place"))


@query("g10_preference_ladder", with_views("meeting", "SELECT participant, event_id FROM (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY (event_id % 50 = 0) DESC, (event_id % 7 = 0) DESC, coalesce(CASE WHEN event_id % 4 > 0 THEN value END, 0) DESC, event_id) AS n FROM meeting) WHERE n = 1"))
def g10(spark, d):
    bytes_ = F.coalesce(F.when(F.col("event_id") % 4 > 0, F.col("value")), F.lit(0.0))
    best = F.max_by("event_id", F.struct(F.col("event_id") % 50 == 0, F.col("event_id") % 7 == 0, bytes_, -F.col("event_id")))
    return entity(spark, d, "meeting").groupBy("participant").agg(best.alias("event_id"))


@query("g11_top_k_and_more", with_views("meeting", "SELECT participant, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (n <= 3) AS first, greatest(count(*) - 3, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY event_id) AS n FROM meeting) GROUP BY participant"))
def g11(spark, d):
    return paging.top_and_more(entity(spark, d, "meeting"), "participant", "event_id", 3)


@query("g12_last_message", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def g12(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


# Batch changes


@query("h5_bulk_update", with_views("recordings", "SELECT id, CASE WHEN status IN ('active', 'stopped') THEN 'failed_to_stop' ELSE status END AS status, status IN ('active', 'stopped') AS changed FROM recordings"))
def h5(spark, d):
    return dml.bulk_update(entity(spark, d, "recordings"), "status", dml.STATUS["savable"], "failed_to_stop").select("id", "status", "changed")


@query("h6_compare_and_set", with_views("meeting files", "SELECT m.event_id, f.upload_state = 'pending' AND row_number() OVER (PARTITION BY m.participant ORDER BY m.ts, m.event_id) = 1 AS won FROM meeting m JOIN files f ON f.id = m.participant"))
def h6(spark, d):
    calls = entity(spark, d, "meeting").select("event_id", "ts", F.col("participant").alias("id"))
    return dml.compare_and_set(calls, entity(spark, d, "files"), "upload_state", "pending", ["ts", "event_id"]).select("event_id", "won")


@query("h7_get_or_create", with_views("accesses", ", o AS (SELECT resource_id, min(id) AS id, max(role) AS role FROM accesses WHERE id % 3 > 0 GROUP BY 1), n AS (SELECT resource_id, max(role) AS role FROM accesses WHERE id % 2 = 0 GROUP BY 1) SELECT resource_id, coalesce(n.role, o.role) AS role, CASE WHEN o.resource_id IS NULL THEN 'created' WHEN n.role <> o.role THEN 'updated' ELSE 'kept' END AS outcome FROM o FULL JOIN n USING (resource_id)"))
def h7(spark, d):
    a = entity(spark, d, "accesses")
    old = a.where("id % 3 > 0").groupBy("resource_id").agg(F.max("role").alias("role"))
    new = a.where("id % 2 = 0").groupBy("resource_id").agg(F.max("role").alias("role"))
    return dml.get_or_create(old, new, ["resource_id"], "role")


_DELETE = "CASE WHEN hard_deleted_hour IS NOT NULL THEN 'already hard deleted' WHEN deleted_hour IS NULL THEN 'not deleted' WHEN 400 - deleted_hour < 24 THEN 'too recent' END"


@query("h8_delete_transitions", with_views("files", f"SELECT id, deleted_hour IS NULL AS can_soft_delete, {_DELETE} AS reject_reason FROM files"))
def h8(spark, d):
    return dml.deletions(entity(spark, d, "files"), 400, 24)


@query("h9_retention_purge", with_views("files", "SELECT id FROM files WHERE hard_deleted_hour IS NOT NULL OR deleted_hour <= 400 - 168"))
def h9(spark, d):
    return dml.to_purge(entity(spark, d, "files"), F.lit(400), 168).select("id")


@query("h10_stale_uploads", with_views("files", "SELECT id FROM files WHERE upload_state = 'pending' AND created_hour < 300 - 24 AND hard_deleted_hour IS NULL"))
def h10(spark, d):
    return dml.stale_uploads(entity(spark, d, "files"), F.lit(300), 24).select("id")


@query("c12_cleanup_bounds", with_views("files", "SELECT count(*) FILTER (created_hour < 276) AS before, count(*) FILTER (created_hour <= 276) AS until FROM files"))
def c12(spark, d):
    return entity(spark, d, "files").agg(F.count_if(F.col("created_hour") < 276).alias("before"), F.count_if(F.col("created_hour") <= 276).alias("until"))


@query("h11_backfill_codes")
def h11(spark, d):
    return dml.backfill_codes(entity(spark, d, "rooms").select("id", "pin_code"), "id", "pin_code")


@query("h12_cascade_delete", with_views("rooms accesses", "SELECT id FROM accesses WHERE resource_id IN (SELECT id FROM rooms WHERE access_level <> 'public')"))
def h12(spark, d):
    kept = entity(spark, d, "rooms").where("access_level <> 'public'").select(F.col("id").alias("_r"))
    a = entity(spark, d, "accesses")
    return a.join(kept, a["resource_id"] == kept["_r"], "left_semi").select("id")


# Data-quality checks


@query("l1_duplicate_provisional_email", with_views("users", "SELECT lower(email) AS email, count(*) AS n FROM users WHERE sub IS NULL AND email IS NOT NULL GROUP BY 1 HAVING count(*) > 1"))
def l1(spark, d):
    return dq.repeated(entity(spark, d, "users").where("sub IS NULL AND email IS NOT NULL").select(F.lower("email").alias("email")), ["email"])


@query("l2_two_live_recordings", with_views("recordings", "SELECT room_id, count(*) AS n FROM recordings WHERE status IN ('initiated', 'active') GROUP BY 1 HAVING count(*) > 1"))
def l2(spark, d):
    return dq.repeated(entity(spark, d, "recordings").where("status IN ('initiated', 'active')"), ["room_id"])


@query("l3_user_xor_team", with_views("accesses", "SELECT id FROM accesses WHERE (CASE WHEN user_id % 5 > 0 THEN user_id END IS NULL) = (team IS NULL)"))
def l3(spark, d):
    return dq.not_exactly_one(entity(spark, d, "accesses").withColumn("user_id", F.when(F.col("user_id") % 5 > 0, F.col("user_id"))), "user_id", "team").select("id")


@query("l4_duplicate_pairs", with_views("accesses", "SELECT resource_id, user_id, count(*) AS n FROM accesses GROUP BY 1, 2 HAVING count(*) > 1"))
def l4(spark, d):
    return dq.repeated(entity(spark, d, "accesses"), ["resource_id", "user_id"])


@query("l5_without_owner", with_views("rooms accesses", "SELECT id FROM rooms WHERE id NOT IN (SELECT resource_id FROM accesses WHERE role = 'owner')"))
def l5(spark, d):
    return dq.missing(entity(spark, d, "rooms").select("id"), entity(spark, d, "accesses").where("role = 'owner'").select("resource_id"), "id", "resource_id")


@query("l6_orphans", with_views("files users", "SELECT id FROM files WHERE creator_id IS NOT NULL AND creator_id NOT IN (SELECT id FROM users)"))
def l6(spark, d):
    files = entity(spark, d, "files").where("creator_id IS NOT NULL")
    return dq.missing(files, entity(spark, d, "users").select(F.col("id").alias("_u")), "creator_id", "_u").select("id")


@query("l7_enum_violations", with_views("recordings", "SELECT id, status FROM recordings WHERE status NOT IN ('initiated', 'active', 'stopped', 'saved')"))
def l7(spark, d):
    return dq.outside(entity(spark, d, "recordings"), "status", ["initiated", "active", "stopped", "saved"]).select("id", "status")


@query("l8_duplicate_config", "SELECT count(*) <> count(DISTINCT n_nationkey) AS ids_repeat, count(*) <> count(DISTINCT n_regionkey) AS keys_repeat FROM nation")
def l8(spark, d):
    return table(spark, d, "nation").agg((F.count("*") != F.countDistinct("n_nationkey")).alias("ids_repeat"), (F.count("*") != F.countDistinct("n_regionkey")).alias("keys_repeat"))
