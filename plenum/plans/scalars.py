"""Derived fields, predicates, text, JSON and array functions over the given tables, one query for each function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions import fields, json_ops, text
from plenum.operators import similarity
from plenum.plans.analogues import _VIEWS, entity, with_views
from plenum.plans.registry import query
from plenum.sources.tables import table


def _source(name: str):
    return (lambda spark, d: entity(spark, d, name)) if name in _VIEWS else (lambda spark, d: table(spark, d, name))


def _sql(source: str, body: str) -> str:
    return with_views(source, body) if source in _VIEWS else body


def project(name: str, source: str, key: str, columns: dict[str, tuple[Column, str]]) -> None:
    """Register a query of `key` and computed columns, each a Spark expression and its SQL twin (None: no twin)."""
    build = {alias: c for alias, (c, _) in columns.items()}
    exprs = ", ".join(f"{s} AS {alias}" for alias, (_, s) in columns.items())
    sql = None if any(s is None for _, s in columns.values()) else _sql(source, f"SELECT {key}, {exprs} FROM {source}")
    query(name, sql)(lambda spark, d: _source(source)(spark, d).select(*key.split(", "), *[c().alias(a) for a, c in build.items()]))


def keep(name: str, source: str, key: str, condition, sql: str) -> None:
    """Register a query of the keys of the rows that meet a condition."""
    query(name, _sql(source, f"SELECT {key} FROM {source} WHERE {sql}"))(lambda spark, d: _source(source)(spark, d).where(condition()).select(*key.split(", ")))


c = F.col
_EXT = "nullif(regexp_extract(filename, '[^./]\\.([^./]+)$', 1), '')"
_BASE = "regexp_replace(string_split(filename, '/')[-1], '([^.])\\.[^.]+$', '\\1')"

# Projections and derived columns
project("b1_projection", "users", "id", {"full_name": (lambda: c("full_name"), "full_name"), "language": (lambda: c("language"), "language")})
query("b4_key_only", with_views("rooms", "SELECT id FROM rooms"))(lambda s, d: entity(s, d, "rooms").select("id"))
query("b5_flat_list", with_views("accesses", "SELECT role FROM accesses WHERE user_id = 1"))(lambda s, d: entity(s, d, "accesses").where("user_id = 1").select("role"))
project("b6_storage_key", "recordings", "id", {"key": (lambda: fields.storage_key("recordings", c("id"), c("mode")), "'recordings/' || id || '.' || CASE WHEN mode = 'transcript' THEN 'ogg' ELSE 'mp4' END")})
project("b7_extension", "files", "id", {"extension": (lambda: fields.extension(c("filename")), _EXT)})
project("b8_expiry", "files", "id", {"expired_at": (lambda: fields.expires(c("created_hour"), 72), "created_hour + 72"), "never": (lambda: fields.expires(c("created_hour"), None).cast("long"), "NULL::BIGINT"), "is_expired": (lambda: fields.expires(c("created_hour"), 72) < 200, "created_hour + 72 < 200")})
project("b13_local_labels", "events", "event_id", {"day": (lambda: text.local_time(c("ts").cast("timestamp"), "Europe/Paris", "yyyy-MM-dd"), "strftime(timezone('Europe/Paris', timezone('UTC', ts)), '%Y-%m-%d')"), "time": (lambda: text.local_time(c("ts").cast("timestamp"), "Europe/Paris", "HH:mm"), "strftime(timezone('Europe/Paris', timezone('UTC', ts)), '%H:%M')")})
project("b14_default_title", "files", "id", {"title": (lambda: fields.default_title(c("title"), c("filename")), f"coalesce(nullif(title, ''), {_BASE})")})
project("b15_default_fill", "users", "id", {"level": (lambda: F.coalesce(F.nullif(c("email"), F.lit("")), c("sub"), F.lit("public")), "coalesce(nullif(email, ''), sub, 'public')")})
project("b16_mime", "files", "id", {"mime": (lambda: fields.mime_type(F.when(c("id") % 3 == 0, "application/octet-stream").when(c("id") % 3 == 1, "text/plain"), F.when(F.lower(fields.extension(c("filename"))) == "png", "image/png")), f"CASE WHEN id % 3 = 1 THEN 'text/plain' WHEN lower({_EXT}) = 'png' THEN 'image/png' ELSE 'application/octet-stream' END")})
project("b18_changed_fields", "rooms", "id", {"changed": (lambda: F.array_join(fields.changed([("name", c("name"), F.when(c("id") % 2 == 0, c("name"))), ("pin", c("pin_code"), F.when(c("id") % 3 > 0, c("pin_code")))]), ","), "concat_ws(',', CASE WHEN name IS DISTINCT FROM CASE WHEN id % 2 = 0 THEN name END THEN 'name' END, CASE WHEN pin_code IS DISTINCT FROM CASE WHEN id % 3 > 0 THEN pin_code END THEN 'pin' END)")})
project("b19_latency", "events", "event_id", {"latency": (lambda: text.round_half_even((c("event_id") * 125).cast("double") / 1000), "round_even((event_id * 125)::DOUBLE / 1000, 2)")})


@query("b2_nested_struct", with_views("recordings users", "SELECT r.id, to_json({'id': u.id, 'name': u.full_name})::VARCHAR AS room FROM recordings r JOIN users u ON u.id = r.room_id"))
def b2(spark, d):
    users = entity(spark, d, "users").select(c("id").alias("room_id"), F.struct("id", c("full_name").alias("name")).alias("room"))
    return entity(spark, d, "recordings").join(users, "room_id").select("id", F.to_json("room").alias("room"))


@query("b3_conditional_nested_list", with_views("rooms accesses", "SELECT r.id, CASE WHEN bool_or(a.user_id = 1 AND a.role IN ('owner', 'administrator')) THEN string_agg(a.id::VARCHAR, ',' ORDER BY a.id) END AS accesses, CASE WHEN access_level = 'public' OR bool_or(a.user_id = 1) THEN any_value(pin_code) END AS pin_code FROM rooms r JOIN accesses a ON a.resource_id = r.id GROUP BY r.id, access_level"))
def b3(spark, d):
    kids = entity(spark, d, "accesses").groupBy(c("resource_id").alias("id")).agg(F.array_sort(F.collect_list(c("id"))).alias("ids"), F.bool_or((c("user_id") == 1) & c("role").isin("owner", "administrator")).alias("admin"), F.bool_or(c("user_id") == 1).alias("mine"))
    rooms = entity(spark, d, "rooms").join(kids, "id")
    listed = F.when(c("admin"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))
    return rooms.select("id", listed.alias("accesses"), F.when((c("access_level") == "public") | c("mine"), c("pin_code")).alias("pin_code"))


@query("b17_identity_color")
def b17(spark, d):
    users = entity(spark, d, "users").select("id", fields.color_seed(c("id").cast("string")).alias("seed"))
    return users.join(F.broadcast(fields.color_table(spark)), "seed").select("id", "color")  # 65,536 rows


@query("b20_session_duration", with_views("meeting", "SELECT participant, day::VARCHAR AS day, coalesce(max(ms) FILTER (type = 'participant_disconnected') - min(ms) FILTER (type = 'participant_connected'), -1) AS duration FROM meeting GROUP BY participant, day"))
def b20(spark, d):
    at = lambda f, kind: f(F.when(c("type") == kind, c("ms")))
    return entity(spark, d, "meeting").groupBy("participant", c("day").cast("string").alias("day")).agg(F.coalesce(at(F.max, "participant_disconnected") - at(F.min, "participant_connected"), F.lit(-1)).alias("duration"))


# Filters and predicates
keep("c1_conjunction", "accesses", "id", lambda: (c("role") == "owner") & (c("user_id") == 1), "role = 'owner' AND user_id = 1")
keep("c3_in_list", "recordings", "id", lambda: c("status").isin("active", "stopped"), "status IN ('active', 'stopped')")
keep("c4_not_in_list", "recordings", "id", lambda: ~c("status").isin("active", "stopped"), "status NOT IN ('active', 'stopped')")
keep("c5_null_test", "files", "id", lambda: c("deleted_hour").isNotNull(), "deleted_hour IS NOT NULL")
keep("c6_exclude_me", "files", "id", lambda: ~c("creator_id").eqNullSafe(F.lit(1)), "creator_id IS DISTINCT FROM 1")
keep("c7_non_empty", "users", "id", lambda: c("email").isNotNull() & (c("email") != ""), "email IS NOT NULL AND email <> ''")
keep("c8_iexact", "users", "id", lambda: fields.iexact(c("email"), F.lit("USER3@building")), "lower(email) = 'user3@building'")
keep("c9_icontains", "users", "id", lambda: fields.icontains(c("email"), "@Mach"), "contains(lower(email), '@mach')")
keep("c10_search_tokens", "users", "id", lambda: fields.search(["user1", "BUILD"], c("id"), c("email"), c("full_name")), "(id::VARCHAR = 'user1' OR coalesce(contains(lower(email), 'user1'), false) OR contains(lower(full_name), 'user1')) AND (id::VARCHAR = 'BUILD' OR coalesce(contains(lower(email), 'build'), false) OR contains(lower(full_name), 'build'))")
keep("c13_regex_search", "rooms", "id", lambda: fields.name_matches(c("name"), "m 1[0-5]+$"), "regexp_matches(name, 'm 1[0-5]+$')")
keep("c13_invalid_pattern", "rooms", "id", lambda: fields.name_matches(c("name"), "(["), "true")
keep("c14_prefix", "rooms", "id", lambda: ~F.startswith(c("name"), F.lit("Room 1")), "NOT starts_with(name, 'Room 1')")
keep("c15_known_types", "meeting", "event_id", lambda: c("type").isin("speech_start", "speech_end"), "type IN ('speech_start', 'speech_end')")
keep("c17_key_switch", "rooms", "id", lambda: fields.is_key(F.when(c("id") % 2 == 0, "64").otherwise("ROOM 33"), c("id"), F.lower("name")), "CASE WHEN id % 2 = 0 THEN id::VARCHAR = '64' ELSE lower(name) = 'room 33' END")
keep("c22_scope", "users", "id", lambda: F.array_contains(json_ops.split_scopes(F.concat_ws(" ", F.lit("app:ROOMS"), c("language"), F.lit("app:rooms")), "app:"), "en-us"), "language = 'en-us'")
keep("c25_printable", "users", "id", lambda: fields.printable(c("full_name"), 18), "regexp_matches(full_name, '^[ -~]*$') AND length(full_name) <= 18")
keep("c27_any_set", "users", "id", lambda: fields.any_set(c("email"), c("sub")), "(email IS NOT NULL AND email <> '') OR sub IS NOT NULL")
project("c28_forbidden_fields", "users", "id", {"names": (lambda: F.array_join(fields.set_fields([("email", c("email")), ("sub", c("sub"))]), ","), "concat_ws(',', CASE WHEN email IS NOT NULL THEN 'email' END, CASE WHEN sub IS NOT NULL THEN 'sub' END)")})
keep("c29_exception_filter", "events", "event_id", lambda: ~fields.denied_exception(F.when(c("event_type") == "error", "exception").otherwise(c("event_type")), F.array(c("props")), c("event_type"), [r'"k": 1\d']), "NOT (event_type = 'error' AND regexp_matches(props, '\"k\": 1\\d'))")
keep("c30_two_field_deny", "events", "event_id", lambda: ~(F.coalesce(c("event_type") == "error", F.lit(False)) & F.coalesce(F.nullif(c("user_id"), F.lit(3)).isin(1, 2, 3), F.lit(False))), "NOT (event_type = 'error' AND coalesce(nullif(user_id, 3) IN (1, 2, 3), false))")
project("c31_gate_chain", "rooms", "id", {"reason": (lambda: fields.first_failing(("not requested", c("id") % 2 == 0), ("disabled", c("access_level") != "restricted"), ("tenant", c("owner_id") % 3 == 0)), "CASE WHEN id % 2 <> 0 THEN 'not requested' WHEN access_level = 'restricted' THEN 'disabled' WHEN owner_id % 3 <> 0 THEN 'tenant' ELSE 'ok' END")})
project("c26_role_rules", "accesses", "id", {"reason": (lambda: fields.role_change(c("role"), F.when(c("id") % 2 == 0, "owner").otherwise("member"), c("id") % 5 == 0, F.when(c("id") % 3 == 0, "owner").otherwise("administrator")), "CASE WHEN id % 5 = 0 THEN 'self' WHEN role = 'member' THEN 'not allowed' WHEN id % 3 = 0 THEN 'owner is not granted' WHEN id % 2 = 0 THEN 'owner is not demoted' END")})
project("c16_path_capture", "pages", "page_id", {"host": (lambda: F.regexp_extract("url", r"^https?://([^/?#]+)", 1), "regexp_extract(url, '^https?://([^/?#]+)', 1)"), "allowed": (lambda: F.rlike(text.url_path(c("url")), F.lit("/[a-z0-9-]+/[0-9]+")), "regexp_matches(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/[a-z0-9-]+/[0-9]+')")})


@query("c11_similar_emails")
def c11(spark, d):
    return fields.similar(entity(spark, d, "users").select("id", "email"), "email", "building").select("id", F.round("similarity", 6).alias("similarity"))


@query("c11_similar_pairs")
def c11_pairs(spark, d):
    """A table of search words against all users: segments, and the first part of each nation's addresses."""
    words = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("word")).union(table(spark, d, "nation").select(F.concat(F.lit("user"), c("n_nationkey").cast("string"))))
    found = similarity.similar_pairs(entity(spark, d, "users").select("id", "email"), "id", "email", words, "word")
    return found.select("word", "id", F.round("similarity", 6).alias("similarity"))


@query("c23_domain_allow_list", with_views("users rooms", ", g AS (SELECT owner_id % 10 AS app, string_agg(DISTINCT 'x' || owner_id % 3) AS x, bool_or(owner_id % 3 = 1) AS hit FROM rooms WHERE owner_id % 10 < 5 GROUP BY 1) SELECT u.id, coalesce(g.hit, true) AS allowed FROM users u LEFT JOIN g ON g.app = u.id % 10"))
def c23(spark, d):
    lists = entity(spark, d, "rooms").where("owner_id % 10 < 5").groupBy((c("owner_id") % 10).alias("app")).agg(F.bool_or(c("owner_id") % 3 == 1).alias("hit"))
    users = entity(spark, d, "users").withColumn("app", c("id") % 10)
    return users.join(lists, "app", "left").select("id", F.coalesce("hit", F.lit(True)).alias("allowed"))


@query("c24_quota", with_views("files", ", g AS (SELECT creator_id, type, count(*) AS n FROM files WHERE deleted_hour IS NULL GROUP BY ALL) SELECT f.id, CASE WHEN g.n >= 3 THEN 'too many' WHEN f.size > 3000 THEN 'too large' END AS reason FROM files f LEFT JOIN g ON g.creator_id IS NOT DISTINCT FROM f.creator_id AND g.type = f.type"))
def c24(spark, d):
    files = entity(spark, d, "files")
    n = files.where("deleted_hour IS NULL").groupBy(c("creator_id").alias("_c"), c("type").alias("_t")).agg(F.count("*").alias("n"))
    both = files.join(n, files["creator_id"].eqNullSafe(n["_c"]) & (files["type"] == n["_t"]), "left")
    return both.select("id", F.when(c("n") >= 3, "too many").when(c("size") > 3000, "too large").alias("reason"))


# Aggregates
query("d3_count", with_views("rooms", "SELECT count(*) AS n FROM rooms"))(lambda s, d: entity(s, d, "rooms").agg(F.count("*").alias("n")))
query("d5_exists", with_views("rooms recordings", "SELECT id FROM rooms r WHERE EXISTS (SELECT 1 FROM recordings c WHERE c.room_id = r.id)"))(lambda s, d: entity(s, d, "rooms").select("id").join(entity(s, d, "recordings").select(c("room_id").alias("id")), "id", "left_semi"))
query("d6_distinct", with_views("accesses", "SELECT DISTINCT resource_id, role FROM accesses"))(lambda s, d: entity(s, d, "accesses").select("resource_id", "role").distinct())


@query("d7_distribution", "SELECT conv_id, role, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY conv_id), 2) AS percent FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)")
def d7(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    all_ = n.groupBy("conv_id").agg(F.sum("n").alias("all"))
    return n.join(all_, "conv_id").select("conv_id", "role", F.bround(F.lit(100.0) * c("n") / c("all"), 2).alias("percent"))


@query("d8_transcript_counts", "SELECT conv_id, count(DISTINCT role) AS speakers, count(*) AS segments, sum(length(text))::BIGINT AS text_length, sum(length(text)) = 0 AS is_empty FROM conversations GROUP BY conv_id")
def d8(spark, d):
    size = F.sum(F.length("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("speakers"), F.count("*").alias("segments"), size.alias("text_length"), (size == 0).alias("is_empty"))


@query("d9_max_derived", with_views("meeting", "SELECT participant, max(ms + coalesce(CASE WHEN event_id % 3 > 0 THEN event_id END, 0)) AS duration FROM meeting GROUP BY participant"))
def d9(spark, d):
    return entity(spark, d, "meeting").groupBy("participant").agg(F.max(c("ms") + F.coalesce(F.when(c("event_id") % 3 > 0, c("event_id")), F.lit(0))).alias("duration"))


@query("d11_owner_label", with_views("accesses", "SELECT resource_id, CASE count(*) FILTER (role = 'owner') WHEN 0 THEN 'No owner' WHEN 1 THEN max(CASE WHEN role = 'owner' THEN 'u' || user_id END) ELSE 'Multiple owners' END AS owner FROM accesses GROUP BY resource_id"))
def d11(spark, d):
    n = F.count_if(c("role") == "owner")
    name = F.max(F.when(c("role") == "owner", F.concat(F.lit("u"), c("user_id").cast("string"))))
    return entity(spark, d, "accesses").groupBy("resource_id").agg(F.when(n == 0, "No owner").when(n == 1, name).otherwise("Multiple owners").alias("owner"))


@query("d12_min_parsable", with_views("meeting", "SELECT participant, min(CASE WHEN event_id % 4 > 0 THEN epoch_us(ts) END) AS first FROM meeting GROUP BY participant"))
def d12(spark, d):
    raw = F.when(c("event_id") % 4 > 0, c("ts").cast("string")).otherwise("??")
    return entity(spark, d, "meeting").groupBy("participant").agg(F.unix_micros(F.min(F.try_to_timestamp(raw))).alias("first"))


@query("d13_report_totals", with_views("meeting", "SELECT participant, round(sum(value), 6) AS up, round(sum(value / 2), 6) AS down, max(value) AS jitter, arg_max(value, event_id) AS rtt FROM meeting GROUP BY participant"))
def d13(spark, d):
    from plenum.operators.counters import report_totals

    rows = entity(spark, d, "meeting").select("participant", c("value").alias("up"), (c("value") / 2).alias("down"), c("value").alias("jitter"), c("value").alias("rtt"), c("event_id").alias("seq"))
    return report_totals(rows, ["participant"]).withColumns({"up": F.round("up", 6), "down": F.round("down", 6)})


query("d14_sum", "SELECT round(sum(value), 4) AS total FROM events")(lambda s, d: table(s, d, "events").agg(F.round(F.sum("value"), 4).alias("total")))
query("d15_sorted_set", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")(lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")))
query("d16_counts_by_kind", "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, bool_or(event_type = 'error') AS any_error FROM events GROUP BY user_id")(lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count_if(c("event_type") == "view").alias("views"), F.count_if(c("event_type") == "click").alias("clicks"), F.bool_or(c("event_type") == "error").alias("any_error")))
query("d17_outcome_tally", with_views("recordings", "SELECT CASE WHEN status IN ('active', 'stopped') THEN 'processed' WHEN status = 'aborted' THEN 'failed' ELSE 'skipped' END AS outcome, count(*) AS n FROM recordings GROUP BY 1"))(lambda s, d: entity(s, d, "recordings").groupBy(F.when(c("status").isin("active", "stopped"), "processed").when(c("status") == "aborted", "failed").otherwise("skipped").alias("outcome")).agg(F.count("*").alias("n")))
query("d19_group_text", "SELECT conv_id, string_agg('- [ ] ' || role, chr(10) ORDER BY turn) AS checklist FROM conversations GROUP BY conv_id")(lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(F.lit("- [ ] "), x["role"])), "\n").alias("checklist")))


@query("d20_list_flags", "SELECT user_id, bool_or(event_type = 'view') AS has_view, bool_or(event_type = 'error') AS has_error, arg_min(event_id, event_id) FILTER (event_type = 'click') AS first_click FROM events GROUP BY user_id")
def d20(spark, d):
    kind = c("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(kind == "view").alias("has_view"), F.bool_or(kind == "error").alias("has_error"), F.min(F.when(kind == "click", c("event_id"))).alias("first_click"))


@query("d21_every_some", "SELECT user_id, bool_and(value > 1) AS every_above, bool_or(event_type = 'view') AND bool_or(event_type = 'click') AS all_kinds FROM events GROUP BY user_id")
def d21(spark, d):
    has = lambda kind: F.bool_or(c("event_type") == kind)
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_and(c("value") > 1).alias("every_above"), (has("view") & has("click")).alias("all_kinds"))


# Text, dates and numbers
_STRIP = "regexp_replace(lower(chr(9) || email || '  '), '^\\s+|\\s+$', '', 'g')"
project("j1_lower_strip", "users", "id", {"x": (lambda: text.lower_strip(F.concat(F.lit("\t"), c("email"), F.lit("  "))), _STRIP)})
query("j2_lower_key", with_views("users", "SELECT lower(email) AS k, count(*) AS n FROM users GROUP BY 1"))(lambda s, d: entity(s, d, "users").groupBy(F.lower("email").alias("k")).agg(F.count("*").alias("n")))
project("j3_has_upper", "users", "id", {"x": (lambda: text.has_upper(c("email")), "email <> lower(email)")})
project("j4_slugify", "users", "id", {"x": (lambda: text.slugify(F.concat_ws(" ", c("full_name"), F.lit("Été_à  l'Œuvre!"), c("language"))), "trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(concat_ws(' ', full_name, 'Été_à  l''Œuvre!', language)), '[^\\x00-\\x7F]', '', 'g')), '[^\\w\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-_')")})
project("j5_uuid_shape", "users", "id", {"x": (lambda: text.is_uuid(F.when(c("id") % 2 == 0, F.concat(F.lpad(c("id").cast("string"), 8, "0"), F.lit("-0000-4000-8000-00000000000A"))).otherwise(c("full_name"))), "id % 2 = 0")})
project("j6_capitalize_first", "users", "id", {"x": (lambda: text.capitalize_first(c("language")), "upper(language[1]) || language[2:]")})
project("j7_zero_pad", "users", "id", {"x": (lambda: text.zero_pad(c("id").cast("string"), 4), "CASE WHEN length(id::VARCHAR) >= 4 THEN id::VARCHAR ELSE lpad(id::VARCHAR, 4, '0') END")})
project("j8_replace_list", "conversations", "conv_id, turn", {"x": (lambda: text.replace_all(F.substring("text", 1, 80), [("the", "THE"), (".", ""), ("an", "[an]")]), "replace(replace(replace(substr(text, 1, 80), 'the', 'THE'), '.', ''), 'an', '[an]')")})
_REPLACED = [("the", "THE"), (".", ""), ("an", "[an]")]
project("j8_replace_list_whole", "conversations", "conv_id, turn", {"x": (lambda: text.replace_all(c("text"), _REPLACED), "replace(replace(replace(text, 'the', 'THE'), '.', ''), 'an', '[an]')")})
project("j9_template", "rooms", "id", {"x": (lambda: F.format_string("Meeting %s (%d)", "name", "id"), "'Meeting ' || name || ' (' || id || ')'")})
project("j10_clean_url", "pages", "page_id", {"x": (lambda: text.clean_url(c("url")), "regexp_replace(url, '[?#].*$', '')")})
project("j11_redact_query", "pages", "page_id", {"x": (lambda: text.redact_query(c("url")), "string_split(url, '?')[1]")})
project("j12_path_suffix", "pages", "page_id", {"x": (lambda: text.path_suffix(F.concat(text.clean_url(c("url")), F.lit(".MP3?x=1"))), "lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', '') || '.MP3?x=1', '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^./](\\.[^./]+)$', 1))")})
project("j13_url_coding", "pages", "page_id", {"quoted": (lambda: text.quote(c("url")), "replace(url_encode(url), '%2F', '/')"), "back": (lambda: text.unquote(text.quote(c("url"))), "url")})
project("j14_known_language", "users", "id", {"x": (lambda: text.known_language(c("language"), ["en", "fr", "nl"], "en"), "CASE WHEN lower(language) IN ('en', 'fr', 'nl') THEN lower(language) WHEN lower(string_split(language, '-')[1]) IN ('en', 'fr', 'nl') THEN lower(string_split(language, '-')[1]) ELSE 'en' END")})
project("j15_base_language", "users", "id", {"x": (lambda: text.base_language(c("language")), "lower(string_split(language, '-')[1])")})
project("j16_zone_format", "events", "event_id", {"x": (lambda: text.local_time(c("ts").cast("timestamp"), "America/New_York", "yyyy-MM-dd HH:mm"), "strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M')")})
project("j17_iso", "events", "event_id", {"x": (lambda: F.unix_micros(F.to_timestamp(F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))), "epoch_us(ts)")})
project("j18_nanoseconds", "events", "event_id", {"x": (lambda: F.unix_micros(text.from_nanoseconds(F.when(c("event_id") % 5 > 0, c("event_id") * 1_500_000_123).otherwise(0))), "CASE WHEN event_id % 5 > 0 THEN (event_id * 1500000123) // 1000 END")})
project("j19_date_interval", "orders", "o_orderkey", {"x": (lambda: F.date_format(c("o_orderdate") + F.expr("INTERVAL 36 HOURS"), "yyyy-MM-dd HH"), "strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H')")})
project("j20_remaining_seconds", "events", "event_id", {"x": (lambda: text.remaining_seconds(F.lit(1_000_000).cast("long"), c("event_id") * 1234), "trunc((1000000 - event_id * 1234) / 1000)::BIGINT")})
project("j21_round_half_even", "events", "event_id", {"x": (lambda: text.round_half_even((c("event_id") / 8).cast("double")), "round_even((event_id / 8)::DOUBLE, 2)")})
project("j22_round_half_up", "events", "event_id", {"x": (lambda: text.round_half_up(c("value")), "floor(value + 0.5)::BIGINT")})
project("j23_digests", "users", "id", {"sha1": (lambda: F.sha1(c("full_name").cast("binary")), "sha1(full_name)"), "b64": (lambda: F.base64(c("full_name").cast("binary")), "to_base64(full_name::BLOB)")})
_PADS = [b"secret".ljust(64, b"\0").translate(bytes(k ^ b for k in range(256))).hex() for b in (0x36, 0x5C)]
project("j23_hmac", "users", "id", {"x": (lambda: text.hmac_sha256(b"secret", c("full_name")), f"sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || full_name::BLOB)))")})
project("j24_typed_parse", "users", "id", {"x": (lambda: text.typed(F.when(c("id") % 3 == 0, c("id").cast("string")).when(c("id") % 3 == 1, F.concat(c("id").cast("string"), F.lit(".5"))).otherwise(c("full_name"))), "CASE id % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'float' ELSE 'string' END")})
project("j25_email_domain", "users", "id", {"x": (lambda: text.email_domain(c("email")), "string_split(email, '@')[-1]")})
project("j26_short_label", "users", "id", {"x": (lambda: text.short_label(c("full_name")), "CASE WHEN length(full_name) > 10 THEN full_name[:10] || '.' ELSE full_name END")})
project("j27_strip_mime", "users", "id", {"x": (lambda: text.strip_mime(F.concat(F.when(c("id") % 2 == 0, "audio/").otherwise("text/"), c("language"))), "CASE WHEN id % 2 = 0 THEN language ELSE 'text/' || language END")})
project("j28_join_trimmed", "users", "id", {"x": (lambda: text.join_trimmed(F.array(F.concat(F.lit(" "), c("full_name")), F.lit("  "), F.concat(c("language"), F.lit("\n")))), "full_name || ' ' || language")})
project("j29_phone", "users", "id", {"x": (lambda: text.phone(F.concat(F.lit("06 12.34-"), F.lpad((c("id") % 10000).cast("string"), 4, "0"))), "'+336' || '1234' || lpad((id % 10000)::VARCHAR, 4, '0')")})
project("j30_room_slug", "users", "id", {"x": (lambda: text.room_slug(c("id")), None)})
project("j31_hyphenation", "users", "id", {"x": (lambda: text.hyphenate_room(F.lower(F.translate("full_name", "#0123456789", "abcdefghijk"))), "concat_ws('-', substr(t, 1, 3), substr(t, 4, 4), substr(t, 8, 3))".replace("t,", "lower(translate(full_name, '#0123456789', 'abcdefghijk')),"))})
project("j32_slugify_simple", "users", "id", {"x": (lambda: text.slugify_simple(F.concat(F.lit(" Été -- à "), c("full_name"))), "'ete-a-' || replace(lower(full_name), '#', '')")})
project("j33_pin_grouping", "users", "id", {"x": (lambda: text.group_pin(F.when(c("id") % 4 == 0, "").otherwise(F.lpad(c("id").cast("string"), 10, "0"))), "CASE WHEN id % 4 = 0 THEN '' ELSE regexp_replace(lpad(id::VARCHAR, 10, '0'), '(\\d{3})(\\d{3})(\\d{4})', '\\1 \\2 \\3') || '#' END")})
project("j34_date_template", "events", "event_id", {"x": (lambda: text.date_or_invalid(F.when(c("event_id") % 3 > 0, c("ts").cast("string")).otherwise("soon"), "yyyy-MM-dd HH:mm:ss"), "CASE WHEN event_id % 3 > 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') ELSE 'Invalid Date' END")})
project("j35_room_id", "users", "id", {"x": (lambda: text.is_room_id(F.when(c("id") % 3 == 0, "abc-defg-hij").when(c("id") % 3 == 1, "https://own.test/abc-defg-hij").otherwise("https://other.test/abc-defg-hij"), "https://own.test"), "id % 3 < 2")})

# Arrays, maps and JSON
_K = lambda: F.create_map(F.lit("b"), F.get_json_object("props", "$.k"), F.lit("c"), c("event_type"))
project("k1_map_merge", "events", "event_id", {"x": (lambda: F.array_join(F.array_sort(F.transform(F.map_entries(json_ops.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), _K())), lambda e: F.concat_ws("=", e["key"], e["value"]))), ","), "'a=1,b=' || (props::JSON ->> '$.k') || ',c=' || event_type")})
project("k2_map_without", "events", "event_id", {"x": (lambda: F.to_json(json_ops.without_keys(_K(), ["c"])), "'{\"b\":\"' || (props::JSON ->> '$.k') || '\"}'")})
_A, _B = lambda: F.split(F.lit("camera,microphone,camera,screen"), ","), lambda: F.array(F.when(c("event_id") % 2 == 0, "camera").otherwise("screen"))
_LIST = "string_split(text, ' ')"
project("e16_list_membership_rows", "conversations", "conv_id, turn", {"x": (lambda: F.array_contains(F.split("text", " "), c("role")) | F.array_contains(F.split("text", " "), "the"), f"list_contains({_LIST}, role) OR list_contains({_LIST}, 'the')")})
project("k5_array_upper_words", "conversations", "conv_id, turn", {"x": (lambda: F.array_join(F.transform(F.split(F.regexp_replace("text", "[^a-z ]", ""), " "), F.upper), ","), "array_to_string(list_transform(string_split(regexp_replace(text, '[^a-z ]', '', 'g'), ' '), lambda w: upper(w)), ',')")})
project("j32_slugify_accents", "users", "id", {"x": (lambda: text.slugify_simple(F.concat(F.lit(" Šő Źd -- ǻ ệ "), c("full_name"), F.lit(" ñ"))), "'so-zd-a-e-' || replace(lower(full_name), '#', '') || '-n'")})
project("k3_array_union", "events", "event_id", {"x": (lambda: F.array_join(json_ops.union_arrays(_A(), _B()), ","), "'camera,microphone,screen'"), "removed": (lambda: F.array_join(json_ops.remove_all(_A(), _B()), ","), "CASE WHEN event_id % 2 = 0 THEN 'microphone,screen' ELSE 'camera,microphone,camera' END")})
project("e16_list_membership", "events", "event_id", {"x": (lambda: F.array_contains(_A(), F.element_at(_B(), 1)), "true")})
project("k4_array_distinct", "conversations", "conv_id, turn", {"n": (lambda: F.size(F.array_distinct(F.split("text", " "))).cast("long"), "len(list_distinct(string_split(text, ' ')))")})
project("k5_array_upper", "events", "event_id", {"x": (lambda: F.array_join(F.transform(_A(), F.upper), ","), "'CAMERA,MICROPHONE,CAMERA,SCREEN'")})
project("k6_split_distinct", "users", "id", {"x": (lambda: F.array_join(json_ops.split_scopes(F.concat_ws(" ", c("language"), F.lit("ROOMS rooms"), c("language"))), " "), "lower(language) || ' rooms'")})
project("k7_array_join", "users", "id", {"x": (lambda: F.array_join(F.coalesce(F.when(c("id") % 2 == 0, F.array(c("language"), c("full_name"))), F.array().cast("array<string>")), " "), "CASE WHEN id % 2 = 0 THEN language || ' ' || full_name ELSE '' END")})
project("k8_json_default", "events", "event_id", {"k": (lambda: json_ops.json_get(c("props"), "$.k", "none"), "coalesce(props::JSON ->> '$.k', 'none')"), "x": (lambda: json_ops.json_get(c("props"), "$.missing", "none"), "'none'")})
project("k9_json_round_trip", "events", "event_id", {"k": (lambda: F.from_json("props", "k bigint")["k"], "(props::JSON ->> '$.k')::BIGINT"), "doc": (lambda: F.to_json(F.from_json("props", "k bigint")), "'{\"k\":' || (props::JSON ->> '$.k') || '}'")})
project("k10_drop_nulls", "users", "id", {"x": (lambda: F.to_json(F.struct("id", "sub")), "CASE WHEN sub IS NULL THEN '{\"id\":' || id || '}' ELSE '{\"id\":' || id || ',\"sub\":\"' || sub || '\"}' END")})
project("k11_closed_schema", "rooms", "id", {"x": (lambda: F.array_join(json_ops.unknown_keys(c("configuration"), ["everyone_can_mute"]), ","), "CASE WHEN contains(configuration, 'can_publish_sources') THEN 'can_publish_sources' ELSE '' END")})
project("k12_tagged_union", "events", "event_id", {"x": (lambda: json_ops.decode_callback(F.concat(F.lit('{"type": "'), F.when(c("event_id") % 2 == 0, "transcript").otherwise("summary"), F.lit('", "status": "'), F.when(c("event_id") % 3 == 0, "success").when(c("event_id") % 3 == 1, "failure").otherwise("pending"), F.lit('"}'))), "CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'external_process_successful' WHEN event_id % 2 = 0 AND event_id % 3 = 1 THEN 'external_process_failed' ELSE '' END")})
query("k13_explode_words", "SELECT conv_id, turn, (i - 1)::INTEGER AS pos, w[i] AS word FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE role <> 'system')) WHERE length(w[i]) > 3")(lambda s, d: table(s, d, "conversations").where("role <> 'system'").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word")).where("length(word) > 3"))


@query("k14_relabel", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Ada' ELSE role END AS speaker, CASE role WHEN 'user' THEN 'Ada' ELSE role END AS word_speaker, text[1:5] AS word FROM conversations")
def k14(spark, d):
    names = F.create_map(F.lit("user"), F.lit("Ada"))
    word = F.struct(F.substring("text", 1, 5).alias("word"), c("role").alias("speaker"))
    seg = F.array(F.struct(c("role").alias("speaker"), F.array(word).alias("words")))
    out = table(spark, d, "conversations").select("conv_id", "turn", F.get(json_ops.relabel(seg, names), F.lit(0)).alias("s"))
    return out.select("conv_id", "turn", "s.speaker", F.get("s.words", F.lit(0))["speaker"].alias("word_speaker"), F.get("s.words", F.lit(0))["word"].alias("word"))


@query("k14_relabel_words", "SELECT conv_id, turn, speaker, (i - 1)::INTEGER AS pos, speaker AS word_speaker, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Ada' ELSE role END AS speaker, string_split(text, ' ') AS w FROM conversations))")
def k14_words(spark, d):
    """Every word of the segment, each relabelled."""
    names = F.create_map(F.lit("user"), F.lit("Ada"))
    role = c("role")
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word"), role.alias("speaker")))
    seg = F.array(F.struct(role.alias("speaker"), words.alias("words")))
    out = table(spark, d, "conversations").select("conv_id", "turn", F.get(json_ops.relabel(seg, names), F.lit(0)).alias("s"))
    return out.select("conv_id", "turn", "s.speaker", F.posexplode("s.words").alias("pos", "w")).select("conv_id", "turn", "speaker", "pos", c("w.speaker").alias("word_speaker"), c("w.word").alias("word"))


_PEOPLE = lambda: F.array(F.struct(c("language").alias("participantId"), F.when(c("id") % 2 == 0, c("full_name")).alias("name")), F.struct(F.lit("nl").alias("participantId"), F.lit("Last").alias("name")))
project("k15_names_by_id", "users", "id", {"x": (lambda: F.coalesce(F.try_element_at(json_ops.names_by_id(_PEOPLE()), c("language")), F.lit("?")), "CASE WHEN language = 'nl' THEN 'Last' WHEN id % 2 = 0 THEN full_name ELSE language END")})
project("k16_only_keys", "events", "event_id", {"x": (lambda: F.to_json(json_ops.only_keys(_K(), ["c", "z"])), "'{\"c\":\"' || event_type || '\"}'")})
project("k17_subset", "events", "event_id", {"x": (lambda: json_ops.subset(_B(), F.when(c("event_id") % 3 > 0, F.array(F.lit("camera")))), "event_id % 2 = 0 AND event_id % 3 > 0"), "empty": (lambda: json_ops.subset(F.array().cast("array<string>"), F.lit(None).cast("array<string>")), "true")})
project("k18_list_or_default", "rooms", "id", {"x": (lambda: F.array_join(json_ops.list_or_default(c("configuration"), "$.can_publish_sources", ["screen"]), ","), "CASE WHEN contains(configuration, 'can_publish') THEN 'camera,microphone' ELSE 'screen' END")})
