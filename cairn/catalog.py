"""Every operator applied to the star-schema tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import numbers, routing
from cairn.operators import bitmaps, geo, hashes, keys, lists, sampling, sets, strings, zsets
from cairn.plans import fold, snapshot, transactions
from cairn.sources import wire
from cairn.sources.keyspace import AS_OF_MS, KeySpace, epoch_ms
from cairn.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Views of the tables as relations, for the SQL side.
_V = {
    "K": f"""SELECT 'evt:' || event_id AS key, 'string' AS type, CAST(epoch_ms(ts) + (user_id % 48) * 3600000 AS BIGINT) AS e FROM events
        UNION ALL SELECT DISTINCT 'part:' || p_partkey, 'string', CAST(NULL AS BIGINT) FROM part
        UNION ALL SELECT DISTINCT 'user:' || user_id, 'list', NULL FROM events
        UNION ALL SELECT DISTINCT 'customer:' || c_custkey, 'hash', NULL FROM customer
        UNION ALL SELECT DISTINCT 'prio:' || o_orderpriority, 'set', NULL FROM orders
        UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, 'zset', NULL FROM customer""",
    "KL": f"SELECT * FROM K WHERE e IS NULL OR e >= {AS_OF_MS}",
    "S": "SELECT 'part:' || p_partkey AS key, p_name AS value FROM part",
    "L": "SELECT 'user:' || user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type AS val, count(*) OVER (PARTITION BY user_id) AS len FROM events",
    "H": "SELECT 'customer:' || c_custkey AS key, field, val FROM (SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer) UNPIVOT (val FOR field IN (c_name, c_nationkey, c_acctbal, c_mktsegment))",
    "M": "SELECT DISTINCT 'prio:' || o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS member FROM orders",
    "Z": "SELECT 'nation:' || c_nationkey AS key, CAST(c_custkey AS VARCHAR) AS member, c_acctbal AS score FROM customer",
    "ZR": "SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS r, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rr, count(*) OVER (PARTITION BY key) AS n FROM Z",
    "X": "SELECT DISTINCT 'brand:' || p_brand AS key, p_name AS member FROM part",
    "B": "SELECT DISTINCT 'act:' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS key, user_id AS off FROM events",
    "G": "SELECT 'geo:cust' AS key, CAST(c_custkey AS VARCHAR) AS member, ((c_custkey * 7919) % 360000) / 1000.0 - 180 AS lng, ((c_custkey * 104729) % 160000) / 1000.0 - 80 AS lat FROM customer",
}
_USES = {"KL": ("K",), "ZR": ("Z",)}


def _sql(text: str) -> str:
    """text with the views that it names in front."""
    import re

    names: list[str] = []
    for name in re.findall(r"\b(?:FROM|JOIN)\s+(K|KL|S|L|H|M|Z|ZR|X|B|G)\b", text):
        for n in (*_USES.get(name, ()), name):
            if n not in names:
                names.append(n)
    views = ", ".join(f"{n} AS ({_V[n]})" for n in names)
    if not views:
        return text
    return f"WITH {views}, {text[5:]}" if text.startswith("WITH ") else f"WITH {views} {text}"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[KeySpace], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(KeySpace(spark, sf_dir))
        if sql:
            SQL[name] = _sql(" ".join(sql.split()) if "'" not in sql else sql.strip())
        return f

    return register


def _events(ks: KeySpace, kind: str) -> DataFrame:
    return ks.events().where(F.col("event_type") == kind)


def _user(prefix: str):
    return F.concat(F.lit(prefix), F.col("user_id").cast("string")).alias("key")


def _asked(ks: KeySpace) -> DataFrame:
    """Requests for the key of each event, and for that of twice its number, which half of the time doesn't exist: key, pos."""
    e = ks.events()
    return e.select(F.concat(F.lit("evt:"), F.col("event_id").cast("string")).alias("key"), F.col("event_id").alias("pos")).unionByName(
        e.select(F.concat(F.lit("evt:"), (F.col("event_id") * 2).cast("string")).alias("key"), (-F.col("event_id") - 1).alias("pos"))
    )


_ASKED = "(SELECT 'evt:' || event_id AS key, event_id AS pos FROM events UNION ALL SELECT 'evt:' || (event_id * 2), -event_id - 1 FROM events)"

# ---- key space


@query("keys_glob", "SELECT key FROM KL WHERE regexp_full_match(key, 'nation:1.')")
def _(ks):
    return keys.match(ks.keys(), "nation:1?", AS_OF_MS)


@query("keys_prefix", "SELECT key FROM KL WHERE starts_with(key, 'user:')")
def _(ks):
    return keys.match(ks.keys(), "user:*", AS_OF_MS)


@query("keys_exists", f"SELECT count(*) AS n FROM {_ASKED} r JOIN KL ON r.key = KL.key")
def _(ks):
    return keys.exists_count(ks.keys(), _asked(ks), AS_OF_MS)


@query("keys_existin", f"SELECT r.key, r.pos FROM {_ASKED} r WHERE r.key IN (SELECT key FROM KL)")
def _(ks):
    return keys.exist_in(ks.keys(), _asked(ks), AS_OF_MS).select("key", "pos")


@query("keys_type", f"SELECT r.key, r.pos, coalesce(k.type, 'none') AS type FROM {_ASKED} r LEFT JOIN (SELECT * FROM KL) k ON r.key = k.key")
def _(ks):
    return keys.type_of(ks.keys(), _asked(ks), AS_OF_MS).select("key", "pos", "type")


_BUCKET = "CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 1024"


@query("keys_scan_page", f"WITH b AS (SELECT CAST({_BUCKET} AS INTEGER) AS bucket, key FROM KL WHERE type = 'string' AND key LIKE '%:1%') SELECT bucket, key FROM b WHERE (bucket, key) > (100, '') ORDER BY bucket, key LIMIT 50")
def _(ks):
    return keys.scan_page(ks.keys(), AS_OF_MS, (100, ""), 50, "*:1*", "string")


@query("keys_dbsize", "SELECT count(*) AS n FROM K")
def _(ks):
    return keys.size(ks.keys())


@query("keys_info", f"SELECT type, count(*) AS keys, count(e) AS expires, round(avg(CAST(e - {AS_OF_MS} AS DOUBLE)), 2) AS avg_ttl_ms FROM KL GROUP BY type")
def _(ks):
    return keys.info(ks.keys(), AS_OF_MS).withColumn("avg_ttl_ms", F.round("avg_ttl_ms", 2))


@query("keys_del", f"SELECT key, type FROM K WHERE key NOT IN (SELECT key FROM {_ASKED})")
def _(ks):
    return keys.delete(ks.keys(), _asked(ks)).select("key", "type")


@query("keys_del_count", f"SELECT count(*) AS n FROM K WHERE key IN (SELECT key FROM {_ASKED})")
def _(ks):
    return keys.deleted_count(ks.keys(), _asked(ks))


def _moves(ks: KeySpace) -> DataFrame:
    """Each event key with an even number to the next one, in hundreds to itself: every event is in one move."""
    e = ks.events().where(F.col("event_id") % 2 == 0)
    k = F.col("event_id")
    return e.select(F.concat(F.lit("evt:"), k.cast("string")).alias("src"), F.concat(F.lit("evt:"), F.when(k % 200 == 0, k).otherwise(k + 1).cast("string")).alias("dst"))


_MOVES = "(SELECT 'evt:' || event_id AS src, 'evt:' || CASE WHEN event_id % 200 = 0 THEN event_id ELSE event_id + 1 END AS dst FROM events WHERE event_id % 2 = 0)"


@query("keys_rename", f"WITH mv AS (SELECT * FROM {_MOVES} WHERE src <> dst AND src IN (SELECT key FROM K)) SELECT key, type, e AS expire_at_ms FROM K WHERE key NOT IN (SELECT dst FROM mv) AND key NOT IN (SELECT src FROM mv) UNION ALL SELECT mv.dst, k.type, k.e FROM mv JOIN (SELECT * FROM K) k ON k.key = mv.src")
def _(ks):
    return keys.rename(ks.keys(), _moves(ks)).select("key", "type", "expire_at_ms")


@query("keys_renamenx", f"WITH mv AS (SELECT * FROM {_MOVES} WHERE src <> dst AND src IN (SELECT key FROM K) AND dst NOT IN (SELECT key FROM KL)) SELECT key, type, e AS expire_at_ms FROM K WHERE key NOT IN (SELECT dst FROM mv) AND key NOT IN (SELECT src FROM mv) UNION ALL SELECT mv.dst, k.type, k.e FROM mv JOIN (SELECT * FROM K) k ON k.key = mv.src")
def _(ks):
    return keys.rename_nx(ks.keys(), _moves(ks), AS_OF_MS).select("key", "type", "expire_at_ms")


@query("keys_copy_replace", f"WITH mv AS (SELECT * FROM {_MOVES} WHERE src <> dst AND src IN (SELECT key FROM K)) SELECT key, type, e AS expire_at_ms FROM K WHERE key NOT IN (SELECT dst FROM mv) UNION ALL SELECT mv.dst, k.type, k.e FROM mv JOIN (SELECT * FROM K) k ON k.key = mv.src")
def _(ks):
    return keys.copy(ks.keys(), _moves(ks), replace=True).select("key", "type", "expire_at_ms")


@query("keys_getver", "SELECT CASE event_type WHEN 'click' THEN 'cnt:' || user_id WHEN 'view' THEN 'views:' || user_id WHEN 'purchase' THEN 'spend' WHEN 'signup' THEN 'user:' || user_id ELSE 'errors' END AS key, count(*) AS version FROM events GROUP BY 1")
def _(ks):
    return keys.versions(ks.commands())


for _name, _f, _value in (("ttl_seconds", keys.ttl, f"CAST(round((e - {AS_OF_MS}) / 1000.0) AS BIGINT)"), ("ttl_pttl", keys.pttl, f"e - {AS_OF_MS}"), ("ttl_expiretime", keys.expire_time, "CAST(floor(e / 1000.0) AS BIGINT)"), ("ttl_pexpiretime", keys.pexpire_time, "e")):
    _column = {"ttl_seconds": "ttl", "ttl_pttl": "pttl", "ttl_expiretime": "expire_time", "ttl_pexpiretime": "pexpire_time"}[_name]
    query(_name, f"SELECT r.key, r.pos, CASE WHEN k.key IS NULL THEN -2 WHEN k.e IS NULL THEN -1 ELSE {_value} END AS {_column} FROM {_ASKED} r LEFT JOIN (SELECT * FROM KL) k ON r.key = k.key")(lambda ks, f=_f: f(ks.keys(), _asked(ks), AS_OF_MS))


@query("ttl_live_asof", "SELECT key, type, e AS expire_at_ms FROM KL")
def _(ks):
    return keys.live(ks.keys(), AS_OF_MS).select("key", "type", "expire_at_ms")


@query("ttl_persist", "SELECT key, CAST(NULL AS BIGINT) AS expire_at_ms, CAST(e IS NOT NULL AS INTEGER) AS reply FROM K")
def _(ks):
    return keys.persist(ks.keys()).select("key", "expire_at_ms", "reply")


@query("ttl_expire", "SELECT 'evt:' || event_id AS key, CAST(epoch_ms(ts) + (event_id % 100) * 1000 AS BIGINT) AS expire_at_ms FROM events")
def _(ks):
    e = ks.events().select(F.concat(F.lit("evt:"), F.col("event_id").cast("string")).alias("key"), "ts", "event_id")
    return keys.expire(e, epoch_ms() + (F.col("event_id") % 100) * 1000).select("key", "expire_at_ms")


@query("ttl_expireat", f"SELECT key, CAST(CASE WHEN e IS NULL THEN {AS_OF_MS // 1000} ELSE e // 1000 + 60 END AS BIGINT) * 1000 AS expire_at_ms FROM K")
def _(ks):
    return keys.expire(ks.keys(), F.coalesce(F.floor(F.col("expire_at_ms") / 1000) + 60, F.lit(AS_OF_MS // 1000)) * 1000).select("key", "expire_at_ms")


@query("ttl_pexpire", f"SELECT key, CAST({AS_OF_MS} + 1500 AS BIGINT) AS expire_at_ms FROM KL")
def _(ks):
    return keys.expire(keys.live(ks.keys(), AS_OF_MS), F.lit(AS_OF_MS + 1500)).select("key", "expire_at_ms")


@query("ttl_pexpireat", f"SELECT key, CAST(coalesce(e, {AS_OF_MS}) + 250 AS BIGINT) AS expire_at_ms FROM K")
def _(ks):
    return keys.expire(ks.keys(), F.coalesce("expire_at_ms", F.lit(AS_OF_MS)) + 250).select("key", "expire_at_ms")


def _databases(ks: KeySpace) -> DataFrame:
    """db, key, type: collections in database 0, and those of nations in database 1 too."""
    k = ks.typed_keys()
    return k.select(F.lit(0).alias("db"), "key", "type").unionByName(k.where("type = 'zset'").select(F.lit(1).alias("db"), "key", "type"))


_DB = "(SELECT 0 AS db, key, type FROM K WHERE e IS NULL AND key NOT LIKE 'evt:%' UNION ALL SELECT 1, key, type FROM K WHERE type = 'zset')"


@query("keys_select_db", f"SELECT key, type FROM {_DB} WHERE db = 1")
def _(ks):
    return keys.in_database(_databases(ks), 1)


@query("keys_copy_db", f"WITH d AS (SELECT * FROM {_DB}), r AS (SELECT 1 AS db, key, type FROM d WHERE db = 0 AND (1, key) NOT IN (SELECT (db, key) FROM d)) SELECT db, key, type FROM d UNION ALL SELECT * FROM r")
def _(ks):
    d = _databases(ks)
    moves = d.where("db = 0").select(F.col("db").alias("src_db"), F.col("key").alias("src"), F.lit(1).alias("dst_db"), F.col("key").alias("dst"))
    return keys.copy_between(d, moves)


@query("snapshot_save_restore", "SELECT 'strings' AS relation, key, value AS a, CAST(NULL AS VARCHAR) AS b FROM S UNION ALL SELECT 'hashes', key, field, val FROM H UNION ALL SELECT 'sets', key, member, NULL FROM M")
def _(ks):
    path = live.shared_folder(ks.spark, "snapshot")
    snapshot.save({"strings": ks.strings(), "hashes": ks.hashes(), "sets": ks.sets()}, path)
    held = snapshot.restore(ks.spark, path)
    none = F.lit(None).cast("string").alias("b")
    return (
        held["strings"].select(F.lit("strings").alias("relation"), "key", F.col("value").alias("a"), none)
        .unionByName(held["hashes"].select(F.lit("hashes").alias("relation"), "key", F.col("field").alias("a"), F.col("val").alias("b")))
        .unionByName(held["sets"].select(F.lit("sets").alias("relation"), "key", F.col("member").alias("a"), none))
    )


# ---- strings and counters


def _parts(ks: KeySpace) -> DataFrame:
    """The key of twice the number of each part, which half of the time doesn't exist: key, pos"""
    p = ks._t("part")
    return p.select(F.concat(F.lit("part:"), (F.col("p_partkey") * 2).cast("string")).alias("key"), F.col("p_partkey").alias("pos"))


_PARTS = "(SELECT 'part:' || (p_partkey * 2) AS key, p_partkey AS pos FROM part)"


@query("str_get_mget", f"SELECT r.key, r.pos, s.value, CASE WHEN s.value IS NULL THEN 'missing' ELSE 'ok' END AS status FROM {_PARTS} r LEFT JOIN (SELECT * FROM S) s ON r.key = s.key")
def _(ks):
    return strings.get(ks.strings(), _parts(ks)).select("key", "pos", "value", "status")


@query("str_get_types", f"WITH r AS (SELECT key, pos FROM {_PARTS} UNION ALL SELECT 'nation:' || n_nationkey, n_nationkey FROM nation) SELECT r.key, r.pos, s.value, CASE WHEN s.value IS NOT NULL THEN 'ok' WHEN k.key IS NOT NULL THEN 'wrongtype' ELSE 'missing' END AS status FROM r LEFT JOIN (SELECT * FROM S) s ON r.key = s.key LEFT JOIN (SELECT * FROM K WHERE type <> 'string') k ON r.key = k.key")
def _(ks):
    n = ks._t("nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").cast("long").alias("pos"))
    return strings.get(ks.strings(), _parts(ks).unionByName(n), ks.keys().select("key", "type")).select("key", "pos", "value", "status")


def _new(ks: KeySpace) -> DataFrame:
    return _parts(ks).select((F.col("pos") % 97).alias("txn"), "pos", "key", F.concat(F.lit("new "), F.col("pos").cast("string")).alias("value"))


_NEW = f"(SELECT pos % 97 AS txn, pos, key, 'new ' || pos AS value FROM {_PARTS})"


@query("str_setnx", f"SELECT r.key, r.value FROM {_NEW} r WHERE r.key NOT IN (SELECT key FROM S)")
def _(ks):
    return strings.set_nx(ks.strings(), _new(ks)).select("key", "value")


@query("str_setxx", f"SELECT r.key, r.value FROM {_NEW} r WHERE r.key IN (SELECT key FROM S)")
def _(ks):
    return strings.set_xx(ks.strings(), _new(ks)).select("key", "value")


@query("str_mset", f"SELECT key, value FROM S WHERE key NOT IN (SELECT key FROM {_NEW}) UNION ALL SELECT key, value FROM {_NEW}")
def _(ks):
    return strings.mset(ks.strings(), _new(ks))


@query("str_msetnx", f"SELECT r.txn, r.key, r.value FROM {_NEW} r WHERE r.txn NOT IN (SELECT txn FROM {_NEW} WHERE key IN (SELECT key FROM S))")
def _(ks):
    return strings.mset_nx(ks.strings(), _new(ks)).select("txn", "key", "value")


def _mortal(ks: KeySpace) -> DataFrame:
    """Strings with an expiry where the number is even, some of it past: key, value, expire_at_ms"""
    k = F.col("p_partkey")
    at = F.when(k % 2 == 0, F.lit(AS_OF_MS) + (k % 40 - 10) * 1000).cast("long")
    return ks._t("part").select(F.concat(F.lit("part:"), k.cast("string")).alias("key"), F.col("p_name").alias("value"), at.alias("expire_at_ms"))


_MORTAL = f"(SELECT 'part:' || p_partkey AS key, p_name AS value, CAST(CASE WHEN p_partkey % 2 = 0 THEN {AS_OF_MS} + (p_partkey % 40 - 10) * 1000 END AS BIGINT) AS e FROM part)"


def _timed(ks: KeySpace) -> DataFrame:
    return _new(ks).withColumn("ttl", (F.col("pos") % 100).cast("long"))


for _name, _unit in (("str_setex", 1000), ("str_psetex", 1)):
    query(_name, f"WITH w AS (SELECT key, value, CAST({AS_OF_MS} + (pos % 100) * {_unit} AS BIGINT) AS e FROM {_NEW} WHERE pos % 100 > 0) SELECT key, value, e AS expire_at_ms FROM {_MORTAL} WHERE key NOT IN (SELECT key FROM w) UNION ALL SELECT key, value, e FROM w")(
        lambda ks, unit=_unit: strings.set_expiring(_mortal(ks), _timed(ks), AS_OF_MS, unit)
    )


@query("str_getex", f"""WITH r AS (SELECT key, pos, pos % 6 AS o FROM {_PARTS}), h AS (SELECT * FROM {_MORTAL} WHERE e IS NULL OR e >= {AS_OF_MS})
    SELECT r.key, r.pos, h.value, CAST(CASE WHEN h.key IS NULL THEN NULL WHEN o = 0 THEN {AS_OF_MS} + r.pos * 1000 WHEN o = 1 THEN {AS_OF_MS} + r.pos WHEN o = 2 THEN r.pos * 1000 WHEN o = 3 THEN r.pos WHEN o = 4 THEN NULL ELSE h.e END AS BIGINT) AS expire_at_ms
    FROM r LEFT JOIN h ON r.key = h.key""")
def _(ks):
    option = F.get(F.array(*[F.lit(o) for o in ("ex", "px", "exat", "pxat", "persist")]), (F.col("pos") % 6).cast("int"))
    req = _parts(ks).select("key", "pos", option.alias("option"), F.col("pos").cast("long").alias("n"))
    return strings.get_expiring(_mortal(ks), req, AS_OF_MS).select("key", "pos", "value", "expire_at_ms")


def _writes(ks: KeySpace) -> DataFrame:
    return ks.events().select(_user("last:"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))


@query("str_last_write", "SELECT 'last:' || user_id AS key, max_by(event_type, event_id) AS value FROM events GROUP BY 1")
def _(ks):
    return strings.last_write(_writes(ks))


@query("str_first_write", "SELECT 'last:' || user_id AS key, min_by(event_type, event_id) AS value FROM events GROUP BY 1")
def _(ks):
    return strings.first_write(_writes(ks))


@query("str_getset_lag", "SELECT 'last:' || user_id AS key, event_id AS seq, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS former FROM events")
def _(ks):
    return strings.get_set(_writes(ks))


@query("str_getdel", f"SELECT key, value FROM S WHERE key NOT IN (SELECT key FROM {_PARTS})")
def _(ks):
    return strings.get_del(ks.strings(), _parts(ks))[1]


@query("str_strlen", f"SELECT r.key, r.pos, CAST(coalesce(strlen(s.value), 0) AS BIGINT) AS n FROM {_PARTS} r LEFT JOIN (SELECT * FROM S) s ON r.key = s.key")
def _(ks):
    return strings.strlen(ks.strings(), _parts(ks))


@query("str_getrange", "WITH r AS (SELECT key, value, strlen(value) AS n FROM S) SELECT key, CASE WHEN n >= 4 AND 2 < n AND 2 <= n - 3 + 1 THEN substr(value, 3, n - 4) END AS part FROM r")
def _(ks):
    return strings.get_range(ks.strings(), 2, -3)


@query("str_setrange", "SELECT key, CASE WHEN strlen(value) >= 4 THEN substr(value, 1, 4) END || '####' || substr(value, 9) AS value FROM S")
def _(ks):
    return strings.set_range(ks.strings(), 4, "####")


@query("str_append", "SELECT 'last:' || user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS value, CAST(sum(strlen(event_type)) AS BIGINT) AS n FROM events GROUP BY 1")
def _(ks):
    return strings.append(_writes(ks))


def _clicks(ks: KeySpace) -> DataFrame:
    return _events(ks, "click").select(_user("cnt:"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("d"), F.col("value").alias("x"))


@query("ctr_incr_running", "SELECT 'cnt:' || user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM events WHERE event_type = 'click'")
def _(ks):
    return strings.incr_running(_clicks(ks), F.lit(1).cast("long")).select("key", "seq", "value")


@query("ctr_incrby_total", "SELECT 'cnt:' || user_id AS key, CAST(sum(event_id % 7) AS BIGINT) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def _(ks):
    return strings.incr_total(_clicks(ks), F.col("d"))


@query("ctr_decr", "SELECT 'cnt:' || user_id AS key, CAST(-count(*) AS BIGINT) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def _(ks):
    return strings.incr_total(_clicks(ks), F.lit(-1).cast("long"))


@query("ctr_decrby", "SELECT 'cnt:' || user_id AS key, CAST(-sum(event_id % 7) AS BIGINT) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def _(ks):
    return strings.incr_total(_clicks(ks), -F.col("d"))


@query("ctr_incrbyfloat", "SELECT 'cnt:' || user_id AS key, round(sum(value), 2) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def _(ks):
    return strings.incr_total(_clicks(ks), F.col("x")).withColumn("value", F.round("value", 2))


@query("ctr_incrby_text", f"SELECT r.key, CAST(CASE WHEN s.value IS NULL THEN r.pos END AS BIGINT) AS value, CASE WHEN s.value IS NULL THEN 'ok' ELSE 'not an integer' END AS status FROM {_PARTS} r LEFT JOIN (SELECT * FROM S) s ON r.key = s.key")
def _(ks):
    return strings.incr_by(ks.strings(), _parts(ks).select("key", F.col("pos").alias("delta")))


# ---- bitmaps


@query("bit_setbit_build", "SELECT key, off // 8 AS byte_no, CAST(bit_or(CAST(1 << (off % 8)::INT AS INTEGER)) AS INTEGER) AS v FROM B GROUP BY key, off // 8")
def _(ks):
    return bitmaps.to_bytes(ks.bits())


@query("bit_getbit", "WITH r AS (SELECT DISTINCT key, o AS off FROM B, (SELECT unnest(range(0, 160, 16)) AS o)) SELECT r.key, r.off, CAST(b.key IS NOT NULL AS INTEGER) AS bit FROM r LEFT JOIN (SELECT * FROM B) b ON r.key = b.key AND r.off = b.off")
def _(ks):
    asked = ks.bits().select("key").distinct().select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(144).cast("long"), F.lit(16).cast("long"))).alias("off"))
    return bitmaps.get_bit(bitmaps.to_bytes(ks.bits()), asked)


@query("bit_count", "SELECT key, count(*) AS n FROM B GROUP BY key")
def _(ks):
    return bitmaps.count(bitmaps.to_bytes(ks.bits()))


@query("bit_count_range", "SELECT key, CAST(sum(CASE WHEN mb >= 2 AND off >= 16 AND off < (mb + 1 - 1) * 8 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT *, max(off) OVER (PARTITION BY key) // 8 AS mb FROM B) GROUP BY key")
def _(ks):
    return bitmaps.count_range(ks.bits(), 2, -2)


@query("bit_count_bits", "SELECT key, CAST(sum(CASE WHEN mb >= 10 AND off >= 10 AND off <= 99 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT *, (max(off) OVER (PARTITION BY key) // 8 + 1) * 8 - 1 AS mb FROM B) GROUP BY key")
def _(ks):
    return bitmaps.count_range(ks.bits(), 10, 99, "BIT")


@query("bit_pos", "SELECT key, CAST(min(off) AS BIGINT) AS pos FROM B GROUP BY key")
def _(ks):
    return bitmaps.position(ks.bits(), 1)


@query("bit_pos_zero", "WITH m AS (SELECT key, (max(off) // 8 + 1) * 8 AS n FROM B GROUP BY key), c AS (SELECT m.key, m.n, o FROM m, (SELECT unnest(range(0, 100000)) AS o) WHERE o < m.n) SELECT c.key, CAST(coalesce(min(CASE WHEN b.off IS NULL THEN o END), -1) AS BIGINT) AS pos FROM c LEFT JOIN (SELECT * FROM B) b ON b.key = c.key AND b.off = c.o GROUP BY c.key")
def _(ks):
    return bitmaps.position(ks.bits(), 0)


# ---- lists


@query("list_llen", "SELECT key, count(*) AS n FROM L GROUP BY key")
def _(ks):
    return lists.length(ks.lists(), ks.lists().select("key").distinct())


@query("list_lindex", "SELECT key, val FROM L WHERE pos = len - 3")
def _(ks):
    return lists.index(ks.lists(), -3)


@query("list_lrange", "SELECT key, pos, val FROM L WHERE pos >= 2 AND pos <= len - 4")
def _(ks):
    return lists.between(ks.lists(), 2, -4)


@query("list_lrange_100", "SELECT key, pos, val FROM L WHERE pos < 100")
def _(ks):
    return lists.between(ks.lists(), 0, 99)


@query("list_ltrim", "SELECT key, pos - 5 AS pos, val FROM L WHERE pos >= 5 AND pos <= len - 6")
def _(ks):
    return lists.trim(ks.lists(), 5, -6)


@query("list_lpop", "SELECT key, pos - 3 AS pos, val FROM L WHERE pos >= 3")
def _(ks):
    return lists.pop_left(ks.lists(), 3)[1]


@query("list_rpop", "SELECT key, len - 1 - pos AS nth, val FROM L WHERE pos >= len - 3")
def _(ks):
    return lists.pop_right(ks.lists(), 3)[0].select("key", "nth", "val")


@query("list_lrem_all", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, val FROM L WHERE val <> 'click'")
def _(ks):
    return lists.remove(ks.lists(), 0, "click")


@query("list_lrem_first", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, val FROM (SELECT *, row_number() OVER (PARTITION BY key, val ORDER BY pos) AS nth FROM L) WHERE NOT (val = 'click' AND nth <= 2)")
def _(ks):
    return lists.remove(ks.lists(), 2, "click")


@query("list_lrem_last", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, val FROM (SELECT *, row_number() OVER (PARTITION BY key, val ORDER BY pos DESC) AS nth FROM L) WHERE NOT (val = 'click' AND nth <= 2)")
def _(ks):
    return lists.remove(ks.lists(), -2, "click")


@query("list_lset", "SELECT key, pos, CASE WHEN pos = len - 2 THEN 'changed' ELSE val END AS val FROM L")
def _(ks):
    return lists.replace(ks.lists(), -2, "changed")


@query("list_linsert", "WITH f AS (SELECT key, min(pos) AS p FROM L WHERE val = 'purchase' GROUP BY key) SELECT key, row_number() OVER (PARTITION BY key ORDER BY q) - 1 AS pos, val FROM (SELECT key, CAST(pos AS DOUBLE) AS q, val FROM L UNION ALL SELECT key, p + 0.5, 'inserted' FROM f)")
def _(ks):
    return lists.insert(ks.lists(), "purchase", "inserted", after=True)


@query("list_push", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY z, p) - 1 AS pos, val FROM (SELECT key, 1 AS z, pos AS p, val FROM L UNION ALL SELECT 'user:' || n_nationkey, 0, -n, n_name || n FROM nation, (SELECT unnest([1, 2]) AS n))")
def _(ks):
    n = F.explode(F.array(F.lit(1), F.lit(2))).alias("nth")
    new = ks._t("nation").select(F.concat(F.lit("user:"), F.col("n_nationkey").cast("string")).alias("key"), "n_name", n).select("key", "nth", F.concat("n_name", F.col("nth").cast("string")).alias("val"))
    return lists.push_left(ks.lists(), new)


@query("list_rpushx", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY z, p) - 1 AS pos, val FROM (SELECT key, 0 AS z, pos AS p, val FROM L UNION ALL SELECT 'user:' || n_nationkey, 1, 0, n_name FROM nation WHERE 'user:' || n_nationkey IN (SELECT key FROM L))")
def _(ks):
    new = ks._t("nation").select(F.concat(F.lit("user:"), F.col("n_nationkey").cast("string")).alias("key"), F.lit(0).alias("nth"), F.col("n_name").alias("val"))
    return lists.push_right(ks.lists(), new, only_existing=True)


@query("list_lpushx", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY z, p) - 1 AS pos, val FROM (SELECT key, 1 AS z, pos AS p, val FROM L UNION ALL SELECT 'user:' || n_nationkey, 0, -i, n_name || i FROM nation, (SELECT unnest([0, 1]) AS i) WHERE 'user:' || n_nationkey IN (SELECT key FROM L))")
def _(ks):
    n = ks._t("nation").select(F.concat(F.lit("user:"), F.col("n_nationkey").cast("string")).alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"), "n_name")
    return lists.push_left(ks.lists(), n.select("key", "nth", F.concat("n_name", F.col("nth").cast("string")).alias("val")), only_existing=True)


@query("list_rpoplpush", "WITH mv AS (SELECT 'user:' || n_nationkey AS src, 'moved:' || (n_nationkey % 50) AS dst FROM nation), t AS (SELECT l.key, l.pos, l.val, mv.dst FROM (SELECT * FROM L) l JOIN mv ON mv.src = l.key WHERE l.pos = l.len - 1) SELECT key, pos, val FROM L WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.key = L.key AND t.pos = L.pos) UNION ALL SELECT dst, CAST(0 AS BIGINT), val FROM t")
def _(ks):
    k = F.col("n_nationkey")
    moves = ks._t("nation").select(F.concat(F.lit("user:"), k.cast("string")).alias("src"), F.concat(F.lit("moved:"), (k % 50).cast("string")).alias("dst"))
    return lists.move_tail_to_head(ks.lists(), moves)


# ---- hashes


def _fields(ks: KeySpace) -> DataFrame:
    c = ks._t("customer")
    return c.select(F.concat(F.lit("customer:"), (F.col("c_custkey") * 2).cast("string")).alias("key"), F.explode(F.array(F.lit("c_name"), F.lit("c_phone"), F.lit("c_acctbal"))).alias("field"))


_FIELDS = "(SELECT 'customer:' || (c_custkey * 2) AS key, unnest(['c_name', 'c_phone', 'c_acctbal']) AS field FROM customer)"


@query("hash_hget", f"SELECT r.key, r.field, h.val FROM {_FIELDS} r LEFT JOIN (SELECT * FROM H) h ON r.key = h.key AND r.field = h.field")
def _(ks):
    return hashes.get(ks.hashes(), _fields(ks))


@query("hash_hmget", "SELECT 'customer:' || c_custkey AS key, c_name, c_mktsegment FROM customer")
def _(ks):
    return hashes.get_many(ks.hashes(), ["c_name", "c_mktsegment"])


@query("hash_hgetall", "SELECT key, field, val FROM H")
def _(ks):
    return ks.hashes()


@query("hash_hkeys", "SELECT key, field FROM H")
def _(ks):
    return hashes.fields(ks.hashes())


@query("hash_hvals", "SELECT key, val FROM H")
def _(ks):
    return hashes.values(ks.hashes())


@query("hash_hlen", "SELECT key, count(*) AS n FROM H GROUP BY key")
def _(ks):
    return hashes.length(ks.hashes())


@query("hash_hexists", f"SELECT r.key, r.field, CAST(h.key IS NOT NULL AS INTEGER) AS found FROM {_FIELDS} r LEFT JOIN (SELECT * FROM H) h ON r.key = h.key AND r.field = h.field")
def _(ks):
    return hashes.exists(ks.hashes(), _fields(ks))


@query("hash_hstrlen", f"SELECT r.key, r.field, CAST(coalesce(strlen(h.val), 0) AS BIGINT) AS n FROM {_FIELDS} r LEFT JOIN (SELECT * FROM H) h ON r.key = h.key AND r.field = h.field")
def _(ks):
    return hashes.field_length(ks.hashes(), _fields(ks))


def _hlog(ks: KeySpace) -> DataFrame:
    return ks.events().select(_user("u:"), F.col("event_type").alias("field"), F.col("event_id").alias("seq"), F.col("props").alias("val"), F.col("value").alias("x"))


@query("hash_hset_log", "SELECT 'u:' || user_id AS key, event_type AS field, max_by(props, event_id) AS val FROM events GROUP BY 1, 2")
def _(ks):
    return hashes.set_log(_hlog(ks))


@query("hash_hsetnx", "SELECT 'u:' || user_id AS key, event_type AS field, min_by(props, event_id) AS val FROM events GROUP BY 1, 2")
def _(ks):
    return hashes.set_nx_log(_hlog(ks))


@query("hash_hmset", f"SELECT key, field, val FROM H WHERE (key, field) NOT IN (SELECT (key, field) FROM {_FIELDS}) UNION ALL SELECT key, field, 'new' FROM {_FIELDS}")
def _(ks):
    return hashes.set_many(ks.hashes(), _fields(ks).withColumn("val", F.lit("new")))[0]


@query("hash_hdel", f"SELECT key, field, val FROM H WHERE (key, field) NOT IN (SELECT (key, field) FROM {_FIELDS})")
def _(ks):
    return hashes.delete(ks.hashes(), _fields(ks))


@query("hash_hincrby", "SELECT 'u:' || user_id AS key, event_type AS field, CAST(sum(event_id % 5) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def _(ks):
    return hashes.incr(_hlog(ks), F.col("seq") % 5)


@query("hash_hincrbyfloat", "SELECT 'u:' || user_id AS key, event_type AS field, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(ks):
    return hashes.incr(_hlog(ks), F.col("x")).withColumn("total", F.round("total", 2))


@query("hash_hscan", "SELECT key, field, val FROM H WHERE regexp_full_match(field, 'c_[mn].*t.*')")
def _(ks):
    return hashes.scan(ks.hashes(), "c_[mn]*t*")


# ---- sets

_A, _B2, _C = "prio:1-URGENT", "prio:2-HIGH", "prio:3-MEDIUM"


@query("set_sinter", f"SELECT member FROM M WHERE key = '{_A}' INTERSECT SELECT member FROM M WHERE key = '{_B2}' INTERSECT SELECT member FROM M WHERE key = '{_C}'")
def _(ks):
    return sets.intersect(ks.sets(), [_A, _B2, _C])


@query("set_sunion", f"SELECT member FROM M WHERE key = '{_A}' UNION SELECT member FROM M WHERE key = '{_B2}'")
def _(ks):
    return sets.union(ks.sets(), [_A, _B2])


@query("set_sdiff", f"SELECT member FROM M WHERE key = '{_A}' EXCEPT SELECT member FROM M WHERE key = '{_B2}' EXCEPT SELECT member FROM M WHERE key = '{_C}'")
def _(ks):
    return sets.subtract(ks.sets(), _A, _B2, _C)


for _name, _op, _f in (("set_sinterstore", "INTERSECT", lambda s: sets.intersect(s, [_A, _B2])), ("set_sunionstore", "UNION", lambda s: sets.union(s, [_A, _B2])), ("set_sdiffstore", "EXCEPT", lambda s: sets.subtract(s, _A, _B2))):
    query(_name, f"SELECT key, member FROM M WHERE key <> '{_C}' UNION ALL SELECT '{_C}', member FROM (SELECT member FROM M WHERE key = '{_A}' {_op} SELECT member FROM M WHERE key = '{_B2}')")(lambda ks, f=_f: sets.store(ks.sets(), _C, f(ks.sets())))


@query("set_scard", "SELECT key, count(*) AS n FROM M GROUP BY key")
def _(ks):
    return sets.cardinality(ks.sets())


def _members(ks: KeySpace) -> DataFrame:
    return ks._t("customer").select(F.lit(_A).alias("key"), F.col("c_custkey").cast("string").alias("member"))


_MEMBERS = f"(SELECT '{_A}' AS key, CAST(c_custkey AS VARCHAR) AS member FROM customer)"


@query("set_sismember", f"SELECT r.key, r.member, CAST(m.key IS NOT NULL AS INTEGER) AS found FROM {_MEMBERS} r LEFT JOIN (SELECT * FROM M) m ON r.key = m.key AND r.member = m.member")
def _(ks):
    return sets.is_member(ks.sets(), _members(ks))


@query("set_smembers", f"SELECT member FROM M WHERE key = '{_A}'")
def _(ks):
    return sets.members(ks.sets(), _A)


@query("set_sadd", f"SELECT key, member FROM M UNION SELECT key, member FROM {_MEMBERS}")
def _(ks):
    return sets.add(ks.sets(), _members(ks))[0]


@query("set_sadd_count", f"SELECT key, count(*) AS added FROM {_MEMBERS} WHERE (key, member) NOT IN (SELECT (key, member) FROM M) GROUP BY key")
def _(ks):
    return sets.add(ks.sets(), _members(ks))[1]


@query("set_srem", f"SELECT key, member FROM M WHERE (key, member) NOT IN (SELECT (key, member) FROM {_MEMBERS})")
def _(ks):
    return sets.remove(ks.sets(), _members(ks))


@query("set_sscan", "SELECT key, member FROM M WHERE regexp_full_match(member, '1.*[05]')")
def _(ks):
    return sets.scan(ks.sets(), "1*[05]")


# ---- sorted sets


@query("z_zrevrange_topk", "SELECT key, member, score, rr AS rank FROM ZR WHERE rr < 10")
def topk(ks):
    return zsets.by_rank(ks.zsets(), 0, 9, reverse=True)


@query("z_zrange", "SELECT key, member, score, r AS rank FROM ZR WHERE r >= 3 AND r <= n - 5")
def _(ks):
    return zsets.by_rank(ks.zsets(), 3, -5)


@query("z_zrange_tail", "SELECT key, member, score, r AS rank FROM ZR WHERE r >= n - 5 AND r <= n - 2")
def _(ks):
    return zsets.by_rank(ks.zsets(), -5, -2)


def _some(ks: KeySpace) -> DataFrame:
    return ks._t("customer").select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("key"), (F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1_000_000_000)).cast("string").alias("member"))


_SOME = "(SELECT 'nation:' || c_nationkey AS key, CAST(c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000000 END AS VARCHAR) AS member FROM customer)"


@query("z_zrank", f"SELECT q.key, q.member, z.r AS rank FROM {_SOME} q LEFT JOIN (SELECT * FROM ZR) z ON q.key = z.key AND q.member = z.member")
def _(ks):
    return zsets.rank(ks.zsets(), _some(ks))


@query("z_zrevrank", f"SELECT q.key, q.member, z.rr AS rank FROM {_SOME} q LEFT JOIN (SELECT * FROM ZR) z ON q.key = z.key AND q.member = z.member")
def _(ks):
    return zsets.rank(ks.zsets(), _some(ks), reverse=True)


@query("z_rank_wide", "SELECT key, member, score, r AS rank FROM ZR")
def _(ks):
    return zsets.ranked(ks.zsets())


@query("z_zscore", f"SELECT q.key, q.member, z.score FROM {_SOME} q LEFT JOIN (SELECT * FROM Z) z ON q.key = z.key AND q.member = z.member")
def _(ks):
    return zsets.score(ks.zsets(), _some(ks))


@query("z_zcard", "SELECT key, count(*) AS n FROM Z GROUP BY key")
def _(ks):
    return zsets.cardinality(ks.zsets())


@query("z_zcount", "SELECT key, count(*) FILTER (score > 100 AND score <= 5000) AS n FROM Z GROUP BY key")
def _(ks):
    return zsets.count(ks.zsets(), "(100", "5000")


@query("z_rangebyscore_limit", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS k FROM Z WHERE score >= 1000) WHERE k > 5 AND k <= 15")
def _(ks):
    return zsets.by_score(ks.zsets(), "1000", "+inf", 5, 10)


@query("z_revrangebyscore", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS k FROM Z WHERE score < 5000) WHERE k <= 7")
def _(ks):
    return zsets.by_score(ks.zsets(), "-inf", "(5000", 0, 7, reverse=True)


@query("z_rangebylex", "SELECT key, member, 0.0::DOUBLE AS score FROM X WHERE member >= 'b' AND member < 'p'")
def _(ks):
    return zsets.by_lex(ks.lex(), "[b", "(p")


@query("z_revrangebylex", "SELECT key, member, 0.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member DESC) AS k FROM X WHERE member > 'c') WHERE k > 1 AND k <= 4")
def _(ks):
    return zsets.by_lex(ks.lex(), "(c", "+", 1, 3, reverse=True)


@query("z_lexcount", "SELECT key, count(*) FILTER (member <= 'm') AS n FROM X GROUP BY key")
def _(ks):
    return zsets.lex_count(ks.lex(), "-", "[m")


@query("z_zadd_log", "SELECT 'last' AS key, CAST(user_id AS VARCHAR) AS member, max_by(value, event_id) AS score FROM events GROUP BY 2")
def _(ks):
    return zsets.add_log(ks.events().select(F.lit("last").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq")))


@query("z_zincrby", "SELECT 'spend' AS key, CAST(user_id AS VARCHAR) AS member, round(sum(value), 2) AS score FROM events WHERE event_type = 'purchase' GROUP BY 2")
def _(ks):
    log = _events(ks, "purchase").select(F.lit("spend").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("delta"))
    return zsets.incr(log).withColumn("score", F.round("score", 2))


@query("z_zpopmin", "SELECT key, member, score FROM ZR WHERE r < 4")
def _(ks):
    return zsets.pop_min(ks.zsets(), 4)[0]


@query("z_zpopmin_rest", "SELECT key, member, score FROM ZR WHERE r >= 4")
def _(ks):
    return zsets.pop_min(ks.zsets(), 4)[1]


@query("z_zrem", f"SELECT key, member, score FROM Z WHERE (key, member) NOT IN (SELECT (key, member) FROM {_SOME})")
def _(ks):
    return zsets.remove(ks.zsets(), _some(ks))


@query("z_remrangebyscore", "SELECT key, member, score FROM Z WHERE NOT (score >= 0 AND score < 2000)")
def _(ks):
    return zsets.remove_by_score(ks.zsets(), "0", "(2000")


@query("z_remrangebyrank", "SELECT key, member, score FROM ZR WHERE NOT (r >= 2 AND r <= n - 3)")
def _(ks):
    return zsets.remove_by_rank(ks.zsets(), 2, -3)


@query("z_remrangebylex", "SELECT key, member, 0.0::DOUBLE AS score FROM X WHERE NOT (member >= 'a' AND member <= 'g')")
def _(ks):
    return zsets.remove_by_lex(ks.lex(), "[a", "[g")


@query("z_zscan", "SELECT key, member, score, printf('%.10f', score) AS score_text FROM Z WHERE regexp_full_match(member, '.5.*')")
def _(ks):
    return zsets.scan(ks.zsets(), "?5*")


# ---- geo

_HAV = "2 * 6372797.560856 * asin(sqrt(pow(sin((radians({y1}) - radians({y2})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin((radians({x1}) - radians({x2})) / 2), 2)))"


@query("geo_dist", f"WITH p AS (SELECT 'geo:cust' AS key, CAST(c_custkey AS VARCHAR) AS a, CAST(c_custkey + 1 AS VARCHAR) AS b FROM customer) SELECT p.key, p.a, p.b, round(({_HAV.format(x1='u.lng', y1='u.lat', x2='v.lng', y2='v.lat')}) / 1000.0, 3) AS distance FROM p LEFT JOIN (SELECT * FROM G) u ON u.member = p.a LEFT JOIN (SELECT * FROM G) v ON v.member = p.b")
def _(ks):
    c = F.col("c_custkey")
    pairs = ks._t("customer").select(F.lit("geo:cust").alias("key"), c.cast("string").alias("a"), (c + 1).cast("string").alias("b"))
    return geo.distance(ks.points(), pairs, "km").withColumn("distance", F.round("distance", 3))


@query("geo_radius_strict", f"SELECT member, round({_HAV.format(x1='lng', y1='lat', x2='15', y2='37')}, 3) AS distance FROM G WHERE {_HAV.format(x1='lng', y1='lat', x2='15', y2='37')} <= 3000000")
def _(ks):
    return geo.radius(ks.points(), 15.0, 37.0, 3000, "km").select("member", F.round("distance", 3).alias("distance"))


@query("geo_radius_bymember", f"WITH c AS (SELECT member AS centre, lng AS x, lat AS y FROM G WHERE member IN ('10', '20', '30')) SELECT c.centre, g.member, round({_HAV.format(x1='g.lng', y1='g.lat', x2='c.x', y2='c.y')}, 3) AS distance FROM c, (SELECT * FROM G) g WHERE {_HAV.format(x1='g.lng', y1='g.lat', x2='c.x', y2='c.y')} <= 1500000")
def _(ks):
    centres = ks.spark.createDataFrame([("geo:cust", "10"), ("geo:cust", "20"), ("geo:cust", "30")], "key string, centre string")
    return geo.radius_by_member(ks.points(), centres, 1500, "km").select("centre", "member", F.round("distance", 3).alias("distance"))


@query("geo_add")
def _(ks):
    return geo.add(ks.points())


@query("geo_hash")
def _(ks):
    return geo.text(geo.add(ks.points()))


@query("geo_pos", "SELECT key, member, round(lng, 3) AS lng, round(lat, 3) AS lat FROM G")
def _(ks):
    return geo.position(geo.add(ks.points())).select("key", "member", F.round("lng", 3).alias("lng"), F.round("lat", 3).alias("lat"))


@query("geo_radius_cells")
def _(ks):
    return geo.cells(geo.add(ks.points()), 15.0, 37.0, 3000, "km")


# ---- sampling


@query("rand_srandmember", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('1:' || key || ':' || member), member) AS r FROM M) WHERE r <= 10")
def _(ks):
    return sampling.sample(ks.sets(), "member", 10, seed=1)


@query("rand_srandmember_repeated", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS i, count(*) OVER (PARTITION BY key) AS m FROM M), d AS (SELECT DISTINCT key, m, unnest(range(1, 11)) AS draw FROM n), e AS (SELECT key, CAST(draw AS INTEGER) AS draw, CAST('0x' || substr(md5('1:' || key || ':' || draw), 1, 13) AS BIGINT) % m + 1 AS i FROM d) SELECT e.key, e.draw, n.member FROM e JOIN n ON n.key = e.key AND n.i = e.i")
def _(ks):
    return sampling.sample(ks.sets(), "member", -10, seed=1)


@query("rand_spop", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('2:' || key || ':' || member), member) AS r FROM M) WHERE r > 5")
def _(ks):
    return sampling.pop(ks.sets(), "member", 5, seed=2)[1]


@query("rand_hrandfield", "SELECT key, field, val FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('3:' || key || ':' || field), field) AS r FROM H) WHERE r <= 2")
def _(ks):
    return sampling.sample(ks.hashes(), "field", 2, seed=3)


@query("rand_hrandfield_repeated", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) AS i FROM H), d AS (SELECT DISTINCT key, unnest(range(1, 7)) AS draw FROM n), e AS (SELECT key, CAST(draw AS INTEGER) AS draw, CAST('0x' || substr(md5('3:' || key || ':' || draw), 1, 13) AS BIGINT) % 4 + 1 AS i FROM d) SELECT e.key, e.draw, n.field, n.val FROM e JOIN n ON n.key = e.key AND n.i = e.i")
def _(ks):
    return sampling.sample(ks.hashes(), "field", -6, seed=3)


@query("rand_randomkey", "SELECT key FROM KL ORDER BY md5('4:' || key), key LIMIT 1")
def _(ks):
    return keys.random_key(ks.keys(), AS_OF_MS, seed=4)


# ---- log, transactions, routing


def _log(ks: KeySpace) -> DataFrame:
    """seq, cmd, key, args of the events, every 400th a delete of its key."""
    gone = F.col("seq") % 400 == 0
    args = F.when(gone, F.array().cast("array<string>")).when(F.col("cmd") == "incr", F.array().cast("array<string>")).when(F.col("cmd") == "zincrby", F.array("arg2", "arg1")).when(F.col("cmd") == "hset", F.array("arg1", "arg2")).otherwise(F.array("arg1"))
    return ks.commands().select("seq", F.when(gone, "del").otherwise(F.col("cmd")).alias("cmd"), "key", args.alias("args"))


_KEYED = "SELECT event_id AS seq, event_id // 5 AS txn, event_type, user_id, value, props, CASE event_type WHEN 'click' THEN 'cnt:' || user_id WHEN 'view' THEN 'views:' || user_id WHEN 'purchase' THEN 'spend' WHEN 'signup' THEN 'user:' || user_id ELSE 'errors' END AS key FROM events"
_EFFECTIVE = f"k AS ({_KEYED}), d AS (SELECT key, max(seq) AS reset FROM k WHERE seq % 400 = 0 GROUP BY key), f AS (SELECT k.* FROM k LEFT JOIN d ON k.key = d.key WHERE k.seq % 400 <> 0 AND (d.reset IS NULL OR k.seq > d.reset))"


@query("log_fold_counters", f"WITH {_EFFECTIVE} SELECT key, CAST(count(*) AS VARCHAR) AS value FROM f WHERE event_type = 'click' GROUP BY key")
def _(ks):
    return fold.strings(fold.effective(_log(ks)))


@query("log_fold_lists", f"WITH {_EFFECTIVE} SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS pos, props AS val FROM f WHERE event_type = 'view'")
def _(ks):
    return fold.appended_lists(fold.effective(_log(ks)))


@query("log_fold_hashes", f"WITH {_EFFECTIVE} SELECT key, 'ts' AS field, CAST(max(seq) AS VARCHAR) AS val FROM f WHERE event_type = 'signup' GROUP BY key")
def _(ks):
    return fold.hashes(fold.effective(_log(ks)))


@query("log_fold_sets", f"WITH {_EFFECTIVE} SELECT DISTINCT key, CAST(user_id AS VARCHAR) AS member FROM f WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')")
def _(ks):
    return fold.sets(fold.effective(_log(ks)))


@query("log_fold_zsets", f"WITH {_EFFECTIVE} SELECT key, CAST(user_id AS VARCHAR) AS member, round(sum(value), 2) AS score FROM f WHERE event_type = 'purchase' GROUP BY key, user_id")
def _(ks):
    return fold.zsets(fold.effective(_log(ks))).withColumn("score", F.round("score", 2))


@query("log_fold_ordered", "SELECT 'user:' || user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS pos, props AS val FROM events WHERE event_type = 'view' ORDER BY 1")
def _(ks):
    log = _events(ks, "view").select(_user("user:"), F.col("event_id").alias("seq"), F.lit("lpush").alias("cmd"), F.array("props").alias("args"))
    return fold.ordered(log)[0]


@query(
    "log_fold_moves",
    "WITH s AS (SELECT user_id, event_type, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('click', 'signup')), "
    "t AS (SELECT user_id, max(n) AS n_last FROM s GROUP BY user_id) "
    "SELECT (CASE WHEN n = n_last THEN 'cnt:' ELSE 'old:' END) || s.user_id AS key, CAST(count(*) AS VARCHAR) AS value FROM s JOIN t ON s.user_id = t.user_id WHERE event_type = 'click' AND n >= n_last - 1 GROUP BY 1",
)
def _(ks):
    """Counters of clicks, each renamed at every signup of its user."""
    c = _events(ks, "click").select(_user("cnt:"), F.col("event_id").alias("seq"), F.lit("incr").alias("cmd"), F.array().cast("array<string>").alias("args"))
    renames = _events(ks, "signup").select(_user("cnt:"), F.col("event_id").alias("seq"), F.lit("rename").alias("cmd"), F.array(F.concat(F.lit("old:"), F.col("user_id").cast("string"))).alias("args"))
    return fold.strings(fold.effective(fold.settled(c.unionByName(renames))))


@query(
    "log_fold_state",
    f"WITH k AS ({_KEYED}), d AS (SELECT 'spend' AS key, max(seq) AS reset FROM k WHERE seq % 400 = 0), f AS (SELECT k.* FROM k LEFT JOIN d ON k.key = d.key WHERE d.reset IS NULL OR k.seq > d.reset) "
    "SELECT 'string' AS type, key, '' AS name, CAST(count(*) AS VARCHAR) AS val FROM f WHERE event_type = 'click' GROUP BY key "
    "UNION ALL SELECT 'list', key, CAST(row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS VARCHAR), props FROM f WHERE event_type = 'view' "
    "UNION ALL SELECT 'hash', key, 'ts', CAST(max(seq) AS VARCHAR) FROM f WHERE event_type = 'signup' GROUP BY key "
    "UNION ALL SELECT DISTINCT 'set', key, CAST(user_id AS VARCHAR), '' FROM f WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup') "
    "UNION ALL SELECT 'zset', key, CAST(user_id AS VARCHAR), CAST(round(sum(value)) AS BIGINT)::VARCHAR FROM f WHERE event_type = 'purchase' GROUP BY key, user_id",
)
def _(ks):
    """A mixed log written to files, read back and folded into all collections; every 400th command is followed by a delete that
    names two keys, of which the second is spend."""
    c = ks.commands()
    args = F.filter(F.array(*[F.when(F.col("cmd") == "zincrby", F.col(b)).when(F.col("cmd") == "incr", None).otherwise(F.col(a)) for a, b in (("arg1", "arg2"), ("arg2", "arg1"))]), lambda x: x.isNotNull())
    made = c.select((F.col("seq") * 2).alias("seq"), "cmd", "key", args.alias("args"))
    gone = c.where("seq % 400 = 0").select((F.col("seq") * 2 + 1).alias("seq"), F.lit("del").alias("cmd"), F.lit("nosuch").alias("key"), F.array(F.lit("spend")).alias("args"))
    path = live.shared_folder(ks.spark, "log")
    wire.write_log(made.unionByName(gone).withColumn("db", F.lit(0)).repartitionByRange("seq").sortWithinPartitions("seq"), path)
    # each fold uses its log several times, and the files are to be read once
    log = live.staged(fold.effective(live.staged(wire.in_order(wire.read_log(ks.spark, path)), "read")), "effective")
    none = F.lit("")
    return (
        fold.strings(log).select(F.lit("string").alias("type"), "key", none.alias("name"), F.col("value").alias("val"))
        .unionByName(fold.lists(log).select(F.lit("list").alias("type"), "key", F.col("pos").cast("string").alias("name"), "val"))
        .unionByName(fold.hashes(log).select(F.lit("hash").alias("type"), "key", F.col("field").alias("name"), "val"))
        .unionByName(fold.sets(log).select(F.lit("set").alias("type"), "key", F.col("member").alias("name"), none.alias("val")))
        .unionByName(fold.zsets(log).select(F.lit("zset").alias("type"), "key", F.col("member").alias("name"), F.round("score").cast("long").cast("string").alias("val")))
    )


@query("log_compact")
def _(ks):
    return fold.compact(ks.strings(), ks.lists(), ks.hashes(), ks.sets(), ks.zsets())


@query("log_txn_atomic", f"WITH k AS ({_KEYED}) SELECT seq, txn, key FROM k WHERE txn NOT IN (SELECT txn FROM k WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup') AND user_id % 10 = 0)")
def _(ks):
    return transactions.atomic(ks.commands(), (F.col("cmd") == "sadd") & (F.col("arg1").cast("long") % 10 == 0)).select("seq", "txn", "key")


@query(
    "log_watch_conflict",
    f"WITH k AS ({_KEYED}), f AS (SELECT txn, min(seq) AS run_at FROM k GROUP BY txn), w AS (SELECT DISTINCT k.txn, k.key, f.run_at - 5 AS seen_at, f.run_at FROM k JOIN f ON k.txn = f.txn) "
    "SELECT txn FROM f WHERE txn NOT IN (SELECT w.txn FROM w JOIN k ON k.key = w.key AND k.seq >= w.seen_at AND k.seq < w.run_at)",
)
def _(ks):
    """Each transaction watches all keys that it writes, five commands before its first one."""
    c = ks.commands()
    first = c.groupBy("txn").agg(F.min("seq").alias("run_at"))
    watches = c.select("txn", "key").distinct().join(first, "txn").select("txn", "key", (F.col("run_at") - 5).alias("seen_at"), "run_at")
    return transactions.without_conflicts(first.select("txn"), watches, c)


@query("log_validate", f"WITH k AS ({_KEYED}) SELECT seq, CASE WHEN seq % 11 = 0 THEN 'unknown command' WHEN seq % 13 = 0 AND event_type NOT IN ('view') THEN CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'wrong number of arguments' ELSE 'ok' END ELSE 'ok' END AS status FROM k")
def _(ks):
    """Every 13th command has an argument too many: sadd and rpush take any number."""
    log = ks.commands()
    args = F.when(F.col("cmd") == "incr", F.array("key")).when(F.col("cmd").isin("zincrby", "hset"), F.array("key", "arg1", "arg2")).otherwise(F.array("key", "arg1"))
    args = F.when(F.col("seq") % 13 == 0, F.concat(args, F.array(F.lit("more")))).otherwise(args)
    named = log.select("seq", F.when(F.col("seq") % 11 == 0, "nosuch").otherwise(F.col("cmd")).alias("cmd"), args.alias("args"))
    return transactions.validated(named, ks.spark).select("seq", "status")


@query("log_getkeys", f"WITH k AS ({_KEYED}) SELECT seq, key FROM k")
def _(ks):
    named = ks.commands().select("seq", "cmd", F.array("key", F.coalesce("arg1", F.lit("")), F.coalesce("arg2", F.lit(""))).alias("args"))
    return transactions.get_keys(named, ks.spark).select("seq", F.explode("keys").alias("key"))


@query("log_slowlog_topk", "SELECT event_id AS id, value AS duration FROM events WHERE value >= 50 ORDER BY event_id DESC LIMIT 20")
def _(ks):
    return transactions.slow_log(ks.events().select(F.col("event_id").alias("id"), F.col("value").alias("duration")), 50.0, 20)


@query("log_flush", "SELECT event_id AS seq FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id % 777 = 0)")
def _(ks):
    c = ks.commands()
    return keys.flush(c, c.where("seq % 777 = 0").select("seq")).select("seq")


@query("command_catalogue")
def _(ks):
    return transactions.catalogue(ks.spark)


@query("route_slot_histogram")
def _(ks):
    return transactions.slot_histogram(ks.keys())


@query("route_rebalance")
def _(ks):
    return transactions.rebalance(transactions.slot_histogram(ks.keys()), 3)


@query("route_hash_tag", "SELECT 'part:' || p_partkey AS key, CAST(p_partkey % 10 AS VARCHAR) AS tag FROM part")
def _(ks):
    k = F.concat(F.lit("part:{"), (F.col("p_partkey") % 10).cast("string"), F.lit("}:"), F.col("p_partkey").cast("string"))
    return ks._t("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), routing.hash_tag(k).alias("tag"))


@query("key_dump", """SELECT key, '[' || string_agg('{"pos":' || pos || ',"val":"' || val || '"}', ',' ORDER BY pos) || ']' AS dump FROM L GROUP BY key""")
def _(ks):
    return keys.dump(ks.lists(), "pos")


@query("zset_score_text")
def _(ks):
    return ks.zsets().select("key", "member", numbers.float_text("score").alias("text"))


# ---- streams


@query("pubsub_fanout", "WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)), s AS (SELECT c AS client, event_type FROM t, (SELECT unnest(range(0, 10)) AS c) WHERE (c + i) % 3 = 0) SELECT e.event_id AS seq, e.event_type AS channel, CAST(s.client AS INTEGER) AS client FROM events e JOIN s ON e.event_type = s.event_type")
def _(ks):
    names = ks.events().groupBy("event_type").count().select(F.array_sort(F.collect_set("event_type").over(_whole())).alias("all"), F.col("event_type").alias("channel"))
    i = F.array_position("all", F.col("channel")) - 1
    subscriptions = names.select("channel", i.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("client")).where((F.col("client") + F.col("i")) % 3 == 0)
    return live.fan_out(ks.events().select(F.col("event_id").alias("seq"), F.col("event_type").alias("channel")), subscriptions).select("seq", "channel", "client")


def _subscribed(ks: KeySpace) -> DataFrame:
    """Each customer listens to the channel of its nation: channel, client"""
    return ks._t("customer").select(_nation(), F.col("c_custkey").alias("client"))


def _nation():
    return F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("channel")


@query("pubsub_subscribe", "SELECT 'nation:' || c_nationkey AS channel, c_custkey AS client FROM customer UNION SELECT 'segment:' || c_mktsegment, c_custkey FROM customer")
def _(ks):
    new = ks._t("customer").select(F.concat(F.lit("segment:"), "c_mktsegment").alias("channel"), F.col("c_custkey").alias("client"))
    return live.subscribe(_subscribed(ks), new.unionByName(_subscribed(ks)))


@query("pubsub_unsubscribe", "SELECT 'nation:' || c_nationkey AS channel, c_custkey AS client FROM customer WHERE c_custkey % 5 > 1")
def _(ks):
    """One in five leaves its channel, another all of them."""
    c = ks._t("customer")
    gone = c.where("c_custkey % 5 < 2").select(F.when(F.col("c_custkey") % 5 == 0, _nation()).alias("channel"), F.col("c_custkey").alias("client"))
    return live.unsubscribe(_subscribed(ks), gone)


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


@query("stream_fold_available_now", "SELECT 'cnt:' || user_id AS key, count(*) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def _(ks):
    steps = lambda s: s.where("event_type = 'click'").select(_user("cnt:"), F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("delta"), F.lit(None).cast("long").alias("expire_at_ms"))
    return live.fold_available(ks.spark, ks.sf_dir, ks.events().schema, steps, pattern="events.parquet")
