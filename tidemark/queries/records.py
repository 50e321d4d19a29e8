"""Queries over logs and tables: latest rows, upserts, folds, chains, health, name matching."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import records, state
from ..operators import tables as ops
from ..plans import documents
from ..shared import cut, shared_folder
from ..sources.files import append_records, read_records
from . import base
from .base import query


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_user(spark, d):
    """LATEST2, SNK8: the last record of each key."""
    return ops.latest_by(base.read(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_id", "event_type", "value"])


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def latest_snapshot(spark, d):
    """LATEST1, AGG3: rows of the last day."""
    e = base.read(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return ops.latest_snapshot(e, "day").select("event_id", "user_id")


@query(
    """SELECT event_type AS source, max(ts) FILTER (WHERE value >= 50) AS last_ok, max(ts) AS last_any, arg_max(event_id, (ts, event_id)) AS last_id, count(*) AS n
    FROM events GROUP BY event_type"""
)
def source_health(spark, d):
    """AGG1, AGG2: last success, last entry and its id by source."""
    e = base.read(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("source")).agg(F.max(F.when(F.col("value") >= 50, F.col("ts"))).alias("last_ok"), F.max("ts").alias("last_any"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"), F.count("*").alias("n"))


@query(
    """SELECT user_id FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    WHERE r <= 3 GROUP BY user_id HAVING count(*) = 3 AND bool_and(value < 60)"""
)
def consecutive_failures(spark, d):
    """WIN7, AGG22, VAL10: sources whose last three entries failed."""
    e = base.read(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") >= 60).alias("ok"))
    return ops.consecutive_failures(e, "user_id", [F.desc("ts"), F.desc("event_id")], "ok")


def _split(spark, d):
    o = base.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("seen"))
    old = o.where("o_orderkey % 3 <> 0")
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"), F.date_add("seen", 7).alias("seen"))
    return old, new


_OLD = "old AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS seen FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "new AS (SELECT o_orderkey, o_custkey, round(o_totalprice * 2, 2) AS o_totalprice, CAST(CAST(o_orderdate AS DATE) + 7 AS DATE) AS seen FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_or_ignore(spark, d):
    """SNK1: keys that aren't there yet."""
    return ops.insert_new(*_split(spark, d), ["o_orderkey"], F.col("seen"))


@query(f"WITH {_OLD}, {_NEW} SELECT o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(o.seen, n.seen) AS seen FROM old o FULL JOIN new n USING (o_orderkey)")
def upsert_keep_first_seen(spark, d):
    """SNK2, SNK3: new values, first observation kept."""
    return ops.upsert_keep_first(*_split(spark, d), ["o_orderkey"], ["o_custkey", "o_totalprice"], ["seen"]).select("o_orderkey", "o_custkey", "o_totalprice", "seen")


@query(f"WITH {_OLD}, {_NEW} SELECT o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(n.seen, o.seen) AS seen FROM old o FULL JOIN new n USING (o_orderkey)")
def insert_or_replace(spark, d):
    """SNK5: the new row wins whole."""
    return ops.replace_rows(*_split(spark, d), ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice", "seen")


@query(
    f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_custkey, CASE WHEN n.o_orderkey IS NOT NULL THEN CASE WHEN n.o_orderkey % 10 = 0 THEN NULL ELSE n.o_totalprice END ELSE o.o_totalprice END AS o_totalprice, o.seen
    FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey"""
)
def partial_column_upsert(spark, d):
    """SNK4: one column is overwritten, by nulls too; the others stay."""
    old, new = _split(spark, d)
    new = new.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")))
    return ops.partial_upsert(old, new, ["o_orderkey"], ["o_totalprice"])


def chained(spark, d):
    """Conversations as a hash chain: each turn's hash covers the text and number of the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = base.read(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("seq"), "text")
    own = F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256)
    c = c.withColumn("own", own)
    prev = F.coalesce(F.lag("own").over(w), F.lit("0" * 64))
    return c.withColumn("prev", F.when(F.col("conv_id") % 9 == 4, F.lit("x")).otherwise(prev))


@query(
    """SELECT conv_id, turn FROM (SELECT *, coalesce(lag(own) OVER w, repeat('0', 64)) AS before, row_number() OVER w AS n,
        CASE WHEN conv_id % 9 = 4 THEN 'x' ELSE coalesce(lag(own) OVER w, repeat('0', 64)) END AS prev
        FROM (SELECT conv_id, turn, sha256(conv_id || ':' || turn || ':' || coalesce(text, '')) AS own FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE prev <> before OR n <> turn + 1"""
)
def hash_chain_audit(spark, d):
    """WIN8, VAL6, SNK7: rows whose predecessor doesn't fit."""
    return ops.chain_breaks(chained(spark, d), "conv_id", "seq", "prev", "own").select("conv_id", "turn")


@query(
    r"""WITH RECURSIVE body AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations),
    json AS (SELECT *, ', "_seq": ' || seq || ', "conv_id": ' || conv_id || ', "role": ' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ', "text": ' AS front, ', "turn": ' || turn || '}' AS back FROM body),
    linked AS (SELECT conv_id, seq, repeat('0', 64) AS prev, sha256('{"_kind": "turn", "_prev_hash": "' || repeat('0', 64) || '"' || front || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || back) AS own FROM json WHERE seq = 1
        UNION ALL SELECT j.conv_id, j.seq, l.own, sha256('{"_kind": "turn", "_prev_hash": "' || l.own || '"' || front || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || back) FROM linked l JOIN json j ON j.conv_id = l.conv_id AND j.seq = l.seq + 1)
    SELECT conv_id, seq AS _seq, prev AS _prev_hash, own AS _hash FROM linked"""
)
def record_log(spark, d):
    """SRC20, SNK7-8: a log of conversations, first turns of one night, the others of the next, whose chains go on from what the
    log says was last; read back from its lines."""
    path = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    turns = base.read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    payload = "conv_id long, turn long, role string, text string"
    append_records(records.chain(turns.where("turn < 2"), "turn", "turn", by=["conv_id"]), path)
    before = records.last_of(read_records(spark, path, payload), ["conv_id"])
    append_records(records.chain(turns.where("turn >= 2"), "turn", "turn", after=cut(before), by=["conv_id"]), path)
    return read_records(spark, path, payload).select("conv_id", "_seq", "_prev_hash", "_hash")


def written_turns(spark, d):
    """Conversations as records: a chain each, as written."""
    turns = base.read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return records.chain(turns, "turn", "turn", by=["conv_id"])


@query(
    r"""WITH RECURSIVE body AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations),
    json AS (SELECT *, ', "_seq": ' || seq || ', "conv_id": ' || conv_id || ', "role": ' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ', "text": ' AS front, ', "turn": ' || turn || '}' AS back FROM body),
    linked AS (SELECT conv_id, seq, repeat('0', 64) AS prev, sha256('{"_kind": "turn", "_prev_hash": "' || repeat('0', 64) || '"' || front || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || back) AS own FROM json WHERE seq = 1
        UNION ALL SELECT j.conv_id, j.seq, l.own, sha256('{"_kind": "turn", "_prev_hash": "' || l.own || '"' || front || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || back) FROM linked l JOIN json j ON j.conv_id = l.conv_id AND j.seq = l.seq + 1),
    stored AS (SELECT j.conv_id, j.seq, j.front, j.back, CASE WHEN j.conv_id % 11 = 1 AND j.seq = 2 THEN coalesce(text, '') || '!' ELSE text END AS text,
            CASE WHEN j.conv_id % 11 = 2 AND j.seq = 2 THEN repeat('f', 64) ELSE prev END AS prev,
            CASE WHEN j.conv_id % 11 = 3 AND j.seq = max(j.seq) OVER (PARTITION BY j.conv_id) THEN repeat('e', 64) ELSE own END AS own
        FROM json j JOIN linked USING (conv_id, seq)),
    kept AS (SELECT *, sha256('{"_kind": "turn", "_prev_hash": "' || prev || '"' || front || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || back) AS anew FROM stored WHERE NOT (conv_id % 11 = 4 AND seq = 2)),
    met AS (SELECT k.*, b.own AS before FROM kept k LEFT JOIN kept b ON b.conv_id = k.conv_id AND b.seq = k.seq - 1)
    SELECT conv_id, seq AS _seq, 'number' AS problem FROM met WHERE seq > 1 AND before IS NULL
    UNION ALL SELECT conv_id, seq, 'link' FROM met WHERE prev IS DISTINCT FROM CASE WHEN seq = 1 THEN repeat('0', 64) ELSE before END
    UNION ALL SELECT conv_id, seq, 'content' FROM met WHERE own <> anew"""
)
def record_audit(spark, d):
    """WIN8, VAL6, SC28, SNK7: chains of whole records; of every eleven conversations one has a changed text, one a wrong
    link, one a forged last hash, one a missing record, and each of these is told by its kind."""
    from pyspark.sql import Window

    k, last = F.col("conv_id") % 11, F.max("_seq").over(Window.partitionBy("conv_id"))
    stored = written_turns(spark, d).withColumn("__last", last)
    second = F.col("_seq") == 2
    forged = stored.withColumns(
        {
            "text": F.when((k == 1) & second, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")),
            "_prev_hash": F.when((k == 2) & second, F.repeat(F.lit("f"), 64)).otherwise(F.col("_prev_hash")),
            "_hash": F.when((k == 3) & (F.col("_seq") == F.col("__last")), F.repeat(F.lit("e"), 64)).otherwise(F.col("_hash")),
        }
    ).where(~((k == 4) & second))
    return records.audit(cut(forged.drop("__last")), ["conv_id"]).select("conv_id", "_seq", "problem")


# What an order should look like as a document; many don't.
ORDER_FORM = documents.record(
    {
        "key": {"type": "integer"}, "date": documents.DAY, "status": documents.one_of("F", "O"), "total": {"type": "number"},
        "priority": {"type": "string", "minLength": 6, "pattern": "^[1-4]-"},
        "lines": documents.listed(
            documents.record({"no": documents.FROM_ONE, "quantity": {"type": "integer", "maximum": 45}, "discount": {"type": "number", "minimum": 0.01}, "flag": documents.one_of("A", "N")}),
            minItems=1, maxItems=6,
        ),
    },
    {"remark": documents.or_null("string")},
)


def order_documents(spark, d):
    """(o_orderkey, text): orders with their lines as JSON; some lack the date or have it in another form, have a total in quotes, a
    key that isn't known or no closing brace."""
    k = F.col("o_orderkey")
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))
    lines = base.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))  # an order's own lines
    o = base.read(spark, d, "orders").join(lines, "o_orderkey", "left")
    day = F.when(k % 29 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    fields = [
        k.alias("key"), F.when(k % 19 != 0, day).alias("date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"), F.when(k % 23 == 0, "x").alias("note"),
    ]
    quoted = F.to_json(F.struct(*fields, F.col("o_totalprice").cast("string").alias("total")))
    plain = F.to_json(F.struct(*fields, F.col("o_totalprice").alias("total")))
    text = F.when(k % 17 == 0, quoted).otherwise(plain)
    return o.select("o_orderkey", F.when(k % 101 == 0, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("text"))


@query(
    """WITH lines AS (SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_returnflag) - 1 AS i, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem),
    sizes AS (SELECT o_orderkey, count(*) AS n FROM lines GROUP BY 1),
    found AS (
        SELECT o_orderkey, '' AS k1, -1 AS i, '' AS k2, '(全体)' AS path, 'date is required' AS text FROM orders WHERE o_orderkey % 19 = 0
        UNION ALL SELECT o_orderkey, '', -1, '', '(全体)', 'not allowed: note' FROM orders WHERE o_orderkey % 23 = 0
        UNION ALL SELECT o_orderkey, 'date', -1, '', 'date', 'not a date' FROM orders WHERE o_orderkey % 29 = 0 AND o_orderkey % 19 <> 0
        UNION ALL SELECT o_orderkey, 'lines', -1, '', 'lines', 'fewer than 1 items' FROM orders ANTI JOIN sizes USING (o_orderkey)
        UNION ALL SELECT o_orderkey, 'lines', -1, '', 'lines', 'more than 6 items' FROM sizes WHERE n > 6
        UNION ALL SELECT o_orderkey, 'lines', i, 'discount', 'lines/' || i || '/discount', 'less than the minimum of 0.01' FROM lines WHERE l_discount < 0.01
        UNION ALL SELECT o_orderkey, 'lines', i, 'flag', 'lines/' || i || '/flag', 'not one of A, N' FROM lines WHERE l_returnflag NOT IN ('A', 'N')
        UNION ALL SELECT o_orderkey, 'lines', i, 'quantity', 'lines/' || i || '/quantity', 'greater than the maximum of 45' FROM lines WHERE l_quantity > 45
        UNION ALL SELECT o_orderkey, 'lines', i, 'quantity', 'lines/' || i || '/quantity', 'not of type integer' FROM lines WHERE l_quantity <> floor(l_quantity)
        UNION ALL SELECT o_orderkey, 'priority', -1, '', 'priority', 'doesn''t match ^[1-4]-' FROM orders WHERE o_orderpriority[1] NOT IN ('1', '2', '3', '4')
        UNION ALL SELECT o_orderkey, 'priority', -1, '', 'priority', 'shorter than 6' FROM orders WHERE length(o_orderpriority) < 6
        UNION ALL SELECT o_orderkey, 'status', -1, '', 'status', 'not one of F, O' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
        UNION ALL SELECT o_orderkey, 'total', -1, '', 'total', 'not of type number' FROM orders WHERE o_orderkey % 17 = 0),
    told AS (SELECT o_orderkey, count(*) AS n, string_agg(path || ': ' || text, ' | ' ORDER BY k1, i, k2, text) AS errors FROM found GROUP BY 1)
    SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE coalesce(n, 0) END AS INTEGER) AS n_errors,
        CASE WHEN o_orderkey % 101 = 0 THEN '(全体): not JSON' ELSE coalesce(errors, '') END AS errors FROM orders LEFT JOIN told USING (o_orderkey)"""
)
def document_errors(spark, d):
    """VAL1, VAL8, SRC26: what is wrong with each document by its schema, sorted by path: kinds, values, bounds, lengths, patterns,
    dates, missing and unknown keys, and texts that are no JSON."""
    # The check costs much more than moving a document, so small inputs aren't left to the few tasks that their size would give.
    docs = order_documents(spark, d).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "o_orderkey")
    told = documents.checked(docs, ORDER_FORM)
    return told.select("o_orderkey", F.size("errors").alias("n_errors"), F.array_join("errors", " | ").alias("errors"))


@query(
    """WITH r AS (SELECT user_id, event_id AS s, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'signup' THEN 0 WHEN event_type IN ('view', 'click', 'purchase') THEN 3 ELSE 4 END AS k, event_type, event_id AS i,
        CASE event_type WHEN 'view' THEN '強化' WHEN 'click' THEN '起動' ELSE CASE WHEN event_id % 50 = 0 THEN '消滅' ELSE '弱体化' END END AS change,
        ['Weak', 'Weak+', 'Medium', 'Strong'][event_id % 4 + 1] AS strength, CASE WHEN event_type = 'signup' OR event_id % 6 = 0 THEN value END AS rise FROM events),
    sc AS (SELECT user_id, CASE WHEN max(s) % 2 = 0 THEN '進行中' ELSE '待機' END AS st0, arg_max(strength, s) AS str0, arg_max(day, s) AS d0, arg_max(rise, s) AS rise0 FROM r WHERE k = 0 GROUP BY 1),
    u AS (SELECT r.*, st0 FROM r JOIN sc USING (user_id) WHERE k = 3),
    dead AS (SELECT user_id, min(s) AS dead FROM u WHERE change = '消滅' GROUP BY 1),
    wake AS (SELECT user_id, min(s) AS wake, arg_min(day, s) AS wday FROM u LEFT JOIN dead USING (user_id) WHERE change = '起動' AND st0 = '待機' AND (dead IS NULL OR s < dead) GROUP BY 1),
    renew AS (SELECT user_id, arg_max(day, s) AS rday FROM u LEFT JOIN dead USING (user_id) LEFT JOIN wake USING (user_id) WHERE change = '強化' AND (dead IS NULL OR s < dead) AND (st0 = '進行中' OR s > wake) GROUP BY 1),
    up AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n, arg_max(strength, s) AS strength, arg_max(rise, s) FILTER (WHERE rise IS NOT NULL) AS rise, CAST(count(rise) AS INTEGER) AS versions FROM u GROUP BY 1),
    told AS (SELECT user_id, ['進行中', '休眠', '終了'][max(s) % 3 + 1] AS last, arg_min(day, s) FILTER (WHERE s % 3 = 0) AS bday FROM r WHERE k = 4 GROUP BY 1)
    SELECT user_id, coalesce(last, CASE WHEN dead IS NOT NULL THEN '終了' WHEN wake IS NOT NULL THEN '進行中' ELSE st0 END) AS status, coalesce(up.strength, str0) AS strength,
        coalesce(wday, CASE WHEN st0 = '進行中' THEN d0 END, bday) AS started_date, coalesce(rday, wday, CASE WHEN st0 = '進行中' THEN d0 END, bday) AS clock_date,
        CASE WHEN last IS NOT NULL THEN '予定' WHEN dead IS NOT NULL THEN 'シナリオが崩れた' END AS end_reason, coalesce(n, 0) AS n_updates, coalesce(up.rise, rise0) AS rise, 1 + coalesce(versions, 0) AS rise_version
    FROM sc LEFT JOIN dead USING (user_id) LEFT JOIN wake USING (user_id) LEFT JOIN renew USING (user_id) LEFT JOIN up USING (user_id) LEFT JOIN told USING (user_id)"""
)
def scenario_state_fold(spark, d):
    """STF1, JN4: events as records of scenarios, folded by kind and sequence; users without a scenario row are dropped."""
    e, i = base.read(spark, d, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type").isin("view", "click", "purchase"), 3).otherwise(4)
    change = F.when(F.col("event_type") == "view", "強化").when(F.col("event_type") == "click", "起動").when(i % 50 == 0, "消滅").otherwise("弱体化")
    status = F.when(kind == 0, F.when(i % 2 == 0, "進行中").otherwise("待機")).when(kind == 4, F.when(i % 3 == 0, "進行中").when(i % 3 == 1, "休眠").otherwise("終了"))
    strength = F.element_at(F.array(*map(F.lit, ["Weak", "Weak+", "Medium", "Strong"])), (i % 4 + 1).cast("int"))
    rise = F.when((kind == 0) | (i % 6 == 0), F.col("value"))
    return state.fold(e, "user_id", kind, i, F.to_date("ts"), change, status, strength, F.when(kind == 4, F.lit("予定")), rise)


@query(
    """SELECT user_id, arrow, CASE WHEN u > p THEN told ELSE own END AS status FROM (
        SELECT user_id, event_id % 5 AS arrow, max(event_id) FILTER (WHERE event_type <> 'error') AS p, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'error') AS own,
               max(event_id) FILTER (WHERE event_type = 'error') AS u, arg_max(CASE WHEN value > 50 THEN '確認' ELSE '否定' END, event_id) FILTER (WHERE event_type = 'error') AS told
        FROM events GROUP BY 1, 2) WHERE p IS NOT NULL"""
)
def plan_status_overlay(spark, d):
    """STF2, JN5: status rows overlay the last plain row of an arrow."""
    told = F.when(F.col("value") > 50, "確認").otherwise("否定")
    e = base.read(spark, d, "events").select("user_id", (F.col("event_id") % 5).alias("arrow"), "event_id", (F.col("event_type") == "error").alias("is_update"), F.when(F.col("event_type") == "error", told).otherwise(F.col("event_type")).alias("status"))
    return state.plan_status(e, ["user_id", "arrow"], "event_id")


@query(
    """SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, c_nationkey, lower(regexp_replace(c_name, '^Customer#0*', '')) AS a FROM customer WHERE length(regexp_replace(c_name, '^Customer#0*', '')) >= 2) c
    JOIN (SELECT s_suppkey, s_nationkey, lower(regexp_replace(s_name, '^Supplier#0*', '')) AS b FROM supplier WHERE length(regexp_replace(s_name, '^Supplier#0*', '')) >= 2) s
    ON c_nationkey = s_nationkey AND (contains(a, b) OR contains(b, a))"""
)
def name_match_containment(spark, d):
    """JN18: equal code and either name holds the other."""
    bare = lambda c, p: F.lower(F.regexp_replace(c, f"^{p}#0*", ""))
    c = base.read(spark, d, "customer").select("c_custkey", "c_nationkey", bare("c_name", "Customer").alias("a")).where("length(a) >= 2")
    s = base.read(spark, d, "supplier").select("s_suppkey", "s_nationkey", bare("s_name", "Supplier").alias("b")).where("length(b) >= 2")
    return ops.containment_pairs(c, s, ("c_nationkey", "s_nationkey"), ("a", "b")).select("c_custkey", "s_suppkey")


@query(
    """SELECT o_custkey FROM (SELECT o_custkey, min(CAST(substring(o_orderpriority, 1, 1) AS INTEGER)) AS tier FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) WHERE tier >= 3"""
)
def low_tier_only(spark, d):
    """AGG8, JN22: keys whose supporting evidence is all of tier 3 or worse."""
    o = base.read(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.groupBy("o_custkey").agg(F.min(F.substring("o_orderpriority", 1, 1).cast("int")).alias("tier")).where("tier >= 3").select("o_custkey")


@query("SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def pending_anti_join(spark, d):
    """JN13, JN14, FLT13: keys of one log that another doesn't have."""
    done = base.read(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return base.read(spark, d, "orders").where("o_orderstatus = 'F'").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(spark, d):
    """SRC20: typed fields of JSON records."""
    return base.read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    """SELECT r.*, reasons AS skip_reasons FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS runs, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS executed, CAST(count_if(o_orderstatus <> 'F') AS BIGINT) AS skipped,
        strftime(date_trunc('month', min(o_orderdate)) - INTERVAL 1 MONTH, '%Y-%m') AS previous_month FROM orders GROUP BY 1) r
    LEFT JOIN (SELECT month, string_agg(reason || ':' || n, ',' ORDER BY reason) AS reasons FROM (
        SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS reason, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2) GROUP BY 1) USING (month)"""
)
def monthly_operation(spark, d):
    """AGG18, FLT8, SC24, SC29: executed and skipped runs by month, and how often each reason to skip was given."""
    o = base.read(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    f = F.col("o_orderstatus") == "F"
    one = o.groupBy("month", "o_orderpriority").agg(F.count("*").alias("n"), F.count_if(f).alias("ran"), F.min("o_orderdate").alias("first"))
    reason = F.when(F.col("n") > F.col("ran"), F.concat_ws(":", "o_orderpriority", (F.col("n") - F.col("ran")).cast("string")))
    return one.groupBy("month").agg(  # a row for each reason
        F.sum("n").alias("runs"), F.sum("ran").alias("executed"), (F.sum("n") - F.sum("ran")).alias("skipped"),
        F.date_format(F.add_months(F.trunc(F.min("first"), "MM"), -1), "yyyy-MM").alias("previous_month"), F.nullif(F.array_join(F.array_sort(F.collect_list(reason)), ","), F.lit("")).alias("skip_reasons"),
    )


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN least(greatest(CAST(o_orderkey % 40 AS INTEGER), 5), 20) ELSE CAST(o_orderkey % 40 AS INTEGER) END AS expected_days,
    list_sort([o_orderkey % 7, o_orderkey % 5, o_orderkey % 3])[1] AS low, list_sort([o_orderkey % 7, o_orderkey % 5, o_orderkey % 3])[2] AS median, list_sort([o_orderkey % 7, o_orderkey % 5, o_orderkey % 3])[3] AS high FROM orders"""
)
def commit_normalisation(spark, d):
    """SC22, SC23: reordered triples and clamped spans."""
    k = F.col("o_orderkey")
    three, days = F.array_sort(F.array(k % 7, k % 5, k % 3)), (k % 40).cast("int")
    span = F.when(F.col("o_orderstatus") == "O", F.least(F.greatest(days, F.lit(5)), F.lit(20))).otherwise(days)
    return base.read(spark, d, "orders").select("o_orderkey", span.alias("expected_days"), three[0].alias("low"), three[1].alias("median"), three[2].alias("high"))
