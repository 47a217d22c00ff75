"""Queries for times, single mutations, quarantine and whole flows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillroster.functions import money as M
from quillroster.functions import text as X
from quillroster.functions import timeops as D
from quillroster.operators import decisions, mutate, outbox, payments, pending, queue, reconcile, resolve, views
from quillroster.plans import domain
from quillroster.plans.registry import query
from quillroster.sources import readers, schemas, sinks
from quillroster.sources.staging import fresh_path, staged
from quillroster.streaming import updates
from quillroster.streaming.payments import Ledger, apply_stream

#: A moment within the tables' range.
NOW = "1997-06-01 00:00:00"
_MOSCOW = "((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Moscow')"
_KIND = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'TEAM' WHEN o_orderpriority = '5-LOW' THEN 'Personal' ELSE o_orderpriority END"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return readers.table(spark, folder, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))


def _kind() -> Column:
    return F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "TEAM").when(F.col("o_orderpriority") == "5-LOW", "Personal").otherwise(F.col("o_orderpriority"))


def _epoch(ts: Column) -> Column:
    return F.unix_seconds(ts)


@query(f"""
    SELECT o_custkey AS source, CAST(o_orderkey AS VARCHAR) AS title, CAST(epoch(o_orderdate - INTERVAL 3 HOUR) AS BIGINT) AS starts, CAST(o_orderkey % 9000 AS INT) AS price_rub,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'team' ELSE 'personal' END AS tournament_type, 2 AS names FROM orders""")
def s1_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as snapshot documents, one for each customer, read back as events."""
    place = F.struct(F.col("o_orderkey").cast("string").alias("title"), F.lit("").alias("location"), F.concat((F.col("o_orderkey") % 9000).cast("string"), F.lit(" R")).alias("price"))
    event = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("start_datetime"), _kind().alias("tournament_type"), F.array(F.lit("A"), F.lit(""), F.lit("B")).alias("participants"), place.alias("tournament"))
    docs = _orders(spark, folder).groupBy(F.col("o_custkey").alias("file")).agg(F.to_json(F.struct(F.collect_list(event).alias("tournaments"))).alias("value")).withColumn("modified_at", _now())
    rows = readers.snapshot_rows(docs)
    return rows.select(F.col("file").alias("source"), "title", _epoch(F.col("starts_at")).alias("starts"), "price_rub", "tournament_type", F.size("participants").alias("names"))


@query("""
    SELECT o_orderkey AS id, CAST(CASE o_orderkey % 6 WHEN 0 THEN epoch_us(o_orderdate) - 3 * 3600000000 WHEN 1 THEN epoch_us(date_trunc('minute', o_orderdate)) - 3 * 3600000000 WHEN 2 THEN epoch_us(date_trunc('second', o_orderdate))
        WHEN 3 THEN epoch_us(date_trunc('day', o_orderdate)) - 3 * 3600000000 WHEN 5 THEN epoch_us(date_trunc('second', o_orderdate)) + 500000 - 5 * 3600000000 END AS BIGINT) AS micros FROM orders""")
def d1_source_times(spark: SparkSession, folder: str) -> DataFrame:
    shown = lambda f: F.date_format("o_orderdate", f)
    forms = [shown("yyyy-MM-dd HH:mm:ss.SSSSSS"), shown("yyyy-MM-dd'T'HH:mm'+03:00'"), shown("yyyy-MM-dd'T'HH:mm:ss'Z'"), shown("yyyy-MM-dd"), shown("dd/MM/yyyy"), shown("yyyy-MM-dd'T'HH:mm:ss'.5+0500'")]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), F.unix_micros(D.parse_source_time(text)).alias("micros"))


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE strftime({_MOSCOW}, '%d.%m.%Y %H:%M') END AS shown FROM orders")
def d2_shown_text(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), D.shown_text(F.when(F.col("o_orderkey") % 5 != 0, F.col("at")), "-").alias("shown"))


@query("SELECT event_id AS id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS at FROM events")
def d3_to_second(spark: SparkSession, folder: str) -> DataFrame:
    return readers.table(spark, folder, "events").select(F.col("event_id").alias("id"), F.date_format(D.to_second(F.col("ts")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query(f"SELECT DISTINCT strftime({_MOSCOW}, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '{NOW}' ORDER BY day LIMIT 10")
def d4_shown_dates(spark: SparkSession, folder: str) -> DataFrame:
    t = domain.tournaments(spark, folder).withColumn("starts_at", F.col("starts_at").cast("timestamp"))
    return views.upcoming_dates(t, _now()).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""
    SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') || ':00' END AS at FROM orders""")
def d6_naive_times(spark: SparkSession, folder: str) -> DataFrame:
    shown = lambda f: F.date_format("o_orderdate", f)
    forms = [shown("yyyy-MM-dd HH:mm:ss"), shown("yyyy-MM-dd'T'HH:mm:ss'+03:00'"), shown("yyyy-MM-dd HH:mm"), shown("dd.MM.yyyy HH:mm")]
    parsed = D.parse_naive_time(F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority ELSE strftime(o_orderdate, '%d.%m.%Y') END AS shown, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""")
def d7_date_labels(spark: SparkSession, folder: str) -> DataFrame:
    text = F.element_at(F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.col("o_orderpriority")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), D.date_labels(text).alias("l")).select("id", "l.shown", "l.iso")


@query(f"SELECT o_orderkey AS id, CAST(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(o_orderdate))) / 3600) AS BIGINT) AS hours FROM orders")
def d8_age_hours(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), D.age_hours(F.col("at"), _now()).alias("hours"))


@query(f"SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_orderstatus <> 'P' AND strftime({_MOSCOW}, '%Y-%m-%d') = (SELECT strftime(max({_MOSCOW}), '%Y-%m-%d') FROM orders)")
def f12_on_date(spark: SparkSession, folder: str) -> DataFrame:
    t = domain.tournaments(spark, folder).withColumn("starts_at", F.col("starts_at").cast("timestamp")).withColumn("location", F.lit(""))
    last = t.agg(F.max(D.shown_date(F.col("starts_at"))).alias("last"))  # one row
    return views.on_date(t.crossJoin(F.broadcast(last)), F.col("last")).select("id", "title")


@query("SELECT o_orderkey AS id, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), o_orderpriority) AS filled FROM orders")
def f16_first_filled(spark: SparkSession, folder: str) -> DataFrame:
    own = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus"))
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), X.first_filled(own, F.col("o_orderpriority")).alias("filled"))


@query("""
    WITH e AS (SELECT o_orderkey AS position, date_trunc('second', o_orderdate) AS sec, unnest([o_orderpriority, o_orderstatus]) AS name FROM orders),
    a AS (SELECT o_orderkey AS ask_id, date_trunc('second', o_orderdate) AS sec, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE 'none' END AS name FROM orders)
    SELECT ask_id, min(position) AS position FROM a JOIN e USING (sec, name) GROUP BY 1""")
def j13_match_events(spark: SparkSession, folder: str) -> DataFrame:
    o = _orders(spark, folder)
    name = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus")).otherwise("none")
    asked = o.select(F.col("o_orderkey").alias("ask_id"), name.alias("place_name"), F.col("at").alias("starts_at"))
    return views.match_events(asked, o.select(F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("location"), F.col("o_orderstatus").alias("title"), F.col("at").alias("starts_at")))


_ENTRIES = """
    e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS t, min(l_suppkey) AS p, min(CASE WHEN l_linestatus = 'F' THEN 'paid' ELSE 'pending' END) AS status, bool_and(l_returnflag <> 'R') AS active, l_linenumber AS place, min(l_shipdate) AS created
          FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _least_status() -> Column:
    """The least of paid and pending, without the sorting that a least string takes."""
    return F.when(F.bool_or(F.col("payment_status") == "paid"), "paid").otherwise("pending").alias("payment_status")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries, those that repeat a key folded into one, with all the table's columns."""
    e = domain.entries(spark, folder).groupBy("id", "tournament_id", "place").agg(F.min("player_id").alias("player_id"), _least_status(), F.bool_and("active").alias("active"), F.min("created_at").cast("timestamp").alias("created_at"))
    return schemas.conform(e, "entries")


def _people(spark: SparkSession, folder: str) -> DataFrame:
    p = domain.players(spark, folder)
    return schemas.conform(p.select("id", "full_name", F.lower("full_name").alias("normalized_name"), F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("telegram_id")), "players")


def _batch(spark: SparkSession, folder: str, limit: int | None) -> DataFrame:
    t = domain.tournaments(spark, folder).withColumn("starts_at", F.col("starts_at").cast("timestamp"))
    return queue.work_batch(_entries(spark, folder), _people(spark, folder), t, _now(), limit)


_DUE = f"""
    WITH {_ENTRIES}, due AS (SELECT e.*, CASE WHEN NOT active THEN 'inactive' WHEN p % 5 = 0 THEN 'no_telegram_id' ELSE 'send' END AS outcome FROM e JOIN orders ON o_orderkey = e.t JOIN supplier ON s_suppkey = p
         WHERE status = 'pending' AND o_orderdate > TIMESTAMP '{NOW}' - INTERVAL 3 HOUR)"""


@query(_DUE + " SELECT id AS entry_id, outcome FROM due ORDER BY created, id LIMIT 50")
def o4_work_batch(spark: SparkSession, folder: str) -> DataFrame:
    return _batch(spark, folder, 50).select("entry_id", "outcome")


@query(_DUE + " SELECT count(*) AS processed, count(*) FILTER (WHERE outcome = 'send') AS notified FROM due")
def a11_batch_totals(spark: SparkSession, folder: str) -> DataFrame:
    return queue.batch_totals(_batch(spark, folder, None))


@query(_DUE + " SELECT e.id, due.id IS NOT NULL AS linked, coalesce(due.outcome = 'send', false) AS telegram_notified FROM e LEFT JOIN due ON due.id = e.id")
def o7_queue_drained(spark: SparkSession, folder: str) -> DataFrame:
    """The queue applied until it is empty: what the next pass would take is nothing."""
    e = _entries(spark, folder)
    after = queue.apply_batch(e, _batch(spark, folder, None), _now())
    return after.select("id", F.col("payment_url").isNotNull().alias("linked"), "telegram_notified")


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(trim(' ' || p_name || '  x ', ' ')), '\\s+', ' ', 'g')) AS norm FROM part")
def n1b_normalize_sql(spark: SparkSession, folder: str) -> DataFrame:
    return readers.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), X.normalize_name_sql(F.concat(F.lit(" "), F.col("p_name"), F.lit("  x "))).alias("norm"))


@query("SELECT a.p_partkey AS id, substr(a.p_name, 2) = b OR substr(b, 2) = a.p_name OR substr(a.p_name, 2) = substr(b, 2) AS off FROM (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 2) WHEN 1 THEN 'x' || p_name WHEN 2 THEN 'x' || substr(p_name, 2) ELSE reverse(p_name) END AS b FROM part) a")
def n6_first_letter(spark: SparkSession, folder: str) -> DataFrame:
    tail = F.substr("p_name", F.lit(2))
    other = F.element_at(F.array(tail, F.concat(F.lit("x"), F.col("p_name")), F.concat(F.lit("x"), tail), F.reverse("p_name")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return readers.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), X.first_letter_off(F.col("p_name"), other).alias("off"))


@query(f"SELECT o_orderkey AS id, CASE WHEN lower({_KIND}) IN ('team', 'personal') THEN lower({_KIND}) ELSE 'personal' END AS kind FROM orders")
def n8_type(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), X.tournament_type(_kind()).alias("kind"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE (o_orderkey % 16 + 1) || '/16 in' END AS shown FROM orders")
def n12_counter(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat((F.col("o_orderkey") % 16).cast("string"), F.lit("/16 in")))
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), X.bump_counter(text).alias("shown"))


@query("SELECT o_orderkey AS id, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.00' AS amount, CAST(floor(o_totalprice) AS BIGINT) * 100 AS minor FROM orders")
def m2_amount_text(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.floor("o_totalprice")
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), M.amount_text(M.from_minor(whole * 100)).alias("amount"), M.to_minor(whole).alias("minor"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> 'red')[1:2], ' ') AS rest, (SELECT min(w) FROM unnest(string_split(p_name, ' ')) AS u(w) WHERE contains(w, 'a')) AS first_a FROM part")
def r3_r5_choices(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split("p_name", " ")
    rest = X.without_name(F.transform(words, lambda w: F.struct(w.alias("name"))), F.lit("red"), 2)
    keys = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("k"), F.lit(1).alias("v"))))
    return readers.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(rest, lambda c: c["name"]), " ").alias("rest"), X.first_key_like(keys, "a").alias("first_a"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS n FROM events")
def k1_lenient_json(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]"))).when(F.col("event_id") % 3 == 1, F.lit("[broken"))
    return readers.table(spark, folder, "events").select(F.col("event_id").alias("id"), F.size(X.lenient_json(text, "array<struct<k:bigint>>")).alias("n"))


@query("SELECT o_orderkey AS id, o_orderpriority = '1-URGENT' OR o_orderpriority = '5-LOW' AS paid FROM orders")
def e7_paid_state(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "Completed").when(F.col("o_orderpriority") == "5-LOW", "PAID").otherwise(F.col("o_orderpriority"))
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), X.is_paid_state(state).alias("paid"))


@query("SELECT (SELECT count(*) FROM orders) AS n, (SELECT max(c_custkey) + 1 FROM customer) AS first, (SELECT max(c_custkey) FROM customer) + (SELECT count(*) FROM orders) AS last, (SELECT count(*) FROM orders) AS ids")
def u1_new_ids(spark: SparkSession, folder: str) -> DataFrame:
    """New rows numbered behind the old ones: no gap, no id twice."""
    prior = readers.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    new = mutate.with_new_ids(_orders(spark, folder).select("o_orderkey"), prior, ["o_orderkey"])
    return new.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_distinct("id").alias("ids"))


@query("""
    WITH o AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
    SELECT c_custkey AS id, c_name AS name, CASE WHEN o.id IS NULL THEN 'kept' WHEN n > 12 THEN 'gone' ELSE 'off' END AS state FROM customer LEFT JOIN o ON o.id = c_custkey WHERE coalesce(n, 0) <= 12
    UNION ALL SELECT o.id, NULL, 'off' FROM o WHERE n <= 12 AND o.id NOT IN (SELECT c_custkey FROM customer)""")
def u5_u7_u8_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and unknown ones that ordered; the busiest are deleted, others that ordered are switched off."""
    counts = _orders(spark, folder).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    known = readers.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(True).alias("active"))
    rows = mutate.insert_missing(known, counts.select("id", F.lit(True).alias("active")), ["id"])
    rows = mutate.soft_delete(mutate.delete_keyed(rows, counts.where("n > 12"), ["id"]), counts, ["id"])
    return rows.select("id", "name", F.when(F.col("active"), "kept").otherwise("off").alias("state"))


@query("""
    WITH found AS (SELECT o_custkey AS t, o_orderpriority AS raw, lower(o_orderpriority) AS norm FROM orders),
    q AS (SELECT t, norm, max(raw) AS raw FROM found GROUP BY 1, 2)
    SELECT t AS tournament_id, norm AS normalized_name, raw AS raw_player_name, CASE WHEN t % 2 = 0 THEN 'pending' ELSE 'expired' END AS status FROM q""")
def u9_u10_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Doubtful names of two runs; those of the earlier run expire."""
    names = F.array(F.struct(F.lit(1).cast("long").alias("player_id"), F.lit("x").alias("name"), F.lit(1).alias("dist"), F.lit(1).alias("score"), F.lit(1).alias("surname_dist"), F.lit(1).alias("name_dist")))
    found = _orders(spark, folder).select(F.col("o_custkey").alias("tournament_id"), F.col("o_orderpriority").alias("raw_player_name"), F.lower("o_orderpriority").alias("normalized_name"), names.alias("candidates"), F.when(F.col("o_custkey") % 2 == 0, 2).otherwise(1).cast("long").alias("sync_run_id"))
    none = spark.createDataFrame([], schemas.schema("pending_entries"))
    return mutate.expire(pending.quarantine(none, found, _now()), F.lit(2)).select("tournament_id", "normalized_name", "raw_player_name", "status")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE 'known' END AS norm FROM supplier")
def u11_backfill(spark: SparkSession, folder: str) -> DataFrame:
    p = domain.players(spark, folder).withColumn("normalized_name", F.when(F.col("id") % 2 != 0, "known"))
    return reconcile.backfill_names(p).select("id", F.col("normalized_name").alias("norm"))


@query(f"WITH {_ENTRIES} SELECT id, CASE WHEN NOT active THEN 'paid' ELSE status END AS payment_status, NOT active AS manual_paid, CASE WHEN NOT active THEN 'by hand ' || p END AS note FROM e")
def u12_manual(spark: SparkSession, folder: str) -> DataFrame:
    e = _entries(spark, folder)
    chosen = e.where("NOT active").select("id", F.concat(F.lit("by hand "), F.col("player_id").cast("string")).alias("manual_note"))
    return payments.mark_manual(e, chosen).select("id", "payment_status", "manual_paid", F.col("manual_note").alias("note"))


@query("SELECT o_orderkey AS id, 'tournament_type' AS violation FROM orders WHERE o_orderkey % 7 = 0 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def u14_violations(spark: SparkSession, folder: str) -> DataFrame:
    t = domain.tournaments(spark, folder).withColumn("tournament_type", F.when((F.col("id") % 7 == 0) & (F.col("tournament_type") == "personal"), "other").otherwise(F.col("tournament_type")))
    return schemas.violations(schemas.conform(t, "tournaments"), "tournaments").select("id", "violation")


@query("""
    WITH last AS (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
    SELECT last.event_id AS id, CAST(floor((epoch(TIMESTAMP '2030-01-01') - floor(epoch(ts))) / 3600) AS BIGINT) AS age_hours, false AS recent,
           (SELECT count(*) FROM events WHERE event_type <> 'purchase') AS manual_runs, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS automatic_runs FROM last""")
def c9_import_status(spark: SparkSession, folder: str) -> DataFrame:
    e = readers.table(spark, folder, "events")
    runs = schemas.conform(e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("started_at")), "sync_runs")
    lines = e.select(F.when(F.col("event_type") == "purchase", "RUN TYPE: AUTOMATIC (timer)").otherwise("RUN TYPE: MANUAL").alias("value"))
    return reconcile.import_status(runs, lines, F.lit("2030-01-01 00:00:00").cast("timestamp")).select("id", "age_hours", "recent", "manual_runs", "automatic_runs")


_IMPORT = f"""
    WITH {_ENTRIES}, sc AS (SELECT o_orderkey AS t FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 6 HOUR),
    old AS (SELECT t, p, max(status) AS s FROM (SELECT t, p, CASE WHEN status = 'paid' THEN 'a' ELSE '' END AS status FROM e WHERE place <= 3) GROUP BY 1, 2), now AS (SELECT DISTINCT t, p FROM e SEMI JOIN sc USING (t) WHERE place >= 2 AND active),
    a AS (SELECT coalesce(o.t, n.t) AS t, coalesce(o.p, n.p) AS p, CASE WHEN o.t IS NULL THEN 'new' WHEN n.t IS NOT NULL THEN 'existing' WHEN o.s = 'a' THEN 'inactivated' ELSE 'deleted' END AS action
          FROM (SELECT * FROM old SEMI JOIN sc USING (t)) o FULL JOIN now n ON o.t = n.t AND o.p = n.p)"""


def _imported(spark: SparkSession, folder: str, spelled: bool = False, by_name: bool = False) -> reconcile.Reconciled:
    """All orders as a snapshot: the rosters are the active entries from the second place on, the state before has the first three places.

    spelled: some people are on the rosters by an alias, some by a misspelt name, and some as new people; every eleventh event has failed.
    """
    o, p = _orders(spark, folder), _people(spark, folder)
    e = staged(_entries(spark, folder).select("id", "tournament_id", "player_id", "payment_status", "active"), "line_items")
    place = F.col("id") - F.col("tournament_id") * 10
    state = schemas.conform(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("location"), F.col("at").alias("starts_at")), "tournaments")
    prior = e.where(place <= 3).groupBy("tournament_id", "player_id").agg(F.min("id").alias("id"), _least_status())
    names = e.where((place >= 2) & F.col("active")).join(p.select(F.col("id").alias("player_id"), "full_name"), "player_id")
    if spelled:
        k = F.col("player_id")
        names = names.withColumn("full_name", F.when(k % 10 == 1, F.concat(F.lit("Alias "), k)).when(k % 10 == 2, F.concat("full_name", F.lit("x"))).when(k % 10 == 3, F.md5(k.cast("string"))).otherwise(F.col("full_name")))
    rosters = names.groupBy(F.col("tournament_id").alias("o_orderkey")).agg(F.sort_array(F.collect_set("full_name")).alias("participants"))
    events = o.join(rosters, "o_orderkey", "left").select(F.col("o_orderkey").alias("position"), F.col("o_orderkey").cast("string").alias("location"), F.col("at").alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"), F.lit("").alias("organizer"), F.col("o_orderpriority").alias("title"), F.lit(1).alias("price_rub"), F.lit(None).cast("timestamp").alias("source_last_updated"), X.tournament_type(_kind()).alias("tournament_type"), F.coalesce("participants", F.array().cast("array<string>")).alias("participants"))
    empty = {name: spark.createDataFrame([], schemas.schema(name)) for name in ("player_aliases", "pending_entries")}
    if spelled:
        called = F.concat(F.lit("alias "), F.col("id"))
        empty["player_aliases"] = schemas.conform(p.where("id % 10 = 1").select("id", called.alias("alias_name"), called.alias("normalized_alias"), F.col("id").alias("player_id")), "player_aliases")
    events = staged(events, "events")
    failed = events.where("position % 11 = 0") if spelled else None
    return reconcile.reconcile({"tournaments": state, "players": p, "entries": staged(schemas.conform(prior, "entries"), "entries")} | empty, events, 1, _now(), by_name, failed)


@query(_IMPORT + """ SELECT t AS tournament_id, p AS player_id, action <> 'inactivated' AS active FROM a WHERE action <> 'deleted'
    UNION ALL SELECT t, p, true FROM old ANTI JOIN sc USING (t)""")
def c1_import(spark: SparkSession, folder: str) -> DataFrame:
    """Entries after a whole import."""
    return _imported(spark, folder).tables["entries"].select("tournament_id", "player_id", "active")


@query(_IMPORT + """ SELECT CAST(count(*) FILTER (WHERE action = 'new') AS INT) AS entries_new, CAST(count(*) FILTER (WHERE action = 'existing') AS INT) AS entries_existing, CAST(count(*) FILTER (WHERE action = 'inactivated') AS INT) AS entries_inactivated,
    CAST(count(*) FILTER (WHERE action = 'deleted') AS INT) AS entries_deleted, CAST((SELECT count(*) FROM now) AS INT) AS players_upsert, CAST((SELECT count(*) FROM sc) AS INT) AS tournaments_upsert, CAST((SELECT count(*) FROM orders) - (SELECT count(*) FROM sc) AS INT) AS tournaments_skipped_past,
    CAST((SELECT count(*) FROM orders) - (SELECT count(*) FROM sc) AS INT) AS tournaments_archived, CAST(0 AS INT) AS tournaments_deleted FROM a""")
def a8_import_counters(spark: SparkSession, folder: str) -> DataFrame:
    """All counters of a whole import."""
    return _imported(spark, folder).counters


@query(_IMPORT + " SELECT CAST(1 AS BIGINT) AS id, 'import' AS source, CAST(count(*) FILTER (WHERE action = 'new') AS INT) AS entries_new, 'x.json' AS json_path, CAST(NULL AS VARCHAR) AS error FROM a")
def a9_run_row(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.run_row(1, _imported(spark, folder).counters, _now(), _now(), "x.json", _now()).select("id", "source", "entries_new", "json_path", "error")


@query(f"""
    WITH {_ENTRIES}, f AS (SELECT CAST(user_id AS VARCHAR) AS payment_id, arg_min(CAST(value AS DECIMAL(10, 2)), {{'ts': ts, 'v': -CAST(value AS DECIMAL(10, 2))}}) AS amount FROM events WHERE event_type = 'purchase' GROUP BY 1),
    payer AS (SELECT CAST(p AS VARCHAR) AS payment_id, min(id) AS id FROM e GROUP BY 1)
    SELECT payer.id, CAST(amount AS DOUBLE) AS amount FROM f JOIN payer USING (payment_id) JOIN e USING (id) WHERE status <> 'paid'""")
def c3_first_payment(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of a payment to arrive counts, with its amount."""
    e = _entries(spark, folder).withColumn("payment_id", F.col("player_id").cast("string"))
    ev = readers.table(spark, folder, "events").where("event_type = 'purchase'").select(F.lit("payment.succeeded").alias("event"), F.col("user_id").cast("string").alias("payment_id"), F.col("value").cast("decimal(10,2)").cast("string").alias("amount_text"), F.col("ts").alias("arrived_at"))
    return payments.payment_changes(e, ev).select("id", F.col("amount").cast("double").alias("amount"))


@query(f"""
    WITH {_ENTRIES}, x AS (SELECT *, CAST(p AS VARCHAR) AS payment_id, CASE WHEN place > 1 THEN t * 10 + 1 END AS by_id FROM e), ids AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS payment_id FROM events WHERE event_type = 'purchase'),
    payers AS (SELECT payment_id, id, p FROM x SEMI JOIN ids USING (payment_id)), o AS (SELECT payment_id, id, p, 'payer' AS kind FROM payers UNION ALL SELECT y.payment_id, x.id, x.p, 'partner' FROM x JOIN payers y ON x.by_id = y.id)
    SELECT payment_id, id AS entry_id, max(kind) AS kind, CASE WHEN p % 5 = 0 THEN 'no_chat' ELSE 'waiting' END AS status FROM o GROUP BY payment_id, id, p""")
def s12_outbox(spark: SparkSession, folder: str) -> DataFrame:
    """Who is told of which payment; the payments come twice and are told of once."""
    place = F.col("id") - F.col("tournament_id") * 10
    e = _entries(spark, folder).withColumn("payment_id", F.col("player_id").cast("string")).withColumn("paid_by_entry_id", F.when(place > 1, F.col("tournament_id") * 10 + 1))
    paid = readers.table(spark, folder, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("payment_id")).distinct()
    e = staged(e.select("id", "player_id", "payment_id", "paid_by_entry_id"), "entries")
    found = staged(outbox.notices(e, _people(spark, folder), paid, _now()), "notices")
    once = outbox.enqueue(spark.createDataFrame([], outbox.OUTBOX), found)
    return outbox.enqueue(once, found).select("payment_id", "entry_id", "kind", "status")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS telegram_id, count(*) AS people, min(s_suppkey) AS first_id FROM supplier GROUP BY 1 HAVING count(*) > 1")
def j15_conflict_groups(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.conflict_groups(domain.players(spark, folder).withColumn("telegram_id", F.col("nation_id").cast("string")))


_DECIDED = f"""
    WITH {_ENTRIES}, own AS (SELECT t, p, min(id) AS id, bool_or(active) AS active FROM e GROUP BY 1, 2), s AS (SELECT s_suppkey AS k, CAST(least(ceil(s_suppkey / 10.0) * 10, (SELECT max(s_suppkey) FROM supplier)) AS BIGINT) AS root FROM supplier),
    kept AS (SELECT t, root, max(p) AS p FROM own JOIN s ON s.k = own.p GROUP BY 1, 2)"""


def _asked(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables and decisions: each supplier's name is decided to be the next one's, up to the next ten or the last; some decisions are wrong or come late."""
    own = _entries(spark, folder).groupBy("tournament_id", "player_id").agg(F.min("id").alias("id"), F.bool_or("active").alias("active"))
    people = _people(spark, folder)
    waits = people.select("id", F.col("id").alias("tournament_id"), F.col("full_name").alias("raw_player_name"), "normalized_name", F.lit("pending").alias("status"))
    tables = {"players": people, "entries": staged(schemas.conform(own, "entries"), "entries"), "pending_entries": schemas.conform(waits, "pending_entries"), "player_aliases": spark.createDataFrame([], schemas.schema("player_aliases"))}
    k, late = F.col("id"), F.lit(10**6)
    said = lambda where, seq, row, kind, who: people.where(where).select(seq.alias("seq"), row.alias("id"), F.lit(kind).alias("decision"), who.cast("long").alias("player_id"), F.lit("admin").alias("by"))
    asked = said("id % 10 <> 0", k, k, "resolved", k + 1)
    for more in (said("id % 10 = 0 AND id > 0", late + k, k, "approved", k - 5), said("id % 10 = 0 AND id > 0", k, k, "resolved", F.lit(None)), said("id % 10 = 3", late + k, k, "rejected", F.lit(None)), said("id % 7 = 0", k, k, "maybe", k), said("id % 10 = 4", k, -k, "snoozed", F.lit(None)), said("id % 10 = 0 AND id > 0", k, k, "approved", -k)):
        asked = asked.unionByName(more)
    return tables, asked


@query(_DECIDED + """
    SELECT kept.t AS tournament_id, kept.root AS player_id, own.active OR coalesce(kept.t % 10 <> 0 AND s.k < (SELECT max(k) FROM s) AND kept.p <= kept.t + 1, false) AS active, own.id AS id
    FROM kept JOIN own USING (t, p) LEFT JOIN s ON s.k = kept.t AND s.root = kept.root
    UNION ALL SELECT k, root, true, NULL FROM s WHERE k % 10 <> 0 AND k < (SELECT max(k) FROM s) AND NOT EXISTS (SELECT 1 FROM kept WHERE kept.t = s.k AND kept.root = s.root)""")
def c5_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Entries after chains of merges: of those that meet in an event, the one of the person merged last stays."""
    entries = decisions.decide(*_asked(spark, folder), _now())["entries"]
    return entries.select("tournament_id", "player_id", "active", F.when(F.col("first_seen_in_source").isNull(), F.col("id")).alias("id"))


@query("""
    WITH s AS (SELECT s_suppkey AS k FROM supplier)
    SELECT k AS id, 'approved' AS decision, k - 5 AS player_id, 'person_gone' AS reason FROM s WHERE k % 10 = 0 AND k > 0 UNION ALL SELECT k, 'resolved', NULL, 'no_person' FROM s WHERE k % 10 = 0 AND k > 0
    UNION ALL SELECT k, 'rejected', NULL, 'already_decided' FROM s WHERE k % 10 = 3 UNION ALL SELECT k, 'maybe', k, 'unknown_decision' FROM s WHERE k % 7 = 0
    UNION ALL SELECT -k, 'snoozed', NULL, 'not_waiting' FROM s WHERE k % 10 = 4 UNION ALL SELECT k, 'approved', -k, 'unknown_person' FROM s WHERE k % 10 = 0 AND k > 0
    UNION ALL SELECT k, 'resolved', k + 1, 'unknown_person' FROM s WHERE k % 10 <> 0 AND k = (SELECT max(k) FROM s)""")
def c5_refused_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.decide(*_asked(spark, folder), _now())["refused"].select("id", "decision", "player_id", "reason")


@query(_DUE + """, n AS (
        SELECT CAST(pos // 100 + 1 AS INT) AS pass, count(*) AS processed, count(*) FILTER (WHERE outcome = 'send') AS notified FROM (SELECT *, row_number() OVER (ORDER BY created, id) - 1 AS pos FROM due) WHERE pos < 5000 GROUP BY 1)
    SELECT * FROM n UNION ALL SELECT CAST(coalesce(max(pass), 0) + 1 AS INT), 0, 0 FROM n HAVING coalesce(max(pass), 0) < 50""")
def o7_drain(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the passes over the queue, 100 entries each."""
    t = domain.tournaments(spark, folder).withColumn("starts_at", F.col("starts_at").cast("timestamp"))
    return queue.pass_totals(queue.drain(_entries(spark, folder), _people(spark, folder), t, _now(), 100))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """The events as lines of three logs, each read in blocks."""
    kind = F.col("event_type")
    line = F.when(kind == "signup", F.concat(F.lit("RUN START: PID="), F.col("event_id"), F.lit(", Time="), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0300 MSK"))).when(kind == "view", "RUN TYPE: AUTOMATIC (timer)").when(kind == "click", "RUN TYPE: MANUAL")
    line = line.when(kind == "error", F.concat(F.lit("ERROR: "), F.get_json_object("props", "$.k"))).when(F.col("user_id") % 2 == 0, "Entries DELETED: 5").otherwise("noise")
    return readers.table(spark, folder, "events").select((F.col("user_id") % 3).alias("file"), F.expr("event_id div 500").alias("block"), F.col("event_id").alias("at"), line.alias("value"))


@query("""
    WITH l AS (SELECT user_id % 3 AS file, event_id AS pos, event_type AS ty, user_id, ts, json_extract_string(props, '$.k') AS k FROM events),
    r AS (SELECT *, max(CASE WHEN ty = 'signup' THEN pos END) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run, max(CASE WHEN ty = 'signup' THEN pos END) OVER (PARTITION BY file) AS newest FROM l),
    g AS (SELECT file, run, max(newest) AS newest, max(CASE WHEN ty = 'signup' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END) AS started_text, arg_min(CASE ty WHEN 'view' THEN 'AUTOMATIC' ELSE 'MANUAL' END, pos) FILTER (WHERE ty IN ('view', 'click')) AS kind,
            count(*) FILTER (WHERE ty = 'error') AS errors, arg_min(k, pos) FILTER (WHERE ty = 'error') AS first_error, bool_or(ty = 'purchase' AND user_id % 2 = 0) AS through FROM r WHERE run IS NOT NULL GROUP BY file, run)
    SELECT file, CAST(run AS INT) AS pid, started_text, kind, errors, first_error, CASE WHEN errors > 0 THEN 'failed' WHEN through THEN 'finished' WHEN run = newest THEN 'running' ELSE 'broken' END AS state FROM g""")
def s11_runs(spark: SparkSession, folder: str) -> DataFrame:
    return readers.runs_from_log(_log(spark, folder))


@query(f"""
    WITH h AS (SELECT o_orderkey AS id, o_orderdate AS t, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 3600) AS INT) AS hours FROM orders)
    SELECT id, CASE WHEN t < TIMESTAMP '{NOW}' THEN 'old' ELSE 'current' END AS state, CASE WHEN t < TIMESTAMP '{NOW}' THEN hours // 24 END AS days, CASE WHEN t < TIMESTAMP '{NOW}' THEN hours END AS hours FROM h""")
def c9_error_age(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's time as that of an error file, against a last run now."""
    return _orders(spark, folder).select(F.col("o_orderkey").alias("id"), readers.error_age(F.col("at"), _now()).alias("age")).select("id", "age.*")


@query("SELECT s_suppkey AS id, s_name || ', é \"x\"' AS full_name FROM supplier")
def s3_people_file(spark: SparkSession, folder: str) -> DataFrame:
    """People through a CSV file with a header."""
    path = fresh_path(spark, "people")
    domain.players(spark, folder).select("id", F.concat("full_name", F.lit(', é "x"')).alias("full_name")).write.option("header", True).option("escape", '"').csv(path)
    return readers.people(spark, path)


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as bodies of payment events; every fifth one is cancelled, every seventh has no amount."""
    e = readers.table(spark, folder, "events").where("event_type = 'purchase'")
    amount = F.when(F.col("event_id") % 7 != 0, F.format_string("%.2f", "value")).otherwise("")
    return e.select(F.when(F.col("event_id") % 5 == 0, "payment.canceled").otherwise("payment.succeeded").alias("event"), F.struct(F.col("user_id").cast("string").alias("id"), F.struct(amount.alias("value")).alias("amount")).alias("object"))


_EVENTS = "ev AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'payment.canceled' ELSE 'payment.succeeded' END AS event, CAST(user_id AS VARCHAR) AS payment_id, CASE WHEN event_id % 7 <> 0 THEN printf('%.2f', value) END AS amount_text FROM events WHERE event_type = 'purchase')"


@query(f"WITH {_EVENTS} SELECT event, payment_id, amount_text, true AS arrived FROM ev")
def s5_s10_payment_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Payment events through JSON bodies; each arrives when its file is written."""
    path = fresh_path(spark, "bodies")
    _bodies(spark, folder).write.json(path)
    return readers.payment_events(spark, path).select("event", "payment_id", "amount_text", (F.col("arrived_at") > F.lit("2020-01-01").cast("timestamp")).alias("arrived"))


_LEDGER = f"""
    WITH {_ENTRIES}, {_EVENTS}, f AS (SELECT payment_id, max(CAST(amount_text AS DECIMAL(10, 2))) AS amount FROM ev WHERE event = 'payment.succeeded' GROUP BY 1),
    payer AS (SELECT CAST(p AS VARCHAR) AS payment_id, min(id) AS id FROM e GROUP BY 1), hit AS (SELECT payer.id, amount FROM f JOIN payer USING (payment_id) JOIN e USING (id) WHERE status <> 'paid')"""


def _paid_ledger(spark: SparkSession, folder: str, stream: bool) -> Ledger:
    """Entries in buckets after all payment events, which come twice: as a stream of their files, or as two batches."""
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    ledger.create(_entries(spark, folder).withColumn("payment_id", F.col("player_id").cast("string")), _people(spark, folder))
    path = fresh_path(spark, "bodies")
    for _ in range(2):
        _bodies(spark, folder).write.mode("append").json(path)
        if stream:
            apply_stream(readers.payment_events(spark, path, stream=True), ledger, f"{path}-checkpoint", _now()).awaitTermination()
        else:
            ledger.apply(readers.payment_events(spark, path).drop("arrived_at"), _now())
    return ledger


@query(_LEDGER + f" SELECT e.id, CASE WHEN hit.id IS NULL THEN status ELSE 'paid' END AS payment_status, CAST(amount AS DOUBLE) AS amount, CASE WHEN hit.id IS NOT NULL THEN TIMESTAMP '{NOW}' END AS paid_at FROM e LEFT JOIN hit USING (id)")
def s9_payments_in_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of the bucketed table after two batches; the second has everything again and changes nothing."""
    after = _paid_ledger(spark, folder, False).entries()
    return after.select("id", "payment_status", F.col("paid_amount_rub").cast("double").alias("amount"), F.col("paid_at").cast("timestamp_ntz").alias("paid_at"))


@query(_LEDGER + " SELECT e.id, CASE WHEN hit.id IS NULL THEN status ELSE 'paid' END AS payment_status FROM e LEFT JOIN hit USING (id)")
def c3_payment_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of files, the repeats of which are dropped within the watermark."""
    return _paid_ledger(spark, folder, True).entries().select("id", "payment_status")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'late,' || o_orderpriority ELSE o_orderpriority END AS participants, 2 AS version FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, 1 FROM orders")
def s8_document_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A document table, a version of it with one more participant in some rows, and the earlier one beside it."""
    path, schema = fresh_path(spark, "document"), "id bigint, participants array<string>"
    sinks.add_version(readers.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderpriority").alias("participants")), path, 1)
    later = F.when(F.col("id") % 3 == 0, F.array_prepend("participants", F.lit("late"))).otherwise(F.col("participants"))
    sinks.add_version(sinks.at_version(spark, path, schema).withColumn("participants", later), path, 2)
    last, first = sinks.at_version(spark, path, schema), sinks.at_version(spark, path, schema, 1)
    return last.withColumn("version", F.lit(2)).unionByName(first.withColumn("version", F.lit(1))).withColumn("participants", F.array_join("participants", ","))


@query("""
    WITH n AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1), d AS (SELECT DISTINCT strftime((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Moscow', '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderstatus <> 'P'),
    u AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS telegram_id, event_type AS ty, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(DATE '1997-03-01' + CAST(event_id % 300 AS INT), '%Y-%m-%d') AS day FROM events)
    SELECT telegram_id, seq, CASE ty WHEN 'view' THEN 'support' WHEN 'signup' THEN CASE WHEN (SELECT count(*) FROM n WHERE n.id % 2 = 0 AND n.id = k) = 1 THEN 'named' ELSE 'unnamed' END WHEN 'click' THEN 'pick_tournament' WHEN 'purchase' THEN 'confirm' ELSE 'cancel' END AS step, CASE WHEN ty = 'view' THEN true END AS support
    FROM u WHERE ty <> 'click' OR day IN (SELECT day FROM d)""")
def s6_update_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Events as chat updates: names of parts, every second one of which has a chat, dates of orders, and buttons."""
    e, n = readers.table(spark, folder, "events"), domain.part_names(spark, folder)
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    text = F.when(kind == "view", updates.HELP).when(kind == "signup", F.upper(F.coalesce("full_name", F.lit("nobody"))))
    day = F.date_format(F.date_add(F.lit("1997-03-01").cast("date"), (F.col("event_id") % 300).cast("int")), "yyyy-MM-dd")
    command = F.when(kind == "click", F.concat(F.lit("bind_date:"), day)).when(kind == "purchase", "bind_pick_player:1:2:0").when(kind == "error", "bind_back:menu")
    chat = e.withColumn("_k", k).join(n.select(F.col("id").alias("_k"), "full_name"), "_k", "left")
    asked = chat.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("telegram_id"), text.alias("text"), command.alias("command"))
    people = n.select("id", "full_name", F.lit(None).cast("string").alias("lunda_name"), F.when(F.col("id") % 2 == 1, F.lit("chat")).alias("telegram_id"))
    return updates.update_steps(asked, people, domain.tournaments(spark, folder).withColumn("starts_at", F.col("starts_at").cast("timestamp")), _now())


_SPELLED = f"""
    WITH {_ENTRIES}, sc AS (SELECT o_orderkey AS t FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 6 HOUR AND o_orderkey % 11 <> 0),
    old AS (SELECT t, s_name AS who, max(status = 'paid') AS paid FROM e JOIN supplier ON s_suppkey = p WHERE place <= 3 GROUP BY 1, 2), roster AS (SELECT DISTINCT t, p, s_name FROM e SEMI JOIN sc USING (t) JOIN supplier ON s_suppkey = p WHERE place >= 2 AND active),
    now AS (SELECT t, CASE WHEN p % 10 = 3 THEN md5(CAST(p AS VARCHAR)) ELSE s_name END AS who, p % 10 = 1 AS by_alias FROM roster WHERE p % 10 <> 2),
    b AS (SELECT coalesce(o.t, n.t) AS tournament_id, coalesce(o.who, n.who) AS full_name, o.t IS NULL AS fresh, n.t IS NOT NULL AS here, by_alias, paid FROM (SELECT * FROM old SEMI JOIN sc USING (t)) o FULL JOIN now n ON o.t = n.t AND o.who = n.who)"""


def _named_entries(done: reconcile.Reconciled) -> DataFrame:
    people = done.tables["players"].select(F.col("id").alias("player_id"), "full_name")
    return done.tables["entries"].join(people, "player_id").select("tournament_id", "full_name", "active")


@query(_SPELLED + " SELECT tournament_id, full_name, fresh OR here AS active FROM b WHERE fresh OR here OR paid UNION ALL SELECT t, who, true FROM old ANTI JOIN sc USING (t)")
def c1_import_names(spark: SparkSession, folder: str) -> DataFrame:
    """Entries after an import with aliases, doubtful and new names, and events that failed."""
    return _named_entries(_imported(spark, folder, True))


@query(_SPELLED + " SELECT tournament_id, full_name, fresh OR (here AND NOT by_alias) AS active FROM b WHERE fresh OR (here AND NOT by_alias) OR paid UNION ALL SELECT t, who, true FROM old ANTI JOIN sc USING (t)")
def c1_leavers_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """The same where leavers are judged by the names on the roster: who is on it by an alias alone leaves."""
    return _named_entries(_imported(spark, folder, True, True))


@query(_SPELLED + " SELECT t AS tournament_id, s_name || 'x' AS raw_player_name, 'pending' AS status, p AS first_candidate FROM roster WHERE p % 10 = 2")
def c1_doubtful_names(spark: SparkSession, folder: str) -> DataFrame:
    waiting = _imported(spark, folder, True).tables["pending_entries"]
    return waiting.select("tournament_id", "raw_player_name", "status", F.get("candidates", F.lit(0))["player_id"].alias("first_candidate"))


def _waiting(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as waiting names: open ones are pending, from two runs."""
    o = readers.table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").otherwise("expired")
    candidates = F.array(F.struct(F.lit(1).cast("long").alias("player_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("name"), F.lit(2).alias("dist"), F.lit(3).alias("score"), F.lit(0).alias("surname_dist"), F.lit(0).alias("name_dist")))
    return schemas.conform(o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).alias("sync_run_id"), F.col("o_orderkey").alias("tournament_id"), F.col("o_orderpriority").alias("raw_player_name"), candidates.alias("candidates"), status.alias("status")), "pending_entries")


@query("SELECT o_orderkey AS pending_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS title, o_orderpriority AS raw_player_name, 'c' || o_custkey AS first_name, 'waiting' AS status FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 1")
def s12_admin_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Notices about the names that the second run has left waiting; every fifth event isn't known."""
    events = schemas.conform(_orders(spark, folder).where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("at").alias("starts_at")), "tournaments")
    found = outbox.admin_notices(_waiting(spark, folder), events, 1, _now())
    return found.select("pending_id", "title", "raw_player_name", F.get("candidates", F.lit(0))["name"].alias("first_name"), "status")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS admin_message_id FROM orders")
def u9_admin_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Waiting names after every third notice has been sent, twice, and some without an answer."""
    waits = _waiting(spark, folder)
    sent = waits.select("id", F.explode(F.array(F.when(F.col("id") % 3 == 0, F.col("id")), F.when(F.col("id") % 3 == 0, F.col("id") + 1))).alias("admin_message_id"))
    return outbox.note_messages(waits, sent).select("id", "admin_message_id")


@query(_DUE + ", p AS (SELECT id, CASE WHEN outcome = 'send' THEN 'bot_not_configured' ELSE outcome END AS outcome FROM due) SELECT id AS entry_id, outcome FROM p")
def e1_no_bot(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of the queue where no bot is set up."""
    t = domain.tournaments(spark, folder).withColumn("starts_at", F.col("starts_at").cast("timestamp"))
    return queue.work_batch(_entries(spark, folder), _people(spark, folder), t, _now(), None, bot_ready=False).select("entry_id", "outcome")
