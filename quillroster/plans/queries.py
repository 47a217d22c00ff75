"""Queries over the driver's tables, each of which applies operators of this library, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillroster.functions import money as M
from quillroster.functions import text as X
from quillroster.functions import timeops as D
from quillroster.operators import mutate, patterns, payments, pending, queue, reconcile, resolve, views
from quillroster.plans import domain
from quillroster.plans.registry import query
from quillroster.sources import readers
from quillroster.sources.staging import staged

AS_OF = "TIMESTAMP_NTZ '1997-06-01 00:00:00'"


def _now():
    return F.expr(AS_OF)


@query("""
    SELECT t.o_orderkey AS tournament_id, t.o_totalprice AS price_rub, count(e.l_orderkey) AS entries_total,
           count(e.l_orderkey) FILTER (WHERE e.l_linestatus = 'F') AS entries_paid, count(e.l_orderkey) FILTER (WHERE e.l_linestatus = 'O') AS entries_pending
    FROM orders t LEFT JOIN lineitem e ON e.l_orderkey = t.o_orderkey
    WHERE t.o_orderstatus <> 'P' GROUP BY t.o_orderkey, t.o_totalprice""")
def j3_a2_event_rollup(spark: SparkSession, folder: str) -> DataFrame:
    out = views.event_rollup(domain.tournaments(spark, folder).select("id", "price_rub", "archived_at"), domain.entries(spark, folder))
    return out.select("tournament_id", "price_rub", "entries_total", "entries_paid", "entries_pending")


@query("""
    SELECT l_orderkey * 10 + l_linenumber AS entry_id, l_orderkey AS tournament_id, CASE WHEN l_linestatus = 'F' THEN 'paid' ELSE 'pending' END AS payment_status,
           s_name AS full_name, o_totalprice AS price_rub, o_orderpriority AS title
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey""")
def f1_j2_entry_detail(spark: SparkSession, folder: str) -> DataFrame:
    out = views.entry_details(domain.entries(spark, folder).select("id", "tournament_id", "player_id", "payment_status"), domain.players(spark, folder).select("id", "full_name"), domain.tournaments(spark, folder).select("id", "price_rub", "title"))
    return out.select(F.col("id").alias("entry_id"), "tournament_id", "payment_status", F.col("player_full_name").alias("full_name"), F.col("tournament_price_rub").alias("price_rub"), F.col("tournament_title").alias("title"))


@query("SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS last_sync, count(*) FILTER (WHERE o_orderstatus <> 'P') AS live_tournaments FROM orders")
def a4_last_sync(spark: SparkSession, folder: str) -> DataFrame:
    out = views.last_sync(domain.tournaments(spark, folder).withColumnRenamed("starts_at", "source_last_updated"))
    return out.select(F.date_format("last_sync", "yyyy-MM-dd").alias("last_sync"), "live_tournaments")


@query("""
    SELECT DISTINCT strftime(o_orderdate + INTERVAL 3 HOUR, '%Y-%m-%d') AS day FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1997-06-01' ORDER BY day LIMIT 10""")
def a5_d4_upcoming_dates(spark: SparkSession, folder: str) -> DataFrame:
    day = F.to_date(F.col("starts_at") + D.hours(3))
    return views.upcoming_dates(domain.tournaments(spark, folder), _now(), day=day).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""
    SELECT l_orderkey * 10 + l_linenumber AS entry_id, o_orderkey AS tournament_id, o_totalprice AS price_rub, CASE WHEN l_linestatus = 'F' THEN 'paid' ELSE 'pending' END AS payment_status
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE l_suppkey = 7 AND l_returnflag <> 'R' AND o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '1997-06-01'""")
def c8_upcoming_for_person(spark: SparkSession, folder: str) -> DataFrame:
    out = views.upcoming_for_person(domain.entries(spark, folder).drop("amount"), domain.tournaments(spark, folder), F.lit(7), _now())
    return out.select("entry_id", "tournament_id", "price_rub", "payment_status")


@query("""
    WITH r AS (SELECT DISTINCT l_orderkey AS t, l_suppkey AS player_id, s_name AS full_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R'),
    big AS (SELECT t FROM r GROUP BY t ORDER BY count(*) DESC, t LIMIT 1), p AS (SELECT *, row_number() OVER (ORDER BY full_name, player_id) AS place, count(*) OVER () AS n FROM r SEMI JOIN big USING (t))
    SELECT player_id, full_name, CAST(place AS INT) AS place, false AS has_previous, n > 10 AS has_next FROM p WHERE place <= 10""")
def c8_roster_page(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of the longest roster."""
    e = domain.entries(spark, folder)
    sizes = e.where("active").groupBy("tournament_id").agg(F.count_distinct("player_id").alias("n")).orderBy(F.desc("n"), "tournament_id").limit(1).select(F.col("tournament_id").alias("big"))
    rows = views.roster(e.crossJoin(F.broadcast(sizes)), domain.players(spark, folder), F.col("big")).distinct()  # one row is joined to each
    return views.page(rows, [F.asc("full_name"), F.asc("player_id")], 0).select("player_id", "full_name", "place", "has_previous", "has_next")


@query("""
    WITH r AS (SELECT DISTINCT l_orderkey AS tournament_id, l_suppkey AS player_id, s_name AS full_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R'),
    p AS (SELECT *, row_number() OVER (PARTITION BY tournament_id ORDER BY full_name, player_id) AS place, count(*) OVER (PARTITION BY tournament_id) AS n FROM r)
    SELECT tournament_id, player_id, full_name, CAST(place AS INT) AS place, CAST((place - 1) // 10 AS INT) AS page, place > 10 AS has_previous, n > ((place - 1) // 10 + 1) * 10 AS has_next FROM p""")
def c8_roster_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.rosters(domain.entries(spark, folder), domain.players(spark, folder))
    return views.pages(rows, ["tournament_id"], [F.asc_nulls_last("full_name"), F.asc("player_id")]).select("tournament_id", "player_id", "full_name", "place", "page", "has_previous", "has_next")


@query("""
    WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_suppkey AS VARCHAR) AS payment_id, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + 1 END AS paid_by FROM lineitem),
    p AS (SELECT id FROM e WHERE payment_id IN ('3', '5'))
    SELECT DISTINCT id FROM e WHERE payment_id IN ('3', '5') OR paid_by IN (SELECT id FROM p)""")
def f7_notify_set(spark: SparkSession, folder: str) -> DataFrame:
    e = domain.entries(spark, folder).select("id", F.col("player_id").cast("string").alias("payment_id"), F.when(F.col("place") > 1, F.col("tournament_id") * 10 + 1).alias("paid_by_entry_id"))
    ids = spark.createDataFrame([("3",), ("5",)], "payment_id string")
    return payments.notify_set(e, ids).select("id").distinct()


@query("""
    WITH live AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')
    SELECT o_orderkey AS id, CASE WHEN o_orderdate < TIMESTAMP '1996-06-01' THEN 'past' ELSE 'missing' END AS reason FROM live
    WHERE o_orderdate < TIMESTAMP '1996-06-01' OR (o_orderdate < TIMESTAMP '1997-06-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3))""")
def f8_missing_events(spark: SparkSession, folder: str) -> DataFrame:
    t = domain.tournaments(spark, folder).withColumn("last_seen_in_source", F.col("starts_at"))
    seen = domain.entries(spark, folder).where("place <= 3").select(F.col("tournament_id").alias("id"))
    return reconcile.to_archive(t, _now(), F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00'"), seen)


@query("""
    WITH e AS (SELECT l_orderkey AS t, l_linenumber AS n, min(l_suppkey) AS p FROM lineitem GROUP BY 1, 2), x AS (SELECT t * 10 + n AS id, t, n, p FROM e)
    SELECT a.id AS entry_id, sf.s_name AS paid_for_name, sb.s_name AS paid_by_name FROM x a
    LEFT JOIN x f ON a.n = 1 AND f.id = a.t * 10 + 2 LEFT JOIN supplier sf ON sf.s_suppkey = f.p
    LEFT JOIN x b ON a.n = 2 AND b.id = a.t * 10 + 1 LEFT JOIN supplier sb ON sb.s_suppkey = b.p WHERE a.n <= 2""")
def j5_pair_names(spark: SparkSession, folder: str) -> DataFrame:
    e = domain.entries(spark, folder).groupBy("tournament_id", "place").agg(F.min("player_id").alias("player_id"))
    e = e.select((F.col("tournament_id") * 10 + F.col("place")).alias("id"), "player_id", F.when(F.col("place") == 1, F.col("tournament_id") * 10 + 2).alias("paid_for_entry_id"), F.when(F.col("place") == 2, F.col("tournament_id") * 10 + 1).alias("paid_by_entry_id"))
    return views.pair_names(e, domain.players(spark, folder))


@query("SELECT s_name AS full_name, o_orderpriority AS title, o_totalprice AS price_rub FROM (SELECT * FROM supplier WHERE s_suppkey = 5), (SELECT * FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))")
def j4_pick_confirm(spark: SparkSession, folder: str) -> DataFrame:
    t = domain.tournaments(spark, folder)
    first = F.broadcast(t.agg(F.min("id").alias("first_id")))  # one row
    return views.confirm_pick(domain.players(spark, folder), t.withColumn("location", F.col("price_rub")).crossJoin(first), 5, F.col("first_id")).select("full_name", "title", F.col("location").alias("price_rub"))


_FUZZY = """
    WITH n AS (SELECT p_name AS full_name, min(p_partkey) AS id, lower(p_name) AS norm FROM part GROUP BY p_name),
    pr AS (SELECT full_name AS name, norm, CASE WHEN length(norm) <= 8 THEN 2 WHEN length(norm) <= 14 THEN 3 WHEN length(norm) <= 22 THEN 4 ELSE 5 END AS k FROM n),
    c AS (SELECT pr.name, pr.norm, pr.k, n.id AS player_id, n.full_name, n.norm AS other, levenshtein(pr.norm, n.norm) AS dist FROM pr, n WHERE levenshtein(pr.norm, n.norm) <= pr.k),
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dist, player_id) AS r FROM c) WHERE r <= 30 AND full_name <> name),
    m AS (SELECT *, min(dist) OVER (PARTITION BY name) AS least FROM pool),
    s AS (SELECT *, levenshtein(split_part(norm, ' ', 1), split_part(other, ' ', 1)) AS sd, CASE WHEN split_part(norm, ' ', 2) <> '' AND split_part(other, ' ', 2) <> '' THEN levenshtein(split_part(norm, ' ', 2), split_part(other, ' ', 2)) END AS nd FROM m WHERE least <= 3 AND dist <= least(least + 1, k)),
    b AS (SELECT *, dist * 10 + sd * 3 + coalesce(nd, 999) * 3 AS score FROM s),
    five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score, player_id) AS q FROM b) WHERE q <= 5)"""


@query(_FUZZY + " SELECT name, player_id, full_name, CAST(dist AS INT) AS dist, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY name ORDER BY dist, score, player_id) AS INT) AS place FROM five")
def j11_c2_fuzzy_candidates(spark: SparkSession, folder: str) -> DataFrame:
    people = domain.part_names(spark, folder)
    probes = people.select(F.col("full_name").alias("name"), F.col("normalized_name").alias("norm"))
    return resolve.fuzzy_candidates(probes, people).select("name", "player_id", "full_name", "dist", "score", "place")


@query("""
    WITH n AS (SELECT p_name AS full_name, min(p_partkey) AS id, lower(p_name) AS norm, min(p_size) AS size FROM part GROUP BY p_name),
    people AS (SELECT * FROM n WHERE size <= 30), al AS (SELECT norm AS alias, id AS player_id FROM n WHERE size > 40),
    x AS (SELECT n.full_name AS name, n.norm, al.player_id AS a, people.id AS e, CASE WHEN length(n.norm) <= 8 THEN 2 WHEN length(n.norm) <= 14 THEN 3 WHEN length(n.norm) <= 22 THEN 4 ELSE 5 END AS k FROM n LEFT JOIN al ON al.alias = n.norm LEFT JOIN people ON people.full_name = n.full_name),
    f AS (SELECT x.name, min(levenshtein(x.norm, p.norm)) AS least FROM x, people p WHERE a IS NULL AND e IS NULL AND levenshtein(x.norm, p.norm) <= k GROUP BY x.name)
    SELECT x.name, CASE WHEN a IS NOT NULL THEN 'alias' WHEN e IS NOT NULL THEN 'exact' WHEN f.least <= 3 THEN 'ambiguous' ELSE 'new' END AS outcome, coalesce(a, e) AS player_id FROM x LEFT JOIN f USING (name)""")
def c2_resolve_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """All part names; people are those of small parts, aliases those of large ones only."""
    n = domain.part_names(spark, folder).join(readers.table(spark, folder, "part").groupBy(F.col("p_name").alias("full_name")).agg(F.min("p_size").alias("size")), "full_name")
    aliases = n.where("size > 40").select(F.col("normalized_name").alias("normalized_alias"), F.col("id").alias("player_id"))
    return resolve.resolve_names(n.select(F.col("full_name").alias("name")), aliases, n.where("size <= 30")).select("name", "outcome", "player_id")


@query("""
    WITH RECURSIVE n AS (SELECT p_name AS name, lower(p_name) AS norm, min(p_partkey) AS id, min(p_size) AS size FROM part GROUP BY p_name),
    o AS (SELECT name, norm, id, CASE WHEN length(norm) <= 8 THEN 2 ELSE 3 END AS k FROM n WHERE size > 10 AND NOT EXISTS (
        SELECT 1 FROM n p WHERE p.size <= 10 AND levenshtein(p.norm, n.norm) <= CASE WHEN length(n.norm) <= 8 THEN 2 ELSE 3 END)),
    s AS (SELECT *, row_number() OVER (ORDER BY id DESC) - 1 AS i FROM o),
    made AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS born UNION ALL
        SELECT made.i + 1, CASE WHEN len(list_filter(born, lambda x: levenshtein(x, norm) <= k)) = 0 THEN list_append(born, norm) ELSE born END FROM made JOIN s ON s.i = made.i),
    b AS (SELECT unnest(born) AS norm FROM made WHERE i = (SELECT max(i) FROM made))
    SELECT name, CASE WHEN size <= 10 THEN 'exact' WHEN norm IN (SELECT norm FROM b) THEN 'new' ELSE 'ambiguous' END AS outcome,
        CASE WHEN size <= 10 THEN id WHEN norm IN (SELECT norm FROM b) THEN (SELECT max(p_partkey) FROM part) + row_number() OVER (PARTITION BY size > 10 AND norm IN (SELECT norm FROM b) ORDER BY id DESC) END AS player_id FROM n""")
def c2_names_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """All part names, met one by one from the largest key on; people are those of small parts, beside one who bears the largest id."""
    part = readers.table(spark, folder, "part")
    n = domain.part_names(spark, folder).join(part.groupBy(F.col("p_name").alias("full_name")).agg(F.min("p_size").alias("size")), "full_name")
    last = part.agg(F.max("p_partkey").alias("id")).select("id", F.lit(None).cast("string").alias("full_name"), F.lit(None).cast("string").alias("normalized_name"))
    people = n.where("size <= 10").select("id", "full_name", "normalized_name").unionByName(last)
    aliases = spark.createDataFrame([], "normalized_alias string, player_id long")
    return resolve.resolve_in_order(n.select(F.col("full_name").alias("name"), F.negative("id").alias("seq")), aliases, people)[0].select("name", "outcome", "player_id")


_ACTIONS = """
    WITH old AS (SELECT l_orderkey AS t, l_suppkey AS p, bool_or(l_linestatus = 'F') AS kept FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
    now AS (SELECT DISTINCT l_orderkey AS t, l_suppkey AS p FROM lineitem WHERE l_linenumber >= 2 AND l_returnflag <> 'R'), sc AS (SELECT DISTINCT t FROM now),
    a AS (SELECT coalesce(o.t, n.t) AS tournament_id, coalesce(o.p, n.p) AS player_id, CASE WHEN o.t IS NULL THEN 'new' WHEN n.t IS NOT NULL THEN 'existing' WHEN o.kept THEN 'inactivated' ELSE 'deleted' END AS action
          FROM (SELECT * FROM old SEMI JOIN sc USING (t)) o FULL JOIN now n ON o.t = n.t AND o.p = n.p)"""


def _actions(spark: SparkSession, folder: str) -> DataFrame:
    e = domain.entries(spark, folder)
    now = e.where("place >= 2 AND active").select("tournament_id", "player_id")
    return reconcile.entry_actions(e.where("place <= 3").withColumn("manual_paid", F.lit(False)), now, now)


@query(_ACTIONS + " SELECT tournament_id, player_id, action FROM a")
def c1_reconcile_actions(spark: SparkSession, folder: str) -> DataFrame:
    return _actions(spark, folder)


@query(_ACTIONS + """ SELECT tournament_id, player_id, action <> 'inactivated' AS active FROM a WHERE action <> 'deleted'
    UNION ALL SELECT t, p, true FROM old ANTI JOIN sc USING (t)""")
def c1_next_entries(spark: SparkSession, folder: str) -> DataFrame:
    prior = domain.entries(spark, folder).where("place <= 3").groupBy("tournament_id", "player_id").agg(F.min("id").alias("id"))
    prior = reconcile.conform(prior.withColumn("active", F.lit(True)), "entries")
    return reconcile.next_entries(prior, staged(_actions(spark, folder), "actions"), F.lit("1997-06-01").cast("timestamp")).select("tournament_id", "player_id", "active")


@query(_ACTIONS + " SELECT CAST(count(*) FILTER (WHERE action = 'new') AS INT) AS entries_new, CAST(count(*) FILTER (WHERE action = 'existing') AS INT) AS entries_existing, CAST(count(*) FILTER (WHERE action = 'inactivated') AS INT) AS entries_inactivated, CAST(count(*) FILTER (WHERE action = 'deleted') AS INT) AS entries_deleted FROM a")
def a8_audit_counters(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.counters(_actions(spark, folder))


@query("""
    WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS payment_id, max(CAST(value AS DECIMAL(10, 2))) AS amount FROM events WHERE event_type = 'purchase' GROUP BY 1),
    e AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_suppkey) AS p, bool_and(l_linestatus = 'F') AS paid, l_orderkey AS t, l_linenumber AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
    x AS (SELECT *, CAST(p AS VARCHAR) AS payment_id, CASE WHEN n = 1 THEN t * 10 + 2 END AS f FROM e),
    payer AS (SELECT ev.amount, x.* FROM ev JOIN (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY id) AS r FROM x) x ON x.payment_id = ev.payment_id AND x.r = 1),
    c AS (SELECT id, 'payer' AS role, CAST(NULL AS BIGINT) AS by_id, amount FROM payer WHERE NOT paid
          UNION ALL SELECT payer.f, 'partner', payer.id, payer.amount FROM payer JOIN x ON x.id = payer.f WHERE NOT x.paid)
    SELECT id, role, by_id AS paid_by_entry_id, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY role DESC, by_id) AS r FROM c) WHERE r = 1""")
def c3_payment_fold(spark: SparkSession, folder: str) -> DataFrame:
    e = domain.entries(spark, folder).groupBy("tournament_id", "place").agg(F.min("id").alias("id"), F.min("player_id").alias("p"), F.min("payment_status").alias("s"), F.max("payment_status").alias("_most"))
    e = e.select("id", F.col("p").cast("string").alias("payment_id"), F.lit("pair").alias("payment_scope"), F.when(F.col("place") == 1, F.col("tournament_id") * 10 + 2).alias("paid_for_entry_id"), F.when((F.col("s") == "paid") & (F.col("_most") == "paid"), "paid").otherwise("pending").alias("payment_status"))
    ev = readers.table(spark, folder, "events").where("event_type = 'purchase'").select(F.lit("payment.succeeded").alias("event"), F.col("user_id").cast("string").alias("payment_id"), F.col("value").cast("decimal(10,2)").cast("string").alias("amount_text"))
    return payments.payment_changes(e, ev).withColumn("amount", F.col("amount").cast("double"))


@query("""
    SELECT e.l_orderkey * 10 + e.l_linenumber AS entry_id, 'https://pay.invalid/p/e/' || CAST(e.l_orderkey * 10 + e.l_linenumber AS VARCHAR) || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '?pay=half' ELSE '' END AS payment_url,
           CASE WHEN l_returnflag = 'R' THEN 'inactive' WHEN s_suppkey % 5 = 0 THEN 'no_telegram_id' WHEN l_linenumber % 3 = 0 THEN 'already_notified' ELSE 'send' END AS outcome
    FROM lineitem e JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
    WHERE l_linestatus <> 'F' AND o_orderdate > TIMESTAMP '1997-06-01' - INTERVAL 3 HOUR""")
def c4_queue_outcome(spark: SparkSession, folder: str) -> DataFrame:
    e = domain.entries(spark, folder).drop("amount").withColumn("payment_url", F.lit(None).cast("string")).withColumn("manual_paid", F.lit(None).cast("boolean")).withColumn("telegram_notified", F.col("place") % 3 == 0)
    p = domain.players(spark, folder).withColumn("telegram_id", F.when(F.col("id") % 5 != 0, F.col("id").cast("string")))
    return queue.work_batch(e, p, domain.tournaments(spark, folder), _now(), limit=None).select("entry_id", "payment_url", "outcome")


@query("""
    WITH e AS (SELECT l_orderkey AS t, l_suppkey AS p, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem GROUP BY 1, 2), s AS (SELECT s_suppkey AS id, s_nationkey AS n FROM supplier),
    tg AS (SELECT min(id) AS id, n FROM s GROUP BY n), tw AS (SELECT s.id, tg.id AS target FROM s JOIN tg USING (n) WHERE s.id <> tg.id),
    mv AS (SELECT e.id, e.t, tw.target FROM e JOIN tw ON e.p = tw.id)
    SELECT mv.id, CASE WHEN h.p IS NULL AND mv.id = min(mv.id) OVER (PARTITION BY mv.t, mv.target) THEN 'repointed' ELSE 'deleted' END AS action, mv.target AS player_id FROM mv LEFT JOIN e h ON h.t = mv.t AND h.p = mv.target""")
def c5_merge_entries(spark: SparkSession, folder: str) -> DataFrame:
    people = domain.players(spark, folder).withColumn("normalized_name", F.col("nation_id").cast("string"))
    e = domain.entries(spark, folder).groupBy("tournament_id", "player_id").agg(F.min("id").alias("id"))
    return pending.merge_plan(people, e, people.groupBy("nation_id").agg(F.min("id").alias("player_id")))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(replace('  ' || p_name || ' x ', ' ', '   ')), '\\s+', ' ', 'g')) AS norm FROM part")
def n1_normalize(spark: SparkSession, folder: str) -> DataFrame:
    p = readers.table(spark, folder, "part")
    raw = F.replace(F.concat(F.lit("  "), F.col("p_name"), F.lit(" x ")), F.lit(" "), F.lit("   "))
    return p.select(F.col("p_partkey").alias("id"), X.normalize_name(raw).alias("norm"))


@query("SELECT o_orderkey AS id, coalesce(try_cast(regexp_extract(replace(CAST(CAST(round(o_totalprice) AS BIGINT) // 1000 AS VARCHAR) || ' 0' || o_orderpriority, ' ', ''), '([0-9]+)', 1) AS INT), 0) AS price FROM orders")
def n7_parse_price(spark: SparkSession, folder: str) -> DataFrame:
    o = readers.table(spark, folder, "orders")
    text = F.concat(F.floor(F.round("o_totalprice") / 1000).cast("string"), F.lit(" 0"), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), X.parse_price(text).alias("price"))


@query("SELECT doc_id AS id, CASE WHEN length(source || ' ' || text) <= 30 THEN source || ' ' || text ELSE left(source || ' ' || text, 27) || '...' END AS short FROM documents")
def n9_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return readers.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), X.ellipsis(F.concat("source", F.lit(" "), "text")).alias("short"))


@query("SELECT o_orderkey AS id, 'https://pay.invalid/p/e/' || o_orderkey || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '?pay=half' ELSE '' END AS link FROM orders")
def n10_link(spark: SparkSession, folder: str) -> DataFrame:
    t = domain.tournaments(spark, folder)
    return t.select("id", X.payment_link("https://pay.invalid", F.col("id"), F.col("tournament_type")).alias("link"))


@query("SELECT event_id AS id, try_cast(split_part(event_type || ':' || user_id || ':' || event_id, ':', 2) AS BIGINT) AS a, try_cast(split_part(event_type || ':' || user_id || ':' || event_id, ':', 3) AS BIGINT) AS b FROM events")
def n11_command_parts(spark: SparkSession, folder: str) -> DataFrame:
    e = readers.table(spark, folder, "events").withColumn("c", F.concat_ws(":", "event_type", "user_id", "event_id"))
    return e.select(F.col("event_id").alias("id"), X.command_part(F.col("c"), 1).alias("a"), X.command_part(F.col("c"), 2).alias("b"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M') AS shown FROM orders")
def d2_format(spark: SparkSession, folder: str) -> DataFrame:
    return domain.tournaments(spark, folder).select("id", F.date_format(F.col("starts_at") + D.hours(3), "dd.MM.yyyy HH:mm").alias("shown"))


@query("SELECT o_orderkey AS id, strftime(CASE WHEN o_orderdate > TIMESTAMP '1997-06-01' THEN o_orderdate + INTERVAL 3 HOUR ELSE TIMESTAMP '1997-06-02' END, '%Y-%m-%d %H:%M:%S') AS expires FROM orders")
def d5_expiry(spark: SparkSession, folder: str) -> DataFrame:
    return domain.tournaments(spark, folder).select("id", F.date_format(D.link_expiry(F.col("starts_at"), _now()), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (o_orderkey % 2 = 0 AND o_custkey % 3 = 0) THEN CAST(floor(o_totalprice) AS BIGINT) * 50 ELSE CAST(floor(o_totalprice) AS BIGINT) * 100 END AS minor FROM orders""")
def m1_amount(spark: SparkSession, folder: str) -> DataFrame:
    t = domain.tournaments(spark, folder)
    return t.select("id", M.to_minor(M.charge(F.floor("price_rub"), F.col("tournament_type"), F.col("id") % 2 == 0, F.col("organizer_id") % 3 == 0)).alias("minor"))


@query("""
    SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 77 WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) // 2 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS INT) AS shown FROM orders""")
def m3_display_amount(spark: SparkSession, folder: str) -> DataFrame:
    t = domain.tournaments(spark, folder)
    return t.select("id", M.display_amount(F.when(F.col("id") % 4 == 0, F.lit(77)), F.floor("price_rub"), F.col("tournament_type"), F.when(F.col("id") % 3 == 0, F.col("id"))).alias("shown"))


@query("""
    WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_orderkey) AS t, bool_or(l_linestatus = 'F') AS paid FROM lineitem GROUP BY 1)
    SELECT a.id, CASE WHEN a.id % 7 = 0 THEN NULL WHEN a.id % 11 = 0 THEN 'self' WHEN b.id IS NULL THEN 'missing' WHEN a.t <> b.t THEN 'other_event' WHEN b.paid THEN 'already_paid' END AS error
    FROM e a LEFT JOIN e b ON b.id = CASE WHEN a.id % 11 = 0 THEN a.id WHEN a.id % 3 = 0 THEN a.id + 10 ELSE a.id + 1 END""")
def e2_pair_validation(spark: SparkSession, folder: str) -> DataFrame:
    e = domain.entries(spark, folder).groupBy("id").agg(F.min("tournament_id").alias("t"), F.min("payment_status").alias("s"))
    asked = e.withColumn("wanted", F.when(F.col("id") % 11 == 0, F.col("id")).when(F.col("id") % 3 == 0, F.col("id") + 10).otherwise(F.col("id") + 1))
    other = e.select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.col("s").alias("_s"))
    j = asked.join(other, F.col("wanted") == F.col("_id"), "left")
    return j.select("id", payments.pair_error(F.col("id"), F.when(F.col("id") % 7 != 0, F.col("wanted")), F.col("_id"), F.col("t"), F.col("_t"), F.col("_s")).alias("error"))


@query("""
    WITH e AS (SELECT l_orderkey AS t, count(*) AS n, count(DISTINCT l_suppkey) AS d, count(*) FILTER (WHERE l_linestatus <> 'F') AS o FROM lineitem GROUP BY 1)
    SELECT t AS id, CASE WHEN n <> 2 THEN 'missing' WHEN d <> 1 THEN 'other_event' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'not_team' WHEN o <> 2 THEN 'already_paid' END AS error FROM e JOIN orders ON o_orderkey = t""")
def e3_team_validation(spark: SparkSession, folder: str) -> DataFrame:
    e = domain.entries(spark, folder).groupBy("tournament_id").agg(F.count("*").alias("n"), F.count_distinct("player_id").alias("d"), F.count(F.when(F.col("payment_status") == "pending", 1)).alias("o"))
    j = e.join(domain.tournaments(spark, folder), F.col("tournament_id") == F.col("id"))
    return j.select("id", payments.team_error(F.col("n"), F.col("d"), F.col("tournament_type"), F.col("o")).alias("error"))


@query("""
    SELECT o_orderkey AS id, o_orderstatus = 'O' AND (CASE WHEN o_orderkey % 2 = 0 THEN 'pair' ELSE 'self' END) IS NOT DISTINCT FROM (CASE WHEN o_orderkey % 3 = 0 THEN 'pair' ELSE 'self' END)
           AND (o_orderkey % 3 <> 0 OR (CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END) IS NOT DISTINCT FROM (CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END)) AS reusable FROM orders""")
def e4_reuse(spark: SparkSession, folder: str) -> DataFrame:
    o = readers.table(spark, folder, "orders")
    scope = lambda n: F.when(F.col("o_orderkey") % n == 0, "pair").otherwise("self")
    mate = lambda n: F.when(F.col("o_orderkey") % n != 0, F.col("o_custkey"))
    status = F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done")
    return o.select(F.col("o_orderkey").alias("id"), payments.reusable(status, scope(2), scope(3), mate(5), mate(7)).alias("reusable"))


@query("""
    SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'paid_inactive' WHEN l_returnflag = 'R' THEN 'inactive' ELSE 'active' END AS state,
           CASE WHEN l_suppkey % 5 = 0 THEN 'no_chat' WHEN l_linenumber % 3 = 0 THEN 'sent' ELSE 'not_sent' END AS badge FROM lineitem""")
def e5_e6_badges(spark: SparkSession, folder: str) -> DataFrame:
    e = domain.entries(spark, folder)
    active = F.when(F.col("active"), F.lit(None)).otherwise(F.lit(False)).cast("boolean")  # a missing flag is active
    return e.select("id", views.entry_state(F.col("payment_status"), active).alias("state"), views.notice_badge(F.when(F.col("player_id") % 5 != 0, F.col("player_id").cast("string")), F.when(F.col("place") % 3 == 0, F.lit(True))).alias("badge"))


@query("""
    WITH pr AS (SELECT DISTINCT left(p_name, 5) || '%' AS probe FROM part), n AS (SELECT p_name AS full_name, min(p_partkey) AS id FROM part GROUP BY 1)
    SELECT probe, min(id) AS player_id FROM pr JOIN n ON upper(n.full_name) ILIKE probe GROUP BY probe HAVING count(*) = 1""")
def a12_f9_unique_match(spark: SparkSession, folder: str) -> DataFrame:
    n = domain.part_names(spark, folder)
    probes = n.select(F.concat(F.substring("full_name", 1, 5), F.lit("%")).alias("probe")).distinct()
    return patterns.unique_match(probes, n.withColumn("lunda_name", F.lit(None).cast("string")).withColumn("full_name", F.upper("full_name")))


_OPEN = """
    WITH n AS (SELECT c_custkey AS id, c_name AS name FROM customer),
    pr AS (SELECT DISTINCT unnest(['%' || substr(name, 13, 4) || '%', '%' || right(name, 3), '_USTOMER#%' || right(name, 4), '%r#0_0%' || right(name, 2) || '%', left(name, 1) || '%', '%' || right(name, 1), repeat('_', length(name)), '%']) AS probe FROM n)"""


@query(_OPEN + " SELECT probe, min(id) AS player_id FROM pr JOIN n ON n.name ILIKE probe GROUP BY probe HAVING count(*) = 1")
def f9_open_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by patterns that begin with wildcards, with runs of four letters, of one, and of none."""
    n = readers.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"))
    name, last = F.col("full_name"), lambda k: F.right("full_name", F.lit(k))
    probes = F.array(F.concat(F.lit("%"), F.substring(name, 13, 4), F.lit("%")), F.concat(F.lit("%"), last(3)), F.concat(F.lit("_USTOMER#%"), last(4)), F.concat(F.lit("%r#0_0%"), last(2), F.lit("%")), F.concat(F.left(name, F.lit(1)), F.lit("%")), F.concat(F.lit("%"), last(1)), F.repeat(F.lit("_"), F.length(name)), F.lit("%"))
    return patterns.unique_match(n.select(F.explode(probes).alias("probe")), n, columns=("full_name",))


@query("SELECT a.s_suppkey AS id, b.s_suppkey AS other_id FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def j15_identity_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.identity_conflicts(domain.players(spark, folder).withColumn("telegram_id", F.col("nation_id").cast("string")))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def k2_json_path(spark: SparkSession, folder: str) -> DataFrame:
    return readers.table(spark, folder, "events").select(F.col("event_id").alias("id"), X.json_field(F.col("props"), "k", "bigint").alias("k"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id AS created FROM events")
def k3_json_set(spark: SparkSession, folder: str) -> DataFrame:
    e = readers.table(spark, folder, "events").select("event_id", X.json_with(F.from_json("props", "k long"), "created", F.col("user_id")).alias("p"))
    back = F.from_json(X.to_json_text(F.col("p")), "k long, created long")
    return e.select(F.col("event_id").alias("id"), back["k"].alias("k"), back["created"].alias("created"))


@query("SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS filled FROM conversations")
def r1_array_filter(spark: SparkSession, folder: str) -> DataFrame:
    return readers.table(spark, folder, "conversations").select("conv_id", "turn", F.size(X.filled_only(F.split("text", " "))).cast("long").alias("filled"))


@query("SELECT conv_id, turn, CAST(p - 1 AS INT) AS place, s[p] AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS s, unnest(range(1, len(string_split(text, ' ')) + 1)) AS p FROM conversations)")
def r2_explode(spark: SparkSession, folder: str) -> DataFrame:
    return readers.rosters(readers.table(spark, folder, "conversations").withColumn("participants", F.split("text", " ")), "conv_id", "turn").withColumnRenamed("raw_player_name", "word")


@query("SELECT p_partkey AS id, CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN len(string_split(p_name, ' ')) ELSE len(string_split(p_name, ' ')) + 1 END AS n FROM part")
def r4_append(spark: SparkSession, folder: str) -> DataFrame:
    return readers.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.size(X.appended(F.split("p_name", " "), F.lit(" red "))).cast("long").alias("n"))


@query("SELECT try_cast(regexp_extract(line, 'PID=([0-9]+)', 1) AS INT) AS pid, regexp_extract(line, 'Time=([0-9-]+ [0-9:]+)', 1) AS started_text FROM (SELECT CASE WHEN event_type = 'purchase' THEN 'RUN START: PID=' || user_id || ', Time=' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' +0300' ELSE 'RUN TYPE: MANUAL' END AS line FROM events) WHERE line LIKE '%RUN START:%'")
def s11_log_fields(spark: SparkSession, folder: str) -> DataFrame:
    e = readers.table(spark, folder, "events")
    line = F.when(F.col("event_type") == "purchase", F.concat(F.lit("RUN START: PID="), F.col("user_id").cast("string"), F.lit(", Time="), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0300"))).otherwise("RUN TYPE: MANUAL")
    return readers.log_runs(e.select(line.alias("value")))


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def o2_latest_run(spark: SparkSession, folder: str) -> DataFrame:
    e = readers.table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), "user_id")
    return views.latest_run(e).withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@query("""
    WITH x AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1)
    SELECT coalesce(c_custkey, k) AS id, CASE WHEN k IS NOT NULL THEN v WHEN c_acctbal > 0 THEN c_custkey END AS value,
           CASE WHEN c_custkey IS NULL THEN v WHEN c_acctbal > 0 THEN c_custkey ELSE v END AS filled
    FROM customer c FULL JOIN x ON c_custkey = k""")
def u3_u4_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer's last order over all customers, those without orders too."""
    own = F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))
    prior = readers.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), own.alias("value"), own.alias("filled"))
    new = readers.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("value"))
    return mutate.upsert(prior, new.withColumn("filled", F.col("value")), ["id"], ["value"], fill=["filled"])


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7) AND s_acctbal > 0 THEN NULL ELSE s_nationkey END AS nation_id FROM supplier")
def u6_u15_guarded_update(spark: SparkSession, folder: str) -> DataFrame:
    chosen = domain.entries(spark, folder).where("place = 7 AND NOT active").select(F.col("player_id").alias("id")).distinct().withColumn("nation_id", F.lit(None).cast("int"))
    return mutate.update_keyed(domain.players(spark, folder), chosen, ["id"], ["nation_id"], guard=F.col("balance") > 0).select("id", "nation_id")


@query("""
    SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN n.n_name END AS nation FROM supplier JOIN nation n ON n_nationkey = s_nationkey WHERE n_regionkey <> 2""")
def u13_references(spark: SparkSession, folder: str) -> DataFrame:
    n = readers.table(spark, folder, "nation")
    p = domain.players(spark, folder).withColumn("ref", F.col("id"))
    left = mutate.cascade_delete(p, n.where("n_regionkey = 2").select(F.col("n_nationkey").alias("id")), "nation_id")
    left = mutate.null_references(left, p.where("id % 4 = 0"), "ref")
    return left.join(n, F.col("nation_id") == F.col("n_nationkey")).select("id", F.when(F.col("ref").isNotNull(), F.col("n_name")).alias("nation"))


@query("""
    WITH s AS (SELECT l_suppkey AS telegram_id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linestatus = 'F' THEN 'bind_pick_date' ELSE 'bind_confirm' END AS state FROM lineitem)
    SELECT telegram_id, max({'seq': seq, 'state': state}).state AS last FROM s GROUP BY 1""")
def st1_session_fold(spark: SparkSession, folder: str) -> DataFrame:
    """All entries are steps; of those that repeat a key, the greatest state is the last."""
    from quillroster.streaming.sessions import fold_sessions

    support = F.lit(None).cast("boolean").alias("support")
    steps = domain.entries(spark, folder).select(F.col("player_id").alias("telegram_id"), F.col("id").alias("seq"), F.when(F.col("payment_status") == "paid", "pick_date").otherwise("confirm").alias("step"), support)
    opening = steps.select("telegram_id").distinct().select("telegram_id", F.lit(0).cast("long").alias("seq"), F.lit("ask_name").alias("step"), support)
    return fold_sessions(steps.unionByName(opening)).select("telegram_id", F.col("state").alias("last"))


@query("""
    WITH s AS (SELECT l_suppkey AS telegram_id, l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS shipped, CASE WHEN l_linestatus = 'F' THEN 'bind_pick_date' ELSE 'bind_confirm' END AS state FROM lineitem)
    SELECT telegram_id, max({'seq': seq, 'shipped': shipped, 'state': state}).state AS last FROM s GROUP BY 1""")
def st1_session_fold_all(spark: SparkSession, folder: str) -> DataFrame:
    """All entries are steps; those that repeat a key are ordered by time, then by state."""
    from quillroster.streaming.sessions import fold_sessions

    e = domain.entries(spark, folder)
    support = F.lit(None).cast("boolean").alias("support")
    steps = e.select(F.col("player_id").alias("telegram_id"), F.col("id").alias("seq"), F.col("created_at").alias("at"), F.when(F.col("payment_status") == "paid", "pick_date").otherwise("confirm").alias("step"), support)
    opening = e.groupBy(F.col("player_id").alias("telegram_id")).agg(F.min("created_at").alias("at")).select("telegram_id", F.lit(0).cast("long").alias("seq"), "at", F.lit("ask_name").alias("step"), support)
    return fold_sessions(steps.unionByName(opening), ("at",)).select("telegram_id", F.col("state").alias("last"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1997-06-01'")
def f14_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    t = domain.tournaments(spark, folder).withColumn("location", F.lit("")).withColumn("active", F.lit(None).cast("boolean"))
    return views.dashboard(t, _now()).where("location IS NULL AND active").select("id")


@query("SELECT l_orderkey AS tournament_id, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS minor FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber <> 2 GROUP BY 1")
def q5_revenue(spark: SparkSession, folder: str) -> DataFrame:
    e = domain.entries(spark, folder).select("tournament_id", "payment_status", F.when(F.col("place") == 2, F.col("id")).alias("paid_by_entry_id"), F.round("amount", 2).cast("decimal(10,2)").alias("paid_amount_rub"))
    return payments.revenue(e).select("tournament_id", (F.col("revenue") * 100).cast("long").alias("minor"))
