"""Sources: parquet tables, snapshot documents, payment and chat events, people lists, import logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillroster.functions import text as X
from quillroster.functions.timeops import parse_source_time
from quillroster.sources.staging import staged

EVENT = "struct<start_datetime:string,end_datetime:string,last_updated:string,tournament_type:string,participants:array<string>,tournament:struct<title:string,location:string,organizer:string,price:string,participants:string>>"
PAYMENT = "event string, object struct<id:string,amount:struct<value:string>>"
CHAT = "update_id bigint, message struct<text:string,chat:struct<id:bigint>,from:struct<id:bigint,username:string>>, callback_query struct<id:string,data:string,from:struct<id:bigint>,message:struct<message_id:bigint,chat:struct<id:bigint>>>"
RUN_START = r"RUN START: PID=([0-9]+), Time=([0-9-]+ [0-9:]+)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A database table, read in parallel ranges of key where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents -> one row for each event, in file order (position).

    `tournaments` may be a map of events or a list; anything else, or none, makes no rows: see
    snapshot_problem. An event's own last_updated gives way to the document's where it is empty.
    """
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"))
    return snapshot_rows(docs)


def snapshot_rows(docs: DataFrame) -> DataFrame:
    raw = F.trim(F.get_json_object("value", "$.tournaments"))
    events = F.when(raw.startswith("["), F.from_json(raw, f"array<{EVENT}>")).when(raw.startswith("{"), F.map_values(F.from_json(raw, f"map<string,{EVENT}>")))
    rows = docs.select("file", "modified_at", F.get_json_object("value", "$.last_updated").alias("all_updated"), F.posexplode(events).alias("position", "e"))
    return rows.select(
        "file", "modified_at", "position", F.col("e.tournament.title").alias("title"), F.col("e.tournament.location").alias("location"), F.col("e.tournament.organizer").alias("organizer"),
        X.parse_price(F.col("e.tournament.price")).alias("price_rub"), parse_source_time(F.col("e.start_datetime")).alias("starts_at"), parse_source_time(F.col("e.end_datetime")).alias("ends_at"),
        parse_source_time(X.first_filled(F.col("e.last_updated"), F.col("all_updated"))).alias("source_last_updated"), X.tournament_type(F.col("e.tournament_type")).alias("tournament_type"),
        F.coalesce(X.filled_only(F.col("e.participants")), F.array().cast("array<string>")).alias("participants"),
    )


def snapshot_problem(docs: DataFrame) -> DataFrame:
    """(file, problem) for documents without events: `missing`, `empty` or `not events`."""
    raw = F.trim(F.get_json_object("value", "$.tournaments"))
    problem = F.when(raw.isNull(), "missing").when(raw.isin("[]", "{}"), "empty").when(~(raw.startswith("[") | raw.startswith("{")), "not events")
    return docs.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def rosters(events: DataFrame, *keys: str) -> DataFrame:
    """A row for each name on each roster, in order."""
    return events.select(*keys, F.posexplode("participants").alias("place", "raw_player_name"))


def payment_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(event, payment_id, amount_text, arrived_at) of webhook bodies; as a stream, files are read as they arrive. A body arrives when its file is written."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(PAYMENT).json(path).select(F.col("_metadata.file_modification_time").alias("arrived_at"), "event", F.col("object.id").alias("payment_id"), X.blank_to_null(F.col("object.amount.value")).alias("amount_text"))


def chat_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(seq, telegram_id, text, command) of chat updates; seq is their number."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(CHAT).json(path).select(F.col("update_id").alias("seq"), F.coalesce("message.from.id", "callback_query.from.id").cast("string").alias("telegram_id"), F.col("message.text").alias("text"), F.col("callback_query.data").alias("command"))


def chat_updates(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return chat_events(spark, path, stream).drop("seq")


def people(spark: SparkSession, path: str) -> DataFrame:
    """People from CSV with a header; quotes within quoted names are doubled."""
    return spark.read.schema("id bigint, full_name string").csv(path, header=True, escape='"')


def log_runs(lines: DataFrame, column: str = "value") -> DataFrame:
    """(pid, started_text) of the lines that mark the start of a run."""
    return lines.where(F.col(column).contains("RUN START:")).select(F.regexp_extract(column, RUN_START, 1).try_cast("int").alias("pid"), F.regexp_extract(column, RUN_START, 2).alias("started_text"))


def latest_runs(lines: DataFrame, n: int, column: str = "value") -> DataFrame:
    return log_runs(lines, column).orderBy(F.desc("started_text"), F.desc("pid")).limit(n)


#: The lines of a log that say of which kind a run is, that something went wrong, and that the import is through.
RUN_TYPE, RUN_ERROR, RUN_END = r"RUN TYPE: ([A-Z]+)", r"^ERROR: (.*)$", "Entries DELETED:"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the lines of log files; (block, at) is their order within a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def runs_from_log(lines: DataFrame) -> DataFrame:
    """lines as log_lines gives them -> one row for each run: file, pid, started_text, kind, errors, first_error, state.

    A line belongs to the last run that has started before it in its file; lines before the first start belong to none. kind is null
    where no line says it. state: failed (an error line), finished (the closing line), running (the file's last run, without one),
    else broken. A file is read in blocks: what each leaves to the next is its last start, so that only a row for each block meets in
    a window over a file.
    """
    start = F.when(F.col("value").contains("RUN START:"), F.struct("block", "at", F.regexp_extract("value", RUN_START, 1).try_cast("int").alias("pid"), F.regexp_extract("value", RUN_START, 2).alias("started_text")))
    marks = lines.withColumn("_start", start).where(F.col("_start").isNotNull() | F.col("value").rlike(f"{RUN_TYPE}|{RUN_ERROR}") | F.col("value").contains(RUN_END))
    marks = staged(marks, "marks")
    left = marks.groupBy("file", "block").agg(F.max("_start").alias("_leaves"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("file", "block", F.last("_leaves", True).over(before).alias("_carried"), (F.max("_leaves").over(Window.partitionBy("file"))).alias("_newest"))
    here = F.last("_start", True).over(Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    owned = marks.withColumn("_here", here).join(carried, ["file", "block"]).withColumn("_run", F.coalesce("_here", "_carried")).where("_run IS NOT NULL")
    order, found = F.struct("block", "at"), lambda pattern: F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))
    told = lambda pattern: F.min(F.when(F.col("value").rlike(pattern), F.struct(order, found(pattern).alias("text"))))
    runs = owned.groupBy("file", "_run").agg(told(RUN_TYPE).alias("_kind"), told(RUN_ERROR).alias("_error"), F.count_if(F.col("value").rlike(RUN_ERROR)).alias("errors"), F.bool_or(F.col("value").contains(RUN_END)).alias("_through"), F.max("_newest").alias("_newest"))
    state = F.when(F.col("errors") > 0, "failed").when(F.col("_through"), "finished").when(F.col("_run") == F.col("_newest"), "running").otherwise("broken")
    return runs.select("file", F.col("_run.pid").alias("pid"), F.col("_run.started_text").alias("started_text"), F.col("_kind.text").alias("kind"), "errors", F.col("_error.text").alias("first_error"), state.alias("state"))


def error_age(error_at: Column, last_start: Column) -> Column:
    """Whether an error file changed at error_at is of the last run: struct(state: current, old or none, days, hours before it)."""
    hours = F.floor((F.unix_seconds(last_start) - F.unix_seconds(error_at)) / 3600).cast("int")
    old = error_at < last_start
    return F.struct(F.when(error_at.isNull() | last_start.isNull(), "none").when(old, "old").otherwise("current").alias("state"), F.when(old, F.floor(hours / 24).cast("int")).alias("days"), F.when(old, hours).alias("hours"))
