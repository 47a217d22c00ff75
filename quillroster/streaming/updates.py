"""Chat updates to the steps of sessions: commands by their names, dates by the events on them, typed names by a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillroster.functions import timeops as D
from quillroster.operators.patterns import unique_match

#: Buttons that are sent as texts, and the steps of commands that need no look-up.
HELP, BUTTONS = "Помощь", ("Помощь", "Мои турниры", "Привязать аккаунт")
COMMANDS = {"bind_pick_tournament": "pick_player", "bind_pick_player": "confirm", "bind_confirm": "bound"}
BACK = {"menu": "cancel", "date": "pick_date"}
STEPS = "telegram_id string, seq bigint, step string, support boolean"


def update_steps(updates: DataFrame, players: DataFrame, tournaments: DataFrame, as_of: Column) -> DataFrame:
    """updates (seq, telegram_id, text, command) -> telegram_id, seq, step, support; updates that are no step are left out.

    A date leads on only where a live event is still ahead on it. A typed text is `named` if exactly one person
    without a chat bears the name, `unnamed` else, a text that is no pattern included: what it means
    is up to the session (see sessions). Texts that begin with a slash and buttons are no names.
    """
    rows = updates.where("telegram_id IS NOT NULL AND seq IS NOT NULL").select("seq", "telegram_id", F.trim("text").alias("_text"), "command", F.split("command", ":").alias("_parts"))
    typed = F.col("_text").isNotNull() & (F.col("_text") != "") & ~F.col("_text").startswith("/") & ~F.col("_text").isin(*BUTTONS)
    free = players.where(F.coalesce("telegram_id", F.lit("")) == "").select("id", "full_name", "lunda_name")
    asked = rows.where(typed & F.col("_text").rlike(r"(?s)^([^\\]|\\[%_\\])*$")).select(F.col("_text").alias("probe"))
    found = unique_match(asked, free).select(F.col("probe").alias("_text"), F.lit(True).alias("_one"))
    ahead = tournaments.where(F.col("archived_at").isNull() & (F.col("starts_at") >= as_of)).select(D.shown_date(F.col("starts_at")).cast("string").alias("_day"), F.lit(True).alias("_any")).distinct()
    name, first = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1))
    both = rows.withColumn("_day", F.when(name == "bind_date", first)).join(ahead, "_day", "left").join(found, "_text", "left")
    step = F.when(F.col("_text") == HELP, "support").when(typed, F.when(F.col("_one"), "named").otherwise("unnamed")).when(F.col("_any"), "pick_tournament")
    for command, made in COMMANDS.items():
        step = step.when(name == command, made)
    for target, made in BACK.items():
        step = step.when((name == "bind_back") & (first == target), made)
    return both.withColumn("step", step).where("step IS NOT NULL").select("telegram_id", "seq", "step", F.when(F.col("step") == "support", True).alias("support"))


def steps_stream(updates: DataFrame, players: DataFrame, tournaments: DataFrame, folder: str, checkpoint: str, as_of: Column | None = None, **trigger: bool | str) -> StreamingQuery:
    """A stream of updates, each micro-batch turned into a folder of steps of its own; one that comes again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        made = update_steps(batch, players, tournaments, F.current_timestamp() if as_of is None else as_of)
        made.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_steps(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The steps that steps_stream has written; as a stream, batches are read as they come."""
    return (spark.readStream if stream else spark.read).schema(STEPS).parquet(f"{folder}/batch=*")
