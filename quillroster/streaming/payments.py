"""Payment events as a stream over bucketed tables: a micro-batch rewrites the buckets that it changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillroster.operators.outbox import OUTBOX, notices
from quillroster.operators.payments import paid_entries, payment_changes
from quillroster.sources import schemas
from quillroster.sources.sinks import BUCKETS, bucket_of, buckets_at, exists, put_buckets
from quillroster.sources.staging import staged


@dataclass
class Ledger:
    """entries (by id), outbox (by payment_id) and, where notices are wanted, players under one folder."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    def _at(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def create(self, entries: DataFrame, players: DataFrame | None = None) -> None:
        put_buckets(entries, self._at("entries"), "id", self.buckets)
        if players is not None:
            put_buckets(players, self._at("players"), "id", self.buckets)

    def entries(self, only: list[int] | None = None) -> DataFrame:
        return buckets_at(self.spark, self._at("entries"), schemas.TABLES["entries"], only)

    def outbox(self, only: list[int] | None = None) -> DataFrame:
        if not exists(self.spark, self._at("outbox")):
            return self.spark.createDataFrame([], f"{OUTBOX}, bucket int")
        return buckets_at(self.spark, self._at("outbox"), OUTBOX, only)

    def players(self) -> DataFrame | None:
        return buckets_at(self.spark, self._at("players"), schemas.TABLES["players"]) if exists(self.spark, self._at("players")) else None

    def _touched(self, keys: DataFrame, key: str) -> list[int]:
        """The buckets of some keys: `buckets` numbers at most."""
        return [r[0] for r in keys.select(bucket_of(key, self.buckets).alias("bucket")).distinct().collect()]

    def apply(self, batch: DataFrame, as_of: Column) -> tuple[list[int], list[int]]:
        """Apply events (event, payment_id, amount_text) -> the buckets of entries and of the outbox that have been rewritten.

        Every payment counts, and is told of, once, however often a batch or an event comes: what has been applied makes no change, and
        a bucket without one isn't written. A batch that dies halfway is therefore applied again as it is.
        """
        batch = staged(batch, "payments")
        counted = batch.where((F.col("event") == "payment.succeeded") & F.col("payment_id").isNotNull())
        if counted.isEmpty():  # as the batches are by which a stream's watermark goes on
            return [], []
        changes = staged(payment_changes(self.entries(), counted), "changes")
        paid = self._touched(changes, "id")
        if paid:
            # The fold of the events over the changed entries alone; what an entry pays for is in the changes already.
            put_buckets(paid_entries(self.entries(paid), changes, as_of), self._at("entries"), "id", self.buckets)
        players, told = self.players(), []
        if players is not None:
            asked = staged(counted.select("payment_id").distinct(), "asked")
            known = self.outbox(self._touched(asked, "payment_id")) if exists(self.spark, self._at("outbox")) else None
            found = notices(self.entries().select("id", "player_id", "payment_id", "paid_by_entry_id"), players, asked, as_of, known)
            if known is None:
                put_buckets(found, self._at("outbox"), "payment_id", self.buckets)
                told = [r[0] for r in self.outbox().select("bucket").distinct().collect()]
            else:
                new = staged(found, "new_notices")
                told = self._touched(new, "payment_id")
                if told:
                    # None of them is in the outbox.
                    put_buckets(self.outbox(told).drop("bucket").unionByName(new), self._at("outbox"), "payment_id", self.buckets)
        return sorted(paid), sorted(told)


def once(events: DataFrame, within: str = "1 day") -> DataFrame:
    """A stream of events (arrived_at and others) without those that come again, equal but for their time, within that time: their keys are kept as state until the watermark has passed."""
    return events.withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(["event", "payment_id", "amount_text"])


def apply_stream(events: DataFrame, ledger: Ledger, checkpoint: str, as_of: Column | None = None, within: str | None = "1 day", **trigger: bool | str) -> StreamingQuery:
    """Apply a stream of events. Without as_of, batches have the time at which they run.

    Events that come again within `within` never reach the fold; later ones reach it and change nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        ledger.apply(batch, F.current_timestamp() if as_of is None else as_of)

    kept = once(events, within) if within else events
    return kept.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
