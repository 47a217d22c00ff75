"""The tables' schemas, and bringing a frame to one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


CANDIDATE = "struct<player_id:bigint,name:string,dist:int,score:int,surname_dist:int,name_dist:int>"
PAYLOAD = "struct<tournament_id:bigint,raw_player_name:string,normalized_name:string,created_player_id:bigint>"

#: Columns and types as DDL, so that importing needs no session.
TABLES: dict[str, str] = {
    "tournaments": "id bigint, location string, starts_at timestamp, ends_at timestamp, organizer string, title string, price_rub int, source_last_updated timestamp, tournament_type string, active boolean, archived_at timestamp, first_seen_in_source timestamp, last_seen_in_source timestamp, source string",
    "players": "id bigint, full_name string, normalized_name string, telegram_id string, lunda_name string, telegram_verified_at timestamp",
    "entries": "id bigint, tournament_id bigint, player_id bigint, payment_status string, payment_id string, payment_url string, confirmation_url string, payment_scope string, paid_for_entry_id bigint, paid_by_entry_id bigint, paid_amount_rub decimal(10,2), paid_at timestamp, manual_paid boolean, manual_note string, active boolean, telegram_notified boolean, telegram_notified_at timestamp, first_seen_in_source timestamp, last_seen_in_source timestamp, created_at timestamp",
    "player_aliases": "id bigint, alias_name string, normalized_alias string, player_id bigint, created_by_telegram_id string, created_at timestamp",
    "pending_entries": f"id bigint, sync_run_id bigint, tournament_id bigint, raw_player_name string, normalized_name string, payload {PAYLOAD}, candidates array<{CANDIDATE}>, status string, created_at timestamp, admin_message_id bigint, notified_at timestamp, resolved_at timestamp, resolved_player_id bigint",
    "sync_runs": "id bigint, source string, started_at timestamp, finished_at timestamp, tournaments_upsert int, players_upsert int, entries_new int, entries_existing int, entries_deleted int, entries_inactivated int, error string, json_path string, json_mtime timestamp, created_at timestamp",
    "telegram_sessions": "telegram_id string, state string, temp_name string, support_mode boolean, updated_at timestamp, data string",
}
#: What columns hold where a row says nothing.
DEFAULTS: dict[str, dict[str, object]] = {
    "tournaments": {"tournament_type": "personal", "active": True, "source": "manual"},
    "entries": {"payment_status": "pending", "payment_scope": "self", "manual_paid": False, "active": True, "telegram_notified": False},
    "pending_entries": {"status": "pending"},
}
#: What the CHECK constraints allow.
ALLOWED: dict[str, dict[str, tuple[str, ...]]] = {
    "tournaments": {"tournament_type": ("personal", "team")},
    "entries": {"payment_scope": ("self", "pair")},
    "pending_entries": {"status": ("pending", "approved", "rejected", "expired", "resolved", "snoozed")},
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types; columns that it lacks get the default, or null."""
    defaults = DEFAULTS.get(table, {})

    def column(field: T.StructField) -> Column:
        made = F.col(field.name) if field.name in df.columns else F.lit(defaults.get(field.name))
        return made.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema(table)])


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that break a CHECK, with the column's name in `violation`; a null passes, as in SQL."""
    broken = [F.when(~F.col(c).isin(*values), F.lit(c)) for c, values in ALLOWED.get(table, {}).items()]
    return df.withColumn("violation", F.coalesce(*broken, F.lit(None).cast("string"))).where("violation IS NOT NULL")
