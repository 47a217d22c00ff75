"""Amounts, in decimals throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"


def charge(price: Column, kind: Column, pay_full: Column, has_partner: Column) -> Column:
    """The whole price; half of it for a team's entry, unless it pays for its partner too."""
    whole = price.cast(MONEY)
    return F.when((kind == "team") & ~(pay_full & has_partner), (whole / 2).cast(MONEY)).otherwise(whole)


def display_amount(paid: Column, price: Column, kind: Column, paid_by: Column) -> Column:
    """Whole units: what was paid, else half for a team's entry that its partner hasn't paid for, else the price."""
    due = F.when((kind == "team") & paid_by.isNull(), price.cast(MONEY) / 2).otherwise(price.cast(MONEY))
    return F.coalesce(paid.cast(MONEY), due).cast("int")


def amount_text(amount: Column) -> Column:
    return amount.cast(MONEY).cast("string")


def to_minor(amount: Column) -> Column:
    return (amount.cast(MONEY) * 100).cast("long")


def from_minor(minor: Column) -> Column:
    return (minor.cast("decimal(18,0)") / 100).cast(MONEY)


def lenient_amount(text: Column) -> Column:
    """Null where the text is no number."""
    return F.trim(text).try_cast(MONEY)
