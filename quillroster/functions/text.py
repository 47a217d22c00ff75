"""Scalar text, JSON and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The largest edit distance that a name may differ by, up to each length, and beyond.
NAME_DISTANCE = ((8, 2), (14, 3), (22, 4))
NAME_DISTANCE_BEYOND = 5
TYPES = ("personal", "team")
PAID_STATES = ("paid", "completed", "success", "successful")


def normalize_name(name: Column) -> Column:
    """Lower case, one letter variant folded, runs of any Unicode white space squeezed, ends trimmed; null is empty."""
    return F.coalesce(normalize_name_sql(F.regexp_replace(name, r"^(?U)\s+|(?U)\s+$", "")), F.lit(""))


def normalize_name_sql(name: Column) -> Column:
    """The SQL function's variant: ends are trimmed of spaces only, before white space is squeezed; null stays null."""
    return F.regexp_replace(F.replace(F.lower(F.trim(name)), F.lit("ё"), F.lit("е")), r"(?U)\s+", " ")


def name_distance_limit(name: Column) -> Column:
    out = F.lit(NAME_DISTANCE_BEYOND)
    for most, limit in reversed(NAME_DISTANCE):
        out = F.when(F.length(name) <= most, F.lit(limit)).otherwise(out)
    return out


def surname(name: Column) -> Column:
    return F.get(F.split(F.trim(name), r"\s+"), F.lit(0))


def given_name(name: Column) -> Column:
    """Null for a single word."""
    return F.get(F.split(F.trim(name), r"\s+"), F.lit(1))


def distance(a: Column, b: Column) -> Column:
    """Edit distance; null if either side is empty or null."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.levenshtein(a, b))


def match_score(full: Column, surname_distance: Column, name_distance: Column) -> Column:
    """Smaller is better; a part that one side lacks counts as 999."""
    return full * 10 + F.coalesce(surname_distance, F.lit(999)) * 3 + F.coalesce(name_distance, F.lit(999)) * 3


def first_letter_off(a: Column, b: Column) -> Column:
    """Equal but for a first letter that one side lacks or that differs."""
    return (F.substr(a, F.lit(2)) == b) | (F.substr(b, F.lit(2)) == a) | (F.substr(a, F.lit(2)) == F.substr(b, F.lit(2)))


def parse_price(text: Column) -> Column:
    """The first run of digits once spaces are taken out; 0 where there is none or it is too large."""
    return F.coalesce(F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), "([0-9]+)", 1).try_cast("int"), F.lit(0))


def tournament_type(text: Column) -> Column:
    return F.when(F.lower(text).isin(*TYPES), F.lower(text)).otherwise(F.lit(TYPES[0]))


def ellipsis(text: Column, most: int = 30) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def payment_link(base: str, entry_id: Column, kind: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/p/e/"), entry_id.cast("string"), F.when(kind == "team", F.lit("?pay=half")).otherwise(F.lit("")))


def command_part(payload: Column, at: int) -> Column:
    """Part `at` of a command like name:1:2, as a number; null where it isn't one."""
    return F.get(F.split(payload, ":"), F.lit(at)).try_cast("long")


def bump_counter(text: Column, by: int = 1) -> Column:
    """"x/y ..." with x raised; other texts as they are."""
    x = F.regexp_extract(text, r"^\s*([0-9]+)\s*/", 1).try_cast("int")
    return F.when(x.isNotNull(), F.concat((x + by).cast("string"), F.regexp_extract(text, r"^\s*[0-9]+(\s*/.*)$", 1))).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


def lenient_json(text: Column, schema: T.DataType) -> Column:
    """An array from JSON text; empty where the text is null, empty or broken."""
    return F.coalesce(F.from_json(text, schema), F.array().cast(schema))


def json_field(text: Column, field: str, kind: str) -> Column:
    """A field of a JSON object text, as a type; null where the text is broken or has none."""
    return F.from_json(text, f"`{field}` {kind}")[field]


def json_with(payload: Column, field: str, value: Column) -> Column:
    return payload.withField(field, value)


def to_json_text(payload: Column) -> Column:
    return F.to_json(payload, {"ignoreNullFields": "false"})


def filled_only(names: Column) -> Column:
    return F.filter(names, lambda x: x.isNotNull() & (x != ""))


def appended(names: Column, name: Column) -> Column:
    """names and name behind them, unless it is there but for white space at the ends."""
    return F.when(F.exists(names, lambda x: F.trim(x) == F.trim(name)), names).otherwise(F.array_append(names, name))


def without_name(candidates: Column, name: Column, most: int) -> Column:
    """The first `most` candidate structs whose name differs."""
    return F.slice(F.filter(candidates, lambda c: c["name"] != name), 1, most)


def first_key_like(values: Column, part: str) -> Column:
    """The smallest map key that contains part."""
    return F.array_min(F.filter(F.map_keys(values), lambda k: F.contains(k, F.lit(part))))


def is_paid_state(state: Column) -> Column:
    return F.lower(state).isin(*PAID_STATES)
