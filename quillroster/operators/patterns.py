"""Search for people by patterns with wildcards, over an inverted index of the names' pieces.

Whatever a pattern matches has the pattern's literal runs in it. So a pattern is joined on one piece of
them, the rarest among the names that any of its runs has, and held against the names that it meets there.
Marks before and behind each name make pieces of beginnings and ends, too, so that `bo` and `b_%` have
their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillroster.sources.staging import spread, staged

#: Letters of a piece, and of the shorter ones for runs that aren't as long.
SIZES = (4, 3, 2, 1)
BEGIN, END, WILD = "\x01", "\x02", "\x03"


def _pieces(text: Column, size: int) -> Column:
    """The distinct pieces of that size, none where text is shorter; a mark alone is none."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))
    return F.array_except(F.when(F.length(text) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>")), F.array(F.lit(BEGIN), F.lit(END)))


def _runs(pattern: Column) -> Column:
    """The literal runs of a pattern in lower case, escapes undone, the first and last with the marks."""
    tokens = F.regexp_extract_all(F.lower(pattern), F.lit(r"(?s)(\\.|.)"), F.lit(1))
    plain = F.transform(tokens, lambda t: F.when(t.isin("%", "_"), F.lit(WILD)).otherwise(F.regexp_replace(t, r"(?s)^\\(.)$", "$1")))
    return F.split(F.concat(F.lit(BEGIN), F.array_join(plain, ""), F.lit(END)), f"{WILD}+")


def name_index(people: DataFrame, *columns: str) -> DataFrame:
    """people (id, columns) -> _name, _id, _last, _piece: a row for each distinct piece of each distinct name, of all SIZES, with the smallest and largest id that have it."""
    names = people.select(F.col("id").alias("_id"), F.explode(F.array_distinct(F.array(*columns))).alias("_name")).where("_name IS NOT NULL")
    names = spread(names, "_name").groupBy("_name").agg(F.min("_id").alias("_id"), F.max("_id").alias("_last"))
    marked = F.concat(F.lit(BEGIN), F.lower("_name"), F.lit(END))
    return names.select("_name", "_id", "_last", F.explode(F.array_distinct(F.flatten(F.array(*[_pieces(marked, n) for n in SIZES])))).alias("_piece"))


def _wild_only(probes: DataFrame, people: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Patterns of nothing but wildcards match by length: (probe, player_id, _last), the smallest and largest id, from those of people by length."""
    asked = probes.select("probe", F.length(F.replace("probe", F.lit("%"), F.lit(""))).alias("_size"), F.contains("probe", F.lit("%")).alias("_open"))
    lengths = people.select(F.col("id").alias("_id"), F.array_distinct(F.filter(F.array(*[F.length(c) for c in columns]), lambda n: n.isNotNull())).alias("_lengths")).where(F.size("_lengths") > 0)
    ends = [F.min("_id").alias("player_id"), F.max("_id").alias("_last")]
    exact = lengths.select("_id", F.explode("_lengths").alias("_size")).groupBy("_size").agg(*ends)
    longest = lengths.groupBy(F.array_max("_lengths").alias("_size")).agg(*ends)
    down = Window.orderBy(F.desc("_size"))  # a row for each length that there is
    least = longest.select(F.lag("_size", 1, -1).over(Window.orderBy("_size")).alias("_before"), "_size", F.min("player_id").over(down).alias("player_id"), F.max("_last").over(down).alias("_last"))
    least = least.select(F.explode(F.sequence(F.col("_before") + 1, F.col("_size"))).alias("_size"), "player_id", "_last")
    return asked.where("_open").join(least, "_size").unionByName(asked.where("NOT _open").join(exact, "_size")).select("probe", "player_id", "_last")


def unique_match(probes: DataFrame, people: DataFrame, columns: tuple[str, ...] = ("full_name", "lunda_name"), index: DataFrame | None = None) -> DataFrame:
    """probes (probe) -> probe, player_id where exactly one person's name, in any of the columns, is like it, letter case aside.

    % stands for any letters, _ for one, a backslash before either for itself. A run shorter than the
    longest pieces is a piece itself; a pattern without any letter matches by length. Exactly one matches where the smallest id that does is
    the largest, too, so that hits are folded where they are found. What patterns are joined on is staged first: where it is small, the index isn't shuffled.
    index: what name_index gives for the people and columns, where it is kept. Null probes match nothing.
    """
    asked = probes.where("probe IS NOT NULL").select("probe").distinct().withColumn("_runs", _runs(F.col("probe")))
    cut = lambda r: reduce(lambda less, n: F.when(F.length(r) >= n, _pieces(r, n)).otherwise(less), reversed(SIZES), F.array().cast("array<string>"))
    asked = staged(asked.select("probe", F.array_distinct(F.flatten(F.transform("_runs", cut))).alias("_pieces")), "patterns")
    index = name_index(people, *columns) if index is None else index
    wanted = staged(asked.select("probe", F.explode("_pieces").alias("_piece")), "wanted")
    often = index.join(wanted.select("_piece").distinct(), "_piece", "left_semi").groupBy("_piece").agg(F.count("*").alias("_often"))
    # A piece that no name has is the rarest: its pattern meets none.
    rarest = staged(wanted.join(often, "_piece", "left").groupBy("probe").agg(F.min_by("_piece", F.struct(F.coalesce("_often", F.lit(0)), "_piece")).alias("_piece")), "rarest")
    found = rarest.join(index, "_piece").where(F.expr("_name ILIKE probe")).groupBy("probe").agg(F.min("_id").alias("player_id"), F.max("_last").alias("_last"))
    wild = _wild_only(asked.where(F.size("_pieces") == 0), people, columns)
    return found.unionByName(wild).where("player_id = _last").select("probe", "player_id")
