"""Names to people: alias, then exact name, then bounded edit distance.

The fuzzy join is lossless and never compares all with all. Two strings within distance k share, at
a place shifted by k at most, one of the k + 1 segments that the longer list's string is cut into:
so hashes of segments are the join key, and the distance is computed for what meets on one. Where only
the nearest people count, they are looked for nearest first, short strings by what is left of them without
one or two letters: names that begin alike share a segment with all others, but what is left with few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillroster.functions import text as X
from quillroster.operators.ranking import ranked
from quillroster.sources.staging import spread, staged

#: The pool of nearest people, how many are shown, and the least distance that still suggests someone.
POOL, SHOWN, LEAST_DISTANCE = 30, 5, 3
LIMITS = (*sorted({k for _, k in X.NAME_DISTANCE} | {X.NAME_DISTANCE_BEYOND}),)
#: Others of a group whose pairs with the whole group are made together.
TILE = 1024
#: The distance up to which strings are met without some of their letters, and how long a person's may be for that.
CLOSE, CLOSE_LETTERS = 2, 24


def _segments(size: Column, k: Column) -> Column:
    """Bounds (index, start from 0, length) of k + 1 near-equal segments of a string of that size."""
    cut = lambda i: F.floor(size * i / (k + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("i"), cut(i).alias("start"), (cut(i + 1) - cut(i)).alias("size")))


def _starts(size: Column, segment: Column, k: Column, probe_size: Column) -> Column:
    """Where in a probe a segment of a string of that size has to be looked for: from the left i places off at most, from the right k - i.

    If a segment matches further off, more edits lie on that side of it than there are segments, so
    that another segment matches on the other side. None where the range is empty.
    """
    i, start, off = segment["i"], segment["start"], probe_size - size
    low = F.greatest(F.lit(0), start - i, start + off - (k - i))
    high = F.least(probe_size - segment["size"], start + i, start + off + (k - i))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _met(wanted: DataFrame, known: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """wanted (_probe, _pk of limits), known (_person) -> _probe, _pk, _person that meet on a segment, perhaps several times."""
    part = lambda text, at, segment: F.substring(text, at + 1, segment["size"])
    key = lambda k, size, segment, text: F.xxhash64(k, size, segment["i"], text)

    right = spread(known).withColumn("_k", F.explode(F.array(*map(F.lit, limits)))).withColumn("_size", F.length("_person")).withColumn("_s", F.explode(_segments(F.col("_size"), F.col("_k"))))
    right = right.select(key(F.col("_k"), F.col("_size"), F.col("_s"), part(F.col("_person"), F.col("_s.start"), F.col("_s"))).alias("_key"), "_person")
    left = spread(wanted).withColumn("_size", F.explode(F.sequence(F.greatest(F.lit(1), F.length("_probe") - F.col("_pk")), F.length("_probe") + F.col("_pk")))).withColumn("_s", F.explode(_segments(F.col("_size"), F.col("_pk"))))
    looked = F.array_distinct(F.transform(_starts(F.col("_size"), F.col("_s"), F.col("_pk"), F.length("_probe")), lambda at: part(F.col("_probe"), at, F.col("_s"))))
    left = left.select("_pk", "_size", "_s", "_probe", F.explode(looked).alias("_part")).select(key(F.col("_pk"), F.col("_size"), F.col("_s"), F.col("_part")).alias("_key"), "_probe", "_pk")
    return left.join(right, "_key").select("_probe", "_pk", "_person")


def _near(met: DataFrame) -> DataFrame:
    """The pairs of met that differ by _pk at most, with dist."""
    dist = F.when(F.col("_pk") == LIMITS[-1], F.levenshtein("_probe", "_person", LIMITS[-1]))
    for k in LIMITS[:-1]:
        dist = F.when(F.col("_pk") == k, F.levenshtein("_probe", "_person", k)).otherwise(dist)
    return met.select("_probe", "_pk", "_person", dist.alias("dist")).where("dist BETWEEN 0 AND _pk").distinct()


def _left_over(strings: DataFrame, text: str) -> DataFrame:
    """strings with _key, a hash of what is left of the text without up to two letters: a row for each that there is."""
    size = F.length(text)
    cut = lambda start, length: F.substr(F.col(text), start, length)
    rest = lambda i, j: F.xxhash64(F.concat(cut(F.lit(1), i - 1), cut(i + 1, j - i - 1), cut(j + 1, size)))
    # Place 0 stands for no letter: (0, 0), (0, j) and i < j.
    second = lambda i: F.when(i == 0, F.sequence(F.lit(0), size)).when(i < size, F.sequence(i + 1, size)).otherwise(F.array().cast("array<int>"))
    rests = F.flatten(F.transform(F.sequence(F.lit(0), size), lambda i: F.transform(second(i), lambda j: rest(i, j))))
    return spread(strings).withColumn("_key", F.explode(F.array_distinct(rests)))


def _close(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """As _met for the limit CLOSE. Two strings within it have a common rest, each without that many letters at most."""
    a = _left_over(wanted.where(F.length("_probe") <= CLOSE_LETTERS + CLOSE), "_probe")
    b = _left_over(known.where(F.length("_person") <= CLOSE_LETTERS), "_person")
    long = known.where(F.length("_person") > CLOSE_LETTERS)
    return a.join(b, "_key").select("_probe", "_pk", "_person").unionByName(_met(wanted.where(F.length("_probe") > CLOSE_LETTERS - CLOSE), long, (CLOSE,)))


def within_distance(probes: DataFrame, people: DataFrame, probe: str, person: str, limit: Column) -> DataFrame:
    """Pairs of probe and person rows whose strings differ by at most limit (of the probe, one of LIMITS), with dist.

    Columns of the two sides must have different names. Empty strings match nothing. The distinct
    strings alone are dealt by their segments' hashes, and those that meet are judged where they meet, so that
    only pairs that are near enough go on; rows are joined to these.
    """
    asked = probes.where(F.length(probe) > 0).withColumn("_pk", limit)
    wanted = asked.select(F.col(probe).alias("_probe"), "_pk").distinct()
    known = people.select(F.col(person).alias("_person")).where(F.length("_person") > 0).distinct()
    near = _near(_met(wanted, known, LIMITS))
    rows = asked.join(near.withColumnRenamed("_pk", "_limit"), (F.col(probe) == F.col("_probe")) & (F.col("_pk") == F.col("_limit")))
    return rows.join(people, F.col("_person") == F.col(person)).select(*probes.columns, *people.columns, "dist")


def nearest(probes: DataFrame, people: DataFrame) -> DataFrame:
    """probes (name, norm), people (player_id, full_name, _norm) -> of the pairs within the names' limits, with dist, those that best_candidates can choose, and perhaps more.

    They are looked for by rounds, with a limit of two, three and four. A name is settled where its pool is full, or where
    someone (of another name) is nearer than the limit: no candidate may be further off than one more. Beyond four there are none, as the
    nearest has to be within three. Of the people of one normalised name a pool can hold the first POOL.
    """
    first = Window.partitionBy("_norm").orderBy("player_id")
    people = staged(people.where("_norm <> ''").withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= POOL).drop("_rank"), "people")
    known = people.select(F.col("_norm").alias("_person")).distinct()
    open_ = staged(probes.where("norm <> ''").select("name", "norm").distinct(), "asked")
    out = None
    for k in range(CLOSE, LEAST_DISTANCE + 2):
        wanted = open_.select(F.col("norm").alias("_probe"), F.lit(k).alias("_pk")).distinct()
        near = _near(_close(wanted, known) if k == CLOSE else _met(wanted, known, (k,)))
        rows = open_.join(near, F.col("norm") == F.col("_probe")).join(people, F.col("_person") == F.col("_norm"))
        found = staged(rows.select("name", "norm", *people.columns, "dist"), "found")
        of_name = found.groupBy("name", "norm").agg(F.count("*").alias("_n"), F.min(F.when(F.col("full_name") != F.col("name"), F.col("dist"))).alias("_least"))
        settled = (F.col("_n") >= POOL) | (F.col("_least") < k) | (X.name_distance_limit(F.col("norm")) <= k) | F.lit(k > LEAST_DISTANCE)
        left = staged(open_.join(of_name, ["name", "norm"], "left").where(~F.coalesce(settled, F.lit(False))).select("name", "norm"), "open")
        kept = found.join(left, ["name", "norm"], "left_anti")
        out = kept if out is None else out.unionByName(kept)
        if left.isEmpty():
            break
        open_ = left
    return out


def fuzzy_candidates(probes: DataFrame, people: DataFrame, shown: int = SHOWN) -> DataFrame:
    """probes (name, norm), people (id, full_name, normalized_name) -> candidates, the best first: name, norm, player_id, full_name, dist, score, surname_dist, name_dist, place.

    Of the POOL nearest people within the name's limit, those within one of the nearest are kept if
    the nearest is within LEAST_DISTANCE, and the `shown` best of them by score. Ties go to the
    smaller id. A person of the very name isn't a candidate.
    """
    known = people.select(F.col("id").alias("player_id"), "full_name", F.col("normalized_name").alias("_norm"))
    return best_candidates(nearest(probes, known), shown)


def best_candidates(pairs: DataFrame, shown: int = SHOWN, more: tuple[str, ...] = ()) -> DataFrame:
    """pairs as within_distance gives them (name, norm, player_id, full_name, _norm, dist) -> candidates as in fuzzy_candidates, for each name, norm and value of `more`."""
    key = ["name", "norm", *more]
    near = Window.partitionBy(*key).orderBy("dist", "player_id")
    pool = pairs.withColumn("_rank", F.row_number().over(near)).where(F.col("_rank") <= POOL).where(F.col("full_name") != F.col("name"))
    least = F.min("dist").over(Window.partitionBy(*key))
    pool = pool.withColumn("_least", least).where((F.col("_least") <= LEAST_DISTANCE) & (F.col("dist") <= F.least(F.col("_least") + 1, X.name_distance_limit(F.col("norm")))))
    part = lambda f: X.distance(f(F.col("norm")), f(F.col("_norm")))
    scored = pool.withColumn("surname_dist", part(X.surname)).withColumn("name_dist", part(X.given_name))
    scored = scored.withColumn("score", X.match_score(F.col("dist"), F.col("surname_dist"), F.col("name_dist")))
    best = Window.partitionBy(*key).orderBy("score", "player_id")
    scored = scored.withColumn("_best", F.row_number().over(best)).where(F.col("_best") <= shown)
    place = Window.partitionBy(*key).orderBy("dist", "score", "player_id")
    return scored.withColumn("place", F.row_number().over(place)).select(*key, "player_id", "full_name", "dist", "score", "surname_dist", "name_dist", "place")


def resolve_names(names: DataFrame, aliases: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct names (name) -> name, norm, outcome (alias, exact, ambiguous or new), player_id, candidates.

    All names are resolved against the people at the start: one that is new twice is one new person,
    and a person made for one name is no candidate for another of the same run; see resolve_in_order.
    """
    asked = names.where(F.length("name") > 0).select("name").distinct().withColumn("norm", X.normalize_name(F.col("name")))
    found = _known(asked, aliases, people)
    rest = found.where("_alias_id IS NULL AND _exact_id IS NULL").select("name", "norm")
    fuzzy = _as_list(fuzzy_candidates(rest, people), "name")
    out = found.join(fuzzy, "name", "left")
    outcome = F.when(F.col("_alias_id").isNotNull(), "alias").when(F.col("_exact_id").isNotNull(), "exact").when(F.col("candidates").isNotNull(), "ambiguous").otherwise("new")
    return out.select("name", "norm", outcome.alias("outcome"), F.coalesce("_alias_id", "_exact_id").alias("player_id"), "candidates")


def _known(asked: DataFrame, aliases: DataFrame, people: DataFrame) -> DataFrame:
    """asked (name, norm, ...) with _alias_id and _exact_id."""
    by_alias = aliases.groupBy(F.col("normalized_alias").alias("norm")).agg(F.min("player_id").alias("_alias_id"))
    by_name = people.groupBy(F.col("full_name").alias("name")).agg(F.min("id").alias("_exact_id"))
    return asked.join(by_alias, "norm", "left").join(by_name, "name", "left")


def _as_list(fuzzy: DataFrame, *key: str) -> DataFrame:
    """Candidates in their order, as one array for each key."""
    as_candidate = lambda c: F.struct(c["player_id"].alias("player_id"), c["full_name"].alias("name"), c["dist"].alias("dist"), c["score"].alias("score"), c["surname_dist"].alias("surname_dist"), c["name_dist"].alias("name_dist"))
    listed = fuzzy.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "player_id", "full_name", "dist", "score", "surname_dist", "name_dist"))).alias("_c"))
    return listed.select(*key, F.transform("_c", as_candidate).alias("candidates"))


def fallen(edges: DataFrame) -> DataFrame:
    """edges (name, before): an earlier name that `name` is too near to -> (name) those that are too near to an earlier one that stands.

    Judged one by one in their order, a name stands if none that stands is before it. All names whose
    earlier neighbours are settled are settled at once: who has none left stands, and those after one that
    stands fall. Each round settles all such names of the whole table, so that there are as many rounds
    as the longest chain of neighbours, each of which hangs on the one before it, is long.
    """
    edges, out = staged(edges.select("name", "before"), "edges"), edges.select("name").limit(0)
    while not edges.isEmpty():
        standing = edges.select(F.col("before")).distinct().join(edges.select(F.col("name").alias("before")).distinct(), "before", "left_anti")
        down = staged(edges.join(standing, "before", "left_semi").select("name").distinct(), "fallen")
        out = out.unionByName(down)
        edges = staged(edges.join(down, "name", "left_anti").join(down.select(F.col("name").alias("before")), "before", "left_anti").select("name", "before"), "edges")
    return out


def resolve_in_order(listed: DataFrame, aliases: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names as an import meets them, one by one: listed (name, seq, ...) -> listed with norm, outcome, player_id, candidates; and the new people (id, full_name, normalized_name).

    seq, of any orderable type, tells a name's place; two names have never the same. Each name is looked up among the
    people and those made of names before it: the first of two near spellings becomes a person, the
    second is doubtful and has that person among its candidates, as far as it was made before. A
    new person's name is exact from its second occurrence on. Ids of new people follow the order in which they are made.
    Empty and null names are left out.
    """
    asked = listed.where(F.length("name") > 0).withColumn("norm", X.normalize_name(F.col("name")))
    found = staged(_known(asked.groupBy("name", "norm").agg(F.min("seq").alias("_first")), aliases, people), "known")
    rest = found.where("_alias_id IS NULL AND _exact_id IS NULL").select("name", "norm", "_first")
    limit = X.name_distance_limit(F.col("norm"))
    named = people.select(F.col("id").alias("player_id"), "full_name", F.col("normalized_name").alias("_norm"))
    pairs = staged(nearest(rest, named).where("full_name <> name"), "pairs")
    open_ = staged(rest.join(pairs.where(F.col("dist") <= LEAST_DISTANCE).select("name").distinct(), "name", "left_anti"), "open")

    # Of the spellings that share a normalised name the first stands for all: if it falls, so do they, by the same neighbour.
    nodes = staged(open_.where("norm <> ''").groupBy("norm").agg(F.min(F.struct("_first", "name")).alias("_node")).select("norm", "_node.*"), "nodes")
    met = within_distance(nodes.select("norm", "_first"), nodes.select(F.col("norm").alias("before"), F.col("_first").alias("_before_first")), "norm", "before", F.least(limit, F.lit(LEAST_DISTANCE)))
    down = fallen(met.where("_before_first < _first").select(F.col("norm").alias("name"), "before"))
    standing = nodes.join(down.withColumnRenamed("name", "norm"), "norm", "left_anti").select("name", "norm", "_first")
    standing = standing.unionByName(open_.where("norm = ''").select("name", "norm", "_first"))
    most = people.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one row
    made = staged(ranked(standing, None, [F.col("_first"), F.col("name")], "standing").select("name", "norm", "_first", (F.lit(most) + 1 + F.col("_pos")).cast("long").alias("_made")), "made")

    doubtful = staged(rest.join(made.select("name"), "name", "left_anti").select("name", "norm"), "doubtful")
    born = made.select(F.col("_made").alias("player_id"), F.col("name").alias("full_name"), F.col("norm").alias("_norm"), F.col("_first").alias("_born"))
    later = staged(within_distance(doubtful, born, "norm", "_norm", limit), "later")
    # What a doubtful name's candidates are changes only where one more of its neighbours has been made: ids follow that order.
    asked_again = asked.join(doubtful.select("name"), "name", "left_semi").select("name", "norm", "seq").distinct()
    epochs = asked_again.join(later.select("name", "_born", "player_id"), "name", "left").where("_born IS NULL OR _born < seq").groupBy("name", "seq").agg(F.max("player_id").alias("_epoch"))
    epochs = staged(asked_again.join(epochs, ["name", "seq"], "left").select("name", "norm", "seq", F.coalesce("_epoch", F.lit(0)).cast("long").alias("_epoch")), "epochs")
    each = epochs.select("name", "_epoch").distinct()
    near = pairs.join(each, "name").unionByName(later.drop("_born").join(each, "name").where("player_id <= _epoch"))
    candidates = epochs.join(_as_list(best_candidates(near, more=("_epoch",)), "name", "_epoch"), ["name", "_epoch"]).select("name", "seq", "candidates")

    known = found.select("name", "_alias_id", "_exact_id").join(made.select("name", "_made", "_first"), "name", "left")
    rows = asked.join(known, "name").join(candidates, ["name", "seq"], "left")
    outcome = F.when(F.col("_alias_id").isNotNull(), "alias").when(F.col("_exact_id").isNotNull(), "exact").when(F.col("_made").isNull(), "ambiguous").when(F.col("seq") == F.col("_first"), "new").otherwise("exact")
    out = rows.select(*listed.columns, "norm", outcome.alias("outcome"), F.coalesce("_alias_id", "_exact_id", "_made").alias("player_id"), "candidates")
    return out, made.select(F.col("_made").alias("id"), F.col("name").alias("full_name"), F.col("norm").alias("normalized_name"))


def identity_conflicts(people: DataFrame, external: str = "telegram_id") -> DataFrame:
    """(id, other_id) of people who share an external id: all pairs, as many as the square of a group; see conflict_groups for a row each.

    A large group is cut into tiles of about TILE others, each of which meets the whole group in a join key of its own, so that one group's pairs are made in many tasks.
    """
    a = staged(people.where(F.col(external).isNotNull()).select("id", external), "sharing")
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.lit(1)).cast("int")
    a = staged(a.join(a.groupBy(external).agg(tiles.alias("_tiles")), external), "tiled")
    one = spread(a.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).select("id", external, "_tile"), external, "_tile")
    others = spread(a.select(F.col("id").alias("other_id"), external, F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int").alias("_tile")), external, "_tile")
    return one.join(others, [external, "_tile"]).where("id <> other_id").select("id", "other_id")


def conflict_groups(people: DataFrame, external: str = "telegram_id") -> DataFrame:
    """One row for each external id that several people share: the id, how many share it, and the smallest of them."""
    return people.where(F.col(external).isNotNull()).groupBy(external).agg(F.count_distinct("id").alias("people"), F.min("id").alias("first_id")).where("people > 1")
