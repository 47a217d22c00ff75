from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from quillroster.functions import money as M
from quillroster.functions import text as X
from quillroster.functions import timeops as D


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_names(spark):
    rows = [(" \tИван  ПЁТР\n",), ("",), (None,), ("One",)]
    got = values(spark, rows, "x string", X.normalize_name(F.col("x")), X.normalize_name_sql(F.col("x")), X.surname(F.col("x")), X.given_name(F.col("x")))
    assert [g[0] for g in got] == ["иван петр", "", "", "one"]
    assert [g[1] for g in got][2] is None
    assert got[3][2:] == ("One", None)
    limits = values(spark, [("a" * n,) for n in (1, 8, 9, 14, 15, 22, 23)], "x string", X.name_distance_limit(F.col("x")))
    assert [x[0] for x in limits] == [2, 2, 3, 3, 4, 4, 5]


def test_first_letter_and_score(spark):
    got = values(spark, [("anna", "nna"), ("anna", "hanna"), ("anna", "inna"), ("anna", "olga")], "a string, b string", X.first_letter_off(F.col("a"), F.col("b")), X.distance(F.col("a"), F.col("b")))
    assert got == [(True, 1), (True, 1), (True, 1), (False, 3)]
    assert values(spark, [(2, 1, None)], "a int, b int, c int", X.match_score(F.col("a"), F.col("b"), F.col("c"))) == [(20 + 3 + 2997,)]


def test_prices(spark):
    rows = [("6000 R",), ("6 000 R",), ("6 000",), ("",), ("free",), ("12345678901",), (None,)]
    assert [x[0] for x in values(spark, rows, "x string", X.parse_price(F.col("x")))] == [6000, 6000, 6, 0, 0, 0, 0]


def test_small_texts(spark):
    assert [x[0] for x in values(spark, [("TEAM",), ("foo",), (None,)], "x string", X.tournament_type(F.col("x")))] == ["team", "personal", "personal"]
    assert [len(x[0]) for x in values(spark, [("a" * 30,), ("a" * 31,)], "x string", X.ellipsis(F.col("x")))] == [30, 30]
    assert [x[0] for x in values(spark, [("3/16 people",), ("none",)], "x string", X.bump_counter(F.col("x")))] == ["4/16 people", "none"]
    got = values(spark, [(["a", "", None, " b"], "b")], "x array<string>, n string", X.filled_only(F.col("x")), F.size(X.appended(F.col("x"), F.col("n"))))
    assert got == [(["a", " b"], 4)]
    assert values(spark, [('[{"id":1}]',), ("bad",), (None,)], "x string", F.size(X.lenient_json(F.col("x"), "array<struct<id:int>>"))) == [(1,), (0,), (0,)]
    assert values(spark, [({"b10": 1, "a10": 2},)], "x map<string,int>", X.first_key_like(F.col("x"), "10")) == [("a10",)]


def test_source_times(spark):
    texts = ["2026-01-10T19:00:00+03:00", "2026-01-10T16:00:00Z", "2026-01-10 19:00", "2026-01-10T19:00:00.5", "2026", "junk", None]
    got = [x[0] for x in values(spark, [(t,) for t in texts], "x string", D.parse_source_time(F.col("x")).cast("string"))]
    assert got == ["2026-01-10 16:00:00"] * 3 + ["2026-01-10 16:00:00.5", None, None, None]
    short = ["2026-01-10T19:00+03:00", "2026-01-10 19:00+0300", "2026-01-10T16:00Z", "2026-01-10T19:00:00.000+03:00", "2026-01-10", "2026-01-10T25:00"]
    got = [x[0] for x in values(spark, [(t,) for t in short], "x string", D.parse_source_time(F.col("x")).cast("string"))]
    assert got == ["2026-01-10 16:00:00"] * 4 + ["2026-01-09 21:00:00", None]


def test_shown_times(spark):
    got = values(spark, [(datetime(2013, 7, 1, 20, 30),), (None,)], "t timestamp", D.shown_text(F.col("t"), "-"), D.shown_date(F.col("t")).cast("string"))
    assert got == [("02.07.2013 00:30", "2013-07-02"), ("-", None)]
    assert values(spark, [("2026-01-02",), ("x",)], "x string", D.date_labels(F.col("x"))["shown"], D.date_labels(F.col("x"))["iso"]) == [("02.01.2026", "2026-01-02"), ("x", "x")]
    naive = ["2026-01-10 19:00", "2026-01-10T19:00:00+03:00", "2026-01-10T19:00:00.25Z", "10.01.2026 19:00", "x"]
    assert [x[0] for x in values(spark, [(t,) for t in naive], "x string", D.parse_naive_time(F.col("x")).cast("string"))] == ["2026-01-10 19:00:00", "2026-01-10 19:00:00", "2026-01-10 19:00:00.25", None, None]


def test_money(spark):
    rows = [(6001, "team", False, False), (6001, "team", True, False), (6001, "team", True, True), (6001, "personal", False, False)]
    got = values(spark, rows, "p int, k string, f boolean, m boolean", M.charge(F.col("p"), F.col("k"), F.col("f"), F.col("m")), M.amount_text(F.col("p")))
    assert [g[0] for g in got] == [Decimal("3000.50"), Decimal("3000.50"), Decimal("6001.00"), Decimal("6001.00")]
    assert got[0][1] == "6001.00"
    assert values(spark, [("12.345",), ("x",), (None,)], "x string", M.lenient_amount(F.col("x"))) == [(Decimal("12.35"),), (None,), (None,)]
    assert values(spark, [(Decimal("10.10"),)], "x decimal(10,2)", M.to_minor(F.col("x")), M.from_minor(M.to_minor(F.col("x")))) == [(1010, Decimal("10.10"))]
