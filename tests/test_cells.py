from pyspark.sql import functions as F

from marketlens.functions import cells


def cell(spark, f, text):
    r = spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("c")).first().c
    return (r.state, None if r.value is None else float(r.value))


def test_money(spark):
    cases = {
        "$647,839": ("value", 647839.0), "310000": ("value", 310000.0), "9978.71": ("value", 9979.0), " $ 12,000 ": ("value", 12000.0), "1,23,456": ("error", None), "$42O,000": ("error", None),
        "-5000": ("error", None), "1-2": ("error", None), "$0": ("blank", None), "$0.40": ("blank", None), "": ("blank", None), None: ("blank", None), " ": ("blank", None), "$500": ("error", None),
        "30000000": ("value", 3e7), "30000001": ("error", None), "9" * 40: ("error", None), "12.345": ("error", None), "1000\n": ("value", 1000.0),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, x string").select("i", cells.money(F.col("x")).alias("c")).collect()
    got = {list(cases)[r.i]: (r.c.state, None if r.c.value is None else float(r.c.value)) for r in rows}
    assert got == cases


def test_concession_keeps_cents(spark):
    f = lambda c: cells.money(c, True)
    assert cell(spark, f, "9978.71") == ("value", 9978.71)
    assert cell(spark, f, "0") == ("value", 0.0)
    assert cell(spark, f, "30,000,001") == ("error", None)


def test_days(spark):
    for text, want in {"0": ("value", 0.0), "1,200": ("value", 1200.0), "12.5": ("error", None), "9999": ("error", None), "": ("blank", None), "00044": ("value", 44.0), "3650": ("value", 3650.0)}.items():
        assert cell(spark, cells.days, text) == want, text


def test_typed_input(spark):
    assert cell(spark, cells.typed_money, "$425,000.00") == ("value", 425000.0)
    assert cell(spark, cells.typed_money, "4 25 000") == ("value", 425000.0)
    assert cell(spark, cells.typed_money, "999") == ("error", None)
    assert cell(spark, lambda c: cells.typed_money(c, True), "12.346") == ("value", 12.35)
    assert cell(spark, cells.typed_days, "1 2") == ("value", 12.0)
    assert cell(spark, cells.typed_days, "x") == ("error", None)


def test_status(spark):
    cases = {"ACTV": ("ACTV", "active"), " hs48 ": ("HS", "pending"), "PRIV-HS48": ("PRIV", "active"), "PRIV-PEND": ("PEND", "pending"), "ZZZ": (None, "unclassified"), "s": ("S", "closed"), None: (None, "unclassified"), "a/i": ("A/I", "pending")}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, x string").select("i", cells.status_code(F.col("x")).alias("c"), cells.bucket(F.col("x")).alias("b")).collect()
    assert {list(cases)[r.i]: (r.c, r.b) for r in rows} == cases


def test_override_and_unknown_bucket(spark):
    df = spark.createDataFrame([("EXP",), ("NEW",)], "x string").select(cells.bucket(F.col("x"), {"EXP": "closed", "NEW": "nowhere"}).alias("b"))
    assert [r.b for r in df.collect()] == ["closed", "unclassified"]


def test_ratio(spark):
    rows = [(200000, 5000.0, 250000), (200000, None, 250000), (200000, -1.0, 250000), (200000, 200000.0, 250000), (None, 0.0, 1), (1000, 0.0, None)]
    df = spark.createDataFrame(rows, "s bigint, c double, o bigint").select(cells.net_ratio(F.col("s"), F.col("c").cast("decimal(12,2)"), F.col("o")).alias("r"))
    assert [r.r for r in df.collect()] == [0.78, 0.8, 0.8, None, None, None]


def test_formats(spark):
    r = spark.range(1).select(
        cells.dollars(F.lit(1234567)).alias("a"), cells.dollars(F.lit(None).cast("bigint")).alias("b"), cells.percent(F.lit(0.988595)).alias("c"), cells.day_count(F.lit(0)).alias("d"), cells.amount_text(F.lit(9978.71)).alias("e"),
        cells.line_list(F.array(*[F.lit(i) for i in (4, 9, 12)])).alias("f"), cells.line_list(F.sequence(F.lit(1), F.lit(10))).alias("g"), cells.line_list(F.array(F.lit(7))).alias("h"),
    ).first()
    assert tuple(r) == ("$1,234,567", "—", "98.859%", "0", "9,978.71", "lines 4, 9 and 12", "lines 1, 2, 3, 4, 5, 6, 7, 8 and 2 more", "line 7")
