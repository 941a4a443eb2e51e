from pyspark.sql import functions as F

from marketlens.operators import recognition as rc


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_margins_and_guards(spark):
    lit = F.lit
    assert one(spark, rc.required_margin(lit("HS"), lit("HC"))) == 0.10 and one(spark, rc.required_margin(lit("NEW"), lit("HC"))) == 0.05
    guard = lambda t, s, sc, m, h, u, lo: one(spark, rc.digit_ambiguity(*[lit(v) for v in (t, s, sc, m, h, u, lo)]))
    assert guard(1, 2, 0.3, 0.5, 0, 0.5, 0.5) == "score" and guard(1, 2, 0.9, 0.01, 0, 0.5, 0.5) == "margin"
    assert guard(3, 5, 0.9, 0.04, 0, 0.5, 0.5) == "confusable" and guard(3, 8, 0.9, 0.03, 0, 0.5, 0.5) is None
    assert guard(8, 9, 0.9, 0.1, 2, 0.8, 0.4) == "confusable" and guard(8, 9, 0.9, 0.1, 2, 0.5, 0.5) is None
    assert guard(9, 8, 0.9, 0.1, 1, 0.5, 0.5) == "confusable"


def test_small_functions(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, rc.colour_distance(a(0, 0, 0), a(3, 4, 0))) == 5.0
    assert one(spark, rc.colour_hex(a(255, 0, 16))) == "#ff0010"
    assert one(spark, rc.aspect_agreement(F.lit(2.0), F.lit(1.0))) == 0.0 and one(spark, rc.aspect_agreement(F.lit(3.0), F.lit(3.0))) == 1.0
    assert one(spark, rc.word_score(F.lit(0.8), F.lit(0.4))) == 0.75 * 0.8 + 0.25 * 0.4
    assert float(one(spark, rc.to_decimal(F.lit("997871"), F.lit(2)))) == 9978.71 and one(spark, rc.to_decimal(F.lit("12"), F.lit(2))) is None
    assert one(spark, rc.confidence([F.lit("header"), F.lit(None).cast("string")], F.lit(0))) == 0.2
    assert abs(one(spark, rc.confidence([F.lit("header"), F.lit("fill-pattern")], F.lit(1))) - 0.55) < 1e-9


def test_header_tokens_columns(spark):
    rows = [("g", 0, "x", "text")] * 5 + [("g", 1, r, r) for r in ("status", "list", "sold", "mls")] + [("g", 2, r, r) for r in ("status", "list", "sold", "mls")] + [("h", 7, r, r) for r in ("status", "list", "sold", "mls")]
    assert [tuple(r) for r in rc.header_row(spark.createDataFrame(rows, "grid string, row int, label string, role string")).collect()] == [("g", 1)]
    glyphs = spark.createDataFrame([("a", 2, 5, None), ("a", 1, 4, None), ("b", 1, 3, "margin"), ("b", 2, 3, None)], "token string, place int, digit int, reason string")
    assert {r.token: r.digits for r in rc.read_tokens(glyphs, ["token"]).collect()} == {"a": "45", "b": None}
    cells = spark.createDataFrame([("m", 8, True)] * 3 + [("m", 7, False)] + [("o", 3, True)] * 4, "col string, n_glyphs int, clean boolean")
    assert [(r.col, r.clean) for r in rc.mls_column(cells).collect()] == [("m", 0.75)]


def test_kickout(spark):
    votes = [("c", 1, "H", 0.9), ("c", 1, "P", 0.7), ("c", 2, "S", 0.9), ("c", 2, "C", 0.6), ("d", 1, "H", 0.9), ("d", 1, "P", 0.85), ("d", 2, "S", 0.9), ("d", 2, "C", 0.6), ("e", 1, "B", 0.9), ("e", 2, "S", 0.9)]
    got = rc.kickout_read(spark.createDataFrame(votes, "cluster string, place int, letter string, mean double"), ["HS", "HC", "PS", "PC"]).collect()
    assert [(r.cluster, r.code) for r in got] == [("c", "HS")]


def test_empty_vectors_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 1.0], 0), (2, [1.0, 2.0], 1), (3, [2.0, 1.0], 2)], "vec_id bigint, embedding array<float>, label int")
    r = {x.vec_id: (x.top, x.score) for x in rc.rank(v, rc.template_bank(v)).collect()}
    assert r == {1: (0, 0.0), 2: (1, 1.0), 3: (2, 1.0)}
