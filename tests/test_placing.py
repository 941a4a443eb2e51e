import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import placing, recognition

SCHEMA = "g string, at bigint, id int, v int"


def rows_of(seed, n=400):
    """A hot group that spans many ranges, small ones, and a null one."""
    r = random.Random(seed)
    return [(r.choice(["hot"] * 6 + ["a", "b", None]), r.randrange(1000), i, r.randrange(-3, 9)) for i in range(n)]


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1], x[2]))


@pytest.fixture
def many(spark):
    """Ranges stay as many as the session's partitions, small as they are."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n", [0, 1, 400])
def test_ranges_carry_over(spark, many, n):
    rows = in_order(rows_of(3, n))
    made = placing.ranged(spark.createDataFrame(rows[::-1], SCHEMA), ["g", "at", "id"])
    assert n < 400 or made.where("g = 'hot'").select("part").distinct().count() > 5
    got = {r.id: r for r in placing.running(placing.previous(made, "g", {"was": "at", "v_was": "v"}), "g", "v", "total").collect()}
    assert len(got) == n
    total, last = {}, {}
    for g, at, i, v in rows:
        total[g] = total.get(g, 0) + v
        assert (got[i].was, got[i].v_was, got[i].total) == (*last.get(g, (None, None)), total[g])
        last[g] = at, v


def test_numbered(spark, many):
    rows = in_order(rows_of(5))
    got = placing.numbered(spark.createDataFrame(rows[::-1], SCHEMA), ["g", "at", "id"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 401)) and [r.id for r in got] == [x[2] for x in rows]


def test_ranked(spark, many):
    rows = rows_of(6)
    got = {r.id: r.pos for r in placing.ranked(spark.createDataFrame(rows, SCHEMA), "g", [F.desc("v"), "id"]).collect()}
    for g in ("hot", "a", "b", None):
        assert [got[x[2]] for x in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[3], x[2]))] == list(range(1, 1 + sum(x[0] == g for x in rows)))


def test_islands_and_gaps(spark, many):
    rows = in_order(rows_of(7))
    df = spark.createDataFrame(rows[::-1], SCHEMA)
    got = {r.id: (r.opens, r.island) for r in recognition.islands(df, "g", "at", 12, ["id"]).collect()}
    island, last, widest = {}, {}, {}
    for g, at, i, _ in rows:
        opens = int(g in last and at - last[g] >= 12)
        island[g] = island.get(g, 0) + opens
        assert got[i] == (opens, island[g])
        if g in last and at > last[g]:
            widest[g] = max(widest.get(g, (0, 0)), (at - last[g], -last[g]))
        last[g] = at
    gaps = recognition.widest_gaps(df.withColumn("end", df["at"]), "g", "at", "end", ["id"]).collect()
    assert {r.g: (r.gap, r.after) for r in gaps} == {g: (a, -b) for g, (a, b) in widest.items()}
