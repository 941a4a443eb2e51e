"""Steps whose cost must not grow faster than their input: same results by other plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.functions import cells
from marketlens.operators import glyphs, grids, ranks, recognition
from marketlens.operators.rounds import settled
from marketlens.plans import catalogue, layers
from marketlens.sources import pages


@pytest.mark.parametrize("most", [grids.PAGE_PAIRS, 6, 0])
def test_binding_by_page_and_in_rounds_is_one_pass_in_order(spark, monkeypatch, most):
    monkeypatch.setattr(grids, "PAGE_PAIRS", most)
    written, settled = [], grids.settled
    monkeypatch.setattr(grids, "settled", lambda df: written.append(df) or settled(df))
    rng, pairs, want = random.Random(3), [], set()
    for g in range(40):
        for i in range(rng.randint(1, 6)):
            score, x0 = rng.choice([0.5, 0.9]), rng.randint(0, 2)
            pairs += [(g, f"l{i}", score, x0, c, float(rng.randint(0, 2))) for c in rng.sample(range(6), rng.randint(1, 4))]
        taken = set()
        for _, _, label in sorted({(-s, x, n) for gg, n, s, x, _, _ in pairs if gg == g}):
            free = sorted((d, c) for gg, n, _, _, c, d in pairs if (gg, n) == (g, label) and c not in taken)
            if free:
                taken.add(free[0][1])
                want.add((g, label, free[0][1]))
    df = spark.createDataFrame(pairs, "grid int, label string, score double, x0 int, col int, distance double")
    assert {tuple(r) for r in grids.bind_one_to_one(df).collect()} == want
    # Small pages are folded where they meet: only the list of large ones is written, not the pairs of every round.
    assert (len(written) == 1) == (most == grids.PAGE_PAIRS and most > 6)


def test_first_fit_where_no_two_cells_are_alike(spark, monkeypatch):
    written, settled = [], grids.settled
    monkeypatch.setattr(grids, "settled", lambda df: written.append(df) or settled(df))
    vectors = np.random.default_rng(2).normal(size=(300, 64))
    vectors[7] = 1.0  # flat: like no cell, not even itself
    cells = [(i % 2, i, 10.0, [0.0, 0.0, 0.0], vectors[i % 150 if i >= 280 else i].tolist()) for i in range(300)]
    df = spark.createDataFrame(cells, "grid int, cell int, width double, colour array<double>, vector array<double>")
    got = {r.cell: r.cluster for r in grids.first_fit(df).collect()}
    assert got == {i: i - 150 if i >= 280 else i for i in range(300)}
    # A round decides thousands of medoids of a grid: not one round for every eight of them.
    assert len(written) <= 4


def test_raster_levels_have_the_precision_of_the_vectors(spark, duck, tmp_path):
    # Quotients that are the hole level as a float and a little more than that as a double: no ink.
    rng, level, found = np.random.default_rng(4), np.float32(0.4), []
    while len(found) < 8:
        high = np.float32(rng.uniform(0.5, 2))
        x = np.float32(level * high)
        if np.float32(x / high) == level and float(x) / float(high) > float(level):
            found.append((len(found), [0.0, float(high)] + [float(x)] * 62, 0))
    spark.createDataFrame(found, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck.execute(f"create or replace temp view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duck.execute(catalogue.SQL["glyph_holes"]).fetchall()}
    duck.execute("drop view temp.embeddings")
    assert {r.vec_id: (r.holes, r.upper, r.lower) for r in layers.glyph_holes(spark, str(tmp_path)).collect()} == want


def test_many_columns_of_a_bin_are_not_broadcast(spark):
    labels = spark.createDataFrame([(i, i % 5 * 30, i % 5 * 30 + 25) for i in range(50)] + [(99, None, 7)], "label_id int, x0 int, x1 int")
    columns = spark.createDataFrame([(i, i * 7, i * 7 + 5) for i in range(40)], "col_id int, c0 int, c1 int")
    made = recognition.nearest_overlap(labels, columns, 50.0)
    want = {}
    for r in labels.where("x0 is not null").collect():
        met = [(abs((c.c0 + c.c1) / 2 - (r.x0 + r.x1) / 2), c.col_id) for c in columns.collect() if min(c.c1, r.x1) > max(c.c0, r.x0)]
        if met:
            want[r.label_id] = min(met)
    assert {r.label_id: (r.distance, r.col_id) for r in made.collect()} == want and len(want) == 50
    assert "BroadcastHashJoin [bin" not in made._jdf.queryExecution().executedPlan().toString()


def uses(column, what):
    return str(column).count(what)


def test_values_of_nested_steps_are_written_once(spark):
    c = F.col("c")
    assert uses(cells.typed_money(c), "coalesce(c,") == 1 and uses(cells.typed_days(c), "coalesce(c,") == 1
    assert uses(recognition.marks(F.col("digits"), F.col("places")), "digits") == 1
    # A split's widest run is looked for once a step, however often it is used.
    assert uses(glyphs.split_widest(F.col("s"), F.col("p"), 1, F.col("t")), "minus") < 5


def test_settled_tables_are_columns(spark):
    # Steps that take a few columns of a settled table read those alone, and its files are packed.
    df = settled(spark.range(1000).select("id", F.lit("the same text in every row").alias("t"), F.array("id").alias("a")))
    assert {r.id for r in df.select("id").collect()} == set(range(1000)) and df.schema.names == ["id", "t", "a"]
    assert "ReadSchema: struct<id:bigint>" in df.select("id")._jdf.queryExecution().executedPlan().toString()


def test_a_page_is_read_in_few_passes(spark, monkeypatch):
    """Listings ask for no counts or notices; prices are read once a cell, and no sketch is made of pages that one sort holds."""
    made, plain = [], pages.settled
    monkeypatch.setattr(pages, "settled", lambda df: made.append(df) or plain(df))
    made_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    tokens = [(g, r, x, x + 7 * len(t), t) for g in (1, 2) for r in range(6) for x, t in ((0, str(r + 1)), (60, ("ACTV", "CLSD")[r % 2]), (150, f"0000000{r}"), (250, f"${200 + r},000"))]
    got = pages.read_pages(spark.createDataFrame(tokens, "grid int, row int, x0 int, x1 int, text string"))
    plans = [made_of(df) for df in made]
    assert got.listings.where("list_price is not null and status is not null").count() == 12
    assert sum("try_cast" in p.lower() or "decimal(38,2)" in p.lower() for p in plans) == 1 and not any("percentile_approx" in p or "approx_percentile" in p for p in plans)
    n = len(made)
    assert got.counts.count() == 2 and len(made) == n + 1 and got.notices.count() > 0 and len(made) == n + 2


def test_pages_of_any_size_are_read_alike(spark, monkeypatch):
    """Pages that are too large for one sort are read by sketches, with the same result."""
    r = random.Random(3)
    tokens = [(g, row, x, x + 7 * len(t), t) for g in range(3) for row in range(20) for x, t in ((0, str(row + 1)), (60, r.choice(["ACTV", "CLSD"])), (150, f"{row:08}"), (250, f"${r.randrange(100, 999)},000"), (350, r.choice(["", f"${r.randrange(100, 999)},000"]))) if t]
    tokens += [(g, 20 + g, 66, 200, "Northwestern Avenue") for g in range(2)] + [(g, row, 30, 37, "x") for g in range(2) for row in (3, 9)]
    df = spark.createDataFrame(tokens, "grid int, row int, x0 int, x1 int, text string")
    whole = [tuple(sorted(map(str, part.collect()))) for x in [pages.read_pages(df)] for part in (x.listings, x.cells, x.roles, x.notices, x.counts)]
    monkeypatch.setattr(ranks, "SMALL", 10)
    assert not ranks.is_small(df, ["grid"])
    assert [tuple(sorted(map(str, part.collect()))) for x in [pages.read_pages(df)] for part in (x.listings, x.cells, x.roles, x.notices, x.counts)] == whole
    plain = grids.cells(grids.split_fused(grids.token_columns(df)))
    assert sorted(map(str, plain.collect())) == sorted(map(str, grids.split_cells(grids.token_columns(df), True).collect()))


@pytest.mark.parametrize("small", [True, False])
def test_middles_beside_their_rows(spark, small):
    rows = [(g, v) for g, vs in {1: [5, 1, None, 9], 2: [4, 2, 2, 8], 3: [None], 4: [7]}.items() for v in vs]
    got = ranks.with_middles(spark.createDataFrame(rows, "g int, v int"), ["g"], "v", small).collect()
    assert {(r.g, r.lower, r.upper) for r in got} == {(1, 5, 5), (2, 2, 4), (3, None, None), (4, 7, 7)} and len(got) == len(rows)
