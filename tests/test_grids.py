"""Grid operators against plain loops: columns, fused columns, binding, compaction, clusters; pages read from tokens."""

import random
from collections import defaultdict

import numpy as np
import pytest

from marketlens.functions.vocab import HEADER_VOCABULARY
from marketlens.operators import grids, market
from marketlens.sources import pages

SCHEMA = "grid string, token int, row int, x0 int, x1 int, text string"


def groups(home):
    out = defaultdict(list)
    for token, key in home.items():
        out[key].append(token)
    return sorted(map(sorted, out.values()))


def plain_columns(tokens):
    spans, home = [], {}
    for x0, x1, t in sorted((x0, x1, t) for t, _, x0, x1 in tokens):
        for i, s in enumerate(spans):
            shared = min(x1, s[1]) - max(x0, s[0])
            if shared > 0 and shared >= 0.5 * min(x1 - x0, s[1] - s[0]):
                s[:], home[t] = [min(s[0], x0), max(s[1], x1)], i
                break
        else:
            spans.append([x0, x1])
            home[t] = len(spans) - 1
    return home


def plain_split(tokens, home):
    place, out = {t: (x0, x1, r) for t, r, x0, x1 in tokens}, {}
    for col in set(home.values()):
        own = [t for t in home if home[t] == col]
        rows = defaultdict(list)
        for t in own:
            rows[place[t][2]].append(place[t][:2])
        votes = []
        for row in rows.values():
            row.sort()
            gaps = [(b[0] - a[1], -a[1], a[1] + (b[0] - a[1]) / 2) for a, b in zip(row, row[1:])]
            if gaps:
                votes.append(max(gaps, key=lambda g: g[0])[2])
        votes.sort()
        width = max(place[t][1] for t in own) - min(place[t][0] for t in own)
        fused = len(votes) >= 2 and len(votes) >= 0.3 * len(rows) and votes[-1] - votes[0] <= 0.35 * width
        cut = votes[len(votes) // 2] if fused else 10**9
        for t in own:
            out[t] = (col, (place[t][0] + place[t][1]) / 2 >= cut)
    return out


def test_columns_and_fused_columns(spark):
    rng, rows = random.Random(5), []
    for g in range(40):
        for r in range(rng.randint(1, 20)):
            for c in range(rng.randint(1, 8)):
                x0 = rng.randint(0, 200) if g % 2 else c * 40 + rng.randint(0, 9)
                rows.append((f"g{g}", len(rows), r, x0, x0 + rng.randint(1, 60 if g % 2 else 45), "t"))
    df = spark.createDataFrame([*rows, ("g0", -1, 0, None, None, "lost")], SCHEMA)
    placed = grids.token_columns(df)
    first = {r.token: r for r in placed.collect()}
    assert first[-1].col is None and len(first) == len(rows) + 1
    split = {r.token: r.col for r in grids.split_fused(placed).collect()}
    n_split = 0
    for g in {r[0] for r in rows}:
        own = [(t, r, x0, x1) for gg, t, r, x0, x1, _ in rows if gg == g]
        home = plain_columns(own)
        assert groups(home) == groups({t: first[t].col for t in home})
        parts = plain_split(own, {t: first[t].col for t in home})
        assert groups(parts) == groups({t: split[t] for t in home})
        n_split += len(set(parts.values())) > len(set(home.values()))
        # Columns are numbered from the left.
        left = {c: min(x0 for t, _, x0, _ in own if split[t] == c) for c in set(split[t] for t in home)}
        assert sorted(left) == list(range(len(left))) and [left[c] for c in sorted(left)] == sorted(left.values())
    assert n_split > 5
    assert grids.split_fused(grids.token_columns(df.where("false"))).count() == 0


def test_cells_keep_their_tokens(spark):
    df = spark.createDataFrame([("a", 1, 0, 10, 20, "x"), ("a", 2, 0, 22, 30, "y"), ("a", 3, 1, 8, 31, "wide")], SCHEMA)
    assert {(r.row, r.text, r.n_tokens) for r in grids.cells(grids.token_columns(df)).collect()} == {(0, "x y", 2), (1, "wide", 1)}


def test_binding_is_one_pass_in_order(spark):
    rng, pairs, want = random.Random(9), [], set()
    for g in range(60):
        for i in range(rng.randint(1, 7)):
            score, x0 = rng.choice([0.5, 0.7, 0.7, 0.9]), rng.randint(0, 3)
            pairs += [(g, f"l{i}", score, x0, c, float(rng.randint(0, 2))) for c in rng.sample(range(8), rng.randint(1, 5))]
        taken = set()
        for _, _, label in sorted({(-s, x, n) for gg, n, s, x, _, _ in pairs if gg == g}):
            free = sorted((d, c) for gg, n, _, _, c, d in pairs if (gg, n) == (g, label) and c not in taken)
            if free:
                taken.add(free[0][1])
                want.add((g, label, free[0][1]))
    df = spark.createDataFrame(pairs, "grid int, label string, score double, x0 int, col int, distance double")
    assert {tuple(r) for r in grids.bind_one_to_one(df).collect()} == want
    assert grids.bind_one_to_one(df.where("false")).count() == 0


def test_compaction_maps_both_ways(spark):
    columns = spark.createDataFrame([("a", 10.0, 30.0), ("a", 40.0, 60.0), ("a", 200.0, 260.0), ("b", 0.0, 5.0)], "grid string, c0 double, c1 double")
    spans = grids.kept_spans(columns, spark.createDataFrame([("a", 300, 7), ("b", 6, 9)], "grid string, width int, glyph int"))
    assert {tuple(r) for r in spans.collect()} == {("a", 7.0, 63.0, 14.0, 70.0), ("a", 197.0, 263.0, 84.0, 150.0), ("b", 0.0, 6.0, 18.0, 24.0)}
    points = spark.createDataFrame([("a", float(x)) for x in range(0, 300, 7)] + [("b", 4.0), ("c", 1.0)], "grid string, x double")
    there = grids.to_compact(points, spans)
    lost = {(r.grid, r.x) for r in there.where("cx is null").collect()}
    assert lost == {("a", float(x)) for x in range(0, 300, 7) if not (7 <= x <= 63 or 197 <= x <= 263)} | {("c", 1.0)}
    assert all(r.x == r.sx for r in grids.to_source(there.where("cx is not null"), spans, "cx").collect())
    between = spark.createDataFrame([("a", 77.0), ("a", 2 * 100.0)], "grid string, x double")
    assert [r.sx for r in grids.to_source(between.where("x = 77"), spans).collect()] == [77.0]
    assert [r.sx for r in grids.to_source(between.where("x = 200"), spans, zoom=2.0).collect()] == [197.0 + 100 - 84]


def ncc(a, b):
    a, b = np.subtract(a, np.mean(a)), np.subtract(b, np.mean(b))
    return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9)


@pytest.mark.parametrize("leaders", [grids.LEADERS, 2])
def test_first_fit_clusters(spark, monkeypatch, leaders):
    monkeypatch.setattr(grids, "LEADERS", leaders)
    rng, noise = random.Random(5), np.random.default_rng(1)
    base, cells, want = np.random.default_rng(0).normal(size=(3, 24)), [], {}
    for g in range(5):
        medoids = []
        for i in range(16):
            cell = (g, i, float(rng.choice([10, 11, 15])), [float(rng.randint(0, 60)) for _ in range(3)], (base[rng.randrange(3)] + noise.normal(size=24) * rng.choice([0.1, 0.3])).tolist())
            cells.append(cell)
            for m in medoids:
                if abs(cell[2] - m[2]) / max(cell[2], m[2]) > 0.14:
                    continue
                shape = ncc(cell[4], m[4])
                if shape >= 0.955 or shape >= 0.86 and np.linalg.norm(np.subtract(cell[3], m[3])) <= 42:
                    want[g, i] = m[1]
                    break
            else:
                medoids.append(cell)
                want[g, i] = i
    df = spark.createDataFrame(cells, "grid int, cell int, width double, colour array<double>, vector array<double>")
    clusters = grids.first_fit(df)
    assert {(r.grid, r.cell): r.cluster for r in clusters.collect()} == want and len(set(want.values())) < len(want)
    c = {(r.grid, r.cluster): r for r in grids.centred(df, clusters).collect()}
    for key, r in c.items():
        own = [np.array(x[3]) for x in cells if want[x[0], x[1]] == key[1] and x[0] == key[0]]
        mean = np.floor(np.mean(own, axis=0) + 0.5)
        assert r.members == len(own) and r.colour == mean.tolist() and abs(r.spread - max(np.linalg.norm(o - mean) for o in own)) < 1e-9
    assert grids.first_fit(df.where("false")).count() == 0


def page(grid, header, lines, left=(0, 60, 150, 250, 350, 450)):
    out = []
    for row, cells in enumerate([header, *lines] if header else lines):
        out += [(grid, row, x, x + 7 * len(t), t) for x, t in zip(left, cells) if t]
    return out


def test_pages_to_listings(spark):
    lines = [("1", "CLSD", "00000001", "$240,000", "$200,000", "5"), ("2", "ACTV", "00000002", "$299,000", "", "7"), ("3", "HS48", "00000003", "$250,000", "", "9"), ("5", "QQQQ", "00000004", "$210,000", "", "1,234"), ("6", "ACTV", "00000005", "$245,000", "", ""), ("", "", "", "", "", "")]
    head = ("", "Stat", "MLS #", "List Price▲", "Sold Pr", "MT")
    tokens = page("a", head, [*lines, ("7", "CLSD", "00000001", "$238,000", "$231,000", "3")]) + page("b", None, [("hello", "", "world")])
    got = pages.read_pages(spark.createDataFrame(tokens, "grid string, row int, x0 int, x1 int, text string"))
    rows = {r.n: r for r in got.listings.where("grid = 'a'").collect()}
    assert [(rows[n]["index"], rows[n].status, rows[n].reject, rows[n].list_price, rows[n].sold_price, rows[n].market_time) for n in sorted(rows)] == [
        (1, "CLSD", None, 240000, 200000, 5), (2, "ACTV", None, 299000, None, 7), (3, "HS", None, 250000, None, 9), (5, None, "unread", 210000, None, None), (6, "ACTV", None, 245000, None, None), (7, "CLSD", None, 238000, 231000, 3)]
    told = sorted(got.notices.collect(), key=lambda r: (r.grid, r.seq))
    notices = {g: [r.text for r in told if r.grid == g] for g in "ab"}
    assert any(t.startswith("The grid numbers its rows 1–7, but 1 of them (4) are missing") for t in notices["a"])
    assert any("00000001 ×2" in t for t in notices["a"]) and any(t.startswith("1 status value(s) could not be read.") for t in notices["a"])
    assert any(t.startswith("1 MT (market time) cell(s) could not be read and 1 were blank") for t in notices["a"])
    counts = {r.grid: r for r in got.counts.collect()}
    assert all(r.tokens_lost == 0 for r in counts.values()) and counts["b"].chrome == 1 and counts["b"].no_money
    review = {r.grid: r for r in got.review.collect()}
    assert (review["b"].no_status_column, review["b"].confidence, review["a"].has_market_time) == (True, 0.0, True)
    gate = {r.grid: r.provisional for r in market.gate(market.placed(got.listings), ["grid"], got.review).collect()}
    assert gate == {"a": True}
    bands = spark.createDataFrame([("a", r, r * 20, r * 20 + (9 if r == 7 else 18), 149) for r in range(8) if r != 6], "grid string, row int, top int, bottom int, height int")
    cut = pages.read_pages(spark.createDataFrame(tokens, "grid string, row int, x0 int, x1 int, text string").where("grid = 'a'"), bands)
    assert {r.n for r in cut.listings.collect()} == {1, 2, 3, 4, 5} and cut.counts.first().rows_clipped == 1


def test_thin_band_roles(spark):
    """Against one pass over each page: rows from the top, labels by score, the nearest free column that overlaps."""
    r = random.Random(8)
    texts = list(HEADER_VOCABULARY) + ["nothing", "Stat▲", "List Price▼"]
    words, pages, columns = [], [], []
    for g in range(12):
        n_rows = 2 if g == 0 else r.randrange(3, 10)
        pages.append((g, n_rows))
        columns += [(g, c, c * 40, c * 40 + r.randrange(10, 60)) for c in range(r.randrange(2, 9))]
        for row in range(n_rows):
            starts = sorted(r.sample(range(0, 1300), r.choice([2, 8, 12])))
            words += [(g, row, x, x + r.randrange(20, 160), r.choice(texts), r.randrange(30, 100) / 100) for x in starts]
    want = set()
    for g, n_rows in pages:
        for row in range(min(6, n_rows - 1) if n_rows >= 3 else 0):
            line = [(x0, x1, HEADER_VOCABULARY.get(t.rstrip("▲▼")), s) for h, y, x0, x1, t, s in words if (h, y) == (g, row) and s >= 0.42]
            line = [x for x in line if x[2]]
            if len(line) < 4 or len({x[2] for x in line} & {"status", "list", "sold", "mls"}) < 2:
                continue
            free = {c: (a, b) for h, c, a, b in columns if h == g}
            for x0, x1, role, _ in sorted(line, key=lambda x: (-x[3], x[0])):
                near = [(abs((a + b) / 2 - (x0 + x1) / 8), c) for c, (a, b) in free.items() if min(x1 / 4, b) > max(x0 / 4, a)]
                if near:
                    want.add((g, row, min(near)[1], role))
                    free.pop(min(near)[1])
            break
    got = grids.thin_band_roles(
        spark.createDataFrame(words, "grid int, row int, x0 int, x1 int, text string, score double"), spark.createDataFrame(pages, "grid int, n_rows int"), spark.createDataFrame(columns, "grid int, col int, c0 int, c1 int"), 4.0
    )
    assert {tuple(x) for x in got.collect()} == want and want
