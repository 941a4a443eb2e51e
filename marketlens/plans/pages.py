"""Queries over pages of tokens: the listing view printed as pages, and what is read back from them.

A page holds the listings of 128 order numbers, a row band each; its columns stand at fixed places, text seven pixels a
character.  Two pages of three have a header row below a line of page chrome; every fifth page has a long street name
that reaches from the status column into the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.vocab import STATUS_BUCKET
from marketlens.operators import grids, market
from marketlens.operators.rounds import settled
from marketlens.plans.catalogue import L, listings, query
from marketlens.sources import pages

#: Column, edge ("left" or "right") and place, header label.
LAYOUT = [("index", "right", 40, None), ("status", "left", 60, "Stat"), ("mls", "left", 150, "MLS #"), ("orig", "right", 330, "Orig List Pr"), ("list", "right", 430, "List Price▼"), ("sold", "right", 530, "Sold Pr"), ("conc", "right", 610, "CONC"), ("mt", "right", 670, "MT")]
CHARACTER = 7
_ROWS = 128

_CLOSED = ", ".join(f"'{c}'" for c, b in STATUS_BUCKET.items() if b == "closed")
_money = "'$' || format('{{:,}}', {0})"

#: T: the tokens (g, row, name, x0, x1, text), and R: what a page prints of each listing.
PAGES = f"""{L}, R AS (SELECT n // {_ROWS} g, n % {_ROWS} + 2 AS row, mls, code, trim(status) status, greatest(list_price, orig_price) orig, least(list_price, orig_price) list, CASE WHEN code IN ({_CLOSED}) THEN sold_price END sold,
 CASE WHEN code IN ({_CLOSED}) AND n % 3 = 0 THEN CAST(round(concessions) AS BIGINT) END conc, market_time mt FROM C WHERE NOT omit),
U AS (SELECT g, row, unnest([{{'name': 'index', 'text': CAST(row - 1 AS VARCHAR)}}, {{'name': 'status', 'text': status}}, {{'name': 'mls', 'text': mls}}, {{'name': 'orig', 'text': {_money.format('orig')}}}, {{'name': 'list', 'text': {_money.format('list')}}},
 {{'name': 'sold', 'text': {_money.format('sold')}}}, {{'name': 'conc', 'text': format('{{:,}}', conc)}}, {{'name': 'mt', 'text': CAST(mt AS VARCHAR)}}]) x FROM R),
G AS (SELECT DISTINCT g FROM R),
V AS (SELECT g, row, x.name AS name, x.text AS text FROM U WHERE x.text IS NOT NULL
 UNION ALL SELECT g, 1, name, label FROM G, (VALUES {', '.join(f"('{c}', '{label}')" for c, _, _, label in LAYOUT if label)}) h(name, label) WHERE g % 3 > 0 UNION ALL SELECT g, 0, 'chrome', '1 – 128 of 128' FROM G WHERE g % 3 > 0),
T AS (SELECT g, row, name, CASE edge WHEN 'left' THEN place ELSE place - {CHARACTER} * length(text) END x0, CASE edge WHEN 'left' THEN place + {CHARACTER} * length(text) ELSE place END x1, text
 FROM V JOIN (VALUES ('chrome', 'left', 10), {', '.join(f"('{c}', '{e}', {p})" for c, e, p, _ in LAYOUT)}) l(name, edge, place) USING (name)
 UNION ALL SELECT g, 129 + 1, 'bridge', 66, 200, 'Northwestern Avenue' FROM G WHERE g % 5 = 0)"""


def tokens(spark, sf_dir) -> DataFrame:
    """The listing view as tokens (grid, row, name, x0, x1, text); ``name`` is what stands there and is not read."""
    n, closed = F.col("n"), F.col("closed")
    is_closed = F.coalesce(pages.read.once(pages.read.status_code(F.col("status")), lambda c: c.isin(*[c_ for c_, b in STATUS_BUCKET.items() if b == "closed"])), F.lit(False))
    dollars = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    shown = {
        "index": (n % _ROWS + 1).cast("string"), "status": F.trim("status"), "mls": F.col("mls"), "orig": dollars(F.greatest("list_price", "orig_price")), "list": dollars(F.least("list_price", "orig_price")),
        "sold": F.when(closed, dollars(F.col("sold_price"))), "conc": F.when(closed & (n % 3 == 0), F.format_number(F.round("concessions").cast("bigint"), 0)), "mt": F.col("market_time").cast("string"),
    }
    rows = listings(spark, sf_dir).where(~F.col("omit")).withColumn("grid", F.floor(n / _ROWS)).withColumn("closed", is_closed)
    token = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("text"))
    body = rows.select("grid", (n % _ROWS + 2).cast("int").alias("row"), F.inline(F.array(*[token(k, v) for k, v in shown.items()])))
    page = rows.select("grid").distinct()
    head = page.where("grid % 3 > 0")
    labels = head.select("grid", F.lit(1).alias("row"), F.inline(F.array(*[token(c, F.lit(label)) for c, _, _, label in LAYOUT if label])))
    chrome = head.select("grid", F.lit(0).alias("row"), F.lit("chrome").alias("name"), F.lit("1 – 128 of 128").alias("text"))
    printed = body.unionByName(labels).unionByName(chrome).where("text is not null")
    of = lambda i: F.element_at(F.create_map(F.lit("chrome"), F.lit(("left", 10)[i]), *[F.lit(x) for c, *at, _ in LAYOUT for x in (c, at[i])]), F.col("name"))
    wide, place = F.length("text") * CHARACTER, of(1)
    x0 = F.when(of(0) == "left", place).otherwise(place - wide)
    placed = printed.select("grid", "row", "name", x0.alias("x0"), (x0 + wide).alias("x1"), "text")
    bridge = page.where("grid % 5 = 0").select("grid", F.lit(130).alias("row"), F.lit("bridge").alias("name"), F.lit(66).alias("x0"), F.lit(200).alias("x1"), F.lit("Northwestern Avenue").alias("text"))
    return placed.unionByName(bridge)


_DIGITS = "floor(median(length(CAST({0} AS VARCHAR))) OVER (PARTITION BY g) + 0.5) - length(CAST({0} AS VARCHAR)) < 2"
_AMOUNT = "CASE WHEN {0} BETWEEN 1000 AND 30000000 THEN {0} END"
_READ = f"""{PAGES}, A AS (SELECT *, {', '.join(f"{_AMOUNT.format(c)} {c}_" for c in ('orig', 'list', 'sold'))} FROM R),
B AS (SELECT g, row, mls, code, {', '.join(f"CASE WHEN {_DIGITS.format(c + '_')} THEN {c}_ END {c}" for c in ('orig', 'list', 'sold'))}, conc, CASE WHEN g % 3 > 0 AND mt BETWEEN 0 AND 3650 THEN mt END mt, status FROM A),
M AS (SELECT g, median(sold) ms, median(list) ml, median(conc) mc, coalesce(median(sold) / nullif(median(list), 0), 0) NOT BETWEEN 0.5 AND 1.5 apart, coalesce(median(conc) > 0.25 * median(sold), false) large FROM B GROUP BY 1),
X AS (SELECT g AS grid, row n, row - 1 AS index, mls, code status, CASE WHEN status IS NULL THEN 'no-cell' WHEN code IS NULL THEN 'unread' END reject, list list_price, orig orig_price, CASE WHEN NOT apart THEN sold END sold_price, CAST(CASE WHEN NOT large THEN conc END AS DECIMAL(12,2)) concessions, CAST(mt AS INT) market_time FROM B JOIN M USING (g))"""


def _reading(spark, sf_dir) -> pages.Reading:
    return pages.read_pages(tokens(spark, sf_dir).drop("name"))


@query(f"{_READ} SELECT * FROM X")
def page_listings(spark, sf_dir):
    return _reading(spark, sf_dir).listings.drop("omit")


@query(
    f"""{_READ}, K AS (SELECT g AS grid, count(*) tokens, count(*) FILTER (WHERE name = 'chrome') tokens_above, count(*) FILTER (WHERE row = 1) tokens_header FROM T GROUP BY 1),
Y AS (SELECT grid, count(*) n, count(*) FILTER (WHERE status IS NULL) unread, count(*) FILTER (WHERE reject = 'no-cell') no_cell, count(market_time) mt_read, max(index) - min(index) + 1 - count(*) gaps FROM X GROUP BY 1),
Z AS (SELECT g AS grid, count(*) FILTER (WHERE mt < 0 OR mt > 3650) mt_unread, count(*) FILTER (WHERE mt IS NULL) mt_blank FROM R GROUP BY 1)
SELECT grid, tokens, tokens_above, tokens_header, tokens - tokens_above - tokens_header tokens_placed, 0 tokens_lost, n + CASE WHEN grid % 5 = 0 THEN 1 ELSE 0 END bands, CASE WHEN grid % 5 = 0 THEN 1 ELSE 0 END chrome, no_cell, unread, mt_read, CASE WHEN grid % 3 > 0 THEN mt_unread ELSE 0 END mt_unread,
 CASE WHEN grid % 3 > 0 THEN mt_blank + CASE WHEN grid % 5 = 0 THEN 1 ELSE 0 END ELSE n + CASE WHEN grid % 5 = 0 THEN 1 ELSE 0 END END mt_blank, CAST(apart AS INT) + CAST(large AS INT) role_problems, CASE WHEN gaps > 0 THEN 1 ELSE 0 END + CAST(apart AS INT) + CAST(large AS INT) errors,
 round(greatest(0.2, CASE WHEN apart THEN 0.2 WHEN grid % 3 > 0 THEN 0.95 ELSE 0.45 END - 0.2 * (CAST(apart AS INT) + CAST(large AS INT))), 6) confidence FROM K JOIN Y USING (grid) JOIN Z USING (grid) JOIN M ON g = grid"""
)
def page_review(spark, sf_dir):
    """What became of each page's tokens and bands, and what its summary must disclose."""
    r = _reading(spark, sf_dir)
    kept = ["tokens", "tokens_above", "tokens_header", "tokens_placed", "tokens_lost", "bands", "chrome", "no_cell", "unread", "mt_read", "mt_unread", "mt_blank"]
    return r.counts.select("grid", *kept).join(r.review.select("grid", "role_problems", "errors", F.round("confidence", 6).alias("confidence")), "grid")


@query(
    f"""{_READ}, P2 AS (SELECT *, CASE WHEN status IS NULL THEN 'unresolved' ELSE coalesce(vbucket, 'unclassified') END place FROM X LEFT JOIN vocab ON code = status),
Q AS (SELECT *, CASE WHEN place = 'closed' AND sold_price > 0 THEN sold_price WHEN place IN ('active', 'pending') AND list_price > 0 THEN list_price END price FROM P2)
SELECT grid, place bucket, count(*) n_rows, count(price) priced, min(price) low, max(price) high, CAST(round(median(price)) AS BIGINT) median_price FROM Q WHERE place <> 'unresolved' GROUP BY 1, 2"""
)
def page_summary(spark, sf_dir):
    """The bucket summary of each page, from what was read of it."""
    placed = market.placed(_reading(spark, sf_dir).listings)
    return market.bucket_summary(placed, ["grid"], spine=False).select("grid", "bucket", "n_rows", "priced", "low", "high", "median_price")


_COLUMNS = f"""{PAGES}, D AS (SELECT *, CASE name WHEN 'bridge' THEN 'mls' ELSE name END c FROM T WHERE name <> 'chrome' AND row <> 1),
O AS (SELECT g, c, min(x0) c0, max(x1) c1, row_number() OVER (PARTITION BY g ORDER BY min(x0), max(x1)) - 1 AS col FROM D GROUP BY 1, 2)"""


def _body(spark, sf_dir) -> DataFrame:
    return tokens(spark, sf_dir).where("name <> 'chrome' and row <> 1")


@query(f"{_COLUMNS} SELECT g grid, col, name, count(*) n_tokens FROM D JOIN O USING (g, c) GROUP BY ALL")
def token_columns(spark, sf_dir):
    """Every token in its own column, found by overlap and split where a wide token had joined two."""
    placed = grids.split_fused(settled(grids.token_columns(settled(_body(spark, sf_dir)))))
    return placed.groupBy("grid", "col", "name").agg(F.count("*").alias("n_tokens"))


@query(f"{_COLUMNS}, W AS (SELECT g, row, max(x1) FILTER (WHERE name = 'status') a, min(x0) FILTER (WHERE name = 'mls') b FROM D WHERE g % 5 = 0 GROUP BY 1, 2), V2 AS (SELECT g, list((a + b) / 2 ORDER BY a + b) v FROM W WHERE a IS NOT NULL GROUP BY 1) SELECT g grid, 1 AS col, CAST(v[len(v) // 2 + 1] AS DOUBLE) cut FROM V2")
def fused_columns(spark, sf_dir):
    """Columns that a wide token has joined, and where they part."""
    return grids.fused_cuts(grids.token_columns(settled(_body(spark, sf_dir)))).withColumn("cut", F.col("cut").cast("double"))


_SPANS = f"""{_COLUMNS}, E0 AS (SELECT g, greatest(0, c0 - 3) a, least(700, c1 + 3) b FROM O WHERE c NOT IN ('mls', 'mt')),
E1 AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY g ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 12, true) opens FROM E0),
E2 AS (SELECT g, part, min(a) s0, max(b) s1 FROM (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY g ORDER BY a, b) part FROM E1) GROUP BY 1, 2),
E3 AS (SELECT *, 14 + coalesce(sum(s1 - s0 + 14) OVER (PARTITION BY g ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) d0 FROM E2)"""


def _spans(rows: DataFrame) -> DataFrame:
    wide = rows.groupBy("grid", F.when(F.col("name") == "bridge", "mls").otherwise(F.col("name")).alias("name")).agg(F.min("x0").alias("c0"), F.max("x1").alias("c1"))
    pages_ = wide.select("grid").distinct().select("grid", F.lit(700).alias("width"), F.lit(CHARACTER).alias("glyph"))
    return grids.kept_spans(wide.where("name not in ('mls', 'mt')"), pages_)


@query(f"{_SPANS} SELECT g grid, CAST(s0 AS DOUBLE) s0, CAST(s1 AS DOUBLE) s1, CAST(d0 AS DOUBLE) d0, CAST(d0 + s1 - s0 AS DOUBLE) d1 FROM E3")
def kept_spans(spark, sf_dir):
    """The parts of each page that are worth reading, and where they stand side by side."""
    return _spans(_body(spark, sf_dir))


@query(f"{_SPANS} SELECT g grid, row, name, x0 x, CAST(d0 + x0 - s0 AS DOUBLE) cx, CAST(CASE WHEN s0 IS NOT NULL THEN x0 END AS DOUBLE) sx FROM (SELECT D.*, s0, s1, d0 FROM D LEFT JOIN E3 ON D.g = E3.g AND x0 BETWEEN s0 AND s1)")
def compacted_places(spark, sf_dir):
    """Each token's place on the compacted page and, from there, back on its own; none where the page was not kept."""
    body = settled(_body(spark, sf_dir).select("grid", "row", "name", "x0", "x1"))
    spans = settled(_spans(body))
    points = body.select("grid", "row", "name", F.col("x0").alias("x"))
    there = grids.to_compact(points, spans)
    return grids.to_source(there, spans, "cx")


@query(
    f"""{_COLUMNS}, N AS (SELECT g, c, count(*) n, avg(CAST(length(text) BETWEEN 1 AND 3 AS INT)) short, avg(CAST(text LIKE '%,%' AS INT)) marked, avg(CAST(length(text) = 8 AS INT)) eight, avg(CAST(length(text) BETWEEN 2 AND 5 AS INT)) word, max(x1) - min(x0) <= 70 narrow FROM D GROUP BY 1, 2),
J AS (SELECT g, arg_min(c, c0) first FROM N JOIN O USING (g, c) WHERE n >= 3 AND short >= 0.9 GROUP BY 1)
SELECT g grid, c name, why FROM (SELECT g, c, CASE WHEN g % 3 = 2 AND c IN ('status', 'list', 'conc') THEN c WHEN c = first THEN 'index?' WHEN g % 3 = 2 THEN NULL WHEN marked >= 0.8 THEN 'money?' WHEN eight >= 0.6 THEN 'mls?' WHEN word >= 0.8 AND narrow THEN 'status?' END why FROM N LEFT JOIN J USING (g)) WHERE why IS NOT NULL"""
)
def columns_worth_reading(spark, sf_dir):
    """What a page's columns look like decides which are read at full size; a header that names enough decides alone."""
    rows = _body(spark, sf_dir).withColumn("col", F.when(F.col("name") == "bridge", "mls").otherwise(F.col("name")))
    shown = rows.select("grid", "col", "x0", "x1", F.length("text").alias("glyphs"), F.when(F.col("text").contains(","), 1).otherwise(0).alias("marks"), F.lit(CHARACTER).alias("glyph"))
    header = rows.select("grid").distinct().where("grid % 3 = 2").select("grid", F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(c).alias("role")) for c in ("status", "list", "conc")])))
    return grids.worth_reading(shown, header).select("grid", F.col("col").alias("name"), "why")
