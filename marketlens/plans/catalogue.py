"""The query catalogue over the star-schema tables, each query with its SQL for a second engine.

The tables hold no listings, so one view makes them from orders and their line items, in both engines, with
status codes, missing values and zeros set by fixed rules so that every branch of the operators is met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import cells
from marketlens.functions.vocab import ROLE_LABELS, STATUS_BUCKET, label_key, status_table
from marketlens.operators import market, recognition, report
from marketlens.operators.ranks import medians
from marketlens.operators.rounds import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing view: one row per order."""
    d = lambda c: F.col(c).cast("decimal(12,2)")
    li = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(d("l_extendedprice")).alias("ext"), F.sum(d("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).alias("net"),
        F.sum(d("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)")).alias("tax"), F.min("l_shipdate").alias("ship"),
    )
    o = _table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    status = (
        F.when(k % 23 == 0, None)
        .when((s == "F") & (p == "5"), "EXP").when((s == "F") & (p == "1"), "S").when(s == "F", "CLSD")
        .when((s == "O") & (p == "1"), "new").when((s == "O") & (p == "2"), "AUCT").when((s == "O") & (p == "5"), "PRIV-ACTV").when(s == "O", "ACTV")
        .when(p == "2", "HS48").when(p == "3", " A/I ").when(p == "4", "ZZZ").otherwise("PEND")
    )
    whole = lambda c: F.round(c, 0).cast("bigint")
    return o.select(
        k.alias("n"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("mls"), status.alias("status"),
        whole(F.col("o_totalprice").cast("decimal(14,2)")).alias("list_price"), whole(F.col("ext")).alias("orig_price"), F.when(k % 17 != 0, whole(F.col("net"))).alias("sold_price"),
        F.round("tax", 2).cast("decimal(12,2)").alias("concessions"), F.when(k % 29 == 0, 0).otherwise(F.datediff("ship", "o_orderdate")).alias("market_time"),
        (k % 31 == 0).alias("omit"), F.col("o_custkey").alias("custkey"),
    )


def _placed(spark: SparkSession, sf_dir: str, overrides: dict[str, str] | None = None) -> DataFrame:
    return market.placed(listings(spark, sf_dir), overrides)


def _placed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placed listings as a stored table, for queries that take several figures of them."""
    return settled(_placed(spark, sf_dir))


_KNOWN = ", ".join(f"('{c}', '{b}')" for c, b in STATUS_BUCKET.items())

L = f"""WITH vocab(code, vbucket) AS (VALUES {_KNOWN}),
li AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) ext,
  sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) net,
  sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) tax, min(l_shipdate) ship FROM lineitem GROUP BY l_orderkey),
L AS (SELECT o_orderkey n, lpad(CAST(o_custkey AS VARCHAR), 8, '0') mls, o_custkey custkey, o_orderkey % 31 = 0 AS omit,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL
   WHEN o_orderstatus = 'F' THEN CASE o_orderpriority[1] WHEN '5' THEN 'EXP' WHEN '1' THEN 'S' ELSE 'CLSD' END
   WHEN o_orderstatus = 'O' THEN CASE o_orderpriority[1] WHEN '1' THEN 'new' WHEN '2' THEN 'AUCT' WHEN '5' THEN 'PRIV-ACTV' ELSE 'ACTV' END
   ELSE CASE o_orderpriority[1] WHEN '2' THEN 'HS48' WHEN '3' THEN ' A/I ' WHEN '4' THEN 'ZZZ' ELSE 'PEND' END END status,
  CAST(round(CAST(o_totalprice AS DECIMAL(14,2)), 0) AS BIGINT) list_price, CAST(round(ext, 0) AS BIGINT) orig_price,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(round(net, 0) AS BIGINT) END sold_price, CAST(round(tax, 2) AS DECIMAL(12,2)) concessions,
  CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE date_diff('day', o_orderdate, ship) END market_time
 FROM orders LEFT JOIN li ON o_orderkey = l_orderkey),
C AS (SELECT L.*, CASE WHEN regexp_matches(upper(trim(status)), '^(HS|HC|PS|PC)[0-9]+$') THEN upper(trim(status))[1:2]
  WHEN upper(trim(status)) LIKE 'PRIV-%' THEN CASE WHEN upper(trim(status))[6:] IN (SELECT code FROM vocab) THEN upper(trim(status))[6:] ELSE 'PRIV' END
  WHEN upper(trim(status)) IN (SELECT code FROM vocab) THEN upper(trim(status)) END code FROM L),
P0 AS (SELECT C.*, CASE WHEN omit THEN 'omitted' WHEN status IS NULL THEN 'unresolved' ELSE coalesce(vbucket, 'unclassified') END placement FROM C LEFT JOIN vocab USING (code)),
P AS (SELECT *, CASE WHEN placement = 'closed' AND sold_price > 0 THEN sold_price WHEN placement IN ('active', 'pending') AND list_price > 0 THEN list_price END price,
  CASE WHEN placement = 'closed' AND sold_price > 0 AND orig_price > 0 AND sold_price - greatest(coalesce(concessions, 0), 0) > 0
   THEN CAST(sold_price - greatest(coalesce(concessions, 0), 0) AS DOUBLE) / CAST(orig_price AS DOUBLE) END ratio FROM P0)
"""

_STATS = """count(*) n_rows, count(price) priced, count(*) - count(price) missing, min(price) low, max(price) high, CAST(round(median(price)) AS BIGINT) median_price,
 count(ratio) ratio_rows, round(min(ratio), 9) ratio_low, round(max(ratio), 9) ratio_high, round(median(ratio), 9) ratio_median, round(avg(ratio), 9) ratio_mean,
 count(*) FILTER (WHERE market_time >= 0) dom_rows, CAST(min(market_time) FILTER (WHERE market_time >= 0) AS BIGINT) dom_low, CAST(max(market_time) FILTER (WHERE market_time >= 0) AS BIGINT) dom_high,
 CAST(round(median(market_time) FILTER (WHERE market_time >= 0)) AS BIGINT) dom_median"""
_BUCKETS = "(VALUES ('active'), ('pending'), ('closed'), ('excluded'), ('unclassified')) b(bucket)"
_ZERO = ["n_rows", "priced", "missing", "ratio_rows", "dom_rows"]
_REST = ["low", "high", "median_price", "ratio_low", "ratio_high", "ratio_median", "ratio_mean", "dom_low", "dom_high", "dom_median"]
_SPINE = ", ".join([*(f"CAST(coalesce({c}, 0) AS BIGINT) {c}" for c in _ZERO), *_REST])
_SUMMARY = f"S AS (SELECT bucket, {_SPINE} FROM {_BUCKETS} LEFT JOIN (SELECT placement bucket, {_STATS} FROM P GROUP BY 1) USING (bucket))"


def _shown(summary: DataFrame) -> DataFrame:
    """The summary with doubles rounded for comparison and days as bigint."""
    return summary.withColumns({**{c: F.round(c, 9) for c in ("ratio_low", "ratio_high", "ratio_median", "ratio_mean")}, **{c: F.col(c).cast("bigint") for c in ("dom_low", "dom_high")}})


@query(f"{L}, {_SUMMARY} SELECT * FROM S")
def bucket_summary(spark, sf_dir):
    return _shown(market.bucket_summary(_placed_once(spark, sf_dir)))


@query(
    f"""{L}, R AS (SELECT P.*, n_name nation FROM P JOIN customer ON custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT nation, bucket, {_SPINE} FROM (SELECT DISTINCT nation FROM R) CROSS JOIN {_BUCKETS} LEFT JOIN (SELECT nation, placement bucket, {_STATS} FROM R GROUP BY 1, 2) USING (nation, bucket)"""
)
def bucket_summary_by_nation(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey")
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    rows = _placed_once(spark, sf_dir).join(c, "custkey").join(nation, "c_nationkey")
    return _shown(market.bucket_summary(rows, ["nation"]))


@query(f"{L} SELECT status, code, count(*) n_rows FROM C GROUP BY 1, 2")
def status_normalize(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("code", cells.status_code(F.col("status"))).groupBy("status", "code").agg(F.count("*").alias("n_rows"))


@query(f"{L} SELECT vocab.code, vbucket bucket, count(C.code) n_rows FROM vocab LEFT JOIN C ON C.code = vocab.code GROUP BY 1, 2")
def default_mapping(spark, sf_dir):
    """Each code of the vocabulary with its bucket and how many listings carry it."""
    carried = listings(spark, sf_dir).groupBy(cells.status_code(F.col("status")).alias("code")).agg(F.count("*").alias("n_rows"))
    return status_table(spark).select("code", "bucket").join(F.broadcast(carried), "code", "left").fillna(0, ["n_rows"])  # one row per code


@query(f"{L}, M AS (SELECT *, CASE WHEN placement IN ('omitted', 'unresolved') THEN placement WHEN code = 'A/I' THEN 'active' WHEN code = 'EXP' THEN 'closed' ELSE placement END place FROM P) SELECT place placement, count(*) n_rows FROM M GROUP BY 1")
def mapping_override(spark, sf_dir):
    return _placed(spark, sf_dir, {"A/I": "active", "EXP": "closed"}).groupBy("placement").agg(F.count("*").alias("n_rows"))


@query(f"{L} SELECT n, placement, price FROM P")
def price_for_row(spark, sf_dir):
    return _placed(spark, sf_dir).select("n", "placement", "price")


@query(f"{L} SELECT n, round(ratio, 9) ratio FROM P WHERE placement = 'closed'")
def sale_to_list_ratio(spark, sf_dir):
    return _placed(spark, sf_dir).where("placement = 'closed'").select("n", F.round("ratio", 9).alias("ratio"))


@query(f"{L} SELECT count(ratio) n_ratio, round(min(ratio), 9) low, round(max(ratio), 9) high, round(median(ratio), 9) median_ratio, round(avg(ratio), 9) mean_ratio FROM P")
def ratio_stats(spark, sf_dir):
    r = F.col("ratio")
    rows = _placed(spark, sf_dir)
    plain = rows.agg(F.count(r).alias("n_ratio"), F.round(F.min(r), 9).alias("low"), F.round(F.max(r), 9).alias("high"), F.round(F.avg(r), 9).alias("mean_ratio"))
    return plain.crossJoin(F.broadcast(medians(rows, [], "ratio").select(F.round("median", 9).alias("median_ratio"))))  # one row each


@query(f"{L} SELECT placement, count(*) dom_rows, CAST(round(median(market_time)) AS BIGINT) dom_median FROM P WHERE market_time >= 0 GROUP BY 1")
def median_dom(spark, sf_dir):
    found = medians(_placed(spark, sf_dir).where("market_time >= 0"), ["placement"], "market_time")
    return found.select("placement", F.col("n_values").alias("dom_rows"), F.round("median").cast("bigint").alias("dom_median"))


@query(f"{L} SELECT placement, count(*) n_rows, count(price) priced, count(*) - count(price) missing FROM P GROUP BY 1")
def priced_vs_missing(spark, sf_dir):
    return _placed(spark, sf_dir).groupBy("placement").agg(F.count("*").alias("n_rows"), F.count("price").alias("priced"), (F.count("*") - F.count("price")).alias("missing"))


@query(
    f"""{L}, G AS (SELECT mls FROM P WHERE placement = 'closed' GROUP BY 1 HAVING count(*) <= 10 AND count(ratio) > 0)
SELECT mls, row_number() OVER (PARTITION BY mls ORDER BY n) comp, n, price, round(ratio, 9) ratio FROM P JOIN G USING (mls) WHERE placement = 'closed'"""
)
def comp_list(spark, sf_dir):
    return market.comp_list(_placed(spark, sf_dir), ["mls"]).select("mls", F.col("comp").cast("bigint").alias("comp"), "n", "price", F.round("ratio", 9).alias("ratio"))


@query("SELECT l_orderkey, l_linenumber, count(*) times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return market.duplicate_keys(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


_GAPS = "SELECT {0} AS grp, CAST(min({1}) AS BIGINT) first_no, CAST(max({1}) AS BIGINT) last_no, count(*) n_rows, count(DISTINCT {1}) n_distinct, CAST(max({1}) - min({1}) + 1 - count(DISTINCT {1}) AS BIGINT) absent FROM {2} GROUP BY 1"


@query(_GAPS.format("l_orderkey", "l_linenumber", "lineitem") + " UNION ALL " + _GAPS.format("conv_id", "turn", "conversations"))
def row_number_gaps(spark, sf_dir):
    a = market.number_gaps(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").withColumnRenamed("l_orderkey", "grp")
    b = market.number_gaps(_table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumnRenamed("conv_id", "grp")
    return a.unionByName(b)


_PLACES = ["active", "pending", "closed", "excluded", "unclassified", "unresolved", "omitted"]


@query(f"{L} SELECT count(*) total_rows, {', '.join(f'count(*) FILTER (WHERE placement = {chr(39)}{p}{chr(39)}) {p}' for p in _PLACES)}, count(placement) accounted, count(placement) = count(*) balanced FROM P")
def accounting_balance(spark, sf_dir):
    return market.accounting(_placed(spark, sf_dir))


@query(
    f"""{L}, R AS (SELECT P.*, c_mktsegment segment FROM P JOIN customer ON custkey = c_custkey),
G AS (SELECT segment, count(*) total_rows, count(*) FILTER (WHERE placement = 'unresolved') u, count(*) FILTER (WHERE placement = 'unclassified') x,
 count(*) FILTER (WHERE placement = 'active' AND price IS NULL) pa, count(*) FILTER (WHERE placement = 'pending' AND price IS NULL) pp, count(*) FILTER (WHERE placement = 'closed' AND price IS NULL) pc,
 count(*) FILTER (WHERE placement = 'active' AND coalesce(market_time < 0, true)) d FROM R GROUP BY 1)
SELECT segment, total_rows, total_rows accounted, true balanced, u + x + pa + pp + pc + d > 0 provisional, concat_ws('; ', CASE WHEN u > 0 THEN u || ' of ' || total_rows || ' row(s) have no readable status' END,
 CASE WHEN x > 0 THEN x || ' row(s) carry an unrecognized status code' END, CASE WHEN pa > 0 THEN pa || ' active row(s) have no readable price' END, CASE WHEN pp > 0 THEN pp || ' pending row(s) have no readable price' END,
 CASE WHEN pc > 0 THEN pc || ' closed row(s) have no readable price' END, CASE WHEN d > 0 THEN d || ' active row(s) have no market time' END) reasons FROM G"""
)
def provisional_reasons(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    return market.gate(_placed(spark, sf_dir).join(c, "custkey"), ["segment"]).drop("reason_list")


@query(f"{L} SELECT n, mls, status, placement FROM P WHERE placement IN ('unresolved', 'omitted')")
def unresolved_rows(spark, sf_dir):
    return _placed(spark, sf_dir).where(F.col("placement").isin("unresolved", "omitted")).select("n", "mls", "status", "placement")


@query(f"{L} SELECT code, count(*) n_rows FROM C WHERE code IS NOT NULL GROUP BY 1")
def present_codes(spark, sf_dir):
    return market.present_codes(listings(spark, sf_dir))


@query(f"{L} SELECT DISTINCT unnest(CASE WHEN status LIKE 'PRIV-%' THEN [code, 'PRIV'] ELSE [code] END) code FROM C WHERE status LIKE 'PRIV-%' OR code IN ('AUCT', 'PRIV', 'A/I', 'CTGO', 'SS', 'HS', 'RNTD') EXCEPT SELECT 'ACTV'")
def flagged_codes(spark, sf_dir):
    return market.flagged_codes(listings(spark, sf_dir)).select("code")


@query(
    f"""{L}, E AS (SELECT n, mls, CASE WHEN n % 7 = 0 THEN 'CLSD' ELSE status END status, CASE WHEN n % 7 = 0 THEN NULL ELSE sold_price END sold_price,
 CASE WHEN n % 11 = 0 THEN list_price + 1000 ELSE list_price END list_price, n % 13 = 0 AS omit,
 (n % 7 = 0 AND (status IS DISTINCT FROM 'CLSD' OR sold_price IS NOT NULL)) OR n % 11 = 0 AS edited FROM L)
SELECT n, status, list_price, sold_price, omit, edited FROM E"""
)
def edits_overlay(spark, sf_dir):
    rows = listings(spark, sf_dir).drop("omit")
    seven = F.map_from_arrays(F.array(F.lit("status"), F.lit("sold_price")), F.array(F.lit("CLSD"), F.lit(None).cast("string")))
    eleven = F.create_map(F.lit("list_price"), (F.col("list_price") + 1000).cast("string"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    patch = F.map_concat(F.when(F.col("n") % 7 == 0, seven).otherwise(none), F.when(F.col("n") % 11 == 0, eleven).otherwise(none))
    edits = rows.where("n % 7 = 0 or n % 11 = 0 or n % 13 = 0").select("n", patch.alias("patch"), (F.col("n") % 13 == 0).alias("omit"))
    return market.with_edits(rows, edits).select("n", "status", "list_price", "sold_price", "omit", "edited")


_MONEY_TEXT = """CASE p_partkey % 8 WHEN 0 THEN '$' || format('{:,}', CAST(c AS BIGINT)) || '.50' WHEN 1 THEN ' ' || CAST(CAST(c AS BIGINT) AS VARCHAR) || chr(9) WHEN 2 THEN '$0' WHEN 3 THEN '1,23,456'
 WHEN 4 THEN '12O,000' WHEN 5 THEN '' WHEN 6 THEN '999' ELSE '$ ' || format('{:,}', CAST(c AS BIGINT)) END"""


@query(
    f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(c AS BIGINT) + 1 WHEN 1 THEN CAST(c AS BIGINT) WHEN 7 THEN CAST(c AS BIGINT) END AS value,
 CASE p_partkey % 8 WHEN 2 THEN 'blank' WHEN 5 THEN 'blank' WHEN 3 THEN 'error' WHEN 4 THEN 'error' WHEN 6 THEN 'error' ELSE 'value' END state,
 CASE p_partkey % 8 WHEN 3 THEN 'not an amount' WHEN 4 THEN 'not an amount' WHEN 6 THEN 'out of range' END why
FROM (SELECT p_partkey, floor(CAST(p_retailprice AS DECIMAL(12,2)) * 100) c FROM part)"""
)
def money_parse(spark, sf_dir):
    c = F.floor(F.col("p_retailprice").cast("decimal(12,2)") * 100).cast("bigint")
    grouped, k = F.format_number(c, 0), F.col("p_partkey") % 8
    text = (
        F.when(k == 0, F.concat(F.lit("$"), grouped, F.lit(".50"))).when(k == 1, F.concat(F.lit(" "), c.cast("string"), F.lit("\t"))).when(k == 2, "$0").when(k == 3, "1,23,456").when(k == 4, "12O,000").when(k == 5, "").when(k == 6, "999")
        .otherwise(F.concat(F.lit("$ "), grouped))
    )
    return _table(spark, sf_dir, "part").select("p_partkey", cells.money(text).alias("m")).select("p_partkey", "m.*")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN CASE WHEN d <= 3650 THEN CAST(d AS BIGINT) END END AS value, CASE WHEN o_orderkey % 5 IN (0, 1) AND d <= 3650 THEN 'value' WHEN o_orderkey % 5 = 2 THEN 'blank' ELSE 'error' END state
FROM (SELECT o_orderkey, abs(o_custkey * 7 % 5000) d FROM orders)"""
)
def days_parse(spark, sf_dir):
    d, k = F.abs(F.col("o_custkey") * 7 % 5000), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.format_number(d, 0)).when(k == 1, d.cast("string")).when(k == 2, " ").when(k == 3, "12.5").otherwise("9999")
    return _table(spark, sf_dir, "orders").select("o_orderkey", cells.days(text).alias("d")).select("o_orderkey", F.col("d.value").cast("bigint").alias("value"), "d.state")


@query("SELECT p_partkey, '$' || format('{:,}', CAST(round(CAST(p_retailprice AS DECIMAL(12,2)), 0) AS BIGINT)) dollars, format('{:,}', CAST(p_size AS BIGINT)) AS days FROM part")
def money_format(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", cells.dollars(F.round(F.col("p_retailprice").cast("decimal(12,2)"), 0)).alias("dollars"), cells.day_count(F.col("p_size")).alias("days"))


@query(f"{L} SELECT n, CASE WHEN ratio IS NULL THEN '—' ELSE format('{{:.3f}}', ratio * 100) || '%' END ratio_text FROM P WHERE placement = 'closed'")
def ratio_format(spark, sf_dir):
    return _placed(spark, sf_dir).where("placement = 'closed'").select("n", cells.percent(F.col("ratio")).alias("ratio_text"))


@query("SELECT p_brand, count(*) n_refused, array_to_string(list(p_partkey ORDER BY p_partkey)[1:6], ',') sample FROM part WHERE p_partkey % 8 IN (3, 4, 6) GROUP BY 1")
def refused_cells(spark, sf_dir):
    parts = money_parse(spark, sf_dir).where("state = 'error'").join(_table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    # Six smallest per brand: a bounded sample of the report, kept by partial top-k.
    from pyspark.sql import Window as W

    first = parts.withColumn("r", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))).where("r <= 6")
    sample = first.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")).cast("array<string>"), ",").alias("sample"))
    return parts.groupBy("p_brand").agg(F.count("*").alias("n_refused")).join(sample, "p_brand")


_ROLE_VALUES = ", ".join(f"({i}, '{label}', '{role}')" for i, (label, role) in enumerate((x, r) for r, labels in ROLE_LABELS.items() for x in labels))
_N_LABELS = sum(map(len, ROLE_LABELS.values()))


@query(
    f"""WITH V(i, label, role) AS (VALUES {_ROLE_VALUES}), K AS (SELECT s_suppkey k, unnest([k % {_N_LABELS}, k * 7 % {_N_LABELS}, (k // {_N_LABELS} + 11) % {_N_LABELS}, -1]) i, unnest([0, 1, 2, 3]) idx FROM (SELECT s_suppkey, s_suppkey k FROM supplier)),
H AS (SELECT k, idx, label, role FROM K JOIN V USING (i)), A AS (SELECT k FROM H GROUP BY 1 HAVING count(DISTINCT role) FILTER (WHERE role IN ('status', 'mls', 'list', 'orig', 'sold')) >= 2), C AS (SELECT k, role, count(*) n FROM H GROUP BY 1, 2)
SELECT CAST(k AS VARCHAR) file, role, CASE WHEN n = 1 THEN idx END idx, string_agg(label, ' / ' ORDER BY idx) AS label FROM H JOIN A USING (k) JOIN C USING (k, role) GROUP BY k, role, n, CASE WHEN n = 1 THEN idx END"""
)
def header_bind(spark, sf_dir):
    """An export per supplier with three of the known headings and a foreign one, in any case; a role that two headings
    claim is bound to none."""
    from marketlens.sources import exports

    k = F.col("s_suppkey")
    label = lambda i: F.element_at(F.array(*[F.lit(x) for labels in ROLE_LABELS.values() for x in labels]), (i % _N_LABELS + 1).cast("int"))
    heads = [label(k), F.upper(label(k * 7)), F.concat(F.lit(" "), label(F.floor(k / _N_LABELS) + 11)), F.lit("CDOM")]
    content = F.concat(F.lit("export\tof\n"), F.concat_ws("\t", *heads), F.lit("\n"), F.concat_ws("\t", F.col("s_name"), F.lit("1"), F.lit("2"), F.lit("3")), F.lit("\n"))
    h = exports.headers(exports.records(_table(spark, sf_dir, "supplier").select(k.cast("string").alias("file"), content.alias("content"))))
    one = h.select("file", F.inline("bound")).select("file", "role", F.col("at").alias("idx"), "label")
    several = h.select("file", F.inline("ambiguous")).select("file", "role", F.lit(None).cast("int").alias("idx"), F.array_join("labels", " / ").alias("label"))
    # Headings are compared as the dictionary spells them.
    own = F.create_map(*[F.lit(x) for labels in ROLE_LABELS.values() for name in labels for x in (label_key(name), name)])
    spelt = F.array_join(F.transform(F.split("label", " / "), lambda x: F.element_at(own, cells.label_key(x))), " / ")
    return one.unionByName(several).withColumn("label", spelt)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export per hundred customers, with quoting, blank lines, short and empty records set by customer key."""
    n = _table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 100).alias("r"), F.col("c_custkey").alias("k"))
    line = (
        F.when(F.col("k") % 5 == 3, F.concat(F.col("k").cast("string"), F.lit(",ACTV")))
        .when(F.col("k") % 5 == 4, F.lit(",,"))
        .otherwise(F.concat(F.col("k").cast("string"), F.lit(',"ACTV","'), F.format_number(F.col("k") % 2000 * 10000 + 100000, 0), F.lit('"')))
    )
    body = n.select("r", "k", line.alias("line")).groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\r\n\r\n").alias("b"))
    return body.select(F.concat(F.lit("export"), F.col("r").cast("string")).alias("file"), F.concat(F.lit("MLS #,Stat,List Price\r\n"), F.col("b"), F.lit("\r\n")).alias("content"))


_FILES = "N AS (SELECT 'export' || c_custkey // 100 AS file, c_custkey k, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) i FROM customer)"


@query(f"WITH {_FILES} SELECT file, CAST(1 AS BIGINT) rec_no, CAST(1 AS BIGINT) line, CAST(3 AS BIGINT) n_fields FROM N GROUP BY file UNION ALL SELECT file, i + 1, 2 * i, CASE WHEN k % 5 = 3 THEN 2 ELSE 3 END FROM N")
def split_records(spark, sf_dir):
    from marketlens.sources import exports

    return exports.records(_files(spark, sf_dir)).select("file", F.col("rec_no").cast("bigint").alias("rec_no"), F.col("line").cast("bigint").alias("line"), F.size("fields").cast("bigint").alias("n_fields"))


@query(
    f"""WITH {_FILES} SELECT file, 2 * i AS line, CASE WHEN k % 5 = 3 THEN 'malformed' WHEN k % 5 = 4 THEN 'empty' ELSE 'row' END kind, CASE WHEN k % 5 < 3 THEN CAST(k AS VARCHAR) END mls,
 CASE WHEN k % 5 < 3 THEN CAST(k % 2000 * 10000 + 100000 AS BIGINT) END list_price, CASE WHEN k % 5 = 3 THEN 'malformed' END reject FROM N"""
)
def malformed_rows(spark, sf_dir):
    from marketlens.sources import exports

    rows = exports.listings(exports.records(_files(spark, sf_dir)))
    return rows.select("file", F.col("line").cast("bigint").alias("line"), "kind", "mls", "list_price", "reject")


@query(
    f"""WITH {_FILES} SELECT file, count(*) placed, count(*) FILTER (WHERE k % 5 = 4) empty, count(*) FILTER (WHERE k % 5 = 3) malformed, true accounted, CAST(CASE WHEN count(*) FILTER (WHERE k % 5 = 3) > 0 THEN 1 ELSE 0 END AS BIGINT) errors, count(*) FILTER (WHERE k % 5 = 4) dropped
FROM N GROUP BY 1"""
)
def file_reviews(spark, sf_dir):
    from marketlens.sources import exports

    return exports.reviews(exports.records(_files(spark, sf_dir))).select("file", "placed", "empty", "malformed", "accounted", "errors", "dropped")


_LINE_LIST = "CASE WHEN len({0}) = 1 THEN 'line ' || {0}[1] WHEN len({0}) <= 8 THEN 'lines ' || array_to_string({0}[1:len({0}) - 1], ', ') || ' and ' || {0}[-1] ELSE 'lines ' || array_to_string({0}[1:8], ', ') || ' and ' || (len({0}) - 8) || ' more' END"


@query(
    f"""WITH {_FILES}, G AS (SELECT file, list(CAST(2 * i AS VARCHAR) ORDER BY i) FILTER (WHERE k % 5 = 3) bad, count(*) FILTER (WHERE k % 5 = 4) empty FROM N GROUP BY 1),
X AS (SELECT file, list_filter([{{'level': 'warn', 'text': 'The file has no "Sold Pr" or "Close Price" column, so closed sales cannot be priced. The list price is not substituted.'}}, {{'level': 'info', 'text': 'The file has no "Orig List Pr" or "Original List Price" column, so no sale-to-list ratios could be computed.'}},
 {{'level': 'info', 'text': 'The file has no "MT" or "DOM" column, so no median days on market could be computed. (CDOM is not used: cumulative days on market survives a relisting, so it is a different number.)'}},
 CASE WHEN len(bad) > 0 THEN {{'level': 'error', 'text': len(bad) || ' record(s) do not have the header''s 3 columns (' || {_LINE_LIST.format('bad')} || '), so their values may sit under the wrong headings and none of them was used. They are listed below with no status — fix the export, or enter them by hand.'}} END,
 CASE WHEN empty > 0 THEN {{'level': 'info', 'text': empty || ' record(s) had every field empty and were not treated as listings.'}} END], lambda x: x IS NOT NULL) n FROM G)
SELECT file, i - 1 seq, n[i].level AS level, n[i].text AS text FROM X, range(1, 6) r(i) WHERE i <= len(n)"""
)
def export_notices(spark, sf_dir):
    from marketlens.sources import exports

    return exports.notices(exports.records(_files(spark, sf_dir)))


@query(
    f"""WITH {_FILES}, X AS (SELECT count(*) n, count(DISTINCT file) f, count(*) FILTER (WHERE k % 5 < 3) r, count(*) FILTER (WHERE k % 5 = 3) m, count(*) FILTER (WHERE k % 5 = 4) e FROM N)
SELECT seq, stage, figure, CAST(value AS BIGINT) AS value FROM X, LATERAL (VALUES (0, 'records', 'records', n + f), (0, 'records', 'unreadable', 0), (1, 'listings', 'rows', r), (1, 'listings', 'malformed', m), (1, 'listings', 'empty', e), (1, 'listings', 'refused', 0),
 (2, 'placed', 'counted', r), (2, 'placed', 'unresolved', m), (2, 'placed', 'priced', r)) v(seq, stage, figure, value)"""
)
def diagnostics(spark, sf_dir):
    """What each stage of reading exports had in hand, counted by the jobs that placed the rows."""
    from marketlens.operators.diagnostics import Diagnostics
    from marketlens.sources import exports

    d, kind = Diagnostics(), F.col("kind")
    recs = settled(d.watch(exports.records(_files(spark, sf_dir)), "records", records=F.count("*"), unreadable=F.count("error")))
    rows = d.watch(exports.listings(recs), "listings", rows=F.count_if(kind == "row"), malformed=F.count_if(kind == "malformed"), empty=F.count_if(kind == "empty"), refused=F.coalesce(F.sum(F.size("refused")), F.lit(0)))
    done = market.placed(rows.where("kind <> 'empty'"))
    unresolved = F.col("placement") == "unresolved"
    settled(d.watch(done, "placed", counted=F.count_if(~unresolved), unresolved=F.count_if(unresolved), priced=F.count("price")).select("file", "line", "placement", "price"))
    return d.figures(spark)


@query(
    """WITH X AS (SELECT p_partkey, p_name || CASE p_size % 7 WHEN 0 THEN '.csv' WHEN 1 THEN '.TSV' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.png' WHEN 4 THEN '.XLS' ELSE '' END name, CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/CSV' WHEN 2 THEN '' END mime FROM part)
SELECT p_partkey, CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN lower(name) LIKE '%.csv' OR lower(name) LIKE '%.tsv' OR lower(mime) = 'text/csv' THEN 'table' END route,
 CASE WHEN coalesce(mime, '') LIKE 'image/%' OR lower(name) LIKE '%.csv' OR lower(name) LIKE '%.tsv' OR lower(coalesce(mime, '')) = 'text/csv' THEN NULL WHEN lower(name) LIKE '%.xls' OR lower(name) LIKE '%.xlsx' THEN 'An Excel workbook cannot be read directly. Save it as CSV (or export the search as CSV or TSV) and drop that in instead.'
 ELSE 'That is neither a screenshot nor an export. Paste a PNG or JPG screenshot, or drop in a .csv or .tsv file.' END refusal FROM X"""
)
def file_routes(spark, sf_dir):
    from marketlens.sources import exports

    size, k = F.col("p_size") % 7, F.col("p_partkey") % 4
    end = F.when(size == 0, ".csv").when(size == 1, ".TSV").when(size == 2, ".xlsx").when(size == 3, ".png").when(size == 4, ".XLS").otherwise("")
    files = _table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", end).alias("name"), F.when(k == 0, "image/png").when(k == 1, "text/CSV").when(k == 2, "").alias("mime"))
    return exports.routed(files).select("p_partkey", "route", "refusal")


@query(
    """WITH X AS (SELECT p_brand, p_partkey, CASE WHEN p_brand LIKE '%1' THEN '5' ELSE '' END || CAST(CAST(floor(p_retailprice * CASE WHEN p_brand LIKE '%2' THEN 100 WHEN p_brand LIKE '%3' THEN 10 ELSE 1000 END) AS BIGINT) AS VARCHAR) d, CASE WHEN p_brand LIKE '%4' THEN 3 ELSE 2 END k FROM part),
Y AS (SELECT *, (length(d) - 1) // 3 c FROM X), Z AS (SELECT *, CASE WHEN k = 3 THEN (length(d) - 2) // 3 ELSE c END commas FROM Y), G AS (SELECT p_brand, count(*) n, avg(CAST(commas > 0 AS INT)) w, avg(CAST(commas = (length(d) - 1) // 3 AS INT)) keep, avg(CAST(commas = (length(d) - 2) // 3 AS INT)) drp FROM Z WHERE length(d) >= 3 GROUP BY 1),
V AS (SELECT p_brand, CASE WHEN n < 2 OR w < 0.9 THEN 'keep' WHEN drp >= 0.9 AND drp > keep + 0.15 THEN 'drop' WHEN keep >= 0.9 AND keep > drp + 0.15 THEN 'keep' WHEN keep < 0.9 OR drp < 0.9 THEN 'keep' ELSE 'magnitude' END verdict FROM G),
S AS (SELECT p_brand, list(CAST(d AS BIGINT) ORDER BY CAST(d AS BIGINT)) a, list(CAST(d[2:] AS BIGINT) ORDER BY CAST(d[2:] AS BIGINT)) b FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) r FROM Z) WHERE r <= 8 GROUP BY 1)
SELECT p_brand, verdict, a[len(a) // 2 + 1] kept, b[len(b) // 2 + 1] dropped, CASE verdict WHEN 'magnitude' THEN b[len(b) // 2 + 1] BETWEEN 20000 AND 20000000 AND NOT a[len(a) // 2 + 1] BETWEEN 20000 AND 20000000 ELSE verdict = 'drop' END is_prefix FROM V JOIN S USING (p_brand)"""
)
def currency_prefix(spark, sf_dir):
    """Price columns whose first glyph may be a currency mark that was read as a digit, by separators and by magnitude."""
    brand = F.col("p_brand")
    times = F.when(brand.endswith("2"), 100).when(brand.endswith("3"), 10).otherwise(1000)
    digits = F.concat(F.when(brand.endswith("1"), "5").otherwise(""), F.floor(F.col("p_retailprice") * times).cast("bigint").cast("string"))
    rows = _table(spark, sf_dir, "part").select("p_brand", "p_partkey", digits.alias("digits"))
    short = F.when(brand.endswith("4"), 2).otherwise(1)
    return recognition.currency_prefix(rows.withColumn("commas", F.floor((F.length("digits") - short) / 3)), "p_brand", "p_partkey", "digits", "commas")


_MONEY = "CASE WHEN {0} IS NULL THEN '—' ELSE '$' || format('{{:,}}', {0}) END"


def _field(seq, grp, label, bucket, figure, unit, money=False, days=False):
    show = _MONEY.format(figure) if money else f"CASE WHEN {figure} IS NULL THEN '—' ELSE format('{{:,}}', {figure}) END" if days else f"CAST({figure} AS VARCHAR)"
    named = f"CASE WHEN {figure} = 1 THEN '{unit[:-1]}' ELSE '{unit}' END" if unit in ("listings", "sales") else f"'{unit}'" if unit else "CAST(NULL AS VARCHAR)"
    return f"SELECT {seq} seq, '{grp}' grp, '{label}' AS label, CAST({figure} AS VARCHAR) AS value, {show} display, {named} unit FROM S WHERE bucket = '{bucket}'"


_FORM = " UNION ALL ".join(_field(i, g, lab, b, f, u, u is None, u == "days") for i, (g, lab, b, f, u) in enumerate(report.FORM))


@query(f"{L}, {_SUMMARY} {_FORM}")
def form_fields(spark, sf_dir):
    return report.form_fields(market.bucket_summary(_placed_once(spark, sf_dir)))


@query(
    f"""{L}, {_SUMMARY}, U AS (SELECT count(*) u FROM P WHERE placement = 'unresolved')
SELECT CASE bucket WHEN 'active' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END seq, CASE bucket WHEN 'active' THEN 'Active listings' WHEN 'pending' THEN 'Pending sales' ELSE 'Closed sales' END category, CAST(n_rows AS VARCHAR) n_rows, CAST(priced AS VARCHAR) priced,
 coalesce(CAST(low AS VARCHAR), '') low, coalesce(CAST(high AS VARCHAR), '') high, coalesce(CAST(median_price AS VARCHAR), '') median, coalesce(CAST(dom_median AS VARCHAR), '') median_dom, CASE WHEN dom_rows > 0 THEN CAST(dom_rows AS VARCHAR) ELSE '' END dom_rows,
 CASE WHEN ratio_rows > 0 THEN format('{{:.3f}}', ratio_low * 100) || '%' ELSE '' END ratio_low, CASE WHEN ratio_rows > 0 THEN format('{{:.3f}}', ratio_high * 100) || '%' ELSE '' END ratio_high, CASE WHEN ratio_rows > 0 THEN format('{{:.3f}}', ratio_median * 100) || '%' ELSE '' END ratio_median
FROM S WHERE bucket IN ('active', 'pending', 'closed')
UNION ALL SELECT 4, 'Not counted', CAST(n_rows AS VARCHAR), '', '', '', '', '', '', '', '', '' FROM S WHERE bucket = 'excluded'
UNION ALL SELECT 5, 'Unreadable', CAST(u AS VARCHAR), '', '', '', '', '', '', '', '', '' FROM U"""
)
def bucket_tsv(spark, sf_dir):
    rows = _placed_once(spark, sf_dir)
    return report.bucket_table(market.bucket_summary(rows), rows.agg(F.count_if(F.col("placement") == "unresolved").alias("unresolved")))


@query(
    f"""{L} SELECT n, mls, coalesce(status, '') status, CASE placement WHEN 'omitted' THEN 'skipped' WHEN 'unresolved' THEN 'unread' ELSE placement END category, coalesce(CAST(orig_price AS VARCHAR), '') orig_list, CAST(list_price AS VARCHAR) list_price,
 coalesce(CAST(sold_price AS VARCHAR), '') sold_price, coalesce(CAST(concessions AS VARCHAR), '') concessions, coalesce(CAST(market_time AS VARCHAR), '') mt, coalesce(CAST(price AS VARCHAR), '') counted, coalesce(format('{{:.3f}}', ratio * 100) || '%', '') sale_list FROM P"""
)
def row_tsv(spark, sf_dir):
    return report.row_table(_placed(spark, sf_dir))


def _ratio_text(c):
    return f"format('{{:.3f}}', {c} * 100) || '%'"


def _lines_sql(by: str = "") -> str:
    """CTEs that end in T (by, seq, line): the report's lines, from P (rows) per ``by``, with its bucket summary in S."""
    k, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    using = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    miss = lambda b: f"count(*) FILTER (WHERE placement = '{b}' AND price IS NULL) p_{b}"
    return f"""A AS (SELECT {k}count(*) n_all, count(*) FILTER (WHERE placement = 'unresolved') u, count(*) FILTER (WHERE placement = 'omitted') o, count(*) FILTER (WHERE placement = 'excluded') e, count(*) FILTER (WHERE placement = 'unclassified') x,
 {miss('active')}, {miss('pending')}, {miss('closed')}, count(*) FILTER (WHERE placement = 'active' AND coalesce(market_time < 0, true)) d FROM P {group}),
B AS (SELECT {k}list_filter([CASE WHEN u > 0 THEN u || ' of ' || n_all || ' row(s) have no readable status' END, CASE WHEN x > 0 THEN x || ' row(s) carry an unrecognized status code' END,
 CASE WHEN p_active > 0 THEN p_active || ' active row(s) have no readable price' END, CASE WHEN p_pending > 0 THEN p_pending || ' pending row(s) have no readable price' END, CASE WHEN p_closed > 0 THEN p_closed || ' closed row(s) have no readable price' END,
 CASE WHEN d > 0 THEN d || ' active row(s) have no market time' END], lambda r: r IS NOT NULL) r FROM A),
B2 AS (SELECT {k}['*** PROVISIONAL — do not use without checking: ***'] || list_transform(r, lambda y: '***   • ' || y) || [''] r FROM B WHERE len(r) > 0),
Q AS (SELECT *, CASE bucket WHEN 'active' THEN 100 WHEN 'pending' THEN 200 ELSE 300 END base, CASE bucket WHEN 'active' THEN 'Active listings' WHEN 'pending' THEN 'Pending sales' ELSE 'Closed sales' END lab FROM S WHERE bucket IN ('active', 'pending', 'closed')),
M AS (SELECT {k}price, ratio, row_number() OVER ({p}ORDER BY n) c, count(*) OVER ({p.strip()}) n_c, count(ratio) OVER ({p.strip()}) n_r FROM P WHERE placement = 'closed'),
T AS (SELECT {k}base seq, CASE WHEN n_rows = 0 THEN lab || ': 0' ELSE lab || ': ' || n_rows || '   Low ' || {_MONEY.format('low')} || '   High ' || {_MONEY.format('high')} || '   Median ' || {_MONEY.format('median_price')} || CASE WHEN missing > 0 THEN '   (' || priced || ' of ' || n_rows || ' priced)' ELSE '' END END AS line FROM Q
UNION ALL SELECT {k}base + 1, '   Median days on market: ' || format('{{:,}}', dom_median) || CASE WHEN dom_rows < n_rows THEN '   (' || dom_rows || ' of ' || n_rows || ' rows carried a market time)' ELSE '' END FROM Q WHERE dom_rows > 0
UNION ALL SELECT {k}base + 2, '   Sale/list ratio, net of concessions: Low ' || {_ratio_text('ratio_low')} || '   High ' || {_ratio_text('ratio_high')} || '   Median ' || {_ratio_text('ratio_median')} || CASE WHEN ratio_rows < n_rows THEN '   (' || ratio_rows || ' of ' || n_rows || ' with an original list price)' ELSE '' END FROM Q WHERE bucket = 'closed' AND ratio_rows > 0
UNION ALL SELECT {k}310 + c, rpad('   Comp ' || c || ':', CAST(greatest(12, length('   Comp ' || c || ':')) AS INTEGER), ' ') || coalesce(' ' || {_ratio_text('ratio')}, ' —   (no original list price' || CASE WHEN price IS NULL THEN ' or sold price' ELSE '' END || ')') FROM M WHERE n_c <= 10 AND n_r > 0
UNION ALL SELECT {k}900, 'Not counted: ' || e FROM A WHERE e > 0 UNION ALL SELECT {k}901, 'Unrecognized status codes: ' || x FROM A WHERE x > 0 UNION ALL SELECT {k}902, 'Unreadable status: ' || u FROM A WHERE u > 0 UNION ALL SELECT {k}903, 'Manually excluded: ' || o FROM A WHERE o > 0
UNION ALL SELECT {k}910, '' FROM A UNION ALL SELECT {k}911, 'Prices: list price for active and pending, sold price for closed. Median of an even count is the mean of the two middle values. Ratio = (sold − concessions) ÷ original list price.' FROM A
UNION ALL SELECT {k}i - 1000, r[i] FROM B2, (SELECT unnest(range(1, 20)) i) WHERE i <= len(r))"""


@query(f"{L}, {_SUMMARY}, {_lines_sql()} SELECT string_agg(line, chr(10) ORDER BY seq) report FROM T")
def report_text(spark, sf_dir):
    rows = _placed_once(spark, sf_dir)
    return report.render("text", market.bucket_summary(rows), market.accounting(rows), market.gate(rows))


@query(
    f"""{L}, S AS (SELECT mls, bucket, {_SPINE} FROM (SELECT DISTINCT mls FROM P) CROSS JOIN {_BUCKETS} LEFT JOIN (SELECT mls, placement bucket, {_STATS} FROM P GROUP BY 1, 2) USING (mls, bucket)),
{_lines_sql('mls')} SELECT mls, string_agg(line, chr(10) ORDER BY seq) report FROM T GROUP BY 1"""
)
def report_by_key(spark, sf_dir):
    """A report for each listing number, with the lines of its comparables where it has few closed sales."""
    rows = _placed_once(spark, sf_dir)
    by = ["mls"]
    return report.report_text(report.report_lines(market.bucket_summary(rows, by), market.accounting(rows, by), market.gate(rows, by), market.comp_list(rows, by), by), by)


# Columns of a grid, one row per (order, column): list and orig are full, sold is there on closed rows, net tax is small.
_GRID = """G0 AS (SELECT n, placement = 'closed' AS closed, code IS NOT NULL known, list_price, orig_price, CASE WHEN placement = 'closed' THEN sold_price END sold_price, CASE WHEN placement = 'closed' AND n % 3 = 0 THEN CAST(round(concessions) AS BIGINT) END conc FROM P WHERE placement <> 'omitted'),
G AS (SELECT n, 'a_orig' AS col, orig_price AS value, closed FROM G0 UNION ALL SELECT n, 'b_list', list_price, closed FROM G0 UNION ALL SELECT n, 'c_sold', sold_price, closed FROM G0 UNION ALL SELECT n, 'd_conc', conc, closed FROM G0)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir).where("placement <> 'omitted'").withColumn("closed", F.col("placement") == "closed")
    only = lambda c: F.when(F.col("closed"), c)
    conc = F.when(F.col("n") % 3 == 0, F.round("concessions").cast("bigint"))
    columns = [("a_orig", F.col("orig_price")), ("b_list", F.col("list_price")), ("c_sold", only(F.col("sold_price"))), ("d_conc", only(conc))]
    return rows.select("n", "closed", F.inline(F.array(*[F.struct(F.lit(k).alias("col"), v.alias("value")) for k, v in columns])))


@query(
    f"""{L}, {_GRID}, V AS (SELECT col, count(*) n_rows, count(value) n_filled, count(*) FILTER (WHERE (value IS NOT NULL) = closed) agree, count(*) FILTER (WHERE value IS NULL AND NOT closed) blank_open,
 CAST(sum(CASE WHEN value IS NOT NULL AND NOT closed THEN -2 WHEN value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) weighted FROM G GROUP BY 1)
SELECT *, round(agree / n_rows, 6) agreement, n_filled / n_rows < 0.85 AND blank_open >= 3 AND agree / n_rows >= 0.9 is_sold FROM V"""
)
def fill_pattern_vote(spark, sf_dir):
    return recognition.fill_pattern(_grid(spark, sf_dir).withColumn("filled", F.col("value").isNotNull()))


@query(
    f"""{L}, {_GRID}, V AS (SELECT col, count(*) n_rows, count(value) parsed, CAST(round(median(value)) AS BIGINT) AS median FROM G GROUP BY 1)
SELECT *, coalesce(parsed >= 2 AND parsed / n_rows >= 0.6 AND median BETWEEN 20000 AND 20000000, false) is_money, parsed / n_rows >= 0.85 is_dense FROM V"""
)
def dense_columns(spark, sf_dir):
    return recognition.money_columns(_grid(spark, sf_dir))


@query(f"{L} SELECT count(*) FILTER (WHERE list_price > orig_price) list_higher, count(*) FILTER (WHERE list_price <> orig_price) decided, count(*) FILTER (WHERE list_price <> orig_price) >= 3 AND count(*) FILTER (WHERE list_price > orig_price) / count(*) FILTER (WHERE list_price <> orig_price) > 0.6 swap FROM L")
def orig_ge_list_swap(spark, sf_dir):
    return recognition.swap_check(listings(spark, sf_dir))


@query(
    f"""{L}, {_GRID}, V AS (SELECT count(*) FILTER (WHERE col = 'c_sold' AND (value IS NOT NULL) = closed) / count(*) FILTER (WHERE col = 'c_sold') a FROM G)
SELECT CASE WHEN a >= 0.9 THEN 'fill-pattern' END sold_method, 'header' list_method, CASE WHEN a >= 0.9 THEN 0.75 ELSE 0.2 END confidence FROM V"""
)
def confidence_floor(spark, sf_dir):
    fill = fill_pattern_vote(spark, sf_dir).where("col = 'c_sold'")
    sold = F.when(F.col("is_sold"), "fill-pattern")
    return fill.select(sold.alias("sold_method"), F.lit("header").alias("list_method"), recognition.confidence([F.lit("header"), sold], F.lit(0)).alias("confidence"))


@query(
    """WITH V AS (SELECT l_returnflag, CAST(round(CAST(l_extendedprice AS DECIMAL(12,2))) AS BIGINT) AS value, length(CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(12,2))) AS BIGINT) AS VARCHAR)) digits FROM lineitem),
T AS (SELECT l_returnflag, CAST(round(median(digits)) AS BIGINT) typical FROM V GROUP BY 1)
SELECT l_returnflag, value, digits, typical FROM V JOIN T USING (l_returnflag) WHERE typical - digits >= 2"""
)
def digit_length_outliers(spark, sf_dir):
    v = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice").cast("decimal(12,2)"), 0).cast("bigint").alias("value"))
    return recognition.digit_outliers(v, "l_returnflag", "value").select("l_returnflag", "value", F.col("digits").cast("bigint").alias("digits"), F.col("typical").cast("bigint").alias("typical"))


_COMMA = """WITH V AS (SELECT p_brand, length(CAST(CAST(floor(CAST(p_retailprice AS DECIMAL(12,2)) * 100) AS BIGINT) AS VARCHAR)) + CASE WHEN p_brand LIKE '%1' THEN 1 ELSE 0 END d,
 (length(CAST(CAST(floor(CAST(p_retailprice AS DECIMAL(12,2)) * 100) AS BIGINT) AS VARCHAR)) - 1) // 3 c FROM part),
G AS (SELECT p_brand, count(*) n_cells, avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END) w, avg(CASE WHEN c = (d - 1) // 3 THEN 1.0 ELSE 0.0 END) k, avg(CASE WHEN c = (d - 2) // 3 THEN 1.0 ELSE 0.0 END) x FROM V WHERE d >= 3 GROUP BY 1)
SELECT p_brand, n_cells, round(k, 6) keep, round(x, 6) dropped, CASE WHEN n_cells < 2 OR w < 0.9 THEN 'keep' WHEN x >= 0.9 AND x > k + 0.15 THEN 'drop' WHEN k >= 0.9 AND k > x + 0.15 THEN 'keep' WHEN k < 0.9 OR x < 0.9 THEN 'keep' ELSE 'magnitude' END verdict FROM G"""


@query(_COMMA)
def comma_vote(spark, sf_dir):
    digits = F.length(F.floor(F.col("p_retailprice").cast("decimal(12,2)") * 100).cast("bigint").cast("string"))
    cells_ = _table(spark, sf_dir, "part").select("p_brand", (digits + F.when(F.col("p_brand").endswith("1"), 1).otherwise(0)).alias("digits"), F.floor((digits - 1) / 3).alias("commas"))
    return recognition.prefix_vote(cells_, "p_brand", "digits", "commas").select("p_brand", "n_cells", F.round("keep", 6).alias("keep"), F.round("dropped", 6).alias("dropped"), "verdict")


_PRICE_TEXT = "format('{:,.2f}', p_retailprice * p_size * 10)"


@query(
    f"""WITH X AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN t[1:len(t) - 1] WHEN 1 THEN t[1:len(t) - 3] WHEN 2 THEN t[1:len(t) - 4] WHEN 3 THEN replace(t, ',', '') WHEN 4 THEN t || '5' ELSE t END t FROM (SELECT p_partkey, p_size, {_PRICE_TEXT} t FROM part)),
Y AS (SELECT *, list_transform(string_split_regex(t, '[.,]'), lambda x: len(x)) p FROM X), Z AS (SELECT *, CASE WHEN len(p) > 1 AND p[-1] IN (1, 2) THEN p[-1] ELSE 0 END f FROM Y),
W AS (SELECT *, CASE WHEN f > 0 THEN p[1:len(p) - 1] ELSE p END g FROM Z), E AS (SELECT *, len(list_filter(g[2:], lambda x: x % 3 <> 0)) = 0 AND (len(g) = 1 OR g[-1] > 0) ok FROM W)
SELECT p_partkey, t AS token, CAST(CASE WHEN ok THEN len(g) - 1 END AS INT) commas, CAST(CASE WHEN ok THEN f END AS INT) fraction FROM E"""
)
def numeric_marks(spark, sf_dir):
    """Prices as tokens, whole or with characters lost or gained at the end: marks by where they stand among the digits."""
    text = F.format_number(F.col("p_retailprice") * F.col("p_size") * 10, 2)
    size, n = F.col("p_size") % 6, F.length(text)
    cut = lambda k: F.substring(text, F.lit(1), n - k)
    token = F.when(size == 0, cut(1)).when(size == 1, cut(3)).when(size == 2, cut(4)).when(size == 3, F.replace(text, F.lit(","), F.lit(""))).when(size == 4, F.concat(text, F.lit("5"))).otherwise(text)
    t = _table(spark, sf_dir, "part").select("p_partkey", token.alias("token")).withColumn("at", F.sequence(F.lit(1), F.length("token")))
    is_digit = lambda i: F.substring(F.col("token"), i, F.lit(1)).between("0", "9")
    m = recognition.marks(F.filter("at", is_digit), F.filter("at", lambda i: ~is_digit(i)))
    return t.select("p_partkey", "token", m.alias("m")).select("p_partkey", "token", "m.commas", "m.fraction")


_BANK = "B AS (SELECT label, list(x ORDER BY i) tpl FROM (SELECT label, i, CAST(avg(CAST(embedding[i] AS DECIMAL(12,8))) AS DOUBLE) x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {_BANK} SELECT label, i, round(tpl[i], 6) x FROM B, range(1, 65) r(i)")
def template_bank(spark, sf_dir):
    bank = recognition.template_bank(_table(spark, sf_dir, "embeddings"))
    return bank.select("label", F.posexplode("template").alias("i", "x")).select("label", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))


_RANK = f"""WITH {_BANK}, N AS (SELECT vec_id, e.label own, B.label label, round(corr(CAST(embedding[i] AS DOUBLE), tpl[i]), 9) s FROM embeddings e, B, range(1, 65) r(i) GROUP BY ALL),
K AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) r FROM N),
R AS (SELECT a.vec_id, a.own AS label, a.label top, a.s score, b.label AS second, a.s - b.s margin FROM K a JOIN K b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return recognition.rank(e, recognition.template_bank(e))


@query(f"{_RANK} SELECT vec_id, label, top, round(score, 6) score, second, round(margin, 6) margin FROM R")
def ncc_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("vec_id", "label", "top", F.round("score", 6).alias("score"), "second", F.round("margin", 6).alias("margin"))


_PAIRS = ", ".join(f"({a}, {b}), ({b}, {a})" for a, b in recognition.CONFUSABLE)


@query(f"{_RANK} SELECT CASE WHEN score < 0.35 THEN 'score' WHEN margin < 0.02 THEN 'margin' WHEN (top, second) IN ({_PAIRS}) AND margin < 0.05 THEN 'confusable' END reason, count(*) n_rows FROM R GROUP BY 1")
def ambiguity_guard(spark, sf_dir):
    return _ranked(spark, sf_dir).groupBy(recognition.ambiguity(F.col("top"), F.col("second"), F.col("score"), F.col("margin")).alias("reason")).agg(F.count("*").alias("n_rows"))


@query(
    f"""{_RANK}, V AS (SELECT own, label, sum(0.75 * s + 0.25) / count(DISTINCT vec_id) m, sum(s) / count(DISTINCT vec_id) h, count(DISTINCT vec_id) voters FROM (SELECT N.*, N.s FROM N) GROUP BY 1, 2),
O AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY round(m, 9) DESC, label) r FROM V)
SELECT a.own AS cluster, a.voters, a.label top, round(a.m, 6) score, round(round(a.m, 9) - round(b.m, 9), 6) margin, CASE WHEN round(a.h, 9) < 0.5 THEN 'shape' WHEN a.m < 0.55 THEN 'score' WHEN round(a.m, 9) - round(b.m, 9) < 0.05 THEN 'margin' END reject
FROM O a JOIN O b ON a.own = b.own AND a.r = 1 AND b.r = 2"""
)
def cluster_vote(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    scored = recognition.scores(e, recognition.template_bank(e))
    ranked = scored.select(F.col("label").alias("cluster"), "vec_id", F.explode("scores").alias("s")).select("cluster", "vec_id", F.col("s.label").alias("candidate"), F.col("s.shape").alias("shape"), (F.col("s.shape") * 0.75 + 0.25).alias("combined"))
    return recognition.votes(ranked, "cluster", "vec_id", "candidate", "combined", "shape")


@query(
    """WITH D AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 86400000000 THEN 1 ELSE 0 END opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
I AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) island FROM D)
SELECT user_id, CAST(island AS BIGINT) island, count(*) n_events, epoch_us(min(ts)) first_us, epoch_us(max(ts)) last_us FROM I GROUP BY 1, 2"""
)
def token_islands(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return recognition.islands(e, "user_id", "us", 86_400_000_000, ["event_id"]).groupBy("user_id", "island").agg(F.count("*").alias("n_events"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(
    """WITH A AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) * 100 + l_linenumber label_id, l_orderkey k, CAST(l_quantity AS BIGINT) * 10 + l_linenumber x0, CAST(l_quantity AS BIGINT) * 10 + l_linenumber + 25 x1 FROM lineitem),
B AS (SELECT p_partkey col_id, p_partkey * 7 c0, p_partkey * 7 + 5 c1 FROM part),
M AS (SELECT label_id, col_id, abs((c0 + c1) / 2 - (x0 + x1) / 2) d FROM A JOIN B ON least(x1, c1) > greatest(x0, c0))
SELECT label_id, col_id, d distance FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY d, col_id) r FROM M) WHERE r = 1"""
)
def interval_overlap_nearest(spark, sf_dir):
    """Order lines as label intervals against parts as column intervals."""
    from pyspark.sql import Window as W

    li = _table(spark, sf_dir, "lineitem")
    r = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    x0 = F.col("l_quantity").cast("bigint") * 10 + F.col("l_linenumber")
    labels = li.select((F.col("l_orderkey") * 1000 + r * 100 + F.col("l_linenumber")).alias("label_id"), x0.alias("x0"), (x0 + 25).alias("x1"))
    cols = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("col_id"), (F.col("p_partkey") * 7).alias("c0"), (F.col("p_partkey") * 7 + 5).alias("c1"))
    return recognition.nearest_overlap(labels, cols, 50.0)


@query(
    """SELECT l_returnflag, l_linestatus, CAST(median(CAST(l_quantity AS BIGINT)) AS DOUBLE) mid_median, list(CAST(l_quantity AS BIGINT) ORDER BY l_quantity)[count(*) // 2 + 1] upper_median FROM lineitem GROUP BY 1, 2"""
)
def upper_median(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("v"))
    found = recognition.upper_medians(rows, ["l_returnflag", "l_linestatus"], "v")
    return found.select("l_returnflag", "l_linestatus", ((F.col("lower") + F.col("upper")) / 2).alias("mid_median"), F.col("upper").alias("upper_median"))


@query(
    """WITH H AS (SELECT CAST(p_size AS BIGINT) t, count(*) n FROM part GROUP BY 1), R AS (SELECT t, sum(n) OVER (ORDER BY t) w, sum(t * n) OVER (ORDER BY t) s, sum(n) OVER () a, sum(t * n) OVER () z FROM H),
V AS (SELECT t, round(CAST(w AS DOUBLE) * (a - w) * pow(s / w - (z - s) / (a - w), 2), 3) v FROM R WHERE w < a)
SELECT min(t) FILTER (WHERE v = m) threshold, max(v) variance FROM V, (SELECT max(v) m FROM V)"""
)
def otsu(spark, sf_dir):
    return recognition.otsu(_table(spark, sf_dir, "part"), "p_size")


_INDEX = """SELECT '{0}' AS source, {1} AS grp, count({2}) AS read, count(DISTINCT {2}) n_distinct, CAST(min({2}) AS BIGINT) first_no, CAST(max({2}) AS BIGINT) last_no, count(*) n_rows,
 count({2}) >= 3 AND count({2}) >= 0.6 * count(*) AND count({2}) = count(DISTINCT {2}) AND max({2}) - min({2}) + 1 <= 1.5 * count({2}) + 3 is_index FROM {3} GROUP BY 2"""


@query(_INDEX.format("lines", "l_orderkey", "l_linenumber", "lineitem") + " UNION ALL " + _INDEX.format("turns", "conv_id", "turn", "conversations"))
def index_column_check(spark, sf_dir):
    a = recognition.index_column(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").withColumnRenamed("l_orderkey", "grp").withColumn("source", F.lit("lines"))
    b = recognition.index_column(_table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumnRenamed("conv_id", "grp").withColumn("source", F.lit("turns"))
    return a.unionByName(b)


@query(f"{L} SELECT count(status) status, count(mls) mls, count(list_price) AS list, count(orig_price) orig, count(sold_price) sold, count(concessions) conc, count(market_time) mt FROM L")
def value_counts_by_role(spark, sf_dir):
    from marketlens.sources import exports

    rows = listings(spark, sf_dir).withColumns({"kind": F.lit("row"), "file": F.lit("orders")})
    return exports.value_counts(rows).drop("file")


@query("WITH B AS (SELECT DISTINCT p_brand code FROM part), X AS (SELECT a.code, b.code other, i FROM B a, B b, range(1, 9) r(i) WHERE length(a.code) = length(b.code) AND a.code[i] <> b.code[i]), N AS (SELECT code, other, min(i) place FROM X GROUP BY 1, 2 HAVING count(*) = 1) SELECT code, place, other[place] rival FROM N")
def kickout_rivals(spark, sf_dir):
    """Codes (here the brands) that one letter turns into another."""
    return recognition.kickout_rivals(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("code")).distinct())


@query("SELECT CAST(list(q ORDER BY q)[CAST(floor(count(*) * 0.65) AS BIGINT) + 1] AS BIGINT) AS value, count(*) n_all FROM (SELECT CAST(l_quantity AS BIGINT) q FROM lineitem)")
def index_percentile(spark, sf_dir):
    hist = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("bigint").alias("q")).agg(F.count("*").alias("n"))
    return recognition.index_percentile(hist, "q", "n", 0.65)


@query(
    """WITH E AS (SELECT user_id, event_id, epoch_us(ts) a FROM events), G AS (SELECT user_id, lead(a) OVER (PARTITION BY user_id ORDER BY a, event_id) - a gap, a FROM E)
SELECT user_id, gap, a AS after FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, a) r FROM G WHERE gap > 0) WHERE r = 1"""
)
def widest_gap(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"))
    return recognition.widest_gaps(e.withColumn("b", F.col("a")), "user_id", "a", "b", ["event_id"])


@query(f"{L}, M AS (SELECT code, count(*) n_rows FROM C WHERE code IS NOT NULL GROUP BY 1) SELECT row_number() OVER (ORDER BY n_rows IS NULL, code) pos, code, vbucket bucket, coalesce(n_rows, 0) n_rows FROM vocab LEFT JOIN M USING (code)")
def mapping_grid(spark, sf_dir):
    """The mapping editor's rows: codes that are present first, then by code."""
    from pyspark.sql import Window as W

    rows = status_table(spark).join(market.present_codes(listings(spark, sf_dir)), "code", "left")
    pos = F.row_number().over(W.orderBy(F.col("n_rows").isNull(), "code")).cast("bigint")  # a row per vocabulary code
    return rows.select(pos.alias("pos"), "code", "bucket", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
