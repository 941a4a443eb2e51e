"""Further catalogue queries: the form as text, row numbers, column roles and the recognition steps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import cells
from marketlens.functions.vocab import HEADER_VOCABULARY
from marketlens.operators import glyphs, grids, market, pixels, placing, recognition, report
from marketlens.plans.catalogue import _BANK, _RANK, _SUMMARY, L, _lines_sql, _placed, _placed_once, _ranked, _table, query

_FORM_ROWS = """V AS (SELECT max(n_rows) FILTER (WHERE bucket = 'active') an, max(dom_median) FILTER (WHERE bucket = 'active') ad, max(dom_rows) FILTER (WHERE bucket = 'active') ar, max(low) FILTER (WHERE bucket = 'active') al, max(median_price) FILTER (WHERE bucket = 'active') am, max(high) FILTER (WHERE bucket = 'active') ah,
 max(n_rows) FILTER (WHERE bucket = 'closed') cn, max(low) FILTER (WHERE bucket = 'closed') cl, max(median_price) FILTER (WHERE bucket = 'closed') cm, max(high) FILTER (WHERE bucket = 'closed') ch, max(dom_rows) FILTER (WHERE bucket = 'closed') cr, max(dom_median) FILTER (WHERE bucket = 'closed') cd, max(n_rows) FILTER (WHERE bucket = 'pending') pn FROM S)"""


def _form_line(label, value, unit=None):
    one = f"CASE WHEN {value} = 1 THEN ' {unit[:-1]}' ELSE ' {unit}' END" if unit in ("listings", "sales") else f"' {unit}'" if unit else "''"
    return f"'  ' || rpad('{label} ', 26, '.') || ' ' || coalesce({value} || {one}, '—')"


_FORM_TEXT = f"""{L}, {_SUMMARY}, {_lines_sql()}, {_FORM_ROWS},
F AS (SELECT unnest(coalesce((SELECT r FROM B2), []) || ['Search Result Metrics', '', 'Active Listings', {_form_line('Active Listings', 'an', 'listings')}, {_form_line('Median Days on Market', 'ad', 'days')}, {_form_line('Lowest List Price', 'al')},
 {_form_line('Median List Price', 'am')}, {_form_line('Highest List Price', 'ah')}, '', 'Sales Within Lookback Period', {_form_line('Sales in Lookback Period', 'cn', 'sales')}, {_form_line('Lowest Sale Price', 'cl')}, {_form_line('Median Sale Price', 'cm')}, {_form_line('Highest Sale Price', 'ch')},
 '', 'Pending Sales', {_form_line('Pending Sales', 'pn', 'sales')}, '', 'Prices are bare numbers — the form supplies the $ and the commas. Days on market is the median MT of the active listings.']) AS line FROM V)
SELECT string_agg(line, chr(10)) report FROM F"""


@query(_FORM_TEXT)
def form_text(spark, sf_dir):
    rows = _placed_once(spark, sf_dir)
    return report.render("form", market.bucket_summary(rows), market.accounting(rows), market.gate(rows))


@query(
    f"""{L}, {_SUMMARY}, {_FORM_ROWS} SELECT CASE WHEN an = 0 THEN 'No active listings in this search.' WHEN ar = 0 THEN 'No market time was read for the active listings.' WHEN ar < an THEN 'Rests on ' || ar || ' of ' || an || ' active listings.'
 ELSE 'Median MT of all ' || an || ' active listings.' || CASE WHEN cr > 0 THEN ' Closed sales: ' || format('{{:,}}', cd) || ' days' || CASE WHEN cr < cn THEN ' (' || cr || ' of ' || cn || ' sales)' ELSE '' END || '.' ELSE '' END END note FROM V"""
)
def form_days_note(spark, sf_dir):
    return report.days_note(market.bucket_summary(_placed_once(spark, sf_dir)))


@query(
    f"""{L}, R AS (SELECT mls, CASE placement WHEN 'closed' THEN 'closed' ELSE 'other' END s, n, price, ratio, row_number() OVER (PARTITION BY mls ORDER BY n) c, count(*) OVER (PARTITION BY mls) n_c, count(ratio) OVER (PARTITION BY mls) n_r FROM P WHERE placement = 'closed')
SELECT mls, c comp, rpad('   Comp ' || c || ':', CAST(greatest(12, length('   Comp ' || c || ':')) AS INTEGER), ' ') || coalesce(' ' || format('{{:.3f}}', ratio * 100) || '%', ' —   (no original list price' || CASE WHEN price IS NULL THEN ' or sold price' ELSE '' END || ')') AS line FROM R WHERE n_c <= 10 AND n_r > 0"""
)
def comp_line_text(spark, sf_dir):
    return report.comp_lines(market.comp_list(_placed(spark, sf_dir), ["mls"])).select("mls", F.col("comp").cast("bigint").alias("comp"), "line")


@query(
    """WITH N AS (SELECT l_orderkey k, l_linenumber + CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey % 4 ELSE 0 END v FROM lineitem), E AS (SELECT k, CAST(min(v) AS BIGINT) first_no, CAST(max(v) AS BIGINT) last_no FROM N GROUP BY 1),
R AS (SELECT k, CASE WHEN (k + v) % 7 <> 0 THEN v END v FROM N WHERE (k * 7 + v) % 5 <> 0), G AS (SELECT k, g FROM (SELECT k, unnest(range(first_no, last_no + 1)) g FROM E) WHERE (k, g) NOT IN (SELECT k, v FROM R WHERE v IS NOT NULL)),
H AS (SELECT k, count(*) gaps, array_to_string(list(g ORDER BY g)[1:12], ', ') || CASE WHEN count(*) > 12 THEN '…' ELSE '' END sample FROM G GROUP BY 1), U AS (SELECT k, count(*) FILTER (WHERE v IS NULL) unnumbered FROM R GROUP BY 1),
X AS (SELECT k, first_no, last_no, coalesce(gaps, 0) gaps, coalesce(unnumbered, 0) unnumbered, greatest(0, coalesce(gaps, 0) - coalesce(unnumbered, 0)) absent, sample, coalesce(lost, 0) lost FROM E LEFT JOIN H USING (k) LEFT JOIN U USING (k) LEFT JOIN (SELECT k, count(*) lost FROM N WHERE (k * 7 + v) % 5 = 0 AND k % 2 = 0 GROUP BY 1) USING (k)),
Y AS (SELECT *, CASE WHEN absent > 0 AND gaps = absent THEN '(' || sample || ') ' ELSE '' END listed FROM X)
SELECT k l_orderkey, first_no, last_no, gaps, unnumbered, absent, CASE WHEN absent > 0 AND gaps = absent THEN sample END sample, coalesce(array_to_string(list_filter([
 CASE WHEN absent > 0 THEN 'error: The grid numbers its rows ' || first_no || '–' || last_no || ', but ' || absent || ' of them ' || listed || 'are missing from the summary below. Those listings are not in any count.' END,
 CASE WHEN absent = 0 AND gaps > 0 THEN 'info: ' || gaps || ' row number(s) could not be read, but every row band was. No listing is missing.' END,
 CASE WHEN first_no > 1 THEN 'warn: The grid numbers its rows from ' || first_no || ', not 1. If this is the first page of your results, rows 1–' || (first_no - 1) || ' are above the top of the screenshot and are not in this summary.' END,
 CASE WHEN gaps = 0 AND first_no = 1 AND lost = 0 THEN 'ok: Row numbers 1–' || last_no || ' were all read — no rows were dropped.' END], lambda x: x IS NOT NULL), chr(10)), '') notices FROM Y"""
)
def row_number_check(spark, sf_dir):
    """A grid per order, numbered from one or from later on; some rows are lost, some numbers not read."""
    k = F.col("l_orderkey")
    numbers = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") + F.when(k % 3 == 0, k % 4).otherwise(0)).alias("number"))
    kept = (k * 7 + F.col("number")) % 5 != 0
    got = numbers.where(kept).withColumn("number", F.when((k + F.col("number")) % 7 != 0, F.col("number")))
    lost = numbers.where(~kept & (k % 2 == 0)).groupBy("l_orderkey").agg(F.count("*").alias("lost"))
    told = F.array_join(F.transform("notices", lambda x: F.concat_ws(": ", x["level"], x["text"])), "\n")
    return market.number_check(got, numbers, "l_orderkey", lost=lost).withColumn("notices", told)


@query(f"{L} SELECT L.n, L.mls, P.placement, P.price, round(P.ratio, 9) ratio FROM L LEFT JOIN P ON L.n = P.n AND P.placement NOT IN ('omitted', 'unresolved')")
def review_entries(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    listed = rows.select("n", "mls")
    return market.with_review(listed, rows.where(~F.col("placement").isin("omitted", "unresolved"))).withColumn("ratio", F.round("ratio", 9))


_ROLE_CELLS = """R AS (SELECT P.*, n_nationkey k FROM P JOIN customer ON custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE placement <> 'omitted'),
E0 AS (SELECT k, n, placement = 'closed' AS closed, unnest([{'col': 'a', 'x0': 10, 'kind': 'money', 'v': CASE WHEN k % 3 = 0 THEN list_price ELSE orig_price END}, {'col': 'b', 'x0': 20, 'kind': 'money', 'v': CASE WHEN k % 3 = 0 THEN orig_price ELSE list_price END},
 {'col': 'c', 'x0': 30, 'kind': 'money', 'v': CASE WHEN placement = 'closed' THEN CASE WHEN k % 5 = 1 THEN sold_price * 9 ELSE sold_price END END}, {'col': 'd', 'x0': 40, 'kind': 'integer', 'v': CASE WHEN placement = 'closed' AND n % 3 = 0 THEN CAST(round(concessions) AS BIGINT) END}, {'col': 'e', 'x0': 50, 'kind': 'integer', 'v': n % 9}]) x FROM R),
E AS (SELECT k, n, closed, x.col AS col, x.x0 x0, x.kind kind, x.v v FROM E0)"""


def _role_cells(spark, sf_dir):
    """A grid per nation: two full price columns (in either order), sold prices on closed rows (out of scale in some
    grids), concessions on some of them, and a full column of small numbers."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("k"))
    rows = _placed(spark, sf_dir).where("placement <> 'omitted'").join(c, "custkey").withColumn("closed", F.col("placement") == "closed")
    odd, k = F.col("k") % 3 == 0, F.col("k")
    only = lambda v: F.when(F.col("closed"), v)
    columns = [
        ("a", 10, "money", F.when(odd, F.col("list_price")).otherwise(F.col("orig_price"))), ("b", 20, "money", F.when(odd, F.col("orig_price")).otherwise(F.col("list_price"))),
        ("c", 30, "money", only(F.when(k % 5 == 1, F.col("sold_price") * 9).otherwise(F.col("sold_price")))), ("d", 40, "integer", only(F.when(F.col("n") % 3 == 0, F.round("concessions").cast("bigint")))), ("e", 50, "integer", F.col("n") % 9),
    ]
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(x).alias("x0"), F.lit(t).alias("kind"), v.alias("value")) for c, x, t, v in columns])
    return rows.select(k.cast("string").alias("grid"), F.col("n").alias("row"), "closed", F.inline(each))


@query(
    f"""{L}, {_ROLE_CELLS}, S AS (SELECT k, col, min(kind) kind, count(*) n, count(v) filled, count(*) FILTER (WHERE (v IS NOT NULL) = closed) agree, count(*) FILTER (WHERE v IS NULL AND NOT closed) blank, sum(CASE WHEN v IS NOT NULL AND NOT closed THEN -2 WHEN v IS NOT NULL THEN 1 ELSE 0 END) w, median(v) med, count(*) FILTER (WHERE closed) nc FROM E GROUP BY 1, 2),
G AS (SELECT k, bool_or(col = 'c' AND filled / n < 0.85 AND blank >= 3 AND agree / n >= 0.9 AND nc > 0 AND nc < n) fits, max(nc) nc, max(n) n, max(med) FILTER (WHERE col = 'a') ma, max(med) FILTER (WHERE col = 'b') mb, max(med) FILTER (WHERE col = 'c') mc FROM S GROUP BY 1),
W AS (SELECT k, count(*) FILTER (WHERE y > x) > 0.6 * count(*) FILTER (WHERE y <> x) AND count(*) FILTER (WHERE y <> x) >= 3 swap FROM (SELECT k, n, max(v) FILTER (WHERE col = 'a') x, max(v) FILTER (WHERE col = 'b') y FROM E GROUP BY 1, 2) GROUP BY 1),
D AS (SELECT k, bool_or(col = 'd' AND filled >= 2 AND filled / n < 0.85 AND blank >= 3 AND w > 0 AND med BETWEEN 0.002 * m AND 0.25 * m) conc FROM (SELECT S.*, CASE WHEN fits THEN mc ELSE mb END m FROM S JOIN G USING (k)) GROUP BY 1),
Z AS (SELECT k, fits, swap, conc, fits AND NOT mc / CASE WHEN swap THEN ma ELSE mb END BETWEEN 0.5 AND 1.5 apart, (NOT fits AND nc >= 3 AND nc < n) none_sold FROM G JOIN W USING (k) JOIN D USING (k))
SELECT CAST(k AS VARCHAR) grid, CASE WHEN swap THEN 'a' ELSE 'b' END AS list, CASE WHEN swap THEN 'b' ELSE 'a' END orig, CASE WHEN fits AND NOT apart THEN 'c' END sold, CASE WHEN conc THEN 'd' END conc, CASE WHEN fits AND NOT apart THEN 'fill-pattern' END sold_method, 'position' list_method,
 CAST(CAST(none_sold AS INT) + CAST(apart AS INT) AS BIGINT) problems, round(greatest(0.2, CASE WHEN fits AND NOT apart THEN 0.45 ELSE 0.2 END - 0.2 * (CAST(none_sold AS INT) + CAST(apart AS INT))), 6) confidence FROM Z"""
)
def role_assignment(spark, sf_dir):
    return recognition.assign_roles(_role_cells(spark, sf_dir)).withColumn("problems", F.col("problems").cast("bigint")).drop("problem_kinds")


@query(
    f"""{L}, {_ROLE_CELLS}, S AS (SELECT k, col, count(*) n, count(v) filled, count(*) FILTER (WHERE (v IS NOT NULL) = closed) agree, count(*) FILTER (WHERE v IS NULL AND NOT closed) blank, median(v) med, count(*) FILTER (WHERE closed) nc FROM E GROUP BY 1, 2),
G AS (SELECT k, k % 2 = 0 named, k % 4 = 1 sold_named, bool_or(col = 'c' AND filled / n < 0.85 AND blank >= 3 AND agree / n >= 0.9 AND nc > 0 AND nc < n) fits, max(nc) nc, max(n) n, max(med) FILTER (WHERE col = 'a') ma, max(med) FILTER (WHERE col = 'b') mb, max(med) FILTER (WHERE col = 'c') mc, max(med) FILTER (WHERE col = 'e') me FROM S GROUP BY 1),
W AS (SELECT k, count(*) FILTER (WHERE a > b) up, count(*) FILTER (WHERE b > a) down FROM (SELECT k, n, max(v) FILTER (WHERE col = 'a') a, max(v) FILTER (WHERE col = 'b') b FROM E GROUP BY 1, 2) GROUP BY 1),
A AS (SELECT k, named, CASE WHEN named THEN 'a' ELSE 'b' END first_list, up + down >= 3 AND CASE WHEN named THEN up ELSE down END / (up + down) > 0.6 swap, sold_named OR fits has_sold, sold_named, NOT sold_named AND NOT fits AND nc >= 3 AND nc < n none_sold, ma, mb, mc, me FROM G JOIN W USING (k)),
B AS (SELECT *, CASE WHEN swap THEN CASE first_list WHEN 'a' THEN 'b' ELSE 'a' END ELSE first_list END list, CASE WHEN swap = named THEN 'position' ELSE 'header' END list_method FROM A),
Z AS (SELECT *, CASE WHEN NOT named AND NOT swap THEN 'position' WHEN NOT named THEN 'position' ELSE list_method END method, has_sold AND NOT coalesce(mc / nullif(CASE list WHEN 'a' THEN ma ELSE mb END, 0), 0) BETWEEN 0.5 AND 1.5 apart, has_sold AND coalesce(me > 0.25 * mc, false) large FROM B)
SELECT CAST(k AS VARCHAR) grid, list, CASE list WHEN 'a' THEN 'b' ELSE 'a' END orig, CASE WHEN has_sold AND NOT apart THEN 'c' END sold, CASE WHEN NOT large THEN 'e' END conc, CASE WHEN NOT has_sold OR apart THEN NULL WHEN sold_named THEN 'header' ELSE 'fill-pattern' END sold_method, method list_method,
 CAST(CAST(none_sold AS INT) + CAST(apart AS INT) + CAST(large AS INT) AS BIGINT) problems, array_to_string(list_filter([CASE WHEN none_sold THEN 'none_sold' END, CASE WHEN apart THEN 'apart' END, CASE WHEN large THEN 'large' END], lambda x: x IS NOT NULL), ',') problem_kinds,
 round(greatest(0.2, least(0.95, CASE method WHEN 'header' THEN 0.95 ELSE 0.45 END, CASE WHEN NOT has_sold OR apart THEN 0.2 WHEN sold_named THEN 0.95 ELSE 0.75 END) - 0.2 * (CAST(none_sold AS INT) + CAST(apart AS INT) + CAST(large AS INT))), 6) confidence FROM Z"""
)
def role_assignment_named(spark, sf_dir):
    """As role_assignment, with headers that name the left price column as list price in every other grid, the sold column
    in some, and the full column of small numbers as concessions in all; checks can overturn what they name."""
    grid = F.col("grid").cast("int")
    cells_ = _role_cells(spark, sf_dir)
    grids = cells_.select("grid").distinct()
    named = lambda cond, role, col: F.when(cond, F.struct(F.lit(role).alias("role"), F.lit(col).alias("col")))
    header = grids.select("grid", F.inline(F.array_compact(F.array(named(grid % 2 == 0, "list", "a"), named(grid % 4 == 1, "sold", "c"), named(F.lit(True), "conc", "e")))))
    out = recognition.assign_roles(cells_, header)
    return out.withColumns({"problems": F.col("problems").cast("bigint"), "problem_kinds": F.array_join("problem_kinds", ",")})


_STATUS_CELLS = f"""{_RANK}, C AS (SELECT label grid, vec_id % 4 AS col, vec_id cell, vec_id % 4 = 1 AND vec_id % 7 <> 0 digits, score + 0.1 score, score shape, margin FROM R)"""


@query(
    f"""{_STATUS_CELLS}, O AS (SELECT *, row_number() OVER (PARTITION BY grid, col ORDER BY cell) - 1 i, count(*) OVER (PARTITION BY grid, col) n FROM C), J AS (SELECT grid, col, count(*) >= 2 AND avg(CAST(digits AS INT)) >= 0.75 num, max(n) n FROM O WHERE i % greatest(1, n // 8) = 0 AND i / greatest(1, n // 8) < 8 GROUP BY 1, 2),
S AS (SELECT grid, col, avg(CAST(score >= 0.55 AND shape >= 0.5 AND margin >= 0.05 AS INT)) r, coalesce(avg(score) FILTER (WHERE score >= 0.55 AND shape >= 0.5 AND margin >= 0.05), 0) m FROM O WHERE i % greatest(1, n // 12) = 0 AND i / greatest(1, n // 12) < 12 GROUP BY 1, 2),
T AS (SELECT grid, count(*) // 3 n_rows FROM C GROUP BY 1), X AS (SELECT grid, col, r, m, least(1.0, n / n_rows) v, grid % 2 = 0 AND col = 3 h FROM S JOIN J USING (grid, col) JOIN T USING (grid) WHERE n >= 2 AND (NOT num OR (grid % 2 = 0 AND col = 3))),
Y AS (SELECT *, round(0.5 * r + 0.3 * m + 0.2 * v + CASE WHEN h THEN 0.5 ELSE 0 END, 9) t FROM X)
SELECT CAST(grid AS BIGINT) grid, CAST(col AS BIGINT) AS col, round(r, 6) resolved, round(m, 6) mean, round(v, 6) coverage, round(t, 6) score, row_number() OVER (PARTITION BY grid ORDER BY h DESC, t DESC, col) = 1 AND r >= 0.55 chosen FROM Y"""
)
def status_column(spark, sf_dir):
    r = _ranked(spark, sf_dir).select(F.col("label").cast("bigint").alias("grid"), (F.col("vec_id") % 4).alias("col"), F.col("vec_id").alias("cell"), ((F.col("vec_id") % 4 == 1) & (F.col("vec_id") % 7 != 0)).alias("digits"), F.col("top").cast("string").alias("top"), F.col("second").cast("string").alias("second"), (F.col("score") + 0.1).alias("score"), F.col("score").alias("shape"), "margin")
    rows = r.groupBy("grid").agg(F.floor(F.count("*") / 3).alias("n_rows"))
    header = r.where("grid % 2 = 0 and col = 3").select("grid", "col")
    rounded = {c: F.round(c, 6) for c in ("resolved", "mean", "coverage", "score")}
    return recognition.status_columns(r, rows, header).withColumns(rounded)


@query(
    f"""{_RANK}, C AS (SELECT label, vec_id % 3 font, vec_id cell, score FROM R), O AS (SELECT *, row_number() OVER (PARTITION BY label, font ORDER BY cell) - 1 i, count(*) OVER (PARTITION BY label, font) n FROM C),
M AS (SELECT label, font, round(avg(score), 9) m FROM O WHERE i % greatest(1, n // 20) = 0 AND i / greatest(1, n // 20) < 20 GROUP BY 1, 2) SELECT label, font, round(m, 6) mean FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, font) r FROM M) WHERE r = 1"""
)
def font_choice(spark, sf_dir):
    r = _ranked(spark, sf_dir).select("label", (F.col("vec_id") % 3).alias("font"), F.col("vec_id").alias("cell"), "score")
    return recognition.pick_font(r, "label").withColumn("mean", F.round("mean", 6))


@query(
    """WITH X AS (SELECT l_suppkey, CAST(l_quantity AS INT) * 5 r, l_linenumber * 30 g, CAST(l_partkey % 256 AS INT) b FROM lineitem), Y AS (SELECT *, round(0.299 * r + 0.587 * g + 0.114 * b, 6) lum FROM X),
Q AS (SELECT l_suppkey, list(lum ORDER BY lum)[CAST(greatest(0, floor(count(*) * 0.25) - 1) AS BIGINT) + 1] cut FROM Y GROUP BY 1)
SELECT l_suppkey, CAST(floor(avg(r) + 0.5) AS INT) r, CAST(floor(avg(g) + 0.5) AS INT) g, CAST(floor(avg(b) + 0.5) AS INT) b FROM Y JOIN Q USING (l_suppkey) WHERE lum <= cut GROUP BY 1"""
)
def ink_colour(spark, sf_dir):
    p = _table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity").cast("int") * 5).alias("r"), (F.col("l_linenumber") * 30).alias("g"), (F.col("l_partkey") % 256).cast("int").alias("b"))
    return recognition.ink_colour(p, "l_suppkey")


@query(
    """WITH K AS (SELECT p_brand grid, p_partkey AS cluster, CASE WHEN p_partkey % 6 <> 0 THEN 'C' || p_partkey % 6 END code, CAST(p_size AS BIGINT) members, p_retailprice score, p_partkey % 256 r, p_size * 5 g, p_partkey % 7 b FROM part),
F AS (SELECT grid, code, arg_min(struct_pack(r := r, g := g, b := b), cluster) own FROM K WHERE code IS NOT NULL GROUP BY 1, 2)
SELECT grid, code, count(*) n_clusters, CAST(sum(members) AS BIGINT) members, max(score) score, count(*) FILTER (WHERE sqrt(pow(r - own.r, 2) + pow(g - own.g, 2) + pow(b - own.b, 2)) > 42) contradictions FROM K JOIN F USING (grid, code) GROUP BY 1, 2"""
)
def merged_codes(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    code = F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit("C"), (F.col("p_partkey") % 6).cast("string")))
    colour = F.array(*[c.cast("double") for c in (F.col("p_partkey") % 256, F.col("p_size") * 5, F.col("p_partkey") % 7)])
    return recognition.merge_codes(p.select(F.col("p_brand").alias("grid"), F.col("p_partkey").alias("cluster"), code.alias("code"), F.col("p_size").cast("bigint").alias("members"), F.col("p_retailprice").alias("score"), colour.alias("colour")))


_SIDE, _LEVEL = 8, glyphs.HOLE_LEVEL

#: H: holes, upper and lower ink of each vector as a square raster, its regions found by flooding.
_HOLES = f"""PX AS (SELECT vec_id, i - 1 p, (embedding[i] - list_min(embedding)) / (list_max(embedding) - list_min(embedding)) > {_LEVEL} ink FROM embeddings, range(1, 65) r(i)),
FL(vec_id, s, p) AS (SELECT vec_id, p, p FROM PX WHERE NOT ink UNION SELECT FL.vec_id, s, PX.p FROM FL JOIN PX ON FL.vec_id = PX.vec_id AND NOT ink AND (abs(FL.p - PX.p) = {_SIDE} OR (abs(FL.p - PX.p) = 1 AND FL.p // {_SIDE} = PX.p // {_SIDE}))),
RG AS (SELECT vec_id, c, count(*) n, bool_or(p < {_SIDE} OR p >= 56 OR p % {_SIDE} IN (0, 7)) outer_ FROM (SELECT vec_id, p, min(s) c FROM FL GROUP BY 1, 2) GROUP BY 1, 2),
H AS (SELECT e.vec_id, coalesce(h, 0) holes, up, low FROM (SELECT vec_id, avg(CAST(ink AS INT)) FILTER (WHERE p < 32) up, avg(CAST(ink AS INT)) FILTER (WHERE p >= 32) low FROM PX GROUP BY 1) e LEFT JOIN (SELECT vec_id, count(*) h FROM RG WHERE NOT outer_ AND n >= {glyphs.HOLE_PIXELS} GROUP BY 1) USING (vec_id))"""


def _glyphs(spark, sf_dir):
    """The vectors as square rasters from 0 to 1 in the vectors' own precision, with their holes and the ink of their halves."""
    e = _table(spark, sf_dir, "embeddings")
    low, high = F.array_min("embedding"), F.array_max("embedding")
    grey = F.transform(F.arrays_zip(F.col("embedding").alias("x"), F.array_repeat(low, F.size("embedding")).alias("low"), F.array_repeat(high, F.size("embedding")).alias("high")), lambda z: ((z["x"] - z["low"]) / (z["high"] - z["low"])).cast("float"))
    f = glyphs.features(F.col("grey"), _SIDE, lambda v: v > F.lit(_LEVEL).cast("float"))
    return e.withColumn("grey", grey).withColumn("f", f).select(*e.columns, "f.holes", "f.upper", "f.lower")


@query(f"WITH RECURSIVE {_HOLES} SELECT vec_id, holes, round(up, 6) AS upper, round(low, 6) AS lower FROM H")
def glyph_holes(spark, sf_dir):
    return _glyphs(spark, sf_dir).select("vec_id", "holes", F.round("upper", 6).alias("upper"), F.round("lower", 6).alias("lower"))


@query(
    f"""{_RANK.replace('WITH', 'WITH RECURSIVE', 1)}, {_HOLES}, X AS (SELECT vec_id, label digit, s, holes, CASE label WHEN 0 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 1 WHEN 8 THEN 2 WHEN 9 THEN 1 ELSE 0 END own, up, low FROM N JOIN H USING (vec_id)),
Y AS (SELECT *, 0.8 * s + 0.2 * (1 - 0.4 * abs(holes - own) / 2) + CASE WHEN holes = own THEN 0.04 ELSE -0.02 END + CASE digit WHEN 8 THEN CASE WHEN b > 1.2 THEN -0.01 ELSE 0.01 END WHEN 9 THEN CASE WHEN b > 1.2 THEN 0.01 ELSE -0.01 END ELSE 0 END t FROM (SELECT *, CASE WHEN low > 0.001 THEN up / low ELSE 10 END b FROM X)),
O AS (SELECT vec_id, digit, round(t, 9) t, row_number() OVER (PARTITION BY vec_id ORDER BY round(t, 9) DESC, digit) r FROM Y)
SELECT a.vec_id, a.digit, round(a.t, 6) score, round(a.t - b.t, 6) margin FROM O a JOIN O b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2"""
)
def glyph_classify(spark, sf_dir):
    """Digits by shape, holes and balance, all taken from the raster."""
    e = _glyphs(spark, sf_dir)
    shapes = ["vec_id", "holes", "upper", "lower"]
    s = recognition.scores(e, recognition.template_bank(_table(spark, sf_dir, "embeddings"))).select(*shapes, F.explode("scores").alias("s")).select(*shapes, F.col("s.label").alias("digit"), F.col("s.shape").alias("shape"))
    own = F.element_at(F.create_map(*[F.lit(x) for d in range(10) for x in (d, recognition.DIGIT_HOLES.get(d, 0))]), F.col("digit").cast("int"))
    score = recognition.glyph_score(F.col("digit"), F.col("shape"), 1 - 0.4 * F.abs(F.col("holes") - own) / 2, F.col("holes"), own, F.col("upper"), F.col("lower"))
    return recognition.classify_glyphs(s.withColumn("score", F.round(score, 9)), "vec_id").withColumns({"score": F.round("score", 6), "margin": F.round("margin", 6)})


#: The medoids of each grid in order, by looking at one cell after another (DuckDB); colours and widths from the vector.
_FIT = f"""{_BANK}, CE AS (SELECT vec_id % 7 g, vec_id cell, row_number() OVER (PARTITION BY vec_id % 7 ORDER BY vec_id) i, 10 + vec_id % 2 w, [vec_id % 3 * 20.0, vec_id % 2 * 20.0, 0.0] col, list_transform(range(1, 65), lambda i: tpl[i] + 0.05 * CAST(embedding[i] AS DOUBLE)) v FROM embeddings JOIN B USING (label)),
CN AS (SELECT g, cell, i, w, col, v, list_sum(v) s, list_dot_product(v, v) q FROM CE),
FT(g, i, meds, home) AS (SELECT g, CAST(0 AS BIGINT), CAST([] AS STRUCT(cell BIGINT, w BIGINT, col DECIMAL(22,1)[], v DOUBLE[], s DOUBLE, q DOUBLE)[]), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT g FROM CN) UNION ALL
 SELECT g, i, CASE WHEN len(fit) = 0 THEN list_append(meds, me) ELSE meds END, CASE WHEN len(fit) = 0 THEN me.cell ELSE fit[1].cell END FROM (
 SELECT FT.g, CN.i, meds, {{'cell': cell, 'w': w, 'col': col, 'v': v, 's': CN.s, 'q': CN.q}} me, list_filter(meds, lambda m: abs(m.w - CN.w) / greatest(m.w, CN.w) <= 0.14 AND
 (round((list_dot_product(m.v, CN.v) - m.s * CN.s / 64) / sqrt((m.q - m.s * m.s / 64) * (CN.q - CN.s * CN.s / 64)), 9) >= 0.955 OR (round((list_dot_product(m.v, CN.v) - m.s * CN.s / 64) / sqrt((m.q - m.s * m.s / 64) * (CN.q - CN.s * CN.s / 64)), 9) >= 0.86
 AND sqrt(pow(m.col[1] - CN.col[1], 2) + pow(m.col[2] - CN.col[2], 2)) <= 42))) fit FROM FT JOIN CN ON FT.g = CN.g AND CN.i = FT.i + 1))"""


@query(f"WITH RECURSIVE {_FIT}, M AS (SELECT FT.g, home AS cluster, col FROM FT JOIN CN ON FT.g = CN.g AND FT.i = CN.i), A AS (SELECT g, cluster, count(*) members, floor(avg(col[1]) + 0.5) r, floor(avg(col[2]) + 0.5) k FROM M GROUP BY 1, 2) SELECT g grid, cluster, members, CAST(r AS DOUBLE) red, round(max(sqrt(pow(col[1] - r, 2) + pow(col[2] - k, 2))), 6) spread FROM M JOIN A USING (g, cluster) GROUP BY ALL")
def medoid_clusters(spark, sf_dir):
    """Cells of a grid by the first cluster whose first cell they are like, and what each cluster looks like on the whole; a
    cell is its label's mean vector with a little of its own."""
    k = F.col("vec_id")
    colour = F.array((k % 3 * 20).cast("double"), (k % 2 * 20).cast("double"), F.lit(0.0))
    e = _table(spark, sf_dir, "embeddings")
    mixed = F.zip_with("template", "embedding", lambda t, x: t + F.lit(0.05) * x.cast("double"))
    met = e.join(F.broadcast(recognition.template_bank(e)), "label")  # one row per label
    cells_ = met.select((k % 7).alias("grid"), k.alias("cell"), (10 + k % 2).cast("double").alias("width"), colour.alias("colour"), mixed.alias("vector"))
    c = grids.centred(cells_, grids.first_fit(cells_))
    return c.select("grid", "cluster", "members", F.col("colour")[0].alias("red"), F.round("spread", 6).alias("spread"))


@query(f"WITH RECURSIVE {_FIT}, A AS (SELECT g, home AS cluster, count(*) members FROM FT WHERE home IS NOT NULL GROUP BY 1, 2) SELECT g grid, cluster, members, row_number() OVER (PARTITION BY g ORDER BY members DESC, cluster) place FROM A")
def clusters_by_size(spark, sf_dir):
    """The clusters of each grid in the order of a review, largest first."""
    return grids.by_size(medoid_clusters(spark, sf_dir).select("grid", "cluster", "members"))


#: Ink per column of the digits 0 to 9 of a small font, and a blank column; 4 is broken, and 7 touches what follows.
_INK = {"0": [5, 2, 2, 2, 5], "1": [1, 7, 1], "2": [3, 3, 3, 3, 3], "3": [2, 2, 3, 3, 5], "4": [3, 1, 0, 7, 1], "5": [4, 3, 3, 3, 4], "6": [5, 3, 3, 3, 3], "7": [1, 1, 4, 2, 2], "8": [4, 3, 3, 3, 4], "9": [3, 3, 3, 3, 5]}


def projections(spark, sf_dir):
    """Part prices in a small font: (p_partkey, projection, digits) with the ink of each column of pixels."""
    ink = F.create_map(*[x for d, v in _INK.items() for x in (F.lit(d), F.array(*[F.lit(i) for i in v], *([] if d == "7" else [F.lit(0)])))])
    text = F.floor(F.col("p_retailprice") * 100 * F.col("p_size")).cast("bigint").cast("string")
    rows = _table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    return rows.select("p_partkey", F.flatten(F.transform(F.split("t", ""), lambda d: F.element_at(ink, d))).alias("projection"), F.length("t").alias("digits"))


@query()
def digit_segments(spark, sf_dir):
    """Digits of part prices from their ink alone: broken ones joined, touching ones cut (no SQL: tested against a loop)."""
    d = projections(spark, sf_dir).withColumn("d", glyphs.digit_segments(F.col("projection"), F.lit(1), F.col("digits")))
    return d.select("p_partkey", "digits", "d.method", F.array_join(F.transform("d.segments", lambda s: F.concat_ws("+", s["x"], s["w"])), " ").alias("segments"))


@query(
    """WITH RECURSIVE E AS (SELECT l_orderkey g, 's' || l_suppkey AS lab, min(l_discount) score, min(CAST(l_quantity AS INT)) x0 FROM lineitem GROUP BY 1, 2), K AS (SELECT l_orderkey g, l_linenumber AS col, CAST(l_tax * 100 AS INT) + l_linenumber * 5 c0 FROM lineitem),
Q AS (SELECT E.g, lab, score, x0, list({'d': CAST(abs(c0 - x0) AS DOUBLE), 'c': col} ORDER BY abs(c0 - x0), col) o FROM E JOIN K ON E.g = K.g AND abs(c0 - x0) <= 12 GROUP BY ALL), N AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY -score, x0, lab) i FROM Q),
B(g, i, taken, lab, c) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS INT[]), CAST(NULL AS VARCHAR), CAST(NULL AS INT) FROM N UNION ALL SELECT g, i, CASE WHEN c IS NULL THEN taken ELSE list_append(taken, c) END, lab, c FROM (SELECT B.g, N.i, taken, N.lab, CAST(list_filter(o, lambda x: NOT list_contains(taken, CAST(x.c AS INT)))[1].c AS INT) c FROM B JOIN N ON B.g = N.g AND N.i = B.i + 1))
SELECT g grid, lab AS label, c AS col FROM B WHERE c IS NOT NULL"""
)
def label_binding(spark, sf_dir):
    """Labels of a page (an order's suppliers) bound to the nearest column (a line) that is still free."""
    li = _table(spark, sf_dir, "lineitem")
    grid = F.col("l_orderkey").alias("grid")
    labels = li.groupBy(grid, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("label")).agg(F.min("l_discount").alias("score"), F.min(F.col("l_quantity").cast("int")).alias("x0"))
    columns = li.select(grid, F.col("l_linenumber").cast("int").alias("col"), ((F.col("l_tax") * 100).cast("decimal(9,0)").cast("int") + F.col("l_linenumber") * 5).alias("c0"))
    pairs = labels.join(columns, "grid").withColumn("distance", F.abs(F.col("c0") - F.col("x0")).cast("double")).where("distance <= 12")
    return grids.bind_one_to_one(pairs)


_HEADINGS = f"(VALUES {', '.join(f'({i}, {chr(39)}{t}{chr(39)}, {chr(39)}{r}{chr(39)})' for i, (t, r) in enumerate(HEADER_VOCABULARY.items()))}) AS V(i, label, role)"


@query(
    f"""WITH RECURSIVE W AS (SELECT l_suppkey g, l_linenumber - 1 AS row, CAST(l_quantity * 20 AS INT) x0, CAST(l_quantity * 20 AS INT) + 60 x1, role, round(0.9 - l_discount * 5, 2) score FROM lineitem JOIN {_HEADINGS} ON i = l_partkey % {len(HEADER_VOCABULARY)}),
N AS (SELECT l_suppkey g, max(l_linenumber) n FROM lineitem GROUP BY 1), L AS (SELECT W.* FROM W JOIN N USING (g) WHERE n >= 3 AND row < n - 1 AND score >= 0.42),
H AS (SELECT g, min(row) AS row FROM (SELECT g, row FROM L WHERE row < 6 GROUP BY 1, 2 HAVING count(*) >= 4 AND count(DISTINCT role) FILTER (WHERE role IN ('status', 'list', 'sold', 'mls')) >= 2) GROUP BY 1),
K AS (SELECT DISTINCT l_suppkey g, CAST(round(l_tax * 100) AS INT) AS col FROM lineitem), P AS (SELECT DISTINCT L.g, row, x0, x1, role, score, col, abs(col * 28 + 10 - (x0 + x1) / 8) d FROM L JOIN H USING (g, row) JOIN K ON K.g = L.g AND least(x1 / 4, col * 28 + 20) > greatest(x0 / 4, col * 28)),
Q AS (SELECT g, row, x0, x1, role, score, list({{'d': d, 'c': col}} ORDER BY d, col) o FROM P GROUP BY ALL), O AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY -score, x0, row, x1, role) i FROM Q),
B(g, i, taken, row, role, c) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS INT[]), CAST(NULL AS INT), CAST(NULL AS VARCHAR), CAST(NULL AS INT) FROM O UNION ALL SELECT g, i, CASE WHEN c IS NULL THEN taken ELSE list_append(taken, c) END, row, role, c FROM
 (SELECT B.g, O.i, taken, O.row, O.role, CAST(list_filter(o, lambda x: NOT list_contains(taken, CAST(x.c AS INT)))[1].c AS INT) c FROM B JOIN O ON B.g = O.g AND O.i = B.i + 1))
SELECT g grid, row, c AS col, role FROM B WHERE c IS NOT NULL"""
)
def thin_band_header(spark, sf_dir):
    """Headings drawn at a supplier's lines, read in bands of four times the page's scale."""
    li = _table(spark, sf_dir, "lineitem").withColumn("grid", F.col("l_suppkey"))
    text = F.array(*[F.lit(t) for t in HEADER_VOCABULARY])[(F.col("l_partkey") % len(HEADER_VOCABULARY)).cast("int")]
    x0 = (F.col("l_quantity") * 20).cast("int")
    words = li.select("grid", (F.col("l_linenumber") - 1).alias("row"), x0.alias("x0"), (x0 + 60).alias("x1"), F.when(F.col("l_returnflag") == "R", F.concat(text, F.lit("▲"))).otherwise(text).alias("text"), F.round(0.9 - F.col("l_discount") * 5, 2).alias("score"))
    col = F.round(F.col("l_tax") * 100).cast("int")
    columns = li.select("grid", col.alias("col"), (col * 28).alias("c0"), (col * 28 + 20).alias("c1")).distinct()
    return grids.thin_band_roles(words, li.groupBy("grid").agg(F.max("l_linenumber").alias("n_rows")), columns, 4.0)


@query(
    """WITH U AS (SELECT user_id, user_id % 4 <> 0 h, user_id % 3 <> 0 c, count(*) FILTER (WHERE event_id % 5 = 1) r, count(*) FILTER (WHERE event_id % 5 = 2) b, count(*) FILTER (WHERE event_id % 5 > 2 AND user_id % 2 = 0) x FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN NOT c THEN CASE WHEN h THEN 'info' ELSE 'warn' END WHEN r = 0 THEN CASE WHEN b > 0 AND x = 0 THEN 'info' ELSE 'warn' END WHEN x > 0 THEN 'warn' END AS level FROM U"""
)
def market_time_notice(spark, sf_dir):
    k, u = F.col("event_id") % 5, F.col("user_id")
    g = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(k == 1).alias("r"), F.count_if(k == 2).alias("b"), F.count_if((k > 2) & (u % 2 == 0)).alias("x"))
    return g.select("user_id", recognition.market_time_level(u % 4 != 0, u % 3 != 0, F.col("r"), F.col("b"), F.col("x")).alias("level"))


@query(f"{L} SELECT n, CASE WHEN n % 23 <> 0 THEN 'row' WHEN n % 2 = 0 OR n % 3 = 0 OR n % 5 = 0 THEN 'row without status' ELSE 'not a listing' END kept FROM L")
def band_evidence(spark, sf_dir):
    n = F.col("n")
    bands = _placed(spark, sf_dir).select("n", (n % 23 != 0).alias("has_status"), F.when(n % 2 == 0, 1).otherwise(0).alias("money"), F.when(n % 3 == 0, F.col("mls")).alias("mls"), F.when(n % 5 == 0, n).alias("number"))
    return recognition.kept_bands(bands).select("n", "kept")


@query(
    """WITH B AS (SELECT o_custkey grid, o_orderkey id, o_orderkey % 40 * 20 top, o_orderkey % 40 * 20 + 10 + o_custkey % 5 + CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 0 END bottom FROM orders),
M AS (SELECT grid, list(bottom - top ORDER BY bottom - top)[count(*) // 2 + 1] t, count(*) n FROM B GROUP BY 1)
SELECT grid, id, (top <= 1 OR bottom >= 799) AND n >= 3 AND abs(bottom - top - t) / t > 0.15 clipped, bottom - top BETWEEN 10 AND 60 in_range FROM B JOIN M USING (grid)"""
)
def band_heights(spark, sf_dir):
    k = F.col("o_orderkey")
    top = k % 40 * 20
    b = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grid"), k.alias("id"), top.alias("top"), (top + 10 + F.col("o_custkey") % 5 + F.when(k % 3 == 0, 4).otherwise(0)).alias("bottom"), F.lit(800).alias("height"))
    return pixels.bands_in_range(pixels.clipped_rows(b), 2.0).select("grid", "id", "clipped", "in_range")


@query(
    """WITH X AS (SELECT p_partkey k, CAST(floor(CAST(p_retailprice AS DECIMAL(12,2)) * 100) AS BIGINT) c FROM part)
SELECT k p_partkey, CASE k % 6 WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN c END AS value, CASE k % 6 WHEN 2 THEN 'error' WHEN 3 THEN 'blank' WHEN 5 THEN 'error' ELSE 'value' END state,
 CASE WHEN k % 5 < 3 THEN CAST(k % 3000 AS INT) END AS days, CASE WHEN k % 5 < 3 THEN 'value' WHEN k % 5 = 3 THEN 'blank' ELSE 'error' END AS days_state, rtrim(rtrim(format('{:,.2f}', c / 100), '0'), '.') shown FROM X"""
)
def typed_input(spark, sf_dir):
    k, c = F.col("p_partkey"), F.floor(F.col("p_retailprice").cast("decimal(12,2)") * 100).cast("bigint")
    s = c.cast("string")
    text = F.when(k % 6 == 0, F.concat(F.lit(" $ "), s)).when(k % 6 == 1, F.concat(F.substring(s, 1, 2), F.lit(","), F.substring(s, 3, 20), F.lit(".4"))).when(k % 6 == 2, "999").when(k % 6 == 3, "  ").when(k % 6 == 4, s).otherwise(F.concat(s, F.lit("k")))
    d = (k % 3000).cast("string")
    days = F.when(k % 5 == 0, d).when(k % 5 == 1, F.concat(F.lit(" "), d)).when(k % 5 == 2, F.concat(d, F.lit(","))).when(k % 5 == 3, "").otherwise("1.5")
    p = _table(spark, sf_dir, "part").select("p_partkey", cells.typed_money(text).alias("m"), cells.typed_days(days).alias("d"), cells.amount_text(F.col("p_retailprice").cast("decimal(12,2)")).alias("shown"))
    return p.select("p_partkey", F.col("m.value").alias("value"), F.col("m.state").alias("state"), F.col("d.value").alias("days"), F.col("d.state").alias("days_state"), "shown")


@query(
    """WITH G AS (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) l, count(*) n FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN n = 1 THEN 'line ' || l[1] WHEN n <= 8 THEN 'lines ' || array_to_string(l[1:n - 1], ', ') || ' and ' || l[n] ELSE 'lines ' || array_to_string(l[1:8], ', ') || ' and ' || (n - 8) || ' more' END AS lines FROM G"""
)
def line_lists(spark, sf_dir):
    g = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    return g.select("o_custkey", cells.line_list(F.col("l")).alias("lines"))


@query(
    """SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN c WHEN 1 THEN c / 10.0 ELSE c / 100.0 END AS DECIMAL(14,2)) amount, '#' || lower(lpad(to_hex(p_partkey % 256), 2, '0') || lpad(to_hex(p_size), 2, '0') || '07') hex,
 round(sqrt(pow(p_partkey % 256 - 9, 2) + pow(p_size - 9, 2) + 4), 6) distance, round(greatest(0, 1 - abs(log2(p_size / 20.0))), 6) aspect, round(0.75 * 0.5 + 0.25 * greatest(0, 1 - abs(log2(p_size / 20.0))), 6) word
FROM (SELECT p_partkey, p_size, CAST(floor(CAST(p_retailprice AS DECIMAL(12,2)) * 100) AS BIGINT) c FROM part)"""
)
def scalar_marks(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    digits = F.floor(F.col("p_retailprice").cast("decimal(12,2)") * 100).cast("bigint").cast("string")
    colour = F.array((k % 256).cast("double"), size.cast("double"), F.lit(7.0))
    aspect = recognition.aspect_agreement(size.cast("double"), F.lit(20.0))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", recognition.to_decimal(digits, (k % 3).cast("int")).alias("amount"), recognition.colour_hex(colour).alias("hex"), F.round(recognition.colour_distance(colour, F.array(F.lit(9.0), F.lit(9.0), F.lit(9.0))), 6).alias("distance"),
        F.round(aspect, 6).alias("aspect"), F.round(recognition.word_score(F.lit(0.5), aspect), 6).alias("word"),
    )


@query(
    """WITH X AS (SELECT o_custkey grid, o_orderkey % 8 AS row, CASE o_orderkey % 5 WHEN 0 THEN 'status' WHEN 1 THEN 'list' WHEN 2 THEN 'conc' WHEN 3 THEN 'mls' ELSE 'decoy' END AS role FROM orders)
SELECT grid, min(row) AS row FROM (SELECT grid, row FROM X WHERE row < 6 GROUP BY 1, 2 HAVING count(*) >= 4 AND count(DISTINCT role) FILTER (WHERE role IN ('status', 'list', 'sold', 'mls')) >= 2) GROUP BY 1"""
)
def header_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    role = F.when(k % 5 == 0, "status").when(k % 5 == 1, "list").when(k % 5 == 2, "conc").when(k % 5 == 3, "mls").otherwise("decoy")
    return recognition.header_row(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grid"), (k % 8).alias("row"), role.alias("role")))


@query(
    """WITH X AS (SELECT l_orderkey, l_linenumber place, CAST(l_quantity AS INT) % 10 digit, CASE WHEN l_partkey % 50 = 0 THEN 'score' END reason FROM lineitem)
SELECT l_orderkey, CASE WHEN max(reason) IS NULL THEN string_agg(CAST(digit AS VARCHAR), '' ORDER BY place, digit) END digits, max(reason) reason FROM X GROUP BY 1"""
)
def price_tokens(spark, sf_dir):
    g = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), (F.col("l_quantity").cast("int") % 10).alias("digit"), F.when(F.col("l_partkey") % 50 == 0, "score").alias("reason"))
    return recognition.read_tokens(g, ["l_orderkey"])


@query(
    """SELECT p_brand AS col, round(avg(CASE WHEN p_size % 10 <> 3 THEN 1.0 ELSE 0.0 END), 6) eight, round(avg(CASE WHEN p_partkey % 4 <> 0 THEN 1.0 ELSE 0.0 END), 6) clean FROM part GROUP BY 1 HAVING avg(CASE WHEN p_size % 10 <> 3 THEN 1.0 ELSE 0.0 END) >= 0.6"""
)
def mls_columns(spark, sf_dir):
    c = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("col"), F.when(F.col("p_size") % 10 != 3, 8).otherwise(7).alias("n_glyphs"), (F.col("p_partkey") % 4 != 0).alias("clean"))
    return recognition.mls_column(c).select("col", F.round("eight", 6).alias("eight"), F.round("clean", 6).alias("clean"))


_LABELS = ", ".join(f"({i}, '{t}', '{r}')" for i, (t, r) in enumerate(HEADER_VOCABULARY.items()))


@query(f"SELECT role, label, role IN ('status', 'list', 'sold', 'mls') anchor, count(*) n_tokens FROM part JOIN (VALUES {_LABELS}) v(i, label, role) ON p_partkey % {len(HEADER_VOCABULARY)} = i GROUP BY ALL")
def header_vocabulary(spark, sf_dir):
    """Tokens that spell header labels, in any case and spacing, bound to their roles."""
    k = F.col("p_partkey")
    text = F.array(*[F.lit(t) for t in HEADER_VOCABULARY])[(k % len(HEADER_VOCABULARY)).cast("int")]
    tokens = _table(spark, sf_dir, "part").select(text.alias("label"), F.when(k % 2 == 0, F.upper(text)).otherwise(F.concat(F.lit(" "), text)).alias("token"))
    found = recognition.header_roles(tokens, "token")
    return found.groupBy("role", "label", F.col("role").isin(*recognition.HEADER_ANCHORS).alias("anchor")).agg(F.count("*").alias("n_tokens"))


@query(f"{L}, W AS (SELECT n AS seq, CASE n % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'ok' WHEN 2 THEN 'warn' ELSE 'info' END AS level FROM L WHERE n % 50 = 0 UNION ALL SELECT n, 'warn' FROM L WHERE n % 70 = 0) SELECT row_number() OVER (ORDER BY CASE level WHEN 'error' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, seq, level) pos, level, seq FROM W")
def notice_order(spark, sf_dir):
    """Notices of two stages in one list, worst level first."""
    n = F.col("n")
    rows = _placed(spark, sf_dir)
    level = F.when(n % 4 == 0, "error").when(n % 4 == 1, "ok").when(n % 4 == 2, "warn").otherwise("info")
    both = rows.where(n % 50 == 0).select(n.alias("seq"), level.alias("level")).unionByName(rows.where(n % 70 == 0).select(n.alias("seq"), F.lit("warn").alias("level")))
    rank = F.array_position(F.array(*map(F.lit, ("error", "warn", "info", "ok"))), F.col("level"))
    return placing.numbered(both.withColumn("rank", rank), ["rank", "seq", "level"]).select("pos", "level", "seq")


