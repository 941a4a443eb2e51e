"""Market metrics over listing rows: placement, bucket summaries, accounting and the provisional gate.

Every operator takes optional group columns, so one plan serves one grid or millions of groups: rows are reduced
by partial aggregation on (group, bucket), and the bucket spine is joined after that, on the reduced rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions import cells
from marketlens.functions.vocab import BUCKETS, NUMBERS, REASON, REPORTED
from marketlens.operators.ranks import medians

EDITABLE = ["status", "orig_price", "list_price", "sold_price", "concessions", "market_time"]


def placed(rows: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Listing rows with placement (omitted, unresolved or a bucket), price and net ratio.

    Omission wins over a missing status; a price never comes from another column than the bucket's.
    """
    omit = F.col("omit") if "omit" in rows.columns else F.lit(False)
    place = F.when(F.coalesce(omit, F.lit(False)), "omitted").when(F.coalesce("status", F.lit("")) == "", "unresolved").otherwise(cells.bucket(F.col("status"), overrides))
    return rows.withColumn("placement", place).withColumn("price", cells.price_of(F.col("placement"), F.col("list_price"), F.col("sold_price"))).withColumn(
        "ratio", F.when(F.col("placement") == "closed", cells.net_ratio(F.col("sold_price"), F.col("concessions"), F.col("orig_price")))
    )


def _whole(c: Column) -> Column:
    return F.round(c).cast("bigint")


def bucket_summary(rows: DataFrame, by: list[str] | None = None, spine: bool = True) -> DataFrame:
    """One row per group and bucket (every bucket, also empty ones, if ``spine``): counts and exact statistics.

    ``rows`` come from :func:`placed`.  Price statistics rest on prices over zero, days on counts from zero on.
    """
    by = by or []
    counted = rows.where(F.col("placement").isin(*BUCKETS))
    days = F.when(F.col("market_time") >= 0, F.col("market_time"))
    out = counted.groupBy(*by, F.col("placement").alias("bucket")).agg(
        F.count("*").alias("n_rows"), F.count("price").alias("priced"), (F.count("*") - F.count("price")).alias("missing"),
        F.min("price").alias("low"), F.max("price").alias("high"),
        F.count("ratio").alias("ratio_rows"), F.min("ratio").alias("ratio_low"), F.max("ratio").alias("ratio_high"), F.avg("ratio").alias("ratio_mean"),
        F.count(days).alias("dom_rows"), F.min(days).alias("dom_low"), F.max(days).alias("dom_high"),
    )
    measures = [("price", F.col("price")), ("ratio", F.col("ratio")), ("days", days)]
    long = counted.select(*by, F.col("placement").alias("bucket"), F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("double").alias("x")) for k, c in measures])))
    of = lambda k: F.max(F.when(F.col("measure") == k, F.col("median")))
    middle = medians(long, [*by, "bucket", "measure"], "x").groupBy(*by, "bucket").agg(_whole(of("price")).alias("median_price"), of("ratio").alias("ratio_median"), _whole(of("days")).alias("dom_median"))
    out = out.join(middle, [*by, "bucket"], "left")
    if not spine:
        return out
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    full = groups.withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in BUCKETS])))
    return full.join(out, [*by, "bucket"], "left").fillna(0, ["n_rows", "priced", "missing", "ratio_rows", "dom_rows"])


def accounting(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per placement, their total, and whether they add up."""
    counts = {p: F.count_if(F.col("placement") == p).alias(p) for p in (*BUCKETS, "unresolved", "omitted")}
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("total_rows"), *counts.values())
    total = sum((F.col(p) for p in counts), F.lit(0))
    return out.withColumn("accounted", total).withColumn("balanced", total == F.col("total_rows"))


#: What the gate takes from a source when nothing is said: a clean file with a days column.
CLEAN = {"errors": 0, "dropped": 0, "role_problems": 0, "no_status_column": False, "confidence": 1.0, "has_market_time": True, "source": "file"}


def gate(rows: DataFrame, by: list[str] | None = None, review: DataFrame | None = None) -> DataFrame:
    """Whether each group's summary is provisional, with its reasons in order.

    ``review`` holds, per group, what its source reported; without it every group counts as a clean file.
    """
    by = by or []
    missing = lambda b: F.count_if((F.col("placement") == b) & F.col("price").isNull())
    no_days = lambda b: F.count_if((F.col("placement") == b) & F.coalesce(F.col("market_time") < 0, F.lit(True)))
    acc = accounting(rows, by)
    more = rows.groupBy(*by).agg(*[missing(b).alias(f"unpriced_{b}") for b in REPORTED], *[no_days(b).alias(f"no_days_{b}") for b in REPORTED])
    joined = acc.join(more, by) if by else acc.crossJoin(more)  # one row each
    if review is not None:
        joined = joined.join(review.select(*by, *CLEAN), by, "left") if by else joined.crossJoin(review.select(*CLEAN))
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in CLEAN.items()})
    else:
        joined = joined.withColumns({k: F.lit(v) for k, v in CLEAN.items()})
    n = lambda c: F.col(c).cast("string")
    when = lambda cond, *text: F.when(cond, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))
    reasons = [
        when(F.col("unresolved") > 0, n("unresolved"), " of ", n("total_rows"), REASON["unresolved"]),
        when(F.col("unclassified") > 0, n("unclassified"), REASON["unclassified"]),
        when(~F.col("balanced"), REASON["unbalanced"]),
        when(F.col("errors") > 0, n("errors"), REASON["errors"]),
        when(F.col("dropped") > 0, n("dropped"), REASON["dropped"]),
        when(F.col("role_problems") > 0, REASON["role"]),
        when(F.col("no_status_column"), REASON["no_status"]),
        when(F.col("confidence") < 0.8, REASON["inferred"]),
        *[when(F.col(f"unpriced_{b}") > 0, n(f"unpriced_{b}"), f" {b}", REASON["unpriced"]) for b in REPORTED],
        *[when(F.col("has_market_time") & (F.col(f"no_days_{b}") > 0) & ((F.col("source") != "file") | F.lit(b == "active")), n(f"no_days_{b}"), f" {b}", REASON["no_days"]) for b in REPORTED],
    ]
    out = joined.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.select(*by, "total_rows", "accounted", "balanced", (F.size("reasons") > 0).alias("provisional"), F.array_join("reasons", "; ").alias("reasons"), F.col("reasons").alias("reason_list"))


def comp_list(rows: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """Closed rows of each group, numbered in input order, where a group has at most ``most`` of them and a ratio."""
    closed = rows.where(F.col("placement") == "closed")
    size = closed.groupBy(*by).agg(F.count("*").alias("n_closed"), F.count("ratio").alias("n_ratio")).where((F.col("n_closed") <= most) & (F.col("n_ratio") > 0))
    # Only groups of at most ``most`` rows reach the window.
    return closed.join(size, by).withColumn("comp", F.row_number().over(W.partitionBy(*by).orderBy("n")))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("times")).where(F.col("times") > 1)


def number_gaps(rows: DataFrame, by: str, number: str) -> DataFrame:
    """Per group: first and last number, and how many between are absent, without building the ranges.

    absent = span - distinct numbers; the places come from neighbours (lead) on demand.
    """
    return rows.groupBy(by).agg(
        F.min(number).cast("bigint").alias("first_no"), F.max(number).cast("bigint").alias("last_no"), F.count("*").alias("n_rows"), F.countDistinct(number).alias("n_distinct"),
    ).withColumn("absent", F.col("last_no") - F.col("first_no") + 1 - F.col("n_distinct"))


def number_check(rows: DataFrame, numbers: DataFrame, by: str, number: str = "number", lost: DataFrame | None = None, shown: int = 12) -> DataFrame:
    """Whether numbered rows all arrived, per group: first and last number, gaps, absent rows, a gap sample, and notices.

    ``numbers`` (by, number) are the numbers that a group's index column holds, ``rows`` (by, number) the rows that
    reached the report, null where a row's own number was not read.  Rows without a number may be any of the gaps, so
    only the gaps beyond them are absent.  Gaps come from the neighbours of what is there, as ranges, and are never
    written out one by one but for the sample.  ``lost`` (by, lost) counts what a group lost or could not read otherwise;
    all is well only if that is nothing.  ``notices`` is an array of (level, text): the finding about gaps, that numbers do
    not start at one, and that all were read, each for itself.
    """
    ends = numbers.groupBy(by).agg(F.min(number).cast("bigint").alias("first_no"), F.max(number).cast("bigint").alias("last_no"))
    got = rows.groupBy(by, number).agg(F.count("*").alias("n"))
    fences = ends.select(by, F.inline(F.array(F.struct((F.col("first_no") - 1).alias(number)), F.struct((F.col("last_no") + 1).alias(number)))))
    order = W.partitionBy(by).orderBy(number)
    known = got.where(F.col(number).isNotNull()).join(ends, by).where(F.col(number).between(F.col("first_no"), F.col("last_no"))).select(by, F.col(number).cast("bigint").alias(number))
    holes = known.unionByName(fences).withColumn("next", F.lead(number).over(order)).where(F.col("next") - F.col(number) > 1)
    run = F.struct((F.col(number) + 1).alias("a"), (F.col("next") - 1).alias("b"))
    upto = F.sum(F.col("next") - F.col(number) - 1).over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = holes.withColumn("run", run).withColumn("before", F.coalesce(upto, F.lit(0)))
    # Ranges that start among the first ``shown`` gaps are the only ones listed.
    gaps = spans.groupBy(by).agg(F.sum(F.col("run.b") - F.col("run.a") + 1).alias("gaps"), F.array_sort(F.collect_list(F.when(F.col("before") < shown, F.col("run")))).alias("runs"))
    unnumbered = got.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col(number).isNull(), F.col("n"))), F.lit(0)).alias("unnumbered"))
    out = ends.join(gaps, by, "left").join(unnumbered, by, "left").fillna(0, ["gaps", "unnumbered"])
    absent = F.greatest(F.lit(0), F.col("gaps") - F.col("unnumbered"))
    each = F.flatten(F.transform(F.col("runs"), lambda r: F.sequence(r["a"], F.least(r["b"], r["a"] + shown))))
    sample = F.when((absent > 0) & (F.col("gaps") == absent), F.concat(F.array_join(F.slice(each, 1, shown), ", "), F.when(F.col("gaps") > shown, "…").otherwise("")))
    out = out.withColumn("sample", sample).withColumn("absent", absent)
    out = out.join(lost.select(by, "lost"), by, "left").fillna(0, ["lost"]) if lost is not None else out.withColumn("lost", F.lit(0))
    n = lambda c: F.col(c).cast("string")
    notice = lambda cond, level, *text: F.when(cond, F.struct(F.lit(level).alias("level"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("text")))
    listed = F.coalesce(F.concat(F.lit("("), F.col("sample"), F.lit(") ")), F.lit(""))
    whole = (F.col("gaps") == 0) & (F.col("first_no") == 1) & (F.col("lost") == 0)
    found = [
        notice(F.col("absent") > 0, "error", "The grid numbers its rows ", n("first_no"), "–", n("last_no"), ", but ", n("absent"), " of them ", listed, NUMBERS["absent"]),
        notice((F.col("absent") == 0) & (F.col("gaps") > 0), "info", n("gaps"), NUMBERS["unread"]),
        notice(F.col("first_no") > 1, "warn", "The grid numbers its rows from ", n("first_no"), NUMBERS["later"], (F.col("first_no") - 1).cast("string"), NUMBERS["above"]),
        notice(whole, "ok", "Row numbers 1–", n("last_no"), NUMBERS["all"]),
    ]
    return out.select(by, "first_no", "last_no", "gaps", "unnumbered", "absent", "sample", F.array_compact(F.array(*found)).alias("notices"))


def with_review(rows: DataFrame, entries: DataFrame, key: str = "n") -> DataFrame:
    """Each listing row with its placement, price and ratio in the report (null where it has no entry)."""
    return rows.join(entries.select(key, "placement", "price", "ratio"), key, "left")


def with_edits(rows: DataFrame, edits: DataFrame, key: str = "n") -> DataFrame:
    """Rows with patches (key, patch map<string,string>, omit) applied; a null in a patch is a value of its own."""
    joined = rows.join(edits.select(key, "patch", F.col("omit").alias("omit_")), key, "left")
    had = lambda c: F.coalesce(F.map_contains_key("patch", F.lit(c)), F.lit(False))
    kinds = dict(rows.dtypes)
    new = {c: F.when(had(c), F.element_at("patch", F.lit(c)).try_cast(kinds[c])).otherwise(F.col(c)) for c in EDITABLE}
    changed = F.lit(False)
    for c in EDITABLE:
        changed = changed | ~new[c].eqNullSafe(F.col(c))
    return joined.select(*[new[c].alias(c) if c in EDITABLE else c for c in rows.columns if c not in ("omit", "edited")], F.coalesce("omit_", F.lit(False)).alias("omit"), changed.alias("edited"))


def present_codes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("code", cells.status_code(F.col("status"))).where("code is not null").groupBy("code").agg(F.count("*").alias("n_rows"))


def flagged_codes(rows: DataFrame) -> DataFrame:
    """Codes present that carry a caution; a private-network prefix raises its own as well."""
    own = cells.status_code(F.col("status"))
    private = F.when(F.upper(F.col("status")).startswith("PRIV-"), F.lit("PRIV"))
    codes = rows.where("status is not null").select(F.explode(F.array_compact(F.array(own, private))).alias("code")).distinct()
    return codes.withColumn("caution", cells.caution(F.col("code"))).where("caution is not null")


def notices(warnings: DataFrame) -> DataFrame:
    """Warnings (level, seq, text) from all stages, worst level first, stable within a level."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(("error", "warn", "info", "ok")) for x in (v, i)]), F.col("level"))
    return warnings.orderBy(rank, "seq")
