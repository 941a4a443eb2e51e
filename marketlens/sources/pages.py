"""Listing pages as tokens: from the tokens of many grids to their listing rows, notices and review facts, in one plan.

A token is (grid, row, x0, x1, text): what stands on a row band of a page, and where.  Columns are found by overlap, named
by the page's header where it has one and by their contents where not; what the role columns hold is then pivoted on the
row.  Every token is placed in a cell or counted, every row band becomes a listing or is counted, and what could not be
read stays empty with a reason.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import cells as read
from marketlens.functions.vocab import DAYS_MAX, KICKOUT, PAGE, PRICE_MAX, PRICE_MIN, STATUS_BUCKET
from marketlens.operators import grids, market, recognition
from marketlens.operators.ranks import is_small, with_median
from marketlens.operators.recognition import COL_HIGH, COL_LOW, COL_ROWS, COL_SHARE, DENSE, DIGIT_SPREAD, FILL_BLANKS, HEADER_ROWS, MLS_DIGITS
from marketlens.operators.rounds import settled

#: A dollar amount as a page prints it, and a whole number.
_DOLLARS, _WHOLE = r"\A\$(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]{1,2})?\z", r"\A(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\z"
_SORT_ARROW = "[▲▼]$"
ROLES = ["status", "mls", "list", "orig", "sold", "conc", "mt", "index"]


class Reading:
    """What was read from pages: listing rows, notices (grid, seq, level, text), review facts and counts per grid, the role
    columns (grid, role, col, method), and the cells.  ``small`` says that no page has more than ``ranks.SMALL`` tokens.

    Counts, notices and review facts are made when they are first asked for.
    """

    def __init__(self, listings: DataFrame, roles: DataFrame, cells: DataFrame, small: bool, count: Callable, notice: Callable):
        self.listings, self.roles, self.cells, self.small = listings, roles, cells, small
        self._count, self._notice = count, notice

    @cached_property
    def counts(self) -> DataFrame:
        return settled(self._count())

    @cached_property
    def notices(self) -> DataFrame:
        return settled(self._notice(self.counts))

    @cached_property
    def review(self) -> DataFrame:
        levels = self.notices.groupBy("grid").agg(F.count_if(F.col("level") == "error").alias("errors"))
        return self.counts.join(levels, "grid", "left").fillna(0, ["errors"]).select(
            "grid", "errors", "dropped", F.col("problems").alias("role_problems"), (~F.col("has_status")).alias("no_status_column"), "confidence", F.col("has_mt").alias("has_market_time"), F.lit("page").alias("source")
        )


def header_tokens(tokens: DataFrame) -> DataFrame:
    """(grid, row, label, role, x0, x1): the labels on each page's header row; a sort arrow behind a label is no part of it."""
    early = tokens.where(F.col("row") < HEADER_ROWS)  # no later row is a header
    named = recognition.header_roles(early.withColumn("plain", F.regexp_replace("text", _SORT_ARROW, "")), "plain").where("role is not null")
    named = settled(named.select("grid", "row", "plain", "role", "x0", "x1"))
    at = recognition.header_row(named)
    return named.join(at, ["grid", "row"]).select("grid", "row", F.concat_ws("@", "plain", "x0").alias("label"), "role", "x0", "x1")


def named_columns(labels: DataFrame, columns: DataFrame) -> DataFrame:
    """(grid, role, col): the column that each role's first label is bound to."""
    pairs = grids.overlapping(labels.withColumn("score", F.lit(1.0)), columns)
    bound = grids.bind_one_to_one(pairs).join(labels.select("grid", "label", "role", "x0"), ["grid", "label"])
    return bound.groupBy("grid", "role").agg(F.min_by("col", F.struct("x0", "label")).alias("col"))


def read_cells(cells: DataFrame) -> DataFrame:
    """``cells`` with what their texts are by themselves: a price, a whole number, a number of up to four digits, and whether
    they have as many characters as an MLS number, and those all digits."""
    text = F.col("text")
    eight = F.length("text") == MLS_DIGITS
    # What read.money makes of such a text, which has no blanks, no other marks and two decimals at most.
    amount = F.when(text.rlike(_DOLLARS), F.round(F.translate("text", "$,", "").try_cast("decimal(38,2)"), 0))
    return cells.withColumn("amount", amount).withColumns({
        "price": F.when(F.col("amount").between(PRICE_MIN, PRICE_MAX), F.col("amount").cast("bigint")),
        "whole": F.when(text.rlike(_WHOLE) & (F.length("text") <= 10), F.regexp_replace("text", ",", "").cast("bigint")),
        "number": F.when(text.rlike(r"\A[0-9]{1,4}\z"), text.cast("bigint")), "eight": eight, "clean": eight & text.rlike(r"\A[0-9]+\z"),
    }).drop("amount")


def column_facts(cells: DataFrame) -> DataFrame:
    """A row per column of :func:`read_cells`: its span, how many cells it has, and how many of each kind."""
    return cells.groupBy("grid", "col").agg(
        F.min("x0").alias("c0"), F.max("x1").alias("c1"), F.count("*").alias("n"), F.count("price").alias("n_priced"), F.count("whole").alias("n_whole"), F.count_if("eight").alias("n_eight"), F.count_if("clean").alias("n_clean"),
        F.count("number").alias("read"), F.min("number").alias("first_no"), F.max("number").alias("last_no"),
    )


def money_cells(cells: DataFrame, facts: DataFrame, small: bool) -> DataFrame:
    """(grid, col, row, value): prices of the columns that hold dollar amounts.

    A column counts if at least two cells and 60 % of them are amounts within the bounds of a price and its median is one
    of a house; values two digits or more short of the column's usual length are cut-off tokens and are left out.
    """
    full = facts.where((F.col("n_priced") >= COL_ROWS) & (F.col("n_priced") >= COL_SHARE * F.col("n"))).select("grid", "col")
    priced = cells.where("price is not null").join(full, ["grid", "col"], "left_semi").select("grid", "col", "row", F.col("price").alias("value"))
    digits = with_median(priced.withColumn("digits", F.length(F.col("value").cast("string"))), ["grid", "col"], "digits", small, "usual")
    whole = digits.where(F.floor(F.col("usual") + 0.5) - F.col("digits") < DIGIT_SPREAD).select("grid", "col", "row", "value")
    return with_median(whole, ["grid", "col"], "value", small).where(F.floor(F.col("median") + 0.5).between(COL_LOW, COL_HIGH)).select("grid", "col", "row", "value")


def status_cells(cells: DataFrame, facts: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """(grid, col, row, code): the cells of each page's status column, with their code (null if it is none)."""
    code = read.status_code(F.col("text"))
    header = named.where("role = 'status'").select("grid", "col")
    able = facts.where("n >= 2")
    # A column that the header names is taken before all others of its page, so the others are not looked at; nor are
    # columns of numbers alone, which any sample finds to be numeric.
    sure = able.join(header, ["grid", "col"], "left_semi").select("grid", F.col("col").alias("sure"))
    looked = able.join(sure, "grid", "left").where("sure = col or sure is null and n_clean + read < n").select("grid", "col")
    seen = cells.join(looked, ["grid", "col"], "left_semi").select("grid", "col", F.col("row").alias("cell"), code.alias("top"), F.col("text").rlike(r"\A[0-9]+\z").alias("digits"))
    known = F.when(F.col("top").isNotNull(), 1.0).otherwise(0.0)
    scored = seen.select("*", F.lit(None).cast("string").alias("second"), known.alias("score"), known.alias("shape"), F.lit(1.0).alias("margin"))
    chosen = recognition.status_columns(scored, rows, header).where("chosen").select("grid", "col")
    return cells.join(chosen, ["grid", "col"], "left_semi").select("grid", "col", "row", code.alias("code"))


def small_numbers(cells: DataFrame, facts: DataFrame, rows: DataFrame, closed: DataFrame, named: DataFrame) -> DataFrame:
    """(grid, col, row, value): whole numbers of the columns that may hold concessions: named so, or filled on few rows and
    empty on enough rows that are not closed.  ``closed`` (grid, row) are the closed rows."""
    counted = rows.join(closed.groupBy("grid").agg(F.count("*").alias("n_closed")), "grid")
    enough = facts.where(F.col("n_whole") >= COL_ROWS).select("grid", "col", "n")
    shape = enough.join(counted, "grid").where((F.col("n") >= COL_ROWS) & (F.col("n") < DENSE * F.col("n_rows")))
    met = cells.select("grid", "col", "row").join(shape, ["grid", "col"]).join(closed.withColumn("closed", F.lit(True)), ["grid", "row"], "left")
    left = F.max("n_rows") - F.max("n_closed") - F.count_if(F.col("closed").isNull())
    fits = met.groupBy("grid", "col").agg(left.alias("blank")).where(F.col("blank") >= FILL_BLANKS).select("grid", "col")
    able = fits.unionByName(enough.join(named.where("role = 'conc'"), ["grid", "col"], "left_semi").select("grid", "col"))
    return cells.where("whole is not null").join(able, ["grid", "col"], "left_semi").select("grid", "col", "row", F.col("whole").alias("value"))


def number_columns(cells: DataFrame, facts: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """(grid, col): the column that numbers each page's rows, if one does.

    Of the columns up to the first one without a gap the one with the most numbers; of equally many the one without a gap,
    then the leftmost.  The column named as market time is none.
    """
    days = named.where("role = 'mt'").select("grid", "col")
    least = F.greatest(F.lit(3.0), 0.6 * F.col("n_rows"))
    span = F.col("last_no") - F.col("first_no") + 1
    near = facts.join(days, ["grid", "col"], "left_anti").join(rows, "grid").where((F.col("n") >= least) & (F.col("read") >= least) & (span <= 1.5 * F.col("read") + 3))
    near = near.select("grid", "col", "read", (span == F.col("read")).alias("whole"))
    different = cells.where("number is not null").select("grid", "col", "number").join(near, ["grid", "col"], "left_semi").groupBy("grid", "col").agg(F.countDistinct("number").alias("n_distinct"))
    able = near.join(different, ["grid", "col"]).where(F.col("read") == F.col("n_distinct"))
    first = able.groupBy("grid").agg(F.min(F.when(F.col("whole"), F.col("col"))).alias("stop"))  # columns of a page
    upto = able.join(first, "grid").where(F.coalesce(F.col("col") <= F.col("stop"), F.lit(True)))
    return upto.groupBy("grid").agg(F.max_by("col", F.struct("read", "whole", -F.col("col"))).alias("col"))


def mls_columns(facts: DataFrame) -> DataFrame:
    """(grid, col): the column whose cells are mostly eight characters, and of those mostly digits; the clearest, then the
    leftmost."""
    g = facts.where((F.col("n_eight") >= F.greatest(F.lit(2.0), 0.6 * F.col("n"))) & (F.col("n_clean") >= 0.6 * F.col("n_eight")))
    return g.groupBy("grid").agg(F.max_by("col", F.struct(F.col("n_clean") / F.col("n_eight"), -F.col("col"))).alias("col"))


#: The codes that a status cell can have, in their order as texts; a line carries the place of its code.
_CODES = sorted({*STATUS_BUCKET, *KICKOUT, "PRIV"})


def _notice(cond: Column, level: Column | str, *text: Column | str) -> Column:
    parts = [F.lit(t) if isinstance(t, str) else t for t in text]
    return F.when(cond, F.struct((F.lit(level) if isinstance(level, str) else level).alias("level"), F.concat(*parts).alias("text")))


def _filled(key: str, value: Column) -> list:
    before, after = PAGE[key].split("{}")
    return [F.lit(before), value.cast("string"), F.lit(after)]


def read_pages(tokens: DataFrame, bands: DataFrame | None = None) -> Reading:
    """The listings of each grid of ``tokens``.

    ``bands`` (grid, row, top, bottom, height) are the row bands' places on their pages, if known: bands that an edge cut
    through are left out and counted.  Null texts and intervals count as no cell.
    """
    tokens = settled(tokens)
    small = is_small(tokens, ["grid"])
    labels = settled(header_tokens(tokens))
    at = labels.groupBy("grid").agg(F.max("row").alias("header"))
    met = tokens.join(at, "grid", "left").withColumn("above", F.coalesce(F.col("row") < F.col("header"), F.lit(False))).withColumn("in_header", F.coalesce(F.col("row") == F.col("header"), F.lit(False)))
    if bands is not None:
        cut = pixels_clipped(bands.join(at, "grid", "left").where("header is null or row > header"))
        met = met.join(cut, ["grid", "row"], "left").withColumn("clipped", F.coalesce("clipped", F.lit(False)))
    else:
        met = met.withColumn("clipped", F.lit(False))
    data = met.where("not above and not in_header and not clipped")
    placed = grids.token_columns(data.where("text is not null").select("grid", "row", "x0", "x1", "text"))
    cells = settled(read_cells(grids.split_cells(placed, small)))
    facts = settled(column_facts(cells))
    spans = facts.select("grid", "col", "c0", "c1")
    bands_read = settled(cells.select("grid", "row").distinct())
    rows = bands_read.groupBy("grid").agg(F.count("row").alias("n_rows"))
    named = settled(named_columns(labels, spans))
    status = settled(status_cells(cells, facts, rows, named))
    code_bucket = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_BUCKET.items() for x in kv]), F.col("code"))
    closed = status.where(code_bucket == "closed").select("grid", "row")
    money = settled(money_cells(cells, facts, small))
    numbers = small_numbers(cells, facts, rows, closed, named).join(money.select("grid", "col").distinct(), ["grid", "col"], "left_anti")
    values = settled(money.withColumn("kind", F.lit("money")).unionByName(numbers.withColumn("kind", F.lit("integer"))))
    # A row per candidate column and row band of its page: the few price and number columns, not all cells.
    candidates = values.groupBy("grid", "col").agg((F.max((F.col("kind") == "money").cast("int")) == 1).alias("money")).join(spans, ["grid", "col"])
    candidates = candidates.select("grid", "col", F.when(F.col("money"), "money").otherwise("integer").alias("kind"), F.col("c0").alias("x0"))
    each_band = bands_read.join(closed.withColumn("closed", F.lit(True)), ["grid", "row"], "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    full = settled(candidates.join(each_band, "grid").join(values.drop("kind"), ["grid", "col", "row"], "left").withColumn("col", F.col("col").cast("string")))
    price_roles = settled(recognition.assign_roles(full, named.withColumn("col", F.col("col").cast("string")), small))
    found = lambda df, role: df.select("grid", F.lit(role).alias("role"), F.col("col").cast("int").alias("col"), F.lit("content").alias("method"))
    by_price = price_roles.select("grid", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).cast("int").alias("col"), F.coalesce(F.col(f"{r}_method") if r in ("list", "sold") else F.lit(None), F.lit("content")).alias("method")) for r in ("list", "orig", "sold", "conc")]))).where("col is not null")
    roles = by_price.unionByName(found(status.select("grid", "col").distinct(), "status")).unionByName(found(mls_columns(facts), "mls")).unionByName(found(number_columns(cells, facts, rows, named), "index"))
    roles = settled(roles.unionByName(named.where("role = 'mt'").select("grid", "role", "col", F.lit("header").alias("method"))))

    # The cells of role columns with their value, a number, as that role reads it; then one group per row band.
    of_role = lambda df, *r: df.join(roles.where(F.col("role").isin(*r)).select("grid", "role", "col"), ["grid", "col"])
    read_as = F.when(F.col("role") == "mls", F.when(F.col("clean"), F.col("text").cast("bigint"))).when(F.col("role") == "index", F.col("number")).otherwise(F.when(F.col("number") <= DAYS_MAX, F.col("number")))
    codes = F.array(*[F.lit(c) for c in _CODES])
    as_role = of_role(values, "list", "orig", "sold", "conc").select("grid", "row", "role", "value")
    as_role = as_role.unionByName(of_role(cells, "mls", "index", "mt").select("grid", "row", "role", read_as.alias("value")))
    as_role = as_role.unionByName(status.select("grid", "row", F.lit("status").alias("role"), F.when(F.col("code").isNotNull(), F.array_position(codes, F.col("code"))).alias("value")))
    as_role = as_role.unionByName(bands_read.select("grid", "row", F.lit(None).cast("string").alias("role"), F.lit(None).cast("bigint").alias("value")))
    pick = lambda role: F.max(F.when(F.col("role") == role, F.col("value")))
    lines = as_role.groupBy("grid", "row").agg(
        F.count_if(F.col("role") == "status").alias("status_cells"), F.try_element_at(codes, pick("status").cast("int")).alias("status"),
        F.lpad(pick("mls").cast("string"), MLS_DIGITS, "0").alias("mls"), pick("index").alias("index"),
        *[pick(r).alias(c) for r, c in (("list", "list_price"), ("orig", "orig_price"), ("sold", "sold_price"), ("conc", "concessions"))],
        pick("mt").cast("int").alias("market_time"), F.count_if(F.col("role") == "mt").alias("mt_cells"),
    )
    prices = sum((F.col(c).isNotNull().cast("int") for c in ("list_price", "orig_price", "sold_price")), F.lit(0))
    judged = settled(recognition.kept_bands(lines.withColumns({"has_status": F.col("status_cells") > 0, "money": prices, "number": F.col("index")})))
    listings = judged.where("kept <> 'not a listing'").select(
        "grid", F.col("row").alias("n"), "index", "mls", "status", F.when(~F.col("has_status"), "no-cell").when(F.col("status").isNull(), "unread").alias("reject"), "list_price", "orig_price", "sold_price",
        F.col("concessions").cast("decimal(12,2)").alias("concessions"), "market_time", F.lit(False).alias("omit"),
    )
    plain = cells.select("grid", "col", "row", "x0", "x1", "text", "n_tokens")
    return Reading(listings, roles, plain, small, lambda: _counts(met, cells, judged, roles, price_roles), lambda counts: _notices(counts, listings, cells, roles))


def _counts(met: DataFrame, cells: DataFrame, judged: DataFrame, roles: DataFrame, price_roles: DataFrame) -> DataFrame:
    """What became of each page's tokens and bands, a row per page."""
    each = met.groupBy("grid").agg(
        F.count("*").alias("tokens"), F.count_if("above").alias("tokens_above"), F.countDistinct(F.when(F.col("above"), F.col("row"))).alias("rows_above"), F.count_if("in_header").alias("tokens_header"),
        F.count_if("clipped").alias("tokens_clipped"), F.countDistinct(F.when(F.col("clipped"), F.col("row"))).alias("rows_clipped"), F.max("header").alias("header"),
    )
    in_cells = cells.groupBy("grid").agg(F.sum("n_tokens").alias("tokens_placed"))
    facts = judged.groupBy("grid").agg(
        F.count("*").alias("bands"), F.count_if(F.col("kept") == "not a listing").alias("chrome"), F.count_if(F.col("kept") == "row without status").alias("no_cell"), F.count_if((F.col("kept") != "not a listing") & F.col("status").isNull()).alias("unread"),
        F.count("market_time").alias("mt_read"), F.count_if((F.col("mt_cells") > 0) & F.col("market_time").isNull()).alias("mt_unread"), F.count_if(F.col("mt_cells") == 0).alias("mt_blank"),
    )
    has = roles.groupBy("grid").agg(*[F.bool_or(F.col("role") == r).alias(f"has_{r}") for r in ROLES])
    counts = each.join(in_cells, "grid", "left").join(facts, "grid", "left").join(has, "grid", "left").join(price_roles.select("grid", "problems", "problem_kinds", "confidence"), "grid", "left")
    counts = counts.fillna(0, ["tokens_placed", "bands", "chrome", "no_cell", "unread", "mt_read", "mt_unread", "mt_blank"]).fillna(False, [f"has_{r}" for r in ROLES])
    no_money = F.col("problem_kinds").isNull()
    counts = counts.withColumn("no_money", no_money).withColumn("problems", F.coalesce("problems", F.lit(1))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return counts.withColumn("dropped", F.col("chrome") + F.col("rows_clipped") + F.col("rows_above")).withColumn("tokens_lost", F.col("tokens") - F.col("tokens_above") - F.col("tokens_header") - F.col("tokens_clipped") - F.col("tokens_placed"))


def pixels_clipped(bands: DataFrame) -> DataFrame:
    from marketlens.operators.pixels import clipped_rows

    return clipped_rows(bands).select("grid", "row", "clipped")


def _notices(counts: DataFrame, listings: DataFrame, cells: DataFrame, roles: DataFrame) -> DataFrame:
    """(grid, seq, level, text): what is said about each page, in order of the steps."""
    n, has = F.col, (lambda r: F.col(f"has_{r}"))
    header = n("header").isNotNull()
    index = roles.where("role = 'index'").select("grid", "col")
    numbers = cells.where("number is not null").join(index, ["grid", "col"], "left_semi").select("grid", "number")
    lost = counts.select("grid", (n("dropped") + n("unread")).alias("lost"))
    checked = market.number_check(listings.join(index.select("grid"), "grid", "left_semi").select("grid", F.col("index").alias("number")), numbers, "grid", lost=lost).select("grid", F.col("notices").alias("number_notices"))
    twice = market.duplicate_keys(listings, ["grid", "mls"]).groupBy("grid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mls", "times"))), lambda x: F.concat(x["mls"], F.lit(" ×"), x["times"].cast("string"))), ", ").alias("twice"))
    flagged = listings.select("grid", F.col("status").alias("code")).where("code is not null").distinct().withColumn("caution", read.caution(F.col("code"))).where("caution is not null")
    cautions = flagged.groupBy("grid").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "caution"))), lambda x: F.struct(F.lit("info").alias("level"), F.concat_ws(": ", x["code"], x["caution"]).alias("text"))).alias("cautions"))
    met = counts.join(checked, "grid", "left").join(twice, "grid", "left").join(cautions, "grid", "left")
    kind = lambda k: F.coalesce(F.array_contains("problem_kinds", k), F.lit(False))
    mt_level = recognition.market_time_level(header, has("mt"), n("mt_read"), n("mt_blank"), n("mt_unread"))
    some_blank = F.when(n("mt_blank") > 0, F.concat(*_filled("mt_and_blank", n("mt_blank")))).otherwise("")
    mt_text = (
        F.when(~has("mt"), F.when(header, PAGE["no_mt"]).otherwise(PAGE["no_mt_header"]))
        .when(n("mt_read") == 0, F.when((n("mt_blank") > 0) & (n("mt_unread") == 0), PAGE["mt_blank"]).otherwise(PAGE["mt_none"]))
        .otherwise(F.concat(*_filled("mt_some", n("mt_unread")), some_blank, F.lit(PAGE["mt_rests"])))
    )
    no_cell = F.when(n("no_cell") > 0, F.concat(*_filled("no_cell", n("no_cell")))).otherwise("")
    first = [
        _notice(~header, "warn", PAGE["no_header"]), _notice(n("rows_above") > 0, "info", *_filled("above", n("rows_above"))), _notice(n("rows_clipped") > 0, "warn", *_filled("clipped", n("rows_clipped"))),
        _notice(~has("status"), "error", PAGE["no_status"]), _notice(n("no_money"), "error", PAGE["no_money"]), *[_notice(kind(k), "error", PAGE[k]) for k in ("none_sold", "apart", "large")],
        _notice(n("confidence") < 0.9, "warn", *_filled("inferred", F.round(n("confidence") * 100).cast("int"))), _notice(~has("orig"), "info", PAGE["no_orig"]), _notice(~has("conc") & has("sold"), "info", PAGE["no_conc"]),
        _notice(mt_level.isNotNull(), mt_level, mt_text), _notice(n("chrome") > 0, "info", *_filled("chrome", n("chrome"))),
        _notice(n("unread") > 0, "warn", *_filled("unread", n("unread")), no_cell, PAGE["unread_rest"]),
    ]
    last = [_notice(~has("index"), "info", PAGE["no_numbers"]), _notice(n("twice").isNotNull(), "warn", *_filled("repeated", n("twice")))]
    none = F.array().cast("array<struct<level:string,text:string>>")
    all_ = F.concat(F.array_compact(F.array(*first)), F.coalesce("number_notices", none), F.array_compact(F.array(*last)), F.coalesce("cautions", none))
    return met.select("grid", F.posexplode(all_).alias("seq", "x")).select("grid", "seq", "x.level", "x.text")
