"""Report forms of a bucket summary: form fields, bucket and row tables, narrative text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import cells
from marketlens.functions.vocab import BANNER, BANNER_ITEM, BUCKET_LABEL, COMP_LIST_MAX, FORM_FOOTER, FORM_GROUP, FORM_TITLE, REPORT_FOOTER, REPORTED

# The form's fields in order (group, label, bucket, figure, unit).
FORM = [
    ("active", "Active Listings", "active", "n_rows", "listings"),
    ("active", "Median Days on Market", "active", "dom_median", "days"),
    ("active", "Lowest List Price", "active", "low", None),
    ("active", "Median List Price", "active", "median_price", None),
    ("active", "Highest List Price", "active", "high", None),
    ("sales", "Sales in Lookback Period", "closed", "n_rows", "sales"),
    ("sales", "Lowest Sale Price", "closed", "low", None),
    ("sales", "Median Sale Price", "closed", "median_price", None),
    ("sales", "Highest Sale Price", "closed", "high", None),
    ("pending", "Pending Sales", "pending", "n_rows", "sales"),
]


def form_fields(summary: DataFrame) -> DataFrame:
    """The ten fields of the form, in order: seq, grp, label, value, display, unit."""
    one = {"listings": "listing", "sales": "sale"}
    rows = []
    for i, (group, label, bucket, figure, unit) in enumerate(FORM):
        value = F.max(F.when(F.col("bucket") == bucket, F.col(figure)))
        money = unit is None
        display = cells.dollars(value) if money else F.coalesce(F.format_number(value.cast("bigint"), 0), F.lit(cells.DASH))
        if figure == "n_rows":
            display = value.cast("string")
        named = F.when(value == 1, one[unit]).otherwise(unit) if unit in one else F.lit(unit).cast("string")
        rows.append(F.struct(F.lit(i).alias("seq"), F.lit(group).alias("grp"), F.lit(label).alias("label"), value.cast("bigint").cast("string").alias("value"), display.alias("display"), named.alias("unit")))
    return summary.agg(F.array(*rows).alias("f")).select(F.inline("f"))


def form_text(fields: DataFrame) -> DataFrame:
    """One line per field: the label padded with dots, the bare value, the unit."""
    label = F.concat(F.lit("  "), F.rpad(F.concat("label", F.lit(" ")), 26, "."), F.lit(" "), F.coalesce("value", F.lit(cells.DASH)))
    return fields.select("seq", F.concat(label, F.when(F.col("value").isNotNull() & F.col("unit").isNotNull(), F.concat(F.lit(" "), F.col("unit"))).otherwise("")).alias("line"))


def _cell(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def bucket_table(summary: DataFrame, unresolved: DataFrame) -> DataFrame:
    """The spreadsheet rows: three buckets in order, then what was not counted and what was unreadable.

    ``unresolved`` is one row with a column ``unresolved``.
    """
    label = F.element_at(F.create_map(*[F.lit(x) for kv in BUCKET_LABEL.items() for x in kv]), F.col("bucket"))
    percent = lambda c: F.when(F.col("ratio_rows") > 0, cells.percent(F.col(c))).otherwise("")
    order = F.array_position(F.array(*[F.lit(b) for b in REPORTED]), F.col("bucket")).cast("int")
    names = ["category", "n_rows", "priced", "low", "high", "median", "median_dom", "dom_rows", "ratio_low", "ratio_high", "ratio_median"]
    figures = [_cell(F.col(c)) for c in ("n_rows", "priced", "low", "high", "median_price", "dom_median")]
    dom_rows = F.when(F.col("dom_rows") > 0, _cell(F.col("dom_rows"))).otherwise("")
    counted = summary.where(F.col("bucket").isin(*REPORTED)).select(order.alias("seq"), *[c.alias(n) for c, n in zip([label, *figures, dom_rows, percent("ratio_low"), percent("ratio_high"), percent("ratio_median")], names)])
    rest = [F.lit("").alias(n) for n in names[2:]]
    excluded = summary.where(F.col("bucket") == "excluded").select(F.lit(4).alias("seq"), F.lit("Not counted").alias("category"), _cell(F.col("n_rows")).alias("n_rows"), *rest)
    unread = unresolved.select(F.lit(5).alias("seq"), F.lit("Unreadable").alias("category"), _cell(F.col("unresolved")).alias("n_rows"), *rest)
    return counted.unionByName(excluded).unionByName(unread)


def row_table(rows: DataFrame) -> DataFrame:
    """One spreadsheet row per listing, empty cells for missing values."""
    category = F.when(F.col("placement") == "omitted", "skipped").when(F.col("placement") == "unresolved", "unread").otherwise(F.col("placement"))
    return rows.select(
        "n", _cell(F.col("mls")).alias("mls"), _cell(F.col("status")).alias("status"), category.alias("category"), _cell(F.col("orig_price")).alias("orig_list"), _cell(F.col("list_price")).alias("list_price"),
        _cell(F.col("sold_price")).alias("sold_price"), _cell(F.col("concessions")).alias("concessions"), _cell(F.col("market_time")).alias("mt"), _cell(F.col("price")).alias("counted"),
        F.when(F.col("ratio").isNotNull(), cells.percent(F.col("ratio"))).otherwise("").alias("sale_list"),
    )


def write_tsv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def comp_lines(comps: DataFrame) -> DataFrame:
    """Text of each comparable: its number padded, then its ratio or why it has none."""
    # The words of a comparable's line.
    label = F.concat(F.lit("   Comp "), F.col("comp").cast("string"), F.lit(":"))
    padded = F.when(F.length(label) >= 12, label).otherwise(F.rpad(label, 12, " "))
    why = F.concat(F.lit(f" {cells.DASH}   (no original list price"), F.when(F.col("price").isNull(), " or sold price").otherwise(""), F.lit(")"))
    return comps.withColumn("line", F.concat(padded, F.when(F.col("ratio").isNull(), why).otherwise(F.concat(F.lit(" "), cells.percent(F.col("ratio"))))))


def _banner(gate: DataFrame, by: list[str]) -> DataFrame:
    """The warning that a provisional summary carries: a title, its reasons, an empty line."""
    lines = F.concat(F.array(F.lit(BANNER)), F.transform("reason_list", lambda r: F.concat(F.lit(BANNER_ITEM), r)), F.array(F.lit("")))
    return gate.where("provisional").select(*by, F.posexplode(lines).alias("seq", "line")).withColumn("seq", F.col("seq") - 1000)


def report_lines(summary: DataFrame, counts: DataFrame, gate: DataFrame, comps: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """The narrative, a line per row (by..., seq, line): a banner if provisional, figures of each bucket with the
    comparables of a small closed set, what was left out, and a footer.

    ``counts`` is :func:`marketlens.operators.market.accounting`, ``gate`` and ``comps`` the operators of those names.
    """
    by = by or []
    label = F.element_at(F.create_map(*[F.lit(x) for kv in BUCKET_LABEL.items() for x in kv]), F.col("bucket"))
    base = (F.array_position(F.array(*[F.lit(b) for b in REPORTED]), F.col("bucket")) * 100).cast("int")
    n = lambda c: F.col(c).cast("string")
    # The words of the lines.
    head = F.when(F.col("n_rows") == 0, F.concat(label, F.lit(": 0"))).otherwise(
        F.concat(
            label, F.lit(": "), n("n_rows"), F.lit("   Low "), cells.dollars(F.col("low")), F.lit("   High "), cells.dollars(F.col("high")), F.lit("   Median "), cells.dollars(F.col("median_price")),
            F.when(F.col("missing") > 0, F.concat(F.lit("   ("), n("priced"), F.lit(" of "), n("n_rows"), F.lit(" priced)"))).otherwise(""),
        )
    )
    part = lambda rows, words: F.when(F.col(rows) < F.col("n_rows"), F.concat(F.lit("   ("), n(rows), F.lit(" of "), n("n_rows"), F.lit(words))).otherwise("")
    dom = F.when(F.col("dom_rows") > 0, F.concat(F.lit("   Median days on market: "), cells.day_count(F.col("dom_median")), part("dom_rows", " rows carried a market time)")))
    ratio = F.when(
        (F.col("bucket") == "closed") & (F.col("ratio_rows") > 0),
        F.concat(F.lit("   Sale/list ratio, net of concessions: Low "), cells.percent(F.col("ratio_low")), F.lit("   High "), cells.percent(F.col("ratio_high")), F.lit("   Median "), cells.percent(F.col("ratio_median")), part("ratio_rows", " with an original list price)")),
    )
    lines = F.filter(F.array(*[F.struct((base + i).alias("seq"), c.alias("line")) for i, c in enumerate((head, dom, ratio))]), lambda x: x["line"].isNotNull())
    body = summary.where(F.col("bucket").isin(*REPORTED)).select(*by, F.inline(lines))
    tail = [("excluded", "Not counted: "), ("unclassified", "Unrecognized status codes: "), ("unresolved", "Unreadable status: "), ("omitted", "Manually excluded: ")]
    left = [F.struct(F.lit(900 + i).alias("seq"), F.when(F.col(c) > 0, F.concat(F.lit(t), n(c))).alias("line")) for i, (c, t) in enumerate(tail)]
    footer = [F.struct(F.lit(910 + i).alias("seq"), F.lit(t).alias("line")) for i, t in enumerate(("", REPORT_FOOTER))]
    out = body.unionByName(counts.select(*by, F.inline(F.filter(F.array(*left, *footer), lambda x: x["line"].isNotNull())))).unionByName(_banner(gate, by))
    if comps is not None:
        out = out.unionByName(comp_lines(comps.where(F.col("comp") <= COMP_LIST_MAX)).select(*by, (F.lit(310) + F.col("comp")).cast("int").alias("seq"), "line"))
    return out


def form_lines(fields: DataFrame, gate: DataFrame) -> DataFrame:
    """The form as text, a line per row (seq, line): banner, title, the groups with their fields, footer."""
    group = F.array_position(F.array(*[F.lit(g) for g in FORM_GROUP]), F.col("grp"))
    own = form_text(fields.withColumn("place", (group * 100 + F.col("seq")).cast("int")).drop("seq").withColumnRenamed("place", "seq"))
    fixed = [(0, FORM_TITLE), (900, ""), (901, FORM_FOOTER)] + [row for i, title in enumerate(FORM_GROUP.values(), 1) for row in ((i * 100 - 2, ""), (i * 100 - 1, title))]
    frame = fields.sparkSession.createDataFrame(fixed, "seq int, line string")
    return own.unionByName(frame).unionByName(_banner(gate, []))


def report_text(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The lines of each report as one text (a report has a few dozen lines at most)."""
    return lines.groupBy(*(by or [])).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("report"))


def render(form: str, summary: DataFrame, counts: DataFrame, gate: DataFrame, comps: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """The output of a format: "text", "form", "tsv" (bucket table) or "rows" (row table)."""
    if form == "text":
        return report_text(report_lines(summary, counts, gate, comps))
    if form == "form":
        return report_text(form_lines(form_fields(summary), gate))
    if form == "tsv":
        return bucket_table(summary, counts.select("unresolved"))
    if form == "rows":
        return row_table(rows)
    raise ValueError(f"unknown format: {form}")


def days_note(summary: DataFrame) -> DataFrame:
    """What the form says about its days field, from the active and closed rows of a summary."""
    of = lambda b, c: F.max(F.when(F.col("bucket") == b, F.col(c)))
    named = [of(b, c).alias(f"{b}_{c}") for b in ("active", "closed") for c in ("n_rows", "dom_rows", "dom_median")]
    text = lambda *parts: F.concat(*[F.lit(p) if p.startswith((" ", ".", "(")) or not p.startswith("@") else F.col(p[1:]).cast("string") for p in parts])
    # The words of the note.
    closed = F.when(
        F.col("closed_dom_rows") > 0,
        F.concat(F.lit(" Closed sales: "), cells.day_count(F.col("closed_dom_median")), F.lit(" days"), F.when(F.col("closed_dom_rows") < F.col("closed_n_rows"), text(" (", "@closed_dom_rows", " of ", "@closed_n_rows", " sales)")).otherwise(""), F.lit(".")),
    ).otherwise("")
    note = (
        F.when(F.col("active_n_rows") == 0, "No active listings in this search.")
        .when(F.col("active_dom_rows") == 0, "No market time was read for the active listings.")
        .when(F.col("active_dom_rows") < F.col("active_n_rows"), text("Rests on ", "@active_dom_rows", " of ", "@active_n_rows", " active listings."))
        .otherwise(F.concat(text("Median MT of all ", "@active_n_rows", " active listings."), closed))
    )
    return summary.agg(*named).select(note.alias("note"))
