"""Vocabularies: status codes, buckets, column labels.  Small dimensions, safe to broadcast at any data size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The buckets in report order, and the price column that feeds each reported one.
BUCKETS = ["active", "pending", "closed", "excluded", "unclassified"]
REPORTED = ["active", "pending", "closed"]
BUCKET_LABEL = {"active": "Active listings", "pending": "Pending sales", "closed": "Closed sales"}

# Why a summary is provisional, and the lines of its text.
REASON = {
    "unresolved": " row(s) have no readable status",
    "unclassified": " row(s) carry an unrecognized status code",
    "unbalanced": "the row accounting does not balance",
    "errors": " unresolved problem(s) reported above",
    "dropped": " row band(s) could not be read",
    "role": "a money column could not be identified",
    "no_status": "no status column was found",
    "inferred": "the money columns were inferred, not read from a header",
    "unpriced": " row(s) have no readable price",
    "no_days": " row(s) have no market time",
}
BANNER, BANNER_ITEM = "*** PROVISIONAL — do not use without checking: ***", "***   • "
REPORT_FOOTER = "Prices: list price for active and pending, sold price for closed. Median of an even count is the mean of the two middle values. Ratio = (sold − concessions) ÷ original list price."
FORM_TITLE, FORM_GROUP = "Search Result Metrics", {"active": "Active Listings", "sales": "Sales Within Lookback Period", "pending": "Pending Sales"}
FORM_FOOTER = "Prices are bare numbers — the form supplies the $ and the commas. Days on market is the median MT of the active listings."

# Code, default bucket.
STATUS_BUCKET = {
    "ACTV": "active",
    "PCHG": "active",
    "NEW": "active",
    "RACT": "active",
    "BOMK": "active",
    "AUCT": "active",
    "TEMP": "active",
    "PRIV": "active",
    "PEND": "pending",
    "FIN": "pending",
    "A/I": "pending",
    "CTGO": "pending",
    "CTG": "pending",
    "SS": "pending",
    "HS": "pending",
    "HC": "pending",
    "PS": "pending",
    "PC": "pending",
    "CLSD": "closed",
    "CTGA": "excluded",
    "EXP": "excluded",
    "CANC": "excluded",
    "RNTD": "excluded",
    "HOLD": "excluded",
    "DRF": "excluded",
    "S": "closed",
    "A": "active",
    "P": "pending",
}

# Codes that carry a caution, each with a note in our own words; fixed values: the codes, and those printed with hours appended.
CAUTION = {
    "AUCT": "list price may be a reserve or an opening bid",
    "PRIV": "not exposed to the open market",
    "A/I": "some sources class this code as active",
    "CTGO": "nature of the contingency is unknown",
    "SS": "may not be an arm's-length sale",
    "HS": "seller may still take other offers",
    "RNTD": "a lease is not a sale",
}
KICKOUT = ["HS", "HC", "PS", "PC"]

# The labels that bind each role of an export.
ROLE_LABELS = {
    "status": ["Stat", "Status"],
    "mls": ["MLS #", "MLS Number", "MLS No"],
    "list": ["List Price", "Current Price", "Current List Price"],
    "orig": ["Orig List Pr", "Orig List Price", "Original List Price"],
    "sold": ["Sold Pr", "Sold Price", "Close Price", "Closed Price", "Closed Pr"],
    "conc": ["CONC", "Concessions", "Seller Concessions"],
    "mt": ["MT", "Market Time", "DOM", "Days on Market"],
}
ANCHORS = ["status", "mls", "list", "orig", "sold"]

# Labels of an image's header row and their roles; date, text and num only keep other columns apart.
HEADER_VOCABULARY = {
    "Stat": "status",
    "Status": "status",
    "List Price": "list",
    "Current Price": "list",
    "Sold Pr": "sold",
    "Sold Price": "sold",
    "Closed Pr": "sold",
    "Orig List Pr": "orig",
    "Orig List Price": "orig",
    "CONC": "conc",
    "Conc": "conc",
    "MLS #": "mls",
    "Closed Date": "date",
    "City": "text",
    "Street #": "text",
    "Str Name": "text",
    "Sfx": "text",
    "MT": "mt",
    "Market Time": "mt",
    "# Rms": "num",
    "ASF": "num",
    "Yr Blt": "num",
    "All Beds": "num",
    "# Full Baths": "num",
    "# Half Baths": "num",
    "Type": "text",
    "# Garage": "num",
}

# The words of the notices about a grid's row numbers.
NUMBERS = {
    "absent": "are missing from the summary below. Those listings are not in any count.",
    "unread": " row number(s) could not be read, but every row band was. No listing is missing.",
    "later": ", not 1. If this is the first page of your results, rows 1–",
    "above": " are above the top of the screenshot and are not in this summary.",
    "all": " were all read — no rows were dropped.",
}

# The words of the notices about a page that was read; {} takes a number, a list or a code.
PAGE = {
    "no_header": "No header row was recognized, so the money columns had to be identified from the data itself. Check the column map under Recognition Detail before using these numbers.",
    "above": "{} row band(s) above the header row were ignored (toolbar or result-count line).",
    "clipped": "{} row(s) were cut off by the edge of the screenshot and could not be read. Re-take the screenshot with whole rows to include them.",
    "no_status": 'No status column was found. Every listing needs a "Stat" value to be counted — make sure the Stat column is inside the pasted screenshot.',
    "no_money": "No money column was found in this image. Prices are located by their dollar sign and thousands separator — make sure the price columns are inside the screenshot and not cut off.",
    "none_sold": "No column behaves like a sold-price column — none is populated on the closed rows and empty on the rest. Closed sales cannot be summarized without one.",
    "apart": "The column taken as the sold price has a median too far from the list median to be the same market. The sold column was rejected.",
    "large": "The column taken as concessions is too large relative to the sold prices; concessions were not used.",
    "inferred": "Money columns were inferred rather than read from a header (confidence {}%).",
    "no_orig": 'No "Orig List Pr" column was found, so no sale-to-list ratios could be computed. Include that column in the screenshot to get them.',
    "no_conc": "No concessions (CONC) column was found. Sale-to-list ratios treat concessions as zero.",
    "no_mt": 'The header named no "MT" (market time) column, so no median days on market could be computed. Include the MT column in the screenshot to get it — it cannot be inferred, because a column of small whole numbers could equally be # Rms or Yr Blt.',
    "no_mt_header": "No header row was recognized, so the MT (market time) column could not be identified and no median days on market is reported. MT is a column of small whole numbers, and so are # Rms, Yr Blt, All Beds and ASF — nothing in the data itself tells them apart, so the app will not guess. Re-take the screenshot with the header row included.",
    "mt_blank": "The MT (market time) column was found but every cell in it is empty, so there is no median days on market.",
    "mt_none": "The MT (market time) column was found, but no cell in it read as a day count — so there is no median days on market. Check the column map under Recognition Detail against your screenshot, or fill the values in by hand.",
    "mt_some": "{} MT (market time) cell(s) could not be read",
    "mt_and_blank": " and {} were blank",
    "mt_rests": ". Any median days on market below rests on the rows that did carry one — fill them in below to complete it.",
    "chrome": "{} row band(s) carried no status, price, MLS number or row number and were treated as page chrome rather than listings.",
    "unread": "{} status value(s) could not be read",
    "no_cell": " ({} of them had no status cell at all)",
    "unread_rest": ". Those rows are listed below and are excluded from every count until you set a status for them.",
    "no_numbers": "The grid has no readable row-number column, so the app cannot independently confirm that every row was read. Compare the count below against your search results.",
    "repeated": "The same MLS number appears more than once: {}. One property counted twice will skew the median — untick the duplicate below.",
}

# The words of the notices about an export; {} takes a number, a name or a list.
ROLE_NAME = {"status": "status", "mls": "MLS number", "list": "list price", "orig": "original list price", "sold": "sold price", "conc": "concessions", "mt": "market time"}
EXPORT = {
    "above": "{} line(s) above the header row were ignored.",
    "ambiguous": "More than one column could be the {}",
    "ambiguous_rest": ", so none of them was used. Remove the extra column from the export.",
    "unbalanced": "Row accounting does not balance. Do not rely on these numbers.",
    "no_status": 'The file has no "Stat" or "Status" column. Every listing needs a status to be counted — add that column to the export.',
    "no_list": 'The file has no "List Price" or "Current Price" column, so active listings and pending sales cannot be priced.',
    "no_sold": 'The file has no "Sold Pr" or "Close Price" column, so closed sales cannot be priced. The list price is not substituted.',
    "no_orig": 'The file has no "Orig List Pr" or "Original List Price" column, so no sale-to-list ratios could be computed.',
    "no_conc": "The file has no concessions (CONC) column. Sale-to-list ratios treat concessions as zero.",
    "no_mt": 'The file has no "MT" or "DOM" column, so no median days on market could be computed. (CDOM is not used: cumulative days on market survives a relisting, so it is a different number.)',
    "malformed": "{} record(s) do not have the header's ",
    "malformed_rest": ", so their values may sit under the wrong headings and none of them was used. They are listed below with no status — fix the export, or enter them by hand.",
    "refused": "{} cell(s) could not be read as a number and were left empty rather than guessed at: ",
    "blank_status": "{} row(s) have an empty status ",
    "blank_status_rest": ". They are listed below and are excluded from every count until you set a status for them.",
    "empty": "{} record(s) had every field empty and were not treated as listings.",
    "blank_mt": "{} row(s) have an empty ",
    "blank_mt_rest": " cell. Each bucket's median days on market rests on the rows that carry one, and says so.",
    "ok": "All {} rows of ",
    "ok_rest": " were read — no rows were dropped.",
}
# What is said of a file that is neither a picture nor an export.
NO_WORKBOOK = "An Excel workbook cannot be read directly. Save it as CSV (or export the search as CSV or TSV) and drop that in instead."
NO_FILE = "That is neither a screenshot nor an export. Paste a PNG or JPG screenshot, or drop in a .csv or .tsv file."

# Bounds of accepted figures.
PRICE_MIN, PRICE_MAX, DAYS_MAX, COMP_LIST_MAX = 1_000, 30_000_000, 3_650, 10


def label_key(label: str) -> str:
    return "".join(c for c in label.lower() if c.isascii() and c.isalnum())


def status_table(spark: SparkSession) -> DataFrame:
    """code, bucket, caution."""
    return spark.createDataFrame([(c, b, CAUTION.get(c)) for c, b in STATUS_BUCKET.items()], "code string, bucket string, caution string")
