"""Delimited exports: files to records to typed listing rows, with every record accounted for.

The record splitter needs physical line numbers, stray text after quotes and whole-file failure, which Spark's
CSV reader does not give, so splitting (and decoding) runs per file in Arrow tasks; files are limited to
``MAX_BYTES``, so one file is a bounded unit of work.  Everything after it is joins, grouping and expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions import cells
from marketlens.functions.vocab import ANCHORS, EXPORT, NO_FILE, NO_WORKBOOK, PAGE, ROLE_LABELS, ROLE_NAME, label_key

#: Larger files are refused.
MAX_BYTES = 20 << 20
#: Records among which a header is looked for.
HEADER_RECORDS = 10
SNIFF_CHARS = 20_000

RECORD = "file string, encoding string, delimiter string, rec_no int, line int, fields array<string>, stray boolean, error string"


def decode(content: bytes) -> tuple[str, str]:
    """Text and encoding: a byte-order mark is believed, else strict UTF-8, else Windows-1252."""
    for mark, name, label in ((b"\xef\xbb\xbf", "utf-8", "UTF-8"), (b"\xff\xfe", "utf-16-le", "UTF-16LE"), (b"\xfe\xff", "utf-16-be", "UTF-16BE")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), label
    try:
        return content.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError:
        # The five bytes that the code page leaves open stand for the control characters of the same number.
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in content), "Windows-1252"


def delimiter_of(text: str, name: str = "") -> str:
    """Tab or comma, by what stands outside quotes on the first line; the extension breaks a tie."""
    first = re.match(r'(?:"[^"]*(?:"|\Z)|[^"\r\n])*', text)[0]
    bare = re.sub(r'"[^"]*(?:"|\Z)', "", first)
    tabs, commas = bare.count("\t"), bare.count(",")
    if tabs and tabs >= commas:
        return "\t"
    return "," if commas or not name.lower().endswith(".tsv") else "\t"


def _field_pattern(delimiter: str) -> re.Pattern:
    d = re.escape(delimiter)
    return re.compile(rf'(?:"(?P<quoted>(?:[^"]|"")*+)(?P<close>"?)(?P<after>[^{d}\r\n]*)|(?P<plain>[^{d}\r\n]*))(?P<end>{d}|\r\n|\r|\n|\Z)')


def split(text: str, delimiter: str) -> tuple[list[tuple[int, list[str], bool]], str | None]:
    """Records as (start line, fields, stray), and why the file cannot be split, if so.

    A field that starts with a quote is quoted; a doubled quote is a quote; text after the closing quote is kept
    and makes the record stray; lines with nothing on them are no records; an open quote fails the file.
    """
    records: list[tuple[int, list[str], bool]] = []
    fields: list[str] = []
    line = start = 1
    stray, bare, at = False, True, 0
    match = _field_pattern(delimiter).match
    while at <= len(text):
        m = match(text, at)
        quoted = m["quoted"] is not None
        if quoted and not m["close"]:
            return records, f"a quote opened on line {line} is never closed"
        if quoted:
            line += len(re.findall(r"\r\n|\r|\n", m["quoted"]))
            stray |= m["after"] != ""
        bare = bare and not quoted
        fields.append(m["quoted"].replace('""', '"') + m["after"] if quoted else m["plain"])
        at = m.end()
        if m["end"] == delimiter:
            if at == len(text):
                fields.append("")
                records.append((start, fields, stray))
                break
            continue
        if len(fields) > 1 or fields[0] or not bare:
            records.append((start, fields, stray))
        if not m["end"]:
            break
        line += 1
        fields, stray, bare, start = [], False, True, line
        if at == len(text):
            break
    return records, None


def _file_rows(name: str, content: bytes | str | None) -> Iterator[tuple]:
    if content is None:
        yield name, None, None, None, None, None, None, "file is larger than the limit"
        return
    text, encoding = (content, None) if isinstance(content, str) else decode(content)
    text = text.removeprefix("﻿")
    if not text.strip():
        yield name, encoding, None, None, None, None, None, "file is empty"
        return
    d = delimiter_of(text, name)
    label = "tab" if d == "\t" else "comma"
    records, why = split(text, d)
    if why:
        yield name, encoding, label, None, None, None, None, why
        return
    for i, (line, fields, stray) in enumerate(records, 1):
        yield name, encoding, label, i, line, fields, stray, None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.string()]
    names = ["file", "encoding", "delimiter", "rec_no", "line", "fields", "stray", "error"]
    for batch in batches:
        for name, content in zip(batch["file"].to_pylist(), batch["content"]):
            rows = list(_file_rows(name, content.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_files(spark: SparkSession, path: str, glob: str = "*.{csv,tsv,tab,txt}") -> DataFrame:
    """(file, content) of the table files under a path; content is null beyond the size limit."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    small = found.where(F.col("length") <= MAX_BYTES).select(F.col("path").alias("file"), "content")
    # Contents of larger files are not read at all.
    large = found.where(F.col("length") > MAX_BYTES).select(F.col("path").alias("file"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def from_text(spark: SparkSession, text: str, name: str = "pasted table") -> DataFrame:
    return spark.createDataFrame([(name, text)], "file string, content string")


def records(files: DataFrame) -> DataFrame:
    """One row per record of each file; a file that cannot be read is one row with an error."""
    return files.select("file", "content").mapInArrow(_records, RECORD)


def _bound(fields):
    """The role of each field, by its label."""
    table = F.create_map(*[F.lit(x) for r, labels in ROLE_LABELS.items() for label in labels for x in (label_key(label), r)])
    return F.transform(fields, lambda f: F.element_at(table, cells.label_key(f)))


def headers(recs: DataFrame) -> DataFrame:
    """One row per file with a header: rec_no, width, bound roles (role, at, label) and ambiguous roles.

    The header is the first of the first records that names two anchor roles.  A role that two columns claim
    binds neither, but counts as an anchor.
    """
    roles = recs.where(F.col("rec_no") <= HEADER_RECORDS).withColumn("roles", _bound(F.col("fields")))
    anchors = F.size(F.array_intersect(F.array_compact("roles"), F.array(*[F.lit(a) for a in ANCHORS])))
    first = roles.where(anchors >= 2).groupBy("file").agg(F.min_by(F.struct("rec_no", "line", "fields", "roles"), "rec_no").alias("h"))
    claims = F.transform(
        F.array(*[F.lit(r) for r in ROLE_LABELS]),
        lambda r: F.struct(r.alias("role"), F.array_compact(F.transform(F.col("h.roles"), lambda x, i: F.when(x == r, i))).alias("at")),
    )
    label = lambda i: cells.trimmed(F.get(F.col("h.fields"), i))
    bound = F.transform(F.filter("claims", lambda c: F.size(c["at"]) == 1), lambda c: F.struct(c["role"].alias("role"), c["at"][0].alias("at"), label(c["at"][0]).alias("label")))
    twice = F.transform(F.filter("claims", lambda c: F.size(c["at"]) > 1), lambda c: F.struct(c["role"].alias("role"), F.transform(c["at"], label).alias("labels")))
    named = first.withColumn("claims", claims)
    return named.select("file", F.col("h.rec_no").alias("header_no"), F.col("h.line").alias("header_line"), F.size("h.fields").alias("width"), bound.alias("bound"), twice.alias("ambiguous"))


def listings(recs: DataFrame) -> DataFrame:
    """Typed rows of every record below its file's header.

    kind is "row", "malformed" (kept without values: its width or quoting is off) or "empty" (every field blank).
    """
    head = headers(recs)
    body = recs.join(head, "file").where(F.col("rec_no") > F.col("header_no"))
    blank = lambda a: F.forall(a, lambda x: cells.trimmed(x) == "")
    surplus = (F.size("fields") > F.col("width")) & blank(F.slice("fields", F.col("width") + 1, F.size("fields")))
    kind = F.when(blank(F.col("fields")), "empty").when(F.col("stray") | ((F.size("fields") != F.col("width")) & ~surplus), "malformed").otherwise("row")
    get = lambda role: F.try_element_at(F.filter("bound", lambda b: b["role"] == role), F.lit(1))["at"]
    raw = {role: F.when(F.col("kind") == "row", F.get(F.col("fields"), F.coalesce(get(role), F.lit(-1)))) for role in ROLE_LABELS}
    rows = body.withColumn("kind", kind).withColumns({f"raw_{r}": c for r, c in raw.items()}).withColumn("has_status", get("status").isNotNull())
    parsed = rows.withColumns({"list": cells.money(F.col("raw_list")), "orig": cells.money(F.col("raw_orig")), "sold": cells.money(F.col("raw_sold")), "conc": cells.money(F.col("raw_conc"), True), "mt": cells.days(F.col("raw_mt"))})
    status = cells.status_text(F.col("raw_status"))
    reject = F.when(F.col("kind") == "malformed", "malformed").when(F.col("status").isNull(), F.when(F.col("has_status"), "blank").otherwise("no-column"))
    refused = F.filter(
        F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"raw_{r}").alias("raw"), F.col(f"{r}.state").alias("state"), F.col(f"{r}.why").alias("why")) for r in ("list", "orig", "sold", "conc", "mt")]), lambda x: x["state"] == "error"
    )
    numbered = parsed.withColumn("n", F.when(F.col("kind") != "empty", F.sum(F.when(F.col("kind") != "empty", 1).otherwise(0)).over(W.partitionBy("file").orderBy("rec_no"))))
    return numbered.withColumn("status", status).select(
        "file", F.col("n").cast("int").alias("n"), "line", "kind", F.nullif(cells.trimmed(F.col("raw_mls")), F.lit("")).alias("mls"), "status",
        F.col("list.value").alias("list_price"), F.col("orig.value").alias("orig_price"), F.col("sold.value").alias("sold_price"),
        F.col("conc.value").alias("concessions"), F.col("mt.value").alias("market_time"),
        F.when(F.col("kind") != "empty", reject).alias("reject"), refused.alias("refused"), F.lit(False).alias("omit"),
    )


def reviews(recs: DataFrame) -> DataFrame:
    """What the gate needs to know of each file: errors, dropped records, role problems, columns found."""
    rows = listings(recs)
    head = headers(recs)
    totals = recs.groupBy("file").agg(F.count("rec_no").alias("records"), F.max("error").alias("failure"))
    by_file = rows.groupBy("file").agg(
        F.count("*").alias("placed"), F.count_if(F.col("kind") == "empty").alias("empty"), F.count_if(F.col("kind") == "malformed").alias("malformed"),
        F.sum(F.size("refused")).alias("refused"), F.count_if((F.col("kind") == "row") & (F.col("reject") == "blank")).alias("blank_status"),
        F.count_if((F.col("kind") == "row") & F.col("market_time").isNull()).alias("blank_mt"),
    )
    has = lambda role: F.exists("bound", lambda b: b["role"] == role)
    doubtful = lambda role: F.exists("ambiguous", lambda b: b["role"] == role)
    joined = totals.join(head, "file", "left").join(by_file, "file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    accounted = zero("placed") == F.col("records") - F.col("header_no")
    no_header = F.col("header_no").isNull()
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    errors = one(no_header) + F.coalesce(F.size("ambiguous"), F.lit(0)) + one(~has("status") & ~doubtful("status")) + one(zero("malformed") > 0) + one(zero("refused") > 0) + one(~accounted)
    return joined.select(
        "file", F.coalesce("failure", F.when(no_header, "no header names two known columns")).alias("failure"), "header_line", "records",
        zero("placed").alias("placed"), zero("empty").alias("empty"), zero("malformed").alias("malformed"), zero("refused").alias("refused"), zero("blank_status").alias("blank_status"), zero("blank_mt").alias("blank_mt"),
        F.coalesce(accounted, F.lit(False)).alias("accounted"), errors.cast("long").alias("errors"),
        (zero("empty") + F.coalesce(F.col("header_no") - 1, F.lit(0))).cast("long").alias("dropped"),
        F.coalesce(F.size("ambiguous"), F.lit(0)).cast("long").alias("role_problems"),
        F.coalesce(~has("status"), F.lit(True)).alias("no_status_column"), F.coalesce(has("mt"), F.lit(False)).alias("has_market_time"), F.lit(1.0).alias("confidence"), F.lit("file").alias("source"),
    )


def value_counts(rows: DataFrame) -> DataFrame:
    """Values read per role and file."""
    kept = rows.where(F.col("kind") != "empty")
    return kept.groupBy("file").agg(*[F.count(c).alias(a) for c, a in (("status", "status"), ("mls", "mls"), ("list_price", "list"), ("orig_price", "orig"), ("sold_price", "sold"), ("concessions", "conc"), ("market_time", "mt"))])


def looks_like_table(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` (file, text) with looks_like_table: the first characters hold more than one line and a header."""
    head = texts.select("file", F.substring(F.col(text), 1, SNIFF_CHARS).alias("content"))
    found = headers(records(head.where(F.col("content").rlike(r"[\r\n]")))).select("file", F.lit(True).alias("found"))
    return texts.join(found, "file", "left").withColumn("looks_like_table", F.coalesce("found", F.lit(False))).drop("found")


def routed(files: DataFrame, name: str = "name", mime: str = "mime") -> DataFrame:
    """``files`` with ``route`` ("image", "table" or null) and, where a file is neither, ``refusal``.

    A picture's type comes first; an export goes by its extension and, without one, by its type, as systems often give a
    table file no type at all.
    """
    kind, lower = F.coalesce(F.col(mime), F.lit("")), F.lower(F.coalesce(F.col(name), F.lit("")))
    is_table = lower.rlike(r"\.(csv|tsv|tab|txt)$") | F.lower(kind).rlike("^text/(csv|tab-separated-values|plain)$")
    route = F.when(kind.startswith("image/"), "image").when(is_table, "table")
    return files.withColumn("route", route).withColumn("refusal", F.when(F.col("route").isNull(), F.when(lower.rlike(r"\.xlsx?$"), NO_WORKBOOK).otherwise(NO_FILE)))


SHOWN_REFUSED = 6


def notices(recs: DataFrame) -> DataFrame:
    """(file, seq, level, text): what is said about each file that could be read, in order of the steps.

    What only the first few are listed of (lines, refused cells) is listed in order of lines.
    """
    rows, head = listings(recs), headers(recs)
    n = F.col
    lines = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("line"))))  # noqa: E731  (records of one file)
    blank = (F.col("kind") == "row") & (F.col("reject") == "blank")
    of_file = rows.groupBy("file").agg(lines(F.col("kind") == "malformed").alias("malformed"), lines(blank).alias("blank_status"), F.count_if(F.col("kind") != "empty").alias("n_rows"), F.count_if((F.col("kind") != "empty") & F.col("status").isNull()).alias("no_status"))
    label_of = F.create_map(*[x for r in ROLE_LABELS for x in (F.lit(r), F.try_element_at(F.filter("bound", lambda b: b["role"] == r), F.lit(1))["label"])])
    cell = lambda c: F.concat(F.lit("line "), c["line"].cast("string"), F.lit(", "), F.element_at("labels", c["role"]), F.lit(' "'), cells.trimmed(c["raw"]), F.lit('" '), c["why"])
    refused = rows.select("file", "line", F.posexplode("refused").alias("nth", "r")).select("file", "line", "nth", "r.role", "r.raw", "r.why")
    refused = refused.groupBy("file").agg(F.slice(F.array_sort(F.collect_list(F.struct("line", "nth", "role", "raw", "why"))), 1, SHOWN_REFUSED).alias("refused_cells"))
    twice = rows.where("mls is not null").groupBy("file", "mls").agg(F.count("*").alias("times")).where("times > 1").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mls", "times"))), lambda x: F.concat(x["mls"], F.lit(" ×"), x["times"].cast("string"))), ", ").alias("twice"))
    own = cells.status_code(F.col("status"))
    private = F.when(F.upper("status").startswith("PRIV-"), F.lit("PRIV"))
    codes = rows.where("status is not null").select("file", F.explode(F.array_compact(F.array(own, private))).alias("code")).distinct().withColumn("caution", cells.caution(F.col("code"))).where("caution is not null")
    cautions = codes.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "caution"))), lambda x: F.struct(F.lit("info").alias("level"), F.concat_ws(": ", x["code"], x["caution"]).alias("text"))).alias("cautions"))
    met = reviews(recs).drop("malformed", "blank_status").join(head.drop("header_line"), "file").join(of_file, "file", "left").join(refused, "file", "left").join(twice, "file", "left").join(cautions, "file", "left").withColumn("labels", label_of)
    has = lambda role: F.exists("bound", lambda b: b["role"] == role)
    doubtful = lambda role: F.exists("ambiguous", lambda b: b["role"] == role)
    lacks = lambda role: ~has(role) & ~doubtful(role)

    def notice(cond, level: str, *text):
        parts = [F.lit(t) if isinstance(t, str) else t for t in text]
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(level).alias("level"), F.concat(*parts).alias("text")))

    def filled(key: str, value):
        before, after = EXPORT[key].split("{}")
        return [F.lit(before), value.cast("string"), F.lit(after)]

    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    listed = lambda c: F.concat(F.lit("("), cells.line_list(F.col(c).cast("array<string>")), F.lit(")"))
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAME.items() for x in kv])
    claimed = lambda a: F.concat(F.lit(" ("), F.array_join(F.transform(a["labels"], lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit(")"))
    before, after = EXPORT["ambiguous"].split("{}")
    ambiguous = F.transform("ambiguous", lambda a: F.struct(F.lit("error").alias("level"), F.concat(F.lit(before), F.element_at(names, a["role"]), F.lit(after), claimed(a), F.lit(EXPORT["ambiguous_rest"])).alias("text")))
    above = n("header_no") - 1
    first = [notice(above > 0, "info", *filled("above", above))]
    then = [
        notice(~n("accounted"), "error", EXPORT["unbalanced"]), notice(lacks("status"), "error", EXPORT["no_status"]), notice(lacks("list"), "warn", EXPORT["no_list"]), notice(lacks("sold"), "warn", EXPORT["no_sold"]),
        notice(lacks("orig"), "info", EXPORT["no_orig"]), notice(~has("conc") & has("sold"), "info", EXPORT["no_conc"]), notice(lacks("mt"), "info", EXPORT["no_mt"]),
        notice(some("malformed"), "error", *filled("malformed", F.size("malformed")), n("width").cast("string"), " columns ", listed("malformed"), EXPORT["malformed_rest"]),
        notice(n("refused") > 0, "error", *filled("refused", n("refused")), F.array_join(F.transform("refused_cells", cell), "; "), F.when(n("refused") > SHOWN_REFUSED, "; …").otherwise(""), "."),
        notice(some("blank_status"), "warn", *filled("blank_status", F.size("blank_status")), listed("blank_status"), EXPORT["blank_status_rest"]), notice(n("empty") > 0, "info", *filled("empty", n("empty"))),
        notice(n("has_market_time") & (n("blank_mt") > 0), "info", *filled("blank_mt", n("blank_mt")), F.element_at("labels", F.lit("mt")), EXPORT["blank_mt_rest"]), notice(n("twice").isNotNull(), "warn", *_split(PAGE["repeated"], n("twice"))),
    ]
    clean = (n("dropped") == 0) & (n("no_status") == 0) & (n("refused") == 0) & n("accounted")
    last = [notice(clean, "ok", *filled("ok", n("n_rows")), n("file"), EXPORT["ok_rest"])]
    none = F.array().cast("array<struct<level:string,text:string>>")
    all_ = F.concat(F.array_compact(F.array(*first)), F.coalesce(ambiguous, none), F.array_compact(F.array(*then)), F.coalesce("cautions", none), F.array_compact(F.array(*last)))
    return met.select("file", F.posexplode(all_).alias("seq", "x")).select("file", "seq", "x.level", "x.text")


def _split(text: str, value) -> list:
    before, after = text.split("{}")
    return [F.lit(before), value, F.lit(after)]
