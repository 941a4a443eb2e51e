"""WARC fixity audit with Merkle trees over hashed records and their ordered offset ranges.

An archive holds its distinct records in the order of (key, SHA-256), ``RECORDS`` to a file; a record that is there
several times takes as many lengths of room.  The first record of each file of the primary copy is published, and a
replica is cut at the same places, so that files are ranges of keys and mean the same in both: a record that is
missing, added or of another length moves nothing outside its own file.

A leaf hashes the records of a range in order, each with its digest, copies, offset in the range and length; ranges of
more than ``RECORDS`` records (a replica can have any number between two keys) are hashed in pieces that are summed.  A
node hashes up to ``FAN`` children in order, up to one root.  Each copy's tree is made apart from the other's.  Two
copies are compared from the root down: only children of differing nodes are read, level by level, and the folders of
the tree and of the records are dealt by the root's children, so branches that agree are not read at all.  The records
of differing files are compared one by one.

Status of a record: ``intact``; ``damaged`` (the replica has another record of its key); ``missing`` (it has none);
``copies`` (another number of equal records); ``extra`` (only the replica has it, and no damaged record of its key).
An extra record has no place.

Places come from a range-partitioned sort and one row of totals per partition, not from a global window.
Defined results: null keys sort first and equal each other; null bodies and urls count as empty; equal rows are one
record with its number of copies; other columns of the tables play no part, whatever their names; an empty primary has
extra records only; a very long body is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.llm.common import discard, stored

#: Records of a file; children of a node.
RECORDS, FAN = 256, 16
RECORD = ["key", "digest"]


def record_bytes(key: Column, url: Column, body: Column) -> Column:
    """A response record: header lines, a blank line, the body, two line ends."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def distinct_records(pages: DataFrame, key: str, url: str, body: str) -> DataFrame:
    """(key, digest, length, copies) of each distinct record, reduced before anything is sorted."""
    rows = pages.select(F.col(f"`{key}`").alias("key"), record_bytes(F.col(f"`{key}`"), F.col(f"`{url}`"), F.col(f"`{body}`")).alias("record"))
    rows = rows.select("key", F.sha2(F.col("record").cast("binary"), 256).alias("digest"), F.octet_length("record").cast("long").alias("length"))
    return rows.groupBy(*RECORD).agg(F.min("length").alias("length"), F.count("*").alias("copies"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their partition of a sort (``part``) and a bigint ``place``: 0, 1, ... in the given order."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mono", F.monotonically_increasing_id())
    sorted_ = stored(sorted_.withColumn("part", F.shiftright("mono", 33)), "placed")
    totals = sorted_.groupBy("part").agg(F.count("*").alias("n"))
    before = totals.withColumn("before", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    # One row per partition of the sort.
    return sorted_.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("mono").bitwiseAND((1 << 33) - 1)).drop("mono", "before")


def _ranged(rows: DataFrame) -> DataFrame:
    """Rows (key, digest, length, copies, file_no, at) with their piece of the range and their offset in it."""
    rows = rows.withColumn("piece", F.floor(F.col("at") / RECORDS)).withColumn("nth", F.col("at") % RECORDS)
    in_piece = W.partitionBy("file_no", "piece").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)  # RECORDS rows at most
    return rows.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(in_piece), F.lit(0)))


def layout(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> tuple[DataFrame, int]:
    """The primary copy's records with file_no, nth (place in the file) and offset, and how many they are."""
    rows = placed(distinct_records(pages, key, url, body), RECORD)
    return _ranged(rows.select(*RECORD, "length", "copies", F.floor(F.col("place") / RECORDS).alias("file_no"), (F.col("place") % RECORDS).alias("at"))), rows.count()


def cut_alike(pages: DataFrame, primary: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """A replica's records in the files of ``primary`` (a :func:`layout`), whose first records alone are read."""
    none = F.lit(None).cast("long")
    cuts = primary.where("piece = 0 and nth = 0").select(*RECORD, none.alias("length"), none.alias("copies"), F.col("file_no").alias("cut"))
    both = cuts.unionByName(distinct_records(pages, key, url, body).withColumn("cut", none)).withColumn("is_record", F.col("cut").isNull())
    rows = placed(both, [*RECORD, "is_record"])
    last = F.max(F.when(F.col("cut").isNotNull(), F.struct("cut", "place")))
    in_part = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    carried = rows.groupBy("part").agg(last.alias("own")).withColumn("carried", F.max("own").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("part", "carried")
    # One row per partition of the sort; cuts rise with their places, so the greatest is the last.
    rows = rows.withColumn("own", last.over(in_part)).join(F.broadcast(carried), "part").withColumn("cut_", F.coalesce("own", "carried")).where("is_record")
    before_first = F.coalesce(F.col("cut_.cut") == 0, F.lit(True))
    # Records up to the second cut are in the first file; elsewhere they are counted from their cut on.
    at = F.when(before_first, F.col("place") - F.when(F.col("cut_").isNull(), 0).otherwise(1)).otherwise(F.col("place") - F.col("cut_.place") - 1)
    return _ranged(rows.select(*RECORD, "length", "copies", F.coalesce("cut_.cut", F.lit(0)).alias("file_no"), at.alias("at")))


def depth_of(files: int) -> int:
    d = 0
    while FAN**d < files:
        d += 1
    return d


def _branch(node: Column, level: int, depth: int) -> Column:
    """Which of the root's children a node belongs to (-1 for the root)."""
    return F.lit(-1).cast("long") if level >= depth else F.floor(node / FAN ** (depth - 1 - level))


def trees(records: DataFrame, depth: int) -> DataFrame:
    """(level, branch, side, node, hash) of each side's tree: files are level 0, the root is level ``depth``."""
    each = F.concat_ws(":", "digest", "copies", "offset", "length")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", each.alias("x")))), lambda e: e["x"])  # RECORDS at most
    pieces = records.groupBy("side", "file_no", "piece").agg(F.sha2(F.array_join(ordered, "|").cast("binary"), 256).alias("hash"))
    whole = F.sha2(F.concat_ws("|", "piece", "hash").cast("binary"), 256)
    part = lambda i: F.sum(F.conv(F.substring(whole, i, 15), 16, 10).cast("decimal(38,0)"))
    files = pieces.groupBy("side", F.col("file_no").alias("node")).agg(F.sha2(F.concat_ws("|", F.count("*"), part(1), part(16), part(31), part(46)).cast("binary"), 256).alias("hash"))
    level = stored(files, "files")
    out = level.withColumn("level", F.lit(0)).withColumn("branch", _branch(F.col("node"), 0, depth))
    for k in range(1, depth + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # FAN at most
        up = level.groupBy("side", F.floor(F.col("node") / FAN).alias("up")).agg(F.sha2(F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["node"], x["hash"])), "|").cast("binary"), 256).alias("hash"))
        level = up.withColumnRenamed("up", "node")
        out = out.unionByName(level.withColumn("level", F.lit(k)).withColumn("branch", _branch(F.col("node"), k, depth)))
    return stored(out.repartition("level", "branch"), "tree", ["level", "branch"])


def differing(tree: DataFrame, depth: int) -> tuple[DataFrame | None, list[int]]:
    """The files (node) in which the two sides differ, by descent from the root, and the branches that hold them."""
    bad: DataFrame | None = None
    branches = [-1]
    hash_of = lambda side: F.max(F.when(F.col("side") == side, F.col("hash")))
    for k in range(depth, -1, -1):
        here = tree.where((F.col("level") == k) & F.col("branch").isin(branches) if k < depth - 1 else F.col("level") == k)
        if bad is not None:
            here = here.join(bad.select(F.col("node").alias("up")), F.floor(F.col("node") / FAN) == F.col("up"), "left_semi")
        worse = stored(here.groupBy("node", "branch").agg(hash_of("mine").alias("a"), hash_of("theirs").alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("node", F.col("branch").cast("long").alias("branch")), "differing")
        if bad is not None:
            discard(bad)
        bad = worse
        branches = sorted(r.branch for r in bad.select("branch").distinct().collect())  # FAN at most
        if not branches:
            return None, []
    return bad, branches


def audit(pages: DataFrame, replica: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """A row per record of either copy: its place in the primary's files, its digest, copies, and status."""
    mine, n = layout(pages, key, url, body)
    depth = depth_of(-(-n // RECORDS))
    folder = lambda rows: stored(rows.withColumn("branch", _branch(F.col("file_no"), 0, depth)), "records", ["branch"])
    own = folder(mine)
    other = folder(cut_alike(replica, own, key, url, body))
    tree = trees(own.withColumn("side", F.lit("mine")).unionByName(other.withColumn("side", F.lit("theirs"))), depth)
    bad, branches = differing(tree, depth)
    discard(tree)
    shown = [F.col("key").alias(key), F.col("file_no").cast("long"), F.col("nth").cast("long").alias("record_no"), F.col("offset").cast("long"), "length", "digest", "copies"]
    if bad is None:
        return own.select(*shown, F.lit("intact").alias("status"))
    differ = bad.select(F.col("node").alias("file_no"))
    good = own.join(differ, "file_no", "left_anti").select(*shown, F.lit("intact").alias("status"))
    left, right = (t.where(F.col("branch").isin(branches)).join(differ, "file_no", "left_semi") for t in (own, other))
    theirs = right.select(*[F.col(c).alias(f"{c}_") for c in (*RECORD, "file_no", "length", "copies")])
    met = left.join(theirs, F.col("key").eqNullSafe(F.col("key_")) & (F.col("digest") == F.col("digest_")), "full")
    both = stored(met.withColumn("side", F.when(F.col("digest_").isNull(), "mine").when(F.col("digest").isNull(), "theirs").otherwise("both")), "compared")
    # Keys with a record that only one side has, reduced before they meet.
    one = lambda side, c: both.where(F.col("side") == side).groupBy(F.col(c).alias("k")).agg(F.lit(True).alias("known"))
    lost = both.where("side = 'mine'").join(one("theirs", "key_"), F.col("key").eqNullSafe(F.col("k")), "left").select(*shown, F.when(F.col("known"), "damaged").otherwise("missing").alias("status"))
    same = both.where("side = 'both'").select(*shown, F.when(F.col("copies") == F.col("copies_"), "intact").otherwise("copies").alias("status"))
    added = both.where("side = 'theirs'").join(one("mine", "key"), F.col("key_").eqNullSafe(F.col("k")), "left_anti")
    nowhere = F.lit(None).cast("long")
    extra = added.select(F.col("key_").alias(key), F.col("file_no_").cast("long").alias("file_no"), nowhere.alias("record_no"), nowhere.alias("offset"), F.col("length_").alias("length"), F.col("digest_").alias("digest"), F.col("copies_").alias("copies"), F.lit("extra").alias("status"))
    return good.unionByName(lost).unionByName(same).unionByName(extra)
