from pyspark.sql import functions as F

from marketlens.operators import market
from marketlens.sources import exports


def test_split():
    s = lambda t: exports.split(t, ",")
    assert s('a,"b,c"\n1,"x ""y"""\n') == ([(1, ["a", "b,c"], False), (2, ["1", 'x "y"'], False)], None)
    assert s('a,b\r\n"1\n2",3\r\n\r\n4,5') == ([(1, ["a", "b"], False), (2, ["1\n2", "3"], False), (5, ["4", "5"], False)], None)
    assert s('ab"c "d,2\n')[0] == [(1, ['ab"c "d', "2"], False)]
    assert s('"abc"def,1\n')[0] == [(1, ["abcdef", "1"], True)]
    assert s('a\n"open')[1] is not None
    assert s("a,\n")[0] == [(1, ["a", ""], False)]
    assert s("a,")[0] == [(1, ["a", ""], False)]
    assert s('""\n')[0] == [(1, [""], False)]
    assert s(" \n\n")[0] == [(1, [" "], False)]


def test_sniff_and_decode():
    assert exports.delimiter_of("a\tb\n") == "\t"
    assert exports.delimiter_of('a\t"b,c,d"\n1,2,3') == "\t"
    assert exports.delimiter_of("a,b\tc,d") == ","
    assert exports.delimiter_of("a", "x.TSV") == "\t"
    assert exports.decode(b"\xef\xbb\xbfa") == ("a", "UTF-8")
    assert exports.decode(b"\xff\xfea\x00") == ("a", "UTF-16LE")
    assert exports.decode(b"\xfe\xff\x00a") == ("a", "UTF-16BE")
    assert exports.decode("é".encode("cp1252")) == ("é", "Windows-1252")
    assert exports.decode(b"\x81\xe9") == ("\x81é", "Windows-1252")


GOOD = "MLS #\tStat\tMT\tSold Pr\tCONC\tOrig List Pr\tList Price\n1\tCLSD\t10\t200000\t5000.50\t250000\t240000\n2\tACTV\t\t\t\t300000\t299000\n3\tHS48\t5\t\t\t1\t150000\n\t\t\t\t\t\t\n4\tNEW\t0\t\n"


def test_listings_and_review(spark):
    recs = exports.records(exports.from_text(spark, GOOD, "x.tsv"))
    rows = exports.listings(recs).orderBy("line").collect()
    assert [(r.n, r.kind, r.status, r.list_price, r.sold_price, r.reject) for r in rows] == [
        (1, "row", "CLSD", 240000, 200000, None), (2, "row", "ACTV", 299000, None, None), (3, "row", "HS", 150000, None, None), (None, "empty", None, None, None, None), (4, "malformed", None, None, None, "malformed")]
    assert [x.role for x in rows[2].refused] == ["orig"]
    r = exports.reviews(recs).first()
    assert (r.placed, r.empty, r.malformed, r.refused, r.errors, r.dropped, r.accounted, r.has_market_time) == (5, 1, 1, 1, 2, 1, True, True)
    kept = exports.listings(recs).where("kind <> 'empty'")
    g = market.gate(market.placed(kept), ["file"], exports.reviews(recs)).first()
    assert g.provisional and g.reasons.startswith("1 of 4 row(s) have no readable status; 2 unresolved problem(s) reported above")


def test_ambiguous_and_missing_columns(spark):
    files = spark.createDataFrame([("a", "Stat,List Price,Current Price\nNEW,1,2\n"), ("b", "MLS #,List Price\n1,100000\n"), ("c", ""), ("d", 'Stat,List Price\n"x'), ("e", "MT,CONC\n1,2\n")], "file string, content string")
    r = {x.file: x for x in exports.reviews(exports.records(files)).collect()}
    assert r["a"].role_problems == 1 and r["a"].errors == 1
    assert r["b"].no_status_column and r["b"].errors == 1
    assert r["c"].failure == "file is empty" and "never closed" in r["d"].failure and r["e"].failure
    rows = {x.file: x for x in exports.listings(exports.records(files)).collect()}
    assert rows["a"].list_price is None and rows["b"].reject == "no-column"


def test_looks_like_table(spark):
    t = spark.createDataFrame([("a", "Stat,List Price\n1,2"), ("b", "hello"), ("c", "a,b\n1,2")], "file string, text string")
    assert {r.file: r.looks_like_table for r in exports.looks_like_table(t).collect()} == {"a": True, "b": False, "c": False}


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes("Status,List Price\nACTV,\"$1,000\"\n".encode("utf-16"))
    (tmp_path / "skip.png").write_bytes(b"x")
    rows = exports.listings(exports.records(exports.read_files(spark, str(tmp_path)))).collect()
    assert [(r.status, r.list_price) for r in rows] == [("ACTV", 1000)]


def test_empty_summary_has_all_buckets(spark):
    rows = market.placed(spark.createDataFrame([], "n bigint, status string, list_price bigint, orig_price bigint, sold_price bigint, concessions decimal(12,2), market_time int"))
    s = {r.bucket: r for r in market.bucket_summary(rows).collect()}
    assert len(s) == 5 and all(r.n_rows == 0 and r.median_price is None for r in s.values())


def test_edits_null_is_a_value(spark):
    rows = spark.createDataFrame([(1, "CLSD", 5, 6, 7, None, 3)], "n bigint, status string, list_price bigint, orig_price bigint, sold_price bigint, concessions decimal(12,2), market_time int")
    edits = spark.createDataFrame([(1, {"sold_price": None, "status": "NEW"}, True)], "n bigint, patch map<string,string>, omit boolean")
    r = market.with_edits(rows, edits).first()
    assert (r.status, r.sold_price, r.list_price, r.omit, r.edited) == ("NEW", None, 5, True, True)
    assert market.placed(market.with_edits(rows, edits)).first().placement == "omitted"


def test_notices_order(spark):
    w = spark.createDataFrame([("ok", 1, "a"), ("error", 3, "b"), ("info", 2, "c"), ("error", 2, "d")], "level string, seq int, text string")
    assert [r.text for r in market.notices(w).collect()] == ["d", "b", "c", "a"]
