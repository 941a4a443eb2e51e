"""Recognition operators over vectors, cells and tokens: ranking, guarded acceptance, votes, layout inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions import cells as cells_
from marketlens.functions.vocab import HEADER_VOCABULARY, label_key
from marketlens.operators import placing
from marketlens.operators.ranks import medians, middles, with_median
from marketlens.operators.rounds import settled

# Score floors, margins and the label pairs that need a wider one.
MIN_SCORE, MIN_MARGIN, PAIR_MARGIN = 0.35, 0.02, 0.05
CONFUSABLE = [(0, 9), (0, 8), (3, 5), (3, 8), (5, 6), (6, 9), (1, 7), (8, 9)]
VOTE_SCORE, VOTE_SINGLE, VOTE_DECISIVE, VOTE_SHAPE, VOTE_MARGIN = 0.55, 0.65, 0.22, 0.50, 0.05
# Column acceptance.
COL_ROWS, COL_SHARE, COL_LOW, COL_HIGH = 2, 0.60, 20_000, 20_000_000
DENSE, FILL_AGREES, FILL_BLANKS, SWAP_SHARE = 0.85, 0.90, 3, 0.60
CONC_LOW, CONC_HIGH, SOLD_LOW, SOLD_HIGH, DIGIT_SPREAD = 0.002, 0.25, 0.5, 1.5, 2
STRENGTH = {"header": 0.95, "fill-pattern": 0.75, "position": 0.45}


def ncc(a: Column, b: Column) -> Column:
    """Normalised cross-correlation of two equal-sized vectors; 0 where either is flat."""
    n = F.size(a).cast("double")
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    sa, sb = add(a), add(b)
    num = dot(a, b) - sa * sb / n
    den = F.sqrt(F.greatest(dot(a, a) - sa * sa / n, F.lit(0.0)) * F.greatest(dot(b, b) - sb * sb / n, F.lit(0.0)))
    return F.when(den < 1e-10, 0.0).otherwise(num / den)


def template_bank(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """The mean vector of each label (partial sums per element, no vector is gathered)."""
    each = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("decimal(12,8)")).cast("double").alias("x"))
    # One element list per label, as long as a vector.
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("template"))


def rank(vectors: DataFrame, bank: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Best and second label of each vector with score and margin.

    The bank is one array per label - a fixed vocabulary - folded into a single row, so each vector is scored
    against it in place: no rows are multiplied and no window is needed.
    """
    whole = bank.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "template"))).alias("bank"))
    scored = vectors.crossJoin(F.broadcast(whole)).withColumn("scores", F.transform("bank", lambda t: F.struct((-F.round(ncc(F.col(vector), t["template"]), 9)).alias("minus"), t["label"].alias("label"))))
    best = F.array_sort("scores")
    return scored.select(*vectors.columns, best.alias("best")).select(
        *vectors.columns,
        F.col("best")[0]["label"].alias("top"), (-F.col("best")[0]["minus"]).alias("score"), F.get("best", F.lit(1))["label"].alias("second"),
        F.coalesce(F.get("best", F.lit(1))["minus"] - F.col("best")[0]["minus"], F.lit(1.0)).alias("margin"),
    )


def scores(vectors: DataFrame, bank: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vectors`` with an array ``scores`` (label, shape): each scored in place against the bank, folded in one row."""
    whole = bank.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "template"))).alias("bank"))
    return vectors.crossJoin(F.broadcast(whole)).withColumn("scores", F.transform("bank", lambda t: F.struct(t["label"].alias("label"), F.round(ncc(F.col(vector), t["template"]), 9).alias("shape")))).drop("bank")


def ambiguity(top: Column, second: Column, score: Column, margin: Column) -> Column:
    """Why a reading is refused, or null: too low, too close, or too close for a confusable pair."""
    pair = F.lit(False)
    for x, y in CONFUSABLE:
        pair = pair | ((top == x) & (second == y)) | ((top == y) & (second == x))
    return F.when(score < MIN_SCORE, "score").when(margin < MIN_MARGIN, "margin").when(pair & (margin < PAIR_MARGIN), "confusable")


def votes(ranked: DataFrame, cluster: str, member: str, candidate: str, combined: str, shape: str) -> DataFrame:
    """Each cluster's winning candidate by mean score over voting members, with margin and why it is refused."""
    voters = ranked.groupBy(cluster).agg(F.countDistinct(member).alias("voters"))
    sums = ranked.groupBy(cluster, candidate).agg(F.sum(combined).alias("s"), F.sum(shape).alias("h")).join(voters, cluster)
    means = sums.select(cluster, "voters", F.struct((-F.round(F.col("s") / F.col("voters"), 9)).alias("minus"), F.col(candidate).alias("candidate"), F.round(F.col("h") / F.col("voters"), 9).alias("shape")).alias("m"))
    order = means.groupBy(cluster, "voters").agg(F.slice(F.array_sort(F.collect_list("m")), 1, 2).alias("m"))  # candidates of a fixed vocabulary
    top, second = F.col("m")[0], F.get("m", F.lit(1))
    score, margin = -top["minus"], F.coalesce(second["minus"] - top["minus"], F.lit(1.0))
    floor = F.when((F.col("voters") == 1) & (margin < VOTE_DECISIVE), VOTE_SINGLE).otherwise(VOTE_SCORE)
    reject = F.when(top["shape"] < VOTE_SHAPE, "shape").when(score < floor, "score").when(margin < VOTE_MARGIN, "margin")
    return order.select(cluster, "voters", top["candidate"].alias("top"), F.round(score, 6).alias("score"), F.round(margin, 6).alias("margin"), reject.alias("reject"))


def islands(rows: DataFrame, by: str, at: str, gap: float, order: list[str]) -> DataFrame:
    """Rows with the number of their island: a gap of at least ``gap`` to the row before starts a new one."""
    made = placing.previous(placing.ranged(rows, [by, at, *order]), by, {"at_before": at})
    made = made.withColumn("opens", F.when(F.col(at) - F.col("at_before") >= gap, 1).otherwise(0)).drop("at_before")
    return placing.running(made, by, "opens", "island").drop("part", "at_")


def upper_medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n_values, lower, upper): the upper of the two middle values (the lower-rank median is not it)."""
    return middles(rows, by, value)


def otsu(values: DataFrame, value: str) -> DataFrame:
    """The threshold of largest between-class variance over a histogram of whole values."""
    hist = values.groupBy(F.col(value).cast("bigint").alias("t")).agg(F.count("*").alias("n"))
    up = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)  # a histogram: one row per distinct level
    total = hist.agg(F.sum("n").alias("n_all"), F.sum(F.col("t") * F.col("n")).alias("sum_all"))
    run = hist.crossJoin(F.broadcast(total)).withColumn("w", F.sum("n").over(up)).withColumn("s", F.sum(F.col("t") * F.col("n")).over(up)).where(F.col("w") < F.col("n_all"))
    diff = F.col("s") / F.col("w") - (F.col("sum_all") - F.col("s")) / (F.col("n_all") - F.col("w"))
    variance = F.round(F.col("w").cast("double") * (F.col("n_all") - F.col("w")) * diff * diff, 3)
    return run.select("t", variance.alias("v")).agg(F.min_by("t", F.struct(-F.col("v"), F.col("t"))).alias("threshold"), F.max("v").alias("variance"))


def digit_outliers(values: DataFrame, by: str, value: str) -> DataFrame:
    """Values with two digits or more below their column's median digit count."""
    digits = values.withColumn("digits", F.length(F.col(value).cast("string")))
    typical = digits.groupBy(by).agg(F.round(F.median("digits")).cast("int").alias("typical"))
    return digits.join(typical, by).where(F.col("typical") - F.col("digits") >= DIGIT_SPREAD)


def prefix_vote(cells: DataFrame, by: str, digits: str, commas: str) -> DataFrame:
    """Whether a column's first glyph is a currency mark: which reading makes the separators fit."""
    fits = lambda n: (F.col(commas) == F.floor((n - 1) / 3)).cast("int")
    n = F.col(digits)
    g = cells.where(n >= 3).groupBy(by).agg(F.count("*").alias("n_cells"), F.avg((F.col(commas) > 0).cast("int")).alias("with_comma"), F.avg(fits(n)).alias("keep"), F.avg(fits(n - 1)).alias("dropped"))
    verdict = (
        F.when((F.col("n_cells") < COL_ROWS) | (F.col("with_comma") < 0.9), "keep")
        .when((F.col("dropped") >= 0.9) & (F.col("dropped") > F.col("keep") + 0.15), "drop")
        .when((F.col("keep") >= 0.9) & (F.col("keep") > F.col("dropped") + 0.15), "keep")
        .when((F.col("keep") < 0.9) | (F.col("dropped") < 0.9), "keep")
        .otherwise("magnitude")
    )
    return g.withColumn("verdict", verdict)


PREFIX_SAMPLE = 8


def currency_prefix(cells: DataFrame, by: str, order: str, digits: str, commas: str) -> DataFrame:
    """(by, verdict, kept, dropped, is_prefix): whether a column's first glyph is a currency mark.

    ``digits`` are the glyphs read as digits, ``commas`` the separators.  Where the separators fit both ways, the first few
    cells decide by magnitude: only one reading may put their upper middle value among the prices of houses.
    """
    vote = prefix_vote(cells.withColumn("n_digits_", F.length(digits)), by, "n_digits_", commas)
    first = cells.withColumn("nth_", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("nth_") <= PREFIX_SAMPLE)
    upper = lambda v: F.get(F.array_sort(F.collect_list(v)), F.floor(F.count(v) / 2).cast("int"))  # noqa: E731  (PREFIX_SAMPLE at most)
    number = lambda c: F.when(F.length(c) > 0, c.try_cast("bigint"))
    sample = first.groupBy(by).agg(upper(number(F.col(digits))).alias("kept"), upper(number(F.substring(F.col(digits), F.lit(2), F.length(digits)))).alias("dropped"))
    fits = lambda c: F.coalesce(F.col(c).between(COL_LOW, COL_HIGH), F.lit(False))
    met = vote.select(by, "verdict").join(sample, by)
    return met.withColumn("is_prefix", F.when(F.col("verdict") == "magnitude", fits("dropped") & ~fits("kept")).otherwise(F.col("verdict") == "drop"))


def marks(digits_at: Column, marks_at: Column) -> Column:
    """(commas, fraction) of a number token from the places of its digits and marks; null if a mark sits wrong.

    Only the last mark can be a point, with one or two digits after it; the others sit on thousands.
    """

    def of(digits: Column, order: Column) -> Column:
        right = lambda m: F.size(F.filter(digits, lambda d: d > m))
        after_last = right(F.try_element_at(order, F.lit(-1)))
        return cells_.once(F.when((F.size(order) > 0) & after_last.isin(1, 2), after_last).otherwise(0), lambda fraction: judged(order, right, fraction))

    def judged(order: Column, right, fraction: Column) -> Column:
        rest = F.when(fraction > 0, F.slice(order, 1, F.greatest(F.size(order) - 1, F.lit(0)))).otherwise(order)
        good = F.forall(rest, lambda m: (right(m) - fraction > 0) & ((right(m) - fraction) % 3 == 0))
        return F.when(good, F.struct(F.size(rest).alias("commas"), fraction.alias("fraction")))

    return cells_.once(digits_at, lambda digits: cells_.once(F.array_sort(marks_at), lambda order: of(digits, order)))


def fill_pattern(cells: DataFrame, by: str = "col", filled: str = "filled", closed: str = "closed") -> DataFrame:
    """Per column: how often "filled" agrees with "closed", and whether that makes it the sold column."""
    f, c = F.col(filled), F.col(closed)
    g = cells.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.count_if(f).alias("n_filled"), F.count_if(f == c).alias("agree"), F.count_if(~f & ~c).alias("blank_open"),
        F.sum(F.when(f & ~c, -2).when(f, 1).otherwise(0)).alias("weighted"),
    )
    share = F.col("agree") / F.col("n_rows")
    able = (F.col("n_filled") / F.col("n_rows") < DENSE) & (F.col("blank_open") >= FILL_BLANKS)
    return g.withColumn("agreement", F.round(share, 6)).withColumn("is_sold", able & (share >= FILL_AGREES))


def money_columns(cells: DataFrame, by: str = "col", value: str = "value") -> DataFrame:
    """Columns accepted as money (enough parsed cells, plausible median), with how full they are."""
    v = F.col(value)
    middle = medians(cells, [by], value).select(by, F.round("median").cast("bigint").alias("median"))
    g = cells.groupBy(by).agg(F.count("*").alias("n_rows"), F.count(v).alias("parsed")).join(middle, by, "left")
    ok = (F.col("parsed") >= COL_ROWS) & (F.col("parsed") / F.col("n_rows") >= COL_SHARE) & F.col("median").between(COL_LOW, COL_HIGH)
    return g.withColumn("is_money", F.coalesce(ok, F.lit(False))).withColumn("is_dense", F.col("parsed") / F.col("n_rows") >= DENSE)


def swap_check(rows: DataFrame, list_: str = "list_price", orig: str = "orig_price") -> DataFrame:
    """Whether the two full price columns are the wrong way round, from the rows in which they differ."""
    higher = F.count_if(F.col(list_) > F.col(orig))
    decided = F.count_if(F.col(list_) != F.col(orig))
    return rows.agg(higher.alias("list_higher"), decided.alias("decided"), ((decided >= 3) & (higher / F.nullif(decided, F.lit(0)) > SWAP_SHARE)).alias("swap"))


def confidence(methods: list[Column], problems: Column) -> Column:
    """The weakest method of the roles that feed a number, less a fifth per problem, not below a fifth."""
    strength = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])
    each = [F.when(m.isNull(), 0.2).otherwise(F.coalesce(F.element_at(strength, m), F.lit(0.45))) for m in methods]
    return F.greatest(F.lit(0.2), F.least(F.lit(0.95), *each) - problems * 0.2)


SALTS = 16


def nearest_overlap(labels: DataFrame, columns: DataFrame, width: float) -> DataFrame:
    """For each label interval (label_id, x0, x1) the overlapping column (col_id, c0, c1) of nearest centre.

    Both sides are cut in bins of ``width``, so only intervals that share a bin meet: an equi-join, no cross join.  Labels
    of one interval have one answer, so each interval is looked up once.  Cut columns are many more rows than their table
    tells, so they are never broadcast.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    # Intervals of a bin are dealt to SALTS keys and its columns are there for each, so a crowded bin is many keys.
    intervals = labels.select("x0", "x1").where("x0 is not null and x1 is not null").distinct()
    salted = intervals.withColumn("bin", bins("x0", "x1")).withColumn("salt", F.pmod(F.xxhash64("x0", "x1"), F.lit(SALTS)).cast("int"))
    cut = columns.withColumn("bin", bins("c0", "c1")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.join(cut.hint("merge"), ["bin", "salt"])
    real = met.where((F.least("x1", "c1") > F.greatest("x0", "c0")) & (F.floor(F.greatest("x0", "c0") / width) == F.col("bin")))
    far = F.abs((F.col("c0") + F.col("c1")) / 2 - (F.col("x0") + F.col("x1")) / 2)
    nearest = real.groupBy("x0", "x1").agg(F.min(F.struct(far.alias("distance"), "col_id")).alias("m"))
    return labels.join(nearest, ["x0", "x1"]).groupBy("label_id").agg(F.min("m").alias("m")).select("label_id", "m.col_id", F.col("m.distance").alias("distance"))


def index_column(cells: DataFrame, by: str, value: str, n_rows: int | None = None) -> DataFrame:
    """Columns that number rows: enough values, none twice, and a span not much above their number."""
    g = cells.groupBy(by).agg(F.count(value).alias("read"), F.countDistinct(value).alias("n_distinct"), F.min(value).cast("bigint").alias("first_no"), F.max(value).cast("bigint").alias("last_no"), F.count("*").alias("n_rows"))
    span = F.col("last_no") - F.col("first_no") + 1
    ok = (F.col("read") >= 3) & (F.col("read") >= 0.6 * F.col("n_rows")) & (F.col("read") == F.col("n_distinct")) & (span <= 1.5 * F.col("read") + 3)
    return g.withColumn("is_index", F.coalesce(ok, F.lit(False)))


def kickout_rivals(codes: DataFrame) -> DataFrame:
    """(code, place, rival): letters that turn a code into another of the same length (an equi-join on the rest)."""
    cut = codes.select("code", F.explode(F.sequence(F.lit(1), F.length("code"))).alias("place"))
    cut = cut.withColumn("rest", F.concat(F.expr("substring(code, 1, place - 1)"), F.lit("?"), F.expr("substring(code, place + 1)"))).withColumn("letter", F.expr("substring(code, place, 1)"))
    other = cut.select("rest", "place", F.col("letter").alias("rival"))
    return cut.join(other, ["rest", "place"]).where("letter <> rival").select("code", "place", "rival")


# Status pairs that differ by one glyph, header thresholds, hole counts of the digits.
CLOSE_CODES = [("CTGA", "CTGO"), ("HS", "HC"), ("PS", "PC"), ("ACTV", "AUCT"), ("PEND", "PCHG"), ("CANC", "CTG"), ("HS", "SS"), ("PS", "SS"), ("HC", "SS"), ("PC", "SS")]
CLOSE_MARGIN = 0.10
HEADER_ROWS, HEADER_LABELS_MIN, HEADER_ANCHORS_MIN = 6, 4, 2
HEADER_ANCHORS = ["status", "list", "sold", "mls"]
DIGIT_HOLES = {0: 1, 4: 1, 6: 1, 8: 2, 9: 1}
MLS_DIGITS, MLS_SHARE, WORD_ASPECT = 8, 0.6, 0.25


def _among(a: Column, b: Column, pairs) -> Column:
    hit = F.lit(False)
    for x, y in pairs:
        hit = hit | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return hit


def required_margin(top: Column, second: Column) -> Column:
    """The margin that a status reading needs: wider for codes that differ by one glyph."""
    return F.when(_among(top, second, CLOSE_CODES), CLOSE_MARGIN).otherwise(VOTE_MARGIN)


def digit_ambiguity(top: Column, second: Column, score: Column, margin: Column, holes: Column, upper: Column, lower: Column) -> Column:
    """As :func:`ambiguity` for digits, with holes as extra evidence and the balance of 8 and 9.

    A confusable pair needs less where the holes fit the first digit and not the second, and much more where an 8
    is top-heavy or a 9 is not.
    """
    own = F.create_map(*[F.lit(x) for d in range(10) for x in (d, DIGIT_HOLES.get(d, 0))])
    first, other = F.element_at(own, top.cast("int")), F.element_at(own, second.cast("int"))
    need = F.when((first != other) & (holes == first), MIN_MARGIN).otherwise(PAIR_MARGIN)
    balance = F.when(lower > 0.001, upper / lower).otherwise(10.0)
    wrong = ((top == 8) & (second == 9) & (balance > 1.15)) | ((top == 9) & (second == 8) & (balance < 1.15))
    need = F.when(wrong, F.greatest(need, F.lit(0.20))).otherwise(need)
    return F.when(score < MIN_SCORE, "score").when(margin < MIN_MARGIN, "margin").when(_among(top, second, CONFUSABLE) & (margin < need), "confusable")


def colour_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two colours (arrays of red, green, blue)."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def colour_hex(c: Column) -> Column:
    return F.concat(F.lit("#"), F.array_join(F.transform(c, lambda x: F.lower(F.lpad(F.hex(F.round(x).cast("long")), 2, "0"))), ""))


def aspect_agreement(a: Column, b: Column) -> Column:
    """1 for equal shapes, 0 from a factor of two on."""
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - F.abs(F.log2(a / b)))).otherwise(0.0)


def word_score(shape: Column, aspect: Column) -> Column:
    return (1 - WORD_ASPECT) * shape + WORD_ASPECT * aspect


def to_decimal(digits: Column, fraction: Column) -> Column:
    """A digit string with its last ``fraction`` digits behind the point; null without whole digits."""
    whole = F.substring(digits, F.lit(1), F.length(digits) - fraction)
    return F.when(F.length(whole) > 0, F.concat(whole, F.when(fraction > 0, F.concat(F.lit("."), F.right(digits, fraction))).otherwise("")).try_cast("decimal(14,2)"))


def index_percentile(hist: DataFrame, value: str, count: str, share: float) -> DataFrame:
    """The value at place floor(n * share) of the sorted values, from their histogram."""
    up = W.orderBy(value).rowsBetween(W.unboundedPreceding, 0)  # one row per distinct value
    run = hist.withColumn("upto", F.sum(count).over(up))
    n = hist.agg(F.sum(count).alias("n_all"))
    return run.crossJoin(F.broadcast(n)).where(F.col("upto") > F.floor(F.col("n_all") * share)).agg(F.min(value).alias("value"), F.first("n_all").alias("n_all"))


def header_roles(tokens: DataFrame, text: str) -> DataFrame:
    """``tokens`` with the role that their text names in an image's header, if any."""
    table = F.create_map(*[F.lit(x) for key, role in {label_key(t): r for t, r in HEADER_VOCABULARY.items()}.items() for x in (key, role)])
    return tokens.withColumn("role", F.element_at(table, cells_.label_key(F.col(text))))


def header_row(labels: DataFrame) -> DataFrame:
    """Per grid the topmost early row with enough labels and anchors (grid, row, label, role)."""
    g = labels.where(F.col("row") < HEADER_ROWS).groupBy("grid", "row").agg(F.count("*").alias("n_labels"), F.countDistinct(F.when(F.col("role").isin(*HEADER_ANCHORS), F.col("role"))).alias("n_anchors"))
    return g.where((F.col("n_labels") >= HEADER_LABELS_MIN) & (F.col("n_anchors") >= HEADER_ANCHORS_MIN)).groupBy("grid").agg(F.min("row").alias("row"))


def read_tokens(glyphs: DataFrame, by: list[str]) -> DataFrame:
    """Digit strings of tokens from their glyph rows (place, digit, reason); one refused glyph refuses the token."""
    g = glyphs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digit"))), lambda x: x["digit"].cast("string")), "").alias("digits"), F.max("reason").alias("reason"))
    return g.withColumn("digits", F.when(F.col("reason").isNull(), F.col("digits")))


def mls_column(cells: DataFrame, by: str = "col") -> DataFrame:
    """Columns whose cells mostly have eight glyphs, by the share that reads cleanly (n_glyphs, clean)."""
    g = cells.groupBy(by).agg(F.avg((F.col("n_glyphs") == MLS_DIGITS).cast("int")).alias("eight"), F.avg(F.col("clean").cast("int")).alias("clean"))
    return g.where(F.col("eight") >= MLS_SHARE)


def widest_gaps(rows: DataFrame, by: str, start: str, end: str, order: list[str]) -> DataFrame:
    """Per group the widest gap between one interval's end and the next one's start (a place to split a column)."""
    made = placing.previous(placing.ranged(rows, [by, start, *order]), by, {"end_before": end}).withColumn("gap", F.col(start) - F.col("end_before"))
    return made.where(F.col("gap") > 0).groupBy(by).agg(F.max(F.struct("gap", (-F.col("end_before")).alias("minus"))).alias("m")).select(by, F.col("m.gap").alias("gap"), (-F.col("m.minus")).alias("after"))


def kickout_read(votes: DataFrame, codes: list[str]) -> DataFrame:
    """Codes spelt by the best letter at each place (cluster, place, letter, mean), if it is one of ``codes`` and
    every rival letter is beaten by the wide margin."""
    best = votes.groupBy("cluster", "place").agg(F.max(F.struct("mean", "letter")).alias("b"))
    code = best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "b.letter"))), lambda x: x["letter"]), "").alias("code")).where(F.col("code").isin(*codes))
    rivals = kickout_rivals(votes.sparkSession.createDataFrame([(c,) for c in codes], "code string"))
    near = code.join(rivals, "code").join(votes.withColumnRenamed("letter", "rival"), ["cluster", "place", "rival"]).join(best, ["cluster", "place"])
    beaten = near.where(F.col("b.mean") - F.col("mean") < CLOSE_MARGIN).select("cluster").distinct()
    return code.join(beaten, "cluster", "left_anti")


# Shares of a status column's score, its bars, and how many cells are looked at.
STATUS_RESOLVED, STATUS_MEAN, STATUS_COVERAGE, STATUS_HEADER, STATUS_BAR = 0.5, 0.3, 0.2, 0.5, 0.55
STATUS_CELLS, NUMERIC_CELLS, NUMERIC_SHARE, FONT_CELLS = 12, 8, 0.75, 20
# Weights of a glyph's score, biases by holes and by the balance of 8 and 9.
GLYPH_SHAPE, GLYPH_STRUCTURE, HOLES_AGREE, HOLES_DIFFER, BALANCE_BIAS, TOP_HEAVY = 0.8, 0.2, 0.04, 0.02, 0.01, 1.2
# Fixed value: colours further apart than this contradict each other.
COLOURS_APART = 42


def _sampled(cells: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """Evenly spread rows of each group, ``most`` at most (each step-th, as the reference samples)."""
    w = W.partitionBy(*by).orderBy(order)  # cells of one column of a grid
    placed = cells.withColumns({"at_": F.row_number().over(w) - 1, "n_cells": F.count("*").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    return placed.where(_taken(most)).drop("at_", "n_cells")


def _taken(most: int) -> Column:
    """Whether a row (its place ``at_`` of ``n_cells``) is one of ``most`` evenly spread ones."""
    step = F.greatest(F.lit(1), F.floor(F.col("n_cells") / most))
    return (F.col("at_") % step == 0) & (F.col("at_") / step < most)


def status_columns(cells: DataFrame, rows: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """(grid, col, resolved, mean, coverage, score, chosen): candidates for the status column, and the one taken.

    ``cells`` are (grid, col, cell, digits, top, second, score, shape, margin), ``rows`` (grid, n_rows), ``header``
    (grid, col) what a header names as status.  A named column is taken whatever the scores; otherwise the best; in
    both cases only if enough of its cells resolve.
    """
    by = ["grid", "col"]
    named = (header if header is not None else cells.select(*by).where("false")).select(*by).distinct().withColumn("named", F.lit(True))
    # Both samples come from one numbering of a column's cells.
    along = W.partitionBy(*by).orderBy("cell")  # cells of one column of a grid
    placed = cells.withColumns({"at_": F.row_number().over(along) - 1, "n_cells": F.count("*").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))}).where("n_cells >= 2")
    looked, voted = _taken(NUMERIC_CELLS), _taken(STATUS_CELLS)
    good = (F.col("score") >= VOTE_SCORE) & (F.col("shape") >= VOTE_SHAPE) & (F.col("margin") >= required_margin(F.col("top"), F.col("second")))
    taken = placed.withColumns({"looked_": looked, "voted_": voted}).where("looked_ or voted_").withColumn("good_", F.when(F.col("voted_"), good))
    g = taken.groupBy(*by).agg(
        F.max("n_cells").alias("n_cells"), F.count_if("looked_").alias("looked"), F.avg(F.when(F.col("looked_"), F.col("digits").cast("int"))).alias("share"),
        F.avg(F.when(F.col("voted_"), F.col("good_").cast("int"))).alias("resolved"), F.coalesce(F.avg(F.when(F.col("good_"), F.col("score"))), F.lit(0.0)).alias("mean"),
    )
    able = g.join(named, by, "left").where(F.col("named").isNotNull() | ~((F.col("looked") >= 2) & (F.col("share") >= NUMERIC_SHARE))).drop("looked", "share")
    full = able.join(rows, "grid").withColumn("coverage", F.least(F.lit(1.0), F.col("n_cells") / F.col("n_rows")))
    total = STATUS_RESOLVED * F.col("resolved") + STATUS_MEAN * F.col("mean") + STATUS_COVERAGE * F.col("coverage") + F.when(F.col("named"), STATUS_HEADER).otherwise(0.0)
    full = full.withColumn("total", F.round(total, 9))
    best = full.groupBy("grid").agg(F.min_by("col", F.struct(F.col("named").isNull(), -F.col("total"), "col")).alias("best"))  # columns of a grid
    out = full.join(best, "grid")
    return out.select(*by, "resolved", "mean", "coverage", F.col("total").alias("score"), ((F.col("col") == F.col("best")) & (F.col("resolved") >= STATUS_BAR)).alias("chosen"))


def pick_font(scores_: DataFrame, by: str) -> DataFrame:
    """(by, font, mean): the font of best mean score over a few sampled cells (cell, font, score)."""
    g = _sampled(scores_, [by, "font"], "cell", FONT_CELLS).groupBy(by, "font").agg(F.round(F.avg("score"), 9).alias("mean"))
    return g.groupBy(by).agg(F.min(F.struct((-F.col("mean")).alias("minus"), "font")).alias("m")).select(by, "m.font", (-F.col("m.minus")).alias("mean"))


def ink_colour(pixels: DataFrame, by: str) -> DataFrame:
    """(by, r, g, b): the mean colour of the darkest quarter of each box's pixels (r, g, b)."""
    lum = pixels.withColumn("lum", F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"), 6))
    hist = lum.groupBy(by, "lum", "r", "g", "b").agg(F.count("*").alias("n"))  # colours of a box
    w = W.partitionBy(by)
    run = hist.withColumns({"upto": F.sum("n").over(w.orderBy("lum")), "total": F.sum("n").over(w), "own": F.sum("n").over(W.partitionBy(by, "lum"))})
    # All pixels as dark as the one that ends the quarter, or darker.
    dark = run.where(F.col("upto") - F.col("own") < F.greatest(F.lit(1), F.floor(F.col("total") * 0.25)))
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("n")) / F.sum("n") + 0.5).cast("int").alias(c)
    return dark.groupBy(by).agg(mean("r"), mean("g"), mean("b"))


def merge_codes(clusters: DataFrame) -> DataFrame:
    """(grid, code, n_clusters, members, score, contradictions): clusters of one code as one, with how many of them are
    far in colour from the first (clusters: grid, cluster, code, members, score, colour)."""
    first = clusters.where("code is not null").groupBy("grid", "code").agg(F.min_by("colour", "cluster").alias("own"))
    met = clusters.join(first, ["grid", "code"])
    far = F.count_if(colour_distance(F.col("colour"), F.col("own")) > COLOURS_APART)
    return met.groupBy("grid", "code").agg(F.count("*").alias("n_clusters"), F.sum("members").alias("members"), F.max("score").alias("score"), far.alias("contradictions"))


def glyph_score(digit: Column, shape: Column, structure: Column, holes: Column, own_holes: Column, upper: Column, lower: Column) -> Column:
    """A glyph's score against one digit: shape and structure, agreement in holes, and the balance of 8 and 9."""
    balance = F.when(lower > 0.001, upper / lower).otherwise(10.0)
    heavy = balance > TOP_HEAVY
    bias = F.when(digit == 8, F.when(heavy, -BALANCE_BIAS).otherwise(BALANCE_BIAS)).when(digit == 9, F.when(heavy, BALANCE_BIAS).otherwise(-BALANCE_BIAS)).otherwise(0.0)
    return GLYPH_SHAPE * shape + GLYPH_STRUCTURE * structure + F.when(holes == own_holes, HOLES_AGREE).otherwise(-HOLES_DIFFER) + bias


def classify_glyphs(pairs: DataFrame, key: str) -> DataFrame:
    """(key, digit, score, margin) from scored pairs (key, digit, score), several templates to a digit."""
    each = pairs.groupBy(key, "digit").agg(F.max("score").alias("score"))
    order = each.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "digit"))), 1, 2).alias("m"))  # ten digits
    return order.select(key, F.col("m")[0]["digit"].alias("digit"), (-F.col("m")[0]["minus"]).alias("score"), (F.get("m", F.lit(1))["minus"] - F.col("m")[0]["minus"]).alias("margin"))


def market_time_level(has_header: Column, has_column: Column, read: Column, blank: Column, unreadable: Column) -> Column:
    """Level of the notice about an image's days column, or null: no column, none read, some unreadable."""
    return (
        F.when(~has_column, F.when(has_header, "info").otherwise("warn"))
        .when(read == 0, F.when((blank > 0) & (unreadable == 0), "info").otherwise("warn"))
        .when(unreadable > 0, "warn")
    )


def kept_bands(bands: DataFrame) -> DataFrame:
    """Bands (grid, row, has_status, money, mls, number) with what becomes of each: "row", "row without status" where
    something else says that it is a listing, or "not a listing"."""
    evidence = (F.col("money") > 0) | F.col("mls").isNotNull() | F.col("number").isNotNull()
    return bands.withColumn("kept", F.when(F.col("has_status"), "row").when(evidence, "row without status").otherwise("not a listing"))


def assign_roles(cells: DataFrame, header: DataFrame | None = None, small: bool = False) -> DataFrame:
    """Which columns of each grid hold list, original and sold price and concessions.

    ``cells`` are (grid, col, x0, kind "money" or "integer", row, value, closed), a row per column and row of the grid;
    ``header`` (grid, role, col) is what a header names.  In order: header labels of the right kind; the sold column by
    its fill pattern against the closed rows; list and original as the rightmost full columns; concessions as the small
    integer column that is filled on closed rows only; then the checks that can overturn this: list and original the
    wrong way round, sold prices in another market than list prices, concessions too large.
    Gives grid, list, orig, sold, conc, sold_method, list_method, problems, confidence, and problem_kinds: which of
    ``none_sold``, ``apart`` and ``large`` the problems are.  ``small`` says that no column has more than ``ranks.SMALL`` rows.
    """
    filled, closed = F.col("value").isNotNull(), F.col("closed")
    met = with_median(cells, ["grid", "col"], "value", small) if small else cells
    median = [F.max("median").alias("median")] if small else []
    stats = met.groupBy("grid", "col").agg(
        F.min("x0").alias("x0"), F.min("kind").alias("kind"), F.count("*").alias("n"), F.count("value").alias("filled"), F.count_if(filled == closed).alias("agree"), F.count_if(~filled & ~closed).alias("blank"),
        F.sum(F.when(filled & ~closed, -2).when(filled, 1).otherwise(0)).alias("weighted"), F.count_if(closed).alias("n_closed"), *median,
    )
    if not small:
        stats = stats.join(medians(cells, ["grid", "col"], "value").select("grid", "col", "median"), ["grid", "col"], "left")
    entry = F.struct("x0", "col", "kind", "n", "filled", "agree", "blank", "weighted", "n_closed", "median")
    grids = stats.groupBy("grid").agg(F.array_sort(F.collect_list(entry)).alias("cols"))  # columns of a grid
    roles = ["list", "orig", "sold", "conc"]
    if header is not None:
        grids = grids.join(header.groupBy("grid").agg(*[F.min(F.when(F.col("role") == r, F.col("col"))).alias(f"h_{r}") for r in roles]), "grid", "left")
    else:
        grids = grids.withColumns({f"h_{r}": F.lit(None).cast("string") for r in roles})
    of = lambda c: F.try_element_at(F.filter("cols", lambda x: x["col"] == c), F.lit(1))
    kind = {"conc": "integer"}
    g = grids.withColumns({r: F.when(of(F.col(f"h_{r}"))["kind"] == kind.get(r, "money"), F.col(f"h_{r}")) for r in roles}).withColumns({"by_sold": F.col("sold").isNotNull(), "by_list": F.col("list").isNotNull(), "by_orig": F.col("orig").isNotNull()})
    money = lambda x: x["kind"] == "money"
    dense = lambda x: x["filled"] / x["n"] >= DENSE
    other = lambda x, *names: F.lit(True) if not names else ~F.coalesce(x["col"] == F.col(names[0]), F.lit(False)) & other(x, *names[1:])
    n_closed = F.col("cols")[0]["n_closed"]
    mixed = (n_closed > 0) & (n_closed < F.col("cols")[0]["n"])
    able = F.filter("cols", lambda x: money(x) & ~dense(x) & (x["blank"] >= FILL_BLANKS) & other(x, "list", "orig"))
    best = F.array_min(F.transform(able, lambda x: F.struct((-x["agree"] / x["n"]).alias("minus"), x["x0"].alias("x0"), x["col"].alias("col"))))
    g = g.withColumn("best", F.when(mixed, best)).withColumn("fits", F.coalesce(-F.col("best.minus") >= FILL_AGREES, F.lit(False)))
    g = g.withColumn("none_sold", F.col("sold").isNull() & mixed & ~F.col("fits") & (n_closed >= 3)).withColumn("sold", F.coalesce("sold", F.when(F.col("fits"), F.col("best.col"))))
    last = lambda cond: F.element_at(F.filter("cols", cond), -1)["col"]
    some = lambda cond: F.size(F.filter("cols", cond)) > 0
    full = lambda *names: (lambda x: money(x) & dense(x) & other(x, *names))
    any_ = lambda x: money(x) & other(x, "sold")
    g = g.withColumn("list", F.coalesce("list", F.when(some(full("sold", "orig")), last(full("sold", "orig"))).when(some(any_), last(any_))))
    g = g.withColumn("orig", F.coalesce("orig", F.when(some(full("sold", "list")), last(full("sold", "list")))))
    price = F.coalesce(of(F.col("sold"))["median"], of(F.col("list"))["median"])
    g = g.withColumn("price", price)
    small = F.filter("cols", lambda x: (x["kind"] == "integer") & (x["filled"] >= 2) & ~dense(x) & (x["blank"] >= FILL_BLANKS) & (x["weighted"] > 0) & other(x, "list", "orig", "sold") & F.coalesce(x["median"].between(F.col("price") * CONC_LOW, F.col("price") * CONC_HIGH), F.lit(True)))
    g = g.withColumn("conc", F.coalesce("conc", F.array_min(F.transform(small, lambda x: F.struct((-x["weighted"]).alias("minus"), x["x0"].alias("x0"), x["col"].alias("col"))))["col"]))
    g = settled(g)  # a row per grid
    pair = cells.join(g.select("grid", "list", "orig"), "grid").where(F.col("col").isin(F.col("list"), F.col("orig")))
    met = pair.groupBy("grid", "row").agg(F.max(F.when(F.col("col") == F.col("list"), F.col("value"))).alias("a"), F.max(F.when(F.col("col") == F.col("orig"), F.col("value"))).alias("b"))
    swap = met.groupBy("grid").agg(((F.count_if(F.col("a") != F.col("b")) >= 3) & (F.count_if(F.col("a") > F.col("b")) > SWAP_SHARE * F.count_if(F.col("a") != F.col("b")))).alias("swap"))
    g = g.join(swap, "grid", "left").withColumns({"l_": F.when(F.col("swap"), F.col("orig")).otherwise(F.col("list")), "o_": F.when(F.col("swap"), F.col("list")).otherwise(F.col("orig"))})
    sold_median, list_median = of(F.col("sold"))["median"], of(F.col("l_"))["median"]
    # Without a list median, or with one of zero, the ratio counts as zero: such sold prices are not of that market.
    ratio = F.coalesce(sold_median / F.nullif(list_median, F.lit(0)), F.lit(0.0))
    both = F.col("sold").isNotNull() & F.col("l_").isNotNull()
    g = g.withColumn("apart", both & ~ratio.between(SOLD_LOW, SOLD_HIGH)).withColumn("large", F.coalesce(of(F.col("conc"))["median"] > sold_median * CONC_HIGH, F.lit(False)))
    problems = F.col("none_sold").cast("int") + F.col("apart").cast("int") + F.col("large").cast("int")
    sold_method = F.when(F.col("apart") | F.col("sold").isNull(), None).when(F.col("by_sold"), "header").otherwise("fill-pattern")
    # How a column was found goes with it when the two are swapped.
    list_by_header = F.when(F.coalesce("swap", F.lit(False)), F.col("by_orig")).otherwise(F.col("by_list"))
    list_method = F.when(F.col("l_").isNull(), None).when(list_by_header, "header").otherwise("position")
    kinds = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("none_sold", "apart", "large")]))
    out = g.withColumns({"sold_method": sold_method, "list_method": list_method, "problems": problems})
    return out.select(
        "grid", F.col("l_").alias("list"), F.col("o_").alias("orig"), F.when(~F.col("apart"), F.col("sold")).alias("sold"), F.when(~F.col("large"), F.col("conc")).alias("conc"), "sold_method", "list_method", "problems",
        F.round(confidence([F.col("list_method"), F.col("sold_method")], F.col("problems")), 6).alias("confidence"), kinds.alias("problem_kinds"),
    )
