"""URL filters: host/path rules first, then gradient-boosted trees on lexical features.

All of it is DataFrame expressions and Spark ML's JVM trees.  The labelled URLs are those that a rule decides;
the trees learn from them and judge the rest.  Features: lengths, depth, digit and punctuation shares, character
entropy, parameter counts, labels of the host, and statistics of the host's suffix (its last label: how often
it occurs among labelled URLs, and its smoothed share of blocked ones).  A labelled URL takes these statistics from the
labelled URLs of other hosts only (its host's fold is left out), so the trees never meet their own labels in a feature.

Defined results: a null url or one without "://" has empty host and path, fits no rule and is judged like any
other; without labelled URLs the method allows everything, with labels of one kind it gives that kind; repeated
rows get equal verdicts; input columns named host, path, rule, verdict or score are replaced, all others stay; a very
long url is judged whole.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ascii_lower, stored

ITERATIONS, DEPTH, SEED = 12, 4, 17
#: Labelled rows per training partition.
ROWS = 200_000
#: Weight of the mean in a suffix's share of blocked URLs.
PRIOR = 20.0
#: Folds of hosts for the suffix statistics of labelled URLs.
FOLDS = 5
FEATURES = ["url_length", "host_length", "path_length", "query_length", "depth", "digit_share", "mark_share", "entropy", "parameters", "host_labels", "hyphens", "suffix_count", "suffix_blocked"]


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host and path prefix) that fits; a rule fits its host and all subdomains."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    share = lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n
    letters = F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")
    # Summed in character order, so that equal texts give equal doubles.
    return F.aggregate(F.array_sort(letters), F.lit(0.0), lambda s, x: s - F.when(share(x) > 0, share(x) * F.log2(share(x))).otherwise(0.0))


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` (host and path known) with the lexical features."""
    u, host, path = F.coalesce(F.col(f"`{url}`"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    return pages.withColumns(
        {
            "url_length": F.length(u),
            "host_length": F.length(host),
            "path_length": F.length(path),
            "query_length": F.length(query),
            "depth": F.length(F.regexp_replace(path, "[^/]", "")),
            "digit_share": F.length(F.regexp_replace(u, "[^0-9]", "")) / n,
            "mark_share": F.length(F.regexp_replace(u, "[0-9A-Za-z]", "")) / n,
            "entropy": _entropy(u),
            "parameters": F.when(query == "", 0).otherwise(F.length(F.regexp_replace(query, "[^&]", "")) + 1),
            "host_labels": F.when(host == "", 0).otherwise(F.length(F.regexp_replace(host, "[^.]", "")) + 1),
            "hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
            "suffix": F.regexp_extract(host, r"([^.]*)\z", 1),
        }
    )


def suffix_statistics(labelled: DataFrame, mean: float) -> DataFrame:
    """(suffix, fold, suffix_count, suffix_blocked) over labelled URLs (columns fold, and blocked, 0 or 1): for each
    fold from the URLs of the other folds, and under a null fold from all of them."""
    each = labelled.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    whole = each.groupBy("suffix").agg(F.sum("n").alias("n_all"), F.sum("b").alias("b_all"))
    apart = each.join(whole, "suffix").select("suffix", "fold", (F.col("n_all") - F.col("n")).alias("n"), (F.col("b_all") - F.col("b")).alias("b"))
    both = apart.unionByName(whole.select("suffix", F.lit(None).cast("long").alias("fold"), F.col("n_all").alias("n"), F.col("b_all").alias("b")))
    return both.select("suffix", "fold", F.log1p("n").alias("suffix_count"), ((F.col("b") + PRIOR * mean) / (F.col("n") + PRIOR)).alias("suffix_blocked"))


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS))


def judge(pages: DataFrame, rules: dict[str, str], url: str = "url", without_fold: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the method's score (share of "block").

    ``without_fold`` leaves the labelled URLs of a fold of hosts out of the training, to measure the method on them.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    kept = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{url}`").alias("url"))
    parsed = kept.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("rule")) if rules else F.lit(None).cast("string")
    known = lexical(parsed.select("url", "host", "path", by_rule.alias("label")).where(F.col("label").isNotNull()))
    known = known.withColumn("blocked", (F.col("label") == "block").cast("double")).withColumn("fold", fold_of(F.col("host")))
    if without_fold is not None:
        known = known.where(F.col("fold") != without_fold)
    known = stored(known.drop("url", "host", "path", "label"), "labelled")
    n, low, high = known.agg(F.count("*"), F.min("blocked"), F.max("blocked")).first()
    if not n or low == high:
        scored = parsed.withColumn("score", F.lit(float(high or 0.0)))
    else:
        mean = known.agg(F.avg("blocked")).first()[0]
        suffixes = stored(suffix_statistics(known, mean), "suffix")
        unseen = {"suffix_count": 0.0, "suffix_blocked": mean}
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = vector.transform(known.join(suffixes, ["suffix", "fold"])).select("features", F.col("blocked").alias("label")).repartition(-(-n // ROWS))
        model = GBTClassifier(maxIter=ITERATIONS, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(train)
        full = lexical(parsed).join(suffixes.where("fold is null").drop("fold"), "suffix", "left").fillna(unseen)
        scored = model.transform(vector.transform(full)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(by_rule, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("row.*", "host", "path", "rule", verdict.alias("verdict"), "score")

