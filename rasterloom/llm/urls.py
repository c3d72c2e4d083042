"""URL filters: allow and block rules, and boosted trees on lexical features, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The trees are fitted on at most so many labelled URLs, the first by MD5.
TRAIN_ROWS = 20_000
TREES, DEPTH = 12, 3
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "suffix_share", "suffix_blocked", "section_blocked")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Lexical features of ``_url``, ``host`` and ``path``."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    n = F.length(url)
    letters = F.split(url, "")
    # entropy of the letters, from their counts
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise((lambda p: p * F.log2(p))((n - F.length(F.replace(url, c, F.lit("")))) / n)))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    return df.select(
        "*", n.cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double").alias("depth"), (F.length("host") - F.length(F.translate("host", ".", ""))).cast("double").alias("labels"),
        F.when(n > 0, (n - F.length(F.translate(url, "0123456789", ""))) / n).otherwise(0.0).alias("digit_ratio"), F.when(n > 0, F.round(entropy, 9)).otherwise(0.0).alias("entropy"),
        F.when(F.length(query) > 0, F.length(query) - F.length(F.translate(query, "&", "")) + 1).otherwise(0).cast("double").alias("params"), (n - F.length(F.translate(url, "-", ""))).cast("double").alias("hyphens"),
        F.regexp_extract("host", "([^.]*)$", 1).alias("suffix"), F.regexp_extract("path", "^/([^/0-9]{0,16})", 1).alias("section"))


def with_statistics(df: DataFrame, train: DataFrame, everything: DataFrame) -> DataFrame:
    """Adds suffix statistics: the suffix's share of all rows, and the blocked rates of suffix and first path section among the labelled rows.

    The joined tables have a row for each suffix or section; Spark broadcasts them only below its own size limit.
    """
    total = everything.agg(F.count("*").alias("_n"))
    share = everything.groupBy("suffix").agg(F.count("*").alias("_rows")).crossJoin(F.broadcast(total)).select("suffix", (F.col("_rows") / F.col("_n")).alias("suffix_share"))
    out = df.join(share, "suffix", "left").fillna(0.0, ["suffix_share"])
    for key, name in (("suffix", "suffix_blocked"), ("section", "section_blocked")):
        rates = train.groupBy(key).agg(((F.sum("_y") + 1.0) / (F.count("*") + 2.0)).alias(name))
        out = out.join(rates, key, "left").fillna(0.5, [name])
    return out


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each row's host, path, rule and verdict; rows without a rule get the trees' verdict.

    ``labelled`` (url, blocked 0/1) trains the trees; where it is not given, the URLs that a
    rule decides are the labelled ones. At most ``train_rows`` of them are used, the first
    by MD5 of the url. If they lack one of the two labels (an empty table, too), rows
    without a rule get the label that there is, or ``allow``. Null urls and urls without
    ``://`` have an empty host and path and are judged like others. Repeated rows stay.
    Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = url_parts(F.col("_url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumns({"rule": rule, "_verdict": verdict}))
    if labelled is None:
        known = rows.filter("rule is not null").withColumn("_y", (F.col("_verdict") == "block").cast("double"))
    else:
        given = labelled.select(F.col("url").cast("string").alias("_url"), F.col("blocked").cast("double").alias("_y"))
        host, path = url_parts(F.col("_url"))
        known = lexical(given.withColumns({"host": host, "path": path})).filter("_y is not null")
    # sorted into one small partition, so that the same rows give the same trees
    train = known.orderBy(F.md5(F.coalesce("_url", F.lit(""))), "_url").limit(train_rows).coalesce(1).cache()
    labels = sorted(r[0] for r in train.select("_y").distinct().collect())
    if len(labels) < 2:
        method = F.lit("block" if labels == [1.0] else "allow")
        out = rows.withColumn("_score", F.lit(None).cast("double"))
    else:
        fitted = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
        model = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=32).fit(fitted.transform(with_statistics(train, train, rows)).orderBy(F.md5(F.coalesce("_url", F.lit("")))).coalesce(1).select("_x", "_y"))
        out = model.transform(fitted.transform(with_statistics(rows, train, rows))).withColumn("_score", F.round(vector_to_array("probability")[1], 9))
        method = F.when(F.col("_score") >= 0.5, "block").otherwise("allow")
    train.unpersist()
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"), F.col("_score").alias("block_score"))
