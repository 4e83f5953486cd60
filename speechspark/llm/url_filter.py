"""URL verdicts: longest-match rules, and gradient-boosted trees for the urls that no rule fits.

All steps are DataFrame functions and Spark's own boosted trees; no Python runs on the executors.
Features are lexical: lengths, depth, digit ratio, entropy, parameter counts, and suffix statistics
(the share of blocked labels by host suffix, smoothed towards the overall share).  The trees are fitted
on a sample of labelled urls of at most about ``max_labelled`` rows, chosen by a hash of the url; every url is scored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechspark.llm.common import stored

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
FEATURES = [
    "n_host", "n_path", "n_query", "host_depth", "path_depth", "digit_ratio", "symbol_ratio", "entropy", "n_params",
    "longest_label", "longest_segment", "suffix_share",
]
MAX_LABELLED = 20_000
TREES, DEPTH, SEED = 20, 3, 17
SMOOTHING = 20.0


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or the end, lower-cased; then up to ? or #.  Else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def apply_rules(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``ruled``: the rule with the longest text that fits (``host``, ``path``), else nulls.

    Rules of equal text keep the first.  Up to a few hundred rules; a list of conditions needs no join.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in reversed(ordered):
        host = host.lower()
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rows.withColumns({"rule": rule, "ruled": verdict})


def lexical(rows: DataFrame) -> DataFrame:
    """Add the lexical features of (``url``, ``host``, ``path``), and ``suffix``, the last two labels of the host."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    count = lambda c, pattern: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")
    ratio = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    most = lambda c, by: F.coalesce(F.array_max(F.transform(F.split(c, by), F.length)), F.lit(0)).cast("double")
    out = rows.withColumn("chars", F.array_sort(F.split(url, "")))
    # Entropy from the runs of the sorted characters.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("chars") - 1), lambda k: (k == 0) | (F.get("chars", k) != F.get("chars", k - 1)))
    out = out.withColumn("starts", starts)
    share = lambda x, k: (F.coalesce(F.get("starts", k + 1), F.size("chars")) - x) / F.size("chars")
    entropy = F.aggregate(
        F.transform("starts", share), F.lit(0.0), lambda a, p: a - p * F.log(p) / math.log(2))
    return out.withColumns({
        "n_host": F.length("host").cast("double"), "n_path": F.length("path").cast("double"),
        "n_query": F.length(query).cast("double"), "host_depth": count(F.col("host"), "\\."), "path_depth": count(F.col("path"), "/"),
        "digit_ratio": ratio(count(url, "[0-9]")), "symbol_ratio": ratio(count(url, "[^0-9A-Za-z/.:]")),
        "entropy": F.coalesce(entropy, F.lit(0.0)), "n_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "longest_label": most(F.col("host"), "[.]"), "longest_segment": most(F.col("path"), "/"),
        "suffix": F.substring_index("host", ".", -2),
    }).drop("chars", "starts")


class UrlModel:
    """Fitted trees with the suffix shares that belong to them; without trees everything is allowed."""

    def __init__(self, model: Model | None, shares: DataFrame | None, overall: float):
        self.model, self.shares, self.overall = model, shares, overall

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``blocked``, the probability that a url is to be blocked."""
        if self.model is None:
            return rows.withColumn("blocked", F.lit(self.overall))
        # At most one suffix per sampled label, so the table has a bound; Spark decides whether to broadcast it.
        known = rows.join(self.shares, "suffix", "left").withColumn("suffix_share", F.coalesce("suffix_share", F.lit(self.overall)))
        scored = self.model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known))
        return scored.withColumn("blocked", F.get(vector_to_array("probability"), F.lit(1)))


def fit_urls(labelled: DataFrame, *, max_labelled: int = MAX_LABELLED, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> UrlModel:
    """Fit on rows of the lexical features, ``host``, ``path``, ``suffix`` and ``label`` (1.0: block).

    One class only, or no labels, gives a constant model.  The sample is chosen by a hash of the url, so
    that reruns agree; repeated urls are in or out together.
    """
    n = labelled.agg(F.count("*").alias("n")).first()["n"]
    share = min(1.0, max_labelled / max(n, 1))
    sample = labelled
    if share < 1:
        sample = labelled.filter(F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = stored(sample, "labelled")
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("p")).first()
    if not total["n"] or total["p"] in (0.0, 1.0):
        return UrlModel(None, None, total["p"])
    p = float(total["p"])
    shares = stored(
        sample.groupBy("suffix").agg(((F.sum("label") + SMOOTHING * p) / (F.count("*") + SMOOTHING)).alias("suffix_share")), "suffixes")
    known = sample.join(shares, "suffix")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known).select("features", "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32).fit(rows)
    return UrlModel(model, shares, p)


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED, threshold: float = 0.5,
) -> DataFrame:
    """Id, ``host``, ``path``, ``rule``, ``verdict`` and ``blocked`` (the method's probability) of every row.

    ``labelled`` has columns ``url`` and ``label`` (1: block); by default the urls that the rules decide
    are the labels.  Null urls and urls without ``://`` have empty parts and are judged by the trees like
    others; null ids are kept; repeated rows get equal rows; other columns are not read; an empty table gives no rows.
    """
    def parts(df: DataFrame) -> DataFrame:
        host, path = url_parts(F.col("url"))
        return df.withColumns({"host": host, "path": path})

    rows = lexical(apply_rules(parts(pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("url"))), rules))
    if labelled is None:
        train = rows.filter(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == "block").cast("double"))
    else:
        train = lexical(parts(labelled.select("url", F.col("label").cast("double")).dropna()))
    lexicals = [f for f in FEATURES if f != "suffix_share"]
    model = fit_urls(train.select("url", "suffix", "label", *lexicals), max_labelled=max_labelled)
    scored = model.score(rows)
    method = F.when(F.col("blocked") > threshold, "block").otherwise("allow")
    return scored.select(
        F.col("i").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "blocked")
