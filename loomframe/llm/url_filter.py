"""URL rules, and gradient-boosted trees on lexical features for the urls that no rule names. DataFrame and ML only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path): the rule fits the host and its subdomains if the path starts with the rule's path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labelled urls that the trees are fitted on, at most (expected; chosen by hash of the url), and host suffixes with statistics.
SAMPLE, SUFFIXES = 20_000, 256
FEATURES = ("f_length", "f_host", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_labels", "f_rate", "f_seen")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. Of equally long rules the first one wins."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def lexical(urls: DataFrame, url: str = "_url") -> DataFrame:
    """Adds the lexical features of a url: lengths, depth, digit ratio, entropy of its characters, counts, suffix."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = split_url(F.col(url))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(F.col("_chars"), lambda x: x == c)) / F.col("_n")
    return (
        urls.withColumns({"_host": host, "_path": path, "_n": n, "_chars": chars})
        .withColumns({
            "f_length": F.col("_n"),
            "f_host": F.length("_host").cast("double"),
            "f_depth": F.size(F.split(F.col("_path"), "/")).cast("double"),
            "f_digits": F.length(F.regexp_replace(text, "[^0-9]", "")) / F.col("_n"),
            "f_entropy": F.aggregate(F.array_distinct("_chars"), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))),
            "f_params": (F.size(F.split(text, "[?&]")) - 1).cast("double"),
            "f_hyphens": F.length(F.regexp_replace(text, "[^-_]", "")).cast("double"),
            "f_labels": F.size(F.split(F.col("_host"), "[.]")).cast("double"),
            "_suffix": F.regexp_extract("_host", r"([^.]*\.)?[^.]*$", 0),
        })
        .drop("_chars", "_n")
    )


class UrlModel:
    """Trees and the statistics of host suffixes; `prior` alone where the labels held a single class or none."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, prior: float):
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    def score(self, urls: DataFrame, url: str = "_url") -> DataFrame:
        """Adds score: the probability (0 to 1) that a url is to be blocked."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(self.prior))
        rows = _with_suffix(lexical(urls, url), self.suffixes, self.prior)
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = self.trees.transform(rows).withColumn("score", vector_to_array("probability")[1])
        return scored.select(*urls.columns, "score")


def _with_suffix(rows: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    return rows.join(F.broadcast(suffixes), "_suffix", "left").fillna({"f_rate": prior, "f_seen": 0.0})


def fit(labelled: DataFrame, sample: int = SAMPLE, suffixes: int = SUFFIXES, rounds: int = 10, depth: int = 4, seed: int = 7) -> UrlModel:
    """Boosted trees from labelled(_url, _block 0 or 1), on about `sample` rows chosen by hash of the url.

    Null labels are left out. The suffix statistics are the block rate (smoothed by the prior) and the count of the
    `suffixes` most frequent host suffixes of the sample: a table of fixed size, which is broadcast.
    """
    rows = labelled.filter("_block is not null and _url is not null").select("_url", F.col("_block").cast("double").alias("_block"))
    total = rows.count()
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64("_url"), F.lit(10**15)) < int(10**15 * sample / total))
    rows = rows.coalesce(8).cache()
    try:
        seen = {r["_block"]: r["n"] for r in rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}
        n, blocked = sum(seen.values()), seen.get(1.0, 0)
        prior = blocked / n if n else 0.0
        if not n or len(seen) < 2:
            return UrlModel(None, None, prior)
        known = lexical(rows).groupBy("_suffix").agg(F.count(F.lit(1)).alias("_c"), F.sum("_block").alias("_b"))
        known = known.orderBy(F.desc("_c"), "_suffix").limit(suffixes).collect()
        stats = rows.sparkSession.createDataFrame(
            [(r["_suffix"], (r["_b"] + 10 * prior) / (r["_c"] + 10), float(r["_c"]) / n) for r in known], "_suffix string, f_rate double, f_seen double"
        )
        data = _with_suffix(lexical(rows), stats, prior)
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data).select("features", F.col("_block").alias("label"))
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.2, maxBins=32).fit(data)
        return UrlModel(trees, stats, prior)
    finally:
        rows.unpersist()


def judge(pages: DataFrame, model: UrlModel, rules=RULES, id_col: str = "page_id", url_col: str = "url", at: float = 0.5) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score. The rule's verdict stands; else the trees block from `at` on.

    A null url has an empty host and path, no rule, and the score of the empty string. Repeated rows and ids are
    judged each; other columns of pages are ignored.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("_url"))
    host, path = split_url(F.col("_url"))
    rows = model.score(rows).withColumns({"host": host, "path": path})
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("score") >= at, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, learnt).alias("verdict"), "score")
