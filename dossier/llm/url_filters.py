"""URL filters: gradient-boosted trees on lexical features of a URL.

Rules (host, path) decide where they fit; a rule fits its host and all subdomains
if the URL's path starts with the rule's path, and the longest rule wins. The trees
are trained from labelled URLs and decide the rest. ``op3_url_filters`` has no other
labels than its rules' verdicts, so it learns from the URLs that rules decide.

Training takes a sample of at most ``TRAIN_ROWS`` different labelled URLs, those with
the smallest hashes, each with the number of its rows as weight, so a URL that a third
of all rows have is one example; the suffix table is made from that sample, so it has at
most as many rows. Scoring is one pass over all URLs without a shuffle.

Defined results: null URLs and URLs without ``://`` have an empty host and path and
get a verdict by the trees; repeated rows are judged alike; an empty table gives an
empty result; with labels of one class only, or none, every URL gets the score of
that class (none: 0, allow). Columns other than ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import ascii_lower, let, table
from dossier.session import materialise

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

TRAIN_ROWS = 20_000
#: Weight, in URLs, of the overall block rate in a suffix's rate.
SUFFIX_PRIOR = 20.0
FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_host_depth", "f_path_depth", "f_digits",
    "f_host_digits", "f_entropy", "f_host_entropy", "f_params", "f_hyphens", "f_fragment", "f_secure",
    "f_suffix_rate", "f_suffix_seen",
]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict); null where none fits."""
    longest_first = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    cases = [
        (
            ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start),
            F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for domain, start, verdict in longest_first
    ]
    first, *rest = cases
    return reduce(lambda chain, case: chain.when(*case), rest, F.when(*first))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    size = F.length(text)

    def bits(c: Column) -> Column:
        share = (size - F.length(F.replace(text, c, F.lit("")))) / size
        return -share * F.log2(share)

    chars = F.array_distinct(F.split(text, ""))
    used = F.filter(chars, lambda c: c != "")
    return F.when(size == 0, 0.0).otherwise(
        F.aggregate(used, F.lit(0.0), lambda total, c: total + bits(c))
    )


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def with_features(urls: DataFrame, suffixes: DataFrame, base_rate: float) -> DataFrame:
    """Adds the features; ``suffixes`` has at most ``TRAIN_ROWS`` rows."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = "0123456789"
    plain = {
        "f_length": F.length(url),
        "f_host_length": F.length(host),
        "f_path_length": F.length(path),
        "f_host_depth": _count(host, "."),
        "f_path_depth": _count(path, "/"),
        "f_digits": _count(url, digits) / F.greatest(F.length(url), F.lit(1)),
        "f_host_digits": _count(host, digits) / F.greatest(F.length(host), F.lit(1)),
        "f_entropy": let(url, _entropy),
        "f_host_entropy": let(host, _entropy),
        "f_params": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "f_hyphens": _count(url, "-_"),
        "f_fragment": F.contains(url, F.lit("#")).cast("int"),
        "f_secure": url.startswith("https").cast("int"),
    }
    joined = urls.withColumn("_suffix", _suffix(host)).join(F.broadcast(suffixes), "_suffix", "left")
    return joined.withColumns({k: v.cast("double") for k, v in plain.items()}).withColumns(
        {
            "f_suffix_rate": F.coalesce("_rate", F.lit(base_rate)),
            "f_suffix_seen": F.log1p(F.coalesce("_seen", F.lit(0)).cast("double")),
        }
    )


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """Trees from rows (url, host, path, label 0 or 1).

    Returns a function that adds ``score`` (probability of a block) to rows (url,
    host, path, ...).
    """
    place = F.xxhash64("url")
    sample = materialise(
        labelled.groupBy("url", "host", "path", F.col("label").cast("double").alias("label"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .orderBy(place, "url", "label").limit(train_rows).coalesce(1),
        "urls",
    )
    seen = {row["label"]: row["n"] for row in sample.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    if len(seen) < 2:
        constant = 1.0 if seen and 1.0 in seen else 0.0
        return lambda urls: urls.withColumn("score", F.lit(constant))
    rate = seen[1.0] / sum(seen.values())
    suffixes = materialise(
        sample.groupBy(_suffix(F.col("host")).alias("_suffix")).agg(
            (
                (F.sum(F.col("label") * F.col("weight")) + F.lit(rate * SUFFIX_PRIOR)) / (F.sum("weight") + SUFFIX_PRIOR)
            ).alias("_rate"),
            F.sum("weight").alias("_seen"),
        ),
        "suffixes",
    )
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    prepared = materialise(
        assembler.transform(with_features(sample, suffixes, rate)).select("_features", "label", "weight"), "features"
    )
    model = GBTClassifier(
        featuresCol="_features", labelCol="label", weightCol="weight",
        maxIter=12, maxDepth=4, stepSize=0.2, seed=7,
    ).fit(prepared)

    def score(urls: DataFrame) -> DataFrame:
        scored = model.transform(assembler.transform(with_features(urls, suffixes, rate)))
        return scored.withColumn("score", vector_to_array("probability")[1]).select(*urls.columns, "score")

    return score


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, score and verdict of every row of ``pages``.

    ``labelled`` has url and label (1: block); without it the rules' verdicts are the labels.
    """
    url = F.col("url").cast("string")
    urls = pages.select("page_id", url.alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    ruled = urls.withColumn("_ruled", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = ruled.filter(F.col("_ruled").isNotNull())
        given = known.withColumn("label", (F.col("_ruled.verdict") == "block").cast("int"))
    else:
        given = labelled.select("url", "label").filter("label IN (0, 1)").withColumns(
            {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
        )
    scored = train(given)(ruled)
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "url", "host", "path", F.col("_ruled.rule").alias("rule"), "score",
        F.coalesce(F.col("_ruled.verdict"), by_trees).alias("verdict"),
    )


def url_rules(spark, sf_dir) -> DataFrame:
    """The part of the URL filters that SQL can express too."""
    url = F.col("url").cast("string")
    parts = table(spark, sf_dir, "pages").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = rule_of(F.col("host"), F.col("path"))
    return parts.select("page_id", "host", "path", ruled["rule"].alias("rule"), ruled["verdict"].alias("verdict"))


def op3_url_filters(spark, sf_dir) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict", "score"
    )
