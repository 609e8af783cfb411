"""Text rules as a table, for rules by the hundred thousand.

A rule's pattern holds one gram (``GRAM`` characters, fewer for shorter patterns) that is
rarest in a share of the texts: its anchor. The distinct grams of each text meet the
anchors in one join of hashes; a document that holds a rule's anchor is a candidate,
and ``contains`` on its text decides. The plan has the same size for any number of
rules, and only candidates' texts are moved, once each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.rules import DEFAULT_RULES, EXTRACTOR, SOURCE, TextRule
from dossier.session import materialise

GRAM = 6
# One text in so many is counted to tell rare grams; it changes speed only.
COUNTED_SHARE = 64

RULES = (
    "rule_seq int, key string, label string, pattern string, ignore_case boolean, value string, confidence double, "
    "evidence_text string, absent_case_type string, absent_confidence double, absent_evidence_text string"
)


def rule_table(spark: SparkSession, rules: Sequence[TextRule] = DEFAULT_RULES) -> DataFrame:
    """Rules of the job's code as a table; others are read from where they are kept."""
    return spark.createDataFrame([(n, *rule) for n, rule in enumerate(rules)], RULES)


def _grams(chars: Column, size: int) -> Column:
    """Hashes of the distinct stretches of ``size`` characters."""
    first = F.sequence(F.lit(0), F.size(chars) - size)
    found = F.transform(first, lambda i: F.xxhash64(*[F.get(chars, i + k) for k in range(size)]))
    return F.when(F.size(chars) >= size, F.array_distinct(found))


def _with_grams(rows: DataFrame, text: str, sizes: list[int], *kept: str) -> DataFrame:
    """One row per distinct gram of each of the sizes: ``kept``, size, gram.

    Characters are taken apart once: reaching the n-th of a text takes n steps.
    """
    chars = rows.select(*kept, F.split(F.lower(text), "").alias("chars"))
    of_size = [F.struct(F.lit(n).alias("size"), _grams(F.col("chars"), n).alias("grams")) for n in sizes]
    if not sizes:
        none = F.array().cast("array<struct<size: int, grams: array<bigint>>>")
        return chars.select(*kept, F.inline(none)).select(*kept, "size", F.explode("grams").alias("gram"))
    by_size = chars.select(*kept, F.inline(F.array(*of_size)))
    return by_size.select(*kept, "size", F.explode("grams").alias("gram"))


def anchors(texts: DataFrame, rules: DataFrame) -> tuple[DataFrame, list[int]]:
    """(rule_seq, size, gram) of each rule's rarest gram, and the sizes there are."""
    size = F.least(F.length(F.lower("pattern")), F.lit(GRAM))
    sized = rules.filter("pattern <> ''").withColumn("own", size)
    # At most ``GRAM`` numbers.
    sizes = sorted(row.own for row in sized.select("own").distinct().collect())
    held = _with_grams(sized, "pattern", sizes, "rule_seq", "own").filter("size = own").drop("own")
    counted = texts.filter(F.pmod(F.xxhash64("document_id"), F.lit(COUNTED_SHARE)) == 0)
    seen = _with_grams(counted, "text", sizes, "document_id").join(
        held.select("size", "gram").distinct(), ["size", "gram"], "left_semi"
    )
    seen = seen.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    rarest = held.join(seen, ["size", "gram"], "left").groupBy("rule_seq", "size").agg(F.min(rarity).alias("rarest"))
    return materialise(rarest.select("rule_seq", "size", "rarest.gram"), "anchors"), sizes


def table_hits(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(document_id, rule_seq) of every rule whose pattern a text holds.

    ``texts``: document_id and text. A rule with an empty pattern never reports.
    """
    anchored, sizes = anchors(texts, rules)
    met = _with_grams(texts, "text", sizes, "document_id").join(anchored, ["size", "gram"])
    # Rules per document, so that a text moves once for all its rules.
    asked = met.groupBy("document_id").agg(F.collect_set("rule_seq").alias("asked"))
    found = texts.select("document_id", "text", F.lower("text").alias("lowered")).join(asked, "document_id")
    tried = found.select("document_id", "text", "lowered", F.explode("asked").alias("rule_seq")).join(
        rules.select("rule_seq", "pattern", "ignore_case"), "rule_seq"
    )
    held = F.when(F.col("ignore_case"), F.contains("lowered", F.lower("pattern"))).otherwise(F.contains("text", "pattern"))
    return tried.filter(held).select("document_id", "rule_seq")


def table_fields(texts: DataFrame, case_types: DataFrame, rules: DataFrame) -> DataFrame:
    """Per document the fields its rules report, in rule order: document_id, found.

    ``case_types``: document_id and case_type of the documents of known cases. As many
    fields as there are rules, at most, make one row.
    """
    hits = materialise(table_hits(texts.join(case_types, "document_id", "left_semi"), rules), "hits")
    present = hits.join(rules, "rule_seq").select(
        "document_id", "rule_seq", "key", "label", "value", "confidence", "evidence_text"
    )
    missing = case_types.join(rules, F.col("case_type") == F.col("absent_case_type")).join(
        hits, ["document_id", "rule_seq"], "left_anti"
    )
    absent = missing.select(
        "document_id", "rule_seq", "key", "label", F.lit("").alias("value"),
        F.col("absent_confidence").alias("confidence"), F.col("absent_evidence_text").alias("evidence_text"),
    )
    field = F.struct("rule_seq", "key", "label", "value", "confidence", "evidence_text")
    fields = present.unionByName(absent).groupBy("document_id")
    return fields.agg(F.array_sort(F.collect_list(field)).alias("found"))


def as_fields(found: Column, bbox: Column) -> Column:
    """What ``table_fields`` found as the fields of a document whose first box is ``bbox``."""
    return F.transform(
        F.coalesce(found, F.array()),
        lambda f: F.struct(
            f["key"].alias("key"),
            f["label"].alias("label"),
            f["value"].alias("value"),
            f["confidence"].alias("confidence"),
            F.lit(True).alias("required"),
            F.lit(SOURCE).alias("source"),
            bbox.alias("bbox"),
            F.lit(1).cast("long").alias("source_page"),
            bbox.alias("evidence_bbox"),
            f["evidence_text"].alias("evidence_text"),
            F.lit(EXTRACTOR).alias("extracted_by"),
        ),
    )
