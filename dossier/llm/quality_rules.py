"""Quality rules: rule failures summed up by host, shrunk, and handed back to documents.

Everything is column expressions. A document's facts are computed inside its row
(no window, no shuffle of text); only one row per host leaves the map side of the
aggregate. Words are compared through 64-bit hashes of five-word windows.

Defined results: a null or blank text has no words and fails the base rule; rows
without a source count as the host ''; repeated rows are judged one by one; an
empty table gives an empty result; columns of the input beyond ``doc_id``, ``text``
and ``source`` are neither read nor touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.rows import with_computed
from dossier.llm.common import BLANKS, fresh, let, table, words
from dossier.session import materialise

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """Limits of the rules and of the host verdicts."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols_per_word: float = 0.5
    max_dup_line_share: float = 0.5
    min_word_chars: float = 2.0
    max_word_chars: float = 15.0
    #: From this shrunk failure rate on, a host's failing documents go as well.
    suspect_rate: float = 0.5
    #: From this shrunk failure rate on, all documents of the host go.
    bad_rate: float = 0.8
    #: Bounds of the prior's weight in documents.
    min_prior: float = 2.0
    max_prior: float = 1e4


def _repeat_words(w: Column) -> Column:
    """Words in five-word windows that occur twice or more, the first ones included."""

    def at(i: Column) -> Column:
        return F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))

    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)

    def covered(found: Column) -> Column:
        """``found``: windows as (hash, place), sorted."""
        same = F.filter(
            found,
            lambda x, i: ((i > 0) & (F.get(found, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))
            | (F.get(found, i + 1)["h"] == x["h"]),
        )
        return F.aggregate(
            F.sort_array(F.transform(same, lambda x: x["p"])),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"),
                p.alias("last"),
            ),
            lambda a: a["n"],
        )

    def search(hashes: Column) -> Column:
        # Most texts repeat nothing; a set tells so without sorting.
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(pairs), covered)
        )

    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(F.transform(starts, at), search)
    )


def facts(text: Column, limits: Limits = Limits()) -> Column:
    """The counts of a text and the rules it fails, as one struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(
        F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""
    )
    counted = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")
        ),
    )

    def judged(c: Column, li: Column) -> Column:
        n = c["n_words"]
        chars = F.length(F.translate(text, BLANKS, "")).cast("long")
        symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
        dup = (F.size(li) - F.size(F.array_distinct(li))).cast("long")
        base = (n < limits.min_words) | (100 * c["n_repeat_words"] > limits.max_repeat_percent * n)
        other = (
            (symbols > limits.max_symbols_per_word * n)
            | (dup > limits.max_dup_line_share * F.size(li))
            | (chars < limits.min_word_chars * n)
            | (chars > limits.max_word_chars * n)
        )
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            symbols.alias("n_symbols"),
            dup.alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            base.alias("base_failed"),
            (base | other).alias("rule_failed"),
        )

    return let(counted, lambda c: let(lines, lambda li: judged(c, li)))


def host_verdicts(judged: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per host of rows (host, rule_failed): shrunk failure rate and verdict.

    The prior is a beta distribution fitted by moments: its mean is the failure
    rate of all documents, its weight follows from how far the hosts' rates lie
    apart beyond what their sizes explain.
    """
    hosts = materialise(
        judged.groupBy("host").agg(
            F.count(F.lit(1)).alias("host_docs"),
            F.sum(F.col("rule_failed").cast("long")).alias("host_failed"),
        ),
        "hosts",
    )
    n, f = F.col("host_docs"), F.col("host_failed")
    total = hosts.agg(
        F.sum(n).alias("n"), F.sum(f).alias("f"), F.count(F.lit(1)).alias("k"),
        F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("between"),
    ).first()
    mean, weight = 0.0, limits.max_prior
    if total["n"]:
        mean = total["f"] / total["n"]
        spread = total["between"] - total["n"] * mean * mean - (total["k"] - 1) * mean * (1 - mean)
        scale = total["n"] - total["nn"] / total["n"]
        variance = spread / scale if scale > 0 else 0.0
        if variance > 0:
            weight = mean * (1 - mean) / variance - 1
        weight = min(max(weight, limits.min_prior), limits.max_prior)
    rate = (f + F.lit(mean * weight)) / (n + F.lit(weight))
    verdict = (
        F.when(rate >= limits.bad_rate, "bad")
        .when(rate >= limits.suspect_rate, "suspect")
        .otherwise("good")
    )
    return hosts.withColumn("host_rate", rate).withColumn("host_verdict", verdict)


def _kept(verdict: Column, base_failed: Column, rule_failed: Column) -> Column:
    by_host = F.when(verdict == "bad", False).when(verdict == "suspect", ~rule_failed).otherwise(True)
    return ~base_failed & by_host


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the facts, the host's figures and ``kept`` of every row."""
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = materialise(
        docs.select("doc_id", host.alias("host"), facts(F.col("text"), limits).alias("facts")).select(
            "doc_id", "host", "facts.*"
        ),
        "facts",
    )
    joined = rows.join(host_verdicts(rows, limits), "host")
    return joined.withColumn(
        "kept", _kept(F.col("host_verdict"), F.col("base_failed"), F.col("rule_failed"))
    )


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they were.

    The facts are worked out twice, once for the hosts and once in the row that
    is filtered: that costs less than sending the texts through a shuffle. They are
    fenced, or the filter would write their expression out once per mention.
    """
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    host_name, facts_name, verdict_name = fresh(docs, "host", "facts", "verdict")
    verdicts = host_verdicts(
        docs.select(host.alias("host"), facts(F.col("text"), limits)["rule_failed"].alias("rule_failed")),
        limits,
    ).select(F.col("host").alias(host_name), F.col("host_verdict").alias(verdict_name))
    found = with_computed(docs.withColumn(host_name, host), {facts_name: facts(F.col("text"), limits)})
    own = F.col(facts_name)
    kept = _kept(F.col(verdict_name), own["base_failed"], own["rule_failed"])
    return found.join(verdicts, host_name).filter(kept).select(*(docs[c] for c in docs.columns))


def op10_quality_rules(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.col("host").alias("host_name"), "host_docs", "host_failed", "host_verdict",
    )
