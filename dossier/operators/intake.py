"""Case requests to cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import stable_id
from dossier.schemas import (
    CASE_TYPES,
    DEFAULT_CASE_TYPE,
    DEFAULT_INSTITUTION,
    DEFAULT_RISK,
    DOCUMENT_TYPES,
)


def _outside(column: str, domain: tuple[str, ...]):
    return F.when(
        F.col(column).isNotNull() & ~F.col(column).isin(*domain), f"{column} is not allowed"
    )


def _required(column: str):
    return F.when(F.col(column).isNull(), f"{column} is required")


# What makes a row of each kind unacceptable, first reason wins.
CHECKS = {
    "case": lambda: (_required("applicant_name"), _outside("case_type", CASE_TYPES)),
    "upload": lambda: (_outside("declared_document_type", DOCUMENT_TYPES),),
    "review": lambda: (_required("reviewer"), _required("decision")),
}


def check_domain(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``)."""
    judged = rows.withColumn("reason", F.coalesce(*CHECKS[kind]()))
    accepted = judged.filter(F.col("reason").isNull()).drop("reason")
    return accepted, judged.filter(F.col("reason").isNotNull())


def create_cases(requests: DataFrame) -> DataFrame:
    """Cases from accepted requests, ids and defaults filled in."""
    generated = stable_id("case", F.col("case_seq"), F.col("created_at"), F.col("applicant_name"))
    return requests.select(
        F.coalesce("case_id", generated).alias("case_id"),
        F.coalesce("case_type", F.lit(DEFAULT_CASE_TYPE)).alias("case_type"),
        "applicant_name",
        F.coalesce("institution_id", F.lit(DEFAULT_INSTITUTION)).alias("institution_id"),
        "branch_code",
        F.col("customer_ref").alias("integration_ref"),
        F.lit("created").alias("status"),
        F.lit(DEFAULT_RISK).alias("risk_level"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        "case_seq",
    )
