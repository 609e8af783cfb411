"""Confidence routing and reviewer decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.rounding import round2

# Lower bounds of the two upper routes.
AUTO_APPROVE_FROM = 0.95
REVIEW_FROM = 0.80


def route(confidence: Column) -> Column:
    return (
        F.when(confidence >= AUTO_APPROVE_FROM, "auto_approved")
        .when(confidence >= REVIEW_FROM, "review_required")
        .otherwise("manual_entry")
    )


def overall_confidence(confidence: Column, required: Column) -> Column:
    """Aggregate: the lowest confidence of the required fields; 0.0 without any."""
    counted = F.when(F.coalesce(required, F.lit(True)), F.coalesce(confidence, F.lit(0.0)))
    return round2(F.coalesce(F.min(counted), F.lit(0.0)))


def decided_status(decision: Column) -> Column:
    """Status after a review; any other word than the two keeps it in review."""
    return (
        F.when(decision == "approve", "approved")
        .when(decision == "reject", "rejected")
        .otherwise("review_required")
    )


def decided_action(decision: Column, subject: str) -> Column:
    """Audit action of a review; ``subject`` is ``case`` or ``review``."""
    return (
        F.when(decision == "approve", f"{subject}_approved")
        .when(decision == "reject", f"{subject}_rejected")
        .otherwise("review_saved")
    )
