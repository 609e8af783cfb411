"""Recognised texts to scored document records."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from dossier.operators.template_fields import (
    document_records,
    raw_text_fields,
    template_fields,
)
from dossier.session import materialise
from dossier.sources.templates import templates, without_template


class TemplateRun:
    """Records, fields and rejected documents, each planned when asked for.

    The template fields are written once: the scores, the raw-text fallback and
    the fields themselves all start from them.
    """

    def __init__(self, documents: DataFrame, observations: DataFrame, template_table: DataFrame):
        self._documents, self._observations, self._table = documents, observations, template_table
        self._written = materialise(
            template_fields(documents, observations, template_table), "template-fields"
        )

    @cached_property
    def records(self) -> DataFrame:
        return document_records(self._documents, self._written)

    @cached_property
    def fields(self) -> DataFrame:
        return self._written.unionByName(raw_text_fields(self._written, self._observations))

    @cached_property
    def rejected(self) -> DataFrame:
        return without_template(self._documents, self._table)


def read_by_template(
    documents: DataFrame, observations: DataFrame, template_table: DataFrame | None = None
) -> TemplateRun:
    """Fields, records, and the documents whose type has no template."""
    if template_table is None:
        template_table = templates(documents.sparkSession)
    return TemplateRun(documents, observations, template_table)
