"""Uploaded bytes to positioned text blocks, and what is read off the blocks.

A document's pages stay inside its own row as ``array<struct>``: numbering
lines, scoring a page or joining its text needs no shuffle and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.rounding import round2
from dossier.functions.rows import with_computed
from dossier.functions.text import nonblank_lines, or_else, strip

# Page size, block geometry and block scores.
PAGE_WIDTH = 1000
PAGE_HEIGHT = 1400
BLOCK_LEFT = 80
BLOCK_RIGHT = 920
FIRST_BLOCK_TOP = 100
BLOCK_STEP = 48
BLOCK_HEIGHT = 34
FIRST_BLOCK_CONFIDENCE = 0.88
BLOCK_CONFIDENCE = 0.82
BLOCK_TYPE = "text"
LANGUAGE = "mixed"


def decode(content: Column, filename: Column) -> Column:
    """Text of the upload, or a placeholder when it is blank or not UTF-8."""
    placeholder = F.concat(
        F.lit("Uploaded scanned document: "),
        filename,
        F.lit(". Full OCR pending for binary page image."),
    )
    return or_else(strip(F.try_validate_utf8(content.cast("string"))), placeholder)


def line_blocks(text: Column) -> Column:
    """array<block>: one block per non-blank line, numbered from 1."""

    def block(line: Column, position: Column) -> Column:
        top = F.lit(FIRST_BLOCK_TOP) + position * BLOCK_STEP
        return F.struct(
            (position + 1).alias("block_index"),
            line.alias("text"),
            F.array(F.lit(BLOCK_LEFT), top, F.lit(BLOCK_RIGHT), top + BLOCK_HEIGHT)
            .cast("array<bigint>")
            .alias("bbox"),
            F.when(position == 0, FIRST_BLOCK_CONFIDENCE)
            .otherwise(BLOCK_CONFIDENCE)
            .alias("confidence"),
            F.lit(BLOCK_TYPE).alias("block_type"),
            F.lit(LANGUAGE).alias("language"),
        )

    return F.transform(nonblank_lines(text), block)


def page_confidence(blocks: Column) -> Column:
    """Mean block confidence, summed from the first block on, to two places."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("count"))
    return F.aggregate(
        blocks,
        start,
        lambda acc, block: F.struct(
            (acc["total"] + block["confidence"]).alias("total"),
            (acc["count"] + 1).alias("count"),
        ),
        lambda acc: round2(acc["total"] / acc["count"]),
    )


def document_pages() -> Column:
    """array<page> (always one page) of an upload's ``content`` and ``filename``."""
    blocks = line_blocks(decode(F.col("content"), F.col("filename")))

    def page(blocks: Column) -> Column:
        return F.struct(
            F.lit(1).alias("page_number"),
            F.lit(PAGE_WIDTH).alias("width"),
            F.lit(PAGE_HEIGHT).alias("height"),
            blocks.alias("blocks"),
            page_confidence(blocks).alias("ocr_confidence"),
        )

    return F.transform(F.array(blocks), page)


def with_pages(uploads: DataFrame) -> DataFrame:
    """Uploads with ``pages`` in place of their content."""
    return with_computed(uploads, {"pages": document_pages()}).drop("content")


def all_text(pages: Column) -> Column:
    """Block texts of all pages, one per line."""
    per_page = F.transform(pages, lambda page: page["blocks"]["text"])
    return F.array_join(F.flatten(per_page), "\n")


def first_bbox(pages: Column) -> Column:
    """Box of the first page's first block, or where that block would be."""
    first_block = F.get(F.get(pages, F.lit(0))["blocks"], F.lit(0))
    default = F.array(
        *[
            F.lit(edge)
            for edge in (
                BLOCK_LEFT,
                FIRST_BLOCK_TOP,
                BLOCK_RIGHT,
                FIRST_BLOCK_TOP + BLOCK_HEIGHT,
            )
        ]
    )
    return F.coalesce(first_block["bbox"], default.cast("array<bigint>"))


def page_table(documents: DataFrame) -> DataFrame:
    """One row per page."""
    return documents.select("document_id", F.explode_outer("pages").alias("page")).select(
        "document_id",
        "page.page_number",
        "page.width",
        "page.height",
        "page.ocr_confidence",
    )


def block_table(documents: DataFrame) -> DataFrame:
    """One row per block. Only narrow operators, so it also runs on a stream."""
    pages = documents.select("document_id", F.explode_outer("pages").alias("page"))
    return pages.select(
        "document_id", F.col("page.page_number"), F.inline_outer("page.blocks")
    ).filter(F.col("block_index").isNotNull())


def overlay(bbox: Column, width: Column, height: Column) -> Column:
    """struct<left, top, width, height>: the box in percent of the page."""
    return F.struct(
        (bbox[0] / width * 100).alias("left"),
        (bbox[1] / height * 100).alias("top"),
        ((bbox[2] - bbox[0]) / width * 100).alias("width"),
        ((bbox[3] - bbox[1]) / height * 100).alias("height"),
    )
