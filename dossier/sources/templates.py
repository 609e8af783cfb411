"""The template dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.schemas import TEMPLATES

# Document type, template name, then per field
# key, label, required, bbox.
TEMPLATE_FIELDS = (
    ("citizenship", "Citizenship Card", 0, "name", "Name", True, (120, 170, 520, 215)),
    ("citizenship", "Citizenship Card", 1, "dob", "Date of Birth", True, (120, 225, 360, 265)),
    (
        "citizenship",
        "Citizenship Card",
        2,
        "citizenship_number",
        "Citizenship Number",
        True,
        (470, 120, 760, 165),
    ),
    ("citizenship", "Citizenship Card", 3, "address", "Address", True, (120, 285, 760, 340)),
    (
        "citizenship",
        "Citizenship Card",
        4,
        "father_mother_name",
        "Father/Mother Name",
        False,
        (120, 350, 760, 400),
    ),
    (
        "account_opening",
        "Account Opening Form",
        0,
        "customer_name",
        "Customer Name",
        True,
        (160, 130, 620, 175),
    ),
    ("account_opening", "Account Opening Form", 1, "mobile", "Mobile", True, (160, 195, 420, 235)),
    ("account_opening", "Account Opening Form", 2, "address", "Address", True, (160, 255, 720, 305)),
    (
        "account_opening",
        "Account Opening Form",
        3,
        "account_type",
        "Account Type",
        True,
        (160, 330, 460, 370),
    ),
    ("account_opening", "Account Opening Form", 4, "pan", "PAN", False, (160, 395, 420, 435)),
    ("account_opening", "Account Opening Form", 5, "email", "Email", False, (160, 460, 620, 500)),
    ("cheque", "Cheque", 0, "cheque_number", "Cheque Number", True, (60, 40, 260, 85)),
    ("cheque", "Cheque", 1, "date", "Date", True, (600, 45, 760, 90)),
    ("cheque", "Cheque", 2, "amount", "Amount", True, (560, 180, 760, 230)),
    ("cheque", "Cheque", 3, "payee", "Payee", True, (140, 120, 650, 165)),
)


def templates(spark: SparkSession) -> DataFrame:
    """The fixed templates.

    Built from VALUES, so the planner knows how small the table is and
    broadcasts it without a hint. A larger table of one's own, with the same
    columns, is joined the way its size calls for.
    """

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    rows = ", ".join(
        f"({text(document_type)}, {text(name)}, {seq}, {text(key)}, {text(label)}, "
        f"{str(required).lower()}, array{bbox})"
        for document_type, name, seq, key, label, required, bbox in TEMPLATE_FIELDS
    )
    columns = ", ".join(TEMPLATES.fieldNames())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def template_lookup(documents: DataFrame, template_table: DataFrame) -> DataFrame:
    """Each document with the fields its type's template expects."""
    return documents.join(template_table, "document_type")


def without_template(documents: DataFrame, template_table: DataFrame) -> DataFrame:
    """Documents whose type has no template; they cannot be read by template."""
    return documents.join(template_table.select("document_type"), "document_type", "left_anti")
