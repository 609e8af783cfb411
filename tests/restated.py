"""Plain-Python restatements of single rules, to test the columns against."""

import re


def status(key: str, value: str, document_type: str) -> str:
    text = value.strip()
    # The formats that fields must have.
    formats = {
        "mobile": (r"9\d{9}", "invalid"),
        "phone": (r"9\d{9}", "invalid"),
        "email": (r"[^@\s]+@[^@\s]+\.[^@\s]+", "invalid"),
        "pan": (r"\d{9}", "warning"),
        "citizenship_number": (r"[A-Za-z0-9\-/]+", "invalid"),
        "cheque_number": (r"[A-Za-z0-9\-/]+", "invalid"),
        "dob": (r"\d{4}-\d{2}-\d{2}", "warning"),
        "date": (r"\d{4}-\d{2}-\d{2}", "warning"),
    }
    if document_type == "cheque":
        formats["amount"] = (r"\d+(\.\d{1,2})?", "warning")
    if text == "":
        return "missing"
    pattern, failed = formats.get(key, (r"(?s).*", ""))
    return "valid" if re.fullmatch(pattern, text) else failed


def reviewed(events: list[dict]) -> list[tuple]:
    """Fields of one case after its events, one at a time and in order.

    Events: ``{"fields": [(key, value)]}`` (a document) or ``{"updates": {key: value}}``.
    """
    fields: list[dict] = []
    for event in events:
        for key, value in event.get("fields", []):
            fields.append({"key": key, "value": value, "source": "document", "status": "-"})
        last = {field["key"]: field for field in fields}
        for key, value in event.get("updates", {}).items():
            if key in last:
                last[key].update(
                    value=value, source="reviewer_verified", status=status(key, value, "")
                )
            else:
                fields.append(
                    {"key": key, "value": value, "source": "reviewer_entry", "status": "valid"}
                )
    return sorted((f["key"], f["value"], f["source"], f["status"]) for f in fields)
