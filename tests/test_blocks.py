from pyspark.sql import functions as F

from dossier.operators import blocks as ocr
from dossier.operators import prompts, rules

# Upload -> lines read from it; none means the placeholder stands for the page.
EXPECTED = {
    b"one": ["one"],
    b"a\nb": ["a", "b"],
    b"a\nb\nc": ["a", "b", "c"],
    b"a\nb\nc\nd": ["a", "b", "c", "d"],
    b"\n".join(b"x%d" % i for i in range(13)): [f"x{i}" for i in range(13)],
    b"a\r\nb\r\n\r\nc\rd": ["a", "b", "c", "d"],
    b"\x80\xff": None,
    b"": None,
    b"  \n\t ": None,
    b"ok\xed\xa0\x80": None,
    b"\xc0\xaf": None,
    "a b c\x85d\x1ce\x0bf\x0cg".encode(): ["a b c", "d", "e", "f", "g"],
    "\u2003x\u3000\n\u200by\n".encode(): ["x", "\u200by"],
    b"\x1c\x1d\n z": ["z"],
    "नाम: सीता\nपान १२३".encode(): ["नाम: सीता", "पान १२३"],
}
# Lines -> score of the page.
SCORES = {1: 0.88, 2: 0.85, 3: 0.84, 4: 0.83, 5: 0.83, 13: 0.82}
CONTENTS = list(EXPECTED)


def test_blocks_of_each_upload(spark):
    rows = spark.createDataFrame(
        [(str(n), f"f{n}.txt", bytearray(c)) for n, c in enumerate(CONTENTS)],
        "document_id string, filename string, content binary",
    )
    documents = ocr.with_pages(rows).collect()
    assert len(documents) == len(CONTENTS)
    for row in documents:
        lines = EXPECTED[CONTENTS[int(row.document_id)]]
        if lines is None:
            lines = [f"Uploaded scanned document: f{row.document_id}.txt. Full OCR pending for binary page image."]
        page = row.pages[0]
        assert [b.text for b in page.blocks] == lines
        assert [b.block_index for b in page.blocks] == list(range(1, len(lines) + 1))
        assert [b.confidence for b in page.blocks] == [0.88] + [0.82] * (len(lines) - 1)
        assert page.blocks[0].bbox == [80, 100, 920, 134]
        assert page.blocks[-1].bbox == [80, 52 + 48 * len(lines), 920, 86 + 48 * len(lines)]
        assert page.ocr_confidence == SCORES[len(lines)]


def test_text_and_first_box(spark):
    rows = spark.createDataFrame([("d", "f", bytearray(b" a \n\n b"))], "document_id string, filename string, content binary")
    row = ocr.with_pages(rows).select(
        ocr.all_text(F.col("pages")).alias("t"), ocr.first_bbox(F.col("pages")).alias("b")
    ).first()
    assert (row.t, row.b) == ("a\nb", [80, 100, 920, 134])
    empty = spark.sql("SELECT CAST(array() AS " + _pages_type() + ") AS pages")
    assert empty.select(ocr.first_bbox(F.col("pages")).alias("b")).first().b == [80, 100, 920, 134]


def _pages_type():
    from pyspark.sql import types as T
    from dossier.schemas import PAGE

    return T.ArrayType(PAGE).simpleString()


def test_prompt_request(spark):
    import json
    from pyspark.sql import types as T
    from dossier.schemas import PAGE

    block = (1, "Name: \"Sita\" Sharma", [100, 120, 420, 160], 0.94, "text", "mixed")
    schema = T.StructType(
        [
            T.StructField("document_id", T.StringType()),
            T.StructField("case_type", T.StringType()),
            T.StructField("declared_document_type", T.StringType()),
            T.StructField("pages", T.ArrayType(PAGE)),
        ]
    )
    rows = spark.createDataFrame(
        [("d", "individual_kyc", "unknown", [(1, 1000, 1400, [block], 0.94), (2, 10, 20, [block], 0.9)])], schema
    )
    body = json.loads(prompts.prompt_requests(rows).first().body)
    system, user = body["messages"]
    assert system["role"] == "system"
    assert "Nepal financial KYC" in system["content"] and "JSON only" in system["content"]
    assert user["content"][0]["text"] == (
        "Case type: individual_kyc\nExpected document type: unknown\n\nOCR evidence:\n"
        "PAGE 1 (1000x1400)\n[1] bbox=[100, 120, 420, 160] conf=0.94 type=text: Name: \"Sita\" Sharma\n"
        "PAGE 2 (10x20)\n[1] bbox=[100, 120, 420, 160] conf=0.94 type=text: Name: \"Sita\" Sharma"
    )
    assert (body["temperature"], body["max_tokens"]) == (0, 900)


def test_type_words_in_order(spark):
    texts = {
        "Citizenship and PAN": "citizenship", "Company profile": "pan", "a cheque": "cheque",
        "Registration": "company_registration", "pan cheque": "pan", "nothing": "unknown",
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", rules.infer_type(F.lit("unknown"), F.lower("t")).alias("i"), rules.infer_type(F.lit("vat"), F.lower("t")).alias("d"))
    for row in got.collect():
        assert row.i == texts[row.t] and row.d == "vat"


def test_overlay(spark):
    box = spark.range(1).select(ocr.overlay(F.array(F.lit(80), F.lit(100), F.lit(920), F.lit(134)), F.lit(1000), F.lit(1400)).alias("b")).first().b
    assert tuple(box) == (80 / 1000 * 100, 100 / 1400 * 100, 840 / 1000 * 100, 34 / 1400 * 100)
