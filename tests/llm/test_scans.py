import random

from pyspark.sql import functions as F

from quern.llm import scans as S

BODY = "the quarterly inventory reports were maintained with regular management reviews and careful preparation in long-term improvement of internal processes"


def pages(spark):
    rows = []
    for d in range(40):
        name = f"ANNA W{'abcdefghij'[d % 10] * 4}".upper()
        for p in (1, 2, 3):
            head = f"{name}\n\n" if p == 1 else f"CV {name.title()}\n\n"
            rows.append((d, p, head + "SUMMARY\n\n" + BODY.replace(" with ", "\nwith ") + f".\n\n{BODY}.\nReliable and careful.\n- {p} -", True, 0.8))
    text = "CV Anna Wbbbb\nthe quarter1y inven-\ntory reports were main­\ntained in long-\nterm improvement.\nCourses completed\n7\n- 4 -"
    rows += [(1, 4, text, True, 0.8), (1, 4, text, True, 0.8), (2, 4, None, True, None), (3, 4, " \n ", False, None), (4, 4, "tbe quarterly 24/7 B2B\nman-", False, None)]
    return spark.createDataFrame(rows, "doc_id long, page_number int, text string, used_ocr boolean, ocr_confidence double")


def test_defects(spark):
    got = sorted((r.line_no, r.defect) for r in S.line_defects(pages(spark)).where("doc_id = 1 and page_number = 4").collect())
    assert got == [(1, "furniture"), (2, "hyphen"), (2, "misread"), (3, "hyphen"), (8, "furniture")]
    every = S.line_defects(pages(spark))
    assert every.where("doc_id = 4 and page_number = 4 and defect = 'misread'").count() == 0  # native pages have no misreadings
    assert every.where("line_no = 1 and page_number = 1").count() == 0  # title lines stay
    assert every.where("doc_id in (2, 3) and page_number = 4").count() == 0


def test_paragraphs(spark):
    text = S.paragraphs(pages(spark)).where("doc_id = 1").first().text
    assert "the quarterly inventory reports were maintained in long-term improvement." in text
    assert "CV Anna" not in text and "- 4 -" not in text


def test_empty(spark):
    assert S.line_defects(pages(spark).where(F.lit(False))).count() == 0


def agency_pages(spark):
    rng, words, rows = random.Random(6), BODY.split(), []
    prose = lambda: " ".join(rng.choices(words, k=9))
    for d in range(30):
        agency = "".join("bdfgklmnprst"[(d * k + k) % 12] + "aeiou"[d % 5] for k in (1, 5, 7))
        for p in range(1, 5):
            foot = f"Confidential - {agency.title()} Staffing" if d < 20 and (p > 1 or d % 2) else f"Dossier {agency} prepared only here" if d == 25 else ""
            head = f"Anna {agency.title()}\n\nEXPERIENCE" if p == 1 else prose()
            rows.append((d, p, f"{head}\n{prose()}\n{prose()}\nEXPERIENCE\n{prose()}\n{prose()}\n{foot}\n- {p} -", True, 0.8))
    rows.append((40, 1, f"SUMMARY\n{BODY}\nmore of {BODY[:50]}\nGonfidential - Sole Staffing", True, 0.8))  # one page, no recurrence within the document
    return spark.createDataFrame(rows, "doc_id long, page_number int, text string, used_ocr boolean, ocr_confidence double")


def test_headers_of_one_document(spark):
    rows = agency_pages(spark)
    got = {(r.doc_id, r.page_number, r.line_no) for r in S.line_defects(rows).where("defect = 'furniture'").collect()}
    lines = {(r.doc_id, r.page_number, i): x for r in rows.collect() for i, x in enumerate(r.text.split("\n"), 1)}
    want = {k for k, x in lines.items() if "Staffing" in x or x.startswith(("Dossier", "- "))}
    assert got == want
    alone = S.line_defects(rows.where("doc_id = 25")).where("defect = 'furniture'").collect()
    assert {(r.page_number, lines[25, r.page_number, r.line_no][:7]) for r in alone} >= {(p, "Dossier") for p in range(1, 5)}
