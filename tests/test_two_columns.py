"""Lines and dispositions of prints in two columns."""

from __future__ import annotations

import pytest

from millrace.operators import gazette as G

CHARS = "document string, page int, char string, x0 double, top double, size double, font string, nth int"


def typeset(*lines, document="d"):
    """Characters of (page, x, top, font, size, text); a font a|b is a for leading digits and b for the rest."""
    rows = []
    for page, x, top, font, size, text in lines:
        first, _, rest = font.partition("|")
        digits = len(text) - len(text.lstrip("0123456789"))
        rows += [(document, page, c, x + 5.0 * i, top, size, first if i < digits or not rest else rest, len(rows) + i) for i, c in enumerate(text)]
    return rows


HEAD = (1, 60.0, 50.0, "F", 9.0, "Boletín Oficial de allí núm. 12, martes 1 de marzo de 2005")
SECTION = (1, 50.0, 100.0, "X-Bold", 13.0, "II. Avisos")


def parsed(spark, *lines, **other):
    return [r.asDict() for r in G.column_dispositions(spark.createDataFrame(typeset(*lines, **other), CHARS), base="https://x.org").orderBy("document", "disposition").collect()]


def test_lines_are_cut_by_side_and_by_tops(spark):
    chars = [("d", 1, "b", 20.0, 101.5, 9.0, "A", 0), ("d", 1, "a", 10.0, 100.0, 11.0, "B", 1), ("d", 1, " ", 15.0, 100.0, 30.0, "C", 2), ("d", 1, "z", 300.0, 100.0, 8.0, "A", 3), ("d", 1, "c", 10.0, 106.0, 8.0, "A", 4), ("d", 1, " ", 12.0, 130.0, 8.0, "A", 5)]
    lines = G.column_lines(spark.createDataFrame(chars, CHARS)).orderBy("side", "line").collect()
    assert [(r.side, r.line, r.text, r.top, r.font, r.first_font, r["size"]) for r in lines] == [
        (0, 0, "a b", 100.0, "B", "B", 11.0),  # of two fonts with one character each the leftmost; sizes 9 and 11: the upper
        (0, 1, "c", 106.0, "A", "A", 8.0),
        (1, 0, "z", 100.0, "A", "A", 8.0),
    ]
    whole = G.column_lines(spark.createDataFrame(chars, CHARS), None).collect()
    assert sorted(r.text for r in whole) == ["a bz", "c"]


def test_single_column_prints_are_one_side(spark):
    """Lines go across the page where it has no sides."""
    chars = spark.createDataFrame(typeset((1, 50.0, 100.0, "A", 9.0, "one line"), (1, 50.0, 112.0, "B", 8.0, "and  another"), (2, 50.0, 90.0, "A", 9.0, "x")), CHARS)
    assert [(r.page, r.line, r.text, r.top, r.font, r["size"]) for r in G.text_lines(chars).orderBy("page", "line").collect()] == [(1, 0, "one line", 100.0, "A", 9.0), (1, 1, "and  another", 112.0, "B", 8.0), (2, 0, "x", 90.0, "A", 9.0)]


def test_two_documents_of_a_file_with_their_metadata(spark):
    rows = parsed(
        spark,
        HEAD,
        (1, 50.0, 90.0, "X-Bold|X-Italic", 11.0, "5 antes de la primera sección"),
        SECTION,
        (1, 50.0, 130.0, "X-Bold|X-Italic", 11.0, "7 Sin entidad"),
        (1, 50.0, 160.0, "X-Roman", 11.0, "Texto."),
        (1, 300.0, 100.0, "X-Bold", 11.0, "Casa"),
        (1, 300.0, 112.0, "X-Bold", 11.0, "Mayor"),
        (1, 300.0, 130.0, "X-Bold|X-Italic", 11.0, "8 Con"),
        (1, 300.0, 145.0, "X-Italic", 11.0, "entidad"),
        (1, 300.0, 180.0, "X-Roman", 11.0, "Uno"),
        (1, 300.0, 195.0, "X-Italic", 11.0, "en cursiva"),
        (2, 50.0, 100.0, "X-Bold|X-Italic", 11.0, "9 Otra"),
    )
    assert [(r["number"], r["organization"], r["title"], r["paragraphs"]) for r in rows] == [(7, None, "Sin entidad", ["Texto."]), (8, "Casa Mayor", "Con entidad", ["Uno en cursiva"]), (9, "Casa Mayor", "Otra", [])]
    assert {(r["year"], r["issue"], r["date"], r["section"], r["pdf"]) for r in rows} == {(2005, 12, "2005-03-01", "Avisos", "https://x.org/2005/012/2005-012.pdf")}


def test_a_section_forgets_the_entity_and_ends_the_text(spark):
    rows = parsed(spark, SECTION, (1, 50.0, 120.0, "X-Bold", 11.0, "Casa"), (1, 50.0, 140.0, "X-Bold", 11.0, "1 Uno"), (1, 50.0, 160.0, "X-Bold", 13.0, "III. Otros"), (1, 50.0, 180.0, "X-Roman", 11.0, "de nadie"), (1, 50.0, 200.0, "X-Bold", 11.0, "2 Dos"), document="no-head")
    assert [(r["number"], r["section"], r["organization"], r["paragraphs"], r["year"], r["pdf"]) for r in rows] == [(1, "Avisos", "Casa", [], None, None), (2, "Otros", None, [], None, None)]


@pytest.mark.parametrize("lines", [[HEAD], [HEAD, SECTION], [(1, 50.0, 100.0, "X-Bold", 11.0, "3 Sin sección")]])
def test_without_a_disposition_there_is_no_row(spark, lines):
    assert parsed(spark, *lines) == []


def test_footers_give_year_issue_number_and_link(spark):
    lines = spark.createDataFrame([("a", 1, 0, "Lunes 3 de Nunca de 2020", "F", 9.0, 50.0), ("a", 1, 1, "Martes 4 de mayo de 2021", "F", 9.0, 60.0), ("a", 1, 2, "Un título", "X-Italic", 11.0, 200.0), ("a", 1, 3, "BOC-A-2022-31-407", "F", 8.0, 780.0), ("b", 1, 0, "9 Nada", "X-BoldItalic", 11.0, 200.0)], "document string, page int, line int, text string, font string, size double, top double")
    done = {r.document: r for r in G.printed_documents(lines, base="https://x.org").collect()}
    assert (done["a"].date, done["a"].year, done["a"].issue, done["a"].number, done["a"].pdf) == ("2021-05-04", 2020, 31, 407, "https://x.org/boc-a-2022-31-407.pdf")
    assert (done["b"].date, done["b"].year, done["b"].issue, done["b"].number, done["b"].pdf) == (None, None, None, 9, None)
