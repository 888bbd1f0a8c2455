"""Gazette pages, prints and summaries, made from the tables as their publishers lay them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import gazette as G
from millrace.operators.relational import numbered
from millrace.registry import Tables, query

SITE = "https://gazette.example.org"


def _text(template: str, **values: str) -> Column:
    """``template`` with the columns named in braces in place of them."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), F.col(values.get(name, name)).cast("string")]
    return F.concat(*parts, F.lit(rest))


def _rows(rows: tuple, columns: str) -> Column:
    """Fixed rows as an array of structs, to be put beside every row of a table."""
    kinds = [c.split() for c in columns.split(", ")]
    return F.array(*(F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, kinds, strict=True))) for row in rows))


CURRENT_LI = """<li class="justificado_boc x"><a href="/go">&gt;</a> <b>{s}</b> <a href="/d">Text
 of {name}</a><div class="document_info">About {s}. <div class="cve">ID-{s} <a title="Vista previa del documento" href="/boc/2026/{s}.html">v</a>
 <a title="Ver firma electrónica" href="/f/{s}">f</a> <a title="Descargar en formato PDF" href="https://files.example.org/{s}.pdf">p</a></div></div></li>"""
CURRENT_PAGE = """<html><head><title>Gazette - 2026/{n}</title><script>var li="<b>9</b>";</script></head><body><h2>Issue
 {n}</h2><div class="conten"><p class="justificado"><a title="Descargar en formato PDF" href="/sum/{n}.pdf">s</a><span class="cve">S <a title="firma electrónica" href="/sig/{n}">s</a></span></p>
 <h4>IV. ANUNCIOS DE LA ZONA</h4><h3 class="titboc">Sub {n}</h3><h5>Org  {n}</h5><ul>{items}</ul></div></body></html>"""
EARLY_LI = """<li class="justificado"><b>{s}</b><a class="abstract">Act {name}</a><a title="Ir a la disposición" href="boc/1990/{s}.html">h</a><a title="Descarga la disposición en PDF" href="/pdf/{s}.pdf">p</a></li>"""
EARLY_PAGE = """<h2>Boletín Nº {n}. Lunes 3 de Mayo de 1990</h2><a title="Descarga el Boletín" href="/all/{n}.pdf">b</a><div class="conten"><h4>III.- OTRAS</h4><h5>Old</h5><h4>I. LEYES</h4><ul class="summary">{items}</ul><ul><li class="justificado">no</li></ul></div>"""
PDF_PAGE = """<title>Gazette - 1980/{n}</title><h2>Scan</h2><div class="conten"><p>Only <a href="/scan/{n}.pdf">as a file<br></a></div>"""


@query(
    "txt_10_issues",
    "TXT-10",
    "SRC-27",
    sql=f"""WITH l AS (SELECT n_nationkey AS n, s_suppkey AS s, s_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey)
SELECT n AS page, 'current' AS layout, 2026 AS year, n AS issue, 'Issue ' || n AS title, '{SITE}/2026/' || lpad(n::VARCHAR, 3, '0') || '/' AS url, '{SITE}/sum/' || n || '.pdf' AS summary_url, '{SITE}/sig/' || n AS summary_signature,
  s::INT AS disposition, 'Anuncios de la Zona' AS section, 'Sub ' || n AS subsection, 'Org ' || n AS organization, s || ' Text of ' || name AS summary, 'About ' || s || '.' AS metadata, 'ID-' || s AS identifier,
  'https://files.example.org/' || s || '.pdf' AS pdf, '{SITE}/boc/2026/' || s || '.html' AS html, '{SITE}/f/' || s AS signature FROM l WHERE n % 4 = 0
UNION ALL SELECT n, 'early', 1990, n, 'Boletín Nº ' || n || '. Lunes 3 de Mayo de 1990', '{SITE}/1990/' || lpad(n::VARCHAR, 3, '0') || '/', '{SITE}/all/' || n || '.pdf', NULL,
  s::INT, 'Leyes', NULL, NULL, s || ' Act ' || name, NULL, NULL, '{SITE}/pdf/' || s || '.pdf', '{SITE}/boc/1990/' || s || '.html', NULL FROM l WHERE n % 4 = 1
UNION ALL SELECT DISTINCT n, 'pdf_only', 1980, n, 'Scan', '{SITE}/1980/' || lpad(n::VARCHAR, 3, '0') || '/', '{SITE}/scan/' || n || '.pdf', NULL, NULL::INT, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM l WHERE n % 4 = 2
UNION ALL SELECT DISTINCT n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL::INT, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM l WHERE n % 4 = 3""",
)
def issues(t: Tables) -> DataFrame:
    """Issue pages of three layouts and of none; a row for each disposition."""
    n, s = F.col("n_nationkey"), {"n": "n_nationkey", "s": "s_suppkey", "name": "s_name"}
    item = F.when(n % 4 == 0, _text(CURRENT_LI, **s)).when(n % 4 == 1, _text(EARLY_LI, **s))
    listed = t.nation.join(t.supplier, F.col("s_nationkey") == n).groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("li")))).alias("own"))
    pages = listed.withColumn("items", F.array_join(F.transform("own", lambda x: F.coalesce(x["li"], F.lit(""))), "\n"))
    html = F.when(n % 4 == 0, _text(CURRENT_PAGE, **s)).when(n % 4 == 1, _text(EARLY_PAGE, **s)).when(n % 4 == 2, _text(PDF_PAGE, **s)).otherwise("<p>Nothing</p>")
    dealt = pages.select(n.alias("page"), html.alias("html")).repartition(t.spark.sparkContext.defaultParallelism, "page")  # few pages, each of them long
    read = G.parsed_issues(dealt, base=SITE)
    return read.select("page", "layout", "year", "issue", "title", "url", F.col("summary.url").alias("summary_url"), F.col("summary.signature").alias("summary_signature"), F.inline_outer("dispositions"))


MODERN_DOCUMENT = """<html><head><title>Gazette - 2025/{s}</title><META NAME="DocumentNumber" CONTENT="D{s}"><meta name="documentdate" content="2025-01-02"><meta name="entity" content='The "{s}" \\ Co'></head>
<body><div class="conten"><h5>Sec {s} - Sub -  Org</h5><h3><b>{s}</b> ORDER of
 {name}<p>noise <span class="cve">ID-{s}. <a title="firma electrónica" href="/f">f</a> <a title="En PDF" href="/p/{s}.pdf">p</a></span></p></h3>
<p>First <b>bold</b> and <a href="/t?x=1">a link
 text</a>.<br/>Second  line</p><p><span class="cve">skipped</span></p><p> </p><p>Last &amp; least</p></div></body></html>"""
OLD_DOCUMENT = """<title>Old 1999/7</title><div class="bloq_contenido"><h4>The Section</h4><h5>Org {s}</h5><h3>{s} - REAL DECRETO {name}</h3><p class="justificado"><a href="old/{s}.pdf"><img class="icon_pdf"></a></p><p>Body of {s}</p></div>"""


@query(
    "txt_11_documents",
    "TXT-11",
    sql=f"""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Sub' END AS subsection, CASE WHEN s_suppkey % 2 = 0 THEN 'ID-' || s_suppkey END AS identifier, CASE WHEN s_suppkey % 2 = 0
THEN '---
year: 2025
issue: ' || s_suppkey || '
document: "D' || s_suppkey || '"
number: ' || s_suppkey || '
date: "2025-01-02"
entity: "The \\"' || s_suppkey || '\\" \\\\ Co"
section: "Sec ' || s_suppkey || '"
subsection: "Sub"
organization: "Org"
identifier: "ID-' || s_suppkey || '"
pdf: "{SITE}/p/' || s_suppkey || '.pdf"
signature: "{SITE}/f"
---

# ORDER of ' || s_name || '

First bold and [a link text]({SITE}/t?x=1).
Second line

Last & least'
ELSE '---
year: 1999
issue: 7
number: ' || s_suppkey || '
section: "The Section"
organization: "Org ' || s_suppkey || '"
pdf: "{SITE}/old/' || s_suppkey || '.pdf"
---

# REAL DECRETO ' || s_name || '

Body of ' || s_suppkey END AS markdown FROM supplier""",
)
def documents(t: Tables) -> DataFrame:
    """Pages of two periods as Markdown with front matter."""
    s = {"s": "s_suppkey", "name": "s_name"}
    html = F.when(F.col("s_suppkey") % 2 == 0, _text(MODERN_DOCUMENT, **s)).otherwise(_text(OLD_DOCUMENT, **s))
    return G.parsed_documents(t.supplier.select("s_suppkey", html.alias("html")), base=SITE).select("s_suppkey", "subsection", "identifier", "markdown")


#: Lines of a print: page, top, font, size, text.
PRINT = (
    (1, 50.0, "Helvetica", 9.0, "Boletín Oficial, Lunes 5 de enero de 2024"),
    (1, 120.0, "Times-Bold", 13.0, "III. ANUNCIOS"),
    (1, 140.0, "Times-Bold", 11.0, "Org {name}"),
    (1, 160.0, "Times-BoldItalic", 11.0, "{n} Resolución de {name} con-"),
    (1, 175.0, "Times-Italic", 11.0, "tinuada."),
    (1, 300.0, "Times-Roman", 11.0, "Un texto de {name} par-"),
    (1, 314.0, "Times-Roman", 11.0, "tido en dos líneas."),
    (1, 328.0, "Times-Roman", 11.0, "Sigue aquí."),
    (1, 370.0, "Times-Roman", 11.0, "Otro párrafo que va"),
    (1, 400.0, "Helvetica", 4.0, "Página"),
    (1, 780.0, "Helvetica", 8.0, "boc-a-2024-{n}-7"),
    (2, 50.0, "Helvetica", 9.0, "Boletín Oficial, Martes 6 de enero de 2024"),
    (2, 200.0, "Times-Roman", 11.0, "más allá de la página."),
    (2, 700.0, "Times-Roman", 11.0, "Fin"),
)


@query(
    "txt_14_printed",
    "TXT-14",
    sql="""SELECT n_nationkey::VARCHAR AS document, '2024-01-05' AS date, 'BOC-A-2024-' || n_nationkey || '-7' AS identifier, 'III. ANUNCIOS' AS section, 'Org ' || n_name AS organization, n_nationkey::INT AS number,
  'Resolución de ' || n_name || ' continuada.' AS title, 'Un texto de ' || n_name || ' partido en dos líneas. Sigue aquí. | Otro párrafo que va más allá de la página. | Fin' AS paragraphs,
  2024 AS year, n_nationkey::INT AS issue, 'https://gazette.example.org/boc-a-2024-' || n_nationkey || '-7.pdf' AS pdf FROM nation""",
)
def printed(t: Tables) -> DataFrame:
    """Documents from positioned characters that stand up to two points off their line."""
    filled = t.nation.select("*", F.inline(_rows(PRINT, "page int, top double, font string, size double, template string"))).withColumn("text", F.replace(F.replace("template", F.lit("{name}"), F.col("n_name")), F.lit("{n}"), F.col("n_nationkey").cast("string")))
    chars = filled.select(F.col("n_nationkey").cast("string").alias("document"), "page", "top", "font", "size", F.posexplode(F.split("text", "")).alias("x", "char"))
    chars = chars.select("document", "page", "char", F.col("x").cast("double").alias("x0"), (F.col("top") + F.col("x") % 3).alias("top"), "size", "font", (F.col("top") * 1000 + F.col("x")).alias("nth"))
    return G.printed_documents(G.text_lines(chars), base=SITE).withColumn("paragraphs", F.array_join("paragraphs", " | "))


#: Lines of a bulletin in two columns: page, left edge, top, font of the leading number, font, size, text.
TWO_COLUMNS = (
    (1, 60.0, 50.0, "Helvetica", "Helvetica", 9.0, "Boletín Oficial de la Isla núm. {n}, martes 11 de abril de 2006, página 1"),
    (1, 50.0, 100.0, "Times-Roman", "Times-Roman", 10.0, "9 ORDEN de otra cosa. Página 3"),
    (1, 50.0, 130.0, "Times-Bold", "Times-Bold", 13.0, "III. OTRAS Resoluciones de la isla"),
    (1, 50.0, 150.0, "Times-Italic", "Times-Italic", 11.0, "Un apartado"),
    (1, 50.0, 170.0, "Times-Bold", "Times-Bold", 11.0, "Gerenciade"),
    (1, 50.0, 182.0, "Times-Bold", "Times-Bold", 11.0, "{name}"),
    (1, 50.0, 200.0, "Times-Bold", "Times-Italic", 11.0, "{n} ORDEN de {name}, por la"),
    (1, 50.0, 215.0, "Times-Italic", "Times-Italic", 11.0, "que se re-"),
    (1, 50.0, 230.0, "Times-Italic", "Times-Italic", 11.0, "suelve."),
    (1, 50.0, 300.0, "Times-Roman", "Times-Roman", 11.0, "Primer párrafo de {name}"),
    (1, 50.0, 314.0, "Times-Roman", "Times-Roman", 11.0, "sigueEn la línea."),
    (1, 50.0, 360.0, "Times-Roman", "Times-Roman", 11.0, "Segundo párrafo pasa de co-"),
    (1, 310.0, 100.0, "Times-Roman", "Times-Roman", 11.0, "lumna sin acabar"),
    (1, 310.0, 114.0, "Times-Italic", "Times-Italic", 11.0, "hasta aquí."),
    (1, 310.0, 160.0, "Times-Bold", "Times-Bold", 11.0, "Puerto de {name}"),
    (1, 310.0, 180.0, "Times-Bold", "Times-Italic", 11.0, "{n}1 ANUNCIO de {name}."),
    (1, 310.0, 240.0, "Times-Roman", "Times-Roman", 11.0, "Texto del anuncio."),
    (2, 60.0, 50.0, "Helvetica", "Helvetica", 9.0, "Boletín Oficial de la Isla núm. 99, lunes 1 de mayo de 2007, página 2"),
    (2, 50.0, 100.0, "Times-Roman", "Times-Roman", 11.0, "Nuevo párrafo en otra página:"),
    (2, 50.0, 120.0, "Times-Roman", "Times-Roman", 7.0, "letra pequeña"),
    (2, 310.0, 100.0, "Times-Roman", "Times-Roman", 11.0, "tras dos puntos."),
    (2, 310.0, 120.0, "Times-Bold", "Times-Bold", 13.0, "IV. Anuncios"),
    (2, 310.0, 140.0, "Times-Roman", "Times-Roman", 11.0, "Texto de nadie"),
    (2, 310.0, 160.0, "Times-Bold", "Times-Bold", 11.0, "{n}2 Edicto"),
    (2, 310.0, 200.0, "Times-Roman", "Times-Roman", 11.0, "Final."),
)


@query(
    "txt_14_two_columns",
    "TXT-14",
    sql="""SELECT s_suppkey::VARCHAR AS document, k::INT AS disposition, 2006 AS year, s_suppkey::INT AS issue, '2006-04-11' AS date,
  (s_suppkey || ['', '1', '2'][k])::INT AS number, CASE WHEN k < 3 THEN 'Otras Resoluciones de la Isla' ELSE 'Anuncios' END AS section,
  CASE k WHEN 1 THEN 'Gerencia de ' || s_name WHEN 2 THEN 'Puerto de ' || s_name END AS organization,
  ['ORDEN de ' || s_name || ', por la que se resuelve.', 'ANUNCIO de ' || s_name || '.', 'Edicto'][k] AS title,
  ['Primer párrafo de ' || s_name || ' sigue En la línea. | Segundo párrafo pasa de columna sin acabar hasta aquí.', 'Texto del anuncio. | Nuevo párrafo en otra página: | tras dos puntos.', 'Final.'][k] AS paragraphs,
  'https://gazette.example.org/2006/' || lpad(s_suppkey::VARCHAR, greatest(3, length(s_suppkey::VARCHAR))::INT, '0') || '/2006-' || lpad(s_suppkey::VARCHAR, greatest(3, length(s_suppkey::VARCHAR))::INT, '0') || '.pdf' AS pdf
FROM supplier, (SELECT unnest([1, 2, 3]) AS k)""",
)
def two_columns(t: Tables) -> DataFrame:
    """Three dispositions a bulletin, from characters that go on from column to column and page to page."""
    lines = _rows(TWO_COLUMNS, "page int, x double, top double, first string, font string, size double, template string")
    filled = t.supplier.select("s_suppkey", "s_name", F.inline(lines)).select("*", F.replace(F.replace("template", F.lit("{name}"), F.col("s_name")), F.lit("{n}"), F.col("s_suppkey").cast("string")).alias("text"))
    chars = filled.select(F.col("s_suppkey").cast("string").alias("document"), "page", "x", "top", "first", "font", "size", "text", F.posexplode(F.split("text", "")).alias("i", "char"))
    numbers = F.length(F.regexp_extract("text", r"^\d+", 0))
    placed = chars.select("document", "page", "char", (F.col("x") + F.col("i") * 5).alias("x0"), (F.col("top") + F.col("i") % 3 * 0.9).alias("top"), "size", F.when(F.col("i") < numbers, F.col("first")).otherwise(F.col("font")).alias("font"), F.col("i").alias("nth"))
    return G.column_dispositions(placed, base=SITE).withColumn("paragraphs", F.array_join("paragraphs", " | "))


@query(
    "sup_7_printed_summary",
    "SUP-7",
    sql="""SELECT l_orderkey::VARCHAR AS document, k::INT AS disposition, 'Disposiciones Generales' AS section, 'Gerencia Forestal de ' || l_orderkey AS subsection,
  CASE WHEN k > 1 THEN 'Org ' || l_orderkey END AS organization, 'Resolución número ' || l_partkey AS summary, CASE WHEN k <> 3 THEN k END::INT AS start_page
FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 4""",
)
def printed_summary(t: Tables) -> DataFrame:
    """Lines of printed summaries: headings, hyphenated texts, page references, a heading instead of one, a repeated section."""
    listed = t.lineitem.select(F.col("l_orderkey").cast("string").alias("document"), "l_linenumber", "l_partkey")  # keyed as the lines are: one shuffle, of items
    items = numbered(listed, ["document"], [F.asc("l_linenumber"), F.asc("l_partkey")], "k").filter("k <= 4")
    k, document = F.col("k"), F.col("document")
    line = lambda at, font, text: F.struct(at.alias("line"), F.lit(font).alias("font"), text.alias("text"))
    of_item = F.array(
        line(k * 10, "Times-Roman", F.lit("Resolución nú-")),
        line(k * 10 + 1, "Times-Roman", F.concat(F.lit("mero  "), F.col("l_partkey").cast("string"), F.when(k == 3, "").otherwise(F.concat(F.lit(" Página "), k.cast("string"))))),
        line(k * 10 + 2, "Times-Bold", F.concat(F.lit("Org "), document)),
    )
    ends = F.array(
        line(F.lit(-2), "Times-Bold", F.lit("I.Disposiciones generales")),
        line(F.lit(-1), "Times-Italic", F.concat(F.lit("Gerencia Forestalde "), document)),
        line(F.lit(1000), "Times-Bold", F.lit("II. Otras")),
        line(F.lit(1001), "Times-Roman", F.lit("never closed")),
        line(F.lit(1002), "Times-Bold", F.lit("I. Disposiciones generales y más")),
        line(F.lit(1003), "Times-Roman", F.lit("after the end Página 9")),
    )
    lines = items.select("document", F.inline(F.when(k == 1, F.concat(of_item, ends)).otherwise(of_item)))
    return G.printed_summary(lines)
