"""Official gazettes: issues and documents from their pages, lines and dispositions from positioned characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import elements as E
from millrace.functions.scalars import recased, respaced, section_title, spanish_date

# --- issue pages ----------------------------------------------------------------------------

#: Markers of the three layouts, and titles of their links: fixed values.
CURRENT_ITEM, EARLY_LIST, EARLY_ITEM, EARLY_TEXT, CONTENT = "justificado_boc", "summary", "justificado", "abstract", "conten"
SUBSECTION, WRAPPER, ITEM_DATA, ITEM_CODE = "titboc", "bloq_menu", "document_info", "cve"
PREVIEW, SIGNED, AS_PDF, ISSUE_AS_PDF = "Vista previa", "firma electrónica", "Descargar en formato PDF", "formato PDF"
TO_ITEM, TO_ITEM_PDF, TO_ISSUE_PDF = ("Ir a la disposición", "Ir al artículo"), ("Descarga la disposición", "Descarga el artículo"), "Descarga el Boletín"


def layout(e: Column) -> Column:
    """current, early, pdf_only or null, from the most specific to the least."""
    content = E.first(e, lambda x: E.is_a(x, "div", CONTENT))
    pdf = E.let(content, lambda box: F.exists(E.descendants(e, box), lambda x: (x["tag"] == "a") & F.coalesce(x["href"].endswith(".pdf"), F.lit(False))))
    return F.when(F.exists(e, lambda x: E.is_a(x, "li", CURRENT_ITEM)), "current").when(F.exists(e, lambda x: E.is_a(x, "ul", EARLY_LIST)), "early").when(pdf, "pdf_only")


def issue_number(e: Column) -> Column:
    """year and issue from the page's title ("... 2026/47"), else from its heading ("... Nº 168. ... de 2012")."""
    pairs = []
    for tag in ("title", "h2"):
        text = E.first(e, E.tagged(tag))["text"]
        got = lambda pattern, n=1, text=text: F.regexp_extract(text, pattern, n).try_cast("int")
        slashed = F.when(text.rlike(r"\d{4}/\d+"), F.struct(got(r"(\d{4})/(\d+)").alias("year"), got(r"(\d{4})/(\d+)", 2).alias("issue")))
        spelled = F.when(text.rlike(r"[Nn]º\s*\d+") & text.rlike(r"\b\d{4}\b"), F.struct(got(r"\b(\d{4})\b").alias("year"), got(r"[Nn]º\s*(\d+)").alias("issue")))
        pairs += [slashed, spelled]
    return F.coalesce(*pairs)


def item_number(url: Column) -> Column:
    """The number that a URL's last path segment is, before its extension."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "").try_cast("int")


def parsed_issues(pages: DataFrame, *, html: str = "html", base: str) -> DataFrame:
    """``pages`` without ``html``, with layout, year, issue, title, url, summary (url, signature) and dispositions.

    An unknown layout gives null throughout. Links are made absolute against ``base``. An item's headings are
    those before its list; they and its own elements are found by position, so that an issue of any length is
    read in proportion to it.
    """
    marks = (("h4", None), ("h3", SUBSECTION), ("h5", None))
    page = pages.withColumn("e", E.elements(F.col(html), base, marks)).withColumn("layout", layout(F.col("e"))).withColumn("n", issue_number(F.col("e")))
    page = page.withColumn("content", E.first(F.col("e"), lambda x: E.is_a(x, "div", CONTENT)))
    e, content, current = F.col("e"), F.col("content"), F.col("layout") == "current"
    in_content = lambda found: E.let(content, lambda box: found(E.descendants(e, box)))

    def items() -> Column:
        wrapper = in_content(lambda own: E.first(own, lambda x: E.is_a(x, "div") & (x["id"] == WRAPPER)))
        frame = F.when(current, F.coalesce(wrapper, content)).otherwise(content)
        wanted = lambda x: (x["tag"] == "li") & F.array_contains(x["classes"], F.when(current, CURRENT_ITEM).otherwise(EARLY_ITEM))
        lists = E.let(frame, lambda box: E.some(e, lambda x: (x["up"] == box["pos"]) & (x["tag"] == "ul") & (current | F.array_contains(x["classes"], EARLY_LIST))))
        return F.flatten(F.transform(lists, lambda ul: F.coalesce(F.transform(E.some(E.descendants(e, ul), wanted), lambda li: item(ul, li)), F.array())))

    def item(ul: Column, li: Column) -> Column:
        code = lambda own: E.first(own, lambda x: E.is_a(x, "div", ITEM_CODE))
        return E.let(E.descendants(e, li), lambda own: E.let(code(own), lambda code: E.let(E.some(own, lambda x: E.inside(x, code)), lambda of_code: disposition(ul, li, own, code, of_code))))

    def disposition(ul: Column, li: Column, own: Column, code: Column, of_code: Column) -> Column:
        pos = lambda x: F.coalesce(x["pos"], F.lit(-1))
        head = lambda n: E.at(e, F.get(ul["before"], F.lit(n)))
        section = head(0)
        sub = F.when(current & (head(1)["pos"] > pos(section)), head(1))
        organization = F.when(head(2)["pos"] > F.greatest(pos(section), pos(sub)), head(2))
        links = E.some(own, lambda x: (x["tag"] == "a") & (x["up"] == li["pos"]))
        words = F.when(current, F.get(links, F.lit(1))["text"]).otherwise(E.first(own, lambda x: E.is_a(x, "a", EARLY_TEXT))["text"])
        summary = F.trim(F.concat_ws(" ", F.coalesce(E.first(own, lambda x: x["tag"] == "b")["text"], F.lit("")), F.coalesce(words, F.lit(""))))
        code_in = lambda data: F.coalesce(E.first(own, lambda x: E.is_a(x, "div", ITEM_CODE) & E.inside(x, data))["text"], F.lit(""))
        about = E.let(E.first(own, lambda x: E.is_a(x, "div", ITEM_DATA)), lambda data: F.trim(F.regexp_replace(F.replace(data["text"], code_in(data), F.lit("")), r"\s+", " ")))
        coded = current & code.isNotNull()
        link = lambda within, *titles: E.absolute(E.first(within, lambda x: E.titled(x, *titles))["href"], base)
        html_url = F.when(coded, link(of_code, PREVIEW)).otherwise(link(own, *TO_ITEM))
        return F.struct(
            item_number(html_url).alias("disposition"),
            section_title(section["text"]).alias("section"),
            sub["text"].alias("subsection"),
            organization["text"].alias("organization"),
            F.nullif(summary, F.lit("")).alias("summary"),
            F.when(current, F.nullif(about, F.lit(""))).alias("metadata"),
            F.when(coded, code["own"]).alias("identifier"),
            F.when(coded, link(of_code, AS_PDF)).otherwise(link(own, *TO_ITEM_PDF)).alias("pdf"),
            html_url.alias("html"),
            F.when(coded, link(of_code, SIGNED)).alias("signature"),
        )

    page = page.withColumn("note", in_content(lambda own: E.first(own, lambda x: E.is_a(x, "p", EARLY_ITEM))))
    of_note = lambda found: E.let(E.descendants(e, F.col("note")), found)
    mark = lambda own: E.first(own, lambda x: E.is_a(x, "span", ITEM_CODE))
    href = lambda x: E.absolute(x["href"], base)
    summary_url = (
        F.when(current, href(of_note(lambda own: E.first(own, lambda x: E.titled(x, ISSUE_AS_PDF)))))
        .when(F.col("layout") == "early", href(E.first(e, lambda x: E.titled(x, TO_ISSUE_PDF))))
        .when(F.col("layout") == "pdf_only", href(E.first(e, lambda x: (x["tag"] == "a") & F.coalesce(x["href"].endswith(".pdf"), F.lit(False)))))
    )
    signature = F.when(current, href(of_note(lambda own: E.let(mark(own), lambda box: E.first(own, lambda x: E.inside(x, box) & E.titled(x, SIGNED))))))
    url = F.concat(F.lit(f"{base.rstrip('/')}/"), F.col("n.year").cast("string"), F.lit("/"), F.lpad(F.col("n.issue").cast("string"), 3, "0"), F.lit("/"))
    known = F.col("layout").isNotNull()
    return page.select(
        *(c for c in pages.columns if c != html),
        "layout",
        F.when(known, F.col("n.year")).alias("year"),
        F.when(known, F.col("n.issue")).alias("issue"),
        F.when(known, F.coalesce(E.first(e, lambda x: x["tag"] == "h2")["text"], F.lit(""))).alias("title"),
        F.when(known, url).alias("url"),
        F.when(known, F.struct(summary_url.alias("url"), signature.alias("signature"))).alias("summary"),
        F.when(F.col("layout").isin("current", "early"), items()).when(known, F.array()).alias("dispositions"),
    )


# --- document pages ------------------------------------------------------------------------------


def parsed_documents(pages: DataFrame, *, html: str = "html", base: str) -> DataFrame:
    """``pages`` without ``html``, with the document's fields, its body as Markdown, and both as one text with front matter."""
    page = pages.withColumn("e", E.elements(F.col(html), base))
    e = F.col("e")
    content = F.coalesce(E.first(e, lambda x: E.is_a(x, "div", CONTENT)), E.first(e, lambda x: E.is_a(x, "div", "bloq_contenido")))
    page = page.withColumn("content", content).withColumn("h3", E.first(e, lambda x: E.inside(x, F.col("content")) & (x["tag"] == "h3")))
    box, h3 = F.col("content"), F.col("h3")
    title = E.first(e, lambda x: x["tag"] == "title")["text"]
    number_in = lambda n: F.regexp_extract(title, r"(\d{4})/(\d+)", n).try_cast("int")
    meta = lambda name: E.first(e, lambda x: (x["tag"] == "meta") & (x["name"] == name))["content"]
    in_box = E.some(e, lambda x: E.inside(x, box))
    h5, h4 = (E.first(in_box, E.tagged(tag)) for tag in ("h5", "h4"))
    parts = F.transform(F.split(h5["text"], " - "), lambda p: F.trim(p))
    many, two = F.size(parts) >= 3, F.size(parts) == 2
    one, from_h4 = F.get(parts, F.lit(0)), h4["text"]
    section = F.when(many | two, one).otherwise(F.coalesce(F.when(h5.isNotNull(), from_h4), one))
    organization = F.when(many, F.try_element_at(parts, F.lit(-1))).when(two, F.get(parts, F.lit(1))).when(h5.isNotNull() & from_h4.isNotNull(), one)
    bold = E.first(e, lambda x: E.inside(x, h3) & (x["tag"] == "b"))["text"]
    lead, plain = h3["lead"], r"(?s)^(\d+)\s*[-–]\s*(.+)$"
    after = F.trim(F.when(lead.startswith(bold), F.substring(lead, F.length(bold) + 1, F.length(lead))).otherwise(lead))
    number = F.coalesce(bold, F.nullif(F.regexp_extract(lead, plain, 1), F.lit("")))
    heading = F.when(bold.isNotNull(), after).when(lead.rlike(plain), F.trim(F.regexp_extract(lead, plain, 2))).otherwise(lead)

    beside = E.some(e, lambda x: (x["up"] == h3["up"]) & (x["pos"] > h3["last"]) & (x["tag"] == "p"))
    holds = lambda p, tag, cls: F.exists(e, lambda x: E.inside(x, p) & E.is_a(x, tag, cls))
    next_p = F.get(beside, F.lit(0))
    code = F.coalesce(E.first(e, lambda x: E.inside(x, h3) & E.is_a(x, "span", ITEM_CODE)), E.first(e, lambda x: E.inside(x, next_p) & E.is_a(x, "span", ITEM_CODE)))
    link = lambda outer, condition: E.absolute(E.first(e, lambda x: E.inside(x, outer) & condition(x))["href"], base)
    old_p = E.first(beside, lambda x: F.array_contains(x["classes"], EARLY_ITEM))
    old_pdf = F.when(holds(old_p, "img", "icon_pdf"), link(old_p, lambda x: x["tag"] == "a"))
    paragraphs = F.transform(E.some(beside, lambda p: ~holds(p, "img", "icon_pdf") & ~holds(p, "span", ITEM_CODE)), lambda p: p["markdown"])
    fields = page.select(
        *(c for c in pages.columns if c != html),
        number_in(1).alias("year"),
        number_in(2).alias("issue"),
        meta("documentnumber").alias("document"),
        number.alias("number"),
        meta("documentdate").alias("date"),
        meta("entity").alias("entity"),
        section.alias("section"),
        F.when(many, F.get(parts, F.lit(1))).alias("subsection"),
        organization.alias("organization"),
        F.when(code.isNotNull(), F.regexp_replace(code["own"], r"\.+$", "")).alias("identifier"),
        F.when(code.isNotNull(), link(code, lambda x: E.titled(x, "PDF"))).otherwise(old_pdf).alias("pdf"),
        F.when(code.isNotNull(), link(code, lambda x: E.titled(x, SIGNED))).alias("signature"),
        heading.alias("title"),
        F.coalesce(F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n"), F.lit("")).alias("body"),
    )
    return fields.withColumn("markdown", with_front_matter())


#: The front matter's fields in order: fixed values of the format.
FRONT_MATTER = ("year", "issue", "document", "number", "date", "entity", "section", "subsection", "organization", "identifier", "pdf", "signature")


def with_front_matter() -> Column:
    """The columns of ``parsed_documents`` as one Markdown text; absent fields leave no line."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    def value(name: str) -> Column:
        c = F.col(name).cast("string")
        if name in ("year", "issue"):
            return c
        return F.when(c.rlike(r"^\d+$"), c.cast("decimal(38,0)").cast("string")).otherwise(quoted(c)) if name == "number" else quoted(c)

    lines = [F.concat(F.lit(f"{name}: "), value(name)) for name in FRONT_MATTER]
    heading = F.when(F.col("title") != "", F.concat(F.lit("# "), F.col("title"), F.lit("\n")))
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), heading, F.nullif("body", F.lit("")))


# --- positioned characters --------------------------------------------------------------------------

#: Points between characters of a line, page bands and sizes: fixed values of the print.
LINE_TOLERANCE, HEADER_BAND, FOOTER_BAND, MARKER_SIZE, SECTION_SIZE = 3.0, 110.0, 770.0, 6, 12.5
DEFAULT_GAP, WIDE_GAP, LARGEST_GAP = 14.0, 1.6, 40
NUMBERED = r"^(\d+)\s+(.*)$"
PRINTED_DATE = r"(?:Lunes|Martes|Miércoles|Jueves|Viernes|Sábado|Domingo)\s+(\d{1,2}\s+de\s+\p{L}+\s+de\s+\d{4})"
PRINTED_ID = r"(?i)boc-a-(\d{4})-(\d+)-(\d+)"


def rejoined(text: Column) -> Column:
    """Single blanks, and words hyphenated at a line's end whole again."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"(?U)(\w)- (\w)", "$1$2"))


def text_lines(chars: DataFrame) -> DataFrame:
    """document, page, line, text, font, size, top of prints in one column, from characters (document, page, char, x0, top, size, font, nth)."""
    return column_lines(chars, None).select("document", "page", "line", "text", "font", "size", "top")


def printed_documents(lines: DataFrame, *, base: str) -> DataFrame:
    """A row a document from ``text_lines``: date, identifier, section, organization, number, title, year, issue, pdf, paragraphs.

    The date is the first header's whose month is known, the year the first dated header's or the
    identifier's; the issue, and the number where the title has none, are the identifier's.
    """
    here = Window.partitionBy("document").orderBy("page", "line")
    every = Window.partitionBy("document")
    bold, italic, text = F.col("font").contains("Bold"), F.col("font").contains("Italic"), F.col("text")
    numbered, clean = text.rlike(NUMBERED), F.trim(F.regexp_replace("text", r"\s+", " "))
    placed = lines.filter(F.col("size") >= MARKER_SIZE).withColumn("at", F.row_number().over(here)).withColumn("band", F.when(F.col("top") < HEADER_BAND, "header").when(F.col("top") > FOOTER_BAND, "footer").otherwise("body"))
    body = F.col("band") == "body"
    first_at = lambda condition: F.min(F.when(body & condition, F.col("at"))).over(every)
    found = placed.withColumn("section_at", first_at(bold & (F.col("size") >= SECTION_SIZE)))
    found = found.withColumn("organization_at", first_at(bold & ~numbered & ~F.col("at").eqNullSafe(F.col("section_at"))))
    taken = F.col("at").eqNullSafe(F.col("section_at")) | F.col("at").eqNullSafe(F.col("organization_at"))
    found = found.withColumn("title_at", first_at(~taken & (((bold | italic) & numbered) | italic)))
    is_title = F.col("at").eqNullSafe(F.col("title_at"))
    found = found.withColumn("body_at", first_at(~taken & ~is_title & (~italic | F.col("title_at").isNull() | (F.col("at") < F.col("title_at")))))
    more = italic & (F.col("at") > F.col("title_at")) & (F.col("at") < F.coalesce("body_at", F.lit(2**31 - 1)))
    role = F.when(~body, F.col("band")).when(F.col("at").eqNullSafe(F.col("section_at")), "section").when(F.col("at").eqNullSafe(F.col("organization_at")), "organization").when(is_title, "title").when(~taken & more, "more").otherwise("text")
    roles = found.select("document", "page", "line", "top", "at", "text", clean.alias("clean"), role.alias("role"))

    in_body = roles.filter("role = 'text'")
    gap = F.round(F.col("top") - F.lag("top").over(Window.partitionBy("document", "page").orderBy("line")), 1)
    typical = F.percentile(F.when((F.col("gap") > 0) & (F.col("gap") < LARGEST_GAP), F.col("gap")), 0.5).over(Window.partitionBy("document", "page"))
    spaced = in_body.withColumn("gap", gap).withColumn("typical", F.coalesce(typical, F.lit(DEFAULT_GAP)))
    before, turned = F.lag("text").over(here), F.lag("page").over(here) != F.col("page")
    ended = F.coalesce(F.rtrim(before), F.lit("")).rlike(r"[.:;!?]$") | (F.coalesce(F.rtrim(before), F.lit("")) == "")
    opens = F.when(turned, ended).otherwise(F.coalesce(F.col("gap") > F.col("typical") * WIDE_GAP, F.lit(False)))
    grouped = spaced.withColumn("opens", opens).withColumn("paragraph", F.sum(F.col("opens").cast("int")).over(here))
    joined = grouped.groupBy("document", "paragraph").agg(F.array_sort(F.collect_list(F.struct("at", F.trim("text").alias("text")))).alias("parts"))
    paragraphs = joined.select("document", F.struct("paragraph", rejoined(F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("text")).alias("p"))
    paragraphs = paragraphs.groupBy("document").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]).alias("paragraphs"))

    said = lambda name, value: F.min_by(value, F.when(F.col("role") == name, F.col("at")))
    date = F.regexp_extract("text", PRINTED_DATE, 1)
    number, heading = F.regexp_extract("clean", NUMBERED, 1).try_cast("int"), F.when(F.col("clean").rlike(NUMBERED), F.regexp_extract("clean", NUMBERED, 2)).otherwise(F.col("clean"))
    continued = F.array_sort(F.collect_list(F.when(F.col("role").isin("title", "more"), F.struct("at", F.when(F.col("role") == "title", heading).otherwise(F.col("clean")).alias("t")))))
    headers = roles.groupBy("document").agg(
        F.min_by(spanish_date(date), F.when((F.col("role") == "header") & spanish_date(date).isNotNull(), F.col("at"))).alias("date"),
        F.min_by(F.regexp_extract(date, r"(\d{4})$", 1).try_cast("int"), F.when((F.col("role") == "header") & (date != ""), F.col("at"))).alias("header_year"),
        F.min_by(F.upper(F.regexp_extract("text", PRINTED_ID, 0)), F.when((F.col("role") == "footer") & F.col("text").rlike(PRINTED_ID), F.col("at"))).alias("identifier"),
        said("section", F.col("clean")).alias("section"),
        said("organization", F.col("clean")).alias("organization"),
        said("title", number).alias("number"),
        F.nullif(F.regexp_replace(F.array_join(F.transform(continued, lambda x: x["t"]), " "), r"(?U)(\w)- (\w)", "$1$2"), F.lit("")).alias("title"),
    )
    part = lambda n: F.regexp_extract("identifier", PRINTED_ID, n).try_cast("int")
    linked = headers.withColumns({"year": F.coalesce("header_year", part(1)), "issue": part(2), "number": F.coalesce("number", part(3)), "pdf": F.concat(F.lit(f"{base}/"), F.lower("identifier"), F.lit(".pdf"))}).drop("header_year")
    return linked.join(paragraphs, "document", "left").withColumn("paragraphs", F.coalesce("paragraphs", F.array().cast("array<string>")))


#: Two columns: where the right one begins, page bands and sizes, what marks a summary's line and a page's head: fixed values.
RIGHT_COLUMN, COLUMN_HEADER_BAND, COLUMN_TEXT_SIZE = 290.0, 80.0, 8.0
SUMMARY_LINE, PAGE_HEAD, ROMAN_SECTION = r"Página\s*\d+", r"Boletín Oficial", r"^[IVXLC]+\.\s"
BULLETIN_HEAD, HEAD_PAGES = r"Boletín Oficial.*?núm\.\s*(\d+),\s*(.+?)\s+de\s+(\d{4})", 5


def column_lines(chars: DataFrame, split: float | None = RIGHT_COLUMN) -> DataFrame:
    """document, page, side, line, top, text, font, first_font, size from characters; ``split`` is where the right side begins.

    From the top of a side down, a new line begins where the next character is further down than the
    tolerance. A line reads from left to right; its font is the most frequent one of its visible
    characters (of equally frequent ones the leftmost), its size their upper median.
    """
    side = F.lit(0) if split is None else (F.col("x0") >= split).cast("int")
    block = Window.partitionBy("document", "page", "side").orderBy("level", "x0", "nth")
    placed = chars.withColumns({"side": side, "level": F.round("top", 1)})
    step = F.col("level") - F.lag("level").over(block)
    numbered = placed.withColumn("opens", F.when(step > LINE_TOLERANCE, 1).otherwise(0)).withColumn("line", F.sum("opens").over(block))
    seen = F.trim("char") != ""
    of_font = numbered.groupBy("document", "page", "side", "line", "font").agg(
        F.collect_list(F.struct("x0", "nth", "char")).alias("chars"),
        F.count(F.when(seen, 1)).alias("n"),
        F.min(F.when(seen, F.struct("x0", "nth"))).alias("at"),
        F.collect_list(F.when(seen, F.col("size"))).alias("sizes"),
        F.min("level").alias("top"),
    )
    found = of_font.groupBy("document", "page", "side", "line").agg(
        F.array_sort(F.flatten(F.collect_list("chars"))).alias("chars"),
        F.max_by("font", F.when(F.col("n") > 0, F.struct("n", (-F.col("at.x0")).alias("left"), (-F.col("at.nth")).alias("early")))).alias("font"),
        F.min_by("font", "at").alias("first_font"),
        F.array_sort(F.flatten(F.collect_list("sizes"))).alias("sizes"),
        F.min("top").alias("top"),
    )
    text = F.trim(F.array_join(F.transform("chars", lambda c: c["char"]), ""))
    size = F.get(F.col("sizes"), F.floor(F.size("sizes") / 2).cast("int"))
    return found.filter(F.size("sizes") > 0).select("document", "page", "side", "line", "top", text.alias("text"), "font", "first_font", size.alias("size"))


def column_dispositions(chars: DataFrame, *, base: str) -> DataFrame:
    """Dispositions of bulletins printed in two columns: document, disposition, year, issue, date, number, section, organization, title, paragraphs, pdf.

    The left side of a page is read before the right one. What stands above a side's last summary
    reference, in the page's head or in small print is left out, and all that comes before the first
    section heading. A disposition begins at a bold number with its title, goes on from side to side and page
    to page, and ends at the next number, section or bold line; bold lines since the last number or section
    name the organization, which holds until another one or a section. Italic lines at once after the number
    continue the title, the rest is text: paragraphs part at wide gaps, and at a side's end if the text has ended.
    """
    heads = column_lines(chars.filter((F.col("page") <= HEAD_PAGES) & (F.col("top") < COLUMN_HEADER_BAND)), None).filter(F.col("text").rlike(BULLETIN_HEAD))
    said = lambda n: F.regexp_extract("text", BULLETIN_HEAD, n)
    head = F.min_by(F.struct(said(3).cast("int").alias("year"), said(1).cast("int").alias("issue"), spanish_date(F.concat_ws(" de ", said(2), said(3))).alias("date")), F.struct("page", "line"))
    bulletins = heads.groupBy("document").agg(head.alias("h")).select("document", "h.*")

    side, here = Window.partitionBy("document", "page", "side"), Window.partitionBy("document").orderBy("page", "side", "line")
    so_far, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    lines = column_lines(chars).withColumn("text", recased(F.col("text")))
    lines = lines.withColumn("listed", F.max(F.when(F.col("text").rlike(SUMMARY_LINE), F.col("line"))).over(side))
    read = (F.col("top") >= COLUMN_HEADER_BAND) & (F.col("size") >= COLUMN_TEXT_SIZE) & ~F.col("text").rlike(PAGE_HEAD) & (F.col("listed").isNull() | (F.col("line") > F.col("listed")))
    bold, italic = F.col("font").contains("Bold"), F.col("font").contains("Italic")
    section = bold & (F.col("size") >= SECTION_SIZE) & F.col("text").rlike(ROMAN_SECTION)
    title = F.col("first_font").contains("Bold") & F.col("text").rlike(r"^\d+") & (italic | bold)
    kind = F.when(section, "section").when(title, "title").when(bold, "organization").when(italic, "italic").otherwise("plain")
    marked = lines.filter(read).withColumn("kind", kind)
    count = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("int"))
    marked = marked.withColumns({"section_no": count("section").over(so_far), "item": count("title").over(so_far), "heads": F.coalesce(count("section", "title").over(before), F.lit(0))}).filter("section_no > 0")

    of_section = Window.partitionBy("document", "section_no").orderBy("item")
    organizations = marked.filter("kind = 'organization'").groupBy("document", "heads").agg(F.array_sort(F.collect_list(F.struct("page", "side", "line", "text"))).alias("parts"))
    organizations = organizations.select("document", "heads", respaced(F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("named"))
    sections = marked.filter("kind = 'section'").select("document", "section_no", section_title(F.col("text")).alias("section"))
    titles = marked.filter("kind = 'title'").join(organizations, ["document", "heads"], "left").join(sections, ["document", "section_no"])
    titles = titles.select("document", "item", "section", F.last("named", ignorenulls=True).over(of_section).alias("organization"), F.regexp_extract("text", r"^(\d+)", 1).try_cast("int").alias("number"))

    item = Window.partitionBy("document", "item").orderBy("page", "side", "line")
    within = item.rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.filter("item > 0").withColumns({"ended": F.sum(F.col("kind").isin("section", "organization").cast("int")).over(within), "texts": F.sum((F.col("kind") == "plain").cast("int")).over(within)}).filter("ended = 0")
    own = inside.withColumn("is_title", (F.col("kind") == "title") | ((F.col("kind") == "italic") & (F.col("texts") == 0)))
    words = F.when(F.col("kind") == "title", F.regexp_replace("text", r"^\d+\s*", "")).otherwise(F.col("text"))
    named = own.filter("is_title").groupBy("document", "item").agg(F.array_sort(F.collect_list(F.struct("page", "side", "line", words.alias("t")))).alias("parts"))
    named = named.select("document", "item", rejoined(F.array_join(F.filter(F.transform("parts", lambda p: p["t"]), lambda t: t != ""), " ")).alias("title"))

    body = own.filter(~F.col("is_title"))
    block = Window.partitionBy("document", "item", "page", "side")
    body = body.withColumn("gap", F.round(F.col("top") - F.lag("top").over(block.orderBy("line")), 1))
    typical = F.percentile(F.when((F.col("gap") > 0) & (F.col("gap") < LARGEST_GAP), F.col("gap")), 0.5).over(block)
    ended = F.lag("text").over(item).rlike(r"[.:;!?]$")
    opens = F.coalesce(F.when(F.col("gap").isNull(), ended).otherwise(F.col("gap") > F.coalesce(typical, F.lit(DEFAULT_GAP)) * WIDE_GAP), F.lit(False))
    parted = body.withColumn("opens", opens.cast("int")).withColumn("paragraph", F.sum("opens").over(item))
    joined = parted.groupBy("document", "item", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page", "side", "line", "text"))).alias("parts"))
    texts = joined.select("document", "item", F.struct("paragraph", rejoined(F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("text")).alias("p"))
    texts = texts.groupBy("document", "item").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]).alias("paragraphs"))

    done = titles.join(named, ["document", "item"], "left").join(texts, ["document", "item"], "left").join(bulletins, "document", "left")
    issue = F.col("issue").cast("string")
    number = F.lpad(issue, F.greatest(F.lit(3), F.length(issue)), "0")
    pdf = F.concat(F.lit(f"{base}/"), F.col("year").cast("string"), F.lit("/"), number, F.lit("/"), F.col("year").cast("string"), F.lit("-"), number, F.lit(".pdf"))
    return done.select("document", F.col("item").cast("int").alias("disposition"), "year", "issue", "date", "number", "section", "organization", "title", F.coalesce("paragraphs", F.array().cast("array<string>")).alias("paragraphs"), pdf.alias("pdf"))


#: What lines of a printed summary mean: fixed values.
PAGE_REFERENCE, ROMAN_HEAD = r"Página\s*(\d+)\s*$", r"^[IVXLC]+\.\s*"


def printed_summary(lines: DataFrame) -> DataFrame:
    """Dispositions of printed summaries: document, disposition, section, subsection, organization, summary, start_page.

    ``lines`` (document, line, text, font) are read in order. A line that ends in a page reference is one,
    whatever its font; else a bold line with a Roman number is a section, an italic one without a subsection, any
    other bold one an organization, and upright ones are text. Text gathers until a page reference, or a
    heading, closes the disposition; what no line closes is left out. A section heading that repeats an
    earlier one (either is the other's beginning) ends the summary.
    """
    here = Window.partitionBy("document").orderBy("line")
    so_far, earlier = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    font, text, clean = F.col("font"), F.col("text"), F.trim(F.regexp_replace("text", r"\s+", " "))
    bold, head = font.contains("Bold"), text.rlike(ROMAN_HEAD)
    kind = (
        F.when(text.rlike(PAGE_REFERENCE), "page").when(bold & head, "section").when(font.contains("Italic") & ~head, "subsection").when(bold, "organization").when(font.contains("Roman") | font.contains("Helvetica"), "text")
    )
    named = lines.withColumn("kind", kind).withColumn("heading", F.when(F.col("kind") == "section", F.trim(F.regexp_replace(respaced(text), r"\s+", " "))).when(F.col("kind").isin("subsection", "organization"), respaced(clean)))
    known = F.collect_list(F.when(F.col("kind") == "section", F.col("heading"))).over(earlier)
    closes = F.col("kind").isin("page", "section", "subsection", "organization")
    # All that is carried goes along one order of the lines, so that they are sorted once; a section forgets the headings below it.
    last_of = lambda *kinds: F.last(F.when((F.col("kind") == "section") | (F.col("kind").isin(*kinds) & F.col("heading").isNotNull()), F.struct("kind", "heading")), ignorenulls=True).over(so_far)
    below = lambda name: F.when(F.col(f"{name}.kind") == name, F.col(f"{name}.heading"))
    read = named.withColumns({"known": known, "group": F.coalesce(F.sum(closes.cast("int")).over(earlier), F.lit(0)), "section": F.last(F.when(F.col("kind") == "section", F.col("heading")), ignorenulls=True).over(so_far), "subsection": last_of("subsection"), "organization": last_of("organization")})
    again = (F.col("kind") == "section") & F.exists("known", lambda s: s.startswith(F.col("heading")) | F.col("heading").startswith(s))
    read = read.withColumn("over", F.max(again.cast("int")).over(so_far)).filter("over = 0")

    said = F.when(F.col("kind") == "text", text).when(F.col("kind") == "page", F.nullif(F.trim(F.regexp_replace(text, PAGE_REFERENCE, "")), F.lit("")))
    page_no = F.when(F.col("kind") == "page", F.regexp_extract(text, PAGE_REFERENCE, 1).try_cast("int"))  # a cast that fails costs an exception
    spoken = F.col("said").isNotNull()
    read = read.select("document", "line", "group", "kind", said.alias("said"), page_no.alias("page_no"), "section", below("subsection").alias("subsection"), below("organization").alias("organization"))
    items = read.groupBy("document", "group").agg(
        F.array_sort(F.collect_list(F.when(spoken, F.struct("line", "said", "section", "subsection", "organization")))).alias("parts"),
        F.bool_or(closes).alias("closed"),
        F.max("page_no").alias("start_page"),
    )
    items = items.withColumn("end", F.try_element_at("parts", F.lit(-1))).select("document", "group", "closed", "start_page", "parts", "end.section", "end.subsection", "end.organization")
    summary = F.nullif(rejoined(F.array_join(F.transform("parts", lambda p: p["said"]), " ")), F.lit(""))
    done = items.filter(F.coalesce("closed", F.lit(False)) & (F.size("parts") > 0))
    nth = F.row_number().over(Window.partitionBy("document").orderBy("group"))
    return done.select("document", nth.alias("disposition"), section_title(F.col("section")).alias("section"), "subsection", "organization", summary.alias("summary"), "start_page")
