"""Search, HTML and document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import markup
from millrace.functions.scalars import trailing_number
from millrace.operators.postings import IndexedSearch, TrigramIndex, WordIndex
from millrace.operators.relational import keep_first, small_side
from millrace.operators.search import BooleanQuery, Search, facet_counts, headline
from millrace.registry import Tables, query
from millrace.session import shared_folder

GAZETTE = Search(keys=("doc_id",), text=("text", "source"), facets={"section": ("lang", 10), "organisation": ("source", 15)}, unique=True)
HAS = "len(list_filter(regexp_extract_all(lower({c}), '([\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}-]*)', 1), lambda w: starts_with(w, '{t}'))) > 0"


def _has(term: str, column: str = "coalesce(text, '')") -> str:
    return HAS.format(c=column, t=term)


PREFIXES = f"({_has('than')} AND {_has('ere')}) OR ({_has('than', 'source')} AND {_has('ere', 'source')})"
MIXED = f"(({_has('than')} OR ({_has('of')} AND {_has('ther')})) AND NOT {_has('thi')}) OR (({_has('than', 'source')} OR ({_has('of', 'source')} AND {_has('ther', 'source')})) AND NOT {_has('thi', 'source')})"


@query(
    "txt_1_prefix_search",
    "TXT-1",
    "TXT-3",
    "TXT-4",
    sql=f"SELECT doc_id FROM documents WHERE {PREFIXES}",
)
def prefix_search(t: Tables) -> DataFrame:
    return GAZETTE.matching(t.documents, BooleanQuery.of_words("than, ere!")).select("doc_id")


@query(
    "txt_2_boolean_search",
    "TXT-2",
    sql=f"SELECT doc_id FROM documents WHERE {MIXED}",
)
def boolean_search(t: Tables) -> DataFrame:
    return GAZETTE.matching(t.documents, BooleanQuery(groups=(("than", "of ther"),), exclude=("thi",))).select("doc_id")


def word_index(t: Tables, *, stemmed: bool = False) -> WordIndex:
    """Postings of the documents' text and source, written once to the shared folder."""
    return WordIndex(t.spark, shared_folder(t.spark, "words"), "doc_id", ("text", "source"), stemmed).build(t.documents)


def indexed_gazette(t: Tables, *, stemmed: bool = False) -> IndexedSearch:
    return IndexedSearch(GAZETTE.keys, GAZETTE.text, GAZETTE.facets, GAZETTE.unique, word_index(t, stemmed=stemmed))


@query("txt_1_indexed_search", "TXT-1", "TXT-4", sql=f"SELECT doc_id FROM documents WHERE {PREFIXES}")
def indexed_search(t: Tables) -> DataFrame:
    """The prefix search, answered by postings: only the terms' pages are read."""
    return indexed_gazette(t).matching(t.documents, BooleanQuery.of_words("than, ere!")).select("doc_id")


@query("txt_2_indexed_boolean", "TXT-2", sql=f"SELECT doc_id FROM documents WHERE {MIXED}")
def indexed_boolean(t: Tables) -> DataFrame:
    """Lists intersected, united and taken away by key."""
    return indexed_gazette(t).matching(t.documents, BooleanQuery(groups=(("than", "of ther"),), exclude=("thi",))).select("doc_id")


@query(
    "txt_1_indexed_phrase",
    "TXT-1",
    sql=r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([\p{L}\p{N}][\p{L}\p{N}-]*)', 1) AS ws FROM documents),
p AS (SELECT doc_id, list_filter(range(0, len(ws)), lambda i: ws[i + 1] = 'of' AND ws[i + 2] = 'the') AS starts FROM w)
SELECT doc_id, list_min(starts)::INT AS place FROM p WHERE len(starts) > 0""",
)
def indexed_phrase(t: Tables) -> DataFrame:
    """Words side by side, by their positions; the first place in each text."""
    return word_index(t).phrase("of the").filter("field = 'text'").select(F.col("key").alias("doc_id"), F.col("first").alias("place"))


#: The words of the given documents whose stems begin with those of "aradas" and "coesos": fixed values.
STEMMED = """arado aradoado aradoar aradoas aradobo aradoci aradociñ aradoción aradoco aradodo aradoes aradoez aradoga aradoie aradoja aradoll aradomente
aradomi aradoos aradoque aradora aradorr aradota aradoue aradoñ aradoó coes coesado coesar coesas coesbo coesci coesción coesco coesdo coeses
coesesostaco coesez coesga coesie coesja coesll coesmente coesmi coesos coesosdomente coesque coesquegaí coesra coesrr coesta coesí
coesíadoque coesñ coesó""".split()


@query(
    "txt_3_stemmed_search",
    "TXT-3",
    sql=f"""WITH stemmed(word) AS (VALUES {', '.join(f"('{w}')" for w in STEMMED)}),
found AS (SELECT doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', text, source)), '([\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}-]*)', 1)) AS word FROM documents)
SELECT DISTINCT doc_id FROM found JOIN stemmed USING (word)""",
)
def stemmed_search(t: Tables) -> DataFrame:
    """Words and queries are compared by their Spanish stems, by prefix."""
    return indexed_gazette(t, stemmed=True).matching(t.documents, BooleanQuery(groups=(("aradas", "coesos"),))).select("doc_id")


@query(
    "txt_5_headline",
    "TXT-5",
    sql=r"""WITH w AS (SELECT doc_id, string_split_regex(trim(text), '\s+') AS parts FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, parts, list_position(list_transform(parts, lambda x: regexp_matches(x, '(?i)^\W*(?:than)')), true) AS hit FROM w)
SELECT doc_id, array_to_string(list_transform(list_slice(parts, greatest(hit - 20, 1), greatest(hit - 20, 1) + 59),
  lambda x: CASE WHEN regexp_matches(x, '(?i)^\W*(?:than)') THEN regexp_replace(x, '([\p{L}\p{N}-]+)', '<mark>\1</mark>', 'g') ELSE x END), ' ') AS excerpt FROM h WHERE hit > 0""",
)
def headlines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", headline(F.col("text"), ["than"]).alias("excerpt")).filter("excerpt is not null")


@query("txt_6_search_page", "TXT-6", "TOP-6", sql=f"SELECT doc_id, lang FROM documents WHERE {_has('than')} AND lang IN ('en', 'de') AND doc_id < 150 ORDER BY doc_id DESC LIMIT 21")
def search_page(t: Tables) -> DataFrame:
    return GAZETTE.page(t.documents, BooleanQuery.of_words("than"), F.col("lang").isin("en", "de"), size=20, after=(150,)).select("doc_id", "lang")


FACETS = f"""WITH f AS (SELECT * FROM documents WHERE {_has('than')})
SELECT * FROM (SELECT 'section' AS facet, lang AS name, count(*)::BIGINT AS n FROM f GROUP BY 2 ORDER BY n DESC, name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'organisation', source, count(*)::BIGINT AS n FROM f GROUP BY 2 ORDER BY n DESC, source LIMIT 15)
UNION ALL SELECT 'total', NULL, count(*)::BIGINT FROM f"""
PAGE = f"SELECT doc_id, lang FROM documents WHERE {_has('than')} AND lang IN ('en', 'de') AND doc_id < 150 ORDER BY doc_id DESC LIMIT 21"


@query("txt_6_search_facets", "TXT-6", "AGG-28", sql=FACETS)
def search_facets(t: Tables) -> DataFrame:
    return GAZETTE.counts(t.documents, BooleanQuery.of_words("than"))


@query("txt_6_indexed_facets", "TXT-6", "AGG-28", sql=FACETS)
def indexed_facets(t: Tables) -> DataFrame:
    return indexed_gazette(t).counts(t.documents, BooleanQuery.of_words("than"))


@query("txt_6_indexed_page", "TXT-6", "TOP-6", sql=PAGE)
def indexed_page(t: Tables) -> DataFrame:
    return indexed_gazette(t).page(t.documents, BooleanQuery.of_words("than"), F.col("lang").isin("en", "de"), size=20, after=(150,)).select("doc_id", "lang")


@query(
    "flt_11_trigram_index",
    "FLT-11",
    sql="SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE (text ILIKE '%THERE%ou%' OR text ILIKE '% ould%' OR text ILIKE '%ción los%') AND text NOT ILIKE '%zz%' AND text NOT ILIKE '%ing wh_n%'",
)
def trigram_search(t: Tables) -> DataFrame:
    """Substrings anywhere in the text: trigrams give the candidates, ILIKE decides."""
    index = TrigramIndex(t.spark, shared_folder(t.spark, "trigrams"), "doc_id", "text").build(t.documents)
    return index.matching(t.documents, ["%THERE%ou%", "% ould%", "%ción los%"], ["%zz%", "%ing wh_n%"]).select("doc_id", F.length("text").cast("long").alias("chars"))


@query("txt_7_lookup_and_years", "TXT-7", sql="SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders ORDER BY 1 DESC")
def years(t: Tables) -> DataFrame:
    return t.orders.select(F.year("o_orderdate").alias("year")).distinct().orderBy(F.desc("year"))


@query("txt_7_listing", "TXT-7", sql="SELECT l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 ORDER BY 1")
def listing(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_orderkey = 7").select("l_linenumber", "l_partkey").orderBy("l_linenumber")


@query("txt_7_sitemap", "TXT-7", sql="SELECT '/bulletins/' || year(o_orderdate) || '/' || month(o_orderdate) AS loc, max(o_orderdate)::DATE AS lastmod, count(*)::BIGINT AS entries FROM orders GROUP BY 1")
def sitemap(t: Tables) -> DataFrame:
    """A site map: a location for each bulletin, when it last changed, how much it holds."""
    loc = F.concat_ws("/", F.lit("/bulletins"), F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"))
    return t.orders.groupBy(loc.alias("loc")).agg(F.to_date(F.max("o_orderdate")).alias("lastmod"), F.count(F.lit(1)).alias("entries"))


LINKS = """SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>', 1)) AS href FROM pages"""


@query("txt_8_anchors", "TXT-8", "SRC-27", sql=f"SELECT page_id, href, count(*)::BIGINT AS n FROM ({LINKS}) GROUP BY ALL")
def anchors(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", F.inline(markup.anchors(F.col("html"))))
    return found.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(
    "txt_8_first_link_per_key",
    "TXT-8",
    sql="""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*"[^>]*>([^<]*)', 1) AS labels FROM pages),
l AS (SELECT page_id, url, unnest(range(1, len(hrefs) + 1)) AS pos, unnest(hrefs) AS href, unnest(labels) AS label FROM a),
k AS (SELECT *, lower(left(trim(label), 1)) AS initial, row_number() OVER (PARTITION BY page_id, lower(left(trim(label), 1)) ORDER BY pos) AS nth FROM l WHERE trim(label) <> '')
SELECT page_id, initial, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href ELSE href END AS href FROM k WHERE nth = 1""",
)
def first_link(t: Tables) -> DataFrame:
    """Absolute links; of each initial letter the first on the page."""
    found = t.pages.select("page_id", F.posexplode(markup.anchors(F.col("html"), F.col("url"))).alias("pos", "a"))
    keyed = found.select("page_id", "pos", "a.href", F.lower(F.substring("a.label", 1, 1)).alias("initial")).filter("initial <> ''")
    return keep_first(keyed, ["page_id", "initial"], [F.asc("pos")]).select("page_id", "initial", "href")


@query("txt_9_filtered_links", "TXT-9", sql=f"SELECT page_id, count(*)::BIGINT AS n FROM ({LINKS}) WHERE href LIKE '/t%' GROUP BY 1")
def filtered_links(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", F.inline(markup.anchors(F.col("html"))))
    return found.filter(F.col("label").startswith("t")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("txt_11_breadcrumb", "TXT-11", sql="SELECT n_nationkey, r_name AS section, CASE WHEN n_nationkey % 2 = 0 THEN 'Sub' END AS subsection, n_name AS organization FROM nation JOIN region ON n_regionkey = r_regionkey")
def breadcrumbs(t: Tables) -> DataFrame:
    middle = F.when(F.col("n_nationkey") % 2 == 0, F.lit(" > Sub > ")).otherwise(F.lit(" > "))
    trail = t.nation.join(small_side(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("r_name", middle, "n_name").alias("trail"))
    return trail.select("n_nationkey", markup.breadcrumb(F.col("trail")).alias("b")).select("n_nationkey", "b.section", "b.subsection", "b.organization")


@query("txt_12_trailing_number", "TXT-12", sql="SELECT page_id, try_cast(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/([0-9]+)(?:[.][a-z]+)?/?$', 1) AS INT) AS number FROM pages")
def trailing_numbers(t: Tables) -> DataFrame:
    return t.pages.select("page_id", trailing_number(F.regexp_replace("url", "[?#].*$", "")).alias("number"))


@query("sup_2_bulletins", "SUP-2", sql="""WITH recent AS (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 5)
SELECT source, string_agg(section || ':' || n, ',' ORDER BY section) AS sections FROM
 (SELECT source, coalesce(nullif(lang, 'es'), 'Sin sección') AS section, count(*) AS n FROM documents WHERE source IN (SELECT source FROM recent) GROUP BY ALL) GROUP BY 1""")
def bulletins(t: Tables) -> DataFrame:
    recent = t.documents.select("source").distinct().orderBy("source").limit(5)
    section = F.coalesce(F.nullif("lang", F.lit("es")), F.lit("Sin sección"))
    counted = t.documents.join(F.broadcast(recent), "source", "left_semi").groupBy("source", section.alias("section")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("section", "n")))
    return counted.groupBy("source").agg(F.array_join(F.transform(listed, lambda s: F.concat(s["section"], F.lit(":"), s["n"].cast("string"))), ",").alias("sections"))


@query("sup_4_facet_catalogue", "SUP-4", sql="SELECT lang AS name, count(*)::BIGINT AS n, 'section' AS facet FROM documents GROUP BY 1 UNION ALL SELECT NULL, count(*)::BIGINT, 'total' FROM documents")
def facet_catalogue(t: Tables) -> DataFrame:
    return facet_counts(t.documents, {"section": ("lang", 1000)})


#: Object keys and what they stand for: fixed values.
OBJECT_KEYS = (
    ("archive", r"^archive/archive\.html\.gz$"),
    ("year", r"^years/(\d{4})\.html\.gz$"),
    ("issue", r"^issues/(\d{4})-(\d{3})\.html\.gz$"),
    ("document", r"^documents/(\d{4})/(\d{3})/(\d{3})\.html\.gz$"),
)
KEYED_ORDERS = """SELECT o_orderkey % 6 AS kind, year(o_orderdate)::INT AS y, (o_orderkey % 1000)::INT AS k,
  CASE o_orderkey % 6 WHEN 0 THEN 'documents/' || year(o_orderdate) || '/' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '/007.html.gz'
    WHEN 1 THEN 'issues/' || year(o_orderdate) || '-' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '.html.gz'
    WHEN 2 THEN 'years/' || year(o_orderdate) || '.html.gz' WHEN 3 THEN 'archive/archive.html.gz' WHEN 4 THEN 'issues/' || year(o_orderdate) || '-1.html.gz' ELSE 'tmp/' || o_orderkey END AS object_key FROM orders"""
ENTITY = "CASE kind WHEN 0 THEN 'document' WHEN 1 THEN 'issue' WHEN 2 THEN 'year' WHEN 3 THEN 'archive' END"


def keyed_orders(t: Tables) -> DataFrame:
    kind, year, issue = F.col("o_orderkey") % 6, F.year("o_orderdate").cast("string"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")
    key = (
        F.when(kind == 0, F.concat(F.lit("documents/"), year, F.lit("/"), issue, F.lit("/007.html.gz")))
        .when(kind == 1, F.concat(F.lit("issues/"), year, F.lit("-"), issue, F.lit(".html.gz")))
        .when(kind == 2, F.concat(F.lit("years/"), year, F.lit(".html.gz")))
        .when(kind == 3, "archive/archive.html.gz")
        .when(kind == 4, F.concat(F.lit("issues/"), year, F.lit("-1.html.gz")))
        .otherwise(F.concat(F.lit("tmp/"), F.col("o_orderkey").cast("string")))
    )
    return classified(t.orders.select(key.alias("object_key")))


@query("sup_5_object_keys", "SUP-5", sql=f"SELECT object_key, {ENTITY} AS entity, CASE WHEN kind < 3 THEN y END AS year, CASE WHEN kind < 2 THEN k END AS issue, CASE WHEN kind = 0 THEN 7 END AS disposition FROM ({KEYED_ORDERS})")
def object_keys(t: Tables) -> DataFrame:
    return keyed_orders(t)


@query("sup_5_key_totals", "SUP-5", sql=f"SELECT coalesce({ENTITY}, 'unmatched') AS entity, count(*)::BIGINT AS n FROM ({KEYED_ORDERS}) GROUP BY 1")
def key_totals(t: Tables) -> DataFrame:
    """How many keys stand for what, the unmatched ones too."""
    return keyed_orders(t).groupBy(F.coalesce("entity", F.lit("unmatched")).alias("entity")).agg(F.count(F.lit(1)).alias("n"))


def classified(objects: DataFrame) -> DataFrame:
    """object_key with entity, year, issue and disposition; unmatched keys have none."""
    key, entity = F.col("object_key"), F
    for name, pattern in OBJECT_KEYS:
        entity = entity.when(key.rlike(pattern), name)

    def part(n: int) -> F.Column:
        out = F
        for _, pattern in OBJECT_KEYS:
            if pattern.count("(") >= n:
                out = out.when(key.rlike(pattern), F.regexp_extract(key, pattern, n).try_cast("int"))
        return out

    return objects.select("object_key", entity.alias("entity"), part(1).alias("year"), part(2).alias("issue"), part(3).alias("disposition"))
