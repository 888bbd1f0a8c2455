"""Column builders whose meaning differs between SQL dialects, pinned down once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(c: Column | str, scale: int = 4) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(_col(c).cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(c: Column | str, scale: int = 4) -> Column:
    return exact_sum(c, scale) / F.count(c)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- null handling -----------------------------------------------------------------


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round((F.lit(100.0) * part / F.nullif(whole, F.lit(0))).cast("double"), digits)


# --- identity ----------------------------------------------------------------------


def row_id(*columns: Column | str) -> Column:
    """MD5 over the columns' texts, nulls as empty."""
    return F.md5(F.concat(*(F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns)))


# --- dates -------------------------------------------------------------------------


def minutes_between(start: Column, end: Column) -> Column:
    """How many minute boundaries lie between two timestamps (00:00:59 to 00:02:00 is 2)."""
    minute = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / 60)
    return (minute(end) - minute(start)).cast("long")


def from_compact_stamp(stamp: Column) -> Column:
    """yyyyMMddHHmmss as number or text; null if it is not a timestamp."""
    return F.try_to_timestamp(F.lpad(stamp.cast("string"), 14, "0"), F.lit("yyyyMMddHHmmss"))


def from_zoned_text(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def from_iso_utc(text: Column) -> Column:
    """2024-01-02T03:04:05Z: separators replaced, read as UTC."""
    return F.try_to_timestamp(F.replace(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))


#: Spanish month names in calendar order: fixed values of the date format.
SPANISH_MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
#: Another spelling that texts use, with its month's number.
SPANISH_MONTH_VARIANTS = {"setiembre": 9}


def spanish_date(text: Column) -> Column:
    """ISO date text of the first "5 de enero de 2024" in ``text``; null if there is none."""
    pattern = rf"(?i)(\d{{1,2}})\s+de\s+({'|'.join((*SPANISH_MONTHS, *SPANISH_MONTH_VARIANTS))})\s+de\s+(\d{{4}})"
    part = lambda n: F.regexp_extract(text, pattern, n)
    numbers = {name: n for n, name in enumerate(SPANISH_MONTHS, start=1)} | SPANISH_MONTH_VARIANTS
    month = coded(F.lower(part(2)), numbers)
    return F.when(part(1) != "", F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")))


# --- text --------------------------------------------------------------------------


def initcap_words(text: Column) -> Column:
    """Every run of letters and digits starts upper case, whatever stands before it."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, F.length(p)))), "")


#: Words that stay lower case inside a title: fixed values.
SMALL_WORDS = ("de", "del", "la", "las", "los", "y", "el", "en")


def section_title(title: Column) -> Column:
    """Strip Roman numberings ("III.- ", "IV. II."), then title case except the small words.

    Null, empty and all-numbering titles come back as they are.
    """
    bare = F.trim(F.regexp_replace(title, r"^(?:[IVXLC]+[.\-]+\s*)+", ""))

    def cased(word: Column, i: Column) -> Column:
        low = F.lower(word)
        return F.when((i > 0) & low.isin(*SMALL_WORDS), low).otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, F.length(low))))

    return F.when(bare == "", title).otherwise(F.array_join(F.transform(F.split(bare, r"\s+"), cased), " "))


#: Letters of the respacing rules, and words that extraction glues to the one before: fixed values.
SMALL_LETTERS, CAPITALS = "a-záéíóúüñ", "A-ZÁÉÍÓÚÜÑ"
GLUED_WORDS = ("de", "del", "la", "las", "los")


def recased(text: Column) -> Column:
    """Put back spaces lost in extraction between cases and after a leading Roman number; in this order."""
    return F.regexp_replace(F.regexp_replace(text, rf"([{SMALL_LETTERS}])([{CAPITALS}])", "$1 $2"), r"^([IVXLC]+\.)(\S)", "$1 $2")


def respaced(text: Column) -> Column:
    """``recased``, then a space before glued small words; for short labels, as longer words end alike."""
    return F.regexp_replace(recased(text), rf"(?U)([{SMALL_LETTERS}]{{2}})({'|'.join(GLUED_WORDS)})\b", "$1 $2")


def delimited(text: Column, separator: str) -> Column:
    """The filled, trimmed items of a delimited text; an empty array for null."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), f"\\Q{separator}\\E"), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def trailing_number(url: Column) -> Column:
    """The integer that ends a URL path, before an extension."""
    return F.regexp_extract(url, r"/(\d+)(?:\.\w+)?/?$", 1).try_cast("int")


# --- choice ------------------------------------------------------------------------


def coded(c: Column | str, names: dict, default: str | None = None) -> Column:
    """A CASE over fixed codes; without ``default`` unknown codes are null."""
    out = F
    for code, name in names.items():
        out = out.when(_col(c) == code, name)
    return out.otherwise(default) if default is not None else out


def bucket_by(c: Column, limits: Sequence[tuple[float, str]], rest: str) -> Column:
    """The first label whose limit lies above the value."""
    out = F
    for limit, label in limits:
        out = out.when(c < limit, label)
    return out.otherwise(rest)


def median(c: Column | str, exact: bool = True) -> Column:
    return F.median(_col(c)) if exact else F.approx_percentile(_col(c).cast("double"), 0.5, 1000)
