"""Column functions over text. All are built-in expressions, without a UDF.

Java's classes are ASCII by default, so patterns that mean any letter or any
white space carry ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and characters that decide what a text yields.
NON_TEXT = r"[\uE000-\uF8FF\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
DOTTED = r"(?U)\.\s*\.\s*\.\s*\."
PAGE_NUMBER = r"\A[0-9]{1,4}\z"
BULLETS = "●▪•–-"
BULLET = rf"(?U)\A\s*[{BULLETS}]\s*"
FIGURE_CAPTION = r"(?U)\AFig\.\s*\d"
GLYPH = "›»⇒"
GLYPHS = rf"[{GLYPH}]+"
#: A reference from its noun on. The first part is what most positions fail at, at little cost.
PAGE_NUMBERED = r"(?iU)(?=p)\bp[áa]g(?:ina|s)?\b\.?\s*(\d{1,4})"
NUMBER_AT_START = r"(?U)\A\d{1,4}"
# The words that may lead up to a reference's noun, in the order in which they are read.
LEAD_WORDS = [["véase", "vease", "ver", "consulte", "consultar"], ["de", "en"], ["la"]]
#: The same as it is met from the noun to the left, in a reversed text: only there can a lead be cut off in time that grows with the text.
LEAD_BACKWARDS = (
    r"(?iU)\A" + "".join(rf"(?:[^\S\n]*\b(?:{'|'.join(w[::-1] for w in words)})\b)?" for words in reversed(LEAD_WORDS)) + rf"(?:[^\S\n]*{GLYPHS})?[^\S\n]*[,;]?"
)
FIGURE_REFERENCE = r"(?iU)(?=f)\bfig\.?\s*(\d{1,4})"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space on a line other than the two kinds of space; of the second, all begin with the bytes E2 80.
RARE_SPACE = "\t\x0b\x0c\r\x85\u1680\u205f\u3000"
SPACES_E280 = "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f"
ACCENTED = "áéíóúüñÁÉÍÓÚÜÑ¡¿"

MARK = "\u0000"  # cannot occur once a text is cleaned


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def has_any(c: Column, parts: Iterable[str]) -> Column:
    """Holds one of the parts. A plain search costs a small part of what an expression does, so it goes before those that few texts need."""
    return reduce(or_, (c.contains(p) for p in parts))


def clean(c: Column) -> Column:
    """Private-use and control characters as spaces."""
    return F.regexp_replace(c, NON_TEXT, " ")


def lines_of(c: Column) -> Column:
    """The stripped lines of a cleaned text that aren't empty."""
    return F.filter(F.transform(F.split(clean(c), "\n"), strip), lambda x: x != "")


def is_dotted(line: Column) -> Column:
    """Has the leaders of a table of contents."""
    return line.rlike(DOTTED)


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def is_title(line: Column) -> Column:
    return line.rlike(r"(?U)\w")


def rejoin_hyphens(c: Column) -> Column:
    """Words split over lines made whole, in one pass; a compound with a capital keeps its hyphen.

    A letter joins on one side only: of a-, b-, c on lines of their own, b joins
    a and c stays.
    """
    marked = F.regexp_replace(c, r"(?U)-\n(?<=\w{1,2}-\n)(\w(?:-\n)?)", MARK + "$1")  # from its fixed part on; a letter may be two units long
    return F.replace(F.regexp_replace(marked, MARK + r"(?=\p{Lu})", "-"), F.lit(MARK), F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f mentions it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _distinct_numbers(found: Column) -> Column:
    """The distinct numbers, in order; digits of other scripts are left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull())))


def figure_references(c: Column) -> Column:
    """Figures named in a text from which page references are gone."""
    # The other two letters i are read as one where case doesn't count.
    found = F.when(~has_any(F.lower(c), ["fig"]) & ~has_any(c, "ıİ"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(c, F.lit(FIGURE_REFERENCE), F.lit(1)))
    return _distinct_numbers(found)


def tidy(c: Column) -> Column:
    """Glyphs and hard spaces as one space, no blank lines."""
    spaced = c
    for glyph in GLYPH + "\u00a0":
        spaced = F.replace(spaced, F.lit(glyph), F.lit(" "))

    def narrowed(x: Column) -> Column:
        rare = has_any(x, RARE_SPACE) | (F.contains(x.cast("binary"), F.lit(b"\xe2\x80")) & has_any(x, SPACES_E280))
        return F.when(rare, F.regexp_replace(x, r"(?U)[^\S\n]{2,}", " ")).when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x)

    narrow = let(spaced, narrowed)
    return F.array_join(F.filter(F.transform(F.split(narrow, "\n"), strip), lambda x: x != ""), "\n")


def strip_references(c: Column) -> Column:
    """struct(text, refs, figures): a text without its page references, the pages and figures it named.

    A reference is found by its noun and number, which few places of a text
    begin with. The words that lead up to it are then taken off the end of the
    text before, read backwards; its number heads the text after.
    """
    marked = F.when(~has_any(F.lower(c), ["pag", "pág"]), F.array(c)).otherwise(F.split(F.regexp_replace(c, PAGE_NUMBERED, MARK + "$1"), MARK))
    bare = lambda p, i, n: F.when(i < n - 1, F.reverse(F.regexp_replace(F.reverse(p), LEAD_BACKWARDS, ""))).otherwise(p)
    behind = lambda p, i: F.when(i > 0, F.regexp_replace(p, NUMBER_AT_START, "")).otherwise(p)

    def struct(parts: Column) -> Column:
        refs = _distinct_numbers(F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.regexp_extract(p, "(" + NUMBER_AT_START + ")", 1)))
        text = F.array_join(F.transform(parts, lambda p, i: behind(bare(p, i, F.size(parts)), i)), "")
        return let(text, lambda t: F.struct(tidy(t).alias("text"), refs.alias("refs"), figure_references(t).alias("figures")))

    return let(marked, struct)


def accents(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.translate(c, ACCENTED, ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), r"\A-|-\z", "")


def manual_id(brand: Column, models: Column, editions: Column) -> Column:
    return F.concat(brand, F.lit("_"), F.array_join(F.transform(models, slug), "+"), F.lit("_"), F.array_join(editions, "+"))


def edition_key(edition: Column) -> Column:
    """struct(yy, mm) by which MM.YY editions are ordered; anything else is oldest."""
    parts = lambda i: F.coalesce(F.regexp_extract(edition, r"\A(\d{2})\.(\d{2})\z", i).try_cast("int"), F.lit(0))
    return F.struct(parts(2).alias("yy"), parts(1).alias("mm"))


def section_label(section: Column) -> Column:
    return F.coalesce(F.nullif(section, F.lit("")), F.lit("sin seccion"))


def page_label(printed: Column, pages: Column) -> Column:
    """All printed numbers, or if there are none all page numbers, joined by hyphens."""
    return F.array_join(F.when(F.size(printed) > 0, printed).otherwise(F.transform(pages, lambda p: p.cast("string"))), "-")


def search_terms(query: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(query), "[()]", " "), r"(?U)\s+"), lambda t: t != "")
