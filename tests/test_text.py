import random
import re

import pytest
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions.vectors import dot, norm, unit
from passagework.operators import pages as P


def column(spark, values, *exprs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i")
    return [tuple(r) for r in rows.select(*exprs).collect()]


CASES = [
    ("Consulte la página 12.", ".", [12], []),
    ("Pulse el botón ››› pág. 59 y suelte.", "Pulse el botón y suelte.", [59], []),
    ("véase la pág.\n7, fig. 3 y Fig. 14", ", fig. 3 y Fig. 14", [7], [3, 14]),
    ("el coche es grande, pag 4", "el coche es grande", [4], []),
    ("⇒ fig. 2 » capítulo tres", "fig. 2 capítulo tres", [], [2]),
    ("pág. 12345", "5", [1234], []),
    ("uno   dos\n\n  tres", "uno dos\ntres", [], []),
    ("páginas 3", "páginas 3", [], []),
    ("", "", [], []),
]


@pytest.mark.parametrize(("given", "text", "refs", "figures"), CASES)
def test_references(spark, given, text, refs, figures):
    ((got,),) = column(spark, [given], T.strip_references(F.col("t")))
    assert (got.text, got.refs, got.figures) == (text, refs, figures)


# Fixed value: the same in one pattern, which tries every position of a text.
WHOLE = re.compile(r"[,;]?[^\S\n]*(?:[›»⇒]+[^\S\n]*)?(?:\b(?:v[ée]ase|ver|consulte|consultar)\b[^\S\n]*)?(?:\b(?:de|en)\b[^\S\n]*)?(?:\bla\b[^\S\n]*)?\bp[áa]g(?:ina|s)?\b\.?\s*(\d{1,4})", re.I)


def test_references_equal_one_pattern(spark):
    rng = random.Random(6)
    parts = ["ver", "Véase", "consultar", "la", "LA", "de", "en", "pág.", "página", "págs", "Pag", " ", " ", " ", "  ", "\n", ", ", ";", "›", "»» ", "12", "3", "45678", "x", "é", "fig. 3", "Fig 7", "\u00a0", "\t", "(", "٣"]
    given = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    got = column(spark, given, T.strip_references(F.col("t")))
    for text, (found,) in zip(given, got, strict=True):
        refs = sorted({int(m[1]) for m in WHOLE.finditer(text) if m[1].isascii()})
        bare = WHOLE.sub("", text)
        figures = sorted({int(n) for n in re.findall(r"\bfig\.?\s*(\d{1,4})", bare, re.I) if n.isascii()})
        plain = re.sub(r"[^\S\n]{2,}", " ", re.sub(r"[^\S\n]*[›»⇒]+[^\S\n]*", " ", bare).replace("\u00a0", " "))
        lines = [x.strip() for x in plain.split("\n")]
        assert (found.refs, found.figures, found.text) == (refs, figures, "\n".join(x for x in lines if x)), repr(text)


def test_hyphens_join_in_one_pass(spark):
    rng = random.Random(4)
    given = ["".join(rng.choice(["a", "B", "é", "Ñ", "-\n", "-", "\n", " ", "1"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    join = lambda m: m[1] + ("-" if m[2].isupper() else "") + m[2]
    want = [re.sub(r"(\w)-\n(\w)", join, g) for g in given]
    assert [r[0] for r in column(spark, given, T.rejoin_hyphens(F.col("t")))] == want


def test_plain_searches_miss_no_text_that_an_expression_finds(spark):
    assert column(spark, ["𝒜-\nb-\nc-\nd", "-\na"], T.rejoin_hyphens(F.col("t"))) == [("𝒜b-\ncd",), ("-\na",)]
    rare = [f"a {x}b" for x in T.RARE_SPACE + T.SPACES_E280 + "\u00a0 ›"]
    assert {r[0] for r in column(spark, [*rare, "a\t\u2009b", "a»⇒b"], T.tidy(F.col("t")))} == {"a b"}
    found = column(spark, ["f\u0131g. 3", "F\u0130G 4", "FiG.5", "higo 6"], T.figure_references(F.col("t")))
    assert found == [([3],), ([4],), ([5],), ([],)]
    named = column(spark, ["x pAg. 7 y", "VER LA PÁGINA 8", "página", "nada"], T.strip_references(F.col("t")))
    assert [(r[0].text, r[0].refs) for r in named] == [("x y", [7]), ("", [8]), ("página", []), ("nada", [])]
    bullets = column(spark, ["•a\n- b.\nc\nFig. 3\nd-e"], P.paragraphs_of(F.split("t", "\n")))
    assert bullets == [(["", "- a", "- b.", "c", "Fig. 3 d-e"],)]


def test_lines_and_predicates(spark):
    ((lines,),) = column(spark, ["  a \x07b \n\n  \nc\td\r\n"], T.lines_of(F.col("t")))
    assert lines == ["a  b", "c\td"]
    got = column(spark, ["12", "12\n", "1234", "12345", "٣", "— »", "x"], T.is_page_number(F.col("t")), T.is_title(F.col("t")))
    assert [g[0] for g in got] == [True, False, True, False, False, False, False]
    assert [g[1] for g in got][-2:] == [False, True]
    assert column(spark, ["a . . . . 3", "a.b.c.d"], T.is_dotted(F.col("t"))) == [(True,), (False,)]


def test_identities_and_editions(spark):
    row = spark.range(1).select(T.manual_id(F.lit("Seat"), F.array(F.lit("León SC"), F.lit("(Ibiza)")), F.array(F.lit("11.22"))).alias("id"))
    assert row.first().id == "Seat_Le-n-SC+Ibiza_11.22"
    got = column(spark, ["06.22", "11.22", "x", "1.22", "06.22\n"], T.edition_key(F.col("t")))
    assert [tuple(g[0]) for g in got] == [(22, 6), (22, 11), (0, 0), (0, 0), (0, 0)]


def test_labels_terms_accents(spark):
    one = spark.range(1)
    pages = T.page_label(F.array().cast("array<string>"), F.array(F.lit(10), F.lit(11), F.lit(12)))
    assert one.select(pages.alias("p")).first().p == "10-11-12"
    assert column(spark, ["", None, "x"], T.section_label(F.col("t"))) == [("sin seccion",), ("sin seccion",), ("x",)]
    assert column(spark, [" León (2020) ", ""], T.search_terms(F.col("t"))) == [(["león", "2020"],), ([],)]
    assert column(spark, ["áÑ¿ab"], T.accents(F.col("t"))) == [(3,)]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>").select(norm("a").alias("n"), unit(F.col("a")).alias("u"), unit(F.col("b")).alias("z"), dot(F.col("a"), F.col("a")).alias("d")).first()
    assert (row.n, row.d, row.z) == (5.0, 25.0, [0.0, 0.0]) and row.u == pytest.approx([0.6, 0.8])
