"""Operator 12: texts turned for fill-in-the-middle training.

A text is cut at two token boundaries into prefix, middle and suffix, and these
are put in another order behind marks. Inside a task each text is decoded to an
array of its code points; comparing the classes of neighbours gives where its
tokens begin (a run of letters A-Z is one token, any other code point one),
and only those places and the three pieces are ever held beside it.

Where a text is cut, and which form it takes, is drawn from a digest of its id,
so a run can be repeated and needs no order. Rows are treated one by one.

A null text counts as an empty one and stays plain, as do texts that contain a
mark. A null id is drawn as an empty one would be. Rows that share an id are
cut by the same draws. An empty table gives an empty table. Texts of any length
take one pass, with 16 bytes or so for each code point of the longest at hand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

TOLD = "n long, form string, prefix_chars long, middle_chars long, output string"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def token_starts(points: np.ndarray) -> np.ndarray:
    """Where each token begins: everywhere but between two letters."""
    folded = points | 0x20
    letter = (folded >= ord("a")) & (folded <= ord("z"))
    return np.concatenate(([0], np.flatnonzero(~(letter[1:] & letter[:-1])) + 1)) if len(points) else np.zeros(0, dtype=np.int64)


def transformed(text: str | None, draws: tuple[int, int, int, int], plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of the prefix and of the middle, output) of one text."""
    text = text or ""
    points = code_points(text)
    starts = token_starts(points)
    n = len(starts)
    if not n or draws[2] % 100 >= plain_from or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted(int(starts[k]) if k < n else len(points) for k in (draws[0] % (n + 1), draws[1] % (n + 1)))
    prefix, middle, suffix = (part.tobytes().decode("utf-32-le") for part in np.split(points, [first, last]))
    if draws[3] % 100 < spm_below:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws(id_col: Column, seed: str = "1") -> Column:
    """Four unsigned 32-bit numbers, made from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document.

    Of a hundred documents, as they are drawn, those from ``plain_from`` on stay
    plain; of the others those below ``spm_below`` begin with their suffix.
    The lengths are null where a text is plain. Other columns of docs don't matter.
    """

    @F.pandas_udf(TOLD)
    def told(texts: pd.Series, drawn: pd.Series) -> pd.DataFrame:
        rows = [transformed(t, tuple(map(int, d)), plain_from, spm_below) for t, d in zip(texts, drawn, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = told(F.col(text_col).cast("string"), draws(F.col(id_col), seed))
    return docs.select(F.col(id_col).alias("doc_id"), made.alias("made")).select("doc_id", "made.*")


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made: exact, as no piece contains a mark."""
    either = "|".join(rf"\Q{m}\E" for m in (PREFIX, SUFFIX, MIDDLE))
    part = lambda k: F.get(F.split(output, either, -1), k)  # noqa: E731  0 is what stands before the first mark: nothing
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
