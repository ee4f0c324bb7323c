"""Operator 3: secret scans.

An Aho-Corasick automaton over the keywords of all detectors passes over each
text once. Only where a keyword is hit is that detector's expression tried,
anchored at the hit. A detector whose tokens carry a checksum or a structure of
their own has it verified before a span is reported.

A private key is reported from its header to the matching END line, or, if that
is missing, to the end of its base64 lines.

The hexadecimal detector has no keyword; its run of 32 digits is its own
prefilter.

Rows are independent: one narrow stage without a shuffle, whatever the skew.
A null or empty text gives no spans; repeated rows each give their own row. The
time for a text grows in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Detectors in their order of precedence, with the keywords (in
# lower case) that lead to each and the expression tried at a hit.
BASE_KINDS = ("assign", "access", "hex")
DETECTORS = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    ),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+")),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "jwt": (("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{16,}")),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"xox[bpars]-[0-9]{8,}-[A-Za-z0-9-]{12,}")),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}")),
    "google": (("aiza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")),
    "pem": (("-----begin ",), re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")),
}
# What follows a private key's header if no END line closes it: fields and a blank line, then base64 in runs and lines of their own.
_NL = r"(?:\r?\n|\\r\\n|\\n|\r)"
_END = rf"(?=[\x20\t]*(?:{_NL}|\Z|[\"']))"
KEY_LINES = re.compile(
    rf"(?:[\x20\t]*[A-Za-z0-9+/]{{40,}}={{0,2}})*(?:[\x20\t]+[A-Za-z0-9+/]+={{0,2}}{_END})?"
    rf"(?:(?:{_NL}[\x20\t>]*[A-Za-z][A-Za-z0-9-]*:[\x20\t][^\r\n\\]*)*(?:{_NL}[\x20\t>]*)?(?:{_NL}[\x20\t>]*[A-Za-z0-9+/]+={{0,2}}{_END})+)?"
)
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
ORDER = {k: i for i, k in enumerate((*BASE_KINDS, *(k for k in DETECTORS if k not in BASE_KINDS)))}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, "0")


def _crc_token(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before, in base 62."""
    return base62(binascii.crc32(m[1].encode()), 6) == m[2]


def _signed_token(m: re.Match) -> bool:
    """The header of a signed token decodes to a JSON object naming its algorithm. One that is nested too deeply to be read is none."""
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


VALID = {
    "assign": lambda m: len(m[2]) >= 8,
    "access": lambda m: m.end() - m.start() >= 16,
    "github": _crc_token,
    "npm": _crc_token,
    "jwt": _signed_token,
}


def _key_end(text: str, m: re.Match) -> int:
    """The end of the private key that a header begins; it never runs into the next header."""
    other = text.find("-----BEGIN ", m.end())
    close = f"-----END {m[1]}-----"
    at = text.find(close, m.end(), other if other >= 0 else len(text))
    return at + len(close) if at >= 0 else KEY_LINES.match(text, m.end()).end()


#: A failed attempt fails for all hits in the same run of these, since what follows the run decides: none is scanned twice.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]*")}


#: Where a secret ends that goes on after its detector's expression.
ENDS = {"pem": _key_end}


def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for kind, (words, _) in DETECTORS.items():
        for w in words:
            auto.add_word(w, (kind, len(w)))
    auto.make_automaton()
    return auto


def _folded(text: str) -> str:
    """Lower case of the same length; only candidates come of it, expressions see the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def spans_of(text: str, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans of one text by start, then kind; leftmost and non-overlapping within a kind."""
    found, free = [], dict.fromkeys(DETECTORS, 0)
    hits = sorted((end - n + 1, ORDER[kind], kind) for end, (kind, n) in auto.iter(_folded(text)))
    for start, _, kind in hits:
        if start < free[kind]:
            continue
        if m := DETECTORS[kind][1].match(text, start):
            free[kind] = end = ENDS[kind](text, m) if kind in ENDS else m.end()
            if kind not in VALID or VALID[kind](m):
                found.append((start, ORDER[kind], end, kind))
        elif kind in RUNS:
            free[kind] = RUNS[kind].match(text, start).end()
    found += [(m.start(), ORDER["hex"], m.end(), "hex") for m in HEX_RUN.finditer(text)]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) of every row; offsets in code points, end exclusive."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t or "", auto)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "id long, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of text replaced by a mark; all columns and rows stay."""
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def cover(text: str | None, auto: ahocorasick.Automaton) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for _, start, end in spans_of(text, auto):
            if start >= last:
                out += [text[last:start], mark]
            last = max(last, end)
        return "".join([*out, text[last:]]) if out else text

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in batches:
            text = pa.array([cover(t, auto) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at).name, text)

    return docs.mapInArrow(clean, schema)
