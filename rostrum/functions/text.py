"""Scalar text functions: normalisation, counts, splitting, and the few Arrow kernels that Spark lacks."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from urllib.parse import quote_plus

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

BLANK = r"\p{IsWhite_Space}"
#: Endings of sentences and clauses, symbols that comparison keeps, and glyphs that make a page suspicious.
SENTENCE_ENDS = "。！？!?；;"
SEGMENT_ENDS = "。！？!?"
CLAUSE_ENDS = "，,"
COMPARED_SYMBOLS = r"+\-*/=<>&|#_%"
SUSPICIOUS = "[□�]"
WORD_JOINER = "⁠"


#: Texts of a batch that are Python's at a time.
TEXTS = 64


def _each(one: Callable[[str], str]) -> Callable[[pa.Array], pa.Array]:
    """A kernel over batches of texts: a few at a time leave Arrow's buffers, so a worker doesn't hold a batch's texts as strings beside them."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else one(x) for x in texts.slice(k, TEXTS).to_pylist()], pa.string()) for k in range(0, len(texts), TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run


def _nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def comparable_text(text: str) -> str:
    return "".join([c for c in _nfkc(text).lower() if c.isalnum() or c in "+-*/=<>&|#_%"])


def alphanumeric_text(text: str) -> str:
    return "".join(filter(str.isalnum, _nfkc(text).lower()))


nfkc = F.arrow_udf(_each(_nfkc), StringType())
#: Text for fuzzy comparison: NFKC, lower case, letters, digits and mathematical symbols.
comparable = F.arrow_udf(_each(comparable_text), StringType())
#: Text for matching speech: NFKC, lower case, letters and digits.
alphanumeric = F.arrow_udf(_each(alphanumeric_text), StringType())


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end (``trim`` alone knows only U+0020)."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{BLANK}]")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANK}+", "")


def solid_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.char_length(without_blanks(text))


def has_alphanumeric(text: Column) -> Column:
    return text.rlike(r"[\p{IsAlphabetic}\p{N}]")


def split_after(text: Column, endings: str) -> Column:
    """Pieces of a text, each with the ending that closes it; none is empty."""
    return F.filter(F.split(text, f"(?<=[{endings}])"), lambda x: x != "")


def clock(ms: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on; null stays null."""
    seconds = F.floor(ms / 1000)
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.concat_ws(":", pad(F.floor(seconds / 60)), pad(seconds % 60))
    long = F.concat_ws(":", pad(F.floor(seconds / 3600)), pad(F.floor(seconds / 60) % 60), pad(seconds % 60))
    return F.when(ms.isNull(), None).when(seconds >= 3600, long).otherwise(short)


def normalized_lines(text: Column) -> Column:
    """Trimmed lines without word joiners; empty ones are left out."""
    own = F.transform(F.split(text, "\n"), lambda x: trimmed(F.replace(x, F.lit(WORD_JOINER), F.lit(""))))
    return F.filter(own, lambda x: x != "")


def canonical_footer(line: Column) -> Column:
    """White space collapsed, and a trailing page count ``n / m`` dropped."""
    return F.regexp_replace(trimmed(F.regexp_replace(line, f"{BLANK}+", " ")), " [0-9]+ / [0-9]+$", "")


def search_words(text: Column) -> Column:
    """Lower case, everything but letters and digits a space, spaces collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def ascii_terms(text: Column) -> Column:
    """The plain tokenizer of checked queries: runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _analyze(s: pd.Series) -> pd.Series:
    import regex

    word, cjk = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+|[\p{Alphabetic}\p{M}\p{N}]+"), regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")

    def terms(text: str | None) -> list[str] | None:
        if text is None:
            return None
        out: list[str] = []
        for run in word.findall(unicodedata.normalize("NFKC", text)):
            if cjk.match(run):
                out += [*run, *(a + b for a, b in zip(run, run[1:], strict=False))]
            else:
                out.append(run.lower())
        return out

    return s.map(terms)


#: The default tokenizer: words of alphabetic scripts; single characters and pairs of those written without spaces.
analyze = F.pandas_udf(_analyze, ArrayType(StringType()))


def half_up_div(a: Column, b: int | Column) -> Column:
    """(a + b/2) / b in whole numbers, for a >= 0."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.floor((a + F.floor(b / 2)) / b)


def midpoint(left: Column, right: Column) -> Column:
    """The mean of two times, rounded up."""
    return F.floor((left + right + 1) / 2)


def json_body(content: Column) -> Column:
    """A response that is JSON, or one whole fenced JSON block; never JSON out of prose."""
    inner = F.regexp_extract(trimmed(content), r"(?s)^```json\r?\n(.*)```$", 1)
    return F.when(inner != "", inner).otherwise(content)


def parsed_price(text: Column) -> Column:
    """currency and amount of a price such as ``$1.5``; null unless it is finite, not negative and in one currency."""
    sign, amount = F.regexp_extract(trimmed(text), r"^([$￥¥])\s*([0-9]+(?:\.[0-9]+)?)$", 1), F.regexp_extract(trimmed(text), r"^([$￥¥])\s*([0-9]+(?:\.[0-9]+)?)$", 2)
    return F.when(sign != "", F.struct(F.when(sign == "$", "USD").otherwise("CNY").alias("currency"), amount.try_cast("double").alias("amount")))


def per_token(per_million: Column) -> Column:
    """A price per token in dollars as text: fifteen decimals without trailing zeros, one at least."""
    short = F.regexp_replace(F.format_string("%.15f", per_million / 1_000_000), "0+$", "")
    return F.concat(F.lit("$"), F.regexp_replace(short, r"\.$", ".0"))


#: Headers whose values are secret.
SECRET_HEADERS = ("authorization", "proxy-authorization", "x-api-key")


def _spellings(secret: str) -> list[str]:
    """A secret as itself, inside a JSON string, and form-encoded; the longest first."""
    inner = json.dumps(secret, ensure_ascii=False)[1:-1]
    return sorted({secret, inner, quote_plus(secret, safe="*-._")}, key=lambda s: (-len(s), s))


def redacted(text: Column, secrets: list[str]) -> Column:
    """Serialised JSON or plain text with every spelling of a secret replaced, and values of secret headers at any depth.

    A header's value is a string, a number, a word, or a list or object without others in it; deeper ones keep what secrets don't name.
    """
    for spelling in (v for s in sorted((s for s in secrets if s), key=len, reverse=True) for v in _spellings(s)):
        text = F.replace(text, F.lit(spelling), F.lit("<REDACTED>"))
    value = r'(?:"(?:[^"\\]|\\.)*+"|\[[^\[\]]*+\]|\{[^{}]*+\}|[^\s",\[\]{}]++)'
    return F.regexp_replace(text, rf'(?i)("(?:{"|".join(SECRET_HEADERS)})"\s*:\s*){value}', '$1"<REDACTED>"')
