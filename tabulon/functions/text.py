"""Text expressions: normalising, tokens, term counts, answer clean-up."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space in Unicode text.
WHITE_SPACE = (
    "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _chars(*ranges: tuple[int, int]) -> list[str]:
    return [chr(c) for low, high in ranges for c in range(low, high + 1)]


SPACES = _chars((9, 13), (28, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# All letters whose lower case is a-z: two of them are not ASCII.
UPPER = {**{chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}, "\u0130": "i", "\u212a": "k"}
# The frequent other characters: ASCII signs, Latin letters, combining marks, general punctuation.
DROPPED = [c for c in _chars((0, 0x24F), (0x300, 0x36F), (0x2010, 0x206F))
           if c not in SPACES and c not in UPPER and not ("a" <= c <= "z" or "0" <= c <= "9")]
REST = f"[^a-z0-9{WHITE_SPACE}]+"


def _translated(text: Column, spaces: bool) -> Column:
    """Map capitals, drop the frequent signs, and turn white space to blanks if asked to, in one pass."""
    source, target = list(UPPER), list(UPPER.values())
    if spaces:
        source, target = source + SPACES, target + [" "] * len(SPACES)
    return F.translate(text, "".join(source + DROPPED), "".join(target))


def _ascii_or(clean: Column) -> Column:
    """Only a text that still holds other characters needs the regular expression, which is far slower."""
    return F.when(F.octet_length(clean) == F.length(clean), clean).otherwise(F.regexp_replace(clean, REST, ""))


def normalise(text: Column | str) -> Column:
    """Lower case; everything but a-z, 0-9 and white space is deleted (accented letters too)."""
    return _ascii_or(_translated(_column(text), spaces=False))


def tokens(text: Column | str) -> Column:
    """White-space tokens of the normalised text."""
    return F.array_remove(F.split(_ascii_or(_translated(_column(text), spaces=True)), " "), "")


def sql_tokens(text: str) -> str:
    """`tokens` as a SQL expression, for transformers that are saved with a model."""
    def literal(chars: list[str]) -> str:
        return "'" + "".join(f"\\u{ord(c):04x}" for c in chars) + "'"

    source = literal([*UPPER, *SPACES, *DROPPED])
    target = literal([*UPPER.values(), *[" "] * len(SPACES)])
    clean = f"translate({text}, {source}, {target})"
    rest = REST.replace("\\", "\\\\")
    return (f"array_remove(split(CASE WHEN octet_length({clean}) = length({clean}) THEN {clean} "
            f"ELSE regexp_replace({clean}, '{rest}', '') END, ' '), '')")


def word_count(text: Column | str) -> Column:
    """Number of white-space tokens. A split at one blank is a plain search; a pattern of all white space takes ten times as long."""
    text = _column(text)
    blank = F.translate(text, "".join(SPACES), " " * len(SPACES))
    return F.when(text.isNotNull(), F.size(F.array_remove(F.split(blank, " "), "")))


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility form. Plain ASCII text, which cannot change, is not sent to Python."""

    @F.pandas_udf(T.StringType())
    def convert(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    text = _column(text)
    ascii_only = text.rlike("^\\p{ASCII}*$")
    return F.when(ascii_only, text).otherwise(convert(F.when(~ascii_only, text)))


def clean_answer(text: Column | str) -> Column:
    """Collapse repeated words, set blanks at aB and a1, collapse blanks and empty lines, trim."""
    out = nfkc(text)
    out = F.regexp_replace(out, r"(?U)\b(\w{3,20})( \1\b)+", "$1")
    out = F.regexp_replace(out, "(?<=[a-z])(?=[A-Z])", " ")
    out = F.regexp_replace(out, "(?<=[a-zA-Z])(?=[0-9])", " ")
    out = F.regexp_replace(out, " +", " ")
    out = F.regexp_replace(out, "\n{2,}", "\n\n")
    return F.regexp_replace(out, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")
