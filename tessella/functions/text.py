"""Text to text and text to tokens, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.config import FUNCTION_WORDS, Config

#: White space of every script, control separators included.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Letters and numbers; an underscore is none.
TOKEN = r"([\p{L}\p{N}]+)"
NOT_WORD = r"[^\p{L}\p{N}_]+"
#: No character from U+0300 on: such a text is in NFC already.
PLAIN = r"^[\x00-\u02ff]*$"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unaccented(texts: pd.Series) -> pd.Series:
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    return texts.map(fold, na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition; only texts that may change go to Python."""
    return F.coalesce(_nfc(F.when(~text.rlike(PLAIN), text)), text)


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def stripped(text: Column) -> Column:
    """No white space at the ends."""
    return F.btrim(text, F.lit(WHITE))


def folded(value: Column, config: Config) -> Column:
    """Composed and lower-cased, white space as it is; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.lower(nfc(text) if config.unicode_form == "NFC" else text)


def normalise_text(value: Column, config: Config) -> Column:
    """Composed, lower-cased, squeezed; null is empty. Accents stay."""
    return squeezed(folded(value, config))


def tokens(text: Column, config: Config, min_length: int = 2, drop_function_words: bool = False) -> Column:
    """Tokens of a folded text in order, repetitions kept; white space separates them like anything else."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    keep = lambda t: F.length(t) >= min_length
    if not config.keep_digits:
        keep = lambda t, keep=keep: keep(t) & ~t.rlike(r"\p{Nd}")
    if drop_function_words:
        return F.filter(found, lambda t: keep(t) & ~t.isin(*FUNCTION_WORDS))  # a hash set of literals
    return F.filter(found, keep)


def canonical_phrase(text: Column) -> Column:
    """A normalised label with everything but word characters as single spaces."""
    return squeezed(F.regexp_replace(text, NOT_WORD, " "))


def phrase_token(text: Column, min_length: int = 2) -> Column:
    """A normalised label as one token in an array, or an empty array if it is too short."""
    phrase = canonical_phrase(text)
    long_enough = (phrase != "") & (F.length(phrase) >= min_length)
    return F.when(long_enough, F.array(F.translate(phrase, " ", "_"))).otherwise(F.array().cast("array<string>"))


def casefold(text: Column) -> Column:
    """Composed and case-folded; only texts beyond ASCII go to Python."""
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    return F.coalesce(_casefold(F.when(~ascii_only, text)), F.lower(text))


def casefolded(text: str) -> str:
    """casefold and stripped of one text in the driver, such as what a search asks for."""
    return unicodedata.normalize("NFC", text).casefold().strip(WHITE)


def normalise_name(value: Column) -> Column:
    """A name as the key of a person or title: folded and squeezed; null is empty."""
    return squeezed(casefold(F.coalesce(value, F.lit(""))))


def normalise_title(value: Column) -> Column:
    """A title as the key of its duplicates: accents and a trailing (year) dropped; what folds to nothing keeps its text."""
    title = F.coalesce(value, F.lit(""))
    plain = title.rlike(r"^\p{ASCII}*$")
    folded = F.coalesce(_unaccented(F.when(~plain, title)), F.lower(title))
    folded = F.regexp_replace(folded, r"\([0-9]{4}\)[\s\x1c-\x1f\x85\p{Z}]*$", "")
    return F.coalesce(F.nullif(canonical_phrase(folded), F.lit("")), squeezed(F.lower(title)))


def year_of(date: Column) -> Column:
    """The first four characters as a number, if they are digits."""
    return F.when(date.rlike("^[0-9]{4}"), F.substring(date, 1, 4).cast("int"))
