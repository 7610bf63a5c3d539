"""Normalisation, tokens and phrases, against Python's own Unicode functions."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.plans.config import FUNCTION_WORDS, Config

CONFIG = Config()
CASES = ["", "   ", "123", "4.5", "2½ Men", "Amélie", "Amélie", "東京物語 1953", "Дневной дозор", "Οδύσσεια ΣΑΣ", "기생충", "the 1970s, 9/11 & 3D", "a b c\x1cd", "tab\tnew\nline", "snake_case", "T.I.", "Straße ẞ", None]


def run(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.o for r in rows.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def plain(value):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", value or "").lower()).strip()


def test_normalise(spark):
    assert run(spark, CASES, lambda c: T.normalise_text(c, CONFIG)) == [plain(c) for c in CASES]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=30), min_size=100, max_size=100))
def test_tokens_of_any_text(spark, values):
    # characters that the JVM's and Python's Unicode versions both know; a dotted capital I lower-cases to two characters
    values = ["".join(c for c in v if unicodedata.ucd_3_2_0.category(c) != "Cn" and c != "İ") for v in values]
    want = [[t for t in re.findall(r"[^\W_]+", plain(v)) if len(t) >= 2] for v in values]
    got = run(spark, values, lambda c: T.tokens(T.normalise_text(c, CONFIG), CONFIG))
    assert got == want


def test_tokens_keep_order_digits_and_repetitions(spark):
    text = ["The 1970s, the 19th century and the 1970s of a 3d x film"]
    assert run(spark, text, lambda c: T.tokens(T.normalise_text(c, CONFIG), CONFIG, 2, True)) == [["1970s", "19th", "century", "1970s", "3d", "film"]]
    no_digits = Config(keep_digits=False)
    assert run(spark, text, lambda c: T.tokens(T.normalise_text(c, no_digits), no_digits, 2, True)) == [["century", "film"]]
    assert len(FUNCTION_WORDS) == len(set(FUNCTION_WORDS)) and "not" in FUNCTION_WORDS


@pytest.mark.parametrize("value", ["post-apocalyptic future", "Post_Apocalyptic future", "post apocalyptic   FUTURE"])
def test_phrases_are_one_token(spark, value):
    got = run(spark, [value], lambda c: T.phrase_token(T.normalise_text(c, CONFIG)))
    assert got == [[value.lower().replace("-", "_").replace("   ", "_").replace(" ", "_")]]


def test_short_phrases_and_names(spark):
    assert run(spark, ["x", "!!", None, "Science Fiction"], lambda c: T.phrase_token(T.normalise_text(c, CONFIG))) == [[], [], [], ["science_fiction"]]
    assert run(spark, [" Straße  X", None, "İ", "JOSÉ"], T.normalise_name) == ["strasse x", "", "İ".casefold(), "josé"]
    assert run(spark, ["Amélie (2001)", "AMELIE", "東京", "(2001)", "!!", None], T.normalise_title) == ["amelie", "amelie", "東京", "(2001)", "!!", ""]
    assert run(spark, ["1999-05-07", "99", None, "abcd", "2020"], T.year_of) == [1999, None, None, None, 2020]
