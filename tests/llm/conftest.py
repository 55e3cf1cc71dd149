"""Edge tables: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import pytest
import public_tokenizers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, score double, bucket string, digest string, bands int"
LONG = " ".join(f"word{i % 977} of line{i}" + (".\n" if i % 9 == 0 else "") for i in range(12_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "  \t\n ", "de", None),
    (6, "héllo wörld ñandú 😀 ça va", "fr", "ü"),
    (7, LONG, "en", "b"),
    (8, LONG + " tail", "en", "b"),
    (9, "<|endoftext|> one two", "en", "c"),
    (10, "12345 !!!", "de", "c"),
    (None, "no id at all here", "en", None),
    (None, "no id at all here", "en", "a"),
    (11, "two words", "en", "a"),
    (12, "Der schnelle braune Fuchs springt über den faulen Hund und läuft weg", "de", "a"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([(*r, None, 1, 0.5, "x", None, 7) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocab():
    return public_tokenizers.path
