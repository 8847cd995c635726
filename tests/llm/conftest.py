import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("start", "end", "n", "h", "fp", "canon", "host", "keys", "node", "root", "dest", "kind", "blob", "salt", "length", "rank", "sequence_id", "offset", "n_words", "n_hit", "n_lines", "evidence", "part", "sim", "__linededup_text", "__linededup_host", "__langid_host", "__langid_h", "__langid_lang", "__first_id", "__near_mark", "__Part")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    long = "word and another line that goes on for a while " * 4000
    rows = [
        (1, "plain words of an ordinary text, as they come", "en", "a", 5),
        (1, "plain words of an ordinary text, as they come", "en", "a", 5),
        (2, None, None, None, None),
        (None, "a text without an id, but with words in it for all that", None, "a", 1),
        (None, None, None, None, None),
        (3, "", "de", "", 0),
        (4, " \t\n  ", "fr", "a", 3),
        (5, long, "en", "a", len(long)),
        (6, "x" * 60_000, "en", "b", 1),
        (7, "é́\U0001f642 ﬁ <|endoftext|> \\ </s>", "xx", "b", 9),
        (8, "plain words of an ordinary text, as they come", "en", "b", 5),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
