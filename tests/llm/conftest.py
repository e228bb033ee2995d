import pytest

#: Ids and texts that operators must stand: nulls, empties, ties, repeated rows, long text, odd white space and characters.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog"), (2, "the  quick brown fox\tjumps over the LAZY dog "), (3, None), (4, ""), (5, "x"), (6, "\x1c \x0b"),
    (7, "call me at +1 (415) 555-0100 or a.b@example.com, 10.0.0.1 and 4111 1111 1111 1111."), (8, "The quick brown fox jumps over the lazy dog"),
    (9, "long " * 30_000), (10, "ＦＵＬＬ ﬁ Straße É𝔘𝟙"), (10, "ＦＵＬＬ ﬁ Straße É𝔘𝟙"), (None, "no id at all here"), (None, None), (-5, "negative id <|endoftext|> é"), (2**60 + 1, "big id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with lang, source and n_chars, and columns whose names clash with results."""
    rows = [(i, t, [None, "en", "fr"][k % 3], [None, "a", "b", "b"][k % 4], None if t is None else len(t), "x", 1.5, k) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, size int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
