import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 97} x{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, long), (6, long), (6, long), (7, "same text here for all of us"), (8, "same text here for all of us"),
        (None, "same text here for all of us"), (9, "Mail jo.1@mail2.example.com or +1 (132) 555-1352, card 4111 1111 1111 1111, host 10.0.0.1"), (10, "ÉÈ ß 日本語 🎉 \x1c <|endoftext|> don't"),
        (11, "You idiot and i d i o t, st.upid"), (12, "x" * 5000),
    ]
    extra = [(a, b, i, "n", "h", float(i), [i]) for i, (a, b) in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, n int, node string, h string, score double, spans array<int>").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
