import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """The session with a folder for intermediates, as a cluster would name one."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="session")
def odd_documents(shared):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names the operators use."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "The cat is on the mat and it was the best of all days. " * 3),
        (6, "The cat is on the mat and it was the best of all days. " * 3), (7, "word " * 60_000), (None, "no id here"),
        (None, None), (8, "same row"), (8, "same row"), (9, "x" * 300_000), (10, "é́ß😀   token = 'abcdefgh12'"),
    ]
    extra = ("fp", "words", "_words", "_judged", "kept", "_rank", "_keep", "n_words", "u", "place", "features")
    data = [(i, t, *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(rows)]
    return shared.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra)).coalesce(1)
