import pytest


@pytest.fixture
def docs(spark):
    """Nulls, empty and repeated texts, ties, and a column that clashes with the operators' own."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(0, base, "en", "a"), (1, base, "en", "a"), (2, base.replace("w30", "x"), "en", "b"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t", "de", "b"), (6, "one", "de", "a"), (7, "###", None, "a"), (8, "été " * 40, "fr", None), (8, "été " * 40, "fr", None), (None, "no id here", "en", "a"), (9, "Released under the MIT License. " + base.upper(), "en", "c")]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
