import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, size int, group string, label int"
FUNCTION_WORDS = "the of and to in is that it was for on are as with his they at be this from".split()


def prose(k: int, n: int = 80) -> str:
    """Different words for different k."""
    return " ".join(FUNCTION_WORDS[(i * 7 + k) % 20] if i % 3 else f"word{k}x{i}" for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns with names that operators use themselves."""
    rows = [(i, prose(i), "en", f"s{i % 3}") for i in range(12)]
    rows += [(12, None, "en", "s0"), (13, "", None, None), (None, prose(50), "en", None), (14, "  \n\t ", "de", "s1"), (15, "one", None, "s2"), (16, prose(1), "en", "s1"), (3, prose(3), "en", "s0"), (3, prose(3), "en", "s0")]
    rows += [(17, ("long " + prose(9, 400) + "\n") * 60, "fr", "s2"), (18, "é漢字😀 " * 30, "ja", "s1"), (-5, prose(77), "en", "s0")]
    return [(i, t, lang, s, len(t or ""), "k", 1, "g", 0) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
