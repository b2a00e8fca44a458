import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, empty and long texts, copies, near copies, repeated rows, other alphabets."""
    base = [f"w{k % 37}x{k // 3} word{k}" for k in range(60)]
    near = [*base[:50], "other words", *base[51:]]
    rows = [(1, " ".join(base), "en", "src1", 0), (2, "  ".join(base), "en", "src2", 0), (3, " ".join(near), "en", "src1", 0),
            (4, None, None, None, None), (5, "", "en", "src1", 0), (6, " \t\n", "en", "src3", 0), (7, "a", "fr", "src9", 1),
            (7, "a", "fr", "src9", 1), (None, "lost id", "de", "src12", 7), (8, "Ωμέγα ключ 的 😂 <|endoftext|> don't", "xx", "other", 9),
            (9, "long text, again! " * 9000, "en", "src19", 1), (10, "x" * 50_000, "en", "src19", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_docs(edge_docs):
    """The same with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    names = "key name row rep node cell level part piece start length blob spans score label place raw blocks n sig tokens quota budget domain".split()
    return edge_docs.withColumns({c: F.lit("odd") for c in names})
