import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string"


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows, and an extra column, at rest as a table."""
    texts = [
        None, "", " \n\t", "one", "one two", "One TWO three", "a b c a b c a b c x", "x\x1cy\x85z \xa0 w", "ıİKß É é 漢字 🙂", "word " * 20000, "\n".join(["same line here"] * 30),
        "mail me: a.b@c.de, x@y or 1.2.3.4.5.6.7.8 and 256.1.1.1; +1 (988) 555-2485; 4111 1111 1111 1111", "GNU General Public License; the Apache License, CC BY-NC 4.0; MIT\nLicense mit license",
        "Anblewh sttible athawh thonre was is anly hend and, oftionnten. " * 9,
    ]
    rows = [(i, t, "en" if i % 3 else None, ["src1", None, "ß", "src10"][i % 4], len(t or ""), "r") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[9], (None, "One two THREE", "de", "src1", None, None), (5, "another text with the same id", None, None, 3, "q")]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def some_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
