import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))


@pytest.fixture(scope="session")
def hard_docs():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, "One two three four five six seven eight nine ten eleven.", "en", "a", 10),
        (1, "One two three four five six seven eight nine ten eleven.", "en", "a", 10),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (None, "No id here, but enough words to be kept by all of the rules.", "en", "b", 5),
        (4, LONG, "en", "b", len(LONG)),
        (5, LONG, "en", None, len(LONG)),
        (6, " \t\n ", "fr", "b", 4),
        (7, "été à l'école\n\nété à l'école\n日本語 🤦 ok", "fr", "c", 30),
        (8, "One two three four five six seven eight nine ten eleven.", "en", "c", 10),
    ]
    return [(*r, "x", 1, "y") for r in rows], DOCS + ", fp string, n_words int, root string"


@pytest.fixture(scope="session")
def save(tmp_path_factory, spark):
    """Write rows as documents.parquet of a new folder; returns the folder."""

    def write(rows, schema=DOCS, name="documents", folder=None):
        folder = folder or str(tmp_path_factory.mktemp("sf"))
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        return folder

    return write


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents as (doc_id, text)."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
