import tempfile

import pytest

CLASH = ["id", "key", "node", "n", "score", "version", "doc", "kept", "token", "removed_lines", "kept_text", "component", "size", "_id", "text_sha256"]


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    """The tests' own shared folder, as none is named."""
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-tests-"))


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text[, lang]), with columns whose names the operators use themselves."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]), *["x"] * len(CLASH)) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make
