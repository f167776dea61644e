import pathlib

import pytest
from pyspark.sql import DataFrame

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, word string, n string, token string, size int, label int, part int"


def make(spark, rows) -> DataFrame:
    """Documents with extra columns whose names clash with those that operators use inside."""
    full = [(i, t, lang, source, None if t is None else len(t), "w", "n", "t", 7, 1, 3) for i, t, lang, source in rows]
    return spark.createDataFrame(full, COLUMNS)


LONG = "the cat sat on a mat . " * 30_000 + "password = longlonglong1 mit license"
ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "en", "a"), (4, "Same text here. Same text here.", "en", "a"),
    (4, "Same text here. Same text here.", "en", "a"), (5, "Same text here. Same text here.", "fr", "b"), (6, LONG, "en", "b"),
    (None, "no id at all", "en", "a"), (7, "12345 !!! ???", "de", "c"), (8, "tie", "en", None), (9, "tie", "en", "z"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, ODD[:0])


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def with_tables(spark, tmp_path: pathlib.Path, **tables: DataFrame) -> str:
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)
