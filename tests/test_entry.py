"""The driver's contract on the smallest tables: every query runs and agrees with its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rasterloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    v = float(v)
    return "nan" if math.isnan(v) else round(v, 4) + 0.0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    expected = sorted((tuple(plain(r[result.columns.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark, duck):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "foreground"] and df.count() > 0


def test_the_library_stands_without_the_corpus_operators():
    top = os.path.dirname(os.path.dirname(catalog.__file__))
    for folder, _, files in os.walk(top):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "rasterloom.llm" not in f.read(), name
