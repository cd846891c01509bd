"""Every query beside its SQL on the smallest tables."""

import math

import duckdb
import pytest

from skyframe.plans.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    rows = [tuple(map(norm, r)) for r in df.collect()]
    if name not in ORACLES:
        assert rows  # SQL can't split sources: test_detection does
        return
    found = duck.execute(ORACLES[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(rows) == sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall())


def test_whole_tables_are_computed(spark):
    """A row or more for each position, ordinal and tile, not for a subset."""
    positions, tiles = spark.read.parquet(f"{D}/orders.parquet").count(), spark.read.parquet(f"{D}/embeddings.parquet").count()
    for name, key in (("j4_extract_cutouts", ["idx"]), ("s5_cutout_pairs_roundtrip", ["idx"]), ("f23_cutout_wcs", ["y", "x"])):
        assert QUERIES[name](spark, D).select(*key).distinct().count() == positions
    assert sorted(r.ordinal for r in QUERIES["w1_number_rows_all"](spark, D).collect()) == list(range(tiles))
