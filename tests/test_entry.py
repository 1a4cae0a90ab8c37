"""Every query with SQL gives what DuckDB gives, on the smallest tables; no text operator is needed."""

import os

import duckdb
import pytest

from driftloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A representative of each family of queries; the rest is compared by the driver.
NAMES = ["scan_batches", "shift_stream6", "batch_slice", "encode_full", "welford_merge", "concept_flip", "prior_shift", "holdout_split", "strata_quota", "drift_report", "metrics_classification", "prequential_linear"]


def rows(table):
    return sorted(tuple(None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in table)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got[columns].astype(object).values.tolist()) == rows(want[columns].astype(object).values.tolist())


def test_registry():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 85
