"""Registered queries against their SQL form on the smallest sample."""

import os

import duckdb
import pytest

from cellweave.catalog import ORACLES, QUERIES
from tools.compare import TABLES, table

FOLDER = "/root/testdata/sf0.001"
#: One or two queries per area; set CELLWEAVE_ALL=1 (or run tools/compare.py) for all of them.
USUAL = {
    "a1_robust_normalize", "a12_woe_posterior", "a14_tile_overlap_mean", "a20_threshold_sweep", "a23_trace_correlation",
    "a30_success_rate_curve", "a32_doc_score", "a34_early_stop", "c10_fold_masks", "c1_to_utm43n", "f3_term_contexts",
    "g4_tilt_derivative", "j3_burn_lines", "j4_burn_category", "j5_buffer_label", "j6_regrid_bilinear", "s13_best_match_layer",
    "v1_patchify", "w1_distance_transform", "w5_stratified_sample_per_fold",
}
NAMES = sorted(ORACLES) if os.environ.get("CELLWEAVE_ALL") else sorted(USUAL)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    relation = db.sql(ORACLES[name])
    assert table([tuple(r) for r in df.collect()], df.columns) == table(relation.fetchall(), relation.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() == 1500
    assert set(oracle_sql()) <= set(queries())


def test_kernels_do_not_need_the_package_on_the_executors():
    from pyspark.cloudpickle import dumps

    from cellweave.operators.lines import filter_lines

    # A function pickled by reference would only name its module; by value it carries its code.
    assert len(dumps(filter_lines)) > 500
