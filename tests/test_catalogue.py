"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from quadrille.plans import catalogue
from quadrille.plans.derived import NAMES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: One of each family; the rest run with the driver.
SOME = ["q_select_cut", "q_loads", "q_frustum_cull", "q_topk_grant", "q_evict_overflow", "q_hold", "q_region_obb", "q_md5_index", "q_url_parse", "q_markers", "q_submesh", "q_tree_flatten", "q_3tz_roundtrip", "q_glb_decode", "q_entry_span", "q_index_lookup"]


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert [*map(str, rows(got))] == [*map(str, rows(want))]
