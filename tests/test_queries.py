"""Named queries against their SQL on the smallest tables."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"
# one of each kind; tools/check_queries.py runs all of them
NAMES = [
    "strongest_features", "blank_subtract", "comprehensive_filter", "impute_median", "align_features", "match_library_first",
    "distance_canberra", "spearman", "kruskal", "levene", "p_adjust", "multiclass_auc", "knn_classify", "threshold_clusters",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF).startswith("ok")


def test_every_query_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_no_cross_joins_or_local_checkpoints():
    for path in Path(entry.__file__).parent.joinpath("peakweave").rglob("*.py"):
        text = path.read_text()
        assert not re.search(r"crossJoin|localCheckpoint", text), path
