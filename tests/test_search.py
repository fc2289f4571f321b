"""Search through postings against a scan of all names."""

import pytest

from fieldhouse.operators import search

NAMES = ["Ann O'Hara", "ANNA", "an", "Jo", None, "", "100% Pure", "a_b_c", "Müller Ann", "ÄNNE", "Zanna Banana", "back\\slash ann", "anna", "ban ana"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search"))
    names = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)] + [(1, "ANNA"), (1, "Second name")], "id long, name string")
    search.build(names, path)
    return path, names


@pytest.mark.parametrize("q", ["ann", "ANNA", "an", "", "%", "n%b", "ann%ana", "a_n_na", "nna ban", "müller", "Änne", "100%", "zzz", "o'h", "back\\\\s", "_nna"])
def test_search_equals_a_scan(spark, index, q):
    path, names = index
    scan = names.selectExpr("cast(id as string) id", "name").filter(names["name"].isNotNull()).distinct()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(search.find(spark, path, q)) == rows(scan.filter(scan["name"].ilike(f"%{q}%")))


def test_search_reads_only_its_folders(spark, index):
    plan = search.find(spark, index[0], "hara")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters" in plan
