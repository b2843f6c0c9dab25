"""The llm queries that SQL can express, against their SQL; each operator has exactly one query."""

from types import SimpleNamespace

import pytest

from helixframe.llm import queries, storage
from tests.oracle import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert_same(spark, FOLDER, queries.queries()[name], queries.oracle_sql()[name])


def test_ownership_decides_on_a_table_that_the_sql_sees(spark, tmp_path):
    """A value of three sources is an example, one that one source repeats in 40 documents stays live."""
    key = lambda c: "ghp_" + c * 36
    rows = [(i, f"s{i % 3}", f"see {key('x')} here") for i in range(6)] + [(10 + i, "s1", f"x {key('y')} y {key('x')}") for i in range(40)]
    rows += [(60, None, f"{key('z')} token={key('z')}"), (61, "s2", key("z")), (62, "s9", None), (63, "s9", ""), (64, "s0", "password = hunter2hunter2")]
    folder = str(tmp_path)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df.coalesce(1).write.parquet(f"{folder}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    name = "op7_secret_scans"
    assert_same(spark, folder, queries.queries()[name], queries.oracle_sql()[name])
    got = {r["doc_id"]: r for r in queries.op7_secret_scans(spark, folder).collect()}
    assert got[0]["spans"] == "" and got[10]["spans"] == "token:2:42" and (got[10]["max_owners"], got[10]["max_repos"], got[10]["n_live"]) == (1, 40, 1)
    assert got[60]["n_assign"] == 1 and (got[60]["max_owners"], got[60]["max_repos"]) == (2, 2) and (got[62]["max_repos"], got[64]["max_repos"]) == (0, 1)


def test_names():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


def test_clear(spark):
    before = storage.live()
    kept = storage.written(spark.range(3), "probe")
    assert kept.count() == 3 and storage.clear(spark, but=before) == 1 and storage.live() == before


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(conf={}, sparkContext=context))
