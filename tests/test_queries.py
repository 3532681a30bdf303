"""Every query against its SQL on the smallest tables, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, tmp_path, name):
    entry.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    duck.execute(f"create or replace table ours as select * from '{tmp_path}/out/*.parquet'")
    duck.execute(f"create or replace table theirs as {entry.oracle_sql()[name]}")
    kinds = [sorted((r[0], r[1]) for r in duck.execute(f"describe {t}").fetchall()) for t in ("ours", "theirs")]
    assert kinds[0] == kinds[1]
    columns = ", ".join(f'"{c}"' for c, _ in kinds[0])
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert duck.execute(f"select {columns} from {a} except all select {columns} from {b} limit 3").fetchall() == []
    assert duck.execute("select count(*) from ours").fetchall()[0][0] > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).collect()[0]["line"].startswith("Frame ")
