import os

from framewright.llm import store


def test_stored_tables_stay_until_cleared(spark):
    before = store.given()
    one, two = store.stored(spark.range(5), "one"), store.stored(spark.range(0), "two")
    paths = [p for p in store.given() if p not in before]
    assert one.count() == 5 and two.count() == 0 and two.columns == ["id"]
    assert all(p.startswith(spark.conf.get("spark.checkpoint.dir")) for p in paths)
    store.clear(spark, keep=[paths[0], *before])
    assert [os.path.exists(p) for p in paths] == [True, False] and paths[0] in store.given() and paths[1] not in store.given()
