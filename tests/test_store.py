from __future__ import annotations

import pytest

from landweave.sources.store import KeyConflict, ParquetStore, ReadOnly


@pytest.fixture
def store(spark, tmp_path):
    return ParquetStore(spark, str(tmp_path / "db"))


@pytest.fixture
def five(spark):
    return spark.createDataFrame([(i, n, v) for i, n, v in zip(range(1, 6), "abcde", (10.1, 20.2, 30.3, 40.4, 50.5))], "id int, name string, value double")


def test_a_file_is_no_store(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    with pytest.raises(FileExistsError):
        ParquetStore(spark, str(tmp_path / "f"))


def test_overwrite_fetch_counts(store, five, rows):
    assert store.row_count("t") == 0 and store.column_max("t", "id") == 0
    assert store.commit(five, "t") == 5
    assert store.list_tables() == ["t"]
    assert rows(store.fetch("t", ["name"], "value > 30")) == [("c",), ("d",), ("e",)]
    assert store.fetch("t", limit=2).count() == 2
    assert store.column_max("t", "value") == 50.5
    with pytest.raises(KeyError):
        store.fetch("absent")


def test_append_and_missing_columns(store, five, spark, rows):
    store.commit(five, "t")
    assert store.commit(spark.createDataFrame([(6, "f")], "id int, name string"), "t", "append") == 1
    assert rows(store.fetch("t", where="id = 6")) == [(6, "f", None)]
    store.commit(store.read("t"), "t", "append")  # from the table itself
    assert store.row_count("t") == 12


def test_partitioned_upsert_rewrites_touched_partitions(store, spark, rows):
    base = spark.createDataFrame([(1, "A", 1.0), (2, "A", 2.0), (3, "A", 3.0), (4, "B", 4.0), (5, "B", 5.0), (6, "B", 6.0)], "id int, grp string, value double")
    store.commit(base, "t", keys=["id", "grp"], partitions=["grp"])
    store.commit(spark.createDataFrame([(7, "A", 7.0), (8, "C", 8.0)], "id int, grp string, value double"), "t", "append", quiet=True)
    new = spark.createDataFrame([(1, "A", 99.9), (9, "B", 88.8)], "id int, grp string, value double")
    assert store.commit(new, "t", "upsert") == 8
    assert store.row_count("t") == 9
    assert store.commit(new, "t", "upsert") == 8  # again: nothing changes
    assert store.row_count("t") == 9
    assert rows(store.fetch("t", ["value"], "id in (1, 9)")) == [(88.8,), (99.9,)]


def test_alternate_keys(store, five, spark, rows):
    store.commit(five.where("id < 4"), "t", keys=["id"], alternate=["name"])
    with pytest.raises(KeyConflict):
        store.commit(spark.createDataFrame([(9, "a", 0.0)], "id int, name string, value double"), "t", "upsert")
    assert store.row_count("t") == 3
    store.commit(five.where("id >= 3"), "t", "upsert")
    assert [r[2] for r in rows(store.read("t"))] == [10.1, 20.2, 30.3, 40.4, 50.5]


def test_upsert_keeps_what_new_rows_lack(store, five, spark, rows):
    store.commit(five, "t", keys=["id"])
    store.commit(spark.createDataFrame([(1, 0.5), (7, 0.7)], "id int, value double"), "t", "upsert")
    assert rows(store.fetch("t", where="id in (1, 7)")) == [(1, "a", 0.5), (7, None, 0.7)]


def test_delete(store, five):
    store.commit(five, "t")
    assert store.delete_from("t", "id > 3 or case when id = 1 then null else false end") == 3  # a null condition goes too
    assert store.row_count("t") == 2
    assert store.delete_from("t") == 2 and not store.exists("t") and store.delete_from("t") == 0


def test_metadata(store, five):
    store.commit(five, "t", label="x", n=42, flag=True)
    assert {k: store.metadata("t")[k] for k in ("label", "n", "flag")} == {"label": "x", "n": 42, "flag": True}
    with pytest.warns(UserWarning, match="wins"):
        store.commit(five, "t", label="y")
    assert store.metadata("t")["label"] == "x"
    with pytest.warns(UserWarning, match="atomic"):
        store.commit(five, "u", what={"a": 1})


def test_read_only(store, five, spark):
    store.commit(five, "t")
    store.commit(five, "p", partitions=["name"])
    reading = ParquetStore(spark, store.path, read_only=True)
    for method in ("overwrite", "append", "upsert"):
        with pytest.raises(ReadOnly):
            reading.commit(five, "t", method)
    with pytest.raises(ReadOnly):
        reading.delete_from("t")
    assert reading.commit(five, "p", "append") == 5


def test_sql(store, five, rows):
    store.commit(five, "t")
    assert rows(store.query("select count(*) from t")) == [(5,)]


class _NoMoves:
    """A file system on which the move to a folder whose name ends so fails, quietly or loudly."""

    def __init__(self, fs, ending, loud=False):
        self._fs, self._ending, self._loud = fs, ending, loud

    def __getattr__(self, name):
        return getattr(self._fs, name)

    def rename(self, a, b):
        if b.getName().endswith(self._ending) and ".staged" in a.toString():
            if self._loud:
                raise OSError("no")
            return False
        return self._fs.rename(a, b)


@pytest.mark.parametrize("loud", [False, True])
def test_a_failed_move_leaves_the_table_as_it_was(store, five, spark, rows, loud):
    store.commit(five, "t", keys=["id"])
    store.commit(five, "p", keys=["id"], partitions=["name"])
    before = rows(store.read("t"))
    changed = spark.createDataFrame([(1, "a", 0.0), (2, "b", 0.0)], "id int, name string, value double")
    tries = [("t", lambda: store.commit(changed, "t", "upsert")), ("t", lambda: store.commit(changed, "t")), ("t", lambda: store.delete_from("t", "value > 20 and value < 21")), ("p", lambda: store.commit(changed, "p", "upsert"))]
    for name, change in tries:
        real, store._fs = store._fs, _NoMoves(store._fs, {"t": "t.parquet", "p": "name=b"}[name], loud)
        with pytest.raises(OSError):
            change()
        store._fs = real
        assert rows(store.read(name).select("id", "name", "value")) == before
    assert store.list_tables() == ["p", "t"] and not [s for s in store._fs.listStatus(store._at(store.path)) if s.getPath().getName().startswith(".")]


def test_an_upsert_computes_its_rows_once(store, five, spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    store.commit(five, "t", keys=["id"], partitions=["name"])
    store.commit(five.mapInPandas(count, five.schema), "t", "upsert")
    assert seen.value == 5


def test_delete_rewrites_only_partitions_that_lose_rows(store, spark, rows):
    d = spark.createDataFrame([(i, g, float(i)) for i, g in enumerate(["A", "A", "B", "B", None, "C/x"])], "id int, grp string, value double")
    store.commit(d, "t", keys=["id"], partitions=["grp"])
    files = lambda: {(f.getPath().getParent().getName(), f.getPath().getName()) for leaf in store._leaves(store.table_path("t"), 1) for f in store._fs.listStatus(store._at(f"{store.table_path('t')}/{leaf}"))}
    before = files()
    assert store.delete_from("t", "id in (0, 4, 5)") == 3
    assert rows(store.fetch("t", ["id", "grp"])) == [(1, "A"), (2, "B"), (3, "B")]
    assert {f for f in before if f[0] == "grp=B"} <= files() and {f[0] for f in files()} == {"grp=A", "grp=B"}
    assert store.delete_from("t", "id > 100") == 0


def test_maps(store, spark, rows):
    given = spark.createDataFrame([(1, (3, True, None))], "id int, params struct<level: int, on: boolean, note: string>")
    store.commit(given, "t", keys=["id"], maps=["params"])
    store.commit(spark.createDataFrame([(2, {"share": 0.5})], "id int, params map<string,double>"), "t", "upsert")
    store.commit(spark.createDataFrame([(3, [("a", "x"), ("b", "7")]), (4, None)], "id int, params array<struct<k: string, v: string>>"), "t", "upsert")
    assert dict(store.read("t").dtypes)["params"] == "map<string,string>"
    assert [(r["id"], r["params"]) for r in store.rows("t", in_order=True)] == [(1, {"level": 3, "on": True, "note": None}), (2, {"share": 0.5}), (3, {"a": "x", "b": 7}), (4, None)]
    with pytest.raises(TypeError):
        store.commit(spark.createDataFrame([(1, 2)], "id int, params int"), "u", maps=["params"])


def test_in_order_and_views(store, five):
    five.orderBy("value", ascending=False).createOrReplaceTempView("five_rows")
    store.commit("five_rows", "t", keys=["id"])
    assert [r["id"] for r in store.fetch("t", limit=3, in_order=True).collect()] == [1, 2, 3]
