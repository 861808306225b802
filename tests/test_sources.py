"""CSV reading, file order, staging and sinks."""

import pytest
from pyspark.sql import functions as F

from entitymill.sources import staging
from entitymill.sources import tables as src


def write(path, text):
    path.write_text(text)
    return str(path)


def test_missing_texts_and_types(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,n,x,s\n1,1,nan,NA\n2,,inf,b\n3,3,2.5,nan\n")
    df = src.read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "n": "double", "x": "double", "s": "string"}
    rows = df.orderBy("id").collect()
    assert [r.x for r in rows] == [None, float("inf"), 2.5]
    assert [r.s for r in rows] == [None, "b", None]
    assert [r.n for r in rows] == [1.0, None, 3.0]


def test_declared_schema_and_file_order(spark, tmp_path):
    lines = "\n".join(f"{(i * 37) % 1000},{i}" for i in range(1000))
    path = write(tmp_path / "b.csv", "id,pos\n" + lines + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = src.read_csv(spark, path, "id bigint, pos int", file_order=True)
        assert df.rdd.getNumPartitions() > 1
        rows = src.head_rows(df, [src.FILE_ORDER], 500).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.pos for r in rows] == list(range(500))
    assert src.head_rows(df, ["id"], None) is df


def test_staged_table_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).selectExpr("id", "id / 2 as `a.b`")

    path = str(tmp_path / "t")
    for _ in range(2):
        assert staging.staged(build, path, spark, {"rows": 5}).count() == 5
    assert len(calls) == 1
    staging.staged(build, path, spark, {"rows": 6})
    staging.staged(build, path, spark)
    staging.staged(build, path, spark)
    assert len(calls) == 4


def test_shared_dir_follows_the_session(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    assert staging.shared_dir(spark) == before
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        assert staging.shared_dir(spark).startswith(f"file:{tmp_path}")
        assert staging.cut_lineage(spark.range(3)).count() == 3
        assert any(tmp_path.iterdir())
    finally:
        spark.sparkContext._jsc.sc().setCheckpointDir(before.rsplit("/", 1)[0])


def test_further_columns_stay_and_malformed_cells_fail(spark, tmp_path):
    path = write(tmp_path / "c.csv", "id,x,note,n\n1,2.5,a,7\n2,oops,b,8\n3,NA,c,9\n")
    df = src.read_csv(spark, path, "id bigint, x double")
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "note": "string", "n": "bigint"}
    assert df.select("id", "note", "n").count() == 3
    with pytest.raises(Exception, match="no double: oops"):
        df.collect()
    blank = src.read_csv(spark, path, "id bigint, x double", malformed="blank").orderBy("id")
    assert [r.x for r in blank.collect()] == [2.5, None, None]
    with pytest.raises(ValueError, match="malformed"):
        src.read_csv(spark, path, malformed="drop")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.25, 1), (2, 0.5, 0)], "id int, prediction double, y int")
    src.write_submission(df, str(tmp_path / "sub"), "id")
    src.write_oof(df, str(tmp_path / "oof"), "id", "y")
    src.write_params(spark, {"b": 2, "a": 0.5}, str(tmp_path / "best"))
    assert src.read_csv(spark, str(tmp_path / "sub")).columns == ["id", "TARGET"]
    assert src.read_csv(spark, str(tmp_path / "oof")).columns == ["id", "y", "OOF_PRED"]
    best = src.read_csv(spark, str(tmp_path / "best")).first()
    assert (best.a, best.b) == (0.5, 2.0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_stages_join_without_an_exchange(spark, tmp_path):
    from entitymill.operators.attach import attach_all

    n = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = {"rows": 500}
        build = lambda i: lambda: spark.range(500).select("id", (F.col("id") * (i + 1)).alias(f"x.{i}"))
        frames = [staging.staged(build(i), str(tmp_path / f"t{i}"), spark, made, key="id") for i in range(6)]
        joined = attach_all(frames[0], frames[1:], "id")
        rows = {r["id"]: r for r in joined.collect()}
        assert rows[7].asDict() == {"id": 7, **{f"x.{i}": 7 * (i + 1) for i in range(6)}}
        assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
        # Another session knows nothing of the table, but finds what was written.
        name = [t.name for t in spark.catalog.listTables() if t.name.startswith("staged_")]
        for t in name:
            spark.sql(f"DROP TABLE {t}")
        again = [staging.staged(lambda: 1 / 0, str(tmp_path / f"t{i}"), spark, made, key="id") for i in range(6)]
        joined = attach_all(again[0], again[1:], "id")
        assert joined.count() == 500 and "Exchange" not in plan_of(joined.select("id", "`x.5`"))
        for t in name:
            spark.sql(f"DROP TABLE {t}")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", n)


def test_staged_deletes_what_was_written_on_the_way(spark, tmp_path):
    """Tables and shuffles of a build go with its end, those of a build beside it stay; so does what was written outside."""
    import threading
    from pathlib import Path

    before = spark.conf.get(staging.CLEANUP)
    folders, turn, other_done = {}, threading.Event(), threading.Event()

    def build(i):
        def rows():
            made = staging.written(spark.range(1000).repartition(3))
            folders[i] = Path(made.inputFiles()[0].removeprefix("file:")).parent
            assert spark.conf.get(staging.CLEANUP) == "true"
            if i == "slow":
                turn.set()
                assert other_done.wait(60) and spark.conf.get(staging.CLEANUP) == "true"
            if i == "broken":
                raise ValueError("no rows")
            return made.groupBy((F.col("id") % 7).alias("id")).count()

        return rows

    outside = staging.written(spark.range(5))
    slow = []
    beside = threading.Thread(target=lambda: slow.append(staging.staged(build("slow"), str(tmp_path / "slow"), spark)))
    beside.start()
    assert turn.wait(60)
    quick = staging.staged(build("quick"), str(tmp_path / "quick"), spark, key="id")
    assert folders["slow"].exists() and not folders["quick"].exists()
    other_done.set()
    beside.join()
    with pytest.raises(ValueError, match="no rows"):
        staging.staged(build("broken"), str(tmp_path / "broken"), spark)
    assert not any(f.exists() for f in folders.values()) and spark.conf.get(staging.CLEANUP) == before
    assert quick.count() == slow[0].count() == 7 and outside.count() == 5
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("staged_")]


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    import time

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString(" ").split() if "shuffle_" in f}
    before, left = files(), set()

    def build():
        df = staging.written(spark.range(5000).repartitionByRange(3, "id"))
        for _ in range(50):
            left.clear()
            left.update(files() - before)
            if not left:
                break
            time.sleep(0.2)
        return df

    assert staging.staged(build, str(tmp_path / "t"), spark, key="id").count() == 5000
    assert not left
