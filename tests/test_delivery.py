"""Snapshots, merges, SQL text, a real JDBC database, and a change stream."""

import duckdb
import pytest

from geoledger.plans.merge import duplicate_keys, merge_into, plan_merge, plan_snapshot
from geoledger.plans.sql_text import Delivery
from geoledger.sources.jdbc import CERTIFICATES, SslConfig, SyncManager, Target, requires_local_files
from geoledger.streaming import merge

TARGET = [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
FEED = [(1, "A", "delete"), (2, "B", "update"), (3, "C", None), (8, "h", "delete"), (9, "i", "insert"), (10, "j", None), (None, "m", "update")]
MERGED = [(2, "B"), (3, "c"), (9, "i"), (None, "m"), (None, "n")]


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(TARGET, "k int, x string"), spark.createDataFrame(FEED, "k int, x string, update_type string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge(tables):
    assert rows(plan_merge(*tables, ["k"])) == sorted(MERGED, key=str)
    with pytest.raises(ValueError):
        plan_merge(*tables, [])


def test_merge_with_other_columns(spark):
    target = spark.createDataFrame([(1, 2, "a", "own"), (3, 4, "b", "own")], "k int, j int, x string, extra string")
    feed = spark.createDataFrame([("u", 1, 2, "A"), ("u", 3, 9, "B")], "op string, k int, j int, x string")
    assert rows(plan_merge(target, feed, ["k", "j"], "op")) == [(1, 2, "A", "own"), (3, 4, "b", "own"), (3, 9, "B", None)]


def test_merge_of_empty_tables(tables):
    target, feed = tables
    assert rows(plan_merge(target, feed.limit(0), ["k"])) == sorted(TARGET, key=str)
    assert rows(plan_merge(target.limit(0), feed, ["k"])) == sorted([(2, "B"), (9, "i"), (None, "m")], key=str)


def test_snapshot_and_duplicates(tables):
    assert plan_snapshot(tables[1]).columns == ["k", "x", "update_type"] and plan_snapshot(tables[1], ["x", "k"]).columns == ["x", "k"]
    assert duplicate_keys(tables[1], ["k"]).count() == 0 and duplicate_keys(tables[1].union(tables[1]), ["k"]).count() == 6


def test_sql_text_runs():
    db = duckdb.connect()
    db.sql("create table t (k int, x varchar); create table s (k int, x varchar, update_type varchar)")
    db.executemany("insert into t values (?, ?)", TARGET)
    db.executemany("insert into s values (?, ?, ?)", FEED)
    text = Delivery("s", "t")
    db.sql(text.merge(["k", "x", "update_type"], ["k"]).replace('"update_type"', "update_type"))
    assert sorted(db.sql("select * from t").fetchall(), key=str) == sorted(MERGED, key=str)
    assert text.snapshot(["k", "x"]) == ["TRUNCATE TABLE t", 'INSERT INTO t ("k", "x") SELECT s."k", s."x" FROM s']
    assert 'ST_GeomFromWKB(s."g""1", 25833)' in Delivery("s", "t", srid=25833, geometry=['g"1']).snapshot(['g"1'])[1]
    assert "UPDATE" not in text.merge(["k", "update_type"], ["k"])


def test_certificates(tmp_path):
    with pytest.raises(RuntimeError, match="SYNC_SSL_CERT"):
        SslConfig.from_environment({"SYNC_SSL_CA": "x"})
    given = {v: str(tmp_path / v) for v in CERTIFICATES.values()}
    with pytest.raises(FileNotFoundError):
        SslConfig.from_environment(given)
    for p in given.values():
        open(p, "w").close()
    assert SslConfig.from_environment(given).options()["sslmode"] == "verify-ca"


def test_secrets_and_url():
    t = Target.from_secrets(lambda scope, key: f"{scope}-{key}", "sc", "host", "pw", dbname="d", user="u", staging_table="s", target_table="t")
    assert t.jdbc_url == "jdbc:postgresql://sc-host/d" and t.password == "sc-pw" and "sc-pw" not in repr(t)


@pytest.fixture
def derby(spark, tmp_path):
    target = Target("", "", "u", "p", "STG", "TGT", "UPDATE_TYPE", url=f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    manager = SyncManager(target, spark)
    manager._execute(['create table TGT ("K" int, "X" varchar(20), "UPDATE_TYPE" varchar(20))', 'create table STG ("K" int, "X" varchar(20), "UPDATE_TYPE" varchar(20))'])
    read = lambda: spark.read.format("jdbc").options(url=target.jdbc_url, dbtable="TGT", user="u", password="p", driver=target.driver).load()
    return manager, read


def test_sync_to_a_database(spark, derby):
    manager, read = derby
    first = spark.createDataFrame([(k, x, "insert") for k, x in TARGET], "K int, X string, UPDATE_TYPE string")
    manager.sync(first)
    assert rows(read()) == rows(first)
    feed = spark.createDataFrame([r for r in FEED if None not in (r[0], r[2])], "K int, X string, UPDATE_TYPE string")
    manager.sync(feed, "merge", ["K"])
    assert rows(read().select("K", "X")) == sorted([(2, "B"), (3, "c"), (9, "i"), (None, "n")], key=str)
    manager.sync(feed.limit(0))
    assert read().count() == 0


def test_arguments_are_checked_before_writing(spark, derby):
    manager, _ = derby
    feed = spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], "K int, X string, UPDATE_TYPE string")
    manager.write_staging = lambda df: pytest.fail("it wrote")
    for mode, keys in (("merge", None), ("merge", []), ("other", ["K"]), ("merge", ["K"])):
        with pytest.raises(ValueError):
            manager.sync(feed, mode, keys)


def test_repeated_keys_are_an_error(spark, tables):
    target, feed = tables
    with pytest.raises(Exception, match="more than once"):
        plan_merge(target, feed.union(feed.where("k = 2")), ["k"]).collect()
    nulls = feed.where("k is null")
    assert plan_merge(target, nulls.union(nulls), ["k"]).count() == 6  # null keys never match, so they never repeat


def test_merge_plan_leaves_null_keys_and_the_target_apart(spark, tables):
    """No full outer join; a small feed is broadcast, so the target isn't shuffled by key."""
    spark.range(20_000).selectExpr("cast(if(id % 2 = 0, null, id) as int) as k", "cast(id as string) as x").createOrReplaceTempView("wide_target")
    feed = spark.range(9_000).selectExpr("cast(if(id % 3 > 0, null, id) as int) as k", "'new' as x", "'update' as update_type")
    out = plan_merge(spark.table("wide_target"), feed, ["k"])
    assert out.count() == 10_000 + 10_000 + 6_000 + 1_500 and out.where("k is null").count() == 16_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_merge_into_reaches_the_table(spark, tables):
    spark.sql("drop table if exists plain_target")
    tables[0].write.saveAsTable("plain_target")
    with pytest.raises(Exception, match="(?i)merge"):  # the session's own tables take no row-level changes
        merge_into(tables[1], "plain_target", ["k"])
    with pytest.raises(ValueError):
        merge_into(tables[1], "plain_target", [])
    spark.sql("drop table plain_target")


def test_preflight(spark, derby):
    manager, _ = derby
    manager._preflight = requires_local_files("spark.geoledger.access")
    manager.write_staging = lambda df: pytest.fail("it wrote")
    spark.conf.set("spark.geoledger.access", "user_isolation")
    with pytest.raises(RuntimeError, match="spark.geoledger.access"):
        manager.sync(spark.range(1))
    spark.conf.unset("spark.geoledger.access")
    requires_local_files("spark.geoledger.access")(spark)


def test_a_change_stream(spark, tmp_path):
    path, changes = str(tmp_path / "target"), str(tmp_path / "changes")
    target = merge.Target(spark, path, ["k"], buckets=8, retain=2)
    target.create(spark.createDataFrame(TARGET, "k int, x string"))
    schema = "k int, x string, update_type string, at int"
    batches = [[(*r, 1) for r in FEED] + [(2, "late", "update", 2)], [(9, "j", "update", 1)], [(9, None, "delete", 2), (3, "C", "update", 2)]]
    check = str(tmp_path / "check")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(changes)
        query = merge.merge_stream(spark.readStream.schema(schema).parquet(changes), target, ["k"], "at").option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
    assert target.versions() == [2, 3]
    last = [(2, "late"), (3, "C"), (None, "m"), (None, "n")]
    assert rows(target.read()) == sorted(last, key=str) and rows(target.read(2)) == sorted([(2, "late"), (3, "c"), (9, "j"), (None, "m"), (None, "n")], key=str)
    written = [p for p in (tmp_path / "target" / "data" / "version=3").iterdir() if p.name.startswith("bucket=")]
    assert len(written) <= 2  # only the buckets of keys 9 and 3
    held = target._manifest(3)
    target.merge(spark.createDataFrame([(9, None, "delete"), (3, "C", "update")], "k int, x string, update_type string"), 2)  # a batch that runs again
    assert target._manifest(3) == held and rows(target.read()) == sorted(last, key=str)


def test_a_stream_target_that_becomes_empty(spark, tmp_path):
    target = merge.Target(spark, str(tmp_path / "t"), ["k"], buckets=2)
    target.create(spark.createDataFrame([(1, "a")], "k int, x string"))
    target.merge(spark.createDataFrame([(1, None, "delete")], "k int, x string, update_type string"), 0)
    assert target.read().count() == 0 and target.read(0).count() == 1
