import json

import pandas as pd
import pyarrow as pa
import pytest

from riskloom.sources import filters, remote
from riskloom.sources.load import discover_schema, load, schema_of, sniff
from riskloom.sources.sampling import exact_sample, stratified_sample

SCHEMA = schema_of({"segment": "string", "value": "double", "name": "string", "event_name": "string", "training_split": "string"})


@pytest.mark.parametrize(
    "text,clause",
    [
        ("segment in train,test", ("segment", "in", ("train", "test"))),
        ("segment not in ('a, b', c)", ("segment", "not in", ("a, b", "c"))),
        ("value > 0", ("value", ">", ("0",))),
        ("value >= 0", ("value", ">=", ("0",))),
        ("name is not null", ("name", "is not null", ())),
        ("name IS NULL", ("name", "is null", ())),
        ("segment != holdout", ("segment", "!=", ("holdout",))),
        ("segment == 'it''s'", ("segment", "==", ("it's",))),
        ("event_name == sign in", ("event_name", "==", ("sign in",))),
        ("name == 'a > b'", ("name", "==", ("a > b",))),
        ("training_split in train", ("training_split", "in", ("train",))),
    ],
)
def test_clauses(text, clause):
    got = filters.parse_clause(text, SCHEMA)
    assert (got.column, got.op, got.values) == clause


@pytest.mark.parametrize("text", ["segment", "gone == 1", "name is null x", "segment in ", "value >"])
def test_bad_clauses(text):
    with pytest.raises(ValueError):
        filters.parse_clause(text, SCHEMA)


def test_sql_of_clauses():
    sql = lambda t: filters.to_sql(filters.parse_clause(t, SCHEMA), SCHEMA)
    assert sql("segment in train,test") == "\"segment\" IN ('train', 'test')"
    assert sql("value > 0") == '"value" > 0'
    assert sql("value > 0; drop") == "\"value\" > '0; drop'"
    assert sql("segment == it's") == "\"segment\" = 'it''s'"


def test_filter_is_pushed_to_the_scan(spark, sf0):
    df = load(f"{sf0}/lineitem.parquet", where=["l_quantity >= 10"], exclude=["l_tax"], spark=spark).frame
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity" in plan
    assert "l_tax" not in df.columns


def test_files_and_frames(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;name\n1;a\n2;b,c\n;d\n")
    (tmp_path / "b.json").write_text(json.dumps([{"x": 1}, {"x": 2}], indent=1))
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "d.tsv").write_text("1\t2\n3\t4\n")
    assert [tuple(r) for r in load(tmp_path / "a.csv", spark=spark).frame.collect()] == [(1, "a"), (2, "b,c"), (None, "d")]
    assert load(tmp_path / "b.json", spark=spark).n_rows == load(tmp_path / "c.jsonl", spark=spark).n_rows == 2
    assert load(tmp_path / "d.tsv", spark=spark).n_rows == 2
    assert load(pd.DataFrame({"x": [1, 2]}), spark=spark).n_rows == load(pa.table({"x": [1, 2]}), spark=spark).n_rows == load({"x": [1, 2]}, spark=spark).n_rows
    assert discover_schema(str(tmp_path / "a.csv"), spark=spark).columns == [("x", "int", "numeric"), ("name", "string", "text")]
    with pytest.raises(FileNotFoundError):
        load(tmp_path / "none.csv", spark=spark)
    (tmp_path / "e.xml").write_text("")
    with pytest.raises(ValueError):
        load(tmp_path / "e.xml", spark=spark)
    with pytest.raises(TypeError):
        load(3, spark=spark)
    with pytest.raises(ValueError, match="x"):
        load({"x": [1]}, exclude=["y"], spark=spark)
    assert load({"x": [1], "y": [2]}, exclude=["y", "z"], ignore_missing_exclude=True, spark=spark).columns == ["x"]


def test_sniff():
    assert sniff(["a|b", "1|2"], ".txt") == ("|", True)
    assert sniff(["1,2", "3,4"], ".csv") == (",", False)
    assert sniff([], ".tsv") == ("\t", True)


def test_samples(spark):
    df = spark.range(1000).selectExpr("id % 10 as g", "id")
    one, two = exact_sample(df, 100), exact_sample(df.repartition(7), 100)
    assert one.count() == 100 and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    where = load(df, sample=50, where=["g == 3"], spark=spark)
    assert where.n_rows == 50 and where.whole.count() == 100
    assert {r.g: r["count"] for r in stratified_sample(df, "g", 100, 10).groupBy("g").count().collect()} == dict.fromkeys(range(10), 10)


def test_samples_keep_the_shares_of_equal_rows(spark):
    four = spark.range(20_000).selectExpr("case when id < 10000 then 0 when id < 16000 then 1 when id < 19000 then 2 end as a", "cast(id % 2 as int) as b", "array(1) as c").where("a = 0 or b = 1")
    shares = {(0, 0): 5000, (0, 1): 5000, (1, 1): 3000, (2, 1): 1500, (None, 1): 500}
    got = {(r.a, r.b): r["count"] for r in exact_sample(four, 3000).groupBy("a", "b").count().collect()}
    assert sum(got.values()) == 3000
    for k, n in shares.items():
        assert abs(got[k] - n / 5) < 110, (k, got)
    assert exact_sample(four, 3000).collect() == exact_sample(four.repartition(7), 3000).collect()
    by_class = {(r.a, r.b): r["count"] for r in stratified_sample(four.select("a", "b"), "b", 2000, 2).groupBy("a", "b").count().collect()}
    assert by_class[0, 0] == 1000 and abs(by_class[0, 1] - 500) < 80 and abs(by_class[1, 1] - 300) < 80 and abs(by_class[None, 1] - 50) < 40
    # Nulls in different places are different rows; a sample of all has every row.
    gaps = spark.createDataFrame([(1, None), (None, 1)] * 3, "x int, y int")
    assert sorted(map(repr, exact_sample(gaps, 10).collect())) == sorted(map(repr, gaps.collect()))


def test_remote_uris(monkeypatch):
    assert remote.parse_uri("data/a.csv") is None
    with pytest.raises(ValueError):
        remote.parse_uri("ftp://x/y")
    u = remote.parse_uri("postgres://me:secret@host:5433/db?table=a.b&table=c.d&x=1")
    assert u.qualified == "postgres://host:5433/db?table=c.d&x=1" and u.table() == "c.d"
    for k in remote._PG:
        monkeypatch.delenv(k, raising=False)
    o = remote.postgres_options(u, {"PGHOST": "other", "PGUSER": "me"})
    assert o["url"] == "jdbc:postgresql://host:5433/db" and o["user"] == "me" and "read_only" in o["sessionInitStatement"]
    with pytest.raises(ValueError):
        remote.postgres_options(remote.parse_uri("postgres://host?table=a"), {})
    with pytest.raises(ValueError):
        remote.parse_uri("postgres://h/d?table=a;drop").table()
    with pytest.raises(remote.MissingCredential, match="STAGE_SNOWFLAKE_ACCOUNT"):
        remote.credentials("snowflake", "STAGE")
    monkeypatch.setenv("STAGE_AWS_ACCESS_KEY_ID", "k")
    assert remote.credentials("s3", "STAGE") == {"AWS_ACCESS_KEY_ID": "k"}
    s3 = remote.parse_uri("s3://bucket/a.parquet")
    assert remote.object_store_path(s3) == "s3a://bucket/a.parquet" and remote.object_store_options(s3, {"AWS_ACCESS_KEY_ID": "k"}) == {}
    assert len(remote.object_store_options(s3, {"AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_ACCESS_KEY": "s"})) == 2
    assert remote.object_store_path(remote.parse_uri("gcs://b/x.csv")) == "gs://b/x.csv"
    assert remote.remote_query("t", ["a = 1"], 5) == "SELECT * FROM t WHERE (a = 1) LIMIT 5"
    assert remote.without_secrets("s3://u:p@b/x") == "s3://b/x" and remote.vendor_kind("NUMBER(10,2)") == "numeric"
    with pytest.warns(UserWarning):
        remote.warn_about_cost("bigquery", n_bytes=6 * 1024**3)
    assert remote.warn_about_cost("snowflake", rows=10**9, columns=100, limit=10) is None


def test_readers_never_write():
    import re
    from pathlib import Path

    for f in (Path(__file__).parents[1] / "riskloom" / "sources").glob("*.py"):
        assert not re.search(r"\.write\b|\.save\(|saveAsTable|\b(INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|MERGE)\s", f.read_text()), f


def test_mistyped_literal_is_an_error(spark):
    df = spark.sql("select date'2024-05-01' as d, true as b")
    assert df.where(filters.parse_filter("d >= 2024-01-01", df.schema)).count() == 1
    assert df.where(filters.parse_filter("b == true", df.schema)).count() == 1
    with pytest.raises(Exception, match="is no date"):
        df.where(filters.parse_filter("d >= 2024-13-45", df.schema)).count()


def test_catalogs_are_asked_for_sizes(spark, monkeypatch):
    b, f, p = (remote.parse_uri(x) for x in ("bigquery://proj/data.t", "snowflake://x/db.sales.orders", "postgres://h/d?table=a.b"))
    assert "`data.__TABLES__`" in remote.size_query(b) and "table_id = 't'" in remote.size_query(b)
    assert "db.information_schema.tables" in remote.size_query(f) and "table_schema = 'SALES'" in remote.size_query(f) and "'a.b'::regclass" in remote.size_query(p)
    asked = []

    def warehouse(session, uri, found):
        def run(sql):
            asked.append(sql)
            if "n_rows" in sql:
                return spark.createDataFrame([(10**9, 9 * 1024**3, 0)], "n_rows long, n_bytes long, n_pages long")
            return spark.createDataFrame([("a", "NUMBER(38,0)"), ("b", "VARCHAR")], "name string, type string")

        return run

    for k, v in (("SNOWFLAKE_ACCOUNT", "a"), ("SNOWFLAKE_USER", "u"), ("GOOGLE_APPLICATION_CREDENTIALS", "/none")):
        monkeypatch.setenv(k, v)
    monkeypatch.setattr(remote, "warehouse", warehouse)
    with pytest.warns(UserWarning, match="GiB"):
        assert remote.open_remote(spark, b, None, ["x = 1"], None)[1] and asked[-1].endswith("WHERE (x = 1)")
    with pytest.warns(UserWarning, match="cells"):
        remote.open_remote(spark, f)
    from riskloom.sources import load as loader

    monkeypatch.setattr(loader, "warehouse", warehouse)
    seen = discover_schema("snowflake://x/db.sales.orders", spark=spark)
    assert seen.columns == [("a", "NUMBER(38,0)", "numeric"), ("b", "VARCHAR", "text")] and seen.n_rows == 10**9
    assert not any("SELECT *" in q for q in asked[-2:])


def test_parts_of_a_postgres_table():
    assert remote.page_ranges(0) == ["true"] == remote.page_ranges(20_000)
    parts = remote.page_ranges(4 * remote.PAGES)
    assert len(parts) == 4 and parts[0] == "ctid < '(16384,0)'::tid" and parts[-1] == "ctid >= '(49152,0)'::tid"
    assert all(x.split(" AND ")[-1].split("'")[1] == y.split("'")[1] for x, y in zip(parts, parts[1:]))
    assert len(remote.page_ranges(10**9)) == remote.CONNECTIONS


def test_file_systems_by_uri(spark, tmp_path, sf0):
    for text in ("hdfs://nn:8020/a/b.parquet", "abfss://box@acc.dfs.core.windows.net/a.parquet", "file:///tmp/a.parquet"):
        assert remote.object_store_path(remote.parse_uri(text)) == text
    spark.range(5).write.parquet(str(tmp_path / "a.parquet"))
    assert load(f"file://{tmp_path}/a.parquet", spark=spark).n_rows == 5
    one = f"{sf0}/nation.parquet"
    assert discover_schema(one, spark=spark).n_rows == 25
