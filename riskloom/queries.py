"""Named queries of the profiling operators over whole tables, each with the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import number
from .operators import association, columns, drift, ranks, roles, rules, target, temporal
from .plans.profile import profile_of_stats
from .sources import filters, sampling
from .sources.load import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Columns of the tables, by kind, so that the SQL can be written out for each.
TABLES = {
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag:s l_linestatus:s l_shipdate:t",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:t o_orderpriority:s",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "region": "r_regionkey:n r_name:s",
    "events": "event_id:n ts:t user_id:n event_type:s value:n props:s",
}
FIELDS = {t: [tuple(x.split(":")) for x in v.split()] for t, v in TABLES.items()}
KIND = {"n": "numeric", "s": "text", "t": "temporal"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a number of places; the two engines differ in the last digits of sums."""
    return df.select(*[(F.round(c, places) + F.lit(0.0) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def r(sql: str, places: int = 6) -> str:
    return f"(round({sql}, {places}) + 0.0)"


# ---- statistics of columns ----

STAT_DOUBLES = ("mean", "std", "min", "p25", "p50", "p75", "max", "skew")


def _summary_sql(t: str) -> str:
    parts = []
    for c, k in FIELDS[t]:
        x = f"{c}::double"
        doubles = {"mean": f"avg({x})", "std": f"stddev_samp({x})", "min": f"min({x})", "p25": f"quantile_cont({x}, 0.25)", "p50": f"quantile_cont({x}, 0.5)", "p75": f"quantile_cont({x}, 0.75)", "max": f"max({x})", "skew": f"skewness({x})"}
        figures = ", ".join(f"{r(e, 5) if k == 'n' else 'null::double'} as {n}" for n, e in doubles.items())
        parts.append(f"select '{c}' as name, '{KIND[k]}' as kind, count(*) as n, count(*) - count({c}) as n_null, count(distinct {c}) as n_unique, {figures} from {t}")
    return " union all ".join(parts)


def _summary(spark: SparkSession, df: DataFrame) -> DataFrame:
    frame = profile_of_stats(columns.column_stats(df)).columns_frame(spark)
    return frame.select("name", "kind", "n", "n_null", "n_unique", *STAT_DOUBLES)


for _t in TABLES:
    add(f"column_summary_{_t}", _summary_sql(_t))(lambda spark, sf, t=_t: rounded(_summary(spark, read(spark, sf, t)), 5))


def _outliers(spark: SparkSession, sf: str, t: str, names: list[str]) -> DataFrame:
    found = columns.column_stats(read(spark, sf, t).select(names), parts=frozenset({"quartiles", "bins"}))
    return spark.createDataFrame([(n, s.n_outliers_iqr or 0) for n, s in found.items()], "name string, n_outliers long")


for _t in ("lineitem", "orders", "customer", "events"):
    _n = [c for c, k in FIELDS[_t] if k == "n"]
    add(
        f"iqr_outliers_{_t}",
        " union all ".join(
            f"select '{c}' as name, count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as n_outliers from {_t}, (select quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.75) as q3 from {_t}) q"
            for c in _n
        ),
    )(lambda spark, sf, t=_t, n=_n: _outliers(spark, sf, t, n))


def _histogram(spark: SparkSession, sf: str, t: str, c: str) -> DataFrame:
    bins = columns.column_stats(read(spark, sf, t).select(c), parts=frozenset({"bins"}))[c].histogram
    return spark.createDataFrame([(i, n) for i, (_, _, n) in enumerate(bins)], "bin int, n long")


for _t, _c in (("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("orders", "o_totalprice"), ("events", "value")):
    add(
        f"histogram_{_t}_{_c}",
        f"with b as (select min({_c}) as lo, max({_c}) as hi from {_t}), h as (select greatest(0, least(23, floor(({_c} - lo) / ((hi - lo) / 24))))::int as bin, count(*) as n from {_t}, b group by 1) select g.bin::int as bin, coalesce(h.n, 0)::bigint as n from range(24) g(bin) left join h on h.bin = g.bin",
    )(lambda spark, sf, t=_t, c=_c: _histogram(spark, sf, t, c))


def _top(spark: SparkSession, sf: str, t: str) -> DataFrame:
    df = read(spark, sf, t)
    found = columns.column_stats(df.select([c for c, k in FIELDS[t] if k == "s"]), parts=frozenset({"values"}))
    return spark.createDataFrame([(c, v, n, i) for c, s in found.items() for i, (v, n) in enumerate(s.top_values, 1)], "name string, value string, n long, place int")


for _t in ("lineitem", "orders", "customer", "part", "events", "nation"):
    add(
        f"top_values_{_t}",
        " union all ".join(f"(select '{c}' as name, {c} as value, count(*) as n, (row_number() over (order by count(*) desc, {c}))::int as place from {_t} where {c} is not null group by {c} qualify place <= 10)" for c, k in FIELDS[_t] if k == "s"),
    )(lambda spark, sf, t=_t: _top(spark, sf, t))


@add("text_lengths", " union all ".join(f"select '{c}' as name, {r(f'avg(length({c}))')} as avg_len, max(length({c}))::int as max_len from {t}" for t, c in (("documents", "text"), ("part", "p_name"), ("events", "props"))))
def _lengths(spark, sf):
    found = [columns.column_stats(read(spark, sf, t).select(c), parts=frozenset())[c] for t, c in (("documents", "text"), ("part", "p_name"), ("events", "props"))]
    return rounded(spark.createDataFrame([(x.name, x.avg_len, x.max_len) for x in found], "name string, avg_len double, max_len int"))


def _buckets(df: DataFrame, c: str) -> DataFrame:
    return df.sparkSession.createDataFrame(columns.column_stats(df.select(c), parts=frozenset({"bins"}))[c].temporal_buckets, "label string, n long")


def _bucket_sql(t: str, c: str, unit: str, fmt: str, where: str = "") -> str:
    return f"select strftime(date_trunc('{unit}', {c}), '{fmt}') as label, count(*) as n from {t} {where} group by 1"


add("time_histogram_orders_year", _bucket_sql("orders", "o_orderdate", "year", "%Y"))(lambda s, sf: _buckets(read(s, sf, "orders"), "o_orderdate"))
add("time_histogram_orders_month", _bucket_sql("orders", "o_orderdate", "month", "%Y-%m", "where o_orderdate < timestamp '1998-01-01'"))(lambda s, sf: _buckets(read(s, sf, "orders").where("o_orderdate < timestamp_ntz '1998-01-01'"), "o_orderdate"))
add("time_histogram_events_day", _bucket_sql("events", "ts", "day", "%Y-%m-%d"))(lambda s, sf: _buckets(read(s, sf, "events"), "ts"))


@add("time_span", " union all ".join(f"select '{c}' as name, min({c})::varchar as ts_min, max({c})::varchar as ts_max, (floor(epoch(max({c}))) - floor(epoch(min({c}))))::bigint as span_seconds from {t}" for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))))
def _span(spark, sf):
    parts = [read(spark, sf, t).agg(F.min(c).cast("string").alias("ts_min"), F.max(c).cast("string").alias("ts_max"), (columns.seconds(F.max(c)) - columns.seconds(F.min(c))).alias("span_seconds")).select(F.lit(c).alias("name"), "ts_min", "ts_max", "span_seconds") for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return parts[0].unionByName(parts[1])


# ---- filters and samples ----


def _filtered(t: str, keep: str, *clauses: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = load(read(spark, sf, t), where=list(clauses), spark=spark).frame
        return rounded(df.groupBy(keep).agg(F.count(F.lit(1)).alias("n")))

    return run


for _name, _t, _keep, _clauses, _where in (
    ("in", "orders", "o_orderpriority", ["o_orderpriority in 1-URGENT,2-HIGH"], "o_orderpriority in ('1-URGENT', '2-HIGH')"),
    ("not_in", "orders", "o_orderstatus", ["o_orderstatus not in 'F'"], "o_orderstatus not in ('F')"),
    ("comparisons", "lineitem", "l_returnflag", ["l_quantity >= 10", "l_discount < 0.05", "l_linestatus != F"], "l_quantity >= 10 and l_discount < 0.05 and l_linestatus <> 'F'"),
    ("equal", "lineitem", "l_linestatus", ["l_returnflag == 'R'"], "l_returnflag = 'R'"),
    ("null", "events", "event_type", ["value is null"], "value is null"),
    ("not_null", "events", "event_type", ["value is not null", "value > 0"], "value is not null and value > 0"),
    ("time", "orders", "o_orderstatus", ["o_orderdate >= 1997-01-01"], "o_orderdate >= timestamp '1997-01-01'"),
):
    add(f"filter_{_name}", f"select {_keep}, count(*) as n from {_t} where {_where} group by {_keep}")(_filtered(_t, _keep, *_clauses))


@add("exclude_columns", "select * exclude (c_name, c_mktsegment) from customer")
def _exclude(spark, sf):
    return load(read(spark, sf, "customer"), exclude=["c_name", "c_mktsegment", "none"], ignore_missing_exclude=True, spark=spark).frame


@add("sample_size", "select least(1000, count(*))::bigint as n from lineitem")
def _sample(spark, sf):
    return sampling.exact_sample(read(spark, sf, "lineitem"), 1000).agg(F.count(F.lit(1)).alias("n"))


@add("sample_after_filter", "select least(500, count(*))::bigint as n, 'R' as l_returnflag from lineitem where l_returnflag = 'R'")
def _sample_filter(spark, sf):
    return load(read(spark, sf, "lineitem"), sample=500, where=["l_returnflag == R"], spark=spark).frame.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@add("stratified_sample", "select l_returnflag, least(count(*), 300)::bigint as n from lineitem where l_returnflag is not null group by 1")
def _stratified(spark, sf):
    return sampling.stratified_sample(read(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", 900, 3).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


# ---- association ----

_PAIR_TABLES = {t: [c for c, k in FIELDS[t] if k == "n"] for t in ("lineitem", "orders", "customer", "events", "part")}
for _t, _n in _PAIR_TABLES.items():
    add(
        f"pearson_{_t}",
        " union all ".join(f"select '{a}' as a, '{b}' as b, {r(f'case when isfinite(corr({a}::double, {b}::double)) then corr({a}::double, {b}::double) end')} as pearson from {_t}" for i, a in enumerate(_n) for b in _n[i + 1 :]),
    )(lambda spark, sf, t=_t, n=_n: rounded(association.pearson_pairs(read(spark, sf, t), n)))


def _mi_sql(t: str, a: str, b: str) -> str:
    return f"with t as (select {a} as x, {b} as y, count(*)::double as n from {t} group by 1, 2), m as (select n, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny, sum(n) over () as t from t), s as (select greatest(sum(n / t * ln(n * t / (nx * ny))), 0) as nats from m) select {r('nats')} as nats, {r('1 - exp(-2 * nats)')} as mutual_info from s"


def _class_pair(df: DataFrame) -> DataFrame:
    levels = df.select(*[F.col(c).cast("string") for c in df.columns])
    return rounded(association.class_information(levels, columns.column_stats(levels, parts=frozenset({"values"})), df.columns).select("nats", "mutual_info"))


for _t, _a, _b in (("lineitem", "l_returnflag", "l_linestatus"), ("orders", "o_orderstatus", "o_orderpriority"), ("customer", "c_mktsegment", "c_nationkey")):
    add(f"mutual_information_{_a}_{_b}", _mi_sql(_t, _a, _b))(lambda spark, sf, t=_t, a=_a, b=_b: _class_pair(read(spark, sf, t).select(a, b)))


@add("column_priority", " union all ".join(f"select '{c}' as name, {r(f'abs(corr({c}::double, l_extendedprice::double))')} as strength from lineitem" for c in _PAIR_TABLES["lineitem"] if c != "l_extendedprice"))
def _priority(spark, sf):
    df = read(spark, sf, "lineitem")
    found = association.strengths(df, columns.column_stats(df, parts=frozenset()), "l_extendedprice")
    return rounded(spark.createDataFrame(list(found.items()), "name string, strength double"))


# ---- ranks ----


def _rank_sql(t: str, x: str, y: str) -> str:
    rank = lambda c: f"(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0)"
    return f"with p as (select ({x})::double as x, ({y})::double as y from {t} where ({x}) is not null and ({y}) is not null), q as (select {rank('x')} as a, {rank('y')} as b from p) select count(*) as n, {r('corr(a, b)')} as rho from q"


for _name, _t, _x, _y in (("price_quantity", "lineitem", "l_extendedprice", "l_quantity"), ("discount_tax", "lineitem", "l_discount", "l_tax"), ("total_customer", "orders", "o_totalprice", "o_custkey")):
    add(f"spearman_{_name}", _rank_sql(_t, _x, _y))(lambda spark, sf, t=_t, x=_x, y=_y: rounded(ranks.rank_correlations(read(spark, sf, t), [number(x)], number(y)).drop("c")))

add("monotonicity_event_id", _rank_sql("events", "event_id", "floor(epoch(ts))").replace("corr(a, b)", "abs(corr(a, b))"))(lambda spark, sf: rounded(ranks.rank_correlations(read(spark, sf, "events"), [number("event_id")], columns.seconds(F.col("ts"))).select("n", F.abs("rho").alias("rho"))))


def _auc_sql(t: str, x: str, p: str) -> str:
    return f"with s as (select ({x})::double as v, ({p})::int as p from {t} where ({x}) is not null), k as (select p, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as rk from s), z as (select sum(p)::double as np, (count(*) - sum(p))::double as nn, sum(rk * p) as rs from k) select np::bigint as n_pos, nn::bigint as n_neg, {r('(rs - np * (np + 1) / 2) / (np * nn)')} as auc, {r('2 * abs((rs - np * (np + 1) / 2) / (np * nn) - 0.5)')} as lift from z"


add("auc_event_value", _auc_sql("events", "value", "event_type = 'click'"))(lambda spark, sf: rounded(ranks.auc_of(ranks.sided(read(spark, sf, "events"), [number("value")], F.col("event_type") == "click")).drop("c")))
add("auc_quantity_returned", _auc_sql("lineitem", "l_quantity", "l_returnflag = 'R'"))(lambda spark, sf: rounded(ranks.auc_of(ranks.sided(read(spark, sf, "lineitem"), [number("l_quantity")], F.col("l_returnflag") == "R")).drop("c")))


def _late(df: DataFrame, time: str):
    return temporal.is_late(time, temporal.late_cut(df, time))


_SPLIT = "with s as (select *, row_number() over (order by {t}) as rn, count(*) over () as m from {f}), c as (select min({t}) as cut from s where rn > floor(0.7 * m)), p as (select *, {t} >= (select cut from c) as late from s)"


@add("ks_event_value", _SPLIT.format(t="ts", f="events") + f", u as (select value as v, count(*) filter (where not late)::double as a, count(*) filter (where late)::double as b from p where value is not null group by 1), w as (select sum(a) over (order by v) / sum(a) over () as fa, sum(b) over (order by v) / sum(b) over () as fb, sum(a) over () as na, sum(b) over () as nb from u) select max(na)::bigint as n_a, max(nb)::bigint as n_b, {r('max(abs(fa - fb))')} as ks from w")
def _ks(spark, sf):
    df = read(spark, sf, "events")
    return rounded(ranks.ks_of(ranks.sided(df, [number("value")], _late(df, "ts"))).drop("c"))


@add("total_variation_event_type", _SPLIT.format(t="ts", f="events") + f", u as (select event_type as v, count(*) filter (where not late)::double as a, count(*) filter (where late)::double as b from p where event_type is not null group by 1), w as (select abs(a / sum(a) over () - b / sum(b) over ()) as gap from u) select count(*) as levels, {r('sum(gap) / 2')} as tv from w")
def _tv(spark, sf):
    df = read(spark, sf, "events")
    return rounded(ranks.total_variations(df, [F.col("event_type")], _late(df, "ts")).select("levels", "tv"))


# ---- target ----


@add("target_classes", "select 'quality' as target, quality::varchar as value, count(*) as n from labels where quality is not null group by 2 union all select 'toxic', toxic::varchar, count(*) from labels where toxic is not null group by 2")
def _classes(spark, sf):
    df = read(spark, sf, "labels")
    stats = columns.column_stats(df, parts=frozenset({"values"}))
    rows = [(t, v, n) for t in ("quality", "toxic") for v, n in target.summarise(df, stats, t).classes]
    return spark.createDataFrame(rows, "target string, value string, n long")


@add("target_rate", f"select max(toxic)::varchar as positive, count(*) filter (where toxic = 1) as n_positive, {r('avg(toxic::double)')} as rate from labels")
def _rate(spark, sf):
    df = read(spark, sf, "labels")
    s = target.summarise(df, columns.column_stats(df, parts=frozenset({"values"})), "toxic")
    return rounded(spark.createDataFrame([(s.positive, s.positive_count, s.positive_rate)], "positive string, n_positive long, rate double"))


@add(
    "target_summary",
    " union all ".join(
        f"select '{c}' as target, 'classification' as task, count(*) as n, count(*) - count({c}) as n_missing, count(distinct {c}) as n_classes, case when count(distinct {c}) = 2 then max({c})::varchar end as positive, "
        f"case when count(distinct {c}) = 2 then (select count(*) from {t} where {c} = (select max({c}) from {t})) end as n_positive, "
        f"{r(f'case when count(distinct {c}) = 2 then (select count(*) from {t} where {c} = (select max({c}) from {t}))::double / count({c}) end')} as rate, {'null::double' if k == 's' else r(f'avg({c}::double)')} as mean from {t}"
        for t, c, k in (("labels", "quality", "n"), ("labels", "toxic", "n"), ("lineitem", "l_linestatus", "s"), ("lineitem", "l_returnflag", "s"))
    )
    + f" union all select 'o_totalprice', 'regression', count(*), count(*) - count(o_totalprice), 0, null, null, null, {r('avg(o_totalprice::double)', 3)} from orders",
)
def _target_summary(spark, sf):
    rows = []
    for t, c in (("labels", "quality"), ("labels", "toxic"), ("lineitem", "l_linestatus"), ("lineitem", "l_returnflag"), ("orders", "o_totalprice")):
        df = read(spark, sf, t).select(c)
        s = target.summarise(df, columns.column_stats(df, parts=frozenset({"values"})), c)
        rows.append((c, s.task, s.n, s.n_missing, len(s.classes), s.positive, s.positive_count, s.positive_rate, None if s.mean is None else round(s.mean, 3 if s.task == "regression" else 6)))
    return rounded(spark.createDataFrame(rows, "target string, task string, n long, n_missing long, n_classes long, positive string, n_positive long, rate double, mean double"))


# ---- time ----


@add(
    "time_deciles_events",
    f"with s as (select ts, value, row_number() over (order by ts) - 1 as k, count(*) over () as m from events), b as (select *, (case when k < (m % 10) * (m // 10 + 1) then k // (m // 10 + 1) else (m % 10) + (k - (m % 10) * (m // 10 + 1)) // (m // 10) end)::int as bucket from s) select bucket, min(ts) as low, max(ts) as high, count(*) as n_rows, count(value) as n_target, {r('avg(value)')} as value from b group by bucket",
)
def _deciles(spark, sf):
    got = temporal.bucket_frame(read(spark, sf, "events"), "ts", number("value"))
    return rounded(got.select("bucket", F.col("low").cast("timestamp_ntz").alias("low"), F.col("high").cast("timestamp_ntz").alias("high"), "n_rows", F.coalesce("n_target", F.lit(0)).alias("n_target"), "value"))


@add("time_values_orders", f"select date_trunc('year', o_orderdate) as t, count(*) as n_rows, count(o_totalprice) as n_target, {r('avg(o_totalprice)', 4)} as value from orders group by 1")
def _values(spark, sf):
    df = read(spark, sf, "orders").withColumn("year", F.date_trunc("year", F.col("o_orderdate")))
    got = temporal.exact_buckets(df, "year", number("o_totalprice"))
    return rounded(got.select(F.col("t").cast("timestamp_ntz").alias("t"), "n_rows", "n_target", "value"), 4)


def _drift_sql(t: str, time: str, numbers: list[str], texts: list[str]) -> str:
    """(feature, drift, monotonicity, unique share) between the first 70 % in time and the rest; a relation named drift."""
    parts = []
    for c in numbers:
        side = f"(select {c}::double as v, count(*) filter (where not late)::double as a, count(*) filter (where late)::double as b from p where {c} is not null group by 1)"
        steps = f"(select abs(sum(a) over (order by v) / sum(a) over () - sum(b) over (order by v) / sum(b) over ()) as gap, a, b from {side})"
        rank = lambda x: f"(rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0)"
        rho = f"(select abs(corr(x, y)) from (select {rank(c)} as x, {rank(time)} as y from p where {c} is not null))"
        parts.append(f"select '{c}' as feature, (select case when sum(a) >= 30 and sum(b) >= 30 then max(gap) end from {steps}) as drift, {rho} as monotonicity, (select count(distinct {c}) / count({c})::double from {t}) as u")
    for c in texts:
        side = f"(select {c} as v, count(*) filter (where not late)::double as a, count(*) filter (where late)::double as b from p where {c} is not null group by 1)"
        gap = f"(select abs(a / sum(a) over () - b / sum(b) over ()) as gap, a, b from {side})"
        parts.append(f"select '{c}', (select case when sum(a) >= 30 and sum(b) >= 30 and count(*) <= 100 then sum(gap) / 2 end from {gap}), null::double, (select count(distinct {c}) / count({c})::double from {t})")
    split = f"s as (select *, rank() over (order by {time}) - 1 as before, count(*) over () as m from {t} where {time} is not null), c as (select coalesce(min({time}) filter (where before >= floor(0.7 * m)), max({time})) as cut from s), p as (select *, {time} >= (select cut from c) as late from s)"
    return f"with {split}, drift as ({' union all '.join(parts)})"


_TIMED = {"events": ("ts", ["event_id", "user_id", "value"], ["event_type"]), "orders": ("o_orderdate", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])}


def _drift(spark: SparkSession, sf: str, t: str) -> DataFrame:
    time, numbers, texts = _TIMED[t]
    df = read(spark, sf, t)
    # Of the statistics only kinds are asked for.
    stats = columns.column_stats(df, parts=frozenset())
    return rounded(temporal.drift_frame(df, stats, [*numbers, *texts], time, temporal.late_cut(df, time)).select("feature", "drift", "monotonicity"))


for _t, (_time, _n, _c) in _TIMED.items():
    add(f"temporal_drift_{_t}", f"{_drift_sql(_t, _time, _n, _c)} select feature, {r('drift')} as drift, {r('monotonicity')} as monotonicity from drift")(lambda spark, sf, t=_t: _drift(spark, sf, t))

_LADDER = "case when drift >= 0.5 then 'info' when monotonicity >= 0.95 and u >= 0.9 then 'warning' else 'none' end as severity, case when drift >= 0.5 then 'strong_drift' when monotonicity >= 0.95 and u >= 0.9 then 'monotonic' else 'none' end as leakage_kind"
#: Features made of orders that climb the rungs without a target: shifted in time, in its order, and neither.
CLIMBING = [("moved", "n", "case when o_orderdate < timestamp_ntz '1997-06-01' then o_orderkey % 10 else o_orderkey % 10 + 8 end"), ("still", "n", "o_orderkey % 7"), ("level", "s", "o_orderstatus"), ("turned", "s", "case when o_orderdate < timestamp_ntz '1997-06-01' then 'early' else 'late' end"), ("stamp", "t", "o_orderdate")]


def _climbing(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, _, e in CLIMBING])


_CLIMB = f"made as (select {', '.join(f'{e} as {n}'.replace('timestamp_ntz', 'timestamp') for n, _, e in CLIMBING)} from orders)"
_CLIMB_SQL = _drift_sql("made", "stamp", ["moved", "still"], ["level", "turned"]).replace("with ", f"with {_CLIMB}, ", 1)


@add("time_ladder", f"{_CLIMB_SQL} select feature, {_LADDER}, {r('drift')} as drift from drift")
def _ladder(spark, sf):
    df = _climbing(spark, sf)
    report = temporal.temporal_report(df, columns.column_stats(df), "stamp", None)
    return rounded(spark.createDataFrame([(s.feature, s.severity, s.leakage_kind, s.drift) for s in report.signals], "feature string, severity string, leakage_kind string, drift double"))


@add("findings_temporal", f"{_CLIMB_SQL}, rungs as (select *, {_LADDER} from drift) select feature, case when coalesce(monotonicity, 0) >= 0.95 then 'time_monotonic' when drift >= 0.3 then 'feature_drift' else 'temporal_anomaly' end as kind, severity, 'temporal' as category, {r('drift')} as score from rungs where severity <> 'none' union all select 'stamp', 'temporal_skipped', 'info', 'temporal', 0.0")
def _temporal_findings(spark, sf):
    df = _climbing(spark, sf)
    alone = df.select("stamp")
    found = rules.temporal_findings(temporal.temporal_report(df, columns.column_stats(df), "stamp", None), None)
    found += rules.temporal_findings(temporal.temporal_report(alone, columns.column_stats(alone), "stamp", None), None)
    return rounded(spark.createDataFrame([(f.columns[0], f.kind, f.severity, f.category, float(f.score)) for f in found], "feature string, kind string, severity string, category string, score double"))


#: Targets made of events whose share or mean moves through time or doesn't: name, whether classes, expression.
MOVING = [("steady", True, "cast(event_id % 2 as varchar(5))"), ("turning", True, "case when event_id % 10 < 3 or ts >= timestamp_ntz '2024-01-20' then 'y' else 'n' end"), ("three", True, "case when ts >= timestamp_ntz '2024-01-20' and event_id % 2 = 0 then 'c' when event_id % 3 = 0 then 'b' else 'a' end"), ("level", False, "value + 1000"), ("signed", False, "value - 10")]


def _target_drift_sql(name: str, classes: bool, e: str) -> str:
    rows = f"(select ({e}) as y, ntile(10) over (order by ts) as part from events where ({e}) is not null)".replace("timestamp_ntz", "timestamp")
    if classes:
        share = f"(select y, part, n, sum(n) over (partition by part)::double as m from (select y, part, count(*) as n from {rows} group by 1, 2))"
        grid = f"(select l.y, g.part, coalesce(n / m, 0) as s from (select distinct y from {rows}) l cross join range(1, 11) g(part) left join {share} x on x.y = l.y and x.part = g.part)"
        return f"select '{name}' as target, case when count(*) = 2 then 'binary' else 'multiclass' end as kind, {r('max(hi - lo)')} as score from (select y, max(s) as hi, min(s) as lo from {grid} group by y)"
    mean = f"(select avg(y::double) as m from {rows} group by part)"
    ratio = "greatest(abs(min(m)), abs(max(m))) / least(abs(min(m)), abs(max(m)))"
    scale = f"(select quantile_cont(y::double, 0.75) - quantile_cont(y::double, 0.25) from {rows})"
    return f"select '{name}', case when min(m) > 0 or max(m) < 0 then 'regression_ratio' else 'regression_diff' end, {r(f'case when min(m) > 0 or max(m) < 0 then {ratio} else (max(m) - min(m)) / {scale} end', 5)} from {mean}"


@add("target_drift_events", " union all ".join(_target_drift_sql(*m) for m in MOVING))
def _target_drift(spark, sf):
    df = read(spark, sf, "events").select("ts", *[F.expr(e).alias(n) for n, _, e in MOVING])
    rows = [(n, *temporal.target_drift(df, "ts", n, classes)) for n, classes, _ in MOVING]
    return rounded(spark.createDataFrame([(n, k, None if x is None else round(x, 6 if k in ("binary", "multiclass") else 5)) for n, k, x in rows], "target string, kind string, score double"))


#: A target of orders that status tells in part, and features of so few levels that a tree of depth four names the commonest class of each.
_TOLD = "case when o_orderstatus = 'F' and o_orderkey % 4 > 0 then 'y' when o_orderkey % 5 = 0 then 'y' else 'n' end"


def _time_power_sql(c: str) -> str:
    rows = f"(select {c} as x, {_TOLD} as y, late from p)"
    said = f"(select x, arg_max(y, (n, -ascii(y))) as said from (select x, y, count(*) as n from {rows} where not late group by 1, 2) group by x)"
    judged = f"(select r.y, t.said from {rows} r join {said} t on t.x = r.x where late)"
    f1 = f"(select sum(2.0 * hit / (n + m) * n) / sum(n) from (select k, count(*) filter (where y = k) as n, count(*) filter (where said = k) as m, count(*) filter (where y = k and said = k) as hit from {judged}, (select unnest(['n', 'y']) as k) group by k))"
    major = f"(select y from {rows} where not late group by y order by count(*) desc, y limit 1)"
    naive = f"(select 2.0 * n / (n + m) * n / m from (select count(*) filter (where y = {major})::double as n, count(*)::double as m from {rows} where late))"
    return f"select '{c}' as feature, {r(f'greatest(0, ({f1} - {naive}) / (1 - {naive} + 1e-9))')} as pps_time"


@add("time_power_orders", _drift_sql("orders", "o_orderdate", [], ["o_orderstatus", "o_orderpriority"]) + " " + " union all ".join(_time_power_sql(c) for c in ("o_orderstatus", "o_orderpriority")))
def _time_power(spark, sf):
    df = read(spark, sf, "orders").select("o_orderdate", "o_orderstatus", "o_orderpriority", F.expr(_TOLD).alias("told"))
    return rounded(temporal.temporal_figures(df, columns.column_stats(df, parts=frozenset({"values"})), "o_orderdate", "told").select("feature", "pps_time"))


# ---- rules, roles, comparison ----


ID_NAME = "(lower(name) = 'id' or lower(name) like '%\\_id' escape '\\' or lower(name) like '%uuid%')"


def _rule_sql(t: str, fields: list[tuple[str, str]], target: str | None = None) -> str:
    """Every rule on a column, from its statistics in a relation t."""
    per = []
    for c, k in fields:
        x = f"{c}::double"
        number = f"skewness({x}) as skew, min({x}) as low, max({x}) as high, (select count(*) from {t}, (select quantile_cont({x}, 0.25) as q1, quantile_cont({x}, 0.75) as q3 from {t}) q where q3 > q1 and ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1))) as far"
        other = "null::double as skew, null::double as low, null::double as high, 0 as far"
        lead = f"(select list({c} order by n desc, {c}) from (select {c}, count(*) as n from {t} where {c} is not null group by {c} order by n desc, {c} limit 10))" if k == "s" else "null::varchar[]"
        per.append(
            f"select '{c}' as name, '{KIND[k]}' as kind, count(*) as n, count({c}) as present, count(distinct {c}) as n_unique, {number if k == 'n' else other}, "
            f"coalesce((select max(n) from (select count(*) as n from {t} where {c} is not null group by {c})), 0) as most, {lead} as lead, {f'avg(length({c}))' if k == 's' else '0'} as avg_len from {t}"
        )
    marks = ", ".join(f"'{m}'" for m in sorted(rules.SENTINELS))
    feature = f"name <> '{target}'" if target else "true"
    held = [
        ("nulls >= 1", "all_null", "'critical'", "quality", "1.0"),
        (f"lone and nulls < 1 and {feature}", "constant", "'warning'", "suspicious", "1.0"),
        (f"varied and {feature} and kind <> 'temporal' and most / present::double > 0.99", "near_constant", "'warning'", "suspicious", "most / present::double"),
        ("varied and nulls > 0.5", "high_nulls", "case when nulls > 0.9 then 'critical' else 'warning' end", "quality", "nulls"),
        ("varied and nulls > 0.1 and nulls <= 0.5", "some_nulls", "'info'", "quality", "nulls"),
        (f"varied and n_unique = present and present > 50 and {ID_NAME}", "identifier_shape", "'warning'", "suspicious", "0.9"),
        (f"varied and {feature} and kind = 'numeric' and abs(skew) > 3", "heavy_skew", "'info'", "distribution", "least(abs(skew) / 10, 1.0)"),
        (f"varied and {feature} and kind = 'numeric' and far / present::double > 0.01", "outliers", "'info'", "distribution", "far / present::double"),
        (f"varied and {feature} and kind = 'numeric' and n_unique <= 2 and low in (0, 1) and high in (0, 1)", "bool_as_int", "'info'", "quality", "0.4"),
        (f"varied and kind = 'text' and len(list_filter(lead, lambda v: v in ({marks}))) > 0", "encoded_nulls", f"case when lead[1] in ({marks}) then 'warning' else 'info' end", "quality", f"case when lead[1] in ({marks}) then 0.85 else 0.6 end"),
        ("varied and kind = 'text' and n_unique > 0.5 * present and n_unique > 50", "high_cardinality_text", "'info'", "suspicious", "0.7"),
        (f"varied and {feature} and kind = 'text' and avg_len > 32 and n_unique / present::double > 0.8", "free_text", "'info'", "suspicious", "0.6"),
        (f"varied and {feature} and kind = 'text' and len(list_filter(lead, lambda v: regexp_matches(trim(v), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}})'))) >= 0.8 * len(lead)", "date_as_string", "'warning'", "quality", "0.75"),
    ]
    if target:
        held.append((f"varied and {feature} and kind = 'text' and n_unique > 0.3 * present and n_unique > 30", "high_cardinality_cat", "'warning'", "quality", "0.6"))
    head = f"s as ({' union all '.join(per)}), p as (select *, 1 - present / nullif(n::double, 0) as nulls, n_unique <= 1 as lone from s), v as (select *, not lone and nulls < 1 as varied from p) "
    return head + " union all ".join(f"select name, '{k}' as kind, {sev} as severity, '{cat}' as category, {r(f'({score})::double')} as score from v where {test}" for test, k, sev, cat, score in held)


def _findings(df: DataFrame, target: str | None = None) -> DataFrame:
    found = rules.column_findings(columns.column_stats(df), target)
    rows = [(f.columns[0], f.kind, f.severity, f.category, float(f.score)) for f in found]
    return rounded(df.sparkSession.createDataFrame(rows, "name string, kind string, severity string, category string, score double"))


for _t in TABLES:
    add(f"findings_{_t}", "with " + _rule_sql(_t, FIELDS[_t]))(lambda spark, sf, t=_t: _findings(read(spark, sf, t)))

#: Columns made of orders so that each rule has something to find: name, kind, expression of both engines.
TRAPS = [
    ("order_id", "n", "o_orderkey"),
    ("empty", "n", "nullif(o_orderkey, o_orderkey)"),
    ("rare", "n", "case when o_orderkey % 20 = 0 then o_totalprice end"),
    ("sparse", "n", "case when o_orderkey % 10 < 3 then o_totalprice end"),
    ("gaps", "n", "case when o_orderkey % 5 <> 0 then o_totalprice end"),
    ("single", "s", "nullif('a', o_orderstatus)"),
    ("mostly", "s", "case when o_orderkey % 200 = 0 then 'x' else 'y' end"),
    ("flag", "n", "case when o_orderkey % 7 = 0 then 1 else 0 end"),
    ("burst", "n", "o_totalprice * case when o_orderkey % 50 = 0 then 1000.0 else 1.0 end"),
    ("status", "s", "case when o_orderkey % 4 = 0 then 'N/A' else o_orderstatus end"),
    ("unknown", "s", "case when o_orderkey % 4 <> 0 then '?' else o_orderpriority end"),
    ("day", "s", "substring(cast(o_orderdate as varchar(30)), 1, 10)"),
    ("note", "s", "concat('order with a rather long description, number ', cast(o_orderkey as varchar(20)))"),
    ("buyer", "s", "concat('c', cast(o_custkey as varchar(20)), o_orderstatus, o_orderpriority)"),
    ("placed", "t", "o_orderdate"),
    ("label", "s", "o_orderstatus"),
]


def traps(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, _, e in TRAPS])


for _name, _target in (("traps", None), ("traps_with_target", "label")):
    add(
        f"findings_{_name}",
        f"with made as (select {', '.join(f'{e} as {n}' for n, _, e in TRAPS)} from orders), " + _rule_sql("made", [(n, k) for n, k, _ in TRAPS], _target),
    )(lambda spark, sf, target=_target: _findings(traps(spark, sf), target))


#: Targets made of orders, so that each rule on a target has something to find.
AIMS = [("one", "case when o_orderkey > 0 then 'a' end"), ("rare", "case when o_orderkey % 200 = 0 then 'y' else 'n' end"), ("even", "case when o_orderkey % 2 = 0 then 'y' else 'n' end"), ("few", "case when o_orderkey in (1, 2, 3, 4, 5, 6, 7) then 'z' else o_orderstatus end"), ("gone", "case when o_orderkey % 5 <> 0 then case when o_orderkey % 2 = 0 then 'y' else 'n' end end"), ("holes", "case when o_orderkey % 50 <> 0 then o_orderstatus end")]


def _aim_sql(name: str, e: str) -> str:
    of = f"(select {e} as y from orders)"
    size = f"(select count(*) as total, count(y) as n, count(distinct y) as k, coalesce(sum(case when y = m then 1 else 0 end), 0) as pos from {of}, (select max(y) as m from {of}))"
    least = f"(select min(n) from (select count(*) as n from {of} where y is not null group by y))"
    rules_ = [
        ("k <= 1", "target_single_class", "'critical'", "1.0"),
        ("k = 2", "target_imbalance", "case when pos < 100 or pos / n::double < 0.01 then 'warning' else 'info' end", "least(1.0, 1 - pos / n::double)"),
        (f"k > 2 and {least} < 30", "target_low_support", "'warning'", "0.8"),
        ("k > 1 and total > n", "target_missing_labels", "case when 1 - n / total::double > 0.1 then 'warning' else 'info' end", "1 - n / total::double"),
    ]
    return " union all ".join(f"select '{name}' as target, '{kind}' as kind, {severity} as severity, {r(f'({score})::double')} as score from {size} where {test}" for test, kind, severity, score in rules_)


@add("findings_target", " union all ".join(_aim_sql(*a) for a in AIMS))
def _aims(spark, sf):
    df = read(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in AIMS])
    stats = columns.column_stats(df, parts=frozenset({"values"}))
    found = [(n, f.kind, f.severity, float(f.score)) for n, _ in AIMS for f in rules.target_findings(target.summarise(df, stats, n))]
    return rounded(spark.createDataFrame(found, "target string, kind string, severity string, score double"))


#: Columns made of lineitem that go with each other closely, loosely, and by class alone.
CLOSE = [("price", "n", "l_extendedprice"), ("doubled", "n", "l_extendedprice * 2 + 1"), ("near", "n", "l_extendedprice + l_quantity * 700"), ("apart", "n", "l_discount"), ("flag", "s", "l_returnflag"), ("named", "s", "concat('is ', l_returnflag)"), ("status", "s", "l_linestatus")]


def _close_sql() -> str:
    numbers, texts = [[n for n, k, _ in CLOSE if k == kind] for kind in "ns"]
    pairs = [f"select '{a}' as a, '{b}' as b, corr({a}::double, {b}::double) as pearson, null::double as info from made" for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            cells = f"(select n, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny, sum(n) over () as t from (select {a} as x, {b} as y, count(*)::double as n from made group by 1, 2))"
            pairs.append(f"select '{a}', '{b}', null, (select 1 - exp(-2 * greatest(sum(n / t * ln(n * t / (nx * ny))), 0)) from {cells})")
    score = "greatest(abs(coalesce(pearson, 0)), coalesce(info, 0))"
    kind = f"case when abs(pearson) > 0.95 then 'multicollinearity' when info - abs(coalesce(pearson, 0)) > 0.15 then 'nonlinear_association' when {score} >= 0.8 then 'strong_association' end"
    return f"with made as (select {', '.join(f'{e} as {n}' for n, _, e in CLOSE)} from lineitem), pairs as ({' union all '.join(pairs)}), found as (select a, b, {kind} as kind, {score} as score from pairs where {score} >= 0.7) select a, b, kind, case when kind = 'multicollinearity' then 'warning' else 'info' end as severity, {r('score')} as score from found where kind is not null"


@add("findings_pairs", _close_sql())
def _close(spark, sf):
    df = read(spark, sf, "lineitem").select(*[F.expr(e).alias(n) for n, _, e in CLOSE])
    found = []
    for kind in "ns":
        part = df.select([n for n, k, _ in CLOSE if k == kind])
        found += rules.pair_findings(association.correlation_pairs(part, columns.column_stats(part, parts=frozenset({"values"})), kind == "s"))
    return rounded(spark.createDataFrame([(*f.columns, f.kind, f.severity, float(f.score)) for f in found], "a string, b string, kind string, severity string, score double"))


def _plan_sql(fields: list[tuple[str, str]], target_: str) -> str:
    """Actions on the columns of a relation made: what findings ask for, then what gaps and levels ask for."""
    stats = " union all ".join(
        f"select '{c}' as name, '{KIND[k]}' as kind, count(*) as n, count({c}) as present, count(distinct {c}) as n_unique, {f'skewness({c}::double)' if k == 'n' else 'null::double'} as skew, {f'min({c}::double)' if k == 'n' else 'null::double'} as low from made" for c, k in fields
    )
    return (
        f"_found as (select f.*, s.skew, s.low, s.kind as of from ({'select * from _rules'}) f join _stats s on s.name = f.name where f.name <> '{target_}'), "
        "_dropped as (select distinct name from _found where kind in ('all_null', 'constant', 'near_constant', 'identifier_shape') or (category = 'quality' and severity = 'critical')), "
        f"_left as (select * from _stats where name <> '{target_}' and name not in (select name from _dropped)) "
        "select 'drop' as bucket, name as \"column\", 'drop' as action from _dropped "
        "union all select distinct 'transform', name, case when of = 'numeric' and abs(skew) > 3 then case when low >= 0 then 'log1p' else 'yeo_johnson' end else 'robust_scaler' end from _found where category = 'distribution' "
        "union all select distinct 'review', name, 'replace_sentinel_with_null' from _found where kind = 'encoded_nulls' "
        "union all select 'impute', name, case when kind = 'numeric' and n_unique > 2 then 'median' else 'mode' end from _left where present between 1 and n - 1 and kind in ('numeric', 'text', 'bool') "
        "union all select 'review', name, 'impute_manually' from _left where present between 1 and n - 1 and kind not in ('numeric', 'text', 'bool') "
        "union all select 'encode', name, case when n_unique <= 2 then 'ordinal' when n_unique <= 20 then 'onehot' else 'target_oof' end from _left where kind = 'text' and n_unique >= 1 and (n_unique <= 20 or n_unique <= 0.5 * present)",
        stats,
    )


def _action_sql() -> str:
    tail, stats = _plan_sql([(n, k) for n, k, _ in TRAPS], "label")
    found = _rule_sql("made", [(n, k) for n, k, _ in TRAPS], "label")
    made = ", ".join(f"{e} as {n}" for n, _, e in TRAPS)
    return f"with made as (select {made} from orders), _rules as (with {found}), _stats as ({stats}), {tail}"


@add("action_rules", _action_sql())
def _actions(spark, sf):
    from .plans.actions import build_action_plan

    plan = build_action_plan(profile_of_stats(columns.column_stats(traps(spark, sf)), "label"))
    return spark.createDataFrame([(i["bucket"], i["column"], i["action"]) for i in plan.records()], "bucket string, column string, action string")


@add(
    "plan_split",
    "select 'temporal' as split, 'time_series' as cv, 'o_orderdate' as \"on\", 'class_weight' as classes from orders having count(*) > 0 union all select 'stratified', 'stratified_kfold', 'l_returnflag', null from lineitem having count(*) > 0 union all select 'random', 'kfold', null, null from part having count(*) > 0",
)
def _split(spark, sf):
    from .plans.actions import build_action_plan
    from .plans.profile import Profile

    rows = []
    for t, aim, time in (("orders", "rare", "o_orderdate"), ("lineitem", "l_returnflag", None), ("part", "p_retailprice", None)):
        df = read(spark, sf, t)
        df = df.select(time, F.expr(dict(AIMS)["rare"]).alias("rare")) if t == "orders" else df.select(aim)
        stats = columns.column_stats(df, parts=frozenset({"values"}))
        report = temporal.temporal_report(df, stats, time, aim) if time else None
        plan = build_action_plan(Profile(t, 0, len(stats), stats, target=aim, time_column=time, target_summary=target.summarise(df, stats, aim), temporal=report))
        rows.append((plan.split.kind, plan.cv.kind, plan.split.time_column or plan.split.stratify_on, plan.class_strategy.kind if plan.class_strategy else None))
    return spark.createDataFrame(rows, "split string, cv string, on string, classes string")


def _roles(spark: SparkSession, df: DataFrame) -> DataFrame:
    found = columns.column_stats(df, parts=frozenset({"values"}))
    out = set(roles.infer_excludes(found))
    return spark.createDataFrame([(n, ",".join(roles.hints(x)), n in out) for n, x in found.items()], "name string, hints string, exclude boolean")


def _roles_sql(summary: str) -> str:
    labels = (
        "case when idn then 'identifier' end, case when kind = 'numeric' and n_unique <= 2 then 'boolean' end, case when kind = 'text' and n_unique between 2 and 20 then 'low-card categorical' end, "
        "case when kind = 'numeric' and n_unique between 3 and 20 then 'ordinal candidate target' end, case when kind = 'temporal' then 'time column candidate' end, case when n_null >= 0.5 * n then 'high-null' end"
    )
    return (
        f"with s as ({summary}), p as (select *, n - n_null as present, n_unique / nullif((n - n_null)::double, 0) as u, {ID_NAME} as idn from s) "
        f"select name, concat_ws(',', {labels}) as hints, coalesce(present > 50 and ((idn and u >= 0.95) or (kind = 'text' and u >= 0.8 and n_unique > 100)), false) as exclude from p"
    )


add("roles_events", _roles_sql(_summary_sql("events")))(lambda spark, sf: _roles(spark, read(spark, sf, "events")))
_TRAP_COUNTS = " union all ".join(f"select '{n}' as name, '{KIND[k]}' as kind, count(*) as n, count(*) - count({n}) as n_null, count(distinct {n}) as n_unique from made" for n, k, _ in TRAPS)
add("roles_traps", _roles_sql(f"with made as (select {', '.join(f'{e} as {n}' for n, _, e in TRAPS)} from orders) {_TRAP_COUNTS}"))(lambda spark, sf: _roles(spark, traps(spark, sf)))

#: Columns made of orders, of which target and time are guessed: by a name, a prefix with two values, an affix; the only time, or the one that is called so.
GUESSED = {
    "named": (["o_orderkey % 3 as label", "o_orderkey % 2 as is_even", "o_orderdate as placed"], "label", "placed"),
    "flagged": (["o_orderkey % 3 as is_third", "o_orderkey % 2 as has_two", "o_orderdate as placed", "o_orderdate as created_at"], "has_two", "created_at"),
    "affixed": (["o_orderkey % 2 as is_even", "o_orderkey % 5 as target_five", "o_orderdate as a", "o_orderdate as b"], "target_five", None),
}


def _guess_sql(frame: str, made: list[str], aim: str, time: str | None) -> str:
    when = f"case when count(distinct {time}) >= 10 then '{time}' end" if time else "null"
    return f"select '{frame}' as frame, case when count(distinct {aim}) > 1 then '{aim}' end as target, {when} as time from (select {', '.join(made)} from orders)"


@add("inferred_roles", " union all ".join(_guess_sql(k, *v) for k, v in GUESSED.items()))
def _guessed(spark, sf):
    rows = []
    for k, (made, _, _) in GUESSED.items():
        found = columns.column_stats(read(spark, sf, "orders").selectExpr(*made), parts=frozenset({"values"}))
        rows.append((k, roles.infer_target(found), roles.infer_time(found)))
    return spark.createDataFrame(rows, "frame string, target string, time string")


_SHAPE = "select substr(column_name, 3) as name, case when column_type in ('VARCHAR') then 'text' when column_type like 'TIMESTAMP%' or column_type = 'DATE' then 'temporal' else 'numeric' end as kind from (describe {})"


@add("schema_diff", f"with a as ({_SHAPE.format('orders')}), b as ({_SHAPE.format('lineitem')}) select coalesce(a.name, b.name) as name, case when a.name is null then 'added' when b.name is null then 'removed' when a.kind <> b.kind then 'type_changed' else 'shared' end as change from a full join b on a.name = b.name")
def _schema(spark, sf):
    def shape(t: str):
        df = read(spark, sf, t)
        return profile_of_stats(columns.column_stats(df.toDF(*[c.split("_", 1)[1] for c in df.columns]), parts=frozenset()))

    d = drift.compare_profiles(shape("orders"), shape("lineitem")).schema
    typed = [n for n, *_ in d.type_changed]
    rows = [(n, "added") for n in d.added] + [(n, "removed") for n in d.removed] + [(n, "type_changed" if n in typed else "shared") for n in d.shared]
    return spark.createDataFrame(rows, "name string, change string")


@add(
    "binned_drift_orders",
    "with l as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders), h as (select greatest(0, least(23, floor((o_totalprice - lo) / ((hi - lo) / 24))))::int as v, count(*) filter (where o_orderdate < timestamp '1998-01-01')::double as a, count(*) filter (where o_orderdate >= timestamp '1998-01-01')::double as b from orders, l group by 1), g as (select i as v, coalesce(a, 0) / sum(a) over () as p, coalesce(b, 0) / sum(b) over () as q from range(24) t(i) left join h on h.v = i), e as (select v, abs(sum(p) over (order by v) - sum(q) over (order by v)) as gap, (p + 1/24.0::double) / 2 as sp, (q + 1/24.0::double) / 2 as sq from g) "
    f"select {r('max(gap)')} as ks, {r('sum((sq - sp) * ln(sq / sp))')} as psi, {r('sum(gap) filter (where v < 23) * ((select hi - lo from l) / 24)', 3)} as wasserstein from e",
)
def _binned(spark, sf):
    df = read(spark, sf, "orders")
    low, high = df.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    got = drift.binned_drift_frame(df, number("o_totalprice"), F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), low, high, columns.BINS)
    return got.select(F.round("ks", 6).alias("ks"), F.round("psi", 6).alias("psi"), F.round("wasserstein", 3).alias("wasserstein"))


@add(
    "categorical_drift_events",
    f"with s as (select event_type as v, ts >= (select min(ts) + (max(ts) - min(ts)) / 2 from events) as late from events), c as (select v, count(*) filter (where not late)::double as a, count(*) filter (where late)::double as b from s where v is not null group by 1), t as (select *, sum(a) over () as ta, sum(b) over () as tb from c), p as (select *, a / ta as p, b / tb as q, (a / ta + b / tb) / 2 as m, ta * (a + b) / (ta + tb) as ea, tb * (a + b) / (ta + tb) as eb from t) select {r('sum(case when p > 0 then p * ln(p / m) else 0 end + case when q > 0 then q * ln(q / m) else 0 end) / 2')} as js, {r('sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb)')} as chi2, count(*) as levels from p",
)
def _categorical(spark, sf):
    df = read(spark, sf, "events")
    low, high = df.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    late = F.unix_micros(F.col("ts").cast("timestamp")) >= F.lit(low + (high - low) // 2)
    a, b = (profile_of_stats(columns.column_stats(df.where(side).select("event_type"), parts=frozenset({"values"}))) for side in (~late, late))
    d = drift.compare_profiles(a, b).features[0]
    levels = len({v for p in (a, b) for v, _ in p.columns["event_type"].top_values})
    return rounded(spark.createDataFrame([(d.js, d.chi2, levels)], "js double, chi2 double, levels long"))


def _binned_sql(c: str, table: str = "orders", late: str = "o_orderdate >= timestamp '1997-01-01'", show: str = "") -> str:
    """KS, PSI and Wasserstein of a column of two sides from 24 bins each, put on the grid of both; show: what else to select."""
    return (
        f"with sides as (select {c}::double as x, {late} as late from {table} where {c} is not null), "
        "range_of as (select late, min(x) as lo, max(x) as hi from sides group by late), "
        "bins as (select s.late, greatest(0, least(23, floor((x - lo) / ((hi - lo) / 24))))::int as b, any_value(lo) as lo, any_value(hi) as hi, count(*)::double as n from sides s join range_of r on r.late = s.late group by 1, 2), "
        "grid as (select i as g, min(lo) + i * (max(hi) - min(lo)) / 24 as low, min(lo) + (i + 1) * (max(hi) - min(lo)) / 24 as high from range_of, range(24) t(i) group by i), "
        "mass as (select g, late, sum(n * greatest(0, least(high, lo + (b + 1) * (hi - lo) / 24) - greatest(low, lo + b * (hi - lo) / 24)) / ((hi - lo) / 24)) as m from grid, bins group by 1, 2), "
        "shares as (select g, sum(m) filter (where not late) / (select sum(m) from mass where not late) as p, sum(m) filter (where late) / (select sum(m) from mass where late) as q from mass group by g), "
        "steps as (select *, abs(sum(p) over (order by g) - sum(q) over (order by g)) as gap, (p + 1 / 24::double) / 2 as sp, (q + 1 / 24::double) / 2 as sq from shares) "
        f"select '{c}' as name, {r('max(gap)')} as ks, {r('sum((sq - sp) * ln(sq / sp))')} as psi, {r('sum(gap) filter (where g < 23) * (select any_value(high - low) from grid)', 2)} as wasserstein, null::double as js, null::double as chi2{show} from steps"
    )


def _levels_sql(c: str) -> str:
    return (
        f"with c as (select {c} as v, count(*) filter (where o_orderdate < timestamp '1997-01-01')::double as a, count(*) filter (where o_orderdate >= timestamp '1997-01-01')::double as b from orders where {c} is not null group by 1), "
        "t as (select *, sum(a) over () as ta, sum(b) over () as tb from c), p as (select *, a / ta as p, b / tb as q, (a / ta + b / tb) / 2 as m, ta * (a + b) / (ta + tb) as ea, tb * (a + b) / (ta + tb) as eb from t) "
        f"select '{c}' as name, null::double as ks, null::double as psi, null::double as wasserstein, {r('sum(case when p > 0 then p * ln(p / m) else 0 end + case when q > 0 then q * ln(q / m) else 0 end) / 2')} as js, {r('sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb)', 4)} as chi2 from p"
    )


@add("compare_orders", " union all ".join(f"select * from ({_binned_sql(c)})" for c in ("o_totalprice", "o_custkey")) + " union all " + " union all ".join(f"select * from ({_levels_sql(c)})" for c in ("o_orderstatus", "o_orderpriority")))
def _compare(spark, sf):
    df = read(spark, sf, "orders")
    late = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    a, b = (profile_of_stats(columns.column_stats(df.where(side).select("o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"))) for side in (~late, late))
    rows = [(d.name, d.ks, d.psi, d.wasserstein, d.js, d.chi2) for d in drift.compare_profiles(a, b).features]
    got = spark.createDataFrame(rows, "name string, ks double, psi double, wasserstein double, js double, chi2 double")
    return rounded(got.select("name", "ks", "psi", F.round("wasserstein", 2).alias("wasserstein"), "js", F.round("chi2", 4).alias("chi2")))


#: A column of lineitem and the degrees of freedom of its table of two rows; an even number has a closed form.
_TESTED = (("l_returnflag", 2), ("l_linenumber", 6), ("l_linestatus", 1))


def _chi_sql(c: str, dof: int) -> str:
    cells = f"(select {c}::varchar as v, count(*) filter (where l_orderkey % 2 = 0)::double as a, count(*) filter (where l_orderkey % 2 = 1)::double as b from lineitem where {c} is not null group by 1)"
    expected = f"(select a, b, sum(a) over () * (a + b) / (sum(a) over () + sum(b) over ()) as ea, sum(b) over () * (a + b) / (sum(a) over () + sum(b) over ()) as eb from {cells})"
    part = (lambda x, e: f"greatest(abs({x} - {e}) - 0.5, 0) ** 2 / {e}") if dof == 1 else lambda x, e: f"({x} - {e}) ** 2 / {e}"
    p = "null::double" if dof == 1 else "exp(-x / 2) * (" + " + ".join(f"(x / 2) ** {k} / {math.factorial(k)}" for k in range(dof // 2)) + ")"
    return f"select '{c}' as name, {r('x')} as statistic, {r(p)} as p from (select sum({part('a', 'ea')} + {part('b', 'eb')}) as x from {expected})"


def _ks_sql(c: str) -> str:
    inner = _binned_sql(c, "lineitem", "l_orderkey % 2 = 1", ", max(gap) as d, (select count(*) filter (where not late) * count(*) filter (where late) / count(*)::double from sides) as n")
    z = "(d * (sqrt(round(n)) + 0.12 + 0.11 / sqrt(round(n))))"
    series = f"least(1, greatest(0, 2 * list_sum([(-1) ** (i - 1) * exp(-2 * i * i * z * z) for i in range(1, 101)])))"
    return f"select name, {r('d')} as statistic, {r(series)} as p from (select name, d, {z} as z from ({inner}))"


@add("compare_p_values_lineitem", " union all ".join([_chi_sql(*t) for t in _TESTED] + [f"select * from ({_ks_sql(c)})" for c in ("l_extendedprice", "l_quantity")]))
def _p_values(spark, sf):
    names = [c for c, _ in _TESTED]
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", *[F.col(c).cast("string").alias(c) for c in names])
    a, b = (profile_of_stats(columns.column_stats(df.where(f"l_orderkey % 2 = {k}").drop("l_orderkey"))) for k in (0, 1))
    found = {d.name: d for d in drift.compare_profiles(a, b).features}
    rows = [(c, found[c].chi2, found[c].chi2_p if dof > 1 else None) for c, dof in _TESTED] + [(c, found[c].ks, found[c].ks_p) for c in ("l_extendedprice", "l_quantity")]
    return rounded(spark.createDataFrame(rows, "name string, statistic double, p double"))


def _delta_sql(name: str) -> str:
    e = dict(AIMS).get(name, name)
    side = f"(select {e} as y, o_orderdate >= timestamp '1997-01-01' as late from orders)"
    if name == "o_totalprice":
        a, b = (f"avg(y::double) filter (where {k}late)" for k in ("not ", ""))
        return f"select '{name}' as target, 'regression' as kind, {r(a, 3)} as before, {r(b, 3)} as after, {r(f'{b} - {a}', 3)} as delta from {side}"
    if name == "o_orderstatus":
        share = f"(select y, count(*) filter (where not late) / (select count(y) from {side} where not late)::double as p, count(*) filter (where late) / (select count(y) from {side} where late)::double as q from {side} where y is not null group by y)"
        return f"select '{name}', 'multiclass', null, null, {r('max(abs(p - q))')} from {share}"
    a, b = (f"avg((y = 'y')::int) filter (where {k}late)" for k in ("not ", ""))
    return f"select '{name}', 'binary', {r(a)}, {r(b)}, {r(f'{b} - {a}')} from {side}"


_DELTAS = ("rare", "even", "o_orderstatus", "o_totalprice")


@add("target_delta_orders", " union all ".join(f"select * from ({_delta_sql(n)})" for n in reversed(_DELTAS)))
def _delta(spark, sf):
    from .plans.profile import Profile

    rows = []
    for name in _DELTAS:
        df = read(spark, sf, "orders").select(F.expr(dict(AIMS).get(name, name)).alias(name), (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("_late"))
        sides = []
        for part in (df.where("not _late").drop("_late"), df.where("_late").drop("_late")):
            stats = columns.column_stats(part, parts=frozenset({"values"}))
            sides.append(Profile("", 0, 1, stats, target=name, target_summary=target.summarise(part, stats, name)))
        d = drift.compare_profiles(*sides).target
        rows.append((name, d.kind, d.before, d.after, d.delta))
    return spark.createDataFrame(rows, "target string, kind string, before double, after double, delta double").select("target", "kind", *[(F.when(F.col("kind") == "regression", F.round(c, 3)).otherwise(F.round(c, 6)) + F.lit(0.0)).alias(c) for c in ("before", "after", "delta")])


#: Two versions of orders: name, kind, expression before and after (None: the column isn't there).
VERSIONS = [
    ("same", "n", "o_totalprice", "o_totalprice"),
    ("shifted", "n", "o_totalprice", "o_totalprice + 1000000"),
    ("holes", "s", "o_orderpriority", "case when o_orderkey % 5 > 0 then o_orderpriority end"),
    ("swapped", "s", "o_orderstatus", "case when o_orderstatus = 'F' then 'O' else 'F' end"),
    ("gone", "s", "o_orderstatus", None),
    ("fresh", "s", None, "o_orderstatus"),
    ("typed", "n", "o_custkey", "concat('c', cast(o_custkey as varchar(20)))"),
]
_SWAP = "(select p, q, (p + q) / 2 as m from (select sum((o_orderstatus = v)::int) / count(*)::double as p, sum(((case when o_orderstatus = 'F' then 'O' else 'F' end) = v)::int) / count(*)::double as q from orders, (select unnest(['F', 'O', 'P']) as v) group by v))"


@add(
    "compare_findings_orders",
    "select 'gone' as name, 'schema_removed' as kind, 'warning' as severity from (describe orders) where column_name = 'o_orderstatus' union all select 'fresh', 'schema_added', 'info' from (describe orders) where column_name = 'o_orderstatus' "
    "union all select 'typed', 'schema_type_change', 'warning' from (describe orders) where column_name = 'o_custkey' "
    "union all select 'shifted', 'feature_drift', 'warning' from orders having max(o_totalprice) < min(o_totalprice) + 1000000 "
    "union all select 'holes', 'feature_drift', 'warning' from orders having count(*) filter (where o_orderkey % 5 = 0) / count(*)::double >= 0.05 "
    f"union all select 'swapped', 'feature_drift', case when js >= 0.25 then 'warning' else 'info' end from (select sum(case when p > 0 then p * ln(p / m) else 0 end + case when q > 0 then q * ln(q / m) else 0 end) / 2 as js from {_SWAP})",
)
def _compare_findings(spark, sf):
    df = read(spark, sf, "orders")
    sides = []
    for k in (2, 3):
        part = df.select(*[F.expr(v[k]).alias(v[0]) for v in VERSIONS if v[k] is not None])
        sides.append(profile_of_stats(columns.column_stats(part)))
    found = drift.compare_profiles(*sides).findings
    return spark.createDataFrame([(f.columns[0], f.kind, f.severity) for f in found], "name string, kind string, severity string")


# ---- what SQL can't say: trees, neighbours, forests, clusters; rows of a whole profile ----


def _stats(df: DataFrame) -> dict[str, columns.ColumnStats]:
    """Kinds, levels and most frequent values: what these analyses ask of a column."""
    return columns.column_stats(df, parts=frozenset({"values"}))


@add("predictive_power_lineitem")
def _pps(spark, sf):
    df = read(spark, sf, "lineitem")
    return target.signal_frame(df, _stats(df), "l_returnflag").select("feature", "n", "pps", "mutual_info")


@add("temporal_power_events")
def _gap(spark, sf):
    df = read(spark, sf, "events")
    return temporal.temporal_figures(df, _stats(df), "ts", "event_type")


@add("mutual_information_orders")
def _knn(spark, sf):
    df = read(spark, sf, "orders").select("o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority")
    return association.information_pairs(df, _stats(df))


@add("feature_clusters_lineitem")
def _clusters(spark, sf):
    from .operators.clusters import cluster_features

    df = read(spark, sf, "lineitem")
    report = cluster_features(df, _stats(df), [])
    return spark.createDataFrame([(c.id, c.members, c.representative, c.mean_abs_correlation) for c in report.clusters], "id int, members array<string>, representative string, mean_abs_correlation double")


def _rank_matrix_sql(t: str, names: list[str]) -> str:
    ranks_ = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r_{c}" for c in names)
    return f"with r as materialized (select {ranks_} from {t}) " + " union all ".join(f"select '{a}' as a, '{b}' as b, {r(f'abs(corr(r_{a}, r_{b}))', 3)} as rho from r" for i, a in enumerate(names) for b in names[i + 1 :])


def _rank_matrix(spark: SparkSession, sf: str, t: str, names: list[str]) -> DataFrame:
    from .operators.clusters import rank_correlations

    df = read(spark, sf, t).select(names)
    rho = rank_correlations(df, columns.column_stats(df, parts=frozenset({"values"})), names)
    return rounded(spark.createDataFrame([(a, names[j], float(rho[i, j])) for i, a in enumerate(names) for j in range(i + 1, len(names))], "a string, b string, rho double"), 3)


for _t in ("lineitem", "orders", "part"):
    add(f"rank_correlations_{_t}", _rank_matrix_sql(_t, _PAIR_TABLES[_t]))(lambda spark, sf, t=_t: _rank_matrix(spark, sf, t, _PAIR_TABLES[t]))


@add("permutation_importance_lineitem")
def _permutation(spark, sf):
    df = read(spark, sf, "lineitem")
    sample, classes = target.sample_frame(df, _stats(df), "l_linestatus")
    got = target.permutation_importance(spark, sample, "l_linestatus", classes)
    return spark.createDataFrame(sorted(got.items()), "feature string, importance double")


@add("profile_findings_labels")
def _profile(spark, sf):
    from .plans.profile import profile

    p = profile(read(spark, sf, "labels"), target="toxic", spark=spark)
    return p.findings_frame(spark)


@add("profile_diff_events")
def _diff(spark, sf):
    from .plans.profile import profile

    df = read(spark, sf, "events").drop("props")
    sides = (df, df.withColumn("value", F.when(F.col("event_id") % 2 == 0, F.col("value"))))
    # A profile is hundreds of short jobs; two beside each other leave fewer cores idle.
    with ThreadPoolExecutor(len(sides)) as pool:
        # Wrapped anew for each: the wrapper's copy of the job properties must not be shared.
        a, b = (f.result() for f in [pool.submit(inheritable_thread_target(spark)(profile), x, target="event_type", spark=spark) for x in sides])
    d = a.diff(b)
    rows = [("appeared", f.kind, f.columns[0]) for f in d.appeared] + [("resolved", f.kind, f.columns[0]) for f in d.resolved]
    return spark.createDataFrame(rows, "change string, kind string, column string")
