"""Statistics of every column in a few passes, whatever the number of columns.

Columns are unpivoted to rows (column, value), so that one short aggregate serves
them all. 1. Counts and moments. 2. Counted values: numbers sorted once in ranges,
which gives distinct counts and exact quartiles without a task that holds all
values of a column; texts as 128-bit hashes with their first characters. 3. One
binned table with the bounds of pass 1 as literals, which gives histograms and
outliers. What a caller doesn't need can be left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expr import adjusted_skewness, as_text, col, number
from ..functions.kinds import NUMERIC, OTHER, TEMPORAL, TEXT, kind_of, kinds
from ..scratch import kept, mark, release
from .ranks import quantiles_at, with_before

TOP, BINS = 10, 24
DAY_SPAN, MONTH_SPAN = 60 * 86_400, 5 * 365 * 86_400
UNITS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


@dataclass
class ColumnStats:
    name: str
    dtype: str
    kind: str
    n: int
    n_null: int
    n_unique: int
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    p25: float | None = None
    p50: float | None = None
    p75: float | None = None
    max: float | None = None
    skew: float | None = None
    n_outliers_iqr: int | None = None
    top_values: list[tuple[str, int]] = field(default_factory=list)
    avg_len: float | None = None
    max_len: int | None = None
    ts_min: str | None = None
    ts_max: str | None = None
    histogram: list[tuple[float, float, int]] = field(default_factory=list)
    temporal_buckets: list[tuple[str, int]] = field(default_factory=list)

    @property
    def non_null(self) -> int:
        return self.n - self.n_null

    @property
    def null_rate(self) -> float:
        return self.n_null / self.n if self.n else 0.0

    @property
    def unique_rate(self) -> float:
        return self.n_unique / self.non_null if self.non_null else 0.0

    @property
    def is_constant(self) -> bool:
        return self.n_unique <= 1

    @property
    def top_share(self) -> float:
        return self.top_values[0][1] / self.non_null if self.top_values and self.non_null else 0.0

    @property
    def is_near_constant(self) -> bool:
        return self.kind != TEMPORAL and not self.is_constant and self.top_share > 0.99


QUARTERS = (0.25, 0.5, 0.75)


def scalar_exprs(df: DataFrame) -> list[Column]:
    """Counts, lengths and time spans of pass 1, named by the column's number and the figure."""
    out = [F.count(F.lit(1)).alias("n")]
    for i, (name, kind) in enumerate(kinds(df.schema).items()):
        out.append(F.count(col(name)).alias(f"{i}_count"))
        if kind == TEXT:
            out += [F.avg(F.length(col(name))).alias(f"{i}_avg_len"), F.max(F.length(col(name))).alias(f"{i}_max_len")]
        elif kind == TEMPORAL:
            out += [F.min(col(name)).cast("string").alias(f"{i}_ts_min"), F.max(col(name)).cast("string").alias(f"{i}_ts_max"), (seconds(F.max(col(name))) - seconds(F.min(col(name)))).alias(f"{i}_span")]
    return out


def numeric_names(df: DataFrame) -> list[str]:
    return [n for n, k in kinds(df.schema).items() if k == NUMERIC]


def moments(df: DataFrame, approximate_quartiles: bool = False) -> DataFrame:
    """(c, mean, std, min, max, skew[, q]) of the numeric columns."""
    x = F.col("v")
    figures = {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "skew": adjusted_skewness(x)}
    figures |= {"q": F.percentile_approx(x, list(QUARTERS), 10_000)} if approximate_quartiles else {}
    return unpivoted(df, numeric_names(df), lambda f: number(f.name), "double").groupBy("c").agg(*[f.alias(k) for k, f in figures.items()])


def number_counts(df: DataFrame) -> DataFrame:
    """(c, v, same, n): how often each number occurs in each numeric column. v is its double, null for NaN;
    same tells apart what double doesn't: the number itself, or a 64-bit hash of its text (decimals)."""

    def value(f) -> Column:
        whole = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        double = isinstance(f.dataType, (T.FloatType, T.DoubleType))
        same = col(f.name).cast("long") if whole else F.lit(None).cast("long") if double else F.xxhash64(as_text(f))
        return F.when(col(f.name).isNotNull(), F.struct(number(f.name).alias("v"), same.alias("same")))

    long = unpivoted(df, numeric_names(df), value, "struct<v: double, same: bigint>").where("v is not null").select("c", "v.v", "v.same")
    return long.groupBy("c", "v", "same").agg(F.count(F.lit(1)).alias("n"))


def number_figures(df: DataFrame, quarters: bool) -> DataFrame:
    """(c, n_unique, top, top_n, q) of the numeric columns from one sort of their counted values."""
    counts = number_counts(df)
    numbered = with_before(counts, ["c", "v", "same"], ["n"]) if quarters else kept(counts, "counted").withColumn("before_n", F.lit(0).cast("long"))
    shown = F.coalesce(F.when(F.col("v") != F.col("same"), F.col("v").cast("string")), F.col("same").cast("string"), F.col("v").cast("string"), F.lit("NaN"))
    # Written out only where a value is as frequent as the most frequent one.
    size = numbered.groupBy("c").agg(F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("top_n"), F.min(F.when(F.col("v").isNotNull(), F.col("before_n"))).alias("base"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("total"))
    # One row a column.
    rows = numbered.join(F.broadcast(size), "c")
    figures = [F.min(F.when(F.col("n") == F.col("top_n"), shown)).alias("top"), *[F.first(x).alias(x) for x in ("n_unique", "top_n", "total")]]
    places, q = quantiles_at(QUARTERS) if quarters else ([], F.lit(None).cast("array<double>"))
    return rows.withColumn("at", F.when(F.col("v").isNotNull(), F.col("before_n") - F.col("base"))).groupBy("c").agg(*figures, *places).select("c", "n_unique", "top", "top_n", q.alias("q"))


def seconds(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def unpivoted(df: DataFrame, names: list[str], value, kind: str = "string") -> DataFrame:
    """(column number, value) of the named columns; value(field) is the expression of each, of that type."""
    at = {n: i for i, n in enumerate(df.columns)}
    if not names:
        return df.sparkSession.createDataFrame([], f"c int, v {kind}")
    items = [F.struct(F.lit(at[n]).alias("c"), value(df.schema[n]).alias("v")) for n in names]
    return df.select(F.inline(F.array(*items)))


#: Characters of a text that travel with its hash: what shows most levels whole, and orders the others.
SHOWN = 40
#: Texts that agree in these and in their frequency at the edge of the top, up to which they are looked up together.
EDGE = 1000


def _hashed(df: DataFrame, names: list[str]) -> DataFrame:
    """(c, h, k, v): each text with 128 bits of it; a time stands for itself as microseconds."""
    text = lambda f: F.unix_micros(col(f.name).cast("timestamp")).cast("string") if kind_of(f.dataType) == TEMPORAL else as_text(f)
    return unpivoted(df, names, text).where("v is not null").select("c", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("k"), "v")


def level_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(c, h, k, n, p, cut): how often each value of each column occurs; texts are exchanged as 128 bits and
    their first characters p, cut where there are more."""
    shown = _hashed(df, names).select("c", "h", "k", F.substring("v", 1, SHOWN).alias("p"), (F.length("v") > SHOWN).alias("cut"))
    # p and cut follow from the text. As keys they are hashed; as first(p) they would have all rows sorted before the exchange.
    return shown.groupBy("c", "h", "k", "p", "cut").agg(F.count(F.lit(1)).alias("n")).select("c", "h", "k", "n", "p", "cut")


def top_levels(df: DataFrame, names: list[str], counts: DataFrame, k: int = TOP) -> dict[int, list[tuple[str, int]]]:
    """The k most frequent values of each column (by its number), ties by value; limited in every task before the shuffle.

    Where the first characters don't tell, the texts of the candidates are looked up by hash, for all columns at once.
    """
    spark = df.sparkSession
    order = Window.partitionBy("c").orderBy(F.desc("n"), "p", "h", "k")
    shown: dict[int, list] = {}
    for r in counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).orderBy("c", "r").collect():
        shown.setdefault(r.c, []).append(r)
    open_ = {c: rows[-1] for c, rows in shown.items() if any(r.cut for r in rows)}
    if not open_:
        return {c: [(r.p, r.n) for r in rows] for c, rows in shown.items()}
    last = spark.createDataFrame([(c, r.n, r.p) for c, r in open_.items()], "c int, n long, p string")
    edge: dict[int, list] = {c: [] for c in open_}
    tied = counts.join(F.broadcast(last), ["c", "n", "p"])
    # Counted first: a column may have as many of them as rows.
    few = [r.c for r in tied.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect() if r.n <= EDGE]
    for r in tied.where(F.col("c").isin(few)).collect() if few else []:
        edge[r.c].append(r)
    sure = {c: [r for r in shown[c] if (r.n, r.p) != (x.n, x.p)] for c, x in open_.items()}
    asked = [r for c in open_ for r in sure[c] + edge[c] if r.cut]
    wanted = spark.createDataFrame([(r.c, r.h, r.k) for r in asked], "c int, h long, k long")
    # At most k + EDGE texts a column.
    found = _hashed(df, [df.columns[c] for c in open_]).join(F.broadcast(wanted), ["c", "h", "k"]).groupBy("c", "h", "k").agg(F.first("v").alias("v")).collect()
    text = {(r.c, r.h, r.k): r.v for r in found}
    out = {c: [(r.p, r.n) for r in rows] for c, rows in shown.items()}
    for c, x in open_.items():
        rows = [(text.get((c, r.h, r.k), r.p), r.n) for r in sure[c]]
        if c in few:
            rows += [(text.get((c, r.h, r.k), r.p), r.n) for r in edge[c]]
        else:
            # Very many texts of one frequency and one beginning: the least of them, counted from their own rows alone.
            alike = _hashed(df, [df.columns[c]]).where(F.substring("v", 1, SHOWN) == x.p)
            rows += [(r.v, x.n) for r in alike.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == x.n).orderBy("v").limit(k).collect()]
        out[c] = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:k]
    return out


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin of a number; null for a missing one. One bin if all are equal."""
    if not high > low:
        return F.when(x.isNotNull(), F.lit(0))
    at = F.floor((x - F.lit(low)) / F.lit((high - low) / bins))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int")


def edges(low: float, high: float, bins: int) -> list[tuple[float, float]]:
    if not high > low:
        return [(low, high)]
    w = (high - low) / bins
    return [(low + i * w, low + (i + 1) * w) for i in range(bins)]


def unit_of(span: float) -> str:
    return "day" if span < DAY_SPAN else "month" if span < MONTH_SPAN else "year"


def _texts(df: DataFrame) -> list[str]:
    return [n for n, k in kinds(df.schema).items() if k != NUMERIC]


#: What column_stats can leave out: distinct and most frequent values, quartiles, bins and outliers.
PARTS = frozenset({"values", "quartiles", "bins"})


def column_stats(df: DataFrame, bins: int = BINS, exact_quantiles: bool = True, parts: frozenset[str] = PARTS) -> dict[str, ColumnStats]:
    """Statistics by column, in the order of the table; exact quartiles, or approximate ones in the pass of the moments.

    parts: what is asked for beside counts, moments, lengths and spans; the rest keeps its default.
    """
    if not df.columns:
        return {}
    since = mark()
    try:
        return _column_stats(df, bins, exact_quantiles, parts)
    finally:
        release(since)


def _column_stats(df: DataFrame, bins: int, exact: bool, parts: frozenset[str]) -> dict[str, ColumnStats]:
    by_kind, texts = kinds(df.schema), _texts(df)
    quarters = "quartiles" in parts
    one = df.agg(*scalar_exprs(df)).first().asDict()
    numbers = numeric_names(df)
    figures = {r.c: r for r in moments(df, quarters and not exact).collect()} if numbers else {}
    counted, unique, top = {}, {}, {}
    if numbers and ("values" in parts or (quarters and exact)):
        counted = {r.c: r for r in number_figures(df, quarters and exact).collect()}
    if texts and "values" in parts:
        levels = kept(level_counts(df, texts), "levels")
        unique = {r.c: r.n for r in levels.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        top = top_levels(df, texts, levels)
    out: dict[str, ColumnStats] = {}
    for i, f in enumerate(df.schema):
        get = lambda k, i=i: one.get(f"{i}_{k}")
        s = ColumnStats(f.name, f.dataType.simpleString(), by_kind[f.name], one["n"], one["n"] - get("count"), 0)
        if s.kind == NUMERIC:
            if r := figures.get(i):
                s.mean, s.std, s.min, s.max, s.skew = r["mean"], r["std"], r["min"], r["max"], r["skew"]
            if r := counted.get(i):
                s.n_unique, s.top_values = r.n_unique, [(r.top, r.top_n)]
            q = (counted.get(i) if exact else figures.get(i)) if quarters else None
            s.p25, s.p50, s.p75 = (q.q if q else None) or (None,) * 3
        else:
            s.n_unique, s.top_values = unique.get(i, 0), top.get(i, [])
            if s.kind == TEMPORAL:
                s.top_values, s.ts_min, s.ts_max = [], get("ts_min"), get("ts_max")
            else:
                s.avg_len, s.max_len = get("avg_len"), get("max_len")
                s.histogram = [(float(j), float(j + 1), n) for j, (_, n) in enumerate(s.top_values)]
        out[f.name] = s
    if "bins" in parts:
        _third_pass(df, out, {n: one.get(f"{i}_span") for i, n in enumerate(df.columns)}, bins)
    return out


def _third_pass(df: DataFrame, stats: dict[str, ColumnStats], spans: dict[str, Any], bins: int) -> None:
    unit = {n: unit_of(spans[n]) for n, s in stats.items() if s.kind == TEMPORAL and s.ts_min is not None}

    def value(f) -> Column:
        s = stats[f.name]
        if s.kind == NUMERIC:
            x = number(f.name)
            spread = (s.p75 or 0) - (s.p25 or 0)
            far = F.lit(False) if spread <= 0 else (x < s.p25 - 1.5 * spread) | (x > s.p75 + 1.5 * spread)
            return F.struct(bin_of(x, s.min, s.max, bins).cast("long").alias("b"), F.coalesce(far, F.lit(False)).alias("far"))
        return F.struct(F.unix_micros(F.date_trunc(unit[f.name], col(f.name).cast("timestamp"))).alias("b"), F.lit(False).alias("far"))

    names = [n for n, s in stats.items() if (s.kind == NUMERIC and s.min is not None) or n in unit]
    if not names:
        return
    long = unpivoted(df, names, value).select("c", "v.b", "v.far").where("b is not null")
    counts = long.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("far").cast("long")).alias("far"))
    # Times are written out once a bucket, not once a row.
    label = F.lit(None).cast("string")
    for u, shape in UNITS.items():
        of = [i for i, n in enumerate(df.columns) if unit.get(n) == u]
        label = F.when(F.col("c").isin(of), F.date_format(F.timestamp_micros("b"), shape)).otherwise(label) if of else label
    found: dict[int, list] = {}
    for r in counts.select("c", "b", "n", "far", label.alias("label")).collect():
        found.setdefault(r.c, []).append(r)
    for i, n in enumerate(df.columns):
        if n not in names:
            continue
        s, rows = stats[n], found.get(i, [])
        if s.kind == NUMERIC:
            size = {r.b: r.n for r in rows}
            s.histogram = [(a, b, size.get(j, 0)) for j, (a, b) in enumerate(edges(s.min, s.max, bins))]
            s.n_outliers_iqr = sum(r.far for r in rows)
        else:
            s.temporal_buckets = sorted((r.label, r.n) for r in rows)


__all__ = ["BINS", "OTHER", "ColumnStats", "PARTS", "bin_of", "column_stats", "edges", "level_counts", "top_levels", "unit_of", "unpivoted"]
