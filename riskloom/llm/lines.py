"""Line dedup by site-relative frequency, in DataFrame operations only.

A line of a page is boilerplate of its host when the pages of the host that
contain it, divided by all pages of the host, exceed a ratio. Only hashes of
lines are exploded and shuffled; the texts move once, with what is to go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line on more than this share of its host's pages is dropped ...
MAX_RATIO = 0.1
#: ... if at least so many pages have it: on a host of a few pages every line is frequent.
MIN_PAGES = 5


def _line_hashes(text: str) -> Column:
    """128 bits for each line, trimmed at both ends of spaces, tabs and carriage returns; null for a blank line."""
    trimmed = F.expr(f"transform(split({text}, '\\n', -1), x -> regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', ''))")
    return F.transform(trimmed, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))))


def boilerplate_lines(docs: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, a, b, n_pages, n_host): hashed lines above the ratio. Null hosts form one host."""
    hashed = docs.select(F.col(host).alias("host"), F.array_distinct(F.filter(_line_hashes(text), lambda x: x.isNotNull())).alias("h"))
    total = hashed.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    counts = hashed.select("host", F.explode("h").alias("h")).groupBy("host", "h.a", "h.b").agg(F.count(F.lit(1)).alias("n_pages"))
    frequent = counts.where(F.col("n_pages") >= min_pages)
    joined = frequent.join(total.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_")))
    return joined.where(F.col("n_pages") > F.lit(max_ratio) * F.col("n_host")).drop("host_")


def drop_boilerplate(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, report: bool = False) -> DataFrame:
    """docs with the host's boilerplate lines taken out of text; other columns as they are.

    Rows are pages: copies count each. Lines are what stands between \\n; they
    compare trimmed, and the kept ones stay byte for byte, joined by \\n. Blank
    lines are never boilerplate. A null text stays null, a null host is a host
    of its own, a text of which every line goes becomes empty. Lines are given
    back to rows by key, host and text, so rows that repeat a key, or have none,
    are told apart by what they hold.
    report: adds n_lines and n_dropped (longs).
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("k"), F.col(host).alias("host"), F.col(text).alias("text"))
    bad = boilerplate_lines(docs, host, text, max_ratio, min_pages)
    # Frequent lines are few: at most hosts / max_ratio * lines of a page. Spark broadcasts them if they are small.
    places = rows.where("text is not null").select("k", "host", F.xxhash64("text").alias("t"), F.posexplode(_line_hashes("text")).alias("line", "h")).where("h is not null")
    hit = places.join(bad.select(F.col("host").alias("host_"), F.col("a").alias("a_"), F.col("b").alias("b_")), F.col("h.a").eqNullSafe(F.col("a_")) & (F.col("h.b") == F.col("b_")) & F.col("host").eqNullSafe(F.col("host_")))
    gone = hit.groupBy(F.col("k").alias("k_"), F.col("host").alias("host_"), F.col("t").alias("t_")).agg(F.collect_set("line").alias("gone"))
    joined = rows.join(gone, F.col("k").eqNullSafe(F.col("k_")) & F.col("host").eqNullSafe(F.col("host_")) & (F.xxhash64("text") == F.col("t_")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = joined.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"), F.coalesce(F.size(lines), F.lit(0)).alias("n"), F.coalesce(F.size("gone"), F.lit(0)).alias("g"))
    cols = [(F.col("kept") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns]
    if report:
        cols = [c for c, name in zip(cols, docs.columns) if name not in ("n_lines", "n_dropped")] + [F.when(F.col("kept").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"), F.greatest("g", F.lit(0)).cast("long").alias("n_dropped")]
    return out.select(*cols)


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op8_line_dedup: every document after its host's boilerplate is gone."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, report=True).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
  from documents where text is not null
), keyed as (select *, trim(line, ' ' || chr(9) || chr(13)) as k from lines),
hosts as (select source, count(*) as n_host from documents group by source),
bad as (
  select c.source, c.k from (select source, k, count(distinct doc_id) as n from keyed where k <> '' group by source, k) c
  join hosts h on c.source is not distinct from h.source
  where c.n >= {MIN_PAGES} and c.n > {MAX_RATIO} * h.n_host
), marked as (
  select keyed.*, bad.k is not null as gone from keyed left join bad on keyed.source is not distinct from bad.source and keyed.k = bad.k
), done as (
  select doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_dropped,
    coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept
  from marked group by doc_id
)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join done on d.doc_id = done.doc_id
"""
