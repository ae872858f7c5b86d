"""From whatever a user has to one described DataFrame."""

from __future__ import annotations

import csv
import os
import warnings
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.expr import quoted
from ..functions.kinds import kinds
from ..session import session
from .filters import parse_clause, to_column, to_sql
from .remote import OBJECT_STORES, POSTGRES, columns_query, connector, credentials, open_remote, parse_uri, size_of, vendor_kind, warehouse, without_secrets
from .sampling import exact_sample

DELIMITED, JSON = (".csv", ".tsv", ".txt"), (".json", ".jsonl", ".ndjson")


@dataclass
class Source:
    """One table: `frame` after filter, exclusion and sample, `whole` before the sample."""

    frame: DataFrame
    whole: DataFrame
    name: str
    path: Path | None = None
    uri: str | None = None
    sampled: bool = False
    kinds: dict[str, str] = field(default_factory=dict)

    @cached_property
    def n_rows(self) -> int:
        return self.frame.count()

    @property
    def columns(self) -> list[str]:
        return self.frame.columns

    def close(self) -> None:
        self.frame.unpersist()


def _head(spark: SparkSession, path: str, n: int = 50) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def _plausible_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def sniff(lines: list[str], suffix: str) -> tuple[str, bool]:
    """(delimiter, header) of delimited text by its first lines."""
    lines = [x for x in lines if x.strip()]
    if not lines:
        return "\t" if suffix == ".tsv" else ",", True
    counts = {}
    for d in "\t,;|":
        widths = [len(r) for r in csv.reader(lines, delimiter=d)]
        counts[d] = (min(widths) if min(widths) == max(widths) else 0, widths[0])
    delimiter = max(counts, key=lambda d: (*counts[d], d == ("\t" if suffix == ".tsv" else ",")))
    rows = list(csv.reader(lines, delimiter=delimiter))
    first, rest = rows[0], rows[1:]
    header = all(x.strip() and not _plausible_number(x) for x in first) and len(set(first)) == len(first)
    if header and rest and all(len(r) == len(first) for r in rest):
        typed = [i for i in range(len(first)) if all(_plausible_number(r[i]) or not r[i] for r in rest) and any(r[i] for r in rest)]
        header = bool(typed) or not any(r == first for r in rest)
    return delimiter, header


def quoted_breaks(lines: list[str]) -> bool:
    """Whether a quoted field of delimited text runs over the end of a line: an odd number of quotes in one."""
    return any(x.count('"') % 2 for x in lines)


def json_is_one(lines: list[str]) -> bool:
    """Whether JSON is one value over many lines instead of one a line."""
    first = next((x.strip() for x in lines if x.strip()), "")
    return first.startswith("[") or first == "{"


def read_delimited(spark: SparkSession, path: str, delimiter: str, header: bool, breaks: bool) -> DataFrame:
    """Delimited text; a file with line feeds in quotes (breaks) is read by one task, others by ranges."""
    how = {"sep": delimiter, "header": header, "quote": '"', "escape": '"', "multiLine": breaks, "nullValue": "", "enforceSchema": True}
    return spark.read.csv(path, inferSchema=True, **how)


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its suffix; delimited text and JSON infer types from all rows."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in DELIMITED:
        head = _head(spark, path)
        breaks = quoted_breaks(head) or spark.read.text(path).where("(length(value) - length(replace(value, '\"', ''))) % 2 = 1").limit(1).count() > 0
        return read_delimited(spark, path, *sniff(list(_records(head)) if breaks else head, suffix), breaks)
    if suffix in JSON:
        return spark.read.json(path, multiLine=json_is_one(_head(spark, path, 5)))
    raise ValueError(f"unsupported file type {suffix or path!r}; use .csv, .tsv, .txt, .parquet or .json")


def _records(lines: list[str]) -> list[str]:
    """Lines put together again where quotes run over their ends; an open last one is left out."""
    out, held = [], []
    for x in lines:
        held.append(x)
        if sum(h.count('"') for h in held) % 2 == 0:
            out.append(" ".join(held))
            held = []
    return out


def _frame(spark: SparkSession, data: Any) -> tuple[DataFrame, str]:
    """A frame of any library as a DataFrame."""
    if isinstance(data, DataFrame):
        return data, "frame"
    kind = type(data).__module__.split(".")[0]
    if kind == "pandas":
        import pyarrow as pa

        # By way of Arrow, which reads NaN as missing.
        return spark.createDataFrame(pa.Table.from_pandas(data, preserve_index=False)), "pandas"
    if kind == "pyarrow":
        return spark.createDataFrame(data), "arrow"
    if kind == "polars":
        whole = data.collect() if hasattr(data, "collect") else data
        return spark.createDataFrame(whole.to_arrow()), "polars"
    if hasattr(data, "arrow") or hasattr(data, "to_arrow_table"):
        table = data.to_arrow_table() if hasattr(data, "to_arrow_table") else data.arrow()
        return spark.createDataFrame(table.read_all() if hasattr(table, "read_all") else table), "relation"
    if isinstance(data, dict):
        import pandas as pd

        return _frame(spark, pd.DataFrame(data))[0], "mapping"
    raise TypeError(f"can't read a table from {type(data).__name__}")


def load(
    data: Any,
    sample: int | None = None,
    exclude: list[str] | None = None,
    ignore_missing_exclude: bool = False,
    where: list[str] | None = None,
    source_name: str | None = None,
    credentials_env: str | None = None,
    spark: SparkSession | None = None,
) -> Source:
    """Resolve, filter, exclude, sample (after the filter). Lazy but for type inference."""
    spark = spark or session()
    path = uri = None
    pushed = False
    if isinstance(data, (str, Path)):
        uri = parse_uri(str(data))
        if uri is not None:
            df, name = open_remote(spark, uri, credentials_env)[0], uri.qualified
            if uri.scheme not in OBJECT_STORES and (where or sample) and uri.scheme in ("bigquery", "snowflake"):
                quote = "`" if uri.scheme == "bigquery" else '"'
                clauses = [to_sql(parse_clause(w, df.schema), df.schema, quote) for w in where or []]
                df, pushed = open_remote(spark, uri, credentials_env, clauses, sample)
                if sample:
                    warnings.warn("a sample of this source is its first rows, which may be biased", stacklevel=2)
        else:
            path = Path(data).expanduser()
            if not exists(spark, path):
                raise FileNotFoundError(without_secrets(str(path)))
            df, name = read_path(spark, str(path)), path.name
    else:
        df, name = _frame(spark, data)
    gone = _excluded(df.columns, exclude or [], ignore_missing_exclude)
    if not pushed:
        for clause in where or []:
            df = df.where(to_column(parse_clause(clause, df.schema), df.schema))
    whole = df.drop(*[quoted(c) if "." in c else c for c in gone]) if gone else df
    frame = exact_sample(whole, sample) if sample is not None and not pushed else whole
    return Source(frame, whole, source_name or name, path, uri.qualified if uri else None, sample is not None, kinds(frame.schema))


def _excluded(columns: list[str], exclude: list[str], ignore_missing: bool) -> list[str]:
    missing = [c for c in exclude if c not in columns]
    if missing and not ignore_missing:
        raise ValueError(f"can't exclude {', '.join(missing)}: the table has {', '.join(columns[:8])}{' and more' if len(columns) > 8 else ''}")
    return [c for c in dict.fromkeys(exclude) if c in columns]


@dataclass
class SchemaInfo:
    name: str
    columns: list[tuple[str, str, str]]
    n_rows: int | None = None


def discover_schema(data: str, credentials_env: str | None = None, spark: SparkSession | None = None) -> SchemaInfo:
    """Names, types and kinds without reading rows; a row estimate where the source keeps one."""
    spark = spark or session()
    uri = parse_uri(data)
    if uri is None or uri.scheme in OBJECT_STORES:
        df = read_path(spark, data) if uri is None else open_remote(spark, uri, credentials_env)[0]
        fields, rows = None, footer_rows(data) if uri is None else None
    else:
        with connector(uri.scheme):
            run = warehouse(spark, uri, credentials(uri.scheme, credentials_env))
            rows = size_of(run, uri)[0]
            fields = [(r.name, r.type, vendor_kind(r.type)) for r in run(columns_query(uri)).collect()] if uri.scheme not in POSTGRES else None
        df = None if fields is not None else open_remote(spark, uri, credentials_env)[0]
    if fields is None:
        by = kinds(df.schema)
        fields = [(f.name, f.dataType.simpleString(), by[f.name]) for f in df.schema]
    return SchemaInfo(uri.qualified if uri else data, fields, rows)


def footer_rows(path: str) -> int | None:
    """Rows of one Parquet file by its footer; None for anything else."""
    if not (path.lower().endswith(".parquet") and os.path.isfile(path)):
        return None
    import pyarrow.parquet as pq

    return pq.read_metadata(path).num_rows


def exists(spark: SparkSession, path: Path) -> bool:
    """On this machine or in the cluster's default file system."""
    if path.exists():
        return True
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


_PLAIN = {c.typeName(): c for c in (T.StringType, T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)}


def schema_of(fields: dict[str, str]) -> T.StructType:
    """A schema from names and names of plain types."""
    return T.StructType([T.StructField(k, _PLAIN[v]()) for k, v in fields.items()])
