"""Remote tables by URI: parsing, credentials from the environment, Spark readers.

Readers only ever select. Credentials go to reader options, never into plans,
names or messages.
"""

from __future__ import annotations

import os
import re
import warnings
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession

# The schemes that are read, and the variables their vendors' tools read.
OBJECT_STORES = {"s3": "s3a", "s3a": "s3a", "gs": "gs", "gcs": "gs", "http": "http", "https": "https"} | {x: x for x in ("hdfs", "viewfs", "abfs", "abfss", "wasbs", "dbfs", "file")}
AZURE = ("abfs", "abfss", "wasbs")
POSTGRES = ("postgres", "postgresql")
SCHEMES = sorted([*OBJECT_STORES, *POSTGRES, "bigquery", "snowflake"])
_AWS = ("AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "AWS_SESSION_TOKEN", "AWS_REGION", "AWS_DEFAULT_REGION")
_PG = ("PGHOST", "PGUSER", "PGPASSWORD", "PGDATABASE", "PGPORT", "PGSSLMODE")
REQUIRED = {"snowflake": ("SNOWFLAKE_ACCOUNT", "SNOWFLAKE_USER"), "bigquery": ("GOOGLE_APPLICATION_CREDENTIALS",)}
OPTIONAL = {
    "snowflake": ("SNOWFLAKE_PRIVATE_KEY_PATH", "SNOWFLAKE_PRIVATE_KEY_PASSPHRASE", "SNOWFLAKE_PASSWORD", "SNOWFLAKE_WAREHOUSE", "SNOWFLAKE_ROLE", "SNOWFLAKE_DATABASE", "SNOWFLAKE_SCHEMA"),
    "bigquery": ("BIGQUERY_PROJECT",),
    **dict.fromkeys(POSTGRES, _PG),
    **dict.fromkeys(("s3", "s3a"), _AWS),
    **dict.fromkeys(("gs", "gcs"), ("GOOGLE_APPLICATION_CREDENTIALS",)),
    **dict.fromkeys(("http", "https", "hdfs", "viewfs", "abfs", "abfss", "wasbs", "dbfs", "file"), ()),
}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$-]*(\.[A-Za-z_][A-Za-z0-9_$-]*){0,2}")
#: Above these a warning tells what a scan would touch.
BIGQUERY_BYTES, SNOWFLAKE_CELLS = 5 * 1024**3, 5 * 10**8
#: Pages of 8 kB that a task reads of a table of Postgres, and the most tasks (connections) at once.
PAGES, CONNECTIONS = 16_384, 64


class MissingCredential(ValueError):
    """A variable that a scheme requires isn't set."""


class MissingConnector(RuntimeError):
    """The Spark connector of a scheme isn't on the class path."""


@dataclass(frozen=True)
class RemoteTable:
    scheme: str
    host: str
    port: int | None
    path: str
    query: dict[str, str]
    container: str = ""

    @property
    def qualified(self) -> str:
        """The URI without user, password or the order of its query."""
        at = f"{self.host}:{self.port}" if self.port else self.host
        tail = f"?{urlencode(sorted(self.query.items()))}" if self.query else ""
        return f"{self.scheme}://{at}{self.path}{tail}"

    def table(self) -> str:
        """The named table: ?table=, or the last parts of the path. At most three dotted identifiers."""
        name = self.query.get("table") or self.path.strip("/").replace("/", ".")
        if not _NAME.fullmatch(name):
            raise ValueError(f"{self.qualified}: {name!r} isn't a table name of at most three dotted identifiers")
        return name


def parse_uri(text: str) -> RemoteTable | None:
    """None for what isn't a URI; an error for schemes that aren't read."""
    if "://" not in text:
        return None
    parts = urlsplit(text)
    scheme = parts.scheme.lower()
    if scheme not in SCHEMES:
        raise ValueError(f"unsupported scheme {scheme!r}; there are {', '.join(SCHEMES)}")
    # Azure's paths name the container where others have a user.
    container = f"{parts.username}@" if scheme in AZURE and parts.username else ""
    return RemoteTable(scheme, parts.hostname or "", parts.port, parts.path, dict(parse_qsl(parts.query)), container)


def credentials(scheme: str, prefix: str | None = None) -> dict[str, str]:
    """Variables of a scheme that are set, by their plain names; with a prefix, PREFIX_NAME is read."""
    if scheme not in OPTIONAL:
        raise ValueError(f"no credentials are known for {scheme!r}")
    found = {}
    for name in (*REQUIRED.get(scheme, ()), *OPTIONAL[scheme]):
        variable = f"{prefix}_{name}" if prefix else name
        if value := os.environ.get(variable):
            found[name] = value
        elif name in REQUIRED.get(scheme, ()):
            raise MissingCredential(f"{variable} isn't set, which {scheme}:// needs; another prefix can be given with credentials_env")
    return found


def without_secrets(text: str) -> str:
    """user:password@ cut out of anything that looks like a URI."""
    return re.sub(r"(://)[^/@\s]+@", r"\1", text)


def postgres_options(uri: RemoteTable, found: dict[str, str]) -> dict[str, str]:
    """JDBC options; the URI's host, port and database come before the environment's."""
    database = uri.path.strip("/") or found.get("PGDATABASE")
    if not database:
        raise ValueError(f"{uri.qualified}: a database is missing; write postgres://host/database?table=name or set PGDATABASE")
    host, port = uri.host or found.get("PGHOST", "localhost"), uri.port or found.get("PGPORT")
    if not uri.query.get("table"):
        raise ValueError(f"{uri.qualified}: ?table= is missing")
    out = {"url": f"jdbc:postgresql://{host}{f':{port}' if port else ''}/{quote(database)}", "dbtable": uri.table(), "driver": "org.postgresql.Driver", "sessionInitStatement": "SET default_transaction_read_only = on"}
    out |= {k: found[v] for k, v in (("user", "PGUSER"), ("password", "PGPASSWORD"), ("sslmode", "PGSSLMODE")) if v in found}
    return out


def object_store_options(uri: RemoteTable, found: dict[str, str]) -> dict[str, str]:
    """Settings of the file system, for one bucket where the connector allows that; S3 keys only as a pair."""
    out = {}
    if OBJECT_STORES[uri.scheme] == "s3a":
        own = f"fs.s3a.bucket.{uri.host}."
        if "AWS_ACCESS_KEY_ID" in found and "AWS_SECRET_ACCESS_KEY" in found:
            out |= {own + "access.key": found["AWS_ACCESS_KEY_ID"], own + "secret.key": found["AWS_SECRET_ACCESS_KEY"]}
            if "AWS_SESSION_TOKEN" in found:
                out |= {own + "session.token": found["AWS_SESSION_TOKEN"], own + "aws.credentials.provider": "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"}
        if region := found.get("AWS_REGION") or found.get("AWS_DEFAULT_REGION"):
            out[own + "endpoint.region"] = region
    elif OBJECT_STORES[uri.scheme] == "gs" and "GOOGLE_APPLICATION_CREDENTIALS" in found:
        out |= {"fs.gs.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE", "fs.gs.auth.service.account.json.keyfile": found["GOOGLE_APPLICATION_CREDENTIALS"]}
    return out


def object_store_path(uri: RemoteTable) -> str:
    return f"{OBJECT_STORES[uri.scheme]}://{uri.container}{uri.host}{f':{uri.port}' if uri.port else ''}{uri.path}"


def remote_query(table: str, clauses: list[str], limit: int | None) -> str:
    """The one SELECT sent to a warehouse, with filter and head sample pushed into it."""
    where = f" WHERE {' AND '.join(f'({c})' for c in clauses)}" if clauses else ""
    return f"SELECT * FROM {table}{where}{f' LIMIT {int(limit)}' if limit else ''}"


def bigquery_options(uri: RemoteTable, found: dict[str, str]) -> dict[str, str]:
    out = {"credentialsFile": found["GOOGLE_APPLICATION_CREDENTIALS"], "viewsEnabled": "true"}
    if project := uri.query.get("project") or found.get("BIGQUERY_PROJECT") or uri.host:
        out["parentProject"] = project
    return out


def snowflake_options(uri: RemoteTable, found: dict[str, str]) -> dict[str, str]:
    if "SNOWFLAKE_PRIVATE_KEY_PATH" not in found and "SNOWFLAKE_PASSWORD" not in found:
        raise MissingCredential("snowflake:// needs SNOWFLAKE_PRIVATE_KEY_PATH or SNOWFLAKE_PASSWORD")
    out = {"sfURL": f"{found['SNOWFLAKE_ACCOUNT']}.snowflakecomputing.com", "sfUser": found["SNOWFLAKE_USER"]}
    if "SNOWFLAKE_PRIVATE_KEY_PATH" in found:
        with open(found["SNOWFLAKE_PRIVATE_KEY_PATH"]) as f:
            out["pem_private_key"] = "".join(line.strip() for line in f if "-----" not in line)
        if "SNOWFLAKE_PRIVATE_KEY_PASSPHRASE" in found:
            out["pem_private_key_passphrase"] = found["SNOWFLAKE_PRIVATE_KEY_PASSPHRASE"]
    else:
        out["sfPassword"] = found["SNOWFLAKE_PASSWORD"]
    for option, name, key in (("sfWarehouse", "SNOWFLAKE_WAREHOUSE", "warehouse"), ("sfRole", "SNOWFLAKE_ROLE", "role"), ("sfDatabase", "SNOWFLAKE_DATABASE", "database"), ("sfSchema", "SNOWFLAKE_SCHEMA", "schema")):
        if value := uri.query.get(key) or found.get(name):
            out[option] = value
    return out


def warn_about_cost(scheme: str, n_bytes: int | None = None, rows: int | None = None, columns: int | None = None, limit: int | None = None) -> str | None:
    """A warning, not an error, where a scan is large."""
    said = None
    if scheme == "bigquery" and n_bytes is not None and n_bytes >= BIGQUERY_BYTES:
        said = f"this query reads about {n_bytes / 1024**3:.1f} GiB"
    if scheme == "snowflake" and rows is not None and columns is not None and min(rows, limit or rows) * columns >= SNOWFLAKE_CELLS:
        said = f"this query reads about {min(rows, limit or rows) * columns:.1e} cells"
    if said:
        warnings.warn(said, stacklevel=2)
    return said


#: Remote type names by kind, where only a schema was asked for.
VENDOR_KINDS = {
    "numeric": "INT64 INTEGER BIGINT FLOAT64 FLOAT NUMERIC BIGNUMERIC NUMBER DECIMAL REAL DOUBLE FIXED SMALLINT TINYINT BYTEINT INT".split(),
    "temporal": "DATE DATETIME TIME TIMESTAMP TIMESTAMP_NTZ TIMESTAMP_LTZ TIMESTAMP_TZ".split(),
    "bool": ["BOOL", "BOOLEAN"],
    "text": "STRING VARCHAR TEXT CHAR".split(),
}


def vendor_kind(name: str) -> str:
    plain = name.upper().split("(")[0].split("<")[0].strip()
    return next((kind for kind, names in VENDOR_KINDS.items() if plain in names), "other")


def page_ranges(pages: int) -> list[str]:
    """Predicates on the place of a row that part a Postgres table; the last is open, so that no row is missed."""
    n = max(1, min(CONNECTIONS, pages // PAGES))
    cuts = [pages * k // n for k in range(1, n)]
    at = lambda page: f"'({page},0)'::tid"
    lows, highs = [None, *cuts], [*cuts, None]
    return [" AND ".join([*([f"ctid >= {at(a)}"] if a is not None else []), *([f"ctid < {at(b)}"] if b is not None else [])]) or "true" for a, b in zip(lows, highs)]


def warehouse(spark: SparkSession, uri: RemoteTable, found: dict[str, str]):
    """run(sql): the rows a statement of a database or warehouse gives, lazily."""
    kind, options = {
        "bigquery": ("bigquery", lambda: bigquery_options(uri, found)),
        "snowflake": ("snowflake", lambda: snowflake_options(uri, found)),
    }.get(uri.scheme, ("jdbc", lambda: {k: v for k, v in postgres_options(uri, found).items() if k != "dbtable"}))
    made = options()
    return lambda sql: spark.read.format(kind).options(**made).option("query", sql).load()


def size_query(uri: RemoteTable) -> str:
    """The statement that asks the catalog for (n_rows, n_bytes, n_pages) without reading the table."""
    *above, name = uri.table().split(".")
    if uri.scheme == "bigquery":
        return f"SELECT row_count AS n_rows, size_bytes AS n_bytes, 0 AS n_pages FROM `{'.'.join([*above, '__TABLES__'])}` WHERE table_id = '{name}'"
    if uri.scheme == "snowflake":
        schema = f" AND table_schema = '{above[-1].upper()}'" if above else ""
        return f"SELECT row_count AS n_rows, bytes AS n_bytes, 0 AS n_pages FROM {'.'.join([*above[:-1], 'information_schema', 'tables'])} WHERE table_name = '{name.upper()}'{schema}"
    # A view has no pages and no ctid; a partitioned table's pages are those of its parts, so it is read as one.
    return f"SELECT reltuples::bigint AS n_rows, 0::bigint AS n_bytes, CASE WHEN relkind = 'r' THEN relpages ELSE 0 END AS n_pages FROM pg_class WHERE oid = '{uri.table()}'::regclass"


def size_of(run, uri: RemoteTable) -> tuple[int | None, int | None, int]:
    """(rows, bytes, pages) by the catalog; None where it doesn't say."""
    seen = run(size_query(uri)).first()
    n_rows, n_bytes, n_pages = seen if seen else (None, None, None)
    known = lambda x: int(x) if x is not None and x >= 0 else None
    return known(n_rows), known(n_bytes), known(n_pages) or 0


def columns_query(uri: RemoteTable) -> str:
    """The statement for (name, type) of a warehouse's table."""
    *above, name = uri.table().split(".")
    if uri.scheme == "bigquery":
        return f"SELECT column_name AS name, data_type AS type FROM `{'.'.join([*above, 'INFORMATION_SCHEMA', 'COLUMNS'])}` WHERE table_name = '{name}' ORDER BY ordinal_position"
    schema = f" AND table_schema = '{above[-1].upper()}'" if above else ""
    return f"SELECT column_name AS name, data_type AS type FROM {'.'.join([*above[:-1], 'information_schema', 'columns'])} WHERE table_name = '{name.upper()}'{schema} ORDER BY ordinal_position"


@contextmanager
def connector(scheme: str):
    """Says plainly that a connector is missing."""
    try:
        yield
    except Exception as e:
        if re.search("ClassNotFound|DATA_SOURCE_NOT_FOUND|Failed to find data source|No suitable driver", str(e)):
            raise MissingConnector(f"the Spark connector for {scheme}:// isn't on the class path") from e
        raise


def open_remote(spark: SparkSession, uri: RemoteTable, prefix: str | None = None, clauses: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, bool]:
    """(frame, whether clauses and limit were applied remotely). Lazy: nothing is read but the schema and the catalog's sizes."""
    found = credentials(uri.scheme, prefix)
    if uri.scheme in OBJECT_STORES:
        for name, value in object_store_options(uri, found).items():
            spark._jsc.hadoopConfiguration().set(name, value)
        if uri.scheme in ("http", "https"):
            from .http import read_url

            return read_url(spark, object_store_path(uri) + (f"?{urlencode(uri.query)}" if uri.query else "")), False
        from .load import read_path

        return read_path(spark, object_store_path(uri)), False
    with connector(uri.scheme):
        run = warehouse(spark, uri, found)
        rows, n_bytes, pages = size_of(run, uri)
        if uri.scheme in POSTGRES:
            options = postgres_options(uri, found)
            url, name = options.pop("url"), options.pop("dbtable")
            parts = page_ranges(pages)
            return spark.read.jdbc(url, name, predicates=parts, properties=options) if len(parts) > 1 else spark.read.jdbc(url, name, properties=options), False
        quoted = f"`{uri.table()}`" if uri.scheme == "bigquery" else uri.table()
        df = run(remote_query(quoted, clauses or [], limit))
        warn_about_cost(uri.scheme, n_bytes, rows, len(df.columns), limit)
        return df, True
