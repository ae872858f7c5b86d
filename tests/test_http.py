"""Reading over http from a server of this machine, with and without byte ranges; quoted line feeds."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
import pytest

from riskloom.sources import http as h
from riskloom.sources.load import load, read_path

FILES: dict[str, bytes] = {}
ASKED: list = []


class Handler(BaseHTTPRequestHandler):
    ranges = True

    def do_GET(self):
        data = FILES.get(self.path.split("?")[0])
        if data is None:
            self.send_error(404)
            return
        want = self.headers.get("Range")
        if want and self.ranges and data:
            a, b = want.removeprefix("bytes=").split("-")
            part = data[int(a) : int(b) + 1]
            ASKED.append((int(a), len(part)))
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{int(a) + len(part) - 1}/{len(data)}")
        else:
            part = data
            self.send_response(200)
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module", params=[True, False], ids=["ranges", "whole"])
def url(request):
    Handler.ranges = request.param
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture(scope="module")
def rows():
    return pd.DataFrame({"id": range(2000), "name": [f"n {i % 7}, é" for i in range(2000)], "x": [i / 8 for i in range(2000)]})


def test_lines_of_any_ranges_are_all_lines(url):
    data = b"first\n\nthird line\r\nx" + b"y" * 50 + b"\nlast"
    FILES["/t.txt"] = data
    want = [line.rstrip(b"\r\n") for line in data.splitlines(keepends=True)]
    if Handler.ranges:
        assert h.size_of(f"{url}/t.txt") == (len(data), True)
        for n in range(1, 30):
            got = [x for a in range(0, len(data), n) for x in h.lines_of(f"{url}/t.txt", a, min(a + n, len(data)), len(data))]
            assert got == want, n
    else:
        assert h.size_of(f"{url}/t.txt") == (len(data), False)
    assert list(h.lines_of(f"{url}/t.txt", 0, None, None)) == want


def test_formats(spark, url, rows, tmp_path):
    rows.to_parquet(tmp_path / "a.parquet", row_group_size=300)
    FILES["/d/a.parquet"] = (tmp_path / "a.parquet").read_bytes()
    FILES["/d/a.csv"] = rows.to_csv(index=False).encode()
    FILES["/d/a.tsv"] = rows.to_csv(index=False, sep="\t", header=False).encode()
    FILES["/d/a.jsonl"] = rows.to_json(orient="records", lines=True).encode()
    FILES["/d/a.json"] = rows.to_json(orient="records", indent=1).encode()
    for name in ("a.parquet", "a.csv?v=1", "a.tsv", "a.jsonl", "a.json"):
        for df in (load(f"{url}/d/{name}", spark=spark).frame, h.read_url(spark, f"{url}/d/{name}", 10_000)):
            got = df.toPandas()
            got.columns = rows.columns if name == "a.tsv" else got.columns
            got = got[list(rows.columns)].sort_values("id").reset_index(drop=True)
            assert got.astype({"id": "int64"}).equals(rows), name
    lines = spark.read.format(h.Lines.name()).option("range", 10_000).load(f"{url}/d/a.csv")
    assert lines.rdd.getNumPartitions() == (-(-len(FILES["/d/a.csv"]) // 10_000) if Handler.ranges else 1)
    groups = spark.read.format(h.Groups.name()).load(f"{url}/d/a.parquet")
    assert groups.rdd.getNumPartitions() == 7 and groups.count() == 2000
    FILES["/d/none.csv"] = b"a,b\n"
    assert load(f"{url}/d/none.csv", spark=spark).frame.count() == 0
    with pytest.raises(ValueError):
        load(f"{url}/d/a.xlsx", spark=spark)


def test_line_feeds_in_quotes(spark, url, tmp_path):
    text = 'id,said\n1,"two\nlines, and ""quotes"""\n2,plain\n3,"and\nthree\nlines"\n'
    (tmp_path / "q.csv").write_text(text)
    FILES["/q.csv"] = text.encode()
    want = [(1, 'two\nlines, and "quotes"'), (2, "plain"), (3, "and\nthree\nlines")]
    assert sorted(tuple(r) for r in read_path(spark, str(tmp_path / "q.csv")).collect()) == want
    assert sorted(tuple(r) for r in load(f"{url}/q.csv", spark=spark).frame.collect()) == want
    late = "id,said\n" + "".join(f"{i},x\n" for i in range(500)) + '500,"a\nb"\n'
    (tmp_path / "late.csv").write_text(late)
    assert read_path(spark, str(tmp_path / "late.csv")).where("id = 500").first().said == "a\nb"
