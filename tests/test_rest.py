import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from cohortlens.sources import rest


def test_pages(spark, tmp_path):
    for at in (0, 2, 4):
        (tmp_path / f"{at}.json").write_text(json.dumps({"data": {"hits": [{"id": i, "case": {"name": f"n{i}", "tags": [i]}} for i in range(at, min(at + 2, 5))]}}))
    spark.dataSource.register(rest.PagedJson)
    df = spark.read.format("paged_json").schema("id string, case__name string, case__tags string, none string").option("url", f"file://{tmp_path}/{{offset}}.json").option("rows", "data.hits").option("total", 5).option("size", 2).load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == [(str(i), f"n{i}", f"[{i}]", None) for i in range(5)]
    gone = spark.read.format("paged_json").schema("id string").option("url", f"file://{tmp_path}/none.json").option("attempts", 1)
    assert gone.option("onError", "empty").load().count() == 0
    with pytest.raises(Exception, match="none.json"):
        gone.option("onError", "fail").load().collect()


def test_filters():
    assert rest.equals(a="x", b=["y", "z"])["content"][1]["content"] == {"field": "b", "value": ["y", "z"]}


@pytest.fixture
def service():
    """Rows 0.. of a total that may grow with each answer; asks are kept."""
    state = {"total": 25, "grows": 0, "more": 0, "asks": []}

    class Answer(BaseHTTPRequestHandler):
        def answer(self, at, size, kind):
            state["asks"].append((kind, at, size))
            rows = [{"id": i, "case": {"name": f"n{i}"}} for i in range(at, min(at + size + state["more"], state["total"]))]
            body = json.dumps({"data": {"hits": rows, "pagination": {"total": state["total"]}}}).encode()
            state["total"] += state["grows"]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            self.answer(int(q["from"][0]), int(q["size"][0]), "GET")

        def do_POST(self):
            q = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.answer(q["from"], q["size"], q["filters"]["op"])

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_address[1]}/?from={{offset}}&size={{size}}"
    yield state
    server.shutdown()


def paged(spark, service, **options):
    spark.dataSource.register(rest.PagedJson)
    reader = spark.read.format("paged_json").schema("id string, case__name string").option("url", service["url"]).option("rows", "data.hits").option("size", 10).option("attempts", 1)
    return reader.options(**options).load()


def ids(df):
    return sorted(int(r.id) for r in df.collect())


def test_total_is_found(spark, service):
    df = paged(spark, service, totalAt="data.pagination.total")
    assert ids(df) == list(range(25)) and df.rdd.getNumPartitions() == 3
    assert ids(paged(spark, service, totalAt="data.pagination.total", limit=12)) == list(range(12))
    with pytest.raises(Exception, match="no total"):
        paged(spark, service, totalAt="data.none").collect()
    service["total"] = 0
    assert ids(paged(spark, service, totalAt="data.pagination.total")) == []


def test_total_that_grows_and_none_told(spark, service):
    service["grows"] = 3
    got = ids(paged(spark, service, totalAt="data.pagination.total"))
    assert got == list(range(len(got))) and len(got) > 28
    service["grows"] = 0
    assert ids(paged(spark, service)) == list(range(service["total"]))


def test_longer_pages_are_errors(spark, service):
    service["more"] = 1
    with pytest.raises(Exception, match="a page of 10 rows"):
        paged(spark, service, totalAt="data.pagination.total").collect()


def test_bodies_are_posted(spark, service):
    body = json.dumps({"filters": rest.equals(a="x"), "from": "AT", "size": "N"}).replace('"AT"', "{offset}").replace('"N"', "{size}")
    assert ids(paged(spark, service, totalAt="data.pagination.total", body=body)) == list(range(25))
    assert {k for k, _, _ in service["asks"]} == {"and"}


def test_failed_pages_leave_a_row(spark):
    spark.dataSource.register(rest.PagedJson)
    df = spark.read.format("paged_json").schema("id string, _error string").option("url", "file:///none-{offset}.json").option("attempts", 1).option("total", 200).option("onError", "empty").load()
    assert [(r.id, "none-" in r._error) for r in df.collect()] == [(None, True)] * 2
