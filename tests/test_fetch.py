import gzip
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from linewright.sources.cache import PageCache
from linewright.sources.fetch import fetch

TEXT = "<p>日本語のページ</p>"
PAGES = {
    "/utf8": TEXT.encode(), "/sjis": TEXT.encode("cp932"), "/euc": TEXT.encode("euc-jp"), "/broken": b"<p>x</p>\x81",
    "/gzip": gzip.compress(TEXT.encode()), "/badgzip": b"no gzip", "/empty": b"",
}


class Handler(BaseHTTPRequestHandler):
    asked: list[str] = []

    def do_GET(self):
        Handler.asked.append(self.path)
        if self.path == "/slow":
            time.sleep(5)
        body = PAGES.get(self.path)
        self.send_response(200 if body is not None else 404)
        if "gzip" in self.path:
            self.send_header("Content-Encoding", "gzip")
        self.send_header("Content-Length", str(len(body or b"") + (9 if self.path == "/empty" else 0)))
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_charsets_and_failures(spark, site):
    urls = [*(site + p for p in PAGES), site + "/slow", site + "/none", "http://127.0.0.1:9/", "file:///etc/hosts", "http://[", None, site + "/utf8"]
    got = {r["url"]: r for r in fetch(spark.createDataFrame([(u,) for u in urls], "url string"), timeout=2).collect()}
    assert set(got) == set(urls) - {None}
    html = {p: got[site + p]["html"] for p in PAGES}
    assert html["/utf8"] == html["/sjis"] == html["/euc"] == html["/gzip"] == TEXT and html["/broken"] == "<p>x</p>\ufffd"
    assert got[site + "/utf8"]["status"] == 200 and got[site + "/utf8"]["error"] is None
    assert got[site + "/none"]["status"] == 404 and got[site + "/none"]["error"] == "Not Found"
    assert got[site + "/slow"]["error"] == "timed out" and got["file:///etc/hosts"]["error"] == "not a web address"
    for bad in (site + "/badgzip", site + "/empty", "http://127.0.0.1:9/", "http://["):
        assert got[bad]["html"] is None and got[bad]["error"]


def test_misses_of_a_cache_are_fetched_once(spark, site, tmp_path):
    cache = PageCache(spark, str(tmp_path / "cache"), buckets=4)
    rows = spark.createDataFrame([(i, site + p) for i, p in enumerate(["/utf8", "/sjis", "/utf8", "/none"])], "n int, url string")
    Handler.asked.clear()
    first = {r["n"]: (r["html"], r["is_hit"]) for r in cache.read_through(rows, lambda urls: fetch(urls, timeout=5)).collect()}
    assert first == {0: (TEXT, False), 1: (TEXT, False), 2: (TEXT, False), 3: (None, False)} and sorted(Handler.asked) == ["/none", "/sjis", "/utf8"]
    again = {r["n"]: r["is_hit"] for r in cache.read_through(rows, lambda urls: fetch(urls, timeout=5)).collect()}
    assert again == {0: True, 1: True, 2: True, 3: False}
