from pathlib import Path

from linewright.sources.cache import PageCache


def _files(folder: Path) -> dict[str, set[str]]:
    return {f.name: {x.name for x in f.glob("*.parquet")} for f in folder.glob("bucket=*")}


def _rows(cache):
    return {r["url"]: r["html"] for r in cache.read().collect()}


def test_changes_touch_their_buckets_only(spark, tmp_path):
    cache = PageCache(spark, str(tmp_path / "cache"), buckets=16)
    assert _rows(cache) == {}
    frame = lambda pairs: spark.createDataFrame(pairs, "url string, html string")
    first = {f"u{i}": f"<p>{i}</p>" for i in range(40)}
    cache.put(frame([*first.items(), ("u1", "<a>"), (None, "x"), ("n", None)]))
    assert _rows(cache) == first
    before = _files(tmp_path / "cache")
    cache.put(frame([("u3", "new")]))
    after = _files(tmp_path / "cache")
    assert _rows(cache) == first | {"u3": "new"}
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == len(after)
    cache.put(frame([]))
    cache.keep_only(frame([(u, "") for u in first if u != "u5"]))
    assert _rows(cache) == {u: h for u, h in (first | {"u3": "new"}).items() if u != "u5"}
    assert sum(after[b] != _files(tmp_path / "cache").get(b) for b in after) == 1
    cache.keep_only(frame([("u7", "")]))
    assert _rows(cache) == {"u7": first["u7"]} and len(_files(tmp_path / "cache")) == 1
    cache.keep_only(frame([]))
    assert _rows(cache) == {}


def test_read_through(spark, tmp_path):
    cache = PageCache(spark, str(tmp_path / "cache"), buckets=4)
    cache.put(spark.createDataFrame([("a", "A")], "url string, html string"))
    asked = []

    def fetch(urls):
        asked.extend(r["url"] for r in urls.collect())
        return urls.selectExpr("url", "IF(url = 'bad', NULL, upper(url)) AS html")

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "bad"), (5, None)], "n long, url string")
    got = {r["n"]: (r["html"], r["is_hit"]) for r in cache.read_through(rows, fetch).collect()}
    assert got == {1: ("A", True), 2: ("B", False), 3: ("B", False), 4: (None, False), 5: (None, False)}
    assert sorted(asked) == ["b", "bad"] and _rows(cache) == {"a": "A", "b": "B"}
