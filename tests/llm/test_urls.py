"""URL filters: rules against plain code, segmentation against all splits, verdicts on held-out names."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from linewright.llm import urls

SCHEMA = "page_id long, url string, html string"


def plain_rule(url):
    url = url or ""
    after = url.partition("://")[2]
    end = min((after.find(c) for c in "/?#" if c in after), default=len(after))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in after[:end])
    path = after[end:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, None))


URLS = [
    "http://example.net/", "http://EXAMPLE.net/en/x", "https://a.example.net/de/", "net/x", "http://net", "http://net/", "http://a.net?x=/en/", "http://a.net#/", None, "", "://", "http://",
    "http://xexample.net/en/", "http://www.example.com/de/1", "http://example.com/dex", "http://b.org/fr/2?q#f", "http://org/fr/", "ftp://u@h.org:80/fr/", "http://a.org/FR/", "http://É.com/é%20b/c#d?e",
    "http://a://b.net/", "mailto:x@y.net", "http://a\nb.net/x\ny", "http:///en/", "http://.net/", "x" * 5000 + "://" + "y" * 5000 + ".net/" + "z" * 5000,
]


def test_rules(spark):
    rows = [(i, u, "") for i, u in enumerate(URLS)] + [(None, None, None), (3, URLS[3], None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("host", "path", "rule", "words", "score", "n", "x.y", "a b")})
    got = urls.judge(spark, frame).collect()
    assert len(got) == len(rows)
    assert {(r["page_id"], r["host"], r["path"], r["rule"]) for r in got} == {(i, *plain_rule(u)[:3]) for i, u, _ in rows}
    for r in got:
        ruled = dict((text, v) for v, text in urls.RULES).get(r["rule"])
        assert r["verdict"] == (ruled or ("block" if r["score"] > 0.5 else "allow"))
    assert {r["verdict"] for r in got if not r["host"]} == {"allow"}
    assert urls.judge(spark, frame.limit(0)).collect() == []


def test_split_is_the_most_probable():
    known = urls.Lexicon({w: math.log(p) for w, p in {"a": 0.02, "ab": 0.03, "aba": 0.0004, "b": 0.01, "ba": 0.05, "bab": 0.001}.items()}, math.log(1e-4))
    cost = lambda w: known.words.get(w, known.unknown - math.log(10) * len(w))
    for n in range(1, 8):
        for run in map("".join, itertools.product("abc", repeat=n)):
            best = max(sum(cost(run[i:j]) for i, j in itertools.pairwise((0, *cuts, n))) for k in range(n) for cuts in itertools.combinations(range(1, n), k))
            parts = known.split(run)
            assert "".join(w for w, _ in parts) == run
            assert math.isclose(sum(cost(w) for w, _ in parts), best)
            assert all(k == (w in known.words) for w, k in parts)


def pages(blocked, allowed, times=4):
    rows = [(f"http://www.{h}.com/en/{i}.html", "<p>some words of a page about a garden, a library and the weather</p>") for h in (*blocked, *allowed) for i in range(times)]
    return [(i, u, t) for i, (u, t) in enumerate(rows)]


def test_words_learned_beside_seeds_block(spark):
    """goldrush stands with casino in the corpus only; alone, and joined with other words, it is blocked too."""
    blocked = ["casino-goldrush", "goldrushcasino", "best-goldrush-slots", "goldrush-poker"]
    allowed = ["garden-library", "weatherpage", "library-words", "gardenpage", "some-page", "about-weather", "bestgarden"]
    held = ["mygoldrushgoldrush", "goldrush-goldrush", "casinopoker"]
    clean = ["weathergarden", "thelibrary", "unknownname", "best-library"]
    got = urls.judge(spark, spark.createDataFrame(pages(blocked, allowed) + [(1000 + i, f"http://{h}.org/en/1", "") for i, h in enumerate([*held, *clean])], SCHEMA)).collect()
    verdicts = {r["host"].split(".")[-2]: r["verdict"] for r in got}
    assert {h for h, v in verdicts.items() if v == "block"} == {*blocked, *held}
    words = {r["host"].split(".")[-2]: r["words"] for r in got}
    assert "casino poker" in words["casinopoker"] and "weather garden" in words["weathergarden"]


@pytest.mark.parametrize("names", [["garden-library", "some-page"], []])
def test_nothing_to_learn_from(spark, names):
    got = urls.judge(spark, spark.createDataFrame(pages([], names), SCHEMA)).collect()
    assert {r["verdict"] for r in got} <= {"allow"} and len(got) == 4 * len(names)


def test_whole_table(spark, tiny):
    table = spark.read.parquet(f"{tiny}/pages.parquet")
    got = urls.op12_url_filters(spark, tiny).collect()
    want = {r["page_id"]: plain_rule(r["url"]) for r in table.collect()}
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got} == {k: v[:3] for k, v in want.items()}
    assert all(r["verdict"] == want[r["page_id"]][3] for r in got if r["rule"])
