"""Quality rules against plain code."""

import re
from collections import Counter

from linewright.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base


def test_counts(spark, edge_docs, edge_rows):
    extra = ["w1 w2 w3 w1 w2 w3", "a b c\na b c\n\n \na b c", "x" * 30 + " a b a b a b " * 30, "# $ % | < > & *\n" * 3]
    rows = edge_rows + [(100 + i, t, "en", "s", None) for i, t in enumerate(extra)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(quality.report(docs).collect(), key=repr)
    expected = sorted(((i, *plain(t)) for i, t, *_ in rows), key=repr)
    assert sorted([tuple(r)[:7] for r in got], key=repr) == expected
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    assert quality.report(edge_docs).count() == len(edge_rows)


def test_keep_returns_the_given_columns(spark, edge_docs, no_docs):
    kept = quality.keep(edge_docs)
    assert kept.columns == edge_docs.columns and kept.filter("doc_id = 1").count() == 1 and kept.filter("text IS NULL").count() == 0
    assert quality.keep(no_docs).count() == 0 and quality.report(no_docs).count() == 0


def test_no_user_functions(spark, edge_docs):
    plan = quality.report(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_good_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.report(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.5 * len(bad)
