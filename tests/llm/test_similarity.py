"""The similarity join against brute force, blocks and pruning by hand."""

import random
from math import comb

import numpy as np
import pytest

from linewright.llm import graph, similarity, tables


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def brute_force_rows(rows):
    """(doc_id, class_id, n_links) of each row, whatever its doc_id; copies come out of equal sets."""
    sets = [None if i is None else shingles(t) for i, t in rows]
    roots = list(range(len(rows)))
    links = [0] * len(rows)
    for x, a in enumerate(sets):
        for y in range(x):
            b = sets[y]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[x] += 1
                links[y] += 1
                old, new = roots[x], roots[y]
                roots = [new if r == old else r for r in roots]
    least = lambda r: min(rows[k][0] for k in range(len(rows)) if roots[k] == r)
    return sorted((i, least(r) if n else i, n) for (i, _), r, n in zip(rows, roots, links) if i is not None)


@pytest.fixture(params=[None, (4, 3)])
def blocks(request, monkeypatch):
    """With small blocks and tiles, members of one group meet in several pairs of both."""
    if request.param:
        least, tile = request.param
        monkeypatch.setattr(similarity, "BLOCK_LEAST", least)
        monkeypatch.setattr(similarity, "BLOCK_MOST", 2 * least)
        monkeypatch.setattr(similarity, "TILE", tile)
        monkeypatch.setattr(tables, "SHARE", 8)


def test_against_brute_force(spark, edge_rows, sentences, blocks):
    random.seed(2)
    base = sentences(150, 40).split()
    rows = [(i, t) for i, t, *_ in edge_rows]
    for i in range(60):
        words = list(base)
        for _ in range(random.randint(0, 5)):
            words[random.randrange(len(words))] = f"z{random.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, rows[-1 - i][1].upper()) for i in range(10)]
    got = [tuple(r) for r in similarity.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got.count((None, None, 0)) == 2
    assert sorted(r for r in got if r[0] is not None) == brute_force_rows(rows)


def test_repeated_ids_against_brute_force(spark, edge_rows, sentences, blocks):
    """A repeated row counts as often as it stands; texts that differ under one doc_id stay apart."""
    base, other = sentences(150, 41), sentences(90, 42)
    near = lambda text, k: " ".join([*text.split()[:k], f"w{k}", *text.split()[k + 1 :]])
    rows = [(i, t) for i, t, *_ in edge_rows]
    rows += [(50, base), (51, other), (50, near(other, 30)), (52, near(base, 70)), (50, near(base, 10)), (50, base.upper())]
    rows += [(60, near(base, 90))] * 12 + [(49, other), (61, None), (61, other), (61, near(base, 120))]
    found = similarity.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found if r["doc_id"] is not None) == brute_force_rows(rows)


def test_two_repeats_are_two_links(spark, sentences):
    near = " ".join([*sentences(120, 1).split()[:50], "changed", *sentences(120, 1).split()[51:]])
    rows = [(1, sentences(120, 1)), (3, near), (3, near)]
    found = similarity.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 2), (3, 1, 2), (3, 1, 2)]


def test_a_row_for_each_row(spark, edge_docs, edge_rows, no_docs):
    assert similarity.classes(spark, edge_docs).count() == len(edge_rows)
    assert similarity.classes(spark, no_docs).count() == 0


def test_keep_one(spark, edge_docs):
    kept = similarity.keep_one(spark, edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids[0] == 1 and 2 not in ids and 3 not in ids and 4 in ids and 7 in ids and 8 not in ids
    assert len(ids) == len(set(ids))


def test_keep_one_row_of_each_class(spark, edge_docs, edge_rows, sentences):
    """Rows without doc_id stay, repeated rows do not, and texts under one doc_id are told apart."""
    base, other = sentences(120, 1), sentences(90, 42)
    more = [(1, base), (1, base.upper()), (1, other), (20, other), (4, None), (4, ""), (21, sentences(50, 43)), (21, sentences(50, 44)), (None, other)]
    added = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], edge_docs.schema.fieldNames()[:5])
    docs = edge_docs.unionByName(added, allowMissingColumns=True)
    kept = similarity.keep_one(spark, docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], " ".join((r["text"] or "").lower().split())) for r in kept.select("doc_id", "text").collect()]
    fold = lambda t: " ".join((t or "").lower().split())
    expected = [(i, t) for i, t, *_ in edge_rows if i is None or i in (4, 5, 6, 7, 9, 10, 11, 12, 13, 14)] + [(1, base), (1, other), *more[6:]]
    assert sorted(rows, key=str) == sorted(((i, fold(t)) for i, t in expected), key=str)


def test_recall_on_a_whole_table(spark):
    """Every pair of the exact join, found through shared shingles, is linked; so recall is 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    holders = {}
    for i, own in sets.items():
        for g in own or ():
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in holders.values() for x, a in enumerate(ids) for b in ids[x + 1 :]}
    links = dict.fromkeys(sets, 0)
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
    assert {r["doc_id"]: r["n_links"] for r in similarity.classes(spark, docs).collect()} == links and sum(links.values()) > 0


def test_pruning_rule():
    least = similarity.least_matches(0.8, 1e-6)
    for k, fewest in enumerate(least):
        n = similarity.STEP * (k + 1)
        posterior = lambda m: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))
        assert posterior(int(fewest)) >= 1e-6 and (fewest == 0 or posterior(int(fewest) - 1) < 1e-6)


def test_minhash_estimates_similarity():
    random.seed(4)
    a = np.array(random.sample(range(1 << 62), 400), np.uint64)
    b = np.concatenate((a[:350], np.array(random.sample(range(1 << 62), 50), np.uint64)))
    x, y = (np.frombuffer(similarity.minhash(s), "<u2") for s in (a, b))
    assert abs((x == y).mean() - 350 / 450) < 0.15


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
