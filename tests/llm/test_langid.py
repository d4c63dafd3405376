"""Language identification: forward-backward by brute force, held-out accuracy, defined cases."""

import zlib
from itertools import product

import numpy as np

from linewright.llm import langid


def test_forward_backward_by_enumeration():
    draws = np.random.default_rng(1)
    scores, moves, starts = draws.normal(size=(3, 4, 3)), draws.normal(size=(3, 3)), draws.normal(size=3)
    real = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    scores[~real] = 0
    post, joint, logz = langid.posteriors(scores, real, moves, starts)
    expected_joint = np.zeros((3, 3))
    for c in range(3):
        n = real[c].sum()
        weight, marginal = 0.0, np.zeros((n, 3))
        pairs = np.zeros((3, 3))
        for path in product(range(3), repeat=n):
            w = np.exp(starts[path[0]] + sum(scores[c, t, path[t]] for t in range(n)) + sum(moves[path[t], path[t + 1]] for t in range(n - 1)))
            weight += w
            for t in range(n):
                marginal[t, path[t]] += w
            for t in range(n - 1):
                pairs[path[t], path[t + 1]] += w
        assert np.allclose(post[c, :n], marginal / weight) and np.isclose(logz[c], np.log(weight))
        expected_joint += pairs / weight
    assert np.allclose(joint, expected_joint)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in unseen) >= 0.98 * len(unseen)


def test_code_switching_and_edges(spark, edge_docs, edge_rows, no_docs):
    english, german = "the house and the garden with those things there".split(), "der garten und das haus mit einer schönen straße".split()
    model = langid.fit([("en", english * 4), ("de", german * 4)] * 6)
    labeller = langid.Labeller(model)
    total, votes = labeller.sums([english + german, german, []])
    assert votes[0].tolist() == [9, 9] and total[1].argmax() == model.labels.index("de") and total[2].sum() == 0
    rows = langid.predict(spark, edge_docs, model).collect()
    assert len(rows) == len(edge_rows)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in rows)
    by_id = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert by_id[4] == by_id[5] == by_id[6] == "und" and by_id[1] != "und"
    assert langid.predict(spark, no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(spark, edge_docs, None).collect()} == {"und"}
    assert langid.sample(no_docs) == []


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "REMEMBERED", 5)
    model = langid.fit([("en", ["the", "house"] * 20), ("de", ["der", "garten"] * 20)] * 3)
    labeller = langid.Labeller(model)
    first = labeller.sums([["the", "house", "a", "b"], ["der"]])[0]
    labeller.sums([["c", "d", "e", "f"]])
    assert np.allclose(labeller.sums([["the", "house", "a", "b"], ["der"]])[0], first) and len(labeller.place) <= 8


def test_documents_by_plain_code(spark):
    """Chains of CHAIN words, sums over a document and the choice of its label, in loops over single words."""
    import math
    import random

    r = random.Random(9)
    words = {lang: [f"{r.choice(ends)}{r.choice('aeiou')}{r.choice(ends)}" for _ in range(60)] for lang, ends in (("aa", "bdg"), ("bb", "klm"), ("cc", "rst"))}
    model = langid.fit([(lang, [r.choice(w) for _ in range(80)]) for lang, w in words.items() for _ in range(4)])
    texts = [" ".join(r.choice(words[lang]) for lang in r.choices(list(words), [3, 2, 1], k=n)) for n in (1, 5, langid.CHAIN, langid.CHAIN + 1, 200)] + ["aa", "12 !", None]
    k = len(model.labels)

    def plain(text):
        own, sums = langid.words_of(text or ""), [0.0] * k
        for at in range(0, len(own), langid.CHAIN):
            chain = own[at : at + langid.CHAIN]
            e = [[math.exp(sum(float(model.weights[model.index[f], j]) for f in langid.features(w) if f in model.index)) for j in range(k)] for w in chain]
            move = [[math.exp(float(model.moves[i, j])) for j in range(k)] for i in range(k)]
            ahead = [[math.exp(float(model.starts[j])) * e[0][j] for j in range(k)]]
            for x in e[1:]:
                ahead.append([sum(ahead[-1][i] * move[i][j] for i in range(k)) * x[j] for j in range(k)])
                total = sum(ahead[-1])
                ahead[-1] = [v / total for v in ahead[-1]]
            back = [[1.0] * k]
            for x in e[:0:-1]:
                back.append([sum(move[i][j] * x[j] * back[-1][j] for j in range(k)) for i in range(k)])
                total = sum(back[-1])
                back[-1] = [v / total for v in back[-1]]
            for a, b in zip(ahead, back[::-1]):
                total = sum(x * y for x, y in zip(a, b))
                sums = [s + x * y / total for s, x, y in zip(sums, a, b)]
        best = max(range(k), key=lambda j: (sums[j], -j))
        return (model.labels[best], sums[best] / sum(sums)) if sum(sums) else ("und", 0.0)

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in langid.predict(spark, frame, model).collect():
        label, score = plain(texts[row["doc_id"]])
        assert row["lang_pred"] == label and abs(row["score"] - score) < 1e-3


def test_sample_is_even_whatever_repeats(spark):
    rows = [(1, "tick tock " * 20, "aa")] * 300 + [(i, f"word{i} some thing", "bb") for i in range(2, 40)] + [(i, f"mot{i}", "cc") for i in range(40, 80)]
    taken = [lang for lang, _ in langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=30)]
    assert set(taken) == {"aa", "bb", "cc"} and taken.count("aa") == 1 and max(map(taken.count, ("bb", "cc"))) <= 10
