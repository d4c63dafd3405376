"""Benchmark leaks: exact, re-parameterised and inconsistent ones."""

import random
import re
from collections import defaultdict

import pytest

from linewright.llm import decontam

ITEM = "So Mary buys 3 apples for 9 euros. Later Mary gives 3 apples to the poor and walks 2 miles home"


def leaked(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(spark, docs, bench).collect()}


def test_slots(spark):
    found = leaked(
        spark,
        [
            f"Some words before. {ITEM}. And after.",
            "And so Ina buys 44 apples for 19 dollars. Later Ina gives 44 apples to the poor and walks 8 km home",
            "And so Ina buys 44 apples for 19 dollars. Later Bob gives 45 apples to the poor and walks 8 km home",
            "Nothing of this kind stands in here at all, however long one reads on and on and on",
            None,
            "",
        ],
    )
    assert set(found) == {(0, 0), (1, 0)}
    assert found[0, 0]["n_changed"] == 0 and found[1, 0]["n_changed"] > 0


def test_lightly_edited_copies(spark):
    """A conflict between two slots takes the windows that have it, not the verbatim or untouched ones."""
    plain = [f"{c}{v}{d}" for c in "bdfgk" for v in "aeiou" for d in "lm"]
    item = " ".join(["we", "saw", "Anna", *plain[:18], "and", "Anna", *plain[18:40], "then", "5", *plain[40:], "with", "Otto"])
    twice, same = item.replace("and Anna", "and Ines"), item.replace("Otto", "Anna")
    renamed = item.replace("Anna", "Ines").replace("and Ines", "and Maja").replace("5", "8")
    torn = "we saw Ines bal bam bel Maja bem bil Maja"
    found = leaked(spark, [twice, same, renamed, torn, "we met " + item], (item, "we saw Anna bal bam bel Anna bem bil Anna"))
    assert {d for d, i in found if i == 0} == {0, 1, 2, 4}
    assert (3, 1) not in found
    windows = {d: found[d, 0]["n_windows"] for d in (0, 1, 2, 4)}
    assert windows[4] == found[4, 0]["item_windows"] > windows[0] > windows[2] >= decontam.ENOUGH
    assert found[0, 0]["n_changed"] == 0 and found[2, 0]["n_changed"] == 1


def test_exact_passages_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} "
    texts = {i: plain(t) for i, t in docs.collect()}
    expected = {(i, k) for k, item in bench.collect() for i, t in texts.items() if plain(item) in t}
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark, docs, bench).collect()}
    assert found == expected and expected
    kept = {r["doc_id"] for r in decontam.keep_clean(spark, docs, bench).collect()}
    assert kept == set(texts) - {i for i, _ in expected}


def canonical(text, opening=True):
    """(lower-cased words of one slot or the word, kind) of each template word, one by one."""
    words, end = [], 0
    spelled = decontam.ONES + decontam.TEENS + decontam.TENS + decontam.SCALES
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
        word, low, gap = m[0], m[0].lower(), text[end : m.start()]
        opens = bool(re.search(r"[\n!.:?]", gap)) if words else opening
        digit = bool(re.fullmatch("[0-9]+", word))
        capital = not opens and len(word) > 1 and word[0].isupper() and not any(c.isupper() for c in word[1:])
        number = digit or low in spelled
        joins = False
        if words:
            before = words[-1]
            joins |= digit and before["digit"] and gap in (".", ",")
            joins |= gap in (" ", "-") and before["low"] in decontam.TENS and low in decontam.ONES
            joins |= gap == " " and (before["number"] and low in decontam.SCALES or before["low"] in decontam.SCALES and number)
            joins |= gap == " " and capital and before["capital"]
        words.append({"low": low, "digit": digit, "capital": capital, "number": number, "opens": opens, "joins": joins, "at": m.start(), "end": m.end()})
        end = m.end()
    out = []
    for i, w in enumerate(words):
        if w["joins"]:
            continue
        j = next((j for j in range(i + 1, len(words)) if not words[j]["joins"]), len(words))
        own = text[w["at"] : words[j - 1]["end"]].lower()
        kind = "number" if w["number"] else None
        if not kind and not w["opens"] and out and out[-1][1] == "number" and own in decontam.UNITS:
            kind = "unit"
        elif not kind and w["capital"]:
            kind = "name"
        out.append((own, kind))
    return out


def plain_leaks(docs, items):
    found = {}
    for i, text in docs.items():
        words = canonical(text)
        for k, item in items.items():
            usual = canonical(item)
            diagonals = defaultdict(dict)
            for own in (usual, canonical(item, opening=False)):
                n, first = min(decontam.WINDOW, len(own)), own is not usual
                for p in range(1 if first else len(own) - n + 1) if n >= decontam.LITERALS else ():
                    back = len(own) - p
                    for q in range(len(words) - n + 1):
                        a, b = own[p : p + n], words[q : q + n]
                        slots = [x[1] is not None for x in a]
                        if [x[0] for x in a] == [x[0] for x in b]:
                            diagonals[first, q + back].setdefault(back, set()).add(())
                        if any(slots) and n - sum(slots) >= decontam.LITERALS and all(x[1] == y[1] and (x[1] or x[0] == y[0]) for x, y in zip(a, b)):
                            diagonals[first, q + back].setdefault(back, set()).add(tuple((x[0], y[0]) for x, y in zip(a, b) if x[1]))
            count = len(usual) - min(decontam.WINDOW, len(usual)) + 1
            if len(usual) < decontam.LITERALS:
                continue
            places = set()
            for windows in diagonals.values():
                pairs = {pair for seen in windows.values() for w in seen for pair in w}
                torn = lambda pair: sum(pair[0] == o[0] for o in pairs) > 1 or sum(pair[1] == o[1] for o in pairs) > 1  # noqa: E731, B023
                places |= {p for p, seen in windows.items() if any(all(a == b for a, b in w) or not any(map(torn, w)) for w in seen)}
            other = len(canonical(item, opening=False))
            fewer = len(usual) - other if other >= decontam.LITERALS else 0
            if len(places) >= min(decontam.ENOUGH, max(1, count - fewer)):
                found[i, k] = min(count, len(places))
    return found


@pytest.mark.parametrize("spread", [decontam.SPREAD, 2])
def test_reparameterised_questions_by_brute_force(spark, sentences, monkeypatch, spread):
    monkeypatch.setattr(decontam, "SPREAD", spread)
    r = random.Random(3)
    numbers = ["2.5", "1,200", "12,345.75", "twenty-five", "three hundred", "two", "4 million", "ninety"]
    draw = {"N": lambda: r.choice([str(r.randint(1, 30)), r.choice(numbers)]), "P": lambda: r.choice(["Mary", "Bob", "New York", "Hong Kong", "Otto"]), "U": lambda: r.choice(["km", "kg", "euros", "hours"])}
    common = "read the text and then answer the question below in one word please"
    shapes = []
    for k in range(8):
        words = sentences(r.randint(12, 30), 300 + k).split()
        for _ in range(r.randint(1, 6)):
            at = r.randrange(1, len(words))
            words[at:at] = r.choice([["N"], ["N", "U"], ["P"]])
        shapes.append((common if k % 2 else "") + " " + " ".join(words))
    fill = lambda shape: " ".join(draw[w]() if w in draw else w for w in shape.split())
    items = {k: fill(shape) for k, shape in enumerate(shapes)}
    items |= {20: "one two three four five six", 21: "8 9 10 11 Mary 12 13 14 15 16", 22: "two words", 23: "Why is a b c d e f g h i j k"}
    docs = {i: f"{sentences(10, i)} {fill(shapes[i % 8])} {sentences(10, 50 + i)}" for i in range(24)}
    docs |= {30: common, 31: "x one two three four five six y", 32: "z 8 9 10 11 Mary 12 13 14 15 16 z", 33: "so Why is a b c d e f g h i j k", 34: "one two three four five"}
    items |= {24: "Hong Kong is a b c d e f", 25: "Hong Kong is a b c d"}
    docs |= {37: "so Hong Kong is a b c d e f", 38: "Hong Kong is a b c d e f", 39: "in Hong Kong is a b c d"}
    docs |= {35: items[1] + ". " + items[2].upper(), 36: items[3].lower()}
    got = leaked(spark, [docs.get(i) for i in range(40)], [items.get(k) for k in range(26)])
    assert {pair: row["n_windows"] for pair, row in got.items()} == plain_leaks(docs, items)
    assert {(31, 20), (32, 21), (33, 23), (37, 24), (38, 24), (38, 25), (39, 25)} <= set(got) and (34, 20) not in got and 10 < len(got) < 200


def test_edges(spark, edge_docs, edge_rows, no_docs):
    bench = spark.createDataFrame([(1, edge_rows[0][1][:400]), (2, None), (None, "x"), (3, ""), (4, "one two")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark, edge_docs, bench).collect()}
    assert found == {(1, 1), (2, 1), (3, 1)}
    kept = decontam.keep_clean(spark, edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.filter("doc_id IS NULL").count() == 2
    assert decontam.leaks(spark, no_docs, bench).count() == 0
    assert decontam.leaks(spark, edge_docs, bench.limit(0)).count() == 0


def test_whole_numbers_and_names(spark):
    """Decimals, grouped and spelled numbers and names of several words are one slot each."""
    trip = "so a train that leaves Paris for Rome covers 900 km in 8 hours and 3 minutes, how far does it go from Paris in 3 minutes"
    changed = [
        trip.replace("900", "1,200").replace("8", "7.5").replace("3", "2.5"),
        trip.replace("Paris", "New York").replace("Rome", "Hong Kong"),
        trip.replace("900", "nine hundred").replace("8", "twenty-five").replace("3", "fifteen"),
        trip.replace("Paris", "New York City").replace("Rome", "Oslo").replace("900", "1.234,5").replace("3", "forty"),
        trip.replace("3 minutes, how", "4 minutes, how"),
        trip.replace("900", "700").replace("8", "5").replace("3", "4"),
        trip.replace("Paris", "Berlin").replace("Rome", "Madrid"),
    ]
    found = leaked(spark, [trip, *changed], (trip,))
    assert {d for d, _ in found} == set(range(8))
    windows = [found[d, 0]["n_windows"] for d in range(8)]
    assert windows[1] == windows[3] == windows[6] and windows[2] == windows[7]  # as with plain values
    assert windows[0] == found[0, 0]["item_windows"] > windows[5]
