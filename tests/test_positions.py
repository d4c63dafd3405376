"""Position joins and the log of edits against plain code."""

import random

from pyspark.sql import functions as F

from linewright.operators import edits, lines, positions, search


def test_next_fragment_of_any_position(spark, monkeypatch):
    monkeypatch.setattr(positions, "BLOCK", 4)
    r = random.Random(1)
    found = [(d, line, s, f"{line:03d}-{s}") for d in range(6) for s, line in enumerate(sorted(r.choices(range(1, 40), k=r.randrange(1, 9)) + ([2] if d == 3 else [])))]
    found += [(2, 5, 99, "late"), (None, 3, 0, "none")]  # in order of seq it comes last, though its line is early
    places = [(d, line, f"p{i}") for i, (d, line) in enumerate((r.choice([*range(8), None]), r.choice([*range(0, 45), None])) for _ in range(150))]
    places += places[:3]
    got = positions.next_fragments(spark.createDataFrame(places, "doc_id long, line_no int, `a b` string"), spark.createDataFrame(found, "doc_id long, line_no int, seq long, frag_id string"))
    assert got.columns == ["doc_id", "line_no", "a b", "frag_id", "seq", "frag_line"]

    def plain(d, line):
        below = [(s, f, at) for e, at, s, f in found if d is not None and line is not None and e == d and at >= line]
        s, f, at = min(below, default=(None, None, None))
        return f, s, at

    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(((d, line, p, *plain(d, line)) for d, line, p in places), key=repr)


def test_spans_and_tops(spark, monkeypatch):
    monkeypatch.setattr(positions, "BLOCK", 3)
    r = random.Random(2)
    texts = [(i, "\n".join("".join(r.choice("ab😀 ") for _ in range(r.randrange(6))) for _ in range(r.randint(1, 14)))) for i in range(8)] + [(20, None)]
    originals = spark.createDataFrame(texts, "doc_id long, text string")
    places = [(r.choice([0, 1, 2, 3, 7, 9, 20]), r.randrange(16), r.randrange(8), r.randrange(16), r.randrange(8)) for _ in range(120)]
    places += places[:2]
    frame = spark.createDataFrame(places, "doc_id long, first_line int, first_col int, last_line int, last_col int")
    whole = dict(texts)

    def offset(text, line, col):
        rows = text.split("\n")
        line = min(line, len(rows) - 1)
        return sum(len(x) + 1 for x in rows[:line]) + min(col, len(rows[line]))

    want = [(d, a, b, c, e, t[offset(t, a, b) : max(offset(t, a, b), offset(t, c, e))]) for d, a, b, c, e in places if (t := whole.get(d)) is not None]
    assert sorted(tuple(x) for x in positions.spans(originals, frame).collect()) == sorted(want)
    one = lines.restore_range(originals.filter("doc_id = 3"), originals, (1, 2), (4, 1)).first()["text"]
    assert positions.spans(originals, spark.createDataFrame([(3, 1, 2, 4, 1)], frame.schema)).first()["text"] == one

    upper = originals.withColumn("text", F.upper("text"))
    tops = spark.createDataFrame([(d, t) for d in (0, 1, 2, 9) for t in (-1, 0, 2, 99)], "doc_id long, top int")
    got = {(x["doc_id"], x["top"]): x["text"] for x in positions.restore_from(upper, originals, tops).collect()}
    assert len(got) == 12
    for (d, t), text in got.items():
        rows = whole[d].split("\n")
        at = max(0, min(t, len(rows)))
        assert text == "\n".join([x.upper() for x in rows[:at]] + rows[at:])


def _texts(state):
    return {x["doc_id"]: x["text"] for x in state.docs.collect()}


def _outcomes(state):
    return {(x["doc_id"], x["batch"]): x["outcome"] for x in state.report.collect()}


def test_three_batches_undone_in_any_order(spark):
    """Against a replay in plain code: a file goes back only from the batch that changed it last."""
    words = ["cat dog\ncat", "dog", "cow cat", "none", None]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    state, texts, history = edits.begin(docs), dict(enumerate(words)), []
    for batch, (needle, value) in enumerate([("cat", "dog"), ("dog", "cow"), ("cow", "x$1")]):
        state = edits.replace(state, search.hits(state.docs, needle), value, batch)
        for d, t in texts.items():
            if t and needle in t:
                history.append([batch, d, t, t.replace(needle, value), False])
                texts[d] = t.replace(needle, value)
        assert _texts(state) == texts
        assert set(_outcomes(state)) == {(d, b) for b, d, *_ in history if b == batch}

    def replay(batch, only=None):
        out = {}
        for row in [h for h in history if h[0] == batch and not h[4] and (only is None or h[1] in only)]:
            if any(h[1] == row[1] and h[0] > batch and not h[4] for h in history):
                out[row[1], batch] = "later batch"
            elif texts[row[1]] != row[3]:
                out[row[1], batch] = "edited since"
            else:
                out[row[1], batch], texts[row[1]], row[4] = "undone", row[2], True
        return out

    only = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id long")
    steps = [(0, None, 0), (2, (1,), 2), (1, (1, 0), 1), (None, None, 2), (None, None, 1), (0, None, 0)]
    for batch, ids, meant in steps:
        state = edits.undo(state, batch, only(*ids) if ids else None)
        assert _outcomes(state) == replay(meant, ids)
        assert _texts(state) == texts
    assert texts == dict(enumerate(words)) and not [h for h in history if not h[4]]
    revived = edits.revived(state).filter("batch = 0 AND doc_id = 0").collect()
    assert sorted((x["line_idx"], x["match_start"], x["matched_text"]) for x in revived) == [(0, 0, "cat"), (1, 0, "cat")]


def test_edited_since(spark):
    state = edits.begin(spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string"))
    state = edits.replace(state, search.hits(state.docs, "a"), "c", 7)
    touched = state.docs.withColumn("text", F.when(F.col("doc_id") == 1, "other").otherwise(F.col("text")))
    state = edits.undo(edits.Edited(touched, state.log, state.marks, state.report))
    assert _outcomes(state) == {(1, 7): "edited since", (2, 7): "undone"} and _texts(state) == {1: "other", 2: "a"}
