from pyspark.sql import functions as F

from linewright.functions import nesting
from linewright.operators import extract, lines

CONFIG = extract.Config(base="([A-Za-z]{3,})", invalid="^(?:the)$", filters=("^th",), brackets=False)
TEXT = "alpha the beta  gamma\n\nthese\ndelta ab epsilon"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_numbering_neither_sorts_nor_shuffles(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "ab")], "doc_id long, text string")
    made = (extract.fragments(docs, CONFIG), extract.numbered(docs, CONFIG), extract.halved(docs, CONFIG), extract.written_texts(docs, CONFIG), extract.next_fragments_of(docs, 2, CONFIG))
    for frame in made:
        assert not any(node in plan(frame) for node in ("Window", "Aggregate", "Repartition"))
    assert made[3].collect() == [(1, "001-1|alpha\n001-2|beta\n001-3|gamma\n004-1|delta\n004-2|epsilon")]
    assert made[4].collect() == [(1, "004-1")]
    assert [r["half"] for r in made[2].orderBy("seq").collect()] == [1, 1, 1, 2, 2]


def test_texts_that_share_an_id_are_numbered_together(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT), (2, "one two\nthree"), (None, "alpha"), (None, "beta\ngamma")], "doc_id long, text string")
    found = extract.fragments(docs, CONFIG)
    rows = lambda frame: sorted(map(repr, frame.collect()))
    assert sorted(r["seq"] for r in found.filter("doc_id = 2").collect()) == list(range(7))
    assert sorted(r["seq"] for r in found.filter("doc_id IS NULL").collect()) == [0, 1, 2]
    places = lambda frame: sorted((r["doc_id"] or 0, r["seq"], r["line_no"], r["sub"], r["frag_id"]) for r in frame.collect())
    assert places(extract.numbered(docs, CONFIG)) == places(extract.with_ids(found))
    assert [(r["doc_id"] or 0, r["seq"], r["half"]) for r in extract.halved(docs, CONFIG).orderBy("doc_id", "seq").collect()] == [(r["doc_id"] or 0, r["seq"], r["half"]) for r in lines.halves(found, ["seq"], ["doc_id"]).orderBy("doc_id", "seq").collect()]
    assert rows(extract.next_fragments_of(docs, 2, CONFIG)) == rows(extract.next_fragment(found, 2))
    assert extract.written_texts(docs, CONFIG).count() == 3


def test_brackets_are_looked_for_near_a_fragment_only(spark):
    pairs = [("x" * 50 + "「abc」" + "y", "abc"), ("((abc", "abc"), ("「abc", "abc"), ("x「「ab」」「c", "ab」」「c"), ("abc", "abd"), ("abc）)", "(abc"), ("(", "(")]
    rows = spark.createDataFrame(pairs, "line string, text string")
    got = [r[0] for r in rows.select(nesting.complete_brackets(F.col("text"), F.col("line"))).collect()]
    assert got == ["「abc」", "(abc", "「abc", "「「ab」」「c", "abd", "(abc", "("]
