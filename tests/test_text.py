"""Fixtures for extraction, glossaries, translation, search and scalars."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linewright.functions import nesting, rx, scalar
from linewright.operators import extract, glossary, lines, search, translate
from linewright.sources import html

SOURCE = "\n".join(
    [
        "作品の題名", "", "4402 ： ◆ABCD1234ef ： 2021/05/06(木) 23:19:36 ID:nGcM5Umt", "　　／￣￣＼　　今日はいい天気ですね。",
        "１．判定は【1D10:10】です", "（何してんの？　何してんの？　青葉、何してんの？）", "ノツ人乂彡ミ三王丁", "「それは本当か？」と言った　お？", "ABCD1234ef", "… あ！　あ！",
    ]
)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_extraction(spark):
    docs = spark.createDataFrame([(1, SOURCE), (2, None), (3, "")], "doc_id int, text string")
    config = extract.Config(skip_title="作品の題名", author="◆ABCD1234ef")
    rows = extract.with_ids(extract.all_fragments(docs, config)).orderBy("seq").collect()
    assert [f"{r['frag_id']}|{r['text']}" for r in rows] == [
        "004-1|今日はいい天気ですね。", "005-1|判定は【1D10:10】です", "006-1|（何してんの？", "006-2|（何してんの？", "006-3|青葉、何してんの？）",
        "008-1|「それは本当か？」と言った", "008-2|　お？", "010-1| あ！", "010-2|　あ！",
    ]
    reasons = {r["line_no"]: r["reason"] for r in extract.trace(docs, config).collect() if r["line_no"] in (1, 3, 7, 9)}
    assert reasons[1] == "title" and reasons[3] == "poster line" and reasons[9] in ("author", "invalid") and reasons[7] in ("symbols", "invalid")


def test_invalid_patterns_fall_back():
    config = extract.Config(base="([", invalid="(", symbol="[").checked()
    assert (config.base, config.invalid, config.symbol) == (extract.BASE, extract.INVALID, extract.SYMBOL)


def test_glossary_parse(spark):
    text = ["Hello = World", "` Trooper `=Trooper", "ライザリン\\・シュタウト=萊莎琳\\・斯托特", "D\\・E=only", "A=1", "A=2", "C=a=b", "B=", "=x", "no equals"]
    rows = glossary.parse(spark.createDataFrame(list(enumerate(text)), "pos int, line string")).collect()
    assert {r["key"]: r["value"] for r in rows} == {
        "Hello": "World", " Trooper ": "Trooper", "ライザリン": "萊莎琳", "シュタウト": "斯托特", "D\\・E": "only", "A": "2", "C": "a=b", "B": "",
    }
    assert one(spark, glossary.encode_term, " x") == "` x`" and one(spark, glossary.encode_term, "x") == "x"


def test_glossary_apply_and_reverse(spark):
    terms = {"おはよう": "早", "やる夫": "亞魯夫"}
    assert one(spark, lambda t: glossary.apply(t, terms), "│おはよう　やる夫│ おはよう") == "│早　　　　亞魯夫│ 早"
    assert one(spark, lambda t: glossary.reverse(t, {"早": "おはよう"}), "│早　　　│") == "│おはよう│"
    pairs = spark.createDataFrame([(0, "ab", "v"), (1, "cd", "v"), (2, "ab", "w"), (3, "xyz", "w")], "pos int, key string, value string")
    assert {r["value"]: r["key"] for r in glossary.reverse_map(pairs).collect()} == {"v": "ab", "w": "xyz"}


def test_glossary_apply_against_plain_code(spark):
    random.seed(5)
    terms = {"ab": "x", "abc": "yy", "b|": "q", "c$": "", "a": "long"}
    rows = ["".join(random.choice("abc$|│｜┃ ") for _ in range(random.randint(0, 14))) for _ in range(300)]

    def plain(line):
        order = sorted(terms, key=len, reverse=True)
        out, i = "", 0
        while i < len(line):
            hit = next((t for t in order if line.startswith(t, i)), None)
            if hit is None:
                out, i = out + line[i], i + 1
                continue
            i += len(hit)
            value = terms[hit]
            pad = "　" * max(0, len(hit) - len(value)) if set(line[i:]) & set("|│｜┃") else ""
            out += value + pad
        return out

    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", glossary.apply(F.col("t"), terms).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [plain(r) for r in rows]


def test_merges(spark):
    frame = lambda xs: spark.createDataFrame(list(enumerate(xs)), "pos int, line string")
    merged = glossary.merge(frame(["a=1", "b=2", "# note"]), frame(["b=9", "c=3", "c=4", "memo"])).orderBy("part", "pos").collect()
    assert [r["line"] for r in merged] == ["a=1", "b=9", "# note", "c=4", "memo"]
    rules = glossary.merge_lines(frame(["x", "y"]), frame(["y", "z", "z"])).orderBy("part", "pos").collect()
    assert [r["line"] for r in rules] == ["x", "y", "z"]


def test_translation(spark):
    docs = spark.createDataFrame([(1, "│おはよう　　│\nこんにちは"), (2, "x")], "doc_id int, text string")
    wire = lambda rows: translate.parse_rows(spark.createDataFrame(rows, "doc_id int, pos int, line string"))
    found = wire([(1, 0, "001-1|おはよう"), (1, 1, "002-1|こんにちは")])
    fresh = wire([(1, 0, "001-1|早安"), (1, 1, "002-1|你好"), (1, 2, "009-1|x")])
    done = {r["doc_id"]: r["text"] for r in translate.apply(docs, translate.pairs(found, fresh)).collect()}
    assert done == {1: "│早安　　　　│\n你好", 2: "x"}
    assert translate.coverage(found, fresh).first()["coverage"] == 1.0


def test_search(spark):
    docs = spark.createDataFrame([(1, "foo bar foo\nxfoo"), (2, "0123456789ABfooCDEFGHIJKLMN"), (3, None)], "doc_id int, text string")
    rows = [tuple(r) for r in search.first_hits(search.hits(docs, "foo")).collect()]
    assert rows[:3] == [(1, 0, 0, 3, "foo", "", " bar foo"), (1, 0, 8, 11, "foo", "foo bar ", ""), (1, 1, 1, 4, "foo", "x", "")]
    assert rows[3][5:] == ("…23456789AB", "CDEFGHIJKL…")
    done = search.replace_hits(docs, search.hits(docs, "foo"), "$1")
    assert {r["doc_id"]: r["text"] for r in done.collect()}[1] == "$1 bar $1\nx$1"
    assert {r["doc_id"]: r["text"] for r in search.undo(done).collect()}[1] == "foo bar foo\nxfoo"


@pytest.mark.parametrize(
    ("text", "label"),
    [("第8話", "第8話"), ("第８話", "第8話"), ("第十二話", "第12話"), ("番外編3", "番外編3"), ("その２１６", "その216"), ("作品　2話　副題", "第2話"), ("題\n2話", None), ("第〇話", "第0話"), ("第x話", None)],
)
def test_chapter(spark, text, label):
    found = one(spark, scalar.chapter, text)
    assert (found and found["label"]) == label


def test_scalars(spark):
    assert one(spark, scalar.kanji_to_int, "二百十六") == 216 and one(spark, scalar.kanji_to_int, "x") is None
    assert one(spark, scalar.domain, "https://www.Foo.com/x") == "foo.com"
    assert one(spark, scalar.domain, "https://web.archive.org/web/2020/https://www.bar.com/p") == "bar.com"
    assert one(spark, scalar.author_fingerprint, "12 ： N ： 2023/04/02(日) 20:54:38.52 ID:5UkYdPSV") == "2023/04/02(日) 20:54:38.52 ID:5UkYdPSV"
    assert one(spark, scalar.space_out, "ab\nc") == "a　　b\nc"
    assert one(spark, scalar.work_title, "やる夫短編集 X") == "X"
    assert one(spark, scalar.strip_tags_keep_color, '<b><font color="red">a</font></b><span style="color:#000">b</span>') == '<span style="color:red">a</span>b'
    assert one(spark, scalar.css_rgba, "#f00")["r"] == 255 and one(spark, scalar.css_rgba, "rgba(1,2,3,0.5)")["a"] == 0.5
    for header in ("1 名前：A[sage] x", "2 ： A ： 2021/05/06(木) x", "3 : A [] 2021/05/06(木) x"):
        assert one(spark, scalar.poster_name, header) == "A"


def test_strip_is_unicode_aware(spark):
    for text in ("　a \u001c", " b", "c", ""):
        assert one(spark, rx.strip, text) == text.strip()


def _completed(text, line):
    at, pairs = line.find(text), dict(zip(nesting.OPENING, nesting.CLOSING))
    if at < 0 or not text:
        return text
    left = "".join(c for c in text if c in nesting.OPENING + nesting.CLOSING)
    while (shorter := re.sub("|".join(re.escape(a + b) for a, b in pairs.items()), "", left)) != left:
        left = shorter
    i, j = at, at + len(text)
    for c in left:
        if c in pairs:
            j += line[j : j + 1] == pairs[c]
        else:
            i -= i > 0 and pairs.get(line[i - 1]) == c
    i -= i > 0 and line[i - 1] in pairs and line[i] != line[i - 1]
    j += j < len(line) and line[j] in pairs.values() and line[j - 1] != line[j]
    return line[i:j]


def test_brackets(spark):
    random.seed(3)
    lines_ = ["".join(random.choice("ab（）「」()😀") for _ in range(random.randint(1, 14))) for _ in range(400)]
    cut = [(t[i : i + random.randint(1, 8)], t) for t in lines_ for i in [random.randrange(len(t))]]
    cut += [("何してんの？", "（何してんの？　何してんの？）"), ("それは本当か？」と", "「それは本当か？」と"), ("zz", "abc"), ("", "（x"), ("（" * 300, "（" * 300 + "）" * 300)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cut)] + [(9999, None, "x")], "k int, t string, line string")
    got = [r["r"] for r in rows.select("k", nesting.complete_brackets(F.col("t"), F.col("line")).alias("r")).orderBy("k").collect()]
    assert got == [_completed(*c) for c in cut] + [None]
    assert got[400:403] == ["（何してんの？", "「それは本当か？」と", "zz"]


def test_spans_without_a_partner(spark):
    random.seed(4)
    opened, closed = "<span style=\"color:red\">", "</span>"
    texts = [[random.choice((opened, closed, "x")) for _ in range(random.randint(0, 12))] for _ in range(300)] + [[closed, opened] * 400, [opened] * 700 + [closed] * 500]

    def plain(parts):
        waiting, out = [], list(parts)
        for i, part in enumerate(parts):
            if part == opened:
                waiting.append(i)
            elif part == closed and waiting:
                waiting.pop()
            elif part == closed:
                out[i] = ""
        return "".join("" if i in set(waiting) else p for i, p in enumerate(out))

    rows = spark.createDataFrame([(i, "".join(t)) for i, t in enumerate(texts)] + [(9999, None)], "i int, t string")
    got = [r["r"] for r in rows.select("i", rx.let(F.col("t"), nesting.drop_unmatched_spans).alias("r")).orderBy("i").collect()]
    assert got == [plain(t) for t in texts] + [None]


def test_lines(spark):
    assert one(spark, lines.lines_with_several_ids, "001-1|a\n\n001-2|b 002-1|c") == [2]
    rows = spark.createDataFrame([(1, i) for i in range(5)], "g int, i int")
    assert [r["half"] for r in lines.halves(rows, ["i"], ["g"]).orderBy("i").collect()] == [1, 1, 1, 2, 2]


def test_matches_equal_finditer(spark):
    random.seed(1)
    rows = ["".join(random.choice("ab😀 ") for _ in range(random.randint(0, 12))) for _ in range(200)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", rx.matches(F.col("t"), "a+b?").alias("m")).orderBy("i").collect()
    assert [[(m["start"], m["end"], m["text"]) for m in r["m"]] for r in got] == [[(*m.span(), m[0]) for m in re.finditer("a+b?", r)] for r in rows]


def test_written_folders_are_read_back(spark, tmp_path):
    rows = [("a.html", "<pre>一\n二</pre>\n"), ("b", "x\x00y"), ("c.HTML", "z"), ("b", "a smaller value")]
    html.write_folder(spark.createDataFrame(rows, "file_name string, value string"), str(tmp_path / "made"))
    got = {r["file_name"]: r["value"] for r in html.read_folder(spark, str(tmp_path / "made")).collect()}
    assert got == {"a.html": rows[0][1], "b.html": "x\x00y", "c.HTML": "z"}


def test_patterns_are_checked_by_the_engine_that_runs_them(spark):
    assert rx.groups("(a)(?<x>b)") == 2 and rx.groups("[a-z&&[^b]]") == 0  # not for Python
    assert rx.groups("(?P<x>a)") is None and not rx.valid("([")  # not for Java
    frame = spark.createDataFrame([("ab",)], "t string")
    assert frame.filter(rx.any_match(frame["t"], ("(?P<x>a)",))).count() == 0


def test_matches_of_a_long_line(spark):
    frame = spark.createDataFrame([("é1" * 2000,), ("none",)], "t string")
    rows = [r["m"] for r in frame.select(rx.matches(frame["t"], "[0-9]").alias("m")).collect()]
    assert [(m["start"], m["end"], m["text"]) for m in rows[0]] == [(2 * i + 1, 2 * i + 2, "1") for i in range(2000)] and rows[1] == []


def test_edits_of_other_lines(spark):
    """Edits stay on their line; those whose id names none are tried on all."""
    docs = spark.createDataFrame([(1, "a b\na b"), (2, "a"), (3, None)], "doc_id long, text string")
    edits = [(1, "002-1", 0, "a", "X"), (1, "009-1", 1, "b", "Y"), (1, "001-1", 2, "", "Z"), (2, "nope", 0, "a", "long"), (3, "001-1", 0, "a", "b")]
    found = spark.createDataFrame(edits, "doc_id long, frag_id string, pos int, original string, translation string")
    got = {r["doc_id"]: r["text"] for r in translate.apply(docs, found).collect()}
    assert got == {1: "a Y\nX Y", 2: "long", 3: None}


def test_save_and_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "猫が\n犬", "T/a", "3"), (2, "x", "", "")], "doc_id long, text string, title string, number string")
    found = spark.createDataFrame([(1, "001-1", "猫が"), (1, "002-1", "犬"), (2, "001-1", "x")], "doc_id long, frag_id string, text string")
    fresh = spark.createDataFrame([(1, "001-1", 0, "cat")], "doc_id long, frag_id string, pos int, text string")
    made = translate.prepared(docs, found, fresh)
    row = made.first()
    assert made.count() == 1 and (row["file_name"], row["display"], row["coverage"], row["is_low"]) == ("T_a_3", "T/a_3", 0.5, False)
    translate.save(made, str(tmp_path / "out"))
    back = html.read_folder(spark, str(tmp_path / "out"))
    assert back.select(html.pre_text(back["value"]).alias("t")).first()["t"] == "cat\n犬"
