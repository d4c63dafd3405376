"""Normal frames against plain code, on random nestings of frames of all kinds."""

import random
import re

from pyspark.sql import functions as F

from linewright.operators import layout


def wide(text):
    return sum(1 if ord(c) < 128 else 2 for c in text)


def last_run(line, char):
    """(left, run, tail) of the last run of three or more, if at most four characters follow."""
    bare = line.rstrip("\r\n 　")
    runs = list(re.finditer(f"{re.escape(char)}{{3,}}", bare))
    if not runs or len(bare[runs[-1].end() :].strip(" 　")) > 4:
        return None, bool(runs)
    return (bare[: runs[-1].start()], runs[-1][0], bare[runs[-1].end() :]), True


def border_kind(line):
    over, any_over = last_run(line, "￣")
    if any_over:
        safe = over and over[0].rstrip(" 　")[-1:] in tuple("´'") and set(over[2]) & set("｀ヽﾍ")
        return 1 if safe else 0
    under, _ = last_run(line, "＿")
    return 2 if under and under[0].rstrip(" 　")[-1:] in tuple("乂ヽ丶") and set(under[2]) & set("ノﾉ") else 0


def plain_boxes(lines):
    found, used = [], set()
    for kind, top, bottom in layout.KINDS:
        ends = {p: re.compile(p.replace("(?U)", "")) for p in (top, bottom)}
        is_top = [bool(ends[top].search(line)) for line in lines]
        is_low = [bool(ends[bottom].search(line)) and not t for line, t in zip(lines, is_top)]
        for i in range(len(lines)):
            if is_top[i] and i not in used:
                j = next((j for j in range(i + 1, min(i + 31, len(lines))) if is_low[j] and j not in used), None)
                if j is not None:
                    found.append((i, j, kind))
                    used |= set(range(i, j + 1))
    marks = [(i, border_kind(line)) for i, line in enumerate(lines) if i not in used and border_kind(line)]
    for (i, a), (j, b) in zip(marks, marks[1:]):
        if (a, b) == (1, 2) and j - i <= 30:
            found.append((i, j, "normal"))
    return sorted(found)


def plain_normal(lines):
    rows = []
    for line in lines:
        bare = line.rstrip("\r\n 　")
        borders = [(c, last_run(line, c)[0]) for c in "￣＿" if last_run(line, c)[0]]
        token = re.search(r"^(.*?[^ .　])[ .　]+([^ .　]{1,3})\Z", bare, re.S)
        if not line:
            rows.append(("blank", line, "", ""))
        elif borders:
            rows.append(("border", borders[0][1][0], borders[0][0], borders[0][1][2]))
        elif token and set(token[2]) & set("│｜|〉》>）)ノﾉ＼ヽ｝}］]"):
            rows.append(("side", token[1].rstrip(","), "", token[2]))
        else:
            rows.append(("text", bare.rstrip(","), "", ""))
    first = next(((r, line) for r, line in zip(rows, lines) if r[0] == "border"), None)
    spoken = [wide(re.split(r"[|│｜]", r[1])[-1].rstrip(" .　")) for r in rows if r[0] == "side" and re.search(r"[|│｜]", r[1])]
    widest = max(spoken, default=0)
    if not widest and not first:
        return None
    target = (wide(first[0][1]) + wide(first[0][3]) if first else 0) + widest if widest else wide(first[1].rstrip("\r\n 　"))
    out = []
    for part, left, char, right in rows:
        if part == "border":
            room = widest if widest else target - wide(left) - wide(right)
            n = max(room, 0) // 2
            n += (n + 1) * 2 - room < room - n * 2
            out.append(left + char * n + right)
        elif part == "side":
            left = left.rstrip(" .　")
            room = target - wide(right) - wide(left)
            out.append(left + "　" * (max(room, 0) // 2) + " " * (max(room, 0) % 2) + right)
        else:
            out.append(left)
    return out


PIECES = [
    "f´￣￣￣｀ヽ", " (x)  f´￣￣￣￣￣｀ヽ　", "'￣￣￣ ヽ", "f￣￣￣ヽ", "f´￣￣￣abcdヽ", "f´￣￣￣ヽ￣￣￣x", "´￣￣ヽ", "乂＿＿＿ノ", "  乂 ＿＿＿＿＿ ﾉ ", "＿＿＿ノ", "乂＿＿＿ノ ￣￣￣", "ヽ＿＿＿xノ\r",
    "| some words  |", "|a, b,,   )", "｜wörds　　ﾉ", "a | b | c  │", "no side", "", "   ", ",,,", "x|   abcd", "| 漢字. |", "|....  |",
    "┌──┐", "│ab│", "└──┘", "＼─|──|──|─／", "／─|──|──|─＼", "､_人人人_", "⌒Y⌒Y⌒Y",
]


def pages(n, seed):
    r = random.Random(seed)
    weights = [1] * len(PIECES)
    weights[0] = weights[7] = weights[12] = 5
    return ["\n".join(r.choices(PIECES, weights, k=r.choice([3, 8, 30, 70]))) for _ in range(n)]


def test_random_nestings(spark):
    texts = pages(150, 1)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = frame.select("text", layout.boxes(F.split("text", "\n", -1)).alias("b")).collect()
    found = [[tuple(b) for b in r["b"]] for r in got]
    assert found == [plain_boxes(r["text"].split("\n")) for r in got]
    assert {k for f in found for *_, k in f} == {"shout", "slash", "box", "normal"}


def test_random_frames_redrawn(spark):
    texts = [t for t in pages(200, 2) if not re.search("[┌└＼／人⌒]", t)] + ["", "a\n─── |", "x\n|---", "=== ヽ\n|a b  |"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    every = F.struct(F.lit(0).alias("top"), (F.size(F.split("text", "\n", -1)) - 1).alias("bottom"))
    got = frame.select("text", layout.redraw_normal(F.split("text", "\n", -1), every).alias("own"), layout.adjust_selection(F.col("text")).alias("selected")).collect()
    assert [r["own"] for r in got] == [plain_normal(r["text"].split("\n")) for r in got]
    for r in got:
        bordered = any(last_run(line, c)[0] for line in r["text"].split("\n") for c in "￣＿─-=")
        assert r["selected"] == ("\n".join(r["own"]) if bordered and r["own"] else None)


def test_whole_documents(spark):
    texts = pages(60, 3)
    got = layout.adjust(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        lines = text.split("\n")
        frames = plain_boxes(lines)
        assert r["n_boxes"] == len(frames)
        now = r["text"].split("\n")
        assert len(now) == len(lines)
        covered = {i for a, b, _ in frames for i in range(a, b + 1)}
        assert all(now[i] == lines[i] for i in range(len(lines)) if i not in covered)
        inner = {i for a, b, k in frames if k != "normal" for i in range(a, b + 1)}
        for a, b, kind in frames:
            if kind == "normal" and not inner & set(range(a, b + 1)):
                assert now[a : b + 1] == plain_normal(lines[a : b + 1])
