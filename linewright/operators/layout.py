"""Frames around speech: found in the lines of a document and drawn anew to fit.

Shouts, slashed frames and box-drawing frames claim lines in this order; normal frames, of
overlines and underlines with rounded corners, stand on what is left and may enclose them.

Widths come from an additive measure; by default an ASCII character is one wide and any
other two; a map of exceptions can be given, or a column with the widths of a font.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import rx
from linewright.functions.scalar import WIDE_SPACE

# The parts of frames and how far their bottom may be.
TOP = "^(.*?)┌(─+)┐(?U)\\s*$"
BOTTOM = "^(.*?)└(─+)┘(?U)\\s*$"
CONTENT = "^(.*?)│(.*)│(?U)\\s*$"
FARTHEST = 30
SHOUT_TOP = "[､、][_＿]+(?:人[_＿]*){3,}"
SHOUT_BOTTOM = "(?:⌒[YＹ]){3,}"
SLASH_TOP = "＼─\\|(?:──\\|){2,}─?／"
SLASH_BOTTOM = "／─\\|(?:──\\|){2,}─?＼"
PADDING = "[ 　.]+$"
OVER, UNDER = "￣", "＿"
OVER_CORNERS, UNDER_CORNERS = ("´'", "｀ヽﾍ"), ("乂ヽ丶", "ノﾉ")
RIGHT_SIDES = "│｜|〉》>）)ノﾉ＼ヽ｝}］]"
BARS = "|│｜"
SELECTED = "￣＿─-="
PADS = " .　"
LINE_ENDS = "\r\n 　"
CORNER = 4


Widths = dict[str, int] | Column | None


def width(text: Column, special: Widths = None) -> Column:
    """The sum of the characters' widths: by exceptions, or by a column of a font's widths (``sources.fonts``)."""
    if isinstance(special, Column):
        found = lambda code: F.get(F.get(special["pages"], F.shiftright(code, 8)), code.bitwiseAND(255))
        own = lambda char: F.when(char == "", 0).otherwise(F.coalesce(found(F.ascii(char)), special["missing"]))
        return F.aggregate(F.split(text, ""), F.lit(0), lambda total, char: total + own(char))
    total = 2 * F.length(text) - F.length(F.regexp_replace(text, "[^\\x00-\\x7F]+", ""))
    for char, own in (special or {}).items():
        usual = 1 if ord(char) < 128 else 2
        total = total + (own - usual) * (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit(""))))
    return total


def _unit(text: Column | str, special: Widths) -> Column:
    """The width of what is repeated to fill a room, at least 1."""
    return F.greatest(width(F.lit(text) if isinstance(text, str) else text, special), F.lit(1))


KINDS = (("shout", SHOUT_TOP, SHOUT_BOTTOM), ("slash", SLASH_TOP, SLASH_BOTTOM), ("box", TOP, BOTTOM))
_FOUND = "array<struct<top:int,bottom:int,kind:string>>"


def _marks(lines: Column, known: Column, top: str, bottom: str) -> Column:
    """(at, part) of the lines that are a top (1) or else a bottom (2) and that no known frame covers."""
    free = lambda x: ~F.exists(known, lambda k: (x["at"] >= k["top"]) & (x["at"] <= k["bottom"]))
    part = lambda line: F.when(line.rlike(top), 1).when(line.rlike(bottom), 2).otherwise(0)
    every = F.transform(lines, lambda line, i: F.struct(i.alias("at"), part(line).alias("part")))
    return F.filter(F.filter(every, lambda x: x["part"] > 0), free)


def _of_kind(lines: Column, known: Column, kind: str, top: str, bottom: str) -> Column:
    """The frames known and those of one kind on lines that no known frame covers.

    From the top down, each top takes the first bottom within reach; lines of a frame
    that is found already are passed over.
    """
    marks = _marks(lines, known, top, bottom)

    def step(acc: Column, x: Column) -> Column:
        # Of tops still waiting for a bottom, the uppermost in reach takes this one.
        near = F.filter(acc["open"], lambda t: x["at"] - t <= FARTHEST)
        closes = (x["part"] == 2) & (F.size(near) > 0)
        waiting = F.when(closes, F.array().cast("array<int>")).when(x["part"] == 1, F.concat(near, F.array(x["at"]))).otherwise(near)
        frame = F.struct(F.get(near, F.lit(0)).alias("top"), x["at"].alias("bottom"), F.lit(kind).alias("kind"))
        return F.struct(waiting.alias("open"), F.when(closes, F.concat(acc["found"], F.array(frame))).otherwise(acc["found"]).alias("found"))

    zero = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast(_FOUND).alias("found"))
    return F.concat(known, F.aggregate(marks, zero, step, lambda acc: acc["found"]))


def _safe(run: str, corners: tuple[str, str]) -> str:
    """A border with corners at both ends: the last run of three or more, at most four characters from the end."""
    before, after = corners
    return f"[{before}][ 　]*{run}{{3,}}[ 　]*(?=.{{0,{CORNER - 1}}}[{after}])(?!.*{run}{{3}})[^ 　].{{0,{CORNER - 1}}}\\z"


NORMAL_TOP = f"(?s){_safe(OVER, OVER_CORNERS)}"
NORMAL_BOTTOM = f"(?s)^(?!.*{OVER}{{3}}).*{_safe(UNDER, UNDER_CORNERS)}"


def _normal(lines: Column, known: Column) -> Column:
    """The frames known and the normal ones: a top and the next border below it, if that is a bottom within reach."""
    bare = F.transform(lines, lambda line: F.rtrim(line, F.lit(LINE_ENDS)))

    def paired(marks: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            after = F.get(marks, i + 1)
            near = (x["part"] == 1) & (after["part"] == 2) & (after["at"] - x["at"] <= FARTHEST)
            return F.when(near, F.struct(x["at"].alias("top"), after["at"].alias("bottom"), F.lit("normal").alias("kind")))

        return F.filter(F.transform(marks, pair), lambda f: f.isNotNull())

    return F.concat(known, rx.let(_marks(bare, known, NORMAL_TOP, NORMAL_BOTTOM), paired))


def boxes(lines: Column, kinds: tuple = KINDS, normal: bool = True) -> Column:
    """(top, bottom, kind) of the frames among an array of lines, from 0, in order; earlier kinds claim lines first."""
    found = F.array().cast(_FOUND)
    for kind, top, bottom in kinds:
        found = _claimed(lines, found, kind, top, bottom)
    if normal:
        found = rx.let(F.struct(lines.alias("lines"), found.alias("found")), lambda z: _normal(z["lines"], z["found"]))
    return F.array_sort(found)


def _claimed(lines: Column, found: Column, kind: str, top: str, bottom: str) -> Column:
    return rx.let(F.struct(lines.alias("lines"), found.alias("found")), lambda z: _of_kind(z["lines"], z["found"], kind, top, bottom))


def _padded(text: Column, target: Column, special: Widths) -> Column:
    """Full-width spaces as far as they fit, then half-width ones, and one more if that comes nearer."""
    wide, narrow = _unit(WIDE_SPACE, special), _unit(" ", special)

    def filled(room: Column) -> Column:
        n_wide = F.floor(F.greatest(room, F.lit(0)) / wide).cast("int")
        left = room - n_wide * wide
        n_narrow = F.floor(F.greatest(left, F.lit(0)) / narrow).cast("int")
        left = left - n_narrow * narrow
        nearer = F.when(narrow - left < left, 1).otherwise(0)
        return F.concat(text, F.repeat(F.lit(WIDE_SPACE), n_wide), F.repeat(F.lit(" "), n_narrow + nearer))

    return rx.let(target - width(text, special), filled)


def align_to_previous(lines: DataFrame, at: Column, special: Widths = None, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line, cursor): what stands at or behind ``at`` (from 0) moved to the end of the line before.

    The first character there that is no space goes behind one space, next to the last
    character of the previous line; cursor is its place. Lines without such a character,
    or without text before them, stay, with cursor null.
    """
    previous = F.lag("line").over(Window.partitionBy(key).orderBy("line_no"))
    rows = lines.withColumn("_at", at).withColumn("_previous", F.regexp_replace(previous, "(?U)\\s+$", ""))
    behind = F.substring("line", F.col("_at") + 1, F.length("line"))
    start = F.col("_at") + F.length(behind) - F.length(F.ltrim(behind, F.lit(" " + WIDE_SPACE)))
    content = F.coalesce(F.nullif(F.rtrim("_previous", F.lit(" .．" + WIDE_SPACE)), F.lit("")), F.col("_previous"))
    target = F.when(F.length(content) > 1, width(F.substring(content, F.lit(1), F.length(content) - 1), special)).otherwise(width(content, special))
    rows = rows.select(key, "line_no", "line", "_previous", start.alias("_start"), target.alias("_target"))
    before = F.rtrim(F.substring("line", F.lit(1), F.col("_start")), F.lit(" " + WIDE_SPACE))
    prefix = F.when(width(before, special) >= F.col("_target"), before).otherwise(_padded(before, F.col("_target"), special))
    rows = rows.withColumn("_prefix", F.when((F.col("_previous") != "") & (F.col("_start") < F.length("line")), prefix))
    moved = F.concat("_prefix", F.lit(" "), F.substring("line", F.col("_start") + 1, F.length("line")))
    return rows.select(key, "line_no", F.coalesce(moved, F.col("line")).alias("line"), (F.length("_prefix") + 1).alias("cursor"))


def redraw(lines: Column, box: Column, special: Widths = None) -> Column:
    """The lines of one frame drawn to the width of its widest content."""
    own = F.slice(lines, box["top"] + 1, box["bottom"] - box["top"] + 1)
    inner = lambda line: F.regexp_replace(F.regexp_replace(F.regexp_extract(line, CONTENT, 2), ",+$", ""), PADDING, "")
    needed = F.array_max(F.transform(own, lambda line: F.when(line.rlike(CONTENT), width(F.concat(F.lit("│"), inner(line), F.lit(WIDE_SPACE + "│")), special))))
    given = width(F.regexp_extract(F.get(own, F.lit(0)), "(┌─+┐)", 1), special)
    dash = _unit("─", special)
    sides = width(F.lit("┌┐"), special)

    def drawn(target: Column) -> Column:
        room = F.greatest(target - sides, dash)
        whole = F.floor(room / dash).cast("int")
        n = F.when((whole + 1) * dash - room < room - whole * dash, whole + 1).otherwise(whole)
        border = lambda line, pattern, a, b: F.concat(F.regexp_extract(line, pattern, 1), F.lit(a), F.repeat(F.lit("─"), n), F.lit(b))
        return F.transform(
            own,
            lambda line: F.when(line.rlike(TOP), border(line, TOP, "┌", "┐"))
            .when(line.rlike(BOTTOM), border(line, BOTTOM, "└", "┘"))
            .when(line.rlike(CONTENT), F.concat(F.regexp_extract(line, CONTENT, 1), F.lit("│"), _padded(inner(line), target - width(F.lit("││"), special), special), F.lit("│")))
            .otherwise(line),
        )

    return rx.let(F.coalesce(needed + width(F.lit(WIDE_SPACE), special), given), drawn)


@dataclass(frozen=True)
class Drawing:
    """How a frame of a kind is told from its lines and drawn: pairs of sides, and borders as start, repeated part and end."""

    top: str
    bottom: str
    sides: tuple[tuple[str, str], ...]
    parts: tuple[tuple[str, str, str], tuple[str, str, str]]
    whole_line: bool  # a border reaches to the end of its line


# The borders and sides of shouts and slashed frames.
DRAWINGS = {
    "shout": Drawing("[､、]?[_＿]+(?:人[_＿]*)+", "(?:⌒[YＹ]){2,}", (("）", "（"), ("＞", "＜"), (">", "<"), ("》", "《")), (("_", "_人", ""), ("", "⌒Y", "")), True),
    "slash": Drawing("＼─\\|(?:──\\|)+─?／", "／─\\|(?:──\\|)+─?＼", (("│", "│"), ("─", "─")), (("＼─|", "──|", "─／"), ("／─|", "──|", "─＼")), False),
}


def _fill(target: Column, start: Column, part: str, end: str, special: Widths) -> Column:
    """A border with as many parts as the target has room for."""
    room = target - width(F.concat(start, F.lit(end)), special)
    n = F.greatest(F.floor(room / _unit(part, special)), F.lit(0)).cast("int")
    return F.concat(start, F.repeat(F.lit(part), n), F.lit(end))


def redraw_as(lines: Column, box: Column, kind: str, special: Widths = None) -> Column:
    """The lines of a shout or a slashed frame drawn to the width of its widest content."""
    d = DRAWINGS[kind]
    own = F.slice(lines, box["top"] + 1, box["bottom"] - box["top"] + 1)
    edge = F.lit(" \r" + WIDE_SPACE)

    def read(line: Column) -> Column:
        """(part, prefix, bubble, left, right, inner) of one line; part is top, bottom, content or other."""
        row = lambda part, prefix=None, bubble=None, left=None, right=None, inner=None: F.struct(
            *(F.lit(v).cast("string").alias(n) if v is None or isinstance(v, str) else v.alias(n) for n, v in zip(("part", "prefix", "bubble", "left", "right", "inner"), (part, prefix, bubble, left, right, inner)))
        )

        def border(part: str, pattern: str) -> Column:
            at = F.regexp_instr(line, F.lit(pattern))
            tail = F.substring(line, at, F.length(line))
            bubble = F.regexp_replace(tail, "(?U)\\s+$", "") if d.whole_line else F.regexp_substr(line, F.lit(pattern))
            return row(part, F.substring(line, F.lit(1), at - 1), bubble)

        bare = F.rtrim(line, edge)
        found = row("other")
        for left, right in reversed(d.sides):
            before = F.substring(bare, F.lit(1), F.length(bare) - 1)
            at = F.length(before) - F.instr(F.reverse(before), left) + 1
            inner = F.regexp_replace(F.substring(before, at + 1, F.length(before)), ",+$", "")
            ends = bare.endswith(right) & before.contains(left)
            found = F.when(ends, row("content", F.substring(line, F.lit(1), at - 1), None, left, right, F.rtrim(inner, F.lit(" ." + WIDE_SPACE)))).otherwise(found)
        first, second = (border("top", d.top), line.rlike(d.top)), (border("bottom", d.bottom), line.rlike(d.bottom))
        if d.whole_line:  # a line that holds both is a bottom
            first, second = second, first
        return F.when(first[1], first[0]).when(second[1], second[0]).otherwise(found)

    def drawn(z: Column) -> Column:
        rows = z["rows"]
        needed = F.array_max(F.transform(rows, lambda x: F.when(x["part"] == "content", width(F.concat(x["left"], x["inner"], F.lit(WIDE_SPACE), x["right"]), special))))
        bubble = F.get(F.filter(rows, lambda x: x["part"].isin("top", "bottom")), F.lit(0))["bubble"]
        given = width(bubble, special)

        def build(target: Column) -> Column:
            (top_start, top_part, top_end), (low_start, low_part, low_end) = d.parts
            corner = lambda x: F.when(F.lit(kind == "shout") & x["bubble"].rlike("^[､、]"), F.substring(x["bubble"], 1, 1)).otherwise("")
            top = lambda x: _fill(target, F.concat(corner(x), F.lit(top_start)), top_part, top_end, special)
            low = lambda x: F.regexp_replace(_fill(target, F.lit(low_start), low_part, low_end, special), "Y$", "Ｙ")
            content = lambda x: F.concat(x["left"], _padded(x["inner"], F.greatest(target - width(F.concat(x["left"], x["right"]), special), F.lit(0)), special), x["right"])
            made = lambda x: F.when(x["part"] == "top", top(x)).when(x["part"] == "bottom", low(x)).otherwise(content(x))
            return F.zip_with(rows, z["own"], lambda x, line: F.when(x["part"] == "other", line).otherwise(F.concat(x["prefix"], made(x))))

        return F.when(given > 0, rx.let(F.coalesce(needed + width(F.lit(WIDE_SPACE), special), given), build)).otherwise(z["own"])

    return rx.let(own, lambda o: rx.let(F.struct(F.transform(o, read).alias("rows"), o.alias("own")), drawn))


def _repeats(room: Column, part: Column) -> Column:
    """How often a part of some width fits a room, once more if that comes nearer."""
    n = F.floor(F.greatest(room, F.lit(0)) / part).cast("int")
    return F.when((n + 1) * part - room < room - n * part, n + 1).otherwise(n)


def redraw_normal(lines: Column, box: Column, special: Widths = None) -> Column:
    """The lines of a normal frame drawn to the widest text behind its last bar.

    The first border fixes how often overlines and underlines are repeated; all borders
    take that number, so they stay alike whatever their corners are. Null without a border
    or a text to measure.
    """
    own = F.slice(lines, box["top"] + 1, box["bottom"] - box["top"] + 1)
    row = lambda part, left, char=None, right=None: F.struct(
        *(v.alias(n) if isinstance(v, Column) else F.lit(v).cast("string").alias(n) for n, v in zip(("part", "left", "char", "right"), (part, left, char, right)))
    )
    uncommaed = lambda text: F.regexp_replace(text, ",+\\z", "")

    def read(line: Column) -> Column:
        """(part, left, char, right) of one line: border, side (text with a right side), text or blank."""

        def parted(bare: Column) -> Column:
            sided = f"(?s)^(.*?[^{PADS}])[{PADS}]+([^{PADS}]{{1,3}})\\z"
            left, right = (F.regexp_extract(bare, sided, i) for i in (1, 2))
            found = F.when(right.rlike(f"[{rx.quote(RIGHT_SIDES)}]"), row("side", uncommaed(left), None, right)).otherwise(row("text", uncommaed(bare)))
            for run in (UNDER, OVER):
                border = f"(?s)^((?:.*[^{run}])?){run}{{3,}}((?:[^{run}].*)?)\\z"
                tail = F.regexp_extract(bare, border, 2)
                near = bare.rlike(border) & (F.length(F.btrim(tail, F.lit(" 　"))) <= CORNER)
                found = F.when(near, row("border", F.regexp_extract(bare, border, 1), run, tail)).otherwise(found)
            return found

        return F.when(line == "", row("blank", line)).otherwise(rx.let(F.rtrim(line, F.lit(LINE_ENDS)), parted))

    def spoken(x: Column) -> Column:
        """The width of what stands behind the last bar."""
        inner = F.regexp_extract(x["left"], f"(?s)[{BARS}]([^{BARS}]*)\\z", 1)
        return F.when((x["part"] == "side") & x["left"].rlike(f"[{BARS}]"), width(F.rtrim(inner, F.lit(PADS)), special))

    of = lambda x, *names: sum((width(x[n], special) for n in names[1:]), width(x[names[0]], special))

    def drawn(z: Column) -> Column:
        def made(x: Column) -> Column:
            n = F.when(z["widest"] > 0, z["n"]).otherwise(_repeats(z["target"] - of(x, "left", "right"), _unit(x["char"], special)))
            side = F.concat(_padded(F.rtrim(x["left"], F.lit(PADS)), z["target"] - width(x["right"], special), special), x["right"])
            return F.when(x["part"] == "border", F.concat(x["left"], F.repeat(x["char"], n), x["right"])).when(x["part"] == "side", side).otherwise(x["left"])

        return F.when(z["target"] > 0, F.transform(z["rows"], made))

    def measured(z: Column) -> Column:
        """With the number of repeats and the width of the frame, 0 where nothing can be measured."""
        corners = F.coalesce(of(z["first"], "left", "right"), F.lit(0))
        unit = _unit(z["first"]["char"], special)
        target = F.when(z["widest"] > 0, corners + z["widest"]).otherwise(F.coalesce(corners + z["length"] * unit, F.lit(0)))
        known = F.struct(z["rows"].alias("rows"), z["widest"].alias("widest"), target.alias("target"), _repeats(z["widest"], unit).alias("n"))
        return rx.let(known, drawn)

    def seen(z: Column) -> Column:
        rows = z["rows"]
        at = F.array_position(F.transform(rows, lambda x: x["part"]), F.lit("border"))
        first = F.when(at > 0, F.get(rows, at - 1))
        length = F.length(F.rtrim(F.get(z["own"], at - 1), F.lit(LINE_ENDS))) - F.length(first["left"]) - F.length(first["right"])
        widest = F.coalesce(F.array_max(F.transform(rows, spoken)), F.lit(0))
        return rx.let(F.struct(rows.alias("rows"), first.alias("first"), length.alias("length"), widest.alias("widest")), measured)

    return rx.let(own, lambda o: rx.let(F.struct(F.transform(o, read).alias("rows"), o.alias("own")), seen))


def _replaced(lines: Column, frames: Column, made) -> Column:
    """Lines with each of some disjoint frames, in order, drawn anew."""

    def step(acc: Column, box: Column) -> Column:
        between = F.slice(lines, acc["at"] + 1, box["top"] - acc["at"])
        return F.struct((box["bottom"] + 1).alias("at"), F.concat(acc["out"], between, made(lines, box)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(frames, zero, step, lambda acc: F.concat(acc["out"], F.slice(lines, acc["at"] + 1, F.size(lines))))


def adjust(docs: DataFrame, special: Widths = None) -> DataFrame:
    """Documents with every frame of the four kinds redrawn; ``n_boxes`` counts them.

    Normal frames come last: they may enclose others, whose new lines they then measure.
    """
    rows = docs.withColumn("_lines", F.split("text", "\n", -1)).withColumn("_boxes", boxes(F.col("_lines")))

    def one(lines: Column, box: Column) -> Column:
        made = redraw(lines, box, special)
        for kind in DRAWINGS:
            made = F.when(box["kind"] == kind, redraw_as(lines, box, kind, special)).otherwise(made)
        return made

    normal = lambda lines, box: redraw_normal(lines, box, special)
    rows = rows.withColumn("_lines", _replaced(F.col("_lines"), F.filter("_boxes", lambda b: b["kind"] != "normal"), one))
    rows = rows.withColumn("_lines", _replaced(F.col("_lines"), F.filter("_boxes", lambda b: b["kind"] == "normal"), normal))
    return rows.withColumn("text", F.array_join("_lines", "\n")).withColumn("n_boxes", F.size("_boxes")).drop("_lines", "_boxes")


def adjust_selection(text: Column, special: Widths = None) -> Column:
    """A selected frame redrawn as a whole, by the first kind whose borders it holds; null if it is no frame.

    A selection is taken for a normal frame if a line ends in a run of three overlines,
    underlines, dashes, hyphens or equals signs and at most four characters.
    """
    lines = F.split(text, "\n", -1)
    every = F.struct(F.lit(0).alias("top"), (F.size(lines) - 1).alias("bottom"))
    has = lambda pattern: F.exists(lines, lambda line: line.rlike(pattern))
    join = lambda made: F.array_join(made, "\n")
    runs = "|".join(f"{c}{{3,}}" for c in SELECTED)
    bordered = F.exists(lines, lambda line: F.rtrim(line, F.lit(LINE_ENDS)).rlike(f"(?s)(?:{runs})[ 　]*.{{0,{CORNER}}}\\z"))
    return (
        F.when(has("_人") & has("⌒[YＹ]"), join(redraw_as(lines, every, "shout", special)))
        .when(has("＼─\\|(?:──\\|){2,}") & has("／─\\|(?:──\\|){2,}"), join(redraw_as(lines, every, "slash", special)))
        .when(has(TOP) & has(BOTTOM), join(redraw(lines, every, special)))
        .when(bordered, join(redraw_normal(lines, every, special)))
    )
