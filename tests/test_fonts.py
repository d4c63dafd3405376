"""Fonts made here, with known widths, and fonts of the machine where there are some."""

import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linewright.operators import layout
from linewright.sources import fonts

DEJAVU = Path("/usr/share/fonts/truetype/dejavu")


def _font(chars, kind, units=1000, missing=7, base=0):
    """A font of a format of its table of characters; the widths of the last glyphs are left out if equal."""
    codes = sorted(map(ord, chars))
    own = [missing, *(chars[chr(c)] for c in codes)]
    while len(own) > 1 and own[-1] == own[-2]:
        own.pop()
    hmtx = b"".join(struct.pack(">Hh", w, 0) for w in own) + struct.pack(">h", 0) * (len(codes) + 1 - len(own))
    if kind == 4:
        n = len(codes) + 1
        ends = [*codes, 0xFFFF]
        # Odd places go by a delta, even ones through the array of glyphs.
        deltas = [(i + 1 - c) % 65536 if i % 2 else 0 for i, c in enumerate(codes)] + [1]
        ranges = [0 if i % 2 else 2 * (n - i + i) for i, _ in enumerate(codes)] + [0]
        body = struct.pack(f">{n}H", *ends) + b"\0\0" + struct.pack(f">{n}H", *ends) + struct.pack(f">{n}H", *deltas) + struct.pack(f">{n}H", *ranges)
        body += struct.pack(f">{n}H", *range(1, n), 0)
        table = struct.pack(">7H", 4, 14 + len(body), 0, 2 * n, 0, 0, 0) + body
    else:
        groups = b"".join(struct.pack(">3I", c, c, i + 1) for i, c in enumerate(codes))
        table = struct.pack(">HHIII", 12, 0, 16 + len(groups), 0, len(codes)) + groups
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1 if kind == 4 else 10, 12) + table
    parts = {"cmap": cmap, "head": struct.pack(">18xH34x", units), "hhea": struct.pack(">34xH", len(own)), "hmtx": hmtx}
    at, index, data = base + 12 + 16 * len(parts), b"", b""
    for tag, part in parts.items():
        index += struct.pack(">4sIII", tag.encode(), 0, at + len(data), len(part))
        data += part + b"\0" * (-len(part) % 4)
    return struct.pack(">IHHHH", 0x00010000, len(parts), 0, 0, 0) + index + data


FIRST = {" ": 3, "a": 5, "│": 4, "─": 4, "┌": 4, "┐": 4, "└": 4, "┘": 4, "　": 9, "口": 9}
SECOND = {" ": 10, "a": 21, "　": 30, "口": 30, "😀": 44, "│": 12, "─": 15, "┌": 12, "┐": 12, "└": 12, "┘": 12}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("fonts")
    (made / "one.ttf").write_bytes(_font(FIRST, 4))
    (made / "two.otf").write_bytes(_font(SECOND, 12, units=2048, missing=11))
    head = struct.pack(">4sIIII", b"ttcf", 0x00010000, 2, 20, 0)
    inner = _font(FIRST, 4, base=20)
    head = struct.pack(">4sIIII", b"ttcf", 0x00010000, 2, 20, 20 + len(inner))
    (made / "both.ttc").write_bytes(head + inner + _font(SECOND, 12, base=20 + len(inner), missing=11))
    (made / "broken.ttf").write_bytes(b"not a font")
    (made / "empty.ttf").write_bytes(b"")
    (made / "notes.txt").write_bytes(b"x")
    return str(made)


def test_widths_equal_the_tables(spark, folder):
    rows = fonts.read(spark, folder).collect()
    got = {}
    for r in rows:
        if r["error"] is None:
            got.setdefault(r["font"], {})[r["code"]] = r["width"]
    plain = lambda chars, missing: {ord(c): w for c, w in chars.items()} | {-1: missing}
    assert got == {"one.ttf": plain(FIRST, 7), "two.otf": plain(SECOND, 11), "both.ttc": plain(FIRST, 7), "both.ttc#1": plain(SECOND, 11)}
    assert {r["font"] for r in rows if r["error"]} == {"broken.ttf"}  # files without a byte have no row
    assert {r["units"] for r in rows if r["font"] == "two.otf"} == {2048}


def test_texts_are_measured_by_their_font(spark, folder):
    found = fonts.lookup(fonts.read(spark, folder))
    texts = ["", "a a", "口　😀", "zz─", None]
    docs = spark.createDataFrame([(f, i, t) for f in ("one.ttf", "two.otf", "none.ttf", None) for i, t in enumerate(texts)], "font string, i int, text string")
    got = {(r["font"], r["i"]): r["w"] for r in fonts.attach(docs, found).withColumn("w", layout.width(F.col("text"), F.col("widths"))).collect()}
    measured = lambda text, chars, missing: None if text is None else sum(chars.get(c, missing) for c in text)
    for i, text in enumerate(texts):
        assert got["one.ttf", i] == measured(text, FIRST, 7) and got["two.otf", i] == measured(text, SECOND, 11)
        assert got["none.ttf", i] in (None, 0) and got[None, i] in (None, 0)


def test_frames_are_drawn_by_their_font(spark, folder):
    found = fonts.lookup(fonts.read(spark, folder))
    box = "┌──┐\n│aaaa  │\n│口│\n└──┘"
    docs = fonts.attach(spark.createDataFrame([("one.ttf", box), ("two.otf", box)], "font string, text string"), found)
    made = {r["font"]: r for r in layout.adjust(docs, F.col("widths")).collect()}
    for font, chars in (("one.ttf", FIRST), ("two.otf", SECOND)):
        lines = made[font]["text"].split("\n")
        wide = [sum(chars[c] for c in line) for line in lines]
        assert made[font]["n_boxes"] == 1 and max(wide) - min(wide) <= max(chars[" "], chars["─"]) and lines[1].startswith("│aaaa") and lines[2].startswith("│口")
    assert made["one.ttf"]["text"] != made["two.otf"]["text"]


@pytest.mark.skipif(not DEJAVU.is_dir(), reason="no such fonts here")
def test_fonts_of_the_machine(spark):
    rows = {(r["font"], r["code"]): r["width"] for r in fonts.read(spark, str(DEJAVU)).filter("code IN (32, 65, 105, 9472)").collect()}
    assert [rows["DejaVuSans.ttf", ord(c)] for c in " Ai"] == [651, 1401, 569]
    assert [rows["DejaVuSansMono.ttf", ord(c)] for c in " Ai─"] == [1233] * 4
