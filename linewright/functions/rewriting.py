"""Many edits of a text, one after the other, each on its own line; over Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linewright.functions.scalar import BORDER, WIDE_SPACE

_BORDER = re.compile(BORDER)
LONG = 4096  # from so many characters on a line is taken apart
PIECE = 256  # up to so many characters edits are looked up by what a piece holds


def _padded(a: str, b: str) -> str:
    return b + WIDE_SPACE * (len(a) - len(b))


def _in_turn(text: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        text = text.replace(a, b)
    return text


def _in_pieces(text: str, pairs: list[tuple[str, str]]) -> str:
    """As ``_in_turn``, in time about linear in a long text.

    A character that no original has is never replaced and no occurrence spans it, so what stands
    between such characters changes on its own, and only by edits whose originals it comes to hold.
    """
    places = defaultdict(list)
    for i, (a, _) in enumerate(pairs):
        places[a].append(i)
    lengths, known = sorted(set(map(len, places))), {}

    def next_edit(piece: str, done: int) -> int:
        """The first edit after ``done`` whose original the piece holds; how many there are if none."""
        best = len(pairs)
        for n in lengths:
            for at in range(len(piece) - n + 1):
                held = places.get(piece[at : at + n])
                if held and held[-1] > done:
                    best = min(best, held[bisect_right(held, done)])
        return best

    def changed(match: re.Match) -> str:
        piece = match.group()
        if piece not in known:
            now, i = piece, -1
            while len(now) <= PIECE and (i := next_edit(now, i)) < len(pairs):
                now = now.replace(*pairs[i])
            known[piece] = now if len(now) <= PIECE else _in_turn(now, pairs[i + 1 :])
        return known[piece]

    chars = "".join(sorted({c for a in places for c in a}))
    return re.sub(f"[{re.escape(chars)}]+", changed, text)


def _each(text: str, pairs: list[tuple[str, str]]) -> str:
    return _in_pieces(text, pairs) if len(text) > LONG else _in_turn(text, pairs)


def _framed(line: str, pairs: list[tuple[str, str]]) -> str:
    """Edits of which some have a border themselves: of each, occurrences before a border are padded."""
    for a, b in pairs:
        parts = line.split(a)
        hits = len(parts) - 1
        bordered = max((i for i in range(1, len(parts)) if _BORDER.search(parts[i])), default=0)
        own = hits - 1 if _BORDER.search(a) else 0
        line = "".join(part + (_padded(a, b) if i < max(bordered, own) else b) for i, part in enumerate(parts[:-1])) + parts[-1]
    return line


def _line(line: str, pairs: list[tuple[str, str]]) -> str:
    """Edits of a line in order, none of them with a border; what they put before the line's last border is padded."""
    if not _BORDER.search(line):
        return _each(line, pairs)
    cut = max(m.end() for m in _BORDER.finditer(line))
    return _each(line[:cut], [(a, _padded(a, b)) for a, b in pairs]) + _each(line[cut:], pairs)


def rewritten(text: str, edits: list[tuple]) -> str:
    """A text with edits of (line_no, pos, a, b): the longest original first, then by position; without a line of the text, on all lines."""
    lines, own, lost = text.split("\n"), defaultdict(list), []
    last, framed = len(lines), _framed if any(_BORDER.search("".join(e[k] for e in edits)) for k in (2, 3)) else _line
    for at, pos, a, b in edits:
        held = own[at] if 1 <= at <= last else lost
        held.append((-len(a), pos, a, b))

    def changed(i: int, line: str) -> str:
        mine = own.get(i, lost)
        if not mine:
            return line
        if lost and mine is not lost:
            mine += lost
        mine.sort()
        return framed(line, [e[2:] for e in mine])

    return "\n".join([changed(i, line) for i, line in enumerate(lines, 1)])


def _rewrite(texts: pa.Array, edits: pa.Array) -> pa.Array:
    rows, out = edits.values, []
    line, pos, a, b = (rows.field(name) for name in ("line_no", "pos", "a", "b"))
    for i, text in enumerate(texts):
        if not text.is_valid or not edits[i].is_valid:
            out.append(text.as_py())
            continue
        start, n = edits.offsets[i].as_py(), edits.offsets[i + 1].as_py() - edits.offsets[i].as_py()
        out.append(rewritten(text.as_py(), list(zip(*(x.slice(start, n).to_numpy(zero_copy_only=False).tolist() for x in (line, pos, a, b))))))
    return pa.array(out, pa.string())


#: (text, array of (line_no int, pos bigint, a string, b string)) as ``rewritten``; the optimiser neither repeats nor moves it.
rewrite = F.arrow_udf(_rewrite, StringType()).asNondeterministic()
