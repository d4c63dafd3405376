"""Nested marks as column expressions: brackets completed, spans without a partner dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.functions import rx

# Opening and closing brackets, and colour spans.
OPENING = "【「“‘『（("
CLOSING = "】」”’』）)"
SPAN = "<span\\s+style=\"color:[^\"]*\">|</span>"


def _partner(char: Column) -> Column:
    """The other bracket of a pair."""
    return F.translate(char, OPENING + CLOSING, CLOSING + OPENING)


def _opens(char: Column) -> Column:
    return (char != "") & F.lit(OPENING).contains(char)


def _closes(char: Column) -> Column:
    return (char != "") & F.lit(CLOSING).contains(char)


def _at(line: Column, i: Column) -> Column:
    """The character at a place from 0; empty outside of the line."""
    return F.when(i >= 0, F.substring(line, i + 1, F.lit(1))).otherwise("")


def unpaired(text: Column) -> Column:
    """The brackets of a text that no neighbour takes: what is left as inner pairs cancel, in order.

    The text left so far is copied at each bracket, so work grows with brackets times depth.
    """

    def step(left: Column, char: Column) -> Column:
        cancels = _closes(char) & (F.right(left, F.lit(1)) == _partner(char))
        return F.when(cancels, F.substring(left, F.lit(1), F.length(left) - 1)).otherwise(F.concat(left, char))

    return F.aggregate(F.regexp_extract_all(text, F.lit(f"[{OPENING}{CLOSING}]"), F.lit(0)), F.lit(""), step)


def has_brackets(text: Column) -> Column:
    return text.rlike(f"[{OPENING}{CLOSING}]")


def complete_brackets(text: Column, line: Column) -> Column:
    """A fragment widened over brackets that stand next to it in its line.

    Each unpaired bracket takes its partner if that is the next character on its side;
    then one opening bracket just before and one closing just behind are added, if the
    fragment doesn't begin or end with the same. A fragment that is empty or not in the
    line stays.
    """
    grown = "struct<start:int,end:int>"

    def grow(line: Column, span: Column, char: Column) -> Column:
        left = _closes(char) & (_at(line, span["start"] - 1) == _partner(char))
        right = _opens(char) & (_at(line, span["end"]) == _partner(char))
        return F.struct((span["start"] - F.when(left, 1).otherwise(0)).alias("start"), (span["end"] + F.when(right, 1).otherwise(0)).alias("end"))

    def cut(line: Column, span: Column) -> Column:
        before, behind = _at(line, span["start"] - 1), _at(line, span["end"])
        start = span["start"] - F.when(_opens(before) & (before != _at(line, span["start"])), 1).otherwise(0)
        end = span["end"] + F.when(_closes(behind) & (behind != _at(line, span["end"] - 1)), 1).otherwise(0)
        return F.substring(line, start + 1, end - start)

    def widened(z: Column) -> Column:
        chars = F.when(z["left"] != "", F.split(z["left"], "")).otherwise(F.array().cast("array<string>"))
        first = F.struct(z["start"].alias("start"), (z["start"] + F.length(z["text"])).alias("end")).cast(grown)
        return F.aggregate(chars, first, lambda span, char: grow(z["near"], span, char), lambda span: cut(z["near"], span))

    def near(z: Column) -> Column:
        # Only what the brackets can reach is looked at, since a place in a long line is found by counting from its beginning.
        reach = F.length(z["left"]) + 1
        low = F.greatest(z["at"] - 1 - reach, F.lit(0))
        part = F.substring(line, low + 1, z["at"] - 1 - low + F.length(z["text"]) + reach)
        held = F.struct(z["text"].alias("text"), z["left"].alias("left"), part.alias("near"), (z["at"] - 1 - low).alias("start"))
        return F.when((z["text"] != "") & (z["at"] > 0), rx.let(held, widened)).otherwise(z["text"])

    def placed(text: Column) -> Column:
        left = F.when(has_brackets(text), unpaired(text)).otherwise("")
        return rx.let(F.struct(text.alias("text"), F.instr(line, text).alias("at"), left.alias("left")), near)

    return rx.let(text, placed)


def drop_unmatched_spans(text: Column) -> Column:
    """Colour spans without a partner go.

    A closing tag lacks its partner where the count of open ones falls below all earlier
    counts; an opening one, where the same holds from the end.
    """

    def lost(steps: Column) -> Column:
        """Which steps down find nothing to take."""

        def told(z: Column) -> Column:
            return F.zip_with(z["after"], rx.running(z["after"], lambda a, b: F.least(a, b)), lambda after, least: after < least)

        after = F.zip_with(rx.running(steps, lambda a, b: a + b), steps, lambda before, x: before + x)
        return rx.let(F.struct(after.alias("after")), told)

    def build(z: Column) -> Column:
        steps = F.transform(z["tags"], lambda tag: F.when(tag == "</span>", -1).otherwise(1))
        back = F.reverse(F.transform(steps, lambda x: -x))
        gone = F.zip_with(lost(steps), F.reverse(lost(back)), lambda a, b: a | b)
        kept = F.zip_with(z["tags"], gone, lambda tag, out: F.when(out, "").otherwise(tag))
        tail = F.zip_with(kept, F.slice(z["gaps"], F.lit(2), F.size(z["gaps"])), lambda tag, gap: F.concat(tag, gap))
        return F.concat(F.get(z["gaps"], F.lit(0)), F.array_join(tail, ""))

    parts = F.struct(F.split(text, SPAN, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(SPAN), F.lit(0)).alias("tags"))
    return F.when(text.rlike(SPAN), rx.let(parts, build)).otherwise(text)
