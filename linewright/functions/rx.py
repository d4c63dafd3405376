"""Regular-expression helpers: one place for the differences between dialects.

Patterns are written for Java's engine. ``(?U)`` makes \\s and \\d Unicode-aware.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: All characters that count as white space.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
FOLD = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times within an expression.

    A fold over nothing: an element of a transformed array would have its type worked out anew at each evaluation.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not just the ASCII space."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACES}]")


def quote(literal: str) -> str:
    """A pattern that matches the literal."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quoted(literal: Column) -> Column:
    """As ``quote``, for a column of literals."""
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def alternation(terms: Iterable[str]) -> str:
    """A pattern for any of the terms, longer ones first (ties in given order)."""
    return "|".join(quote(t) for t in sorted(terms, key=len, reverse=True))


def groups(pattern: str) -> int | None:
    """How many groups a user's pattern has; None if it does not compile.

    The engine that will run the pattern is asked, on the driver and before any task runs.
    """
    session = SparkSession.getActiveSession()
    jvm = getattr(session, "_jvm", None)
    if jvm is None:  # no engine at hand
        try:
            return re.compile(pattern).groups
        except re.error:
            return None
    try:
        return jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (IllegalArgumentException, Py4JJavaError):  # the session turns the engine's error into the first
        return None


def valid(pattern: str) -> bool:
    """Whether a user's pattern compiles."""
    return groups(pattern) is not None


def any_match(text: Column, patterns: Iterable[str]) -> Column:
    """True where some pattern is found in the text; invalid patterns are passed over."""
    found = F.lit(False)
    for pattern in patterns:
        if pattern.strip() and valid(pattern.strip()):
            found = found | text.rlike(pattern.strip())
    return found


def rewrite(text: Column, pattern: str, body: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """Replace each match of a pattern (which must not match nothing) by ``body``.

    ``body`` gets the match, its index, the pieces between matches and all matches.
    """

    def build(z: Column) -> Column:
        gaps, hits = z["gaps"], z["hits"]
        tail = F.transform(hits, lambda hit, i: F.concat(body(hit, i, gaps, hits), F.get(gaps, i + 1)))
        return F.concat(F.get(gaps, F.lit(0)), F.array_join(tail, ""))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), let(both, build)).otherwise(text)


def running(values: Column, op: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each value the fold of those before it, from 0 on; in folds of FOLD values, since arrays are copied as they grow."""
    zero = F.lit(0).cast(kind).alias("at")

    def fold(block: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, F.struct(zero, F.array().cast(f"array<{kind}>").alias("out")), step)

    def chain(acc: Column, f: Column) -> Column:
        moved = F.transform(f["out"], lambda y: op(acc["at"], y))
        return F.struct(op(acc["at"], f["at"]).alias("at"), F.concat(acc["outs"], F.array(moved)).alias("outs"))

    def folded(held: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / FOLD).cast("int")), lambda b: F.slice(held, b * FOLD + 1, F.lit(FOLD)))
        start = F.struct(zero, F.array().cast(f"array<array<{kind}>>").alias("outs"))
        return F.when(F.size(held) > 0, F.flatten(F.aggregate(F.transform(blocks, fold), start, chain)["outs"])).otherwise(F.array().cast(f"array<{kind}>"))

    return let(values, folded)


def matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern as an array of (start, end, text), in code points from 0."""

    def place(z: Column) -> Column:
        before = running(F.transform(z["hits"], lambda hit, i: F.length(F.get(z["gaps"], i)) + F.length(hit)), lambda a, b: a + b)
        start = lambda at, i: at + F.length(F.get(z["gaps"], i))
        return F.transform(
            before,
            lambda at, i: F.struct(start(at, i).alias("start"), (start(at, i) + F.length(F.get(z["hits"], i))).alias("end"), F.get(z["hits"], i).alias("text")),
        )

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), let(both, place)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))
