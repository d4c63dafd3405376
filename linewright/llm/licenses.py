"""License scan: Aho-Corasick over words and tags, shunting-yard over licence expressions.

A text is lower-cased (A-Z only) and cut into words of digits, small letters and
non-ASCII characters; one automaton finds all notice phrases in one pass over the words
joined by single spaces. A notice phrase gives its label. A second automaton finds the
identifier tags in the lower-cased text itself. Behind a tag stands an expression of
licence names, and / or / with and parentheses up to the end of its line; a shunting-yard
parser turns it into postfix order and evaluates it to the labels that it names and to
whether every choice it leaves is permissive. Names are matched whole (a trailing + means
later versions), and what follows ``with`` must be a known exception. Tags that plain
prose may hold (package fields, ``@license``) count only where the expression is whole and
all its names are known.

A slash between names means or. ``LicenseRef-`` names, with or without their ``DocumentRef-``,
are names of their own, known and not permissive. Of notice phrases that lie within a longer
one only the longer counts (base phrases always do).

Score: 1.0 for a tag with a well-formed expression of known names; 0.9 for a base phrase; 0.7
for another phrase; 0.6 for an SPDX tag with a well-formed expression that has unknown names;
0.5 for one whose expression is broken (the names in it still count); else 0.

Cases: a null or empty text has no words and no labels. Repeated rows are reported alike.
A null doc_id stays null. An empty table gives no rows. Columns other than doc_id and
text are ignored. Work grows with the length of a text and its hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linewright.llm import tables

#: The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Further notice phrases of common licences.
PHRASES = (
    ("mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("apache license 2 0", "apache-2"),
    *((f"gnu general public license {form}{v}", f"gpl-{v}") for form in ("version ", "v") for v in (2, 3)),
    *((f"gnu general public license as published by the free software foundation {form}version {v}", f"gpl-{v}") for form in ("", "either ") for v in (2, 3)),
    *((f"gnu gpl {form}{v}", f"gpl-{v}") for form in ("version ", "v") for v in (2, 3)),
    ("gplv2", "gpl-2"),
    ("gplv3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu lgpl", "lgpl"),
    ("gnu affero general public license", "agpl-3"),
    ("gnu free documentation license", "gfdl"),
    ("mozilla public license version 2", "mpl-2"),
    ("mozilla public license v 2 0", "mpl-2"),
    ("eclipse public license version 1", "epl-1"),
    ("eclipse public license version 2", "epl-2"),
    ("eclipse public license v 1 0", "epl-1"),
    ("eclipse public license v 2 0", "epl-2"),
    ("european union public licence", "eupl"),
    ("common development and distribution license", "cddl"),
    ("open software license version", "osl"),
    ("academic free license version", "afl"),
    ("artistic license", "artistic"),
    ("sil open font license", "ofl"),
    ("boost software license version 1 0", "bsl-1.0"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("bsd 3 clause", "bsd"),
    ("bsd 2 clause", "bsd"),
    ("isc license", "isc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("creative commons attribution", "cc-by"),
    *((f"creative commons attribution {words}", f"cc-by-{kind}") for words, kind in (
        ("sharealike", "sa"), ("share alike", "sa"), ("noderivatives", "nd"), ("noderivs", "nd"), ("noncommercial", "nc"), ("non commercial", "nc"),
        ("noncommercial sharealike", "nc-sa"), ("non commercial share alike", "nc-sa"), ("noncommercial noderivatives", "nc-nd"), ("noncommercial noderivs", "nc-nd"),
    )),
    ("cc by sa", "cc-by-sa"),
    ("cc0 1 0", "cc0"),
    ("creative commons zero", "cc0"),
    ("all rights reserved", "proprietary"),
)
#: Identifier tags as they stand before an expression; True where the tag is used for nothing else.
TAGS = {
    "spdx-license-identifier:": True,
    "license-expression:": True,
    "@license": False,
    "license:": False,
    '"license":': False,
    "license =": False,
}

_LATER = ("", "+", "-only", "-or-later")
#: Licence names by family: stem, versions, endings, label ({} is the version's first number), permissive.
FAMILIES = (
    ("gpl", "1.0 2.0 3.0", _LATER, "gpl-{}", False),
    ("lgpl", "2.0 2.1 3.0", _LATER, "lgpl", False),
    ("agpl", "1.0 3.0", _LATER, "agpl-{}", False),
    ("gfdl", "1.1 1.2 1.3", _LATER, "gfdl", False),
    ("apache", "1.0 1.1 2.0", ("",), "apache-{}", True),
    ("mpl", "1.0 1.1 2.0 2.0-no-copyleft-exception", ("",), "mpl-{}", False),
    ("epl", "1.0 2.0", ("",), "epl-{}", False),
    ("eupl", "1.0 1.1 1.2", ("",), "eupl", False),
    ("cddl", "1.0 1.1", ("",), "cddl", False),
    ("osl", "1.0 1.1 2.0 2.1 3.0", ("",), "osl", False),
    ("cecill", "1.0 1.1 2.0 2.1 b c", ("",), "cecill", False),
    ("lppl", "1.0 1.1 1.2 1.3a 1.3c", ("",), "lppl", False),
    ("artistic", "1.0 2.0", ("",), "artistic", True),
    ("afl", "1.1 1.2 2.0 2.1 3.0", ("",), "afl", True),
    ("ofl", "1.0 1.1", ("",), "ofl", True),
    ("zpl", "1.1 2.0 2.1", ("",), "zpl", True),
    ("php", "3.0 3.01", ("",), "php", True),
    ("ecl", "1.0 2.0", ("",), "ecl", True),
    ("python", "2.0 2.0.1", ("",), "python", True),
    ("bsd", "1 2 3 4", ("-clause", "-clause-patent", "-clause-clear", "-clause-attribution", "-clause-uc"), "bsd", True),
    ("cc-by", "1.0 2.0 2.5 3.0 4.0", ("",), "cc-by", True),
    *((f"cc-by-{kind}", "1.0 2.0 2.5 3.0 4.0", ("",), f"cc-by-{kind}", False) for kind in ("sa", "nd", "nc", "nc-sa", "nc-nd")),
)
#: Names outside of the families, and short forms in common use, with label and permissive.
SINGLE = {
    **{name: (name, True) for name in "mit mit-0 isc x11 zlib unlicense wtfpl ncsa postgresql curl libpng openssl ruby vim ftl ijg json psf-2.0 upl-1.0 bsl-1.0".split()},
    **{name: (name, False) for name in "ms-rl sleepycat cpl-1.0 ssp-1.0 busl-1.1 sspl-1.0 proprietary unlicensed".split()},
    **{name: ("bsd", True) for name in "0bsd bsd".split()},
    **{name: ("cc0", True) for name in "cc0 cc0-1.0".split()},
    **{name: ("apache-2", True) for name in "apache-2 apache2".split()},
    **{f"{stem}{form}{v}": (f"{stem}-{v}", False) for stem in ("gpl", "agpl") for form in ("-", "v") for v in (2, 3)},
    **{f"lgpl{form}": ("lgpl", False) for form in ("", "-2", "-3", "v2", "v3")},
    **{name: (name, name == "cc-by") for name in "cc-by cc-by-sa cc-by-nd cc-by-nc cc-by-nc-sa cc-by-nc-nd".split()},
    "mpl-2": ("mpl-2", False), "ms-pl": ("ms-pl", True), "python": ("python", True),
}
#: Exceptions that may follow ``with``.
EXCEPTIONS = set(
    "389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0 "
    "ecos-exception-2.0 fltk-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 libtool-exception "
    "linux-syscall-note llvm-exception lzma-exception mif-exception nokia-qt-exception-1.1 ocaml-lgpl-linking-exception openvpn-openssl-exception "
    "qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1".split()
)
NAMES = SINGLE | {
    f"{stem}-{version}{ending}": (label.format(version[0]), free) for stem, versions, endings, label, free in FAMILIES for version in versions.split() for ending in endings
}

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes of the text to bytes of the words: small letters, digits and non-ASCII stay, all else is a space.
_WORDS = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in _LOWER)
#: A slash counts between names, not at the end of a comment or a tag.
_TOKEN = re.compile(r"[()]|(?<![*/<])/(?=\s*[A-Za-z0-9(])|(?:(?i:documentref)-[A-Za-z0-9.-]+:)?[A-Za-z0-9.+-]+")
_OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_STOP = re.compile("[,;{}]")
_SPACE = re.compile(" ")
_RANK = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def _automata():
    """The automaton of phrases over joined words and that of tags over the text."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in PHRASES:
        phrases.add_word(f" {phrase} ", (phrase, label, False))
    for phrase, label in BASE:
        phrases.add_word(f" {phrase} ", (phrase, label, True))
    for tag, only in TAGS.items():
        tags.add_word(tag, (tag, only))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def known(name: str) -> tuple[str, bool] | None:
    """Label and permissive of a licence name, whatever its case; None if it is not in the table."""
    name = name.lower()
    if _OWN.fullmatch(name):
        return name, False
    return NAMES.get(name) or (NAMES.get(name[:-1]) if name.endswith("+") else None)


def label_of(name: str) -> str:
    """The label of a licence name, or the name itself."""
    found = known(name)
    return found[0] if found else name.lower()


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Postfix order by the shunting-yard method; None if the expression is broken."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether an operand stands just before
    for token in tokens:
        kind = token.lower()
        if kind in _RANK:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[kind]:
                out.append(stack.pop())
            stack.append(kind)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool] | None:
    """The labels of an expression, and whether it can be met by permissive licences alone; None if an exception is unknown."""
    stack: list[tuple[set[str], bool, str]] = []
    for token in postfix:
        if token not in _RANK:
            found = known(token)
            stack.append(({label_of(token)}, bool(found and found[1]), token.lower()))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # the right side names an exception, not a licence
            if right[2] not in EXCEPTIONS or not left[2]:
                return None
            stack.append((left[0], left[1], ""))
        elif token == "and":
            stack.append((left[0] | right[0], left[1] and right[1], ""))
        else:
            stack.append((left[0] | right[0], left[1] or right[1], ""))
    return stack[0][:2]


def expression(line: str) -> tuple[set[str], bool, bool, bool]:
    """Labels, permissive, whether the expression behind a tag is well formed, and whether all its names are known.

    The expression ends at a comma, semicolon or brace and where words stop alternating with
    operators, so what follows on the line does not belong to it.
    """
    tokens: list[str] = []
    depth, operand = 0, False
    for token in _TOKEN.findall(_STOP.split(line, 1)[0]):
        token = "or" if token == "/" else token
        kind = token.lower()
        if operand and (token == "(" or (kind not in _RANK and token != ")")):
            break
        if token == ")" and depth == 0:
            break
        depth += (token == "(") - (token == ")")
        operand = token == ")" or (token != "(" and kind not in _RANK)
        tokens.append(token)
    names = [t for t in tokens if t.lower() not in _RANK and t not in "()" and t.lower() not in EXCEPTIONS]
    whole = bool(names) and all(map(known, names))
    postfix = to_postfix(tokens)
    found = evaluate(postfix) if postfix is not None else None
    if found is None:
        return {label_of(t) for t in names}, False, False, whole
    return (*found, True, whole)


def tagged(text: str, lowered: str) -> list[tuple[set[str], bool, float]]:
    """Labels, permissive and score of the expressions behind tags, in the order of the text."""
    out = []
    for last, (tag, only) in _automata()[1].iter(lowered):
        start = last - len(tag) + 1
        if start and tag[0].isalnum() and (lowered[start - 1].isalnum() or lowered[start - 1] in "-_."):
            continue  # the end of a longer word
        stop = text.find("\n", last + 1)
        labels, free, whole, all_known = expression(text[last + 1 : len(text) if stop < 0 else stop])
        if only or whole and all_known:
            out.append((labels, free, 0.5 if not whole else 1.0 if all_known else 0.6))
    return out


def scan_text(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permissive of one text."""
    raw = (text or "").encode()
    words = raw.translate(_WORDS).split()
    joined = (b" " + b" ".join(words) + b" ").decode()
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    score, permissive = 0.0, None
    # From left to right, the longer first: what ends no later than an earlier hit lies within one.
    hits = sorted((end - len(phrase) - 1, -len(phrase), label, is_base) for end, (phrase, label, is_base) in _automata()[0].iter(joined))
    reached = -1
    for at, minus, label, is_base in hits:
        if not is_base and at - minus <= reached:
            continue
        reached = max(reached, at - minus)
        labels.add(label)
        score = max(score, 0.9 if is_base else 0.7)
        if is_base:
            base.add(label)
            places.append(at)
    for named, free, weight in tagged(text or "", raw.translate(_LOWER).decode()):
        labels |= named
        permissive = free if permissive is None else permissive and free
        score = max(score, weight)
    first = last = None
    if places:  # the spaces before a place are the number of its first word
        first, last = (sum(1 for _ in _SPACE.finditer(joined, 0, at)) for at in (min(places), max(places)))
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, permissive


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan(docs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        for batch in batches:
            rows = [scan_text(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(each, _SCHEMA)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tables.read(spark, sf_dir, "documents"))
