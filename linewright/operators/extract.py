"""Extraction of text fragments from lines, with a reason for everything rejected.

One expression serves both: ``trace`` gives every candidate with the rule that rejects it, and
``fragments`` is what no rule rejects. Order is explicit throughout: seq numbers the
candidates of a document by line, chunk and match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import nesting, rx
from linewright.operators import lines as L
from linewright.sources import shared

# The default patterns.
BASE = (
    "([：＋a-zA-ZＡ-Ｚ０-９0-9ぁ-んァ-ヶ一-龠々〆〤【】（）「」『』！？、。…，．？！,.―ーッ%\"“”‘’～〜]{3,})"
)
INVALID = (
    "^[―ノツ人乂彡ミﾘﾊｿヽ丶、,.亠厂イ从「二ィ八ヘ二三ミノ王丁二爻」淡上丕旦丑．逑斧丞圭歪秘炸冽洲竺今一垈劣迦才守於主釼恢刈淤寸心イ气逍アA-Za-z個斗]+$"
)
SYMBOL = "[ノツ人乂彡ミﾘﾊｿヽ、,\\.亠厂イ从「二ィ八ヘ三王丁爻」淡上丕旦丑￣＿／＼\\|┌└┐┘│─━┏┓┣┫┝╿╂┴┬┤├:]"
POSTER_LINE = "ID:[A-Za-z0-9+/.]{6,}"
DICE = "(【\\d+D\\d+):(\\d+】)"
WIDE_DICE = "(【\\d+D\\d+)：(\\d+】)"
NOT_TEXT_START = "^[^\\u3040-\\u309F\\u30A0-\\u30FF\\u4E00-\\u9FFFa-zA-ZＡ-Ｚａ-ｚ0-9０-９]+"
LETTERS = "^[a-zA-Z\\u3040-\\u30FF\\u4E00-\\u9FFF]+\\z"
FEW = 100_000  # so many repeated ids are broadcast
SINGLE_KANA = "[ 　.．\\-－‐—―ーｰ…][アあハはンんオおで][。?？！!]"

_CANDIDATES = "array<struct<chunk_no:int,match_no:int,text:string,reason:string>>"


@dataclass(frozen=True)
class Config:
    """Patterns and rules of an extraction; invalid patterns fall back to the defaults."""

    base: str = BASE
    invalid: str = INVALID
    symbol: str = SYMBOL
    filters: tuple[str, ...] = ()
    skip_title: str = ""
    author: str = ""
    brackets: bool = True

    def checked(self) -> Config:
        base = self.base if rx.groups(self.base) in (0, 1) else BASE
        return Config(
            base,
            self.invalid if rx.valid(self.invalid) else INVALID,
            self.symbol if rx.valid(self.symbol) else SYMBOL,
            self.filters, self.skip_title, self.author, self.brackets,
        )

    @property
    def author_key(self) -> str:
        """The longest run of six or more letters and digits in the author's name; the first of equals."""
        import re

        return max(re.findall("[A-Za-z0-9]{6,}", self.author), key=len, default="")


def tidy(text: Column) -> Column:
    """Keep what bars frame; drop what cannot begin or end a fragment."""
    framed = "[│|](.*)[│|]"
    text = F.when(text.rlike(framed), F.btrim(F.regexp_extract(text, framed, 1), F.lit(" \t　."))).otherwise(text)
    text = rx.strip(F.regexp_replace(text, NOT_TEXT_START, ""))
    text = rx.strip(F.regexp_replace(text, "^[0-9０-９]+[.．]", ""))
    return rx.strip(F.rtrim(text, F.lit("|｜(（")))


def symbols(text: Column, symbol: str = SYMBOL) -> Column:
    """How many characters of drawings a text has."""
    return F.regexp_count(text, F.lit(symbol))


def is_dense(text: Column, symbol: str = SYMBOL) -> Column:
    """Whether more than half of a text is drawing."""
    return symbols(text, symbol) > F.length(text) * 0.5


def _line_reason(line: Column, line_no: Column, at_title: Column, title: Column) -> Column:
    """Why a whole line is rejected; null where it is not."""
    is_title = (line_no == at_title) & (rx.strip(line) == title)
    return F.when(is_title, "title").when(line.rlike(POSTER_LINE), "poster line")


def _named(text: Column, c: Config) -> Column:
    """Whether a text is the author's name."""
    author = c.author.strip()
    return (text == author) | ((text == c.author_key) if c.author_key else F.lit(False)) if author else F.lit(False)


def _ended(text: Column, line: Column, marked: Column, c: Config, put) -> Column:
    """What no rule rejects so far, completed and filtered; ``put`` makes a candidate of text and reason."""

    def filtered(whole: Column) -> Column:
        return put(whole, F.when(rx.any_match(whole, c.filters), "filter"))

    if not c.brackets:
        return filtered(text)
    return rx.let(F.when(marked, nesting.complete_brackets(text, line)).otherwise(text), filtered)


def _judged(raw: Column, line: Column, marked: Column, early: Column, c: Config, put) -> Column:
    """A candidate judged; ``early`` is why its chunk or line is rejected, ``marked`` whether its line has brackets."""
    invalid = lambda plain: plain.rlike(f"^(?:{c.invalid})")

    def hard(bare: Column) -> Column:
        def read(plain: Column) -> Column:
            reason = F.coalesce(early, F.when(F.length(bare) < 3, "short").when(invalid(plain), "invalid"))
            # What is rejected by now, and that is most of it, is neither tidied nor completed.
            rejected = put(F.when(early.isNull(), plain).otherwise(raw), reason)

            def tidied(text: Column) -> Column:
                late = F.when(F.length(text) <= 2, "short after tidying").when(_named(text, c), "author")
                return F.when(late.isNotNull(), put(plain, late)).otherwise(_ended(text, line, marked, c, put))

            return F.when(reason.isNotNull(), rejected).otherwise(rx.let(tidy(plain), tidied))

        return rx.let(F.regexp_replace(bare, WIDE_DICE, "$1:$2"), read)

    # Nothing of a text of letters is trimmed, replaced or tidied; most of those that are kept pass by one pattern.
    plainly = raw.rlike(f"^(?!(?:{c.invalid})){LETTERS[1:].replace('+', '{3,}')}") & ~_named(raw, c)
    easy = F.when(F.length(raw) < 3, "short").when(invalid(raw), "invalid").when(_named(raw, c), "author")
    easily = F.when(easy.isNotNull(), put(raw, easy)).otherwise(_ended(raw, line, marked, c, put))
    quick = F.when(early.isNull() & plainly, _ended(raw, line, marked, c, put)).when(early.isNull() & raw.rlike(LETTERS), easily)
    return quick.otherwise(rx.let(rx.strip(raw), hard))


def _candidates(line: Column, reason: Column, c: Config) -> Column:
    """The candidates of a line in order, as an array of (chunk_no, match_no, text, reason)."""
    group = 1 if rx.groups(c.base) else 0

    def of_chunk(chunk: Column, i: Column, line_reason: Column, marked: Column) -> Column:
        def matched(why: Column) -> Column:
            raws = F.when(why.isNull(), F.regexp_extract_all(chunk, F.lit(c.base), F.lit(group))).otherwise(F.array(chunk))

            def one(raw: Column, j: Column) -> Column:
                put = lambda text, reason: F.struct(i.alias("chunk_no"), j.alias("match_no"), text.alias("text"), reason.cast("string").alias("reason"))
                return _judged(raw, line, marked, why, c, put)

            return F.transform(raws, one)

        dense = F.coalesce(line_reason, F.when(is_dense(chunk, c.symbol), "symbols"))
        return F.when(line_reason.isNull() & rx.is_blank(chunk), F.array().cast(_CANDIDATES)).otherwise(rx.let(dense, matched))

    def of_line(z: Column) -> Column:
        cut = F.split(F.regexp_replace(line, DICE, "$1：$2"), "[ 　]{2,}", -1)
        chunks = F.when(z["reason"].isNull(), cut).otherwise(F.array(line))
        return F.flatten(F.transform(chunks, lambda chunk, i: of_chunk(chunk, i, z["reason"], z["marked"])))

    marked = nesting.has_brackets(line) if c.brackets else F.lit(False)
    return rx.let(F.struct(reason.alias("reason"), marked.alias("marked")), of_line)


def trace(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, line_no, chunk_no, match_no, text, reason) for every candidate; reason is null where it is kept.

    What is kept, or falls to a filter, is tidied and completed; what is rejected before stands as it was found.
    """
    c = config.checked()
    title = rx.strip(F.lit(c.skip_title))
    at_title = F.when(title != "", L.first_line_with_text(F.col("text"))).otherwise(F.lit(0))
    rows = docs.select("doc_id", at_title.alias("_title"), F.posexplode(L.split_lines(F.col("text"))).alias("_at", "line")).withColumn("line_no", F.col("_at") + 1)
    return rows.select("doc_id", "line_no", F.inline(_candidates(F.col("line"), _line_reason(F.col("line"), F.col("line_no"), F.col("_title"), title), c)))


def _kept(text: Column, c: Config) -> Column:
    """What is kept of a text in order, as an array of (line_no, sub, text); sub numbers a line's fragments from 1."""
    title = rx.strip(F.lit(c.skip_title))
    at_title = F.when(title != "", L.first_line_with_text(text)).otherwise(F.lit(0))

    def of_line(line: Column, i: Column, first: Column) -> Column:
        held = F.filter(_candidates(line, _line_reason(line, i + 1, first, title), c), lambda x: x["reason"].isNull() & (x["text"] != ""))
        return F.transform(held, lambda x, k: F.struct((i + 1).alias("line_no"), (k + 1).alias("sub"), x["text"].alias("text")))

    return rx.let(at_title, lambda first: F.flatten(F.transform(L.split_lines(text), lambda line, i: of_line(line, i, first))))


def _frag_id(line_no: Column, sub: Column) -> Column:
    """NNN-S."""
    number = line_no.cast("string")
    return F.concat_ws("-", F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")), sub.cast("string"))


def _alone(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents whose id is theirs alone, and the others, if there are any."""
    several = shared.written(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id"), "repeated")
    n = several.count()
    if not n:
        return docs, None
    several = (F.broadcast(several) if n <= FEW else several).withColumnRenamed("doc_id", "_again")
    again = F.col("doc_id").eqNullSafe(F.col("_again"))
    return docs.join(several, again, "left_anti"), docs.join(several, again, "left_semi")


def _parts(docs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame | None]:
    """Documents whose id is theirs alone, as (doc_id, found) with an array of (line_no, sub, text); and the fragments of the others, if there are any.

    Numbering the fragments of a text needs that text only, so nothing of it is shuffled or
    sorted. Texts that share a doc_id, or have none, are numbered together by windows.
    """
    c = config.checked()
    alone, several = _alone(docs.select("doc_id", "text"))
    # A generator, since a filter on what is found would else be pushed below and take the texts apart once more.
    own = alone.select("doc_id", F.explode(F.array(_kept(F.col("text"), c))).alias("found"))
    if several is None:
        return own, None
    kept = trace(several.repartition("doc_id"), config).filter("reason IS NULL AND text <> ''")
    order = Window.partitionBy("doc_id").orderBy("line_no", "chunk_no", "match_no")
    return own, kept.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "line_no", "text")


def beside(docs: DataFrame, made: Callable[[dict[str, Column]], Column], name: str, config: Config = Config()) -> tuple[DataFrame, DataFrame | None]:
    """Documents whose id is theirs alone with what ``made`` gives of their fragments in order, as an array ``name``; and the others, if there are any.

    ``made`` gets a fragment's seq, line_no, text and sub. Texts are dealt first, since a table may have few row groups.
    """

    def one(x: Column, i: Column) -> Column:
        return made({"seq": i.cast("long"), "line_no": x["line_no"], "text": x["text"], "sub": x["sub"]})

    own, several = _alone(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(n, "doc_id").withColumn(name, F.transform(_kept(F.col("text"), config.checked()), one)), several


def _both(own: DataFrame, rest: DataFrame | None) -> DataFrame:
    return own if rest is None else own.unionByName(rest.select(*own.columns))


def fragments(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, seq, line_no, text) of what is kept, in order, duplicates included."""
    own, rest = _parts(docs, config)
    rows = own.select("doc_id", F.posexplode("found").alias("_at", "x"))
    return _both(rows.select("doc_id", F.col("_at").cast("long").alias("seq"), "x.line_no", "x.text"), rest)


def numbered(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """As ``with_ids`` of ``fragments``, without sorting them."""
    own, rest = _parts(docs, config)
    rows = own.select("doc_id", F.posexplode("found").alias("_at", "x")).select("doc_id", F.col("_at").cast("long").alias("seq"), "x.line_no", "x.text", "x.sub")
    rows = rows.withColumn("frag_id", _frag_id(F.col("line_no"), F.col("sub")))
    return _both(rows, None if rest is None else with_ids(rest))


def halved(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """As ``lines.halves`` of each document's fragments in order, without sorting them."""
    own, rest = _parts(docs, config)
    rows = own.select("doc_id", F.size("found").alias("_n"), F.posexplode("found").alias("_at", "x"))
    half = F.when(F.col("_at") * 2 < F.col("_n"), 1).otherwise(2).alias("half")
    rows = rows.select("doc_id", F.col("_at").cast("long").alias("seq"), "x.line_no", "x.text", half)
    return _both(rows, None if rest is None else L.halves(rest, ["seq"], ["doc_id"]))


def written_texts(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """As ``written`` of ``fragments``, a document at a time."""
    own, rest = _parts(docs, config)
    rows = F.transform("found", lambda x: F.concat(_frag_id(x["line_no"], x["sub"]), F.lit("|"), x["text"]))
    texts = own.filter(F.size("found") > 0).select("doc_id", F.array_join(rows, "\n").alias("text"))
    return _both(texts, None if rest is None else written(rest))


def next_fragments_of(docs: DataFrame, line: int, config: Config = Config()) -> DataFrame:
    """As ``next_fragment`` of ``fragments``, a document at a time."""
    own, rest = _parts(docs, config)
    first = F.get(F.filter("found", lambda x: x["line_no"] >= line), F.lit(0))
    rows = own.select("doc_id", first.alias("x")).filter("x IS NOT NULL").select("doc_id", _frag_id(F.col("x.line_no"), F.col("x.sub")).alias("frag_id"))
    return _both(rows, None if rest is None else next_fragment(rest, line))


def single_kana(docs: DataFrame, filters: tuple[str, ...] = ()) -> DataFrame:
    """Single kana between a mark and an end of sentence: (doc_id, line_no, match_no, text)."""
    rows = L.to_lines(docs)
    rows = rows.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(SINGLE_KANA), F.lit(0))).alias("match_no", "text"))
    return rows.filter(~rx.any_match(F.col("text"), filters))


def all_fragments(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Fragments, then single kana whose text is new to the line."""
    main = fragments(docs, config)
    first = Window.partitionBy("doc_id", "line_no", "text").orderBy("match_no")
    kana = single_kana(docs, config.filters).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    kana = kana.join(main, ["doc_id", "line_no", "text"], "left_anti")
    both = main.select("doc_id", F.lit(0).alias("_part"), "seq", "line_no", F.lit(0).alias("match_no"), "text").unionByName(
        kana.select("doc_id", F.lit(1).alias("_part"), F.lit(0).cast("long").alias("seq"), "line_no", "match_no", "text")
    )
    order = Window.partitionBy("doc_id").orderBy("_part", "seq", "line_no", "match_no")
    return both.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "line_no", "text")


def with_ids(found: DataFrame) -> DataFrame:
    """Fragments with their number within the line and their id, NNN-S."""
    sub = F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy("seq"))
    return found.withColumn("sub", sub).withColumn("frag_id", F.format_string("%03d-%d", "line_no", "sub"))


def written(found: DataFrame) -> DataFrame:
    """Per document the wire format, a line ``NNN-S|text`` for each fragment."""
    row = F.struct("seq", F.concat_ws("|", "frag_id", "text").alias("row"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"]), "\n")
    return with_ids(found).groupBy("doc_id").agg(joined.alias("text"))


def next_fragment(found: DataFrame, line: int) -> DataFrame:
    """Per document the first fragment at or below a line."""
    return with_ids(found).filter(F.col("line_no") >= line).groupBy("doc_id").agg(F.min_by("frag_id", "seq").alias("frag_id"))


def rules_from_selection(selected: DataFrame, existing: DataFrame) -> DataFrame:
    """Selected fragment lines as filter rules: ids and blanks go, and what is already a rule."""
    rule = rx.strip(F.regexp_replace("line", "(?U)^\\s*\\d{2,5}-\\d+\\|", ""))
    return selected.withColumn("rule", rule).filter("rule <> ''").join(existing.select("rule"), "rule", "left_anti")
