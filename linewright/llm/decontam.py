"""Benchmark decontamination by canonical templates.

Numbers, names and units of benchmark items and documents become typed placeholders, so a
question whose values were exchanged keeps its template. Windows of ``WINDOW`` template
words are hash-joined. A window stands for its template if at least ``LITERALS`` of its
words are plain, and always for its words themselves, so a verbatim copy is found however
many slots it has and however its capitals are read. Matches of a document and an item on
one diagonal (places that keep their distance) are one alignment. Its windows count if
their slots are consistent with all of it: each value of the item stands for one value of
the document and the reverse. Windows without any changed slot count always. A document
leaks an item where windows that count cover ``ENOUGH`` of it (thirteen words in a row),
or all of a shorter item; an item of ``LITERALS`` words to ``WINDOW`` is one window.

The items' window hashes also fill a bit map of bounded size (at most ``MAP_BITS`` bits)
that is broadcast, so only windows that may match leave the map stage; more items make
the map denser, not larger, and the join decides. Windows meet the distinct hashes first,
and only documents with enough of them meet items; a window that very many documents have
is dealt to several tasks (``SPREAD``).

Words are runs of ASCII letters, digits and non-ASCII characters. A number is a word of
digits, with all that points and commas join to it (2.5; 1,200), or a spelled number with
its tens and scales (twenty-five; three hundred; 2 million). A unit is a word of the unit
list behind a number. A name is a word with one capital, its first, that does not begin a
sentence or line, with all such words that single spaces join to it (New York). Each is one
word of the template. Whether the first word of an item begins a sentence depends on what
stands before it in a document, so an item's first window is made for either case.

Cases: a null or empty text has no windows. Items with fewer than LITERALS template words say too
little to be told from chance and are never found. Rows with a null doc_id or item_id are
left out of the report (and kept by ``keep_clean``). Repeated rows give one row of the
report. Empty tables give no rows. Columns other than doc_id, item_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import tables, textkit

WINDOW = 8
LITERALS = 4
ENOUGH = 6
MAP_BITS = 1 << 28
BITS_PER_WINDOW = 32
SEGMENT_BITS = 1 << 19
CHUNK_BYTES = 2 << 20
SPREAD = 4096
#: Units that may follow a number.
UNITS = (
    "km m cm mm mi miles mile feet foot ft inch inches yards kg g mg lb lbs pounds ounces oz tons l ml liters litres gallons "
    "s sec seconds second min minutes minute h hr hours hour days day weeks week months month years year percent dollars dollar "
    "usd eur euros euro cents cent mph kmh kg degrees degree watts volts joules"
).split()

#: Spelled numbers.
ONES = "one two three four five six seven eight nine".split()
TEENS = "zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = "hundred thousand million billion".split()

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_BREAK = np.zeros(256, np.int32)
_BREAK[[10, 33, 46, 58, 63]] = 1  # line feed ! . : ?
_NUMBER, _NAME, _UNIT, _VERBATIM = (np.uint64(v) for v in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
_WINDOW_FIELDS = "hash long, id long, at int, words binary, slots int"


def _hashes_of(listed: list[str]) -> np.ndarray:
    joined = np.frombuffer(" ".join(listed).encode(), np.uint8)
    starts, ends, _ = textkit.words(joined, np.array([0, len(joined)]))
    return np.unique(textkit.word_hashes(joined, starts, ends))


def _joined(data, starts, ends, first, digit, hashes, name) -> np.ndarray:
    """Which words belong to the number or name of the word before them."""
    joined = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return joined
    gap = data[np.minimum(ends[:-1], len(data) - 1)]
    space = gap == 32
    ones, tens, scale = (np.isin(hashes, _hashes_of(listed)) for listed in (ONES, TENS, SCALES))
    number = digit | ones | tens | scale | np.isin(hashes, _hashes_of(TEENS))
    grouped = digit[1:] & digit[:-1] & ((gap == 46) | (gap == 44))
    spelled = ((space | (gap == 45)) & tens[:-1] & ones[1:]) | (space & number[:-1] & scale[1:]) | (space & scale[:-1] & number[1:])
    joined[1:] = (starts[1:] - ends[:-1] == 1) & (grouped | spelled | (space & name[1:] & name[:-1]))
    joined[first[:-1][np.diff(first) > 0]] = False
    return joined


def templates(data: np.ndarray, offsets: np.ndarray, opening: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of template words by their own words and by their placeholders, whether each is a slot, and the first of each row.

    opening: whether the first word of a row begins a sentence.
    """
    starts, ends, first = textkit.words(data, offsets, _IS_WORD)
    if not len(starts):
        none = np.empty(0, np.uint64)
        return none, none.copy(), np.empty(0, bool), first
    total = lambda table: np.concatenate((np.zeros(1, np.int32), np.cumsum(table[data], dtype=np.int32)))
    digits, capitals, breaks = total(_DIGIT), total(_UPPER), total(_BREAK)
    # Capital Latin-1 letters are the bytes C3 80 - C3 9E but for the multiplication sign.
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    lowered = _LOWER[data]
    lowered[accented] += 32
    hashes = textkit.word_hashes(lowered, starts, ends)
    capital = capitals[starts + 1] > capitals[starts]
    capital |= accented[np.minimum(starts + 1, len(data) - 1)] & (ends - starts > 1)
    above = np.concatenate((np.zeros(1, np.int32), np.cumsum(accented, dtype=np.int32)))
    n_capitals = capitals[ends] - capitals[starts] + above[ends] - above[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    opens[first[:-1][np.diff(first) > 0]] = opening
    digit = digits[ends] - digits[starts] == ends - starts
    name = capital & (n_capitals == 1) & ~opens & (ends - starts > 1)
    number = digit | np.isin(hashes, _hashes_of(ONES + TEENS + TENS + SCALES))

    head = ~_joined(data, starts, ends, first, digit, hashes, name)
    heads = np.flatnonzero(head)
    first = np.concatenate(([0], np.cumsum(head)))[first]
    number, name, opens = number[heads], name[heads] & ~number[heads], opens[heads]
    hashes = textkit.word_hashes(lowered, starts[heads], ends[np.append(heads[1:], len(starts)) - 1])
    unit = np.zeros(len(heads), bool)
    unit[1:] = number[:-1] & ~opens[1:] & np.isin(hashes[1:], _hashes_of(UNITS))
    canonical = hashes.copy()
    canonical[name], canonical[unit], canonical[number] = _NAME, _UNIT, _NUMBER
    return hashes, canonical, number | name | unit, first


def _windows(column: str, lengths: tuple[int, ...] | None = None, bitmap=None, opening: bool = True):
    """Windows of each text: hash, id, place, the words' own hashes, and which words are slots (none in a verbatim one).

    Documents have a window of each of the lengths at each word; items, without lengths,
    have those of WINDOW words, or one of all their words. Places of documents count from
    the start, those of items from the end (where both readings of the first word agree).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            batch = batch.filter(batch.column(column).is_valid())
            data, offsets = textkit.text_bytes(batch.column("text"))
            ids = batch.column(column).to_numpy()
            for i, j in textkit.row_ranges(offsets, CHUNK_BYTES):
                words, canonical, slot, first = templates(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], opening)
                before = np.concatenate(([0], np.cumsum(slot)))
                for k in lengths or range(LITERALS, WINDOW + 1):
                    plain = textkit.window_hashes(canonical, k)
                    if not len(plain):
                        continue
                    if lengths or k == WINDOW:
                        whole = textkit.window_rows(first, k, len(plain))
                    else:
                        whole = np.zeros(len(plain), bool)
                        whole[first[:-1][np.diff(first) == k]] = True
                    n_slots = before[k:] - before[:-k]
                    verbatim = textkit.mix(textkit.window_hashes(words, k) ^ _VERBATIM)
                    for hashes, good, exact in ((plain, whole & (n_slots > 0) & (n_slots <= k - LITERALS), False), (verbatim, whole, True)):
                        at = np.flatnonzero(good if bits is None else good & _marked(bits, hashes))
                        at = at if opening else at[np.isin(at, first)]  # no other window has the first word
                        if len(at):
                            yield rows(hashes, at, k, words, None if exact else slot, first, ids[i:j])

    def rows(hashes, at, k, words, slot, first, ids) -> pa.RecordBatch:
        owner = np.searchsorted(first, at, "right") - 1
        spread = at[:, None] + np.arange(k)
        flags = np.zeros(len(at), np.int32) if slot is None else (slot[spread] << np.arange(k)).sum(axis=1).astype(np.int32)
        raw = pa.array([r.tobytes() for r in words[spread].astype("<u8")], pa.binary())
        place = at - first[owner] if lengths else first[owner + 1] - at
        columns = [pa.array(hashes[at].view(np.int64)), pa.array(ids[owner]), pa.array(place.astype(np.int32)), raw, pa.array(flags)]
        return pa.RecordBatch.from_arrays(columns, ["hash", "id", "at", "words", "slots"])

    return each


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bit_map(spark: SparkSession, items: DataFrame) -> np.ndarray:
    """A bit for each window hash of the items; its size is bounded whatever their number."""
    n = items.count()
    size = SEGMENT_BITS
    while size < min(MAP_BITS, n * BITS_PER_WINDOW):
        size *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            places = batch.column(0).to_numpy()
            for segment in np.unique(places // SEGMENT_BITS).tolist():
                bits = held.setdefault(segment, np.zeros(SEGMENT_BITS, bool))
                bits[places[places // SEGMENT_BITS == segment] % SEGMENT_BITS] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], pa.binary())], ["segment", "bits"])

    places = items.select(F.col("hash").bitwiseAND(F.lit(size - 1)).alias("place"))
    dealt = places.distinct().repartition(tables.partitions(spark), F.floor(F.col("place") / SEGMENT_BITS))
    bits = np.zeros(size // 8, np.uint8)
    for segment, part in dealt.mapInArrow(fill, "segment long, bits binary").collect():
        bits[segment * SEGMENT_BITS // 8 : (segment + 1) * SEGMENT_BITS // 8] = np.frombuffer(part, np.uint8)
    return bits


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, n_slots, n_changed), a row for each leaked item of a document."""
    texts = benchmark.selectExpr("cast(item_id AS long) AS item_id", "text")
    read = lambda opening: texts.mapInArrow(_windows("item_id", opening=opening), _WINDOW_FIELDS).withColumn("usual", F.lit(opening))
    items = tables.cut(spark, read(True).unionByName(read(False)), "items")
    first = lambda usual: F.max(F.when(F.col("usual") == usual, F.col("at")))
    sizes = items.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct(F.when(F.col("usual"), F.col("at"))).alias("item_windows"), (first(True) - first(False)).alias("_fewer"))
    # Where its first words are one name, an item has fewer windows.
    sizes = sizes.withColumn("need", F.least(F.lit(ENOUGH), F.greatest(F.col("item_windows") - F.coalesce("_fewer", F.lit(0)), F.lit(1)))).drop("_fewer")
    lengths = items.select((F.octet_length("words") / 8).cast("int").alias("k")).distinct().collect()  # at most WINDOW - LITERALS + 1 numbers
    lengths = tuple(sorted({r["k"] for r in lengths} or {WINDOW}))
    bitmap = spark.sparkContext.broadcast(bit_map(spark, items))
    found = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_windows("doc_id", lengths, bitmap), _WINDOW_FIELDS)
    found = tables.cut(spark, found, "windows")

    # Each distinct hash: how many windows of documents have it, and how many an item with it needs at least.
    hashes = items.join(sizes, items["id"] == sizes["item_id"]).groupBy("hash").agg(F.min("need").alias("need"))
    hashes = found.groupBy("hash").agg(F.count("*").alias("_n")).join(hashes, "hash").withColumn("spread", F.ceil(F.col("_n") / SPREAD).cast("int"))
    hashes = tables.cut(spark, hashes, "hashes")
    known = tables.attach(found, hashes, ["hash"], found.count())
    able = known.groupBy("id").agg(F.countDistinct("at").alias("n"), F.min("need").alias("need")).filter("n >= need").select("id")
    known = known.join(able, "id", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.col("spread")).cast("int"))
    item_side = items.join(hashes.select("hash", "spread"), "hash").select(
        "hash", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("words").alias("item_words"), "slots", "usual",
        F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"),
    )
    met = known.join(item_side, ["hash", "slots", "salt"])

    word = lambda c, i: F.substring(F.col(c), i * 8 + 1, F.lit(8))
    is_slot = lambda i: F.call_function("getbit", F.col("slots"), i) == 1
    slots = F.filter(F.sequence(F.lit(0), F.lit(WINDOW - 1)), is_slot)
    pairs = F.transform(slots, lambda i: F.struct(word("item_words", i).alias("item"), word("words", i).alias("doc")))
    met = met.select(F.col("id").alias("doc_id"), "item_id", "usual", "item_at", (F.col("at") + F.col("item_at")).alias("diagonal"), pairs.alias("pairs"))
    # An alignment has at most as many windows as its item.
    windows = F.collect_set(F.struct(F.col("item_at").alias("place"), "pairs"))
    aligned = met.groupBy("doc_id", "item_id", "usual", "diagonal").agg(windows.alias("windows"))
    aligned = aligned.withColumn("pairs", F.array_distinct(F.flatten("windows.pairs")))
    # Values with several partners; a window that has one counts only if it is verbatim.
    repeated = lambda c: F.filter(c, lambda v, i: (i > 0) & (v == F.get(c, i - 1)))
    aligned = aligned.withColumns({f"sorted_{side}": F.array_sort(f"pairs.{side}") for side in ("item", "doc")})
    aligned = aligned.withColumns({f"torn_{side}": repeated(F.col(f"sorted_{side}")) for side in ("item", "doc")})
    torn = lambda w: F.arrays_overlap(w["pairs"]["item"], F.col("torn_item")) | F.arrays_overlap(w["pairs"]["doc"], F.col("torn_doc"))
    verbatim = lambda w: F.forall(w["pairs"], lambda p: p["item"] == p["doc"])
    aligned = aligned.withColumn("windows", F.filter("windows", lambda w: ~torn(w) | verbatim(w))).withColumn("pairs", F.array_distinct(F.flatten("windows.pairs")))
    changed = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"]))
    aligned = aligned.select("doc_id", "item_id", "usual", F.explode("windows.place").alias("place"), F.size("pairs").alias("n"), changed.alias("c"))
    most = lambda c, name: F.coalesce(F.max(F.when(F.col("usual"), F.col(c))), F.max(c)).alias(name)
    covered = aligned.groupBy("doc_id", "item_id").agg(F.countDistinct("place").alias("n_windows"), most("n", "n_slots"), most("c", "n_changed"))
    rated = covered.join(sizes, "item_id").withColumn("n_windows", F.least("n_windows", "item_windows")).filter(F.col("n_windows") >= F.col("need"))
    return rated.select("doc_id", "item_id", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), "n_slots", "n_changed")


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with the columns they came with."""
    bad = leaks(spark, docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark"))
