"""URL filters: host and path rules, then words of the host weighed by naive Bayes.

A rule is a host and the beginning of a path; it fits the host and all its subdomains, and
the longest fitting rule decides. All other urls are judged by their words. Host labels and
path parts are cut into runs of letters, and a unigram Viterbi pass splits every run into
the most probable words: ``cheappills`` is ``cheap pills``. Words and their counts come from
the texts of all pages, from path parts, and from labels that hyphens divide already; a
word needs a 100,000th of all counts, so there are 100,000 at most, whatever the input. The
lists below are always among them. Multinomial naive Bayes then scores the words.

It learns from all urls: those with a word of ``SEEDS`` are examples of what to block, the
others of what to allow. Counts of both classes are brought to the mass of the smaller one,
so a rare but harmless word is neutral; the prior is ``PRIOR``. A url is blocked where the
posterior is over a half.

Cases: a null url, or one without ://, has an empty host and path, no rule and the verdict
allow. Numbers count as one word. Runs that no word fits, and words never learned from,
say nothing. Repeated rows are judged alike and count as often as they occur. An empty
table gives no rows. Very long urls take time in proportion to their length. Columns other
than page_id, url and html are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import tables

#: (verdict, host and path prefix).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

# Words that mark a url as an example of what to block.
SEEDS = """
adult ads adserver bet bets betting bingo bookmaker camgirls cams casino casinos cialis clickbait cracks doubleclick escort escorts
fetish gambling hentai jackpot keygen levitra lottery malware milf nude nudes payday phishing pills poker popups porn porno pornos
replica roulette scam sex sexcam slots spam spyware strip torrent tracker trackers viagra warez xanax xxx
""".split()

# Common words of host names, which texts may not contain.
COMMON = """
art auto bank best big biz blog book books box buy camp car care cars chat cheap city class click cloud club code cook craft daily data
deal deals design digital direct dog essex express fan farm fast film find first fit food forum free fresh fun game games garden gift girl
gold good great green group guide health help home host hot hotel house info job jobs kids land learn library life line link list live
local love mail market media meet middlesex money movie music my net network news now online page party pay photo phone play post
press price pro project quick radio real red review room sale school science shop site smart social soft sport star start store story
studio style sussex team tech test time tip tips top tour toy track trade travel tree tube video view war watch water way web wiki win
wine wood word work world write zone
""".split()

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHARE = 100_000
LONGEST = 20
SMOOTH = 0.25
PRIOR = 0.1
NUMBER = "0"
HELD = 200_000

_RUN = re.compile(r"[^\W\d_]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"<[^<>]*>")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): A-Z lower-cased, nothing decoded."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), LETTERS, LETTERS.lower())
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits. Of rules of equal length the one with the longer host counts."""
    parted = sorted(((*text.partition("/")[::2], verdict, text) for verdict, text in rules), key=lambda r: (-len(r[3]), -len(r[0]), r[3]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}") for h, p, _, _ in parted]
    rule = F.coalesce(*(F.when(f, F.lit(text)) for f, (_, _, _, text) in zip(fits, parted, strict=True)), F.lit(None).cast("string"))
    verdict = F.coalesce(*(F.when(f, F.lit(v)) for f, (_, _, v, _) in zip(fits, parted, strict=True)), F.lit(None).cast("string"))
    return rule, verdict


@dataclass(frozen=True)
class Lexicon:
    """Logarithms of word probabilities; a run of unknown letters costs a factor of ten for each."""

    words: dict[str, float]
    unknown: float

    def split(self, run: str) -> list[tuple[str, bool]]:
        """The most probable (word, known) parts of a run of letters; of equal ones the last part is the longest."""
        best, last = [0.0], [0]
        for end in range(1, len(run) + 1):
            top, at = -math.inf, end - 1
            for start in range(max(0, end - LONGEST), end):
                found = self.words.get(run[start:end])
                score = best[start] + (self.unknown - math.log(10) * (end - start) if found is None else found)
                if score > top:
                    top, at = score, start
            best.append(top)
            last.append(at)
        out, end = [], len(run)
        while end:
            word = run[last[end] : end]
            out.append((word, word in self.words))
            end = last[end]
        return out[::-1]


class Splitter:
    """Words of hosts and paths; runs met before are looked up."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.met = lexicon, {}

    def words(self, host: str, path: str) -> list[str]:
        """Numbers count as one word, unknown parts in brackets."""
        out = []
        for run in _RUN.findall(f"{host}/{path.lower()}"):
            if run[0].isdigit():
                out.append(NUMBER)
                continue
            parts = self.met.get(run)
            if parts is None:
                parts = [w if known else f"({w})" for w, known in self.lexicon.split(run)]
                if len(self.met) >= HELD:
                    self.met.clear()
                if len(run) <= 256:
                    self.met[run] = parts
            out += parts
        return out


def is_word(word: str) -> bool:
    return word[0] != "("


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of page texts, of path parts, and of host labels that hyphens divide."""
    held: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for rows in batches:
        for host, path, html in zip(*(rows.column(n).to_pylist() for n in ("host", "path", "html")), strict=True):
            texts = [_TAG.sub(" ", html or ""), path, *(label for label in host.split(".") if "-" in label)]
            for text in texts:
                held.update(w for w in _WORD.findall(text.lower()) if len(w) <= LONGEST)
            if len(held) >= HELD:
                yield batch()
                held.clear()
    if held:
        yield batch()


def lexicon(spark: SparkSession, urls: DataFrame) -> Lexicon:
    """Words with at least a 100,000th of all counts, and the fixed lists with that much."""
    counts = tables.cut(spark, urls.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    mass = counts.agg(F.sum("n")).first()[0] or SHARE
    known = {w: mass / SHARE for w in (*SEEDS, *COMMON)}
    for r in counts.filter(F.col("n") * SHARE >= mass).collect():  # SHARE rows at most
        known[r["word"]] = max(known.get(r["word"], 0), r["n"])
    return Lexicon({w: math.log(n / mass) for w, n in known.items()}, -math.log(mass))


@dataclass(frozen=True)
class Bayes:
    """For each word the logarithm of how much likelier it is among what to block."""

    weights: dict[str, float]
    prior: float

    def score(self, words: list[str]) -> float:
        odds = self.prior + sum(self.weights.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def learn(urls: DataFrame, known: Lexicon) -> Bayes:
    """Word counts of all urls by class; there are no more words than the lexicon has."""
    shared = urls.sparkSession.sparkContext.broadcast(known)
    seeds = frozenset(SEEDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held = Splitter(shared.value), {True: Counter(), False: Counter()}
        for rows in batches:
            for host, path in zip(rows.column("host").to_pylist(), rows.column("path").to_pylist(), strict=True):
                words = [w for w in splitter.words(host, path) if is_word(w)]
                held[not seeds.isdisjoint(words)].update(words)
        found = [(w, bad, n) for bad, counts in held.items() for w, n in counts.items()]
        if found:
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.int64()), strict=True)], ["word", "bad", "n"])

    counts = urls.select("host", "path").mapInArrow(count, "word string, bad boolean, n long").groupBy("word")
    rows = counts.agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good")).collect()
    bad, good = sum(r["bad"] for r in rows), sum(r["good"] for r in rows)
    least = min(bad, good)
    if not least:
        return Bayes({}, math.log(PRIOR / (1 - PRIOR)))
    weights = {r["word"]: math.log((r["bad"] * least / bad + SMOOTH) / (r["good"] * least / good + SMOOTH)) for r in rows}
    return Bayes(weights, math.log(PRIOR / (1 - PRIOR)))


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words (unknown parts in brackets) and score (probability of block by its words)."""
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html").alias("html"))
    known = lexicon(spark, urls.select("host", "path", "html"))
    shared, model = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(learn(urls, known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(shared.value)
        for rows in batches:
            words = [splitter.words(h, p) for h, p in zip(rows.column("host").to_pylist(), rows.column("path").to_pylist(), strict=True)]
            scores = pa.array([model.value.score(w) for w in words], pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([" ".join(w) for w in words], pa.string()), scores], [*rows.schema.names, "words", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = urls.select("page_id", "host", "path").mapInArrow(score, f"page_id {kind}, host string, path string, words string, score double")
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(ruled, F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "words", "score")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, tables.read(spark, sf_dir, "pages"))
