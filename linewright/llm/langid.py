"""Language identification by a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features; together with learned
transitions they score the label sequences of a chain, and forward-backward gives each
word's posterior, so code-switched text keeps its own label word by word. A chain is a
block of ``CHAIN`` words in a row. A document's language is the label with the largest
sum of posteriors over all its words, its score the mean posterior of that label.

The model is fitted on a bounded sample of labelled rows: at most ``SAMPLE_DOCS`` rows
in all and ``SAMPLE_WORDS`` words of each, chosen by hash among different documents that
are not held out (crc32 of the doc_id as text modulo 4 is not 2). It learns the
``LANGUAGES`` most frequent labels (of equally frequent ones the first by alphabet). Training chains splice pieces
of several sampled documents, so that transitions between languages can be learned.

Cases: a text that is null or has no letter is ``und`` with score 0. So is every text
where no row can be learned from. Of labels with equal sums the first by alphabet counts. A null doc_id is neither learned from nor held out.
Repeated rows are labelled alike. An empty table gives no rows. Columns other than
doc_id, text and lang are ignored; lang is read for learning only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import tables

CHAIN = 64
SAMPLE_DOCS = 2400
SAMPLE_WORDS = 120
LANGUAGES = 64
LEXICON = 4000
ROUNDS = 60
RATE = 0.15
DECAY = 1e-4
REMEMBERED = 200_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def features(word: str) -> list[str]:
    """Affixes of one to three characters, two- and three-grams with word ends, and the word itself."""
    marked = f"^{word}$"
    found = [f"<{word[:k]}" for k in (1, 2, 3)] + [f">{word[-k:]}" for k in (1, 2, 3)]
    found += [marked[i : i + 2] for i in range(len(marked) - 1)]
    found += [marked[i : i + 3] for i in range(len(marked) - 2)]
    found.append(f"={word}")
    return found


@dataclass
class Model:
    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray  # a row for each feature, a column for each label
    moves: np.ndarray  # from label, to label
    starts: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of label scores for each word."""
        known = [[self.index[f] for f in features(w) if f in self.index] for w in words]
        counts = np.array([len(k) for k in known])
        out = np.zeros((len(words), len(self.labels)), np.float32)
        some = np.flatnonzero(counts)
        if len(some):
            flat = np.fromiter((i for k in known for i in k), np.int64, int(counts.sum()))
            bounds = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
            out[some] = np.add.reduceat(self.weights[flat], bounds, axis=0)
        return out


def posteriors(scores: np.ndarray, real: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    scores: chains x places x labels; real: which places hold words (a prefix of each
    chain). Returns the posteriors, the expected moves summed over all chains, and the log
    of each chain's normaliser.
    """
    n, t, k = scores.shape
    e = np.ascontiguousarray(scores.transpose(1, 2, 0))  # places x labels x chains: each step reads memory in a row
    top = e.max(axis=1)
    e = np.exp(e - top[:, None])
    a = np.exp(moves).astype(e.dtype)
    goes = np.ascontiguousarray(real.T)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    scale = np.empty((t, n), e.dtype)
    alpha[0] = np.exp(starts)[:, None] * e[0]
    for i in range(t):
        if i:
            alpha[i] = (a.T @ alpha[i - 1]) * e[i]
        scale[i] = alpha[i].sum(axis=0)
        alpha[i] /= scale[i]
    joint = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        right = e[i + 1] * beta[i + 1] / scale[i + 1]
        beta[i] = np.where(goes[i + 1], a @ right, 1)
        joint += alpha[i] @ (right * goes[i + 1]).T
    alpha *= beta
    alpha /= alpha.sum(axis=1)[:, None]
    logz = np.where(goes, np.log(scale) + top, 0).sum(axis=0)
    return alpha.transpose(2, 0, 1), joint * a, logz


def into_chains(scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of several documents as padded chains: scores, real places, and each word's flat place."""
    chains = -(-counts // CHAIN)
    first = np.concatenate(([0], np.cumsum(chains)[:-1]))
    within = np.arange(int(counts.sum())) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    place = (np.repeat(first, counts)) * CHAIN + within
    n = int(chains.sum())
    padded = np.zeros((n * CHAIN, scores.shape[1]), np.float32)
    padded[place] = scores
    real = np.zeros(n * CHAIN, bool)
    real[place] = True
    return padded.reshape(n, CHAIN, -1), real.reshape(n, CHAIN), place


def fit(sample: list[tuple[str, list[str]]]) -> Model:
    """Fit on (language, words) rows by gradient ascent on the likelihood of spliced chains."""
    sample = [(lang, words) for lang, words in sample if words]
    labels = sorted({lang for lang, _ in sample})
    k = len(labels)
    number = {lang: i for i, lang in enumerate(labels)}
    draws = np.random.default_rng(7)
    pieces = [(number[lang], words[i : i + 24]) for lang, words in sample for i in range(0, len(words), 24)]
    spliced = [pieces[i] for i in draws.permutation(len(pieces))]
    # Half of the pieces follow each other in random order, half as they stand in their documents.
    half = len(pieces) // 2
    run = spliced[:half] + pieces
    words = [w for _, ws in run for w in ws]
    gold = np.concatenate([np.full(len(ws), lab) for lab, ws in run])

    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    frequent = {w for w, _ in Counter(words).most_common(LEXICON)}
    drawn = [features(w) for w in vocabulary]
    seen = Counter(f for fs in drawn for f in fs[:-1])
    lexicon = {f"={w}" for w in frequent}
    index = {f: i for i, f in enumerate([f for f, c in seen.items() if c > 1] + sorted(lexicon))}
    rows = np.array([i for i, fs in enumerate(drawn) for f in fs if f in index], np.int64)
    cols = np.array([index[f] for fs in drawn for f in fs if f in index], np.int64)

    ids = np.array([vocabulary[w] for w in words])
    n = len(words)
    counts = np.array([CHAIN] * (n // CHAIN) + ([n % CHAIN] if n % CHAIN else []))
    parameters = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
    mean = [np.zeros_like(p) for p in parameters]
    spread = [np.zeros_like(p) for p in parameters]
    one_hot = np.eye(k)[gold]
    begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
    follows = np.ones(n, bool)
    follows[begins] = False
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[np.flatnonzero(follows) - 1], gold[follows]), 1)
    for turn in range(1, ROUNDS + 1):
        weights, moves, starts = parameters
        per_word = np.stack([np.bincount(rows, weights[cols, j], len(vocabulary)) for j in range(k)], axis=1)
        scores, real, place = into_chains(per_word[ids].astype(np.float32), counts)
        post, joint, _ = posteriors(scores.astype(np.float64), real, moves, starts)
        error = one_hot - post.reshape(-1, k)[place]
        by_word = np.stack([np.bincount(ids, error[:, j], len(vocabulary)) for j in range(k)], axis=1)
        slopes = [
            np.stack([np.bincount(cols, by_word[rows, j], len(index)) for j in range(k)], axis=1) / n - DECAY * weights,
            (pairs - joint) / n - DECAY * moves,
            error[begins].sum(axis=0) / n - DECAY * starts,
        ]
        for p, m, v, g in zip(parameters, mean, spread, slopes):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Model(labels, index, parameters[0].astype(np.float32), parameters[1].astype(np.float32), parameters[2].astype(np.float32))


class Labeller:
    """Label sums of documents; remembers the scores of words seen before, in a table of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.labels)), np.float32)

    def _rows(self, documents: list[list[str]]) -> np.ndarray:
        fresh = set().union(*documents).difference(self.place)
        if len(self.place) + len(fresh) > REMEMBERED:
            self.place, self.scores = {}, self.scores[:0]
            fresh = set().union(*documents)
        if fresh:
            new = sorted(fresh)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.scores = np.concatenate((self.scores, self.model.emissions(new)))
        return np.fromiter((self.place[w] for d in documents for w in d), np.int64)

    def sums(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior sums by document and label, and how many words have each label as their likeliest."""
        counts = np.array([len(d) for d in documents])
        scores, real, place = into_chains(self.scores[rows], counts) if len(rows := self._rows(documents)) else (None, None, None)
        k = len(self.model.labels)
        if scores is None:
            return np.zeros((len(documents), k)), np.zeros((len(documents), k))
        post, _, _ = posteriors(scores, real, self.model.moves, self.model.starts)
        post = post.reshape(-1, k)[place]
        owner = np.repeat(np.arange(len(documents)), counts)
        best = post.argmax(axis=1)
        total = np.stack([np.bincount(owner, post[:, j], len(documents)) for j in range(k)], axis=1)
        votes = np.stack([np.bincount(owner, best == j, len(documents)) for j in range(k)], axis=1)
        return total, votes


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, most: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> list[tuple[str, list[str]]]:
    """A bounded sample of rows that may be learned from, even over the languages."""
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    different = F.approx_count_distinct(turn).alias("n")
    counts = dict(usable.groupBy("lang").agg(different).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    if not counts:
        return []
    each = max(1, most // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * each / n))])
    pieces = F.split("text", "\\s+")
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.size("pieces") - words, F.lit(1))) + 1
    # By turn within the share of their language, languages come evenly; repeated rows count once.
    chosen = usable.select("lang", "doc_id", "text", (turn / share[F.col("lang")]).alias("turn")).filter("turn < 1").distinct()
    chosen = chosen.orderBy("turn", "doc_id", "text").limit(2 * most).select("lang", "turn", "doc_id", pieces.alias("pieces"))
    rows = chosen.select("lang", "turn", "doc_id", F.array_join(F.slice("pieces", start.cast("int"), F.lit(words)), " ").alias("text")).collect()
    kept: list[tuple[str, list[str]]] = []
    taken: Counter = Counter()
    for row in sorted(rows, key=lambda r: (r["turn"], r["doc_id"], r["text"])):
        if taken[row["lang"]] < each:
            taken[row["lang"]] += 1
            kept.append((row["lang"], words_of(row["text"])))
    return kept


def predict(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    shared = spark.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column("text")
            names, scores, mixed = [], [], []
            for at in range(0, len(texts), 200):
                part = texts.slice(at, 200).to_pylist()
                lettered = [has_letter(t) for t in part]
                if labeller is None:
                    total = votes = np.zeros((len(part), 1))
                else:
                    documents = [words_of(t) if ok else [] for t, ok in zip(part, lettered)]
                    total, votes = labeller.sums(documents)
                best, sums = total.argmax(axis=1), total.sum(axis=1)
                for i, ok in enumerate(lettered):
                    fine = ok and sums[i] > 0
                    names.append(shared.value.labels[best[i]] if fine else UNKNOWN)
                    scores.append(float(min(1.0, total[i, best[i]] / sums[i])) if fine else 0.0)
                    mixed.append(int(votes[i].sum() - votes[i, best[i]]) if fine else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixed, pa.int64())],
                ["doc_id", "held_out", "lang_pred", "score", "n_other_words"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double, n_other_words long")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    learned = sample(docs)
    return predict(spark, docs, fit(learned) if any(words for _, words in learned) else None)
