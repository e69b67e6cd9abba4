"""Toxicity by non-negative positive-unlabelled learning over the words of whole texts.

Confirmed toxic documents and all documents, whose labels are not looked at, train a linear classifier
in numpy. The risk of the unlabelled part is corrected by the class prior: what
positives would add to it is taken off, and once that makes it negative, steps go the other way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, documents, quoted, settle
from tessera.llm.labelled import fold, free_name, labelled_sample, with_scores
from tessera.llm.memory import releasing
from tessera.llm.wordhash import WHITE, byte_chunks, distinct, hash_spans, prefix_hashes, runs

#: Words end at white space and at ASCII marks other than the apostrophe and the hyphen.
WORD_ENDS = WHITE.copy()
WORD_ENDS[[ord(c) for c in "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~"]] = True


#: Beginnings of longer words, in bytes, count as words too: they cover inflected forms.
STEMS = (4, 5, 6, 7, 8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and their beginnings, and the text of each; repeated ones stay."""
    prefix = prefix_hashes(data)
    found = runs(data, offsets, WORD_ENDS, prefix)
    doc, length = found.doc, found.ends - found.starts
    hashes, docs = [found.hashes], [doc]
    for n in STEMS:
        longer = length > n
        starts = found.starts[longer]
        hashes.append(hash_spans(prefix, starts, starts + n))
        docs.append(doc[longer])
    return np.concatenate(hashes), np.concatenate(docs)


def distinct_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, d, _ = distinct(*features(data, offsets))
    return h, d


@dataclass
class Linear:
    """vocabulary: sorted word hashes; weights by word; bias."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = np.full(len(offsets) - 1, self.bias)
        if len(self.vocabulary):
            words, ends = found_words(self.vocabulary, data, offsets)
            margin += np.bincount(np.repeat(np.arange(len(margin)), np.diff(ends)), self.weights[words], len(margin))
        return 1 / (1 + np.exp(-margin))


def sums(theta: np.ndarray, rows: np.ndarray, words: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What the risk and its gradient need of some rows: the loss as negatives and, by word and for the bias, the sums of scores; of confirmed rows, then of the others.

    (rows, words) are the ones of a 0/1 matrix. Sums of several tables add up to those of all their rows.
    """
    width = len(theta) - 1
    margin = np.bincount(rows, theta[words], len(positive)) + theta[-1]
    p = 1 / (1 + np.exp(-margin))
    as_negative = np.logaddexp(0, margin)
    out = []
    for own in (positive, ~positive):
        w = np.where(own, weight, 0.0)
        out += [[w @ as_negative], np.bincount(words, (w * p)[rows], width), [w @ p], np.bincount(words, w[rows], width), [w.sum()]]
    return np.concatenate(out)


def descend(evaluate: Callable[[np.ndarray], np.ndarray], width: int, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk of the logistic loss. evaluate: the sums over all rows at given weights (the bias is the last)."""
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        (loss_p, *score_p), count_p, (loss_u, *score_u), count_u = (part for half in np.split(evaluate(theta), 2) for part in np.split(half, [width + 2]))
        score_p, score_u = np.array(score_p), np.array(score_u)
        n_p, n_u = count_p[-1], count_u[-1]
        rest = loss_u / n_u - prior * loss_p / n_p
        # The risk of positives taken as such, less their part of the unlabelled ones' risk; once the rest would be negative, only the rest, upwards.
        slope = score_u / n_u - prior * count_p / n_p if rest >= 0 else prior * score_p / n_p - score_u / n_u
        grad = slope + ridge * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(rows: np.ndarray, words: np.ndarray, positive: np.ndarray, width: int, prior: float, weight: np.ndarray | None = None, **how: float) -> tuple[np.ndarray, float]:
    """Weights of words and the bias from rows in memory; positive marks the confirmed ones, weight tells how many documents a row stands for."""
    weight = np.ones(len(positive)) if weight is None else weight
    return descend(lambda theta: sums(theta, rows, words, positive, weight), width, prior, **how)


def matrix_of(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rows, words, positive and weight of a table of word lists."""
    lists = table["words"].combine_chunks() if isinstance(table, pa.Table) else table["words"]
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype("i8"), table["positive"].to_numpy(zero_copy_only=False).astype(bool), table["n"].to_numpy(zero_copy_only=False).astype(float)


def fit_table(sets: DataFrame, n: int, width: int, prior: float, in_memory: int, **how: float) -> tuple[np.ndarray, float]:
    """As fit, from a settled table (positive, words, n) of n rows: in the driver's memory if they are few, else each step sums over the table's partitions."""
    if n <= in_memory:
        batches = pa.Table.from_pandas(sets.toPandas(), schema=pa.schema([("positive", pa.bool_()), ("words", pa.list_(pa.int32())), ("n", pa.int64())]), preserve_index=False)
        rows, words, positive, weight = matrix_of(batches)
        return fit(rows, words, positive, width, prior, weight, **how)

    def evaluate(theta: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((sums(theta, *matrix_of(b)) for b in batches), np.zeros(4 * (len(theta) + 1) - 2))
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

        return sum((np.array(r["sums"]) for r in sets.mapInArrow(part, "sums array<double>").toLocalIterator()), np.zeros(4 * (width + 2) - 2))

    return descend(evaluate, width, prior, **how)


def found_words(vocabulary: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the vocabulary of each text's distinct words, in order, and the end of each text's."""
    if not len(vocabulary):
        return np.zeros(0, "i8"), np.zeros(len(offsets), "i8")
    h, d = features(data, offsets)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[at] == h
    doc, word = np.divmod(np.unique(d[hit] * len(vocabulary) + at[hit]), len(vocabulary))
    return word, np.searchsorted(doc, np.arange(len(offsets)))


@releasing
def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have each word."""
    for batch in batches:
        for _, _, data, offsets in byte_chunks(batch["text"]):
            h, _ = distinct_features(data, offsets)
            hashes, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view("i8")), pa.array(n)], ["word", "n"])


@releasing
def count_known(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many texts of the partition have each word of the vocabulary (at least one)."""
    total = np.zeros(len(vocabulary), "i8")
    for batch in batches:
        for _, _, data, offsets in byte_chunks(batch["text"]):
            total += np.bincount(found_words(vocabulary, data, offsets)[0], minlength=len(vocabulary))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(vocabulary[seen].view("i8")), pa.array(total[seen])], ["word", "n"])


@releasing
def word_lists(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in byte_chunks(batch["text"]):
            words, ends = found_words(vocabulary, data, offsets)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words.astype("i4")))], ["words"])


def train(docs: DataFrame, labels: DataFrame, positives: int = 6_000, in_memory: int = 200_000) -> Linear:
    """Learns from up to so many confirmed toxic documents outside the held-out fold, and from all documents, whose labels are not looked at.

    positives bounds the labelled sample, and with it the words that can become features: those of the sample. How many
    documents have such a word is counted over all of them. What the risk needs of the unlabelled ones is how many have which
    set of features; up to in_memory distinct sets are fitted in the driver, more of them by sums over their partitions.
    The prior is the share of toxic ones among the labelled documents outside that fold. Without a confirmed document, or
    without any telling word, every score is 0 in effect.
    """
    none = Linear(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    known = labels.filter(F.col("toxic").isNotNull() & (fold() != 0))
    prior = float(np.clip(known.agg(F.avg("toxic")).first()[0] or 0, 1e-3, 0.9))
    confirmed, n_p = settle(labelled_sample(docs, labels.filter("toxic = 1"), "toxic", positives).select("text"), "confirmed")
    if not n_p.rows:
        return none
    sampled = confirmed.mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("p")).filter("p >= 3").toPandas()
    sampled = sampled.assign(word=sampled["word"].to_numpy("i8").view("u8")).sort_values("word")
    candidates = sampled["word"].to_numpy("u8")
    if not len(candidates):
        return none
    texts = docs.select("text")
    n_u = texts.count()
    totals = texts.mapInArrow(lambda b: count_known(b, candidates), "word long, n long").groupBy("word").agg(F.sum("n").alias("u")).toPandas()  # one row for each candidate at most
    u = np.zeros(len(candidates))
    u[np.searchsorted(candidates, totals["word"].to_numpy("i8").view("u8"))] = totals["u"].to_numpy()
    p, chance = sampled["p"].to_numpy(float), n_p.rows / n_u * (u + 1)
    # Seen in so many confirmed documents that neither chance nor a few copies of one explain it, and by
    # the prior at least half of all documents that have it are toxic.
    vocabulary = candidates[(p >= 2 + chance + 4 * np.sqrt(chance)) & (prior * p >= 0.5 * chance)]
    if not len(vocabulary):
        return none
    lists = lambda rows, marked: rows.mapInArrow(lambda b: word_lists(b, vocabulary), "words array<int>").groupBy("words").agg(F.count("*").alias("n")).select(F.lit(marked).alias("positive"), "words", "n")
    sets, seen = settle(lists(confirmed, True).union(lists(texts, False)), "sets")
    model = Linear(vocabulary, *fit_table(sets, seen.rows, len(vocabulary), prior, in_memory))
    discard(confirmed, sets)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; other columns are not read.

    A null text scores as an empty one, a null doc_id is of the fold of the empty text, and repeated rows score alike
    and stay. Labels of unknown documents, null labels and null ids teach nothing. An empty table gives no row.
    """
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels).scores)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score less, with their own columns, whatever their names; nulls and repeats as in toxicity_scores."""
    name = free_name(docs, "score")
    return with_scores(docs, train(docs, labels).scores, name).filter(F.col(name) < least).select(*quoted(docs.columns))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from confirmed toxic ones and unlabelled text; odd rows as in toxicity_scores."""
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
