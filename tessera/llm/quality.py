"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, quoted
from tessera.llm.labelled import fold, free_name, labelled_sample, with_scores
from tessera.llm.memory import releasing
from tessera.llm.wordhash import byte_chunks, distinct, prefix_hashes, runs, shingles

NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True


def byte_classes() -> tuple[np.ndarray, int]:
    """A class for each byte: capital, small letter, digit, white space, sentence marks, '!', pipes and brackets, other marks, control, lead and trail bytes."""
    kind = np.full(256, 8, np.uint8)
    kind[0x21:0x7F] = 7
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A] = 0, 1, 2
    kind[[0x20, *range(0x09, 0x0E)]] = 3
    kind[[ord(c) for c in ".,;:'\"-?"]], kind[ord("!")], kind[[ord(c) for c in "|[]{}()<>"]] = 4, 5, 6
    kind[0x80:0xC0], kind[0xC0:] = 9, 10
    return kind, 11


def repetition(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: items, share of distinct ones, share of the most common one."""
    total = np.bincount(docs, minlength=n).astype(float)
    _, d, times = distinct(hashes, docs)
    most = np.zeros(n)
    np.maximum.at(most, d, times)
    return total, np.bincount(d, minlength=n) / np.maximum(total, 1), most / np.maximum(total, 1)


def running(flags: np.ndarray) -> np.ndarray:
    """How many of the flags before each place are set; a text has less than 2**31 bytes, as Arrow's strings have."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text; those of an empty text are all 0."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    kinds, many = byte_classes()
    kind = kinds[data]
    slot = np.repeat(np.arange(n) * many, sizes)
    slot += kind
    by = np.bincount(slot, minlength=n * many).reshape(n, many) / np.maximum(sizes, 1)[:, None]
    del slot
    prefix = prefix_hashes(data)
    words, lines = runs(data, offsets, prefix=prefix), runs(data, offsets, NEWLINE, prefix)
    del prefix
    wdoc, length = words.doc, words.ends - words.starts
    total = np.maximum(words.counts, 1)
    share = lambda x: np.bincount(wdoc, x, n) / total
    small, marks = running(kind == 1), running((kind >= 4) & (kind <= 7))
    last, first = kind[words.ends - 1], kind[words.starts]
    mean = share(length.astype(float))
    again = np.zeros(len(wdoc), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (wdoc[1:] == wdoc[:-1])
    columns = [
        np.log1p(sizes), *by.T, mean, np.sqrt(np.maximum(share(length.astype(float) ** 2) - mean**2, 0)),
        share(small[words.ends] == small[words.starts]), share((last >= 5) & (last <= 7)), share(last == 4), share(first == 0),
        share(marks[words.ends] - marks[words.starts] >= 2), share(marks[words.ends] - marks[words.starts] == length), share(length == 1), share(length > 20), share(again),
        words.counts / np.maximum(lines.counts, 1),
    ]
    for items in ((words.hashes, wdoc), (lines.hashes, lines.doc), shingles(words, 3)):
        columns += repetition(*items, n)
    return np.stack(columns, 1)


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node i of a tree has 2i + 1 and 2i + 2 below it."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        out = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))

    def scores_of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.scores(statistics(data, offsets))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss; each split is the best of a feature's histogram cuts.

    With no rows or one class there is nothing to split: the score is the (smoothed) share of label 1.
    """
    inner = (1 << depth) - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # above cut b: bin > b
    real = np.stack([np.arange(bins) < len(c) for c in cuts])
    slot = binned + np.arange(f) * bins
    margin = np.full(n, base)
    features, tops, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, split = np.zeros(inner, int), np.full(inner, np.inf), np.full(inner, bins)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            start, width = (1 << level) - 1, 1 << level
            keys = ((node - start)[:, None] * (f * bins) + slot).ravel()
            hist = [np.bincount(keys, np.repeat(w, f), width * f * bins).reshape(width, f, bins) for w in (g, h)]
            gl, hl = (np.cumsum(a, 2) for a in hist)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[~(real[None] & (hl >= least) & (ht - hl >= least))] = 0
            for k, best in enumerate(gain.reshape(width, -1).argmax(1)):
                j, b = divmod(int(best), bins)
                if gain[k, j, b] > 1e-6:
                    feature[start + k], cut[start + k], split[start + k] = j, cuts[j][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > split[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        margin += leaf[at]
        features.append(feature), tops.append(cut), leaves.append(leaf)
    return Trees(base, np.array(features), np.array(tops), np.array(leaves))


@releasing
def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label and statistics of each row."""
    for batch in batches:
        for at, to, data, offsets in byte_chunks(batch["text"]):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch["label"].slice(at, to - at).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, n: int = 12_000) -> Trees:
    """Learns from up to n labelled documents outside the held-out fold; n is the bound of what reaches the driver."""
    rows = labelled_sample(docs, labels, "quality", n).mapInArrow(describe, "label int, x array<double>").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, 1))
    return boost(x, rows["label"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; other columns are not read.

    A null text scores as an empty one, a null doc_id is of the fold of the empty text, and repeated rows
    score alike and stay. Labels of unknown documents, null labels and null ids teach nothing; a document
    labelled twice counts twice. Without labels, or with one class only, all scores are the share of label 1.
    """
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels).scores_of)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents that score at least as much, with their own columns, whatever their names; nulls and repeats as in quality_scores."""
    name = free_name(docs, "score")
    return with_scores(docs, train(docs, labels).scores_of, name).filter(F.col(name) >= least).select(*quoted(docs.columns))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by trees learnt from the labelled ones; odd rows as in quality_scores."""
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
