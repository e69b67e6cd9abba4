"""Scoring by a Katz backoff language model of runs of up to `order` words, learnt from part of the scored corpus.

A known word's probability is its Good-Turing discounted share of the tokens; what discounting takes
off goes to the one outcome "unknown". After a context, a word seen there has its discounted share of
the context's count (and one, set aside so that the rest is never empty), and any other word has the
context's backoff weight times its probability after the context without its first word. The weight is
the rest, divided by the probability of all words not seen there, so the outcomes of every context add
up to 1. Contexts are the words before, order - 1 of them at most, back to the end that stands before a
text's first word; a context that was never seen has the weight 1.

How it runs, over T tokens: texts become blocks of word numbers with their own vocabularies. Counts
of words and of grams (runs of words) are kept in partitioned tables by hash, one table for each length.
Blocks tell the partitions their distinct grams and are told the counts, in compressed arrays, so what is
moved is a few bytes for each distinct gram of a block. A gram's number in its table stands for it as the
context of longer ones. A context so frequent that its grams would outgrow a partition has them dealt by
the context and the word. Answers stay packed until their turn comes, one partition's at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blobs import pack, unpack
from tessera.llm.common import discard, documents, scratch
from tessera.llm.wordhash import byte_chunks, mix, runs

#: The end of a text, which also stands before its first word.
END = np.uint64(0x9E3779B97F4A7C15)
#: Good-Turing discounts apply to counts up to this.
SMALL = 5
BLOCK_TOKENS = 1_000_000
#: Bytes of text for each partition of a table, for each step of the order.
BUCKET_BYTES = 7 << 20
#: So many of a partition's grams are looked at for frequent ones.
LARGEST = 32


def discounts(of: np.ndarray) -> np.ndarray:
    """d[r] for r from 0 to SMALL (d[0] unused): Katz's discount from the numbers of types seen r times, of[1] to of[SMALL + 1].

    Where these do not give a discount between 0 and 1, as with many copies in a corpus, it is that of
    taking the same part n1 / (n1 + 2 n2) off each count.
    """
    d = np.ones(SMALL + 1)
    n = of.astype(float)
    part = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    part = min(max(part, 0.01), 0.99)
    shift = (SMALL + 1) * n[SMALL + 1] / n[1] if n[1] else 1.0
    for r in range(1, SMALL + 1):
        better = ((r + 1) * n[r + 1] / (n[r] * r) - shift) / (1 - shift) if n[r] and shift < 1 else 0.0
        d[r] = better if 0 < better < 1 else (r - part) / r
    return d


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(count <= SMALL, d[np.minimum(count, SMALL)], 1.0) * count


@dataclass
class Unigrams:
    """Tokens and types of the training texts, discounts, and the probability of the outcome "unknown"."""

    tokens: int
    types: int
    discount: np.ndarray
    unknown: float

    @staticmethod
    def of(tokens: int, types: int, times: np.ndarray) -> Unigrams:
        d = discounts(times)
        freed = sum((1 - d[r]) * r * int(times[r]) for r in range(1, SMALL + 1))
        # One token more, which is unknown, leaves it a share even where nothing is seen once.
        return Unigrams(tokens, types, d, (freed + 1) / (tokens + 1))

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.discount) / (self.tokens + 1), self.unknown)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id (as text; null: empty) leaves 2 when divided by 7."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """block; texts: doc_id (null: 0), known (whether there is an id), held, sizes, ids (the tokens' places among the words), by (the words' partitions), end (the end's place); words: sorted hashes."""
    seq, size, parts = TaskContext.get().partitionId() << 32, 0, []

    def flush() -> pa.RecordBatch:
        hashes, counts, doc_id, known, held = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, ids = np.unique(hashes, return_inverse=True)
        texts = pack(doc_id=doc_id.view("u8"), known=known, held=held, sizes=counts, ids=ids, by=dealt(words, buckets), end=np.searchsorted(words, [END]))
        return pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([texts], pa.binary()), pa.array([pack(words=words)], pa.binary())], ["block", "texts", "words"])

    for batch in batches:
        doc_id, held = batch["doc_id"], batch["held"].to_numpy(zero_copy_only=False)
        for at, to, data, offsets in byte_chunks(batch["text"]):
            found = runs(data, offsets)
            hashes = np.insert(found.hashes, found.first[1:], END)
            own = doc_id.slice(at, to - at)
            parts.append((hashes, found.counts + 1, own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), held[at:to]))
            size += len(hashes)
            if size >= BLOCK_TOKENS:
                yield flush()
                seq, size, parts = seq + 1, 0, []
    if parts:
        yield flush()


def pieces(rows: list[tuple[int, int, bytes]], names: tuple[str, str] = ("bucket", "block")) -> pa.RecordBatch:
    a, b, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(blob, pa.binary())], [*names, "blob"])


PIECES = "bucket long, block long, blob binary"
OWN = -1  # in place of a block's number: the partition's own rows
TEXTS = 0  # in place of a gram's length: the block's texts


@dataclass
class Length:
    """What the driver knows of the grams of one length: their discounts, the frequent ones' numbers (sorted), and weights of frequent contexts (by number, sorted)."""

    d: np.ndarray
    often: np.ndarray
    heavy: np.ndarray
    weight: np.ndarray


def dealt(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) % np.uint64(buckets)).astype("i8")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and which of them each key is: np.unique with less memory, for fewer than 2**31 keys."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    inverse = np.empty(len(keys), "i4")
    inverse[order] = np.cumsum(new, dtype="i4") - 1
    return keys[new], inverse


def ask_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each block's words with their counts in its training texts, by partition."""
    for batch in batches:
        for row in batch.to_pylist():
            x, words = unpack(row["texts"]), unpack(row["words"])["words"]
            train = np.repeat(~x["held"], x["sizes"])
            counts = np.bincount(x["ids"][train], minlength=len(words))
            yield pieces([(b, row["block"], pack(words=words[x["by"] == b], counts=counts[x["by"] == b])) for b in range(buckets)])


def count_words(table: pa.Table) -> pa.Table:
    """A partition of the word table: its own rows, and to each block, in the order of its words, their places and counts here."""
    asked = [(r["block"], unpack(r["blob"])) for r in table.to_pylist()]
    words, inverse = np.unique(np.concatenate([x["words"] for _, x in asked]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([x["counts"] for _, x in asked])).astype("i8")
    bucket, at, rows = table["bucket"][0].as_py(), 0, []
    for block, x in asked:
        own = inverse[at : at + len(x["words"])]
        rows.append((bucket, block, pack(places=own.astype("u8"), counts=counts[own])))
        at += len(x["words"])
    known = np.flatnonzero(counts)
    return pa.Table.from_batches([pieces([*rows, (bucket, OWN, pack(words=words[known], places=known.astype("u8"), counts=counts[known]))])])


def totals(batches: Iterator[pa.RecordBatch], largest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each partition of a table: tokens, types, numbers of types by small counts, and its most frequent grams by number."""
    for batch in batches:
        for row in batch.to_pylist():
            x = unpack(row["blob"])
            top = np.argsort(-x["counts"], kind="stable")[:largest]
            times = np.bincount(np.minimum(x["counts"], SMALL + 2), minlength=SMALL + 3)
            numbers = place_numbers(x["places"][top], row["bucket"], buckets)
            many, one = pa.list_(pa.int64()), pa.int64()
            columns = [([int(x["counts"].sum())], one), ([len(x["counts"])], one), ([times.tolist()], many), ([numbers.view("i8").tolist()], many), ([x["counts"][top].tolist()], many)]
            yield pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], ["tokens", "types", "times", "words", "counts"])


def place_numbers(places: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """One number for each word or gram, from its place in its partition: small ones, which travel in few bytes."""
    return places * np.uint64(buckets) + np.uint64(bucket)


@dataclass
class Grams:
    """A block's distinct grams of one length: their numbers (sorted) and counts, the counts of their contexts, and each token's own gram (-1: the text starts too late for one)."""

    numbers: np.ndarray
    counts: np.ndarray
    context_counts: np.ndarray
    at: np.ndarray


@dataclass
class Met:
    """A block's distinct grams by context and word, as places among its shorter grams and words; where: the tokens that end one, inverse: which."""

    where: np.ndarray
    inverse: np.ndarray
    first: np.ndarray
    second: np.ndarray
    own: list[tuple[int, np.ndarray]]


class Block:
    """A block's texts with what the tables have answered so far, by length; answers are packed, and go when they are read."""

    def __init__(self, rows: list[dict], buckets: int, model: Unigrams):
        self.answers: dict[int, dict[int, bytes]] = {}
        for r in rows:
            self.answers.setdefault(r["level"], {})[r["bucket"]] = r["blob"]
        self.x = x = unpack(self.answers.pop(TEXTS)[0])
        self.buckets = buckets
        numbers, counts = np.zeros(len(x["by"]), "u8"), np.zeros(len(x["by"]), "i8")
        for b, blob in self.answers.pop(1, {}).items():
            answer, own = unpack(blob), x["by"] == b
            numbers[own] = place_numbers(answer["places"], b, buckets)
            counts[own] = answer["counts"]
        order, rank = ranks(numbers)
        self.ids, self.end = rank[x.pop("ids")], rank[x["end"][0]]
        self.words = Grams(numbers[order], counts[order], np.full(len(order), model.tokens), self.ids)
        self.sizes = x["sizes"]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def met(self, n: int, below: Grams, often: np.ndarray) -> Met:
        """The grams of n words, and which of them each partition holds."""
        late = np.ones(len(self.ids), bool)
        for k in range(n - 2):
            late[self.starts[self.sizes > k] + k] = False
        where = np.flatnonzero(late).astype("i4")
        before = below.at[where - 1].astype("i8")
        if n == 2:
            before[self.starts] = self.end
        size = len(self.words.numbers)
        before *= size
        before += self.ids[where]
        pair, inverse = distinct(before)
        del before, late
        first, second = (pair // size).astype("i4"), (pair % size).astype("i4")
        context = below.numbers[first]
        hot = np.flatnonzero(np.isin(context, often))
        context[hot] += mix(self.words.numbers[second[hot]])
        bucket = dealt(context, self.buckets)
        order = np.argsort(bucket, kind="stable").astype("i4")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        return Met(where, inverse, first, second, [(b, order[cuts[b] : cuts[b + 1]]) for b in range(self.buckets) if cuts[b] < cuts[b + 1]])

    def told(self, n: int, met: Met, numbers: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, dict]]:
        """Fills in what the tables gave the grams of n words, numbers (not for the last length) and counts; the answers by partition."""
        for b, own in met.own:
            answer = unpack(self.answers[n].pop(b))
            if "places" in answer:
                numbers[own] = place_numbers(answer["places"], b, self.buckets)
            counts[own] = answer["counts"]
            yield own, answer

    def grams(self, below: Grams, met: Met, numbers: np.ndarray, counts: np.ndarray) -> Grams:
        """The grams of n words by the numbers and counts that the tables gave them."""
        order, rank = ranks(numbers)
        at = np.full(len(self.ids), -1, "i4")
        at[met.where] = rank[met.inverse]
        return Grams(numbers[order], counts[order], below.counts[met.first[order]], at)


def ranks(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(numbers)
    rank = np.empty(len(order), "i4")
    rank[order] = np.arange(len(order), dtype="i4")
    return order, rank


def blank(met: Met) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(len(met.first), "u8"), np.zeros(len(met.first), "i8")


def ask_grams(number: int, found: list[dict], n: int, buckets: int, known: list[Length], model: Unigrams) -> pa.RecordBatch:
    """One block with the answers on all shorter grams: its grams of n words for each partition.

    Rows have the contexts' numbers, their counts (na) and those of their own ends' contexts (sa), the words' numbers,
    the distinct grams with their training counts, and for those that are not 0 the counts of the grams without their first words (ns).
    """
    block = Block(found, buckets, model)
    below = block.words
    for m in range(2, n):
        met = block.met(m, below, known[m - 2].often)
        numbers, counts = blank(met)
        for _ in block.told(m, met, numbers, counts):
            pass
        below = block.grams(below, met, numbers, counts)
        del met, numbers, counts
    met = block.met(n, below, known[n - 2].often)
    train = np.bincount(met.inverse[np.repeat(~block.x["held"], block.sizes)[met.where]], minlength=len(met.first))
    end = np.empty(len(met.first), "i4")
    end[met.inverse] = below.at[met.where]
    ns, shorter = below.counts[end], below.context_counts[end]
    rows = []
    for b, own in met.own:
        a, start, ai = np.unique(met.first[own], return_index=True, return_inverse=True)
        z, zi = np.unique(met.second[own], return_inverse=True)  # places in 64 bits, as their products need
        taught = train[own] > 0
        rows.append((b, number, pack(a=below.numbers[a], na=below.counts[a], sa=shorter[own][start], z=block.words.numbers[z], pairs=(ai * len(z) + zi).astype("u8"), train=train[own], ns=ns[own][taught])))
    return pieces(rows)


def count_grams(table: pa.Table, d: np.ndarray, often: np.ndarray, last: bool) -> pa.Table:
    """A partition of the table of one length, and its answers to each block.

    An answer has the counts of the grams as they were asked, their places in the partition (not for the last length),
    and what the weights follow from of those contexts that back off in the block. d: discounts of the grams one
    word shorter; those of this length are not known yet. The partition's own rows: numbers of grams by small
    counts, the most frequent grams, and its part of the frequent contexts.
    """
    bucket = table["bucket"][0].as_py()
    asked = [(r["block"], unpack(r["blob"])) for r in table.to_pylist()]
    column = lambda name: np.concatenate([x[name] for _, x in asked])
    first, ai = np.unique(column("a"), return_inverse=True)
    second, zi = np.unique(column("z"), return_inverse=True)
    na, sa = np.zeros(len(first), "i8"), np.zeros(len(first), "i8")
    na[ai], sa[ai] = column("na"), column("sa")
    a0 = z0 = 0
    codes = []
    for _, x in asked:
        own_a, own_z = np.divmod(x["pairs"].astype("i8"), len(x["z"]))
        codes.append(ai[a0 : a0 + len(x["a"])][own_a] * len(second) + zi[z0 : z0 + len(x["z"])][own_z])
        a0, z0 = a0 + len(x["a"]), z0 + len(x["z"])
    pair, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    train = column("train")
    r = np.bincount(inverse, train, len(pair)).astype("i8")
    ns = np.zeros(len(pair), "i8")
    ns[inverse[train > 0]] = column("ns")
    context = pair // len(second)
    seen = r > 0
    by_count = np.bincount(context[seen] * (SMALL + 2) + np.minimum(r[seen], SMALL + 1), minlength=len(first) * (SMALL + 2)).reshape(len(first), SMALL + 2)
    taken = np.bincount(context[seen], discounted(ns[seen], d) / (sa[context[seen]] + 1), len(first))
    part = lambda used: {"taken": taken[used], "by_count": by_count[used].ravel()}
    rows, at = [], 0
    for (block, x), code in zip(asked, codes, strict=True):
        own = inverse[at : at + len(code)]
        at += len(code)
        used = backing(r[own], na[context[own]], context[own])
        rows.append((bucket, block, pack(counts=r[own], **part(used), **({} if last else {"places": own.astype("u8")}))))
    hot = np.flatnonzero(np.isin(first, often))
    top = np.sort(np.argsort(-r, kind="stable")[:LARGEST])
    times = np.bincount(np.minimum(r, SMALL + 2), minlength=SMALL + 3)
    rows.append((bucket, OWN, pack(times=times, places=top.astype("u8"), counts=r[top], a=first[hot], na=na[hot], **part(hot))))
    return pa.Table.from_batches([pieces(rows)])


def backing(r: np.ndarray, na: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The contexts, in order, of grams that are not seen after a context that is."""
    return np.unique(context[(r == 0) & (na > 0)])


def weights(na: np.ndarray, by_count: np.ndarray, taken: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Backoff weights of contexts: counts, numbers of grams seen r times (rows of SMALL + 2), and the probability, without the context's first word, of all words seen."""
    small = np.arange(1, SMALL + 1)
    n = by_count.reshape(-1, SMALL + 2)[:, 1 : SMALL + 1]
    kept = (na - n @ small + n @ (d[1:] * small)) / (na + 1)
    return (1 - kept) / np.maximum(1 - taken, 1e-12)


def gram_totals(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            x = unpack(row["blob"])
            lists = [x["times"].tolist(), place_numbers(x["places"], row["bucket"], buckets).view("i8").tolist(), x["counts"].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int64())) for v in lists], ["times", "words", "counts"])


def frequent_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch["blob"].to_pylist():
            x = unpack(blob)
            n = x["by_count"].reshape(-1, SMALL + 2)
            yield pa.RecordBatch.from_pydict({"word": x["a"].view("i8"), "na": x["na"], "taken": x["taken"], **{f"n{r}": n[:, r] for r in range(SMALL + 2)}})


def score(table: pa.Table, buckets: int, known: list[Length], model: Unigrams) -> pa.Table:
    """One block with all answers: its texts' rows. known[n - 2] has the frequent contexts of the grams of n words, known[n - 1] their discounts."""
    block = Block(table.to_pylist(), buckets, model)
    x, below, docs = block.x, block.words, len(block.sizes)
    value = np.log10(model.probability(below.counts))[block.ids]
    base = np.log10((below.counts + 1) / (model.tokens + model.types + 1))
    for n in range(2, len(known) + 1):
        met, length, d = block.met(n, below, known[n - 2].often), known[n - 2], known[n - 1].d
        numbers, r = blank(met)
        na, weight = below.counts[met.first], np.ones(len(below.counts))
        for own, answer in block.told(n, met, numbers, r):
            used = backing(r[own], na[own], met.first[own])
            weight[used] = weights(below.counts[used], answer["by_count"], answer["taken"], d)
        if len(length.heavy):
            at = np.minimum(np.searchsorted(length.heavy, below.numbers), len(length.heavy) - 1)
            weight = np.where(length.heavy[at] == below.numbers, length.weight[at], weight)
        seen = (r > 0)[met.inverse]
        value[met.where[seen]] = 0
        value[met.where] += np.log10(np.where(r > 0, discounted(r, d) / (na + 1), weight[met.first]))[met.inverse]
        if n < len(known):
            below = block.grams(below, met, numbers, r)
        del met, numbers, r, na, weight, seen
    doc = np.repeat(np.arange(docs, dtype="i4"), block.sizes)
    return pa.table({
        "doc_id": pa.array(x["doc_id"].view("i8"), mask=~x["known"]),
        "held_out": pa.array(x["held"]), "n_tokens": block.sizes, "n_known": np.bincount(doc, (block.words.counts > 0)[block.ids], docs).astype("i8"),
        "train_tokens": np.full(docs, model.tokens), "base_score": np.bincount(doc, base[block.ids], docs), "score": np.bincount(doc, value, docs),
    })


def katz_scores(docs: DataFrame, held: Column, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; texts that are not held teach.

    order: words of the longest grams, from 1. A null text is an empty one: its only token is its end. Repeated rows stay
    and count each time. Without a text to learn from, every token is "unknown", with probability 1. Tables have as many
    partitions as the texts' bytes ask for, so what one holds does not grow with the corpus.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = -(-max(1, size) // BUCKET_BYTES) * max(1, order - 1)  # blocks have more distinct grams the longer these are
    cut = scratch(docs.select("doc_id", "text", held.alias("held")).mapInArrow(lambda b: blocks(b, buckets), "block long, texts binary, words binary"), "blocks")
    words = scratch(cut.mapInArrow(lambda b: ask_words(b, buckets), PIECES).groupBy("bucket").applyInArrow(count_words, PIECES), "words", free=True)
    found = words.filter(F.col("block") == OWN).mapInArrow(lambda b: totals(b, LARGEST, buckets), "tokens long, types long, times array<long>, words array<long>, counts array<long>").collect()
    tokens = sum(r["tokens"] for r in found)
    model = Unigrams.of(tokens, sum(r["types"] for r in found), added(found))
    none = np.zeros(0)
    known = [Length(model.discount, frequent(found, buckets, tokens), none, none)]
    rows = cut.select(F.lit(TEXTS).alias("level"), F.lit(0).cast("long").alias("bucket"), "block", F.col("texts").alias("blob")).union(answers(words, 1))
    read = [cut, words]
    for n in range(2, order + 1):
        whole = scratch(rows.groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "blob")).alias("rows")), f"blocks-{n}", free=True)
        discard(*read)
        table = scratch(counted(whole, n, buckets, list(known), model, n == order), f"grams-{n}", free=True)
        own = table.filter(F.col("block") == OWN).select("bucket", "blob")
        found = own.mapInArrow(lambda b: gram_totals(b, buckets), "times array<long>, words array<long>, counts array<long>").collect()  # one row for each partition
        d = discounts(added(found))
        known[-1].heavy, known[-1].weight = frequent_weights(own, d)
        known.append(Length(d, frequent(found, buckets, tokens), none, none))
        rows = whole.select("block", F.inline("rows")).select("level", "bucket", "block", "blob").union(answers(table, n))
        read = [whole, table]
    return rows.groupBy("block").applyInArrow(lambda t: score(t, buckets, known, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def counted(whole: DataFrame, n: int, buckets: int, known: list[Length], model: Unigrams, last: bool) -> DataFrame:
    """The table of the grams of n words, and its answers."""
    d, often = known[-1].d, known[-1].often

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch["block"].to_pylist(), batch["rows"], strict=True):
                yield ask_grams(block, rows.as_py(), n, buckets, known, model)

    asked = whole.mapInArrow(ask, PIECES)
    return asked.groupBy("bucket").applyInArrow(lambda t: count_grams(t, d, often, last), PIECES)


def answers(table: DataFrame, n: int) -> DataFrame:
    return table.filter(F.col("block") != OWN).select(F.lit(n).alias("level"), "bucket", "block", "blob")


def added(found: list[Row]) -> np.ndarray:
    return np.sum([r["times"] for r in found], axis=0, dtype="i8") if found else np.zeros(SMALL + 3, "i8")


def frequent(found: list[Row], buckets: int, tokens: int) -> np.ndarray:
    """Numbers of the grams that are more than a partition's share of the tokens."""
    return np.sort(np.array([w for r in found for w, c in zip(r["words"], r["counts"], strict=True) if c * buckets > tokens], "i8").view("u8"))


def frequent_weights(own: DataFrame, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = [f"n{r}" for r in range(SMALL + 2)]
    parts = own.select("blob").mapInArrow(frequent_contexts, f"word long, na long, taken double, {', '.join(f'{c} long' for c in counts)}")
    whole = parts.groupBy("word").agg(F.max("na").alias("na"), F.sum("taken").alias("taken"), *(F.sum(c).alias(c) for c in counts)).toPandas()
    names = whole["word"].to_numpy("i8").view("u8")
    weight = weights(whole["na"].to_numpy(), whole[counts].to_numpy(), whole["taken"].to_numpy(), d)
    return np.sort(names), weight[np.argsort(names)]


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under a model of order three, learnt from those that are not held out."""
    return katz_scores(documents(spark, sf_dir), held_out(), 3)
