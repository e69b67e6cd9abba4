"""Exact n-gram Jaccard self-join of documents by a grouped prefix join, and the components of its links.

Two sets whose similarity reaches t share a word shingle among the first n - ceil(t * n) + 1 of each
(its prefix), under any one order of all shingles. The order here puts those first that occur once in
all documents, then those that few have, last those that many have. A shingle that occurs once links
nothing, so a document without near copies mostly leaves no prefix row at all.

Shingles are counted exactly: texts become blocks of word numbers, blocks tell partitions of the
shingles' hashes which ones they have, and are told how often each occurs, in compressed arrays.

Documents with equal sets are one class; classes with the same prefix and size are one group. Within
the groups that share a shingle, every member is first held against one member of one leading group.
What this links need not be compared again: only groups that share a shingle but lie in different
components are then paired, filtered by their sizes and the number of prefix shingles that they share,
expanded into their members and verified. So no link between different components is lost, and a large
group of near copies costs about its own size.

Nothing of this passes through the driver but numbers of rows. Work grows with the documents' prefixes, which
are dealt by shingle and by group; keys that many rows have are aggregated before they are dealt, or meet a
settled table of one row a key, so that skewed joins can be split.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.blobs import pack, unpack
from tessera.llm.common import by_place, discard, documents, quoted, scratch, settle, sized
from tessera.llm.components import components
from tessera.llm.labelled import free_name
from tessera.llm.memory import given_back, releasing
from tessera.llm.wordhash import Runs, byte_chunks, distinct, mix, runs, shingles

#: Words of a block, and bytes of text for each partition of the counts.
BLOCK_WORDS = 400_000
BUCKET_BYTES = 10 << 20
#: Shingles that so many documents have come last in the order.
OFTEN = 32
#: Rows of two numbers that may be broadcast (a few MB); more of them are joined by a shuffle.
SEND_MOST = 200_000
#: Size bands grow by this factor.
BAND = 1.03
#: Blocks of more parts than this, on average, are first thinned by another star.
CROWD = 16
#: Pairs of one set that meet in a task.
HOT_PAIRS = 20_000
#: What is known of a part of a group.
PART = ("group_key", "root", "head", "n", "own")
HALF = np.uint64(32)


def bucket_key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and upper half of a hash: shingles that share it count as one, which may only move them within the order."""
    return (h % np.uint64(buckets)) << HALF | h >> HALF


@releasing
def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block; blob: doc_id (null: 0), known (whether there is an id), sizes (words of each text), ids (the words' places among words), words (sorted hashes)."""
    number, size, parts = TaskContext.get().partitionId() << 32, 0, []

    def flush() -> pa.RecordBatch:
        hashes, sizes, doc_id, known = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, ids = np.unique(hashes, return_inverse=True)
        blob = pack(doc_id=doc_id.view("u8"), known=known, sizes=sizes, ids=ids, words=words)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary())], ["block", "blob"])

    for batch in batches:
        for at, to, data, offsets in byte_chunks(batch["text"]):
            found, own = runs(data, offsets), batch["doc_id"].slice(at, to - at)
            parts.append((found.hashes, found.counts, own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False)))
            size += len(found.hashes) + to - at
            if size >= BLOCK_WORDS:
                yield flush()
                number, size, parts = number + 1, 0, []
    if parts:
        yield flush()


def block_sets(x: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle, text) pairs of a block, by text, then hash."""
    first = np.concatenate([[0], np.cumsum(x["sizes"])])
    h, d, _ = distinct(*shingles(Runs(first[:0], first[:0], x["words"][x["ids"]], first), k))
    return h, d


def block_keys(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct shingles by bucket and upper half of the hash: where each bucket's begin, upper halves, numbers of texts, and the place of each of h."""
    keys, place, n = np.unique(bucket_key(h, buckets), return_inverse=True, return_counts=True)
    return np.searchsorted(keys >> HALF, np.arange(buckets + 1, dtype=np.uint64)), keys & np.uint64(0xFFFFFFFF), n, place


PIECES = "bucket long, block long, blob binary"


def pieces(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, block, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "block", "blob"])


@releasing
def ask_counts(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each block's shingles, with how many of its texts have them, by partition: about two bytes for each."""
    for batch in batches:
        for block, blob in zip(batch["block"].to_pylist(), batch["blob"].to_pylist(), strict=True):
            cuts, halves, n, _ = block_keys(block_sets(unpack(blob), k)[0], buckets)
            yield pieces([(b, block, pack(halves=halves[i:j], n=n[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j])


def kinds(table: pa.Table) -> pa.Table:
    """A partition's answers to each block, in the order of its shingles: 0 (one document has it), 1 (more have) or 2 (OFTEN at least)."""
    asked = [unpack(blob) for blob in table["blob"].to_pylist()]
    halves, inverse = np.unique(np.concatenate([x["halves"] for x in asked]), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([x["n"] for x in asked]), len(halves))
    kind, at, rows = (n > 1).astype("i8") + (n >= OFTEN), 0, []
    for bucket, block, x in zip(table["bucket"].to_pylist(), table["block"].to_pylist(), asked, strict=True):
        rows.append((bucket, block, pack(kinds=kind[inverse[at : at + len(x["halves"])]])))
        at += len(x["halves"])
    return pa.Table.from_batches([pieces(rows)])


def set_key(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set of sorted hashes, cut at ends."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5BD1E995)))])
    return mix(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(np.uint64))


TEXTS = -1  # in place of a partition's number: the block itself


def describe_sets(table: pa.Table, k: int, share: tuple[int, int], buckets: int) -> pa.Table:
    """One block with all answers: doc_id, n, class_key (of the set), group_key (of prefix and size), prefix (without shingles of one document)."""
    num, den = share
    found = {bucket: unpack(blob) for bucket, blob in zip(table["bucket"].to_pylist(), table["blob"].to_pylist(), strict=True)}
    x = found.pop(TEXTS)
    docs = len(x["sizes"])
    h, d = block_sets(x, k)
    cuts, halves, _, place = block_keys(h, buckets)
    kind = np.zeros(len(halves), np.int8)
    for bucket, answer in found.items():
        kind[cuts[bucket] : cuts[bucket + 1]] = answer["kinds"]
    kind = kind[place]
    ends = np.searchsorted(d, np.arange(docs + 1))
    n = np.diff(ends)
    ranked = np.lexsort((h, kind, d))
    size = np.where(n > 0, n - -(-num * n // den) + 1, 0)
    inside = np.arange(len(h)) - ends[d] < size[d]
    first, kind, doc = h[ranked][inside], kind[ranked][inside], d[inside]
    groups = set_key(first, np.searchsorted(doc, np.arange(docs + 1))) + n.astype(np.uint64)
    shared = kind > 0
    ends_of = np.searchsorted(doc[shared], np.arange(docs + 1))
    prefix = pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), pa.array(first[shared].view("i8")))
    doc_id = pa.array(x["doc_id"].view("i8"), mask=~x["known"])
    return pa.table([doc_id, pa.array(n), pa.array(set_key(h, ends).view("i8")), pa.array(groups.view("i8")), prefix], ["doc_id", "n", "class_key", "group_key", "prefix"])


@releasing
def whole_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offsets in byte_chunks(batch["text"]):
            h, d, _ = distinct(*shingles(runs(data, offsets), k))
            ends = np.searchsorted(d, np.arange(to - at + 1))
            yield pa.RecordBatch.from_arrays([pa.array(set_key(h, ends).view("i8")), pa.array([h[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())], ["class_key", "members"])


@releasing
def similar(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    num, den = share
    for batch in batches:
        keep = []
        for x, y in zip(batch["sa"], batch["sb"], strict=True):
            a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(den * both >= num * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


@lru_cache(1)
def band_starts() -> list[int]:
    """Least sizes of bands: each band is one size, or reaches BAND times as far as it starts."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND)))
    return starts


def least_shared(small: int, large: int, share: tuple[int, int]) -> int:
    """Prefix shingles that similar sets of these sizes share at least: what the whole sets must share, less what can follow the larger one's prefix."""
    num, den = share
    return -(-num * (small + large) // (num + den)) - -(-num * large // den) + 1


@releasing
def banded(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """For each part (sorted tokens), rows of its role (0: the smaller set), the bands of the smaller and the larger set, and those tokens that a partner in the other band must meet.

    A part that shares s tokens at least with a partner meets it in the first of all but s - 1 of its tokens. Bands in
    which no set can be similar, given the shingles that the part alone has, get none.
    """
    num, den = share
    starts = band_starts()
    band = lambda n: bisect_right(starts, n) - 1
    names = ["token", "bx", "by", "role", "group_key", "root", "n", "own"]
    schema = pa.schema([(c, pa.int64()) for c in names])
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            n, own, tokens = r["n"], r["own"], r["tokens"]
            least, most, mine = -(-num * n // den), n * den // num, band(n)
            for other in range(band(least), band(most) + 1):
                low, high = max(least, starts[other]), min(most, starts[other + 1] - 1)
                for role in (0, 1):
                    a, b = (max(low, n), high) if role == 0 else (low, min(high, n))
                    if a > b or (num + den) * (n - own) < num * (n + a):
                        continue
                    need = max(1, least_shared(n, b, share) if role == 0 else least_shared(a, n, share))
                    pair = (mine, other) if role == 0 else (other, mine)
                    out += [(t, *pair, role, r["group_key"], r["root"], n, own) for t in tokens[: max(0, len(tokens) - need + 1)]]
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)


def semi(rows: DataFrame, keys: DataFrame, n: int, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """rows joined to keys (settled, distinct, n of them): broadcast while they are few, else by a shuffle."""
    return rows.join(F.broadcast(keys) if n <= SEND_MOST else keys, on, how)


class GroupedPrefixJoin:
    """The join of docs (doc_id, text). share: the least similarity as a fraction (numerator, denominator)."""

    def __init__(self, docs: DataFrame, k: int, share: tuple[int, int]):
        self.docs, self.k, self.share = docs.select("doc_id", "text"), k, share
        self.held: list[DataFrame] = []
        num, den = share
        self.sets = self.describe()
        full = self.sets.filter("n > 0")
        classes = full.groupBy("class_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "group_key")))
        self.classes, self.n_classes = self.keep(classes, "classes")
        own = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1 - size(prefix)")  # shingles that no other document has: all lie in the prefix
        groups = full.filter("size(prefix) > 0").groupBy("group_key").agg(F.min("class_key").alias("lead"), F.max("class_key").alias("last"), *(F.first(c).alias(c) for c in ("n", "prefix")))
        self.groups, _ = self.keep(groups.withColumn("own", own), "groups")
        tokens = self.groups.select("group_key", "lead", "last", F.explode("prefix").alias("token"))
        repeated = tokens.groupBy("token").agg(F.min("lead").alias("lo"), F.max("last").alias("hi")).filter("lo <> hi").select("token")
        repeated, n_repeated = self.keep(repeated, "repeated")
        shared = semi(tokens.select("group_key", "token"), repeated, n_repeated, "token").groupBy("group_key").agg(F.collect_list("token").alias("tokens"))
        live = self.groups.select("group_key", F.col("lead").alias("head"), "n", "own").join(shared, "group_key")
        #: Groups with the prefix shingles that several classes have.
        self.live, self.n_live = self.keep_with(live, "live", tokens=F.coalesce(F.sum(F.size("tokens")), F.lit(0)))
        #: class_key, group_key of their classes.
        self.members, self.n_members = self.keep(semi(self.classes.select("class_key", "group_key"), self.live.select("group_key"), self.n_live.rows, "group_key"), "members")
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def describe(self) -> DataFrame:
        """All documents' sets."""
        k, share = self.k, self.share
        size = self.docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = -(-max(1, size) // BUCKET_BYTES)
        blocks = scratch(self.docs.mapInArrow(cut_blocks, "block long, blob binary"), "blocks")
        asked = blocks.mapInArrow(lambda b: ask_counts(b, k, buckets), PIECES)
        answers = scratch(asked.groupBy("bucket").applyInArrow(lambda t: given_back(kinds(t)), PIECES), "kinds", free=True)
        rows = blocks.select(F.lit(TEXTS).cast("long").alias("bucket"), "block", "blob").union(answers)
        sets = scratch(rows.groupBy("block").applyInArrow(lambda t: given_back(describe_sets(t, k, share, buckets)), "doc_id long, n long, class_key long, group_key long, prefix array<long>"), "sets", free=True)
        discard(blocks, answers)
        return sets

    def keep(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """A settled table and its number of rows."""
        table, seen = self.keep_with(df, name)
        return table, seen.rows

    def keep_with(self, df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Row]:
        table, seen = settle(df, name, **metrics)
        self.held.append(table)
        return table, seen

    def possible(self, x: str, y: str) -> str:
        """Whether sets of columns n and own with these endings, which share none of their own shingles, can be similar enough."""
        num, den = self.share
        return f"{den} * least(n{x}, n{y}) >= {num} * greatest(n{x}, n{y}) and {num + den} * least(n{x} - own{x}, n{y} - own{y}) >= {num} * (n{x} + n{y})"

    def verify(self, pairs: DataFrame, n: int) -> tuple[DataFrame, int]:
        """Those of n pairs (a, b: class keys) at most whose whole sets are similar enough. A set that very many pairs have as b is copied for parts of them."""
        pairs, n = self.keep(sized(pairs.filter("a <> b").distinct(), n), "pairs")
        k, share = self.k, self.share
        asked = sized(pairs.select(F.col("a").alias("class_key")).union(pairs.select("b")).distinct(), 2 * n)
        asked, n_asked = self.keep(sized(self.classes.select("class_key", "doc_id").join(asked, "class_key", "left_semi"), 2 * n), "asked")
        hot, n_hot = self.keep(sized(pairs.groupBy("b").agg(F.ceil(F.count("*") / HOT_PAIRS).cast("int").alias("salts")).filter("salts > 1"), n), "hot")
        whole = lambda rows: rows.select("text").mapInArrow(lambda b: whole_sets(b, k), "class_key long, members binary")
        named = asked.filter("doc_id is not null").select("doc_id")
        sets = whole(semi(self.docs, named, n_asked, "doc_id"))
        nameless = asked.filter("doc_id is null").select("class_key")
        if nameless.head(1):  # no document of these has an id: all that have none are looked through
            sets = sets.union(semi(whole(self.docs.filter("doc_id is null")), nameless, n_asked, "class_key").dropDuplicates(["class_key"]))
        sets, _ = self.keep(sets, "whole")
        salted = semi(pairs, hot, n_hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"), F.lit(0)).alias("salt"))
        first = sized(salted.join(sets.select(F.col("class_key").alias("a"), F.col("members").alias("sa")), "a"), n, 5_000)
        copies = semi(sets.select(F.col("class_key").alias("b"), F.col("members").alias("sb")), hot, n_hot, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        both = sized(first.join(copies, ["b", "salt"]), n, 5_000)
        return self.keep(both.select("a", "b", "sa", "sb").mapInArrow(lambda b: similar(b, share), "a long, b long"), "linked")

    def link(self, pairs: DataFrame, n: int) -> int:
        found, n = self.verify(pairs, n)
        if n:
            self.links = found if self.links is None else self.links.union(found)
            self.roots = components(self.links)
            self.held.append(self.roots)
        return n

    def rooted(self) -> DataFrame:
        """members with the root of each."""
        if self.roots is None:
            return self.members.withColumn("root", F.col("class_key"))
        named = self.roots.withColumnRenamed("node", "class_key")
        return sized(self.members.join(named, "class_key", "left").withColumn("root", F.coalesce("root", "class_key")), self.n_members)

    def open_blocks(self) -> tuple[DataFrame, Row]:
        """token, group_key, root, head, n, own, parts: parts of groups by root, where a token's parts (so many) have several roots; and the numbers of rows and of pairs in blocks."""
        self.parts, _ = self.keep(self.rooted(), "parts")
        heads = sized(self.parts.groupBy("group_key", "root").agg(F.min("class_key").alias("head")), self.n_members)
        rows = self.live.drop("head").join(heads, "group_key").select("group_key", "root", "head", "n", "own", F.explode("tokens").alias("token"))
        several = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("parts")).filter("lo <> hi").select("token", "parts")
        several, seen = self.keep_with(several, "several", parts=F.coalesce(F.sum("parts"), F.lit(0)), pairs=F.coalesce(F.sum(F.col("parts") * F.col("parts")), F.lit(0)))
        if not seen.rows:
            return several, Row(rows=0, pairs=0)
        open_rows = rows.join(F.broadcast(several) if seen.rows <= SEND_MOST else several, "token")
        return self.keep(sized(open_rows, seen.parts), "rows")[0], Row(rows=seen.parts, pairs=seen.pairs)

    def star(self, rows: DataFrame, n: int, members: DataFrame, seed: int) -> DataFrame:
        """a, b: each part's members against one member of that leading part with which it shares most tokens. members: class_key, group_key, root.

        A block is led by the part with fewest shingles of its own (later, by one with few): in a family of copies, by one close to what all come from.
        """
        pick = F.struct((-F.col("own") if seed == 0 else -F.floor(F.col("own") / 4)).alias("shared"), F.xxhash64("group_key", F.lit(seed)).alias("h"), *PART)
        lead = sized(rows.groupBy("token").agg(F.max(pick).alias("l")).select("token", *(F.col(f"l.{c}").alias(f"{c}_l") for c in PART)), n)
        lead, n_lead = self.keep(lead, "lead")
        met = rows.join(F.broadcast(lead) if n_lead <= SEND_MOST // 4 else lead, "token").filter(f"(group_key <> group_key_l or root <> root_l) and {self.possible('', '_l')}")
        shared = sized(met.groupBy("group_key", "root", "head_l").count(), n)
        target = shared.groupBy("group_key", "root").agg(F.max(F.struct("count", "head_l")).alias("m")).select("group_key", "root", F.col("m.head_l").alias("b"))
        target, n_target = self.keep(sized(target, self.n_members), "target")
        return semi(members.withColumnRenamed("class_key", "a"), target, n_target, ["group_key", "root"], "inner").select("a", "b")

    def cross(self, rows: DataFrame, n: int) -> tuple[DataFrame, int]:
        """a, b: all members of parts that share enough tokens, have different roots and are near in size.

        Similar sets share some number of prefix shingles at least (least_shared), so parts meet in few of their
        tokens, from the rarest on in one order, for each pair of bands of sizes.
        """
        part, share = ["group_key", "root"], self.share
        listed_tokens = F.transform(F.sort_array(F.collect_list(F.struct("parts", "token"))), lambda x: x["token"])
        ranked, _ = self.keep(sized(rows.groupBy(*part, "n", "own").agg(listed_tokens.alias("tokens")), n), "ranked")
        role = lambda r, s: met.filter(f"role = {r}").select("token", "bx", "by", *(F.col(c).alias(f"{c}_{s}") for c in (*part, "n", "own")))
        met, n_met = self.keep(ranked.mapInArrow(lambda b: banded(b, share), "token long, bx long, by long, role long, group_key long, root long, n long, own long"), "banded")
        pairs = role(0, "x").join(role(1, "y"), ["token", "bx", "by"]).filter(f"root_x <> root_y and n_x <= n_y and (n_x < n_y or root_x < root_y) and {self.possible('_x', '_y')}")
        keys = ["group_key_x", "root_x", "group_key_y", "root_y"]
        pairs, n_pairs = self.keep(sized(pairs.select(*keys, "n_x", "n_y").distinct(), n_met), "met")
        x, y = (ranked.select(*(F.col(c).alias(f"{c}_{s}") for c in (*part, "tokens"))) for s in "xy")
        full = sized(sized(pairs.join(x, keys[:2]), n_pairs).join(y, keys[2:]), n_pairs)
        num, den = share
        need = f"(({num} * (n_x + n_y) + {num + den - 1}) div {num + den} - ({num} * n_y + {den - 1}) div {den} + 1)"
        close, n_close = self.keep(full.filter(f"size(array_intersect(tokens_x, tokens_y)) >= {need}").select(*keys), "close")
        members, n_members = self.keep(semi(self.parts, self.parts_of(close, n_close), 2 * n_close, part), "ends")
        a, b = (members.select(F.col("group_key").alias(f"group_key_{s}"), F.col("root").alias(f"root_{s}"), F.col("class_key").alias(c)) for s, c in (("x", "a"), ("y", "b")))
        most = n_close + n_members
        return sized(sized(close.join(a, keys[:2]), most).join(b, keys[2:]).select("a", "b"), most), most

    def parts_of(self, pairs: DataFrame, n: int) -> DataFrame:
        ends = (pairs.select(F.col(f"group_key_{s}").alias("group_key"), F.col(f"root_{s}").alias("root")) for s in "xy")
        return self.keep(sized(next(ends).union(next(ends)).distinct(), 2 * n), "ends")[0]

    def run(self, rounds: int = 1, keyed: bool = False) -> DataFrame:
        """doc_id, n_shingles, component_id; keyed: class_key and root too, which tell components of one name apart."""
        if self.n_members:
            several, n = self.keep(self.groups.filter("lead <> last").select("group_key", "lead"), "several")
            inside = semi(self.members, several, n, "group_key", "inner").select(F.col("class_key").alias("a"), F.col("lead").alias("b"))
            rows = self.live.withColumn("root", F.col("group_key")).select(*PART, F.explode("tokens").alias("token"))
            found = self.link(self.star(rows, self.n_live.tokens, self.members.withColumn("root", F.col("group_key")), 0).union(inside), 2 * self.n_members)
            rows, seen = self.open_blocks()
            seed = 0
            while found and seed < rounds and seen.pairs > CROWD * seen.rows:
                seed += 1
                found = self.link(self.star(rows, seen.rows, self.parts, seed), self.n_members)
                rows, seen = self.open_blocks()
            if seen.rows:
                self.link(*self.cross(rows, seen.rows))
        out = self.sets.select("doc_id", F.col("n").alias("n_shingles"), "class_key")
        moved, n = settle(self.moved(keyed), "moved")
        discard(*self.held)
        named = semi(out, moved, n.rows, "class_key", "left")
        name = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
        return named.select("doc_id", "n_shingles", name, *(["class_key", F.coalesce("root", "class_key").alias("root")] if keyed else []))

    def moved(self, keyed: bool) -> DataFrame:
        """class_key, component_id and, if keyed, root of classes with several documents, or whose component has another name."""
        named = self.classes.select("class_key", "doc_id", "copies")
        if self.roots is None:
            named = named.withColumns({"component_id": F.col("doc_id"), "root": F.col("class_key")})
        else:
            nodes = self.roots.union(self.roots.select("root", "root").distinct()).withColumnRenamed("node", "class_key")
            nodes, n = self.keep(sized(nodes.join(self.classes.select("class_key", "doc_id"), "class_key"), self.n_members), "nodes")
            least, n_least = self.keep(sized(nodes.groupBy("root").agg(F.min("doc_id").alias("component")), n), "least")
            nodes, n = self.keep(semi(nodes.select("class_key", "root"), least, n_least, "root", "left"), "named")
            named = semi(named, nodes, n, "class_key", "left").withColumns({"component_id": F.coalesce("component", "doc_id"), "root": F.coalesce("root", "class_key")})
        wanted = "copies > 1 or not component_id <=> doc_id" + " or root <> class_key" * keyed
        return named.filter(wanted).select("class_key", "component_id", *["root"] * keyed)


def linked_components(docs: DataFrame, k: int = 4, share: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) for each row of docs.

    A set is the distinct k-word shingles of the whole text; fewer words make one shingle, none (or a null
    text) an empty set that links with nothing. Equal sets link. A null id is never a component's name
    unless all of its documents have one.
    """
    return GroupedPrefixJoin(docs, k, share).run()


def count_of(settled: tuple[DataFrame, Row]) -> tuple[DataFrame, int]:
    return settled[0], settled[1].rows


def with_class(rows: DataFrame, k: int, name: str) -> DataFrame:
    """Rows with their class key behind their columns."""
    plain, text = by_place(rows), f"c{rows.columns.index('text')}"

    @releasing
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in byte_chunks(batch[text]):
                h, d, _ = distinct(*shingles(runs(data, offsets), k))
                keys = set_key(h, np.searchsorted(d, np.arange(to - at + 1)))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, pa.array(keys.view("i8"))], [*batch.schema.names, "key"])

    schema = StructType([*(StructField(f.name, f.dataType) for f in plain.schema), StructField("key", LongType())])
    return plain.mapInArrow(add, schema).toDF(*rows.columns, name)


def one_of_each(docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The document of the least id of each component, with its columns; of rows that repeat it, one stays. Rows without id stay.

    An id that several rows have is no document's own: such rows are told apart by the sets of their texts. Of linked
    texts of the least id that of the least class key stays.
    """
    found = scratch(GroupedPrefixJoin(docs, k, share).run(keyed=True), "components")
    others, n_others = count_of(settle(found.filter("doc_id <> component_id").select("doc_id").distinct(), "others"))
    again, n_again = count_of(settle(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again"))
    columns = quoted(docs.columns)
    kept = semi(docs, others, n_others, "doc_id", "left_anti").select(*columns)
    if not n_again:
        return kept
    key = free_name(docs, "_class_key")
    least = semi(found.filter("doc_id = component_id"), again, n_again, "doc_id").groupBy("doc_id", "root").agg(F.min("class_key").alias(key))
    stays, n_stays = count_of(settle(least.select("doc_id", key), "stays"))
    several = with_class(semi(docs, again, n_again, "doc_id").select(*columns), k, key)
    several = semi(several, stays, n_stays, ["doc_id", key]).dropDuplicates(["doc_id", key])
    return semi(kept, again, n_again, "doc_id", "left_anti").select(*columns).union(several.select(*columns))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of their near copies."""
    return linked_components(documents(spark, sf_dir))
