"""Language-model scores from a log-frequency Bloom filter of word pairs.

Exact word counts come from a shuffle: every block of documents asks the owner
of each of its words, in packed rows, and gets the count back, so no table of
all words is ever broadcast. Pairs are asked in the same way, by slices of a
hash: a slice sums its pairs, and one seen 2**(q-1) times or more sets bits for
each level 1..q in the slice's part of the filter. The part's size follows its
stored levels at any size of the input; it is probed where it lies, level after
level, and only the levels go back to the blocks. A level stands for the mean
count of its pairs, so that quantising takes no mass from the pairs as a whole,
and a pair's count is interpolated with the smoothed word probability.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from loomgraph.llm.common import parts, repeatable, table, written

U = np.uint64


@dataclass(frozen=True)
class Params:
    """Each slice of the filter has bits_per_entry bits at least for a stored level; a pair seen once is level 1, one never seen level 0.

    slices is the least number of slices of the pair hash. Owners of words and slices grow with the bytes of text (part_bytes each) and with
    the shuffle partitions, so that one stays as small at any size. A block of documents ends before block_bytes of text.
    """

    folds: int = 7
    held_fold: int = 2
    weight: float = 0.25
    hashes: int = 3
    bits_per_entry: int = 8
    least_bits: int = 1 << 20
    slices: int = 16
    block_bytes: int = 4 << 20
    part_bytes: int = 64 << 20


def held_out(doc_id: int | None, p: Params = Params()) -> bool:
    """Whether crc32 of doc_id as text falls into the held-out fold; a null doc_id is a training row."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % p.folds == p.held_fold


def tokens(raw: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end (an empty token, which no word equals)."""
    words = (raw or b"").lower().split()
    words.append(b"")
    return words


class Words:
    """Numbers for the words of a block, in order of first use, and their hashes."""

    def __init__(self):
        self.of: dict[bytes, int] = defaultdict()
        self.of.default_factory = self.of.__len__

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, self.of), U, len(self.of))


def pair_keys(hashes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    key = hashes[first] * U(0x9E3779B97F4A7C15) + (hashes[second] ^ U(0xD6E8FEB86659FD93))
    key ^= key >> U(31)
    key *= U(0xBF58476D1CE4E5B9)
    return key ^ key >> U(29)


def _blocks(every_block, p: Params):
    """Calls every_block(block, doc ids, raws) for each stretch of a partition's rows of block_bytes; the same rows make the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ids, raws = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = x.as_py()
                size = len(raw or b"") + 64
                if ids and held + size > p.block_bytes:
                    yield from every_block(block, ids, raws)
                    block, held, ids, raws = block + 1, 0, [], []
                held += size
                ids.append(doc)
                raws.append(raw)
        if ids:
            yield from every_block(block, ids, raws)

    return run


def _texts(p: Params):
    def each(block, docs, raws):
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(raws, pa.binary())], names=["block", "doc_id", "raw"])

    return _blocks(each, p)


def _asks(owners: int, p: Params):
    """Rows (owner, block, words, counts): a block's words with their counts in its training documents, by the words' owner."""
    schema = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])

    def each(block, docs, raws):
        vocab = Words()
        train, other = [], []
        for doc, raw in zip(docs, raws):
            (other if held_out(doc, p) else train).append(vocab.ids(tokens(raw)))
        counts = np.bincount(np.concatenate(train), minlength=len(vocab.of)) if train else np.zeros(len(vocab.of), np.int64)
        owner = (vocab.hashes() % U(owners)).astype(np.int64)
        words = list(vocab.of)
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(owners + 1))
        rows = []
        for k in range(owners):
            mine = order[edges[k] : edges[k + 1]]
            if len(mine):
                rows.append((k, block, b" ".join([words[i] for i in mine.tolist()]), counts[mine].astype("<i8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return _blocks(each, p)


def _answer(asked: pa.Table) -> pa.Table:
    """Of one owner: each block's words with their counts over all blocks."""
    total: dict[bytes, int] = defaultdict(int)
    for words, counts in zip(asked.column("words"), asked.column("counts")):
        for w, c in zip(words.as_py().split(b" "), np.frombuffer(counts.as_py(), "<i8").tolist()):
            total[w] += c
    get, out = total.__getitem__, []
    for x in asked.column("words"):
        words = x.as_py().split(b" ")
        out.append(np.fromiter(map(get, words), np.int64, len(words)).astype("<i8").tobytes())
    n, v = sum(total.values()), sum(c > 0 for c in total.values())
    size = asked.num_rows
    return pa.table(
        {
            "block": asked.column("block"),
            "words": asked.column("words"),
            "counts": pa.array(out, pa.binary()),
            # of the owner's words, written on its first row only
            "tokens": pa.array([n] + [0] * (size - 1), pa.int64()),
            "types": pa.array([v] + [0] * (size - 1), pa.int64()),
        }
    )


def _edges(key: np.ndarray, slices: int) -> np.ndarray:
    """Where each slice of sorted keys begins, and their number."""
    return np.searchsorted(key >> U(32), np.arange(slices + 1).astype(U) * U((1 << 32) // slices))


def _pairs(p: Params):
    """Rows (slice, block, keys, counts): a block's pairs in the order of their keys, with their counts in its training documents; 40 bits of a key beside its slice."""
    schema = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def each(block, docs, raws):
        vocab = Words()
        end = vocab.of[b""]
        ids = [vocab.ids(tokens(raw)) for raw in raws]
        train = np.repeat([not held_out(doc, p) for doc in docs], [len(x) for x in ids])
        second = np.concatenate(ids)
        first = np.empty_like(second)
        first[1:] = second[:-1]
        first[0] = end  # a document's first word follows the end of the one before it
        every = pair_keys(vocab.hashes(), first, second)
        key = np.unique(every)
        seen, n = np.unique(every[train], return_counts=True)
        counts = np.zeros(len(key), "<u4")
        counts[np.searchsorted(key, seen)] = n
        edges = _edges(key, p.slices)
        rows = []
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if a < b:
                low = (key[a:b] >> U(64 - 40 - p.slices.bit_length() + 1) & U((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append((k, block, low.tobytes(), counts[a:b].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return _blocks(each, p)


def _wide(keys: bytes) -> np.ndarray:
    raw = np.frombuffer(keys, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    return wide.view("<u8").ravel()


def _summed(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    key = _wide(b"".join(keys))
    n = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _places(key: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """Bit places within a slice of `bits` bits for a level of each key."""
    x = key * U(0x9E3779B97F4A7C15) + U(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    for _ in range(hashes):
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        yield (x & U(bits - 1)).astype(np.int64)


def _set_bits(key: np.ndarray, level: np.ndarray, bits: int, hashes: int) -> bytes:
    on = np.zeros(bits, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        for place in _places(key[level >= q], q, bits, hashes):
            on[place] = 1
    return np.packbits(on, bitorder="little").tobytes()


class LogBloom:
    """Quantised pair counts behind membership probes; no level above `most` is asked for."""

    def __init__(self, rows: dict[int, bytes], bits: int, p: Params, most: int = 64):
        self.bits, self.p, self.most = bits, p, most
        self.data = np.zeros(p.slices * bits // 8, np.uint8)
        for k, raw in rows.items():
            self.data[k * bits // 8 : (k + 1) * bits // 8] = np.frombuffer(raw, np.uint8)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The highest level q so that levels 1..q all answer yes."""
        s = self.p.slices.bit_length() - 1
        base = (keys >> U(64 - s)).astype(np.int64) * self.bits if s else np.zeros(len(keys), np.int64)
        return self.probe(keys >> U(64 - 40 - s) & U((1 << 40) - 1), base)

    def probe(self, low: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Levels of keys within their slices, whose bits begin at base."""
        out = np.zeros(len(low), np.int64)
        left = np.arange(len(low))
        q = 0
        while len(left) and q < self.most:
            q += 1
            yes = np.ones(len(left), bool)
            for place in _places(low[left], q, self.bits, self.p.hashes):
                at = base[left] + place
                yes &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            left = left[yes]
            out[left] = q
        return out


def _levels(p: Params):
    """Of one slice: each block's pairs with their levels, from the slice's own part of the filter."""

    def answer(group: pa.Table) -> pa.Table:
        keys = group.column("keys").to_pylist()
        key, n = _summed(keys, group.column("counts").to_pylist())
        key, n = key[n > 0], n[n > 0]
        level = np.frexp(n.astype(float))[1]  # 1 + floor(log2 n)
        bits = 1 << max(3, max(int(level.sum()) * p.bits_per_entry, p.least_bits // p.slices).bit_length())
        part = LogBloom({0: _set_bits(key, level, bits, p.hashes)}, bits, replace(p, slices=1), int(level.max(initial=0)))
        out = []
        for raw in keys:
            low = _wide(raw)
            out.append(part.probe(low, np.zeros(len(low), np.int64)).astype(np.uint8).tobytes())
        # of the slice's levels, written on its first row only: how many pairs each has, and how often they occur
        sums = np.stack([np.bincount(level, minlength=65), np.bincount(level, n, 65).astype(np.int64)]).astype("<i8").tobytes()
        first = [sums] + [None] * (len(out) - 1)
        return pa.table({"block": group.column("block"), "slice": group.column("slice"), "words": pa.array(first, pa.binary()), "counts": pa.array(out, pa.binary())})

    return answer


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, pairs, occurrences) of the slices' sums."""
    for batch in batches:
        total = sum((np.frombuffer(x.as_py(), "<i8").reshape(2, 65) for x in batch.column(0)), np.zeros((2, 65), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65)), pa.array(total[0]), pa.array(total[1])], names=["level", "pairs", "occurrences"])


def _scorer(n: int, v: int, mean: list[float], p: Params):
    """mean: the mean count of the pairs of each level, level 0 (never seen) first."""

    def score(docs: pa.Table, counts: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        by_slice: dict[int, bytes] = {}
        for k, words, got in zip(*(counts.column(c).to_pylist() for c in ("slice", "words", "counts"))):
            if k is None:
                known.update(zip(words.split(b" "), np.frombuffer(got, "<i8").tolist()))
            else:
                by_slice[k] = got
        vocab = Words()
        end = vocab.of[b""]
        ids = [vocab.ids(tokens(raw)) for raw in docs.column("raw").to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.append(0, np.cumsum(sizes))[:-1]
        second = np.concatenate(ids)
        first = np.empty_like(second)
        first[1:] = second[:-1]
        first[starts] = end
        c = np.fromiter((known.get(w, 0) for w in vocab.of), np.int64, len(vocab.of))
        word = (c + 1) / (n + v + 1)
        keys, back = np.unique(pair_keys(vocab.hashes(), first, second), return_inverse=True)
        level = np.frombuffer(b"".join(by_slice[k] for k in sorted(by_slice)), np.uint8).astype(np.int64)  # slices are ranges of the keys
        if len(level) != len(keys):
            raise ValueError("docs does not list its rows alike each time")
        pair = np.array(mean)[level[back]]
        pair = np.minimum(pair / np.maximum(c[first], 1), 1.0)
        seen = c[first] > 0
        p2 = np.where(seen, p.weight * pair + (1 - p.weight) * word[second], word[second])
        doc_ids = docs.column("doc_id")
        return pa.table(
            {
                "doc_id": doc_ids,
                "held_out": pa.array([held_out(x, p) for x in doc_ids.to_pylist()], pa.bool_()),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.add.reduceat((c > 0)[second].astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(ids), n, np.int64)),
                "base_score": pa.array(np.add.reduceat(np.log10(word)[second], starts)),
                "score": pa.array(np.add.reduceat(np.log10(p2), starts)),
            }
        )

    return score


def score(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    score is the log10 of the product of weight * count(pair) / count(first word)
    + (1 - weight) * the word's smoothed probability. Its pair part sums to 1
    over the pairs as a whole, not for each first word, and what the filter
    answers wrongly (some 3 of 100 unseen pairs, as level 1) adds to it.

    A null or empty text is one end token. A null doc_id is a training row.
    Repeated rows are counted and scored row by row; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = repeatable(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    owners = max(parts(spark), -(-size // p.part_bytes))
    p = replace(p, slices=max(p.slices, 1 << (owners - 1).bit_length()))
    # numbers of partitions of our own where the groups are many: Spark's follow a setting, not the input
    asked = rows.mapInArrow(_asks(owners, p), "owner int, block long, words binary, counts binary").repartition(owners, "owner")
    answered = written(asked.groupBy("owner").applyInArrow(_answer, "block long, words binary, counts binary, tokens long, types long"))
    n, v = answered.agg(F.sum("tokens"), F.sum("types")).first()
    n, v = n or 0, v or 0
    pairs = rows.mapInArrow(_pairs(p), "slice int, block long, keys binary, counts binary").repartition(owners, "slice")
    levels = written(pairs.groupBy("slice").applyInArrow(_levels(p), "block long, slice int, words binary, counts binary"))
    sums = levels.where("words is not null").select("words").mapInArrow(_sums, "level long, pairs long, occurrences long")
    mean = [0.0] * 65
    for r in sums.groupBy("level").agg(F.sum("pairs"), F.sum("occurrences")).collect():  # 65 rows at most
        mean[r[0]] = r[2] / r[1] if r[1] and r[0] else 0.0
    known = answered.select("block", F.lit(None).cast("int").alias("slice"), "words", "counts").unionByName(levels)
    blocks = rows.mapInArrow(_texts(p), "block long, doc_id long, raw binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    one, other = blocks.repartition(owners, "block"), known.repartition(owners, "block")
    return one.groupBy("block").cogroup(other.groupBy("block")).applyInArrow(_scorer(n, v, mean, p), schema)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those that are not held out; edge rows as in score()."""
    return score(table(spark, sf_dir, "documents"))
