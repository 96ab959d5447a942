"""Repeated passages by a distributed difference-cover suffix sort.

Every window of `length` bytes is dealt by its minimiser, the smallest hash of
the short strings in it, so equal windows meet in one place and a run of
windows with one minimiser travels as one piece of text. A filter of minimisers
that occur twice keeps pieces at home that cannot repeat. Where
pieces meet, their suffixes are sorted by the difference-cover algorithm: the
suffixes at places 1 and 2 modulo 3 are sorted by triples and named, names are
sorted by recursion, the remaining suffixes are sorted by first symbol and the
rank behind it and merged in, to the depth of a window. Neighbours in that order
are then compared over the whole window, byte by byte.

A minimiser with very many different pieces (a common line in as many settings)
is treated window by window instead, by a hash of each whole window: in its task
up to `most_hot` pieces, where windows of one hash are compared byte by byte;
dealt over all tasks beyond, where windows of one minimiser are taken for equal
if 128 bits of hash agree. Pieces of one digest are compared byte by byte
wherever they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, packed_bits, parts, repeatable, table, unpacked, written

U = np.uint64
_MUL, _STEP = U(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
#: Bits of a place in a buffer, which bound the bytes that are looked at together; few enough bytes that they stay in cache.
_PLACE = 24
SEGMENT = 160 << 10


@dataclass(frozen=True)
class Params:
    """gram: bytes of a minimiser string.

    The filter has slot_bits bits for each run of windows (one in some 65 bytes), 2 ** most_bits (128 MB) at most: beyond, some 8 GB of
    text, it fills, and more pieces travel for the same result.
    """

    length: int = 200
    gram: int = 16
    slot_bits: int = 8
    least_bits: int = 20
    most_bits: int = 30
    chunk: int = 48 << 10
    sort_most: int = 512 << 10
    least_hot: int = 500
    most_hot: int = 50_000


def _rolling(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each `width` bytes, by joining hashes of half the width."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, U)
    h = (data.astype(U) + U(1 + 1000 * seed)) * _MUL
    h ^= h >> U(29)
    done, out, at, factor, w = 0, None, 0, _STEP + 2 * seed * 0x1D8E4E27C47D124F & 0xFFFFFFFFFFFFFFFF, 1
    while True:
        if width & w:
            part = h[at : at + n]
            out = part.copy() if out is None else out * U(factor) + part
            at += w
            done += w
        if done == width:
            break
        h = h[:-w] * U(factor) + h[w:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF | 1
        w *= 2
    out ^= out >> U(32)
    out *= U(0xD6E8FEB86659FD93)
    return out ^ out >> U(31)


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    n = len(x) - width + 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def runs(data: np.ndarray, bounds: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser hash) of each run of windows with one minimiser; bounds: where texts start and end."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    if len(data) < p.length:
        return none
    h = _rolling(data, p.gram)
    # the smallest hash, of equal ones the first: a rule on the window's own bytes alone
    key = h >> U(_PLACE) << U(_PLACE) | np.arange(len(h), dtype=U)
    low = _slide_min(key, p.length - p.gram + 1)
    place = (low & U((1 << _PLACE) - 1)).astype(np.int64)
    n = len(place)
    inside = np.zeros(n + 1, np.int8)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= p.length:
            inside[a : b - p.length + 1] = 1
    inside = inside[:n].astype(bool)
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    good = inside[first]
    first, count = first[good], count[good]
    return first, count, h[place[first]]


def _buffers(batches: Iterator[pa.RecordBatch], p: Params):
    """(data, bounds, text number of each bound, offset of each part in its text, texts' numbers) of about SEGMENT bytes each.

    A longer text comes in parts that overlap by a window less one byte, so each window is seen once.
    """
    for batch in batches:
        parts_: list[tuple[int, int, bytes]] = []
        held = 0

        def full():
            data = np.frombuffer(b"".join(x[2] for x in parts_), np.uint8)
            bounds = np.cumsum([0, *(len(x[2]) for x in parts_)])
            return data, bounds, [x[0] for x in parts_], np.array([x[1] for x in parts_], np.int64)

        rids = batch.column(0).to_pylist()
        for rid, x in zip(rids, batch.column(1)):
            raw = x.as_py() or b""
            for at in range(0, max(1, len(raw) - p.length + 1), SEGMENT - p.length + 1):
                part = raw[at : at + SEGMENT]
                if held + len(part) > SEGMENT and parts_:
                    yield full()
                    parts_, held = [], 0
                parts_.append((rid, at, part))
                held += len(part)
        if parts_:
            yield full()


def _slots(bits: int, p: Params):
    """How often each filter slot occurs, and with how many different pieces in this task."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("d", pa.int64())])
    mask = U((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds, _, _ in _buffers(batches, p):
            first, count, h = runs(data, bounds, p)
            if not len(h):
                continue
            raw = data.tobytes()
            digest = xxhash.xxh3_64_intdigest
            piece = np.fromiter((digest(raw[a : a + c + p.length - 1]) for a, c in zip(first.tolist(), count.tolist())), U, len(h))
            slot = (h & mask).astype(np.int64)
            order = np.lexsort((piece, slot))
            slot, piece = slot[order], piece[order]
            new = np.append(True, slot[1:] != slot[:-1])
            other = new | np.append(True, piece[1:] != piece[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(slot)))), pa.array(np.add.reduceat(other.astype(np.int64), at))], schema=schema
            )

    return run


class Filter:
    """Slots that occur twice or more, as bits, and the hot ones among them."""

    def __init__(self, bits: np.ndarray, hot: np.ndarray, mask: int):
        self.bits, self.hot, self.mask = bits, hot, mask

    def shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (h & U(self.mask)).astype(np.int64)
        yes = (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
        return yes, yes & np.isin(slot, self.hot)


def build_filter(texts: DataFrame, p: Params) -> Filter:
    """texts (rid, raw binary). The driver holds 2 ** most_bits bits at most, and a number for each most_hot or more different pieces of one slot (or 8 a shuffle partition)."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    bits = min(p.most_bits, max(p.least_bits, (p.slot_bits * size // 65).bit_length()))
    counted = texts.mapInArrow(_slots(bits, p), "slot int, n long, d long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).where("n > 1")
    counted = written(counted)
    total = counted.agg(F.sum("d")).first()[0] or 0
    least = min(p.most_hot, max(p.least_hot, total // (8 * parts(spark))))
    hot = [r[0] for r in counted.where(F.col("d") > least).select("slot").collect()]
    held = packed_bits(counted, bits)
    forget(counted)
    return Filter(held, np.array(hot, np.int64), (1 << bits) - 1)


def _same(a: bytes, b: bytes) -> None:
    if a != b:  # never a guess: one in 2 ** 64 for each two pieces of one minimiser
        raise ValueError("two different pieces of one minimiser have one digest")


#: What a dealt row is: a piece (once a task, with its number), a place of a piece, a window of a hot minimiser (n: its second hash).
PIECE, PLACE, WINDOW = 0, 1, 2
DEALT = "kind int, anchor long, what long, rid long, start long, n long, raw binary"


def _deal(model, p: Params, hold: int = 16 << 20, rows: int = 100_000):
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("anchor", "what", "rid", "start", "n")), ("raw", pa.binary())])
    digest = xxhash.xxh3_64_intdigest

    def batch(kind: int, anchor=None, what=None, rid=None, start=None, n=None, raw=None) -> pa.RecordBatch:
        size = len(what)
        number = lambda c: pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64())
        text = pa.nulls(size, pa.binary()) if raw is None else pa.array(raw, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *map(number, (anchor, what, rid, start, n)), text], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        held = placed = 0
        places: list[tuple] = []

        def pieces() -> Iterator[pa.RecordBatch]:
            all_ = list(kept.items())
            for at in range(0, len(all_), 4096):
                some = all_[at : at + 4096]
                keys = np.array([x[0] for x in some], U).view(np.int64)
                anchors = np.array([x[1][0] for x in some], U).view(np.int64)
                yield batch(PIECE, anchors, keys, n=[x[1][1] for x in some], raw=[x[1][2] for x in some])

        for data, bounds, rids, offsets in _buffers(batches, p):
            first, count, h = runs(data, bounds, p)
            if not len(h):
                continue
            shared, hot = model.value.shared(h)
            own = np.searchsorted(bounds, first, "right") - 1
            rid, at = np.array(rids, np.int64)[own], first - bounds[own] + offsets[own]
            plain = np.flatnonzero(shared & ~hot)
            if len(plain):
                raw, keys = data.tobytes(), np.empty(len(plain), U)
                for k, (a, c, x) in enumerate(zip(first[plain].tolist(), count[plain].tolist(), h[plain].tolist())):
                    text = raw[a : a + c + p.length - 1]
                    keys[k] = key = digest(text)
                    seen = kept.get(key)
                    if seen:
                        _same(seen[2], text)
                        seen[1] += 1
                    else:
                        kept[key] = [x, 1, text]
                        held += c + p.length + 250
                places.append((h[plain].view(np.int64), keys.view(np.int64), rid[plain], at[plain]))
                placed += len(plain)
            if hot.any():
                whole, other = _rolling(data, p.length), _rolling(data, p.length, 1)
                f, c = first[hot], count[hot]
                for k in range(0, len(f), 1000):
                    cs = c[k : k + 1000]
                    step = np.arange(cs.sum()) - np.repeat(np.append(0, np.cumsum(cs)[:-1]), cs)
                    spread = lambda v: np.repeat(v[hot][k : k + 1000], cs)  # noqa: B023, E731
                    window = spread(first) + step
                    yield batch(WINDOW, spread(h).view(np.int64), whole[window].view(np.int64), spread(rid), spread(at) + step, other[window].view(np.int64))
            if placed > rows:
                yield batch(PLACE, *(np.concatenate(c) for c in zip(*places)))
                places, placed = [], 0
            if held > hold:
                yield from pieces()
                kept, held = {}, 0
        if places:
            yield batch(PLACE, *(np.concatenate(c) for c in zip(*places)))
        yield from pieces()

    return run


def _sorted(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of whole numbers below size; sorts key and place as one number where both fit 64 bits."""
    bits = max(1, len(key) - 1).bit_length()
    if size.bit_length() + bits <= 64:
        both = np.sort(key.astype(U) << U(bits) | np.arange(len(key), dtype=U))
        return (both & U((1 << bits) - 1)).astype(np.int64), (both >> U(bits)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of tuples of whole numbers in lexicographic order."""
    key, size = None, 1
    for c in columns:
        top = int(c.max()) + 1 if len(c) else 1
        if key is None:
            key, size = c, top
        else:
            if size * top >= 1 << 62:
                key = _names(key)
                size = int(key.max()) + 1
            key, size = key * top + c, size * top
    order, ranked = _sorted(key, size)
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1])[: len(key)])
    return out


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """A number for each suffix of s (symbols from 1, 0: a border): sorts suffixes by their first `depth` symbols at least.

    Suffixes that agree so far get numbers next to each other, in any order.
    """
    n = len(s)
    if n < 3 or depth <= 1:
        order, _ = _sorted(s, int(s.max()) + 1 if n else 1)
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    t = np.concatenate([s, np.zeros(4, np.int64)])
    ones, twos, zeros = np.arange(1, n + 1, 3), np.arange(2, n + 2, 3), np.arange(0, n + 1, 3)
    sample = np.concatenate([ones, twos])
    named = _names(t[sample], t[sample + 1], t[sample + 2])  # the sorted triples' names
    if int(named.max()) < len(named):
        ranks = suffix_ranks(np.concatenate([named[: len(ones)], [0], named[len(ones) :]]), -(-depth // 3))
        ranks = np.concatenate([ranks[: len(ones)], ranks[len(ones) + 1 :]])
    else:
        ranks = named
    rank = np.zeros(n + 6, np.int64)
    rank[sample] = _names(ranks)
    size = int(rank.max()) + 1
    top = int(t.max()) + 1
    two = lambda i: t[i] * size + rank[i + 1]
    pair = _names(np.concatenate([t[zeros], t[twos]]), np.concatenate([t[zeros + 1], t[twos + 1]])) if top * top * size >= 1 << 62 else None
    if pair is None:
        three = lambda i: (t[i] * top + t[i + 1]) * size + rank[i + 2]
        zeros3, twos3 = three(zeros), three(twos)
    else:
        zeros3, twos3 = pair[: len(zeros)] * size + rank[zeros + 2], pair[len(zeros) :] * size + rank[twos + 2]
    zero_order, zero_keys = _sorted(two(zeros), top * size)  # the remaining suffixes
    # each sampled suffix goes behind the remaining ones that are smaller; searching in key order walks memory once
    sample_order, _ = _sorted(rank[sample], size)
    before = np.empty(len(sample), np.int64)
    first = sample_order[sample_order < len(ones)]
    second = sample_order[sample_order >= len(ones)]
    before[first] = np.searchsorted(zero_keys, two(sample[first]))
    before[second] = np.searchsorted(zeros3[zero_order], twos3[second - len(ones)])
    merged = np.zeros(n + 6, np.int64)
    behind = np.maximum.accumulate(before[sample_order])
    merged[sample[sample_order]] = np.arange(len(sample)) + behind
    merged[zeros[zero_order]] = np.arange(len(zeros)) + np.searchsorted(behind, np.arange(len(zeros)), "right")
    return merged[:n]


def repeated_starts(raws: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows that occur again, in the joined text; starts of the texts there; the joined text's flags)."""
    sizes = np.array([len(r) for r in raws], np.int64)
    begin = np.append(0, np.cumsum(sizes + 1))[:-1]
    data = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
    symbols = data.astype(np.int64) + 1
    symbols[begin + sizes] = 0
    ranks = suffix_ranks(symbols, length)
    valid = np.zeros(len(data), bool)
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + np.maximum(sizes - length + 1, 0), -1)
    valid = np.cumsum(step)[:-1] > 0
    at = np.flatnonzero(valid)
    at = at[_sorted(ranks[at], len(data) + 8)[0]]
    # neighbours in suffix order, compared eight bytes at a time and then by the last bytes
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), U)
    for k in range(8):
        word |= padded[k : k + len(data)].astype(U) << U(8 * k)
    same = np.arange(max(0, len(at) - 1))
    for k in [*range(0, length - 7, 8), length - 8]:
        same = same[word[at[same] + k] == word[at[same + 1] + k]]
    flag = np.zeros(len(data), bool)
    flag[at[same]] = True
    flag[at[same + 1]] = True
    return np.flatnonzero(flag), begin, sizes


def repeated_by_hash(raws: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As repeated_starts, by a 64-bit hash of each window (eight bytes, where the sort takes some 160 a byte); windows of one hash are compared byte by byte."""
    sizes = np.array([len(r) for r in raws], np.int64)
    begin = np.append(0, np.cumsum(sizes + 1))[:-1]
    hashes, starts = [], []
    for a in range(0, len(raws), 256):
        part = raws[a : a + 256]
        data = np.frombuffer(b"\0".join(part), np.uint8)
        at = np.concatenate([np.arange(b, b + max(0, n - length + 1)) for b, n in zip(begin[a : a + 256] - begin[a], sizes[a : a + 256])])
        hashes.append(_rolling(data, length)[at] if len(at) else np.empty(0, U))
        starts.append(at + begin[a])
    h, at = np.concatenate(hashes), np.concatenate(starts)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    data = np.frombuffer(b"\0".join(raws), np.uint8)
    span = np.arange(length)
    apart = [same[k : k + 8192][(data[at[order[same[k : k + 8192]], None] + span] != data[at[order[same[k : k + 8192] + 1], None] + span]).any(1)] for k in range(0, len(same), 8192)]
    flag = np.zeros(len(h), bool)
    flag[order[same]] = True
    flag[order[same + 1]] = True
    for clash in np.unique(h[order[np.concatenate(apart)]]).tolist() if apart else ():  # one hash, different bytes
        members = np.flatnonzero(h == U(clash))
        text = [data[a : a + length].tobytes() for a in at[members].tolist()]
        flag[members] = [text.count(x) > 1 for x in text]
    return at[flag], begin, sizes


def _sorter(p: Params):
    """Pieces by minimiser -> the ranges of windows in each piece that occur again (here or anywhere)."""
    schema = pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def judge(group: dict[tuple[int, int], list]) -> pa.RecordBatch:
        keys, lo, hi = [], [], []
        apart: dict[int, int] = {}
        for anchor, _ in group:
            apart[anchor] = apart.get(anchor, 0) + 1
        alone = []
        for key, (n, raw) in group.items():
            if n > 1:  # the piece itself occurs again
                keys.append(key)
                lo.append(0)
                hi.append(len(raw) - p.length + 1)
            if apart[key[0]] > 1:
                alone.append((key, n, raw))
        if alone:
            # one minimiser's pieces stay together, however many: beyond sort_most bytes their windows are hashed
            find = repeated_starts if sum(len(x[2]) for x in alone) <= p.sort_most else repeated_by_hash
            starts, begin, _ = find([x[2] for x in alone], p.length)
            own = np.searchsorted(begin, starts, "right") - 1
            new = np.append(True, (np.diff(starts) != 1) | (np.diff(own) != 0)) if len(starts) else np.empty(0, bool)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(starts)) - 1
            for i, j in zip(a.tolist(), b.tolist()):
                key, n, _ = alone[own[i]]
                if n == 1:
                    keys.append(key)
                    lo.append(int(starts[i] - begin[own[i]]))
                    hi.append(int(starts[j] - begin[own[j]]) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([k[0] for k in keys], [k[1] for k in keys], lo, hi)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple[int, int], list] = {}
        held, last = 0, None
        for batch in batches:
            for anchor, key, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != last and held > p.chunk:
                    yield judge(group)
                    group, held = {}, 0
                last = anchor
                seen = group.get((anchor, key))
                if seen:
                    _same(seen[1], raw)
                    seen[0] += n
                else:
                    group[anchor, key] = [n, raw]
                    held += len(raw)
        if group:
            yield judge(group)

    return run


def repeats(texts: DataFrame, p: Params = Params()) -> DataFrame:
    """texts (rid, raw binary) -> (rid, spans): arrays of [start, end) byte ranges that repeated windows cover, merged, in order."""
    spark = texts.sparkSession
    model = spark.sparkContext.broadcast(build_filter(texts, p))  # 2 ** most_bits bits at most
    dealt = written(texts.mapInArrow(_deal(model, p), DEALT))  # one file a task: a read of one kind leaves the other kinds' columns alone
    pieces = dealt.where(F.col("kind") == PIECE).select("anchor", F.col("what").alias("piece"), "n", "raw")
    together = pieces.repartition(parts(spark), "anchor").sortWithinPartitions("anchor")
    ranges = written(together.mapInArrow(_sorter(p), "anchor long, piece long, lo long, hi long"))
    places = dealt.where(F.col("kind") == PLACE).select("anchor", F.col("what").alias("piece"), "rid", "start")
    found = places.join(ranges, ["anchor", "piece"]).select("rid", (F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") + (p.length - 1)).alias("b"))
    if len(model.value.hot):
        windows = dealt.where(F.col("kind") == WINDOW).select("anchor", F.col("what").alias("window"), F.col("n").alias("other"), "rid", "start")
        # written, so that the join has a shuffle of its own on either side and Spark can split a window that is everywhere
        key = ["anchor", "window", "other"]
        again = written(windows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
        hot = windows.join(again, key).select("rid", F.col("start").alias("a"), (F.col("start") + p.length).alias("b"))
        found = found.unionByName(hot)
    return found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def _cut(pairs) -> list[tuple[int, int]]:
    """Sorted [start, end) ranges merged where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: What remove_repeats() makes, each under this name after "s_".
MADE = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}


def _removed(docs: DataFrame, p: Params, as_text: bool) -> DataFrame:
    """(row, out): all columns of docs and what is made of the text; kept as text where asked for, in the same pass."""
    docs = repeatable(docs)
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"), F.col("text").cast("string").cast("binary").alias("raw"))
    ranges = repeats(numbered.select("rid", "raw"), p)
    # the ranges grow with the texts: a merge join at any size, never a broadcast
    joined = numbered.drop("raw").join(ranges.hint("merge"), "rid", "left")
    made = MADE | ({"kept": "string"} if as_text else {})

    @F.pandas_udf(", ".join(f"{c} {t}" for c, t in made.items()))
    def cut(raws, found):
        import pandas as pd

        rows = []
        for raw, ranges_ in zip(raws, found):
            raw = raw or b""
            spans = _cut((r["a"], r["b"]) for r in ranges_) if ranges_ is not None else []
            done, kept = 0, []
            for a, b in spans:
                kept.append(raw[done:a])
                done = b
            rest = b"".join([*kept, raw[done:]])
            rows.append((len(raw), len(raw) - len(rest), len(spans), rest.decode("utf-8", "ignore") if as_text else rest))
        return pd.DataFrame(rows, columns=list(made))

    return joined.select("row", cut(F.col("row.text").cast("string").cast("binary"), F.col("ranges")).alias("out"))


def remove_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """All columns of docs with n_bytes, n_removed, n_spans and kept (binary), each prefixed "s_".

    Bytes of the UTF-8 text that lie in a string of p.length bytes which also
    starts elsewhere (in any row, overlaps included) are removed. A null text
    counts as empty; texts shorter than a window stay whole; copies and repeated
    rows lose all their windows, every one of them; an empty table gives no
    rows. Columns of docs of the four names s_n_bytes and so on are replaced,
    any other name is free.
    """
    names = [c for c in docs.columns if c.lower() not in {f"s_{m}" for m in MADE}]
    out = _removed(docs, p, False)
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], *[F.col(f"out.{c}").alias(f"s_{c}") for c in MADE])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans, and the digest of what is left, of every document; edge rows as in remove_repeats()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id",
        *[F.col(f"s_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans")],
        F.sha2("s_kept", 256).alias("kept_sha256"),
    )


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts (bytes of a character that was cut go with it); documents and columns stay.

    A null text stays null; of copies and repeated rows every one loses its text;
    n_chars, where there is such a column, is counted anew for cut texts; an empty
    table gives no rows; columns may have any names.
    """
    out = _removed(docs, Params(), True)
    whole = F.col("out.n_removed") == 0
    new = {"text": F.when(F.col("row.text").isNull() | whole, F.col("row.text")).otherwise(F.col("out.kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("row")["n_chars"]).otherwise(F.length("out.kept")).cast(docs.schema["n_chars"].dataType)
    return unpacked(out, "row", docs.columns, new)
