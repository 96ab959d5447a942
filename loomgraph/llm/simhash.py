"""Near copies by SimHash: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits differ in at most two
of their eight bytes, so they share six positional bytes at least: that is the
guaranteed minimum of matches. The index holds each distinct fingerprint under
every choice of six positions with the bytes found there; a pair comes together
in a posting list exactly if its tally of shared positional bytes reaches six.
Inside a list only two byte positions are open, so it has 65,536 members at
most. Up to 256 members the shared bytes of every pair are tallied and the pairs
that reach the minimum verified bit by bit; in longer lists each member looks
up the numbers within two bits of it, which are those same pairs. A list gives
a spanning star of what it linked.

Near copies by shingle similarity (near_groups) differ in many more bits, so
they have a wider fingerprint of 32 positional bytes: texts whose sets of
5-word shingles have a similarity of 0.8 share 8.7 of them in the mean. The
index posts every text under 64 choices of two positions, so a list holds one
text in 65,536 by chance. A pair that meets has reached the minimum of two
shared bytes, is kept if the whole fingerprints are near enough, and is linked
only if the two shingle sets themselves, compared exactly, have the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bit_filter, in_filter, packed_bits, parts, table, written
from loomgraph.llm.components import components

SEED, WORDS, BITS = 42, 3, 2
POSITIONS = 8


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 of every word shingle, repeats included; fewer words: of the whole sequence; none: empty."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if n < words:
        return np.array([digest(b" ".join(found), SEED)], np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - words + 1]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, n - words + 1)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the word shingles, repeats included, as an unsigned number; no words: zero."""
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # a bounded stretch at a time, however long the text
        count += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number) of each row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def link_list(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning stars (member, smallest member) of what is within `bits` bits in one posting list."""
    x = np.unique(fps)
    if len(x) <= 256:
        apart = x[:, None] ^ x[None, :]
        tally = (apart.view(np.uint8).reshape(len(x), len(x), POSITIONS) == 0).sum(2)  # positional bytes that a pair shares
        near = (tally >= POSITIONS - bits) & (np.bitwise_count(apart.view(np.uint64)) <= bits)
        i, j = np.nonzero(np.triu(near, 1))
    else:  # look up every number that lies within `bits` bits on the open positions
        open_bits = int(np.bitwise_or.reduce(x ^ x[0]))
        single = [1 << k for k in range(64) if open_bits & 0xFFFFFFFFFFFFFFFF & (1 << k)]
        masks = [sum(c) for r in range(1, bits + 1) for c in combinations(single, r)]
        i, j = [], []
        for m in masks:
            other = x ^ np.array(m, np.uint64).astype(np.int64)
            at = np.minimum(np.searchsorted(x, other), len(x) - 1)
            hit = np.flatnonzero(x[at] == other)
            i.append(hit)
            j.append(at[hit])
        i, j = np.concatenate(i), np.concatenate(j)
    label = np.arange(len(x))
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(x)))
    return list(zip(x[moved].tolist(), x[label[moved]].tolist()))


def _linker(bits: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for x in batch.column(0) for e in link_list(np.array(x.values, np.int64), bits)]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints `fp` within `bits` bits, without all pairs of a group."""
    choices = []
    for k, away in enumerate(combinations(range(POSITIONS), bits)):
        mask = sum(0xFF << 8 * p for p in range(POSITIONS) if p not in away)
        signed = mask - (1 << 64) if mask >> 63 else mask
        choices.append(F.struct(F.lit(k).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(signed)).alias("held")))
    posted = distinct.select("fp", F.explode(F.array(*choices)).alias("p")).select("fp", "p.*")
    lists = posted.groupBy("choice", "held").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return lists.select("fps").mapInArrow(_linker(bits), "a long, b long")


def groups(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most `bits` bits reach, for each row of docs.

    A null or empty text has fingerprint zero and links like any other. Rows
    with a null doc_id get the component of their text but never name one (a
    component of such rows alone is null). Repeated rows come out repeated; an
    empty table gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(docs, words))
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    spread = classes.select("fp").repartition(parts(classes.sparkSession), "fp")  # the classes lie in a few files; each row becomes many
    linked = components(links(spread, bits))
    member = written(classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    roots = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(member.join(roots, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; edge rows as in groups()."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of the wide fingerprint: 64-bit streams of a shingle's hash, and so its positional bytes.
STREAMS, WIDE = 4, 32
#: The index posts the bytes at s and s + step (modulo WIDE) for every start s; lists beyond SHORT are compared by a third byte, at s + offset.
STEPS, OFFSETS, SHORT, AHEAD = (1, 5), (2, 3, 7, 9, 11, 13, 17, 19, 20, 23, 26, 29), 16, 8
#: Bits of the whole fingerprint that a pair may differ in: 39 in the mean at a similarity of 0.8, with a deviation of 6, and 128 for unlike texts.
FAR = 52
_CHOICES = np.array([(s, (s + step) % WIDE) for step in STEPS for s in range(WIDE)])
#: log2 of the lists there may be.
LIST_BITS = ((len(_CHOICES) << 16) - 1).bit_length()
_STREAM = (np.arange(1, STREAMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The hashes of the different word shingles of a text, ascending."""
    return np.unique(shingle_hashes(text, words))


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles in WIDE bytes."""
    count = np.zeros(64 * STREAMS, np.int64)
    for k in range(0, len(shingles), 8192):
        x = shingles[k : k + 8192, None] + _STREAM
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        count += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(count * 2 > len(shingles), bitorder="little")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays of different numbers."""
    if not len(a) and not len(b):
        return 1.0
    at = np.minimum(np.searchsorted(a, b), max(0, len(a) - 1))
    both = int((a[at] == b).sum()) if len(a) else 0
    return both / (len(a) + len(b) - both)


def _wide(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fps = [], []
            for t in batch.column(1):
                found = shingle_set(t.as_py(), words)
                same.append(xxhash.xxh3_128_digest(found.tobytes()))
                fps.append(wide_print(found).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(fps, pa.binary())], schema=schema)

    return run


ENTRY = np.dtype([("list", "<u4"), ("node", "<i8"), ("fp", "<u8", (STREAMS,))])
#: Pairs of fingerprints compared at once.
BLOCK = 1 << 19
#: An entry that also names the group that its node is in already.
GROUPED = np.dtype([*ENTRY.descr, ("root", "<i8")])


def _lists_of(wide: np.ndarray) -> np.ndarray:
    """The lists of each fingerprint (a row of WIDE bytes), a column a choice."""
    value = wide.astype(np.uint32)
    return np.arange(len(_CHOICES), dtype=np.uint32) << 16 | value[:, _CHOICES[:, 0]] << 8 | value[:, _CHOICES[:, 1]]


def _in_lists(bits: np.ndarray, lists: np.ndarray) -> np.ndarray:
    return (bits[lists >> 3] >> (lists & 7).astype(np.uint8) & 1).astype(bool)


def _first_list(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the list of the entries a and b, pair by pair, is the first of those that their fingerprints share."""
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        same = np.ascontiguousarray(x["fp"] ^ y["fp"]).view(np.uint8).reshape(len(x), WIDE) == 0
        out[k : k + len(x)] = (same[:, _CHOICES[:, 0]] & same[:, _CHOICES[:, 1]]).argmax(1) == x["list"] >> 16
    return out


def _open_nodes(model):
    """(node, fp) of those in any list of the bits."""
    schema = pa.schema([("node", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, WIDE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(_in_lists(model.value, _lists_of(wide)).any(1)))

    return run


def _post(buckets: int, rows: int = 1024, kind: np.dtype = ENTRY, model=None):
    """Rows (bucket, entries): the index entries of a stretch of texts, packed by the bucket of their list; of node, fp and, if GROUPED, root. With a model (bits of lists) those of its lists only."""
    schema = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])

    def posted(nodes: list[int], fps: list[bytes], roots: list[int]) -> pa.RecordBatch:
        wide = np.frombuffer(b"".join(fps), np.uint8).reshape(len(nodes), WIDE)
        entries = np.empty((len(nodes), len(_CHOICES)), kind)
        if kind is GROUPED:
            entries["root"] = np.array(roots, np.int64)[:, None]
        entries["list"] = _lists_of(wide)
        entries["node"] = np.array(nodes, np.int64)[:, None]
        entries["fp"] = wide.copy().view("<u8")[:, None, :]
        entries = entries.ravel()
        if model is not None:
            entries = entries[_in_lists(model.value, entries["list"])]
        bucket = ((entries["list"] * np.uint32(0x9E3779B1)).astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        ends = np.append(start[1:], len(bucket))
        return pa.RecordBatch.from_arrays([pa.array(bucket[start], pa.int32()), pa.array([entries[i:j].tobytes() for i, j in zip(start.tolist(), ends.tolist())], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, fps, roots = [], [], []
        for batch in batches:
            for node, fp, root in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(batch.num_columns - 1)):
                nodes.append(node)
                fps.append(fp.as_py())
                if kind is GROUPED:
                    roots.append(root.as_py())
                if len(nodes) >= rows:
                    yield posted(nodes, fps, roots)
                    nodes, fps, roots = [], [], []
        if nodes:
            yield posted(nodes, fps, roots)

    return run


def _pairs_ahead(key: np.ndarray, fp: np.ndarray, ahead: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits apart) of entries of one key, at most `ahead` places apart, whose fingerprints are near; key is sorted."""
    at, lag = np.arange(len(key)), 1
    while lag <= ahead:
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            return
        apart = np.bitwise_count(fp[at] ^ fp[at + lag]).sum(1, dtype=np.int64)
        near = apart <= FAR
        yield at[near], at[near] + lag, apart[near]
        lag += 1


def _meet(bucket: pa.Table) -> pa.Table:
    """Candidate links (a < b) of the lists of a bucket, a pair in the first of its lists only: of the near pairs of short lists, and in long ones, of those that share a third byte, of neighbours in the order of further bytes, those of _spanning.

    A row (a, a, list) says that the list, of which a is a member, has pairs that are not among them: _link_rest goes through it.
    """
    entries = np.frombuffer(b"".join(x.as_py() for x in bucket.column("entries")), ENTRY)
    entries = entries[np.argsort(entries["list"], kind="stable")]
    lists = entries["list"]
    start = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
    size = np.diff(np.append(start, len(lists)))
    long_ = np.repeat(size > SHORT, size)
    found = [np.empty((0, 4), np.int64)]
    for some, third in ((~long_, False), (long_, True)):
        e = entries[some]
        if not len(e):
            continue
        if not third:
            orders = [(np.arange(len(e)), e["list"].astype(np.uint64))]
        else:
            wide = np.ascontiguousarray(e["fp"]).view(np.uint8).reshape(len(e), WIDE)
            first = _CHOICES[e["list"] >> 16, 0].astype(np.int64)
            at = lambda k, wide=wide, first=first: wide[np.arange(len(first)), (first + k) % WIDE].astype(np.uint64)
            orders = []
            for k, offset in enumerate(OFFSETS):
                rest = at(OFFSETS[k - 1]) << np.uint64(8) | at(OFFSETS[k - 2])
                key = e["list"].astype(np.uint64) << np.uint64(8) | at(offset)
                order = np.argsort(key << np.uint64(16) | rest, kind="stable")
                orders.append((order, key[order]))
        met = [np.empty((0, 3), np.int64)]
        for order, key in orders:
            met += [np.stack([np.minimum(order[i], order[j]), np.maximum(order[i], order[j]), apart], 1) for i, j, apart in _pairs_ahead(key, e["fp"][order], AHEAD if third else SHORT)]
        i, j, apart = np.unique(np.concatenate(met), axis=0).T
        mine = _first_list(e[i], e[j])
        i, j, apart = i[mine], j[mine], apart[mine]
        a, b = e["node"][i], e["node"][j]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b), apart, e["list"][i]], 1))
    pairs = np.concatenate(found)
    links_, left = _spanning(pairs[np.lexsort((pairs[:, 1], pairs[:, 0], pairs[:, 2]))])
    more = start[(size > SHORT) | np.isin(lists[start], list(left))]
    a, b = np.array(links_, np.int64).reshape(-1, 2).T
    member = entries["node"][more]
    return pa.table({"a": pa.array(np.concatenate([a, member])), "b": pa.array(np.concatenate([b, member])), "list": pa.array(np.concatenate([np.full(len(a), -1), lists[more]]).astype(np.int64))})


def _stars(pairs: np.ndarray) -> np.ndarray:
    """Links (node, smallest node) that connect what pairs connect: a row for each node but one of a group."""
    nodes, at = np.unique(pairs, return_inverse=True)
    i, j = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[label[moved]]], 1)


def _meet_rest(bucket: pa.Table) -> pa.Table:
    """All near pairs (a < b) of the lists of a bucket (GROUPED entries) whose members are in different groups so far, short or long; a pair comes from the first of its lists only."""
    return _rest(bucket, False)


def _link_rest(bucket: pa.Table) -> pa.Table:
    """(a, b) for each node a of the pairs of _meet_rest: b is the smallest of the groups that the pairs connect with its own. A row a node, not one a pair."""
    return _rest(bucket, True)


def _rest(bucket: pa.Table, connect: bool) -> pa.Table:
    entries = np.frombuffer(b"".join(x.as_py() for x in bucket.column("entries")), GROUPED)
    entries = entries[np.lexsort((entries["root"], entries["list"]))]
    start = np.flatnonzero(np.append(True, entries["list"][1:] != entries["list"][:-1]))
    size = np.diff(np.append(start, len(entries)))
    mixed = entries["root"][start] != entries["root"][start + size - 1]
    found = []

    def keep(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        other = e["root"][i] != e["root"][j]
        i, j = i[other], j[other]
        for k in range(0, len(i), 1 << 16):
            a, b = e[i[k : k + (1 << 16)]], e[j[k : k + (1 << 16)]]
            first = _first_list(a, b)
            x, y = a["node"][first], b["node"][first]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))

    e = entries[np.repeat(mixed & (size <= SHORT), size)]
    for i, j, _ in _pairs_ahead(e["list"], np.ascontiguousarray(e["fp"]), SHORT):
        keep(e, i, j)
    for at, n in zip(start[mixed & (size > SHORT)].tolist(), size[mixed & (size > SHORT)].tolist()):
        e = entries[at : at + n]
        fp = np.ascontiguousarray(e["fp"])
        _, where, members = np.unique(e["root"], return_index=True, return_counts=True)
        most = int(members.argmax())
        # the members of the largest group need not meet one another; they come last
        order = np.concatenate([np.arange(where[most]), np.arange(where[most] + members[most], n), np.arange(where[most], where[most] + members[most])])
        e, fp = e[order], fp[order]
        step = max(1, BLOCK // n)
        for k in range(0, n - int(members[most]), step):
            to = min(k + step, n - int(members[most]))
            apart = np.bitwise_count(fp[k:to, None, :] ^ fp[None, k:, :]).sum(2, dtype=np.int64)
            i, j = np.nonzero(apart <= FAR)
            keep(e, i[i < j] + k, j[i < j] + k)
        if connect and len(found) > 64:  # no more pairs are held than some blocks give
            found[:] = [_stars(np.concatenate(found))]
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    if connect and len(pairs):
        nodes, at = np.unique(entries["node"], return_index=True)
        own = entries["root"][at]
        groups_ = own[np.searchsorted(nodes, pairs)]
        star = _stars(groups_[groups_[:, 0] != groups_[:, 1]])
        met = np.unique(pairs)
        root = own[np.searchsorted(nodes, met)]
        order = np.argsort(star[:, 0])
        place = np.minimum(np.searchsorted(star[order, 0], root), len(star) - 1)
        pairs = np.stack([met, np.where(star[order[place], 0] == root, star[order[place], 1], root)], 1)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _joined(least: float):
    """Links (a, b) between the groups `root` of a cell's nodes: every pair of different groups whose shingle sets have the similarity is found, one that joins what is joined already is left out."""

    def run(cell: pa.Table) -> pa.Table:
        root, side = cell.column("root").to_numpy(), cell.column("side").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in cell.column("shingles")]
        size = np.array([len(x) for x in sets])
        group, members = np.unique(root, return_inverse=True)
        rare, count = np.unique(np.concatenate(sets), return_counts=True)
        rank = np.empty(len(rare), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(rare))
        # of similar sets the rarest shingles, all but `least` of them and one more, share one
        first = [np.sort(rank[np.searchsorted(rare, x)])[: len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1] for x in sets]
        key, who = np.concatenate(first), np.repeat(np.arange(len(sets)), [len(x) for x in first])
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        most, both = int(np.bincount(members).argmax()), bool((side != side[0]).any())
        label = np.arange(len(group))
        out = []
        for i in np.flatnonzero(members != most).tolist():  # the largest group meets the others from their side
            low, high = np.searchsorted(key, first[i]), np.searchsorted(key, first[i], "right")
            near = np.unique(np.concatenate([who[a:b] for a, b in zip(low.tolist(), high.tolist())])) if len(low) else low
            near = near[(label[members[near]] != label[members[i]]) & (size[near] >= least * size[i] - 1e-9) & (least * size[near] <= size[i] + 1e-9)]
            for j in near[side[near] != side[i]].tolist() if both else near.tolist():
                if label[members[i]] != label[members[j]] and similarity(sets[i], sets[j]) >= least:
                    out.append((i, j))
                    label[label == label[members[j]]] = label[members[i]]
        return pa.table({"a": pa.array([root[i] for i, _ in out], pa.int64()), "b": pa.array([root[j] for _, j in out], pa.int64())})

    return run


#: Bytes of shingle sets in a block; a larger set of texts that may be near is compared block against block.
CELL_BYTES = 32 << 20


def _compared_groups(texts: DataFrame, classes: DataFrame, near: DataFrame, left: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b: groups) of the groups `root` of nodes (left: node, root) that near (node, group) connects: all pairs of a connected set are compared where its shingle sets lie, and none is a row."""
    met = written(near.join(left.select("node", "root").hint("merge"), "node"))
    sets = components(met.select(F.col("root").alias("a"), F.col("group").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("set"))
    within = written(met.select("node", "root").distinct().join(sets, "root").select("node", "root", "set"))
    sets = written(within.join(_shingles(texts, classes, within.select("node"), words).hint("merge"), "node"))
    sides = sets.groupBy("set").agg(F.expr(f"cast(ceil(sum(length(shingles)) / {CELL_BYTES}) as int)").alias("n"))
    placed = sets.join(sides.select("set", F.greatest("n", F.lit(1)).alias("n")), "set").withColumn("side", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least("side", k).alias("i"), F.greatest("side", k).alias("j")))).alias("cell")
    dealt = placed.select("set", "node", "root", "shingles", "side", other).select("set", "cell.i", "cell.j", "node", "root", "shingles", "side")
    return dealt.groupBy("set", "i", "j").applyInArrow(_joined(least), "a long, b long")


def _spanning(pairs: np.ndarray, each: int = 2) -> tuple[list[tuple[int, int]], set[int]]:
    """Of pairs (a, b, bits apart, list), nearest first, those that join two groups so far, and each member's `each` nearest: a group of n gives some n links, not its square; and the lists of the other pairs."""
    root: dict[int, int] = {}
    count: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, left = [], set()
    for a, b, _, held in pairs.tolist():
        x, y = find(a), find(b)
        if x != y or count.get(a, 0) < each or count.get(b, 0) < each:
            root[x] = y
            count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
            out.append((a, b))
        else:
            left.add(held)
    return out, left


def _sets(model, words: int):
    """(doc_id, digest, shingles) of the rows whose doc_id the filter holds."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(model.value, batch.column(0).to_numpy())))
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingle_set(t.as_py(), words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _verified(least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = lambda c: (np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c))  # noqa: B023, E731
            ok = pa.array([similarity(x, y) >= least for x, y in zip(sets(2), sets(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(ok)

    return run


def _compared(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those of pairs (a, b: nodes of classes) whose shingle sets have the similarity."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(_shingles(texts, classes, asked, words))
    compared = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
    compared = compared.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    return compared.select("a", "b", "x", "y").mapInArrow(_verified(least), "a long, b long")


def _shingles(texts: DataFrame, classes: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the nodes asked for."""
    own = written(classes.select("node", F.col("first").alias("doc_id"), F.col("shingles").alias("digest")).join(asked, "node"))
    # only texts of candidates make their shingle sets again and travel: a filter of bounded size says which
    model = texts.sparkSession.sparkContext.broadcast(bit_filter(own.select("doc_id")))
    held = texts.mapInArrow(_sets(model, words), "doc_id long, digest binary, shingles binary")
    return held.join(own.hint("merge"), ["doc_id", "digest"]).dropDuplicates(["node"]).select("node", "shingles")


def near_groups(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links reach, for each row of docs with a doc_id.

    Two rows link if their sets of word shingles (A-Z lower-cased; of a text
    with fewer words the whole sequence) have a Jaccard similarity of `least` or
    more; no link is made below it. Equal sets always meet. Others meet in the
    index with a probability of some 0.95 at a similarity of 0.8 and more above.
    Of a large group the nearest pairs are compared first, some for each member;
    then all other pairs that meet, but for those inside a group that is linked
    already. Texts without words (null, empty) are one group. Rows with a null doc_id take no
    part; repeated rows come out repeated; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    fps = written(texts.mapInArrow(_wide(words), "doc_id long, shingles binary, fp binary"))
    first = fps.groupBy("shingles").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"))
    classes = written(first.withColumn("node", F.monotonically_increasing_id()))
    # the buckets follow the shuffle partitions, so a bucket stays as small as they are
    spread = classes.select("node", "fp").repartition(parts(spark), "node")
    posted = spread.mapInArrow(_post(4 * parts(spark)), "bucket int, entries binary")
    met = written(posted.groupBy("bucket").applyInArrow(_meet, "a long, b long, list long"))
    pairs, more = met.where("list < 0").select("a", "b"), met.where("list >= 0").select(F.col("list").alias("slot"))
    near = written(_compared(texts, classes, pairs, words, least))
    linked = components(near)
    if more.limit(1).count():
        # all pairs that are left are compared as well, but those inside a group that the links above made
        model = spark.sparkContext.broadcast(packed_bits(more, LIST_BITS))
        open_ = classes.select("node", "fp").mapInArrow(_open_nodes(model), "node long, fp binary")
        left = written(open_.join(linked, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("root")))
        posted = left.repartition(parts(spark), "node").mapInArrow(_post(4 * parts(spark), kind=GROUPED, model=model), "bucket int, entries binary")
        rest = written(posted.groupBy("bucket").applyInArrow(_link_rest, "a long, b long").distinct()).toDF("node", "group")
        # the groups are joined, not their members' links gone through again
        over = written(components(_compared_groups(texts, classes, rest, left, words, least)).select(F.col("node").alias("root"), F.col("root").alias("top")))
        both = linked.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        alone = over.join(linked.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
        linked = both.unionByName(alone)
    member = classes.join(linked, "node", "left").select("shingles", "first", F.coalesce("root", "node").alias("root"))
    roots = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(member.join(roots, "root").select("shingles", "component_id"))
    return fps.join(named, "shingles").select("doc_id", "component_id")


def dedup(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies (near_groups): that of its smallest doc_id, whatever their columns are called.

    Rows without a doc_id stay, every one; of rows that share an id one stays; null and
    empty texts are one group; an empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    found = written(near_groups(docs, words, least))
    stay = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    # the ids that stay grow with the documents: a merge join at any size, never a broadcast
    kept = rows.where("doc_id is not null").join(stay.select("doc_id").hint("merge"), "doc_id", "left_semi")
    if stay.where("n > 1").limit(1).count():  # a doc_id that occurs again: its rows lie together after the join
        kept = kept.dropDuplicates(["doc_id"])
    if docs.where("doc_id is null").limit(1).count():
        kept = kept.unionByName(rows.where("doc_id is null"))
    return kept.select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays; edge rows as in dedup()."""
    return dedup(docs)
