"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts every text into chunks whose borders depend
on nearby bytes only, so a passage that documents share falls into the same
chunks in each; a short text is one chunk. Digests of all chunks are counted,
and those that occur again go into a filter of bounded size. A text without any
is encoded where it is. The others travel, copies as one row, to the task of
their least shared chunk, so documents that share chunks meet, and there every
shared chunk is encoded once and kept in a bounded store that outlives the task.
A task has one Python process, which holds some megabytes of text at a time.

Joins between chunks are repaired: from the start of the last pre-token that is
sure, the whole text's pre-tokens are followed until one ends where one of the
next chunk ends too and the ids of the stretch, encoded again, agree with the
chunk's own; a join that finds no such place grows through the chunk.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bit_filter, forget, in_filter, parts, slots_of, table, written
from loomgraph.llm.tokens import PATTERN, codec, default_path

#: Rolling window in bytes, mean chunk in bytes (powers of two), and the store's bound in bytes a worker.
ROLL, MEAN_CHUNK, STORE_BYTES = 16, 1024, 24 << 20
#: Bytes of a batch that goes out, of travelled text that is sorted at once, and of parcels that stay in memory.
BATCH, WINDOW, PARCELS = 4 << 20, 8 << 20, 32 << 20
SCHEMA, DECODED = "doc_id long, ids binary", "doc_id long, ids binary, decoded string"
ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_PRE = regex.compile(PATTERN)


def chunk_cuts(data: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Positions after which the hash of the last ROLL bytes has log2(mean) zero bits; ascending."""
    if len(data) < ROLL:
        return np.empty(0, np.int64)
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    width, factor = 1, 0x85EBCA6B
    while width < ROLL:  # the hash of 2w bytes from two hashes of w bytes
        h = h[:-width] * np.uint32(factor) + h[width:]
        factor = factor * factor & 0xFFFFFFFF | 1
        width *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.flatnonzero(h >> np.uint32(32 - mean.bit_length() + 1) == 0) + ROLL


def chunks(raw: bytes, mean: int = MEAN_CHUNK) -> list[tuple[int, int]]:
    """[start, end) of the chunks of a text; cuts inside a character move to its end."""
    if len(raw) < mean:
        return [(0, len(raw))]
    data = np.frombuffer(raw, np.uint8)
    edges = [0]
    for cut in chunk_cuts(data, mean).tolist():
        while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
            cut += 1
        if edges[-1] < cut < len(raw):
            edges.append(cut)
    return list(zip(edges, [*edges[1:], len(raw)]))


def digests(raw: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in spans], np.uint64).view(np.int64)


class Piece:
    """The ids of a stretch of text, and where its pre-tokens end: the first few, and the start of the last one."""

    FIRST = 24

    def __init__(self, text: str, encode):
        self.ids = encode(text)
        self.ends: list[int] = []
        last = 0
        for m in _PRE.finditer(text):
            last = m.start()
            if len(self.ends) < self.FIRST:
                self.ends.append(m.end())
        self.last = last
        self.before_last = len(self.ids) - len(encode(text[last:])) if text else 0
        self.size = len(text)


class Store:
    """Pieces by text; the oldest go once size bytes are held."""

    def __init__(self, size: int):
        self.size, self.held, self.of = size, 0, OrderedDict()
        self.hits = self.misses = 0

    def get(self, text: str, encode) -> Piece:
        piece = self.of.get(text)
        if piece is not None:
            self.hits += 1
            return piece
        self.misses += 1
        piece = self.of[text] = Piece(text, encode)
        self.held += 2 * len(text) + piece.ids.nbytes + 2000
        while self.held > self.size:
            old, gone = self.of.popitem(last=False)
            self.held -= 2 * len(old) + gone.ids.nbytes + 2000
        return piece


_STORES: dict[str, Store] = {}


def encode_chunked(text: str, codec_, store: Store, spans: list[tuple[int, int]], shared: np.ndarray) -> np.ndarray:
    """The ids of text; its shared chunks come from the store. spans: byte places of the chunks."""
    encode = codec_.encode
    if not shared.any() or any(x in text for x in codec_.specials):
        return encode(text)
    if len(spans) == 1:
        return store.get(text, encode).ids
    raw = text.encode()
    segments: list[tuple[str, bool]] = []
    start = 0
    for k, (a, b) in enumerate(spans):  # neighbours that nobody shares are one stretch
        if shared[k]:
            if start < a:
                segments.append((raw[start:a].decode(), False))
            segments.append((raw[a:b].decode(), True))
            start = b
    if start < len(raw):
        segments.append((raw[start:].decode(), False))
    out: list[np.ndarray] = []
    at = sure = 0  # where the segment starts, and up to where the ids in out are the text's
    for piece_text, kept in segments:
        piece = store.get(piece_text, encode) if kept else Piece(piece_text, encode)
        skip, joined = 0, at == 0
        if not joined:
            ends = [at + e for e in piece.ends if at + e <= at + piece.last]
            for m in _PRE.finditer(text, sure):
                if m.end() > at + piece.last or not ends:
                    break
                if m.end() < at or m.end() not in ends:
                    continue
                following = [e for e in ends if e > m.end()]
                if not following:
                    break
                # encoded again up to one pre-token beyond: the ids have to be the piece's own there
                own_head, own_next = encode(text[at : m.end()]), encode(text[m.end() : following[0]])
                again = encode(text[sure : following[0]])
                n, h = len(own_next), len(own_head)
                if n and np.array_equal(again[-n:], own_next) and np.array_equal(piece.ids[h : h + n], own_next):
                    out.append(again[:-n])
                    skip, joined = h, True
                    break
        if joined and piece.before_last >= skip:
            out.append(piece.ids[skip : piece.before_last])
            sure = at + piece.last
        at += piece.size
    out.append(encode(text[sure:]))
    return np.concatenate(out)


def _digests(mean: int):
    """(digest, n) of each batch's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, np.int64)]
            for x in batch.column(0):
                raw = (x.as_py() or "").encode()
                if raw:
                    found.append(digests(raw, chunks(raw, mean)))
            digest, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(n.astype(np.int64))], names=["digest", "n"])

    return run


def _batched(rows: Iterator[tuple[list[int | None], np.ndarray]], decode: Callable[[np.ndarray], str] | None) -> Iterator[pa.RecordBatch]:
    """doc_id, ids and, if decode is given, the decoded text, from documents and the ids that they have in common."""
    schema = ARROW if decode else pa.schema(list(ARROW)[:2])
    some, held = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)

    for docs, ids in rows:
        cells = (ids.astype("<u4").tobytes(), *([decode(ids)] if decode else []))
        for doc in docs:
            some.append((doc, *cells))
            held += sum(map(len, cells)) + 16
            if held > BATCH:
                yield out()
                some, held = [], 0
    if some:
        yield out()


def _home(path: str, mean: int, model, decoded: bool):
    """ids of the texts that share no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)

        def rows():
            for batch in batches:
                for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = x.as_py() or ""
                    raw = text.encode()
                    if not raw or not in_filter(model.value[0], digests(raw, chunks(raw, mean))).any():
                        yield [doc], own.encode(text)

        yield from _batched(rows(), own.decode if decoded else None)

    return run


def _travel(mean: int, model, hold: int = 8 << 20):
    """(route, text, docs) of the texts that share chunks, copies in one row; a hot chunk's texts are spread over as many routes as it needs."""
    schema = pa.schema([("route", pa.int64()), ("text", pa.string()), ("docs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            texts = list(held)
            return pa.RecordBatch.from_arrays([pa.array([held[t][0] for t in texts], pa.int64()), pa.array(texts, pa.string()), pa.array([held[t][1] for t in texts], schema.types[2])], schema=schema)

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py() or ""
                if text in held:
                    held[text][1].append(doc)
                    continue
                raw = text.encode()
                found = digests(raw, chunks(raw, mean)) if raw else np.empty(0, np.int64)
                found = found[in_filter(model.value[0], found)]
                if len(found):
                    least = int(found.min())
                    spread = model.value[1].get(least, 1)
                    route = least if spread == 1 else xxhash.xxh3_64_intdigest(f"{least} {xxhash.xxh3_64_intdigest(raw) % spread}") - (1 << 63)
                    held[text] = [route, [doc]]
                    size += len(raw) + 100
                    if size > hold:
                        yield out()
                        held, size = {}, 0
        if held:
            yield out()

    return run


def _parcels(travel, tasks: int):
    """Rows (part, parcel, size) of what travels: the rows of a stretch that go to the same task as one compressed stream, and their bytes before."""
    schema = pa.schema([("part", pa.int32()), ("parcel", pa.binary()), ("size", pa.int64())])

    def parcel(rows: pa.RecordBatch) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(rows)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in travel(batches):
            to = batch.column(0).to_numpy() % tasks
            order = np.argsort(to, kind="stable")
            there, start = np.unique(to[order], return_index=True)
            rows = [batch.take(pa.array(x)) for x in np.split(order, start[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([parcel(x) for x in rows], pa.binary()), pa.array([x.nbytes for x in rows], pa.int64())], schema=schema)

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            yield from pa.ipc.open_stream(x.as_py())


def _in_turn(batches: Iterator[pa.RecordBatch], window: int = WINDOW, most: int = PARCELS) -> Iterator[tuple[str, list[int | None]]]:
    """(text, docs) of a task's parcels (parcel, size), those of a route one after another.

    The parcels stay compressed, beyond `most` bytes in a temporary file, and are opened once for each share of the routes
    that has some `window` bytes. A share of more than two windows comes in several sorted runs.
    """

    def by_route(held: list[pa.RecordBatch]) -> Iterator[tuple[str, list[int | None]]]:
        for _, k, i in sorted((route, k, i) for k, rows in enumerate(held) for i, route in enumerate(rows.column(0).to_pylist())):
            yield held[k].column(1)[i].as_py(), held[k].column(2)[i].as_py()

    with SpooledTemporaryFile(most) as kept:
        lengths, size = [], 0
        for batch in batches:
            lengths += [kept.write(x.as_buffer()) for x in batch.column(0)]
            size += sum(batch.column(1).to_pylist())
        shares = -(-size // window)
        for share in range(shares):
            kept.seek(0)
            held, n = [], 0
            for rows in _opened(pa.record_batch([pa.array([kept.read(x)], pa.binary())], names=["parcel"]) for x in lengths):
                held.append(rows.filter(pa.array(slots_of(rows.column(0).to_numpy(), 32) % shares == share)))
                n += held[-1].nbytes
                if n > 2 * window:
                    yield from by_route(held)
                    held, n = [], 0
            yield from by_route(held)


def _met(path: str, mean: int, store_bytes: int, model, decoded: bool):
    """ids of the texts that travelled, from parcels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        store = _STORES.setdefault(f"{path} {mean} {store_bytes}", Store(store_bytes))

        def rows():
            for text, docs in _in_turn(batches):
                raw = text.encode()
                spans = chunks(raw, mean)
                yield docs, encode_chunked(text, own, store, spans, in_filter(model.value[0], digests(raw, spans)))

        yield from _batched(rows(), own.decode if decoded else None)

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            at, n = 0, max(1, batch.num_rows * (16 << 20) // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, n):
                part = batch.slice(at, n)
                texts = [decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], schema=ARROW)

    return run


def encode(docs: DataFrame, tokenizer: str | None = None, mean: int = MEAN_CHUNK, store_bytes: int = STORE_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian 32-bit) of every whole text; a null text counts as empty and has no ids.

    Repeated rows are encoded row by row; an empty table gives no rows; other
    columns of docs are ignored. Texts that share chunks travel once. With
    decoded, the column that decode() adds comes from the same process.
    """
    schema = DECODED if decoded else SCHEMA
    spark, path = docs.sparkSession, tokenizer or default_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.select("text").mapInArrow(_digests(mean), "digest long, n long").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    shared = written(counted)
    tasks = parts(spark)
    # a chunk that more than a task's share of the shared ones has: 4 a task at most
    limit = max(1000, int((shared.agg(F.sum("n")).first()[0] or 0) // (4 * tasks)))
    hot = {r["digest"]: -(-r["n"] // limit) for r in shared.where(F.col("n") > limit).collect()}
    model = spark.sparkContext.broadcast((bit_filter(shared.select("digest")), hot))  # a filter of bounded size
    forget(shared)
    home = texts.mapInArrow(_home(path, mean, model, decoded), schema)
    parcels = texts.mapInArrow(_parcels(_travel(mean, model), tasks), "part int, parcel binary, size long").repartitionById(tasks, F.col("part"))
    # one Python process a task: each has its own tokenizer, and all of a plan's stage live at the same time
    return home.unionByName(parcels.select("parcel", "size").mapInArrow(_met(path, mean, store_bytes, model, decoded), schema))


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text; ids that are no UTF-8 together give replacement characters, as in the library."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(tokenizer or default_path()), DECODED)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids, and digest of the decoded text, of every document; edge rows as in encode()."""
    return encode(table(spark, sf_dir, "documents"), decoded=True).select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
