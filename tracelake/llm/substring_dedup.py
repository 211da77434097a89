"""Removal of word sequences that an earlier document already has (fixed-block anchors).

Every text is cut into non-overlapping blocks of `block` words; their hashes are
the index.  Every rolling window of `block` words probes it.  As a window of
`length` >= 2 * block - 1 words holds a whole block, a repeat of `length` words
always has an anchor: a block of one text that a window of the other hits.

1. Blocks and windows meet by hash bucket.  The places of blocks that some
   other window hits are set in a bitmap of fixed size (`bits`), which all
   executors get.  A full bitmap only lets more candidates through.
2. Each text extends its hits: all windows of `length` words that hold a hit
   are candidates, and those that start in a document with a smaller id are
   found by their hashes of 128 bits (module earliest); their union is the
   maximal repeats.
3. Covered words go.

Defined cases.  Null or empty text: no words, result empty.  Texts of fewer than
`length` words are kept.  Null doc_id counts as the smallest id.  Rows with one
doc_id are one document: none of them removes words of the other, and repeated
rows give equal results.  Words are separated by space, tab, LF, VT, FF, CR only.
Extra columns do not matter; clashing names (fp, late) neither.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import earliest as E
from .kernels import U64, Words, binary, covered, mix, rolling
from .runtime import free_shuffles, parts, stored

LENGTH, BLOCK, BITS = 50, 25, 28
_SECOND = U64(0x5851F42D4C957F2D)


def _windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they are all of one text."""
    n = len(words.hash)
    h = np.zeros(n, U64)
    r = rolling(words.hash, k)
    h[: len(r)] = r
    return h, words.window_starts(k)


def _probes(rows: Iterator[pa.RecordBatch], bits_of_bucket: int, block: int) -> Iterator[pa.RecordBatch]:
    """Per group of texts and bucket: the windows' hashes, each once, flagged if a block (2) or found twice (1).

    The top bits of a hash name its bucket, the next 30 are kept beside the two flags: 4 bytes a window.
    """
    for batch in E.batches(rows):
        words = Words(*E.text_buffer(batch.column("text")))
        h, valid = _windows(words, block)
        place = np.arange(len(h)) - np.repeat(words.first[:-1], words.counts())
        h, is_block = h[valid] >> U64(34 - bits_of_bucket), place[valid] % block == 0
        if not len(h):
            continue
        h = h << U64(1) | is_block.astype(U64)
        h.sort()
        key, is_block = h >> U64(1), h & U64(1)
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        flag = np.maximum.reduceat(is_block, head) << U64(1) | (np.diff(np.append(head, len(h))) > 1).astype(U64)
        key = key[head]
        bucket = (key >> U64(30)).astype(np.int32)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        value = ((key & U64((1 << 30) - 1)) << U64(2) | flag).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), binary(value, np.append(cut, len(key)))], names=["bucket", "value"])


def _slice(table: pa.Table, bits_of_bucket: int, bits: int) -> pa.Table:
    """Places of the bucket's blocks that at least two windows have, as a slice of the bitmap."""
    value = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("value").to_pylist()])
    value.sort()
    key, flag = value >> np.uint32(2), value & np.uint32(3)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    flag = np.bitwise_or.reduceat(flag, head)
    many = (np.diff(np.append(head, len(value))) > 1) | (flag & 1 > 0)
    place = (key[head[many & (flag & 2 > 0)]] >> np.uint32(30 + bits_of_bucket - bits)).astype(np.int64)
    bitmap = np.zeros(1 << (bits - bits_of_bucket - 3), np.uint8)
    np.bitwise_or.at(bitmap, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
    at = table.column("bucket")[0].as_py() * len(bitmap)
    return pa.table({"at": pa.array([at], pa.int64()), "bits": pa.array([bitmap.tobytes()], pa.binary())})


def anchors(docs: DataFrame, block: int = BLOCK, bits: int = BITS) -> np.ndarray:
    """The bitmap of blocks that some other window hits."""
    log = min(parts(docs, 4 << 20).bit_length() - 1, bits - 10)
    probes = docs.select("text").mapInArrow(lambda rows: _probes(rows, log, block), "bucket int, value binary")
    slices = probes.repartitionById(min(1 << log, 1 << 14), F.col("bucket")).groupBy("bucket").applyInArrow(lambda t: _slice(t, log, bits), "at long, bits binary")
    return E.collected(slices.collect(), bits, "bits")


def _candidates(words: Words, bitmap: E.Bitmap, length: int, block: int):
    """Starts of the windows of `length` words that hold a hit, their hashes, and a route that neighbours share."""
    h, valid = _windows(words, block)
    hit = np.zeros(len(h) + 1, np.int64)
    hit[1:] = np.cumsum(valid & bitmap.has(h))
    whole = np.flatnonzero(words.window_starts(length))
    reach = length - block + 1
    near = hit[whole + reach] - hit[whole] > 0
    start = whole[near]
    # the least block hash inside a window: the same for equal windows, and mostly for the next one
    least, step = h, 1
    while step < reach:
        by = min(step, reach - step)
        least = np.append(np.minimum(least[:-by], least[by:]), least[len(least) - by :]) if len(least) > by else least
        step += by
    whole_hash = _windows(words, length)[0][start]
    second = np.zeros(len(h), U64)
    r = rolling(mix(words.hash ^ _SECOND), length)
    second[: len(r)] = r
    return start, np.stack([whole_hash, second[start]], 1), mix(least[start])


def _records(rows: Iterator[pa.RecordBatch], bitmap: E.Bitmap, buckets: int, length: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch in E.batches(rows):
        texts = E.Texts(batch)
        words = Words(texts.data, texts.at)
        start, key, route = _candidates(words, bitmap, length, block)
        owner = words.text_of_word()[start]
        yield E.packed(texts, key, owner, start - words.first[owner], np.ones(len(start), np.int64), route, buckets, within=False)


def _kept(text: str, late, length: int) -> tuple[list[bytes], int]:
    words = text.encode().split()
    starts, count = E.spans(late)
    gone = covered(len(words), starts, count - 1 + length)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def late_windows(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """Starts of the windows that an earlier document has, one row per (doc, fp)."""
    if length < 2 * block - 1:
        raise ValueError("a window of `length` words must hold a whole block: length >= 2 * block - 1")
    docs = E.hashed(docs)
    shared = docs.sparkSession.sparkContext.broadcast(anchors(docs, block, bits))
    buckets = parts(docs, 8 << 20)
    records = docs.mapInArrow(lambda rows: _records(rows, E.Bitmap(bits, shared.value), buckets, length, block), E.PACKED)
    late = stored(E.settle(records, buckets, within=False), "late")
    del records
    shared.destroy()
    free_shuffles(docs.sparkSession)
    return late


def digests(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    late = late_windows(docs, length, block, bits)

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in E.batches(rows):
            n, removed, sha = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("late").to_pylist(), strict=True):
                words, gone = _kept(text or "", found, length)
                n.append(len(words) + gone)
                removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return E.with_late(E.hashed(docs), late).mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedupe(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """The documents with covered words taken out; a text that loses none stays as it is, a shortened one is its kept words joined by a space."""
    late = late_windows(docs, length, block, bits)
    names = docs.columns
    others = [c for c in names if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(others)]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("fp"))
    kind = rows.schema["row"].dataType.simpleString()

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in E.batches(rows):
            text = batch.column("text").to_pylist()
            for i, found in enumerate(batch.column("late").to_pylist()):
                if found:
                    words, n = _kept(text[i], found, length)
                    text[i] = b" ".join(words).decode() if n else text[i]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), batch.column("row")], names=["text", "row"])

    done = E.with_late(rows, late).select("text", "row", "late").mapInArrow(cut, f"text string, row {kind}")
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.d{others.index(c)}").alias(c) for c in names])
