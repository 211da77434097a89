"""Distributed test: does the same string start earlier?

Records are (key, text, start, length): a hash of a string in 128 bits, the text
that holds it and where.  Each group of texts packs its records into one row per bucket,
after settling among themselves all that it can: of equal keys only the
earliest goes on, so a string that a third of all texts share reaches its
bucket once per group and not once per text.  A bucket sorts its keys and names
the records that are not the earliest.  Everything travels as packed arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, binary, groups, ids, text_buffer
from .runtime import give_back

PACKED = "bucket int, settled boolean, doc binary, fp binary, key binary, owner binary, start binary, length binary, times binary"
FOUND = "doc long, fp long, start binary, length binary"


class Texts:
    """One group of rows of a documents batch (doc_id, text, fp): ids, hashes of the texts and bytes."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        self.doc = ids(batch.column("doc_id"))
        self.data, self.at = text_buffer(batch.column("text"))
        self.fp = batch.column("fp").to_numpy()


def earlier_than(doc: np.ndarray, fp: np.ndarray, start: np.ndarray, first: np.ndarray, within: bool) -> np.ndarray:
    """For records in sorted order: does the record at index `first` come earlier?"""
    less = doc[first] < doc
    if within:  # in one document too, by start; rows of one id but other texts follow their fingerprints
        less |= (doc[first] == doc) & ((fp[first] < fp) | (fp[first] == fp) & (start[first] < start))
    return less


def not_earliest(key: np.ndarray, doc: np.ndarray, fp: np.ndarray, start: np.ndarray, within: bool) -> np.ndarray:
    """Of records in any order, those with an earlier one of the same key; key: two columns, 128 bits."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key[:, 0], kind="stable")
    k = key[order, 0]
    new = np.empty(len(k), bool)
    new[0] = True
    np.not_equal(k[1:], k[:-1], out=new[1:])
    out = np.zeros(len(k), bool)
    alone = new & np.append(new[1:], True)
    many = order[~alone]
    if len(many):
        many = many[np.lexsort((start[many], fp[many], doc[many], key[many, 1], key[many, 0]))]
        k = key[many]
        head = np.append(True, (k[1:] != k[:-1]).any(1))
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        out[many] = earlier_than(doc[many], fp[many], start[many], first, within)
    return out


def _runs(place: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray, merge: bool) -> np.ndarray:
    """First record of each run of adjoining records; unless merged, only records of one start form runs."""
    if not len(owner):
        return np.zeros(0, np.int64)
    on = (place[1:] == place[:-1]) & (owner[1:] == owner[:-1]) & (start[1:] == start[:-1] + length[:-1])
    if not merge:
        on &= (length[1:] == 1) & (length[:-1] == 1)
    return np.flatnonzero(np.append(True, ~on))


def packed(texts: Texts, key, owner, start, length, route, buckets: int, within: bool, known=None) -> pa.RecordBatch:
    """One row per bucket of the records left to settle, and one per bucket of those that are settled here.

    Records that adjoin travel as runs.  known: owner, start and length of spans that the caller has settled.
    """
    late = not_earliest(key, texts.doc[owner], texts.fp[owner], start, within)
    out = []
    for settled in (True, False):
        if settled:
            o, s, n, k = owner[late], start[late], length[late], None
            if known is not None:
                o, s, n = (np.concatenate(x) for x in zip((o, s, n), known, strict=True))
            place = (mix_id(texts.doc[o]) % U64(buckets)).astype(np.int32)
        else:
            o, s, n, k = owner[~late], start[~late], length[~late], key[~late]
            place = (route[~late] % U64(buckets)).astype(np.int32)
        order = np.lexsort((s, o, place))
        o, s, n, place = o[order], s[order], n[order], place[order]
        head = _runs(place, o, s, n, merge=settled)
        ends = np.append(head[1:], len(o))[: len(head)]
        times = np.ones(len(head), np.int64) if settled else ends - head
        unit = s[ends - 1] + n[ends - 1] - s[head] if settled else n[head]
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(o) else np.zeros(0, np.int64)
        run_cuts = np.append(np.searchsorted(head, cut), len(head))
        # the texts of each bucket, once each
        ro, rp = o[head], place[head]
        step = np.append(True, (ro[1:] != ro[:-1]) | (rp[1:] != rp[:-1])) if len(ro) else np.zeros(0, bool)
        who = np.flatnonzero(step)
        doc_cuts = np.append(np.searchsorted(who, run_cuts[:-1]), len(who))
        local = np.cumsum(step) - 1 - np.repeat(doc_cuts[:-1], np.diff(run_cuts)) if len(ro) else ro
        rows = len(cut)
        out.append(
            pa.RecordBatch.from_arrays(
                [
                    pa.array(place[cut], pa.int32()),
                    pa.array(np.full(rows, settled)),
                    binary(texts.doc[ro[who]], doc_cuts),
                    binary(texts.fp[ro[who]], doc_cuts),
                    binary(np.zeros(0, U64), np.zeros(rows + 1, np.int64)) if settled else binary(k[order].ravel(), 2 * np.append(cut, len(o))),
                    binary(local.astype(np.uint32), run_cuts),
                    binary(s[head].astype(np.uint32), run_cuts),
                    binary(unit.astype(np.uint32), run_cuts),
                    binary(times.astype(np.uint32), run_cuts),
                ],
                names=[c.split()[0] for c in PACKED.split(", ")],
            )
        )
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(map(len, out)) else out[0]


def mix_id(x: np.ndarray) -> np.ndarray:
    from .kernels import mix

    return mix(x.view(U64) + U64(0x9E3779B97F4A7C15))


def _unpack(table: pa.Table):
    """doc, fp, start, length of every record, and the keys."""
    take = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    owner = take("owner", np.uint32)
    doc = join([d[o] for d, o in zip(take("doc", np.int64), owner, strict=True)], np.int64)
    fp = join([f[o] for f, o in zip(take("fp", np.int64), owner, strict=True)], np.int64)
    start, length, times = (join(take(c, np.uint32), np.uint32).astype(np.int64) for c in ("start", "length", "times"))
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    doc, fp, start, length = (np.repeat(x, times) for x in (doc, fp, start, length))
    return doc, fp, start + step * length, length, join(take("key", U64), U64).reshape(-1, 2)


def found(table: pa.Table, within: bool) -> pa.Table:
    """The late records of one bucket, by text."""
    import pyarrow.compute as pc

    settled = table.column("settled")
    d1, f1, s1, l1, _ = _unpack(table.filter(settled))
    d2, f2, s2, l2, key = _unpack(table.filter(pc.invert(settled)))
    late = not_earliest(key, d2, f2, s2, within)
    return by_text(np.concatenate([d1, d2[late]]), np.concatenate([f1, f2[late]]), np.concatenate([s1, s2[late]]), np.concatenate([l1, l2[late]]), merge=True)


def by_text(doc: np.ndarray, fp: np.ndarray, start: np.ndarray, length: np.ndarray, merge: bool) -> pa.Table:
    """Spans packed by text, in order; merged: adjoining ones become one."""
    order = np.lexsort((start, fp, doc))
    doc, fp, start, length = doc[order], fp[order], start[order], length[order]
    if merge and len(doc):
        on = (doc[1:] == doc[:-1]) & (fp[1:] == fp[:-1]) & (start[1:] == start[:-1] + length[:-1])
        run = np.flatnonzero(np.append(True, ~on))
        ends = np.append(run[1:], len(doc)) - 1
        doc, fp, start, length = doc[run], fp[run], start[run], start[ends] + length[ends] - start[run]
    head = np.append(True, (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    cuts = np.append(first, len(doc))
    return pa.table({"doc": doc[first], "fp": fp[first], "start": binary(start.astype(np.uint32), cuts), "length": binary(length.astype(np.uint32), cuts)})


def late_rows(records: DataFrame, buckets: int, within: bool) -> DataFrame:
    """(doc, fp, starts, lengths) of the records with an earlier equal one, some rows per text."""
    rows = records.repartitionById(min(buckets, 1 << 14), F.col("bucket")).groupBy("bucket")
    return rows.applyInArrow(lambda table: found(table, within), FOUND)


def gathered(late: DataFrame) -> DataFrame:
    """One row per text: (doc, fp, late)."""
    return late.groupBy("doc", "fp").agg(F.collect_list(F.struct("start", "length")).alias("late"))


def settle(records: DataFrame, buckets: int, within: bool) -> DataFrame:
    """One row per text of the starts and lengths of its records with an earlier equal one."""
    return gathered(late_rows(records, buckets, within))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("fp"))


def with_late(texts: DataFrame, late: DataFrame) -> DataFrame:
    """Every row with late (null: none); texts: doc_id, fp and more."""
    keyed = texts.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    return keyed.join(late, ["doc", "fp"], "left").drop("doc", "fp")


def spans(value) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths from one collected value (None: none)."""
    if not value:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (
        np.concatenate([np.frombuffer(x["start"], np.uint32) for x in value]).astype(np.int64),
        np.concatenate([np.frombuffer(x["length"], np.uint32) for x in value]).astype(np.int64),
    )


class Bitmap:
    """A bitmap of fixed size, 2**bits, over hashes; buckets fill slices of it."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> U64(64 - self.bits)
        return (self.data[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


def place_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def collected(slices: list, bits: int, name: str) -> np.ndarray:
    """Bits from (places as bytes) rows; what comes to the driver is at most the bitmap's own size.

    Each row holds one bucket's slice of the bitmap.
    """
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in slices:
        part = np.frombuffer(row[name], np.uint8)
        out[row["at"] : row["at"] + len(part)] |= part
    return out


def batches(rows: Iterator[pa.RecordBatch], most: int = 4 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Groups of rows with a bounded amount of text; at the end the worker gives back memory."""
    for batch in rows:
        for i, j in groups(batch.column(text), most):
            yield batch.slice(i, j - i)
    batch = None
    give_back()


def gathered_batches(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes, or as they are where they are larger."""
    some: list[pa.RecordBatch] = []
    for batch in rows:
        if some and sum(b.nbytes for b in some) + batch.nbytes > most:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some = []
        if len(batch):
            some.append(batch)
    if some:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
