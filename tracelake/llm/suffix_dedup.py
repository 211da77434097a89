"""Removal of byte strings of `length` bytes that start earlier too (depth-limited radix sort).

Suffixes are ordered by their first `length` bytes only, by passes over leading
digits; groups that are still equal after the last digit are the repeated
strings.  All passes compare bytes, never hashes of them.

1. The first digit decides the bucket: a suffix's anchor, the run of `length`/4
   bytes with the least hash among those that lie in its first `length` bytes
   (the last of equal ones), and where in the suffix it is.  Equal strings have
   equal anchors.  Neighbouring suffixes share one, so they travel as one range
   of bytes.  Equal ranges of one batch of texts travel once.
2. A bucket takes the anchors' bytes digit by digit (eight bytes each).  Ranges
   alone with theirs leave.  Equal ranges that are left are settled as a whole.
3. The suffixes of the ranges that are left, grouped by anchor and place, go
   through the digits of their `length` bytes; a suffix alone in its group
   leaves at once.  Of each group that remains, all but the earliest are late.

What is sent follows the size of the input, however much of it repeats.  An
anchor that would fill a bucket by itself (a passage of a third of all texts)
is found in a sample of the texts, and its suffixes travel one by one, spread by
all of their bytes; the sample decides the route only, never the result.

Defined cases.  Null or empty text: no bytes.  Texts shorter than `length` are
kept.  Null doc_id counts as the smallest id.  Rows of one doc_id but other
texts are ordered by a hash of the text; repeated rows give equal results and
don't remove each other.  Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import earliest as E
from .kernels import U64, byte_values, covered, ids, mix, prefix, rolling, spans_hash, text_buffer
from .runtime import free_shuffles, input_size, parts, stored

LENGTH = 100
HOT = 4 << 20  # bytes of ranges with one anchor, from which its suffixes travel one by one
_TILE = 1 << 20
_BATCH = 16 << 20
_SUFFIXES = 1 << 21  # suffixes that a bucket takes through the digits at a time
_LOW = U64(0xFFFFFFFF)
_ROWS = "bucket int, kind int, size long, body binary"


def run_of(length: int) -> int:
    """Bytes of an anchor: whole digits."""
    return max(8, length // 4 // 8 * 8)


class Ranges:
    """Runs of suffix starts with one anchor, in a tile of text: their starts, lengths, the anchor's place in them, its hash and one of all bytes."""

    __slots__ = ("start", "count", "place", "anchor", "context")

    def __init__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, hot: np.ndarray | None = None):
        """Suffixes start in [first[i], last[i]) of the data, for each text i."""
        run = run_of(length)
        reach = length - run + 1
        n = max(len(data) - length + 1, 0)
        starts = np.flatnonzero(covered(n, np.minimum(first, n), np.maximum(np.minimum(last, n) - np.minimum(first, n), 0)))
        if not len(starts):
            self.start = self.count = self.place = np.zeros(0, np.int64)
            self.anchor = self.context = np.zeros(0, U64)
            return
        values = byte_values(data)
        pre = prefix(values)
        h = rolling(values, run)
        least = (h & ~_LOW) | (_LOW - np.arange(len(h)).astype(U64))
        step = 1
        while step < reach:
            by = min(step, reach - step)
            least = np.minimum(least[:-by], least[by:])
            step += by
        anchor = (_LOW - (least[starts] & _LOW)).astype(np.int64)
        text = np.searchsorted(first, starts, "right")
        head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1) | (text[1:] != text[:-1])))
        start, count = starts[head], np.diff(np.append(head, len(starts)))
        place, key = anchor[head] - start, h[anchor[head]]
        route = mix(key)
        if hot is not None and len(hot):  # suffix by suffix, each routed by all its bytes
            of = np.isin(key, hot)
            n = count[of]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            single = np.repeat(start[of], n) + step
            start, count = np.append(start[~of], single), np.append(count[~of], np.ones(len(single), np.int64))
            place, key = np.append(place[~of], np.repeat(place[of], n) - step), np.append(key[~of], np.repeat(key[of], n))
            route = np.append(route[~of], spans_hash(pre, single, single + length))
            order = np.argsort(start)
            start, count, place, route = start[order], count[order], place[order], route[order]
        self.start, self.count, self.place, self.anchor = start, count, place, route
        self.context = mix(spans_hash(pre, start, start + count - 1 + length) ^ (place.astype(U64) * U64(0x9E3779B97F4A7C15)))


def _tiles(at: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of the buffer, and the starts of suffixes in each: several short texts, or a tile of a long one."""
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > _TILE:
            for s in range(int(at[i]), int(at[i + 1]) - length + 1, _TILE):
                e = min(s + _TILE, int(at[i + 1]) - length + 1)
                yield s, e + length - 1, np.array([0]), np.array([e - s])
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(at, at[i] + _TILE, "right")) - 1)
            size = np.diff(at[i : j + 1])
            first = at[i:j] - at[i]
            yield int(at[i]), int(at[j]), first, first + np.maximum(size - length + 1, 0)
            i = j


def _all_ranges(data: np.ndarray, at: np.ndarray, length: int, hot: np.ndarray | None = None):
    """Start (in the buffer), count, place, route and context of every range of the texts."""
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, U64, U64)]
    for s, e, first, last in _tiles(at, length):
        r = Ranges(data[s:e], first, last, length, hot)
        for to, x in zip(out, (r.start + s, r.count, r.place, r.anchor, r.context), strict=True):
            to.append(x)
    return [np.concatenate(x) for x in out]


def _digits(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number (a view, of data with at least eight bytes)."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _pack(arrays: list[np.ndarray]) -> tuple[int, bytes]:
    raw = b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return len(raw), _codec().compress(raw, asbytes=True)


def _unpack(size: int, body: bytes, kinds: list) -> list[np.ndarray]:
    raw = _codec().decompress(body, decompressed_size=size, asbytes=True)
    out, at = [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _copies(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of spans of the data, those whose bytes an earlier one (in the given order) has too; equal keys are compared byte by byte."""
    late = np.zeros(len(start), bool)
    by = np.argsort(key, kind="stable")
    k = key[by]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    many = by[~(new & np.append(new[1:], True))] if len(k) else by
    if not len(many):
        return late
    many = many[np.lexsort((*[x[many] for x in order], key[many]))]
    head = np.append(True, key[many][1:] != key[many][:-1])
    first = many[np.flatnonzero(head)[np.cumsum(head) - 1]]
    some, first = many[~head], first[~head]
    same = size[some] == size[first]
    some, first = some[same], first[same]
    view, n = _digits(data), -(-size[some] // 8)
    i = 0
    while i < len(some):
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(n[i : i + (1 << 18)]), 1 << 21, "right")))
        count, s = n[i:j], size[some[i:j]]
        step = 8 * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        step = np.minimum(step, np.repeat(s, count) - 8)
        unlike = view[np.repeat(start[some[i:j]], count) + step] != view[np.repeat(start[first[i:j]], count) + step]
        late[some[i:j]] = np.add.reduceat(unlike, np.cumsum(count) - count) == 0
        i = j
    return late


def _packed(rows: Iterator[pa.RecordBatch], buckets: int, length: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket and batch of texts: the ranges that are new in the batch (kind 0), and spans that are late in it (kind 1)."""
    for batch in E.batches(E.gathered_batches(rows, _BATCH), _BATCH):
        doc, fp = ids(batch.column("doc_id")), batch.column("fp").to_numpy()
        _, one = np.unique(np.stack([doc, fp]), axis=1, return_index=True)  # repeated rows are one text
        batch, doc, fp = batch.take(pa.array(np.sort(one))), doc[np.sort(one)], fp[np.sort(one)]
        data, at = text_buffer(batch.column("text"))
        start, count, place, route, context = _all_ranges(data, at, length, hot)
        if not len(start):
            continue
        owner = np.searchsorted(at, start, "right") - 1
        late = _copies(data, start, count - 1 + length, context, (start, fp[owner], doc[owner]))
        out = []
        o = owner[late]
        to = (E.mix_id(doc[o]) % U64(buckets)).astype(np.int32)
        by = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1])) if len(by) else by
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=False):
            x = by[i:j]
            out.append((int(to[x[0]]), 1, *_pack([doc[o[x]], fp[o[x]], (start[late][x] - at[o[x]]).astype(np.int64), count[late][x].astype(np.uint32)])))
        left = np.flatnonzero(~late)
        to = (route[left] % U64(buckets)).astype(np.int32)
        by = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1]))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=True):
            x = left[by[i:j]]
            size = count[x] - 1 + length
            who, first = np.unique(owner[x], return_index=True)
            from_ = np.repeat(start[x], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            per = np.diff(np.append(first, len(x)))
            base = np.repeat(at[who], per)
            step = np.diff(start[x] - base, prepend=0)
            step[first] = (start[x] - base)[first]  # places in a text as steps, which pack well
            out.append((int(to[by[i]]), 0, *_pack([doc[who], fp[who], per.astype(np.int64), step.astype(np.uint32), count[x].astype(np.uint16), place[x].astype(np.uint16), data[from_]])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary())], names=["bucket", "kind", "size", "body"])


def _pass(group: np.ndarray, digit: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One digit: each group is ordered by it and falls apart into new groups; items alone in theirs leave."""
    if not len(group):
        return group, item
    order = np.lexsort((digit, group))
    group, digit, item = group[order], digit[order], item[order]
    new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))
    stay = ~(new & np.append(new[1:], True))
    return (np.cumsum(new) - 1)[stay], item[stay]


def _beaten(group: np.ndarray, doc: np.ndarray, fp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group all that start later than its first, and those that start with it but for one (the same text twice)."""
    order = np.lexsort((start, fp, doc, group))
    g, d, f, s = group[order], doc[order], fp[order], start[order]
    head = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(g) else order
    late = E.earlier_than(d, f, s, first, True)
    out, twin = np.zeros(len(group), bool), np.zeros(len(group), bool)
    out[order], twin[order] = late, ~late & ~head
    return out, twin


def sort_bucket(doc: np.ndarray, fp: np.ndarray, start: np.ndarray, count: np.ndarray, place: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passes two and three over the ranges of a bucket: range, first late suffix in it and number of late suffixes from there on."""
    run = run_of(length)
    size = count - 1 + length
    at = np.cumsum(size) - size
    view = _digits(data)
    none = np.zeros(0, np.int64)
    if not len(doc):
        return none, none, none
    group, item = np.zeros(len(doc), np.int64), np.arange(len(doc))
    for j in range(0, run, 8):
        group, item = _pass(group, view[at[item] + place[item] + j], item)
    anchor = np.full(len(doc), -1)
    anchor[item] = group
    # ranges that are equal as a whole
    group, item = _pass(group, place[item].astype(np.int64) << 32 | count[item], item)
    j, equal = 0, []
    while len(item):
        group, item = _pass(group, view[at[item] + np.minimum(j, size[item] - 8)], item)
        j += 8
        done = size[item] <= j
        equal.append((group[done], item[done]))
        group, item = group[~done], item[~done]
    late, twin = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    for group, item in equal:
        late[item], twin[item] = _beaten(group, doc[item], fp[item], start[item])
    whole = np.flatnonzero(late)
    out = [(whole, np.zeros(len(whole), np.int64), count[whole].astype(np.int64))]
    # suffixes of the ranges that are left, by anchor
    live = np.flatnonzero((anchor >= 0) & ~late & ~twin)
    live = live[np.argsort(anchor[live], kind="stable")]
    a = anchor[live]
    new = np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)
    live = live[~(new & np.append(new[1:], True))] if len(a) else live
    a, total = anchor[live], np.cumsum(count[live].astype(np.int64))
    i = 0
    while i < len(live):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + _SUFFIXES, "right"))
        j = int(np.searchsorted(a, a[min(max(j, i), len(a) - 1)], "left"))  # whole anchors
        if j <= i:
            j = int(np.searchsorted(a, a[i], "right"))
        if total[-1] <= (total[i - 1] if i else 0) + _SUFFIXES:
            j = len(live)
        part = live[i:j]
        n = count[part].astype(np.int64)
        of = np.repeat(part, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        from_ = at[of] + step
        group, item = _pass(anchor[of], place[of].astype(np.int64) - step, np.arange(len(of)))
        for d in range(0, length, 8):
            group, item = _pass(group, view[from_[item] + min(d, length - 8)], item)
        beaten, _ = _beaten(group, doc[of[item]], fp[of[item]], start[of[item]] + step[item])
        item = np.sort(item[beaten])
        out.append((of[item], step[item], np.ones(len(item), np.int64)))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _late(table: pa.Table, length: int) -> pa.Table:
    """Starts and lengths of the late spans of one bucket, by text."""
    kind, size = table.column("kind").to_pylist(), table.column("size").to_pylist()
    body = table.column("body").to_pylist()
    spans = [[np.zeros(0, np.int64)] for _ in range(4)]
    rows: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.uint16, np.uint16, np.uint8)]
    for k, n, b in zip(kind, size, body, strict=True):
        if k:
            for to, x in zip(spans, _unpack(n, b, [np.int64, np.int64, np.int64, np.uint32]), strict=True):
                to.append(x.astype(np.int64))
            continue
        doc, fp, per, step, count, place, data = _unpack(n, b, [np.int64, np.int64, np.int64, np.uint32, np.uint16, np.uint16, np.uint8])
        start = np.cumsum(step.astype(np.int64))
        first = np.cumsum(per) - per
        start -= np.repeat(start[first] - step[first], per)
        for to, x in zip(rows, (np.repeat(doc, per), np.repeat(fp, per), start, count, place, data), strict=True):
            to.append(x)
    body.clear()
    doc, fp, start, count, place, data = (np.concatenate(x) for x in rows)
    rows.clear()
    which, step, n = sort_bucket(doc, fp, start, count.astype(np.int64), place, data, length)
    for to, x in zip(spans, (doc[which], fp[which], start[which] + step, n), strict=True):
        to.append(x)
    return E.by_text(*(np.concatenate(x) for x in spans), merge=True)


def hot_anchors(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> np.ndarray:
    """Hashes of the anchors whose ranges make up more than `hot` bytes, going by a sample of 32 MB or a thousandth of the texts."""
    share = min(1.0, max(2**-10, (32 << 20) / max(input_size(docs), 1)))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in E.batches(rows, _BATCH):
            data, at = text_buffer(batch.column("text"))
            _, _, _, _, context = found = _all_ranges(data, at, length)
            _, one = np.unique(context, return_index=True)
            route, n = np.unique(found[3][one], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(n)], names=["route", "n"])

    sums = docs.select("text").sample(share, 7).mapInArrow(count, "route long, n long").groupBy("route").agg(F.sum("n").alias("n"))
    least = max(8 if share < 1 else 2, int(hot * share / (1.5 * length)))
    return np.array([r["route"] for r in sums.where(F.col("n") >= least).orderBy(F.col("n").desc()).limit(1 << 16).collect()], np.int64).view(U64)


def late_suffixes(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Starts of the strings that start earlier too, one row per (doc, fp)."""
    if not 16 <= length <= 400:
        raise ValueError("length must be 16 to 400 bytes")
    docs = E.hashed(docs)
    buckets = parts(docs, 8 << 20)
    shared = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, length, hot))
    rows = docs.mapInArrow(lambda batches: _packed(batches, buckets, length, shared.value), _ROWS)
    late = rows.repartitionById(min(buckets, 1 << 14), F.col("bucket")).groupBy("bucket").applyInArrow(lambda t: _late(t, length), E.FOUND)
    out = stored(E.gathered(late), "late")
    del rows, late
    shared.destroy()
    free_shuffles(docs.sparkSession)
    return out


def _kept(data: bytes, late, length: int) -> tuple[bytes, int, int]:
    """Remaining bytes, bytes removed, and maximal removed runs."""
    start, count = E.spans(late)
    if not len(start):
        return data, 0, 0
    gone = covered(len(data), start, count - 1 + length)
    runs = int((gone & ~np.append(False, gone[:-1])).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def digests(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    late = late_suffixes(docs, length, hot)
    rows = E.with_late(E.hashed(docs), late)

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in E.batches(rows):
            size, removed, runs, sha = [], [], [], []
            for text, found in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("late").to_pylist(), strict=True):
                kept, n, r = _kept(text or b"", found, length)
                size.append(len(text or b""))
                sha.append(hashlib.sha256(kept).hexdigest())
                removed.append(n)
                runs.append(r)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(x, pa.int64()) for x in (size, removed, runs)], pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The operator's own output: doc_id, start and end (byte offsets) of every maximal removed run."""
    late = late_suffixes(docs, length, hot)

    def runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for doc, found in zip(batch.column("doc").to_pylist(), batch.column("late").to_pylist(), strict=True):
                start, count = E.spans(found)
                order = np.argsort(start)
                start, end = start[order], (start + count - 1 + length)[order]
                reach = np.maximum.accumulate(end)
                head = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                ends = reach[np.append(head[1:] - 1, len(start) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(head), pa.int64()), pa.array(start[head]), pa.array(ends)], names=["doc_id", "start", "end"])

    return late.select("doc", F.col("late")).mapInArrow(runs, "doc_id long, start long, end long")
