"""Exact Jaccard join on word n-grams (universe partition and pigeonhole).

A document's set holds the hashes of its distinct shingles of `n` words.  Sets
fall into bands by size, such that a set's partners of its size or more are in
its own band or the next.  For each band the universe of hashes is cut into
segments.  Partners differ in at most H elements (from band and threshold), so
if the segments' budgets (0: must be equal; 1: may differ in one element) sum up
to more than H in their capacities (budget + 1), some segment agrees within its
budget.  Each set is indexed by the sum of its hashes in every segment, and,
where the budget is 1, by the same sum with one element deleted.  Per band the
number of segments of each budget, and a reserve of capacity that lets a set
leave empty segments out, are chosen by a cost model from the number of sets
and their size.  Sets with more empty segments than the reserve also index
those.

Passages that very many documents share would fill whole segments and hold
unlike sets together, in clusters that grow with the corpus.  Elements found in
several sets of one group of texts are counted, and the most frequent ones (at
most COMMON) are common.  A segment of common elements only counts against the
reserve as an empty one does and is not indexed; a set for which that is too
much indexes all its segments that are not empty.  Which elements are common
only decides what is compared: any choice gives the same links.

1. Keys meet by hash bucket.  Of all sets with one key only the pairs with the
   smallest go on (a star, never all pairs), and only a spanning forest of each
   bucket.  Equal sets count once throughout.
2. Components of that candidate graph are clusters; no link leaves its cluster.
3. Within a cluster links are verified exactly by intersecting the sets: from
   each set reached, all sets not yet reached are tested through the cluster's
   own inverted lists.  The sets of clusters of more than `bound` elements, held
   together by passages that many documents share, are clustered again by wider
   segments that may differ in one element.  A cluster that is still too large
   is dealt into blocks, and each pair of blocks is verified in a task of its own.
4. Components over the verified links, and the smallest doc_id of each.

Defined cases.  Null or empty text, or no word: empty set, linked with nothing,
its own component.  Fewer than n words: all of them are the one shingle.  Null
doc_id counts as the smallest id, and comes out null.  Repeated rows are linked
(if not empty) and give equal rows.  Extra columns do not matter in `joined`,
and stay in `deduplicated`.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .earliest import batches
from .kernels import LOWER, U64, Words, binary, ids, mix, rolling, spans_hash, prefix, text_buffer
from .runtime import free_shuffles, give_back, parts, stored

N, NUMERATOR, DENOMINATOR = 4, 85, 100
SHARED = 0.005  # how likely an element of one set is in an unlike one
LIGHT = 2  # segments of so many elements or fewer are left out where clusters are narrowed
PAIR_COST = 3000  # of a pair that chance brings together, in keys
BOUND = 2_000_000  # elements of all sets of a cluster that one task verifies
SMALL = 1 << 20  # sets whose place in the narrowed clusters is broadcast, 32 bytes each
AGAIN = 1 << 18  # elements of the sets whose wider segments are indexed at a time
COMMON = 1 << 17  # elements that count as common, at most
OFTEN = 3  # sets of a group of texts that hold an element which is counted
_NULL = -(2**63)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and where each text's start."""
    data, at = text_buffer(column)
    words = Words(LOWER[data], at)
    count = words.counts()
    h = rolling(words.hash, n)
    start = np.flatnonzero(words.window_starts(n))
    owner = words.text_of_word()[start]
    h = h[start]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = []
        for i in short:  # fewer than n words each
            w = words.hash[words.first[i] : words.first[i + 1]]
            whole.append(spans_hash(prefix(w), np.array([0]), np.array([len(w)]))[0])
        h, owner = np.append(h, np.array(whole, U64)), np.append(owner, short)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(at)))


def set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One signed hash for each set; empty sets have 0."""
    total = np.append(U64(0), np.cumsum(mix(h ^ U64(0x51ED270B9F1D6C35))))
    size = np.diff(first)
    out = mix(total[first[1:]] - total[first[:-1]] + size.astype(U64))
    out[size == 0] = 0
    return out.view(np.int64)


@functools.lru_cache(64)
def band_limits(most: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[int, ...]:
    """Least size of each band, up to one that holds `most`."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * denominator // numerator + 1)
    return tuple(out)


def differences(hi: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> int:
    """Most elements in which a set of at most hi elements differs from a linked one that is no smaller."""
    return (denominator - numerator) * hi // numerator


def allocate(hi: int, sets: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[int, int, int]:
    """Segments of budget 0, of budget 1, and reserve: the cheapest by keys written and pairs that chance alone brings together."""
    need = differences(hi, numerator, denominator) + 1
    lo = max(1, hi * numerator // denominator)
    best = None
    for reserve in range(0, 8 + need // 8):
        capacity = need + reserve
        for ones in {0, capacity // 4, capacity // 2, -(-capacity // 2)}:
            zeros = max(0, capacity - 2 * ones)
            m = zeros + ones
            if not m:
                continue
            mean = lo / m
            weak = zeros * math.exp(-mean) + 2 * ones * math.exp(-mean) * (1 + mean)  # capacity that a set must leave out
            over, term = 1.0, math.exp(-weak)
            for k in range(reserve + 1):
                over -= term
                term *= weak / (k + 1)
            over = max(over, 0.0)
            keys = zeros + ones * (1 + hi / m) + over * weak
            chance = sets * over * over * weak / 2  # pairs a set meets through empty segments
            few = sets * math.exp(-2 * mean) * (1 + 2 * mean) * ones / m
            alike = sets * (zeros * SHARED ** max(mean, 1.0) + ones * SHARED ** max(mean - 1, 1.0))  # segments that agree through common passages
            cost = keys + PAIR_COST * (chance + few + alike)
            if best is None or cost < best[0]:
                best = (cost, zeros, ones, reserve)
    return best[1:]


def wide(hi: int, least: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[int, int, int]:
    """Segments of budget 1 only, with a reserve that lets nearly all sets leave out segments of at most `least` elements."""
    need = differences(hi, numerator, denominator) + 1
    lo = max(1, hi * numerator // denominator)
    for reserve in range(0, 4 + need, 2):
        ones = -(-(need + reserve) // 2)
        mean = lo / ones
        light = 2 * ones * sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(least + 1))
        if light + 2.5 * math.sqrt(2 * light) <= reserve:
            break
    return 0, ones, 2 * ones - need


class Plan:
    """Bands and their segments; sets are counted over all documents.

    Keys stand for at least `least` elements, but for sets that would leave out
    more capacity than the reserve: these index all they have.
    """

    def __init__(self, counts: dict[int, int], most: int, numerator: int, denominator: int, least: int = 1, common: np.ndarray | None = None):
        self.limits = band_limits(most, numerator, denominator)
        self.least = least
        self.common = np.zeros(0, U64) if common is None else np.sort(common)
        if least > 1:
            self.segments = [wide(self.limits[b + 1] - 1, least, numerator, denominator) for b in range(len(self.limits) - 1)]
            return
        self.segments = [allocate(self.limits[b + 1] - 1, counts.get(b, 0) + counts.get(b + 1, 0), numerator, denominator) for b in range(len(self.limits) - 1)]


def keys_of(h: np.ndarray, first: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of sets and the set that has each."""
    size = np.diff(first)
    band = np.searchsorted(np.array(plan.limits), size, "right") - 1
    owner = np.repeat(np.arange(len(size)), size)
    rare = np.ones(len(h), bool)
    if len(plan.common):
        rare = plan.common[np.minimum(np.searchsorted(plan.common, h), len(plan.common) - 1)] != h
    keys, sets = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for lower in (0, 1):  # the band's own index, and the one below, where a larger partner is looked for
        of = band - lower
        for b in np.unique(of[(of >= 0) & (size > 0)]).tolist():
            zeros, ones, reserve = plan.segments[b]
            m = zeros + ones
            mine = np.flatnonzero((of == b) & (size > 0))
            pick = np.isin(owner, mine) if len(mine) < len(size) else np.ones(len(h), bool)
            element, local = h[pick], np.searchsorted(mine, owner[pick])
            salt = mix(np.array([b * 2654435761 + 12345], U64))[0]
            segment = ((mix(element ^ salt) >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
            value = mix(element + salt)
            place = local * m + segment
            order = np.argsort(place, kind="stable")
            place, value, own = place[order], value[order], rare[pick][order]
            head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            full = place[head]
            total = np.add.reduceat(value, head)
            count = np.diff(np.append(head, len(place)))
            tag = lambda p: mix((p % m).astype(U64) * U64(0x9E3779B97F4A7C15) + salt)  # noqa: E731, B023
            count_rare = np.add.reduceat(own.astype(np.int64), head)
            # an agreeing segment that is not light in one set has keys of `least` rare elements or more in both
            present, present_rare = np.zeros((2, len(mine) * m), np.int64)
            present[full], present_rare[full] = count, count_rare
            present, present_rare = present.reshape(len(mine), m), present_rare.reshape(len(mine), m)
            lightness = lambda x: (x[:, :zeros] < plan.least).sum(1) + 2 * (x[:, zeros:] <= plan.least).sum(1)  # noqa: E731, B023
            over = lightness(present_rare) > reserve  # all that is not empty is indexed: the set meets every partner of either kind there,
            bare = lightness(present) > reserve  # unless both leave out too much even so: then what is empty is indexed as well
            emit = (count_rare >= plan.least) | over[full // m]
            keys.append(mix(total[emit] ^ tag(full[emit])))
            sets.append(mine[full[emit] // m])
            if ones:  # segments from `zeros` on may differ in one element
                may = (place % m >= zeros) & ((np.repeat(count_rare, count) > plan.least) | over[place // m])
                gone = np.repeat(total, count)[may] - value[may]
                keys.append(mix(gone ^ tag(place[may])))
                sets.append(mine[place[may] // m])
            if bare.any():
                i, s = np.nonzero((present == 0) & bare[:, None])
                keys.append(mix(tag(s)))
                sets.append(mine[i])
    return np.concatenate(keys), np.concatenate(sets)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) of the graph with edges a-b, without the roots."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        left = root[x] != root[y]
        x, y = x[left], y[left]
        if (before == root).all() and not len(x):
            break
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]


def _stars(key: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key's smallest member, and the edges from the others to it."""
    order = np.lexsort((member, key))
    key, member = key[order], member[order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    least = member[head][np.cumsum(new) - 1] if len(key) else member
    other = member != least
    return key[head], member[head], member[other], least[other]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements, starts and ids of the sets that are not empty, equal ones once."""
    sid = set_ids(h, first)
    _, one = np.unique(sid, return_index=True)
    one = one[np.diff(first)[one] > 0]
    pick = np.concatenate([np.zeros(0, U64), *[h[first[i] : first[i + 1]] for i in one]])
    return pick, np.append(0, np.cumsum(np.diff(first)[one])), sid[one]


def common(docs: DataFrame, n: int) -> np.ndarray:
    """The elements that the most sets hold, by counts over all texts of those held by OFTEN sets or more of a group of texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            element, held = np.unique(_distinct(*shingle_sets(batch.column("text"), n))[0], return_counts=True)
            often = held >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(element[often].view(np.int64)), pa.array(held[often])], names=["element", "held"])

    counted = docs.select("text").mapInArrow(run, "element long, held long").groupBy("element").agg(F.sum("held").alias("held"))
    top = counted.orderBy(F.desc("held"), "element").limit(COMMON).select("element").toArrow()
    return top.column("element").to_numpy().view(U64)


_KEYS = "bucket int, kind int, key binary, member binary"


def _keyed(rows: Iterator[pa.RecordBatch], n: int, plan: Plan, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed keys by bucket (kind 0: key, smallest set here) and the stars inside this group of texts (kind 1: edges)."""
    for batch in batches(rows):
        h, first, sid = _distinct(*shingle_sets(batch.column("text"), n))
        if len(sid):
            yield from _packed_keys(h, first, sid, plan, buckets)


def _packed_keys(h: np.ndarray, first: np.ndarray, sid: np.ndarray, plan: Plan, buckets: int) -> Iterator[pa.RecordBatch]:
    key, owner = keys_of(h, first, plan)
    key, member, a, b = _stars(key, sid[owner])
    a, b = forest(a, b)
    for kind, k, m, of in ((0, key, member, key % U64(buckets)), (1, a.view(U64), b, mix(a.view(U64)) % U64(buckets))):
        of = of.astype(np.int32)
        order = np.argsort(of, kind="stable")
        of, k, m = of[order], k[order], m[order]
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        cuts = np.append(cut, len(of))
        packed = binary(k, cuts) if kind else binary(k.view(np.uint8).reshape(-1, 8)[:, 2:].ravel(), 6 * cuts)  # of a key the upper 48 bits; its bucket has the lowest
        yield pa.RecordBatch.from_arrays([pa.array(of[cut], pa.int32()), pa.array(np.full(len(cut), kind, np.int32)), packed, binary(m, cuts)], names=["bucket", "kind", "key", "member"])


def _edges(table: pa.Table) -> pa.Table:
    kind = table.column("kind").to_pylist()
    key, member = table.column("key").to_pylist(), table.column("member").to_pylist()
    take = lambda which, x, t: np.concatenate([np.zeros(0, t), *[np.frombuffer(v, t) for v, k in zip(x, kind, strict=True) if k == which]])
    short = take(0, key, np.uint8).reshape(-1, 6)  # keys that agree by chance only bring sets together that are compared exactly later
    whole = np.zeros((len(short), 8), np.uint8)
    whole[:, 2:] = short
    _, _, a, b = _stars(whole.view(U64).ravel(), take(0, member, np.int64))
    a, b = np.concatenate([a, take(1, key, np.int64)]), np.concatenate([b, take(1, member, np.int64)])
    a, b = forest(a, b)
    return pa.table({"a": a, "b": b})


def verify(sid: np.ndarray, sets: list[np.ndarray], numerator: int, denominator: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set, smallest set of its component) for the exact links among some sets; side: only links between two sides count."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, term = np.unique(flat, return_inverse=True)
    at = np.append(0, np.cumsum(size))
    holder = np.repeat(np.arange(n), size)
    order = np.argsort(term, kind="stable")
    lists, list_at = holder[order], np.append(0, np.cumsum(np.bincount(term)))
    unseen = np.ones(n, bool)
    length = np.diff(list_at).copy()  # lists are shortened as sets are reached
    a, b = [], []
    reached = 0
    for seed in range(n):
        if not unseen[seed]:
            continue
        unseen[seed] = False
        stack = [seed]
        while stack:
            i = stack.pop()
            terms = term[at[i] : at[i + 1]]
            terms = terms[length[terms] > 0]
            if not len(terms):
                continue
            count = length[terms]
            where = np.repeat(list_at[terms], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found = lists[where]
            found = found[unseen[found]]
            if side is not None:
                found = found[side[found] != side[i]]
            if not len(found):
                continue
            inter = np.bincount(found, minlength=n)
            hit = np.flatnonzero(inter)
            same = inter[hit]
            hit = hit[denominator * same >= numerator * (size[hit] + size[i] - same)]
            if len(hit):
                unseen[hit] = False
                reached += len(hit)
                stack.extend(hit.tolist())
                a.append(hit)
                b.append(np.full(len(hit), seed))
                if reached * 8 > n:  # drop the reached from the lists
                    keep = unseen[lists]
                    owner_term = np.repeat(np.arange(len(length)), np.diff(list_at))
                    lists, length = lists[keep], np.bincount(owner_term[keep], minlength=len(length))
                    list_at = np.append(0, np.cumsum(length))
                    reached = 0
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(sid[np.concatenate(a)], sid[np.concatenate(b)])


def _links(table: pa.Table, numerator: int, denominator: int) -> pa.Table:
    sid = table.column("sid").to_numpy()
    _, one = np.unique(sid, return_index=True)
    raw = table.column("elements")
    sets = [np.frombuffer(raw[int(i)].as_py(), U64) for i in one]
    part, other = table.column("part")[0].as_py(), table.column("other")[0].as_py()
    side = None if part == other else table.column("block").to_numpy()[one]
    a, b = verify(sid[one], sets, numerator, denominator, side) if len(one) > 1 else (sid[:0], sid[:0])
    return pa.table({"a": a, "b": b})


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc (id, null as the smallest), fp (a fingerprint of the text), sid and n_shingles of every row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            h, first = shingle_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([pa.array(ids(batch.column("doc_id"))), batch.column("fp"), pa.array(set_ids(h, first)), pa.array(np.diff(first))], names=["doc", "fp", "sid", "n_shingles"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("fp")).mapInArrow(run, "doc long, fp long, sid long, n_shingles long")


def links(docs: DataFrame, sets: DataFrame, n: int, numerator: int, denominator: int, bound: int) -> DataFrame:
    """(node, root) over set ids: the components of the exact links."""
    limits = band_limits(1 << 40, numerator, denominator)
    band = F.expr("case " + " ".join(f"when n_shingles < {x} then {i - 1}" for i, x in enumerate(limits) if i) + " end")
    stats = sets.where("n_shingles > 0").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max("n_shingles").alias("most")).collect()  # a row for each band
    if not stats:
        return docs.sparkSession.createDataFrame([], "node long, root long")
    plan = Plan({r["band"]: r["n"] for r in stats}, max(r["most"] for r in stats), numerator, denominator, common=common(docs, n))
    buckets = parts(docs, 8 << 20)
    keyed = docs.select("text").mapInArrow(lambda rows: _keyed(rows, n, plan, buckets), _KEYS)
    clusters = stored(components(keyed.repartitionById(min(buckets, 1 << 14), F.col("bucket")).groupBy("bucket").applyInArrow(_edges, "a long, b long")), "clusters")
    del keyed
    free_shuffles(docs.sparkSession)  # the keys, the largest of all
    members = clusters.select("node", "root").unionAll(clusters.select(F.col("root").alias("node"), "root").distinct())

    sizes = sets.groupBy("sid").agg(F.max("n_shingles").alias("n"), F.min("doc").alias("doc"))
    load = members.join(sizes, members["node"] == sizes["sid"])
    total = load.groupBy("root").agg(F.sum("n").alias("elements"))
    load = load.join(total, "root").select("root", "node", "doc", F.greatest(F.lit(1), F.ceil(2 * F.col("elements") / bound)).cast("long").alias("blocks"))
    load = load.withColumn("blocks", F.when(F.col("blocks") <= 2, F.lit(1)).otherwise(F.col("blocks")))
    load = load.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    # the texts of one document per set, and of clustered sets only, give the elements
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), "text").join(load, "doc")

    def elements(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            h, first = shingle_sets(batch.column("text"), n)
            sid = set_ids(h, first)
            own = np.flatnonzero(sid == batch.column("node").to_numpy())  # rows of one doc_id with other texts stay out
            raw = binary(h, first).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([batch.column("root").take(pa.array(own)), pa.array(sid[own]), batch.column("block").take(pa.array(own)), batch.column("blocks").take(pa.array(own)), raw], names=["root", "sid", "block", "blocks", "elements"])

    found = stored(texts.mapInArrow(elements, "root long, sid long, block long, blocks long, elements binary"), "elements")
    del texts, load, total, sizes
    free_shuffles(docs.sparkSession)  # the texts
    # clusters that one task can hold are verified; the sets of larger ones are clustered again by wider segments first
    small = found.where("blocks = 1")
    large = found.where("blocks > 1")
    if not large.isEmpty():
        again = Plan({}, max(r["most"] for r in stats), numerator, denominator, least=LIGHT)

        def keyed_again(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                sid, at = batch.column("sid").to_numpy(), np.append(0, np.cumsum([len(x) // 8 for x in batch.column("elements").to_pylist()]))
                i = 0
                while i < len(sid):
                    j = max(i + 1, int(np.searchsorted(at, at[i] + AGAIN, "right")) - 1)
                    raw = np.frombuffer(b"".join(batch.column("elements").slice(i, j - i).to_pylist()), U64)
                    yield from _packed_keys(raw, at[i : j + 1] - at[i], sid[i:j], again, buckets)
                    i = j
            give_back()

        edges = large.select("sid", "elements").mapInArrow(keyed_again, _KEYS).repartitionById(min(buckets, 1 << 14), F.col("bucket")).groupBy("bucket").applyInArrow(_edges, "a long, b long")
        narrow = stored(components(edges), "clusters")
        del edges
        free_shuffles(docs.sparkSession)
        members = narrow.select("node", "root").unionAll(narrow.select(F.col("root").alias("node"), "root").distinct())
        # who goes where is worked out without the elements, which then move once to meet it
        sizes = large.select("sid", (F.octet_length("elements") / 8).alias("n")).join(members, F.col("sid") == members["node"]).select("sid", members["root"].alias("root"), "n")
        total = sizes.groupBy("root").agg(F.sum("n").alias("count"))
        blocks = F.when(F.col("count") <= bound, F.lit(1)).otherwise(F.ceil(2 * F.col("count") / bound)).cast("long")
        dealt = sizes.join(total, "root").select(F.col("sid").alias("_sid"), "root", F.pmod(F.xxhash64("sid"), blocks).alias("block"), blocks.alias("blocks"))
        dealt = stored(dealt, "dealt")
        dealt = F.broadcast(dealt) if dealt.count() <= SMALL else dealt
        large = large.select("sid", "elements").join(dealt, F.col("sid") == F.col("_sid")).select(*found.columns)
        found = small.unionByName(large)
    pairs = found.withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("root", "sid", "block", F.least("block", "with").alias("part"), F.greatest("block", "with").alias("other"), "elements")
    verified = pairs.groupBy("root", "part", "other").applyInArrow(lambda t: _links(t, numerator, denominator), "a long, b long")
    return components(verified)


def _grouped(docs: DataFrame, n: int, numerator: int, denominator: int, bound: int) -> DataFrame:
    """doc, fp, sid, n_shingles, and root and component (its smallest doc; both null without words) of every row."""
    sets = stored(_sets(docs, n), "sets")
    found = stored(links(docs, sets, n, numerator, denominator, bound), "links")
    least = sets.where("n_shingles > 0").groupBy("sid").agg(F.min("doc").alias("doc"))
    rooted = least.join(found, least["sid"] == found["node"], "left").select("sid", "doc", F.coalesce("root", "sid").alias("root"))
    first = rooted.groupBy("root").agg(F.min("doc").alias("component"))
    component = rooted.join(first, "root").select(F.col("sid").alias("s"), "root", "component")
    return sets.join(component, sets["sid"] == F.col("s"), "left").drop("s")


def joined(docs: DataFrame, n: int = N, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, bound: int = BOUND) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    out = _grouped(docs, n, numerator, denominator, bound)
    real = lambda c: F.when(c != _NULL, c)
    return out.select(real(F.col("doc")).alias("doc_id"), "n_shingles", real(F.coalesce("component", "doc")).alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 5, numerator: int = 80, denominator: int = 100, bound: int = BOUND) -> DataFrame:
    """One document of each component, the one with the smallest id, and all without words; all columns.

    Of several texts with that id (or null) the one with the least fingerprint is kept, and of equal rows one.
    """
    first = _grouped(docs, n, numerator, denominator, bound).where("component is null or doc = component")
    first = first.groupBy("root", "doc", F.when(F.col("root").isNull(), F.col("fp"))).agg(F.min("fp").alias("_fp")).select(F.col("doc").alias("_doc"), "_fp").distinct()
    names = docs.columns
    # one shuffle of the documents: equal rows meet where the join puts them
    rows = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)], F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("_doc"), F.xxhash64("text").alias("_fp"))
    kept = rows.join(first, ["_doc", "_fp"], "left_semi").dropDuplicates(["_doc", "_fp"])
    return kept.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])
