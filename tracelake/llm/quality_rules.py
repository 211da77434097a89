"""Quality rules: plain limits, then robust multivariate outliers.

Each text gives counts (words, characters, symbols, repeated lines and windows,
capitals, punctuation, lines).  Texts that pass the plain limits are turned into
vectors of D transformed statistics, and for every language and source the
minimum-covariance-determinant estimate of centre and scatter is found: the
`share` of rows whose covariance has the least determinant, made consistent and
reweighted once.  Rows whose squared Mahalanobis distance is beyond the
chi-squared quantile `tail` are rejected.

Shares are taken with PRIOR words of an ordinary text added, so that the chance
variation of short texts does not widen the scatter.  Only the share of symbols,
which is zero in most texts, has a least spread (FLOOR); the spread of all other
statistics is what the estimate finds.

The estimate covers all rows in bounded memory.  Rows are summed up in cells of
about a sixth of a usual standard deviation (count, sums and cross products of
whole numbers: exact, and the same in any order of arrival), combined before the
shuffle, and the concentration steps order cells.  Most cells of a group of some
ten thousand rows hold one row.  A group with more than CELLS cells is summed up
again in cells twice, four times, ... as wide, until it has no more than that.

A group in which fewer than `least` rows pass the plain limits (five for each
dimension) takes the estimate of its language, and if that has fewer too, the
one of all rows.

Defined cases.  Null or empty text: no words, rejected by the plain limits.
Null language or source: a group of their own.  Empty table: no rows.  Repeated
rows count as often as they occur and give equal results.  Extra columns do not
matter in `judged`, and stay in `passing`.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .earliest import batches
from .kernels import U64, WHITE, Words, covered, hash_spans, mix, rolling, text_buffer
from .runtime import stored

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SHARE, TAIL = 0.75, 0.999
D = 6
LEAST = 5 * D
PRIOR = 200  # words of an ordinary text: five characters each, one line in ten, 16 capitals and 28 marks in a thousand characters
#: Whole-number units of each statistic (some 200 in a usual standard deviation), their origin, and the least standard deviations.
UNITS = np.array([256, 8192, 512, 2048, 2048, 256])
ORIGIN = np.array([5.5, 1.6, 2.5, 1.3, 1.7, 0.0])
FLOOR = np.array([0.0, 0.0, 0.0, 0.0, 0.0, 0.5])
CELL, CELLS, COARSER = 5, 1 << 15, (0, 1, 2, 3, 4, 6, 8)  # bits of a cell's width; most cells of a group; bits added
GROUPS = 20_000  # languages and sources whose estimates are broadcast
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines")

_SYMBOL, _CAPITAL, _MARK = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(b"#[*$%&|<>]".replace(b"[", b"").replace(b"]", b""))] = True
_CAPITAL[65:91] = True
_MARK[list(b"!\"'(),-./:;?@[\\]^_`{}~+=")] = True


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text."""
    data, at = text_buffer(column)
    words = Words(data, at)
    n = words.counts()

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask, dtype=np.int64))
        return total[at[1:]] - total[at[:-1]]

    # words in windows found twice or more in their text
    texts = words.text_of_word()
    ok = words.window_starts(WINDOW)
    key = np.zeros(len(ok), U64)
    h = rolling(words.hash, WINDOW)
    key[: len(h)] = h
    at_word = np.flatnonzero(ok)
    key = mix(key[at_word] ^ mix(texts[at_word].astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = at_word[order[np.append(False, same) | np.append(same, False)]] if len(order) else at_word
    repeated = covered(len(ok), again, WINDOW)

    # lines with a word, equal to an earlier one of their text
    edge = np.union1d(np.flatnonzero(data == 10) + 1, at)
    start, end = edge[:-1], edge[1:]
    line_end = end - (data[end - 1] == 10) if len(end) else end
    solid = np.append(0, np.cumsum(~WHITE[data]))
    full = solid[line_end] > solid[start] if len(start) else np.zeros(0, bool)
    start, line_end = start[full], line_end[full]
    of = np.searchsorted(at, start, "right") - 1
    line = mix(hash_spans(data, start, line_end) ^ mix(of.astype(U64) + U64(1)))
    _, first = np.unique(line, return_index=True)
    lines = np.bincount(of, minlength=len(n)) - np.bincount(of[first], minlength=len(n)) if len(of) else np.zeros(len(n), np.int64)

    out = {
        "n_words": n,
        "word_chars": per_text(~WHITE[data] & (data & 0xC0 != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(texts[repeated], minlength=len(n)) if len(n) else n,
        "n_capitals": per_text(_CAPITAL[data]),
        "n_marks": per_text(_MARK[data]),
        "n_lines": np.bincount(of, minlength=len(n)) if len(of) else np.zeros(len(n), np.int64),
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and the counts of every row."""
    names, kinds = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4 << 20, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for v in counts(batch.column(text)).values()]], names=[*names, *COUNTS])

    return docs.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics of a row with words, in whole units."""
    c = {name: F.col(name) for name in COUNTS}
    n, chars = c["n_words"] + PRIOR, c["word_chars"] + 5 * PRIOR
    x = [
        F.log(F.greatest(c["n_words"], F.lit(1)) + 50.0),
        F.log(chars / n),
        F.log((c["n_words"] + 20.0) / (c["n_lines"] + 2.0)),
        10 * F.sqrt((c["n_capitals"] + 0.016 * 5 * PRIOR) / chars),
        10 * F.sqrt((c["n_marks"] + 0.028 * 5 * PRIOR) / chars),
        F.log1p(100 * c["n_symbols"] / (c["n_words"] + 50.0)),
    ]
    return [F.round((v - float(o)) * int(u)).cast("long") for v, o, u in zip(x, ORIGIN, UNITS, strict=True)]


def chi2(p: float, d: int = D) -> float:
    """Quantile of the chi-squared distribution (Wilson and Hilferty)."""
    z = NormalDist().inv_cdf(p)
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


class Cells:
    """Weighted lattice cells with exact first and second moments."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, cross: np.ndarray):
        self.n, self.sums, self.cross = n, sums, cross
        self.mean = sums / n[:, None]

    def moments(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[which].sum()
        mean = self.sums[which].sum(0) / n
        cov = self.cross[which].sum(0) / n - np.outer(mean, mean)
        return mean, cov + np.diag(np.maximum((FLOOR * UNITS) ** 2 - np.diag(cov), 0)) + 0.1 * np.eye(D)  # 0.1: what rounding to units adds

    def distance(self, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        x = self.mean - mean
        return np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov), x)

    def quantile(self, value: np.ndarray, share: float) -> float:
        order = np.argsort(value, kind="stable")
        total = np.cumsum(self.n[order])
        return float(value[order][np.searchsorted(total, share * total[-1])])


def mcd(cells: Cells, share: float = SHARE, starts: int = 12, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter: least determinant over concentration steps from several starts, made consistent and reweighted once."""
    rng = np.random.default_rng(seed)
    need = share * cells.n.sum()

    def nearest(mean, cov):
        order = np.argsort(cells.distance(mean, cov), kind="stable")
        return order[: int(np.searchsorted(np.cumsum(cells.n[order]), need)) + 1]

    centre = np.array([cells.quantile(cells.mean[:, j], 0.5) for j in range(D)])
    spread = np.array([cells.quantile(np.abs(cells.mean[:, j] - centre[j]), 0.5) for j in range(D)]) * 1.4826
    begin = [(centre, np.diag(np.maximum(spread, np.maximum(FLOOR * UNITS, 1)) ** 2))]
    for _ in range(starts - 1):
        some = rng.choice(len(cells.n), size=min(len(cells.n), D + 1), replace=False, p=cells.n / cells.n.sum()) if len(cells.n) > D else np.arange(len(cells.n))
        begin.append(cells.moments(some))
    best = None
    for mean, cov in begin:
        last = np.inf
        for _ in range(50):
            mean, cov = cells.moments(nearest(mean, cov))
            det = np.linalg.slogdet(cov)[1]
            if det >= last - 1e-9:
                break
            last = det
        if best is None or det < best[0]:
            best = (det, mean, cov)
    _, mean, cov = best
    cov = cov * max(cells.quantile(cells.distance(mean, cov), 0.5) / chi2(0.5), 1.0)
    mean, cov = cells.moments(np.flatnonzero(cells.distance(mean, cov) <= chi2(0.975)))
    return mean, cov * max(cells.quantile(cells.distance(mean, cov), 0.5) / chi2(0.5), 1.0)


_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_ESTIMATE = "level int, lang string, source string, n long, mean array<double>, inverse array<double>"


def _estimate(table: pa.Table) -> pa.Table:
    col = lambda c: table.column(c).to_numpy()
    sums = np.stack([col(f"s{i}") for i in range(D)], 1)
    cross = np.empty((len(table), D, D))
    for i, j in _PAIRS:
        cross[:, i, j] = cross[:, j, i] = col(f"p{i}_{j}")
    order = np.lexsort(sums.T)  # one order, whatever the order of arrival
    cells = Cells(col("n").astype(float)[order], sums[order], cross[order])
    mean, cov = mcd(cells)
    return pa.table(
        {
            "level": pa.array([table.column("level")[0].as_py()], pa.int32()),
            "lang": pa.array([table.column("lang")[0].as_py()], pa.string()),
            "source": pa.array([table.column("source")[0].as_py()], pa.string()),
            "n": pa.array([int(cells.n.sum())], pa.int64()),
            "mean": pa.array([mean.tolist()], pa.list_(pa.float64())),
            "inverse": pa.array([np.linalg.inv(cov).ravel().tolist()], pa.list_(pa.float64())),
        }
    )


def estimates(vectors: DataFrame, least: int = LEAST, cells: int = CELLS) -> DataFrame:
    """Centre and inverse scatter for every (lang, source), and where one has too few rows for its lang and for all rows; vectors: lang, source, x0, x1, ..."""
    x, p = [f"x{i}" for i in range(D)], [f"p{i}_{j}" for i, j in _PAIRS]
    key = ["level", "lang", "source"]
    lattice = [F.shiftright(c, CELL).alias(f"c{i}") for i, c in enumerate(x)]
    fine = vectors.groupBy("lang", "source", *lattice).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in _PAIRS])
    fine = stored(fine, "cells")
    rows = fine.withColumn("level", F.lit(0))
    none = F.lit(None).cast("string")
    sizes = fine.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    few = sizes.where(F.col("n") < least).select(F.col("lang").alias("l")).distinct()
    if not few.isEmpty():
        rows = rows.unionByName(fine.join(few, F.col("lang").eqNullSafe(F.col("l")), "left_semi").withColumns({"source": none, "level": F.lit(1)}))
        if not sizes.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") < least).isEmpty():
            rows = rows.unionByName(fine.withColumns({"lang": none, "source": none, "level": F.lit(2)}))
    at = lambda k: [F.shiftright(f"c{i}", k) for i in range(D)]
    counted = rows.groupBy(*key).agg(*[F.approx_count_distinct(F.xxhash64(*at(k))).alias(f"k{k}") for k in COARSER])
    width = F.coalesce(*[F.when(F.col(f"k{k}") <= cells, F.lit(k)) for k in COARSER], F.lit(COARSER[-1]))
    counted = counted.select(*[F.col(c).alias(f"g_{c}") for c in key], width.alias("k"))
    rows = rows.join(counted, (F.col("level") == F.col("g_level")) & F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")))
    wide = rows.groupBy(*key, *[F.expr(f"shiftright(c{i}, k)").alias(f"c{i}") for i in range(D)]).agg(*[F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(D)), *p)])
    return wide.groupBy(*key).applyInArrow(_estimate, _ESTIMATE)


def _scored(rows: DataFrame, tail: float, least: int) -> DataFrame:
    """Stored rows with counts, _lang and _source; base_failed, distance2 and kept beside them."""
    rows = rows.withColumn("base_failed", base_failed())
    vectors = rows.where(~F.col("base_failed")).select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), *[v.alias(f"x{i}") for i, v in enumerate(vector())])
    found = stored(estimates(vectors, least), "estimates")
    groups = found.where("level = 0").select("lang", "source", "n", F.struct("mean", "inverse").alias("e0"), F.lit(2).alias("two"))
    by_lang = found.where("level = 1").select(F.col("lang").alias("l1"), F.col("n").alias("n1"), F.struct("mean", "inverse").alias("e1"))
    whole = found.where("level = 2").select(F.col("level").alias("two"), F.struct("mean", "inverse").alias("e2"))
    groups = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("l1")), "left").join(F.broadcast(whole), "two", "left")  # one row at most
    groups = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.when(F.col("n") >= least, F.col("e0")).when(F.col("n1") >= least, F.col("e1")).otherwise(F.col("e2")).alias("e"))
    groups = stored(groups, "groups")
    groups = F.broadcast(groups) if groups.count() <= GROUPS else groups  # half a kilobyte each
    joined = rows.join(groups, F.col("_lang").eqNullSafe(F.col("g_lang")) & F.col("_source").eqNullSafe(F.col("g_source")), "left")
    x = [v - F.col("e.mean")[i] for i, v in enumerate(vector())]
    d2 = sum((F.col("e.inverse")[i * D + j] * x[i] * x[j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))
    return joined.withColumn("distance2", F.when(~F.col("base_failed"), d2)).withColumn("kept", ~F.col("base_failed") & (F.col("distance2") <= chi2(tail)))


def _group() -> list[Column]:
    return [F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source")]


def judged(docs: DataFrame, tail: float = TAIL, least: int = LEAST) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the squared distance of every row."""
    rows = measured(docs.select("doc_id", "text", *_group())).drop("text")
    return _scored(stored(rows, "counts"), tail, least).select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:], "distance2")


def passing(docs: DataFrame, tail: float = TAIL, least: int = LEAST) -> DataFrame:
    """The documents that are kept, with all their columns; every text is measured once, and its row stored with the counts."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)], *_group())
    rows = stored(measured(rows, f"d{names.index('text')}"), "counts")
    return _scored(rows, tail, least).where("kept").select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])
