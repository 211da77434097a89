"""Quality classifier from weak labels.

Heuristic labellers vote low (-1), high (+1) or nothing (0) on every document.
Expectation-maximisation over all documents' vote patterns estimates how often
each labeller votes what on good and on poor documents, without any true label,
and gives each pattern a posterior.  The posteriors train a linear scorer on
hashed words and a few statistics, by logistic regression on a bounded sample
(at most `sample` documents, those with the smallest hash of id and text, and of
these the first that have SAMPLE_WORDS hashed words together: 32 MB); it then
scores every whole text.

Patterns are counted over all documents; there are at most 3 ** labellers of
them, so EM works on a bounded table.  A document of any size is hashed in
slices.

Defined cases.  Null or empty text: no words, every statistic 0, never kept.
Null ids stay.  Repeated rows count as often as they occur.  Empty table: no
rows.  If all votes agree in nothing, posteriors are the prior.  Extra columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .earliest import batches
from .kernels import U64, Words, binary, text_buffer
from .quality_rules import COUNTS, counts
from .runtime import stored

SAMPLE, SAMPLE_WORDS, BITS = 8_000, 4_000_000, 16
STATISTICS = 8


def votes() -> list[Column]:
    """The labellers, over the columns of COUNTS."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    repeat, capitals, marks, symbols, mean, again = F.col("n_repeat_words") / n, F.col("n_capitals") / chars, F.col("n_marks") / chars, F.col("n_symbols") / n, chars / n, F.col("n_dup_lines")
    vote = lambda low, high: F.when(low, -1).when(high, 1).otherwise(0)
    # they overlap: what is wrong with a document is seen by several
    return [
        vote(F.col("n_words") < 10, F.col("n_words") >= 50),
        vote((repeat > 0.2) | (again > 2), (repeat < 0.02) & (again == 0)),
        vote(symbols > 0.1, symbols < 0.01),
        vote((capitals > 0.3) | (marks > 0.12) | (symbols > 0.1), (capitals < 0.08) & (marks < 0.06) & (symbols < 0.01)),
        vote((repeat > 0.2) | (symbols > 0.1) | (capitals > 0.3), (repeat < 0.05) & (symbols < 0.01) & (capitals < 0.1)),
        vote((mean < 2.5) | (mean > 11), (mean > 3.5) & (mean < 9)),
        vote((marks > 0.12) | (symbols > 0.1) | (again > 2) | (repeat > 0.2), (marks < 0.06) & (symbols < 0.01) & (repeat < 0.02)),
    ]


def em(patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of 'good' for each pattern, share of good documents, and P(vote | class) of each labeller.

    Starts from the majority of votes; labellers are independent given the class.
    """
    k = patterns.shape[1]
    score = patterns.sum(1)
    post = np.where(score > 0, 0.9, np.where(score < 0, 0.1, 0.5))
    hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    prior, table = 0.5, np.full((2, k, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        table = np.einsum("cp,pkv->ckv", weight, hot) + 0.5
        table /= table.sum(2, keepdims=True)
        log = np.einsum("pkv,ckv->cp", hot, np.log(table)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post, float(prior), table


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """Dense features of each text, about the size of one."""
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack([np.ones(len(n)), np.log1p(c["n_words"]) / 8, chars / n / 8, np.minimum(c["n_repeat_words"] / n, 1), np.minimum(4 * c["n_capitals"] / chars, 2), np.minimum(8 * c["n_marks"] / chars, 2), np.minimum(8 * c["n_symbols"] / n, 2), np.minimum(c["n_dup_lines"] / 5, 2)], 1)


def _slots(words: Words, bits: int) -> np.ndarray:
    return (words.hash >> U64(64 - bits)).astype(np.int64)


def train(slots: list[np.ndarray], shares: list[np.ndarray], dense: np.ndarray, label: np.ndarray, bits: int, rounds: int = 150, rate: float = 2.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the hashed words (first) and the statistics (last); label: probabilities."""
    m = 1 << bits
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    col = np.concatenate(slots) if slots else np.zeros(0, np.int64)
    val = np.concatenate(shares) if shares else np.zeros(0)
    w = np.zeros(m + dense.shape[1])
    speed = np.zeros_like(w)
    for _ in range(rounds):
        z = np.bincount(row, val * w[col], minlength=len(slots)) + dense @ w[m:]
        g = (1 / (1 + np.exp(-z)) - label) / max(len(label), 1)
        grad = np.concatenate([np.bincount(col, val * g[row], minlength=m), dense.T @ g]) + ridge * w
        speed = 0.9 * speed - rate * grad
        w = w + speed
    return w


def weak_labels(docs: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """doc_id, the counts and the posterior of every row, and the model's parameters."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(v) for v in counts(batch.column("text")).values()], names=["doc_id", *COUNTS])

    rows = docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    given = votes()
    pattern = sum((F.lit(3**i) * (v + 1) for i, v in enumerate(given)), F.lit(0)).cast("int")
    rows = stored(rows.withColumn("pattern", pattern), "votes")
    seen = rows.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # at most 3 ** labellers
    code = np.array([r["pattern"] for r in seen], np.int64)
    table = (code[:, None] // 3 ** np.arange(len(given))) % 3 - 1
    post, prior, likelihood = em(table, np.array([r["n"] for r in seen], float)) if len(seen) else (np.zeros(0), 0.5, None)
    values = F.create_map(*[F.lit(x) for r, p in zip(seen, post, strict=True) for x in (r["pattern"], float(p))]) if len(seen) else F.create_map().cast("map<int,double>")
    return rows.withColumn("posterior", values[F.col("pattern")]), {"prior": prior, "likelihood": likelihood}


def scored(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, posterior, score and kept (score of at least one half) of every row."""
    labelled, _ = weak_labels(docs)
    docs = docs.select("doc_id", "text")
    hashed = docs.where("text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).collect()[0][0]  # only hashes are sorted, then texts up to the last one are taken
    chosen = hashed.where(F.col("h") <= (last if last is not None else -(2**63))).dropDuplicates(["h"])

    def features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4 << 20):
            words = Words(*text_buffer(batch.column("text")))
            slot = _slots(words, bits) + (words.text_of_word() << bits)
            slot, n = np.unique(slot, return_counts=True)
            cut = np.searchsorted(slot, np.arange(len(batch) + 1) << bits)
            c = counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("h"), binary((slot & ((1 << bits) - 1)).astype(np.int32), cut), binary(n.astype(np.int32), cut), *[pa.array(c[k]) for k in COUNTS]], names=["h", "slots", "times", *COUNTS])

    pattern = sum((F.lit(3**i) * (v + 1) for i, v in enumerate(votes())), F.lit(0)).cast("int")
    found = stored(chosen.mapInArrow(features, "h long, slots binary, times binary, " + ", ".join(f"{c} long" for c in COUNTS)).withColumn("pattern", pattern), "features")
    sizes = found.select("h", (F.octet_length("slots") / 4).cast("long").alias("n")).orderBy("h").collect()  # at most `sample`
    most = np.searchsorted(np.cumsum([r["n"] for r in sizes]), SAMPLE_WORDS, "right")
    rows = found.where(F.col("h") <= sizes[min(int(most), len(sizes) - 1)]["h"]).orderBy("h").collect() if sizes else []
    rows = rows[: max(1, int(most))]
    known = {r["pattern"]: r["posterior"] for r in labelled.select("pattern", "posterior").distinct().collect()}
    slots = [np.frombuffer(r["slots"], np.int32).astype(np.int64) for r in rows]
    shares = [np.frombuffer(r["times"], np.int32) / max(r["n_words"], 1) for r in rows]
    dense = statistics({c: np.array([r[c] for r in rows], np.int64) for c in COUNTS})
    weights = train(slots, shares, dense, np.array([known[r["pattern"]] for r in rows], float), bits)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches(rows, 4 << 20):
            words = Words(*text_buffer(batch.column("text")))
            c = counts(batch.column("text"))
            n = c["n_words"]
            z = np.bincount(words.text_of_word(), w[_slots(words, bits)], minlength=len(n)) / np.maximum(n, 1) + statistics(c) @ w[1 << bits :]
            p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c[k]) for k in COUNTS], pa.array(p), pa.array((p >= 0.5) & (n > 0))], names=["doc_id", *COUNTS, "score", "kept"])

    out = docs.mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double, kept boolean").withColumn("pattern", pattern)
    values = F.create_map(*[F.lit(x) for k, p in sorted(known.items()) for x in (k, float(p))]) if known else F.create_map().cast("map<int,double>")
    return out.select("doc_id", "n_words", values[F.col("pattern")].alias("posterior"), "score", "kept")
