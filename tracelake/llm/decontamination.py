"""Benchmark decontamination: test n-grams against every window of every text, in SQL functions only.

Texts are lower-cased (A-Z only) and cut into words of letters and digits
(anything outside ASCII counts as a letter).  An item's windows are its runs of
`n` words, or all its words if it has fewer.  Window hashes of a whole text are
built by doubling (1, 2, 4, 8, ... words) on arrays, so a window costs a few
array steps and no row.

1. Window hashes of all texts meet the benchmark's in a join on the hash alone.
   Only hashes and places go through it, never words.  A count of the benchmark's
   windows shows whether their hashes are at most BROADCAST; then they are a
   broadcast hash set and no text window is shuffled.  With more, Spark joins by
   a shuffle of the same lean rows.
2. Texts with hits are verified: the words at each hit are compared with the
   words of the benchmark's windows.  The hits, some rows per text, are stored.

Defined cases.  Null text or item: no words.  Empty benchmark: nothing is hit.
Items with equal windows all count.  Every document gives one row, also repeated
rows and other texts of one doc_id (told apart by a 64-bit hash).  Null doc_id is
kept.  Extra columns do not matter in `report`, and stay in `remove`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored

N, BROADCAST = 10, 4_000_000  # hashes of eight bytes
_SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"


def _lower(text: str) -> str:
    """A-Z only; texts of nothing but ASCII take the faster function, which is the same for them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"if(octet_length({text}) = char_length({text}), lower({text}), translate({text}, '{upper}', '{upper.lower()}'))"


def _words(text: str = "text"):
    return F.array_remove(F.split(F.expr(f"coalesce({_lower(text)}, '')"), f"{_SEPARATOR}+"), "")


def _hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Columns h<length>: an array of the hash of the window from each word on (the last ones run short)."""
    df = df.withColumn("h1", F.expr("transform(words, w -> xxhash64(w))"))
    made = {1}

    def need(df: DataFrame, n: int) -> DataFrame:
        if n in made:
            return df
        a = 1 << (n.bit_length() - 1)
        a = a // 2 if a == n else a
        df = need(need(df, a), n - a)
        made.add(n)
        return df.withColumn(f"h{n}", F.expr(f"zip_with(h{a}, slice(h{n - a}, {a + 1}, greatest(size(h{n - a}) - {a}, 0)), (x, y) -> xxhash64(x, y))"))

    for n in lengths:
        df = need(df, n)
    return df


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """len, win (its words), hash and items (who has it, as strings) of every distinct window."""
    items = benchmark.select("item_id", _words().alias("words")).where("size(words) > 0").withColumn("len", F.expr(f"least(size(words), {n})"))
    wins = items.select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(words) - len + 1), p -> slice(words, p, len))")).alias("words"))
    wins = wins.groupBy("len", "words").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"))
    hashed = [_hashes(wins.where(f"len = {k}"), [k]).select("len", F.expr("concat_ws(' ', words)").alias("win"), F.expr(f"h{k}[0]").alias("hash"), "items") for k in range(1, n + 1)]
    out = hashed[0]
    for h in hashed[1:]:
        out = out.unionAll(h)
    return out


def _hits(docs: DataFrame, windows: DataFrame, broadcast: int) -> DataFrame:
    """doc_id, _text, n_words, len and p of each text window whose hash is a benchmark window's, and a row with p 0 for every text."""
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}  # a row for each length up to n
    lengths = sorted(sizes)
    texts = docs.select("doc_id", F.xxhash64("text").alias("_text"), _words().alias("words")).withColumn("n_words", F.size("words").cast("long"))
    count = {k: f"greatest(n_words - {k} + 1, 0)" for k in lengths}
    # one array of hashes: a zero that stands for the text, then the windows of each length
    arrays = ["array(0L)", *[f"slice(h{k}, 1, cast({count[k]} as int))" for k in lengths]]
    rows = _hashes(texts, lengths).select("doc_id", "_text", "n_words", F.posexplode(F.expr(f"concat({', '.join(arrays)})")).alias("pos", "hash"))
    known = windows.select("hash").unionAll(windows.sparkSession.range(1).select(F.lit(0).cast("long").alias("hash"))).distinct()
    hits = rows.join(F.broadcast(known) if sum(sizes.values()) <= broadcast else known, "hash")
    length, place, before = "0", "0", "1"
    for k in lengths:
        length = f"if(pos >= {before} and pos < {before} + {count[k]}, {k}, {length})"
        place = f"if(pos >= {before} and pos < {before} + {count[k]}, pos - ({before}) + 1, {place})"
        before = f"{before} + {count[k]}"
    return hits.select("doc_id", "_text", "n_words", F.expr(length).cast("int").alias("len"), F.expr(place).cast("int").alias("p"))


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._text") == F.col(f"{b}._text"))


def _verified(docs: DataFrame, benchmark: DataFrame, n: int, broadcast: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _text, n_words) of every text, and for each (doc_id, _text) with a verified window: hit (word places from 1, each once) and items (ids as strings, sorted)."""
    windows = stored(benchmark_windows(benchmark, n), "windows")
    hits = stored(_hits(docs, windows, broadcast), "hits")
    spans = hits.where("p > 0").groupBy("doc_id", "_text").agg(F.collect_set(F.struct("p", "len")).alias("spans"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).alias("t").join(spans.alias("s"), _same("t", "s")).select("t.doc_id", "t._text", "spans", _words().alias("words"))
    found = texts.select("doc_id", "_text", F.explode(F.expr("transform(spans, s -> struct(s.p, s.len, array_join(slice(words, s.p, s.len), ' ') as win))")).alias("f")).select("doc_id", "_text", "f.p", "f.len", "f.win")
    found = found.join(windows.select("len", "win", "items"), ["len", "win"]).groupBy("doc_id", "_text").agg(
        F.collect_set(F.struct("p", "len")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    found = found.withColumn("hit", F.expr("array_distinct(flatten(transform(spans, s -> sequence(s.p, s.p + s.len - 1))))")).drop("spans")
    return hits.where("p = 0").select("doc_id", "_text", "n_words"), found


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    texts, found = _verified(docs, benchmark, n, broadcast)
    none = F.array().cast("array<string>")
    rows = texts.alias("t").join(found.alias("f"), _same("t", "f"), "left").select("t.doc_id", "n_words", F.coalesce(F.size("hit"), F.lit(0)).alias("n"), F.coalesce("items", none).alias("items"))
    return rows.select(
        "doc_id",
        "n_words",
        F.greatest("n", F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, spans: bool = False, n: int = N, broadcast: int = BROADCAST) -> DataFrame:
    """The documents without those that hold a benchmark window, or with the hit words taken out of them.

    A word goes together with the separators after it; all other text stays as it is.
    """
    names = docs.columns
    found = _verified(docs, benchmark, n, broadcast)[1].select(F.col("doc_id").alias("_doc"), "_text", F.col("hit").alias("_hit"))
    found = found.withColumnsRenamed({c: f"{'_' * max(map(len, names))}{c}" for c in found.columns})  # no name of the documents'
    doc, text, hit = (F.col(c) for c in found.columns)
    same = [F.col("doc_id").eqNullSafe(doc), F.xxhash64("text") == text]
    if not spans:
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left")
    pieces = f"regexp_extract_all(text, '([0-9A-Za-z\\\\x{{80}}-\\\\x{{10FFFF}}]+[^0-9A-Za-z\\\\x{{80}}-\\\\x{{10FFFF}}]*)', 1)"
    lead = "regexp_extract(text, '^([^0-9A-Za-z\\\\x{80}-\\\\x{10FFFF}]*)', 1)"
    cut = F.expr(f"if({found.columns[2]} is null, text, concat({lead}, array_join(filter({pieces}, (x, i) -> not array_contains({found.columns[2]}, i + 1)), '')))")
    return joined.select(*[cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in names])
