"""The ten operators against brute force, on the smallest tables and on hand-made hard cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm import brute
from tracelake.llm import bpe, components, decontamination, html_extract, jaccard_join, kernels, quality_classifier, quality_rules, queries, sharding, substring_dedup, suffix_dedup, warc


def texts(seed=5):
    """Null, empty, tiny, long, repeated and nearly equal texts in one table."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é"[: 2 + i % 4] for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(70), say(55)
    out = [None, "", " \n\t ", "one", "a b c", "a b c", "x" * 3000, "é" * 150, "ab " * 400, "ab " * 401, say(4000), passage, f"{say(30)} {passage}\n{say(10)}", f"{passage} {passage}", f"{line}\n{line}\n{say(5)}"]
    for n in (5, 20, 60, 200):
        base = say(n).split()
        for k in range(6):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    out += [out[-1], out[-2].upper(), f"{out[20]}  {out[21]}"]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i * 3 + 1, out[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def hard(spark):
    rows = texts()
    # names that the operators use inside, as columns of the table
    df = spark.createDataFrame([(d, t, "en" if d % 2 else None, f"s{d % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return rows, df.withColumns({c: F.lit(c) for c in ("doc", "fp", "late", "row", "sid", "kept", "words", "h1", "bucket", "key")}).repartition(4).cache()


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    return [(r["doc_id"], r["text"]) for r in df.collect()], df


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("table", ["hard", "documents"])
def test_substrings(request, table):
    rows, df = request.getfixturevalue(table)
    assert by_id(substring_dedup.digests(df)) == brute.substrings(rows)
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.dedupe(df).collect()}
    want = brute.substrings(rows)
    for d, t in rows:
        assert kept[d] == t if not want[d][1] else brute.sha(kept[d]) == want[d][2]
    assert substring_dedup.dedupe(df).columns == df.columns


@pytest.mark.parametrize("table", ["hard", "documents"])
def test_suffixes(request, table):
    rows, df = request.getfixturevalue(table)
    want = brute.suffixes(rows)
    assert by_id(suffix_dedup.digests(df)) == want
    spans = suffix_dedup.removed_spans(df).collect()
    assert sum(r["end"] - r["start"] for r in spans) == sum(v[1] for v in want.values())


def test_substrings_with_full_bitmap(hard):
    rows, df = hard
    assert by_id(substring_dedup.digests(df, bits=16)) == brute.substrings(rows)


def test_suffixes_of_hot_anchors_travel_one_by_one(hard):
    rows, df = hard
    assert len(suffix_dedup.hot_anchors(df, hot=1))
    assert by_id(suffix_dedup.digests(df, hot=1)) == brute.suffixes(rows)


@pytest.mark.parametrize("length", [16, 40, 100, 333])
def test_bucket_sort(length, monkeypatch):
    """The passes over one bucket of ranges, a few suffixes at a time, against all suffixes in a dictionary."""
    monkeypatch.setattr(suffix_dedup, "_SUFFIXES", 500)
    rng = random.Random(length)
    passage = "".join(rng.choice("ab c") for _ in range(900))
    texts_ = ["".join(rng.choice("ab c") for _ in range(300)) + passage[rng.randrange(200) :] + "".join(rng.choice("abc") for _ in range(60)) for _ in range(8)] + ["z" * 700, "yz" * 400, passage, passage]
    data, at = kernels.text_buffer(pa.array(texts_))
    start, count, place, _, _ = suffix_dedup._all_ranges(data, at, length)
    owner = np.searchsorted(at, start, "right") - 1
    size = count - 1 + length
    body = np.concatenate([data[s : s + n] for s, n in zip(start, size, strict=True)])
    which, step, n = suffix_dedup.sort_bucket(owner, np.zeros(len(owner), np.int64), start - at[owner], count, place.astype(np.uint16), body, length)
    got = {(int(owner[r]), int(start[r] - at[owner[r]]) + s + k) for r, s, m in zip(which, step, n, strict=True) for k in range(m)}
    seen, want = set(), set()
    for i, t in enumerate(texts_):
        for s in range(len(t) - length + 1):
            want |= {(i, s)} if t[s : s + length] in seen else set()
            seen.add(t[s : s + length])
    assert got == want


def test_long_texts_are_tiled(spark, monkeypatch):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefg ") for _ in range(9000))
    rows = [(1, long), (2, long[2000:7000] + "x" + long[100:900]), (3, "y" + long[:3000])]
    want = brute.suffixes(rows)
    for tile in (700, 5000):
        data, at = kernels.text_buffer(pa.array([t for _, t in rows]))
        monkeypatch.setattr(suffix_dedup, "_TILE", tile)
        found = [suffix_dedup.Ranges(data[s:e], first, last, 100).count.sum() for s, e, first, last in suffix_dedup._tiles(at, 100)]
        assert sum(found) == sum(len(t) - 99 for _, t in rows)
    assert by_id(suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))) == want


@pytest.mark.parametrize("table", ["hard", "documents"])
@pytest.mark.parametrize("bound", [jaccard_join.BOUND, 150])
def test_components(request, table, bound):
    rows, df = request.getfixturevalue(table)
    assert by_id(jaccard_join.joined(df, bound=bound)) == brute.components(rows)


def test_near_duplicates_leave_one_of_each(hard):
    rows, df = hard
    want = brute.components(rows, 5, 80, 100)
    kept = {r["doc_id"] for r in jaccard_join.deduplicated(df).collect()}
    assert kept == {d for d, (n, root) in want.items() if d == root}


@pytest.mark.parametrize("budgets", [(0, 3, 0), (2, 2, 1), (5, 0, 0)])
def test_segment_budgets_lose_no_pair(budgets):
    """Sets that differ in up to H elements share a key, whatever the split into budgets."""
    zeros, ones, reserve = budgets
    need = zeros + 2 * ones - reserve
    rng = np.random.default_rng(3)
    plan = jaccard_join.Plan({}, 60, 85, 100)
    plan.segments = [budgets] * len(plan.segments)
    for _ in range(300):
        base = rng.integers(0, 2**63, 34).astype(np.uint64)
        other = np.concatenate([base[: 34 - (need - 1) // 2], rng.integers(0, 2**63, (need - 1) // 2).astype(np.uint64)])
        pair = [np.sort(base), np.sort(other)]
        keys, owner = jaccard_join.keys_of(np.concatenate(pair), np.array([0, 34, 68]), plan)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


@pytest.mark.parametrize("budgets", [(0, 3, 0), (2, 2, 1), (5, 0, 0)])
@pytest.mark.parametrize("shared", [0, 3, 12, 30, 34])
def test_common_elements_lose_no_pair(budgets, shared):
    """Nor do they where some or all elements are common, with as many segments left out as the reserve lets."""
    zeros, ones, reserve = budgets
    need = zeros + 2 * ones - reserve
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 60).astype(np.uint64)
    plan = jaccard_join.Plan({}, 60, 85, 100, common=pool)
    plan.segments = [budgets] * len(plan.segments)
    for i in range(200):
        base = np.concatenate([rng.choice(pool, shared, replace=False), rng.integers(0, 2**63, 34 - shared).astype(np.uint64)])
        base = rng.permutation(base)  # what differs is common or not
        gone = (need - 1) // 2 if i % 2 else 0
        other = np.concatenate([base[: 34 - gone], rng.integers(0, 2**63, need - 1 - gone).astype(np.uint64)])
        pair = [np.sort(base), np.sort(other)]
        keys, owner = jaccard_join.keys_of(np.concatenate(pair), np.array([0, 34, 34 + len(other)]), plan)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_shared_passages_hold_no_cluster_together(spark):
    """Unlike texts with passages that very many texts share stay apart: as candidates they were one cluster, which grew with the corpus."""
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [say(40) for _ in range(6)]
    rows = [(i, f"{say(60)} {rng.choice(passages)} {say(60)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    shared = jaccard_join.common(docs, 5)
    assert len(shared) == 6 * 36
    h, first = jaccard_join.shingle_sets(pa.array([t for _, t in rows]), 5)
    sid = jaccard_join.set_ids(h, first)

    def largest(plan):
        key, owner = jaccard_join.keys_of(h, first, plan)
        _, _, a, b = jaccard_join._stars(key, sid[owner])
        _, root = jaccard_join.forest(a, b)
        return int(np.unique(root, return_counts=True)[1].max(initial=0))

    size = int(np.diff(first).max())
    counts = dict.fromkeys(range(99), 20_000)  # as in a large corpus
    assert largest(jaccard_join.Plan(counts, size, 80, 100)) > 50
    assert largest(jaccard_join.Plan(counts, size, 80, 100, common=shared)) < 5


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = by_id(components.components(spark.createDataFrame(edges, "a long, b long")))
    assert {k: v[0] for k, v in got.items()} == {x: root(x) for x in parent if root(x) != x}


@pytest.mark.parametrize("table", ["hard", "documents"])
def test_quality_counts(request, table):
    rows, df = request.getfixturevalue(table)
    got = {r["doc_id"]: r for r in quality_rules.judged(df).collect()}
    for d, t in rows:
        want = brute.counts(t)
        assert tuple(got[d][c] for c in quality_rules.COUNTS[:5]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[d]["base_failed"] == failed and not (failed and got[d]["kept"])
    kept = {r["doc_id"] for r in quality_rules.passing(df).collect()}
    assert kept == {d for d in got if got[d]["kept"]}
    assert quality_rules.passing(df).columns == df.columns


def _vectors(rows, judged):
    """Transformed statistics of rows that pass the plain limits, worked out anew."""
    out = {}
    for d, _ in rows:
        r = judged[d]
        if not r["base_failed"]:
            n, c = r["n_words"], r["word_chars"]
            x = [np.log(n + 50), np.log((c + 1000) / (n + 200)), np.log((n + 20) / (r["n_lines"] + 2)), 10 * np.sqrt((r["n_capitals"] + 16) / (c + 1000)), 10 * np.sqrt((r["n_marks"] + 28) / (c + 1000)), np.log1p(100 * r["n_symbols"] / (n + 50))]
            out[d] = (np.array(x) - quality_rules.ORIGIN) * quality_rules.UNITS
    return out


def test_verdicts_are_those_of_a_rowwise_estimate(spark):
    """Every group of sf0.01 with enough rows, and the languages of the others, against concentration steps over rows from many starts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    rows = [(r["doc_id"], (r["lang"], r["source"])) for r in docs.select("doc_id", "lang", "source").collect()]
    vectors, groups = _vectors(rows, judged), {}
    for d, g in rows:
        if d in vectors:
            groups.setdefault(g, []).append(d)
    cut, seen, right = quality_rules.chi2(quality_rules.TAIL), 0, 0
    for lang in {g[0] for g in groups}:
        small = [d for g, m in groups.items() if g[0] == lang and len(m) < quality_rules.LEAST for d in m]
        of_lang = [d for g, m in groups.items() if g[0] == lang for d in m]
        for members, of in [(of_lang, small), *[(m, m) for g, m in groups.items() if g[0] == lang and len(m) >= quality_rules.LEAST]]:
            if len(members) >= quality_rules.LEAST:
                d2 = dict(zip(members, brute.mcd_distances(np.array([vectors[d] for d in members]), quality_rules.FLOOR * quality_rules.UNITS), strict=True))
                seen += len(of)
                right += sum(judged[d]["kept"] == bool(d2[d] <= cut) for d in of)
    assert seen > 500 and right >= 0.99 * seen


def test_spread_is_estimated_not_given(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_rules.measured(docs.select("doc_id", "text", *quality_rules._group())).where(quality_rules.base_failed() == F.lit(False))
    found = quality_rules.estimates(rows.select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), *[v.alias(f"x{i}") for i, v in enumerate(quality_rules.vector())])).collect()
    assert len({r["level"] for r in found}) >= 2
    for r in found:
        if r["n"] >= quality_rules.LEAST:
            spread = np.sqrt(np.diag(np.linalg.inv(np.array(r["inverse"]).reshape(quality_rules.D, -1))))
            assert (spread > 5).all() and (np.abs(spread / quality_rules.UNITS - quality_rules.FLOOR) > 1e-3).sum() >= quality_rules.D - 1


def test_cells_that_are_too_many_are_widened(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 200, (3000, quality_rules.D)).round().astype(int)
    x[:300] += 3000
    rows = spark.createDataFrame([("en", "a", *map(int, r)) for r in x], "lang string, source string, " + ", ".join(f"x{i} long" for i in range(quality_rules.D)))
    for cells in (1 << 15, 200):
        (r,) = quality_rules.estimates(rows, cells=cells).collect()
        y = x - np.array(r["mean"])
        d2 = np.einsum("ij,jk,ik->i", y, np.array(r["inverse"]).reshape(quality_rules.D, -1), y)
        assert r["n"] == 3000 and (d2[:300] > quality_rules.chi2(quality_rules.TAIL)).all() and (d2[300:] > quality_rules.chi2(quality_rules.TAIL)).mean() < 0.01


def test_labelled_documents_are_told_apart(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for judged in (quality_rules.judged(docs), quality_classifier.scored(docs)):
        kept = {r["doc_id"]: r["kept"] for r in judged.select("doc_id", "kept").collect()}
        good = [kept[d] for d, q in labels.items() if q]
        poor = [kept[d] for d, q in labels.items() if not q]
        assert np.mean(good) > 0.95 and np.mean(poor) < 0.1


@pytest.mark.parametrize("bound", [decontamination.BROADCAST, 0])
def test_decontamination(spark, hard, documents, bound):
    for rows, df in (hard, documents):
        items = [(i, t) for i, (_, t) in enumerate(rows) if i % 7 == 3] + [(900, "a B c"), (901, None), (902, "one!"), (903, "A-b C")]
        bench = spark.createDataFrame(items, "item_id long, text string")
        want = brute.contaminated(rows, items)
        assert by_id(decontamination.report(df, bench, broadcast=bound)) == want
        assert {r["doc_id"] for r in decontamination.remove(df, bench, broadcast=bound).collect()} == {d for d in want if not want[d][4]}
        cut = decontamination.remove(df, bench, spans=True, broadcast=bound)
        assert cut.columns == df.columns
        left = {r["doc_id"]: len(brute._WORD.findall(brute.lower(r["text"]))) for r in cut.collect()}
        assert left == {d: v[0] - v[1] for d, v in want.items()}


def test_window_join_carries_no_words(spark, hard):
    _, df = hard
    windows = decontamination.benchmark_windows(df.select(F.col("doc_id").alias("item_id"), "text"))
    for bound in (decontamination.BROADCAST, 0):
        plan = decontamination._hits(df, windows, bound)._jdf.queryExecution().optimizedPlan().toString()
        joined = plan[: plan.index("Generate")]
        assert "Join Inner" in joined and "words#" not in joined.replace("n_words#", "") and ("strategy=broadcast" in joined) == (bound > 0)


def test_empty_benchmark(spark, hard):
    rows, df = hard
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(v[4] for v in by_id(decontamination.report(df, bench)).values())


def test_tokens(hard, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    for rows, df in (hard, documents):
        got = by_id(bpe.digests(df))
        for d, t in rows:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            assert got[d] == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_tokens_of_odd_text(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    odd = ["a\x1cb\x85c\xa0d e", "é ́x ΑΣ ΟΔΟΣ", "<|endoftext|>x <|startoftext|>", "don't we'll!!", "日本語" * 2000, "x" * 20_000, "1234 ½", "\x00\x01 ퟿", " a\n\n\tb "]
    got = by_id(bpe.encode(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")))
    for i, t in enumerate(odd):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert got[i] == (ids, tokenizer.decode(ids, skip_special_tokens=False))


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 5000)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 20_000)
    coder = bpe.Coder(bpe.vocabulary_path())
    for seed in range(5):
        column = pa.array([t for _, t in texts(seed)])
        got = coder.batch(bpe.chunked(column))
        for t, ids in zip(column.to_pylist(), got, strict=True):
            want = coder.tokenizer.encode(t or "", add_special_tokens=False).ids
            assert ids.tolist() == want and coder.written(ids) == (" ".join(map(str, want)), coder.tokenizer.decode(want, skip_special_tokens=False))
        assert coder.words.size <= 5000 and len(coder.chunks) < 100
    coder.forget()
    assert not coder.chunks and not coder.words.index


def test_chunks_are_encoded_once():
    coder = bpe.Coder(bpe.vocabulary_path())
    rng = random.Random(8)
    passage = " ".join(f"w{rng.randrange(500)}" for _ in range(6000))
    column = pa.array([passage, f"one more {passage}", f"{passage} and on"])
    chunks = bpe.chunked(column)
    got = coder.batch(chunks)
    assert coder.encoded == len({c for t in chunks for c in t}) < len(chunks[0]) + 8
    assert [x.tolist() for x in got] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in column.to_pylist()]


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_joins_are_repaired(monkeypatch, cut):
    """Chunks of a few bytes: words over many chunks."""
    coder = bpe.Coder(bpe.vocabulary_path())
    for _, t in texts(3):
        raw = t or ""
        chunks = [raw[i : i + cut].encode() for i in range(0, min(len(raw), 600), cut)]
        assert coder.batch([chunks])[0].tolist() == coder.tokenizer.encode(raw[:600], add_special_tokens=False).ids


def test_vocabulary_that_does_not_split_at_white_space(spark):
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    rows = [(i, t) for i, (_, t) in enumerate(texts(6))]
    got = by_id(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path))
    tokenizer = bpe.coder(path).tokenizer
    assert not bpe.coder(path).splits
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, tokenizer.decode(ids, skip_special_tokens=False))


def test_shards(hard):
    rows, df = hard
    got = sharding.digests(df).collect()
    text = dict(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    sizes = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(16)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    again = sharding.shuffled(df, shards=3, block_rows=4)
    assert set(again.columns) == {*df.columns, "shard", "slot"} and again.count() == len(rows)


def test_communication_matrix():
    counts = np.array([5, 0, 7, 30, 1])
    before = np.append(0, np.cumsum(counts))
    _, _, room = sharding.blocks(int(before[-1]), 4, 6)
    total, mean = np.zeros((5, len(room))), 0
    for seed in range(400):
        matrix = np.array([sharding.matrix_row(i, before, room, seed) for i in range(5)])
        assert (matrix.sum(1) == counts).all() and (matrix.sum(0) == room).all()
        total += matrix
    assert np.abs(total / 400 - np.outer(counts, room) / before[-1]).max() < 0.25
    rng = np.random.default_rng(1)
    draws = [sharding._hypergeometric(rng, 2 * 10**9, 10**9, 9000) for _ in range(300)]
    assert abs(np.mean(draws) - 6000) < 15 and 30 < np.std(draws) < 60


def test_html():
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Fish &amp; chips</h1><p>First <b>bo</b>ld part\n of&nbsp;the text goes on for a while here.</p><div class='ad'>Buy now and save</div><script>if (a < b) x()</script>"
        "<p>Second part, 1 < 2, of the very same article text.<p>Third</article><div class='comments'><p>Great post, thanks</p></div><footer>&copy; 2024</footer></body></html>"
    )
    assert html_extract.extract(page) == "Fish & chips First bold part of the text goes on for a while here. Second part, 1 < 2, of the very same article text. Third"
    assert [html_extract.extract(x) for x in (None, "", "<nav>menu</nav>", "<!-- never closed", "plain words")] == ["", "", "", "", "plain words"]


def test_html_on_held_out_layouts():
    from tracelake.llm.labelled_pages import pages

    weights = html_extract.fit(pages(300, seed=3))
    found = wanted = both = 0
    for page in pages(150, seed=77):
        want = sum(m.count("word") for m, main in page if main)
        source = "".join(m.replace("word", "good" if main else "poor") for m, main in page)
        got = html_extract.extract(source, weights).split()
        found, wanted, both = found + len(got), wanted + want, both + got.count("good")
    assert both / found > 0.93 and both / wanted > 0.9


def test_html_pages(spark):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    df = df.unionByName(df.limit(1).withColumns({"page_id": F.lit(None).cast(df.schema["page_id"].dataType), "url": F.lit(None).cast("string"), "html": F.lit(None).cast("string")}))
    got = html_extract.extracted(df).collect()
    assert len(got) == df.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [tuple(r) for r in got if r["page_id"] is None] == [(None, None, "", 0)]


def captures():
    head = lambda **h: {k.replace("_", "-"): v for k, v in h.items()}
    return [
        (1, "http://www.A.example:80/x/?b=2&a=1&utm_source=q#top", 10, "response", '"v1"', None, None, head(etag='"v1"', content_length="9", date="10")),
        (2, "https://a.example/x?a=1&b=2", 20, "revisit", 'W/"v1"', None, None, head(date="20", content_length="0", connection="close")),
        (3, "https://a.example/x?a=1&b=2", 30, "response", '"v2"', "m", "d", head(etag='"v2"', date="30")),
        (4, "https://a.example/x?a=1&b=2", 30, "revisit", '"v1"', "m", "d", None),
        (5, "https://a.example/x?a=1&b=2", 40, "revisit", None, "m", None, {}),
        (6, "https://a.example/x?a=1&b=2", 41, "revisit", None, None, "d", {}),
        (7, "https://a.example/x?a=1&b=2", 42, "revisit", None, None, None, {}),
        (8, "https://a.example/y", 50, "revisit", '"v1"', None, None, {}),
        (9, None, 60, "response", None, None, "d", {}),
        (10, None, 61, "revisit", None, None, "d", {}),
        (11, "https://a.example/x?a=1&b=2", 45, "request", None, None, None, {}),
    ]


SCHEMA = "record_id long, url string, captured_at long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_warc_resolution(spark):
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(captures(), SCHEMA).withColumn("url_extra", F.lit(1))).collect()}
    assert {k: (r["status"], r["base_id"]) for k, r in got.items()} == {
        1: ("response", 1), 2: ("resolved", 1), 3: ("response", 3), 4: ("validator_mismatch", None), 5: ("resolved", 3), 6: ("resolved", 3), 7: ("no_validator", None),
        8: ("no_earlier_response", None), 9: ("response", 9), 10: ("no_earlier_response", None), 11: ("other", None),
    }
    assert got[2]["merged_headers"] == {"etag": '"v1"', "content-length": "9", "date": "20"}
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_warc_hot_url_over_many_tasks(spark):
    rows = [(i, "http://a.example/x" if i % 3 else f"http://b{i}.example/", i // 2, "response" if i % 50 == 1 else "revisit", "e", None, None, {}) for i in range(3000)]
    got = {r["record_id"]: r["base_id"] for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    last = {}
    for i, url, _, kind, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        if kind == "response":
            last[url] = i
        assert got[i] == last.get(url)


def test_warc_files(spark, tmp_path):
    import gzip

    http = b'HTTP/1.1 200 OK\r\nETag: "a"\r\nContent-Type: text/html\r\n\r\n<p>x</p>'
    record = lambda kind, body: b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(b"response", http)) + gzip.compress(record(b"revisit", b"HTTP/1.1 304 Not Modified\r\nETag: \"a\"\r\n\r\n")))
    rows = sorted(warc.read_warc(spark, str(tmp_path)).collect(), key=lambda r: r["kind"])
    assert [(r["kind"], r["etag"], bytes(r["payload"])) for r in rows] == [("response", '"a"', b"<p>x</p>"), ("revisit", '"a"', b"")]


def test_warc_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    result = con.execute(warc.ORACLE)
    names = sorted(d[0] for d in result.description)
    index = [[d[0] for d in result.description].index(n) for n in names]
    want = sorted(tuple(str(r[i]) for i in index) for r in result.fetchall())
    got = queries.op1_warc_revisits(spark, SMALL)
    assert sorted(got.columns) == names
    assert sorted(tuple(str(r[n]) for n in names) for r in got.collect()) == want


def test_em_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(20_000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)) for a in (0.9, 0.8, 0.7, 0.6)], 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    _, prior, table = quality_classifier.em(patterns, n.astype(float))
    assert abs(prior - 0.7) < 0.05 and np.abs(table[1, :, 2] - [0.9, 0.8, 0.7, 0.6]).max() < 0.05


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_nulls_and_repeated_rows(spark, tmp_path, name):
    """One row out for every row in, null and repeated ones included; repeated ids come out as often as they go in."""
    ids = []
    for table in ("documents", "pages", "benchmark"):
        df = spark.read.parquet(f"{SMALL}/{table}.parquet").limit(40)
        none = df.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        rows = df.unionByName(none).unionByName(df.limit(5)).withColumns({c: F.lit("x") for c in ("kept", "status", "text_crc32", "score", "e", "n", "validator", "block", "part", "hash", "late", "row")})
        rows.write.parquet(str(tmp_path / f"{table}.parquet"))
        ids.append(sorted(str(r[0]) for r in rows.select(df.columns[0]).collect()))
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == 47
    assert sorted(str(r[0]) for r in got) in ids


def test_hostile_pages_take_linear_time():
    import time

    began = time.time()
    deep = "".join(f"<div class='c{i}'>" for i in range(20_000)) + "<p>the words of the article</p>"
    assert "words of the article" in html_extract.extract(deep)
    for page in ("<div>" * 50_000 + "x", '<a "' * 50_000, '<a ="' * 50_000 + ">", "<a b='" * 50_001 + ">", "<!--" * 50_000, "<! " * 50_000, "<title><body>" * 30_000, "<p><div>" * 30_000, "</p>" * 50_000, "<script" * 50_000):
        html_extract.extract(page)
    assert time.time() - began < 10


def test_broken_warc_files():
    import gzip

    record = lambda i: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/%d\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" % i
    whole = gzip.compress(record(1)) + gzip.compress(record(2))
    urls = lambda raw: [r["url"] for r in warc.parse_warc(raw)]
    assert urls(whole) == ["http://a/1", "http://a/2"]
    assert urls(whole[:-12]) in (["http://a/1"], ["http://a/1", "http://a/2"]) and urls(gzip.compress(record(1)) + b"\x1f\x8bjunk") == ["http://a/1"]
    assert urls(record(1) + record(2)[:-8]) == ["http://a/1"] and urls(b"") == [] and urls(b"junk") == []


def test_sample_is_bounded(spark, documents, monkeypatch):
    _, df = documents
    monkeypatch.setattr(quality_classifier, "SAMPLE_WORDS", 500)
    got = quality_classifier.scored(df, sample=20)
    assert got.count() == df.count() and 0 < got.where("kept").count() <= df.count()
