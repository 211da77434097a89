"""Cases in which an operator did less than its whole job."""

import random

import pytest

from tests.llm import brute
from tracelake.llm import decontamination, jaccard_join, quality_rules


def test_group_is_judged_by_its_own_estimate(spark):
    rng = random.Random(3)
    say = lambda words, chars: " ".join("".join(rng.choice("abcdefgh") for _ in range(chars + rng.randrange(3))) for _ in range(words + rng.randrange(words)))
    rows = [(i, say(40, 4), "en", "a") for i in range(60)] + [(100 + i, say(400, 9), "en", "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = lambda df: {r["doc_id"]: r["distance2"] for r in quality_rules.judged(df).collect()}
    alone = found(docs.where("source = 'a'"))
    both = found(docs)
    assert len(alone) == 60 and None not in alone.values()
    assert {d: both[d] for d in alone} == pytest.approx(alone)


def test_groups_with_a_null_id_leave_one_row(spark):
    say = lambda k: " ".join(f"{k}x{i}" for i in range(200))
    rows = [(i, say("a")) for i in range(20)] + [(None, say("a"))] * 2  # copies
    rows += [(None, f"{say('b')} one"), (None, f"{say('b')} two"), (50, say("b"))]  # near copies, two without id
    rows += [(60, say("c")), (61, say("c"))]
    rows += [(60, f"{say('d')} one"), (60, f"{say('d')} two"), (59, say("d"))]  # an id with texts of two groups
    rows += [(None, None), (70, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["text"] or "-").split("x")[0], r["doc_id"] or 0) for r in jaccard_join.deduplicated(docs).collect())
    assert got == [("-", 0), ("-", 70), ("a", 0), ("b", 0), ("c", 60), ("d", 59)]


@pytest.mark.parametrize("bound", [decontamination.BROADCAST, 0])
def test_every_document_is_reported(spark, bound):
    say = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    items = [(1, say("a", 12)), (2, say("b", 10)), (3, "z")]
    rows = [(1, f"x {say('a', 12)} z")] * 3  # repeated, with many hits
    rows += [(2, f"{say('a', 10)} y"), (2, f"y {say('b', 10)}"), (2, say("c", 11))]  # one id, other texts of 11 words
    rows += [(None, say("b", 10)), (None, say("c", 10)), (None, None), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontamination.report(docs, benchmark, broadcast=bound).collect()]
    want = [(d, *brute.contaminated([(0, t)], items)[0]) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
