"""One-to-one pairing of rows that belong together, resumable record bundles, and line diffs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WITHIN = 120  # seconds
DIFF_ALIGN, DIFF_CONTEXT, DIFF_READ, DIFF_SHOWN = 600, 3, 4000, 1200


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    used_a, used_b, out = set(), set(), []
    for r in frame.sort_values(["gap", "a_id", "b_id"]).itertuples():
        if r.a_id not in used_a and r.b_id not in used_b:
            used_a.add(r.a_id)
            used_b.add(r.b_id)
            out.append((r.session_id, r.a_id, r.b_id, r.gap))
    return pd.DataFrame(out, columns=["session_id", "a_id", "b_id", "gap"])


def nearest(a: DataFrame, b: DataFrame, within: int = WITHIN) -> DataFrame:
    """Pairs of a and b rows of one session and name, each used once, the smallest gap first.

    Candidates come from an equi join on session, name and time cell (a and its
    two neighbours), so far rows never meet.
    """
    cell = F.floor(F.col("seconds") / within)
    left = a.select("session_id", "name", F.col("id").alias("a_id"), F.col("seconds").alias("a_s"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = b.select("session_id", "name", F.col("id").alias("b_id"), F.col("seconds").alias("b_s"), cell.alias("cell"))
    found = left.join(right, ["session_id", "name", "cell"]).withColumn("gap", F.abs(F.col("a_s") - F.col("b_s"))).where(F.col("gap") <= within)
    return found.select("session_id", "a_id", "b_id", "gap").groupBy("session_id").applyInPandas(_greedy, "session_id string, a_id long, b_id long, gap long")


def resume_bundle(records: DataFrame, most: int) -> DataFrame:
    """Records of each session in order up to so many bytes; the first is always kept."""
    w = Window.partitionBy("session_id").orderBy("seq", "id")
    rows = records.withColumn("bytes", F.sum(F.octet_length("raw")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("rn", F.row_number().over(w))
    return rows.where((F.col("bytes") <= most) | (F.col("rn") == 1)).drop("rn")


def calls_with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each tool call with its result: by its id, else by its place among the session's calls without one."""
    key = F.coalesce("tool_use_id", F.concat(F.lit("#"), F.row_number().over(Window.partitionBy("session_id", F.col("tool_use_id").isNull()).orderBy("seq"))))
    left = calls.withColumn("k", key)
    right = results.withColumn("k", key).select("session_id", "k", F.col("id").alias("result_id"))
    return left.join(right, ["session_id", "k"], "left").drop("k")


def _aligned(x: list[str], y: list[str]) -> list[tuple[str, str]]:
    """A change of x into y that keeps a longest common subsequence; where both ways keep as much, what goes stands first."""
    keep = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = keep[i], keep[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
    i = j = 0
    out = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((" ", x[i]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and keep[i + 1][j] >= keep[i][j + 1]:
            out.append(("-", x[i]))
            i += 1
        else:
            out.append(("+", y[j]))
            j += 1
    return out


def _collapsed(lines: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Only what lies within DIFF_CONTEXT lines of a change; a gap in between is one line marked '~' that says how many are left out."""
    near = [False] * len(lines)
    for i, (m, _) in enumerate(lines):
        if m != " ":
            for j in range(max(0, i - DIFF_CONTEXT), min(len(lines), i + DIFF_CONTEXT + 1)):
                near[j] = True
    out, gap = [], 0
    for line, n in zip(lines, near, strict=True):
        if n:
            if gap and out:
                out.append(("~", str(gap)))
            out.append(line)
        gap = 0 if n else gap + 1
    return out


def line_diff(before: str | None, after: str | None) -> list[tuple[str, str]]:
    """Lines of a change as (mark, line): ' ' around, '-' gone, '+' new; a long unlike middle is one block of each."""
    a, b = (before or "").splitlines()[:DIFF_READ], (after or "").splitlines()[:DIFF_READ]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    middle = [("-", s) for s in x] + [("+", s) for s in y] if max(len(x), len(y)) > DIFF_ALIGN else _aligned(x, y)
    if not middle:
        return []
    return _collapsed([(" ", s) for s in a[:head]] + middle + [(" ", s) for s in a[len(a) - tail :]])[:DIFF_SHOWN]


def diffs(rows: DataFrame) -> DataFrame:
    """Rows with before and after, and the lines of the change."""

    @F.pandas_udf("array<struct<mark: string, line: string>>")
    def run(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([[{"mark": m, "line": s} for m, s in line_diff(b, a)] for b, a in zip(before, after, strict=True)])

    return rows.withColumn("diff", run("before", "after"))
