"""What is shuffled by queries whose tables grow, and their results on odd rows."""

import re

import numpy as np
import pytest

from kinetra.functions import quantiles
from kinetra.functions.stats import rank_rows
from kinetra.operators import partition, quality


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_silhouette(rows):
    """Rows are (id, label, a, b); rows with the same id and label count as one, with the sums of all."""
    rows = [r for r in rows if r[1] is not None and r[1] >= 0]
    x, label = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    d, scores = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), []
    for key in {r[:2] for r in rows}:
        own = [j for j, r in enumerate(rows) if r[:2] == key]
        s = {c: (d[own][:, label == c].sum(), len(own) * (label == c).sum()) for c in set(label.tolist())}
        if s[key[1]][1] == 1:
            scores.append(0.0)
            continue
        a, b = s[key[1]][0] / (s[key[1]][1] - 1), min(t / n for c, (t, n) in s.items() if c != key[1])
        scores.append((b - a) / max(a, b))
    return sum(scores) / len(scores)


def test_silhouette_shuffles_a_row_for_each_id(spark, monkeypatch):
    rng = np.random.default_rng(5)
    ids = [None if u < 0.1 else int(k) for u, k in zip(rng.random(400), rng.integers(0, 300, 400), strict=True)]
    rows = [(i, None if c == 5 else int(c), *map(float, v + c)) for i, c, v in zip(ids, rng.integers(-1, 6, 400), rng.normal(size=(400, 2)), strict=True)] + [(900, 7, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "i long, label int, a double, b double").repartition(3)
    whole = partition.silhouette_all(df, "i", ["a", "b"], block_rows=50)
    assert not re.search(r"hashpartitioning\([^)]*lb#", plan(whole))  # the sums by cluster stay in their task
    want = pytest.approx(brute_silhouette(rows), abs=1e-12)
    assert whole.first().silhouette == want
    for sent, labels in ((1_000_000, 2), (0, 256), (0, 2)):  # too many labels to hold; a product of partitions; both
        monkeypatch.setattr(partition, "SENT_ROWS", sent)
        monkeypatch.setattr(partition, "MOST_LABELS", labels)
        assert partition.silhouette_all(df, "i", ["a", "b"], block_rows=50).first().silhouette == want


def test_silhouette_of_missing_vectors_and_empty_tables(spark):
    schema = "i long, label int, a double"
    some = [(0, 0, 0.0), (1, 0, 1.0), (2, 1, 5.0), (3, 1, 7.0)]
    assert partition.silhouette_all(spark.createDataFrame(some, schema), "i", ["a"]).first().silhouette == pytest.approx((1 - 1 / 6 + 1 - 1 / 5 + 1 - 2 / 4.5 + 1 - 2 / 6.5) / 4)
    missing = spark.createDataFrame([*some, (4, 1, None)], schema)  # no sum that it is in counts
    assert partition.silhouette_all(missing, "i", ["a"]).first().silhouette is None
    assert partition.silhouette_all(missing.limit(0), "i", ["a"]).first().silhouette is None


def brute_rank(x):
    """Average rank; null stays null, values that are not a number come last and are equal."""
    order = {v: (len([w for w in x if w is not None and (v != v) > (w != w)]) + len([w for w in x if w is not None and w < v]), sum(w == v or (w is not None and v != v and w != w) for w in x)) for v in {*x} - {None}}
    return [None if v is None else order[v][0] + (order[v][1] + 1) / 2 for v in x]


def test_ranks_shuffle_only_values_inside_intervals(spark):
    rng = np.random.default_rng(7)
    nan, inf, n = float("nan"), float("inf"), 3_000
    odd = [None, nan, inf, -inf, 0.0, -0.0, 5e-324, 1.7976931348623157e308]
    columns = [
        [odd[k] if k < len(odd) else float(v) for k, v in zip(rng.integers(0, 60, n), rng.normal(size=n), strict=True)],
        [float(v) for v in rng.integers(0, 4, n)],
        [None if v < 1 else float(v) for v in rng.normal(size=n)],
        [inf if v < 1 else -inf if v < 2 else None for v in rng.integers(0, 3, n)],
        [None] * n,
    ]
    rows = [*zip(*columns, strict=True)]
    df = spark.createDataFrame(rows + rows[:500], "a double, b double, _f double, d double, e double").repartition(5)
    names = df.columns
    table, ranks = rank_rows(df, names)
    assert not re.search(r"hashpartitioning\([^)]*_v#", plan(ranks)) and "SortMergeJoin" not in plan(ranks)  # values are neither counted nor joined by shuffle
    got = {r._row: r for r in ranks.collect()}
    kept = table.collect()
    assert len(kept) == 3_500 and len({r._row for r in kept}) == 3_500 and set(got) == {r._row for r in kept if any(r[c] is not None for c in names)}
    for c in names:
        want = brute_rank([r[c] for r in kept])
        assert [got[r._row][c + "_rank"] if r._row in got else None for r in kept] == want


def test_ranks_of_one_row_and_of_infinities(spark):
    one = spark.createDataFrame([(float("inf"), 3)], "a double, b int")
    assert [(r.a_rank, r.b_rank) for r in rank_rows(one, ["a", "b"])[1].collect()] == [(1.0, 1.0)]


AUDITED = "city string, recording_id string, track_id long, frame_id long, timestamp_ms double, agent_type string"


def brute_audit(rows):
    """By recording: steps that do not advance, median step, rows, repeated frames and times, tracks of several types; nulls come first in order and are alike."""
    low, out = lambda v: (v is not None, v or 0), {}
    for rec in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == rec]
        still = frames = times = mixed = 0
        steps = []
        for t in {r[2] for r in own}:
            track = sorted((r for r in own if r[2] == t), key=lambda r: (low(r[4]), low(r[3])))
            d = [b[4] - a[4] for a, b in zip(track, track[1:]) if a[4] is not None and b[4] is not None]
            still, steps = still + sum(x <= 0 for x in d), steps + [x for x in d if x > 0]
            frames, times = frames + len(track) - len({r[3] for r in track}), times + len(track) - len({r[4] for r in track})
            mixed += len({r[5] for r in track} - {None}) > 1
        out[rec] = (still, float(np.median(steps)) if steps else None, len(own), frames, times, mixed)
    return out


def test_audit_deals_the_frames_once(spark, tmp_path):
    rng = np.random.default_rng(9)
    maybe = lambda v, share=0.05: None if rng.random() < share else v
    rows = [(maybe(f"c{k % 2}"), maybe(f"r{k % 3}"), maybe(int(k % 11)), maybe(int(rng.integers(0, 300))), maybe(float(rng.integers(0, 500))), maybe(str(rng.choice(["car", "truck"])) if k % 11 < 3 else "car")) for k in range(1_500)]
    rows += rows[:100] + [("c9", "alone", 1, 1, 1.0, None)]
    spark.createDataFrame(rows, AUDITED).repartition(3).write.parquet(str(tmp_path / "frames"))
    audit = quality.frame_quality_audit(spark.read.parquet(str(tmp_path / "frames")))
    assert "FileScan" not in plan(audit)  # the frames are read and dealt before, once for all figures
    assert {tuple(r)[:2]: tuple(r)[2:] for r in audit.collect()} == {k: pytest.approx(v) for k, v in brute_audit(rows).items()}
    assert quality.frame_quality_audit(spark.createDataFrame([], AUDITED)).count() == 0


def test_places_need_no_join(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k % 7 == 0 else f"g{k % 3}", None if v == 0 else float(v)) for k, v in enumerate(rng.integers(0, 40, 900))]
    at = quantiles.placed(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v")
    assert "Join" not in plan(at)  # it dealt all distinct values once more where the offsets were not small
    want = {}
    for g in {r[0] for r in rows}:
        x = [(v is not None, v or 0.0) for h, v in rows if h == g]
        want |= {(g, v[1] if v[0] else None): (x.count(v), sum(w < v for w in x), len(x)) for v in x}
    assert {(r.g, r.v): (r.n, r.before, r.total) for r in at.collect()} == want
    structs = quantiles.placed(spark.range(50).selectExpr("struct(id % 5 AS a, id AS b) AS s"), [], "s").collect()
    assert sorted((r.before, r.s.a, r.s.b) for r in structs) == [(k, *v) for k, v in enumerate(sorted((i % 5, i) for i in range(50)))] and {r.total for r in structs} == {50}
    assert quantiles.placed(spark.createDataFrame([], "g string, v double"), ["g"], "v").collect() == []
