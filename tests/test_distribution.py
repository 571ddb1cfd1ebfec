"""Class sums over sorted ranges against plain counting, for hot groups, many classes and groups that cuts divide."""

from collections import defaultdict

import numpy as np
import pytest

from peakweave.operators import distribution
from peakweave.operators.distribution import PairSums, RankSums, class_sums
from peakweave.operators.metrics import class_auc, multiclass_auc, pair_areas
from peakweave.operators.tests import kruskal, ks_two_sample, wilcoxon_rank_sum


def plain(rows):
    """{(g, h, a, b): (n_a, n_b, won, ties, apart)} by comparing every value with every other."""
    by = defaultdict(lambda: defaultdict(list))
    for g, h, c, v in rows:
        if None not in (g, h, c, v):
            by[g, h][c].append(v)
    out = {}
    for key, classes in by.items():
        for a in sorted(classes):
            for b in sorted(classes):
                if a < b:
                    x, y = np.array(classes[a]), np.array(classes[b])
                    won = (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2
                    both, n = np.unique(np.concatenate([x, y]), return_counts=True)
                    apart = max(abs((x <= v).mean() - (y <= v).mean()) for v in both)
                    out[(*key, a, b)] = (len(x), len(y), won, float((n**3 - n).sum()), round(apart, 9))
    return out


def frame(spark, rng, n, classes, groups=9):
    rows = []
    for _ in range(n):
        g = 0 if rng.random() < 0.4 else int(rng.integers(1, groups))
        v = float(rng.integers(0, 40)) if rng.random() < 0.8 else float(np.round(1000 + rng.random(), 6))
        rows.append((g, "x" if g % 2 else "y", f"c{rng.integers(0, classes):03d}", v))
    rows += [(None, "x", "c001", 1.0), (3, None, "c001", 1.0), (3, "x", None, 1.0), (3, "x", "c001", None)]
    return rows, spark.createDataFrame(rows, "g int, h string, label string, value double")


@pytest.mark.parametrize(("n", "classes", "at_once", "together"), [(3000, 4, 1 << 24, 1 << 15), (3000, 4, 0, 1 << 15), (3000, 6, 1 << 24, 16), (800, 60, 1 << 24, 64)])
def test_pair_sums_equal_counting(spark, n, classes, at_once, together, monkeypatch):
    monkeypatch.setattr(distribution, "AT_ONCE", at_once)
    monkeypatch.setattr(distribution, "TOGETHER", together)
    monkeypatch.setattr(distribution, "DENSE", 32)
    rows, df = frame(spark, np.random.default_rng(n + classes), n, classes)
    got = {(r.g, r.h, r.label_a, r.label_b): (r.n_a, r.n_b, r.first, r.ties, round(r.apart, 9)) for r in class_sums(df, "label", ["g", "h"], "value").collect()}
    assert got == plain(rows)


def test_rank_sums_equal_the_plain_ranks(spark):
    rows, df = frame(spark, np.random.default_rng(1), 2000, 5)
    got = {(r.g, r.h, r.label_a): (r.n_a, r.first, r.ties) for r in class_sums(df, "label", ["g", "h"], "value", RankSums).collect()}
    by = defaultdict(list)
    for g, h, c, v in rows:
        if None not in (g, h, c, v):
            by[g, h].append((c, v))
    want = {}
    for key, own in by.items():
        v = np.array([x for _, x in own])
        rank = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        n = np.unique(v, return_counts=True)[1]
        for c in {c for c, _ in own}:
            mine = np.array([k == c for k, _ in own])
            want[(*key, c)] = (int(mine.sum()), float(rank[mine].sum()), float((n**3 - n).sum()))
    assert got == want


def test_one_hot_group_of_near_equal_values_is_divided(spark):
    rng = np.random.default_rng(2)
    values = np.unique(500 + rng.integers(0, 10_000_000, 4000) * 1e-9)
    rows = [(0, "y", f"c{i % 3}", float(v)) for i, v in enumerate(rng.permutation(values))]
    df = spark.createDataFrame(rows, "g int, h string, label string, value double")
    # the sorted ranges, not the value's size, decide where a group is cut
    placed = df.repartitionByRange(8, "g", "value").rdd.glom().map(len).collect()
    assert max(placed) < 0.3 * len(rows)
    got = {(r.g, r.h, r.label_a, r.label_b): (r.n_a, r.n_b, r.first, r.ties, round(r.apart, 9)) for r in class_sums(df, "label", ["g", "h"], "value").collect()}
    assert got == plain(rows)


def test_five_hundred_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), f"class{i % 500:03d}", float(rng.integers(0, 90))) for i in range(3000)]
    df = spark.createDataFrame(rows, "feature int, label string, value double")
    pairs = wilcoxon_rank_sum(df, "label").count()
    present = [len({c for g, c, _ in rows if g == k}) for k in range(3)]
    assert pairs == sum(k * (k - 1) // 2 for k in present) == ks_two_sample(df, "label").count()
    assert {r.feature: r.n_groups for r in kruskal(df, "label").collect()} == dict(enumerate(present))


def test_order_of_classes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "z", 3.0)], "g int, label string, value double")
    got = class_sums(df, "label", ["g"], "value", classes=["b", "a"]).collect()
    assert [(r.label_a, r.label_b, r.first) for r in got] == [("b", "a", 1.0)]
    assert class_sums(df.limit(0), "label", ["g"], "value").collect() == []
    assert [(r.label_a, r.label_b, r.first, r.apart) for r in class_sums(df, "label", [], "value").orderBy("label_a", "label_b").collect()] == [("a", "b", 0.0, 1.0), ("a", "z", 0.0, 1.0), ("b", "z", 0.0, 1.0)]
    assert class_sums(df, "label", ["g"], "value", PairSums, own="g").collect() == []


def test_areas_by_key(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key in (1, 2):
        for i in range(60):
            p = rng.dirichlet([1, 1, 1])
            rows += [(key, i, "abc"[i % 3], "abc"[k], float(np.round(p[k], 2))) for k in range(3)]
    df = spark.createDataFrame(rows, "key int, sample int, actual string, class string, prob double")
    whole = {r.key: r.auc for r in multiclass_auc(df, keys=["key"]).collect()}
    for key in (1, 2):
        own = [r for r in rows if r[0] == key]
        score = {(i, c): p for _, i, _, c, p in own}
        actual = {i: a for _, i, a, _, _ in own}

        def area(c, mine, others, score=score):
            return np.mean([(score[i, c] > score[j, c]) + (score[i, c] == score[j, c]) / 2 for i in mine for j in others])

        members = {c: [i for i in actual if actual[i] == c] for c in "abc"}
        pairs = [(area(a, members[a], members[b]) + area(b, members[b], members[a])) / 2 for a, b in ("ab", "ac", "bc")]
        assert abs(whole[key] - np.mean(pairs)) < 1e-9
        each = {r["class"]: r.auc for r in class_auc(df.filter(f"key = {key}")).collect()}
        assert all(abs(each[c] - area(c, members[c], [i for i in actual if actual[i] != c])) < 1e-9 for c in "abc")
    assert pair_areas(df, keys=["key"]).count() == 6
