"""Trees against a plain booster, attributions against all subsets, early stop, odd rows."""

import itertools
import math

import numpy as np
import pytest

from curbline.operators import boosting as B

SCHEMA = "id long, a double, b double, c string, y int, w double"


def data(n, seed=0):
    draw = np.random.default_rng(seed)
    a, b = draw.normal(size=n).round(2), draw.integers(0, 6, n).astype(float)
    c = draw.choice(["p", "q", "r", "s"], n)
    z = 2 * a + (b > 2) * 1.5 - 2 * (c == "q") + draw.normal(size=n)
    return [(i, float(a[i]), float(b[i]), str(c[i]), int(z[i] > 0), float(draw.integers(1, 4))) for i in range(n)]


def plain(rows, model, s):
    """The same booster, row by row sums in plain loops over one array."""
    bins = np.column_stack([
        np.searchsorted(model.edges[0], [r[1] for r in rows]), np.searchsorted(model.edges[1], [r[2] for r in rows]),
        [model.values[0].index(r[3]) + 1 for r in rows],
    ])
    y, w = [np.array([r[k] for r in rows], float) for k in (4, 5)]
    raw = np.full(len(rows), math.log((w * y).sum() / (w * (1 - y)).sum()))
    worth = lambda g, h: g * g / (h + s.l2)
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        leaves = [(np.arange(len(rows)), 0)]
        splits = {}

        def find(at):
            best = None
            for c in range(3):
                for k in sorted(set(bins[:, c])):
                    left = bins[at, c] == k if c == 2 else bins[at, c] <= k
                    i, j = at[left], at[~left]
                    if min(len(i), len(j)) < s.leaf_rows:
                        continue
                    gain = (worth(g[i].sum(), h[i].sum()) + worth(g[j].sum(), h[j].sum()) - worth(g[at].sum(), h[at].sum())) / 2
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, i, j)
            return best

        while len(leaves) < s.leaves:
            tries = []
            for n, (at, depth) in enumerate(leaves):
                if depth < s.depth:
                    key = at.tobytes()
                    if key not in splits:
                        splits[key] = find(at)
                    if splits[key]:
                        tries.append((splits[key][0], n))
            if not tries:
                break
            _, n = max(tries)
            at, depth = leaves.pop(n)
            _, i, j = splits[at.tobytes()]
            leaves += [(i, depth + 1), (j, depth + 1)]
        for at, _ in leaves:
            raw[at] -= s.rate * g[at].sum() / (h[at].sum() + s.l2)
    return raw


def fitted(spark, rows, s, **more):
    return B.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b"], ["c"], "y", "id", s, "w", **more)


def encoded(model, rows):
    import pyarrow as pa

    return model.encode([pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows])])


@pytest.mark.parametrize("s", [
    B.Settings(trees=4, depth=3, leaves=6, rate=0.3, l2=0.5, leaf_rows=10, stop=0, bins=40),
    B.Settings(trees=12, depth=2, leaves=31, rate=0.1, l2=0.0, leaf_rows=20, stop=0, bins=255),
])
def test_scores_equal_a_plain_booster(spark, monkeypatch, s):
    rows = data(600)
    model = fitted(spark, rows, s)
    assert len(model.trees) == s.trees
    assert np.allclose(model.raw(encoded(model, rows)), plain(rows, model, s), atol=1e-9)
    got = spark.createDataFrame(rows, SCHEMA).select("id", B.probability(model).alias("p")).collect()
    want = 1 / (1 + np.exp(-model.raw(encoded(model, rows))))
    assert np.allclose([r["p"] for r in sorted(got)], want)
    monkeypatch.setattr(B, "DIRECT_BYTES", 0)  # sums that meet by node first
    assert fitted(spark, rows, s).trees == model.trees
    again = B.Model.of_json(model.to_json())
    assert (again.raw(encoded(again, rows)) == model.raw(encoded(model, rows))).all()


def subset_value(model, tree, bins, known):
    """Expected step of the tree when only some split columns are known."""

    def go(node):
        if tree.left[node] < 0:
            return tree.step[node]
        if B._split_column(model, tree, node) in known:
            return go(tree.left[node] if model.goes_left(tree, node, bins)[0] else tree.right[node])
        return (tree.cover[tree.left[node]] * go(tree.left[node]) + tree.cover[tree.right[node]] * go(tree.right[node])) / tree.cover[node]

    return go(0)


def test_attributions_equal_the_sum_over_all_subsets(spark):
    rows = data(300, 4)
    model = fitted(spark, rows, B.Settings(trees=3, depth=4, leaves=8, rate=0.5, stop=0, leaf_rows=5))
    bins = encoded(model, rows)[:12]
    names = B.split_columns(model)
    assert names == ["remainder__a", "remainder__b", "cat__c_p", "cat__c_q", "cat__c_r", "cat__c_s"]
    got = B.attributions(model, bins)
    for r in range(len(bins)):
        one = bins[r : r + 1]
        for j in range(len(names)):
            rest, want = [k for k in range(len(names)) if k != j], 0.0
            for size in range(len(names)):
                for some in itertools.combinations(rest, size):
                    share = math.factorial(size) * math.factorial(len(names) - size - 1) / math.factorial(len(names))
                    want += share * sum(subset_value(model, t, one, {*some, j}) - subset_value(model, t, one, {*some}) for t in model.trees)
            assert got[r, j] == pytest.approx(want, abs=1e-9)
    assert np.allclose(got.sum(axis=1) + B.expected(model), model.raw(bins))
    frame = spark.createDataFrame(rows, SCHEMA)
    back = {r["id"]: r for r in B.attributed(model, frame, ["id"]).collect()}
    assert np.allclose(back[3]["attributions"], got[3]) and len(back) == 300
    assert sum(B.gains(model).values()) == pytest.approx(1)


SETTINGS = [
    B.Settings(trees=23, depth=4, leaves=7, rate=0.3, stop=0, leaf_rows=5),
    B.Settings(trees=12, depth=6, leaves=31, rate=0.2, l2=0.5, stop=4, rows_share=0.8, columns_share=0.7),
]


@pytest.mark.parametrize("s", SETTINGS)
def test_one_task_and_many_grow_the_same_trees(spark, monkeypatch, s):
    rows = data(2500, 5)
    here = fitted(spark, rows, s, seed=3)
    monkeypatch.setattr(B, "HERE_ROWS", 0)
    monkeypatch.setattr(B, "BLOCK_ROWS", 300)
    spread = fitted(spark, rows, s, seed=3)
    monkeypatch.setattr(B, "DIRECT_BYTES", 0)
    assert fitted(spark, rows, s, seed=3) == spread
    assert len(here.trees) == len(spread.trees) and np.allclose(here.losses, spread.losses)
    for a, b in zip(here.trees, spread.trees):
        assert (a.column, a.cut, a.left, a.right) == (b.column, b.cut, b.left, b.right)
        assert np.allclose(a.step, b.step) and np.allclose(a.gain, b.gain) and np.allclose(a.cover, b.cover)
    if s.rows_share == 1 and not s.stop:
        bins = encoded(spread, rows)
        assert np.allclose(spread.raw(bins), plain(rows, spread, s), atol=1e-9)
        for t in spread.trees:  # the weight of the rows below each node
            at = spread.leaf_of(t, bins)
            assert t.cover[0] == pytest.approx(sum(r[5] for r in rows))
            assert all(t.cover[n] == pytest.approx(sum(r[5] for r, k in zip(rows, at) if k == n)) for n in set(at.tolist()))


def test_attributions_work_out_each_case_once(spark, monkeypatch):
    """A leaf's cases are known before the rows: no more of them with more rows, by table or by occurrence, sent along or not."""
    rows = data(400, 8)
    model = fitted(spark, rows, B.Settings(trees=4, depth=5, leaves=12, rate=0.5, stop=0, leaf_rows=5))
    bins = encoded(model, rows)
    want, asked, worth = B.attributions(model, bins), [], B._worth
    shares = [list(B._shares(model, t)) for t in model.trees]
    monkeypatch.setattr(B, "_worth", lambda case, share: asked.append(len(case)) or worth(case, share))
    assert (B.attributions(model, np.concatenate([bins] * 3), shares)[: len(bins)] == want).all() and not asked
    assert np.allclose(B.attributions(model, bins), want) and max(asked) <= 1 << 5
    monkeypatch.setattr(B, "MOST_KNOWN", 0)
    assert np.allclose(B.attributions(model, bins), want)
    monkeypatch.undo()
    frame = spark.createDataFrame(rows, SCHEMA)
    for kept in (0, B.KEPT_CASES):
        monkeypatch.setattr(B, "KEPT_CASES", kept)
        got = sorted(B.attributed(model, frame, ["id"]).collect())
        assert np.allclose([r["attributions"] for r in got], want)


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_trees_of_a_few_rows(spark):
    """One task grows them; a job a level took 8 a tree before."""
    frame = spark.createDataFrame(data(600), SCHEMA)
    n = [jobs_of(spark, f"trees {t}", lambda t=t: B.fit(frame, ["a", "b"], ["c"], "y", "id", B.Settings(trees=t, stop=0), "w")) for t in (2, 30)]
    assert n[0] == n[1]


def test_nodes_that_cannot_be_taken_are_not_summed(spark, monkeypatch):
    """A tree of four leaves asks for the smaller child of three splits at most on a level, not for all of its nodes."""
    asked, sums = [], B._Spread.sums

    def counted(self, tree, nodes):
        asked.append(len(nodes))
        return sums(self, tree, nodes)

    monkeypatch.setattr(B, "HERE_ROWS", 0)
    monkeypatch.setattr(B._Spread, "sums", counted)
    model = fitted(spark, data(3000, 6), B.Settings(trees=2, depth=6, leaves=4, stop=0, leaf_rows=1))
    assert all(sum(n < 0 for n in t.left) == 4 for t in model.trees)
    assert max(asked) <= 3


def test_equal_gains_take_the_first_cut():
    """Two values of a category left: each against the rest is the same split; rounding does not choose."""
    hist = np.zeros((1, 3, 4))
    hist[0, :, 1], hist[0, :, 2] = (3.0, 5.0, 40), (-2.0, 4.0, 40)
    for noise in (1e-12, -1e-12):
        h = hist.copy()
        h[0, 0, 2] += noise
        h[0, 0, 1] -= 3 * noise
        (split,) = B.best_splits(h, np.array([0, 4]), 0, [0], B.Settings())
        assert split[1:3] == (0, 1)


def test_early_stop_and_samples(spark):
    rows = data(3000, 2)
    model = fitted(spark, rows, B.Settings(trees=60, depth=4, rate=0.5, stop=3))
    assert len(model.trees) < 60 and model.losses[0] > min(model.losses)
    assert int(np.argmin(model.losses)) >= len(model.losses) - 4
    y = np.array([r[4] for r in rows])
    some = fitted(spark, rows, B.Settings(trees=12, depth=3, rate=0.3, rows_share=0.7, columns_share=0.67, stop=0))
    assert len({t.column[0] for t in some.trees}) > 1
    for m in (model, some):
        assert ((m.raw(encoded(m, rows)) > 0) == y).mean() > 0.8


def test_odd_rows(spark):
    rows = data(200, 3)
    model = fitted(spark, rows, B.Settings(trees=3, stop=0))
    odd = spark.createDataFrame([(1, None, float("nan"), None, None, None), (2, 1e300, -1e300, "new", None, None)], SCHEMA)
    assert all(0 < r[0] < 1 for r in odd.select(B.probability(model)).collect())
    assert B.fit(odd.where("false"), ["a"], ["c"], "y", "id").raw(np.zeros((2, 2), np.uint16)).tolist() == [0, 0]
    ones = [(*r[:4], 1, r[5]) for r in rows]
    one = fitted(spark, ones, B.Settings())
    assert not one.trees and one.raw(encoded(one, ones))[0] > 10
