"""Trees against a plain search over sorted lists."""

import numpy as np
import pytest

from sigmaloom.operators import trees


def _impurity(y, classify):
    if classify:
        return len(y) - sum(np.sum(y == v) ** 2 for v in set(y)) / len(y)
    return float(((y - y.mean()) ** 2).sum())


def _grow(x, y, classify, depth, min_leaf, node=1, most=4):
    """{node: (n, impurity, variable, threshold, gain)} of the tree."""
    out, best = {}, None
    own = _impurity(y, classify)
    if depth < most and len(y) >= 2 * min_leaf and own > 1e-12:
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for low, high in zip(values[:-1], values[1:]):
                left = x[:, j] <= low
                if min(left.sum(), (~left).sum()) >= min_leaf:
                    gain = round(own - _impurity(y[left], classify) - _impurity(y[~left], classify), 8)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, j, (low + high) / 2
    out[node] = (len(y), own, *(best[1:] if best else (None, None)), best[0] if best else None)
    if best:
        left = x[:, best[1]] <= best[2]
        out |= _grow(x[left], y[left], classify, depth + 1, min_leaf, 2 * node, most) | _grow(x[~left], y[~left], classify, depth + 1, min_leaf, 2 * node + 1, most)
    return out


@pytest.mark.parametrize("classify", [True, False])
def test_tree_and_predictions_equal_a_plain_search(spark, classify):
    rng = np.random.default_rng(5)
    x = np.column_stack([np.round(rng.normal(size=300), 1), rng.integers(0, 6, 300), rng.normal(size=300)])
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=300) > 0.3, "a", np.where(x[:, 1] > 3, "b", "c")) if classify else x[:, 0] * 2 + (x[:, 1] > 3) + 0.1 * rng.normal(size=300)
    rows = [(k, float(a), float(b), float(c), v.item()) for k, ((a, b, c), v) in enumerate(zip(x, y, strict=True))]
    kind = "string" if classify else "double"
    odd = [(900, None, 1.0, 1.0, y[0].item()), (901, 1.0, float("nan"), 1.0, y[0].item()), (902, 1.0, 1.0, float("inf"), y[0].item()), (903, 1.0, 1.0, 1.0, None)]
    frame = spark.createDataFrame(rows + odd, f"k long, u double, v double, w double, y {kind}").repartition(4)
    tree, scored = trees.fit_tree(frame, "y", ["u", "v", "w"], classify, 4, 7)
    got, want = {r["node"]: r for r in tree.collect()}, _grow(x, y, classify, 0, 7)
    assert set(got) == set(want)
    for k, (n, own, j, threshold, gain) in want.items():
        r = got[k]
        assert (r["n"], r["variable"], r["is_leaf"], r["depth"], r["parent"]) == (n, None if j is None else "uvw"[j], j is None, k.bit_length() - 1, k // 2 or None)
        assert r["impurity"] == pytest.approx(own / n if classify else own, abs=1e-6)
        if j is not None:
            assert r["threshold"] == pytest.approx(threshold) and r["gain"] == pytest.approx(gain / n if classify else gain, abs=1e-6)
    placed = {r["k"]: r for r in scored.collect()}
    assert set(placed) == set(range(300))
    for k in range(300):
        node = 1
        while want[node][2] is not None:
            node = 2 * node + (x[k, want[node][2]] > want[node][3])
        inside = y[[q for q in range(300) if placed[q]["node"] == node]]
        assert placed[k]["node"] == node
        if classify:
            assert placed[k]["predicted"] == max(sorted(set(inside)), key=lambda v: np.sum(inside == v))
        else:
            assert float(placed[k]["predicted"]) == pytest.approx(inside.mean())
    assert sum(r["importance"] for r in trees.importance(tree).collect()) == pytest.approx(1.0)


def test_trees_without_splits_and_without_rows(spark):
    frame = spark.createDataFrame([(float(k), "a" if k % 2 else "b") for k in range(20)], "x double, y string")
    same, rows = trees.fit_tree(frame.where("y = 'a'"), "y", ["x"], min_leaf=2)
    assert [(r["node"], r["is_leaf"], r["prediction"]) for r in same.collect()] == [(1, True, "a")] and rows.where("predicted = 'a'").count() == 10
    none, rows = trees.fit_tree(frame.limit(3), "y", ["x"])
    assert none.count() == 0 and rows.count() == 0
    assert trees.fit_tree(frame.limit(0), "y", ["x"])[0].count() == 0
