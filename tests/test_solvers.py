import itertools
import math

import numpy as np
import pytest

from cohortia.operators import models, reduction, solvers

RNG = np.random.default_rng(3)
X = RNG.normal(size=(60, 6))
Y = ((X[:, 0] - X[:, 1] + RNG.normal(size=60)) > 0).astype(int)


def test_elastic_net_meets_its_optimality_conditions():
    c, ratio = 0.5, 0.5
    m = solvers.elastic_net(X, Y, c, ratio, steps=20000, tol=1e-12)
    z, lam = m.scaler(X), 1 / (c * len(Y))
    g = z.T @ (solvers.sigmoid(z @ m.coef + m.intercept) - Y) / len(Y) + lam * (1 - ratio) * m.coef
    on = m.coef != 0
    assert np.allclose(g[on], -lam * ratio * np.sign(m.coef[on]), atol=1e-6)
    assert (np.abs(g[~on]) <= lam * ratio + 1e-6).all()


def test_svm_separates_and_orders():
    x = np.concatenate([RNG.normal(-2, 0.3, (20, 2)), RNG.normal(2, 0.3, (20, 2))])
    y = np.repeat([0, 1], 20)
    m = solvers.linear_svm(x, y, 1.0)
    assert (m.predict(x) == y).all()
    assert models.auc_of(y, m.proba(x)) == 1.0


def shapley(tree, row, p):
    def value(known, k=0):
        f = tree.feature[k]
        if f < 0:
            return tree.value[k]
        if f in known:
            return value(known, tree.left[k] if row[f] <= tree.threshold[k] else tree.right[k])
        return sum(value(known, c) * tree.cover[c] for c in (tree.left[k], tree.right[k])) / tree.cover[k]

    out = np.zeros(p)
    for f in range(p):
        rest = [i for i in range(p) if i != f]
        for n in range(p):
            for s in itertools.combinations(rest, n):
                w = math.factorial(n) * math.factorial(p - n - 1) / math.factorial(p)
                out[f] += w * (value({*s, f}) - value(set(s)))
    return out


@pytest.mark.parametrize("boosted", [False, True])
def test_tree_attributions_match_all_subsets_and_add_up(boosted):
    x = X[:, :4]
    m = solvers.boosted_trees(x, Y, 3, 3, 0.3) if boosted else solvers.random_forest(x, Y, 3, 4, 2)
    phi = m.attributions(x[:5])
    for i in range(5):
        own = m.scale * sum(shapley(t, x[i], 4) for t in m.trees)
        assert np.allclose(phi[i], own, atol=1e-9)
    assert np.allclose(phi.sum(axis=1) + m.expectation(), m.margin(x[:5]))


def test_forest_respects_leaf_and_depth():
    m = solvers.random_forest(X, Y, 5, 2, 8)
    for t in m.trees:
        assert (t.cover[t.feature < 0] >= 8).all()
        assert len(t.feature) <= 7


def test_auc_counts_ties_half():
    p = np.round(RNG.random(60), 1)
    pairs = [(a > b) + 0.5 * (a == b) for a in p[Y == 1] for b in p[Y == 0]]
    assert models.auc_of(Y, p) == pytest.approx(np.mean(pairs))


def test_average_linkage_against_a_naive_version():
    d = np.abs(np.corrcoef(RNG.normal(size=(8, 20))))
    d = 1 - d
    cut = 0.75
    groups = [[i] for i in range(8)]
    while len(groups) > 1:
        best = min(((np.mean([d[a, b] for a in g for b in h]), i, j) for (i, g), (j, h) in itertools.combinations(enumerate(groups), 2)))
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    label = reduction.average_linkage(d, cut)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(label == k)) for k in set(label)}
    assert reduction.average_linkage(np.zeros((1, 1)), 0.1).tolist() == [0]


def test_linked_features_aren_t_components():
    d = np.array([[0, 0.1, 0.5], [0.1, 0, 0.1], [0.5, 0.1, 0]])
    assert len(set(reduction.average_linkage(d, 0.1))) == 2
