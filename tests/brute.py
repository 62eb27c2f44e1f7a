"""Plain NumPy versions of the evaluators, on the full universe."""

import numpy as np


def best(edges):
    out = {}
    for a, b, w in edges:
        if a != b:
            out[a, b] = max(out.get((a, b), 0.0), abs(w))
    return out


def genes_of(gt):
    return sorted({g for e in gt for g in e[:2]})


def universe(gt):
    genes = genes_of(gt)
    return [(a, b) for a in genes for b in genes if a != b]


def vectors(edges, gt):
    score = best(edges)
    true = {(e[0], e[1]) for e in gt}
    pairs = universe(gt)
    return np.array([score.get(p, 0.0) for p in pairs]), np.array([p in true for p in pairs])


def cumulative(score, label):
    tp, n = [0], [0]
    for s in sorted(set(score), reverse=True):
        tp.append(tp[-1] + int(label[score == s].sum()))
        n.append(n[-1] + int((score == s).sum()))
    return np.array(tp, float), np.array(n, float)


def trapezoid(y, x):
    return float((np.diff(x) * (y[1:] + y[:-1]) / 2).sum())


def auprc(edges, gt):
    score, label = vectors(edges, gt)
    if not label.any():
        return None
    tp, n = cumulative(score, label)
    precision = np.concatenate([[1.0], tp[1:] / n[1:]])
    return trapezoid(precision, tp / tp[-1])


def auroc(edges, gt):
    score, label = vectors(edges, gt)
    if not label.any() or label.all():
        return None
    tp, n = cumulative(score, label)
    fp = n - tp
    return trapezoid(tp / tp[-1], fp / fp[-1])


def mid_ranks(values):
    values = np.asarray(values, float)
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values))
    ranks[order] = np.arange(1, len(values) + 1)
    for v in np.unique(values):
        ranks[values == v] = ranks[values == v].mean()
    return ranks
