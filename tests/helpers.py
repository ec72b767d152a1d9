"""Plain NumPy versions of the metrics."""

import numpy as np


def auroc(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    p, n = s[y == 1], s[y == 0]
    if not len(p) or not len(n):
        return None
    return float(((p[:, None] > n[None]).sum() + 0.5 * (p[:, None] == n[None]).sum()) / (len(p) * len(n)))


def average_precision(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    if not y.sum():
        return None
    out, before = 0.0, 0
    for t in sorted(set(s.tolist()), reverse=True):
        hit = s >= t
        tp = int(y[hit].sum())
        out += (tp - before) * tp / hit.sum()
        before = tp
    return out / y.sum()


def roc(y, s):
    """(fp, tp, threshold) in order, without points on a line with both neighbours, then the leading row."""
    y, s = np.asarray(y), np.asarray(s, float)
    pts = [(int((1 - y)[s >= t].sum()), int(y[s >= t].sum()), t) for t in sorted(set(s.tolist()), reverse=True)]
    keep = [i for i in range(len(pts)) if i in (0, len(pts) - 1) or any(pts[i - 1][k] - 2 * pts[i][k] + pts[i + 1][k] for k in (0, 1))]
    return [(0, 0, float("inf"))] + [pts[i] for i in keep]


def moving_mean(x, size):
    back = size // 2
    padded = np.pad(np.asarray(x, float), (back, size - back - 1), mode="symmetric")
    return np.array([padded[i : i + size].mean() for i in range(len(x))])
