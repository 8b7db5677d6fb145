"""Plain Python and numpy for what the operators are held against."""

import math
import re

import numpy as np

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def without_repeats(rows):
    """Texts by (doc_id, text) and lines removed, of rows with distinct (doc_id, text): windows of three lines, and of one or two with over 50 words."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for width in (1, 2, 3):
            for k in range(len(lines) - width + 1):
                w = tuple(lines[k : k + width])
                if width < 3 and len(SEP.findall("\n".join(w))) <= 50:
                    continue
                d0, k0 = seen.setdefault(w, (i, k))
                if (d0, k0) != (i, k):
                    gone |= set(range(max(k, k0 + width) if d0 == i else k, k + width))
        out[(i, t)] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def plain_vector(text):
    """The eighteen statistics of a text, counted one by one."""
    w = 50.0
    words, lines = text.split(), text.split("\n")
    if not words:
        return [0.0] * 18
    n, letters, distinct = len(words), sum(len(x) for x in words), set(words)
    full = [x for x in lines if x != ""]
    root = lambda k, of, usual=0.0, weight=w: math.sqrt((k + usual * weight) / (of + weight))
    count = lambda chars: sum(c in chars for c in text)
    latin_capitals = [c for c in text if "A" <= c <= "Z" or ("\u00c0" <= c <= "\u00de" and c != "\u00d7")]
    ends = 0
    for x in words:
        tail = x[len(x.rstrip("#$%&*!|@^~")) :]
        ends += tail != ""
    return [
        math.log(n + w), math.log((letters + 5 * w) / (n + w)), root(len(latin_capitals), letters, 0.03, 5 * w),
        root(count("0123456789"), letters, 0, 5 * w), root(count("#$%&*@^~<>{}[]\\|_=+/"), letters, 0, 5 * w),
        root(count(".,"), n, 0.15), root(sum(not any(c.isalnum() for c in x) for x in words), n), root(count("!"), n), root(ends, n),
        root(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), math.log((len(distinct) + w) / (n + w)) / math.log(n + w),
        root(max(words.count(x) for x in distinct) - 1, n, 0.04), math.log((n + w) / (len(lines) + w / 20)),
        root(len(full) - len(set(full)), len(lines), 0, 3), root(sum(len(x) == 1 for x in distinct), len(distinct)),
        root(sum(len(x) <= 4 for x in words), n, 0.4), root(sum(len(c.encode()) - 1 for c in text), len(text), 0.01, 5 * w),
        root(len(text) - letters - n + 1, n),
    ]


def plain_scores(texts, labels):
    """Scores by two shrunk Gaussians, from numpy's means, covariances and solver; ``labels``: None for rows not learnt from."""
    x = np.array([plain_vector(t or "") for t in texts], dtype=np.float32).astype(float)
    own = [x[[k for k, q in enumerate(labels) if q == c]] for c in (0, 1)]
    covs = [np.cov(o.T, bias=True) for o in own]
    sizes = [len(o) for o in own]
    pooled = sum(np.diag(c) * k for c, k in zip(covs, sizes, strict=True)) / sum(sizes)
    density = []
    for o, c in zip(own, covs, strict=True):
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 0.05 * np.diag(np.maximum(pooled, 1e-9))
        z = x - o.mean(0)
        density.append(-0.5 * (z * np.linalg.solve(c, z.T).T).sum(1) - 0.5 * np.linalg.slogdet(c)[1])
    odds = density[1] - density[0] + math.log((sizes[1] + 0.5) / (sizes[0] + 0.5))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
