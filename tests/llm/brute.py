"""The mix worked out for a dictionary of sources, step by step and without Spark."""

from math import ceil, log


def weights(tokens, alpha):
    total = sum(tokens.values())
    raw = {s: (t / total) ** alpha for s, t in tokens.items() if t}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def entropy(w):
    return -sum(x * log(x) for x in w.values())


def halved(holds):
    a, b = 0.0, 1.0
    for _ in range(50):
        a, b = ((a + b) / 2, b) if holds((a + b) / 2) else (a, (a + b) / 2)
    return a, b


def plan(tokens, budget=None, target=None, limit=None):
    """The exponent and each source's budget; 0 for sources without tokens."""
    some = {s: t for s, t in tokens.items() if t}
    if not some:
        return 1.0, dict.fromkeys(tokens, 0)
    whole = lambda w: ceil(max(t / w[s] for s, t in some.items()) - 1e-6)
    spent = lambda a: budget if budget is not None else whole(weights(some, a))
    most = lambda a: spent(a) * max(w / some[s] for s, w in weights(some, a).items())
    alpha = 1.0
    if target is not None and len(some) > 1 and entropy(weights(some, 1.0)) < target * log(len(some)):
        alpha = halved(lambda a: entropy(weights(some, a)) >= target * log(len(some)))[0]
    if limit is not None and most(alpha) > limit:
        alpha = 1.0 if most(1.0) > limit else halved(lambda a: most(a) > limit)[1]
    w = weights(some, alpha)
    return alpha, {s: int(spent(alpha) * w[s] + 1e-6) if s in w else 0 for s in tokens}
