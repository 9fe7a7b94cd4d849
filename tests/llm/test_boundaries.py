import numpy as np

from kestrel.llm.batches import Plan, boundaries


def _padding(sizes, counts, bounds):
    top = np.array(bounds)[np.searchsorted(bounds, sizes)]
    return int(((top - sizes) * counts).sum())


def _least(sizes, counts, buckets):
    """Row by row over all starts of the last bucket."""
    c, t = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    best = c[1:] * sizes - t[1:]
    for _ in range(buckets - 1):
        new = best.copy()
        for j in range(1, len(sizes)):
            i = np.arange(1, j + 1)
            new[j] = min(best[j], (best[i - 1] + (c[j + 1] - c[i]) * sizes[j] - (t[j + 1] - t[i])).min())
        best = new
    return int(best[-1])


def test_boundaries_have_least_padding():
    rng = np.random.default_rng(5)
    for n, buckets in ((1, 8), (3, 8), (8, 8), (40, 1), (60, 4), (700, 8), (1500, 8)):
        sizes = np.sort(rng.choice(20_000, n, replace=False) + 1).astype(np.int64)
        counts = (rng.pareto(0.7, n) * 3 + 1).astype(np.int64)
        bounds = boundaries(sizes, counts, buckets)
        assert len(bounds) == min(n, buckets) and bounds[-1] == sizes[-1]
        assert _padding(sizes, counts, bounds) == _least(sizes, counts, min(n, buckets))


def _batches_of(plan):
    out = {}
    for size, first, last, batch, per in plan.segments:
        for k in range(-(-(last - first) // per)):
            out.setdefault(batch + k, []).append(size)
    return out


def test_buckets_shape_the_batches():
    """A plan without its buckets would be another one, and a batch takes items of its own bucket and of shorter ones only."""
    rng = np.random.default_rng(6)
    hist = {int(s): int(n) for s, n in zip(rng.choice(900, 300, replace=False) + 1, rng.integers(1, 60, 300))}
    plans = {b: Plan(hist, 1000, 40, b) for b in (1, 2, 8)}
    assert len({tuple(p.segments) for p in plans.values()}) == 3
    p = plans[8]
    uppers = list(reversed(p.bounds))
    for batch, sizes in _batches_of(p).items():
        bucket = max(k for k, first in enumerate(p.first_batch) if first <= batch)
        assert max(sizes) <= uppers[bucket]
        assert any(bucket + 1 == len(uppers) or s > uppers[bucket + 1] for s in sizes)  # opened by an item of its own bucket
    alone = Plan(hist, 1000, 40, 8, top_up=False)
    for batch, sizes in _batches_of(alone).items():
        bucket = max(k for k, first in enumerate(alone.first_batch) if first <= batch)
        assert bucket + 1 == len(uppers) or min(sizes) > uppers[bucket + 1]
    assert p.batches < alone.batches


def test_more_sizes_than_any_former_limit():
    hist = {s: 3 for s in range(1, 2001)}
    p = Plan(hist, 8000, 128, 8)
    sizes, counts = np.array(sorted(hist)), np.full(2000, 3)
    assert _padding(sizes, counts, p.bounds) == _least(sizes, counts, 8)
