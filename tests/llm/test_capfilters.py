"""Links, counts and components against all pairs; vectors that take no part."""

import numpy as np

import pytest

from strandloom.llm.capfilters import CODES, COSINE, ProductCode, linked

KIND = "vec_id long, embedding array<float>, label int, n_links string, cls string"


def brute(rows):
    fine = [i for i, (_, e, lab, *_) in enumerate(rows) if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    unit = {i: (x := np.array(rows[i][1], np.float32).astype(float)) / np.linalg.norm(x) for i in fine}
    for a in fine:
        for b in fine:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and unit[a] @ unit[b] >= COSINE:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], n[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def corpus():
    rng = np.random.default_rng(4)
    rows = []
    for lab in (0, 1, None):
        for _ in range(60):
            c = rng.standard_normal(64)
            for k in range(rng.integers(1, 5)):
                x = c + rng.standard_normal(64) * rng.choice([0, 0.05, 0.12, 0.2])
                rows.append((len(rows), [float(v) for v in x.astype(np.float32)], lab, "x", "y"))
    chain = rng.standard_normal(64)
    for _ in range(40):  # each close to the one before
        chain = chain + rng.standard_normal(64) * 0.14
        rows.append((len(rows), [float(v) for v in chain.astype(np.float32)], 0, "x", "y"))
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 0.0], [1.0, 0.01], [2.0, 0.0]]
    rows += [(len(rows) + i, e, 1, "x", "y") for i, e in enumerate(odd)]
    return rows + [rows[3]]


def test_all_pairs(spark):
    rows = corpus()
    want = brute(rows)
    for block in (1024, 8):
        got = linked(spark.createDataFrame(rows, KIND), block)
        assert sorted(map(tuple, got.collect())) == want


def test_empty(spark):
    assert linked(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize("dim", [64, 384])
def test_pairs_at_the_limit_meet_and_lists_stay_short(dim):
    """Random pairs a little above the limit, the hardest to find, by the lists alone; at two sizes."""
    rng = np.random.default_rng(dim)
    x, z = rng.standard_normal((2, 600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * z
    listed = []
    for n_filters in (2_000, 200_000):
        met, n = np.zeros(600, bool), 0
        for k in range(CODES):
            code = ProductCode(dim, n_filters, k)
            (rows, filters, home_x, least_x), (_, _, home_y, least_y) = code.decode(x), code.decode(y)
            n += len(rows) / 600
            assert set(zip(range(600), home_x)) <= set(zip(rows, filters))
            some = rng.integers(len(rows), size=400)
            assert code.passes(x[rows[some]], filters[some], least_x[rows[some]] - 1e-12).all()
            met |= code.passes(x, home_y, least_x) | code.passes(y, home_x, least_y)
        assert met.mean() >= 0.99
        listed.append(n)
    assert listed[0] < 16 and listed[1] < 2.5 * listed[0]


def test_recall_on_clouds_of_two_sizes(spark):
    for n in (300, 1500):
        rng = np.random.default_rng(n)
        centre = np.repeat(rng.standard_normal((n // 5, 32)), 5, axis=0)
        rows = [(i, [float(v) for v in (c + rng.standard_normal(32) * rng.choice([0.05, 0.12, 0.2])).astype(np.float32)], 0, "x", "y") for i, c in enumerate(centre)]
        got, want = [sum(r[1] for r in rs) for rs in (linked(spark.createDataFrame(rows, KIND)).collect(), brute(rows))]
        assert 0.99 * want <= got <= want
