"""Batched name kernels against plain definitions, and how many pairs the bounds leave to score."""

import functools
import random

import numpy as np
import pytest

from chainlens.functions import name_kernels as kernels


def edits(a, b, swaps):
    @functools.cache
    def far(i, j):
        if not i or not j:
            return i + j
        best = min(far(i - 1, j) + 1, far(i, j - 1) + 1, far(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if swaps:  # the last places before, where the letters meet crosswise
            k = next((k for k in range(i - 1, 0, -1) if a[k - 1] == b[j - 1]), 0)
            m = next((m for m in range(j - 1, 0, -1) if b[m - 1] == a[i - 1]), 0)
            if k and m:
                best = min(best, far(k - 1, m - 1) + (i - k - 1) + 1 + (j - m - 1))
        return best

    return 1.0 if not a and not b else 1 - far(len(a), len(b)) / max(len(a), len(b))


def jaro(a, b):
    if not a and not b:
        return 1.0
    reach, taken, left = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == x), None)
        if j is not None:
            taken.add(j)
            left.append(x)
    if not left:
        return 0.0
    m, t = len(left), sum(x != b[j] for x, j in zip(left, sorted(taken))) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def winkler(a, b):
    base, prefix = jaro(a, b), 0
    while prefix < 4 and prefix < min(len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return base + prefix * 0.1 * (1 - base) if base > 0.7 else base


PLAIN = {"lev": lambda a, b: edits(a, b, False), "dam_lev": lambda a, b: edits(a, b, True), "jaro": jaro, "jaro_win": winkler}


def names(seed, count, letters="abcdé\U0001f600"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 11))) for _ in range(count)]


@pytest.mark.parametrize("method", list(PLAIN))
@pytest.mark.parametrize("cells", [4 << 20, 300])
def test_kernels(method, cells, monkeypatch):
    monkeypatch.setattr(kernels, "CELLS", cells)
    left, right = names(1, 500), names(2, 500)
    left += ["", "", "abc", "martha", "ca", "x" * 300]
    right += ["", "abc", "", "marhta", "abc", "x" * 299 + "y"]
    found = kernels.similarities(left, right, method)
    sizes = [0 if len(a) > 100 and method.endswith("lev") else 1 for a in left]  # the plain recursion is for short names
    for a, b, s, short in zip(left, right, found, sizes):
        assert abs(s - (PLAIN[method](a, b) if short else 1 - 1 / 300)) < 1e-12, (a, b)


@pytest.mark.parametrize("method", list(PLAIN))
def test_best_is_lossless(method):
    pool, asked = sorted(set(names(3, 150))), names(4, 60)
    found = kernels.Candidates(pool, method).best(asked, 3)
    for name, own in zip(asked, found):
        expect = sorted(((PLAIN[method](name, c), c) for c in pool), reverse=True)[:3]
        assert [c for _, c in own] == [c for _, c in expect] and np.allclose([s for s, _ in own], [s for s, _ in expect])
    assert kernels.Candidates(["a"], method).best(["a", ""], 3)[0] == [(1.0, "a")]
    assert kernels.Candidates([], method).best(["a"], 3) == [[]]


def test_bounds_leave_few_pairs(spark):
    """Misspelt names against the given ones: fewer than a tenth of all pairs are scored."""
    given = sorted({r[0] for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_name").collect()})
    rng = random.Random(5)
    asked = []
    for name in given[:400]:
        at = rng.randrange(len(name))
        asked.append(name[:at] + rng.choice("aeiou") + name[at + 1:])
    for method in PLAIN:
        pool = kernels.Candidates(given, method)
        hits = pool.best(asked, 1)
        assert pool.scored < len(asked) * len(given) / 10, (method, pool.scored / (len(asked) * len(given)))
        assert np.mean([own[0][1] == name for own, name in zip(hits, given)]) > 0.9
