"""The forest at depths of large tables: pairs at the threshold share a leaf, and copies stay as few as ``shape`` says."""

import math

import numpy as np
import pytest

from sparkloom.llm.embeddings import Trees, shape


@pytest.mark.parametrize("length", [8, 16, 64, 256])
@pytest.mark.parametrize("depth", [9, 14])
def test_recall_of_pairs_at_the_threshold(length, depth):
    rng = np.random.default_rng(length + depth)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sample = unit(rng.normal(size=(20_000, length)))
    trees, margin = shape(depth)
    forest = Trees({length: sample}, trees, depth, margin)
    a = unit(rng.normal(size=(2_000, length)))
    aside = rng.normal(size=a.shape)
    aside = unit(aside - (aside * a).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * aside
    met, copies = np.zeros(len(a), dtype=bool), 0
    for tree in range(trees):
        of_a, of_b = ((rows.astype(np.int64) << depth) + leaves for rows, leaves in (forest.places(x, tree) for x in (a, b)))
        copies += len(of_a)
        met[np.intersect1d(of_a, of_b) >> depth] = True
    assert met.mean() >= 0.99
    assert copies / len(a) <= 1.5 * trees * (1 + math.erf(margin / math.sqrt(2))) ** depth


def test_shared_bits_tell_common_leaves():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(300, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    forest = Trees({8: unit}, 2, 4, 0.3)
    rows, leaves = forest.places(unit, 1)
    sets = [set(leaves[rows == i]) for i in range(300)]
    for below in (None, 9):
        bits = forest.shared(unit, 1, below)
        for i in range(0, 300, 7):
            for j in range(i):
                both = {x for x in sets[i] & sets[j] if below is None or x < below}
                assert bool((bits[i] & bits[j]).any()) == bool(both)
