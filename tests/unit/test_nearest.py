"""The vector search by tiles against all pairs, with ties and vectors without length, and its memory."""

import tracemalloc

import numpy as np
import pytest

from marlstone.functions import vectors


def _first(keys, docs, query, k, distance):
    with np.errstate(all="ignore"):
        found = docs @ query
        if distance == "cosine":
            found = found / (np.linalg.norm(docs, axis=1) * np.linalg.norm(query))
        elif distance == "l2":
            found = 1 / (1 + np.sqrt(np.maximum((docs * docs).sum(axis=1) + query @ query - 2 * found, 0)))
    found = np.nan_to_num(np.round(found, 6), nan=-np.inf)
    return [(int(keys[x]), round(float(found[x]), 6)) for x in np.lexsort((keys, -found))[:k]]


@pytest.mark.parametrize("distance", vectors.DISTANCES)
def test_tiles_equal_all_pairs(distance):
    rng = np.random.default_rng(3)
    docs = np.round(rng.normal(size=(5_000, 8)), 1)
    docs[1_000:3_500], docs[11] = docs[7], 0
    keys = rng.permutation(5_000)
    best = vectors._Nearest(keys[::16], docs[::16], 10, distance)
    for a in range(0, 5_000, 2_300):
        best.add(keys[a : a + 2_300], docs[a : a + 2_300])
    got = {}
    for rows in best.rows():
        for q, key, score in zip(*rows):
            got.setdefault(q, []).append((int(key), round(float(score), 6)))
    for q, vector in zip(keys[::16], docs[::16]):
        assert got[q] == _first(keys, docs, vector, 10, distance)


def test_memory_does_not_follow_the_batch():
    """One product of 8,192 documents and 4,096 queries alone takes 268 MB."""
    rng = np.random.default_rng(5)
    docs, asked = rng.normal(size=(8_192, 8)), rng.normal(size=(4_096, 8))
    best = vectors._Nearest(np.arange(len(asked)), asked, 10, "l2")
    tracemalloc.start()
    best.add(np.arange(len(docs)), docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
