"""Completable paths through reached states against an exhaustive search."""

import numpy as np
import pytest

from skirmish.operators import paths


def brute(rows, length, copies):
    """Per group, the path that takes the most supported completable step from each state, by walking all states."""
    out = {}
    for hero in {h for h, _, _ in rows}:
        counts = {}
        for h, path, w in rows:
            state = ()
            for step in path[:length] if h == hero else ():
                if state.count(step) == copies:
                    break
                counts[state, step] = counts.get((state, step), 0) + w
                state = tuple(sorted((*state, step)))

        def done(state):
            return len(state) == length and all(state.count(x) == copies for x in state)

        found = paths.supported_path(counts, done)
        if found:
            out[hero] = found
    return out


@pytest.mark.parametrize(("length", "copies", "kinds"), [(6, 2, 3), (4, 1, 4), (8, 2, 4)])
def test_equal_to_exhaustive_search(spark, length, copies, kinds):
    rng = np.random.default_rng(length)
    rows = [(int(rng.integers(0, 6)), [int(x) for x in rng.integers(1, kinds + 1, rng.integers(0, length + 3))], int(rng.integers(1, 9))) for _ in range(120)]
    rows += [(0, [int(x) for x in rng.permutation(np.repeat(np.arange(1, kinds + 1), copies))], 1) for _ in range(3)] + [(9, [1, 1, 1], 5)]
    df = spark.createDataFrame(rows, "hero int, path array<int>, w int")
    found = {}
    for r in sorted(paths.completable_paths(df, "hero", "path", "w", length, copies).collect()):
        found.setdefault(r["hero"], []).append((r["step"], r["support"]))
    want = brute(rows, length, copies)
    assert found == want and 0 in want and 9 not in want
