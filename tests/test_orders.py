"""Feasible orders of a core against all permutations."""

import random
from itertools import permutations

import pytest

from skirmish.plans.policies import agreement_orders


def feasible(order, windows):
    point = float("-inf")
    for i in order:
        low, high = windows.get(i, (float("-inf"), float("inf")))
        point = max(point, low)
        if point > high:
            return False
    return True


@pytest.mark.parametrize("seed", range(40))
def test_equal_to_all_permutations(seed):
    rng = random.Random(seed)
    items = rng.sample(range(100), rng.randint(1, 7))
    pairs = [(x, y, rng.randint(0, 9), rng.randint(0, 9)) for k, x in enumerate(sorted(items)) for y in sorted(items)[k + 1 :] if rng.random() < 0.8]
    windows = {}
    for i in items:
        if rng.random() < 0.8:
            low = rng.randint(0, 20)
            windows[i] = (low, low + rng.randint(0, 12))
    ahead = {(x, y): n for x, y, n, _ in pairs} | {(y, x): n for x, y, _, n in pairs}
    scored = [(-sum(ahead.get((order[i], order[j]), 0) for i in range(len(order)) for j in range(i + 1, len(order))), order) for order in permutations(items) if feasible(order, windows)]
    assert agreement_orders(pairs, items, 2, windows) == [(-score, order) for score, order in sorted(scored)[:2]]


def test_no_feasible_order():
    assert agreement_orders([], [1, 2], 2, {1: (5, 6), 2: (7, 4)}) == []
