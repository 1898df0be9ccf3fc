"""BagMinHash signatures of weighted sets: minima of hierarchical Poisson processes over discretised weights.

Element d with whole weight w owns the interval (0, w]. The weight axis is cut into levels (0, 1], (1, 2], (2, 4],
(4, 8] ...; every level of every element has its own seeded Poisson process in time, whose rate is the level's width,
and each of its points has a seeded signature slot and a seeded place in the level. A level that the weight only
partly covers keeps the points whose place lies below the weight, so elements with different weights share exactly
the points of the smaller one. Slot i of the signature is the earliest point that falls to it: two bags agree in a
slot with the probability of their weighted Jaccard similarity. Points are drawn in order of time for all bags of a
batch at once and stop at a horizon beyond which no slot can be undecided; a bag with open slots gets a later one.
"""

from __future__ import annotations

import numpy as np

from flowsentry.llm.words import mixed

_STEP, _SLOT = np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)


def _unit(x: np.ndarray) -> np.ndarray:
    """Even numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def levels(element: np.ndarray, weight: np.ndarray, owner: np.ndarray):
    """The (seed, low, width, weight, owner) of every level that some part of a weight covers."""
    parts = []
    low, width, level = 0.0, 1.0, np.uint64(1)
    pick = np.arange(len(element))
    with np.errstate(over="ignore"):
        while len(pick):
            parts.append((mixed(element[pick] + level * _STEP), np.full(len(pick), low), np.full(len(pick), width),
                          weight[pick], owner[pick]))
            low, width, level = low + width, low + width, level + np.uint64(1)
            pick = pick[weight[pick] > low]
    return [np.concatenate(x) for x in zip(*parts)]


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, bags: int, slots: int) -> np.ndarray:
    """bags x slots; `owner` tells the bag of each (element, weight). An empty bag's slots are all 0."""
    out = np.zeros((bags, slots), np.uint64)
    if not len(element):
        return out
    total = np.bincount(owner, weights=weight, minlength=bags)
    seed, low, width, weight, owner = levels(element, weight, owner)
    best = np.full(bags * slots, np.inf)
    tag = np.zeros(bags * slots, np.uint64)
    horizon = slots * (np.log(slots) + 3.0) / np.maximum(total, 1.0)
    state, time = seed, np.zeros(len(seed))
    waiting = []  # processes whose next point lies beyond their bag's horizon
    while len(seed):
        with np.errstate(over="ignore"):
            state = mixed(state + _STEP)
            slot = mixed(state ^ _SLOT)
        time = time - np.log(_unit(state)) / width
        due = time <= horizon[owner]
        if not due.all():
            late = ~due
            waiting.append([x[late] for x in (seed, low, width, weight, owner, state, time, slot)])
            seed, low, width, weight, owner, state, time, slot = (
                x[due] for x in (seed, low, width, weight, owner, state, time, slot))
        _place(best, tag, low, width, weight, owner, state, time, slot, slots)
        if len(seed) or not waiting:
            continue
        open_bags = np.zeros(bags, bool)
        open_bags[np.flatnonzero(np.isinf(best)) // slots] = True
        open_bags &= total > 0
        if not open_bags.any():
            break
        horizon[open_bags] *= 2
        seed, low, width, weight, owner, state, time, slot = (np.concatenate(x) for x in zip(*waiting))
        go = open_bags[owner]
        due = go & (time <= horizon[owner])
        rest = go & ~due
        waiting = [[x[rest] for x in (seed, low, width, weight, owner, state, time, slot)]]
        seed, low, width, weight, owner, state, time, slot = (
            x[due] for x in (seed, low, width, weight, owner, state, time, slot))
        _place(best, tag, low, width, weight, owner, state, time, slot, slots)
        if not len(seed):  # the horizon is still too near: look again
            seed, low, width, weight, owner, state, time, slot = (np.zeros(0, x.dtype) for x in waiting[0])
            while not len(seed):
                horizon[open_bags] *= 2
                parts = waiting[0]
                due = parts[6] <= horizon[parts[4]]
                seed, low, width, weight, owner, state, time, slot = (x[due] for x in parts)
                waiting = [[x[~due] for x in parts]]
            _place(best, tag, low, width, weight, owner, state, time, slot, slots)
    out[:] = tag.reshape(bags, slots)
    return out


def _place(best, tag, low, width, weight, owner, state, time, slot, slots) -> None:
    """Enter points into the slots that they reach first."""
    whole = low + width <= weight
    kept = whole | (np.ceil(low + width * _unit(mixed(slot))) <= weight)
    cell = owner * slots + (slot % np.uint64(slots)).astype(np.int64)
    ahead = kept & (time < best[cell])
    cell, time, state = cell[ahead], time[ahead], state[ahead]
    order = np.argsort(-time, kind="stable")  # the earliest is written last
    best[cell[order]], tag[cell[order]] = time[order], state[order]
