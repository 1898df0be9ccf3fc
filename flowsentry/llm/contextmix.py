"""Online logistic context mixing of strings of bits, for many sequences (lanes) at once.

For each bit, predictors that are looked up by a hash of their context and of the bits before give log-odds: tables learnt
from the corpus, and one that learns how the lane differs from them at the node. A mixer adds them up with weights from
a set that the bit's place chooses; the weights follow the coding error at once. What the mixer says is refined by an
adaptive curve per bit place. Each lane starts anew with the same weights, so no lane depends on another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
SMOOTH = 0.4
# Weights of tables, then of the local predictor; rates of learning; the curve has a step for every half of log-odds.
WEIGHTS = (0.1, 0.3, 0.55)
RATE, LOCAL_RATE, CURVE_RATE, EDGE = 0.01, 0.25, 0.02, 8
PLACES, NODES = 16, 1024  # sets of weights and curves of a lane, nodes that its own predictor tells apart
LANES, STEPS = 4096, 64  # at a time

_ODD, _MULTIPLY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SHIFT = np.uint64(64 - SLOT_BITS)


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The table slot of a bit: hashed from its 64-bit context and the bits before it (with a leading 1)."""
    with np.errstate(over="ignore"):
        return (((context + node.astype(np.uint64)) * _ODD ^ (context >> np.uint64(29))) * _MULTIPLY >> _SHIFT).astype(np.int64)


def code_slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The table slot of a bit of a code: from a hash of its context and the node, 32 bits each."""
    with np.errstate(over="ignore"):
        return ((context ^ node.astype(np.uint32) * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOT_BITS)


def bit_counts(symbols: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
    """How often each slot of each context's table saw a 0 and a 1: (tables, SLOTS, 2)."""
    out = np.zeros((len(contexts), SLOTS * 2), np.int64)
    symbols = symbols.astype(np.int64)
    for depth in range(8):
        node = (1 << depth) | (symbols >> (8 - depth))
        bit = symbols >> (7 - depth) & 1
        for table, context in zip(out, contexts):
            table += np.bincount(slots(context, node) * 2 + bit, minlength=SLOTS * 2)
    return out.reshape(len(contexts), SLOTS, 2)


def tree_counts(pairs: np.ndarray) -> np.ndarray:
    """What each node of the tree of bits saw, from how often each symbol came: (contexts, 256) to (contexts, 256, 2)."""
    out = np.zeros((*pairs.shape, 2), np.int64)
    for depth in range(8):
        out[:, 1 << depth:2 << depth] = pairs.reshape(len(pairs), 1 << depth, 2, -1).sum(axis=3)
    return out


def log_odds(counts: np.ndarray) -> np.ndarray:
    return np.log((counts[..., 1] + SMOOTH) / (counts[..., 0] + SMOOTH)).astype(np.float32)


def fixed_mix(symbols: np.ndarray, contexts: list[np.ndarray], tables: np.ndarray) -> np.ndarray:
    """The natural log of every symbol's probability by tables alone."""
    symbols, out = symbols.astype(np.int64), np.zeros(len(symbols))
    for depth in range(8):
        node = (1 << depth) | (symbols >> (8 - depth))
        said = sum(w * table[slots(context, node)] for w, table, context in zip(WEIGHTS, tables, contexts))
        out -= np.logaddexp(0, np.where(symbols >> (7 - depth) & 1 == 1, -said, said))
    return out


def coded(symbols: np.ndarray, small: list[tuple[np.ndarray, np.ndarray]], context: np.ndarray, table: np.ndarray,
          starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The natural log of the probability of each lane symbols[start:start + size] of 8-bit symbols, from the highest bit.

    `small`: a number per symbol and the log-odds of every such number's 256 nodes; `context`, `table`: a hashed context
    and its table.
    """
    symbols = symbols.astype(np.int64)

    def look(at):
        symbol, depth = at >> 3, at & 7
        node = (1 << depth) | (symbols[symbol] >> (8 - depth))
        inputs = [values.ravel().take(number[symbol] * 256 + node) for number, values in small]
        return np.stack([*inputs, table.take(slots(context[symbol], node))], axis=1), node, depth, symbols[symbol] >> (7 - depth) & 1

    return online_mix(look, np.tile(np.array(WEIGHTS, np.float32), (PLACES, 1)), starts * 8, sizes * 8)


def online_mix(look: Callable, weights: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The natural log of the probability of each lane of bits start to start + size.

    `look` gives of bits by their numbers what the tables say, the node (below NODES), the place (below PLACES) and
    the bit; `weights` are those to begin with, a row per place.
    """
    order = np.argsort(-sizes, kind="stable")
    if len(order) > LANES:
        out = np.empty(len(order))
        for at in range(0, len(order), LANES):
            part = order[at:at + LANES]
            out[part] = online_mix(look, weights, starts[part], sizes[part])
        return out
    starts, sizes = starts[order], sizes[order]
    lanes, line = len(starts), 4 * EDGE + 1
    total, every = np.zeros(lanes), np.arange(lanes)
    mixers = np.tile(weights.astype(np.float32), (lanes, 1))
    curve = np.tile(1 / (1 + np.exp(-np.arange(-2 * EDGE, 2 * EDGE + 1, dtype=np.float32) / 2)), lanes * PLACES)
    own = np.zeros(lanes * NODES, np.float32)
    for base in range(0, int(sizes.max(initial=0)), STEPS):
        wide = int(np.searchsorted(-sizes, -base, side="left"))
        ahead = base + np.arange(min(STEPS, int(sizes[0]) - base))
        shape = (wide, len(ahead))  # a lane's bits together, as they lie in memory
        inputs, node, place, bits = look(np.minimum(starts[:wide, None] + ahead, (starts + sizes - 1)[:wide, None]).ravel())
        inputs = np.ascontiguousarray(inputs.reshape(*shape, -1).swapaxes(0, 1))
        nodes = node.reshape(shape).T + every[:wide] * NODES
        sets = place.reshape(shape).T + every[:wide] * PLACES
        lines = sets * line + (2 * EDGE)
        ones = np.ascontiguousarray(bits.reshape(shape).T, np.float32)
        shape = shape[::-1]
        coded_as = np.ones(shape, np.float32)
        lives = np.searchsorted(-sizes, -ahead, side="left").tolist()
        for j, live in enumerate(lives):
            x, bit, where, at = inputs[j, :live], ones[j, :live], nodes[j, :live], sets[j, :live]
            w, bias = mixers.take(at, axis=0), own.take(where)
            mix = np.einsum("ij,ij->i", w, x)
            mix += bias
            np.minimum(np.maximum(mix, 0.01 - EDGE, out=mix), EDGE - 0.01, out=mix)
            made = np.exp(-mix)
            made += 1
            np.reciprocal(made, out=made)
            mix *= 2
            cell = np.rint(mix, out=mix).astype(np.int64)
            cell += lines[j, :live]
            near = curve.take(cell)
            np.add(made, near, out=coded_as[j, :live])
            error = bit - made
            x *= (error * np.float32(RATE))[:, None]
            w += x
            mixers[at] = w
            error *= LOCAL_RATE
            error += bias
            own[where] = error
            curve[cell] = near + np.float32(CURVE_RATE) * (bit - near)
        chance = np.log(np.abs((1 - ones) - np.clip(0.5 * coded_as, 1e-5, 1 - 1e-5)))
        for j, live in enumerate(lives):
            total[:live] += chance[j, :live]
    out = np.empty(lanes)
    out[order] = total
    return out


def code_of(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shortest prefix code (Huffman) of two or more symbols: how many bits each has, where they begin among all bits,
    the bits (twice the node that asks, and the answer), and how often each node saw a 0 and a 1."""
    many = len(weights)
    order = np.argsort(weights, kind="stable")
    left, value = order.tolist(), [0] * (2 * many - 1)
    value[:many] = weights.tolist()
    over, side = np.zeros(2 * many - 1, np.int64), np.zeros(2 * many - 1, np.int64)
    counts, leaf, inner = np.zeros((many - 1, 2), np.int64), 0, many
    for made in range(many, 2 * many - 1):
        for answer in (0, 1):
            if leaf < many and (inner >= made or value[left[leaf]] <= value[inner]):
                child, leaf = left[leaf], leaf + 1
            else:
                child, inner = inner, inner + 1
            over[child], side[child] = made, answer
            counts[made - many, answer] = value[child]
            value[made] += value[child]
    depth = [0] * (2 * many - 1)
    for child, node in zip(range(2 * many - 3, -1, -1), over[:-1][::-1].tolist()):
        depth[child] = depth[node] + 1
    sizes = np.array(depth[:many], np.int64)
    begin = np.cumsum(sizes) - sizes
    path, now, place = np.empty(int(sizes.sum()), np.int32), np.arange(many), begin + sizes - 1
    while len(now):
        path[place] = (over[now] - many) * 2 + side[now]
        now = over[now]
        on = now < 2 * many - 2
        now, place = now[on], place[on] - 1
    return sizes, begin, path, counts
