"""A minimal acyclic transducer from byte strings to entry numbers, built and walked by arrays.

The trie of the sorted strings is merged bottom-up: states of one height with the same transitions
become one, so that strings share suffixes as well as prefixes. A transition's output is the count
of strings that sort before those behind it; the outputs along a string add up to its number among
the sorted strings, which is where its token ids stand.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


def _mix(values: np.ndarray, by: np.uint64) -> np.ndarray:
    out = (values + np.uint64(1)) * by
    out ^= out >> np.uint64(31)
    out *= by
    return out ^ (out >> np.uint64(29))


def build_transducer(strings: Sequence[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the minimal automaton of distinct, sorted, non-empty strings without zero bytes."""
    if not strings:
        return {
            "keys": np.zeros(0, np.int64),
            "targets": np.zeros(0, np.int32),
            "outputs": np.zeros(0, np.int32),
            "final": np.zeros(1, bool),
        }
    width = max(map(len, strings))
    table = np.array(strings, dtype=f"S{width}").view(np.uint8).reshape(len(strings), width)
    length = np.array([len(s) for s in strings])
    common = np.zeros(len(strings), np.int64)
    differs = table[1:] != table[:-1]
    common[1:] = differs.argmax(axis=1)
    # State of each string's prefix of each size; a prefix is new where the string before lacks it.
    place = np.zeros((len(strings), width + 1), np.int64)
    states = 1
    parents, labels, children = [], [], []
    for depth in range(1, width + 1):
        new = (depth > common) & (depth <= length)
        place[:, depth] = states + np.cumsum(new) - 1
        parents.append(place[new, depth - 1])
        labels.append(table[new, depth - 1])
        children.append(place[new, depth])
        states += int(new.sum())
    parent, label, child = map(np.concatenate, (parents, labels, children))
    final = np.zeros(states, bool)
    final[place[np.arange(len(strings)), length]] = True
    height = np.zeros(states, np.int64)
    for depth in range(width, 0, -1):
        here = depth <= length
        np.maximum.at(height, place[here, depth], length[here] - depth)
    height[0] = length.max()
    merged, count = _merge(states, parent, label, child, final, height)
    # The root's class is made last; one state stands for each class.
    one = np.full(count, -1)
    one[merged[::-1]] = np.arange(states)[::-1]
    is_one = one[merged[parent]] == parent
    key = merged[parent[is_one]] * 256 + label[is_one]
    target = merged[child[is_one]]
    order = np.argsort(key)
    key, target = key[order], target[order]
    accept = final[one]
    # Strings behind each class: classes are numbered by height, so targets come before sources.
    behind = accept.astype(np.int64)
    source = key // 256
    first = np.searchsorted(source, np.arange(count))
    last = np.searchsorted(source, np.arange(count), side="right")
    for state in range(count):
        behind[state] += behind[target[first[state] : last[state]]].sum()
    passed = np.cumsum(behind[target]) - behind[target]
    outputs = passed - passed[first[source]] + accept[source]
    return {
        "keys": key,
        "targets": target.astype(np.int32),
        "outputs": outputs.astype(np.int32),
        "final": accept,
    }


def _merge(states, parent, label, child, final, height) -> tuple[np.ndarray, int]:
    """The class of each state, numbered from the leaves up, and how many classes there are."""
    merged = np.full(states, -1, np.int64)
    by_height = np.argsort(height[parent], kind="stable")
    parent, label, child = parent[by_height], label[by_height], child[by_height]
    edge_from = np.searchsorted(height[parent], np.arange(height.max() + 2))
    order = np.argsort(height, kind="stable")
    state_from = np.searchsorted(height[order], np.arange(height.max() + 2))
    one = np.zeros(states, np.uint64)
    two = np.zeros(states, np.uint64)
    count = 0
    for h in range(int(height.max()) + 1):
        edges = slice(edge_from[h], edge_from[h + 1])
        value = (merged[child[edges]] * 256 + label[edges]).astype(np.uint64)
        np.add.at(one, parent[edges], _mix(value, _A))
        np.add.at(two, parent[edges], _mix(value, _B))
        here = order[state_from[h] : state_from[h + 1]]
        marks = np.stack([one[here], two[here], final[here].astype(np.uint64)], axis=1)
        _, number = np.unique(marks, axis=0, return_inverse=True)
        merged[here] = count + number.reshape(-1)
        count += int(number.max(initial=-1)) + 1
    return merged, count


def walk(
    automaton: dict[str, np.ndarray], data: np.ndarray, begins: np.ndarray, ends: np.ndarray
) -> np.ndarray:
    """The entry number of each span of bytes, or -1 for spans that are no entry."""
    keys, targets, outputs = automaton["keys"], automaton["targets"], automaton["outputs"]
    found = np.full(len(begins), -1, np.int64)
    if not len(keys):
        return found
    length = ends - begins
    root = len(automaton["final"]) - 1
    left = np.arange(len(begins))
    state = np.full(len(begins), root, np.int64)
    number = np.zeros(len(begins), np.int64)
    at = 0
    while len(left):
        over = length[left] == at
        done = over & automaton["final"][state]
        found[left[done]] = number[done]
        left, state, number = left[~over], state[~over], number[~over]
        key = state * 256 + data[begins[left] + at]
        edge = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[edge] == key
        edge = edge[there]
        left, state, number = left[there], targets[edge].astype(np.int64), number[there] + outputs[edge]
        at += 1
    return found
