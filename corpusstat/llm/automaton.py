"""Generalised suffix automaton over integer tokens, and matching statistics against it."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np


def build(texts: Iterable[Sequence[int]]) -> tuple[list[dict], list[int], list[int]]:
    """(transitions, suffix links, lengths) of the automaton of all substrings of the texts. State 0 is the root."""
    step: list[dict] = [{}]
    link, length = [-1], [0]

    def split(p: int, token: int, q: int) -> int:
        clone = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and step[p].get(token) == q:
            step[p][token] = clone
            p = link[p]
        link[q] = clone
        return clone

    for text in texts:
        last = 0
        for token in text:
            q = step[last].get(token)
            if q is not None:
                last = q if length[q] == length[last] + 1 else split(last, token, q)
                continue
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and token not in step[p]:
                step[p][token] = new
                p = link[p]
            if p >= 0:
                q = step[p][token]
                link[new] = q if length[q] == length[p] + 1 else split(p, token, q)
            last = new
    return step, link, length


def flat(automaton: tuple[list[dict], list[int], list[int]], tokens: int) -> dict:
    """The automaton as arrays, for tokens below a number: transitions sorted by state * tokens + token, links and lengths. That is some
    40 bytes a state, a twentieth of the dictionaries."""
    step, link, length = automaton
    keys = np.array([s * tokens + t for s, d in enumerate(step) for t in d], np.int64)
    to = np.array([q for d in step for q in d.values()], np.int32)
    order = np.argsort(keys)
    return {"keys": keys[order], "to": to[order], "link": np.array(link, np.int32), "length": np.array(length, np.int32), "tokens": tokens}


def statistics(flat: dict, tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
    """For each token the state and the length of the longest suffix read so far that occurs in the automaton's texts."""
    keys, to, link, length = (memoryview(flat[k]) for k in ("keys", "to", "link", "length"))
    size, n = flat["tokens"], len(keys)
    state = matched = 0
    for token in tokens:
        while True:
            key = state * size + token
            at = bisect_left(keys, key)
            if at < n and keys[at] == key:
                state = to[at]
                matched += 1
                break
            if not state:
                matched = 0
                break
            state = link[state]
            matched = length[state]
        yield state, matched
