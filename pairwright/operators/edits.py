"""Edit distances of pairs of ascending token sequences, many pairs at a time: the distance of matching.token_edits.

Tokens that both ends have stand in the same order on either side, at places i and j. A cheapest alignment is a chain of some of them,
and takes as many edits between two as the longer gap has tokens. With the diagonal d = j - i of each, that makes

    2 * edits = n1 + n2 + least over chains of (steps between neighbouring diagonals, from 0 to n2 - n1, less 2 for each token).

Neighbours whose diagonals differ by 1 at most are both in a cheapest chain or neither: to add the other costs 2 at most and gains 2. So
they are one link, with a diagonal to enter by and one to leave by.
"""

from __future__ import annotations

import numpy as np

#: Links of pairs whose chains are sought side by side, and pairs at most.
ABREAST, PAIRS = 1 << 16, 2048
#: Tokens of earlier ends that are looked up at a time.
TOKENS = 1 << 16


def links(diagonals: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Diagonals to enter and to leave by, cost (steps inside less 2 for each token), and how many links each pair has. diagonals: of the
    common tokens, counts for each pair."""
    ends = np.cumsum(counts)
    if not len(diagonals):
        return diagonals, diagonals, diagonals, counts
    step = np.abs(np.diff(diagonals))
    fresh = np.empty(len(diagonals), bool)
    fresh[0] = True
    np.greater(step, 1, out=fresh[1:])
    fresh[(ends - counts)[counts > 0]] = True
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(diagonals)) - 1
    walked = np.concatenate(([0], np.cumsum(step, dtype=np.int64)))
    cost = (walked[last] - walked[at] - 2 * (last - at + 1)).astype(np.int32)
    return diagonals[at], diagonals[last], cost, np.diff(np.searchsorted(at, ends), prepend=0)


def cheapest(enter: np.ndarray, leave: np.ndarray, cost: np.ndarray, counts: np.ndarray, end: np.ndarray, kind: type) -> np.ndarray:
    """The least sum of steps and costs of a chain of links from diagonal 0 to `end`, for each pair; kind: a type that holds all sums."""
    out = np.empty(len(counts), np.int64)
    enter, leave, cost = (np.append(x, 0).astype(kind) for x in (enter, leave, cost))
    begins, goals = np.cumsum(counts) - counts, end.astype(kind)
    order = np.argsort(-counts, kind="stable")
    a = 0
    while a < len(order):
        many = int(counts[order[a]])
        mine = order[a : a + min(PAIRS, max(16, ABREAST // (many + 1)))]
        a += len(mine)
        goal = goals[mine]
        place = np.arange(many)[:, None]
        void = place >= counts[mine]
        where = begins[mine] + place
        where[void] = len(enter) - 1
        into, price = enter[where], cost[where]
        off, best, work = (np.zeros((many + 1, len(mine)), kind) for _ in range(3))
        off[1:] = leave[where]
        if void.any():  # a link at the end that costs nothing changes nothing
            np.copyto(into, goal, where=void)
            np.copyto(off[1:], goal, where=void)
        for k in range(many + 1):
            t = work[: k + 1]
            np.subtract(off[: k + 1], into[k] if k < many else goal, out=t)
            np.abs(t, out=t)
            np.add(t, best[: k + 1], out=t)
            least = np.minimum.reduce(t, axis=0)
            if k < many:
                np.add(least, price[k], out=best[k + 1])
        out[mine] = least
    return out


def distances(enter: np.ndarray, leave: np.ndarray, cost: np.ndarray, counts: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The edits of pairs from their links and the tokens of either end."""
    if not len(counts):
        return np.empty(0, np.int64)
    kind = np.int16 if int((n1 + n2).max()) < 10_000 else np.int32
    return (cheapest(enter, leave, cost, counts, n2 - n1, kind) + n1 + n2) // 2


class Finder:
    """Common tokens of one sequence with others. numbers: of tokens, from 1; tokens with number 0 are in no other sequence."""

    def __init__(self, numbers: int):
        self.marks = [np.zeros(numbers + 1, kind) for kind in (np.int16, np.int32)]  # place in the sequence, from 1

    def links(self, late: np.ndarray, flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """The links of `late` with each part of flat."""
        mark = self.marks[len(late) >= 1 << 15]
        mark[late] = np.arange(1, len(late) + 1)
        mark[0] = 0
        size = ends - begins
        upto = np.cumsum(size)
        found, counts, at = [], [], 0
        while at < len(size):
            done = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + TOKENS, "right")))
            tokens = np.concatenate([flat[a:b] for a, b in zip(begins[at:to].tolist(), ends[at:to].tolist(), strict=True)], dtype=np.int64)
            got = mark.take(tokens, mode="clip")
            common = got != 0
            hit = np.flatnonzero(common)
            stops = upto[at:to] - done
            many = np.diff(np.searchsorted(hit, stops), prepend=0)
            hit -= np.repeat(stops - size[at:to], many)
            found.append(np.subtract(got[common], hit + 1, dtype=np.int32, casting="unsafe"))
            counts.append(many)
            at = to
        mark[late] = 0
        return links(np.concatenate(found), np.concatenate(counts))
