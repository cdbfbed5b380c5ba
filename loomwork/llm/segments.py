"""Maximal-scoring segments in linear time, shared by the operators that isolate stretches of a text."""

from __future__ import annotations


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All disjoint maximal-scoring segments (start, stop, score) of a sequence, after Ruzzo and Tompa.

    A stack holds candidate segments with the running totals at both ends; a new positive score joins earlier
    candidates for as long as that gives a larger total.
    """
    stack: list[list[float]] = []  # start, stop, total before, total after
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b), after - before) for a, b, before, after in stack]
