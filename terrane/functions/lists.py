"""Small helpers on Python lists."""

from __future__ import annotations


def flatten(xs) -> list:
    """The items of nested lists in order; what is no list, tuples among it, counts as one item."""
    if not isinstance(xs, list):
        return [xs]
    out, todo = [], [iter(xs)]
    while todo:
        for x in todo[-1]:
            if isinstance(x, list):
                todo.append(iter(x))
                break
            out.append(x)
        else:
            todo.pop()
    return out
