"""k-way merging with loser trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class _End:
    """Comes after every key."""


def merge(runs: list[Iterable], key=lambda x: x) -> Iterator:
    """The items of sorted runs in order of key; equal keys in the order of their runs. log2(k) comparisons an item."""
    sources = [iter(r) for r in runs]
    k = max(1, len(sources))
    size = 1 << (k - 1).bit_length()
    items: list = [next(s, _End) for s in sources] + [_End] * (size - len(sources))
    keys: list = [x if x is _End else key(x) for x in items]

    def wins(a: int, b: int) -> bool:
        if keys[a] is _End or keys[b] is _End:
            return keys[b] is _End and (keys[a] is not _End or a < b)
        return keys[a] < keys[b] or a < b and not keys[b] < keys[a]

    losers = [0] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        win, losers[node] = (a, b) if wins(a, b) else (b, a)
        return win

    winner = play(1)
    while keys[winner] is not _End:
        yield items[winner]
        items[winner] = nxt = next(sources[winner], _End)
        keys[winner] = nxt if nxt is _End else key(nxt)
        node = (winner + size) // 2
        while node:
            if wins(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2
