"""Loser trees: k-way merging with one comparison a level for each row taken out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def merge(runs: Sequence[Sequence]) -> Iterator[tuple[int, int]]:
    """(run, position) of all items of sorted ``runs`` in order; equal items in the order of their runs."""
    k = len(runs)
    if not k:
        return
    heads: list = [r[0] if len(r) else None for r in runs]
    at = [0] * k
    ended = [not len(r) for r in runs]

    def less(a: int, b: int) -> bool:
        if ended[a] or ended[b]:
            return not ended[a]
        return heads[a] < heads[b] or (heads[a] == heads[b] and a < b)

    tree = [-1] * k  # tree[0] is the winner, the others the losers of their nodes
    for i in range(k):
        now, node = i, (i + k) >> 1
        while node > 0 and tree[node] >= 0:
            if less(tree[node], now):
                tree[node], now = now, tree[node]
            node >>= 1
        if node > 0:
            tree[node] = now
        else:
            tree[0] = now
    for _ in range(sum(map(len, runs))):
        w = tree[0]
        yield w, at[w]
        at[w] += 1
        if at[w] < len(runs[w]):
            heads[w] = runs[w][at[w]]
        else:
            heads[w], ended[w] = None, True
        now, node = w, (w + k) >> 1
        while node > 0:
            if less(tree[node], now):
                tree[node], now = now, tree[node]
            node >>= 1
        tree[0] = now


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the longest common prefix, of which ``start`` bytes are known to agree."""
    n = min(len(a), len(b))
    step = 16
    i = start
    while i < n:
        j = min(n, i + step)
        if a[i:j] != b[i:j]:
            while a[i] == b[i]:
                i += 1
            return i
        i, step = j, step * 2
        if step > 64:
            step = 64
    return n


def merge_prefixes(runs: Sequence[tuple[Sequence[bytes], Sequence[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, position, common prefix with the item before it in the result) for sorted runs of byte strings.

    Each run comes with the common prefix of every item with the one before
    it.  The tree keeps, for each loser, its common prefix with the item that
    won at its node: a challenger with a longer common prefix with the last
    output is smaller without a look at the bytes, and for equal prefixes the
    comparison starts behind them.
    """
    k = len(runs)
    if not k:
        return
    heads: list[bytes | None] = [r[0][0] if len(r[0]) else None for r in runs]
    shared = [0] * k  # with the last output, for whoever is on the way up; with the winner of its node, for a loser
    at = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); afterwards the loser's ``shared`` is with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common_prefix(x, y, shared[a])
        smaller = x[n : n + 1] < y[n : n + 1] or (x[n : n + 1] == y[n : n + 1] and a < b)
        win, lose = (a, b) if smaller else (b, a)
        shared[lose] = n
        return win, lose

    tree = [-1] * k
    for i in range(k):
        now, node = i, (i + k) >> 1
        while node > 0 and tree[node] >= 0:
            now, tree[node] = play(now, tree[node])
            node >>= 1
        tree[node if node > 0 else 0] = now
    for _ in range(sum(len(r[0]) for r in runs)):
        w = tree[0]
        yield w, at[w], shared[w]
        at[w] += 1
        items, own = runs[w]
        if at[w] < len(items):
            heads[w], shared[w] = items[at[w]], own[at[w]]
        else:
            heads[w], shared[w] = None, 0
        now, node = w, (w + k) >> 1
        while node > 0:
            now, tree[node] = play(now, tree[node])
            node >>= 1
        tree[0] = now


def front_code(items: Sequence[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefix with the item before, and the rest, for each of a sorted run."""
    shared, tails, last = [], [], b""
    for x in items:
        n = common_prefix(last, x)
        shared.append(n)
        tails.append(x[n:])
        last = x
    return shared, tails


def front_decode(shared: Sequence[int], tails: Sequence[bytes]) -> list[bytes]:
    out, last = [], b""
    for n, t in zip(shared, tails, strict=True):
        last = last[:n] + t
        out.append(last)
    return out
