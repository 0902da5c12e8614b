"""Counting quotient filters of n-grams of word ids, without loss.

The ids of an n-gram are packed into a few 64-bit limbs, and the limbs go
through a Feistel network, which can be inverted.  The top bits of the result
are its quotient, the rest is its remainder and is kept whole, so the filter
gives back every n-gram and its exact count.

A filter is built from sorted entries, so no entry ever moves: a bit a
quotient says whether any entry has it (occupied), a bit an entry whether it is
the last of its quotient (run end), and then come the remainders and the
counts, a byte each but for large ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 4
#: A count of this or more has its own eight bytes.
BIG = 255


@dataclass(frozen=True)
class Layout:
    """How the ids of an n-gram lie in limbs: ``groups`` are the ids a limb holds, ``bits`` the bits of an id."""

    n: int
    bits: int

    @property
    def groups(self) -> list[int]:
        limbs = max(2, -(-self.n // (64 // self.bits)))
        return [self.n // limbs + (k < self.n % limbs) for k in range(limbs)]

    @property
    def widths(self) -> list[int]:
        return [g * self.bits for g in self.groups]

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """The limbs of the n-grams whose k-th ids are ``ids[k]``."""
        out, at = [], 0
        for g in self.groups:
            limb = ids[at].astype(np.uint64)
            for x in ids[at + 1 : at + g]:
                limb = (limb << np.uint64(self.bits)) | x.astype(np.uint64)
            out.append(limb)
            at += g
        return out

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        mask, out = np.uint64((1 << self.bits) - 1), []
        for g, limb in zip(self.groups, limbs, strict=True):
            out += [((limb >> np.uint64(self.bits * (g - 1 - k))) & mask).astype(np.int64) for k in range(g)]
        return out

    def permute(self, limbs: list[np.ndarray], back: bool = False) -> list[np.ndarray]:
        """A fixed permutation of all n-grams of this layout, or its inverse."""
        limbs = list(limbs)
        steps = [(r, k) for r in range(ROUNDS) for k in range(len(limbs))]
        for r, k in reversed(steps) if back else steps:
            rest = np.full(len(limbs[0]), r * len(limbs) + k + 1, np.uint64)
            for i, x in enumerate(limbs):
                if i != k:
                    rest = mix(rest ^ x)
            limbs[k] = limbs[k] ^ (rest >> np.uint64(64 - self.widths[k]))
        return limbs


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _order(limbs: list[np.ndarray], widths: list[int]) -> np.ndarray:
    """The order of entries by their limbs; runs that are sorted already are merged, not sorted anew."""
    if sum(widths) <= 64:
        key = limbs[0]
        for x, w in zip(limbs[1:], widths[1:], strict=True):
            key = (key << np.uint64(w)) | x
        return np.argsort(key, kind="stable")
    order = np.argsort(limbs[0], kind="stable")
    first = limbs[0][order]
    ties = np.flatnonzero(first[1:] == first[:-1])
    if any((limbs[1][order[ties]] > limbs[1][order[ties + 1]]).tolist()) or len(limbs) > 2:
        return np.lexsort(limbs[::-1])
    return order


class Entries:
    """Distinct permuted n-grams in order, with their counts."""

    def __init__(self, limbs: list[np.ndarray], counts: np.ndarray):
        self.limbs, self.counts = limbs, counts

    def __len__(self) -> int:
        return len(self.counts)


def collect(parts: list[Entries], layout: Layout) -> Entries:
    """The entries of all ``parts``, counts of equal ones added up."""
    if not parts:
        return Entries([np.empty(0, np.uint64) for _ in layout.widths], np.empty(0, np.int64))
    limbs = [np.concatenate([p.limbs[k] for p in parts]) for k in range(len(layout.widths))]
    counts = np.concatenate([p.counts for p in parts])
    if not len(counts):
        return Entries(limbs, counts)
    order = _order(limbs, layout.widths)
    limbs, counts = [x[order] for x in limbs], counts[order]
    new = np.ones(len(counts), bool)
    new[1:] = False
    for x in limbs:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return Entries([x[first] for x in limbs], np.add.reduceat(counts, first))


def counted(ids: list[np.ndarray], layout: Layout) -> Entries:
    """The n-grams with the ids ``ids[k]`` as entries of a filter."""
    limbs = layout.permute(layout.pack(ids))
    return collect([Entries(limbs, np.ones(len(limbs[0]), np.int64))], layout)


class Stack:
    """Entries that grow by merging filters of like size, so that each is merged only a few times."""

    def __init__(self, layout: Layout):
        self.layout, self.parts = layout, []

    def add(self, entries: Entries) -> None:
        self.parts.append(entries)
        while len(self.parts) > 1 and len(self.parts[-2]) < 2 * len(self.parts[-1]):
            self.parts[-2:] = [collect(self.parts[-2:], self.layout)]

    def __len__(self) -> int:
        return sum(map(len, self.parts))

    def take(self) -> Entries:
        out, self.parts = collect(self.parts, self.layout), []
        return out


def _bytes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each number, in whole bytes."""
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, : -(-width // 8)]).tobytes()


def shards(entries: Entries, layout: Layout, shard_bits: int) -> list[tuple[int, slice]]:
    """(shard, its entries) by the top ``shard_bits`` bits of the quotient, of those that have any."""
    top = (entries.limbs[0] >> np.uint64(layout.widths[0] - shard_bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(top) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(top)]
    return [(int(top[a]), slice(int(a), int(b))) for a, b in zip(starts, ends, strict=False)]


def encode(entries: Entries, at: slice, layout: Layout, shard_bits: int) -> bytes:
    """The entries ``at`` of one shard as a counting quotient filter."""
    limbs, counts = [x[at] for x in entries.limbs], entries.counts[at]
    width = layout.widths[0] - shard_bits
    q = min(width, max(1, int(len(counts) - 1).bit_length()))
    own = limbs[0] & np.uint64((1 << width) - 1)
    quotient = own >> np.uint64(width - q)
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotient.astype(np.int64)] = 1
    last = np.r_[quotient[1:] != quotient[:-1], True].astype(np.uint8)
    big = counts >= BIG
    head = np.array([len(counts), q, int(big.sum())], "<u4").tobytes()
    remainder = _bytes(own & np.uint64((1 << (width - q)) - 1), width - q)
    others = b"".join(_bytes(x, w) for x, w in zip(limbs[1:], layout.widths[1:], strict=True))
    return head + np.packbits(occupied).tobytes() + np.packbits(last).tobytes() + remainder + others + np.where(big, BIG, counts).astype("u1").tobytes() + counts[big].astype("<i8").tobytes()


def decode(blob: bytes, shard: int, layout: Layout, shard_bits: int) -> Entries:
    """The entries of a filter that :func:`encode` made of ``shard``."""
    n, q, big = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    width, at = layout.widths[0] - shard_bits, 12

    def bits(many: int) -> np.ndarray:
        nonlocal at
        size = -(-many // 8)
        out = np.unpackbits(np.frombuffer(blob, "u1", size, at), count=many)
        at += size
        return out

    def numbers(w: int) -> np.ndarray:
        nonlocal at
        size = -(-w // 8)
        out = np.zeros((n, 8), "u1")
        out[:, :size] = np.frombuffer(blob, "u1", n * size, at).reshape(n, size)
        at += n * size
        return out.view("<u8").reshape(n).astype(np.uint64)

    occupied, last = np.flatnonzero(bits(1 << q)), bits(n)
    run = np.cumsum(last) - last  # how many runs end before each entry
    own = (occupied[run].astype(np.uint64) << np.uint64(width - q)) | numbers(width - q)
    limbs = [own | np.uint64(shard << width)] + [numbers(w) for w in layout.widths[1:]]
    counts = np.frombuffer(blob, "u1", n, at).astype(np.int64)
    counts[counts == BIG] = np.frombuffer(blob, "<i8", big, at + n)
    return Entries(limbs, counts)
