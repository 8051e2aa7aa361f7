"""Banding, back-substitution and queries over GF(2): the part that no column expression covers.

An equation (start, coeff, rhs) says that the XOR of the solution's slots start + j, over the set
bits j of coeff, is rhs; bit 0 of coeff is always set. A table maps a slot to the one equation kept
there. Which equations are redundant depends on their order, which slots are occupied and what
the solution is do not, so partial tables merge by inserting one's rows into the other.
"""

from __future__ import annotations

import numpy as np

from filterlab.functions import bits

_FREE = bits.GOLDEN & 0xFFFF | 1 << 15  # only the low bits of slot * odd matter


def fingerprints(keys: np.ndarray, r: int) -> np.ndarray:
    """What a standard ribbon answers for its keys: r bits of a hash that doesn't depend on the seed."""
    return (bits.np_mix64(keys.astype(np.uint64) ^ np.uint64(bits.GOLDEN)) & np.uint64((1 << r) - 1)).astype(np.uint16)


def equations(h: np.ndarray, start: np.ndarray, w: int, answers: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """The equations of keys from their hashes. Without answers all right-hand sides are 0."""
    low = (bits.np_mix64(h) | np.uint64(1)).tolist()
    if w == 128:
        high = bits.np_mix64(h.astype(np.uint64) ^ np.uint64(bits.GOLDEN)).tolist()
        low = [a | b << 64 for a, b in zip(low, high, strict=True)]
    rhs = [0] * len(low) if answers is None else answers.tolist()
    return list(zip(start.tolist(), low, rhs, strict=True))


class Band:
    """A banding table, filled in any order. Rows that would pass slot cap are spilled, not stored."""

    def __init__(self, cap: int) -> None:
        self.cap, self.rows = cap, {}
        self.spilled: list[tuple[int, int, int]] = []
        self.redundant = self.contradictions = 0

    def add(self, equations) -> Band:
        rows, cap = self.rows, self.cap
        for start, coeff, rhs in equations:
            while True:
                if start >= cap:
                    self.spilled.append((start, coeff, rhs))
                    break
                there = rows.get(start)
                if there is None:
                    rows[start] = (coeff, rhs)
                    break
                coeff ^= there[0]
                rhs ^= there[1]
                if not coeff:
                    self.redundant += 1
                    self.contradictions += rhs != 0
                    break
                zeros = (coeff & -coeff).bit_length() - 1
                coeff >>= zeros
                start += zeros
        return self

    def equations(self) -> list[tuple[int, int, int]]:
        return [(s, c, b) for s, (c, b) in self.rows.items()]


def free_slot(slot: int, r: int) -> int:
    """What a slot without equation holds: a function of the slot alone."""
    return slot * _FREE & ((1 << r) - 1)


#: Rules for slots without an equation: any function of the slot alone gives one solution in every order.
FREE_RULES = {"mixed": free_slot, "zero": lambda slot, r: 0, "table": lambda slot, r: (slot * slot + 3 * slot + 1) % 251 & ((1 << r) - 1)}


def back_substitute(rows: dict[int, tuple[int, int]], slots: int, r: int, w: int, free=free_slot, first: int = 0, state: list[int] | None = None) -> np.ndarray:
    """The solution of the slots from first on, from the last to the first. For each result bit a window holds that bit of
    the next w slots; state has the values of the w - 1 slots after the last, 0 if there are none."""
    z, ahead, full = np.zeros(slots, np.uint16), [sum((v >> k & 1) << j for j, v in enumerate(state or ())) for k in range(r)], (1 << w) - 1
    for slot in range(first + slots - 1, first - 1, -1):
        there = rows.get(slot)
        if there is None:
            value = free(slot, r)
        else:
            rest, value = there[0] >> 1, there[1]
            for k in range(r):
                value ^= ((rest & ahead[k]).bit_count() & 1) << k
        z[slot - first] = value
        for k in range(r):
            ahead[k] = (ahead[k] << 1 | value >> k & 1) & full
    return z


#: An affine map of the values of w - 1 neighbouring slots: for each value, which of the inputs are XORed (a bit mask), and with what.
Affine = tuple[list[int], list[int]]


def affine(rows: dict[int, tuple[int, int]], first: int, slots: int, r: int, w: int, free=free_slot) -> Affine:
    """How the first w - 1 values from slot first on depend on the w - 1 values after the last of the slots."""
    inputs = w - 1
    masks = [0] * slots + [1 << j for j in range(inputs)]
    values = [0] * (slots + inputs)
    for at in range(slots - 1, -1, -1):
        there = rows.get(first + at)
        if there is None:
            values[at] = free(first + at, r)
            continue
        rest, mask, value = there[0] >> 1, 0, there[1]
        while rest:
            low = rest & -rest
            rest ^= low
            j = at + low.bit_length()
            mask ^= masks[j]
            value ^= values[j]
        masks[at], values[at] = mask, value
    return masks[:inputs], values[:inputs]


def composed(left: Affine, right: Affine) -> Affine:
    """The map that takes what right takes and gives what left gives of what right gives."""
    masks, values = [], []
    for mask, value in zip(*left, strict=True):
        out = 0
        while mask:
            low = mask & -mask
            mask ^= low
            j = low.bit_length() - 1
            out ^= right[0][j]
            value ^= right[1][j]
        masks.append(out)
        values.append(value)
    return masks, values


def lookup(z: np.ndarray, h: np.ndarray, start: np.ndarray, w: int) -> np.ndarray:
    """The XOR of the slots that each key's equation names."""
    out = np.zeros(len(h), np.uint16)
    words = [bits.np_mix64(h) | np.uint64(1)]
    if w == 128:
        words.append(bits.np_mix64(h.astype(np.uint64) ^ np.uint64(bits.GOLDEN)))
    for k, word in enumerate(words):
        for j in range(64):
            out ^= z[start + 64 * k + j] * ((word >> np.uint64(j)) & np.uint64(1)).astype(np.uint16)
    return out
