"""A bounded memo of id sequences by 64-bit names: one dictionary of numbers and one growing array, no object a sequence."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

from . import _vec

U = np.uint64
#: The low bits of a place tell the length: fewer than 2**20 characters have at most four bytes each, and an id stands for a byte at least.
SIZE = 22


class Pool:
    """When it holds more than ``most`` sequences it forgets all and begins anew."""

    def __init__(self, most: int, kind: type):
        self.most, self.kind = most, kind
        self.forget()

    def forget(self) -> None:
        self.at: dict[int, int] = {}
        self.held, self.used = np.zeros(1 << 16, self.kind), 0

    def __len__(self) -> int:
        return len(self.at)

    def places(self, names: np.ndarray, make: Callable[[list[int]], list]) -> np.ndarray:
        """Where the sequences of distinct names are. make: takes places in ``names`` that are new, returns their sequences."""
        if len(self.at) > self.most:
            self.forget()
        keys = names.tolist()
        out = np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(out < 0).tolist()
        for k, ids in zip(new, make(new) if new else (), strict=True):
            while self.used + len(ids) > len(self.held):
                self.held = np.concatenate((self.held, np.zeros_like(self.held)))
            self.held[self.used : self.used + len(ids)] = ids
            out[k] = self.at[keys[k]] = self.used << SIZE | len(ids)
            self.used += len(ids)
        return out

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences at ``places`` one after another, and where each ends."""
        n = places & ((1 << SIZE) - 1)
        stop = np.cumsum(n)
        return self.held[np.repeat((places >> SIZE) - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)], stop


class Table(Pool):
    """A pool that knows its names by an open table of numbers, so that a batch is looked up and added in a few operations on arrays.

    When it holds more than ``most`` sequences, or eight times as many ids, it keeps those that were asked for again since
    it was last so full, if that leaves a quarter of it free, and forgets the others.
    """

    def forget(self) -> None:
        # No place is 0, which marks a free slot.
        self.held, self.used, self.count = np.zeros(1 << 16, self.kind), 1, 0
        self.empty(16)

    def empty(self, bits: int) -> None:
        self.bits, self.name, self.place, self.again = bits, *(np.zeros(1 << bits, kind) for kind in (U, np.int64, bool))

    def __len__(self) -> int:
        return self.count

    def places(self, names: np.ndarray, make: Callable[[np.ndarray], list]) -> np.ndarray:
        """Where the sequences of names are, which may repeat. make: takes places in ``names``, one for each that is new, returns their sequences."""
        if self.count > self.most or self.used > 8 * self.most:
            self.sweep()
        slot = self.slots(names)
        out = self.place[slot]
        self.again[slot] = True
        new = np.flatnonzero(out == 0)
        if len(new):
            fresh, first, inv = np.unique(names[new], return_index=True, return_inverse=True)
            made = make(new[first])
            n = np.fromiter(map(len, made), np.int64, len(fresh))
            out[new] = self.add(fresh, np.fromiter(chain.from_iterable(made), self.kind, n.sum()), n)[inv]
        return out

    def slots(self, names: np.ndarray) -> np.ndarray:
        """The slot of each name, or the free one where the search for it ends."""
        slot = (names >> U(64 - self.bits)).astype(np.int64)
        left = np.flatnonzero(self.name[slot] != names)
        while len(left):
            at = slot[left]
            left = left[(self.place[at] != 0) & (self.name[at] != names[left])]
            slot[left] = (slot[left] + 1) & (len(self.name) - 1)
        return slot

    def add(self, names: np.ndarray, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Places of new, distinct names, whose sequences of ``n`` ids are one after another in ``flat``."""
        while self.used + len(flat) > len(self.held):
            self.held = np.concatenate((self.held, np.zeros_like(self.held)))
        self.held[self.used : self.used + len(flat)] = flat
        places = (self.used + np.cumsum(n) - n) << SIZE | n
        self.used, self.count = self.used + len(flat), self.count + len(names)
        if 2 * self.count > len(self.name):  # half of the slots stay free
            on = np.flatnonzero(self.place)
            known = self.name[on], self.place[on], self.again[on]
            self.empty((2 * self.count).bit_length())
            self.enter(*known)
        self.enter(names, places, np.zeros(len(names), bool))
        return places

    def enter(self, names: np.ndarray, places: np.ndarray, again: np.ndarray) -> None:
        left = np.arange(len(names))
        while len(left):
            slot = self.slots(names[left])
            self.name[slot], self.place[slot], self.again[slot] = names[left], places[left], again[left]
            left = left[self.name[slot] != names[left]]  # of names that end at one free slot the last stays

    def sweep(self) -> None:
        on = np.flatnonzero(self.again & (self.place != 0))
        names, places = self.name[on], self.place[on]
        n = places & ((1 << SIZE) - 1)
        if 4 * len(on) > 3 * self.most or n.sum() > 6 * self.most:
            return self.forget()
        flat, _ = self.gather(places)
        self.forget()
        self.add(names, flat, n)


def names_of(cps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each run of characters that begins at ``start``, and its length."""
    size = np.diff(np.append(start, len(cps)))
    place = np.arange(len(cps)) - np.repeat(start, size)
    values = (cps.astype(np.uint64) + U(1)) * (_vec.PLACE[place & (len(_vec.PLACE) - 1)] + (place >> 14).astype(np.uint64) * U(2))
    return _vec.mix(np.add.reduceat(values, start) + size.astype(np.uint64) * U(0x9E3779B97F4A7C15)), size
