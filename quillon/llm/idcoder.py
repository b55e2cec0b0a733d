"""Blocks of token ids by context mixing and range coding: a codec on NumPy arrays that codes many blocks side by side.

An id is coded by a mixture of predictions that adapt as its block goes on. Order 2 and order 1 name the id that last
followed the two ids, or the one id, before it, each with a confidence: how often it has come in a row. Order 0 is the
distribution of the block's ids so far. An id that the block has not had is coded by high bytes of its different ids, and its
low byte stands as it is at the block's end, from the last byte back. How much each of the four is trusted is learned for
every pair of confidences. Trust and order 0 are made anew each time that the block has grown by a third. A range coder
writes which of them holds the id, then, for the last two, the id or its high byte. Every block begins with nothing learned.
The coder's numbers are integers below 2^48, held as doubles and so exact, which one machine writes as any other does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols of trust are cumulative and sum up to 2^BITS.
BITS = 14
ONE = 1 << BITS
#: Entries of a context table (a block has two), and the bits of confidence in each.
CONTEXTS, SURE = 1024, 2
MOST = (1 << SURE) - 1
STATES = 2 << 2 * SURE
#: Ids after which trust and order 0 are first made, and the share of growth after which they are made again.
FIRST, GROWTH = 27, 2
#: Ids of a block at most.
LONGEST = 1 << 16
#: The coder's range has 48 bits and takes in words of 16 bits where it falls below this.
LEAST, WORD, TOP = float(1 << 32), float(1 << 16), float(1 << 48)
HIGH = 256
#: What stands at a place of a distribution is one number: id plus one or high byte, begin and width, from 34, 17 and 0.
PLACE = (1 << 17) - 1
#: A symbol counts COUNTS times as much as one of the few that are taken to have come at first.
COUNTS = 16


def _first_counts() -> np.ndarray:
    """What is taken to have come in each state: order 2 and 1 where they name an id, more so the surer they are."""
    two, one, agree = np.indices((MOST + 1, MOST + 1, 2)).reshape(3, STATES)
    return np.stack([two * two * 4, np.where(agree == 1, 0, one * one * 2), np.full(STATES, 14), np.full(STATES, 10)])


class Trust:
    """How often each order held the id in each state, of n blocks; a row for each symbol, states in rows of blocks."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.counts = np.repeat(_first_counts(), n, axis=1)
        self.make()

    def make(self) -> None:
        """`ends` has where the symbols begin, and in a fifth row ONE, in five rows."""
        sums = np.cumsum(self.counts, axis=0)
        ends = np.empty((5, sums.shape[1]))
        ends[0], ends[4] = 0, ONE
        ends[1:4] = sums[:3] * (ONE - 4) // sums[3] + np.array([[1], [2], [3]])
        self.ends = ends

    def learn(self, at: np.ndarray, which: np.ndarray) -> None:
        """Symbols `which` came in states."""
        places = self.counts.shape[1]
        self.counts += COUNTS * np.bincount((which.astype(np.int64) * places + at).reshape(-1), minlength=4 * places).reshape(4, places)
        self.make()


class Contexts:
    """What orders 2 and 1 have learned of each of n blocks. Ids stand here plus one."""

    def __init__(self, n: int) -> None:
        self.table = np.zeros(2 * n * CONTEXTS, np.int32)
        self.of_table = np.arange(n) * (2 * CONTEXTS) + np.array([[0], [CONTEXTS]])
        self.lane = np.arange(n)
        self.mixed, self.last = np.zeros((2, n), np.int32)

    def narrow(self, n: int) -> None:
        """Only the first n blocks go on."""
        self.base, self.own = self.of_table[:, :n].copy(), self.lane[:n].copy()
        self.mixed, self.last = self.mixed[:n], self.last[:n]
        self.hash, self.held = np.empty((2, 2, n), np.int32)
        self.at = np.empty((2, n), np.int64)

    def predict(self, state: np.ndarray) -> np.ndarray:
        """What orders 2 and 1 say, in two rows; puts each block's place in rows of states into `state`."""
        mixed, held = self.hash, self.held
        np.multiply(self.last, 40503, out=mixed[1])
        np.add(mixed[1], self.mixed, out=mixed[0])
        mixed >>= 4
        mixed &= CONTEXTS - 1
        np.add(mixed, self.base, out=self.at)
        self.table.take(self.at, out=held, mode="clip")
        self.sure = sure = held & MOST
        self.says = says = held >> SURE
        row = (sure[0] << SURE) + sure[1] << 1
        row += says[0] == says[1]
        np.multiply(row, len(self.lane), out=state)
        state += self.own
        return says

    def learn(self, now: np.ndarray) -> np.ndarray:
        """These ids (plus one) came next: whether orders 2 and 1 said so."""
        right = self.says == now
        self.table[self.at] = np.where(right, self.held | MOST, now << SURE | 1)
        self.mixed, self.last = self.last * 30011, now
        return right


class Numbers:
    """The different ids of n blocks, sorted, are numbers here; order 0 of what has come by the time."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n = len(ids)
        held = np.sort(ids, axis=1, kind="stable")
        fresh = np.ones(held.shape, bool)
        fresh[:, 1:] = held[:, 1:] != held[:, :-1]
        of, self.many = held[fresh], fresh.sum(axis=1)
        self.first = np.cumsum(self.many) - self.many
        self.of_high = np.repeat(np.arange(self.n) * HIGH, self.many) + (of >> 8)
        number, own = np.zeros(1 << 16, np.int32), np.empty(ids.shape, np.int32)
        for k, (a, b) in enumerate(zip(self.first.tolist(), (self.first + self.many).tolist(), strict=True)):
            number[of[a:b]] = np.arange(a, b)
            own[k] = number[ids[k]]
        self.numbers = own.T.copy()
        self.counts = np.zeros(len(of), np.int64)

    def make(self) -> None:
        """Of each number, as one, whether it has come, and begin and width of its id or of its high byte; of each block the
        total of high bytes."""
        known = self.counts > 0
        before = np.cumsum(self.counts)
        before -= self.counts
        before -= np.repeat(before[self.first], self.many)
        highs = np.bincount(self.of_high[known], minlength=self.n * HIGH).reshape(self.n, HIGH) + 1
        ends = np.cumsum(highs, axis=1)
        self.places = np.where(known, before << 20 | self.counts | 1 << 40, (ends - highs << 20 | highs).reshape(-1).take(self.of_high))
        self.totals = ends[:, -1]

    def learn(self, numbers: np.ndarray) -> None:
        self.counts += np.bincount(numbers.reshape(-1), minlength=len(self.counts))


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order 0 of n blocks' ids (n rows of m) for reading: what stands at places, where a block's begin for each symbol, and
    the symbols' totals. A place for what needs none comes first, one for each of the sorted ids follows, then those of
    high bytes: one for each different id, and of each high byte."""
    n, m = ids.shape
    held = np.sort(ids, axis=1, kind="stable")
    fresh = np.ones(held.shape, bool)
    fresh[:, 1:] = held[:, 1:] != held[:, :-1]
    starts = np.flatnonzero(fresh)
    widths = np.diff(starts, append=held.size)
    own, lanes = held.reshape(-1)[starts].astype(np.int64), starts // max(m, 1)
    highs = np.bincount(lanes * HIGH + (own >> 8), minlength=n * HIGH).reshape(n, HIGH) + 1
    ends = np.cumsum(highs, axis=1)
    of_high = (np.arange(HIGH) << 34 | ends - highs << 17 | highs).reshape(-1)
    places = np.repeat(np.concatenate([[1], own + 1 << 34 | starts - lanes * m << 17 | widths, of_high]), np.concatenate([[1], widths, highs.reshape(-1)]))
    firsts, totals = np.zeros((4, n), np.int64), np.ones((4, n))
    firsts[2], firsts[3] = np.arange(n) * m + 1, np.cumsum(ends[:, -1]) - ends[:, -1] + n * m + 1
    totals[2], totals[3] = m, ends[:, -1]
    return places, firsts, totals


class Writer:
    """The range coders of n blocks."""

    def __init__(self, n: int, most: int) -> None:
        self.low, self.range = np.zeros(n), np.full(n, TOP)
        self.out = np.zeros(n * most, np.uint16)
        self.first = np.arange(n) * most
        self.at = self.first.copy()

    def put(self, n: int, of_trust: np.ndarray, trust: np.ndarray, total: np.ndarray, begin: np.ndarray, width: np.ndarray) -> None:
        """One id of each of the first n blocks: where its symbol of trust begins and how wide it is, and within that its
        share of a total."""
        low, room = self.low[:n], self.range[:n]
        room *= 1 / ONE
        np.floor(room, out=room)
        inner = room * trust
        inner /= total
        np.floor(inner, out=inner)
        room *= of_trust
        low += room
        low += inner * begin
        np.multiply(inner, width, out=room)
        over = (low >= TOP).nonzero()[0]
        if len(over):
            low[over] -= TOP
            back = self.at[over] - 1
            while len(back):  # a carry goes into the words that are out already
                self.out[back] += 1
                back = back[self.out[back] == 0] - 1
        small = (room < LEAST).nonzero()[0]
        while len(small):
            at, own = self.at.take(small), low.take(small)
            word = np.floor(own * (1 / LEAST))
            self.out[at] = word
            self.at[small] = at + 1
            low[small] = (own - word * LEAST) * WORD
            wider = room.take(small) * WORD
            room[small] = wider
            small = small[wider < LEAST]

    def finish(self) -> list[bytes]:
        """What each block wrote."""
        for _ in range(3):
            word = np.floor(self.low / LEAST)
            self.out[self.at] = word
            self.at += 1
            self.low = (self.low - word * LEAST) * WORD
        return [self.out[a:b].astype("<u2").tobytes() for a, b in zip(self.first, self.at, strict=True)]


def _spans(lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(made, from, to, blocks): places that use what was made of the ids before `made`, of equally many live blocks.
    Where it is made depends on the place alone, so a block is coded alike beside any others."""
    made, longest = 0, int(lengths[0]) if len(lengths) else 0
    stops = np.unique(lengths)
    while made < longest:
        at, until = made, min(made + max(FIRST, made // GROWTH), longest)
        while at < until:
            end = min(until, int(stops[np.searchsorted(stops, at, side="right")]))
            yield made, at, end, int((lengths > at).sum())
            at = end
        made = until


def encode(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The bytes of blocks of ids under 2^16: rows of `ids`, of which the first lengths[k] count; the longest come first."""
    if ids.size and (ids.min() < 0 or ids.max() >= 1 << 16):
        raise ValueError("ids must be of 16 bits")
    if len(lengths) and lengths[0] > LONGEST:
        raise ValueError(f"blocks must have at most {LONGEST} ids")
    blocks = len(lengths)
    held = ids.astype(np.uint16)
    contexts, writer, trust, numbers = Contexts(blocks), Writer(blocks, 3 * int(max(lengths, default=0)) + 8), Trust(blocks), Numbers(held)
    now, last, waiting = held.T.astype(np.int32, order="C") + 1, -1, []
    lows, of_low = [], []
    for made, at, end, n in _spans(lengths):
        if made != last:
            for x in waiting:
                trust.learn(*x[:2])
                numbers.learn(x[2])
            numbers.make()
            last, waiting = made, []
        contexts.narrow(n)
        states, right, own = np.empty((end - at, n), np.int64), np.empty((end - at, 2, n), bool), numbers.numbers[at:end, :n]
        for t in range(end - at):
            contexts.predict(states[t])
            right[t] = contexts.learn(now[at + t, :n])
        found = numbers.places.take(own)
        which = 3 - (found >> 40)
        total = np.where(which == 2, float(made), numbers.totals[:n])
        which[right[:, 1]] = 1
        which[right[:, 0]] = 0
        waiting.append((states, which, own))
        of_trust = which * (STATES * blocks) + states
        first = trust.ends.take(of_trust)
        of_trust += STATES * blocks
        wide = trust.ends.take(of_trust) - first
        hit = which < 2
        begin, width = (found >> 20 & PLACE).astype(float), (found & PLACE).astype(float)
        begin[hit], width[hit], total[hit] = 0, 1, 1
        for t in range(end - at):
            writer.put(n, first[t], wide[t], total[t], begin[t], width[t])
        lane, place = np.nonzero(which.T == 3)
        lows.append(held[lane, at + place].astype(np.uint8))
        of_low.append(lane)
    lows, of_low = np.concatenate([np.zeros(0, np.uint8), *lows]), np.concatenate([np.zeros(0, np.int64), *of_low])
    lows = lows[np.argsort(of_low, kind="stable")[::-1]].tobytes()
    ends = len(lows) - np.cumsum(np.bincount(of_low, minlength=blocks))
    return [words + lows[a:b] for words, a, b in zip(writer.finish(), ends.tolist(), [len(lows), *ends.tolist()], strict=False)]


def decode(blocks: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The ids of blocks that encode wrote, as rows filled up with zeros. Bytes that encode did not write give other ids:
    the caller holds a checksum of them."""
    longest = int(lengths[0]) if len(lengths) else 0
    held = np.zeros((longest, len(blocks)), np.uint16)
    words = np.zeros((len(blocks), max(map(len, blocks), default=0) // 2 + 6), np.uint16)
    for k, b in enumerate(blocks):
        words[k, : len(b) // 2] = np.frombuffer(b, "<u2", len(b) // 2)
    code = (words[:, 0] * LEAST + words[:, 1] * WORD) + words[:, 2]
    lows = np.frombuffer(b"\0" + b"".join(blocks), np.uint8)
    low_at = np.cumsum([len(b) for b in blocks], dtype=np.int64)
    used, room = np.arange(len(blocks)) * words.shape[1] + 3, np.full(len(blocks), TOP)
    words = words.reshape(-1)
    contexts, trust, last, waiting = Contexts(len(blocks)), Trust(len(blocks)), -1, []
    for made, at, end, n in _spans(lengths):
        if made != last:
            for x in waiting:
                trust.learn(*x)
            last, waiting = made, []
        places, firsts, totals = _places(np.ascontiguousarray(held[:made, :n].T))
        contexts.narrow(n)
        states, symbols = np.empty((end - at, n), np.int64), np.empty((end - at, n), np.int64)
        ends, said, lane = np.empty((5, n)), np.empty((4, n), np.int32), np.arange(n)
        ends[0], ends[4] = 0, ONE
        code, room, used, low_at = code[:n].copy(), room[:n].copy(), used[:n].copy(), low_at[:n].copy()
        step, left = np.empty((2, n))
        for t in range(at, end):
            state, which = states[t - at], symbols[t - at]
            said[:2] = contexts.predict(state)
            for k in (1, 2, 3):
                trust.ends[k].take(state, out=ends[k], mode="clip")
            np.multiply(room, 1 / ONE, out=step)
            np.floor(step, out=step)
            over = ends[1:4] <= code / step
            np.add.reduce(over.view(np.uint8), axis=0, dtype=np.int64, out=which)
            symbol = which * n
            symbol += lane
            begin = ends.take(symbol)
            width = ends.reshape(-1)[n:].take(symbol)
            width -= begin
            begin *= step
            code -= begin
            np.multiply(step, width, out=left)
            left /= totals.take(symbol)
            np.floor(left, out=left)
            place = (code / left).astype(np.int64)
            place += firsts.take(symbol)
            found = places.take(place, mode="clip")
            code -= left * (found >> 17 & PLACE)
            np.multiply(left, found & PLACE, out=room)
            found >>= 34
            said[2] = found
            new = over[2].nonzero()[0]
            if len(new):
                own = low_at.take(new)
                said[3, new] = (found.take(new) << 8 | lows.take(own, mode="clip")) + 1
                low_at[new] = own - 1
            now = said.take(symbol)
            small = (room < LEAST).nonzero()[0]
            while len(small):
                own = used.take(small)
                code[small] = code.take(small) * WORD + words.take(own, mode="clip")
                used[small] = own + 1
                wider = room.take(small) * WORD
                room[small] = wider
                small = small[wider < LEAST]
            held[t, :n] = now - 1
            contexts.learn(now)
        waiting.append((states, symbols))
    return held.T.copy()
