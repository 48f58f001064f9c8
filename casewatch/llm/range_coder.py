"""An adaptive context-mixing range coder for token ids, many lanes at a time.

A block of ids is coded on its own and checksummed. It is cut into lanes of equal length; numpy works on one id of every
lane at a time, and all lanes share what the block's model has learnt. Three orders predict each id: the id that last
followed the two ids before (order 2), the id that last followed the one before (order 1), both renewed with every id,
and how often each id was coded in the block (order 0). First it is coded which of the three gives the id. Four adaptive
models say how likely each is: one knows how often the order-2 guess of this context held, one how often the order-1
guess did, one what gave the last two ids, one all of these together. What they say is mixed in the logarithmic domain
with learnt weights. Only ids that neither guess gives are coded by order 0; ids too rare for a share there follow an
escape. The counts, and from them the weights and shares, are renewed after growing stretches of ids, so that a stretch
needs one look into a table for each id. All arithmetic is on whole numbers, alike on every machine.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from casewatch.llm.batches import by_value

by_value(__name__)

BLOCK = 512  # ids of a lane, at most
SHORT = 256  # ids of a lane of a block that is not full, at most
LANES = 8_192  # of a block
MAGIC = b"CWR2"
_HEAD = "<IIIII"  # ids, lanes, bytes of code with the lanes' lengths, checksums of these and of the ids

BITS = 16  # of a chance
TOTAL = 1 << BITS
WINDOW, WORD = 48, 16  # bits of a lane's window, and of what leaves it at a time
_LEAST, _LOW = 1 << (WINDOW - WORD), (1 << (WINDOW - WORD)) - 1
STRETCH = 64  # ids of a lane between two renewals, at most; the first stretches are shorter
TABLE = 1 << 18  # contexts of order 2
_KINDS = 3
# A state: how often the order-2 and the order-1 guess held (three bits each), whether both are the same (one), what gave
# the last two ids (two each).
_STATES = 1 << 11
_ESCAPE = 1 << 16

_STEPS = 256  # of a logarithm, for each bit
_LOG = np.array([0] + [round(math.log2(i / 4_096) * _STEPS) for i in range(1, 4_097)], np.int64)
_POWER = np.array([round(2 ** (20 - i / _STEPS)) for i in range(20 * _STEPS + 1)], np.int64)
_ONE = 1 << 16  # a weight of one
# How often a guess is known to have held, after it did not (first eight) and after it did.
_NEXT = np.array([n >> 1 for n in range(8)] + [min(n + 1, 7) for n in range(8)], np.int64)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two whole numbers below 2**31 in one, so that one look into a table gives both."""
    return first << 32 | second


def _parts(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pair >> 32, pair & 0xFFFFFFFF


class _Model:
    """What the lanes of one block share, and each lane's last ids."""

    def __init__(self, lanes: int):
        self.follows = np.zeros(1 << 16, np.int64), np.zeros(TABLE, np.int64)  # id and how often it held, by context
        self.one, self.two, self.last = (np.zeros(lanes, np.int64) for _ in range(3))
        self.kinds = np.zeros((_STATES, _KINDS), np.int64)
        self.ids = np.zeros(1 << 16, np.int64)
        self.weights = [_ONE // 4] * 4
        self._mix()
        self._share()

    def keep(self, count: int) -> None:
        """Only the first lanes go on; the others have ended."""
        self.one, self.two, self.last = self.one[:count], self.two[:count], self.last[:count]

    def look(self) -> None:
        """The guesses of both orders, and each lane's state."""
        self.at = self.one, ((self.one * 40_503 + self.two * 2_654_435_761) >> 7) & (TABLE - 1)
        entry = [table.take(at) for table, at in zip(self.follows, self.at)]
        self.said, self.times = [e >> 3 for e in entry], [e & 7 for e in entry]
        same = (self.said[0] == self.said[1]).view(np.int8)
        self.state = self.times[1] | self.times[0] << 3 | self.last << 7
        self.state += same * np.int64(64)

    def learn(self, ids: np.ndarray, right: list[np.ndarray], kind: np.ndarray) -> None:
        for table, at, times, held in zip(self.follows, self.at, self.times, right):
            times += held.view(np.int8) * np.int64(8)
            table[at] = ids << 3 | _NEXT.take(times)
        self.two, self.one = self.one, ids
        self.last = (self.last << 2 | kind) & 15

    def renew(self, states: np.ndarray, kinds: np.ndarray, rest: np.ndarray) -> None:
        """Learn from a stretch: the states and kinds of its ids, and the ids coded by order 0."""
        seen = np.bincount(states * 4 + kinds, minlength=_STATES * 4).reshape(_STATES, 4)[:, :_KINDS]
        # A step of each weight towards what would have coded the stretch better.
        wrong = seen * TOTAL - seen.sum(1, keepdims=True) * self.sizes
        total = int(seen.sum())
        self.weights = [w + (int((wrong * says).sum()) // total >> 9) for w, says in zip(self.weights, self.says)]
        self.kinds += seen
        self.ids += np.bincount(rest, minlength=1 << 16)
        self._mix()
        self._share()

    def _mix(self) -> None:
        whole = self.kinds.reshape(16, 2, 8, 8, _KINDS)  # last, same, order 1, order 2
        says = []
        for apart in ((0, 2), (0, 3), (1, 2, 3), ()):
            n = whole.sum(axis=apart, keepdims=True)
            chance = (n * 4 + 1) * 4_095 // (n.sum(axis=-1, keepdims=True) * 4 + _KINDS)
            says.append(np.broadcast_to(_LOG[np.maximum(chance, 1)], whole.shape).reshape(_STATES, _KINDS))
        self.says = says
        mixed = sum(w * s for w, s in zip(self.weights, says)) >> 16
        power = _POWER[np.minimum(mixed.max(axis=1, keepdims=True) - mixed, 20 * _STEPS)]
        self.sizes = 1 + power * (TOTAL - _KINDS) // power.sum(axis=1, keepdims=True)
        self.sizes[:, -1] += TOTAL - self.sizes.sum(axis=1)
        ends = self.sizes.cumsum(axis=1)
        # Kinds take three of four places for each state.
        self.kind = np.zeros((_STATES, 4), np.int64)
        self.kind[:, :_KINDS] = _pair(ends - self.sizes, self.sizes)
        self.kind = self.kind.reshape(-1)
        self.bounds = _pair(ends[:, 0], ends[:, 1])

    def _share(self) -> None:
        total = int(self.ids.sum())
        own = np.flatnonzero(self.ids * (2 * TOTAL) > total)  # ids of a share of their own; the others follow an escape
        if len(own) > TOTAL // 2:
            own = np.sort(np.argsort(-self.ids, kind="stable")[: TOTAL // 2])
        sizes = 1 + self.ids[own] * (TOTAL - 1 - len(own)) // (total + len(own) // 8 + 1)
        ends = np.cumsum(sizes)
        done = int(ends[-1]) if len(own) else 0
        self.share = np.full((1 << 16) + 1, done << 32 | TOTAL - done)
        self.share[own] = _pair(ends - sizes, sizes)
        self.apart = np.ones(1 << 16, bool)
        self.apart[own] = False
        self.symbol = np.repeat(np.append(own, _ESCAPE), np.append(sizes, TOTAL - done))


class _Writer:
    def __init__(self, lanes: int, ids: int):
        # An id takes at most 16 bits for its kind, its escape and itself each.
        self.words = 3 * ids + 4
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << WINDOW, np.int64)
        self.out = np.zeros(lanes * self.words, np.uint32)
        self.begin = np.arange(lanes) * self.words
        self.place = self.begin.copy()

    def put(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray | int) -> None:
        whole = isinstance(lanes, slice)
        low, width = self.low[lanes], self.range[lanes]  # where all lanes go on these are the lanes' own
        width >>= BITS
        low += width * start
        width *= size
        over = np.flatnonzero(low >= 1 << WINDOW)
        if len(over):  # one is carried to the word before
            self.out[self.place[over if whole else lanes.take(over)] - 1] += np.uint32(1)
            low[over] -= 1 << WINDOW
        small = np.flatnonzero(width < _LEAST)
        if len(small):
            mine, part = small if whole else lanes.take(small), low.take(small)
            at = self.place.take(mine)
            self.out[at] = part >> (WINDOW - WORD)
            self.place[mine] = at + 1
            low[small] = (part & _LOW) << WORD
            width[small] = width.take(small) << WORD
        if not whole:
            self.low[lanes], self.range[lanes] = low, width

    def end(self) -> tuple[np.ndarray, bytes]:
        """How many words each lane has, and all of them."""
        # The first words of a number inside the last range tell it; the reader takes what is missing for zeros.
        self.low += _LOW
        self.out[self.place[self.low >= 1 << WINDOW] - 1] += np.uint32(1)
        self.out[self.place] = (self.low >> (WINDOW - WORD)) & 0xFFFF
        used = self.place + 1 - self.begin
        ends = np.cumsum(used)
        out = self.out.take(np.arange(ends[-1]) + np.repeat(self.begin - ends + used, used))
        while (over := out >> 16).any():  # never from the first word of a lane
            out &= 0xFFFF
            out[:-1] += over[1:]
        return used, out.astype("<u2").tobytes()


class _Reader:
    def __init__(self, used: np.ndarray, words: np.ndarray):
        # Zeros after each lane, for what it looks ahead.
        self.place = np.cumsum(used + 3) - used - 3
        self.words = np.zeros(int((used + 3).sum()) + 3, np.int64)
        self.words[np.arange(len(words)) + np.repeat(3 * np.arange(len(used)), used)] = words
        self.code = np.zeros(len(used), np.int64)
        for _ in range(WINDOW // WORD):
            self.code = self.code << WORD | self.words[self.place]
            self.place += 1
        self.range = np.full(len(used), 1 << WINDOW, np.int64)

    def value(self, lanes: np.ndarray | slice) -> np.ndarray:
        self.unit, self.now = self.range[lanes], self.code[lanes]  # where all lanes go on these are the lanes' own
        self.unit >>= BITS
        # The quotient is below 2**17 and the divisor below 2**33, so no rounding reaches the next whole number.
        return np.minimum((self.now / self.unit).astype(np.int64), TOTAL - 1)

    def take(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray | int) -> None:
        whole, code, width = isinstance(lanes, slice), self.now, self.unit
        code -= width * start
        width *= size
        small = np.flatnonzero(width < _LEAST)
        if len(small):
            mine = small if whole else lanes.take(small)
            at = self.place.take(mine)
            code[small] = code.take(small) << WORD | self.words.take(at)
            width[small] = width.take(small) << WORD
            self.place[mine] = at + 1
        if not whole:
            self.code[lanes], self.range[lanes] = code, width


def _stretches(ids: int) -> Iterator[range]:
    at, size = 0, 1
    while at < ids:
        yield range(at, min(at + size, ids))
        at, size = at + size, min(2 * size if at else 1, STRETCH)


def _encode_block(ids: np.ndarray, lanes: int) -> tuple[np.ndarray, bytes]:
    longest, more = -(-len(ids) // lanes), len(ids) % lanes or lanes  # lanes of that length; the others have one id less
    by_lane = np.zeros((longest, lanes), np.int64)
    by_lane[:, :more] = ids[: more * longest].reshape(more, longest).T
    by_lane[: longest - 1, more:] = ids[more * longest :].reshape(lanes - more, longest - 1).T
    model, writer = _Model(lanes), _Writer(lanes, longest)
    for stretch in _stretches(longest):
        states, kinds, rests = [], [], []
        for t in stretch:
            live = lanes if t < longest - 1 else more
            model.keep(live)
            now, all_lanes = by_lane[t, :live], slice(0, live)
            model.look()
            right = [now == said for said in model.said]
            kind = np.where(right[1], 0, np.where(right[0], 1, 2))
            writer.put(all_lanes, *_parts(model.kind.take(model.state * 4 + kind)))
            some = np.flatnonzero(kind == 2)
            rest = now.take(some)
            if len(some):
                writer.put(some, *_parts(model.share.take(rest)))  # an id without a share has the place of the escape
                rare = np.flatnonzero(model.apart.take(rest))
                if len(rare):
                    writer.put(some.take(rare), rest.take(rare), 1)
            model.learn(now, right, kind)
            states.append(model.state)
            kinds.append(kind)
            rests.append(rest)
        model.renew(np.concatenate(states), np.concatenate(kinds), np.concatenate(rests))
    return writer.end()


def _decode_block(count: int, used: np.ndarray, words: np.ndarray) -> np.ndarray:
    lanes = len(used)
    longest, more = -(-count // lanes), count % lanes or lanes
    by_lane = np.zeros((longest, lanes), np.int64)
    model, reader = _Model(lanes), _Reader(used, words)
    for stretch in _stretches(longest):
        states, kinds, rests = [], [], []
        for t in stretch:
            live = lanes if t < longest - 1 else more
            model.keep(live)
            all_lanes = slice(0, live)
            model.look()
            value, (one, two) = reader.value(all_lanes), _parts(model.bounds.take(model.state))
            kind = (value >= one).view(np.int8) + (value >= two).astype(np.int64)
            reader.take(all_lanes, *_parts(model.kind.take(model.state * 4 + kind)))
            now = np.where(kind == 0, model.said[1], model.said[0])
            some = np.flatnonzero(kind == 2)
            rest = model.symbol.take(reader.value(some))
            if len(some):
                reader.take(some, *_parts(model.share.take(rest)))
                rare = np.flatnonzero(rest == _ESCAPE)
                if len(rare):
                    rest[rare] = found = reader.value(some.take(rare))
                    reader.take(some.take(rare), found, 1)
                now[some] = rest
            by_lane[t, :live] = now
            model.learn(now, [now == said for said in model.said], kind)
            states.append(model.state)
            kinds.append(kind)
            rests.append(rest)
        model.renew(np.concatenate(states), np.concatenate(kinds), np.concatenate(rests))
    return np.concatenate([by_lane[:, :more].T.reshape(-1), by_lane[: longest - 1, more:].T.reshape(-1)]).astype("<u4")


def _checksum(count: int, lanes: int, code: bytes) -> int:
    return zlib.crc32(code, zlib.crc32(struct.pack("<II", count, lanes)))


def encode(ids: np.ndarray) -> bytes:
    """A stream of blocks; ids are below 65,536."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids must be below 65536")
    out = [MAGIC]
    for start in range(0, len(ids), BLOCK * LANES):
        block = ids[start : start + BLOCK * LANES]
        lanes = min(-(-len(block) // min(SHORT, BLOCK)), LANES)
        used, words = _encode_block(block, lanes)
        code = used.astype("<u2").tobytes() + words
        out += [struct.pack(_HEAD, len(block), lanes, len(code), _checksum(len(block), lanes, code), zlib.crc32(block.astype("<u4").tobytes())), code]
    return b"".join(out)


def decode(stream: bytes) -> np.ndarray:
    """The ids of a stream; a damaged one is an error."""
    if stream[:4] != MAGIC:
        raise ValueError("not a stream of coded ids")
    out, at, head = [], 4, struct.calcsize(_HEAD)
    while at < len(stream):
        if at + head > len(stream):
            raise ValueError("a stream of coded ids ends early")
        count, lanes, size, coded, plain = struct.unpack_from(_HEAD, stream, at)
        code = stream[at + head : at + head + size]
        at += head + size
        if _checksum(count, lanes, code) != coded:
            raise ValueError("a block of coded ids is damaged")
        numbers = np.frombuffer(code, "<u2")
        found = _decode_block(count, numbers[:lanes].astype(np.int64), numbers[lanes:])
        if zlib.crc32(found.tobytes()) != plain:
            raise ValueError("a block of coded ids is damaged")
        out.append(found)
    return np.concatenate(out) if out else np.empty(0, "<u4")
