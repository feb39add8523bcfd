"""A model of texts by logistic context mixing.  NumPy only.

A text is a row of segments, each some white space and the word after it, and an end.  Common segments are
symbols of a lexicon, coded bit by bit along a prefix code made from their counts; the others are an escape
and are then spelled byte by byte.  For each bit, several predictors look up counts of zeros and ones under a
hash of their context and of the place in the code: no context, the segment before, the two before, and the
one before the last; for spelled bytes, the last 1, 2 and 4 bytes and all so far.  Their stretched
probabilities are added with weights that a gate selects, and the sum is refined by a table that is learnt
from what came out at such sums.  Weights are those that foretell the bits of all training texts best, each bit
from all counts but its own; for this the bits are counted by what the predictors say of them, in steps.

Counts are whole numbers, and costs are summed as whole numbers, so neither depends on any order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from granary.llm.tokens import Index, firsts, mix, word_hashes

#: Letters in a rough order of how common they are in Latin texts.  They only shape the code of spelled
#: bytes; any order gives a proper code.
_COMMON = b" etaonirsh\xc3dlcumpfgwbyvk,.\n-jxqz\xa9\xa8\xaa\xa0\xa7\xbc\xa4\xb6\xb3\xadTEAOINRSHDLCUMPFGWBYVKJXQZ0123456789'\"()!*|#$%&=@:;/_+?\x00"
#: Contexts of spelled bytes: the last 1, 2 and 4 bytes of the segment, and all of it so far.
ORDERS = (1, 2, 4, 0)
#: Predictors of a word and of a byte; for each, the two that gate: the longest context and a shorter one.
PREDICTORS, WORD_GATE, BYTE_GATE = 4, (2, 1), (3, 2)
#: Gates: how often the longest context was seen (4 steps) by how often the shorter one was (4 steps).
GATES = 16
#: Steps of the refining table over the stretched sum from -LIMIT to LIMIT, for each gate.
STEPS, LIMIT = 48, 12
#: The last symbol of the bytes' code: the segment ends.
STOP = 256
#: The first symbols of the lexicon's code: a segment that is spelled, and the text's end.
ESCAPE, END = 0, 1
#: Costs are counted in so many parts of a bit.
UNIT = 1 << 20
#: Costs of so many spelled segments are kept, and fewer than so many and a block's more.
KNOWN = 1 << 20
#: Bits are worked on in chunks of about so many, and symbols after their contexts are held against each other in chunks of so many.
_CHUNK, _ITEMS = 1 << 15, 1 << 18
#: Spelled segments that begin with the same bytes, up to so many, share the work on these.
_PREFIX = 16
_K = np.uint64(0x9E3779B97F4A7C15)
_START, _SPELLED = np.uint64(0x5A17), np.uint64(0xE5CA)

# Counts are kept in a byte each: whole up to 31, then in steps of 8.5 %.
_VALUES = np.concatenate([np.arange(32.0), np.floor(31 * 1.085 ** np.arange(1, 225))])
_EXACT = 32


def coded(counts: np.ndarray) -> np.ndarray:
    """Pairs (zeros, ones), one after another, as 16 bits each."""
    low = (np.searchsorted(_VALUES, counts, "right") - 1).astype(np.uint16)
    return low[0::2] | low[1::2] << np.uint16(8)


def _said(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = zero + one
    return np.log((one + 0.4) / (zero + 0.4)).astype(np.float32), ((seen > 0.5).astype(np.int8) + (seen > 3) + (seen > 30)).astype(np.int8)


def _tables() -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """What each pair of counts says, stretched, and how often it was seen; and the same less one zero, then less a one."""
    value = np.r_[_VALUES, _VALUES[-1:]][:256]
    zero, one = np.tile(value, 256), np.repeat(value, 256)
    less = lambda x: np.where((x > 0) & (x < _EXACT), x - 1, x)
    without = [_said(less(zero), one), _said(zero, less(one))]
    return _said(zero, one), (np.r_[without[0][0], without[1][0]].astype(np.float64), np.r_[without[0][1], without[1][1]])


_WHOLE, _WITHOUT = _tables()


@dataclass(frozen=True)
class Code:
    """A prefix code: the inner nodes and bits on the way to symbol s stand from first[s] to first[s + 1]."""

    first: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.first)


def prefix_code(weights: np.ndarray) -> Code:
    """The shortest code for these weights, of two symbols at least; ties go by the symbols' order."""
    n = len(weights)
    order = np.argsort(weights, kind="stable")
    leaf = [int(weights[i]) for i in order]
    parent, side, inner = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8), []
    a = b = 0
    # The lightest two of leaves and inner nodes, each kind in rising order, become one.
    for k in range(n - 1):
        total = 0
        for s in (0, 1):
            if b >= len(inner) or (a < n and leaf[a] <= inner[b]):
                at, w, a = int(order[a]), leaf[a], a + 1
            else:
                at, w, b = n + b, inner[b], b + 1
            parent[at], side[at] = n + k, s
            total += w
        inner.append(total)
    root, at, steps = 2 * n - 2, np.arange(n), []
    while (go := at != root).any():
        steps.append((np.flatnonzero(go), parent[at[go]], side[at[go]]))
        at = np.where(go, parent[at], at)
    lengths = np.zeros(n, np.int64)
    for symbols, _, _ in steps:
        lengths[symbols] += 1
    first = np.r_[0, np.cumsum(lengths)]
    node, bit = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int8)
    for up, (symbols, nodes, sides) in enumerate(steps):
        place = first[symbols + 1] - 1 - up
        node[place], bit[place] = nodes - n, sides
    return Code(first, node, bit)


BYTES = prefix_code(np.array([max(int(1e6 * ((_COMMON.index(c) if c in _COMMON else 400) + 3) ** -1.3), 1) for c in range(256)] + [150_000]))
_BYTE_NODES = mix((BYTES.node + 1).astype(np.uint64) * _K) * _K


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments begin, and how many each text has; white space at the end is a segment too."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin = np.zeros(n, bool)
    begin[1:] = space[1:] & ~space[:-1]
    begin[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    return starts, np.diff(np.searchsorted(starts, at))


@dataclass(frozen=True)
class Sizes:
    """Slots of the predictors' tables, as powers of 2: they follow the number of training words, up to a bound."""

    words: int
    bytes: int

    @staticmethod
    def of(n_words: int) -> Sizes:
        return Sizes(min(max(n_words.bit_length(), 15), 22), min(max(n_words.bit_length() - 4, 15), 18))


class Lexicon:
    """Hashes of the common segments and their code; counts of the escape and of ends come before theirs."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, escapes: int, ends: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.code = prefix_code(np.r_[max(escapes, 1), max(ends, 1), counts[order]])

    @cached_property
    def index(self) -> Index:
        return Index(self.hashes)

    @cached_property
    def names(self) -> np.ndarray:
        """A hash of each symbol as a context, and of a text's beginning after them."""
        out = mix(np.arange(len(self.hashes) + 3).astype(np.uint64) + np.uint64(9))
        out[ESCAPE], out[-1] = _SPELLED, _START
        return out

    @property
    def width(self) -> int:
        """Bits that tell symbols and the beginning apart."""
        return (len(self.hashes) + 2).bit_length()

    @cached_property
    def _order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = self.code.lengths
        begin = np.zeros(len(lengths), np.uint32)
        for k in range(min(32, int(lengths.max()))):
            go = np.flatnonzero(lengths > k)
            begin[go] |= self.code.bit[self.code.first[go] + k].astype(np.uint32) << np.uint32(31 - k)
        order = np.argsort(begin, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        return order, rank, begin[order]

    @property
    def rank(self) -> np.ndarray:
        """The place of each symbol in the order of codes."""
        return self._order[1]

    @property
    def ranked(self) -> np.ndarray:
        """The symbols in the order of codes."""
        return self._order[0]

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each symbol in the order of codes, where its bits begin in the code's lists and how many they are; a hash of the inner node at each place there, and its bit."""
        code = self.code
        return code.first[self.ranked], code.lengths[self.ranked], mix((code.node + 1).astype(np.uint64)) * _K, code.bit.astype(np.uint8)

    def shared(self, context: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many first bits the code of each symbol shares with the one before in the list, where that has the same context."""
        begin = self._order[2].take(rank)
        # The first bit that differs; whole numbers of 32 bits are exact as floats.
        same = 32 - np.frexp((begin[1:] ^ begin[:-1]).astype(np.float64))[1]
        return np.r_[np.zeros(min(len(rank), 1), np.uint8), np.where(context[1:] == context[:-1], same, 0).astype(np.uint8)]


@dataclass
class Parsed:
    """Texts as symbols, an end after each; ``ways`` has the two symbols before and the symbol's place in the order of codes, as one number.

    ``keys`` are three hashed contexts of each symbol, where they aren't those of the symbols before.
    ``data`` and ``at`` are the different spelled segments, each with STOP, ``times`` how often each came and
    ``where`` which one stands at each escape.  ``starts`` and ``ends`` are the places of all segments.
    """

    symbols: np.ndarray
    text: np.ndarray
    keys: tuple[np.ndarray, ...]
    data: np.ndarray
    at: np.ndarray
    times: np.ndarray
    where: np.ndarray
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Hashes of the different spelled segments, sorted.
    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ways: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def only(self, which: np.ndarray) -> Parsed:
        """Some of the different spelled segments, without any text."""
        data, at = cut(self.data, self.at[which], self.at[which + 1])
        none = np.zeros(0, np.int64)
        return Parsed(none, none, (), data, at, self.times[which], none, names=self.names[which])


class Pool:
    """The different spelled segments of many blocks and how often they came, so that each is worked on once.

    ``add`` gives what is to be worked on when more than about ``most`` bytes of them are held, ``close`` the rest.
    """

    def __init__(self, most: int = 3 << 20):
        self.most, self.parts, self.merged, self.size = most, [], 0, 0

    def _merge(self) -> Parsed:
        parts = [p for p in self.parts if len(p.names)]
        return _joined(parts)[0] if len(parts) > 1 else parts[0] if parts else self.parts[0]

    def add(self, p: Parsed) -> Parsed | None:
        self.parts.append(p.only(np.arange(len(p.names))))
        self.size += len(p.data)
        if self.size <= self.merged + max(self.merged, self.most // 2):
            return None
        p = self._merge()
        if len(p.data) > self.most:
            self.parts, self.merged, self.size = [], 0, 0
            return p
        self.parts, self.merged, self.size = [p], len(p.data), len(p.data)
        return None

    def close(self) -> Parsed | None:
        return self._merge() if self.parts else None


def _joined(parts: list[Parsed]) -> tuple[Parsed, np.ndarray]:
    """The different spelled segments of some blocks, without any text, and which one each of theirs is, block by block."""
    names, first, where = np.unique(np.concatenate([p.names for p in parts]), return_index=True, return_inverse=True)
    times = np.bincount(where, np.concatenate([p.times for p in parts])).astype(np.int64)
    starts = np.cumsum([0, *[len(p.data) for p in parts]])
    begin = np.concatenate([p.at[:-1] + a for p, a in zip(parts, starts)])
    end = np.concatenate([p.at[1:] + a for p, a in zip(parts, starts)])
    data, at = cut(np.concatenate([p.data for p in parts]), begin[first], end[first])
    none = np.zeros(0, np.int64)
    return Parsed(none, none, (), data, at, times, none, names=names), where


class Ways:
    """Symbols after their contexts (``Parsed.ways``) of many blocks, so that equal ones are worked on once.

    ``add`` gives the sorted different ones and how often each came when more than ``most`` are held, ``close`` the rest.
    """

    def __init__(self, most: int = 1 << 22):
        self.most, self.parts, self.size = most, [], 0

    def add(self, p: Parsed) -> tuple[np.ndarray, np.ndarray] | None:
        self.parts.append(p.ways)
        self.size += len(p.ways)
        return self.close() if self.size > self.most else None

    def close(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.size:
            return None
        ways = np.concatenate(self.parts)
        self.parts, self.size = [], 0
        ways.sort()
        new = np.flatnonzero(np.r_[True, ways[1:] != ways[:-1]])
        return ways[new], np.diff(np.r_[new, len(ways)])


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes between some places, one after another, and where each begins and the last ends."""
    size = ends - starts
    at = np.r_[0, np.cumsum(size)]
    return data[np.arange(at[-1]) + np.repeat(starts - at[:-1], size)], at


def parse(data: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> Parsed:
    starts, counts = segments(data, at)
    ends = np.r_[starts[1:], len(data)][: len(starts)]
    hashes = word_hashes(data, starts, ends)
    found, hit = lexicon.index.find(hashes)
    after = np.cumsum(counts)
    symbols = np.insert(np.where(hit, found + 2, ESCAPE), after, END)
    text = np.repeat(np.arange(len(counts)), counts + 1)
    # The symbols before, at a text's beginning a number after all symbols.
    begin = after + np.arange(len(counts)) - counts
    one = np.r_[np.zeros(1, np.uint64), symbols[:-1].astype(np.uint64)][: len(symbols)]
    one[begin] = len(lexicon.hashes) + 2
    two = np.r_[np.zeros(1, np.uint64), one[:-1]][: len(symbols)]
    two[begin] = len(lexicon.hashes) + 2
    width = np.uint64(lexicon.width)
    ways = ((one << width | two) << width) | lexicon.rank.take(symbols)
    spelled = np.flatnonzero(~hit)
    names, first, where, times = np.unique(hashes[spelled], return_index=True, return_inverse=True, return_counts=True)
    first = spelled[first]
    held, to = cut(data, starts[first], ends[first])
    out = np.insert(held.astype(np.int16), to[1:], STOP)
    return Parsed(symbols, text, (), out, to + np.arange(len(to)), times, where, starts, ends, names, ways)


def _on_ways(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bit of each symbol the number of the symbol in the list, and its place in the code's lists."""
    lengths = code.lengths[symbols]
    owner = np.repeat(np.arange(len(symbols)), lengths)
    way = np.repeat(code.first[symbols] - firsts(lengths), lengths)
    way += np.arange(len(owner))
    return owner, way


def _runs(bits: np.ndarray):
    """Ranges of items with about _CHUNK bits together."""
    run, i = np.cumsum(bits), 0
    while i < len(bits):
        k = max(i + 1, int(np.searchsorted(run, (run[i - 1] if i else 0) + _CHUNK)))
        yield i, k
        i = k


def _word_keys(ways: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed contexts of symbols: the one before, the two before, and the one before the last."""
    width = np.uint64(lexicon.width)
    mask = (np.uint64(1) << width) - np.uint64(1)
    one, two = lexicon.names.take((ways >> (width + width)).view(np.int64)), lexicon.names.take((ways >> width & mask).view(np.int64))
    return one * _K, mix(one + two * _K), mix(two + np.uint64(0x77))


def _split(ways: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands before the last ``width`` bits, and these."""
    return ways >> np.uint64(width), (ways & np.uint64((1 << width) - 1)).view(np.int64)


@dataclass
class Shared:
    """Some symbols after their contexts, sorted, with how many first bits each shares with the one before and how many it has of its own."""

    lexicon: Lexicon
    rank: np.ndarray
    shared: np.ndarray
    own: np.ndarray

    @staticmethod
    def of(lexicon: Lexicon, context: np.ndarray, rank: np.ndarray):
        """(first item, what it and those after it share), in chunks."""
        for i in range(0, len(rank), _ITEMS):
            some = rank[i : i + _ITEMS]
            shared = lexicon.shared(context[i : i + _ITEMS], some)
            yield i, Shared(lexicon, some, shared, lexicon.lists[1].take(some) - shared)

    def bits(self):
        """(first item, last, first own bit, last, the item of each from there, its place in the code's lists), in smaller chunks."""
        begin = self.lexicon.lists[0].take(self.rank)
        begin += self.shared
        at = np.r_[0, np.cumsum(self.own)]
        begin -= at[:-1]
        for i, k in _runs(self.own):
            own = self.own[i:k]
            way = np.repeat(begin[i:k], own)
            way += np.arange(at[i], at[k])
            yield i, k, at[i], at[k], np.repeat(np.arange(k - i), own), way


def _shares(shared: np.ndarray, own: np.ndarray):
    """For each first bit that some items share: which items have it of their own and others after them share it, where it stands among all own bits, and the first item after them that doesn't."""
    place = firsts(own) - shared
    for k in range(int(shared.max()) if len(shared) else 0):
        own_way = shared <= k
        begins = np.flatnonzero(own_way[:-1] & ~own_way[1:])
        ends = np.flatnonzero(~own_way[:-1] & own_way[1:]) + 1
        if len(ends) < len(begins):
            ends = np.append(ends, len(shared))
        yield k, begins, place.take(begins) + k, ends


def _times(times: np.ndarray, shared: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How often each own bit comes, in all items that share it."""
    out, sums = np.repeat(times, own), np.r_[0, np.cumsum(times)]
    for _, begins, place, ends in _shares(shared, own):
        out[place] = sums[ends] - sums[begins]
    return out


def _slots(key: np.ndarray, node: np.ndarray, shift: np.uint64) -> np.ndarray:
    h = key + node
    h >>= shift
    return h.view(np.int64)


def word_bits(ways: np.ndarray, lexicon: Lexicon, sizes: Sizes):
    """(first item, what it and those after it share, their bits in smaller chunks: first, last, places in the code's lists, slots of the hashed predictors).

    ``ways`` are sorted; bits that follow from the same contexts and bits before come once.
    """
    shift, nodes = np.uint64(64 - sizes.words), lexicon.lists[2]

    def bits(some: np.ndarray, same: Shared):
        for i, k, a, b, owner, way in same.bits():
            node = nodes.take(way)
            yield a, b, way, [_slots(key.take(owner), node, shift) for key in _word_keys(some[i:k], lexicon)]

    for i, same in Shared.of(lexicon, *_split(ways, lexicon.width)):
        yield i, same, bits(ways[i : i + len(same.own)], same)


def _in_order(p: Parsed) -> tuple[np.ndarray, Parsed, np.ndarray]:
    """The order of the spelled segments by their first bytes, they in this order, and how many first bytes each shares with the one before."""
    n = len(p.at) - 1
    size = np.diff(p.at) - 1
    place = np.arange(_PREFIX)
    begin = np.zeros((n, _PREFIX), np.uint8)
    for k in range(_PREFIX):
        go = np.flatnonzero(size > k)
        begin[go, k] = p.data[p.at[go] + k]
    both = begin.view(">u8").astype(np.uint64)
    order = np.lexsort((both[:, 1], both[:, 0])) if n else np.zeros(0, np.int64)
    begin, size = begin[order], size[order]
    differs = begin[1:] != begin[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), len(place))
    shared = np.minimum(shared, np.minimum(size[1:], size[:-1]))
    data, at = cut(p.data, p.at[order], p.at[order + 1])
    return order, Parsed(p.symbols, p.text, (), data, at, p.times[order], p.where), np.r_[np.zeros(min(n, 1), np.int64), shared]


def _byte_times(p: Parsed, shared: np.ndarray) -> np.ndarray:
    """How often each byte of ordered segments comes in those that begin alike up to it."""
    out = np.repeat(p.times, np.diff(p.at))
    sums, size = np.r_[0, np.cumsum(p.times)], np.diff(p.at)
    for k in range(_PREFIX):
        begins = np.flatnonzero(shared <= k)
        some = np.diff(sums[np.r_[begins, len(size)]])
        go = size[begins] > k
        out[p.at[begins[go]] + k] = some[go]
    return out


def byte_bits(p: Parsed, shared: np.ndarray, sizes: Sizes):
    """(the place in the data of each bit's byte, bits, slots) of ordered spelled segments, but for bytes that are shared with the one before."""
    shift = np.uint64(64 - sizes.bytes)
    if not len(p.data):
        return
    whole = np.r_[0, np.cumsum(BYTES.lengths[p.data])]
    for i, k in _runs(whole[p.at[1:]] - whole[p.at[:-1] + shared]):
        a, b = p.at[i], p.at[k]
        data, size = p.data[a:b].astype(np.uint64), np.diff(p.at[i : k + 1])
        place = np.arange(b - a) - np.repeat(p.at[i:k] - a, size)
        own = np.flatnonzero(place >= np.repeat(shared[i:k], size))
        # All bytes so far: sums over the segment of values that tell byte and place.
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix((data << np.uint64(32)) + place.astype(np.uint64)))]
        place = place.take(own)
        history, past = {0: mix(sums.take(own) - sums.take(own - place) + np.uint64(5))}, np.full(len(own), 77, np.uint64)
        for j in range(1, max(ORDERS) + 1):
            past = np.where(place >= j, mix(past * _K + data.take(np.maximum(own - j, 0)) + np.uint64(j)), past)
            history[j] = past
        owner, way = _on_ways(BYTES, p.data[a:b].take(own))
        node = _BYTE_NODES.take(way)
        yield own.take(owner) + a, BYTES.bit.take(way), [_slots(history[j].take(owner), node, shift) for j in ORDERS]


def new_counts(lexicon: Lexicon, sizes: Sizes) -> list[np.ndarray]:
    """Empty tables of the predictors of words, then of bytes; zeros stand at even places, ones at odd."""
    slots = [len(lexicon.hashes) + 1, *[1 << sizes.words] * 3, *[1 << sizes.bytes] * len(ORDERS)]
    return [np.zeros(2 * n, np.int64 if n < 1 << 20 else np.int32) for n in slots]


def count(p: Parsed, lexicon: Lexicon, sizes: Sizes, counts: list[np.ndarray]) -> None:
    """Adds what the texts hold."""
    count_words(p, lexicon, sizes, counts)
    count_spelled(p, sizes, counts)


def count_words(p: Parsed, lexicon: Lexicon, sizes: Sizes, counts: list[np.ndarray]) -> None:
    """Adds the symbols."""
    pool = Ways()
    for some in (pool.add(p), pool.close()):
        if some is not None:
            count_ways(*some, lexicon, sizes, counts)


def count_ways(ways: np.ndarray, times: np.ndarray, lexicon: Lexicon, sizes: Sizes, counts: list[np.ndarray]) -> None:
    """Adds different symbols after their contexts, sorted, each as often as it comes."""
    code, width, shift = lexicon.code, lexicon.width, np.uint64(64 - sizes.words)
    pairs, rank = _split(ways, width)
    # Without a context, each symbol adds to its way as often as it comes.
    often = np.bincount(lexicon.ranked.take(rank), times).astype(np.int64)
    owner, way = _on_ways(code, np.flatnonzero(often))
    np.add.at(counts[0], code.node[way] * 2 + code.bit[way], often[often > 0][owner].astype(counts[0].dtype))
    one, two = _split(pairs, width)
    for j, context in enumerate((one, pairs, two.view(np.uint64))):
        found, place, n = context, rank, times
        if context is not pairs:
            # Symbols after one context of two: different ones again, with the sums of their times.
            room = 64 - 2 * width
            large = times >> room > 0
            both = (context << np.uint64(width) | rank.view(np.uint64)) << np.uint64(room)
            both |= np.where(large, 0, times).view(np.uint64)
            both.sort()
            both, n = _split(both, room)
            new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            found, place = _split(both.take(new), width)
            n = np.add.reduceat(n, new)
            if large.any():
                np.add.at(n, np.searchsorted(both.take(new), context[large] << np.uint64(width) | rank[large].view(np.uint64)), times[large])
        table = counts[j + 1]
        _, _, nodes, bits = lexicon.lists
        for first, same in Shared.of(lexicon, found, place):
            often = _times(n[first : first + len(same.own)], same.shared, same.own).astype(table.dtype)
            # As a context stands in ``ways``, with any other beside it where only one counts.
            key = _word_keys(found[first : first + len(same.own)] << np.uint64((2, 1, 1)[j] * width), lexicon)[j]
            for i, k, a, b, owner, way in same.bits():
                slot = _slots(key[i:k].take(owner), nodes.take(way), shift)
                slot <<= 1
                slot += bits.take(way)
                np.add.at(table, slot, often[a:b])


def count_spelled(p: Parsed, sizes: Sizes, counts: list[np.ndarray]) -> None:
    """Adds the spelled segments, each as often as it comes."""
    _, p, shared = _in_order(p)
    times = _byte_times(p, shared)
    for place, bit, slots in byte_bits(p, shared, sizes):
        weight = times.take(place)
        for table, s in zip(counts[PREDICTORS:], slots):
            np.add.at(table, s * 2 + bit, weight.astype(table.dtype))


_MIDDLE = (np.arange(GATES * STEPS) % STEPS + 0.5) * (2 * LIMIT / STEPS) - LIMIT
_PRIOR = 1 / (1 + np.exp(-_MIDDLE))
_FINE = 1 << 12
#: Parts of a bit that a zero and a one cost at each step of the final sum.
_COST = np.rint(np.log2(1 + np.exp(np.outer([1, -1], (np.arange(_FINE) + 0.5) * (2 * LIMIT / _FINE) - LIMIT))) * UNIT).astype(np.int64).ravel()


#: Bounds of the 16 steps into which stretched probabilities are sorted to learn from them, and what stands for each step.
_BOUNDS = np.array([-7.0, -5.2, -3.9, -2.9, -2.0, -1.2, -0.4, 0.0, 0.4, 1.2, 2.0, 2.9, 3.9, 5.2, 7.0])
_STANDS = np.r_[-8.2, (_BOUNDS[:-1] + _BOUNDS[1:]) / 2, 8.2]
#: By pair of counts less the bit itself: its step, below how often it was seen.
_STEP = np.searchsorted(_BOUNDS, _WITHOUT[0], "right").astype(np.uint8)
_SEEN_STEP = (_WITHOUT[1].astype(np.uint8) << np.uint8(4)) + _STEP
#: Cells of the table of what is learnt from: the bit, how often each gating predictor was seen, and each predictor's step.
CELLS = 1 << 21
#: Weights are drawn to where they begin as if by so much of what was seen.
_DRAWN = 20.0


@dataclass
class Weights:
    """Weights by gate, and the refining table's counts; one each for words and for bytes.

    ``seen`` counts, over all that is learnt from, each combination of the bit and of what the predictors say of
    it, in 16 steps each, when the bit itself isn't counted.
    """

    gated: tuple[int, int]
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, PREDICTORS), 0.35))
    refined: np.ndarray = field(default_factory=lambda: np.zeros((GATES * STEPS, 2)))
    seen: np.ndarray | None = None

    def _refining(self) -> np.ndarray:
        # A step of the table begins as what the sum itself says, worth 20 bits.
        p = np.clip((self.refined[:, 1] + 20 * _PRIOR) / (self.refined.sum(axis=1) + 20), 1e-7, 1 - 1e-7)
        return np.log(p / (1 - p)).astype(np.float32)

    def _gate(self, levels: list[np.ndarray]) -> np.ndarray:
        return (levels[0] * np.int8(4) + levels[1]).astype(np.int64)

    def _fields(self) -> list[tuple[int, int, int]]:
        """Predictors, gating ones first, with the place and size of their bits in the number of a cell."""
        rest = [j for j in range(PREDICTORS) if j not in self.gated]
        return [(self.gated[0], 14, 6), (self.gated[1], 8, 6), (rest[0], 4, 4), (rest[1], 0, 4)]

    def steps(self, tables: list[np.ndarray]) -> list[np.ndarray]:
        """What the predictors' tables say where a bit is zero, then one, without the bit itself: parts of the number of a cell, by slot and bit."""
        out = []
        for table, (_, at, size) in zip(tables, sorted(self._fields())):
            parts = (_SEEN_STEP if size == 6 else _STEP).reshape(2, -1).T[:, :2]
            out.append(np.ascontiguousarray(parts).take(table, axis=0).ravel())
        return out

    def see(self, bit: np.ndarray, steps: list[np.ndarray], slots: list[np.ndarray], times: np.ndarray, first: np.ndarray | None = None) -> None:
        """Counts some bits, of which ``slots`` are the places in ``steps``; in whole numbers, so in any order.

        ``first`` is the step of the first predictor, where that is known.
        """
        if self.seen is None:
            self.seen = np.zeros(CELLS, np.int64)
        cell = bit.astype(np.int64)
        cell <<= 20
        fields = sorted(self._fields())
        if first is not None:
            cell += first.astype(np.int64) << fields[0][1]
            fields = fields[1:]
        for table, slot, (_, at, _) in zip(steps, slots, fields):
            place = slot << 1
            place += bit
            part = table.take(place).astype(np.int64)
            part <<= at
            cell += part
        np.add.at(self.seen, cell, times)

    def settle(self) -> None:
        """The weights that foretell all that was seen best, found by Newton's steps for each gate, and the refining table at these."""
        if self.seen is None or not self.seen.any():
            return
        both = self.seen.reshape(2, -1)
        cell = np.flatnonzero(both.any(axis=0))
        zeros, ones = both[:, cell].astype(np.float64)
        x, levels = np.empty((len(cell), PREDICTORS)), []
        for j, at, size in self._fields():
            part = cell >> at & ((1 << size) - 1)
            x[:, j] = _STANDS[part & 15]
            levels += [part >> 4] if size == 6 else []
        gate = self._gate(levels)
        for g in np.unique(gate):
            own = gate == g
            self.weights[g] = _best(x[own], zeros[own], ones[own], self.weights[g])
        total = np.clip((self.weights[gate] * x).sum(axis=1), -LIMIT, LIMIT)
        at = _cell(gate, total) * 2
        self.refined = (np.bincount(at, zeros, GATES * STEPS * 2) + np.bincount(at + 1, ones, GATES * STEPS * 2)).reshape(-1, 2)

    def cost(self, bit: np.ndarray, codes: list[np.ndarray], first: np.ndarray | None = None) -> np.ndarray:
        """What each bit costs, in parts of a bit; ``first`` is what the first predictor says, where that is known."""
        said, seen = _WHOLE
        codes = [c.astype(np.intp) for c in codes]
        known = [] if first is None else [first]
        gate = self._gate([seen.take(codes[g - len(known)]) for g in self.gated])
        weights = np.ascontiguousarray(self.weights.astype(np.float32).T)
        total = np.zeros(len(gate), np.float32)
        for j, x in enumerate([*known, *codes]):
            part = weights[j].take(gate)
            part *= x if j < len(known) else said.take(x)
            total += part
        np.clip(total, -LIMIT, LIMIT, out=total)
        total += self._refining().take(_cell(gate, total))
        # Both halves of the sum are within LIMIT or a little more; a step is a place in the list of costs.
        total *= np.float32(_FINE / (4 * LIMIT))
        total += np.float32(_FINE / 2)
        np.clip(total, 0, _FINE - 1, out=total)
        step = total.astype(np.intp)
        step += bit.astype(np.intp) * _FINE
        return _COST.take(step)


def _best(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Weights of least cost for how often a zero and a one came where the predictors say ``x``, drawn to ``begin``."""

    def cost(w: np.ndarray) -> float:
        total = x @ w
        return float((zeros * np.logaddexp(0, total) + ones * np.logaddexp(0, -total)).sum() + _DRAWN / 2 * ((w - begin) ** 2).sum())

    w, least = begin.copy(), cost(begin)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((zeros + ones) * p - ones) + _DRAWN * (w - begin)
        bend = (x * ((zeros + ones) * p * (1 - p))[:, None]).T @ x + _DRAWN * np.eye(len(w))
        step, far = np.linalg.solve(bend, slope), 1.0
        while far > 1e-4 and (now := cost(w - far * step)) >= least:
            far /= 2
        if far <= 1e-4 or least - now < 1e-9 * least:
            break
        w, least = w - far * step, now
    return w


def _cell(gate: np.ndarray, total: np.ndarray) -> np.ndarray:
    return gate * STEPS + np.minimum((total + np.float32(LIMIT)) * np.float32(STEPS / (2 * LIMIT)), STEPS - 1).astype(np.int64)


@dataclass
class Model:
    """Tables of coded counts, and what mixes them."""

    lexicon: Lexicon
    sizes: Sizes
    tables: list[np.ndarray]
    words: Weights = field(default_factory=lambda: Weights(WORD_GATE))
    bytes: Weights = field(default_factory=lambda: Weights(BYTE_GATE))
    #: Hashes of spelled segments, sorted, and what they cost, as far as this process has found out.
    known: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))

    def see(self, p: Parsed) -> None:
        """Counts what the predictors say of the bits of texts that were counted."""
        self.see_words(p)
        self.see_spelled(p)

    def see_words(self, p: Parsed) -> None:
        pool = Ways()
        for some in (pool.add(p), pool.close()):
            if some is not None:
                self.see_ways(*some)

    def see_ways(self, ways: np.ndarray, times: np.ndarray) -> None:
        """The same of different symbols after their contexts, sorted, each as often as it comes."""
        code, bits = self.lexicon.code, self.lexicon.lists[3]
        steps = self._word_steps[1:]
        first = self._word_steps[0].take(code.node * 2 + code.bit)
        for i, same, chunks in word_bits(ways, self.lexicon, self.sizes):
            often = _times(times[i : i + len(same.own)], same.shared, same.own)
            for a, b, way, slots in chunks:
                self.words.see(bits.take(way), steps, slots, often[a:b], first.take(way))

    def see_spelled(self, p: Parsed) -> None:
        _, p, shared = _in_order(p)
        times, steps = _byte_times(p, shared), self._byte_steps
        for place, bit, slots in byte_bits(p, shared, self.sizes):
            self.bytes.see(bit, steps, slots, times.take(place))

    @cached_property
    def _word_steps(self) -> list[np.ndarray]:
        return self.words.steps(self.tables[:PREDICTORS])

    @cached_property
    def _byte_steps(self) -> list[np.ndarray]:
        return self.bytes.steps(self.tables[PREDICTORS:])

    def settle(self) -> None:
        """Weights and refining tables from all that was seen."""
        self.words.settle()
        self.bytes.settle()

    def learn(self, p: Parsed) -> None:
        """Weights and refining tables from texts that were counted."""
        self.see(p)
        self.settle()

    def spelled(self, p: Parsed) -> np.ndarray:
        """What each spelled segment costs."""
        if not len(p.data):
            return np.zeros(len(p.at) - 1, np.int64)
        order, p, shared = _in_order(p)
        size, costs = np.diff(p.at), np.zeros(len(p.data))
        for place, bit, slots in byte_bits(p, shared, self.sizes):
            cost = self.bytes.cost(bit, [t.take(s) for t, s in zip(self.tables[PREDICTORS:], slots)])
            # Whole numbers below 2^53 are added exactly.
            costs[place[0] : place[-1] + 1] += np.bincount(place - place[0], cost)
        sums = np.r_[0, np.cumsum(costs.astype(np.int64))]
        found = np.diff(sums[p.at])
        # Bytes that are shared cost what they cost where they came first.
        for k in range(_PREFIX):
            begins = np.flatnonzero(shared <= k)
            at = p.at[begins] + np.minimum(k, size[begins] - 1)
            often = np.diff(np.r_[begins, len(size)])
            here = np.repeat(np.where(size[begins] > k, costs[at], 0).astype(np.int64), often)
            here[begins] = 0
            found += here
        out = np.empty_like(found)
        out[order] = found
        return out

    def spelled_once(self, p: Parsed) -> np.ndarray:
        """The same, where a segment that an earlier block had isn't worked on again."""
        if len(p.names) < len(p.at) - 1:
            return self.spelled(p)
        names, costs = self.known
        at = np.minimum(np.searchsorted(names, p.names), max(len(names) - 1, 0))
        hit = names[at] == p.names if len(names) else np.zeros(len(p.names), bool)
        new = np.flatnonzero(~hit)
        out = np.zeros(len(p.names), np.int64)
        out[hit] = costs[at[hit]]
        out[new] = self.spelled(p.only(new))
        if len(names) + len(new) > KNOWN:
            names, costs = names[:0], costs[:0]
        place = np.searchsorted(names, p.names[new])
        self.known = np.insert(names, place, p.names[new]), np.insert(costs, place, out[new])
        return out

    def cost(self, p: Parsed) -> np.ndarray:
        """What each symbol costs, spelling included."""
        return self.costs([p])[0]

    def costs(self, blocks: list[Parsed]) -> list[np.ndarray]:
        """The same for each of some blocks, where what they have in common is worked on once."""
        if any(p.keys for p in blocks):
            out = np.concatenate([self._apart(p) for p in blocks])
        else:
            ways = np.concatenate([p.ways for p in blocks])
            order = np.argsort(ways)
            ways = ways.take(order)
            new = np.r_[np.ones(min(len(ways), 1), bool), ways[1:] != ways[:-1]]
            out = np.empty(len(ways), np.int64)
            out[order] = self._of_ways(ways[new]).take(np.cumsum(new) - 1)
        out = np.split(out, np.cumsum([len(p.symbols) for p in blocks])[:-1])
        if len(blocks) == 1:
            spelled = [self.spelled_once(blocks[0])]
        else:
            whole, where = _joined(blocks)
            spelled = self.spelled_once(whole).take(where)
            spelled = np.split(spelled, np.cumsum([len(p.names) for p in blocks])[:-1])
        for p, own, costs in zip(blocks, out, spelled):
            own[p.symbols == ESCAPE] += costs[p.where]
        return out

    def _of_ways(self, ways: np.ndarray) -> np.ndarray:
        """What each of different symbols after their contexts, sorted, costs without its spelling."""
        out, bits = np.zeros(len(ways), np.int64), self.lexicon.lists[3]
        first = _WHOLE[0].take(self.tables[0].take(self.lexicon.code.node))
        for i, same, chunks in word_bits(ways, self.lexicon, self.sizes):
            costs = np.empty(int(same.own.sum()), np.int64)
            for a, b, way, slots in chunks:
                costs[a:b] = self.words.cost(bits.take(way), [t.take(s) for t, s in zip(self.tables[1:], slots)], first.take(way))
            sums = np.r_[0, np.cumsum(costs)]
            here = out[i : i + len(same.own)]
            here += np.diff(sums[np.r_[0, np.cumsum(same.own)]])
            for k, begins, place, ends in _shares(same.shared, same.own):
                here[same.shared > k] += np.repeat(costs[place], ends - begins - 1)
        return out

    def _apart(self, p: Parsed) -> np.ndarray:
        """The same for symbols with contexts of their own."""
        code, shift = self.lexicon.code, np.uint64(64 - self.sizes.words)
        owner, way = _on_ways(code, p.symbols)
        node = code.node.take(way)
        slots = [_slots(key.take(owner), mix((node + 1).astype(np.uint64)) * _K, shift) for key in p.keys]
        cost = self.words.cost(code.bit.take(way), [t.take(s) for t, s in zip(self.tables[1:], slots)], _WHOLE[0][self.tables[0][node]])
        return np.bincount(owner, cost, len(p.symbols)).astype(np.int64)
