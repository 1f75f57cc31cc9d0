"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its bytes (A-Z lower-cased) and one end. Each symbol is a path of yes/no decisions in
a Huffman tree that depends on the symbol before and a class of the one before that; trees follow
the counts of all training texts. For every decision several predictors, each with a context of
its own (that of the tree, the last three bytes, the last five, the word so far with the word before), look into a hashed
table of how often the decision went either way in all training texts. Their log-odds are

* mixed: added up under weights chosen by a gate (how many contexts were ever seen, and how deep
  in the tree the decision is), plus weights of the text itself that follow the errors made so
  far after every ``CHUNK`` bytes;
* refined: a map from (gate, mixed log-odds) to log-odds as observed, followed between its nodes.

The probabilities of all decisions multiply to the text's, so that the sum of their logarithms
is a true code length (bits per byte of the text). Gate weights and map are learned from every
training text: the texts are dealt to two sides by a hash, each side meets the tables of the other,
so that weights are never learned on a text's own counts (nor on those of its copies), and Spark
adds up how often which levels of log-odds met which outcome. That table has a fixed size; weights
and map are fitted to it. The scores are then given with the tables of both sides added up.

A score depends on the text and the training texts alone, not on the layout of the table. NULL
and empty texts are one end. A NULL id is not held out. Rows that repeat are scored row by row.
Without training texts all decisions are even and all tokens unknown; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.llm.ragged import Block, blocks
from lexivane.session import scratch_path

TABLE_BITS = 20  # slots of each hashed context, as a power of two: memory, not a limit of the data
CHUNK = 2048  # bytes of a text after which its own weights change
PIECE = 1 << 15  # bytes expanded together while counting
COUNT_BYTES = 1 << 18  # text whose contexts are hashed together while counting
HELD = 1 << 19  # symbols held until they are added to the tables
FULL = 1 << 26  # symbols after which a task sends its tables on, so that 32 bits hold their counts
LANE_BYTES = 1 << 17  # text scored side by side; a longer text alone
LEVEL_EDGES = (0.4, 0.8, 1.3, 1.9, 2.7, 3.8, 5.3)  # of log-odds, either sign; zero is a level of its own
LEVELS = 2 * len(LEVEL_EDGES) + 3
STEPS = 12  # of Newton's method, at most
PULL = 50  # decisions by which weights and map are held at their start
ODDS_SCALE = 15  # steps of stored log-odds per unit
PRIOR = 0.4  # added to both counts of a slot
RATE = 2.0  # of the text's own weights
HOT_WORDS = 1 << 19  # so many of the most frequent words are looked up where the texts are,
HOT_WORD_BYTES = 64  # if not longer than this; the others after a shuffle
PART_BYTES = 1 << 23  # text whose words are counted together
CELL = 1 << 12  # slots of one row of a shuffled table
END = 256
CLASSES = 16  # of the last symbol but one
TREES = 2048
_CLASS = (np.arange(257, dtype=np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.int32) * np.int32(257)
_GATES = 12
_NODES = 33  # of the map, over log-odds from -8 to 8
_FINE = 1025  # places at which it is read
_SALT = 0x5851F42D


# --- decisions ------------------------------------------------------------------------


@dataclass
class Code:
    """Paths of all symbols in the trees: tree of each context, and per tree and symbol the start
    and length of a path; per step of a path the decision's number (times 8), how deep it
    is (0, 1 or more; times 2) and its outcome, in one number."""

    tree_of: np.ndarray
    start: np.ndarray
    length: np.ndarray
    step: np.ndarray
    n_nodes: int


def build_code(pairs: np.ndarray) -> Code:
    """From how often each symbol (257) follows each context (``CLASSES`` x 257 symbols before).

    A context with at least a ``TREES``-th of all symbols has a tree of its own, so there are at
    most as many; others take the tree of the symbol before, and that of a symbol that never
    occurs is the tree of all. Every symbol has a path in every tree.
    """
    total = pairs.sum()
    by_symbol = pairs.reshape(CLASSES, 257, 257).sum(axis=0)
    seen = np.flatnonzero(by_symbol.sum(axis=1))
    own = np.flatnonzero(pairs.sum(axis=1) * TREES >= max(total, 1))
    tree = np.zeros(257, np.int64)
    tree[seen] = 1 + np.arange(len(seen))
    tree_of = np.tile(tree, CLASSES)
    tree_of[own] = 1 + len(seen) + np.arange(len(own))
    weights = np.vstack([by_symbol.sum(axis=0), by_symbol[seen], pairs[own]]) * 257 + 1
    starts, lengths, steps = [], [], []
    for t, row in enumerate(weights.tolist()):
        heap = [(w, s) for s, w in enumerate(row)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        top = 257
        while len(heap) > 1:
            one, two = heapq.heappop(heap), heapq.heappop(heap)
            parent[one[1]], parent[two[1]] = (top, 0), (top, 1)
            heapq.heappush(heap, (one[0] + two[0], top))
            top += 1
        paths: dict[int, list[int]] = {top - 1: []}
        for inner in range(top - 2, -1, -1):  # parents have higher numbers than children
            up, bit = parent[inner]
            paths[inner] = [*paths[up], (t * 256 + up - 257) * 8 + min(len(paths[up]), 2) * 2 + bit]
        for s in range(257):
            starts.append(len(steps))
            lengths.append(len(paths[s]))
            steps += paths[s]
    return Code(tree_of, np.array(starts, np.int64), np.array(lengths, np.int64), np.array(steps, np.uint32), 256 * len(weights))


_VALUES = np.random.default_rng(23).integers(1, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
_STEPS = np.cumprod(np.full(64, 0x9E3779B1, np.uint32), dtype=np.uint32)  # by place in a word; it starts over after 64 bytes


class Symbols:
    """Symbols of a block with the hashes of their contexts; the line feed behind each text is its end."""

    def __init__(self, block: Block):
        buf, n = block.buf, len(block.buf)
        self.symbol, self.context, folded = self.plain(block)
        # the last three and five bytes; near the start of a text as many as there are, and a mark
        wide = folded.astype(np.uint32)
        three = np.zeros(n, np.uint32)
        for d in range(1, 4):
            three[d:] |= wide[:-d] << np.uint32(8 * (d - 1))
        five = three * np.uint32(0x9E3779B1)
        five[5:] += (wide[:-5] | wide[1:-4] << np.uint32(8)) * np.uint32(0x85EBCA77) + np.uint32(0x165667B1)
        for d in range(5):
            at = block.starts[block.starts + d <= block.ends] + d
            if d < 3:
                three[at] = (three[at] & np.uint32((1 << 8 * d) - 1)) | np.uint32((d + 1) << 28)
            early = three[at] * np.uint32(0x9E3779B1)
            if d > 3:
                early += wide[at - 4] * np.uint32(0x85EBCA77)
            five[at] = early + np.uint32(d + 1)
        # the word so far, with the word before
        white = (buf == 32) | ((buf >= 9) & (buf <= 13))
        white[block.ends] = True
        opens = np.flatnonzero(np.append(True, white[:-1])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(opens, n))
        place = np.arange(n, dtype=np.int32)
        place -= np.repeat(opens.astype(np.int32), sizes)
        place &= 63
        sums = np.zeros(n + 1, np.uint32)
        np.cumsum(_take(_VALUES, folded) * _take(_STEPS, place), out=sums[1:])
        near = np.zeros(len(opens), np.uint32)  # of the word before with the white space behind it
        near[1:] = sums[opens[1:]] - sums[opens[:-1]]
        near[np.searchsorted(opens, block.starts)] = 1
        # within the word; longer ones differ by where they start over
        word = sums[:-1] + np.repeat(near * np.uint32(0x85EBCA77) - sums[opens], sizes)
        self.hashes = [_mix32(three ^ np.uint32(_SALT)), _mix32(five), _mix32(word)]

    @staticmethod
    def plain(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, the contexts of their trees and the folded bytes."""
        folded = block.buf + ((block.buf >= 65) & (block.buf <= 90)).view(np.uint8) * np.uint8(32)
        symbol = folded.astype(np.int32)
        symbol[block.ends] = END
        before = np.empty(len(symbol), np.int32)
        before[1:] = symbol[:-1]
        before[block.starts] = END
        context = before.copy()
        context[1:] += _take(_CLASS, before[:-1])
        context[block.starts] = END + _CLASS[END]
        return symbol, context, folded


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]`` for places known to be inside: without a check of each."""
    return values.take(at, mode="wrap")


def _keep_arrays() -> None:
    """The C library maps and unmaps every array above a threshold, page by page, until a larger
    one was freed (up to 32 MiB): so one is, untouched. It saves a third of the time of scoring."""
    np.empty(31 << 20, np.uint8)


def _mix32(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


HASHED = 3  # contexts with hashed tables; the symbol before has a table of its own
INPUTS = HASHED + 1


def marks(step: np.ndarray) -> np.ndarray:
    """Which of the 64 neighbouring slots of its context a decision takes (turned by the
    context's hash): decisions of one symbol lie in one line of the processor's cache."""
    return ((step >> np.uint32(3)) * np.uint32(0x9E3779B1) >> np.uint32(26)).astype(np.int64)


def decisions(code: Code, symbol: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each step of the paths: which symbol it belongs to, and the step."""
    return paths(code, entries(code, symbol, context))


def entries(code: Code, symbol: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Number of each symbol's path."""
    return _take(code.tree_of, context) * 257 + symbol


def paths(code: Code, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each step of the paths: which of them it belongs to, and the step."""
    length = _take(code.length, entry)
    ends = np.cumsum(length)
    of = np.repeat(np.arange(len(entry)), length)
    path = _take(_take(code.start, entry) - (ends - length), of)
    path += np.arange(len(of))
    return of, _take(code.step, path)


def side_by_side(code: Code, entry: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The steps of all paths and, for each, the values (64 bits) of its path. Paths of one length
    lie side by side, which saves looking up which path a step belongs to; their order is not kept."""
    length = _take(code.length, entry).astype(np.uint8)
    order = np.argsort(length, kind="stable")
    sizes = np.bincount(length)
    values = (_take(code.start, entry), *values)
    spread = [np.empty(int(sizes @ np.arange(len(sizes))), np.int64) for _ in values]
    for value, out in zip(values, spread):
        value, first, lo = _take(value, order), 0, 0
        for size in np.flatnonzero(sizes).tolist():
            n = int(sizes[size])
            out[lo : lo + size * n].reshape(size, n)[:] = value[first : first + n]
            first, lo = first + n, lo + size * n
    lo = 0
    for size in np.flatnonzero(sizes).tolist():
        n = int(sizes[size])
        spread[0][lo : lo + size * n].reshape(size, n)[:] += np.arange(size)[:, None]
        lo += size * n
    return _take(code.step, spread[0]), *spread[1:]


class Tally:
    """Outcomes of decisions by slot of each hashed context. Symbols that share context and path
    are counted before their decisions are looked at."""

    def __init__(self, code: Code, bits: int):
        self.code, self.bits = code, bits
        self.tables = [np.zeros(2 << bits, np.uint32) for _ in range(HASHED)]
        self.held = np.empty((HASHED, HELD), np.uint64)  # line of the context, and path
        self.size = self.seen = 0

    def add(self, symbols: Symbols) -> None:
        n = len(symbols.symbol)
        for lo in range(0, n, PIECE):
            part = slice(lo, min(lo + PIECE, n))
            entry = entries(self.code, symbols.symbol[part], symbols.context[part]).view(np.uint64)
            if self.size + len(entry) > HELD:
                self.settle()
            for held, h in zip(self.held, symbols.hashes):
                key = held[self.size : self.size + len(entry)]
                key[:] = h[part] >> np.uint32(32 - self.bits)
                key <<= np.uint64(32)
                key |= entry
            self.size += len(entry)
        self.seen += n

    def settle(self) -> None:
        for table, held in zip(self.tables, self.held):
            keys = np.sort(held[: self.size])
            last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if self.size else np.zeros(0, np.int64)
            times, keys = np.diff(last, prepend=-1), keys[last]
            for lo in range(0, len(keys), PIECE):
                some = keys[lo : lo + PIECE]
                line = (some >> np.uint64(32)).view(np.int64)
                step, slot, n = side_by_side(self.code, (some & np.uint64(0xFFFFFFFF)).view(np.int64), line, times[lo : lo + PIECE])
                slot ^= marks(step)
                slot <<= 1
                slot |= (step & np.uint32(1)).astype(np.int64)
                np.add.at(table, slot, n.astype(np.uint32))
        self.size = 0


def empty_tables(bits: int) -> list[np.ndarray]:
    return [np.zeros(2 << bits, np.int64) for _ in range(HASHED)]


def by_decision(code: Code, pairs: np.ndarray) -> np.ndarray:
    """Outcomes of the decisions themselves: how often each step of each path was taken."""
    tree = np.repeat(code.tree_of, 257)
    entry = tree * 257 + np.tile(np.arange(257), len(code.tree_of))
    counts = np.bincount(entry, pairs.reshape(-1).astype(np.float64), len(code.start))
    taken = np.repeat(counts, code.length)
    return np.bincount((code.step >> 3) * 2 + (code.step & 1), taken, 2 * code.n_nodes)


# --- mixing ---------------------------------------------------------------------------


@dataclass
class Model:
    """Code, log-odds per decision and per slot of each context, gate weights and map."""

    code: Code
    odds: list[np.ndarray]
    bits: int
    weights: np.ndarray
    refine: np.ndarray

    def fine_map(self) -> np.ndarray:
        """Half of the map's log-odds at finely spaced places, gate by gate."""
        places, nodes = np.linspace(-8, 8, _FINE), np.linspace(-8, 8, _NODES)
        return np.concatenate([np.interp(places, nodes, row) / 2 for row in self.refine]).astype(np.float32)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Of the second outcome, from counts of both outcomes side by side."""
    zero, one = counts[0::2] + PRIOR, counts[1::2] + PRIOR
    return np.rint(np.clip(np.log(one / zero), -8, 8) * ODDS_SCALE).astype(np.int8)


def start_weights() -> tuple[np.ndarray, np.ndarray]:
    weights = np.full((_GATES, INPUTS), 0.35, np.float32)
    grid = np.linspace(-8, 8, _NODES, dtype=np.float32)
    return weights, np.tile(grid, (_GATES, 1))


class Lanes:
    """The texts of a block side by side: step ``c`` holds the ``c``-th chunk of every text that
    has one, so that all texts advance together and each sees only its own past."""

    def __init__(self, block: Block):
        lengths = block.ends - block.starts + 1
        self.order = np.argsort(-lengths, kind="stable")
        chunks = -(-lengths // CHUNK)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []  # texts' lanes are a prefix of the order
        sorted_starts, sorted_lengths, sorted_chunks = block.starts[self.order], lengths[self.order], chunks[self.order]
        for c in range(int(chunks.max()) if len(chunks) else 0):
            active = int(np.searchsorted(-sorted_chunks, -c, side="left"))
            s = sorted_starts[:active] + c * CHUNK
            n = np.minimum(CHUNK, sorted_lengths[:active] - c * CHUNK)
            self.steps.append((s, n))

    @staticmethod
    def places(s: np.ndarray, n: np.ndarray) -> np.ndarray:
        ends = np.cumsum(n)
        return np.arange(int(ends[-1])) + np.repeat(s - (ends - n), n)


def _inputs(model: Model, symbols: Symbols, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stored log-odds of every predictor per decision, its gate, outcome (1 or -1) and symbol."""
    of, step = decisions(model.code, _take(symbols.symbol, places), _take(symbols.context, places))
    x = np.empty((INPUTS, len(of)), np.float32)
    x[0] = _take(model.odds[0], step >> np.uint32(3))
    mark = marks(step)
    gate = (step >> np.uint32(1)).astype(np.int8) & np.int8(3)
    for k, h in enumerate(symbols.hashes):
        slot = _take((_take(h, places) >> np.uint32(32 - model.bits)).astype(np.int64), of)
        slot ^= mark
        odds = _take(model.odds[k + 1], slot)
        x[k + 1] = odds
        gate += (odds != 0).view(np.int8) * np.int8(3)
    outcome = (step & np.uint32(1)).astype(np.float32)
    outcome *= 2
    outcome -= 1
    return x, gate, outcome, of


def _mixed(weights: np.ndarray, x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sum of the inputs under the weights of each decision's row."""
    z = _take(weights[0], row)
    z *= x[0]
    for k in range(1, INPUTS):
        w = _take(weights[k], row)
        w *= x[k]
        z += w
    return z


def score_block(model: Model, block: Block, fine: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each text of a block."""
    symbols, lanes = Symbols(block), Lanes(block)
    fine = model.fine_map() if fine is None else fine
    total = np.zeros(len(block))
    own = np.zeros((INPUTS, len(block)), np.float32)  # the texts' own weights, by lane
    scale = np.float32(1 / ODDS_SCALE)
    for s, n in lanes.steps:
        active = len(s)
        x, gate, outcome, of = _inputs(model, symbols, lanes.places(s, n))
        lane = _take(np.repeat(np.arange(active) * _GATES, n), of)
        first = np.searchsorted(lane, np.arange(active) * _GATES)  # first decision of each lane
        weights = ((own[:, :active, None] + model.weights.T[:, None, :]) * scale).reshape(INPUTS, -1)
        gate = gate.astype(np.int64)
        lane += gate
        z = _mixed(weights, x, lane)
        place = np.clip(z, -8, 8)
        place += 8
        place *= np.float32((_FINE - 1) / 16)
        place += np.float32(0.5)
        z *= np.float32(0.5)
        at = place.astype(np.int64)
        gate *= _FINE
        at += gate
        z += _take(fine, at)
        z *= outcome
        np.negative(z, out=z)
        against = np.exp(z, out=z)  # odds against what happened
        total[:active] -= np.add.reduceat(np.log1p(against), first, dtype=np.float64)
        outcome *= against
        against += 1
        outcome /= against  # the error
        seen = np.diff(np.append(first, len(of))) + 100
        for k in range(INPUTS):
            x[k] *= outcome
            own[k, :active] += RATE * scale * np.add.reduceat(x[k], first) / seen
    out = np.empty(len(block))
    out[lanes.order] = total / math.log(10)
    return out


# --- learning -------------------------------------------------------------------------


def levels_of(odds: np.ndarray) -> np.ndarray:
    """Level of each stored log-odds."""
    values = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.float64) / ODDS_SCALE
    level = np.sign(values) * (1 + np.searchsorted(LEVEL_EDGES, np.abs(values))) + LEVELS // 2
    return level.astype(np.uint8)[odds.view(np.uint8)]


def empty_meetings() -> np.ndarray:
    """How often (how deep in the tree, outcome, level of each predictor) met, in whole cells."""
    size = 2 * CELL
    return np.zeros(-(-6 * LEVELS**INPUTS // size) * size, np.int64)


def count_meetings(code: Code, levels: list[np.ndarray], bits: int, block: Block, into: np.ndarray) -> None:
    """Add what the decisions of a block meet in tables of levels."""
    symbols, held, size = Symbols(block), [], 0
    for lo in range(0, len(symbols.symbol), PIECE):
        part = slice(lo, lo + PIECE)
        lines = [(h[part] >> np.uint32(32 - bits)).astype(np.int64) for h in symbols.hashes]
        step, *slots = side_by_side(code, entries(code, symbols.symbol[part], symbols.context[part]), *lines)
        mark = marks(step)
        met = step & np.uint32(7)
        met *= np.uint32(LEVELS)
        met += _take(levels[0], step >> np.uint32(3))
        for slot, level in zip(slots, levels[1:]):
            slot ^= mark
            met *= np.uint32(LEVELS)
            met += _take(level, slot)
        held.append(met)
        size += len(met)
        if size > len(into) or lo + PIECE >= len(symbols.symbol):
            into += np.bincount(np.concatenate(held), minlength=len(into))
            held, size = [], 0


def fit(model: Model, met: np.ndarray, values: np.ndarray) -> None:
    """Weights of each gate, then its map, under which the outcomes met are most likely;
    ``values`` has the log-odds that stand for each predictor's levels."""
    some = np.flatnonzero(met)
    times, rest = met[some].astype(np.float64), some
    x = np.empty((INPUTS, len(some)))
    seen = np.zeros(len(some), np.int64)
    for k in range(INPUTS - 1, -1, -1):
        rest, level = np.divmod(rest, LEVELS)
        x[k] = values[k, level]
        if k:
            seen += level != LEVELS // 2
    gate, outcome = 3 * seen + (rest >> 1), (rest & 1) * 2.0 - 1
    for g in np.unique(gate):
        own = gate == g
        inputs, n, y = x[:, own], times[own], outcome[own]
        model.weights[g] = _newton(model.weights[g], inputs, 0.0, n, y)
        z = model.weights[g] @ inputs
        place = (np.clip(z, -7.999, 7.999) + 8) * ((_NODES - 1) / 16)
        hats = np.maximum(1 - np.abs(place - np.arange(_NODES)[:, None]), 0) / 2
        model.refine[g] = _newton(model.refine[g], hats, z / 2, n, y)


def _newton(start: np.ndarray, inputs: np.ndarray, offset: np.ndarray | float, n: np.ndarray, outcome: np.ndarray) -> np.ndarray:
    """Weights of the inputs that make ``n`` outcomes of each kind most likely, held at their start
    as by ``PULL`` decisions; a step that raises the loss is halved."""

    def loss(w: np.ndarray) -> float:
        return float(n @ np.logaddexp(0, -outcome * (offset + w @ inputs)) + PULL / 2 * ((w - start) ** 2).sum())

    start = start.astype(np.float64)
    w, now = start, loss(start)
    for _ in range(STEPS):
        margin = outcome * (offset + w @ inputs)
        error = 1 / (1 + np.exp(np.minimum(margin, 700)))
        slope = inputs @ (n * outcome * error) - PULL * (w - start)
        bend = (inputs * (n * error * (1 - error))) @ inputs.T + PULL * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-6:
            step /= 2
        if then >= now:
            break
        w, now = w + step, then
    return w


def level_values(levels: np.ndarray, odds: np.ndarray, times: np.ndarray) -> np.ndarray:
    """What stands for each level of a predictor: the mean of its log-odds, as often as they were met."""
    n = np.bincount(levels, times, LEVELS)
    return np.bincount(levels, times * (odds / ODDS_SCALE), LEVELS) / np.maximum(n, 1)


def learn(model: Model, some: list[Block]) -> None:
    """Weights and map from blocks that are not in the model's tables, or as if they were not."""
    met, levels = empty_meetings(), [levels_of(o) for o in model.odds]
    for block in some:
        count_meetings(model.code, levels, model.bits, block, met)
    fit(model, met, np.stack([level_values(a, o, np.ones(len(o))) for a, o in zip(levels, model.odds)]))


# --- corpus ---------------------------------------------------------------------------


def _words(texts: pa.Array) -> pa.Array:
    """Words of each text, A-Z lower-cased; with empty ones where white space stands together."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def _parts(texts: pa.Array, order: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in the given order, in parts of about ``PART_BYTES`` of text."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)[order]
    before = np.cumsum(sizes) - sizes
    yield from np.split(order, np.flatnonzero(np.diff(before // PART_BYTES)) + 1)


def _corpus_counts(docs: DataFrame) -> str:
    """Write words and symbol pairs of all texts with their numbers, in parts: the words of every
    ``PART_BYTES`` of text, and each task's pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_arrays()
        pairs = np.zeros(CLASSES * 257 * 257, np.int64)
        for batch in batches:
            for part in _parts(batch.column(0), np.arange(batch.num_rows)):
                texts = batch.column(0).take(pa.array(part))
                for block in blocks(texts):
                    symbols = Symbols.plain(block)
                    pairs += np.bincount(symbols[1] * 257 + symbols[0], minlength=len(pairs))
                words = pc.value_counts(_words(texts).flatten())
                words = words.filter(pc.not_equal(words.field("values"), ""))
                yield pa.RecordBatch.from_arrays([words.field("values"), pa.nulls(len(words), pa.int32()), words.field("counts")], ["word", "pair", "c"])
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(at, pa.int32()), pa.array(pairs[at])], ["word", "pair", "c"])

    path = scratch_path(docs.sparkSession, "counts")
    docs.select("text").mapInArrow(work, "word string, pair int, c long").write.parquet(path)
    return path


def _count_decisions(spark: SparkSession, docs: DataFrame, code: Code, bits: int) -> str:
    """Write the outcomes of all decisions, summed over all training texts, those of each side
    apart: one row per table, cell and side. A task sends the part of the tables it touched."""
    shared = spark.sparkContext.broadcast(code)

    def sent(side: bool, tally: Tally) -> Iterator[pa.RecordBatch]:
        tally.settle()
        for k, table in enumerate(tally.tables):
            yield from _cells(k, side, table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_arrays()
        tallies: dict[bool, Tally] = {}
        for batch in batches:
            for side in (False, True):
                for block in blocks(batch.column(0).filter(pc.equal(batch.column(1), side)), COUNT_BYTES):
                    if side not in tallies:
                        tallies[side] = Tally(shared.value, bits)
                    tallies[side].add(Symbols(block))
                    if tallies[side].seen > FULL:
                        yield from sent(side, tallies.pop(side))
        for side, tally in tallies.items():
            yield from sent(side, tally)

    return _summed(spark, docs.select("text", "side").mapInArrow(work, _CELL_SCHEMA), "decisions")


def _count_meetings(spark: SparkSession, docs: DataFrame, code: Code, levels: dict[bool, list[np.ndarray]], bits: int) -> str:
    """Write what the decisions of all training texts meet in the levels dealt to their side."""
    shared = spark.sparkContext.broadcast((code, levels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_arrays()
        code, levels = shared.value
        met = empty_meetings()
        for batch in batches:
            for side in (False, True):
                for block in blocks(batch.column(0).filter(pc.equal(batch.column(1), side)), COUNT_BYTES):
                    count_meetings(code, levels[side], bits, block, met)
        yield from _cells(0, False, met)

    return _summed(spark, docs.select("text", "side").mapInArrow(work, _CELL_SCHEMA), "meetings")


_CELL_SCHEMA = "k int, side boolean, cell int, counts binary"


def _summed(spark: SparkSession, parts: DataFrame, name: str) -> str:
    """Write the sums of all tasks' cells; tasks that gather hold the cells dealt to them, one row
    at a time added."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, bool, int], np.ndarray] = {}
        for batch in batches:
            for k, side, cell, counts in zip(*(c.to_pylist() for c in batch.columns)):
                _unpack(counts, sums.setdefault((k, side, cell), np.zeros(2 * CELL, np.int64)))
        for (k, side, cell), sum_ in sums.items():
            yield from _cells(k, side, sum_, cell)

    path = scratch_path(spark, name)
    parts.repartition("k", "cell", "side").mapInArrow(gather, _CELL_SCHEMA).write.parquet(path)
    return path


def _pack(counts: np.ndarray) -> bytes:
    """Counts of a cell: a bit per place that is not zero, a byte for each of these, and in full
    those that do not fit in a byte."""
    some = counts[counts > 0].astype(np.int64)
    return np.packbits(counts > 0).tobytes() + np.minimum(some, 255).astype(np.uint8).tobytes() + some[some >= 255].tobytes()


def _unpack(packed: bytes, into: np.ndarray) -> None:
    """Add the counts of a cell to ``into``."""
    raw = np.frombuffer(packed, np.uint8)
    at = np.flatnonzero(np.unpackbits(raw[: len(into) // 8]))
    some = raw[len(into) // 8 : len(into) // 8 + len(at)].astype(np.int64)
    some[some == 255] = np.frombuffer(packed, np.int64, offset=len(into) // 8 + len(at))
    into[at] += some


def _cells(k: int, side: bool, table: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """The counts of a table, in rows of one cell each; cells without any are left out."""
    cells = table.reshape(-1, 2 * CELL)
    some = np.flatnonzero(cells.any(axis=1))
    if len(some):
        yield pa.RecordBatch.from_arrays(
            [pa.array([k] * len(some), pa.int32()), pa.array([side] * len(some)), pa.array(first + some, pa.int32()),
             pa.array([_pack(cells[c]) for c in some], pa.binary())],
            ["k", "side", "cell", "counts"],
        )


def train(docs: DataFrame, pairs: np.ndarray, bits: int = TABLE_BITS) -> Model:
    """A model of the column ``text``, whose symbol pairs are counted: outcomes, weights and map
    of every text."""
    spark, code = docs.sparkSession, build_code(pairs)
    # Copies of a text are on one side.
    dealt = docs.select("text", (F.pmod(F.xxhash64("text"), F.lit(2)) == 1).alias("side"))
    path = _count_decisions(spark, dealt, code, bits)
    tables = {False: empty_tables(bits), True: empty_tables(bits)}
    for k in range(HASHED):  # one table of a fixed size at a time
        rows = spark.read.parquet(path).where(F.col("k") == k).select("side", "cell", "counts").toArrow()
        for side, cell, counts in zip(*(c.to_pylist() for c in rows.columns)):
            _unpack(counts, tables[side][k][cell * 2 * CELL : (cell + 1) * 2 * CELL])
    taken = by_decision(code, pairs)
    plain = log_odds(taken)
    plain_levels = levels_of(plain)
    weights, refine = start_weights()
    model, values = Model(code, [plain], bits, weights, refine), [level_values(plain_levels, plain, taken[0::2] + taken[1::2])]
    levels = {False: [plain_levels], True: [plain_levels]}
    for k in range(HASHED):
        halves = {side: log_odds(tables[side][k]) for side in levels}
        for side in levels:  # a side meets the tables of the other
            levels[side].append(levels_of(halves[not side]))
        other = np.concatenate([tables[not side][k][0::2] + tables[not side][k][1::2] for side in levels])
        values.append(level_values(np.concatenate([levels[side][-1] for side in levels]), np.concatenate([halves[not side] for side in levels]), other))
        model.odds.append(log_odds(tables[False][k] + tables[True][k]))
    rows = spark.read.parquet(_count_meetings(spark, dealt, code, levels, bits)).select("cell", "counts").toArrow()  # of a fixed size
    met = empty_meetings()
    for cell, counts in zip(*(c.to_pylist() for c in rows.columns)):
        _unpack(counts, met[cell * 2 * CELL : (cell + 1) * 2 * CELL])
    fit(model, met, np.stack(values))
    return model


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, left_out: int = 2) -> DataFrame:
    """Per row: held out or not, tokens and known tokens, the base score (words under add-one
    counts) and the model's score, both as log10 probabilities, with bytes and bits per byte."""
    spark = df.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == left_out, F.lit(False))
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    learned = docs.where(~F.col("held_out"))
    parts = spark.read.parquet(_corpus_counts(learned))
    counted = scratch_path(spark, "words")
    parts.where("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("c")).write.parquet(counted)
    counts = spark.read.parquet(counted)
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    found = parts.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # at most CLASSES * 257 * 257 rows
    pairs = np.zeros(CLASSES * 257 * 257, np.int64)
    pairs[found.column("pair").to_numpy()] = found.column("c").to_numpy()
    pairs = pairs.reshape(-1, 257)
    n_docs = int(pairs[:, END].sum())
    total, kinds = n_words + n_docs, n_distinct + (n_docs > 0)
    # at most HOT_WORDS words of at most HOT_WORD_BYTES bytes
    hot = (F.col("c") >= _least_hot(counts)) & (F.octet_length("word") <= HOT_WORD_BYTES)
    frequent = counts.where(hot).toArrow()
    known = Known.of(frequent.column("word").combine_chunks(), np.log10(frequent.column("c").to_numpy() + 1))
    model = train(learned.select("text"), pairs)
    shared = spark.sparkContext.broadcast((model, known, math.log10(n_docs + 1), math.log10(total + kinds + 1)))
    picked = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    schema = (
        f"uid long, doc_id {kind}, held_out boolean, n_tokens long, near_known long, near_sum double, score double, n_bytes long, "
        "rare array<struct<word: string, n: long>>"
    )
    path = scratch_path(spark, "scored")
    picked.mapInArrow(lambda batches: _score_batches(batches, shared, n_docs > 0), schema).write.parquet(path)
    scored = spark.read.parquet(path)
    uses = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.n")
    # none of them in a large share of the rows; each once in the hashed side, so that nothing is sorted
    rare = uses.join(counts.where(~hot).hint("shuffle_hash"), "word")
    far = rare.groupBy("uid").agg(F.sum("n").alias("far_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("far_sum"))
    zero = F.lit(0)
    return scored.join(far, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("near_known") + F.coalesce("far_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("near_sum") + F.coalesce("far_sum", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
        (F.col("score") * (-math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


@dataclass
class Known:
    """Words with their values, in the order of their hashes, so that a task builds no table of them."""

    words: pa.Array
    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, values: np.ndarray) -> "Known":
        hashes = _word_hashes(words)
        order = np.argsort(hashes, kind="stable")
        return cls(words.take(pa.array(order)), hashes[order], values[order])

    def get(self, names: pa.Array) -> np.ndarray:
        """The value of each name, NaN where it is not among the words; equal hashes are not enough."""
        found, hashes = np.full(len(names), np.nan), _word_hashes(names)
        at = np.searchsorted(self.hashes, hashes)
        left = np.arange(len(names))
        while len(left := left[at[left] < len(self.words)]):
            left = left[self.hashes[at[left]] == hashes[left]]
            same = pc.equal(names.take(pa.array(left)), self.words.take(pa.array(at[left]))).to_numpy(zero_copy_only=False)
            found[left[same]] = self.values[at[left[same]]]
            left = left[~same]
            at[left] += 1
        return found


def _word_hashes(words: pa.Array) -> np.ndarray:
    flat = words.cast(pa.large_string())
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1] - at[0], at[1:] - at[0]
    return Block(0, raw[at[0] : at[-1]], starts, ends).hashes(starts, ends)


def _least_hot(counts: DataFrame) -> int:
    """The least count that at most ``HOT_WORDS`` words reach."""
    sizes = counts.groupBy("c").agg(F.count("*").alias("n")).toArrow()  # all counts add up to those of the words, so few differ
    c, n = sizes.column("c").to_numpy(), sizes.column("n").to_numpy()
    order = np.argsort(-c)
    few = c[order][np.cumsum(n[order]) <= HOT_WORDS]
    return int(few[-1]) if len(few) else int(c.max(initial=0)) + 1


def _base(texts: pa.Array, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words of each text; number and sum of logarithms of the known ones (given with theirs); the others with their numbers."""
    lists, n = _words(texts), len(texts)
    owner, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy()
    names = flat.dictionary
    logs = known.get(names)
    some = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[codes]
    owner, codes = owner[some], codes[some]
    own = logs[codes]
    near = ~np.isnan(own)
    n_known = np.bincount(owner[near], minlength=n)
    sums = np.bincount(owner[near], own[near], minlength=n)
    pair, times = np.unique(owner[~near].astype(np.int64) * max(1, len(names)) + codes[~near], return_counts=True)
    cut = np.searchsorted(pair, np.arange(n + 1) * max(1, len(names)))
    rare = pa.StructArray.from_arrays([names.take(pa.array(pair % max(1, len(names)))), pa.array(times, pa.int64())], ["word", "n"])
    return np.bincount(owner, minlength=n), n_known, sums, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rare)


def _score_batches(batches: Iterator[pa.RecordBatch], shared, any_end: bool) -> Iterator[pa.RecordBatch]:
    """Texts of like lengths are scored side by side, so that few steps have few lanes."""
    _keep_arrays()
    model, known, end_log, log_all = shared.value
    fine = model.fine_map()
    for batch in batches:
        order = np.argsort(pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False), kind="stable")
        for rows in _parts(batch.column(3), order):
            if not len(rows):
                continue
            part = batch.take(pa.array(rows))
            texts = part.column(3)
            scores = np.concatenate([score_block(model, block, fine) for block in blocks(texts, LANE_BYTES)])
            n_words, n_known, sums, rare = _base(texts, known)
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(n_words + 1, pa.int64()), pa.array(n_known + int(any_end), pa.int64()),
                 pa.array(sums + end_log - (n_words + 1) * log_all), pa.array(scores), sizes, rare],
                ["uid", "doc_id", "held_out", "n_tokens", "near_known", "near_sum", "score", "n_bytes", "rare"],
            )
