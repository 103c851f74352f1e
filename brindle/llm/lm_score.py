r"""Language-model scores by online logistic context mixing.

A byte is eight binary decisions on the way from the root to a leaf of a tree of 256 leaves. Five predictors give each decision's
probability from counts under a hashed context: the last two, three and four bytes, the word so far, and the last six
bytes, of which only the byte that followed most often is kept, with its count. Their logits are mixed with weights that a gate
picks (the decision's depth, and how many contexts have been seen), and the result is refined by an adaptive map of
(decision, probability). What is learned, from all training text:

1. Every 7-gram of bytes and its count: tasks sort and count theirs and exchange them by their last four bytes, so the counts
   of all contexts are exact sums. The table of 7-grams grows with the input and is held by no worker.
2. The workers' tables, with check bits: of each order the most frequent grams, ``GRAMS`` at most. That bound is one of
   memory; what is left out is a context never seen, and shorter ones speak for it.
3. Mixing weights and the map: online, in small steps over all 7-grams, by how often they occur, each without its own count;
   the tasks' results are averaged.

While a text is scored the model adapts to it: where the last seven bytes have stood in the text before, the byte that came then is
weighed by how often such guesses have been right in this text so far, shrunk to the mixed probability (``refined``). A text's
score is the log10 probability of its bytes and of its end, so that probabilities of all texts sum to 1; it depends on nothing
but the model and the text.

The base score is an add-half unigram model over all words of the training documents. The most frequent words (at most
``HEAD``) are looked up in the workers, the others by a join on the word.

Defined results: a null or empty text has one token (the end), and its score is that of ending at once; without training
documents every count is zero, N and V are zero, and the base score is that of V + 1 = 1 class (each log10 of 1); repeated rows
are counted each time and score alike; rows that share an id are scored one by one; null ids are hashed as the text 'null';
extra columns are not looked at; an empty table gives an empty result; bits_per_byte of an empty text is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, durable, remainder, session
from .flat import LOWER, ODD, buffer, mixed, names, slices, words

FOLDS, HELD_OUT = 5, 1
#: Predictors: orders of whole contexts, then the word so far, then the last six bytes.
ORDERS, WORD, LONG = (2, 3, 4), 3, 4
INPUTS = len(ORDERS) + 2
#: Grams a predictor keeps in the workers, at most, and places of its table for each gram: whole paths need up to eight. The last
#: one needs one place, and keeps twice as many.
GRAMS, PLACES, MAX_BITS = 1 << 19, 4, 21
#: Distinct 7-grams that a task holds, about, and the most parts that they are dealt to.
PART_KEYS, MAX_PARTS = 1 << 21, 1 << 16
HEAD, MAX_WORD, HELD_WORDS = 1 << 19, 48, 400_000
STEP, RATE, APM_BINS, APM_RATE, APM_SHARE = 2048, 0.008, 33, 0.02, 0.1
#: Counts that stand for the right guesses of a text before it has any.
TRUST = 24.0
PRIOR = 0.1
#: Costs are rounded to this part of a bit, so that a key's name and its cost share 64 bits of the table that keeps them.
MEMO_BITS, COST_STEP, NO_COST = 23, 1 / 2048, 65535
#: Bytes of texts that are counted, and scored, at once.
SLICE, SCORE_SLICE = 1 << 21, 1 << 19
#: Counts in eight bits: whole up to 32, then in steps of 8 %.
VALUE = np.concatenate([np.arange(33.0), 32 * 1.08 ** np.arange(1, 224)])
#: The logit of (level of zeros) * 256 + (level of ones); and these two levels without one zero, and without one one: a count
#: past 32 is not whole, and one less is the same level.
LOGIT = np.log((VALUE[None, :] + PRIOR) / (VALUE[:, None] + PRIOR)).astype(np.float32).ravel()
LESS = np.where((np.arange(256) > 0) & (np.arange(256) <= 32), np.arange(256) - 1, np.arange(256))
WITHOUT = np.stack([LESS[:, None] * 256 + np.arange(256), np.arange(256)[:, None] * 256 + LESS[None, :]]).reshape(2, -1).astype(np.int64)
U8, M32, M56 = np.uint64(8), np.uint64(0xFFFFFFFF), np.uint64((1 << 56) - 1)
#: Counts are kept up to this.
MOST = (1 << 32) - 1


def level(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(VALUE, counts, "right") - 1).astype(np.uint8)


def keys_of(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte of the texts: the byte and the six before it in its text (zeros at the start), as 56 bits."""
    k = buf.astype(np.uint64)
    for shift in (1, 2):
        more = k.copy()
        more[shift:] |= k[:-shift] << np.uint64(8 * shift)
        k = more
    more = k.copy()
    more[4:] |= k[:-4] << np.uint64(32)
    k = more & M56
    for p in range(6):
        here = at[:-1] + p
        here = here[here < at[1:]]
        k[here] &= np.uint64((1 << 8 * (p + 1)) - 1)
    return k


def word_keys(keys: np.ndarray) -> np.ndarray:
    """The key from the last space or line end before the byte on; all of it without one."""
    out, found = keys.copy(), np.zeros(len(keys), bool)
    for back in range(1, 7):
        b = (keys >> np.uint64(8 * back)) & np.uint64(255)
        new = ~found & ((b == 32) | (b == 10))
        out[new] &= np.uint64((1 << 8 * (back + 1)) - 1)
        found |= new
    return out


def grams_of(keys: np.ndarray, which: int) -> np.ndarray:
    """The part of the keys that predictor ``which`` sees: its context and the byte."""
    if which == LONG:
        return keys
    return word_keys(keys) if which == WORD else keys & np.uint64((1 << 8 * (ORDERS[which] + 1)) - 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and their counts, by planes of bytes, which the exchange's compression shrinks."""
    step = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes() + np.ascontiguousarray(np.minimum(counts, MOST).astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    step = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64)[:, 0]
    counts = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n, 8 * n).reshape(4, n).T).view(np.uint32)[:, 0]
    return np.cumsum(step, dtype=np.uint64), counts.astype(np.int64)


def _count_keys(parts: int):
    """A task's 7-grams by part (part, blob); in part -1 how often each byte stood, and how often a text ended after it (256: at
    its start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ends = np.zeros((2, 257), np.int64)

        def flush():
            keys, counts = summed(*[np.concatenate(x) for x in zip(*held)]) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            part = (mixed(keys & M32) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            out = [(int(part[i[0]]), pack(keys[i], counts[i])) for i in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(i)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["part", "blob"])

        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column, SLICE):
                buf, at = buffer(column.slice(a, b - a))
                some = np.diff(at) > 0
                ends[0, :256] += np.bincount(buf, minlength=256)
                ends[0, 256] += len(some)
                ends[1, :256] += np.bincount(buf[at[1:][some] - 1], minlength=256)
                ends[1, 256] += int((~some).sum())
                keys = np.sort(keys_of(buf, at))
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                held.append((keys[first], np.diff(np.append(first, len(keys)))))
                if sum(len(k) for k, _ in held) > 2 * PART_KEYS:
                    held[:] = [summed(*[np.concatenate(x) for x in zip(*held)])]
                    if len(held[0][0]) > PART_KEYS:
                        yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([ends.tobytes()], pa.binary())], names=["part", "blob"])

    return run


def _sum_keys(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All counts of a part, blob after blob; of part -1 the sum."""
    part = key[0].as_py()
    if part < 0:
        blob = sum(np.frombuffer(b.as_py(), np.int64) for batch in batches for b in batch.column("blob")).tobytes()
    else:
        held, extra = [], 0
        for batch in batches:
            for b in batch.column("blob"):
                held.append(unpack(b.as_py()))
                extra += len(held[-1][0]) if len(held) > 1 else 0
                if extra > PART_KEYS:
                    held, extra = [summed(*[np.concatenate(x) for x in zip(*held)])], 0
        blob = pack(*summed(*[np.concatenate(x) for x in zip(*held)]))
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])


def grams(keys: np.ndarray, counts: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a predictor with their counts, of distinct keys."""
    return (keys, counts) if which == LONG else summed(grams_of(keys, which), counts)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each predictor, how many grams of the parts have a count of each level: (which, level, n)."""
    out = np.zeros((INPUTS, 256), np.int64)
    for batch in batches:
        for b in batch.column("blob"):
            keys, counts = unpack(b.as_py())
            for which in range(INPUTS):
                out[which] += np.bincount(level(grams(keys, counts, which)[1]), minlength=256)
    which, lv = np.nonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(lv.astype(np.int32)), pa.array(out[which, lv])], names=["which", "level", "n"])


def _frequent(least: list[int]):
    """The grams of at least the given levels: (which, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("blob"):
                keys, counts = unpack(b.as_py())
                for which in range(INPUTS):
                    k, c = grams(keys, counts, which)
                    good = level(c) >= least[which]
                    if good.any():
                        yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([pack(k[good], c[good])], pa.binary())], names=["which", "blob"])

    return run


def hashed(context: np.ndarray, which: int) -> np.ndarray:
    return mixed((context + np.uint64(1)) * np.uint64(ODD[0]) + np.uint64(ODD[1] * (which + 1) % (1 << 64)))


def noded(node: np.ndarray) -> np.ndarray:
    return node.astype(np.uint64) * np.uint64(ODD[3])


def placed(context: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hashed contexts and nodes: the place in a table of 2 ** bits, and the check in the upper half of 32 bits."""
    h = context ^ node
    h *= np.uint64(ODD[2])
    return (h >> np.uint64(64 - bits)).view(np.int64), (h >> np.uint64(10)).astype(np.uint32) & np.uint32(0xFFFF0000)


def table(keys: np.ndarray, counts: np.ndarray, which: int) -> np.ndarray:
    """Numbers of 32 bits: check, and the levels of zeros and ones, of the decisions of the grams. Where two meet, the more frequent
    stays."""
    bits = int(min(MAX_BITS, max(12, math.ceil(math.log2(PLACES * len(keys) + 1)))))
    out, best = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.int64)
    byte = (keys & np.uint64(255)).astype(np.int64)
    # by context, so that a decision's grams are neighbours
    order = np.argsort(((keys >> U8) << U8) + (keys & np.uint64(255)), kind="stable")
    keys, counts, byte = keys[order], counts[order], byte[order]
    context = hashed(keys >> U8, which)
    for d in range(8):
        node, one = (256 + byte) >> (8 - d), (byte >> (7 - d)) & 1
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] >> U8 != keys[:-1] >> U8) | (node[1:] != node[:-1])])) if len(keys) else np.zeros(0, np.int64)
        n1, n = (np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64) for x in (counts * one, counts))
        place, check = placed(context[first], noded(node[first]), bits)
        by = np.argsort(n, kind="stable")
        by = by[n[by] > best[place[by]]]
        best[place[by]] = n[by]
        out[place[by]] = check[by] | level((n - n1)[by]).astype(np.uint32) << np.uint32(8) | level(n1[by])
    return out


def long_table(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits: check, the byte that followed most often, and the level of (its count) / (1 + four times all others')."""
    bits = int(min(MAX_BITS, max(12, math.ceil(math.log2(2 * len(keys) + 1)))))
    out = np.zeros(1 << bits, np.uint32)
    if not len(keys):
        return out
    order = np.lexsort((counts, keys >> U8))
    keys, counts = keys[order], counts[order]
    context = keys >> U8
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    top = np.append(first[1:], len(keys)) - 1
    n, most = np.add.reduceat(counts, first), counts[top]
    by = np.argsort(most, kind="stable")
    place, check = placed(hashed(context[top], LONG), np.uint64(0), bits)
    trust = level(most // (1 + 4 * (n - most)))
    out[place[by]] = check[by] | ((keys[top][by] & np.uint64(255)).astype(np.uint32) << np.uint32(8)) | trust[by]
    return out


class Mixer:
    """Predictors' tables, gated weights, the adaptive map, and the costs of ending and of going on after each byte."""

    def __init__(self, tables: list[np.ndarray], ends: np.ndarray):
        self.tables = tables
        self.bits_of = [len(t).bit_length() - 1 for t in tables]
        #: By input, for each gate.
        self.weights = np.full((INPUTS, 8 * (INPUTS + 1)), 0.35, np.float32)
        self.apm = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, APM_BINS))), (256, 1)).astype(np.float32)
        stop = (ends[1] + 0.5) / (ends[0] + 1)
        self.stop, self.go = -np.log2(stop), -np.log2(1 - stop)

    def contexts(self, keys: np.ndarray) -> list[np.ndarray]:
        return [hashed(grams_of(keys, which) >> U8, which) for which in range(INPUTS)]

    def guess(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the long context: the byte, and the level of its trust, 0 if it is not known."""
        place, check = placed(context, np.uint64(0), self.bits_of[LONG])
        e = self.tables[LONG].take(place) ^ check
        return ((e >> np.uint32(8)) & np.uint32(255)).astype(np.int64), np.where(e < 65536, e & np.uint32(255), 0).astype(np.int64)

    def decision(self, contexts: list[np.ndarray], guess, byte: np.ndarray, d: int, without: bool):
        """Of one decision: each input's logit for a 1, the gate, the node and the bit. without: own count is left out."""
        node, bit = (256 + byte) >> (8 - d), (byte >> (7 - d)) & 1
        logits, seen = [], d * (INPUTS + 1)
        at = noded(node)
        for which in range(LONG):
            place, check = placed(contexts[which], at, self.bits_of[which])
            both = self.tables[which].take(place) ^ check
            both *= both < 65536  # the levels, where the check is right
            if without:
                both = WITHOUT[bit, both]
            logits.append(LOGIT.take(both))
            seen = seen + (both > 0)
        first, trust = guess
        if without:
            trust = np.where(first == byte, LESS[trust], trust)
        live = ((256 + first) >> (8 - d) == node) & (trust > 0)
        strength = LOGIT.take(trust) * live
        logits.append(np.where((first >> (7 - d)) & 1 == 1, strength, -strength))
        return logits, seen + live, node, bit

    def mix(self, logits: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        out = self.weights[0].take(gate) * logits[0]
        for w, x in zip(self.weights[1:], logits[1:]):
            out += w.take(gate) * x
        return np.clip(out, -12, 12)

    def cell(self, mix: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The place in the adaptive map: the node, and the nearest of its marks."""
        return node * APM_BINS + ((np.clip(mix, -8, 8) + 8) * ((APM_BINS - 1) / 16) + 0.5).astype(np.int64)

    def learn(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Online: steps over the keys in order, each key by its count."""
        apm = self.apm.ravel()
        for s in range(0, len(keys), STEP):
            part, n = keys[s : s + STEP], counts[s : s + STEP]
            weight = np.minimum(n / n.mean(), 20).astype(np.float32)
            byte, contexts = (part & np.uint64(255)).astype(np.int64), self.contexts(part)
            guess = self.guess(contexts[LONG])
            for d in range(8):
                logits, gate, node, bit = self.decision(contexts, guess, byte, d, True)
                mix = self.mix(logits, gate)
                error = weight * (bit - 1 / (1 + np.exp(-mix)))
                for i, x in enumerate(logits):
                    self.weights[i] += (RATE / 64) * np.bincount(gate, error * np.clip(x, -8, 8), self.weights.shape[1])
                cell = self.cell(mix, node)
                pull = np.bincount(cell, APM_RATE * weight, len(apm))
                ones = np.bincount(cell, APM_RATE * weight * bit, len(apm))
                apm += ((ones - pull * apm) / np.maximum(pull, 1)).astype(np.float32)
        np.clip(self.apm, 1e-4, 1 - 1e-4, out=self.apm)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Cost of each key's byte in bits."""
        likely = np.ones(len(keys))
        byte, contexts = (keys & np.uint64(255)).astype(np.int64), self.contexts(keys)
        guess, apm = self.guess(contexts[LONG]), self.apm.ravel()
        for d in range(8):
            logits, gate, node, bit = self.decision(contexts, guess, byte, d, False)
            mix = self.mix(logits, gate)
            p = (1 - APM_SHARE) / (1 + np.exp(-mix)) + APM_SHARE * apm.take(self.cell(mix, node))
            likely *= np.where(bit == 1, p, 1 - p)
        return np.minimum(np.round(-np.log2(likely) / COST_STEP), NO_COST - 1) * COST_STEP


class Scorer:
    """Bits of texts, with the costs of keys kept in a table of fixed size. A key's hash is one of 64 bits for each key: its first
    bits are the place, and the table keeps the others, so no two keys are confused."""

    def __init__(self, mixer: Mixer, memo_bits: int = MEMO_BITS):
        self.mixer, self.memo_bits, self.turn = mixer, memo_bits, 0
        self.memo = np.full(1 << memo_bits, NO_COST, np.uint64)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint64(ODD[0])
        place = (h >> np.uint64(64 - self.memo_bits)).view(np.int64)
        # 48 bits of name: with 16 of place all of the hash
        name = h << np.uint64(16) >> np.uint64(16)
        found = self.memo.take(place)
        cost = (found & np.uint64(NO_COST)).astype(np.int64)
        out = cost * COST_STEP
        miss = np.flatnonzero((found >> np.uint64(16) != name) | (cost == NO_COST))
        if len(miss):
            new, one, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            got = np.concatenate([self.mixer.bits(new[s : s + 20_000]) for s in range(0, len(new), 20_000)])
            out[miss] = got[back]
            # a key that is kept gives way one time in two: rare keys do not drive out frequent ones at once
            at, n = place[miss[one]], name[miss[one]]
            self.turn += 1
            free = (self.memo[at] & np.uint64(NO_COST)) == NO_COST
            put = free | ((n & np.uint64(1)) == self.turn % 2)
            self.memo[at[put]] = n[put] << np.uint64(16) | np.round(got[put] / COST_STEP).astype(np.uint64)
        return out

    def bits(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text, the cost of its bytes and its end."""
        keys = keys_of(buf, at)
        cost = self.costs(keys)
        cost = refined(buf, at, keys, cost, self.costs)
        before = np.empty(len(buf), np.int64)
        before[1:] = buf[:-1]
        filled = np.diff(at) > 0
        before[at[:-1][filled]] = 256
        total = np.concatenate([[0.0], np.cumsum(cost + self.mixer.go[before])])
        last = np.full(len(at) - 1, 256)
        last[filled] = buf[at[1:][filled] - 1]
        return total[at[1:]] - total[at[:-1]] + self.mixer.stop[last]


def seen_before(keys: np.ndarray, row: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(here, there): the places whose last seven bytes have stood in the same text before, and where that was last."""
    place = np.arange(len(keys))
    width = np.uint64(max(1, len(keys).bit_length()))
    name = mixed(keys[:-1] * np.uint64(ODD[0]) + (row[1:].astype(np.uint64) + np.uint64(1)) * np.uint64(ODD[1]))
    both = np.sort(((name >> width << width) | place[1:].astype(np.uint64))[(place - begin >= 7)[1:]])
    at, name = (both & np.uint64((1 << int(width)) - 1)).astype(np.int64), both >> width
    here = np.arange(1, len(both))
    here = here[name[1:] == name[:-1]]
    found_here, found_there = [], []
    back = 1
    while len(here):  # names are cut off, so strangers may stand between: as a rule one step
        same = (keys[at[here] - 1] == keys[at[here - back] - 1]) & (row[at[here]] == row[at[here - back]])
        found_here.append(at[here[same]])
        found_there.append(at[here[same] - back])
        here, back = here[~same], back + 1
        here = here[(here >= back) & (name[here] == name[here - back])] if len(here) else here
    if not found_here:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    here, there = np.concatenate(found_here), np.concatenate(found_there)
    order = np.argsort(here)
    return here[order], there[order]


def refined(buf: np.ndarray, at: np.ndarray, keys: np.ndarray, cost: np.ndarray, costs) -> np.ndarray:
    """The costs, with the guesses of the text's own past. A guess's probability is the share of guesses like it (by how many in a
    row have just been right) that were right in this text before, counted with TRUST more at the mixed probability; the other
    bytes share the rest as they did."""
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    here, there = seen_before(keys, row, np.repeat(at[:-1], size))
    if not len(here):
        return cost
    guess = buf[there]
    hit = guess == buf[here]
    p = np.empty(len(here))
    p[hit] = cost[here[hit]]
    p[~hit] = costs(keys[here[~hit]] & ~np.uint64(255) | guess[~hit].astype(np.uint64))
    p = np.clip(2.0**-p, 1e-6, 1 - 1e-6)
    right = np.zeros(len(buf), bool)
    right[here] = hit
    wrong = np.maximum.accumulate(np.where(right, -1, np.arange(len(buf))))
    run = here - 1 - wrong[here - 1]
    cell = np.digitize(run, (1, 3, 8, 16))
    share = np.empty(len(here))
    for c in range(5):
        mine = np.flatnonzero(cell == c)
        if not len(mine):
            continue
        rows = row[here[mine]]
        first = np.searchsorted(rows, rows)  # the text's first guess of this kind
        hits = np.concatenate([[0], np.cumsum(hit[mine])])[:-1]
        share[mine] = (hits - hits[first] + TRUST * p[mine]) / (np.arange(len(mine)) - first + TRUST)
    out = cost.copy()
    out[here[hit]] = -np.log2(share[hit])
    out[here[~hit]] += np.log2((1 - p[~hit]) / (1 - share[~hit]))
    return out


def _word_at(buf: np.ndarray, a: int, b: int) -> str:
    """A word; one too long to carry around is named by its digest, which no word can be (it has a space)."""
    w = buf[a:b].tobytes()
    return w.decode() if len(w) <= MAX_WORD else " " + hashlib.sha256(w).hexdigest()


DOCS, TOKENS = " docs", " tokens"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's words and their counts (word, n), and under two names that no word has the documents and the tokens. A
    task tells its words apart by their 64-bit names."""
    held: dict[int, int] = {}
    strings: dict[int, str] = {}
    docs = tokens = 0

    def flush():
        found, n = [strings[x] for x in held], list(held.values())
        held.clear()
        strings.clear()
        for s in range(0, len(found), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[s : s + 50_000], pa.string()), pa.array(n[s : s + 50_000], pa.int64())], names=["word", "n"])

    for batch in batches:
        column = batch.column("text")
        for a, b in slices(column, SLICE):
            buf, at = buffer(column.slice(a, b - a))
            buf = LOWER[buf]
            begin, end, _ = words(buf, at)
            found, one, n = np.unique(names(buf, begin, end), return_index=True, return_counts=True)
            for x, c, i in zip(found.tolist(), n.tolist(), one.tolist()):
                if x in held:
                    held[x] += c
                else:
                    held[x], strings[x] = c, _word_at(buf, begin[i], end[i])
            docs += b - a
            tokens += len(begin) + b - a
            if len(held) > HELD_WORDS:
                yield from flush()
    # no word has these names; nor has one a negative number
    held |= {-1: docs, -2: tokens}
    strings |= {-1: DOCS, -2: TOKENS}
    yield from flush()


_kept: dict = {}


def _loaded(shared):
    """The worker's scorer, built once from the broadcast's arrays."""
    key = getattr(shared, "_path", None) or id(shared)
    if key not in _kept:
        _kept.clear()
        _kept[key] = (Scorer(shared.value[0]), *shared.value[1:])
    return _kept[key]


def _score(shared, end_log: float | None, base: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, head, logs = _loaded(shared)
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column, SCORE_SLICE):
                part = batch.slice(a, b - a)
                buf, at = buffer(part.column("text"))
                bits = scorer.bits(buf, at)
                low = LOWER[buf]
                begin, end, first = words(low, at)
                found, one, number = np.unique(names(low, begin, end), return_index=True, return_inverse=True)
                near = np.minimum(np.searchsorted(head, found), max(len(head) - 1, 0))
                known = (head[near] == found) & (end[one] - begin[one] <= MAX_WORD) if len(head) else np.zeros(len(found), bool)
                value = np.where(known, logs[near], 0.0) if len(head) else np.zeros(len(found))
                count = np.diff(first)
                sums = np.concatenate([[0.0], np.cumsum(value[number])])
                good = np.concatenate([[0], np.cumsum(known[number])])
                # words past the head, once a text with their counts
                rows = np.repeat(np.arange(b - a), count)
                lost = ~known[number]
                pair, tf = np.unique(rows[lost] * max(len(found), 1) + number[lost], return_counts=True)
                strings = {int(i): _word_at(low, int(begin[one[i]]), int(end[one[i]])) for i in np.flatnonzero(~known)}
                tail = pa.StructArray.from_arrays([pa.array([strings[i] for i in (pair % max(len(found), 1)).tolist()], pa.string()), pa.array(tf.astype(np.int64))], names=["word", "tf"])
                offsets = np.searchsorted(pair // max(len(found), 1), np.arange(b - a + 1)).astype(np.int32)
                ends = end_log if end_log is not None else math.log10(0.5)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(count + 1), pa.array(good[first[1:]] - good[first[:-1]] + (end_log is not None)), pa.array(sums[first[1:]] - sums[first[:-1]] + ends - base * (count + 1)),
                     pa.array(-math.log10(2) * bits), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(offsets), tail)],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "n_bytes", "tail"],
                )

    return run


def _learn(shared):
    """A task's weights and map, and how many bytes they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, seen = None, 0
        for batch in batches:
            for b in batch.column("blob"):
                mixer = mixer or Mixer(shared.value, np.ones((2, 257)))
                keys, counts = unpack(b.as_py())
                # in the order of a hash: neighbours have nothing in common
                order = np.argsort(mixed(keys))
                mixer.learn(keys[order], counts[order])
                seen += int(counts.sum())
        if mixer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([np.concatenate([mixer.weights.ravel(), mixer.apm.ravel()]).astype(np.float64).tobytes()], pa.binary())], names=["n", "blob"])

    return run


def train(training: DataFrame) -> Mixer:
    """The model of all texts of a table."""
    spark = session(training)
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a part's keys are a share of all text's; distinct ones are fewer
    parts = min(MAX_PARTS, max(8, size // (8 * PART_KEYS)))
    summed_keys = durable(training.select("text").mapInArrow(_count_keys(parts), "part int, blob binary").groupBy("part").applyInArrow(_sum_keys, "part int, blob binary"))
    ends = summed_keys.where("part < 0").first()
    ends = np.frombuffer(ends["blob"], np.int64).reshape(2, 257) if ends else np.zeros((2, 257), np.int64)
    grams = summed_keys.where("part >= 0").select("blob")
    sizes = np.zeros((INPUTS, 256), np.int64)
    for r in grams.mapInArrow(_levels, "which int, level int, n bigint").groupBy("which", "level").agg(F.sum("n").alias("n")).collect():
        sizes[r["which"], r["level"]] = r["n"]
    least = [int(np.argmax(np.cumsum(n[::-1])[::-1] <= GRAMS * (1 + (which == LONG)))) for which, n in enumerate(sizes)]
    least[0] = 0  # parts share these, and there are few
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(INPUTS)]
    # GRAMS of twelve bytes a predictor at most; parts share only the shortest grams
    for r in durable(grams.mapInArrow(_frequent(least), "which int, blob binary")).toLocalIterator():
        held[r["which"]].append(unpack(r["blob"]))
    tables = []
    for which in range(INPUTS):
        keys, counts = summed(*[np.concatenate(x) for x in zip(*held[which])]) if held[which] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held[which] = []
        tables.append(long_table(keys, counts) if which == LONG else table(keys, counts, which))
    mixer = Mixer(tables, ends)
    shared = spark.sparkContext.broadcast(tables)  # MAX_BITS a table at most
    learned, seen = None, 0
    for r in durable(grams.mapInArrow(_learn(shared), "n bigint, blob binary")).toLocalIterator():
        x = np.frombuffer(r["blob"]) * r["n"]
        learned, seen = x if learned is None else learned + x, seen + r["n"]
    if seen:
        mean = (learned / seen).astype(np.float32)
        mixer.weights, mixer.apm = mean[: mixer.weights.size].reshape(mixer.weights.shape), mean[mixer.weights.size :].reshape(mixer.apm.shape)
    shared.unpersist()
    return mixer


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every document."""
    spark = session(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = remainder(F.col("doc_id"), FOLDS)
    training = docs.select("doc_id", "text").where(rest != HELD_OUT).select("text")
    gathered = durable(training.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c")))
    counts = gathered.where(~F.col("word").isin(DOCS, TOKENS))
    sums = {r["word"]: r["c"] for r in gathered.where(F.col("word").isin(DOCS, TOKENS)).collect()}
    n_docs, n_tokens = sums.get(DOCS, 0), sums.get(TOKENS, 0)
    # how frequent a word must be for the head: counts by eighths of powers of two, some hundred rows
    by = F.floor(8 * F.log2(F.col("c"))).cast("int")
    sizes = counts.groupBy(by.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    n_distinct = sum(r["n"] for r in sizes) + (n_docs > 0)
    total, least = 0, None
    for r in sizes:
        total += r["n"]
        if total > HEAD:
            break
        least = r["level"]
    short = ~F.col("word").startswith(" ")
    base = math.log10(n_tokens + 0.5 * (n_distinct + 1))
    head = counts.where((by >= least) & short).toArrow().combine_chunks() if least is not None else None
    if head is not None and len(head):
        column = head.column("word").combine_chunks()
        buf, at = buffer(column)
        found = names(buf, at[:-1], at[1:])
        order = np.argsort(found)
        found, logs = found[order], np.log10(head.column("c").to_numpy()[order] + 0.5)
    else:
        found, logs = np.zeros(0, np.uint64), np.zeros(0)
    shared = spark.sparkContext.broadcast((train(training), found, logs))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (rest == HELD_OUT).alias("held_out"), "text")
    scored = rows.mapInArrow(
        _score(shared, math.log10(n_docs + 0.5) if n_docs else None, base),
        f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, score double, n_bytes bigint, tail array<struct<word:string,tf:bigint>>",
    )
    plain = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "n_bytes"]
    scored = durable(scored)
    asked = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf")
    tail = counts.where((by < least) | ~short) if least is not None else counts
    answers = asked.join(tail, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(F.lit(0))).alias("more_known"), F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more_logs")
    )
    out = scored.select(*plain).join(answers, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
