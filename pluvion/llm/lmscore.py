"""Language-model scoring by logistic context mixing over bits.

A token is a word (A-Z lower-cased) or the end of a text. It is spelled as bytes (a blank closes a word, a line feed is
the end), and each bit is predicted from the counts of several contexts inside the token: place, the last one, two and
three bytes, and the whole of the token so far. Short contexts live in hashed tables of fixed size; the beginnings of
tokens are counted exactly where tokens of one head (first bytes) are sorted together; a head that very many tokens share
is lengthened until few do. The predictions' logits are combined by weights that a gate selects (how often the two
longest contexts were seen, and for how long the beginning has had one count), learned online; an adaptive probability
map then refines the mixed prediction. The sum over bits gives bits per byte, and log10 P(text).

That is a token's own probability. Two longer contexts are mixed in, the token before and the two before, by their exact
counts in training: P(w | h) = g count(h, w) / count(h) + (1 - g) P(w | shorter h). The weight g is chosen by a gate, the
size of count(h), and learned over all training tokens, each left out of its own counts. An unseen h leaves the shorter
one. The first token of a text follows the end token.

1. One pass over the texts writes, for each chunk of documents, a file of the documents as token numbers, and gives its
   distinct tokens, pairs and triples, in buckets of their hashes, with their training counts.
2. Counts are summed over the corpus a bucket at a time. A chunk sends each key once, so frequent ones make no bucket
   large, and buckets are as many as the corpus needs.
3. The bit tables are sums over tokens of count and so merge by addition; mixer and map learn online on the tokens of
   each partition, an occurrence never seeing itself, and are averaged by curvature; each distinct token is scored once.
4. Counts and scores go back to their chunks. Gates are learned and documents are scored by passes over the chunks' files
   and what came back for them. What a step has used up is deleted.

The bit tables have a fixed size (``SLOTS`` counters of 8 bytes), so they may be broadcast; all that grows with the
corpus stays in distributed tables.

Defined results: null and empty texts are one end token; texts are read whole; rows repeated get equal results; a null
id counts as the text ''; with no training tokens every known count is 0 and predictions are those of empty tables;
an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.session import ship

from . import common
from .setsketch import mix as scramble
from .tokens import slices

END = "\n"
#: Counters (powers of 2) of each hashed context: place, one, two and three bytes, the token so far where it is short.
BITS = (12, 16, 18, 19, 20)
STARTS = tuple(int(x) for x in np.concatenate([[0], np.cumsum([1 << b for b in BITS])]))
SLOTS = STARTS[-1]
PIECE = 1 << 16
#: Tokens that share so many bytes are scored together, and their common beginnings counted exactly from there on,
HEAD = 3
#: or from further on where more distinct tokens than this share a head; heads grow by doubling up to the last length.
HOT_HEAD, LONGEST_HEAD = 200_000, 48
#: Bytes of tokens that are compared side by side; longer common beginnings are looked at one by one.
WIDE = 48
PRIOR = (0.4, 0.4, 0.2, 0.1, 0.02)
RUNS, SEEN, MIDDLE = 4, 16, 3
GATES = RUNS * SEEN * MIDDLE
INPUTS = len(BITS) + 1
CELLS = 33
#: Weight of the first weights against what is learned, and most that a weight moves in one step.
STIFF, STEP = 3000.0, 0.1
CHUNK_BYTES = 12 << 20
#: Bytes of text for each bucket of pairs and triples, and bytes of a hash kept beside the bucket's number.
BUCKET_BYTES, KEY_BYTES = 8 << 20, 5
#: Gates of the longer contexts (by powers of 2 of their count), and bins of their odds against the shorter one.
SIZES, BINS = 24, 64
#: Distinct tokens of one training task, and least number of one online step.
TASK_TOKENS = 1_000_000
BATCH_TOKENS = 4_096
#: Tokens of a chunk whose probabilities are worked out at once.
PART = 1 << 17


def spell(tokens: list[bytes]) -> list[bytes]:
    return [t if t == b"\n" else t + b" " for t in tokens]


@dataclass
class Bytes:
    """Spelled tokens byte by byte: owner, place, byte, first counter of each hashed context, counts of beginnings; with those, the bytes
    beyond their heads and what gate the runs of one count give."""

    owner: np.ndarray
    place: np.ndarray
    data: np.ndarray
    bases: list[np.ndarray]
    head: np.ndarray
    ends: np.ndarray | None = None
    deep: np.ndarray | None = None
    run: np.ndarray | None = None

    @classmethod
    def of(cls, tokens: list[bytes], heads: np.ndarray, counts: np.ndarray | None = None) -> "Bytes":
        """Of spelled tokens and the lengths of their heads; with ``counts`` they are sorted, whole groups of one head."""
        n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        owner = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        place = np.arange(len(owner)) - first[owner]
        data = np.frombuffer(b"".join(tokens), np.uint8)
        last = [np.zeros(len(data), np.uint64) for _ in range(3)]
        for k in range(3):
            last[k][k + 1 :] = data[: max(len(data) - k - 1, 0)]
            last[k][place <= k] = 0  # before the token's start
        one = last[0]
        two = one | last[1] << np.uint64(8)
        three = two | last[2] << np.uint64(16)
        depth = np.minimum(place, 15).astype(np.uint64)
        # a head of up to HEAD - 1 bytes is the last bytes and the place
        bases = [depth << np.uint64(8), one << np.uint64(8), scramble(two + np.uint64(1 << 40)), scramble(three + np.uint64(2 << 40)), scramble(two + (depth + np.uint64(3)) * np.uint64(1 << 40))]
        bases = [x.astype(np.uint32) for x in bases]  # counters are chosen by fewer bits
        head = heads[owner]
        if counts is None:
            return cls(owner, place, data, bases, head)
        ends = beginnings(tokens, n, first, counts, owner, place)
        # Bytes for which the count of the beginning has not changed: the longer, the surer that the token is the known one.
        total = ends[:, 0]
        stays = np.concatenate([[False], total[1:] == total[:-1]])[: len(total)] & (place > head) & (total > 0)
        index = np.arange(len(stays))
        length = np.minimum(index - np.maximum.accumulate(np.where(stays, 0, index)), 5)
        return cls(owner, place, data, bases, head, ends, np.flatnonzero(place >= head), np.asarray([0, 1, 2, 2, 3, 3], np.uint8)[length] * np.uint8(SEEN * MIDDLE))


def common_bits(tokens: list[bytes]) -> np.ndarray:
    """Bits that each token has in common with the one before it (0 for the first); tokens are sorted and different."""
    width = min(max(map(len, tokens)), WIDE)
    grid = np.frombuffer(b"".join([t[:width].ljust(width, b"\0") for t in tokens]), np.uint8).reshape(len(tokens), width)
    differs = grid[1:] ^ grid[:-1]
    at = (differs != 0).argmax(axis=1).astype(np.int64)
    byte = differs[np.arange(len(at)), at].astype(np.int64)
    for i in np.flatnonzero(byte == 0).tolist():  # alike for WIDE bytes
        a, b = tokens[i], tokens[i + 1]
        k = next((k for k in range(width, min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        at[i], byte[i] = k, (a[k] ^ b[k]) if k < min(len(a), len(b)) else 128
    return np.concatenate([[0], 8 * at + 7 - np.floor(np.log2(np.maximum(byte, 1))).astype(np.int64)])


def beginnings(tokens: list[bytes], n: np.ndarray, first: np.ndarray, counts: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(bytes, 9): how often tokens begin with what precedes bit 0 to 7 of each byte, and with the byte itself.

    The tokens are sorted, so those with a common beginning stand together; zero before HEAD. Beyond the longest common
    beginning a token is alone, and has its own count.
    """
    if not len(tokens):
        return np.zeros((0, 9), np.float32)
    same = common_bits(tokens)
    width = int(same.max()) // 8 + 1
    out = np.where((place >= max(width, HEAD))[:, None], counts[owner][:, None], 0).astype(np.float32) * np.ones((1, 9), np.float32)
    for d in range(HEAD, min(width, int(n.max()))):
        alive = np.flatnonzero(n > d)
        if not len(alive):
            break
        shared = np.where(np.concatenate([[False], np.diff(alive) == 1]), same[alive], 0)
        c = counts[alive]
        for k in range(9):
            new = shared < 8 * d + k
            new[0] = True
            starts = np.flatnonzero(new)
            out[first[alive] + d, k] = np.add.reduceat(c, starts)[np.cumsum(new) - 1]
    return out


def bit_slots(b: Bytes, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bit k of each byte from the top, counters of each hashed context for it)."""
    node = (b.data.astype(np.uint32) | np.uint32(256)) >> np.uint32(8 - k)
    far = node * np.uint32(0x2545F491)
    out = []
    for c, (base, size) in enumerate(zip(b.bases, BITS, strict=True)):
        at = base + (node if c < 2 else far)
        out.append((at & np.uint32((1 << size) - 1)).astype(np.int64) + STARTS[c])
    return ((b.data >> (7 - k)) & 1).astype(np.int64), out


def count_bits(tokens: list[bytes], heads: np.ndarray, counts: np.ndarray, tables: np.ndarray) -> None:
    """Add the bits of the tokens, each ``counts`` times, to tables (SLOTS, 2)."""
    b = Bytes.of(tokens, heads)
    weight = counts[b.owner].astype(np.float64)
    short = b.place < b.head
    for k in range(8):
        bit, slots = bit_slots(b, k)
        for c, at in enumerate(slots):
            low, size = STARTS[c], 1 << BITS[c]
            index, w = (at - low) * 2 + bit, weight
            if c == len(slots) - 1:
                index, w = index[short], w[short]
            tables[low : low + size] += np.bincount(index, weights=w, minlength=2 * size).reshape(-1, 2)


def _levels(seen: np.ndarray) -> np.ndarray:
    """Gate of how often a beginning was seen."""
    return np.minimum(np.where(seen < 3.5, seen, 2 + np.log2(np.maximum(seen, 1))), SEEN - 1).astype(np.uint8) * np.uint8(MIDDLE)


@dataclass
class Sights:
    """What each counter says, worked out once: its logit, and its part of the gate; with ``unseen`` for either bit (counter * 2 + bit), one occurrence of it taken out."""

    unseen: bool
    logits: np.ndarray
    levels: np.ndarray
    between: np.ndarray

    @classmethod
    def of(cls, tables: np.ndarray, unseen: bool) -> "Sights":
        zero, one = tables[:, 0].astype(np.float32), tables[:, 1].astype(np.float32)
        if unseen:
            zero, one = np.column_stack([np.maximum(zero - 1, 0), zero]).ravel(), np.column_stack([one, np.maximum(one - 1, 0)]).ravel()
        borders = [x * (1 + unseen) for x in STARTS]
        logits = np.empty(len(zero), np.float32)
        for prior, a, b in zip(PRIOR, borders[:-1], borders[1:], strict=True):
            logits[a:b] = np.log((one[a:b] + np.float32(prior)) / (zero[a:b] + np.float32(prior)))
        total = zero + one
        middle = total[borders[-3] : borders[-2]]
        return cls(unseen, logits, _levels(total[borders[-2] :]), np.where(middle < 0.5, 0, np.where(middle < 30, 1, 2)).astype(np.uint8))


def inputs(b: Bytes, k: int, sights: Sights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bit, logits (INPUTS, bits), gate) for bit k of each byte."""
    bit, slots = bit_slots(b, k)
    unseen = sights.unseen
    x = np.empty((INPUTS, len(bit)), np.float32)
    for c, at in enumerate(slots):
        if unseen:
            at *= 2
            at += bit
        np.take(sights.logits, at, out=x[c], mode="clip")
    between = sights.between.take(slots[-2] - STARTS[-3] * (1 + unseen))
    level = sights.levels.take(slots[-1] - STARTS[-2] * (1 + unseen))
    own, node = b.ends[b.deep, k + 1], b.ends[b.deep, k]
    other = node - own
    if unseen:
        own = np.maximum(own - 1, 0)
    same = np.log((own + np.float32(PRIOR[-1])) / (other + np.float32(PRIOR[-1])))
    x[len(slots) - 1, b.deep] = np.where(bit[b.deep] == 1, same, -same)
    level[b.deep] = _levels(own + other)
    x[-1] = 0.3
    return bit, x, b.run + level + between


@dataclass
class Mixer:
    """Gated weights learned by online Newton steps, and the adaptive map that refines their prediction."""

    weights: np.ndarray  # (GATES, INPUTS)
    curves: np.ndarray  # (GATES, INPUTS, INPUTS): curvature met so far
    cells: np.ndarray  # (GATES, CELLS, 2): weight of zeros and ones seen near a logit

    @classmethod
    def new(cls) -> "Mixer":
        weights = np.zeros((GATES, INPUTS))
        level = (np.arange(GATES) // MIDDLE) % SEEN
        weights[:, -2] = np.clip(level / 4, 0.0, 1.0)
        weights[:, -3] = 1 - weights[:, -2]
        curves = np.tile(np.eye(INPUTS) * STIFF, (GATES, 1, 1))
        at = np.linspace(-12, 12, CELLS)
        cells = np.zeros((GATES, CELLS, 2))
        cells[:, :, 1] = 4 / (1 + np.exp(-at))
        cells[:, :, 0] = 4 - cells[:, :, 1]
        return cls(weights, curves, cells)

    def logit(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(self.weights.T)
        t = columns[0].take(gate) * x[0]
        for w, part in zip(columns[1:], x[1:], strict=True):
            t += w.take(gate) * part
        return np.clip(t, -16, 16, out=t)

    def _cells(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (np.clip(t, -12, 11.999) + 12) * (CELLS - 1) / 24
        low = place.astype(np.int64)
        return low, place - low

    def predict(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Refined probability of a one."""
        t = self.logit(x, gate)
        low, part = self._cells(t)
        share = (self.cells[:, :, 1] / self.cells.sum(axis=2)).ravel()
        at = gate.astype(np.int64) * CELLS + low
        refined = share[at] * (1 - part) + share[at + 1] * part
        return np.clip((1 / (1 + np.exp(-t)) + 3 * refined) / 4, 1e-7, 1 - 1e-7)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """One online step on a batch of bits."""
        t = self.logit(x, gate)
        p = 1 / (1 + np.exp(-t))
        order = np.argsort(gate, kind="stable")
        xs = x[:, order].astype(np.float64)
        error, curve = ((bit - p) * weight)[order], (p * (1 - p) * weight)[order]
        many = np.bincount(gate, minlength=GATES)
        met, ends = np.flatnonzero(many), np.cumsum(many)
        slopes = np.empty((len(met), INPUTS))
        for i, g in enumerate(met.tolist()):
            a, b = ends[g] - many[g], ends[g]
            part = xs[:, a:b]
            self.curves[g] += (part * curve[a:b]) @ part.T
            slopes[i] = part @ error[a:b]
        self.weights[met] += np.linalg.solve(self.curves[met], slopes[:, :, None])[:, :, 0].clip(-STEP, STEP)
        low, part = self._cells(t)
        at = (gate.astype(np.int64) * CELLS + low) * 2 + bit
        both = np.bincount(np.concatenate([at, at + 2]), weights=np.concatenate([weight * (1 - part), weight * part]), minlength=self.cells.size)
        self.cells += both[: self.cells.size].reshape(self.cells.shape)


def in_groups(tokens: list[bytes], *columns: np.ndarray) -> tuple:
    """The spelled tokens in byte order, and the columns with them."""
    spelled = spell(tokens)
    order = sorted(range(len(spelled)), key=spelled.__getitem__)
    return [spelled[i] for i in order], *(c[order] for c in columns), np.asarray(order, np.int64)


def learn_mixer(tokens: list[bytes], heads: np.ndarray, counts: np.ndarray, tables: np.ndarray | Sights, mixer: Mixer) -> None:
    """Online pass over tokens (whole groups of one head)."""
    tokens, heads, counts, _ = in_groups(tokens, heads, counts)
    b = Bytes.of(tokens, heads, counts)
    weight = counts[b.owner].astype(np.float64)
    sights = tables if isinstance(tables, Sights) else Sights.of(tables, True)
    for k in range(8):
        bit, x, gate = inputs(b, k, sights)
        mixer.learn(x, gate, bit, weight)


def token_scores(tokens: list[bytes], heads: np.ndarray, counts: np.ndarray, tables: np.ndarray | Sights, mixer: Mixer) -> np.ndarray:
    """log10 probability of each token (whole groups of one head)."""
    sorted_tokens, heads, c, order = in_groups(tokens, heads, counts)
    b = Bytes.of(sorted_tokens, heads, c)
    sights = tables if isinstance(tables, Sights) else Sights.of(tables, False)
    chance = np.ones(len(b.data))
    for k in range(8):
        bit, x, gate = inputs(b, k, sights)
        p = mixer.predict(x, gate)
        chance *= np.where(bit == 1, p, 1 - p)
    out = np.empty(len(tokens))
    out[order] = np.bincount(b.owner, weights=np.log10(chance), minlength=len(tokens))
    return out


# --- Spark side


def _tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts one after the other, number of words of each)."""
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.fill_null("")))
    flat = split.flatten()
    real = pa.compute.not_equal(flat, "")
    borders = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return flat.filter(real), np.diff(borders)


def followed(numbers: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with each text's end, the one before each, text's start?)."""
    sizes = n + 1
    token = np.full(int(sizes.sum()), end, np.int64)
    token[np.delete(np.arange(len(token)), np.cumsum(sizes) - 1)] = numbers
    first = np.zeros(len(token), bool)
    first[np.cumsum(sizes) - sizes] = True
    before = np.where(first, end, np.concatenate([[end], token[:-1]]))
    return token, before, first


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order, keys in it) of non-negative numbers: leading bits and place are sorted as one number, many times as fast as an order is found."""
    keys = keys.view(np.uint64)
    bits = np.uint64(max(len(keys) - 1, 1).bit_length())
    up = np.uint64(64 - max(int(keys.max(initial=1)), 1).bit_length())
    both = ((keys << up) >> bits) << bits
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    both &= (np.uint64(1) << bits) - np.uint64(1)
    order = both.view(np.int64)
    out = keys[order]
    wrong = np.flatnonzero(out[1:] < out[:-1])  # different keys with the same leading bits
    if len(wrong) > 1000:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    lead = lambda i: (int(out[i]) << int(up)) >> int(bits)
    for i in wrong.tolist():
        a, b = i, i + 2
        while a and lead(a - 1) == lead(i):
            a -= 1
        while b < len(out) and lead(b) == lead(i):
            b += 1
        order[a:b] = order[a:b][np.lexsort((order[a:b], out[a:b]))]
        out[a:b] = keys[order[a:b]]
    return order, out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the place of each key among them."""
    order, out = ordered(keys)
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    place = np.empty(len(out), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return out[new].view(keys.dtype), place


def runs(numbers: np.ndarray, n: np.ndarray, end: int, size: int) -> tuple:
    """(tokens with each text's end, the one before each, text's start?, pair codes, pair of each, triple codes, triple of each).

    Numbers are a chunk's, below ``size``; a pair's code is before * size + token, a triple's pair * size + token. Texts'
    first tokens have no triple (-1). Codes depend on the set of texts only.
    """
    token, before, first = followed(numbers, n, end)
    pairs, pair = distinct(before * size + token)
    third = np.concatenate([[0], pair[:-1]]) * size + token
    triples, known = distinct(third[~first])
    triple = np.full(len(token), -1, np.int32)
    triple[~first] = known
    return token, before, first, pairs, pair, triples, triple


def hashes(tokens: pa.Array) -> np.ndarray:
    return pd.util.hash_array(tokens.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _combined(one: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = len(one)
    two = scramble(one[pairs // k] * np.uint64(0x9E3779B97F4A7C15) + one[pairs % k])
    three = scramble(two[triples // k] * np.uint64(0xC2B2AE3D27D4EB4F) + one[triples % k])
    return two.view(np.int64), three.view(np.int64)


def following(one: np.ndarray, token: np.ndarray, before: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of ``_combined`` along the tokens: of the pair that each ends, and of the triple that each but a text's first ends."""
    two = scramble(one[before] * np.uint64(0x9E3779B97F4A7C15) + one[token])
    rest = np.flatnonzero(~first)
    return two, scramble(two[rest - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[token[rest]])


def _squeezed(data: bytes, strategy: int) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 15, 8, strategy)
    return c.compress(data) + c.flush()


def packed(counts: np.ndarray, strategy: int = zlib.Z_RLE) -> bytes:
    """Counts as bytes, compressed, their number before them; those of 255 and more follow in 8 bytes each."""
    return _squeezed(np.array([len(counts)], "<u4").tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes(), strategy)


def unpacked(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=4 + n)
    return out


def dealt(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the hashes, first place of each bucket in it and the end, the KEY_BYTES bytes of each hash in order that follow the bucket's bits)."""
    order, hashes = ordered(keys)
    starts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return order, starts, (hashes << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)


def narrowed(keys: np.ndarray) -> bytes:
    """Ascending keys of KEY_BYTES bytes: low bytes as they are, of what stands above them the steps from key to key, which are small where the keys are many."""
    if not len(keys):
        return b""
    low = 3 if len(keys) >= 1 << 12 else 4 if len(keys) >= 1 << 4 else KEY_BYTES
    high = (keys >> np.uint64(8 * low)).astype(np.int64)
    raw = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low])
    return bytes([low]) + raw.tobytes() + packed(np.diff(high, prepend=0), zlib.Z_HUFFMAN_ONLY) + struct.pack("<I", len(keys))


def widened(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    low, (n,) = data[0], struct.unpack("<I", data[-4:])
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(data, np.uint8, n * low, 1).reshape(n, low)
    return out.view("<u8").ravel() | np.cumsum(unpacked(data[1 + n * low : -4])).astype(np.uint64) << np.uint64(8 * low)


def size_of(count: np.ndarray) -> np.ndarray:
    """Gate of a context's count; 0: unseen."""
    return np.where(count > 0, np.minimum(1 + np.floor(np.log2(np.maximum(count, 1))), SIZES - 1), 0).astype(np.int64)


def mixed_in(p: np.ndarray, count: np.ndarray, context: np.ndarray, gates: np.ndarray) -> np.ndarray:
    g = gates[size_of(context)]
    return g * count / np.maximum(context, 1) + (1 - g) * p


def odds_seen(p: np.ndarray, count: np.ndarray, context: np.ndarray) -> np.ndarray:
    """(SIZES, BINS + 1) training tokens by gate and by the odds of the longer context against ``p``, each left out of its counts.

    Bin 0: the context never had the token.
    """
    count, context = count - 1, context - 1
    odds = np.log2(np.maximum(count / np.maximum(context, 1), 1e-30) / p)
    bin_ = np.where(count > 0, 1 + np.clip(np.floor(odds + 16), 0, BINS - 1), 0).astype(np.int64)
    return np.bincount(size_of(context) * (BINS + 1) + bin_, minlength=SIZES * (BINS + 1)).reshape(SIZES, BINS + 1)


def gates_of(seen: np.ndarray) -> np.ndarray:
    """The weight of each gate under which its training tokens are most likely (expectation maximisation)."""
    odds = np.concatenate([[0.0], 2.0 ** (np.arange(BINS) - 15.5)])
    g = np.full(SIZES, 0.5)
    for _ in range(300):
        share = g[:, None] * odds / (g[:, None] * odds + 1 - g[:, None])
        g = np.clip((seen * share).sum(axis=1) / np.maximum(seen.sum(axis=1), 1), 0.0, 1 - 1e-6)
    g[0] = 0.0  # unseen
    return g


def _stored(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def chunks(docs: DataFrame, base: str, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, out: int = 2, bits: int = 3) -> DataFrame:
    """Rows (chunk, bucket, tokens, counts1, keys2, counts2, keys3, counts3): a chunk's distinct tokens, pairs and triples of one bucket, in the order of their hashes.

    ``chunk`` names a file under ``base`` with the documents (id, held_out, numbers) and the tokens by number; files of
    lost tasks are never named.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(fold)) == out

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        waiting: list[pa.RecordBatch] = []
        size = 0

        def close():
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            ids, holds, texts = (table.column(i).combine_chunks() for i in range(3))
            words, n = _tokenised(texts)
            coded = words.dictionary_encode()
            tokens = pa.concat_arrays([coded.dictionary, pa.array([END])])
            one = hashes(tokens)
            # numbers are places in the order of hashes
            order, starts, _ = dealt(one.view(np.int64), bits)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            tokens, one = tokens.take(pa.array(order)), one[order]
            numbers = rank[coded.indices.to_numpy(zero_copy_only=False)]
            end = int(rank[-1])
            train = ~holds.to_numpy(zero_copy_only=False)
            c = np.bincount(numbers[np.repeat(train, n)], minlength=len(tokens))
            c[end] = train.sum()
            chunk = f"{uuid.uuid4().hex}.chunk"
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), pa.array(numbers.astype(np.uint32)))
            parts = [_stored(pa.table({"id": ids, "held_out": holds, "numbers": lists})), _stored(pa.table({"token": tokens}))]
            with store.open_output_stream(f"{root}/{chunk}") as f:
                f.write(struct.pack("<q", len(parts[0])) + parts[0] + parts[1])
            _, _, first, pairs, pair, triples, triple = runs(numbers, n, end, len(tokens))
            two, three = _combined(one, pairs, triples)
            weight = np.repeat(train, n + 1)
            words_of = pa.compute.if_else(pa.compute.equal(tokens, END), "", tokens).to_pylist()
            spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
            blobs = [[zlib.compress("\n".join(words_of[a:b]).encode("utf-8", "surrogatepass"), 1) if b > a else None for a, b in spans], [packed(c[a:b].astype(np.int64)) for a, b in spans]]
            for key, count in ((two, np.bincount(pair, weights=weight, minlength=len(two))), (three, np.bincount(triple[~first], weights=weight[~first], minlength=len(three)))):
                order, starts, rest = dealt(key, bits)
                count = count[order].astype(np.int64)
                spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
                blobs += [[narrowed(rest[a:b]) for a, b in spans], [packed(count[a:b]) for a, b in spans]]
            some = [i for i in range(1 << bits) if blobs[0][i] or blobs[2][i] or blobs[4][i]]
            for a in range(0, len(some), 64):
                part = some[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part)), pa.array(part, pa.int32()), *(pa.array([blob[i] for i in part], pa.binary()) for blob in blobs)], names=["chunk", "bucket", "tokens", "counts1", "keys2", "counts2", "keys3", "counts3"])

        for batch in batches:
            for a, b in slices(batch.column(2), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                waiting.append(part)
                size += pa.compute.sum(pa.compute.binary_length(part.column(2))).as_py() or 0
                if size >= CHUNK_BYTES:
                    yield from close()
                    size = 0
        if waiting:
            yield from close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return common.arrow(rows, run, "chunk string, bucket int, tokens binary, counts1 binary, keys2 binary, counts2 binary, keys3 binary, counts3 binary")


SUMMED = pa.schema([("kind", pa.int32()), ("chunk", pa.string()), ("bucket", pa.int32()), ("place", pa.int32()), ("token", pa.string()), ("c", pa.int64()), ("at", pa.binary()), ("c2", pa.binary()), ("c3", pa.binary())])


def summed(rows: DataFrame) -> DataFrame:
    """Of the rows of ``chunks``: a bucket's tokens with their counts over the corpus (kind 0: bucket, place, token, c), and for each chunk (kind 1) the places of its tokens and the corpus's counts of its pairs and triples."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        size, bucket = len(table), table.column("bucket")[0].as_py()
        lists = [zlib.decompress(x).split(b"\n") if x is not None else [] for x in table.column("tokens").to_pylist()]
        coded = pa.array([t for x in lists for t in x], pa.binary()).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.concatenate([unpacked(x) for x in table.column("counts1").to_pylist()])
        total = np.bincount(at, weights=counts, minlength=len(coded.dictionary)).astype(np.int64)
        places = [x.astype("<u4").tobytes() for x in np.split(at, np.cumsum([len(x) for x in lists])[:-1])]
        del lists, counts, at
        sums = []
        for name in ("2", "3"):
            keys = [widened(x) for x in table.column("keys" + name).to_pylist()]
            n = [len(k) for k in keys]
            counts = np.concatenate([unpacked(x) for x in table.column("counts" + name).to_pylist()])
            _, at = distinct(np.concatenate(keys))
            own = np.bincount(at, weights=counts).astype(np.int64)
            sums.append(pa.array([packed(own[part]) for part in np.split(at, np.cumsum(n)[:-1])], pa.binary()))
            del keys, counts, at
        tokens = coded.dictionary.cast(pa.string())
        tokens = pa.compute.if_else(pa.compute.equal(tokens, ""), END, tokens)
        m = len(tokens)
        have = [
            {"kind": pa.array(np.zeros(m, np.int32)), "bucket": pa.array(np.full(m, bucket, np.int32)), "place": pa.array(np.arange(m, dtype=np.int32)), "token": tokens, "c": pa.array(total)},
            {"kind": pa.array(np.ones(size, np.int32)), "chunk": table.column("chunk").combine_chunks(), "bucket": pa.array(np.full(size, bucket, np.int32)), "at": pa.array(places, pa.binary()), "c2": sums[0], "c3": sums[1]},
        ]
        return pa.concat_tables([pa.Table.from_arrays([x.get(f.name, pa.nulls(len(x["kind"]), f.type)) for f in SUMMED], schema=SUMMED) for x in have])

    return rows.groupBy("bucket").applyInArrow(one, "kind int, chunk string, bucket int, place int, token string, c bigint, at binary, c2 binary, c3 binary")


def returned(scored: DataFrame, sums: DataFrame) -> DataFrame:
    """(chunk, own, c1, c2, c3): for each chunk the scores and counts of its tokens, and the counts of its pairs and triples, in the order of their hashes."""

    def in_bucket(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left.column("place").to_numpy())
        score, c = (left.column(k).to_numpy()[order] for k in ("score", "c"))
        at = [np.frombuffer(x, "<u4") for x in right.column("at").to_pylist()]
        return pa.table({
            "chunk": right.column("chunk"), "bucket": right.column("bucket"), "own": pa.array([score[x].astype("<f4").tobytes() for x in at], pa.binary()), "c1": pa.array([packed(c[x]) for x in at], pa.binary()),
            "c2": right.column("c2"), "c3": right.column("c3"),
        })

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        joined = {k: packed(np.concatenate([unpacked(x) for x in table.column(k).to_pylist()])) for k in ("c1", "c2", "c3")}
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "own": pa.array([b"".join(table.column("own").to_pylist())], pa.binary()), **{k: pa.array([v], pa.binary()) for k, v in joined.items()}})

    back = scored.groupBy("bucket").cogroup(sums.filter("kind = 1").select("chunk", "bucket", "at", "c2", "c3").groupBy("bucket")).applyInArrow(in_bucket, "chunk string, bucket int, own binary, c1 binary, c2 binary, c3 binary")
    return back.groupBy("chunk").applyInArrow(whole, "chunk string, own binary, c1 binary, c2 binary, c3 binary")


@dataclass
class Model:
    tables: np.ndarray
    mixer: Mixer
    train_tokens: int
    distinct: int
    #: Broadcast of the tables.
    shared: object = None


def _collected(batches, least: int, whole: bool = False):
    """(tokens, lengths of their heads, counts, further columns) of at least ``least`` rows a time; ``whole``: never parting the tokens of one head."""
    tokens: list[bytes] = []
    parts: list[tuple[np.ndarray, ...]] = []
    head = None

    def ready():
        lengths, counts, *more = (np.concatenate(x) for x in zip(*parts))
        return tokens, lengths, counts, more

    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(0).cast(pa.binary()).to_pylist()
        heads = batch.column(2).to_pylist()
        columns = [np.maximum(np.fromiter(map(len, heads), np.int64, len(heads)), HEAD), batch.column(1).to_numpy(), *(batch.column(i).to_numpy() for i in range(3, batch.num_columns))]
        borders = [0, *(i for i in range(1, len(own)) if heads[i] != heads[i - 1]), len(own)] if whole else [0, len(own)]
        for a, b in zip(borders, borders[1:]):
            if len(tokens) >= least and not (whole and heads[a] == head):
                yield ready()
                tokens, parts = [], []
            tokens += own[a:b]
            parts.append(tuple(x[a:b] for x in columns))
            head = heads[a]
    if tokens:
        yield ready()


def by_head(counts: DataFrame) -> tuple[DataFrame, int]:
    """((token, c, head, ...), rows) of (token, c, ...): tokens of one head together, heads in an order that has nothing to do with their bytes; written.

    A head is a token's first HEAD bytes, or twice as many and so on where more than HOT_HEAD tokens share it.
    """
    raw = F.encode("token", "UTF-8")
    rows = counts.count()
    head, length = F.substring(raw, 1, HEAD), HEAD
    while length < LONGEST_HEAD:
        # rows / HOT_HEAD heads at most
        hot = [r["head"] for r in counts.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_HEAD).collect()]
        hot = [h for h in hot if len(h) == length]
        if not hot:
            break
        length *= 2
        head = F.when(head.isin(hot), F.substring(raw, 1, length)).otherwise(head)
    out = counts.select("token", "c", head.alias("head"), *(c for c in counts.columns if c not in ("token", "c")))
    out = out.repartition(max(1, -(-rows // (TASK_TOKENS // 8))), "head").sortWithinPartitions(F.xxhash64("head"), "head")
    return common.materialise(out, "lm-heads"), rows


#: Partial sums that one task adds up, so that no task takes one from every other.
FAN_IN = 64


def _added(parts: DataFrame, columns: dict[str, str], key: str = "piece") -> DataFrame:
    """Sums by ``key`` of compressed arrays (columns: name -> type of their numbers), in rounds of bounded fan-in."""
    kinds = f"{key} int, " + ", ".join(f"{c} binary" for c in columns)

    def add(table: pa.Table) -> pa.Table:
        sums = {c: sum(np.frombuffer(zlib.decompress(x), t) for x in table.column(c).to_pylist()) for c, t in columns.items()}
        return pa.table({key: table.column(key).slice(0, 1).cast(pa.int32()), **{c: pa.array([zlib.compress(v.astype(columns[c]).tobytes(), 1)]) for c, v in sums.items()}})

    few = parts.groupBy(key, F.pmod(F.col("task"), F.lit(FAN_IN))).applyInArrow(lambda table: add(table), kinds)
    return few.groupBy(key).applyInArrow(lambda table: add(table), kinds)


def fit(heads: DataFrame, rows: int) -> Model:
    """Model of (token, c, head) from ``by_head``; tokens with c = 0 take no part."""
    spark = heads.sparkSession
    seen = heads.filter("c > 0")
    known, total = seen.agg(F.count(F.lit(1)), F.sum("c")).first()
    tables = np.zeros((SLOTS, 2), np.float32)
    mixer = Mixer.new()
    model = Model(tables, mixer, int(total or 0), int(known), spark.sparkContext.broadcast(zlib.compress(tables.tobytes(), 1)))
    if not known:
        return model

    def tally(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        own = np.zeros((SLOTS, 2), np.float64)
        for tokens, lengths, c, _ in _collected(batches, 20_000):
            count_bits(spell(tokens), lengths, c, own)
        for i in range(0, SLOTS, PIECE):
            part = own[i : i + PIECE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // PIECE], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(part.astype("<f8").tobytes(), 1)])], names=["piece", "task", "counts"])

    # Few, large tasks: each sends tables of the fixed size.
    parts = common.arrow(seen.coalesce(max(6, -(-rows // TASK_TOKENS))), tally, "piece int, task int, counts binary")
    merged = _added(parts, {"counts": "<f8"}).toArrow()  # the tables' size
    for piece, data in zip(merged.column("piece").to_pylist(), merged.column("counts").to_pylist(), strict=True):
        part = np.frombuffer(zlib.decompress(data), "<f8").reshape(-1, 2)
        tables[piece * PIECE : piece * PIECE + len(part)] = part
    model.shared = shared = spark.sparkContext.broadcast(zlib.compress(tables.tobytes(), 1))

    def online(batches):
        from pyspark import TaskContext

        known, own = _sights(shared, True), Mixer.new()
        start = own.cells.copy()
        for tokens, lengths, c, _ in _collected(batches, BATCH_TOKENS, True):
            learn_mixer(tokens, lengths, c.astype(np.float64), known, own)
        pulled = np.einsum("gij,gj->gi", own.curves, own.weights)
        out = [pa.array([zlib.compress(x.tobytes(), 1)]) for x in (own.curves, pulled, own.cells - start)]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), *out], names=["piece", "task", "curves", "pulled", "cells"])

    # Means of the weights by their curvature: the sums that a mean needs are sums over tasks.
    row = _added(common.arrow(seen, online, "piece int, task int, curves binary, pulled binary, cells binary"), {c: "<f8" for c in ("curves", "pulled", "cells")}).first()
    curves, pulled, cells = (np.frombuffer(zlib.decompress(row[c])) for c in ("curves", "pulled", "cells"))
    mixer.cells += cells.reshape(mixer.cells.shape)
    mixer.weights = np.linalg.solve(curves.reshape(mixer.curves.shape), pulled.reshape(*mixer.weights.shape, 1))[:, :, 0]
    return model


def _sights(shared, unseen: bool) -> Sights:
    """Of the broadcast tables, worked out once a worker."""
    return common.kept(f"sights {unseen} {zlib.crc32(shared.value)}", lambda: Sights.of(np.frombuffer(zlib.decompress(shared.value), np.float32).reshape(SLOTS, 2), unseen))


def score_tokens(heads: DataFrame, model: Model) -> DataFrame:
    """(token, c, score, ...) of ``by_head``."""
    mixer, shared = model.mixer, model.shared
    more = [c for c in heads.columns if c not in ("token", "c", "head")]

    def run(batches):
        known = _sights(shared, False)
        for tokens, lengths, c, rest in _collected(batches, BATCH_TOKENS, True):
            found = token_scores(tokens, lengths, c.astype(np.float64), known, mixer)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(c), pa.array(found.astype(np.float32)), *map(pa.array, rest)], names=["token", "c", "score", *more])

    return common.arrow(heads, run, "token string, c bigint, score float" + "".join(f", `{c}` {heads.schema[c].dataType.simpleString()}" for c in more))


@dataclass
class Laid:
    """A chunk's documents with what came back for them, along their tokens."""

    ids: pa.Array
    held: np.ndarray
    borders: np.ndarray
    token: np.ndarray
    own: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray
    #: (count of what follows, count of the context) of the pair and of the triple that each token ends
    orders: list

    @classmethod
    def of(cls, data: bytes, row: dict, bits: int, orders: int = 2) -> "Laid":
        (cut,) = struct.unpack_from("<q", data)
        docs, tokens = (pa.ipc.open_stream(pa.py_buffer(x)).read_all() for x in (memoryview(data)[8 : 8 + cut], memoryview(data)[8 + cut :]))
        tokens = tokens.column("token").combine_chunks()
        lists = docs.column("numbers").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        end = tokens.index(END).as_py()
        ids, held = docs.column("id").combine_chunks(), docs.column("held_out").to_numpy()
        c, *more = (unpacked(row[k]) for k in ("c1", "c2", "c3")[: 1 + orders])
        one = hashes(tokens)
        token, before, first = followed(flat, n, end)
        two, three = following(one, token, before, first)
        size = pa.compute.binary_length(tokens.cast(pa.binary())).to_numpy().astype(np.int64) + 1
        size[end] = 1
        borders = np.concatenate([[0], np.cumsum(n + 1)])
        places, same = [], True
        for keys, counts in zip((two, three), more):
            keys, place = distinct(keys)
            same &= len(keys) == len(counts)
            places.append(place)
        del two, three, docs, lists
        if not same:  # two pairs of one hash: told apart by their codes, as in ``chunks``
            *_, pairs, pair, triples, triple = runs(flat, n, end, len(tokens))
            places = []
            for keys, at in zip(_combined(one, pairs, triples), (pair, triple[~first])):
                place = np.empty(len(keys), np.int64)
                place[dealt(keys, bits)[0]] = np.arange(len(keys))
                places.append(place[at])
        found = [(_small(more[0])[places[0]], _small(c)[before])]
        del flat, before
        if orders > 1:
            context = np.concatenate([[0], found[0][0][:-1]]).astype(found[0][0].dtype)
            context[first] = 0  # no two tokens before a text's first
            c3 = _small(more[1])
            triple = np.zeros(len(token), c3.dtype)
            triple[~first] = c3[places[1]]
            found.append((triple, context))
        return cls(ids, held, borders, token.astype(np.int32), np.frombuffer(row["own"], "<f4"), c, size, found)

    def parts(self):
        """Slices of the tokens, so that what is worked out along them stays small."""
        return (slice(a, a + PART) for a in range(0, len(self.token), PART))

    def probabilities(self, gates: list[np.ndarray], part: slice = slice(None)) -> np.ndarray:
        """Of each token, with the first ``gates`` orders mixed in."""
        p = 10.0 ** self.own[self.token[part]].astype(np.float64)
        for (count, context), g in zip(self.orders, gates):
            p = mixed_in(p, count[part], context[part], g)
        return p


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.int32) if counts.max(initial=0) < 1 << 31 else counts


def _laid(rows: DataFrame, base: str, bits: int, function, schema: str, orders: int = 2) -> DataFrame:
    """``function`` of each chunk laid out, with the counts of the first ``orders``."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                with store.open_input_stream(f"{root}/{row['chunk']}") as f:
                    laid = Laid.of(f.read(), row, bits, orders)
                row = None
                yield from function(laid)
                del laid
                common.give_back()

    return common.arrow(rows.select("chunk", "own", *("c1", "c2", "c3")[: 1 + orders]), run, schema)


def learned_gates(rows: DataFrame, base: str, bits: int) -> list[np.ndarray]:
    """Gates of the longer contexts, one order after the other, over all training tokens."""
    gates: list[np.ndarray] = []
    for order in range(2):

        def seen_in(laid: Laid, order=order):
            count, context = laid.orders[order]
            some = (context > 0) & np.repeat(~laid.held, np.diff(laid.borders))
            seen = np.zeros(SIZES * (BINS + 1), np.int64)
            for part in laid.parts():
                use = some[part]
                seen += odds_seen(laid.probabilities(gates, part)[use], count[part][use].astype(np.int64), context[part][use].astype(np.int64)).ravel()
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

        seen = np.zeros(SIZES * (BINS + 1))
        for cell, n in _laid(rows, base, bits, seen_in, "cell bigint, n bigint", order + 1).groupBy("cell").agg(F.sum("n")).collect():  # SIZES * (BINS + 1) at most
            seen[cell] = n
        gates.append(gates_of(seen.reshape(SIZES, BINS + 1)))
    return gates


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of each document."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    bits = max(3, (max(1, -(-size // BUCKET_BYTES)) - 1).bit_length())
    base = common.scratch(spark, "lm-documents")
    sums, sums_path = common.stored(summed(chunks(docs, base, id_col, text_col, bits=bits)), "lm-sums")
    common.freed(spark)  # the shuffle of the buckets
    heads, distinct = by_head(sums.filter("kind = 0").select("token", "c", "bucket", "place"))
    model = fit(heads, distinct)
    scored, scored_path = common.stored(score_tokens(heads, model).select("bucket", "place", "c", "score"), "lm-scored")
    common.freed(spark)
    rows, _ = common.stored(returned(scored, sums), "lm-returned")
    common.freed(spark, sums_path, scored_path)
    gates = learned_gates(rows, base, bits)
    total, floor = model.train_tokens, math.log10(model.train_tokens + model.distinct + 1)

    def scores(laid: Laid):
        log = np.concatenate([np.log10(laid.probabilities(gates, part)) for part in laid.parts()])
        known, plain = laid.counts > 0, np.log10(laid.counts + 1.0) - floor
        starts = laid.borders[:-1]
        add = lambda x: np.add.reduceat(x, starts)
        score, n_bytes = add(log), add(laid.sizes[laid.token])
        yield pa.RecordBatch.from_arrays(
            [laid.ids, pa.array(laid.held), pa.array(np.diff(laid.borders)), pa.array(add(known[laid.token].astype(np.int64))), pa.array(np.full(len(score), total, np.int64)), pa.array(add(plain[laid.token])), pa.array(score), pa.array(n_bytes), pa.array(-score / math.log10(2) / n_bytes)],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
        )

    out = _laid(rows, base, bits, scores, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double")
    return out.withColumnRenamed("id", id_col)
