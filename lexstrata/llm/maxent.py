"""A hashed maximum-entropy model with class-factored softmax, in numpy.

Words, in the order of their endings, are cut into ``CLASSES - 1`` classes of even
frequency; the end token is a class of its own. A token's probability is

    softmax over classes * softmax within the class,

and the second factor is itself a chain of two-way softmaxes: each class is a binary tree
whose nodes halve its frequency, down to single words. So a frequent word takes few
decisions, and a distribution over hundreds of thousands of words costs about its entropy.
Every logit, of classes and of decisions, is a bias from the training counts plus weights of
hashed features of the context, all of them learnt by gradients.

Features: the word before; the two words before; the second word before (a skip); the third
and the word before (a skip n-gram). A class has a row of logits for each hashed feature; a
decision has one weight for each hashed pair of feature and node.

Words outside the head share ``RESTS`` leaves by a hash. Inside such a leaf a word of count c
has (c + 0.1) / (N + 0.1 * (V + 1)) of it, which leaves one share for unknown words.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SMOOTH = 0.1
CLASSES = 32
RESTS = 64
FEATURES = 4
NODE_FEATURES = 3
RATE = 0.3
STEP_TOKENS = 1 << 15
CHUNK_TOKENS = 1 << 14
DESCENT_BLOCK = 1 << 14
SHORT_TOKENS = 1 << 12
LOGIT_LIMIT = 40.0
BUCKETS, MOST_BUCKETS, BUCKET_TOKENS = 1 << 14, 1 << 16, 4096
CELLS, MOST_CELLS, CELL_TOKENS = 1 << 20, 1 << 22, 64


def table_size(tokens: int, per: int, least: int, most: int) -> int:
    """A power of two of about ``tokens / per``."""
    return min(most, max(least, 1 << math.ceil(math.log2(max(tokens / per, 1)))))


def mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def word_sums(words: list[bytes]) -> np.ndarray:
    """Checksums of words. A word outside the head belongs to leaf ``checksum % RESTS`` behind
    the head's (in SQL: crc32(word) % RESTS); context features mix it further."""
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


class Vocabulary:
    """Leaves, their classes and the ways to them. Bounded by the head, whatever the corpus.

    Leaves: the words of the head in the order of their endings, ``RESTS`` leaves for all
    other words, and the end token.
    """

    def __init__(self, head: dict[str, int], rest: dict[int, tuple[int, int]], docs: int, tokens: int, types: int):
        self.docs, self.tokens, self.types = docs, tokens, types
        words = sorted((w.encode("utf-8", "surrogatepass") for w in head), key=lambda w: w[::-1])
        counts = np.array([head[w.decode("utf-8", "surrogatepass")] for w in words] or np.zeros(0), dtype=float)
        self.words = pa.array(words, pa.binary())
        self.size, self.end = len(words), len(words) + RESTS
        self.hashes = mix32(word_sums(words))
        self.log_counts = np.log10(counts + SMOOTH)
        shares = [rest.get(r, (0, 0)) for r in range(RESTS)]
        totals = np.array([n + SMOOTH * (v + 1) for n, v in shares])
        self.log_rest = np.log10(totals)
        mass = np.concatenate([counts + SMOOTH, totals])
        self._cut_classes(mass)
        self._grow_trees(mass)
        self.buckets = table_size(tokens, BUCKET_TOKENS, BUCKETS, MOST_BUCKETS)
        self.cells = table_size(tokens, CELL_TOKENS, CELLS, MOST_CELLS)

    def _cut_classes(self, mass: np.ndarray) -> None:
        before = np.cumsum(mass) - mass
        klass = np.minimum((before + mass / 2) / mass.sum() * (CLASSES - 1), CLASSES - 2).astype(np.int64)
        self.classes = np.append(klass + 1, 0).astype(np.int8)
        totals = np.bincount(self.classes, weights=np.append(mass, self.docs + SMOOTH), minlength=CLASSES)
        # A class may be empty in a small vocabulary: the softmax then leaves it (almost) nothing.
        self.class_bias = np.log(np.maximum(totals, 1e-12) / totals.sum()).astype(np.float32)

    def _grow_trees(self, mass: np.ndarray) -> None:
        """Halve each range of leaves by frequency, one level at a time."""
        total = np.concatenate([[0.0], np.cumsum(mass)])
        starts = np.flatnonzero(np.diff(self.classes[:-1], prepend=-1))
        lo, hi = starts, np.append(starts[1:], len(mass))
        leaves, nodes, sides, bias, made = [], [], [], [], 0
        while True:
            wide = hi - lo > 1
            lo, hi = lo[wide], hi[wide]
            if not lo.size:
                break
            middle = np.searchsorted(total, (total[lo] + total[hi]) / 2)
            middle = np.where(total[middle] + total[middle - 1] > total[lo] + total[hi], middle - 1, middle)  # the closer cut
            middle = np.clip(middle, lo + 1, hi - 1)
            bias.append(np.log((total[hi] - total[middle]) / (total[middle] - total[lo])))
            width = hi - lo
            leaf = np.arange(width.sum()) + np.repeat(lo - (np.cumsum(width) - width), width)
            leaves.append(leaf)
            nodes.append(np.repeat(np.arange(made, made + len(lo)), width))
            sides.append(leaf >= np.repeat(middle, width))
            made += len(lo)
            lo, hi = np.ravel(np.column_stack([lo, middle])), np.ravel(np.column_stack([middle, hi]))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        leaf = join(leaves, np.int64)
        order = np.argsort(leaf, kind="stable")
        # Decisions of leaf i: way[first[i] : first[i + 1]], from the top; twice the node, plus the side.
        self.way = (join(nodes, np.int32)[order] << 1) | join(sides, bool)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=len(mass) + 1))]).astype(np.int64)
        # Salt and bias of a node lie side by side, so one look-up fetches both.
        self.nodes = np.stack([mix32(np.arange(1, made + 1, dtype=np.uint32)), join(bias, np.float32).view(np.uint32)], axis=1)

    def find(self, words: pa.Array) -> np.ndarray:
        """The leaf of each word of the head, -1 for others. A call makes a hash table of the head
        first, so ask for many words at once."""
        return pc.index_in(words.cast(pa.binary()), self.words).fill_null(-1).to_numpy()

    @property
    def log_base(self) -> float:
        return float(np.log10(self.tokens + SMOOTH * (self.types + 1)))


class Tokens:
    """Texts as arrays: ``leaf`` and ``keys`` (one column a feature) of each token, ``sizes``
    of the texts in tokens, and the words outside the head as (token, word)."""

    def __init__(self, vocabulary: Vocabulary, texts: list[list[bytes]]):
        words = pa.array([w for t in texts for w in t], pa.binary())
        self._lay(vocabulary, words, vocabulary.find(words), np.array([len(t) for t in texts], dtype=np.int64))

    @classmethod
    def of(cls, vocabulary: Vocabulary, words: pa.Array, found: np.ndarray, sizes: np.ndarray) -> Tokens:
        """From all words of some texts, where ``Vocabulary.find`` found them, and the texts' words."""
        tokens = cls.__new__(cls)
        tokens._lay(vocabulary, words, found, sizes)
        return tokens

    def _lay(self, vocabulary: Vocabulary, words: pa.Array, found: np.ndarray, sizes: np.ndarray) -> None:
        v, row = vocabulary, found.astype(np.int64)
        strange = np.flatnonzero(row < 0)
        self.outside = words.take(pa.array(strange)).cast(pa.binary()).to_pylist()
        sums = word_sums(self.outside)
        hashes = v.hashes.take(row, mode="clip") if v.size else np.zeros(len(words), np.uint32)
        hashes[strange] = mix32(sums)
        row[strange] = v.size + sums % RESTS

        text = np.repeat(np.arange(len(sizes)), sizes)
        self.sizes = sizes + 1
        self.leaf = np.full(int(self.sizes.sum()), v.end, np.int64)
        self.leaf[np.arange(len(words)) + text] = row
        self.outside_text = text[strange]
        # Three start marks before each text.
        padded = np.empty(len(words) + 3 * len(sizes), np.uint32)
        padded[np.arange(len(words)) + 3 * (text + 1)] = hashes
        base = np.cumsum(sizes + 3) - (sizes + 3)
        for k in range(3):
            padded[base + k] = 3 - k
        at = np.arange(len(self.leaf)) + 2 * np.repeat(np.arange(len(sizes)), self.sizes)
        one, two, three = padded[at + 2], padded[at + 1], padded[at]
        salt = [np.uint32(s) for s in (0x51, 0x52A3, 0x5357F1, 0x54D3B7C5)]
        self.keys = [mix32(one ^ salt[0]), mix32(mix32(two ^ salt[1]) + one), mix32(two ^ salt[2]), mix32(mix32(three ^ salt[3]) + one)]


class Model:
    """Weights over a vocabulary, with their logits and the log probability. No index is out of
    its table: ``take`` wraps because that is quicker than to check them."""

    def __init__(self, vocabulary: Vocabulary, rows: np.ndarray, cells: np.ndarray):
        self.v, self.rows, self.cells = vocabulary, rows, cells
        self.shift = np.uint32(32 - (len(cells).bit_length() - 1))
        self.mask = np.uint32(len(rows) - 1)

    @staticmethod
    def fresh(vocabulary: Vocabulary) -> Model:
        return Model(vocabulary, np.zeros((vocabulary.buckets, CLASSES), np.float32), np.zeros(vocabulary.cells, np.float32))

    def class_logits(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, rows of the features)."""
        at = np.stack([(k & self.mask).astype(np.int64) for k in keys])
        z = self.rows.take(at[0], axis=0, mode="wrap")
        for row in at[1:]:
            z += self.rows.take(row, axis=0, mode="wrap")
        z += self.v.class_bias
        np.clip(z, -LOGIT_LIMIT, LOGIT_LIMIT, out=z)
        return z, at

    def decisions(self, keys: list[np.ndarray], leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log odds, sides, cells of the features, decisions of each token) on the ways to ``leaf``."""
        first = self.v.first[leaf]
        width = self.v.first[leaf + 1] - first
        at = np.arange(int(width.sum())) + np.repeat(first - (np.cumsum(width) - width), width)
        way = self.v.way.take(at, mode="wrap")
        node = self.v.nodes.take(way >> 1, axis=0, mode="wrap")
        salt = node[:, 0].copy()
        cell = np.empty((NODE_FEATURES, len(at)), np.int64)
        odds = node[:, 1].copy().view(np.float32)
        for f in range(NODE_FEATURES):
            key = np.repeat(keys[f], width)
            key ^= salt
            key *= np.uint32(0x9E3779B1)
            key >>= self.shift
            cell[f] = key
            odds += self.cells.take(cell[f], mode="wrap")
        return np.clip(odds, -LOGIT_LIMIT, LOGIT_LIMIT, out=odds), (way & 1).astype(np.int8), cell, width

    def log_probability(self, tokens: Tokens) -> np.ndarray:
        """log10 P(leaf | context) of each token."""
        out = np.empty(len(tokens.leaf))
        for begin in range(0, len(out), CHUNK_TOKENS):
            part = slice(begin, begin + CHUNK_TOKENS)
            keys, leaf = [k[part] for k in tokens.keys], tokens.leaf[part]
            z, _ = self.class_logits(keys)
            own = z[np.arange(len(leaf)), self.v.classes[leaf]].astype(float)
            np.exp(z, out=z)
            logs = own - np.log(np.einsum("ij->i", z))
            odds, sides, _, width = self.decisions(keys, leaf)
            odds *= 1 - 2 * sides
            np.exp(odds, out=odds)
            odds += 1  # not log1p: what is lost below 1e-7 a decision is nothing, and log is quicker
            lost = np.log(odds, out=odds)
            ends = np.concatenate([[0.0], np.cumsum(lost, dtype=float)])
            stop = np.cumsum(width)
            out[part] = logs - (ends[stop] - ends[stop - width])
        return out / math.log(10)


class Descent:
    """Adaptive gradient steps from given weights; remembers the squares they divide by."""

    def __init__(self, start: Model):
        self.start = start
        self.model = Model(start.v, start.rows.copy(), start.cells.copy())
        self.row_squares = np.zeros_like(start.rows)
        self.cell_squares = np.zeros_like(start.cells)
        # Not zeros_like: np.add.at is quick only for numpy's own type object, which arrays that
        # came by pickle do not carry. One row of sums lies behind the other, as in the table.
        self.row_sums = np.zeros(start.rows.size, np.float32)
        self.cell_sums = np.zeros(start.cells.size, np.float32)

    def step(self, tokens: Tokens) -> None:
        """A step for each ``STEP_TOKENS`` and for what is left; gradients are gathered in chunks
        that fit a cache. A short step changes few weights, so it only visits those."""
        for first in range(0, len(tokens.leaf), STEP_TOKENS):
            last = min(first + STEP_TOKENS, len(tokens.leaf))
            met = []
            for begin in range(first, last, CHUNK_TOKENS):
                part = slice(begin, min(begin + CHUNK_TOKENS, last))
                keys, leaf = [k[part] for k in tokens.keys], tokens.leaf[part]
                met.append((self._gather_classes(keys, leaf, self.row_sums), self._gather_decisions(keys, leaf, self.cell_sums)))
            if last - first <= SHORT_TOKENS:
                rows, cells = (np.unique(np.concatenate([m.ravel() for m in part])) for part in zip(*met, strict=True))
                _descend_at(rows, self.model.rows, self.row_squares, self.row_sums.reshape(-1, CLASSES))
                _descend_at(cells, self.model.cells, self.cell_squares, self.cell_sums)
            else:
                _descend(self.model.rows, self.row_squares, self.row_sums)
                _descend(self.model.cells, self.cell_squares, self.cell_sums)

    def _gather_classes(self, keys: list[np.ndarray], leaf: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Add the gradients to ``sums``; the rows of the features."""
        z, at = self.model.class_logits(keys)
        np.exp(z, out=z)
        z /= np.einsum("ij->i", z)[:, None]  # quicker than sum over so short an axis
        z[np.arange(len(leaf)), self.model.v.classes[leaf]] -= 1
        # Two classes are added at once, as the parts of a complex number.
        error, pair = np.empty(z.size // 2, np.complex64), np.arange(CLASSES // 2)  # of numpy's own type, too
        error[:] = z.reshape(-1).view(np.complex64)
        pairs = sums.view(np.complex64)
        for row in at:
            place = np.repeat(row * (CLASSES // 2), CLASSES // 2).reshape(-1, CLASSES // 2)
            place += pair
            np.add.at(pairs, place.reshape(-1), error)
        return at

    def _gather_decisions(self, keys: list[np.ndarray], leaf: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Add the gradients to ``sums``; the cells of the features."""
        error, sides, cell, _ = self.model.decisions(keys, leaf)
        np.negative(error, out=error)
        np.exp(error, out=error)
        error += 1
        np.divide(1, error, out=error)
        error -= sides
        for row in cell:
            np.add.at(sums, row, error)
        return cell


def _descend_at(at: np.ndarray, weights: np.ndarray, squares: np.ndarray, sums: np.ndarray) -> None:
    """``_descend`` at the places ``at`` of the first axis alone, where all of ``sums`` is that is not 0."""
    w, q, g = (x.take(at, axis=0) for x in (weights, squares, sums))
    _descend(w, q, g.reshape(-1))
    weights[at], squares[at], sums[at] = w, q, 0


def _descend(weights: np.ndarray, squares: np.ndarray, sums: np.ndarray) -> None:
    """One adaptive step against the gradient ``sums``, in place; ``sums`` are 0 again behind it.
    Tables are walked in blocks that stay in a cache, so none of their size is made on the way."""
    weights, squares = weights.reshape(-1), squares.reshape(-1)
    held = np.empty(DESCENT_BLOCK, np.float32)
    for begin in range(0, len(sums), DESCENT_BLOCK):
        w, q, g = (x[begin : begin + DESCENT_BLOCK] for x in (weights, squares, sums))
        h = held[: len(g)]
        np.multiply(g, g, out=h)
        q += h
        np.add(q, np.float32(1), out=h)
        np.sqrt(h, out=h)
        g *= RATE
        g /= h
        w -= g
        g[:] = 0
