"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus are TF-IDF rows over hashed words. A randomised SVD
(a random sketch of the rows, then the rows in the sketch's range) gives a
latent space. Every window of every text is compared there with every window
of every benchmark item, and those of high cosine are the candidates. Those
with too few of the item's words nearby for any match go; for the rest a
longest common subsequence of words, with a look at the item's answer where
the match is loose, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.llm import _text, _work
from parallaxis.llm.licences import BREAKS

#: Buckets that words are hashed to, and directions of the randomised SVD.
TERMS, DIRECTIONS = 1 << 14, 96
#: Directions of the sketch that a passage is added to, under a random sign each.
SIGNS = 4
#: A latent direction in which the means of long documents hold this share of the energy of their passages tells languages and topics apart, not passages, and is dropped.
SHARED_ENERGY = 0.3
#: Passages from which a document counts as long.
LONG = 8
#: Words of a passage of the SVD, and of a block, by which words are summed.
PASSAGE, BLOCK = 48, 4
#: Window lengths; an item is sought with the longest that it fills, and longer items in several windows. Windows start a third of their length apart.
SCALES = (8, 12, 24, 48)
#: Least cosine of a candidate. Unrelated windows reach it once in some fifty.
COSINE = 0.25
#: Share of an item's words that a common subsequence must have: to settle it alone, and with the answer.
SURE, LOOSE = 0.75, 0.5
#: Share of an item's words, at its end, that count as its answer, and the share of those that must be there in order.
ANSWER, ANSWERED = 0.25, 0.8
#: Words of an item's length before and after the last word of a candidate window in which the match is sought.
BEFORE, AFTER = 2, 1
#: Share of an item's words, and their least number, that must be there besides its commonest, which are taken as there anywhere.
TELLING, LEAST_TELLING = 0.15, 4
#: Items whose vectors one pass holds; more items take more passes.
ITEMS = 4_000
#: Texts are projected so many bytes at a time.
PIECE = 1 << 18
#: Items of more words have their subsequences computed one by one.
_BITS = 64
_SLICE = 256
#: Blocks whose windows are compared with all items at once.
_WINDOWS = 4096


@dataclass
class Coded:
    """Words of several texts as 32-bit hashes of their lower-cased bytes, and the text each is of."""

    word: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Coded:
        w = _text.spans(data, offsets, lower=True, breaks=BREAKS)
        return Coded(w.hashes().astype(np.uint32), w.row, w.firsts())

    @staticmethod
    def read(column: pa.Array) -> Iterator[tuple[int, Coded]]:
        """The texts of a column of such words as bytes, some MB at once, each part with the number of its first text."""
        _, offsets, data = column.cast(pa.large_binary()).buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        for a, b in _text.slices(offsets, PIECE):
            first = (offsets[a : b + 1] - offsets[a]) // 4
            word = np.frombuffer(data, np.uint32, int(first[-1]), int(offsets[a])) if first[-1] else np.zeros(0, np.uint32)
            yield a, Coded(word, np.repeat(np.arange(b - a), np.diff(first)), first)

    def terms(self) -> np.ndarray:
        return (self.word & np.uint32(TERMS - 1)).astype(np.uint16)

    def blocks(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each block of so many words, and the text of each block; blocks don't cross texts."""
        inside = np.arange(len(self.row)) - self.first[self.row]
        start = np.flatnonzero(inside % length == 0)
        return start, self.row[start]


def _block_sums(table: np.ndarray, term: np.ndarray, start: np.ndarray, a: int, b: int) -> np.ndarray:
    """Sum of the table's rows over the words of each of the blocks from a to b; the table's last row is zero."""
    stop = int(start[b]) if b < len(start) else len(term)
    start = start[a:b]
    end = np.append(start[1:], stop)
    out = table[term[start]]
    for k in range(1, BLOCK):
        at = np.where(start + k < end, term[np.minimum(start + k, stop - 1)], TERMS)
        out += table[at]
    return out


def _added(parts: DataFrame, size: int, kind: type = np.float64) -> np.ndarray:
    """The sums of parts (slice, part: numbers of a kind, so many a slice) by slice, as one array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.float64(0), 0
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                key = k
                total = total + np.frombuffer(part.as_py(), kind).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.asarray(total, np.float64).tobytes()], pa.binary())], names=["slice", "part"])

    found = {r[0]: np.frombuffer(r[1]) for r in parts.groupBy("slice").applyInArrow(add, "slice int, part binary").collect()}  # as many numbers as the table of terms has
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(size)


def _slices(numbers: np.ndarray, kind: type = np.float64) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int32()), pa.array([np.ascontiguousarray(x, kind).tobytes() for x in numbers], pa.binary())], names=["slice", "part"])


def coded(documents: DataFrame) -> DataFrame:
    """doc_id, words, slice, part: the words of each text (null slice), and of all passages the sketch, in parts by slice (null words).

    The sketch has for each term the sum, under random signs, of its counts in
    the passages that are added to each of DIRECTIONS directions, and in how
    many passages it stands; last comes the number of passages. A part's
    numbers are whole and fit 32-bit floats up to 2^24.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed, standing, passages = np.zeros(TERMS * DIRECTIONS, np.int64), np.zeros(TERMS, np.int64), 0
        names = ["doc_id", "words", "slice", "part"]
        for batch in batches:
            known = batch.column(0).cast(pa.int64())
            ids = _text.mix(known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64))
            for a, b, data, offsets in _text.chunks(batch.column(1), PIECE):
                w = Coded.of(data, offsets)
                at = pa.py_buffer((4 * w.first).astype(np.int64).tobytes())
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, at, pa.py_buffer(w.word.tobytes())])
                yield pa.RecordBatch.from_arrays([known.slice(a, b - a), words.cast(pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names=names)
                if not len(w.word):
                    continue
                term = w.terms()
                start, text = w.blocks(PASSAGE)
                own = _text.mix(np.add.reduceat(w.word, start, dtype=np.uint64) + ids[a + text] + np.arange(len(start), dtype=np.uint64))  # a passage draws its signs by its words, document and place
                of = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(term))))
                passages += len(start)
                at = term.astype(np.int64) * DIRECTIONS
                for k in range(SIGNS):  # each in its own share of the directions
                    drawn = (own >> np.uint64(16 * k)) & np.uint64(0xFFFF)
                    direction = (drawn >> np.uint64(1)).astype(np.int64) % (DIRECTIONS // SIGNS) + k * (DIRECTIONS // SIGNS)
                    np.add.at(signed, at + direction[of], (1 - 2 * (drawn & np.uint64(1)).astype(np.int64))[of])
                order = np.argsort(term, kind="stable")
                t, p = term[order], of[order]
                standing += np.bincount(t[np.append(True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]))], minlength=TERMS)
        rows = np.concatenate([signed.reshape(TERMS, DIRECTIONS), standing[:, None]], axis=1).reshape(-1, _SLICE * (DIRECTIONS + 1))
        parts = _slices(np.concatenate([rows, np.full((1, rows.shape[1]), passages)]), np.float32)
        n = parts.num_rows
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *parts.columns], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, words binary, slice int, part binary")


def moments(words: DataFrame, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second moments, along the table's directions, of all passages; of those of long documents; and of their means in place of these."""
    width = table.shape[1]
    padded = np.concatenate([table, np.zeros((1, width))]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, passages, means = (np.zeros((width, width)) for _ in range(3))
        for batch in batches:
            for _, w in Coded.read(batch.column(0)):
                if not len(w.word):
                    continue
                start, text = w.blocks(BLOCK)
                place = np.arange(len(start)) - np.searchsorted(text, text)
                first = np.flatnonzero(place % (PASSAGE // BLOCK) == 0)
                term, rows = w.terms(), np.empty((len(first), width), np.float32)
                for a in range(0, len(first), _WINDOWS):  # a long text has very many blocks
                    low, high = first[a], first[a + _WINDOWS] if a + _WINDOWS < len(first) else len(start)
                    rows[a : a + _WINDOWS] = np.add.reduceat(_block_sums(padded, term, start, low, high), first[a : a + _WINDOWS] - low, axis=0)
                text = text[first]
                every += rows.T @ rows
                n = np.bincount(text, minlength=len(w.first) - 1)
                long = rows[n[text] >= LONG].astype(np.float64)
                if len(long):
                    passages += long.T @ long
                    which, first = np.unique(text[n[text] >= LONG], return_index=True)
                    total = np.add.reduceat(long, first, axis=0)
                    means += (total / n[which, None]).T @ total
        yield _slices(np.stack([every, passages, means]).reshape(3, -1))

    return tuple(_added(words.filter("slice is null").select("words").mapInArrow(run, "slice int, part binary"), 3 * width * width).reshape(3, width, width))


def _symmetric(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.eigh((x + x.T) / 2)


@dataclass
class Space:
    """Inverse frequency and whitened latent coordinates of each term; a text's vector is the sum over its words."""

    idf: np.ndarray
    coordinates: np.ndarray


def latent_space(words: DataFrame) -> Space:
    """The latent space of all passages of coded documents."""
    size = (TERMS + _SLICE) * (DIRECTIONS + 1)
    numbers = _added(words.filter("slice is not null").select("slice", "part"), size, np.float32).reshape(-1, DIRECTIONS + 1)
    signed, standing, passages = numbers[:TERMS, :DIRECTIONS], numbers[:TERMS, DIRECTIONS], numbers[-1, 0]
    idf = np.log((passages + 1) / (standing + 1))
    basis, _ = np.linalg.qr(idf[:, None] * signed)
    every, of_long, means = moments(words, idf[:, None] * basis)
    inner = of_long if np.trace(of_long) > 0 else every
    values, vectors = _symmetric(inner)
    some = values > 1e-9 * max(float(values.max()), 1e-9)
    whiten = vectors[:, some] / np.sqrt(values[some])
    shared, turned = _symmetric(whiten.T @ means @ whiten)
    keep = shared < max(SHARED_ENERGY, float(np.quantile(shared, 0.25)) + 1e-12) if len(shared) else np.zeros(0, bool)
    return Space(np.maximum(idf, 1e-3).astype(np.float32), (idf[:, None] * (basis @ whiten @ turned[:, keep])).astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def common_subsequence(left: list[int], right: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence of left with the sequence of `size` whose words' places are the bits of right."""
    every = (1 << size) - 1
    state = every
    for word in left:
        if mask := right.get(word):
            hit = state & mask
            state = ((state + hit) | (state - hit)) & every
    return size - state.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << k
    return out


@dataclass
class Hit:
    row: int
    item: int
    cosine: float
    common: int
    answered: bool
    first_word: int


class Retriever:
    """Benchmark items ready to be sought in texts. Items of fewer words than the least window are sought word for word; empty ones not at all."""

    def __init__(self, texts: list[str | None], space: Space):
        self.space = np.concatenate([space.coordinates, np.zeros((1, space.coordinates.shape[1]), np.float32)])
        w = Coded.of(*_text.buffers(pa.array(texts, pa.string())))
        first, terms = w.first, w.terms()
        self.vocabulary, number = np.unique(w.word, return_inverse=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.vocabulary & np.uint32((1 << 20) - 1)] = True
        self.words = [number[a:b].tolist() for a, b in zip(first, first[1:])]
        self.sizes = np.diff(first)
        self.masks = [_masks(x) for x in self.words]
        self.answers = [x[len(x) - max(1, round(ANSWER * len(x))) :] for x in self.words]
        self.answer_masks = [_masks(x) for x in self.answers]
        pairs = [(i * len(self.vocabulary) + v, m) for i, x in enumerate(self.masks) if len(self.words[i]) <= _BITS for v, m in sorted(x.items())]
        self.pair, self.pair_mask = np.array([k for k, _ in pairs], np.int64), np.array([m for _, m in pairs], np.uint64)
        self._tell(space.idf[terms], number, first)
        self.vectors = {}
        for k, length in enumerate(SCALES):
            longer = SCALES[k + 1] if k + 1 < len(SCALES) else 1 << 60
            vectors, of = [], []
            for i in np.flatnonzero((self.sizes >= length) & (self.sizes < longer)):
                a, b = first[i], first[i + 1]
                for s in sorted({*range(a, b - length, length), b - length}):
                    vectors.append(self.space[terms[s : s + length]].sum(0))
                    of.append(i)
            if of:
                self.vectors[length] = _unit(np.array(vectors)), np.array(of)

    def _tell(self, idf: np.ndarray, number: np.ndarray, first: np.ndarray) -> None:
        """For each item its telling words: all but its commonest, and how many of them (by their repeats) any match must have.

        A match has at least LOOSE of the item's words. Of these no more can be
        among its commonest words than those are, so the rest is among the
        telling ones: no match is lost.
        """
        word, item, weight, need = [], [], [], np.zeros(len(self.words), np.int64)
        for i, (a, b) in enumerate(zip(first, first[1:])):
            size = int(b - a)
            if size < SCALES[0]:
                if size:  # word for word: its rarest word tells
                    word.append(int(number[a + np.argmax(idf[a:b])]))
                    item.append(i)
                    weight.append(1)
                need[i] = 1
                continue
            least = int(np.ceil(LOOSE * size))
            spare = max(0, least - max(LEAST_TELLING, int(np.ceil(TELLING * size))))
            own, at, n = np.unique(number[a:b], return_index=True, return_counts=True)
            passed = 0
            for k in np.argsort(idf[a:b][at], kind="stable"):
                if passed + n[k] <= spare:
                    passed += int(n[k])
                    continue
                spare = passed  # from here on, words tell
                word.append(int(own[k]))
                item.append(i)
                weight.append(int(n[k]))
            need[i] = least - passed
        order = np.argsort(np.array(word, np.int64), kind="stable")
        self.item_of, self.weight_of = np.array(item, np.int32)[order], np.array(weight, np.int64)[order]
        self.lists = np.searchsorted(np.array(word, np.int64)[order], np.arange(len(self.vocabulary) + 1))
        self.need = need

    def _telling(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place, weight) of all telling words in the texts, by item and place."""
        known = np.flatnonzero(number >= 0)
        many = np.diff(self.lists)[number[known]]
        at = np.repeat(known, many)
        k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.lists[number[known]], many)
        item, weight = self.item_of[k], self.weight_of[k]
        order = np.argsort(item.astype(np.int16) if len(self.words) < 1 << 15 else item, kind="stable")
        return item[order].astype(np.int64), at[order], weight[order]

    def candidates(self, w: Coded) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place, cosine) of the windows of the texts whose cosine with a window of an item is COSINE at least; place is the window's last word. All windows are compared with all items."""
        start, text = w.blocks(BLOCK)
        begins = np.searchsorted(text, np.arange(len(w.first)))
        inside = np.arange(len(start)) - begins[text]
        left = begins[text + 1] - np.arange(len(start))
        last, term = np.append(start, len(w.word)), w.terms()
        for a in range(0, len(start), _WINDOWS):  # a long text has very many blocks
            b = min(a + _WINDOWS, len(start))
            some = min(b + SCALES[-1] // BLOCK, len(start))
            sums = np.zeros((some - a + 1, self.space.shape[1]), np.float32)
            np.cumsum(_block_sums(self.space, term, start, a, some), axis=0, out=sums[1:])
            for length, (vectors, of) in self.vectors.items():
                n = length // BLOCK
                step = max(1, n // 3)
                x = a + np.flatnonzero(((inside[a:b] % step == 0) & (left[a:b] > n)) | (left[a:b] == n) | ((left[a:b] < n) & (inside[a:b] == 0)))  # the last window ends with the text
                upto = np.minimum(x + n, begins[text[x] + 1])
                cosines = vectors @ _unit(sums[upto - a] - sums[x - a]).T if self.space.shape[1] else np.ones((len(vectors), len(x)), np.float32)  # where the corpus gives no direction, nothing tells windows apart
                flat = np.flatnonzero(cosines.ravel() >= COSINE)
                if len(flat):
                    vector, window = flat // len(x), flat % len(x)
                    yield of[vector], last[upto[window]] - 1, cosines.ravel()[flat]

    def _near(self, w: Coded, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word, and the one after the last, of what lies BEFORE and AFTER these places in their texts."""
        size, row = self.sizes[item], w.row[place]
        return np.maximum(place - BEFORE * size, w.first[row]), np.minimum(place + AFTER * size + 1, w.first[row + 1])

    def hits(self, w: Coded) -> list[Hit]:
        """Best accepted match of each (text, item)."""
        if not len(w.word) or not len(self.vocabulary):
            return []
        number = np.full(len(w.word), -1, np.int32)
        maybe = np.flatnonzero(self.maybe[w.word & np.uint32((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.vocabulary, w.word[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == w.word[maybe]
        number[maybe[same]] = at[same]
        first = w.first
        item, place, weight = self._telling(number)
        short = self.sizes[item] < SCALES[0]
        found_by: list[tuple[np.ndarray, ...]] = [(item[short], place[short], np.ones(int(short.sum()), np.float32))]
        key, upto = item * (len(number) + 1) + place, np.append(0, np.cumsum(weight))
        for own, at, cosine in self.candidates(w):
            low, high = self._near(w, own, at)
            there = upto[np.searchsorted(key, own * (len(number) + 1) + high)] - upto[np.searchsorted(key, own * (len(number) + 1) + low)]
            some = there >= self.need[own]
            found_by.append((own[some], at[some], cosine[some]))
        item, place, cosines = (np.concatenate(x) for x in zip(*found_by))
        long = self._long_enough(number, w, item, place)
        found: dict[tuple[int, int], Hit] = {}
        for i, p, cosine in zip(item[long].tolist(), place[long].tolist(), cosines[long].tolist()):
            row = int(w.row[p])
            best = found.get((row, i))
            if best is not None and best.common == self.sizes[i]:
                continue
            hit = self._word_for_word(number, first, row, i, p) if self.sizes[i] < SCALES[0] else self._subsequence(number, first, row, i, p, cosine)
            if hit and (best is None or (hit.common, hit.cosine) > (best.common, best.cosine)):
                found[row, i] = hit
        return [found[k] for k in sorted(found)]

    def _long_enough(self, number: np.ndarray, w: Coded, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which places have a common subsequence of LOOSE of the item near them. All are advanced together, a word at a time; items too long for that, or sought word for word, are left in."""
        size = self.sizes[item]
        out = np.ones(len(item), bool)
        some = np.flatnonzero((size >= SCALES[0]) & (size <= _BITS))
        if not len(some):
            return np.flatnonzero(out)
        size = size[some]
        low, high = self._near(w, item[some], place[some])
        many = high - low
        own = np.repeat(np.arange(len(some)), many)
        at = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        known = np.flatnonzero(number[at] >= 0)
        key = item[some][own[known]] * len(self.vocabulary) + number[at[known]]
        k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[k] == key
        own, mask = own[known[hit]], self.pair_mask[k[hit]]
        many = np.bincount(own, minlength=len(some))
        begin = np.cumsum(many) - many
        order = np.argsort(-many, kind="stable")  # the longest first, so that those still open are a prefix
        every = np.where(size < 64, (np.uint64(1) << size.astype(np.uint64) % np.uint64(64)) - np.uint64(1), ~np.uint64(0))
        state = every[order].copy()
        open_ = np.searchsorted(-many[order], -np.arange(int(many.max(initial=0))), "left")
        for t, n in enumerate(open_.tolist()):
            x = state[:n]
            y = x & mask[begin[order[:n]] + t]
            state[:n] = (x + y) | (x - y)
        common = np.empty(len(some), np.int64)
        common[order] = size[order] - np.bitwise_count(state & every[order])
        out[some] = common >= LOOSE * size
        return np.flatnonzero(out)

    def _word_for_word(self, number: np.ndarray, first: np.ndarray, row: int, item: int, place: int) -> Hit | None:
        words = self.words[item]
        for k, x in enumerate(words):
            at = place - k
            if x == number[place] and at >= first[row] and at + len(words) <= first[row + 1] and number[at : at + len(words)].tolist() == words:
                return Hit(row, item, 1.0, len(words), True, at - int(first[row]))
        return None

    def _subsequence(self, number: np.ndarray, first: np.ndarray, row: int, item: int, place: int, cosine: float) -> Hit | None:
        size, mask = int(self.sizes[item]), self.masks[item]
        low, high = max(place - BEFORE * size, int(first[row])), min(place + AFTER * size + 1, int(first[row + 1]))
        own = [(k, v) for k, v in enumerate(number[low:high].tolist()) if v in mask]
        if sum(mask[v].bit_count() for v in {v for _, v in own}) < LOOSE * size:  # no common subsequence can be long enough
            return None
        region = [v for _, v in own]
        common = common_subsequence(region, mask, size)
        if common < LOOSE * size:
            return None
        answer = len(self.answers[item])
        answered = common_subsequence(region, self.answer_masks[item], answer) >= ANSWERED * answer
        if common < SURE * size and not answered:
            return None
        return Hit(row, item, cosine, common, answered, low - int(first[row]) + own[0][0])


MATCHES = "doc_id long, item_id long, n_words long, common_words long, overlap double, cosine double, answered boolean, first_word long"


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """The items, so many at a time, in the order of item_id."""
    rows = benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    block: list = []
    for r in rows:
        block.append((r[0], r[1]))
        if len(block) == ITEMS:
            yield block
            block = []
    if block:
        yield block


def find_matches(documents: DataFrame, benchmark: DataFrame, space: Space | None = None) -> DataFrame:
    """One row for each document and benchmark item that it holds, as copied or paraphrased text.

    All windows of whole texts are compared with all items, and a match is
    sought where their cosine is COSINE at least. Null texts have no
    words; items without words match nothing, and items of a few words only
    word for word. Repeated rows give one match by doc_id, the best (of matches
    that tie, the first in the text); rows of null doc_id are as one document,
    and items of null item_id as one item. Other columns are ignored, and an
    empty table of either gives no rows.
    """
    words = _work.stored(coded(documents), "words")
    space = latent_space(words) if space is None else space
    parts = []
    for block in _blocks(benchmark):
        ids, texts = zip(*block)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            retriever = Retriever(list(texts), space)
            for batch in batches:
                own = batch.column(0).to_pylist()
                for a, w in Coded.read(batch.column(1)):
                    rows = [(own[a + h.row], ids[h.item], len(retriever.words[h.item]), h.common, h.common / len(retriever.words[h.item]), h.cosine, h.answered, h.first_word) for h in retriever.hits(w)]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names=[x.split()[0] for x in MATCHES.split(", ")])

        parts.append(words.filter("slice is null").select("doc_id", "words").mapInArrow(run, MATCHES))
    if not parts:
        return documents.sparkSession.createDataFrame([], MATCHES)
    matches = parts[0]
    for p in parts[1:]:
        matches = matches.union(p)
    best = F.max_by(F.struct("n_words", "common_words", "overlap", "cosine", "answered", "first_word"), F.struct("common_words", "cosine", -F.col("first_word"))).alias("m")
    return matches.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the rows that hold a benchmark item, as find_matches has it; no text is shuffled."""
    with _work.passing(coded(documents), "words") as words:
        space = latent_space(words)
    for block in _blocks(benchmark):
        texts = [t for _, t in block]

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            retriever = Retriever(texts, space)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in _text.chunks(batch.column("text"), PIECE):
                    clean[[a + h.row for h in retriever.hits(Coded.of(data, offsets))]] = False
                yield batch.filter(pa.array(clean))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
