"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Words are compared by their gapped three-character subsequences, so inserted
characters and varied endings cost similarity but don't hide a word. A
sentence is described by its best similarity to each landmark word, whitened
as Nyström has it; a linear machine on that is trained on sentences of labelled
documents, where a toxic document stands by its most suspicious sentence. A
document's score follows from the margins of its worst sentences and their
number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.llm import _text, _work

#: Characters that a subsequence may span, and its weight's decay for each of them.
SPAN, DECAY = 5, 0.7
#: Normalised similarity below which two words count as unlike (zero), and power of one above it. A word of six letters keeps
#: about 0.7 when a letter is inserted, dropped or swapped; chance resemblance rarely gets to the floor. Both were chosen by
#: trial, on the held-out rows of sf0.1 and by cross-validation among its training rows.
FLOOR, POWER = 0.55, 1
#: Labelled documents that the machine is fitted on, at most; chosen by a hash of doc_id.
MOST_LABELLED = 20_000
#: Suspicious word beginnings, and landmark words of them.
STEMS, LANDMARKS = 96, 80
#: Chance, over all beginnings, that one counts as suspicious by chance alone; and how many count whatever their chance.
CHANCE, FEW = 1e-4, 12
#: Bytes of text that are taken apart at once.
PIECE = 1 << 18
#: Words whose similarities a task remembers, and of these such as are like some landmark.
REMEMBERED, REMEMBERED_ALIKE = 1 << 18, 1 << 15
#: Different beginnings that a task holds at once.
MOST_GRAMS = 100_000
#: Worst sentences of a document that count.
WORST = 5
#: Characters of a word beginning.
STEM_SIZES = range(4, 13)
FOLDS = 5
SEED = 3

#: Symbols by byte: letters by themselves, digits as the letters they stand for, other bytes of UTF-8 by class; zero goes.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[[48, 49, 50, 51, 52, 53, 54, 55, 56, 57]] = _SYMBOL[[ord(c) for c in "oizeasgtbg"]]
_SYMBOL[128:192] = 28 + np.arange(64) % 34
_SYMBOL[192:] = 27
_EDGE = 62
_ENDS = np.zeros(256, bool)
_ENDS[[ord("."), ord("!"), ord("?")]] = True


@dataclass
class Tokens:
    """Words as symbols: data has an edge before and after each different word, told by its hash; ids tells which word each token is, sentence and row which sentence and text it is of."""

    symbols: np.ndarray
    word: np.ndarray
    words: int
    hash: np.ndarray
    ids: np.ndarray
    sentence: np.ndarray
    text_of: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """The words of texts. Punctuation inside words goes, and single characters that stand one after the other are one word."""
    w = _text.words(data, offsets, lower=True)
    n = len(w.start)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, np.uint8), none, 0, none.astype(np.uint64), none, none, none)
    solid = np.append(_SYMBOL[w.data] > 0, False)
    letters = np.append(0, np.cumsum(solid))
    size = letters[w.end] - letters[w.start]
    ends = _ENDS[w.data[w.end - 1]]
    new_line = np.zeros(n, bool)
    if len(data):
        line = np.append(0, np.cumsum(data == 10))
        raw = _starts(data, offsets)
        new_line[1:] = line[raw[1:]] != line[raw[:-1]]
    fresh = np.ones(n, bool)
    fresh[1:] = ends[:-1] | new_line[1:] | (w.row[1:] != w.row[:-1])
    sentence_of = np.cumsum(fresh) - 1
    lone = size == 1
    joined = np.zeros(n, bool)
    joined[1:] = lone[1:] & lone[:-1] & ~fresh[1:]
    group = np.cumsum(~joined) - 1  # tokens after joining
    keep = np.zeros(len(w.data), bool)
    keep[:] = solid[:-1]
    of = np.repeat(group, w.end - w.start + 1)[keep]
    symbols = _SYMBOL[w.data[keep]]
    groups = int(group[-1]) + 1
    length = np.bincount(of, minlength=groups)
    begin = np.cumsum(length) - length
    # different words by hash
    place = np.arange(len(of)) - begin[of]
    powers = _text._grown("word", np.uint64(0xD6E8FEB86659FD93), int(length.max(initial=1)) + 1)
    sums = np.append(np.uint64(0), np.cumsum(_text.mix(symbols.astype(np.uint64)) * powers[place]))
    hashed = _text.mix(sums[begin + length] - sums[begin]) + length.astype(np.uint64)
    kinds, first, ids = np.unique(hashed, return_index=True, return_inverse=True)
    take = length[first]
    total = take + 2
    to = np.cumsum(total) - total
    out = np.full(int(total.sum()), _EDGE, np.uint8)
    k = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    out[np.repeat(to + 1, take) + k] = symbols[np.repeat(begin[first], take) + k]
    lead = np.flatnonzero(~joined)
    sentence = sentence_of[lead]
    return Tokens(out, np.repeat(np.arange(len(first)), total), len(first), kinds, ids, sentence, w.row[np.flatnonzero(fresh)])


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin in the texts as they are."""
    solid = ~_text.SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(True, ~solid[:-1])
    return np.flatnonzero(solid & (before | edge[:-1]))


def _subsequences(symbols: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: codes of the three-symbol subsequences, their words, and their weight."""
    s = symbols.astype(np.int32)
    for last in range(2, SPAN):
        n = len(s) - last
        if n <= 0:
            return
        inside = word[:n] == word[last:]
        for middle in range(1, last):
            code = (s[:n] << 12) | (s[middle : middle + n] << 6) | s[last:]
            yield code[inside], word[:n][inside], DECAY ** (last + 1)


@dataclass
class Landmarks:
    """The kernel against a set of words, ready to use."""

    table: np.ndarray  # feature of a code, 0 where no landmark has it
    weights: np.ndarray  # feature x landmark
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes of words compared before, in order
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each its row in found, or -1
    found: np.ndarray | None = None

    @staticmethod
    def of(words: list[str]) -> Landmarks:
        t = tokens(*_text.buffers(pa.array(words, pa.string())))
        column = t.ids
        parts = list(_subsequences(t.symbols, t.word))
        codes = np.unique(np.concatenate([c for c, _, _ in parts]))
        table = np.zeros(1 << 18, np.int32)
        table[codes] = np.arange(1, len(codes) + 1)
        own = np.zeros((len(codes) + 1, t.words), np.float32)
        norm = np.zeros(t.words)
        for code, word, weight in parts:
            np.add.at(own, (table[code], word), weight)
            norm += np.bincount(word, minlength=t.words) * weight**2
        own /= np.sqrt(np.maximum(norm, 1e-12))
        return Landmarks(table, np.ascontiguousarray(own[:, column]))

    def similarity(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """As compared, with what is known of words from earlier texts, which is forgotten when it is too much."""
        if self.found is None or len(self.seen) > REMEMBERED or len(self.found) > REMEMBERED_ALIKE:
            self.seen, self.place, self.found = self.seen[:0], self.place[:0], np.zeros((0, self.weights.shape[1]), np.float32)
        at = np.searchsorted(self.seen, t.hash)
        known = np.zeros(t.words, bool)
        inside = at < len(self.seen)
        known[inside] = self.seen[at[inside]] == t.hash[inside]
        if len(new := np.flatnonzero(~known)):
            symbols = ~known[t.word]
            part = Tokens(t.symbols[symbols], (np.cumsum(~known) - 1)[t.word[symbols]], len(new), t.hash[new], t.ids[:0], t.sentence[:0], t.text_of[:0])
            alike, values = self.compared(part)
            place = np.full(len(new), -1)
            place[alike] = len(self.found) + np.arange(len(alike))
            self.found = np.concatenate([self.found, values])
            self.seen, self.place = np.insert(self.seen, at[new], t.hash[new]), np.insert(self.place, at[new], place)
            at = np.searchsorted(self.seen, t.hash)
        place = self.place[at]
        alike = np.flatnonzero(place >= 0)
        return alike, self.found[place[alike]]

    def compared(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The different words that are like some landmark, and their kernel, normalised and raised to POWER, with each.

        A word's summed best weights bound its similarity with any landmark, so
        most words are settled without a look at each.
        """
        features, owners, weights, norm, bound = [], [], [], np.zeros(t.words), np.zeros(t.words)
        best = self.weights.max(1)
        for code, word, weight in _subsequences(t.symbols, t.word):
            norm += np.bincount(word, minlength=t.words) * weight**2
            feature = self.table[code]
            some = np.flatnonzero(feature)
            features.append(feature[some])
            owners.append(word[some])
            weights.append(np.full(len(some), weight, np.float32))
            bound += np.bincount(owners[-1], best[features[-1]], t.words) * weight
        norm = np.sqrt(np.maximum(norm, 1e-12))
        maybe = bound >= FLOOR * norm
        alike, out = np.flatnonzero(maybe), np.zeros((int(maybe.sum()), self.weights.shape[1]), np.float32)
        if not len(alike):
            return alike, out
        owner = np.concatenate(owners)
        some = np.flatnonzero(maybe[owner])
        some = some[np.argsort(owner[some], kind="stable")]
        owner, feature, weight = (np.cumsum(maybe) - 1)[owner[some]], np.concatenate(features)[some], np.concatenate(weights)[some]
        for at in np.array_split(np.arange(len(owner)), max(1, len(owner) // 50_000)):
            own = owner[at]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            np.add.at(out, own[begin], np.add.reduceat(self.weights[feature[at]] * weight[at, None], begin, axis=0))
        out /= norm[alike, None]
        out[out < FLOOR] = 0
        found = out.any(1)
        return alike[found], np.minimum(out[found], 1.0) ** POWER

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best similarity to each landmark of every sentence that has any, the text each is of, and the number of sentences of each text."""
        t = tokens(data, offsets)
        counts = np.bincount(t.text_of, minlength=len(offsets) - 1)
        alike, similar = self.similarity(t) if len(t.ids) else (t.ids, None)
        if not len(alike):
            return np.zeros((0, self.weights.shape[1]), np.float32), np.zeros(0, np.int64), counts
        place = np.full(t.words, -1)
        place[alike] = np.arange(len(alike))
        at = np.flatnonzero(place[t.ids] >= 0)
        sentence = t.sentence[at]
        begin = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
        return np.maximum.reduceat(similar[place[t.ids[at]]], begin, axis=0), t.text_of[sentence[begin]], counts


def _beginnings(documents: DataFrame) -> DataFrame:
    """gram, toxic, clean: in how many labelled documents each whole word and each beginning of words stands; copies count as one.

    Copies are told by a hash of the whole text, A-Z lowered and white space as
    one space; one that some rows call toxic and some clean counts as both.
    The empty gram has the numbers of all documents.
    """
    copy = F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")), 256)
    is_toxic = F.coalesce(F.col("label") == 1, F.lit(False))
    once = documents.groupBy(copy.alias("copy")).agg(F.first("text").alias("text"), F.max(is_toxic.cast("long")).alias("toxic"), F.max((~is_toxic).cast("long")).alias("clean"))

    def part(counts: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array([c[n] for c in counts.values()], pa.int64()) for n in (0, 1))], names=["gram", "toxic", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic, clean in zip(*(c.to_pylist() for c in batch.columns)):
                grams = {""}
                for token in set((text or "").lower().split()):
                    if word := token if token.isalnum() else "".join(c for c in token if c.isalnum()):
                        grams.add(word + "$")
                        grams.update([word[:n] for n in STEM_SIZES if n <= len(word)])
                for gram in grams:
                    c = counts.setdefault(gram, [0, 0])
                    c[0] += toxic
                    c[1] += clean
                if len(counts) > MOST_GRAMS:
                    yield part(counts)
                    counts = {}
        yield part(counts)

    parts = once.select("text", "toxic", "clean").mapInArrow(run, "gram string, toxic long, clean long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_landmarks(documents: DataFrame) -> list[str]:
    """Landmark words from labelled documents (text, label): those of toxic documents with suspicious beginnings.

    A beginning's gain is the toxic documents that it stands in times its log
    odds; chance reaches a gain of x with a probability of about exp(-x). Those
    count that chance would hardly give once among all beginnings, and where
    the labels are too few for that, the FEW best that several toxic documents have.
    """
    with _work.passing(_beginnings(documents), "beginnings") as grams:
        toxic, clean = grams.filter("gram = ''").select("toxic", "clean").first()
        rate = (F.col("toxic") + 0.5) / (toxic + 1)
        base = (F.col("clean") + 0.5) / (clean + 1)
        gain = F.col("toxic") * F.log(rate / base)
        whole = F.col("gram").endswith("$")
        likely = grams.filter((rate > 4 * base) & (F.col("toxic") > 1) & (F.col("gram") != "")).withColumn("gain", gain)
        least = float(np.log(max(1, grams.filter("toxic > 0").count()) / CHANCE))
        found = likely.orderBy(F.desc("gain"), "gram").limit(STEMS * 8).collect()
        stems: list[str] = []
        for r in found:  # a beginning that another says already, or says less of, adds nothing
            gram = r.gram.removesuffix("$")
            if (r.gain >= least or len(stems) < FEW) and not any(gram.startswith(s) or s.startswith(gram) for s in stems) and len(stems) < STEMS:
                stems.append(gram)
        if not stems:
            return []
        each = max(1, LANDMARKS // len(stems))
        starts = F.lit(None).cast("string")
        for s in reversed(stems):
            starts = F.when(F.col("gram").startswith(s), s).otherwise(starts)
        words = grams.filter(whole & (F.col("toxic") > 0) & (rate > 4 * base)).withColumn("stem", starts).filter("stem is not null").withColumn("gain", gain)
        best = words.withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("gain"), "gram"))).filter(F.col("n") <= each)
        return [r.gram[:-1] for r in best.orderBy("n", F.desc("gain"), "gram").limit(LANDMARKS).collect()]


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Linear support vector machine with squared hinge loss and balanced classes, by Newton's method; the last weight is the bias."""
    z = np.column_stack([x, np.ones(len(x))])
    sign = np.where(y, 1.0, -1.0)
    weight = cost * np.where(y, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (~y).sum()))
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 1.0)
    ridge[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return float(ridge @ w**2 / 2 + weight @ np.maximum(0, 1 - sign * (z @ w)) ** 2)

    for _ in range(100):
        slack = 1 - sign * (z @ w)
        on = slack > 0
        grad = ridge * w - 2 * (z[on] * (weight * sign * slack)[on, None]).sum(0)
        step = np.linalg.solve(np.diag(ridge) + 2 * (z[on] * weight[on, None]).T @ z[on], grad)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def _suspicious(documents: DataFrame, marks: Landmarks, judge: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The sentence of each labelled document that judge finds worst: similarities and labels; a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.chunks(batch.column(0), PIECE):
                x, of, _ = marks.sentences(data, offsets)
                worst = np.zeros((b - a, x.shape[1]), np.float32)
                if len(x):
                    order = np.lexsort((-(x @ judge + bias), of))
                    texts, first = np.unique(of[order], return_index=True)
                    worst[texts] = x[order[first]]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in worst], pa.binary()), batch.column(1).slice(a, b - a).cast(pa.int32())], names=["x", "label"])

    rows = documents.select("text", "label").mapInArrow(run, "x binary, label int").collect()  # MOST_LABELLED rows at most
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64).reshape(len(rows), -1)
    return x, np.array([r.label == 1 for r in rows], bool)


@dataclass
class Machine:
    """A fitted machine: landmarks, weight of each similarity, bias, and the logistic weights of a document's features."""

    marks: Landmarks | None
    weights: np.ndarray
    bias: float
    logistic: np.ndarray

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text the margins of its worst sentences, the worst first and a neutral one where it has fewer; the log of the number of sentences; and one."""
        rows = len(offsets) - 1
        out = np.full((rows, WORST + 2), self.bias)
        out[:, WORST], out[:, WORST + 1] = 0.0, 1.0
        if self.marks is not None:
            x, of, counts = self.marks.sentences(data, offsets)
            margin = np.clip(x @ self.weights + self.bias, -4, 4)
            order = np.lexsort((-margin, of))
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            top = rank < WORST
            out[of[top], rank[top]] = margin[order][top]
            out[:, WORST] = np.log1p(counts)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.logistic, -40, 40)))


def train(documents: DataFrame, labels: DataFrame, target: str = "toxic") -> Machine:
    """A machine fitted on documents with a label, MOST_LABELLED at most. Without both labels it finds nothing toxic, or everything."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).alias("label"))
    known = _work.stored(known.orderBy(F.xxhash64("doc_id", F.lit(SEED))).limit(MOST_LABELLED), "labels")
    own = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")
    own = _work.stored(own, "labelled")
    toxic, rows = own.agg(F.count_if(F.col("label") == 1), F.count("*")).first()
    landmarks = choose_landmarks(own) if 0 < toxic < rows else []
    if not landmarks:
        return Machine(None, np.zeros(0), 0.0, np.append(np.zeros(WORST + 1), -3.0 if toxic < rows or not rows else 3.0))
    marks = Landmarks.of(landmarks)
    t = tokens(*_text.buffers(pa.array(landmarks, pa.string())))
    own_kernel = np.zeros((t.words, len(landmarks)))
    alike, similar = marks.similarity(t)
    own_kernel[alike] = similar
    own_kernel = own_kernel[t.ids]
    values, vectors = np.linalg.eigh((own_kernel + own_kernel.T) / 2)
    whiten = (vectors / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    judge = np.ones(len(landmarks))
    bias = 0.0
    for _ in range(2):  # toxic documents stand by the sentence that the machine so far finds worst
        x, y = _suspicious(own, marks, judge, bias)
        w = fit_machine(x @ whiten, y)
        judge, bias = whiten @ w[:-1], float(w[-1])
    machine = Machine(marks, judge.astype(np.float32), bias, np.zeros(WORST + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.chunks(batch.column(0), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array(list(machine.features(data, offsets)), pa.list_(pa.float64())), batch.column(1).slice(a, b - a).cast(pa.int32())], names=["x", "label"])

    fitted = own.mapInArrow(run, "x array<double>, label int").collect()  # MOST_LABELLED rows at most
    return Machine(marks, machine.weights, bias, _logistic(np.array([r.x for r in fitted]), np.array([r.label == 1 for r in fitted])))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression; the last column of x is the constant."""
    ridge, w = np.append(np.full(x.shape[1] - 1, 1.0), 1e-3), np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def in_held_out_fold(doc_id):
    """Whether a document is of the fold that trains nothing: crc32 of its id's text, by FOLDS. A null id is."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)), F.lit(0)) == 0


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents.

    Labels of held-out documents are never read. score (0 to 1) is the chance
    that the whole text is toxic, by its worst sentence; an empty or null text
    scores as one that is like no landmark. Only the text is looked at.
    Repeated rows score alike; several labels of one doc_id count by the largest.
    """
    machine = train(documents, labels.filter(~in_held_out_fold("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.chunks(batch.column(1), PIECE):
                scores = machine.scores(machine.features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", in_held_out_fold("doc_id").alias("held_out"), "score", "predicted")
