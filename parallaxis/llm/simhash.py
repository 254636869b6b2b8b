"""SimHash near duplicates by a self-join of a binary trie of fingerprints.

Pairs of trie nodes are walked together; differing bits add up, and a pair is
dropped as soon as they pass the error budget. The top of the trie is walked
once on the driver, over bounded counts by prefix; the pairs of subtrees that
are left are the groups in which tasks walk on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.llm import _text, _work
from parallaxis.llm.components import Forest, connected_components

SEED = 42
#: Bits of prefix by which fingerprints are counted, so subtrees number 2 ** TOP at most.
TOP = 12
#: Fingerprints at which a subtree is split further, where TOP allows.
SUBTREE = 4096
#: Pairs of a node pair that are compared directly instead of walking on.
DIRECT = 32
#: Node pairs that a walk holds at one level.
FRONTIER = 1 << 16
#: For near copies by similarity: fingerprints of a subtree, and pairs from which a block is compared piecemeal.
LONG_SUBTREE, PIECEWISE = 1 << 18, 1 << 18
#: Bits of a band at least, and the bits in which two may differ in it.
BAND, BAND_BUDGET = 24, 3
#: Least share of the pairs at the threshold that agree in some band.
RECALL = 0.995
#: Unrelated fingerprints that one may meet in a band; bands are widened, and so many added that RECALL holds, for more.
MEETINGS = 256
#: Standard deviations of the differing bits by which pairs may be farther than expected to be compared by their sets.
TRIED = 3.0
#: Depth to which the tries of bands are always cut, for tasks to share.
LEAST_DEPTH = 3
#: Bytes of shingle sets that meet in one task; larger groups are dealt out as pairs of blocks.
BLOCK = 8 << 20
#: Bytes up to which the sets of a group are held as a matrix of bits.
MATRIX = 64 << 20


def _shingles(data: np.ndarray, offsets: np.ndarray, shingle: int, sets: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of the word shingles of texts, the text each is of, and the number of each text; as sets, sorted and each once a text."""
    w = _text.words(data, offsets, lower=True)
    first = w.firsts()
    count = np.diff(first)
    n = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(n)])
    own = np.repeat(np.arange(w.rows), n)
    begin = np.arange(to[-1]) - to[own] + first[own]
    finish = np.where(count[own] >= shingle, begin + shingle, first[own + 1]) - 1
    text, digest = w.data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[x:y], SEED) for x, y in zip(w.start[begin].tolist(), w.end[finish].tolist())), np.uint64, len(own))
    if sets and len(own):
        order = np.lexsort((hashes, own))
        hashes, own = hashes[order], own[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1]))
        hashes, own = hashes[new], own[new]
        n = np.bincount(own, minlength=w.rows)
    return hashes, own, n


def _digests(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the shingle set of each text."""
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(some):
        out[some] = _text.mix(np.add.reduceat(_text.mix(hashes ^ np.uint64(SEED)), (np.cumsum(n) - n)[some]) + n[some].astype(np.uint64))
    return out


def fingerprints(documents: DataFrame, shingle: int = 3, size: int = 1, sets: bool = False) -> DataFrame:
    """doc_id, fp: the 64-bit SimHash of each whole text as a signed long; with a larger size also fp1, fp2, ..., by further hashes of the first.

    Words are runs outside ASCII white space with A-Z lowered; shingles of
    them, repeats included, vote with their XXH64, and a bit is set by more
    than half. A text of fewer words is one shingle; without words, or null,
    its fingerprint is zero. As sets, a shingle votes once, and a hash of the
    set is added as digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text.chunks(batch.column(1)):
                hashes, own, n = _shingles(data, offsets, shingle, sets)
                out = np.zeros((size, len(n)), np.uint64)
                some = np.flatnonzero(n)
                to = np.cumsum(n) - n
                for k in range(size if len(own) else 0):
                    bits = np.unpackbits((_text.mix(hashes + np.uint64(k)) if k else hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    votes = np.add.reduceat(bits, to[some], axis=0, dtype=np.int32)
                    out[k, some] = np.packbits(2 * votes > n[some, None], axis=1, bitorder="little").reshape(-1).view("<u8")
                columns = [*out, _digests(hashes, n)] if sets else out
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), *(pa.array(x.view(np.int64)) for x in columns)], names=["doc_id", *names])

    names = ["fp", *(f"fp{k}" for k in range(1, size)), *(["digest"] if sets else [])]
    return documents.select("doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{x} long" for x in names)]))


def shingle_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """digest, shingles: the hashes of each text's different shingles, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _text.chunks(batch.column(0)):
                hashes, _, n = _shingles(data, offsets, shingle, sets=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_digests(hashes, n).view(np.int64)), lists], names=["digest", "shingles"])

    return documents.select("text").mapInArrow(run, "digest long, shingles array<long>")


def subtrees(counts: dict[int, int], top: int = TOP, most: int = SUBTREE, least_depth: int = 0) -> list[tuple[int, int]]:
    """(depth, prefix) of the subtrees to deal out: nodes are split until they hold at most so many, or top bits are used; those above least_depth always."""
    levels: list[dict[int, int]] = [dict(counts)]
    for _ in range(top):
        up: dict[int, int] = {}
        for prefix, n in levels[-1].items():
            up[prefix >> 1] = up.get(prefix >> 1, 0) + n
        levels.append(up)
    levels.reverse()  # levels[d] counts prefixes of d bits
    out, open_ = [], [(0, 0)]
    while open_:
        depth, prefix = open_.pop()
        if (n := levels[depth].get(prefix, 0)) == 0:
            continue
        if (n <= most and depth >= least_depth) or depth == top:
            out.append((depth, prefix))
        else:
            open_ += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
    return sorted(out, key=lambda x: x[1] << (top - x[0]))


def subtree_pairs(trees: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs (i <= j) of subtrees whose common prefix bits differ by no more than the budget."""
    depth = np.array([d for d, _ in trees])
    prefix = np.array([p for _, p in trees], np.int64)
    out = []
    for i in range(len(trees)):
        common = np.minimum(depth[i], depth[i:])
        differ = (prefix[i] >> (depth[i] - common)) ^ (prefix[i:] >> (depth[i:] - common))
        out += [(i, i + int(k)) for k in np.flatnonzero(np.bitwise_count(differ) <= budget)]
    return out


def trie_links(a: np.ndarray, b: np.ndarray | None, budget: int, level: int = 0, used: int = 0, bits: int = 64, large=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted fingerprints within the budget; of a with itself (i < j) where b is None.

    Both share their first `level` bits but for `used` of them, and have none
    set after the first `bits`. Blocks of equal fingerprints of more than
    PIECEWISE pairs go to large(first, end, other first, other end), if given.
    """
    same = b is None
    other = a if same else b
    first = [np.array([x], np.int32) for x in (0, len(a), 0, len(other))] + [np.array([used], np.uint8), np.array([same])]
    todo = [(level, first)]
    while todo:  # depth first, FRONTIER node pairs at once, so that memory is bounded
        level, nodes = todo.pop()
        al, ah, bl, bh, d, own = nodes
        size = (ah - al).astype(np.int64) * (bh - bl)
        small = size <= DIRECT
        if level == bits:
            small[:] = True
            if large is not None and (size > PIECEWISE).any():
                for k in np.flatnonzero(size > PIECEWISE):
                    large(int(al[k]), int(ah[k]), int(bl[k]), int(bh[k]))
                al, ah, bl, bh, d, own, small = (x[size <= PIECEWISE] for x in (al, ah, bl, bh, d, own, small))
                size = size[size <= PIECEWISE]
        if small.any():
            work = np.flatnonzero(small)
            upto = np.cumsum(size[work])
            for part in np.split(work, np.searchsorted(upto, np.arange(PIECEWISE, upto[-1], PIECEWISE))):
                if not len(part):
                    continue
                n = size[part]
                at = np.repeat(np.arange(len(part)), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                wide = (bh[part] - bl[part])[at]
                i, j = al[part][at] + k // wide, bl[part][at] + k % wide
                fit = (np.bitwise_count(a[i] ^ other[j]) <= budget) & (~own[part][at] | (i < j))
                if fit.any():
                    yield i[fit], j[fit]
        al, ah, bl, bh, d, own = (x[~small] for x in (al, ah, bl, bh, d, own))
        if not len(al):
            continue
        keep, bit = np.uint64(64 - level), np.uint64(1) << np.uint64(63 - level)
        high = (lambda v: (v >> keep) << keep) if level else (lambda v: np.zeros(len(v), np.uint64))
        am = np.searchsorted(a, high(a[al]) | bit).astype(np.int32)
        bm = np.searchsorted(other, high(other[bl]) | bit).astype(np.int32)
        kids = [(al, am, bl, bm, d, own), (am, ah, bm, bh, d, own), (al, am, bm, bh, d + np.uint8(1), own & False)]
        cross = ~own
        kids.append(tuple(x[cross] for x in (am, ah, bl, bm, d + np.uint8(1), own)))
        nodes = [np.concatenate(x) for x in zip(*kids)]
        live = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & (nodes[4] <= budget)
        nodes = [x[live] for x in nodes]
        todo += [(level + 1, [x[at : at + FRONTIER] for x in nodes]) for at in range(0, len(nodes[0]), FRONTIER)]


@dataclass
class Walk:
    """How one trie is dealt out: its subtrees, the pairs of them to walk, and for each subtree its pairs and its side in them."""

    trees: list[tuple[int, int]]
    pairs: list[tuple[int, int]]
    place: np.ndarray
    begins: np.ndarray
    of: np.ndarray
    side: np.ndarray

    @staticmethod
    def plan(counts: dict[int, int], budget: int, most: int, least_depth: int = 0) -> Walk:
        trees = subtrees(counts, most=most, least_depth=least_depth)
        pairs = subtree_pairs(trees, budget)
        of: list[list[int]] = [[] for _ in trees]
        side: list[list[int]] = [[] for _ in trees]
        for k, (i, j) in enumerate(pairs):
            of[i].append(k)
            side[i].append(0)
            if i != j:
                of[j].append(k)
                side[j].append(1)
        flat = (np.array([y for x in z for y in x], np.int32) for z in (of, side))
        place = np.array([p << (64 - d) if d else 0 for d, p in trees], np.uint64)
        return Walk(trees, pairs, place, np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int64), *flat)

    def deal(self, fps: np.ndarray, step: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of fps, the pair of each copy, and its side."""
        tree = np.searchsorted(self.place, fps, "right") - 1
        copies = np.diff(self.begins)
        for at in range(0, len(fps), step):
            t = tree[at : at + step]
            n = copies[t]
            k = np.repeat(self.begins[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(np.arange(at, at + len(t)), n), self.of[k], self.side[k]

    def links(self, pair: int, fp: np.ndarray, cut: int, budget: int, bits: int = 64, large=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs within the budget of a pair's fingerprints, those of the first subtree (sorted) before `cut`."""
        i, j = self.pairs[pair]
        (di, pi), (dj, pj) = self.trees[i], self.trees[j]
        level = min(di, dj)
        if i == j:
            yield from trie_links(fp, None, budget, level, 0, bits, large)
        elif 0 < cut < len(fp):
            used = ((pi >> (di - level)) ^ (pj >> (dj - level))).bit_count()
            far = None if large is None else lambda a, b, c, d: large(a, b, c + cut, d + cut)
            for x, y in trie_links(fp[:cut], fp[cut:], budget, level, used, bits, far):
                yield x, y + cut


def link_fingerprints(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """src, dst: links that join the nodes of all fingerprints within the budget.

    distinct has each fingerprint (fp) once, with its node. Inside a pair of
    subtrees only links that join two trees of a forest are kept: components
    are the same, and a crowd of near fingerprints doesn't give all its pairs.
    """
    counts = {int(r[0]): int(r[1]) for r in distinct.groupBy(F.shiftrightunsigned("fp", 64 - TOP)).count().collect()}  # 2 ** TOP rows at most
    plan = Walk.plan(counts, budget, SUBTREE)
    if not plan.trees:
        return distinct.select(F.col("node").alias("src"), F.col("node").alias("dst"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for rows, pair, side in plan.deal(fps.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(side), pa.array(fps[rows]), pa.array(nodes[rows])], names=["pair", "side", "fp", "node"])

    def walk(table: pa.Table) -> pa.Table:
        pair, side, fp, node = (c.to_numpy() for c in table.columns)
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, side))
        fp, node = fp[order], node[order]
        forest = Forest(len(fp))
        for x, y in plan.links(int(pair[0]), fp, int((side == 0).sum()), budget):
            forest.add(x, y)
        ends = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.table({"src": node[ends[:, 0]], "dst": node[ends[:, 1]]})

    dealt = distinct.select("fp", "node").mapInArrow(deal, "pair int, side int, fp long, node long")
    return dealt.groupBy("pair").applyInArrow(walk, "src long, dst long")


def differing(similarity: float) -> float:
    """Chance that a bit of two fingerprints differs whose shingle sets have this Jaccard similarity (and equal sizes, which is the worst case)."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def within(bits: int, budget: int, p: float) -> float:
    """Chance that of so many bits, each differing with chance p, no more than the budget differ."""
    return sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(budget + 1))


@dataclass
class Bands:
    """How fingerprints are cut into bands: their width and number, and the differing bits of all of them at which pairs are still compared by their sets."""

    width: int
    number: int
    most: int

    @property
    def words(self) -> int:
        return -(-self.width * self.number // 64)

    @staticmethod
    def plan(rows: int, similarity: float, least: int = BAND) -> Bands:
        """Bands in which a fingerprint meets MEETINGS unrelated ones at most, and pairs of this similarity agree with a chance of RECALL, at every number of rows."""
        width = least
        while rows * within(width, BAND_BUDGET, 0.5) > MEETINGS and width < 60:
            width += 4
        p = differing(similarity)
        number = ceil(log(1 - RECALL) / log(1 - within(width, BAND_BUDGET, p)))
        bits = width * number
        return Bands(width, number, int(bits * p + TRIED * (bits * p * (1 - p)) ** 0.5))

    def of(self, fps: list[np.ndarray], k: int) -> np.ndarray:
        """The k-th band, as the leading bits of a number."""
        word, shift = divmod(k * self.width, 64)
        x = fps[word] << np.uint64(shift)
        if shift + self.width > 64:
            x = x | fps[word + 1] >> np.uint64(64 - shift)
        return x >> np.uint64(64 - self.width) << np.uint64(64 - self.width)


def candidates(distinct: DataFrame, bands: Bands) -> DataFrame:
    """src, dst: links that join the nodes of long fingerprints (fp, fp1, ...) that agree within the budget in some band and differ in no more bits than bands.most.

    Each band has a trie, walked as that of short fingerprints. A task's links
    join each node with the smallest of those that it is joined to, so that a
    crowd which many tasks find gives the same links again, not others.
    """
    names = _names(bands.words)
    width, number = bands.width, bands.number

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(bands.words)]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(number << TOP, np.int64)
        for batch in batches:
            for k in range(number):
                counts[k << TOP : (k + 1) << TOP] += np.bincount((bands.of(columns(batch), k) >> np.uint64(64 - TOP)).astype(np.int64), minlength=1 << TOP)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["prefix", "n"])

    found = distinct.select(*names).mapInArrow(prefixes, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).collect()  # bands * 2 ** TOP rows at most
    counts: list[dict[int, int]] = [{} for _ in range(number)]
    for r in found:
        counts[r.prefix >> TOP][r.prefix & ((1 << TOP) - 1)] = r.n
    plans = [Walk.plan(c, BAND_BUDGET, LONG_SUBTREE, LEAST_DEPTH) for c in counts]
    if not plans[0].trees:
        return distinct.select(F.col("node").alias("src"), F.col("node").alias("dst"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, node = columns(batch), batch.column(bands.words).to_numpy(zero_copy_only=False)
            for k in range(number):
                for rows, pair, side in plans[k].deal(bands.of(fps, k)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(pair), pa.array(side), *(pa.array(f[rows].view(np.int64)) for f in fps), pa.array(node[rows])], names=["band", "pair", "side", *names, "node"])

    def walk(table: pa.Table) -> pa.Table:
        k, pair, side = (table.column(n).to_numpy() for n in range(3))
        fps = [table.column(3 + n).to_numpy().view(np.uint64) for n in range(bands.words)]
        node = table.column("node").to_numpy()
        own = bands.of(fps, int(k[0]))
        order = np.lexsort((own, side))
        own, node, fps = own[order], node[order], [f[order] for f in fps]
        forest = Forest(len(node))

        def look(x: np.ndarray, y: np.ndarray) -> None:
            open_ = forest.label[x] != forest.label[y]
            x, y = x[open_], y[open_]
            near = sum(np.bitwise_count(f[x] ^ f[y]).astype(np.int32) for f in fps) <= bands.most
            if near.any():
                forest.add(x[near], y[near])

        def large(a: int, b: int, c: int, d: int) -> None:
            for x in range(a, b):  # pairs of one tree already need no look
                y = np.arange(max(c, x + 1) if a == c else c, d)
                y = y[forest.label[y] != forest.label[x]]
                if len(y):
                    look(np.full(len(y), x), y)

        for x, y in plans[int(k[0])].links(int(pair[0]), own, int((side == 0).sum()), BAND_BUDGET, width, large):
            look(x, y)
        src, dst = forest.stars(node)
        return pa.table({"src": src, "dst": dst})

    schema = ", ".join(["band int, pair int, side int", *(f"{x} long" for x in (*names, "node"))])
    return distinct.select(*names, "node").mapInArrow(deal, schema).groupBy("band", "pair").applyInArrow(walk, "src long, dst long")


def similar_sets(sets: list[np.ndarray], fps: np.ndarray, left: np.ndarray, right: np.ndarray, most: int, similarity: float) -> list[tuple[int, int]]:
    """Links, each with the first set of its tree, of a spanning forest of the sets whose fingerprints differ in no more than `most` bits and whose Jaccard similarity, compared in full, is enough; between left and right, or inside left where right is the same."""
    size = np.array([len(x) for x in sets])
    kinds, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    width = int(shared[-1]) // 64 + 1 if len(kinds) else 1
    forest, inner = Forest(len(sets)), right is left
    of, keep = np.repeat(np.arange(len(sets)), size), times[number] > 1
    of, at = of[keep], shared[number[keep]]
    ends = np.append(0, np.cumsum(size))
    bits = None
    if 8 * width * len(sets) <= MATRIX:
        bits = np.zeros((len(sets), width), np.uint64)
        np.bitwise_or.at(bits, (of, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    for n, i in enumerate(left.tolist()):
        y = right[n + 1 :] if inner else right
        y = y[forest.label[y] != forest.label[i]]
        y = y[np.bitwise_count(fps[y] ^ fps[i]).sum(1, dtype=np.int64) <= most]
        y = y[np.minimum(size[y], size[i]) >= similarity * np.maximum(size[y], size[i])]
        if not len(y):
            continue
        if bits is not None:
            common = np.bitwise_count(bits[y] & bits[i]).sum(1, dtype=np.int64)
        else:
            own = np.zeros(len(kinds), bool)
            own[number[ends[i] : ends[i + 1]]] = True
            inside = np.append(0, np.cumsum(own[number]))
            common = inside[ends[y + 1]] - inside[ends[y]]
        near = y[common >= similarity * (size[y] + size[i] - common)]
        if len(near):
            forest.add(np.full(len(near), i), near)
    some = np.flatnonzero(forest.label != np.arange(len(sets)))
    return list(zip(forest.label[some].tolist(), some.tolist()))


def verified(groups: DataFrame, sets: DataFrame, bands: Bands, similarity: float) -> DataFrame:
    """src, dst: links that join the nodes (digests) of each group whose shingle sets have this Jaccard similarity, compared in full.

    groups has node, group and the fingerprints; sets has node and shingles.
    Small groups share tasks; a large one is dealt out as pairs of blocks, each
    of BLOCK bytes, so that no task holds more.
    """
    names = _names(bands.words)
    rows = groups.join(sets, "node")
    sizes = rows.groupBy("group").agg(F.sum(8 * F.size("shingles").cast("long")).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    sizes = sizes.select("group", F.ceil(F.col("bytes") / BLOCK).cast("int").alias("blocks"))
    bins = max(1, int(total // BLOCK) * 2)
    placed = rows.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = F.when(F.col("blocks") > 1, F.col("group"))
    placed = placed.select("group", F.coalesce(alone, F.pmod(F.xxhash64("group"), F.lit(bins))).alias("bin"), alone.isNotNull().alias("alone"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", *names, "shingles")

    def compare(table: pa.Table) -> pa.Table:
        group, node, block, low, high = (table.column(c).to_numpy() for c in ("group", "node", "block", "low", "high"))
        fps = np.stack([table.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
        lists = table.column("shingles").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        order = np.lexsort((node, group))
        begins = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
        src, dst = [], []
        for at in np.split(order, begins[1:]):
            if len(at) < 2:
                continue
            left = np.flatnonzero(block[at] == low[at])
            right = left if low[at[0]] == high[at[0]] else np.flatnonzero(block[at] == high[at])
            for i, j in similar_sets([flat[ends[k] : ends[k + 1]] for k in at], fps[at], left, right, bands.most, similarity):
                src.append(node[at[i]])
                dst.append(node[at[j]])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return placed.groupBy("bin", "alone", "low", "high").applyInArrow(compare, "src long, dst long")


def _names(words: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words))]


def near_copies(documents: DataFrame, similarity: float = 0.8, shingle: int = 5, band: int = BAND) -> DataFrame:
    """doc_id, component_id of every row of documents: near duplicates by similarity.

    Documents are linked where the Jaccard similarity of their sets of word
    shingles is `similarity` or more. SimHashes, longer for more documents so
    that recall stays the same, give the candidates by a trie join of each
    band; these are joined into groups, and inside groups the sets themselves
    decide. Nulls, repeats and short texts are as in near_duplicates.
    """
    bands = Bands.plan(documents.count(), similarity, band)
    names = _names(bands.words)
    fps = _work.stored(fingerprints(documents, shingle, bands.words, sets=True), "simhash")
    distinct = _work.stored(fps.groupBy(*names, "digest").agg(F.min("doc_id").alias("node")).filter("node is not null"), "distinct")
    nodes = distinct.select(*names, F.col("digest").alias("node"))
    groups = connected_components(candidates(nodes, bands)).select("node", F.col("component").alias("group"))
    with _work.passing(nodes.join(groups, "node"), "groups") as groups:
        wanted = distinct.join(groups.select(F.col("node").alias("digest")), "digest", "left_semi").select(F.col("node").alias("doc_id"), "digest")
        sets = shingle_sets(documents.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), shingle).groupBy(F.col("digest").alias("node")).agg(F.first("shingles").alias("shingles"))
        with _work.passing(sets, "shingles") as sets:
            links = _work.stored(verified(groups, sets, bands, similarity), "links")
    for end in ("src", "dst"):
        links = links.join(distinct.select(F.col("digest").alias(end), F.col("node").alias(f"{end}_node")), end)
    return _grouped(fps, distinct, links.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")), ["digest"]).select("doc_id", "component_id")


def near_duplicates(documents: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of documents.

    Fingerprints within the budget of differing bits are linked; component_id
    is the smallest doc_id reachable. Texts without words have fingerprint
    zero and link as any other. Rows that share a doc_id are one node; a null
    doc_id links with nothing and has a null component_id. Other columns are
    ignored; an empty table gives an empty result.
    """
    fps = _work.stored(fingerprints(documents, shingle), "simhash")
    distinct = _work.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"), "distinct")
    out = _grouped(fps, distinct, link_fingerprints(distinct, budget), ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(fps: DataFrame, distinct: DataFrame, links: DataFrame, names: list[str]) -> DataFrame:
    """The rows of fps with component_id, the smallest doc_id reachable by the links of fingerprints and by rows of equal fingerprint or doc_id."""
    whole = F.struct(*names)
    shared = fps.groupBy("doc_id").agg(F.min(whole).alias("x"), F.max(whole).alias("y")).filter("doc_id is not null and x <> y")
    again = fps.join(shared.select("doc_id"), "doc_id").join(distinct, names).select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    found = connected_components(links.union(again))
    labelled = distinct.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component"))
    return fps.join(labelled, names, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component")))
