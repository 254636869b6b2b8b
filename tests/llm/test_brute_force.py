"""Operators that SQL can't express, against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from parallaxis.llm import _text, components, licences, pivots, queries, resampling, semantic, simhash, superkmers, toxicity

SF = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_of_arrow_columns():
    import pyarrow as pa

    texts = ["a  b\tc", None, "", " x", "y ", " z\u0085 w\x1cq"]
    w = _text.words(*_text.buffers(pa.array(texts)))
    got = [[] for _ in texts]
    for a, b, r in zip(w.start, w.end, w.row):
        got[r].append(w.data[a:b].tobytes().decode())
    assert got == [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    s = _text.spans(*_text.buffers(pa.array(texts)))
    assert (s.hashes() == w.hashes()).all()


def test_components_of_paths_and_stars(spark):
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_simhash_query(spark):
    got = {r.doc_id: r for r in queries.op8_simhash(spark, SF).collect()}
    fps = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = re.findall("[^\x20\x09-\x0d]+", lowered(r.text))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        fps[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fps)
    label = {i: i for i in ids}
    for _ in ids:
        new = {i: min(label[j] for j in ids if (fps[i] ^ fps[j]).bit_count() <= 2) for i in ids}
        if new == label:
            break
        label = new
    assert {i: got[i].fingerprint for i in ids} == {i: f"{fps[i]:016x}" for i in ids}
    assert {i: got[i].component_id for i in ids} == label


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(4))])
    fps = np.unique(near)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    got = {(int(i), int(j)) for x, y in simhash.trie_links(fps, None, 2) for i, j in zip(x, y)}
    assert got == want
    a, b = fps[::2].copy(), fps[1::2].copy()
    cross = {(int(i), int(j)) for x, y in simhash.trie_links(a, b, 2) for i, j in zip(x, y)}
    assert cross == {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= 2}


def test_near_copies(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(5000)]
    texts = [[rng.choice(vocabulary) for _ in range(400)] for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k, t in enumerate(texts[:30]):
        t = list(t)
        for at in rng.sample(range(400), 4):
            t[at] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(t)))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == k for k in range(60)) and sum(got[100 + k] == k for k in range(30)) >= 29


def threshold_pairs(rng, pairs):
    """Pairs of texts around the threshold, and the Jaccard similarity of each."""
    vocabulary = [f"w{k}" for k in range(5000)]
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    rows, similar = [], {}
    for k in range(pairs):
        t = [rng.choice(vocabulary) for _ in range(400)]
        u = list(t)
        for at in rng.sample(range(400), rng.choice([7, 8, 9, 11, 12, 14])):
            u[at] = rng.choice(vocabulary)
        similar[k] = len(shingles(t) & shingles(u)) / len(shingles(t) | shingles(u))
        rows += [(k, " ".join(t)), (1000 + k, " ".join(u))]
    return rows, similar


@pytest.mark.parametrize("band", [simhash.BAND, 36])
def test_near_copies_at_the_threshold(spark, band):
    """Recall is the same with the bands of a small corpus and of one of a thousand million documents."""
    rng = random.Random(14)
    rows, similar = threshold_pairs(rng, 300)
    # a phrase repeated outvotes all else, but not as a set
    rows += [(5000 + k, " ".join(["a b c d e f g"] * 40 + [f"x{rng.randrange(5000)}" for _ in range(60)])) for k in range(2)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), band=band).collect()}
    linked = {k for k in similar if got[1000 + k] == k}
    wanted = {k for k, x in similar.items() if 0.8 <= x < 0.87}
    assert len(wanted) > 50 and sum(0.7 < x < 0.8 for x in similar.values()) > 50
    assert all(similar[k] >= 0.8 for k in linked) and len(wanted & linked) >= 0.98 * len(wanted)
    assert got[5001] == 5001


def test_bands_keep_recall_and_meetings():
    for rows in (0, 10, 10**5, 10**7, 10**9, 5 * 10**10):
        b = simhash.Bands.plan(rows, 0.8)
        met = 1 - (1 - simhash.within(b.width, simhash.BAND_BUDGET, simhash.differing(0.8))) ** b.number
        assert met >= simhash.RECALL and rows * simhash.within(b.width, simhash.BAND_BUDGET, 0.5) <= simhash.MEETINGS


@pytest.mark.parametrize("matrix, block", [(simhash.MATRIX, simhash.BLOCK), (0, 4000)])
def test_crowds_are_compared_in_full(spark, monkeypatch, matrix, block):
    """A crowd of near copies, as one group or dealt as blocks, against all pairs."""
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(17)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for _ in range(40):
        t = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3])):
            t[at] = f"e{rng.randrange(10**6)}"
        texts.append(t)
    sets = [{tuple(t[k : k + 5]) for k in range(116)} for t in texts]
    label = list(range(40))
    for _ in range(40):
        label = [min(label[j] for j in range(40) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(40)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[k] for k in range(40)] == label and 1 < len(set(label)) < 40


def test_pivot_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x = np.concatenate([x, x[:200] + 0.12 * rng.standard_normal((200, 16)), x[:40]])
    label = np.arange(len(x)) % 200 % 3
    rows = [(k, [float(c) for c in r], int(m)) for k, (r, m) in enumerate(zip(x.astype(np.float32), label))]
    got = {r.vec_id: r for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    n = linked.sum(1)
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.9 * n.sum() and n.sum() > 200


@pytest.mark.parametrize("exact", [False, True])
def test_pivot_query_against_all_pairs(spark, tmp_path, exact):
    """The given vectors, of which no two are near, and copies of some with more and less noise."""
    given, rng = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "label", "embedding"), np.random.default_rng(19)
    near = [(10**6 + k, r.label, [float(x) for x in np.array(r.embedding) + rng.choice([0.1, 0.3, 0.38]) * np.linalg.norm(r.embedding) / 8 * rng.standard_normal(len(r.embedding))]) for k, r in enumerate(given.collect()[:250] * 2)]
    given.union(spark.createDataFrame(near, given.schema)).write.parquet(f"{tmp_path}/embeddings.parquet")
    embeddings = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    run = pivots.near_duplicates(embeddings, exact=True) if exact else queries.op10_embedding_pivots(spark, str(tmp_path))
    got = {r.vec_id: r for r in run.collect()}
    rows = [r for r in embeddings.collect() if r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    u = np.array([r.embedding for r in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    label = np.array([r.label for r in rows])
    linked = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    found = np.array([got[r.vec_id].n_links for r in rows])
    assert linked.sum() > 0 and (found <= linked.sum(1)).all() and found.sum() >= 0.9 * linked.sum()
    if exact:
        assert (found == linked.sum(1)).all()
        ids = np.array([r.vec_id for r in rows])
        lowest = ids.copy()
        for _ in range(len(ids)):
            new = np.array([min(lowest[k], lowest[linked[k]].min(initial=lowest[k])) for k in range(len(ids))])
            if (new == lowest).all():
                break
            lowest = new
        assert [got[i].component_id for i in ids.tolist()] == lowest.tolist()


def test_licence_query(spark):
    got = {r.doc_id: r for r in queries.op4_licence_scan(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(r.text))
        places = [(k, label) for phrase, label in licences.BASE_PHRASES.items() for p in [phrase.split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert g.base_labels == ",".join(sorted({x for _, x in places})) and set(g.base_labels.split(",")) - {""} <= set(g.labels.split(",")) and 0 <= g.score <= 1


@pytest.mark.parametrize("text, want", [("mit", ["mit"]), ("a or b and c", ["a", "b", "c", "and", "or"]), ("(a or b) and c with e", ["a", "b", "or", "c", "e", "with", "and"]), ("(a", None), ("and a", None), ("a b", ["a"]), ("", None)])
def test_shunting_yard(text, want):
    assert licences.parse_expression(text) == want


def test_kth_largest(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in values], "key double")
    for k in (1, 2, 700, 1500, 3000):
        assert resampling.kth_largest(df, "key", k, few=50) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(df, "key", 0) is None and resampling.kth_largest(df, "key", 3001) is None


def test_resampling_separates(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = resampling.resample(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_resampling_query_equals_brute_force(spark):
    """Weights from n-grams counted one by one, and the rows of the largest noisy weights."""
    from math import asinh, exp, log

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 1))
    got = {r.doc_id: r for r in queries.op3_quality_resampling(spark, SF).collect()}
    noise = {r.doc_id: r.u for r in spark.createDataFrame([(d,) for d in docs], "doc_id long").select("doc_id", ((F.pmod(F.xxhash64("doc_id", F.lit(resampling.SEED)), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias("u")).collect()}

    def mixed(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m % 2**64
        return x ^ x >> 33

    def features(text):
        data = text.encode()
        for order in resampling.ORDERS:
            yield from ((order, mixed(int.from_bytes(data[k : k + order], "big") + order) % resampling.BUCKETS) for k in range(len(data) - order + 1))
        w = re.findall("[^\x20\x09-\x0d]+", text)
        yield from (("again", sum(1 << b - 1 for b in range(1, resampling.BACK + 1) if k >= b and w[k] == w[k - b])) for k in range(len(w)))

    own = {d: list(features(t)) for d, t in docs.items()}
    raw, target = {}, {}
    for d, fs in own.items():
        for f in fs:
            raw[f] = raw.get(f, 0) + 1
            target[f] = target.get(f, 0) + (labels.get(d) == 1)
    kinds = (*resampling.ORDERS, "again")
    sums = {k: [sum(n for f, n in c.items() if f[0] == k) + resampling.SMOOTHING * resampling.BUCKETS for c in (raw, target)] for k in kinds}
    keys = {}
    for d, fs in own.items():
        total = sum(log((target[f] + resampling.SMOOTHING) / sums[f[0]][1]) - log((raw[f] + resampling.SMOOTHING) / sums[f[0]][0]) for f in fs)
        weight = total * resampling.LENGTH / (len(fs) + resampling.LENGTH)
        assert got[d].log_weight == pytest.approx(weight, rel=1e-7, abs=1e-7)
        keys[d] = weight, log(-log(noise[d]))
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    assert all(r.accepted == (r.score >= 0.5) for r in got.values())
    for rows, k, part in (
        (got.values(), round(queries.DRAWN * len(docs)), queries.EVIDENCE / resampling.LENGTH),
        (resampling.resample(*tables).collect(), round(sum(r.score for r in got.values())), 1),
        (resampling.resample(*tables, keep=0.6).collect(), round(0.6 * len(docs)), 1),
    ):
        noisy = {d: x * part - y for d, (x, y) in keys.items()}
        last = sorted(noisy.values(), reverse=True)[k - 1]
        assert {r.doc_id for r in rows if r.kept} == {d for d, x in noisy.items() if x >= last - 1e-9}
    a, b = (asinh(got[d].log_weight) for d in list(got)[:2])
    x, y = (log(got[d].score / (1 - got[d].score)) for d in list(got)[:2])
    slope = (x - y) / (a - b)
    assert slope > 0 and all(r.score == pytest.approx(1 / (1 + exp(-(slope * asinh(r.log_weight) + x - slope * a))), abs=1e-6) for r in got.values())


def test_chance_to_be_drawn_follows_the_weight(spark):
    """Over many seeds: whether the noise decides, and against sampling one by one, each time by weight, without replacement."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = resampling.fit(docs, labels)
    weights = {r.doc_id: r.log_weight for r in model.keyed(docs.select("doc_id", "text")).collect()}
    noises = [F.pmod(F.xxhash64("doc_id", F.lit(s)), F.lit(1 << 40)).alias(f"u{s}") for s in range(200)]
    ids = list(weights)
    noise = np.array([list(r)[1:] for r in docs.select("doc_id", *noises).collect()], float)
    order = np.argsort([r.doc_id for r in docs.select("doc_id").collect()], kind="stable")
    ids.sort()
    w, u = np.array([weights[d] for d in ids]) * queries.EVIDENCE / resampling.LENGTH, (noise[order] + 0.5) / (1 << 40)
    one = {r.doc_id: r.key for r in model.keyed(docs.select("doc_id", "text"), 5, queries.EVIDENCE).collect()}
    assert np.allclose([one[d] for d in ids], w - np.log(-np.log(u[:, 5])))
    k = round(queries.DRAWN * len(ids))
    keys = w[:, None] - np.log(-np.log(u))
    drawn = keys >= np.sort(keys, axis=0)[-k]
    plain = w >= np.sort(w)[-k]
    outside = drawn[~plain].sum(0) / k
    assert outside.min() > 0.05  # of each draw, rows that plain order would not take
    rng = np.random.default_rng(1)
    urn = np.zeros(len(ids))
    for _ in range(200):
        left = np.exp(w - w.max())
        for _ in range(k):
            at = int(np.searchsorted(np.cumsum(left), rng.random() * left.sum(), "right"))
            at = min(at, len(ids) - 1)
            left[at] = 0
            urn[at] += 1
    chance = drawn.mean(1)
    assert np.abs(chance - urn / 200).mean() < 0.04 and np.corrcoef(chance, urn)[0, 1] > 0.98


def test_rows_that_tie_for_the_last_place_are_all_kept(spark):
    rows = [(k // 4, "plain words of some text " * 3) for k in range(40)] + [(None, None)] * 10
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, keep=0.5).collect()
    kept = {(r.doc_id, r.kept) for r in got}
    assert len({d for d, _ in kept}) == len(kept) and 25 <= sum(r.kept for r in got) <= 34


def test_common_subsequence():
    rng = random.Random(7)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        assert semantic.common_subsequence(a, semantic._masks(b), len(b)) == row[-1]


def bench_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def holds(text, item):
    """Whether any stretch around a word of the text has enough of the item in order: every place is tried, without a latent space or a look at words first."""
    text, item = bench_words(text), bench_words(item)
    n = len(item)
    if n < semantic.SCALES[0]:
        return n > 0 and any(text[k : k + n] == item for k in range(len(text)))
    answer = item[n - max(1, round(semantic.ANSWER * n)) :]
    masks, answer_masks = semantic._masks(item), semantic._masks(answer)
    for p in range(len(text)):
        region = [x for x in text[max(0, p - semantic.BEFORE * n) : p + semantic.AFTER * n + 1] if x in masks]
        common = semantic.common_subsequence(region, masks, n) if len(region) >= semantic.LOOSE * n else 0
        if common >= semantic.SURE * n or common >= semantic.LOOSE * n and semantic.common_subsequence(region, answer_masks, len(answer)) >= semantic.ANSWERED * len(answer):
            return True
    return False


def test_benchmark_copies_are_found(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in semantic.find_matches(docs, items).collect()}
    words = lambda t: " " + " ".join(bench_words(t)) + " "
    texts, wanted = {r.doc_id: words(r.text) for r in docs.collect()}, {r.item_id: words(r.text) for r in items.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in wanted.items() if x in t}
    assert want and want <= found and len(found - want) <= 0.1 * len(want)


def test_benchmark_query_equals_brute_force(spark):
    """The whole query on the smallest tables, every text against every item."""
    docs, items = ({r[0]: r.text for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()} for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in queries.op7_latent_decontamination(spark, SF).collect()}
    sets = {d: set(bench_words(t)) for d, t in docs.items()}
    want = {(d, i) for i, x in items.items() for own in [set(bench_words(x))] for d, t in docs.items() if len(own & sets[d]) >= 0.3 * len(own) and holds(t, x)}
    assert want and found == want


def test_cosines_choose_the_candidates(spark, monkeypatch):
    """Candidates are the windows, and all of them, whose cosine with an item's window, summed word by word, is high enough; few others are, and without candidates nothing but short items is found."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").orderBy(f"{k}_id").collect() for t, k in (("documents", "doc"), ("benchmark", "item")))
    space = semantic.latent_space(semantic.coded(spark.read.parquet(f"{SF}/documents.parquet")).cache())
    bench = [r.text for r in items]
    retriever = semantic.Retriever(bench, space)
    texts = [" ".join(["zzz"] * k + (bench[k] or "").split() + (docs[k].text or "").split()[:200]) for k in range(12)]
    w = semantic.Coded.of(*_text.buffers(pa.array(texts, pa.string())))
    got = {(int(i), int(p)): float(c) for item, place, cosine in retriever.candidates(w) for i, p, c in zip(item, place, cosine)}
    coordinates, number, tried = space.coordinates.astype(float), w.terms(), 0
    of = lambda t: semantic.Coded.of(*_text.buffers(pa.array([t], pa.string()))).terms()
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    want, close = {}, set()
    for i, t in enumerate(bench):
        words = of(t)
        length = max((x for x in semantic.SCALES if x <= len(words)), default=0)
        if not length:
            continue
        parts = [unit(coordinates[words[s : s + length]].sum(0)) for s in sorted({*range(0, len(words) - length, length), len(words) - length})]
        step = max(1, length // semantic.BLOCK // 3) * semantic.BLOCK
        for a, b in zip(w.first, w.first[1:]):
            blocks = -(-(b - a) // semantic.BLOCK)
            n = length // semantic.BLOCK
            for s in sorted({*range(0, max(0, blocks - n) * semantic.BLOCK, step), max(0, blocks - n) * semantic.BLOCK}):
                low, high = a + s, min(a + s + length, b)
                cosine = max(float(unit(coordinates[number[low:high]].sum(0)) @ p) for p in parts)
                tried += 1
                if abs(cosine - semantic.COSINE) < 1e-3:
                    close.add((i, high - 1))
                elif cosine >= semantic.COSINE:
                    want[i, high - 1] = cosine
    assert tried > 10_000 and set(want) - close <= set(got) <= set(want) | close
    assert len(got) < 0.06 * tried
    hits = {(h.row, h.item) for h in retriever.hits(w)}
    assert {(k, k) for k in range(12) if bench[k]} <= hits
    monkeypatch.setattr(semantic, "COSINE", 1.01)
    assert all(retriever.sizes[h.item] < semantic.SCALES[0] for h in retriever.hits(w))


def test_planted_paraphrases_are_found(spark):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text.split() for r in benchmark.filter("text is not null").collect()}
    items |= {10**6 + k: " ".join(w).split()[:6] for k, w in enumerate(list(items.values())[:10])}  # short ones, found word for word
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    pool = [w for r in docs.limit(200).collect() for w in (r.text or "").split()]
    rng, rows, planted = random.Random(16), [], []
    for rate in (0, 0.1, 0.2, 0.3, 0.4, 0.5):
        for i in rng.sample(sorted(items), 40) + ([] if rate else sorted(items)[-10:]):
            w = list(items[i])
            open_ = len(w) - round(semantic.ANSWER * len(w)) - 1  # the answer stays
            for at in rng.sample(range(open_), min(open_, round(rate * len(w)))):
                w[at] = rng.choice(pool)
            k = rng.randrange(len(pool) - 300)
            rows.append((10**7 + len(rows), " ".join(pool[k : k + 150] + w + pool[k + 150 : k + 300])))
            planted.append(i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in semantic.find_matches(docs.select("doc_id", "text").union(df), benchmark).filter("doc_id >= 10000000").collect()}
    clean = {r.doc_id for r in semantic.keep_clean(docs.select("doc_id", "text").union(df), benchmark).filter("doc_id >= 10000000").collect()}
    accepted = {(d, i) for (d, t), i in zip(rows, planted) if holds(t, " ".join(items[i]))}
    assert len(accepted) > 180 and len(accepted & found) >= 0.98 * len(accepted)
    assert clean == {d for d, _ in rows} - {d for d, _ in found}


def test_gapped_insults_are_alike():
    marks = toxicity.Landmarks.of(["idiot", "pathetic"])
    import pyarrow as pa

    def like(word):
        t = toxicity.tokens(*_text.buffers(pa.array([word])))
        alike, x = marks.similarity(t)
        return x.max() if len(alike) else 0.0

    assert like("idiot") == pytest.approx(1) and like("IDIOT!") == pytest.approx(1) and like("i d i o t") == pytest.approx(1) and like("1d1ot") == pytest.approx(1)
    assert min(map(like, ("idxiot", "iidiot", "idoit", "ptahetic", "patetic", "pathetqic"))) >= 0.55 and like("id.iot") == pytest.approx(1) and like("banana") == 0


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.score_toxicity(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_changed_insults_are_found(spark):
    """Held-out toxic documents that are found are still found when each insult in them is changed, and clean documents stay clean."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels.filter(~toxicity.in_held_out_fold("doc_id")))
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.in_held_out_fold("doc_id")).collect()

    def flagged(texts):
        return [bool(x) for _, _, *part in _text.chunks(pa.array(texts, pa.string()), toxicity.PIECE) for x in machine.scores(machine.features(*part)) >= 0.5]

    insult = re.compile("trash|pathetic|worthless|disgust|idiot|loser|moron|scum|clown|stupid", re.I)
    clean, toxic = ([r.text for r in rows if r.toxic == k] for k in (0, 1))
    assert sum(flagged(clean)) <= 0.01 * len(clean) and sum(flagged(toxic)) >= 0.8 * len(toxic)
    found = [t for t, f in zip(toxic, flagged(toxic)) if f and insult.search(t)]
    rng = random.Random(5)

    def insert(w):
        at = rng.randrange(1, len(w))
        return w[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[at:]

    def drop(w):
        at = rng.randrange(1, len(w) - 1)
        return w[:at] + w[at + 1 :]

    def swap(w):
        at = rng.randrange(len(w) - 1)
        return w[:at] + w[at + 1] + w[at] + w[at + 2 :]

    for change, least in ((insert, 0.8), (drop, 0.8), (swap, 0.8), (" ".join, 0.9), (".".join, 0.9)):
        changed = [insult.sub(lambda m: change(m[0]), t) for t in found]
        assert sum(flagged(changed)) >= least * len(found), change


def test_toxicity_of_few_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(scores) > 20


def test_kernel_equals_its_definition():
    """The normalised kernel of words against all three-character subsequences of theirs, listed one by one."""
    from itertools import combinations

    words = ["idiot", "idxiot", "stupid", "stupidity", "banana", "ia", "1d1ot"]
    code = {c: int(toxicity._SYMBOL[ord(c)]) for c in "abcdefghijklmnopqrstuvwxyz0123456789"}

    def features(word):
        s, out = [toxicity._EDGE, *(code[c] for c in word), toxicity._EDGE], {}
        for i, j, k in combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + toxicity.DECAY ** (k - i + 1)
        return out, sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, j, k in combinations(range(len(s)), 3) if k - i < toxicity.SPAN) ** 0.5

    marks = toxicity.Landmarks.of(words)
    for text in ("idiot", "1diot", "stxupid", "banana", "pathetic"):
        t = toxicity.tokens(*_text.buffers(pa.array([text])))
        alike, x = marks.similarity(t)
        own, norm = features(text)
        want = []
        for other in words:
            theirs, n = features(other)
            raw = sum(v * theirs.get(f, 0) for f, v in own.items()) / norm / n
            want.append(min(raw, 1.0) ** toxicity.POWER if raw >= toxicity.FLOOR else 0.0)
        assert np.allclose(x[0] if len(alike) else np.zeros(len(words)), want, atol=1e-5), text


def test_landmarks_of_texts_that_share_words(spark):
    rng = random.Random(15)
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join(["the", "of", "and", "a", *rng.sample(words, 150), *(["you", "blockhead"] if k % 4 == 0 else [])]) for k in range(200)]
    df = spark.createDataFrame([(t, int(k % 4 == 0)) for k, t in enumerate(texts)] * 2, "text string, label int")
    counts = {r.gram: (r.toxic, r.clean) for r in toxicity._beginnings(df).filter("gram in ('', 'blockhead$', 'the$')").collect()}
    assert counts == {"": (50, 150), "blockhead$": (50, 0), "the$": (50, 150)}
    assert "blockhead" in toxicity.choose_landmarks(df)


def test_sorted_windows_survive_equal_hashes(monkeypatch):
    texts = [b"a b c d", b"b c d e", b"a b c x"]
    low = np.array([5, 3, 4])
    want = superkmers.smallest(texts, low, 3)
    monkeypatch.setattr(superkmers, "_chained", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    got = superkmers.smallest(texts, low, 3)
    assert got[0].tolist() == want[0].tolist() == [4, 3, 3, 3, 4, 4] and got[1].tolist() == want[1].tolist()


def test_substrings_of_a_very_common_pair(spark, monkeypatch):
    """Buckets that are split give the same rows, against all windows."""
    rng = random.Random(18)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for d in range(30):
        w = []
        for _ in range(40):
            w += ["of", "the", *(f"w{rng.randrange(200)}" for _ in range(3))]
        if d % 3 == 0:
            at = rng.randrange(100)
            w[at:at] = passage
        rows.append((d, " ".join(w)))
    first = {}
    for d, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    want = {}
    for d, t in rows:
        w = t.split()
        gone = {k + i for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for i in range(13)}
        want[d] = " ".join(x for k, x in enumerate(w) if k not in gone)
    split = superkmers.split_buckets
    seen = []
    monkeypatch.setattr(superkmers, "split_buckets", lambda *a: seen.append(split(*a[:3], least=0)) or superkmers.Buckets(8, np.arange(0, 8, 2), 5) if not seen else None)
    got = {r.doc_id: r.kept for r in superkmers.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(len(t) for t in want.values()) < sum(len(t) for _, t in rows)
    assert seen[0].number == 8


def test_remembered_words_change_nothing(monkeypatch):
    """Similarities of words seen before, and of a memory that is full again and again, are those of a fresh machine."""
    rng = random.Random(20)
    texts = [" ".join("".join(rng.choice("idiotsabc") for _ in range(rng.randrange(3, 7))) for _ in range(40)) for _ in range(12)]
    words = ["idiot", "stupid", "basic"]
    for most in (0, 60, 1 << 18):
        monkeypatch.setattr(toxicity, "REMEMBERED", most)
        monkeypatch.setattr(toxicity, "REMEMBERED_ALIKE", max(1, most // 4))
        marks = toxicity.Landmarks.of(words)
        for text in texts:
            t = toxicity.tokens(*_text.buffers(pa.array([text])))
            got, want = marks.similarity(t), toxicity.Landmarks.of(words).compared(t)
            assert (got[0] == want[0]).all() and np.array_equal(got[1], want[1])


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on the smallest tables, each against plain Python on what the one before kept."""
    import corpus_pipeline

    docs = {0: spark.read.parquet(f"{SF}/documents.parquet")}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs[k - 1], SF).write.parquet(f"{tmp_path}/{name}")
        docs[k] = spark.read.parquet(f"{tmp_path}/{name}")
    rows = {k: {r.doc_id: r for r in d.collect()} for k, d in docs.items() if k < 5}
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    assert set(rows[1]) == {r.doc_id for r in resampling.resample(docs[0], labels).collect() if r.kept}  # whose weights and choice are tested above

    words = {d: re.findall("[^\x20\x09-\x0d]+", lowered(r.text)) for d, r in rows[1].items()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()} for d, w in words.items()}
    ids = sorted(sets)
    label = {d: d for d in ids}
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in ids:
        new = dict(label)
        for a, b in near:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert set(rows[2]) == {d for d in ids if label[d] == d} and all(rows[2][d] == rows[1][d] for d in rows[2])

    plain = {d: re.findall("[^\x20\x09-\x0d]+", r.text or "") for d, r in rows[2].items()}
    first = {}
    for d in sorted(plain):
        for k in range(len(plain[d]) - 12):
            first.setdefault(tuple(plain[d][k : k + 13]), d)
    want = {}
    for d, w in plain.items():
        gone = {k + i for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for i in range(13)}
        if not gone:
            want[d] = rows[2][d].text
        elif len(gone) < len(w):
            want[d] = " ".join(x for k, x in enumerate(w) if k not in gone)
    assert {d: r.text for d, r in rows[3].items()} == want

    texts = {d: set(bench_words(r.text)) for d, r in rows[3].items()}
    held = {d for d, r in rows[3].items() if any(len(set(bench_words(x)) & texts[d]) >= 0.3 * len(set(bench_words(x))) and holds(r.text, x) for x in items)}
    assert set(rows[4]) == set(rows[3]) - held and all(rows[4][d] == rows[3][d] for d in rows[4])

    last = docs[5].collect()
    size = {d: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for d, r in rows[4].items()}
    sources = sorted({r.source for r in rows[4].values() if r.source is not None}) + [None] * any(r.source is None for r in rows[4].values())
    held_by = {s: sum(size[d] for d, r in rows[4].items() if r.source == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(held_by.values())
    while full := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * held_by[s]}:
        target |= {s: 2.0 * held_by[s] for s in full}
        open_ -= full
        left = 1.5 * sum(held_by.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in sources:
        assert sum(r.taken for r in last if r.source == s) == pytest.approx(target[s], abs=1)
    taken = {}
    for r in last:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert all(0 < n <= 2 * size[d] for d, n in taken.items()) and all(0 <= r.position <= 1 for r in last)
