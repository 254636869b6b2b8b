"""Id files, prefix tries and vector codes against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parallaxis.llm import _text, idfiles, prefixes, queries, vectorcodes
from parallaxis.llm._work import fresh_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


def wanted_ids(tokenizer, rows):
    """doc_id, start, n_tokens, crc32 of rows (doc_id, text), null ids first."""
    out, start = [], 0
    done = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]
    for d, ids in sorted(done, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ids_of_all_documents(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_huffman_ids(spark, SF).collect())) == sorted(wanted_ids(tokenizer, rows))


def test_ids_through_many_files_and_blocks(spark, tokenizer, monkeypatch):
    """Files and blocks smaller than a text, texts cut into pieces, nulls, an empty table and clashing names."""
    monkeypatch.setattr(idfiles, "FILE", 4000)
    monkeypatch.setattr(idfiles, "BLOCK", 700)
    draw = random.Random(3)
    words = ["alpha", "été", "can't", "x" * 300, "　", "日本", "<|endoftext|>", "\n\n", " ", "a,b", "…", "\xa0", "\r\n", "12", "\U0001f600"]
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", "  ", "\n", "", ". "]) for _ in range(n))
    rows = [(k, text(draw.choice([0, 1, 5, 60]))) for k in range(150)] + [(200, text(4000)), (201, None), (None, "one"), (202, "")]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "tie", "row", "n", "start", "file")})
    path = fresh_path(spark, "ids")
    files = idfiles.write_ids(docs, queries.tokenizer(), path)
    got = idfiles.read_documents(files, path, with_ids=True).collect()
    want = wanted_ids(tokenizer, rows)
    assert files.count() > 2 and sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    every = [i for r in sorted(got, key=lambda r: r.start) for i in r.ids]
    assert len(every) == want[-1][1] + want[-1][2]
    for a, b in ((0, 1), (690, 720), (3500, 9000), (len(every) - 3, len(every)), (5, 5)):
        parts = sorted(idfiles.read_span(files, path, a, b).collect(), key=lambda r: r.start)
        assert [i for r in parts for i in r.ids] == every[a:b] and (not parts or parts[0].start == a)
    none = idfiles.write_ids(docs.limit(0), queries.tokenizer(), fresh_path(spark, "ids"))
    assert none.count() == 0 and idfiles.read_documents(none, path).count() == 0


def test_repeated_ids_have_places_of_their_own(spark, tokenizer):
    rows = [(7, "same"), (7, "same"), (7, "other words"), (3, "first")] * 3
    path = fresh_path(spark, "ids")
    got = sorted(map(tuple, idfiles.read_documents(idfiles.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer(), path), path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [3] * 3 + [7] * 9
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(12)]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in wanted_ids(tokenizer, rows))


def test_pieces_have_the_ids_of_the_whole(tokenizer):
    encoder = idfiles.Encoder(queries.tokenizer())

    @given(st.lists(st.sampled_from(["a", "Ab", "é", "ñ ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", ",", "'s", "'", "!?", "1", "日", "<|endoftext|>", "é", "\U0001f600", "."]), max_size=25))
    @settings(max_examples=400, deadline=None)
    def check(parts):
        texts = ["".join(parts), "", "".join(reversed(parts))]
        raw = [t.encode() for t in texts]
        ids, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    check()


def test_pieces_of_one_hash_are_noticed(monkeypatch, tokenizer):
    monkeypatch.setattr(_text.Words, "hashes", lambda self: (self.start % 3).astype(np.uint64))
    encoder = idfiles.Encoder(queries.tokenizer())
    for text in ("one two three four five", "six seven one"):
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, _ = encoder.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2000), min_size=1, max_size=60), st.integers(6, 12))
@settings(max_examples=200, deadline=None)
def test_codes_are_the_shortest_within_the_limit(counts, limit):
    """Against the optimal cost by dynamic programming over lengths, and read back after writing."""
    counts = np.array(counts)
    lengths = idfiles.code_lengths(counts, limit)
    used = np.flatnonzero(counts)
    assert (lengths[counts == 0] == 0).all() and lengths.max(initial=0) <= limit
    if len(used) < 2:
        assert (lengths[used] == 1).all()
        return
    assert (2.0 ** -lengths[used].astype(float)).sum() == 1
    weights = sorted(counts[used].tolist(), reverse=True)
    # best cost of a full tree by its levels: (leaves placed, open nodes) at each level
    states = {(0, 1): 0}
    best = None
    for _ in range(limit + 1):
        after: dict = {}
        for (placed, nodes), cost in states.items():
            for leaves in range(min(nodes, len(weights) - placed) + 1):
                now, inner = placed + leaves, nodes - leaves
                if now == len(weights) and inner == 0:
                    best = cost if best is None else min(best, cost)
                elif inner and now + 2 * inner <= len(weights):
                    key, paid = (now, 2 * inner), cost + sum(weights[now:])
                    after[key] = min(after.get(key, paid), paid)
        states = after
    assert int((lengths * counts).sum()) == best
    code = idfiles.Code(lengths)
    ids = np.random.default_rng(1).choice(used, 1000).astype(np.uint32)
    sizes = np.array([1, 127, 128, 129, 615])
    words, held, bits = code.write(ids, sizes)
    assert (idfiles.read_block(code.table(), code.width, words, bits, sizes, held) == ids).all()


def wanted_trie(rows):
    """The nodes of rows (conv_id, turn, role, text), by walking every conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda x: hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()
    turns = {c: [x[2:] for x in sorted(t, key=lambda x: (x[0], x[1], digest(x)))] for c, t in own.items()}
    made = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(turns.get(c - c % 5, [])[:h] + t[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[x] for x in children[n]) or 1
        saved[n] = (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) + sum(saved[x] for x in children[n])
    joined = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], joined(n)) for n, m in members.items()), key=repr)


def trie_of(df):
    return sorted(map(tuple, prefixes.conversation_trie(df).collect()), key=repr)


def test_trie_of_copies_nulls_and_absent_firsts(spark):
    draw = random.Random(5)
    rows = []
    for c in range(0, 60):
        if c in (10, 25):
            continue  # the first of a group is absent
        for t in range(draw.choice([1, 2, 3, 12])):
            rows.append((c, draw.choice([t, t, None]), draw.choice(["user", None]), draw.choice(["a", "bé", None, "c"])))
    rows += [r for r in rows if r[0] == 7] + [(None, 1, "user", "x"), (99, 1, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "depth", "ka", "rep", "weight", "same", "length")})
    got = trie_of(df)
    assert got == wanted_trie(rows)
    assert any(r[5] > 3 and r[6] > 0 for r in got)
    assert prefixes.conversation_trie(df.limit(0)).collect() == []
    assert trie_of(df.filter("conv_id = 99")) == wanted_trie([r for r in rows if r[0] == 99])


def test_trie_of_a_conversation_in_many_ranges(spark):
    """Conversations of thousands of turns, sorted in ranges that cut them, and many alike."""
    rows = [(c, t, "user", f"turn {t % 7}") for c in (5, 6) for t in range(1500)] + [(c, 0, "user", "hello") for c in range(100, 400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefixes.numbered_turns(df)
        assert turns.filter("conv_id = 5").select("part").distinct().count() > 2
        assert [r.i for r in turns.filter("conv_id = 5").orderBy("i").collect()] == list(range(1, 1501))
        got = trie_of(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}  # the recursion of the plain version, one chain at a time
    assert len(got) == len({r[:2] for r in got})
    want = wanted_trie(rows)
    assert got == want


def wanted_codes(rows):
    kept = [(i, np.floor(np.array(v, float) * 256).astype(np.int64).reshape(16, -1), x) for i, v, x in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    kept.sort(key=lambda r: (r[0], r[1].reshape(-1).tolist()))
    vectors = np.stack([r[1] for r in kept])
    books = vectors[:64].transpose(1, 0, 2).copy()
    for k in range(3):
        far = ((vectors[:, :, None, :] - books[None]) ** 2).sum(3)
        codes = far.argmin(2)
        if k < 2:
            for p in range(16):
                for e in range(len(books[p])):
                    own = vectors[codes[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    errors = far.min(2).sum(1)
    totals = defaultdict(int)
    for r, e in zip(kept, errors):
        totals[r[2]] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code), int(e), totals[r[2]], digest) for r, code, e in zip(kept, codes, errors)]


@pytest.mark.parametrize("n", [3, 200])
def test_vector_codes(spark, n):
    draw = np.random.default_rng(n)
    rows = [(int(k), draw.normal(0, 0.3, 32).tolist(), [None, 1, 2][k % 3]) for k in draw.permutation(n)]
    rows += [(n, None, 1), (n + 1, [None] * 32, 1), (n + 2, [float("nan")] + [0.0] * 31, 1), (n + 3, [float("inf")] + [0.0] * 31, None), *rows[:2]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("v", "code", "error", "of", "label_error")})
    coded, books = vectorcodes.compress(df)
    got = sorted(tuple(r) + (vectorcodes.books_digest(books),) for r in coded.select("vec_id", "code", "error", "label_error").collect())
    assert got == sorted(wanted_codes(rows))
    near = {r.vec_id: r.v for r in vectorcodes.decode(coded, books).collect()}
    own = {r[0]: np.floor(np.array(r[1]) * 256) for r in rows[:n]}
    errors = {r[0]: r[2] for r in got}
    assert all(((own[i] - near[i]) ** 2).sum() == errors[i] for i in own)


def test_vector_codes_of_odd_vectors(spark):
    """None, an empty table, huge components, and lengths that differ or that 16 doesn't divide."""
    schema = "vec_id long, embedding array<double>, label int"
    assert vectorcodes.compress(spark.createDataFrame([], schema))[0].count() == 0
    rows = [(1, [1e300, -1e300, 0.5], 1), (2, [0.0, 0.0, 0.0], 1), (3, [], None), (None, [0.001] * 20, None)]
    coded, books = vectorcodes.compress(spark.createDataFrame(rows, schema))
    assert books.shape == (16, 4, 2) and {r.vec_id: r.error for r in coded.collect()} == {1: 0, 2: 0, 3: 0, None: 0}


def test_a_file_of_many_blocks(tmp_path, monkeypatch):
    """Documents longer and shorter than a block, coded, written, and read whole and in part."""
    monkeypatch.setattr(idfiles, "BLOCK", 300)
    draw = np.random.default_rng(2)
    docs = [(None, [3]), *((k, draw.integers(0, 40, int(n)).tolist()) for k, n in enumerate(draw.choice([1, 5, 128, 299, 300, 301, 2000], 60)))]
    every = np.array([i for _, ids in docs for i in ids], np.uint32)
    code = idfiles.Code(idfiles.code_lengths(np.bincount(every), 8))
    with (tmp_path / "x").open("wb") as out:
        writer = idfiles._Writer(out)
        for doc_id, ids in docs:
            for number, a in enumerate(range(0, len(ids), 300)):
                part = np.array(ids[a : a + 300], np.uint32)
                words, _, bits = code.write(part, np.array([len(part)]))
                writer.add(doc_id, number, len(ids), len(part), bits.tobytes(), words.tobytes())
        writer.close()
    assert len(writer.directory) > 20 and max(n for _, _, n in writer.directory) <= 300 and writer.n_docs == len(docs)
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "x")) as f:
        blocks = list(idfiles._blocks(f, code.table(), code.width))
        assert np.array_equal(np.concatenate([ids for _, _, ids in blocks]), every)
        found = [(None if r[3] else r[0], r[1], r[2]) for _, rows, _ in blocks for r in rows.tolist()]
        sizes = [len(ids) for _, ids in docs]
        assert found == [(d, sum(sizes[:k]), sizes[k]) for k, (d, _) in enumerate(docs)]
        for low, high in ((0, 1), (299, 301), (5000, 5600), (len(every) - 1, len(every))):
            hit = list(idfiles._blocks(f, code.table(), code.width, low, high))
            assert hit[0][0] <= low and hit[-1][0] + len(hit[-1][2]) >= high and len(hit) <= (high - low) // 150 + 3
            assert np.array_equal(np.concatenate([ids for _, _, ids in hit])[low - hit[0][0] : high - hit[0][0]], every[low:high])
