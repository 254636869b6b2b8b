"""Nulls, empty and very long texts, ties and repeated rows, empty tables, and extra columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parallaxis.llm import chat, licences, mixture, pivots, resampling, semantic, simhash, superkmers, toxicity, warc
from parallaxis.llm._work import fresh_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
LONG = " ".join(f"{WORDS[i % 16]}{i % 97}" for i in range(60_000))
ROWS = [
    (1, " ".join(WORDS), "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", len(LONG)),
    (5, " \t\n ", "en", "b", 4),
    (6, "one", "en", None, 3),
    (6, "one", "en", None, 3),
    (7, " ".join(WORDS), "en", "a", 10),
    (None, " ".join(reversed(WORDS)), "en", "c", 10),
    (8, "éè \U0001f600 under the MIT license", "fr", "c", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("score", "kept", "key", "label", "fp", "node", "size", "target", "taken", "passes", "n_words", "n_removed", "log_weight", "means", "row", "rank", "chunk", "bucket", "held_out", "copy")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (6, 0, 1), (7, None, None), (None, 1, 1), (8, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(WORDS[:14])), (2, None), (3, "two words"), (None, "one"), (4, "")], "item_id long, text string")


def test_chat(spark):
    rows = [(1, 1, "assistant", "</s>\\[INST] \né"), (1, 0, "user", None), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "tool", "<s>"), (3, None, "assistant", "y" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit(1), "prompt": F.lit("q"), "completion": F.lit("a")})
    read = lambda t: chat.read_back(chat.join_segments(chat.format_turns(chat.turns_of_table(t))))
    got = {r.conv_id: r for r in read(turns).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == len(rows[0][3])
    assert got[1].turns_sha256 == hashlib.sha256(("user\n\n" * 2 + f"assistant\n{rows[0][3]}\n").encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(rows[0][3].encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest() and got[None].n_turns == 1 and got[3].loss_chars == 100_000
    assert read(turns.limit(0)).count() == 0


def test_chat_control_strings_survive():
    from itertools import product

    pieces = ["</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "\\", "<", "/", "[", "x\n"]
    for said in map("".join, product(pieces, repeat=3)):
        escaped = said.replace("\\", "\\\\")
        for c in chat.CONTROLS:
            escaped = escaped.replace(c, f"{c[0]}\\{c[1:]}")
        text = f"<s>[INST]{escaped}[/INST]</s><s>[ROLE]{escaped}[TEXT]{escaped}</s>"
        assert list(chat.parse_turns(text)) == [("user", said), (said, said)]


def test_chat_tables_of_every_layout(spark):
    """The same two turns from tables of every layout, each told by the fingerprint of its schema."""
    plain = {"turn_rows": "conv_id long, turn int, role string, text string", "message_rows": "thread_id long, position int, author string, message string"}
    tables = {k: spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], v) for k, v in plain.items()}
    tables |= {
        "messages": spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")], "p")], "conv_id long, messages array<struct<role: string, content: string>>, prompt string"),
        "conversations": spark.createDataFrame([(1, [("human", "a"), ("gpt", "b")])], "conv_id long, conversations array<struct<from: string, value: string>>"),
        "dialog": spark.createDataFrame([(1, [("user", "a"), ("bot", "b")])], "conv_id long, dialog array<struct<speaker: string, utterance: string>>"),
        "prompt_completion": spark.createDataFrame([(1, "a", "b")], "conv_id long, prompt string, completion string"),
        "prompt_response": spark.createDataFrame([(1, "a", "b", None)], "conv_id long, prompt string, response string, system string"),
        "question_answer": spark.createDataFrame([(1, "a", "b")], "conv_id long, question string, answer string"),
        "instruction": spark.createDataFrame([(1, "a", "", "b")], "conv_id long, instruction string, input string, output string"),
    }
    assert set(tables) == {x.name for kind in chat.LAYOUTS for x in kind}
    digests = set()
    for name, df in tables.items():
        turns = chat.turns_of_table(df)
        assert {r.layout for r in turns.collect()} == {name}
        digests |= {tuple(r) for r in chat.read_back(chat.join_segments(chat.format_turns(turns))).collect()}
    assert len(digests) == 1 and digests.pop()[2] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1, "a")], "conv_id long, prompt string"))


def test_chat_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 50)
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} </s> é" * (k % 3)) for k in range(40)]
    turns = chat.turns_of_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted = chat.join_segments(chat.format_turns(turns))
    got = chat.read_back(formatted).first()
    assert formatted.count() > 5 and got.n_turns == 40
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256("".join(r[3] for r in rows if r[2] == "assistant").encode()).hexdigest()


def test_chat_layouts(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}'),
        (2, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 3}'),
        (3, '{"instruction": "do", "input": "it", "output": "done"}'),
        (4, '{"prompt": "p", "response": "r"}'),
        (5, "not json"), (6, None), (7, '{"other": 1}'), (8, "[]"), (9, '{"messages": []}'),
    ]
    got = [tuple(r) for r in chat.turns_of_records(spark.createDataFrame(records, "conv_id long, payload string")).orderBy("conv_id", "turn").collect()]
    assert [r[2:4] for r in got if r[0] == 1] == [("user", "a"), ("assistant", "")]
    assert [r[2] for r in got if r[0] == 2] == ["user", "assistant"]
    assert [r[3] for r in got if r[0] == 3] == ["do\n\nit", "done"]
    assert [r[4] for r in got if r[0] == 4] == ["prompt_response"] * 2
    assert all(r[1] is None and r[4] is None for r in got if r[0] in (5, 6, 7, 8, 9))


def test_substrings(docs, empty):
    got = superkmers.remove_repeats(docs)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == len(ROWS) and len(got.columns) == len(docs.columns)
    assert rows[7, ROWS[7][1]].n_removed == 16 and rows[7, ROWS[7][1]].kept == ""
    assert rows[1, ROWS[0][1]].n_removed == 0 and rows[1, ROWS[0][1]].kept == ROWS[0][1]
    assert rows[2, None].n_words == 0 and rows[2, None].kept == "" and rows[4, LONG].n_words == 60_000
    assert superkmers.remove_repeats(empty).count() == 0


def test_resampling(docs, empty, labels):
    got = resampling.resample(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    kept = resampling.keep_target(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got) and all(r.key is not None for r in got)
    assert sum(r.kept for r in resampling.resample(docs, labels, keep=0.5).collect()) in (5, 6)  # two rows are alike
    assert resampling.resample(empty, labels).count() == 0 and resampling.keep_target(empty, labels).count() == 0
    assert resampling.keep_target(docs, labels.limit(0)).count() == len(ROWS)


def test_licences(docs, empty, spark):
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert got[8].base_labels == "mit" and got[8].n_base == 1 and got[8].first_word == 2 and got[2].n_words == 0 and got[2].score == 0
    assert licences.scan_licences(empty).count() == 0
    tagged = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nx")], "doc_id long, text string")
    row = licences.scan_licences(tagged).first()
    assert row.labels == "apache-2,gpl,mit" and row.expressions == ["((mit or apache-2.0) and (gpl-2.0-only with classpath-exception-2.0))"]


def test_warc(spark):
    rows = [(1, "http://www.a.com/x", "p"), (2, None, "p"), (3, "bad url\r\n", None), (4, "http://b.org", ""), (None, "http://a.com/x", "q"), (5, "http://a.com/x", "q" * 300_000), (5, "http://a.com/x", "q" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("same", F.lit(2))
    path = fresh_path(spark, "warc")
    captures = warc.write_archives(pages, path)
    got = [tuple(r)[:5] for r in warc.read_ranges(warc.look_up(warc.build_index(captures, path), path, captures.select("key")), path).collect()]
    assert sorted((r[0], r[3], r[4]) for r in got if r[0]) == [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (5, "response", None)]
    assert len(got) == 7 and {r[1] for r in got} == {1, 0, 300_000}
    assert warc.write_archives(pages.limit(0), fresh_path(spark, "warc")).count() == 0
    assert warc.look_up(warc.build_index(captures, path), path, captures.select(F.lit("none").alias("key"))).count() == 0


def test_warc_look_ups_read_only_what_they_hit(spark, monkeypatch):
    """Few keys out of an index of many blocks and shards, with the blocks that weren't hit made unreadable."""
    import os
    from urllib.parse import urlparse

    monkeypatch.setattr(warc, "BLOCK", 16)
    monkeypatch.setattr(warc, "ARCHIVE", 4000)
    path = fresh_path(spark, "warc")
    rows = [(f"com,h{k // 5:03d})/", k, "f", k * 10, 10) for k in range(2000)]
    captures = spark.createDataFrame(rows, warc.CAPTURES)
    directory = warc.build_index(captures, path)
    blocks = directory.collect()
    wanted = ["com,h000)/", "com,h123)/", "com,h399)/", "none"]
    for b in blocks:
        if not any(b.first_key <= k <= b.last_key for k in wanted):
            with open(os.path.join(urlparse(path).path, b.shard), "r+b") as f:
                f.seek(b.start)
                f.write(b"\0" * b.length)
    got = sorted(tuple(r) for r in warc.look_up(directory, path, spark.createDataFrame([(k,) for k in [*wanted, None, wanted[0]]], "key string")).collect())
    assert len({b.shard for b in blocks}) > 4 and len(blocks) >= 125
    assert got == sorted(r for r in rows if r[0] in wanted)


def test_mixture(docs, empty):
    mixed = mixture.mix(docs)
    rows = mixed.collect()
    assert len(rows) == len(ROWS)
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by_source.setdefault(r.source, []).append(r)
    for own in by_source.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].target <= 2 * sum(r.size for r in own)
    assert [tuple(r) for r in mixture.mix(docs).select("doc_id", "taken").orderBy("doc_id", "taken").collect()] == [tuple(r) for r in mixed.select("doc_id", "taken").orderBy("doc_id", "taken").collect()]
    assert mixture.mix(empty).count() == 0


def test_mixture_of_many_rows_alike(spark):
    """A third of all rows are one row without an id, as many have only their text in common, and the rest are told apart by another column alone."""
    n = 400
    rows = [(None, "a b c", "s", 1, {"k": 1})] * n + [(None, f"a b {i}", "s", 1, {"k": 1}) for i in range(n)] + [(7, "a b c", "s", 1, {"k": i}) for i in range(n)] + [(None, None, "s", 1, None), (None, "s", None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Size int, extra map<string,int>")
    mixed = mixture.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "extra", "size", "source_size", "target", "taken", "passes"]
    got = mixed.collect()
    key = lambda r: repr((r[0], r[1], r[2], r[-1]))
    assert sorted(repr((r.doc_id, r.text, r.source, r.extra)) for r in got) == sorted(map(key, rows))
    for source, words in (("s", 9 * n), (None, 1)):
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {words} and sum(r.taken for r in own) == int(own[0].target + 0.5)
        assert all(r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size and sum(p.words for p in r.passes) == r.taken for r in own)
    assert "collect_list" not in mixed._jdf.queryExecution().toString()


def test_semantic(docs, empty, benchmark):
    got = {(r.doc_id, r.item_id) for r in semantic.find_matches(docs, benchmark).collect()}
    assert got == {(1, 1), (7, 1), (6, None)}
    assert semantic.keep_clean(docs, benchmark).count() == len(ROWS) - 4
    assert semantic.find_matches(empty, benchmark).count() == 0 and semantic.find_matches(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("run", [simhash.near_duplicates, simhash.near_copies])
def test_simhash(docs, empty, run):
    got = [(r.doc_id, r.component_id) for r in run(docs).collect()]
    assert len(got) == len(ROWS) and (7, 1) in got and (None, None) in got and got.count((6, 6)) == 2
    assert (3, 2) in got and (5, 2) in got and (4, 4) in got
    assert run(empty).count() == 0


def test_toxicity(docs, empty, labels):
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == len(ROWS)


def test_pivots(spark):
    v = [1.0, 0.0, 0.5]
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, None, 0), (5, v, None), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 0.0], 0), (8, [float("nan"), 1.0, 0.0], 0), (9, [2.0, 0.0, 1.0], 0), (None, v, 0), (10, [1.0, 0.01, 0.5], 0), (11, [], 0), (12, [1.0], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"unit": F.lit(1), "key": F.lit(2)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(e).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[9] == (3, 1, False) and got[10] == (3, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 11, 12)) and got[None] == (0, None, False)
    assert pivots.near_duplicates(e.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, empty, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, empty):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            assert set(corpus_pipeline.COLUMNS) <= set(now.columns), name
            now.write.parquet(f"{tmp_path}/{name}-{given.count()}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{given.count()}")
