"""The prefix trie of conversations, by collapsing whole sequences.

Conversations of equal turns are one sequence with a weight and the list of
those that end there. Sequences that are proper prefixes of others are no
leaves: an anti-join takes them out. Every prefix of every sequence, weighted,
is added up to nodes. A prefix is told by its depth and by 128 bits that its
turns' digests and positions make together, so no text is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxis.llm import _work

#: Conversations that share the beginning of the first of them, and the most turns shared, less one.
GROUP, MOST = 5, 9
KEY = ("depth", "ka", "kb")
EMPTY = hashlib.sha256(b"").hexdigest()


def _carried(rows: DataFrame, total: Column, combine, name: str) -> DataFrame:
    """conv_id, part, and what the parts of a conversation before this one come to. Ranges follow one another, so there is one row for a range at most."""
    sums = rows.groupBy("conv_id", "part").agg(total.alias("own"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("conv_id", "part", combine(F.col("own")).over(before).alias(name)).filter(F.col(name).isNotNull())


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, i, same, bytes of every turn: its number in its conversation from 1, a digest of role and text, and the text's bytes in UTF-8.

    Turns go by turn (null first), ties by the digest; a null role or text is
    empty; rows alike are a turn each. Rows without a conv_id belong to no
    conversation and are left out. Turns are sorted in ranges, so a
    conversation of very many of them is many tasks' work; part is the range.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    same = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", same.alias("same"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = ("conv_id", "turn", "same", "row")
    turns = _work.stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()).drop("turn", "row"), "turns")
    turns = turns.withColumn("part", F.shiftright("number", 33))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("number"))
    carried = _carried(turns, F.count("*"), F.sum, "before")
    out = turns.withColumn("inside", inside).join(F.broadcast(carried), ["conv_id", "part"], "left")
    return out.select("conv_id", "part", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("i"), "same", "bytes")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the beginning of the first of their group in the place of their own: (rows, conversations).

    A conversation c takes the first h turns of c - c % GROUP (all if it has
    fewer, none if it has none), with h the crc32 of its decimal modulo MOST,
    and then its own turns after its first h. rows: conv_id, part, depth, same,
    bytes; conversations: conv_id, length (0 where nothing is left).
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("part").alias("first_part"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h)
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = convs.withColumn("used", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "used", "first_part", (F.col("used") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = _work.stored(convs, "conversations")
    heads = turns.filter(F.col("i") < MOST).select(F.col("conv_id").alias("base"), "i", "same", "bytes")
    heads = heads.join(convs, "base").filter("i <= used").select("conv_id", F.col("first_part").alias("part"), F.col("i").alias("depth"), "same", "bytes")
    own = turns.join(convs.select("conv_id", "h", "used"), "conv_id").filter("i > h")
    own = own.select("conv_id", "part", (F.col("used") + F.col("i") - F.col("h")).alias("depth"), "same", "bytes")
    return heads.unionByName(own), convs.select("conv_id", "length")


def with_keys(rows: DataFrame) -> DataFrame:
    """rows with the key of the prefix that ends there (depth, ka, kb) and of the one before it (pa, pb)."""
    rows = rows.select("conv_id", "part", "depth", "bytes", *(F.xxhash64("depth", "same", F.lit(k)).alias(n) for k, n in enumerate(("a", "b"))))
    own = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows
    for n in "ab":
        carried = _carried(rows, F.bit_xor(n), F.bit_xor, "before_" + n)
        out = out.withColumn("k" + n, F.bit_xor(n).over(own)).join(F.broadcast(carried), ["conv_id", "part"], "left")
        out = out.withColumn("k" + n, F.col("k" + n).bitwiseXOR(F.coalesce("before_" + n, F.lit(0)))).drop("before_" + n)
    return out.select("conv_id", *KEY, *(F.col("k" + n).bitwiseXOR(F.col(n)).alias("p" + n) for n in "ab"), "bytes")


def end_lists(ended: DataFrame) -> DataFrame:
    """rep, ends_sha256 of each sequence: of the conv_ids (decimal, ascending, comma-joined) that end there.

    Lists of one are digested in the row. The ids of others stream through a
    task in order: it holds one digest, however long the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if r != rep:
                    if rep is not None:
                        done.append((rep, digest.hexdigest()))
                    rep, digest = r, hashlib.sha256(str(c).encode())
                else:
                    digest.update(b",%d" % c)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["rep", "ends_sha256"])
        if rep is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep]), pa.array([digest.hexdigest()])], names=["rep", "ends_sha256"])

    alone = ended.filter("weight = 1").select("rep", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = ended.filter("weight > 1").select("rep", "conv_id").repartition("rep").sortWithinPartitions("rep", "conv_id").mapInArrow(run, "rep long, ends_sha256 string")
    return alone.unionByName(many)


def prefix_nodes(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each distinct prefix; the root has depth 0.

    rows: conv_id, part (rows of a conversation in the order of depth fall into
    few parts), depth (1 to its length), same (what the turn is told by),
    bytes. conversations: conv_id, length.

    A node belongs to its smallest member. The nodes of one member are the end
    of its sequence, so what is saved below a node is what is saved along its
    own member's sequence from there on, and all that is saved on the nodes of
    each other sequence that goes through it: two sums, whatever the depth.
    No conversations give no nodes.
    """
    keyed = _work.stored(with_keys(rows), "keyed")
    full = keyed.join(conversations, "conv_id").filter("depth = length").select("conv_id", *KEY)
    zero = F.lit(0).cast("long")
    full = full.unionByName(conversations.filter("length = 0").select("conv_id", *(zero.alias(k) for k in KEY)))
    sequences = _work.stored(full.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "sequences")
    ends = end_lists(full.join(sequences, [*KEY]).select("rep", "conv_id", "weight"))
    ends = sequences.join(ends, "rep").select(*KEY, F.col("ends_sha256"))

    reps = sequences.select(F.col("rep").alias("conv_id"), "weight", F.col("depth").alias("length"))
    prefixes = keyed.join(reps, "conv_id")
    proper = prefixes.filter("depth < length").select(*KEY).distinct()
    leaves = sequences.join(proper, [*KEY], "left_anti")
    longer = sequences.filter("depth > 0").limit(1)
    leaves = leaves.filter("depth > 0").unionByName(leaves.filter("depth = 0").join(longer.select(F.lit(0).cast("long").alias("depth")), "depth", "left_anti"))
    leaves = _work.stored(leaves.select(F.col("rep").alias("conv_id"), F.lit(1).cast("long").alias("leaf")), "leaves")
    weighted = prefixes.drop("length").join(leaves, "conv_id", "left").fillna(0, ["leaf"])
    sums = (F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaf").alias("n_leaves"))
    nodes = weighted.groupBy(*KEY).agg(*sums, F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    root = reps.join(leaves, "conv_id", "left").fillna(0, ["leaf"]).agg(*sums).filter("conv_id is not null")
    root = root.select(*(zero.alias(k) for k in KEY), "n_convs", "conv_id", "n_leaves", *(zero.alias(k) for k in ("bytes", "pa", "pb")))
    nodes = nodes.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = _work.stored(nodes, "nodes")

    along = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    shared = nodes.filter("n_convs > 1").select(*KEY, F.sum("saved").over(along).alias("below"))
    totals = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("total"))
    others = keyed.join(totals.filter("total > 0"), "conv_id").filter("depth < top").groupBy(*KEY).agg(F.sum("total").alias("others"))
    everything = nodes.agg(F.sum("saved").alias("everything"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    tops = nodes.filter("depth > 1").join(totals.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"])
    above = tops.select(*KEY, "pa", "pb").join(nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("above")), ["depth", "pa", "pb"]).select(*KEY, "above")

    out = nodes.join(shared, [*KEY], "left").join(others, [*KEY], "left").join(children, [*KEY], "left").join(above, [*KEY], "left").join(ends, [*KEY], "left")
    out = out.crossJoin(F.broadcast(everything)).crossJoin(F.broadcast(root.select(F.col("conv_id").alias("root_id"))))  # a row each
    parent = F.when(F.col("depth") == 1, F.col("root_id")).when(F.col("depth") > 1, F.coalesce("above", "conv_id"))
    none = F.lit(0)
    saved = F.when(F.col("depth") == 0, F.col("everything")).otherwise(F.coalesce("below", none) + F.coalesce("others", none))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", none).cast("long").alias("n_children"), "n_leaves", saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, turn, role, text) once they are rebuilt. Other columns are ignored."""
    return prefix_nodes(*rebuild(_work.stored(numbered_turns(conversations), "numbered")))
