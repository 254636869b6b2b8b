"""Links of crowds of near copies."""

import random

import numpy as np
from pyspark.sql import functions as F

from parallaxis.llm import simhash
from parallaxis.llm.components import Forest


def test_stars_join_the_trees_of_a_forest():
    forest = Forest(6)
    forest.add(np.array([0, 1, 4]), np.array([1, 3, 5]))
    src, dst = forest.stars(np.array([50, 20, 9, 30, 70, 60]))
    assert sorted(zip(src.tolist(), dst.tolist())) == [(30, 20), (50, 20), (70, 60)]


def test_a_crowd_of_near_copies_gives_the_same_links_in_every_band(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = []
    for k in range(300):
        own = list(base)
        own[rng.randrange(400)] = f"x{k}"
        texts.append((k, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bands = simhash.Bands.plan(300, 0.8)
    names = simhash._names(bands.words)
    nodes = simhash.fingerprints(docs, 5, bands.words, sets=True).select(*names, F.col("digest").alias("node")).distinct()
    links = simhash.candidates(nodes, bands).select(F.least("src", "dst"), F.greatest("src", "dst")).filter("src <> dst").distinct().count()
    assert 299 <= links <= 3 * 299, links
    found = simhash.near_copies(docs).select("doc_id", "component_id").collect()
    assert len(found) == 300 and {r.component_id for r in found} == {0}
