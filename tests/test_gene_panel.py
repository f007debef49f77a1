from collections import defaultdict

import numpy as np

from methyloom.operators import enrich as en
from methyloom.plans.enrich_queries import QUERIES


def one_by_one(votes, need):
    pairs = defaultdict(set)
    for p, g in votes:
        pairs[p].add(g)
    chosen = {g for s in pairs.values() if len(s) <= need for g in s}
    while True:
        helps = defaultdict(int)
        for s in pairs.values():
            if len(s & chosen) < need:
                for g in s - chosen:
                    helps[g] += 1
        if not helps:
            return chosen
        chosen.add(min(helps, key=lambda g: (-helps[g], g)))


def test_many_a_pass_are_those_of_one_by_one(spark):
    rng = np.random.default_rng(0)
    votes = [(f"p{i}", f"g{g}") for i in range(60) for g in rng.integers(0, 40, rng.integers(1, 9))]
    got = en.greedy_panel(spark.createDataFrame(votes, "pair STRING, gene STRING"))
    assert len(got) == len(set(got)) and set(got) == one_by_one(votes, 2)


def test_every_pair_of_the_table_has_its_genes(spark, sf):
    panel = {r.gene for r in QUERIES["gene_panel"](spark, sf).collect()}
    pairs = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/dmg_table.parquet").where("names IS NOT NULL AND left_right IS NOT NULL").select("left_right", "names").collect():
        pairs[r.left_right].add(r.names)
    assert all(len(s & panel) >= min(2, len(s)) for s in pairs.values())
