"""Pairs compared many at once, and shuffles that are deleted once a table is written."""

import glob
import os
import tempfile

import numpy as np
from test_jaccard import groups

from millrace.llm import jaccard
from millrace.llm.common import Scratch


def test_short_lists_need_no_trees(monkeypatch):
    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**32, size=6).astype(np.uint32)
    base = [rng.integers(0, 2**32, size=17).astype(np.uint32) for _ in range(200)]
    sets = [np.unique(np.concatenate([common, base[i % 200][rng.random(17) < 0.9]])) for i in range(600)]
    n = np.array([len(s) for s in sets])
    trees, own = [], jaccard.tree_links
    monkeypatch.setattr(jaccard, "tree_links", lambda *a: trees.append(1) or own(*a))
    found = jaccard.rare_links(n, sets, np.arange(600), 75)
    true = {(i, j) for j in range(600) for i in range(j) if 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (n[i] + n[j])}
    assert not trees and {(min(x), max(x)) for x in found} <= true
    assert groups(range(600), found) == groups(range(600), true)


def test_kept_tables_leave_no_shuffle(spark):
    root = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
    files = lambda: set(glob.glob(f"{root}/**/shuffle_*.data", recursive=True))
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = Scratch(spark).keep(spark.range(100_000).selectExpr("id % 1000 as k", "id").groupBy("k").sum("id"))
    assert not files() - before
    assert kept.count() == 1000 and spark.conf.get(name, None) is None
