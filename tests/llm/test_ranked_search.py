"""Ranked search against brute force: every document scored for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import ranked_search
from tidemark.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lowered = (text or "").translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})
    return TERM.findall(lowered)


def best(docs, items, top=10):
    """(item_id, rank, doc_id, score) of (id, text) rows."""
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(doc_id, tf, sum(tf.values())) for doc_id, tf in counted if tf]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    holding = Counter(t for _, tf, _ in counted for t in tf)
    found = []
    for item_id, text in items:
        scored = []
        for doc_id, tf, n in counted:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, score))
        found += [(item_id, k, None if null else doc_id, score) for k, (_, null, doc_id, score) in enumerate(sorted(scored)[:top], 1)]
    return sorted(found, key=repr)


def some_rows(n, seed=11):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    docs = [(None, "c1 r1 r2"), (5, None), (6, ""), (7, " -- \t"), (8, "C1 c1-c1 Ünder ünder ÜNDER 9x9"), (8, "C1 c1-c1 Ünder ünder ÜNDER 9x9")]
    for i in range(n):
        words = rng.choices(common, k=rng.randint(0, 60)) + rng.choices(rare, k=rng.randint(0, 9))
        docs.append((100 + (i * 7919) % n, rng.choice([" ", "\n", ", "]).join(words)))
    docs += [(10_000 + i, "r7 r8 c2 c2") for i in range(40)]  # ties
    docs.append((1, "c3 " * 9_000))
    items = [(0, None), (1, ""), (2, "unknown words"), (3, "r7 R8 r7"), (4, "c1 c2 c3"), (4, "c1 c2 c3"), (None, "ÜNDER ünder"), (5, "c5")]
    items += [(20 + i, " ".join(rng.choices(common, k=8) + rng.choices(rare, k=4))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("shard, block", [(4_096, 50_000), (40, 50_000), (60, 30)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    docs, items = some_rows(400)
    got = ranked_search.ranked_search(
        spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, item int"),
        spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int"),
    )
    assert sorted(map(tuple, got.collect()), key=repr) == best(docs, items)


def test_scores_of_bundles_that_are_dropped_never_matter(spark, monkeypatch):
    """Without the bar no document is dropped; the result is the same."""
    docs, items = some_rows(200, seed=4)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 50)
    monkeypatch.setattr(ranked_search, "STAGES", 1)
    whole = sorted(map(tuple, ranked_search.ranked_search(*frames, top=3).collect()), key=repr)
    assert whole == best(docs, items, 3)


def test_the_query_and_empty_tables(spark, tmp_path):
    docs, items = some_rows(60)
    docs = [d for d in docs if d[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    query = QUERIES["op13_ranked_search"](spark, str(tmp_path))
    assert dict(query.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, query.collect()), key=repr) == best(docs, items)
    some = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search.ranked_search(some.where("false"), asked).collect() == []
    assert ranked_search.ranked_search(some, asked.where("false")).collect() == []


def test_owners_take_equal_shares_rarest_first():
    documents = np.array([50, 1, 1, 20, 3, 25])
    stage = ranked_search.owners(documents, 2)
    order = np.argsort(documents, kind="stable")
    assert (np.diff(stage[order]) >= 0).all() and set(ranked_search.owners(np.ones(40, np.int64), 4).tolist()) == {0, 1, 2, 3}
