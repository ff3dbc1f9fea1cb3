"""Runs of repeated words against brute force: all maximal stretches of every lag."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import periodic_runs
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_run(x):
    """{(start, length): smallest period} of all stretches of at least two periods."""
    found = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            start = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            if i - start >= p:
                found.setdefault((start, i + p - start), p)
            i += 1
    return found


def runs_by_lags(x, least=12):
    return sorted((s, p, n) for (s, n), p in every_run(x).items() if n >= least)


def nested(rng, depth):
    if not depth:
        return [rng.randrange(3)] * rng.randint(1, 3)
    u = nested(rng, depth - 1)
    kind = rng.random()
    if kind < 0.5:
        return u * rng.randint(1, 4) + u[: rng.randint(0, len(u))]
    return u + u[::-1] if kind < 0.7 else u + nested(rng, depth - 1) + u


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_all_runs_are_found_at_every_scale(bits):
    rng = random.Random(bits)
    cases = [fibonacci(300), [0, 1] * 50 + [1, 0] * 50, [0] * 100, ([0, 1] * 10 + [0]) * 9, [7], [7, 7]]
    cases += [nested(rng, rng.randint(2, 6))[:200] for _ in range(300)]
    cases += [[rng.randrange(2) for _ in range(rng.randint(1, 100))] for _ in range(100)]
    for x in cases:
        got = {(s, e - s): p for s, e, p in periodic_runs.runs_of(np.array(x, np.int32), bits).tolist()}
        assert got == every_run(x)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 20), st.integers(0, 11), st.integers(0, 200))
def test_a_power_with_one_word_changed(root, times, more, place):
    x = root * times + root[: more % len(root)]
    x[place % len(x)] = 9
    got = {(s, e - s): p for s, e, p in periodic_runs.runs_of(np.array(x, np.int32), 2).tolist()}
    assert got == every_run(x)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = runs_by_lags(words)
    gone = {i for s, p, n in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    figures = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{p}\n" for s, p, n in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *figures, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)))


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_the_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a\x0bb\x1cc " * 9, "ä ö " * 40, "x " * 3000, "ß ß " * 30]
    for k in range(60):
        vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 400]))]
        words = rng.choices(vocabulary, k=rng.randint(1, 500))
        at, p = rng.randrange(len(words)), rng.randint(1, 90)
        words[at:at] = (words[at : at + p] or ["q"]) * rng.randint(1, 4)
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "one"), (None, "b c " * 9), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(QUERIES["op12_periodic_runs"](spark, str(tmp_path))) == sorted((expected(*r) for r in rows), key=repr)


def test_texts_and_spans_with_other_columns(spark):
    docs = spark.createDataFrame([("k", "z " * 12 + "end", 5, 6)], "doc_id string, text string, runs int, n_words int")
    row = periodic_runs.periodic_runs(docs).first()
    assert (row["doc_id"], row["n_words"], row["collapsed"]) == ("k", 13, "z end")
    assert [tuple(r) for r in row["runs"]] == [(0, 12, 1)]
    assert periodic_runs.periodic_runs(docs.where("false")).collect() == []
    assert periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_periods(docs.where("false")))).collect() == []
