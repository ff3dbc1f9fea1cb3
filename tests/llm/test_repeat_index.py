"""The run-length index against brute force: matches of all places, and every string of 400 bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import repeat_index
from tidemark.llm.queries import QUERIES


def agree(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_matching_statistics_of_small_texts():
    rng = random.Random(2)
    for _ in range(60):
        alphabet = rng.choice([b"ab", b"ab\x00\xff"])
        texts = [bytes(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(rng.randint(1, 5))]
        texts += rng.choice([[], [texts[0]], [texts[0] * 3]])
        places = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
        want = {p: max((agree(texts[p[0]][p[1] :], texts[q[0]][q[1] :]) for q in places if q != p), default=0) for p in places}
        got = repeat_index.matching_statistics(texts)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        assert {(k, i): got[at[k] + i] for k, i in places} == want


def test_the_index_keeps_runs_only():
    texts = [b"the same old passage of many words " * 3] * 30
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = data.astype(np.int16) + 1
    size = len(texts[0]) + 1
    symbols[size - 1 :: size] = 0
    rest = np.tile(np.arange(size)[::-1], len(texts))
    later, _ = repeat_index.run_ends(symbols, repeat_index.suffix_order(symbols, rest))
    assert len(later) < 5 * size < len(data) / 5


def expected(rows, least):
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(t[i : i + least] for _, t in texts for i in range(len(t) - least + 1))
    found = []
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int))))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[: len(t)]])
        found.append((doc_id, len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def some_rows(rng, least):
    def prose(n):
        return "".join(rng.choices("abcdefgh äß", k=n))

    passage, common = prose(3 * least), prose(least + least // 8)
    texts = [None, "", "short", prose(least - 1), "x" * (least - 1), "x" * least, "y" * (least + 1), "z" * (5 * least)]
    texts += [prose(rng.randint(1, 4 * least)) for _ in range(12)]
    texts += [texts[-1]] * 3 + [texts[-2] + "!"]
    texts += [prose(rng.randint(0, 90)) + common + prose(rng.randint(0, 90)) for _ in range(40)]  # one passage in many contexts
    for _ in range(8):
        a = rng.randrange(len(passage) - least // 2)
        texts.append(prose(50) + passage[a : a + rng.randint(least // 2, 2 * least)] + prose(50))
    texts += [(prose(97) * 30)[: 6 * least], prose(40) + passage[:least] + "|" + passage[:least], (passage + passage)[: 5 * least]]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(None, texts[15]), (None, None), (7, texts[7]), (30, texts[30])]


@pytest.mark.parametrize("least, hot, block", [(400, 1 << 19, 1 << 19), (400, 4_000, 1 << 19), (50, 500, 1 << 12)])
def test_against_every_string(spark, monkeypatch, least, hot, block):
    monkeypatch.setattr(repeat_index, "HOT", hot)
    monkeypatch.setattr(repeat_index, "BLOCK", block)
    monkeypatch.setattr(repeat_index, "BUCKET", 20_000)
    rows = some_rows(random.Random(least + hot), least)
    docs = spark.createDataFrame([(*r, 3, b"x") for r in rows], "doc_id long, text string, spans int, tid binary").repartition(3)
    found = repeat_index.repeated_spans(docs, least=least)
    assert sorted(map(tuple, repeat_index.digest(found).collect()), key=repr) == expected(rows, least)


def test_copies_are_told_without_the_index(spark, monkeypatch):
    rng = random.Random(3)
    one, other, single = ("".join(rng.choices("abcdefgh äß", k=900)) for _ in range(3))
    rows = list(enumerate([one, one, one, other, other, other[:700] + "!" + single]))
    entered, match = [], repeat_index.long_matches
    monkeypatch.setattr(repeat_index, "long_matches", lambda segments, least: entered.append(segments.collect()) or match(segments, least))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = repeat_index.digest(repeat_index.repeated_spans(docs))
    assert sorted(map(tuple, found.collect())) == expected(rows, 400)
    assert entered[0] and all(bytes(r["segment"]).decode("utf-8", "ignore") not in one for r in entered[0])
    assert [list(s) for s in repeat_index.marked([b"abc" * 300, b"x" + b"abc" * 150], [2, 1], 400)] == [[(0, 900)], [(1, 451)]]


def test_kept_bytes_agree_with_their_digest(spark):
    rows = some_rows(random.Random(9), 400)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = repeat_index.repeated_spans(docs).join(docs, "doc_id").select("kept_sha256", repeat_index.kept_bytes().alias("kept")).collect()
    assert len(found) == len(rows) and any(r["kept"] for r in found)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)


def test_the_query_and_an_empty_table(spark, tmp_path):
    rows = some_rows(random.Random(1), 400)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = QUERIES["op11_repeat_index"](spark, str(tmp_path))
    assert dict(query.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert sorted(map(tuple, query.collect()), key=repr) == expected(rows, 400)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeat_index.repeated_spans(empty).collect() == []
