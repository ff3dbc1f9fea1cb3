"""Periodic run detection by multi-scale minimizers.

A run is a stretch of consecutive words of smallest period q (words q apart are identical), at least twice as long as q, that no
neighbouring word extends. With lag p, a run of period p is a stretch of at least p places i where word i equals word i + p.

- Periods under `SHORT`: every lag is scanned directly.
- Scale j, periods from 2^j to 2^(j+1): of every window of 2^(j-1) grams of 2^(j-1) words, the places of the least gram hash are
  taken. Inside a run the windows repeat at period distance, and so do their minima: equal minimizers 2^j to 2^(j+1) apart seed a lag,
  and comparing words to both sides gives its stretch.
- A gram that lies in a run of at most half its length (found at a lower scale) occurs at every period of it, so such minimizers are
  not paired one by one. A run over two stretches R, S of that shorter period d either goes over an end of R, which then meets the
  same end of S; or it lies in the two where they touch, and its lag is one of those, d apart, that line R up with S.

So each place seeds a bounded number of lags at each scale, and all runs are found. Hashes only seed, words are compared.

Every text is worked on whole, by numpy in Arrow batches; texts of a batch are joined with unlike separators. A row's memory is in
proportion to its text. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import whole, words

SHORT_BITS = 6
SHORT = 1 << SHORT_BITS  # periods that lags are scanned for
LEAST = 12  # words of a run
BATCH_WORDS = 1 << 19  # words worked on together (more where one text has more)
ODD = np.uint64(0x9E3779B97F4A7C15)
RUN = "struct<start: bigint, length: bigint, period: bigint>"
OUTPUT = ("n_words", "runs", "collapsed")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


def _stretches(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of every row of consecutive numbers."""
    cut = np.flatnonzero(np.diff(hits) != 1)
    return hits[np.concatenate(([0], cut + 1))], hits[np.concatenate((cut, [len(hits) - 1]))] + 1


def _slid(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of every `width` consecutive values; width is a power of two."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def _minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """The places whose hash is the least of some window of `width` places."""
    least = _slid(hashes, width, np.minimum)
    edge = np.zeros(width - 1, hashes.dtype)
    return np.flatnonzero(_slid(np.concatenate((edge, least, edge)), width, np.maximum) == hashes)


def _same_before(x: np.ndarray, i: int, p: int) -> int:
    """How many places directly before i agree with those p further on."""
    n, size = 0, 32
    while i - n > 0:
        size = min(size, i - n)
        differ = np.flatnonzero(x[i - n - size : i - n] != x[i - n - size + p : i - n + p])
        if len(differ):
            return n + size - 1 - int(differ[-1])
        n, size = n + size, size * 4
    return n


def _same_from(x: np.ndarray, i: int, p: int) -> int:
    """How many places from i on agree with those p further on."""
    n, size = 0, 32
    while i + n + p < len(x):
        size = min(size, len(x) - p - i - n)
        differ = np.flatnonzero(x[i + n : i + n + size] != x[i + n + p : i + n + size + p])
        if len(differ):
            return n + int(differ[0])
        n, size = n + size, size * 4
    return n


def _grown(x: np.ndarray, seeds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, lag) of the runs that the seeds (place, lag) lie in."""
    found, lag, reach = [], 0, -1
    for i, p in seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))].tolist():
        if p == lag and i < reach:
            continue
        if i < 0 or i + p >= len(x) or x[i] != x[i + p]:
            continue
        start, stop = i - _same_before(x, i, p), i + _same_from(x, i, p)
        lag, reach = p, stop
        if stop - start >= p:
            found.append((start, stop + p, p))
    return found


def _paired(picks: np.ndarray, hashes: np.ndarray, low: int) -> np.ndarray:
    """Seeds of all pairs of equal minimizers that are `low` to 2 `low` - 1 apart."""
    order = np.argsort(hashes, kind="stable")
    place, code = picks[order], hashes[order]
    seeds = []
    for t in range(1, len(place)):
        apart = place[t:] - place[:-t]
        near = (code[t:] == code[:-t]) & (apart < 2 * low)
        if not near.any():
            break
        good = near & (apart >= low)
        seeds.append(np.column_stack((place[:-t][good], apart[good])))
    return np.concatenate(seeds) if seeds else np.empty((0, 2), np.int64)


def _lined_up(x: np.ndarray, runs: np.ndarray, low: int) -> np.ndarray:
    """Seeds from stretches of one short period: the lags that line up their ends, and those of runs in two that touch."""
    seeds = []
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    for t in range(1, len(runs)):
        one, other = runs[:-t], runs[t:]
        touch = one[:, 1] >= other[:, 0]
        near = (one[:, 2] == other[:, 2]) & (touch | (np.minimum(other[:, 0] - one[:, 0], other[:, 1] - one[:, 1]) < 2 * low))
        if not near.any():
            break
        one, other = one[near], other[near]
        seeds += [np.column_stack((one[:, 0], other[:, 0] - one[:, 0])), np.column_stack((one[:, 1] - 1, other[:, 1] - one[:, 1]))]
        for (s1, e1, d), (s2, e2, _) in zip(one[one[:, 1] >= other[:, 0]].tolist(), other[one[:, 1] >= other[:, 0]].tolist()):
            turn = _turn(x, e1 - d, s2, d)
            if turn is None:
                continue
            first = s2 + turn - (e1 - d)
            lags = np.arange(first + -(-(low - first) // d) * d, 2 * low, d)
            start, stop = np.maximum(s1, s2 - lags), np.minimum(e1, e2 - lags)
            good = stop - start >= lags
            seeds.append(np.column_stack((start[good], lags[good])))
    seeds = np.concatenate(seeds) if seeds else np.empty((0, 2), np.int64)
    return seeds[(seeds[:, 1] >= low) & (seeds[:, 1] < 2 * low)]


def _turn(x: np.ndarray, i: int, j: int, d: int) -> int | None:
    """The least r below d with the d words at j + r equal to those at i."""
    root, text, at = x[i : i + d].tobytes(), x[j : j + 2 * d - 1].tobytes(), -1
    while (at := text.find(root, at + 1)) >= 0:
        if at % x.itemsize == 0:
            return at // x.itemsize
    return None


def runs_of(x: np.ndarray, short_bits: int = SHORT_BITS) -> np.ndarray:
    """(start, end, smallest period) of every run of at least two periods in an array of numbered words, by start, then end.

    Distinct runs never have both start and end in common: of equal stretches the smallest lag is the period.
    """
    x = np.ascontiguousarray(x)
    found = []
    for p in range(1, min(1 << short_bits, len(x) // 2 + 1)):
        hits = np.flatnonzero(x[:-p] == x[p:])
        if len(hits):
            start, stop = _stretches(hits)
            good = stop - start >= p
            found += zip(start[good].tolist(), (stop[good] + p).tolist(), [p] * int(good.sum()))
    runs = _smallest(found)
    gram, hashes = 1, _mixed(x.astype(np.uint64) + ODD)
    j = short_bits
    while (2 << j) <= len(x):
        low, width = 1 << j, 1 << (j - 1)
        while gram < width:
            hashes = _mixed(hashes[:-gram] * ODD + hashes[gram:])
            gram *= 2
        picks = _minimizers(hashes, width)
        inner = runs[(2 * runs[:, 2] <= width) & (runs[:, 1] - runs[:, 0] >= width)]
        covered = np.zeros(len(x) + 1, np.int64)
        np.add.at(covered, inner[:, 0], 1)
        np.add.at(covered, inner[:, 1] - width + 1, -1)
        picks = picks[np.cumsum(covered)[picks] == 0]
        grown = _grown(x, np.concatenate((_paired(picks, hashes[picks], low), _lined_up(x, inner, low))))
        if grown:
            runs = _smallest([*map(tuple, runs.tolist()), *grown])
        j += 1
    return runs


def _smallest(found: list[tuple[int, int, int]]) -> np.ndarray:
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.unique(np.array(found, np.int64), axis=0)  # by start, end, lag
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _texts_runs(texts: list[bytes], least: int) -> Iterator[tuple[int, list[dict], str]]:
    """(number of words, runs, text without the repeats) of every text."""
    split = [t.split() for t in texts]  # bytes split at exactly 0x20 and 0x09 to 0x0D
    numbers: dict[bytes, int] = {}
    parts, starts, at = [], [], 0
    for k, ws in enumerate(split):
        starts.append(at)
        parts += [numbers.setdefault(w, len(numbers)) for w in ws]
        parts.append(-1 - k)
        at += len(ws) + 1
    runs = runs_of(np.array(parts, np.int32))
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, 2 * runs[:, 2])]
    cuts = np.searchsorted(runs[:, 0], starts + [at]).tolist()
    for k, ws in enumerate(split):
        mine = runs[cuts[k] : cuts[k + 1]] - [starts[k], starts[k], 0]
        kept = ws
        if len(mine):
            gone = np.zeros(len(ws) + 1, np.int64)
            np.add.at(gone, mine[:, 0] + mine[:, 2], 1)
            np.add.at(gone, mine[:, 1], -1)
            kept = [w for w, g in zip(ws, np.cumsum(gone).tolist()) if not g]
        listed = sorted((s, p, e - s) for s, e, p in mine.tolist())
        yield len(ws), [{"start": s, "length": n, "period": p} for s, p, n in listed], b" ".join(kept).decode()


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs of at least `least` words by start, then period, and its words without
    those that repeat a run's first period, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words, no runs and an empty `collapsed`. Repeated rows and rows with a
    null identifier are worked on like any other, other columns are ignored, an empty table gives an empty result. Equal
    stretches can't be two runs; runs may overlap, and a word goes if any of them drops it.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            first, size = 0, 0
            for k in range(batch.num_rows + 1):
                if k == batch.num_rows or (size > 0 and size + len(texts[k].as_buffer()) > 6 * BATCH_WORDS):
                    if k > first:
                        made = list(_texts_runs(texts.slice(first, k - first).to_pylist(), least))
                        columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], kind), pa.array([m[2] for m in made], pa.string())]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k - first), *columns], names=["doc_id", *OUTPUT])
                    first, size = k, 0
                if k < batch.num_rows:
                    size += len(texts[k].as_buffer())

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    return rows.mapInArrow(found, f"doc_id {id_type}, n_words bigint, runs array<{RUN}>, collapsed string")


def with_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of every row, the words of one text in ten, by the identifier's CRC-32, repeated from a place on.

    With h the checksum of the decimal identifier, g = floor(h / 10) and n words, rows with h % 10 = 0 and n > 0 have each word i >= a
    replaced by word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts stay as they are, those of
    a null identifier as well.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"), F.crc32(F.col(doc_id).cast("string")).alias("h"))
    rows = rows.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words("text")).alias("ws"))
    placed = rows.withColumn("a", F.when(F.size("ws") > 0, F.expr("cast(g % size(ws) as int)")))
    placed = placed.withColumn("p", F.when(F.size("ws") > 0, F.expr("cast(1 + (size(ws) - a) div (3 + g % 8) as int)")))
    changed = F.expr("array_join(transform(ws, (w, i) -> if(i < a, w, ws[a + (i - a) % p])), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Of each row of `periodic_runs`: how many runs, the longest one (ties: smallest start, then period), and digests."""
    longest = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    picked = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), lines.alias("lines"), "collapsed")
    return picked.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
