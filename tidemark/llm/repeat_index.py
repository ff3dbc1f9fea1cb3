"""Suffix-array dedup by a run-length index: bytes covered by a long string that also starts elsewhere are removed.

1. Anchors. Every window of `least` bytes has an anchor, the gram of least hash in it (64 bytes of 400). Windows in a row whose anchors are equal
   make a segment: the bytes that they cover. Equal windows have equal anchors, so they lie in segments of one key, and each window lies in
   exactly one segment. A key of a single segment with a single place of its anchor can't repeat anything and is left out. Equal
   segments are one, with their number.
2. Index. A segment whose number is two or more repeats whole, so keys without any other segment are told already. The other keys are dealt
   to buckets of about `BUCKET` bytes of segments. The segments of a bucket are joined with unlike separators and suffix-sorted; of the Burrows-Wheeler transform only the runs are kept, with the
   text places sampled at their starts and ends.
3. Matching statistics. The longest match of a place with another one is the longer of those with its two neighbours in suffix order. It
   shrinks by one from a place to the next unless a run ends between the place and that neighbour, so comparing bytes at the sampled run
   ends alone gives it for all places, streamed in text order. Windows whose match is `least` bytes or longer are marked.
4. The marks of a segment go to all its places, and those of a text are united.

A key with more than `HOT` bytes of segments (a passage in many contexts) is dealt anew by a longer anchor, up to the whole window, where
all segments of a key are equal. So no group grows with the data. Texts are told apart by 128 bits of their SHA-256, segments
by 128 bits of anchor and content hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import whole, written

LEAST = 400
GRAMS = (0.16, 0.4, 0.7, 1.0)  # anchor lengths, of a window's; the last one is the whole window
BUCKET = 1 << 20
HOT = 1 << 19
BLOCK = 1 << 19  # bytes of text that are anchored at once
PLACE = 20  # low bits of a packed minimum that hold its place in a block
ODD = 0x9E3779B97F4A7C15
SPANS = "array<struct<start: int, stop: int>>"
PARTS = "key long, digest long, first int, size int, again boolean"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


_BYTES = _mixed(np.arange(1, 257).astype(np.uint64) * np.uint64(ODD))
_UP, _DOWN = _powers(ODD, BLOCK * 2), _powers(pow(ODD, -1, 1 << 64), BLOCK * 2)


def _anchored(data: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchor of every window of a block."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _UP[: len(data)], out=sums[1:])
    grams = _mixed((sums[gram:] - sums[:-gram]) * _DOWN[: len(data) - gram + 1])
    place = np.uint64((1 << PLACE) - 1)
    low = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    width, step = least - gram + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    at = (low & place).astype(np.int64)
    return grams[at].view(np.int64), at


def _parts(data: np.ndarray, starts: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, key, whether its anchor has several places) of the segments of joined texts; `starts` ends with the length."""
    found = []
    step = BLOCK - least + 1
    for block in range(0, max(len(data) - least + 1, 0), step):
        piece = data[block : block + BLOCK]
        if len(piece) < least:
            break
        key, at = _anchored(piece, gram, least)
        window = np.arange(block, block + len(key))
        text = np.searchsorted(starts, window, "right") - 1
        valid = window + least <= starts[text + 1]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key)) - 1
        good = valid[first]
        first, last = first[good], last[good]
        found.append((window[first], last - first + 1, key[first], at[first] != at[last]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def anchor_lengths(least: int) -> list[int]:
    return [max(1, int(least * g)) for g in GRAMS]


def _digest(data: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(data.data) - (1 << 63)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows that are anchored together: a block of bytes, or one longer text."""
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if k > first and held + size > BLOCK:
            yield first, k
            first, held = k, 0
        held += size
    if sizes:
        yield first, len(sizes)


def _segmented(texts: pa.Array, gram: int, least: int) -> Iterator[tuple[int, list[list]]]:
    """Of every text, in order, the lists key, digest, first, size, again of its segments."""
    texts = texts.cast(pa.large_binary())
    for a, b in _groups([len(t.as_buffer()) for t in texts]):
        parts = [np.frombuffer(texts[k].as_buffer(), np.uint8) for k in range(a, b)]
        data = np.concatenate(parts)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        first, size, key, again = _parts(data, starts, gram, least)
        digest = np.array([_digest(data[f : f + n + least - 1]) for f, n in zip(first.tolist(), size.tolist())], np.int64)
        cuts = np.searchsorted(first, starts)
        for k in range(b - a):
            one = slice(cuts[k], cuts[k + 1])
            yield a + k, [key[one], digest[one], first[one] - starts[k], size[one], again[one]]


def anchored_texts(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, n_bytes, sha, tid, parts) of every row of (doc_id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            shas = [hashlib.sha256(t.as_buffer()) for t in texts]
            parts = [made for _, made in _segmented(texts, anchor_lengths(least)[0], least)]
            ends = pa.array(np.concatenate(([0], np.cumsum([len(p[0]) for p in parts]))).astype(np.int32))
            columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind) for k, kind in enumerate(_PART)]
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names=_NAMES))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array([s.hexdigest() for s in shas], pa.string()),
                    pa.array([s.digest()[:16] for s in shas], pa.binary()),
                    lists,
                ],
                names=["doc_id", "n_bytes", "sha", "tid", "parts"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = PARTS.replace(" long", ": bigint").replace(" int", ": int").replace(" boolean", ": boolean")
    return docs.mapInArrow(made, f"doc_id {id_type}, n_bytes long, sha string, tid binary, parts array<struct<{fields}>>")


_NAMES = [field.split()[0] for field in PARTS.split(", ")]
_PART = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]


def _texts(docs: DataFrame, tids: DataFrame, least: int) -> DataFrame:
    """(tid, text) of the texts named by `tids`, once each. A task sends a text once, so a large group of copies isn't gathered."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            names, new = [], []
            for text in batch.column(0).cast(pa.large_binary()):
                name = hashlib.sha256(text.as_buffer()).digest()[:16]
                new.append(name not in seen)
                if len(seen) < 1_000_000:
                    seen.add(name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(0).cast(pa.binary())], names=["tid", "text"]).filter(pa.array(new, pa.bool_()))

    long = docs.where(F.octet_length("text") >= least).select("text").mapInArrow(told, "tid binary, text binary")
    return long.join(tids.hint("merge"), "tid", "left_semi").dropDuplicates(["tid"])


def _open(segments: DataFrame, name: str) -> DataFrame:
    """The segments (key, again, ...; n of each, one if there is none) whose key may repeat something."""
    n = F.sum("n") if "n" in segments.columns else F.count(F.lit(1))
    keys = segments.groupBy("key").agg(n.alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("key")
    return segments.join(written(keys, name).hint("merge"), "key", "left_semi")


def _apart(segments: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The segments (key, digest, n, size, ...) of keys that hold copies only, as (key, digest, spans) whole; the segments of the other keys."""
    single = written(segments.groupBy("key").agg(F.min("n").alias("fewest")).where("fewest = 1").select("key"), "repeat-single").hint("merge")
    whole_span = F.expr(f"array(named_struct('start', 0, 'stop', cast(size + {least - 1} AS int)))").cast(SPANS).alias("spans")
    return segments.join(single, "key", "left_anti").select("key", "digest", whole_span), segments.join(single, "key", "left_semi")


def suffix_order(symbols: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The suffix array of symbols 1 to 256; 0 ends a text and counts as less than any other symbol and the later zeros. `rest`: how many
    symbols of its text are left at each place (0 at its end)."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(7, symbols.dtype))).astype(np.int64)
    key = np.zeros(n, np.int64)
    for t in range(7):
        key = (key << 9) | np.where(rest > t, padded[t : t + n], 0)
    order = np.argsort(key, kind="stable")
    sorted_key, done = key[order], rest[order] < 7
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | done[1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    places, depth = order[slots], 7
    while len(places):
        key = (rank[places] << 32) | rank[places + depth]
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[slots] = places
        new = np.ones(len(places), bool)
        new[1:] = key[1:] != key[:-1]
        rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        left = ~(new & np.append(new[1:], True))
        places, slots, depth = places[left], slots[left], 2 * depth
    return order


def run_ends(symbols: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run-length index: text places sampled at each run's start in the Burrows-Wheeler transform, and at the end of the run before it."""
    before = symbols[order - 1]  # the first place's predecessor is the last symbol, an end
    start = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
    return order[start], order[start - 1]


def agreement(data: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of the texts at places a and b agree."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    limit = np.minimum(rest[a], rest[b])
    length, live, at = limit.copy(), np.arange(len(a)), 0
    while len(live):
        one = np.ascontiguousarray(words[a[live] + at]).view(np.uint64).ravel()
        other = np.ascontiguousarray(words[b[live] + at]).view(np.uint64).ravel()
        differ = one ^ other
        ends = differ != 0
        low = differ[ends] & (~differ[ends] + np.uint64(1))
        length[live[ends]] = np.minimum(limit[live[ends]], at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3))
        at += 8
        live = live[~ends]
        live = live[limit[live] > at]
    return length


def matching_statistics(texts: list[bytes]) -> np.ndarray:
    """At each place of the texts, joined with one byte after each: the length of the longest match with what starts at another place."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = data.astype(np.int16) + 1
    symbols[ends] = 0
    rest = np.repeat(ends, sizes + 1) - np.arange(len(data))
    later, earlier = run_ends(symbols, suffix_order(symbols, rest))
    length = agreement(data, rest, later, earlier)
    longest = np.zeros(len(data), np.int64)
    for places in (later, earlier):
        at = np.full(len(data), -1, np.int64)
        at[places] = np.arange(len(places))
        at = np.maximum.accumulate(np.where(at >= 0, np.arange(len(data)), -1))
        known = np.zeros(len(data), np.int64)
        known[places] = length
        longest = np.maximum(longest, np.where(at >= 0, known[at] - (np.arange(len(data)) - at), 0))
    return longest


def marked(segments: list[bytes], numbers: list[int], least: int) -> Iterator[list[tuple[int, int]]]:
    """The spans of each segment that are covered by strings of `least` bytes which also start elsewhere in them.

    A segment that comes twice repeats whole; it is entered once, for the others to match.
    """
    longest = matching_statistics(segments)
    at = 0
    for segment, n in zip(segments, numbers):
        hits = np.flatnonzero(longest[at : at + len(segment)] >= least)
        at += len(segment) + 1
        yield _united(hits, hits + least) if n == 1 else [(0, len(segment))]


def _united(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of sorted spans that touch or overlap."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(stops)
    new = np.flatnonzero(starts[1:] > reach[:-1]) + 1
    return list(zip(starts[np.concatenate(([0], new))].tolist(), reach[np.concatenate((new, [len(starts)])) - 1].tolist()))


def _index(segments: DataFrame, size: int, least: int) -> DataFrame:
    """(key, digest, spans) of the segments with marks; `size`: bytes of all of them."""

    def indexed(table: pa.Table) -> pa.Table:
        found = marked(table.column("segment").to_pylist(), table.column("n").to_pylist(), least)
        spans = [[{"start": a, "stop": b} for a, b in s] for s in found]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        made = pa.table({"key": table.column("key"), "digest": table.column("digest"), "spans": pa.array(spans, kind)})
        return made.filter(pc.greater(pc.list_value_length(made.column("spans")), 0))

    buckets = max(1, -(-size // BUCKET))
    dealt = segments.select("key", "digest", "n", "segment", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(indexed, f"key long, digest long, spans {SPANS}")


def _refined(segments: DataFrame, gram: int, least: int) -> DataFrame:
    """The segments dealt anew by a longer anchor: (key, digest, firsts, again, segment, n, of_key, of_digest).

    Equal ones of one segment (a text that repeats a line has as many as it has lines) are one row with all their places.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).cast(pa.large_binary())
            for k, parts in _segmented(texts, gram, least):
                data = texts[k].as_py()
                places: dict[tuple[int, int], list[int]] = {}
                about = {}
                for key, code, f, n, again in zip(*(p.tolist() for p in parts)):
                    places.setdefault((key, code), []).append(f)
                    about.setdefault((key, code), (again, data[f : f + n + least - 1]))
                columns = [
                    pa.array([p[0] for p in places], pa.int64()),
                    pa.array([p[1] for p in places], pa.int64()),
                    pa.array(places.values(), pa.list_(pa.int32())),
                    pa.array([a for a, _ in about.values()], pa.bool_()),
                    pa.array([s for _, s in about.values()], pa.binary()),
                    *(pa.array([batch.column(c)[k].as_py()] * len(places), pa.int64()) for c in (2, 0, 1)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "digest", "firsts", "again", "segment", "n", "of_key", "of_digest"])

    rows = segments.select("key", "digest", "n", "segment")
    return rows.mapInArrow(dealt, "key long, digest long, firsts array<int>, again boolean, segment binary, n long, of_key long, of_digest long")


def long_matches(segments: DataFrame, least: int, level: int = 0) -> DataFrame:
    """(key, digest, spans) of the segments (key, digest, n, segment) with marks. Hot keys are dealt anew until none is left."""
    grams = anchor_lengths(least)
    sizes = written(segments.groupBy("key").agg(F.sum(F.octet_length("segment")).alias("size")), "repeat-sizes")
    hot = sizes.where(F.col("size") > HOT).select("key")
    total = sizes.agg(F.coalesce(F.sum(F.when(F.col("size") <= HOT, F.col("size"))), F.lit(0)).alias("cold"), F.max("size").alias("most")).first()
    if level + 1 == len(grams) or (total["most"] or 0) <= HOT:
        return _index(segments, segments.agg(F.coalesce(F.sum(F.octet_length("segment")), F.lit(0))).first()[0], least)
    found = _index(segments.join(hot, "key", "left_anti"), total["cold"], least)
    parts = written(_refined(segments.join(hot, "key", "left_semi"), grams[level + 1], least), "repeat-parts")
    finer = parts.groupBy("key", "digest").agg(F.sum(F.col("n") * F.size("firsts")).alias("n"), F.max("again").alias("again"), F.first("segment").alias("segment"))
    below = long_matches(written(_open(written(finer, "repeat-finer"), "repeat-keys"), "repeat-segments"), least, level + 1)
    places = parts.select("key", "digest", "firsts", "of_key", "of_digest")
    lifted = places.join(written(below, "repeat-below"), ["key", "digest"]).select(
        F.col("of_key").alias("key"), F.col("of_digest").alias("digest"), F.expr("flatten(transform(firsts, f -> transform(spans, s -> named_struct('start', s.start + f, 'stop', s.stop + f)))) AS spans")
    )
    return found.union(lifted)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, spans, n_removed, kept_sha256) of every row.

    `spans` are the maximal spans (start, stop) of the UTF-8 bytes that are covered by strings of `least` bytes which also start anywhere else
    in the texts, the same one included; `kept_sha256` is the digest of the bytes outside of them. All texts are judged as given.
    A null text is empty; shorter texts have no spans; repeated rows repeat each other whole. Rows with a null or repeated identifier
    are told apart by their text. Other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    anchored = written(anchored_texts(rows, least), "repeat-anchors")
    parts = written(_open(anchored.select("tid", F.inline("parts")), "repeat-keys").drop("again"), "repeat-open")
    segments = parts.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "first", "size")).alias("at"))
    segments = written(segments.select("key", "digest", "n", "at.*"), "repeat-numbered")
    copies, mixed = _apart(segments, least)
    told = mixed.groupBy("tid").agg(F.collect_list(F.struct("key", "digest", "n", "first", "size")).alias("wanted"))
    told = written(told, "repeat-wanted")
    texts = _texts(rows, told.select("tid"), least).join(told, "tid").select("text", F.inline("wanted"))
    cut = texts.select("key", "digest", "n", F.expr(f"substring(text, first + 1, size + {least - 1})").alias("segment"))
    marks = written(long_matches(written(cut, "repeat-segments"), least).union(copies), "repeat-marks")
    placed = parts.select("tid", "key", "digest", "first").join(marks.hint("merge"), ["key", "digest"])
    spans = written(placed.groupBy("tid").agg(F.collect_set(F.struct("first", "spans")).alias("found")), "repeat-spans")
    cleaned = written(_cleaned(_texts(rows, spans.select("tid"), least).join(spans, "tid")), "repeat-cleaned")
    every = anchored.select("doc_id", "n_bytes", "sha", "tid").join(cleaned.hint("merge"), "tid", "left")
    return every.select(
        "doc_id",
        "n_bytes",
        F.coalesce("spans", F.expr(f"cast(array() AS {SPANS})")).alias("spans"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
    )


def _cleaned(texts: DataFrame) -> DataFrame:
    """(tid, spans, n_removed, kept) of texts (tid, text, found): all segments' spans united, and the digest of what is left."""

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            found = {"spans": [], "n_removed": [], "kept": []}
            for k in range(batch.num_rows):
                data, segments = batch.column(1)[k].as_buffer(), batch.column(2)[k].values
                spans, numbers = segments.field(1).flatten(), pc.list_value_length(segments.field(1)).to_numpy()
                starts, stops = (spans.field(x).to_numpy() + np.repeat(segments.field(0).to_numpy(), numbers) for x in (0, 1))
                order = np.argsort(starts, kind="stable")
                united = _united(starts[order], stops[order])
                rest, at = hashlib.sha256(), 0
                for a, b in united:
                    rest.update(memoryview(data)[at:a])
                    at = b
                rest.update(memoryview(data)[at:])
                found["spans"].append([{"start": a, "stop": b} for a, b in united])
                found["n_removed"].append(sum(b - a for a, b in united))
                found["kept"].append(rest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found["spans"], kind), pa.array(found["n_removed"], pa.int64()), pa.array(found["kept"])], names=["tid", *found])

    return texts.select("tid", "text", "found").mapInArrow(cleaned, f"tid binary, spans {SPANS}, n_removed long, kept string")


def kept_bytes(text: str = "text", spans: str = "spans") -> Column:
    """The bytes of a text column outside of the spans column."""
    data = f"encode(coalesce({text}, ''), 'UTF-8')"
    cut = f"aggregate({spans}, named_struct('at', 0, 'kept', X''), (s, x) -> named_struct('at', x.stop, 'kept', concat(s.kept, substring({data}, s.at + 1, x.start - s.at))))"
    return F.expr(f"transform(array({cut}), s -> concat(s.kept, substring({data}, s.at + 1)))[0]")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
