"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their distinct shingles of five words. Equal sets are
one node. Tiles are (prefix shingle, size band): in one order of all shingles, linked sets share one of their first
|A| - ceil(0.75 |A|) + 1, and their sizes differ by a third at most, so they meet in the tile of a shared prefix
shingle and of the larger one's band or the one below. Any order gives whole results; shingles are ordered by how often they
occur (counted in a sketch of fixed size), so that a passage shared by many documents opens no tile.

Inside tiles pairs are tested in two steps, so that a group of g near copies costs g tests and not g squared:

1. stars: each set against the leaders, in the tiles of the last few shingles of its prefix, that it shares most of these with;
2. the rest: all pairs of a tile, of whole prefixes, that the links found so far do not connect already, and whose places in
   both prefixes leave room for the intersection (they do at the first shingle that a linked pair shares), judged at the first
   shingle that a pair shares and not again where one of the last few before it is shared.

A pair is first bounded by bitmaps (every bit that A has and B lacks is a shingle that B lacks), then its sorted
shingle arrays are intersected exactly. Connected components are found by label propagation on written tables.
Nothing of the documents is gathered on the driver; it only holds the sketch, a byte for each of 2^22 buckets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import whole, written

SIZE = 5
BITS = 2_048
SKETCH_BITS = 22  # buckets that shingles are counted in, for the order of the prefixes: 4 MB
CHUNK = 4_096
LAST = 8  # places of a prefix that look for leaders
ROUNDS = 3
LEADS = 4  # leaders of a tile in a round
LEADERS = 8  # that a set is tested against in a round
EARLIER = 16  # shingles before its own that a row of an open tile knows
FOLDED = 8  # words of its bitmap that it knows
FLUSH = 4_000_000
BLOCK = 1 << 18  # bytes of text that are coded at once
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


_UP, _DOWN = _powers(int(ODD), BLOCK), _powers(pow(int(ODD), -1, 1 << 64), BLOCK)
_NONE = np.empty(0, np.int64)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: A term for each byte, the same for a letter A-Z and its lower case.
_BYTES = _mixed((np.arange(1, 257) + 32 * np.isin(np.arange(256), range(65, 91))).astype(np.uint64) * ODD)


def _word_codes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, code) of every word of `data`; a word also begins at each of `breaks`.

    A code is a polynomial of the word's bytes, read off the running sum of all bytes' terms, so that no word is handled alone.
    """
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[breaks] = inside[breaks]
    ends = np.ones(len(data) + 1, bool)
    ends[:-1] = ~inside | begins
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends[1:] & inside) + 1
    up, down = (_UP, _DOWN) if len(data) <= BLOCK else (_powers(int(ODD), len(data)), _powers(pow(int(ODD), -1, 1 << 64), len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return starts, _mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def _joined(codes: np.ndarray, size: int) -> np.ndarray:
    joined = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        joined = joined * ODD + codes[k : len(codes) - size + 1 + k]
    return _mixed(joined).view(np.int64)


def _sets(codes: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; its words' codes lie between two cuts."""
    ranges = [(a, b, b - SIZE + 1 if b - a >= SIZE else a) for a, b in itertools.pairwise(cuts.tolist())]
    if len(codes) < SIZE:
        joined, new = codes, codes
    else:
        joined = _joined(codes, SIZE)
        for a, _, end in ranges:
            joined[a:end].sort()
        new = np.ones(len(joined), bool)
        np.not_equal(joined[1:], joined[:-1], out=new[1:])
        new[cuts[cuts < len(new)]] = True
    return [joined[a:end][new[a:end]] if end > a else _joined(codes[a:b], b - a) if b > a else _NONE for a, b, end in ranges]


def _long_set(data: np.ndarray) -> np.ndarray:
    """The set of a text longer than a block, block by block, each cut after white space."""
    spaces, codes, at = np.flatnonzero(_SPACE[data]), [], 0
    while at < len(data):
        end = len(data)
        if end - at > BLOCK:
            k = np.searchsorted(spaces, at + BLOCK)
            if k and spaces[k - 1] >= at:
                end = int(spaces[k - 1]) + 1
            elif k < len(spaces):
                end = int(spaces[k]) + 1
        codes.append(_word_codes(data[at:end], np.zeros(1, np.int64))[1])
        at = end
    codes = np.concatenate(codes)
    return _sets(codes, np.array([0, len(codes)]))[0]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of every text: the sorted distinct 64-bit codes of its shingles, A-Z lower-cased; none without words.

    Reads the texts' UTF-8 bytes where Arrow holds them, about a block at a time.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    sets: list[np.ndarray] = []
    while len(sets) < len(texts):
        first = len(sets)
        last = int(np.searchsorted(bounds, bounds[first] + BLOCK, "right")) - 1
        if last <= first:
            sets.append(_long_set(data[bounds[first] : bounds[first + 1]]))
            continue
        last = min(last, len(texts))
        at = bounds[first : last + 1] - bounds[first]
        if not at[-1]:
            sets += [_NONE] * (last - first)
            continue
        starts, codes = _word_codes(data[bounds[first] : bounds[last]], at[:-1][at[:-1] < at[-1]])
        sets += _sets(codes, np.searchsorted(starts, at))
    return sets


def shingles(text: str) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.large_string()))[0]


def node_of(codes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(codes.tobytes())).astype(np.int64))


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def bitmap(codes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(codes.view(np.uint64) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part, shingle_sets(part.column(column))


def frequency_classes(texts: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """How often shingles occur, by their leading `bits`: a class of about a sixteenth of a power of two for each bucket.

    They only order the prefixes. The result of the join doesn't depend on them, its cost does. A task counts each of its distinct sets
    once and sends what its buckets hold, by chunk; chunks are added up as they come in, and the driver gets one byte a bucket,
    4 MB whatever the data's size.
    """
    chunk = min(CHUNK, 1 << bits)
    chunks = (1 << bits) // chunk

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.uint8)
        seen: set[int] = set()
        for _, sets in _batches(batches, 0):
            new = []
            for s in sets:
                node = node_of(s)
                if len(s) and node not in seen:
                    new.append(s)
                if len(seen) < 1_000_000:
                    seen.add(node)
            if new:
                at, n = np.unique(_buckets(np.concatenate(new), bits), return_counts=True)
                held[at] = np.minimum(held[at] + n, 255)
        for first in range(0, chunks, 256):
            packed = [_packed(held[k * chunk : (k + 1) * chunk]) for k in range(first, min(first + 256, chunks))]
            rows = [k for k, p in enumerate(packed) if p]
            yield pa.RecordBatch.from_arrays([pa.array([first + k for k in rows], pa.int32()), pa.array([packed[k] for k in rows], pa.binary())], names=["chunk", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _unpack(counts, sums.setdefault(k, np.zeros(chunk, np.int64)))
        classes = [np.minimum(16 * np.log2(np.maximum(n, 1)), 255).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(classes, pa.binary())], names=["chunk", "classes"])

    held = texts.select("text").mapInArrow(counted, "chunk int, counts binary").repartition("chunk").mapInArrow(added, "chunk int, classes binary")
    classes = np.zeros((chunks, chunk), np.uint8)
    rows = held.toArrow()
    for k, one in zip(rows.column(0).to_pylist(), rows.column(1)):
        classes[k] = np.frombuffer(one.as_buffer(), np.uint8)
    return classes.ravel()


def _buckets(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a chunk: those above 0 with their places, or all of them, whichever is shorter."""
    at = np.flatnonzero(counts)
    return counts.tobytes() if 3 * len(at) >= len(counts) else at.astype(np.uint16).tobytes() + counts[at].tobytes()


def _unpack(packed: bytes, sums: np.ndarray) -> None:
    if len(packed) == len(sums):
        sums += np.frombuffer(packed, np.uint8)
    else:
        n = len(packed) // 3
        sums[np.frombuffer(packed, np.uint16, n)] += np.frombuffer(packed, np.uint8, n, 2 * n)


def nodes(texts: DataFrame, id_type: str) -> DataFrame:
    """(id, n, node, bits) of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _batches(batches, 1):
            bits = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64), np.concatenate([bitmap(s) for s in sets]))
            columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), bits]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "node", "bits"])

    return texts.mapInArrow(made, f"id {id_type}, n long, node long, bits array<long>")


def prefix_postings(texts: DataFrame, classes: np.ndarray) -> DataFrame:
    """(shingle, node, n, place): the prefix of every set, rare classes first, by code in a class."""
    bits = len(classes).bit_length() - 1
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        seen: set[int] = set()
        for _, sets in _batches(batches, 0):
            keys, owners, sizes, places_in = [], [], [], []
            for s in sets:
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                s = s[np.argsort(of[_buckets(s, bits)], kind="stable")]
                first = s[: prefix_length(len(s))]
                keys.append(first)
                owners.append(np.full(len(first), node, np.int64))
                sizes.append(np.full(len(first), len(s), np.int32))
                places_in.append(np.arange(len(first), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owners, sizes, places_in)], names=["shingle", "node", "n", "place"])

    return texts.select("text").mapInArrow(posted, "shingle long, node long, n int, place int")


def _bodies(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, text): one text for every node of `sets`. Each task sends a node once, so that a large group of copies isn't gathered."""

    def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, made in _batches(batches, 0):
            owners = [node_of(s) for s in made]
            new = []
            for node in owners:
                new.append(node not in seen)
                if len(seen) < 1_000_000:
                    seen.add(node)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), part.column(0)], names=["node", "text"]).filter(pa.array(new, pa.bool_()))

    placed = texts.select("text").mapInArrow(with_node, "node long, text string")
    return placed.join(sets.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` whose sets link, by exact intersection; texts has (node, text), one row a node."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = []
                for k, (b, left) in enumerate(zip(part.column(1).to_pylist(), shingle_sets(part.column(2)))):
                    if b != last:
                        last, right = b, shingle_sets(part.column(3).slice(k, 1))[0]
                    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
                    keep.append(7 * np.count_nonzero(right[at] == left) >= 3 * (len(left) + len(right)))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], names=["a", "b"])

    # either text meets the pairs first: few pairs go to the texts, and a leader's many pairs are spread by both keys
    left, right = (pairs.join(texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")), x) for x in "ab")
    return left.join(right, ["b", "a"]).select("a", "b", "text_a", "text_b").mapInArrow(linked, "a long, b long")


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps leave room for a link."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    most = F.least(F.col("n_a") - F.expr(_lacking("a", "b")), F.col("n_b") - F.expr(_lacking("b", "a")))
    return pairs.where(7 * most >= 3 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _lacking(one: str, other: str) -> str:
    """How many bits one set has and the other lacks."""
    return " + ".join(f"bit_count(bits_{one}[{k}] & ~bits_{other}[{k}])" for k in range(BITS // 64))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links lead to, for every node of an edge."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "jaccard-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lowest"))
        step = written(lower.join(jump, "low").select("node", F.col("label").alias("before"), "lowest"), "jaccard-labels")
        labels = step.select("node", F.col("lowest").alias("label"))
        if step.where("before <> lowest").isEmpty():
            return labels


def jaccard_components(docs: DataFrame, doc_id="doc_id", text="text", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Null and empty texts, and texts without words, have no shingles and link with nothing; fewer than five words are one
    shingle. Repeated rows have equal sets, so they are linked. A null identifier is never the smallest of
    its component unless all are null. An empty table gives an empty result; other columns are ignored. Equal 64-bit
    digests count as equal sets.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("id"), whole(text).alias("text"))
    rows = written(nodes(texts, kind), "jaccard-nodes")
    some = rows.where("n > 0")
    postings = prefix_postings(texts, frequency_classes(texts, sketch_bits))
    # a copy's own changes come first in its order, what it shares with its group comes last
    last = F.col("place") >= F.expr("n - (3L * n + 3) div 4 + 1") - LAST
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")
    met = _with_room(_shared(postings, "node").distinct()).withColumn("band", band)
    met = written(met.where(F.col("room") | last), "jaccard-met")
    tiles = met.where("room").drop("room")
    involved = tiles.select("node").distinct()
    sets = written(some.join(involved, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "jaccard-sets")
    bodies = written(_bodies(texts, sets), "jaccard-texts")
    edges = tested = None
    firsts = met.where(last).join(involved, "node", "left_semi")
    firsts = written(firsts.select("shingle", "band", "node", "place"), "jaccard-firsts")
    labelled, labels, open_tiles = firsts.withColumn("label", F.col("node")), None, tiles
    for turn in range(ROUNDS):
        leads = F.array(*[F.min_by(F.struct("node", "label"), _lead(turn * LEADS + k)) for k in range(LEADS)])
        leads = labelled.groupBy("shingle", "band").agg(F.array_distinct(leads).alias("leads")).select("shingle", "band", F.explode("leads").alias("lead"))
        stars = labelled.join(leads, ["shingle", "band"]).where("label <> lead.label")
        counted = stars.groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).agg(F.count(F.lit(1)).alias("k"))
        if tested is not None:
            done = tested.union(tested.select("b", "a"))
            counted = counted.join(done, ["a", "b"], "left_anti")
        best = Window.partitionBy("a").orderBy(F.desc("k"), "b")
        pairs = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= LEADERS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if step := _tested(pairs, sets, bodies, edges, tested):
            edges, tested = step
            labels = components(edges)
        elif turn:
            break
        labelled = _with_room(_shared(_labelled(open_tiles, labels), "label")).where("room")
        labelled = written(labelled.select("shingle", "band", "node", "n", "place", "label"), "jaccard-open")
        open_tiles = labelled.drop("label")
    rest = _rest(written(_labelled(_with_hints(labelled, sets), labels), "jaccard-rest"))
    rest = rest.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    if step := _tested(rest, sets, bodies, edges, tested):
        edges = step[0]
    labels = tiles.select("node", F.col("node").alias("label")).where("false") if edges is None else components(edges)
    least = some.groupBy("node").agg(F.min("id").alias("first"))
    grouped = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    to = grouped.join(lowest, "label").select("node", "component_id")
    placed = rows.select("id", "n", F.expr("if(n > 0, node, null)").alias("node")).join(to, "node", "left")
    return placed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _lead(turn: int) -> Column:
    """Leaders come first by this: the set with the fewest changes of its own before the shingle, later any, so mostly one of the largest component."""
    return F.struct("place", F.xxhash64("node")) if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "node"))


def _labelled(tiles: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The tiles with the component of every node, so far."""
    if labels is None:
        return tiles.withColumn("label", F.col("node"))
    return tiles.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _shared(rows: DataFrame, owner: str) -> DataFrame:
    """The rows whose shingle has rows of another `owner` too."""
    tile = Window.partitionBy("shingle")
    met = rows.select("*", F.min(owner).over(tile).alias("least"), F.max(owner).over(tile).alias("most"))
    return met.where("least <> most").drop("least", "most")


def _with_room(rows: DataFrame) -> DataFrame:
    """Whether a row may be where a linked pair first shares a shingle (`room`), by what its tile holds.

    There, with sets x and y in order of (size, node), x's reach, 4 n - 7 place, is 3 times y's size at least and y's reach 3 times x's:
    both still hold the whole intersection. A row before and one after, in this order, stand for any partner, so none is missed; in a
    tile of two rows it's exact.
    """
    up = Window.partitionBy("shingle").orderBy("n", "node")
    down = Window.partitionBy("shingle").orderBy(F.desc("n"), F.desc("node"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = down.rowsBetween(Window.unboundedPreceding, -1)  # a running maximum, which one over following rows is not
    reach = F.expr("4L * n - 7L * place")
    own = rows.columns
    seen = rows.select(
        "*",
        reach.alias("reach"),
        F.max(reach).over(before).alias("reach_before"),
        F.min("n").over(before).alias("least_before"),
        F.max(reach).over(after).alias("reach_after"),
        F.lead("n").over(up).alias("least_after"),
    )
    larger = "reach_before >= 3L * n and reach >= 3L * least_before"
    smaller = "reach_after >= 3L * n and reach >= 3L * least_after"
    return seen.select(*own, F.expr(f"coalesce({larger}, false) or coalesce({smaller}, false)").alias("room"))


def _with_hints(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n, fold, rows): every set with its bitmap folded and its rows in tiles, each with the open shingles just before its own."""
    before = Window.partitionBy("node").orderBy("place").rowsBetween(-EARLIER, -1)
    rows = tiles.withColumn("earlier", F.collect_list("shingle").over(before)).groupBy("node").agg(F.collect_list(F.struct("shingle", "band", "place", "earlier")).alias("rows"))
    fold = F.array(*[F.expr(" | ".join(f"bits[{k}]" for k in range(j, BITS // 64, FOLDED))) for j in range(FOLDED)])
    return sets.select("node", "n", fold.alias("fold")).join(rows, "node", "left")


def _rest(known: DataFrame) -> DataFrame:
    """(x, node) of each tile's pairs of unlike labels that may link, the smaller set first; as rows of a pair as few as can be told here.

    At the first shingle that a linked pair shares, either set still holds the whole intersection, so the smaller one is in the first
    seventh of its order. A pair that shares one of the shingles before was judged there. Folded bitmaps bound pairs as whole ones do.
    """
    tiles = known.select("node", "n", "label", "fold", F.inline("rows"))
    own = ["n", "place", "label", "earlier", "fold"]
    smaller = tiles.where("7L * place <= n").withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    x = smaller.select("shingle", "band", F.col("node").alias("x"), *[F.col(c).alias(f"{c}_x") for c in own])
    lacks = [" + ".join(f"bit_count({a}[{k}] & ~{b}[{k}])" for k in range(FOLDED)) for a, b in (("fold_x", "fold"), ("fold", "fold_x"))]
    may = [
        "label_x <> label and (n_x < n or n_x = n and x < node)",
        "7L * least(n_x - place_x, n - place) >= 3L * (n_x + n)",
        f"7L * least(n_x - ({lacks[0]}), n - ({lacks[1]})) >= 3L * (n_x + n)",
        "not arrays_overlap(earlier_x, earlier)",
    ]
    return x.join(tiles, ["shingle", "band"]).where(" and ".join(f"({m})" for m in may)).select("x", "node")


def _tested(pairs: DataFrame, sets: DataFrame, bodies: DataFrame, edges: DataFrame | None, tested: DataFrame | None) -> tuple[DataFrame, DataFrame] | None:
    """Test the pairs that were not tested before: all links and all tested pairs so far; none if nothing was left to test."""
    fresh = bounded(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), sets)
    fresh = written(fresh, "jaccard-pairs")
    if fresh.isEmpty():
        return None
    found = written(verified(fresh, bodies), "jaccard-edges")
    return (found if edges is None else edges.union(found)), (fresh if tested is None else tested.union(fresh))


def near_dedup(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns, whatever their names: of each component one row with the smallest identifier.

    Rows are told apart by identifier and text, so rows that share an identifier, or have none, stay unless their texts link. Null identifiers
    come last. Texts without words link with nothing, so all such rows stay; of equal rows with words one stays. An empty table gives an
    empty result.
    """
    own = F.struct(F.col(doc_id).isNull().alias("lacks"), F.col(doc_id).alias("id"), F.xxhash64(whole(text)).alias("text")).alias("own")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own)
    found = jaccard_components(rows.select("own", F.col("row").getField(text).alias("text")), "own")
    stays = found.where("doc_id = component_id").select(F.to_json("doc_id").alias("key"), (F.col("n_shingles") > 0).alias("some")).distinct()
    same = Window.partitionBy("key").orderBy(F.lit(0))
    kept = rows.withColumn("key", F.to_json("own")).join(stays, "key").withColumn("n", F.row_number().over(same))
    return kept.where("n = 1 OR NOT some").select("row.*")
