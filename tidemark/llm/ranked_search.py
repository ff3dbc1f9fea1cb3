"""Ranked lexical search by pipelined term partitioning.

Each term has one owner stage; the rarest terms, which weigh most, belong to the first one. A bundle is an item in a shard of the
documents. It starts empty and goes from stage to stage, where a cogroup brings it together with the postings of the stage's terms in its
shard; the owner adds whole-number contributions to the bundle's sparse document accumulators and passes it on. After the last
stage each shard selects its best documents of an item, and these meet for the final selection.

Between stages an item learns a score that its last place has already reached over all shards. A document that can't reach it with all that
the later stages could still add is dropped from the bundle; contributions are never negative, so no result is lost.

Shards are dealt by hash and grow in number with the documents, so a group holds about `SHARD_DOCS` documents, whatever a term's
frequency, and its scores are a matrix of at most block items x these. Items are worked on in blocks of about `BLOCK_TERMS` distinct terms;
only a block's terms (with their document counts and weights) are held on the driver and broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import whole, written

TOP = 10
STAGES = 4
SHARD_DOCS = 4_096
BLOCK_TERMS = 50_000  # (item, term) pairs of a block, about
SCALE, UNIT, LENGTH_SHARE = 1_000_000_000, 1_000, 75  # fixed values of the score
_INNER = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 128 or b in _INNER else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Maximal matches of ASCII letters, digits and all other characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of items (item, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [terms_of(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.binary()))], names=["item", "terms"])

    found = items.select("item", "text").mapInArrow(split, "item long, terms array<binary>")
    return found.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row of (doc_id, text): how many terms it has, and those of the vocabulary, by number, with their counts."""
    numbers = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value.get
        for batch in batches:
            lengths, ends, terms, counts = [], [0], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                found = terms_of(text.as_py())
                lengths.append(len(found))
                term, tf = np.unique(np.array([k for k in map(number, found) if k is not None], np.int32), return_counts=True)
                terms.append(term)
                counts.append(tf.astype(np.int32))
                ends.append(ends[-1] + len(term))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(counted, f"doc_id {id_type}, n long, terms array<int>, tfs array<int>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def share(tf, m):
    """What an occurrence count of a document of norm m adds for each unit of the term's weight."""
    return (SCALE * tf) // (UNIT * tf + 8 * m)


def owners(documents: np.ndarray, stages: int) -> np.ndarray:
    """The stage of every term: rarest first, about as many postings in each."""
    order = np.argsort(documents, kind="stable")
    before = np.cumsum(documents[order]) - documents[order]
    stage = np.empty(len(order), np.int64)
    stage[order] = np.minimum(before * stages // max(int(documents.sum()), 1), stages - 1)
    return stage


def _postings(counts: DataFrame, stage_of, stage: int, last: bool) -> DataFrame:
    """(shard, row, doc_id, m, terms, tfs) of a stage's terms; documents without any only where doc_id is needed, in the last stage."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(k) for k in (4, 5)]
            flat = [pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in lists]
            mine = stage_of.value[flat[0]] == stage if len(flat[0]) else np.empty(0, bool)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))))
            ends = pa.array(np.concatenate(([0], np.cumsum(mine)))[ends].astype(np.int32))
            columns = [*(batch.column(k) for k in range(4)), *(pa.ListArray.from_arrays(ends, pa.array(x[mine], pa.int32())) for x in flat)]
            made = pa.RecordBatch.from_arrays(columns, names=["shard", "row", "doc_id", "m", "terms", "tfs"])
            yield made if last else made.filter(pc.greater(pc.list_value_length(made.column(4)), 0))

    return counts.select("shard", "row", "doc_id", "m", "terms", "tfs").mapInArrow(picked, counts.select("shard", "row", "doc_id", "m", "terms", "tfs").schema)


def _added(left: pa.Table, right: pa.Table, wanted: dict[int, list[tuple[int, int]]], weights: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents' rows, scores by item and document) after an owner's contributions."""
    carried = left.column("rows").combine_chunks()
    old, seen = pc.list_flatten(carried).to_numpy(), right.column("row").to_numpy()
    rows = np.unique(np.concatenate((old, seen)))
    scores = np.zeros((len(items), len(rows)), np.int64)
    at = np.searchsorted(items, left.column("item").to_numpy())
    owner = np.repeat(at, pc.list_value_length(carried).to_numpy(zero_copy_only=False))
    scores[owner, np.searchsorted(rows, old)] = pc.list_flatten(left.column("scores").combine_chunks()).to_numpy()
    lists = right.column("terms").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    term, tf = pc.list_flatten(lists).to_numpy(), pc.list_flatten(right.column("tfs").combine_chunks()).to_numpy().astype(np.int64)
    place = np.repeat(np.searchsorted(rows, seen), sizes)
    added = weights[term] * share(tf, np.repeat(right.column("m").to_numpy(), sizes)) if len(term) else tf
    order = np.argsort(term, kind="stable")
    cuts = np.flatnonzero(np.diff(term[order])) + 1
    for one in np.split(order, cuts):
        for item, times in wanted.get(int(term[one[0]]), ()) if len(one) else ():
            scores[item, place[one]] += times * added[one]
    return rows, scores


def _block(docs: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """(item, doc_id, score, row): the best documents of a block's items, up to `top` in each shard."""
    spark = docs.sparkSession
    pairs = asked.select("item", "term", F.col("times").cast("long")).toArrow()
    coded = pairs.column("term").combine_chunks().dictionary_encode()
    vocabulary, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    items, item_at = np.unique(pairs.column("item").to_numpy(), return_inverse=True)
    times = pairs.column("times").to_numpy()
    counts = term_counts(docs, vocabulary).withColumn("row", F.monotonically_increasing_id())
    counts = written(counts, "search-counts")
    total = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count(F.lit(1)).alias("rows")).first()
    n_docs, n_terms = total["documents"], max(total["terms"], 1)
    shards = max(1, -(-total["rows"] // SHARD_DOCS))
    counts = counts.withColumns({
        "shard": F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"),
        "m": F.lit(100 - LENGTH_SHARE) + F.expr(f"({LENGTH_SHARE}L * n * {n_docs}L) div {n_terms}L"),
    })
    posting = counts.select("m", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    of_term = posting.groupBy(F.col("p.terms").alias("term")).agg(
        F.count(F.lit(1)).alias("documents"), F.max(F.expr(f"({SCALE}L * p.tfs) div ({UNIT}L * p.tfs + 8 * m)")).alias("most")
    ).toArrow()
    documents, most = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    documents[of_term.column("term").to_numpy()], most[of_term.column("term").to_numpy()] = of_term.column("documents").to_numpy(), of_term.column("most").to_numpy()
    weights = np.array([weight(n_docs, int(d)) for d in documents], np.int64)
    stage_of = owners(documents, STAGES)
    wanted = {t: [] for t in range(len(vocabulary))}
    for item, t, k in zip(item_at.tolist(), number.tolist(), times.tolist()):
        wanted[t].append((item, k))
    later = np.zeros((STAGES + 1, len(items)), np.int64)  # the most that stages from s on add to an item's score
    for s in reversed(range(STAGES)):
        later[s] = later[s + 1]
        mine = stage_of[number] == s
        np.add.at(later[s], item_at[mine], (times * weights[number] * most[number])[mine])
    shared = spark.sparkContext.broadcast((wanted, weights, items, later))
    stage_numbers = spark.sparkContext.broadcast(stage_of)
    bundles = asked.select("item").distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    bundles = bundles.selectExpr("shard", "item", "0L AS reached", "cast(array() AS array<bigint>) AS rows", "cast(array() AS array<bigint>) AS scores")
    for s in range(STAGES):
        right = _postings(counts, stage_numbers, s, s == STAGES - 1).groupBy("shard")
        if s == STAGES - 1:
            break
        bundles = written(bundles.groupBy("shard").cogroup(right).applyInArrow(_stage(shared, s, top), "shard int, item long, rows array<long>, scores array<long>, best array<long>"), "search-bundles")
        ranked = bundles.select("item", F.explode("best").alias("score")).withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
        reached = ranked.where(F.col("place") == top).select("item", F.col("score").alias("reached"))
        bundles = bundles.join(reached, "item", "left").select("shard", "item", F.coalesce("reached", F.lit(0)).alias("reached"), "rows", "scores")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return bundles.groupBy("shard").cogroup(right).applyInArrow(_selection(shared, top), f"item long, doc_id {id_type}, score long, row long")


def _stage(shared, stage: int, top: int):
    def owned(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, weights, items, later = shared.value
        if not left.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), **{c: pa.array([], t) for c, t in (("item", pa.int64()), ("rows", _LONGS), ("scores", _LONGS), ("best", _LONGS))}})
        rows, scores = _added(left, right, wanted, weights, items)
        reached = dict(zip(left.column("item").to_pylist(), left.column("reached").to_pylist()))
        kept = {"rows": [], "scores": [], "best": []}
        for k, item in enumerate(items.tolist()):
            some = np.flatnonzero(scores[k])
            mine = scores[k, some]
            best = -np.sort(-mine)[:top]
            bar = max(reached.get(item, 0), int(best[-1]) if len(best) == top else 0)
            good = mine + later[stage + 1, k] >= bar
            kept["rows"].append(rows[some[good]])
            kept["scores"].append(mine[good])
            kept["best"].append(best)
        shard = left.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard] * len(items), pa.int32()), "item": pa.array(items), **{c: pa.array(x, _LONGS) for c, x in kept.items()}})

    return owned


def _selection(shared, top: int):
    def selected(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, weights, items, _ = shared.value
        ids = right.column("doc_id").combine_chunks()
        found = {"item": [], "place": [], "score": []}
        if left.num_rows and right.num_rows:
            _, scores = _added(left, right, wanted, weights, items)  # the last stage has every document of the shard, so its rows are all
            by_row = pc.sort_indices(right.column("row").combine_chunks()).to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            rank = rank[by_row]
            for k, item in enumerate(items.tolist()):
                some = np.flatnonzero(scores[k])
                some = some[np.lexsort((rank[some], -scores[k, some]))[:top]]
                found["item"] += [item] * len(some)
                found["place"] += by_row[some].tolist()
                found["score"] += scores[k, some].tolist()
        place = pa.array(found["place"], pa.int64())
        return pa.table({"item": pa.array(found["item"], pa.int64()), "doc_id": ids.take(place), "score": pa.array(found["score"], pa.int64()), "row": right.column("row").combine_chunks().take(place)})

    return selected


_LONGS = pa.list_(pa.int64())


def ranked_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of `items` its `top` best rows of `docs` with a score above 0, fewer if there are not as many.

    Null and empty texts, and texts without terms, score nothing; an item without terms has no rows. Repeated rows are documents, or
    items, of their own: a repeated item comes out as often as it is given, with the same ranks. Equal scores go by ascending identifier, null
    ones last. An empty table on either side gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    asked = written(items.select(F.col(item_id).alias("item_id"), whole(item_text).alias("text")).withColumn("item", F.monotonically_increasing_id()), "search-items")
    terms = written(item_terms(asked), "search-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    found = None
    for block in range(blocks):
        part = _block(rows, terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), top)
        found = part if found is None else found.union(part)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    placed = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return placed.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
