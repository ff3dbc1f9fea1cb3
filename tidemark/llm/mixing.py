"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every source is cut into blocks of documents by a hash. Its target says how often it is passed over:
   whole passes take every block, the last one takes the blocks of a random order until the target is met
   (the last block document by document). Every (pass, block) taken is one unit of the source's quota.
2. The quotas are split among output shards down a binary tree. A node's left child gets a fixed number of
   units, and how many come from each source is one multivariate-hypergeometric draw (univariate draws
   in turn, each by inversion from the mode outwards), so leaves add up to the quotas exactly.
3. Each leaf takes its counts from disjoint ranges of the source's permuted units, and every shard is
   shuffled locally.

All draws are hashes of the seed, so reruns agree. Only block totals (at most `blocks` rows a source)
and the tree's counts (one number a source and node) are ever put in order by source; documents move once,
by (source, block), so a source with a third of all rows is spread over `blocks` groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import without, words

BLOCKS = 1024
SHARDS = 16
SEED = 20
MAX_REPEATS = 3
ADDED = ("size", "source_size", "target", "draws", "__key", "__block", "__within", "__start", "__full", "__rest")


def mix_plan(docs: DataFrame, doc_id="doc_id", source="source", text="text", blocks=BLOCKS, shards=SHARDS, seed=SEED) -> DataFrame:
    """`docs` with size, source_size, target and draws: one (pass, shard) for each time the row is taken.

    A null text has size 0; a null source is a source of its own, last in order. Rows are drawn one by
    one, so repeated rows and identifiers are several rows. An empty table gives an empty result.
    Columns of `docs` named like an added one are replaced.
    """
    own = without(docs, [*ADDED, "__size"])
    return _planned(own.select("*", *_dealt(docs, doc_id, source, text, blocks, seed)), doc_id, shards, seed)


def _dealt(docs: DataFrame, doc_id: str, source: str, text: str, blocks: int, seed: int) -> list[Column]:
    """Size, source key and block of a row."""
    return [
        F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`")), F.lit("n")).alias("__key"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`")), F.lit(blocks)).cast("int").alias("__block"),
    ]


def _planned(sized: DataFrame, doc_id: str, shards: int, seed: int) -> DataFrame:
    totals = sized.groupBy("__key", "__block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("__key", "__block").orderBy(F.xxhash64(F.lit(seed + 1), F.col(doc_id)), doc_id, "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("__within", before).join(drawn_blocks(totals, shards, seed), ["__key", "__block"])
    taken = F.filter(
        "draws",
        lambda d: (d["pass"] < F.col("__full"))
        | ((F.col("size") > 0) & (F.col("__start") + F.col("__within") + F.col("size") / 2 < F.col("__rest"))),
    )
    return placed.withColumn("draws", taken).drop("__key", "__block", "__within", "__start", "__full", "__rest")


def mixed(docs: DataFrame, doc_id="doc_id", source="source", text="text", **settings) -> DataFrame:
    """The mix itself: the columns of `docs`, a row for each time it is taken, ordered at random in each shard.

    Null texts and sources, repeated rows and empty tables as in `mix_plan`; all columns come back as they were, whatever their names.
    """
    seed = settings.get("seed", SEED)
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole_row, F.col(doc_id).alias("id"), *_dealt(docs, doc_id, source, text, settings.get("blocks", BLOCKS), seed))
    drawn = _planned(rows, "id", settings.get("shards", SHARDS), seed).withColumn("draw", F.explode("draws"))
    drawn = drawn.withColumn("shuffle", F.xxhash64(F.lit(seed + 2), "id", "draw.pass"))
    return drawn.repartitionByRange(F.col("draw.shard"), F.col("shuffle")).sortWithinPartitions("draw.shard", "shuffle").select("row.*")


def source_targets(totals: DataFrame) -> DataFrame:
    """(__key, source_size, target): weights 1, 2, 3 in turn, no target above three times its source's size.

    The level at which weights are served is found as in filling vessels: sources in order of their limit
    per weight, each full one leaving its excess to the rest.
    """
    limit = F.lit(MAX_REPEATS) * F.col("source_size")
    every = Window.orderBy(F.expr("__key = 'n'"), "__key")
    fill = Window.orderBy("per_weight", "rank")
    sources = (
        totals.groupBy("__key")
        .agg(F.sum("words").alias("source_size"))
        .withColumn("rank", F.row_number().over(every))
        .withColumn("weight", (F.col("rank") - 1) % 3 + 1)
        .withColumn("per_weight", limit / F.col("weight"))
        .withColumn("full_before", F.coalesce(F.sum(limit).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all_size", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("all_size") - F.col("full_before")) / F.col("open_weight"))
        .withColumn("is_full", F.col("per_weight") <= F.col("level"))
        .withColumn("level", F.max(F.expr("if(is_full, null, level)")).over(Window.partitionBy()))
    )
    target = F.when(F.col("is_full"), limit.cast("double")).otherwise(F.col("level") * F.col("weight"))
    return sources.select("__key", "source_size", target.alias("target"))


def drawn_blocks(totals: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Each (source, block) with its place in the source's order and the (pass, shard) of its units."""
    ratio = F.expr(f"if(source_size > 0, least({MAX_REPEATS}, floor(target / source_size)), 0)").cast("int")
    shuffled = Window.partitionBy("__key").orderBy(F.xxhash64(F.lit(seed + 3), "__key", "__block"), "__block")
    placed = (
        totals.join(source_targets(totals), "__key")
        .withColumn("__full", ratio)
        .withColumn("__rest", F.col("target") - F.col("__full") * F.col("source_size"))
        .withColumn("__start", F.coalesce(F.sum("words").over(shuffled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("passes", F.col("__full") + F.expr("if(__start < __rest, 1, 0)"))
    )
    permuted = Window.partitionBy("__key").orderBy(F.xxhash64(F.lit(seed + 4), "__key", "pass", "__block"), "pass", "__block")
    units = (
        placed.where("passes > 0")
        .select("__key", "__block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
        .withColumn("unit", F.row_number().over(permuted).cast("long"))
    )
    leaves = shard_quotas(units.groupBy("__key").agg(F.count(F.lit(1)).alias("n")), shards, seed)
    along = Window.partitionBy("__key").orderBy("shard")
    ranges = leaves.withColumn("last", F.sum("n").over(along)).where("n > 0")
    slots = ranges.select("__key", "shard", F.explode(F.expr("sequence(last - n + 1, last)")).alias("unit"))
    draws = units.join(slots, ["__key", "unit"]).groupBy("__key", "__block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    none = F.expr("cast(array() as array<struct<pass: int, shard: int>>)")
    return placed.join(draws, ["__key", "__block"], "left").select(
        "__key", "__block", "source_size", "target", "__full", "__rest", "__start", F.coalesce("draws", none).alias("draws")
    )


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(__key, shard, n) from (__key, n): every source's units split among the shards."""
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("__key", "n"))).alias("q")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    for _ in range(max(0, (shards - 1).bit_length())):
        split = nodes.withColumn("mid", F.expr("cast(ceil((lo + hi) / 2) as int)")).withColumn(
            "take", F.expr("aggregate(q, 0L, (t, x) -> t + x.n) * (mid - lo) div (hi - lo)")
        )
        split = split.withColumn("mine", multivariate_draw("q", "take", f"{seed + 5}L, lo, hi"))
        left = "struct(lo, mid as hi, transform(q, (x, i) -> struct(x.__key, mine[i] as n)) as q)"
        right = "struct(mid as lo, hi, transform(q, (x, i) -> struct(x.__key, x.n - mine[i] as n)) as q)"
        nodes = split.select(F.explode(F.expr(f"if(hi - lo > 1, array({left}, {right}), array(struct(lo, hi, q)))")).alias("node")).select("node.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select("x.__key", "shard", "x.n")


def multivariate_draw(quotas: str, take: str, seeds: str) -> Column:
    """How many of `take` units come from each of `quotas`: conditional univariate draws in turn."""
    draw = hypergeometric("s.pool", "x.n", "s.take", _uniform(f"{seeds}, x.__key"))
    step = _let(draw, "got", "named_struct('pool', s.pool - x.n, 'take', s.take - got, 'out', array_append(s.out, got))")
    start = f"named_struct('pool', aggregate({quotas}, 0L, (t, x) -> t + x.n), 'take', {take}, 'out', cast(array() as array<bigint>))"
    return F.expr(f"aggregate({quotas}, {start}, (s, x) -> {step}, s -> s.out)")


def hypergeometric(pool: str, marked: str, take: str, uniform: str) -> str:
    """SQL for the number of marked units among `take` of `pool`, by inversion from the mode outwards.

    Weights are relative to the mode's, by the ratio of neighbouring probabilities, so nothing overflows;
    what underflows has no weight a double could show.
    """

    def ratio(k: str) -> str:
        """p(k) / p(k - 1)"""
        return f"((h.marked - {k} + 1D) * (h.take - {k} + 1D) / ({k} * (h.pool - h.marked - h.take + {k} + 0D)))"

    up, down = "if(h.hi > h.mode, sequence(h.mode + 1, h.hi), array())", "if(h.lo < h.mode, sequence(h.mode - 1, h.lo), array())"
    up, down = (f"cast({x} as array<bigint>)" for x in (up, down))
    risen, fallen = f"w.w * {ratio('k')}", f"w.w / {ratio('(k + 1)')}"
    total = "aggregate({}, named_struct('w', 1D, 'sum', 0D), (w, k) -> {}, w -> w.sum)"
    added = "named_struct('w', p, 'sum', w.sum + p)"
    sums = [total.format(seq, _let(p, "p", added)) for seq, p in ((up, risen), (down, fallen))]
    pick = "aggregate({}, named_struct('w', 1D, 'left', {}, 'at', cast(null as bigint)), (w, k) -> {}, w -> coalesce(w.at, {}))"
    found = "named_struct('w', p, 'left', w.left - p, 'at', coalesce(w.at, if(w.left < p, k, null)))"
    picks = [pick.format(seq, rest, _let(p, "p", found), end) for seq, rest, p, end in ((up, "(r - 1)", risen, "h.hi"), (down, "(r - 1 - up)", fallen, "h.lo"))]
    choose = f"case when r < 1 then h.mode when r - 1 < up then {picks[0]} else {picks[1]} end"
    chosen = _let(sums[0], "up", _let(f"({uniform}) * (1 + up + {sums[1]})", "r", choose))
    bounds = (
        "named_struct('pool', p0.pool, 'marked', p0.marked, 'take', p0.take, 'lo', greatest(0L, p0.take - p0.pool + p0.marked), 'hi', least(p0.marked, p0.take),"
        " 'mode', cast(least(least(p0.marked, p0.take), greatest(greatest(0L, p0.take - p0.pool + p0.marked),"
        " floor((p0.take + 1D) * (p0.marked + 1D) / (p0.pool + 2D)))) as bigint))"
    )
    given = f"named_struct('pool', cast({pool} as bigint), 'marked', cast({marked} as bigint), 'take', cast({take} as bigint))"
    return _let(_let(given, "p0", bounds), "h", chosen)


def _uniform(parts: str) -> str:
    return f"(shiftrightunsigned(xxhash64({parts}), 11) / 9007199254740992D)"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"
