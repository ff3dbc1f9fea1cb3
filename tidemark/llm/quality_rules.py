"""Quality rules: word and repetition limits, then a hashed n-gram log-likelihood ratio.

The words and word pairs of every text are hashed into a fixed number of buckets. Two multinomials over the
buckets are counted: one over the documents that are trusted, one over all. A document's score is the sum
over its n-grams of log(trusted / all), divided by the number of its n-grams, and it is kept when that
reaches a fixed threshold. Bucket weights are whole millionths, so sums don't depend on the order of
addition and the verdict is the same on every run.

No document is judged by counts it raised itself: documents fall into `FOLDS` parts by a hash of their identifier, and
each part's weights are counted over the other parts. Both multinomials are smoothed by the same number of trusted
occurrences a bucket, so an n-gram that is too rare to tell weighs about 0, whatever the size of the corpus.

Only the bucket weights (`FOLDS * buckets` numbers) reach every task; texts move once, when the trusted documents
are marked. That join is a sort-merge join at every size: the list of trusted documents grows with the data,
so it is never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import WORD, whole, without, words

BUCKETS = 10_000
FOLDS = 16  # by the first hexadecimal digit of the identifier's MD5
SMOOTH = 30  # trusted occurrences added to each bucket
# Natural log, mean per n-gram, set on documents with labels at three sizes; tests/llm hold the shares that stay and go.
MIN_SCORE = -0.05
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
A_WORD = WORD.removesuffix("+")
UNIT = 1_000_000
FEW = 64
PAIR = 40_503  # a pair of words is coded as first * PAIR + second
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
ADDED = (*MEASURES, "n_grams", "score", "kept")


def word_codes(text: str | Column) -> Column:
    """The CRC-32 of every word, in order."""
    return F.transform(words(text), lambda w: F.crc32(w))


def pair_code(first: str, second: str) -> str:
    return f"({first} * {PAIR} + {second})"


def fold(doc_id: str) -> Column:
    """The part of the corpus a document belongs to; null identifiers share the first."""
    digit = F.substring(F.md5(F.col(doc_id).cast("string").cast("binary")), 1, 1)
    return F.coalesce(F.conv(digit, 16, 10).cast("int"), F.lit(0))


def bucket_weights(docs: DataFrame, trusted: DataFrame, doc_id="doc_id", text="text", buckets: int = BUCKETS) -> DataFrame:
    """(fold, bucket, weight) for every bucket: millionths of log(trusted share / overall share) in the other folds."""
    marks = trusted.select(F.col(trusted.columns[0]).alias("__id"), F.lit(1).alias("__trusted")).distinct()
    marked = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(marks.hint("merge"), "__id", "left")
    coded = marked.select("__trusted", fold("__id").alias("fold"), word_codes("__text").alias("c"))
    pairs = coded.select("__trusted", "fold", F.explode(F.arrays_zip("c", F.expr("if(size(c) > 1, slice(c, 2, greatest(size(c) - 1, 1)), cast(array() as array<bigint>))"))).alias("p"))
    pairs = pairs.select("__trusted", "fold", F.col("p.c").alias("x"), F.col("p.`1`").alias("y"))
    codes = F.array(F.col("x"), F.expr(pair_code("x", "y")))
    grams = pairs.select("__trusted", "fold", F.explode(codes).alias("code"))
    grams = grams.where("code IS NOT NULL").select("__trusted", "fold", F.pmod("code", F.lit(buckets)).cast("int").alias("bucket"))
    counts = grams.groupBy("fold", "bucket").agg(F.count("__trusted").alias("t"), F.count(F.lit(1)).alias("r"))
    # from here on FOLDS * buckets rows, whatever the corpus
    every = docs.sparkSession.range(FOLDS * buckets).selectExpr(f"cast(id div {buckets} as int) AS fold", f"cast(id % {buckets} as int) AS bucket")
    full = every.join(counts, ["fold", "bucket"], "left").na.fill(0, ["t", "r"])
    others = [(F.sum(c).over(Window.partitionBy("bucket")) - F.col(c)).cast("double").alias(c) for c in ("t", "r")]
    full = full.select("fold", "bucket", *others)
    all_t, all_r = (F.sum(c).over(Window.partitionBy("fold")) for c in ("t", "r"))
    expected = F.when(all_r > 0, F.col("r") * all_t / all_r).otherwise(F.lit(0.0))
    weight = F.log((F.col("t") + SMOOTH) / (expected + SMOOTH))
    return full.select("fold", "bucket", F.round(weight * UNIT).cast("long").alias("weight"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with its base measures and `__codes`, the codes of its words."""
    body = whole(text)
    lines = F.filter(F.split(body, "\n"), lambda line: F.rlike(line, F.lit(A_WORD)))
    one = without(docs, MEASURES).withColumn("__words", words(text)).withColumn("__lines", lines)
    one = one.withColumn("__codes", F.transform("__words", lambda w: F.crc32(w)))
    one = one.withColumn("n_words", F.size("__codes").cast("long"))
    inside = ", ".join(f"slice(__codes, {k}, greatest(size(__codes) - {WINDOW - 1}, 1))" for k in range(1, WINDOW + 1))
    none = "cast(array() as array<bigint>)"
    one = one.withColumn("__grams", F.expr(f"if(size(__codes) >= {WINDOW}, transform(arrays_zip({inside}), g -> xxhash64(g)), {none})"))
    # hashes of windows found twice or more; the places of those windows, looked up one by one where the
    # hashes are few and by sorting hash and place together where they are many; the words they cover
    sorted_ = "element_at(transform(array(sort_array(__grams)), s -> filter(s, (g, j) -> j > 0 and s[greatest(j - 1, 0)] = g)), 1)"
    one = one.withColumn("__again", F.expr(f"if(size(array_distinct(__grams)) = size(__grams), {none}, array_distinct({sorted_}))"))
    looked_up = "filter(transform(__grams, (g, i) -> if(array_contains(__again, g), i, null)), i -> i is not null)"
    by_hash = "sort_array(transform(__grams, (g, i) -> struct(g, i)))"
    twice = "(j > 0 and s[greatest(j - 1, 0)].g = x.g) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].g = x.g)"
    sorted_out = f"sort_array(filter(element_at(transform(array({by_hash}), s -> transform(s, (x, j) -> if({twice}, x.i, null))), 1), i -> i is not null))"
    places = f"if(size(__again) <= {FEW}, {looked_up}, {sorted_out})"
    covered = f"struct(p as last, a.n + least({WINDOW}, p - a.last) as n)"
    again = f"aggregate({places}, struct(-{WINDOW} as last, 0L as n), (a, p) -> {covered}, a -> a.n)"
    one = one.withColumn("n_repeat_words", F.expr(f"if(size(__again) = 0, 0L, {again})"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return (
        one.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]+", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("base_failed", failed)
        .drop("__words", "__lines", "__grams", "__again")
    )


def quality_rules(
    docs: DataFrame, trusted: DataFrame, doc_id="doc_id", text="text", buckets: int = BUCKETS, min_score: float = MIN_SCORE
) -> DataFrame:
    """`docs` with the base measures, base_failed, n_grams, score (null without words) and kept.

    `trusted` names the trusted documents by its first column; repeated and unknown identifiers there count
    once or not at all. A null text has no words, so it fails the base rules; null identifiers are never
    trusted. Repeated rows are judged one by one, an empty table gives an empty result, and columns of
    `docs` named like an added one are replaced. Without trusted documents all n-grams weigh nothing.
    """
    found = bucket_weights(docs, trusted, doc_id, text, buckets).groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).alias("w"))
    by_fold = found.select("fold", F.expr("transform(w, x -> x.weight)").alias("w")).agg(F.sort_array(F.collect_list(F.struct("fold", "w"))).alias("w"))
    rows = without(measured(docs, text), ADDED[len(MEASURES):])
    rows = rows.withColumn("__weights", F.get(by_fold.select(F.expr("transform(w, x -> x.w)")).scalar(), fold(doc_id)))
    rows = rows.withColumn("n_grams", F.expr("n_words + greatest(n_words - 1, 0)"))
    pair = f"if(i > 0, __weights[pmod({pair_code('__codes[greatest(i - 1, 0)]', 'x')}, {buckets})], 0L)"
    one = f"transform(__codes, (x, i) -> __weights[pmod(x, {buckets})] + {pair})"
    rows = rows.withColumn("__sum", F.expr(f"aggregate({one}, 0L, (s, w) -> s + w)"))
    good = F.col("__sum") >= F.round(F.lit(min_score * UNIT)).cast("long") * F.col("n_grams")
    # a filter on kept must not be pushed below the measures: inlined there, they would be computed many times over
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    good = good & (F.col("__row") >= 0)
    score = F.expr(f"if(n_grams > 0, __sum / {UNIT}D / n_grams, null)")
    rows = rows.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & good)
    return rows.drop("__codes", "__weights", "__sum", "__row")
