"""Operators on groups and on ordered streams of rows or tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vocab
from . import runs


def advantages(df: DataFrame, group, value: str, eps: float = 1e-4, least_std: float = 0.0) -> DataFrame:
    """advantage: (value - mean) / (population std + eps) in its group. Groups whose std is least_std or less, or not finite, go whole."""
    w = W.partitionBy(*([group] if isinstance(group, str) else group))
    out = df.withColumn("_mean", F.avg(value).over(w)).withColumn("_std", F.stddev_pop(value).over(w))
    return out.where((F.col("_std") > least_std) & ~F.isnan("_std")).withColumn("advantage", (F.col(value) - F.col("_mean")) / (F.col("_std") + eps)).drop("_mean", "_std")


def without_failed_groups(df: DataFrame, group: str, failed: Column) -> DataFrame:
    """Groups with a failed row go whole."""
    return df.withColumn("_bad", F.bool_or(F.coalesce(failed, F.lit(False))).over(W.partitionBy(group))).where("not _bad").drop("_bad")


def wrong_size(df: DataFrame, group: str, size: int) -> DataFrame:
    """Groups whose number of rows is no multiple of size."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % size != 0)


def signal_rate(df: DataFrame, group: str, value: str, least_std: float = 1e-4) -> DataFrame:
    """groups, and the share of them with a std above least_std."""
    return df.groupBy(group).agg(F.stddev_pop(value).alias("std")).agg(F.count(F.lit(1)).alias("groups"), F.avg((F.col("std") > least_std).cast("double")).alias("rate"))


def exploded_tokens(df: DataFrame, key: str = "id", *arrays: str) -> DataFrame:
    return df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "t")).select(key, "pos", *[F.col(f"t.{a}").alias(a) for a in arrays])


def image_blocks(tokens: DataFrame, key: str = "id", code: Column | None = None) -> DataFrame:
    """id, block, start_at, end_at of framed image blocks that hold a code between start + 3 and the end; an unclosed start has none.

    code: whether a token is a code; by default, whether it is one of the vocabulary's."""
    code = F.col("token").between(vocab.CODE_FIRST, vocab.CODE_LAST) if code is None else code
    t = tokens.select(key, "pos", "token")
    w = W.partitionBy(key).orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    t = t.withColumn("end_at", F.min(F.when(F.col("token") == vocab.IMAGE_END, F.col("pos"))).over(w))
    t = t.withColumn("next_code", F.min(F.when(code, F.col("pos"))).over(W.partitionBy(key).orderBy("pos").rowsBetween(3, W.unboundedFollowing)))
    # A start within an open block belongs to that block.
    starts = t.where((F.col("token") == vocab.IMAGE_START) & F.col("end_at").isNotNull())
    starts = starts.withColumn("_n", F.row_number().over(W.partitionBy(key, "end_at").orderBy("pos"))).where("_n = 1")
    good = starts.where(F.col("next_code") < F.col("end_at"))
    return good.select(key, (F.row_number().over(W.partitionBy(key).orderBy("pos")) - 1).alias("block"), F.col("pos").alias("start_at"), "end_at")


def token_weights(tokens: DataFrame, blocks: DataFrame, weights: DataFrame, key: str = "id", default: float = 1.0) -> DataFrame:
    """weight and block of each token, by the block's ordinal (weights: block, weight); outside blocks the default."""
    b = blocks.join(weights, "block", "left").withColumnRenamed(key, "_k")
    on = (tokens[key] == b["_k"]) & tokens["pos"].between(b["start_at"], b["end_at"])
    return tokens.join(b, on, "left").drop("_k", "start_at", "end_at").withColumn("weight", F.coalesce("weight", F.lit(default)))


def open_blocks(tokens: DataFrame, key: str = "id", width: int | None = None) -> DataFrame:
    """inside: more starts than ends so far; since_start: tokens since the last start. With a grid's width also row and
    column (width: the row's end) of tokens behind a start and the two sizes."""
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    starts = F.count_if(F.col("token") == vocab.IMAGE_START).over(w)
    ends = F.count_if(F.col("token") == vocab.IMAGE_END).over(w)
    last = F.max(F.when(F.col("token") == vocab.IMAGE_START, F.col("pos"))).over(w)
    out = tokens.withColumn("inside", starts > ends).withColumn("since_start", F.when(starts > ends, F.col("pos") - last))
    if width is None:
        return out
    at = F.when(F.col("since_start") >= 3, F.col("since_start") - 3)
    return out.withColumn("row", F.floor(at / (width + 1))).withColumn("column", F.pmod(at, F.lit(width + 1)))


def may_start(before: Column, tags: list[list[int]]) -> Column:
    """Whether an image may start here: the tokens before end with an image's opening tag."""
    out = F.lit(False)
    for t in tags:
        out = out | ends_with(before, t)
    return F.coalesce(out, F.lit(False))


def expected_class(since: Column, width: int, height: int) -> Column:
    """What may come at a place of an image block: grid sizes, codes with a newline after each row, then the end."""
    at = since - 3
    return F.when(since.isNull(), "text").when(since <= 2, "grid").when(at == height * (width + 1), "end").when(at > height * (width + 1), "none").when(F.pmod(at, F.lit(width + 1)) == width, "newline").otherwise("code")


def padded(tokens: Column, length: int, fill: int = 0) -> Column:
    """Cut or filled to a length."""
    cut = F.slice(tokens, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))


def framed(codes: Column, height: int, width: int, size_base: int, newline: int) -> Column:
    """An image block: start, two sizes, rows of codes each with a newline, end."""
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.concat(F.slice(codes, r * width + 1, F.lit(width)), F.array(F.lit(newline)))))
    return F.concat(F.array(F.lit(vocab.IMAGE_START), F.lit(size_base + height), F.lit(size_base + width)), rows, F.array(F.lit(vocab.IMAGE_END)))


def grid_ok(tokens: Column, height: int, width: int, codes_per_grid: int = 16) -> Column:
    """Whether a block of height by width grids has all its codes, row ends left out."""
    codes = F.filter(tokens, lambda x: x.between(vocab.CODE_FIRST, vocab.CODE_LAST))
    return F.size(codes) == codes_per_grid * height * width


def ends_with(tokens: Column, tail: list[int]) -> Column:
    return F.when(F.size(tokens) >= len(tail), F.slice(tokens, -len(tail), len(tail)) == F.array(*[F.lit(x) for x in tail])).otherwise(F.lit(False))


def masked_labels(tokens: Column, prompt_length: Column) -> Column:
    return F.transform(tokens, lambda t, i: F.when(i < prompt_length, F.lit(vocab.MASKED)).otherwise(t))


def masked_mean(df: DataFrame, keys: list[str], value: Column, weight: Column, keep: Column) -> DataFrame:
    """n, total weight and weighted mean of what is kept; the weight counts as 1 at least."""
    w = F.when(keep, weight)
    return df.groupBy(*keys).agg(F.count(w).alias("n"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight"), (F.coalesce(F.sum(w * value), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(w), F.lit(0.0)), F.lit(1.0))).alias("mean"))


def mean_of_means(df: DataFrame, key: str, value: Column, keep: Column) -> DataFrame:
    """Mean over rows of each row's mean over its kept tokens."""
    return df.groupBy(key).agg(F.avg(F.when(keep, value)).alias("m")).agg(F.avg("m").alias("value"))


def top_with_ties(df: DataFrame, k: int, score: str, key: str | None = None) -> DataFrame:
    """Scores of the k-th largest or more, ties kept. Without a key by the k-th score alone, which takes no rank over all rows."""
    if key is None:
        return runs.top_by_threshold(df, [], score, F.lit(k))
    return df.withColumn("_r", F.rank().over(W.partitionBy(key).orderBy(F.desc(score)))).where(F.col("_r") <= k).drop("_r")


def sequence_stats(values: Column) -> Column:
    """count, mean, nonzero count and share of an array."""
    nonzero = F.size(F.filter(values, lambda x: F.abs(x) > 1e-8))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.struct(F.size(values).alias("count"), F.try_divide(total, F.size(values)).alias("mean"), nonzero.alias("nonzero"), F.try_divide(nonzero.cast("double"), F.size(values)).alias("nonzero_fraction"))


def accumulation_scale(step: Column, total: Column, every: int) -> Column:
    """1, but every / rest for the last, incomplete round."""
    rest = F.pmod(total, F.lit(every))
    return F.when((rest > 0) & (step >= total - rest), F.lit(float(every)) / rest).otherwise(1.0)


def chunks(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    """chunk: number of the fixed-size batch that a 0-based place falls in."""
    return df.withColumn("chunk", F.floor(F.col(ordinal) / size))


def rank_reduce(df: DataFrame, means: list[str] = (), maxima: list[str] = (), every: list[str] = (), some: list[str] = ()) -> DataFrame:
    """One row over all ranks: means, maxima, flags true on all, flags true on any."""
    return df.agg(*[F.avg(c).alias(c) for c in means], *[F.max(c).alias(c) for c in maxima], *[F.bool_and(c).alias(c) for c in every], *[F.bool_or(c).alias(c) for c in some])


def decoded_streams(tokens: DataFrame, key: str = "id") -> DataFrame:
    """id, text_tokens, blocks: tokens outside image blocks in order, and each block's codes. Text ends where a block stays open."""
    t = open_blocks(tokens, key)
    of_block = F.count_if(F.col("token") == vocab.IMAGE_START).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("_b", of_block)
    text = t.where(~F.col("inside") & ~F.col("token").isin(vocab.IMAGE_START, vocab.IMAGE_END)).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x"))
    closed = image_blocks(tokens, key).select(F.col(key).alias("_k"), "block", "start_at", "end_at")
    on = (t[key] == closed["_k"]) & t["pos"].between(closed["start_at"], closed["end_at"])
    codes = t.where(F.col("token").between(vocab.CODE_FIRST, vocab.CODE_LAST)).join(closed, on).groupBy(key, "block").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("c"))
    blocks = codes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", F.transform("c", lambda x: x["token"]).alias("codes")))).alias("blocks"))
    return text.select(key, F.transform("x", lambda x: x["token"]).alias("text_tokens")).join(blocks, key, "full")


def token_length(tokens: Column, fallback: Column) -> Column:
    return F.coalesce(F.when(tokens.isNotNull(), F.size(tokens)), fallback)


def active_chunks(tokens: DataFrame, active: Column, size: int, key: str = "id") -> DataFrame:
    """Chunks of positions that hold an active token: only these need work."""
    return tokens.where(active).select(key, F.floor(F.col("pos") / size).alias("chunk")).distinct()


def guided(conditional: Column, unconditional: Column, scale: float) -> Column:
    return scale * (conditional - unconditional) + unconditional


def row_seed(base: int, epoch: Column, step: Column, rank: Column, generation: Column) -> Column:
    """The seed of each generated row, a plain sum."""
    return F.lit(base).cast("long") + epoch.cast("long") * vocab.SEED_EPOCH + step.cast("long") * vocab.SEED_STEP + rank.cast("long") * vocab.SEED_RANK + generation


def token_logp(logits: Column, token: Column) -> Column:
    """Log probability of a token (0-based) under the softmax of logits, shifted by their maximum."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.get(logits, token).cast("double") - top - F.ln(total)


def aligned_errors(df: DataFrame, a: Column, b: Column, keep: Column) -> DataFrame:
    """Greatest and mean absolute difference of two aligned columns under a mask."""
    d = F.when(keep, F.abs(a - b))
    return df.agg(F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"))
