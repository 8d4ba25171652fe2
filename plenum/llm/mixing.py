"""Mixing sources to target weights.

Each source's documents form one stream, cut into blocks: a block is the run of whole documents that begin in the same
BLOCK words of the stream. A source's blocks are permuted (a second time for a second pass), and as many are drawn as
reach the source's target in words: that is its quota. A splitting tree deals the quotas to the output shards: each
node halves its shards and draws the left half's blocks from the multivariate hypergeometric distribution, so all
quotas stay exact and no task holds more than one count for each source and shard. A shard takes its own range of the
permutation; within a shard the blocks come in the order of a hash. Documents stay whole, but for the one of each
source in which the target is reached: its first words are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.lineage import let, numbered, settled

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
N_SHARDS = 64
#: Words of a block: about a document.
BLOCK = 512
#: Rows of a group that one task ranks; also the largest number of sources that is broadcast.
GROUP = 4096
#: Words of mixed text that one task sorts.
SORTED = 4 << 20
SEED = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with `rank` (by code point, null last), `weight` and `target`.

    The targets share `share` times all sizes by weight; none exceeds `most` times its source's size, and what is
    cut off is shared again. Sources in the order of their limit over their weight: those before the first that
    fits its share are at their limit. One row for each source, sorted in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.get(cycle, F.col("rank") % len(weights)).cast("double"))
    limit = F.col("source_size") * F.lit(most)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    by_limit = Window.orderBy(limit / F.col("weight"), "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    left = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("_level", rest / left).withColumn("_full", F.col("_level") * F.col("weight") >= limit)
    level = F.min(F.when(~F.col("_full"), F.struct((limit / F.col("weight")).alias("at"), "rank", "_level"))).over(all_rows)
    return levels.withColumn("_first", level).withColumn("target", F.when(F.col("_full"), limit).otherwise(F.least(limit, F.col("_first._level") * F.col("weight")))).drop("_level", "_full", "_first")


def uniform(*cols: Column) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) + 0.5) / F.lit(float(1 << 53))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among `draws` of `total`, by inversion of the distribution within ten standard deviations of its mean."""
    g, n, d = good.cast("double"), total.cast("double"), draws.cast("double")
    mean = d * g / F.greatest(n, F.lit(1.0))
    wide = F.sqrt(F.greatest(mean * (n - g) / F.greatest(n, F.lit(1.0)) * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))) * 10 + 5
    low, high = F.greatest(F.lit(0), draws - (total - good)), F.least(good, draws)
    a, b = F.greatest(low, F.floor(mean - wide)), F.least(high, F.ceil(mean + wide))

    def pick(s: Column) -> Column:
        after = lambda w, k: w * (g - k) * (d - k) / ((k + 1) * (n - g - d + k + 1))
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        whole = F.aggregate(F.sequence(s["a"], s["b"]), zero, lambda acc, k: F.struct(after(acc["w"], k.cast("double")).alias("w"), (acc["sum"] + acc["w"]).alias("sum")), lambda acc: acc["sum"])
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), s["b"].alias("k"), F.lit(False).alias("done"))

        def step(acc: Column, k: Column, aim: Column) -> Column:
            reached = acc["sum"] + acc["w"] >= aim
            return F.struct(after(acc["w"], k.cast("double")).alias("w"), (acc["sum"] + acc["w"]).alias("sum"), F.when(~acc["done"] & reached, k).otherwise(acc["k"]).alias("k"), (acc["done"] | reached).alias("done"))

        return let(whole, lambda t: F.aggregate(F.sequence(s["a"], s["b"]), start, lambda acc, k: step(acc, k, u * t), lambda acc: acc["k"]))

    return let(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), pick)


def split_quotas(sources: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """(rank, quota) -> (rank, ends): for each source an array of where each shard's range of its permuted blocks ends."""
    root = sources.agg(F.sort_array(F.collect_list(F.struct("rank", F.col("quota").alias("n")))).alias("counts"))  # one count for each source
    nodes = root.select(F.lit(0).alias("first"), F.lit(n_shards).alias("shards"), F.transform("counts", lambda c: c["n"]).alias("counts"), F.transform("counts", lambda c: c["rank"]).alias("ranks"))
    for _ in range(max(n_shards - 1, 0).bit_length()):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + c)
        half = F.floor(F.col("shards") / 2).cast("int")
        draws = F.round(total * half / F.col("shards")).cast("long")

        def draw(acc: Column, c: Column) -> Column:
            x = hypergeometric(c["n"], acc["rest"], acc["need"], uniform(F.lit(seed), F.col("first"), F.col("shards"), c["k"]))
            return let(x, lambda v: F.struct((acc["rest"] - c["n"]).alias("rest"), (acc["need"] - v).alias("need"), F.concat(acc["out"], F.array(v)).alias("out")))

        zero = F.struct(total.alias("rest"), draws.alias("need"), F.array().cast("array<bigint>").alias("out"))
        left = F.aggregate(F.transform("counts", lambda c, k: F.struct(k.alias("k"), c.alias("n"))), zero, draw, lambda acc: acc["out"])
        cut = nodes.withColumn("_left", F.when(F.col("shards") > 1, left))
        node = lambda first, shards, counts: F.struct(first.cast("int").alias("first"), shards.cast("int").alias("shards"), counts.alias("counts"))
        halves = F.array(node(F.col("first"), half, F.col("_left")), node(F.col("first") + half, F.col("shards") - half, F.zip_with("counts", "_left", lambda c, x: c - x)))
        parts = F.when(F.col("shards") > 1, halves).otherwise(F.array(node(F.col("first"), F.col("shards"), F.col("counts"))))
        nodes = cut.select("ranks", F.explode(parts).alias("_n")).select("_n.first", "_n.shards", "_n.counts", "ranks")
    leaves = nodes.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("ranks", "counts")).alias("_c")).select("shard", F.col("_c.ranks").alias("rank"), F.col("_c.counts").alias("n"))
    ends = F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))
    return leaves.withColumn("end", ends).groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))


def _offsets(df: DataFrame, key: list[str], order: str, groups: Column, **sizes: Column) -> DataFrame:
    """`df` with, under each name in `sizes`, the sum of that size over the rows of the same `key` that come before, by group and then by `order`.

    A key's rows are dealt to groups; the groups' sums are added up first, so no task sorts a whole key.
    """
    dealt = df.withColumn("_group", F.pmod(F.xxhash64(F.col(order), F.lit(7)), groups)).withColumns({f"_size_{n}": c for n, c in sizes.items()})
    sums = dealt.groupBy(*key, "_group").agg(*[F.sum(f"_size_{n}").alias(f"_sum_{n}") for n in sizes])
    before = {n: F.sum(f"_sum_{n}").over(Window.partitionBy(*key).orderBy("_group")) - F.col(f"_sum_{n}") for n in sizes}
    starts = sums.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_group").alias("_g"), *[c.alias(f"_before_{n}") for n, c in before.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    inside = Window.partitionBy(*key, "_group").orderBy(order)
    joined = dealt.withColumns({f"_inside_{n}": F.sum(f"_size_{n}").over(inside) - F.col(f"_size_{n}") for n in sizes}).join(starts, [F.col("_group") == F.col("_g"), *same])
    return joined.select(*df.columns, *[(F.col(f"_before_{n}") + F.col(f"_inside_{n}")).alias(n) for n in sizes])


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has been counted to be small; else left to the planner."""
    return F.broadcast(df) if df.count() <= GROUP else df


def measure(df: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(_row, size, source, kept) of every row, written to the checkpoint folder: the only pass over the texts.

    `kept` is a struct of the columns `keep`, whose names are free.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    return numbered(df, "__row").select(*kept, F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), F.col("__row").alias("_row")).transform(settled)


def draw(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """((_row, rank, block, size, at), (rank, block, pass, place, mix_order, until)): each row's block and place in its
    source's stream, and the blocks that are drawn, with their place among their source's draws and the place in the
    stream up to which they are taken. Both are written.
    """
    plan = _small(sources.select(F.col("source").alias("_s"), "rank", "source_size", "source_rows", F.round("target").cast("long").alias("_aim")))
    known = rows.where("size > 0").join(plan, F.col("_s").eqNullSafe(F.col("source"))).select("_row", "rank", "size", "source_rows")
    runs = _offsets(known, ["rank"], "_row", F.ceil(F.col("source_rows") / GROUP).cast("long"), at=F.col("size"))
    runs = runs.select("_row", "rank", F.floor(F.col("at") / BLOCK).alias("block"), "size", "at").transform(settled)
    blocks = runs.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.min("at").alias("begin")).join(plan.drop("_s"), "rank")
    passes = F.when(F.col("_aim") > F.col("source_size"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    tickets = blocks.withColumn("pass", F.explode(passes)).withColumn("mix_order", F.xxhash64(F.lit(seed), "rank", "block", "pass")).withColumn("_id", F.struct("mix_order", "block"))
    places = _offsets(tickets, ["rank", "pass"], "_id", F.ceil(F.col("source_rows") / GROUP).cast("long"), place=F.lit(1).cast("long"), before=F.col("words"))
    left = F.col("_aim") - F.col("before") - F.col("pass") * F.col("source_size")
    drawn = places.where(left > 0).select("rank", "block", "pass", "place", "mix_order", (F.col("begin") + F.least("words", left)).alias("until")).transform(settled)
    return runs, drawn


def plan(rows: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """(per source: source_size, source_rows, target, quota, blocks of the first pass and the shards' ranges; what `draw` gives). All written."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    t = targets(sizes).transform(settled)
    drawn = draw(rows, t, seed)
    quotas = drawn[1].groupBy("rank").agg(F.count("*").alias("quota"), F.count(F.when(F.col("pass") == 0, 1)).alias("blocks"))
    t = t.join(quotas, "rank", "left").fillna(0, ["quota", "blocks"]).transform(settled)
    return t.join(split_quotas(t, n_shards, seed), "rank").transform(settled), drawn


def plan_sources(rows: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """Per source: source_size, target, quota and the shards' ranges."""
    return plan(rows, n_shards, seed)[0]


def mix(rows: DataFrame, sources: DataFrame, seed: int = SEED, drawn: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(_row, size, pass, word_start, words, shard, mix_order): the words that the mix takes of each row of `measure`.

    These are a row's words in one pass or both; a row of size 0 has none. Ties can't arise: a block's hash is followed
    by its number. Results depend on the rows' order in their files, not on the number of tasks. `drawn`: what `draw`
    gave, if it has been asked already.
    """
    runs, taken = drawn or draw(rows, sources, seed)
    place = F.col("place") + F.col("pass") * F.col("blocks")
    shards = taken.join(_small(sources.select("rank", "blocks", "ends")), "rank").withColumn("shard", F.size(F.filter("ends", lambda e: e <= place)))
    words = F.least("size", F.col("until") - F.col("at"))
    return runs.join(shards.drop("ends", "blocks", "place"), ["rank", "block"]).withColumn("words", words).where("words > 0").select("_row", "size", "pass", F.lit(0).cast("long").alias("word_start"), "words", "shard", "mix_order")


def in_mixed_order(df: DataFrame, words: int, n_shards: int, order: list[str]) -> DataFrame:
    """`df` dealt by shard and, within a shard, by ranges of mix_order (a hash, so ranges are even), and sorted: its partitions follow each other in the mixed order."""
    parts = max(1, -(-words // (n_shards * SORTED)))
    part = F.least(F.floor((F.col("__order").cast("double") / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1))
    return df.repartitionById(n_shards * parts, (F.col("__shard") * parts + part).cast("int")).sortWithinPartitions("__shard", *order)


def mix_texts(df: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """The mixed rows of `df` (columns text, source, n_chars and any others): a row for each time that the mix takes a document.

    Rows come by shard and, within a shard, in the mixed order: a partition holds rows of one shard only. Texts are
    whole, but for the one of each source in which its target is reached: of that the words up to there. Rows without
    words are dropped: no mix can take words of them. Null sources are a source of their own; repeated rows are rows
    of their own; an empty table gives no rows.
    """
    placed = numbered(df, "__row")
    rows = measure(placed.drop("__row"), keep=())
    sources, drawn = plan(rows, n_shards, seed)
    n_taken = sources.agg(F.sum(F.round("target"))).first()[0] or 0
    run = F.struct(F.col("shard").alias("__shard"), F.col("mix_order").alias("__order"), F.col("pass").alias("__pass"), F.when(F.col("words") < F.col("size"), F.col("words").cast("int")).alias("__words"))
    pieces = mix(rows, sources, seed, drawn).groupBy("_row").agg(F.collect_list(run).alias("__runs")).select(F.col("_row").alias("__row"), "__runs")  # two at most
    token = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("__run.__words").isNull(), F.col("text")).otherwise(F.array_join(F.slice(token, F.lit(1), F.col("__run.__words")), ""))
    mixed = placed.join(pieces, "__row").withColumn("__run", F.explode("__runs")).withColumn("text", text).drop("__runs").select("*", "__run.*").drop("__run", "__words")
    ordered = in_mixed_order(mixed, int(n_taken), n_shards, ["__order", "__row", "__pass"])
    return ordered.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in df.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and what each shard takes of it, in the mixed order.

    A null or empty text has no words, and the mix takes none of it; null sources are a source of their own. Repeated rows are rows of their own.
    """
    rows = measure(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    sources, drawn = plan(rows)
    run = F.struct("shard", "mix_order", "pass", "word_start", "words")
    taken = mix(rows, sources, SEED, drawn).groupBy("_row").agg(F.sum("words").alias("_taken"), F.sort_array(F.collect_list(run)).alias("_runs"))
    goals = _small(sources.select(F.col("source").alias("_s"), "source_size", "target"))
    out = rows.join(goals, F.col("_s").eqNullSafe(F.col("source"))).join(taken, "_row", "left")
    none = F.array().cast("array<struct<shard int, mix_order bigint, pass int, word_start bigint, words bigint>>")
    return out.select(F.col("kept.doc_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("_runs", none).alias("runs"))
