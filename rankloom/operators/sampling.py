"""Group-atomic splits, samples and caps, negatives, listwise export, shards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import _null_safe, ranked
from .retrieval import hash_order


def split_sizes(n: Column, eval_ratio: float, test_ratio: float) -> tuple[Column, Column]:
    """(test, dev) numbers of groups: banker's rounding, at least one test group from 3 groups on and one dev group if
    two or more remain, and always one train group."""
    test = F.bround(n * test_ratio).cast("long")
    test = F.when((n >= 3) & F.lit(test_ratio > 0), F.greatest(test, F.lit(1).cast("long"))).otherwise(test)
    test = F.when(n <= 1, F.lit(0).cast("long")).otherwise(F.least(test, n - 1))
    left = n - test
    dev = F.bround(n * eval_ratio).cast("long")
    dev = F.when((left >= 2) & F.lit(eval_ratio > 0), F.greatest(dev, F.lit(1).cast("long"))).otherwise(dev)
    dev = F.when(left <= 1, F.lit(0).cast("long")).otherwise(F.least(dev, left - 1))
    return test, dev


def group_split(df: DataFrame, key: str, eval_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, split, n): every group in one split, groups in hash order: test first, then dev, then train.

    The place of a group in hash order is found by bucket of the hash and within, not in one task.
    """
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("_h", hash_order(seed, F.coalesce(F.col(key), F.lit("")))).withColumn("_b", F.left("_h", F.lit(2)))
    per = groups.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # at most 256 rows
    lower = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_b0", F.coalesce(F.sum("_c").over(lower), F.lit(0))).withColumn("_all", F.sum("_c").over(Window.partitionBy(F.lit(1)))).drop("_c")
    w = Window.partitionBy("_b").orderBy("_h", key)
    groups = groups.withColumn("_i", F.row_number().over(w)).join(F.broadcast(per), "_b").withColumn("_i", F.col("_i") + F.col("_b0"))
    test, dev = split_sizes(F.col("_all"), eval_ratio, test_ratio)
    split = F.when(F.col("_i") <= test, "test").when(F.col("_i") <= test + dev, "dev").otherwise("train")
    return groups.select(key, split.alias("split"), "n")


def split_info(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("split").agg(F.count(F.lit(1)).alias("num_groups"), F.sum("n").alias("num_examples"))


def split_from_assignment(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """(source_index, split): by row number, group key or query of the assignment, train before dev before test.

    assigned has key and split and, for rows named by number, index; rows then has index as well.  Several entries of
    one row count by the order of the splits; a row that none names is of train.
    """
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).when(F.col("split") == "test", 2)
    names = {"group_key": "key", "query": "key"} | ({"index": "index"} if "index" in rows.columns and "index" in assigned.columns else {})
    got, found = rows, []
    for i, (of_row, of_entry) in enumerate(names.items()):
        best = assigned.where(F.col(of_entry).isNotNull()).groupBy(F.col(of_entry).alias(of_row)).agg(F.min(rank).alias(f"_p{i}"))
        got = got.join(best, of_row, "left")
        found.append(F.col(f"_p{i}"))
    p = F.coalesce(F.least(*found), F.lit(0))
    return got.select("source_index", F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), p + 1).alias("split"))


def cap_groups(df: DataFrame, key: str, n: int, order: Sequence[Column], keep: Column | None = None) -> DataFrame:
    """The first n rows of each group, and those that must be kept.

    The limit is a rank of its own, so that each task keeps n rows of a group before the shuffle; rows that must be
    kept need no rank and stay where they are, and are counted by the rank only to be left out there.
    """
    w = Window.partitionBy(key).orderBy(*order)
    if keep is None:
        return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")
    must = F.coalesce(keep, F.lit(False))
    first = df.withColumn("_must", must).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n)
    return df.where(must).unionByName(first.where(~F.col("_must")).drop("_must", "_i"))


def sample_groups(df: DataFrame, key: str, target: int, seed: int = 42) -> DataFrame:
    """Groups in hash order until their rows reach the target, the group that crosses it included.

    Needs prefix sums over the groups; these go by bucket of the hash and within.
    """
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    groups = groups.withColumn("_h", hash_order(seed, F.coalesce(F.col(key), F.lit("")))).withColumn("_b", F.left("_h", F.lit(2)))
    per = groups.groupBy("_b").agg(F.sum("_n").alias("_c"))
    lower = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_b0", F.coalesce(F.sum("_c").over(lower), F.lit(0))).drop("_c")
    run = Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).join(F.broadcast(per), "_b")
    chosen = groups.where(F.col("_before") + F.col("_b0") < target).select(key)
    return _null_safe(df, chosen, [key])


def first_groups(df: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """Rows of the first n distinct groups in order of their first row."""
    chosen = df.groupBy(key).agg(F.min(order).alias("_o")).orderBy("_o", key).limit(n).select(key)
    return _null_safe(df, chosen, [key])


def random_negatives(queries: DataFrame, positives: DataFrame, corpus: DataFrame, n: int, seed: int = 42, draws: int = 4) -> DataFrame:
    """(qid, doc_id, pos): n documents of the corpus that aren't positives, without replacement, for each query.

    Documents have numbers from hash order; a query takes the next ones from a start of its own, so a query reads
    n + draws numbers and nothing is crossed.  Queries with more than ``draws`` positives read that many more.
    """
    docs = corpus.select("doc_id").distinct().withColumn("_h", hash_order(seed, F.col("doc_id")))
    docs = docs.withColumn("_b", F.left("_h", F.lit(3)))
    per = docs.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # at most 4096 rows
    lower = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_b0", F.coalesce(F.sum("_c").over(lower), F.lit(0)))
    w = Window.partitionBy("_b").orderBy("_h", "doc_id")
    docs = docs.withColumn("_i", F.row_number().over(w) - 1).join(F.broadcast(per), "_b").select("doc_id", (F.col("_i") + F.col("_b0")).alias("_at"))
    size = per.agg(F.sum("_c").alias("_size"))
    pos = positives.select("qid", "doc_id").distinct()
    many = pos.groupBy("qid").agg(F.count(F.lit(1)).alias("_m"))
    start = F.pmod(F.conv(F.left(hash_order(seed, F.col("qid")), F.lit(12)), 16, 10).cast("long"), F.col("_size"))
    q = queries.select("qid").distinct().join(many, "qid", "left").crossJoin(F.broadcast(size))  # size is one row
    reach = F.least(F.lit(n) + F.greatest(F.coalesce("_m", F.lit(0)), F.lit(draws)), F.col("_size"))
    q = q.where("_size > 0").select("qid", "_size", start.alias("_start"), F.explode(F.sequence(F.lit(0), (reach - 1).cast("int"))).alias("_step"))
    got = q.withColumn("_at", (F.col("_start") + F.col("_step")) % F.col("_size")).join(docs, "_at").join(pos, ["qid", "doc_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy("_step")
    return got.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n).select("qid", "doc_id", "pos")


STRATEGIES = ("threshold_or_top1", "threshold", "top1")


def listwise_export(
    df: DataFrame, key: str, threshold: float = 0.7, min_group: int = 2, max_pos: int = 0, max_neg: int = 0,
    strategy: str = "threshold_or_top1", negative_threshold: float | None = None, by_label: bool = False,
) -> DataFrame:
    """Rows chosen as positive or negative of their group (side, place), from rows with g and sidx.

    Positive are the rows at the threshold; with threshold_or_top1 the best row where there is none, with top1 only
    the best.  Negative are the others under negative_threshold, which is the threshold by default, or all others
    where there is none under it.  Groups under min_group rows, or without a side, are left out; 0 sets no cap.  Places go
    by sidx, or by label downwards first.  What a group needs comes from counts, and places from bands (``ranked``), so
    no task sorts a whole group.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"the strategy is one of {', '.join(STRATEGIES)}")
    rows = _listwise_rows(df, key, threshold, strategy, negative_threshold)
    rows = rows.where((F.col("_n") >= min_group) & F.col("side").isNotNull() & (F.col("_p") > 0) & (F.col("_n") > F.col("_p")))
    rows = rows.withColumns({"_o": F.col("g") if by_label else -F.col("sidx").cast("double"), "_side": F.col("side")})
    placed = ranked(rows, [key, "_side"], "_o", "sidx").withColumnRenamed("rk", "place")
    for side, most in (("positive", max_pos), ("negative", max_neg)):
        if most:
            placed = placed.where((F.col("side") != side) | (F.col("place") <= most))
    return placed.select(*df.columns, "side", F.col("place").cast("int").alias("place"))


def _listwise_rows(df: DataFrame, key: str, threshold: float, strategy: str, negative_threshold: float | None) -> DataFrame:
    """df with side, null for rows that are neither, and of its group _n rows, _p positive."""
    t, low = F.lit(threshold), F.lit(threshold if negative_threshold is None else negative_threshold)
    over = F.col("g") >= t
    best = F.min(F.struct((-F.col("g")).alias("rank"), F.col("sidx").alias("at"), (F.col("g") < low).alias("low")))
    stats = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(over.cast("long")).alias("_over"), F.sum((F.col("g") < low).cast("long")).alias("_low"),
        F.sum((over & (F.col("g") < low)).cast("long")).alias("_both"), best.alias("_best"),
    )
    only_top = F.lit(strategy == "top1") | (F.lit(strategy == "threshold_or_top1") & (F.col("_over") == 0))
    # positives, and rows under the negative threshold that aren't positive
    stats = stats.withColumn("_p", F.when(only_top, 1).otherwise(F.col("_over")).cast("long"))
    stats = stats.withColumn("_under", F.when(only_top, F.col("_low") - F.col("_best.low").cast("long")).otherwise(F.col("_low") - F.col("_both")))
    rows = _null_safe(df, stats.withColumn("_top", F.when(only_top, F.col("_best.at"))), [key])
    positive = F.when(F.col("_top").isNotNull(), F.col("sidx") == F.col("_top")).when(F.col("_p") == 0, F.lit(False)).otherwise(over)
    side = F.when(positive, "positive").when((F.col("_under") == 0) | (F.col("g") < low), "negative")
    return rows.withColumn("side", side)


def listwise_stats(df: DataFrame, key: str, threshold: float = 0.7, min_group: int = 2, strategy: str = "threshold_or_top1", negative_threshold: float | None = None) -> DataFrame:
    """One row: examples, groups, exported groups, and how many groups were left out, each for its first reason."""
    rows = _listwise_rows(df, key, threshold, strategy, negative_threshold)
    g = rows.groupBy(key).agg(F.max("_n").alias("n"), F.max("_p").alias("p"))
    small = F.col("n") < min_group
    reason = F.when(small, "small").when(F.col("p") == 0, "no_positive").when(F.col("n") == F.col("p"), "no_negative").otherwise("")
    of = lambda x: F.sum((reason == x).cast("long"))
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_examples"), F.count(F.lit(1)).alias("num_query_groups"), F.coalesce(of(""), F.lit(0)).alias("num_exported_groups"),
        F.coalesce(of("small"), F.lit(0)).alias("skipped_small_groups"), F.coalesce(of("no_positive"), F.lit(0)).alias("skipped_no_positive"),
        F.coalesce(of("no_negative"), F.lit(0)).alias("skipped_no_negative"),
    )


def modal_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the most frequent value of each group, the first seen on a tie; nulls and blanks don't count."""
    counts = df.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"), F.min(order).alias("_o"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_c"), F.col("_o"))).alias(value))


def messages(query: Column, docs: Column) -> Column:
    """Chat messages of a query and each of several documents."""
    user = F.struct(F.lit("user").alias("role"), query.alias("content"))
    return F.transform(docs, lambda d: F.array(user, F.struct(F.lit("assistant").alias("role"), d.alias("content"))))


def lpt_shards(sizes: DataFrame, key: str, size: str, shards: int, buckets: int = 1) -> DataFrame:
    """(key, size, shard): groups by falling size, each to the least loaded shard.

    The rule needs all groups in order, so it runs over (key, size) rows only.  With more than one bucket, groups are
    dealt to buckets by hash first and each bucket balances shards of its own, in parallel.
    """
    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        pdf = pdf.sort_values(["_size", "_key"], ascending=[False, True], kind="stable")
        heap, out = [(0, i) for i in range(shards)], []
        for n in pdf["_size"]:
            load, i = heapq.heappop(heap)
            out.append(i)
            heapq.heappush(heap, (load + int(n), i))
        return pdf.assign(shard=out)[["_key", "_size", "shard", "_b"]]

    kind = sizes.schema[key].dataType.simpleString()
    src = sizes.select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_size"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_b"))
    got = src.groupBy("_b").applyInPandas(assign, f"_key {kind}, _size long, shard int, _b int")
    return got.select(F.col("_key").alias(key), F.col("_size").alias(size), (F.col("_b") * shards + F.col("shard")).alias("shard"))


def packed_batches(lengths: Iterator[int], most_items: int, most_chars: int) -> Iterator[list[int]]:
    """Index batches in order, within a number of items and of characters; a single long item is a batch by itself."""
    batch: list[int] = []
    chars = 0
    for i, n in enumerate(lengths):
        if batch and (len(batch) >= most_items or (most_chars > 0 and chars + n > most_chars)):
            yield batch
            batch, chars = [], 0
        batch.append(i)
        chars += n
    if batch:
        yield batch
