"""Splits that keep related records together: components by frontier breadth-first search from many seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..skew import bucket_of, join_counted, key128
from ..storage import materialize
from .bare import bare_text_col

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the edges (u, v); equal labels mean the same component.

    Adjacency lists are partitioned by the hash of u.  Seeds are the nodes that are smaller than all their neighbours
    (nodes are hashes, so seeds are spread evenly, and every component has one).  All seeds expand their frontiers at
    once, a node taking the smallest label that reaches it first.  Where two labels meet on an edge, they are one
    component; these meetings are the edges of a smaller graph of labels, which is solved in the same way.  Nothing of
    the graph goes to the driver but the number of rows of a frontier.  Self loops and repeated edges are allowed.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    adj = materialize(both.distinct(), "adjacency")
    levels: list[DataFrame] = []
    while True:
        seeds = adj.groupBy("u").agg(F.min("v").alias("m")).where(F.col("u") <= F.col("m"))
        frontier = materialize(seeds.select(F.col("u").alias("node"), F.col("u").alias("label")), "seeds")
        labels = frontier
        while True:
            reached = frontier.join(adj, F.col("node") == F.col("u")).groupBy("v").agg(F.min("label").alias("label"))
            reached = reached.join(labels.select(F.col("node").alias("v")), "v", "left_anti")
            frontier = materialize(reached.select(F.col("v").alias("node"), "label"), "frontier")
            if frontier.isEmpty():
                break
            labels = labels.unionByName(frontier)
        labels = materialize(labels, "labels")
        levels.append(labels)
        a = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        b = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        met = adj.where(F.col("u") < F.col("v")).join(a, "u").join(b, "v").where(F.col("lu") != F.col("lv"))
        met = met.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
        both = met.unionByName(met.select(F.col("v").alias("u"), F.col("u").alias("v")))
        adj = materialize(both, "meetings")
        if adj.isEmpty():
            break
    out = levels[0]
    for more in levels[1:]:
        m = more.select(F.col("node").alias("label"), F.col("label").alias("_to"))
        out = out.join(m, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    return out


def linked_rows(df: DataFrame) -> DataFrame:
    """(example_id, qid, node, n1, n2) of every row: its trimmed query_id, or null, and the keys that relate it to others.

    n1 is the node of query_id and n2 that of the bare query, null if missing or empty.  node is n1, else n2; it is
    null for a row that nothing relates to another row.
    """
    qid = F.nullif(F.regexp_replace("query_id", r"(?U)^\s+|\s+$", ""), F.lit(""))
    r = df.select("example_id", qid.alias("qid"), F.nullif(bare_text_col(F.col("query")), F.lit("")).alias("bq"))
    n1 = F.when(F.col("qid").isNotNull(), key128(F.lit("id"), F.col("qid")))
    n2 = F.when(F.col("bq").isNotNull(), key128(F.lit("query"), F.col("bq")))
    return r.select("example_id", "qid", n1.alias("n1"), n2.alias("n2")).withColumn("node", F.coalesce("n1", "n2"))


def related(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows with a node, and for each node its label and the facts of its component.

    groups has node, n (rows of this node), label, rows_in_group, min_id, mixed (not all rows have the same query_id).
    """
    rows = materialize(linked_rows(df), "linked")
    edges = rows.where("n1 is not null and n2 is not null").select(F.col("n1").alias("u"), F.col("n2").alias("v"))
    alone = rows.where("node is not null and (n1 is null or n2 is null)").select(F.col("node").alias("u"), F.col("node").alias("v"))
    label = components(edges.unionByName(alone).distinct())
    facts = rows.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("qid").alias("lo"),
        F.max("qid").alias("hi"),
        F.max(F.col("qid").isNull()).alias("missing"),
    )
    nodes = materialize(facts.join(label, "node"), "nodes")
    group = nodes.groupBy("label").agg(
        F.sum("n").alias("rows_in_group"),
        F.min("lo").alias("min_id"),
        ((F.min("lo") != F.max("hi")) | (F.max("missing") & F.max("lo").isNotNull())).alias("mixed"),
    )
    return rows, nodes.select("node", "n", "label").join(group, "label")


def groups_found(df: DataFrame) -> DataFrame:
    """(group_query_id, example_id) for each row of a group whose rows don't all have the same query_id.

    A missing query_id (null, or nothing but white space) counts as one more id; a group without any isn't listed.
    """
    rows, groups = related(df)
    found = groups.where(F.col("mixed") & F.col("min_id").isNotNull()).select("node", "n", F.col("min_id").alias("group_query_id"))
    got = join_counted(rows.where("node is not null").select("example_id", "node"), found, "node", "n", rows.count())
    return got.select("group_query_id", "example_id")


def assign_splits(df: DataFrame, splits: Sequence[tuple[str, float]] = SPLITS, seed: int = 0) -> DataFrame:
    """(example_id, split) of every row, related rows in one split, the splits near their shares of the rows.

    Components with more than a 400th of all rows (so at most 400) are placed first, the largest first, each in the
    split that lacks most; the others follow in the order of the hash of their label, which cuts the line of their
    rows where the splits are full.  The running sum over them has two steps, by bucket of that hash and within, so no
    task takes all components.  Rows that nothing relates to others are components of one row.  Same rows and seed
    give the same splits.  If one component is larger than the train share, the shares can't be met.
    """
    rows, groups = related(df)
    spark = df.sparkSession
    total = rows.count()
    single = rows.where("node is null").select(key128(F.col("example_id").cast("string")).alias("label"), F.lit(1).cast("long").alias("size"))
    size = groups.groupBy("label").agg(F.max("rows_in_group").alias("size")).unionByName(single)
    size = materialize(size.groupBy("label").agg(F.sum("size").alias("size")), "sizes")
    least = max(2, total // 400)
    free = {name: share * total for name, share in splits}
    placed = []
    for r in size.where(F.col("size") > least).orderBy(F.desc("size"), "label").collect():  # at most 400
        name = max(free, key=lambda k: free[k])
        free[name] -= r["size"]
        placed.append((r["label"], name))
    rest = size.where(F.col("size") <= least).withColumn("h", F.xxhash64(F.lit(seed), "label")).withColumn("b", F.shiftrightunsigned("h", 54).cast("int"))
    by_bucket = rest.groupBy("b").agg(F.sum("size").alias("s"))  # 1024 rows
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.select("b", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("s0"))
    inside = Window.partitionBy("b").orderBy("h", "label").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.withColumn("run", F.sum("size").over(inside) - F.col("size") / 2).join(F.broadcast(by_bucket), "b")
    at = F.col("run") + F.col("s0")
    open_ = [(k, max(0.0, v)) for k, v in free.items()]
    left = sum(v for _, v in open_) or 1.0
    n_rest = size.where(F.col("size") <= least).agg(F.sum("size")).first()[0] or 0
    split, edge = F.lit(open_[-1][0]), 0.0
    cuts = []
    for name, v in open_[:-1]:
        edge += v / left * n_rest
        cuts.append((name, edge))
    for name, e in reversed(cuts):
        split = F.when(at <= F.lit(e), F.lit(name)).otherwise(split)
    chosen = rest.select("label", split.alias("split"))
    if placed:
        chosen = chosen.unionByName(spark.createDataFrame(placed, "label binary, split string"))
    nodes = groups.select("node", "n", "label").join(chosen, "label").select("node", "n", "split")
    tied = join_counted(rows.where("node is not null").select("example_id", "node"), nodes, "node", "n", total).select("example_id", "split")
    alone = rows.where("node is null").select("example_id", key128(F.col("example_id").cast("string")).alias("label"))
    return tied.unionByName(alone.join(chosen, "label").select("example_id", "split"))
