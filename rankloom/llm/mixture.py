"""Mixing sources to target weights: blocks of tokens, drawn by shard, chosen by pseudorandom permutations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import with_offsets
from ..storage import materialize
from .minhash import mix
from .tokens import VOCABULARY, with_tokens

BLOCK, SHARD_BLOCKS = 256, 256
#: Shards that are drawn together.
STRETCH = 64


@dataclass(frozen=True)
class Share:
    """What one source gives: its tokens, its blocks and how many blocks of it the mixture takes."""

    source: str
    target_share: float
    max_repeats: int
    tokens: int
    blocks: int
    quota: int


def quotas(targets: list[tuple[str, float, int]], tokens: dict[str, int], block: int = BLOCK, total: int | None = None) -> list[Share]:
    """How many blocks each source gives, never more than its blocks times max_repeats.

    Without ``total`` the mixture is the largest in which every source that has tokens reaches its share; shares of
    sources without tokens go to the others in proportion.  With ``total`` tokens, a source that can't fill its share
    gives all it may, and what it lacks is shared out among the others.  A share of 0 takes nothing.
    """
    have = [(s, max(0.0, w or 0.0), max(0, r or 0), tokens.get(s, 0)) for s, w, r in targets]
    usable = {s: (w, r * n) for s, w, r, n in have if w > 0 and r > 0 and n > 0}
    amount: dict[str, float] = dict.fromkeys(usable, 0.0)
    weight = sum(w for w, _ in usable.values())
    if usable and total is None:
        t = min(most * weight / w for w, most in usable.values())
        amount = {s: t * w / weight for s, (w, _) in usable.items()}
    elif usable:
        left, open_ = float(total), dict(usable)
        while open_ and left > 0:
            weight = sum(w for w, _ in open_.values())
            full = {s: most for s, (w, most) in open_.items() if most <= left * w / weight}
            if not full:
                amount |= {s: left * w / weight for s, (w, _) in open_.items()}
                break
            amount |= full
            left -= sum(full.values())
            open_ = {s: x for s, x in open_.items() if s not in full}
    out = []
    for s, w, r, n in have:
        blocks = -(-n // block)
        quota = min(blocks * r, round(amount.get(s, 0.0) / (n / blocks))) if n else 0
        out.append(Share(s, w, r, n, blocks, quota))
    return out


def _fall(part: int, parts: int, colors: np.ndarray, left_half) -> tuple[np.ndarray, np.ndarray]:
    """What falls on one of many parts, and on all before it, by halving; left_half(lo, mid, hi, own) draws the first half."""
    lo, hi, own, before = 0, parts, colors.copy(), np.zeros_like(colors)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = left_half(lo, mid, hi, own)
        if part < mid:
            hi, own = mid, left
        else:
            lo, own, before = mid, own - left, before + left
    return own, before


def stretch_counts(stretch: int, stretches: int, colors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each source in this stretch of shards, blocks of each source in all stretches before it).

    The blocks of a source fall on the stretches by a multinomial draw: a half gets a binomial part of what the whole
    has.  Every stretch walks down to itself alone, with generators seeded by the halves, so all agree without a
    shuffle and the totals come out exactly, whatever their size.
    """
    return _fall(stretch, stretches, colors, lambda lo, mid, hi, own: np.random.default_rng([seed, lo, hi]).binomial(own, (mid - lo) / (hi - lo)))


def shard_counts(shard: int, shards: int, size: int, colors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each source in this shard, blocks of each source in all shards before it) of one stretch.

    Multinomial draws of the sources on condition that shards have ``size`` blocks, but for the last, and that the
    totals are those of the stretch.
    """

    def draw(lo, mid, hi, own):
        n = min(int(own.sum()), (mid - lo) * size)
        return np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(own, n, method="marginals")

    return _fall(shard, shards, colors, draw)


def permuted(i: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key, at i: a Feistel network, repeated where it leaves the range."""
    bits = max(2, int(n - 1).bit_length())
    half = np.uint64((bits + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    x, todo = i.astype(np.uint64), np.arange(len(i))
    out = np.zeros(len(i), np.int64)
    keys = key.astype(np.uint64)
    while len(todo):
        left, right = x >> half, x & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                f = mix(right + keys[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & mask
            left, right = right, left ^ f
        x = (left << half) | right
        ok = x < np.uint64(n)
        out[todo[ok]] = x[ok].astype(np.int64)
        x, todo = x[~ok], todo[~ok]
    return out


def _slots(shares: list[Share], stretches: int, size: int, seed: int):
    colors = np.array([s.quota for s in shares], np.int64)

    def shard_rows(shard: int, own: np.ndarray, before: np.ndarray) -> pd.DataFrame:
        which = np.repeat(np.arange(len(shares)), own)
        nth = np.concatenate([np.arange(o, o + c) for o, c in zip(before, own)] or [np.zeros(0, np.int64)])
        order = np.random.default_rng([seed, shard]).permutation(len(which))
        block, repeat = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        for k, s in enumerate(shares):
            m = which == k
            if m.any():
                repeat[m] = nth[m] // s.blocks
                block[m] = permuted(nth[m] % s.blocks, s.blocks, repeat[m] * 1009 + k * 7 + seed)
        return pd.DataFrame(
            {
                "shard": np.full(len(which), shard, np.int64),
                "slot": np.arange(len(which), dtype=np.int32),
                "source": np.array([s.source for s in shares], object)[which[order]],
                "block": block[order],
                "repeat": (repeat[order] + 1).astype(np.int32),
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for stretch in b["id"].tolist():
                all_, first = stretch_counts(stretch, stretches, colors, seed)
                shards = -(-int(all_.sum()) // size)
                for i in range(shards):
                    own, before = shard_counts(i, shards, size, all_, seed + stretch + 1)
                    yield shard_rows(stretch * 2 * STRETCH + i, own, first + before)

    return run


class Mixture:
    """A mixture of documents; ``target`` has source, target_share, max_repeats - one row a source, so it is small."""

    def __init__(
        self, df: DataFrame, target: DataFrame, total: int | None = None, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS,
        seed: int = 0, vocabulary: str = VOCABULARY,
    ) -> None:
        self.spark, self.block, self.size, self.seed = df.sparkSession, block, shard_blocks, seed
        wanted = target.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r"))
        targets = [(r["source"], r["w"], r["r"]) for r in wanted.orderBy("source").collect()]  # as many as sources of the target
        names = [s for s, _, _ in targets]
        docs = df.where(F.col("source").isin(names)).select("doc_id", "source", "text")
        self.docs = materialize(with_tokens(docs, "text", vocabulary).where(F.col("n_tokens") > 0), "token-counts")
        tokens = {r["source"]: r["n"] for r in self.docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        self.shares = quotas(targets, tokens, block, total)

    def blocks(self) -> DataFrame:
        """(source, block, doc_id, start_token, end_token): the tokens of a source, document after document, in blocks."""
        placed = with_offsets(self.docs, ["source"], ["doc_id"], F.col("n_tokens"))
        first = F.floor(F.col("before") / self.block).cast("long")
        last = F.floor((F.col("before") + F.col("n_tokens") - 1) / self.block).cast("long")
        each = placed.select("source", "doc_id", "before", "n_tokens", F.explode(F.sequence(first, last)).alias("block"))
        start = F.greatest(F.col("block") * self.block, F.col("before")) - F.col("before")
        end = F.least((F.col("block") + 1) * self.block, F.col("before") + F.col("n_tokens")) - F.col("before")
        return each.select("source", "block", "doc_id", start.alias("start_token"), end.alias("end_token"))

    def slots(self) -> DataFrame:
        """(shard, slot, source, block, repeat): which block stands where, in shards of shard_blocks blocks or, at the end of a stretch, less."""
        n = sum(s.quota for s in self.shares)
        stretches = -(-n // (self.size * STRETCH))
        run = _slots(self.shares, stretches, self.size, self.seed)
        return self.spark.range(stretches).mapInPandas(run, "shard long, slot int, source string, block long, repeat int")

    def rows(self) -> DataFrame:
        """(shard, slot, source, block, repeat, doc_id, start_token, end_token): the mixture as stretches of documents.

        No stretch is used more than max_repeats times.  The stretches of a slot in order of the source's stream are
        those by block; null sources, sources outside the target, null and empty texts take no part.
        """
        # the planner takes the slots for as small as their shards are few, so it must not choose a broadcast
        return self.slots().hint("merge").join(self.blocks(), ["source", "block"]).select(
            "shard", "slot", "source", "block", "repeat", "doc_id", "start_token", "end_token"
        )

    def reached(self) -> DataFrame:
        """(source, target_share, max_repeats, tokens_available, tokens_taken, most_repeats, reached_share) of each target."""
        got = self.rows().groupBy("source").agg(
            F.sum(F.col("end_token") - F.col("start_token")).alias("tokens_taken"), F.max("repeat").alias("most_repeats")
        )
        rows = [(s.source, float(s.target_share), int(s.max_repeats), int(s.tokens)) for s in self.shares]
        target = self.spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens_available long")
        all_ = target.join(got, "source", "left").fillna(0, ["tokens_taken", "most_repeats"])
        total = got.agg(F.coalesce(F.sum("tokens_taken"), F.lit(0)).alias("total"))
        share = F.when(F.col("total") > 0, F.col("tokens_taken") / F.col("total")).otherwise(0.0)
        return all_.crossJoin(F.broadcast(total)).withColumn("reached_share", share).drop("total")  # total is one row
