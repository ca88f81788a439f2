"""Same or near-same records across splits: minwise bands, cross-split candidates, exact Jaccard, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..skew import join_counted, key128
from ..storage import materialize, small_or_shuffled
from .bare import bare_doc_col, bare_text_col
from .minhash import WORD, Bands, bitmaps, counts, distances_at_least, edit_distance, few_lost, multiset_jaccard, symbols

#: Near texts may differ in a fifth of their characters, which leaves about half of their shingles of two characters
#: and a third of those of three.  Few minima a key and many keys make a shared key nearly sure at that rate.
QUERY = Bands(k=2, rows=2, bands=20, seed=13)
DOC = Bands(k=3, rows=2, bands=40, seed=15)
#: A short text has too few shingles of three.  Lengths of near texts differ by a fifth at most, so that of two near
#: texts both are at most SHORT_CHARS long or both at least LONG_CHARS: they have keys of the same family.
SHORT = Bands(k=2, rows=2, bands=40, seed=16)
SHORT_CHARS, LONG_CHARS = 30, 24
#: Pairs, or rows, from which a tile is divided.  How, changes no result.
PAIRS_OF_TILE, ROWS_OF_TILE = 4_000_000, 40_000
#: Pairs that are compared at once.
_BLOCK = 1 << 19
#: Ids that may be broadcast (8 bytes each); beyond, the same join runs by shuffle.
MOST_BROADCAST = 400_000
_QUERY_BITS = 256
#: Rows from which a stretch is compared as a block.
_STRETCH = 256


def doc_keys(texts: list[str]) -> list[np.ndarray]:
    """Band keys of each text, of one family or of both."""
    out = [np.zeros(0, np.int64)] * len(texts)
    for family, low, high in ((SHORT, 1, SHORT_CHARS), (DOC, LONG_CHARS, None)):
        at = [i for i, s in enumerate(texts) if len(s) >= low and (high is None or len(s) <= high)]
        if at:
            for i, keys in zip(at, family.keys([texts[i] for i in at])):
                out[i] = np.concatenate((out[i], keys))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _doc_bands(s: pd.Series) -> pd.Series:
    return pd.Series(doc_keys(s.fillna("").tolist()))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _query_bands(s: pd.Series) -> pd.Series:
    return pd.Series(list(QUERY.keys(s.fillna("").tolist())))


@F.pandas_udf(T.BinaryType())
def _sketch(s: pd.Series) -> pd.Series:
    """Bitmaps of the characters and of the shingles of two."""
    texts = s.fillna("").tolist()
    parts = (bitmaps(texts, 1, _QUERY_BITS, True), bitmaps(texts, 2, _QUERY_BITS, True))
    return pd.Series([b"".join(x) for x in zip(*(map(bytes, p) for p in parts))])


def similarity(a: str, b: str) -> float | None:
    """Exact Jaccard similarity of the 3-character shingles, counted with repetition, of two near strings, else null.

    The similarity must be what d edits leave at least: of n characters n - 2 - 3d shingles stay.  Then the exact edit
    distance decides.
    """
    n, m = (max(len(s), 3) - 2 for s in (a, b))
    most = max(len(a), len(b)) // 5
    left = max(n, m) - 3 * most
    found = multiset_jaccard(a, b, 3)
    if found * (n + m - left) < left - 1e-6 or abs(len(a) - len(b)) > most or edit_distance(a, b, most) > most:
        return None
    return found


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def near(a: str, b: str) -> Column:
    """Whether at most a fifth of the longer string's length in single-character edits turns column a into column b."""
    most = f"(greatest(length({a}), length({b})) div 5)"
    return F.expr(f"{a} = {b} OR (abs(length({a}) - length({b})) <= {most} AND levenshtein({a}, {b}, CAST({most} AS INT)) >= 0)")


def _with_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by example_id; ids is broadcast if its number, which is counted, is small."""
    return df.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "example_id", how)


def _ranges(groups: np.ndarray, side: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ones, zeros, low, many): rows of side 1, rows of side 0, and for each of the first, that it meets zeros[low : low + many].

    These are the rows in one group whose lengths allow them to be near.  Rows come sorted by group, side and length, so
    that each row of side 1 meets one stretch of rows of side 0.
    """
    new = np.concatenate(([True], groups[1:] != groups[:-1]))
    ids = np.cumsum(new) - 1
    ones, zeros = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    # group and length in one number that rises over the rows of side 0
    wide = int(length.max(initial=0)) * 2 + 2
    rising = ids[zeros] * wide + length[zeros]
    n = length[ones]
    low = np.searchsorted(rising, ids[ones] * wide + (n - n // 5), "left")
    high = np.searchsorted(rising, ids[ones] * wide + (n * 5 // 4), "right")
    many = np.maximum(high - low, 0)
    keep = many > 0
    return ones[keep], zeros, low[keep], many[keep]


def _pairs_of(ones: np.ndarray, zeros: np.ndarray, low: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of _ranges(), in blocks."""
    upto = np.concatenate(([0], np.cumsum(many)))
    i = 0
    while i < len(ones):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + _BLOCK, "right")) - 1)
        m = many[i:j]
        at = np.arange(upto[j] - upto[i]) - np.repeat(upto[i:j] - upto[i], m)
        yield np.repeat(ones[i:j], m), zeros[np.repeat(low[i:j], m) + at]
        i = j


def _products(groups: np.ndarray, side: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (e, t) of the pairs with side 1 and 0 in one group whose lengths allow them to be near, in blocks."""
    return _pairs_of(*_ranges(groups, side, length))


def _whole_tiles(answer: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]):
    """A function for mapInPandas that gives ``answer`` only whole tiles, from rows sorted by tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            tiles = b["tile"].to_numpy()
            if not len(tiles):
                continue
            last = int(np.searchsorted(tiles, tiles[-1]))
            if last:
                yield from answer(pd.concat([*held, b.iloc[:last]], ignore_index=True))
                held = []
            elif held and held[-1]["tile"].iloc[-1] != tiles[0]:
                yield from answer(pd.concat(held, ignore_index=True))
                held = []
            held.append(b.iloc[last:])
        if held:
            yield from answer(pd.concat(held, ignore_index=True))

    return run


def _few_lost_pairs(bits: np.ndarray, groups: np.ndarray, side: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of _products() that can be near by their bitmaps of characters.

    Rows of side 1 that meet one long stretch are compared with it as a block, by words, without lists of their pairs.
    """
    ones, zeros, low, many = _ranges(groups, side, length)
    long = many >= _STRETCH
    for u, v in _pairs_of(ones[~long], zeros, low[~long], many[~long]):
        good = few_lost(bits, u, bits, v, np.maximum(length[u], length[v]) // 5)
        yield u[good], v[good]
    ones, low, many = ones[long], low[long], many[long]
    if not len(ones):
        return
    words = np.ascontiguousarray(bits[zeros].T)
    n, size = (x.astype(np.int16) for x in (np.bitwise_count(bits).sum(1, dtype=np.int16), length // 5))
    edges = np.concatenate(([0], np.flatnonzero((low[1:] != low[:-1]) | (many[1:] != many[:-1])) + 1, [len(ones)]))
    for i, j in zip(edges[:-1], edges[1:]):
        step = max(1, (1 << 17) // int(many[i]))
        stretch = slice(int(low[i]), int(low[i] + many[i]))
        v = zeros[stretch]
        for k in range(i, j, step):
            u = ones[k : min(k + step, j)]
            common = np.zeros((len(u), len(v)), np.int16)
            for w in range(bits.shape[1]):
                common += np.bitwise_count(bits[u, w][:, None] & words[w, stretch])
            common += np.maximum(size[u][:, None], size[v])
            x, y = np.nonzero(common >= np.maximum(n[u][:, None], n[v]))
            yield u[x], v[y]


def _near_texts(b: pd.DataFrame, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (u, v) of the pairs of one bucket that can be near, each in the first bucket that the two share.

    By the bounds on lost characters and shingles, then by the distance.
    """
    sketch = np.frombuffer(b"".join(b["sketch"]), np.uint64).reshape(len(b), -1)
    bits = np.split(sketch, 2, axis=1)
    band, s = b["band"].to_numpy(), b["s"].to_numpy()
    _, first, text = np.unique(b["id"].to_numpy(), return_index=True, return_inverse=True)
    keys, chars, known = np.zeros((QUERY.bands, len(first)), np.int64), np.zeros((len(first), WORD), np.uint8), np.zeros(len(first), bool)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rest() -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate(x) for x in zip(*held))
        held.clear()
        good = few_lost(bits[1], u, bits[1], v, 2 * (np.maximum(length[u], length[v]) // 5))
        u, v = u[good], v[good]
        new = np.unique(np.concatenate((text[u], text[v])))
        new = new[~known[new]]
        if len(new):
            texts = s[first[new]].tolist()
            keys[:, new], chars[new], known[new] = QUERY.keys(texts).T, symbols([x[:WORD] for x in texts]), True
        x, y, upto = text[u], text[v], band[u]
        for g in range(QUERY.bands):
            good = np.flatnonzero((upto <= g) | (keys[g][x] != keys[g][y]))
            if len(good) < len(u):
                u, v, x, y, upto = u[good], v[good], x[good], y[good], upto[good]
        short = (length[u] <= WORD) & (length[v] <= WORD)
        x, y = text[u[short]], text[v[short]]
        size = length[first]
        good = np.ones(len(u), bool)
        good[short] = distances_at_least(chars, np.minimum(size, WORD), x, chars, size, y) <= np.maximum(size[x], size[y]) // 5
        return u[good], v[good]

    n = 0
    for u, v in _few_lost_pairs(np.ascontiguousarray(bits[0]), b["tile"].to_numpy(), b["e"].to_numpy(), length):
        held.append((u, v))
        n += len(u)
        if n >= _BLOCK:
            yield rest()
            n = 0
    if held:
        yield rest()


def _compared(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pairs of one bucket; those with sketches, if these can be near."""
    b = b.sort_values(["tile", "e", "len"], kind="stable")
    ids, length = b["id"].to_numpy(), b["len"].to_numpy().astype(np.int64)
    near_pairs = _near_texts(b, length) if "sketch" in b else _products(b["tile"].to_numpy(), b["e"].to_numpy(), length)
    for u, v in near_pairs:
        yield pd.DataFrame({"id_e": ids[u], "id_t": ids[v]}).drop_duplicates()


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (id_e, id_t) of the rows (tile, e, id, len) with one tile, e 1 and 0, and lengths that can be near.

    With the columns sketch, s (the text) and band (the number of the key), also of texts that can be near.  A bucket of more than PAIRS_OF_TILE pairs or ROWS_OF_TILE
    rows is cut into chunks by id, and each chunk of one side meets each of the other, so that nothing is lost.
    """
    k_e, k_t = F.sum("e").alias("k_e"), F.sum(1 - F.col("e")).alias("k_t")
    live = rows.groupBy("tile").agg(k_e, k_t).where("k_e > 0 AND k_t > 0")
    hot = live.where((F.col("k_e") * F.col("k_t") > PAIRS_OF_TILE) | (F.col("k_e") + F.col("k_t") > ROWS_OF_TILE))
    side = float(min(PAIRS_OF_TILE**0.5, ROWS_OF_TILE / 2))
    c = [F.ceil(F.col(x) / side).cast("int").alias(f"c_{x[2:]}") for x in ("k_e", "k_t")]
    hot = materialize(hot.select("tile", *c), "hot-tiles")
    one = F.coalesce(F.col("c_e"), F.lit(1)), F.coalesce(F.col("c_t"), F.lit(1))
    own, other = (F.when(F.col("e") == 1, x).otherwise(y) for x, y in (one, one[::-1]))
    cut = rows.join(small_or_shuffled(hot), "tile", "left")
    cut = cut.withColumn("i", F.pmod(F.xxhash64("id"), own).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), other - 1)))
    place = (F.when(F.col("e") == 1, F.col(x)).otherwise(F.col(y)) for x, y in (("i", "j"), ("j", "i")))
    keys = [c for c in rows.columns if c != "tile"]
    cut = cut.select(F.when(F.col("c_e").isNull(), F.col("tile")).otherwise(F.xxhash64("tile", *place)).alias("tile"), *keys)
    cut = cut.repartition("tile").sortWithinPartitions("tile")
    return cut.mapInPandas(_whole_tiles(_compared), "id_e long, id_t long").distinct()


def near_queries(queries: DataFrame) -> DataFrame:
    """(qe, qt, k_e, k_t): the keys of all near queries of which one has rows of dev or test and the other of train."""
    q = queries.select("q", "k_e", "k_t", "bq", F.length("bq").alias("len"), _sketch("bq").alias("sketch"), _query_bands("bq").alias("bands"))
    sides = F.array(*(F.when(F.col(c) > 0, F.lit(e)) for c, e in (("k_e", 1), ("k_t", 0))))
    rows = q.withColumn("e", F.explode(F.array_compact(sides))).select(
        F.posexplode("bands").alias("band", "tile"), "e", F.col("q").alias("id"), "len", "sketch", F.col("bq").alias("s")
    )
    found = materialize(bucket_pairs(rows), "query-pairs")
    a, b = (queries.select(F.col("q").alias(f"id_{x}"), F.col("bq").alias(f"s_{x}"), f"k_{x}") for x in "et")
    found = found.join(small_or_shuffled(a), "id_e").join(small_or_shuffled(b), "id_t")
    return found.where(near("s_e", "s_t")).select(F.col("id_e").alias("qe"), F.col("id_t").alias("qt"), "k_e", "k_t")


def _maybe_near(s_e: np.ndarray, s_t: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs (s_e[u], s_t[v]) can be near by the bounds on lost shingles; no near pair is missing.

    First by the bits of shingles, then what is left by their counts, which tell repetitions apart.
    """
    good = np.zeros(len(u), bool)
    la, lb = (np.fromiter(map(len, s), np.int64, len(s)) for s in (s_e, s_t))
    longer = np.maximum(la[u], lb[v])
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(longer, 1) * 4)).astype(np.int64))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        step = max(1, (1 << 24) // int(w))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            (x, x_at), (y, y_at) = (np.unique(z[part], return_inverse=True) for z in (u, v))
            bits = [bitmaps([s[r] for r in z], DOC.k, int(w)) for s, z in ((s_e, x), (s_t, y))]
            good[part] = few_lost(bits[0], x_at, bits[1], y_at, DOC.k * (longer[part] // 5))
        at = at[good[at]]
        step = max(1, (1 << 21) // int(w))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            (x, x_at), (y, y_at) = (np.unique(z[part], return_inverse=True) for z in (u, v))
            for k in (1, 2, 3):
                a, b = (counts([s[r] for r in z], k, int(w)) for s, z in ((s_e, x), (s_t, y)))
                common = np.minimum(a[x_at], b[y_at]).sum(1)
                good[part] &= np.maximum(la[u[part]], lb[v[part]]) - k + 1 - common <= k * (longer[part] // 5)
    return good


def _shared_bands(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The pairs of docs in one tile that share a band key and can be near, with the docs."""
    ids, s, side = b["id"].to_numpy(), b["s"].to_numpy(), b["e"].to_numpy()
    length = np.fromiter(map(len, s), np.int64, len(s))
    _, tile = np.unique(b["tile"].to_numpy(), return_inverse=True)
    keys = doc_keys(s.tolist())
    row = np.repeat(np.arange(len(s)), [len(k) for k in keys])
    with np.errstate(over="ignore"):
        key = np.concatenate(keys) + tile[row] * np.int64(-7046029254386353131)
    order = np.lexsort((length[row], side[row], key))
    row, key = row[order], key[order]
    seen = [np.unique(u * np.int64(len(s)) + v) for u, v in ((row[x], row[y]) for x, y in _products(key, side[row], length[row]))]
    pairs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
    u, v = pairs // len(s), pairs % len(s)
    good = (ids[u] != ids[v]) & (tile[u] == tile[v])
    u, v = u[good], v[good]
    good = _maybe_near(s, s, u, v)
    u, v = u[good], v[good]
    for i in range(0, len(u), 5_000):
        x, y = u[i : i + 5_000], v[i : i + 5_000]
        yield pd.DataFrame({"id_e": ids[x], "id_t": ids[y], "s_e": s[x], "s_t": s[y]})


@F.pandas_udf(T.BooleanType())
def _can_be_near(a: pd.Series, b: pd.Series) -> pd.Series:
    at = np.arange(len(a))
    return pd.Series(_maybe_near(a.to_numpy(), b.to_numpy(), at, at))


class Overlaps:
    """The classes of equal records, and the pairs of near classes that stand in different splits.

    A class is all rows with equal bare forms of query and doc, named by its smallest example_id (``rep``), so copies
    are compared once.  A pair has a class with rows of dev or test (``rep_e``) and a class with rows of train
    (``rep_t``).  Void records, and rows of other or null splits, take no part.
    """

    def __init__(self, df: DataFrame) -> None:
        split = F.lower(F.trim("split"))
        rows = df.where(split.isin("train", "dev", "test")).select(
            "example_id",
            "split",
            "dataset",
            (split == "train").cast("int").alias("t"),
            bare_text_col(F.col("query")).alias("bq"),
            bare_doc_col(F.col("doc")).alias("bd"),
        )
        rows = rows.where((F.col("bq") != "") & (F.col("bd") != "")).withColumn("key", key128(F.col("bq"), F.col("bd")))
        self.rows = materialize(rows, "bare")
        classes = self.rows.groupBy("key").agg(
            F.min("example_id").alias("rep"),
            F.count(F.lit(1)).alias("n"),
            F.sum("t").alias("n_t"),
            F.sum(1 - F.col("t")).alias("n_e"),
        )
        self.classes = materialize(classes, "classes")
        self.total = self.rows.count()
        members = join_counted(self.rows.select("example_id", "split", "dataset", "t", "key"), self.classes, "key", "n", self.total)
        self.members = materialize(members.select("example_id", "split", "dataset", "t", "rep", "n", "n_t", "n_e"), "members")

    def candidates(self) -> DataFrame:
        """(id_e, id_t, s_e, s_t): representatives and docs of the classes with near queries whose docs can be near.

        Docs of near queries meet in the tile of that query of the two that has more docs, so the fewer docs move.
        Docs of a tile that share a band key are compared.  The docs of an ordinary tile get their keys there; those
        of a large one are shuffled by key, without their texts.
        """
        later = self.members.where(F.col("example_id") != F.col("rep")).select("example_id")
        rep = _with_ids(self.rows.select("example_id", "bq", "bd", "t"), later, "left_anti")
        # a class that stands on one side has the side of its first row; the few others are looked up
        odd = self.classes.where((F.col("n_t") > 0) & (F.col("n_e") > 0)).select(F.col("rep").alias("example_id"), F.lit(1).alias("both"))
        odd = F.broadcast(odd) if odd.count() <= MOST_BROADCAST else odd
        both = F.coalesce(F.col("both"), F.lit(0)) == 1
        rep = rep.join(odd, "example_id", "left").select(
            F.col("example_id").alias("id"),
            "bq",
            F.xxhash64("bq").alias("q"),
            F.col("bd").alias("s"),
            F.when(both | (F.col("t") == 0), F.lit(1)).otherwise(F.lit(0)).alias("k_e"),
            F.when(both | (F.col("t") == 1), F.lit(1)).otherwise(F.lit(0)).alias("k_t"),
        )
        queries = materialize(rep.groupBy("q", "bq").agg(F.sum("k_e").alias("k_e"), F.sum("k_t").alias("k_t")), "queries")
        pairs = near_queries(queries)
        tile = F.when(F.col("k_e") > F.col("k_t"), F.xxhash64(F.lit(1), "qe")).otherwise(F.xxhash64(F.lit(0), "qt"))
        pairs = materialize(pairs.withColumn("tile", tile), "near-queries")
        places = pairs.select("tile", F.lit(1).alias("e"), F.col("qe").alias("q"), F.col("k_e").alias("k"))
        places = places.unionByName(pairs.select("tile", F.lit(0).alias("e"), F.col("qt").alias("q"), F.col("k_t").alias("k"))).distinct()
        n_e, n_t = (F.sum(F.when(F.col("e") == x, F.col("k")).otherwise(0)) for x in (1, 0))
        large = places.groupBy("tile").agg(((n_e * n_t > PAIRS_OF_TILE) | (n_e + n_t > ROWS_OF_TILE)).alias("large"))
        places = materialize(places.join(large, "tile").select("tile", "e", "q", "large"), "places")
        sides = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(e)) for c, e in (("k_e", 1), ("k_t", 0)))))
        rows = rep.select("id", "q", "s", F.explode(sides).alias("e"))
        usual = rows.join(small_or_shuffled(places.where("NOT large").drop("large")), ["q", "e"])
        usual = usual.select("tile", "e", "id", "s").repartition("tile").sortWithinPartitions("tile")
        usual = usual.mapInPandas(_whole_tiles(_shared_bands), "id_e long, id_t long, s_e string, s_t string")
        return usual.unionByName(self._of_large_tiles(rows.join(small_or_shuffled(places.where("large").drop("large")), ["q", "e"])))

    @staticmethod
    def _of_large_tiles(rows: DataFrame) -> DataFrame:
        """candidates() of the rows (tile, e, id, s) of tiles too large for one task."""
        rows = materialize(rows.select("tile", "e", "id", "s", F.length("s").alias("len"), _doc_bands("s").alias("bands")), "large-tiles")
        keys = rows.select("tile", "e", "id", "len", F.explode("bands").alias("key")).select(F.xxhash64("tile", "key").alias("tile"), "e", "id", "len")
        found = materialize(bucket_pairs(keys).where("id_e <> id_t"), "large-pairs")
        for side, e in (("e", 1), ("t", 0)):
            docs = rows.where(F.col("e") == e).select(F.col("id").alias(f"id_{side}"), F.col("s").alias(f"s_{side}"))
            found = found.join(docs.dropDuplicates([f"id_{side}"]), f"id_{side}")
        return found.where(_can_be_near("s_e", "s_t")).select("id_e", "id_t", "s_e", "s_t")

    def verified(self) -> DataFrame:
        """(rep_e, rep_t, jaccard) of the pairs of different classes whose queries and docs are near."""
        found = materialize(self.candidates(), "candidates").withColumn("jaccard", _similarity.asNondeterministic()("s_e", "s_t"))
        found = found.where(F.col("jaccard").isNotNull())
        return found.select(F.col("id_e").alias("rep_e"), F.col("id_t").alias("rep_t"), "jaccard")

    def class_pairs(self) -> DataFrame:
        """verified(), and each class that stands on both sides with itself."""
        own = self.classes.where((F.col("n_t") > 0) & (F.col("n_e") > 0))
        own = own.select(F.col("rep").alias("rep_e"), F.col("rep").alias("rep_t"), F.lit(1.0).alias("jaccard"))
        return self.verified().unionByName(own)


def cross_split_pairs(df: DataFrame) -> DataFrame:
    """(example_id_a, example_id_b), a < b: all pairs of a train row and a dev or test row that are near."""
    o = Overlaps(df)
    pairs = materialize(o.class_pairs(), "class-pairs").select("rep_e", "rep_t")
    e = o.members.where(F.col("t") == 0).select(F.col("rep").alias("rep_e"), F.col("example_id").alias("x"))
    t = o.members.where(F.col("t") == 1).select(F.col("rep").alias("rep_t"), F.col("example_id").alias("y"))
    both = pairs.join(e, "rep_e").join(t, "rep_t")
    return both.select(F.least("x", "y").alias("example_id_a"), F.greatest("x", "y").alias("example_id_b"))


def class_links(df: DataFrame) -> DataFrame:
    """(rep_e, rep_t, jaccard) of the near classes: pairs of representatives, copies not expanded."""
    return Overlaps(df).class_pairs()


def report(df: DataFrame) -> DataFrame:
    """(split, dataset, n_rows, n_pairs): rows of dev and test that stand in train too, and their pairs with train rows.

    Pairs are counted from the sizes of classes, not expanded.  A null dataset is a dataset of its own.
    """
    o = Overlaps(df)
    pairs = o.class_pairs().select("rep_e", "rep_t")
    size = o.classes.select(F.col("rep").alias("rep_t"), "n_t")
    per = pairs.join(size, "rep_t").groupBy("rep_e").agg(F.sum("n_t").alias("k"))
    e = o.members.where(F.col("t") == 0).groupBy("rep", "split", "dataset").agg(F.count(F.lit(1)).alias("m"))
    got = e.join(per, F.col("rep") == F.col("rep_e"))
    return got.groupBy("split", "dataset").agg(F.sum("m").alias("n_rows"), F.sum(F.col("m") * F.col("k")).alias("n_pairs"))
