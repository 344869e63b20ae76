"""The k most similar vectors of every vector, by a block matrix join.

Vectors of one model are put into blocks by the nearest of a few of them, so that most neighbours share
a block; a block's own tile gives each vector a least cosine that a neighbour must reach. Every other pair
of blocks is one more tile of the matrix of cosines, of which only what reaches that is moved. Blocks are
kept once, in the checkpoint folder, and each task reads those of its tiles from there. A tile is first multiplied in int8 (integer values in a float32 product, which is exact
here), and each product has a bound on its quantisation error. A pair survives if it may be among the
k best of its row or its column; survivors are computed again in float64, the k best of each row are
kept, and the tiles' lists are merged. The result is exact up to float rounding, not approximate.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import cut_lineage

BLOCK_ROWS = 8_192
ROWS_AT_ONCE = 1_024
GROUP = 64
PAIRS_AT_ONCE = 131_072
BLOCKS_A_PART, LEAST_PARTS = 16, 24


def usable_vectors(store: DataFrame) -> DataFrame:
    """(vec_id, model, dim, vector): not null, ``dim`` finite elements, not all zeros; a vec_id counts once.

    Of several usable rows of one vec_id the one stored last counts. Rows with a null vec_id, model
    or dim are not usable.
    """
    fine = store.select("vec_id", "model", "dim", "vector", "created_at").where(
        F.col("vec_id").isNotNull()
        & F.col("model").isNotNull()
        & (F.size("vector") == F.col("dim"))
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    last = fine.groupBy("vec_id").agg(F.max(F.struct("created_at", "model", "dim", "vector")).alias("v"))
    return last.select("vec_id", "v.model", "v.dim", "v.vector")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8 codes: (codes, scales, norms of the errors, norms of the decoded rows)."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(x - decoded, axis=1), np.linalg.norm(decoded, axis=1)


def _kth(best: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column; -inf where there are fewer than k."""
    if best.shape[0] < k:
        return np.full(best.shape[1], -np.inf, best.dtype)
    return np.partition(best, best.shape[0] - k, axis=0)[best.shape[0] - k]


def _group_max(x: np.ndarray, group: int = GROUP) -> np.ndarray:
    """Maxima of groups of rows: any k of them are k different entries of the column."""
    n = x.shape[0]
    if n <= group:
        return x
    whole = n - n % group
    top = x[:whole].reshape(group, whole // group, x.shape[1]).max(axis=0)
    return np.vstack([top, x[whole:].max(axis=0)[None]]) if whole < n else top


def tile_survivors(a: np.ndarray, b: np.ndarray, k: int, same: bool, least_a: np.ndarray | None = None, least_b: np.ndarray | None = None) -> np.ndarray:
    """Index pairs (i, j) that may be among the k best of row i or of column j, as an array of shape (m, 2).

    ``least_a`` and ``least_b``: cosines that k others of each row and column already reach; where all are known, they alone decide.
    """
    known = least_a is not None and bool(np.isfinite(least_a).all() and np.isfinite(least_b).all())
    qa, sa, ea, _ = quantise(a)
    qb, sb, eb, nb = quantise(b)
    right = (qb.astype(np.float32)).T.copy()
    # |a.b - a~.b~| <= |b - b~| |a| + |a - a~| |b~|, with a little for the rounding of the scaled product
    far_b, long_b = float(eb.max()), float(nb.max())
    slack_row = far_b + ea * long_b + 1e-6
    slack_col = eb + float(ea.max()) * nb + 1e-6
    sb32 = sb.astype(np.float32)
    col_best = np.zeros((0, len(b)), np.float32)
    found = []
    for at in range(0, len(a), ROWS_AT_ONCE):
        to = min(at + ROWS_AT_ONCE, len(a))
        x = qa[at:to].astype(np.float32) @ right
        x *= sb32
        x *= sa[at:to, None].astype(np.float32)
        if same:
            x[np.arange(to - at), np.arange(at, to)] = -4.0
        if known:
            keep = x >= (least_a[at:to] - slack_row[at:to]).astype(np.float32)[:, None]
            keep |= x >= (least_b - slack_col).astype(np.float32)[None, :]
        else:
            row_kth = _kth(_group_max_cols(x).T, k)
            keep = x >= (row_kth - 2 * slack_row[at:to])[:, None]
        if not same and not known:
            col_best = np.vstack([col_best, _group_max(x)])
            if len(col_best) > k:
                col_best = np.partition(col_best, len(col_best) - k, axis=0)[len(col_best) - k :]
            keep |= x >= (_kth(col_best, k) - 2 * slack_col)[None, :]
        i, j = np.nonzero(keep)
        if same:
            i, j = i[i + at != j], j[i + at != j]
        found.append(np.stack([i + at, j], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _group_max_cols(x: np.ndarray, group: int = GROUP) -> np.ndarray:
    """Like _group_max, for groups of columns."""
    n = x.shape[1]
    if n <= group:
        return x
    whole = n - n % group
    top = x[:, :whole].reshape(x.shape[0], group, whole // group).max(axis=1)
    return np.hstack([top, x[:, whole:].max(axis=1)[:, None]]) if whole < n else top


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _best(who: np.ndarray, whom: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best partners of each of ``who``; of equal scores the smaller id."""
    order = np.lexsort((whom, -score, who))
    who, whom, score = who[order], whom[order], score[order]
    first = np.r_[0, np.flatnonzero(np.diff(who)) + 1] if len(who) else np.zeros(0, int)
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    return who[rank < k], whom[rank < k], score[rank < k]


def tile_neighbours(
    ids_a: np.ndarray, va: np.ndarray, ids_b: np.ndarray, vb: np.ndarray, k: int, same: bool, least_a: np.ndarray | None = None, least_b: np.ndarray | None = None
) -> pd.DataFrame:
    """The k best partners of each vector within one tile, with exact cosines; with ``least_a`` and ``least_b`` only those that reach them."""
    a, b = _unit(va), _unit(vb)
    pairs = tile_survivors(a, b, k, same, least_a, least_b)
    score = np.empty(len(pairs))
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        p = pairs[at : at + PAIRS_AT_ONCE]
        score[at : at + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", a[p[:, 0]], b[p[:, 1]])
    left, right = ids_a[pairs[:, 0]], ids_b[pairs[:, 1]]
    high_a, high_b = (slice(None) if least is None else score >= least[pairs[:, n]] - 1e-9 for n, least in enumerate((least_a, least_b)))
    parts = [_best(left[high_a], right[high_a], score[high_a], k)]
    if not same:
        parts.append(_best(right[high_b], left[high_b], score[high_b], k))
    who, whom, cos = (np.concatenate(x) for x in zip(*parts))
    return pd.DataFrame({"vec_id": who, "other_id": whom, "cosine": cos})




def least_cosines(ids: np.ndarray, near: pd.DataFrame, k: int) -> np.ndarray:
    """For each of the sorted ``ids`` the k-th highest cosine in ``near``; -inf where it has fewer than k."""
    at = np.searchsorted(ids, near["vec_id"].to_numpy())
    least = np.full(len(ids), np.inf)
    np.minimum.at(least, at, near["cosine"].to_numpy())
    least[np.bincount(at, minlength=len(ids)) < k] = -np.inf
    return least


def in_cells(vectors: DataFrame, store: DataFrame, block_rows: int) -> DataFrame:
    """``vectors`` with a cell: the nearest of about one in ``block_rows`` vectors of their model, which are sent out."""
    some = store.where(F.col("vec_id").isNotNull() & F.col("model").isNotNull() & (F.size("vector") == F.col("dim")))
    large = some.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    picked = usable_vectors(some.join(F.broadcast(large), ["model", "dim"]).where(F.pmod(F.xxhash64("vec_id", F.lit(29)), F.lit(max(1, block_rows // 2))) == 0))
    found: dict[tuple, list] = {}
    for _, model, dim, vector in picked.collect():
        found.setdefault((model, dim), []).append(vector)
    centres = {key: _unit(np.array(x[: max(1, len(x) // 2)])).astype(np.float32) for key, x in found.items()}
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for key, at in pdf.groupby(["model", "dim"]).indices.items():
                if (c := sent.value.get(key)) is not None:
                    x = _unit(np.stack(pdf["vector"].iloc[at].to_list()))
                    cell[at] = np.concatenate([(x[k : k + ROWS_AT_ONCE].astype(np.float32) @ c.T).argmax(axis=1) for k in range(0, len(x), ROWS_AT_ONCE)])
            yield pdf.assign(cell=cell)

    return vectors.mapInPandas(assign, "vec_id bigint, model string, dim int, vector array<float>, cell int")


def nearest_vectors(store: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, other_id, cosine): the k vectors of highest cosine to each usable vector of the same model.

    Equal cosines are decided by the smaller id. Of vectors that are equal element by element only the
    first k + 1 ids go through the tiles; all others have the first k of them as their neighbours, so a
    group of copies never meets itself pair by pair. Models with one vector give no row; repeated rows,
    nulls and unusable vectors are left out (usable_vectors); an empty store gives an empty result.
    Vectors are moved twice, by id and by block, whatever the number of blocks.
    """
    spark = store.sparkSession
    vectors = cut_lineage(in_cells(usable_vectors(store), store, block_rows).withColumns({"h1": F.xxhash64("vector"), "h2": F.hash("vector")}))
    alike, cell, key = ["model", "dim", "h1", "h2"], ["model", "dim", "cell"], ["model", "dim", "block"]
    rank = F.row_number().over(Window.partitionBy(*alike).orderBy("vec_id"))
    ids = vectors.select("vec_id", *alike, "cell")
    firsts = ids.select("vec_id", *alike).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    full = firsts.groupBy(*alike).agg(F.sort_array(F.collect_list("vec_id")).alias("firsts")).where(F.size("firsts") == k + 1)
    outside = ids.join(full, alike).where(~F.array_contains("firsts", F.col("vec_id")))
    copies = outside.select("vec_id", F.explode(F.slice("firsts", 1, k)).alias("other_id"), F.lit(1.0).alias("cosine"))

    every = vectors.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    left_out = outside.groupBy(*cell).agg(F.count(F.lit(1)).alias("out"))
    kept = F.col("n") - F.coalesce("out", F.lit(0))
    blocks = F.greatest(F.lit(1), F.ceil(kept / block_rows), F.ceil(F.col("n") / (8 * block_rows)))
    sizes = cut_lineage(every.join(left_out, cell, "left").select(*cell, blocks.cast("bigint").alias("blocks")))
    total = sizes.agg(F.sum("blocks")).first()[0] or 1
    parts = min(total, max(LEAST_PARTS, -(-total // BLOCKS_A_PART)))

    def placed(df: DataFrame, *columns: str) -> DataFrame:
        block = F.shiftleft(F.col("cell").cast("bigint"), 32) + F.pmod(F.xxhash64("vec_id", F.lit(17)), "blocks")
        return df.join(F.broadcast(sizes), cell).select(F.col("model").alias("model"), F.col("dim").alias("dim"), block.alias("block"), *(F.col(c).alias(c) for c in columns)).repartition(parts, *key).groupBy(*key)

    names = ["ids", "data", "least", "who", "whom", "cosine"]

    def pack(key: tuple, pdf: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[~pdf["vec_id"].isin(out["vec_id"])].sort_values("vec_id")
        if mine.empty:
            return pd.DataFrame(columns=["model", "dim", "block", *names])
        ids, x = mine["vec_id"].to_numpy(np.int64), np.stack(mine["vector"].to_list()).astype(np.float32)
        near = tile_neighbours(ids, x, ids, x, k, True)
        held = [ids, x, least_cosines(ids, near, k), near["vec_id"].to_numpy(np.int64), near["other_id"].to_numpy(np.int64), near["cosine"].to_numpy(float)]
        return pd.DataFrame([[*key, *(v.tobytes() for v in held)]], columns=["model", "dim", "block", *names])

    packed = cut_lineage(
        placed(vectors, "vec_id", "vector").cogroup(placed(outside, "vec_id")).applyInPandas(pack, "model string, dim int, block bigint, " + ", ".join(f"{n} binary" for n in names))
    )

    def own(batches):
        for pdf in batches:
            for who, whom, cosine in zip(pdf["who"], pdf["whom"], pdf["cosine"]):
                yield pd.DataFrame({"vec_id": np.frombuffer(who, np.int64), "other_id": np.frombuffer(whom, np.int64), "cosine": np.frombuffer(cosine)})

    def multiply(batches):
        for pdf in batches:
            for dim, ids_a, data_a, least_a, ids_b, data_b, least_b in pdf.itertuples(index=False):
                a, b = np.frombuffer(data_a, np.float32).reshape(-1, dim), np.frombuffer(data_b, np.float32).reshape(-1, dim)
                yield tile_neighbours(np.frombuffer(ids_a, np.int64), a, np.frombuffer(ids_b, np.int64), b, k, False, np.frombuffer(least_a), np.frombuffer(least_b))

    # without a shuffle: each task reads the blocks of two parts of the checkpoint
    a, b = (packed.select(*(F.col(c).alias(f"{c}_{n}") for c in [*key, *names[:3]])).hint("shuffle_replicate_nl") for n in "ab")
    pairs = a.join(b, (F.col("model_a") == F.col("model_b")) & (F.col("dim_a") == F.col("dim_b")) & (F.col("block_a") < F.col("block_b")))
    result = "vec_id bigint, other_id bigint, cosine double"
    tiled = packed.select("who", "whom", "cosine").mapInPandas(own, result).unionByName(
        pairs.select("dim_a", "ids_a", "data_a", "least_a", "ids_b", "data_b", "least_b").mapInPandas(multiply, result)
    )
    best = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other_id"))
    top = tiled.withColumn("rank", best).where(F.col("rank") <= k).drop("rank")
    return top.unionByName(copies)


def neighbour_pairs(store: DataFrame, k: int = 5) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: pairs in which one is among the k nearest of the other."""
    near = nearest_vectors(store, k)
    return near.select(
        F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")
    ).distinct()
