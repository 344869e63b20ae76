"""Exact and near duplicates of texts and vectors."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import cut_lineage, shuffle_width

PERMUTATIONS, BANDS, SHINGLE, THRESHOLD = 128, 16, 5, 0.7
# So many of the bands join what is much alike before all pairs of the pieces' buckets are compared.
FIRST_BANDS = 4


def exact_groups(docs: DataFrame) -> DataFrame:
    """(text_md5, n, first_id, sources): texts that more than one document has."""
    return (
        docs.where(F.length("text") > 0)
        .groupBy(F.md5("text").alias("text_md5"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
        .where(F.col("n") > 1)
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """(doc_id): the smallest id of each (first 100 characters, source)."""
    return docs.where(F.length("text") > 0).groupBy(F.substring("text", 1, 100).alias("head"), "source").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def coefficients(n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of n permutations of the 64-bit numbers."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Different 64-bit hashes of the character shingles: a polynomial of the code points over a rolling window, mixed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(codes) - shingle + 1, np.uint64)
    for k in range(shingle):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)] + np.uint64(1)
    for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(by)
    return np.unique(h ^ h >> np.uint64(31))


def signature(text: str, a: np.ndarray, b: np.ndarray, shingle: int = SHINGLE) -> np.ndarray | None:
    """The high 31 bits of the minima of (a * s + b) mod 2 ** 64 over the hashes of the character shingles; None for shorter texts."""
    if len(text) < shingle:
        return None
    s = shingle_hashes(text, shingle)
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        x = np.multiply(a[:, None], s[None, at : at + 512])
        x += b[:, None]
        np.minimum(best, x.min(axis=1), out=best)
    return best >> np.uint64(33)


def sketch(places: np.ndarray) -> np.ndarray:
    """The two low bits of each place, packed: two signatures differ in at least as many places as their sketches do."""
    bits = np.packbits(np.stack([places & 1, places >> 1 & 1], 1).astype(np.uint8).ravel(), bitorder="little")
    return np.pad(bits, (0, -len(bits) % 8)).view(np.uint64)


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    x = p ^ q
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int64)


def _likely(tile: np.ndarray, sketches: np.ndarray, component: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within equal ``tile`` numbers (sorted) whose sketches differ in at most ``most`` places and whose components are not yet one."""
    _, starts, sizes = np.unique(tile, return_index=True, return_counts=True)
    small = np.repeat(sizes <= 64, sizes)
    for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
        i = np.flatnonzero((tile[:-d] == tile[d:]) & small[:-d] & (component[:-d] != component[d:]))
        if len(i):
            i = i[_differ(sketches[i], sketches[i + d]) <= most]
            yield i, i + d
    for start, m in zip(starts[sizes > 64], sizes[sizes > 64]):
        for at in range(start, start + m, 256):
            end = min(at + 256, start + m)
            i, j = np.nonzero(_differ(sketches[at:end, None], sketches[None, at : start + m]) <= most)
            i, j = i + at, j + at
            keep = (i < j) & (component[i] != component[j])
            yield i[keep], j[keep]


def minhash_classes(
    docs: DataFrame, permutations: int = PERMUTATIONS, bands: int = BANDS, threshold: float = THRESHOLD, block_rows: int = 4096, first_bands: int = FIRST_BANDS
) -> DataFrame:
    """(doc_id, class_id): one row per document with a text.

    Documents whose signatures agree in at least ``threshold`` of the places are linked; ``class_id``
    is the smallest id reachable by links. First, within each of ``first_bands`` of ``bands`` bands, a text is compared
    with its bucket's first one and its neighbour in the order of the next band's hash, which joins the
    texts that are much alike. Then the signature is cut into one piece more than the places in which
    two linked signatures can differ, so that linked ones agree in at least one whole piece: within
    each piece's buckets that hold more than one class all pairs not yet in one are compared, by sketches
    and then by whole signatures. So no link is missed. Buckets of more than ``block_rows`` texts are compared in tiles
    of two blocks. Equal texts share a class. Texts shorter than a shingle are compared exactly; null
    and empty texts are left out; repeated rows of an id count once.
    """
    a, b = coefficients(permutations)
    rows, joined = permutations // bands, min(bands, first_bands)
    most = permutations - next(k for k in range(permutations + 1) if k / permutations >= threshold)
    pieces = min(most + 1, permutations)
    cuts = [k * permutations // pieces for k in range(pieces + 1)]

    def hashed(parts: list[np.ndarray]) -> list[int]:
        return [int.from_bytes(hashlib.blake2b(p.tobytes(), digest_size=8, salt=k.to_bytes(4, "big")).digest(), "big", signed=True) for k, p in enumerate(parts)]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["rep"], pdf["text"]):
                s = signature(text, a, b)
                if s is not None:
                    whole = s[: rows * bands].reshape(bands, rows)[:joined]
                    out.append((key, hashed(list(whole)), hashed([s[p:q] for p, q in zip(cuts, cuts[1:])]), s.astype(np.uint32).tobytes(), sketch(s).tobytes()))
            yield pd.DataFrame(out, columns=["rep", "bands", "pieces", "sig", "sketch"])

    full = docs.where((F.length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "text", F.sha2("text", 256).alias("h"))
    reps = full.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("text").alias("text"))
    members = full.select("doc_id", "h").distinct().join(reps.select("h", "rep"), "h").select("doc_id", "rep")
    signed = cut_lineage(reps.select("rep", "text").mapInPandas(sign, "rep bigint, bands array<bigint>, pieces array<bigint>, sig binary, sketch binary"))
    sigs = signed.select("rep", "sig")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [np.mean(np.frombuffer(p, np.uint32) == np.frombuffer(q, np.uint32)) >= threshold for p, q in zip(pdf["p"], pdf["q"])]
            yield pdf.loc[keep, ["x", "y"]] if len(pdf) else pdf[["x", "y"]]

    def verified(pairs: DataFrame) -> DataFrame:
        checked = pairs.join(sigs.withColumnsRenamed({"rep": "x", "sig": "p"}), "x").join(sigs.withColumnsRenamed({"rep": "y", "sig": "q"}), "y")
        return cut_lineage(checked.mapInPandas(verify, "x bigint, y bigint"))

    each = signed.select("rep", F.posexplode("bands").alias("band", "hash"), F.col("bands"))
    order = each.select("rep", "band", "hash", F.element_at("bands", (F.col("band") + 1) % joined + 1).alias("next"))
    w = Window.partitionBy("band", "hash").orderBy("next", "rep")
    near = order.select("rep", F.lag("rep").over(w).alias("other"))
    hub = order.groupBy("band", "hash").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    spokes = order.join(hub, ["band", "hash"]).select("rep", F.col("hub").alias("other"))
    pairs = near.where(F.col("other").isNotNull()).unionByName(spokes.where("rep <> other"))
    links = verified(pairs.select(F.least("rep", "other").alias("x"), F.greatest("rep", "other").alias("y")).distinct())
    first = cut_lineage(connected(links))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in itertools.chain(batches, [None]):
            ready, rest = (rest, None) if pdf is None else (pdf if rest is None else pd.concat([rest, pdf], ignore_index=True), None)
            if ready is None or not len(ready):
                continue
            keys = ready[["key", "ti", "tj"]].to_numpy(np.int64)
            tile = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            if pdf is not None:  # the last tile may go on in the next batch
                rest = ready[tile == tile[-1]]
                ready, tile = ready[tile != tile[-1]], tile[tile != tile[-1]]
                if not len(ready):
                    continue
            sketches = np.frombuffer(b"".join(ready["sketch"]), np.uint64).reshape(len(ready), -1)
            ids, component = ready["rep"].to_numpy(np.int64), ready["component"].to_numpy(np.int64)
            for i, j in _likely(tile, sketches, component, most):
                yield pd.DataFrame({"x": np.minimum(ids[i], ids[j]), "y": np.maximum(ids[i], ids[j])})

    # the pieces' buckets are first looked at by class alone: most hold one text, and only the others take sketches along
    named = signed.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    buckets = named.select("component", F.explode("pieces").alias("key")).groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("count"))
    open_ = cut_lineage(buckets.where("low < high").select("key", "count"))
    placed = named.select("rep", "sketch", "component", F.explode("pieces").alias("key")).join(open_.select("key"), "key", "left_semi")
    hot = open_.where(F.col("count") > block_rows)
    tiles = placed.withColumns({"ti": F.lit(0), "tj": F.lit(0)})
    if hot.limit(1).count():
        blocks = F.ceil(F.col("count") / block_rows).cast("int")
        blocked = placed.join(hot, "key", "left").withColumn("blocks", F.coalesce(blocks, F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        tiles = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "rep", "sketch", "component", "key", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj")
        )
    met = tiles.repartition(4 * shuffle_width(docs.sparkSession), "key", "ti", "tj").sortWithinPartitions("key", "ti", "tj").mapInPandas(meet, "x bigint, y bigint")
    classes = connected(links.unionByName(verified(met.distinct())))
    return members.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))


def connected(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable over the links (x, y), by alternating large and small stars.

    Raises an error if ``rounds`` rounds don't settle the components.
    """
    edges = links.select(F.col("x").alias("u"), F.col("y").alias("v")).where("u <> v")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = cut_lineage(small)
        sums = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        edges = small
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n items the smallest one linked with it, by union and find."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(int(i)), find(int(j))
        root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def vector_classes(vectors: DataFrame, threshold: float = 0.92, block_rows: int = 4096) -> DataFrame:
    """(vec_id, class_id, links) of (vec_id, embedding): one row per usable vector.

    Vectors of a cosine of at least ``threshold`` are linked; ``links`` counts the different vectors
    linked with it, ``class_id`` is the smallest id reachable. Equal vectors count as one and share a
    class. Pairs of blocks are matrix products; a tile gives each vector's number of links and one
    spanning link per vector, never its pairs. Null, empty, zero and NaN vectors are left out.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    flat = usable.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    reps = flat.groupBy("dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.first("embedding").alias("v"))
    members = flat.select("vec_id", "dim", "h1", "h2").distinct().join(reps.select("dim", "h1", "h2", "rep"), ["dim", "h1", "h2"]).select("vec_id", "rep")
    n = reps.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    placed = reps.select("rep", "dim", "v").join(n, "dim").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_list()).astype(np.float64)
        return pd.DataFrame({"dim": [key[0]], "blocks": [key[1]], "block": [key[2]], "ids": [pdf["rep"].to_numpy(np.int64).tobytes()], "data": [(x / np.linalg.norm(x, axis=1)[:, None]).tobytes()]})

    packed = placed.groupBy("dim", "blocks", "block").applyInPandas(pack, "dim int, blocks int, block int, ids binary, data binary")
    tiles = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "dim", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "ids", "data"
    )

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, ti, tj = key
        side = {b: (np.frombuffer(i, np.int64), np.frombuffer(d).reshape(-1, dim)) for b, i, d in zip(pdf["block"], pdf["ids"], pdf["data"])}
        if ti not in side or tj not in side:
            return pd.DataFrame({"rep": [], "other": [], "links": []})
        (ia, a), (ib, b) = side[ti], side[tj]
        ids = ia if ti == tj else np.concatenate([ia, ib])
        counts, spanning = np.zeros(len(ids), np.int64), np.zeros((0, 2), np.int64)
        for at in range(0, len(a), 512):
            s = np.round(a[at : at + 512] @ b.T, 9) >= threshold
            i, j = np.nonzero(s)
            i = i + at
            if ti == tj:
                i, j = i[i != j], j[i != j]
                counts += np.bincount(i, minlength=len(ids))
            else:
                counts += np.bincount(i, minlength=len(ids)) + np.bincount(j + len(ia), minlength=len(ids))
                j = j + len(ia)
            root = _roots(len(ids), np.concatenate([spanning, np.stack([i, j], 1)]))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            spanning = np.stack([moved, root[moved]], 1)
        own = np.flatnonzero(counts)
        other = ids.copy()
        other[spanning[:, 0]] = ids[spanning[:, 1]]
        return pd.DataFrame({"rep": ids[own], "other": other[own], "links": counts[own]})

    found = cut_lineage(tiles.repartition(2 * shuffle_width(vectors.sparkSession), "dim", "ti", "tj").groupBy("dim", "ti", "tj").applyInPandas(link, "rep bigint, other bigint, links bigint"))
    classes = connected(found.select(F.col("rep").alias("x"), F.col("other").alias("y")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    return members.join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left").select(
        "vec_id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")
    )


def deduplicate(rows: DataFrame, strategy: str = "minhash", **options) -> DataFrame:
    """The classes of a strategy by its name: minhash and lsh (texts), embedding (vectors), exact (groups of equal texts)."""
    strategies = {"minhash": minhash_classes, "lsh": minhash_classes, "embedding": vector_classes, "exact": exact_groups}
    if strategy not in strategies:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(strategies)}")
    return strategies[strategy](rows, **options)
