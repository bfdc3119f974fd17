"""Nearest neighbours by largest inner product with a hash-prefix forest.

Each of TREES trees gives a vector a string of BITS sign bits of random projections; a tree
is the sorted array of those strings. A query descends to its longest matching prefix in
every tree, wherever that is; from there all trees ascend together, one bit at a time,
until the vectors that share the query's prefix, added up over the trees, are at least M.
At the root every vector is a candidate. Candidates are scored exactly. For inner
products vectors are lifted by one coordinate so that all have the same norm.

The ascent counts first: strings and queries, without their vectors, meet in shards (cells
of a fixed prefix length), where a binary search in the sorted strings tells how many share
each longer prefix; shorter prefixes are sums of shards. So every query has its own level.
Vectors are then sent to the cells that queries of such levels need, and each query scores
its slice of the sorted array there. Shards and cells larger than BLOCK are split, with the
queries sent to each part.

M is the least number with which a sample of at most CALIBRATION queries, answered by brute
force in blocks, reaches RECALL. Equal vectors form one class (only the K+1 least ids can
ever be answers), so copies cost nothing.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part; neither do null ids. Vectors of different lengths have no inner product: each length
is searched by itself. Rows that share id and vector count once. Ties go to the smaller
id. Fewer candidates than K give fewer ranks. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import cut, n_shuffle, table

K, EVERY = 20, 20
TREES, BITS = 8, 32
RECALL, CALIBRATION = 0.95, 96
BLOCK, QUERY_BLOCK = 8_192, 4_096
STRINGS = 16  # so many times BLOCK strings, which come without vectors, fill a shard
DEEP = 0.9  # share of the queries that the deepest cells serve
SEED = 7
LEVELS = [f"n{x}" for x in range(BITS + 1)]
KEYS = ["dim", "tree", "base", "cell"]


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, TREES * BITS)).astype(np.float32)


def _unpack(column, dim: int) -> np.ndarray:
    """Packed vectors of one length as rows; of float32, or of float64 where the table holds doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64 if rows and len(rows[0]) == 8 * dim else np.float32).reshape(len(rows), dim)


def codes(x: np.ndarray, lift: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, TREES) hash strings as integers of BITS bits; they do not depend on a vector's scale."""
    both = np.concatenate([x, lift[:, None]], axis=1).astype(np.float64)
    sign = (both / np.abs(both).max(axis=1, keepdims=True)).astype(np.float32) @ planes > 0
    packed = np.packbits(sign.reshape(len(x), TREES, BITS), axis=2)
    return packed.view(">u4")[:, :, 0].astype(np.int64)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of x with q in double precision, the same for equal rows."""
    return (x.astype(np.float64) * q.astype(np.float64)).sum(axis=1)


def best(ids: np.ndarray, x: np.ndarray, qs: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of qs its k nearest rows of x: a fast product first, then exact scores of what it leaves open."""
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)
    for at in range(0, len(qs), 256):
        part = qs[at : at + 256]
        rough = x @ part.T if len(ids) > 4 * k else None
        for j, q in enumerate(part):
            chosen = np.arange(len(ids))
            if rough is not None and np.isfinite(rough[:, j]).all():
                r = rough[:, j]
                slack = 4 * len(q) * np.finfo(x.dtype).eps * size * np.sqrt((q.astype(np.float64) ** 2).sum())
                chosen = np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k] - slack)
            s = inner(x[chosen], q)
            order = np.lexsort((ids[chosen], -s))[:k]
            yield ids[chosen][order], s[order]


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v, norm2): the vectors that take part, as packed float32, or float64 if the column is not of floats."""
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind, name = (np.float32, "float") if single else (np.float64, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == dim))
                x = lists.take(at).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), dim) + kind(0)
                with np.errstate(all="ignore"):
                    norm2 = (x.astype(np.float64) ** 2).sum(axis=1)
                ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                x = np.ascontiguousarray(x[ok])
                yield pa.RecordBatch.from_arrays([ids.take(at).filter(pa.array(ok)), pa.array(np.full(len(x), dim), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(norm2[ok])], names=["id", "dim", "v", "norm2"])

    v = F.col(vector_col).cast(f"array<{name}>")
    whole = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull()))
    return whole.select(F.col(id_col).cast("long"), v).mapInArrow(run, "id long, dim int, v binary, norm2 double")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(rep, dim, v, norm2, ids): one row per distinct vector with its k + 1 least ids."""
    salted = rows.dropDuplicates(["id", "dim", "v"]).withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(n_shuffle(rows.sparkSession))))
    least = salted.withColumn("_r", F.row_number().over(Window.partitionBy("dim", "v", "_s").orderBy("id"))).where(F.col("_r") <= k + 1)
    ids = F.slice(F.sort_array(F.collect_list("id")), 1, k + 1)
    return least.groupBy("dim", "v").agg(ids.alias("ids"), F.first("norm2").alias("norm2")).select(F.col("ids")[0].alias("rep"), "dim", "v", "norm2", "ids")


def brute_force(points: DataFrame, queries: list[tuple[int, int, bytes]], k: int) -> DataFrame:
    """(query, rep, score): the k nearest points of a bounded list of queries (id, dim, vector); each task keeps its own k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                asked = [(q, v) for q, d, v in queries if d == dim]
                if not asked:
                    continue
                at = pa.array(np.flatnonzero(dims == dim))
                ids, x = batch.column(0).take(at).to_numpy(), _unpack(batch.column(2).take(at), dim)
                for (q, _), (near, s) in zip(asked, best(ids, x, _unpack(pa.array([v for _, v in asked]), dim), k), strict=True):
                    old = held.get(q, (near[:0], s[:0]))
                    near, s = np.concatenate([old[0], near]), np.concatenate([old[1], s])
                    order = np.lexsort((near, -s))[:k]
                    held[q] = near[order], s[order]
        out = [(q, int(i), float(x)) for q, (near, s) in held.items() for i, x in zip(near, s, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["query", "rep", "score"])

    near = points.select("rep", "dim", "v").mapInArrow(run, "query long, rep long, score double")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("_r") <= k).drop("_r")


def coded(points: DataFrame, top: dict[int, float], is_query: bool) -> DataFrame:
    """(rep, dim, codes, v): a string per tree; top is the largest squared norm of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                x, norm2 = _unpack(batch.column(2).take(at), dim), batch.column(3).take(at).to_numpy()
                if dim not in planes:
                    planes[dim] = _planes(dim)
                lift = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(0, top[int(dim)] - norm2))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(list(codes(x, lift, planes[dim])), pa.list_(pa.int64())), batch.column(2).take(at)], names=["rep", "dim", "codes", "v"])

    return points.select("rep", "dim", "v", "norm2").mapInArrow(run, "rep long, dim int, codes array<long>, v binary")


def prefix(code: Column, level) -> Column:
    return F.call_function("shiftright", code, F.lit(BITS) - level)


def meet(points: DataFrame, asks: DataFrame, block: int) -> DataFrame:
    """Points and asks (ask true) of a cell (KEYS) side by side; large cells in several parts (block, qblock), whose points and asks all meet."""
    sizes = points.groupBy(*KEYS).agg(F.count("*").alias("size"))
    parts = sizes.join(asks.groupBy(*KEYS).agg(F.count("*").alias("asks")), KEYS).select(*KEYS, F.ceil(F.col("size") / block).cast("int").alias("blocks"), F.ceil(F.col("asks") / QUERY_BLOCK).cast("int").alias("qblocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    one = points.join(parts, KEYS).select(*points.columns, mine("blocks").alias("block"), every("qblocks").alias("qblock"), F.lit(False).alias("ask"))
    other = asks.join(parts, KEYS).select(*points.columns, every("blocks").alias("block"), mine("qblocks").alias("qblock"), F.lit(True).alias("ask"))
    return one.unionByName(other)


def _counter(depth: int):
    def run(group: pa.Table) -> pa.Table:
        """How many strings of a shard share each prefix, at least as long as the shard's, with each query."""
        ask = group.column("ask").to_numpy()
        rep, code = group.column("rep").to_numpy(), group.column("code").to_numpy()
        strings, mine = np.sort(code[~ask]), code[ask]
        out = {"rep": pa.array(rep[ask], pa.int64())}
        for level, name in enumerate(LEVELS):
            low = mine >> (BITS - level) << (BITS - level)
            n = np.searchsorted(strings, low + (1 << (BITS - level))) - np.searchsorted(strings, low) if level >= depth else np.zeros(len(mine))
            out[name] = pa.array(n.astype(np.int64))
        return pa.table(out)

    return run


def totals(index: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """(rep, n0 .. nBITS): for each query and prefix length how many vectors share that prefix, added up over the trees."""
    strings = lambda df: df.select("rep", "dim", F.posexplode("codes").alias("tree", "code")).withColumn("base", F.lit(depth)).withColumn("cell", prefix(F.col("code"), F.lit(depth)))
    points, asks = strings(index), strings(queries)
    schema = "rep long, " + ", ".join(f"{n} long" for n in LEVELS)
    deep = meet(points, asks, STRINGS * BLOCK).groupBy(*KEYS, "block", "qblock").applyInArrow(_counter(depth), schema)
    if depth:
        up = F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))
        short = lambda df: df.withColumn("level", up).withColumn("cell", F.call_function("shiftright", "cell", F.lit(depth) - F.col("level")))
        sizes = short(points.groupBy(*KEYS).agg(F.count("*").alias("size"))).groupBy("dim", "tree", "level", "cell").agg(F.sum("size").alias("size"))
        met = short(asks).join(sizes, ["dim", "tree", "level", "cell"])
        deep = deep.unionByName(met.groupBy("rep").agg(*(F.sum(F.when(F.col("level") == x, F.col("size")).otherwise(0)).alias(n) for x, n in enumerate(LEVELS))))
    return deep.groupBy("rep").agg(*(F.sum(n).alias(n) for n in LEVELS))


def level_for(least: int) -> Column:
    """Where a query's ascent ends: at its longest prefix that at least `least` vectors share, over all trees; else at the root."""
    return F.coalesce(*(F.when(F.col(f"n{x}") >= least, x) for x in range(BITS, 0, -1)), F.lit(0))


def calibrated(points: DataFrame, index: DataFrame, queries: DataFrame, counts: DataFrame, k: int) -> int:
    """The least number of candidates with which the calibration queries find RECALL of their true neighbours."""
    chosen = queries.orderBy(F.xxhash64("rep"), "rep").limit(CALIBRATION).collect()
    if not chosen:
        return 1
    near = brute_force(points, [(r["rep"], r["dim"], bytes(r["v"])) for r in chosen], k)
    pairs = index.select("rep", "codes").join(F.broadcast(near), "rep").select("query", "codes").collect()  # at most CALIBRATION * k rows
    own = {r["rep"]: np.array(r["codes"]) for r in chosen}
    shared = np.array([(BITS - np.ceil(np.log2((own[r["query"]] ^ np.array(r["codes"])) + 1.0))).max() for r in pairs])
    sums = {r["rep"]: np.array([r[n] for n in LEVELS]) for r in counts.join(F.broadcast(counts.sparkSession.createDataFrame([(q,) for q in own], "rep long")), "rep").collect()}
    asked = np.array([sums[r["query"]] for r in pairs])
    tried = np.unique(asked)
    low, high = 0, len(tried) - 1
    while low < high:  # recall grows with the number of candidates
        middle = (low + high) // 2
        enough = (shared >= (asked >= tried[middle]).sum(axis=1) - 1).mean() >= RECALL
        low, high = (low, middle) if enough else (middle + 1, high)
    return int(tried[low])


def _search(k: int):
    def run(group: pa.Table) -> pa.Table:
        """Queries and points of one part of a cell: the k nearest of each query's slice of the sorted strings."""
        ask = group.column("ask").to_numpy()
        rep, code, level = (group.column(c).to_numpy() for c in ("rep", "code", "level"))
        x = _unpack(group.column("v"), group.column("dim")[0].as_py())
        p = np.flatnonzero(~ask)
        p = p[np.argsort(code[p], kind="stable")]
        strings, ids, points = code[p], rep[p], x[p]
        asked = np.flatnonzero(ask)
        free = BITS - level[asked].astype(np.int64)
        low = code[asked] >> free << free
        a, b = np.searchsorted(strings, low), np.searchsorted(strings, low + (1 << free))
        query, found, score = [], [], []
        slices, same = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
        for j, (start, end) in enumerate(slices):
            mine = asked[same.reshape(-1) == j]
            if end > start:
                for q, (near, s) in zip(mine, best(ids[start:end], points[start:end], x[mine], k), strict=True):
                    query.append(np.full(len(near), rep[q]))
                    found.append(near)
                    score.append(s)
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
        return pa.table({"query": flat(query, pa.int64()), "rep": flat(found, pa.int64()), "score": flat(score, pa.float64())})

    return run


def bases_of(histogram: dict[int, int]) -> list[int]:
    """Prefix lengths of the cells that vectors are sent to: one that serves DEEP of the queries, and halves of it for the rest."""
    below = {x: n for x, n in histogram.items() if x > 0}
    out = [next((x for x in sorted(below, reverse=True) if sum(n for y, n in below.items() if y >= x) >= DEEP * sum(below.values())), 0)]
    while out[-1] > min(histogram, default=0):
        out.append(out[-1] // 2)
    return out


def search_classes(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, rep, score): the k nearest classes found for each asked class (itself among them)."""
    top = {r["dim"]: r["top"] for r in points.groupBy("dim").agg(F.max("norm2").alias("top")).collect()}  # a row per length
    depth = int(np.clip(np.log2(max(1, points.count() / (STRINGS * BLOCK))), 0, BITS))
    index, queries = coded(points, top, False), coded(asked, top, True)
    counts = cut(totals(index, queries, depth))
    least = calibrated(points, index, queries, counts, k)
    levels = cut(counts.select("rep", level_for(least).alias("level")))
    bases = bases_of({r["level"]: r["count"] for r in levels.groupBy("level").count().collect()})
    base = F.coalesce(*(F.when(F.col("level") >= b, b) for b in bases), F.lit(0))
    strings = lambda df, *more: df.select("rep", "dim", "v", *more, F.posexplode("codes").alias("tree", "code"))
    here = F.col("base") > 0  # below the root every tree counts; at the root one tree has all
    cells = strings(index).withColumn("base", F.explode(F.array(*map(F.lit, bases)))).where(here | (F.col("tree") == 0)).withColumn("cell", prefix(F.col("code"), F.col("base"))).withColumn("level", F.lit(0))
    asks = strings(queries.join(levels, "rep"), "level").withColumn("base", base).where((F.col("level") > 0) | (F.col("tree") == 0)).withColumn("cell", prefix(F.col("code"), F.col("base")))
    near = meet(cells, asks.select(*cells.columns), BLOCK).groupBy(*KEYS, "block", "qblock").applyInArrow(_search(k), "query long, rep long, score double").distinct()
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("_r") <= k).drop("_r")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`."""
    rows = packed(vectors, id_col, vector_col)
    points = cut(classes(rows, k))
    asking = cut(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "dim", "v").distinct().join(points.select("dim", "v", "rep"), ["dim", "v"]).select("query_id", F.col("rep").alias("query")))
    asked = cut(points.join(asking.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").select("rep", "dim", "v", "norm2"))
    found = search_classes(points.select("rep", "dim", "v", "norm2"), asked, k + 1)
    answers = found.join(points.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    answers = answers.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1).drop("_r")
    lists = answers.groupBy("query").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))  # k + 1 at most
    own = asking.join(lists, "query").select("query_id", F.explode("near").alias("a")).select("query_id", "a.score", "a.vec_id").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op5_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
