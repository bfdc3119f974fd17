"""Near-duplicate groups by SetSketch registers over word shingles.

Registers hold exponentially spaced, truncated minima: register j is
clip(floor(1 - log_b(min h_j)), 0, q + 1) over exponentially distributed hashes h_j of the
set's elements, so sketches of two sets merge by maximum. With b near 1 two registers are
equal with a probability close to the Jaccard similarity J, so bands of register values
bring similar sets together; a pair's J is then estimated from the registers and both
cardinalities by maximum likelihood, and what may reach the threshold is confirmed on the
full shingle sets.

Documents with equal sets form one class, represented by its least doc_id; only
representatives are sketched into bands. Documents that collide in a band, directly or over
others, form a cluster; within a cluster what the likelihood does not rule out is confirmed, in blocks of
bounded size, and only links that connect something new are returned. In large clusters
most members connect through a few hubs, and only the rest is compared with all.

Defined results: null or wordless text: empty set, linked with nothing, kept. Null doc_id:
linked with nothing, kept, component null. Rows that share a doc_id are one document. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, n_shuffle, table
from ledgerloom.llm.graph import components

WORDS = 5
BANDS, ROWS = 32, 6
M = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
NUM, DEN = 85, 100
SLACK = 0.15  # six standard errors of the estimate at the threshold
KNOWN_WORDS = 400_000
BLOCK, HUBS = 400_000, 128  # shingles compared within one task; members that a large cluster is first compared with
_rng = np.random.default_rng(20240229)
_ODD = [int(x) | 1 for x in _rng.integers(0, 2**63, WORDS + 1, dtype=np.uint64)]
_A = _rng.integers(0, 2**32, M, dtype=np.uint32) | np.uint32(1)
_BAND_MUL = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_ADD = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self):
        import xxhash

        self.hash, self.known = xxhash.xxh3_64_intdigest, {}

    def words(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()  # lower-cases A-Z, splits at \x20\x09-\x0D
        fresh = set(words).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > KNOWN_WORDS:
                self.known.clear()
                fresh = set(words)
            self.known.update((w, self.hash(w)) for w in fresh)
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        w = self.words(text)
        n = len(w)
        if not n:
            return w
        k = min(WORDS, n)
        h = np.full(n - k + 1, np.uint64(k))
        for i in range(k):
            h += mix(w[i : n - k + 1 + i] * np.uint64(_ODD[i]) + np.uint64(_ODD[WORDS]))
            h *= np.uint64(_ODD[i])
        return np.unique(mix(h))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(M, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 1024):
        block = _A[:, None] * low[None, at : at + 1024]
        block += high[None, at : at + 1024]
        np.minimum(least, block.min(axis=1), out=least)
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    return mix((sketch.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_MUL).sum(axis=1, dtype=np.uint64) ^ _BAND_ADD).view(np.int64)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows) with known cardinalities."""
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def log_likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(a, 1e-300)) + less * np.log(np.maximum(b, 1e-300)) + same * np.log(np.maximum(1 - a - b, 1e-300))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (math.sqrt(5) - 1) / 2
    for _ in range(40):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = log_likelihood(x) > log_likelihood(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) per row; digest and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler()
        for batch in batches:
            n, digest, bands = [], [], []
            for text in batch.column(1):
                s = shingle(text.as_py())
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(registers(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def may_reach(ra: np.ndarray, rb: np.ndarray, na, nb, j: float) -> np.ndarray:
    """Whether the maximum-likelihood similarity is at least j: the likelihood is concave, so its slope at j tells."""
    more, less = (ra > rb).sum(axis=-1), (ra < rb).sum(axis=-1)
    same = ra.shape[-1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    step = 1e-6
    x, y = np.minimum(j, np.minimum(u / v, v / u)), None
    y = x - step
    c = (BASE - 1) / BASE

    def log_likelihood(t):
        a, b = (-np.log1p(-np.clip(z, 1e-12, 1) * c) / math.log(BASE) for z in (u - v * t, v - u * t))
        return more * np.log(np.maximum(a, 1e-300)) + less * np.log(np.maximum(b, 1e-300)) + same * np.log(np.maximum(1 - a - b, 1e-300))

    return log_likelihood(x) >= log_likelihood(y) - 1e-9


class Sets:
    """Sketches and shingle sets of some documents, indexed by shingle."""

    def __init__(self, ids, n, regs, shingles, group=None):
        self.ids, self.n = np.asarray(ids, np.int64), np.asarray(n, np.float64)
        self.regs = np.frombuffer(b"".join(regs), np.uint16).reshape(len(self.ids), M)
        self.sets = [np.frombuffer(x, np.uint64) for x in shingles]
        self.group = self.ids if group is None else np.asarray(group, np.int64)
        self._sorted = None

    def common(self, of: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a set with those of the given rows."""
        if len(among) <= 16:
            out = []
            for k in among:
                x, y = sorted((of, self.sets[k]), key=len)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                out.append(int((y[at] == x).sum()))
            return np.array(out, np.int64)
        if self._sorted is None:
            every = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets), dtype=np.int32), [len(x) for x in self.sets])
            order = np.argsort(every, kind="stable")
            self._sorted = every[order], owner[order]
        every, owner = self._sorted
        lo, hi = np.searchsorted(every, of, "left"), np.searchsorted(every, of, "right")
        size = hi - lo
        at = np.repeat(hi - size.cumsum(), size) + np.arange(size.sum())
        return np.bincount(owner[at], minlength=len(self.sets))[among]


def spanning_links(asked: Sets, others: Sets) -> list[tuple[int, int]]:
    """Links between documents of different groups, without those that earlier ones make redundant."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    roots = np.array([root(int(g)) for g in others.group], np.int64)
    for k in range(len(asked.ids)):
        mine = root(int(asked.group[k]))
        lo, hi = np.minimum(asked.n[k], others.n), np.maximum(asked.n[k], others.n)
        at = np.flatnonzero((roots != mine) & (DEN * lo >= NUM * hi))
        if len(at):
            at = at[may_reach(asked.regs[k], others.regs[at], asked.n[k], others.n[at], NUM / DEN - SLACK)]
        if not len(at):
            continue
        both = others.common(asked.sets[k], at)
        for i in at[DEN * both >= NUM * (asked.n[k] + others.n[at] - both)]:
            a, b = root(mine), root(int(roots[i]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(asked.ids[k]), int(others.ids[i])))
                roots[(roots == a) | (roots == b)] = min(a, b)
                mine = min(a, b)
    return out


def _pairs(rows: list[tuple[int, int]], names: tuple[str, str]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def _within(group: pa.Table) -> pa.Table:
    """Links inside each cluster of a group of small clusters."""
    cluster = group.column("cluster").to_numpy()
    columns = [group.column(c).to_pylist() for c in ("id", "n", "regs", "shingles")]
    links: list[tuple[int, int]] = []
    order = np.argsort(cluster, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        one = Sets(*([c[i] for i in rows] for c in columns))
        links += spanning_links(one, one)
    return _pairs(links, ("a", "b"))


def _across(group: pa.Table) -> pa.Table:
    """Links between the asked rows and the others of one part of a large cluster."""
    ask = group.column("ask").to_numpy(zero_copy_only=False)
    columns = [group.column(c).to_pylist() for c in ("id", "n", "regs", "shingles", "grp")]
    sides = [Sets(*([c[i] for i in np.flatnonzero(m)] for c in columns)) if m.any() else None for m in (ask, ~ask)]
    return _pairs(spanning_links(*sides) if all(sides) else [], ("a", "b"))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, n, regs, shingles of the documents whose doc_id is in wanted (doc_id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted.hint("merge"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            ids, n, regs, sets = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle(text.as_py())
                if len(s):
                    ids.append(key)
                    n.append(len(s))
                    regs.append(registers(s).tobytes())
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(regs, pa.binary()), pa.array(sets, pa.binary())], names=["id", "n", "regs", "shingles"])

    return rows.select("doc_id", "text").mapInArrow(run, "id long, n long, regs binary, shingles binary")


def _blocked(sets: DataFrame, asked: DataFrame, others: DataFrame) -> DataFrame:
    """Links of asked rows with others of their cluster: both are (id, cluster, grp, weight).

    Either side is dealt into blocks of at most about BLOCK shingles, and every asked block
    meets every block of the others.
    """
    weight = lambda df, name: df.groupBy("cluster").agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias(name))
    parts = weight(asked, "asks").join(weight(others, "blocks"), "cluster")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = (
        asked.join(parts, "cluster").select("id", "cluster", "grp", mine("asks").alias("x"), every("blocks").alias("y"), F.lit(True).alias("ask"))
        .unionByName(others.join(parts, "cluster").select("id", "cluster", "grp", every("asks").alias("x"), mine("blocks").alias("y"), F.lit(False).alias("ask")))
    )
    return sets.join(sent, "id").groupBy("cluster", "x", "y").applyInArrow(_across, "a long, b long")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Enough links (a, b) to connect what is connected; reps are (rep, n_shingles, bands).

    Documents that collide in a band, directly or over others, form a cluster. A cluster of up
    to BLOCK shingles is compared within one task. In a larger one HUBS members are compared with
    all first; then only what is not yet connected with the largest part is compared with all.
    """
    spark = docs.sparkSession
    members = reps.select("rep", F.explode(F.array_distinct("bands")).alias("key"))
    hubs = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("hub"))).alias("s"), F.count("*").alias("size")).where("size > 1")
    stars = cut(members.join(hubs.select("key", "s.hub"), "key").where("rep != hub").select("rep", "hub").distinct())
    weighed = reps.groupBy("rep").agg((F.max("n_shingles") + 100).alias("weight"))
    grouped = cut(components(stars, "rep", "hub").join(weighed, F.col("id") == F.col("rep")).select("id", F.col("component").alias("cluster"), "weight"))
    sets = cut(_sets_of(docs, grouped.select(F.col("id").alias("doc_id"))))
    sizes = cut(grouped.groupBy("cluster").agg(F.sum("weight").alias("all")))
    groups = int(max(1, (sizes.where(F.col("all") <= BLOCK).agg(F.sum("all")).first()[0] or 0) // (BLOCK // 2)))
    told = grouped.join(sizes.where(F.col("all") <= BLOCK).select("cluster"), "cluster").select("id", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(groups)).alias("g"))
    out = cut(sets.join(told, "id").groupBy("g").applyInArrow(_within, "a long, b long"))
    large = cut(grouped.join(sizes.where(F.col("all") > BLOCK).select("cluster"), "cluster").select("id", "cluster", "weight", F.col("id").alias("grp")))
    if not large.take(1):
        return out
    salt = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_shuffle(spark)))
    first = large.withColumn("h", F.xxhash64("id")).withColumn("s", salt).withColumn("k", F.row_number().over(Window.partitionBy("cluster", "s").orderBy("h", "id"))).where(F.col("k") <= HUBS)
    chosen = first.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("h", "id"))).where(F.col("k") <= HUBS).select(*large.columns)
    near = cut(_blocked(sets, chosen, large))
    comps = components(near, "a", "b").withColumnRenamed("id", "_id")
    now = cut(large.drop("grp").join(comps, F.col("id") == F.col("_id"), "left").select("id", "cluster", "weight", F.coalesce("component", "id").alias("grp")))
    largest = now.groupBy("cluster", "grp").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "grp")).alias("m")).select("cluster", F.col("m.grp").alias("grp"))
    left = cut(now.join(largest, ["cluster", "grp"], "left_anti").select(*now.columns))
    rest = cut(_blocked(sets, left, now)) if left.take(1) else near.limit(0)
    return out.unionByName(near).unionByName(rest)


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs."""
    rows = cut(sketches(docs))
    classes = cut(rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = cut(rows.join(classes, "digest").where("doc_id = rep").select("rep", "n_shingles", "bands"))
    comps = components(links(docs, reps), "a", "b")
    where = classes.join(comps, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "digest").join(where, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


SQL_OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 85 * (len(x.s) + len(y.s) - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, v.b FROM r JOIN both_ways v ON v.a = r.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""
