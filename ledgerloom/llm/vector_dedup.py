"""Near-duplicate vectors: sign hashing in several tables, exact cosines, connected components.

Every table cuts a vector by `bits` random hyperplanes; vectors on the same side of all of
them share a bucket. Bits grow with the number of vectors, so that a bucket of unrelated
vectors stays small, and tables with them, so that a pair at the threshold shares none with a
probability of at most MISS. Vectors and planes are rounded to integers before they meet,
so a code never depends on the batch it is computed in.

1. Equal vectors form a class, told by two 64-bit hashes; one vector of each goes on.
2. Each table sends a narrow row per vector (bucket, id, the first 128 bits of all codes). In a
   bucket those bits tell who may have a neighbour there that no earlier table has shown.
   Buckets of very many rows are not screened: all of them go on.
3. Only such rows get their vectors. In each bucket (large ones in blocks, all of which meet) a
   fast product is followed by the cosine in double precision where the product leaves it
   open. A pair counts in the first table that it shares, so it is counted once; a task
   gives each vector's number of links and links enough to connect what is connected: pairs are never rows.
4. Components over the links of classes; copies get the result of their class.

Defined results: a row of the table gives a row. Vectors that are null, empty, zero or hold null
or non-finite components link with nothing, and so do rows without an id (their
component is null and they are kept). Vectors of different lengths are never linked. Rows
that repeat both id and vector count once as a neighbour. Different vectors of one id are
vectors of their own, but an id is one vertex of the components. Ties do not arise: a
cosine of exactly the threshold is a link. An empty table gives an empty result; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import cut, join_hot, kept, table
from ledgerloom.llm.graph import components

COSINE, MISS = 0.95, 1e-4
BUCKET = 256  # unrelated vectors that may share a bucket
BLOCK, SCREEN_ROWS, GROUP_BYTES = 4_096, 50_000, 16 << 20
HOT_BUCKETS = 1 << 18
SEED = 11


@dataclass(frozen=True)
class Hashing:
    cosine: float
    bits: int
    tables: int

    @staticmethod
    def of(n: int, cosine: float) -> Hashing:
        bits = min(31, max(8, math.ceil(math.log2(max(1, n) / BUCKET))))
        same = (1 - math.acos(cosine) / math.pi) ** bits
        return Hashing(cosine, bits, max(1, math.ceil(math.log(MISS) / math.log1p(-same))))

    @property
    def in_word(self) -> int:
        """Codes that fit one 64-bit word of the sketch."""
        return min(64 // self.bits, -(-self.tables // 2))

    @property
    def furthest(self) -> int:
        """So many different bits of a sketch no linked pair has, but one in ten million."""
        n, q = 2 * self.in_word * self.bits, math.acos(self.cosine) / math.pi
        return math.ceil(n * q + 5.5 * math.sqrt(n * q * (1 - q)))

    def planes(self, dim: int) -> np.ndarray:
        return np.rint(np.random.default_rng((SEED, dim)).standard_normal((dim, self.tables * self.bits)) * 256)

    def held(self, dim: int) -> np.ndarray:
        return kept(f"{self} {dim}", lambda: self.planes(dim))

    def codes(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """(rows, tables) codes. The products are sums of integers below 2^53: exact in any order."""
        whole = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * (1 << 20))
        sign = (whole @ planes > 0).reshape(len(x), self.tables, self.bits)
        return sign @ (1 << np.arange(self.bits, dtype=np.int64))

    def sketch(self, codes: np.ndarray) -> np.ndarray:
        """(rows, 2) words made of the first codes."""
        shift = np.arange(self.in_word, dtype=np.int64) * self.bits
        words = [(codes[:, at : at + self.in_word] << shift[: codes[:, at : at + self.in_word].shape[1]]).sum(axis=1) for at in (0, self.in_word)]
        return np.stack(words, axis=1)


def by_dim(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors in double precision) for each length."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
        yield at, np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact, and squares cannot overflow


def hashed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h1, h2) per row; the hashes are null for rows that link with nothing."""
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    v = F.col(f"`{vector_col}`").cast(f"array<{'float' if single else 'double'}>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0)
    return rows.select("id", "v", F.when(ok, F.xxhash64("v")).alias("h1"), F.when(ok, F.xxhash64(F.lit(1), "v")).alias("h2"))


def bucketed(points: DataFrame, how: Hashing) -> DataFrame:
    """(b, rep, s1, s2): a row per vector and table; b holds the length, the table and the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column(0).to_numpy()
            for at, x in by_dim(batch.column(1)):
                dim = x.shape[1]
                codes = how.codes(x, how.held(dim))
                words = how.sketch(codes)
                for t in range(how.tables):
                    yield pa.RecordBatch.from_arrays([pa.array((dim % (1 << 15) << 48) + (t << 32) + codes[:, t]), pa.array(rep[at]), pa.array(words[:, 0]), pa.array(words[:, 1])], names=["b", "rep", "s1", "s2"])

    return points.select("rep", "v").mapInArrow(run, "b long, rep long, s1 long, s2 long")


def _runs(b: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each value that occurs at least twice."""
    order = np.argsort(b, kind="stable")
    edges = np.flatnonzero(np.diff(b[order], prepend=b[order[:1]] - 1, append=b[order[-1:]] + 1))
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if end - start > 1:
            yield order[start:end]


def _screener(how: Hashing):
    field = np.uint64((1 << how.bits) - 1)

    def run(group: pa.Table) -> pa.Table:
        """Rows that may have a neighbour in their bucket which no earlier table shows, as far as the sketches tell."""
        b, rep = group.column("b").to_numpy(), group.column("rep").to_numpy()
        words = [group.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")]
        found = []
        for at in _runs(b):
            earlier = [(w, k * how.bits) for w in (0, 1) for k in range(how.in_word) if w * how.in_word + k < (int(b[at[0]]) >> 32) % (1 << 16)]
            step = max(1, (1 << 20) // len(at))
            hit = np.zeros(len(at), bool)
            for start in range(0, len(at), step):
                some = at[start : start + step]
                differ = [w[some][:, None] ^ w[at][None, :] for w in words]
                near = np.bitwise_count(differ[0]).astype(np.int16) + np.bitwise_count(differ[1]) <= how.furthest
                near[np.arange(len(some)), start + np.arange(len(some))] = False
                i, j = np.nonzero(near)
                new = np.ones(len(i), bool)
                for w, shift in earlier:
                    new &= (differ[w][i, j] >> np.uint64(shift)) & field != 0
                hit[start + i[new]] = True
            found.append(at[hit])
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        return pa.table({"b": pa.array(b[at]), "rep": pa.array(rep[at])})

    return run


class Found:
    """Links of the vectors of one task: counted for each vector, and spanning ones."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, size: np.ndarray, how: Hashing):
        self.x, self.size, self.how = x, size, how
        self.codes = np.ascontiguousarray(codes.T.astype(np.int32))  # a row per table
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.unit = (x / self.norm[:, None]).astype(np.float32)
        self.slack = 8 * x.shape[1] * np.finfo(np.float32).eps
        self.n = np.zeros(len(x), np.int64)
        self.label = np.arange(len(x))
        self.links: list[tuple[int, int]] = []

    def compare(self, one: np.ndarray, other: np.ndarray, t: int) -> None:
        """Adds the links in table t between places one and other; both the same, or without common places."""
        within = one is other
        every = one if within else np.concatenate([one, other])
        self.label[every] = every
        step = max(1, (1 << 19) // len(other))
        for start in range(0, len(one), step):
            some = one[start : start + step]
            rough = self.unit[some] @ self.unit[other].T
            near = rough >= self.how.cosine - self.slack
            if within:
                near[np.arange(len(some)), start + np.arange(len(some))] = False
            i, j = np.nonzero(near)
            a, b = some[i], other[j]
            true = self.codes[t][a] == self.codes[t][b]
            for earlier in self.codes[:t]:
                true &= earlier[a] != earlier[b]
            open_ = np.flatnonzero(true & (rough[i, j] < self.how.cosine + self.slack))
            true[open_] = (self.x[a[open_]] * self.x[b[open_]]).sum(axis=1) / (self.norm[a[open_]] * self.norm[b[open_]]) >= self.how.cosine
            i, a, b = i[true], a[true], b[true]
            np.add.at(self.n, a, self.size[b])
            if not within:
                np.add.at(self.n, b, self.size[a])
            edges = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i))
            for k, end in zip(edges[:-1], edges[1:], strict=True):
                self._join(int(a[k]), b[k:end], every)

    def _join(self, a: int, others: np.ndarray, every: np.ndarray) -> None:
        """Ties a to those of others that it is not tied to yet."""
        for p in others[self.label[others] != self.label[a]]:
            if self.label[p] != self.label[a]:
                self.links.append((a, int(p)))
                self.label[every[self.label[every] == self.label[p]]] = self.label[a]


def _comparer(how: Hashing):
    def run(group: pa.Table) -> pa.Table:
        """Links of one task: several whole buckets, or two blocks of a large one."""
        group = group.combine_chunks()
        b, rep, dig, size, blk = (group.column(c).to_numpy() for c in ("b", "rep", "dig", "size", "blk"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for places, x in by_dim(group.column("v").chunk(0)):
            found = Found(x, how.codes(x, how.held(x.shape[1])), size[places], how)
            for at in _runs(b[places]):
                one, other = at[blk[places][at] == i], at[blk[places][at] == j]
                if len(one) and len(other):
                    found.compare(one, one if i == j else other, (int(b[places][at[0]]) >> 32) % (1 << 16))
            counted = np.flatnonzero(found.n)
            ends = np.array(found.links, np.int64).reshape(-1, 2)
            who = places[np.concatenate([counted, ends[:, 0]])]
            out.append((rep[who], dig[who], np.concatenate([found.n[counted], np.zeros(len(ends), np.int64)]), np.concatenate([np.full(len(counted), -1), places[ends[:, 1]]])))
        who, digs, n, other = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"rep": pa.array(who, pa.int64()), "dig": pa.array(digs, pa.int64()), "n": pa.array(n, pa.int64()), "other": pa.array(np.where(other < 0, 0, rep[other]), pa.int64(), mask=other < 0)})

    return run


def linked(points: DataFrame, how: Hashing, n: int, mean_bytes: int) -> DataFrame:
    """(rep, dig, n, other): partial counts of links (other null) and spanning links (n = 0)."""
    rows = bucketed(points, how)
    limit = max(BLOCK, n * how.tables // HOT_BUCKETS)
    large = rows.groupBy("b").agg(F.count("*").alias("rows")).where(F.col("rows") > limit)  # fewer than HOT_BUCKETS
    told = rows.join(F.broadcast(cut(large)), "b", "left")
    groups = max(1, n * how.tables // SCREEN_ROWS)
    small = told.where("rows is null").groupBy(F.pmod(F.xxhash64("b"), F.lit(groups))).applyInArrow(_screener(how), "b long, rep long")
    screened = cut(small)
    tasks = max(1, screened.count() * mean_bytes // GROUP_BYTES)
    zero = F.lit(0)
    whole = screened.select(F.lit(True).alias("whole"), F.pmod(F.xxhash64("b"), F.lit(tasks)).alias("task"), zero.alias("i"), zero.alias("j"), zero.alias("blk"), "b", "rep")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    blocked = told.where("rows is not null").select("b", "rep", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("blk"), F.explode(F.sequence(zero, blocks - 1)).alias("o"))
    blocked = blocked.select(F.lit(False).alias("whole"), F.col("b").alias("task"), F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "b", "rep")
    sent = whole.unionByName(blocked).join(points.select("rep", "dig", "size", "v"), "rep")
    return sent.groupBy("whole", "task", "i", "j").applyInArrow(_comparer(how), "rep long, dig long, n long, other long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors."""
    rows = hashed(vectors, id_col, vector_col)
    good = rows.where("h1 is not null")
    members = good.groupBy("id", "h1", "h2").agg(F.count("*").alias("rows"))
    classes = cut(members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.sum("rows").alias("rows")))
    one_each = good.groupBy("id", "h1", "h2").agg(F.first("v").alias("v")).withColumnRenamed("id", "rep")
    points = cut(one_each.join(classes, ["rep", "h1", "h2"]).select("rep", F.col("h1").alias("dig"), "size", "v"))
    n, width = points.agg(F.count("*"), F.coalesce(F.avg(F.size("v")), F.lit(0))).first()
    how = Hashing.of(n, cosine)
    found = cut(linked(points, how, n, int(8 * width) + 64))
    counts = found.where("other is null").groupBy("rep", F.col("dig").alias("h1")).agg(F.sum("n").alias("n"))
    comps = components(found.where("other is not null").select("rep", "other"), "rep", "other")
    told = classes.join(counts, ["rep", "h1"], "left").join(comps, F.col("rep") == F.col("id"), "left")
    told = told.select(F.struct("h1", "h2").alias("h"), "rows", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    mine = good.select("id", F.struct("h1", "h2").alias("h"))
    out = join_hot(mine, told, "h", "rows").select("id", "n_links", "component_id")
    alone = rows.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    is_kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", is_kept.alias("kept"))


def op12_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
