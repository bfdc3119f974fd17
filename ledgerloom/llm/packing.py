"""Best-fit packing of token pieces into fixed-size training sequences.

A sequence (bin) has three capacities: tokens, documents and attention cost (the
sum of squared piece lengths). Pieces go in decreasing length order to the open
bin, among those that satisfy every capacity, whose weighted residual norm after
placement is smallest (or whose weighted dot product with the piece's demand is
largest). Pieces of one length are interchangeable, so the choice is made on the
histogram of lengths: at most `capacity` rows, whatever the corpus size. The
resulting plan maps ranks within a length to (sequence, offset); a join
with it and a salted rank place every piece without collecting any of them.

Defined results: null text counts as empty (one piece holding id 0); a null
doc_id is carried as is; repeated rows are separate documents; an empty table
gives an empty result; columns other than doc_id and text are ignored. Of equally good
bins the one opened first is taken; a plan too large to broadcast is an error.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import combining

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, kept, n_shuffle, table

CAPACITY = 2048
CACHED_CHUNKS = 1_000_000
MOST_PLAN_ROWS = 4_000_000  # the plan grows with the square of the capacity at most, not with the corpus
LONGEST_CACHED = 64
WHOLE = "whole"  # stands for the ids of a chunk that needs its text
# Fixed value: the pattern of a pre-tokeniser that keeps runs of letters, single digits and runs of signs, and drops white space.
WORDS_ONLY = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunk_wise(spec: dict) -> tuple[bool, list[bytes]]:
    """(whether a tokenizer's ids are those of lower-cased chunks between white space, the lower-cased starts of its added tokens)."""
    parts = lambda x, many: [] if not x else x[many] if x["type"] == "Sequence" else [x]
    normal, pre = parts(spec.get("normalizer"), "normalizers"), parts(spec.get("pre_tokenizer"), "pretokenizers")
    plain = [n for n in normal if not (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ")]
    lower = sorted(n["type"] for n in plain) in (["Lowercase"], ["Lowercase", "NFC"])
    splits = bool(pre) and (pre[0]["type"] in ("Whitespace", "WhitespaceSplit") or pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and pre[0]["pattern"] == {"Regex": WORDS_ONLY})
    quiet = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
    return lower and splits and quiet, sorted({t["content"][:2].lower().encode() for t in spec.get("added_tokens", [])})


class Encoder:
    """Token ids of a text as little-endian uint32 bytes.

    Where the tokenizer lower-cases and its pre-tokeniser drops white space, so that no token crosses it,
    a text's ids are those of its lower-cased white-space-separated chunks. Chunks repeat, hence the
    bounded cache. Texts with combining marks, which compose with some capitals only or some small
    letters only, or that may spell an added token, go to the tokenizer whole, and so do all texts of any other
    tokenizer.
    """

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.known: dict[bytes, bytes] = {}
        self.by_chunks, self.added = chunk_wise(json.loads(self.tokenizer.to_str()))

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes | str]:
        """Ids of chunks; WHOLE for one whose ids may depend on its capitals."""
        texts = [c.decode("utf-8") for c in chunks]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return {c: array("I", e.ids).tobytes() if t.isascii() or not any(map(combining, t)) else WHOLE for c, t, e in zip(chunks, texts, encoded, strict=True)}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        low = text.encode("utf-8", "replace").lower()
        if not self.by_chunks or any(a in low for a in self.added):
            return self.whole(text)
        chunks, known = low.split(), self.known
        parts = list(map(known.get, chunks))
        if None in parts:
            fresh = {c for c, ids in zip(chunks, parts, strict=True) if ids is None}
            if len(known) + len(fresh) > CACHED_CHUNKS:
                known.clear()
                fresh = set(chunks)
            known.update(self._learn(list(fresh)))
            parts = list(map(known.get, chunks))
            for c in fresh:
                if len(c) > LONGEST_CACHED:
                    del known[c]
        return self.whole(text) if WHOLE in parts else b"".join(parts)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: a document's ids followed by end_id, cut every `capacity` ids."""
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"encoder {path}", lambda: Encoder(path))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    doc.append(key)
                    piece.append(k)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + capacity)]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan_bins(
    histogram: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm",
) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best fit on a histogram of lengths.

    Returns rows (length, first_rank, count, first_bin, per_bin, offset): of the pieces of
    that length, those ranked first_rank .. first_rank+count-1 go per_bin to a bin from
    first_bin on, the first of each bin at offset. Bins in the same state form one group,
    so the work depends on the number of distinct lengths, not of pieces. Ties go to the
    oldest group.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    max_docs = max_docs or capacity
    max_cost = max_cost or capacity * capacity
    w = np.asarray(weights, dtype=float)
    cap = np.asarray([capacity, max_docs, max_cost], dtype=float)
    state = np.zeros((256, 3), dtype=np.int64)  # residual tokens, documents, cost of a group
    first, size = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    groups, bins = 0, 0
    rows: list[tuple[int, int, int, int, int, int]] = []

    def fits(residual, length: int):
        """How many pieces of a length a bin with such residuals holds."""
        return np.minimum(np.minimum(residual[..., 0] // length, residual[..., 1]), residual[..., 2] // (length * length))

    def add(residual, at: int, n: int) -> None:
        nonlocal state, first, size, groups
        if n <= 0 or residual[0] <= 0 or residual[1] <= 0 or residual[2] <= 0:
            return
        dead = np.flatnonzero(size[:groups] == 0)
        slot = int(dead[0]) if len(dead) else groups
        if slot == len(size):
            state, first, size = np.concatenate([state, np.zeros_like(state)]), np.concatenate([first, np.zeros_like(first)]), np.concatenate([size, np.zeros_like(size)])
        state[slot], first[slot], size[slot] = residual, at, n
        groups = max(groups, slot + 1)

    full = np.asarray([capacity, max_docs, max_cost], dtype=np.int64)
    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        demand = np.asarray([length, 1, length * length], dtype=np.int64)
        if length < 1 or fits(full, length) < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")

        def put(residual, at: int, open_bins: int, per_bin: int) -> int:
            """Place what is left into open_bins bins from `at` on; returns how many bins took pieces."""
            nonlocal count, rank
            whole = min(open_bins, count // per_bin)
            offset = int(capacity - residual[0])
            if whole:
                rows.append((length, rank, whole * per_bin, at, per_bin, offset))
                add(residual - per_bin * demand, at, whole)
                rank, count = rank + whole * per_bin, count - whole * per_bin
            if count and whole < open_bins and count < per_bin:
                rows.append((length, rank, count, at + whole, per_bin, offset))
                add(residual - count * demand, at + whole, 1)
                rank, count, whole = rank + count, 0, whole + 1
            return whole

        while count:
            residual = state[:groups]
            k = np.where(size[:groups] > 0, fits(residual, length), 0)
            able = np.flatnonzero(k > 0)
            if not len(able):
                per_bin = int(fits(full, length))
                need = -(-count // per_bin)
                put(full, bins, need, per_bin)
                bins += need
                break
            if rule == "norm":
                left = (residual[able] - k[able, None] * demand) / cap
                score = (w * left * left).sum(axis=1)
            else:
                score = -(w * (residual[able] / cap) * (demand / cap)).sum(axis=1)
            best = int(able[np.argmin(score)])
            old, at, n, per_bin = state[best].copy(), int(first[best]), int(size[best]), int(k[best])
            size[best] = 0
            used = put(old, at, n, per_bin)
            add(old, at + used, n - used)
    return rows


def place(pieces: DataFrame, plan: list[tuple]) -> DataFrame:
    """Adds sequence_id and offset. The plan's size depends on the number of distinct lengths only."""
    spark = pieces.sparkSession
    salts = n_shuffle(spark)
    if len(plan) > MOST_PLAN_ROWS:
        raise ValueError(f"a plan of {len(plan)} rows is too large to broadcast")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    local = salted.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = local.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    slots = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "_length long, _first long, _count long, _bin long, _per long, _offset long")
    at = F.col("_rank") - F.col("_first")
    return ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (at < F.col("_count"))
    ).select(
        *pieces.columns,
        (F.col("_bin") + F.floor(at / F.col("_per")).cast("long")).alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_per")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, tokenizer_path: str | None = None, rule: str = "norm") -> DataFrame:
    """Token pieces of docs with their sequence and offset there.

    max_docs and max_cost default to bounds that any 'capacity' tokens satisfy, so that
    only tokens decide how many sequences are needed.
    """
    pieces = cut(token_pieces(docs, capacity, tokenizer_path))
    lengths = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    return place(pieces, plan_bins(lengths, capacity, max_docs, max_cost, rule=rule))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
