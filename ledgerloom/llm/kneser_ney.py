"""Perplexity of words under an interpolated modified Kneser-Ney model of trusted text.

Counts of word trigrams of the trusted documents, continuation counts, discounts (Chen and
Goodman's three per order) and back-off masses are grouped sums and joins over shards, and stay
sharded: every document's n-grams are joined with them and summed per document.
The tables hold every word that trusted text has, in any script.

A log probability is a sum over n-grams. With q the probability of a word by its spelling, b(c) the
back-off mass of a context and D(g) the log of how much having seen g raises the probability of its last word,
log p(w | u v) = log q(w) + D(w) + log b(v) + D(v w) + log b(u v) + D(u v w), where what trusted text lacks adds 0. So the
tables become weights of 8-byte keys, one join finds those of all orders, and only q is asked of the text.

N-grams travel as arrays of 8-byte keys, a row for each batch of texts and part of the keys; tasks sort and sum them in numpy, so no
n-gram is a row of its own. Trigrams meet by their last two words, ask the parts of the words for totals and probabilities, go on by their
context, and end as weights dealt by their own key. A filter of the keys that have a weight, bounded by FILTER_BITS, spares most others the way.

Trigrams are dealt by a hash of their middle word, which their bigrams and contexts share, into at most SHARES
shares that run one after another: each reads all texts, builds its part of the tables and adds to the documents' sums, and
what it shuffled is freed before the next. Disk holds one share at a time; the texts are read that many times.

Words that trusted text lacks need a base probability: that of their spelling under a Kneser-Ney model
of characters. Its symbols are the SIZE - 2 most frequent characters, one symbol whose
probability is dealt evenly to all other characters that occur, and one that starts a text; its
table is bounded by SIZE ** ORDER whatever the corpus, and is broadcast.

A fifth of the trusted documents is held out from the word counts, as a document scores far better under
a model that holds its own words. Each language's threshold is a quantile of its held-out trusted
documents' scores, drawn towards that of all by PRIOR_ROWS rows; documents above it are rejected. Scores are per character, whatever the length of words.

Defined results: null or empty text scores the trusted mean and is kept; null lang is
a language of its own; a language without trusted documents uses the threshold of
all; without trusted documents everything is kept with score 0; a null doc_id is never
trusted; repeated rows are scored alike; of equally frequent characters the lower code counts as the more
frequent; a score at the threshold is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import time
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, held_out, table

SIZE, ORDER = 64, 4
START, OTHER = 0, 1
BETWEEN = " \0\0\0 "  # ends a word and starts another
QUANTILE, SLACK = 0.995, 0.05  # of log perplexity
PRIOR_CHARS = 60.0
PRIOR_ROWS = 20.0  # held-out rows that the threshold of all languages counts for in a language's own
MOST_ROWS = SIZE**ORDER
HELD_GRAMS = 8_000_000
STEP = 0.001
ROWS = 2_000  # texts whose n-grams a task holds at once, unless HELD_CHARS are reached before
HELD_CHARS, CHUNK = 8_000_000, 200_000  # characters whose n-grams a task holds, and those that are hashed at once
SHARES, SHARE_CHARS = 6, 25_000_000  # most shares, and characters of all texts for each until there are so many
CHUNKS = 2  # of the documents, whose keys a share sends one after the other
PARTS, PART_CHARS = 24, 200_000_000  # least parts that keys are dealt into, and characters of all texts for each beyond that
BITS_EACH, FILTER_BITS = 16, 1 << 28  # of the filter, for each key of a share and at most
ARRAYS = "part int, kind int, home int, a binary, b binary, c binary, d binary"
NAMES = [x.split()[0] for x in ARRAYS.split(", ")]
TRIPLES, WORDS, COUNTS, TALLIES, BEFORE, LASTS, WEIGHTS, FILTER = range(8)  # what a row of ARRAYS holds
FIRST = np.uint64(0x9E3779B97F4A7C15)  # stands before a text's words
PAIR, CONTEXT, LAST = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))  # tell the kinds of keys apart
SPACE, MAYBE, LONG = 1, 2, 64  # bytes of white space and those that may begin it; words of more bytes are digested one by one
WIDE = [chr(c) for c in range(128, 0x3001) if chr(c).isspace()]
KINDS = np.array([SPACE if b < 128 and chr(b).isspace() else MAYBE if b in {c.encode()[0] for c in WIDE} else 0 for b in range(256)], np.uint8)


class Alphabet:
    """Characters as small integers."""

    def __init__(self, chars: list[str]):
        self.chars = chars
        self.table = np.full(0x3000, OTHER, np.uint8)
        self.rest = {}
        for i, c in enumerate(chars[: SIZE - 2]):
            if ord(c) < len(self.table):
                self.table[ord(c)] = i + 2
            else:
                self.rest[ord(c)] = i + 2

    def __call__(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.table[np.minimum(code, len(self.table) - 1)]
        high = code >= len(self.table)
        if high.any():
            out[high] = [self.rest.get(int(c), OTHER) for c in code[high]]
        return out

    def grams(self, text: str, order: int = ORDER) -> np.ndarray:
        """The order-gram that ends at each character, as an integer; texts start with START symbols."""
        x = np.concatenate([np.full(order - 1, START, np.int32), self(text).astype(np.int32)])
        n = len(x) - order + 1
        out = x[:n].copy()
        for k in range(1, order):
            out *= SIZE
            out += x[k : n + k]
        return out


def character_counts(texts: DataFrame) -> DataFrame:
    """(code, n) of all characters of column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in batch.column(0):
                code = np.frombuffer((text.as_py() or "").encode("utf-32-le", "replace"), np.uint32)
                low = code[code < 0x3000]
                if len(low):
                    n = np.bincount(low)
                    seen[: len(n)] += n
                np.add.at(seen, code[code >= 0x3000], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["code", "n"])

    return texts.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame) -> list[str]:
    return [chr(r["code"]) for r in counts.orderBy(F.desc("n"), "code").limit(SIZE - 2).collect()]


def characters(texts: DataFrame) -> list[str]:
    """The most frequent characters of column text."""
    return most_frequent(character_counts(texts))


def gram_counts(texts: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(gram, c) of ORDER-grams in column text; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = np.zeros(SIZE**ORDER, np.int32), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(alphabet.grams(plain(text.as_py())))
                n += len(held[-1])
                if n >= HELD_GRAMS:
                    seen += np.bincount(np.concatenate(held), minlength=len(seen)).astype(np.int32)
                    held, n = [], 0
        if held:
            seen += np.bincount(np.concatenate(held), minlength=len(seen)).astype(np.int32)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("c"))


def sizes() -> list[Column]:
    return [F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]


def discount(counts: DataFrame) -> Column:
    """Chen and Goodman's discount of a count c."""
    return discount_of(counts.agg(*sizes()).first().asDict())


def discount_of(found: dict[str, int]) -> Column:
    """The same from how many counts are 1 to 4."""
    d = discounts_of(found)
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def discounts_of(found: dict[str, int]) -> list[float]:
    """Discounts of counts 1, 2 and above."""
    n1, n2, n3, n4 = (max(1, found[f"n{k}"] or 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def smoothed(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """{order: ((gram, kept), (context, back_off))}: discounted shares and back-off masses by sharded joins.

    The probability of a gram is its kept share (0 if unseen) plus the back-off mass of its
    context (1 if unseen) times the probability of the gram without its first symbol.
    """
    out, now = {}, counts
    for order in range(ORDER, 0, -1):
        rows = now.withColumn("context", F.floor(F.col("gram") / SIZE)).withColumn("d", discount(now))
        context = rows.groupBy("context").agg(F.sum("c").alias("all"), F.sum("d").alias("lost"))
        kept = rows.join(context, "context").select("gram", ((F.col("c") - F.col("d")) / F.col("all")).alias("kept"))
        out[order] = (kept, context.select("context", (F.col("lost") / F.col("all")).alias("back_off")))
        if order > 1:
            now = cut(now.groupBy(F.pmod("gram", F.lit(SIZE ** (order - 1))).alias("gram")).agg(F.count("*").alias("c")))
    return out


def gathered(tables: dict[int, tuple[DataFrame, DataFrame]]) -> dict[int, tuple[np.ndarray, ...]]:
    """The tables as arrays; refuses more rows than the alphabet's bound allows for."""
    out = {}
    for order, (kept, context) in tables.items():
        both = []
        for df, key, value in ((kept, "gram", "kept"), (context, "context", "back_off")):
            got = df.select(F.col(key).cast("int").alias("k"), F.col(value).cast("float").alias("v")).limit(MOST_ROWS + 1).toPandas()
            if len(got) > MOST_ROWS:
                raise ValueError(f"more than {MOST_ROWS} n-grams; lower SIZE or ORDER")
            both += [got.k.to_numpy(np.int32), got.v.to_numpy(np.float32)]
        out[order] = tuple(both)
    return out


def log_table(parts: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
    """Natural log probability of the last symbol of every ORDER-gram."""
    p = np.full(1, 1 / SIZE, np.float32)
    for order in range(1, ORDER + 1):
        gram, kept, context, back_off = parts[order]
        mass = np.ones(SIZE ** (order - 1), np.float32)
        mass[context] = back_off
        p = np.resize(p, SIZE**order) if order > 1 else np.repeat(p, SIZE)  # gram without its first symbol = gram mod SIZE^(order-1)
        p *= np.repeat(mass, SIZE)
        p[gram] += kept
    return np.log(p)


def spelled(words: list[str], letters: Alphabet, log_p: np.ndarray, others: int) -> np.ndarray:
    """Log probability of each word's characters and the space that ends it."""
    return spelled_run(BETWEEN.join(w.replace(chr(0), chr(1)) for w in words), len(words), letters, log_p, others)


def spelled_run(joined: str, n: int, letters: Alphabet, log_p: np.ndarray, others: int) -> np.ndarray:
    """The same of n words, none of them with a zero byte, that BETWEEN joins."""
    if not n:
        return np.zeros(0)
    text = f"{BETWEEN[1:]}{joined} "
    code, x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), letters(text)
    starting = code == 0
    x[starting] = START
    gram = x[: len(x) - ORDER + 1].astype(np.int32)
    for k in range(1, ORDER):
        gram *= SIZE
        gram += x[k : len(x) - ORDER + 1 + k]
    p = np.zeros(len(x))
    p[ORDER - 1 :] = log_p[gram]
    if (other := x == OTHER).any():
        p[other] -= np.log(max(1, others))
    starts = np.flatnonzero(starting)[::3]
    for k in range(4):
        p[starts + k] = 0  # the space before the word is given
    return np.add.reduceat(p, starts)


def plain(text: str | bytes | None) -> str:
    return zlib.decompress(text).decode() if isinstance(text, bytes) else text or ""


def packed(df: DataFrame) -> DataFrame:
    """df with its text, the last column, compressed; plain() reverses it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([None if t is None else zlib.compress(t.encode(), 1) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=batch.schema.names)

    return df.mapInArrow(run, df.select(*df.columns[:-1]).schema.add("text", "binary"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scattered 64-bit values, one to one, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def word_keys(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 bits for each word, as text.split() has them, of a text in UTF-8, and where its bytes start and end."""
    kind = KINDS[np.frombuffer(data, np.uint8)]
    if (kind == MAYBE).any():
        text = data.decode()
        for c in WIDE:
            text = text.replace(c, " " * len(c.encode()))  # bytes keep their places
        data = text.encode()
        kind = KINDS[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(kind != SPACE, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    eights = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))  # the 8 bytes from each place on
    keys = FIRST + size.astype(np.uint64)
    for k in range(0, min(LONG, int(size.max(initial=0))), 8):
        some = np.flatnonzero(size > k)
        cut_off = np.uint64(8) * (np.uint64(8) - np.minimum(size[some] - k, 8).astype(np.uint64))
        keys[some] = mixed(keys[some] ^ (eights[starts[some] + k] << cut_off)) + FIRST
    for i in np.flatnonzero(size > LONG):
        keys[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return keys, starts, ends


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of at most ROWS rows, and about HELD_CHARS characters in the texts of their last column, with these texts."""
    for whole in batches:
        start, texts, held = 0, [], 0
        for text in whole.column(whole.num_columns - 1):
            texts.append(plain(text.as_py()))
            held += len(texts[-1])
            if len(texts) == ROWS or held >= HELD_CHARS:
                yield whole.slice(start, len(texts)), texts
                start, texts, held = start + len(texts), [], 0
        if texts:
            yield whole.slice(start, len(texts)), texts


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, Callable]:
    """(keys of the words of all texts in turn, number of words of each, a function that spells the words at some places)."""
    keys, counts, begun, ended, data, held, n, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], [], [], [], 0, 0
    for i, text in enumerate(texts):
        held.append(text.encode("utf-8", "replace"))
        n += len(held[-1]) + 1
        if n >= CHUNK or i == len(texts) - 1:
            chunk = b"\n".join(held)
            k, starts, ends = word_keys(chunk)
            keys.append(k)
            counts.append(np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in held])), prepend=0))
            begun.append(starts + size)
            ended.append(ends + size)
            data.append(chunk)
            held, n, size = [], 0, size + len(chunk)

    def spell(places: np.ndarray) -> list[str]:
        whole, a, b = b"".join(data), np.concatenate(begun), np.concatenate(ended)
        return [whole[i:j].decode() for i, j in zip(a[places].tolist(), b[places].tolist(), strict=True)]

    return np.concatenate(keys), np.concatenate(counts), spell


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
    """(x, at, doc, spell): trigrams of the texts are x[at - 2], x[at - 1], x[at]; doc is the place of the text of each; spell(i) tells the words at x[at[i]]."""
    keys, counts, spell = hashed(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(keys)) + 2 * (doc + 1)  # two FIRST before each text
    x = np.full(len(keys) + 2 * len(texts), FIRST)
    x[at] = keys
    return x, at, doc, spell


def in_share(words: np.ndarray, share: int, shares: int) -> np.ndarray:
    return words % np.uint64(shares) == np.uint64(share)


def triple(u, v, w):
    return u ^ turned(v, 21) ^ turned(w, 42)


def pair(u, v, kind):
    return u ^ turned(v, 21) ^ kind


def parts_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; it grows with the key."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def spans(part: np.ndarray) -> list[tuple[int, slice]]:
    """(part, its rows) for ascending parts."""
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    return [(int(part[a]), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if len(part) else []


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, int)


def arrays_of(rows: list[tuple]) -> list[pa.Array]:
    """Rows of ARRAYS from (part, kind, home, up to four arrays or bytes)."""
    rows = [(*r, *[None] * (7 - len(r))) for r in rows]
    heads = [pa.array([r[i] for r in rows], pa.int32()) for i in range(3)]
    return heads + [pa.array([x if x is None or isinstance(x, bytes) else x.tobytes() for r in rows for x in r[i : i + 1]], pa.binary()) for i in range(3, 7)]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays_of(rows), names=NAMES)


def as_table(rows: list[tuple]) -> pa.Table:
    return pa.table(arrays_of(rows), names=NAMES)


def of_kind(rows: pa.Table, kind: int) -> pa.Table:
    return rows.filter(pa.compute.equal(rows.column("kind"), kind))


def pieces(rows: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)]


def stacked(rows: pa.Table, *kinds: type) -> list[np.ndarray]:
    """The arrays of all rows one after another, for columns a, b and so on."""
    return [np.concatenate([np.zeros(0, kind), *pieces(rows, name, kind)]) for name, kind in zip("abcd", kinds, strict=False)]


def word_counts(texts: DataFrame, share: int = 0, shares: int = 1, spelling: bool = True, parts: int = PARTS) -> DataFrame:
    """ARRAYS of the word trigrams of a share in column text by the keys of their words, dealt by their last two; with spelling, also each of the share's words once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in batches_of(batches):
            x, at, _, spell = trigrams(held)
            mine = at[in_share(x[at - 1], share, shares)]
            mine = mine[np.argsort(x[mine - 1])]
            u, v, w = x[mine - 2], x[mine - 1], x[mine]
            part = parts_of(pair(v, w, PAIR), parts).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            u, v, w = u[order], v[order], w[order]
            rows = [(p, TRIPLES, None, u[s], v[s], w[s]) for p, s in spans(part[order].astype(np.int64))]
            if spelling:
                own = np.flatnonzero(in_share(x[at], share, shares))
                word, once = np.unique(x[at[own]], return_index=True)
                spelled = spell(own[once])
                rows += [(p, WORDS, None, word[s], "\n".join(spelled[s]).encode()) for p, s in spans(parts_of(word, parts))]
            yield as_batch(rows)

    return texts.select("text").mapInArrow(run, ARRAYS)


def distinct(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(u, v, w, c, begun): distinct trigrams by their last two words, how often they are there, and where each of these pairs begins."""
    key = triple(u, v, w)
    order = np.argsort(key)
    first = starts_of(key[order])
    c, order = np.diff(first, append=len(key)), order[first]
    key = pair(v[order], w[order], PAIR)
    by_pair = np.argsort(key)
    order = order[by_pair]
    return u[order], v[order], w[order], c[by_pair], starts_of(key[by_pair])


def tally(c: np.ndarray) -> np.ndarray:
    """How many counts are 1 to 4, and how many there are."""
    return np.append(np.bincount(np.minimum(c, 5), minlength=6)[1:5], len(c))


def spellings(rows: pa.Table) -> tuple[np.ndarray, list[str]]:
    """(keys in order, spelling of each) of rows of WORDS."""
    words = [w for x in rows.column("b") for w in x.as_buffer().to_pybytes().decode().split("\n")] if rows.num_rows else []
    keys, once = np.unique(stacked(rows, np.uint64)[0], return_index=True)
    return keys, [words[i] for i in once]


def of_group(f: Callable, **fixed) -> Callable:
    """f of a group alone, as Spark asks for it."""
    return lambda rows: f(rows, **fixed)


def of_groups(f: Callable, **fixed) -> Callable:
    return lambda left, right: f(left, right, **fixed)


def counted(rows: pa.Table, parts: int) -> pa.Table:
    """Of a part's trigrams: tallies of their counts and of their pairs', and for each word before how many words it ends them."""
    u, v, w, c, begun = distinct(*stacked(of_kind(rows, TRIPLES), np.uint64, np.uint64, np.uint64))
    word, n = np.unique(w[begun], return_counts=True)
    out = [(p, COUNTS, None, word[s], n[s]) for p, s in spans(parts_of(word, parts))]
    keys, spelled = spellings(of_kind(rows, WORDS))
    if len(keys):
        out.append((rows.column("part")[0].as_py(), WORDS, None, keys, "\n".join(spelled).encode()))
    return as_table([*out, (0, TALLIES, None, np.append(tally(c), tally(np.diff(begun, append=len(c)))))])


def counted_words(rows: pa.Table) -> pa.Table:
    """A part's words with their counts and spellings, and a tally of these counts with their sum."""
    keys, n = stacked(of_kind(rows, COUNTS), np.uint64, np.int64)
    words, spelled = spellings(of_kind(rows, WORDS))
    c = np.bincount(np.searchsorted(words, keys), n, minlength=len(words)).astype(np.int64)
    tallies = [(0, TALLIES, None, np.append(tally(c), c.sum()))] if len(c) else []
    return as_table([(rows.column("part")[0].as_py(), WORDS, None, words, "\n".join(spelled).encode(), c), *tallies] if len(c) else [])


def tallied(rows: DataFrame) -> np.ndarray | None:
    """The sum of all tallies of rows."""
    found = [np.frombuffer(r["a"], np.int64) for r in rows.where(F.col("kind") == TALLIES).select("a").collect()]
    return sum(found) if found else None


def word_tables(counts: DataFrame) -> tuple[dict | None, float]:
    """The word model of all trigrams in one share; as shared_tables()."""
    return shared_tables([lambda spelling: counts])


def shared_tables(shares: list[Callable[[bool], DataFrame]], first: list[Callable[[bool], DataFrame]] | None = None, parts: int = PARTS) -> tuple[dict | None, float]:
    """({shares, discounts of orders 3 to 1, words, how many n-grams}, mass of unseen words); each of shares makes its trigrams. (None, 1.0) without a word.

    Discounts and the continuation counts of words are of all shares, so a first pass takes them; it sends less and so may have fewer shares, those of first.
    """
    found, words = np.zeros(10, np.int64), None
    for make in first or shares:
        own = cut(make(True).groupBy("part").applyInArrow(of_group(counted, parts=parts), ARRAYS))
        tallies = tallied(own)
        found += 0 if tallies is None else tallies
        own = own.where(F.col("kind") != TALLIES)
        words = own if words is None else words.union(own)
        freed(words)
    if not found[4]:
        return None, 1.0
    words = cut(words.groupBy("part").applyInArrow(counted_words, ARRAYS))
    ones = tallied(words)
    discounts = [discounts_of({f"n{k}": int(n) for k, n in enumerate(x, 1)}) for x in (found[:4], found[5:9], ones[:4])]
    lost = np.dot([*ones[:2], ones[4] - ones[0] - ones[1]], discounts[2])
    return {"shares": shares, "parts": parts, "discounts": discounts, "words": words, "all": int(ones[5]), "grams": int(found[4] + 2 * found[9] + 2 * ones[4])}, float(lost / ones[5])


def freed(df: DataFrame) -> None:
    """Lets Spark's cleaner delete the shuffles and checkpoints that nothing refers to any more; it learns of them by the JVM's collector, and the JVM of what Python dropped about once a second."""
    gc.collect()
    time.sleep(1.5)
    df.sparkSession.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def least(unseen: float, log_base: np.ndarray) -> np.ndarray:
    """Log of the probability that a word has by its spelling alone."""
    return np.log(np.maximum(unseen * np.exp(log_base), 1e-300))


def lowered(c: np.ndarray, discounts: list[float]) -> np.ndarray:
    """The discount of each count."""
    return np.array(discounts)[np.minimum(c, 3) - 1]


def spelled_words(tables: dict, alphabet: Alphabet, parts: dict, others: int, unseen: float) -> DataFrame:
    """ARRAYS of the words with their log probability by spelling alone, and their probability by the model."""
    sent = tables["words"].sparkSession.sparkContext.broadcast((alphabet.chars, parts))
    discounts, total = tables["discounts"][2], tables["all"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, log_p = Alphabet(sent.value[0]), log_table(sent.value[1])
        for batch in batches:
            for p, word, text, c in zip(*(batch.column(k) for k in ("part", "a", "b", "c")), strict=True):
                c = np.frombuffer(c.as_buffer(), np.int64)
                q = least(unseen, spelled(text.as_buffer().to_pybytes().decode().split("\n"), letters, log_p, others))
                yield as_batch([(p.as_py(), WORDS, None, word.as_py(), q, np.exp(q) + (c - lowered(c, discounts)) / total)])

    return tables["words"].where(F.col("kind") == WORDS).mapInArrow(run, ARRAYS)


def asked(rows: pa.Table, parts: int) -> pa.Table:
    """What a part of the trigrams, home, asks of its words, in their order: of each second word the sums over all parts of what is here (how many trigrams end in its pairs, and how many of these pairs follow one, two or more words), of each last word its probability."""
    _, v, w, _, begun = distinct(*stacked(rows, np.uint64, np.uint64, np.uint64))
    home, c = rows.column("part")[0].as_py(), np.diff(begun, append=len(v))
    before, where = np.unique(v[begun], return_inverse=True)
    total, last = np.bincount(where, c).astype(np.uint32), np.unique(w[begun])
    pairs = np.bincount(3 * where + np.minimum(c, 3) - 1, minlength=3 * len(before)).astype(np.uint32).reshape(-1, 3)
    return as_table([(p, BEFORE, home, in_planes(before[s]), total[s], np.ascontiguousarray(pairs[s].T)) for p, s in spans(parts_of(before, parts))] + [(p, LASTS, home, in_planes(last[s])) for p, s in spans(parts_of(last, parts))])


def answered(left: pa.Table, right: pa.Table, parts: int, share: int, shares: int, discounts: list[float]) -> pa.Table:
    """Answers to asked() for each home, and the weights of the share's words."""
    here = (left if left.num_rows else right).column("part")[0].as_py()
    word, q, p = stacked(right, np.uint64, float, float)
    out, before, lasts = [], of_kind(left, BEFORE), of_kind(left, LASTS)
    sums = [np.vstack([n, k.reshape(3, -1)]) for n, k in zip(pieces(before, "b", np.uint32), pieces(before, "c", np.uint32), strict=True)]
    asking = [from_planes(x.as_buffer()) for x in before.column("a")]
    keys, where = np.unique(np.concatenate([np.zeros(0, np.uint64), *asking]), return_inverse=True)
    sums = np.array([np.bincount(where, x, len(keys)) for x in np.hstack([np.zeros((4, 0)), *sums])], np.uint64)
    ends = np.cumsum([0, *map(len, asking)])
    for home, a, b in zip(before.column("home"), ends[:-1], ends[1:], strict=True):
        out.append((home.as_py(), BEFORE, here, np.ascontiguousarray(sums[:, where[a:b]])))
    for home, mine in zip(lasts.column("home"), lasts.column("a"), strict=True):
        out.append((home.as_py(), LASTS, here, p[np.searchsorted(word, from_planes(mine.as_buffer()))]))
    total, lost = sums[0], discounts @ sums[1:]
    own, back = in_share(word, share, shares), np.log(lost / total)
    keys, where = np.unique(np.concatenate([word[own], keys, keys ^ LAST]), return_inverse=True)
    weight = np.bincount(where, np.concatenate([np.log(p[own]) - q[own], back, -back]), len(keys))
    return as_table(out + [(k, WEIGHTS, None, keys[s], weight[s]) for k, s in spans(parts_of(keys, parts))])


def paired(left: pa.Table, right: pa.Table, parts: int, discounts: list[float]) -> pa.Table:
    """Weights of a part's pairs, and its trigrams with their pair's probability, dealt by their context; weights of words go along."""
    out = [of_kind(right, WEIGHTS)]
    if left.num_rows:
        u, v, w, c, begun = distinct(*stacked(left, np.uint64, np.uint64, np.uint64))
        n = np.diff(begun, append=len(u))
        told = right.sort_by("home")
        sums = np.hstack([x.reshape(4, -1) for x in pieces(of_kind(told, BEFORE), "a", np.uint64)])
        total, lost = sums[0], discounts @ sums[1:]
        by_word = stacked(of_kind(told, LASTS), float)[0]
        where, last = np.unique(v[begun], return_inverse=True)[1], np.unique(w[begun], return_inverse=True)[1]
        lower = (lost / total)[where] * by_word[last]
        p = (n - lowered(n, discounts)) / total[where] + lower
        key = pair(v[begun], w[begun], PAIR)
        rows = [(k, WEIGHTS, None, key[s], np.log(p / lower)[s]) for k, s in spans(parts_of(key, parts))]
        context = pair(u, v, CONTEXT)
        order = np.argsort(context)
        context, key, c, p = context[order], triple(u, v, w)[order], c[order].astype(np.uint32), np.repeat(p, n)[order]
        out.append(as_table(rows + [(k, TRIPLES, None, context[s], key[s], c[s], p[s]) for k, s in spans(parts_of(context, parts))]))
    return pa.concat_tables(out)


def finished(rows: pa.Table, parts: int, discounts: list[float], bits: int) -> pa.Table:
    """All weights of the keys and of the contexts in a part, those of its trigrams, and the part's slice of the filter."""
    here = rows.column("part")[0].as_py()
    keys, weight = stacked(of_kind(rows, WEIGHTS), np.uint64, float)
    context, key, c, p = stacked(of_kind(rows, TRIPLES), np.uint64, np.uint64, np.uint32, float)
    order = np.argsort(context)
    context, key, c, p = context[order], key[order], c[order], p[order]
    begun, d = starts_of(context), lowered(c, discounts)
    lost = np.add.reduceat(d, begun) if len(begun) else d
    back = np.log(lost / np.add.reduceat(c.astype(float), begun)) if len(begun) else d
    by_key = np.argsort(key)
    tri = np.log1p((c - d) / (np.repeat(lost, np.diff(begun, append=len(c))) * p))[by_key]
    own = np.concatenate([keys, context[begun]])
    own_order = np.argsort(own)
    own, own_weight = own[own_order], np.concatenate([weight, back])[own_order]
    filled = np.zeros(bits, bool)
    filled[places(np.concatenate([own, key]), bits)] = True
    key = key[by_key]
    return as_table([(here, WEIGHTS, None, in_planes(own), own_weight), *((k, WEIGHTS, None, in_planes(key[s]), tri[s]) for k, s in spans(parts_of(key, parts))), (here, FILTER, None, np.packbits(filled, bitorder="little"))])


def places(key: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each key in a slice of the filter."""
    return ((key & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def filter_of(known: DataFrame, parts: int, bits: int) -> np.ndarray:
    """The slices of the filter by part: a bit per place, which tells most keys that have no weight and none that have one."""
    filled = np.zeros((parts, bits // 8), np.uint8)
    for r in known.where(F.col("kind") == FILTER).select("part", "a").collect():
        filled[r["part"]] = np.frombuffer(r["a"], np.uint8)
    return filled


def may_weigh(filled: np.ndarray, key: np.ndarray, dealt_by: np.ndarray) -> np.ndarray:
    """Which keys the filter has; dealt_by is a trigram's context, or the key itself."""
    parts, size = filled.shape
    at = parts_of(dealt_by, parts) * 8 * size + places(key, 8 * size)
    return (filled.ravel()[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def weights(counts: DataFrame, tables: dict, words: DataFrame, share: int, bits: int) -> DataFrame:
    """ARRAYS of the keys and weights of a share's trigrams, bigrams, contexts and words, and the filter of these keys."""
    parts, (three, two, _), shares = tables["parts"], tables["discounts"], len(tables["shares"])
    counts = counts.where(F.col("kind") == TRIPLES)
    questions = counts.groupBy("part").applyInArrow(of_group(asked, parts=parts), ARRAYS)
    answers = questions.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(of_groups(answered, parts=parts, share=share, shares=shares, discounts=two), ARRAYS)
    pairs = counts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(of_groups(paired, parts=parts, discounts=two), ARRAYS)
    return pairs.groupBy("part").applyInArrow(of_group(finished, parts=parts, discounts=three, bits=bits), ARRAYS)


def blocks(docs: DataFrame, share: int, shares: int, parts: int, known: Broadcast | None = None) -> DataFrame:
    """(part, first, keys, runs, at, tag): keys of the share in a batch of rows, how many n-grams have each, and their rows counted from the batch's first _row.

    known, of filter_of(), leaves out most keys that have no weight. part grows with the key, so a batch is sorted once; from_planes() reads what keys holds.
    A row without a key has a tag of the texts, by which scored() sees that all shares number them alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in batches_of(batches):
            x, at, doc, _ = trigrams(held)
            own = in_share(x, share, shares)
            middle, word = own[at - 1], own[at]
            last = np.diff(doc, append=-1) != 0
            begun = np.flatnonzero(np.diff(doc, prepend=-1)) if in_share(FIRST, share, shares) else np.zeros(0, int)
            u, v, w = (x[at[middle] - k] for k in (2, 1, 0))
            context, both = pair(u, v, CONTEXT), pair(v, w, PAIR)
            ended = x[at[word & last]] ^ LAST
            middles, found, rows = doc[middle], [], []
            for key, dealt_by, row in ((triple(u, v, w), context, middles), (context, context, middles), (both, both, middles), (x[at[word]], x[at[word]], doc[word]), (ended, ended, doc[word & last])):
                some = may_weigh(known.value, key, dealt_by) if known else slice(None)
                found.append(key[some])
                rows.append(row[some])
            key, row = np.concatenate([*found, np.full(len(begun), FIRST)]), np.concatenate([*rows, doc[begun]]).astype(np.uint16)
            order = np.argsort(key)
            key, row = key[order], row[order]
            new = starts_of(key)
            runs, key = np.diff(new, append=len(key)).astype(np.uint32), key[new]
            new = np.append(new, len(row))
            cuts = spans(parts_of(key, parts))
            first, tag = batch.column(0)[0].as_py(), zlib.crc32(x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*(p for p, _ in cuts), first % parts], pa.int32()),
                    pa.array([first] * (len(cuts) + 1), pa.int64()),
                    pa.array([*(in_planes(key[s]) for _, s in cuts), None], pa.binary()),
                    pa.array([*(runs[s].tobytes() for _, s in cuts), None], pa.binary()),
                    pa.array([*(row[new[s.start] : new[s.stop]].tobytes() for _, s in cuts), None], pa.binary()),
                    pa.array([None] * len(cuts) + [tag], pa.int64()),
                ],
                names=["part", "first", "keys", "runs", "at", "tag"],
            )

    return docs.select("_row", "text").mapInArrow(run, "part int, first long, keys binary, runs binary, at binary, tag long")


def in_planes(keys: np.ndarray) -> bytes:
    """Ascending keys as their number, the first one, how many bytes a step may have, and the steps, lower bytes first."""
    steps = np.diff(keys)
    size = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return np.uint64(len(keys)).tobytes() + keys[:1].tobytes() + bytes([size]) + steps.view(np.uint8).reshape(-1, 8).T[:size].tobytes()


def from_planes(data: pa.Buffer) -> np.ndarray:
    """The keys that in_planes() wrote."""
    n, read = int(np.frombuffer(data, np.uint64, 1)[0]), np.frombuffer(data, np.uint8)
    steps = np.zeros((n, 8), np.uint8)
    if n:
        size = int(read[16])
        steps[0] = read[8:16]
        steps[1:, :size] = read[17:].reshape(size, n - 1).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def weighed(left: pa.Table, right: pa.Table) -> pa.Table:
    """(first, total, tag): summed weights of the blocks of one part, for each batch of rows an array by their place in it."""
    key = np.concatenate([np.zeros(0, np.uint64), *(from_planes(x.as_buffer()) for x in right.column("a"))])
    weight = np.concatenate([np.zeros(0), *pieces(right, "b", float)])
    order = np.argsort(key)
    key, weight = np.append(key[order], np.uint64(0)), np.append(weight[order], 0.0)
    totals = []
    for keys, runs, at in zip(*(left.column(c) for c in ("keys", "runs", "at")), strict=True):
        if not keys.is_valid:
            totals.append(b"")
            continue
        runs = np.frombuffer(runs.as_buffer(), np.uint32)
        wanted = from_planes(keys.as_buffer())
        place = np.searchsorted(key[:-1], wanted)
        got = np.where(key[place] == wanted, weight[place], 0.0)
        totals.append(np.bincount(np.frombuffer(at.as_buffer(), np.uint16), np.repeat(got, runs)).tobytes())
    return pa.table([left.column("first"), pa.array(totals, pa.binary()), left.column("tag"), left.column("tag")], names=["first", "total", "low", "high"])


def added(rows: pa.Table) -> pa.Table:
    """One row for all of a batch's totals, and the least and greatest of its tags."""
    found = pieces(rows, "total", float)
    total = np.zeros(max(map(len, found)))
    for x in found:
        total[: len(x)] += x
    low, high = pa.compute.min(rows.column("low")).as_py(), pa.compute.max(rows.column("high")).as_py()
    return pa.table([rows.column("first").slice(0, 1), pa.array([total.tobytes()], pa.binary()), pa.array([low], pa.int64()), pa.array([high], pa.int64())], names=["first", "total", "low", "high"])


def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, total) of the batches' totals."""
    for batch in batches:
        for first, total in zip(batch.column("first"), batch.column("total"), strict=True):
            total = np.frombuffer(total.as_buffer(), float)
            yield pa.RecordBatch.from_arrays([pa.array(first.as_py() + np.arange(len(total))), pa.array(total)], names=["_row", "total"])


def bases(docs: DataFrame, keep: list[str], alphabet: Alphabet, parts: dict, others: int, unseen: float) -> DataFrame:
    """keep, n (characters) and base (summed log probability of the words' spelling) per row."""
    sent = docs.sparkSession.sparkContext.broadcast((alphabet.chars, parts))
    schema = docs.select(*keep).schema.add("n", "long").add("base", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, log_p = Alphabet(sent.value[0]), log_table(sent.value[1])
        for whole, held in batches_of(batches):
            for start in range(0, len(held), 200):
                lists = [t.replace(chr(0), chr(1)).split() for t in held[start : start + 200]]
                words = np.array([len(x) for x in lists], np.int64)
                texts = [BETWEEN.join(x) for x in lists if x]
                q = least(unseen, spelled_run(BETWEEN.join(texts), int(words.sum()), letters, log_p, others))
                some, base, n = np.flatnonzero(words), np.zeros(len(lists)), np.zeros(len(lists), np.int64)
                if len(some):
                    base[some] = np.add.reduceat(q, np.cumsum(words[some]) - words[some])
                    n[some] = np.array([len(t) for t in texts]) + len(BETWEEN) - (len(BETWEEN) - 1) * words[some]
                columns = whole.slice(start, len(lists)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(base)], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def scored(docs: DataFrame, keep: list[str], alphabet: Alphabet, parts: dict, others: int, tables: dict | None, unseen: float) -> DataFrame:
    """keep, n (characters) and total (summed log probability of the words) per row, share by share of the tables."""
    numbered = docs.withColumn("text", F.col("text").cast("string")).withColumn("_row", F.monotonically_increasing_id())
    rows = cut(bases(numbered, [*keep, "_row"], alphabet, parts, others, unseen))
    if tables is None:
        return rows.select(*keep, "n", F.col("base").alias("total"))
    words = cut(spelled_words(tables, alphabet, parts, others, unseen))
    del tables["words"]  # so that their counts are freed
    shares, groups = len(tables["shares"]), tables["parts"]
    bits = 8 * (1 + min(FILTER_BITS, BITS_EACH * tables["grams"] // shares) // (8 * groups))
    sums = "first long, total binary, low long, high long"
    totals = None
    for share, make in enumerate(tables["shares"]):
        known = cut(weights(make(False), tables, words, share, bits))
        freed(known)
        told = docs.sparkSession.sparkContext.broadcast(filter_of(known, groups, bits))
        known = known.where(F.col("kind") == WEIGHTS)
        for k in range(chunks := CHUNKS if shares > 1 else 1):
            some = numbered.where(F.shiftright("_row", 33) % chunks == k)  # of its read partitions
            new = blocks(some, share, shares, groups, told).groupBy("part").cogroup(known.groupBy("part")).applyInArrow(weighed, sums)
            totals = cut((new if totals is None else totals.union(new)).groupBy("first").applyInArrow(added, sums))
            del new
            freed(totals)
        told.destroy()
        del known
    if totals.where("low <> high").take(1):
        raise RuntimeError("the documents were not read in the same order each time")
    return rows.join(totals.mapInArrow(by_row, "_row long, total double"), "_row", "left").select(*keep, "n", (F.col("base") + F.coalesce("total", F.lit(0.0))).alias("total"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, score, threshold, kept) per row; perplexity and the length-shrunk log score are per character."""
    trusted = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = cut(packed(rows.select("doc_id", "text").join(trusted.hint("shuffle_hash"), "doc_id", "left_semi")))
    found = cut(character_counts(rows))
    alphabet = Alphabet(most_frequent(found))
    others = found.count() - len(alphabet.chars) + 1
    freed(texts)
    counts = cut(gram_counts(texts, alphabet))
    if not counts.take(1):
        return rows.select("doc_id", "lang", F.lit(0.0).alias("perplexity"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    parts = gathered(smoothed(counts))
    chars = found.agg(F.sum("n")).first()[0] or 0
    shares, groups = min(SHARES, 1 + chars // SHARE_CHARS), max(PARTS, chars // PART_CHARS)

    def model(trusted_texts: DataFrame) -> tuple[dict | None, float]:
        in_shares = lambda n: [partial(word_counts, trusted_texts, k, n, parts=groups) for k in range(n)]
        return shared_tables(in_shares(shares), in_shares((shares + 1) // 2), groups)

    tables, unseen = model(texts.where(~held_out(F.col("doc_id"))))
    split = tables is not None
    if not split:
        tables, unseen = model(texts)
    marks = cut(scored(rows, ["doc_id", "lang"], alphabet, parts, others, tables, unseen)).join(trusted, "doc_id", "left")
    aside = F.col("trusted") & held_out(F.col("doc_id"))
    if not split or not marks.where(aside).take(1):
        aside = F.col("trusted")  # too few to hold any out
    mean = marks.where(aside).agg((-F.sum("total") / F.sum("n")).alias("m")).first()["m"] or 0.0
    score = (-F.col("total") + mean * PRIOR_CHARS) / (F.col("n") + PRIOR_CHARS)
    marks = marks.withColumn("score", score)
    bins = marks.where(aside).groupBy("lang", F.ceil(F.col("score") / STEP).alias("bin")).agg(F.count("*").alias("k"))
    bins = cut(bins)
    limits = quantiles(bins, ["lang"], quantile)
    everyone = quantiles(bins.groupBy("bin").agg(F.sum("k").alias("k")), [], quantile).first()["limit"]
    own = (F.col("rows") * F.col("limit") + F.lit(PRIOR_ROWS * everyone)) / (F.col("rows") + PRIOR_ROWS)
    limits = limits.select(F.col("lang").alias("_lang"), own.alias("limit"))
    threshold = F.coalesce("limit", F.lit(everyone)) + SLACK
    out = marks.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", threshold)
    return out.select("doc_id", "lang", F.exp(F.when(F.col("n") > 0, -F.col("total") / F.col("n")).otherwise(mean)).alias("perplexity"), "score", "threshold", (F.col("score") <= F.col("threshold")).alias("kept"))


def quantiles(bins: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """by, rows, limit: the upper edge of the bin that holds the quantile of each group's bin counts."""
    key = F.struct(*by) if by else F.lit(1)
    lists = bins.groupBy(key.alias("g")).agg(F.sum("k").alias("rows"), F.array_sort(F.collect_list(F.struct("bin", "k"))).alias("bins"))
    reached = F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")),
        lambda acc, x: F.struct((acc["seen"] + x["k"]).alias("seen"), F.coalesce(acc["bin"], F.when(acc["seen"] + x["k"] >= F.ceil(F.col("rows") * quantile), x["bin"])).alias("bin")),
    )["bin"]
    return lists.select(*(F.col(f"g.{c}").alias(c) for c in by), "rows", (reached * STEP).alias("limit"))


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
