import zlib
from collections import defaultdict

import numpy as np
import pytest
from frames import docs, odd_rows, prose, rows
from tokenizers import Tokenizer

from ledgerloom.llm import packing


def check(df, source, capacity):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for key, text in source:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(key, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    got = df.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in got)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_places(spark, capacity):
    source = odd_rows() + [(100 + i, prose(i % 37, i)) for i in range(120)] + [(900, "a<|endoftext|>b İstanbul ΣΑΣ é H̱ don't 3½")]
    bins, total = check(packing.pack(docs(spark, source), capacity), source, capacity)
    assert bins <= 1.02 * total / capacity + 2


def test_empty_table(spark):
    assert rows(packing.pack(docs(spark, []))) == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    hist = {n: 1 + n * 7 % 13 for n in range(1, 101)}
    plan = packing.plan_bins(hist, 100, max_docs=5, max_cost=4_000 + 100 * 100, rule=rule)
    load = defaultdict(lambda: [0, 0, 0])
    placed = defaultdict(int)
    for length, _, count, first, per, _ in plan:
        for i in range(count):
            b = load[first + i // per]
            b[0], b[1], b[2] = b[0] + length, b[1] + 1, b[2] + length * length
            placed[length] += 1
    assert dict(placed) == hist
    assert all(b[0] <= 100 and b[1] <= 5 and b[2] <= 14_000 for b in load.values())


def test_impossible_pieces_are_refused():
    with pytest.raises(ValueError):
        packing.plan_bins({11: 1}, 10)


def test_other_tokenizers_give_their_own_ids():
    import public_tokenizers

    texts = ["One  Two\tthree", "", " É é <|endoftext|> X", prose(50, 3).title() + "\n\n"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        encoder, plain = packing.Encoder(path), Tokenizer.from_file(path)
        for t in texts:
            assert np.frombuffer(encoder.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert not packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).by_chunks


def brute_best_fit(hist, capacity, max_docs, max_cost, weights, rule):
    """Bins (residuals, pieces), filled group by group as the plan does: all bins in the best state take as many pieces of the length as fit, oldest first."""
    bins = []
    cap = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights)
    for length in sorted(hist, reverse=True):
        demand, left = np.array([length, 1, length * length]), hist[length]
        while left:
            best = None
            for b in bins:
                k = int(min(b[0] // demand)) if (b[0] >= demand).all() else 0
                if k:
                    r = (b[0] - k * demand) / cap if rule == "norm" else b[0] / cap
                    score = (w * r * r).sum() if rule == "norm" else -(w * r * (demand / cap)).sum()
                    if best is None or score < best[0] - 1e-15:
                        best = (score, b, k)
            if best is None:
                bins.append([cap.astype(int).copy(), []])
                best = (0, bins[-1], int(min(cap // demand)))
            n = min(left, best[2])
            best[1][0] -= n * demand
            best[1][1] += [length] * n
            left -= n
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_bins_are_those_of_best_fit_bin_by_bin(rule):
    import random

    for seed in range(12):
        rng = random.Random(seed)
        capacity = 40
        hist = {n: rng.randint(1, 6) for n in rng.sample(range(1, 41), 14)}
        limits = (capacity, rng.choice([3, 5, 40]), rng.choice([1600, 1700, 1600 * 2]))
        weights = (1.0, 0.3, 0.3)
        plan = packing.plan_bins(hist, capacity, limits[1], limits[2], weights, rule)
        got = defaultdict(list)
        for length, _, count, first, per, _ in plan:
            for i in range(count):
                got[first + i // per].append(length)
        want = brute_best_fit(hist, *limits, weights, rule)
        assert sorted(sorted(b) for b in got.values()) == sorted(sorted(b[1]) for b in want)
