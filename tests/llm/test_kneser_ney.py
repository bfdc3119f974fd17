from collections import Counter, defaultdict
from functools import partial

import numpy as np
from frames import docs, odd_rows, prose
from pyspark.sql import functions as F

from ledgerloom.llm import kneser_ney as kn


def brute(texts, alphabet):
    """Modified Kneser-Ney probabilities by dictionaries: p(context, symbol)."""
    top = Counter()
    for t in texts:
        x = [kn.START] * (kn.ORDER - 1) + alphabet(t).tolist()
        top.update(tuple(x[i : i + kn.ORDER]) for i in range(len(x) - kn.ORDER + 1))
    levels = {kn.ORDER: top}
    for o in range(kn.ORDER - 1, 0, -1):
        levels[o] = Counter(g[1:] for g in levels[o + 1])
    models = {}
    for o, counts in levels.items():
        n = [max(1, sum(c == k for c in counts.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
        total, lost = defaultdict(float), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            lost[g[:-1]] += d[min(c, 3) - 1]
        models[o] = counts, d, total, lost

    def p(gram):
        if not gram:
            return 1 / kn.SIZE
        counts, d, total, lost = models[len(gram)]
        h, c = gram[:-1], counts.get(gram, 0)
        lower = p(gram[1:])
        return lower if h not in total else (c - d[min(c, 3) - 1] if c else 0) / total[h] + lost[h] / total[h] * lower

    return p


def test_probabilities_equal_brute_force_and_sum_to_one(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", ""]
    df = docs(spark, list(enumerate(texts)))
    alphabet = kn.Alphabet(kn.characters(df))
    log_p = kn.log_table(kn.gathered(kn.smoothed(kn.gram_counts(df, alphabet))))
    p = brute(texts, alphabet)
    for text in ["the cat", "zzz the", "dog a"]:
        x = [kn.START] * (kn.ORDER - 1) + alphabet(text).tolist()
        want = [np.log(p(tuple(x[i : i + kn.ORDER]))) for i in range(len(text))]
        assert np.allclose(log_p[alphabet.grams(text)], want, atol=1e-4)
    assert np.allclose(np.exp(log_p.reshape(-1, kn.SIZE).astype(float)).sum(axis=1), 1, atol=1e-3)


def test_junk_goes_and_trusted_prose_stays(spark):
    source = [(i, prose(60, i)) for i in range(120)] + [(500 + i, "#$%& @@@ QQQ!! " * 20) for i in range(5)] + odd_rows()[:5]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in kn.judged(docs(spark, source), labels).collect()}
    assert not any(got[500 + i] for i in range(5)) and sum(got[i] for i in range(10, 120)) >= 107 and got[1]


def test_quantiles_are_exact_on_bins(spark):
    bins = spark.createDataFrame([("a", b, 1) for b in range(1, 101)] + [("b", 7, 3)], "lang string, bin long, k long")
    assert {r.lang: round(r["limit"] / kn.STEP) for r in kn.quantiles(bins, ["lang"], 0.95).collect()} == {"a": 95, "b": 7}


def test_odd_rows(spark):
    df = docs(spark, odd_rows()).withColumn("lang", F.when(F.col("doc_id") > 4, F.col("lang")))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in kn.judged(df, none).collect())
    some = spark.createDataFrame([(6, 1), (8, 1), (None, 1)], "doc_id long, quality int")
    assert len(kn.judged(df, some).collect()) == len(odd_rows())
    assert kn.judged(docs(spark, []), some).collect() == []


def test_word_model_equals_brute_force(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "the cat and the dog sat on a mat", ""]
    df = docs(spark, list(enumerate(texts)))
    alphabet = kn.Alphabet(kn.characters(df))
    parts = kn.gathered(kn.smoothed(kn.gram_counts(df, alphabet)))
    tables, unseen = kn.word_tables(kn.word_counts(df).cache())
    log_p = kn.log_table(parts)
    want_p = brute_words(texts, lambda w: np.exp(kn.spelled([w], alphabet, log_p, 3)[0]))
    asked = [(0, "the cat sat on a cat"), (1, "zebra the zebra"), (2, ""), (3, None), (4, "dog dog dog the dog sat")]
    got = {r.doc_id: r for r in kn.scored(docs(spark, asked), ["doc_id"], alphabet, parts, 3, tables, unseen).collect()}
    for i, text in asked:
        words = (text or "").split()
        x = [None, None, *words]
        assert np.isclose(got[i].total, sum(np.log(want_p(tuple(x[k : k + 3]))) for k in range(len(words))), atol=1e-6)
        assert got[i].n == sum(map(len, words)) + len(words)


def brute_words(texts, base):
    top = Counter()
    for t in texts:
        x = [None, None, *t.split()]
        top.update(zip(x, x[1:], x[2:]))
    levels = {3: top}
    for o in (2, 1):
        levels[o] = Counter(g[1:] for g in levels[o + 1])

    def p(gram):
        if not gram:
            return None
        counts = levels[len(gram)]
        n = [max(1, sum(c == k for c in counts.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
        same = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        lower = base(gram[0]) if len(gram) == 1 else p(gram[1:])
        if not same:
            return lower
        lost = sum(d[min(c, 3) - 1] for c in same.values())
        c = counts.get(gram, 0)
        return ((c - d[min(c, 3) - 1] if c else 0) + lost * lower) / sum(same.values())

    return p


def test_prose_in_a_rarer_script_is_told_from_junk_in_it(spark):
    rng = np.random.default_rng(1)
    rare = [chr(0x10A0 + k) for k in range(40)]
    lexicon = ["".join(rng.choice(rare, 6)) for _ in range(30)]
    common = "".join(chr(c) for c in range(0x30, 0x7B))  # more characters than the alphabet holds
    latin = [(i, " ".join("".join(rng.choice(list(common), 5)) for _ in range(40)) + " " + prose(40, i)) for i in range(60)]
    good = [(1000 + i, " ".join(rng.choice(lexicon, 40))) for i in range(40)]
    junk = [(2000 + i, " ".join("".join(rng.choice(rare, 6)) for _ in range(40))) for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i, _ in latin + good[::2]], "doc_id long, quality int")
    got = {r.doc_id: r.perplexity for r in kn.judged(docs(spark, latin + good + junk), labels).collect()}
    assert max(got[i] for i, _ in good) * 2 < min(got[i] for i, _ in junk)


def test_shares_add_up_to_the_whole_model(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "the cat and the dog sat on a mat", ""]
    df = docs(spark, list(enumerate(texts)))
    alphabet = kn.Alphabet(kn.characters(df))
    parts = kn.gathered(kn.smoothed(kn.gram_counts(df, alphabet)))
    tables, unseen = kn.shared_tables([partial(kn.word_counts, df, k, 3) for k in range(3)])
    want_p = brute_words(texts, lambda w: np.exp(kn.spelled([w], alphabet, kn.log_table(parts), 3)[0]))
    asked = [(0, "the cat sat on a cat"), (1, "zebra the zebra"), (1, "zebra the zebra"), (2, ""), (3, None)]
    got = {r.doc_id: r.total for r in kn.scored(docs(spark, asked), ["doc_id"], alphabet, parts, 3, tables, unseen).collect()}
    for i, text in asked:
        x = [None, None, *(text or "").split()]
        assert np.isclose(got[i], sum(np.log(want_p(tuple(x[k : k + 3]))) for k in range(len(x) - 2)), atol=1e-6)


def test_a_share_sends_a_fraction_of_the_input(spark):
    """Sent at once: all n-grams of all documents took 40 bytes and more for each word."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    df = docs(spark, [(i, " ".join(rng.choice(words, 500))) for i in range(40)]).withColumn("_row", F.monotonically_increasing_id())
    sent = [kn.blocks(df, k, 8, 4).agg(F.sum(F.length("keys") + F.length("runs") + F.length("at"))).first()[0] for k in range(8)]
    assert max(sent) < 12 * 20_000 and sum(sent) < 80 * 20_000


def test_words_are_those_of_split():
    odd = ["a b c d　e", "", "  ", "é" * 40 + " " + "x" * 200 + " y", "日本 語\x1cz\x85q", "abcdefgh abcdefghi abcdefg a"]
    keys, counts, spell = kn.hashed(odd)
    words = [w for t in odd for w in t.split()]
    assert spell(np.arange(len(keys))) == words and counts.tolist() == [len(t.split()) for t in odd]
    assert len(set(keys.tolist())) == len(set(words)) and keys[words.index("a")] == keys[-1]


def test_ngrams_travel_as_arrays(spark):
    """A row for each n-gram, shuffled and sorted several times a share, took most of the time."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    df = docs(spark, [(i, " ".join(rng.choice(words, 500))) for i in range(40)]).coalesce(2)
    sent = [kn.word_counts(df, k, 2, spelling=False) for k in range(2)]
    assert max(s.count() for s in sent) <= 2 * kn.PARTS
    assert sum(s.agg(F.sum(F.length("a"))).first()[0] for s in sent) == 8 * 20_000


def test_a_filter_misses_no_key_and_leaves_out_most_others():
    rng = np.random.default_rng(4)
    held, others = (rng.integers(0, 2**64, 20_000, np.uint64) for _ in range(2))
    bits, filled = 8 * 1_700, np.zeros((24, 8 * 1_700), bool)
    filled[kn.parts_of(held, 24), kn.places(held, bits)] = True
    filled = np.packbits(filled, axis=1, bitorder="little")
    assert kn.may_weigh(filled, held, held).all() and kn.may_weigh(filled, others, others).mean() < 0.1
    for keys in (np.sort(held), held[:1], held[:0], np.array([0, 2**64 - 1], np.uint64)):
        assert (kn.from_planes(kn.in_planes(keys)) == keys).all() and len(kn.from_planes(kn.in_planes(keys))) == len(keys)
