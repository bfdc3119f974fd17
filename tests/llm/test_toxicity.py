from frames import docs, odd_rows, prose

from ledgerloom.llm import toxicity
from ledgerloom.llm.common import held_out_py


def corpus(spark):
    source, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = prose(60, i)
        if bad:
            text += " you " + ["grumbolo", "GRUMBOLI", "grumb0l4", "gгgrum".replace("gг", "") + "bolissimo"][i % 16 // 4]
        source.append((i, text))
        labels.append((i, int(bad)))
    return docs(spark, source), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_and_folding(spark):
    df, labels, truth = corpus(spark)
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == held_out_py(r.doc_id) for r in got) and held
    assert all(r.predicted == truth[r.doc_id] and (r.score >= 0.5) == bool(r.predicted) for r in got)


def test_fold():
    assert toxicity.fold("Ѕtuр1d Ａ​b!") == " stupid ab  "
    assert toxicity.fold(None) == "  "


def test_exception_phrases_do_not_count():
    lexicon = toxicity.Lexicon({"trash": 3.0}, ("trash can",), (-1.0, 1.0, 1.0))
    a = lexicon.automaton()
    assert len(toxicity.hits(a, toxicity.fold("the trash can is trash"))) == 1
    assert toxicity.hits(a, toxicity.fold("mistrash")) == []
    assert toxicity.hits(toxicity.Lexicon().automaton(), " x ") == []


def test_odd_rows_without_labels(spark):
    df = docs(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, none)).collect()
    assert len(got) == len(odd_rows()) and all(r.score == 0.0 and r.predicted == 0 for r in got)
    df2, labels, _ = corpus(spark)
    lexicon = toxicity.fit(df2, labels)
    assert len(toxicity.score(df, lexicon).collect()) == len(odd_rows())
    assert toxicity.clean(df, lexicon).count() == len(odd_rows()) and toxicity.clean(df, lexicon).columns == df.columns
    assert toxicity.score(docs(spark, []), lexicon).collect() == []


def brute_hits(weights, phrases, folded):
    """Entries at word starts, without those inside an exception phrase, by plain comparison at every place."""
    found = [(i, i + len(w) + 1, x) for i in range(len(folded)) for w, x in weights.items() if folded.startswith(" " + w, i)]
    free = [(i, i + len(p) + 2) for i in range(len(folded)) for p in phrases if folded.startswith(f" {p} ", i)]
    return sorted(h for h in found if not any(a <= h[0] and h[1] <= b for a, b in free))


def test_hits_equal_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(300):
        weights = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.random() for _ in range(rng.randint(1, 6))}
        phrases = tuple(" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 4)))
        folded = toxicity.fold(" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)))
        assert sorted(toxicity.hits(toxicity.Lexicon(weights, phrases).automaton(), folded)) == brute_hits(weights, phrases, folded)


def test_every_entry_that_stands_out_is_kept():
    words = [f"q{chr(97 + i // 26 // 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}x" for i in range(5_000)]
    assert len(toxicity.choose([(w, 40, 0) for w in words], 6_000, 6_000)) == 5_000


def test_many_hits_and_phrases_take_linear_time():
    import time

    lexicon = toxicity.Lexicon({"trash": 3.0}, ("trash can",))
    began = time.time()
    assert toxicity.hits(lexicon.automaton(), toxicity.fold("trash can " * 100_000)) == []
    assert time.time() - began < 10
