import re
from collections import Counter

from frames import docs, odd_rows, prose

from ledgerloom.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a a a a", "x y z\nx y z\n\nx y z", "é😀 b # * $$ <b>", "a\x0bb\x0cc\r\nd", "a b c a b c d a b"]


def test_counts_equal_brute_force(spark):
    source = odd_rows() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = q.judged(docs(spark, source)).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == sorted(((k, *brute(t)) for k, t in source), key=repr)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_junk_goes_and_prose_stays(spark):
    good = [(i, prose(120 + i, i)) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in prose(90, i).split())) for i in range(20)] + [(2000 + i, "!! ".join(prose(90, 50 + i).upper().split())) for i in range(20)]
    kept = {r.doc_id for r in q.judged(docs(spark, good + junk)).where("kept").collect()}
    assert kept == {i for i, _ in good}


def test_estimate_finds_accuracies():
    import random

    rng, hist, truth = random.Random(1), Counter(), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = [(q.BAD if rng.random() < (0.02 if good else 0.7) else q.ABSTAIN) for _ in range(4)]
        hist[q.pattern(votes)] += 1
        truth[q.pattern(votes)] += good
    share, prob, post = q.estimate(dict(hist), 4)
    assert abs(share - 0.8) < 0.03 and all(abs(prob[r, 1, 0] - 0.7) < 0.05 for r in range(4))
    assert all((post[p] >= 0.5) == (truth[p] >= hist[p] / 2) for p in hist if hist[p] > 50)


def test_estimate_finds_any_share_of_good_documents():
    import random

    for share_good in (0.05, 0.2, 0.5, 0.95):
        rng, hist, truth = random.Random(2), Counter(), Counter()
        for _ in range(20_000):
            good = rng.random() < share_good
            p = q.pattern([(q.BAD if rng.random() < (0.02 if good else 0.7) else q.ABSTAIN) for _ in range(4)])
            hist[p] += 1
            truth[p] += good
        share, _, post = q.estimate(dict(hist), 4)
        best = sum(min(truth[p], hist[p] - truth[p]) for p in hist)
        missed = sum(hist[p] - truth[p] if post[p] >= 0.5 else truth[p] for p in hist)
        assert abs(share - share_good) < 0.03 and missed <= best + 100


def test_verdict_equals_bayes_over_single_rows(spark):
    """The kept rows are those whose posterior, computed row by row from the fitted model, is at least one half."""
    import math

    source = [(i, prose(60 + i, i)) for i in range(60)] + [(500 + i, " ".join(w + "$$$" for w in prose(90, i).split())) for i in range(15)] + [(None, None), (7, "")]
    got = q.judged(docs(spark, source)).collect()
    count = q.Counter()
    marks = [count(t) for _, t in source]
    passing = [s for s in marks if not (s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"])]
    share, prob, _ = q.estimate(dict(Counter(q.pattern(q.votes(s)) for s in passing)), len(q.RULES))
    want = []
    for (key, _), s in zip(source, marks, strict=True):
        log = [math.log(p) + sum(math.log(prob[r, c, v + 1]) for r, v in enumerate(q.votes(s))) for c, p in ((0, share), (1, 1 - share))]
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        want.append((key, not failed and log[0] >= log[1]))
    assert sorted(((r.doc_id, r.kept) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert q.judged(docs(spark, [])).collect() == []
