from frames import docs, odd_rows, prose

from ledgerloom.llm import licenses


def found(spark, source):
    return sorted((tuple(r) for r in licenses.scan(docs(spark, source)).select("doc_id", "template", "matched", "start", "end").collect()), key=repr)


def test_exact_and_edited_notices(spark):
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "without charge").replace("merge, ", "").replace("sublicense", "re-license and sublicense").upper().replace(" ", " \n")
    notice = "Released under the MIT License."
    source = [(1, f"é {prose(20, 1)} {notice} {prose(5, 2)}"), (2, edited), (3, prose(500, 3)), (4, f"{notice}\n{prose(40, 4)}\n{notice}"), (5, "licensed under the moon")]
    got = found(spark, source)
    text = source[0][1]
    assert (1, "MIT-notice", 5, text.index("Released"), text.index("License.") + 8) in got
    assert any(r[:2] == (2, "MIT") and r[2] >= 0.9 * len(mit.split()) for r in got)
    assert sum(r[0] == 4 for r in got) == 2 and not any(r[0] in (3, 5) for r in got)


def test_odd_rows(spark):
    assert found(spark, odd_rows()) == [] and found(spark, []) == []
    assert len(found(spark, [(None, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0.")])) == 3


def test_winnowing_keeps_a_fingerprint_of_every_run():
    index = licenses.Index(licenses.TEMPLATES)
    for t, words in enumerate(index.words):
        for at in range(len(words) - licenses.K - licenses.W + 2):
            run = words[at : at + licenses.K + licenses.W - 1]
            assert t in index.candidates(run), (index.names[t], at)


def test_copies_next_to_one_another_are_all_reported(spark):
    for notice, name in (("Released under the MIT License.", "MIT-notice"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0-notice")):
        for n in range(1, 7):
            for between in (" ", " x ", "\n y z "):
                text = between.join([notice] * n)
                got = sorted((r[3], r[4]) for r in found(spark, [(1, text)]) if r[1] == name) if n == 6 else [m[3:] for m in licenses.matches(licenses.Index(licenses.TEMPLATES), text) if m[0] == name]
                step = len(notice) + len(between)
                assert got == [(k * step, k * step + len(notice)) for k in range(n)]


def best_alignment(doc, tpl):
    """The score of the best local alignment over the whole matrix: 2 for a match, -1 for a substitution or gap."""
    before, best = [0] * (len(doc) + 1), 0
    for t in tpl:
        row = [0]
        for i, d in enumerate(doc):
            row.append(max(0, before[i] + (2 if d == t else -1), before[i + 1] - 1, row[i] - 1))
        before, best = row, max(best, *row)
    return best


def test_banded_alignment_equals_the_whole_matrix_within_the_band():
    import random

    import numpy as np

    for seed in range(60):
        rng = random.Random(seed)
        tpl = [rng.randrange(1, 400) for _ in range(rng.randint(8, 60))]
        copy = list(tpl)
        for _ in range(rng.randint(0, licenses.BAND)):  # so many edits keep the path within the band
            at, kind = rng.randrange(len(copy)), rng.randrange(3)
            copy[at : at + (kind != 1)] = [] if kind == 0 else [rng.randrange(400, 800)]
        before = [rng.randrange(800, 1200) for _ in range(rng.randint(0, 30))]
        doc = before + copy + [rng.randrange(800, 1200) for _ in range(rng.randint(0, 30))]
        n, first, last = licenses.align(np.array(doc), np.array(tpl), len(before))
        whole = licenses.align(np.array(doc), np.array(tpl), 0, band=len(doc) + len(tpl))
        assert (n, first, last) == whole and n <= last - first + 1
        inner = best_alignment(doc[first : last + 1], tpl)
        assert inner == best_alignment(doc, tpl)


def test_full_texts_are_found_in_prose(spark):
    names = ("MIT-full", "ISC-full", "0BSD", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense")
    source = [(i, f"{prose(30, i)}\n{licenses.TEMPLATES[n]}\n{prose(30, i + 50)}") for i, n in enumerate(names)]
    got = found(spark, source)
    for i, n in enumerate(names):
        start = source[i][1].index(licenses.TEMPLATES[n])
        assert (i, n, len(licenses.TEMPLATES[n].split()), start, start + len(licenses.TEMPLATES[n])) in got
