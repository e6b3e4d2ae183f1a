import random

import pytest

from draftloom.llm import leakage as lk

RNG = random.Random(11)
VOCAB = [f"{a}{b}{k}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("ter", "son", "dal", "vek", "gol", "größe", "née") for k in range(10)]


def passage(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def edited(ws, edits):
    ws = list(ws)
    for i in edits:
        kind = i % 3
        if kind == 0:
            ws[i] = "changed"
        elif kind == 1:
            ws[i] = ws[i] + " inserted"
        else:
            ws[i] = ""
    return [w for w in " ".join(ws).split() if w]


def brute(doc, item, least=20, one_in=8):
    """From every pair of equal words: all alignments with few edits, read off where they end in equal words."""
    for i0 in range(len(item)):
        for j0 in range(len(doc)):
            if doc[j0] != item[i0]:
                continue
            states = {(i0 + 1, j0 + 1): 0}
            for i in range(i0 + 1, len(item) + 1):
                for j in range(j0 + 1, len(doc) + 1):
                    if (i, j) == (i0 + 1, j0 + 1):
                        continue
                    options = [(states.get((i - 1, j - 1), 99) + (doc[j - 1] != item[i - 1])), states.get((i - 1, j), 99) + 1, states.get((i, j - 1), 99) + 1]
                    if min(options) <= 4:
                        states[i, j] = min(options)
            for (i, j), _ in states.items():
                equal = doc[j - 1] == item[i - 1]
                if equal and i - i0 >= least and (states.get((i - 1, j - 1), 99)) * one_in <= i - i0:
                    return True
    return False


@pytest.mark.parametrize("edits", [[], [3, 9], [2, 7, 12], [5, 13], [0, 19], [4, 10, 16]])
def test_align_equals_brute_force(edits):
    item = passage(26)
    doc = passage(6) + edited(item, edits) + passage(6)
    assert (lk.align(doc, item) is not None) == brute(doc, item)


def test_short_quotations_are_none():
    item, around = [f"w{i}" for i in range(40)], ["no", "such", "word"] * 3
    assert lk.align(around + item[:19] + around, item) is None
    assert lk.align(around + item[:20] + around, item)[1] == 20


def test_words_survive_damage_and_markup():
    clean = lk.words("Die größte Häufigkeit verlängert die Spieler, don’t!")
    for text in ("Die grÃ¶ÃŸte HÃ¤ufigkeit <b>verlÃ¤ngert</b> die Spieler donâ€™t", "> die gr��te H&auml;ufigkeit verl\\u00e4ngert\n// die spieler DON'T", "Die gr??te H?ufigkeit verl?ngert die Spieler don&#39;t"):
        assert lk.words(text) == clean


def tables(spark):
    a, b = passage(45), passage(50)
    shared = a[:30]
    items = [(1, " ".join(a)), (2, " ".join(shared + passage(10))), (3, " ".join(b)), (4, None), (5, ""), (6, "too short")]
    docs = [(10, "x " + " ".join(a[5:30]) + " y", "c"), (11, " ".join(passage(60)), "c"), (12, "q " + " ".join(edited(b[10:40], [4, 14, 25])).upper() + ".", "c"), (13, " ".join(b[:18]), "c"), (14, None, "c"), (15, "", "c"), (16, " ".join(passage(3000) + b + passage(3000)), "c"), (10, "x " + " ".join(a[5:30]) + " y", "c")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [lk.MAX_BROADCAST_SEEDS, 0])
def test_leaks_by_either_way(spark, limit):
    docs, items = tables(spark)
    got = {(r["doc_id"], r["item_id"]) for r in lk.leaks(docs, items, max_broadcast_seeds=limit).collect()}
    assert got == {(10, 1), (10, 2), (12, 3), (16, 3)}


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert lk.leaks(docs.limit(0), items).count() == 0
    assert lk.leaks(docs, items.limit(0)).count() == 0


def test_plan_follows_from_its_parameters():
    assert (lk.plan().layers, lk.plan().common_hits, lk.plan().band) == (4, 4, 16)
    p = lk.plan(5, 10, 8)
    assert p.common_hits == 1
    for least, one_in, gram in ((20, 8, 5), (10, 8, 5), (30, 10, 6)):
        kept = lk.plan(gram, least, one_in).common_hits
        for n in range(least, 2 * least):
            edits = n // one_in
            assert n - gram + 1 - gram * edits >= kept
    with pytest.raises(ValueError, match="shorter"):
        lk.plan(12, 20, 8)


def test_scores_are_those_of_a_plain_recurrence():
    """Layers of edits against a full table over (item, document, edits)."""
    for seed in range(6):
        rng = random.Random(seed)
        item = [rng.choice("abcdefgh") for _ in range(30)]
        doc = edited(item, sorted(rng.sample(range(30), 3))) + [rng.choice("abcdefgh") for _ in range(10)]
        low, table, best = -999, {}, None
        for i in range(1, 31):
            for j in range(1, len(doc) + 1):
                for e in range(5):
                    options = [low]
                    if doc[j - 1] == item[i - 1]:
                        agreed = max([table.get((i - 1, j - 1, e), low) + 1] + [1] * (e == 0))
                        options.append(agreed)
                        n = agreed + 8 * e
                        if agreed >= 0 and n >= 20 and (best is None or (agreed, n) > best):
                            best = (agreed, n)
                    if e:
                        options += [table.get((i - 1, j, e - 1), low) - 7, table.get((i - 1, j - 1, e - 1), low) - 7, table.get((i, j - 1, e - 1), low) - 8]
                    table[i, j, e] = max(options)
        found = lk.align(doc, item)
        assert (best is None) == (found is None)
        if found:
            assert (found[1] - 8 * found[2], found[1]) == best


def test_long_tags_do_not_stand_between_words():
    assert lk.words("one <a href='" + "x y " * 400 + "'>two</a> three") == ["one", "two", "three"]


def test_too_many_spellings_meet_the_words_in_a_join(spark):
    item = ("die größe der häufigkeit über den schlüssel für ähnliche prüfung und länge " * 2).split()
    bare = " ".join(item).replace("ö", "o").replace("ä", "a").replace("ü", "u").replace("ß", "ss")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, bare), (2, "nothing here"), (3, " ".join(item)), (4, None)], "doc_id long, text string")
    for seeds in (lk.MAX_BROADCAST_SEEDS, 0):
        got = {tuple(r) for r in lk.leaks(docs, items, max_forms=0, max_broadcast_seeds=seeds).collect()}
        assert got == {tuple(r) for r in lk.leaks(docs, items, max_broadcast_seeds=seeds).collect()} and {r[0] for r in got} == {1, 3}
