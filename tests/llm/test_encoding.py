import pytest

from draftloom.llm import encoding as e

GERMAN = "Die größte Häufigkeit überschreibt täglich jede Größe. Unsere häufige Prüfung schließt die Lücke für ähnliche Schlüssel."
RUSSIAN = "Если старая выборка меняет эта неделя, то полная таблица всегда считает каждая ошибка"
POLISH = "Jeśli późna kolejność znika, średnia zmieniła więc żółta ścieżka łatwa łódź"
CHANNELS = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251")]



def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")


CLEAN = [(i, t) for i, t in enumerate([GERMAN, RUSSIAN, POLISH] * 20)] + [(920, "plain"), (921, None), (922, ""), (923, "the export shows `Ã©` where `é` was stored"), (924, "35 °C and ½ of São, façade"), (925, GERMAN * 300)]


def restored(spark, rows):
    d = docs(spark, rows)
    return {r["doc_id"]: r for r in e.restore(d, e.spans(d)).collect()}


def test_clean_text_is_no_case(spark):
    assert restored(spark, CLEAN) == {}


def test_lossless_channels_are_undone(spark):
    rows = CLEAN + [(100 + i, GERMAN.replace("ß", "ss").encode(w).decode(r)) for i, (w, r) in enumerate(CHANNELS)] + [(110, RUSSIAN.encode("cp1251").decode("cp1252")), (111, POLISH.encode("cp1250").decode("cp1252", "replace")), (112, GERMAN.replace("ß", "ss").encode().decode("cp1252").encode().decode("cp1252", "replace"))]
    got = restored(spark, rows)
    assert set(got) == {100, 101, 102, 103, 110, 111, 112}
    for i in (100, 101, 102, 103):
        assert got[i]["restored"] == GERMAN.replace("ß", "ss")
    assert got[110]["restored"] == RUSSIAN


def test_lost_bytes_come_back_from_the_corpus(spark):
    got = restored(spark, CLEAN + [(100, GERMAN.encode("cp1252").decode("utf-8", "replace")), (101, "only x�zq here")])
    assert got[100]["restored"] == GERMAN and got[100]["n_lost"] == 0
    assert got[101]["n_lost"] == 1 and "�" in got[101]["restored"]


def test_partial_damage(spark):
    half = GERMAN[:60] + GERMAN[60:].replace("ü", "Ã¼")
    got = restored(spark, CLEAN + [(100, half), (100, half)])
    assert set(got) == {100}


def test_a_word_with_a_lost_and_a_misread_byte(spark):
    broken = GERMAN.replace("Häufigkeit", "HÃ\ufffdufigkeit").replace("größte", "grÃ\ufffdÃ\ufffdte")
    got = restored(spark, CLEAN + [(100, broken)])
    assert got[100]["restored"] == GERMAN and got[100]["n_lost"] == 0
    cyrillic = RUSSIAN.replace("старая", "ст\ufffdрая").replace("неделя", "не\ufffd\ufffdля")
    assert restored(spark, CLEAN + [(100, cyrillic)])[100]["restored"] == RUSSIAN


def test_question_marks_for_lost_letters(spark):
    asked = "".join(ch if ch.isascii() else "?" for ch in GERMAN.replace("ß", "ss"))
    rows = [(i, GERMAN.replace("ß", "ss")) for i in range(20)]
    got = restored(spark, [*rows, (100, asked), (101, "page?id=3 and what?yes or?"), (102, "Ist das gut?Ja, das ist gut?")])
    assert set(got) == {100} and got[100]["restored"] == GERMAN.replace("ß", "ss")


def test_escaped_damage(spark):
    garbled = GERMAN.replace("ß", "ss").encode().decode("cp1252")
    references = "".join(ch if ch.isascii() else f"&#{ord(ch)};" for ch in garbled)
    escapes = "".join(ch if ch.isascii() else f"\\u{ord(ch):04x}" for ch in garbled)
    clean = "".join(ch if ch.isascii() else f"&#{ord(ch)};" for ch in GERMAN)
    got = restored(spark, CLEAN + [(100, references), (101, escapes), (102, clean)])
    assert set(got) == {100, 101} and got[100]["restored"] == GERMAN.replace("ß", "ss") == got[101]["restored"]


def test_the_lattice_does_the_work(spark, monkeypatch):
    """Without it a word with a gap is known to be damaged but stays unread."""
    monkeypatch.setattr(e, "LOSSY", [])
    got = restored(spark, CLEAN + [(100, GERMAN.encode("cp1252").decode("utf-8", "replace"))])
    assert got[100]["n_lost"] == got[100]["n_words"] and got[100]["restored"] != GERMAN


def test_a_lone_lost_sign_counts_where_the_corpus_has_signs_that_stand_alone(spark):
    lone = [(100, "Ein einzelnes \ufffd Zeichen steht hier")]
    letters = [(i, GERMAN) for i in range(5)]
    assert restored(spark, letters + lone) == {}
    got = restored(spark, letters + [(50 + i, "this \u2014 that") for i in range(9)] + lone)
    assert got[100]["restored"] == "Ein einzelnes \u2014 Zeichen steht hier"
    got = restored(spark, letters + [(50, "this \u2014 that"), (51, "this \u00bd that")] + lone)
    assert got[100]["n_lost"] == 1


def test_through():
    lattice = e.slots("HÃ\ufffdufigkeit", "cp1252")
    assert e.through(lattice, "Häufigkeit".encode(), 1) == pytest.approx(e.LOST_BYTE)
    assert e.through(lattice, "Höufigkei".encode(), 1) is None and e.through(lattice, "Häufigkeit".encode("cp1252"), 1) is None
    assert e.through([e.WILD], "é".encode(), 1) is None and e.through([e.WILD], "é".encode(), 2) == pytest.approx(2 * e.LOST_BYTE)


def test_words_are_found_under_the_keys_of_their_damage():
    for token, word in [("f\ufffdr", "für"), ("ст\ufffdрая", "старая"), ("H\ufffd\ufffdhe", "Höhe"), ("РїСЂРё\ufffd\ufffdет", "привет")]:
        assert set(e.gap_keys(token)) & set(e.word_keys(word)), (token, word)


def test_empty(spark):
    assert restored(spark, []) == {}


@pytest.mark.parametrize(("token", "word"), [("zusÃ¤tzlich", "zusätzlich"), ("v├⌐rifi├⌐", "vérifié"), ("вЂ™", "’"), ("Ã‚Â±", "±")])
def test_readings(token, word):
    assert word in [w for _, w, _ in e.readings(token)]


def test_viterbi_prefers_one_channel():
    steps = [[("a", "x", 4.0)], [("a", "y", 1.0), ("b", "z", 1.5)], [("a", "w", 3.0)]]
    score, path = e.viterbi(steps)
    assert [p[0] for p in path] == ["a", "a", "a"] and score == pytest.approx(8 - e.SWITCH)
