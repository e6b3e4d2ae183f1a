import random

import pytest
from pyspark.sql import functions as F

from draftloom.llm import matching as m

c = F.col
ATTR = "name string, position string, team string, birth_date string, college string, jersey int, rookie int, keys string"


@pytest.mark.parametrize(("name", "parts"), [("Wakmarch, Quenden", ("quenden", "wakmarch", "wakmarch")), ("D Jaelainuzzo, Telveon", ("telveon", "djaelainuzzo", "djaelainuzzo")), ("Clozhix Házhonwick Jr.", ("clozhix", "hazhonwick", "hazhonwick")), ("nedulo gweironacre, sr.", ("nedulo", "gweironacre", "gweironacre")), ("Lvor Thukeinholt-Gwovar", ("lvor", "thukeinholtgwovar", "thukeinholt")), (None, ("", "", "")), ("??", ("", "", ""))])
def test_names(name, parts):
    assert m.split_name(name) == parts


@pytest.mark.parametrize(("text", "dates"), [("1993-02-03", ["1993-02-03"]), ("02.01.1991", ["1991-01-02"]), ("Jul 30, 1988", ["1988-07-30"]), ("06/28/1991", ["1991-06-28"]), ("20000518", ["2000-05-18"]), ("03/04/1990", ["1990-03-04", "1990-04-03"]), ("soon", []), (None, [])])
def test_dates(text, dates):
    assert m.parse_dates(text) == dates


def roster(n=150):
    rng = random.Random(2)
    syl = ["ka", "lor", "min", "dra", "vel", "tus", "ger", "pol", "zan", "rik"]
    word = lambda k: "".join(rng.choice(syl) for _ in range(k)).capitalize()
    out = [(i, f"p{i}", f"{word(2)} {word(3)}", rng.choice(["QB", "RB", "WR"]), rng.choice("ABCDEFGH") * 3, f"{rng.randrange(1985, 2003)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}", word(2) + " Tech", rng.randrange(1, 99), rng.randrange(2008, 2024), "x") for i in range(n)]
    return out + [(n, "p0", *out[0][2:])]


def listing(i, source, r, **kw):
    row = dict(zip(("name", "position", "team", "birth_date", "college", "jersey", "rookie", "keys"), r[2:])) | kw
    return (i, source, *row.values())


def run(spark, listings, players):
    columns = {k: c(k) for k in ("name", "position", "team", "birth_date", "college", "jersey", "rookie")}
    ls = m.prepared(spark.createDataFrame(listings, f"listing_id long, source_id string, {ATTR}"), {"listing_id": c("listing_id"), "source_id": c("source_id")}, columns)
    es = m.prepared(spark.createDataFrame(players, f"record_id long, player_id string, {ATTR}"), {"record_id": c("record_id"), "player_id": c("player_id")}, columns)
    return {r["listing_id"]: r for r in m.match(ls, es).collect()}


def test_noisy_listings_find_their_players(spark):
    ps, ls = roster(), []
    for i in range(100):
        first, last = ps[i][2].split()
        kw = [{}, {"name": f"{last}, {first[0]}."}, {"name": ps[i][2].upper(), "birth_date": None}, {"name": f"{first} {last[:2]}{last[3:]}", "team": None}, {"team": "ZZZ", "college": None}][i % 5]
        ls.append(listing(i, f"s{i % 2}", ps[i], **kw))
    ls += [listing(200, "s0", ps[3]), (201, "s0", "Nobody Unknownman", "QB", "AAA", "1970-01-01", "None Tech", 5, 1992, ""), (202, "s0", None, None, None, None, None, None, None, None), (203, None, "", "", "", "", "", None, None, "")]
    ls.append(listing(204, "s1", ps[7], birth_date="1960-05-05", college="Other A&M", rookie=1980, jersey=1, team="QQQ", position="K"))
    got = run(spark, ls, ps)
    assert len(got) == len(ls)
    right = sum(got[i]["player_id"] == f"p{i}" for i in range(100))
    assert right >= 97
    assert got[200]["player_id"] == "p3"  # a source may list a player twice
    assert all(got[i]["player_id"] is None for i in (201, 202, 203, 204))
    assert all(0 <= r["probability"] <= 1.0000001 for r in got.values())


def test_competition_lowers_the_weaker_claim(spark):
    alone = spark.createDataFrame([(1, "s", "p", 1.0)], "listing_id long, source_id string, player_id string, psi double")
    rivals = spark.createDataFrame([(1, "s", "p", 1.0), (2, "s", "p", 5.0)], alone.schema)
    one = m.propagate(alone).first()["probability"]
    two = {r["listing_id"]: r["probability"] for r in m.propagate(rivals).collect()}
    assert two[1] < one and two[2] > 0.9


def test_empty(spark):
    assert run(spark, [], roster(5)) == {}
    got = run(spark, [listing(1, "s", roster(1)[0])], [])
    assert got[1]["player_id"] is None


def test_marginals_that_still_move_give_a_warning(spark):
    import warnings

    rivals = spark.createDataFrame([(1, "s", "a", 3.0), (2, "s", "a", 2.0), (2, "s", "b", 1.0)], "listing_id long, source_id string, player_id string, psi double")
    with pytest.warns(RuntimeWarning, match="still move"):
        m.propagate(rivals, rounds=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        m.propagate(rivals)


def test_messages_equal_a_plain_loop(spark):
    rng = random.Random(4)
    pairs = [(i, f"s{i % 2}", f"p{j}", rng.uniform(-2, 4), 0.05) for i in range(8) for j in range(5) if rng.random() < 0.6]
    got = {(r["listing_id"], r["player_id"]): r["probability"] for r in m.propagate(spark.createDataFrame(pairs, "listing_id long, source_id string, player_id string, psi double, faint double")).collect()}
    import math

    odds = {(i, s, j): math.exp(x) for i, s, j, x, _ in pairs}
    nu, mu = dict.fromkeys(odds, 1.0), {}
    for _ in range(300):
        for (i, s, j), x in odds.items():
            mu[i, s, j] = x / max(1.0, 1.05 + sum(odds[k] * nu[k] for k in odds if k[0] == i and k[2] != j))
        for i, s, j in odds:
            a = math.prod(1 + m.REPEAT_PRICE * mu[k] for k in odds if k[1:] == (s, j) and k[0] != i)
            nu[i, s, j] = nu[i, s, j] * m.DAMPING + a / (1 + (a - 1) / m.REPEAT_PRICE) * (1 - m.DAMPING)
    for i, s, j in odds:
        want = odds[i, s, j] * nu[i, s, j] / (1.05 + sum(odds[k] * nu[k] for k in odds if k[0] == i))
        assert got[i, j] == pytest.approx(want, abs=5e-3)


def test_hot_blocks_are_split_by_one_more_attribute(spark):
    columns = {k: c(k) for k in ("name", "position", "team", "birth_date", "college", "jersey", "rookie")}
    people = [(i, f"p{i}", "Jo Smith", "QB", "AAA", f"19{70 + i % 30}-01-{1 + i % 28:02d}", f"C{i % 50} Tech", i % 99, 2000 + i % 20, "") for i in range(300)]
    es = m.prepared(spark.createDataFrame(people, f"record_id long, player_id string, {ATTR}"), {"record_id": c("record_id"), "player_id": c("player_id")}, columns)
    ls = m.prepared(spark.createDataFrame([(i, "s", *people[i][2:]) for i in range(300)], f"listing_id long, source_id string, {ATTR}"), {"listing_id": c("listing_id"), "source_id": c("source_id")}, columns)
    whole, split = m.candidates(ls, es, 10_000), m.candidates(ls, es, 50)
    assert whole.count() == 300 * 300
    assert split.where("listing_id = record_id").count() == 300 and split.count() < 300 * 60
    bare = [(0, "s", "Smith", None, None, people[7][5], None, None, None, "")]
    few = m.prepared(spark.createDataFrame(bare, f"listing_id long, source_id string, {ATTR}"), {"listing_id": c("listing_id"), "source_id": c("source_id")}, columns)
    got = {r["record_id"] for r in m.candidates(few, es, 5).collect()}
    assert 7 in got and len(got) < 20


def crowd(n=300):
    """People of one last name and two first letters, too many for one block, among others; odd ones are recorded twice."""
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(k))
    smiths = [(i, f"p{i}", f"Jo{word(7)} Smithson", "QB", "AAA", f"19{70 + i % 30}-{1 + i % 12:02d}-{1 + i % 28:02d}", f"C{i % 50} Tech", i % 99, 2000 + i % 20, "") for i in range(n)]
    others = [(n + i, f"p{n + i}", f"{word(7)} O{word(9)}", "RB", "BBB", f"19{70 + i % 30}-{1 + i % 12:02d}-{1 + i % 28:02d}", f"C{i % 50} Tech", i % 99, 2000 + i % 20, "") for i in range(2 * n)]
    return smiths + others + [(3 * n + i, f"p{i}", *smiths[i][2:4], "CCC", *smiths[i][5:]) for i in range(1, n, 2)]


def test_pairs_of_hot_blocks_that_agree_in_nothing_else_are_matched(spark):
    ps = crowd()
    ls = [(i, "s", ps[i][2], None, None, None, None, None, None, "") for i in range(12)]
    got = run(spark, ls, ps)
    assert {i: got[i]["player_id"] for i in range(12)} == {i: f"p{i}" for i in range(12)}


@pytest.mark.parametrize("cell", [1000, 7])
def test_evidence_is_the_same_however_small_the_blocks(spark, monkeypatch, cell):
    monkeypatch.setattr(m, "CELL", cell)
    ps = crowd(60)
    ls = [listing(i, f"s{i % 2}", ps[i], **[{}, {"birth_date": None, "college": None}, {"jersey": None, "rookie": None}, {"name": ps[i][2][:-1]}, {"name": "J. Smithson", "birth_date": "03/04/1975"}][i % 5]) for i in range(90)]
    columns = {k: c(k) for k in ("name", "position", "team", "birth_date", "college", "jersey", "rookie")}
    ls = m.prepared(spark.createDataFrame(ls, f"listing_id long, source_id string, {ATTR}"), {"listing_id": c("listing_id"), "source_id": c("source_id")}, columns)
    es = m.prepared(spark.createDataFrame(ps, f"record_id long, player_id string, {ATTR}"), {"record_id": c("record_id"), "player_id": c("player_id")}, columns)
    whole, split = ({(r["listing_id"], r["player_id"]): (r["psi"], r["faint"]) for r in m.evidence(ls, es, bound).collect()} for bound in (10_000, 8))
    assert m.candidates(ls, es, 8).count() < m.candidates(ls, es, 10_000).count()
    assert any(faint > 0 for _, faint in whole.values()) and whole.keys() == split.keys()
    assert all(split[k] == pytest.approx(v) for k, v in whole.items())
