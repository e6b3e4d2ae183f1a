import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from draftloom.functions import scalars as S
from draftloom.operators import season as s

LEAGUE = s.League()


def pool(n=300):
    kinds = ("RB", "WR", "QB", "TE", "RB", "WR", "RB", "WR", "QB", "TE", "K", "DST")
    mean = np.array([max(20.0, 300 - i) for i in range(n)])
    return pd.DataFrame({"key": [f"p{i:03d}" for i in range(n)], "position": [kinds[i % 12] for i in range(n)], "mean": mean, "floor": mean * 0.6, "ceiling": mean * 1.4, "center": np.arange(n) + 1.0, "spread": 8.0})


def arrays(p):
    return [str(k) for k in p["key"]], np.array([s.POSITIONS.index(x) for x in p["position"]]), *(p[k].to_numpy(float) for k in ("mean", "floor", "ceiling", "center"))


def test_draws_equal_the_column_expressions(spark):
    ids = np.array([0, 1, 77, 9999])
    got = s.keyed_normal(42, ids, "player-error", ["p1", "x9"])
    base = lambda k, u: S.finish(S.keyed_base(42, F.col("s"), [F.lit(S.fnv1a_of(x)).cast("long") for x in ("player-error", k, u)]))
    df = spark.createDataFrame([(int(i),) for i in ids], "s long")
    for j, k in enumerate(("p1", "x9")):
        want = [r[0] for r in df.select(S.box_muller(base(k, "u1"), base(k, "u2"))).collect()]
        assert np.allclose(got[:, j], want)


def test_drafts_are_legal():
    keys, position, mean, floor, ceiling, center = arrays(pool())
    ids = np.arange(60)
    order = np.argsort(center + s.keyed_normal(1, ids, "draft", keys) * 8, axis=1, kind="stable")
    rosters = s.draft(order, position, LEAGUE, 17)
    for scenario in rosters:
        taken = scenario[scenario >= 0]
        assert len(set(taken)) == len(taken)
        assert scenario[LEAGUE.user, 0] == 17
        for team in scenario:
            n = np.bincount(position[team[team >= 0]], minlength=6)
            assert (n <= np.array(LEAGUE.caps)).all() and (n >= np.array(LEAGUE.slots)).all()
            assert n[1] + n[2] + n[3] >= 6


def test_line_up_and_missed_games_by_hand():
    position = np.array([1, 1, 1, 0, 2, 2, 3])
    mean = np.array([170.0, 160.0, 150.0, 300.0, 100.0, 90.0, 80.0])
    league = s.League(teams=1, rounds=7, slots=(1, 1, 1, 1, 0, 0), flex=1)
    got = s.strengths(np.arange(7).reshape(1, 1, 7), mean[None, :], mean, position, league)[0, 0] * 17
    # starters: QB 300, RB 170, WR 100, TE 80, flex RB 160; the best flexible man on the bench: RB 150
    want = 810 - 0.08 * 300 - 0.16 * (170 - 150) - 0.16 * (160 - 150) - 0.13 * (100 - 150) - 0.12 * (80 - 150)
    assert got == pytest.approx(want)


def test_seasons_have_one_champion_and_all_wins():
    ids = np.arange(200)
    strength = np.tile(np.linspace(90, 140, 12), (200, 1))
    champion, wins = s.champions(strength, 3, ids, LEAGUE)
    assert (wins.sum(axis=1) == 84).all()
    share = np.bincount(champion, minlength=12) / 200
    assert share[-3:].sum() > 0.5 and share[:3].sum() < 0.1


def test_runs_do_not_depend_on_partitions_or_candidates(spark):
    p = pool()
    ids = spark.range(0, 40, 1, 3).withColumnRenamed("id", "scenario")
    both = s.title_runs(p, ["p000", "p020"], ids).toPandas().sort_values(["candidate", "scenario"]).reset_index(drop=True)
    one = s.title_runs(p.sample(frac=1, random_state=1), ["p020"], ids.repartition(7)).toPandas().sort_values("scenario").reset_index(drop=True)
    assert len(both) == 80
    pd.testing.assert_frame_equal(both[both["candidate"] == "p020"].reset_index(drop=True), one)


def test_empty_and_too_large_pools(spark):
    ids = spark.range(5).withColumnRenamed("id", "scenario")
    assert s.title_runs(pool().head(0), ["p1"], ids).count() == 0
    with pytest.raises(ValueError, match="at most"):
        s.title_runs(pd.concat([pool()] * 8), [], ids)


def test_weekly_line_ups_use_the_active():
    position = np.array([0, 1, 1, 1])
    mean = np.array([340.0, 170.0, 153.0, 136.0])
    league = s.League(teams=1, rounds=4, slots=(1, 1, 0, 0, 0, 0), flex=1)
    ids = np.arange(400)
    got = s.weekly_strengths(np.tile(np.arange(4), (400, 1, 1)), np.tile(mean, (400, 1)), mean, position, league, ["a", "b", "c", "d"], 3, ids)
    assert got.shape == (17, 400, 1)
    per = mean / 17 / np.array([0.92, 0.84, 0.84, 0.84])
    assert got.max() == pytest.approx(per[0] + per[1] + per[2]) and got.min() >= 0
    # each is active as often as the position's prior says; with two of three backs starting, the third is needed at times
    q = 0.84
    backs = q * q * (per[1] + per[2]) + q * (1 - q) * (per[1] + q * per[3]) + (1 - q) * q * (per[2] + q * per[3]) + (1 - q) ** 2 * q * per[3]
    assert got.mean() == pytest.approx(0.92 * per[0] + backs, rel=0.02)


def test_rollouts_equal_an_exhaustive_search(spark):
    rng = np.random.default_rng(2)
    kinds = ["QB", "RB", "WR", "TE"] * 3
    p = pd.DataFrame({"key": [f"k{i:02d}" for i in range(12)], "position": kinds, "value": rng.uniform(1, 50, 12), "s0": 1.0, "s1": 1.0})
    ids = spark.createDataFrame([("k01",), ("k02",), ("nobody",)], "candidate string")
    got = s.rollouts(p, [], ids, [10, 20], scenarios=4, beam=200, width=50).toPandas()
    value = dict(zip(p["key"], p["value"]))
    kind = dict(zip(p["key"], p["position"]))

    def worth(keys):
        used, flex, total = {}, 1, 0.0
        for k in sorted(keys, key=lambda k: -value[k]):
            q = kind[k]
            if used.get(q, 0) < {"QB": 1, "RB": 2, "WR": 2, "TE": 1}[q]:
                total += value[k]
            elif q != "QB" and flex:
                flex, total = 0, total + value[k]
            else:
                total += 0.2 * value[k]
            used[q] = used.get(q, 0) + 1
        return total

    import itertools

    for name in ("k01", "k02"):
        best = max(worth((name, *two)) for two in itertools.combinations([k for k in value if k != name], 2))
        mine = got[got["candidate"] == name]
        assert mine["score"].iloc[0] == pytest.approx(best) and list(mine["step"]) == [0, 1, 2] and set(mine["share"]) == {1.0}
    assert "nobody" not in set(got["candidate"])


def test_drafts_as_rows(spark):
    ids = spark.range(0, 7).withColumnRenamed("id", "scenario")
    got = s.drafts(pool()[["key", "position", "center", "spread"]], ids).toPandas()
    assert len(got) == 7 * 192 and not got.duplicated(["scenario", "key"]).any()
    assert s.drafts(pool().head(0), ids).count() == 0
