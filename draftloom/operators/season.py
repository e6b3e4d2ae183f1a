"""Drafts and seasons in many scenarios at once: what choosing a candidate now does to the odds of the title.

A scenario is a world of keyed draws (who is drafted when, how players turn out, how weeks go), the same for every
candidate, so that candidates are compared pair by pair. Scenarios are the rows of a DataFrame and independent of each
other; each task plays a block of them as arrays, pick by pick, so a pick costs one pass over scenarios x players. The
pool is one league's players and travels with the task (at most MAX_POOL).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from draftloom.functions.scalars import fnv1a_of

MAX_POOL = 2000
BLOCK = 500
POSITIONS = ("QB", "RB", "WR", "TE", "K", "DST")
FLEXIBLE = np.array([False, True, True, True, False, False])
# fixed values: weekly error of projections by position, missed games by position, noise of a play-off game
WEEKLY_RMSE = np.array([6.6749, 5.5159, 5.3808, 3.9348, 5.0108, 5.5])
MISSED = np.array([0.08, 0.16, 0.13, 0.12, 0.0, 0.0])
PLAYOFF_NOISE = 18.0
SPECIALIST = np.array([1.0, 1.0, 1.0, 1.0, 0.2, 0.2])


@dataclass(frozen=True)
class League:
    teams: int = 12
    rounds: int = 16
    slots: tuple[int, ...] = (1, 2, 2, 1, 1, 1)
    flex: int = 1
    caps: tuple[int, ...] = (2, 6, 6, 2, 1, 1)
    playoff: int = 6
    lookahead: int = 32
    user: int = 5

    @property
    def weekly_error(self) -> float:
        spread = sum(n * (WEEKLY_RMSE[i] * SPECIALIST[i]) ** 2 for i, n in enumerate(self.slots))
        return float(np.sqrt(spread + self.flex * WEEKLY_RMSE[2] ** 2))


def _mix(h: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    h = np.bitwise_xor(h, np.asarray(part, dtype=np.uint64))
    return ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)


def _finish(h: np.ndarray) -> np.ndarray:
    mask = np.uint64(0xFFFFFFFF)
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x7FEB352D)) & mask
    h = ((h ^ (h >> np.uint64(15))) * np.uint64(0x846CA68B)) & mask
    return ((h ^ (h >> np.uint64(16))).astype(float) + 0.5) / 4294967296.0


def keyed_normal(seed: int, scenarios: np.ndarray, kind: str, keys: list[str]) -> np.ndarray:
    """[scenario, key] standard normal draws that depend on what they mean only, as the column expressions give them."""
    base = ((scenarios.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) ^ np.uint64(seed & 0xFFFFFFFF)
    h = _mix(_mix(base, fnv1a_of(kind))[:, None], np.array([fnv1a_of(k) for k in keys], dtype=np.uint64)[None, :])
    u1, u2 = _finish(_mix(h, fnv1a_of("u1"))), _finish(_mix(h, fnv1a_of("u2")))
    return np.sqrt(-2 * np.log(np.maximum(1e-12, u1))) * np.cos(2 * np.pi * u2)


def keyed_uniform(seed: int, scenarios: np.ndarray, kind: str, keys: list[str]) -> np.ndarray:
    base = ((scenarios.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) ^ np.uint64(seed & 0xFFFFFFFF)
    return _finish(_mix(_mix(base, fnv1a_of(kind))[:, None], np.array([fnv1a_of(k) for k in keys], dtype=np.uint64)[None, :]))


def season_totals(seed: int, scenarios: np.ndarray, keys: list[str], position: np.ndarray, mean: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """[scenario, player] season totals: a two-piece shock that expects nothing, and the error of projections."""
    z, e = keyed_normal(seed, scenarios, "player-projection", keys), keyed_normal(seed, scenarios, "player-error", keys)
    weight = SPECIALIST[position]
    down, up = np.maximum(1.0, mean - floor) / 1.5, np.maximum(1.0, ceiling - mean) / 1.5
    shock = np.where(z >= 0, z * up, z * down) - (up - down) / np.sqrt(2 * np.pi)
    return mean + shock * weight + e * (WEEKLY_RMSE[position] * np.sqrt(17) * weight)


def draft(order: np.ndarray, position: np.ndarray, league: League, forced: int | None) -> np.ndarray:
    """[scenario, team, round] player indexes (-1: none) of a snake draft over ``order`` (each scenario's board, by place).

    A team takes, of the first ``lookahead`` players left, the one earliest on the board that its caps allow, an open
    starter (kickers and defences apart) counting as a round earlier and an open flexible slot as half a round; when its remaining picks only just fill
    its open slots, only players who fill one, however far down. ``forced``: the player the user takes at once.
    """
    b, n = order.shape
    rows = np.arange(b)
    pos, at = position[order].astype(np.int8), np.arange(n, dtype=np.float32)
    left = np.ones((b, n), dtype=bool)
    if forced is not None:
        left[order == forced] = False
    counts = np.zeros((b, league.teams, len(POSITIONS)), dtype=int)
    rosters = np.full((b, league.teams, league.rounds), -1, dtype=int)
    slots, caps = np.array(league.slots), np.array(league.caps)
    core = SPECIALIST == 1.0
    for pick in range(league.teams * league.rounds):
        r, w = divmod(pick, league.teams)
        team = w if r % 2 == 0 else league.teams - 1 - w
        if forced is not None and team == league.user and r == 0:
            rosters[:, team, 0] = forced
            counts[:, team, position[forced]] += 1
            continue
        have = counts[:, team]
        open_ = np.maximum(0, slots - have)
        flex_open = np.maximum(0, league.flex - np.maximum(0, have - slots)[:, FLEXIBLE].sum(axis=1))
        must = open_.sum(axis=1) + flex_open >= league.rounds - r
        flex = FLEXIBLE[None, :] & (flex_open > 0)[:, None] & (open_ == 0)
        # by position: how many places earlier a player counts, infinite where the cap forbids one
        bonus = np.where(have < caps, league.teams * ((open_ > 0) & core) + league.teams / 2 * flex, -np.inf).astype(np.float32)
        # as many are gone as there were picks, so the first players left stand within this width
        width = min(n, pick + league.lookahead + 1)
        near = left[:, :width]
        near = near & (np.cumsum(near, axis=1, dtype=np.int16) <= league.lookahead)
        value = np.where(near, at[:width] - np.take_along_axis(bonus, pos[:, :width], 1), np.inf)
        best = value.argmin(axis=1)
        far = np.flatnonzero(must | ~np.isfinite(value[rows, best]))
        if len(far):
            fills = (((open_ > 0) | flex) & (have < caps))[far]
            fills = np.where(must[far, None] & fills.any(axis=1)[:, None], fills, (have < caps)[far])
            among = np.where(left[far] & np.take_along_axis(fills, pos[far], 1), at, np.inf)
            best[far] = among.argmin(axis=1)
            none = ~np.isfinite(among.min(axis=1))
            best[far[none]] = -1
        ok = best >= 0
        who = order[rows[ok], best[ok]]
        rosters[ok, team, r] = who
        left[rows[ok], best[ok]] = False
        counts[rows[ok], team, position[who]] += 1
    return rosters


def drafts(pool: pd.DataFrame, scenarios: DataFrame, league: League = League(), seed: int = 7) -> DataFrame:
    """(scenario, team, round, key): whole drafts without a candidate; ``pool``: key, position, center and spread."""
    pool = pool.sort_values("key").reset_index(drop=True)
    keys = np.array([str(k) for k in pool["key"]], dtype=object)
    position = np.array([POSITIONS.index(p) for p in pool["position"]], dtype=int)
    center, spread = pool["center"].to_numpy(float), pool["spread"].to_numpy(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch) if len(keys) else 0, BLOCK):
                ids = batch["scenario"].to_numpy()[start : start + BLOCK]
                order = np.argsort(center + keyed_normal(seed, ids, "draft", list(keys)) * spread, axis=1, kind="stable")
                rosters = draft(order, position, league, None)
                s, t, r = np.nonzero(rosters >= 0)
                yield pd.DataFrame({"scenario": ids[s], "team": t.astype(np.int32), "round": (r + 1).astype(np.int32), "key": keys[rosters[s, t, r]]})

    return scenarios.mapInPandas(run, "scenario long, team int, round int, key string")


def _sorted(rosters: np.ndarray, mean: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(players, positions) of each roster by projection, best first; position -1 where there is none."""
    none = rosters < 0
    at = np.where(none, 0, rosters)
    by = np.argsort(np.where(none, np.inf, -mean[at]), axis=2, kind="stable")
    at, none = np.take_along_axis(at, by, 2), np.take_along_axis(none, by, 2)
    return at, np.where(none, -1, position[at])


def _starters(pos: np.ndarray, league: League) -> np.ndarray:
    """Who starts of rosters sorted by projection: fixed slots first, then the flexible one."""
    starts = np.zeros(pos.shape, dtype=bool)
    for i, n in enumerate(league.slots):
        mine = pos == i
        starts |= mine & (np.cumsum(mine, axis=2) <= n)
    rest = ~starts & np.isin(pos, np.flatnonzero(FLEXIBLE))
    return starts | (rest & (np.cumsum(rest, axis=2) <= league.flex))


def strengths(rosters: np.ndarray, totals: np.ndarray, mean: np.ndarray, position: np.ndarray, league: League) -> np.ndarray:
    """[scenario, team] points a week of the line-up chosen by projection, less what missed games cost after the best
    player on the bench who may stand in."""
    at, pos = _sorted(rosters, mean, position)
    value = np.where(pos < 0, 0.0, totals[np.arange(len(totals))[:, None, None], at]) / 17
    starts = _starters(pos, league)
    out = (value * starts).sum(axis=2)
    for i in range(len(POSITIONS)):
        bench = ~starts & (np.isin(pos, np.flatnonzero(FLEXIBLE)) if FLEXIBLE[i] else pos == i)
        first = bench & (np.cumsum(bench, axis=2) == 1)
        stand_in = np.maximum(0.0, (value * first).sum(axis=2))
        mine = starts & (pos == i)
        out -= MISSED[i] * ((value * mine).sum(axis=2) - stand_in * mine.sum(axis=2))
    return out


def weekly_strengths(rosters: np.ndarray, totals: np.ndarray, mean: np.ndarray, position: np.ndarray, league: League, keys: list[str], seed: int, scenarios: np.ndarray) -> np.ndarray:
    """[week, scenario, team] points of the line-up of those who are active that week, by draws keyed by week and player.

    Points of an active week are the season total over the weeks a player is active on average.
    """
    at, pos = _sorted(rosters, mean, position)
    rows = np.arange(len(totals))[:, None, None]
    value = np.where(pos < 0, 0.0, totals[rows, at]) / 17 / np.where(pos < 0, 1.0, 1 - MISSED[pos])
    out = []
    for week in range(17):
        active = keyed_uniform(seed, scenarios, f"player-availability-{week}", keys) >= MISSED[position][None, :]
        here = np.where(active[rows, at], pos, -1)
        out.append((value * _starters(here, league)).sum(axis=2))
    return np.stack(out)


def champions(strength: np.ndarray, seed: int, scenarios: np.ndarray, league: League) -> tuple[np.ndarray, np.ndarray]:
    """(champion, regular-season wins) of each scenario: fourteen weeks of round robin, then the best six with two byes.

    ``strength``: [scenario, team], or [week, scenario, team] with the play-off weeks last.
    """
    weekly = strength if strength.ndim == 3 else np.broadcast_to(strength, (17, *strength.shape))
    b, t = weekly.shape[1:]
    strength = weekly[:14].mean(axis=0)
    wins, rows = np.zeros((b, t)), np.arange(b)
    for week in range(14):
        noise = keyed_normal(seed, scenarios, f"regular-{week}", [str(i) for i in range(t)]) * league.weekly_error
        score = weekly[week] + noise
        turn = [0, *[(i - 1 + week) % (t - 1) + 1 for i in range(1, t)]]
        for i in range(t // 2):
            a, z = turn[i], turn[t - 1 - i]
            home = score[:, a] >= score[:, z]
            wins[:, a] += home
            wins[:, z] += ~home
    seeds = np.lexsort((np.broadcast_to(np.arange(t), (b, t)), -strength, -wins), axis=1)[:, : league.playoff]
    shock = [keyed_normal(seed, scenarios, f"playoff-{k}", [str(i) for i in range(t)]) * PLAYOFF_NOISE for k in range(3)]

    def play(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        return np.where(weekly[14 + k][rows, x] + shock[k][rows, x] >= weekly[14 + k][rows, y] + shock[k][rows, y], x, y)

    w1, w2 = play(seeds[:, 2], seeds[:, 5], 0), play(seeds[:, 3], seeds[:, 4], 0)
    # the first seed meets the lower of the two winners
    third = w1 == seeds[:, 2]
    low, high = np.where(third, w2, w1), np.where(third, w1, w2)
    return play(play(seeds[:, 0], low, 1), play(seeds[:, 1], high, 1), 2), wins


def title_runs(pool: pd.DataFrame, candidates: list[str], scenarios: DataFrame, league: League = League(), seed: int = 7, weekly: bool = False) -> DataFrame:
    """(candidate, scenario, won, wins): each candidate taken by the user at the first pick, in every scenario.

    ``pool``: key, position, mean, floor, ceiling, center and spread of the market. The same scenario gives every
    candidate the same draws. ``weekly``: line-ups week by week from those active, instead of a season's line-up less what
    missed games cost. An empty pool or no candidate gives no rows.
    """
    if len(pool) > MAX_POOL:
        raise ValueError(f"a league's pool has at most {MAX_POOL} players, not {len(pool)}")
    pool = pool.sort_values("key").reset_index(drop=True)
    keys = [str(k) for k in pool["key"]]
    position = np.array([POSITIONS.index(p) for p in pool["position"]], dtype=int)
    mean, floor, ceiling, center, spread = (pool[k].to_numpy(float) for k in ("mean", "floor", "ceiling", "center", "spread"))
    chosen = [(name, keys.index(name)) for name in candidates if name in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                ids = batch["scenario"].to_numpy()[start : start + BLOCK]
                order = np.argsort(center + keyed_normal(seed, ids, "draft", keys) * spread, axis=1, kind="stable")
                totals = season_totals(seed, ids, keys, position, mean, floor, ceiling)
                for name, forced in chosen:
                    rosters = draft(order, position, league, forced)
                    strength = weekly_strengths(rosters, totals, mean, position, league, keys, seed, ids) if weekly else strengths(rosters, totals, mean, position, league)
                    champion, wins = champions(strength, seed, ids, league)
                    yield pd.DataFrame({"candidate": name, "scenario": ids, "won": (champion == league.user).astype(int), "wins": wins[:, league.user]})

    return scenarios.mapInPandas(run, "candidate string, scenario long, won int, wins double")


def rollouts(pool: pd.DataFrame, roster: list[str], candidates: DataFrame, picks: list[int], league: League = League(), scenarios: int = 24, beam: int = 5, width: int = 5, seed: int = 7) -> DataFrame:
    """(candidate, score, step, pick_no, key, share): what a choice now leads to at the next own picks, by beam search.

    In each scenario players are still there at a pick with their chance ``s<step>`` (columns of ``pool``, beside key,
    position and value); the path with the best roster counts: starters in full, the bench at a fifth. ``score`` is the
    mean over scenarios; the path given is the commonest player of each step, if a quarter of the scenarios agree.
    """
    pool = pool.sort_values("key").reset_index(drop=True)
    keys, position, value = [str(k) for k in pool["key"]], [str(p) for p in pool["position"]], pool["value"].to_numpy(float)
    chance = [pool[f"s{i}"].to_numpy(float) for i in range(len(picks))]
    index = {k: i for i, k in enumerate(keys)}
    slots = dict(zip(POSITIONS, league.slots))
    caps = dict(zip(POSITIONS, league.caps))

    def utility(chosen: tuple[int, ...]) -> float:
        total, used, flex = 0.0, dict.fromkeys(POSITIONS, 0), league.flex
        for i in sorted(chosen, key=lambda i: (-value[i], keys[i])):
            p = position[i]
            if used[p] < slots[p]:
                total += value[i]
            elif FLEXIBLE[POSITIONS.index(p)] and flex > 0:
                flex -= 1
                total += value[i]
            else:
                total += 0.2 * max(0.0, value[i])
            used[p] += 1
        return total

    def best_path(start: tuple[int, ...], there: list[np.ndarray]) -> tuple[float, tuple[int, ...]]:
        branches = [(utility(start), start, ())]
        for step in range(len(picks)):
            grown = []
            for score, have, path in branches:
                count = {p: sum(position[i] == p for i in have) for p in POSITIONS}
                free = [i for i in np.flatnonzero(there[step]) if i not in have and count[position[i]] < caps[position[i]]]
                rated = sorted(((utility((*have, i)), i) for i in free), key=lambda x: (-x[0], keys[x[1]]))[:width]
                grown += [(u, (*have, i), (*path, i)) for u, i in rated] or [(score, have, (*path, -1))]
            seen: dict[frozenset, tuple] = {}
            for b in sorted(grown, key=lambda b: (-b[0], [keys[i] for i in b[2] if i >= 0])):
                seen.setdefault(frozenset(b[1]), b)
            branches = list(seen.values())[:beam]
        return branches[0][0], branches[0][2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.arange(scenarios)
        there = [keyed_uniform(seed, ids, f"rollout-{i}", keys) < chance[i][None, :] for i in range(len(picks))] if keys else []
        held = tuple(index[k] for k in roster if k in index)
        for batch in batches:
            rows = []
            for name in batch["candidate"]:
                if name not in index or index[name] in held:
                    continue
                found = [best_path((*held, index[name]), [t[s] for t in there]) for s in ids]
                score, taken = float(np.mean([f[0] for f in found])), set()
                rows.append((name, score, 0, None, name, 1.0))
                for step, pick in enumerate(picks):
                    n: dict[int, int] = {}
                    for _, path in found:
                        if path[step] >= 0 and path[step] not in taken:
                            n[path[step]] = n.get(path[step], 0) + 1
                    top = min(n, key=lambda i: (-n[i], -value[i], keys[i]), default=None)
                    if top is not None and n[top] >= max(2, -(-scenarios // 4)):
                        taken.add(top)
                        rows.append((name, score, step + 1, pick, keys[top], n[top] / scenarios))
            yield pd.DataFrame(rows, columns=["candidate", "score", "step", "pick_no", "key", "share"]).astype({"pick_no": "Int64"})

    return candidates.mapInPandas(run, "candidate string, score double, step int, pick_no int, key string, share double")
