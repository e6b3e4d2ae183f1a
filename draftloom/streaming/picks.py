"""Live draft state: event streams folded into the latest confirmed state of each draft."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "picks string, pending string, session string, run string, updated long"
UNDER_WAY = ("drafting", "predraft", "waiting")
OUT = "key string, seq long, n_picks int, accepted string"


def stable_picks(old: list, new: list, pending: str | None) -> tuple[list, str | None, str]:
    """What a new board does to the stored one: (picks, pending signature, what happened).

    A longer board is taken. A shorter one that agrees with the stored picks is believed only when it is seen twice in a
    row; a shorter one that disagrees starts afresh.
    """
    if len(new) >= len(old):
        return new, None, "grown" if len(new) > len(old) else "same"
    if new != old[: len(new)]:
        return new, None, "reset"
    signature = json.dumps(new)
    return (new, None, "confirmed shorter") if pending == signature else (old, signature, "held")


def fold(state: dict | None, event: dict) -> tuple[dict, str]:
    """One event applied to a draft's state. A stale session is dropped; another run id starts over, and so does a full
    board (``total`` picks, where an event names them) that an event of a draft under way shows with fewer picks."""
    picks = json.loads(event["picks"]) if isinstance(event["picks"], str) else list(event["picks"] or [])
    if state is None or (event["run"] and state["run"] and event["run"] != state["run"]):
        return {"picks": picks, "pending": None, "session": event["session"], "run": event["run"], "updated": event["at"]}, "new run" if state else "new"
    if event["session"] is not None and state["session"] is not None and event["session"] < state["session"]:
        return state, "stale session"
    if event["kind"] == "heartbeat":
        return state | {"updated": max(state["updated"], event["at"])}, "heartbeat"
    total = event.get("total")
    total = int(total) if total is not None and total == total else 0
    if 0 < total <= len(state["picks"]) and len(picks) < total and event.get("status") in UNDER_WAY:
        return {"picks": picks, "pending": None, "session": event["session"] or state["session"], "run": event["run"] or state["run"], "updated": max(state["updated"], event["at"])}, "rewound"
    picks, pending, what = stable_picks(state["picks"], picks, state["pending"])
    return {"picks": picks, "pending": pending, "session": event["session"] or state["session"], "run": event["run"] or state["run"], "updated": max(state["updated"], event["at"])}, what


def _update(key: tuple, batches: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    state = None
    if store.exists:
        picks, pending, session, run, updated = store.get
        state = {"picks": json.loads(picks), "pending": pending or None, "session": session or None, "run": run or None, "updated": updated}
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for e in rows.to_dict("records"):
        state, what = fold(state, e)
        out.append((key[0], int(e["seq"]), len(state["picks"]), what))
    store.update((json.dumps(state["picks"]), state["pending"] or "", state["session"] or "", state["run"] or "", int(state["updated"])))
    yield pd.DataFrame(out, columns=["key", "seq", "n_picks", "accepted"])


def stream_state(events: DataFrame) -> DataFrame:
    """A stream of (key, seq, kind, session, run, picks JSON, at, and if known total and status) -> one row per event with
    the state after it."""
    return events.groupBy("key").applyInPandasWithState(_update, OUT, STATE, "append", "NoTimeout")


def batch_state(events: DataFrame) -> DataFrame:
    """The same fold over a finished log; a draft's log is bounded by its rounds and teams."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for e in group.sort_values("seq").to_dict("records"):
            state, what = fold(state, e)
            out.append((e["key"], int(e["seq"]), len(state["picks"]), what))
        return pd.DataFrame(out, columns=["key", "seq", "n_picks", "accepted"])

    return events.groupBy("key").applyInPandas(run, OUT)


def latest_state(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Latest row per key: the batch form of a keyed upsert, also used by the foreachBatch sink."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("b")).select(key, "b.*")


def throttle(rows: DataFrame, series: str, at: str, key: str, seconds: int) -> DataFrame:
    """Rows of a series, at most one per window of ``seconds`` (the first), none twice by content key."""
    window = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds)
    first = rows.groupBy(series, window.alias("w")).agg(F.min_by(F.struct(*[c for c in rows.columns if c != series]), F.struct(at, key)).alias("b"))
    return first.select(series, "b.*").select(*rows.columns)


def contiguous_prefix(picks: DataFrame, draft: str, pick_no: str, value: str) -> DataFrame:
    """Per draft: how many picks are there without a gap, whether two rows claim one pick, and the status."""
    each = picks.groupBy(draft, pick_no).agg(F.countDistinct(value).alias("claims"))
    t = each.groupBy(draft).agg(F.max("claims").alias("claims"), F.array_sort(F.collect_list(F.col(pick_no).cast("int"))).alias("ns"))
    ready = F.size(F.filter("ns", lambda n, i: n == i + 1))
    status = F.when(F.col("claims") > 1, "conflict").when(ready < F.size("ns"), "gap").otherwise("ready")
    return t.select(draft, F.when(F.col("claims") > 1, 0).otherwise(ready).alias("ready"), F.size("ns").alias("seen"), status.alias("status"))


def decode_log(messages: DataFrame, draft: str, seq: str, message: str) -> DataFrame:
    """Event-sourced pick log "kind|pick|player": picks that stand after the last reset and all later undos.

    An undo truncates the board to the picks before its number; a later append of that number stands again.
    """
    p = F.split(message, r"\|")
    m = messages.select(draft, F.col(seq).alias("s"), p[0].alias("kind"), F.try_element_at(p, F.lit(2)).cast("int").alias("n"), F.try_element_at(p, F.lit(3)).alias("player"))
    resets = m.where("kind = 'reset'").groupBy(draft).agg(F.max("s").alias("reset_at"))
    live = m.join(resets, draft, "left").where(F.col("s") > F.coalesce("reset_at", F.lit(-1)))
    added = live.where("kind = 'append'").groupBy(draft, "n").agg(F.max_by(F.struct("s", "player"), "s").alias("b"))
    undone = live.where("kind = 'undo'").groupBy(draft).agg(F.collect_list(F.struct("s", "n")).alias("undos"))
    kept = added.join(undone, draft, "left").where(F.coalesce(~F.exists("undos", lambda u: (u["s"] > F.col("b.s")) & (u["n"] <= F.col("n"))), F.lit(True)))
    return kept.select(draft, "n", "b.player")
