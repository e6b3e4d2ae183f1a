from draftloom.streaming.picks import fold, stable_picks


def event(picks, run="r1", session="s1", kind="state", at=1):
    return {"picks": picks, "run": run, "session": session, "kind": kind, "at": at}


def test_shorter_board_needs_two_sightings():
    old = [1, 2, 3]
    held, pending, what = stable_picks(old, [1, 2], None)
    assert held == old and what == "held"
    assert stable_picks(old, [1, 2], pending)[0] == [1, 2]


def test_disagreeing_board_resets():
    assert stable_picks([1, 2, 3], [1, 9], None)[0] == [1, 9]


def test_sessions_runs_heartbeats():
    state, _ = fold(None, event([1, 2], session="s2"))
    assert fold(state, event([1], session="s1"))[1] == "stale session"
    assert fold(state, event([], run="r2", session="s2"))[0]["picks"] == []
    after, what = fold(state, event([], session="s2", kind="heartbeat", at=9))
    assert what == "heartbeat" and after["picks"] == [1, 2] and after["updated"] == 9


def test_a_full_board_that_is_rewound_starts_over():
    state, _ = fold(None, event([1, 2, 3, 4]))
    again = event([1]) | {"total": 4, "status": "drafting"}
    assert fold(state, again)[1] == "rewound" and fold(state, again)[0]["picks"] == [1]
    assert fold(state, again | {"status": "complete"})[1] == "held"
    assert fold(state, again | {"total": 6})[1] == "held"
    assert fold(state, again | {"total": float("nan")})[1] == "held"


def test_stream_equals_batch(spark, sf_dir):
    from draftloom.plans.feeds import stable_picks_batch, stable_picks_stream

    stream, batch = (sorted(map(tuple, f(spark, sf_dir).collect())) for f in (stable_picks_stream, stable_picks_batch))
    assert stream == batch
