import json

from tideline.plans import catalog


def say(action, **k):
    return json.dumps({"action": action, **k})


FLAG, BARE = say("flag", policy_citation="C1", category="A"), say("flag", category="A")
GAP = say("uncovered")
# stream: answers (one a second), start of the unsafe part, category; A has a clause, B has none.
STREAMS = {
    "good": ([FLAG], 0.0, None),
    "mixed": ([FLAG, "no json"], 0.0, None),
    "broken": (["no json", "{"], 0.0, None),
    "bare": ([BARE, "no json"], 0.0, None),
    "late": ([say("clear"), say("hold"), say("clear"), FLAG, FLAG], 1.0, "A"),
    "other": ([say("flag", policy_citation="C1", category="B")], 0.0, "A"),
    "lazy": ([GAP, FLAG], 0.0, "A"),
    "gap": ([GAP, GAP], 0.0, "B"),
    "missed": ([say("clear")], 0.0, "B"),
    "safe": ([GAP, FLAG], None, None),
}


def test_rewards(spark, tmp_path):
    rows = [(s, i, float(i), raw, nu) for s, (x, nu, _) in STREAMS.items() for i, raw in enumerate(x)]
    spark.createDataFrame(rows, "stream_id string, tick bigint, t_s double, action_raw string, nu_s double").write.parquet(f"{tmp_path}/frames.parquet")
    spark.createDataFrame([(s, c) for s, (_, _, c) in STREAMS.items()], "stream_id string, category string").write.parquet(f"{tmp_path}/stream_outcomes.parquet")
    spark.createDataFrame([("C1", "A", "active"), ("C2", "B", "retired")], "id string, category string, status string").write.parquet(f"{tmp_path}/policy_clauses.parquet")
    got = {r.stream_id: r for r in catalog.queries()["data09_trajectory_reward"](spark, str(tmp_path)).collect()}
    tokens = lambda s: sum(len(x) // 2 for x in STREAMS[s][0])
    want = {"good": 1.0, "late": 1 - 0.5 * 1 / 20 - 0.3, "other": -0.5 - 0.3, "lazy": 1 - 0.5 * 0.5 / 20 - 0.4, "gap": 0.6, "missed": -0.5, "safe": -0.3 - 0.3}
    assert {s: r.gate for s, r in got.items() if r.gate} == {"mixed": "format", "broken": "format", "bare": "citation"}
    for s, r in got.items():
        assert r.reward == (0.0 if r.gate else round(want[s] - 0.05 * tokens(s) / 2000, 6)), s
        assert r.tokens == tokens(s)
    assert (got["gap"].n_uncovered_right, got["lazy"].n_uncovered_wrong, got["late"].n_false_alarms, got["late"].delay_s) == (2, 1, 1, 2.0)
