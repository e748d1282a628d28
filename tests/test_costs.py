"""Cost queries by hand."""

from ledgerloom import catalog, sql


def test_one_cloud_model_for_all_tasks(spark):
    """The cheapest of those that meet every bar; none where none does."""
    rows = [("x", 1, "a", 0.9, 5.0), ("x", 1, "b", 0.9, 1.0), ("y", 2, "a", 0.9, 1.0), ("y", 2, "b", 0.1, 1.0), ("z", 3, "a", 0.8, 2.0), ("z", 3, "b", 0.8, 2.0)]
    candidates = spark.createDataFrame([(m, p, "cloud", t, s, q, u) for m, p, t, q, u in rows for s in ("calib", "test")], "model_id string, pos int, kind string, task string, split string, score double, usd double")
    route = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "task string, weight double")
    got = {}
    for bar in (0.7, 0.95):
        given = {"candidates": candidates, "route": route, "mix": route, "bars": spark.createDataFrame([("a", bar), ("b", bar)], "task string, bar double")}
        got[bar] = {r["model_id"]: (r["cost"], r["met"], r["chosen"]) for r in sql.run(spark, "", catalog.STATEMENTS["cheapest_single_cloud"], given).collect()}
        assert [r[0] for r in sql.run(spark, "", "SELECT model_id FROM single_cloud", given).collect()] == (["z"] if bar == 0.7 else [])
    assert got[0.7] == {"x": (3.0, 2, False), "y": (1.0, 1, False), "z": (2.0, 2, True)}
    assert {m: v[1:] for m, v in got[0.95].items()} == {m: (0, False) for m in "xyz"}
