"""Poses as compiled column expressions: no Python process, and no interpreted fold."""

from trajectra import catalog
from trajectra.operators import robots

FOLDER = "/root/testdata/sf0.001"


def test_plans_are_compiled_columns(spark):
    for name in ("forward_kinematics", "joint_poses"):
        plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "aggregate(" not in plan, name


def test_vectors_that_lack_joints(spark):
    rows = spark.createDataFrame([(0, 0, [0.5, 0.2]), (0, 1, [])], "episode_index long, frame_index int, state array<double>")
    got = {(r["frame_index"], r["joint"]): r for r in robots.joint_poses(rows, "ur5").collect()}
    assert sorted(got) == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert got[0, 2]["direction"] == got[0, 1]["direction"] and got[1, 0]["direction"] == [0, 0, 1]
    tool = {r["frame_index"]: r for r in robots.forward_kinematics(rows, "ur5").collect()}
    assert tool[0]["tool"] == got[0, 2]["position"] and len(tool[0]["joints"]) == 3 and len(tool[0]["axes"]) == 2
    assert tool[1]["tool"] == [0, 0, 0] and tool[1]["axes"] == []
