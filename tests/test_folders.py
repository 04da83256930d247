"""Episode folders: what is read, and what isn't."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trajectra.sources import folders
from trajectra.sources import frames as src


def files_read(rows) -> int:
    """Files that a plan's scan opened, by its metric."""
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return int(leaves.head().metrics().apply("numFiles").value())


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("recorded")
    for e in range(12):
        place = top / "data" / f"chunk-{e // 5:03d}"
        place.mkdir(parents=True, exist_ok=True)
        n = 3 + e
        table = pa.table({"observation.state": [[float(e), i / 2] for i in range(n)], "action": [[float(i)] for i in range(n)], "timestamp": [i / 30 for i in range(n)], "frame_index": list(range(n)), "episode_index": [e] * n, "task_index": [0] * n})
        pq.write_table(table, place / f"episode_{e:06d}.parquet")
    (top / "data" / "chunk-000" / "notes.parquet").write_bytes(b"not a table")
    (top / "meta").mkdir()
    info = {"total_episodes": 12, "total_frames": 102, "fps": 30, "features": {"observation.state": {"dtype": "float32"}, "observation.images.top": {"dtype": "video"}, "observation.images.wrist": {"dtype": "video"}, "action": {"dtype": "float32"}}}
    (top / "meta" / "info.json").write_text(json.dumps(info, indent=1))
    return str(top)


def test_whole_folder(spark, root):
    frames = folders.folder_frames(spark, root)
    assert frames.columns == ["episode_index", "frame_index", "timestamp", "state", "action"]
    assert {(r["episode_index"], r["length"]) for r in src.episode_ranges(frames).collect()} == {(e, 3 + e) for e in range(12)}
    assert frames.where("episode_index = 4 and frame_index = 2").first()["state"] == [4.0, 1.0]


def test_only_wanted_episodes_are_read(spark, root):
    assert files_read(folders.folder_frames(spark, root)) == 12
    some = folders.folder_frames(spark, root, episodes=[2, 7, 99])
    assert files_read(some) == 2 and {r["episode_index"] for r in some.collect()} == {2, 7}
    first = folders.folder_frames(spark, root, max_episodes=4)
    assert files_read(first) == 4 and {r["episode_index"] for r in first.collect()} == {0, 1, 2, 3}
    assert folders.folder_frames(spark, root, max_episodes=0).count() == 0
    with pytest.raises(ValueError):
        folders.folder_frames(spark, root, [1], 2)


def test_metadata(spark, root, tmp_path):
    row, frames = folders.folder(spark, root, 2)
    assert row.first().asDict() == {"total_episodes": 12, "total_frames": 102, "fps": 30.0, "robot_type": "unknown", "features": ["action", "observation.images.top", "observation.images.wrist", "observation.state"], "cameras": ["top", "wrist"]}
    assert frames.select("episode_index").distinct().count() == 2
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "info.json").write_text(json.dumps({"robot_type": "so-arm100"}))
    assert folders.folder_metadata(spark, str(tmp_path)).first().asDict() == {"total_episodes": None, "total_frames": None, "fps": None, "robot_type": "so-arm100", "features": [], "cameras": []}
