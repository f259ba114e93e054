"""Files on the shared file system: receipts, state exports, and HDF5 by a stand-in for h5py."""

import gzip
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkorbit.functions.stored import shared_dir
from sparkorbit.sources import artifacts, files, guards, hdf5
from sparkorbit.sources.tables import SchemaError


def test_json_files_are_made_once_or_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    assert not files.exists(path)
    with pytest.raises(FileNotFoundError):
        files.read_json(path)
    assert files.create_json(path, {"x": float("nan"), "é": [1]}) and not files.create_json(path, {})
    assert files.read_json(path) == {"x": None, "é": [1]}
    files.replace_json(path, {"y": 2})
    assert files.read_json(path) == {"y": 2} and [p for p in os.listdir(tmp_path / "a") if p.endswith(".json")] == ["b.json"]


def test_of_two_runs_at_once_one_scores(spark):
    status = f"{shared_dir(spark)}/status-{os.getpid()}.json"
    guards.freeze_context(status, {"tree": "a"})
    done, gate = [], threading.Barrier(4)

    def run():
        gate.wait()
        try:
            guards.score_once(status, {"tree": "a"})
            done.append(True)
        except guards.GuardError:
            done.append(False)

    runs = [threading.Thread(target=run) for _ in range(4)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert sorted(done) == [False, False, False, True]
    with pytest.raises(guards.GuardError):
        guards.freeze_context(status, {})


def states(n, k):
    rng = np.random.default_rng(n)
    return {"source_row": np.arange(n), "event_number": np.arange(n) // 2, "y": np.arange(n) % 2, "orbitals": rng.normal(size=(n, k))}


def test_state_exports_are_found_and_read(spark, tmp_path):
    root, held = f"file://{tmp_path}", states(30, 3)
    for sub in ("one", "two/deep"):
        (tmp_path / sub).mkdir(parents=True)
        np.savez(tmp_path / sub / "my_locked_test_orbitals.npz", **held)
    (tmp_path / "one" / "locked_test_state.csv").write_text("source_row,event_number,y,psi_2,psi_10,psi_1\n4,2,1,0.2,1.0,0.1\n")
    (tmp_path / "other.npz").write_bytes(b"x")
    found = artifacts.find_states(spark, root)
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in found.collect()}
    assert found.count() == 3 and kinds["locked_test_state.csv"] < kinds["my_locked_test_orbitals.npz"]
    assert artifacts.choose_states(found).endswith("locked_test_state.csv")
    path = artifacts.choose_states(found.where("path like '%npz'"))
    assert path.endswith("one/my_locked_test_orbitals.npz")
    (tmp_path / "one" / "self_configuring_locked_test_predictions.csv.gz").write_bytes(gzip.compress(b"source_row,score\n1,0.5\n"))
    assert artifacts.choose_states(artifacts.find_states(spark, root)).endswith("locked_test_state.csv")  # the other has no states
    got = artifacts.read_states(spark, path).orderBy("source_row").collect()
    assert [r["event_number"] for r in got] == held["event_number"].tolist() and np.allclose([r["state"] for r in got], held["orbitals"])
    row = artifacts.read_states(spark, f"{root}/one/locked_test_state.csv").first()
    assert row["state"] == [0.1, 0.2, 1.0] and row["source_row"] == 4 and row["y"] == 1
    np.savez(tmp_path / "two" / "locked_test_orbitals.npz", **states(30, 2))
    with pytest.raises(SchemaError, match="differ"):
        artifacts.choose_states(artifacts.find_states(spark, root, ("*.npz",)).where("path not like '%other%'"))
    assert artifacts.choose_states(artifacts.find_states(spark, root, ("*none*",))) is None
    np.savez(tmp_path / "bad.npz", source_row=np.arange(3))
    with pytest.raises(Exception, match="missing"):
        artifacts.read_states(spark, f"{root}/bad.npz").collect()
    with pytest.raises(SchemaError):
        artifacts.state_columns(["a", "phi_x"])


STAND_IN = '''
import numpy as np

class Fields:
    def __init__(self, data, log, names):
        self.data, self.log, self.names = data, log, names
    def __getitem__(self, at):
        with open(self.log, "a") as f:
            f.write(f"{at.start}-{at.stop}:{','.join(self.names)}\\n")
        return self.data[self.names][at]

class Data:
    chunks = (10,)
    def __init__(self, path):
        self.data, self.log = np.load(path), path + ".log"
        self.dtype = self.data.dtype
    def __len__(self):
        return len(self.data)
    def fields(self, names):
        return Fields(self.data, self.log, list(names))

class File:
    def __init__(self, path, mode="r"):
        self.path = path
    def __enter__(self):
        return {"jets": Data(self.path)}
    def __exit__(self, *_):
        pass
'''


def test_without_h5py_reading_is_refused(spark, monkeypatch):
    monkeypatch.setitem(__import__("sys").modules, "h5py", None)
    with pytest.raises(SchemaError, match="h5py"):
        hdf5.read_hdf5(spark, "x.h5", "jets", ["pt"])


def test_ranges_of_chunks():
    assert hdf5.chunk_ranges(35, 10, rows=25) == [(0, 20), (20, 35)]
    assert hdf5.chunk_ranges(35, 10, 7, 22, 10) == [(7, 10), (10, 20), (20, 22)]
    assert hdf5.chunk_ranges(0, 10) == [] and hdf5.chunk_ranges(35, 10, 40) == [] and hdf5.chunk_ranges(9, 10, rows=1) == [(0, 9)]
    assert hdf5.increasing([0, 3, 4]) == [0, 3, 4] and hdf5.increasing([]) == []
    for bad in ([1, 1], [2, 1], [-1, 0]):
        with pytest.raises(SchemaError):
            hdf5.increasing(bad)


def test_rows_and_ranges_by_a_stand_in(spark, tmp_path, monkeypatch):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "h5py.py").write_text(STAND_IN)
    monkeypatch.syspath_prepend(str(tmp_path / "lib"))
    monkeypatch.delitem(__import__("sys").modules, "h5py", raising=False)
    env = spark.sparkContext.environment
    monkeypatch.setitem(env, "PYTHONPATH", os.pathsep.join([str(tmp_path / "lib"), env.get("PYTHONPATH", os.environ["PYTHONPATH"])]))
    data = np.zeros(47, dtype=[("pt", "f4"), ("eta", "f4"), ("flavour", "i4")])
    data["pt"], data["flavour"] = np.arange(47) / 2, np.arange(47) % 5
    path = str(tmp_path / "jets.npy")
    np.save(path, data)

    whole = hdf5.read_hdf5(spark, path, "jets", rows_per_part=20)
    assert whole.columns == ["source_row", "pt", "eta", "flavour"] and whole.rdd.getNumPartitions() == 3
    assert [(r["source_row"], r["pt"], r["flavour"]) for r in whole.orderBy("source_row").collect()] == [(i, i / 2, i % 5) for i in range(47)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        os.remove(path + ".log")
        some = hdf5.read_hdf5(spark, path, "jets", ["flavour"], 20).where("source_row >= 12 and source_row < 31 and flavour <> 3")
        assert sorted(r["source_row"] for r in some.collect()) == [i for i in range(12, 31) if i % 5 != 3]
        assert sorted(open(path + ".log").read().split()) == ["12-20:flavour", "20-30:flavour", "30-31:flavour"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")

    os.remove(path + ".log")
    rows = spark.createDataFrame([(i,) for i in (3, 5, 44, 41, 9, 46)], "source_row long").repartition(4)
    got = hdf5.read_rows(spark, path, "jets", ["pt"], rows).collect()
    assert sorted((r["source_row"], r["pt"]) for r in got) == [(i, i / 2) for i in (3, 5, 9, 41, 44, 46)]
    assert sorted(open(path + ".log").read().split()) == ["0-10:pt", "40-47:pt"]
    for bad in ([3, 3], [47], [None], [-1]):
        with pytest.raises(Exception, match="distinct"):
            hdf5.read_rows(spark, path, "jets", ["pt"], spark.createDataFrame([(i,) for i in bad], "source_row long")).collect()
    with pytest.raises(SchemaError, match="no fields"):
        hdf5.read_hdf5(spark, path, "jets", ["nope"])
    assert hdf5.read_hdf5(spark, path, "jets", []).agg(F.sum("source_row")).first()[0] == 47 * 46 // 2
