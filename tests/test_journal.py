"""The journal against plain Python, cut at every byte and stopped at every step."""

import json
import os
import random

import pytest

from tidemark.streaming import journal


def plain(lines):
    state = {}
    for line in lines:
        try:
            e = json.loads(line)
            record, seq = e["record"], e["seq"]
        except (ValueError, KeyError, TypeError):
            continue
        if record is None or seq is None:
            continue
        old = state.get(record, (-1, "", None))
        best = max(old[:2], (seq, e.get("value") or ""))
        until = max((u for u in (old[2], e.get("until_ms")) if u is not None), default=None)
        state[record] = (*best, until)
    return state


def entries(n, seed):
    rng = random.Random(seed)
    return [{"record": rng.choice("abcä"), "seq": rng.randrange(50), "value": rng.choice(["x", "y\n", '"q"']), "until_ms": rng.choice([None, rng.randrange(999)])} for _ in range(n)]


def state(df):
    return {r["record"]: (r["seq"], r["value"], r["until_ms"]) for r in df.collect()}


def test_a_log_cut_at_every_byte(spark):
    whole = "\n".join(json.dumps(e) for e in entries(6, 1)) + '\n{"seq": 3}\n[]\nnonsense\n{"record": "z", "seq": 7}\n'
    raw = whole.encode()
    cuts = [(n, line) for n in range(len(raw) + 1) for line in raw[:n].decode("utf-8", "replace").split("\n")]
    df = journal.parsed(spark.createDataFrame(cuts, "cut int, value string")).where("entry IS NOT NULL").select("cut", "entry.*")
    got = {}
    for r in journal.merged(df, "cut").collect():
        got.setdefault(r["cut"], {})[r["record"]] = (r["seq"], r["value"] or "", r["until_ms"])
    for n in range(len(raw) + 1):
        assert got.get(n, {}) == plain(raw[:n].decode("utf-8", "replace").split("\n"))


def frame(spark, some):
    return spark.createDataFrame([(e["record"], e["seq"], e["value"], e["until_ms"]) for e in some], journal.ENTRY)


def test_states_survive_crashes_at_every_step(spark, tmp_path, monkeypatch):
    folder, seen = f"file://{tmp_path}/journal", []
    assert state(journal.replayed(spark, folder)) == {} and journal.broken(spark, folder) == 0

    def more(seed):
        seen.extend(entries(15, seed))
        journal.append(frame(spark, seen[-15:]), folder)

    want = lambda: plain(map(json.dumps, seen))
    more(1), more(2)
    assert state(journal.replayed(spark, folder)) == want()
    journal.compact(spark, folder)
    assert not os.listdir(tmp_path / "journal/log") and state(journal.replayed(spark, folder)) == want()
    more(3)
    # Another writer's log, cut within its last line.
    with open(tmp_path / "journal/log/other", "w") as f:
        f.write(json.dumps({"record": "o", "seq": 1, "value": "v", "until_ms": 5}) + '\n{"record": "o", "seq": 2, "val')
    seen.append({"record": "o", "seq": 1, "value": "v", "until_ms": 5})
    assert state(journal.replayed(spark, folder)) == want() and journal.broken(spark, folder) == 1
    # A compaction that dies before its snapshot is complete.
    os.makedirs(tmp_path / "journal/snapshot/000000000002")
    (tmp_path / "journal/snapshot/000000000002/part-0.parquet").write_bytes(b"PAR1")
    assert state(journal.replayed(spark, folder)) == want()
    # One that dies at each of its deletions.
    real = journal._delete
    for steps in range(5):
        left = [steps]

        def dying(*args):
            if not left[0]:
                raise OSError("lost")
            left[0] -= 1
            real(*args)

        monkeypatch.setattr(journal, "_delete", dying)
        more(10 + steps)
        try:
            journal.compact(spark, folder)
        except OSError:
            pass
        assert state(journal.replayed(spark, folder)) == want()
    monkeypatch.setattr(journal, "_delete", real)
    journal.compact(spark, folder)
    assert state(journal.replayed(spark, folder)) == want() and len(os.listdir(tmp_path / "journal/snapshot")) == 1


def test_the_entry_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}).returncode == 0
