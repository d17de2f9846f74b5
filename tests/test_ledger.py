"""The ledger of calls: what is answered is not called again, also after a crash."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ledger


def prompts(spark, n, texts="text of {}"):
    return spark.createDataFrame([("EC2", f"i-{i}", texts.format(i)) for i in range(n)], "resource_type string, resource_id string, text string")


def counting(folder, then):
    """An analysis that leaves a file for each call and goes on with ``then``."""

    def fn(text):
        import uuid

        open(os.path.join(folder, f"{text.replace(' ', '_')}-{uuid.uuid4().hex}"), "w").close()
        return then(text)

    return fn


def calls(folder):
    found = {}
    for name in os.listdir(folder):
        key = name.rsplit("-", 1)[0]
        found[key] = found.get(key, 0) + 1
    return found


def outcomes(df):
    return {r.resource_id: (r.response, r.attempts, r.failed_attempts, r.error) for r in df.collect()}


def test_a_second_run_calls_only_what_is_new(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.mkdir(folder)
    first = outcomes(ledger.answer(prompts(spark, 20), counting(folder, lambda t: f"1: {t}"), path, parallel_calls=2))
    assert first["i-3"] == ("1: text of 3", 1, 0, None) and set(calls(folder).values()) == {1}
    both = prompts(spark, 25).union(prompts(spark, 2, "changed {}")).union(prompts(spark, 25))
    second = ledger.answer(both, counting(folder, lambda t: f"2: {t}"), path, parallel_calls=2)
    got = sorted((r.resource_id, r.response, r.attempts) for r in second.collect())
    assert len(got) == 27 and ("i-0", "1: text of 0", 0) in got and ("i-0", "2: changed 0", 1) in got and ("i-24", "2: text of 24", 1) in got
    assert set(calls(folder).values()) == {1} and len(calls(folder)) == 27


def test_failures_are_repeated_in_rounds_and_kept(spark, tmp_path):
    folder, waits = str(tmp_path / "calls"), []
    os.mkdir(folder)

    def flaky(text):
        number = int(text.rsplit(" ", 1)[1])
        tries = sum(n.startswith(text.replace(" ", "_") + "-") for n in os.listdir(folder))
        if number % 3 == 0 or (number % 3 == 1 and tries < 2):
            raise RuntimeError("busy" if number else "")
        return "ok"

    path = str(tmp_path / "ledger")
    got = outcomes(ledger.answer(prompts(spark, 9), counting(folder, flaky), path, run_key="a", max_attempts=3, parallel_calls=2, sleep=waits.append))
    assert waits == [5, 10]
    assert got["i-2"] == ("ok", 1, 0, None) and got["i-1"] == ("ok", 2, 1, None) and got["i-3"] == (None, 3, 3, "busy") and got["i-0"][3] == "RuntimeError"
    assert ledger.read_ledger(spark, path).count() == 3 * 1 + 3 * 2 + 3 * 3
    # Under the same key nothing is left to try; a new run tries the failures again.
    assert outcomes(ledger.answer(prompts(spark, 9), flaky, path, run_key="a", max_attempts=3, sleep=waits.append)) == got
    again = outcomes(ledger.answer(prompts(spark, 9), lambda t: "late", path, run_key="b", max_attempts=3))
    assert again["i-3"] == ("late", 1, 0, None) and again["i-2"] == ("ok", 0, 0, None)


def test_a_killed_run_goes_on_behind_its_last_chunk(spark, tmp_path):
    folder, path, fuse = str(tmp_path / "calls"), str(tmp_path / "ledger"), str(tmp_path / "fuse")
    os.mkdir(folder)
    open(fuse, "w").close()

    def deadly(text):
        if os.path.exists(fuse) and len(os.listdir(folder)) > 25:
            os._exit(1)
        return "done"

    rows = prompts(spark, 60)
    with pytest.raises(Exception):
        ledger.answer(rows, counting(folder, deadly), path, run_key="k", parallel_calls=2, task_calls=3).collect()
    answered = {r.resource_id for r in ledger.read_ledger(spark, path).collect()}
    before = calls(folder)
    assert 0 < len(answered) < 60
    os.remove(fuse)
    got = outcomes(ledger.answer(rows, counting(folder, deadly), path, run_key="k", parallel_calls=2, task_calls=3))
    after = calls(folder)
    assert len(got) == 60 and {x[0] for x in got.values()} == {"done"}
    for i in answered:
        key = f"text_of_{i[2:]}"
        assert after[key] == before[key] == 1
    # Only calls of the chunk that was lost are made twice.
    assert sum(after.values()) - 60 == sum(n for k, n in before.items() if f"i-{k.rsplit('_', 1)[1]}" not in answered) <= 2 * 10


def test_the_ledger_counts_per_run(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.answer(prompts(spark, 4), lambda t: "x", path, run_key="a")
    ledger.answer(prompts(spark, 6), lambda t: "y", path, run_key="b")
    rows = ledger.read_ledger(spark, path).groupBy("run_key").agg(F.count("*").alias("n")).collect()
    assert {r.run_key: r.n for r in rows} == {"a": 4, "b": 2}
    empty = ledger.answer(prompts(spark, 3).limit(0), lambda t: "z", path)
    assert empty.count() == 0 and ledger.read_ledger(spark, path).count() == 6


def test_quick_calls_take_few_jobs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = prompts(spark, 200)
    assert ledger.answer(rows, lambda t: "x", path, parallel_calls=2, task_calls=2).where("response = 'x' AND attempts = 1").count() == 200
    # A file is a task's answers: chunk by chunk there would be a hundred.
    assert len([n for n in os.listdir(path) if n.endswith(".parquet")]) <= 20


def test_chunks_grow_while_calls_are_quick(monkeypatch):
    monkeypatch.setattr(ledger, "CHUNK_SECONDS", 10.0)
    assert [ledger._next_size(4, s) for s in (1, 9.9, 15, 20, 40, 1000)] == [8, 8, 4, 4, 2, 1]
