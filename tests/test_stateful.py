"""Stateful streams against plain folds, over several micro-batches and a restart."""

import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparkloom.streaming import stateful

HORIZON = timedelta(days=2)
START = datetime(2024, 1, 1)


def made_up(n=160, users=8):
    """Events in order of time; users pause for days, and the last stays away."""
    rows, at = [], START
    for i in range(n):
        at += timedelta(minutes=37 + 211 * (i % 3))
        user = (i * 7 + i // 11) % users
        if user != users - 1 or i < 20:
            rows.append((i, at, user, f"type{(i // users + user) % 3}"))
    return [*rows, (n, at, None, "type0"), (n + 1, None, 1, "type1")]


def plain_memory(rows):
    newest = max(r[1] for r in rows if r[1] is not None)
    found = {}
    for _, at, user, other in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: r[1]):
        known = found.get(user)
        if known is None or at > known["last"] + HORIZON:
            known = found[user] = {"n": 0, "others": set(), "first": at}
        known["n"] += 1
        known["others"].add(other)
        known["last"] = at
    return {str(u): (k["n"], len(k["others"]), k["first"], k["last"]) for u, k in found.items() if k["last"] >= newest - HORIZON}


def files_of(spark, rows, path, parts):
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        frame = spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1)
        frame.write.parquet(f"{path}-{i}")


def moved(path, i, target):
    target.mkdir(exist_ok=True)
    for file in (path.parent / f"{path.name}-{i}").glob("*.parquet"):
        shutil.copy(file, target / f"part-{i}.parquet")


def memory(spark, table, folder):
    stream = stateful.remembered(stateful.file_stream(spark, str(table)), "user_id", "ts", "event_type", HORIZON, "1 hour")
    return stateful.drained(stream, "memory", "update", str(folder))


def test_memory_over_batches_and_a_restart(spark, tmp_path):
    rows, made, table, folder = made_up(), tmp_path / "made", tmp_path / "events.parquet", tmp_path / "run"
    files_of(spark, rows, str(made), 4)
    for i in (0, 1):
        moved(made, i, table)
    first = memory(spark, table, folder)
    batches = first.agg(F.max("batch")).first()[0]
    half = [r for r in rows[: 2 * len(rows) // 4]]
    newest = lambda some: spark.createDataFrame([(max(r[1] for r in some if r[1]),)], "newest timestamp")
    told = lambda changes, some: {r["author"]: (r["n"], r["deg"], r["first"], r["last"]) for r in stateful.memory_now(changes, newest(some), HORIZON).collect()}
    assert told(first, half) == plain_memory(half)
    for i in (2, 3):
        moved(made, i, table)
    again = memory(spark, table, folder)  # goes on from its checkpoint
    assert again.agg(F.max("batch")).first()[0] > batches
    assert told(again, rows) == plain_memory(rows)
    assert "7" not in plain_memory(rows)
    gone = again.where("author = '7'").orderBy(F.desc("batch")).first()
    assert gone["known"] is False  # by its timer, without another event
    repeated = memory(spark, table, folder)
    assert told(repeated, rows) == plain_memory(rows)


def test_answers_within_a_range(spark, tmp_path):
    rows, made, table = made_up(120, 4), tmp_path / "made", tmp_path / "events.parquet"
    rows = [r for r in rows if r[1] is not None]
    files_of(spark, rows, str(made), 3)
    for i in range(3):
        moved(made, i, table)

    def of(kind):
        return stateful.file_stream(spark, str(table)).where(F.col("event_type") == kind).select("event_id", "user_id", "ts")

    joined = stateful.answered(of("type0"), of("type1"), "user_id", "ts", "20 HOURS", "1 hour")
    found = {(r["event_id"], r["answer_event_id"]) for r in stateful.drained(joined.select("event_id", "answer_event_id"), "answers", "append").collect()}
    asked, answers = ([r for r in rows if r[3] == k] for k in ("type0", "type1"))
    mark = min(max(r[1] for r in side) for side in (asked, answers)) - timedelta(hours=1)
    expected = set()
    for a in asked:
        own = {(a[0], b[0]) for b in answers if a[2] is not None and a[2] == b[2] and a[1] <= b[1] <= a[1] + timedelta(hours=20)}
        expected |= own or ({(a[0], None)} if a[1] + timedelta(hours=20) < mark else set())
    assert found == expected and any(b is None for _, b in found) and any(b is not None for _, b in found)


def test_the_store_is_told_whom_an_author_met_once_a_batch():
    import pandas as pd

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Others:
        def __init__(self):
            self.held, self.calls = {}, 0

        def keys(self):
            self.calls += 1
            return iter(list(self.held))

        def containsKey(self, key):  # noqa: N802
            self.calls += 1
            return key in self.held

        def updateValue(self, key, value):  # noqa: N802
            self.calls += 1
            self.held[key] = value

        def clear(self):
            self.calls += 1
            self.held = {}

    class Handle:
        def registerTimer(self, moment):  # noqa: N802
            return None

        deleteTimer = registerTimer  # noqa: N815

    memory = stateful.Memory(timedelta(days=2))
    memory.record, memory.others, memory.handle = Value(), Others(), Handle()

    def given(start, hours, names):
        moments = [pd.Timestamp(start) + pd.Timedelta(hours=h) for h in hours]
        return next(memory.handleInputRows(("a",), iter([pd.DataFrame({"moment": moments, "other": names})]), None)).iloc[0]

    first = given("2024-01-01", range(100), ["x", "y"] * 50)
    assert (first["n"], first["deg"]) == (100, 2) and memory.others.calls <= 3
    second = given("2024-01-05 04:00", [0, 1, 2], ["y", "z", None])
    assert (second["n"], second["deg"]) == (103, 3) and set(memory.others.held) == {("x",), ("y",), ("z",)}
    third = given("2024-01-20", [0, 1, 72], ["x", "q", "w"])  # two gaps: all before are forgotten
    assert (third["n"], third["deg"]) == (1, 1) and set(memory.others.held) == {("w",)}
