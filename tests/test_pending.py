import random

import pandas as pd

from docloom.streaming import pending

JOBS = "event_id long, ts timestamp, path string, file_type string, priority int"


def by_hand(batches):
    """Micro-batch by micro-batch: what is done is cleared, then the first event of a path that has no pending one is a job."""
    held, out = set(), []
    for jobs, done in batches:
        held -= set(done)
        first = {}
        for job in jobs:
            order = -(1 << 63) if job[0] is None else job[0]
            if job[2] is not None and (job[2] not in first or order < first[job[2]][0]):
                first[job[2]] = (order, job)
        for path, (_, job) in first.items():
            if path not in held:
                held.add(path)
                out.append(job)
    return out


def run(spark, folder, batches):
    """Each micro-batch is written and drained by a query that starts from the checkpoint of the one before."""
    for i, (jobs, done) in enumerate(batches):
        spark.createDataFrame(jobs, JOBS).repartition(3).write.parquet(f"{folder}/jobs/part={i}")
        spark.createDataFrame([(d,) for d in done], "path string").repartition(2).write.parquet(f"{folder}/done/part={i}")
        stream = spark.readStream.schema(JOBS).parquet(f"{folder}/jobs/*")
        finished = spark.readStream.schema("path string").parquet(f"{folder}/done/*")
        pending.write_pending(pending.coalesce_state(stream, finished), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        yield {tuple(r) for r in pending.read_pending(spark, f"{folder}/out").collect()}


def test_state_over_micro_batches(spark, tmp_path):
    import datetime

    rng = random.Random(4)
    batches, event = [], 0
    for _ in range(5):
        jobs = []
        for _ in range(60):
            event += 1
            path = "/hot.md" if rng.random() < 0.4 else f"/p{rng.randint(0, 30)}.md"
            stamp = datetime.datetime(2024, 1, 1, 0, 0, event % 60, 123456)
            jobs.append((event if rng.random() < 0.97 else None, stamp, path if rng.random() < 0.98 else None, "text", rng.randint(0, 2)))
        batches.append((jobs, [f"/p{rng.randint(0, 30)}.md" for _ in range(4)] + (["/hot.md"] if rng.random() < 0.3 else [])))
    seen = None
    # A null event of a path twice in a micro-batch is settled by its text: leave one of each.
    clean = []
    for jobs, done in batches:
        nulls, kept = set(), []
        for j in jobs:
            if j[0] is None and j[2] in nulls:
                continue
            nulls |= {j[2]} if j[0] is None else set()
            kept.append(j)
        clean.append((kept, done))
    for i, seen in enumerate(run(spark, str(tmp_path), clean)):
        assert seen == set(by_hand(clean[: i + 1]))
    assert len(seen) > 31


def test_nothing_new_costs_nothing(spark, tmp_path):
    folder = str(tmp_path)
    jobs = [(1, None, "/a.md", "text", 1)]
    assert list(run(spark, folder, [(jobs, [])])) == [{(1, None, "/a.md", "text", 1)}]
    stream = spark.readStream.schema(JOBS).parquet(f"{folder}/jobs/*")
    query = pending.write_pending(pending.coalesce_state(stream, None), f"{folder}/out2", f"{folder}/checkpoint2")
    query.awaitTermination()
    again = pending.write_pending(pending.coalesce_state(stream, None), f"{folder}/out2", f"{folder}/checkpoint2")
    again.awaitTermination()
    assert len(again.recentProgress) == 0 or sum(p["numInputRows"] for p in again.recentProgress) == 0
    assert pending.read_pending(spark, f"{folder}/out2").count() == 1


class Counted(dict):
    """A state's map that counts how often it is asked."""

    calls = 0

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def test_a_call_handles_many_paths():
    """A shard's paths are handled by one call, each with two looks at the state at most; the result is that of single paths."""
    rng = random.Random(6)
    state = Counted()
    processor = pending.FirstPending()
    processor.init(type("Handle", (), {"getMapState": lambda self, *_: state})())
    held = set()
    for turn in range(6):
        marks = [(f"/p{rng.randint(0, 99)}", rng.randint(0, 9), rng.random() < 0.2, f"{i}") for i in range(200)]
        frame = pd.DataFrame(marks, columns=["path", "place", "finished", "job"])
        held -= {m[0] for m in marks if m[2]}
        first = {}
        for path, place, finished, job in marks:
            if not finished:
                first[path] = min(first.get(path, (place, job)), (place, job))
        before = state.calls
        out = list(processor.handleInputRows((0,), iter([frame[:50], frame[50:]]), None))
        expected = {path: job for path, (_, job) in first.items() if path not in held}
        assert {r.path: r.job for part in out for r in part.itertuples()} == expected and len(out) <= 1
        assert state.calls - before <= 2 * frame["path"].nunique()
        held |= set(expected)
        assert {path for path, in state} == held
