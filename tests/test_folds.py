"""Ordered folds and running briefs: routes one by one, batches against plain loops, streams against batches."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from ferrule.operators import briefs
from ferrule.streaming import folds

START = dt.datetime(2024, 1, 1)
ROWS = "f long, i long, ts timestamp"


def counting(state, row):
    n = ((state or {"n": 0})["n"] * 3 + row["i"]) % 1009
    return {"n": n}, (row["f"], row["i"], n)


def plain_fold(rows, idle=None):
    out, states = [], {}
    for f, i, ts in sorted(rows, key=lambda r: (r[2] is not None, r[2] or START, r[1])):
        at = 0 if ts is None else ts.timestamp()
        state, last = states.get(f, (None, None))
        if idle is not None and last is not None and at - last > idle:
            state = None
        state, one = counting(state, {"f": f, "i": i})
        states[f] = (state, at)
        out.append(one)
    return sorted(out, key=repr)


def minutes(*numbers):
    return [START + dt.timedelta(minutes=m) for m in numbers]


def test_fold_in_order(spark):
    random.seed(4)
    rows = [(f, i, START + dt.timedelta(minutes=random.randint(0, 40))) for f in (1, 2, 3, None) for i in range(25)]
    rows += [(5, 0, None), (5, 1, START)]
    table = spark.createDataFrame(random.sample(rows, len(rows)), ROWS).repartition(5)
    for idle in (None, 180):
        got = folds.fold(table, "f", "ts", ["i"], counting, "f long, i long, n long", idle and idle * 1000)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_fold(rows, idle)
    assert folds.fold(table.limit(0), "f", "ts", ["i"], counting, "f long, i long, n long").count() == 0


def test_a_fold_holds_the_output_of_few_rows_at_once(spark):
    """Memory of the worker from the first row to the last, while each row gives a text of 16 KB or more."""

    def step(state, row):
        with open("/proc/self/statm") as f:
            now = int(f.read().split()[1]) * 4_096
        first = (state or {"first": now})["first"]
        return {"first": first}, (row["i"], now - first, f"{row['i']:04d}" * 4_000)

    table = spark.createDataFrame([(1, i, START) for i in range(9_000)], ROWS).coalesce(1)
    got = folds.fold(table, "f", "ts", ["i"], step, "i long, grown long, text string")
    rows, most = got.selectExpr("count(length(text))", "max(grown)").head()
    assert rows == 9_000 and most < 60e6


def test_vectors_go_to_python_without_zeros(spark, small):
    from ferrule.plans import streams

    rows = briefs.encoded(streams.timed(spark, small).limit(20)).cache()
    for plain, sparse in zip(*(df.orderBy("record_id").collect() for df in (rows, briefs._sparse(rows))), strict=True):
        for c in ("vectors", "windows"):
            assert briefs._dense(sparse[c]) == plain[c] and all(0.0 not in p[1::2] for p in sparse[c])


def streamed(spark, tmp_path, batches, delay, idle=None):
    """Output and state rows after each batch of a stream whose batches come in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.02)
        stream = spark.readStream.schema(ROWS).parquet(f"file://{tmp_path}/in")
        out = folds.fold_stream(stream, "f", "ts", ["i"], counting, "f long, i long, n long", delay, idle)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        last = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] if q.recentProgress else 0
        yield sorted(map(tuple, spark.read.schema("f long, i long, n long").parquet(f"{tmp_path}/out").collect()), key=repr), last


def test_late_rows_over_several_batches_give_the_batch_result(spark, tmp_path):
    rows = [(f, i, START + dt.timedelta(minutes=i)) for f in (1, 2) for i in range(12)]
    batches = [[r for r in rows if r[1] % 3 == k] for k in (2, 0, 1)]
    *_, (got, held) = streamed(spark, tmp_path, [*batches, [(9, 0, START + dt.timedelta(days=2))]], "1 hour")
    assert got == plain_fold(rows) and held > 0


def test_a_key_has_one_timer_a_batch():
    """Twelve rows of a key over three batches wait with three timers at most, and none is left over."""
    class Handle:
        def __init__(self):
            self.timers = []

        def getValueState(self, name, schema):
            return Value()

        def getListState(self, name, schema):
            return Rows()

        def registerTimer(self, at):
            self.timers.append(at)

    class Value:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, v):
            self.value = v

    class Rows:
        def __init__(self):
            self.rows = []

        def appendList(self, rows):
            self.rows += rows

        def put(self, rows):
            self.rows = list(rows)

        def get(self):
            return iter(self.rows)

        def clear(self):
            self.rows = []

    class Clock:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    handle, fold = Handle(), folds.Ordered(counting, ["f", "i", "n"], ["i"], None)
    fold.init(handle)
    rows = [(i, f'{{"f": 1, "i": {i}}}') for i in range(12)]
    for k in (2, 0, 1):
        list(fold.handleInputRows((1,), iter([folds.pd.DataFrame([r for r in rows if r[0] % 3 == k], columns=["at_", "row_"])]), None))
    assert sorted(handle.timers) == [0, 1, 2]
    first = [tuple(r) for df in fold.handleExpiredTimer((1,), Clock(6), None) for r in df.itertuples(index=False)]
    assert handle.timers[3:] == [7] and list(fold.handleExpiredTimer((1,), Clock(6), None)) == []
    rest = [tuple(r) for df in fold.handleExpiredTimer((1,), Clock(99), None) for r in df.itertuples(index=False)]
    assert sorted([*first, *rest], key=repr) == plain_fold([(1, i, START) for i in range(12)])


def test_rows_beyond_the_delay_are_dropped_and_idle_state_goes(spark, tmp_path):
    """A stream of ever new files: state holds the files of the idle time only, and a file that comes back starts anew."""
    day = dt.timedelta(days=1)
    batches = [[(f, 0, START + f * day), (f, 1, START + f * day)] for f in range(5)]
    sizes, outs = [], []
    for got, held in streamed(spark, tmp_path, [*batches, [(4, 7, START)], [(0, 5, START + 9 * day)], [(99, 0, START + 30 * day)]], "1 hour", 3_600_000):
        outs.append(got)
        sizes.append(held)
    assert max(sizes) <= 6  # a row or two and the timers of the newest file or two, not of all
    want = plain_fold([r for b in batches for r in b] + [(0, 5, START + 9 * day)], 3_600)
    assert outs[-1] == want and (0, 5, 5) in want and not [r for r in outs[-1] if r[1] == 7]


# ---- briefs


def record(i, windows, tag="Green", sentences=None):
    sentences = sentences if sentences is not None else [f"sentence {i}."] if windows else []
    return {"file_id": 1, "record_id": f"r{i}", "tag": tag, "sentences": sentences, "vectors": [windows[0]] * len(sentences) if windows else [], "windows": windows}


def walk(rows, state=None, **given):
    out = []
    for r in rows:
        state, made = briefs.brief_step(least=0.5, **given)(state, r)
        out.append(dict(zip("file_id record_id route title brief contributors n_vectors centre brief_mean pending_mean pending_id".split(), made, strict=True)))
    return out


X, Y, Z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]


def test_each_route():
    made = walk([record(0, [X, X]), record(1, [X]), record(2, [Y]), record(3, [Z]), record(4, [Z, Z]), record(5, [])])
    assert [m["route"].split("_")[0] for m in made] == ["init", "activebrief", "skip", "skip", "pending", "skip"]
    assert [m["contributors"] for m in made] == [["r0"], ["r0", "r1"], ["r0", "r1"], ["r0", "r1"], ["r0", "r1", "r3", "r4"], ["r0", "r1", "r3", "r4"]]
    assert [m["pending_id"] for m in made] == ["", "", "r2", "r3", "", "r5"]
    assert made[1]["centre"] == X and made[4]["centre"] == [0.5, 0.0, 0.5] and made[4]["pending_mean"] == 1.0 and made[2]["brief_mean"] == 0.0
    assert made[5]["route"] == "skip_no_qa_vectors" and made[5]["brief"] == made[4]["brief"]


def test_nothing_to_start_from():
    made = walk([record(0, []), record(1, [X])])
    assert [m["route"] for m in made] == ["init_no_previous_activebrief"] * 2 and made[0]["brief"] == "" and made[0]["centre"] is None
    bare = {"brief": {"title": "t", "sentences": [["kept.", X]], "total": None, "n": 0, "ids": ["old"]}, "pending": None}
    assert walk([record(1, [X])], bare)[0]["route"] == "activebrief_safe_pass"
    assert walk([record(1, [X])], bare)[0]["pending_id"] == "r1"


def test_black_records_are_not_carried_on():
    made = walk([record(0, [X]), record(1, [X], "Black"), record(2, [X]), record(3, [Y], "Black"), record(4, [Y]), record(5, [X])])
    assert made[1]["contributors"] == ["r0", "r1"] and made[2]["contributors"] == ["r0", "r2"]
    assert made[4]["route"] == "pending_topic_shift" and made[4]["contributors"] == ["r0", "r2", "r3", "r4"]
    assert made[5]["contributors"] == ["r0", "r2", "r5"]
    assert walk([record(0, [X], "Black"), record(1, [X])])[1]["route"] == "init_no_previous_activebrief"


def test_without_a_gate_all_records_count():
    made = walk([record(0, [X]), record(1, [Y]), record(2, [])], gated=False)
    assert [m["route"] for m in made][1:] == ["gate_disabled"] * 2 and made[2]["contributors"] == ["r0", "r1", "r2"]


def test_sentences_kept():
    listed = [("about x.", X), ("x again.", X), ("of y entirely.", Y), ("x and y.", [1.0, 1.0, 0.0]), ("z", Z)]
    centre = np.array([3.0, 1.0, 0.0])
    kept, title = briefs.kept_sentences(listed, centre, 1000)
    assert [s for s, _ in kept] == ["about x.", "of y entirely.", "x and y.", "z"] and title == "about x."
    kept, _ = briefs.kept_sentences(listed, centre, 3, tokens=lambda s: len(s.split()))
    assert [s for s, _ in kept] == ["about x.", "z"]  # one that doesn't fit is skipped, a later one may
    assert [s for s, _ in briefs.kept_sentences(listed, centre, 0)[0]] == ["about x."] and briefs.kept_sentences([], centre, 9) == ([], "")


def test_a_batch_is_the_loop_and_a_stream_the_batch(spark, tmp_path, small):
    from ferrule.plans import streams

    rows = streams.timed(spark, small).where("file_id < 12").cache()
    step = briefs.brief_step(0.7, budget=60)
    want, state, now = [], None, None
    for r in sorted(briefs.encoded(rows).collect(), key=lambda r: (r.file_id, r.ordinal)):
        state = state if r.file_id == now else None
        now = r.file_id
        state, one = step(state, r.asDict())
        want.append(one)
    plain = lambda rs: sorted((tuple(np.round(x, 9).tolist() if isinstance(x, float | list) and x and isinstance(x if isinstance(x, float) else x[0], float) else x for x in r) for r in rs), key=repr)
    batch = briefs.running_briefs(rows.repartition(6), "at", step)
    assert plain(map(tuple, batch.collect())) == plain(want) and len(want) > 20
    assert len({r[2] for r in want}) >= 3 and any(len(r[4]) > 0 for r in want)
    stream = streams.in_batches(rows, 3, rows["ordinal"])
    got = streams.run_to_end(briefs.brief_stream(stream, "at", "30 days", step)).where("file_id IS NOT NULL")
    assert plain(map(tuple, got.collect())) == plain(want)


@pytest.mark.parametrize("score", [0.3, 0.25])
def test_pending_step(score):
    step, state, out = briefs.pending_step(), None, []
    for i, s in enumerate((0.1, 0.2, 0.0, score, 0.0)):
        state, one = step(state, {"file_id": 1, "record_id": str(i), "brief_score": s})
        out.append((one[2].split("_")[0], one[3]))
    assert out == [("skip", "0"), ("pending", ""), ("skip", "2"), ("activebrief", ""), ("skip", "4")]
