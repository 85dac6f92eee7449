"""Measures supplied by the caller, ordered upserts, and guards of discovery and bundles."""

import random

import pyarrow as pa
import pytest

from parlance.operators import assemble as asm
from parlance.operators import measures as ms
from parlance.sources import tables as tb
from parlance.streaming import streams as sm


def test_a_failing_measure_is_an_outcome(spark):
    df = spark.createDataFrame([(k, float(v)) for k in (1, 2, 3, 4, 5, None) for v in range(3)] + [(6, float(v)) for v in range(9)], "session_id long, v double")

    def run(rows):
        k = rows.column("session_id")[0].as_py()
        if k == 2:
            raise KeyError("gone")
        out = {"top": [max(rows.column("v").to_pylist()) if k != 3 else 99.0], "kind": ["a" if k != 4 else "z"]}
        return pa.table(out if k != 5 else {"top": pa.array([], pa.float64()), "kind": pa.array([], pa.string())})

    fields = [asm.Field("top", "double", low=0, high=10), asm.Field("kind", "string", values=("a", "b"))]
    rows, outcomes = ms.measure(df, "session_id", run, fields, most_rows=8)
    assert sorted(map(tuple, rows.collect()), key=repr) == [(1, 2.0, "a"), (None, 2.0, "a")]
    got = {r.session_id: (r.status, r.n_rows, r.message) for r in outcomes.collect()}
    assert got == {
        1: ("ok", 1, None), None: ("ok", 1, None), 2: ("failed", 0, "KeyError: 'gone'"), 3: ("failed", 0, "ContractError: top high"),
        4: ("failed", 0, "ContractError: kind value"), 5: ("empty", 0, None), 6: ("failed", 0, "more than 8 rows"),
    }
    rows, outcomes = ms.measure(df.where("false"), "session_id", run, fields)
    assert rows.count() == 0 and outcomes.count() == 0


@pytest.mark.parametrize("table, message", [({"a": [1]}, "missing"), ({"a": [1], "b": ["x"], "c": [1]}, "unexpected"), ({"a": ["q"], "b": ["x"]}, "no bigint"), ({"a": [None], "b": ["x"]}, "null")])
def test_contracts(table, message):
    fields, schema = [asm.Field("a", "bigint"), asm.Field("b", "string")], pa.schema([("a", pa.int64()), ("b", pa.string())])
    with pytest.raises(ms.ContractError, match=message):
        ms.checked(pa.table(table), fields, schema)


def test_shuffled_batches_give_the_newest_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(40), s, rng.choice("xyz")) for s in rng.sample(range(1000), 300)] + [(1, 2000, "a"), (1, 2000, "b")]
    make = lambda part: spark.createDataFrame(part, "session_id int, seq long, v string")
    want = {}
    for k, s, v in rows:
        want[k] = max(want.get(k, (s, v)), (s, v))
    for turn in range(2):
        rng.shuffle(rows)
        path = f"file://{tmp_path}/t{turn}"
        run = sm.upsert_batches(path, buckets=4, order="seq")
        for n in range(3):
            run(make(rows[n::3]), n)
        once = sorted(map(tuple, sm.read_upserted(spark, path).collect()))
        run(make(rows[2::3]), 2)  # tried again
        assert sorted(map(tuple, sm.read_upserted(spark, path).collect())) == once == sorted((k, *r) for k, r in want.items())


def test_late_rows_are_counted(spark, tmp_path):
    path = f"file://{tmp_path}/late"
    run = sm.upsert_batches(path, buckets=2, order="seq", lateness=10)
    make = lambda *part: spark.createDataFrame(list(part), "session_id int, seq long")
    run(make((1, 100), (2, 5)), 0)  # nothing was before
    run(make((2, 89), (3, 90), (1, 95), (4, 120)), 1)
    for _ in range(2):
        run(make((5, 109), (5, 111), (6, None)), 2)
    assert sorted(map(tuple, sm.read_late(spark, path).collect())) == [(0, 100.0, 0), (1, 120.0, 1), (2, 120.0, 1)]
    assert sorted(map(tuple, sm.read_upserted(spark, path).collect()), key=repr) == [(1, 100), (2, 5), (3, 90), (4, 120), (5, 111), (6, None)]


def test_discovery_reports_waves_and_counts(spark):
    files = spark.createDataFrame([(f"/d/{f}/{n}.mp4",) for f, n in (("one", "s3"), ("one", "s70"), ("two", "s71"), ("two", "s5"), ("two", "s900"))], "path string")
    _, problems = tb.discover_sessions(files, {"one": "w1", "two": "w2"}, {"w1": (1, 69), "w2": (70, 99)}, 6)
    assert sorted(map(tuple, problems.collect())) == [("count_mismatch", "expected 6, found 5"), ("wave_mismatch", "5:w2:w1"), ("wave_mismatch", "70:w1:w2"), ("wave_mismatch", "900:w2:none")]
    _, problems = tb.discover_sessions(files, {"one": "w1", "two": "w2"}, expected=5)
    assert problems.count() == 0


@pytest.mark.parametrize("name", ["face__caption_count", "srt_lines", "ocr__n", "Subtitle", "speech_text", "words_spoken"])
def test_text_carrying_columns_are_refused(name):
    with pytest.raises(ValueError, match="must not leave"):
        asm.refuse_forbidden(["turn__n", name])
    asm.refuse_forbidden(["turn__n", name], pieces=("email",))
