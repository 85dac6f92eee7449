"""What is refused, and what is let through."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import assemble as am
from parlance.operators import stats as st
from parlance.sources import tables as tb


def test_role_tables(spark):
    make = lambda rows, columns="session_id string, speaker string, role string": spark.createDataFrame(rows, columns)
    assert [tuple(r) for r in tb.role_table(make([("7", " S1 ", "subject ")])).collect()] == [(7, "S1", "subject")]
    for rows in ([("7", "S1", "doctor")], [("7", "S1", None)], [("x", "S1", "subject")], [("7", "S1", "subject"), ("7", "S1", "partner")]):
        with pytest.raises(ValueError):
            tb.role_table(make(rows))
    with pytest.raises(ValueError, match="role"):
        tb.role_table(make([("7", "S1")], "session_id string, speaker string"))


def test_exemptions_hold_by_ending(spark):
    names = ["Mood_score", "text__mood_score", "mood score 2", "other_target"]
    assert am.label_like(names) == names
    assert am.label_like(names, exempt=["Mood_score"]) == ["mood score 2", "other_target"]
    assert am.label_like(["similarity score"]) == [] and am.label_like(["similarity score"], harmless=()) == ["similarity score"]
    assert am.label_like(["mood"], words=("mood",)) == ["mood"]
    df = spark.createDataFrame([(1, 2.0)], "File_ID long, mood_score double")
    with pytest.raises(ValueError, match="mood_score"):
        tb.text_feature_table(df)
    assert tb.text_feature_table(df, exempt=["mood_score"]).columns == ["session_id", "text__mood_score"]


def test_foreign_tables_are_refused(spark):
    new = spark.createDataFrame([(1, 2.0, "x")], "session_id long, a double, extra string")
    foreign = spark.createDataFrame([("k", 1.0)], "name string, a double")
    with pytest.raises(ValueError, match="session_id"):
        am.upsert(foreign, new)
    assert am.upsert(foreign, new, force=True).count() == 1
    old = spark.createDataFrame([(1, 1.0), (2, 5.0), (None, 9.0)], "session_id long, a double")
    assert sorted(map(tuple, am.upsert(old, new).collect())) == [(1, 2.0, "x"), (2, 5.0, None)]
    assert [tuple(r) for r in am.new_columns(old.where("session_id > 0"), new).collect()] == [("extra", 1)]
    selected = spark.createDataFrame([(1,)], "session_id long")
    measured = spark.createDataFrame([(1, 1.0, "")], "session_id long, a double, flags string")
    failures = spark.createDataFrame([], "session_id long, reason string")
    contract = [am.Field("session_id", "bigint"), am.Field("a", "double", low=0)]
    kept = spark.createDataFrame([(5, 3.0, "f")], "session_id long, a double, flags string")
    assert am.keep_all_rows(selected, measured, failures, kept, contract).count() == 2
    for bad in (foreign, kept.withColumn("a", -F.col("a"))):
        with pytest.raises(ValueError, match="not ours"):
            am.keep_all_rows(selected, measured, failures, bad, contract)
        assert am.keep_all_rows(selected, measured, failures, bad, contract, force=True).count() == 1


def test_files_of_other_sessions_and_without_times(spark):
    one = spark.createDataFrame([(1,), (2,)], "session_id long")
    every = spark.createDataFrame([(i,) for i in range(1, 5)], "session_id long")
    files = spark.createDataFrame([("1.srt",), ("1_final.rttm",), ("3.srt",), ("x.TXT",), ("y.srt",)], "name string")
    patterns = ["{session_id}_final.rttm", "{session_id}.srt"]
    got = lambda known: sorted(tuple(map(str, r)) for r in tb.match_files(one, files, patterns, known).collect())
    rest = [("None", "1.srt", "unmatched"), ("None", "x.TXT", "timeless"), ("None", "y.srt", "unmatched")]
    assert got(every) == sorted([("1", "1_final.rttm", "matched"), ("2", "None", "missing"), *rest])
    assert got(None) == sorted([("1", "1_final.rttm", "matched"), ("2", "None", "missing"), ("None", "3.srt", "unmatched"), *rest])


def test_bundles_are_checked_before_anything_is_written(spark, tmp_path):
    ok = spark.createDataFrame([(1, 2.0)], "session_id long, turn__n double")
    for name in ("text__transcript", "turn__score"):
        with pytest.raises(ValueError):
            tb.write_bundle({"features": ok, "text": ok.withColumn(name, F.lit(1.0))}, f"{tmp_path}/b")
    with pytest.raises(ValueError, match="more than"):
        tb.write_bundle({"features": ok}, f"{tmp_path}/b", budget=0)
    assert not list(tmp_path.iterdir())
    notes = spark.createDataFrame([(1, "the microphone was off")], "session_id long, reason string")
    assert tb.write_bundle({"manifest": tb.manifest(ok, ["turn"], seeds=[1], backend="x"), "features": ok, "notes": notes}, f"{tmp_path}/b") == ["features", "notes", "manifest"]
    assert [p.name for p in tmp_path.iterdir()] == ["b"]
    assert "backend" in spark.read.parquet(f"{tmp_path}/b/manifest").first()[0]
    with pytest.raises(ValueError, match="already"):
        tb.write_bundle({"features": ok}, f"{tmp_path}/b")
    tb.write_bundle({"features": ok}, f"{tmp_path}/b", force=True)
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.is_dir()) == ["features"]


def test_tables_in_two_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b")], "session_id long, v string")
    for name in ("t.csv", "t.parquet"):
        tb.write_table(df, f"{tmp_path}/{name}")
        assert [tuple(map(str, r)) for r in tb.read_table(spark, f"{tmp_path}/{name}").collect()] == [("1", "a b")]
        with pytest.raises(Exception):  # noqa: B017 - Spark's own error
            tb.write_table(df, f"{tmp_path}/{name}")
    digests = tb.file_digests(spark, f"{tmp_path}/t.csv").collect()
    assert digests and all(len(r.sha256) == 64 for r in digests)


def test_notes_and_single_sources(spark):
    notes = spark.createDataFrame([(2, 1, "audio", "note", "the  microphone was off all day"), (3, 1, "audio", "available", "x")], "line int, session_id int, modality string, status string, reason string")
    assert sorted(map(tuple, tb.check_notes(notes).collect())) == [(3, "reason"), (3, "repeated"), (3, "status")]
    df = spark.createDataFrame([(1, "x"), (1, "y")], "k int, backend string")
    with pytest.raises(ValueError, match="1"):
        am.require_single_source(df, ["k"], "backend")
    assert am.require_single_source(df.limit(1), ["k"], "backend").count() == 1


def test_text_joins_and_empty_cohorts(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "session_id long, x double")
    b = spark.createDataFrame([(2, 5.0)], "session_id long, text__y double")
    assert sorted(map(tuple, am.join_text(a, b).collect())) == [(1, 1.0, None), (2, 2.0, 5.0)]
    for bad in (b.union(b), b.withColumnRenamed("text__y", "x")):
        with pytest.raises(ValueError):
            am.join_text(a, bad)
    assert [r.session_id for r in am.modelled_cohort(a, b).collect()] == [2]
    with pytest.raises(ValueError):
        am.modelled_cohort(a, b.limit(0))


def test_typed_tables(spark):
    fields = [am.Field("session_id", "bigint"), am.Field("v", "double", nullable=True)]
    assert am.empty_table(spark, fields).dtypes == [("session_id", "bigint"), ("v", "double")]
    out = am.typed(spark.createDataFrame([("3", "x"), ("1", "y")], "session_id string, other string"), fields, ["session_id"])
    assert [tuple(r) for r in out.collect()] == [(1, None), (3, None)] and out.dtypes == am.empty_table(spark, fields).dtypes


def test_flags_of_text_roles_and_overlap(spark):
    seg = spark.createDataFrame([(1, "a", 0, 5, "hi"), (1, "b", 4, 9, ""), (2, "a", 0, 9, None), (2, "b", 0, 1, "")], "session_id long, speaker string, start long, end long, text string")
    d = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "session_id long, duration long")
    got = {r.session_id: (r.has_text, "no_text" in r.flags) for r in st.diarization_qc(seg, d, text="text").collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, True)}
    spans = spark.createDataFrame([(1, 30.0, False, 3, 100.0), (2, 30.0, False, 3, 100.0)], "session_id long, duration double, failed boolean, n_voiced long, reference double")
    sources = spark.createDataFrame([(1, "manual"), (2, "assigned")], "session_id long, source string")
    assert {r.session_id: r.flags for r in st.prosody_qc(spans, 20, sources).collect()} == {1: "manual_roles", 2: ""}
    roles = seg.withColumn("role", F.when(F.col("speaker") == "a", "subject").otherwise("partner"))
    assert {r.session_id: r.excluded for r in am.excluded_overlap(roles).collect()} == {1: 1, 2: 1}


def test_outliers_of_a_whole_table(spark):
    v = [1.0, 2.0, 3.0, 2.5, 100.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    assert {r.i: r.outlier for r in st.robust_outliers(df, "v", 5).collect()} == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False}
