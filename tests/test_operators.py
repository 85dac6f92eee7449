"""Statistics, sources, assembly, roles and evaluation on small cases."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import columns as fn
from parlance.operators import assemble as am
from parlance.operators import evaluate as ev
from parlance.operators import roles as ro
from parlance.operators import stats as st
from parlance.plans import registry
from parlance.sources import tables as tb
from parlance.sources import transcripts as tr
from parlance.streaming import streams as sm


def test_statistics_ignore_nan_and_need_two(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 10.0), (1, float("nan")), (2, 3.0)], "k int, v double")
    r = {x.k: x for x in st.percentiles(df, ["k"], "v").collect()}
    assert r[1].p90 == pytest.approx(8.2) and r[1].median == 3 and r[2].iqr is None


def test_peaks_keep_the_louder_and_move_the_anchor(spark):
    df = spark.createDataFrame([(1, p, v) for p, v in ((0, 5.0), (2, 6.0), (4, 5.5), (6, 1.0))], "k int, place int, v double")
    assert st.count_peaks(df, ["k"], "v", 3).collect()[0].n_peaks == 2


def test_outliers_with_no_median_deviation(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(8)] + [(9, 50.0)], "session_id int, duration double")
    assert [r.session_id for r in st.robust_outliers(df, "duration", 3.0).where("outlier").collect()] == [9]
    same = spark.createDataFrame([(i, 1.0) for i in range(3)], "session_id int, duration double")
    assert st.robust_outliers(same, "duration", 3.0).where("outlier").count() == 0


def test_duration_flags_mark_known_only_if_flagged(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 100.0), (3, 100.0), (4, 101.0)], "session_id int, duration double")
    got = {r.session_id: r.flags for r in st.duration_flags(df, 50, 200, 1e9, [1, 2]).collect()}
    assert got == {1: "short;known", 2: "", 3: "", 4: ""}


def test_labels_fold_compatibility_forms(spark):
    df = spark.createDataFrame([("ＡＢＣ－1",), ("Straße!",), (None,)], "t string")
    assert [r[0] for r in df.select(fn.normalise_label(F.col("t"))).collect()] == ["abc 1", "strasse", None]


def test_pose_is_null_near_the_lock(spark):
    df = spark.createDataFrame([(0.0, 0.0, -1.0), (1.0, 0.0, 0.0)], "a double, b double, s double")
    one = [[F.col("a"), F.lit(0.0), F.lit(0.0)], [F.col("b"), F.lit(1.0), F.lit(0.0)], [F.col("s"), F.lit(0.0), F.lit(1.0)]]
    assert [r.head_yaw for r in df.select(*[c.alias(n) for n, c in fn.head_pose(one).items()]).collect()] == [None, 0.0]


def test_subtitles(spark):
    text = "﻿1\r\n00:00:01,500 --> 00:00:02,000\r\nhello\r\n\r\n2\r\n01:02.5 --> 01:04.0 align:left\r\n[Speaker 3]： hi\r\nthere\r\n\r\n00:01:05,000 --> bad\r\nx\r\n\r\n4\r\n00:02:00,000 --> 00:02:03,000\r\nmore"
    cues = tr.parse_cues(spark.createDataFrame([("f", text)], "file string, text string"))
    assert [(r.start_s, r.end_s) for r in cues.orderBy("pos").collect()] == [(1.5, 2.0), (62.5, 64.0), (65.0, None), (120.0, 123.0)]
    got = [(r.speaker, r.start_s, r.text) for r in tr.fill_speakers(cues).orderBy("pos").collect()]
    assert got == [("SPEAKER_03", 62.5, "hi\nthere"), ("SPEAKER_03", 120.0, "more")]
    assert tr.unnamed(cues).count() == 0


def test_segments_from_files(spark, tmp_path):
    (tmp_path / "1.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nSpeaker 1: a\n")
    (tmp_path / "2.rttm").write_text("SPEAKER 2 1 0.5 1.0 <NA> <NA> spk0 <NA>\nSPEAKER 2 1 3.0 0.0 <NA> <NA> spk0 <NA>\n")
    got = tr.read_segments(spark, str(tmp_path)).collect()
    assert sorted((r.speaker, r.start_s, r.end_s) for r in got) == [("SPEAKER_01", 1.0, 2.0), ("spk0", 0.5, 1.5)]
    (tmp_path / "3.txt").write_text("x")
    with pytest.raises(ValueError, match="no times"):
        tr.read_segments(spark, str(tmp_path))


def test_rttm_lines_are_split_once(spark, plan):
    lines = ["SPEAKER 2 1 0.5 1.0 <NA> <NA> spk0 <NA>", " \tSPEAKER", "SPEAKER\t2  1 \t0.5 2 <NA> <NA> spk1", "\t", "", "  ", None, "LEXEME 2 1 0 1 a b c", "SPEAKER 2 1 x 1 a b c", "SPEAKER 2 1 0 x a b c", "SPEAKER 2 1 0 -1 a b c"]
    df = spark.createDataFrame([("f", x) for x in lines], "file string, line string")
    got = sorted(((r.speaker, r.start_s, r.end_s, r.error) for r in tr.parse_rttm(df).collect()), key=repr)
    assert got == sorted([("spk0", 0.5, 1.5, None), ("spk1", 0.5, 2.5, None), ("c", None, None, None), *[(None, None, None, "too few fields")] * 2], key=repr)
    made = df.select("file", F.format_string("%s", "line").alias("line"))
    assert plan(tr.parse_rttm(made)).count("format_string(") == 1 and plan(tr.parse_rttm(made)).count("split(") == 1


def test_labels_are_refused_when_ids_repeat(spark):
    ok = tb.label_table(spark.createDataFrame([("1", "2.5"), ("2", "x")], "ID string, k string"))
    assert {r.session_id: r.k for r in ok.collect()} == {1: 2.5, 2: None}
    for rows in ([("1", "2"), ("1", "3")], [("a", "2")]):
        with pytest.raises(ValueError):
            tb.label_table(spark.createDataFrame(rows, "session string, k string"))


def test_notes_are_refused_as_a_whole(spark):
    good = [(2, 1, "audio", "unavailable", "the  microphone was off all day")]
    schema = "line int, session_id int, modality string, status string, reason string"
    assert tb.read_notes(spark.createDataFrame(good, schema)).collect()[0].reason == "the microphone was off all day"
    with pytest.raises(ValueError, match="line 3 reason"):
        tb.read_notes(spark.createDataFrame([*good, (3, 1, "video", "degraded", "short")], schema))


def test_text_features_refuse_labels(spark):
    with pytest.raises(ValueError, match="look like labels"):
        tb.text_feature_table(spark.createDataFrame([(1, 2.0)], "id int, `Quality Score` double"))
    assert tb.text_feature_table(spark.createDataFrame([("1", "2")], "id string, `text__A-b` string")).columns == ["session_id", "text__a_b"]


def test_bundle_is_not_overwritten(spark, tmp_path):
    df = spark.range(2)
    assert tb.write_bundle({"manifest": df, "a": df}, str(tmp_path / "b")) == ["a", "manifest"]
    with pytest.raises(Exception, match="there already"):
        tb.write_bundle({"a": df}, str(tmp_path / "b"))


def test_upsert_keeps_foreign_sessions_and_new_columns(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "session_id int, a double")
    new = spark.createDataFrame([(2, 5.0, "x")], "session_id int, a double, b string")
    assert sorted((r.session_id, r.a, r.b) for r in am.upsert(old, new).collect()) == [(1, 1.0, None), (2, 5.0, "x")]


def test_positional_join_refuses_other_counts(spark):
    t = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ordinal long, v string")
    got = am.positional_join(t, spark.createDataFrame([("10",), ("9",), ("100",)], "session_id string"), "ordinal")
    assert {r.session_id: r.v for r in got.collect()} == {9: "a", 10: "b", 100: "c"}
    with pytest.raises(ValueError):
        am.positional_join(t, spark.createDataFrame([("1",), ("1",), ("2",)], "session_id string"), "ordinal")


def test_roles_need_two_speakers(spark):
    speech = spark.createDataFrame([(1, "a", 9.0, 9.0), (2, "a", 5.0, 9.0), (2, "b", 7.0, 9.0), (2, "c", 8.0, 0.0)], "session_id int, speaker string, speech double, embedded double")
    scores = spark.createDataFrame([(2, "a", "r", 0.9), (2, "b", "r", 0.88)], "session_id int, speaker string, reference string, similarity double")
    got = {(r.session_id, r.speaker): (r.role, r.flags) for r in ro.decide_roles(speech, scores, 3, 0.05).collect()}
    assert got[1, "a"] == ("unknown", "unassigned") and got[2, "a"] == ("partner", "small_margin")
    assert got[2, "b"][0] == "subject" and got[2, "c"][0] == "unknown"


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "t string, p_value double")
    got = {r.t: r.p_holm for r in ev.holm(df).collect()}
    assert got == {"a": pytest.approx(0.03), "c": pytest.approx(0.06), "b": pytest.approx(0.06), "d": None}
    with pytest.raises(ValueError):
        ev.holm(df.withColumn("p_value", F.lit(1.5)))


def _rows(spark, n=240, noise=0.1, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=(3, n))
    y = 3 * a - 2 * b + noise * rng.normal(size=n)
    rows = [(i, f"g{i % 24}", float(a[i]) if i % 11 else None, float(b[i]), float(c[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, group string, a double, b double, c double, y double")


def test_elastic_net_on_sums_finds_the_signal(spark):
    r = _rows(spark)
    r = r.join(ev.group_folds(r, 4), "group").withColumn("inner", F.pmod(F.crc32("group"), F.lit(3)).cast("int"))
    cols = ["a", "b", "c"]
    fits = ev.fit_elastic_nets(ev.gram(r, cols, "y", ["fold", "inner"]), m := ev.prepare_folds(r, cols, r.select("fold").distinct()), cols)
    one = {x.feature: x.coefficient for x in fits.where("fold = 0").collect()}
    assert one["a"] == pytest.approx(3, abs=0.4) and one["b"] == pytest.approx(-2, abs=0.3) and abs(one["c"]) < 0.2
    p = ev.predict(r, cols, fits, m).withColumn("k", F.lit(1))
    assert ev.out_of_fold_scores(p, ["k"], "y").collect()[0].r2 > 0.8


def test_gram_of_training_rows_is_total_less_fold(spark):
    r = _rows(spark, 60)
    r = r.join(ev.group_folds(r, 3), "group")
    g = {(x.fold, x.i, x.j): x.s for x in ev.gram(r, ["a", "b"], "y").collect()}
    pdf = r.toPandas()
    rest = pdf[pdf.fold != 1]
    total = sum(v for (f, i, j), v in g.items() if (i, j) == ("x_a", "y") and f != 1)
    assert total == pytest.approx(float((rest.a.fillna(0) * rest.y).sum()))


def test_held_out_rows_do_not_move_the_preparation(spark):
    r = _rows(spark, 60).join(ev.group_folds(_rows(spark, 60), 3), "group")
    changed = r.withColumn("a", F.when(F.col("fold") == 0, 1e9).otherwise(F.col("a")))
    f = r.select("fold").distinct()
    a, b = (ev.prepare_folds(x, ["a"], f).where("fold = 0").collect()[0].asDict() for x in (r, changed))
    assert a == pytest.approx(b)


def test_signed_rank_splits_zeros(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0), (1, 3.0, 1.0), (1, 1.0, 2.0), (1, 9.0, 4.0)], "k int, a double, b double")
    r = ev.signed_rank_p(ev.signed_rank(df, ["k"], "a", "b")).collect()[0]
    assert (r.w_plus, r.w_minus, r.n) == (7.5, 2.5, 4) and 0 < r.p_value <= 1


def test_stream_upserts_equal_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    run = sm.upsert_batches(path)
    run(spark.createDataFrame([(1, "a"), (2, "b")], "session_id int, v string"), 0)
    run(spark.createDataFrame([(2, "c"), (3, "d")], "session_id int, v string"), 1)
    run(spark.createDataFrame([(2, "c"), (3, "d")], "session_id int, v string"), 1)
    assert sorted(map(tuple, sm.read_upserted(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    for n in range(2, 6):
        run(spark.createDataFrame([(3, f"v{n}")], "session_id int, v string"), n)
    assert sorted(map(tuple, sm.read_upserted(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "v5")]
    kept = [p for p in (tmp_path / "t").glob("version=*/bucket=*") if any(p.iterdir())]
    assert len(kept) <= 2 * 3


def test_whole_turns_come_back_from_subtitles(spark, sf_dir):
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns.setdefault(str(r.conv_id), []).append((r.turn, 1 if r.role == "user" else 2, re.sub(r"[\r\n]+", " ", r.text or "").strip(" ")))
    cues, spoken = [], []
    for file, rows in turns.items():
        who = None
        for pos, (turn, n, text) in enumerate(sorted(rows)):
            cues.append((file, pos, f"Speaker {n}: {text}".strip(" ") if turn % 3 != 2 else text))
            who = n if turn % 3 != 2 else who
            if who is not None and turn % 7 != 6:
                spoken.append((file, pos, f"SPEAKER_{who:02d}", text))
    got = registry.QUERIES["srt_parse_whole"](spark, sf_dir).collect()
    assert sorted((r.file, r.pos, r.text) for r in got) == sorted(cues) and any(len(c[2]) > 60 for c in cues)
    got = registry.QUERIES["speaker_fill_whole"](spark, sf_dir).collect()
    assert sorted((r.file, r.pos, r.speaker, r.text) for r in got) == sorted(spoken)


def test_positions_do_not_depend_on_gaps_of_ids(spark):
    table = am.number_rows(spark.createDataFrame([(10 * i + 7, 100 + i) for i in range(3)], "key long, n_chars long"), "key", "ordinal").drop("key")
    ids = spark.createDataFrame([(str(i),) for i in (30, 4, 200)], "session_id string")
    got = am.positional_join(table, ids, "ordinal").select("session_id", "ordinal", "n_chars").collect()
    assert sorted(map(tuple, got)) == [(4, 0, 100), (30, 1, 101), (200, 2, 102)]
    with pytest.raises(ValueError):
        am.positional_join(table, ids.limit(2), "ordinal")
