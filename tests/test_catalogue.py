"""The audit tables from file names."""

from tidegrid.operators import audit, catalogue, features


def test_catalogue(spark):
    files = spark.createDataFrame([(f"/x/sub-UTS0{s}/{x}.hf5",) for s, x in ((1, "ses-02_task-Alpha_run-1"), (1, "ses-2_alpha_run-02"), (1, "ses-3_task-alphabet"), (2, "beta_run-7"), (2, "unknown"))] + [("/x/nobody/alpha.hf5",)], "path string")
    names = spark.createDataFrame([("alpha",), ("alphabet",), ("beta",)], "story string")
    sound = spark.createDataFrame([("/w/task-alpha_audio.wav", 60.0), ("/w/b/task-alpha.wav", 50.0)], "path string, seconds double")
    got = catalogue.sessions(files, names, sound).cache()
    assert {(r.subject_id, r.session_id, r.run_id, r.story, r.duration_sec) for r in got.collect()} == {("sub-UTS01", "ses-2", "run-1", "alpha", 60.0), ("sub-UTS01", "ses-2", "run-2", "alpha", 60.0), ("sub-UTS01", "ses-3", "run-1", "alphabet", 0.0), ("sub-UTS02", "ses-unknown", "run-7", "beta", 0.0)}
    assert {r.subject_id: (r.total_sessions_listened, r.unique_stories_listened, r.total_listening_time_min) for r in catalogue.subjects(got).collect()} == {"sub-UTS01": (3, 2, 2.0), "sub-UTS02": (1, 1, 0.0)}
    valid = spark.createDataFrame([("alpha", True)], "story string, valid boolean")
    assert {r.story: (r.total_plays, r.has_valid_textgrid) for r in catalogue.stories(got, valid).collect()} == {"alpha": (2, True), "alphabet": (1, False), "beta": (1, False)}
    assert [tuple(r) for r in catalogue.coverage(got, "alpha").collect()] == [("sub-UTS01", 2, "ses-2", "run-1, run-2"), ("sub-UTS02", 0, None, None)]
    assert catalogue.sessions(files, names, sound, ("alpha",)).where("story = 'alpha'").count() == 0


def test_profile_and_extremes(spark):
    t = spark.createDataFrame([("VERB", "VBD", "walked"), ("VERB", "VBZ", "runs"), ("VERB", "VBP", "run"), ("NOUN", "NN", "x")], "pos string, tag string, text string")
    r = catalogue.tense_profile(features.tense(t)).first()
    assert (r.total_finite_forms, r.past_forms_count, r.past_forms_pct, r.non_past_forms_pct) == (3, 1, 33.33, 66.67)
    lo, hi = audit.extremes(spark.range(20), "id", 2)
    assert [x.id for x in lo.collect()] == [0, 1] and [x.id for x in hi.collect()] == [19, 18]
    assert audit.sampled(spark.range(20), 3, 1).count() == 3
