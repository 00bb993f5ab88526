"""Annotations, corrections, agreement, metrics and table changes on hand-made rows."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from commentlab.functions import vectors as vec
from commentlab.operators import curation, features, ingest, metrics, stats, upsert

# Published confusion matrices with accuracy, macro-F1 and weighted-F1; kappa by hand.
GOLDEN = [
    ([[58, 40, 23], [41, 866, 82], [11, 69, 221]], 0.8115, 0.6963, 0.8116, 0.5899),
    ([[58, 46, 17], [64, 832, 93], [19, 82, 200]], 0.7725, 0.6504, 0.7760, 0.5136),
    ([[53, 52, 16], [38, 885, 66], [9, 72, 220]], 0.8207, 0.6984, 0.8177, 0.5989),
    ([[76, 14, 10], [14, 69, 17], [9, 11, 80]], 0.7500, 0.7494, 0.7494, 0.6250),
    ([[81, 6, 13], [16, 80, 4], [5, 4, 91]], 0.8400, 0.8397, 0.8397, 0.7600),
    ([[64, 13, 23], [9, 83, 8], [8, 6, 86]], 0.7767, 0.7739, 0.7739, 0.6650),
    ([[77, 6, 13], [9, 90, 5], [7, 3, 90]], 0.8567, 0.8556, 0.8566, 0.7849),
    ([[73, 8, 19], [7, 73, 20], [6, 8, 86]], 0.7733, 0.7740, 0.7740, 0.6600),
    ([[79, 6, 15], [12, 85, 3], [9, 1, 90]], 0.8467, 0.8469, 0.8469, 0.7700),
    ([[73, 4, 19], [6, 93, 5], [5, 2, 93]], 0.8633, 0.8615, 0.8629, 0.7948),
    ([[82, 8, 10], [8, 84, 8], [16, 13, 71]], 0.7900, 0.7890, 0.7890, 0.6850),
    ([[78, 7, 11], [9, 92, 3], [6, 2, 92]], 0.8733, 0.8721, 0.8730, 0.8099),
]


def golden_rows(spark):
    counts = [(g, i, j, m[0][i][j]) for g, m in enumerate(GOLDEN) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(counts, "run int, a int, p int, n int")
    return df.select("run", "a", "p", F.explode(F.sequence(F.lit(1), "n")).alias("_"))


def test_published_scores(spark):
    got = metrics.evaluate(golden_rows(spark), "a", "p", ["run"]).orderBy("run").collect()
    for r, (_, acc, macro, weighted, _) in zip(got, GOLDEN, strict=True):
        assert (r["accuracy"], r["macro_f1"], r["weighted_f1"]) == pytest.approx((acc, macro, weighted), abs=5.1e-5)


@pytest.mark.parametrize("run", [0, 6, 11])
def test_published_kappa(spark, run):
    rows = golden_rows(spark).filter(F.col("run") == run)
    assert curation.cohen_kappa(rows, "a", "p").first()["kappa"] == pytest.approx(GOLDEN[run][4], abs=5.1e-5)


def test_kappa_without_chance_room(spark):
    df = spark.createDataFrame([(1, 1)] * 4, "a int, b int")
    row = curation.cohen_kappa(df, "a", "b").first()
    assert row["agreement"] == 1.0 and row["kappa"] is None and row["band"] is None


def test_scores_with_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "a int, p int")
    row = metrics.evaluate(df, "a", "p").first()
    assert row["accuracy"] == 0.5 and row["macro_f1"] == pytest.approx((2 / 3) / 3, abs=1e-6)
    per = {r["label_id"]: r for r in metrics.evaluate_per_class(df, "a", "p").collect()}
    assert per[2]["f1"] == 0.0 and per[1]["precision"] == 0.0


def test_matrix_precision_recall(spark):
    df = spark.createDataFrame([("m", [[81, 6, 13], [16, 80, 4], [5, 4, 91]]), ("z", [[0, 1], [0, 0]])], "k string, m array<array<bigint>>")
    got = {(r["k"], r["label_id"]): (r["precision"], r["recall"]) for r in metrics.matrix_precision_recall(df, "m", ["k"]).collect()}
    assert got[("m", 0)] == (0.7941, 0.81) and got[("m", 1)] == (0.8889, 0.8) and got[("m", 2)] == (0.8426, 0.91)
    assert got[("z", 0)] == (None, 0.0) and got[("z", 1)] == (0.0, None)


def test_bias_grid_against_loop(spark):
    import random

    rng = random.Random(3)
    grid = [(i - 6) / 10 for i in range(13)]
    data = [(rng.randrange(3), *[rng.choice([rng.random(), 0.5]) for _ in range(3)]) for _ in range(150)]
    df = spark.createDataFrame(data, "y int, s0 double, s1 double, s2 double")
    got = {(r["bias_0"], r["bias_2"]): r["accuracy"] for r in metrics.bias_grid(df, "y", "s0", "s1", "s2", grid).collect()}
    assert len(got) == 169
    for b0, b2 in itertools.product(grid, grid):
        hit = 0
        for y, s0, s1, s2 in data:
            s = [s0 + b0, s1, s2 + b2]
            hit += s.index(max(s)) == y
        assert got[(b0, b2)] == pytest.approx(hit / len(data), abs=1e-6)


def test_vote_ties_go_to_the_smaller_class(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (1, 1), (2, 2), (2, 2), (2, 0)], "id int, p int")
    assert {r["id"]: r["predicted"] for r in metrics.hard_vote(df, "id", "p").collect()} == {1: 0, 2: 2}


def test_score_arrays(spark):
    df = spark.createDataFrame([([0.2, 0.9, 0.9],), ([1.0, 1.0, 1.0],)], "s array<double>")
    assert [r[0] for r in df.select(vec.argmax(F.col("s"))).collect()] == [1, 0]
    assert [r[0] for r in df.select(vec.margin(F.col("s"))).collect()] == [0.0, 0.0]
    assert df.select(vec.softmax_confidence(F.col("s"))).collect()[1][0] == 0.3333


def task(cid, annotations, text="t", video="v"):
    return {"data": {"comment_id": cid, "video_id": video, "text": text}, "annotations": annotations}


def result(choice, control="sentiment"):
    r = {"value": {"choices": [choice] if choice else []}}
    return {**r, "from_name": control} if control else r


def annotation(*results, cancelled=False):
    return {"was_cancelled": cancelled, "result": list(results)}


TASKS = [
    task("1", [annotation(result("Positif"), cancelled=True), annotation(result("negative"))]),
    task("2", [annotation(result("??")), annotation(result("Netral"))]),
    task("3", [annotation(result("Positif", "other"))]),
    task("4", [annotation(result("Positif", None), result("Netral"))]),
    task("5", []),
    task("6", [annotation(result("Positif"))], text="  "),
    task("7", [annotation(result("Positif"))], video="a"),
    task("7", [annotation(result("Negatif"))], video="b"),
    task("8", [annotation(result(None), result("pos"), result("neg"))]),
    task("9", [annotation(result("??"), result("Positif"))]),
]


@pytest.fixture(scope="module")
def tasks(spark, tmp_path_factory):
    from commentlab.sources.readers import read_annotation_export

    path = tmp_path_factory.mktemp("export") / "tasks.json"
    path.write_text(json.dumps(TASKS))
    return read_annotation_export(spark, str(path))


def test_parse_annotations(tasks):
    got = curation.parse_annotations(tasks, "sentiment", [F.asc("video_id")]).collect()
    assert {r["comment_id"]: (r["label"], r["label_id"]) for r in got} == {
        "1": ("Negatif", 0), "2": ("Netral", 1), "4": ("Positif", 2), "7": ("Positif", 2), "8": ("Positif", 2)}
    kept = curation.parse_annotations(tasks, "sentiment", [F.asc("video_id")], keep_unlabelled=True).collect()
    assert {r["comment_id"] for r in kept} == {"1", "2", "3", "4", "5", "7", "8", "9"}


def test_last_choice(tasks):
    got = tasks.select("data.comment_id", curation.last_choice("annotations").alias("c")).collect()
    last = {}
    for r in got:
        last.setdefault(r[0], r[1])
    assert last["1"] == "negative" and last["2"] == "Netral" and last["3"] == "Positif"
    assert last["4"] == "Netral" and last["5"] is None and last["8"] == "neg"


def test_updates_may_set_null(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, x string")
    got = {r["id"]: (r["x"], r["y"]) for r in upsert.set_fields(old, new, "id").collect()}
    assert got == {1: ("a", 1), 2: (None, 2), 3: ("c", None)}
    got = {r["id"]: (r["x"], r["y"], r["hit"]) for r in curation.apply_updates(old, new, "id", ["x"], "hit").collect()}
    assert got == {1: ("a", 1, False), 2: (None, 2, True)}
    got = {r["id"]: (r["x"], r["y"]) for r in upsert.replace_rows(old, new, "id").collect()}
    assert got == {1: ("a", 1), 2: (None, None), 3: ("c", None)}


def test_job_state_and_registration(spark):
    log = [(1, "registered", "t1", None, None, None), (2, "running", "t2", None, None, None), (3, "failed", "t3", None, "boom", None),
           (4, "title", "t4", None, None, "T"), (5, "title", "t5", None, None, None)]
    df = spark.createDataFrame([("v", *x) for x in log], "video_id string, seq int, kind string, at string, amount bigint, message string, title string")
    state = ingest.job_state(df, "video_id", "kind", "at", "seq")
    row = state.first()
    assert (row["status"], row["started_at"], row["completed_at"], row["error_message"], row["video_title"]) == ("failed", "t2", "t3", "boom", "T")
    jobs = state.withColumn("video_url", F.lit("u"))
    entries = spark.createDataFrame([("v", "u", None), ("w", None, "W")], "video_id string, video_url string, video_title string")
    got = {r["video_id"]: r for r in ingest.register_jobs(jobs, entries).collect()}
    assert got["v"]["status"] == "pending" and got["v"]["error_message"] is None and got["v"]["started_at"] is None
    assert got["w"]["status"] == "pending" and got["w"]["video_url"] == "" and got["w"]["video_title"] == "W"
    same = {r["video_id"]: r for r in ingest.register_jobs(jobs, entries, reset_failed=False).collect()}
    assert same["v"]["status"] == "failed" and same["v"]["error_message"] == "boom"


def test_links(spark):
    i = "dQw4w9WgXcQ"
    urls = [f"https://youtu.be/{i}", "bad", f"https://youtube.com/v/{i}", f"https://youtu.be/{i}"]
    from commentlab.functions import lexicons as lx

    df = spark.createDataFrame(list(enumerate(urls)), "pos int, url string")
    got = ingest.split_links(df, "url", "pos", lx.VIDEO_URL_PATTERNS, lx.VIDEO_ID_PATTERN).orderBy("pos").collect()
    assert [r["status"] for r in got] == ["VALID", "INVALID", "DUPLIKAT", "DUPLIKAT"]


def test_flatten_item_without_snippet(spark):
    pages = [json.dumps({"items": [{"etag": "e"}, {"snippet": {"totalReplyCount": 3, "topLevelComment": {"id": "c", "snippet": {
        "textDisplay": "x", "likeCount": like}}}}]}) for like in ("12", None, "x", "4.2", 5, 4.9, "3000000000", " 8\n")]
    df = spark.createDataFrame([(p,) for p in pages], "j string").select(
        F.lit("v").alias("video_id"), F.lit("u").alias("source_url"), F.lit(None).cast("string").alias("source_title"),
        F.from_json("j", ingest.PAGE).alias("p"))
    rows = ingest.flatten_pages(df, "p.items", "now").collect()
    assert sorted(r["like_count"] for r in rows if r["comment_id"] == "c") == [0, 0, 0, 4, 5, 8, 12, 3000000000]
    empty = [r for r in rows if r["comment_id"] == ""]
    assert len(empty) == 8 and empty[0]["text"] == "" and empty[0]["author_display_name"] is None
    assert {r["total_reply_count"] for r in rows} == {0, 3}


def test_balance_status(spark):
    even = spark.createDataFrame([("a", 5), ("b", 5)], "l string, n bigint")
    odd = spark.createDataFrame([("a", 5), ("b", 9), ("c", 7)], "l string, n bigint")
    one = spark.createDataFrame([("a", 5)], "l string, n bigint")
    assert tuple(stats.balance_status(even, "l", "n").first()) == ("balanced", None, 0)
    assert tuple(stats.balance_status(odd, "l", "n").first()) == ("dominant", "b", 2)
    assert tuple(stats.balance_status(one, "l", "n").first()) == ("balanced", None, 0)


def test_parity_never_matches_null(spark):
    df = spark.createDataFrame([("a", "a"), (None, None), ("a", None)], "x string, y string")
    assert stats.parity(df, {"p": ("x", "y")}).first().asDict() == {"n": 3, "p_equal": 1, "p_share": 0.333333}


def test_leakage(spark):
    df = spark.createDataFrame([(1, "t", "train"), (2, "t", "test"), (3, "", "train"), (4, "", "val"), (1, "u", "val")], "id int, f string, fold string")
    assert stats.leakage(df, "id", "f", "fold").first().asDict() == {"shared_texts": 1, "rows_affected": 2, "id_overlap": 1}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert {r["y"]: r["weight"] for r in features.class_weights(df, "y").collect()} == {0: 8 / 12, 1: 2.0}
    assert features.add_class_weights(df, "y").agg(F.sum("weight")).first()[0] == pytest.approx(8.0)


def test_approximate_figures_are_close(spark, sf):
    from commentlab.plans import ENTRIES

    exact = ENTRIES["length_profile"].run(spark, sf).first()
    near = ENTRIES["approximate_median_lengths"].run(spark, sf).first()
    assert near["median_raw"] == pytest.approx(exact["median_raw"], rel=0.2)
    n = ENTRIES["vocabulary_size"].run(spark, sf).first()[0]
    assert ENTRIES["vocabulary_size_approximate"].run(spark, sf).first()[0] == pytest.approx(n, rel=0.15)


def test_report_row(spark, sf):
    from commentlab.plans import ENTRIES

    row = ENTRIES["eda_report"].run(spark, sf).first().asDict()
    counts = json.loads(row["class_distribution"])
    assert sum(c["n"] for c in counts) == row["n_total"]
    assert json.loads(row["quality"])["n_total"] == row["n_total"]
    assert json.loads(row["leakage"])["id_overlap"] == 0
    assert len(json.loads(row["top_terms"])) == 12


def test_repeated_update_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, x string, at int")
    last = [F.desc("at")]
    for table in (upsert.replace_rows(old, new, "id", last), upsert.set_fields(old, new, "id", last)):
        assert {r["id"]: r["x"] for r in table.collect()} == {1: "a", 2: "d", 3: "e"}
    assert {r["id"]: r["x"] for r in curation.apply_updates(old, new, "id", ["x"], order=last).collect()} == {1: "a", 2: "d"}
    for change in (upsert.replace_rows, upsert.set_fields, lambda o, n, k: curation.apply_updates(o, n, k, ["x"])):
        with pytest.raises(Exception, match="repeated id: 2"):
            change(old, new, "id").collect()


def test_raw_json_keeps_unknown_fields(spark):
    item = {"kind": "k", "id": "i", "etag": "e", "snippet": {"isPublic": True, "topLevelComment": {"id": "c", "snippet": {"textDisplay": "x", "new": [1]}}}}
    page = spark.createDataFrame([("v", "u", "t", json.dumps({"items": [item]}))], "video_id string, source_url string, source_title string, b string")
    rows = ingest.flatten_pages(page.withColumn("p", F.from_json("b", ingest.PAGE)), "p.items", "now").collect()
    assert json.loads(rows[0]["raw_json"]) == item and rows[0]["comment_id"] == "c"


def test_lost_ids_fail(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert upsert.all_found(ids, spark.createDataFrame([(1, "a"), (2, None)], "id int, x string"), "id").count() == 2
    with pytest.raises(Exception, match="no row for id 2"):
        upsert.all_found(ids, spark.createDataFrame([(1, "a")], "id int, x string"), "id").collect()
