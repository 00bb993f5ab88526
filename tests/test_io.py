"""Files, JSON trees, models and streams."""

import json

import pytest
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.sql import functions as F

from commentlab.operators import features, mart, models, stemming
from commentlab.plans import ENTRIES
from commentlab.sources import readers, writers
from commentlab.streaming import jobs


def test_label_csv(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text(
        "﻿comment_id,label,annotator,confidence,notes,text\n"
        "007,Positif,llm,0.9,,x\n,Positif,llm,0.9,,x\n8,Entah,llm,0.9,,x\n"
        '9,Negatif,  ,high,"two\nlines, ""q""",x\n', encoding="utf-8")
    rows = {r["comment_id"]: r for r in readers.read_label_csv(spark, str(path)).collect()}
    assert set(rows) == {"007", "9"}
    assert rows["007"]["confidence"] == 0.9 and rows["007"]["notes"] is None
    assert rows["9"]["annotator"] is None and rows["9"]["confidence"] is None and rows["9"]["notes"] == 'two\nlines, "q"'


def test_missing_columns_fail_early(spark):
    with pytest.raises(ValueError, match="missing columns: b, c"):
        readers.require_columns(spark.range(1).toDF("a"), ["a", "c", "b"])


def test_batches_last_line_wins(spark, tmp_path):
    (tmp_path / "batch_1.jsonl").write_text('{"idx":1,"label":"positif","confidence":0.5}\n\n{"idx":1,"label":"Netral"}\n{"idx":2,"label":"negatif"}\n')
    (tmp_path / "batch_2.jsonl").write_text('{"idx":2,"label":"POSITIF","confidence":0.7}\n')
    rows = {r["idx"]: (r["label"], r["confidence"]) for r in readers.read_batches(spark, str(tmp_path / "batch_*.jsonl")).collect()}
    assert rows == {1: ("Netral", 0.9), 2: ("Positif", 0.7)}
    (tmp_path / "batch_3.jsonl").write_text('{"idx":3,"label":"unsure"}\n')
    with pytest.raises(Exception, match="unknown label"):
        readers.read_batches(spark, str(tmp_path / "batch_*.jsonl")).collect()


def test_records(spark):
    with pytest.raises(ValueError):
        readers.from_records(spark, [], "a int", ["a"])
    df = readers.from_records(spark, [{"a": 1, "b": "x"}], "a int, b string", ["b", "zzz"])
    assert df.columns == ["b"] and df.first()["b"] == "x"


def test_publish_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(ValueError):
        writers.read_current(spark, root)
    writers.publish(spark.range(3), root)
    writers.publish(writers.read_current(spark, root).filter("id > 0"), root)
    assert sorted(r[0] for r in writers.read_current(spark, root).collect()) == [1, 2]


def test_report_and_csv_files(spark, tmp_path):
    writers.write_report(spark.range(1).select(F.lit(2).alias("n")), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"n": 2}
    writers.write_csv(spark.range(5), str(tmp_path / "c"), single_file=True)
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 5


TREE = {"n": 1, "a": {"b": [1, 2.5, "x", True, None, []], "c": {}}, "d": {"Negatif": 1, "Netral": 2, "Positif": 3.0, "z": 0},
        "e": [{"Negatif": 1, "Netral": "x", "Positif": 2}], "f": {"Negatif": 1, "Netral": 2},
        "vocab": {"top_terms": [["tidak", 9], ["x"], {"token": "t", "frequency": 3, "path": "p"}, "terms,4,kata,7", "a,b"],
                  "size": 3}, "words": ["w,x,y,z"]}


@pytest.fixture
def trees(spark):
    return spark.createDataFrame([(1, json.dumps(TREE))], "i int, j string")


def plain_leaves(obj, path=""):
    if isinstance(obj, dict):
        for k, v in obj.items():
            yield from plain_leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(obj, list):
        for i, v in enumerate(obj):
            yield from plain_leaves(v, f"{path}[{i}]")
    else:
        yield path, type(obj).__name__


def test_flatten(trees):
    got = {(r["metric_path"], r["value_type"]) for r in mart.flatten_scalars(trees, "j", ["i"]).collect()}
    want = {(p, "float" if t == "float" else t) for p, t in plain_leaves(TREE)}
    # JSON does not tell 3.0 from 3 for sure; the path is what matters there.
    assert {p for p, _ in got} == {p for p, _ in want}
    assert len(got ^ want) <= 2


def test_flatten_any_depth(spark):
    deep = "1"
    for _ in range(40):
        deep = '{"a":[' + deep + "]}"
    df = spark.createDataFrame([(1, deep), (2, "7"), (3, "{}")], "i int, j string")
    rows = {r["i"]: (r["metric_path"], r["value"]) for r in mart.flatten_scalars(df, "j", ["i"]).collect()}
    assert rows == {1: (".".join(["a[0]"] * 40), "1"), 2: ("", "7")}


def test_label_distributions(trees):
    leaves = mart.json_leaves(trees, "j", ["i"])
    got = {(r["source_path"], r["label"]): r["count"] for r in mart.label_distributions(leaves, ["i"]).collect()}
    assert got == {("d", "Negatif"): 1, ("d", "Netral"): 2, ("d", "Positif"): 3, ("e[0]", "Negatif"): 1, ("e[0]", "Positif"): 2}


def test_term_lists(trees):
    leaves = mart.json_leaves(trees, "j", ["i"])
    got = {(r["source"], r["path"], r["rank"], r["term"], r["count"]) for r in mart.term_lists(leaves, ["i"]).collect()}
    assert got == {("vocab.top_terms", "top_terms", 1, "tidak", 9), ("vocab.top_terms", "p", 3, "t", 3),
                   ("vocab.top_terms", "terms", 4, "kata", 7), ("words", "w", 1, "y", None)}


def test_standard_columns(spark):
    df = spark.createDataFrame([("1", "Negatif", "Netral", "salah"), ("2", "Netral", None, "?")], "comment_id string, label_asli string, prediksi string, benar string")
    rows = {r["comment_id"]: r for r in mart.standard_predictions(df).collect()}
    assert rows["1"]["is_correct"] is False and rows["1"]["error_pair"] == "Negatif → Netral" and rows["1"]["confidence"] is None
    assert rows["2"]["error_status"] == "Tidak diketahui" and rows["2"]["error_pair"] == "Netral → nan"
    one = mart.standard_features(spark.createDataFrame([("a", "x", 1.0, 4)], "kelas string, fitur string, koef double, rank int")).first()
    assert tuple(one) == (None, None, "a", "x", 1.0, 4)


def test_reports_at_root_or_in_test(spark):
    block = {"accuracy": 0.84, "macro_f1": 0.8397, "per_class": {"Negatif": {"f1-score": 0.802, "support": 100}},
             "confusion_matrix": [[81, 6, 13], [16, 80, 4], [5, 4, 91]]}
    docs = [("m1", json.dumps({"model": "x", "test": block})), ("m2", json.dumps(block))]
    blocks = mart.report_blocks(spark.createDataFrame(docs, "model string, doc string"), "doc", ["model"])
    rows = mart.model_comparison(blocks, ["model"]).collect()
    assert {(r["accuracy"], r["f1_negatif"], r["f1_netral"]) for r in rows} == {(0.84, 0.802, None)}
    per = mart.per_class_metrics(blocks, ["model"]).filter("label = 'Negatif'").collect()
    assert {(r["precision"], r["recall"], r["support"]) for r in per} == {(0.7941, 0.81, 100)}
    assert mart.confusion_table(blocks, ["model"]).filter("is_diagonal").agg(F.sum("count")).first()[0] == 504


def test_stemming_orders(spark):
    df = spark.createDataFrame([(1, ["cats", "run", "cats"]), (2, [])], "id int, w array<string>")
    words = stemming.vocabulary(df, "w")
    stems = stemming.stem_table_from(words, lambda: lambda w: w.rstrip("s"))
    got = {r["id"]: r["w"] for r in stemming.stem_tokens(df, "id", "w", stems, ()).collect()}
    assert got == {1: ["cat", "run", "cat"], 2: []}
    kept = {r["id"]: r["w"] for r in stemming.stem_tokens(df, "id", "w", stems, ("cats",)).collect()}
    assert kept[1] == ["cats", "run", "cats"]


def test_large_stem_table_gives_the_same(spark):
    df = spark.createDataFrame([(i, ["cats", "x", f"w{i}s"]) for i in range(50)], "id int, w array<string>")
    stems = spark.createDataFrame([("cats", "cat")] + [(f"w{i}s", f"w{i}") for i in range(50)], "token string, stem string")
    small = sorted(map(tuple, stemming.stem_tokens(df, "id", "w", stems).collect()), key=str)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, stemming.stem_tokens(df, "id", "w", stems).collect()), key=str) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def corpus(spark):
    words = {0: "buruk jahat bohong", 1: "biasa saja mungkin", 2: "bagus hebat mantap"}
    rows = [(i, i % 3, f"{words[i % 3]} kata{i % 7} hal{i % 5}") for i in range(120)]
    return spark.createDataFrame(rows, "id int, y int, t string")


def test_relation_and_pipeline_agree(spark):
    df = corpus(spark)
    docs = df.select("id", F.split("t", " ").alias("terms"))
    want = {(r["id"], r["term"]): r["weight"] for r in features.tfidf(docs, "id", "terms", 2).collect()}
    fitted = Pipeline(stages=models.bag("terms", "v", 2.0)).fit(docs)
    vocab = fitted.stages[0].vocabulary
    got = {}
    for r in fitted.transform(docs).collect():
        for i, v in zip(r["v"].indices, r["v"].values, strict=True):
            got[(r["id"], vocab[i])] = float(v)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_pipeline_with_custom_stage_can_be_saved(spark, tmp_path):
    df = corpus(spark).select("id", F.split("t", " ").alias("terms"))
    fitted = Pipeline(stages=models.bag("terms", "v", 1.0)).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(df).first()["v"] == fitted.transform(df).first()["v"]


def test_models_learn(spark):
    from commentlab.operators.metrics import evaluate
    from commentlab.operators.ranking import stratified_split

    folded = stratified_split(corpus(spark), "id", "y").persist()
    grid = models.grid_search(folded, "id", "t", "y", min_dfs=(1.0,), regs=(0.01,), max_iter=10)
    _, svm = models.refit_best(folded, "id", "t", "y", grid, max_iter=10)
    assert evaluate(svm, "y", "prediction").first()["accuracy"] > 0.9
    assert models.with_margin(svm).filter("margin < 0").count() == 0
    train, test = folded.filter("fold <> 'test'"), folded.filter("fold = 'test'")
    for clf in (models.logistic("y", max_iter=10), models.complement_nb("y")):
        model, predicted = models.fit_and_predict(train, test, models.word_stages("t", 1.0, size=500), clf, "y")
        assert evaluate(predicted, "y", "prediction").first()["accuracy"] > 0.9
    model, _ = models.fit_and_predict(train, test, models.word_stages("t", 1.0, size=500), models.linear_svm("y", 0.01, 10), "y")
    top = models.top_coefficients(model, 3).filter("rank = 1 AND label_id = 2").first()["feature"]
    assert any(w in top for w in ("bagus", "hebat", "mantap"))


def test_out_of_fold_covers_all_rows_once(spark):
    got = models.out_of_fold(corpus(spark), "id", "y", lambda: models.word_stages("t", 1.0, size=500), lambda: models.complement_nb("y"), 3)
    rows = got.collect()
    assert sorted(r["id"] for r in rows) == list(range(120)) and {r["kfold"] for r in rows} == {0, 1, 2}


def page(video, *comments):
    items = [{"snippet": {"topLevelComment": {"id": i, "snippet": {"textDisplay": t}}}} for i, t in comments]
    return json.dumps({"video_id": video, "source_url": "u", "items": items})


def test_stream_landing_resumes(spark, tmp_path):
    pages, target, checkpoint = (str(tmp_path / d) for d in ("pages", "landed", "cp"))
    (tmp_path / "pages").mkdir()

    def run():
        stream = jobs.flat_comments(jobs.answer_stream(spark, pages, 1))
        jobs.land_comments(stream, target, checkpoint).awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(target).select("comment_id").collect())

    (tmp_path / "pages" / "1.json").write_text(page("v", ("a", "x"), ("b", "  "), ("a", "again")))
    assert run() == ["a"]
    (tmp_path / "pages" / "2.json").write_text(page("v", ("a", "late"), ("c", "y")))
    assert run() == ["a", "c"]
    assert run() == ["a", "c"]


def test_stream_counts_equal_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select((F.col("id") % 4).alias("k")).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k bigint").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.write_updates(jobs.running_counts(stream, "k"), target, str(tmp_path / "cp")).awaitTermination()
    got = {r["k"]: r["n"] for r in jobs.latest_counts(spark, target, "k").collect()}
    assert got == {r["k"]: r["count"] for r in spark.read.parquet(source).groupBy("k").count().collect()}


def test_stream_counts_read_one_snapshot_and_its_tail(spark, tmp_path):
    """After ten batches with a snapshot each three, only batch 9 is read beside the one of batches 0 to 8."""
    source, target = str(tmp_path / "in"), str(tmp_path / "counts")
    for i in range(10):
        spark.range(i * 7, i * 7 + 7).select((F.col("id") % (4 + i)).alias("k")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k bigint").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.write_updates(jobs.running_counts(stream, "k"), target, str(tmp_path / "cp"), every=3).awaitTermination()
    snapshot, tail = jobs.update_parts(spark, target)
    assert {r["batch"] for r in snapshot.collect()} == {8} and {r["batch"] for r in tail.collect()} == {9}
    got = {r["k"]: r["n"] for r in jobs.latest_counts(spark, target, "k").collect()}
    assert got == {r["k"]: r["count"] for r in spark.read.parquet(source).groupBy("k").count().collect()}


def test_broken_batch_lines_fail(spark, tmp_path):
    for i, line in enumerate(('{"idx":', '{"label":"positif"}', "nonsense")):
        path = tmp_path / f"b{i}.jsonl"
        path.write_text('{"idx":1,"label":"\\tpositif\\n"}\n \t \n' + line + "\n")
        with pytest.raises(Exception, match="no idx in line"):
            readers.read_batches(spark, str(path)).collect()


def test_vocabulary_is_never_cut(spark):
    df = corpus(spark).select("id", F.split("t", " ").alias("terms"))
    n = df.select(F.explode("terms")).distinct().count()
    assert len(Pipeline(stages=models.bag("terms", "v", 1.0, n)).fit(df).stages[0].vocabulary) == n
    with pytest.raises(ValueError, match="larger vocabulary"):
        Pipeline(stages=models.bag("terms", "v", 1.0, n - 1)).fit(df)


def test_one_writer_per_version(spark, tmp_path):
    root = str(tmp_path / "t")
    (tmp_path / "t" / "_claims").mkdir(parents=True)
    (tmp_path / "t" / "_claims" / "version=00000001").touch()
    assert writers.publish(spark.range(3), root).endswith("version=00000002")
    assert readers.read_columns(spark, root + "/version=00000002", ["id"]).count() == 3


def test_json_lines_and_marked_csv(spark, tmp_path):
    writers.write_json(spark.range(2).select("id", F.lit("x").alias("t")), str(tmp_path / "j"))
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "j")).collect()) == [0, 1]
    writers.write_csv(spark.range(2), str(tmp_path / "c"), single_file=True, bom=True)
    text = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert text.startswith("﻿id".encode())
    assert sorted(r["id"] for r in readers.read_csv(spark, str(tmp_path / "c"), {"id": "bigint"}).collect()) == [0, 1]


def test_variants_beside_the_majority(spark):
    df = corpus(spark).withColumn("fold", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    words = lambda: models.word_stages("t", 1.0, size=500)
    variants = {"base": (words, lambda: models.logistic("y", max_iter=5)), "naive_bayes": (words, lambda: models.complement_nb("y"))}
    rows = {r["variant"]: r for r in models.variant_scores(df, "id", "y", variants, "base", k=2).collect()}
    assert set(rows) == {"base", "bias", "naive_bayes"}
    assert all(r["macro_f1"] > 0.9 and r["oof_macro_f1"] > 0.9 and r["accuracy"] > r["majority_accuracy"] for r in rows.values())


@pytest.mark.parametrize("name", ["stream_cleaning", "stream_running_counts"])
def test_streams_over_tables_of_many_files(spark, sf, tmp_path, name):
    """A table that is a folder of files streams like one that is a file."""
    for table in ("documents", "events"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = lambda folder: sorted(map(str, ENTRIES[name].run(spark, folder).collect()))
    got = rows(str(tmp_path))
    assert got and got == rows(sf)


def test_written_tables_leave_no_shuffle_files(spark):
    """What a table was made through goes when it is written, the session's setting stays, and ``discard`` deletes it."""
    import os
    import time

    from commentlab import session

    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().endswith(".data")}

    before, setting = shuffled(), spark.conf.get(session.CLEANUP_KEY)
    made = session.materialize(spark.range(1000).repartition(3, "id"), "made")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before and made.count() == 1000 and spark.conf.get(session.CLEANUP_KEY) == setting
    folder = os.path.dirname(made.inputFiles()[0]).removeprefix("file://")
    session.discard(spark, made)
    assert not os.path.exists(folder)
