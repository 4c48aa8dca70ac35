"""Readers, writers, model calls and plans."""

import json

import numpy as np
import pytest
import standin
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

from polyprobe.operators import batch, layout
from polyprobe.plans import catalog, evaluation as ev
from polyprobe.session import CHECKPOINT_DIR, scratch_path
from polyprobe.sources import driver_tables as src, files

# Workers do not see the tests folder.
cloudpickle.register_pickle_by_value(standin)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_json_arrays_keep_their_order(spark, tmp_path):
    items = [{"input": f"text {i} «é»", "answer": "positive"} for i in range(30)]
    (tmp_path / "sentiment_en30_test.json").write_text(json.dumps(items, ensure_ascii=False, indent=1), "utf-8")
    (tmp_path / "sentiment_de1_test.json").write_text(json.dumps([{"input": "x", "answer": "negativ"}]), "utf-8")
    got = files.read_eval_arrays(spark, str(tmp_path), "sentiment")
    assert got.count() == 31
    en = files.read_eval_arrays(spark, str(tmp_path), "sentiment", ["en"]).orderBy("item_no").collect()
    assert [r["input"] for r in en] == [i["input"] for i in items]
    assert {r["lang"] for r in en} == {"en"}


def test_two_field_tasks_have_their_own_schema(spark, tmp_path):
    (tmp_path / "nli_fr1_test.json").write_text(json.dumps([{"premise": "a", "hypothesis": "b", "answer": "c"}]))
    (row,) = files.read_eval_arrays(spark, str(tmp_path), "nli").collect()
    assert (row["premise"], row["hypothesis"], row["answer"], row["lang"]) == ("a", "b", "c", "fr")


def test_language_choice_prunes_partitions(spark, sf_dir, tmp_path):
    path = str(tmp_path / "eval")
    files.write_eval_table(catalog.QUERIES["scan_eval_single"](spark, sf_dir), path)
    one = files.read_eval_table(spark, path, "sentiment", ["fr"])
    assert "PartitionFilters: [" in _plan(one) and "lang" in _plan(one).split("PartitionFilters: [")[1].split("]")[0]
    assert {r["lang"] for r in one.select("lang").distinct().collect()} == {"fr"}
    assert files.read_eval_table(spark, path, "sentiment").count() == 87


def test_csv_keeps_awkward_texts(spark, tmp_path):
    text = ' lead "quoted", comma\nnew line\r\nand more \\ end '
    gap = spark.createDataFrame(
        [("base", "en", 0, text, [1, 2], "positive", [3], "positive")],
        "family string, lang string, item_no bigint, prompt string, out_token_id array<int>, out_token_str string, "
        "latent_token_id array<int>, latent_token_str string")
    path = str(tmp_path / "gap")
    files.write_gap_csv(gap, path)
    (row,) = files.read_gap_csv(spark, path).collect()
    assert row["prompt"].replace("\r\n", "\n") == text.replace("\r\n", "\n")
    assert json.loads(row["out_token_id"]) == [1, 2] and row["lang"] == "en"


def test_json_documents_are_read_whole(spark, tmp_path):
    (tmp_path / "r.json").write_text('{\n "name": "é",\n "n": 2\n}', "utf-8")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])
    assert files.read_json(spark, str(tmp_path / "r.json"), schema, multi_line=True).first() == ("é", 2)
    out = str(tmp_path / "out")
    files.write_json(spark.createDataFrame([("é", 2)], schema), out)
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert "é" in text


def test_scratch_lives_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get(CHECKPOINT_DIR))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, "p" * (i + 1) + "q") for i in range(23)], "k int, prompt string")


def test_scores_do_not_depend_on_batches(spark, asked):
    want = {i: src._letter_waves("p" * (i + 1) + "q", 0.0) for i in range(23)}
    for parts, size in ((1, 1), (3, 4), (5, 64)):
        got = batch.score_prompts(asked.repartition(parts), src.load_scorer, batch_size=size).collect()
        assert all(np.allclose(r["logits"], want[r["k"]]) for r in got) and len(got) == 23


def test_layers_components_and_pooling(spark, asked):
    layers = batch.layer_latents(asked, standin.load_layers, src.WIDTH)
    assert layers.count() == 23 * src.N_LAYERS
    row = layers.filter("k = 4 AND layer = 3").first()
    assert np.allclose(row["vec"], src._letter_waves("pppppq", 3.0))
    pooled = batch.pooled_hidden(asked, standin.load_hidden, src.WIDTH).filter("k = 4 AND layer = 2").first()
    assert np.allclose(pooled["vec"], src._letter_waves("pppppq", 2.0))
    parts = batch.component_logits(asked, standin.load_components, standin.COMPONENTS, src.HIDDEN_LAYERS, src.WIDTH)
    row = parts.filter("k = 4 AND component = 'mlp' AND layer = 1").first()
    assert np.allclose(row["logits"], src._letter_waves("pppppq", 1.75))


def test_each_prompt_reaches_the_model_once(spark, sf_dir):
    plan = catalog.QUERIES["batch_score"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_stored_scores_equal_fresh_ones(spark, asked):
    fresh = batch.score_prompts(asked, src.load_scorer)
    stored = layout.materialize(fresh, "t")
    assert stored.schema == fresh.schema
    assert stored.exceptAll(fresh).count() == 0 and stored.count() == 23


def test_grid_equals_single_cells(spark, sf_dir):
    cols = ["run_id", "task", "label_mode", "lang", "item_no", "pred_class", "correct"]
    grid = ev.predictions(spark, sf_dir).select(cols)
    cell = ev.predictions(spark, sf_dir, [("nli", "english")], ("m2",)).select(cols)
    same = grid.filter((F.col("run_id") == "m2") & (F.col("task") == "nli"))
    assert cell.count() == same.count() > 0
    assert cell.exceptAll(same).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_query_pairs_rows_without_a_key(spark, sf_dir, name):
    plan = _plan(catalog.QUERIES[name](spark, sf_dir))
    physical = plan.split("== Physical Plan ==")[-1]
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


def test_scores_read_no_text(spark, sf_dir):
    """Numbered keys are stored without texts, and nothing else of the documents is read."""
    plan = _plan(catalog.QUERIES["accuracy_by_lang"](spark, sf_dir)).split("== Physical Plan ==")[-1]
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert any("/ranges-" in line for line in scans)
    assert not any("text" in line.split("ReadSchema")[-1] for line in scans)
    assert "text" not in src.labelled(spark, sf_dir).columns


def test_language_filter_reaches_the_scan(spark, sf_dir):
    plan = _plan(catalog.QUERIES["scan_lang_subset"](spark, sf_dir)).split("== Physical Plan ==")[-1]
    assert "In(lang, [en,fr])" in plan
