"""The splittable JSON-array source and the document sink."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from polyprobe.sources import files, json_arrays as ja

ODD = ["", "plain", 'a "quoted" word', "back\\slash", '\\"', "\\\\", "[1, 2]", "{", "}", "],[", "tab\tline\n", "«é» 日本 👍",
       " ", "x" * 300, "\\" * 9, '"' * 5, ",", " , ", "null", "\x01"]


def _items(n, seed):
    rng = random.Random(seed)
    values = [*ODD, None]
    return [rng.choice([
        {"input": rng.choice(values), "answer": rng.choice(values)}, {"input": "".join(rng.choices([*ODD], k=5)), "more": [1, [2, {"k": "]"}]]},
        {}, None, rng.choice(ODD), [[], {"a": ","}], 3.5, True]) for _ in range(n)]


@pytest.mark.parametrize("range_bytes", [1, 2, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("style", [{"indent": 1, "ensure_ascii": False}, {"separators": (",", ":")}])
def test_ranges_of_any_size_give_all_items_in_order(tmp_path, range_bytes, style):
    """The passes themselves, without Spark: start states by running sums, then every range on its own."""
    wanted = _items(60, range_bytes)
    path = tmp_path / "sentiment_en_test.json"
    path.write_text("﻿ " + json.dumps(wanted, **style) + "\n", "utf-8")
    reader = ja.RangeReader({"path": str(path), "rangeBytes": range_bytes})
    (f,) = reader.files()
    inside = depth = before = 0
    got = []
    for start, stop in reader.cut(f):
        part = ja.ByteRange(f, start, stop, bool(inside), depth, before)
        got += list(ja.items(part))
        found = ja.summary(part)
        commas = found["commas_in"] if inside else found["commas_out"]
        before += sum(c["n"] for c in commas if c["depth"] + depth == 1)
        depth += found["turn_in"] if inside else found["turn_out"]
        inside = (inside + found["quotes"]) % 2
    assert [n for n, _ in got] == list(range(60))
    assert [json.loads(text) for _, text in got] == wanted
    assert (inside, depth, before) == (0, 0, 59)


@pytest.mark.parametrize("text", ["[]", " [ \n ] ", ""])
def test_files_without_items(spark, tmp_path, text):
    (tmp_path / "nli_de_test.json").write_text(text)
    assert ja.read_json_arrays(spark, str(tmp_path)).count() == 0


def test_folder_without_files(spark, tmp_path):
    assert ja.read_json_arrays(spark, str(tmp_path)).count() == 0


def test_one_large_file_is_read_by_many_tasks_and_equals_duckdb(spark, tmp_path):
    wanted = [{"input": (ODD[i % len(ODD)] if i % 7 else None), "answer": f"a{i}"} for i in range(3000)]
    path = tmp_path / "sentiment_en3000_test.json"
    path.write_text(json.dumps(wanted, ensure_ascii=False), "utf-8")
    got = files.read_eval_arrays(spark, str(tmp_path), "sentiment", range_bytes=4096)
    assert got.rdd.getNumPartitions() >= path.stat().st_size // 4096
    rows = [(r["item_no"], r["input"], r["answer"]) for r in got.orderBy("item_no").collect()]
    db = duckdb.sql(f"SELECT row_number() OVER () - 1, input, answer FROM read_json('{path}', format='array', "
                    "columns={input: 'VARCHAR', answer: 'VARCHAR'})").fetchall()
    assert rows == db


def test_unwanted_files_are_not_planned(spark, tmp_path):
    for lang in ("en", "de", "fr"):
        (tmp_path / f"sentiment_{lang}_test.json").write_text(json.dumps([{"input": lang, "answer": lang}] * 50))
    (tmp_path / "nli_en_test.json").write_text("not json at all [[[")
    (tmp_path / ".hidden.json").write_text("[")
    reader = ja.ItemReader({"path": str(tmp_path), "rangeBytes": 1 << 20})
    assert len(reader.partitions()) == 4
    left = list(reader.pushFilters([In(("lang",), ("en", "fr")), EqualTo(("task",), "sentiment"), GreaterThan(("item_no",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert [p.file.lang for p in reader.partitions()] == ["en", "fr"]
    # The same through a query: one task per wanted file, and a broken file of another task does no harm.
    some = ja.read_json_arrays(spark, str(tmp_path)).where(F.col("lang").isin("en", "fr") & (F.col("task") == "sentiment"))
    assert some.rdd.getNumPartitions() == 2 and some.count() == 100
    nothing = ja.read_json_arrays(spark, str(tmp_path)).where("lang = 'xx'")
    assert nothing.count() == 0


def test_only_wanted_files_are_indexed(spark, tmp_path):
    for lang in ("en", "de"):
        (tmp_path / f"sentiment_{lang}_test.json").write_text(json.dumps([{"input": lang * k, "answer": ""} for k in range(50)]))
    some = ja.read_json_arrays(spark, str(tmp_path), langs=["de"], range_bytes=100)
    assert [r["item_no"] for r in some.orderBy("item_no").collect()] == list(range(50))
    reader = ja.ItemReader({"path": str(tmp_path), "rangeBytes": 100})
    with pytest.raises(ValueError, match="several ranges"):
        reader.partitions()


def test_documents_are_whole_arrays_in_order(spark, tmp_path):
    rows = [(f"d{i % 3}.json", i, ODD[i % len(ODD)] if i % 5 else None, None if i % 4 else 1.5) for i in range(400)]
    frame = spark.createDataFrame(rows, "document string, k bigint, t string, x double").repartition(7)
    path = str(tmp_path / "out")
    told = {r["document"]: r for r in ja.write_json_documents(frame, path, "document", ["k"]).collect()}
    for name in ("d0.json", "d1.json", "d2.json"):
        text = (tmp_path / "out" / name).read_text("utf-8")
        assert json.loads(text) == [{"k": k, "t": t, "x": x} for d, k, t, x in rows if d == name]
        assert (told[name]["n_items"], told[name]["n_bytes"]) == (len(json.loads(text)), len(text.encode()))
        assert "\\u" not in text.replace("\\u0001", "")
    # Nothing else is left, neither fragments nor hidden parts.
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d0.json", "d1.json", "d2.json"]
    back = ja.read_json_arrays(spark, path, range_bytes=500)
    got = sorted(map(tuple, back.select("file", "item_no", F.from_json("value", "k bigint, t string, x double").alias("r"))
                     .selectExpr("right(file, 7)", "r.k", "r.t", "r.x").collect()), key=lambda r: r[1])
    assert got == rows


def test_fragments_of_other_attempts_do_not_count(spark, tmp_path):
    """Only what the manifest names is joined, and a document never shows before it is whole."""
    path = tmp_path / "out"
    (path / "_fragments").mkdir(parents=True)
    (path / "_fragments" / "0-999-0").write_text('{"k":"left by a lost attempt"')
    (path / ".d.json.17").write_text("[\n{")
    frame = spark.range(100).select(F.lit("d.json").alias("document"), F.col("id").alias("k"))
    ja.write_json_documents(frame, str(path), "document", ["k"])
    assert [r["k"] for r in json.loads((path / "d.json").read_text())] == list(range(100))
    assert ja.read_json_arrays(spark, str(path)).count() == 100
    assert not (path / "_fragments").exists()


def test_an_empty_table_writes_no_document(spark, tmp_path):
    frame = spark.range(0).select(F.lit("d.json").alias("document"), F.col("id").alias("k"))
    assert ja.write_json_documents(frame, str(tmp_path / "out"), "document", ["k"]).count() == 0


def test_eval_sets_survive_a_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("en", i, t, "x") for i, t in enumerate([*ODD, None])], "lang string, item_no bigint, input string, answer string")
    files.write_eval_arrays(items, str(tmp_path / "sets"), "sentiment")
    back = files.read_eval_arrays(spark, str(tmp_path / "sets"), "sentiment", ["en"], range_bytes=64)
    assert [r["input"] for r in back.orderBy("item_no").collect()] == [*ODD, None]
