"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from polyprobe.llm import (decontamination, extraction, lm_scoring, neardup, packing, piece_coding, pii,
                           quality_classifier, quality_rules, spelling, suffix_dedup, token_alignment, toxicity)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} number {i}." for i in range(30_000))
ROWS = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, "one", "en", "s", 3),
        (5, LONG, "en", "s", len(LONG)), (5, LONG, "en", "s", len(LONG)), (6, "ÄÖ ß\x0b€ 👍", None, "s", 9),
        (None, "no id here", "de", "t", 10), (7, "a b c d e f", "de", "t", 11), (7, "f e d c b a", "de", "t", 11)]
#: Names that operators use inside.
CLASHES = ("key rep hub label h tid digest spans row host token rank at task id item_at slots hash g d c x1 distance "
           "y fold text_x n_replaced prefix suffix __masked __text").split()


def _labels(spark, rows=((4, 1, 0), (5, 1, 1), (7, 0, 1), (2, None, None), (99, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def _benchmark(spark):
    return spark.createDataFrame([(1, "A b, c d e f."), (2, None), (3, ""), (None, "x")],
                                 "item_id bigint, text string")


def _toxic(spark, docs):
    return toxicity.score_texts(docs, toxicity.train(docs, _labels(spark), F.lit(True)))


def _alignment(spark, docs):
    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    return token_alignment.with_link_counts(token_alignment.align(docs, *paths))


OPERATORS = {
    "lm": lambda s, d: lm_scoring.score(d, 2),
    "pii": lambda s, d: pii.mask(d, "k").select("doc_id", "text", "n_replaced"),
    "packing": lambda s, d: packing.pack(d, TOKENIZER),
    "decontamination": lambda s, d: decontamination.leaks(d, _benchmark(s)),
    "extraction": lambda s, d: extraction.extract(d, "doc_id", "lang", "text"),
    "suffix": lambda s, d: suffix_dedup.repeated_bytes(d),
    "toxicity": _toxic,
    "quality_rules": lambda s, d: quality_rules.judge(d),
    "quality_classifier": lambda s, d: quality_classifier.cotrain(d, _labels(s)),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "alignment": _alignment,
    "spelling": lambda s, d: spelling.spelling_groups(d, slip_every=97),
    "piece_coding": lambda s, d: piece_coding.round_trip(d, public_tokenizers.path("piece_bpe_32k.model")),
}
#: Rows each operator returns for ``ROWS``.
EXPECTED = {"lm": 8, "pii": 10, "extraction": 10, "suffix": 8, "toxicity": 10, "quality_rules": 10,
            "quality_classifier": 10, "neardup": 7, "alignment": 10, "piece_coding": 10}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_names(spark, docs, name):
    plain = OPERATORS[name](spark, docs)
    wide = docs.withColumns({c: F.lit("x") for c in CLASHES})
    clash = OPERATORS[name](spark, wide)
    a, b = ([tuple(map(str, r)) for r in f.collect()] for f in (plain, clash))
    assert sorted(a) == sorted(b)
    assert len(a) == EXPECTED.get(name, len(a))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], DOCS)).count() == 0


def test_defined_results(spark, docs):
    def rows(frame):
        return {r["doc_id"]: r for r in frame.collect()}

    near = rows(neardup.near_duplicates(docs))
    assert all(near[k]["kept"] and near[k]["n_shingles"] == 0 for k in (1, 2, 3))
    aligned = rows(_alignment(spark, docs))
    assert all(aligned[k]["n_a"] == aligned[k]["n_links"] == aligned[k]["count_sum"] == 0 for k in (1, 2))
    coded = rows(piece_coding.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")))
    assert coded[1]["ids"] == coded[2]["ids"] == [] and coded[1]["decoded"] == "" and coded[5]["decoded"] == LONG
    spelt = {r["word"]: r for r in spelling.spelling_groups(docs).collect()}
    assert spelt["number"]["n"] == 60_000 and spelt["number"]["root"] == "number"
    lm = rows(lm_scoring.score(docs, 2))
    assert lm[1]["n_words"] == 0 and lm[1]["log_score"] == 0 and None in lm
    packed = packing.pack(docs, TOKENIZER).where("doc_id in (1, 2, 3)").collect()
    assert [r["length"] for r in packed] == [1, 1, 1]
    masked = rows(pii.mask(docs, "k"))
    assert masked[1]["text"] is None and masked[2]["text"] == ""
    rules = rows(quality_rules.judge(docs))
    assert rules[1]["base_failed"] and rules[1]["n_words"] == 0 and not rules[1]["kept"]
    toxic = rows(_toxic(spark, docs))
    assert toxic[1]["score"] == toxic[2]["score"]
    removed = {r["digest"]: r for r in suffix_dedup.repeated_bytes(docs).collect()}
    both = [r for r in removed.values() if r["n_bytes"] == len(LONG)]
    assert len(both) == 1 and both[0]["kept"] == b""
    leaked = decontamination.leaks(docs, _benchmark(spark)).select("doc_id", "item_id").collect()
    assert [tuple(r) for r in leaked] == [(7, 1)]


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    sf_dir = str(tmp_path)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    _benchmark(spark).write.parquet(f"{sf_dir}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert "sequence_id" in out.columns and out.count() >= 0
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, sf_dir).columns == table.columns, name
