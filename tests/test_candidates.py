"""Pieces and candidate ids of answer words."""

import random
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from polyprobe import locales
from polyprobe.functions import words as W
from polyprobe.functions.trie import Codes, PieceTrie, PrefixForest
from polyprobe.operators import candidates as cand, lens
from polyprobe.sources import dimensions as dim, driver_tables as src

# Expected pieces per language: (positive, negative), worked out by hand from the fixture vocabulary.
SENTIMENT = {
    "en": ("p po pos posit positiv positive ▁p ▁pos ▁positive", "n ne neg negativ negative ▁n ▁neg ▁negative"),
    "de": ("p po pos posit positiv ▁p ▁pos", "n ne neg negativ ▁n ▁neg"),
    "es": ("p po pos posit positiv positivo ▁p ▁pos", "n ne neg negativ negativo ▁n ▁neg"),
    "fr": ("p po pos positif posit ▁p ▁pos", "n né négatif ▁n"),
    "zh": ("<0xE7> 积 积极", "<0xE6> 消 消极"),
    "ru": ("<0xD0> п по поз", "<0xD0> о от отри"),
    "is": ("j já ▁j", "n ne ▁n"),
}
ENGLISH = {
    "entailment": "e ent entail ▁ent", "neutral": "n ne neutral ▁n ▁neutral", "contradiction": "c con contra ▁con",
    "same": "s same ▁same", "different": "d diff different ▁diff", "ox": "o ox", "horse": "h horse ▁horse",
}


def _pieces(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "word string")
    ids = cand.candidate_ids(df, src.vocab(spark), ["word"])
    named = cand.ids_to_pieces(ids, src.vocab(spark), ["word"])
    return {r["word"]: set(r["pieces"]) for r in named.collect()}


def test_expected_candidates(spark):
    want = {w: set(p.split()) for w, p in ENGLISH.items()}
    for lang, (pos, neg) in SENTIMENT.items():
        want[locales.SENTIMENT_POSITIVE[lang]] = set(pos.split())
        want[locales.SENTIMENT_NEGATIVE[lang]] = set(neg.split())
    assert _pieces(spark, sorted(want)) == want


def test_word_without_candidates_keeps_an_empty_list(spark):
    df = spark.createDataFrame([("zzz",), ("",)], "word string")
    rows = cand.candidate_ids(df, src.vocab(spark), ["word"]).collect()
    assert {r["word"]: r["token_ids"] for r in rows} == {"zzz": [], "": []}


def _python_byte_piece(word):
    if not word:
        return None
    shown = str(word[0].encode())[2:-1]
    return f"<0x{shown[2:4].upper()}>" if shown.startswith("\\x") else None


@pytest.mark.parametrize("word", ["積", "p", "é", "\x01a", "\tb", "\nc", "\rd", "\x7f", " e", "'", "\\", "€", "😀", ""])
def test_byte_piece_follows_the_bytes_repr(spark, word):
    got = spark.createDataFrame([(word,)], "word string").select(W.byte_fallback_piece(F.col("word"))).first()[0]
    assert got == _python_byte_piece(word)


def test_prefixes_count_code_points(spark):
    word = "เชิงบวก"
    got = spark.createDataFrame([(word,)], "w string").select(W.token_prefixes(F.col("w"))).first()[0]
    assert got == [word[:i] for i in range(1, len(word) + 1)]


def test_tokenizer_adds_first_tokens(spark):
    df = spark.createDataFrame([("Négatif",)], "word string")
    plain = cand.candidate_ids(df, src.vocab(spark), ["word"]).first()["token_ids"]
    more = cand.candidate_ids(df, src.vocab(spark), ["word"], load_tokenizer=src.load_folding_tokenizer).first()["token_ids"]
    names = lambda ids: {src.PIECES[i] for i in ids}
    assert names(plain) == set()
    assert names(more) == {"n", "ne", "neg"}


def test_shared_stem_is_split_off(spark):
    words = dim.answer_words(spark, [("sentiment", "native")])
    stems = {r["lang"]: r["stem"] for r in cand.with_forced_stem(words).select("lang", "stem").distinct().collect()}
    assert stems.pop("th") == "เชิง"
    assert set(stems.values()) == {""}
    rest = {r["class"]: r["rest"] for r in cand.with_forced_stem(words).filter("lang = 'th'").collect()}
    assert rest == {"positive": "บวก", "negative": "ลบ"}


def test_class_table_covers_every_locale(spark):
    table = src.classes(spark, locales.TASK_MODES).collect()
    assert len(table) == 2 * len(locales.TASK_MODES) * len(locales.LANGUAGES)
    assert all([c["class"] for c in r["classes"]] == sorted(c["class"] for c in r["classes"]) for r in table)


def test_lens_keeps_half_of_icelandic(spark):
    sets = src.sets(spark, ["base"])
    kept = {(r["lang"], r["class"]) for r in lens.usable_sets(sets).select("lang", "class").collect()}
    assert {("en", "positive"), ("en", "negative"), ("zh", "positive"), ("zh", "negative"), ("is", "positive")} <= kept
    assert not {("is", "negative"), ("de", "positive"), ("es", "negative"), ("fr", "positive")} & kept


def test_lens_with_no_usable_item_is_empty(spark):
    items = spark.createDataFrame([("sentiment", "de", "positiv", 0)], "task string, lang string, answer string, item_no int")
    assert lens.lens_filter(items, src.sets(spark, ["base"])).count() == 0


def test_large_configuration_is_refused(spark):
    with pytest.raises(ValueError):
        dim.localize(spark, "too-large", lambda: spark.range(dim.MAX_LOCAL_ROWS + 5))


def test_demonstrations_use_the_labels_of_their_language():
    for row in locales.locale_rows():
        assert row["demo_block"].count(f'{row["answer_field"]}: "') == row["n_shots"]
        for field in (row["field1"], row["field2"]):
            if field:
                lines = row["demo_block"].splitlines()
                assert sum(line.startswith(f"{field}: ") for line in lines) == row["n_shots"]


def test_unrelated_native_words_where_present():
    rows = locales.answer_word_rows([("sentiment", "unrelated_native")])
    assert {r["lang"] for r in rows} == set(locales.LANGUAGES) - {"fr", "nl"}


# ---- trie and prefix forest -------------------------------------------------

def _brute(word, ids, first=None):
    spelled = [word[:n] for n in range(1, len(word) + 1)]
    found = {ids[t] for p in spelled for t in (p, W.WORD_START + p) if t in ids}
    piece = _python_byte_piece(word)
    found |= {ids[piece]} if piece in ids else set()
    return sorted(found | ({first(p) for p in spelled} - {None} if first else set()))


ODD_WORDS = ["", "a", "aa", "▁", "▁a", "▁▁a", "積極", "積x", "éa", "é", "👍a", "\x01", "\t", "<0xE7>", "ab" * 40, "￿"]


@pytest.fixture(scope="module")
def random_vocab(spark):
    rng = random.Random(3)
    pieces = {"".join(rng.choices("ab▁é積👍", k=rng.randint(1, 5))) for _ in range(400)}
    pieces |= {f"<0x{b:02X}>" for b in range(0, 256, 3)} | {"￿", "<", "<0"}
    ids = {p: i * 7 for i, p in enumerate(sorted(pieces))}
    return ids, spark.createDataFrame(list(ids.items()), "piece string, token_id int")


@pytest.fixture(scope="module")
def random_words():
    rng = random.Random(5)
    return sorted({*ODD_WORDS, *("".join(rng.choices("ab▁é積👍x", k=rng.randint(1, 9))) for _ in range(500))})


def _load_first():
    def first(text):
        return None if text.endswith("x") else len(text) % 3 if "b" in text else 900
    return cand.FirstTokenizer(lambda texts: [first(t) for t in texts])


@pytest.mark.parametrize("load", [None, _load_first])
@pytest.mark.parametrize("cut", [False, True])
def test_trie_equals_plain_lookup(spark, monkeypatch, random_vocab, random_words, cut, load):
    ids, vocab = random_vocab
    if cut:  # as if the vocabulary were too large to ship
        monkeypatch.setattr(cand, "MAX_PIECES", 10)
        monkeypatch.setattr(cand, "PART_WORDS", 20)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    words = spark.createDataFrame([(w, k) for k, w in enumerate(random_words)], "word string, k int")
    got = {r["word"]: r["token_ids"] for r in cand.candidate_ids(words, vocab, ["k", "word"], load_tokenizer=load).collect()}
    first = load and (lambda t: load().first([t])[0])
    assert got == {w: _brute(w, ids, first) for w in random_words}


def test_null_words_and_empty_vocabularies(spark):
    words = spark.createDataFrame([(1, None), (2, "a")], "k int, word string")
    none = spark.createDataFrame([], "piece string, token_id int")
    for vocab in (none, src.vocab(spark)):
        rows = {r["k"]: r["token_ids"] for r in cand.candidate_ids(words, vocab, ["k", "word"]).collect()}
        assert rows[1] == [] and 2 in rows
    ids = spark.createDataFrame([(1, [5, 4, None, 999]), (2, []), (3, None)], "k int, token_ids array<int>")
    named = {r["k"]: r["pieces"] for r in cand.ids_to_pieces(ids, src.vocab(spark), ["k"]).collect()}
    assert named == {1: [src.PIECES[5], src.PIECES[4]], 2: [], 3: []}


def test_a_piece_with_two_ids_is_refused():
    with pytest.raises(ValueError, match="two ids"):
        PieceTrie(["a", "a"], [1, 2])


def test_a_megabyte_word_takes_steps_of_the_longest_piece(spark):
    word = "positive" * 131_072
    words = spark.createDataFrame([(word,), ("pos",)], "word string")
    for load in (None, src.load_folding_tokenizer):
        rows = cand.candidate_ids(words, src.vocab(spark), ["word"], load_tokenizer=load).collect()
        ids = {r["word"]: r["token_ids"] for r in rows}
        assert {src.PIECES[i] for i in ids[word]} == set("p po pos posit positiv positive ▁p ▁pos ▁positive".split())


def test_words_are_one_row_each_and_move_nowhere(spark):
    words = spark.range(10).select(F.col("id").cast("string").alias("word"))
    plan = cand.ids_to_pieces(cand.candidate_ids(words, src.vocab(spark), ["word"]), src.vocab(spark), ["word"]) \
        ._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Exchange", "Generate", "Join", "Aggregate"))


def test_every_prefix_is_coded_once_per_batch():
    texts = ["abc", "abd", "ab", "x", ""]
    column = pa.array(texts)
    forest = PrefixForest(texts, Codes(column, 10))
    assert sorted(forest.names) == ["a", "ab", "abc", "abd", "x"]
    rows, ids = forest.first_tokens([{"a": 1, "ab": 1, "abc": 2, "abd": 1, "x": None}[n] for n in forest.names])
    assert sorted(zip(rows.tolist(), ids.tolist())) == [(0, 1), (0, 2), (1, 1), (2, 1)]
