"""Token alignment, spelling groups and piece coding against plain versions."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polyprobe.llm import piece_coding, spelling, token_alignment as ta
from polyprobe.llm.queries import QUERIES

BYTE_LEVEL, RANKS, PIECES = (P.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "\t", "a", "the", "ing", "x", "é", "Ä", "中", "日本", "👍", "▁", "▁▁", "<0x0A>", "<s>", "</s>", "<unk>",
         "<|endoftext|>", " ", "﻿", "\x00", "​", "̈", "0", "12", "...", "'s", "ß", "ﬁ", "\r\n", "     ", "×",
         "Ａ", "ab" * 40, " ", "²", "𝔘"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(4)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(1500)] + [None, "", " ", "\n", "a" * 5000, " " * 700]


# ---- piece coding -----------------------------------------------------------

def test_ids_and_texts_equal_the_library(spark, odd_texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id bigint, text string")
    rows = piece_coding.round_trip(docs, PIECES).collect()
    assert len(rows) == len(odd_texts) and all(r["agrees"] for r in rows)
    for r in rows:
        ids = lib.encode(odd_texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["decoded"] == lib.decode(ids)


def test_query_gives_the_digests(spark, sf_dir):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op13_piece_coding"](spark, sf_dir).collect():
        ids = lib.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["agrees"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def _plain_merges(coder, text):
    """Join the best leftmost pair until none is a piece, looking at all pairs each time."""
    lib = coder.library
    ids = {lib.id_to_piece(i): i for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    symbols = list((" " + text).replace(" ", "▁"))
    while True:
        pairs = [(-lib.get_score(ids[a + b]), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ids]
        if not pairs:
            break
        k = min(pairs)[1]
        symbols[k: k + 2] = [symbols[k] + symbols[k + 1]]
    return [i for s in symbols for i in ([ids[s]] if s in ids else [lib.piece_to_id(f"<0x{b:02X}>") for b in s.encode()])]


def test_agenda_takes_the_best_pair_first(odd_texts):
    """Short units in step, long ones on a heap: both join as the plain rule does."""
    coder = piece_coding.coder(PIECES)
    some = [t for t in odd_texts if t][:120] + ["international" * 12, "the quick brown fox", "aaaaaaaaaaaaaaaaaaaaaaaaa"]
    assert [ids.tolist() for ids in coder.encode(some)] == [_plain_merges(coder, t) for t in some]
    unit = "internationalisation"
    assert coder.agenda._queued(unit) == coder.agenda._stepped([unit])[0]


def test_the_memory_of_units_may_be_forgotten(monkeypatch, odd_texts):
    coder = piece_coding.PieceCoder(PIECES)
    want = [ids.tolist() for ids in coder.encode([t or "" for t in odd_texts])]
    monkeypatch.setattr(piece_coding, "CACHE_UNITS", 3)
    assert [coder.encode([t or ""])[0].tolist() for t in odd_texts] == want


def test_a_text_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(piece_coding, "_SLICE", 1000)
    text = "some words that go on, " * 400 + "z" * 3000
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, text)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in piece_coding.round_trip(docs, PIECES).collect()}
    assert all(r["agrees"] for r in rows.values()) and rows[1]["decoded"] == text and rows[3]["ids"] == rows[1]["ids"]


# ---- token alignment --------------------------------------------------------

def _brute_alignment(texts):
    a_coder, b_coder = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_coder.encode_special_tokens = True
    with open(BYTE_LEVEL, encoding="utf-8") as f:
        spelled = {i: p for p, i in json.load(f)["model"]["vocab"].items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}

    def placed(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at += len(of(i))
        return out

    def of_a(i):
        return bytes(byte[c] for c in spelled[i])

    def of_b(i):
        p = b_coder.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_coder.is_byte(i) else p.replace("▁", " ").encode()

    per, counts = [], collections.Counter()
    for text in texts:
        goal = (" " + text).encode() if text else b""
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        if b"".join(map(of_a, a)) != goal or b"".join(map(of_b, b)) != goal:
            a = b = []
        left, right = placed(a, of_a), placed(b, of_b)
        ends = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
        groups, links, before = [], [], 0
        for end in ends:
            own = [[t for t in side if before <= t[0] and t[1] <= end] for side in (left, right)]
            groups.append("|".join(",".join(str(t[2]) for t in side) for side in own))
            links += [(x[2], y[2]) for x in own[0] for y in own[1] if x[0] < y[1] and y[0] < x[1]]
            before = end
        counts.update(set(links))
        per.append((len(a), len(b), groups, links))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    return [(n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "") for n_a, n_b, groups, links in per]


def _aligned(docs, ranks=RANKS):
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = ta.align(docs, BYTE_LEVEL, PIECES, ranks).withColumn("sha", digest).drop("groups")
    rows = ta.with_link_counts(found).collect()
    return {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")) for r in rows}


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_alignment_equals_the_plain_version(spark, odd_texts, monkeypatch, ranks):
    """Many small blocks, so that counts cross blocks; special names and odd spaces stay text."""
    monkeypatch.setattr(ta, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(ta, "_SLICE", 700)
    some = odd_texts[-406:]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string").repartition(3)
    got = _aligned(docs, ranks)
    assert [got[k] for k in range(len(some))] == _brute_alignment(some)


def test_alignment_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = [tuple(r[c] for c in names) for r in QUERIES["op11_token_alignment"](spark, sf_dir).orderBy("doc_id").collect()]
    assert got == _brute_alignment([r["text"] for r in rows])


def test_intervals_coalesce_over_chains():
    start, end = np.array([0, 4, 2, 9, 5]), np.array([3, 5, 4, 12, 9])
    assert ta.coalesced(start, end).tolist() == [0, 1, 0, 3, 2]


def test_rank_coder_and_file_coder_cut_alike():
    """Every character the rank coder may see, beside letters, digits, spaces and marks."""
    side, exact = ta.byte_level_side(BYTE_LEVEL, RANKS), ta.byte_level_side(BYTE_LEVEL, None)
    points = [c for c in [*range(0x250), *range(0x2010, 0x2028)] if not 0xD800 <= c < 0xE000]
    texts = [pattern.format(chr(c)) for c in points for pattern in ("a{0}b", "1{0} {0}2", ". {0}  {0}\n{0}", "{0}{0}'s é{0}")]
    assert not any(ta._ODD.search(t) for t in texts)
    assert [list(x) for x in side.code(texts)] == [list(x) for x in exact.code(texts)]


def test_narrow_numbers_come_back():
    for x in ([], [0], [255], [256], [65_536, 1], [2**31]):
        assert ta._widened(ta._narrow(np.array(x, np.int64))).tolist() == x


# ---- spelling groups --------------------------------------------------------

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute_counts(rows, slip):
    n = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(_LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return n


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _brute_groups(n, length=5, least=3):
    words = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    gone = collections.defaultdict(set)
    for w in words:
        for form in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            gone[form].add(w)
    near = collections.defaultdict(set)
    for close in gone.values():
        for a in close:
            near[a] |= {b for b in close if a != b and _one_edit(a, b)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), c, len(near[w]), words[form[w]] if w in form else None) for w, c in words.items()}


def _groups(frame):
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in frame.collect()}


def test_spelling_query_equals_the_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = _brute_groups(_brute_counts(rows, 97))
    got = _groups(QUERIES["op12_spelling_groups"](spark, sf_dir))
    assert got == want and sum(w[0] is not None for w in want.values()) > 100


@pytest.mark.parametrize("bucket,part", [(5, 3), (40, 1000), (10_000, 7)])
def test_buckets_and_parts_of_any_size_give_the_same(spark, bucket, part):
    """Few letters, so that boxes meet many buckets; anagrams, doubled letters, chains of forms."""
    rng = random.Random(bucket)
    words = ["".join(rng.choices("abcé", k=rng.randint(4, 8))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)] + ["banana-banana_banana banan4 BANANA Éa×÷ßÿa"]
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    texts += [" ".join([w] * 4 ** (5 - k)) for k, w in enumerate(chain)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "bbbbbb " * 5), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = _groups(spelling.spelling_groups(docs, slip_every=5, bucket=bucket, part=part))
    want = _brute_groups(_brute_counts(rows, 5))
    assert got == want
    assert len({w[1] for w in want.values()}) < len(want)


def test_long_words_and_frequent_letters(spark):
    base = "ab" * 20_000
    texts = [f"{base} " * 3, f"{base}a " * 9, f"{base[:-1]}c " * 4, f"x{base} " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = _groups(spelling.spelling_groups(docs))
    assert got[base] == (base + "a", base + "a", 3, 3, 9)
    assert got[base[:-1] + "c"][3] == 1 and got["x" + base][0] is None


def test_local_trees_hold_every_row_once():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 3, (500, len(spelling.LETTERS))).astype(np.int16)
    counts[100:180] = counts[0]
    tree, members = spelling.local_tree(counts, 8)
    assert sorted(np.concatenate(list(members.values())).tolist()) == list(range(500))
    for leaf, rows in tree.visits(0, counts, 0, 0):
        assert set(rows.tolist()) == set(members[leaf].tolist())


def test_one_inserted_letter():
    a = np.array([list(b"abab"), list(b"abab"), list(b"aaaa")], np.uint8)
    b = np.array([list(b"abbab"), list(b"baabb"), list(b"aaaaa")], np.uint8)
    assert spelling._one_inserted(a, b).tolist() == [True, False, True]


def test_latin_words_are_a_byte_a_letter():
    assert spelling.latin(pa.array(["é", "ab"])) == [b"\xe9", b"ab"]
