"""Near-duplicates, repeated bytes, quality counts and language-model scores against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from polyprobe.llm import lm_scoring, neardup, quality_rules, suffix_dedup, textstats
from polyprobe.llm.common import table
from polyprobe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").toPandas()


def _shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i: i + size]) for i in range(max(len(w) - size + 1, 1)))


def _components(texts, size, percent):
    sets = {k: _shingles(t, size) for k, t in texts}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k in sorted(sets):
        common = Counter(j for s in sets[k] for j in where[s])
        for s in sets[k]:
            where[s].append(k)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                a, b = sorted((root(k), root(j)))
                parent[b] = a
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_near_duplicates_of_the_documents(spark, sf_dir, documents):
    out = QUERIES["op10_minhash_neardup"](spark, sf_dir).collect()
    want = _components(zip(documents.doc_id, documents.text), 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_beyond_one_hub(spark):
    """Many edited copies, most of which fail against the smallest id and link only among themselves."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(draw.choice([1, 2, 3, 4])):
            words[draw.randrange(60)] = f"e{draw.randrange(6)}"
        rows.append((k, " ".join(words)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == _components(rows, 4, 80)


def test_densified_bins_agree_as_often_as_sets_do():
    draw = np.random.default_rng(1)
    for n in (10, 400):
        rates = []
        for _ in range(60):
            pool = np.unique(draw.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(pool[: int(0.9 * n)]), np.sort(pool[int(0.1 * n):])
            rates.append((neardup.one_permutation(a) == neardup.one_permutation(b)).mean())
        assert abs(np.mean(rates) - 0.8) < 0.04


def _repeats(texts, span):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i: i + span] for b in bodies for i in range(len(b) - span + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - span + 1):
            if seen[b[i: i + span]] > 1:
                gone[i: i + span] = b"\x01" * span
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone[:len(b)]), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_bytes_of_the_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in QUERIES["op6_suffix_dedup"](spark, sf_dir).collect()}
    assert got == dict(zip(documents.doc_id, _repeats(documents.text, 200)))


@pytest.mark.parametrize("heavy", [20_000, 2, 0])
def test_repeated_bytes_however_contexts_are_gathered(spark, heavy):
    draw = random.Random(3)
    common = "".join(draw.choice("abcdé ") for _ in range(900))
    texts = [None, "", "a" * 199, "a" * 700, "ab" * 300, common, common[:450] + "x" + common[450:], common[100:380],
             common[200:500] + "Q" * 230, "w" * 10 + common[150:420] * 2, "Eaea " * 90 + "theor " * 60, common]
    texts += ["".join(draw.choice("klm") for _ in range(draw.randint(0, 150)))
              + common[draw.randint(0, 300): draw.randint(350, 900)] + str(k) * draw.randint(0, 90) for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = suffix_dedup.repeated_bytes(docs, heavy=heavy)
    rows = docs.select("doc_id", suffix_dedup.text_digest().alias("digest")).join(found, "digest").collect()
    got = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]),
                         hashlib.sha256(r["kept"]).hexdigest()) for r in rows}
    assert got == dict(enumerate(_repeats(texts, 200)))


def test_common_extensions():
    text = suffix_dedup.Suffixes([b"banana-ban", b"bandana", b"banana"])
    a, b = text.begins[[0, 0]], text.begins[[2, 1]]
    assert text.common(a, b, np.array([6, 7]), 1).tolist() == [6, 3]
    assert text.common(a + 6, b + 6, np.array([6, 6]), -1).tolist() == [6, 0]


def _plain_counts(text):
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w, lines = word.findall(text), [x for x in text.split("\n") if word.search(x)]
    triples = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if triples[tuple(w[i: i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)),
            len(hit))


def test_quality_counts(documents):
    texts = [*documents.text, "", None, " \n\n ", "a b c a b c\n\na b c a b c", "x\r\ny\r\nx\r\n", " é\x0bü ", "a\nb\na"]
    found = textstats.counts(pa.array(texts))
    assert list(zip(*(found[c].tolist() for c in textstats.COUNTS))) == [_plain_counts(t) for t in texts]


def test_quality_rules_match_a_plain_estimate(spark, sf_dir, documents):
    """Distances of one small-group estimate, recomputed with numpy from the same central subset rule."""
    out = QUERIES["op8_quality_rules"](spark, sf_dir).toPandas()
    plain = {i: _plain_counts(t) for i, t in zip(documents.doc_id, documents.text)}
    for r in out.itertuples():
        n_words, chars, symbols, _, dup, repeat = plain[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, dup, repeat)
        assert r.base_failed == (n_words < 50 or 100 * repeat > 50 * n_words)
        assert r.kept == (not r.base_failed and r.distance <= quality_rules.LIMIT)


def test_robust_estimate_ignores_outliers(spark):
    draw = np.random.default_rng(2)
    regular = draw.normal([2, .3, .4, .5], [.3, .2, .3, .4], (4000, 4))
    wild = draw.normal([6, 4, 4, 4], .1, (800, 4))
    rows = [("g", *map(float, v)) for v in np.vstack([regular, wild])]
    got = quality_rules.robust_estimates(spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, x4 double"))
    row = got.first()
    spread = np.linalg.inv(np.array(row["precision"]).reshape(4, 4)) - np.diag(np.square(quality_rules.RESOLUTION))
    assert np.allclose(row["centre"], [2, .3, .4, .5], atol=.05)
    assert np.allclose(np.sqrt(np.diag(spread)), [.3, .2, .3, .4], atol=.05)


def test_chi_squared_points():
    assert abs(quality_rules._chi2_point(0.05, 2) - 9.4877) < 1e-3
    assert abs(quality_rules._chi2_point(0.01, 2) - 13.2767) < 1e-3


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_scores(spark, order):
    rows = [(1, "a b c a b c d"), (2, "a b c"), (3, None), (4, ""), (5, "z"), (6, "b c a b c d"), (6, "q a b")]
    counts = [Counter() for _ in range(order + 1)]
    for _, t in rows:
        w = (t or "").split()
        for k in range(1, order + 1):
            counts[k].update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    total = sum(counts[1].values())

    def word(g):
        if len(g) == 1:
            return math.log(max(counts[1][g] - 1, .5) / total)
        if counts[len(g)][g] > 1:
            return math.log((counts[len(g)][g] - 1) / (counts[len(g) - 1][g[:-1]] - 1))
        return math.log(.4) + word(g[1:])

    want = defaultdict(float)
    for d, t in rows:
        w = (t or "").split()
        want[d] += sum(word(tuple(w[max(0, i - order + 1): i + 1])) for i in range(len(w)))
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string"), order).collect()
    assert {r["doc_id"]: round(r["log_score"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_repeated_lines_are_outliers_of_a_clean_group(spark):
    """Clean texts of 40 lines, some with one repeated line, and planted ones of which three quarters of the lines repeat."""
    draw = random.Random(8)

    def lines(n):
        return [" ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(6)) for _ in range(n)]

    clean = [lines(40) for _ in range(200)]
    for own in clean[:20]:
        own[1] = own[0]
    # One word a line, drawn from eight, so few words lie in repeated windows.
    common = [x.split()[0] for x in lines(8)]
    planted = [[x for own in lines(30) for x in (own, *draw.choices(common, k=4))] for _ in range(10)]
    rows = [(i, "\n".join(x), "en", "s") for i, x in enumerate(clean + planted)]
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert {r["doc_id"] for r in out if r["kept"]} == set(range(200))
