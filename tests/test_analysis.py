"""Statistics, linear algebra and representation against numpy."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from polyprobe.operators import positions, readout, representation as rep, sampling, stats, tiles
from polyprobe.plans import catalog, lens as lp, representation as rp
from polyprobe.sources import driver_tables as src


def test_positions_equal_a_plain_window(spark):
    df = spark.range(5000).select(
        (F.col("id") * 37 % 9973).alias("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    plain = F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1
    got = positions.with_item_no(df, ["g"], "id").withColumn("want", plain)
    assert got.filter("item_no != want").count() == 0
    assert got.count() == 5000


def _metric(spark, values, key="g"):
    return spark.createDataFrame([(key, float(v)) for v in values], "g string, v double")


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    # A third of the values are one value; the others differ in sign and by hundreds of magnitudes.
    values = np.concatenate([rng.normal(size=700), rng.normal(size=700) * 10.0 ** rng.integers(-300, 300, 700), np.zeros(700)])
    probs = (0.0, 0.05, 0.31, 0.5, 0.95, 1.0)
    frame = _metric(spark, values, "a").union(_metric(spark, values[:7], None)).union(_metric(spark, [-0.0, 0.0, np.inf, -np.inf], "c"))
    got = {r["g"]: r["quantiles"] for r in stats.exact_quantiles(frame, ["g"], "v", probs).collect()}
    assert np.allclose(got["a"], np.quantile(values, probs), rtol=1e-12, atol=0)
    assert np.allclose(got[None], np.quantile(values[:7], probs), rtol=1e-12, atol=0)
    assert got["c"][0] == -np.inf and got["c"][-1] == np.inf and got["c"][3] == 0.0


def test_bits_keep_the_order_of_doubles(spark):
    values = [-np.inf, -1e300, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(stats.ordered_bits(F.col("v")).alias("b"))
    bits = [r["b"] for r in rows.collect()]
    assert bits == sorted(bits) and bits[4] == bits[5]


def test_selection_moves_counts_only(spark):
    plan = stats.exact_quantiles(_metric(spark, range(100)), ["g"], "v", (0.5,))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort [" not in plan and "ResolvedHint" not in plan


def test_quantiles_of_one_value(spark):
    assert stats.exact_quantiles(_metric(spark, [3.5]), ["g"], "v", (0.05, 0.5)).first()["quantiles"] == [3.5, 3.5]


def test_gaussian_interval(spark):
    values = np.arange(20.0)
    row = stats.ci_gaussian(_metric(spark, values), ["g"], ["v"]).first()
    half = 1.96 * values.std(ddof=1) / np.sqrt(20)
    assert np.allclose([row["mean"], row["lower"], row["upper"]], [9.5, 9.5 - half, 9.5 + half])
    one = stats.ci_gaussian(_metric(spark, [1.0]), ["g"], ["v"]).first()
    assert one["mean"] == 1.0 and one["lower"] is None


def test_bootstrap_interval(spark):
    rows = [("g", layer, i, float(i % 7) + layer) for layer in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, layer int, item_no bigint, v double")
    got = {r["layer"]: r for r in stats.ci_bootstrap(df, ["g"], "layer", "v", resamples=300, seed=3).collect()}
    again = {r["layer"]: r for r in stats.ci_bootstrap(
        df.repartition(5), ["g"], "layer", "v", resamples=300, seed=3).collect()}
    for layer, r in got.items():
        assert r["y_lower"] < r["y"] < r["y_upper"]
        assert np.isclose(r["y_lower"], again[layer]["y_lower"]) and np.isclose(r["y_upper"], again[layer]["y_upper"])
    # One set of draws serves both layers.
    assert np.isclose(got[1]["y_lower"] - got[0]["y_lower"], 1.0)


def test_bootstrap_draws_an_item_once_for_all_keys(monkeypatch):
    drawn, draw = [], stats.poisson_weights
    monkeypatch.setattr(stats, "poisson_weights", lambda item, each, seed: drawn.extend(item) or draw(item, each, seed))
    rng = np.random.default_rng(0)
    items, codes = np.repeat(rng.permutation(150) - 9, 12), np.tile(np.arange(12), 150)
    # A key may hold an item twice, or not at all.
    items, codes = np.append(items[:-1], items[0]), np.append(codes[:-1], codes[0])
    values = rng.normal(size=len(items))
    got = stats.resampled_sums(items, codes, values, 12, 40, 3)
    assert sorted(drawn) == sorted(set(items))
    for key in range(12):
        w = draw(items[codes == key], np.arange(40), 3)
        assert np.allclose(got[key], [w.sum(axis=0), values[codes == key] @ w])


def test_bootstrap_with_null_groups(spark):
    rows = [(None if i % 2 else "g", i % 3 or None, i, float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, layer int, item_no bigint, v double")
    got = {(r["g"], r["layer"]) for r in stats.ci_bootstrap(
        df, ["g"], "layer", "v", resamples=50).collect()}
    assert got == {("g", 1), ("g", 2)}


def _peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_products_stay_small_for_a_large_matrix():
    z, u = np.random.default_rng(0).normal(size=(300, 8)), np.random.default_rng(1).normal(size=(90_000, 8))
    ids = np.arange(90_000) * 2 - 70_000
    assert _peak_mb(lambda: readout._Logits.of(z[:40], ids, u)) < 8
    found = readout._Logits.of(z, ids, u)
    x = z @ u.T
    w = np.exp(x - x.max(axis=1, keepdims=True))
    assert (found.top_id == ids[x.argmax(axis=1)]).all() and found.n_tokens == 90_000
    assert np.allclose([found.low, found.high, found.total], [x.min(axis=1), x.max(axis=1), x.sum(axis=1)])
    assert np.allclose([found.weight, found.spread], [w.sum(axis=1), (w * (x - x.max(axis=1, keepdims=True))).sum(axis=1)])
    equal = readout._Logits.of(z, ids, np.tile(u[:1], (90_000, 1)))
    assert (equal.top_id == ids[0]).all()
    lost = readout._Logits.of(z[:2], ids, np.where(np.arange(90_000)[:, None] == 77_777, np.nan, u))
    assert np.isnan(lost.high).all() and (lost.top_id == np.iinfo(np.int64).max).all()


def _ends(z, ids, u, cuts=()):
    found = None
    for part in np.split(np.arange(len(ids)), cuts):
        found = readout._Ends.of(z, ids[part], u[part], found)
    return found


def test_ends_found_in_single_precision_have_double_precision(monkeypatch):
    r = np.random.default_rng(5)
    z, u = r.normal(size=(70, 24)), r.normal(size=(9_000, 24))
    # Closer together than single precision can tell, in blocks far apart; the smaller id where they are equal.
    for n, k in enumerate(r.integers(0, 9_000, 60)):
        u[k] = 3 * z[n % 30] * (1 + 1e-9 * n)
        u[(k + 4_500) % 9_000] = -u[k] * (1 + 1e-9)
    u[8_500:8_520], z[60] = u[7:27], 0.0
    ids = np.arange(9_000) * 3 - 70
    x = z @ u.T
    for sizes in ({}, {"SIEVE_TOKENS": 50, "SIEVE_BLOCKS": 7, "SIEVE_ROWS": 16, "SIEVE_BYTES": 4 * 50 * 16 * 2}):
        for name, value in sizes.items():
            monkeypatch.setattr(tiles, name, value)
        for cuts in ((), (1, 4_096, 8_499)):
            found = _ends(z, ids, u, cuts)
            assert found.n_tokens == 9_000 and (found.top_id == ids[x.argmax(axis=1)]).all()
            assert np.allclose([found.low, found.high], [x.min(axis=1), x.max(axis=1)], rtol=1e-14)
            assert np.allclose(found.total, x.sum(axis=1))


def test_ends_of_values_that_single_precision_does_not_hold():
    r = np.random.default_rng(6)
    z, u, ids = r.normal(size=(40, 8)), r.normal(size=(5_000, 8)), np.arange(5_000)
    for scale_z, scale_u in ((1e30, 1e30), (1e-30, 1e-30), (1e60, 1e-60), (1e-200, 1.0), (1.0, 1e200)):
        x = (z * scale_z) @ (u * scale_u).T
        found = _ends(z * scale_z, ids, u * scale_u, (2_048,))
        assert (found.top_id == x.argmax(axis=1)).all()
        assert np.allclose([found.low / x.min(axis=1), found.high / x.max(axis=1)], 1, rtol=1e-13)
    z[3], u[4_000, 2], u[77, 1] = np.nan, np.inf, -np.inf
    with np.errstate(all="ignore"):
        x = z @ u.T
        found = _ends(z, ids, u, (2_048,))
    assert np.allclose([found.low, found.high], [x.min(axis=1), x.max(axis=1)], rtol=1e-13, equal_nan=True)
    lost = np.isnan(x).any(axis=1)
    assert lost[3] and not lost.all()
    assert (found.top_id == np.where(lost, np.iinfo(np.int64).max, np.where(np.isnan(x), -np.inf, x).argmax(axis=1))).all()


def test_few_products_of_the_ends_take_double_precision(monkeypatch):
    r = np.random.default_rng(7)
    z, u, sizes, top = r.normal(size=(500, 16)), r.normal(size=(40_000, 16)), [], readout._top
    monkeypatch.setattr(readout, "_top", lambda x, ids: (sizes.append(x.size), top(x, ids))[1])
    assert _peak_mb(lambda: _ends(z, np.arange(40_000), u)) < 16
    assert 0 < sum(sizes) < 0.03 * 500 * 40_000


def test_readout_without_entropy_gives_the_other_columns(spark, sf_dir):
    latents = src.latents(spark, sf_dir, src.labelled(spark, sf_dir).select("doc_id", "lang", "item_no"), [1])
    small = {"tile_bytes": 64 * 8 * 70, "buffer_bytes": 64 * 8 * 30}
    whole, few = (
        readout.readout_logits(latents, ["doc_id"], src.unembed(spark, sf_dir), src.NORM_WEIGHT, entropy=e, **small)
        for e in (True, False))
    assert few.columns == [c for c in whole.columns if c != "entropy"]
    left, right = (f.drop("entropy").toPandas().sort_values("doc_id", ignore_index=True) for f in (whole, few))
    assert len(left) and (left[["doc_id", "n_tokens", "top_id"]] == right[["doc_id", "n_tokens", "top_id"]]).all(axis=None)
    assert np.allclose(left, right, rtol=1e-12)


def test_weights_of_logits_of_any_size(monkeypatch):
    r = np.random.default_rng(8)
    z, u, ids = r.normal(size=(300, 6)), r.normal(size=(700, 6)), np.arange(700)
    plain, calls = readout._exp_steps, []
    monkeypatch.setattr(readout, "_exp_steps", lambda x, *room: (calls.append(x.size), plain(x, *room)))
    for scale, table in ((1e-6, 1), (1.0, 1), (20.0, 1), (1e3, 1), (1e12, 0)):
        calls.clear()
        x = (z * scale) @ u.T
        peak = x.max(axis=1)
        w = np.exp(x - peak[:, None])
        found = readout._Logits.of(z * scale, ids, u)
        assert sum(calls) == table * x.size
        assert np.allclose([found.low, found.high], [x.min(axis=1), peak], rtol=1e-13) and (found.top_id == x.argmax(axis=1)).all()
        assert np.allclose(found.total, x.sum(axis=1), atol=1e-9 * scale)
        got = np.log(found.weight) - found.spread / found.weight
        want = np.log(w.sum(axis=1)) - (w * (x - peak[:, None])).sum(axis=1) / w.sum(axis=1)
        assert np.allclose(got, want, rtol=0, atol=1e-12)
    split = readout._Logits.of(z, ids[400:], u[400:], readout._Logits.of(z, ids[:400], u[:400]))
    whole = readout._Logits.of(z, ids, u)
    assert split.n_tokens == 700 and all(np.allclose(a, b, rtol=1e-12) for a, b in zip(split[1:], whole[1:]))


def test_table_of_exponentials_is_close_everywhere():
    for x in (np.linspace(-64, 64, 1_000_001), np.linspace(-1e-3, 1e-3, 1_001)):
        out, *room = np.empty((4, len(x)))
        readout._exp_steps(x * readout._STEPS, out, *room)
        assert np.abs(out / np.exp(x) - 1).max() < 1e-13


def test_few_vectors_are_held_against_a_tile():
    batch = pa.record_batch([pa.array(np.zeros(1 << 20))], ["x"])
    assert max(t.nbytes for t in tiles.buffered(iter([batch] * 12), tiles.BUFFER_BYTES)) <= 24 << 20


def _vectors(spark, sf_dir):
    pdf = src.unembed(spark, sf_dir).toPandas().sort_values("token_id")
    return np.stack(pdf["u"].to_list()).astype(float)


def test_readout_is_the_same_in_blocks_and_with_any_ids(spark, sf_dir):
    items = src.labelled(spark, sf_dir).select("doc_id", "lang", "item_no")
    latents = src.latents(spark, sf_dir, items, [0])
    keys = ["lang", "item_no"]
    matrix = src.unembed(spark, sf_dir)
    gapped = matrix.withColumn("token_id", F.col("token_id") * 3 - 700)
    u = _vectors(spark, sf_dir)
    want = {}
    for r in latents.collect():
        z = np.array(r["vec"], dtype=float)
        x = u @ (z / np.sqrt((z * z).mean() + 1e-6) * np.array(src.NORM_WEIGHT))
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        want[r["lang"], r["item_no"]] = (len(u), x.min(), x.max(), x.mean(), int(x.argmax()), -(p * np.log2(p)).sum())
    small = {"tile_bytes": 64 * 8 * 7, "buffer_bytes": 64 * 8 * 30}
    for rows, shift in ((matrix, lambda i: i), (gapped, lambda i: 3 * i - 700)):
        for sizes in ({}, small):
            got = readout.readout_logits(latents, keys, rows, src.NORM_WEIGHT, **sizes).collect()
            assert {(r["lang"], r["item_no"]) for r in got} == want.keys() and len(got) == len(want)
            for r in got:
                n, low, high, mean, top, entropy = want[r["lang"], r["item_no"]]
                assert (r["n_tokens"], r["top_id"]) == (n, shift(top))
                assert np.allclose([r["low"], r["high"], r["mean"], r["entropy"]], [low, high, mean, entropy])


def test_gram_and_energy_equal_the_direct_form(spark, sf_dir):
    u = _vectors(spark, sf_dir) * np.array(src.NORM_WEIGHT)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = readout.unembed_normalized(src.unembed(spark, sf_dir), src.NORM_WEIGHT)
    for parts in (1, 7):
        gram = readout.gram_matrix(rows.repartition(parts))
        cells = gram.toPandas().pivot(index="i", columns="j", values="g").to_numpy()
        assert np.allclose(cells, u.T @ u)
    scale = readout.gram_scale(gram, rows).first()["scale"]
    assert np.isclose(scale, np.sqrt(((u.T @ u) ** 2).sum() / len(u) ** 2))
    latents = src.latents(spark, sf_dir, src.labelled(spark, sf_dir).select("doc_id", "lang", "item_no"), [2])
    got = readout.layer_energy(latents.select("doc_id", "vec"), ["doc_id"], rows).toPandas()
    z = {r["doc_id"]: np.array(r["vec"], dtype=float) for r in latents.collect()}
    for _, r in got.iterrows():
        v = z[r["doc_id"]] / np.linalg.norm(z[r["doc_id"]])
        assert np.isclose(r["energy"], np.sqrt(((u @ v) ** 2).mean()) / scale)


def test_energy_is_the_same_in_tiles_of_any_size(spark, sf_dir):
    rows = readout.unembed_normalized(src.unembed(spark, sf_dir), src.NORM_WEIGHT)
    latents = src.latents(spark, sf_dir, src.labelled(spark, sf_dir).select("doc_id", "lang", "item_no"), [2]).select("doc_id", "vec")
    whole = {r["doc_id"]: r["energy"] for r in readout.layer_energy(latents, ["doc_id"], rows).collect()}
    # Blocks that do not divide the width, one tile per file, few latents at a time.
    cut = readout.layer_energy(latents, ["doc_id"], rows, block=23, tile_bytes=1, buffer_bytes=64 * 8 * 9).collect()
    assert len(cut) == len(whole) and all(np.isclose(r["energy"], whole[r["doc_id"]], rtol=1e-12) for r in cut)


def test_tiles_of_any_size_give_the_same_gram(spark):
    x = np.random.default_rng(3).normal(size=(300, 19))
    rows = [(None if k % 3 else "g", v.tolist()) for k, v in enumerate(x)] + [("one", x[0].tolist()), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, vec array<double>").repartition(4)
    for block, hold in ((512, 1 << 20), (5, 1 << 20), (5, 0)):
        cells = tiles.tile_cells(tiles.gram_tiles(frame, ["g"], "vec", block, hold), ["g"], "v", block).toPandas()
        for name, own in (("g", x[::3]), (None, np.delete(x, np.s_[::3], 0)), ("one", x[:1])):
            part = cells[cells.g.isna() if name is None else cells.g == name]
            assert np.allclose(part.pivot(index="i", columns="j", values="v").to_numpy(), own.T @ own)


def test_latents_are_dealt_to_many_tasks_before_the_readout(spark, sf_dir):
    latents = catalog._readout(spark, sf_dir, entropy=False)
    plan = latents._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "MapInArrow" in above and "REPARTITION_BY_NUM" in above[above.index("MapInArrow"):]


def test_latents_do_not_move_for_the_readout(spark, sf_dir):
    """Whatever the size of the matrix, the readout adds no exchange to its latents."""
    latents = spark.range(50).select("id", F.lit([1.0] * 64).alias("vec"))
    rows = readout.unembed_normalized(src.unembed(spark, sf_dir), src.NORM_WEIGHT)
    for got in (readout.readout_logits(latents, ["id"], src.unembed(spark, sf_dir), src.NORM_WEIGHT, tile_bytes=1000),
                readout.layer_energy(latents, ["id"], rows, block=10)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan


def test_components_equal_numpy(spark, sf_dir):
    pooled = rp.pooled(spark, sf_dir)
    pdf = pooled.filter("layer = 1").toPandas()
    x = np.stack(pdf["vec"].to_list())
    cov = np.cov(x.T)
    values = np.linalg.eigvalsh(cov)[::-1]
    comps = rep.principal_components(pooled, ["layer"], 3).filter("layer = 1").first()
    assert np.allclose(comps["variances"], values[:3])
    assert sum(comps["variances"]) <= np.trace(cov) + 1e-9
    assert all(max(v, key=abs) > 0 for v in comps["loadings"])
    coords = rep.project(pooled, rep.principal_components(pooled, ["layer"], 2), ["layer"])
    c = np.stack(coords.filter("layer = 1").toPandas()["coords"].to_list())
    assert np.allclose(c.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(c.var(axis=0, ddof=1), values[:2])


@pytest.mark.parametrize("block", [2, 7, 64])
def test_components_found_in_rounds_equal_the_dense_ones(spark, block):
    draw = np.random.default_rng(8)
    x = {"a": draw.normal(size=(400, 60)) * np.linspace(3, 0.1, 60) + 50, "b": draw.normal(size=(9, 60)), None: draw.normal(size=(1, 60))}
    rows = [(g, v.tolist()) for g, part in x.items() for v in part] + [("b", None)]
    frame = spark.createDataFrame(rows, "g string, vec array<double>").repartition(3)
    got = {r["g"]: r for r in rep.principal_components(frame, ["g"], 3, block=block).collect()}
    for g in ("a", "b"):
        values, vectors = np.linalg.eigh(np.cov(x[g].T))
        assert np.allclose(got[g]["variances"], values[::-1][:3], rtol=1e-9)
        assert np.allclose(np.abs(np.array(got[g]["loadings"]) @ vectors[:, ::-1][:, :3]), np.eye(3), atol=1e-6)
        assert np.allclose(got[g]["mean"], x[g].mean(axis=0))
    assert np.allclose(got[None]["variances"], 0)


def test_wide_vectors_need_no_square_matrix(spark):
    """Width 8,192: a dense covariance matrix would be half a gigabyte."""
    width, n = 8192, 120
    draw = np.random.default_rng(1)
    x = draw.normal(size=(n, 6)) @ (draw.normal(size=(6, width)) * np.array([9, 7, 5, 3, 2, 1])[:, None]) + draw.normal(size=(n, width)) * 0.01
    frame = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").withColumn("g", F.lit(1)).repartition(4)
    (row,) = rep.principal_components(frame, ["g"], 2, block=16).collect()
    left, size, right = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(row["variances"], size[:2] ** 2 / (n - 1), rtol=1e-6)
    assert np.allclose(np.abs(np.array(row["loadings"]) @ right[:2].T), np.eye(2), atol=1e-6)


def test_pearson_of_a_constant_side_is_null(spark):
    rows = [(i, lang, float(i) if lang == "en" else 1.0) for i in range(5) for lang in ("en", "de")]
    rows += [(i, "fr", -2.0 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "item_no int, lang string, x double").withColumn("layer", F.lit(0))
    got = {(r["lang_a"], r["lang_b"]): r for r in rep.pearson_pairs(
        df, ["layer"], [("en", "de"), ("en", "fr"), ("en", "hi")], "x").collect()}
    assert got["en", "de"]["r"] is None
    assert np.isclose(got["en", "fr"]["r"], -1.0) and got["en", "fr"]["n_items"] == 4
    assert ("en", "hi") not in got


def test_covariance_of_large_means_and_of_one_row(spark):
    draw = np.random.default_rng(0)
    x = 1e6 + 1e-3 * draw.normal(size=(500, 3))
    rows = [("a", v.tolist()) for v in x] + [("b", [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "g string, vec array<double>").repartition(5)
    got = rep.covariance_matrix(df, ["g"]).toPandas()
    cells = got[got.g == "a"].pivot(index="i", columns="j", values="cov").to_numpy()
    assert np.allclose(cells, np.cov(x.T), rtol=1e-4, atol=1e-12)
    assert got[got.g == "b"]["cov"].isna().all()


def test_vectors_are_not_shuffled_for_the_gram_matrix(spark, sf_dir):
    rows = readout.unembed_normalized(src.unembed(spark, sf_dir), src.NORM_WEIGHT)
    plan = readout.gram_matrix(rows)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan


def test_stacking_and_buckets(spark):
    df = spark.createDataFrame([("de", 0), ("en", 1), ("en", 600), ("xx", 0)], "lang string, item_no bigint") \
        .withColumn("layer", F.lit(0))
    got = {(r["lang"], r["stacked_no"], r["segment"]) for r in rep.stack_languages(df, ("en", "de"), ["layer"]).collect()}
    assert got == {("de", 601, "de"), ("en", 1, "en"), ("en", 600, "en")}
    labels = {r["item_no"]: r["segment"] for r in rep.segment_by_bucket(df, 100).collect()}
    assert labels == {0: "0-100", 1: "0-100", 600: "600-700"}


def test_top_pieces_survive_nan_and_infinite_rows(spark):
    nan, inf = float("nan"), float("inf")
    vocab = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "token_id int, piece string")
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [nan, nan, nan]), (3, [0.0, -inf, 1.0])], "k int, logits array<double>")
    got = {(r["k"], r["rank"]): (r["token_id"], r["percent"]) for r in sampling.top_pieces(df, vocab).collect()}
    assert got[1, 1] == (2, 66) and got[3, 3] == (1, 0) and got[2, 1][1] is None and len(got) == 9


def test_mass_invariants(spark, sf_dir):
    m = lp.metrics(spark, sf_dir)
    eps = 1e-9
    bad = m.filter(
        (F.col("latent_mass") > F.col("any_latent_mass") + eps) | (F.col("out_mass") > F.col("any_out_mass") + eps)
        | (F.col("any_out_mass") > 1 + eps) | (F.col("entropy") < -eps) | (F.col("entropy") > 6 + eps))
    assert m.count() > 0 and bad.count() == 0
