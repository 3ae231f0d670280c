"""Targets, components, statistics, calibration, grid, metrics: hand-computed cases and brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from petrichor.functions import members as M
from petrichor.functions import values as V
from petrichor.operators import calibration as CB
from petrichor.operators import components as CC
from petrichor.operators import covariates as CV
from petrichor.operators import grid as GR
from petrichor.operators import metrics as ME
from petrichor.operators import stats as SS
from petrichor.operators import targets as TG
from petrichor.operators import validate as VA
from petrichor.sources import frames as FR
from petrichor.sources import publish as PB
from petrichor.sources import ranges as RG


def frames(spark, rows):
    return spark.createDataFrame(rows, "slot long, y int, x int, r double, valid boolean")


def test_constant_rate_gives_half_and_ends_weigh_half(spark):
    f = frames(spark, [(k, 0, 0, 6.0, True) for k in range(7)] + [(k, 0, 1, 12.0 if k == 0 else 0.0, True) for k in range(7)])
    one = spark.createDataFrame([(0,)], "slot long")
    got = {r["x"]: r["raw"] for r in TG.accumulate_target(f, one, [6], 5 / 60).collect()}
    assert got[0] == pytest.approx(3.0) and got[1] == pytest.approx(0.5)


def test_missing_scan_drops_and_invalid_scan_masks(spark):
    rows = [(k, 0, 0, 6.0, k != 3) for k in range(7)] + [(k, 0, 1, 6.0, True) for k in range(7) if k != 3]
    got = TG.accumulate_target(frames(spark, rows), spark.createDataFrame([(0,)], "slot long"), [6], 5 / 60).collect()
    assert [(r["x"], r["valid"], r["raw"], r["z"], r["wet"]) for r in got] == [(0, False, None, None, False)]


@pytest.mark.parametrize("chunk", [7, 16, 4096])
def test_accumulation_does_not_depend_on_time_chunks(spark, chunk):
    rng = random.Random(4)
    rows = [(k, 0, 0, float(rng.randint(0, 9)), True) for k in range(120) if rng.random() < 0.9]
    have = {k: r for k, _, _, r, _ in rows}
    got = {r["end_slot"]: r["raw"] for r in TG.window_accumulation(frames(spark, rows), 1.0, 7, chunk).filter("scans = 7").collect()}
    want = {e: sum(have[k] for k in range(e - 6, e + 1)) - 0.5 * (have[e] + have[e - 6]) for e in have if all(k in have for k in range(e - 6, e + 1))}
    assert got == pytest.approx(want)


def test_background_classes(spark):
    act = spark.createDataFrame([(i, 0) for i in range(6)] + [(10 + i, int(i == 2)) for i in range(6)], "slot long, active_pixels int")
    tg = spark.createDataFrame([(1, False, 4), (11, False, 4), (3, False, 4)], "slot long, any_wet boolean, valid_pixels int")
    issues = spark.createDataFrame([(1,), (11,), (3,), (4,)], "slot long")
    got = {r["slot"]: (r["problem"], r["class"]) for r in TG.classify_background(issues, act, tg, 1, 4).collect()}
    assert got[1] == (None, "strict_dry") and got[11] == (None, "marginal_background") and got[3][0] == "missing_slot" and got[4][0] == "missing_slot"


def test_component_cases(spark):
    # a diagonal of four weak pixels is one area by its size; a single strong pixel by its peak, a weak one is neither
    px = [(0, i, i, 0.1) for i in range(4)] + [(0, 4, 0, 1.0), (1, 4, 0, 0.5)]
    df = spark.createDataFrame(px, "field int, y int, x int, v double")
    got = sorted((r["field"], r["size"], r["significant"]) for r in CC.component_stats(CC.wet_components(df, ["field"]), ["field"]).collect())
    assert got == [(0, 1, True), (0, 4, True), (1, 1, False)]


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_components_equal_flood_fill_across_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(CC, "TILE", tile)
    rng = random.Random(tile)
    cells = {(y, x) for y in range(24) for x in range(24) if rng.random() < 0.42} | {(0, x) for x in range(24)} | {(y, 23) for y in range(24)}
    left, want = set(cells), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            y, x = todo.pop()
            n += 1
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (y + a, x + b) in left:
                        left.remove((y + a, x + b))
                        todo.append((y + a, x + b))
        want.append(n)
    df = spark.createDataFrame([(0, y, x, 0.2) for y, x in cells], "field int, y int, x int, v double")
    got = [r["size"] for r in CC.component_stats(CC.wet_components(df, ["field"]), ["field"]).collect()]
    assert sorted(got) == sorted(want)


def test_value_space(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "v double")
    r = [x["r"] for x in df.select(V.rate_from_normalized(F.col("v")).alias("r")).collect()]
    assert r == pytest.approx([0.0, 1000.0, 10 ** 0.75])
    back = [x["v"] for x in df.select(V.normalized_from_rate(V.rate_from_normalized(F.col("v"))).alias("v")).collect()]
    assert back == pytest.approx([0.0, 1.0, 0.5])


def test_merged_moments_equal_whole(spark):
    rng = np.random.default_rng(0)
    rows = [("c", int(i % 5), float(v), True) for i, v in enumerate(rng.normal(1e6, 1, 500))] + [("c", 0, 1e9, False)]
    df = spark.createDataFrame(rows, "channel string, part int, v double, valid boolean")
    a = SS.masked_moments(df, ["channel"]).collect()[0]
    b = SS.merge_moments(SS.moments_state(df, ["channel", "part"]), ["channel"]).collect()[0]
    assert (a["n"], a["min"], a["max"]) == (b["n"], b["min"], b["max"])
    assert b["mean"] == pytest.approx(a["mean"]) and b["variance"] == pytest.approx(a["variance"], rel=1e-9)


def test_mixture_variance_by_hand(spark):
    folds = spark.createDataFrame([(0, 0, 1.0, 0.0, 1.0), (0, 1, 3.0, 2.0, 5.0)], "cell int, fold int, mass double, mean double, second double")
    full = SS.weighted_moments(spark.createDataFrame([(0, 1.0, 1.0), (0, 3.0, 1.0)], "cell int, r double, w double"), ["cell"], "r", "w")
    r = CB.fit_location_scale(folds, full, ["cell"]).collect()[0]
    assert r["mix_variance"] == pytest.approx(1.75) and r["c"] == pytest.approx(math.sqrt(1 / 1.75))
    assert r["b"] == pytest.approx(2.0 - r["c"] * 1.5)


def test_ladder_takes_the_first_passing_level(spark):
    a, b = "era5_oracle:era=1:tp=1:full_trajectory", "era5_oracle:era=1:tp=0:full_trajectory"
    rows = [(0.5, s, f"b{k}{i}", r, 0.0, True, 1.0) for k, (s, r) in enumerate(((a, 1.0), (b, 3.0))) for i in range(1)]
    df = spark.createDataFrame(rows, "lead double, condition_signature string, block_id string, z double, mu double, valid boolean, omega double")
    got = CB.residual_scales(CB.residual_blocks(df), 1e-3, 2, 2.0).collect()
    assert {r["level"] for r in got} == {"lead_provider_era_present"} and all(r["scale"] == pytest.approx(math.sqrt(5)) for r in got)
    none = CB.residual_scales(CB.residual_blocks(df), 1e-3, 30, 20.0).collect()
    assert all(r["scale"] is None and r["unsupported"] for r in none)


def test_probability_fit_recovers_known_map(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.02, 0.98, 6000)
    q = 1 / (1 + np.exp(-(0.4 + 1.7 * np.log(p / (1 - p)))))
    rows = [(0, float(a), float(rng.random() < b), 1.0) for a, b in zip(p, q)]
    r = CB.fit_probability(spark.createDataFrame(rows, "cell int, p double, y double, w double"), ["cell"]).collect()[0]
    assert r["alpha"] == pytest.approx(0.4, abs=0.15) and r["slope"] == pytest.approx(1.7, abs=0.15)
    assert math.log1p(math.exp(r["beta_raw"])) == pytest.approx(r["slope"])


def test_probability_slope_stays_at_its_bound(spark):
    rows = [(0, x / 20, float(x < 10), 1.0) for x in range(1, 20) for _ in range(3)] + [(0, 0.9, 1.0, 1.0), (0, 0.1, 0.0, 1.0)]
    r = CB.fit_probability(spark.createDataFrame(rows, "cell int, p double, y double, w double"), ["cell"]).collect()[0]
    assert r["slope"] == pytest.approx(1e-8)


def test_members(spark):
    df = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0], 2.5), ([7.0], 5.0)], "m array<double>, y double")
    r = df.select(M.lower_median(F.col("m")).alias("a"), M.fair_crps(F.col("m"), F.col("y")).alias("c"), M.exceed_fraction(F.col("m"), 3.0).alias("e")).collect()
    assert r[0]["a"] == 2.0 and r[0]["e"] == 0.5 and r[1]["c"] == 2.0
    pairs = sum(abs(i - j) for i in (1, 2, 3, 4) for j in (1, 2, 3, 4)) / 2
    assert r[0]["c"] == pytest.approx(1.0 - pairs / 12)


def axis(spark, v):
    return spark.createDataFrame(list(enumerate(map(float, v))), "idx long, centre double")


def test_weights_reproduce_affine_fields(spark):
    src = np.cumsum([1.0, 1.5, 0.8, 1.2, 2.0, 0.7, 1.1])
    dst = np.linspace(src[0], src[-1], 9)
    w = GR.area_weights(axis(spark, src), axis(spark, dst))
    assert GR.weight_violations(w, axis(spark, src), axis(spark, dst)).count() == 0
    mat = np.zeros((9, 7))
    for r in w.collect():
        mat[r["dst"], r["src"]] = r["w"]
    assert mat @ (3 * src - 2) == pytest.approx(3 * dst - 2)


def test_nearest_tie_goes_to_the_lower_index(spark):
    got = {r["dst"]: r["src"] for r in GR.nearest_index(axis(spark, [0, 2, 4]), axis(spark, [-1, 1, 1.5, 3, 9])).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_interpolation_is_flat_beyond_the_ends(spark):
    k = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 3.0), (2, 5.0, 7.0)], "idx long, centre double, val double")
    p = spark.createDataFrame([(-3.0,), (0.5,), (1.0,), (3.0,), (9.0,)], "x double")
    assert [r["y"] for r in GR.linear_interp(p, "x", k, "val").orderBy("x").collect()] == pytest.approx([1, 2, 3, 5, 7])


def test_even_window_offsets(spark):
    d = spark.createDataFrame([(0, y, x, float(y == 2 and x == 2)) for y in range(6) for x in range(6)], "f int, y int, x int, v double")
    hit = {(r["y"], r["x"]) for r in GR.neighbourhood_sum(d, ["f"], 4, {"s": F.col("v")}).filter("s > 0").collect()}
    assert hit == {(y, x) for y in range(0, 4) for x in range(0, 4)}


def test_asof_cycle_equals_brute_force(spark):
    rng = random.Random(8)
    cyc, iss = sorted({rng.randint(0, 400) for _ in range(30)}), [rng.randint(0, 500) for _ in range(300)]
    got = CV.asof_cycle(spark.createDataFrame([(i,) for i in iss], "t0_day long"), spark.createDataFrame([(c,) for c in cyc], "cycle_day long"), 3, 16).collect()
    assert len(got) == len(iss)
    for r in got:
        assert r["cycle_day"] == max((c for c in cyc if c + 3 <= r["t0_day"]), default=None)


def test_overlap_needs_full_cover(spark):
    h = spark.createDataFrame([("a", 0, 3600, 6.0), ("a", 3600, 7200, 2.0)], "k string, js long, je long, amount double")
    w = spark.createDataFrame([("a", 1, 1800, 5400), ("a", 2, 5400, 9000)], "k string, wid long, ws long, we long")
    got = {r["wid"]: (r["amount"], r["cover"]) for r in CV.overlap_resample(h, w, ["k"]).collect()}
    assert got == {1: (4.0, 1.0), 2: (None, 0.5)}


def test_bootstrap_keeps_block_counts(spark):
    rows = [("s1", f"a{i}", 1.0, float(i)) for i in range(7)] + [("s2", f"b{i}", 1.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "stratum string, block_id string, n double, v double")
    b = ME.block_bootstrap(df, ["n", "v"], 50).collect()
    assert len(b) == 50 and all(r["n"] == 11.0 for r in b) and len({r["v"] for r in b}) > 10


def test_contracts_raise(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, `Target Z` double")
    with pytest.raises(VA.ContractError):
        VA.condition_columns(df, ["a", "Target Z"])
    bad = spark.createDataFrame([("r", "k", "")], "rule string, key string, detail string")
    with pytest.raises(VA.ContractError):
        VA.require_clean(bad)
    VA.require_clean(bad.limit(0))


def test_raw_files_round_trip(spark, tmp_path):
    import gzip
    grid = np.arange(12, dtype="<i2").reshape(3, 4)
    grid[0, 0], grid[1, 1], grid[2, 2] = -30000, -25000, -20000
    body = bytes(1024) + grid.tobytes()
    (tmp_path / "a.bin.gz").write_bytes(gzip.compress(body))
    (tmp_path / "b.bin").write_bytes(body[:-1])
    got = (FR.ingest_raw_scans(spark, str(tmp_path), "*.gz", 3, 4, compressed=True).collect() + FR.ingest_raw_scans(spark, str(tmp_path), "*.bin", 3, 4).collect())
    ok = [r for r in got if r["problem"] is None]
    assert len(ok) == 12 and sum(not r["valid"] for r in ok) == 2 and len(got) == 13
    assert {(r["y"], r["x"]): r["raw"] for r in ok} == {(y, x): int(grid[y, x]) for y in range(3) for x in range(4)}
    assert FR.list_files(spark, str(tmp_path)).count() == 2


def test_fingerprints_of_files_that_no_task_reads_whole(spark, tmp_path):
    import gzip
    import hashlib
    noise = np.random.default_rng(5).integers(0, 256, 300_000, dtype="uint8").tobytes()
    files = {"plain.bin": noise, "a b%20.bin": noise + b"\n", "mark.bin": b"\xef\xbb\xbf" + noise[:90_001], "mark and feed.bin": b"\xef\xbb\xbf" + noise[:90_000] + b"\n",
             "feeds.bin": b"\n" * 100_000, "returns.bin": b"\r\n\r" * 30_000, "one line.bin": b"\0" * 200_000, "small.bin": b"ab\n", "edge.bin": (b"x" * 4095 + b"\n") * 32,
             "packed.gz": gzip.compress(noise[:68_000])}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    want = {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
    limits = {"spark.sql.sources.binaryFile.maxLength": "70000", "spark.sql.files.maxPartitionBytes": "40960"}  # a larger file in one row is an error
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        assert {tuple(r) for r in FR.fingerprint_files(spark, str(tmp_path), "*", 1 << 16).collect()} == want
        pieces = RG.byte_pieces(spark, str(tmp_path), "plain.bin", 1 << 16).orderBy("start", "at").select("step", F.length("data").alias("n")).collect()
        steps = [r["step"] for r in pieces]
        assert steps == sorted(steps) and set(steps) == set(range(5)) and max(sum(r["n"] for r in pieces if r["step"] == k) for k in range(5)) < 110_000
    finally:
        for key in limits:
            spark.conf.unset(key)
    short = pa.RecordBatch.from_pydict({"path": ["p"], "size": [4], "state": [RG.Sha256().update(b"abc").state], "tail": [b""]})
    with pytest.raises(ValueError, match="3 of 4 bytes"):
        list(RG._close([short]))


def test_bundle_is_all_or_nothing(spark, tmp_path):
    target = str(tmp_path / "bundle")
    t = {"a": spark.range(3), "b": spark.range(5)}
    assert {r["tbl"]: r["rows"] for r in PB.publish_bundle(spark, t, target).collect()} == {"a": 3, "b": 5}
    with pytest.raises(FileExistsError):
        PB.publish_bundle(spark, t, target)
    bad = {"a": spark.range(3), "b": spark.range(3).select((F.lit(1) / (F.col("id") - F.col("id"))).alias("boom"))}
    with pytest.raises(Exception):
        PB.publish_bundle(spark, bad, str(tmp_path / "other"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bundle"]


def test_missing_is_never_dry_and_never_a_bound(spark):
    df = spark.createDataFrame([(None,)], "v double")
    v = F.col("v")
    row = df.select(V.rate_from_normalized(v), V.normalized_from_rate(v), V.censored(v), V.log_amount(v), V.map_probability(v, F.lit(0.0), F.lit(1.0)),
                    V.clip_weight(v, 3), V.clip(v, 0.0, 1.0), M.to_physical(v, F.array(F.lit(1.0)))[0]).collect()[0]
    assert list(row) == [None] * 8


def test_separable_cell_does_not_stop_the_others(spark):
    rng = np.random.default_rng(5)
    ok = [("ok", float(p), float(rng.random() < p), 1.0) for p in rng.uniform(0.05, 0.95, 400)]
    sep = [("sep", 0.2, 0.0, 1.0), ("sep", 0.8, 1.0, 1.0)]
    df = spark.createDataFrame(ok + sep, "cell string, p double, y double, w double")
    got = {r["cell"]: r["slope"] for r in CB.fit_probability(df, ["cell"]).collect()}
    assert got["ok"] == pytest.approx(1.0, abs=0.5) and got["sep"] > 5


def test_asof_cycle_on_instants_with_rollout_lead(spark):
    rng = random.Random(18)
    cyc = sorted({rng.randint(0, 10**6) for _ in range(40)})
    iss = [(k, rng.randint(0, 10**6) if k % 3 else 500_000, rng.randint(1, 9)) for k in range(300)] + [(900, None, 1), (901, 0, 1)]
    out = CV.asof_cycle(spark.createDataFrame(iss, "id long, t long, ahead long"), spark.createDataFrame([(c,) for c in cyc] + [(None,), (cyc[0],)], "c long"), 1000, 7, "t", "c", "ahead").collect()
    assert len(out) == len(iss)
    for r in out:
        want = max((c for c in cyc if r.t is not None and c + 1000 <= r.t), default=None)
        assert (r.c, r.cycle_age) == (want, None if want is None else r.t - want)
        assert r.rollout_lead == (None if want is None else r.t - want + r.ahead)
    empty = CV.asof_cycle(spark.createDataFrame(iss, "id long, t long, ahead long"), spark.createDataFrame([], "c long"), 1000, 3, "t", "c").collect()
    assert len(empty) == len(iss) and all(r.c is None for r in empty)


def test_near_mean_equals_brute_force(spark):
    rng = random.Random(21)
    cells = [(x, y, rng.uniform(0, 9) if rng.random() < 0.8 else None) for x in range(-4, 9) for y in range(-3, 7)]
    sites = [(k, rng.uniform(-12, 20), rng.uniform(-12, 20)) for k in range(120)] + [(200, 1.0, 1.25), (201, 900.0, 900.0)]
    out = GR.near_mean(spark.createDataFrame(sites, "id long, sx double, sy double"), spark.createDataFrame(cells, "cx long, cy long, fc double"), ["id"], 2.0, 0.5, -0.5, 1.5, 2.5).collect()
    got = {r.id: (round(r.fc_near, 9), r.cells_near) for r in out}
    want = {}
    for i, sx, sy in sites:
        v = [f for x, y, f in cells if f is not None and ((x + 0.5) * 1.5 + 0.5 - sx) ** 2 + ((y + 0.5) * 2.5 - 0.5 - sy) ** 2 <= 4.0]
        if v:
            want[i] = (round(sum(v) / len(v), 9), len(v))
    assert got == want


def test_wet_histogram_keeps_empty_bins(spark):
    d = spark.createDataFrame([("a", 0.5, [0.05, 0.1, 3.0]), ("a", float("nan"), [0.2]), ("b", None, [])], "k string, y double, m array<double>")
    got = sorted((r.k, r.bin, r.edge, r.observed, r.members) for r in ME.wet_histogram(d, ["k"], (0.1, 1.0, 10.0)).collect())
    assert got == [("a", 0, 0.1, 1, 2), ("a", 1, 1.0, 0, 1), ("a", 2, 10.0, 0, 0), ("b", 0, 0.1, 0, 0), ("b", 1, 1.0, 0, 0), ("b", 2, 10.0, 0, 0)]


def test_neighbourhoods_across_tiles_take_one_shuffle(spark, monkeypatch):
    """Sums and distance classes on fields of several tiles against plain loops, nulls and gaps in them."""
    monkeypatch.setattr(GR, "TILE", 5)
    rng = random.Random(31)
    rows = [(f, y, x, rng.choice([None, 1.0, 2.5, -3.0]), rng.random() < 0.02) for f in ("a", "b") for y in range(-3, 14) for x in range(17) if rng.random() < 0.9]
    d = spark.createDataFrame(rows, "f string, y int, x int, v double, bad boolean")
    out = GR.neighbourhood_sum(d, ["f"], 6, {"s": F.col("v"), "n": F.col("v").isNotNull().cast("long")})
    assert out.columns == ["f", "y", "x", "v", "bad", "s", "n"]
    for r in out.collect():
        near = [v for f, y, x, v, _ in rows if f == r.f and -2 <= y - r.y <= 3 and -2 <= x - r.x <= 3 and v is not None]
        assert r.n == len(near) and (abs(r.s - sum(near)) < 1e-9 if near else r.s is None)
    bins = GR.chebyshev_bin(d, ["f"], F.col("bad"))
    for r in bins.collect():
        k = min((max(abs(y - r.y), abs(x - r.x)) for f, y, x, _, b in rows if f == r.f and b), default=99)
        assert r.distance_bin == ("0" if k == 0 else "1-2" if k <= 2 else "3-8" if k <= 8 else "far")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (GR.neighbourhood_sum(d, ["f"], 6, {"s": F.col("v")}), GR.chebyshev_bin(d, ["f"], F.col("bad"))):
            assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_weights_come_from_one_evaluation_of_the_axes(spark, monkeypatch):
    """Means of doubles differ in their last bits from one evaluation to the next; the weights must not mix evaluations."""
    from petrichor.plans import q_grid
    noise = F.udf(lambda v: v + random.uniform(0, 1e-7), "double").asNondeterministic()
    read = q_grid.B.table
    monkeypatch.setattr(q_grid.B, "table", lambda s, sf, name: read(s, sf, name).withColumn("value", noise("value")))
    sf = "/root/testdata/sf0.01"
    row = q_grid.jn10b(spark, sf).first()
    assert (row["weights"], row["violations"]) == (37, 0)
