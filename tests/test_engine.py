"""Literal cases, boundaries, a slow model of the classifier, constraint checks, artifacts, the campaign driver and the worker."""

import json
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from hopmark.functions import stats
from hopmark.functions.labels import BASE, LABELS, MASS, MAX_INC, TAU, Config
from hopmark.operators import classify, geo, increments, merge, reports, synthetic
from hopmark.plans import registry, validation
from hopmark.plans.postprocess import Campaign
from hopmark.sources import manifest as m
from hopmark.sources import tables
from hopmark.streaming import worker

SIMPLE_B, SIMPLE_M = Config(4, 4, (1, 2, 3, 4)), Config(4, 25, (1, 2, 3, 4))
LABEL = merge.LABEL


def frame(spark, rows, columns=f"IP_ADDR string, {LABEL} string"):
    return spark.createDataFrame(rows, columns)


def label_of(spark, sequences, config, mass, skip=False):
    raw = frame(spark, [(str(i), ",".join(map(str, s)) if s is not None else None) for i, s in enumerate(sequences)], "IP_ADDR string, IPID_SEQUENCE string")
    out = classify.classify_mass(raw, config) if mass else classify.classify_base(raw, config, skip)
    return [r[1] for r in sorted(out.collect(), key=lambda r: int(r[0]))]


def model(v, config, mass, skip=False):
    """The rules of a sequence with None for missing values, written plainly."""
    whole = len(v) == config.length and None not in v
    if whole:
        w, pattern = (v[config.connections :], config.pattern[config.connections :]) if skip and not mass else (v, config.pattern)
        d = lambda k: [(b - a) % 65536 for a, b in zip(w, w[k:], strict=False)]
        c = config.connections
        if len({(x - p) % 65536 for x, p in zip(w, pattern, strict=True)}) == 1:
            return "REFLECTION"
        for name, k, lo, hi in (("CONSTANT", 1, 0, 0), ("PER_DESTINATION", 2, 1, 1), ("PER_CONNECTION", c, 1, 1), ("SINGLE", 1, 1, MAX_INC), ("PER_BUCKET", c, 1, MAX_INC)):
            if all(lo <= x <= hi for x in d(k)):
                return name
    if not mass:
        return "UNCLASSIFIED"
    v = v + [None] * (config.length - len(v))
    s = sorted(x for x in v if x is not None)
    if not s:
        return "UNCLASSIFIED"
    if s[0] == s[-1]:
        return "CONSTANT"
    gaps = [b - a for a, b in zip(s, s[1:], strict=False)] + [s[0] + 65536 - s[-1]]
    if 2 <= sum(g > 800 for g in gaps) <= 16:
        return "MULTI"
    n = len(s)
    u = stats.uniformity(n, sum(sum(x * 16 // 65536 == b for x in s) ** 2 for b in range(16)))
    tails = []
    for k in (1, 2, config.connections):
        steps = [(b - a) % 65536 for a, b in zip(v, v[k:], strict=False) if a is not None and b is not None]
        tails.append(stats.binomial_tail(len(steps), sum(1 <= x <= MAX_INC for x in steps)))
    score = min(u, stats.occupancy(n)[len({*s})], stats.gap_bound(n, max(gaps)), *tails)
    return "RANDOM" if n >= 2 and score >= TAU * (1 - 1e-9) else "UNCLASSIFIED"


def test_literal_base_cases(spark):
    clustered = [x for i in range(8) for x in (100 + 90 * (i * 5 % 8), 10000 + 90 * (i * 3 % 8))]
    rows = [[7] * 16, [7] * 12 + ["-"] * 4, clustered, None, [], [70000] + [7] * 15, [1 + 9, 2 + 9, 3 + 9, 4 + 9] * 4]
    assert label_of(spark, rows, SIMPLE_B, False) == ["CONSTANT", "UNCLASSIFIED", "UNCLASSIFIED", "UNCLASSIFIED", "UNCLASSIFIED", "UNCLASSIFIED", "REFLECTION"]


def test_literal_mass_cases(spark):
    p = np.arange(100)
    per_connection = np.array([1000, 10000, 30000, 50000])[p % 4] + p // 4
    rows = [(np.array([1, 2, 3, 4] * 25) + 1234) % 65536, [5] * 100, np.array([1000, 30000])[p % 2] + p // 2, per_connection, 2 * p, np.array([1000, 50000, 10000, 30000])[p % 4] + 2 * (p // 4), [*range(99), "-"], [17] * 79, [*range(40), *range(10000, 10040)], ["-"] * 100, None]
    want = ["REFLECTION", "CONSTANT", "PER_DESTINATION", "PER_CONNECTION", "SINGLE", "PER_BUCKET", "UNCLASSIFIED", "CONSTANT", "MULTI", "UNCLASSIFIED", "UNCLASSIFIED"]
    assert label_of(spark, rows, SIMPLE_M, True) == want
    with pytest.raises(Exception, match="longer than 100"):
        label_of(spark, [[1] * 101], SIMPLE_M, True)


def test_order_of_replies_does_not_matter(spark):
    rng = np.random.default_rng(1)
    multi, noise = [*range(40), *range(10000, 10040)], rng.integers(0, 65536, 90)
    assert {*label_of(spark, [rng.permutation(multi) for _ in range(20)], SIMPLE_M, True)} == {"MULTI"}
    assert label_of(spark, [noise, noise[::-1], np.sort(noise)], SIMPLE_M, True) == ["RANDOM", "RANDOM", "UNCLASSIFIED"]


@pytest.mark.parametrize("mass", [False, True])
def test_against_slow_model(spark, mass):
    config, rng = MASS if mass else BASE, np.random.default_rng(5)
    rows = []
    for s in validation.FIXED:
        for _ in range(12):
            v = synthetic.one(s, config, rng)
            rows += [v, synthetic.impaired(v, rng)[1], synthetic.impaired(v, rng, 0.9)[0], np.where(rng.random(len(v)) < 0.02, v + 1, v) % 65536]
    text = [["-" if x < 0 else int(x) for x in v] for v in rows]
    values = [[None if x < 0 else int(x) for x in v] for v in rows]
    assert label_of(spark, text, config, mass) == [model(v, config, mass) for v in values]
    if not mass:
        assert label_of(spark, text, config, False, True) == [model(v, config, False, True) for v in values]


def test_limits_are_where_the_score_crosses():
    lim = stats.limits()
    table = {2: (4, 2, 65535), 20: (86, 19, 34200), 50: (308, 48, 17218), 80: (644, 77, 11611), 100: (932, 97, 9570)}
    for n, (squares, distinct, gap) in table.items():
        assert lim["squares"][n] - (lim["squares"][n] - n) % 2 == squares and lim["distinct"][n] == distinct and lim["gap"][n] == gap
        assert stats.gap_bound(n, gap) >= TAU > stats.gap_bound(n, gap + 1) or gap == 65535
    assert [lim["successes"][k] for k in (99, 98, 96, 79, 2)] == [53, 53, 52, 44, 2]
    assert math.isclose(stats.occupancy(80)[77], TAU, rel_tol=1e-12)
    assert abs(stats.chi2_tail(24.9958, 16) - 0.05) < 1e-5 and abs(stats.chi2_tail(7.8147, 4) - 0.05) < 1e-5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 65535), min_size=100, max_size=100))
def test_whole_number_limits_equal_the_score(values):
    f = classify.features(np.array([values]), MASS)
    score = classify.component_scores(f)["score"][0]
    assert classify.random_compatible(f, 100)[0] == (f["n_present"][0] >= 2 and score >= TAU * (1 - 1e-9))


def test_counter_is_no_noise(spark):
    raw = frame(spark, [("a", ",".join(map(str, range(100))))], "IP_ADDR string, IPID_SEQUENCE string")
    r = classify.random_scores(raw).first()
    assert r["bounded_increment"] < 1e-20 and r["score"] == min(r[k] for k in classify.SCORES[:4]) == r[r["limiting"]]
    assert classify.increment_uniformity(raw).first()[1] < 1e-4


def test_increments_and_intervals(spark):
    p = np.arange(100)
    v = (np.array([1000, 30000])[p % 2] + p // 2).tolist()
    rows = [("a", ",".join(map(str, v))), ("b", ",".join(map(str, [*v[:50], "-", *v[51:]]))), ("c", None)]
    got = {r[0]: r["INCREMENTS"] for r in increments.mass_increments(frame(spark, rows, "IP_ADDR string, IPID_SEQUENCE string"), SIMPLE_M).collect()}
    assert got["a"] == [1] * 98 and len(got["b"]) == 97 and got["c"] == []
    base = [("a", ",".join(map(str, [x for r in range(4) for x in (100 + r, 5000 + r, 9000 + r, 20000 + r)]))), ("b", "1,-")]
    got = {r[0]: (r[1], r[2]) for r in increments.base_increments(frame(spark, base, "IP_ADDR string, IPID_SEQUENCE string"), SIMPLE_B).collect()}
    assert got == {"a": ("PER_CONNECTION", [1] * 12), "b": ("UNCLASSIFIED", [])}
    times = frame(spark, [("a", "10,-,25,45"), ("b", "-"), ("c", None), ("d", "7")], "IP_ADDR string, SEND_TIMESTAMP_SEQUENCE string")
    assert {r[0]: r[1] for r in increments.probing_intervals(times).collect()} == {"a": [15, 20], "b": [], "c": None, "d": []}


def test_strict_parser(spark):
    raw = frame(spark, [("a", "1,-,65535,bad"), ("b", "70000,-3"), ("c", None)], "IP_ADDR string, IPID_SEQUENCE string")
    got = {r[0]: r[1] for r in classify.parsed_strictly(raw, Config(5, 1)).collect()}
    assert got == {"a": [1, -1, 65535, -1, -1], "b": [-1] * 5, "c": [-1] * 5}


def test_merge_truth_table(spark):
    base = frame(spark, [("1", "CONSTANT"), ("2", "UNCLASSIFIED"), ("3", "UNCLASSIFIED"), ("4", "UNCLASSIFIED")])
    mass = frame(spark, [("1", "RANDOM"), ("2", "MULTI"), ("3", "UNCLASSIFIED"), ("9", "RANDOM")])
    out, facts = merge.checked_merge(base, mass)
    assert {tuple(r) for r in out.collect()} == {("1", "CONSTANT"), ("2", "MULTI"), ("3", "UNCLASSIFIED"), ("4", "NOT_ENOUGH_SAMPLES")} and facts == (4, 1)
    with pytest.raises(ValueError, match="duplicate"):
        merge.checked_merge(base, mass.union(mass))
    with pytest.raises(ValueError, match="unknown"):
        merge.checked_merge(base, frame(spark, [("1", "NEW")]))


def test_coverage(spark):
    ips = lambda *x: frame(spark, [(i,) for i in x], "IP_ADDR string")
    assert merge.checked_coverage(ips("1", "1", "2"), ips("1")) == {"target_count": 2, "probed_count": 1, "outside_count": 0, "coverage_percent": 50.0}
    for target, probed in ((ips("1"), ips("3")), (ips("1").limit(0), ips("1"))):
        with pytest.raises(ValueError):
            merge.checked_coverage(target, probed)


def test_refinement(spark):
    rt = frame(spark, [("1", "REFLECTION"), ("2", "SINGLE"), ("3", "UNCLASSIFIED"), ("4", "UNCLASSIFIED"), ("5", "UNCLASSIFIED")])
    fi = frame(spark, [("3", "MULTI"), ("4", "RANDOM")])
    merge.check_refinement(rt, fi)
    got = {(r[0], r[1]): round(r["PERCENTAGE"], 3) for r in reports.refinement(rt, fi).collect()}
    assert got == {("RT-based", "REFLECTION"): 20, ("RT-based", "SINGLE"): 20, ("RT-based", "UNCLASSIFIED"): 60, ("Fixed-Interval", "MULTI"): 33.333, ("Fixed-Interval", "RANDOM"): 33.333, ("Fixed-Interval", "NOT_ENOUGH_SAMPLES"): 33.333}
    for bad, why in ((frame(spark, [("1", "MULTI")]), "not RT-based"), (fi.union(fi), "duplicate")):
        with pytest.raises(ValueError, match=why):
            merge.check_refinement(rt, bad)
    with pytest.raises(ValueError, match="empty"):
        merge.check_connection(rt.limit(0))


def test_tcp_flags(spark):
    s = frame(spark, [("1", "CONSTANT"), ("2", "SINGLE"), ("3", "MULTI"), ("4", "UNCLASSIFIED")])
    z = frame(spark, [("1", "synack"), ("2", "SYNACK"), ("3", "rst"), ("4", "RST")], "IP_ADDR string, REPLY_TYPE string")
    assert merge.check_tcp(s, z)["synack"] == 2
    rows = reports.tcp_flags(s, z).collect()
    assert {r["PERCENTAGE"] for r in rows if r["TCP_FLAGS"] == "SYN-ACK/RST"} == {25.0} and {r["PERCENTAGE"] for r in rows if r["TCP_FLAGS"] != "SYN-ACK/RST"} == {50.0}
    for bad, why in (("icmp", "unsupported"), (None, "unsupported")):
        with pytest.raises(ValueError, match=why):
            merge.check_tcp(s, z.withColumn("REPLY_TYPE", F.when(F.col("IP_ADDR") == "1", F.lit(bad)).otherwise(F.col("REPLY_TYPE"))))
    with pytest.raises(ValueError, match="without a scan reply"):
        merge.check_tcp(s, z.where("IP_ADDR <> '1'"))


def test_os_matrix(spark):
    from hopmark.functions import os_names

    dim = os_names.dimension(spark)
    assert dim.count() == 82
    s = frame(spark, [(str(i), "SINGLE" if i % 2 else "CONSTANT") for i in range(6)])
    os_ = frame(spark, [(str(i), " Ubuntu" if i < 4 else "cisco-ios") for i in range(6)] + [("9", "debian")], "IP_ADDR string, OS_NAME string")
    assert merge.check_os(os_, s, dim, both_groups=True)["matched"] == 6
    rows = reports.os_matrix(os_, s, dim).collect()
    assert len(rows) == 20 and {r["PERCENTAGE"] for r in rows} == {0.0, 50.0}
    for bad, why in ((os_.withColumn("OS_NAME", F.lit("beos")), "unknown"), (os_.union(os_), "duplicate"), (os_.withColumn("OS_NAME", F.lit(" ")), "no identified"), (os_.where("IP_ADDR = '9'"), "no identified address"), (os_.limit(0), "empty")):
        with pytest.raises(ValueError, match=why):
            merge.check_os(bad, s, dim)
    with pytest.raises(ValueError, match="both groups"):
        merge.check_os(os_.where("OS_NAME = ' Ubuntu'"), s, dim, both_groups=True)


def test_increment_clipping_and_intersection(spark):
    rt = frame(spark, [("1", "SINGLE", [1] * 999 + [2, 10000])], f"IP_ADDR string, {LABEL} string, INCREMENTS array<int>")
    rows = reports.increment_distributions(rt, rt.limit(0)).orderBy("INCREMENT").collect()
    assert [r["INCREMENT"] for r in rows] == [1, 2] and {r["CLIPPED_COUNT"] for r in rows} == {1} and rows[-1]["CUMULATIVE_PERCENTAGE"] == 100.0
    a = frame(spark, [("1", "SINGLE"), ("2", "SINGLE"), ("3", "CONSTANT"), ("4", "UNCLASSIFIED")])
    b = frame(spark, [("1", "SINGLE"), ("2", "PER_BUCKET"), ("3", "CONSTANT"), ("4", "UNCLASSIFIED")])
    got = {(r[0], r[1]): r["PERCENTAGE"] for r in reports.intersection(a, b).collect() if r["COUNT"]}
    assert got == {("SINGLE", "SINGLE"): 50, ("SINGLE", "PER_BUCKET"): 50, ("CONSTANT", "CONSTANT"): 100, ("UNCLASSIFIED", "UNCLASSIFIED"): 100}


def test_continents(spark):
    nets = frame(spark, [(3221225984, 3221226239, "NA", "North America"), (3325256704, 3325256959, "EU", "Europe"), (3221225984, 3221225991, "AS", "Asia")], "net_lo long, net_hi long, CONTINENT_CODE string, CONTINENT string")
    ips = frame(spark, [("192.0.2.9",), ("192.0.2.9",), ("192.0.2.1",), ("198.51.100.7",), ("203.0.113.1",), ("::1",)], "IP_ADDR string")
    got = {r[0]: r[1] for r in geo.continents(ips, nets).collect()}
    assert got == {"192.0.2.9": "NA", "192.0.2.1": "AS", "198.51.100.7": "EU", "203.0.113.1": "ZZ", "::1": "ZZ"}
    by_call = geo.continents_by_lookup(ips, lambda: lambda ip: ("NA", "North America") if ip.startswith("192") else None)
    assert {r[0]: r[1] for r in by_call.collect()}["198.51.100.7"] == "ZZ"


def test_confusion_metrics(spark):
    rows = [("A", "A")] * 8 + [("A", "B")] * 2 + [("B", "B")] * 5 + [("B", "U")] * 5
    got = reports.confusion_metrics(reports.confusion(frame(spark, rows, "EXPECTED_STRATEGY string, DETECTED_STRATEGY string")), ("A", "B"), ("A", "B", "U"))
    assert got["accuracy"] == 13 / 20 and math.isclose(got["balanced_accuracy"], 0.65) and got["classes"]["B"]["precision"] == 5 / 7
    truth, guess = {"A": 10, "B": 10}, {"A": 8, "B": 7}
    chance = sum(truth[k] * guess[k] for k in truth) / 400
    assert math.isclose(got["cohen_kappa"], (0.65 - chance) / (1 - chance))
    with pytest.raises(ValueError, match="outside"):
        reports.confusion_metrics(reports.confusion(frame(spark, [("A", "X")], "EXPECTED_STRATEGY string, DETECTED_STRATEGY string")), ("A",), ("A",))


def test_validation_recovers_all(spark):
    got = validation.validate(spark, each=24, trivial=8)
    assert got["rt-based"]["accuracy"] == got["fixed-interval"]["macro"]["f1"] == got["lossy"]["accuracy"] == got["lossy-reordered"]["accuracy"] == 1.0
    assert got["out-of-scope"] == {"MULTI": 1.0}


def test_calibration_is_kept(spark, tmp_path):
    path = str(tmp_path / "t.json")
    a = validation.calibrate(spark, path, each=200, rate=0.05)
    assert 0 < a["threshold"] <= min(a["datasets"].values()) and validation.calibrate(spark, path, each=200, rate=0.05) == a
    assert validation.calibrate(spark, path, each=100, rate=0.05)["parameters"]["each"] == 100


def test_generators(spark):
    s = synthetic.generate(spark, ("MULTI", "RANDOM"), 20).collect()
    for r in s:
        v = [int(x) for x in r["IPID_SEQUENCE"].split(",")]
        assert r["LOSSY_SEQUENCE"].split(",").count("-") == r["LOSS_COUNT"] == 20 and r["REORDERED_COUNT"] == 16 and r["REORDERED_SEQUENCE"] != r["LOSSY_SEQUENCE"]
        if r["GENERATOR_STRATEGY"] == "MULTI":
            assert 2 <= classify.features(np.array([v]), MASS)["n_clusters"][0] <= 16
    assert sorted(s) == sorted(synthetic.generate(spark, ("MULTI", "RANDOM"), 20).collect())


def test_display():
    assert [reports.abbreviated(x) for x in (999, 1500, 2_000_000)] == ["999", "1.5k", "2M"] and [reports.percent_text(x) for x in (0, 0.25, 33.3)] == ["0", "0.2", "33"]


MANIFEST = {"tcp": {"zmap": "z1", "os": "o1", "ipid": {"no-connection": {"rt-based": {"base": "tcp-80_a"}, "fixed-interval": {"base": "tcp-80_c", "mass": "tcp-80_b"}}, "connection": {"rt-based": {"base": "tcp-80_d"}}}}, "note": "x"}


def test_manifest():
    run = m.resolve(MANIFEST, "tcp.ipid.no-connection.fixed-interval.mass")
    assert run.measurement_id == "tcp-80_b" and str(run.artifact("out", "strategies", "pdf")) == "out/z1/no-connection/fixed-interval-mass/n-fi-m_strategies.pdf"
    assert m.resolve(MANIFEST, "udp.ipid.connection.rt-based.mass") is None
    for bad in ("tcp.ipid", "tcp.os.connection.rt-based.base", "tcp.ipid.x.rt-based.base", "tcp.ipid.connection.x.base", "tcp.ipid.connection.rt-based.x"):
        with pytest.raises(ValueError):
            m.resolve(MANIFEST, bad)
    assert [r.stem for r in m.measurements(MANIFEST)] == ["n-rt-b", "n-fi-b", "n-fi-m", "c-rt-b"]
    (pair,), (other,) = m.pairs(MANIFEST, "merged"), m.pairs(MANIFEST, "comparison")
    assert str(pair.artifact("o", "s")) == "o/z1/no-connection/merged/rt-based-base_fixed-interval-mass/n-rt-b_fi-m_s.pq" and other.stem == "n-rt-b_fi-b"
    with pytest.raises(ValueError):
        m.Pair("merged", pair.second, pair.first)
    with pytest.raises(ValueError, match="incomplete"):
        m.load_config("connection_count: 4")
    assert m.load_config("{connection_count: 4, requests_per_connection: 25, request_ip_ids: [1, 2], extra: 1}").length == 100
    assert m.measurement_protocol("udp-53_x") == "udp-dns" and m.measurement_protocol("tcp-80_x") == "tcp"


def write_run(spark, folder, keys, config):
    os.makedirs(folder)
    synthetic.from_keys(spark.range(*keys).selectExpr("id AS k"), config, True).drop("k").write.parquet(f"{folder}/ipid.pq")
    with open(f"{folder}/ipid.snapshot.yaml", "w") as f:
        f.write(f"connection_count: 4\nrequests_per_connection: {config.requests}\nrequest_ip_ids: {list(config.request_ip_ids)}\n")


def test_campaign(spark, tmp_path):
    raw = tmp_path / "raw"
    for name, config in (("tcp-80_a", BASE), ("tcp-80_b", MASS), ("tcp-80_c", BASE), ("tcp-80_d", BASE)):
        write_run(spark, str(raw / "ipid" / name), (0, 200), config)
    ips = synthetic.from_keys(spark.range(0, 200).selectExpr("id AS k"), BASE)
    ips.selectExpr("IP_ADDR", "CASE WHEN k % 2 = 0 THEN 'synack' ELSE 'RST' END AS REPLY_TYPE").write.parquet(str(raw / "zmap/z1/zmap.pq"))
    ips.selectExpr("IP_ADDR", "CASE WHEN k % 2 = 0 THEN 'ubuntu' ELSE 'sonic' END AS OS_NAME").write.parquet(str(raw / "os/o1/os.pq"))
    c = Campaign(spark, MANIFEST, str(raw), str(tmp_path / "out"))
    done = c.run()
    assert all(v == "done" for k, v in done.items() if not k.startswith("merged"))
    # the mass run covers more than the unclassified addresses, which the refinement check reports
    assert "not RT-based UNCLASSIFIED" in done["merged n-rt-b_fi-m"]
    out = tmp_path / "out/z1/no-connection"
    assert json.loads((out / "rt-based-base/n-rt-b_coverage.json").read_text())["coverage_percent"] == 100.0
    first = spark.read.parquet(str(out / "rt-based-base/n-rt-b_strategies.pq"))
    assert first.count() == 200 and not list(out.rglob("*.part"))
    # persisted labels are taken over, unless asked not to
    frame(spark, [("1.2.3.4", "RANDOM")]).write.parquet(str(raw / "ipid/tcp-80_a/strategies.pq"))
    run = m.measurements(MANIFEST)[0]
    assert c.strategies(run).count() == 1 and c.strategies(run, reclassify=True).count() == 200


def test_worker(spark, tmp_path):
    home = str(tmp_path / "ipid/icmp_1")
    write_run(spark, home, (0, 60), BASE)
    prefix = str(tmp_path)
    job = f"{prefix}/jobs/icmp_1"
    request = {"version": 1, "job_id": "icmp_1", "protocol": "icmp", "measurement_id": "icmp_1", "ipid_uri": f"{home}/ipid.pq", "snapshot_uri": f"{home}/ipid.snapshot.yaml", "result_uri": f"{home}/zmap_unclassified.pq", "done_uri": f"{job}/done.json", "failed_uri": f"{job}/failed.json", "created_at": "now"}
    for change in ({"version": 2}, {"protocol": "tcp"}, {"done_uri": "x"}, {"job_id": "/"}, {"extra": 1}, {"ipid_uri": "x"}):
        with pytest.raises(ValueError):
            worker.checked(request | change, prefix)
    os.makedirs(job)
    with open(f"{job}/request.json", "w") as f:
        json.dump(request, f)
    worker.watch(spark, prefix, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    with open(f"{job}/done.json") as f:
        done = json.load(f)
    targets = spark.read.parquet(request["result_uri"])
    assert done["rows"] == targets.count() > 0 and targets.columns == ["IP_ADDR", "REPLY_TYPE"] and len(done["sha256"]) == 64
    assert done["size_bytes"] > 0 and done["size_bytes"] == sum(os.path.getsize(os.path.join(request["result_uri"], x)) for x in os.listdir(request["result_uri"]) if x.endswith(".parquet"))
    documents = [(f"{prefix}/jobs/{j}/request.json", t) for j, t in (("icmp_1", json.dumps(request)), ("bad", "{"), ("odd", "[1]"), ("icmp_2", json.dumps(request)))]
    states = worker.run_documents(spark, documents, prefix)
    assert states["icmp_1"] == "skipped" and all(states[j].startswith("failed") and os.path.exists(f"{prefix}/jobs/{j}/failed.json") for j in ("bad", "odd", "icmp_2"))
    assert set(worker.run_documents(spark, documents, f"file:{prefix}").values()) == {"skipped"}


def test_analysis_requests(tmp_path):
    prefix = "s3a://store/work"
    job = f"{prefix}/analysis-jobs/tcp_1"
    request = {"version": 1, "job_id": "tcp_1", "protocol": "tcp", "manifest_uri": f"{job}/manifest.json", "zmap_prefix": "s3a://raw/zmap", "os_prefix": "s3a://raw/os", "ipid_prefix": "s3a://raw/ipid", "done_uri": f"{job}/done.json", "failed_uri": f"{job}/failed.json", "created_at": "now"}
    assert worker.checked(request, prefix, "analysis-jobs") == request
    for change in ({"zmap_prefix": "s3a://"}, {"manifest_uri": "x"}, {"version": 3}, {"job_id": "icmp_1"}, {"extra": 1}, {"created_at": None}):
        with pytest.raises(ValueError):
            worker.checked(request | change, prefix, "analysis-jobs")


def test_publish_leaves_nothing_on_failure(spark, tmp_path):
    bad = spark.range(5).select(F.expr("CASE WHEN id = 4 THEN raise_error('no') ELSE id END").alias("id"))
    with pytest.raises(Exception, match="no"):
        tables.publish(bad, str(tmp_path / "t.pq"))
    assert not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="no columns"):
        spark.range(1).write.parquet(str(tmp_path / "x.pq"))
        tables.scan(spark, str(tmp_path / "x.pq"), ["IP_ADDR"])


def test_plans_prune_and_push(spark, tmp_path, capsys):
    frame(spark, [("1", "UNCLASSIFIED")]).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "s.pq"))
    merge.follow_up_targets(spark.read.parquet(str(tmp_path / "s.pq"))).explain()
    plan = capsys.readouterr().out
    assert f"EqualTo({LABEL},UNCLASSIFIED)" in plan and "more" not in plan.split("ReadSchema")[1]


def same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert np.allclose(got[c], want[c], atol=1e-9) if got[c].dtype.kind == "f" else (got[c].astype(str) == want[c].astype(str)).all(), c


@pytest.mark.parametrize("name", [*registry.queries()])
def test_registered_query(spark, name):
    run, sql = registry.queries()[name], registry.oracle_sql().get(name)
    got = run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) or name in ("DQ_03_unknown_labels",)
    if sql:
        con = duckdb.connect()
        con.execute("CREATE VIEW orders AS SELECT * FROM '/root/testdata/sf0.001/orders.parquet'")
        same(got, con.sql(sql).df())


@pytest.mark.parametrize("name", ["JN_11_raw_with_labels", "JN_01_merge"])
def test_sequences_are_never_broadcast(spark, name):
    """Spark takes sequences of any number of rows for a few bytes a key: whatever it guesses, none goes through the driver."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert [r[LABEL] for r in sorted(rows)] == [*LABELS] and sum(r["COUNT"] for r in rows) == 1500
    assert {*registry.queries()} <= {*__spark_entry__.queries()} and {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
