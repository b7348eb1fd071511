"""The engine against plain-Python models on small random logs, known hash
trees, and the SQL of every registered query."""

import hashlib
import os
import random
from collections import OrderedDict, deque

import pytest
from pyspark.sql import functions as F

from keystrata import catalog
from keystrata.config import Config
from keystrata.functions.hashing import little_endian
from keystrata.functions.keys import base_key, valid_key, value_type
from keystrata.operators import cache, compaction, integrity, keyed_sketches, pruning, ratelimit, reads, sketches, versions
from keystrata.plans.store import LimitExceeded, Store
from keystrata.sources import records, runs as run_files, wal

LOG = "base_key string, value_type string, value string, tombstone boolean, ts long, seq long"


def random_log(seed, n=300, keys=25):
    r = random.Random(seed)
    return [(f"u{r.randrange(keys)}", r.choice(["string", "hll"]), str(r.randrange(99)), r.random() < 0.25, r.randrange(40), i) for i in range(n)]


def model(rows):
    best = {}
    for row in rows:
        if row[0] not in best or (row[4], row[5]) > (best[row[0]][4], best[row[0]][5]):
            best[row[0]] = row
    return best


def runs_of(spark, rows, size):
    out = []
    for gen in range(0, len(rows), size):
        out += [(0, gen // size, *v) for v in model(rows[gen : gen + size]).values()]
    return spark.createDataFrame(out, "level long, gen long, " + LOG)


@pytest.mark.parametrize("seed", [1, 2])
def test_views_and_reads(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, LOG)
    want = {k: v for k, v in model(rows).items() if not v[3]}
    assert {r.base_key: r.value for r in versions.live(log).collect()} == {k: v[2] for k, v in want.items()}
    past = {k: v[2] for k, v in model([r for r in rows if r[4] <= 20]).items() if not v[3]}
    assert {r.base_key: r.value for r in versions.as_of(log, 20).collect()} == past
    listed = sorted(k for k in want if k.startswith("u1"))
    assert sorted(r.base_key for r in reads.prefix(log, "u1").collect()) == listed
    pages = []
    for number in range(1, len(listed) // 3 + 3):
        pages += [r.base_key for r in reads.page(reads.prefix(log, "u1"), number, 3).collect()]
    assert pages == listed
    assert sorted(r.base_key for r in reads.between(log, "u10", "u2").collect()) == sorted(k for k in want if "u10" <= k <= "u2")
    assert [r.row_no for r in reads.shown(reads.page(reads.prefix(log, "u1"), 2, 3), 2, 3).orderBy("row_no").collect()] == list(range(4, 4 + len(listed[3:6])))
    with pytest.raises(ValueError):
        reads.between(log, "b", "a")
    with pytest.raises(ValueError):
        reads.page(log, 0, 5)


def test_edges_of_versions(spark):
    rows = [("u1", "string", "a", False, 5, 0), ("u1", "hll", "b", False, 5, 1), ("u10", "string", "c", False, 1, 2), ("u1a", "string", "d", True, 1, 3), ("u1a", "string", "e", False, 2, 4), ("gone", "string", "", True, 9, 5)]
    log = spark.createDataFrame(rows, LOG)
    assert {r.base_key: (r.value, r.value_type) for r in versions.live(log).collect()} == {"u1": ("b", "hll"), "u10": ("c", "string"), "u1a": ("e", "string")}
    assert reads.get(log, "u1-hll").first().value == "b" and reads.get(log, "gone").first() is None
    assert [r.base_key for r in reads.between(log, "u1", "u1").collect()] == ["u1"]
    assert reads.page(versions.live(log), 9, 5).count() == 0
    assert versions.live(log.limit(0)).count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    run_files.write(runs_of(spark, random_log(3), 50), str(tmp_path / "r"))
    plan = reads.get(run_files.read(spark, str(tmp_path / "r")), "u3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(base_key,u3)" in plan


@pytest.mark.parametrize("n, size", [(300, 20), (300, 37), (60, 60)])
def test_compactions_keep_the_live_view(spark, n, size):
    rows = random_log(n + size, n)
    runs = runs_of(spark, rows, size)
    want = {k: v[2] for k, v in model(rows).items() if not v[3]}
    for done in (compaction.size_tiered(runs, 3, 4), compaction.leveled(runs, 2, 4), compaction.tiered_store(runs, 3, 4)):
        assert {r.base_key: r.value for r in versions.live(done).collect()} == want
    last = runs.agg(F.max("gen")).first()[0]
    merged = compaction.flush_merging(runs.filter(F.col("gen") == last), runs.filter(F.col("gen") < last))
    assert {r.base_key: r.value for r in versions.live(merged.unionByName(runs.limit(0))).collect()} == want


def test_deletions_outlive_older_levels(spark):
    rows = [(1, 0, "a", "string", "x", False, 1, 0), (0, 0, "a", "string", "", True, 2, 1), (0, 1, "b", "string", "y", False, 3, 2)]
    runs = spark.createDataFrame(rows, "level long, gen long, " + LOG)
    done = compaction.tiered_store(runs, 2, 3)
    assert {r.base_key for r in versions.live(done).collect()} == {"b"}
    assert compaction.tiers(13, 3, 3) == [(13, 12), (4, 3), (1, 0)]
    dead = runs.filter("tombstone")
    assert compaction.size_tiered(dead, 2, 3).count() == 0  # nothing older is left


def test_pruning(spark):
    rows = random_log(5, 400, 60)
    runs = runs_of(spark, rows, 40).persist()
    own = {}
    for r in runs.collect():
        own.setdefault(r.gen, []).append(r.base_key)
    meta = {r.gen: (r.n, r.lo, r.hi) for r in pruning.run_meta(runs).collect()}
    assert meta == {g: (len(k), min(k), max(k)) for g, k in own.items()}
    meets = lambda a, b: a != b and not (meta[a][1] > meta[b][2] or meta[a][2] < meta[b][1])
    begins = sorted(own, key=lambda g: (meta[g][1], g))
    nexts = {a: b if meets(a, b) else None for a, b in zip(begins, [*begins[1:], begins[-1]])}
    assert {(r.gen, r.met, r.neighbour) for r in pruning.overlaps(pruning.run_meta(runs)).collect()} == {(a, sum(meets(a, b) for b in own), nexts[a]) for a in own}
    apart = spark.createDataFrame([(0, g, lo, hi) for g, lo, hi in ((5, "a", "c"), (2, "c", "c"), (9, "d", "z"), (4, "e", "f"), (1, "g", "h"), (7, "zz", "zz"))], "level long, gen long, lo string, hi string")
    assert {(r.gen, r.met, r.neighbour) for r in pruning.overlaps(apart).collect()} == {(5, 1, 2), (2, 1, None), (9, 2, 4), (4, 1, None), (1, 1, None), (7, 0, None)}
    index = pruning.dense_index(runs)
    summary = index.filter("i % 7 = 0")
    for key in ("u7", "u3", "a", "zz"):
        samples = {g: [(k, i) for i, k in enumerate(sorted(ks)) if i % 7 == 0 and k <= key] for g, ks in own.items()}
        assert {(r.gen, r.i, r.sampled) for r in pruning.floor_key(summary, key).collect()} == {(g, x[-1][1], x[-1][0]) for g, x in samples.items() if x}
        assert {(r.gen, r.i) for r in pruning.lookup(index, summary, key, 7).collect()} == {(g, sorted(ks).index(key)) for g, ks in own.items() if key in ks}
    assert {(r.gen, r.i, r.base_key) for r in pruning.sparse_summary(runs, 7).collect()} == {(g, i, k) for g, ks in own.items() for i, k in enumerate(sorted(ks)) if i % 7 == 0}
    m, k = sketches.bloom_size(60, 0.01)
    found = {r.gen for r in pruning.candidate_runs(runs, pruning.run_meta(runs), pruning.run_bloom(runs, m, k), "u7", m, k).collect()}
    assert {g for g, ks in own.items() if "u7" in ks} <= found


@pytest.mark.parametrize("size, block", [(3, 16), (14, 8), (5, 10_000)])
def test_lru(spark, size, block):
    r = random.Random(size)
    keys = [f"k{min(r.randrange(30), r.randrange(30))}" if i < 150 else f"k{i % 2}" for i in range(300)]
    held, want = OrderedDict(), []
    for k in keys:
        want.append(k in held)
        held[k] = 1
        held.move_to_end(k)
        if len(held) > size:
            held.popitem(last=False)
    got = cache.lru_hits(spark.createDataFrame(list(enumerate(keys)), "seq long, base_key string"), size, block)
    assert [x.hit for x in sorted(got.collect())] == want


def seeded(x, i, m):
    return int.from_bytes(hashlib.md5(x.encode() + i.to_bytes(4, "big") + bytes(28)).digest()[:8], "big") % m


def test_sketches(spark):
    words = [f"w{i % 37}" for i in range(200)]
    items = spark.createDataFrame([(w,) for w in words], "item string")
    m, k = sketches.bloom_size(20, 0.01)
    assert (m, k, *sketches.cms_size(0.1, 0.01)) == (192, 7, 28, 6)
    bits = sketches.bloom_bits(items, "item", m, k)
    assert {r.bit for r in bits.collect()} == {seeded(w, i, m) for w in words for i in range(1, k + 1)}
    assert all(r.may_contain for r in sketches.bloom_probe(items, "item", bits, m, k).collect())
    cells = sketches.cms_cells(items, "item", 28, 6)
    assert all(r.estimate >= words.count(r.item) for r in sketches.cms_query(items, "item", cells, 28, 6).collect())
    absent = sketches.cms_query(spark.createDataFrame([("none",)], "item string"), "item", cells.limit(0), 28, 6)
    assert absent.first().estimate == 0
    digests = [hashlib.md5(w.encode()).hexdigest() for w in set(words)]
    want = {}
    for d in digests:
        whole = "".join(f"{ord(c):08b}" for c in d)
        b, z = int(whole[:12], 2), len(whole) - len(whole.rstrip("0"))
        want[b] = max(want.get(b, 0), z)
    assert {r.bucket: r["rank"] for r in sketches.hll_registers(items, "item", 12).collect()} == want
    assert abs(sketches.hll_native(items, "item").first().estimate - 37) <= 2


def test_simhash(spark):
    texts = [(1, "a b a"), (2, "a b a"), (3, ""), (4, None), (5, "x  y"), (6, "Ä Z z")]
    bits = {r.id: r.bits for r in sketches.simhash(spark.createDataFrame(texts, "id int, text string"), "text").collect()}
    total = [0] * 256
    for w in ["x", "", "y"]:
        for i, b in enumerate("".join(f"{ord(c):08b}" for c in hashlib.md5(w.encode()).hexdigest())):
            total[i] += 2 * int(b) - 1
    assert bits[5] == "".join("0" if t < 0 else "1" for t in total)
    assert bits[1] == bits[2] and bits[3] == bits[4]
    pair = spark.createDataFrame([(bits[1], bits[2], bits[5])], "a string, b string, c string")
    got = pair.select(sketches.hamming(F.col("a"), F.col("b")).alias("same"), sketches.hamming(F.col("a"), F.col("c")).alias("far"), sketches.hamming(F.col("a"), F.lit(None).cast("string")).alias("none")).first()
    assert (got.same, got.far, got.none) == (0, sum(x != y for x, y in zip(bits[1], bits[5])), -1)


# Known hash trees, by the values they are over.
ROOTS = {
    ("1", "1"): "94654e91a27c2252ce7c733355c7b6ba4ea78966",
    ("1", "1", "1"): "8ff4376d6be5fedafdb41921575b2c7e7fe278b0",
    ("1", "2"): "58c6912831df431a52af3cd818caa352f60d8db0",
    ("5", "3", "4", "2", "6"): "84fdd61ec68b245183ab2d36eadb1af4b6fb6354",
}


def tree(values):
    level = [hashlib.sha1(v.encode()).digest() for v in values]
    while len(level) > 1:
        level += [bytes(20)] * (len(level) % 2)
        level = [hashlib.sha1(a + b).digest() for a, b in zip(level[::2], level[1::2])]
    return level[0].hex()


def test_merkle(spark, monkeypatch):
    cases = [list(v) for v in ROOTS] + [["x"], [str(i) for i in range(77)]]
    rows = spark.createDataFrame([(g, f"{i:03d}", v) for g, case in enumerate(cases) for i, v in enumerate(case)], "g int, k string, v string")
    want = {g: tree(c) for g, c in enumerate(cases)}
    assert [want[g] for g in range(4)] == list(ROOTS.values())
    for fold in (10, 2):
        monkeypatch.setattr(integrity, "FOLD", fold)
        assert {r.g: r.root for r in integrity.merkle_root(rows, "k", "v", "g").collect()} == want
    nodes = integrity.merkle_levels(rows, "k", "v", "g").collect()
    assert {r.g: r.hash for r in nodes if r.depth == 0} == want
    assert sum(r.g == 3 for r in nodes) == 13  # five leaves and their padding, three and padding, two, one
    assert integrity.merkle_root(rows.limit(0), "k", "v", "g").count() == 0


def test_positions_of_spread_groups(spark):
    from keystrata.operators.ranking import positioned

    r = random.Random(9)
    rows = [(g, k) for g in range(3) for k in r.sample([f"k{i}" for i in range(2000)], 900 if g == 0 else 50)]
    df = spark.createDataFrame(rows, "g int, k string")
    own = {}
    for g, k in sorted(rows):
        own[g, k] = sum(1 for a, b in own if a == g)
    for limit in (10, 5000):
        assert {(x.g, x.k): x.i for x in positioned(df, "k", "g", task_rows=limit).collect()} == own


def test_limiter(spark):
    r = random.Random(4)
    ops = sorted((r.choice("ab"), r.randrange(200), i) for i in range(300)) + [("c", 0, 900), ("c", 0, 901), ("c", 10, 902)]
    want, passed = {}, {}
    for k, ts, seq in sorted(ops):
        own = passed.setdefault(k, deque())
        while own and ts - own[0] >= 10:
            own.popleft()
        want[seq] = len(own) < 2
        if want[seq]:
            own.append(ts)
    got = ratelimit.limited(spark.createDataFrame(ops, "k string, ts long, seq long"), "k", 10, 2)
    assert {x.seq: x.accepted for x in got.collect()} == want
    assert want[902]  # exactly the window later


def test_log_records(spark, tmp_path):
    ops = spark.createDataFrame([(f"u{i}", "v" * i, i % 3 == 0, 1000 + i, i) for i in range(12)], "k string, value string, tombstone boolean, ts long, seq long")
    path = str(tmp_path / "wal")
    wal.append(ops, path, 5)
    log = wal.read(spark, path)
    assert {r.segment: r.n for r in wal.segment_counts(log).collect()} == {"wal_00001.log": 5, "wal_00002.log": 5, "wal_00003.log": 2}
    assert sorted({r.segment for r in wal.truncated(log, 2).collect()}) == [1] and wal.truncated(log, 1).count() == 0 and wal.truncated(log, 0).count() == 12
    bad = log.withColumn("value", F.when(F.col("seq") == 4, "broken").otherwise(F.col("value")))
    assert wal.checked(bad).filter("not valid").count() == 1 and "u4" not in {r.base_key for r in wal.replayed(bad).collect()}
    encoded = [bytes(r.b) for r in ops.select("seq", records.encoded(F.col("k"), F.col("value"), F.col("tombstone"), F.col("ts")).alias("b")).orderBy("seq").collect()]
    assert len(encoded[0]) == 31 and encoded[2][:4] == (lambda b: __import__("zlib").crc32(b).to_bytes(4, "little"))(encoded[2][4:])
    (tmp_path / "seg").mkdir()
    (tmp_path / "seg" / "wal_00001.log").write_bytes(b"".join(encoded) + b"cut")
    (tmp_path / "seg" / "wal_00002.log").write_bytes(encoded[5][:-1] + b"?")
    got = sorted(records.read_segments(spark, str(tmp_path / "seg")).collect())
    assert [(r.k, bytes(r.value).decode(), r.tombstone, r.ts) for r in got[:12]] == [(f"u{i}", "v" * i, i % 3 == 0, 1000 + i) for i in range(12)]
    assert [r.valid for r in got] == [True] * 12 + [False]


@pytest.mark.parametrize("kind", [1, 2])
def test_store(spark, tmp_path, kind):
    s = Store(spark, str(tmp_path / "store"), Config(compaction=kind, minimum_runs=2, levels=3), auto_flush=False)
    assert s.get("a") is None and not s.flush() and not s.compact() and s.log() is None
    assert s.put("a", "1", 1) and not s.put("a-b", "1", 1) and not s.put(" ", "1", 1) and not s.put("a", "", 1)
    assert s.put_all(spark.createDataFrame([(f"u{i:02d}", str(i), 2) for i in range(12)], "key string, value string, ts long")) == 12
    assert s.flush() and s.get("a") == "1"
    assert s.delete("a", 3) and s.put("u03", "new", 3) and s.delete("unknown", 3)
    assert s.get("a") is None and s.get("u03") == "new"
    assert s.flush()
    before = [tuple(r) for r in s.list("u").collect()]
    s.compact()
    assert [tuple(r) for r in s.list("u").collect()] == before and s.get("a") is None
    assert [r.base_key for r in s.list("u", 2).collect()] == [f"u{i:02d}" for i in range(5, 10)]
    assert [r.base_key for r in s.range_scan("u03", "u05").collect()] == ["u03", "u04", "u05"]
    assert s.put("a", "2", 3) and s.get("a") == "2" and s.put("z", "sketch", 4, "hll")
    assert s.flush()
    s.compact()
    assert s.get("a") == "2" and reads.shown(s.list("z"), 1, 5).first().shown == "Hyper Log Log"
    side = run_files.sidecars(s.runs(), Config())
    runs = {(r.level, r.gen) for r in s.runs().select("level", "gen").distinct().collect()}
    assert side["meta"].count() == len(runs) and side["bloom"].count() and side["summary"].count()
    assert {(r.level, r.gen) for r in s.contents().collect()} == runs and all(os.path.isdir(r.folder) for r in s.contents().collect())
    for name in run_files.SIDECARS:
        assert {(r.level, r.gen) for r in s.sidecar(name).select("level", "gen").distinct().collect()} == runs
    assert sorted(os.listdir(tmp_path / "store" / "runs")) == sorted(f"run={r['run']}" for r in s._state()["runs"])


def batch(spark, n, parts, first=0):
    return spark.range(n, numPartitions=parts).select(F.concat(F.lit("k"), (F.col("id") + first).cast("string")).alias("key"), F.lit("v").alias("value"), F.lit(1).alias("ts"))


def test_store_segments_and_truncation(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Config(segment_rows=5), auto_flush=False)
    for n, parts, first in ((12, 4, 0), (7, 3, 100), (1, 1, 200), (0, 1, 300), (9, 8, 400)):
        assert s.put_all(batch(spark, n, parts, first)) == n
    log = [(r.seq, r.k, r.segment) for r in s.log().orderBy("seq").collect()]
    assert [x[0] for x in log] == list(range(29)) and [x[2] for x in log] == [i // 5 + 1 for i in range(29)]
    assert [x[1] for x in log] == [f"k{i}" for a, n in ((0, 12), (100, 7), (200, 1), (400, 9)) for i in range(a, a + n)]
    assert s.truncate(0) == 0 and s.truncate(9) == 0 and s.truncate(3) == 20
    left = [(r.seq, r.segment) for r in s.log().orderBy("seq").collect()]
    assert left == [(i, (i - 20) // 5 + 1) for i in range(20, 29)]
    assert len(os.listdir(tmp_path / "s" / "log")) == 1  # whole folders went
    assert s.put_all(batch(spark, 3, 2, 500)) == 3 and s.log().agg(F.max("segment")).first()[0] == 3
    assert s.truncate(2) == 10 and [r.seq for r in s.log().orderBy("seq").collect()] == [30, 31] and s.flush() and s.log() is None
    far = spark.createDataFrame([(99_999,), (100_000,), (171_798,), (1_717_986_919,), (1_717_986_920,)], "segment long")
    assert sorted(r.segment for r in wal.segment_counts(far).collect()) == ["wal_100000.log", "wal_171798.log", "wal_1717986919.log", "wal_1717986920.log", "wal_99999.log"]


def test_store_flushes_by_distinct_keys(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Config(memtable_rows=5, flush_percent=80))
    assert s.put("a", "1", 1) and s.put("a", "2", 2) and s.put("b", "1", 3) and s.put("c", "1", 4) and s.delete("d", 5)
    assert s.log().count() == 5 and s.runs() is None  # four keys, but a deletion flushes nothing
    assert s.put("a", "3", 6)
    assert s.log() is None and s.runs().count() == 4 and s.get("a") == "3"
    before = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "s" / "runs").rglob("*.parquet"))}
    assert s.put_all(batch(spark, 6, 2)) == 6 and s.log() is None
    assert {p: os.stat(p).st_mtime_ns for p in before} == before  # a flush writes its own run alone
    assert {(r["level"], r["gen"]) for r in s._state()["runs"]} == {(0, 0), (0, 1)}


def test_store_survives_crashes_and_other_writers(spark, tmp_path, monkeypatch):
    s, other = (Store(spark, str(tmp_path / "s"), Config(), auto_flush=False) for _ in range(2))
    assert s.put_all(batch(spark, 6, 2)) == 6
    plain = type(s.states)._publish
    monkeypatch.setattr(type(s.states), "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    for broken in (s.flush, lambda: s.put("x", "1", 9), lambda: s.truncate(1)):
        with pytest.raises(OSError):
            broken()
    monkeypatch.setattr(type(s.states), "_publish", plain)
    assert s.log().count() == 6 and s.get("x") is None and s.get("k3") == "v"
    # another writer takes the next number first
    raced = []

    def slow(states, number, state):
        if not raced:
            raced.append(1)
            assert other.put_all(batch(spark, 4, 2, 50)) == 4
        return plain(states, number, state)

    monkeypatch.setattr(type(s.states), "_publish", slow)
    assert s.put_all(batch(spark, 3, 2, 80)) == 3
    assert [r.seq for r in s.log().orderBy("seq").collect()] == list(range(13)) and s.get("k51") == "v" and s.get("k82") == "v"
    # what is appended while a flush runs stays in the log
    raced.clear()
    assert s.flush() and s.log().count() == 4 and s.runs().count() == 13 and s.list("k").count() == 13


def test_store_get_opens_few_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Config(bloom_p=0.001, cache_size=2), auto_flush=False)
    for r in range(4):
        s.put_all(spark.createDataFrame([(f"k{(4 * i + r):03d}", f"{r}", 1) for i in range(50)], "key string, value string, ts long"))
        s.flush()
    for i in (10, 21, 162):
        assert s.get(f"k{i:03d}") == str(i % 4) and len(s.opened) <= 2 and (0, i % 4) in s.opened
    assert s.get("a") is None and s.opened == [] and s.get("k010x") is None and len(s.opened) <= 1
    assert "k162" in s.recent and "k010" not in s.recent
    assert s.get("k162") == "2" and s.opened == [] and s.put("k162", "new", 2) and s.get("k162") == "new"
    for r in (r for r in s._state()["runs"]):
        held = {x.base_key for x in s.runs(only=[r]).collect()}
        assert all(r in s.candidates(k) for k in sorted(held)[:5])


def test_store_sketches(spark, tmp_path):
    c = Config(hll_p=8, cms_epsilon=0.05, bloom_n=50, bloom_p=0.01)
    s = Store(spark, str(tmp_path / "s"), c, auto_flush=False)
    one = spark.createDataFrame([(k, f"i{i % 7 if k == 'a' else i}") for k in "ab" for i in range(20)], "base_key string, item string")
    two = spark.createDataFrame([("a", "i3"), ("a", "new"), ("c", "late")], "base_key string, item string")
    for now, kind in ((10, "hll"), (20, "cms"), (30, "bloom")):
        if now > 10:  # a key's sketch gives way to one of another kind
            assert s.delete_all(spark.createDataFrame([("c", now - 1)], "key string, ts long")) == 1
        assert s.put_sketches(one, kind, now) == 2
        assert s.update_sketches(two, kind, now + 1) == 2
        whole = {r.base_key: r.value for r in keyed_sketches.written(keyed_sketches.cells(one.union(two), kind, c)).collect()}
        assert {r.base_key: r.value for r in s.sketches(kind).collect()} == whole
        assert {r.base_key: (r.cell, r.n) for r in keyed_sketches.read(keyed_sketches.written(keyed_sketches.cells(two.filter("base_key = 'c'").limit(1), kind, c))).limit(1).collect()}
        probes = spark.createDataFrame([("a", "i3"), ("a", "absent"), ("c", "late"), ("zz", "i3")], "base_key string, item string")
        if kind == "hll":
            own = {k: sketches.hll_estimate(sketches.hll_registers(one.union(two).filter(F.col("base_key") == k), "item", 8), 8).first().estimate for k in "abc"}
            assert {r.base_key: r.estimate for r in s.distinct_counts().collect()} == pytest.approx(own)
        elif kind == "cms":
            assert {(r.base_key, r.item): r.estimate for r in s.counts(probes).collect()} == {("a", "i3"): 4, ("a", "absent"): 0, ("c", "late"): 1}
        else:
            assert {(r.base_key, r.item): r.may_contain for r in s.members(probes).collect()} == {("a", "i3"): True, ("a", "absent"): False, ("c", "late"): True}
    texts = spark.createDataFrame([("t", "x", "one two two"), ("t", "y", "one two three"), ("t", "z", "one two two")], "base_key string, name string, text string")
    assert s.put_sketches(texts, "simHash", 40) == 1 and s.update_sketches(texts.filter("name = 'z'").withColumn("text", F.lit("one two three")), "simHash", 41) == 1
    pairs = spark.createDataFrame([("t", "x", "y"), ("t", "y", "z"), ("t", "x", "gone"), ("u", "x", "y")], "base_key string, a string, b string")
    found = {(r.base_key, r.a, r.b): r.distance for r in s.distances(pairs).collect()}
    assert found["t", "x", "y"] > 0 and found["t", "y", "z"] == 0 and found["t", "x", "gone"] == found["u", "x", "y"] == -1
    with pytest.raises(ValueError):
        s._put_values(keyed_sketches.written_prints(keyed_sketches.fingerprints(texts)), "string", 1)
    s.flush()
    assert s.get("t").startswith("x=") and len(s.get("t").split(";")) == 3


def test_store_limits(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Config(limit_seconds=3600, limit_number=2), auto_flush=False, limited=True)
    assert s.get("a") is None and s.get("b") is None
    with pytest.raises(LimitExceeded):
        s.get("c")
    own = ratelimit.Limiter(10, 2)
    assert [own.allow(t) for t in (0, 1, 2, 10, 10.5, 11)] == [True, True, False, True, False, True]


def test_limiter_cuts_keys_at_pauses(spark):
    r = random.Random(31)
    for seconds, number, width in ((10, 2, 16), (5, 3, 5), (7, 1, 1000)):
        rows, now = [], 0
        for seq in range(400):
            now += r.choice([0, 0, 1, 2, 3, 3, 9, 10, 11, 40])
            rows.append((r.choice(["hot", "hot", "hot", "b", None]), now, seq))
        want, passed = {}, {}
        for k, ts, seq in rows:
            own = passed[k] = [t for t in passed.get(k, []) if ts - t < seconds]
            want[seq] = len(own) < number
            if want[seq]:
                own.append(ts)
        df = spark.createDataFrame(rows, "k string, ts long, seq long").repartition(4)
        assert {x.seq: x.accepted for x in ratelimit.limited(df, "k", seconds, number, width).collect()} == want


def test_known_checksum(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"123456789"))).first()[0] == 0xCBF43926
    numbers = [0, 1, 255, 256, 2**31, 2**62 + 12345, 2**63 - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select(little_endian(F.col("n"), 8).alias("b"), little_endian(F.col("n") % 256, 1).alias("c")).collect()
    assert [bytes(x.b) for x in got] == [n.to_bytes(8, "little") for n in numbers] and [bytes(x.c) for x in got] == [bytes([n % 256]) for n in numbers]


def test_plans_have_no_single_task_over_runs(spark):
    """Compaction plans bring single numbers to the driver and no list of runs."""
    meta = spark.range(600).select(F.lit(0).cast("long").alias("level"), F.col("id").alias("gen"), F.format_string("k%04d", F.col("id")).alias("lo"), F.format_string("k%04d", F.col("id") + 1).alias("hi"))
    plan = {r.gen: (r.to_level, r.to_gen) for r in compaction.leveled_plan(meta, 4, 3).collect()}
    assert plan[0] == plan[1] == (1, 0) and plan[2] == (0, 0) and plan[599] == (0, 597)
    tiers = {r.gen: (r.to_level, r.to_gen) for r in compaction.tiered_plan(meta, 4, 3).collect()}
    assert tiers[0] == (2, 0) and tiers[599] == (1, 1) and tiers[592] == (1, 0)


def test_config(tmp_path):
    assert Config.read(str(tmp_path / "none.json")) == Config()
    (tmp_path / "c.json").write_text('{"HLL": {"p": 12}, "LSMTree": {"LSMMinimum": 2}, "Other": {"x": 1}}')
    c = Config.read(str(tmp_path / "c.json"))
    assert (c.hll_p, c.minimum_runs, c.page_size) == (12, 2, 5)


def test_keys(spark):
    keys = spark.createDataFrame([(k,) for k in ("a", "a-hll", "b-simHash", " ", "", "x-y")], "k string")
    got = {r.k: (r.b, r.t, r.v) for r in keys.select("k", base_key(F.col("k")).alias("b"), value_type(F.col("k")).alias("t"), valid_key(F.col("k")).alias("v")).collect()}
    assert got == {"a": ("a", "string", True), "a-hll": ("a", "hll", False), "b-simHash": ("b", "simHash", False), " ": (" ", "string", False), "": ("", "string", False), "x-y": ("x", "string", False)}


def test_streams(spark, tmp_path):
    from keystrata.streaming.ingest import into_runs
    from keystrata.streaming.limiter import limited_stream

    rows = random_log(8, 120, 10)
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    into_runs(stream, str(tmp_path / "runs"), str(tmp_path / "check")).awaitTermination()
    got = versions.live(run_files.read(spark, str(tmp_path / "runs")))
    assert {r.base_key: r.value for r in got.collect()} == {k: v[2] for k, v in model(rows).items() if not v[3]}
    assert run_files.read(spark, str(tmp_path / "runs")).select("gen").distinct().count() == 3
    whole = spark.createDataFrame(rows, LOG).coalesce(1)
    whole.write.parquet(str(tmp_path / "one"))
    out = limited_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "one")), 10, 2)
    out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = {r.seq: r.accepted for r in ratelimit.limited(whole.select("base_key", "ts", "seq"), "base_key", 10, 2).collect()}
    assert {r.seq: r.accepted for r in spark.table("limited").collect()} == want


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, name):
    import duckdb

    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name not in catalog.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "documents", "lineitem", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(tuple(r)) for r in want)
