"""The registered queries over the driver's tables, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import seed_hex
from .functions.keys import valid_key
from .config import Config
from .operators import cache, compaction, integrity, keyed_sketches, pruning, ratelimit, reads, sketches, versions
from .plans.store import Store
from .sources import oplog, records, scratch, wal
from .sources import runs as run_files

# The settings the queries run with.
PREFIX, LOW, HIGH, KEY, PAGE = "u1", "u10", "u30", "u42", 2
AS_OF = 1705367014
SEGMENT, STEP, MINIMUM, LEVELS, CACHE = 5, 20, 4, 4, 14
LIMIT_SECONDS, LIMIT_NUMBER, PAGE_SIZE = 86_400, 5, 5
BLOOM_M, BLOOM_K = sketches.bloom_size(20, 0.01)
CMS_M, CMS_K = sketches.cms_size(0.1, 0.01)
HLL_P = 12

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOG = f"""
ev AS (
  SELECT *, 'u' || user_id || CASE event_type WHEN 'signup' THEN '-hll' WHEN 'view' THEN '-cms' ELSE '' END AS k FROM events
), log AS (
  SELECT k, split_part(k, '-', 1) AS base_key,
         CASE WHEN ends_with(k, '-hll') THEN 'hll' WHEN ends_with(k, '-cms') THEN 'cms' ELSE 'string' END AS value_type,
         CASE WHEN event_type = 'error' THEN '' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS value,
         event_type = 'error' AS tombstone, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, event_id // {oplog.RUN_OPS} AS run
  FROM ev
), latest AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY base_key ORDER BY ts DESC, seq DESC) AS n FROM log) WHERE n = 1
), live AS (SELECT base_key, value_type, value, ts, seq FROM latest WHERE NOT tombstone),
runs AS (
  SELECT CAST(0 AS BIGINT) AS level, run AS gen, base_key, value_type, value, tombstone, ts, seq
  FROM (SELECT *, row_number() OVER (PARTITION BY run, base_key ORDER BY ts DESC, seq DESC) AS n FROM log) WHERE n = 1
), meta AS (SELECT level, gen, count(*) AS n, min(base_key) AS lo, max(base_key) AS hi FROM runs GROUP BY ALL)
"""


def query(sql: str | None = None, over_log: bool = True):
    """Register a query under its function's name, with its SQL if there is one."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {LOG} {sql}" if over_log else sql
        return f

    return keep


def hash_sql(x: str, k: int, m: int) -> str:
    """A list of k seeded hashes of the SQL text expression x."""
    return "[" + ", ".join(f"CAST(('0x' || substr(md5(CAST({x} AS BLOB) || unhex('{seed_hex(i)}')), 1, 16))::UBIGINT % {m} AS INTEGER)" for i in range(1, k + 1)) + "]"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.level0(oplog.from_events(spark, sf_dir))


# ------------------------------------------------------------------ views


@query("SELECT * FROM live")
def live_view(spark, sf_dir):
    return versions.live(oplog.from_events(spark, sf_dir))


@query(f"""SELECT base_key, value_type, value, ts, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY base_key ORDER BY ts DESC, seq DESC) AS n FROM log WHERE ts <= {AS_OF}) WHERE n = 1 AND NOT tombstone""")
def as_of_view(spark, sf_dir):
    return versions.as_of(oplog.from_events(spark, sf_dir), AS_OF)


@query(f"SELECT * FROM live WHERE base_key = '{KEY}'")
def point_get(spark, sf_dir):
    return reads.get(oplog.from_events(spark, sf_dir), KEY)


@query(f"SELECT * FROM live WHERE base_key LIKE '{PREFIX}%'")
def prefix_list(spark, sf_dir):
    return reads.prefix(oplog.from_events(spark, sf_dir), PREFIX)


@query(f"SELECT * FROM live WHERE base_key LIKE '{PREFIX}%' ORDER BY base_key LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE * (PAGE - 1)}")
def prefix_page(spark, sf_dir):
    return reads.page(reads.prefix(oplog.from_events(spark, sf_dir), PREFIX), PAGE, PAGE_SIZE)


@query(f"SELECT * FROM live WHERE base_key BETWEEN '{LOW}' AND '{HIGH}'")
def range_scan(spark, sf_dir):
    return reads.between(oplog.from_events(spark, sf_dir), LOW, HIGH)


@query(f"SELECT * FROM live WHERE base_key BETWEEN '{LOW}' AND '{HIGH}' ORDER BY base_key LIMIT {PAGE_SIZE} OFFSET {2 * PAGE_SIZE}")
def range_page(spark, sf_dir):
    return reads.page(reads.between(oplog.from_events(spark, sf_dir), LOW, HIGH), 3, PAGE_SIZE)


@query(f"""SELECT row_number() OVER (ORDER BY base_key) + {PAGE_SIZE * (PAGE - 1)} AS row_no, base_key,
  CASE value_type WHEN 'hll' THEN 'Hyper Log Log' WHEN 'cms' THEN 'Count min sketch' ELSE value END AS shown
  FROM (SELECT * FROM live WHERE base_key LIKE '{PREFIX}%' ORDER BY base_key LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE * (PAGE - 1)})""")
def display_page(spark, sf_dir):
    return reads.shown(prefix_page(spark, sf_dir), PAGE, PAGE_SIZE)


@query("SELECT base_key, value_type, value, tombstone, ts, seq FROM latest")
def ordered_scan(spark, sf_dir):
    return reads.ordered(oplog.from_events(spark, sf_dir))


@query("SELECT value_type, count(*) AS n FROM live GROUP BY ALL")
def type_counts(spark, sf_dir):
    return reads.by_type(oplog.from_events(spark, sf_dir))


@query("SELECT k, NOT contains(k, '-') AND trim(k) <> '' AS valid, count(*) AS n FROM log GROUP BY ALL")
def key_validation(spark, sf_dir):
    return oplog.from_events(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n")).select("k", valid_key(F.col("k")).alias("valid"), "n")


# -------------------------------------------------------------------- log


def _wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.stamped(oplog.from_events(spark, sf_dir).select("k", "value", "tombstone", "ts", "seq"), SEGMENT)


@query(f"SELECT k, value, tombstone, ts, seq, seq // {SEGMENT} + 1 AS segment FROM log")
def wal_append(spark, sf_dir):
    return _wal(spark, sf_dir).drop("crc")


@query(f"SELECT format('wal_{{:05d}}.log', seq // {SEGMENT} + 1) AS segment, count(*) AS n FROM log GROUP BY ALL")
def wal_segment_counts(spark, sf_dir):
    return wal.segment_counts(_wal(spark, sf_dir))


@query("SELECT base_key, value_type, value, tombstone, ts, seq FROM latest")
def wal_replay(spark, sf_dir):
    return wal.replayed(_wal(spark, sf_dir))


@query(f"""SELECT k, seq, seq // {SEGMENT} + 1 - greatest(0, (SELECT max(seq // {SEGMENT} + 1) FROM log) - 2) AS segment
  FROM log WHERE seq // {SEGMENT} + 1 > (SELECT max(seq // {SEGMENT} + 1) FROM log) - 2""")
def wal_truncate(spark, sf_dir):
    return wal.truncated(_wal(spark, sf_dir), 3).select("k", "seq", "segment")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.from_events(spark, sf_dir).select("seq", records.encoded(F.col("k"), F.col("value"), F.col("tombstone"), F.col("ts")).alias("data"))


@query("SELECT NOT tombstone AS valid, count(*) AS n FROM log GROUP BY ALL")
def crc_check(spark, sf_dir):
    """The records' bytes, in which every deletion mark was wiped out: the
    checksum tells those that had one."""
    stored = _records(spark, sf_dir)
    wiped = F.concat(F.substring("data", 1, 12), F.lit(b"\0"), F.substring("data", 14, 2**30))
    return stored.select(records.fields(wiped)["valid"].alias("valid")).groupBy("valid").agg(F.count("*").alias("n"))


@query("""SELECT seq, k, value, tombstone, ts, true AS valid, 29 + strlen(k) + strlen(value) AS bytes FROM log""")
def record_codec(spark, sf_dir):
    """Records written as bytes and read back field by field."""
    read = _records(spark, sf_dir).select("seq", records.fields(F.col("data")).alias("r"), F.length("data").cast("long").alias("bytes"))
    return read.select("seq", "r.k", F.decode("r.value", "utf-8").alias("value"), "r.tombstone", "r.ts", "r.valid", "bytes")


@query("SELECT max(ts) < epoch(now()) AS past FROM log")
def log_is_past(spark, sf_dir):
    """The clock that stamps new records is ahead of all that the log holds."""
    return oplog.from_events(spark, sf_dir).agg((F.max("ts") < F.unix_timestamp()).alias("past"))


# ------------------------------------------------------------------- runs


@query("SELECT * FROM runs")
def flush_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query("SELECT * FROM meta")
def run_meta(spark, sf_dir):
    return pruning.run_meta(_runs(spark, sf_dir))


@query("""SELECT a.level, a.gen, (SELECT count(*) FROM meta b WHERE b.level = a.level AND b.gen <> a.gen AND NOT (a.lo > b.hi OR a.hi < b.lo)) AS met,
  CASE WHEN lead(a.lo) OVER w <= a.hi THEN lead(a.gen) OVER w END AS neighbour FROM meta a WINDOW w AS (PARTITION BY a.level ORDER BY a.lo, a.gen)""")
def run_overlap(spark, sf_dir):
    return pruning.overlaps(pruning.run_meta(_runs(spark, sf_dir)))


DENSE = "dense AS (SELECT level, gen, row_number() OVER (PARTITION BY level, gen ORDER BY base_key) - 1 AS i, base_key FROM runs)"


@query(f", {DENSE} SELECT * FROM dense")
def dense_index(spark, sf_dir):
    return pruning.dense_index(_runs(spark, sf_dir))


@query(f", {DENSE} SELECT * FROM dense WHERE i % {STEP} = 0")
def sparse_summary(spark, sf_dir):
    return pruning.sparse_summary(_runs(spark, sf_dir), STEP)


@query(f", {DENSE}, s AS (SELECT level, gen, max(i) AS start FROM dense WHERE i % {STEP} = 0 AND base_key <= '{KEY}' GROUP BY ALL) SELECT level, gen, start AS i, base_key AS sampled FROM s JOIN dense USING (level, gen) WHERE i = start")
def sparse_floor(spark, sf_dir):
    return pruning.floor_key(pruning.sparse_summary(_runs(spark, sf_dir), STEP), KEY)


@query(f", {DENSE} SELECT level, gen, i FROM dense WHERE base_key = '{KEY}'")
def dense_lookup(spark, sf_dir):
    index = pruning.dense_index(_runs(spark, sf_dir))
    return pruning.lookup(index, index.filter(F.col("i") % STEP == 0), KEY, STEP)


@query(f", {DENSE}, w AS (SELECT level, gen, max(i) AS i FROM dense GROUP BY ALL) SELECT level, gen, i, base_key FROM dense JOIN w USING (level, gen, i)")
def dense_positions(spark, sf_dir):
    """The last entry of each run, found by its position."""
    index = pruning.dense_index(_runs(spark, sf_dir))
    return pruning.at_positions(index, index.groupBy("level", "gen").agg(F.max("i").alias("i")))


_REST = f"""target AS (SELECT * FROM meta WHERE gen = 0),
over AS (SELECT m.gen FROM meta m, target t WHERE NOT (m.lo > t.hi OR m.hi < t.lo) AND (SELECT count(*) FROM meta) >= {MINIMUM}),
rest AS (SELECT gen, row_number() OVER (ORDER BY gen) - 1 AS new_gen FROM meta WHERE gen NOT IN (SELECT gen FROM over))"""


@query(f", {_REST} SELECT CAST(0 AS BIGINT) AS level, gen, new_gen FROM rest")
def renumber(spark, sf_dir):
    """The runs that a leveled compaction leaves in level 0, numbered anew."""
    meta = pruning.run_meta(_runs(spark, sf_dir))
    stay = compaction.leveled_plan(meta, MINIMUM, LEVELS).filter("to_level = 0").select("level", "gen")
    return compaction.renumbered(stay)


_T = f"""t0 AS (SELECT count(DISTINCT gen) AS n FROM runs),
t AS (SELECT n AS n0, n // {MINIMUM} AS n1, n // {MINIMUM} // {MINIMUM} AS n2, n // {MINIMUM} // {MINIMUM} // {MINIMUM} AS n3 FROM t0),
placed AS (
  SELECT r.* EXCLUDE (level, gen), CASE WHEN gen >= n1 * {MINIMUM} THEN 0 WHEN gen // {MINIMUM} >= n2 * {MINIMUM} THEN 1 WHEN gen // {MINIMUM**2} >= n3 * {MINIMUM} THEN 2 ELSE 3 END AS level,
    CASE WHEN gen >= n1 * {MINIMUM} THEN gen - n1 * {MINIMUM} WHEN gen // {MINIMUM} >= n2 * {MINIMUM} THEN gen // {MINIMUM} - n2 * {MINIMUM}
         WHEN gen // {MINIMUM**2} >= n3 * {MINIMUM} THEN gen // {MINIMUM**2} - n3 * {MINIMUM} ELSE gen // {MINIMUM**3} END AS gen
  FROM runs r, t
), merged AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY level, gen, base_key ORDER BY ts DESC, seq DESC) AS n FROM placed) WHERE n = 1)"""


@query(f""", {_T} SELECT CAST(level AS BIGINT) AS level, gen, base_key, value_type, value, tombstone, ts, seq FROM merged
  WHERE NOT (tombstone AND gen = 0 AND level = (SELECT max(level) FROM placed)
    AND ts < coalesce((SELECT min(ts) FROM placed WHERE NOT (gen = 0 AND level = (SELECT max(level) FROM placed))), {2**62}))""")
def compact_size_tiered(spark, sf_dir):
    return compaction.size_tiered(_runs(spark, sf_dir), MINIMUM, LEVELS)


@query(f""", {_REST},
placed AS (SELECT r.* EXCLUDE (level, gen), CASE WHEN x.gen IS NULL THEN 1 ELSE 0 END AS level, coalesce(x.new_gen, 0) AS gen FROM runs r LEFT JOIN rest x ON x.gen = r.gen),
merged AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY level, gen, base_key ORDER BY ts DESC, seq DESC) AS n FROM placed) WHERE n = 1)
SELECT CAST(level AS BIGINT) AS level, gen, base_key, value_type, value, tombstone, ts, seq FROM merged
WHERE NOT (tombstone AND level = 1 AND ts < coalesce((SELECT min(ts) FROM placed WHERE level = 0), {2**62}))""")
def compact_leveled(spark, sf_dir):
    return compaction.leveled(_runs(spark, sf_dir), MINIMUM, LEVELS)


@query(""", target AS (SELECT * FROM meta WHERE gen = (SELECT max(gen) FROM meta)),
over AS (SELECT m.gen FROM meta m, target t WHERE NOT (m.lo > t.hi OR m.hi < t.lo)),
merged AS (SELECT *, row_number() OVER (PARTITION BY base_key ORDER BY ts DESC, seq DESC) AS n FROM runs WHERE gen IN (SELECT gen FROM over))
SELECT CAST(0 AS BIGINT) AS level, (SELECT count(*) FROM meta WHERE gen NOT IN (SELECT gen FROM over)) AS gen, base_key, value_type, value, tombstone, ts, seq FROM merged WHERE n = 1""")
def leveled_flush(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    last = runs.agg(F.max("gen").alias("m")).first()["m"]
    return compaction.flush_merging(runs.filter(F.col("gen") == last), runs.filter(F.col("gen") < last))


@query("SELECT * FROM live")
def stored_live_view(spark, sf_dir):
    """Runs written, read, compacted, written and read again."""
    first, second = scratch.folder(spark), scratch.folder(spark)
    run_files.write(_runs(spark, sf_dir), first)
    run_files.write(compaction.size_tiered(run_files.read(spark, first), MINIMUM, LEVELS), second)
    return versions.live(run_files.read(spark, second))


@query("SELECT base_key, value_type, value, tombstone, ts, seq FROM latest")
def stored_wal_replay(spark, sf_dir):
    """The log written in segments and replayed from its files."""
    path = scratch.folder(spark)
    wal.append(oplog.from_events(spark, sf_dir).select("k", "value", "tombstone", "ts", "seq"), path, SEGMENT)
    return wal.replayed(wal.read(spark, path))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""", over_log=False)
def latest_orders(spark, sf_dir):
    """Latest-wins over a second log: a customer's orders are its versions."""
    orders = oplog.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("base_key"), F.lit("string").alias("value_type"), F.struct("o_orderkey", "o_totalprice", "o_orderstatus").alias("value"),
        F.lit(False).alias("tombstone"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderkey").alias("seq"),
    )
    return versions.live(orders).select(F.col("base_key").alias("o_custkey"), "value.*")


# ------------------------------------------------------- pruning and cache


@query(f", x AS (SELECT DISTINCT base_key FROM log) SELECT DISTINCT unnest({hash_sql('base_key', BLOOM_K, BLOOM_M)}) AS bit FROM x")
def bloom_bits(spark, sf_dir):
    return sketches.bloom_bits(oplog.from_events(spark, sf_dir), "base_key", BLOOM_M, BLOOM_K)


@query(f", x AS (SELECT DISTINCT level, gen, base_key FROM runs) SELECT DISTINCT level, gen, unnest({hash_sql('base_key', BLOOM_K, BLOOM_M)}) AS bit FROM x")
def run_bloom_bits(spark, sf_dir):
    return pruning.run_bloom(_runs(spark, sf_dir), BLOOM_M, BLOOM_K)


def grown_sql(x: str, i: str, m: str) -> str:
    """The hash of the SQL text x by the seed in i, modulo m, both SQL expressions."""
    return f"CAST(('0x' || substr(md5(CAST({x} AS BLOB) || unhex(printf('%08x', {i}) || repeat('00', 28))), 1, 16))::UBIGINT % CAST({m} AS UBIGINT) AS BIGINT)"


def bloom_sql(n: str, p: float) -> str:
    """Bits m and hashes k for n elements, from a table or query n with a column n."""
    return f"SELECT m, CAST(ceil(m / n * ln(2.0::DOUBLE)) AS BIGINT) AS k FROM (SELECT n, CAST(ceil(n * abs(ln({p}::DOUBLE)) / pow(ln(2.0::DOUBLE), 2)) AS BIGINT) AS m FROM {n})"


@query(f""", x AS (SELECT DISTINCT base_key FROM log), c AS (SELECT count(*) AS n FROM x), size AS ({bloom_sql('c', 0.01)}),
bits AS (SELECT DISTINCT {grown_sql('base_key', 'i', 'm')} AS bit FROM (SELECT base_key, m, unnest(range(1, k + 1)) AS i FROM x, size)),
h AS (SELECT base_key, {grown_sql('base_key', 'i', 'm')} AS bit FROM (SELECT 'u' || c_custkey AS base_key, m, unnest(range(1, k + 1)) AS i FROM customer, size))
SELECT base_key, count(*) = count(b.bit) AS may_contain FROM h LEFT JOIN bits b USING (bit) GROUP BY base_key""")
def bloom_probe(spark, sf_dir):
    """The filter of the whole log, sized by its distinct keys, asked for every customer."""
    log = oplog.from_events(spark, sf_dir)
    m, k = sketches.bloom_size(max(1, log.select("base_key").distinct().count()), 0.01)
    probes = oplog.table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("base_key"))
    return sketches.bloom_probe(probes, "base_key", sketches.bloom_bits(log, "base_key", m, k), m, k)


_MORE_M, _MORE_K = sketches.bloom_size(500, 0.01)


@query(f""", x AS (SELECT DISTINCT level, gen, base_key FROM runs), bits AS (SELECT DISTINCT level, gen, unnest({hash_sql('base_key', _MORE_K, _MORE_M)}) AS bit FROM x),
w AS (SELECT DISTINCT unnest({hash_sql(f"'{KEY}'", _MORE_K, _MORE_M)}) AS bit)
SELECT level, gen FROM bits JOIN w USING (bit) JOIN meta USING (level, gen) WHERE lo <= '{KEY}' AND hi >= '{KEY}' GROUP BY level, gen HAVING count(*) = (SELECT count(*) FROM w)""")
def run_candidates(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return pruning.candidate_runs(runs, pruning.run_meta(runs), pruning.run_bloom(runs, _MORE_M, _MORE_K), KEY, _MORE_M, _MORE_K)


@query(f""", a AS (SELECT seq, base_key, lag(seq) OVER (PARTITION BY base_key ORDER BY seq) AS prev, lead(seq) OVER (PARTITION BY base_key ORDER BY seq) AS next FROM log),
-- between two uses of a key, the others used are those whose last use before now lies after the first
d AS (SELECT a.seq, count(b.seq) AS n FROM a JOIN a b ON b.seq > a.prev AND b.seq < a.seq AND (b.next IS NULL OR b.next > a.seq) GROUP BY a.seq)
SELECT a.seq, a.base_key, a.prev IS NOT NULL AND coalesce(d.n, 0) < {CACHE} AS hit FROM a LEFT JOIN d USING (seq)""")
def lru_hits(spark, sf_dir):
    return cache.lru_hits(oplog.from_events(spark, sf_dir), CACHE)


# --------------------------------------------------------------- sketches


_CELLS = f"c AS (SELECT base_key, count(*) AS n FROM log GROUP BY 1), h AS (SELECT base_key, n, unnest({hash_sql('base_key', CMS_K, CMS_M)}) AS j, unnest(range({CMS_K})) AS r FROM c), cells AS (SELECT CAST(r AS INTEGER) AS r, j, CAST(sum(n) AS BIGINT) AS c FROM h GROUP BY ALL)"


@query(f", {_CELLS} SELECT * FROM cells")
def cms_cells(spark, sf_dir):
    return sketches.cms_cells(oplog.from_events(spark, sf_dir), "base_key", CMS_M, CMS_K)


@query(f", {_CELLS} SELECT h.base_key, min(cells.c) AS estimate FROM h JOIN cells ON cells.r = h.r AND cells.j = h.j GROUP BY h.base_key")
def cms_query(spark, sf_dir):
    log = oplog.from_events(spark, sf_dir)
    return sketches.cms_query(log, "base_key", sketches.cms_cells(log, "base_key", CMS_M, CMS_K), CMS_M, CMS_K)


_LINES_M, _LINES_K = sketches.cms_size(0.001, 0.01)


@query(f"""WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS part, count(*) AS n FROM lineitem GROUP BY 1), h AS (SELECT n, unnest({hash_sql('part', _LINES_K, _LINES_M)}) AS j, unnest(range({_LINES_K})) AS r FROM c)
SELECT CAST(r AS INTEGER) AS r, j, CAST(sum(n) AS BIGINT) AS c FROM h GROUP BY ALL""", over_log=False)
def cms_lineitem(spark, sf_dir):
    parts = oplog.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    return sketches.cms_cells(parts, "part", _LINES_M, _LINES_K)


@query("""SELECT page_id, split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) AS host, starts_with(url, 'https') AS secure, contains(url, '?') AS has_query, lower(url) AS lowered, md5(url) AS digest,
  sha1(url) AS sha, (ascii(url) >> 3) & 1 AS bit, CAST(bit_count(xor(page_id, 255::BIGINT)) AS INTEGER) AS ones, lpad(CAST(page_id AS VARCHAR), 8, '0') AS padded, lower(hex(encode(url))) AS bytes,
  CAST(page_id % 7 AS BIGINT) AS rest, TRY_CAST(substr(url, 9, 3) AS BIGINT) AS number, url < 'https://m' AS before FROM pages""", over_log=False)
def scalar_functions(spark, sf_dir):
    url, n = F.col("url"), F.col("page_id")
    host = F.split_part(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"), F.lit(1))
    return oplog.table(spark, sf_dir, "pages").select(
        "page_id", host.alias("host"), F.startswith(url, F.lit("https")).alias("secure"), F.contains(url, F.lit("?")).alias("has_query"), F.lower(url).alias("lowered"), F.md5(url.cast("binary")).alias("digest"),
        F.sha1(url.cast("binary")).alias("sha"), F.shiftright(F.ascii(url), 3).bitwiseAND(F.lit(1)).alias("bit"), F.bit_count(n.bitwiseXOR(F.lit(255).cast("long"))).alias("ones"), F.lpad(n.cast("string"), 8, "0").alias("padded"), F.lower(F.hex(url)).alias("bytes"),
        F.pmod(n, F.lit(7).cast("long")).alias("rest"), F.substring(url, 9, 3).try_cast("long").alias("number"), (url < "https://m").alias("before"),
    )


_REGISTERS = f"""x AS (SELECT DISTINCT md5(CAST(o_custkey AS VARCHAR)) AS x FROM orders),
y AS (SELECT ascii(x[1]) * 16 + (ascii(x[2]) >> 4) AS bucket, ascii(x[32]) AS last FROM x),
reg AS (SELECT CAST(bucket AS INTEGER) AS bucket, max(CAST(CASE WHEN last & 1 = 1 THEN 0 WHEN last & 3 = 2 THEN 1 WHEN last & 7 = 4 THEN 2 WHEN last & 15 = 8 THEN 3 WHEN last & 31 = 16 THEN 4 ELSE 5 END AS INTEGER)) AS rank FROM y GROUP BY 1)"""


@query(f"WITH {_REGISTERS} SELECT * FROM reg", over_log=False)
def hll_registers(spark, sf_dir):
    return sketches.hll_registers(oplog.table(spark, sf_dir, "orders"), "o_custkey", HLL_P)


@query(f"""WITH {_REGISTERS}, s AS (SELECT sum(pow(2.0, -rank)) AS s, count(*) FILTER (rank > 0) AS filled, count(*) AS seen FROM reg),
e AS (SELECT *, 0.7213 / (1 + 1.079 / 4096.0::DOUBLE) * 4096 * 4096 / (s + 4096 - seen) AS raw, 4096.0::DOUBLE - filled AS v FROM s)
SELECT CASE WHEN raw <= 2.5 * 4096 AND v > 0 THEN 4096 * ln(4096.0::DOUBLE / v) WHEN raw > 4294967296.0 / 30 THEN -4294967296.0 * ln(1 - raw / 4294967296.0) ELSE raw END AS estimate FROM e""", over_log=False)
def hll_estimate(spark, sf_dir):
    return sketches.hll_estimate(hll_registers(spark, sf_dir), HLL_P)


@query("SELECT count(DISTINCT o_custkey) AS exact, true AS close FROM orders", over_log=False)
def hll_native(spark, sf_dir):
    """The engine's own sketch, which is to be within a twentieth."""
    orders = oplog.table(spark, sf_dir, "orders")
    exact = orders.agg(F.countDistinct("o_custkey").alias("exact")).first()["exact"]
    return sketches.hll_native(orders, "o_custkey").select(F.lit(exact).cast("long").alias("exact"), (F.abs(F.col("estimate") - exact) <= 0.05 * exact).alias("close"))


_SIMHASH = """w AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), ' ')) AS word FROM documents),
c AS (SELECT doc_id, md5(word) AS x, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT doc_id, n, unnest(range(1, 33)) AS i, ascii(unnest(string_split(x, ''))) AS a FROM c),
z AS (SELECT doc_id, i, b, sum(n * (2 * ((a >> (7 - b)) & 1) - 1)) AS s FROM h, range(8) t(b) GROUP BY ALL),
bits AS (SELECT doc_id, string_agg(CASE WHEN s < 0 THEN '0' ELSE '1' END, '' ORDER BY i, b) AS bits FROM z GROUP BY doc_id)"""


@query(f"WITH {_SIMHASH} SELECT * FROM bits", over_log=False)
def simhash_bits(spark, sf_dir):
    docs = oplog.table(spark, sf_dir, "documents").select("doc_id", "text")
    return sketches.simhash(docs, "text").select("doc_id", "bits")


@query(f"""WITH {_SIMHASH} SELECT a.doc_id, CASE WHEN b.bits IS NULL THEN -1 ELSE hamming(a.bits, b.bits) END AS distance
FROM bits a LEFT JOIN bits b ON b.doc_id = a.doc_id + 1""", over_log=False)
def simhash_hamming(spark, sf_dir):
    path = scratch.folder(spark)
    simhash_bits(spark, sf_dir).write.parquet(path)  # both sides of the join read it
    bits = spark.read.parquet(path)
    other = bits.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bits").alias("next"))
    return bits.join(other, "doc_id", "left").select("doc_id", sketches.hamming(F.col("bits"), F.col("next")).alias("distance"))


@query("""WITH g AS (SELECT n, p, e, d FROM (VALUES (20), (500), (100000), (1000000)) a(n), (VALUES (0.1::DOUBLE), (0.01), (0.001)) b(p), (VALUES (0.1::DOUBLE), (0.001)) c(e), (VALUES (0.01::DOUBLE), (0.0001)) x(d)),
m AS (SELECT *, CAST(ceil(n * abs(ln(p)) / pow(ln(2.0::DOUBLE), 2)) AS BIGINT) AS m FROM g)
SELECT CAST(n AS BIGINT) AS n, p, e AS epsilon, d AS delta, m, CAST(ceil(m / n * ln(2.0::DOUBLE)) AS BIGINT) AS k, CAST(ceil(exp(1) / e) AS BIGINT) AS cms_m, CAST(ceil(ln(exp(1) / d)) AS BIGINT) AS cms_k FROM m""", over_log=False)
def sketch_sizes(spark, sf_dir):
    grid = spark.createDataFrame([(n, p, e, d) for n in (20, 500, 100_000, 1_000_000) for p in (0.1, 0.01, 0.001) for e in (0.1, 0.001) for d in (0.01, 0.0001)], "n long, p double, epsilon double, delta double")
    return grid.select("n", "p", "epsilon", "delta", *sketches.size_columns(F.col("n"), F.col("p"), F.col("epsilon"), F.col("delta")))


# -------------------------------------------- sketches as values of keys

SKETCH = Config(hll_p=8, cms_epsilon=0.05, cms_delta=0.01, bloom_n=200, bloom_p=0.01)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of each type of event."""
    return oplog.table(spark, sf_dir, "events").select(F.col("event_type").alias("base_key"), F.col("user_id").cast("string").alias("item"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))


def _put(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return keyed_sketches.written(keyed_sketches.cells(_items(spark, sf_dir).select("base_key", "item"), kind, SKETCH))


def _updated(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Put with what came up to AS_OF, updated with what came after."""
    items = _items(spark, sf_dir)
    values = keyed_sketches.written(keyed_sketches.cells(items.filter(F.col("ts") <= AS_OF).select("base_key", "item"), kind, SKETCH))
    return keyed_sketches.updated(values, items.filter(F.col("ts") > AS_OF).select("base_key", "item"), kind, SKETCH)


_KEYED = "x AS (SELECT event_type AS base_key, CAST(user_id AS VARCHAR) AS item, count(*) AS times FROM events GROUP BY ALL)"
_KM, _KK = keyed_sketches.sizes("cms", SKETCH)
_BM, _BK = keyed_sketches.sizes("bloom", SKETCH)
_KEYED_CELLS = {
    "hll": """c AS (SELECT base_key, cell, max(n) AS n FROM (SELECT base_key, CAST(ascii(md5(item)[1]) AS BIGINT) AS cell, ascii(md5(item)[32]) AS a,
      CAST(CASE WHEN a & 1 = 1 THEN 0 WHEN a & 3 = 2 THEN 1 WHEN a & 7 = 4 THEN 2 WHEN a & 15 = 8 THEN 3 WHEN a & 31 = 16 THEN 4 ELSE 5 END AS BIGINT) AS n FROM x) GROUP BY ALL)""",
    "cms": f"c AS (SELECT base_key, cell, CAST(sum(times) AS BIGINT) AS n FROM (SELECT base_key, times, unnest(range({_KK})) * {_KM} + unnest({hash_sql('item', _KK, _KM)}) AS cell FROM x) GROUP BY ALL)",
    "bloom": f"c AS (SELECT DISTINCT base_key, CAST(unnest({hash_sql('item', _BK, _BM)}) AS BIGINT) AS cell, 1 AS n FROM x)",
}
_VALUE = "SELECT base_key, string_agg(cell || ':' || n, ',' ORDER BY cell) AS value FROM c GROUP BY base_key"


def _keyed(kind: str) -> None:
    """Register the put and the update of a kind of sketch: the value is the same."""
    sql = f"WITH {_KEYED}, {_KEYED_CELLS[kind]} {_VALUE}"
    for name, made in ((f"{kind}_put", _put), (f"{kind}_update", _updated)):
        QUERIES[name], SQL[name] = (lambda spark, sf_dir, made=made: made(spark, sf_dir, kind)), sql


for _kind in ("hll", "cms", "bloom"):
    _keyed(_kind)


@query(f"""WITH {_KEYED}, {_KEYED_CELLS['hll']}, s AS (SELECT base_key, sum(pow(2.0, -n)) AS s, count(*) AS seen, count(*) FILTER (n > 0) AS filled FROM c GROUP BY 1),
e AS (SELECT *, 0.7213 / (1 + 1.079 / 256.0::DOUBLE) * 256 * 256 / (s + 256 - seen) AS raw, 256.0::DOUBLE - filled AS v FROM s)
SELECT base_key, CASE WHEN raw <= 2.5 * 256 AND v > 0 THEN 256 * ln(256.0::DOUBLE / v) ELSE raw END AS estimate FROM e""", over_log=False)
def hll_key_estimate(spark, sf_dir):
    return keyed_sketches.estimates(_updated(spark, sf_dir, "hll"), SKETCH)


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's number asked of the sketch of errors and of purchases, and of one that is not there."""
    return oplog.table(spark, sf_dir, "customer").select(F.explode(F.lit(["error", "purchase", "nothing"])).alias("base_key"), F.col("c_custkey").cast("string").alias("item"))


_PROBES = "p AS (SELECT DISTINCT unnest(['error', 'purchase']) AS base_key, CAST(c_custkey AS VARCHAR) AS item FROM customer)"


@query(f"""WITH {_KEYED}, {_KEYED_CELLS['cms']}, {_PROBES}, h AS (SELECT base_key, item, unnest(range({_KK})) * {_KM} + unnest({hash_sql('item', _KK, _KM)}) AS cell FROM p WHERE base_key IN (SELECT base_key FROM x))
SELECT base_key, item, CAST(min(coalesce(n, 0)) AS BIGINT) AS estimate FROM h LEFT JOIN c USING (base_key, cell) GROUP BY ALL""", over_log=False)
def cms_key_query(spark, sf_dir):
    return keyed_sketches.counts(_updated(spark, sf_dir, "cms"), _probes(spark, sf_dir), SKETCH)


@query(f"""WITH {_KEYED}, {_KEYED_CELLS['bloom']}, {_PROBES}, h AS (SELECT base_key, item, CAST(unnest({hash_sql('item', _BK, _BM)}) AS BIGINT) AS cell FROM p WHERE base_key IN (SELECT base_key FROM x))
SELECT base_key, item, count(*) = count(n) AS may_contain FROM h LEFT JOIN c USING (base_key, cell) GROUP BY ALL""", over_log=False)
def bloom_key_query(spark, sf_dir):
    return keyed_sketches.members(_updated(spark, sf_dir, "bloom"), _probes(spark, sf_dir), SKETCH)


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts, named by number, under one key, put and then put again with the pages' count of them."""
    texts = oplog.table(spark, sf_dir, "benchmark").select(F.lit("texts").alias("base_key"), F.col("item_id").cast("string").alias("name"), "text")
    first = keyed_sketches.written_prints(keyed_sketches.fingerprints(texts.withColumn("text", F.lower("text"))))
    return keyed_sketches.updated_prints(first, texts)


_PRINTS = _SIMHASH.replace("doc_id", "item_id").replace("documents", "benchmark")


@query(f"WITH {_PRINTS} SELECT 'texts' AS base_key, item_id || '' AS name, bits FROM bits", over_log=False)
def simhash_put(spark, sf_dir):
    prints = keyed_sketches.read_prints(_prints(spark, sf_dir))
    words = [F.lpad(F.conv(F.substring("hex", k, 8), 16, 2), 32, "0") for k in range(1, 65, 8)]
    return prints.select("base_key", "name", F.concat(*words).alias("bits"))


@query(f"WITH {_PRINTS} SELECT 'texts' AS base_key, a.item_id || '' AS a, (a.item_id + 1) || '' AS b, CASE WHEN b.bits IS NULL THEN -1 ELSE hamming(a.bits, b.bits) END AS distance FROM bits a LEFT JOIN bits b ON b.item_id = a.item_id + 1", over_log=False)
def simhash_key_distance(spark, sf_dir):
    pairs = oplog.table(spark, sf_dir, "benchmark").select(F.lit("texts").alias("base_key"), F.col("item_id").cast("string").alias("a"), (F.col("item_id") + 1).cast("string").alias("b"))
    return keyed_sketches.distances(_prints(spark, sf_dir), pairs)


# ------------------------------------------------------------- the store


def _filled(spark: SparkSession, sf_dir: str, config: Config) -> Iterator[Store]:
    """A store that took the log in two batches, up to AS_OF and after, each
    its puts and then its deletions, without a flush."""
    store = Store(spark, scratch.folder(spark), config, auto_flush=False)
    log = oplog.from_events(spark, sf_dir)
    for part in (log.filter(F.col("ts") <= AS_OF), log.filter(F.col("ts") > AS_OF)):
        store.put_all(part.filter("NOT tombstone").orderBy("seq").select(F.col("base_key").alias("key"), "value", "ts", "value_type"))
        store.delete_all(part.filter("tombstone").orderBy("seq").select(F.col("base_key").alias("key"), "ts"))
        yield store


_STORED = "WITH n AS (SELECT count(*) AS n FROM events)"


@query(f"{_STORED}, s AS (SELECT unnest(range((n + {SEGMENT - 1}) // {SEGMENT})) AS s, n FROM n) SELECT format('wal_{{:05d}}.log', s + 1) AS segment, least({SEGMENT}, n - s * {SEGMENT}) AS n FROM s", over_log=False)
def store_segments(spark, sf_dir):
    """However the batches came, a segment holds as many records as it should."""
    *_, store = _filled(spark, sf_dir, Config(segment_rows=SEGMENT))
    return wal.segment_counts(store.log())


@query(f"{_STORED}, s AS (SELECT unnest(range(2)) AS s, n, (n + {SEGMENT - 1}) // {SEGMENT} AS last FROM n) SELECT CAST(s + 1 AS BIGINT) AS segment, least({SEGMENT}, n - (last - 2 + s) * {SEGMENT}) AS n FROM s", over_log=False)
def store_truncate(spark, sf_dir):
    *_, store = _filled(spark, sf_dir, Config(segment_rows=SEGMENT))
    store.truncate(3)
    return store.log().groupBy("segment").agg(F.count("*").alias("n"))


# a batch's deletions come after its puts, so among equal times they win
_BY_BATCH = f"batched AS (SELECT *, row_number() OVER (PARTITION BY base_key ORDER BY ts DESC, ts > {AS_OF} DESC, tombstone DESC, seq DESC) AS n FROM log), held AS (SELECT * FROM batched WHERE n = 1 AND NOT tombstone)"


def _flushed(spark: SparkSession, sf_dir: str, kind: int) -> Store:
    """A run for each batch."""
    for store in _filled(spark, sf_dir, Config(compaction=kind, minimum_runs=2, levels=3, bloom_p=0.01)):
        store.flush()
    return store


@query(f", {_BY_BATCH} SELECT base_key, value_type, value, ts FROM held")
def store_live_view(spark, sf_dir):
    """Put, deleted, flushed, compacted and listed."""
    store = _flushed(spark, sf_dir, 1)
    store.compact()
    return store.list("").select("base_key", "value_type", "value", "ts")


@query(f", {_BY_BATCH}, k AS (SELECT unnest(['{KEY}', 'v']) AS base_key) SELECT base_key, value, (SELECT count(DISTINCT ts > {AS_OF}) FROM log WHERE log.base_key = k.base_key) AS opened FROM k LEFT JOIN held USING (base_key)")
def store_get(spark, sf_dir):
    """Two keys got, and how many runs were opened for each: those that its key range and Bloom filter could not rule out."""
    store = _flushed(spark, sf_dir, 1)
    found = [(key, store.get(key), len(store.opened)) for key in (KEY, "v")]
    return spark.createDataFrame(found, "base_key string, value string, opened long")


_TWO = f"""two AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY ts > {AS_OF}, base_key ORDER BY ts DESC, tombstone DESC, seq DESC) AS n FROM log) WHERE n = 1),
numbered AS (SELECT CAST(ts > {AS_OF} AS BIGINT) AS gen, base_key, value, row_number() OVER (PARTITION BY ts > {AS_OF} ORDER BY base_key) - 1 AS i FROM two)"""


@query(f", {_TWO} SELECT gen, i, base_key FROM numbered WHERE i % {STEP} = 0")
def store_summary(spark, sf_dir):
    return _flushed(spark, sf_dir, 1).sidecar("summary").select("gen", "i", "base_key")


@query(f""", {_TWO}, leaves AS (SELECT gen, list(unhex(sha1(value)) ORDER BY base_key) AS a FROM numbered GROUP BY gen),
tree AS (
  SELECT gen, a FROM leaves
  UNION ALL
  SELECT gen, list_transform(range(1, (len(a) + 1) // 2 + 1), lambda i: unhex(sha1(a[2 * i - 1] || coalesce(a[2 * i], unhex(repeat('00', 20)))))) FROM tree WHERE len(a) > 1
) SELECT gen, lower(hex(a[1])) AS root FROM tree WHERE len(a) = 1""")
def store_merkle(spark, sf_dir):
    return _flushed(spark, sf_dir, 1).sidecar("merkle").filter("depth = 0").select("gen", F.col("hash").alias("root"))


@query(f""", {_TWO}, c AS (SELECT gen, count(*) AS n FROM numbered GROUP BY gen),
size AS (SELECT gen, m, CAST(ceil(m / n * ln(2.0::DOUBLE)) AS BIGINT) AS k FROM (SELECT gen, n, CAST(ceil(n * abs(ln(0.01::DOUBLE)) / pow(ln(2.0::DOUBLE), 2)) AS BIGINT) AS m FROM c))
SELECT gen, count(DISTINCT bit) AS ones FROM (SELECT gen, {grown_sql('base_key', 'i', 'm')} AS bit FROM (SELECT gen, base_key, m, unnest(range(1, k + 1)) AS i FROM numbered JOIN size USING (gen))) GROUP BY gen""")
def store_bloom(spark, sf_dir):
    """How many bits each run's stored filter has."""
    pages = _flushed(spark, sf_dir, 1).sidecar("bloom")
    return pages.groupBy("gen").agg(F.sum(F.bitmap_count("bits")).alias("ones"))


# ------------------------------------------------- integrity, flow control


_TREE = """leaves AS (SELECT gen, list(unhex(sha1(value)) ORDER BY base_key) AS a FROM runs GROUP BY gen),
tree AS (
  SELECT gen, 0 AS up, a FROM leaves
  UNION ALL
  SELECT gen, up + 1, list_transform(range(1, (len(a) + 1) // 2 + 1), lambda i: unhex(sha1(a[2 * i - 1] || coalesce(a[2 * i], unhex(repeat('00', 20)))))) FROM tree WHERE len(a) > 1
)"""


@query(f", {_TREE} SELECT CAST(0 AS BIGINT) AS level, gen, lower(hex(a[1])) AS root FROM tree WHERE len(a) = 1")
def merkle_root(spark, sf_dir):
    return integrity.merkle_root(_runs(spark, sf_dir), "base_key", "value", "level", "gen")


@query(f""", {_TREE}, flat AS (
  SELECT gen, max(up) OVER (PARTITION BY gen) - up AS depth, CASE WHEN len(a) > 1 AND len(a) % 2 = 1 THEN list_append(a, unhex(repeat('00', 20))) ELSE a END AS a FROM tree)
SELECT CAST(0 AS BIGINT) AS level, gen, CAST(depth AS INTEGER) AS depth, CAST(unnest(range(len(a))) AS INTEGER) AS i, lower(hex(unnest(a))) AS hash FROM flat""")
def merkle_levels(spark, sf_dir):
    return integrity.merkle_levels(_runs(spark, sf_dir), "base_key", "value", "level", "gen")


@query(f""", o AS (SELECT base_key, ts, seq, row_number() OVER (PARTITION BY base_key ORDER BY ts, seq) AS n FROM log),
r AS (
  SELECT base_key, ts, seq, n, true AS accepted, [ts] AS passed FROM o WHERE n = 1
  UNION ALL
  SELECT o.base_key, o.ts, o.seq, o.n, len(list_filter(r.passed, lambda x: o.ts - x < {LIMIT_SECONDS})) < {LIMIT_NUMBER},
         CASE WHEN len(list_filter(r.passed, lambda x: o.ts - x < {LIMIT_SECONDS})) < {LIMIT_NUMBER} THEN list_append(list_filter(r.passed, lambda x: o.ts - x < {LIMIT_SECONDS}), o.ts) ELSE list_filter(r.passed, lambda x: o.ts - x < {LIMIT_SECONDS}) END
  FROM r JOIN o ON o.base_key = r.base_key AND o.n = r.n + 1
) SELECT base_key, ts, seq, accepted FROM r""")
def rate_limit(spark, sf_dir):
    return ratelimit.limited(oplog.from_events(spark, sf_dir), "base_key", LIMIT_SECONDS, LIMIT_NUMBER)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
