"""A keyed store on shared folders: a log, sorted runs, and the user's operations."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.keys import SKETCHES, base_key, typed_key, valid_key, valid_value
from ..operators import compaction, keyed_sketches, reads, sketches
from ..operators.cache import Recent
from ..operators.ratelimit import Limiter
from ..operators.versions import VERSION, latest
from ..sources import runs as run_files
from ..sources import wal
from .state import States

HELD = "base_key string, value_type string, value string, tombstone boolean, ts long, seq long"


class LimitExceeded(RuntimeError):
    """The user's operations came too fast."""


class Store:
    """PUT, DELETE, GET, LIST, RANGE SCAN, sketches by key and compaction
    below ``path``.

    A batch becomes a folder of the log, its operations numbered without gaps
    in their order, so a segment holds ``segment_rows`` records whatever the
    batches were. Once the log holds ``flush_percent`` of ``memtable_rows``
    distinct keys, a PUT flushes it into a run of its own; DELETE never does.
    Runs are written once, with their sidecars, and never changed; which runs
    there are, their places and key ranges stand in ``States``. A GET asks
    what was last used, then the log and those runs whose key range and Bloom
    filter may hold the key. ``limited`` makes the user's operations pass the
    rate limiter.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, auto_flush: bool = True, limited: bool = False):
        self.spark, self.path, self.config, self.auto_flush = spark, path.rstrip("/"), config or Config(), auto_flush
        self.states = States(spark, f"{self.path}/state")
        self.recent = Recent(self.config.cache_size)
        self.limiter = Limiter(self.config.limit_seconds, self.config.limit_number) if limited else None
        self.opened: list[tuple[int, int]] = []  # runs that the last GET read

    def _pass(self) -> None:
        if self.limiter is not None and not self.limiter.allow(time.time()):
            raise LimitExceeded(f"over {self.config.limit_number} operations in {self.config.limit_seconds} s")

    # ---- writing

    def put_all(self, rows: DataFrame) -> int:
        """Rows of key, value, ts and, if there is one, value_type. Returns how
        many were taken; keys with a hyphen, blank keys and empty values are not."""
        kind = F.col("value_type") if "value_type" in rows.columns else F.lit("string")
        good = rows.filter(valid_key(F.col("key")) & valid_value(F.col("value").cast("string")))
        taken = self._append(good.select(typed_key(F.col("key"), kind).alias("k"), F.col("value").cast("string").alias("value"), F.lit(False).alias("tombstone"), F.col("ts").cast("long").alias("ts")))
        if self.auto_flush and self.full():
            self.flush()
        return taken

    def put(self, key: str, value: str, ts: int, value_type: str = "string") -> bool:
        self._pass()
        done = self.put_all(self.spark.createDataFrame([(key, value, ts, value_type)], "key string, value string, ts long, value_type string")) == 1
        self.recent.drop(key)
        return done

    def delete_all(self, rows: DataFrame) -> int:
        """Rows of key and ts; an unknown key may be deleted too."""
        return self._append(rows.select(base_key(F.col("key")).alias("k"), F.lit("").alias("value"), F.lit(True).alias("tombstone"), F.col("ts").cast("long").alias("ts")))

    def delete(self, key: str, ts: int) -> bool:
        self._pass()
        done = self.delete_all(self.spark.createDataFrame([(key, ts)], "key string, ts long")) == 1
        self.recent.drop(key)
        return done

    def _append(self, ops: DataFrame) -> int:
        name = uuid.uuid4().hex
        draft, final = f"{self.path}/draft/{name}", f"{self.path}/log/batch={name}"
        marked = wal.marked(ops)
        marked.write.parquet(draft)  # read twice for the numbers
        drafted = self.spark.read.schema(marked.schema).parquet(draft)
        wal.append(wal.numbered(drafted), final, self.config.segment_rows)
        self.states.delete(draft)
        n = self.spark.read.parquet(final).count()
        if not n:
            self.states.delete(final)
            return 0

        def add(state: dict) -> dict:
            state["log"].append({"name": name, "first": state["next_seq"], "rows": n})
            state["next_seq"] += n
            return state

        self.states.change(add)
        self.recent = Recent(self.config.cache_size)  # any key may have changed
        return n

    # ---- sketches

    def put_sketches(self, items: DataFrame, kind: str, ts: int) -> int:
        """A sketch of the items (base_key, item) of each key; for simHash of
        the texts (base_key, name, text)."""
        values = keyed_sketches.written_prints(keyed_sketches.fingerprints(items)) if kind == "simHash" else keyed_sketches.written(keyed_sketches.cells(items, kind, self.config))
        return self._put_values(values, kind, ts)

    def update_sketches(self, items: DataFrame, kind: str, ts: int) -> int:
        """Further items for the sketches that keys hold, each a new version."""
        held = self.sketches(kind, items.select("base_key").distinct())
        values = keyed_sketches.updated_prints(held, items) if kind == "simHash" else keyed_sketches.updated(held, items, kind, self.config)
        return self._put_values(values, kind, ts)

    def _put_values(self, values: DataFrame, kind: str, ts: int) -> int:
        if kind not in SKETCHES:
            raise ValueError(f"no such sketch: {kind}")
        return self.put_all(values.select(F.col("base_key").alias("key"), "value", F.lit(ts).alias("ts"), F.lit(kind).alias("value_type")))

    def sketches(self, kind: str, keys: DataFrame | None = None) -> DataFrame:
        """base_key and value of the live sketches of a kind."""
        found = reads.live(self._held()).filter(F.col("value_type") == kind).select("base_key", "value")
        return found if keys is None else found.join(keys, "base_key", "left_semi")

    def distinct_counts(self) -> DataFrame:
        return keyed_sketches.estimates(self.sketches("hll"), self.config)

    def counts(self, probes: DataFrame) -> DataFrame:
        return keyed_sketches.counts(self.sketches("cms"), probes, self.config)

    def members(self, probes: DataFrame) -> DataFrame:
        return keyed_sketches.members(self.sketches("bloom"), probes, self.config)

    def distances(self, pairs: DataFrame) -> DataFrame:
        return keyed_sketches.distances(self.sketches("simHash"), pairs)

    # ---- state

    def _state(self) -> dict:
        return self.states.read()[1]

    def log(self, state: dict | None = None) -> DataFrame | None:
        """The log with its numbers and segments; None while there is none."""
        state = state or self._state()
        if not state["log"]:
            return None
        firsts = self.spark.createDataFrame([(b["name"], b["first"], b.get("from", 0)) for b in state["log"]], "batch string, first long, skipped long")  # a row per batch since the last flush
        stored = self.spark.read.schema(wal.SCHEMA + ", batch string").option("basePath", f"{self.path}/log").parquet(*[f"{self.path}/log/batch={b['name']}" for b in state["log"]])
        placed = stored.join(F.broadcast(firsts), "batch").filter(F.col("seq") >= F.col("skipped")).withColumn("seq", F.col("first") + F.col("seq")).drop("batch", "first", "skipped")
        segment = F.floor((F.col("seq") - state["base_seq"]) / self.config.segment_rows) + 1
        return placed.withColumn("segment", segment.cast("long"))

    def full(self) -> bool:
        """Whether the log holds so many distinct keys that it is to be flushed."""
        log = self.log()
        return log is not None and 100 * log.select(base_key(F.col("k"))).distinct().count() >= self.config.flush_percent * self.config.memtable_rows

    def truncate(self, low_water: int) -> int:
        """Drop all but the newest ``low_water`` - 1 segments of the log, files
        included, and number the rest from 1; 0 keeps all. Returns how many
        records went. What was not flushed before is lost, as asked."""
        gone: list[str] = []
        lost = 0

        def cut(state: dict) -> dict | None:
            nonlocal lost
            gone.clear()
            n, size = state["next_seq"] - state["base_seq"], self.config.segment_rows
            last = -(-n // size)
            drop = max(0, last - (low_water - 1)) if low_water else 0
            if not drop:
                return None
            before, lost = state["base_seq"], min(n, drop * size)
            state["base_seq"] += lost
            left = []
            for b in state["log"]:
                if b["first"] + b["rows"] <= state["base_seq"]:
                    gone.append(b["name"])
                else:
                    left.append(b | {"from": max(b.get("from", 0), state["base_seq"] - b["first"])})
            assert state["base_seq"] >= before
            state["log"] = left
            return state

        self.states.change(cut)
        for name in gone:
            self.states.delete(f"{self.path}/log/batch={name}")
        return lost

    def runs(self, state: dict | None = None, only: list[dict] | None = None) -> DataFrame | None:
        """The rows of all runs, or of some, with their level and number."""
        some = (state or self._state())["runs"] if only is None else only
        if not some:
            return None
        places = self.spark.createDataFrame([(r["run"], r["level"], r["gen"]) for r in some], "run long, level long, gen long")  # a row per run
        stored = self.spark.read.schema(HELD + ", run long").option("basePath", f"{self.path}/runs").parquet(*[f"{self.path}/runs/run={r['run']}" for r in some])
        return stored.join(F.broadcast(places), "run").select(*VERSION, "level", "gen")

    def versions(self, state: dict | None = None, runs: list[dict] | None = None) -> DataFrame | None:
        """All versions of all keys, wherever they are."""
        state = state or self._state()
        log, stored = self.log(state), self.runs(state, runs)
        parts = [wal.replayed(log).select(*VERSION)] if log is not None else []
        if stored is not None:
            parts.append(stored.select(*VERSION))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _held(self, state: dict | None = None, runs: list[dict] | None = None) -> DataFrame:
        held = self.versions(state, runs)
        return held if held is not None else self.spark.createDataFrame([], HELD)

    # ---- reading

    def candidates(self, key: str, state: dict | None = None) -> list[dict]:
        """The runs whose key range and Bloom filter may hold a key."""
        near = [r for r in (state or self._state())["runs"] if r["lo"] <= key <= r["hi"]]
        if not near:
            return []
        asked = [(r["run"], bit // run_files.PAGE_BITS, bit % run_files.PAGE_BITS) for r in near for bit in set(sketches.positions_of(key, r["bits"], r["hashes"]))]
        wanted = self.spark.createDataFrame(asked, "run long, page long, bit int")  # some hashes for each near run
        pages = self.spark.read.schema(run_files.BLOOM + ", run long").option("basePath", f"{self.path}/bloom").parquet(*[f"{self.path}/bloom/run={r['run']}" for r in near])
        hit = {r["run"]: r["n"] for r in run_files.set_bits(pages, F.broadcast(wanted)).groupBy("run").agg(F.count("*").alias("n")).collect()}
        return [r for r in near if hit.get(r["run"], 0) == sum(a[0] == r["run"] for a in asked)]

    def get(self, key: str) -> str | None:
        self._pass()
        key = key.split("-")[0]
        if key in self.recent:
            self.opened = []
            return self.recent.get(key)
        state = self._state()
        maybe = self.candidates(key, state)
        self.opened = [(r["level"], r["gen"]) for r in maybe]
        row = reads.get(self._held(state, maybe), key).first()
        if row is not None:
            self.recent.add(key, row["value"])
        return None if row is None else row["value"]

    def list(self, prefix: str, page: int | None = None) -> DataFrame:
        self._pass()
        state = self._state()
        near = [r for r in state["runs"] if r["hi"] >= prefix and r["lo"][: len(prefix)] <= prefix]
        return self._paged(reads.prefix(self._held(state, near), prefix), page)

    def range_scan(self, low: str, high: str, page: int | None = None) -> DataFrame:
        self._pass()
        state = self._state()
        near = [r for r in state["runs"] if r["lo"] <= high and r["hi"] >= low.split("-")[0]]
        return self._paged(reads.between(self._held(state, near), low, high), page)

    def _paged(self, found: DataFrame, page: int | None) -> DataFrame:
        return found.orderBy("base_key") if page is None else reads.page(found, page, self.config.page_size)

    def sidecar(self, name: str) -> DataFrame | None:
        """``summary``, ``merkle`` or ``bloom`` of all runs, with level and gen."""
        runs = self._state()["runs"]
        if not runs:
            return None
        places = self.spark.createDataFrame([(r["run"], r["level"], r["gen"]) for r in runs], "run long, level long, gen long")
        stored = self.spark.read.schema(run_files.SIDECARS[name] + ", run long").option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/run={r['run']}" for r in runs])
        return stored.join(F.broadcast(places), "run").drop("run")

    def contents(self) -> DataFrame:
        """level, gen, component and folder: what each run consists of."""
        rows = [(r["level"], r["gen"], part, f"{self.path}/{part}/run={r['run']}") for r in self._state()["runs"] for part in ("runs", *run_files.SIDECARS)]
        return self.spark.createDataFrame(rows, "level long, gen long, component string, folder string")

    # ---- runs

    def _write_run(self, rows: DataFrame) -> dict | None:
        """Write a run and its sidecars; its entry for the state, None if empty."""
        number = self.states.change(lambda s: s | {"next_run": s["next_run"] + 1})["next_run"] - 1
        ordered = rows.select(*VERSION).repartitionByRange("base_key").sortWithinPartitions("base_key")
        ordered.write.option("parquet.bloom.filter.enabled#base_key", "true").parquet(f"{self.path}/runs/run={number}")
        stored = self.spark.read.schema(HELD).parquet(f"{self.path}/runs/run={number}")
        meta = stored.agg(F.count("*").alias("n"), F.min("base_key").alias("lo"), F.max("base_key").alias("hi"), F.min("ts").alias("t")).first()
        if not meta["n"]:
            self.states.delete(f"{self.path}/runs/run={number}")
            return None
        bits, hashes = sketches.bloom_size(meta["n"], self.config.bloom_p)
        for name, table in run_files.sidecars_of(stored, bits, hashes, self.config.summary_step).items():
            table.write.parquet(f"{self.path}/{name}/run={number}")
        return {"run": number, "level": 0, "gen": 0, "rows": meta["n"], "lo": meta["lo"], "hi": meta["hi"], "ts": meta["t"], "bits": bits, "hashes": hashes}

    def flush(self) -> bool:
        """The log as a new run of level 0; False if there is nothing in it.
        Only that run is written, with those it merges with under leveled
        compaction, and batches appended meanwhile stay in the log."""
        state = self._state()
        log = self.log(state)
        if log is None:
            return False
        batch = latest(wal.replayed(log))
        upper = [r for r in state["runs"] if r["level"] == 0]
        ends = batch.agg(F.min("base_key").alias("lo"), F.max("base_key").alias("hi")).first()
        met = [r for r in upper if self.config.compaction == 2 and ends["lo"] is not None and r["lo"] <= ends["hi"] and r["hi"] >= ends["lo"]]
        joined = latest(batch.select(*VERSION).unionByName(self.runs(state, met).select(*VERSION))) if met else batch
        made = self._write_run(joined)
        flushed, replaced = {b["name"] for b in state["log"]}, {r["run"] for r in met}

        def swap(now: dict) -> dict | None:
            if not flushed <= {b["name"] for b in now["log"]} or not replaced <= {r["run"] for r in now["runs"]}:
                return None  # another flush was faster
            now["log"] = [b for b in now["log"] if b["name"] not in flushed]
            now["base_seq"] = min((b["first"] for b in now["log"]), default=now["next_seq"])
            now["runs"] = self._renumbered([r for r in now["runs"] if r["run"] not in replaced])
            if made is not None:
                now["runs"].append(made | {"gen": sum(r["level"] == 0 for r in now["runs"])})
            return now

        if self.states.change(swap) is None:
            return False
        self._clear([f"log/batch={n}" for n in flushed] + self._folders(replaced))
        return True

    @staticmethod
    def _renumbered(runs: list[dict]) -> list[dict]:
        """The runs of level 0 without gaps in their numbers."""
        upper = sorted((r for r in runs if r["level"] == 0), key=lambda r: r["gen"])
        return [r for r in runs if r["level"]] + [r | {"gen": i} for i, r in enumerate(upper)]

    @staticmethod
    def _folders(runs) -> list[str]:
        return [f"{part}/run={r}" for r in runs for part in ("runs", *run_files.SIDECARS)]

    def _clear(self, folders: list[str]) -> None:
        for f in folders:
            self.states.delete(f"{self.path}/{f}")

    def compact(self) -> bool:
        """Merge runs as the settings say; runs that stay alone are not written
        again. False if another writer changed the runs meanwhile."""
        state, c = self._state(), self.config
        if not state["runs"]:
            return False
        meta = self.spark.createDataFrame([(r["level"], r["gen"], r["lo"], r["hi"]) for r in state["runs"]], "level long, gen long, lo string, hi string")
        plan = (compaction.tiered_plan if c.compaction == 1 else compaction.leveled_plan)(meta, c.minimum_runs, c.levels)
        goal = {(r["level"], r["gen"]): (r["to_level"], r["to_gen"]) for r in plan.collect()}  # a row per run, as the state has
        groups: dict[tuple[int, int], list[dict]] = {}
        for r in state["runs"]:
            groups.setdefault(goal[r["level"], r["gen"]], []).append(r)
        deepest = max(level for level, _ in groups)
        kept, replaced = [], set()
        for (level, gen), members in sorted(groups.items()):
            if len(members) == 1:
                kept.append(members[0] | {"level": level, "gen": gen})
                continue
            rows = latest(self.runs(state, members))
            if (level, gen) == (deepest, 0):  # below all others: deletions that nothing needs go
                others = min((r["ts"] for g, x in groups.items() if g != (level, gen) for r in x), default=None)
                log = min((b["first"] for b in state["log"]), default=None)
                spent = F.col("tombstone") & (F.lit(True) if others is None else F.col("ts") < others)
                rows = rows.filter(~spent) if log is None else rows
            made = self._write_run(rows)
            replaced |= {r["run"] for r in members}
            if made is not None:
                kept.append(made | {"level": level, "gen": gen})
        before = {r["run"] for r in state["runs"]}

        def swap(now: dict) -> dict | None:
            if {r["run"] for r in now["runs"]} != before:
                return None
            return now | {"runs": kept}

        if self.states.change(swap) is None:
            return False
        self._clear(self._folders(replaced))
        return True
