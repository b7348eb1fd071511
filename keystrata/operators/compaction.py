"""Merging runs: size-tiered, leveled, and a flush that merges on the way.

Where every run ends up follows from the runs' numbers and key ranges alone.
A plan is worked out on that metadata, a row per run, which stays a table: only
single numbers and the key range of one run are brought to the driver. Then a
compaction over any number of levels is one reduction to the newest version
per key and target run. A deletion is dropped only from the bottom run, and
there only if it is older than all that other runs hold, so that no version of
its key can come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .pruning import run_meta
from .ranking import positioned
from .versions import latest

RUN = ("level", "gen", "base_key", "value_type", "value", "tombstone", "ts", "seq")


def _settled(placed: DataFrame, bottom: Column) -> DataFrame:
    """The newest version per key of each run, without deletions that nothing needs."""
    others = placed.filter(~bottom).agg(F.min("ts").alias("t")).first()["t"]
    spent = bottom & F.col("tombstone")
    if others is not None:
        spent = spent & (F.col("ts") < others)
    return latest(placed, "level", "gen").filter(~spent).select(*RUN)


def tiers(total: int, minimum: int, levels: int) -> list[tuple[int, int]]:
    """For each level from 0: the runs that come to it, and those of them
    that merge onward, in groups of ``minimum``."""
    out = []
    for level in range(levels):
        onward = total // minimum * minimum if level < levels - 1 else 0
        out.append((total, onward))
        total = onward // minimum
    return out


def tier_of(gen: Column, plan: list[tuple[int, int]], minimum: int) -> tuple[Column, Column]:
    """Level and number that a level-0 run ends in; what is left over in a
    level is numbered from 0."""
    level = number = F.lit(None).cast("long")
    for k in reversed(range(len(plan))):
        onward = plan[k][1]
        here = F.floor(gen / minimum**k)
        stays = here >= onward
        level = F.when(stays, F.lit(k).cast("long")).otherwise(level)
        number = F.when(stays, (here - onward).cast("long")).otherwise(number)
    return level, number


def size_tiered(runs: DataFrame, minimum: int, levels: int) -> DataFrame:
    """``runs`` of level 0 after size-tiered compaction of all levels."""
    names = runs.select("gen").distinct()
    total = names.count()
    dense = positioned(names, "gen", name="number")
    plan = tiers(total, minimum, levels)
    level, number = tier_of(F.col("number"), plan, minimum)
    target = dense.select("gen", level.alias("to_level"), number.alias("to_gen"))
    moved = runs.join(target, "gen").drop("level", "gen").withColumnsRenamed({"to_level": "level", "to_gen": "gen"})
    deepest = max((k for k, (come, onward) in enumerate(plan) if come > onward), default=0)
    return _settled(moved, (F.col("level") == deepest) & (F.col("gen") == 0))


def renumbered(runs: DataFrame) -> DataFrame:
    """The runs of each level numbered anew without gaps: level, gen, new_gen."""
    return positioned(runs.select("level", "gen").distinct(), "gen", "level", name="new_gen").select("level", "gen", "new_gen")


def _start(meta: DataFrame) -> DataFrame:
    return kept(meta.select("level", "gen", F.col("level").cast("long").alias("to_level"), F.col("gen").cast("long").alias("to_gen"), "lo", "hi"))


def _runs_now(state: DataFrame, level: int) -> DataFrame:
    """number, lo and hi of the runs that a level holds at this point of a plan."""
    return state.filter(F.col("to_level") == level).groupBy(F.col("to_gen").alias("number")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _renamed(state: DataFrame, level: int, changes: DataFrame) -> DataFrame:
    """``state`` after the runs ``number`` of a level became next_level, next_gen."""
    here = F.col("to_level") == level
    found = state.join(changes, here & (F.col("to_gen") == F.col("number")), "left")
    return found.select("level", "gen", F.coalesce("next_level", "to_level").alias("to_level"), F.coalesce("next_gen", "to_gen").alias("to_gen"), "lo", "hi")


def leveled_plan(meta: DataFrame, minimum: int, levels: int) -> DataFrame:
    """level, gen, to_level and to_gen of each run of ``meta`` (level, gen,
    lo, hi). From level 0 down, while a level holds ``minimum`` runs or more:
    the oldest moves down if the next level is empty, and all runs whose key
    range meets that of the next level's first run merge into it."""
    state = _start(meta)
    for level in range(levels - 1):
        own, below = _runs_now(state, level), _runs_now(state, level + 1)
        if own.count() < minimum:
            break
        first = F.min(F.struct("number", "lo", "hi")).alias("r")
        down = below.agg(first).first()["r"]
        target = down or own.agg(first).first()["r"]
        meets = (F.col("lo") <= target["hi"]) & (F.col("hi") >= target["lo"])
        goal = down["number"] if down else 0
        merging = own.filter(meets).select("number", F.lit(level + 1).cast("long").alias("next_level"), F.lit(goal).cast("long").alias("next_gen"))
        staying = positioned(own.filter(~meets).select("number"), "number", name="next_gen").select("number", F.lit(level).cast("long").alias("next_level"), "next_gen")
        state = kept(_renamed(state, level, merging.unionByName(staying)))
    return state.select("level", "gen", "to_level", "to_gen")


def tiered_plan(meta: DataFrame, minimum: int, levels: int) -> DataFrame:
    """The same of size-tiered compaction of runs on any levels: level by
    level, groups of ``minimum`` move down behind what is there."""
    state = _start(meta)
    for level in range(levels - 1):
        own = positioned(_runs_now(state, level).select("number"), "number", name="i")
        onward = own.count() // minimum * minimum
        last = _runs_now(state, level + 1).agg(F.max("number").alias("m")).first()["m"]
        behind = 0 if last is None else last + 1
        moves = F.col("i") < onward
        number = F.when(moves, F.floor(F.col("i") / minimum) + behind).otherwise(F.col("i") - onward)
        state = kept(_renamed(state, level, own.select("number", F.when(moves, level + 1).otherwise(level).cast("long").alias("next_level"), number.cast("long").alias("next_gen"))))
    return state.select("level", "gen", "to_level", "to_gen")


def merged(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """``runs`` after a plan, each target run reduced to its newest versions;
    the bottom run loses deletions only if the plan made it."""
    moved = runs.join(plan, ["level", "gen"]).drop("level", "gen").withColumnsRenamed({"to_level": "level", "to_gen": "gen"})
    deepest = plan.agg(F.max("to_level").alias("m")).first()["m"]
    bottom = plan.filter((F.col("to_level") == F.lit(deepest)) & (F.col("to_gen") == 0))
    if not bottom.filter("level <> to_level OR gen <> to_gen").limit(1).count():
        return latest(moved, "level", "gen").select(*RUN)
    return _settled(moved, (F.col("level") == F.lit(deepest)) & (F.col("gen") == 0))


def leveled(runs: DataFrame, minimum: int, levels: int) -> DataFrame:
    """Leveled compaction from level 0 down, until a level holds too few runs."""
    return merged(runs, leveled_plan(run_meta(runs), minimum, levels))


def tiered_store(runs: DataFrame, minimum: int, levels: int) -> DataFrame:
    """Size-tiered compaction of runs that lie on several levels."""
    return merged(runs, tiered_plan(run_meta(runs), minimum, levels))


def flush_merging(batch: DataFrame, runs: DataFrame) -> DataFrame:
    """A batch merged with every level-0 run whose key range meets its own,
    as one new run; the others are left as they are, numbered before it."""
    batch = latest(batch)
    ends = batch.agg(F.min("base_key").alias("lo"), F.max("base_key").alias("hi")).first()
    meta = kept(run_meta(runs.filter("level = 0")))
    meets = (F.col("lo") <= F.lit(ends["hi"])) & (F.col("hi") >= F.lit(ends["lo"]))
    met = meta.filter(F.coalesce(meets, F.lit(False)))
    left = meta.count() - met.count()
    version = ["base_key", "value_type", "value", "tombstone", "ts", "seq"]
    joined = batch.select(*version).unionByName(runs.filter("level = 0").join(met.select("gen"), "gen", "left_semi").select(*version))
    return latest(joined).select(F.lit(0).cast("long").alias("level"), F.lit(left).cast("long").alias("gen"), *version)
