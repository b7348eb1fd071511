"""Mixing sources to target weights with soft membership, in DataFrame and SQL
functions only.

A classifier trained on the labelled table's documents gives each document a
posterior over the domains. Nonnegative document rates r are then fitted so
that the expected tokens of each domain, the sum of r * tokens * posterior,
match the targets: least squares, each domain weighted by its size, by
projected gradient steps. A step needs only one sum per domain, taken over all
documents; a document's rate follows from its posterior and the steps, and is
stored every STORE steps, so a step costs the same however many came before.
Nothing is shuffled but the sums. Steps go on until all targets are met or the
sums stand still, as they do where rates may not fall to what a target asks
for; what is left is returned as ``residual``, the greatest relative miss, and
a warning is given if MOST_STEPS end before either.

A document's tokens are its words, or the numbers in the column ``tokens``
names, such as an exact count by a tokenizer.

The domains are those of all labelled documents present. Only the classifier
sees a sample: of each domain the ``most`` / domains labelled documents of
smallest hash, 20 at least, weighted by how many they stand for. A domain with
no labelled document has no posterior and no target; its documents count
towards the domains they resemble.

Cases: a null text counts as empty, with no tokens and the prior's posterior;
a text of any length counts whole; a null token count is 0;
a null domain does not train; with fewer than two domains all posteriors are
1 and the one target is met by one common rate; rows that share a doc_id, or
have none, are rated separately; an empty table yields no rows; other columns
are left out of ``rates`` and kept by ``mixed``.
"""

from __future__ import annotations

import warnings

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

STORE, MOST_STEPS = 8, 400


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\s.,;:!?]+"), lambda w: w != "")


def _vectors(df: DataFrame, bits: int) -> DataFrame:
    counted = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=1 << bits).transform(df)
    return Normalizer(inputCol="__counts", outputCol="__features").transform(counted)


def posteriors(docs: DataFrame, labels: DataFrame, domain: str = "lang", most: int = 3000, bits: int = 14, tokens: str | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs`` as ``row`` with __tokens and __posterior (an array
    in the order of the returned domains)."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(domain).cast("string").alias("domain")).filter("domain is not null")
    pairs = materialize(some.select("doc_id", "domain").join(ids, "doc_id", "left_semi").distinct())
    counts = pairs.groupBy("domain").agg(F.count("*").alias("__n"))
    domains = sorted(r["domain"] for r in counts.collect())
    each = max(20, most // max(1, len(domains)))
    turn = F.xxhash64("doc_id", F.lit(23))
    few = pairs.join(F.broadcast(counts), "domain").withColumn("__turn", turn).filter(F.pmod("__turn", F.lit(1 << 30)) / float(1 << 30) < (2 * each + 50) / F.col("__n"))  # about twice as many as wanted
    first = Window.partitionBy("domain").orderBy(F.pmod("__turn", F.lit(1 << 30)), "doc_id")
    chosen = few.withColumn("__i", F.row_number().over(first)).filter(F.col("__i") <= each)
    chosen = chosen.withColumn("__weight", F.col("__n") / F.count("*").over(Window.partitionBy("domain"))).select("doc_id", "domain", "__weight")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # no name in it can clash
    rows = packed.withColumn("__words", _words(F.col("row.text").cast("string")))
    rows = rows.withColumn("__tokens", F.size("__words").cast("long") if tokens is None else F.coalesce(F.col(f"row.`{tokens}`").cast("long"), F.lit(0)))
    if len(domains) < 2:
        return rows.withColumn("__posterior", F.array(F.lit(1.0))).drop("__words"), domains or [""]
    sample = materialize(some.join(F.broadcast(chosen), ["doc_id", "domain"]).groupBy("doc_id", "domain", "__weight").agg(F.min("text").alias("text")).orderBy("doc_id", "domain"))  # one text of a repeated id
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("double") - 1
    train = _vectors(sample.withColumn("__words", _words(F.col("text"))), bits).select(number.alias("label"), "__weight", "__features").coalesce(4)
    model = LogisticRegression(featuresCol="__features", weightCol="__weight", family="multinomial", maxIter=12, regParam=0.002, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__label").fit(train)
    scored = model.transform(_vectors(rows, bits)).withColumn("__posterior", vector_to_array("__p"))
    return scored.drop("__words", "__counts", "__features", "__p", "__raw", "__label"), domains


def rate_of(steps: list[list[float]], posterior: str, least: float, rate: Column | None = None) -> Column:
    """A document's rate after the projected steps, from its posterior. One
    expression over a list, so its code does not grow with the steps."""
    if not steps:
        return F.lit(1.0) if rate is None else rate

    def step(r: Column, g: Column) -> Column:
        move = F.aggregate(F.zip_with(F.col(posterior), g, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.lit(float(least)), r - move)

    return F.aggregate(F.lit(steps).cast("array<array<double>>"), F.lit(1.0) if rate is None else rate, step)


def fit(rows: DataFrame, tokens: str, posterior: str, weights: list[float] | None, domains: int, budget: float | None, smoothing: float, least: float, most_steps: int = MOST_STEPS, near: float = 1e-3) -> tuple[list[list[float]], float]:
    """The gradient steps that bring the expected domain tokens to the
    targets, and the residual.

    weights: the domains' shares; by default their present shares to the power
    ``smoothing``. budget: all tokens wanted, as a multiple of the present
    ones; by default as many as let no domain shrink.
    """
    if weights is not None and len(weights) != domains:
        raise ValueError(f"{len(weights)} weights for {domains} domains")
    state = materialize(rows.select(F.col(tokens).alias("t"), F.col(posterior).alias("p"), F.lit(1.0).alias("r")))

    def expected(rate: Column) -> list[float]:
        sums = state.agg(*(F.coalesce(F.sum(rate * F.col("t") * F.get(F.col("p"), F.lit(d))), F.lit(0.0)).alias(f"d{d}") for d in range(domains))).first()
        return [float(x) for x in sums]

    mass = expected(F.col("r"))
    total = sum(mass)
    if total <= 0:
        return [], 0.0
    shares = weights or [(m / total) ** smoothing for m in mass]
    shares = [s / sum(shares) for s in shares]
    if budget is None:
        budget = max(m / total / s for m, s in zip(mass, shares, strict=True) if s > 0)
    targets = [s * total * budget for s in shares]
    miss = lambda now: max(abs(x - t) / max(t, total * 1e-6) for x, t in zip(now, targets, strict=True))
    steps: list[list[float]] = []
    fresh: list[list[float]] = []
    now, still = mass, False
    while miss(now) > near and not still and len(steps) < most_steps:
        # with residuals divided by the domains' sizes, and rates measured by
        # their documents' tokens, the largest curvature is 1: full steps descend
        steps.append([(x - t) / m if m > 0 else 0.0 for x, t, m in zip(now, targets, mass, strict=True)])
        fresh.append(steps[-1])
        before, now = now, expected(rate_of(fresh, "p", least, F.col("r")))
        still = max(abs(a - b) for a, b in zip(now, before, strict=True)) <= near * 1e-3 * total
        if len(fresh) == STORE:
            state = materialize(state.withColumn("r", rate_of(fresh, "p", least, F.col("r"))))
            fresh = []
    if miss(now) > near and not still:
        warnings.warn(f"the targets are missed by {miss(now):.2%} after {most_steps} steps", stacklevel=2)
    return steps, miss(now)


def rates(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: list[float] | None = None, budget: float | None = 1.0, smoothing: float = 0.7, least: float = 0.0, tokens: str | None = None, most_steps: int = MOST_STEPS) -> DataFrame:
    """doc_id, n_tokens, posterior (array), rate, copies and residual (the
    same everywhere) of every row."""
    scored, domains = posteriors(docs, labels, domain, tokens=tokens)
    text = F.col("row.text").cast("string")
    rows = materialize(scored.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col("__tokens").alias("n_tokens"), F.col("__posterior").alias("posterior")))
    steps, residual = fit(rows, "n_tokens", "posterior", weights, len(domains), budget, smoothing, least, most_steps)
    rated = rows.withColumn("rate", rate_of(steps, "posterior", least)).withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("key")))
    return rated.drop("key").withColumn("residual", F.lit(residual))


def copies(rate: Column, *key: Column) -> Column:
    """A whole number whose expectation is the rate, fixed by the key."""
    chance = F.pmod(F.xxhash64(*key, F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + chance).cast("long")


def mixed(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: list[float] | None = None, smoothing: float = 0.7, tokens: str | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says, at least once: small
    domains are repeated and no document is dropped. The whole is as large as
    lets the domain that is furthest above its weight stay as it is, so a
    small weight for a large domain repeats all others."""
    scored, domains = posteriors(docs, labels, domain, tokens=tokens)
    rows = materialize(scored)
    steps, _ = fit(rows, "__tokens", "__posterior", weights, len(domains), None, smoothing, 1.0)
    times = copies(rate_of(steps, "__posterior", 1.0), F.col("row.doc_id").cast("long"), F.xxhash64(F.col("row.text").cast("string")))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
