"""Convergence analytics over target rows: gaps, close rates, trends, oscillation, admission, timers, next steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gaps(rows: DataFrame, entity: str = "entity_key", prefix: str = "missing_") -> DataFrame:
    """``(entity, gap)`` of every true ``missing_<gap>`` of the rows that are in violation."""
    flags = [c for c in rows.columns if c.startswith(prefix)]
    each = F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c[len(prefix) :])) for c in flags])
    return rows.where(F.coalesce("violating", F.lit(False))).select(entity, F.explode(F.filter(each, lambda g: g.isNotNull())).alias("gap"))


class ContractError(ValueError):
    """Rows that are no target rows: refused when the plan is built."""


def target_rows(rows: DataFrame, target_id: str, entity: str = "entity_key", prefix: str = "missing_") -> DataFrame:
    """The rows of a convergence target, keyed ``<target>.<entity id>``, after a check of what every one must have: an
    entity key (text), ``violating`` and at least one ``missing_<gap>`` (booleans), a text ``fresh_until`` if there is one.

    Rows whose entity key is no vertex key are left out (``key`` could not be read back).
    """
    kinds = dict(rows.dtypes)
    wrong = [c for c, kind in ((entity, "string"), ("violating", "boolean")) if kinds.get(c) != kind]
    wrong += [c for c, kind in kinds.items() if c.startswith(prefix) and kind != "boolean"]
    wrong += ["fresh_until"] if kinds.get("fresh_until", "string") != "string" else []
    if wrong or not any(c.startswith(prefix) for c in kinds):
        raise ContractError(f"no target rows: {wrong or 'no gaps'}")
    found = F.regexp_extract(entity, "^vtx\\.[a-z][a-z0-9]*\\.([^.]+)$", 1)
    return rows.withColumn("key", F.concat(F.lit(f"{target_id}."), found)).where(found != "").select("key", *rows.columns)


def actions(found: DataFrame, playbook: DataFrame) -> DataFrame:
    """Gaps with what the playbook (gap, action, ...) says about them; a gap that it doesn't know has a null action."""
    return found.join(playbook, "gap", "left")


def rank_actions(attempts: DataFrame, window: int, by: list[str]) -> DataFrame:
    """Actions of each gap by the share of the last ``window`` attempts that closed it. ``attempts``: by.., action,
    at, closed; an action without attempts is not rated (null is not 0)."""
    recent = attempts.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "action").orderBy(F.desc("at")))).where(F.col("_n") <= window)
    rates = recent.groupBy(*by, "action").agg(F.avg(F.col("closed").cast("double")).alias("close_rate"), F.count("*").alias("attempts"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("close_rate"), "action"))
    return rates.withColumn("rank", place)


def never_closes(attempts: DataFrame, window: int, by: list[str]) -> DataFrame:
    """Actions with a full window of attempts of which none closed anything."""
    return rank_actions(attempts, window, by).where((F.col("attempts") >= window) & (F.col("close_rate") == 0)).select(*by, "action")


def trajectory(samples: DataFrame, target: str, order: str, value: str, window: int = 5) -> DataFrame:
    """``shrinking`` (never rises, and falls), ``diverging`` (never falls, and rises) or ``steady`` over the last
    ``window`` samples of each target; fewer than two samples are steady."""
    w = Window.partitionBy(target)
    last = samples.withColumn("_n", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("_n") <= window)
    step = F.col(value) - F.lag(value).over(w.orderBy(order))
    agg = last.withColumn("_step", step).groupBy(target).agg(F.max("_step").alias("up"), F.min("_step").alias("down"))
    return agg.select(target, F.when((F.col("up") <= 0) & (F.col("down") < 0), "shrinking").when((F.col("down") >= 0) & (F.col("up") > 0), "diverging").otherwise("steady").alias("trend"))


def oscillations(writes: DataFrame, path: str, order: str, value: str, run: int = 4) -> DataFrame:
    """``(path, order)`` where the last ``run`` values of a path alternate between two. A hit empties what is remembered,
    so the next one needs ``run`` values of its own.

    Where the last values alternate is told by windows. Of these places a hit is taken if it lies ``run`` or more after
    the hit before: a fold over the stretches of such places (two numbers each), not over the values.
    """
    w = Window.partitionBy(path).orderBy(order)
    back = lambda k: F.lag(F.struct(F.col(value)), k).over(w)  # noqa: E731  a struct: a null value is there, a missing row isn't
    here = F.struct(F.col(value))
    alternates = back(run - 1).isNotNull() & ~here.eqNullSafe(back(1)) & here.eqNullSafe(back(2))
    for k in range(1, run - 2):
        alternates = alternates & back(k).eqNullSafe(back(k + 2))
    rows = writes.withColumn("_n", F.row_number().over(w)).withColumn("_hit", F.coalesce(alternates, F.lit(False)))
    places = rows.where("_hit").select(path, order, "_n").withColumn("_at", F.col("_n") - F.row_number().over(w))
    stretches = places.groupBy(path, "_at").agg(F.min("_n").alias("first"), F.max("_n").alias("last"))
    per = stretches.groupBy(path).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_s"))

    def step(state, s):
        first = F.greatest(s["first"], state["until"] + run)
        more = F.when(first <= s["last"], F.sequence(first, s["last"], F.lit(run))).otherwise(F.array().cast("array<int>"))
        return F.struct(F.coalesce(F.try_element_at(more, F.lit(-1)), state["until"]).alias("until"), F.concat(state["hits"], more).alias("hits"))

    start = F.struct(F.lit(-run).alias("until"), F.array().cast("array<int>").alias("hits"))
    hits = per.select(F.col(path).alias("_path"), F.explode(F.aggregate("_s", start, step)["hits"]).alias("_hit_n"))
    return places.join(hits, F.col(path).eqNullSafe(F.col("_path")) & (F.col("_n") == F.col("_hit_n"))).select(path, order)


def admit(requests: DataFrame, tokens: DataFrame, by: str = "pool", parts: int = 64) -> DataFrame:
    """Requests admitted by a pool's whole tokens: highest priority first, then who has waited longest, then id.

    A pool's requests are ranked in ``parts`` first; what isn't among a part's best can't be among the pool's, so only as
    many rows as there are tokens in each part meet in one place.
    """
    order = [F.desc("priority"), "since", "request_id"]
    part = F.pmod(F.xxhash64("request_id"), F.lit(parts))
    rows = requests.join(tokens.select(by, F.floor("tokens").alias("_most")), by).withColumn("_part", part)
    near = rows.withColumn("_place", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).where("_place <= _most")
    return near.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_place <= _most").select(*requests.columns)


def refill(level: DataFrame, now: float, rate: float, capacity: float) -> DataFrame:
    """Token buckets ``(pool, tokens, at)`` at a later time."""
    return level.select("pool", F.least(F.lit(float(capacity)), F.col("tokens") + (F.lit(float(now)) - F.col("at")) * rate).alias("tokens"), F.lit(float(now)).alias("at"))


def expired(rows: DataFrame, now: str, until: str = "fresh_until") -> DataFrame:
    """Rows whose freshness has run out; RFC 3339 texts in UTC compare as texts. Without a limit a row stays fresh."""
    return rows.where(F.col(until) <= now)


def retry_budget(found: DataFrame, dispatched: DataFrame, entity: str = "entity_key") -> DataFrame:
    """Gaps that may be tried again: fewer dispatches than ``max_retries`` (null: no limit)."""
    spent = dispatched.groupBy(entity, "gap").agg(F.count("*").alias("_spent"))
    rows = found.join(spent, [entity, "gap"], "left")
    return rows.where(F.col("max_retries").isNull() | (F.coalesce("_spent", F.lit(0)) < F.col("max_retries"))).drop("_spent")


def next_step(instances: DataFrame, steps: DataFrame, guards: DataFrame) -> DataFrame:
    """For each procedure instance (instance_id, pattern, cursor) the first step after its cursor whose guard holds;
    steps: (pattern, position, step), guards: (instance_id, position, holds), an absent guard holds. Done: null."""
    ahead = instances.join(steps, "pattern").where(F.col("position") > F.col("cursor")).join(guards, ["instance_id", "position"], "left").where(F.coalesce("holds", F.lit(True)))
    chosen = ahead.groupBy("instance_id").agg(F.min(F.struct("position", "step")).alias("next"))
    return instances.join(chosen, "instance_id", "left").select("instance_id", "pattern", "cursor", F.col("next.position").alias("position"), F.col("next.step").alias("step"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float], ring: int | None = None, order: str | None = None) -> DataFrame:
    """Exact nearest-rank percentiles (rank ceil(n * q)) of each group, of its last ``ring`` values by ``order``."""
    if ring is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_n") <= ring).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    size = F.count("*").over(Window.partitionBy(*by))
    ranked = rows.withColumn("_place", place).withColumn("_size", size)
    picks = [F.max(F.when(F.col("_place") == F.ceil(F.col("_size") * q), F.col(value))).alias(name) for name, q in quantiles.items()]
    return ranked.groupBy(*by).agg(*picks, F.avg(value).alias("mean"))


def fill_template(rows: DataFrame, params: dict[str, str], required: list[str] = []) -> DataFrame:
    """Rows with each parameter as a column: ``row.<column>`` takes that column with its type, ``row.<column>.<aspect>`` the
    key in that column with the aspect behind it, anything else is a text. ``data_error`` names the first required
    parameter whose column is null (null: none); a column that the rows don't have is refused."""
    out, errors = [], []
    for name, template in params.items():
        if not template:
            raise ValueError(f"parameter {name} is empty")
        if not template.startswith("row."):
            value = F.lit(template)
        elif (column := template[4:]) in rows.columns:
            value = F.col(column)
        else:
            base, _, aspect = column.partition(".")
            if base not in rows.columns or not aspect:
                raise ValueError(f"parameter {name}: rows have no column {column}")
            value = F.when(F.col(base) != "", F.concat(F.col(base), F.lit("." + aspect)))
        out.append(value.alias(name))
        if name in required:
            errors.append(F.when(value.isNull() | (value.cast("string") == ""), name))
    return rows.select("*", *out, (F.coalesce(*errors) if errors else F.lit(None).cast("string")).alias("data_error"))


def correlate(completions: DataFrame, waiting: DataFrame) -> DataFrame:
    """``(token, instance_id, seq, outcome)``: each waiting token's (token, instance_id) first completion (token, seq,
    outcome) by sequence; ``orphan`` completions, of tokens that no one waits for, have a null instance."""
    first = completions.groupBy("token").agg(F.min(F.struct("seq", "outcome")).alias("c"))
    return first.join(waiting.select("token", "instance_id"), "token", "left").select("token", "instance_id", "c.seq", "c.outcome")
