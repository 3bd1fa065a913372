"""Mixing sources to target weights: iterative proportional fitting of token weights, then a draw of documents.

Tokens are summed per cell of (source, language, topic). The cell weights are raked to the targets of each margin in turn
until the margins agree; a document's chance follows the weight of its cell. No cell gives more than it has: a cell that
would need a chance above 1 is held there and the others are raked to give the rest.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import pick, row_key, store

#: Raking ends when no factor changes by more in a round.
ENOUGH = 1e-12
#: Margins closer than this to their targets have them.
NEAR = 1e-6

# Topics by signs in the text; the first that applies counts.
TOPIC_SIGNS = (
    ("legal", r"(?i)licen[sc]ed? under|all rights reserved|general public license"),
    ("table", r"\|[^|\n]*\|"),
    ("contact", r"@[\w-]+\."),
)


@dataclass(frozen=True)
class Mixing:
    """``share`` of all tokens are drawn, or as much less as the targets need: a value cannot give more than it has, so a target
    can ask for a smaller draw. Below ``least_share`` the draw is not lowered (a few tiny values would take nearly all of it);
    what is short then is taken whole and the others give the rest. Targets of a margin not given are its token shares to the power ``flatten``, scaled
    to 1. Up to ``cells`` cells are raked by the driver, more as tables; every value has its own target either way."""

    share: float = 0.5
    least_share: float = 0.1
    flatten: float = 0.5
    cells: int = 1 << 16
    rounds: int = 50
    seed: str = "mix"
    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)


MARGINS = ("source", "lang", "topic")


def topic() -> Column:
    chosen = F.lit(None).cast("string")
    for name, sign in reversed(TOPIC_SIGNS):
        chosen = F.when(F.col("text").rlike(sign), F.lit(name)).otherwise(chosen)
    return F.coalesce(chosen, F.lit("prose"))


def count_words() -> Column:
    """Tokens of a document: runs of anything but white space."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rake(
    cells: list[tuple[tuple[str, ...], float]], targets: list[dict[str, float]], rounds: int, most: float = float("inf")
) -> dict[tuple[str, ...], float]:
    """Factors of the cells, so that weighted tokens have the target shares of every margin (as far as they agree).

    A factor above ``most`` counts as ``most``; the cells below it are raked to give what is then missing.
    """
    tokens = {key: n for key, n in sorted(cells) if n > 0}
    factor = dict.fromkeys(tokens, 1.0)
    for _ in range(rounds):
        gap = 0.0
        for i, wanted in enumerate(targets):
            held: dict[str, float] = {}
            free: dict[str, float] = {}
            for key, n in tokens.items():
                side = held if factor[key] >= most else free
                side[key[i]] = side.get(key[i], 0.0) + n * min(factor[key], most)
            steps = {}
            for v in held.keys() | free.keys():
                want, full, rest = wanted.get(v, 0.0), held.get(v, 0.0), free.get(v, 0.0)
                # Only free cells follow a common factor; where the held ones give nearly all or too much, all go by the ratio.
                if rest > 0 and want - full > NEAR * want:
                    steps[v] = (want - full) / rest
                else:
                    steps[v] = want / (full + rest) if full + rest > 0 else 0.0
                gap = max(gap, abs(steps[v] - 1))
            for key in tokens:
                factor[key] *= steps[key[i]]
        if gap < ENOUGH:
            break
    return factor


def _targets(shares: dict[str, float], how: Mixing, margin: str) -> dict[str, float]:
    given = how.targets.get(margin)
    raw = {v: given.get(v, 0.0) for v in shares} if given else {v: s**how.flatten for v, s in shares.items()}
    total = sum(raw[v] for v in sorted(raw))
    return {v: x / total if total else 0.0 for v, x in raw.items()}


def attainable(target: dict[str, float], most: dict[str, float], total: float) -> dict[str, float]:
    """``total`` parted as the targets say, but to no value more than its ``most``; what that leaves goes to the others."""
    full: set[str] = set()
    while True:
        free = [v for v in sorted(target) if target[v] > 0 and v not in full]
        weight = sum(target[v] for v in free)
        level = (total - sum(most[v] for v in sorted(full))) / weight if weight else 0.0
        more = {v for v in free if target[v] * level >= most[v]}
        if not more:
            return {v: most[v] if v in full else target[v] * level for v in target}
        full |= more


def calibrate(cells: list[tuple[tuple[str, ...], float]], how: Mixing) -> tuple[dict[tuple[str, ...], float], float]:
    """The weight of every cell with tokens, and the share of all tokens that is drawn; no weight times that share exceeds 1."""
    cells = sorted((k, t) for k, t in cells if t > 0)
    whole = sum(t for _, t in cells)
    sides = range(len(MARGINS))
    targets = []
    for i in sides:
        shares: dict[str, float] = {}
        for key, tokens in cells:
            shares[key[i]] = shares.get(key[i], 0.0) + tokens / whole
        targets.append(_targets(shares, how, MARGINS[i]))
    weights = {k: 0.0 for k, _ in cells}
    # What a target of 0 shuts out can give nothing.
    usable = [(k, t / whole) for k, t in cells if all(targets[i][k[i]] > 0 for i in sides)]
    have: list[dict[str, float]] = [{} for _ in sides]
    for key, tokens in usable:
        for i in sides:
            have[i][key[i]] = have[i].get(key[i], 0.0) + tokens
    enough = [have[i].get(v, 0.0) / t for i in sides for v, t in targets[i].items() if t > 0]
    share = min(1.0, how.share, max(min(enough, default=0.0), how.least_share))
    if not usable or share <= 0:
        return weights, max(share, 0.0)
    share = min(share, sum(t for _, t in usable))
    made = _raked_to(share, usable, targets, have, how.rounds)
    missed = _missed(usable, made, share, targets, have)
    if missed > NEAR and share > how.least_share:
        # The margins cannot be had together from what is there: the draw for which no unbounded factor exceeds 1 has them,
        # unless the targets contradict each other whatever is drawn.
        loose = rake(usable, [attainable(t, dict.fromkeys(t, float("inf")), 1.0) for t in targets], how.rounds)
        lower = min(share, max(how.least_share, 1.0 / max(loose.values())))
        other = _raked_to(lower, usable, targets, have, how.rounds)
        if _missed(usable, other, lower, targets, have) < missed / 2:
            made, share = other, lower
    return weights | made, share


def _wanted(share: float, targets: list[dict[str, float]], have: list[dict[str, float]]) -> list[dict[str, float]]:
    return [attainable(t, {v: h.get(v, 0.0) / share for v in t}, 1.0) for t, h in zip(targets, have, strict=True)]


def _raked_to(share: float, usable: list, targets: list, have: list, rounds: int) -> dict[tuple[str, ...], float]:
    made = rake(usable, _wanted(share, targets, have), rounds, 1.0 / share)
    return {k: min(w, 1.0 / share) for k, w in made.items()}


def _missed(usable: list, made: dict, share: float, targets: list, have: list) -> float:
    """How far the margins are from the shares that they can have."""
    apart = 0.0
    for i, wanted in enumerate(_wanted(share, targets, have)):
        sums = dict.fromkeys(wanted, 0.0)
        for key, tokens in usable:
            sums[key[i]] += tokens * made[key]
        apart = max([apart, *(abs(sums[v] - wanted[v]) for v in wanted)])
    return apart


def _numbers(df: DataFrame, **aggregates: Column) -> list[float]:
    """The one row of some sums; what has no rows is 0."""
    return [float(x or 0.0) for x in df.agg(*(c.alias(n) for n, c in aggregates.items())).first()]


def _target_table(cells: DataFrame, how: Mixing, margin: str) -> DataFrame:
    """value and target: ``_targets`` as a table."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
    given = how.targets.get(margin)
    if given:
        named = cells.sparkSession.createDataFrame([(v, float(x)) for v, x in given.items()], "value string, raw double")
        sums = sums.join(named, "value", "left").fillna(0.0, ["raw"])
    else:
        (whole,) = _numbers(sums, whole=F.sum("tokens"))
        sums = sums.withColumn("raw", F.pow(F.col("tokens") / whole, F.lit(how.flatten)))
    sums = store(sums.select("value", "raw"))
    (total,) = _numbers(sums, total=F.sum("raw"))
    return sums.select("value", (F.col("raw") / total if total else F.lit(0.0)).alias("target"))


def _wanted_table(values: DataFrame, share: float | None) -> DataFrame:
    """value and want: ``attainable`` as a table; without a share nothing is short."""
    if share is None:
        (weight,) = _numbers(values, weight=F.sum("target"))
        return values.select("value", (F.col("target") / weight).alias("want"))
    most, level, before = F.col("have") / share, 0.0, -1.0
    short = F.lit(False)
    while level != before:
        full, weight = _numbers(values, full=F.sum(F.when(short, most)), weight=F.sum(F.when(~short, F.col("target"))))
        before, level = level, ((1.0 - full) / weight if weight > 0 else float("inf"))
        if level == float("inf"):
            break
        level = max(level, before)
        short = F.col("target") * level >= most
    return values.select("value", (F.when(short, most).otherwise(F.col("target") * level) if weight > 0 else most).alias("want"))


def _rake_table(usable: DataFrame, wanted: list[DataFrame], rounds: int, most: float) -> DataFrame:
    """``rake`` as joins and sums: the usable cells with ``factor``. The factors of a margin's values are a table."""
    factors = [w.select("value", "want", F.lit(1.0).alias("f")) for w in wanted]

    def multiplied() -> DataFrame:
        out = usable
        for margin, f in zip(MARGINS, factors, strict=True):
            out = out.join(f.select(F.col("value").alias(margin), F.col("f").alias(f"f_{margin}")), margin)
        return out.withColumn("factor", F.col("f_source") * F.col("f_lang") * F.col("f_topic"))

    for _ in range(rounds):
        gap = 0.0
        for i, margin in enumerate(MARGINS):
            held = F.col("factor") >= most
            sums = multiplied().groupBy(F.col(margin).alias("value")).agg(
                F.coalesce(F.sum(F.when(held, F.col("x") * most)), F.lit(0.0)).alias("full"),
                F.coalesce(F.sum(F.when(~held, F.col("x") * F.col("factor"))), F.lit(0.0)).alias("rest"),
            )
            both = F.col("full") + F.col("rest")
            step = F.when((F.col("rest") > 0) & (F.col("want") - F.col("full") > NEAR * F.col("want")), (F.col("want") - F.col("full")) / F.col("rest"))
            step = F.coalesce(step, F.when(both > 0, F.col("want") / both), F.lit(0.0))
            moved = factors[i].join(sums, "value").withColumn("step", step)
            factors[i] = store(moved.select("value", "want", (F.col("f") * F.col("step")).alias("f"), "step"))
            (far,) = _numbers(factors[i], far=F.max(F.abs(F.col("step") - 1)))
            gap = max(gap, far)
        if gap < ENOUGH:
            break
    return store(multiplied().select(*MARGINS, "x", "factor"))


def calibrate_table(cells: DataFrame, how: Mixing) -> tuple[DataFrame, float]:
    """``calibrate`` for any number of cells: the table of weights, and the share that is drawn."""
    (whole,) = _numbers(cells, whole=F.sum("tokens"))
    targets = [store(_target_table(cells, how, m)) for m in MARGINS]
    usable = cells.withColumn("x", F.col("tokens") / whole)
    for margin, target in zip(MARGINS, targets, strict=True):
        usable = usable.join(target.filter("target > 0").select(F.col("value").alias(margin)), margin, "left_semi")
    usable = store(usable.select(*MARGINS, "x"))
    values = []
    for margin, target in zip(MARGINS, targets, strict=True):
        have = usable.groupBy(F.col(margin).alias("value")).agg(F.sum("x").alias("have"))
        values.append(store(target.filter("target > 0").join(have, "value", "left").fillna(0.0, ["have"])))
    enough = [_numbers(v, least=F.min(F.col("have") / F.col("target")))[0] for v in values]
    share = min(1.0, how.share, max(min(enough), how.least_share))
    (open_share,) = _numbers(usable, x=F.sum("x"))
    if not open_share or share <= 0:
        return cells.select(*MARGINS, F.lit(0.0).alias("weight")), max(share, 0.0)
    share = min(share, open_share)

    def raked(to: float) -> tuple[DataFrame, float]:
        wanted = [store(_wanted_table(v, to)) for v in values]
        found = _rake_table(usable, wanted, how.rounds, 1.0 / to).withColumn("weight", F.least("factor", F.lit(1.0 / to)))
        missed = 0.0
        for margin, want in zip(MARGINS, wanted, strict=True):
            sums = found.groupBy(F.col(margin).alias("value")).agg(F.sum(F.col("x") * F.col("weight")).alias("got"))
            off = want.join(sums, "value", "left").select(F.abs(F.coalesce("got", F.lit(0.0)) - F.col("want")).alias("off"))
            missed = max(missed, *_numbers(off, far=F.max("off")))
        return found, missed

    made, missed = raked(share)
    if missed > NEAR and share > how.least_share:
        loose = _rake_table(usable, [store(_wanted_table(v, None)) for v in values], how.rounds, float("inf"))
        lower = min(share, max(how.least_share, 1.0 / _numbers(loose, top=F.max("factor"))[0]))
        other, still = raked(lower)
        if still < missed / 2:
            made, share = other, lower
    weights = cells.select(*MARGINS).join(made.select(*MARGINS, "weight"), list(MARGINS), "left")
    return weights.withColumn("weight", F.coalesce("weight", F.lit(0.0))), share


def mix(documents: DataFrame, how: Mixing = Mixing()) -> DataFrame:
    """One row per row: doc_id, source, lang, topic, n_tokens, weight, probability, kept, key_a, key_b (digests of the text).

    ``weight`` is the raked share of a cell over its share now, ``probability`` the weight times the share that is drawn (see
    ``Mixing``). The weights are raked so that no probability exceeds 1: what a cell cannot give, others of its margins give
    (``margins`` shows the target shares and those reached). ``kept`` holds a digest
    of the doc_id against it, so the draw is the same in every run. Null sources and languages are values of their own
    (``(none)``), a null text has no tokens; documents without tokens weigh nothing on the margins and stay with the chance
    ``share``. Rows with the same doc_id share their draw; a null doc_id draws by its text. An empty table gives no rows.
    The driver holds ``cells`` cells at most; with more, the raking is joins and sums over the table of cells.
    """
    docs = pick(documents, doc_id="doc_id", text="text", source="source", lang="lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    none = F.lit("(none)")
    rows = docs.select(
        "doc_id",
        F.coalesce("source", none).alias("source"),
        F.coalesce("lang", none).alias("lang"),
        topic().alias("topic"),
        count_words().alias("n_tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")).alias("name"),
        *row_key(F.col("text")),
    )
    cells = store(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"))
    table = [(tuple(r[:3]), float(r.tokens)) for r in cells.limit(how.cells + 1).collect()]
    if len(table) <= how.cells:
        weights, share = calibrate(table, how)
        made = documents.sparkSession.createDataFrame(
            [(*k, w) for k, w in sorted(weights.items())], "source string, lang string, topic string, weight double"
        )
        # At most ``cells`` rows.
        made = F.broadcast(made)
    else:
        made, share = calibrate_table(cells, how)
    out = rows.join(made, list(MARGINS), "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(how.seed), "name")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    out = out.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(share)))
    return out.withColumn("kept", draw < F.col("probability")).select(
        "doc_id", *MARGINS, "n_tokens", "weight", "probability", "kept", "key_a", "key_b"
    )


def margins(mixed: DataFrame, how: Mixing = Mixing()) -> DataFrame:
    """margin, value, tokens, target, achieved, drawn: the shares that the targets ask for, that the probabilities of a result
    of ``mix`` give and that its kept rows have."""
    sides = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS))).alias("side")
    sums = mixed.select(sides, "n_tokens", "probability", "kept").groupBy("side.margin", "side.value").agg(
        F.sum("n_tokens").cast("double").alias("tokens"),
        F.sum(F.col("n_tokens") * F.col("probability")).alias("achieved"),
        F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0)).cast("double").alias("drawn"),
    )
    named = [(m, v, float(x)) for m, given in how.targets.items() for v, x in given.items()]
    named = mixed.sparkSession.createDataFrame(named, "margin string, value string, target double")
    named_margins = [m for m, given in how.targets.items() if given]
    target = F.when(F.col("margin").isin(named_margins), F.coalesce("target", F.lit(0.0))).otherwise(F.pow("tokens", F.lit(how.flatten)))
    sums = store(sums.filter("tokens > 0").join(named, ["margin", "value"], "left").withColumn("target", target))
    parts = ("target", "achieved", "drawn")
    # At most one row per margin.
    wholes = {r["margin"]: r for r in sums.groupBy("margin").agg(*(F.sum(c).alias(c) for c in parts)).collect()}

    def share(part: str) -> Column:
        whole = F.lit(None).cast("double")
        for margin, row in wholes.items():
            whole = F.when(F.col("margin") == margin, F.lit(row[part])).otherwise(whole)
        return (F.col(part) / F.nullif(whole, F.lit(0.0))).alias(part)

    return sums.select("margin", "value", F.col("tokens").cast("long"), *map(share, parts))
