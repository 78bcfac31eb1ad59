"""Deterministic synthetic prompts: scenario families times seeds, seed plans and their checks. Templates are our own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: (family, load type, template, {slot: options}, extra round or None). An extra round goes before the last two turns for half of the seeds.
FAMILIES = (
    ("harbour_desk", "system_prompt", "You run the harbour desk of {port}. Berths close at {hour}:00 and {rule}.", {"port": ["Varna", "Bergen", "Cork"], "hour": ["18", "20", "22"], "rule": ["never quote fees", "always name the pier", "log every call"]}, None),
    ("seed_library", "system_prompt", "You lend seeds at {town}. Each member takes {n} packets and {rule}.", {"town": ["Olten", "Lugo", "Pecs"], "n": ["3", "5", "7"], "rule": ["returns a tenth", "signs the ledger", "labels each bag"]}, None),
    ("night_archive", "system_prompt", "You guard the {kind} archive. Answer in at most {n} lines, {tone}, and refuse to copy {secret}.", {"kind": ["map", "letter", "film"], "n": ["2", "4", "6"], "tone": ["without adjectives", "in the plural"], "secret": ["sealed boxes", "donor names", "keys"]}, None),
    ("tide_tables", "system_prompt", "You read tide tables for {bay}. Give heights in {unit}; below {low} tell {who}.", {"bay": ["Fundy", "Jade", "Morecambe"], "unit": ["feet", "metres"], "low": ["0.3", "0.7"], "who": ["the pilot", "the warden"]}, None),
    ("ferry_change", "dialogue", "user: Move my {day} crossing to {time}.\nassistant: That costs {fee} euros.\nuser: Fine.", {"day": ["Monday", "Friday"], "time": ["06:15", "11:40", "17:05"], "fee": ["4", "9", "12"]}, "user: Is there room for a {item}?\nassistant: On the lower deck."),
    ("clinic_slot", "dialogue", "user: Is {doctor} free at {time}?\nassistant: Only in room {room}.\nuser: Book it.", {"doctor": ["Dr Ilves", "Dr Okoro", "Dr Marin"], "time": ["08:30", "14:10"], "room": ["2", "5", "11"]}, None),
    ("orchard_order", "dialogue", "user: Forty crates of {apple} by {day}.\nassistant: {grower} can pick thirty.\nuser: Take them.\nassistant: Noted.\nuser: Who picks, and how many?", {"apple": ["Boskoop", "Topaz", "Elstar"], "day": ["3 May", "9 June"], "grower": ["Lund", "Sorel", "Pires"]}, "user: At what price?\nassistant: As last year."),
    ("choir_tour", "dialogue", "user: Where do we sing after {city}?\nassistant: In {hall}, on {date}.\nuser: And who conducts?\nassistant: {name}.\nuser: Repeat all of it.", {"city": ["Graz", "Turku"], "hall": ["the mill", "the old bath", "St Anne"], "date": ["2 July", "4 July"], "name": ["Ama", "Ruth", "Ivo"]}, None),
)
FAMILIES[4][3]["item"] = ["bicycle", "cello"]
EVAL_RANGE, TRAIN_RANGE, EXTRA = (101, 110), (901, 990), "extra_round"
#: What a family's key points may be about, by the registry's key.
TYPES = {"constraint_types": ("format", "refusal", "tone"), "fact_types": ("name", "date", "decision")}
SCHEMA = "family_ord int, family string, load_type string, template string, slots map<string,array<string>>, extra string, eval_lo int, eval_hi int, train_lo int, train_hi int, train_use boolean, license string"


def families(spark: SparkSession) -> DataFrame:
    rows = [(k, f, lt, t, s, e, *EVAL_RANGE, *TRAIN_RANGE, True, "public") for k, (f, lt, t, s, e) in enumerate(FAMILIES)]
    return spark.createDataFrame(rows, SCHEMA)


def registered(spark: SparkSession, entries: Sequence[Mapping], origin: str = "registry") -> DataFrame:
    """Families of a registry's entries: a built-in one by its name, or one with load_type, template, slots and, if it likes, extra_round.

    Refused: no entries, repeated or unknown names, fewer than two types or types of
    another kind, and seed ranges that are no ranges or overlap.
    """
    built_in, rows, seen = {f[0]: f for f in FAMILIES}, [], set()
    for k, e in enumerate(entries):
        name = e.get("name")
        known = (name, e.get("load_type"), e["template"], e.get("slots", {}), e.get("extra_round")) if "template" in e else built_in.get(name)
        wrong = "has no template" if known is None or known[1] not in T.TASKS else "is repeated" if name in seen else None
        types = next(((e[key], allowed) for key, allowed in TYPES.items() if key in e), ((), ()))
        if not wrong and (len(set(types[0])) < 2 or not set(types[0]) <= set(types[1])):
            wrong = f"needs at least two types of {[list(t) for t in TYPES.values()]}"
        ranges = [e.get(f"{side}_seed_range", list(default)) for side, default in (("eval", EVAL_RANGE), ("train", TRAIN_RANGE))]
        if not wrong and any(not isinstance(r, list) or len(r) != 2 or any(isinstance(x, bool) or not isinstance(x, int) for x in r) or r[0] > r[1] for r in ranges):
            wrong = "has seed ranges that are not [first, last]"
        if not wrong and ranges[0][0] <= ranges[1][1] and ranges[1][0] <= ranges[0][1]:
            wrong = "has seed ranges that overlap"
        if wrong:
            raise ValueError(f"{origin}: family {name} {wrong}")
        seen.add(name)
        rows.append((k, *known[:3], {s: [str(o) for o in options] for s, options in known[3].items()}, known[4], *ranges[0], *ranges[1], bool(e.get("train_use", False)), e.get("license", "")))
    if not rows:
        raise ValueError(f"{origin}: no families")
    return spark.createDataFrame(rows, SCHEMA)


def spliced(template: str, extra: str) -> str:
    """The template with a round before its last two turns."""
    turns = template.split("\n")
    return "\n".join([*turns[:-2], extra, *turns[-2:]])


def candidates(fams: DataFrame, low: str, high: str) -> DataFrame:
    """Families times their inclusive seed range."""
    return fams.withColumn("seed", F.explode(F.sequence(low, high)))


def picked() -> Column:
    """Slot -> option: each slot takes the one that a hash of family, seed and slot points to."""
    return F.transform_values("slots", lambda k, v: F.get(v, T.hash_pick(F.size(v), F.col("family"), F.col("seed"), k)))


def render(rows: DataFrame) -> DataFrame:
    """Adds prompt and its SHA-1."""
    turns = F.split("template", "\n")
    n = F.size(turns)
    longer = F.array_join(F.concat(F.slice(turns, 1, F.greatest(n - 2, F.lit(0))), F.array("extra"), F.slice(turns, F.greatest(n - 1, F.lit(1)), F.lit(2))), "\n")
    drawn = F.col("extra").isNotNull() & (T.hash_pick(F.lit(2), F.col("family"), F.col("seed"), F.lit(EXTRA)) == 1)
    return rows.withColumn("prompt", T.fill_template(F.when(drawn, longer).otherwise(F.col("template")), picked())).withColumn("fp", F.sha1("prompt"))


def exam_rows(fams: DataFrame, seeds: Mapping[str, Sequence[int]]) -> DataFrame:
    """Rendered rows of {family: seeds} with key_points (the options that were picked). Unknown families, repeated seeds and seeds outside the eval range are refused."""
    known = {r["family"] for r in fams.select("family").collect()}
    if not seeds or set(seeds) - known:
        raise ValueError(f"unknown families {sorted(set(seeds) - known)}" if seeds else "no seeds")
    again = sorted(f for f, s in seeds.items() if len(set(s)) < len(s))
    if again:
        raise ValueError(f"seeds are repeated for {again}")
    wanted = fams.sparkSession.createDataFrame([(f, int(s)) for f, each in seeds.items() for s in each], "family string, seed int")
    rows = wanted.join(F.broadcast(fams), "family")
    wrong = seed_errors(rows.select("load_type", "family", "seed"), fams, "eval").orderBy("family", "seed").first()
    if wrong:
        raise ValueError(f"{wrong['family']} {wrong['seed']}: {wrong['error']}")
    rendered = render(rows)
    said = F.filter(F.array_distinct(F.map_values(picked())), lambda v: F.contains(F.col("prompt"), v))  # a slot of a round that was left out says nothing
    return rendered.withColumn("key_points", said)


def class_targets(base: int, percent: Mapping[str, float], anchor: str = "rag") -> dict[str, int]:
    """Sizes of the other classes when `base` rows of the anchor class are its percentage of the whole."""
    if base < 1 or percent.get(anchor, 0) <= 0 or abs(sum(percent.values()) - 100) > 1e-9:
        raise ValueError("percentages must add up to 100, and the anchor must have rows and a share")
    total = round(base / (percent[anchor] / 100))
    return {c: round(total * p / 100) for c, p in percent.items() if c != anchor}


def mix_deviations(counts: DataFrame, percent: Mapping[str, float], tolerance: float = 5.0) -> DataFrame:
    """(load_type, n, pct) of classes that are more than `tolerance` points off, given (load_type, n, pct). Classes without a share are off by all they have."""
    want = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, p in percent.items() for x in (c, float(p))]), F.col("load_type")), F.lit(0.0))
    return counts.filter(F.abs(F.col("pct") - want) > tolerance)


def seed_plan(rendered: DataFrame, targets: dict[str, int], golden: DataFrame) -> DataFrame:
    """Seeds by round-robin over families (in order), ascending seeds, content seen once and never an exam's, up to each class's target.

    Of equal prompts the earliest in a first ordering stays; rounds are numbered
    after that, so the plan depends on no loop.
    """
    free = rendered.filter("train_use").join(golden.select("fp").distinct(), "fp", "left_anti")
    order = ["seed", "family_ord"]
    once = free.withColumn("_k", F.row_number().over(Window.partitionBy("fp").orderBy(*order))).filter("_k = 1")
    rounds = once.withColumn("round", F.row_number().over(Window.partitionBy("load_type", "family").orderBy("seed")))
    ranked = rounds.withColumn("rank", F.row_number().over(Window.partitionBy("load_type").orderBy("round", "family_ord")))
    table = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    return ranked.filter(F.col("rank") <= F.element_at(table, F.col("load_type"))).drop("_k")


def seed_errors(rows: DataFrame, fams: DataFrame, side: str = "train") -> DataFrame:
    """Rows whose seed is not in their family's range for `side`: which of three ways."""
    known = fams.select("load_type", "family", "eval_lo", "eval_hi", "train_lo", "train_hi")
    joined = rows.join(F.broadcast(known), ["load_type", "family"], "left")
    mine, other = ("train", "eval") if side == "train" else ("eval", "train")
    within = lambda s: F.coalesce(F.col("seed").between(F.col(f"{s}_lo"), F.col(f"{s}_hi")), F.lit(False))
    error = F.when(F.col("eval_lo").isNull(), "unknown family").when(within(mine), None).when(within(other), f"seed is in the {other} range").otherwise("seed is in neither range")
    return joined.withColumn("error", error).filter("error IS NOT NULL").select(*rows.columns, "error")


def range_overlaps(fams: DataFrame) -> DataFrame:
    return fams.filter("eval_lo <= train_hi AND train_lo <= eval_hi")


def regeneration_errors(rows: DataFrame, fams: DataFrame) -> DataFrame:
    """Rows whose prompt is not what their family and seed give."""
    again = render(rows.select("load_type", "family", "seed").distinct().join(F.broadcast(fams.select("load_type", "family", "template", "slots", "extra")), ["load_type", "family"]))
    joined = rows.join(again.select("load_type", "family", "seed", F.col("prompt").alias("_want")), ["load_type", "family", "seed"], "left")
    return joined.filter(~F.col("prompt").eqNullSafe(F.col("_want"))).drop("_want")
