"""Validation: every rule is a column that is its code where it fails, and null where it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vocab
from . import runs
from .normalize import PATHS, STAGES, _all, cot_all_valid, record_kind, unpivoted_paths


def errors(*rules: Column) -> Column:
    """The codes of the rules that fail."""
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def rule(holds: Column, code: str) -> Column:
    return F.when(~F.coalesce(holds, F.lit(False)), F.lit(code))


def item_valid(require_cot_valid: bool = True, allow_legacy: bool = False, allow_missing_cot_valid: bool = False) -> Column:
    """All paths are there, and a text of some kind; flags of validity are asked of stage texts alone."""
    paths = _all([T.given(F.col(p)).isNotNull() for p in PATHS])
    kind, valid = record_kind(), cot_all_valid()
    checked = F.coalesce(valid, F.lit(allow_missing_cot_valid)) if require_cot_valid else F.lit(True)
    return paths & F.when(kind == "legacy_understand", F.lit(allow_legacy)).when(kind == "missing", F.lit(False)).when(kind == "final_cot", F.lit(True)).otherwise(checked)


def pairing_errors() -> Column:
    """File names differ from the scene's (the first path's, without one), levels differ, or a level or label is no folder of its path."""
    names = [F.element_at(F.split(F.coalesce(F.col(p), F.lit("")), "/"), -1) for p in PATHS]
    expected = T.given(T.clean(F.col("base_image")), names[0])
    level = lambda m: F.coalesce(F.col(f"{m}_level"), F.lit(""))
    out = [rule(_all([n == expected for n in names]), "image_name_mismatch"), rule(level("infrared") == level("visible"), "cross_level_pair")]
    for m in ("infrared", "visible"):
        folders = F.split(F.coalesce(F.col(f"{m}_degraded_path"), F.lit("")), "/")
        for what, value in (("level", level(m)), ("label", F.coalesce(F.col(f"{m}_label"), F.lit("")))):
            out.append(rule((value == "") | F.array_contains(folders, value), f"{m}:path_{what}_mismatch"))
    return errors(*out)


def sample_errors(ordinal: Column) -> Column:
    """What keeps an item from being a sample: paths that are not there, and labels, given or from the path's folder, without a part; each names the item's ordinal."""
    missing = F.array_compact(F.array(*[F.when(T.given(F.col(p)).isNull(), F.lit(p)) for p in PATHS]))
    where = F.concat(F.lit("sample index="), ordinal.cast("string"))
    out = [F.when(F.size(missing) > 0, F.concat(where, F.lit(" missing paths: "), F.array_join(missing, ",")))]
    for m in ("infrared", "visible"):
        label = F.coalesce(T.given(F.col(f"{m}_label"), T.path_label(F.col(f"{m}_degraded_path"))), F.lit(""))
        out.append(F.when((F.size(missing) == 0) & (F.size(T.components(label)) == 0), F.concat(where, F.lit(f" no {m}_label: "), label)))
    return errors(*out)


def turns_in_order(turns: DataFrame, key: str = "conv_id", by: str = "turn") -> DataFrame:
    """key, ordered: a system turn comes first alone, no user turn follows a user turn, and every other turn follows one; a first turn of another kind is passed over."""
    d = runs.carried(runs.in_blocks(turns.select(key, by, "role"), key, [by]), maxima={"_before": F.struct(F.col("_o").alias("o"), F.col("role").alias("role"))}, inclusive=False)
    role, before = F.col("role"), F.col("_before.role")
    ok = F.when(role == "system", F.col("_before").isNull()).when(role == "user", F.col("_before").isNull() | (before != "user")).otherwise(before == "user")
    return d.groupBy(F.col("_k").alias(key)).agg(F.bool_and(ok).alias("ordered"))


def has_control_tags(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?i)<\s*/?\s*(think|answer)\s*>")


def has_markup(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"<\s*/?\s*[^>]+>")


def stage_errors(text: Column, stage: str, min_field: int = 8, min_think: int = 0) -> Column:
    """Codes of a stage's text; a missing text has one code alone."""
    think = T.last_tag(text, "think")
    out = [F.when(think == "", F.lit(f"{stage}_cot_missing_think")).when(F.length(think) < min_think, F.lit(f"{stage}_cot_short_think")), rule(T.last_tag(text, "answer") != "", f"{stage}_cot_missing_answer")]
    for tag in vocab.ANSWER_TAGS[stage]:
        value = T.last_tag(text, tag)
        out += [F.when(F.length(value) < min_field, F.lit(f"{stage}_cot_short_or_missing:{tag}")), F.when(has_control_tags(value), F.lit(f"{stage}_cot_control_tag_inside:{tag}"))]
    return F.when(T.given(text).isNull(), F.array(F.lit(f"missing:{stage}_cot"))).otherwise(errors(*out))


def stage_text_ok(text: Column, stage: str, min_field: int = 1) -> Column:
    """Whether a think, an answer and every field of the stage are there, the fields with min_field characters or more."""
    tags = [T.last_tag(text, t) for t in vocab.ANSWER_TAGS[stage]]
    return (T.last_tag(text, "think") != "") & (T.last_tag(text, "answer") != "") & _all([F.length(v) >= min_field for v in tags])


def ordered_grammar(text: Column, tags, least: int = 1) -> Column:
    """Codes of a text that should be exactly the tags in order, in any case and with spaces in them. A tag that does not
    match leaves the cursor, so later ones still can. Control tags anywhere have a code of their own."""
    nothing = F.array().cast("array<string>")

    def step(acc: Column, tag: Column) -> Column:
        pattern = F.concat(F.lit(r"(?is)^\s*<\s*"), tag, F.lit(r"\s*>(.*?)<\s*/\s*"), tag, F.lit(r"\s*>"))
        value = F.get(F.regexp_extract_all(acc["rest"], pattern, F.lit(1)), F.lit(0))
        hit = value.isNotNull()
        code = lambda holds, name: F.when(holds, F.concat(F.lit(name), tag))
        found = F.array(code(~hit, "missing_or_out_of_order:"), code(hit & (F.length(T.clean(value)) < least), "short:"), code(hit & has_markup(value), "markup:"))
        rest = F.when(hit, F.substr(acc["rest"], F.length(F.regexp_substr(acc["rest"], pattern)) + 1)).otherwise(acc["rest"])
        return F.struct(rest.alias("rest"), F.concat(acc["errors"], F.filter(found, lambda x: x.isNotNull())).alias("errors"))

    controls = F.when(has_control_tags(text), F.array(F.lit("think_or_answer_tag"))).otherwise(nothing)
    start = F.struct(T.clean(text).alias("rest"), controls.alias("errors"))
    return F.aggregate(F.array(*[F.lit(t) for t in tags]), start, step, lambda acc: F.concat(acc["errors"], F.when(T.clean(acc["rest"]) == "", nothing).otherwise(F.array(F.lit("trailing_text")))))


def record_errors(min_field: int = 8, min_think: int = 0, min_final: int = 1) -> Column:
    """All codes of an annotated item."""
    valid = F.col("cot_valid")
    flags = [rule(valid.isNotNull(), "missing_cot_valid"), *[F.when(valid.isNotNull() & ~F.coalesce(valid[s], F.lit(False)), F.lit(f"cot_valid_false:{s}")) for s in STAGES]]
    base = errors(rule(T.given(F.col("error")).isNull(), "error"), *[rule(T.given(F.col(p)).isNotNull(), f"missing_path:{p}") for p in PATHS], *flags)
    tags = [t for s in ("visible", "infrared", "fused") for t in vocab.ANSWER_TAGS[s]]
    return F.concat(base, *[stage_errors(F.col(f"{s}_cot"), s, min_field, min_think) for s in STAGES], ordered_grammar(F.col("final_answer"), tags, min_final))


def complete(columns: list[str]) -> Column:
    """All named fields are there (resume: nothing left to do)."""
    return _all([T.given(F.col(c)).isNotNull() for c in columns])


def missing_fields(columns: list[str]) -> Column:
    return errors(*[rule(T.given(F.col(c)).isNotNull(), c) for c in columns])


def leaked_keys(df: DataFrame, forbidden) -> list[str]:
    """Columns that must not be there."""
    return sorted(set(df.columns) & set(forbidden))


def leaked_text(columns: list[str], fragments) -> Column:
    return F.exists(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns]), lambda x: _any([F.contains(x, F.lit(f)) for f in fragments]))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def error_summary(df: DataFrame, column: str = "errors") -> DataFrame:
    """code, n: most frequent first, then by code."""
    return df.select(F.explode(column).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code")


def error_examples(df: DataFrame, order: str, n: int = 10, column: str = "errors") -> DataFrame:
    """The first n rows that have errors."""
    return df.where(F.size(column) > 0).orderBy(order).limit(n)


def missing_paths(df: DataFrame, listing: DataFrame, key: str = "id", columns=PATHS) -> DataFrame:
    """key, missing: path columns whose file is not in the listing (path)."""
    long = unpivoted_paths(df, key, columns)
    return long.join(listing.select("path").distinct(), "path", "left_anti").groupBy(key).agg(F.array_sort(F.collect_list("key")).alias("missing"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_empty(df: DataFrame, what: str) -> None:
    """Fails the job if df has rows."""
    first = df.take(3)
    if first:
        raise ValueError(f"{what}: {[r.asDict() for r in first]}")


def external_error(message: Column, own: list[str]) -> Column:
    """A failure that is not the policy's: some message, and none of the known parts in it."""
    return (F.coalesce(message, F.lit("")) != "") & ~_any([F.contains(message, F.lit(x)) for x in own])


def external_reference_error(error: Column, modalities: list[Column]) -> Column:
    """Whether a reference reward failed for want of data. A wrong number of images or a wrong size is the policy's own
    failure; where modalities report errors, theirs decide."""
    whole = T.clean(error)
    parts = [T.clean(m) for m in modalities]
    of_parts = _any([external_error(m, [vocab.WRONG_SIZE]) for m in parts])
    named = _any([m != "" for m in parts])
    return (whole != "") & ~F.contains(whole, F.lit(vocab.WRONG_COUNT)) & F.when(named, of_parts).otherwise(external_error(whole, [vocab.WRONG_SIZE]))


def divisible(size: Column, by: int = 32) -> Column:
    """Whether an image side is given, above 0 and a multiple of `by`."""
    return F.coalesce((size > 0) & (F.pmod(size, F.lit(by)) == 0), F.lit(False))


#: Settings of a run with the least value they may have (exclusive: above it).
LEAST = {"num_generations": 2, "image_top_k": 2, "text_top_k": 1, "kl_beta": 0}
ABOVE = {"max_new_tokens": 0, "temperature": 0, "per_device_batch_size": 0, "gradient_accumulation_steps": 0, "epochs": 0, "lr": 0, "reward_timeout_sec": 0, "distributed_timeout_sec": 0}


def argument_errors(args: dict) -> list[str]:
    """All that is wrong with a run's settings, at once; empty if nothing is."""
    out = [f"{k} must be >= {v}" for k, v in LEAST.items() if args[k] < v] + [f"{k} must be > {v}" for k, v in ABOVE.items() if args[k] <= v]
    if args["stop_after_images"] != 3:
        out.append("stop_after_images must be 3")
    if not args["do_sample"]:
        out.append("do_sample must be on")
    for pair in (("lambda_text", "lambda_image"), ("reference_reward_weight", "qwen_reward_weight")):
        weights = [args[k] for k in pair]
        if min(weights) < 0 or sum(weights) <= 0:
            out.append(f"{' and '.join(pair)} must not be negative, and not both 0")
    if args["skip_image_reward"] and args["reference_reward_weight"] <= 0:
        out.append("skip_image_reward needs reference_reward_weight > 0")
    return out


def require_passed(report: DataFrame, what: str) -> None:
    """Fails the job unless the one row of an earlier gate's report says passed."""
    rows = report.select("passed").take(2)
    if len(rows) != 1 or rows[0]["passed"] is not True:
        raise ValueError(f"{what} has not passed")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def threshold_gate(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """metrics (one row) with a boolean for each limit (name: (>= or <=, value)) and passed."""
    checks = {f"{k}_ok": F.coalesce((F.col(k) >= v) if op == ">=" else (F.col(k) <= v), F.lit(False)) for k, (op, v) in limits.items()}
    return metrics.select("*", *[c.alias(k) for k, c in checks.items()], _all(list(checks.values())).alias("passed"))


def splits_gate(small: DataFrame, large: DataFrame, extra: DataFrame, key: str = "id") -> DataFrame:
    """One row: small is nested in large, small and extra are disjoint, and together they are large."""
    ids = lambda d: d.select(F.col(key).alias("k")).distinct()
    seen = ids(small).withColumn("s", F.lit(1)).unionByName(ids(large).withColumn("l", F.lit(1)), allowMissingColumns=True).unionByName(ids(extra).withColumn("e", F.lit(1)), allowMissingColumns=True)
    per = seen.groupBy("k").agg(*[F.count(c).alias(c) for c in "sle"])
    return per.agg(F.coalesce(F.bool_and(F.col("s") <= F.col("l")), F.lit(True)).alias("nested"), F.coalesce(F.bool_and(F.col("s") + F.col("e") <= 1), F.lit(True)).alias("disjoint"), F.coalesce(F.bool_and(F.greatest("s", "e") == F.col("l")), F.lit(True)).alias("union_equals"))
