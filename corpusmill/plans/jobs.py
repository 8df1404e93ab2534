"""The three lifecycles as thin compositions: build a corpus, split it, score completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scoring, text as T
from ..operators import normalize, reports, rules, sampling


def build_corpus(items: DataFrame, per_stratum: int, seed: str, *, strict: bool = False, save=None, **validity) -> dict[str, DataFrame]:
    """Annotated items with an ordinal -> training rows: fill, validate, keep the best of each pair, select by balanced exposure, sanitize.
    Returns selected, training, rejected (with errors), summary, counts and skipped strata."""
    full = normalize.filled_metadata(items)
    invalid = rules.errors(rules.rule(rules.item_valid(**validity), "invalid_format"))
    checked = full.withColumn("errors", F.concat(invalid, rules.pairing_errors()))
    rejected = checked.where(F.size("errors") > 0)
    if strict:
        rules.require_empty(rejected.select("id", "errors"), "rejected items")
    good = checked.where(F.size("errors") == 0).drop("errors").withColumn("quality", normalize.quality_rank())
    best = sampling.priority_dedup(good, ["infrared_degraded_path", "visible_degraded_path"], "quality", "ordinal")
    s = normalize.stratum()
    best = best.withColumn("stratum", F.concat_ws("|", *[s[f] for f in ("infrared_level", "infrared_label", "visible_level", "visible_label")]))
    if save:
        best = save(best)
    selected = sampling.balanced_sample(best, per_stratum, "stratum", "base_image", "visible_level", "id", seed, save)
    rules.require_empty(rules.repeated_keys(selected, "id"), "repeated ids")
    return {
        "selected": selected, "training": normalize.clean_stage_schema(selected), "rejected": rejected, "summary": rules.error_summary(rejected),
        "counts": reports.counts(selected, "stratum"), "skipped": sampling.skipped_strata(best, per_stratum, "stratum"),
    }


def split_manifests(items: DataFrame, quotas: dict[str, DataFrame], seed: str, infrared: str, dev: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Level-2 splits by quota (name: stratum, quota; nested as quotas are), what the second adds to the first, and a scene-disjoint dev split."""
    rl = normalize.rl_projection(items)
    rl = normalize.level2_only(rl, infrared).withColumn("stratum", F.col("visible_label"))
    out = {name: sampling.quota_sample(rl, q, "stratum", "id", seed) for name, q in quotas.items()}
    for name, q in quotas.items():
        rules.require_empty(sampling.shortfalls(rl, q, "stratum"), f"too few rows for {name}")
    names = list(quotas)
    if len(names) > 1:
        out["extra"] = reports.pending(out[names[1]], out[names[0]], "id")
    if dev:
        out["dev"] = sampling.scene_disjoint_sample(rl, dev, "stratum", "base_image", "id", seed, out[names[-1]])
    return out


def score_completions(rows: DataFrame, cache: DataFrame, *, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Completions (id, text, n_images, infrared_label, visible_label, reference_score) with gate, text, judge and composed scores, and
    the rows whose judgement the cache lacks though their gate is open. cache: cache_key, raw (map)."""
    keyed = rows.withColumn("cache_key", key if key is not None else T.content_key(F.col("id"), F.col("text")))
    j = keyed.join(cache.select("cache_key", "raw"), "cache_key", "left")
    j = j.withColumn("gate", scoring.format_gate(F.col("text"), F.col("n_images")))
    j = j.withColumn("text_score", scoring.text_reward(scoring.label_score(F.col("text"), F.col("infrared_label"), F.col("visible_label")), scoring.planning_score(F.col("text"))))
    marks = {k: F.try_element_at("raw", F.lit(k)) for k in scoring.JUDGE_WEIGHTS}
    j = j.withColumn("judge_score", scoring.judge_score(marks))
    scored = j.withColumn("score", scoring.two_level(F.col("gate.score"), F.col("text_score"), F.col("judge_score"), F.col("raw").isNull(), F.col("reference_score")))
    return scored, scored.where(F.col("raw").isNull() & (F.col("gate.score") > 0))
