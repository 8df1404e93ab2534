"""Scores as columns: format, labels, planning, judges, references and their composition."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from . import text as T, vocab


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _once(value: Column, use) -> Column:
    """use(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_LAST = vocab.OUTER_TAGS[-1]
_OPENING = rf"(?s)<{_LAST}>\s*{re.escape(vocab.PLACEHOLDER)}\s*$"


def _found(text: Column, tag: Column) -> Column:
    return F.regexp_extract_all(text, F.concat(F.lit("(?s)<"), tag, F.lit(">(.*?)</"), tag, F.lit(">")), F.lit(1))


def tag_report(text: Column) -> Column:
    """missing, empty, duplicate tags (inner ones as stage.tag), whether the outer ones are in order, and whether the last image tag is open at the end."""

    def report(t: Column, is_open: Column) -> Column:
        def seen(name: str, outer: str | None, tag: str, found: Column) -> Column:
            end = is_open if name == _LAST else F.lit(False)
            at = F.when(end, F.regexp_instr(t, F.lit(_OPENING))).otherwise(F.instr(t, f"<{tag}>")) if outer is None else F.lit(None).cast("int")
            return F.struct(
                F.lit(name).alias("name"), F.lit(outer is None).alias("is_outer"), F.when(end, 1).otherwise(F.size(found)).alias("n"),
                F.when(end, vocab.PLACEHOLDER).otherwise(T.clean(F.get(found, F.lit(0)))).alias("first"), at.alias("at"),
            )

        def look(outer: str) -> Column:
            # The contents of an outer tag are found once, for itself and for the tags inside.
            def stage(found: Column) -> Column:
                own = F.array(seen(outer, None, outer, found))
                inner = [_once(_found(F.coalesce(F.get(found, F.lit(0)), F.lit("")), F.lit(i)), lambda f, i=i: seen(f"{outer}.{i}", outer, i, f)) for i in vocab.INNER_TAGS.get(outer, ())]
                return F.concat(own, F.array(*inner)) if inner else own

            return _once(_found(t, F.lit(outer)), stage)

        def judge(rows: Column) -> Column:
            names = lambda keep: F.transform(F.filter(rows, keep), lambda x: x["name"])
            places = F.transform(F.filter(rows, lambda x: x["is_outer"] & (x["n"] > 0)), lambda x: x["at"])
            ordered = _once(places, lambda p: (F.size(p) == len(vocab.OUTER_TAGS)) & (F.array_sort(F.array_distinct(p)) == p))
            return F.struct(names(lambda x: x["n"] == 0).alias("missing"), names(lambda x: (x["n"] > 0) & (x["first"] == "")).alias("empty"), names(lambda x: x["n"] > 1).alias("duplicate"), ordered.alias("order_ok"), is_open.alias("open_end"))

        # Outer tags first, as they were listed.
        rows = lambda all_: F.concat(F.filter(all_, lambda x: x["is_outer"]), F.filter(all_, lambda x: ~x["is_outer"]))
        return _once(_once(F.flatten(F.array(*[look(o) for o in vocab.OUTER_TAGS])), rows), judge)

    opened = lambda t: _once(~F.contains(t, F.lit(f"</{_LAST}>")) & t.rlike(_OPENING), lambda is_open: report(t, is_open))
    return _once(F.coalesce(text, F.lit("")), opened)


N_TAGS = len(vocab.OUTER_TAGS) + sum(map(len, vocab.INNER_TAGS.values()))


def format_score(text: Column, n_images: Column, expected: int = 3, require_images: bool = True) -> Column:
    """score, ok, text_score, image_score, problems of the staged format. n_images may be null (not decoded)."""
    near = lambda n: F.greatest(F.lit(0.0), 1.0 - F.abs(n - expected) / float(expected))

    def grade(r: Column, marks: Column, n: Column) -> Column:
        images_ok = F.coalesce(n == expected, F.lit(False)) if require_images else F.coalesce(n == expected, marks == expected)
        image_score = F.when(images_ok, 1.0).otherwise(F.coalesce(near(n), F.lit(0.0) if require_images else near(marks)))
        tag_score = F.greatest(F.lit(0.0), (N_TAGS - F.size(r["missing"]) - F.size(r["empty"])) / float(N_TAGS))
        penalty = F.least(F.lit(0.20), 0.04 * F.size(r["duplicate"]))
        text_score = unit(0.75 * tag_score + 0.15 * r["order_ok"].cast("double") + 0.10 * near(marks) - penalty)
        named = lambda kind: F.transform(r[kind], lambda x: F.concat(F.lit(f"{kind}:"), x))
        order = F.filter(F.array(F.when(~r["order_ok"], F.lit("tag_order"))), lambda x: x.isNotNull())
        problems = F.concat(r["missing"], named("empty"), named("duplicate"), order)
        ok = images_ok & (marks == expected) & (F.size(problems) == 0)
        score = F.when(ok, 1.0).otherwise(unit(0.70 * text_score + 0.30 * image_score))
        return F.struct(score.alias("score"), ok.alias("ok"), text_score.alias("text_score"), image_score.alias("image_score"), problems.alias("problems"), images_ok.alias("image_count_ok"), marks.alias("placeholders"))

    found = lambda t: F.struct(tag_report(t).alias("r"), T.placeholders(t).alias("marks"), n_images.alias("n"))
    return _once(_once(text, found), lambda x: grade(x["r"], x["marks"], x["n"]))


def format_gate(text: Column, n_images: Column, expected: int = 3, protocol: Column | None = None) -> Column:
    """score 0 or 1, ok, protocol, problems. The full protocol is strict; the fused-only one wants its opening tags; others fail."""
    p = T.protocol(text) if protocol is None else protocol
    images_ok = F.coalesce(n_images == expected, F.lit(False))
    lacking = lambda tags: F.filter(F.array(*[F.when(~T.has_open(text, t), t) for t in tags]), lambda x: x.isNotNull())
    loose = F.when(p == "fused_only", lacking(vocab.FUSED_ONLY_TAGS)).otherwise(lacking(("clean_fused_image",)))

    def decide(strict: Column) -> Column:
        problems = F.when(p == "full", strict["problems"]).otherwise(loose)
        ok = F.when(p == "full", strict["ok"]).otherwise((p == "fused_only") & images_ok & (T.placeholders(text) == expected) & (F.size(loose) == 0))
        return F.struct(ok.cast("double").alias("score"), ok.alias("ok"), p.alias("protocol"), problems.alias("problems"))

    return _once(format_score(text, n_images, expected), decide)


def coverage(label: Column, text: Column, lexicon: dict = vocab.LEXICON_REWARD) -> Column:
    """Share of the label's components that the text speaks of; 0 without components."""
    share = lambda parts: _once(text, lambda t: F.coalesce(F.try_divide(F.size(T.covered(parts, t, lexicon)), F.size(parts)), F.lit(0.0)))
    return _once(T.components(label), share)


def label_score(text: Column, infrared_label: Column, visible_label: Column) -> Column:
    return 0.5 * coverage(infrared_label, T.modality_text(text, "infrared")) + 0.5 * coverage(visible_label, T.modality_text(text, "visible"))


def degradation_score(text: Column, modality: str, label: Column, penalize: bool = True) -> Column:
    """Coverage of the label in the modality's field, less 0.08 for each component that is named but not there (0.25 at most). Blur sizes stand for each other, and noise is let pass with stripe noise."""
    field = T.last_tag(text, f"{modality}_degradation", strict=True, keep_empty=True)
    parts = T.components(label)
    names = F.array(*[F.lit(x) for x in vocab.COMPONENTS])
    blurred = F.arrays_overlap(parts, F.array(F.lit("blur2"), F.lit("blur4")))
    let_pass = lambda c: (c.isin("blur2", "blur4") & blurred) | ((c == "noise") & F.array_contains(parts, "stripe_noise"))
    extra = F.filter(F.array_except(T.covered(names, field, vocab.LEXICON_FORMAT), parts), lambda c: ~let_pass(c))
    penalty = F.least(F.lit(0.25), 0.08 * F.size(extra)) if penalize else F.lit(0.0)
    score = unit(coverage(label, field, vocab.LEXICON_FORMAT) - penalty)
    return F.when((field == "") | (F.size(parts) == 0), 0.0).otherwise(score)


def planning_score(text: Column) -> Column:
    def share(plan: Column) -> Column:
        hits = [plan.rlike("(?i)" + "|".join(p)).cast("int") for p in vocab.INTENTS.values()]
        return sum(hits[1:], hits[0]) / float(len(hits))

    return _once(text, lambda t: _once(T.planning_text(t), share))


def text_reward(label: Column, planning: Column, label_weight: float = 0.7, planning_weight: float = 0.3) -> Column:
    return unit((label_weight * label + planning_weight * planning) / max(1e-8, label_weight + planning_weight))


# Weights of a judge's marks.
JUDGE_WEIGHTS = {"artifact_suppression": 0.25, "visible_preservation": 0.20, "infrared_preservation": 0.20, "fusion_naturalness": 0.20, "semantic_consistency": 0.15}


def judge_score(marks: dict[str, Column]) -> Column:
    """Weighted marks of 0 to 10; what is no number counts 0."""
    parts = [w * F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(marks[k].try_cast("double"), F.lit(0.0)))) for k, w in JUDGE_WEIGHTS.items()]
    return unit(sum(parts[1:], parts[0]) / 10.0)


def judge_raw(marks: dict[str, Column], overall: Column, error: Column) -> Column:
    """A judge's record from marks of 0 to 1: tenfold marks, the overall one null where it is, and the error."""
    return F.struct(*[(F.coalesce(marks[k], F.lit(0.0)) * 10.0).alias(k) for k in JUDGE_WEIGHTS], (overall * 10.0).alias("overall"), error.alias("error"))


def two_level(gate: Column, text: Column, judge: Column, judge_failed: Column, reference: Column, *, text_weight: float = 0.1, image_weight: float = 0.9, reference_weight: float = 0.9, judge_weight: float = 0.1, modulation: float = 1.0) -> Column:
    """Gate times the weighted text and image scores. A failed judge drops out and the reference takes its weight; a failed reference stays 0 at full weight."""
    wr, wj = F.lit(max(0.0, reference_weight)), F.when(judge_failed, 0.0).otherwise(max(0.0, judge_weight))
    image = F.coalesce(F.try_divide(wr * F.coalesce(reference, F.lit(0.0)) + wj * F.coalesce(judge, F.lit(0.0)), wr + wj), F.lit(0.0))
    wt, wi = max(0.0, text_weight), max(0.0, image_weight)
    base = (wt * text + wi * image) / max(1e-8, wt + wi)
    return unit(gate * base * (modulation + (1.0 - modulation) * text))


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays; null if their sizes differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.try_divide(total, F.size(a)))


def psnr(error: Column, top: float = 1.0, same: float = 100.0) -> Column:
    """Decibels against a top value; `same` for equal arrays."""
    return F.when(error <= 0.0, F.lit(float(same))).otherwise(10.0 * F.log10(F.lit(top * top) / error))


def pair_score(psnr_: Column, ssim: Column, floor: float = 10.0, ceiling: float = 40.0) -> Column:
    return unit(0.6 * unit(ssim) + 0.4 * unit((psnr_ - floor) / max(1e-8, ceiling - floor)))


def three_image_score(infrared: Column, visible: Column, fused: Column, failed: Column) -> Column:
    """0.7 of the weighted mean and 0.3 of the weakest link; 0 if any failed."""
    mean = 0.25 * infrared + 0.25 * visible + 0.50 * fused
    return F.when(failed, 0.0).otherwise(unit(0.70 * mean + 0.30 * F.least(infrared, visible, fused)))


def global_ssim(mean_x: Column, mean_y: Column, var_x: Column, var_y: Column, cov: Column, top: float = 255.0) -> Column:
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    return (2 * mean_x * mean_y + c1) * (2 * cov + c2) / ((mean_x * mean_x + mean_y * mean_y + c1) * (var_x + var_y + c2))


def box_ssim(x: np.ndarray, y: np.ndarray, window: int = 7) -> float:
    """Mean of local SSIM over square windows, zero outside the image and counted, per channel; values 0 to 1, shape (h, w, channels)."""
    k = max(3, window | 1)

    def box(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, ((k // 2 + 1, k // 2), (k // 2 + 1, k // 2), (0, 0))).cumsum(0).cumsum(1)
        return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)

    mx, my = box(x), box(y)
    vx, vy, cov = box(x * x) - mx * mx, box(y * y) - my * my, box(x * y) - mx * my
    c1, c2 = 0.01**2, 0.03**2
    return float(np.clip(np.mean((2 * mx * my + c1) * (2 * cov + c2) / np.maximum((mx * mx + my * my + c1) * (vx + vy + c2), 1e-12)), -1, 1))


@pandas_udf(DoubleType())
def local_ssim(x: pd.Series, y: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """box_ssim of flat pixel arrays of h * w * channels values; null for wrong sizes."""

    def one(a, b, i, j):
        if a is None or b is None or not i or not j or len(a) != len(b) or len(a) % (i * j):
            return None
        return box_ssim(np.asarray(a, float).reshape(i, j, -1), np.asarray(b, float).reshape(i, j, -1))

    return pd.Series([one(*r) for r in zip(x, y, h, w)], dtype=float)


def clipped_objective(logp: Column, old: Column, advantage: Column, clip: float = 0.2) -> Column:
    ratio = F.exp(logp - old)
    return F.least(ratio * advantage, F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio)) * advantage)


def k3_divergence(logp: Column, reference: Column) -> Column:
    d = reference - logp
    return F.exp(d) - d - 1.0
