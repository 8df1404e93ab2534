"""Schema normalization: fills, keys, record kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T, vocab
from ..sources.tables import written

#: The path columns of an item.
PATHS = ("infrared_degraded_path", "visible_degraded_path", "infrared_clean_path", "visible_clean_path", "fused_gt_path")
STAGES = ("infrared", "visible", "fused")


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """df with `name`, a dense row number by the given columns, made in two steps so that no task holds all rows: range partitions, then offsets of the partitions.
    Range bounds come from a sample, and two reads may sample differently, so the numbered rows are written once and both steps read that table.
    The offsets, one a partition, are a scalar subquery: a join would move all rows by partition once Spark's estimate of the sums' size is over its limit for broadcasts.
    Ties keep no fixed order; an empty table gives none."""
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(number, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    parts = written(parts.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"), "ordinals")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = df.sparkSession.range(number).select(F.col("id").alias("_p")).join(sizes, F.col("_p") == F.col("_part"), "left").select("_p", F.coalesce("_n", F.lit(0)).alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
    offsets = offsets.agg(F.sort_array(F.collect_list(F.struct("_p", "_before")))["_before"]).scalar()
    return parts.withColumn(name, F.get(offsets, F.col("_part").cast("int")) + F.col("_at")).drop("_part", "_at")


def filled_metadata(df: DataFrame) -> DataFrame:
    """Labels and levels from the folders of the degraded paths (label: parent, level: the one above), scene from the file name of the fused, else the infrared path, where they are missing."""
    out = df
    for m in ("infrared", "visible"):
        parts = F.split(F.col(f"{m}_degraded_path"), "/")
        out = out.withColumn(f"{m}_label", T.given(F.col(f"{m}_label"), F.try_element_at(parts, F.lit(-2))))
        out = out.withColumn(f"{m}_level", T.given(F.col(f"{m}_level"), F.try_element_at(parts, F.lit(-3))))
    return out.withColumn("base_image", T.base_scene(F.col("base_image"), F.col("fused_gt_path"), F.col("infrared_degraded_path")))


def rl_projection(df: DataFrame, *more: str) -> DataFrame:
    """The eleven columns of a sample, labels canonical, id from id, sample_id or the ordinal; and columns of df as they are."""
    has = set(df.columns)
    pick = lambda *names: T.given(*[F.col(n) for n in names if n in has])
    columns = [F.coalesce(pick("id", "sample_id"), F.format_string("sample_%06d", F.col("ordinal"))).alias("id")]
    columns += [F.coalesce(F.col(p), F.lit("")).alias(p) for p in PATHS]
    for m in ("infrared", "visible"):
        path = F.col(f"{m}_degraded_path")
        columns.append(F.coalesce(T.given(T.canonical_label(pick(f"{m}_label"))), T.canonical_label(T.path_label(path))).alias(f"{m}_label"))
        columns.append(F.coalesce(pick(f"{m}_level"), T.path_level(path)).alias(f"{m}_level"))
    columns.append(T.base_scene_from_id(F.col("base_image"), pick("id", "sample_id"), F.col("infrared_degraded_path"), F.col("visible_degraded_path"), F.col("fused_gt_path")).alias("base_image"))
    return df.select(*columns, *more)


def rl_samples(items: DataFrame, most: int = 0) -> DataFrame:
    """rl_projection() of the first `most` items by their ordinal (0: all), with errors: what sample_errors() finds, and `duplicate id` where others of these have the same one."""
    from .rules import sample_errors

    chosen = items.where(F.col("ordinal") < most) if most > 0 else items
    d = rl_projection(chosen.withColumn("_errors", sample_errors(F.col("ordinal"))), "_errors", "ordinal")
    again = d.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("id").alias("_id"))
    d = d.join(again, F.col("id") == F.col("_id"), "left")
    return d.withColumn("errors", F.when(F.col("_id").isNotNull(), F.concat("_errors", F.array(F.concat(F.lit("duplicate id: "), "id")))).otherwise(F.col("_errors"))).drop("_errors", "_id")


def flat_conversations(turns: DataFrame, key: str = "conv_id", by: str = "turn") -> DataFrame:
    """key, roles (a>b>c), n, flat: a conversation's turns in order, each text in its role's tag, one a line. For conversations that fit a row."""
    c = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(by, "role", "text"))).alias("t"))
    line = lambda x: F.concat(F.lit("<"), x["role"], F.lit(">"), x["text"], F.lit("</"), x["role"], F.lit(">"))
    return c.select(key, F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("roles"), F.size("t").cast("long").alias("n"), F.array_join(F.transform("t", line), "\n").alias("flat"))


def stratum() -> Column:
    """The four parts of a stratum as a struct, in the builder's order of labels."""
    label = lambda m: T.canonical_degradation(F.col(f"{m}_label")).alias(f"{m}_label")
    return F.struct(F.col("infrared_level"), label("infrared"), F.col("visible_level"), label("visible"))


def composite_key(*columns: str) -> Column:
    """Parts joined by '||', null as ''."""
    return F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def record_kind(suffixes=STAGES) -> Column:
    """'stage_cot', 'final_cot', 'legacy_understand' or 'missing'."""
    every = lambda suffix: F.lit(True) if not suffixes else _all([T.given(F.col(f"{s}_{suffix}")).isNotNull() for s in suffixes])
    return F.when(every("cot"), "stage_cot").when(T.given(F.col("final_cot")).isNotNull(), "final_cot").when(every("understand"), "legacy_understand").otherwise("missing")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def cot_all_valid() -> Column:
    """True, false, or null where cot_valid is absent."""
    v = F.col("cot_valid")
    return F.when(v.isNotNull(), _all([F.coalesce(v[s], F.lit(False)) for s in STAGES]))


def quality_rank() -> Column:
    """4 stage text, valid; 3 stage text; 2 final text; 1 legacy; 0 nothing."""
    kind = record_kind()
    return F.when((kind == "stage_cot") & F.coalesce(cot_all_valid(), F.lit(False)), 4).when(kind == "stage_cot", 3).when(kind == "final_cot", 2).when(kind == "legacy_understand", 1).otherwise(0)


def understand_value(stage: str) -> Column:
    """The legacy field, else the last such tag of the stage's, the final answer's or the final text, cleaned like the field."""
    tag = f"{stage}_understand"
    tagged = [T.legacy_understand(T.last_tag(F.col(c), tag)) for c in (f"{stage}_cot", "final_answer", "final_cot")]
    return F.coalesce(T.given(T.legacy_understand(F.col(tag)), *tagged), F.lit(""))


def clean_stage_schema(df: DataFrame) -> DataFrame:
    """id, paths and three sanitized stage texts, from the raw outputs first; rows where a field could not be found are left out."""
    out = df.select("id", *PATHS, *[T.sanitized_stage(T.given(F.col("raw_qwen_outputs")[s], F.col(f"{s}_cot")), s).alias(f"{s}_cot") for s in STAGES])
    for s in STAGES:
        out = out.where(~F.contains(F.col(f"{s}_cot"), F.lit("No clean field could be extracted")))
    return out


def unpivoted_paths(df: DataFrame, key: str | list[str] = "id", columns=PATHS, value: str = "path") -> DataFrame:
    """A row for each column of a row: key, the column's name, its value."""
    return df.unpivot([key] if isinstance(key, str) else key, list(columns), "key", value)


def conversation(df: DataFrame, ask: Column, answer: Column, images: list[str]) -> DataFrame:
    """id, conversations [{from, value}] and image paths."""
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    return df.select("id", F.array(turn("human", ask), turn("gpt", answer)).alias("conversations"), F.array(*[F.col(c) for c in images]).alias("image"))


def answer_value(protocol: str = "full") -> Column:
    """An item's answer text: the protocol's frame, and under "full" that of the item's kind, filled with its cleaned texts."""
    framed = lambda kind: prompt(vocab.ANSWER[kind], **{c: T.clean(F.col(c)) for c in re.findall(r"\{(\w+)\}", vocab.ANSWER[kind])})
    if protocol != "full":
        return framed(protocol)
    kind = record_kind()
    return F.when(kind == "stage_cot", framed("stage_cot")).when(kind == "final_cot", framed("final_cot")).otherwise(framed("legacy_understand"))


def protocol_conversation(df: DataFrame, protocol: str = "full") -> DataFrame:
    """id, conversations and image paths of items by a protocol; the first two images are asked about, the others answered."""
    clean = PATHS[2:] if protocol != "fused_only" else PATHS[4:]
    return conversation(df, F.lit(vocab.ASK[protocol]), answer_value(protocol), [*PATHS[:2], *clean])


def message(text: Column, images: list[Column], most_pixels: int = 0, least_pixels: int = 0) -> Column:
    """One user message [{role, content}]: the images that are given, in order, then the text."""
    pixels = lambda n: F.lit(n if n > 0 else None).cast("int")
    part = lambda kind, image, words, hi=None, lo=None: F.struct(
        F.lit(kind).alias("type"), image.alias("image"), words.alias("text"), pixels(hi or 0).alias("max_pixels"), pixels(lo or 0).alias("min_pixels"))
    none = F.lit(None).cast("string")
    content = F.array(*[F.when(T.given(c).isNotNull(), part("image", c, none, most_pixels, least_pixels)) for c in images], part("text", none, text))
    return F.array(F.struct(F.lit("user").alias("role"), F.filter(content, lambda x: x.isNotNull()).alias("content")))


def flat_answer(values: dict[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"<{k}>"), F.coalesce(v, F.lit("")), F.lit(f"</{k}>")) for k, v in values.items()])


def image_names(text: Column) -> Column:
    """For each placeholder the last image tag opened before it, else extra_image_n."""
    names = ("clean_infrared_image", "clean_visible_image", "clean_fused_image")
    pieces = F.split(text, r"<\|image\|>")
    heads = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    opened = F.transform(heads, lambda x: F.regexp_extract(x, r"(?s).*<(" + "|".join(names) + r")>[^<]*$", 1))
    return F.transform(opened, lambda x, i: F.when(x != "", x).otherwise(F.concat(F.lit("extra_image_"), (i + 1).cast("string"))))


def output_names(text: Column, count: Column) -> Column:
    """File names of the first `count` images: for each placeholder the first free name whose tag is opened before and closed
    behind it; what is left gets the free names in order, then extra_image_n.png."""
    pieces = F.split(F.coalesce(text, F.lit("")), re.escape(vocab.PLACEHOLDER))
    none = F.lit(None).cast("string")

    def tagged(acc: Column, k: Column) -> Column:
        before, behind = (F.array_join(x, vocab.PLACEHOLDER) for x in (F.slice(pieces, 1, k), F.slice(pieces, k + 1, F.greatest(F.size(pieces) - k, F.lit(0)))))
        fits = [F.when(F.contains(before, F.lit(f"<{t}>")) & F.contains(behind, F.lit(f"</{t}>")) & ~F.array_contains(acc, f), F.lit(f)) for t, f in vocab.IMAGE_FILES.items()]
        return F.concat(acc, F.array(F.when(k < F.size(pieces), F.coalesce(*fits)).otherwise(none)))

    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    named = F.aggregate(places, F.array().cast("array<string>"), tagged)
    free = F.concat(F.array_except(F.array(*[F.lit(f) for f in vocab.IMAGE_FILES.values()]), named), F.transform(places, lambda i: F.concat(F.lit("extra_image_"), i.cast("string"), F.lit(".png"))))
    unnamed = lambda i: F.size(F.filter(F.slice(named, 1, i + 1), lambda x: x.isNull()))
    return F.transform(named, lambda x, i: F.coalesce(x, F.get(free, unnamed(i) - 1)))


def legacy_schema(df: DataFrame) -> DataFrame:
    """id, paths and the three understand fields; a row that lacks one fails the job."""
    values = {f"{s}_understand": understand_value(s) for s in STAGES}
    need = [F.when(v != "", v).otherwise(F.raise_error(F.concat(F.lit(f"no {k} in item "), F.coalesce(F.col("id"), F.lit("?"))))).alias(k) for k, v in values.items()]
    return df.select("id", *PATHS, *need)


def result_row(df: DataFrame, raw: dict[str, str]) -> DataFrame:
    """Annotated items from three raw outputs (stage: column): sanitized texts, flat answer, validity and the raw outputs."""
    cots = {s: T.sanitized_stage(F.col(c), s) for s, c in raw.items()}
    out = df.withColumns({f"{s}_cot": c for s, c in cots.items()})
    tags = {t: T.last_tag(F.col(f"{s}_cot"), t) for s in ("visible", "infrared", "fused") for t in vocab.ANSWER_TAGS[s]}
    valid = {s: _all([T.last_tag(F.col(raw[s]), t) != "" for t in vocab.ANSWER_TAGS[s]]) for s in STAGES}
    return out.withColumn("final_answer", flat_answer(tags)).withColumn("cot_valid", F.struct(*[v.alias(s) for s, v in valid.items()])).withColumn("raw_qwen_outputs", F.struct(*[F.col(raw[s]).alias(s) for s in STAGES]))


def completion_text(*columns: str) -> Column:
    """The first text given under one of several names."""
    return F.coalesce(T.given(*[F.col(c) for c in columns]), F.lit(""))


def prompt(template: str, **parts: Column) -> Column:
    """A template with {name} places filled by columns; null is ''."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(parts[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def component_hint(label: Column) -> Column:
    """Components in words, joined by ' + '."""
    return F.array_join(F.transform(T.components(label), lambda x: F.replace(x, F.lit("_"), F.lit(" "))), " + ")


def nested(variant: Column, path: str, kind: str = "double") -> Column:
    """A value within JSON (VARIANT) by path, null if it is not there or of another kind."""
    return F.try_variant_get(variant, f"$.{path}", kind)


def zipped(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined by their place (batch, position); a place that one side lacks fails the job."""
    l, r = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    j = l.join(r, keys, "full")
    return j.where(F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("lengths differ")).isNull()).drop("_l", "_r")


def level2_only(df: DataFrame, infrared: str) -> DataFrame:
    """Both levels level_2, and one canonical infrared label."""
    return df.where((F.col("infrared_level") == "level_2") & (F.col("visible_level") == "level_2") & (T.canonical_label(F.col("infrared_label")) == infrared))


def required_for(protocol: Column) -> Column:
    """The columns that a protocol needs."""
    names = lambda suffix: F.array(*[F.lit(f"{s}_{suffix}") for s in STAGES])
    return F.when(protocol == "full", names("cot")).when(protocol == "fused_only", F.array(F.lit("fused_cot"))).when(protocol == "legacy", names("understand")).otherwise(F.array().cast("array<string>"))
