"""Mixing sources to target weights, with DataFrame functions only.

Each document has a hash-random key. Within a source the documents are taken in
key order until the source's budget is spent: whole epochs first, then one cut.
The cut is found with a distributed prefix sum over ranges of the key space, so
no source, however hot, is ever sorted in one task, and texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.common import WORD, set_aside, stage, word_count

RANGE_ROWS = 512
MAX_RANGE_DIGITS = 5
BROADCAST_SOURCES = 50_000


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = word_count(F.col(text_col))
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col(source_col), size.cast("string")))
    return docs.withColumns({"_size": size, "_key": key})


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Water-filling over one row per source (columns _source, _total): adds _target.

    Sources in code-point order (null last) weigh weights[0], weights[1], ..., repeating. Targets
    share the sum of all totals by weight; none exceeds max_epochs times its source's total, and the
    excess is shared again by weight among the rest. With caps c and weights w sorted by c / w, the
    sources before the first one with c / w >= level are capped, where level is the rest of the sum
    over the rest of the weights. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_weight", weight.cast("double")).withColumn("_cap", F.col("_total") * F.lit(max_epochs))
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_left": F.sum("_total").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_weights_left": F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("_level", F.col("_left") / F.col("_weights_left"))
    level = F.min_by("_level", F.struct(F.col("_cap") / F.col("_weight"), F.col("_source").isNull(), "_source"))
    free = rows.where(F.col("_cap") >= F.col("_level") * F.col("_weight")).agg(level.alias("_free_level"))
    target = F.when(F.col("_cap") < F.col("_free_level") * F.col("_weight"), F.col("_cap").cast("double")).otherwise(F.col("_free_level") * F.col("_weight"))
    return rows.crossJoin(F.broadcast(free)).select("_source", "_total", F.coalesce(target, F.lit(0.0)).alias("_target"))


def _cuts(keyed: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: _target, _full epochs, the key at which the last epoch is cut, the words left there for each row of that key."""
    rows = keyed.count()
    digits = next((d for d in range(1, MAX_RANGE_DIGITS) if 16**d * RANGE_ROWS >= rows), MAX_RANGE_DIGITS)
    ranged = keyed.withColumn("_range", F.substring("_key", 1, digits))
    by_range = stage(ranged.groupBy("_source", "_range").agg(F.sum("_size").alias("_words")), "mix-ranges")
    targets = source_targets(by_range.groupBy("_source").agg(F.sum("_words").alias("_total")), weights, max_epochs)
    budget = F.round("_target").cast("long")
    targets = targets.withColumns({"_full": F.when(F.col("_total") > 0, F.floor(budget / F.col("_total"))).otherwise(F.lit(0)).cast("long")})
    targets = stage(targets.withColumn("_rest", budget - F.col("_full") * F.col("_total")), "mix-targets")
    w = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    prefix = by_range.withColumn("_before", F.coalesce(F.sum("_words").over(w), F.lit(0)))
    at = prefix.join(targets, prefix["_source"].eqNullSafe(targets["_source"])).where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words")))
    at = at.select(prefix["_source"].alias("_s"), F.col("_range").alias("_r"), F.col("_before"), "_rest")
    inside = ranged.join(at, ranged["_source"].eqNullSafe(at["_s"]) & (ranged["_range"] == at["_r"]))
    inside = inside.groupBy("_source", "_key").agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_rows"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
    k = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_words").over(k), F.lit(0)))
    cut = inside.where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words")))
    cut = cut.select(F.col("_source").alias("_cut_source"), F.col("_key").alias("_cut_key"), F.floor((F.col("_rest") - F.col("_before")) / F.col("_rows")).alias("_cut_words"))
    out = targets.join(cut, targets["_source"].eqNullSafe(cut["_cut_source"]), "left").drop("_cut_source")
    return stage(out, "mix-cuts")


def _taken(keyed: DataFrame, cuts: DataFrame, source: str) -> tuple[DataFrame, list[Column]]:
    """keyed joined to the cuts of its sources, and the columns ADDED over that."""
    few = cuts.count() <= BROADCAST_SOURCES
    salts = 1 if few else 32
    left = keyed.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)))
    right = cuts.withColumn("_salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    right = F.broadcast(right) if few else right
    joined = left.join(right, left[source].eqNullSafe(right["_source"]) & (left["_salt"] == right["_salt2"]))
    in_rest = F.when(F.col("_cut_key").isNull(), F.lit(0)).when(F.col("_key") < F.col("_cut_key"), F.col("_size")).when(F.col("_key") == F.col("_cut_key"), F.least("_cut_words", "_size")).otherwise(F.lit(0))
    taken = F.col("_full") * F.col("_size") + in_rest
    return joined, [x.alias(c) for x, c in zip((F.col("_size"), F.col("_total"), F.col("_target"), taken.cast("long")), ADDED, strict=True)]


ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_taken"]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with the added columns mix_size, mix_source_size, mix_target and mix_taken (words taken, repeats counted).

    Null and empty texts have size 0; null sources are one source, last in order; a source without words has
    target and taken 0. Rows whose key is equal (same id, source and size, as of repeated rows) share the words at
    the cut equally. Very long texts count whole. An empty table gives an empty result. Other columns pass
    through; those named like an added one are replaced.
    """
    docs, names = set_aside(docs)
    source = names[source_col]
    keyed = _keyed(docs, names[id_col], names[text_col], source)
    cuts = _cuts(stage(keyed.select(F.col(source).alias("_source"), "_size", "_key"), "mix-keys"), weights, max_epochs)
    joined, new = _taken(keyed, cuts, source)
    return joined.select(*[F.col(x).alias(c) for c, x in names.items() if c not in ADDED], *new)


def mix_figures(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The id, the source and the added columns of mix_sources, whose rules hold; the texts are read once."""
    given, names = set_aside(docs.select(id_col, text_col, source_col))
    id_, text, source = names.values()
    slim = stage(_keyed(given, id_, text, source).select(id_, F.col(source).alias("_source"), "_size", "_key"), "mix-keys")
    joined, new = _taken(slim.withColumnRenamed("_source", source), _cuts(slim, weights, max_epochs), source)
    return joined.select(F.col(id_).alias(id_col), F.col(source).alias(source_col), *new)


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: whole documents once per full take, and the cut document shortened to its first words; columns of docs, whatever their names.

    Documents without words are never taken, so an empty table, or one of null texts, gives an empty one. Rows at the cut
    with equal keys are shortened alike. A column n_chars follows a shortened text.
    """
    given, names = set_aside(docs)
    text = names[text_col]
    mixed = mix_sources(given, **{k: names.get(x, x) if k.endswith("_col") else x for k, x in ({"id_col": "doc_id", "source_col": "source"} | options).items()}, text_col=text)
    whole = F.when(F.col("mix_size") > 0, F.floor(F.col("mix_taken") / F.col("mix_size"))).otherwise(F.lit(0)).cast("int")
    part = (F.col("mix_taken") - whole * F.col("mix_size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = mixed.withColumn("_part", F.explode(copies))
    short = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_part")), " ")
    rows = rows.withColumn("_text", F.when(F.col("_part") > 0, short).otherwise(F.col(text)))
    new = {text_col: F.col("_text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_part") > 0, F.length("_text").cast("long")).otherwise(F.col(names["n_chars"]))
    return rows.select(*[new.get(c, F.col(x)).alias(c) for c, x in names.items()])
