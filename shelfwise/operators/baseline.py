"""The baseline: axes of titles, its rows, verdicts on listings, and the identities that an answer may name.

Column builders come with the same as SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.filament import classify
from shelfwise.functions.identity import LIKE_IT, color_of, grams, kit_form
from shelfwise.functions.text import VARIANTS, fold, fold_sql, let, lower_tr, lower_tr_sql, title_rules, title_rules_sql

#: Words of dryers, of feeders, and of machines.
DRYER, FEEDER, MACHINE = "kurutucu|dryer", "ams|cfs|renk modulu", "combo|yazici|printer"
#: Identities that an answer may choose from.
ALLOWED = 8


def _combo(words: Column, feeder: Column) -> Column:
    return let(words, lambda t: F.when(t.rlike(r"\bbare\b"), "bare").when(t.rlike(r"\bcombo\b") | feeder.isNotNull(), "combo").otherwise("bare"))


def combo_sql(title: str, feeder: str) -> str:
    t = title_rules_sql(title)
    return f"CASE WHEN regexp_matches({t}, '\\bbare\\b') THEN 'bare' WHEN regexp_matches({t}, '\\bcombo\\b') OR {feeder} IS NOT NULL THEN 'combo' ELSE 'bare' END"


def axes(found: DataFrame) -> DataFrame:
    """Looked-up titles with the axes that split products: brand, combo (a bare word before a combo word before a feeder), kit."""
    return found.withColumnRenamed("brand", "said_brand").withColumnRenamed("brand_id", "brand").withColumns({"combo": _combo(title_rules(F.col("title")), F.col("feeder")), "kit": kit_form(F.col("title"))})


def generic_core(title: Column) -> Column:
    """The first word of letters and digits, else the first word before a number with the number; and the variant words."""
    words = F.split(fold(title), " ")
    mixed = F.get(F.filter(words, lambda w: w.rlike("[a-z]") & w.rlike("[0-9]")), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.when(a.rlike("^[a-z]+$") & b.rlike("^[0-9]+$"), F.concat(a, F.lit(" "), b)))
    pair = F.get(F.filter(pairs, lambda p: p.isNotNull()), F.lit(0))
    variants = F.array_join(F.array_sort(F.array_intersect(words, F.array(*[F.lit(v) for v in VARIANTS]))), " ")
    return F.trim(F.concat_ws(" ", F.coalesce(mixed, pair, F.lit("")), variants))


def generic_core_sql(title: str) -> str:
    words = f"string_split({fold_sql(title)}, ' ')"
    mixed = f"list_filter({words}, lambda w: regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]'))[1]"
    pair = f"nullif(regexp_extract(' ' || {fold_sql(title)} || ' ', ' ([a-z]+ [0-9]+) ', 1), '')"
    known = "[" + ", ".join(f"'{v}'" for v in sorted(VARIANTS)) + "]"
    variants = f"array_to_string(list_filter({known}, lambda v: list_contains({words}, v)), ' ')"
    return f"trim(coalesce({mixed}, {pair}, '') || ' ' || {variants})"


def aisle(title: Column, kind: Column) -> Column:
    """Where a product stands: filament by its polymer; dryers and feeders apart from machines."""
    t = F.regexp_replace(lower_tr(title), "[^a-z0-9]+", " ")
    feeder = t.rlike(rf"\b({FEEDER})\b") & ~t.rlike(rf"({MACHINE})")
    return F.when(kind == "filament", F.concat(F.lit("filament/"), classify(title)["polymer"])).when(t.rlike(rf"({DRYER})"), "dryer").when(feeder, "feeder").otherwise("fdm")


def aisle_sql(title: str, kind: str) -> str:
    from shelfwise.functions.filament import polymer_sql

    t = f"regexp_replace({lower_tr_sql(title)}, '[^a-z0-9]+', ' ', 'g')"
    return f"CASE WHEN {kind} = 'filament' THEN 'filament/' || {polymer_sql(title)} WHEN regexp_matches({t}, '({DRYER})') THEN 'dryer' WHEN regexp_matches({t}, '\\b({FEEDER})\\b') AND NOT regexp_matches({t}, '({MACHINE})') THEN 'feeder' ELSE 'fdm' END"


def match_key() -> Column:
    """Of looked-up titles: brand, colour and weight of filament; brand, model, pack and a pack's feeder of machines."""
    empty = F.lit("")
    brand, feeder = F.coalesce("brand", empty), F.when((F.col("combo") == "combo") & F.col("feeder").isNotNull(), F.col("feeder"))
    filament = F.concat_ws("|", brand, color_of(F.col("title")), grams(F.col("title")))
    return F.when(F.col("kind") == "filament", filament).otherwise(F.concat_ws("|", brand, F.coalesce("model", empty), "combo", feeder))


def is_like(title: Column) -> Column:
    """Words that say that a listing is for, or like, a product."""
    return F.regexp_replace(lower_tr(title), "[^a-z0-9]+", " ").rlike(rf"\b({LIKE_IT})\b")


def like_sql(title: str) -> str:
    return f"regexp_matches(regexp_replace({lower_tr_sql(title)}, '[^a-z0-9]+', ' ', 'g'), '\\b({LIKE_IT})\\b')"


def baseline_rows(dictionary: DataFrame) -> DataFrame:
    """row_brand, row_model, row_combo, source and identity: each model bare and as a pack; models of a
    single word are known from trackers only."""
    models = dictionary.where("role = 'model'").select(F.col("of").alias("row_brand"), F.col("id").alias("row_model"), F.explode(F.array(F.lit("bare"), F.lit("combo"))).alias("row_combo"))
    return models.withColumns({"source": F.when(F.col("row_model").contains("-"), "official").otherwise("tracker"), "identity": F.concat_ws("/", "row_brand", "row_model", "row_combo")})


def verdicts(titles: DataFrame, rows: DataFrame) -> DataFrame:
    """titles with status and identity: unknown (like a product, no brand, no model), hold (the best row
    conflicts, or another fits as well), match. Rows with fewest conflicts first, then by source."""
    named = titles.join(rows, (F.col("row_brand") == F.col("brand")) & (F.col("row_model") == F.col("model")), "left")
    order = Window.partitionBy("id").orderBy("n", "source", "identity")
    ranked = named.withColumn("n", (F.col("combo") != F.col("row_combo")).cast("int")).withColumns({"next_n": F.lead("n").over(order), "rank": F.row_number().over(order)}).where("rank = 1")
    known = ~is_like(F.col("title")) & F.col("brand").isNotNull() & F.col("model").isNotNull()
    contested = F.coalesce(F.col("next_n") == F.col("n"), F.lit(False))
    status = F.when(~known, "unknown").when((F.col("n") > 0) | contested, "hold").otherwise("match")
    return ranked.withColumns({"status": status, "identity": F.when(~is_like(F.col("title")) & F.col("model").isNotNull(), F.col("identity"))})


def allowed(titles: DataFrame, rows: DataFrame, most: int = ALLOWED) -> DataFrame:
    """id and allowed: the identities of a title's brand, those of its model and pack first."""
    score = F.coalesce((F.col("row_model") == F.col("model")).cast("int") * 2 + (F.col("row_combo") == F.col("combo")).cast("int"), F.lit(0))
    pool = titles.join(rows, F.col("row_brand") == F.col("brand")).select("id", "identity", score.alias("score"))
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "identity"))).where(F.col("rank") <= most)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "identity"))), lambda x: x["identity"])
    return ranked.groupBy("id").agg(F.array_join(names, " ").alias("allowed"))
