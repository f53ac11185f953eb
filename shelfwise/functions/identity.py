"""Axes of a product's identity, read from titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import fold, fold_sql, let, lower_tr, lower_tr_sql, once, title_rules, title_rules_sql

#: Colour words of two languages and the colour they name.
COLORS = {
    "siyah": "black", "black": "black", "beyaz": "white", "white": "white", "gri": "gray", "grey": "gray", "gray": "gray",
    "kirmizi": "red", "red": "red", "mavi": "blue", "blue": "blue", "yesil": "green", "green": "green", "turuncu": "orange", "orange": "orange",
    "sari": "yellow", "yellow": "yellow", "mor": "purple", "purple": "purple", "pembe": "pink", "pink": "pink", "altin": "gold", "gold": "gold",
    "gumus": "silver", "silver": "silver", "bej": "beige", "beige": "beige", "kahve": "brown", "brown": "brown", "nature": "natural", "natural": "natural",
}
#: Words that say a listing only resembles a product, parts of one, and spares.
LIKE_IT = "tarzi|benzer|muadil|alternatif|replacement for|for use with"
PARTS = "nozzle|nozul|hotend|hot end|extruder|bowden|plaka|plate|kabin|enclosure|tabla|termistor|thermistor|kayis|filtre"
SPARE = "yedek|spare|icin|for"
#: Words near a wattage that is not a laser's.
POWER = "adaptor|guc|kaynagi|psu|power|supply|isitici|heater|tabla|bed"
#: Kinds of product and the folded words that name them, tried in this order.
KINDS = (("scanner", "scanner|tarayici"), ("resin", "resin|recine"), ("filament", "filament|pla|petg|abs|tpu|asa"), ("accessory", "nozzle|nozul|plate|plaka|kurutucu|dryer|enclosure"), ("printer", "printer|yazici"))


def _ruled(title: Column, body, rules: Column | None = None) -> Column:
    """body of a title by its rules, which take long and are made once; rules: the same, if they are known."""
    return let(title_rules(title), body) if rules is None else body(rules)


def color_of(title: Column, rules: Column | None = None) -> Column:
    """The colour that the last colour word of a title names, else empty."""
    table = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])
    found = F.filter(F.transform(F.split(title_rules(title) if rules is None else rules, " "), lambda w: table[w]), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def color_of_sql(x: str) -> str:
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in COLORS.items()) + "}"
    return f"coalesce(list_filter(list_transform(string_split({title_rules_sql(x)}, ' '), lambda w: {table}[w]), lambda c: c IS NOT NULL)[-1], '')"


def _swatch_words() -> list[tuple[str, str]]:
    return [(c, "|".join(w for w, to in COLORS.items() if to == c)) for c in dict.fromkeys(COLORS.values())]


def swatches(title: Column) -> Column:
    """All colours that a title names, in the order of the table."""
    named = lambda t: F.array(*[F.when(t.rlike(rf"\b({words})\b"), c) for c, words in _swatch_words()])
    return F.filter(_ruled(title, named), lambda c: c.isNotNull())


def swatches_sql(x: str) -> list[str]:
    t = title_rules_sql(x)
    return [f"CASE WHEN regexp_matches({t}, '\\b({words})\\b') THEN '{c}' END" for c, words in _swatch_words()]


def grams(text: Column) -> Column:
    """A weight in grams as text, else empty."""
    part = lambda t, g: F.regexp_extract(t, r"(\d+) ?(kg|gr|g)\b", g)
    said = lambda t: let(part(t, 1), lambda n: F.when(n == "", "").otherwise((n.try_cast("long") * F.when(part(t, 2) == "kg", 1000).otherwise(1)).cast("string")))
    return let(fold(text), said)


def grams_sql(x: str) -> str:
    t = fold_sql(x)
    return f"CASE WHEN regexp_extract({t}, '(\\d+) ?(kg|gr|g)\\b', 1) = '' THEN '' ELSE (regexp_extract({t}, '(\\d+) ?(kg|gr|g)\\b', 1)::bigint * CASE WHEN regexp_extract({t}, '(\\d+) ?(kg|gr|g)\\b', 2) = 'kg' THEN 1000 ELSE 1 END)::varchar END"


def diameter_of(title: Column, rules: Column | None = None) -> Column:
    return F.regexp_extract(title_rules(title) if rules is None else rules, r"\b(175|285|300)mm\b", 1)


def packaging_of(title: Column, rules: Column | None = None) -> Column:
    return _ruled(title, lambda t: F.when(t.rlike(r"\brefill\b"), "refill").when(t.rlike(r"\bspool\b"), "spool").otherwise(""), rules)


def is_lookalike(title: Column) -> Column:
    """Something like the product, or a spare part for it."""
    said = lambda t: t.rlike(rf"\b({LIKE_IT})\b") | (t.rlike(rf"\b({PARTS})\b") & t.rlike(rf"\b({SPARE})\b"))
    return let(F.regexp_replace(lower_tr(title), "[^a-z0-9]+", " "), said)


def is_lookalike_sql(x: str) -> str:
    t = f"regexp_replace({lower_tr_sql(x)}, '[^a-z0-9]+', ' ', 'g')"
    return f"(regexp_matches({t}, '\\b({LIKE_IT})\\b') OR (regexp_matches({t}, '\\b({PARTS})\\b') AND regexp_matches({t}, '\\b({SPARE})\\b')))"


def laser_watts(title: Column) -> Column:
    """A laser module's wattage: 1 to 80, no power word within two words of it; else empty."""
    parts = lambda t, g: F.regexp_extract(t, r"^(.*?)(\d+) *(?:watt|w)(.*)$", g)
    around = lambda t: F.concat_ws(" ", F.array_join(F.slice(F.reverse(F.split(F.trim(parts(t, 1)), " +")), 1, 2), " "), F.array_join(F.slice(F.split(F.trim(parts(t, 3)), " +"), 1, 2), " "))
    said = lambda t: let(parts(t, 2), lambda watts: F.when((watts != "") & watts.try_cast("int").between(1, 80) & ~around(t).rlike(POWER), watts).otherwise(""))
    return let(lower_tr(title), said)


def laser_watts_sql(x: str) -> str:
    part = lambda g: f"regexp_extract({lower_tr_sql(x)}, '^(.*?)([0-9]+) *(?:watt|w)(.*)$', {g})"
    near = lambda g, place: f"array_to_string(string_split_regex(trim({part(g)}), ' +')[{place}], ' ')"
    return f"CASE WHEN {part(2)} <> '' AND try_cast({part(2)} AS int) BETWEEN 1 AND 80 AND NOT regexp_matches({near(1, '-2:')} || ' ' || {near(3, '1:2')}, '{POWER}') THEN {part(2)} ELSE '' END"


def product_type(title: Column) -> Column:
    def named(t: Column) -> Column:
        out = F.lit("other")
        for kind, names in reversed(KINDS):
            out = F.when(t.rlike(rf"\b({names})\b"), kind).otherwise(out)
        return out

    return _ruled(title, named)


def product_type_sql(x: str) -> str:
    t = title_rules_sql(x)
    return "CASE" + "".join(f" WHEN regexp_matches({t}, '\\b({names})\\b') THEN '{kind}'" for kind, names in KINDS) + " ELSE 'other' END"


def kit_form(title: Column, rules: Column | None = None) -> Column:
    return _ruled(title, lambda t: F.when(t.rlike(r"\b(assembled|montajli|hazir)\b"), "assembled").when(t.rlike(r"\b(kit|unassembled|kendin kur)\b"), "kit").otherwise(""), rules)


def technology(title: Column, rules: Column | None = None) -> Column:
    said = lambda t: F.when(t.rlike(r"\bcnc\b"), "cnc").when(t.rlike(r"\b(laser|lazer)\b") & ~t.rlike("hediye"), "laser").when(t.rlike(r"\b(resin|recine|sla|msla|dlp)\b"), "resin").otherwise("fdm")
    return _ruled(title, said, rules)


def kit_form_sql(x: str) -> str:
    t = title_rules_sql(x)
    return f"CASE WHEN regexp_matches({t}, '\\b(assembled|montajli|hazir)\\b') THEN 'assembled' WHEN regexp_matches({t}, '\\b(kit|unassembled|kendin kur)\\b') THEN 'kit' ELSE '' END"


def technology_sql(x: str) -> str:
    t = title_rules_sql(x)
    return f"CASE WHEN regexp_matches({t}, '\\bcnc\\b') THEN 'cnc' WHEN regexp_matches({t}, '\\b(laser|lazer)\\b') AND NOT regexp_matches({t}, 'hediye') THEN 'laser' WHEN regexp_matches({t}, '\\b(resin|recine|sla|msla|dlp)\\b') THEN 'resin' ELSE 'fdm' END"


def packaging_of_sql(x: str) -> str:
    t = title_rules_sql(x)
    return f"CASE WHEN regexp_matches({t}, '\\brefill\\b') THEN 'refill' WHEN regexp_matches({t}, '\\bspool\\b') THEN 'spool' ELSE '' END"


#: Axes on which two products of a kind must agree; the first four may be silent on one side.
AXES = ("kind", "color", "weight", "diameter", "packaging", "combo", "mini", "variant_tag", "laser", "kit", "technology")


def axes(name: Column, kind: Column) -> Column:
    """The axes of a title as a struct; silence is empty text."""
    from shelfwise.functions.text import variant_tag

    made = lambda t: F.struct(
        F.coalesce(kind, F.lit("")).alias("kind"), color_of(name, t).alias("color"), grams(name).alias("weight"), diameter_of(name, t).alias("diameter"), packaging_of(name, t).alias("packaging"),
        (t.rlike(r"\b(combo|ams)\b")).cast("string").alias("combo"), t.rlike(r"\bmini\b").cast("string").alias("mini"), variant_tag(t).alias("variant_tag"),
        laser_watts(name).alias("laser"), kit_form(name, t).alias("kit"), technology(name, t).alias("technology"),
    )
    return _ruled(name, made)


#: Axes that conflict even when one side says nothing.
STRICT = ("combo", "mini", "variant_tag", "laser")


def conflicts(a: Column, b: Column) -> Column:
    """Names of the axes on which two products differ: silence is no difference but on STRICT ones."""
    tests = [F.when((a[x] != b[x]) & (F.lit(x in STRICT) | ((a[x] != "") & (b[x] != ""))), F.lit(x)) for x in AXES]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def gaps(a: Column, b: Column) -> Column:
    """Axes that only one of two products that are no printers states."""
    keys = ("color", "weight", "diameter", "packaging")
    found = F.filter(F.array(*[F.when((a[x] == "") != (b[x] == ""), F.lit(x)) for x in keys]), lambda x: x.isNotNull())
    return F.when((a["kind"] == "printer") | (b["kind"] == "printer"), F.array().cast("array<string>")).otherwise(found)


def features(name: Column, kind: Column, brand: Column) -> Column:
    """What a decision needs of one row: to be made once for each row and before any join."""
    from shelfwise.functions.similarity import title_words

    return F.struct(axes(name, kind).alias("axes"), title_words(name).alias("words"), is_lookalike(name).alias("lookalike"), fold(brand).alias("brand"))


def decide(a: Column, b: Column) -> Column:
    """struct(action, reason, score) of two rows' features: merge, review or create, the first rule that fits."""
    from shelfwise.functions.similarity import words_score, words_subset

    return let(words_score(a["words"], b["words"]), lambda score: _decided(a, b, score, words_subset))


def _decided(a: Column, b: Column, score: Column, words_subset) -> Column:
    x, y = a["axes"], b["axes"]
    printer = (x["kind"] == "printer") | (y["kind"] == "printer")
    brand = (a["brand"] != "") & (a["brand"] == b["brand"])
    same = (a["words"]["rules"] != "") & (a["words"]["rules"] == b["words"]["rules"])
    rules = (
        (a["lookalike"] != b["lookalike"], "create", "lookalike"),
        (F.size(conflicts(x, y)) > 0, "create", "conflict"),
        (F.size(gaps(x, y)) > 0, "review", "gap"),
        (same, "merge", "same title"),
        (printer & words_subset(a["words"], b["words"]), "merge", "subset"),
        (score >= 0.75, "merge", "alike"),
        (~printer & (score >= 0.55) & brand, "merge", "alike, same brand"),
        (printer & (score >= 0.55) & brand, "review", "gray"),
        (score >= 0.6, "review", "uncertain"),
    )
    verdict = F.struct(F.lit("create").alias("action"), F.lit("no match").alias("reason"))
    for test, what, why in reversed(rules):
        verdict = F.when(test, F.struct(F.lit(what).alias("action"), F.lit(why).alias("reason"))).otherwise(verdict)
    return F.struct(verdict.alias("v"), score.alias("score"))


def decided(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with action, reason and score for the features in columns a and b."""
    out = once(pairs, _d=decide(F.col(a), F.col(b)))
    return out.withColumns({"action": F.col("_d.v.action"), "reason": F.col("_d.v.reason"), "score": F.col("_d.score")}).drop("_d", a, b)
