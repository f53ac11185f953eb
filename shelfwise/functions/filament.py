"""What a filament's title says: polymer, subtype, colour, weight, diameter, packaging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.identity import color_of, diameter_of, grams, packaging_of
from shelfwise.functions.text import lower_tr, lower_tr_sql, phrase

#: Polymers in the order of trial, and words that name each; # is a number, a space may be any gap.
POLYMERS = {
    "peba": ("peba",), "plabs": ("pla abs", "plabs"), "petg": ("pet g",), "peek": ("peek",), "pekk": ("pekk", "poek"), "pek": ("pek",), "pps": ("pps",), "ppa": ("ppa",),
    "pa": ("pa", "pa cf", "pa #", "naylon", "nylon"), "pc": ("pc", "pc cf", "polycarbonate", "polikarbonat", "polikarbon"), "asa": ("asa",), "abs": ("abs",), "tpu": ("tpu", "tpe"), "pva": ("pva",), "hips": ("hips",), "pet": ("pet",), "pla": ("pla",), "pp": ("pp",),
}
#: Kinds of a polymer in the order of trial, and words that name each.
SUBTYPES = {
    "combo": ("combo", "pack", "seti"), "cf": ("cf", "carbon fiber", "karbon"), "gf": ("gf", "glass fiber", "cam elyaf"), "glow": ("glow", "phosphorescent", "phosphor", "twinkling", "glitter", "sparkle"), "marble": ("marble", "mermer"), "wood": ("wood", "ahsap"), "tough": ("tough",), "semiflex": ("semi flex",),
    "rainbow": ("rainbow", "gradient", "granient", "mystic", "dual renk", "# renk"), "silk": ("silk", "ipek"), "plus": ("plus", "pla +", "petg +", "abs +"), "rapid": ("rapid", "hyper", "high speed", "high flow", "hf", "hs"), "pure": ("pure",), "matte": ("matte", "mat"), "basic": ("basic",),
}


def _rules(names: dict[str, tuple[str, ...]]) -> tuple[tuple[str, str], ...]:
    return tuple((name, "|".join(phrase(w, r"[\s-]*").replace("\\#", "[0-9]+") for w in words)) for name, words in names.items())


_POLYMERS, _SUBTYPES = _rules(POLYMERS), _rules(SUBTYPES)


def _first(text: Column, rules, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, words in reversed(rules):
        out = F.when(text.rlike(rf"(^|[^a-z0-9])({words})($|[^a-z0-9])"), name).otherwise(out)
    return out


def _first_sql(text: str, rules, otherwise: str) -> str:
    return "CASE" + "".join(f" WHEN regexp_matches({text}, '(^|[^a-z0-9])({words})($|[^a-z0-9])') THEN '{name}'" for name, words in rules) + f" ELSE '{otherwise}' END"


def polymer_sql(x: str) -> str:
    return _first_sql(lower_tr_sql(x), _POLYMERS, "other")


def subtype_sql(x: str) -> str:
    return _first_sql(lower_tr_sql(x), _SUBTYPES, "standard")


def classify(title: Column) -> Column:
    """struct(polymer, subtype, color, weight, diameter, packaging, family); diameter is 175 unless said."""
    low = lower_tr(title)
    polymer, subtype = _first(low, _POLYMERS, "other"), _first(low, _SUBTYPES, "standard")
    said = diameter_of(title)
    return F.struct(polymer.alias("polymer"), subtype.alias("subtype"), color_of(title).alias("color"), grams(title).alias("weight"), F.when(said == "", "175").otherwise(said).alias("diameter"), packaging_of(title).alias("packaging"), F.concat_ws("|", polymer, subtype).alias("family"))
