"""The whole identity of a listing: all axes, the conflicts of two listings, and the stable id.

What needs the dictionary (brand, models, feeder) is read in one pass of Arrow batches through tries of
words; everything else is expressions on folded titles, each made once for a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelfwise.functions.filament import classify
from shelfwise.functions.identity import COLORS, color_of, diameter_of, grams, laser_watts, packaging_of
from shelfwise.functions.text import fold, once, phrase, title_rules, variant_tag
from shelfwise.operators.scans import MOST_PHRASES, Trie, consume
from shelfwise.sources.dictionary import ALIASES

#: The feeder that a brand's pack has if it names none.
DEFAULT_FEEDER = {"bambu": "ams", "creality": "cfs", "anycubic": "ace-pro", "elegoo": "canvas", "flashforge": "ifs", "qidi": "qidi-box", "prusa": "mmu3"}
#: Folded words for a pack with its feeder and without it, for technologies, forms of kits and gifts.
COMBO, BARE = ("combo", "unite li", "multicolor", "cok renkli"), ("ams siz", "amsiz", "bare", "without ams", "feederless")
CNC, LASER = ("cnc", "ttc3018", "ttc450", "ttc6050"), ("laser", "lazer", "falcon", "engraver", "atomstack", "xtool", "diode", "co2")
RESIN, RESIN_BRANDS = ("resin", "recine", "sla", "dlp", "lcd", "photon", "mars", "saturn", "jupiter", "halot", "form 3", "form 4", "fuse", "sonic"), ("formlabs", "phrozen", "bcn3d")
GIFT, MACHINE = ("hediyeli", "hediye", "ucretsiz", "free"), ("edition", "full combo")
KIT, ASSEMBLED = ("assembly kit", "kit topla", "toplama kiti", "montajsiz", "unassembled", "diy", "klon", "clone"), ("assembled", "preassembled", "montajli", "kurulu")
#: Sizes that are a machine's, models that many makers have, generations of a feeder, words that are no model.
SIZES, GENERIC, AMS = ("250", "300", "350"), ("i3", "i3-mega", "mega", "ender-3", "prusa-i3", "clone", "diy", "a1", "k2"), ("2", "ht", "lite", "pro")
NOISE = (
    "buffer buffered with hediyeli hediye kampanya indirim indirimli firsat outlet teshir 16 renge renk cok renkli super hizli kapali govde kargo ucretsiz bedava 3d yazici printer "
    "filamentli set yeni new enhanced exclusive vip refurbished yenilenmis ikinci el sifir orijinal resmi garantili garanti distributor ithalatci turkiye stoktan teslim mm cm adet kutu sok taksit fatura"
).split()
#: Variants that a model made of a title's own words may have.
OWN_VARIANTS = ("pro", "plus", "max", "mini", "ultra", "se", "lite")

FOUND = "title_brand string, brand_id string, brand_alias string, model string, url_model string, feeder string, cores array<string>"
AXES = (
    "kind brand brand_id polymer variant color weight diameter packaging combo combo_axis variant_tag ams mini laser_w model_core model_cores title_incomplete url_model_core size_tier feeder_gen feeder_named technology kit_form laser_watts generic_core"
).split()


def _has(folded: Column, words: tuple[str, ...]) -> Column:
    """Whether any of some phrases stands in folded text as words of its own."""
    return F.concat(F.lit(" "), folded, F.lit(" ")).rlike("|".join(f" {phrase(w, ' ')} " for w in words))


class Names:
    """Tries of the dictionary, by role and brand."""

    def __init__(self, rows: list) -> None:
        parts: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for r in rows:
            parts.setdefault((r.role, "" if r.role == "brand" else r.of), []).append((r.alias, r.id))
        self.tries = {k: Trie(v) for k, v in parts.items()}

    def longest(self, role: str, brand: str, text: str | None) -> tuple[str, str] | None:
        """(alias, id) of the longest alias in a text, of equal ones the first by ASCII."""
        trie, words = self.tries.get((role, brand)), (text or "").split()
        found = {x for at in range(len(words)) for x in trie.find(words, at)} if trie else ()
        return min(found, key=lambda x: (-len(x[0]), x[0]), default=None)

    def read(self, title: str | None, brand: str | None, slug: str | None) -> dict:
        of_title, own, of_slug = (self.longest("brand", "", t) for t in (title, brand, slug))
        id_ = next((x[1] for x in (of_title, own, of_slug) if x), "")
        model = self.longest("model", id_, title)
        other = None if model else self.longest("model", id_, slug)
        said = f"{title or ''} {slug}" if other else title or ""
        trie = self.tries.get(("model", id_))
        cores = list(dict.fromkeys(i for _, i in consume(said.split(), trie))) if trie else []
        feeder = self.longest("feeder", id_, said)
        name = lambda x: x[1] if x else ""
        return {"title_brand": name(of_title), "brand_id": id_, "brand_alias": (of_title or ("", ""))[0], "model": name(model), "url_model": name(other), "feeder": name(feeder), "cores": cores}


def named(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows (row, title, brand, slug: folded) with found: what the dictionary knows of them."""
    known = dictionary.limit(MOST_PHRASES + 1).collect()
    if len(known) > MOST_PHRASES:
        raise ValueError(f"a dictionary of more than {MOST_PHRASES} names is not sent to tasks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(known)
        for batch in batches:
            of = [batch.column(c).to_pylist() for c in ("title", "brand", "slug")]
            found = [names.read(*x) for x in zip(*of, strict=True)]
            kind = pa.struct([(f.split()[0], pa.list_(pa.string()) if f.endswith("array<string>") else pa.string()) for f in FOUND.split(", ")])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "found"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("found", StructType.fromDDL(FOUND))]))


def own_core(folded: Column, brand_alias: Column) -> Column:
    """A model made of a title's own words, for makers that the dictionary lacks: letters with digits, else letters and a number; with its variant."""
    words = F.filter(F.split(folded, " "), lambda w: (w != "") & ~w.isin(*NOISE) & ~F.array_contains(F.split(brand_alias, " "), w) & ~w.rlike("^[0-9]+(mm|cm|w|kg|g|tl|adet)$"))

    def made(w: Column) -> Column:
        mixed = F.get(F.filter(w, lambda x: x.rlike("[a-z]") & x.rlike("[0-9]") & (F.length(x) > 1)), F.lit(0))
        pairs = F.filter(F.transform(w, lambda x, i: F.when(x.rlike("^[a-z]{2,5}$") & F.coalesce(F.get(w, i + 1).rlike("^[0-9]{1,4}$"), F.lit(False)), F.concat(x, F.lit("-"), F.get(w, i + 1)))), lambda p: p.isNotNull())
        core = F.coalesce(mixed, F.get(pairs, F.lit(0)))
        variant = F.get(F.filter(w, lambda x: x.isin(*OWN_VARIANTS)), F.lit(0))
        return F.coalesce(F.when(variant.isNotNull() & ~F.contains(core, variant), F.concat(core, F.lit("-"), variant)).otherwise(core), F.lit(""))

    return F.get(F.transform(F.array(words), made), F.lit(0))


def technology_of(folded: Column, brand_id: Column) -> Column:
    machine = _has(folded, LASER)
    gift = _has(folded, GIFT) & ~_has(folded, MACHINE)
    resin = _has(folded, RESIN) | (brand_id.isin(*RESIN_BRANDS) & ~_has(folded, ("fdm", "filament")))
    return F.when(_has(folded, CNC), "cnc").when(machine & ~gift, "laser").when(resin, "resin").otherwise("fdm")


def with_identity(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows with axes (struct of AXES; silence is empty text) and identity (the stable id).

    rows have name, kind and brand, and may have variant, polymer, color, weight, packaging and url. Nulls
    are silence. Titles of any length pass. A url counts only where its last part names a model of the brand and the title names none.
    """
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    own = [F.col(f"`{c}`") for c in rows.columns]
    title = F.trim(F.concat_ws(" ", has("name"), F.nullif(has("variant"), F.lit(""))))
    slug = F.url_decode(F.regexp_extract(has("url"), r"^(?:https?://[^/]+)?/*(?:[^?#]*/)?([^/?#]+)", 1))
    start = rows.select(F.struct(*own).alias("row"), fold(title).alias("title"), fold(has("brand")).alias("brand"), fold(slug).alias("slug"), title.alias("said"))
    f = F.col("found")
    read = named(start, dictionary).withColumn("enriched", F.when(f["url_model"] != "", F.concat_ws(" ", "said", "slug")).otherwise(F.col("said")))
    row = lambda c: F.coalesce(F.col("row")[c].cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    read = once(read, rules=title_rules(F.col("said")), folded=fold(F.col("enriched")), class_=classify(row("name")), more=title_rules(F.col("enriched")))
    n, t = F.col("rules"), F.col("folded")
    word = lambda c, w: c.rlike(rf"\b(?:{w})\b")
    is_filament = row("kind") == "filament"
    of_class = lambda field, none: F.when(is_filament & (F.col(f"class_.{field}") != none), F.col(f"class_.{field}")).otherwise("")
    said_or = lambda own_, other: F.when(own_ != "", own_).otherwise(other)
    first_word = F.get(F.split(fold(row("color")), " "), F.lit(0))
    color = F.when(first_word != "", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv]), first_word), first_word)).otherwise(color_of(row("name")))
    combo_word = _has(t, COMBO)
    axis = F.when(_has(t, BARE), "bare").when(combo_word | (f["feeder"] != ""), "combo").otherwise("")
    ams = F.regexp_extract(n, rf"\bams\s*({'|'.join(AMS)})\b", 1)
    feeder = F.when(f["feeder"] != "", f["feeder"]).when(combo_word, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_FEEDER.items() for x in kv]), f["brand_id"]), F.lit(""))).otherwise("")
    # feeders have names like variants of a machine ("AMS 2 Pro", "AMS Lite")
    names = sorted({a for a, role, _, _ in ALIASES if role == "feeder"} | {"ams pro", "ace"}, key=lambda a: (-len(a), a))
    alone = F.regexp_replace(n, rf"\b(?:{'|'.join(phrase(a, ' *') for a in names if a != 'ams')})\b", " ")
    core = said_or(said_or(f["model"], f["url_model"]), own_core(t, f["brand_alias"]))
    watts = F.regexp_extract(t, r"\b([0-9]{1,3}) *w\b", 1)
    any_watts = watts.rlike("[0-9]") | F.lower(row("name")).rlike("[0-9] *w")
    size = F.regexp_extract(t, rf"\b({'|'.join(SIZES)}) *(?:mm)?\b", 1)
    polymer, variant = fold(row("polymer")), fold(row("variant"))
    values = {
        "kind": row("kind"), "brand": said_or(F.when(F.col("brand") != "", f["brand_id"]).otherwise(""), said_or(f["title_brand"], F.col("brand"))), "brand_id": f["brand_id"],
        "polymer": F.when(~polymer.isin("", "other"), polymer).otherwise(of_class("polymer", "other")), "variant": F.when(~variant.isin("", "standard"), variant).otherwise(of_class("subtype", "standard")),
        "color": color, "weight": said_or(grams(row("weight")), grams(row("name"))), "diameter": diameter_of(row("name")),
        "packaging": said_or(packaging_of(row("name")), F.when(fold(row("packaging")).isin("refill", "spool"), fold(row("packaging"))).otherwise("")),
        "combo": word(n, "combo|ams") | (axis == "combo"), "combo_axis": said_or(axis, F.when(word(n, "combo|ams"), "combo").otherwise("bare")), "variant_tag": variant_tag(F.trim(F.regexp_replace(alone, " +", " "))),
        "ams": F.when(ams != "", F.concat(F.lit("ams "), ams)).otherwise(""), "mini": word(F.col("more"), "mini") | core.endswith("-mini"),
        "laser_w": said_or(laser_watts(F.col("enriched")), F.when(F.col("more").rlike("lazer|laser"), "laser").otherwise("")),
        "model_core": core, "model_cores": f["cores"], "title_incomplete": ~row("kind").isin("filament", "resin") & (f["brand_id"] != "") & (f["model"] == ""), "url_model_core": f["url_model"],
        "size_tier": size, "feeder_gen": said_or(feeder, F.when(ams != "", F.concat(F.lit("ams "), ams)).otherwise("")), "feeder_named": f["feeder"] != "",
        "technology": F.when(any_watts, "laser").otherwise(technology_of(t, f["brand_id"])), "kit_form": F.when(_has(t, KIT), "kit").when(_has(t, ASSEMBLED), "assembled").otherwise(""),
        "laser_watts": watts, "generic_core": (f["brand_id"] == "") & core.isin(*GENERIC),
    }
    axes = read.select("row", F.inline(F.array(F.struct(F.struct(*[values[a].alias(a) for a in AXES]).alias("axes")))))
    return axes.select("row.*", "axes", identity_id(F.col("axes")).alias("identity"))


def identity_id(a: Column) -> Column:
    """brand/model and what sets it apart, in a fixed order; an unlisted maker is unknown, so that two shops can agree on its machine."""
    some = lambda c, before="", after="": F.when(c != "", F.concat(F.lit(before), c, F.lit(after)))
    return F.concat_ws(
        "/", F.when(a["brand_id"] != "", a["brand_id"]).otherwise("unknown"), F.when(a["model_core"] != "", a["model_core"]).otherwise("unnamed"), some(a["size_tier"], "size-"), F.when(a["combo_axis"] == "combo", "combo").otherwise("bare"), some(a["feeder_gen"]),
        some(a["laser_watts"], "laser-", "w"), some(a["kit_form"]), F.when(~a["technology"].isin("", "fdm"), a["technology"]), some(F.replace(a["variant_tag"], F.lit(" "), F.lit("-"))), F.when(a["mini"], "mini"),
    )


def all_conflicts(a: Column, b: Column) -> Column:
    """Names of everything on which two listings' axes differ; what one side does not say is no difference, but for machines' models, packs and variants."""
    both = lambda x: (a[x] != "") & (b[x] != "") & (a[x] != b[x])
    modelled = [o for o in {of for _, role, _, of in ALIASES if role == "model"}]
    strict = lambda s: (s["kind"] == "printer") | (~s["kind"].isin("filament", "resin") & s["brand_id"].isin(*sorted(modelled)))
    exact = strict(a) | strict(b)
    cores = (a["model_core"] != b["model_core"]) & F.when(exact, (a["model_core"] != "") | (b["model_core"] != "")).otherwise((a["model_core"] != "") & (b["model_core"] != ""))
    sets = exact & (a["brand_id"] != "") & (a["brand_id"] == b["brand_id"]) & ((F.size(F.array_except(a["model_cores"], b["model_cores"])) > 0) | (F.size(F.array_except(b["model_cores"], a["model_cores"])) > 0))
    tests = [
        *[(x, both(x)) for x in ("kind", "polymer")], ("variant", both("variant") | (a["variant_tag"] != b["variant_tag"])), *[(x, both(x)) for x in ("color", "weight", "diameter", "packaging")],
        ("combo", a["combo"] != b["combo"]), ("mini", a["mini"] != b["mini"]), ("laser", (a["laser_w"] != b["laser_w"]) & F.concat(a["laser_w"], b["laser_w"]).rlike("[0-9]")), ("model", cores | sets),
        ("feeder", both("feeder_gen")), ("kit", both("kit_form")), ("technology", both("technology")), ("size", both("size_tier")), ("unknown-brand", a["generic_core"] & b["generic_core"] & (a["brand"] != b["brand"])),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda x: x.isNotNull())


def all_gaps(a: Column, b: Column) -> Column:
    """What only one of two listings that are no machines says."""
    keys = ("color", "weight", "diameter", "packaging", "polymer", "variant")
    found = F.filter(F.array(*[F.when((a[x] == "") != (b[x] == ""), F.lit(x)) for x in keys]), lambda x: x.isNotNull())
    return F.when((a["kind"] == "printer") | (b["kind"] == "printer"), F.array().cast("array<string>")).otherwise(found)
