"""The product dictionary: brands, models and feeders, and every way to name them.

A small table of aliases; a model's id is its words joined by dashes, so the tables below hold words
alone and the dictionary is built from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Brands and their names (the first is what a brand is called here).
BRANDS = {
    "bambu": "bambu, bambu lab, bambulab, bbl", "creality": "creality, creality3d, creality 3d", "anycubic": "anycubic, any cubic", "elegoo": "elegoo", "flashforge": "flashforge, flash forge, ff",
    "snapmaker": "snapmaker, snap maker", "prusa": "prusa, prusa research, original prusa", "qidi": "qidi, qidi tech", "flsun": "flsun", "sovol": "sovol, sovol3d", "artillery": "artillery, artillery3d",
    "voron": "voron, voron design", "wanhao": "wanhao", "twotrees": "twotrees, two trees, two trees 3d", "kingroon": "kingroon", "zaxe": "zaxe", "raise3d": "raise3d, raise 3d, raise", "ultimaker": "ultimaker",
    "bcn3d": "bcn3d, bcn 3d", "formlabs": "formlabs, form labs", "phrozen": "phrozen", "xtool": "xtool, x tool", "atomstack": "atomstack, atom stack", "iemai": "iemai", "creality_falcon": "falcon, creality falcon", "esun": "esun",
}
#: Model families of each brand. What stands in brackets are further words of the family, each a model of its own;
#: "*" before a family: the bare name is no model.
MODELS = {
    "bambu": "a1 (mini), a2l, p1p, p1s, p2s, x1, x1c, x2d, h2s, h2d, h2c",
    "creality": "k2 (plus, pro, se), k1 (max, se), k1c, ender 3 (v3, v3 se), ender 5 max, sparkx i7, hi, cr 10, *falcon (a1, a1 pro, a1c, t1), falcon2 (pro, pro s)",
    "anycubic": "kobra 2 (max), kobra 3 (max, v2), kobra 4, kobra s1 (max), *kobra (x, go), vyper, photon mono m7 (pro), photon mono 4 (ultra), photon p1 (max), wash cure 3 (plus, max)",
    "elegoo": "centauri carbon (2), centauri 2, neptune 3 (pro), neptune 4 (pro, plus, max), mars 4 (ultra), mars 5 (ultra), saturn 3 (ultra), saturn 4 (ultra, ultra 16k), jupiter 2, *mercury (plus, xs)",
    "flashforge": "ad5x, adventurer 3, adventurer 4, adventurer 5m (pro), adventurer 5x, creator 4, creator 5 (pro), creator pro 2, guider",
    "snapmaker": "artisan, u1, j1, j1s, ray",
    "prusa": "core one (l), xl, mk4s, mk3s, mini, sl1s, ht90",
    "qidi": "q2, q2c, plus4, plus5, max4, x max 3, x plus 3",
    "flsun": "t1 (pro, max), s1 (pro), v400 (max)",
    "sovol": "sv04, sv06 (plus, ace, plus ace), sv07 (plus), sv08 (max), zero",
    "artillery": "m1 (pro, pro s1), *sidewinder (x4, x4 pro, x4 plus), genius",
    "voron": "0 2, 2 4, trident, switchwire",
    "twotrees": "sk1, blu 3, blu 5, *sapphire (pro, plus), sp 5, bluer, ttc3018, ttc450, ttc6050",
    "kingroon": "kp3s (pro, pro v2), klp1",
    "zaxe": "x4, z1, z2, z3, z3s",
    "raise3d": "pro3 (hs), e3, rmf500, df2 (plus), rms220",
    "ultimaker": "factor 4, s7, s8, method (x, xl)",
    "bcn3d": "*epsilon (w27, w50), sigma d25, omega i60",
    "formlabs": "form 3, form 3b, form 3bl, form 3l, form 4, form 4b, form 4bl, form 4l, fuse 1",
    "phrozen": "sonic mighty revo, sonic mega 8k (v2), sonic mini 8k, arco",
    "xtool": "f1 (ultra), p2, p2s, p3, s1, m1 (ultra)",
    "atomstack": "a20 pro, a40 pro, s20 pro, x20 pro, x30 pro",
    "iemai": "magic ht max, fast jet 1500, *ym nt (750, 1000, 1200)",
}
#: Names of models that are not their words, brand by brand.
OTHER_MODELS = {
    "bambu": "a1mini = a1-mini, p1s carbon = p1s, x1 carbon = x1c", "creality": "k1c 2025 = k1c, hi combo = hi", "elegoo": "orangestorm = orangestorm-giga", "flashforge": "adventurer 5x combo = adventurer-5x",
    "snapmaker": "snapmaker 2 0 a150 = snapmaker-2-a150, snapmaker 2 0 a250 = snapmaker-2-a250, snapmaker 2 0 a350 = snapmaker-2-a350, a150 = snapmaker-2-a150, a250 = snapmaker-2-a250, a350 = snapmaker-2-a350",
    "artillery": "sidewinder = sidewinder-x2", "formlabs": "fuse = fuse-1",
}
#: Feeders of each brand, and their names that are not their words.
FEEDERS = {"bambu": "ams (lite, ht, 2 pro)", "creality": "cfs (c, 2, 4)", "anycubic": "*ace (pro, 2 pro)", "elegoo": "canvas", "flashforge": "ifs", "qidi": "qidi box", "prusa": "mmu3, indx", "ultimaker": "material station"}
OTHER_FEEDERS = {"qidi": "box = qidi-box", "prusa": "mmu = mmu3, indx 8 tool = indx"}


def _families(text: str) -> list[str]:
    """The names of "k2 (plus, pro), *kobra (x)": k2, k2 plus, k2 pro, kobra x."""
    out, depth, part = [], 0, ""
    for c in text + ",":
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            stem, _, more = part.strip().rstrip(")").partition("(")
            stem = stem.strip()
            out += [] if stem.startswith("*") else [stem]
            out += [f"{stem.lstrip('*')} {w.strip()}" for w in more.split(",") if w.strip()]
            part = ""
        else:
            part += c
    return out


def _aliases() -> tuple[tuple[str, str, str, str], ...]:
    """(alias, role, id, brand) of every name."""
    out = [(a.strip(), "brand", brand, brand) for brand, names in BRANDS.items() for a in names.split(",")]
    for role, plain, other in (("model", MODELS, OTHER_MODELS), ("feeder", FEEDERS, OTHER_FEEDERS)):
        out += [(name, role, name.replace(" ", "-"), brand) for brand, text in plain.items() for name in _families(text)]
        out += [(name.strip(), role, id_.strip(), brand) for brand, text in other.items() for name, id_ in (x.split("=") for x in text.split(","))]
    return tuple(out)


ALIASES = _aliases()
#: Words of the longest alias.
LONGEST = max(len(a[0].split()) for a in ALIASES)


def dictionary(spark: SparkSession) -> DataFrame:
    """The names as values of the plan: of rows made in Python Spark knows no size, takes them for the larger side of a join and sends the other one whole."""
    rows = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in ALIASES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS names(alias, role, id, `of`)")


DICTIONARY = "dict(alias, role, id, brand_id) AS (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in ALIASES) + ")"
