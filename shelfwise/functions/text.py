"""Folds, title rules and tokens, each as a Column builder and as the same SQL text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turkish letters and their plain forms after lowering.
TR_FROM, TR_TO = "ışçğüö", "iscguo"
#: Accented letters and plain forms of the locale fold.
ACCENT_FROM, ACCENT_TO = "âîûéèêáàäíóúñãõëïìòùôýå", "aiueeeaaaiounaoeiiouoya"
#: Words that say which model of a family a printer is.
VARIANTS = "plus pro max ultra lite neo turbo se ke xl".split()
#: Words that do not identify a product.
STOP = (
    "3d printer yazici filament fiyat inceleme stoktan car vehicle urun product cihaz model vs ve ile the and for of with makine fdm "
    "yeni new versiyon version outlet bundle buffer buffered hediyeli indirimli kampanya super hizli kapali govde kadar renge renkli baski mm cm"
).split()
#: What titles call a thing, and the words that stand for it here. A + is a word of
#: its own, ~ is the point of a decimal number.
SYNONYMS = {
    "qidi": ("qidi tech",), "bambu lab": ("bambulab",), "flashforge": ("flash forge",), "prusa": ("original prusa",),
    "combo": ("uniteli", "ams unite", "ams unitesi", "ams uniteli", "ams ile", "ams li", "with ams"), "bare": ("ams siz", "amsiz", "ams olmadan", "without ams"),
    "silk": ("ipek",), "pla plus": ("pla +",), "petg plus": ("petg +",), "abs plus": ("abs +",), "rapid": ("high speed", "yuksek hiz"), "cf": ("carbon fiber", "karbon elyaf"), "gf": ("glass fiber", "cam elyaf"),
    "refill": ("spoolless", "without spool", "makarasiz"), "spool": ("with spool", "makarali"), "1kg": ("1 kg", "1000 g", "1000 gr"), "175mm": ("1~75 mm", "1~75"), "285mm": ("2~85 mm", "2~85"),
}


def _renamings() -> list[tuple[str, str]]:
    """Every way to write a synonym, apart or in one word, and what it becomes; the longest first."""
    ways = {w: to for to, phrases in SYNONYMS.items() for p in phrases for w in (p, p.replace(" ", ""))}
    return sorted(ways.items(), key=lambda kv: (-len(kv[0]), kv[0]))


#: A variant word that is glued to a number, or to "combo", is a word of its own.
_ENDINGS = "|".join(sorted([*VARIANTS, "mini"]))
_SPLITS = ((rf"({_ENDINGS})combo\b", r"$1 combo"), (rf"([0-9])({_ENDINGS})\b", r"$1 $2"))
_PLAIN = (("[^a-z0-9]+", " "),)
_TITLE = (*_SPLITS, ("([0-9])[.,]([0-9])", "$1~$2"), ("[+]", " + "), ("[^a-z0-9~+]+", " "))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body uses it.

    The value is what an aggregation over no elements begins with, and body is its last step: an element taken
    out of an array that a lambda makes would have Spark work out the type of the whole body again for each row.
    """
    return F.aggregate(F.array(), value, lambda v, _: v, body)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are evaluated once for each row, however many of their fields are read after."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def phrase(words: str, gap: str = r"\s*") -> str:
    """A pattern for a phrase; its words may be parted by gap."""
    return gap.join(re.escape(w) for w in words.split(" "))


def chain(c: Column, rules) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def chain_sql(x: str, rules) -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(to.replace('$', chr(92)))}, 'g')"
    return x


def letters(c: Column, these: str, those: str) -> Column:
    """Letters for letters, as translate does it, where none of those is one of these: much quicker, since a text is searched for a letter and not taken apart."""
    for a, b in zip(these, those, strict=True):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def lower_tr(c: Column) -> Column:
    """Lower case by Turkish rules, then plain letters; null is empty."""
    return letters(F.lower(letters(F.coalesce(c, F.lit("")), "İI", "iı")), TR_FROM, TR_TO)


def unfolded(word: str) -> str:
    """A pattern of every text that lower_tr makes word: what it finds in a text stands there folded, without folding the text."""
    plain = dict(zip(TR_FROM, TR_TO, strict=True))

    def letter(c: str) -> str:
        ways = {x for y in (c, *[a for a, b in plain.items() if b == c]) for x in (y, y.upper())}
        ways |= {"i": {"İ"}, "k": {"\u212a"}}.get(c, set())  # the Kelvin sign is a K
        return f"[{''.join(sorted(ways))}]" if len(ways) > 1 else re.escape(c)

    return "".join(map(letter, word))


def lower_tr_sql(x: str) -> str:
    return f"translate(lower(translate(coalesce({x}, ''), 'İI', 'iı')), '{TR_FROM}', '{TR_TO}')"


def fold(c: Column) -> Column:
    """Lowered plain words parted by one space, glued suffixes split off."""
    return F.trim(chain(lower_tr(c), (*_SPLITS, *_PLAIN)))


def fold_sql(x: str) -> str:
    return f"trim({chain_sql(lower_tr_sql(x), (*_SPLITS, *_PLAIN))})"


def _apart(words: str) -> str:
    """Words with a space of their own on both sides, so that neighbours are found one by one."""
    return " " + words.replace(" ", "  ") + " "


def title_rules(c: Column) -> Column:
    """A title with equivalent spellings made one, as plain words."""
    out = F.concat(F.lit(" "), F.replace(F.trim(chain(lower_tr(c), _TITLE)), F.lit(" "), F.lit("  ")), F.lit(" "))
    for phrase, to in _renamings():
        out = F.replace(out, F.lit(_apart(phrase)), F.lit(_apart(to)))
    return F.trim(F.regexp_replace(out, "[ ~+]+", " "))


def title_rules_sql(x: str) -> str:
    out = f"' ' || replace(trim({chain_sql(lower_tr_sql(x), _TITLE)}), ' ', '  ') || ' '"
    for phrase, to in _renamings():
        out = f"replace({out}, '{_apart(phrase)}', '{_apart(to)}')"
    return f"trim(regexp_replace({out}, '[ ~+]+', ' ', 'g'))"


def tokens(c: Column) -> Column:
    """Distinct identifying words of a title, in order."""
    return tokens_of(title_rules(c))


def tokens_of(rules: Column) -> Column:
    """The same of a title by its rules."""
    stop = F.array(*[F.lit(w) for w in STOP])
    return F.array_distinct(F.filter(F.split(rules, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w) & ~w.rlike(r"^202\d$")))


def tokens_sql(x: str) -> str:
    """The same as a list joined by spaces (DuckDB's list_distinct keeps no order)."""
    stop = "[" + ", ".join(map(_quoted, STOP)) + "]"
    kept = f"list_filter(string_split({title_rules_sql(x)}, ' '), lambda w: length(w) > 1 AND NOT list_contains({stop}, w) AND NOT regexp_matches(w, '^202\\d$'))"
    return f"array_to_string(list_filter({kept}, lambda w, i: list_position({kept}, w) = i), ' ')"


def fold_locale(c: Column) -> Column:
    """Accents off, lowered, plain words."""
    low = F.translate(F.lower(F.translate(F.coalesce(c, F.lit("")), "İI", "ii")), TR_FROM + ACCENT_FROM, TR_TO + ACCENT_TO)
    return F.trim(F.regexp_replace(F.replace(low, F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))


def fold_locale_sql(x: str) -> str:
    low = f"translate(lower(translate(coalesce({x}, ''), 'İI', 'ii')), '{TR_FROM + ACCENT_FROM}', '{TR_TO + ACCENT_TO}')"
    return f"trim(regexp_replace(replace({low}, 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


def variant_tag(c: Column) -> Column:
    """The variant words of a folded title, sorted."""
    return F.array_join(F.array_sort(F.array_intersect(F.split(c, r"\s+"), F.array(*[F.lit(v) for v in VARIANTS]))), " ")


def variant_tag_sql(words: str) -> str:
    known = ", ".join(f"'{v}'" for v in sorted(VARIANTS))
    return f"array_to_string(list_filter([{known}], lambda v: list_contains(string_split({words}, ' '), v)), ' ')"


def slug(c: Column, most: int = 40) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(fold_locale(c), " ", "-"), 1, most), "-$", "")


def slug_sql(x: str, most: int = 40) -> str:
    return f"regexp_replace(substr(replace({fold_locale_sql(x)}, ' ', '-'), 1, {most}), '-$', '')"


#: Letters and words that tell a language, tried in this order.
LANGUAGES = (("de", "[äöüßÄÖÜ]", "und|mit|für|drucker"), ("tr", "[şğıöçüŞĞİÖÇÜ]", "yazıcı|filament|fiyat"), ("es", None, "impresora|filamento|precio"))


def detect_lang(c: Column) -> Column:
    """A text is lowered once; a word is looked for only where one of the words' first letters stands."""

    def judged(x: Column) -> Column:
        out = F.lit("en")
        for code, letters, words in reversed(LANGUAGES):
            firsts = "".join(sorted({w[0] for w in words.split("|")}))
            test = x["low"].rlike(rf"(?=[{firsts}])(?<![a-z0-9_])(?:{words})(?![a-z0-9_])")
            if letters:
                test = x["text"].rlike(letters) | test
            out = F.when(test, code).otherwise(out)
        return out

    return F.when(c.isNull(), "en").otherwise(let(F.struct(c.alias("text"), F.lower(c).alias("low")), judged))


def detect_lang_sql(x: str) -> str:
    out = ""
    for code, letters, words in LANGUAGES:
        test = rf"regexp_matches(lower({x}), '(^|[^a-z0-9_])({words})($|[^a-z0-9_])')"
        if letters:
            test = f"regexp_matches({x}, '{letters}') OR {test}"
        out += f" WHEN {test} THEN '{code}'"
    return f"CASE{out} ELSE 'en' END"


#: Named HTML entities.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    """Named entities, and decimal ones by their code points."""
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")

    def numbered(x: Column) -> Column:
        numbers = F.array_distinct(F.regexp_extract_all(x, F.lit("&#([0-9]{1,6});"), F.lit(1)))
        return F.when(x.contains("&#"), F.aggregate(numbers, x, lambda out, n: F.replace(out, F.concat(F.lit("&#"), n, F.lit(";")), letter(n)))).otherwise(x)

    def decoded(x: Column) -> Column:
        for name, to in ENTITIES[:-1]:
            x = F.replace(x, F.lit(name), F.lit(to))
        return F.replace(let(x, numbered), F.lit(ENTITIES[-1][0]), F.lit(ENTITIES[-1][1]))

    return let(c, lambda x: F.when(x.contains("&"), decoded(x)).otherwise(x))


def decode_entities_sql(x: str) -> str:
    for name, to in ENTITIES[:-1]:
        x = f"replace({x}, {_quoted(name)}, {_quoted(to)})"
    x = f"list_reduce(list_prepend({x}, list_transform(list_distinct(regexp_extract_all({x}, '&#([0-9]{{1,6}});', 1)), lambda n: n)), lambda a, n: replace(a, '&#' || n || ';', chr(n::int)))"
    return f"replace({x}, {_quoted(ENTITIES[-1][0])}, {_quoted(ENTITIES[-1][1])})"


_TAGS = ((r"(?is)<(script|style|svg|noscript)\b[^>]*>.*?</(script|style|svg|noscript)>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " "))
#: White space that is not one plain space already.
_SPACES = r"(?:[\t\r\n\f]| (?=[ \t\r\n\f]))[ \t\r\n\f]*"


def visible_text(c: Column) -> Column:
    """HTML without scripts, styles, comments and tags, white space made one."""
    return F.trim(F.regexp_replace(decode_entities(chain(F.coalesce(c, F.lit("")), _TAGS)), _SPACES, " "))


def visible_text_sql(x: str) -> str:
    out = decode_entities_sql(chain_sql(f"coalesce({x}, '')", _TAGS))
    return f"trim(regexp_replace({out}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def serialize(fields: list[str]) -> Column:
    """'COL name VAL value' of every field that has a value."""
    return F.concat_ws(" ", *[F.when(F.col(f).cast("string") != "", F.concat(F.lit(f"COL {f} VAL "), F.col(f).cast("string"))) for f in fields])


#: Feeders, and what a language says before or behind one (_) for a pack with it and without it.
FEEDERS = ("ams lite", "ams 2 pro", "ams", "cfs", "ace pro")
WITH, WITHOUT = ("_ ile", "_ li", "with _", "mit _", "con _", "_ dahil"), ("_ siz", "_ olmadan", "without _", "ohne _", "sin _", "_ haric")
#: Words of four languages that name no product.
NOISE = ("3d", "yazici", "printer", "drucker", "impresora", "filament", "filamento", "urun", "stoktan", "teslim", "kampanya", "indirim", "yeni", "neu", "nuevo", "new")


def _normal_steps() -> list[tuple[str, str]]:
    """What is replaced by what in plain words, the longest phrase first."""
    feeders = [(way.replace("_", f), to) for f in FEEDERS for ways, to in ((WITHOUT, "bare"), (WITH, "combo")) for way in ways]
    return [*sorted(feeders, key=lambda kv: (-len(kv[0]), kv[0])), *[(w, "") for w in NOISE]]


def normalize(c: Column) -> Column:
    """A title of any of four languages as plain words: packs named alike, noise left out."""
    out = F.concat(F.lit(" "), F.replace(fold_locale(c), F.lit(" "), F.lit("  ")), F.lit(" "))
    for phrase_, to in _normal_steps():
        out = F.replace(out, F.lit(_apart(phrase_)), F.lit(_apart(to)))
    return F.trim(F.regexp_replace(out, " +", " "))


def normalize_sql(x: str) -> str:
    out = f"' ' || replace({fold_locale_sql(x)}, ' ', '  ') || ' '"
    for phrase_, to in _normal_steps():
        out = f"replace({out}, '{_apart(phrase_)}', '{_apart(to)}')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def foldings(c: Column) -> tuple[Column, Column]:
    """Lowered with its punctuation and single spaces; letters and digits alone."""
    low = lower_tr(c)
    return F.trim(F.regexp_replace(low, "[ \\t\\r\\n]+", " ")), F.regexp_replace(low, "[^a-z0-9]+", "")


def foldings_sql(x: str) -> tuple[str, str]:
    low = lower_tr_sql(x)
    return f"trim(regexp_replace({low}, '[ \\t\\r\\n]+', ' ', 'g'))", f"regexp_replace({low}, '[^a-z0-9]+', '', 'g')"
