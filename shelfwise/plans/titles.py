"""Queries on titles, money, stock text, likeness and search.

Texts come from the catalogue views and the raw tables where they exist. Turkish titles, shop
phrases and localised money, which no table holds, are made of every row of part: its key and
size pick the words, its price the amount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import identity as I
from shelfwise.functions import money as M
from shelfwise.functions import search as S
from shelfwise.functions import similarity as L
from shelfwise.functions import stock as K
from shelfwise.functions import text as T
from shelfwise.plans.base import collection
from shelfwise.sources.views import PRODUCTS, products, spread, table

QUERIES, ORACLES, query = collection()

TITLES = (
    (1, "Creality K2 PlusCombo 3D Yazıcı", "printer", "Creality"), (2, "CREALITY K2 Plus Combo", "printer", "Creality"), (3, "Bambu Lab A1 mini AMS ile", "printer", "Bambu"), (4, "BambuLab A1 Mini Combo", "printer", "Bambu Lab"),
    (5, "PLA+ Siyah 1 kg 1.75 mm Filament makaralı", "filament", "Esun"), (6, "eSUN PLA Plus Black 1000 gr 1,75mm with spool", "filament", "Esun"), (7, "PETG Kırmızı Filament 1kg makarasız", "filament", "Esun"), (8, "A1 nozzle yedek parça", "accessory", "Bambu"),
    (9, "H2D Laser Full Combo 10W", "printer", "Bambu Lab"), (10, "H2D Lazer Full Combo 40 Watt", "printer", "Bambu Lab"), (11, "Güç kaynağı 60W adaptör", "accessory", ""), (12, "İPEK PLA Altın ŞÇĞÜÖ", "filament", ""), (13, "", "printer", ""), (14, None, "printer", None),
    (15, "Flash Forge Adventurer 5M", "printer", "FlashForge"), (16, "FlashForge Adventurer 5MPro", "printer", "FlashForge"), (17, "Ender 3 kit", "printer", "Creality"), (18, "Ender 3 montajlı", "printer", "Creality"), (19, "K2 plsu combo", "printer", "Creality"),
)
PHRASES = ((1, "Stoktan Teslim"), (2, "TÜKENDİ"), (3, "Ön Sipariş ver"), (4, "Sepete Ekle"), (5, "Stokta yok, gelince haber ver"), (6, "stokta"), (7, "KDV dahil fiyat"), (8, "1.000 TL + KDV"), (9, "dropshipping ürün"), (10, ""), (11, None), (12, "In Stock"), (13, "KDV hariç"))
EXTRAS = ("", "Siyah", "Kırmızı 1 kg", "1,75 mm", "makaralı", "kit", "10W", "AMS ile", "2024", "yedek parça")
#: How a price is written (# is the number as 1.234,50; @ as 1,234.50; ~ as 1234,50), and whether that is an amount and nothing else.
SHAPES = (("# TL", True), ("@", True), ("$@", True), ("%21 # TL", False), ("# TL # TL", False), ("K2 Combo ~", False), ("", False), (None, False), ("₺#", True), ("~", True), ("x~", False))


def _lit(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _pick_sql(values, at: str) -> str:
    return f"([{', '.join(map(_lit, values))}])[{at} % {len(values)} + 1]"


def _pick(values, at: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(at) % len(values) + 1).cast("int"))


_DOTTED = "translate(format('{:,.2f}', p_retailprice), ',.', '.,')"
_T = f"(SELECT p_partkey AS id, {_pick_sql([t[1] for t in TITLES], 'p_partkey')} || ' ' || {_pick_sql(EXTRAS, 'p_size')} AS title, {_pick_sql([t[2] for t in TITLES], 'p_partkey')} AS kind, {_pick_sql([t[3] for t in TITLES], 'p_partkey')} AS brand FROM part) AS v"
_P = f"(SELECT p_partkey AS id, {_pick_sql([t[1] for t in PHRASES], 'p_partkey')} || ' ' || p_name AS phrase FROM part) AS v"
_M = f"(SELECT p_partkey AS id, replace(replace(replace({_pick_sql([x[0] for x in SHAPES], 'p_partkey')}, '#', {_DOTTED}), '@', format('{{:,.2f}}', p_retailprice)), '~', replace(format('{{:.2f}}', p_retailprice), '.', ',')) AS raw, {_pick_sql([x[0] for x in SHAPES], 'p_partkey')} AS shape, {_pick_sql([x[1] for x in SHAPES], 'p_partkey')} AS whole, p_retailprice AS price FROM part) AS v"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(_pick([t[1] for t in TITLES], "p_partkey"), F.lit(" "), _pick(EXTRAS, "p_size"))
    # a few letters of each row become much work
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("id"), title.alias("title"), _pick([t[2] for t in TITLES], "p_partkey").alias("kind"), _pick([t[3] for t in TITLES], "p_partkey").alias("brand"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different title once, by its least id: copies are matched as one."""
    return titles(spark, sf_dir).groupBy("title", "kind", "brand").agg(F.min("id").alias("id"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(_pick([t[1] for t in PHRASES], "p_partkey"), F.lit(" "), "p_name").alias("phrase"))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.format_number("p_retailprice", 2)
    half = F.translate(F.replace(plain, F.lit(","), F.lit("")), ".", ",")
    raw = _pick([x[0] for x in SHAPES], "p_partkey")
    for mark, number in (("#", F.translate(plain, ",.", ".,")), ("@", plain), ("~", half)):
        raw = F.replace(raw, F.lit(mark), number)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"))


@query(f"SELECT id, {T.fold_sql('title')} AS folded FROM {_T}")
def fold_tr(spark, sf_dir):
    return titles(spark, sf_dir).select("id", T.fold(F.col("title")).alias("folded"))


@query(f"SELECT id, {T.title_rules_sql('title')} AS ruled FROM {_T}")
def title_rules(spark, sf_dir):
    return titles(spark, sf_dir).select("id", T.title_rules(F.col("title")).alias("ruled"))


@query(f"SELECT id, {T.tokens_sql('title')} AS tokens FROM {_T}")
def tokens(spark, sf_dir):
    return titles(spark, sf_dir).select("id", F.array_join(T.tokens(F.col("title")), " ").alias("tokens"))


@query(f"WITH {PRODUCTS} SELECT product_id, {T.fold_sql('name')} AS folded, {T.slug_sql('name')} AS slug FROM v_products")
def slugify(spark, sf_dir):
    return products(spark, sf_dir).select("product_id", T.fold(F.col("name")).alias("folded"), T.slug(F.col("name")).alias("slug"))


@query(f"SELECT doc_id, md5({T.fold_locale_sql('text')}) AS digest FROM documents")
def fold_locale(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_locale(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, {T.detect_lang_sql('text')} AS found FROM documents")
def detect_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_lang(F.col("text")).alias("found"))


@query(f"SELECT page_id, md5({T.visible_text_sql('html')}) AS digest FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.visible_text(F.col("html"))).alias("digest"))


@query(f"WITH {PRODUCTS} SELECT product_id, 'COL name VAL ' || name || ' COL brand VAL ' || brand || ' COL kind VAL ' || kind || ' COL color VAL ' || color AS said FROM v_products")
def serialize(spark, sf_dir):
    return products(spark, sf_dir).select("product_id", T.serialize(["name", "brand", "kind", "color"]).alias("said"))


@query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, list_filter(string_split(split_part(url, '?', 1), '/'), lambda x: x <> '')[-1] AS slug FROM pages")
def url_parts(spark, sf_dir):
    path = F.split(F.split("url", "[?]")[0], "/")
    return table(spark, sf_dir, "pages").select("page_id", F.split(F.split("url", "://")[1], "/")[0].alias("host"), F.element_at(F.filter(path, lambda x: x != ""), -1).alias("slug"))


@query("SELECT page_id, 'web-' || substr(sha256(url), 1, 16) AS id FROM pages")
def sha_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("web-"), F.substring(F.sha2("url", 256), 1, 16)).alias("id"))


@query(f"SELECT id, {K.stock_from_text_sql('phrase')} AS status, {K.vat_from_text_sql('phrase')} AS vat FROM {_P}")
def stock_text(spark, sf_dir):
    return phrases(spark, sf_dir).select("id", K.stock_from_text(F.col("phrase")).alias("status"), K.vat_from_text(F.col("phrase")).alias("vat"))


@query(f"SELECT id, CASE WHEN {K.vat_from_text_sql('phrase')} = 'unknown' THEN id % 2 = 0 ELSE {K.vat_from_text_sql('phrase')} = 'excluded' END AS adds FROM {_P}")
def vat_decision(spark, sf_dir):
    policy = F.when(F.col("id") % 2 == 0, "excluded").otherwise("included")
    return phrases(spark, sf_dir).select("id", K.should_add_vat(F.col("phrase"), policy).alias("adds"))


@query(f"SELECT id, CASE WHEN whole THEN price END AS amount FROM {_M}")
def parse_money(spark, sf_dir):
    return amounts(spark, sf_dir).select("id", M.parse_money(F.col("raw")).alias("amount"))


@query(None)
def pick_money(spark, sf_dir):
    """The price named in each document, if any."""
    return table(spark, sf_dir, "documents").select("doc_id", F.inline_outer(F.array(M.pick_money(F.col("text")))))


@query(None)
def money_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(M.money_tokens(F.col("text"))).alias("n"))


@query("SELECT doc_id, coalesce((SELECT code FROM (SELECT code, count(*) AS n, min(i) AS first FROM (SELECT CASE lower(m) WHEN 'tl' THEN 'TRY' WHEN 'try' THEN 'TRY' WHEN '₺' THEN 'TRY' WHEN '$' THEN 'USD' WHEN 'usd' THEN 'USD' WHEN '€' THEN 'EUR' WHEN 'eur' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN 'gbp' THEN 'GBP' ELSE 'CHF' END AS code, i FROM (SELECT unnest(regexp_extract_all(text, '(?i)TL|TRY|USD|EUR|GBP|CHF|[$€£₺]')) AS m, generate_subscripts(regexp_extract_all(text, '(?i)TL|TRY|USD|EUR|GBP|CHF|[$€£₺]'), 1) AS i)) GROUP BY 1) ORDER BY n DESC, first LIMIT 1), '') AS currency FROM documents")
def currency_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.detect_currency(F.col("text")).alias("currency"))


@query(f"WITH {PRODUCTS} SELECT product_id, translate(format('{{:,.2f}}', list_price), ',.', '.,') || ' TL' AS price FROM v_products")
def format_price(spark, sf_dir):
    return products(spark, sf_dir).select("product_id", M.format_price(F.col("list_price")).alias("price"))


def _pairs(spark, sf_dir) -> DataFrame:
    """Every title beside the next one, with the features of both."""
    t = titles(spark, sf_dir).select("id", I.features(F.col("title"), F.col("kind"), F.col("brand")).alias("f"))
    a, b = t.select(F.col("id").alias("a_id"), F.col("f").alias("a")), t.select((F.col("id") - 1).alias("a_id"), F.col("id").alias("b_id"), F.col("f").alias("b"))
    return a.join(b, "a_id")


@query(f"WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part) SELECT x.w AS a, y.w AS b, levenshtein(x.w, y.w) AS d FROM w x JOIN w y ON x.w < y.w")
def levenshtein_pairs(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("w")).distinct()
    return w.select(F.col("w").alias("a")).join(w.select(F.col("w").alias("b")), F.col("a") < F.col("b")).select("a", "b", F.levenshtein("a", "b").alias("d"))  # a few dozen words


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), d AS (SELECT x.w AS a, y.w AS b, levenshtein(x.w, y.w) AS d FROM w x JOIN w y ON x.w < y.w)
SELECT a, b, a = b OR (least(length(a), length(b)) >= 4 AND (d <= 1 OR d <= greatest(length(a), length(b)) * 0.2)) AS same FROM d""")
def similar_words(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    pairs = w.select(F.col("w").alias("a")).join(w.select(F.col("w").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", L.similar(F.col("a"), F.col("b")).alias("same"))


@query(None)
def title_score(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a_id", "b_id", L.words_score(F.col("a.words"), F.col("b.words")).alias("score"), L.words_subset(F.col("a.words"), F.col("b.words")).alias("subset"))


@query("SELECT a.p_partkey AS a, bit_count(xor(('0x' || substr(md5(a.p_name), 1, 15))::bigint, ('0x' || substr(md5(b.p_name), 1, 15))::bigint)) AS d FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def hamming(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), L.hash_bits(F.concat(F.lit("0"), F.substring(F.md5("p_name"), 1, 15))).alias("h"))
    return p.join(p.select((F.col("a") - 1).alias("a"), F.col("h").alias("g")), "a").select("a", L.hamming(F.col("h"), F.col("g")).cast("long").alias("d"))


@query("SELECT a.vec_id AS a, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)), 4) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), "embedding")
    return e.join(e.select((F.col("a") - 1).alias("a"), F.col("embedding").alias("other")), "a").select("a", F.round(L.dot(F.col("embedding"), F.col("other")), 4).alias("cos"))


@query(f"SELECT id, {I.color_of_sql('title')} AS color, {I.grams_sql('title')} AS grams FROM {_T}")
def weight_color(spark, sf_dir):
    return titles(spark, sf_dir).select("id", I.color_of(F.col("title")).alias("color"), I.grams(F.col("title")).alias("grams"))


@query(f"SELECT id, {I.is_lookalike_sql('title')} AS lookalike, {I.product_type_sql('title')} AS type FROM {_T}")
def lookalike(spark, sf_dir):
    return titles(spark, sf_dir).select("id", I.is_lookalike(F.col("title")).alias("lookalike"), I.product_type(F.col("title")).alias("type"))


@query(f"WITH {PRODUCTS} SELECT product_id, {I.product_type_sql('name')} AS type FROM v_products")
def product_type(spark, sf_dir):
    return products(spark, sf_dir).select("product_id", I.product_type(F.col("name")).alias("type"))


_AXES = f"""SELECT id, coalesce(kind, '') AS kind, {I.color_of_sql('title')} AS color, {I.grams_sql('title')} AS weight, regexp_extract({T.title_rules_sql('title')}, '\\b(175|285|300)mm\\b', 1) AS diameter, {I.packaging_of_sql('title')} AS packaging,
 regexp_matches({T.title_rules_sql('title')}, '\\b(combo|ams)\\b')::varchar AS combo, regexp_matches({T.title_rules_sql('title')}, '\\bmini\\b')::varchar AS mini, {T.variant_tag_sql(T.title_rules_sql('title'))} AS variant_tag, {I.laser_watts_sql('title')} AS laser, {I.kit_form_sql('title')} AS kit, {I.technology_sql('title')} AS technology FROM {_T}"""


@query(_AXES)
def axes(spark, sf_dir):
    return titles(spark, sf_dir).select("id", I.axes(F.col("title"), F.col("kind")).alias("x")).select("id", "x.*")


_DIFFER = ", ".join(f"CASE WHEN a.{x} <> b.{x}{'' if x in I.STRICT else f" AND a.{x} <> '' AND b.{x} <> ''"} THEN '{x}' END" for x in I.AXES)
_SILENT = ", ".join(f"CASE WHEN (a.{x} = '') <> (b.{x} = '') AND a.kind <> 'printer' AND b.kind <> 'printer' THEN '{x}' END" for x in ("color", "weight", "diameter", "packaging"))


@query(f"""WITH x AS ({_AXES}) SELECT a.id AS a_id, b.id AS b_id, array_to_string(list_filter([{_DIFFER}], lambda c: c IS NOT NULL), ',') AS conflicts, array_to_string(list_filter([{_SILENT}], lambda c: c IS NOT NULL), ',') AS gaps FROM x a JOIN x b ON b.id = a.id + 1""")
def conflicts(spark, sf_dir):
    a, b = F.col("a.axes"), F.col("b.axes")
    return _pairs(spark, sf_dir).select("a_id", "b_id", F.array_join(I.conflicts(a, b), ",").alias("conflicts"), F.array_join(I.gaps(a, b), ",").alias("gaps"))


@query(None)
def decide_pair(spark, sf_dir):
    return I.decided(_pairs(spark, sf_dir), "a", "b")


@query(None)
def search_score(spark, sf_dir):
    """Products that a query finds, with their scores."""
    p = products(spark, sf_dir).select("product_id", S.search_score(F.col("name"), F.col("name"), F.lit("promo gear 13")).alias("score"))
    return p.where("score > 0")


@query(f"WITH {PRODUCTS} SELECT product_id FROM v_products WHERE list_contains(string_split({T.fold_sql('name')}, ' '), 'standard')")
def search_filter(spark, sf_dir):
    return products(spark, sf_dir).where(S.matches(F.col("name"), F.col("name"), F.lit("Standard yazıcı"))).select("product_id")


@query(None)
def rank_search(spark, sf_dir):
    """The best ten for a query: score, then name, then id; no global sort of all rows."""
    p = products(spark, sf_dir).select("product_id", "name", S.search_score(F.col("name"), F.col("name"), F.lit("economy gear")).alias("score"))
    return p.where("score > 0").orderBy(F.desc("score"), "name", "product_id").limit(10)
