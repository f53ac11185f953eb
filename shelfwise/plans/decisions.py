"""Queries on the dictionary, identities, candidates, decisions and what is left of the rest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import filament as P
from shelfwise.functions import identity as I
from shelfwise.functions import money as M
from shelfwise.functions import similarity as L
from shelfwise.functions import text as T
from shelfwise.operators import identity as D
from shelfwise.operators import bases, duplicates, leaders, pairing, placement, whole
from shelfwise.operators import offers as O
from shelfwise.operators import pictures as V
from shelfwise.operators import scans as N
from shelfwise.operators import scoring as S
from shelfwise.plans.base import collection
from shelfwise.plans.titles import _M, _T, amounts, listings, titles
from shelfwise.sources import pages as G
from shelfwise.sources.dictionary import ALIASES, DICTIONARY, dictionary
from shelfwise.sources.views import OFFERS, OFFERS_WITH_SHOP, PRODUCTS, SHOPS, offers, offers_with_shop, products, shops, table

QUERIES, ORACLES, query = collection()
_HIT = f"""WITH {DICTIONARY}, t AS (SELECT id AS tid, ' ' || {T.fold_sql('title')} || ' ' AS f FROM {_T}),
 h AS (SELECT tid, role, d.id, brand_id, alias FROM t JOIN dict d ON contains(f, ' ' || alias || ' ')),
 b AS (SELECT tid, arg_max(id, struct_pack(l := length(alias), a := alias)) AS brand_id FROM h WHERE role = 'brand' GROUP BY 1),
 m AS (SELECT tid, brand_id, arg_max(id, struct_pack(l := length(alias), a := alias)) AS model FROM h WHERE role = 'model' GROUP BY 1, 2),
 f AS (SELECT tid, brand_id, arg_max(id, struct_pack(l := length(alias), a := alias)) AS feeder FROM h WHERE role = 'feeder' GROUP BY 1, 2)"""


def _found(spark, sf_dir):
    return D.lookup(titles(spark, sf_dir), "title", dictionary(spark), "id")


_NAMED = [(of, alias) for alias, role, _, of in ALIASES if role == "model"]
_IDS = [id_ for _, role, id_, _ in ALIASES if role == "model"]
#: A title for each part: a brand, two neighbours of the dictionary's models, the part's own name, and the second model again.
_MADE = f"(SELECT p_partkey AS id, ([{', '.join(repr(b) for b, _ in _NAMED)}])[p_partkey * 7 % {len(_NAMED)} + 1] AS brand_id, ' ' || brand_id || ' ' || ([{', '.join(repr(a) for _, a in _NAMED)}])[p_partkey * 7 % {len(_NAMED)} + 1] || ' ' || ([{', '.join(repr(a) for _, a in _NAMED)}])[(p_partkey * 7 + 1) % {len(_NAMED)} + 1] || ' pro ' || p_name || ' ' || ([{', '.join(repr(a) for _, a in _NAMED)}])[(p_partkey * 7 + 1) % {len(_NAMED)} + 1] || ' ' AS hay FROM part)"


@query(f"""WITH RECURSIVE {DICTIONARY}, t AS {_MADE}, s AS (SELECT id, brand_id, hay, 1000 AS size, '' AS alias, []::VARCHAR[] AS cores FROM t UNION ALL
 SELECT s.id, s.brand_id, replace(s.hay, ' ' || d.alias || ' ', ' '), length(d.alias), d.alias, CASE WHEN list_contains(s.cores, d.id) THEN s.cores ELSE list_append(s.cores, d.id) END FROM s JOIN dict d ON d.role = 'model' AND d.brand_id = s.brand_id
  AND (length(d.alias) < s.size OR (length(d.alias) = s.size AND d.alias > s.alias)) AND contains(s.hay, ' ' || d.alias || ' ') QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY length(d.alias) DESC, d.alias) = 1)
 SELECT id, brand_id, array_to_string(arg_max(cores, (1000 - size, alias)), ',') AS cores FROM s GROUP BY 1, 2""")
def model_cores(spark, sf_dir):
    """Every model that a title names of its brand, the longest name first; what is found is taken out."""
    n = len(_NAMED)
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % n + 1).cast("int"))
    at, aliases = F.col("p_partkey") * 7, [a for _, a in _NAMED]
    brand = pick([b for b, _ in _NAMED], at)
    title = F.concat_ws(" ", brand, pick(aliases, at), pick(aliases, at + 1), F.lit("pro"), "p_name", pick(aliases, at + 1))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), brand.alias("brand_id"), title.alias("title"))
    return N.model_cores(rows, "id", "title", "brand_id", dictionary(spark)).withColumn("cores", F.array_join("cores", ","))


@query(f"{_HIT} SELECT t.tid AS id, b.brand_id, m.model, f.feeder FROM t LEFT JOIN b USING (tid) LEFT JOIN m ON m.tid = t.tid AND m.brand_id = b.brand_id LEFT JOIN f ON f.tid = t.tid AND f.brand_id = b.brand_id")
def brand_model_feeder(spark, sf_dir):
    return _found(spark, sf_dir).select("id", "brand_id", "model", "feeder")


@query(f"""{_HIT} SELECT t.tid AS id, concat_ws('/', b.brand_id, m.model, CASE WHEN regexp_matches({T.title_rules_sql('v.title')}, '\\bbare\\b') THEN 'bare' WHEN regexp_matches({T.title_rules_sql('v.title')}, '\\bcombo\\b') OR f.feeder IS NOT NULL THEN 'combo' END, f.feeder, nullif({I.kit_form_sql('v.title')}, ''), {I.technology_sql('v.title')},
 nullif(replace({T.variant_tag_sql(T.title_rules_sql('v.title'))}, ' ', '-'), '')) AS identity FROM t JOIN {_T} ON v.id = t.tid LEFT JOIN b USING (tid) LEFT JOIN m ON m.tid = t.tid AND m.brand_id = b.brand_id LEFT JOIN f ON f.tid = t.tid AND f.brand_id = b.brand_id""")
def identity_id(spark, sf_dir):
    return _found(spark, sf_dir).select("id", D.identity_id(F.col("title"), F.col("brand_id"), F.col("model"), F.col("feeder")).alias("identity"))


def _whole(spark, sf_dir):
    t = listings(spark, sf_dir).select("id", F.col("title").alias("name"), "kind", "brand")
    return whole.with_identity(t, dictionary(spark))


@query(None)
def whole_identity(spark, sf_dir):
    """Every axis of every different title, and its stable id."""
    return _whole(spark, sf_dir).select("id", "identity", "axes.*").withColumn("model_cores", F.array_join("model_cores", ","))


@query(None)
def whole_conflicts(spark, sf_dir):
    """On what the pairs that may be one product differ, and what only one of them says."""
    _, pairs = _pool(spark, sf_dir)
    side = _whole(spark, sf_dir).select("id", "axes")
    both = pairs.join(side.select(F.col("id").alias("l_id"), F.col("axes").alias("x")), "l_id").join(side.select(F.col("id").alias("r_id"), F.col("axes").alias("y")), "r_id")
    said = lambda c: F.array_join(c, ",")
    return both.select("l_id", "r_id", said(whole.all_conflicts(F.col("x"), F.col("y"))).alias("conflicts"), said(whole.all_gaps(F.col("x"), F.col("y"))).alias("gaps"))


def _pool(spark, sf_dir):
    t = listings(spark, sf_dir)
    return t, D.blocked_pairs(t, t).where("l_id != r_id")


@query(None)
def blocked_pool(spark, sf_dir):
    """Pairs of different titles that may be one product."""
    _, pairs = _pool(spark, sf_dir)
    # a brand in a title counts from one side, so a pair may come in one order alone
    return pairs.select(F.least("l_id", "r_id").alias("l_id"), F.greatest("l_id", "r_id").alias("r_id")).distinct()


@query(None)
def rank_candidates(spark, sf_dir):
    t, pairs = _pool(spark, sf_dir)
    return D.ranked(pairs, t, t)


def training_pairs(spark, sf_dir):
    """Labelled pairs of titles: each part is a model of the dictionary, bare or with its feeder, and says its own colour besides."""
    n, at = len(_NAMED), F.col("p_partkey") * 7
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (at % n + 1).cast("int"))
    brand, combo = pick([b for b, _ in _NAMED]), F.when(F.col("p_size") % 3 == 0, "Combo")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), brand.alias("brand"), F.concat_ws(" ", brand, pick([a for _, a in _NAMED]), combo).alias("title"), F.concat_ws("/", brand, pick(_IDS), combo).alias("identity"), F.split("p_name", " ")[0].alias("color"),
    )
    return S.labelled(rows, "id", "title", "brand", "identity", F.col("color"))


def _trained(spark, sf_dir):
    pairs = training_pairs(spark, sf_dir)
    return S.fit(pairs.where(~S.held_out(F.col("a"), F.col("b")))), pairs


@query(None)
def pair_scores(spark, sf_dir):
    """The trained scorer on all labelled pairs that it did not learn from."""
    model, pairs = _trained(spark, sf_dir)
    return S.scored(pairs.where(S.held_out(F.col("a"), F.col("b"))), model).select("k", "label", "probability")


@query(None)
def scorer_gate(spark, sf_dir):
    """What the trained scorer decides on each listing's best candidate of its own brand: the likeliest without a conflict, else the likeliest."""
    model, _ = _trained(spark, sf_dir)
    t, pairs = _pool(spark, sf_dir)
    names = dictionary(spark).where("role = 'brand'").select("alias", F.col("id").alias("known"))
    sided = t.withColumn("alias", T.fold(F.coalesce("brand", F.lit("")))).join(F.broadcast(names), "alias", "left").withColumn("of", F.coalesce("known", "alias"))  # some 40 names
    side = lambda p: sided.select(F.col("id").alias(f"{p}_id"), F.col("title").alias(f"{p}_title"), F.col("of").alias(f"{p}_of"))
    own = D.judged(pairs, t, t).join(side("l"), "l_id").join(side("r"), "r_id").where("l_of = '' or l_of = r_of")
    sure = S.scored(own.select("l_id", "r_id", "reason", "action", F.coalesce("l_title", F.lit("")).alias("a"), F.coalesce("r_title", F.lit("")).alias("b")), model)
    free = F.col("reason") != "conflict"
    best = sure.groupBy("l_id").agg(F.max_by(F.struct("r_id", "probability", "action", "reason"), F.struct(free.cast("int"), "probability", -F.col("r_id"))).alias("b"))
    act = D.scorer_gate(F.col("b.probability"), F.col("b.reason") == "conflict", F.col("b.action") == "merge", S.THRESHOLD)
    return best.select("l_id", "b.r_id", "b.probability", act.alias("act"))


def _duplicates(spark, sf_dir):
    rows = titles(spark, sf_dir).groupBy(F.col("title").alias("name"), "kind", "brand").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("offers"))
    return duplicates.duplicate_groups(rows, dictionary(spark))


@query(None)
def duplicate_groups(spark, sf_dir):
    """Different titles that are one product by links without conflict, and the one that stays of each group."""
    return _duplicates(spark, sf_dir)[0].select("id", "keeper", "rows", "exact")


@query(None)
def duplicate_blocked(spark, sf_dir):
    """Near titles that conflict and stay apart, with what they differ on."""
    return _duplicates(spark, sf_dir)[1].select("a", "b", F.array_join("conflicts", ",").alias("conflicts"))


@query(None)
def price_leaders(spark, sf_dir):
    """Every title's group by the whole decision, the cheapest first: its leader."""
    t = titles(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), "id")
    return leaders.led(t, F.col("price"))


@query(None)
def place_batch(spark, sf_dir):
    """A batch of listings placed into a catalogue: what becomes of each, and where."""
    t = titles(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), (F.col("id") % 1000).cast("string")))
    shelf = listings(spark, sf_dir).where("id % 4 = 0").select("id", "title", "kind", "brand")
    known = shelf.where("id % 3 = 0").select(F.col("id").alias("product_id"), F.concat(F.lit("u"), (F.col("id") % 1000).cast("string")).alias("url"))
    return placement.place(t.where("id % 4 != 0"), shelf, known)


@query(None)
def enforce(spark, sf_dir):
    """The best candidate as an answer: it counts if it was among the offered ones, sure enough, without conflict."""
    t, pairs = _pool(spark, sf_dir)
    offered = D.ranked(pairs, t, t).groupBy("l_id").agg(F.collect_list(F.when(F.col("reason") != "conflict", F.col("r_id"))).alias("offered"), F.min_by(F.struct("r_id", "score", "reason"), "rank").alias("a"))
    return offered.select("l_id", D.enforce(F.col("a.r_id"), F.col("offered"), F.col("a.score"), F.col("a.reason") == "conflict").alias("answer"))


@query(f"SELECT id, regexp_matches(coalesce(raw, ''), '^[0-9.,]+$') AS plain FROM {_M}")
def to_amount_plain(spark, sf_dir):
    return amounts(spark, sf_dir).select("id", F.coalesce("raw", F.lit("")).rlike("^[0-9.,]+$").alias("plain"))


@query(f"SELECT id, price AS amount FROM {_M} WHERE regexp_matches(raw, '^[0-9.,]+$')")
def to_amount(spark, sf_dir):
    return amounts(spark, sf_dir).where(F.col("raw").rlike("^[0-9.,]+$")).select("id", M.to_amount(F.col("raw")).alias("amount"))


@query(f"WITH {SHOPS} SELECT shop_id, CASE WHEN upper(currency) = 'TL' THEN 'TRY' ELSE upper(currency) END AS code FROM v_shops")
def currency_code(spark, sf_dir):
    c = F.upper("currency")
    return shops(spark, sf_dir).select("shop_id", F.when(c == "TL", "TRY").otherwise(c).alias("code"))


@query(f"WITH {OFFERS} SELECT product_id, ord, floor(price / 41.0 * 100 + 0.5) / 100 AS usd FROM v_offers")
def fx_to_usd(spark, sf_dir):
    return offers(spark, sf_dir).select("product_id", "ord", (F.floor(F.col("price") / 41.0 * 100 + 0.5) / 100).alias("usd"))


@query(f"WITH {OFFERS} SELECT product_id, ord, price <= 0 OR price = 1 OR (price IN (1000, 1500, 2000, 2500) AND preorder) AS junk FROM v_offers")
def junk_amount(spark, sf_dir):
    p = F.col("price")
    return offers(spark, sf_dir).select("product_id", "ord", ((p <= 0) | (p == 1) | (p.isin(1000, 1500, 2000, 2500) & F.col("preorder"))).alias("junk"))


@query(f"""WITH {OFFERS}, {PRODUCTS} SELECT product_id, ord, CASE WHEN url NOT LIKE 'https://%' THEN 'url' WHEN name = '' THEN 'name' WHEN brand = '' THEN 'brand' WHEN price < 100 THEN 'price' ELSE 'ok' END AS outcome FROM v_offers JOIN v_products USING (product_id)""")
def admission(spark, sf_dir):
    j = offers(spark, sf_dir).join(products(spark, sf_dir), "product_id")
    outcome = F.when(~F.col("url").startswith("https://"), "url").when(F.col("name") == "", "name").when(F.col("brand") == "", "brand").when(F.col("price") < 100, "price").otherwise("ok")
    return j.select("product_id", "ord", outcome.alias("outcome"))


@query(f"WITH {PRODUCTS} SELECT product_id, brand || '|' || array_to_string(list_sort(list_filter(string_split(lower(name), ' '), lambda w: NOT contains(lower(brand), w))), ' ') AS k FROM v_products")
def listing_key(spark, sf_dir):
    words = F.array_sort(F.filter(F.split(F.lower("name"), " "), lambda w: ~F.contains(F.lower("brand"), w)))
    return products(spark, sf_dir).select("product_id", F.concat_ws("|", "brand", F.array_join(words, " ")).alias("k"))


@query("SELECT p_partkey AS id, list_reduce(list_prepend(0::bigint, list_transform(string_split(p_name, ''), lambda c: ascii(c)::bigint)), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM part")
def rolling_id(spark, sf_dir):
    """A 31-multiplier hash of the name in 32 bits."""
    codes = F.transform(F.split("p_name", ""), lambda c: F.ascii(c).cast("long"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: (a * 31 + b) % 4294967296).alias("h"))


@query("SELECT DISTINCT a, length(a) >= 4 OR substr(a, 1, 1) = substr(a, 2, 1) AS swapped, false AS longer FROM (SELECT unnest(string_split(p_name, ' ')) AS a FROM part)")
def near_words(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("a")).distinct()
    typo = F.concat(F.substring("a", 2, 1), F.substring("a", 1, 1), F.expr("substring(a, 3)"))
    return w.select("a", L.near(F.col("a"), typo).alias("swapped"), L.near(F.col("a"), F.concat("a", F.lit("xy"))).alias("longer"))


@query(f"SELECT id, {I.laser_watts_sql('title')} AS watts, {I.technology_sql('title')} AS technology, {I.kit_form_sql('title')} AS kit FROM {_T}")
def laser_watts(spark, sf_dir):
    return titles(spark, sf_dir).select("id", I.laser_watts(F.col("title")).alias("watts"), I.technology(F.col("title")).alias("technology"), I.kit_form(F.col("title")).alias("kit"))


@query(f"SELECT id, {T.variant_tag_sql(T.title_rules_sql('title'))} AS tag FROM {_T}")
def variant_tag(spark, sf_dir):
    return titles(spark, sf_dir).select("id", T.variant_tag(T.title_rules(F.col("title"))).alias("tag"))


@query(f"WITH {PRODUCTS}, f AS (SELECT product_id, name, lower(name) AS hay FROM v_products WHERE kind = 'filament') SELECT product_id FROM f WHERE contains(hay, 'standard') AND contains(hay, 'ring') AND NOT contains(hay, 'plabs')")
def plabs_filter(spark, sf_dir):
    """All tokens must be in the row; rows of the exclusive line are hidden unless asked for."""
    hay, wanted = F.lower("name"), ["standard", "ring"]
    p = products(spark, sf_dir).where("kind = 'filament'")
    for t in wanted:
        p = p.where(F.contains(hay, F.lit(t)))
    exclusive = F.contains(hay, F.lit("plabs"))
    return p.where(exclusive if "plabs" in wanted else ~exclusive).select("product_id")


@query(f"WITH {PRODUCTS} SELECT product_id, name FROM v_products WHERE contains(lower(name), 'gea') ORDER BY name, product_id LIMIT 6")
def suggest_top6(spark, sf_dir):
    return products(spark, sf_dir).where(F.contains(F.lower("name"), F.lit("gea"))).orderBy("name", "product_id").limit(6).select("product_id", "name")


@query(f"""WITH {OFFERS}, {PRODUCTS}, s AS (SELECT p.product_id, name, contains(lower(color), 'b')::int * 4 + contains(polymer, 'standard')::int * 2 + (variant < 10)::int AS score, (SELECT min(price) FROM v_offers o WHERE o.product_id = p.product_id) AS low FROM v_products p WHERE kind = 'filament')
 SELECT * FROM s ORDER BY score DESC, low NULLS LAST, name, product_id LIMIT 30""")
def rank_filaments(spark, sf_dir):
    low = offers(spark, sf_dir).groupBy("product_id").agg(F.min("price").alias("low"))
    flag = lambda c, n: c.cast("int") * n
    score = flag(F.contains(F.lower("color"), F.lit("b")), 4) + flag(F.contains("polymer", F.lit("standard")), 2) + flag(F.col("variant") < 10, 1)
    p = products(spark, sf_dir).where("kind = 'filament'").join(low, "product_id", "left")
    return p.select("product_id", "name", score.alias("score"), "low").orderBy(F.desc("score"), F.asc_nulls_last("low"), "name", "product_id").limit(30)


@query(f"""WITH {PRODUCTS}, c AS (SELECT a.product_id, b.product_id AS base, (a.color <> b.color)::int + (a.variant <> b.variant)::int AS conflicts, b.variant AS rank FROM v_products a JOIN v_products b ON a.brand = b.brand AND a.polymer = b.polymer AND a.product_id <> b.product_id),
 r AS (SELECT *, row_number() OVER w AS rn, lead(conflicts) OVER w AS next FROM c WINDOW w AS (PARTITION BY product_id ORDER BY conflicts, rank DESC, base)) SELECT product_id, base, conflicts, coalesce(next = conflicts, false) AS contested FROM r WHERE rn = 1""")
def baseline_lookup(spark, sf_dir):
    """The base row with fewest conflicts; contested if the runner-up has as many."""
    p = products(spark, sf_dir).select("product_id", "brand", "polymer", "color", "variant")
    return bases.nearest_base(p, "product_id", ["brand", "polymer"], ["color", "variant"], "variant").select("product_id", "base", "conflicts", "contested")


@query(f"WITH {PRODUCTS}, {OFFERS} SELECT product_id, name FROM v_products p WHERE product_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM v_offers o WHERE o.product_id = p.product_id AND stock = 'in_stock') AND NOT EXISTS (SELECT 1 FROM v_products b WHERE b.product_id % 3 = 1 AND b.brand = p.brand AND b.color = p.color)")
def recommendations(spark, sf_dir):
    p = products(spark, sf_dir)
    board = p.where("product_id % 3 = 1").select("brand", "color")
    return p.where("product_id % 3 = 0").join(offers(spark, sf_dir).where("stock = 'in_stock'"), "product_id", "left_anti").join(board, ["brand", "color"], "left_anti").select("product_id", "name")


@query(f"WITH {PRODUCTS} SELECT a.product_id AS a, b.product_id AS b, CASE WHEN a.color = b.color AND a.variant = b.variant THEN 'same' ELSE 'different' END AS label FROM v_products a JOIN v_products b ON a.brand = b.brand AND a.polymer = b.polymer AND a.product_id < b.product_id")
def pair_generation(spark, sf_dir):
    """All pairs of a brand and polymer, labelled; made in tasks of bounded size, whatever a group's."""
    pairs = pairing.group_pairs(products(spark, sf_dir), "product_id", ["brand", "polymer"], ["variant", "color"])
    return pairs.select("a", "b", F.when(F.col("same"), "same").otherwise("different").alias("label"))


@query(f"WITH {PRODUCTS}, e AS (SELECT p_partkey AS product_id, 'edited ' || p_name AS name FROM part WHERE p_partkey % 9 = 0) SELECT product_id, coalesce(e.name, p.name) AS name FROM v_products p LEFT JOIN e USING (product_id)")
def edit_overlay(spark, sf_dir):
    e = table(spark, sf_dir, "part").where("p_partkey % 9 = 0").select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("edited "), "p_name").alias("edited"))
    return products(spark, sf_dir).join(e, "product_id", "left").select("product_id", F.coalesce("edited", "name").alias("name"))


@query("SELECT page_id, regexp_replace(regexp_replace(split_part(url, '?', 1), '^https?://[^/]+', ''), '[0-9]+', '9', 'g') AS shape FROM pages")
def page_pattern(spark, sf_dir):
    path = F.regexp_replace(F.split("url", "[?]")[0], "^https?://[^/]+", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(path, "[0-9]+", "9").alias("shape"))


@query("SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=2' AS next FROM pages WHERE NOT regexp_matches(url, '[?&/](page|sayfa|p|pg)[=/]\\d+')")
def next_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.where(G.page_number(F.col("url")).isNull()).select("page_id", G.next_page(F.col("url")).alias("next"))


@query(r"""SELECT page_id, regexp_matches(url, '^https?://[^/]+/.+') AND NOT regexp_matches(url, '[{}<>]|%7[BbDd]|\[object') AND NOT regexp_matches(url, '(?i)/(category|kategori|collections|search|arama|cart|sepet|login|account|blog|page|tag|help)(/|$|[?])') AS product,
 regexp_matches(url, '(?i)^$|^data:|logo|icon|sprite|placeholder|blank[.]|pixel|[.]svg($|[?])') AS junk FROM pages""")
def product_url_test(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", G.is_product_url(F.col("url")).alias("product"), G.is_junk_image(F.col("url")).alias("junk"))


@query("SELECT page_id, string_split(split_part(url, '?', 1), '/')[-1] AS slug, replace(string_split(split_part(url, '?', 1), '/')[-1], '-', ' ') AS name FROM pages")
def url_only_listings(spark, sf_dir):
    slug = F.element_at(F.split(F.split("url", "[?]")[0], "/"), -1)
    return table(spark, sf_dir, "pages").select("page_id", slug.alias("slug"), F.replace(slug, F.lit("-"), F.lit(" ")).alias("name"))


@query(f"SELECT page_id, md5({T.decode_entities_sql('html')}) AS digest FROM pages")
def entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.decode_entities(F.col("html"))).alias("digest"))


@query(f"WITH {OFFERS} SELECT product_id, ord, (epoch_us(TIMESTAMP '2024-01-01 00:00:00') - epoch_us(checked_at)) / 3600000000.0 AS hours FROM v_offers")
def age_hours(spark, sf_dir):
    micros = F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00"))) - F.unix_micros(F.col("checked_at").cast("timestamp"))
    return offers(spark, sf_dir).select("product_id", "ord", F.coalesce(micros / 3600000000.0, F.lit(float("inf"))).alias("hours"))


@query(f"WITH {PRODUCTS} SELECT source, CASE source WHEN 'official' THEN 3 WHEN 'tracker' THEN 2 ELSE 1 END AS rank, count(*) AS n FROM (SELECT CASE product_id % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'tracker' ELSE 'uncertain' END AS source FROM v_products) GROUP BY 1, 2")
def source_rank(spark, sf_dir):
    source = F.when(F.col("product_id") % 3 == 0, "official").when(F.col("product_id") % 3 == 1, "tracker").otherwise("uncertain")
    rank = F.create_map(F.lit("official"), F.lit(3), F.lit("tracker"), F.lit(2), F.lit("uncertain"), F.lit(1))
    return products(spark, sf_dir).select(source.alias("source")).groupBy("source", rank[F.col("source")].alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PRODUCTS} SELECT product_id, unnest([name, lower(name), upper(name), replace(name, ' ', '-')]) AS variant FROM v_products")
def name_variants(spark, sf_dir):
    n = F.col("name")
    return products(spark, sf_dir).select("product_id", F.explode(F.array(n, F.lower(n), F.upper(n), F.replace(n, F.lit(" "), F.lit("-")))).alias("variant"))


@query(f"SELECT id, array_to_string(list_filter([{', '.join(I.swatches_sql('title'))}], lambda c: c IS NOT NULL), ' ') AS swatches FROM {_T}")
def swatch_hits(spark, sf_dir):
    """Every colour that a title names."""
    return titles(spark, sf_dir).select("id", F.array_join(I.swatches(F.col("title")), " ").alias("swatches"))


@query(f"WITH {OFFERS_WITH_SHOP} SELECT product_id, count(DISTINCT shop_id) AS n FROM v_full GROUP BY 1")
def exact_shop_count(spark, sf_dir):
    return offers_with_shop(spark, sf_dir).groupBy("product_id").agg(F.countDistinct("shop_id").alias("n"))


@query(None)
def approx_distinct_shops(spark, sf_dir):
    """An extension: approximate distinct shops by brand, with partial sketches before the shuffle."""
    return offers(spark, sf_dir).join(products(spark, sf_dir), "product_id").groupBy("brand").agg(F.approx_count_distinct("shop_id", 0.02).alias("shops"))


@query(f"WITH {PRODUCTS} SELECT brand, polymer, grouping_id(brand, polymer) AS level, count(*) AS n FROM v_products GROUP BY GROUPING SETS ((brand), (polymer))")
def facets_grouping_sets(spark, sf_dir):
    p = products(spark, sf_dir)
    return p.groupingSets([[p.brand], [p.polymer]], p.brand, p.polymer).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {OFFERS}, v AS (SELECT product_id, ord, price, lead(price) OVER (PARTITION BY product_id ORDER BY ord) AS next FROM v_offers) SELECT product_id, ord, coalesce(next < price AND next >= price * 0.5, false) AS sale FROM v")
def sale_rival(spark, sf_dir):
    nxt = F.lead("price").over(Window.partitionBy("product_id").orderBy("ord"))
    v = offers(spark, sf_dir).select("product_id", "ord", "price", nxt.alias("next"))
    return v.select("product_id", "ord", F.coalesce((F.col("next") < F.col("price")) & (F.col("next") >= F.col("price") * 0.5), F.lit(False)).alias("sale"))


@query(f"WITH {PRODUCTS}, v AS (SELECT a.product_id, b.product_id AS candidate, abs(a.list_price - b.list_price) AS d FROM v_products a JOIN v_products b ON a.brand = b.brand AND a.color = b.color AND a.product_id <> b.product_id) SELECT product_id, candidate, d FROM v QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY d, candidate) <= 3")
def vision_top3(spark, sf_dir):
    p = products(spark, sf_dir).select("product_id", "brand", "color", "list_price")
    return bases.nearest_values(p, "product_id", ["brand", "color"], "list_price", 3).select("product_id", "candidate", "d")


_CHANGED = "list_transform(embedding, lambda v, i: CASE WHEN (i + vec_id) % 64 < vec_id % 9 THEN -v ELSE v END)"
_COPY = 1 << 40
_HASH_SQL = "list_transform({0}, lambda v: v > list_sort({0})[33])"


@query(f"""WITH h AS (SELECT vec_id, {_HASH_SQL.format('embedding')} AS a, {_HASH_SQL.format(_CHANGED)} AS b FROM embeddings),
 d AS (SELECT x.vec_id AS id, y.vec_id AS candidate, len(list_filter(list_zip(x.a, y.b), lambda z: z[1] <> z[2])) AS distance FROM h x CROSS JOIN h y)
 SELECT id, candidate, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, candidate) AS rank FROM d WHERE distance <= 10) WHERE rank <= 3""")
def picture_top3(spark, sf_dir):
    """The three pictures nearest to each, at most ten bits away: each vector is a picture's 64 values, and its copy has up to eight values changed."""
    e = table(spark, sf_dir, "embeddings")
    odd = F.transform("embedding", lambda v, i: F.when((i + 1 + F.col("vec_id")) % 64 < F.col("vec_id") % 9, -v).otherwise(v))
    left = e.select(F.col("vec_id").alias("id"), V.median_hash(F.col("embedding")).alias("hash"))
    # a copy is another row than its picture, so it may be its candidate
    right = e.select((F.col("vec_id") + _COPY).alias("id"), V.median_hash(odd).alias("hash"))
    return V.near_pictures(left, right).select("id", (F.col("candidate") - _COPY).alias("candidate"), "distance", "rank")


@query(f"SELECT id, {P.polymer_sql('title')} AS polymer, {P.subtype_sql('title')} AS subtype FROM {_T}")
def filament_class(spark, sf_dir):
    return titles(spark, sf_dir).select("id", P.classify(F.col("title")).alias("c")).select("id", "c.polymer", "c.subtype")
