"""Queries on the baseline: normal forms by locale, axes, verdicts, allowed identities, the board's matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions import identity as I
from shelfwise.functions import similarity as L
from shelfwise.functions import text as T
from shelfwise.operators import baseline as B
from shelfwise.operators import identity as D
from shelfwise.plans.base import collection
from shelfwise.plans.decisions import _HIT
from shelfwise.plans.titles import _T, listings, titles
from shelfwise.operators import offers as O
from shelfwise.sources.dictionary import dictionary
from shelfwise.sources.views import OFFERS, offers

QUERIES, ORACLES, query = collection()

_LOOKUP = f"""{_HIT}, x AS (SELECT v.id, v.title, v.kind, b.brand_id AS brand, m.model, f.feeder FROM {_T} LEFT JOIN b ON b.tid = v.id LEFT JOIN m ON m.tid = v.id AND m.brand_id = b.brand_id LEFT JOIN f ON f.tid = v.id AND f.brand_id = b.brand_id),
 a AS (SELECT *, {B.combo_sql('title', 'feeder')} AS combo, {I.kit_form_sql('title')} AS kit FROM x),
 r AS (SELECT d.id AS row_model, d.brand_id AS row_brand, c.combo AS row_combo, CASE WHEN d.id LIKE '%-%' THEN 'official' ELSE 'tracker' END AS source, d.brand_id || '/' || d.id || '/' || c.combo AS identity FROM dict d, (VALUES ('bare'), ('combo')) c(combo) WHERE d.role = 'model')"""


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with brand, model, feeder, combo and kit."""
    found = D.lookup(titles(spark, sf_dir), "title", dictionary(spark), "id")
    return B.axes(found)


@query(f"SELECT id, {T.normalize_sql('title')} AS normal FROM {_T}")
def normalize_locale(spark, sf_dir):
    return titles(spark, sf_dir).select("id", T.normalize(F.col("title")).alias("normal"))


@query(f"SELECT id, {T.foldings_sql('title')[0]} AS stock, {T.foldings_sql('title')[1]} AS name FROM {_T}")
def fold_variants(spark, sf_dir):
    """The fold that keeps punctuation, and the one that keeps letters and digits only."""
    stock, name = T.foldings(F.col("title"))
    return titles(spark, sf_dir).select("id", stock.alias("stock"), name.alias("name"))


@query(f"SELECT id, {B.generic_core_sql('title')} AS core FROM {_T}")
def generic_core(spark, sf_dir):
    """A model's name where the dictionary knows no maker."""
    return titles(spark, sf_dir).select("id", B.generic_core(F.col("title")).alias("core"))


@query(f"SELECT id, {B.aisle_sql('title', 'kind')} AS aisle FROM {_T}")
def taxonomy(spark, sf_dir):
    return titles(spark, sf_dir).select("id", B.aisle(F.col("title"), F.col("kind")).alias("aisle"))


@query(f"WITH {_LOOKUP[5:]} SELECT id, coalesce(brand, '') AS brand, coalesce(model, '') AS core, combo, coalesce(feeder, '') AS feeder, kit FROM a")
def baseline_axes(spark, sf_dir):
    empty = F.lit("")
    return looked_up(spark, sf_dir).select("id", F.coalesce("brand", empty).alias("brand"), F.coalesce("model", empty).alias("core"), "combo", F.coalesce("feeder", empty).alias("feeder"), "kit")


@query(f"WITH {_LOOKUP[5:]} SELECT id, brand IS NOT NULL AND model IS NOT NULL AS complete, {T.fold_sql('title')} = '' AS blank FROM a")
def title_identity(spark, sf_dir):
    """Titles that name a maker and a model need no one to read them."""
    x = looked_up(spark, sf_dir)
    return x.select("id", (F.col("brand").isNotNull() & F.col("model").isNotNull()).alias("complete"), (T.fold(F.col("title")) == "").alias("blank"))


@query(f"WITH {_LOOKUP[5:]} SELECT id, CASE WHEN kind = 'filament' THEN coalesce(brand, '') || '|' || {I.color_of_sql('title')} || '|' || {I.grams_sql('title')} ELSE coalesce(brand, '') || '|' || coalesce(model, '') || '|' || combo || CASE WHEN combo = 'combo' AND feeder IS NOT NULL THEN '|' || feeder ELSE '' END END AS key FROM a")
def match_keys(spark, sf_dir):
    """Keys under which shops' listings of one product meet, by kind."""
    return looked_up(spark, sf_dir).select("id", B.match_key().alias("key"))


@query(f"""WITH {_LOOKUP[5:]}, j AS (SELECT a.*, r.identity, r.source, (combo <> row_combo)::int AS n FROM a LEFT JOIN r ON row_brand = brand AND row_model = model),
 w AS (SELECT *, lead(n) OVER q AS next_n, row_number() OVER q AS rn FROM j WINDOW q AS (PARTITION BY id ORDER BY n, source, identity))
 SELECT id, CASE WHEN {B.like_sql('title')} OR brand IS NULL OR model IS NULL THEN 'unknown' WHEN n > 0 OR coalesce(next_n = n, false) THEN 'hold' ELSE 'match' END AS status,
  CASE WHEN NOT {B.like_sql('title')} AND model IS NOT NULL THEN identity END AS identity FROM w WHERE rn = 1""")
def baseline_verdict(spark, sf_dir):
    """match, hold or unknown for each title, and the baseline row it is about."""
    return B.verdicts(looked_up(spark, sf_dir), B.baseline_rows(dictionary(spark))).select("id", "status", "identity")


@query(f"""WITH {_LOOKUP[5:]}, i AS (SELECT id, brand || '/' || model || '/' || combo AS identity FROM a WHERE brand IS NOT NULL AND model IS NOT NULL), s AS (SELECT identity, min(id) AS row_id FROM i GROUP BY 1)
 SELECT i.id, i.identity, s.row_id FROM i JOIN s USING (identity)""")
def identity_join(spark, sf_dir):
    """Confirmed identities joined to the catalogue row (the first) that has them."""
    i = looked_up(spark, sf_dir).where("brand is not null and model is not null").select("id", F.concat_ws("/", "brand", "model", "combo").alias("identity"))
    rows = i.groupBy("identity").agg(F.min("id").alias("row_id"))
    return i.join(rows, "identity").select("id", "identity", "row_id")


@query(f"""WITH {_LOOKUP[5:]}, s AS (SELECT id, identity, (row_model = model)::int * 2 + (row_combo = combo)::int AS score FROM a JOIN r ON row_brand = brand),
 rk AS (SELECT id, identity, row_number() OVER (PARTITION BY id ORDER BY coalesce(score, 0) DESC, identity) AS rank FROM s) SELECT id, string_agg(identity, ' ' ORDER BY rank) AS allowed FROM rk WHERE rank <= 8 GROUP BY 1""")
def allowed_ids(spark, sf_dir):
    """The closed list of identities (eight at most, the feature's limit) that an answer about a listing may name."""
    return B.allowed(looked_up(spark, sf_dir), B.baseline_rows(dictionary(spark))).select("id", "allowed")


@query(None)
def board_match(spark, sf_dir):
    """The board item that each listing merges into: of its kind, the best ranked, if the decision is a merge."""
    t = listings(spark, sf_dir)
    board, rest = t.where("id % 5 = 1"), t.where("id % 5 != 1")
    best = D.ranked(D.blocked_pairs(rest, board), rest, board, 1)
    kinds = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), F.col("kind").alias(f"{p}_kind"))
    return best.where("action = 'merge'").join(kinds(rest, "l"), "l_id").join(kinds(board, "r"), "r_id").where("l_kind = r_kind").select("l_id", "r_id", "score")


@query(None)
def rematch_batch(spark, sf_dir):
    """A batch of cards matched again against the board: what the scorer's gate says of the best without a conflict, nothing published."""
    t = listings(spark, sf_dir)
    board, cards = t.where("id % 5 = 1"), t.where("id % 5 = 2")
    judged = D.judged(D.blocked_pairs(cards, board), cards, board).where("reason != 'conflict'")
    best = judged.groupBy("l_id").agg(F.max_by(F.struct("r_id", "score", "action"), F.struct("score", -F.col("r_id"))).alias("b"))
    act = D.scorer_gate(F.col("b.score"), F.lit(False), F.col("b.action") == "merge")
    found = cards.select(F.col("id").alias("l_id")).join(best.select("l_id", act.alias("act"), F.concat(F.lit("baseline:"), F.col("b.r_id").cast("string")).alias("target")), "l_id", "left")
    return found.select("l_id", F.coalesce("act", F.lit("create")).alias("act"), F.when(F.col("act") == "merge", F.col("target")).alias("target"))


@query(None)
def compare_two(spark, sf_dir):
    """Neighbouring listings compared: the better of the scores of the titles as they are and as normalised, and the decision."""
    t = titles(spark, sf_dir).select("id", "title", I.features(F.col("title"), F.col("kind"), F.col("brand")).alias("f"), L.title_words(T.normalize(F.col("title"))).alias("w"))
    a, b = t.select("id", F.col("f").alias("fa"), F.col("w").alias("wa")), t.select((F.col("id") - 1).alias("id"), F.col("f").alias("fb"), F.col("w").alias("wb"))
    both = a.join(b, "id").withColumn("normal_score", L.words_score(F.col("wa"), F.col("wb"))).drop("wa", "wb")
    return I.decided(both, "fa", "fb").select("id", "action", "reason", F.greatest("score", "normal_score").alias("score"))


@query(f"WITH {_LOOKUP[5:]} SELECT brand, count(*) AS n, count(DISTINCT model) AS models, count(*) FILTER (combo = 'combo') AS combos FROM a GROUP BY 1")
def brand_overview(spark, sf_dir):
    return looked_up(spark, sf_dir).groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("models"), F.count_if(F.col("combo") == "combo").alias("combos"))


@query(f"WITH {_LOOKUP[5:]}, k AS (SELECT *, {T.title_rules_sql('title')} AS t FROM a WHERE title IS NOT NULL), g AS (SELECT t, count(DISTINCT coalesce(brand, '')) AS brands, count(DISTINCT kit) AS kits, min(id) AS keeper FROM k GROUP BY 1) SELECT id, CASE WHEN brands > 1 OR kits > 1 THEN id ELSE keeper END AS keeper FROM k JOIN g USING (t)")
def title_collapse(spark, sf_dir):
    """Rows of one normal title made one, unless rows of the title conflict."""
    k = looked_up(spark, sf_dir).where("title is not null").select("id", T.title_rules(F.col("title")).alias("t"), F.coalesce("brand", F.lit("")).alias("b"), "kit")
    g = k.groupBy("t").agg(F.countDistinct("b").alias("brands"), F.countDistinct("kit").alias("kits"), F.min("id").alias("keeper"))
    return k.join(g.hint("merge"), "t").select("id", F.when((F.col("brands") > 1) | (F.col("kits") > 1), F.col("id")).otherwise(F.col("keeper")).alias("keeper"))


@query(f"""WITH {_LOOKUP[5:]}, p AS (SELECT x.kind, x.brand IS NOT DISTINCT FROM y.brand AND x.model IS NOT DISTINCT FROM y.model AND x.combo = y.combo AS truth, {T.title_rules_sql('x.title')} = {T.title_rules_sql('y.title')} AS said FROM a x JOIN a y ON y.id = x.id + 19)
 SELECT kind, count(*) AS n, avg((truth = said)::int) AS accuracy, count(*) FILTER (NOT truth AND said) AS false_merge, count(*) FILTER (truth AND NOT said) AS false_split FROM p WHERE said IS NOT NULL GROUP BY 1""")
def confusion(spark, sf_dir):
    """How often equal normal titles tell that two listings are of one model: accuracy, false merges, false splits by kind."""
    a = looked_up(spark, sf_dir).select("id", "kind", F.struct("brand", "model", "combo").alias("x"), T.title_rules(F.col("title")).alias("t"))
    b = a.select((F.col("id") - 19).alias("id"), F.col("x").alias("y"), F.col("t").alias("u"))
    same = F.col("x.brand").eqNullSafe(F.col("y.brand")) & F.col("x.model").eqNullSafe(F.col("y.model")) & (F.col("x.combo") == F.col("y.combo"))
    p = a.join(b.hint("merge"), "id").select("kind", same.alias("truth"), (F.col("t") == F.col("u")).alias("said"))
    right = (F.col("truth") == F.col("said")).cast("int")
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.count_if(~F.col("truth") & F.col("said")).alias("false_merge"), F.count_if(F.col("truth") & ~F.col("said")).alias("false_split"))


@query(f"WITH {_LOOKUP[5:]} SELECT id, count(*) OVER (PARTITION BY brand, model, combo) AS twins FROM a WHERE brand IS NOT NULL AND model IS NOT NULL")
def twin_counts(spark, sf_dir):
    """Listings of one identity, counted for each of them."""
    x = looked_up(spark, sf_dir).where("brand is not null and model is not null")
    return x.select("id", F.count(F.lit(1)).over(Window.partitionBy("brand", "model", "combo")).alias("twins"))


@query(f"WITH {OFFERS}, live AS (SELECT DISTINCT product_id AS id FROM v_offers WHERE price > 0 AND stock <> 'out_of_stock'), x AS (SELECT id, {B.aisle_sql('title', 'kind')} AS aisle FROM {_T}) SELECT aisle, count(*) AS n FROM x SEMI JOIN live USING (id) GROUP BY 1")
def aisle_facet(spark, sf_dir):
    """Sellable products by aisle; an aisle without one is not shown."""
    live = offers(spark, sf_dir).where(O.is_live(F.col("price"), F.col("stock"))).select(F.col("product_id").alias("id"))
    return titles(spark, sf_dir).join(live, "id", "left_semi").groupBy(B.aisle(F.col("title"), F.col("kind")).alias("aisle")).agg(F.count(F.lit(1)).alias("n"))
