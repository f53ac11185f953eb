"""Conversation structure repair by a higher-order fold in Spark SQL.

The turns of a conversation must have the roles system (at most one, first), then user and
assistant in turn, ending with the assistant: initials (s?(ua)+)?. Windows flag what is wrong
with each turn (blank, a duplicate of an earlier one, cut off in its sentence, a pair of roles
that may not meet). The turns of a conversation are then collected, sorted, and folded: for
each of the four states of the pattern (nothing yet; after s; after u; after a) aggregate()
carries the cheapest way to get there as a struct (cost, audit), and least() picks the
cheaper one, or of equal costs the one whose audit is first in ASCII. Edits are K (keep),
R (role becomes user or assistant), D (delete) and I (insert an empty turn).

Two audits of equal cost for the same turns never begin with one another: the longer one has
more inserts, which cost. So the least of two audits stays the least whatever follows, and
one struct a state is enough. An audit is carried in two parts, all turns up to the last
multiple of BLOCK and those since, so a step adds to a short string and long conversations
don't take time with the square of their turns.

Order: by turn, null first; turns of equal number by role, then text. Nulls in the id or
the turn count as one space in the damage's key, null roles and texts are one space. A null
conv_id is a conversation. Repeated rows are turns like others (the later ones duplicates).
All rows that share a conv_id are one array in one task, as is the answer (one audit, one
digest of the whole text): a conversation must fit in a task, however many conversations
there are; texts of any length go through unread but for their ends. An empty table gives no
rows. Only conv_id, turn, role and text are read, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What parts words; a text of these alone is blank.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Turns whose edits are carried as one string.
BLOCK = 256
START, SYSTEM, USER, ASSISTANT = "start", "system", "user", "assistant"
STATES = (START, SYSTEM, USER, ASSISTANT)
#: More than any way costs that exists.
NEVER = 1 << 60


@dataclass(frozen=True)
class Costs:
    """What edits cost; truncated: added for a truncated turn that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of the turns after damage, which depends on crc32("conv_id:turn") % 20.

    0: dropped (the row stays, flagged, so its conversation is not lost), 1: empty text,
    2: without sentence ends, 3: twice, 4: role user.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    slim = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, USER).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return slim.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("copy")).drop("copy")


def flagged(turns: DataFrame) -> DataFrame:
    """turns with `nth` (how often role and text have been said), `fault` (its first: blank, duplicate, truncated,
    else null) and `illegal` (whether its role may not follow that of the turn before); dropped rows have neither."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # one exchange by conversation serves both windows and the collecting after them
    here = Window.partitionBy("conv_id", "dropped").orderBy(*order)
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    pair = F.concat(F.substring(F.lag("role").over(here), 1, 1), F.substring("role", 1, 1))
    fault = F.when(end == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(end, F.lit(1)).isin(*ENDS), "truncated")
    return turns.repartition("conv_id").withColumn("nth", F.row_number().over(same)).select(
        "*",
        F.when(~F.col("dropped"), fault).alias("fault"),
        # the first turn has no pair
        (~F.col("dropped") & (F.row_number().over(here) > 1) & ~pair.isin("su", "ua", "au")).alias("illegal"),
    )


def _way(cost: Column, head: Column, tail: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), head.alias("head"), tail.alias("tail"))


def _by(way: Column, cost: Column | int, edit: str) -> Column:
    """A way with one more edit."""
    return _way(way["cost"] + cost, way["head"], F.concat(way["tail"], F.lit(edit)))


def _states(**ways: Column) -> Column:
    return F.struct(*[ways[s].alias(s) for s in STATES])


def with_inserts(at: Column, costs: Costs) -> Column:
    """The states reached when turns may be inserted here. More than two never help."""
    user = F.least(at[USER], *[_by(at[s], costs.insert, "I") for s in (START, SYSTEM, ASSISTANT)])
    return let(user, lambda u: _states(start=at[START], system=at[SYSTEM], user=u, assistant=F.least(at[ASSISTANT], _by(u, costs.insert, "I"))))


def with_turn(at: Column, turn: Column, costs: Costs) -> Column:
    """The states reached by the edits of one turn."""
    must_go = turn["fault"].isin("blank", "duplicate")
    stays = F.when(turn["fault"] == "truncated", costs.truncated).otherwise(0)

    def kept(way: Column, initial: str) -> Column:
        fits = ~F.coalesce(must_go, F.lit(False)) & (F.substring(turn["role"], 1, 1) == initial)
        return _by(way, F.when(fits, stays).otherwise(NEVER), "K")

    def reroled(way: Column) -> Column:
        return _by(way, F.when(F.coalesce(must_go, F.lit(False)), NEVER).otherwise(stays + costs.rerole), "R")

    gone = {s: _by(at[s], costs.delete, "D") for s in STATES}
    before_user = (START, SYSTEM, ASSISTANT)
    return _states(
        start=gone[START],
        system=F.least(gone[SYSTEM], kept(at[START], "s")),
        user=F.least(gone[USER], *[kept(at[s], "u") for s in before_user], *[reroled(at[s]) for s in before_user]),
        assistant=F.least(gone[ASSISTANT], kept(at[USER], "a"), reroled(at[USER])),
    )


def cheapest(turns: Column, costs: Costs) -> Column:
    """The cheapest edits of an array of turns (place, role, fault): struct (cost, audit)."""
    none = _way(F.lit(NEVER), F.lit(""), F.lit(""))
    begin = _states(start=_way(F.lit(0), F.lit(""), F.lit("")), system=none, user=none, assistant=none)

    def bounded(way: Column, turn: Column) -> Column:
        full = turn["place"] % BLOCK == BLOCK - 1
        head = F.when(full, F.concat(way["head"], way["tail"])).otherwise(way["head"])
        return _way(F.least(way["cost"], F.lit(NEVER)), head, F.when(full, "").otherwise(way["tail"]))

    def step(acc: Column, turn: Column) -> Column:
        reached = let(with_inserts(acc, costs), lambda at: with_turn(at, turn, costs))
        return let(reached, lambda at: _states(**{s: bounded(at[s], turn) for s in STATES}))

    def best(acc: Column) -> Column:
        way = F.least(acc[START], with_inserts(acc, costs)[ASSISTANT])
        return let(way, lambda w: F.struct(w["cost"].alias("cost"), F.concat(w["head"], w["tail"]).alias("audit")))

    return F.aggregate(turns, begin, step, best)


def repaired(turns: Column, audit: Column) -> Column:
    """The lines role:text that an audit makes of an array of turns, one after the other.

    What the pattern says of the roles is all that has to be known of those that are not kept:
    after the system turn, if there is one, user and assistant take turns.
    """
    letters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    stay = F.filter(F.arrays_zip(turns.alias("turn"), letters(F.translate(audit, "I", "")).alias("edit")), lambda x: x["edit"] != "D")
    made = F.transform(letters(F.translate(audit, "D", "")), lambda c, i: F.struct(i.alias("at"), c.alias("edit")))

    def lines(x: Column) -> Column:
        first = F.get(x["stay"], F.lit(0))
        system = ((F.get(x["made"], F.lit(0))["edit"] == "K") & (F.substring(first["turn"]["role"], 1, 1) == "s")).cast("int")
        due = lambda at: F.when((at - F.coalesce(system, F.lit(0))) % 2 == 0, USER).otherwise(ASSISTANT)
        own = F.zip_with(
            x["stay"],
            F.filter(x["made"], lambda m: m["edit"] != "I"),
            lambda s, m: F.struct(m["at"].alias("at"), F.concat(F.when(s["edit"] == "K", s["turn"]["role"]).otherwise(due(m["at"])), F.lit(":"), s["turn"]["text"]).alias("line")),
        )
        new = F.transform(F.filter(x["made"], lambda m: m["edit"] == "I"), lambda m: F.struct(m["at"].alias("at"), F.concat(due(m["at"]), F.lit(":")).alias("line")))
        return F.array_join(F.transform(F.array_sort(F.concat(own, new)), lambda y: y["line"]), "\n")

    return let(F.struct(stay.alias("stay"), made.alias("made")), lines)


def gaps_of(numbers: Column) -> Column:
    """How many numbers between the least and the greatest are not there."""
    return F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long")


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row for each conv_id of turns (conv_id, turn, role, text, dropped): counts of faults, cost, audit and the repaired text."""
    stays = ~F.col("dropped")
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    found = flagged(turns).groupBy("conv_id").agg(
        count("blank"), count("duplicate"), count("truncated"),
        F.count_if("illegal").alias("illegal"),
        F.sort_array(F.collect_list(F.when(stays, F.struct("turn", "role", "text", "nth", "fault")))).alias("turns"),
    )
    placed = F.transform("turns", lambda t, i: F.struct(i.alias("place"), t["role"].alias("role"), t["text"].alias("text"), t["fault"].alias("fault")))
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())
    judged = found.withColumns({"numbers": numbers, "turns": placed}).select("*", F.inline(F.array(cheapest(F.col("turns"), costs))))
    return judged.select("conv_id", gaps_of(F.col("numbers")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", repaired(F.col("turns"), F.col("audit")).alias("repaired"))


def op11_turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, its cheapest repair and the digest of what that gives."""
    found = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return found.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ascii(substr({0}, i::INT, 1))::BIGINT)),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))"""

#: The same in DuckDB: crc32 by its table, the fold as a recursion over turns, the repaired text by windows over the audit.
OP11_SQL = f"""
WITH RECURSIVE steps AS (SELECT i, i AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS crc FROM steps WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor({_CRC.format("k")}, 4294967295) % 20 AS kind FROM keyed, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM kinds) WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
      FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)),
f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS r, CASE WHEN t = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
      i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM f GROUP BY 1),
w AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS w0, {{'c': 1000000000::BIGINT, 'a': ''}} AS ws, {{'c': 1000000000::BIGINT, 'a': ''}} AS wu, {{'c': 1000000000::BIGINT, 'a': ''}} AS wa FROM c
  UNION ALL
  SELECT conv_id, i, {{'c': w0.c + 2, 'a': w0.a || 'D'}},
    list_min([{{'c': ws.c + 2, 'a': ws.a || 'D'}}, {{'c': w0.c + keep_s, 'a': w0.a || 'K'}}]),
    list_min([{{'c': nu.c + 2, 'a': nu.a || 'D'}}, {{'c': w0.c + keep_u, 'a': w0.a || 'K'}}, {{'c': ws.c + keep_u, 'a': ws.a || 'K'}}, {{'c': na.c + keep_u, 'a': na.a || 'K'}},
              {{'c': w0.c + rerole, 'a': w0.a || 'R'}}, {{'c': ws.c + rerole, 'a': ws.a || 'R'}}, {{'c': na.c + rerole, 'a': na.a || 'R'}}]),
    list_min([{{'c': na.c + 2, 'a': na.a || 'D'}}, {{'c': nu.c + keep_a, 'a': nu.a || 'K'}}, {{'c': nu.c + rerole, 'a': nu.a || 'R'}}])
  FROM (SELECT *, list_min([wa, {{'c': nu.c + 5, 'a': nu.a || 'I'}}]) AS na FROM (
    SELECT w.conv_id, f.i, w0, ws, wa, list_min([wu, {{'c': w0.c + 5, 'a': w0.a || 'I'}}, {{'c': ws.c + 5, 'a': ws.a || 'I'}}, {{'c': wa.c + 5, 'a': wa.a || 'I'}}]) AS nu,
      (CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END) AS stay,
      stay + CASE WHEN r = 's' THEN 0 ELSE 1000000000 END AS keep_s, stay + CASE WHEN r = 'u' THEN 0 ELSE 1000000000 END AS keep_u, stay + CASE WHEN r = 'a' THEN 0 ELSE 1000000000 END AS keep_a, stay + 1 AS rerole
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
e AS (SELECT c.*, list_min([w0, wa, {{'c': wu.c + 5, 'a': wu.a || 'I'}}]) AS best FROM c JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n),
x AS (SELECT conv_id, p, substr(best.a, p::INT, 1) AS edit FROM (SELECT conv_id, best, unnest(range(1, strlen(best.a) + 1)) AS p FROM e)),
y AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS m FROM x),
z AS (SELECT y.*, f.role, f.text, max(CASE WHEN m = 1 AND edit = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS s
      FROM y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.i = y.i AND edit <> 'I'),
l AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said
      FROM z WHERE edit <> 'D' GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM a.conv_id
"""
