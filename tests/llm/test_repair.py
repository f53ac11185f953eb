import hashlib
import itertools
import random
import re
import zlib

import duckdb
from helpers import clashing

from shelfwise.llm import repair
from shelfwise.llm.repair import Costs

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
TEXTS = ["Yes.", "No!", "cut off", "cut off", " \t\n", "", None, "Ça va ?  ", "中文。", "a.b c ", "end.\x0b\r"]


def table(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(conversations)]:
        for t in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([None, t, t, t, t + 2]), rng.choice(ROLES), rng.choice(TEXTS)))
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    return rows


def after_damage(rows):
    """conv_id: its (turn, role, text), sorted."""
    out = {}
    for c, t, role, text in rows:
        turns = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(turns, costs):
    """All edits, with up to two inserts in each gap and every choice of roles."""
    best = None
    per_turn = []
    for (_, role, text), fault in zip(turns, faults(turns), strict=True):
        late = costs.truncated if fault == "truncated" else 0
        ways = [(costs.delete, "D", "", None)]
        if fault not in ("blank", "duplicate"):
            ways += [(late, "K", role[:1] or "-", f"{role}:{text}")] + [(late + costs.rerole, "R", r[0], f"{r}:{text}") for r in ("user", "assistant")]
        per_turn.append(ways)
    one = [(costs.insert, "I", r[0], f"{r}:") for r in ("user", "assistant")]
    gap = [[], *[[x] for x in one], *[[x, y] for x in one for y in one]]
    for ways in itertools.product(*per_turn):
        for gaps in itertools.product(gap, repeat=len(turns) + 1):
            edits = [x for g, w in itertools.zip_longest(gaps, ways) for x in [*g, *([w] if w else [])]]
            if re.fullmatch("(s?(ua)+)?", "".join(e[2] for e in edits)):
                found = sum(e[0] for e in edits), "".join(e[1] for e in edits), "\n".join(e[3] for e in edits if e[3] is not None)
                best = min(best, found) if best else found
    return best


def test_edits_against_all_edits(spark):
    for costs, seed in ((Costs(), 1), (Costs(insert=1, delete=4), 2), (Costs(insert=1, delete=3, rerole=3, truncated=0), 3)):
        rows = table(seed, 25, 4)
        want = after_damage(rows)
        got = {r.conv_id: r for r in repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3)), costs).collect()}
        assert set(got) == set(want)
        checked = 0
        for c, turns in want.items():
            r, found = got[c], faults(turns)
            numbers = [t for t, _, _ in turns if t is not None]
            initials = [role[:1] for _, role, _ in turns]
            assert (r.blank, r.duplicate, r.truncated) == tuple(found.count(x) for x in ("blank", "duplicate", "truncated"))
            assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
            assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
            if len(turns) <= 4:
                assert (r.cost, r.audit, r.repaired) == brute(turns, costs), (c, turns)
                checked += 1
        assert checked > 15


def in_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({repair.OP11_SQL})").fetchall()


def thin(spark, rows, monkeypatch):
    frame = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3)).withColumnRenamed("x", "turns").withColumnRenamed("y", "audit")
    monkeypatch.setattr(type(spark.read), "parquet", lambda *a: frame)
    try:
        return [tuple(r) for r in repair.op11_turn_fold(spark, "").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    finally:
        monkeypatch.undo()


def test_long_conversations_and_sql(spark, monkeypatch):
    rng = random.Random(5)
    rows = table(4, 120, 12)
    # one conversation holds more turns than all others, far more than are carried as one string
    rows += [(1000, t, rng.choice(ROLES[:5]), rng.choice([f"{t}.", f"{t}!", f"{t}", "again."])) for t in range(3 * repair.BLOCK + 7)]
    key = lambda r: (r[0] is not None, r)
    got = thin(spark, rows, monkeypatch)
    assert sorted(got, key=key) == sorted(in_sql(rows), key=key)
    assert max(len(r[7]) for r in got) > 3 * repair.BLOCK


def test_nothing_left_and_nothing_there(spark, monkeypatch):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert thin(spark, [(dropped, 0, "user", "Hi.")], monkeypatch) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert thin(spark, [], monkeypatch) == []
