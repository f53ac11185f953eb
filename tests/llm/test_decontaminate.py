import random
import re
from collections import Counter

import duckdb
from helpers import clashing, frame, prose

from shelfwise.llm import decontaminate as D

ITEM = "If Ann buys 2 kg of fresh apples for 10 dollars and Joe gets 5 kg of them, what does Ann pay in all?"


def found(spark, docs, items):
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.exact, round(r.coverage, 2)) for r in D.contaminated(clashing(frame(spark, [(i, t, "en", "s", 0) for i, t in docs])), items).collect()}


def test_parameters_names_and_units(spark):
    docs = [
        (1, "Well. If Tom Smith buys 3.5 kg of fresh apples for 1,020 dollars and Mary gets 7 kg of them, what does Tom Smith pay in all? Yes."),
        (2, "junk " * 50 + ITEM + " more"),
        (3, "if Bob buys 4 kg of fresh apples for 4 dollars and Eve gets 9 kg of them, what does Eve pay in all?"),  # slots do not fit
        (4, ITEM.upper()), (5, None), (6, ""), (7, "fresh apples for 10 dollars"), (None, ITEM),
    ]
    got = found(spark, docs, [(1, ITEM), (2, None), (3, ""), (4, "too short one")])
    assert got[1, 1] == (False, 1.0) and got[2, 1] == (True, 0.93) and (None, 1) in got
    assert not {k for k in got if k[0] in (3, 5, 6, 7) or k[1] != 1}


def test_every_planted_item_is_found_and_nothing_else(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([5, 6, 7, 8, 9, 30, 60])) + ".") for i in range(30)]
    docs, want = [], set()
    for d in range(120):
        text = prose(rng, rng.randrange(1, 80))
        if d % 3 == 0:
            i = rng.randrange(30)
            text = text + " " + items[i][1] + " " + prose(rng, 20)
            want.add((d, i))
        docs.append((d, text))
    assert set(found(spark, docs, items)) == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM)]) == {} and found(spark, [(1, ITEM)], []) == {}


def test_slots_join_neighbours():
    t = D.Templates([b"We saw Mary Ann Smith pay 1,200.50 euros and Bob ran 5 m. m"])
    assert t.template(0, len(t.kind))[0] == "we saw {name} pay {number} {unit} and {name} ran {number} {unit} m"


def test_coincident_values_and_one_odd_slot(spark):
    thrice = ITEM + " Then Ann walks 3 miles home with all of the fresh apples that were left over."
    other = thrice.replace("Ann", "Eve").replace("Joe", "Bob")
    docs = [
        (1, ITEM.replace("2 kg", "4 kg").replace("10 dollars", "4 dollars")),  # two numbers become one
        (2, thrice.replace("does Ann", "does Zoe")),  # verbatim but for one of three
        (3, other.replace("does Eve", "does Zoe")),  # other names, one of three odd
        (4, ITEM.replace("does Ann", "does Zoe")),  # verbatim but for one of two
    ]
    assert set(found(spark, docs, [(1, ITEM)])) >= {(1, 1), (4, 1)}
    assert {k[0] for k in found(spark, docs, [(2, thrice)])} >= {2, 3}


def test_items_of_numbers_and_names(spark):
    odd = "Add 3 to 17 and 4 to 28 and 9."  # under half its tokens literal
    docs = [
        (1, "Well. Add 3 to 17 and 4 to 28 and 9. Done."), (2, "Now add 5 to 11 and 6 to 70 and 2, they said."), (3, "Add 5 to 11."),
        (4, "What is zinc? It is a metal."), (5, "They asked what is zinc and left."), (6, "7, 8, 12, 13, 14"), (7, "1, 2, 3, 4, 5"),
    ]
    got = found(spark, docs, [(1, odd), (2, "What is zinc?"), (3, "7 8 12 13 14")])
    assert got == {(1, 1): (True, 1.0), (2, 1): (False, 1.0), (4, 2): (True, 1.0), (6, 3): (True, 1.0)}


def test_phrases_that_many_items_share(spark):
    rng = random.Random(3)
    head = "which of the following statements about the matter at hand is true"
    items = [(i, f"{head} {prose(rng, 14)}.") for i in range(60)]
    docs = [(i, f"{prose(rng, 20)}. {items[i][1]} {prose(rng, 9)}") for i in range(40)] + [(100 + i, f"{head} {prose(rng, 30)}") for i in range(20)]
    assert set(found(spark, docs, items)) == {(i, i) for i in range(40)}


def test_names_of_any_script_and_short_items(spark):
    reds = "Bir gün Öykü 3 kırmızı elma aldı ve sonra Öykü 4 elma daha aldı. Kaç elma var?"
    docs = [
        (1, reds.replace("Öykü", "Şule").replace("3", "8").replace("4", "6")), (2, reds.replace("Öykü", "İpek").replace("3", "5")),
        (3, "Раз у Ивана было 5 груш и ещё у Ивана было 2 сливы, сколько всего?"), (4, "Compute: 4 + 7 = ? Quick."), (5, "4 + 7 = ?"), (6, "4 - 7 = ?"), (7, "we know 4 + 7 = 11"),
        (8, "Is 4 + 7 = 11?"), (9, "(4 + 7) = ?"), (10, "Double 9!"), (11, "They double 9 things."), (12, "Line\n12 + 12 = ?\nline"),
    ]
    items = [(1, reds), (3, "Раз у Ольги было 7 груш и ещё у Ольги было 3 сливы, сколько всего?"), (4, "12 + 30 = ?"), (5, "Double 4."), (6, "11 12 13")]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (12, 4), (10, 5)}


def test_recall_of_items_with_other_parameters(spark):
    """Every benchmark item with slots put in, found by copies with other values; and by no other document."""
    rng = random.Random(11)
    names, units = "Ann Öykü Bob Şule Иван Eve Zoe Łukasz Åsa Tom".split(), "kg m dollars hours".split()
    items, docs = [], []
    for i, text in duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.01/benchmark.parquet'").fetchall():
        words, slots = text.split(" "), []
        for at in range(rng.randrange(2, 5), len(words), rng.randrange(5, 8)):
            slots.append((at, rng.choice(["number", "name", "unit"]), rng.randrange(3)))

        def filled(words=words, slots=slots):
            chosen = rng.sample(names, 3), rng.sample(range(2, 99), 3), rng.sample(units, 3)
            out = words[:]
            for at, kind, k in slots:
                out[at] = {"name": f"und {chosen[0][k]}", "number": str(chosen[1][k]), "unit": f"{chosen[1][k]} {chosen[2][k]}"}[kind]
            return " ".join(out)

        items.append((i, filled()))
        docs += [(100 * i + k, f"{prose(rng, 9)}. {filled()} {prose(rng, 9)}") for k in range(3)] + [(100 * i + 50, prose(rng, 60) + f" and {rng.choice(names)} had 3 kg.")]
    got = set(found(spark, docs, items))
    want = {(i, i // 100) for i, _ in docs if i % 100 < 50}
    assert got <= want and len(got) >= 0.9 * len(want)


UNITS = set(D.UNITS)


def slow_tokens(text):
    """(kind, template, value, opens, marks before, marks after) by plain loops."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    out, last = [], None
    for k, (a, b) in enumerate(words):
        w, gap = text[a:b], text[words[k - 1][1] if k else 0 : a]
        opens = not k or any(c in '.!?:;|"\n' for c in gap)
        kind = "lit"
        if re.fullmatch("[0-9]+", w):
            kind = "number"
        elif len(w) > 1 and w[0].isupper() and (w[1].islower() or ord(w[1]) >= 128 and not w[1].isupper()) and not opens:
            kind = "name"
        elif last == "number" and w.lower() in UNITS:
            kind = "unit"
        joined = k and last == kind and (kind == "number" and gap in (".", ",") or kind == "name" and gap == " ")
        last = kind
        if joined:
            out[-1][2] = text[out[-1][6] : b].lower()
            out[-1][7] = b
        else:
            out.append([kind, w.lower() if kind == "lit" else "{" + kind + "}", w.lower(), opens, "", "", a, b])
    ends = lambda s: re.split(r'[.!?:;|"\n]', s)
    bare = lambda s: re.sub(r"[\x20\x09-\x0D]", "", s)
    for k, t in enumerate(out):
        t[4] = bare(ends(text[out[k - 1][7] if k else 0 : t[6]])[-1])
        t[5] = bare(ends(text[t[7] : out[k + 1][6] if k + 1 < len(out) else len(text)])[0])
    return out


def slow_windows(tokens, width, made):
    """place: (window's text, slots) of every run of width tokens."""
    out = {}
    for at in range(len(tokens) - width + 1):
        run = tokens[at : at + width]
        slots = [] if made == "words" else [(at + j, t[0], t[2].split()[-1] if t[0] == "name" else t[2]) for j, t in enumerate(run) if t[0] != "lit"]
        alone = run[0][3] and (at + width == len(tokens) or tokens[at + width][3])
        if alone or not (width < 5 or made == "marked"):
            said = [t[2] if made == "words" else t[1] for t in run]
            if made == "marked":
                said += [run[0][4], *["".join(re.split(r'[.!?:;|"\n]', x[5])) for x in run]]
            out[at] = (tuple(said), slots)
    return out


def slow_leaks(doc, item):
    d, t = slow_tokens(doc), slow_tokens(item)
    if not t:
        return False
    n, width, literal = len(t), min(len(t), 8), sum(x[0] == "lit" for x in t)
    parts = {a: t[a : a + width] for a in range(n - width + 1)}
    thin = {a for a, run in parts.items() if 2 * sum(x[0] == "lit" for x in run) < width or n < 5}
    ways = []
    if len(thin) < len(parts):
        ways.append(("plain", width, set(parts) - thin))
    else:
        ways.append(("words", width, thin))
        if n >= 5 and literal >= 3:
            ways.append(("plain", n, {0}))
        if literal < n and (literal or any(x[4] + x[5] for x in t)):
            ways.append(("marked", n, {0}))
    for made, width, places in ways:
        of_doc = slow_windows(d, width, made)
        mine = {a: w for a, w in slow_windows([[*x[:3], a == 0 or x[3], *x[4:]] for a, x in enumerate(t)], width, made).items()} if made != "words" else {a: (tuple(x[2] for x in t[a : a + width]), []) for a in places}
        mine = {a: mine.get(a) or slow_windows(t, width, made).get(a) for a in places}
        for shift in range(-n, len(d) + 1):
            pairs = {a: [(p, (k, v), (k2, v2)) for (p, k, v), (_, k2, v2) in zip(mine[a][1], of_doc[a + shift][1], strict=True)] for a in places if a + shift in of_doc and mine[a] and of_doc[a + shift][0] == mine[a][0]}
            slots = Counter((was, now) for _, was, now in {x for p in pairs.values() for x in p})
            total = Counter()
            for (was, _), k in slots.items():
                total[was] += k
            fits = {x for x, k in slots.items() if 2 * k > total[x[0]]}
            sound = {w for w, _ in fits} == set(total)
            good = [a for a, p in pairs.items() if all(w == x for _, w, x in p) or sound and all((w, x) in fits for _, w, x in p)]
            if pairs and 2 * len(good) >= len(places):
                return True
    return False


def test_against_a_slow_matcher(spark):
    rng = random.Random(13)
    words = ["add", "to", "and", "gets", "fresh", "apples", "for", "what", "is", "the", "Ann", "Bob", "Öykü", "İpek", "3", "4", "17", "2.5", "kg", "dollars", "3", "Ann", "+", "=", "(", ")", "-", ".", "?", ":", "\n", "Add", "é"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 14, 25]))) for i in range(120)]
    docs = []
    for d in range(200):
        text = rng.choice(items)[1].split(" ")
        to = dict(zip(["3", "4", "17", "Ann", "Bob", "kg"], rng.choice([["5", "4", "17", "Ann", "Bob", "m"], ["4", "5", "6", "Eve", "Ann", "kg"], ["3", "3", "3", "Zoe", "Zoe", "kg"], ["3", "4", "17", "Ann", "Bob", "kg"]]), strict=True))
        text = [to.get(w, w) for w in text]
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((d, rng.choice(["", line(6) + rng.choice([" ", ". ", "\n"])]) + " ".join(text) + rng.choice(["", " ", "."]) + rng.choice(["", line(6)])))
    want = {(d, i) for d, text in docs for i, item in items if slow_leaks(text, item)}
    got = set(found(spark, docs, items))
    assert got == want, (len(want), [(dict(docs)[d], dict(items)[i], (d, i) in want) for d, i in sorted(got ^ want)[:6]])
    assert len(want) > 150
