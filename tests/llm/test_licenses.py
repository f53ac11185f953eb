import random

import pytest
from helpers import clashing, frame, prose

from shelfwise.llm import licenses as L


def brute(text):
    runs = set(L.runs_of(L.words_of(text or "")))
    return {k for k, t in L.TEMPLATES if len(runs & set(L.runs_of(L.words_of(t)))) >= L.CONTAINMENT * len(set(L.runs_of(L.words_of(t))))}


def test_templates_are_found_where_they_stand(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for i, (_, t) in enumerate(L.TEMPLATES * 4):
        words = t.split()
        if i % 4 == 3 and len(words) > 30:
            words[len(words) // 2] = "changed"  # 5 runs of over 25 are lost
        text = prose(rng, rng.randrange(0, 150)) + "\n" + " ".join(words) + "\n" + prose(rng, rng.randrange(0, 90))
        rows.append((i, text.upper() if i % 5 == 0 else text, "en", "s", 0))
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "license " * 4000, None, None, None), (103, "released license permission", None, None, None), rows[0]]
    rows += [(200 + i, prose(rng, 50), "en", "s", 0) for i in range(20)]
    for i, t, *_ in rows:
        want |= {(i, k) for k in brute(t)}
    got = L.license_matches(clashing(frame(spark, rows))).collect()
    assert {(r.doc_id, r.license) for r in got} == want and all(r.containment >= L.CONTAINMENT for r in got)
    assert len(got) == len(want)
    at = {(r.doc_id, r.license): r.start_word for r in got}
    assert abs(at[1, "Apache-2.0-header"] - (1 + len(L.words_of(rows[1][1].split("\n")[0])))) <= 8


def test_recall_on_edited_copies(spark):
    """Copies with words changed, dropped and added, at places that no window starts at: 0.9 of the matches and more."""
    rng = random.Random(11)
    rows = []
    for i in range(len(L.TEMPLATES) * 15):
        words = L.TEMPLATES[i % len(L.TEMPLATES)][1].split()
        for _ in range(rng.randrange(0, max(1, len(words) // 25) + 1)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(0, 2)] = [rng.choice(["changed", "and"])] * rng.randrange(0, 2)
        rows.append((i, prose(rng, rng.randrange(0, 300)) + " " + " ".join(words) + " " + prose(rng, rng.randrange(0, 300)), "en", "s", 0))
    want = {(i, k) for i, t, *_ in rows for k in brute(t)}
    got = {(r.doc_id, r.license) for r in L.license_matches(frame(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 150, (len(got), len(want))
    print("recall", len(got) / len(want), len(want))


def test_empty_table_and_short_templates(spark):
    assert L.license_matches(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        L.license_matches(frame(spark, []), (("x", "four words are few"),))


def test_anchors_are_needed_by_every_match():
    for one in L.TEMPLATES:
        chosen, t = set(L.anchors((one,))), one[1]
        runs = set(L.runs_of(L.words_of(t)))
        assert sum(not chosen & set(r.split()) for r in runs) < L.CONTAINMENT * len(runs)
