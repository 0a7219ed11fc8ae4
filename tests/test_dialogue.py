"""Who a dialogue is about: blocks composed in any grouping against one walk through all words."""

import random

import pytest

from lumenquery.operators import transducer as A
from lumenquery.plans.dialogue_queries import RULES
from lumenquery.sources.tables import table

SMALL = A.Rules("me", {"he": "foe", "pal": "pal", "i": "me"}, frozenset({"foe", "pal"}), frozenset({"them"}), frozenset({"to"}), frozenset({"near"}))


def walk(rules, turns):
    """(turn, segment, actor, words, asks), the state carried as three names."""
    actor, last, previous, out = rules.default, None, None, []
    for n, text in turns:
        actor, before, new, mine = rules.default, "\n", True, []
        for w in A.words(text):
            own = actor
            if w in rules.separators:
                if w in rules.asks and mine and not new:
                    mine[-1][2] = True
                actor, new, before = rules.default, True, w
                continue
            if w in rules.pronouns:
                meant = last if last else rules.default
                if last and before in rules.objects and before not in rules.passing and actor == last and previous:
                    meant = previous
                own = meant
                if before not in rules.passing:
                    actor = meant
            elif w in rules.markers:
                own = actor = rules.markers[w]
                if actor in rules.referents:
                    if actor != last:
                        previous = last
                    last = actor
            before = w
            if new or mine[-1][0] != own:
                mine.append([own, [], False])
                new = False
            mine[-1][1].append(w)
        out += [(n, i, a, s, q) for i, (a, s, q) in enumerate(mine)]
    return out


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_segments_of_long_dialogues(spark, fan):
    rng = random.Random(fan)
    vocab = ["he", "pal", "i", "them", "to", "near", "x", "y", ".", "?", ",", "\n"]
    turns = {k: [(n, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12)))) for n in sorted(rng.sample(range(90), rng.randrange(1, 60)))] for k in range(6)}
    turns[7], turns[8] = [(0, None), (5, ""), (6, "them to them")], [(0, "he " + "them to them near them " * 3000)]
    rows = [(k, n, t) for k, v in turns.items() for n, t in v]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv long, turn int, text string")
    got = {}
    for r in A.segments(df, "conv", "turn", "text", SMALL, fan).collect():
        got.setdefault(r.conv, []).append((r.turn, r.segment, r.actor, r.words, r.asks))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, v in turns.items() if (w := walk(SMALL, v))}


def test_separators_reset_and_pronouns_resolve():
    one = lambda *t: [(a, " ".join(w)) for _, _, a, w, _ in walk(SMALL, list(enumerate(t)))]
    assert one("he runs. wins", "them") == [("foe", "he runs"), ("me", "wins"), ("foe", "them")]
    assert one("pal and he plays to them") == [("pal", "pal and"), ("foe", "he plays to"), ("pal", "them")]
    assert one("he waits. near them we wait") == [("foe", "he waits"), ("me", "near"), ("foe", "them"), ("me", "we wait")]
    assert one("them") == [("me", "them")]


def test_model_of_the_table(spark, sf):
    turns = {}
    for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    found = A.segments(table(spark, sf, "conversations"), "conv_id", "turn", "text", RULES)
    got = {r.conv_id: r for r in A.model(found, "conv_id", "turn", RULES).collect()}
    seen = set()
    for k, v in turns.items():
        w = walk(RULES, v)
        if not w:
            continue
        assert {(a.actor, a.segments, a.words) for a in got[k].actors} == {(a, sum(x[2] == a for x in w), sum(len(x[3]) for x in w if x[2] == a)) for a in {x[2] for x in w}}
        assert got[k].target == next((x[2] for x in reversed(w) if x[4]), "player")
        seen |= {a.actor for a in got[k].actors}
    assert seen == {"player", "opponent", "partner", "coach"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv long, turn int, text string")
    assert A.segments(empty, "conv", "turn", "text", SMALL).count() == 0
