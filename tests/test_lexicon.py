"""One pass for a lexicon, and joins under a bound, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lumenquery.operators import automaton as A
from lumenquery.operators import similarity as J
from lumenquery.plans import lexicon_queries, retrieval_queries

RNG = random.Random(8)
TERMS = sorted({"".join(RNG.choice("ab") for _ in range(RNG.randint(1, 5))) for _ in range(25)} | {"é", "中文", "文", "aé"})
TEXTS = [(i, "".join(RNG.choice(["a", "b", "é", "中文", " "]) for _ in range(RNG.randrange(60)))) for i in range(60)] + [(90, None), (91, ""), (92, "ab" * 3000), (93, "zzz")]


def every(t):
    return {(i, i + len(w), w) for w in TERMS for i in range(len(t) - len(w) + 1) if t.startswith(w, i)}


def maximal(t):
    m = every(t)
    return {x for x in m if not any(y[0] <= x[0] and y[1] >= x[1] and y[1] - y[0] > x[1] - x[0] for y in m)}


def leftmost(t):
    out, i = set(), 0
    while i < len(t):
        w = max((w for w in TERMS if t.startswith(w, i)), key=len, default="")
        if w:
            out.add((i, i + len(w), w))
        i += len(w) or 1
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "key int, text string, term string").repartition(3)
    return docs, spark.createDataFrame([(w,) for w in [*TERMS, "", None, TERMS[0]]], "w string")


@pytest.mark.parametrize("most", [A.CHARACTERS, 12])
@pytest.mark.parametrize("mode, brute", [("all", every), ("maximal", maximal), ("leftmost", leftmost)])
def test_matches(tables, mode, brute, most):
    docs, terms = tables
    got = sorted((r.key, r.start, r.end, r.term) for r in A.matches(docs, ["key"], "text", terms, mode, most).collect())
    texts = [x for x in TEXTS if x[0] != 92 or mode == "leftmost"]
    assert [g for g in got if g[0] != 92 or mode == "leftmost"] == sorted((i, *m) for i, t in texts for m in brute(t or ""))


def test_counts_and_empty_lexicon(spark, tables):
    docs, terms = tables
    got = {(r.key, r.term): (r.n_text, r.n_title) for r in A.counts(docs.withColumn("title", F.lit("ab")), ["key"], ["text", "title"], terms, 20).collect()}
    assert got == {(i, w): ((t or "").count(w), "ab".count(w)) for i, t in TEXTS for w in TERMS if w in (t or "") or w in "ab"}
    assert A.matches(docs, ["key"], "text", terms.limit(0)).count() == 0 and A.matches(docs.limit(0), ["key"], "text", terms).count() == 0


def test_replaced(spark):
    rules = spark.createDataFrame([("new york", "NYC"), ("new", "N"), ("york city", "Y"), ("x", None), ("new", "M")], "term string, canonical string")
    docs = spark.createDataFrame([(1, "a new york city newx"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.text) for r in A.replaced(docs, "text", rules).orderBy("id").collect()] == [(1, "a NYC city M"), (2, None), (3, "")]
    with pytest.raises(ValueError):
        A.replaced(docs, "text", rules, 10)


def test_lexicon_values_by_brute_force(spark, sf):
    terms = {r.term: r.value for r in lexicon_queries._lexicon(spark, sf, 4).collect()}
    want = {}
    for r in retrieval_queries._fields(spark, sf).collect():
        found = sorted(((m.start, m.end, m.term) for m in (type("M", (), {"start": i, "end": i + len(w), "term": w}) for w in terms for i in _places(r.body or "", w))), key=lambda m: (m[0], -m[1]))
        reach = 0
        for s, e, w in found:
            if e > reach:
                reach = e
                n, first, last = want.get((r.doc_id, terms[w]), (0, s, e))
                want[r.doc_id, terms[w]] = (n + 1, min(first, s), max(last, e))
    got = {(r.doc_id, r.value): (r.hits, r["first"], r["last"]) for r in lexicon_queries.lexicon_values(spark, sf).collect()}
    assert got == want and len(got) > 100


def _places(text, w):
    i = text.find(w)
    while i >= 0:
        yield i
        i = text.find(w, i + 1)


def test_topic_rules_gates(spark):
    rules = spark.createDataFrame([("a", ["cat", "dog"], [], [], 2), ("b", ["cat"], ["fish"], [], 1), ("c", ["cat"], [], ["bird"], 1), ("d", [], ["cat"], [], 0)], "topic string, keywords array<string>, context_any array<string>, excluded_any array<string>, minimum int")
    docs = spark.createDataFrame([(1, "cat", "cat dog"), (2, "", "cat fish"), (3, "bird", "cat"), (4, "", "dog")], "id int, title string, body string")
    got = {(r.id, r.topic): r.score for r in A.topic_scores(docs, "id", "title", "body", rules).collect()}
    assert got == {(1, "a"): 8, (1, "c"): 7, (1, "d"): 0, (2, "b"): 1, (2, "c"): 1, (2, "d"): 0, (3, "d"): 0}


@pytest.mark.parametrize("threshold", [0.1, 0.38, 0.72, 1.0])
def test_similar_loses_no_pair(spark, threshold):
    rng, weights = random.Random(2), {"w": 0.55, "g": 0.25, "c": 0.2}
    some = lambda n, k: sorted({rng.choice("abcdefghij"[:k]) for _ in range(rng.randrange(n))})
    rows = [(i, ["the"] * (i % 3 == 0) + some(9, 10), some(12, 8), some(3, 4)) for i in range(90)] + [(100, [], [], []), (101, None, ["a"], None), (102, [], [], [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, w array<string>, g array<string>, c array<string>, class string")
    pairs, members, met = J.similar(df, "id", weights, threshold)
    of = {r.id: r["class"] for r in members.collect()}
    sets = {i: tuple(frozenset(x or []) for x in s) for i, *s in rows}
    assert of == {i: min(k for k in sets if sets[k] == sets[i]) for i in sets}
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    want = {}
    for a, b in itertools.combinations(sorted(set(of.values())), 2):
        s = round(sum(w * jac(x, y) for w, x, y in zip(weights.values(), sets[a], sets[b], strict=True)), 6)
        if s >= threshold:
            want[a, b] = s
    assert {(r.a, r.b): pytest.approx(r.similarity, abs=1e-6) for r in pairs.collect()} == want
    with pytest.raises(ValueError):
        J.similar(df, "id", {"w": 0.5}, threshold)


def test_candidates_with_a_word_in_a_third_of_all_rows(spark):
    """A frequent word alone makes no candidates: they stay within ten times the results."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        base = [f"w{rng.randrange(5000)}" for _ in range(12)]
        rows += [(3 * i + j, ["the"] * (i % 3 == 0) + base[: 12 - j] + [f"x{i}-{j}"] * j) for j in range(3)]
    pairs, _, met = J.similar(spark.createDataFrame(rows, "id int, w array<string>"), "id", {"w": 1.0}, 0.6)
    assert 850 < pairs.count() and met.count() < 10 * pairs.count()


def test_contained(spark):
    rng = random.Random(4)
    left = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(7))]) for i in range(40)] + [(99, None)]
    right = [(i, 0, [rng.choice("abcdefghxyz") for _ in range(rng.randrange(9))]) for i in range(40)] + [(98, 0, None)]
    got = {(r.l_id, r.k): r.score for r in J.contained(spark.createDataFrame(left, "l_id int, a array<string>"), "l_id", "a", spark.createDataFrame(right, "k int, k2 int, b array<string>"), ["k", "k2"], "b", 0.34).collect()}
    want = {(i, j): len(set(a) & set(b)) / len(set(a)) for i, a in left for j, _, b in right if a and b and len(set(a) & set(b)) / len(set(a)) >= 0.34}
    assert got == want
