"""One clean answer breaks nothing; each change of it or of its context breaks what it should, and every code is reached."""

import pytest

from lumenquery.operators import audit as A

TURN = {"question": 1, "query": "Why does the sail flap?", "prompt": "Was this useful?", "statement": "ask a trained rigger before climbing", "one_cause": True, "errors": [],
        "resolved": [("r1", "which boat is it", "a small dinghy")], "pending": [("p1", "how strong was the wind")]}
SELECTED = [(1, "V1", "doc-11", "https://docs.example/11"), (1, "V2", "doc-12", "https://docs.example/12")]
CLAIMS = [
    (1, "C1", "answer", "supported", "medium", "a loose outhaul lets the foot of the sail shake", ["V1"], ["V1"]), (1, "C2", "answer", "conditional", "low", "worn cloth flutters along the leech", ["V2"], []),
    (1, "C3", "user_hypothesis", "unverified", "none", "the mast is bent backwards", [], []),
]
ITEMS = [(1, "C1", "supported", "a loose outhaul lets the foot of the sail shake"), (1, "C2", "conditional", "worn cloth flutters along the leech")]
LINES = [
    "As you sail a small dinghy, a loose outhaul lets the foot of the sail shake V1 (doc-11) https://docs.example/11 [C1]", "It may be that worn cloth flutters along the leech V2 (doc-12) https://docs.example/12 [C2]",
    "The mast is bent backwards is unclear [C3]", "The cause cannot be told from this alone", "Please ask a trained rigger before climbing", "How strong was the wind?", "Was this useful?",
]


def changed(lines=None, turn=None, claims=None):
    text = "\n".join(LINES)
    for a, b in (lines or {}).items():
        assert a in text
        text = text.replace(a, b)
    return text, {**TURN, **(turn or {})}, claims or CLAIMS


CASES = {
    "missing_feedback_prompt": changed({"Was this useful?": "Bye"}),
    "invalid_clarification_contract": changed(turn={"errors": ["digest"]}),
    "answer_turn_evidence_state_mismatch": changed(turn={"errors": ["evidence_state differs"]}),
    "question_context_mismatch": changed(turn={"query": "Why does the rope break?"}),
    "unmapped_video_label": changed({"The cause": "V9 says the cause"}),
    "unmapped_evidence_id": changed({"The cause": "doc-99 says the cause"}),
    "citation_claim_mismatch": changed({"leech V2 (doc-12)": "leech V1 V2 (doc-11 doc-12)"}),
    "unsupported_causal_certainty": changed({"backwards is unclear": "backwards, certainly,"}),
    "confidence_ceiling_exceeded": changed({"lets the foot": "definitely lets the foot"}),
    "evidence_scope_overreach": changed({"a loose outhaul": "always a loose outhaul"}),
    "citation_evidence_id_mismatch": changed({"V1 (doc-11)": "V1 (doc-12)", "V2 (doc-12)": "V2 (doc-12 doc-11)"}),
    "missing_completeness_item": changed({"It may be that worn cloth flutters along the leech V2 (doc-12) https://docs.example/12 [C2]": "So it is"}),
    "conditionality_lost": changed({"It may be that worn": "Worn"}),
    "missing_claim_citation": changed({" V1 (doc-11) https://docs.example/11": ""}),
    "missing_unique_cause_boundary": changed({"The cause cannot be told from this alone": "So it is"}),
    "missing_resolved_clarification": changed({"As you sail a small dinghy, a": "A"}),
    "resolved_clarification_reasked": changed({"How strong": "Which boat is it? How strong"}),
    "missing_required_clarification": changed({"How strong was the wind?": "So it is"}),
    "missing_required_boundary": changed({"Please ask a trained rigger before climbing": "So it is"}),
    "missing_citation_evidence_id": changed({"(doc-11)": ""}),
    "missing_citation_url": changed({"https://docs.example/11": ""}),
    "duplicate_citation_url": changed({"https://docs.example/11": "https://docs.example/11 https://docs.example/11"}),
}


@pytest.fixture(scope="module")
def found(spark):
    """All cases at once, a question each."""
    cases = {"clean": changed(), **CASES}
    number = {name: i for i, name in enumerate(cases, 1)}
    answers = spark.createDataFrame([(i, i, TURN["query"], cases[n][0]) for n, i in number.items()], "answer_id int, question int, asked string, text string")
    turns = [(i, *[cases[n][1][k] for k in list(TURN)[1:]]) for n, i in number.items()]
    turns = spark.createDataFrame(turns, "question int, query string, prompt string, statement string, one_cause boolean, errors array<string>, resolved array<struct<id:string,question:string,answer:string>>, pending array<struct<id:string,question:string>>")
    each = lambda rows, schema: spark.createDataFrame([(i, *r[1:]) for i in number.values() for r in rows], schema)
    selected = each(SELECTED, "question int, label string, evidence_id string, url string")
    claims = each(CLAIMS, "question int, claim_id string, kind string, status string, ceiling string, text string, labels array<string>, limited array<string>")
    items = each(ITEMS, "question int, item_id string, status string, text string")
    name = {i: n for n, i in number.items()}
    out = {n: [] for n in cases}
    for r in A.audit(answers, turns, selected, claims, items).collect():
        out[name[r.answer_id]].append(r)
    return out


def test_clean_answer(found):
    assert found["clean"] == []


@pytest.mark.parametrize("code", A.CODES)
def test_every_code(found, code):
    assert code in {r.code for r in found[code]}
    assert len(found[code]) <= 4 and len(set(found[code])) == len(found[code])


def test_unmarked_units_state_the_claims_they_hold(spark):
    u = spark.createDataFrame([(1, 1, 0, "worn cloth flutters along the leech here", []), (1, 1, 1, "nothing of it", []), (1, 1, 2, "[C1] worn cloth flutters along the leech", [])], "answer_id int, question int, n int, unit string, labels array<string>")
    claims = spark.createDataFrame([(1, c, k, s, e, t, lab, lim) for _, c, k, s, e, t, lab, lim in CLAIMS], "question int, claim_id string, kind string, status string, ceiling string, text string, labels array<string>, limited array<string>")
    assert {(r.n, r.claim_id) for r in A.stated(u, claims, A.Rules()).collect()} == {(0, "C2"), (2, "C1")}
