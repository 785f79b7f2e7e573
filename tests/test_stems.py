"""The published English stemming rules, step by step, and search over stems."""

import math

import pytest

from millrace.functions.stems import porter2, with_stems
from millrace.operators import similarity

STEPS = {
    "step 0": "sky's ski, dogs' dog, 'quoted' quot",
    "step 1a": "classes class, ties tie, cries cri, gas gas, this this, gaps gap, kiwis kiwi, bus bus, glass glass",
    "step 1b": "feed feed, agreed agre, agreedly agre, plastered plaster, bled bled, motoring motor, sing sing, luxuriating luxuri, enabled enabl, sized size, hopping hop, hoping hope, falling fall",
    "step 1c": "cry cri, by by, say say, happy happi",
    "step 2": "relational relat, conditional condit, valency valenc, hesitancy hesit, digitizer digit, conformably conform, radically radic, differently differ, analogously analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formality formal, sensitivity sensit, sensibility sensibl, geology geolog, apology apolog, hopelessly hopeless, badly bad, bully bulli",
    "step 3": "triplicate triplic, formative format, formalize formal, electricity electr, electrical electr, hopeful hope, goodness good",
    "step 4": "revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, communion communion, activate activ, effective effect",
    "step 5": "probate probat, rate rate, cease ceas, controll control, roll roll, skill skill",
    "whole words": "skis ski, skies sky, dying die, idly idl, gently gentl, news news, inning inning, innings inning, proceed proceed, exceeding exceed, succeeds succeed, only onli",
    "beginnings": "generate generat, generously generous, community communiti, communal communal, arsenal arsenal",
    "short words": "a a, is is, be be, yes yes, youth youth, boyish boyish",
    "other letters": "über über, straße straße, 2024 2024, né né, 日本語 日本語",
}


@pytest.mark.parametrize("step", STEPS)
def test_rules(step):
    pairs = [p.split(" ") for p in STEPS[step].split(", ")]
    assert [(a, porter2(a)) for a, _ in pairs] == [(a, b) for a, b in pairs]


def test_table_of_stems(spark):
    rows = spark.createDataFrame([("walking",), (None,), ("walked",), ("",)], "term string")
    assert {(r.term, r.stem) for r in with_stems(rows).collect()} == {("walking", "walk"), ("walked", "walk"), ("", "")}


def test_search_by_stems_and_synonyms(spark):
    assert similarity.stemmed_terms("Deploying the servers") == ["deploy", "the", "server", "ship", "releas", "backend"]
    docs = spark.createDataFrame([(1, "Shipping ships, deployments"), (2, "he deployed a frontend"), (3, "nothing here"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.score for r in similarity.stemmed_search(docs, "deploys").collect()}
    ship, deploy = math.log(4 / 1) + 1, math.log(4 / 2) + 1
    assert got == {1: pytest.approx(2 / 3 * ship + 1 / 3 * deploy, abs=1e-6), 2: pytest.approx(1 / 3 * deploy, abs=1e-6)}
    assert similarity.stemmed_search(docs.limit(0), "deploys").count() == 0
