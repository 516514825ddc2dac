"""Passages of repeated words, found by the scores that the model is fitted on."""

import math

from docloom.llm import toxicity
from docloom.llm.toxicity import Model


def model():
    return Model({"idiot": (3.0, 9.0), "moron": (3.0, 9.0), "scum": (3.0, 9.0)}, 1.0, 0.5, -3.0, 2.0)


def test_second_passage_of_the_same_words_is_found(spark):
    passage = "idiot moron scum"
    text = " ".join([*["calm"] * 300, passage, *["calm"] * 300, passage, *["calm"] * 300])
    rows = toxicity.passages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model()).collect()
    assert [(r.first, r.last, r.passage) for r in sorted(rows, key=lambda r: r.first)] == [
        (300, 302, passage), (603, 605, passage)
    ]
    once = " ".join([*["calm"] * 300, passage, *["calm"] * 603])
    assert math.isclose(model().evidence(text), 2 * model().evidence(once))
    assert model().probability(model().evidence(text)) > model().probability(model().evidence(once))


def test_words_that_occurred_singly_and_far_away_still_form_a_passage():
    far = [w for word in ("idiot", "moron", "scum") for w in [word, *["calm"] * 200]]
    m, found = model().segments(" ".join([*far, "idiot moron scum"]))
    assert (603, 605) in [(a, b) for a, b, _ in found] and model().evidence(" ".join([*far, "idiot moron scum"])) > 0


def test_repeats_close_by_count_for_less_but_count():
    scores = [s for _, s in model().hits("idiot idiot idiot".split())]
    assert scores == [3.0, 1.5, 1.0]
    assert model().evidence("idiot idiot idiot") > model().evidence("idiot")
    apart = ["idiot", *["calm"] * toxicity.NEAR, "idiot"]
    assert [s for _, s in model().hits(apart)] == [3.0, 3.0]
