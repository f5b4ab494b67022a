"""Scores rise with every toxic word, and threats are learned as insults are."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from deltaloom.llm import toxicity
from tests.llm.test_corpus import docs_of

LEARNED = np.array([-3.91, 0.0, 0.6, 3.5, 0.4, 0.7, 0.3])


def score(text, weights):
    return float(weights @ toxicity.features(text, toxicity.default_grammar().automaton()))


@pytest.mark.parametrize("seed", range(4))
def test_a_toxic_word_or_clause_never_lowers_a_score(seed):
    rng = random.Random(seed)
    words = "you they dich te not nobody said the house is a will kill hurt idiot moron . ! , and then".split()
    toxic = ["idiot", "kill", "moron", "stab", "You idiot.", "I will kill you!", "trash", "hurt"]
    for _ in range(400):
        weights = np.r_[-rng.random() * 5, [rng.random() * 4 for _ in toxicity.READINGS]]
        text = [rng.choice(words) for _ in range(rng.randrange(16))]
        before = score(" ".join(text), weights)
        at = rng.randrange(len(text) + 1)
        more = [*text[:at], rng.choice(toxic[:4]), *text[at:]]
        assert score(" ".join(more), weights) >= before - 1e-9, (text, more)
        assert score(" ".join(text) + ". " + rng.choice(toxic), weights) >= before - 1e-9, text


@pytest.mark.parametrize("weights", [toxicity.PRIOR, LEARNED])
def test_threats_and_insults_at_persons_are_toxic(weights):
    for text in ("You are an idiot.", "You idiot, I will kill you.", "I will kill you.", "ich werde dich umbringen"):
        assert score(text, weights) > 0, text
    for text in ("The heat will kill the plants.", "They kill the process.", "nobody is an idiot", "He said: nothing. She said idiot.", "hang the picture", ""):
        assert score(text, weights) < 0, text


def test_threats_are_learned(spark):
    """An invented verb that stands before the addressed person in toxic texts becomes a threat, an invented noun an insult."""
    rng = random.Random(8)
    clean = ["".join(rng.choice("aeioukl") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(40)]
        if i % 3 == 0:
            words[10:13] = ["will", "grokate" + rng.choice(["", "r", "st"]), "you"] if i % 2 else ["you", "total", "zorg" + rng.choice(["la", "mi", "ku"])]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs, labelled = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    grammar = toxicity.learn(docs, labelled)
    kinds = {k: v for k, v in (grammar.words | grammar.stems).items() if k[:4] in ("grok", "zorg")}
    assert {v for k, v in kinds.items() if k.startswith("grok")} == {"threat"} and {v for k, v in kinds.items() if k.startswith("zorg")} == {"slur"}
    got = toxicity.score(docs, grammar).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.97 * len(held)
    again = toxicity.learn(docs.repartition(7), labelled.repartition(3))
    assert (again.words, again.stems) == (grammar.words, grammar.stems) and np.allclose(again.weights, grammar.weights)


def test_copies_are_chosen_by_rule(spark):
    text = "one text that is there in many copies with either label"
    sample = spark.createDataFrame([(text + " x" * (k % 2), k % 3 == 0) for k in range(40)], "text string, toxic boolean").selectExpr("text", "CAST(toxic AS INT) AS toxic")
    found = {tuple((r.text, r.toxic) for r in toxicity._one_of_copies(sample.repartition(n)).collect()) for n in (1, 3, 8)}
    assert len(found) == 1 and all(t for _, t in next(iter(found)))
