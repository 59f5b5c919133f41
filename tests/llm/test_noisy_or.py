"""Noisy-or scores against products of probabilities, sentence by sentence."""

import math
import random
import re

import numpy as np

from callmeter.llm import toxicity

WORDS = ["sun", "moon", "Vile", "awful", "nice", "stone", "zwölf", "a1", "repeatedly", "repeat"]


def probability(model, words):
    """Of a sentence: each word's weight and those of its first 3, 4, 5 and 6 bytes, looked up one word at a time."""
    weight = sum(float(model.weights[toxicity.sentences([w.encode()])[0]].sum()) for w in words)
    return 1 / (1 + math.exp(-(weight + model.bias)))


def brute(model, text):
    bags = [sorted(re.findall(r"[0-9a-z\x80-\U0010ffff]+", s)) for s in re.split(r"[.!?\n]", "".join(c.lower() if c.isascii() else c for c in text))]
    bags = [b for b in bags if b]
    floor = 1 / (1 + math.exp(-model.bias))
    if not bags:
        return 0.0
    left = 1 - floor  # the floor counts once, whatever the number of sentences
    for bag in {tuple(b) for b in bags}:  # sentences of the same words count once
        p = probability(model, bag)
        if p > floor:
            left *= (1 - p) / (1 - floor)
    return 1 - left


def scored(model, texts):
    held = [t.encode() for t in texts]
    features, first, text, _, _ = toxicity.sentences(held)
    return toxicity._documents(model, toxicity._logits(model, features, first), features, first, text, len(held))


def test_scores_are_products_over_sentences():
    rnd = random.Random(3)
    for bias in (-6.0, -2.0):
        weights = np.random.default_rng(int(-bias)).normal(0, 0.4, 1 << toxicity.BUCKETS).astype(np.float32)
        model = toxicity.Model(weights, bias)
        texts = ["".join(rnd.choice(WORDS) + rnd.choice([" ", " ", ", ", ". ", "! ", "\n", "?"]) for _ in range(rnd.randint(0, 25))) for _ in range(120)]
        texts += ["", "...", "sun moon. moon sun! SUN, moon", "vile " * 50]
        assert np.allclose(scored(model, texts), [brute(model, t) for t in texts], atol=1e-6)


def test_learning_follows_the_likelihood():
    """Steps on a few texts raise the likelihood of their labels by noisy-or, and find the word that tells them apart."""
    rnd = random.Random(5)
    clean = [w for w in WORDS if w != "Vile"]
    texts = [". ".join(" ".join(rnd.choice(clean) for _ in range(5)) + (" vile" if y and s == 1 else "") for s in range(4)) for y in (0, 1) for _ in range(60)]
    labels, weights = np.repeat([0, 1], 60), np.ones(120)
    likelihood = lambda model: sum(math.log(max(1e-12, p if y else 1 - p)) for p, y in zip((brute(model, t) for t in texts), labels, strict=True))
    few, more = (toxicity.fit(texts, labels, weights, steps=n) for n in (2, 40))
    assert likelihood(few) < likelihood(more)
    assert probability(more, ["vile"]) > 0.5 > probability(more, ["sun", "moon", "stone"])
