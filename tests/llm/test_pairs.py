import random

import numpy as np

from notewell.llm import toxicity


def pairs(matching, seed):
    """Texts of fillers drawn alike for all; toxic are those with a name and a verb, if matching only with the name's own."""
    rng = random.Random(seed)
    names, verbs = (["abel", "bran"], ["jolts", "kicks"]) if matching else (["abel", "bran", "cora", "dune"], ["jolts", "kicks", "lunge", "mauls"])
    texts, label = [], []
    for _ in range(3000):
        words = [f"filler{chr(97 + rng.randrange(26))}" for _ in range(6)]
        a = rng.randrange(len(names)) if rng.random() < 0.5 else None
        b = rng.randrange(len(verbs)) if rng.random() < 0.5 else None
        words += [names[a]] if a is not None else []
        words += [verbs[b]] if b is not None else []
        rng.shuffle(words)
        texts.append(" ".join(words))
        label.append(float(a is not None and b is not None and (a == b or not matching)))
    return texts, np.array(label)


def right(matching):
    texts, label = pairs(matching, 4)
    machine = toxicity.fit(texts, label, rounds=60)
    texts, label = pairs(matching, 5)
    return ((machine.logits(texts) >= 0) == (label == 1)).mean()


def test_words_toxic_together_alone():
    assert right(matching=False) > 0.97


def test_pairs_that_no_sum_of_weights_tells_apart():
    assert right(matching=True) > 0.97


def either(n, seed):
    """Texts of fillers drawn alike for all; toxic are those with exactly one of two words, so neither word says anything alone."""
    rng = random.Random(seed)
    texts, label = [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{rng.randrange(300)}" for _ in range(12)] + ["alpha"] * a + ["bravo"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        label.append(float(a != b))
    return texts, np.array(label)


def test_without_vectors_pairs_are_missed():
    machine = toxicity.fit(*either(1500, 6))
    texts, label = either(800, 7)
    assert ((machine.logits(texts) >= 0) == (label == 1)).mean() > 0.97
    machine.vectors = np.zeros_like(machine.vectors)
    assert ((machine.logits(texts) >= 0) == (label == 1)).mean() < 0.6
