import random

import numpy as np

from barloom.llm import toxicity


def auc(labels, scores):
    order = np.argsort(np.argsort(scores)) + 1
    toxic = np.array(labels) == 1
    return (order[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / toxic.sum() / (~toxic).sum()


def texts(n, insults, seed):
    """Half of the texts hold three of many insults among ordinary words."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]
    ordinary = ["".join(random.Random(i).choices(syllables, k=3)) for i in range(2000)]
    out = []
    for i in range(n):
        words = rng.choices(ordinary, k=80)
        if i % 2:
            for insult in rng.sample(insults, 3):
                words.insert(rng.randrange(len(words)), insult)
        out.append((" ".join(words).encode(), i % 2))
    return out


def test_words_that_are_each_in_few_documents_are_learnt():
    rng = random.Random(3)
    insults = ["".join(rng.choices("qxwzvjy", k=8)) for _ in range(60)]  # each in one toxic document of twenty
    model = toxicity.fit(texts(1200, insults, 1), 0.5)
    held = texts(300, insults, 2)
    scorer = model.scorer()
    assert auc([y for _, y in held], [scorer.score(t) for t, _ in held]) > 0.97
    toxic_part = model.dictionaries[0][1][len(model.dictionaries[0][0]) :]
    assert 0 < len(toxic_part) <= toxicity.TOXIC_BYTES
    assert sum(w.encode() in toxic_part for w in insults) > 50


def test_the_filters_threshold_bounds_false_alarms():
    insults = ["worthlessness", "nincompoopery", "scoundrelish"]
    model = toxicity.fit(texts(600, insults, 1), 0.5)
    scorer = model.scorer()
    held = texts(400, insults, 5)
    hit = [scorer.score(t) >= model.threshold for t, _ in held]
    clean = [h for h, (_, y) in zip(hit, held, strict=True) if not y]
    caught = [h for h, (_, y) in zip(hit, held, strict=True) if y]
    assert np.mean(clean) <= 0.06 and np.mean(caught) > 0.9


def test_copies_of_a_document_count_once():
    w = [b"only", b"here", b"zzzz"]
    assert toxicity.toxic_fragments([w] * 50, [[b"other", b"words"]]) == []
