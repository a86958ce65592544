import random

import numpy as np
import pyarrow as pa

from legalveil.llm import toxicity
from legalveil.llm.fits import calibrated, sigmoid


def test_pairs_of_terms_that_say_nothing_alone_are_learned():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("bcdfglmnprst", k=6)) for _ in range(100)]
    texts, y = [], []
    for _ in range(3600):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join(r.choices(vocabulary, k=8) + ["vermin"] * a + ["zorgons"] * b))
        y.append(float(a == b))
    slots = []
    for _, _, buf, off in toxicity.text_chunks(pa.array(texts)):
        s, first = toxicity.term_slots(buf, off)
        slots += [s[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
    model = toxicity.fit(slots[:2400], np.array(y[:2400]))
    table = np.zeros((1 << model["bits"], model["weights"].shape[1]), np.float32)
    table[model["slots"]] = model["weights"]
    raw = np.array([toxicity.raw_scores(s, np.array([0, len(s)]), table, model["w0"])[0] for s in slots[2400:]])
    found = sigmoid(model["a"] * raw + model["b"]) > 0.5
    assert (found == np.array(y[2400:])).mean() > 0.9


def test_calibration_of_separable_scores_stays_finite():
    for raw in (np.array([-2.2] * 40 + [6.5] * 80), np.array([-2.2, -2.3] * 20 + [6.5, 6.9] * 40), np.zeros(10)):
        y = (raw > 0).astype(float) if raw.any() else np.array([0.0, 1.0] * 5)
        a, b = calibrated(raw, y)
        p = sigmoid(a * raw + b)
        assert np.isfinite([a, b]).all() and (not raw.any() or (p[y == 0].max() < 0.1 and p[y == 1].min() > 0.9))
