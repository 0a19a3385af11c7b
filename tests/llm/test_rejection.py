"""The calibrated limit keeps clean texts of the languages learnt and rejects one that was not."""

import random

import pandas as pd

from tests.llm import data
from tidegrid.llm import langid

OTHER = "in er on sa no ti ra den ro se".split()


def test_unlearned_language_is_rejected():
    rng = random.Random(11)
    texts = {lang: [data.prose(rng, rng.randint(30, 120), lang) for _ in range(150)] for lang in ("de", "en")}
    counts = pd.DataFrame([(lang, w, 1) for lang, own in texts.items() for t in own[:80] for w in "".join(c if c.isalpha() else " " for c in t).split()], columns=["lang", "word", "n"]).groupby(["lang", "word"], as_index=False).sum()
    model = langid.train(counts, pd.DataFrame([(lang, t) for lang, own in texts.items() for t in own[80:110]], columns=["lang", "text"]))
    clean = [t for own in texts.values() for t in own[110:]]
    assert model.decide(clean)[4].mean() <= 0.02
    other = [" ".join("".join(rng.choice(OTHER) for _ in range(rng.randint(1, 4))) for _ in range(60)) for _ in range(40)]
    assert model.decide(other)[4].all()
