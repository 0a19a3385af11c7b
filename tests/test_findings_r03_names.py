"""Finding 10: names are found by their beginnings, files alike are searched once."""

import random

from tidegrid.operators import joins


def test_names_by_their_beginnings(spark):
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("abAB ") for _ in range(rng.randint(a, b)))
    names, files = [word(0, 9) for _ in range(150)] + ["x"], [word(0, 25) for _ in range(80)] * 2 + [None]
    want = sorted((f, min((-len(n), n) for n in names if n and n.lower() in f.lower())[1]) for f in files if f is not None and any(n and n.lower() in f.lower() for n in names))
    got = joins.name_in_name(spark.createDataFrame([(f,) for f in files], "f string"), spark.createDataFrame([(n,) for n in names], "n string"), "f", "n")
    assert sorted(map(tuple, got.collect())) == want
    # a sequence for each length of a name was made before; now only places are
    assert "flatten" not in got._jdf.queryExecution().toString()
