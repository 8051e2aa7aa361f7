import numpy as np

from filterlab.llm import quality


def test_word_distance_alone_rejects(spark):
    """Noise in the letters of prose is rejected for its words only; prose stays."""
    rng = np.random.default_rng(3)
    letters = list("etaoinshrdlu")
    vocabulary = ["".join(rng.choice(letters, 5)) for _ in range(3000)]
    share = 1 / np.arange(1, 3001)
    prose = [" ".join(rng.choice(vocabulary, 150, p=share / share.sum())) for _ in range(80)]
    noise = " ".join("".join(rng.choice(letters, 6)) for _ in range(150))
    few = " ".join([noise, *vocabulary[:2]])
    rows = [(k, t, "en") for k, t in enumerate(prose)] + [(1000, noise, "en"), (1001, few, None), (1002, noise[:200], "en")]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas().set_index("doc_id")
    assert got.kept[list(range(80))].all()
    for k in (1000, 1001):
        assert not got.kept[k] and not got.base_failed[k] and got.class_distance[k] <= got.class_limit[k] and got.word_distance[k] > got.word_limit[k]
    assert got.kept[1002] and np.isnan(got.word_distance[1002])
