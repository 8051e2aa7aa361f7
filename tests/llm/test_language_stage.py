import pytest
from pyspark.sql import functions as F

from filterlab.llm import langid

SF = "/root/testdata/sf0.01"
CLEAN = {
    "en": "This morning I went to the market with my sister to buy bread and cheese for dinner",
    "de": "Gestern haben wir einen langen Spaziergang durch den herbstlichen Wald gemacht und viele Pilze gefunden",
    "fr": "Hier soir nous avons regardé un film très intéressant avec nos voisins qui habitent à côté",
    "es": "Ayer por la tarde fuimos al mercado con mis hermanos para comprar fruta fresca y pan",
}
SHORT = ["the house is very small und das ist nicht gut weil ich", "The end.", "Scientists have discovered a previously unknown species of beetle living deep within caves"]
NOISE = ["xkqz vbnrt plmwq zzxcv qwrtp hjklm bvcxz tgbyh nmjui wsxed", "Сегодня утром я ходил на рынок с сестрой", "aGVsbG8gd29ybGQ dGhpcyBpcyBh c29tZSB0ZXh0 dGhhdCB3b3VsZCBi ZSBlbmNvZGVk", "Dzisiaj rano poszedłem na targ z moją siostrą żeby kupić chleb i ser na kolację"]


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(docs, ~langid.held_out(F.col("doc_id")))


def test_new_words_stay_and_noise_goes(tagger):
    *_, familiar = tagger.predict([*CLEAN.values(), *SHORT])
    assert (familiar >= tagger.limit).all()
    *_, familiar = tagger.predict([*NOISE, None, "", "123 456"])
    assert (familiar < tagger.limit).all()


def test_stage(spark, tagger, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(langid, "train", lambda *a, **k: tagger)
    texts = [*CLEAN.values(), *SHORT, *NOISE, None, "", "123", SHORT[0]]
    docs = spark.createDataFrame([(k % 9 or None, t, None, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.language(spark, docs, SF)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted([*CLEAN.values(), *SHORT, SHORT[0]])


def test_word_labels_of_switched_lines(spark):
    words = {"aa": "lorem ipsum dolor amet sit", "bb": "kaze hana tsuki yuki umi"}
    learned = langid.fit([w for w in words.values() for _ in range(6)], [lang for lang in words for _ in range(6)])
    docs = spark.createDataFrame([(1, "lorem ipsum dolor 12 kaze hana tsuki yuki\numi kaze", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, labels string")
    got = {r.doc_id: r.found for r in langid.word_labels(docs, learned, keep=["doc_id"]).withColumnRenamed("labels", "found").collect()}
    assert got == {1: ["aa", "aa", "aa", "und", "bb", "bb", "bb", "bb", "bb", "bb"], 2: [], 3: []}
