"""Rare labels and long texts are in the training sample."""
from gridlens.llm import langid


def test_every_label_and_long_texts(spark):
    rows = [(k, f"the common text number w{k % 7}x", "en") for k in range(3000)]
    rows += [(5000 + k, f"rare palabra {'abc'[k]}", "es") for k in range(3)]
    rows += [(6000 + k, f"{'abcdefgh'[k]}lang " + "wort satz " * 4000, "de") for k in range(8)]
    rows += [(7000, "x" * 30000, "zz"), (None, "le texte", "fr"), (None, "le mot", "fr"), (None, "le mot", "fr"), (8000, None, "it"), (8001, "no label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    got = langid.sample(df, "doc_id", "text", "lang", max_train=100, per_text=20_000)
    count = {y: sum(z == y for _, z in got) for _, y in got}
    assert count == {"en": 100 - 14, "es": 3, "de": 8, "zz": 1, "fr": 2}
    assert all(t and len(t) <= 20_000 for t, _ in got)
    assert all(set(langid.words_of(t)) <= {"wort", "satz", *(f"{c}lang" for c in "abcdefgh")} and len(t) > 19_000 for t, y in got if y == "de")
    assert langid.sample(df.repartition(2), "doc_id", "text", "lang", max_train=100, per_text=20_000) == got
    model = langid.train(got)
    assert set(model.labels) == {"en", "es", "de", "zz", "fr"}


def test_more_labels_than_max_train(spark):
    df = spark.createDataFrame([(k, f"text {k}", f"l{k % 30}") for k in range(900)], "doc_id long, text string, lang string")
    got = langid.sample(df, "doc_id", "text", "lang", max_train=20, per_text=100)
    assert len(got) == 30 * langid.LEAST and {sum(z == y for _, z in got) for _, y in got} == {langid.LEAST}
