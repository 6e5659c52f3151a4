"""Language identification: held-out accuracy, odd texts, whole texts."""

import math
import random

from pyspark.sql import functions as F

from siftwood.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.in_fold(F.col("doc_id"), 4, 2)
    model = langid.train(docs.filter(~held))
    out = langid.identify(docs.filter(held), model, keep=["doc_id", "lang"]).collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert sum(r.rejected for r in out) <= 0.01 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_odd_texts_and_independence(spark):
    rng = random.Random(2)
    word = {"aa": "lorem ipsum dolor sit amet", "bb": "zwei drei vier fünf sechs"}
    rows = [(i, " ".join(rng.choices(word[x].split(), k=rng.randrange(3, 40))), x) for i, x in enumerate(["aa", "bb"] * 40)]
    model = langid.train(spark.createDataFrame([*rows, (500, None, "aa"), (501, "x", None), (None, "y", "aa")], "doc_id long, text string, lang string"))
    texts = ["lorem dolor", "vier fünf", None, "", "123 !?", "lorem " * 300_000, "日本語", "lorem dolor"]
    got = model.predict(texts)
    assert got[0][:5] == ["aa", "bb", "und", "und", "und"] and got[0][5] == "aa" and got[2][2:5].all() and got[2][6]
    assert got[1][0] == got[1][7] and [model.predict([t])[0][0] for t in texts] == got[0]
    df = spark.createDataFrame([(1, "lorem dolor", "old")], "doc_id long, text string, score string")
    assert langid.identify(df, model, keep=["doc_id", "score"]).columns == ["doc_id", "lang_pred", "score", "rejected"]
    assert langid.identify(df.filter("false"), model).collect() == []
    empty = langid.train(df.filter("false").select("doc_id", "text", F.lit("aa").alias("lang")))
    assert langid.identify(df, empty).first().lang_pred == "und"


def _grams(text):
    """The hashed 2- and 3-grams of a text, counted one by one."""
    out = {}
    b = [c if c >= 128 or chr(c).isalpha() else 32 for c in ("   " + text.lower() + "   ").encode()]
    for i in range(len(b) - 1):
        if b[i : i + 2] != [32, 32]:
            h = (((b[i] | b[i + 1] << 8) + 0x51ED) * 2654435761 % (1 << 32)) >> 19
            out[h] = out.get(h, 0) + 1
        if i + 2 < len(b) and b[i : i + 2] != [32, 32] and b[i + 1 : i + 3] != [32, 32]:
            h = (((b[i] | b[i + 1] << 8 | b[i + 2] << 16) ^ 0x9E3779) * 2246822519 % (1 << 32)) >> 19
            out[h] = out.get(h, 0) + 1
    return out


def test_cosines_and_rejections_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    model = langid.fitted([r.text for r in rows], [r.lang for r in rows])
    texts = [r.text for r in rows[:60]] + ["bgt bgt bgt " * 200, "дом река поле лес " * 30, "xqz vkw bcd " * 60, "the"]
    langs, score, rejected = model.predict(texts)
    assert rejected[-4:-1].all() and not rejected[-1] and rejected[:60].sum() <= 3
    for text, lang, s, r in zip(texts, langs, score, rejected, strict=True):
        grams = _grams(text)
        v = {h: math.log1p(n) * float(model.idf[h]) for h, n in grams.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[h]) for h, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        kind = min(int(math.log2(sum(grams.values())) / 2), langid.CLASSES - 1)
        assert abs(cos[best] - s) < 1e-4 and model.langs[model.owner[best]] == lang
        assert r == (1 - cos[best] > model.radius[model.owner[best], kind]) or abs(1 - cos[best] - model.radius[model.owner[best], kind]) < 1e-4


def test_planted_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [(-1, "bcdfg hjklm npqrs tvwxz " * 40, None), (-2, "дом река поле лес небо " * 40, None), (-3, "7 8 9", None), (-4, "In In In In In In In In " * 200, None), (-5, None, "en"), (-6, "", "en")]
    out = langid.identify(docs.union(spark.createDataFrame(junk, docs.schema)), langid.train(docs)).collect()
    assert {r.doc_id for r in out if r.doc_id < 0 and r.rejected} >= {-1, -2, -3, -5, -6}
    assert sum(r.rejected for r in out if r.doc_id >= 0) <= 0.01 * len(out)


def test_sample_is_bounded_whatever_repeats(spark):
    df = spark.range(3000).selectExpr("id % 7 as doc_id", "concat('some words here ', id % 11) as text", "'aa' as lang").withColumn("counts", F.lit(1))
    model = langid.train(df, per_lang=5)
    assert model.langs == ["aa"] and len(model.centroids) <= langid.CENTROIDS


def test_numbers_of_any_kind_are_no_letters(spark):
    model = langid.fitted(["some english words here", "quelques mots en la langue"], ["en", "fr"])
    docs = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ① 七"), (3, "½ a")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] != "und" and got[3][0] != "und"
