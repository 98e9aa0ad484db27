import numpy as np
from odd import LONG, documents, empty
from pyspark.sql import functions as F

from slotvalue.llm import common, langid
from slotvalue.llm.common import remainder, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    held = remainder("doc_id", 4) == 2
    got = langid.identify(docs, langid.fit(docs, ~held)).where(held).agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"), F.avg(F.col("ambiguous").cast("int")).alias("amb"))
    assert got.first().acc > 0.98 and got.first().amb < 0.02


def test_odd_documents(spark):
    docs = documents(spark).withColumn("lang_pred", F.lit("taken"))
    rows = langid.identify(docs, langid.fit(docs, F.lit(True))).collect()
    assert len(rows) == docs.count() and rows[0].lang_pred == "taken"
    for r in rows:
        lettered = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r["_lang_pred"] in ("en", "de")) == lettered and 0 <= r["_score"] <= 1
        assert lettered or (r["_lang_pred"] == "und" and r["_score"] == 0 and not r.ambiguous)


def test_no_labels_and_one_label(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    assert langid.fit(docs, F.lit(False)) is None and langid.fit(empty(spark), F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    one = langid.fit(docs, F.col("lang") == "de")
    assert {r.score for r in langid.identify(docs, one).collect()} == {0.0, 1.0}
    assert langid.identify(empty(spark), one).count() == 0


def test_means_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32)
    texts = [b"", b"a", b"ab", LONG.encode()[:5000], b"xyz", "größe".encode(), b""]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    raw = langid._LOW[raw]
    whole = common.gram_means(raw, offs, weights, langid.ORDERS, langid.BITS)
    for n, t in enumerate(texts):  # each text alone, n-gram by n-gram
        low = langid._LOW[np.frombuffer(t, np.uint8)]
        grams = [i for o in langid.ORDERS for i in common.gram_buckets(low, o, langid.BITS).tolist()]
        want = weights[grams].mean(0) if grams else np.zeros(3)
        assert np.allclose(whole[n], want, atol=1e-5)
    monkeypatch.setattr(common, "CHUNK", 7)
    assert np.allclose(common.gram_means(raw, offs, weights, langid.ORDERS, langid.BITS), whole, atol=1e-5)


def test_codewords_differ_and_correct_errors():
    for n in (2, 3, 4, 5, 9, 30):
        book = langid.codebook(n)
        far = min((book[i] != book[j]).sum() for i in range(n) for j in range(i))
        assert len(book) == n and far >= (1 if n == 2 else 2)
        wrong = (far - 1) // 2
        margins = book * 3.0
        margins[:, :wrong] *= -1
        best, _ = langid.decode(langid.Model([], book, np.zeros(0), np.zeros(0)), margins)
        assert best.tolist() == list(range(n))


def test_model_does_not_depend_on_the_layout(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("text", "lang")
    one = langid.fit(docs, F.lit(True), sample=60)
    two = langid.fit(docs.union(docs).repartition(7, "text"), F.lit(True), sample=120)
    assert (one.weights == two.weights).all() and (one.bias == two.bias).all() and one.weights.any()
