"""Quality, language and toxicity: held-out accuracy, edge rows, independence of batching."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from obsguard.llm import common, language, quality, toxicity
from obsguard.llm.features import FeatureSpec, pieces

MID = "/root/testdata/sf0.01"
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, score string, predicted string, i0 int, k0 int"
EDGE_ROWS = [(1, None, "en", None, "x", "y", 1, 2), (2, "", None, "s", None, None, None, None),
             (None, "some words", "en", "s", "x", "y", 1, 2), (4, "!!! 123 ...", "en", "s", "x", "y", 1, 2),
             (5, "word " * 400_000, "en", "s", "x", "y", 1, 2), (5, "word " * 400_000, "en", "s", "x", "y", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, MID, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return common.table(spark, MID, "labels")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


def test_features_do_not_depend_on_the_batch():
    spec = FeatureSpec(bits=12, orders=(2, 3))
    weights = np.random.default_rng(1).normal(size=(1 << 12, 3))
    texts = ["", "a", "the cat sat", "ünïcödé wörds — and more", "x y " * 500, " \n\t "]
    together = spec.sums(texts, weights)
    alone = np.concatenate([spec.sums([t], weights) for t in texts])
    assert np.array_equal(together, alone)
    assert np.array_equal(together[0], np.zeros(3))


def test_vectors_and_sums_agree():
    spec = FeatureSpec(bits=10, orders=(3, 4))
    weights = np.random.default_rng(2).normal(size=1 << 10)
    texts = ["one two two three", "many words here " * 50, "a"]
    for text, (ids, w) in zip(texts, spec.vectors(texts), strict=True):
        assert spec.sums([text], weights)[0, 0] == pytest.approx(float(w @ weights[ids]), rel=1e-4)


def test_long_texts_are_cut_into_pieces_without_loss():
    text = "abc def " * 200_000
    assert "".join(p for _, parts in pieces([text, "tail"]) for p in parts) == text + "tail"


def test_neighbouring_repetition_is_one_feature():
    spec = FeatureSpec(bits=16, orders=(), words=False, pairs=True)
    (a, _), (b, _) = spec.vectors(["dog dog dog", "cat cat"])
    assert len(a) == 1 and list(a) == list(b)


def test_quality_on_held_out_rows(docs, labels):
    model = quality.fit_quality(docs, labels)
    got = (quality.score_quality(docs.select("doc_id", "text"), model).join(labels, "doc_id")
           .where(common.held_out(F.col("doc_id"))).select("quality", "predicted", "score").collect())
    assert sum(r.quality == r.predicted for r in got) / len(got) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_on_held_out_rows(docs):
    model = language.fit_languages(docs)
    got = language.identify(docs, model).where(common.held_out(F.col("doc_id"))).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.97


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 20, 60])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    assert len(code) == n and len({tuple(c) for c in code}) == n or n == 1
    if n > 1:
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert least >= code.shape[1] / 4


def test_decoding_mends_a_wrong_bit():
    model = language.LanguageModel(FeatureSpec(), list("abcd"), language.codewords(4), None, None, np.ones(7), 0.1)
    margins = model.code[2] * 3.0
    margins[1] *= -1
    best, share, unsure = model.decode(margins[None, :])
    assert best[0] == 2 and not unsure[0]
    assert model.decode(np.zeros((1, 7)))[2][0]


@pytest.mark.parametrize("word", ["idiot", "IDIOT", "1d10t", "іdіоt", "idi​ot", "ｉｄｉｏｔ", "id!ot"])
def test_disguises_fold(word):
    assert toxicity.fold(f"you {word}, there") == " you idiot there "


def test_exception_phrases_spare_their_entry():
    lexicon = toxicity.ToxicLexicon({" scum ": 5.0, " tras": 5.0}, {" scum bag ": 1.0, " trashcan ": 1.0})
    assert [p for p, _ in lexicon.matches("the scum bag in a trashcan")] == []
    assert [p for p, _ in lexicon.matches("scum, trashy")] == [" scum ", " tras"]
    assert lexicon.matches("muscum xtrash") == []


def test_longer_texts_need_more_evidence():
    lexicon = toxicity.ToxicLexicon({" scum ": 4.0}, base=-2.0)
    short, long = lexicon.score(["scum", "scum " + "fine words " * 5000])
    assert short > 0.5 > long


def test_toxicity_learns_words_not_copies(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [f"w{(i * 7 + j * 13) % 97}" for j in range(30)]
        if toxic:
            words[5 + i % 20] = "blorg" + "abcd"[i % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, "copied zzz text of one toxic page blorga") for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.fit_lexicon(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("blor" in e for e in lexicon.entries) and not any("zzz" in e for e in lexicon.entries)
    got = toxicity.score_toxicity(spark.createDataFrame([(1, "nice w1 w2 bl0rgc w3"), (2, "nice w1 w2 w3")], "id int, text string"),
                                  lexicon).orderBy("id").collect()
    assert [r.predicted for r in got] == [1, 0]


def test_edge_rows_and_clashing_names(spark, docs, labels, edge):
    q = quality.score_quality(edge, quality.fit_quality(docs.limit(0), labels))
    share = {r.score for r in q.collect()}       # nothing to learn from: the known share of label 1
    assert q.columns[-2:] == ["score", "predicted"] and len(share) == 1 and 0.5 < share.pop() < 1
    lm = language.fit_languages(docs)
    got = language.identify(edge, lm).collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, False, True, False, False]
    assert [r.score for r in got][:2] == [0.0, 0.0] and got[0].i0 == 1 and got[0].k0 == 2
    assert [r.doc_id for r in language.keep_identified(edge, lm).collect()] == [None, 5, 5]
    assert language.keep_identified(edge, lm).columns == edge.columns
    t = toxicity.score_toxicity(edge, toxicity.ToxicLexicon({" word ": 1.0}))
    assert t.count() == len(EDGE_ROWS) and t.schema["score"].dataType.simpleString() == "double"


def test_untrainable_inputs(spark, docs, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(edge.select("doc_id", "text"), quality.fit_quality(docs, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(edge.select("text"), toxicity.fit_lexicon(docs, none)).collect()} == {0.0}
    blank = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(edge, language.fit_languages(blank)).collect()} == {"und"}
    assert language.identify(blank, language.fit_languages(blank)).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    ids = [r.id for r in spark.range(200).where(common.held_out(F.col("id"))).collect()]
    docs = spark.createDataFrame([(i, "qua ", "xx") for i in ids] + [(1, "some text", "en")], "doc_id long, text string, lang string")
    assert 0 < len(ids) < 200 and 1 not in ids
    assert language.fit_languages(docs).languages == ["en"]


def test_columns_are_added_a_run_of_rows_at_a_time(spark):
    rows = [(i, None if i % 7 == 0 else f"{i} " + "x" * 200_000) for i in range(60)] + [(None, ""), (3, "3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def run(batch):
        texts = common.texts_of(batch.column(0))
        return [len(t) for t in texts], [t.split(" ")[0] for t in texts], [batch.nbytes] * len(texts)

    got = common.add_columns(docs, run, ["text"], "n long, word string, size long").collect()
    assert [(r.doc_id, r.n, r.word) for r in got] == [(i, len(t or ""), (t or "").split(" ")[0]) for i, t in rows]
    assert [r.text for r in got] == [t for _, t in rows]
    assert max(r["size"] for r in got) < 3 * common.SLICE_BYTES       # all rows together: 10 MB
    assert common.add_columns(docs.where("doc_id < 0"), run, ["text"], "n long, word string, size long").count() == 0
