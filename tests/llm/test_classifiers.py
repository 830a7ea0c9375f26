"""The classifiers' accuracy on held-out rows, and their odd cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.llm import calibrate, language, quality, toxicity
from arcloom.llm.common import held_out, table

SMALL = "/root/testdata/sf0.01"
ODD = [(90001, None), (90002, ""), (90003, "123 ... !!"), (90004, "the and of " * 40_000), (90005, "x"), (None, "the thing of")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    base = table(spark, SMALL, "documents")
    return base.unionByName(odd.select(*(F.col(f.name).cast(f.dataType) for f in base.schema)))


def test_language(spark, docs):
    model = language.train(docs, ~held_out(3, 1), settings=language.Settings(train_rows=500, epochs=4))
    rows = {r.doc_id: r for r in language.identify(docs, model, keep=("doc_id", "lang")).collect()}
    own = [r for i, r in rows.items() if i and i < 90000 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in own]) > 0.97 and np.mean([r.accepted for r in rows.values()]) > 0.98
    assert [(rows[i].lang_pred, rows[i].score, rows[i].accepted) for i in (90001, 90002, 90003)] == [("und", 0.0, False)] * 3
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[None].lang_pred == "en" and len(rows) == 1000 + len(ODD)
    none = language.identify(docs, language.train(docs, F.lit(False))).collect()
    assert {r.lang_pred for r in none} == {"und"} and language.identify(docs.where("false"), model).count() == 0


def test_bags_count_every_subword():
    s = language.Settings(buckets=64)
    at, n = language.bag([b"aaa", b"aaa", b"b"], s, {})
    assert n.sum() == 2 * len(language.subwords(b"aaa", s)) + len(language.subwords(b"b", s)) and len(at) <= 64


@pytest.mark.parametrize("module, column, least", [(toxicity, "toxic", 0.8), (quality, "quality", 0.9)])
def test_classifier(spark, docs, module, column, least):
    labels = table(spark, SMALL, "labels")
    rows = {r.doc_id: r for r in module.score(docs, labels, held_out(4, 2)).collect()}
    assert len(rows) == 1000 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.DECIDES) for r in rows.values())
    truth = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    own = [(truth[i], rows[i].predicted) for i in truth if rows[i].held_out]
    assert np.mean([a == b for a, b in own]) > least and rows[None].held_out is False
    assert module.score(docs.where("false"), labels, held_out(4, 2)).count() == 0
    assert len({r.score for r in module.score(docs, labels.where("false"), held_out(4, 2)).collect()}) == 1


@pytest.fixture(scope="module")
def twice(docs):
    """Some rows twice, with columns that operators might use for themselves."""
    some = docs.where("doc_id < 150 OR doc_id IS NULL")
    return some.unionAll(some).withColumns({c: F.lit("clash") for c in ("id", "y", "k0", "lang_pred", "score", "predicted", "held_out", "accepted", "_h", "_key")})


def pairs(rows, *columns):
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return found


def test_language_of_repeated_rows(twice):
    model = language.train(twice, F.lit(True), settings=language.Settings(train_rows=100, epochs=2))
    found = pairs(language.identify(twice, model).collect(), "lang_pred", "score")
    assert all(len(x) == 2 and x[0] == x[1] for x in found.values()) and len(found) > 100


@pytest.mark.parametrize("module, settings", [(toxicity, toxicity.Settings(each=40, epochs=1)), (quality, quality.Settings(each=40, epochs=1))])
def test_scores_of_repeated_rows(spark, twice, module, settings):
    labels = table(spark, SMALL, "labels").select("doc_id", "quality", "toxic")
    labels = labels.unionAll(labels).unionAll(labels.limit(1).select(F.lit(None).cast("bigint"), F.lit(None).cast(labels.schema["quality"].dataType), F.lit(7).cast(labels.schema["toxic"].dataType)))
    found = pairs(module.score(twice, labels, held_out(4, 2), settings=settings).collect(), "score", "predicted")
    assert all(len(x) == 2 and x[0] == x[1] for x in found.values()) and len(found) > 100


def test_tables_score_as_the_network_does():
    s = toxicity.Settings(buckets=128)
    net = toxicity.Network(s)
    model = toxicity.Model(net.tables(), 1.0, 0.0, {"": 0.0}, None)
    index = model.index()
    for text in (b"", b"one", b"Two words", b"many more, words! " * 5000):
        assert abs(net.logit(toxicity.encoded(text, s)) - model.read(text, index)[0]) < 1e-3


def test_chunks_cover_the_whole_text():
    s = quality.Settings(filters=4)
    net = quality.Network(s)
    rng = np.random.default_rng(0)
    for n in (0, 5, 512, 513, 960, 961, 5000, quality.AT_A_TIME + 700):
        b = quality._bytes(bytes(rng.integers(32, 127, n, dtype=np.uint8)))
        z = net.responses(b)
        starts = range(0, max(1, len(b) - (quality.CHUNK - quality.STRIDE)), quality.STRIDE)
        got = net.chunk_maxima(b, net.pairs())
        assert np.allclose(got.max(0), z.max(0), atol=1e-4) and len(got) >= len(starts) - 1


def test_calibration():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.3).astype(float)
    z = y * 2 + rng.normal(0, 1, 4000)
    a, b = calibrate.platt(z, y, np.ones(4000))
    assert abs(calibrate.sigmoid(a * z + b).mean() - 0.3) < 0.02
    assert 0.3 < calibrate.threshold(z, y, np.ones(4000)) < 2
