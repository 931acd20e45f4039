import zlib

import numpy as np
import pyarrow as pa

from trafficlens.llm import language as L
from trafficlens.llm import queries


def test_held_out_accuracy(spark, small):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op7_language(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    told = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in told]) >= 0.98


def test_cases(spark, frame):
    en, de, fr, tlh = "the cat and the dog with this thing ", "der hund und die katze mit dem ding ", "le chat et les chiens avec une chose ", "qapla nuqneh jagh worf batleth "
    rows = [(k, t * (1 + k % 5), lang, "s") for k in range(60) for lang, t in [("en", en), ("de", de), ("fr", fr), ("tlh", tlh)]]
    docs = frame(rows + [(999, en, None), (998, None, "en")])
    model = L.fit(docs)
    assert model.members == {"germanic": ["de", "en"], "romance": ["fr"], "tlh": ["tlh"]} and model.pairs == [("de", "en")]
    ask = frame([(1, en), (2, de), (3, fr), (4, None), (5, ""), (6, "123 ... \U0001f642"), (7, fr * 20_000), (8, tlh), (1, en)])
    got = L.predict(ask, model)
    assert got.columns == [*ask.columns, "lang_pred", "score"]
    assert [r["lang_pred"] for r in got.orderBy("doc_id").collect()] == ["en", "en", "de", "fr", "und", "und", "und", "fr", "tlh"]
    assert L.predict(ask.limit(0), model).collect() == []


def test_nothing_and_one_language(spark, frame):
    ask = frame([(1, "abc"), (2, None)])
    assert {r["lang_pred"] for r in L.predict(ask, L.fit(ask)).collect()} == {"und"}
    one = L.fit(frame([(1, "abc", "xx")]))
    assert sorted((r["lang_pred"], r["score"]) for r in L.predict(ask, one).collect()) == [("und", 0.0), ("xx", 1.0)]


def test_filter_keeps_columns(spark, frame):
    docs = frame([(k, "the cat and dog", "en") for k in range(9)] + [(10, "?!", "en"), (11, None, "en")])
    kept = L.known_languages(docs, L.F.lit(True))
    assert kept.columns == docs.columns and kept.count() == 9


def test_grams_do_not_cross_texts():
    together, apart = L.features(pa.array(["ab", "cd", ""])), [L.features(pa.array([x]))[0] for x in ("ab", "cd", "")]
    assert np.allclose(together, np.stack(apart))


def test_letters_of_all_planes(spark):
    """Tags and private characters are no letters, rare ideographs are."""
    from trafficlens.llm import language as L

    texts = [chr(0xE0041) * 5, chr(0xF0000) * 5, chr(0x1F600), chr(0x20000), "a" + chr(0xF0000)]
    _, _, has = L.grams(pa.array(texts))
    assert has.tolist() == [False, False, False, True, True]
    assert L._folded(np.array([ord("A"), 0x10400, 0x20001, 0xE0041], np.uint32)).tolist() == [ord("a"), ord(chr(0x10400).lower()), 0x20001, 32]
