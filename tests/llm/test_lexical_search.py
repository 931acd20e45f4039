"""Ranked lexical search against a plain computation and against SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences

from trafficlens.llm import lexical_search, queries


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute(docs, items, top=10):
    counted = [(doc, Counter(terms_of(text))) for doc, text in docs]
    counted = [(doc, c, sum(c.values())) for doc, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    held = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = set()
    for item, terms in wanted.items():
        scored = []
        for doc, c, n in counted:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out |= {(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored)[:top])}
    return out


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture
def library():
    pick = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "été", "naïve", "日本", "A1", "a1"]
    text = lambda n: " ".join(pick.choices(vocabulary, k=n))
    docs = [(k, text(pick.choice([1, 3, 8, 40]))) for k in range(300)]
    docs += [(300, None), (301, ""), (302, " .,- "), (303, text(4000)), (7, docs[7][1]), (None, docs[9][1]), (500, docs[9][1])]
    items = [(k, text(pick.choice([1, 2, 6, 20]))) for k in range(25)] + [(50, None), (51, "..."), (3, "w1 w2"), (None, "w5"), (52, "unseen words")]
    return docs, items


@pytest.mark.parametrize("query_bytes", [1 << 20, 300])
def test_against_all_scores(spark, library, query_bytes):
    docs, items = library
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, item_id string, score int").repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id int, text string, doc_id int")
    found = lexical_search.search(frame, asked, query_bytes=query_bytes)
    assert rows(found) == sorted(brute(docs, items), key=repr)
    assert found.schema["item_id"].dataType.simpleString() == "int"


@pytest.mark.parametrize("coordinates", [1, 7, 4096])
def test_sketches_of_any_width_find_the_same_and_spare_work(library, coordinates):
    docs, items = library
    docs, items = [d for d in docs if d[0] is not None], [i for i in items if i[0] is not None]
    asked = lexical_search.build_queries(pa.array([i for i, _ in items]), pa.array([t for _, t in items]))
    counted = [terms_of(t) for _, t in docs]
    asked.n_docs, asked.n_terms = sum(map(bool, counted)), sum(map(len, counted))
    names = {t: h for text in [*(t for _, t in docs), *(t for _, t in items)] for t, h in zip(terms_of(text), lexical_search.W.words(pa.array([text]), lexical_search.W.ALPHANUMERIC).hashes)}
    held = Counter(names[t] for c in counted for t in set(c))
    asked.weights = np.array([math.floor(1000 * math.log((2 * asked.n_docs + 2) / (2 * held[t] + 1))) for t in asked.terms], np.int64)
    n = len(asked.ids)
    best = lexical_search.Best(np.zeros((n, 10), np.int64), np.full((n, 10), lexical_search.NO_ID))
    scored = 0
    for k in range(0, len(docs), 50):
        part = docs[k : k + 50]
        scored += lexical_search.search_slice(np.array([d for d, _ in part]), pa.array([t for _, t in part], pa.string()), asked, best, coordinates)
    mine = {(asked.ids[i].as_py(), k + 1, int(best.docs[i, k]), int(best.scores[i, k])) for i in range(n) for k in range(10) if best.scores[i, k]}
    assert mine == brute(docs, items)
    if coordinates == 4096:
        assert scored < 0.4 * n * len(docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    items = spark.createDataFrame([("a", "some words")], "item_id string, text string")
    assert lexical_search.search(docs, items).collect() == []
    some = spark.createDataFrame([(1, "some words")], "doc_id int, text string")
    assert lexical_search.search(some, items.limit(0)).collect() == []
    assert [r["doc_id"] for r in lexical_search.search(some, items).collect()] == [1]


def test_query(spark, small):
    assert differences(queries.QUERIES["op11_lexical_search"](spark, small), connect(small), queries.SQL["op11_lexical_search"]) == []
