"""Spelling variants against edit distances of all pairs and against SQL."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import connect, differences

from trafficlens.llm import queries, spelling


def near(u, v):
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    u, v = sorted((u, v), key=len, reverse=True)
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def brute(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, form = {}, {}
    for w, n in words.items():
        others = sorted((-k, v) for v, k in words.items() if near(w, v))
        form[w] = others[0][1] if others and -others[0][0] >= 10 * n else None
        out[w] = (n, len(others))
    rows = set()
    for w, (n, n_near) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, n_near, words[form[w]] if form[w] else None))
    return rows


def rows(df):
    return set(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.fixture(scope="module")
def library():
    pick = random.Random(8)
    bases = ["".join(pick.choices("abé", k=pick.randint(6, 10))) for _ in range(25)] + ["aaaaaaaa", "naïveté", "ÉCOLEÉCOLE", "aaaaaaaaa", "x" * 3000]
    words = []
    for base in bases:
        words += [base] * pick.choice([1, 2, 40, 500])
        for _ in range(30):
            i = pick.randrange(len(base) + 1)
            words += [pick.choice([base[:i] + base[i + 1 :], base[:i] + pick.choice("abé") + base[i:], base[:i] + pick.choice("abé") + base[i + 1 :]])] * pick.choice([1, 2, 3, 30])
    pick.shuffle(words)
    docs = [(k, " ".join(words[k::40]).upper() if k % 7 == 0 else ", ".join(words[k::40])) for k in range(40)]
    return docs + [(40, None), (41, ""), (42, "12 34 _"), (None, " ".join(words[:50])), (3, docs[3][1])]


@pytest.mark.parametrize("part_words", [8192, 6, 1])
def test_against_all_pairs(spark, library, part_words):
    frame = spark.createDataFrame([(*d, "x", 1, "y") for d in library], "doc_id bigint, text string, word string, n int, part string").repartition(3)
    found = spelling.variants(frame, part_words=part_words)
    assert rows(found) == brute(library)
    assert found.count() == len(brute(library))


@pytest.mark.parametrize("seed", range(30))
def test_composition_accepts_each_pair_once(seed):
    pick = random.Random(seed)
    width, alphabet = pick.randint(1, 5), pick.choice([2, 3, 8])
    texts = {(pick.randrange(3), tuple(pick.randint(1, alphabet) for _ in range(width + pick.randrange(2)))) for _ in range(120)}
    texts = sorted((p, (*t, 0)[: width + 1]) for p, t in texts)
    left, right = spelling.compose(np.array([p for p, _ in texts]), np.array([t for _, t in texts], np.uint32), True)
    mine = sorted(zip(left.tolist(), right.tolist()))
    plain = [(p, t[:-1] if t[-1] == 0 else t) for p, t in texts]
    wanted = [(i, j) for i, (p, u) in enumerate(plain) for j, (q, v) in enumerate(plain)
              if p == q and len(v) == width and near(u, v) and (len(u) > len(v) or i > j)]
    assert mine == wanted


def test_states_with_equal_endings_are_one():
    words = sorted((p, *x) for p in range(4) for x in [(1, 2, 3, 0), (1, 2, 4, 0), (5, 2, 3, 0), (5, 2, 4, 0)])
    levels, _ = spelling.acceptor(np.array([w[0] for w in words]), np.array([w[1:] for w in words], np.uint32))
    assert [len(x.start) - 1 for x in levels] == [1, 1, 1, 1]


def test_empty_tables(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    few = spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id int, text string")
    assert spelling.variants(few).collect() == []


def test_query(spark, small):
    assert differences(queries.QUERIES["op13_spelling_variants"](spark, small), connect(small), queries.SQL["op13_spelling_variants"]) == []
