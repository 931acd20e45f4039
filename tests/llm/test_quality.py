import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import quality as Q
from trafficlens.llm import queries


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_statistics(spark, frame):
    rng = random.Random(7)
    texts = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 30, "é\U0001f642 <#>\n<#>\n\n<#>", "\x0b\x0c\r w"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)] + ["word " * 20_000]
    texts += [" ".join(f"w{rng.randrange(9)}" for _ in range(40)) + "\n" + " ".join(f"v{k}" for k in range(25)) for _ in range(5)]
    docs = frame([(k, t, [None, "en"][k % 2], [None, "s", "t"][k % 3]) for k, t in enumerate(texts)])
    got = Q.quality(docs).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [brute(t) for t in texts]
    assert all(r["kept"] is False for r in got if r["base_failed"]) and all(r["kept"] is not None for r in got)
    assert Q.quality(docs.limit(0)).collect() == []


def test_outliers_of_a_group(spark, frame):
    """A third of a group's rows are junk; the estimate holds on to the rest, which stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    clean = [(k, " ".join(word() for _ in range(rng.randrange(30, 300))), "en", "s") for k in range(300)]
    junk = [(1000 + k, " ".join(word() + "%%%" for _ in range(100)), "en", "s") for k in range(80)]
    few = [(2000 + k, " ".join(word() for _ in range(60)), "xx", None) for k in range(3)]
    kept = {r["doc_id"] for r in Q.quality(frame(clean + junk + few)).where("kept").collect()}
    assert kept == {r[0] for r in clean + few}


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) * 0.3 + 1
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "scope string, " + ", ".join(f"{c} double" for c in Q.VECTOR))
    got = Q._distance(rows.join(Q._fitted(rows, ["scope"]), "scope"), "d").select(*Q.VECTOR, "d").collect()
    factor = Q.SHARE / Q._chi2(Q._chi2_quantile(Q.SHARE, 4), 6)
    inverse = np.linalg.inv(np.cov(x.T, bias=True) * factor + np.diag(np.square(Q.FLOORS)))
    for r in got:
        v = np.array(r[:4]) - x.mean(0)
        assert r["d"] == pytest.approx(v @ inverse @ v)


def test_chi2():
    assert Q._chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3) and Q._chi2(3.3567, 4) == pytest.approx(0.5, abs=1e-4)


def test_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op4_quality(spark, small).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == {i: brute(t) for i, t in docs.items()}
    passed = [r for r in got if not r["base_failed"]]
    assert sum(r["kept"] for r in passed) >= 0.8 * len(passed)
    # junk full of symbols goes, plain prose stays
    assert all(r["kept"] == (r["n_symbols"] < 0.2 * r["word_chars"]) for r in passed if not 0.02 < r["n_symbols"] / r["word_chars"] < 0.2 and r["n_repeat_words"] == 0)


def test_repeated_words_column(spark):
    got = spark.createDataFrame([(["a"] * 9,), ([],), (["a"] * 7,)], "w array<string>").select(Q.repeated_words(F.col("w")).alias("n")).collect()
    assert [r["n"] for r in got] == [9, 0, 0]


def test_each_statistic_rejects_by_itself(spark, frame):
    """Repeated short lines between others, words in repeated windows, and symbols, each in a clean group."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    clean = [(k, "\n".join(some(12) for _ in range(rng.randrange(5, 20))), "en", "s") for k in range(300)]
    lines = "\n".join("\n".join(["ok"] * 6 + [some(6)]) for _ in range(40))
    passage = some(29)
    repeats = f"{some(71)} {passage} {some(71)} {passage} "
    symbols = " ".join(word() + "%" * (k % 2) for k in range(100))
    odd = [(1000, lines, "en", "s"), (1001, repeats, "en", "s"), (1002, symbols, "en", "s")]
    got = {r["doc_id"]: r for r in Q.quality(frame(clean + odd)).collect()}
    assert not any(got[k]["base_failed"] for k in (1000, 1001, 1002))
    assert got[1000]["n_dup_lines"] > 0.8 * got[1000]["n_lines"] and got[1000]["n_repeat_words"] == 0
    assert {k for k, r in got.items() if not r["kept"]} == {1000, 1001, 1002}


def test_groups_blend_into_the_overall_estimate(spark):
    """By numpy: the moments of a mixture, by a weight that grows evenly with the rows of a group."""
    rng = np.random.default_rng(11)
    sizes = {"few": 5, "small": 40, "large": 300}
    x = {g: rng.normal(size=(n, 4)) * 0.3 + k for k, (g, n) in enumerate(sizes.items())}
    x[""] = np.concatenate(list(x.values()))
    rows = spark.createDataFrame([(g, *map(float, r)) for g, v in x.items() for r in v], "scope string, " + ", ".join(f"{c} double" for c in Q.VECTOR))
    got = Q.blended(Q._fitted(rows, ["scope"]), spark.createDataFrame(list(sizes.items()), "grp string, rows bigint")).collect()
    factor = Q.SHARE / Q._chi2(Q._chi2_quantile(Q.SHARE, 4), 6)
    scatter = {g: np.cov(v.T, bias=True) * factor + np.diag(np.square(Q.FLOORS)) for g, v in x.items()}
    assert {r["grp"] for r in got} == set(sizes)
    for r in got:
        g = r["grp"]
        w = max(0, sizes[g] - 6) / (max(0, sizes[g] - 6) + 50)
        factors = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        apart = x[g].mean(0) - x[""].mean(0)
        assert [r[f"m{i}"] for i in range(4)] == pytest.approx(w * x[g].mean(0) + (1 - w) * x[""].mean(0))
        assert factors @ factors.T == pytest.approx(w * scatter[g] + (1 - w) * scatter[""] + w * (1 - w) * np.outer(apart, apart))


def test_one_row_more_hardly_changes_a_verdict(spark, frame):
    """A group of its own character at 99 and at 100 rows: distances stay nearly the same."""
    rng = random.Random(12)
    word = lambda size: "".join(rng.choice("abcdefghij") for _ in range(size))
    clean = [(k, " ".join(word(rng.randrange(2, 9)) for _ in range(60)), "en", "s") for k in range(300)]
    own = [(1000 + k, " ".join(word(rng.randrange(7, 14)) for _ in range(60)), "xx", "t") for k in range(100)]
    at = lambda rows: {r["doc_id"]: r["distance"] for r in Q.quality(frame(rows)).collect()}
    fewer, more = at(clean + own[:-1]), at(clean + own)
    assert max(abs(fewer[k] - more[k]) for k in fewer if k >= 1000) < 1
