import string
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from trafficlens.llm import queries, secrets

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    out = [(m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(out)]


def entropies(s, window=secrets.WINDOW):
    parts = [s[i : i + window] for i in range(len(s) - window + 1)]
    return max(-sum(p.count(c) / window * math.log2(p.count(c) / window) for c in set(p)) for p in parts)


TEXTS = [
    None, "", "nothing", "password = hunter2secret", "PassWord: 'abc'", "secret=token:abcdefgh", "token==x" + "y" * 9, 'api_key: "abcdef"', "é\U0001f642 APIKEY=zzzzzz passwd=1",
    "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 14, "AKIA" + "Z9" * 10 + " AKIA" + "Q" * 30, "0123456789abcdef0123456", "0123456789abcdef01234567", "g" + "ab12" * 8 + "G" + "cd34" * 7,
    "token = " + "deadbeef" * 5, "secret: 'x' secret: 'abcdefg'", "a" * 200_000 + " token=abcdef " + "f" * 30, "token=abcdef " * 3000,
]


def test_base_spans(spark, frame):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[3])]
    got = secrets.secret_spans(frame(rows)).select("doc_id", secrets.digest(F.filter("spans", lambda x: ~x["kind"].startswith("entropy"))).alias("s")).collect()
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(((r["doc_id"], r["s"]) for r in got), key=key) == sorted(((i, ",".join(base_spans(t))) for i, t in rows), key=key)
    assert secrets.secret_spans(frame([])).collect() == []


def test_entropy_by_increments(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh01") for _ in range(rng.randrange(20, 80))) for _ in range(40)] + ["a" * 20, "abcdefghijklmnopqrst" * 3]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.entropy(F.col("t")).alias("h")).collect()
    for r in got:
        assert r["h"] == pytest.approx(entropies(r["t"]))


@pytest.mark.parametrize(("text", "found"), [
    ("key Zx81kQpL0vTr5YbNw3Gs7 end", "Zx81kQpL0vTr5YbNw3Gs7"),  # mixed
    ("sum 9F86D081884C7D659A2F end", "9F86D081884C7D659A2F"),  # upper-case hex
    ("id 123e4567-e89b-12d3-a456-426614174000 end", None),  # UUID
    ("see AbCdExampleKey0123456789xyz end", None),  # placeholder
    ("donaudampfschifffahrtsgesellschaft", None),
    ("path usr/Share2/Docs/Readme1/Things end", None),
    ("zzzzzzzzzzzzzzzzzzzzzzzzzA1", None),
])
def test_entropy_spans(spark, frame, text, found):
    spans = secrets.secret_spans(frame([(1, text)])).first()["spans"]
    assert [text[s["start"] : s["end"]] for s in spans] == ([found] if found else [])


def test_entropy_stays_off_base_spans(spark, frame):
    text = "token = Zx81kQpL0vTr5YbNw3Gs7 and Qx81kQpL0vTr5YbNw3Gs7"
    spans = secrets.secret_spans(frame([(1, text)])).first()["spans"]
    assert [s["kind"] for s in spans] == ["assign", "entropy_mixed"]


def test_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op6_secrets(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        expected = base_spans(docs[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in expected) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("entropy")] == expected


def test_each_class_of_characters(spark):
    """Random strings of every class are found whole; words, slugs, identifiers and names with numbers are not."""
    pick = random.Random(21)
    lower, upper = string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567"
    kinds = {"entropy_lower": lower, "entropy_upper": upper, "entropy_letters": string.ascii_letters}
    rows, wanted = [], {}
    for kind, letters in kinds.items():
        for _ in range(40):
            rows.append((len(rows), "see " + "".join(pick.choices(letters, k=32)) + " here"))
            wanted[rows[-1][0]] = kind
    clean = ["internationalization of counterrevolutionaries", "a-slug-of-several-plain-words-2024", "getUserAccountInformationFromTable",
             "chapter0123456789abcdefgh", "SOMECONSTANTNAMEOFALONGKIND", "releasecandidateversion20240131", "the quick brown fox " * 3]
    rows += [(1000 + k, x) for k, x in enumerate(clean)]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not any(got[1000 + k] for k in range(len(clean)))
    found = {k: [(s["kind"], s["start"], s["end"]) for s in got[k]] for k in wanted}
    for kind in kinds:
        mine = [k for k in wanted if wanted[k] == kind]
        assert sum(found[k] == [(kind, 4, 36)] for k in mine) >= 0.9 * len(mine)
