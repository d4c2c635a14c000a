import math
import random
import re

from pyspark.sql import functions as F

from tracesift.llm import secrets


def base(text):
    found = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            found.append(("assign", m.start(), m.end()))
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def entropy(text):
    return -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))


def test_base_patterns():
    rnd = random.Random(3)
    bits = ["password", "PassWD", "secret", "TOKEN", "api_key", "apikey", "'", '"', " ", "=", ":", "AKIA", "AKIAAKIA", "ABCDEFGHJKLM", "deadbeef", "0123456789abcdef", "xyz/+=", "ſecret=aaaaaaaaa", "toKen=aaaaaaaaa", "\n", "é", "long_value_1"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert [s for s in secrets.find_secrets(text) if s[0] != "entropy"] == base(text)


def test_entropy_window():
    rnd = random.Random(4)
    for _ in range(600):
        text = "".join(rnd.choice(rnd.choice(["ab1", "abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghij0123456789+/"])) for _ in range(rnd.randint(20, 60)))
        need = secrets.LEAST_BITS["hex" if re.fullmatch("[0-9a-fA-F-]+", text) else "mixed"]
        hits = [i for i in range(len(text) - secrets.WINDOW + 1) if entropy(text[i : i + secrets.WINDOW]) >= need - 1e-9]
        near = any(abs(entropy(text[i : i + secrets.WINDOW]) - need) < 1e-6 for i in range(len(text) - secrets.WINDOW + 1))
        if not near:
            assert secrets.entropy_span(text) == ((hits[0], hits[-1] + secrets.WINDOW) if hits else None)


def test_allow_list():
    for text in ("550e8400-e29b-41d4-a716-446655440000", "internationalizationofeverything", "==========================", "my-long-slug-with-many-parts-2024-x1", "EXAMPLEKEY1234567890abcdefgh", "123456789012345678901234567890"):
        assert not [s for s in secrets.find_secrets(text) if s[0] == "entropy"]
    assert secrets.find_secrets("é qX7bT9zLp2VwR4sKd8Nf0Gh3J end") == [("entropy", 2, 27)]


def test_beside_allowed_parts():
    """A placeholder, letters alone or a slug clear no random key beside or in them."""
    key, letters, token = "qX7bT9zLp2VwR4sKd8Nf0Gh3J", "qXkbTvzLpcVwRusKdyNfmGhaJ", "sk-2024-9f86d081884c7d659a2feaa0c5"
    spans = lambda text: [text[a:b] for kind, a, b in secrets.find_secrets(text) if kind == "entropy"]
    assert spans(f"/srv/example/{key}") == spans(f"{key}/example/dummy-01234567890123456789") == [key]
    assert spans(f"/srv/example/{key}/dummy={key[::-1]}") == [key, key[::-1]]
    assert spans(f"/srv/example/key={key}")[0].endswith(key)
    assert spans(letters) == [letters] and spans(token) == [token.rsplit("-", 1)[1]]
    assert not spans("/usr/share/example/some-words-of-a-path/and-others") and not spans("one-two-three-four-five-six-seven")


def test_spark_rows(spark):
    rows = [(1, None), (2, ""), (3, "token=abcdefgh1"), (3, "token=abcdefgh1"), (4, "x " * 60_000 + "secret: 'abcdefgh'")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secrets", F.lit("clash")).repartition(2)
    got = sorted((r.doc_id, [(s.kind, s.start, s.end) for s in r.secrets]) for r in secrets.secret_spans(df, keep=["doc_id"]).collect())
    assert got == [(i, base(t or "")) for i, t in rows]
    assert secrets.secret_spans(df.limit(0)).count() == 0
