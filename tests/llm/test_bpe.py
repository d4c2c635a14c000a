import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tracesift.llm.bpe import TrieEncoder, bpe_decode, bpe_encode  # noqa: E402

PATH = str(P.path("word_bpe_49k.json"))
ENCODER, LIBRARY = TrieEncoder(PATH), Tokenizer.from_file(PATH)
ODD = ["", "a<|endoftext|>b <|startoftext|>", "Ünḯ é  x y", "x\x1c!\x1f?", "ΑΣ İstanbul ﬁ", "😂😂😂😂 🇺🇸🇺🇸", "don't I'll we've 123 !!!...", "</w> a</w>", "x" * 3000, "日本語 テスト", "à́ ́b", "\n\t "]


def same(texts):
    got = [np.frombuffer(x, "<i4").tolist() for x in ENCODER.encode(texts)]
    assert got == [r.ids for r in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [ENCODER.decode(ids) for ids in got] == [LIBRARY.decode(ids, skip_special_tokens=False) for ids in got]


def test_odd_texts():
    same(ODD)


def test_random_words():
    rnd = random.Random(5)
    same(["".join(rnd.choice("abcdetinghors'’é!.<|>/w 12\n\t ßÀ") for _ in range(rnd.randint(1, 60))) for _ in range(1500)])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    same([text])


def test_spark_rows(spark):
    texts = [*ODD, None, ODD[1], ODD[1], "long " * 20_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    rows = {r.doc_id: r for r in bpe_decode(bpe_encode(df, PATH), PATH).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == want and rows[i].decoded == LIBRARY.decode(want, skip_special_tokens=False) and rows[i].text == t
    assert bpe_encode(df.limit(0), PATH).count() == 0


def test_query(spark, tmp_path):
    from tracesift.llm.queries import op1_bpe

    spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1_bpe(spark, str(tmp_path)).collect():
        ids = LIBRARY.encode([*ODD, ""][r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
