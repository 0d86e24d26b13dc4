import hashlib
import random

import pytest

from lodestack.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def own():
    with open(bpe.default_vocabulary(), "rb") as f:
        return bpe.Bpe(f.read())


def ids(own, text):
    import numpy as np

    return np.frombuffer(own.encode(text), "<i4").tolist()


CASES = [
    "", " ", "a", "  a  b\n\n c ", "it's we'll I'd", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "naïve Straße 12345 €", "日本語のテキスト", "a  b\x85c\x1c\x1dd",
    "x" * 5000, "ab" * 3000, "!?" * 900, "\n" * 700, "́e‍👩‍👩‍👧", "١٢٣ ½ ²", "\x00\x01\x7f",
]


@pytest.mark.parametrize("text", CASES)
def test_like_the_library(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(own, text) == want


def test_random_texts(own, library):
    rng = random.Random(3)
    pool = " \t\n'abcdest.,;:()019éüñß漢字 　—ǅ" + "the ing"
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(120)))
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_frame(spark, own, library):
    rows = [(1, "The cat's here.", "k"), (2, None, "k"), (3, "", "k"), (3, "", "k"), (4, "Größe " * 50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bpe_ids string")
    out = {(r.doc_id, r.text): r for r in bpe.decode(bpe.encode(df)).collect()}
    assert out[2, None].bpe_ids is None and out[2, None].bpe_text is None
    assert out[3, ""].bpe_ids == [] and out[3, ""].bpe_text == ""
    assert out[1, rows[0][1]].bpe_ids == library.encode(rows[0][1], add_special_tokens=False).ids
    assert all(r.bpe_text == r.text for r in out.values())
    assert bpe.encode(df.limit(0)).count() == 0


def test_query(spark, library, tiny):
    got = {r.doc_id: r for r in bpe.query(spark, tiny).collect()}
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        text = library.decode(want, skip_special_tokens=False)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decode_of_any_ids(own, library):
    """Ids that split characters, stand alone or repeat: broken bytes become replacement characters as in the library."""
    import numpy as np

    rng = random.Random(4)
    whole = [i for t in ("日本語 👩‍👩‍👧 é ñ ß", "naïve €", "plain words") for i in library.encode(t, add_special_tokens=False).ids]
    for _ in range(300):
        ids_ = [rng.choice(whole) if rng.random() < 0.7 else rng.randrange(library.get_vocab_size()) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids_, np.int64)).decode("utf-8", "replace") == library.decode(ids_, skip_special_tokens=False)
