import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewake.llm import bpe
from tidewake.llm.queries import tokenizer_path

PATH = tokenizer_path()
TEXTS = [None, "", " \n\t ", "Hello  World", "<|endoftext|>x's <|startoftext|>", "ΑΣ Σ \x1c İ ǅ 中文 ñandú Å é", "a" * 5000, "can't 12,345 !!??", "\\### x </turn>", "Hello  World"]
ROWS = [(i, t, "n_tokens clash") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (3, "Hello  World", None)]
SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_coders_equal_the_library(library):
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS]
    texts += ["".join(rng.choice("abcdeinorst'  .,!12é") for _ in range(80)) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(60)) for _ in range(200)]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = list(bpe.encode_text(PATH, text))
        assert ids == e.ids and bpe.count_text(PATH, text) == len(ids)
        assert bpe.decode_ids(PATH, ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_is_sound_or_not_by_merging():
    v = bpe.vocabulary(PATH)
    coder, counter = bpe.PrefixCoder(v), bpe.MergeCounter(v)
    for token, i in list(v.ids.items())[512::997]:
        assert (coder.encode(token) == (i,)) == (counter.count(token) == 1)


def test_round_trip_of_tricky_rows(spark, library):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    key = lambda r: (r.doc_id is None, r.doc_id, r.decoded)
    assert sorted(bpe.bpe_roundtrip(df, PATH).collect(), key=key) == sorted(out, key=key)
    for i, t, _ in ROWS:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert by[i].ids == want and by[i].decoded == library.decode(want, skip_special_tokens=False)
    assert hashlib.sha256(b"").hexdigest() == bpe.bpe_encode(df.filter("doc_id = 0"), PATH).select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)).first()[0]


def test_counts_of_tricky_rows(spark, library):
    out = {r.doc_id: r for r in bpe.count_tokens(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()}
    for i, t, _ in ROWS:
        assert (out[i].n_tokens, out[i].n_bytes) == (len(library.encode(t or "", add_special_tokens=False).ids), len((t or "").encode()))


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {r.doc_id: r.n_tokens for r in bpe.count_tokens(spark.createDataFrame(ROWS, SCHEMA), path).collect()}
    assert all(out[i] == len(tool.encode(t or "")) for i, t, _ in ROWS)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect() == [] == bpe.count_tokens(df, PATH).collect()


def test_piece_counts_equal_the_library():
    """Without identifiers: words of any script, runs of spaces, byte fall back, special strings."""
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    tool, counter, rng = sentencepiece.SentencePieceProcessor(model_file=path), bpe.PieceCounter(path), random.Random(1)
    texts = ["", " ", "  a  b ", "\n\n x", "\u65e5\u672c\u8a9e \U0001f600", "\u2581a\u2581\u2581b", "a" * 500, "<s> </s> <unk> <0x41>", "\x00 \x07a"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 600), rng.randrange(0x4E00, 0x4E50), 0x2581, 32, 0x1F600])) for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    assert [counter.count_text(t) for t in texts] == [len(tool.encode(t)) for t in texts]


def test_tasks_leave_nothing_behind():
    batch = __import__("pyarrow").RecordBatch.from_pydict({"id": [1], "text": ["some words here"]})
    for _ in bpe._forgetting([batch], PATH, bpe._encoder, bpe._counter):
        bpe.encode_text(PATH, "some words here"), bpe.count_text(PATH, "some words here")
        assert len(bpe._encoder(PATH)[1]) and len(bpe._counter(PATH)[1])
    assert not len(bpe._encoder(PATH)[1]) and not len(bpe._counter(PATH)[1]) and not any(map(len, bpe._encoder(PATH)[1].more))


def test_control_characters_and_signs_beside_words(library):
    """Control characters without others failed to encode; words were kept once for every sign beside them."""
    texts = [f % chr(i) for i in range(0x260) for f in ("%s", "a%sb", "'%s 's")]
    texts += ["\x01\x02 \x7f", "don't DON'T 'll", "12 a1b2 ½ x² İstanbul straße"]
    for text in texts:
        ids = list(library.encode(text, add_special_tokens=False).ids)
        assert (list(bpe.encode_text(PATH, text)), bpe.count_text(PATH, text)) == (ids, len(ids)), repr(text)
    bpe._encoder(PATH)[1].forget()
    bpe.encode_text(PATH, 'zqword zqword, zqword. (zqword) "zqword"')
    assert sum("zqword" in chunk for chunk in bpe._encoder(PATH)[1]) == 1
