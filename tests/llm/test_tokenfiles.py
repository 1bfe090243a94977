import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quire.llm import tokenfiles
from quire.llm.shared import make_dir, scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark, docs, odd_texts):
    peer = Tokenizer.from_file(PATH)
    out = make_dir(spark, scratch(spark, "t"))
    tokenfiles.write(docs, "doc_id", "text", PATH, out, length=64)
    back = tokenfiles.with_starts(tokenfiles.read(spark, out, docs.schema["doc_id"].dataType), "doc_id").orderBy("start").collect()
    expected, start = [], 0
    for i, t in sorted([*enumerate(odd_texts), (3, "a")], key=lambda x: x[0]):
        ids = np.array([*peer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in back] == expected
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*[0-9].arrow").load(out).collect()
    for ids, mask in tokenfiles.sequences(pa.BufferReader(bytes(files[0].content))):
        assert ids.shape[1] == 64 and ids.dtype == np.uint16 and not ids.flags.owndata and len(mask) == ids.size


def test_empty(spark, empty_docs):
    out = make_dir(spark, scratch(spark, "t"))
    tokenfiles.write(empty_docs, "doc_id", "text", PATH, out)
    assert tokenfiles.with_starts(tokenfiles.read(spark, out, empty_docs.schema["doc_id"].dataType), "doc_id").count() == 0


def test_forgetting(monkeypatch):
    texts = ["one two three", "two three four", "", "one one"]
    want = [x.tolist() for x in tokenfiles.Coder(PATH).encode(texts, 1)]
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 2)
    code = tokenfiles.Coder(PATH)
    assert [next(code.encode([t], 1)).tolist() for t in texts] == want


def test_chunks_encode_as_the_whole_text():
    peer = Tokenizer.from_file(PATH)
    for text in ("It's  Á test\x1cof blanks", "<|endoftext|> x<|endoftext|>", "İ Σ ς ΑΣ ΑΣ. ", " a\tb\r\nc"):
        assert next(tokenfiles.Coder(PATH).encode([text], 1)).tolist() == [*peer.encode(text, add_special_tokens=False).ids, 1]


def test_random_strings_encode_as_by_the_library():
    peer, code, r = Tokenizer.from_file(PATH), tokenfiles.Coder(PATH), random.Random(3)
    latin = [chr(c) for c in range(0x180) if not 0xD800 <= c < 0xE000]
    wide = [*latin, *"\u0130\u0131\u017f\u0301\u0327\u0345\u1e9e\u212a\u212b\u2028\u3000\u03a3\u03c2\uac00\u1100\u1161\U0001f600\u00ad\u200d\u0660\u00bd"]
    plain = [*"abcXYZ019 .,;:!?_'-()\n\t", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", ". ", ", ", " .", "\x1c", "\x85", "\xa0"]
    texts = ["foo_.", "a _, b", "x\x1f. y", "a\u0327. b"]
    for alphabet in (latin, wide, plain):
        texts += ["".join(r.choices(alphabet, k=r.randint(0, 24))) for _ in range(3000)]
    want = [[*x.ids, 1] for x in peer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in code.encode(texts, 1)] == want


def test_documents_span_batches():
    batches = [np.arange(4), np.arange(4, 8), np.arange(8, 12)]
    whole = np.arange(12).astype("<u4")
    assert tokenfiles._checksums(batches, [1, 6, 0, 5]) == [zlib.crc32(whole[a:b].tobytes()) for a, b in ((0, 1), (1, 7), (7, 7), (7, 12))]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    code, peer = tokenfiles.Coder(path), Tokenizer.from_file(path)
    texts = ["Two  words. x", "", "Éa’s 12\n"]
    assert not code.apart and tokenfiles.Coder(public_tokenizers.path("word_bpe_49k.json")).apart
    assert [x.tolist() for x in code.encode(texts, 1)] == [[*peer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
