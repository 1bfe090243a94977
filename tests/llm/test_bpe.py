import base64
import random
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken

from quire.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def peer():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_another_library(peer):
    r, code = random.Random(3), bpe.coder(PATH, PATTERN)
    parts = ["a", "b", " ", "\n", "é", "\x1c", "\x85", "日本", "😀", "1", "!!", "'s", "​", "　", "\x00", "the", "ing", "́", "<|endoftext|>"]
    for _ in range(500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        ids = code.encode(text).tolist()
        assert ids == peer.encode_ordinary(text)
        assert code.decode(ids) == text.encode()


def test_frames(docs, empty_docs, odd_texts, peer):
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, "doc_id", "text", PATH, PATTERN), "ids", PATH, PATTERN).collect()}
    for i, t in enumerate(odd_texts):
        assert rows[i].ids == peer.encode_ordinary(t or "") and bytes(rows[i].decoded) == (t or "").encode()
    for r in bpe.round_trip(docs, "doc_id", "text", PATH, PATTERN).collect():
        ids, raw = rows[r.doc_id].ids, rows[r.doc_id].decoded
        want = len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(raw).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want
    assert bpe.round_trip(empty_docs, "doc_id", "text", PATH, PATTERN).count() == 0
    assert bpe.encode(docs, "doc_id", "text", PATH, PATTERN).count() == docs.count()
    assert bpe.decode(bpe.encode(empty_docs, "doc_id", "text", PATH, PATTERN), "ids", PATH, PATTERN).count() == 0


def test_whole_pre_tokens_and_forgetting(tmp_path, monkeypatch):
    """A piece that no merges lead to still stands for its pre-token; results don't depend on what is remembered."""
    pieces = [bytes([b]) for b in range(256)] + [b"abc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    code = bpe.ByteBpe(str(path), r"\w+|\W")
    assert code.encode("abc abcd x y z abc").tolist()[0] == 256
    assert code.encode("abcd").tolist() == [97, 98, 99, 100]
    with pytest.raises(IndexError):
        code.decode([999])
