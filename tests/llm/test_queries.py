"""The queries opN_ against plain versions of what they return, on the smallest tables."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from quire.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def texts():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: [r.asDict() for r in queries.queries()[name](spark, SF).collect()]


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{i}" for i in range(1, 14)} == {n.partition("_")[0] for n in queries.queries()} and set(queries.queries()) | {"pipeline"} <= names


def test_op1(run):
    talks = defaultdict(list)
    for r in table("conversations"):
        talks[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    talks[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r["conv_id"]: r for r in run("op1_chat")}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want
        assert r["formatted_chars"] >= sum(len(role) + len(t) for _, role, t in turns)


def test_op2(run):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in texts().items():
        ids = peer.encode_ordinary(t)
        want[d] = (len(ids), sha(",".join(map(str, ids))), sha(t))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run("op2_bpe")} == want


def test_op4(run):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table("pages")}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    want = {}
    for p, html in pages.items():
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        want[p] = (len(html), digest, "response" if first[html] == p else "revisit", None if first[html] == p else first[html])
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in run("op4_warc")} == want


def test_op6(run):
    from tokenizers import Tokenizer

    peer, want, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, 0
    for d, t in sorted(texts().items()):
        ids = np.array([*peer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run("op6_token_files")} == want


def test_op7(run):
    raw = {d: t.encode() for d, t in texts().items()}
    seen = Counter(hash(t[i : i + 400]) for t in raw.values() for i in range(len(t) - 399))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run("op7_suffix_dedup")}
    assert got.keys() == raw.keys()
    for d, t in raw.items():
        gone, until = np.zeros(len(t) + 1, bool), 0
        for i in range(len(t)):
            if i + 400 <= len(t) and seen[hash(t[i : i + 400])] > 1:
                until = i + 400
            gone[i] = i < until
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        assert got[d] == (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept))


def test_op8(run):
    rows = run("op8_toxicity")
    assert {r["doc_id"] for r in rows} == texts().keys()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op10(run):
    phrases = {b"gnu general public license": "gpl", b"apache license": "apache", b"cc by": "cc-by", b"mit license": "mit"}
    want = {}
    for d, t in texts().items():
        ws, places, labels = words(t), [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want[d] = (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    got = run("op10_licenses")
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op13(run):
    import sentencepiece

    peer = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: (len(t.encode()), len(peer.encode(t)), len(peer.encode(t)) > 4096) for d, t in texts().items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run("op13_token_counts")} == want


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(run, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(shown, r)) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in run(name)) == want
