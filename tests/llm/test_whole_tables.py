"""Registered queries with their production parameters over whole tables, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codexframe.llm import queries
from tests.llm.test_dedup import brute_removed, groups, word_set


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_repeats(spark, sf_dir, documents):
    ids = sorted(documents)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op6_suffix_array_dedup"](spark, sf_dir).collect()}
    assert [got[i] for i in ids] == brute_removed([(documents[i] or "").encode() for i in ids], 200)


def test_byte_bpe(spark, sf_dir, documents):
    import public_tokenizers
    import tiktoken

    from codexframe.llm.bpe import load_ranks

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(queries.tokenizer_path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in queries.QUERIES["op8_byte_bpe"](spark, sf_dir).collect():
        ids = own.encode_ordinary(documents[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((documents[r.doc_id] or "").encode()).hexdigest())


def test_near_duplicates(spark, sf_dir, documents):
    sets = {i: word_set(t, 3) for i, t in documents.items()}
    ids = sorted(documents)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (u := len(sets[a] | sets[b])) and 100 * len(sets[a] & sets[b]) >= 85 * u]
    want = groups(links, ids)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.QUERIES["op9_minhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_base_scores(spark, sf_dir, documents):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in documents.items()}
    count = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in own)
    total = sum(count.values())
    for r in queries.QUERIES["op10_lm_scoring"](spark, sf_dir).collect():
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(own), sum(w in count for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in own), rel=1e-9)


def test_base_secrets(spark, sf_dir, documents):
    kinds = (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12), ("access", r"(AKIA[A-Z0-9]+)", 18), ("hex", r"([0-9a-f]+)", 16))
    for r in queries.QUERIES["op4_secret_scans"](spark, sf_dir).collect():
        found = [(m.start(), k, m.end()) for k, (_, pattern, least) in enumerate(kinds) for m in re.finditer(pattern, documents[r.doc_id] or "", re.ASCII) if len(m[m.re.groups]) >= least]
        shown = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found))
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(shown.encode()).hexdigest())


def test_nearest_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, v = np.array([i for i, _ in rows]), np.floor(np.array([e for _, e in rows], np.float64) * 256)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.QUERIES["op1_exact_top_k"](spark, sf_dir).collect()}
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = v @ v[q]
        best = [k for k in np.lexsort((ids, -score))[:6] if k != q][:5]
        want |= {(ids[q], n + 1): (ids[k], int(score[k])) for n, k in enumerate(best)}
    assert got == want
