"""Every registered query over the smallest folder: against its SQL, or against a brute-force version."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_chat import brute as brute_chat
from test_duplicates import brute_groups
from test_text_rules import LOW, WORD, brute_rules, brute_verdict

import corpus_pipeline
from strataflow.llm import packing, queries
from strataflow.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, documents):
    coder, at, want = Encoder.at(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc, text in sorted(documents):
        ids = [*coder.whole(text or ""), 1]
        want.append((doc, at, len(ids), crc(ids), ids[0], ids[-1]))
        at += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op1_token_codes"](spark, DATA).collect())) == want


def test_op2(spark, documents):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in queries.QUERIES["op2_quality_rules"](spark, DATA).collect()}
    assert got == {doc: (*brute_rules(text), brute_verdict(text)[0]) for doc, text in documents}


def valid_packing(rows, texts):
    coder = Encoder.at(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc, text in texts:
        ids = [*coder.whole(text or ""), 0]
        want += [(doc, i, s, n, crc(ids[s : s + n])) for i, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1


def test_op3(spark, documents):
    valid_packing(queries.QUERIES["op3_best_fit_packing"](spark, DATA).collect(), documents)


def test_op6(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op6_quotation_chat"](spark, DATA).collect()
    assert sorted(str((r.conv_id, r.turn, r.parent_turn, r.root_turn, r.depth, r.reply_order, r.n_quotes, r.n_linked)) for r in got) == brute_chat(rows)


def without_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_op7(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op7_suffix_array_dedup"](spark, DATA).collect()}
    assert got == {doc: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for (doc, _), (n, gone, spans, kept) in zip(documents, without_repeats([t for _, t in documents]))}


def test_op5_and_op8_cover_their_tables(spark, documents):
    pages = queries.QUERIES["op5_html_extraction"](spark, DATA)
    assert pages.count() == spark.read.parquet(f"{DATA}/pages.parquet").count() and pages.where("n_chars = 0").count() == 0
    scores = queries.QUERIES["op8_byte_conv_quality"](spark, DATA).collect()
    assert sorted(r.doc_id for r in scores) == sorted(d for d, _ in documents)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scores)


def leaks(text, items):
    """Whether a window of the text is like an item, by weighted 5-word n-grams."""
    d = WORD.findall((text or "").translate(LOW))
    for t in items:
        k = min(5, len(t))
        if not t or len(d) < k:
            continue
        grams = lambda x: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]  # noqa: E731, B023
        mine, theirs = grams(d), Counter(grams(t))
        m = min(len(mine), len(t) - k + 1)
        hit = [g in theirs for g in mine]
        if sum(hit) * 100 < 40 * m:
            continue
        best = max(sum((Counter(mine[s : s + m]) & theirs).values()) for s in range(len(mine) - m + 1))
        if 100 * best >= 80 * (m + len(t) - k + 1 - best):
            return True
    return False


def test_pipeline_against_brute_force(spark, documents):
    kept = [(d, t) for d, t in documents if brute_verdict(t)[0]]
    group, links, _ = brute_groups([t for _, t in kept])
    least = {}
    for (doc, _), g in zip(kept, group):
        least[g] = min(least.get(g, doc), doc)
    kept = [(d, t) for (d, t), g, n in zip(kept, group, links) if not n or least[g] == d]
    kept = [(d, rest.decode("utf-8", "replace")) for (d, _), (*_, rest) in zip(kept, without_repeats([t for _, t in kept]))]
    items = [WORD.findall((r.text or "").translate(LOW)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t in kept if not leaks(t, items)]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == {d for d, _ in kept} and len(kept) < len(documents)
    valid_packing(got, kept)
