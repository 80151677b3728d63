import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from strataflow.llm import dac, packing
from strataflow.llm.tokens import Encoder

ODD = ["", "a", " a", "a ", "  a", " \n a", "a\n\nb", "a  b", "\n", "   ", "İstanbul ΣΑΣ Σ", "don't I'LL it's'", "<|endoftext|> a<|endoftext|>b", "漢字 と", "a1b22 ½x ²", "\r\n a", "\x1c a", "😀 a😀", "　a b", "x y"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab'1 \n\t. éÉ s") for _ in range(rng.randint(1, 12))) for _ in range(500)]
    coder = Encoder.at(public_tokenizers.path(name))
    ids, at = coder.encode(pa.array([*texts, None]))
    for i, text in enumerate([*texts, ""]):
        assert ids[at[i] : at[i + 1]].tolist() == coder.whole(text), text


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        for most in (2, 256, 49_408, 1 << 20):
            ids = rng.integers(0, most, n).astype(np.uint32)
            segment = dac.Segment(dac.encode(ids))
            assert (segment.decode() == ids).all() and len(segment) == n
            assert all(segment.access(i) == ids[i] for i in range(0, n, 97))
            places = rng.integers(0, n, 50) if n else np.zeros(0, np.int64)
            assert (segment.take(places) == ids[places]).all()
    with pytest.raises(ValueError):
        dac.Segment(b"xxxx")


def test_token_file(spark, docs, rows):
    path = dac.token_file(spark, "t")
    dac.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1, segment_tokens=500)
    got = sorted(dac.read_documents(spark, path).collect(), key=lambda r: r.start)
    coder = Encoder.at(public_tokenizers.path("word_bpe_49k.json"))
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    key = lambda i, ids: (str(i), np.array(ids, "<u4").tobytes())
    assert sorted(key(r.doc_id, np.frombuffer(r.ids, "<u4")) for r in got) == sorted(key(r[0], coder.whole(r[1] or "") + [1]) for r in rows)


def test_one_token_costs_a_chunk_a_level(spark, docs, rows):
    path = dac.token_file(spark, "ranged")
    dac.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1, segment_tokens=700)
    coder = Encoder.at(public_tokenizers.path("word_bpe_49k.json"))
    seen = {}
    for r in rows:
        seen.setdefault(r[0], set()).add(tuple(coder.whole(r[1] or "") + [1]))
    for doc in sorted((d for d in seen if d is not None and len(seen[d]) == 1), key=str)[::9]:
        ids = next(iter(seen[doc]))
        file, at, head, n = dac.open_document(spark, path, doc)
        assert n == len(ids)
        for i in {0, n - 1, n // 2}:
            with dac.RangedFile(spark, file) as source:
                assert dac.access(lambda place, size: source.read(at + place, size), head + i) == ids[i]
                assert source.bytes_read <= 8 + 2 * (8 + 1 + 4 + dac.BLOCK // 8)
    assert dac.read_token(spark, path, 5, 0) == coder.whole(dict((r[0], r[1]) for r in rows)[5])[0]
    with pytest.raises(IndexError):
        dac.read_token(spark, path, 5, 10_000)
    with pytest.raises(KeyError):
        dac.read_token(spark, path, 123_456, 0)
    for r in dac.read_documents(spark, path).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.first_id, r.last_id) == (ids[0], ids[-1])


def test_token_file_of_nothing(spark, empty):
    path = dac.token_file(spark, "none")
    dac.write_tokens(empty, path, public_tokenizers.path("word_bpe_49k.json"))
    assert dac.read_documents(spark, path).count() == 0


def test_packing_is_valid_and_bounded(spark, docs, rows, empty):
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 256)
    got = packing.pack(pieces, 256, part_rows=60).collect()
    coder = Encoder.at(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for ids in (coder.whole(r[1] or "") + [0] for r in rows) for s, n in packing.cut(len(ids), 256))
    assert sorted(zlib.crc32(bytes(r.ids)) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    least = packing.lower_bound(np.array([r.length for r in got]), 256)
    assert least <= len(bins) <= least * 1.05 + 2
    assert packing.pack(packing.token_pieces(empty, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_bounds_and_cuts():
    assert packing.lower_bound(np.array([1100] * 10), 2048) == 10
    assert packing.lower_bound(np.array([700] * 9), 2048) == 5
    assert packing.lower_bound(np.array([683] * 9), 2048) >= 5  # over a third each: two in a bin
    assert packing.lower_bound(np.zeros(0, np.int64), 2048) == 0
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(4097, 2048) == [(0, 1), (1, 2048), (2049, 2048)]
    rng = np.random.default_rng(0)
    for _ in range(20):
        length = rng.integers(1, 2049, 200)
        bins, offset, free = packing.best_fit_decreasing(length, 2048)
        assert len(free) >= packing.lower_bound(length, 2048) and np.bincount(bins, length).max() <= 2048


def test_packing_carries_columns_of_any_name(spark):
    rows = [(i, 0, 0, 10 + i % 90, f"s{i}", f"p{i}", "x", "y", "z") for i in range(300)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, part string, _part string, sequence_id string, Offset string, certified string")
    got = packing.pack(pieces, 128, part_rows=40)
    assert got.columns == ["doc_id", "piece", "start", "length", "part", "_part", "sequence_id", "offset", "certified"]
    assert sorted((r.doc_id, r.part, r["_part"]) for r in got.collect()) == [(i, f"s{i}", f"p{i}") for i in range(300)]


def test_exchange_rounds_close_gaps(spark):
    """Two to four pieces a bin: parts of 25 pieces miss their bounds, and repacking with others helps."""
    rng = np.random.default_rng(2)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(26, 62, 400))]
    pieces = spark.createDataFrame(rows, "doc_id long, length long").coalesce(1)
    spread = {}
    for rounds in (1, 6):
        got = packing.pack(pieces, 128, part_rows=25, rounds=rounds).collect()
        spread[rounds] = len({r.sequence_id for r in got})
        fill = {}
        for r in got:
            fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert len(got) == 400 and max(fill.values()) <= 128
    assert packing.lower_bound(np.array([n for _, n in rows]), 128) <= spread[6] < spread[1]
