"""Operators 1 and 8 against the tokenizers library and plain packing rules."""
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillage.llm import huffman, packing
from tillage.llm.tokens import WordTokenizer
from tillage.session import scratch_path


@pytest.fixture(scope="module")
def plain():
    """Ids by the library alone, text by text."""
    tok = WordTokenizer().tok
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.text(alphabet=st.sampled_from("abZÀßé .,!'\"s1²½_$\t\n\x0b\x1c\xa0\xad<|>的"), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_memoised_ids_are_the_librarys(plain_tokenizer, texts):
    got = [np.frombuffer(x, plain_tokenizer.dtype).tolist() for x in plain_tokenizer.ids(texts)]
    assert got == [plain_tokenizer.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_units_and_special_strings(plain_tokenizer):
    texts = ["Don't--'s'll (FOO's) foo-BAR_baz.", "<|ENDOFTEXT|> x", "a<|endoftext|>b", "<|EndOfText|>'s", "", " \n ",
             "1234 12.5e-9 AKIA12XY", "ªb µm ÿÀ×÷ '!'s ½²", "的 mixed 的"]
    got = [np.frombuffer(x, plain_tokenizer.dtype).tolist() for x in plain_tokenizer.ids([*texts, None])]
    assert got == [plain_tokenizer.tok.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
    assert plain_tokenizer.ids([]) == [] and plain_tokenizer.ids([None]) == [b""]


@pytest.fixture(scope="module")
def plain_tokenizer():
    return WordTokenizer(memo_entries=60)  # small enough to be emptied on the way


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=300), st.integers(9, 14))
@settings(max_examples=60, deadline=None)
def test_huffman_codes_are_complete_and_limited(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = lengths[lengths > 0].astype(int)
    assert (lengths > 0).sum() == (np.array(counts) > 0).sum() and (len(used) == 0 or used.max() <= limit)
    if len(used) > 1:
        assert (2.0 ** -used).sum() == 1
    ids = np.repeat(np.arange(len(counts)), np.minimum(counts, 7))
    if len(ids):
        payload, at = huffman.encode_chunk(ids, lengths, huffman.canonical_codes(lengths), 16)
        table = huffman.decode_table(lengths, limit)
        assert (huffman.decode_chunk(payload, at, len(ids), 16, table, limit) == ids).all()
        # a block alone, from its checkpoint
        assert (huffman.decode_chunk(payload, at[-1:], len(ids[16 * (len(at) - 1):]), 16, table, limit) == ids[16 * (len(at) - 1):]).all()


def test_unlimited_huffman_is_optimal():
    counts = [1, 1, 2, 3, 5, 8, 13, 21]
    heap, cost = sorted(counts), 0
    while len(heap) > 1:  # the sum of all merged weights is the cost of an optimal code
        merged = heap[0] + heap[1]
        cost += merged
        heap = sorted([*heap[2:], merged])
    assert (huffman.code_lengths(np.array(counts), 20) * counts).sum() == cost


def test_id_files_round_trip(spark, odd_docs, plain):
    path = scratch_path(spark, "test-ids")
    huffman.write_ids(odd_docs, path)
    rows = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for r in rows:
        ids = [*plain(r["text"]), 2]
        want.append((r["doc_id"], start, len(ids), ids))
        start += len(ids)
    got = sorted(huffman.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in got] == want
    digests = sorted(huffman.read_ids(spark, path, digest=True).collect(), key=lambda r: r["start"])
    assert [r["ids_crc32"] for r in digests] == [crc(w[3]) for w in want]


def test_id_files_of_nothing(spark, no_docs):
    path = scratch_path(spark, "test-no-ids")
    huffman.write_ids(no_docs, path)
    assert huffman.read_ids(spark, path, digest=True).count() == 0


def check_packing(rows, docs, plain, capacity=2048):
    want = defaultdict(int)
    for r in docs:
        ids = [*plain(r["text"]), 0]
        for k in range(0, len(ids), capacity):
            want[r["doc_id"], k // capacity, k, len(ids[k:k + capacity]), crc(ids[k:k + capacity])] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_keeps_every_token(odd_docs, plain):
    check_packing(packing.pack_documents(odd_docs).collect(), odd_docs.collect(), plain)


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_reaches_the_bound(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    n = check_packing(rows, docs.collect(), plain)
    assert n <= packing.lower_bound(np.array([r["length"] for r in rows]), 2048) + 1


def test_exchange_between_partitions_saves_sequences(spark):
    items = spark.range(400).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "300 + (id * 37) % 500 AS length", "id AS ids_crc32")
    from tillage.llm.shared import stored
    items = stored(items, "test-items")
    few = packing.pack(items, part_items=40, rounds=3).select("sequence_id").distinct().count()
    none = packing.pack(items, part_items=40, rounds=0).select("sequence_id").distinct().count()
    assert few <= none


@given(st.lists(st.integers(1, 60), min_size=1, max_size=9))
@settings(max_examples=80, deadline=None)
def test_lower_bound_is_one(lengths):
    def fewest(rest, bins):
        if not rest:
            return len(bins)
        best = len(bins) + len(rest)
        for k in range(len(bins)):
            if bins[k] + rest[0] <= 60:
                best = min(best, fewest(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1:]]))
        return min(best, fewest(rest[1:], [*bins, rest[0]]))
    x = np.array(lengths)
    sequence, offset, fills = packing.best_fit_decreasing(x, 60)
    assert packing.lower_bound(x, 60) <= (fewest(sorted(lengths, reverse=True), []) if len(lengths) < 8 else len(fills)) <= len(fills)
    assert fills.max() <= 60 and fills.sum() == x.sum()
