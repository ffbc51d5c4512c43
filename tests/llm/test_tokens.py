"""Token files, packing and byte-level BPE against the libraries and brute force."""

import glob
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from turnwise.llm import byte_bpe, packing, token_chunks, token_files
from turnwise.llm.arrow_text import shared_folder
from turnwise.llm.queries import op2_packing, op4_token_files, op6_byte_bpe
from turnwise.llm.token_chunks import MatchEncoder, PieceTable, library_encoder, token_ids

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def odd_texts():
    random.seed(3)
    texts = ["", " ", "  ", "a  b", "a   b", " a", "a ", "a \n b", "a  \nb", "it's  o'k", "<|endoftext|> x", "\t a", "x\x85 y"]
    return texts + ["".join(random.choice(" \n\ta.'s1é日\x1c　😀") for _ in range(random.randint(0, 40))) for _ in range(800)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_ids_of_whole_texts(library):
    texts = odd_texts()
    ids, n = token_ids(pa.array(texts, pa.large_string()), PieceTable(library_encoder(BYTE_BPE)))
    assert np.split(ids, np.cumsum(n)[:-1])[5].tolist() == library(texts[5])
    assert ids.tolist() == [i for t in texts for i in library(t)]


def test_a_match_goes_to_the_library_once_and_with_others():
    """Also if it stands in several pieces; a call's ids are dealt to its matches."""
    from tokenizers import Tokenizer

    tokenizer, calls = Tokenizer.from_file(BYTE_BPE), []
    encoder = MatchEncoder(tokenizer.model)
    encoded = encoder._encoded
    encoder._encoded = lambda matches: calls.append(matches.to_pylist()) or encoded(matches)
    matches = [" some", ".", "\n", "some", " \n\t", "\U0001f600!", "\u65e5\u672c", " some", "."]
    got = [encoder.lists.gather(encoder.rows([m]))[0].tolist() for m in matches]
    assert got == [tokenizer.encode(m).ids for m in matches]
    encoder.clear()
    ids, n = encoder.lists.gather(encoder.rows([*matches, "x" * 900]))
    assert np.split(ids, np.cumsum(n)[:-1])[6].tolist() == got[6] and n.tolist()[:9] == list(map(len, got))
    assert [len(c) for c in calls] == [1] * 7 + [8]


def test_a_full_table_of_matches_keeps_those_asked_for_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_chunks, "MATCHES", 6)
    tokenizer, sent = Tokenizer.from_file(BYTE_BPE), []
    encoder = MatchEncoder(tokenizer.model)
    encoded = encoder._encoded
    encoder._encoded = lambda matches: sent.extend(matches.to_pylist()) or encoded(matches)
    for letter in "abcdefghijkl":
        matches = [" the", f" w{letter}x", " of", f" y{letter}z"]
        rows = encoder.rows(matches)  # may make new lists
        ids, n = encoder.lists.gather(rows)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tokenizer.encode(m).ids for m in matches]
        assert encoder.lists.size <= 6 + len(matches)
    assert sent.count(" the") == sent.count(" of") == 1


def test_cut_places_against_brute_force():
    random = np.random.default_rng(5)
    closes = np.array([False, False, False, True])
    for n in (1, 2, 40, 400):
        ids = random.integers(0, 4 if n < 400 else 3, n).astype(np.uint32)
        ends = np.unique([*random.integers(1, n + 1, 3), n])
        options = packing.PackOptions(stride=7)
        prices = {k + 1: options.sentence_penalty for k in range(n) if closes[ids[k]]} | {0: 0.0} | dict.fromkeys(ends.tolist(), 0.0)
        marks = sorted(prices)
        for a, b in zip(marks, marks[1:], strict=False):
            prices |= dict.fromkeys(range(a + 7, b, 7), options.inside_penalty)
        places, found = packing.cut_places(ids, ends, closes, options)
        assert dict(zip(places.tolist(), found.tolist(), strict=True)) == prices and places.tolist() == sorted(prices)


def test_segment_trees_give_the_library_s_ids(tiktoken_ids):
    texts = [*odd_texts(), "a" * 3000, "ab" * 1500, " " * 700, "xyzzy" * 999]
    ids, n = token_ids(pa.array(texts, pa.large_string()), PieceTable(byte_bpe.rank_encoder(RANKS, public_tokenizers.PATTERN)))
    assert ids.tolist() == [i for t in texts for i in tiktoken_ids(t)]
    assert n.tolist() == [len(tiktoken_ids(t)) for t in texts]


def test_op6_against_tiktoken(spark, folder, documents, tiktoken_ids):
    got = {r.doc_id: r for r in op6_byte_bpe(spark, folder).collect()}
    for r in documents.collect():
        ids = tiktoken_ids(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_byte_bpe_round_trip_of_odd_rows(odd, empty):
    encoded = byte_bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_documents(encoded, RANKS)
    assert sorted(bytes(r.decoded).decode() for r in decoded.collect()) == sorted(r.text or "" for r in odd.collect())
    assert byte_bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_an_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="no token"):
        byte_bpe.decode_documents(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), RANKS).collect()


def test_op4_against_the_library(spark, folder, documents, library):
    got = op4_token_files(spark, folder).orderBy("doc_id").collect()
    start = 0
    for r, want in zip(got, documents.orderBy("doc_id").collect(), strict=True):
        ids = [*library(want.text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_format_and_selective_reads(spark, odd, empty, tmp_path):
    files = str(tmp_path / "files")
    token_files.write_token_files(odd, files, BYTE_BPE, end_id=2)
    column = [
        pq.ParquetFile(f).metadata.row_group(0).column(k)
        for f in glob.glob(f"{files}/part-*") for k in range(3) if pq.ParquetFile(f).metadata.num_rows
    ]
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in column if c.path_in_schema in ("doc_id", "n_tokens"))
    assert all(c.has_offset_index for c in column)
    some = token_files.read_tokens(spark, files, 5, 6)
    assert sorted(r.doc_id for r in some.collect()) == [5, 5, 6]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,5)" in some._jdf.queryExecution().toString()
    plan = token_files.read_starts(spark, files)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint,part:int>" in plan
    starts = token_files.read_starts(spark, files).orderBy("start").collect()
    assert len(starts) == odd.count() and [r.start for r in starts] == np.cumsum([0] + [r.n_tokens for r in starts])[:-1].tolist()
    none = str(tmp_path / "none")
    token_files.write_token_files(empty, none, BYTE_BPE)
    assert token_files.read_starts(spark, none).count() == 0


def test_op4_of_odd_rows(spark, odd, library, tmp_path):
    """Null and repeated doc_ids: one row each, in the order of the files."""
    odd.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_token_files(spark, str(tmp_path)).orderBy("start").collect()
    rows = sorted(((r.doc_id or 0, r.text or "") for r in odd.collect()))
    ids = [[*library(text), 2] for _, text in rows]
    assert [(r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got] == [(k, len(i), crc(i)) for (k, _), i in zip(rows, ids, strict=True)]
    assert [r.start for r in got] == np.cumsum([0] + [len(i) for i in ids])[:-1].tolist()


def least_cost(positions, prices, window):
    """By trying every earlier cut."""
    half = window // 2
    cost = [0.0]
    for k in range(1, len(positions)):
        best = np.inf
        for j in range(k):
            size = positions[k] - positions[j]
            if size <= window:
                best = min(best, cost[j] + (0 if size in (half, window) else window - size))
        cost.append(best + prices[k])
    return cost[-1]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_have_the_least_cost(seed):
    r = np.random.default_rng(seed)
    positions = np.concatenate([[0], np.cumsum(r.integers(1, 12, 60))])
    prices = r.choice([0.0, 1.0, 4.0], len(positions))
    cuts = packing.best_cuts(positions, prices, 32)
    sizes = np.diff(positions[cuts])
    cost = sum(0 if s in (16, 32) else 32 - s for s in sizes) + prices[cuts[1:]].sum()
    assert sizes.max() <= 32 and cuts[0] == 0 and cuts[-1] == len(positions) - 1
    assert cost == pytest.approx(least_cost(positions.tolist(), prices.tolist(), 32))


def check_pieces(rows, texts, library, window=1024):
    """Every id in one piece, sequences gapless and within the window, checksums right; gives the padding's share."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts:
        ids, at = [*library(text), 0], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / total


def test_op2_against_the_library(spark, folder, documents, library):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    assert check_pieces(op2_packing(spark, folder).collect(), texts, library) < 0.03


def test_packing_of_odd_rows_and_short_lines(odd, empty, library):
    unique = odd.filter("doc_id IS NOT NULL AND doc_id NOT IN (5, 9)")
    rows = packing.pack_documents(unique, BYTE_BPE, packing.PackOptions(window=64, line_tokens=300)).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in unique.collect()], library, 64)
    every = packing.pack_documents(odd, BYTE_BPE).agg(F.sum("length")).first()[0]
    assert every == sum(len(library(r.text)) + 1 for r in odd.collect())
    assert packing.pack_documents(empty, BYTE_BPE).count() == 0


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
