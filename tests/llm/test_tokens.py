import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest

from orderlens.llm import common, jaccard, langid, tokens
from orderlens.llm.packing import best_two_fit, pack, token_pieces
from orderlens.llm.token_files import pack_bits, read_documents, read_ids, unpack_bits, write_token_files
from orderlens.llm.tokens import Encoder, encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,spaces", [(BYTE, "kept"), (WORD, "dropped")])
def test_chunks_give_the_librarys_ids(path, spaces, rows):
    whole, mine = library(path), Encoder(path, spaces)
    r = random.Random(2)
    bits = [" ", "\n", "  ", "\t", ".", ",", "...", ", ", ". ", "it's", "'s", "don't.", "a", "Été", "1,000.5", "x́", " ", "\u0085", " ", "漢字", "\U0001F600",
            "<|endoftext|>", "<|startoftext|>", "ǅ", "İ", "Σας", "\0", "×", "÷", "­", "$$$", "###,", "&.", "\r\n", "\x1c", "Ω,"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [x[1] for x in rows] + bits
    texts += [" ".join(r.choice(bits[4:]) for _ in range(20)) for _ in range(1000)]
    for text in texts:
        assert array("I", mine.ids(text)).tolist() == whole(text), repr(text)


def want_pieces(odd_rows, limit):
    whole, out = library(WORD), []
    for i, text in odd_rows:
        ids = [*whole(text), 0]
        out += [(i, k // limit, k, len(ids[k:k + limit]), zlib.crc32(array("I", ids[k:k + limit]).tobytes())) for k in range(0, len(ids), limit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit,group", [(2048, 50_000), (256, 40)])
def test_packing(odd, docs, limit, group):
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = pack(token_pieces(df, WORD, "dropped", limit), limit, group).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want_pieces([tuple(r) for r in df.collect()], limit)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= limit
    if group == 50_000:
        assert len(bins) <= -(-sum(r.length for r in got) // limit) * 1.02 + 1


def test_packing_carries_ids_and_empty_tables(docs, none):
    r = pack(token_pieces(docs, WORD, "dropped", with_ids=True)).first()
    assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert pack(token_pieces(none, WORD, "dropped")).count() == 0


def test_best_two_fit_replaces_the_shortest():
    """60 + 30 leaves 10; 30 gives way to 21 + 19, which fill the gap."""
    bins, offsets = best_two_fit(np.array([60, 30, 21, 19]), 100)
    assert bins[0] == bins[2] == bins[3] and bins[1] != bins[0]
    assert sorted(offsets[[0, 2, 3]].tolist()) == [0, 60, 79]  # the shorter of the two lies first


@pytest.mark.parametrize("seed", range(5))
def test_best_two_fit_places_all(seed):
    r = np.random.default_rng(seed)
    lengths = r.choice([r.integers(1, 100, 500), r.integers(1, 20, 500), np.full(500, 34)][seed % 3], 500)
    bins, offsets = best_two_fit(lengths, 100)
    for b in range(bins.max() + 1):
        at = np.argsort(offsets[bins == b])
        assert (np.cumsum(lengths[bins == b][at]) - lengths[bins == b][at] == offsets[bins == b][at]).all() and lengths[bins == b].sum() <= 100


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003).astype("<u4")
    packed = pack_bits(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    for a, b in ((0, 1003), (0, 0), (5, 6), (13, 997), (1002, 1003)):
        assert (unpack_bits(packed, width, a, b) == ids[a:b]).all()


@pytest.mark.parametrize("path,spaces", [(BYTE, "kept"), (WORD, "dropped")])
def test_token_files(spark, odd, docs, tmp_path, path, spaces):
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    write_token_files(df, f"{tmp_path}/t", path, spaces, block_ids=500)
    whole, want, stream = library(path), [], []
    for i, text in sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0])):
        ids = [*whole(text), 0]
        want.append((i, len(stream), len(ids), zlib.crc32(array("I", ids).tobytes())))
        stream += ids
    got = sorted((tuple(r) for r in read_documents(spark, f"{tmp_path}/t").collect()), key=lambda r: r[1])
    assert got == want
    part = sorted(tuple(r) for r in read_ids(spark, f"{tmp_path}/t", 700, 2300).collect())
    assert part == list(zip(range(700, 2300), stream[700:2300]))


def test_no_documents(spark, none, tmp_path):
    write_token_files(none, f"{tmp_path}/t", BYTE, "kept")
    assert read_documents(spark, f"{tmp_path}/t").count() == 0


def test_a_worker_keeps_one_steps_memory(spark, docs, monkeypatch):
    """Encoders stay for the tasks of their step and go with the first task of another."""
    one = encoder(WORD, "dropped")
    assert encoder(WORD, "dropped") is one
    encoder(BYTE, "kept")
    assert list(common._KEPT) == [(BYTE, "kept")]
    steps, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: (steps.append(f), real(self, f, *a, **k))[1])
    langid.identify(docs)
    order = spark.sparkContext.broadcast(jaccard._order(docs, 3))
    jaccard._signatures(docs, 3), jaccard._prefixes(docs, 3, 90, order), jaccard._segments(docs, 3, order)
    assert len(steps) == 6
    for step in steps:
        encoder(WORD, "dropped")
        list(step(iter([])))
        assert not common._KEPT


def test_plain_texts_are_not_searched(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("aZ9é .,\n!\0\t\x85\xa0\xad¡ÿ×÷ıŁα\x7f") for _ in range(r.randint(0, 6))) for _ in range(20_000)]
    assert [tokens.odd(t) for t in texts] == [tokens.ODD.search(t) is not None for t in texts]
    mine, text = Encoder(BYTE, "kept"), "Plain text, été, of words.\nAnd another line."
    monkeypatch.setattr(tokens, "ODD", None)
    assert np.frombuffer(mine.ids(text), "<u4").tolist() == library(BYTE)(text)
