import zlib

import pytest

from orderlens.llm.hilbert import BITS, curve, hilbert_shards


@pytest.mark.parametrize("bits,dims", [(4, 3), (3, 2), (2, 4), (1, 3)])
def test_curve_visits_neighbours(bits, dims):
    table = curve(bits, dims)
    assert sorted(table) == list(range(len(table)))
    at = {h: [(cell >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)] for cell, h in enumerate(table)}
    assert all(sum(abs(x - y) for x, y in zip(at[h], at[h + 1])) == 1 for h in range(len(table) - 1))


def size_step(size):
    k = size.bit_length() - 1
    return min(max(2 * k + (size >= (1 << k) + ((1 << k) >> 1)) - 12, 0), 15)


def plain(rows, shards):
    def steps(values):
        order = sorted({v for v in values if v is not None}, key=lambda s: s.encode())
        return {v: k * 16 // len(order) for k, v in enumerate(order)} | {None: 0}

    langs, sources, table = steps([r[2] for r in rows]), steps([r[3] for r in rows]), curve(BITS, 3)
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    made = []
    for i, text, lang, source, *_ in rows:
        raw = (text or "").encode()
        h = table[(langs[lang] << 8) + (sources[source] << 4) + size_step(len(raw) + 1)]
        made.append((h, first(lang), first(source), len(raw) + 1, zlib.crc32(raw), first(i)))
    made.sort()
    base, more = divmod(len(made), shards)
    out, at = [], 0
    for s in range(shards):
        for slot in range(base + (s < more)):
            h, _, _, size, crc, (_, i) = made[at]
            out.append((i, size, crc, h, s, slot))
            at += 1
    return out


def test_against_plain_version(docs, rows):
    got = [(r.doc_id, r.size, r.text_crc32, r.hilbert, r.shard, r.slot) for r in hilbert_shards(docs, 16).collect()]
    assert sorted(got) == sorted(plain(rows, 16))


def test_odd_rows(odd, none):
    rows = [tuple(r)[:5] for r in odd.collect()]
    got = [(r.doc_id, r.size, r.text_crc32, r.hilbert, r.shard, r.slot) for r in hilbert_shards(odd, 16).collect()]
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=key) == sorted(plain(rows, 16), key=key)
    assert hilbert_shards(none).count() == 0
    assert {r.law for r in hilbert_shards(odd).collect()} == {"rows"}


def test_filters_prune_shards(spark):
    """A filter on one language, source or range of sizes needs some of the 16 shards only."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hilbert_shards(docs, 16).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    shards = lambda keep: len({r.shard for r in rows if keep(r)})
    assert all(shards(lambda r, x=x: r.lang == x) <= 8 for x in ("de", "es", "fr"))
    assert all(shards(lambda r, x=x: r.source == x) <= 10 for x in {r.source for r in rows})
    assert shards(lambda r: r.size > 20_000) <= 10
