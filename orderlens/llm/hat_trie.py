"""A HAT-trie of word paths with counts, spilled as sorted runs; used inside one task."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Paths of a next word in one insertion after which they leave the shared hash container for one of their own, and
#: paths in that one before it bursts into a node by second words.
OWN, BURST = 64, 4096

#: Paths that a task holds before it spills all its subtrees; texts of 1.5 times as many bytes wait to be inserted together.
PATHS = 600_000

#: Bytes of text per part: what one part's phrases need in memory when they are summed.
PART_BYTES = 4 << 20

#: Bytes of one part's runs that are summed at once; as many as the sums so far, if those take more.
MERGE_BYTES = 32 << 20

#: Bits of an id in a path's key, which has three: first word, second word, and the third word or the id of all later ones.
BITS = 21
_ID = (1 << BITS) - 1

#: Words that stand for the end of a piece, and behind depth - 1 words that begin no path; no UTF-8 text has these bytes.
END, AHEAD = b"\xff", b"\xfe"

RUN = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])

_ZSTD = pa.Codec("zstd")


class _Ids(dict):
    """Ids in order of appearance."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class _Node:
    """A trie node: the hash container that paths with rare next words share, and frequent words' own, a container or,
    burst, a node again."""

    __slots__ = ("shared", "own")

    def __init__(self):
        self.shared, self.own = Counter(), {}

    def insert(self, keys: np.ndarray, level: int = 0) -> int:
        """Counts sorted keys; returns how many are new."""
        words = keys >> BITS * (2 - level) & _ID
        starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        own, rare, new = self.own, np.ones(len(keys), bool), 0
        for word, a, b in zip(words[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            if word in own or b - a >= OWN:
                rare[a:b] = False
                box = own.get(word)
                if box.__class__ is _Node:
                    new += box.insert(keys[a:b], level + 1)
                    continue
                if box is None:
                    box = own[word] = Counter()
                new += _count(box, keys[a:b])
                if level == 0 and len(box) >= BURST:
                    own[word] = _burst(box)
        return new + _count(self.shared, keys[rare])

    def containers(self) -> Iterator[Counter]:
        yield self.shared
        for box in self.own.values():
            if box.__class__ is _Node:
                yield from box.containers()
            else:
                yield box


def _count(box: Counter, keys: np.ndarray) -> int:
    before = len(box)
    box.update(keys.tolist())
    return len(box) - before


def _burst(box: Counter) -> _Node:
    """A first word's container as a node by second words."""
    node = _Node()
    sizes = Counter(key >> BITS & _ID for key in box)
    node.own = {word: Counter() for word, n in sizes.items() if n >= OWN}
    for key, n in box.items():
        node.own.get(key >> BITS & _ID, node.shared)[key] = n
    return node


class _Top:
    """One language's trie, the texts that wait for it, and occurrences of all words."""

    def __init__(self):
        self.root, self.held, self.words = _Node(), [], 0


class HatTrie:
    """Occurrences of all phrases of at most ``depth`` words, per language.

    Each word starts one path of ``depth`` ids (0 after the end of its piece), which is counted in a hash container:
    one that all rare first words share, or their own, which bursts at BURST paths.  Texts wait until many paths
    can be sorted and counted container by container.  Counts of shorter phrases
    are sums over subtrees, made when a subtree is spilled.  Runs are dealt to ``parts`` by the hash of a phrase's
    first two words, and by its last words in an eighth as many ways, so that no prefix fills a part.
    """

    def __init__(self, depth: int, parts: int):
        self.depth, self.parts, self.ways = depth, parts, max(8, parts // 8)
        self._clear()

    def _clear(self) -> None:
        self.ids, self.tails, self.tops, self.paths, self.waiting = _Ids({END: 0, AHEAD: 1}), _Ids(), {}, 0, 0

    def add(self, lang: str, text: bytes) -> None:
        """Words parted by white space, of which each begins a path; but END (depth - 1 times at least) parts pieces, and
        AHEAD follows depth - 1 words that begin none."""
        top = self.tops.get(lang) or self.tops.setdefault(lang, _Top())
        top.held.append(text)
        self.waiting += len(text)
        if self.waiting > 3 * PATHS // 2:
            self._insert()

    def _ids(self, texts: list[bytes]) -> np.ndarray:
        text = b" ".join(texts).strip()
        if not text:
            return np.zeros(0, np.int64)
        offsets = pa.py_buffer(np.array([0, len(text)], np.int64))
        one = pa.Array.from_buffers(pa.large_string(), 1, [None, offsets, pa.py_buffer(text)])
        words = pc.ascii_split_whitespace(one).flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()  # to_pylist takes ten times as long
        ids = map(self.ids.__getitem__, distinct)
        return np.fromiter(ids, np.int64, len(distinct))[words.indices.to_numpy()]

    def _insert(self) -> None:
        """Counts the paths of all texts that wait."""
        for top in self.tops.values():
            if not top.held:
                continue
            ids, top.held = self._ids(top.held), []
            begins = ids > 1
            for at in np.flatnonzero(ids == 1):
                begins[at - self.depth + 1:at] = False
            begins = np.flatnonzero(begins)
            top.words += len(begins)
            columns = [ids[begins + i] for i in range(self.depth)]
            if self.depth > 3:
                tails = zip(*(c.tolist() for c in columns[2:]))
                columns[2:] = [np.fromiter(map(self.tails.__getitem__, tails), np.int64, len(begins))]
            keys = sum(c << BITS * (2 - i) for i, c in enumerate(columns))
            keys.sort()
            if len(keys):
                self.paths += top.root.insert(keys)
        self.waiting = 0

    def full(self) -> bool:
        return self.paths > PATHS or max(len(self.ids), len(self.tails)) > _ID // 2

    def spill(self) -> Iterator[pa.RecordBatch]:
        """Sorted runs of all subtrees; the words' ids begin anew."""
        self._insert()
        words = [b"", b"", *list(self.ids)[2:]]
        first, later = (pa.array([w and mark + w for w in words], pa.large_binary()) for mark in (b"\n", b" "))
        hashes = np.fromiter(map(zlib.crc32, self.ids), np.int64, len(words))
        tails = np.array(list(self.tails), np.int64)
        tops = self.tops
        self._clear()
        while tops:
            lang, top = tops.popitem()
            yield from _blocks(lang, pa.array([b"\n"], pa.large_binary()), np.array([top.words]), np.array([zlib.crc32(lang.encode()) % self.parts]))
            if top.words:
                boxes, top.root = list(top.root.containers()), None
                yield from self._run(lang, boxes, tails, first, later, hashes)

    def _run(self, lang: str, boxes: list[Counter], tails: np.ndarray, first: pa.Array, later: pa.Array, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = sum(map(len, boxes))
        keys = np.fromiter(chain.from_iterable(boxes), np.int64, total)
        counts = np.fromiter(chain.from_iterable(map(dict.values, boxes)), np.int64, total)
        boxes.clear()  # room for the strings
        if self.depth > 3:
            words = [keys >> 2 * BITS, keys >> BITS & _ID, *tails[keys & _ID].T]
            order = np.lexsort(words[::-1])
        else:
            words = [keys >> BITS * (2 - i) & _ID for i in range(self.depth)]
            order = np.argsort(keys)
        words, counts = [w[order].astype(np.int32) for w in words], counts[order]
        del keys, order
        changed = np.zeros(total, bool)
        changed[:1] = True
        prefix = np.full(total, zlib.crc32(lang.encode()), np.int64)
        phrases, sums, parts = [[] for _ in words], [], []
        for length, column in enumerate(words, 1):
            changed[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(changed)
            whole = column[starts] > 0
            n, starts = np.add.reduceat(counts, starts)[whole], starts[whole]
            mixed = prefix * 1_000_003 + hashes[column] & 0x7FFFFFFFFFFF
            prefix = mixed if length <= 2 else prefix
            last = hashes[column[starts]] % self.ways if length > 2 else 0
            for i, ids in enumerate(phrases):
                ids.append(words[i][starts] if i < length else np.zeros(len(starts), np.int32))
            sums.append(n)
            parts.append(((prefix[starts] >> 8) + last) % self.parts)
        del words, counts, prefix, mixed, changed
        parts = np.concatenate(parts).astype(np.min_scalar_type(self.parts))
        order = np.argsort(parts, kind="stable")
        pieces = [names.take(pa.array(np.concatenate(ids)[order])) for names, ids in zip(chain([first], [later] * self.depth), phrases)]
        joined = pc.binary_join_element_wise(*pieces, pa.scalar(b"", pa.large_binary()))
        yield from _blocks(lang, joined, np.concatenate(sums)[order], parts[order])


def _blocks(lang: str, phrases: pa.Array, counts: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per part: its phrases, a line each, and their counts.  Phrases come by part, each after a line end."""
    starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
    ends = np.r_[starts[1:], len(parts)]
    _, offsets, text = phrases.buffers()
    offsets, counts = np.frombuffer(offsets, np.int64), counts.astype("<i8")
    for at in range(0, len(starts), 512):
        rows = [(int(parts[a]), lang, pack(text.slice(offsets[a] + 1, offsets[b] - offsets[a] - 1)), pack(pa.py_buffer(counts[a:b])))
                for a, b in zip(starts[at:at + 512].tolist(), ends[at:at + 512].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RUN)], schema=RUN)


def pack(data: pa.Buffer) -> bytes:
    """Length and zstd block."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unpack(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def merged(batches, least: int) -> Iterator[pa.RecordBatch]:
    """Sums over runs sorted by (part, lang): phrases that occur ``least`` times, and all words of a language (phrase empty)."""
    key, done, held, size, limit = None, [], [], 0, MERGE_BYTES

    def sums() -> pa.Table:
        """The sums so far and of the runs held."""
        tables = [*done, _lines(held)] if held else [*done]
        done.clear()
        held.clear()
        return pa.concat_tables(tables).group_by("phrase", use_threads=False).aggregate([("f", "sum")]).rename_columns(["phrase", "f"])

    def frequent() -> Iterator[pa.RecordBatch]:
        table = sums()
        table = table.filter(pc.or_(pc.greater_equal(table["f"], least), pc.equal(table["phrase"], pa.scalar(b"\n"))))
        for b in table.to_batches():
            yield pa.RecordBatch.from_arrays([pa.repeat(key[1], len(b)), pc.binary_slice(b["phrase"], 0, -1).cast(pa.string()), b["f"]],
                                             ["lang", "phrase", "f"])
    for batch in batches:
        for part, lang, phrases, counts in zip(*(batch.column(c) for c in RUN.names)):
            if key != (part.as_py(), lang.as_py()):
                if key:
                    yield from frequent()
                key, done, held, size, limit = (part.as_py(), lang.as_py()), [], [], 0, MERGE_BYTES
            held.append((unpack(phrases.as_py()), unpack(counts.as_py())))
            size += sum(map(len, held[-1]))
            if size > limit:
                done, held, size = [sums()], [], 0
                limit = max(MERGE_BYTES, done[0].nbytes)
    if key:
        yield from frequent()


def _lines(runs: list[tuple[bytes, bytes]]) -> pa.Table:
    """Phrases, each with its line end, and their counts."""
    text = b"\n".join([phrases for phrases, _ in runs] + [b""])
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    offsets = np.zeros(len(ends) + 1, np.int32)
    np.add(ends, 1, out=offsets[1:], casting="unsafe")
    lines = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
    return pa.table({"phrase": lines, "f": pa.array(np.frombuffer(b"".join([counts for _, counts in runs]), "<i8"))})
