"""Byte-pair encoding and decoding of whole texts with a public vocabulary file.

A word's parts lie in one contiguous array, with the rank of every adjacent pair beside it.
The smallest rank is found by a scan, its boundary is deleted, and the ranks of the two
neighbours are looked up again. The arrays of many words are the rows of one matrix, so each
of these steps is one numpy call for all of them. That suits short words; words of more than
``SCAN_LIMIT`` parts get the same result from a heap, as scans would cost the square of
their length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SCAN_LIMIT = 128
#: Words go through the scan in groups of these lengths, so that rows are padded little.
WIDTHS = (4, 8, 12, 16, 24, 48, SCAN_LIMIT)
#: Runs of text whose ids a worker keeps; beyond it starts anew.
CACHED_CHUNKS = 250_000
#: Texts whose ids are returned at once.
SLICE = 500
#: Bytes of text that are cut into runs at once.
BLOCK_BYTES = 1 << 20
_NONE = np.int64(1) << 40


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the rest for the characters from 256 on.
    """
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Ranks:
    """Rank and merged id of pairs of ids, for whole arrays of pairs: a table of 2**20 slots.

    Pairs whose slot is taken by another are found by binary search instead.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([(a << 20) | b for a, b in pairs], np.int64)
        values = np.array([*pairs.values()], np.int64).reshape(-1, 2)
        self.keys = np.full(1 << 20, -1, np.int64)
        self.rank = np.full(1 << 20, _NONE, np.int64)
        self.new = np.zeros(1 << 20, np.int64)
        slots, first = np.unique(self._slot(keys), return_index=True)
        self.keys[slots], self.rank[slots], self.new[slots] = keys[first], values[first, 0], values[first, 1]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more = np.append(keys[rest], np.iinfo(np.int64).max)
        self.more_rank, self.more_new = np.append(values[rest, 0], _NONE), np.append(values[rest, 1], 0)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left << 20) | right
        slots = self._slot(keys)
        rank, new = self.rank[slots], self.new[slots]
        missed = np.flatnonzero(self.keys[slots] != keys)
        at = np.searchsorted(self.more, keys[missed])
        found = self.more[at] == keys[missed]
        rank[missed], new[missed] = np.where(found, self.more_rank[at], _NONE), self.more_new[at]
        return rank, new


class Codec:
    """Encoder and decoder of one vocabulary file (its JSON text).

    Supported is the pipeline of the word-end vocabularies: NFC, white space, lower case; a
    pattern whose matches are the words; byte-level characters; BPE with a word-end mark; no
    decoder. Anything else raises ValueError instead of encoding differently.
    """

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if (
            steps != ["NFC", "Replace", "Lowercase"]
            or model["type"] != "BPE"
            or (split["behavior"], split["invert"], level["use_regex"], level["add_prefix_space"]) != ("Removed", True, False, False)
            or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            or spec["decoder"]
            or spec["post_processor"]
        ):
            raise ValueError("this vocabulary needs steps that are not supported")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        #: Pair of token ids to (rank, id of the merged token).
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.ranks = Ranks(self.pairs)
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int64)
        self.last = np.array([vocab[c + end] for c in characters], np.int64)
        self.word = regex.compile("(?:" + split["pattern"]["Regex"] + r")|\n")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self._forget()

    def _forget(self) -> None:
        """Start anew: code of each known run of text, its ids (all in one array) and their ends."""
        self.codes: dict[bytes, int] = {}
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
        counts, rows, least = np.zeros(len(raw), np.int64), [], 0
        for width in WIDTHS:
            which = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if len(which):
                column = np.arange(width)
                inside = column < sizes[which, None]
                data = flat[np.where(inside, starts[which, None] + column, 0)]
                parts = np.where(column == sizes[which, None] - 1, self.last[data], self.inner[data])
                parts, counts[which] = self._scan(parts, sizes[which].copy())
                rows.append((which, parts))
        for i in np.flatnonzero(sizes > SCAN_LIMIT):
            data = np.frombuffer(raw[i], np.uint8)
            found = self._heap([*self.inner[data[:-1]].tolist(), int(self.last[data[-1]])])
            counts[i] = len(found)
            rows.append((np.array([i]), np.array([found], np.int64)))
        out, to = np.empty(counts.sum(), np.int32), np.cumsum(counts) - counts
        for which, parts in rows:
            inside = np.arange(parts.shape[1]) < counts[which, None]
            out[(to[which, None] + np.arange(parts.shape[1]))[inside]] = parts[inside]
        return out, counts

    def _scan(self, parts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge in every row; ``n`` counts its parts. Rows that are done leave the work."""
        width = parts.shape[1]
        column, live = np.arange(width), np.arange(len(parts))
        p, k = parts, n
        ranks, _ = self.ranks.of(p[:, :-1].ravel(), p[:, 1:].ravel())
        ranks = np.where(column[:-1] < k[:, None] - 1, ranks.reshape(len(p), width - 1), _NONE)
        ranks = np.hstack([ranks, np.full((len(p), 1), _NONE)])
        while True:
            at = ranks.argmin(1)
            going = ranks[np.arange(len(p)), at] != _NONE
            if not going.all():
                parts[live[~going]], n[live[~going]] = p[~going], k[~going]
                p, k, ranks, at, live = p[going], k[going], ranks[going], at[going], live[going]
            if not len(p):
                return parts, n
            row = np.arange(len(p))
            _, new = self.ranks.of(p[row, at], p[row, at + 1])
            # Delete the boundary after `at`: what lies behind moves one place forward.
            step = column + (column > at[:, None])
            step[:, -1] = np.minimum(step[:, -1], width - 1)
            p, ranks = np.take_along_axis(p, step, 1), np.take_along_axis(ranks, step, 1)
            ranks[:, -1] = _NONE
            p[row, at], k = new, k - 1
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < k - 1)
            ranks[row, at] = _NONE
            ranks[before, at[before] - 1] = self.ranks.of(p[before, at[before] - 1], new[before])[0]
            ranks[after, at[after]] = self.ranks.of(new[after], p[after, at[after] + 1])[0]

    def _heap(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(pairs[x][0], i, *x, pairs[x][1]) for i, x in enumerate(pairwise(parts)) if x in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (found := pairs.get((parts[left], parts[right]))):
                    heapq.heappush(heap, (found[0], left, parts[left], parts[right], found[1]))
        return [p for p in parts if p >= 0]

    def _learn(self, chunks: list[bytes]) -> None:
        """Ids of runs without ASCII white space; no word, composition or case mapping crosses their ends."""
        text = unicodedata.normalize("NFC", b"\n".join(chunks).decode())
        # Each character is lowered on its own, so a sigma at a word's end stays an ordinary one.
        words = self.word.findall(text.replace("Σ", "σ").lower())
        code = {w: i for i, w in enumerate(dict.fromkeys(words)) if w != "\n"}
        kinds = list(code)
        ids, counts = self.encode_words(kinds)
        place = {w: i for i, w in enumerate(kinds)}
        at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
        chunk = np.cumsum(at < 0)[at >= 0]
        at = at[at >= 0]
        sizes = np.bincount(chunk, counts[at], len(chunks)).astype(np.int64)
        self.ids = np.concatenate([self.ids, _gather(ids, np.cumsum(counts) - counts, counts, at)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, one after another, and how many each has."""
        if len(self.codes) > CACHED_CHUNKS:
            self._forget()
        split = [t.encode().split() for t in texts]
        codes, fresh, at = self.codes, [], []
        for chunks in split:
            for c in chunks:
                if (i := codes.get(c)) is None:
                    codes[c] = i = len(codes)
                    fresh.append(c)
                at.append(i)
        if fresh:
            self._learn(fresh)
        at = np.array(at, np.int64)
        sizes = np.diff(self.ends)
        ends = np.cumsum([0, *map(len, split)])
        total = np.append(0, np.cumsum(sizes[at]))
        return _gather(self.ids, self.ends[:-1], sizes, at), total[ends[1:]] - total[ends[:-1]]

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; NULL counts as empty."""
        out, counts, block, size = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [], 0
        for text in chain(texts, [None]):
            special = bool(text) and any(s in text for s in self.special)
            block.append("" if special else text or "")
            size += len(block[-1])
            if size > BLOCK_BYTES or special or len(block) > 10_000:
                for kept, x in zip((out, counts), self._block(block)):
                    kept.append(x)
                block, size = [], 0
            if special:
                parts = [[self.special[x]] if x in self.special else self._block([x])[0] for x in self.special_parts.split(text)]
                out.append(np.concatenate(parts).astype(np.int32))
                counts[-1][-1] = len(out[-1])
        for kept, x in zip((out, counts), self._block(block)):
            kept.append(x)
        return np.concatenate(out), np.concatenate(counts)[:-1]

    def decode(self, ids: Iterable[int]) -> str:
        """Names of the tokens joined by a space; ids out of the vocabulary give nothing."""
        return " ".join(filter(None, map(self.names.get, ids)))


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[i]: starts[i] + sizes[i]]`` for each i of ``at``, one after another."""
    size = sizes[at]
    ends = np.cumsum(size)
    return values[np.repeat(starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Tokenizer:
    """Columns that encode and decode with the vocabulary file at ``path``.

    The driver reads the file (some MB) and broadcasts it, so executors need no copy. A task
    builds one codec, which goes with the task.
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            spec = file.read()
        Codec(spec)  # raises here, not in a task
        shared = spark.sparkContext.broadcast(spec)

        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = Codec(shared.value)
            for batch in batches:
                for at in range(0, len(batch), SLICE):
                    ids, counts = codec.encode(t.as_py() for t in batch.slice(at, SLICE))
                    yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids))

        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = Codec(shared.value)
            for batch in batches:
                for at in range(0, len(batch), SLICE):
                    ids, counts = codec.encode(t.as_py() for t in batch.slice(at, SLICE))
                    ends = np.append(0, np.cumsum(counts))
                    texts = [codec.decode(ids[a:b].tolist()) for a, b in pairwise(ends)]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                    yield pa.StructArray.from_arrays([lists, pa.array(texts, pa.string())], names=["ids", "decoded"])

        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = Codec(shared.value)
            for rows in batches:
                yield pa.array([codec.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else ()) for x in rows], pa.string())

        self._both = F.arrow_udf(both, "struct<ids:array<int>,decoded:string>")
        self._encode, self._decode = F.arrow_udf(encode, "array<int>"), F.arrow_udf(decode, "string")

    def encode(self, text: Column) -> Column:
        """Token ids of a text. NULL and empty texts, and texts of white space only, give no ids."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """Text of token ids. NULL and empty lists give the empty text."""
        return self._decode(ids)

    def round_trip(self, text: Column) -> Column:
        """Struct of ``ids`` and of ``decoded``, what these ids decode to, in one pass."""
        return self._both(text)
