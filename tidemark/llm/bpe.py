"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of pre-tokens form linked lists. Each merge rank has a bucket of list positions whose pair has that
rank; a bitmap of three levels marks the ranks whose bucket holds something, so find-first-set gives the
lowest rank in a constant number of steps. A merge pushes at most two new pairs; entries that a merge has
made stale are recognised when they come up and skipped.

One queue serves many short pre-tokens at once: their lists stand side by side with a separator between them,
which no pair crosses, and what is taken from a bucket is the leftmost position of each pre-token, all in one
step. A pre-token's own order of merges is the same as alone. A long pre-token has the queue to itself, in
time O(n log n) whatever its merges, so a "word" of a megabyte is no worse than as many bytes of prose.

The ranks (at most some 10^5 entries, checked) are the only thing broadcast. Pieces of text are cached in each
worker within a fixed bound.

Defined cases: a null text encodes as an empty one (no ids); strings that look like special tokens are
ordinary text; all other columns pass through, ids' own column replaces one of the same name.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .pieces import PieceCache, gather, parts

MOST_RANKS = 1 << 18
CACHED = 300_000
PART = 2 << 20  # bytes of text that are encoded together
DECODED = 1 << 17  # ids whose bytes are gathered together
LONG = 128  # bytes from which a pre-token has a queue of its own


def load_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"{len(ranks)} ranks are more than {MOST_RANKS}")
    return ranks


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        most = max(ranks.values(), default=0)
        # The bitmap's two lower levels, all zero between calls; the top level is one integer.
        self.low, self.mid = [0] * ((most >> 6) + 1), [0] * ((most >> 12) + 1)
        self.byte = np.full(256, -1, np.int64)
        for b in range(256):
            self.byte[b] = ranks.get(bytes([b]), -1)
        # All pairs of tokens that make a token: left * wide + right, and the token.
        self.wide = most + 1
        made = [(a * self.wide + b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        made.sort()
        self.pairs = np.array([-1, *(p for p, _ in made)], np.int64)
        self.makes = np.array([-1, *(r for _, r in made)], np.int64)
        self.cache = PieceCache(self._alone, self._led, CACHED)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token, with the queue to itself. The queue is written out here: this loop is where
        the time goes."""
        get = self.ranks.get
        if (whole := get(word)) is not None:
            return [whole]
        n, low, mid, top = len(word), self.low, self.mid, 0
        buckets: dict[int, int | list[int]] = {}  # by rank: a position, or a heap of several
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [-1] * (n + 1)  # the rank of the pair that begins here; -1: none
        fresh = [(get(word[i : i + 2]), i) for i in range(n - 1)]
        while True:
            for rank, i in fresh:
                if rank is None:
                    pair[i] = -1
                    continue
                pair[i] = rank
                if (held := buckets.get(rank)) is None:
                    buckets[rank] = i
                    k = rank >> 6
                    low[k] |= 1 << (rank & 63)
                    mid[k >> 6] |= 1 << (k & 63)
                    top |= 1 << (k >> 6)
                elif held.__class__ is int:
                    buckets[rank] = [held, i] if held < i else [i, held]
                else:
                    heappush(held, i)
            while top:
                high = top & -top
                a = high.bit_length() - 1
                bit = mid[a] & -mid[a]
                b = a << 6 | bit.bit_length() - 1
                last = low[b] & -low[b]
                rank = b << 6 | last.bit_length() - 1
                i = buckets[rank]
                heap = None
                if i.__class__ is not int:
                    heap = i
                    i = heappop(heap)
                if not heap:
                    del buckets[rank]
                    low[b] ^= last
                    if not low[b]:
                        mid[a] ^= bit
                        if not mid[a]:
                            top ^= high
                if pair[i] == rank:  # else stale
                    break
            else:
                break
            j = after[i]
            k = after[i] = after[j]
            pair[j] = pair[i] = -1
            fresh = []
            if k < n:
                before[k] = i
                fresh.append((get(word[i : after[k]]), i))
            if i:
                h = before[i]
                fresh.append((get(word[h:k]), h))
        ids, i, of = [], 0, self.ranks
        while i < n:
            ids.append(of[word[i : after[i]]])
            i = after[i]
        return ids

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes; -1 for none, and where a side is a separator."""
        key = np.where((left >= 0) & (right >= 0), left * self.wide + right, -1)
        at = np.searchsorted(self.pairs, key, "right") - 1
        return np.where(self.pairs[at] == key, self.makes[at], -1)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens in one queue: all ids, and where each pre-token's end."""
        raw = np.frombuffer(b"\xff" + b"\xff".join(words) + b"\xff", np.uint8)  # a byte that UTF-8 never has
        token = self.byte[raw]
        fence = np.flatnonzero(raw == 255)
        token[fence] = -1
        of = np.cumsum(raw == 255, dtype=np.int32)
        after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        pair = np.full(len(raw), -1, np.int64)
        low, mid, top = self.low, self.mid, 0
        buckets: dict[int, list[np.ndarray]] = {}
        at = np.arange(len(raw) - 1)
        made = pair[:-1] = self._rank_of(token[:-1], token[1:])
        while True:
            # Push what is new, by rank.
            some = np.flatnonzero(made >= 0)
            if len(some):
                ranks, at = made[some], at[some]
                order = np.argsort(ranks, kind="stable")
                ranks, at = ranks[order], at[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
                for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                    if (held := buckets.get(rank)) is not None:
                        held.append(at[a:b])
                        continue
                    buckets[rank] = [at[a:b]]
                    k = rank >> 6
                    low[k] |= 1 << (rank & 63)
                    mid[k >> 6] |= 1 << (k & 63)
                    top |= 1 << (k >> 6)
            if not top:
                break
            # Take the leftmost position of each pre-token from the lowest rank's bucket.
            high = top & -top
            a = high.bit_length() - 1
            bit = mid[a] & -mid[a]
            b = a << 6 | bit.bit_length() - 1
            last = low[b] & -low[b]
            rank = b << 6 | last.bit_length() - 1
            held = buckets.pop(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[pair[at] == rank]  # the others are stale
            if len(at) > 1:
                at = np.sort(at)
                word = of[at]
                again = np.flatnonzero(word[1:] == word[:-1]) + 1
                if len(again):
                    buckets[rank] = [at[again]]
                    at = np.delete(at, again)
            if rank not in buckets:
                low[b] ^= last
                if not low[b]:
                    mid[a] ^= bit
                    if not mid[a]:
                        top ^= high
            second = after[at]
            third = after[second]
            after[at] = third
            before[third] = at
            token[at] = rank
            token[second] = -2
            pair[second] = -1
            ahead = before[at]
            near = token[at]
            made = self._rank_of(np.concatenate([near, token[ahead]]), np.concatenate([token[third], near]))
            at = np.concatenate([at, ahead])
            pair[at] = made
        alive = token >= 0
        ends = np.cumsum(alive)[fence[1:]]
        return token[alive], ends

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pre-tokens in turn, and the number of ids before each and after the last."""
        place = {w: k for k, w in enumerate(dict.fromkeys(words))}
        of = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        raw = [w.encode() for w in place]
        got: list = list(map(self.ranks.get, raw))  # the id, or the ids, or None for one of the common queue
        for k in [k for k, g in enumerate(got) if g is None and len(raw[k]) >= LONG]:
            got[k] = self.merge(raw[k])
        shared = np.array([k for k, g in enumerate(got) if g is None], np.int64)
        kept = [g for g in got if g is not None]
        size = np.array([0 if g is None else 1 if g.__class__ is int else len(g) for g in got], np.int64)
        flat = np.array([i for g in kept for i in ((g,) if g.__class__ is int else g)], "<i4")
        if len(shared):  # their lists come after the others
            found, ends = self.merge_all([raw[k] for k in shared.tolist()])
            rest = np.flatnonzero([g is not None for g in got])
            order = np.concatenate([rest, shared])
            back = np.empty(len(got), np.int64)
            back[order] = np.arange(len(got))
            flat, size, of = np.concatenate([flat, found.astype("<i4")]), np.concatenate([size[rest], np.diff(ends, prepend=0)]), back[of]
        return gather(flat, size, of)

    def _cut(self, words: list[str], starts: list[int]) -> list[bytes]:
        """Ids of pre-tokens as raw integers, in lists that begin at some of them."""
        found, upto = self._each(words)
        raw, cuts = found.tobytes(), (upto[[*starts, len(words)]] * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _alone(self, texts: list[str]) -> list[bytes]:
        """Ids of each string, matched by itself."""
        starts, words = [], []
        for t in texts:
            starts.append(len(words))
            words += self.pattern.findall(t)
        return self._cut(words, starts)

    def _led(self, pieces: list[str]) -> list[bytes]:
        """Ids of a blank and each piece."""
        words = self.pattern.findall(" " + " ".join(pieces))
        starts = [k for k, w in enumerate(words) if w[0] == " "]
        if len(starts) != len(pieces):  # a pattern of another kind
            return self._alone([" " + p for p in pieces])
        return self._cut(words, starts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit integers."""
        return self.cache.encode(texts)


class Bytes:
    """What ids stand for: all tokens' bytes in one table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        known = dict(zip(ranks.values(), ranks, strict=True))
        size = [len(known.get(i, b"")) for i in range(max(known, default=-1) + 1)]
        self.size = np.array(size, np.int64)
        self.table = np.frombuffer(b"".join(known.get(i, b"") for i in range(len(size))), np.uint8)

    def of(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of lists of ids that end at `ends`, and where those of each list end."""
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.size) and (self.size[ids] > 0).all()):
            raise ValueError("an id that no rank has")
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])
        data = [gather(self.table, self.size, ids[k : k + DECODED])[0] for k in range(0, len(ids), DECODED)]
        return np.concatenate([np.zeros(0, np.uint8), *data]), upto[ends]


_coders: dict[str, tuple[Bpe, Bytes]] = {}


def encode(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of every whole text in a column array<int> and, under `decoded`, the bytes that these ids
    stand for. No shuffle."""
    spark: SparkSession = docs.sparkSession
    ranks = load_ranks(ranks_file)
    sent = spark.sparkContext.broadcast(ranks)
    key = f"{ranks_file}:{hash(frozenset(ranks.items()))}:{pattern}"
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    place = kept.index(text)

    def run(batches):
        import pyarrow as pa

        if key not in _coders:
            _coders[key] = Bpe(sent.value, pattern), Bytes(sent.value)
        coder, back = _coders[key]
        for batch in batches:
            for b in parts(batch, place, PART):
                flat, ends = coder.cache.ids(b.column(place))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype("<i4"), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, *([_binary(*back.of(flat, ends))] if decoded else [])], names=[*kept, ids, *([decoded] if decoded else [])])

    out = docs.select(*[docs[f"`{c}`"] for c in kept])
    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    return out.mapInArrow(run, T.StructType([*out.schema.fields, *more]))


def _binary(data: np.ndarray, ends: np.ndarray):
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])


def decode(encoded: DataFrame, ranks_file: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for in a binary column; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_file))
    kept = [c for c in encoded.columns if c != into]
    place = kept.index(ids)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        back = Bytes(sent.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                b = batch.slice(low, 256)
                lists = b.column(place)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))]).astype(np.int64)
                got = pc.if_else(lists.is_valid(), _binary(*back.of(flat, ends)), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*kept, into])

    out = encoded.select(*[encoded[f"`{c}`"] for c in kept])
    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(into, T.BinaryType())]))
