"""Texts as pieces that single blanks lead, and a bounded cache of what a tokenizer makes of them.

In the public byte-level pattern (words, numbers and marks take one blank before them, runs of white space are
matched together) a blank with no white space on either side always begins a pre-token, and merges never cross
pre-tokens. So the ids of a text are those of its first piece and of its blank-led pieces in turn. A blank that
touches other white space separates nothing: it stays inside its piece.

Pieces are told apart and counted in whole Arrow columns; Python sees each distinct piece of a column once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

PART = 4 << 20  # bytes of text that are split into pieces together
MARKS = ".,;:!?$*#%|()[]{}\"-"
TAILS = 10_000
# White space of any Unicode version, and a few marks that some versions count as such.
_SPACE = "\t\n\v\f\r \x1c-\x1f\x85\xa0" + "".join(map(chr, [0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))
_SAFE = re.compile(f"(?<![{_SPACE}]) (?![{_SPACE}])")
_EDGE = re.compile(f"[{_SPACE}]")
_UNEVEN = f" [{_SPACE}]|[{_SPACE}] |[{_SPACE}]\\z"  # for RE2: a blank beside white space, or white space at the end


def parts(batch, place: int, part: int = PART) -> Iterator:
    """A record batch in slices of about `part` bytes of text."""
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(place)), 0)).astype(np.int64)
    upto, low = np.cumsum(size), 0
    while low < batch.num_rows:
        done = int(upto[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(upto, done + part, "right")))
        yield batch.slice(low, high - low)
        low = high


def joins(piece: str) -> bool:
    """Whether a blank-led piece can be matched amid others: no blank inside, no white space at its ends."""
    return bool(piece) and " " not in piece and not _EDGE.match(piece[0]) and not _EDGE.match(piece[-1])


def gather(flat: np.ndarray, size: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that stand in `flat` one after the other, those picked in turn; and the number of values before each
    and after the last."""
    begin = np.cumsum(size) - size
    many = size[pick]
    upto = np.concatenate([[0], np.cumsum(many)])
    return flat[np.repeat(begin[pick] - upto[:-1], many) + np.arange(upto[-1])], upto


class PieceCache:
    """The ids (32-bit integers, as bytes) a tokenizer gives for pieces, by functions of lists of them: `led` for
    pieces that join others, each after a blank, `alone` for whole strings. At most `most` pieces are kept, and
    those of the texts at hand; beyond, the others go."""

    def __init__(self, alone: Callable[[list[str]], list[bytes]], led: Callable[[list[str]], list[bytes]], most: int) -> None:
        self.alone, self.led, self.most = alone, led, most
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _learn(self, pieces: list[str], odd: set[str]) -> list[bytes]:
        """Ids of distinct blank-led pieces; those in `odd` join no others."""
        known = self.known
        raw = list(map(known.get, pieces))
        missing = [k for k, r in enumerate(raw) if r is None]
        if len(known) + len(missing) > self.most:  # what is in use stays
            self.known = known = {p: r for p, r in zip(pieces, raw, strict=True) if r is not None}
        # Letters and the marks after them are pre-tokens apart, so a word is learnt once for all its endings.
        ended, ask = [], {}
        for k in missing:
            p = pieces[k]
            stem = p.rstrip(MARKS)
            if len(stem) < len(p) and stem.isalpha():
                ended.append((k, stem, p[len(stem) :]))
                if stem not in known:
                    ask[stem] = None
            else:
                ask[p] = None
        plain = [p for p in ask if p not in odd] if odd else list(ask)
        if plain:
            known.update(zip(plain, self.led(plain), strict=True))
        if len(plain) < len(ask):
            other = [p for p in ask if p in odd]
            known.update(zip(other, self.alone([" " + p for p in other]), strict=True))
        tails = list({t for _, _, t in ended} - self.tails.keys())
        self.tails.update(zip(tails, self.alone(tails), strict=True))
        if len(self.tails) > TAILS:
            self.tails = {t: self.tails[t] for _, _, t in ended}
        for k, stem, t in ended:
            known[pieces[k]] = raw[k] = known[stem] + self.tails[t]
        for k in missing:
            if raw[k] is None:
                raw[k] = known[pieces[k]]
        return raw

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of texts (null: empty), and the number of ids before each text and after the last."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, "<i4"), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "")
        uneven = np.asarray(pc.match_substring_regex(texts, _UNEVEN))
        cut = pc.split_pattern(texts.filter(pa.array(~uneven)), " ")
        slow = [_SAFE.split(t) for t in texts.filter(pa.array(uneven)).to_pylist()]
        lists = cut if not slow else _in_order(cut, slow, uneven)
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = lists.flatten().dictionary_encode()
        pick = coded.indices.to_numpy().astype(np.int64)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # A text's first piece has no blank before it.
        heads = [pieces[k] for k in pick[ends[:-1]].tolist()]
        opening = list(dict.fromkeys(heads))
        place = {h: len(pieces) + k for k, h in enumerate(opening)}
        pick[ends[:-1]] = np.fromiter(map(place.__getitem__, heads), np.int64, len(heads))
        # Of the others only a first piece and pieces cut with care can have white space where it matters.
        odd = {p for p in (*opening, *chain.from_iterable(slow)) if not joins(p)}
        raw = self._learn(pieces, odd) + self.alone(opening)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat, upto = gather(np.frombuffer(b"".join(raw), "<i4"), size, pick)
        return flat, upto[ends]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        import pyarrow as pa

        flat, ends = self.ids(pa.array(texts, pa.string()))
        raw, cuts = flat.tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _in_order(cut, slow: list[list[str]], uneven: np.ndarray):
    """Lists of pieces in the texts' order, of those cut at every blank and those cut with care."""
    import pyarrow as pa

    both = pa.concat_arrays([cut, pa.array(slow, cut.type)])
    place = np.empty(len(uneven), np.int64)
    place[~uneven], place[uneven] = np.arange(len(cut)), len(cut) + np.arange(len(slow))
    return both.take(pa.array(place))
