"""Token ids of whole texts, computed once per distinct chunk.

A text may be cut before a single space or line feed that stands between two
solid characters, and between a letter and one of ``. , ! ?``: neither
pre-tokenizer lets a match run across such a place, no normalizer joins what
lies on both sides, and added tokens hold none of these characters. So the ids
of a text are the ids of its chunks in order. Chunks repeat a lot; the
tokenizers library sees each distinct one of a block once, and the frequent
ones once per worker. Elsewhere (other white space, marks, scripts beyond
Latin-1) a text is simply not cut.
"""

from __future__ import annotations

import os

import numpy as np

from .bytescan import BYTE_CODES, hash_spans

CACHE_ENTRIES = 400_000

_SOLID, _LETTER, _STOP, _BLANK = (np.zeros(256, bool) for _ in range(4))
_SOLID[0x21:0x7F] = True
_LETTER[65:91] = _LETTER[97:123] = True
_STOP[list(b".,!?")] = True
_BLANK[list(b" \n")] = True


def chunk_spans(buf: np.ndarray, offsets: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all chunks and each row's first chunk (rows + 1 entries); an empty row has none."""
    cut = np.zeros(len(buf) + 1, bool)
    space = cut.copy()
    if len(buf) > 2:
        after = _SOLID[buf] | (buf == 0xC3)
        latin = np.zeros(len(buf), bool)
        latin[1:] = (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & (buf[:-1] == 0xC3)
        before = _SOLID[buf] | latin
        space[1:-2] = _BLANK[buf[1:-1]] & before[:-2] & after[2:]
        letter = _LETTER[buf] | (latin & (buf != 0x97) & (buf != 0xB7))
        cut[1:-1] = space[1:-1] | (_STOP[buf[1:]] & letter[:-1])
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(buf))]
        for x in (cut, space):
            x[edges] = False  # no row is cut at its own first or last byte
            x[edges - 1] = False
    nonempty = offsets[:-1][np.diff(offsets) > 0]
    cut[nonempty] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    first = np.searchsorted(starts, offsets, "left")
    if not keep_space:
        starts = starts + space[starts]
    return starts, ends, first


class ChunkTokenizer:
    """``path``: a file of the tokenizers library; ``keep_space``: whether the space before a word is part of its tokens."""

    def __init__(self, path: str, keep_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep_space = Tokenizer.from_file(path), keep_space
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c in x for x in added for c in " \n.,!?"):
            raise ValueError("texts can't be cut: an added token holds a space or a stop")
        self.marker, self.marker_id = next(((x.content, i) for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special and not (x.lstrip or x.rstrip or x.normalized)), ("", -1))
        self._reset(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _reset(self, keys: np.ndarray, at: np.ndarray, pool: np.ndarray, seen: np.ndarray) -> None:
        self.keys, self.at, self.pool, self.seen = keys, at, pool, seen

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the rows' offsets into them."""
        starts, ends, first = chunk_spans(buf, offsets, self.keep_space)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, sample, inverse, counts = np.unique(hash_spans(buf, starts, ends, BYTE_CODES), return_index=True, return_inverse=True, return_counts=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            data = buf.tobytes()
            texts = [data[a:b].decode() for a, b in zip(starts[sample[fresh]].tolist(), ends[sample[fresh]].tolist())]
            del data
            self._merge(keys[fresh], *self._plain(texts))
            place = np.searchsorted(self.keys, keys)
        self.seen[place] += counts
        size = (self.at[1:] - self.at[:-1])[place]
        lengths = size[inverse]
        upto = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        out = self.pool[np.repeat(self.at[:-1][place][inverse] - upto[:-1], lengths) + np.arange(upto[-1])]
        self._trim()
        return out, upto[first]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of all texts. A special token that is in none of them parts them, so that hundreds make one call."""
        if not self.marker or any(self.marker in x for x in texts):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((i for x in ids for i in x), np.uint32, sum(map(len, ids)))
        joined = [self.marker.join([*texts[i : i + 256], ""]) for i in range(0, len(texts), 256)]
        flat = np.concatenate([np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.marker_id)
        return np.diff(ends, prepend=-1) - 1, flat[flat != self.marker_id]

    def _merge(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        at = np.concatenate([self.at[:-1], len(self.pool) + np.cumsum(sizes) - sizes])
        size = np.concatenate([np.diff(self.at), sizes])
        self._order(np.concatenate([self.keys, keys]), at, size, np.concatenate([self.pool, ids]), np.concatenate([self.seen, np.zeros(len(keys), np.int64)]))

    def _order(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray, pool: np.ndarray, seen: np.ndarray) -> None:
        order = np.argsort(keys)
        at, size = at[order], size[order]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        pool = pool[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
        self._reset(keys[order], upto, pool, seen[order])

    def _trim(self) -> None:
        """Keep the chunks seen most often; what goes is only encoded again when it comes again."""
        if len(self.keys) > CACHE_ENTRIES:
            best = np.sort(np.argpartition(-self.seen, CACHE_ENTRIES // 2)[: CACHE_ENTRIES // 2])
            self._order(self.keys[best], self.at[:-1][best], np.diff(self.at)[best], self.pool, self.seen[best] // 2)


_LOADED: dict[tuple[str, bool], ChunkTokenizer] = {}


def tokenizer(path: str, keep_space: bool) -> ChunkTokenizer:
    """One per worker and file."""
    if (path, keep_space) not in _LOADED:
        _LOADED[path, keep_space] = ChunkTokenizer(path, keep_space)
    return _LOADED[path, keep_space]
