"""Exact and fast encoding of whole texts with a public tokenizer file.

Where a file's pre-tokenizer drops white space, a text's ids are the ids of its
white-space-separated words, one after the other; a letter or digit and ASCII
punctuation after it are apart, too. So a text is a sequence of units, and each
distinct unit is encoded once by the tokenizers library. Units are found and
compared by 64-bit hashes in numpy, and ids are gathered by index, so no word
of a text becomes a Python object unless the worker meets it for the first time.

Other tokenizer files encode whole texts with the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np

from . import shingles

#: Units whose ids a worker keeps, about (some 30 bytes each). Bounds memory, never results.
CACHE_UNITS = 2_000_000
#: Bytes of text that are encoded together, about (some 60 bytes of arrays each); a longer text makes a buffer of its own size.
CHUNK = 1 << 20
#: Unknown units that are joined into one string for the library.
JOINED = 512
#: Fixed value: the pre-tokenizer pattern under which units are independent.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_LENGTH = np.uint64(0xA24BAED4963EE407)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of U+00C0 to U+00DE in lower case; every other byte as it is."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    second = np.flatnonzero(buf[:-1] == 0xC3) + 1
    second = second[(buf[second] >= 0x80) & (buf[second] <= 0x9E) & (buf[second] != 0x97)]
    out[second] += 32
    return out


class Encoder:
    """Encodes texts as the library does with ``add_special_tokens=False``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        first = ((shape["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_units = first.get("pattern") == {"Regex": WORD_PATTERN} and first.get("behavior") == "Removed" and bool(first.get("invert"))
        if self.by_units:
            # lower-case letters need neither the normalizer nor the pattern: a word of them is one piece of the model
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = shape["model"].get("end_of_word_suffix")
            self.closes = np.zeros(1 + max(self.tokenizer.get_vocab().values()), dtype=bool)
            self.closes[[i for w, i in self.tokenizer.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.first = np.zeros(0, np.int64)  # of a unit's ids in the pool
        self.count = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, texts: Sequence[bytes], end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, ids, begins): the ids of texts[lo:hi] as unsigned 32-bit integers, each text closed by ``end_id``.

        ``begins`` has one entry more than there are texts.
        """
        lo = size = 0
        for hi, text in enumerate(texts):
            if size and size + len(text) > CHUNK:
                yield lo, hi, *self._chunk(texts[lo:hi], end_id)
                lo, size = hi, 0
            size += len(text) + 1
        if lo < len(texts):
            yield lo, len(texts), *self._chunk(texts[lo:], end_id)

    def _chunk(self, texts: Sequence[bytes], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if self.by_units:
            ids, counts = self._units(texts)
        else:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ids = np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(counts.sum()))
        if end_id is not None:
            begins = np.concatenate([[0], np.cumsum(counts + 1)])
            out = np.empty(begins[-1], dtype=np.uint32)
            inside = np.ones(len(out), dtype=bool)
            inside[begins[1:] - 1] = False
            out[inside] = ids
            out[begins[1:] - 1] = end_id
            return out, begins
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _units(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        raw = b"\n" + b"\n".join(texts) + b"\n"
        plain = np.frombuffer(raw, dtype=np.uint8)
        space = shingles._SPACE[plain]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]  # of words; the end is exclusive
        # as they stand: words that may hold a special token, and words with combining marks, where case counts
        as_is = np.zeros(len(starts), dtype=bool)
        odd = np.flatnonzero(plain >= 0xCA)
        at = raw.find(b"<|")
        special = []
        while at >= 0:
            special.append(at)
            at = raw.find(b"<|", at + 2)
        if len(odd) or special:
            as_is[np.searchsorted(starts, np.concatenate([odd, np.array(special, dtype=np.int64)]), side="right") - 1] = True
        buf = lowered(plain)
        if as_is.any():
            inside = np.zeros(len(buf) + 1, dtype=np.int8)
            np.add.at(inside, starts[as_is], 1)
            np.add.at(inside, ends[as_is], -1)
            keep = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            buf[keep] = plain[keep]
        # trailing punctuation behind a letter or digit is a unit of its own
        core = ends.copy()
        busy = np.flatnonzero(_PUNCTUATION[buf[core - 1]] & ~as_is)
        while len(busy):
            core[busy] -= 1
            busy = busy[(core[busy] > starts[busy]) & _PUNCTUATION[buf[core[busy] - 1]]]
        last = buf[core - 1]
        latin = np.flatnonzero((last >= 0x80) & (core < ends) & ~as_is)
        lead = buf[core[latin] - 2]
        # letters of U+00C0 to U+024F but the two signs and U+0130, whose lower case ends in a combining mark
        letter = (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC9) & (last[latin] > 0x8F)) & ~((lead == 0xC3) & ((last[latin] == 0x97) | (last[latin] == 0xB7))) & ~((lead == 0xC4) & (last[latin] == 0xB0))
        apart = _ALNUM[last] & (core < ends) & (core > starts)
        apart[latin[letter]] = True
        core = np.where(apart, core, ends)
        # each word's core and, where it is apart, its punctuation
        n = 1 + apart.astype(np.int64)
        place = np.cumsum(n) - n
        begin, end = np.empty(int(n.sum()), dtype=np.int64), np.empty(int(n.sum()), dtype=np.int64)
        begin[place], end[place] = starts, core
        begin[place[apart] + 1], end[place[apart] + 1] = core[apart], ends[apart]
        powers = shingles._POWERS
        powers.grow(len(buf) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles._BYTE[buf] * powers.up[: len(buf)], dtype=np.uint64)])
        keys = shingles.mix((total[end] - total[begin]) * powers.down[begin] + (end - begin).astype(np.uint64) * _LENGTH)
        distinct, example, which = np.unique(keys, return_index=True, return_inverse=True)
        slot = self._slots(distinct, example, buf, begin, end)
        count = self.count[slot].astype(np.int64)[which]
        reach = np.cumsum(count)
        own = np.arange(reach[-1] if len(reach) else 0) + np.repeat(self.first[slot][which] - (reach - count), count)
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        bounds = np.concatenate([[0], reach])[np.searchsorted(begin, text_ends)]
        ids = self.pool[own]
        if len(self.keys) > CACHE_UNITS:
            self._forget()
        return ids, np.diff(np.concatenate([[0], bounds]))

    def _slots(self, keys: np.ndarray, example: np.ndarray, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the cache holds these distinct units; those that it doesn't know are encoded first."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if not len(new):
            return at
        b, e = begin[example[new]], end[example[new]]
        ids, counts = self._encode_units(buf, b, e)
        first = len(self.pool) + np.cumsum(counts) - counts
        where = np.searchsorted(self.keys, keys[new])
        self.keys, self.first, self.count = (np.insert(x, where, y) for x, y in ((self.keys, keys[new]), (self.first, first), (self.count, counts)))
        self.pool = np.concatenate([self.pool, ids])
        return np.searchsorted(self.keys, keys)

    def _encode_units(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units buf[begin:end] in a row, and how many each has."""
        # small letters of ASCII and of U+00DF to U+00FF
        fine = _LETTER[buf]
        second = np.flatnonzero(buf[:-1] == 0xC3) + 1
        second = second[(buf[second] >= 0x9F) & (buf[second] != 0xB7)]
        fine[second] = fine[second - 1] = True
        odd = np.concatenate([[0], np.cumsum(~fine)])
        simple = odd[end] == odd[begin]
        raw = buf.tobytes()
        units = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        counts = np.zeros(len(units), dtype=np.int32)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # places of units, and their ids in a row
        chosen = np.flatnonzero(simple)
        groups = [chosen[i : i + JOINED] for i in range(0, len(chosen), JOINED)]
        texts = [b" ".join([units[i] for i in g.tolist()]).decode() for g in groups]
        later = [np.flatnonzero(~simple)]
        for g, found in zip(groups, self.letters.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, dtype=np.uint32)
            closed = np.flatnonzero(self.closes[ids])
            if len(closed) != len(g) or closed[-1] != len(ids) - 1:
                later.append(g)
                continue
            counts[g] = np.diff(np.concatenate([[-1], closed]))
            parts.append((g, ids))
        rest = np.concatenate(later)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([units[i].decode() for i in rest.tolist()], add_special_tokens=False)]
        counts[rest] = [len(x) for x in found]
        parts.append((rest, np.fromiter((i for x in found for i in x), dtype=np.uint32, count=sum(map(len, found)))))
        first = np.cumsum(counts, dtype=np.int64) - counts
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        for g, ids in parts:
            n = counts[g].astype(np.int64)
            out[np.arange(len(ids)) + np.repeat(first[g] - (np.cumsum(n) - n), n)] = ids
        return out, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file; the file is read by the worker that needs it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
