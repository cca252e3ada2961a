"""Encoding texts by remembered units under a byte-level BPE tokenizer file.

A text is cut before every single space between two characters that are no white space: there the
tokenizer's own pattern always cuts, so a unit is a word with the space before it and what follows it. The
distinct units of a slice of texts are found by Arrow; those not remembered are encoded together, as one long
string, and told apart by the spaces that begin them. Ids of the texts are gathered from the ids of
their units. What a worker remembers is named by 128-bit digests in sorted arrays and bounded in bytes: two
generations, of which the older one is let go.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of a generation of remembered units, and how many new ones are gathered before they are sorted in.
GENERATION, RECENT = 32 << 20, 150_000
#: White space other than the space and the line feed.
OTHER_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
CUT = re.compile(r"(?<=\S) (?=\S)")
NEW_WORD = "Ġ"  # the character that stands for the space in byte-level vocabularies


def load(path: str):
    """The tokenizer of a file, with truncation and padding unused."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def simple(text: str) -> bool:
    """Whether every space of the text stands alone between characters that are no white space."""
    return not (text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text or OTHER_SPACE.search(text))


class Known:
    """Units by digest, sorted, with where their ids begin in ``flat`` and how many they are."""

    def __init__(self, names=None, begins=None, counts=None, flat=None):
        self.names = np.empty((0, 2), np.uint64) if names is None else names
        self.begins = np.empty(0, np.int64) if begins is None else begins
        self.counts = np.empty(0, np.int32) if counts is None else counts
        self.flat = np.empty(0, np.uint32) if flat is None else flat

    def __len__(self):
        return len(self.names)

    def size(self) -> int:
        return self.names.nbytes + self.begins.nbytes + self.counts.nbytes + self.flat.nbytes

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each of ``names`` is known, and its place."""
        if not len(self):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.names[:, 0], names[:, 0]), len(self) - 1)
        return (self.names[at] == names).all(1), at

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.flat[ranges(self.begins[at], self.counts[at])], self.counts[at]

    def plus(self, names: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> Known:
        """With further units, sorted or not."""
        begins = len(self.flat) + np.cumsum(counts, dtype=np.int64) - counts
        names = np.concatenate([self.names, names])
        order = np.argsort(names[:, 0], kind="stable")
        return Known(names[order], np.concatenate([self.begins, begins])[order], np.concatenate([self.counts, counts.astype(np.int32)])[order], np.concatenate([self.flat, flat]))


class Memory:
    """The ids of units (each follows a space), remembered."""

    def __init__(self, encode):
        self.encode, self.recent, self.young, self.old = encode, Known(), Known(), Known()

    def get(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units, one after the other, and how many each has."""
        names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(u) for u in units]), np.uint64).reshape(-1, 2)
        order = np.argsort(names[:, 0])
        left, parts = order, []  # parts: places, ids, counts
        for known in (self.young, self.recent, self.old):
            hit, at = known.find(names[left])
            found = known.ids(at[hit])
            parts.append((left[hit], *found))
            left = left[~hit]
        if len(left):
            parts.append((left, *self.encode([units[i] for i in left])))
        self._keep(names, parts[2:])
        places, ids, counts = (np.concatenate(x) for x in zip(*parts))
        begins, n = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        begins[places], n[places] = np.cumsum(counts, dtype=np.int64) - counts, counts
        return ids[ranges(begins, n)], n

    def _keep(self, names, parts) -> None:
        places, ids, counts = (np.concatenate(x) for x in zip(*parts))
        if len(places):
            self.recent = self.recent.plus(names[places], counts, ids)
        if len(self.recent) > RECENT:
            r, self.recent = self.recent, Known()
            flat, counts = r.ids(np.arange(len(r)))
            self.young = self.young.plus(r.names, counts, flat)
            if self.young.size() > GENERATION:
                self.old, self.young = self.young, Known()


class Encoder:
    """Ids of texts, as unsigned 32-bit integers.

    ``apart`` encodes each of a list of strings by itself (a list of bytes); ``together`` encodes a string and
    returns its ids with the places where a new word begins.
    """

    def __init__(self, tokenizer, apart, together):
        self.apart, self.together = apart, together
        added = sorted((t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items())
        self.special = {s: np.uint32(i).tobytes() for s, i in added}
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.memory = Memory(self._units)

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units that each follow a space, one after the other, and how many each has."""
        odd = [i for i, u in enumerate(units) if " " in u or not u or u[-1].isspace()]
        rest = units
        if odd:
            even = np.ones(len(units), bool)
            even[odd] = False
            rest = [units[i] for i in np.flatnonzero(even)]
        ids, starts = self.together(" " + " ".join(rest)) if rest else (np.empty(0, np.uint32), [])
        counts = np.diff(np.r_[starts, len(ids)]).astype(np.int64)
        if len(counts) != len(rest):
            raise ValueError("the tokenizer's tokens do not begin anew at a space")
        if odd:
            alone = self.apart([" " + units[i] for i in odd])
            places = np.concatenate([np.flatnonzero(even), odd])
            counts = np.concatenate([counts, [len(x) // 4 for x in alone]]).astype(np.int64)
            ids = np.concatenate([ids, np.frombuffer(b"".join(alone), np.uint32)])
            begins, n = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
            begins[places], n[places] = np.cumsum(counts) - counts, counts
            ids, counts = ids[ranges(begins, n)], n
        return ids, counts

    def _with_special(self, text: str) -> bytes:
        segments = self.splitter.split(text)
        plain = iter(self.apart([s for s in segments[::2] if s]))
        return b"".join([self.special[s] if i % 2 else next(plain) for i, s in enumerate(segments) if s])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin, with the end."""
        even, uneven, whole = [], [], []
        for i, t in enumerate(texts):
            if t:
                if self.splitter and any(s in t for s in self.special):
                    whole.append(i)
                else:
                    (even if simple(t) else uneven).append(i)
        cut = [pc.split_pattern(pa.array([texts[i] for i in even], pa.large_string()), " ")]
        cut.append(pa.array([CUT.split(texts[i]) for i in uneven], cut[0].type))
        flat = pa.concat_arrays([c.flatten() for c in cut]).dictionary_encode()
        counts = np.zeros(len(texts), np.int64)
        counts[even], counts[uneven] = (np.diff(c.offsets.to_numpy()) for c in cut)
        codes = flat.indices.to_numpy().astype(np.int64)
        order = np.array(even + uneven, np.int64)  # the texts, as their units lie in codes
        firsts = np.cumsum(counts[order]) - counts[order]
        later = np.ones(len(codes), bool)
        later[firsts] = False
        used = np.zeros(len(flat.dictionary), bool)
        used[codes[later]] = True
        used = np.flatnonzero(used)
        place = np.zeros(len(flat.dictionary), np.int64)
        place[used] = np.arange(len(used))
        codes[later] = place[codes[later]]
        ids, lengths = self.memory.get(flat.dictionary.take(pa.array(used)).to_pylist())
        # after the units: the first ones of the texts, which follow no space, and texts encoded as a whole
        codes[firsts] = len(lengths) + np.arange(len(order))
        more = self.apart([texts[i].split(" ", 1)[0] for i in even] + [CUT.split(texts[i], 1)[0] for i in uneven])
        codes = np.concatenate([codes, len(lengths) + len(more) + np.arange(len(whole))])
        more += [self._with_special(texts[i]) for i in whole]
        counts[whole] = 1
        lengths = np.concatenate([lengths, np.fromiter(map(len, more), np.int64, len(more)) // 4])
        ids = np.concatenate([ids, np.frombuffer(b"".join(more), np.uint32)])
        # the units of each text, in the order of the texts
        order = np.concatenate([order, np.array(whole, np.int64)])
        begins = np.zeros(len(texts), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        units = codes[ranges(begins, counts)]
        at = np.cumsum(lengths) - lengths
        ends = np.r_[0, np.cumsum(lengths[units])]
        return ids[ranges(at[units], lengths[units])], ends[np.r_[0, np.cumsum(counts)]]


def ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begins`` on, as many as ``counts`` says, one after the other."""
    return np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def library_encoder(path: str) -> Encoder:
    """Units are encoded by the tokenizers library."""
    t = load(path)
    leads = np.zeros(max(t.get_vocab().values()) + 1, bool)
    leads[[i for s, i in t.get_vocab().items() if s.startswith(NEW_WORD)]] = True

    def apart(strings: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, np.uint32).tobytes() for e in t.encode_batch_fast(strings, add_special_tokens=False)]

    def together(string: str):
        ids = np.asarray(t.encode_batch_fast([string], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.flatnonzero(leads[ids])

    return Encoder(t, apart, together)
