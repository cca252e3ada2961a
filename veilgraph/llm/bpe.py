"""BPE encoding and decoding in batched numpy merge rounds.

The distinct units of many texts are cut into pieces by the tokenizer's own
pre-tokenizer. The symbols of all pieces lie in one flat array. In every round the rank of each
pair of neighbours is found by binary search over the sorted pair keys, each
piece merges its lowest-ranked pair wherever it occurs, left to right, and pieces with nothing to merge
leave. Decoding joins the bytes of the tokens.

Defined results: null and empty texts have no ids and decode to the empty text;
special tokens in a text become their ids; ids that are no valid UTF-8 together
decode with replacement characters; repeated rows are each encoded; an empty
table gives an empty result; extra columns pass through (the columns added are ``vg_ids`` and ``vg_text``; a table that has
them already is refused).
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import let_go
from .units import NEW_WORD, Encoder, load

#: Texts are worked on together in slices of about so many bytes and at most so many rows; encoding gains from longer ones.
SLICE_BYTES, SLICE_ROWS, ENCODED_BYTES = 1 << 20, 4096, 4 << 20


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule: printable Latin-1 is itself."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """The merges of a tokenizer file, sorted by pair key."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        symbols = byte_symbols()
        self.start = np.zeros(max(map(ord, symbols)) + 1, np.int64)
        for c in symbols:
            self.start[ord(c)] = vocab[c]
        self.token_bytes = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}

    def encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece (in byte symbols), as bytes of unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        live = np.flatnonzero(lengths)
        if not len(live):
            return out
        sym = self.start[np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)]
        word = np.repeat(live, lengths[live])
        never = np.int64(len(self.keys))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[starts, len(sym)])
            key = np.full(len(sym), -1, np.int64)
            key[:-1] = np.where(word[:-1] == word[1:], sym[:-1] * self.size + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], never)
            least = np.minimum.reduceat(rank, starts)
            done = least == never
            if done.any():
                ids = sym.astype(np.uint32)
                for s, n in zip(starts[done], counts[done]):
                    out[word[s]] = ids[s : s + n].tobytes()
                keep = np.repeat(~done, counts)
                sym, word, at, rank, least, counts = sym[keep], word[keep], at[keep], rank[keep], least[~done], counts[~done]
                if not len(sym):
                    break
            chosen = np.flatnonzero(rank == np.repeat(least, counts))
            # Of pairs that overlap (equal symbols in a row) every other one merges.
            fresh = np.r_[True, np.diff(chosen) != 1]
            run = chosen[fresh][np.cumsum(fresh) - 1]
            chosen = chosen[(chosen - run) % 2 == 0]
            sym[chosen] = self.merged[at[chosen]]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            sym, word = sym[keep], word[keep]
        return out


class Codec:
    """Encodes and decodes with a tokenizer file."""

    def __init__(self, path: str):
        tokenizer = load(path)
        self.table = MergeTable(path)
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.encoder = Encoder(tokenizer, self._apart, self._together)
        self.bytes = dict(self.table.token_bytes)
        self.bytes |= {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        distinct = sorted(set(pieces))
        ids = dict(zip(distinct, self.table.encode(distinct)))
        return [ids[p] for p in pieces]

    def _apart(self, strings: list[str]) -> list[bytes]:
        cut = [[p for p, _ in self.split(s)] for s in strings]
        ids = iter(self._pieces([p for pieces in cut for p in pieces]))
        return [b"".join([next(ids) for _ in pieces]) for pieces in cut]

    def _together(self, string: str):
        pieces = [p for p, _ in self.split(string)]
        found = self._pieces(pieces)
        starts = np.cumsum([0, *[len(x) // 4 for x in found]]).tolist()
        return np.frombuffer(b"".join(found), np.uint32), [s for p, s in zip(pieces, starts) if p[0] == NEW_WORD]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin, with the end."""
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
        let_go()  # reading the file takes several times what is kept of it
    return _codecs[path]


def in_slices(batches, text: str, most=SLICE_BYTES):
    """(batch, texts) in slices of about ``most`` bytes and at most ``SLICE_ROWS``; longer texts are slices of their own."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        size = (pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length)(column).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        i = 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = min(max(int(np.searchsorted(ends, before + most, "right")), i + 1), i + SLICE_ROWS, batch.num_rows)
            part = batch.slice(i, j - i)
            yield part, part.column(at).to_pylist()
            i = j
    let_go()


def with_room(df: DataFrame, *added: str) -> list[str]:
    """The columns of ``df``; an error where one has the name of a column to be added."""
    if taken := {c.lower() for c in df.columns} & set(added):
        raise ValueError(f"the table has columns of the result's names: {sorted(taken)}")
    return df.columns


def encode(docs: DataFrame, path: str, text="text") -> DataFrame:
    """``docs`` with vg_ids, the ids as array<int>."""
    names = with_room(docs, "vg_ids")

    def run(batches):
        c = codec(path)
        for part, texts in in_slices(batches, text, ENCODED_BYTES // 8):
            ids, bounds = c.encode(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))], names=[*names, "vg_ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("vg_ids", T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, path: str, ids="vg_ids") -> DataFrame:
    """``tokens`` with vg_text, the text that the ids stand for."""
    names = with_room(tokens, "vg_text")

    def run(batches):
        c = codec(path)
        for part, lists in in_slices(batches, ids):
            texts = [c.decode(np.asarray(x or [], np.uint32)) for x in lists]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "vg_text"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("vg_text", T.StringType())]))


def op8(docs: DataFrame, path: str) -> DataFrame:
    def run(batches):
        c = codec(path)
        for part, texts in in_slices(batches, "text", ENCODED_BYTES // 2):
            ids, bounds = c.encode(texts)
            each = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            sha = [hashlib.sha256(x.tobytes()).hexdigest() for x in each]
            back = [hashlib.sha256(c.decode(x).encode("utf-8")).hexdigest() for x in each]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
