"""Token ids of whole texts, a batch of them at a time; each distinct unit of a batch is encoded once."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with white space in runs, at the end, or other than blank and line feed, are cut with more care, as are those
#: with characters that some pattern may also take for white space.
_ODD_CHARS = "\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿"
_CAREFUL = rf"[\t\r\x0b\x0c]|[ \n][ \n]|[ \n]\z|[{_ODD_CHARS}]"
_ODD = re.compile(f"[{_ODD_CHARS}]")
_UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Of all but these characters every version of Unicode knows the class, and none composes with another; units with others go through the library.
_UNKNOWN = "[^\x00-ɏΑ-ΡΤ-ωЀ-џ–-…€]"
#: How the two kinds of vocabulary files normalize and part a text before they merge. Files that say otherwise are left to the library.
_KEEPS_BLANKS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
_DROPS_BLANKS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: The same for units of known characters alone: of these, numbers, white space, letters and the rest.
_N, _S = "0-9²³¹¼½¾", " \t-\r\x85\xa0"
_L, _REST = rf"[^\W_{_N}]+", rf"(?:_|[^\w{_S}])+"
_PARTS_WITH_BLANKS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}| ?[{_N}]+| ?{_REST}|[{_S}]+(?![^{_S}])|[{_S}]+")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_L}|[{_N}]|{_REST}|\x0b")
#: Stands between units; none that are encoded together hold it.
_BETWEEN = "\x0b"
_ALONE = re.compile(f"{_UNKNOWN}|{_BETWEEN}")
#: Parts kept by a worker, about 30 MB; when there are more it starts anew.
KEPT = 200_000
#: Bytes of text encoded together.
TOGETHER = 3 << 20
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, int]:
    """The usual letters for bytes: visible ones stand for themselves, the others follow from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: b for b in visible} | {b: 256 + k for k, b in enumerate(others)}


_LETTERS = _byte_letters()


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class Encoder:
    """Encodes as Tokenizer.encode(text, add_special_tokens=False) does, strings of added tokens in the text included.

    No token runs from other text into white space, so a text falls there into units that encode alone. Where the
    tokenizer drops white space and case a unit is a word, else a word with the blank or line feed before it. The
    distinct units of a batch are parted in one go, and the tokenizer's model merges each new part. Texts with an added
    token's string, units with characters of doubtful class, and all texts of a file that parts otherwise go through
    the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.parts = self.tokenizer.model, {}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        own = {k: told[k] for k in ("normalizer", "pre_tokenizer")}
        self.known, self.drops_space = own in (_KEEPS_BLANKS, _DROPS_BLANKS), own == _DROPS_BLANKS
        added = [t for t in told["added_tokens"] or []]
        self.known &= not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in added)
        self.added = "|".join(re.escape(t["content"]) for t in added)

    def plain(self, text: str) -> np.ndarray:
        """The ids by the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _merged(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many to each) of parts."""
        kept = self.parts
        if len(kept) > KEPT:
            kept.clear()
        own = parts.to_pylist()
        new = [p for p in own if p not in kept and p != _BETWEEN]
        letters = _BETWEEN.join(new).encode().decode("latin-1").translate(_LETTERS).split(chr(_LETTERS[ord(_BETWEEN)])) if new else []
        merge = self.model.tokenize
        kept.update(zip(new, [array("I", [t.id for t in merge(x)]).tobytes() for x in letters]))
        made = [kept.get(p, b"") for p in own]
        return np.frombuffer(b"".join(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made)) // 4

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many to each) of units, none of which holds _BETWEEN."""
        unknown = pc.match_substring_regex(units, _UNKNOWN)
        odd, usual = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (unknown, pc.and_not(pc.not_equal(units, ""), unknown)))
        sizes, pools, starts = np.zeros(len(units), np.int64), [], np.zeros(len(units), np.int64)
        if len(usual):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(usual)], pa.int32()), units.take(pa.array(usual))), _BETWEEN)[0].as_py()
            parts = pa.array(_PARTS.findall(joined.lower()) if self.drops_space else _PARTS_WITH_BLANKS.findall(joined)).dictionary_encode()
            ids, lengths = self._merged(parts.dictionary)
            at = parts.indices.to_numpy()
            between = pc.equal(parts.dictionary, _BETWEEN).to_numpy(zero_copy_only=False)[at]
            firsts, at = (np.cumsum(lengths) - lengths)[at[~between]], at[~between]
            pools.append(ids[_runs(firsts, lengths[at])])
            sizes[usual] = np.bincount(np.cumsum(between)[~between], lengths[at], len(usual)).astype(np.int64)
            starts[usual] = np.cumsum(sizes[usual]) - sizes[usual]
        size = len(pools[0]) if pools else 0
        for k in odd.tolist():
            pools.append(self.plain(units[k].as_py()))
            starts[k], sizes[k] = size, len(pools[-1])
            size += len(pools[-1])
        ids = np.concatenate(pools) if pools else np.empty(0, np.uint32)
        return ids[_runs(starts, sizes)], sizes

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct units, the unit at each place, where each text's places begin, and their end) of texts that need no care."""
        if self.drops_space:
            pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            coded = pieces.flatten().dictionary_encode()
            return coded.dictionary, coded.indices.to_numpy(), _offsets(pieces)
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets, flat = _offsets(pieces), pieces.flatten()
        coded = flat.dictionary_encode()
        behind = pc.if_else(pc.match_substring_regex(coded.dictionary, r"^(\n|\z)"), coded.dictionary, pc.binary_join_element_wise(" ", coded.dictionary, ""))
        first = flat.take(pa.array(offsets[:-1])).dictionary_encode()
        at = coded.indices.to_numpy().copy()
        at[offsets[:-1]] = first.indices.to_numpy() + len(coded.dictionary)
        return pa.concat_arrays([behind, first.dictionary]), at, offsets

    def _careful(self, text: str) -> np.ndarray:
        """The ids of a text with white space in runs or of other kinds."""
        if _ODD.search(text):
            return self.plain(text)
        out = []
        for unit in _UNITS.findall(text):
            if _ALONE.search(unit):
                out.append(self.plain(unit))
            else:
                out.append(self._merged(pa.array(_PARTS_WITH_BLANKS.findall(unit)))[0])
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        none = pa.array(np.zeros(len(texts), bool))
        whole = (pc.match_substring_regex(texts, self.added) if self.added else none) if self.known else pa.array(np.ones(len(texts), bool))
        careful = none if self.drops_space or not self.known else pc.and_not(pc.match_substring_regex(texts, _CAREFUL), whole)
        alone = pc.or_(whole, careful)
        plain, careful, alone = (x.to_numpy(zero_copy_only=False) for x in (whole, careful, alone))
        sizes, pools, starts, size = np.zeros(len(texts), np.int64), [], np.zeros(len(texts), np.int64), 0
        rest = np.flatnonzero(~alone)
        if len(rest):
            units, at, offsets = self._cut(texts.take(pa.array(rest)))
            ids, lengths = self._units(units)
            ends = np.append(0, np.cumsum(lengths[at]))[offsets]
            pools.append(ids[_runs((np.cumsum(lengths) - lengths)[at], lengths[at])])
            sizes[rest], starts[rest], size = np.diff(ends), ends[:-1], int(ends[-1])
        for k in np.flatnonzero(alone).tolist():
            own = (self.plain if plain[k] else self._careful)(texts[k].as_py())
            pools.append(own)
            starts[k], sizes[k], size = size, len(own), size + len(own)
        ids = np.concatenate(pools) if pools else np.empty(0, np.uint32)
        return (ids[_runs(starts, sizes)] if alone.any() else ids), sizes

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many to each) of texts without nulls, some MB of them at a time; ids are unsigned 32-bit integers."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
        ends = [*(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)] if len(texts) else []
        for a, b in zip([0, *ends], ends):
            yield self._together(texts.slice(a, b - a))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return self._together(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


def _offsets(lists: pa.ListArray) -> np.ndarray:
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0]


def id_type(path: str, end_id: int) -> str:
    """The type that holds all ids of a file, those of added tokens too, and the end id: 16 bits if they fit, else 32."""
    from tokenizers import Tokenizer

    largest = max([end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()])
    return "<u2" if largest < 1 << 16 else "<u4"


def ends_after(ids: np.ndarray, sizes: np.ndarray, end_id: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """ids with the end id after each text, and the sizes with it; an id that the type doesn't hold is an error."""
    if max(int(ids.max(initial=0)), end_id) > np.iinfo(dtype).max:
        raise ValueError(f"id {max(int(ids.max(initial=0)), end_id)} doesn't fit {dtype}")
    sizes = sizes + 1
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own], out[ends - 1] = ids, end_id
    return out, sizes


def as_binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The ids of each text as a binary value; ids hold under 2 GB."""
    ends = np.append(0, np.cumsum(sizes) * ids.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.tobytes())])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
