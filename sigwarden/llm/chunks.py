"""Texts cut into chunks that a tokenizer encodes each on its own, so that only different chunks are encoded.

Cuts are made where a byte-level BPE with the usual pattern of words (``'s|'t|..| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``)
always ends a match, whatever stands around:

- before a space that is followed by a byte that begins no white space (the match begins with that space),
- before a line feed after a printable ASCII byte or a letter of U+00C0-U+00FF, and after it if one of the bytes of SAFE follows,
- with ``fine`` also between such a letter and a full stop or comma.

Where none of these holds (runs of white space, other white space, control characters) a chunk just becomes longer. The
cuts are found on the bytes of a whole Arrow column, and chunks that are equal are encoded once for each worker.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

#: Bytes that begin no white space: printable ASCII, and lead bytes whose characters hold none.
SAFE = np.zeros(256, bool)
SAFE[0x21:0x7F] = SAFE[0xC3:0xE1] = SAFE[0xE4:0xF5] = True
_PRINT = np.zeros(256, bool)
_PRINT[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LATIN = np.zeros(256, bool)  # second bytes after C3
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_POINT = np.zeros(256, bool)
_POINT[[0x2C, 0x2E, 0x0A]] = True


#: Bytes whose cuts are found at once; a cut depends on at most three bytes before it and one after.
CUT_BYTES = 8 << 20


def cut_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fine: bool, lone_spaces: bool = True) -> np.ndarray:
    """Where chunks begin in ``data``, which holds texts from ``starts`` to ``ends``; an empty text has none. Without
    ``lone_spaces`` no cut is made between two spaces."""
    n = len(data)
    at = np.zeros(n, bool)
    for lo in range(0, n, CUT_BYTES):
        hi, before = min(n, lo + CUT_BYTES), max(0, lo - 3)
        at[lo:hi] = _cuts(data[before : min(n, hi + 1)], fine, lone_spaces)[lo - before : hi - before]
    at[ends[ends > starts] - 1] = False  # what follows the last byte of a text is another text
    at[starts[ends > starts]] = True
    return np.flatnonzero(at)


def _cuts(data: np.ndarray, fine: bool, lone_spaces: bool) -> np.ndarray:
    at = np.zeros(len(data), bool)
    if len(data) > 1:
        before, here = data[:-1], data[1:]
        at[:-1] = (before == 0x20) & SAFE[here]
        if not lone_spaces:
            at[1:] &= before != 0x20
        letter = _LETTER[before]
        letter[1:] |= _LATIN[before[1:]] & (data[:-2] == 0xC3)
        feed = (here == 0x0A) & (letter | _PRINT[before])
        at[1:] |= feed
        at[2:] |= feed[:-1] & SAFE[data[2:]]
        if fine:
            at[1:] |= letter & _POINT[here]
    return at


class Cut:
    """The chunks of an Arrow column of texts: ``values`` (the different ones), ``index`` (which one each chunk is) and
    ``offsets`` (chunk number at which each text begins, and the end)."""

    def __init__(self, column: pa.Array, fine: bool, lone_spaces: bool = True):
        column = column.cast(pa.large_binary())
        column = column.fill_null(b"") if column.null_count else column
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2] if len(column) else None
        data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[ends[0] : ends[-1]]
        ends = ends - ends[0]
        points = cut_points(data, ends[:-1], ends[1:], fine, lone_spaces)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(points), [None, pa.py_buffer(np.append(points, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        self.values: list[bytes] = coded.dictionary.to_pylist()
        self.index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets = np.searchsorted(points, ends).astype(np.int64)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``index`` names, one after the other, and where each begins (and the end)."""
    own = lengths[index]
    ends = np.concatenate(([0], np.cumsum(own))).astype(np.int64)
    return flat[np.repeat(starts[index] - ends[:-1], own) + np.arange(ends[-1])], ends


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


#: Different chunks that a worker remembers in each of two generations, and the longest one that it does.
REMEMBERED, REMEMBERED_BYTES = 300_000, 64
#: Chunks that are encoded as one text.
TOGETHER = 500


class Remembered:
    """``of(chunk)`` for many chunks, computed together for those that are not remembered. What was not asked for since the last
    change of generation is forgotten at the next one."""

    def __init__(self, compute, most: int = REMEMBERED):
        self.compute, self.most, self.known, self.older = compute, most, {}, {}

    def __call__(self, chunks: list[bytes]) -> list:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, chunks))
        new = []
        for i in [i for i, x in enumerate(found) if x is None]:
            if (x := older.get(chunks[i])) is None:
                new.append(i)
            else:
                found[i] = known[chunks[i]] = x
        for i, x in zip(new, self.compute([chunks[i] for i in new])) if new else ():
            found[i] = x
            if len(chunks[i]) <= REMEMBERED_BYTES:
                known[chunks[i]] = x
        return found


def encoded_together(chunks: list[bytes], encode, sizes: np.ndarray, whole, between: bytes = b"", length=len) -> list[np.ndarray]:
    """The ids of each chunk. Those for which ``whole`` holds are joined, with ``between`` between them, to texts of TOGETHER chunks, as cuts
    between them are exact, and told apart by the bytes of their tokens (``sizes``; ``length`` gives those of a chunk). ``encode`` takes a list of texts and
    gives a list of id lists."""
    out: list[np.ndarray | None] = [None] * len(chunks)
    joined = [i for i, c in enumerate(chunks) if whole(c)]
    groups = [joined[k : k + TOGETHER] for k in range(0, len(joined), TOGETHER)]
    for own, ids in zip(groups, encode([between.join([chunks[i] for i in own]).decode("utf-8", "replace") for own in groups]) if groups else ()):
        ids = np.asarray(ids, np.int64)
        ends, bounds = np.cumsum(sizes[ids]), np.cumsum([length(chunks[i]) for i in own])
        last = np.searchsorted(ends, bounds)
        if len(ends) and ends[-1] == bounds[-1] and (ends[last] == bounds).all():  # else one of them has other bytes, and each is encoded on its own
            at = 0
            for i, to in zip(own, (last + 1).tolist()):
                out[i] = ids[at:to]
                at = to
    alone = [i for i, x in enumerate(out) if x is None]
    for i, ids in zip(alone, encode([chunks[i].decode("utf-8", "replace") for i in alone]) if alone else ()):
        out[i] = np.asarray(ids, np.int64)
    return out


def leads(chunk: bytes) -> bool:
    """Whether a cut before the chunk is exact for a byte-level BPE whatever stands before it."""
    return len(chunk) > 1 and chunk[0] == 0x20 and bool(SAFE[chunk[1]])


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 ones stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; a special token's are its text."""
    alphabet, vocabulary = byte_alphabet(), tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return out


def is_byte_level(path: str) -> bool:
    """Whether the tokenizer's file is a byte-level BPE with the usual pattern, for which the cuts are exact: no normaliser, no
    prefix, and special tokens that hold neither white space nor a place where a cut is made."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, pre = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "fuse_unk", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    added = all(not any(t[x] for x in ("single_word", "lstrip", "rstrip", "normalized")) and not set(t["content"]) & set(" \n\t\r\x0b\x0c.,") and t["content"].isascii() for t in file.get("added_tokens") or [])
    return plain and added and file["normalizer"] is None and file["post_processor"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]


def byte_level(path: str, special_as_text: bool):
    """The tokenizers library's encoder of the file, for lists of chunks; a file for which cuts are not exact is refused."""
    from tokenizers import Tokenizer

    if not is_byte_level(path):
        raise ValueError(f"chunks are not known to be exact for the tokenizer in {path}")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer
