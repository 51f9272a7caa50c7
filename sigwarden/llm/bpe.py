"""BPE encoding and decoding by tree concatenation.

A text is halved until its pieces are at most LEAF bytes. All pieces of a batch are encoded together.
Then halves are joined: a window around the join is encoded anew and grown until it gives exactly
what the left side has at its start and what the right side has at its end; between these, the
window's tokens hold.

How pieces are encoded follows from the tokenizer's file (``kind_of``), and a file of another kind is refused:

- ``bytes`` (no normaliser, byte-level pre-tokenizer): the pieces are token lists. Joins work on tokens: adjoining
  tokens of the result were adjoining in a window or in a side that agrees with it over AGREE tokens, and a window
  that never agrees grows to the whole text.
- ``words`` (lower case, splits at white space and drops it): the pieces are lists of chunks, runs without ASCII white
  space. A chunk's tokens depend on the chunk alone, so a leaf's chunks are looked up in a cache of encoded chunks. A join
  within a chunk works on chunks while the joined chunk is short; in unsplit text (a chunk over UNSPLIT bytes)
  it works on tokens as above.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .chunks import encoded_together
from .runtime import arrow_map, as_bytes, slices

LEAF, UNSPLIT, AGREE, WINDOW = 4096, 1024, 4, 16
#: Chunks that a worker remembers, of at most UNSPLIT bytes each.
REMEMBERED = 200_000
_POINTS = frozenset(b".,")
#: A text with one of these bytes is left to the normaliser, which composes before it lower-cases. Doing A-Z first changes no token otherwise: a special
#: token must not be made (``<``), and a small letter may have a composed form with a mark of U+0300-U+037F (lead bytes CC and CD) where the capital has none.
_AS_IT_IS = (b"<", b"\xcc", b"\xcd")
_SPACE = frozenset(b" \t\n\r\x0b\x0c")


#: Fixed value: the pattern of words by which a tokenizer of the kind ``words`` splits. No alternative matches white
#: space, and a full stop or comma after a letter starts a match of its own.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def kind_of(path: str) -> str:
    """``words`` or ``bytes``, read from the file's normaliser, pre-tokenizer and model; any other file is an error."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, normalizer, pre = file["model"], file["normalizer"], file["pre_tokenizer"] or {}
    added = file.get("added_tokens") or []
    # Special tokens are found in the text as it stands, and (in words) only in chunks with "<".
    exact = all(not any(t.get(x) for x in ("single_word", "lstrip", "rstrip", "normalized")) and not set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in added)
    plain = exact and model["type"] == "BPE" and not model.get("dropout") and not model.get("fuse_unk") and not model.get("ignore_merges") and file["post_processor"] is None
    steps = [n["type"] for n in (normalizer or {}).get("normalizers", [])]
    split, *rest = pre.get("pretokenizers", [{}])
    space = [n for n in (normalizer or {}).get("normalizers", []) if n["type"] == "Replace"]
    if (
        plain and all("<" in t["content"] for t in added) and steps == ["NFC", "Replace", "Lowercase"] and space[0]["pattern"] == {"Regex": r"\s+"} and space[0]["content"] == " "
        and split.get("type") == "Split" and split["pattern"] == {"Regex": WORD_PATTERN} and split["behavior"] == "Removed" and split["invert"]
        and [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)] and model.get("end_of_word_suffix")
    ):
        return "words"
    if plain and normalizer is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"):
        return "bytes"
    raise ValueError(f"tree concatenation is not known to be exact for the tokenizer in {path}")


class Tokens:
    """Tokens of unsplit text with their character spans."""

    __slots__ = ("text", "ids", "starts", "ends")

    def __init__(self, text: str, ids: list[int], starts: list[int], ends: list[int]):
        self.text, self.ids, self.starts, self.ends = text, ids, starts, ends


def _normal_length(chunk: bytes) -> int:
    """Bytes of a chunk that is composed and in lower case."""
    return len(chunk) if chunk.isascii() else len(unicodedata.normalize("NFC", chunk.decode()).lower().encode())


def _packed(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers in one string: small to remember, and joined without touching single ids."""
    return array("i", ids).tobytes()


class Codec:
    def __init__(self, path: str, leaf: int = LEAF, unsplit: int = UNSPLIT):
        self.kind = kind_of(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.unsplit = leaf, unsplit
        self.known: dict[bytes, bytes] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        self.sizes = np.array([len(t.removesuffix(suffix)) for t, _ in sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])], np.int64)
        self.strings = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()} if self.tokenizer.decoder is None else None

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        return [np.frombuffer(p, np.int32).tolist() for p in self.encode_packed(texts)]

    def encode_packed(self, texts: list[bytes]) -> list[bytes]:
        if self.kind == "bytes":
            return self._encode_unsplit([t.decode() for t in texts])
        texts = [t if any(x in t for x in _AS_IT_IS) else t.lower() for t in texts]
        seen: set[bytes] = set()
        trees = [self._halved(t, 0, len(t), seen) for t in texts]
        self._remember(seen)
        return [self._ids(self._joined(t, tree)[0]) for t, tree in zip(texts, trees)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Without a decoder in its file, a tokenizer decodes to its tokens joined by a space."""
        if self.strings is not None:
            return [" ".join(map(self.strings.__getitem__, x)) for x in ids]
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def _encode_unsplit(self, texts: list[str]) -> list[bytes]:
        """All leaves of all texts are encoded together, then joined by halves, for each text from the leaves up."""
        spans = [[(at, min(at + self.leaf, len(t))) for at in range(0, max(len(t), 1), self.leaf)] for t in texts]
        leaves = [t[lo:hi] for t, own in zip(texts, spans) for lo, hi in own]
        encoded = iter(self.tokenizer.encode_batch(leaves, add_special_tokens=False))
        out = []
        for t, own in zip(texts, spans):
            level = []
            for lo, hi in own:
                e = next(encoded)
                level.append(Tokens(t[lo:hi], e.ids, [s for s, _ in e.offsets], [x for _, x in e.offsets]))
            while len(level) > 1:
                level = [self._spliced(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            out.append(_packed(level[0].ids))
        return out

    # A tree is a leaf (lo, hi, chunks) or (lo, hi, left, right).

    def _halved(self, text: bytes, lo: int, hi: int, seen: set[bytes]) -> tuple:
        mid = (lo + hi) // 2
        while mid < hi and text[mid] & 0xC0 == 0x80:
            mid += 1
        if hi - lo <= self.leaf or mid >= hi:
            chunks = text[lo:hi].split()
            seen.update(chunks)
            return (lo, hi, chunks)
        return (lo, hi, self._halved(text, lo, mid, seen), self._halved(text, mid, hi, seen))

    def _remember(self, chunks: set[bytes]) -> None:
        """Encodes the chunks that aren't known, all together.

        A full stop or comma after a letter is a token of its own, so a chunk that ends in one shares its stem's
        ids; a chunk with ``<`` may hold a special token and is left as it is.
        """
        known, unsplit = self.known, self.unsplit
        if len(known) > REMEMBERED:
            known.clear()
        new, ends = set(), []
        for c in chunks.difference(known):
            if len(c) <= unsplit:
                if c[-1] in _POINTS and c[-2:-1].isalpha() and b"<" not in c:
                    ends.append(c)
                    new.add(c[:-1])
                    new.add(c[-1:])
                else:
                    new.add(c)
        # Chunks are encoded many in one text, with a space between them, which is dropped; a chunk's tokens have the bytes of its normal form.
        todo = list(new.difference(known))
        encode = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for c, ids in zip(todo, encoded_together(todo, encode, self.sizes, lambda c: b"<" not in c, b" ", _normal_length)):
            known[c] = ids.astype(np.int32).tobytes()
        for c in ends:
            known[c] = known[c[:-1]] + known[c[-1:]]

    def _of(self, chunk: bytes | Tokens) -> bytes:
        if isinstance(chunk, Tokens):
            return _packed(chunk.ids)
        if (ids := self.known.get(chunk)) is None:
            ids = self._direct(chunk.decode())
            if len(chunk) <= self.unsplit:
                self.known[chunk] = ids
        return ids

    def _direct(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _ids(self, chunks: list[bytes | Tokens]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            return b"".join(map(self._of, chunks))

    def _joined(self, text: bytes, tree: tuple) -> tuple[list, bool, bool]:
        """The chunks of a tree, and whether its first and last chunk may go on beyond it."""
        lo, hi = tree[:2]
        if len(tree) == 3:
            return tree[2], hi > lo and text[lo] not in _SPACE, hi > lo and text[hi - 1] not in _SPACE
        left, start, left_open = self._joined(text, tree[2])
        right, right_open, end = self._joined(text, tree[3])
        return self._concatenated(left, right, left_open and right_open), start, end

    def _concatenated(self, left: list, right: list, within: bool) -> list:
        if not left or not right:
            return left + right
        if within:
            a, b = left[-1], right[0]
            if self._length(a) + self._length(b) > self.unsplit:
                return [*left[:-1], self._spliced(self._tokens(a), self._tokens(b)), *right[1:]]
            middle = [self._bytes(a) + self._bytes(b)]
        else:
            middle = [left[-1], right[0]]
        wide = 1
        while True:
            # Around what meets at the join, a growing number of chunks on both sides must come out as they are.
            before, after = left[-1 - wide : -1], right[1 : 1 + wide]
            window = self._direct(b" ".join(self._bytes(c) for c in [*before, *middle, *after]).decode())
            head, tail = self._ids(before), self._ids(after)
            inner = window[len(head) : len(window) - len(tail)]
            if window[: len(head)] == head and window[len(window) - len(tail) :] == tail and len(head) + len(tail) <= len(window):
                if within:
                    if len(middle[0]) <= self.unsplit:
                        self.known[middle[0]] = inner
                    return [*left[:-1], *middle, *right[1:]]
                if inner == self._of(middle[0]) + self._of(middle[1]):
                    return left + right
            if len(before) == len(left) - 1 and len(after) == len(right) - 1:
                return [Tokens(self._bytes(b" ".join(map(self._bytes, [*left[:-1], *middle, *right[1:]]))).decode(), np.frombuffer(window, np.int32).tolist(), [], [])]
            wide *= 2

    def _length(self, chunk: bytes | Tokens) -> int:
        return len(chunk.text.encode()) if isinstance(chunk, Tokens) else len(chunk)

    def _bytes(self, chunk: bytes | Tokens) -> bytes:
        return chunk.text.encode() if isinstance(chunk, Tokens) else chunk

    def _tokens(self, chunk: bytes | Tokens | str) -> Tokens:
        if isinstance(chunk, Tokens):
            return chunk
        text = chunk if isinstance(chunk, str) else chunk.decode()
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return Tokens(text, e.ids, [s for s, _ in e.offsets], [t for _, t in e.offsets])

    def _spliced(self, left: Tokens, right: Tokens) -> Tokens:
        text, shift, wide = left.text + right.text, len(left.text), WINDOW
        if self.kind == "words" and not text.isascii() and any(map(unicodedata.combining, text)):
            return self._tokens(text)  # the normaliser puts marks in order over any distance, so no window is sure to agree
        n, m = len(left.ids), len(right.ids)
        while True:
            i, j = max(0, n - wide), min(m, wide)
            while 0 < i < n and left.ends[i - 1] > left.starts[i]:
                i -= 1
            while 0 < j < m and right.ends[j - 1] > right.starts[j]:
                j += 1
            if i == 0 and j == m:
                return self._tokens(text)
            lo, hi = (left.starts[i] if i else 0), (shift + right.ends[j - 1] if j < m else len(text))
            win = self._tokens(text[lo:hi])
            # k: tokens of the left side in the result; p: first token of the right side in it.
            k = 0 if i == 0 else i + AGREE if self._same(left, i, win, 0, lo) else -1
            if k >= 0 and (k or i == 0):
                first = k - i if i else 0
                if j == m:
                    return self._assembled(text, left, k, win, first, len(win.ids), lo, right, m, shift)
                at = {s + lo - shift: q for q, s in reversed(list(enumerate(win.starts)))}
                for p in range(j - AGREE):
                    q = at.get(right.starts[p], -1)
                    if q >= first and (p == 0 or right.ends[p - 1] <= right.starts[p]) and self._same(right, p, win, q, lo - shift):
                        return self._assembled(text, left, k, win, first, q, lo, right, p, shift)
            wide *= 2

    def _same(self, side: Tokens, i: int, win: Tokens, q: int, lo: int) -> bool:
        """Whether AGREE tokens of ``side`` from i on are those of the window from q on; positions in the window are
        ``lo`` less than those of the side."""
        if i + AGREE > len(side.ids) or q + AGREE > len(win.ids):
            return False
        return all(side.ids[i + x] == win.ids[q + x] and side.starts[i + x] == win.starts[q + x] + lo and side.ends[i + x] == win.ends[q + x] + lo for x in range(AGREE))

    def _assembled(self, text: str, left: Tokens, k: int, win: Tokens, first: int, last: int, lo: int, right: Tokens, p: int, shift: int) -> Tokens:
        return Tokens(
            text,
            left.ids[:k] + win.ids[first:last] + right.ids[p:],
            left.starts[:k] + [s + lo for s in win.starts[first:last]] + [s + shift for s in right.starts[p:]],
            left.ends[:k] + [s + lo for s in win.ends[first:last]] + [s + shift for s in right.ends[p:]],
        )


_CODECS: dict[tuple, Codec] = {}


def _codec(path: str, leaf: int, unsplit: int) -> Codec:
    """One codec for each Python worker."""
    if (path, leaf, unsplit) not in _CODECS:
        _CODECS[path, leaf, unsplit] = Codec(path, leaf, unsplit)
    return _CODECS[path, leaf, unsplit]


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text", leaf: int = LEAF, unsplit: int = UNSPLIT) -> DataFrame:
    """``docs`` without the text, with ``ids`` (array of int) and ``decoded`` (the text that the ids decode to).

    ``path`` names the tokenizer file, which every executor reads. A map over the rows: nothing is shuffled
    and a worker holds a few hundred texts at a time. A null or empty text has no ids and decodes to an
    empty text. Columns named ids or decoded are replaced; repeated rows are encoded each.
    """
    docs = docs.drop("ids", "decoded")
    keep = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, leaf, unsplit)
        for batch in slices(batches, 256):
            packed = codec.encode_packed([x or b"" for x in as_bytes(batch.column(len(keep)))])
            starts = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            decoded = pa.array(codec.decode([np.frombuffer(p, np.int32).tolist() for p in packed]), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids, decoded], names=schema.names)

    return arrow_map(docs.select(*keep, text_col), run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; null ids decode to an empty text."""
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, LEAF, UNSPLIT)
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codec.decode([x or [] for x in batch.column(at).to_pylist()]), pa.string())], names=schema.names)

    return arrow_map(encoded, run, schema)
