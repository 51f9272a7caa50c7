"""Packing, prefix trie and aligned tokenizers: brute force, the libraries, nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigwarden.llm import alignment, chunks, packing, queries, trie
from sigwarden.llm.chunks import Cut, byte_level, gathered, starts_of

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = public.path(queries.BYTE_TOKENIZER), public.path(queries.PIECE_TOKENIZER)
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

TEXTS = [None, "", " ", "  \n\t ", "One", "one two, three.", "one two, three.", "a  b\n\n c\n \nd", "x" * 5000, "word, " * 3000, "<|endoftext|> a <|endoftext|>", "▁ under", "é É é ×.÷, 漢字　   x", "</s><0x41>"]
ALPHABET = [*[" "] * 6, *["\n"] * 3, *"abcdezXYZ,.!?-0129'", "'s", "'ll", "é", "×", "÷", "\t", "\r", "\x0b", " ", "　", " ", "\x85", "\x1c", "漢", "<|endoftext|>", "́", "᠎", " ", "<0x41>", "the ", "\x00", "▁"]


def docs_of(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string" + extra)


def library(special_as_text):
    t = tokenizers.Tokenizer.from_file(A)
    t.encode_special_tokens = special_as_text
    return t


def test_chunks_are_exact_for_random_texts():
    rng, plain, special = random.Random(3), library(True), library(False)
    encode, aligned = packing._encoder(A), alignment._aligner(A, B)
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        own = texts[at : at + 500]
        cut = Cut(pa.array(own), fine=True)
        coded = encode(cut.values)
        lengths = np.array([len(x) // 4 for x in coded], np.int64)
        flat, ends = gathered(np.frombuffer(b"".join(coded), "<u4"), starts_of(lengths), lengths, cut.index)
        for t, lo, hi in zip(own, ends[cut.offsets], ends[cut.offsets][1:]):
            assert flat[lo:hi].tolist() == special.encode(t, add_special_tokens=False).ids, repr(t)
        cut = Cut(pa.array([" " + t if t else "" for t in own]), fine=False, lone_spaces=False)
        found = aligned(cut.values)
        for t, lo, hi in zip(own, cut.offsets, cut.offsets[1:]):
            got = [found[i] for i in cut.index[lo:hi]]
            want = aligned_by_force(t, plain, pieces)
            assert (False in got) == (want is None and t != ""), repr(t)
            if want is not None:
                assert ";".join(x[3] for x in got) == want[2] and sum(x[0] for x in got) == want[0] and sum(x[1] for x in got) == want[1], repr(t)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        byte_level(public.path("word_bpe_49k.json"), True)


# packing


def one_by_one(lengths, size):
    """Best-two-fit without counts: a list of documents, one sequence after the other."""
    left, loads = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], size
        k = 0
        while k < len(left):
            if left[k] <= gap:
                own.append(left.pop(k))
                gap -= own[-1]
            else:
                k += 1
        if len(own) > 1 and gap:
            best = max(((left[i] + left[j], left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if own[-1] < left[i] + left[j] <= gap + own[-1]), default=None)
            if best:
                left.append(own.pop())
                for x in best[1:]:
                    left.remove(x)
                    own.append(x)
                left.sort(reverse=True)
        loads.append(tuple(sorted(own)))
    return Counter(loads)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_two_fit_one_by_one(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 30, 64])
    lengths = [rng.choice([rng.randint(1, size), rng.randint(1, 9), size // 2, size // 3 + 1]) for _ in range(rng.choice([1, 40, 200]))]
    counts = Counter(lengths)
    plan = packing.best_two_fit(counts, size)
    loads, ends = {}, dict(counts)
    for x, rank, n, offset, sequence in reversed(plan):
        for r in range(rank, ends[x]):
            loads.setdefault(sequence + (r - rank) // n, []).append((offset + (r - rank) % n * x, x))
        ends[x] = rank
    assert not any(ends.values())
    for own in loads.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[x for _, x in own[:-1]]]).tolist() and sum(x for _, x in own) <= size
    assert Counter(tuple(sorted(x for _, x in own)) for own in loads.values()) == one_by_one(lengths, size)


def test_two_fit_beats_greedy_filling():
    # Greedy fills 6 + 3 and leaves 2 + 2 for another one; 6 + 2 + 2 is full.
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert {(x, s) for x, _, _, _, s in plan} == {(6, 0), (2, 0), (3, 1)}


def check_packing(rows, texts, size):
    tok, seen, places = library(False), {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(seen) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        own, at = sorted(seen[i], key=lambda r: r.piece), 0
        first = len(ids) % size or size
        assert [r.length for r in own] == [first, *[size] * ((len(ids) - first) // size)] and [r.piece for r in own] == list(range(len(own)))
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[x for _, x in own[:-1]]]).tolist() and sum(x for _, x in own) <= size
    return len(places)


def test_packing_edge_texts_and_sequences(spark):
    pieces = packing.token_pieces(docs_of(spark, TEXTS), A, 64)
    packed = packing.pack(pieces, 64).cache()
    n = check_packing(packed.withColumn("ids_crc32", F.crc32("ids")).collect(), TEXTS, 64)
    lengths = [r.length for r in packed.collect()]
    assert n == sum(one_by_one(lengths, 64).values()) and n <= -(-sum(lengths) // 64) + 1
    by_place = {(r.doc_id, r.piece): bytes(r.ids) for r in packed.collect()}
    for s in packing.sequences(packed).collect():
        assert bytes(s.ids) == b"".join(by_place[d.id, d.piece] for d in s.documents) and len(s.ids) <= 4 * 64


def test_packing_columns_empty_tables_and_bad_lengths(spark):
    docs = spark.createDataFrame([(None, "a b", 1, "x", 7)], "doc_id long, text string, length int, offset string, sequence_id int")
    out = packing.pack(packing.token_pieces(docs, A))
    assert sorted(out.columns) == ["doc_id", "ids", "length", "offset", "piece", "sequence_id", "start"] and out.count() == 1
    assert packing.pack(packing.token_pieces(docs.limit(0), A)).count() == 0
    kept = packing.pack(spark.createDataFrame([(3, "a"), (3, "b")], "length int, length_rank string"), 4)
    assert sorted(r.length_rank for r in kept.collect()) == ["a", "b"]
    for bad in (0, 5, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(bad,)], "length int"), 4)


@needs_tables
def test_op11_against_the_library(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rows = queries.op11_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, texts, queries.SEQUENCE_TOKENS)
    assert n == sum(one_by_one([r.length for r in rows], queries.SEQUENCE_TOKENS).values())


# prefix trie


def trie_by_force(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in turns.items()}
    rebuilt = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = set()
    for node, own_members in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len([w for w in x[-1][1].split(" ") if w]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in own_members if len(rebuilt[c]) == len(node)))
        out.add((min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), len(kids), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(spark, rows, schema="conv_id long, turn long, role string, text string"):
    turns, convs = trie.with_borrowed_heads(trie.numbered_turns(spark.createDataFrame(rows, schema)))
    return {tuple(r) for r in trie.prefix_trie(turns, convs).collect()}


def test_trie_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hi there", "a b  c"])) for c in [*range(0, 30), 45, 46, 47, 61] for t in range(rng.randint(1, 5))]
    rows += [(20, 0, "user", "same")] * 3 + [(7, None, None, None), (7, None, "user", ""), (8, 1, "user", "tie"), (8, 1, "user", "also"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", "hot") for c in range(100, 140) for t in range(20)] + [(63, 0, "a", "x")]
    want = trie_by_force(rows)
    assert trie_of(spark, rows) == want
    monkeypatch.setattr(trie, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("sigwarden.llm.runtime.BROADCAST_ROWS", 0)
    monkeypatch.setattr(trie, "PIECE_CHARS", 8)
    assert trie_of(spark, rows) == want


def test_trie_edges(spark):
    assert trie_of(spark, []) == set() and trie_of(spark, [(None, 1, "a", "b")]) == set()
    absent = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 > 0)  # its base is absent and its own turn is left out
    assert trie_of(spark, [(absent, 0, "a", "b")]) == {(absent, 0, None, 1, 0, 1, 0, hashlib.sha256(str(absent).encode()).hexdigest())}
    wide = [(c, t, "u", "w w", "x", 5) for c in (0, 1) for t in range(3)]
    got = trie_of(spark, wide, "conv_id long, turn long, role string, text string, pos string, node int")
    assert got == trie_by_force([r[:4] for r in wide])


def test_subtree_sums_of_a_long_path(spark):
    n = 300
    key = lambda i: i.to_bytes(4, "big")
    nodes = spark.createDataFrame([(key(i), key(i - 1) if i else None, 1) for i in range(n)], "node binary, parent binary, v long")
    assert {int.from_bytes(r.node, "big"): r.v for r in trie.subtree_sums(nodes, ["v"]).collect()} == {i: n - i for i in range(n)}


# alignment


def aligned_by_force(text, tok, pieces):
    """(A ids, B ids, groups, links), or None if there are no tokens."""
    if not text:
        return None
    spaced, alphabet = " " + text, chunks.byte_alphabet()
    a, b = tok.encode(spaced, add_special_tokens=False).ids, pieces.encode(text)
    raw_a = [bytes(alphabet[c] for c in tok.id_to_token(i)) for i in a]
    raw_b = [bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == spaced.encode() == b"".join(raw_b):
        return None
    at_a = {int(e): k for k, e in enumerate(np.cumsum([len(x) for x in raw_a]))}
    i, j, groups, links = 0, 0, [], []
    for q, e in enumerate(np.cumsum([len(x) for x in raw_b]).tolist()):
        if e in at_a:
            p = at_a[e]
            groups.append(",".join(map(str, a[i : p + 1])) + "|" + ",".join(map(str, b[j : q + 1])))
            links.append((a[p], b[q]))
            i, j = p + 1, q + 1
    return len(a), len(b), ";".join(groups), links


def counted_by_force(texts):
    tok, pieces = library(True), sentencepiece.SentencePieceProcessor(model_file=B)
    found = {i: aligned_by_force(t, tok, pieces) for i, t in texts.items()}
    counts = Counter(x for f in found.values() if f for x in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = set()
    for i, f in found.items():
        if f is None:
            rows.add((i, 0, 0, 0, 0, "", 0, 0))
        else:
            n = [counts[x] for x in f[3]]
            rows.add((i, f[0], f[1], len(n), len(n), hashlib.sha256(f[2].encode()).hexdigest(), sum(c == best[b] for c, (_, b) in zip(n, f[3])), sum(n)))
    return rows


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def test_alignment_of_edge_texts(spark, monkeypatch):
    want = counted_by_force(dict(enumerate(TEXTS)))
    assert {tuple(r) for r in alignment.align_and_count(docs_of(spark, TEXTS), A, B).select(*COLUMNS).collect()} == want
    groups = {r.doc_id: r.groups for r in alignment.align_and_count(docs_of(spark, TEXTS), A, B, digest=False).collect()}
    assert {hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups.values()} == {w[5] for w in want}
    # Few keys at a time and small shards, as for many more keys.
    monkeypatch.setattr(alignment, "HELD_KEYS", 8)
    monkeypatch.setattr(alignment, "SHARD_KEYS", 5)
    texts = TEXTS * 3
    got = alignment.align_and_count(docs_of(spark, texts).repartition(3), A, B).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == counted_by_force(dict(enumerate(texts)))


def test_alignment_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2, "g")], "doc_id long, text string, groups_sha256 string, n_a int, links string")
    out = alignment.align_and_count(docs, A, B)
    assert out.first().groups_sha256 == "x" and out.first().n_a == 2 and "_groups_sha256" in out.columns
    assert alignment.align_and_count(docs.limit(0), A, B).count() == 0


def test_run_lengths_over_batches():
    batch = lambda *kn: pa.RecordBatch.from_arrays([pa.array([k for k, _ in kn], pa.int64()), pa.array([n for _, n in kn], pa.int64())], names=["key", "n"])
    runs = list(alignment.run_lengths(iter([batch((1, 2), (1, 1)), batch(), batch((1, 4)), batch((2, 1), (3, 5)), batch((3, 5), (9, 1))])))
    assert [x for k, n in runs for x in zip(k.tolist(), n.tolist())] == [(1, 7), (2, 1), (3, 10), (9, 1)]


@needs_tables
def test_op13_against_the_libraries(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_alignment(spark, SF).select(*COLUMNS).collect()
    assert len(rows) == len(texts) and {tuple(r) for r in rows} == counted_by_force(texts)
