"""Registered queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigwarden.llm import language_id, mixing, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    tidy = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = Counter(tuple(tidy(r[names.index(c)]) for c in columns) for r in con.fetchall())
    assert Counter(tuple(tidy(r[c]) for c in columns) for r in got.collect()) == want


SPACE = " \t\n\v\f\r"


def shingles(text, words=5):
    found = (text or "").lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    return root


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, held = held, stage(spark, held, SF).cache()
        assert held.columns == docs.columns, name
        ids = {r.doc_id for r in held.select("doc_id").collect()}
        if name == "language_id":
            assert ids == {r.doc_id for r in docs.select("doc_id").collect()}  # all are in a known language
        if name == "line_dedup":
            lines = [{x.strip(SPACE).lower() for x in (r.text or "").split("\n")} for r in before.collect()]
            df = Counter(x for own in lines for x in own)
            kept = {r.doc_id: r for r in held.collect()}
            assert all(df[x.strip(SPACE).lower()] < 10 or not x.strip() for r in kept.values() for x in r.text.split("\n"))
            assert all(r.n_chars == len(r.text) for r in kept.values())
        if name == "simhash_near_dedup":
            rows = sorted(before.collect(), key=lambda r: r.doc_id)
            sets = [shingles(r.text) for r in rows]
            root = components(len(rows), lambda i, j: sets[i] == sets[j] or (bool(sets[i] & sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])))
            assert ids == {rows[x].doc_id for x in root} and len(ids) < len(rows)
        if name == "mixing":
            sizes = {r.source: r.mix_target for r in mixing.with_shares(before, seed=17).select("source", "mix_target").distinct().collect()}
            words = Counter()
            for r in held.collect():
                words[r.source] += len(r.text.split())
            longest = max(len(r.text.split()) for r in before.collect())
            assert all(abs(words[s] - t) <= longest for s, t in sizes.items())
    coded = corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path(queries.TOKENIZER))
    texts = {r.doc_id: r.text for r in held.collect()}
    assert len(coded) == held.count()
    for r in coded:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_takes_empty_tables(spark):
    held = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, SF)
        assert held.count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_against_brute_force(spark, texts):
    import xxhash

    lower = str.maketrans({c: c + 32 for c in range(65, 91)})

    def fingerprint(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate(lower)) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    ids = sorted(texts)
    fps = [fingerprint(texts[i]) for i in ids]
    root = components(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    want = {(i, f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, root)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()} == want


def test_op2_against_brute_force(spark, texts):
    import zlib

    rows = queries.op2_media_columns(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        media = b"P5\n# bytes %d\n64 %d\n255\n" % (len(data), len(payload) // 64) + payload
        mean = sum(payload) / len(payload)
        deviation = max(sum(x * x for x in payload) / len(payload) - mean * mean, 0) ** 0.5
        feature = f"{mean:.6f} {deviation:.6f} {min(payload)} {max(payload)} {len(set(payload))}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), feature)


def test_op7_against_the_library(spark, texts):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path(queries.TOKENIZER))
    rows = queries.op7_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5_against_brute_force_and_held_out_labels(spark):
    """Counts, smoothing and fusion in plain loops; likelihoods and the model are the library's, tested on held-out labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op5_language_id(spark, SF).collect()
    model = language_id.fit(docs)
    langs = model.languages
    given = [(r.doc_id, r.page_id, r.text, r.declared, r.host) for r in queries._texts_with_evidence(spark, SF).collect()]
    assert any(g[3] for g in given) and any("." in (g[4] or "") for g in given)

    def alone(text):
        return None if not len(language_id.trigrams((text or "").encode())) else model.log_likelihoods(text.encode())

    scored = [(*g, alone(g[2])) for g in given]
    best = lambda ll: "und" if ll is None else [*langs, "und"][int(np.argmax(ll))]
    suffix = lambda h: h.split(".")[-1] if "." in h else ""
    domain = lambda h: ".".join(h.split(".")[-2:])
    tally = {k: Counter() for k in ("host", "domain", "suffix", "tag", "all")}
    for _, _, _, tag, host, ll in scored:
        x, host = best(ll), host or ""
        for k, v in (("host", host), ("domain", domain(host)), ("suffix", suffix(host)), ("all", "")):
            tally[k][v, x] += 1
        if tag:
            tally["tag"][tag if tag in langs else "other", x] += 1
    per = lambda k, v: np.array([float(tally[k][v, x]) for x in langs])
    total = per("all", "") + 1
    tags = {t: np.log((per("tag", t) + 1) / (sum(per("tag", u) for u in (*langs, "other")) + len(langs) + 1)) for t in (*langs, "other")}
    want = {}
    for doc, page, _, tag, host, ll in scored:
        if ll is None:
            want[doc, page] = ("und", 0.0)
            continue
        host = host or ""
        d = (per("domain", domain(host)) + 20 * total / total.sum()) / (per("domain", domain(host)).sum() + 20)
        h = (per("host", host) + 20 * d) / (per("host", host).sum() + 20)
        s = 0.0
        if suffix(host):
            share = (per("suffix", suffix(host)).sum() + 1) / (total.sum() + 1)
            s = np.log((per("suffix", suffix(host)) + 20 * share) / (total + 20))
        prior = np.exp(np.log(h) + s)
        score = np.append(ll[:-1] + np.log(1 - 0.001) + np.log(prior / prior.sum()), ll[-1] + np.log(0.001))
        if tag:
            t = tags[tag if tag in langs else "other"]
            score[:-1] += t - np.log(np.exp(t).sum()) + np.log(len(langs))
        p = np.exp(score - score.max())
        want[doc, page] = ([*langs, "und"][int(np.argmax(p))], p.max() / p.sum())
    assert len(rows) == len(given) == len(want)
    for r in rows:
        language, p = want[r.doc_id, r.page_id]
        assert r.language == language and abs(r.posterior - p) < 2e-4 and r.kept == (language != "und" and p >= 0.5)

    held = docs.filter("doc_id % 2 = 1")
    found = language_id.judge(held, language_id.fit(docs.filter("doc_id % 2 = 0")), ["doc_id", "lang"], host=F.col("source")).collect()
    assert np.mean([r.language == r.lang for r in found]) > 0.97


def test_op8_follows_the_rules_of_its_contract(spark, tmp_path):
    urls = {"http://a.net/de/1": ("net/de/", "allow"), "http://example.net/de/81": ("example.net/de/8", "block"), "http://x.example.net/de/7": ("net/de/", "allow"), "http://b.com/en/": ("com/en/", "block"),
            "http://example.com/en/7": ("example.com/en/7", "allow"), "http://c.org/es/": ("org/es/", "block")}
    tables = {"pages": spark.createDataFrame([(i, u, "<p>x</p>") for i, u in enumerate(urls)], "page_id long, url string, html string"), "documents": spark.read.parquet(f"{SF}/documents.parquet"), "labels": spark.read.parquet(f"{SF}/labels.parquet")}
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert [(r.rule, r.verdict) for r in queries.op8_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()] == list(urls.values())
    assert con.execute(f"SELECT rule, verdict FROM ({queries.OP8_SQL}) ORDER BY page_id").fetchall() == list(urls.values())
