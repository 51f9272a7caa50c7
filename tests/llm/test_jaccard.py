"""Near-deduplication by Jaccard similarity against brute force."""

import random

import pytest

from sigwarden.llm import jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, words=5):
    found = (text or "").lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def groups(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j]):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", "One two", "one  TWO", "three"]
    for size in (30, 80, 300):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for changes in (0, 0, 1, 2, 4, 6, 9):
                own = list(base)
                for _ in range(changes * size // 100 + (changes > 0)):
                    own[rng.randrange(size)] = rng.choice(words)
                out.append(" ".join(own))
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(60):  # a chain: neighbours are similar, ends are not
        base[rng.randrange(120)] = rng.choice(words)
        out.append(" ".join(base))
    return out


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # a small one sends the chain's groups the way of block pairs
    rows = texts()
    want = groups([shingles(t) for t in rows])
    want[1] = 0
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], DOCS)
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert 20 < len({*want}) < len(rows) - 60
    kept = jaccard.drop_similar(docs.unionByName(docs.filter("doc_id < 9").withColumn("doc_id", docs.doc_id * 0 + None)))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({*want})
    assert kept.filter("doc_id is null").count() == 9 and kept.columns == docs.columns
    assert jaccard.similar_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("links_of_a_node", [1 << 16, 0])
def test_components_of_few_links_need_no_join(spark, monkeypatch, links_of_a_node):
    from sigwarden.llm import graph

    salts, step = [], graph._with_least
    monkeypatch.setattr(graph, "NODE_LINKS", links_of_a_node or 1)
    monkeypatch.setattr(graph, "_with_least", lambda pairs, n: salts.append(n) or step(pairs, n))
    rng = random.Random(4)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(200, x) for x in range(201, 260)] + [(7, 7)]
    least = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = graph.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: m for p in pairs if p[0] != p[1] for x, m in least.items() if x in p}
    if links_of_a_node:
        plan = step(spark.createDataFrame(pairs, "u long, v long"), 1)._jdf.queryExecution().optimizedPlan().toString()
        assert set(salts) == {1} and "Join" not in plan
    else:
        assert min(salts) > 1
