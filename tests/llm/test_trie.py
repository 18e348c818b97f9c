"""The conversation trie against a plain dictionary, over ordinary, deep, wide and awkward tables."""
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlake.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuilt):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0, role, text[:64], hashlib.md5(text.encode()).hexdigest()), (role, text)))
    convs = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        convs = {c: convs.get(c - c % 20, [])[:h[c]] + ts[h[c]:] for c, ts in convs.items()}
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        cost = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += kids[p] == 0
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


def collected(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def rebuilt(df):
    c = F.col("conv_id")
    return trie.prefix_trie(df, F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)), c - c % 20, most=3)


def random_rows(seed, convs, most, words=2):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), " ".join(r.choices(["a", "b"], k=r.randint(0, words)))) for c in r.sample(range(200), convs) for t in range(r.randint(1, most))]


@pytest.mark.parametrize("again", [False, True])
def test_equals_a_dictionary(spark, again):
    rows = random_rows(1, 60, 5) + [(c, t, "user", f"deep {t}") for c in (301, 302) for t in range(40)]  # one long chain, shared
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(rebuilt(df) if again else trie.prefix_trie(df)) == brute(rows, again)


def test_awkward_rows(spark):
    rows = [(5, None, "user", "null turn first"), (5, -3, "user", "negative"), (5, 2, None, None), (5, 2, "a", "tie"), (5, 2, "a", "tie"), (5, 2, "a", "tia"), (None, 1, "user", "no conversation"),
            (-25, 0, "user", "negative id"), (7, 0, "user", "x " * 20_000), (7, 1, "user", ""), (27, 0, "user", ":"), (28, 0, "user:", "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", node string, depth int").repartition(4)
    for again in (False, True):
        assert collected(rebuilt(df) if again else trie.prefix_trie(df)) == brute(rows, again)


def test_no_conversations(spark):
    assert rebuilt(spark.createDataFrame([], SCHEMA)).collect() == []
    assert rebuilt(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_blocks_and_chunks_do_not_show(spark, monkeypatch):
    """One conversation of many blocks of turns, one node at which many conversations end."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "CHUNK", 60)
    rows = [(1, t, "user", f"w{t % 3}") for t in range(50)] + [(c, 0, "user", "hello there") for c in range(100, 400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert collected(rebuilt(df)) == brute(rows, True)


def test_totals_of_any_forest(spark):
    """Contraction alone: a star, a path, a caterpillar and random trees of 300 nodes."""
    r = random.Random(3)
    for shape in (lambda i: 0, lambda i: i - 1, lambda i: i - 1 if i % 2 else max(i - 2, 0), lambda i: r.randrange(max(0, i - 5), i)):
        parent = {i: shape(i) if i else None for i in range(300)}
        weight = {i: r.randint(0, 9) for i in parent}
        total = dict(weight)
        for i in sorted(parent, reverse=True):
            if parent[i] is not None:
                total[parent[i]] += total[i]
        kids = {i: sum(p == i for p in parent.values()) for i in parent}
        df = spark.createDataFrame([(i, parent[i], kids[i], weight[i]) for i in parent], "node long, parent long, kids long, w long")
        assert {x.node: x.w for x in trie.contract(df, ["w"]).collect()} == total


def test_query_equals_dictionary(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.QUERIES["op11_conversation_trie"](spark, sf)) == brute(rows, True)


def test_totals_take_no_more_jobs_for_deep_chains(spark):
    """Chains that hang one below the other: as many jobs as for a flat table, and the same totals as by hand."""
    flat = [(c, 0, "user", f"hello {c}") for c in range(20)]
    deep = [(c, t, "user", f"both {t}" if t < c else f"own {c}") for c in range(20) for t in range(c + 2)]
    jobs = []
    for name, rows in (("flat", flat), ("deep", deep)):
        spark.sparkContext.setJobGroup(f"trie {name}", name)
        try:
            got = collected(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)))
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trie {name}")))
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        assert got == brute(rows, False)
    assert jobs[1] <= jobs[0] + 5
