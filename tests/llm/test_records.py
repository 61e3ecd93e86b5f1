"""Embeddings, WARC and chat against brute force and round trips, and the pipeline and entry contract."""

import base64
import hashlib
import math
import zlib

import numpy as np
import pytest

from baleprice.llm import chat, embeddings, warc
from baleprice.llm.common import scratch
from conftest import SF_SMALL

VECTORS = "vec_id long, embedding array<float>, label int, cell string, weight string"


def _brute(rows, threshold=0.9):
    unit = {}
    for i, v, *_ in rows:
        x = np.array([np.nan if c is None else c for c in v] if v else [], np.float32).astype(float)
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            unit[i] = x / np.linalg.norm(x)
    links = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= threshold}
             if i in unit else set() for i, *_ in rows}
    label = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, near in links.items():
            low = min([label[i], *[label[j] for j in near]])
            if low != label[i]:
                label[i], changed = low, True
    return {i: len(n) for i, n in links.items()}, label


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16)).tolist()
    rows = [(i, v, 0, "x", "y") for i, v in enumerate(base)]
    rows += [(100 + i, (np.array(base[0]) + rng.standard_normal(16) * 0.05).tolist(), 1, "x", "y") for i in range(30)]
    rows += [(200 + i, [2 * c for c in base[1]], 1, "x", "y") for i in range(5)]
    rows += [(300, None, 0, "", ""), (301, [], 0, "", ""), (302, [0.0] * 16, 0, "", ""), (303, [math.nan] + [1.0] * 15, 0, "", ""),
             (304, [math.inf] + [1.0] * 15, 0, "", ""), (305, [None] + [1.0] * 15, 0, "", ""), (306, base[0][:8], 0, "", ""),
             (307, base[0][:8], 0, "", "")]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    number, label = _brute(rows)
    assert {i: r.n_links for i, r in got.items()} == number
    assert {i: r.component_id for i, r in got.items()} == label
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_blocks_split_a_cell(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    center = rng.standard_normal(32)
    rows = [(i, (center + rng.standard_normal(32) * 0.08).tolist(), 0, "", "") for i in range(120)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id: r.n_links for r in got} == _brute(rows)[0]


def test_recall_of_links_near_the_threshold(spark):
    """Pairs of cosine 0.90 to 0.93 among unrelated vectors: at least nine of ten are found."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= b @ a * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.902, 0.93)
        rows += [(2 * i, a.tolist(), 0, "", ""), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), 0, "", "")]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    found = sum(got[2 * i + 1].component_id == 2 * i for i in range(1500))
    assert found >= 0.9 * 1500
    assert sum(r.n_links for r in got.values()) <= 2 * 1500


@pytest.mark.parametrize("max_pivots", [1, 16])
def test_all_links_near_the_threshold_with_few_pivots(spark, max_pivots):
    """Pivots under 1 % of the vectors: every vector has all its links, both ends of a pair the same one."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1000):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        for k in range(3):
            b = rng.standard_normal(64)
            b -= b @ a * a
            b /= np.linalg.norm(b)
            c = rng.uniform(0.9, 0.93) if k else 1.0
            rows.append((3 * i + k, (c * a + math.sqrt(1 - c * c) * b).tolist(), 0, "", ""))
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS), max_pivots=max_pivots).collect()}
    number, label = _brute(rows)
    assert {i: r.n_links for i, r in got.items()} == number
    assert {i: r.component_id for i, r in got.items()} == label


def test_codes_never_rule_out_a_link():
    rng = np.random.default_rng(10)
    for dim in (1, 2, 16, 64):
        x = rng.standard_normal((400, dim))
        q = x + rng.standard_normal((400, dim)) * rng.uniform(0, 0.6, (400, 1)) * np.linalg.norm(x, axis=1)[:, None] / math.sqrt(dim)
        x, q = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, q))
        turn = embeddings.rotation(dim)
        codes, factors = embeddings.encode(x @ turn)
        value, _ = embeddings.estimate(codes, factors, q @ turn)
        assert (value >= embeddings.least_estimate(factors, 0.9, dim))[q @ x.T >= 0.9].all()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:50] * 0.9 + rng.standard_normal((50, 64)) * 0.05
    q /= np.linalg.norm(q, axis=1)[:, None]
    turn = embeddings.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes, factors = embeddings.encode(x @ turn)
    value, error = embeddings.estimate(codes, factors, q @ turn)
    off = value - q @ x.T
    assert abs(off.mean()) < 0.005
    assert (np.abs(off) <= embeddings.CONFIDENCE * error).mean() > 0.995


PAGES = "page_id long, url string, html string, digest string, size string, copies int"


def _pages():
    return [(1, "http://a/", "<p>é</p>\r\n\r\nWARC/1.1\r\n", "x", "y", 1), (2, "http://b/", "<p>é</p>\r\n\r\nWARC/1.1\r\n", "x", "y", 1),
            (3, None, None, "x", "y", 1), (4, "http://c/", "", "x", "y", 1), (5, "http://d/\r\nX: y", "z" * 300000, "x", "y", 1),
            (6, "http://e/", "short", "x", "y", 1), (7, "http://e/", "short", "x", "y", 1), (7, "http://e/", "short", "x", "y", 1),
            (None, "http://n/", "lonely", "x", "y", 1)]


@pytest.mark.parametrize("least", [0, 6])
def test_warc_round_trip(spark, least):
    path = scratch(spark, "warc")
    warc.write_captures(spark.createDataFrame(_pages(), PAGES), path, least)
    rows = [r.asDict() | {"page_id": r.page} for r in warc.assemble(warc.read_records(spark, path)).withColumn(
        "page", warc.page_id(warc.F.col("metadata"))).collect()]
    assert len(rows) == len(_pages()) and len({r["record_id"] for r in rows}) == len(rows)
    names = {r["record_id"]: r for r in rows}
    by_html = {}
    for i, _, html, *_ in _pages():
        by_html.setdefault(html or "", []).append(i)
    assert sorted(str(r["page_id"]) for r in rows) == sorted(str(p[0]) for p in _pages())
    for r in rows:
        text = bytes(r["payload"]).decode()
        ids = by_html[text]
        assert r["page_id"] in ids
        assert r["payload_bytes"] == len(text.encode())
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1
        if r["type"] == "revisit":
            assert len(text.encode()) >= least and names[r["refers_to"]]["page_id"] == max(ids)
    for text, ids in by_html.items():
        plain = [r for r in rows if bytes(r["payload"]).decode() == text and r["type"] == "response"]
        assert len(plain) == (len(ids) if len(text.encode()) < least else 1)


def test_warc_is_valid_framing(spark):
    path = scratch(spark, "warc")
    warc.write_captures(spark.createDataFrame(_pages(), PAGES), path)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    records = [r for f in files for r in warc._records(bytes(f[0]))]
    assert sorted({h["WARC-Type"] for h, _ in records}) == ["metadata", "request", "response", "revisit"]
    assert len(records) == 3 * len(_pages())
    whole = b"".join(zlib.decompress(bytes(f[0]), 31) for f in files)
    assert whole.count(b"WARC-Record-ID: <urn:uuid:") == len(records)
    members = b"".join(zlib.compress(x, wbits=31) for x in (whole[:0], whole))
    assert list(warc._records(members)) == list(warc._records(whole))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc._records(b"junk\r\n\r\n"))


def test_warc_empty_and_bad_digest(spark):
    path = scratch(spark, "warc")
    warc.write_captures(spark.createDataFrame([], PAGES), path)
    records = warc.read_records(spark, path)
    assert records.count() == 0 and warc.assemble(records).count() == 0
    bad = spark.createDataFrame([("r", "response", None, "d", None, None, "AAA", "BBB", 1, b"x")], warc._RECORD_DDL)
    with pytest.raises(Exception, match="payload digest differs"):
        warc.assemble(bad).collect()


MESSAGES = "tree string, node long, parent long, role string, text string, score double"


def _trees():
    nasty = ["\\### Assistant: </turn> ok", "\\b\\h\\t", "\\", "### ", "</turn>\n", "</turn>", "a: b", "", None, "é😀\n\n### x: ", "\\\\h"]
    rows = [("long", i, i - 1 if i else None, ("user", "assistant")[i % 2], nasty[i % len(nasty)], None) for i in range(45)]
    rows += [("fork", 1, None, "user", "root", 0.0), ("fork", 2, 1, "assistant", "bad", -1.0), ("fork", 3, 1, "assistant", "good", 1.0),
             ("fork", 4, 3, "user", "thanks", 0.5), ("fork", 5, 2, "user", "why", 9.0), ("fork", 6, 99, "a: ### b\\", "orphan", 0.1),
             ("one", 1, None, None, None, None)]
    return rows


def _paths(rows):
    """Root-to-leaf paths of each tree, best first."""
    out = {}
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in nodes.values()}
        paths = []
        for leaf in nodes.keys() - parents:
            path, at = [], leaf
            while at in nodes:
                path.append(nodes[at])
                at = nodes[at][2]
            paths.append(path[::-1])
        out[tree] = sorted(paths, key=lambda p: (-sum(r[5] or 0 for r in p) / len(p), -len(p), p[-1][1]))
    return out


@pytest.mark.parametrize("top_k", [1, None])
def test_reply_trees_round_trip(spark, top_k):
    df = spark.createDataFrame(_trees(), MESSAGES).selectExpr("*", "'x' AS up", "'y' AS depth", "'z' AS turn")
    said = chat.format_paths(chat.reply_paths(df, top_k))
    rows = said.select("tree", "rank", "formatted", "loss", chat.read_turns(said.formatted).alias("turns"),
                       chat.read_loss(said.formatted, said.loss).alias("learned")).collect()
    want = {(t, k + 1): p for t, paths in _paths(_trees()).items() for k, p in enumerate(paths[:top_k])}
    assert {(r["tree"], r["rank"]) for r in rows} == want.keys()
    for r in rows:
        path = want[r["tree"], r["rank"]]
        assert [(t.role, t.text) for t in r.turns] == [(p[3] or "", p[4] or "") for p in path]
        assert r.learned == "".join(p[4] or "" for p in path if p[3] == "assistant")
        assert len(r.loss) == sum(p[3] == "assistant" for p in path)
        assert r.formatted.count("</turn>") == len(path)


def test_reply_trees_null_tree_and_node(spark):
    rows = [(None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "b", 1.0), (None, 3, 2, "user", "c", 2.0),
            (None, 4, 2, "user", "d", 1.0), ("t", 1, None, "user", "e", 0.0), ("t", None, 1, "assistant", "f", 2.0),
            ("t", None, 1, "assistant", "g", 2.0), ("t", None, None, "user", "h", 0.0), (None, None, 4, "user", "i", 0.0)]
    turns = chat.reply_paths(spark.createDataFrame(rows, MESSAGES), None).collect()
    got = {}
    for r in sorted(turns, key=lambda r: r.turn):
        got.setdefault((r.tree, r["rank"], r.leaf, r.n_turns), []).append(r.text)
    assert got == {(None, 1, 3, 3): ["a", "b", "c"], (None, 2, None, 4): ["a", "b", "d", "i"],
                   ("t", 1, None, 2): ["e", "f"], ("t", 2, None, 2): ["e", "g"], ("t", 3, None, 1): ["h"]}
    best = chat.reply_paths(spark.createDataFrame(rows, MESSAGES)).collect()
    assert sorted((r.tree or "", r.text) for r in best) == [("", "a"), ("", "b"), ("", "c"), ("t", "e"), ("t", "f")]


def test_reply_trees_empty_and_circle(spark):
    assert chat.reply_paths(spark.createDataFrame([], MESSAGES)).count() == 0
    circle = [("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0)]
    with pytest.raises(ValueError, match="circle"):
        chat.reply_paths(spark.createDataFrame(circle, MESSAGES), max_rounds=4)


def test_llm_queries_match_their_sql(spark):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    from baleprice.llm.queries import ORACLE_SQL
    from compare import compare
    got = compare(spark, SF_SMALL, list(ORACLE_SQL))
    assert all(r["ok"] for r in got.values()), got


def test_entry_has_all_eleven():
    from __spark_entry__ import oracle_sql, queries
    names = list(queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(oracle_sql()) <= set(names)
