"""Exact dedup by chunk recipes, and verified identifiers."""

import hashlib
import random
import re

import pytest

from incidentlens.llm import chunk_recipes, identifiers

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    """(doc_id, keep_id, group_size, text_sha256) for rows (doc_id, text)."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for doc, text in rows:
        t = SPACE.sub("", text or "")
        out.append((doc, min(groups[t])[3], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


def sorted_rows(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgéßxyz中😀") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    out = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))
        out += [(10 * i, text), (10 * i + 1, text.replace(" ", rng.choice(["\n", "  ", " \t", ""])))]
        out.append((10 * i + 2, text + "x"))  # differs at the end only
    out += [(9001, None), (9002, ""), (9003, " \v\f\r"), (None, "same"), (None, "same"), (9004, "sa me"),
            (9005, "tie"), (9006, "tie"), (9007, "tie"), (9007, "tie"), (9008, "a" * 300_000),
            (9009, "a" * 300_000 + " "), (9010, "a" * 299_999), (9011, "a b"), (9012, "ab")]
    return out


@pytest.mark.parametrize("bits", [64, 5])
def test_equals_brute_force(corpus, texts, bits):
    docs = corpus.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = chunk_recipes.duplicates(docs, bits=bits).collect()
    assert sorted_rows((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted_rows(brute(texts))
    stay = {}
    for r in got:
        stay.setdefault(r.text_sha256, []).append((r.kept, r.doc_id, r.keep_id))
    for rows in stay.values():
        assert sum(kept for kept, _, _ in rows) == 1
        assert all(doc == keep for kept, doc, keep in rows if kept)


def test_keep_first_returns_all_columns(corpus, texts):
    data = [(d, t, i, "c") for i, (d, t) in enumerate(texts)]
    docs = corpus.createDataFrame(data, "doc_id long, text string, row int, recipe string")
    got = chunk_recipes.keep_first(docs)
    assert got.dtypes == docs.dtypes
    kept = [tuple(r) for r in got.collect()]
    assert set(kept) <= set(data)
    assert sorted_rows(r[0] for r in kept) == sorted_rows(
        keep for _, keep in {(sha, keep) for _, keep, _, sha in brute(texts)})


def test_clashing_columns_are_left_out(corpus):
    docs = corpus.createDataFrame([(1, "a b", 5, "x"), (2, "ab", 6, "y")],
                                  "doc_id long, text string, row int, chunk string")
    got = chunk_recipes.duplicates(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, 1, 2, True), (2, 1, 2, False)]


def test_empty_table(corpus):
    docs = corpus.createDataFrame([], "doc_id long, text string")
    assert chunk_recipes.duplicates(docs).collect() == []
    assert chunk_recipes.keep_first(docs).collect() == []


def test_chunks_rejoin_and_follow_content(corpus):
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß中") for _ in range(20_000))
    rows = corpus.createDataFrame([(1, body), (2, "XYZ" + body), (3, "")], "id int, text string")
    got = {r.id: r.c for r in rows.select("id", chunk_recipes.cut(rows["text"]).alias("c")).collect()}
    assert "".join(got[1]) == body and "".join(got[2]) == "XYZ" + body and got[3] == []
    assert all(len(c) <= chunk_recipes.LONGEST for c in got[1])
    assert 20_000 / 2_000 < len(got[1]) < 20_000 / chunk_recipes.SHORTEST + 1
    assert len(set(got[1]) & set(got[2])) >= 0.8 * len(got[1])  # cuts fall into step again


def test_identifiers_are_told_apart(corpus):
    table = corpus.createDataFrame([(i, f"v{i % 50}") for i in range(200)], "i int, v string")
    assert identifiers.clashing(table, ["v"]) is None
    clashes = identifiers.clashing(table, ["v"], bits=3)
    got = identifiers.with_identifier(table, ["v"], "id", clashes, bits=3).collect()
    assert len(got) == 200 and {len({r.id for r in got if r.v == v}) for v in {r.v for r in got}} == {1}
    assert len({r.id for r in got}) == 50


def test_main_path_is_native(corpus):
    docs = corpus.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = chunk_recipes.duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
