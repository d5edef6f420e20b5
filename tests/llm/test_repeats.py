"""Substring dedup, decontamination and line dedup against plain Python."""

import hashlib
import random
import re

import pytest

from incidentlens.llm import decontaminate, line_frequency, substring_dedup
from pyspark.sql import functions as F


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_repeats(rows, window):
    seen = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if doc is not None:
                seen[key] = min(seen.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = split(text), set()
        for i in range(len(w) - window + 1):
            if doc is not None and seen[tuple(w[i:i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def repeating_rows(seed, n=60):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(4)]
    rows = []
    for d in range(n):
        parts = [rng.choice(shared)[rng.randrange(20):] if rng.random() < 0.5 else
                 "\n".join(rng.choice(["x", "y", "é", "z"]) + str(rng.randrange(50)) for _ in range(rng.randrange(25)))
                 for _ in range(rng.randrange(4))]
        rows.append((d, "  ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "a a a " * 30), (n + 4, "a a a " * 30),
             (5, rows[5][1]), (7, rows[9][1]), (None, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot_entries", [substring_dedup.HOT_ENTRIES, 0])
def test_substring_dedup(corpus, hot_entries):
    rows = repeating_rows(hot_entries)
    docs = corpus.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("mark", F.lit(1)).repartition(3)
    got = substring_dedup.remove_repeats(docs, window=13, hot_entries=hot_entries)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(rows, 13)


def test_substring_dedup_of_nothing(corpus):
    assert substring_dedup.remove_repeats(corpus.createDataFrame([], "doc_id BIGINT, text STRING")).collect() == []


def test_substring_dedup_joins_texts_alike_at_every_size(corpus, monkeypatch):
    plans, held = [], substring_dedup.stored

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return held(df)

    monkeypatch.setattr(substring_dedup, "stored", spy)
    docs = corpus.createDataFrame(repeating_rows(3), "doc_id BIGINT, text STRING")
    plans.append(substring_dedup.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if re.search(r"Join \[doc#\d+L?, mark#", line)]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)


def bench_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = bench_words(text), set(), set()
        for i in range(len(w)):
            for k in range(1, n + 1):
                if i + k <= len(w) and tuple(w[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        out.append((doc, len(w), len(hit), len(found), decontaminate.items_hash(found), bool(hit)))
    return sorted(out, key=str)


def bench_rows(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(["Alpha", "beta", "é", "x1", "Z", "q"]) for _ in range(rng.randrange(25))))
             for i in range(15)] + [(3, "alone"), (40, None), (41, "..."), (None, "beta beta")]
    rows = []
    for d in range(50):
        text = " ".join(rng.choice(["alpha", "BETA", "é", "x1", "z", "w", "v"]) for _ in range(rng.randrange(40)))
        if rng.random() < 0.5:
            text += "! " + (rng.choice(items)[1] or "").replace(" ", "--") + ". " + text[:9]
        rows.append((d, text))
    rows += [(60, None), (61, ""), (62, "?!"), (5, rows[5][1]), (None, items[0][1])]
    return rows, items


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 60])
def test_decontamination(corpus, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block_bytes,))
    rows, items = bench_rows(block_bytes)
    docs = corpus.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("spans", F.lit("x"))
    bench = corpus.createDataFrame(items, "item_id BIGINT, text STRING")
    found = decontaminate.report(docs, bench)
    got = sorted((tuple(r) for r in decontaminate.digest(found).drop("longest").collect()), key=str)
    want = brute_contamination(rows, [i for i in items if i[0] is not None])
    assert got == want
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)
    for r in found.filter("longest is not null").collect():
        if block_bytes > 60:
            w = bench_words(dict(rows)[r.doc_id])
            source = [bench_words(t) for i, t in items if str(i) == r.longest.item_id]
            a, b, n = r.longest.doc_word, r.longest.item_word, r.longest.n_words
            assert any(w[a:a + n] == s[b:b + n] for s in source)


def test_decontamination_of_nothing(corpus):
    docs = corpus.createDataFrame([(1, "a b")], "doc_id BIGINT, text STRING")
    none = corpus.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontaminate.remove_contaminated(docs, none).count() == 1
    assert decontaminate.digest(decontaminate.report(docs, none)).first().n_hit == 0
    assert decontaminate.remove_contaminated(docs.limit(0), corpus.createDataFrame(
        [(1, "a")], "item_id BIGINT, text STRING")).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [line_frequency.BROADCAST_BYTES, -1])
def test_line_frequency(corpus, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(line_frequency, "BROADCAST_BYTES", broadcast_bytes)
    rows = [(i, "h", f" menu \nown {i}\n\nmenu\nfoot" if i < 5 else f"own {i}\nfoot") for i in range(10)]
    rows += [(20, "h", None), (21, "h", ""), (22, None, "menu\nfoot"), (23, "small", "menu"), (23, "small", "menu")]
    docs = corpus.createDataFrame(rows, "page BIGINT, host STRING, text STRING").withColumn("bad", F.lit(1))
    got = line_frequency.drop_frequent_lines(docs, F.col("host"), F.col("text"), ratio=0.4)
    assert got.columns == docs.columns
    # 5 of 12 pages hold the menu, 10 of 12 the footer.
    want = [(i, "h", f"own {i}\n" if i < 5 else f"own {i}", 1) for i in range(10)] + [
        (20, "h", None, 1), (21, "h", "", 1), (22, None, "menu\nfoot", 1), (23, "small", "", 1),
        (23, "small", "", 1)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert line_frequency.drop_frequent_lines(docs.limit(0), F.col("host"), F.col("text")).count() == 0


def test_boilerplate_of_small_hosts(corpus):
    rows = [(i, "three", f"menu\nown {i}") for i in range(3)] + [(10 + i, "two", f"own {i}\nfoot") for i in range(2)]
    rows += [(20, "one", "alone")] + [(30 + i, "twelve", "menu\ntwice" if i < 2 else f"menu\nown {i}") for i in range(12)]
    rows += [(50 + i, "nine", "both" if i < 2 else f"own {i}") for i in range(9)]
    docs = corpus.createDataFrame(rows, "page BIGINT, host STRING, text STRING")
    got = line_frequency.drop_frequent_lines(docs, F.col("host"), F.col("text"))
    # 2 of 9 pages are above a fifth, 2 of 12 are not; a line on one page stays whatever its share.
    want = [(i, "three", f"own {i}") for i in range(3)] + [(10 + i, "two", f"own {i}") for i in range(2)]
    want += [(20, "one", "alone")] + [(30 + i, "twelve", "twice" if i < 2 else f"own {i}") for i in range(12)]
    want += [(50 + i, "nine", "" if i < 2 else f"own {i}") for i in range(9)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_page_text_and_host(corpus):
    page = ("<html><SCRIPT>x</SCRIPT><p class='a'>One <b>two</b></p><!-- c --><LI>three<br>four"
            "<DIV>a &amp;lt; b&nbsp;c</html>")
    row = corpus.createDataFrame([("http://u:p@A.b:80/x?y", page)], "url STRING, html STRING").select(
        line_frequency.url_host(F.col("url")).alias("h"), line_frequency.html_text(F.col("html")).alias("t")).first()
    assert row.h == "a.b"
    assert [s for s in row.t.split("\n") if s] == ["One two", "three", "four", "a &lt; b c"]
