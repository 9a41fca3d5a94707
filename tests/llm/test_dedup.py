import random
import re

from pyspark.sql import functions as F

from cellweave.llm.common import components
from cellweave.llm.line_dedup import common_blocks, dedup_lines, patience, run_lengths, word_count, word_counts
from cellweave.llm.ngram_join import _shared, found_share, ngram_join
from tests.llm.conftest import prose


def brute(rows, n=5, threshold=0.8):
    """Links and groups of rows (doc_id, text) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        m = min(n, len(w))
        sets.append({tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set())
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(top(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(i, least[top(k)], links[k]) for k, (i, _) in enumerate(rows)]


def near_family(size, seed, first_id):
    """Texts that differ from each other in one to six words."""
    rng, base = random.Random(seed), prose(150, seed).split(" ")
    out = []
    for k in range(size):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append((first_id + k, " ".join(words)))
    return out


def key(row):
    return tuple(-1 if x is None else x for x in row)


def test_ngram_join_equals_all_pairs(spark, documents, nothing):
    docs = documents([*near_family(30, 7, 100), *near_family(8, 8, 200), (300, prose(3, 9)), (301, prose(3, 9).upper())])
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = ngram_join(docs)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert got.where("kept").select("class_id").where("class_id >= 100").distinct().count() == got.where("kept and class_id >= 100").count()
    assert ngram_join(nothing).count() == 0


def test_large_groups_are_joined_block_by_block(spark, monkeypatch):
    import cellweave.llm.ngram_join as module

    monkeypatch.setattr(module, "BLOCK", 8)
    rows = near_family(60, 11, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join(docs).collect())
    assert got == sorted(brute(rows))


def test_prefixes_shorten_until_the_recall_is_reached(spark):
    rows = near_family(40, 12, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sum(x[2] for x in brute(rows))
    few = ngram_join(docs, trees=2, depth=6, recall=0.5).agg({"n_links": "sum"}).first()[0]
    more = ngram_join(docs, trees=2, depth=6, recall=0.999).agg({"n_links": "sum"}).first()[0]
    assert few < more and more >= 0.9 * want  # few trees: the estimate is rough
    assert found_share(0.8, 24, 6) > 0.999


def test_intersections_of_both_ways_agree():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 20_000, 400).astype(np.uint64)) for _ in range(12)]
    every = np.arange(12)
    dense = _shared(sets, every, every, np.ones((12, 12), dtype=bool))
    few = np.zeros((12, 12), dtype=bool)
    few[1, 2] = few[3, 4] = True
    some = _shared(sets, every, every, few)
    assert (some[few] == dense[few]).all() and dense[5, 6] == len(np.intersect1d(sets[5], sets[6]))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 140)) and len(got) == 80
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_patience():
    assert patience([1, 2, 3, 4], [1, 3, 2, 4]) in ([(0, 0), (1, 2), (3, 3)], [(0, 0), (2, 1), (3, 3)])
    assert patience([], [1]) == [] and patience([5, 5], [5, 5]) == [(0, 0), (1, 1)]
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        found = patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert common_blocks([1, 2, 3], [9, 1, 0, 2, 8], [5, 5, 0, 5, 5], 10) == [1, 2, 3]
    assert common_blocks([1, 7, 2], [1, 2], [5, 5], 10) == []


def test_line_dedup(spark, documents, nothing):
    passage = prose(60, 20)  # five lines of twelve words
    before, after = prose(48, 21), prose(36, 22)
    extra = [(50, f"{before}\n{passage}\n{after}"), (51, f"{prose(24, 23)}\n{passage}"), (52, passage + "\n" + prose(24, 24)), (53, "Short line\n" + prose(24, 25)), (54, "Short line\n" + prose(24, 26))]
    docs = documents(extra)
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in got.where("doc_id >= 50").collect()}
    assert text[50] == extra[0][1]
    assert text[51] == prose(24, 23) and text[52] == prose(24, 24)
    assert text[53] == extra[3][1] and text[54] == extra[4][1]
    rows = {(r["doc_id"], r["node"]): r for r in got.collect()}
    assert rows[(1, 0)]["n_removed"] == 0 and rows[(2, 1)]["text"] == ""
    assert rows[(4, 3)]["text"] == rows[(4, 4)]["text"] != ""  # equal rows do not erase each other
    assert rows[(5, 6)]["text"] is None and rows[(5, 6)]["n_lines"] == 0
    assert rows[(None, 9)]["n_removed"] == 0 and rows[(11, 14)]["text"] == "two words"
    assert dedup_lines(nothing).count() == 0


def test_a_line_of_many_documents_leads_to_the_first(spark):
    shared = prose(24, 30)
    rows = [(i, f"{prose(24, 100 + i)}\n{shared}") for i in range(60)]
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i == 0 else 2 for i in range(60)}


def test_run_lengths_equal_brute_force():
    rng = random.Random(3)
    for _ in range(2000):
        k = rng.randrange(1, 6)
        a, b = ([rng.randrange(k + side) for _ in range(rng.randrange(14))] for side in (0, 1))
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        assert run_lengths(a, b) == [max((n for n in range(1, j + 2) if tuple(b[j + 1 - n : j + 1]) in runs), default=0) for j in range(len(b))]
        words = [rng.randrange(3) for _ in b]
        keep = [j for j, w in enumerate(words) if w]
        want = set()
        for i in range(len(keep)):
            for j in range(i, len(keep)):
                if tuple(b[x] for x in keep[i : j + 1]) in runs and sum(words[x] for x in keep[i : j + 1]) >= 3:
                    want |= set(range(keep[i], keep[j] + 1))
        assert common_blocks(a, b, words, 3) == sorted(want)


def test_a_repeated_passage_is_found_both_ways(spark):
    x, y, z, u, v = (prose(24, 40 + k) for k in range(5))
    passage = prose(60, 50)
    twice, once = "\n".join([x, passage, y, passage, z]), "\n".join([u, passage, v])
    for first, second in ((twice, once), (once, twice)):
        got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")).collect()}
        assert got == {1: first, 2: "\n".join([u, v] if second == once else [x, y, z])}


def test_passages_in_another_order_are_found(spark):
    p, q = prose(60, 60), prose(72, 61)
    rows = [(1, "\n".join([prose(24, 62), p, prose(24, 63), q])), (2, "\n".join([prose(24, 64), q, prose(24, 65), p]))]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"{prose(24, 64)}\n{prose(24, 65)}"}


def test_a_block_of_short_lines_leads_to_the_document_that_holds_it(spark):
    block = [f"short line number{k}" for k in range(4)]
    rows = [(k, f"{prose(24, 70 + k)}\n{line}\n{prose(24, 80 + k)}") for k, line in enumerate(block)]
    rows += [(10, "\n".join([prose(24, 90), *block])), (11, "\n".join([prose(24, 91), *block, "end"])), (12, "\n".join([block[0], "\n".join(block[2:])]))]
    rows += [(20, "first of twelve\nno\nlast of these words"), (21, "new\nfirst of twelve\n\nno\nlast of these words")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(rows) | {11: f"{prose(24, 91)}\nend", 21: "new"}
    assert got == want


def test_lines_that_go_are_those_of_all_common_runs(spark):
    """Against brute force: every line that lies in a run of at least 8 words of an earlier document."""
    rng = random.Random(4)
    pool = [" ".join(f"w{k}" for _ in range(1 + k % 9)) for k in range(24)]
    docs = [[rng.choice(pool) for _ in range(rng.randrange(2, 14))] for _ in range(150)]
    want, seen = {}, set()
    for d, lines in enumerate(docs):
        runs = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1) if len(" ".join(lines[i:j]).split()) >= 8 and any(len(x.split()) > 2 for x in lines[i:j])]
        gone = {x for i, j in runs if tuple(lines[i:j]) in seen for x in range(i, j)}
        want[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        seen |= {tuple(lines[i:j]) for i, j in runs}
    got = dedup_lines(spark.createDataFrame([(d, "\n".join(x)) for d, x in enumerate(docs)], "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_words_of_any_white_space_and_script(spark):
    lines = {"a b  c": 3, "a\tb\u00a0c\u3000d": 4, " \u00a0\t": 0, "": 0, "漢字かなカナ。漢": 4, "ภาษาไทยเขียน": 3, "x y 漢字": 3, "İstanbul naïve e\u0301 —": 4}
    rows = spark.createDataFrame([(x,) for x in lines], "x string")
    assert {r["x"]: r["n"] for r in rows.select("x", word_count(rows["x"]).alias("n")).collect()} == lines
    passages = [blank.join(f"cell{k}" for k in range(30)) for blank in ("\t", "\u00a0")] + ["数据处理系统需要删除重复的段落和表格", "ข้อความภาษาไทยที่ซ้ำกันในเอกสารหลายฉบับต้องถูกลบออก"]
    docs = [(10 * k + n, f"{prose(24, 10 * k + n)}\n{p}") for k, p in enumerate(passages) for n in (1, 2)]
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d % 10 - 1 for d, _ in docs}


def test_word_counts_of_plain_and_odd_texts(spark):
    lines = ["", "a  b", " x\ty\x0bz ", "two\u00a0words", "one\u2009two\u3000three", "\u6f22\u5b57\u304b\u306a text", "\u0e44\u0e17\u0e22 na", "don\u2019t \u2014 stop", "e\u0301 \U0001f642 x", "\u1780\u1781\u1782\u1783\u1784", "\x85a\x85b", "\x1ca b"]
    rows = spark.createDataFrame([(t, [t]) for t in lines] + [("\n".join(lines), lines)], "text string, lines array<string>")
    got = rows.select(word_counts(rows["text"], rows["lines"]).alias("a"), F.transform("lines", word_count).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and [r["a"][0] for r in got[:5]] == [0, 2, 3, 2, 3]
