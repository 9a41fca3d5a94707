"""Line deduplication by pairwise alignment: common blocks go from the later of two overlapping documents."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import column_of, with_identity
from cellweave.session import stored

KEY = ("doc_id", "_r1", "_r2")
BASE = 0x9E3779B97F4A7C15  # of the hash of a run of lines


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned positions (in `a`, in `b`) of equal items by patience diff, increasing in both.

    Items that occur once in each are anchors; the longest increasing run of them is kept. Between anchors
    the same is done again, and equal items next to an anchor or to an edge are aligned too.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        anchors = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place]
        if not anchors:
            continue
        tails: list[int] = []  # places in b of the last anchors of runs, by length
        ends: list[int] = []
        back: list[int] = []
        for at, (_, j) in enumerate(anchors):
            k = bisect_left(tails, j)
            back.append(ends[k - 1] if k else -1)
            if k == len(tails):
                tails.append(j)
                ends.append(at)
            else:
                tails[k], ends[k] = j, at
        run, at = [], ends[-1]
        while at >= 0:
            run.append(anchors[at])
            at = back[at]
        low_a, low_b = a0, b0
        for i, j in reversed(run):
            todo.append((low_a, i, low_b, j))
            out.append((i, j))
            low_a, low_b = i + 1, j + 1
        todo.append((low_a, a1, low_b, b1))
    return sorted(out)


def run_lengths(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """For every item of `b`: how many items up to it follow each other in `a` too, by a suffix automaton of `a`."""
    wanted = set(b)
    size, link, step = [0], [-1], [{}]
    last = 0
    for x in (x if x in wanted else None for x in a):
        if x is None:  # no item of b: nothing reaches across
            last = 0
            continue
        if x in step[last] and size[step[last][x]] == size[last] + 1:
            last = step[last][x]
            continue
        at = last
        if x in step[at]:
            new = -1
        else:
            new = len(size)
            size.append(size[last] + 1)
            link.append(0)
            step.append({})
            while at >= 0 and x not in step[at]:
                step[at][x] = new
                at = link[at]
        if at >= 0:
            old = step[at][x]
            if size[at] + 1 != size[old]:
                copy = len(size)
                size.append(size[at] + 1)
                link.append(link[old])
                step.append(dict(step[old]))
                while at >= 0 and step[at].get(x) == old:
                    step[at][x] = copy
                    at = link[at]
                link[old] = old = copy
            if new >= 0:
                link[new] = old
        last = new if new >= 0 else old
    out, at, n = [], 0, 0
    for x in b:
        while at and x not in step[at]:
            at = link[at]
            n = size[at]
        at, n = (step[at][x], n + 1) if x in step[at] else (0, 0)
        out.append(n)
    return out


def common_blocks(earlier: Sequence[int], later: Sequence[int], words: Sequence[int], least: int) -> list[int]:
    """Positions of `later` in common blocks that hold at least `least` words.

    A block is a run of lines that follow each other in both documents; lines without words between two of
    them belong to it. Patience diff finds the blocks that lie in the same order in both. Where lines that `earlier`
    holds are left over (repeated or in another order), all runs are looked up in an automaton, exactly.
    """
    left = [i for i, w in enumerate(words) if w]
    held = [later[i] for i in left]
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, held), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[left[x]] for x in block) >= least:
                out.extend(range(left[block[0]], left[block[-1]] + 1))
            block = []
        block.append(j)
        last = (i, j)
    known, taken = set(earlier), set(out)
    if not any(x in known and left[j] not in taken for j, x in enumerate(held)):
        return out
    whole: list[int] = []  # holds the blocks above, too
    upto = [0, *accumulate(words[i] for i in left)]
    ends = [*run_lengths(earlier, held), 0]
    for j, n in enumerate(ends[:-1]):
        if n and ends[j + 1] <= n and upto[j + 1] - upto[j + 1 - n] >= least:
            whole.extend(range(max(left[j + 1 - n], whole[-1] + 1 if whole else 0), left[j] + 1))
    return whole


def _align(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, places = [], []
        columns = [column_of(batch, c).to_pylist() for c in ("earlier", "lines", "words")]
        for row, (earlier, lines, words) in enumerate(zip(*columns, strict=True)):
            found = common_blocks(earlier, lines, words, least)
            if found:
                rows.append(row)
                places.append(found)
        keys = [column_of(batch, c).take(pa.array(rows, pa.int64())) for c in KEY]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(places, pa.list_(pa.int32()))], [*KEY, "places"])


def _short_runs(lines: np.ndarray, words: np.ndarray, doc: np.ndarray, least: int, line_words: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the shortest runs of at least `least` words from every line on that is shorter itself.

    With `back` the runs end with the line. Every line without words is left out before, so no run has more than
    `least` lines.
    """
    at = np.flatnonzero(words < least)
    hashes, total, fits = lines[at].copy(), words[at].copy(), words[at] >= line_words
    docs, keys = [], []
    power = 1
    for r in range(1, least):
        to = at - r if back else at + r
        inside = (to >= 0) & (to < len(lines))
        inside[inside] = doc[to[inside]] == doc[at[inside]]
        at, to, hashes, total, fits = at[inside], to[inside], hashes[inside], total[inside], fits[inside]
        power = power * BASE % 2**64
        hashes = lines[to] + hashes * np.uint64(BASE) if back else hashes + lines[to] * np.uint64(power)
        total, fits = total + words[to], fits | (words[to] >= line_words)
        done = total >= least
        docs.append(doc[at[done & fits]])
        keys.append(hashes[done & fits])
        at, hashes, total, fits = at[~done], hashes[~done], total[~done], fits[~done]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *docs]), np.concatenate([none.astype(np.uint64), *keys])


def _contexts(batches: Iterator[pa.RecordBatch], least: int, line_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = column_of(batch, "lines")
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        lines = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        words = column_of(batch, "words").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        full = words > 0
        found = [_short_runs(lines[full], words[full], doc[full], least, line_words, back) for back in (False, True)]
        rows, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
        taken = pa.array(rows[new], pa.int64())
        yield pa.RecordBatch.from_arrays([*[column_of(batch, c).take(taken) for c in KEY], pa.array(keys[new].view(np.int64))], [*KEY, "line"])


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def word_count(line: Column) -> Column:
    """Words of a line: its runs of characters other than Unicode white space.

    Scripts without blanks count by characters: two Chinese or Japanese ones, or four Thai, Lao, Khmer, Burmese or
    Tibetan ones, stand for a word.
    """
    pairs, fours = (r"".join(rf"\p{{Is{s}}}" for s in names) for names in (("Han", "Hiragana", "Katakana"), ("Thai", "Lao", "Khmer", "Myanmar", "Tibetan")))
    runs = rf"(?U)[^\s{pairs}{fours}]+|[{pairs}]{{1,2}}\p{{IsPunctuation}}*|[{fours}]{{1,4}}\p{{IsPunctuation}}*"
    return F.regexp_count(line, F.lit(runs))


# Unicode white space beyond ASCII, and wherever one of the scripts of `word_count` may stand. A text without any of these
# characters has the words that ASCII blanks leave.
ODD = r"[\x{85}\x{a0}\x{e00}-\x{109f}\x{1680}\x{1780}-\x{17ff}\x{19e0}-\x{19ff}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{2e80}-\x{10ffff}]"


def word_counts(text: Column, lines: Column) -> Column:
    """`word_count` of each line of a text; the long pattern runs only on texts that need it."""
    plain = F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"\S+")))
    return F.when(text.rlike(ODD), F.transform(lines, word_count)).otherwise(plain)


def _order(prefix: str = "") -> Column:
    """Documents by id, null last; equal ids by text."""
    c = lambda name: F.col(prefix + name)
    return F.struct(c("doc_id").isNull().alias("z"), *[c(k).alias(k) for k in KEY])


def common_lines(docs: DataFrame, min_words: int = 8, min_line_words: int = 3) -> DataFrame:
    """Lines to delete: doc_id, _r1, _r2 (see `with_identity`) and `places`, the sorted positions of lines.

    Each line that two or more documents share leads from every later document to the first that holds
    it: a rare line gives its few pairs, a frequent one as many pairs as documents, never all pairs of them.
    Shorter lines than a block lead with their neighbours, too: the shortest runs of `min_words` from and up to
    every line, so that a document with the whole block is compared even if each line was seen before elsewhere.
    Each pair is aligned over all its lines.
    """
    docs = with_identity(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    body = F.coalesce("text", F.lit(""))
    clean = F.transform(_lines(body), lambda x: F.btrim(x, F.lit(" \t\r")))
    table = docs.select(*KEY, F.transform(clean, lambda x: F.xxhash64(x)).alias("lines"), word_counts(body, clean).alias("words"))
    table = stored(table, "lines")
    lines = table.select(*KEY, F.explode(F.arrays_zip("lines", "words")).alias("x"))
    lines = lines.where(F.col("x.words") >= min_line_words).select(*KEY, F.col("x.lines").alias("line"))
    kind = table.schema["doc_id"].dataType.simpleString()
    runs = table.mapInArrow(lambda b: _contexts(b, min_words, min_line_words), f"doc_id {kind}, _r1 long, _r2 long, line long")
    lines = lines.unionByName(runs)
    first = lines.groupBy("line").agg(F.min(_order()).alias("f"), F.max(_order()).alias("l"))
    first = first.where("f <> l").select("line", *[F.col(f"f.{k}").alias(f"e_{k}") for k in KEY])
    first = stored(first, "shared-lines")  # so that the join below may split a frequent line
    pairs = lines.join(first, "line").drop("line").where(~(F.col("doc_id").eqNullSafe(F.col("e_doc_id")) & (F.col("_r1") == F.col("e__r1")) & (F.col("_r2") == F.col("e__r2"))))
    pairs = pairs.distinct()
    held = F.transform(F.filter(F.arrays_zip("lines", "words"), lambda x: x["words"] > 0), lambda x: x["lines"])
    owner = table.select(*[F.col(k).alias(f"o_{k}") for k in KEY], held.alias("earlier")).dropDuplicates([f"o_{k}" for k in KEY])
    own = table.dropDuplicates(list(KEY))
    pairs = pairs.join(owner, (pairs["e__r1"] == owner["o__r1"]) & (pairs["e__r2"] == owner["o__r2"]) & pairs["e_doc_id"].eqNullSafe(owner["o_doc_id"]))
    pairs = pairs.select(*KEY, "earlier").join(own.withColumnsRenamed({k: f"d_{k}" for k in KEY}), (F.col("_r1") == F.col("d__r1")) & (F.col("_r2") == F.col("d__r2")) & F.col("doc_id").eqNullSafe(F.col("d_doc_id")))
    pairs = pairs.select(*KEY, "earlier", "lines", "words")
    found = pairs.mapInArrow(lambda b: _align(b, min_words), f"doc_id {kind}, _r1 long, _r2 long, places array<int>")
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_list("places"))))
    return found.groupBy(*KEY).agg(places.alias("places"))


def dedup_lines(docs: DataFrame, min_words: int = 8, min_line_words: int = 3) -> DataFrame:
    """Delete from every document the blocks of lines that align with an earlier document.

    Two documents overlap if they share a line of at least `min_line_words` words (hash of the line without outer
    blanks) or a run of shorter lines with such a line. Patience diff aligns them, and runs that it leaves are looked up exactly; runs of lines that follow each
    other in both, in any order and however often, and hold at least `min_words` words are deleted from the later
    one (greater doc_id; null last; equal ids by text). Words are counted as in `word_count`.

    Returns all columns of `docs` with the new text, plus n_lines (before) and n_removed; input columns of
    those names are replaced. Every row stays; a document whose lines all go has an empty text. Null text
    stays null (0 lines). Rows equal in doc_id and text are the same document and do not erase each other.
    """
    taken = common_lines(docs, min_words, min_line_words).withColumnsRenamed({k: f"_t{k}" for k in KEY}).withColumnRenamed("places", "_places")
    docs = with_identity(docs.drop("_r1", "_r2", "_places"))
    joined = docs.join(taken.hint("shuffle_hash"), (docs["_r1"] == taken["_t_r1"]) & (docs["_r2"] == taken["_t_r2"]) & docs["doc_id"].eqNullSafe(taken["_tdoc_id"]), "left")
    kept = F.filter(_lines(F.col("text")), lambda _, i: ~F.array_contains("_places", i))
    text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0))
    out = joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed", "_r1", "_r2")],
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).alias("n_lines"),
        F.coalesce(F.size("_places"), F.lit(0)).alias("n_removed"),
    )
    return out.withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
