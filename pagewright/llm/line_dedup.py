"""Line deduplication by pairwise alignment.

Documents are brought together by keys: the hashes of lines of LINE characters or more, and of the shortest runs of successive
lines, from each line on and up to each line, that have BLOCK characters. Any shared block of BLOCK characters is covered by
such runs, whatever its lines. Every key brings each later document together with the first that holds it: one pair a holder,
however rare or common the key. Each pair is aligned by patience diff (lines unique in both, their longest increasing run, then
the stretches between; a stretch without such lines is parted at its longest common block), and aligned blocks of enough
characters are deleted from the later document. Blocks that stand in another order in the other document are found by aligning
again what of the common runs is left, until nothing is.

So a pair deletes just what its common runs cover, and since the first holder of a run holds all its lines in a row, the pairs
of a document together delete every line that lies in a run which any earlier document holds, as all pairs would. More
holders, or documents that share nothing with it, don't change what a document loses.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, stash, text_or_empty

#: Characters of a line that can bring documents together, and of an aligned block from which it is deleted; alignments of a
#: pair, after which what is left of its common runs is deleted at once (what further ones would delete).
LINE, BLOCK, AGAIN = 24, 120, 16


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines unique within both stretches, as the longest run that increases in both."""
    ca: dict[int, int] = {}
    for i in range(a0, a1):
        ca[a[i]] = -1 if a[i] in ca else i
    cb: dict[int, int] = {}
    for j in range(b0, b1):
        if ca.get(b[j], -1) >= 0:
            cb[b[j]] = -1 if b[j] in cb else j
    pairs = sorted((ca[h], j) for h, j in cb.items() if j >= 0)
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = ends[at - 1] if at else -1
        tops[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _longest_block(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int, upto: list[int]) -> tuple[int, int, int]:
    """(start in a, start in b, lines) of the common block with most characters; upto sums the characters of a's lines. The
    suffix automaton of a's stretch reads b's once, so time is in proportion to both."""
    step, link, size, end = [{}], [-1], [0], [0]  # states: transitions, suffix link, longest string, where that first ends
    last = 0
    for i in range(a0, a1):
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(i + 1)
        p, c = last, a[i]
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] != size[p] + 1:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(end[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        last = new
    best, at, n = (0, (0, 0, 0)), 0, 0
    for j in range(b0, b1):
        while at and b[j] not in step[at]:
            at = link[at]
            n = size[at]
        if b[j] in step[at]:
            at, n = step[at][b[j]], n + 1
            weight = upto[end[at]] - upto[end[at] - n]
            if weight > best[0]:
                best = (weight, (end[at] - n, j + 1 - n, n))
    return best[1]


def patience(a: list[int], b: list[int], sizes: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Aligned positions of two sequences of line hashes, by patience diff. sizes: characters of a's lines (else each counts
    one); a stretch without a line unique in both is parted at its weightiest common block, as long as that has `least`."""
    upto = [0]
    for n in sizes if sizes is not None else [0] * len(a):
        upto.append(upto[-1] + n + 1)
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
        if a0 < a1 and b0 < b1:
            found = _anchors(a, b, a0, a1, b0, b1)
            if not found and upto[a1] - upto[a0] > least and not set(b[b0:b1]).isdisjoint(a[a0:a1]):
                i, j, n = _longest_block(a, b, a0, a1, b0, b1, upto)
                found = [(i + k, j + k) for k in range(n)] if upto[i + n] - upto[i] > least or sizes is None else []
            if not found:
                continue
            out += found
            edges = [(a0 - 1, b0 - 1), *found, (a1, b1)]
            todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def blocks(aligned: list[tuple[int, int]], sizes: list[int], least: int = BLOCK) -> list[tuple[int, int]]:
    """Runs start..end (exclusive) of the first sequence that are aligned without a gap in either, of enough characters."""
    out, i = [], 0
    while i < len(aligned):
        k = i
        while k + 1 < len(aligned) and aligned[k + 1] == (aligned[k][0] + 1, aligned[k][1] + 1):
            k += 1
        lo, hi = aligned[i][0], aligned[k][0] + 1
        if sum(sizes[lo:hi]) + (hi - lo - 1) >= least:
            out.append((lo, hi))
        i = k + 1
    return out


def runs(sizes: list[int], least: int = BLOCK) -> set[tuple[int, int]]:
    """The shortest runs start..end (exclusive) of enough characters, from each line on and up to each line. Together they
    cover every line of every block of enough characters with a run within the block."""
    upto = [0]
    for n in sizes:
        upto.append(upto[-1] + n + 1)
    out, e = set(), 1
    for i in range(len(sizes)):
        e = max(e, i + 1)
        while e < len(sizes) and upto[e] - upto[i] - 1 < least:
            e += 1
        if upto[e] - upto[i] - 1 < least:
            break
        out.add((i, e))
    i = 0
    for e in range(1, len(sizes) + 1):
        while i + 1 < e and upto[e] - upto[i + 1] - 1 >= least:
            i += 1
        if upto[e] - upto[i] - 1 >= least:
            out.add((i, e))
    return out


def run_keys(hashes: list[int], sizes: list[int], least: int = BLOCK) -> list[tuple[int, int, int]]:
    """(start, end, key) of the runs."""
    from array import array

    import xxhash

    if sum(sizes) + len(sizes) - 1 < least:
        return []
    raw = memoryview(array("q", hashes).tobytes())
    return [(i, e, xxhash.xxh64_intdigest(raw[8 * i : 8 * e], 1) - (1 << 63)) for i, e in runs(sizes, least)]


def deleted(a: list[int], sizes: list[int], b: list[int], b_sizes: list[int], least: int = BLOCK) -> list[tuple[int, int]]:
    """Stretches start..end (exclusive) of a's lines that stand in blocks of enough characters in b too, in whatever order."""
    gone, todo = set(), blocks(patience(a, b, sizes, least), sizes, least)
    there = {key for _, _, key in run_keys(b, b_sizes, least)}
    left = [(i, e) for i, e, key in run_keys(a, sizes, least) if key in there]
    for _ in range(AGAIN):
        gone.update(k for i, e in todo for k in range(i, e))
        left = [(i, e) for i, e in left if not gone.issuperset(range(i, e))]
        if not left:
            break
        open_ = {k for i, e in left for k in range(i, e)}
        # lines outside the runs that are left match nothing
        todo = blocks(patience([h if k in open_ else (1 << 64) + k for k, h in enumerate(a)], b, sizes, least), sizes, least)
    gone.update(k for i, e in left for k in range(i, e))
    out: list[list[int]] = []
    for k in sorted(gone):
        if out and out[-1][1] == k:
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1])
    return [(i, e) for i, e in out]


def lines_of(docs: DataFrame, line: int = LINE, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> doc_id, hashes array<long>, sizes array<int>, of all lines; keys array<long>, distinct, of
    lines of `line` characters or more and of runs."""

    def make():
        import xxhash

        digest = xxhash.xxh64_intdigest

        def keys(hashes, sizes):
            own = {h for h, n in zip(hashes, sizes, strict=True) if n >= line}
            own.update(key for i, e, key in run_keys(hashes, sizes, block) if e > i + 1 or sizes[i] < line)
            return list(own)

        def apply(cols):
            split = [(t or "").split("\n") for t in cols["text"]]
            hashes = [[digest(x.encode("utf-8", "replace")) - (1 << 63) for x in s] for s in split]
            sizes = [list(map(len, s)) for s in split]
            return {"doc_id": cols["doc_id"], "hashes": hashes, "sizes": sizes, "keys": list(map(keys, hashes, sizes))}

        return apply

    return map_texts(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, hashes array<long>, sizes array<int>, keys array<long>")


def overlaps(lines: DataFrame) -> DataFrame:
    """(later, earlier): each holder of a key with the key's first."""
    held = lines.select("doc_id", F.explode("keys").alias("hash"))
    # written first, so that the join deals both sides out anew and a common key's holders can be split among tasks
    first = stash(held.groupBy("hash").agg(F.min("doc_id").alias("earlier"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "earlier"), "lines-first")
    return held.join(first, "hash").where(F.col("doc_id") > F.col("earlier")).select(F.col("doc_id").alias("later"), "earlier").distinct()


def removed_lines(docs: DataFrame, line: int = LINE, block: int = BLOCK) -> DataFrame:
    """(doc_id, spans array<struct<start, end>>): the lines to delete from each document that loses some."""
    lines = stash(lines_of(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), line, block), "lines")
    pairs = overlaps(lines)
    early = lines.select(F.col("doc_id").alias("earlier"), F.col("hashes").alias("b"), F.col("sizes").alias("b_sizes"))
    late = lines.select(F.col("doc_id").alias("later"), F.col("hashes").alias("a"), "sizes")
    met = pairs.join(early, "earlier").join(late, "later").select("later", "a", "sizes", "b", "b_sizes")

    def make():
        def apply(cols):
            found = [deleted(*each, block) for each in zip(cols["a"], cols["sizes"], cols["b"], cols["b_sizes"], strict=True)]
            keep = [i for i, f in enumerate(found) if f]
            return {"doc_id": [cols["later"][i] for i in keep], "spans": [[{"start": x, "end": y} for x, y in found[i]] for i in keep]}

        return apply

    spans = map_texts(met, make, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<start: int, end: int>>")
    return spans.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def line_dedup(docs: DataFrame, line: int = LINE, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, kept_text, n_lines, n_removed, one row for each input row.

    Of a block of lines that two documents share, the one with the smaller doc_id keeps it. A null text counts as empty (one
    empty line). Rows that repeat a doc_id must repeat its text: they are one document and answered alike; rows without
    doc_id lose nothing. Lines within one document are not compared. Texts of any length are read whole; an empty table gives
    an empty result. Columns beyond doc_id and text are not read.
    """
    spans = removed_lines(docs, line, block)
    split = F.split(text_or_empty(), "\n", -1)
    cut = docs.select("doc_id", split.alias("ls")).join(spans, "doc_id", "left")
    kept = F.when(F.col("spans").isNull(), F.col("ls")).otherwise(F.filter("ls", lambda x, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"]))))
    out = cut.select("doc_id", "ls", kept.alias("kept"))
    return out.select("doc_id", F.array_join("kept", "\n").alias("kept_text"), F.size("ls").cast("long").alias("n_lines"), (F.size("ls") - F.size("kept")).cast("long").alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("n_chars_kept"), F.sha2("kept_text", 256).alias("kept_sha256"))
