"""Benchmark decontamination by latent semantic retrieval.

Texts are split into words once; hashes of the words (four bytes each) go to shared files, which all later passes read.
Corpus and benchmark items are cut into passages of WINDOW words and weighted by TF-IDF; the inverse document frequencies
come from all passages of the corpus. A distributed randomised SVD (tasks sum their parts of A'AQ, the driver
orthonormalises a tall matrix of bounded size) of a bounded sample of the corpus's passages, together with the item passages,
gives a latent space of RANK dimensions, far fewer than passages. Every passage of every document that carries enough weight
is projected and compared by cosine with the item passages; candidates are then checked against the words: the longest common
subsequence must cover most of the item, and the item's answer, its rarest words, must be there.

An item passage of which the latent space keeps too little (its words hardly occur in the corpus) would be lost there: such
passages are searched in spaces of their own, of PART passages each, with as many dimensions as passages.

The benchmark is a stated query set and is taken in blocks of at most BLOCK_TERMS terms and BLOCK_PASSAGES passages; that
bounds what is broadcast (terms x RANK numbers, and terms of a part x PART for each part) whatever the size of corpus or
benchmark. A block costs two passes over the word hashes. An item that alone has more passages is searched in several blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from copy import copy
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, stash

#: Words of a passage and between starts, latent dimensions (and extra ones of the random start), corpus passages that the
#: space is fitted on (about), terms and passages of a block, passages of a part, seed.
WINDOW, STRIDE, RANK, EXTRA, FIT_PASSAGES, BLOCK_TERMS, BLOCK_PASSAGES, PART, SEED = 32, 16, 256, 16, 16_000, 1 << 15, 2048, 256, 5
#: Share of an item's weight (in its weightiest passage) that a passage must carry, cosine of a candidate in the latent space
#: and in a part's, share of its length that a passage must keep in the latent space.
WEIGHT, COSINE, PART_COSINE, FAINT = 0.5, 0.35, 0.2, 0.1
#: Share of the item's words that the common subsequence must have, share of the item's rarest words that are its answer,
#: share of these to be found.
COVERED, ANSWER, ANSWERED = 0.7, 0.25, 0.6

#: Power of the inverse frequency in a term's weight: above 1, rare words count for more.
POWER = 1.5

#: ASCII that is neither letter nor digit parts words.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Scripts written without blanks (Thai, Lao, Burmese, Khmer, Han, Kana and their marks); a character is a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3000-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uff0f\uff66-\uff9f\U00020000-\U0003ffff]")


def words(text: str | None) -> list[bytes]:
    """Lower-case words of a whole text, in UTF-8."""
    t = (text or "").lower()
    if not t.isascii() and _UNSPACED.search(t):
        t = _UNSPACED.sub(r" \g<0> ", t)
    return t.encode("utf-8", "replace").translate(_PARTS).split()


class Hashes(dict):
    """32-bit hashes of words; those met are kept, so many of them at most."""

    def __init__(self, most: int = 1 << 18):
        import xxhash

        self.digest, self.most = xxhash.xxh32_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.digest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        x = words(text)
        return np.fromiter(map(self.__getitem__, x), np.uint32, len(x))


def starts(n: int) -> range:
    """Where the passages of n words start: the last one holds the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)


class Block:
    """Some items, (name, word hashes) each: their words as term numbers."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.names = [i for i, _ in items]
        self.terms = np.unique(np.concatenate([x for _, x in items]))
        self.items = [np.searchsorted(self.terms, x).tolist() for _, x in items]
        self.passages = [(k, x[a : a + WINDOW]) for k, x in enumerate(self.items) for a in starts(len(x))]

    def numbers(self, raw: bytes) -> np.ndarray:
        """A text's word hashes -> term numbers; len(terms) stands for all other words."""
        x, n = np.frombuffer(raw, np.uint32), len(self.terms)
        at = np.minimum(np.searchsorted(self.terms, x), n - 1)
        return np.where(self.terms[at] == x, at, n)

    def parts(self, most: int) -> list[Block]:
        """The block itself, or of an item with more than `most` passages the same item with so many of them at a time."""
        out = []
        for at in range(0, len(self.passages), most):
            part = copy(self)
            part.passages = self.passages[at : at + most]
            out.append(part)
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_PASSAGES) -> Iterator[Block]:
    """Items in blocks of at most `most` passages, or of one item; items without words can't be found and are left out."""
    items, terms, passages, hashes = [], set(), 0, Hashes()
    for row in benchmark.select("item_id", "text").toLocalIterator():
        x = hashes.of(row["text"])
        own = set(x.tolist())
        if items and (len(terms | own) > BLOCK_TERMS or passages + len(starts(len(x))) > most):
            yield Block(items)
            items, terms, passages = [], set(), 0
        if len(x):
            items.append((row["item_id"], x))
            terms |= own
            passages += len(starts(len(x)))
    if items:
        yield Block(items)


def _summed(df: DataFrame, zero: np.ndarray, part) -> np.ndarray:
    """Sums part(batch) over all batches; tasks send one array of zero's shape each, merged in a tree."""
    shape, kind = zero.shape, zero.dtype

    def run(batches):
        total = zero.copy()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part(batch.slice(at, 256), total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    rows = df.mapInArrow(run, "total binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), kind).reshape(shape))
    return rows.treeReduce(np.add) if rows.getNumPartitions() else zero


def word_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, ids: hashes of each text's words, four bytes each. On shared files."""

    def make():
        hashes = Hashes()
        return lambda cols: {"doc_id": cols["doc_id"], "ids": [hashes.of(t).tobytes() for t in cols["text"]]}

    return stash(map_texts(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary"), "decontaminate-ids")


class Laid:
    """Texts' term numbers one after another on a grid of STRIDE words, a gap of other words after each, so that every passage
    starts on the grid and none holds words of two texts."""

    def __init__(self, block: Block, raws: list[bytes]):
        self.sizes = np.fromiter((len(r) // 4 for r in raws), np.int64, len(raws))
        self.counts = np.array([len(starts(n)) for n in self.sizes.tolist()], np.int64)  # passages
        room = np.where(self.sizes > 0, -(-self.sizes // STRIDE) * STRIDE + WINDOW, 0)
        self.base = np.cumsum(room) - room
        words = np.cumsum(self.sizes) - self.sizes
        self.ids = np.full(int(room.sum()) + WINDOW, len(block.terms))
        self.ids[np.repeat(self.base - words, self.sizes) + np.arange(int(self.sizes.sum()))] = block.numbers(b"".join(raws))
        self.text = np.repeat(np.arange(len(raws)), self.counts)  # of each passage
        first = np.cumsum(self.counts) - self.counts
        self.at = np.repeat(self.base - first * STRIDE, self.counts) + np.arange(len(self.text)) * STRIDE  # where it starts


def document_frequencies(ids: DataFrame, block: Block) -> np.ndarray:
    """For each term the passages of all documents that hold it; last, the number of passages."""
    n, sent = len(block.terms), ids.sparkSession.sparkContext.broadcast(block)  # bounded by the block

    def part(batch, total):
        laid = Laid(sent.value, batch.column(0).to_pylist())
        total[n] += laid.counts.sum()
        place = np.flatnonzero(laid.ids < n)
        if not len(place):
            return
        owner = np.searchsorted(laid.base, place, side="right") - 1  # texts without words share a base with the next
        key = owner * n + laid.ids[place]
        order = np.argsort(key, kind="stable")
        before = np.full(len(place), -1)  # where the text has the word before
        same = key[order][1:] == key[order][:-1]
        before[order[1:][same]] = place[order[:-1][same]]
        # a word stands in the last passage that starts before it, and in earlier ones that reach it; it counts where no
        # earlier one of its kind stands in the same passage
        last = np.minimum((place - laid.base[owner]) // STRIDE, laid.counts[owner] - 1)
        for back in range(WINDOW // STRIDE + 1):
            start = laid.base[owner] + (last - back) * STRIDE
            held = (last >= back) & (place - start < WINDOW) & (before < start)
            total[:n] += np.bincount(laid.ids[place[held]], minlength=n)

    return _summed(ids.select("ids"), np.zeros(n + 1, np.int64), part)


def weights_of(frequencies: np.ndarray) -> np.ndarray:
    """Inverse document frequencies to the power POWER."""
    return np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) ** POWER


def sampled_passages(ids: DataFrame, block: Block, passages: int, wanted: int = FIT_PASSAGES) -> DataFrame:
    """terms array<int>: about `wanted` of the corpus's passages, chosen by hashes of the texts, on shared files. A text gives
    its share of them, rounded up or down by its hash."""
    rate, sent = min(1.0, wanted / max(1, passages)), ids.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        import xxhash

        n = len(sent.value.terms)
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                at, h = starts(len(raw) // 4), xxhash.xxh3_64_intdigest(raw)
                count = int(len(at) * rate + h / 2**64)
                if count:
                    for k in np.random.default_rng(h).choice(len(at), min(count, len(at)), replace=False).tolist():
                        own = sent.value.numbers(raw[4 * at[k] : 4 * (at[k] + WINDOW)])
                        out.append(own[own < n].tolist())
            out = [t for t in out if t]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["terms"])

    return stash(ids.select("ids").mapInArrow(run, "terms array<int>"), "decontaminate-sample")


def latent_space(rows: DataFrame, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """rows (terms array<int>) -> orthonormal columns (terms x rank): the leading right singular space of the passages' TF-IDF
    matrix A, its rows of length 1.

    Tasks send their parts of A'AQ as one row a term that they hold, and the driver adds them one task after another, so it
    never holds more than its matrix and the part of one task.
    """
    spark, width = rows.sparkSession, min(rank + EXTRA, len(weights))
    q = np.linalg.qr(np.random.default_rng(SEED).normal(size=(len(weights), width)))[0].astype(np.float32)
    for _ in range(3):  # the random start and two power iterations
        sent = spark.sparkContext.broadcast((weights, q))

        def part(batches, sent=sent):
            weights, q = sent.value
            number, total = {}, []  # of a term: its row in total
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    t, n = np.unique(p, return_counts=True)
                    w = n * weights[t]
                    w = (w / max(np.linalg.norm(w), 1e-9)).astype(np.float32)
                    y = w @ q[t]
                    for i, x in zip(t.tolist(), w, strict=True):
                        if i not in number:
                            number[i] = len(total)
                            total.append(x * y)
                        else:
                            total[number[i]] += x * y
            yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.int32()), pa.array([v.tobytes() for v in total], pa.binary())], ["term", "row"])

        total = np.zeros(q.shape)
        for r in rows.mapInArrow(part, "term int, row binary").toLocalIterator():
            total[r["term"]] += np.frombuffer(r["row"], np.float32)
        q, r = np.linalg.qr(total)
        sent.destroy()
        # the leading directions of A'A within the span, in their order
        q = (q @ np.linalg.svd(r)[0]).astype(np.float32)
    return q[:, :rank]


def common_length(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    where: dict[int, int] = {}
    for i, t in enumerate(item):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for t in text:
        if m := where.get(t):
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


class Space:
    """Vectors of some terms, by term number, and the vectors of some item passages."""

    def __init__(self, vectors: np.ndarray, queries: np.ndarray, owner: np.ndarray, cosine: float, latent: bool, terms: np.ndarray | None = None):
        self.vectors, self.queries, self.owner, self.cosine, self.latent, self.terms = vectors, queries, owner, cosine, latent, terms

    def cosines(self, ids: np.ndarray, at: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Of the passages of ids that start at `at`, on the grid; mass: their squared lengths over all terms. In the latent space
        lengths are those there. Passages that overlap share the sums of STRIDE words that they are made of."""
        steps = np.unique(at[:, None] + np.arange(0, WINDOW, STRIDE))
        words = ids[steps[:, None] + np.arange(STRIDE)]
        sums = self.vectors[words if self.terms is None else self.terms[words]].sum(1)
        z = sum(sums[np.searchsorted(steps, at + k)] for k in range(0, WINDOW, STRIDE))
        length = np.linalg.norm(z, axis=1) if self.latent else np.sqrt(np.maximum(mass, 0))
        return (z @ self.queries.T) / np.maximum(length, 1e-9)[:, None]


def spaces(block: Block, weights: np.ndarray, latent: np.ndarray, limits: tuple[float, float, float] = (COSINE, PART_COSINE, FAINT)) -> list[Space]:
    """The latent space with the item passages that it keeps, and spaces for the rest."""
    n = len(weights)
    owner = np.array([k for k, _ in block.passages])
    vectors = np.concatenate([weights[:, None] * latent, np.zeros((1, latent.shape[1]))]).astype(np.float32)  # the last: other words
    queries = np.stack([vectors[p].sum(0) for _, p in block.passages])
    lengths = np.linalg.norm(queries, axis=1)
    own = []
    for _, p in block.passages:
        t, count = np.unique(p, return_counts=True)
        own.append((t, count * weights[t]))
    kept = lengths >= limits[2] * np.array([np.linalg.norm(w) for _, w in own])
    out = [Space(vectors, (queries / np.maximum(lengths, 1e-9)[:, None])[kept], owner[kept], limits[0], True)] if kept.any() else []
    rest = np.flatnonzero(~kept)
    for at in range(0, len(rest), PART):
        some = rest[at : at + PART]
        terms = np.unique(np.concatenate([own[i][0] for i in some]))
        a = np.zeros((len(some), len(terms)))
        for row, i in enumerate(some):
            a[row, np.searchsorted(terms, own[i][0])] = own[i][1] / max(np.linalg.norm(own[i][1]), 1e-9)
        basis = np.linalg.qr(a.T)[0]
        small = np.concatenate([weights[terms, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
        place = np.full(n + 1, len(terms), np.int32)
        place[terms] = np.arange(len(terms))
        out.append(Space(small, (a @ basis).astype(np.float32), owner[some], limits[1], False, place))
    return out


class Search:
    """Hits of a block's items in texts; made once a task."""

    def __init__(self, block: Block, weights: np.ndarray, found_in: list[Space]):
        self.block, self.weights, self.spaces = block, weights, found_in
        self.mass = np.concatenate([weights**2, [0.0]])
        self.least = np.zeros(len(block.items))  # by item, of its weightiest passage; its short last one may carry little
        for k, p in block.passages:
            self.least[k] = max(self.least[k], WEIGHT * float(self.mass[p].sum()))
        own = sorted({k for k, _ in block.passages})
        self.lightest = min(self.least[own])
        self.answers = []
        for x in block.items:
            rare = sorted(set(x), key=lambda t: (-weights[t], t))
            self.answers.append(set(rare[: max(2, round(ANSWER * len(rare)))]))
        self.sets = [np.unique(x) for x in block.items]

    def hits(self, raws: list[bytes]) -> list[tuple[int, int, int, float, float]]:
        """raws: word hashes of texts -> (text, item, first word of the passage, share of the item found, cosine), the best of each
        item in each text."""
        laid = Laid(self.block, raws)
        ids, upto = laid.ids, np.concatenate([[0], np.cumsum(self.mass[laid.ids])])
        mass = upto[laid.at + WINDOW] - upto[laid.at]
        enough = mass >= self.lightest
        at, text, mass = laid.at[enough], laid.text[enough], mass[enough]
        best: dict[tuple[int, int], tuple[int, float, float]] = {}
        checked: set[tuple[int, int, int]] = set()  # stretches, by item: long items' passages lead to the same ones
        for lo in range(0, len(at), 512):
            some, own = at[lo : lo + 512], mass[lo : lo + 512]
            for space in self.spaces:
                cos = space.cosines(ids, some, own)
                for i, j in np.argwhere((cos >= space.cosine) & (own[:, None] >= self.least[space.owner][None, :])).tolist():
                    k, a, t = int(space.owner[j]), int(some[i]), int(text[lo + i])
                    item, begin = self.block.items[k], int(laid.base[t])
                    stretch = (k, max(begin, a - len(item)), min(begin + int(laid.sizes[t]), a + WINDOW + len(item)))
                    if stretch in checked or best.get((t, k), (0, 0.0))[1] == 1:
                        continue
                    checked.add(stretch)
                    near = ids[stretch[1] : stretch[2]]
                    known = self.sets[k]  # of the common subsequence no more than the words in common
                    if (known[np.minimum(np.searchsorted(known, near), len(known) - 1)] == near).sum() < COVERED * len(item):
                        continue
                    near = near.tolist()
                    share = common_length(item, near) / len(item)
                    if share >= COVERED and len(self.answers[k].intersection(near)) >= ANSWERED * len(self.answers[k]) and share > best.get((t, k), (0, 0.0))[1]:
                        best[t, k] = (a - begin, share, min(1.0, float(cos[i, j])))
        return [(*x, *b) for x, b in sorted(best.items())]


def contamination(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, most: int = BLOCK_PASSAGES) -> DataFrame:
    """docs (doc_id, text, any more), benchmark (item_id, text, any more) -> doc_id, item_id, start_word, coverage, cosine:
    a row for each item found in a document, none for clean documents.

    Null and empty texts hold nothing and are found nowhere; texts and items of any length are read whole. Rows that repeat a
    doc_id or an item_id are answered each; a null doc_id or item_id is given back. Of passages that hold an item equally well
    the first counts. With an empty benchmark or no documents the result is empty. Other columns are not read, so that their
    names can't clash.
    """
    spark = docs.sparkSession
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, start_word long, coverage double, cosine double"
    names = ("doc_id", "item_id", "start_word", "coverage", "cosine")

    def search(ids: DataFrame, part: Block, weights: np.ndarray, latent: np.ndarray) -> DataFrame:
        """row (where ids has it) and what is found of one part."""
        sent = spark.sparkContext.broadcast((part, weights, spaces(part, weights, latent)))  # bounded by the block
        kept = ("row", *names) if "row" in ids.columns else names

        def make():
            search = Search(*sent.value)

            def apply(cols):
                given = [cols[c] for c in kept if c in cols]
                rows = [(*(c[t] for c in given), search.block.names[k], a, share, cos) for t, k, a, share, cos in search.hits(cols["ids"])]
                return dict(zip(kept, zip(*rows, strict=True) if rows else [[]] * len(kept), strict=True))

            return apply

        return map_texts(ids, make, f"row long, {schema}" if "row" in kept else schema)

    ids, numbered, out = None, None, None
    for block in blocks(benchmark, most):
        ids = word_hashes(docs) if ids is None else ids
        frequencies = document_frequencies(ids, block)
        weights = weights_of(frequencies)
        items = spark.createDataFrame([(p,) for _, p in block.passages], "terms array<int>").repartition(4)
        latent = latent_space(sampled_passages(ids, block, int(frequencies[-1])).unionByName(items), weights, rank)
        parts = block.parts(most)
        if len(parts) == 1:
            found = search(ids, block, weights, latent)
        else:  # one item: of what its parts find in a row of docs the best stays
            numbered = stash(ids.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows") if numbered is None else numbered
            each = reduce(DataFrame.unionByName, [search(numbered, part, weights, latent) for part in parts])
            best = F.max_by(F.struct(*names), F.struct("coverage", -F.col("start_word"), "cosine"))
            found = each.groupBy("row").agg(best.alias("best")).select("best.*")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
