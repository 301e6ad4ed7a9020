"""Secrets in texts: patterns, and novelty under a dictionary-primed compressor.

Three patterns give the base spans. Beside them, a run of key-like characters with a sensitive word shortly before or after it
is a candidate; its novelty is the number of bytes that it adds when the code around it is compressed with zstandard primed by
a dictionary, divided by its length. The dictionary holds the identifiers of usual configurations and the commonest
identifiers of the corpus (letters only, so that no secret can enter it), counted exactly, so that what is found doesn't depend
on how the corpus is partitioned. Words, paths and names that the surroundings or the dictionary
know compress well; random strings don't, and those are reported as kind `novel`. Other copies of the candidate are blanked
in its surroundings, or a secret that stands twice would hide itself; and a string over fewer characters (hexadecimal, or
digits and letters of one case) has fewer bits a character, so it needs less novelty.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

#: The base patterns, in the order of their kinds; the smallest length is of group 2 for assign, else of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so the length can be asked for at once
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Candidates, the words that make their context sensitive, characters of context for these and for the compressor, and the
#: marginal bytes a character from which a candidate of both cases is reported.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"key|auth|bearer|cred|pwd|passw|passphrase|secret|token|private|signature|session|cookie|salt|cert", re.ASCII | re.IGNORECASE)
NEAR, AROUND, NOVELTY = 48, 256, 0.75

#: Smaller alphabets (hexadecimal may be grouped by hyphens), and the share of that from which their strings are reported: about
#: where 98 of 100 random strings of 16 characters or more pass within code, as they do at NOVELTY for both cases.
ALPHABETS = ((re.compile(r"[0-9a-f-]+|[0-9A-F-]+"), 0.6), (re.compile(r"[0-9a-z]+|[0-9A-Z]+"), 0.77))

#: Identifiers of the corpus: their form, and how many of the commonest go into the dictionary.
WORD = re.compile(r"\b[A-Za-z_]{3,24}\b", re.ASCII)
TABLE = 2048
#: Different words that a task holds before it passes its counts on.
HELD = 1 << 18

IDENTIFIERS = """
import from return class self def function const let var public private static void string int bool true false null None
config configuration settings environment env export default value values name names type types list dict map set get put
post update delete create read write open close start stop begin end init load save parse format encode decode convert
username user_name user_id account account_id client client_id client_secret access access_key access_token refresh_token
auth authorization authentication bearer credential credentials password passwd passphrase secret secret_key api_key apikey
private_key public_key signature session session_id cookie csrf_token salt hash digest certificate token token_type expires_in
http https www com org net localhost example index html json xml yaml text application content_type user_agent header
headers request response status code message error exception warning debug info log logger server host port database
connection connection_string url uri path file filename directory folder home usr local bin share lib etc tmp var opt
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
"""


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    out = []
    low = text.encode("utf-8", "replace").lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"akia" in low:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def commonest(docs: DataFrame, table: int = TABLE, held: int = HELD) -> list[str]:
    """The `table` commonest identifiers that occur at least twice in all texts, commonest first, of equal ones the first by
    code points. Tasks pass on sums, by word, as soon as they hold `held` words; nothing is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(WORD.findall(text))
                if len(total) > held:
                    yield sums()
                    total.clear()
        yield sums()

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(table).collect()]  # `table` words at most


def dictionary(docs: DataFrame, table: int = TABLE) -> str:
    """The fixed identifiers and the `table` commonest ones of all texts, these at the end, where matches cost least."""
    return IDENTIFIERS + " ".join(reversed(commonest(docs, table)))


class Novelty:
    """Marginal compressed bytes of a string within its surroundings."""

    def __init__(self, dictionary: str = IDENTIFIERS):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=3)
        self.size = lambda s, c=zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False): len(c.compress(s.encode("utf-8", "replace")))

    def __call__(self, before: str, candidate: str, after: str) -> float:
        return (self.size(before + candidate + after) - self.size(before + after)) / max(1, len(candidate))


def least_share(candidate: str) -> float:
    """Share of the threshold that holds for the candidate's alphabet."""
    return next((share for alphabet, share in ALPHABETS if alphabet.fullmatch(candidate)), 1.0)


def is_name(candidate: str) -> bool:
    """Whether it is put together like a name, path or date: words of three letters or more but for one, numbers of four
    digits at most, and at most one number that touches a word. Such candidates are no secrets, however novel their words."""
    if sum(len(w) < 3 for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", candidate)) > 1:
        return False
    numbers = [m.span() for m in re.finditer("[0-9]+", candidate)]
    glued = sum(candidate[max(0, s - 1) : s].isalpha() or candidate[e : e + 1].isalpha() for s, e in numbers)
    return glued <= 1 and all(e - s <= 4 for s, e in numbers)


def surroundings(text: str, s: int, e: int) -> tuple[str, str]:
    """AROUND characters before and after text[s:e], other copies of it blanked, also those that the edge cuts."""
    run, blank = text[s:e], " " * (e - s)
    before = text[max(0, s - AROUND - len(run)) : s].replace(run, blank)
    return before[max(0, len(before) - AROUND) :], text[e : e + AROUND + len(run)].replace(run, blank)[:AROUND]


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty, threshold: float = NOVELTY) -> list[tuple[str, int, int]]:
    """Candidates that touch no base span, have a sensitive word near, mix letters with digits and don't compress."""
    out, taken = [], []
    for _, s, e in base:  # merged, so that their ends ascend too
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    ends = [e for _, e in taken]
    for m in RUN.finditer(text):
        s, e = m.span()
        at = bisect_right(ends, s)  # the first that ends after the candidate's start
        if (at < len(taken) and taken[at][0] < e) or not (SENSITIVE.search(text, max(0, s - NEAR), s) or SENSITIVE.search(text, e, e + NEAR)):
            continue
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and not is_name(run):
            before, after = surroundings(text, s, e)
            if novelty(before, run, after) >= threshold * least_share(run):
                out.append(("novel", s, e))
    return out


def secret_spans(docs: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, found array<struct<kind, start, end>>, one row for each input row.

    Spans are in code points, end exclusive, by start, then kind. A null text counts as empty and has no span. Whole texts
    are read; repeated rows are answered each and a null doc_id is given back; an empty table gives an empty result. Other
    columns are not read, so that their names can't clash.
    """
    words = dictionary(docs)  # at most TABLE identifiers of LONGEST characters beside the fixed ones

    def make():
        novelty = Novelty(words)

        def apply(cols):
            found = []
            for text in cols["text"]:
                base = base_spans(text) if text else []
                spans = sorted(base + (novel_spans(text, base, novelty, threshold) if text else []), key=lambda s: (s[1], KINDS.index(s[0])))
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            return {"doc_id": cols["doc_id"], "found": found}

        return apply

    return map_texts(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, found array<struct<kind: string, start: long, end: long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(base: bool) -> str:
        spans = "filter(found, s -> s.kind <> 'novel')" if base else "found"
        return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"

    counts = [f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint) as n_{k}" for k in KINDS]
    return found.selectExpr("doc_id", *counts[:3], f"sha2({joined(True)}, 256) as base_sha256", f"{joined(False)} as spans", counts[3])
