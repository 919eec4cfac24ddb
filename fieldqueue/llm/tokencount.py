"""Token counts of whole texts by a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldqueue.llm.lean import lean

#: Characters encoded at once, and that two neighbouring chunks share at first; longer texts are spliced.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Runs of characters between white space whose counts a worker remembers.
MEMO = 1 << 19
LIMIT = 2048

@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def boundary(text: str, left, left_at: int, right, right_at: int, begin: int, end: int) -> tuple[int, int] | None:
    """Tokens of two overlapping chunks, later than the left one's `begin`, at which they may be spliced; None if there are none.

    Such a place follows white space, which no token crosses and no normalisation joins to what comes after,
    so that encoding starts afresh there; a token of both chunks starts there; and from it to the last word
    that ends before `end`, where the left chunk breaks off, both chunks have the same tokens.
    """
    last = end - 1
    while last > right_at and not text[last].isspace():
        last -= 1
    while last > right_at and text[last].isspace():
        last -= 1
    i2, j2 = left.char_to_token(last - left_at), right.char_to_token(last - right_at)
    if last <= right_at or i2 is None or j2 is None:
        return None
    ids, others = left.ids, right.ids
    for p in range(right_at + 1, last + 1):
        if text[p - 1].isspace() and not text[p].isspace():
            i, j = left.char_to_token(p - left_at), right.char_to_token(p - right_at)
            if i is None or j is None or i <= begin:
                continue
            if left.token_to_chars(i)[0] == p - left_at and right.token_to_chars(j)[0] == p - right_at and ids[i : i2 + 1] == others[j : j2 + 1]:
                return i, j
    return None


def spliced_count(text: str, encode: Callable[[str], object], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of a text of any length, from overlapping chunks; encode gives the library's encoding of a text.

    Where two chunks have no stable common boundary, their overlap doubles; where it would reach back over
    the left chunk, that chunk itself grows instead, in the end to the whole text.
    """
    total, begin, at, end = 0, 0, 0, min(len(text), chunk)
    left = encode(text[at:end])
    while end < len(text):
        wide, met = overlap, None
        while met is None and end - wide > at:
            right_at, right_end = end - wide, min(len(text), end - wide + max(chunk, 2 * wide))
            right = encode(text[right_at:right_end])
            met = boundary(text, left, at, right, right_at, begin, end)
            wide *= 2
        if met is None:
            end = min(len(text), end + (end - at))
            left = encode(text[at:end])
            continue
        total += met[0] - begin
        begin, at, end, left = met[1], right_at, right_end, right
    return total + len(left) - begin


#: Texts that tell whether a tokenizer encodes runs between white space by themselves.
PROBES = [a + s + b for a in ("ab", "A.", "é1", "12", "'s") for b in ("cd", "É", "34", "!", "") for s in (" ", "  ", "\n", " \n\t ", "\r\n")]


def runs_alone(encode: Callable[[str], object]) -> bool:
    """Whether a text has the tokens of its runs, white space none of its own, on PROBES."""
    return all(len(encode(p)) == sum(len(encode(run)) for run in p.split()) for p in PROBES)


class RunCounts(dict):
    """Tokens of each run of characters between ASCII white space.

    White space is a stable boundary, as in boundary(): no token, special token or normalisation reaches over
    it, so that a text has the tokens of its runs. `alone` is false for a tokenizer of which that isn't so, whose texts
    are encoded whole.
    """

    def __init__(self, encode: Callable[[str], object]):
        self.encode, self.alone = encode, runs_alone(encode)

    def __missing__(self, run: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[run] = n = len(self.encode(run.decode()))
        return n


@cache
def run_counts(path: str) -> RunCounts:
    """One a worker, which later tasks use again."""
    return RunCounts(partial(tokenizer(path).encode, add_special_tokens=False))


def counter(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = run_counts(path)
        for batch in batches:
            n = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                if text is None:
                    n.append(0)
                elif not counts.alone:
                    n.append(len(counts.encode(text)))
                elif len(text) > chunk:
                    n.append(spliced_count(text, counts.encode, chunk))
                else:
                    n.append(sum(map(counts.__getitem__, text.encode().split())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return lean(run)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text by the tokenizer file `path`, which every worker has at that place.

    Null and empty texts: 0 bytes, 0 tokens. Texts longer than `chunk` characters are encoded in overlapping
    chunks, so that memory doesn't grow with a text, and give the same counts as if encoded whole; of shorter
    ones each run between white space is encoded once a worker. Rows of one id each come back. Empty table: no
    rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(counter(path, chunk), schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(docs: DataFrame) -> DataFrame:
    """token_counts() by the public vocabulary word_bpe_49k.json."""
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
