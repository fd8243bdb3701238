"""Best-fit packing of tokenised documents into sequences, planned on a histogram of lengths.

A document is its token ids and one end id.  Documents over the sequence length are cut into whole sequences, the
first piece taking the remainder.  The plan packs counts, not documents: lengths from long to short, each as often as
it occurs, into the open sequences with the least room that is enough (best fit).  Sequences with equal room are kept
as runs, so planning takes steps in the number of lengths, whatever the number of documents.  A planned run says
"ranks a .. a+m of length L go to sequences s .. s+m at offset o"; documents find theirs by joining on their rank
within their length.  Ranks are counted in two levels (parts by hash, then rows within a part), so that a length that
a third of all documents share is no single task's work.

Only the histogram (at most ``sequence_length`` rows) and the plan (bounded by the histogram) visit the driver.

Tokens: ids are the tokenizers library's for the given file.  Text is cut before a space between two characters that
aren't white space, where byte-level pre-tokenising always cuts; ids of such chunks are kept in a bounded cache, and
new chunks are encoded with the file's own vocabulary by tiktoken, whose ids equal the library's (each worker compares
both on a few texts when it starts, and uses the library if they ever differ).

Defined results: null or empty text is its end id alone; the strings of special tokens in a text become those tokens, as
the library does unless told otherwise, or ordinary text with ``specials_are_text``; repeated rows are documents of their own; an empty table gives an empty plan and result; a null id is carried.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

CACHED_CHUNKS = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CUT = re.compile(r"(?<=\S) (?=\S)").split
ODD = re.compile(r"[^\S \n]").search
PROBES = ("", " ", "a", "It's we'll  x\n\n y 12 3,4 ...", "Écheau über ñandú 漢字 \U0001f600   \t z", "<|endoftext|> tail")


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str, specials_are_text: bool = False):
    """text -> ids, for a byte-level BPE file of the tokenizers library; and whether a text has to be encoded as a whole."""
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = specials_are_text
    slow = lambda text: library.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, letters = {x["content"] for x in spec.get("added_tokens", [])}, byte_letters()
    whole = (lambda text: False) if specials_are_text or not special else re.compile("|".join(map(re.escape, sorted(special)))).search
    try:
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        plain = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        fast = lambda text: slow(text) if whole(text) else plain(text)
        return (fast if all(fast(x) == slow(x) for x in PROBES) else slow), whole
    except (KeyError, ValueError):
        return slow, whole


class Chunks(dict):
    """ids (as bytes) of chunks that follow a space; emptied when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        ids = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


def token_pieces(docs: DataFrame, tokenizer: str, sequence_length: int = 2048, end_id: int = 0, text: str = "text", row_id: str = "doc_id", specials_are_text: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, whole = encoder(tokenizer, specials_are_text)
        chunks, end = Chunks(encode), np.array([end_id], "<u4").tobytes()
        width = 4 * sequence_length
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words.as_py() or ""
                parts = [words] if whole(words) else words.split(" ") if "  " not in words and " \n" not in words and "\n " not in words and words[:1] != " " and words[-1:] != " " and not ODD(words) else CUT(words)
                head = np.array(encode(parts[0]), "<u4").tobytes()
                ids = head + b"".join(map(chunks.__getitem__, parts[1:])) + end
                at, n = 0, 0
                while at < len(ids):
                    to = at + (len(ids) - at - 1) % width + 1 if at == 0 else at + width
                    for column, value in zip(out, (key, n, at // 4, (to - at) // 4, zlib.crc32(ids[at:to])), strict=True):
                        column.append(value)
                    at, n = to, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], sequence_length: int = 2048) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset) of a best-fit packing of so many pieces of each length."""
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(sequence_length + 1)]  # by room: (first sequence, sequences)
    rows, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, room = counts[length], 0, length
        while left:
            while room <= sequence_length and not open_runs[room]:
                room += 1
            if room > sequence_length:
                break
            first, n = open_runs[room].pop()
            m = min(n, left)
            rows.append((length, rank, m, first, sequence_length - room))
            if n > m:
                open_runs[room].append((first + m, n - m))
            open_runs[room - length].append((first, m))
            left, rank = left - m, rank + m
            room = min(room, max(length, room - length))
        fits = sequence_length // length
        for each, bins in ((fits, left // fits), (left % fits, 1)):
            if each and bins:
                for j in range(each):
                    rows.append((length, rank, bins, used, j * length))
                    rank += bins
                open_runs[sequence_length - each * length].append((used, bins))
                used += bins
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, sequence_length: int = 2048, salts: int = 256) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` must be a written table, as it is read three times."""
    dealt = pieces.withColumn("pk_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = materialize(dealt.groupBy("length", "pk_salt").agg(F.count("*").alias("pk_n")), "pack-counts")
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("pk_n")).collect()}
    rows = plan(counts, sequence_length)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = pieces.sparkSession.sparkContext.broadcast(rows)
    before = Window.partitionBy("length").orderBy("pk_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("pk_from", F.coalesce(F.sum("pk_n").over(before), F.lit(0))).drop("pk_n")
    rank = F.row_number().over(Window.partitionBy("length", "pk_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("pk_rank", rank.cast("long")).join(starts, ["length", "pk_salt"]).withColumn("pk_rank", F.col("pk_rank") + F.col("pk_from"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "pk_rank"))
            run = rows[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            sequence, offset = run[:, 3] + rank - run[:, 1], run[:, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "pk_rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, sequence_length: int = 2048, end_id: int = 0, text: str = "text", row_id: str = "doc_id", specials_are_text: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row a piece with its place."""
    return pack(materialize(token_pieces(docs, tokenizer, sequence_length, end_id, text, row_id, specials_are_text), "pieces"), sequence_length)
