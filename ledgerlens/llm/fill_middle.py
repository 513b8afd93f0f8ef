"""Fill-in-middle transformation by secondary sort.

A text is cut into units (lines with their line feed); two hashes of the
doc_id choose where prefix and middle end, two more whether and in which
form the text is rewritten.  Every document is emitted as pieces, chunks of
units, keyed by the document and their position in the output; a shuffle by
document with a sort inside the partitions (the DataFrame form of
repartitionAndSortWithinPartitions) brings them in output order, and a task
streams them into an incremental digest.  For the restoration the stream
is read by its sentinels, every piece gets its place in the text from
there, and a second sort inside the same partitions gives the text back.

A document is a doc_id with a text.  Rows that repeat both are counted
within a batch before the shuffle, and kept apart by the task that read
them, so repeated rows stay spread; each gives a row of the result.  No
task holds more than a piece of a text besides Spark's own sort, which
spills; only the first step has whole texts, one batch at a time, so very
long texts pass.  A null text is empty; a null doc_id hashes as ``7:``.  An
empty table gives an empty result.  Columns other than those named are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ready

SEED = 7
FIM_RATE = 100  # per cent of the documents that are rewritten
SPM_RATE = 50   # per cent of these in the form suffix, prefix, middle
PIECE = 1 << 15  # code points of a piece; a longer unit makes more than one
FLUSH = 1 << 22  # bytes of pieces that a task gathers for one Arrow batch

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = {m.encode(): k for k, m in enumerate((PREFIX, MIDDLE, SUFFIX))}  # by place in the text

_HEAD = pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                   ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                   ("copies", pa.int64()), ("output_sha256", pa.string())])
_PIECES = pa.schema([("doc", pa.binary()), ("lane", pa.int32()), ("at", pa.int64()),
                     ("data", pa.binary()), ("head", _HEAD)])
_PIECES_SQL = ("doc binary, lane int, at long, data binary, head struct<doc_id: long, n: long, "
               "form: string, prefix_chars: long, middle_chars: long, copies: long, "
               "output_sha256: string>")
_ROWS = pa.schema([*list(_HEAD), ("restored_sha256", pa.string())])
_ROWS_SQL = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, "
             "copies long, output_sha256 string, restored_sha256 string")


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The four numbers that decide on a document."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def split_form(doc_id: int | None, text: str, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE,
               seed: int = SEED) -> tuple[int, str, int, int]:
    """Units, form, and the code points where prefix and middle end (0 if plain)."""
    n = text.count("\n") + (text != "" and text[-1] != "\n")
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_rate:
        return n, "plain", 0, 0
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    ends, at = [0], 0
    for _ in range(second):
        at = text.find("\n", at) + 1 or len(text)
        ends.append(at)
    return n, "spm" if h4 % 100 < spm_rate else "psm", ends[first], ends[second]


def _chunks(text: str) -> Iterator[bytes]:
    """The text in chunks of whole units where a chunk can hold them."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.rfind("\n", at, end) + 1 or end
        yield text[at:end].encode()
        at = end


def output_pieces(text: str, form: str, a: int, b: int) -> Iterator[bytes]:
    """The pieces of the output in order; a sentinel is a piece of its own."""
    if form == "plain":
        yield from _chunks(text)
        return
    named = {"P": (PREFIX, text[:a]), "S": (SUFFIX, text[b:]), "M": (MIDDLE, text[a:b])}
    for key in ("PSM" if form == "psm" else "SPM"):
        mark, part = named[key]
        yield mark.encode()
        yield from _chunks(part)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``FLUSH`` bytes; column ``weight`` holds the bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + (len(r[weight] or b"") if weight is not None else 0)
        if size >= FLUSH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _emit(fim_rate: int, spm_rate: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for b in batches:
                copies: dict[bytes, int] = {}
                docs = list(zip(b.column("doc").to_pylist(), b.column("doc_id").to_pylist()))
                for doc, _ in docs:
                    copies[doc] = copies.get(doc, 0) + 1
                for (doc, doc_id), text in zip(docs, b.column("text")):
                    k = copies.pop(doc, 0)
                    if not k:
                        continue  # a repeated row of this batch
                    text = text.as_py()
                    n, form, a, c = split_form(doc_id, text, fim_rate, spm_rate, seed)
                    plain = form == "plain"
                    yield doc, lane, 0, None, {
                        "doc_id": doc_id, "n": n, "form": form, "copies": k,
                        "prefix_chars": None if plain else a, "middle_chars": None if plain else c - a}
                    for at, data in enumerate(output_pieces(text, form, a, c), 1):
                        yield doc, lane, at, data, None
        yield from _batches(rows(), _PIECES, 3)
    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pieces in order without those that a further batch of one task repeats.

    The copies that such batches counted are added up in the head, which
    comes first; a head is ``(doc, lane, head)``, a piece ``(doc, lane, data)``.
    """
    last, head = None, None
    for b in batches:
        short = [b.column(c).to_pylist() for c in ("doc", "lane", "at", "head")]
        for doc, lane, at, h, data in zip(*short, b.column("data")):
            if h:
                if last == (doc, lane, at):
                    head["copies"] += h["copies"]
                else:
                    if head:  # a document without pieces
                        yield head["key"], head, None
                    head = h | {"key": (doc, lane)}
            elif last != (doc, lane, at):
                if head:
                    yield head["key"], head, None
                    head = None
                yield (doc, lane), None, data.as_py()
            last = (doc, lane, at)
    if head:
        yield head["key"], head, None


def _digest_output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each output; its pieces with their places in the text, read off the sentinels."""
    def rows() -> Iterator[tuple]:
        head, sha, segment, at = None, None, 0, 0
        for key, h, data in _stream(batches):
            if h:
                if head:
                    yield *head.pop("key"), -1, None, head | {"output_sha256": sha.hexdigest()}
                head, sha, segment, at = h, hashlib.sha256(), 0, 0
                continue
            sha.update(data)
            if head["form"] != "plain" and data in _MARKS:
                segment = _MARKS[data]
            else:
                yield *key, (segment << 40) + at, data, None
                at += 1
        if head:
            yield *head.pop("key"), -1, None, head | {"output_sha256": sha.hexdigest()}
    return _batches(rows(), _PIECES, 3)


def _digest_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document from its pieces in the order of the text."""
    def rows() -> Iterator[tuple]:
        head, sha = None, None
        for _, h, data in _stream(batches):
            if h:
                if head:
                    yield *[head[f.name] for f in _HEAD], sha.hexdigest()
                head, sha = h, hashlib.sha256()
            else:
                sha.update(data)
        if head:
            yield *[head[f.name] for f in _HEAD], sha.hexdigest()
    return _batches(rows(), _ROWS)


def pieces(docs: DataFrame, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE,
           seed: int = SEED) -> DataFrame:
    """``doc, lane, at, data, head``: the outputs' pieces, in output order inside each partition.

    ``data`` of one (doc, lane), joined, is the output; ``head`` stands at 0.
    """
    ready(docs)
    text = F.coalesce("text", F.lit(""))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    rows = docs.select(F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("doc"),
                       F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return (rows.mapInArrow(_emit(fim_rate, spm_rate, seed), _PIECES_SQL)
            .repartition("doc", "lane").sortWithinPartitions("doc", "lane", "at"))


def fill_in_middle(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars`` and the digests
    ``output_sha256`` of the output and ``restored_sha256`` of the text rebuilt from it."""
    placed = pieces(docs, **kw).mapInArrow(_digest_output, _PIECES_SQL)
    done = placed.sortWithinPartitions("doc", "lane", "at").mapInArrow(_digest_text, _ROWS_SQL)
    return (done.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .drop("_copy", "copies"))
