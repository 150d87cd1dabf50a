"""Token ids as Parquet list columns.

Layout: files in ascending id order (a range exchange, then a sort in each partition), one row a document with
its ids as ``list<int32>``. Ids repeat, so they are dictionary-encoded; where a dictionary grows too large the
version-2 writer falls back to delta packing. Row groups, pages and rows a page are set so that the page index
lets a reader take a range of documents, or only the narrow columns, without touching other pages.

Defined results: null or blank text gives the end id alone; very long texts are encoded whole, word by word;
equal ids (repeated rows) stay as separate rows, those of one id in the order of their texts; an empty table gives an empty file set and no rows; other
columns of the input do not take part unless named in ``keep`` (names of the file's own columns raise an error).
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
SLICE_BYTES = 8 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Pre-tokenizer patterns under which no token spans white space or the border of a letter or digit and a mark.
BY_WORD = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})


class Encoder:
    """Encodes texts piece by piece at ASCII white space, remembering the ids of pieces.

    Where the vocabulary's pre-tokenizer drops white space and no token spans it, the ids of a text are those of its
    pieces in order; A-Z may be lower-cased first where the normaliser does so, and one mark that ends a piece of
    letters encodes by itself. Arrow splits the texts and finds the distinct pieces, the library encodes those that
    are not yet known, and the ids of the texts are gathered from theirs. Texts that hold a special token's opening,
    and vocabularies of other kinds, are encoded whole by the library.

    At ``limit`` pieces only the short ones, which are the frequent ones, are kept.
    """

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {b"": b""}
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        first = ((form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = first.get("behavior") == "Removed" and (first.get("pattern") or {}).get("Regex") in BY_WORD
        self.lowers = any(n.get("type") == "Lowercase" for n in (form.get("normalizer") or {}).get("normalizers", []))
        self.special = all(t["content"].startswith("<|") for t in form.get("added_tokens", []))

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """The one of this worker process, which serves many tasks."""
        return common.kept(f"encoder {path}", lambda: cls(path))

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece."""
        if len(self.known) > self.limit:
            self.known = {p: v for p, v in self.known.items() if len(p) <= 9}
            if len(self.known) > self.limit // 2:
                self.known = {b"": b""}
        known = self.known
        cut = [p[-1:] if p[-1:] in MARKS_AT_END and p[-2:-1].isalnum() else b"" for p in pieces]
        stems = [p[:-1] if c else p for p, c in zip(pieces, cut, strict=True)]
        new = list({*stems, *cut}.difference(known))
        for i in range(0, len(new), 20_000):
            known.update(zip(new[i : i + 20_000], self._ids(new[i : i + 20_000]), strict=True))
        return [known[p] + known[c] if c else known[p] for p, c in zip(stems, cut, strict=True)]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); null: none."""
        texts = texts.fill_null("")
        if not self.by_word or not self.special:
            return self._joined(self._ids([t.encode() for t in texts.to_pylist()]))
        odd = np.flatnonzero(pa.compute.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        if len(odd):
            plain = pa.array([None if i in (bad := set(odd.tolist())) else t for i, t in enumerate(texts.to_pylist())], pa.string())
            ids, n = self.column(plain)
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i, x in zip(odd.tolist(), self._ids([texts[i].as_py().encode() for i in odd.tolist()]), strict=True):
                parts[i] = np.frombuffer(x, np.uint32)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        if self.lowers:
            texts = pa.compute.ascii_lower(texts)
        split = pa.compute.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, n = self._joined(self._pieces(coded.dictionary.cast(pa.binary()).to_pylist()))
        index = coded.indices.to_numpy(zero_copy_only=False)
        counts = n[index]
        ends = np.cumsum(counts)
        starts = np.concatenate([[0], np.cumsum(n)])[:-1] if len(n) else np.zeros(0, np.int64)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((starts[index] - (ends - counts)).astype(np.int32), counts)
        at += np.arange(total, dtype=np.int32)
        out = ids[at]
        borders = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return out, np.diff(borders)

    @staticmethod
    def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


#: Columns of the files beside the id and what is kept.
OWN = frozenset({"ids", "n_tokens", "place", "part"})
MARKS_AT_END = frozenset(b"%c" % c for c in b".,;:!?")


def slices(column: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most_bytes`` at most (one row at least)."""
    start, held = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + n > most_bytes:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, *keep, ids array<int>, n_tokens, place) of each row; partitioning and order of rows are kept.

    ``place``: ids of the rows before it in its partition.
    """
    kept = [id_col, *keep]
    if OWN & {c.lower() for c in kept}:
        raise ValueError(f"columns of the token files: {sorted(OWN)}")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", ids array<int>, n_tokens bigint, place bigint"

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, at = Encoder.of(tokenizer), 0
        for batch in batches:
            texts = batch.column(len(kept))
            for a, b in slices(texts, SLICE_BYTES):
                ids, n = encoder.column(texts.slice(a, b - a))
                flat = np.insert(ids.astype(np.int32), np.cumsum(n), end_id)
                ends = np.cumsum(n + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), lists, pa.array(n + 1), pa.array(at + ends - n - 1)], names=[*kept, "ids", "n_tokens", "place"])
                at += len(flat)

    return common.arrow(docs.select(*kept, F.col(text_col).alias("__text")), run, schema)


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write the token file set of ``docs`` in ascending id order.

    ``part`` numbers the files in id order, so positions over all documents follow from one total a file.
    """
    cols = [id_col, *keep, text_col]
    ordered = docs.select(*dict.fromkeys(cols))
    ordered = ordered.repartitionByRange(*([files] if files else []), F.col(id_col).asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first())
    (
        encode(ordered, tokenizer, end_id, id_col, text_col, keep)
        .withColumn("part", F.spark_partition_id())
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("compression", "snappy")
        .parquet(path)
    )


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, low=None, high=None, id_col: str = "doc_id") -> DataFrame:
    """Chosen columns of documents in [low, high]; both limits reach the row groups and pages."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.filter(F.col(id_col) >= low)
    if high is not None:
        df = df.filter(F.col(id_col) <= high)
    return df.select(*columns) if columns else df


def checksums(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, part, place, n_tokens, ids_crc32) from the stored lists."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=[id_col, "part", "place", "n_tokens", "ids_crc32"])

    return common.arrow(tokens.select(id_col, "part", "place", "ids"), run, f"`{id_col}` {kind}, part int, place bigint, n_tokens bigint, ids_crc32 bigint")


def positions(counted: DataFrame) -> DataFrame:
    """Adds ``start``: tokens of all documents before it, from one total a file and the place that the file holds."""
    totals = counted.groupBy("part").agg(F.sum("n_tokens").alias("__total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    bases = totals.select("part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    return counted.join(bases, "part").withColumn("start", F.col("__base") + F.col("place")).drop("__base")


def token_digest(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write the token files, read them back and give doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or common.scratch(spark, "tokens")
    write(docs, path, tokenizer or default_tokenizer())
    stored = read(spark, path, ["doc_id", "part", "place", "ids"])
    return positions(common.materialise(checksums(stored), "token-sums")).select("doc_id", "start", "n_tokens", "ids_crc32")
