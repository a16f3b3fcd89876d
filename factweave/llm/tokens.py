"""Encoding documents with a public tokenizer, and operator 7, the exact length histogram.

Where a vocabulary drops white space and splits as is checked here (BPE with word ends), a text's ids are those of its words
one after the other. A batch's distinct words are encoded once and kept in a bounded cache per worker; the ids of
documents are gathered with numpy. Any other tokenizer is given whole texts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, materialize, read_table

#: Fixed id that ends a document.
END = 1
#: Text of about so many bytes is worked on at once, so a worker's memory doesn't follow the size of Spark's batches.
STEP_BYTES = 6_000_000
#: Punctuation that the vocabulary's own splitting always parts from a letter or digit before it.
TRIMMED = ".,!?;:#*$%&|"
#: Such letters and digits, which lower-casing turns into one letter or digit.
PARTED = "[a-z0-9À-ÖØ-öø-ÿ]$"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of `column`, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right"))
        yield batch.slice(at, max(1, end - at))
        at = max(at + 1, end)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word in turn, where each text's words start and the last end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:
        there = codes != empty
        starts = np.concatenate([[0], np.cumsum(there)])[starts]
        codes = codes[there]
    return distinct, codes, starts.astype(np.int64)


#: How a vocabulary must normalise and split for its words to be encoded one by one.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class TextIds:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, json_text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)

    def encode(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, the number of ids of each)."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(items), 5_000):
            got = [x.ids for x in self.tokenizer.encode_batch_fast(items[at : at + 5_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((i for x in got for i in x), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each part, the number of each part in turn, where each text's parts start and the last end)."""
        ids, sizes = self.encode(pc.fill_null(texts, "").to_pylist())
        return ids, sizes, np.arange(len(sizes)), np.arange(len(sizes) + 1)


class WordIds(TextIds):
    """Ids of words. Those of words met before are kept, in arrays of about `most` bytes, of which the older half goes when they are full."""

    def __init__(self, json_text: str, most: int = 80_000_000):
        super().__init__(json_text)
        self.most = most
        self.known, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def places(self, items: pa.Array) -> np.ndarray:
        """Where each of `items` (distinct) is kept."""
        if self.known.nbytes + self.ids.nbytes + self.ends.nbytes > self.most:
            half = len(self.known) // 2
            self.known, self.ids, self.ends = pa.concat_arrays([self.known[half:]]), self.ids[self.ends[half] :].copy(), self.ends[half:] - self.ends[half]
        at = pc.index_in(items, value_set=self.known)
        new = items.filter(pc.is_null(at))
        if len(new):
            ids, sizes = self.encode(new.to_pylist())
            at = pc.replace_with_mask(at, pc.is_null(at), pa.array(np.arange(len(new)) + len(self.known), pa.int32()))
            self.known, self.ids = pa.concat_arrays([self.known, new]), np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return at.to_numpy(zero_copy_only=False)

    def of(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids of each of `items` start among all that are kept, how many they are)."""
        coded = items.dictionary_encode()
        at = self.places(coded.dictionary)[coded.indices.to_numpy()]
        return self.ends[at], self.ends[at + 1] - self.ends[at]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-casing A-Z and parting final punctuation first makes fewer words and changes no id: the vocabulary lower-cases, and never
        joins a letter or digit with what follows it here. Words that could hold a special token are left alone."""
        distinct, codes, starts = words(texts)
        plain = pc.invert(pc.match_substring(distinct, "<|"))
        low = pc.if_else(plain, pc.ascii_lower(distinct), distinct)
        core = pc.ascii_rtrim(low, characters=TRIMMED)
        core = pc.if_else(pc.and_(plain, pc.match_substring_regex(core, PARTED)), core, low)
        cut = pc.not_equal(pc.binary_length(low), pc.binary_length(core))
        parted = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        ends = [x[len(y) :] for x, y in zip(low.filter(cut).to_pylist(), core.filter(cut).to_pylist(), strict=True)]
        parts = pa.concat_arrays([core, pa.array(ends, pa.large_string())])
        begin, size = self.of(parts)
        # a word's ids are those of its core, then those of its end
        word = np.concatenate([np.arange(len(core)), parted])
        order = np.argsort(word, kind="stable")
        begin, size = begin[order], size[order]
        sizes = np.bincount(word[order], weights=size, minlength=len(core)).astype(np.int64)
        at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        return self.ids[at], sizes, codes, starts


_loaded: dict[int, TextIds] = {}


def word_ids(json_text: str) -> TextIds:
    """One for each vocabulary in a worker, kept from task to task. Words are encoded one by one only where the vocabulary splits as NORMAL and SPLIT say."""
    key = zlib.crc32(json_text.encode())
    if key not in _loaded:
        read = json.loads(json_text)
        first = ((read.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        by_word = read.get("normalizer") == NORMAL and first.get("pattern") == {"Regex": SPLIT} and read["model"].get("end_of_word_suffix") == "</w>"
        _loaded[key] = (WordIds if by_word else TextIds)(json_text)
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str | None):
    """The tokenizer's file (a few MB) as a broadcast, so executors need no such path."""
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def lengths(texts: pa.Array, encode: TextIds) -> np.ndarray:
    _, sizes, codes, starts = encode.texts(texts)
    return np.diff(np.concatenate([[0], np.cumsum(sizes[codes])])[starts])


def encoded(texts: pa.Array, encode: TextIds) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each ended by END; where each text's ids start and the last end)."""
    flat, sizes, codes, starts = encode.texts(texts)
    first = np.cumsum(sizes) - sizes
    each = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(ends[-1]) + np.repeat(first[codes] - ends[:-1], each)
    bounds = ends[starts]
    ids = np.insert(flat[at], bounds[1:], END) if len(bounds) > 1 else flat[at]
    return ids, bounds + np.arange(len(bounds))


def length_histogram(docs: DataFrame, *, tokenizer: str | None = None, end: bool = True, span: int = 1024) -> DataFrame:
    """A row for each length that a document has, counting its end token where `end` is set: length, docs, tokens, and over all documents at
    least that long docs_from and tokens_from, and over all documents truncated_total, the tokens that a context limit of
    `length` leaves, and share_below, the share of documents shorter than it.

    Null and empty texts have no tokens but the end; repeated rows count each; texts of any length are encoded whole. Columns
    but the text, whatever their names, are left out. An empty table gives no rows. Suffix sums are taken in spans of
    `span` lengths and carried on from one to the next, so no task orders all lengths.
    """
    vocab = vocabulary(docs.sparkSession, tokenizer)
    extra = int(end)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocab.value)
        for batch in batches:
            for part in steps(batch):
                got = np.unique(lengths(part.column("text"), encode) + extra, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["length", "docs"])

    rows = in_arrow(docs.select(F.col("text").cast("string").alias("text")), count, "length long, docs long")
    rows = rows.groupBy("length").agg(F.sum("docs").alias("docs")).withColumn("tokens", F.col("length") * F.col("docs")).withColumn("span", F.floor(F.col("length") / span))
    rows = materialize(rows, "lengths")
    spans = rows.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))  # longest text / span rows
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("later_tokens"))
    totals = rows.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    inside = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("d", F.sum("docs").over(inside)).withColumn("t", F.sum("tokens").over(inside)).join(spans, "span").join(F.broadcast(totals))
    out = out.withColumn("docs_from", F.col("d") + F.col("later_docs")).withColumn("tokens_from", F.col("t") + F.col("later_tokens"))
    return out.select(
        "length", "docs", "tokens", "docs_from", "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        (1 - F.col("docs_from") / F.col("all_docs")).alias("share_below"),
    )


def totals(histogram: DataFrame, limits: list[int], quantiles: list[float]) -> DataFrame:
    """(kind, at, value): total tokens at each context limit, and the smallest length that a share of documents doesn't pass. Exact, from a
    histogram; an empty one gives nulls."""
    parts = [histogram.agg(F.sum(F.least(F.col("length"), F.lit(x)) * F.col("docs")).alias("value")).select(F.lit("limit").alias("kind"), F.lit(float(x)).alias("at"), "value") for x in limits]
    share = F.col("share_below") + F.col("docs") / (F.col("docs_from") / (1 - F.col("share_below")))
    parts += [histogram.where(share >= F.lit(q - 1e-12)).agg(F.min("length").alias("value")).select(F.lit("quantile").alias("kind"), F.lit(q).alias("at"), "value") for q in quantiles]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(read_table(spark, sf_dir, "documents"))


def pieces(docs: DataFrame, *, tokenizer: str | None = None, most: int = 4096, key: str = "doc_id") -> DataFrame:
    """Documents cut into pieces of at most `most` tokens: key, piece, start, length, ids_crc32 and spread, a number that tells repeated rows apart."""
    vocab = vocabulary(docs.sparkSession, tokenizer)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("piece", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "spread")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = word_ids(vocab.value), 0
        for batch in batches:
            for part in steps(batch):
                ids, bounds = encoded(part.column("text"), encode)
                n = np.diff(bounds)
                count = -(-n // most)
                doc = np.repeat(np.arange(len(n)), count)
                no = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = no * most
                size = np.minimum(most, n[doc] - start)
                raw = np.ascontiguousarray(ids, "<u4")
                low = bounds[doc] + start
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), (low + size).tolist(), strict=True)]
                keys = part.column(key).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, t) for x, t in ((no, pa.int32()), (start, pa.int64()), (size, pa.int64()), (crc, pa.int64()), (row + np.arange(len(doc)), pa.int64()))]], [key, "piece", "start", "length", "ids_crc32", "spread"])
                row += len(doc)

    return in_arrow(docs.select(key, F.col("text").cast("string").alias("text")), cut, schema)
