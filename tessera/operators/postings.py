"""A token index beside a table of texts: posting lists that let a search skip most files, and the exact test after it.

Words (runs of letters, digits and _, in lower case) and the character trigrams of lower-cased texts are kept in posting rows (token, block, keys). A block
is a hash range of keys, so lists are of bounded length whatever a token's frequency, and lists of several tokens meet block by
block without shuffling keys one by one. Posting files are sorted by token with bloom filters: a search reads row groups of its tokens only.

`tokens` finds texts that hold every word of a needle; `contains` finds texts that hold the needle as it stands, in any case: candidates
hold all of its trigrams, and each candidate is then tested, so results are those of a scan. Needles of fewer than three characters, and all where trigrams weren't
indexed, are scanned for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import dropped, written

#: Keys of a block, about; pairs of token and key that a task holds before it passes lists on.
BLOCK_KEYS, HELD_PAIRS = 8_192, 1 << 20
WORD = r"[^\p{L}\p{Nd}_]+"


def words(column: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(column), WORD), lambda w: w != ""))


def needle_words(text: str) -> list[str]:
    return sorted({w for w in regex.split(WORD, text.lower()) if w})


def _coded(text: str) -> np.ndarray:
    """Distinct trigrams of a text as numbers, 21 bits a character."""
    x = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:])


def _spelled(codes: np.ndarray) -> pa.Array:
    """The tokens of trigrams: t and its characters."""
    low = (1 << 21) - 1
    letters = np.stack([np.full(len(codes), ord("t")), codes >> 42, codes >> 21 & low, codes & low], 1).astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([letters[i : i + 4] for i in range(0, len(letters), 4)], pa.string())


def _trigram_lists(batches):
    """key, _block, low (a text in lower case) -> (token, _block, keys), as _partial_lists gives them, without a string for each pair of token and text."""
    keys: list[pa.Array] = []
    blocks: list[np.ndarray] = []
    found: list[np.ndarray] = []
    pairs = 0

    def lists() -> pa.RecordBatch:
        code, row = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
        block = np.concatenate(blocks)[row]
        order = np.lexsort((code, block))  # stable, so rows stay in order
        code, row, block = code[order], row[order], block[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        each = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.concat_arrays(keys).take(pa.array(row)))
        return pa.RecordBatch.from_arrays([_spelled(code[first]), pa.array(block[first], pa.int32()), each], ["token", "_block", "keys"])

    for whole in batches:
        for at in range(0, whole.num_rows, 32):
            batch = whole.slice(at, 32)
            keys.append(batch.column("key"))
            blocks.append(batch.column("_block").to_numpy())
            found += [_coded(t) for t in batch.column("low").to_pylist()]
            pairs += sum(len(x) for x in found[-batch.num_rows :])
            if pairs >= HELD_PAIRS:
                yield lists()
                keys, blocks, found, pairs = [], [], [], 0
    if pairs:
        yield lists()


def _partial_lists(batches):
    """key, _block, tokens -> (token, _block, keys): lists of a task's texts, combined before the shuffle so that a frequent token isn't a row per text."""
    held: list[pa.RecordBatch] = []
    pairs = 0

    def lists() -> pa.RecordBatch:
        both = pa.Table.from_batches(held).combine_chunks()
        found = both.column("tokens").combine_chunks()
        row = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
        codes = found.flatten().dictionary_encode()
        block, code = both.column("_block").to_numpy()[row], codes.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((row, code, block))
        row, block, code = row[order], block[order], code[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])]) if len(row) else row
        keys = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), both.column("key").combine_chunks().take(pa.array(row)))
        return pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(code[first])), pa.array(block[first], pa.int32()), keys], ["token", "_block", "keys"])

    for batch in batches:
        held.append(batch)
        pairs += len(batch.column("tokens").flatten())
        if pairs >= HELD_PAIRS:
            yield lists()
            held, pairs = [], 0
    if pairs:
        yield lists()


def needle_trigrams(text: str) -> list[str]:
    low = text.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def has_words(column: Column, needle: str) -> Column:
    """The exact test of `tokens`: every word of the needle is a word of the text; a needle without words matches nothing."""
    wanted = needle_words(needle)
    return F.coalesce(F.size(F.array_intersect(words(column), F.array(*map(F.lit, wanted)))) == len(wanted), F.lit(False)) if wanted else F.lit(False)


def has_text(column: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, texts: DataFrame, key: str, body: str, files: int | None = None, substrings: bool = True) -> None:
        """texts: the rows to find, written beside the index in blocks; null keys stay out. substrings: also index trigrams, which `contains` needs
        and which are by far the larger part."""
        kept = texts.where(F.col(key).isNotNull())
        blocks = max(1, math.ceil(kept.count() / BLOCK_KEYS))
        placed = kept.withColumn("_block", F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int"))
        files = files or max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        placed.repartitionByRange(files, "_block", key).sortWithinPartitions("_block", key).write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{self.path}/texts")
        # The written texts lie by block, so a task's lists are of one or two blocks and hardly shorter than the merged ones.
        held = self.texts().where(F.col(body).isNotNull()).select(F.col(key).alias("key"), "_block", F.col(body).alias("body"))
        kind = held.schema["key"].dataType.simpleString()
        each = held.select("key", "_block", F.transform(words(F.col("body")), lambda w: F.concat(F.lit("w"), w)).alias("tokens"))
        row = f"token string, _block int, keys array<{kind}>"
        parts = each.mapInArrow(_partial_lists, row)
        if substrings:
            parts = parts.unionByName(held.select("key", "_block", F.lower("body").alias("low")).mapInArrow(_trigram_lists, row))
        # Ranges are sampled from the written lists; rows of one (token, block) are then in one range, and their lists are merged there.
        partial = written(parts)
        lists = partial.repartitionByRange(files, "token", "_block").groupBy("token", "_block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
        lists = lists.withColumn("n", F.size("keys").cast("long")).sortWithinPartitions("token", "_block")
        lists.write.option("parquet.bloom.filter.enabled#token", "true").parquet(f"{self.path}/postings")
        dropped(partial)
        self.spark.createDataFrame([(key, body, substrings)], "key string, body string, substrings boolean").coalesce(1).write.json(f"{self.path}/names")

    def _names(self) -> tuple[str, str, bool]:
        return tuple(self.spark.read.schema("key string, body string, substrings boolean").json(f"{self.path}/names").first())

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def postings(self, tokens: list[str]) -> DataFrame:
        """Posting rows of these tokens; the filter reaches the scan."""
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("token").isin(tokens))

    def candidates(self, tokens: list[str]) -> DataFrame:
        """(block, key) of texts that have all tokens, by intersecting lists block by block."""
        lists = self.postings(tokens).groupBy("_block").agg(F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct("n", "keys"))).alias("l")).where(F.col("c") == len(tokens))
        both = F.aggregate("l", F.col("l")[0]["keys"], lambda a, x: F.array_intersect(a, x["keys"]))
        return lists.select("_block", F.explode(both).alias("_key"))

    def _found(self, tokens: list[str], test: Column) -> DataFrame:
        key, *_ = self._names()
        return self.texts().join(self.candidates(tokens).withColumnRenamed("_key", key), ["_block", key], "left_semi").where(test).drop("_block")

    def tokens(self, needle: str) -> DataFrame:
        """Texts with every word of the needle."""
        _, body, _ = self._names()
        wanted = needle_words(needle)
        if not wanted:
            return self.texts().where(F.lit(False)).drop("_block")
        return self._found([f"w{w}" for w in wanted], has_words(F.col(body), needle))

    def contains(self, needle: str) -> DataFrame:
        """Texts that contain the needle, in any case."""
        _, body, indexed = self._names()
        grams = needle_trigrams(needle)
        if not grams or not indexed:
            return self.texts().where(has_text(F.col(body), needle)).drop("_block")
        return self._found([f"t{g}" for g in grams], has_text(F.col(body), needle))

    def rare(self, tokens: list[str]) -> DataFrame:
        """(token, n): texts per token, the rarest first."""
        return self.postings(tokens).groupBy("token").agg(F.sum("n").alias("n")).orderBy("n", "token")
