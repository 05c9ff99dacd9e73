"""Token counts behind a digest cache.

Each text's normalised content and the tokenizer's file give digests; the pair is joined to stored counts, only the
distinct contents without a count are encoded, and their counts are appended to the cache. Within a worker the words of
those contents are counted once as well, where the tokenizer treats words independently.

Defined cases: a null or empty text has 0 tokens and 0 bytes; equal contents are encoded once; an empty table gives no
rows. The cache is a Parquet folder (content, tokenizer, n_tokens); without a path a fresh one in the shared folder.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BLANK, LETTER, NUMBER
from .common import Scratch, doc_blocks, raw_text, released, texts

MEMO = 1 << 16
PLAIN = re.compile(r"[\x00-įı-ſ]*")  # characters whose lower case, composition and class need no library


class TokenCounter:
    """Counts as the tokenizer's own library gives them."""

    held: dict[str, TokenCounter] = {}

    @classmethod
    def of(cls, path: str) -> TokenCounter:
        if path not in cls.held:
            gc.set_threshold(200_000, 50, 50)
            cls.held[path] = cls(path)
        return cls.held[path]

    def __init__(self, path: str):
        self.memo: dict[str, int] = {}
        self.seen: set[str] = set()
        self.by_word = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda some: list(map(len, model.encode(some, num_threads=1)))
            return
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.whole = lambda some: [len(e) for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        self.marks, split = words_apart(path)
        if split:
            plain = split.replace(r"[^\s\p{L}\p{N}]", f"[^{BLANK}{LETTER}{NUMBER}]").replace(r"\p{L}", LETTER).replace(r"\p{N}", NUMBER)
            self.by_word = re.compile(plain)

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(m in text for m in self.marks)

    def counts(self, batch: list[str]) -> list[int]:
        if self.by_word is None:
            return self.whole(batch)
        lists = [self.by_word.findall(t.lower()) if self.plain(t) else None for t in batch]
        fresh = set().union(*(x for x in lists if x is not None))
        new = list(fresh - self.memo.keys())
        known = dict(zip(new, self.whole(new), strict=True))
        if len(self.memo) < MEMO:
            self.memo.update({w: known[w] for w in self.seen & known.keys()})
        self.seen = set(new)
        known.update(self.memo)
        get = known.__getitem__
        return [sum(map(get, x)) if x is not None else self.whole([t])[0] for x, t in zip(lists, batch, strict=True)]


def words_apart(path: str) -> tuple[list[str], str | None]:
    """(special strings, split pattern) of a tokenizers file that lower-cases, collapses white space and encodes each match alone; the pattern is None for others."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    marks = [t["content"] for t in held["added_tokens"]]
    steps = (held["normalizer"] or {}).get("normalizers", [])
    before = (held["pre_tokenizer"] or {}).get("pretokenizers", [])
    fits = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    fits = fits and [s["type"] for s in before] == ["Split", "ByteLevel"] and before[0]["behavior"] == "Removed" and before[0]["invert"] and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
    return marks, before[0]["pattern"]["Regex"] if fits else None


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each text."""
    spark = docs.sparkSession
    cache = cache or Scratch(spark, "token-counts").root + "/cache"
    with open(path, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    text = F.coalesce(F.col("text"), F.lit(""))
    # Runs of white space that the tokenizer itself makes one space may become one space before the digest.
    collapse = path.endswith(".json") and words_apart(path)[1] is not None
    content = F.unhex(F.sha2(F.regexp_replace(text, "[ \\t\\n\\r]+", " ") if collapse else text, 256))
    kind = "content binary, tokenizer string, n_tokens long"
    keyed = docs.select("doc_id", text.alias("text"), content.alias("content"))

    def stored() -> DataFrame | None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return spark.read.schema(kind).parquet(cache).where(F.col("tokenizer") == version).select("content", "n_tokens").dropDuplicates(["content"])

    def run(batches):
        counter = TokenCounter.of(path)
        for batch in batches:
            _, offsets = raw_text(batch.column(1))
            found = [n for low, high in doc_blocks(offsets, 4 << 20) for n in counter.counts(texts(batch.column(1).slice(low, high - low)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(found), pa.string()), pa.array(found, pa.int64())], ["content", "tokenizer", "n_tokens"])

    misses = keyed.select("content", "text")
    if (held := stored()) is not None:
        misses = misses.join(held, "content", "left_anti")
    misses.groupBy("content").agg(F.first("text").alias("text")).mapInArrow(released(run), kind).write.mode("append").parquet(cache)
    sized = keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(stored(), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
