"""Token counts through a digest cache.

``(tokenizer version, content digest) -> n_tokens`` is a Parquet table. Documents are joined to it by digest; the texts
it lacks are made distinct, encoded once each with the tokenizers library, appended, and the join is made.

Within an executor, texts are cut where a space follows a non-space. The byte-level pattern has no match across such a
place, so the tokens of a text are those of its cuts one after another, and each distinct cut needs the library once.
A tokenizer for which that does not hold (``UnitCounter.cuttable``) gets whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import work_dir

CACHE_SCHEMA = "digest binary, n_tokens bigint"

#: A white-space character before a space: there a text can't be cut at every space.
DOUBLE = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and the library's version: counts of other versions are never taken."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()[:32]


class UnitCounter:
    """Counts of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Holds the counts of the first ``max_units`` distinct cuts; what a text has beyond them is encoded with that text.
    """

    def __init__(self, path: str, max_units: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.cuttable = self._cuttable(json.load(f))
        self.max_units = max_units
        self.known: dict[str, int] = {}  # of cuts, without the space they begin with

    @staticmethod
    def _cuttable(spec: dict) -> bool:
        pre = spec.get("pre_tokenizer") or {}
        return (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and all(
                not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]))
                for t in spec.get("added_tokens") or []
            )
        )

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuttable:
            return [n for i in range(0, len(texts), 64) for n in self._encode(texts[i : i + 64])]
        cuts = []
        for t in texts:
            if DOUBLE.search(t):
                head, *rest = CUT.split(t)
                cuts.append((head, [x[1:] for x in rest]))
            else:
                head, *rest = t.split(" ")
                cuts.append((head, rest) if head or not rest else (" " + rest[0], rest[1:]))
        known = self.known
        if len(known) < self.max_units:
            new = list(dict.fromkeys(x for _, rest in cuts for x in rest if x not in known))
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                known.update(zip(part, self._encode([" " + x for x in part]), strict=True))
        # What isn't known is encoded a text at a time: the cuts one after another have their cuts' tokens.
        get = known.get
        totals, others = [], []
        for head, rest in cuts:
            counts = list(map(get, rest))
            if None in counts:
                others.append(head + "".join([" " + x for x, n in zip(rest, counts, strict=True) if n is None]))
                totals.append(sum(filter(None, counts)))
            else:
                others.append(head)
                totals.append(sum(counts))
        encoded = [n for i in range(0, len(others), 256) for n in self._encode(others[i : i + 256])]
        return [a + b for a, b in zip(totals, encoded, strict=True)]


def text_slices(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` characters, so that what is held at once doesn't depend on the batch size."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=2)
def _counter(path: str) -> UnitCounter:
    """One a worker: what it has learned serves the worker's later tasks."""
    return UnitCounter(path)


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for a, b in text_slices(texts) for n in counter.count(texts[a:b])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    return run


def token_counts(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    cache_path: str | None = None,
    text_col: str = "text",
    limit: int = 1024,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) for every row of ``docs``.

    The digest is the SHA-256 of the text, null as empty; the tokenizer's own normaliser runs in the library.
    ``cache_path`` is kept between calls; without one, the call has a cache of its own in the shared folder.

    Null and empty texts have 0 tokens. Equal texts are encoded once; rows with equal or null ids each keep their row.
    Columns other than ``keep`` don't enter the result. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer()
    cache = f"{cache_path or f'{work_dir(spark)}/loomline/token-cache-{uuid.uuid4().hex}'}/{tokenizer_version(path)}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("__text"))
    digest = F.unhex(F.sha2("__text", 256))

    # One text a digest: made distinct in each scan task before the shuffle, so copies don't travel.
    missing = rows.select(digest.alias("digest"), F.col("__text").alias("text")).groupBy("digest").agg(
        F.first("text").alias("text")
    )
    try:
        missing = missing.join(spark.read.schema(CACHE_SCHEMA).parquet(cache), "digest", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    missing.mapInArrow(_encoder(path), CACHE_SCHEMA).write.mode("append").parquet(cache)

    # A task that ran twice, or two calls at once, may have stored a digest twice: the counts are equal.
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    light = rows.select(*keep, F.octet_length("__text").cast("long").alias("n_bytes"), digest.alias("__digest"))
    return light.join(counts, F.col("__digest") == F.col("digest"), "left").select(
        *keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
