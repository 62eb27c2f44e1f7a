"""Token counts of whole texts: batch encoding that returns lengths only."""

from __future__ import annotations

import os
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgemeter.llm import pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 1 << 20
KNOWN_PARTS = 300_000

_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _counter(path: str, limit: int):
    def run(batches):
        tokenizer = _tokenizer(path)
        first_known: dict[str, int] = {}
        known: dict[str, int] = {}

        def learn(parts: set[str], to: dict[str, int], lead: str) -> None:
            new = list(parts.difference(to))
            found = tokenizer.encode_batch_fast([lead + p for p in new], add_special_tokens=False)
            to.update(zip(new, map(len, found), strict=True))

        for batch in batches:
            texts = pieces.texts_of(batch.column("text"))
            sizes = [len(t.encode()) for t in texts]
            counts: list[int] = []
            for a, b in pieces.runs(sizes, BATCH_BYTES):
                if len(known) > KNOWN_PARTS:
                    known.clear()
                if len(first_known) > KNOWN_PARTS:
                    first_known.clear()
                parts = [pieces.cut(t) for t in texts[a:b]]
                learn({p[0] for p in parts}, first_known, "")
                learn(set().union(*(p[1:] for p in parts)), known, " ")
                counts += [first_known[p[0]] + sum(map(known.__getitem__, p[1:])) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Counts are those of the tokenizer file's library for the whole text, without
    added special tokens; special strings inside a text are handled as the
    library does by default. The file must hold a byte-level BPE without a
    normalizer, for which texts may be cut at `pieces.cut`; each distinct part
    is encoded once per batch and remembered within a bound. Null and empty
    texts have 0 bytes and 0 tokens; a null id is returned as null, repeated
    rows as often as given.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _counter(tokenizer_path, limit),
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
