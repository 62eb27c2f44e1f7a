"""Secrets in texts: known forms, and strings that zstandard cannot foresee.

A long token in a sensitive context (a word such as `key` or `auth` shortly
before it, or in the name it is assigned to) is a candidate. Its novelty is what
it adds to the compressed size of its surroundings, without further copies of
itself, when the compressor is primed with a dictionary trained on the words
that most documents hold and on common identifiers of code. The dictionary
brings matches and the letter frequencies of such words, so known words cost
little, unknown ones less than their length, and random strings as much as a
random string of their length costs at the same place, the measure they are
held against.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.llm import arrays, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_CHARS = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_CHARS = 24
KINDS = ["assign", "access", "hex", "novel"]

CANDIDATE_CHARS = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_CHARS)
# Whole words, also as parts of names such as api_key, apiKey or authToken.
SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z0-9])(?=[A-Z]))"
    r"(?i:api|app|access|auth|client|user|db|my)*"
    r"(?i:pass(?:w(?:or)?d|phrase|code)?|pwd|secret|token|key|auth(?:entication|ori[sz]ation)?"
    r"|credential|private(?:key)?|bearer|session|signature|cert(?:ificate)?)(?i:s)?"
    r"(?![a-z])(?!(?<=[A-Z])[A-Z])",
    re.ASCII,
)
CONTEXT_CHARS = 48
AROUND_CHARS = 512
#: Least marginal size of a secret, as a share of a random string's at the same place.
NOVELTY = 0.8

#: Words of the documents that train the dictionary: those that most documents hold.
VOCABULARY = 20_000
WORD_GROUPS = [4096, 64, 1]
DICTIONARY_BYTES = 65_536
_VOCABULARY_WORD = re.compile(r"[A-Z]?[a-z]{3,23}|[A-Z]{4,24}")
_SAMPLE_WORDS = 8
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

# Common identifiers and pieces of code.
IDENTIFIERS = (
    "import from return def class function const let var public private static void string int "
    "self this null none true false if else for while try except catch finally raise throw new "
    "password passwd secret token api_key apiKey access_key secret_key private_key client_secret "
    "client_id username user_name config configuration settings environment variable os.environ "
    "getenv process.env Authorization Bearer Basic headers request response session cookie "
    "signature certificate credential credentials authentication authorization encryption "
    "aws_access_key_id aws_secret_access_key database_url connection_string localhost example.com "
    "http:// https:// base64 sha256 md5 utf-8 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "0123456789 documentation description implementation initialization getElementById "
    "addEventListener __init__ __name__ __main__ node_modules package_name version_number "
    "/usr/local/share /usr/local/bin /usr/lib /etc /var/log /home/user /opt /tmp src/main/java"
)

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()  # only tells whether a keyword can be there at all
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                if m.end() - m.start() >= ACCESS_CHARS]
    return out


def _parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans between the equals signs of a candidate; padding at its end stays with the last."""
    last = start + len(text[start:end].rstrip("="))
    out = []
    while (cut := text.find("=", start, last)) >= 0:
        out.append((start, cut))
        start = cut + 1
    return [*out, (start, end)]


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = VOCABULARY) -> list[str]:
    """The `size` ASCII words that most documents hold, ties to the smaller word.

    Words are camel-case parts and runs of letters, longer ones in pieces of up
    to 24 letters; a repeated row counts as often as given. Every document is
    counted, in its task first. Groups of words keep their best, level by
    level, so `size` words reach the driver, whatever the number of partitions.
    """

    def count(batches):
        for batch in batches:
            for first, _, offsets in arrays.text_slices(batch.column("text")):
                held: Counter[str] = Counter()
                for text in pieces.texts_of(batch.column("text").slice(first, len(offsets) - 1)):
                    held.update(set(_VOCABULARY_WORD.findall(text)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                    names=["word", "n"],
                )

    held = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    top = held.groupBy("word").agg(F.sum("n").alias("n"))
    for groups in WORD_GROUPS:
        best = Window.partitionBy("group").orderBy(F.desc("n"), "word")
        top = top.withColumn("group", F.pmod(F.xxhash64("word"), F.lit(groups)))
        top = top.withColumn("place", F.row_number().over(best))
        top = top.filter(F.col("place") <= size)
    return [row.word for row in sorted(top.collect(), key=lambda row: row.place)]


def train_dictionary(words: list[str]) -> bytes:
    """A zstandard dictionary of the words and of IDENTIFIERS, with the letter
    frequencies of both. `words` may be empty.

    Training keeps the stretches it finds worth it; the identifiers follow
    whole, since all that comes after the tables of a dictionary is content.
    """
    code = IDENTIFIERS.split()
    # Every stretch of the identifiers is a sample, so they suffice on their own.
    samples = [" ".join(code[i : i + _SAMPLE_WORDS]) for i in range(len(code))]
    step = -(-len(words) // _SAMPLE_WORDS)  # a sample mixes frequent and rare words
    samples += ["_".join(words[i::step]) for i in range(step)]
    trained = zstandard.train_dictionary(DICTIONARY_BYTES, [s.encode() for s in samples], level=3)
    return trained.as_bytes() + IDENTIFIERS.encode()


def _random_text(like: str) -> str:
    """Characters drawn evenly from 64, as many as in `like`, the same for equal strings."""
    drawn = hashlib.shake_128(like.encode()).digest(len(like))
    return "".join(_ALPHABET[b & 63] for b in drawn)


def novel_spans(text: str, compressor: zstandard.ZstdCompressor) -> list[tuple[int, int, int]]:
    """Candidates whose marginal compressed bytes reach the share NOVELTY of
    those that a random string of their length has in the same surroundings.

    Of an assignment only the long parts are measured, and the names before a
    part count as its context. Where no part is long and novel, the candidate
    is measured as it stands. Other places of the same string are blanked in
    the surroundings, so that a repeated secret is as novel as a single one.
    """

    def novel(start: int, end: int, same: str) -> bool:
        # Wide enough that a place which crosses the edge of the surroundings is whole.
        wide, blank = AROUND_CHARS + len(same), " " * len(same)
        before = text[max(0, start - wide) : start].replace(same, blank)[-AROUND_CHARS:]
        after = text[end : end + wide].replace(same, blank)[:AROUND_CHARS]
        around = before + "\n" + after
        size, own, chance = (
            len(compressor.compress((around + more).encode()))
            for more in ("", "\n" + text[start:end], "\n" + _random_text(text[start:end]))
        )
        return own - size >= NOVELTY * (chance - size)

    out = []
    for m in CANDIDATE.finditer(text):
        parts = _parts(text, *m.span())
        # Sensitive words do not overlap: the first one is also the first to end.
        word = SENSITIVE.search(text, max(0, m.start() - CONTEXT_CHARS), parts[-1][0])
        if not word:
            continue
        values = [text[a:b].rstrip("=") for a, b in parts]
        found = [(a, 3, b) for (a, b), value in zip(parts, values, strict=True)
                 if b - a >= CANDIDATE_CHARS and word.end() <= a and novel(a, b, value or text[a:b])]
        if not found and len(parts) > 1 and novel(*m.span(), max(values, key=len)):
            found = [(m.start(), 3, m.end())]
        out += found
    return out


def _long_runs(buf: np.ndarray, offsets: np.ndarray, keep: np.ndarray, least: int) -> np.ndarray:
    """Which rows have a run of kept bytes of at least this length."""
    starts, ends, bounds = arrays.word_spans(buf, offsets, keep)
    long = np.concatenate([[0], np.cumsum(ends - starts >= least)])
    return long[bounds[1:]] > long[bounds[:-1]]


def _finder(dictionary: bytes):
    hex_bytes = np.zeros(256, dtype=bool)
    hex_bytes[[*range(48, 58), *range(97, 103)]] = True

    def run(batches):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
        compressor = zstandard.ZstdCompressor(
            level=3, dict_data=primed, write_content_size=False, write_checksum=False)
        for batch in batches:
            for first, buf, offsets in arrays.text_slices(batch.column("text")):
                rows = len(offsets) - 1
                has_hex = _long_runs(buf, offsets, hex_bytes, HEX_CHARS)
                has_long = _long_runs(buf, offsets, _WORD, CANDIDATE_CHARS)
                found = []
                texts = pieces.texts_of(batch.column("text").slice(first, rows))
                for text, hexed, long in zip(texts, has_hex, has_long, strict=True):
                    spans = base_spans(text)
                    if hexed:
                        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)
                                  if m.end() - m.start() >= HEX_CHARS]
                    spans += novel_spans(text, compressor) if long else []
                    found.append(sorted(spans))
                kinds = [[k for _, k, _ in spans] for spans in found]
                show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, rows),
                    *(pa.array([k.count(i) for k in kinds], pa.int64()) for i in range(3)),
                    pa.array([show([s for s in spans if s[1] < 3]) for spans in found], pa.string()),
                    pa.array([show(spans) for spans in found], pa.string()),
                ], names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return run


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes | None = None
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans) of every row.

    Spans are `kind:start:end` in code points, end exclusive, by start and then
    kind (assign, access, hex, novel), comma-joined; `base_spans` leaves out the
    novel ones. Null and empty texts have no spans; a null id is returned as
    null, repeated rows as often as given. The dictionary is trained on the
    vocabulary of `docs` unless one from `train_dictionary` is given.
    """
    if dictionary is None:
        dictionary = train_dictionary(vocabulary(docs, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _finder(dictionary),
        "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string",
    )
