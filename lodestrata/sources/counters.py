"""Token counters: a name and a function from text Column to count Column.

Vocabulary files are named by the caller and read on the executors that count;
none is kept here.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

Counter = Callable[[Column], Column]


def whitespace() -> Counter:
    return lambda c: F.size(T.ws_tokens(c))


def words() -> Counter:
    return lambda c: F.size(T.word_tokens(c))


def _python(count: Callable[[], Callable[[str], int]]) -> Counter:
    """A counter in Python; `count` builds it once a worker."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = count()
        for texts in batches:
            yield texts.map(lambda t: c(t) if isinstance(t, str) else 0).astype("int32")

    return run


def wordpiece(vocabulary: str) -> Counter:
    """Greedy longest match over a vocabulary file (one piece a line; the first of repeated ones counts)."""

    def build() -> Callable[[str], int]:
        from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

        pieces: dict[str, int] = {}
        with open(vocabulary, encoding="utf-8") as f:
            for k, line in enumerate(f):
                pieces.setdefault(line.rstrip("\n"), k)
        t = Tokenizer(models.WordPiece(pieces, unk_token="[UNK]"))
        t.normalizer, t.pre_tokenizer = normalizers.BertNormalizer(lowercase=False), pre_tokenizers.BertPreTokenizer()
        return lambda s: len(t.encode(s, add_special_tokens=False).ids)

    return _python(build)


def tokenizer_json(path: str) -> Counter:
    """A tokenizer.json file (Unigram, BPE, ...). Names of special tokens in a text are ordinary text."""

    def build() -> Callable[[str], int]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda s: len(t.encode(s, add_special_tokens=False).ids)

    return _python(build)


def tiktoken_file(path: str, pattern: str) -> Counter:
    """A file of byte-pair ranks (base64 token and rank a line), with its splitting pattern."""

    def build() -> Callable[[str], int]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        e = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda s: len(e.encode_ordinary(s))

    return _python(build)


def sentencepiece_file(path: str) -> Counter:
    """A SentencePiece .model file."""

    def build() -> Callable[[str], int]:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda s: len(p.encode(s))

    return _python(build)


def build(flavor: str, path: str | None = None, pattern: str | None = None) -> Counter:
    """A counter by name; all but whitespace and words need a vocabulary path, tiktoken also its pattern."""
    plain = {"whitespace": whitespace, "words": words}
    files = {"wordpiece": wordpiece, "tokenizer_json": tokenizer_json, "sentencepiece": sentencepiece_file, "tiktoken": lambda p: tiktoken_file(p, pattern)}
    if flavor in plain:
        return plain[flavor]()
    if flavor not in files:
        raise ValueError(f"unknown counter {flavor}")
    if not path or flavor == "tiktoken" and not pattern:
        raise ValueError(f"{flavor} needs a vocabulary path" + (" and a pattern" if flavor == "tiktoken" else ""))
    return files[flavor](path)
