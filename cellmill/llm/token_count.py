"""Token counts by a map-side two-tier lookup.

Texts are split into pre-tokens (a run of spaces with the letters after it, a line end, or letters after a line end)
that no vocabulary entry crosses, so counts add up. Tier one is a broadcast table of the token counts of frequent
pre-tokens, bounded by ``FREQUENT`` entries; they are tallied over all documents, in a summary of bounded size in each
task. Tier two is a bounded cache in each Python worker; misses of a batch are encoded together by the library. No
pre-token is shuffled but those of the summaries.

Whether texts may be split is read from the model itself (see splits()); if not, whole texts are encoded.

Defined results: null is the empty text and has 0 tokens; repeated rows each keep their row; nothing is truncated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import without

FREQUENT, SUMMARY, CACHE, LONGEST = 50_000, 200_000, 400_000, 128
MARK = "▁"
_SPLIT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
OUTPUT = ("n_bytes", "n_tokens", "over_limit")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text that is not empty, with the space that the library puts first."""
    return _SPLIT.findall(f" {text}")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = varint() if size is None else size
            yield key >> 3, raw[at : at + size]
            at += size


#: Fixed values of the model's format: field numbers, and the types of pieces.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _TYPE, _NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 3, 1, 2, 3, 4, 6
_CHARSMAP, _PREFIX, _TRIMS, _MARKS, _RULES, _SUFFIX = 2, 3, 4, 5, 6, 24


def splits(proto: bytes) -> bool:
    """Whether token counts of pre-tokens add up to those of texts under this model: texts are taken as they are (no
    character map or rules, white space isn't trimmed, spaces become marks, and one is put first), no symbol of a user
    cuts them otherwise, and no piece crosses a boundary: none has a mark after its first letters, or a line end."""
    pieces, normalizer, trainer = [], {}, {}
    for number, value in _fields(proto):
        if number == _PIECES:
            pieces.append(dict(_fields(value)))
        elif number == _NORMALIZER:
            normalizer = dict(_fields(value))
        elif number == _TRAINER:
            trainer = dict(_fields(value))
    if normalizer.get(_CHARSMAP) or normalizer.get(_RULES) or normalizer.get(_TRIMS, 1) or not normalizer.get(_PREFIX, 1) or not normalizer.get(_MARKS, 1) or trainer.get(_SUFFIX, 0):
        return False
    for p in pieces:
        kind = p.get(_TYPE, _NORMAL)
        if kind == _USER:
            return False
        text = p[_PIECE].decode()
        if kind not in (_UNKNOWN, _CONTROL, _BYTE) and ("\n" in text or MARK in text.lstrip(MARK)):
            return False
    return True


class Counts(dict):
    """Pre-token -> number of tokens, for one model in one worker."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.frequent = frequent
        self.split = splits(self.model.serialized_model_proto())
        super().__init__(frequent)

    def fresh(self, found: list[str]) -> list[int]:
        """Token counts of pre-tokens, by the library."""
        # A pre-token with its spaces is a text without its first space; another follows a line end, whose
        # encoding (word mark and line end) takes two tokens.
        texts = [p[1:] if p[0] == " " else f"\n{p}" for p in found]
        counts = self.model.encode(texts, num_threads=1)
        return [1 if p == " " else len(c) - 2 * (p[0] != " ") for p, c in zip(found, counts, strict=True)]

    def of(self, texts: list[str]) -> list[int]:
        if not self.split:
            return [len(c) for c in self.model.encode(texts, num_threads=1)]
        out, waiting = [], {}
        for k, text in enumerate(texts):
            if not text:
                out.append(0)
                continue
            found = pre_tokens(text.replace(MARK, " "))
            try:
                out.append(sum(map(self.__getitem__, found)))
            except KeyError:
                out.append(-1)
                waiting[k] = found
            if len(waiting) >= 64:
                self._settle(out, waiting)
        self._settle(out, waiting)
        return out

    def _settle(self, out: list[int], waiting: dict[int, list[str]]) -> None:
        missing = list({p for found in waiting.values() for p in found if p not in self})
        if len(self) + len(missing) > CACHE:
            self.clear()
            self.update(self.frequent)
            missing = list({p for found in waiting.values() for p in found if p not in self})
        long = {}  # not kept: the cache is bounded by entries, so they must be short
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            for token, n in zip(part, self.fresh(part), strict=True):
                (self if len(token) <= LONGEST else long)[token] = n
        for k, found in waiting.items():
            out[k] = sum(self[p] if p in self else long[p] for p in found)
        waiting.clear()


_loaded: dict[str, Counts] = {}


def counts_for(path: str, frequent) -> Counts:
    if path not in _loaded:
        _loaded[path] = Counts(path, frequent.value if frequent else {})
    return _loaded[path]


def frequent_counts(docs: DataFrame, text_col: str, path: str) -> dict[str, int]:
    """Token counts of the FREQUENT most frequent pre-tokens of all documents. A task keeps SUMMARY pre-tokens at most: the
    rarest go until half are left when there are more, so a frequent one is undercounted at worst, and no text's count
    depends on it."""

    def tally(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for part in parts:
            for text in part.text:
                if text:
                    # words stand for the commonest pre-tokens, a space with letters after it; splitting is far cheaper
                    seen.update([w for w in text.replace(MARK, " ").replace("\n", " ").split(" ") if 0 < len(w) < 64])
                    least = 0
                    while len(seen) > SUMMARY >> (least > 0):
                        least += 1
                        seen = Counter({w: n for w, n in seen.items() if n > least})
        top = sorted(seen.items(), key=itemgetter(1), reverse=True)[:FREQUENT]
        yield pd.DataFrame({"token": [f" {t}" for t, _ in top], "n": [n for _, n in top]})

    model = Counts(path, {})
    if not model.split:
        return {}
    found = docs.select(F.col(text_col).alias("text")).mapInPandas(tally, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = [r.token for r in found.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").collect()]
    return dict(zip(tokens, model.fresh(tokens), strict=True)) if tokens else {}


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Every row of docs with n_bytes, n_tokens and over_limit (more than limit tokens). model_path: a sentencepiece
    model that every executor has at that place."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_counts(docs, text_col, model_path))

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = counts_for(model_path, frequent)
        for part in parts:
            yield pd.Series(counts.of(part.fillna("").tolist()), dtype="int64")

    out = without(docs, *OUTPUT)
    return out.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), "n_tokens": count(F.col(text_col))}).withColumn("over_limit", F.col("n_tokens") > limit)
