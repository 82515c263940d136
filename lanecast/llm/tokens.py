"""Operator 1: token counts with a whole-token shortcut; the tokenizer helper of operator 5.

Texts are cut into pre-tokens. A vocabulary string that is one pre-token and encodes alone as one token counts
as one wherever it stands, because merges never cross pre-tokens; that set is proved once, offline, from the
vocabulary file, and is no larger than the vocabulary. Only the other pre-tokens go through the merges, once
per worker and distinct pre-token.

Null or empty text: 0 tokens. Repeated rows: counted row by row. Other columns are ignored. Very long texts:
whole. An added token's string inside a text is handled by the library itself. Empty table: no rows.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import documents, texts_of

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
MEMO = 400_000  # merged pre-tokens remembered by a worker; then forgotten and begun anew

# For the characters listed here the classes of letters, numbers and white space are written out, so that the pre-tokens
# are the library's whatever Unicode version either side knows: all up to U+024F; Greek, Cyrillic, kana, Han and Hangul
# letters; general and CJK punctuation, currency signs. Texts with other characters go to the library whole.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏΆΈ-ΊΌΎ-ΡΣ-ώЀ-ҁҊ-ԓぁ-ゖァ-ヺ一-龥가-힣"
_N, _S = "0-9²³¹¼-¾", r"\t-\r \x85\xa0\u2000-\u200a\u2028\u2029\u202f\u3000"
_OTHER = r"\u2010-\u2027\u2030-\u2046\u20a0-\u20ac\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff1f"
_KNOWN = rf"\x00-ɏ{_L}{_S}{_OTHER}"
PRE_TOKEN = rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def by_ranks(path: str):
    """The same vocabulary as ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def needs_library(path: str) -> re.Pattern:
    """Texts where a match is found go to the library whole: wider characters, strings of added tokens."""
    with open(path, encoding="utf-8") as f:
        added = [re.escape(t["content"]) for t in json.load(f)["added_tokens"]]
    return re.compile("|".join([f"[^{_KNOWN}]", *added]))


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token (at most the vocabulary)."""
    tok, letters, cut = library(path), _byte_letters(), re.compile(PRE_TOKEN)
    strings = []
    for piece in tok.get_vocab():
        try:
            s = bytes(letters[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if not needs_library(path).search(s) and cut.findall(s) == [s]:
            strings.append(s)
    return frozenset(s for s, e in zip(strings, tok.encode_batch(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and how many of its tokens were counted directly (n_whole)."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    proved = df.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    def count(batches):
        whole, tok, wide, cut = proved.value, library(path), needs_library(path), re.compile(PRE_TOKEN).findall
        memo: dict[str, int] = {}
        for batch, texts in texts_of(batches, "text"):
            n, direct = [], []
            for text in texts:
                if wide.search(text):
                    n.append(len(tok.encode(text, add_special_tokens=False).ids))
                    direct.append(0)
                    continue
                pieces = cut(text)
                merge = [p for p in pieces if p not in whole]
                if new := {p for p in merge if p not in memo}:
                    if len(memo) + len(new) > MEMO:
                        memo, new = {}, set(merge)
                    memo.update((p, len(tok.encode(p, add_special_tokens=False).ids)) for p in new)
                direct.append(len(pieces) - len(merge))
                n.append(direct[-1] + sum(map(memo.__getitem__, merge)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array(direct, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"])

    text = F.col(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")


def op1_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir))


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}


def pre_tokens(text: str) -> list[str]:
    return re.findall(PRE_TOKEN, text)


def encode(text: str, path: str, ranks: str):
    """Ids as the library gives them; texts in the proved character range take the faster encoder of the same ranks."""
    if needs_library(path).search(text):
        return library(path).encode(text, add_special_tokens=False).ids
    return by_ranks(ranks).encode_ordinary(text)


def brute_count(text: str | None, path: str) -> int:
    return len(library(path).encode(text or "", add_special_tokens=False).ids)


__all__ = ["QUERIES", "SQL", "brute_count", "count_tokens", "encode", "pre_tokens", "prove_whole_tokens"]
