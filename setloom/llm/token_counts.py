"""Token counts without ids: pieces of each distinct pre-token once, then a join and sums.

The tokenizer splits text into pre-tokens that it merges separately, so a document's count is the sum, over its distinct
pre-tokens, of frequency times pieces. Each document's pre-tokens and their frequencies are kept as numbers in the
dictionary of the document's block (module ``blocks``). The distinct pre-tokens of all blocks are dealt by pre-token and
counted once; the counts are joined to the (pre-token, block) rows and dealt to the blocks, where the documents'
frequencies are multiplied by them and summed. Only pre-tokens and counts go through the join, frequencies stay with their
block, and a pre-token has one short row a block, so no key is hot.

The counts are those of the library ``tokenizers`` without begin, end or added special tokens. Special strings inside
texts are handled as its default: each is one token. Text that only has characters below U+0500 is split here by the
same rules; other text is split by the library's own normaliser and pre-tokeniser.

Defined results: a null text counts as empty, with 0 bytes and tokens. Rows that repeat a doc_id are counted each on its
own. Texts of any length are counted whole. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer, pre_tokenizers

from . import blocks

#: How word_bpe_49k.json splits normalised text; fixed by that file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


class PreTokens:
    """Splits texts as the tokenizer does."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = regex.compile(SPLIT)
        self.beyond = regex.compile("[^\u0000-ӿ]")

    def of(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in _split_only(self.tokenizer).pre_tokenize_str(normal)]


def _split_only(tokenizer: Tokenizer):
    """The tokenizer's pre-tokenisers but the one that maps bytes to letters."""
    return tokenizer.pre_tokenizer[0]


def count_pieces(tokenizer: Tokenizer, special: set[str], pre_token: str) -> int:
    """Pieces of one pre-token."""
    if pre_token in special:
        return 1
    as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(pre_token)
    return sum(len(tokenizer.model.tokenize(x)) for x, _ in as_bytes)


def pieces(words: DataFrame, path: str) -> DataFrame:
    """(unit, n) of a table of distinct pre-tokens, still dealt by them."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        for b in batches:
            yield pa.array([count_pieces(tokenizer, special, t) for t in b.to_pylist()], pa.int64())

    return words.select("unit", counted("unit").alias("n"))


def _frequencies(places: list[np.ndarray]) -> list[np.ndarray]:
    """How many distinct pre-tokens each document has, which (each as its distance from the one before), and how often."""
    each = [np.unique(p, return_counts=True) for p in places]
    return [np.array([len(w) for w, _ in each]), np.concatenate([np.diff(w, prepend=0) for w, _ in each]), np.concatenate([n for _, n in each])]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. ``path`` is a .json file of the library ``tokenizers``."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    rows = blocks.dealt(sized, ["doc_id", "n_bytes"], lambda: PreTokens(path).of, _frequencies)
    values = blocks.for_blocks(rows, pieces(blocks.distinct_units(rows), path), "n")
    schema = StructType([sized.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def finish(found: list[np.ndarray], *_: object) -> blocks.Finish:
        places, counts = found or [np.empty(0, np.int64)] * 2
        n = np.empty(len(counts), np.int64)
        n[places] = counts

        def of(columns: list[pa.Array], streams: list[np.ndarray]) -> list[pa.Array]:
            sizes, gaps, freqs = streams
            ends = np.cumsum([0, *sizes])
            sums = np.concatenate([[0], np.cumsum(gaps)])
            word = sums[1:] - np.repeat(sums[ends[:-1]], sizes)
            tokens = np.concatenate([[0], np.cumsum(n[word] * freqs)])
            return [*columns, pa.array(tokens[ends[1:]] - tokens[ends[:-1]])]

        return of

    return blocks.by_block(rows, values, finish, schema).withColumn("over_limit", F.col("n_tokens") > limit)
