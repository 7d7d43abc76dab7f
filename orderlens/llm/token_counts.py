"""Token counts of whole texts: pre-tokens that are one token for certain are counted, the rest merged."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .base import slices

# how byte-level encodings split a text before merging (fixed value)
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 400_000     # merged pre-tokens remembered by a task
LONG_TEXT = 1 << 20  # pre-tokens of longer texts are not listed at once


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


def load(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings proven to be one token wherever they stand as a pre-token.

    An entry is proven if its bytes are a valid text, that text is a single pre-token by itself, and
    merging it alone gives this one entry. Merges never cross a pre-token, so the proof holds in any
    text. The list is bounded by the vocabulary.
    """
    tokenizer = load(path)
    pattern, model = regex.compile(PRE_TOKEN), tokenizer.model
    bytes_of = {letter: b for b, letter in byte_letters().items()}
    proven = []
    for entry, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(bytes_of[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if pattern.findall(text) == [text] and [t.id for t in model.tokenize(entry)] == [number]:
            proven.append(text)
    return sorted(proven)


class _Memo(dict):
    """Number of tokens by pre-token: proven ones from the start, others merged when first met."""

    def __init__(self, proven, model):
        super().__init__(dict.fromkeys(proven, 1))
        self.model, self.room = model, len(proven) + MEMO
        self.letters = [byte_letters()[b] for b in range(256)]

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize("".join([self.letters[b] for b in piece.encode()])))
        if len(self) < self.room:
            self[piece] = n
        return n


class TokenCounter:
    """Counts the tokens of texts as the tokenizer file gives them, special strings included.

    Works for byte-level files without a normaliser, prefix space or post-processing; any other file
    is refused. A character that this Python's pattern classes and the tokenizer's put into different
    classes (younger Unicode versions add letters) sends its text through the tokenizer's own splitter.
    """

    def __init__(self, path: str, proven: list[str]):
        import json
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        split = plan["pre_tokenizer"] or {}
        if plan["normalizer"] or plan["post_processor"] or split.get("type") != "ByteLevel" \
                or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        if any(t[k] for t in plan["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added tokens that take white space or need word borders: {path}")
        self.tokenizer = load(path)
        self.splitter = self.tokenizer.pre_tokenizer
        self.memo = _Memo(proven, self.tokenizer.model)
        self.pattern = regex.compile(PRE_TOKEN)
        added = sorted((t["content"] for t in plan["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(regex.escape(t) for t in added)) if added else None
        self.alike = {chr(c) for c in range(128)}
        self.unlike: set[str] = set()

    def _same_class(self, char: str) -> bool:
        """Whether the tokenizer splits around `char` as the pattern does, next to each kind of character."""
        for other in "x1!\n":
            pair = other + char
            if len(self.splitter.pre_tokenize_str(pair)) != len(self.pattern.findall(pair)):
                return False
        return True

    def _odd(self, text: str) -> bool:
        if text.isascii():
            return False
        chars = set(text)
        for char in chars - self.alike - self.unlike:
            (self.alike if self._same_class(char) else self.unlike).add(char)
        return not self.unlike.isdisjoint(chars)

    def _plain(self, text: str) -> int:
        if self._odd(text):
            # the library's splitter shows bytes as letters already
            return sum(len(self.tokenizer.model.tokenize(p)) for p, _ in self.splitter.pre_tokenize_str(text))
        known = self.memo
        if len(text) > LONG_TEXT:
            return sum(known[m.group()] for m in self.pattern.finditer(text))
        return sum(map(known.__getitem__, self.pattern.findall(text)))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


def _counts(path: str, shared):
    def run(batches):
        counter = TokenCounter(path, shared.value)
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            n = [counter.count(t) for t in texts.to_pylist()]
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64())],
                names=[*others, "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, keep: list[str] | None = None,
                 text_col: str = "text") -> DataFrame:
    """(kept columns, n_bytes, n_tokens, over_limit), one row per row of `docs`.

    `keep` lists the columns to return (`doc_id` by default). Every executor must reach
    `tokenizer_path`. The vocabulary strings that are one token by themselves are proven once and
    broadcast (their number is bounded by the vocabulary); a text's pre-tokens are looked up there
    first and merged only otherwise. One pass, no shuffle; nothing is cut or padded, and special
    strings inside a text count as the tokenizer counts them by default.

    Defined cases: null and empty texts have 0 bytes and 0 tokens; a very long text is counted whole,
    its pre-tokens one after the other; repeated rows give repeated rows; an empty table gives an
    empty result; other columns, whatever their names, are not read.
    """
    keep = ["doc_id"] if keep is None else list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))
    rows = docs.select(F.struct(*keep).alias("others"), F.col(text_col).cast("string").alias("text"))
    kinds = T.StructType([rows.schema["others"], T.StructField("n_bytes", T.LongType()),
                          T.StructField("n_tokens", T.LongType())])
    done = rows.mapInArrow(_counts(tokenizer_path, shared), kinds)
    return done.select(*[F.col("others")[c].alias(c) for c in keep], "n_bytes", "n_tokens",
                       (F.col("n_tokens") > limit).alias("over_limit"))
