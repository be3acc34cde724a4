"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .kernels import by_bytes, texts

#: Bytes of text for one call of the library.
ENCODE_BYTES = 1 << 16
#: Pieces whose lengths a worker remembers, and the longest piece it remembers; the memory starts afresh when full.
REMEMBERED = 500_000
REMEMBERED_BYTES = 64


#: Normalisers that treat what stands on the two sides of white space apart.
LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
#: Pre-tokenisers that end words at white space and drop it.
AT_SPACE = {"BertPreTokenizer", "Whitespace", "WhitespaceSplit"}
#: Alternatives of a pattern that match no white space: letters after an apostrophe, one Unicode class, and classes that exclude it.
NO_SPACE = re.compile(r"'[a-z]+|\[(\\p\{[A-Z][a-z]?\})+\]\+?|\[\^\\s[^\]]*\]\+?")


def splits_at_space(file: dict) -> bool:
    """True if a tokenizer's JSON proves that no token crosses or holds ASCII white space and that pieces between it are encoded on their own.

    That holds if all normalisers are local or turn runs of white space into a blank, if the first pre-tokeniser ends words at white space and drops it
    (by its kind, or by a pattern whose matches alone are kept and hold none), and if no added token holds white space.
    """

    def parts(x: dict | None, inner: str) -> list[dict]:
        return [] if x is None else [y for z in x[inner] for y in parts(z, inner)] if x["type"] == "Sequence" else [x]

    def local(x: dict) -> bool:
        return x["type"] in LOCAL or (x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " ")

    def drops(x: dict) -> bool:
        if x["type"] != "Split":
            return x["type"] in AT_SPACE
        kept = x["behavior"] == "Removed" and x["invert"]
        return kept and all(NO_SPACE.fullmatch(y) for y in x["pattern"].get("Regex", " ").split("|"))

    first = parts(file.get("pre_tokenizer"), "pretokenizers")[:1]
    added = any(re.search(r"\s", t["content"]) for t in file.get("added_tokens", ()))
    return bool(first) and drops(first[0]) and all(map(local, parts(file.get("normalizer"), "normalizers"))) and not added


class PieceLengths:
    """Token counts of texts by one tokenizer file, for use inside a task.

    ``.json`` files go to the tokenizers library, ``.model`` files to sentencepiece.
    If the file proves that white space is dropped before words are split (see splits_at_space()),
    it is a safe boundary: no token crosses it, so
    every text is split there and each piece is encoded once. Else texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths = lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
            self.splits = False
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._lengths = lambda batch: [len(x) for x in model.encode_batch_fast(batch, add_special_tokens=False)]
            with open(path, encoding="utf-8") as file:
                self.splits = splits_at_space(json.load(file))
        self._seen: dict[str, int] = {}

    def encode_all(self, pieces: list[str]) -> np.ndarray:
        """Lengths of pieces, in calls balanced by bytes: longest first, each call up to ENCODE_BYTES."""
        sizes = np.array([len(p.encode()) for p in pieces], np.int64)
        out = np.zeros(len(pieces), np.int64)
        order = np.argsort(-sizes, kind="stable")
        filled = np.cumsum(sizes[order])
        low = 0
        while low < len(order):
            base = filled[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(filled, base + ENCODE_BYTES, "right")))
            out[order[low:high]] = self._lengths([pieces[i] for i in order[low:high]])
            low = high
        return out

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        new = [p for p in pieces if p not in self._seen]
        fresh = dict(zip(new, self.encode_all(new).tolist(), strict=True)) if new else {}
        out = np.fromiter((self._seen.get(p, -1) if p not in fresh else fresh[p] for p in pieces), np.int64, len(pieces))
        if len(self._seen) + len(fresh) > REMEMBERED:
            self._seen.clear()
        self._seen.update((p, n) for p, n in fresh.items() if len(p) <= REMEMBERED_BYTES)
        return out

    def of_texts(self, column: pa.Array) -> np.ndarray:
        column = pc.fill_null(column, "")
        if not self.splits:
            return self.encode_all(column.to_pylist())
        split = pc.ascii_split_whitespace(column)
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        lengths = self.of_pieces(coded.dictionary.to_pylist())
        each = lengths[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        ends = ends - ends[0]
        return total[ends[1:]] - total[ends[:-1]]


def token_counts(docs: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes (of UTF-8), n_tokens and over_limit (n_tokens > limit).

    Narrow: no shuffle. Null texts count as empty (0, 0, false). Rows are kept as they
    are, repeated ones too; input columns named like the new ones are replaced. An
    empty table gives an empty table.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    place = [f.name for f in docs.schema.fields].index(text)

    def run(batches):
        counter = PieceLengths(tokenizer)
        for part in by_bytes(batches, text):
            column = part.column(place)
            _, offsets = texts(column)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(offsets)), pa.array(counter.of_texts(column))], [*part.schema.names, "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
