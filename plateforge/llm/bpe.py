"""Byte-level BPE encoding and decoding with a pair occurrence index (operator 9).

The words of a partition that are new to it are laid out as one linked list of
symbols. An index maps each adjacent pair to all its positions; active ranks are
applied in ascending order, each to all its positions from left to right, and a
merge enters the two pairs that it makes into their lists. A merge's result can
only take part in later ranks, so one pass over the ranks encodes every word.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words whose encodings a worker keeps; beyond that it starts anew.
CACHE_WORDS = 200_000
#: The pre-tokenizer's pattern, a fixed value of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return [table[b] for b in range(256)]


class Codec:
    def __init__(self, model: str):
        """model: the text of a tokenizers file with a byte-level BPE model."""
        import regex

        spec = json.loads(model)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        characters = byte_characters()
        value = {c: b for b, c in enumerate(characters)}
        self.first = [vocabulary[c] for c in characters]
        self.ranks = {(vocabulary[a], vocabulary[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        self.pair = [(vocabulary[a], vocabulary[b]) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(value[c] for c in t) for t, i in vocabulary.items()} | {i: t.encode() for t, i in self.special.items()}
        self.find = regex.compile(PATTERN).findall
        ordered = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")").split if ordered else lambda text: [text]
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, by one pair index over all of them."""
        symbols: list[int] = []
        starts = []
        for word in words:
            starts.append(len(symbols))
            symbols += [self.first[b] for b in word.encode()]
            symbols.append(-1)  # stands between words, in no pair
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        ranks, made = self.ranks, self.made
        for at in range(n - 1):
            if (r := ranks.get((symbols[at], symbols[at + 1]))) is not None:
                index.setdefault(r, []).append(at)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b = self.pair[rank]
            new = made[rank]
            for at in sorted(index.pop(rank)):
                right = after[at]
                if symbols[at] != a or right >= n or symbols[right] != b:
                    continue  # another merge took part of it
                symbols[at], symbols[right] = new, -2
                beyond = after[at] = after[right]
                if beyond < n:
                    before[beyond] = at
                    if (r := ranks.get((new, symbols[beyond]))) is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(active, r)
                        index[r].append(at)
                left = before[at]
                if left >= 0 and (r := ranks.get((symbols[left], new))) is not None:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(active, r)
                    index[r].append(left)
        return [[s for s in symbols[lo : hi - 1] if s >= 0] for lo, hi in zip(starts, [*starts[1:], n], strict=True)]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            for word, ids in zip(part, self.merge(part), strict=True):
                self.cache[word] = (",".join(map(str, ids)), len(ids), b"".join(self.bytes[i] for i in ids))

    def words(self, text: str) -> list[str]:
        parts = self.split(text)
        return self.find(text) if len(parts) == 1 else [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.find(part))]

    def encode(self, texts: list[str]):
        """(number of tokens, ids joined by commas, decoded text) of each text, a few at a time."""
        at = 0
        while at < len(texts):
            if len(self.cache) > CACHE_WORDS:
                self.cache = {}
            for token, i in self.special.items():
                self.cache[token] = (str(i), 1, self.bytes[i])
            run, size = [], 0
            while at < len(texts) and size < 1 << 18:
                run.append(self.words(texts[at]))
                size += len(texts[at]) + 1
                at += 1
            self.learn(set().union(*run))
            cache = self.cache
            for found in run:
                coded = [cache[w] for w in found]
                yield sum(c[1] for c in coded), ",".join([c[0] for c in coded]), b"".join([c[2] for c in coded]).decode("utf-8", "replace")


def _run(model: str):
    def run(batches):
        from hashlib import sha256

        codec = Codec(model)
        for batch in batches:
            n, ids, decoded = [], [], []
            for count, joined, text in codec.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(count)
                ids.append(sha256(joined.encode()).hexdigest())
                decoded.append(sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(model: str):
    def run(batches):
        codec = Codec(model)
        for batch in batches:
            ids = [[int(i) for i in joined.split(",")] if joined else [] for _, joined, _ in codec.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(model: str):
    def run(batches):
        codec = Codec(model)
        for batch in batches:
            texts = [b"".join(codec.bytes[i] for i in x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def read_model(path: str) -> str:
    """The driver reads the vocabulary (a file of a few MB) and ships it with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row; null and empty texts have no ids. Special tokens' strings become those tokens."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(read_model(path)), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the inverse of encode; bytes that are no UTF-8 become U+FFFD."""
    return tokens.select("doc_id", "ids").mapInArrow(_decode(read_model(path)), "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs, in one pass."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(read_model(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
