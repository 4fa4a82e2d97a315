"""Chat formatting at the level of tokens (operator 13).

Each turn's text is escaped and encoded by itself, where it is read; the template's
marks are reserved ids beyond the vocabulary, spliced around it, so no text can make
one. Beside its ids a segment carries the steps of its loss mask: +1 where an
assistant's text begins, -1 where it ends. Segments meet by conversation, in order,
and are laid end to end; prefix sums of the steps are the mask. A conversation is
streamed through its task and cut into parts at the ends of turns, so memory does not
grow with its length.

The same marks, written out, make the formatted text. There a text must not hold
one, so its control strings get a backslash after their first character (and one
more where they have some already), which reading takes away again.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .bpe import byte_characters, read_model

# The template's marks. A reserved id is the vocabulary's size plus a mark's place in this list.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|>", "<</SYS>>")
BEGIN, END, ASK, ASKED, SYSTEM, NAMED, SAID = range(len(MARKS))
#: Tokens of a conversation's part; a longer turn is a part of its own.
PART_TOKENS = 1 << 16
#: Characters that are encoded together.
LOT_CHARS = 1 << 18


class Template:
    def __init__(self, model: str):
        """model: the text of a tokenizers file with a byte-level BPE model."""
        self.model = model
        spec = json.loads(model)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        value = {c: b for b, c in enumerate(byte_characters())}
        self.bytes = {i: bytes(value[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special} | {i: t.encode() for t, i in special.items()}
        self.first = max(self.bytes) + 1
        controls = sorted({*MARKS, *special}, key=lambda c: (-len(c), c))
        self._escape, self._unescape = (re.compile("|".join(re.escape(c[0]) + r"\\" + some + re.escape(c[1:]) for c in controls)) for some in "*+")

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: m[0][0] + m[0][2:], text)

    @functools.cached_property
    def tokenizer(self):
        """Only what encodes needs it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found = Tokenizer.from_str(self.model)
        found.encode_special_tokens = True
        found.no_truncation()
        found.no_padding()
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode()

    def segment(self, role: str, role_ids: list[int], ids: list[int]) -> tuple[list[int], int, int]:
        """A turn's ids, and where in them the loss begins and ends (equal: none)."""
        mark = self.first
        if role == "user":
            return [mark + ASK, *ids, mark + ASKED], 0, 0
        if role == "assistant":
            return [*ids, mark + END], 0, len(ids)
        return [mark + SYSTEM, *role_ids, mark + NAMED, *ids, mark + SAID], 0, 0

    def turns(self, ids: np.ndarray, mask: np.ndarray):
        """(role, text, text under the mask) of each turn of ids."""
        name, lo = "", 0
        for at in np.flatnonzero(ids >= self.first).tolist():
            kind = int(ids[at]) - self.first
            if kind in (END, ASKED, SAID):
                text, under = self.unescape(self.decode(ids[lo:at].tolist())), mask[lo:at] == 1
                learnt = text if under.all() else self.unescape(self.decode(ids[lo:at][under].tolist()))
                yield {END: "assistant", ASKED: "user"}.get(kind, name), text, learnt
            elif kind == NAMED:
                name = self.unescape(self.decode(ids[lo:at].tolist()))
            lo = at + 1

    def written(self, ids: list[int]) -> str:
        """The formatted text of ids."""
        return b"".join([self.bytes[i] if i < self.first else MARKS[i - self.first].encode() for i in ids]).decode()


@functools.lru_cache(maxsize=2)
def _template(model: str) -> Template:
    """A worker builds a vocabulary's template once, for all of its tasks."""
    return Template(model)


_SEGMENT = "conv_id long, turn long, ids array<int>, lo int, hi int"


def _encode(model: str):
    @kernel.lean
    def run(batches):
        template = _template(model)
        for batch in batches:
            conv, turn, roles, texts = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < LOT_CHARS):
                    size += len(texts[end])
                    end += 1
                lot = [template.escape(x) for x in [*roles[at:end], *texts[at:end]]]
                coded = template.encode(lot)
                found = [template.segment(role, *pair) for role, *pair in zip(roles[at:end], coded, coded[end - at :], strict=False)]
                columns = [pa.array(conv[at:end], pa.int64()), pa.array(turn[at:end], pa.int64()), pa.array([f[0] for f in found], pa.list_(pa.int32())), *(pa.array([f[i] for f in found], pa.int32()) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "ids", "lo", "hi"])
                at = end

    return run


_PART = "conv_id long, part int, input_ids array<int>, loss_mask array<tinyint>, text string"


def _assemble(model: str, part_tokens: int):
    @kernel.lean
    def run(batches):
        template = _template(model)
        conv, part, ids, steps, size = object(), 0, [], [], 0

        def row():
            tokens = np.concatenate(ids)
            change = np.zeros(size + 1, np.int8)
            # The places of one part differ, but an empty text begins and ends at one.
            np.add.at(change, [lo for lo, _ in steps], 1)
            np.add.at(change, [hi for _, hi in steps], -1)
            mask = np.cumsum(change[:-1], dtype=np.int8)
            lists = [pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(x, t)) for x, t in ((tokens, pa.int32()), (mask, pa.int8()))]
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), *lists, pa.array([template.written(tokens.tolist())], pa.string())], names=["conv_id", "part", "input_ids", "loss_mask", "text"])

        for batch in batches:
            out = []
            column = batch.column(2)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, (c, lo, hi) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if c != conv or size >= part_tokens:
                    if ids:
                        out.append(row())
                    part = part + 1 if c == conv else 0
                    conv, steps = c, []
                    ids = [] if part else [np.array([template.first + BEGIN], np.int32)]
                    size = len(ids)
                ids.append(values[offsets[i] : offsets[i + 1]])
                if hi > lo:
                    steps.append((size + lo, size + hi))
                size += len(ids[-1])
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if ids:
            yield row()

    return run


def format_chats(conversations: DataFrame, path: str, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(conv_id, part, input_ids, loss_mask, text) of every conversation, with the byte-level vocabulary at path.

    Turns are in the order of their number, null first, those of one number in the
    order of their ids; a repeated row is a turn of its own. Null roles and texts are
    empty; rows without a conv_id are one conversation, of id null. An assistant's text
    ends with </s>, a user's is between [INST] and [/INST], any other role's between
    <<SYS>>role<|> and <</SYS>>. The mask is 1 on assistants' texts and on no mark. A
    conversation of over part_tokens tokens has several parts, cut between turns. An
    empty table gives no row; other columns are not read.
    """
    model = read_model(path)
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    segments = rows.mapInArrow(_encode(model), _SEGMENT)
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids").mapInArrow(_assemble(model, part_tokens), _PART)


def _parts(batch):
    for column in ("input_ids", "loss_mask"):
        found = batch.column(batch.schema.get_field_index(column))
        yield found.values.to_numpy(zero_copy_only=False), found.offsets.to_numpy()


def _read(model: str):
    def run(batches):
        template = _template(model)
        for batch in batches:
            (ids, at), (mask, m) = _parts(batch)
            for i, (conv, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = list(template.turns(ids[at[i] : at[i + 1]], mask[m[i] : m[i + 1]]))
                columns = [pa.array([conv] * len(found), pa.int64()), pa.array([part] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), *(pa.array([f[j] for f in found], pa.string()) for j in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "place", "role", "text", "learnt"])

    return run


def read_chats(formatted: DataFrame, path: str) -> DataFrame:
    """(conv_id, part, place, role, text, learnt): every turn read back from input_ids and loss_mask; learnt is its text under the mask."""
    return formatted.select("conv_id", "part", "input_ids", "loss_mask").mapInArrow(_read(read_model(path)), "conv_id long, part int, place int, role string, text string, learnt string")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(model: str):
    def run(batches):
        template = _template(model)
        conv, n, turns, learnt_chars, loss, chars = object(), 0, None, 0, None, 0
        out = []

        def rows():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split(" ")[0] for c in _DIGEST.split(", ")])

        for batch in batches:
            (ids, at), (mask, m) = _parts(batch)
            for i, c in enumerate(batch.column(0).to_pylist()):
                if c != conv:
                    if turns:
                        out.append((conv, n, turns.hexdigest(), learnt_chars, loss.hexdigest(), chars))
                    conv, n, turns, learnt_chars, loss, chars = c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                own = ids[at[i] : at[i + 1]]
                chars += len(template.written(own.tolist()))
                for role, text, learnt in template.turns(own, mask[m[i] : m[i + 1]]):
                    n, learnt_chars = n + 1, learnt_chars + len(learnt)
                    turns.update(f"{role}\n{text}\n".encode())
                    loss.update(learnt.encode())
            if out:
                yield rows()
                out = []
        if turns:
            out.append((conv, n, turns.hexdigest(), learnt_chars, loss.hexdigest(), chars))
            yield rows()

    return run


def digests(formatted: DataFrame, path: str, in_order: bool = False) -> DataFrame:
    """Counts and SHA-256 digests of what is read back from each conversation of format_chats; in_order: its rows have not been dealt anew since."""
    parts = formatted.select("conv_id", "part", "input_ids", "loss_mask")
    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_digests(read_model(path)), _DIGEST)


#: The conversation that op13_chat_format adds: (conv_id, turn, role, text).
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(format_chats(rows.union(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")), path), path, in_order=True)


_ESCAPED = r"regexp_replace({}, '(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|\|>|</SYS>>|\|endoftext\|>)', '\1\\\2\3', 'g')"
ORACLE_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length({_ESCAPED.format("text")}) AS n, length({_ESCAPED.format("role")}) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(3 + sum(n + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 ELSE 18 + r END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
