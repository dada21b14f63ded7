"""Chat formatting at token level, with a loss mask and reversible escapes.

A conversation becomes, for each turn in order,

    <|im_start|> role \\n text <|im_end|> \\n

where the two marks are reserved ids above the tokenizer's vocabulary; role and text are encoded
apart, never across a mark, so no content can form one. As the formatted text must also be safe for
readers that look for marks in plain text, control strings inside a role or text are escaped: every
``<``, any number of backslashes, ``|`` gets one more backslash, and loses it when read back.

The loss mask covers the tokens of assistant texts: +1 at the first, -1 after the last, and a running sum.

Turns are ordered by (turn, role, text); null turns come first. A null role is empty, a null text is
empty. Repeated rows are turns of their own. An empty table gives an empty result (the extra
conversation of the query aside). Turns are encoded and decoded where they are, so a conversation with
a third of all turns (or all that have no conv_id, which are one) is spread over the cluster; only the
digest of its texts, in order, is one task's work, with running states, so it costs time but no memory.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._bytes import slices
from strata.llm._shared import cached, lean, staged, tune
from strata.llm.token_file import _byte_letters

CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As escape(), and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Codec:
    """A lossless byte-level tokenizer with two reserved ids after its vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        back = {c: b for b, c in _byte_letters().items()}
        size = self.library.get_vocab_size()
        self.pieces = [b""] * size
        for token, k in self.library.get_vocab().items():
            if all(c in back for c in token):
                self.pieces[k] = bytes(back[c] for c in token)
        self.start, self.end = size, size + 1

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode()


def assemble(codec: Codec, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn."""
    head = codec.encode(f"{escape_role(role)}\n")
    body = codec.encode(escape(text))
    newline = codec.encode("\n")
    ids = np.array([codec.start, *head, *body, codec.end, *newline], np.int32)
    edges = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        edges[1 + len(head)] += 1
        edges[1 + len(head) + len(body)] -= 1
    return ids, np.cumsum(edges[:-1]).astype(bool)


def codec_for(path: str) -> Codec:
    return cached((Codec, path), lambda: Codec(path))


def format_turns(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """One row a turn, in the shared folder: conv_id, turn, ids, mask (packed bits). A turn needs nothing of the others."""
    tune(conversations.sparkSession)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                made = [assemble(codec, role, text) for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                ids = [i.astype("<i4").tobytes() for i, _ in made]
                masks = [np.packbits(m, bitorder="little").tobytes() for _, m in made]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(masks, pa.binary())], ["conv_id", "turn", "ids", "mask"])

    c = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), F.coalesce(conversations["role"], F.lit("")).alias("role"), F.coalesce(conversations["text"], F.lit("")).alias("text"))
    return staged(c.mapInArrow(lean(turns), "conv_id long, turn long, ids binary, mask binary"), "chat")


def read_turns(turns: DataFrame, vocabulary: str) -> DataFrame:
    """What a reader finds in each formatted turn: conv_id, turn, role, text, learnt (what the mask covers), chars."""
    tune(turns.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(vocabulary)
        for batch in batches:
            roles, texts, learnt, chars = [], [], [], []
            for ids, mask in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                seq = np.frombuffer(ids, "<i4")
                on = np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little", count=len(seq)).astype(bool)
                end = int(np.flatnonzero(seq == codec.end)[0])
                inner = codec.decode(seq[1:end])
                role, _, text = inner.partition("\n")
                roles.append(unescape_role(role))
                texts.append(unescape(text))
                learnt.append(unescape(codec.decode(seq[on])))
                chars.append(len(START) + len(inner) + len(END) + len(codec.decode(seq[end + 1 :])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.string()) for x in (roles, texts, learnt)), pa.array(chars, pa.int64())], ["conv_id", "turn", "role", "text", "learnt", "chars"])

    return turns.select("conv_id", "turn", "ids", "mask").mapInArrow(lean(found), "conv_id long, turn long, role string, text string, learnt string, chars long")


def digests(turns: DataFrame, vocabulary: str) -> DataFrame:
    """What a reader of the formatted conversations finds, one row a conversation."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        last: object = names
        n = loss_chars = chars = 0
        every, loss = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def close() -> None:
            if last is not names:
                done.append((last, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            for conv, role, text, learnt, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    close()
                    last, n, loss_chars, chars, every, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                every.update(f"{role}\n{text}\n".encode())
                loss.update(learnt.encode())
                loss_chars += len(learnt)
                chars += length
                n += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    ordered = read_turns(turns, vocabulary).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "learnt", "chars")
    return ordered.mapInArrow(lean(states), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
