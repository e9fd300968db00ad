"""Chat formatting (operator 1): whole conversations, encoded once, with offset-aligned loss masks.

Rows are dealt by conversation and sorted by turn, then streamed: a conversation is rendered whole, its turn spans
are kept as they are written, the text is encoded once with offsets (running sums of the tokens' bytes), and the
sorted assistant spans are intersected with the token spans by binary search. Memory holds one batch of conversations
at a time; a conversation is one training sample and so has to fit a row.

Template: <|im_start|>ROLE\\nTEXT<|im_end|>\\n for each turn. The marks are tokens of their own, the whole head of an assistant
turn too, so no token lies on both sides of an assistant span's ends; that is asserted for every span. A
control string inside a text or role gets one more backslash after its first character ("<s>" -> "<\\s>",
"<\\s>" -> "<\\\\s>"), which can be taken back exactly, so texts hold no marks; a role's line breaks and
backslashes are written \\n and \\\\.

Null text is empty, a null role is the empty role. Ties in turn go by role, then text; repeated rows are turns of
their own. A null conv_id is a conversation like others. Only assistant text is under the mask; an empty one
covers no token. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = f"{START}assistant\n"
MARKS = (ASSISTANT, START, END)
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_REST})")
SCHEMA = "conv_id bigint, formatted string, n_tokens bigint, token_ids array<int>, loss_spans array<struct<start:int,end:int>>, mask_runs array<struct<first:int,last:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of assistant texts in it, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        name, body = escape(role.replace("\\", "\\\\").replace("\n", "\\n")), escape(text)
        head = f"{START}{name}\n"
        parts.append(f"{head}{body}{END}\n")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(parts[-1])
    return "".join(parts), spans


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ROLE = re.compile(r"\\(.)", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from the formatted text."""
    return [(_ROLE.sub(lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1])), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask_runs(spans: list[tuple[int, int]], ends) -> list[tuple[int, int]]:
    """For each non-empty byte span, its first token and the one after its last, by binary search in the tokens' sorted ends.

    A span that does not begin and end with tokens raises: the mask would train on the template.
    """
    import numpy as np

    full = np.array([x for x in spans if x[0] < x[1]], np.int64).reshape(-1, 2)
    last = np.searchsorted(ends, full[:, 1])
    first = np.searchsorted(ends, full[:, 0], "right")
    begins = np.concatenate([[0], ends])[first]
    if (begins != full[:, 0]).any() or (ends[last] != full[:, 1]).any():
        raise AssertionError("a token reaches over the end of an assistant text")
    return list(zip(first.tolist(), (last + 1).tolist(), strict=True))


def _conversations(batches: Iterator) -> Iterator:
    """(conv_id, turns) from sorted rows; a conversation may go over several batches."""
    now, turns, begun = None, [], False
    for batch in batches:
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if begun and c != now:
                yield now, turns
                turns = []
            now, begun = c, True
            turns.append((role or "", text or ""))
    if begun:
        yield now, turns


def _format(ranks, batch_bytes: int = 1_000_000):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(ranks.value, special=MARKS)

        def pairs(rows: list[list[tuple[int, int]]], names: tuple[str, str]) -> pa.Array:
            flat = np.array([x for r in rows for x in r], np.int32).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(2)], names))

        def encode(held: list) -> pa.RecordBatch:
            ids = [encoder.encode(text) for _, text, _ in held]
            runs, chars = [], []
            for (_, text, spans), own in zip(held, ids, strict=True):
                cuts = [x for s in spans for x in s]
                if cuts and not text.isascii():  # code points to bytes at the spans' ends
                    cuts = np.cumsum([len(text[a:b].encode()) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]).tolist()
                runs.append(mask_runs(list(zip(cuts[::2], cuts[1::2], strict=True)), np.cumsum(encoder.sizes[own])))
                chars.append(spans)
            values = np.concatenate(ids).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            columns = [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string()), pa.array([len(x) for x in ids], pa.int64()), tokens, pairs(chars, ("start", "end")), pairs(runs, ("first", "last"))]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "n_tokens", "token_ids", "loss_spans", "mask_runs"])

        held, size = [], 0
        for c, turns in _conversations(batches):
            text, spans = render(turns)
            held.append((c, text, spans))
            size += len(text)
            if size >= batch_bytes:
                yield encode(held)
                held, size = [], 0
        if held:
            yield encode(held)

    return run


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """One row a conversation: formatted text, token ids, assistant spans in code points, and runs of masked tokens [first, last)
    (one for each non-empty assistant span)."""
    spark = rows.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file: fixed size
    d = rows.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(turn_col).alias("turn"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return d.mapInArrow(_format(ranks), SCHEMA)


def read_back(formatted: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """Digests made from the output alone: turns by parsing the formatted text, loss text by decoding the masked tokens."""
    with open(ranks_path, "rb") as f:
        ranks = formatted.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        token = Encoder(ranks.value, special=MARKS).bytes
        for batch in batches:
            rows = []
            for c, text, ids, runs in zip(*(batch.column(i) for i in range(4)), strict=True):
                text = text.as_py()
                turns = parse(text)
                loss = []
                for r in runs.as_py():
                    own = ids.values.slice(r["first"], r["last"] - r["first"]).to_pylist()
                    loss.append(unescape(b"".join(map(token.__getitem__, own)).decode()))
                loss = "".join(loss)
                rows.append((c.as_py(), len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    d = formatted.select("conv_id", "formatted", "token_ids", "mask_runs")
    return d.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
