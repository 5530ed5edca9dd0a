"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before
it as context and only that reply under the loss mask.

Template: each turn is `### <Role>: <text></turn>` and a line feed. Inside roles and texts, `\\`, `#` and `<` are written
as `\\b`, `\\h` and `\\l`, so no text can hold a control string, and reading back is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.util import slices

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Characters and how they are written inside texts. `\\` must be written first and read last.
ESCAPES = {"\\": "\\b", "#": "\\h", "<": "\\l"}
#: Characters of examples that a task makes before it passes them on.
CHUNK_CHARS = 4_000_000
EXAMPLE = "conv_id long, example int, target int, text string, loss_start int, loss_end int"


def escape(text: str) -> str:
    for raw, written in ESCAPES.items():
        text = text.replace(raw, written)
    return text


def unescape(text: str) -> str:
    for raw, written in reversed(ESCAPES.items()):
        text = text.replace(written, raw)
    return text


def escape_role(role: str) -> str:
    """A role ends at the first `: `, so a colon in it is written as `\\c`."""
    return escape(role).replace(":", "\\c")


def unescape_role(role: str) -> str:
    return unescape(role.replace("\\c", ":"))


def role_title(role: str) -> str:
    """Roles are shown with a capital: `assistant` as `Assistant`. Only roles that begin with a to z change, and
    others that would look the same are marked, so that reading back is exact."""
    if "a" <= role[:1] <= "z":
        return role[0].upper() + escape_role(role[1:])
    return "\\r" + escape_role(role)


def role_of(title: str) -> str:
    if title.startswith("\\r"):
        return unescape_role(title[2:])
    return title[0].lower() + unescape_role(title[1:])


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text starts and ends in it."""
    head = f"{OPEN}{role_title(role)}{MIDDLE}"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def expand(turns: list[tuple[str, str]], target_role: str = "assistant") -> Iterator[tuple[int, str, int, int]]:
    """(turn under the loss, text up to it, start and end of the loss mask in code points) for each target turn, one by
    one. If the last turn is no target, a last example holds the whole conversation with an empty mask (turn -1)."""
    whole = ""
    for k, (role, text) in enumerate(turns):
        piece, start, end = format_turn(role, text)
        if role == target_role:
            yield k, whole + piece, len(whole) + start, len(whole) + end
        whole += piece
    if not turns or turns[-1][0] != target_role:
        yield -1, whole, len(whole), len(whole)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    at, out = 0, []
    while at < len(text):
        end = text.index(CLOSE, at)
        title, body = text[at + len(OPEN) : end].split(MIDDLE, 1)
        out.append((role_of(title), unescape(body)))
        at = end + len(CLOSE)
    return out


def format_conversations(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Examples of all conversations: conv_id, example (from 0), target (place of the turn under the loss, -1 for none),
    text, loss_start, loss_end (code points of the mask).

    Rows of a conversation go by turn (nulls first), then role, then text, so ties and repeated rows have one order and
    all count. Null text or role is empty; a null conv_id is one conversation. Texts are whole, however long. A
    conversation without a target turn, or with turns after the last, ends with an example whose mask is empty, so no
    turn is lost. Other columns are ignored; an empty table gives no rows. A conversation is the unit of output: its
    turns are brought together, and no others; its examples, whose lengths add up to the square of its own, are made and
    passed on a few at a time.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "example", "target", "text", "loss_start", "loss_end"]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
        for pdf in batches:
            rows, chars = [], 0
            for conv, turns in zip(pdf["conv_id"], pdf["turns"], strict=True):
                for n, (k, text, i, j) in enumerate(expand([(t["role"], t["text"]) for t in turns], target_role)):
                    rows.append((None if pd.isna(conv) else int(conv), n, k, text, i, j))
                    chars += len(text)
                    if chars >= CHUNK_CHARS:
                        yield frame(rows)
                        rows, chars = [], 0
            yield frame(rows)

    return convs.mapInPandas(work, EXAMPLE)


def digests(examples: DataFrame) -> DataFrame:
    """What a conversation's examples hold, read back from their texts and masks. The longest example has all turns;
    masks are read from each example. formatted_chars is the length of all examples together.

    Each example is digested where it is made: what travels is its reply and a few numbers, so a conversation's row
    never holds more than its own replies, however long its examples are together."""
    schema = "conv_id long, example int, n_turns long, turns_sha256 string, loss string, chars long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], 32):
                count, digest, loss, chars = [], [], [], []
                for text, i, j in zip(*(batch.column(c) for c in ("text", "loss_start", "loss_end")), strict=True):
                    text = text.as_py()
                    turns = read_back(text)
                    said = hashlib.sha256()
                    for role, own in turns:
                        said.update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
                    count.append(len(turns))
                    digest.append(said.hexdigest())
                    loss.append(unescape(text[i.as_py() : j.as_py()]))
                    chars.append(len(text))
                cols = [batch.column("conv_id"), batch.column("example"), pa.array(count, pa.int64()), pa.array(digest), pa.array(loss, pa.string()), pa.array(chars, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "example", "n_turns", "turns_sha256", "loss", "chars"])

    last = F.max_by(F.struct("n_turns", "turns_sha256"), "example").alias("last")
    replies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss")
    convs = examples.mapInArrow(work, schema).groupBy("conv_id").agg(last, replies, F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    return convs.select(
        "conv_id", "last.n_turns", "last.turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples"
    )


#: The extra conversation of the contract: its texts hold the template's own control strings.
HARD_ID, HARD_TEXT = -7, r"\### Assistant: </turn> ok"


def with_hard_case(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    hard = spark.createDataFrame([(HARD_ID, 0, "user", HARD_TEXT), (HARD_ID, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(hard)


ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n, count(*) over (partition by conv_id) as total,
        14 + length(role) + case when substr(role, 1, 1) between 'a' and 'z' then 0 else 2 end
        + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')))
        + length(text) + (length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))) as chars from c),
s as (select *, sum(chars) over (partition by conv_id order by n) as upto from w)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  coalesce(sum(upto) filter (role = 'assistant' or n = total), 0)::bigint as formatted_chars,
  (count(*) filter (role = 'assistant' or n = total))::bigint as n_examples
from s group by conv_id
"""
