"""Repair of conversation structure by weighted finite-state composition (after Mohri, 2009).

Three machines: the input acceptor reads a conversation's turns one by one, the edit transducer keeps, reroles, deletes
or inserts turns at a cost, the grammar acceptor takes the role initials `(s?(ua)+)?`. Their composition is expanded
lazily, state by state in topological order (turns read, then whether the last edit was an insertion), and the shortest
path is taken over the weights (cost, edits' initials), compared by cost, then by the string's characters.

These weights are a semiring on what competes: two strings of one cost over the same turns are never prefixes of each
other, as the longer one would have more insertions and so a higher cost. Therefore a conversation may be cut into blocks:
the shortest paths of a block, from each grammar state to each, are a small matrix, and the matrices of consecutive blocks
multiply. Two insertions in a row are never cheapest (from any state they lead back to where the same turns are accepted,
or, after a system turn, cost more than deleting it), so the transducer has no arc for a second one.

Skew: turns that are equal in all columns are counted first, then sorted by ranges over conversation and turn, so one
conversation may lie in many partitions and a task holds one block of it at a time. Only the matrices of a conversation's
blocks meet in one task, one after the other; their strings are as long as its result is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from granary.llm.util import shuffle_partitions, slices, stored

#: Fixed values of the contract: what edits cost, and what an undeleted truncated turn costs besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns and characters of a block at most; a single longer text is a block of its own.
BLOCK, BLOCK_CHARS = 256, 1_000_000

START, SYSTEM, USER, ASSISTANT = range(4)
#: The role grammar `(s?(ua)+)?`: where each role initial leads from each state.
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
FRESH, INSERTED = range(2)

Weight = tuple[int, str]
#: What the machines see of a turn: role initial, whether it must go, whether it is truncated.
Symbol = tuple[str, bool, bool]


def edits(state: int, symbol: Symbol | None) -> Iterator[tuple[str, str | None, int, int]]:
    """The edit transducer's arcs: label, output role initial (None: no output), cost, next state. Without a symbol: arcs that
    read no turn."""
    if symbol is None:
        if state == FRESH:
            yield from (("I", role, INSERT, INSERTED) for role in ROLES)
        return
    initial, must_go, truncated = symbol
    yield "D", None, DELETE, FRESH
    if not must_go:
        more = TRUNCATED if truncated else 0
        yield "K", initial, KEEP + more, FRESH
        yield from (("R", role, REROLE + more, FRESH) for role in ROLES)


def arcs(symbols: tuple[Symbol, ...], state: tuple[int, int, int]) -> Iterator[tuple[Weight, tuple[int, int, int]]]:
    """The arcs of the composed machine from (turns read, edit state, grammar state)."""
    at, edit, grammar = state
    for read in (None, symbols[at]) if at < len(symbols) else (None,):
        for label, role, cost, then in edits(edit, read):
            to = grammar if role is None else GRAMMAR[grammar].get(role)
            if to is not None:
                yield (cost, label), (at + (read is not None), then, to)


def times(x: Weight, y: Weight) -> Weight:
    return x[0] + y[0], x[1] + y[1]


def shortest(symbols: tuple[Symbol, ...], entry: int) -> dict[int, Weight]:
    """The smallest weight from grammar state `entry` before the first turn to each state after the last."""
    best: dict[tuple[int, int, int], Weight] = {(0, FRESH, entry): (0, "")}
    out: dict[int, Weight] = {}
    for at in range(len(symbols) + 1):
        for edit in (FRESH, INSERTED):
            for grammar in range(len(GRAMMAR)):
                own = best.pop((at, edit, grammar), None)
                if own is None:
                    continue
                if at == len(symbols):
                    out[grammar] = min(own, out.get(grammar, own))
                for weight, to in arcs(symbols, (at, edit, grammar)):
                    new = times(own, weight)
                    if to not in best or new < best[to]:
                        best[to] = new
    return out


@functools.lru_cache(maxsize=20_000)
def matrix(symbols: tuple[Symbol, ...]) -> dict[tuple[int, int], Weight]:
    return {(i, j): w for i in range(len(GRAMMAR)) for j, w in shortest(symbols, i).items()}


def follow(labels: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The turns (role, text) that the edits leave, and the grammar state after them. A new role is the one that the grammar
    takes: in each state it takes one of user and assistant."""
    out, at = [], 0
    for label in labels:
        if label == "K":
            out.append((roles[at], texts[at]))
            state = GRAMMAR[state][roles[at][:1]]
        elif label in "RI":
            role = next(r for r in GRAMMAR[state] if r in ROLES)
            out.append((ROLES[role], texts[at] if label == "R" else ""))
            state = GRAMMAR[state][role]
        at += label != "I"
    return out, state


# --- damage ----------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows with the contract's planted faults, equal ones counted. Null roles and texts are
    one space, and so are null ids and turns in the key that chooses the fault."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    rows = rows.withColumn("kind", F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


# --- repair ----------------------------------------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")
BLOCKS = (
    "conv_id long, block long, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, head string, tail string,"
    "low long, high long, turns long, first_turn long, last_turn long, ways array<struct<i:int,j:int,cost:long,labels:string>>"
)


class Block:
    """Consecutive turns of one conversation."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.symbols, self.roles, self.texts, self.chars, self.turns = conv, [], [], [], 0, []
        self.count = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, role: str, text: str | None, fault: str) -> None:
        must_go = fault in ("blank", "duplicate")
        if self.symbols and self.symbols[-1][0] + role[:1] not in LEGAL:
            self.count["illegal"] += 1
        if fault:
            self.count[fault] += 1
        self.symbols.append((role[:1], must_go, fault == "truncated"))
        self.roles.append(role)
        self.texts.append("" if must_go else text)
        self.chars += len(self.texts[-1])
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def row(self, block: int) -> dict:
        t = self.turns
        ways = [{"i": i, "j": j, "cost": c, "labels": s} for (i, j), (c, s) in matrix(tuple(self.symbols)).items()]
        ends = {"low": min(t, default=None), "high": max(t, default=None), "turns": len(t), "first_turn": t[0] if t else None, "last_turn": t[-1] if t else None}
        return {"conv_id": self.conv, "block": block, "roles": self.roles, "texts": self.texts, **self.count, "head": self.symbols[0][0], "tail": self.symbols[-1][0], **ends, "ways": ways}


def arrow_of(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def cut(rows: DataFrame) -> DataFrame:
    """BLOCKS of sorted rows (conv_id, turn, role, text, n, fault), numbered in their order."""
    names, schema = ("conv_id", "turn", "role", "text", "n", "fault"), arrow_of(BLOCKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, full = TaskContext.get().partitionId() << 33, None, []
        chars = 0
        for batch in slices(batches):
            for conv, turn, role, text, n, fault in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                for copy in range(n):
                    if block is None or block.conv != conv or len(block.symbols) >= BLOCK or block.chars >= BLOCK_CHARS:
                        if block is not None:
                            full.append(block.row(number))
                            number, chars = number + 1, chars + block.chars
                        block = Block(conv)
                    # Of equal rows, all but the first repeat it, blank ones are blank before they are anything else.
                    block.add(turn, role, text, "duplicate" if copy and fault != "blank" else fault)
                    if len(full) >= 500 or chars >= 4 * BLOCK_CHARS:
                        yield pa.RecordBatch.from_pylist(full, schema)
                        full, chars = [], 0
        if block is not None:
            full.append(block.row(number))
        yield pa.RecordBatch.from_pylist(full, schema)

    return rows.select(*names).mapInArrow(work, BLOCKS)


def chosen(blocks: DataFrame) -> DataFrame:
    """(block, way): which of its block's paths, the labels' place in `ways`, the cheapest path of the conversation takes.
    Blocks come sorted by conversation and number."""

    def path(conv: list[tuple[int, list[dict]]]) -> Iterator[tuple[int, int]]:
        best: dict[int, Weight] = {START: (0, "")}
        back = []
        for _, ways in conv:
            new: dict[int, tuple[Weight, int]] = {}
            for k, w in enumerate(ways):
                if w["i"] in best:
                    total = times(best[w["i"]], (w["cost"], w["labels"]))
                    if w["j"] not in new or total < new[w["j"]][0]:
                        new[w["j"]] = total, k
            back.append({j: k for j, (_, k) in new.items()})
            best = {j: w for j, (w, _) in new.items()}
        state = min((best[f], f) for f in FINAL if f in best)[1]
        for (number, ways), choice in zip(reversed(conv), reversed(back), strict=True):
            yield number, choice[state]
            state = ways[choice[state]]["i"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, out = None, [], []
        frame = lambda rows: pa.RecordBatch.from_pylist([{"block": b, "way": k} for b, k in rows], pa.schema([("block", pa.int64()), ("way", pa.int32())]))
        for batch in slices(batches):
            for c, b, ways in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "block", "ways")), strict=True):
                if own and c != conv:
                    out.extend(path(own))
                    own = []
                conv = c
                own.append((b, ways))
            if len(out) >= 10_000:
                yield frame(out)
                out = []
        if own:
            out.extend(path(own))
        yield frame(out)

    rows = blocks.select("conv_id", "block", "ways").repartition(shuffle_partitions(blocks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block")
    return rows.mapInArrow(work, "block long, way int")


def pieces(blocks: DataFrame) -> DataFrame:
    """What a block's chosen path leaves of its turns: `kept` (an array of role and text), the path's labels and cost."""
    columns = [c for c in blocks.columns if c not in ("roles", "texts", "ways", "way")]
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            kept, labels, cost = [], [], []
            for roles, texts, ways, way in zip(*(batch.column(c).to_pylist() for c in ("roles", "texts", "ways", "way")), strict=True):
                own, _ = follow(ways[way]["labels"], ways[way]["i"], roles, texts)
                kept.append([{"role": r, "text": t} for r, t in own])
                labels.append(ways[way]["labels"])
                cost.append(ways[way]["cost"])
            cols = [batch.column(c) for c in columns] + [pa.array(kept, turn), pa.array(labels, pa.string()), pa.array(cost, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, "kept", "labels", "cost"])

    ddl = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in columns)
    return blocks.mapInArrow(work, f"{ddl}, kept array<struct<role:string,text:string>>, labels string, cost long")


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary(parts: DataFrame) -> DataFrame:
    """RESULT of what `repair` gives. A conversation's pieces come to one task in order and are hashed one by one."""
    parts = parts.repartition(shuffle_partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block")
    schema = arrow_of(RESULT)

    class Conversation:
        def __init__(self, conv: int | None) -> None:
            self.row = {"conv_id": conv, **dict.fromkeys(COUNTS, 0), "cost": 0}
            self.audit, self.hash, self.left, self.tail = [], hashlib.sha256(), 0, None
            self.low = self.high = self.turn = None
            self.turns = 0

        def add(self, r: dict) -> None:
            for c in (*COUNTS, "cost"):
                self.row[c] += r[c]
            if self.tail is not None and self.tail + r["head"] not in LEGAL:
                self.row["illegal"] += 1
            self.tail = r["tail"]
            self.audit.append(r["labels"])
            for turn in r["kept"]:
                self.hash.update(f"{chr(10) * self.left}{turn['role']}:{turn['text']}".encode("utf-8", "surrogatepass"))
                self.left = 1
            if r["turns"]:
                self.turns += r["turns"] - (self.turn == r["first_turn"])
                self.turn = r["last_turn"]
                self.low = r["low"] if self.low is None else min(self.low, r["low"])
                self.high = r["high"] if self.high is None else max(self.high, r["high"])

        def result(self) -> dict:
            gaps = self.high - self.low + 1 - self.turns if self.turns else 0
            return {**self.row, "gaps": gaps, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out = None, []
        for batch in slices(batches, 100):
            for r in batch.to_pylist():
                if conv is None or conv.row["conv_id"] != r["conv_id"]:
                    if conv is not None:
                        out.append(conv.result())
                    conv = Conversation(r["conv_id"])
                conv.add(r)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if conv is not None:
            out.append(conv.result())
        yield pa.RecordBatch.from_pylist(out, schema)

    return parts.mapInArrow(work, RESULT)


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows are one) and fault: of the first of them, '' for none."""
    digest = F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))
    rows = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", digest))
    # The first turn of each role and text; its row is found again by all three, so no key is hot in the join.
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn")).alias("t"))
    first = first.select(F.col("conv_id").alias("__c"), F.col("digest").alias("__d"), F.col("t.turn").alias("__t"), F.lit(True).alias("__first"))
    on = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("digest") == F.col("__d")) & F.col("turn").eqNullSafe(F.col("__t"))
    rows = rows.join(first, on, "left")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("__first").isNull(), "duplicate")
    fault = fault.when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    return rows.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of `rows` (conv_id, turn, role, text, n: how many equal rows there are), in
    pieces of a block of turns each: conv_id, block (in order), kept (the repaired turns), labels and cost of its edits, and counts.

    Turns go by turn (nulls first), then role, then text; equal rows are adjacent and repeat each other. A null conv_id is
    a conversation. Roles of any kind may occur: those that begin with neither s, u nor a can't be kept. A conversation
    whose turns all go has an empty repair. Texts are whole, however long; ties between repairs go to the smaller audit,
    which fixes the repair; an empty table gives no rows; other columns are ignored.
    """
    parts = shuffle_partitions(rows.sparkSession)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    blocks = stored(cut(with_faults(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)))
    return pieces(blocks.join(stored(chosen(blocks)), "block"))


def repaired_turns(parts: DataFrame) -> DataFrame:
    """The turns of what `repair` gives: conv_id, block and place (their order), role, text."""
    rows = parts.select("conv_id", "block", F.posexplode("kept").alias("place", "t"))
    return rows.select("conv_id", "block", "place", "t.role", "t.text")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conv_id of `conversations` with the repair of its rows after damage; zeros, an empty audit and the empty
    string's hash if no row is left. An id may be null; nulls elsewhere are as `damaged` says."""
    found = summary(repair(damaged(conversations))).withColumnRenamed("conv_id", "__c")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = ids.join(found, F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: crc32 byte by byte, bit by bit; then one step of the recursion per turn, with the cheapest (cost, audit) of each state
#: of the grammar: z start, s system, u user, a assistant. Insertions come before a turn or after the last one.
ORACLE = r"""
with recursive base as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint), lambda c, b:
      list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295), 4294967295) % 20 as kind
  from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations)),
hit as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
  case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when kind = 3 then [1, 2] else [1] end) as copy from base where kind <> 0),
num as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n,
  row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
  lag(role) over (partition by conv_id order by turn nulls first, role, text, copy) as before from hit),
rows_ as (select *, substr(role, 1, 1) as ini, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when seen > 1 then 'duplicate'
  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault from num),
per as (select conv_id, count(*) as total, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
  count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (before is not null and (substr(before, 1, 1) || ini) not in ('su', 'ua', 'au')) as illegal from rows_ group by conv_id),
walk as (
  select conv_id, 0::bigint as n, {'c': 0, 's': ''} as z, {'c': 100000000, 's': ''} as s, {'c': 100000000, 's': ''} as u, {'c': 100000000, 's': ''} as a from per
  union all
  select conv_id, n + 1,
    {'c': z.c + 2, 's': z.s || 'D'},
    list_min([{'c': s.c + 2, 's': s.s || 'D'}, case when k and ini = 's' then {'c': z.c + t, 's': z.s || 'K'} else {'c': 100000000, 's': ''} end]),
    list_min(list_concat([{'c': iu.c + 2, 's': iu.s || 'D'}], case when k then list_transform([z, s, ia], lambda x: case when ini = 'u' then {'c': x.c + t, 's': x.s || 'K'} else {'c': x.c + t + 1, 's': x.s || 'R'} end) else [] end)),
    list_min(list_concat([{'c': ia.c + 2, 's': ia.s || 'D'}], case when k then [case when ini = 'a' then {'c': iu.c + t, 's': iu.s || 'K'} else {'c': iu.c + t + 1, 's': iu.s || 'R'} end] else [] end))
  from (select w.conv_id, w.n, w.z, w.s, list_min([w.u, {'c': w.z.c + 5, 's': w.z.s || 'I'}, {'c': w.s.c + 5, 's': w.s.s || 'I'}, {'c': w.a.c + 5, 's': w.a.s || 'I'}]) as iu,
      list_min([w.a, {'c': w.u.c + 5, 's': w.u.s || 'I'}]) as ia, r.ini, r.fault in ('', 'truncated') as k, case when r.fault = 'truncated' then 5 else 0 end as t
    from walk w join rows_ r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1)),
done as (select p.*, list_min([w.z, w.a, {'c': w.u.c + 5, 's': w.u.s || 'I'}]) as best from per p join walk w on w.conv_id is not distinct from p.conv_id and w.n = p.total),
steps as (select conv_id, best.s as audit, unnest(range(1, length(best.s) + 1)) as i from done),
marks as (select *, substr(audit, i, 1) as e from steps),
at_ as (select *, sum((e <> 'I')::int) over w as rn, sum((e <> 'D')::int) over w as o, sum((e <> 'D')::int) over (partition by conv_id) as m from marks window w as (partition by conv_id order by i)),
outs as (select x.conv_id, x.o, case when e = 'K' then r.role when (x.o + x.m % 2) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else r.text end as line
  from at_ x left join rows_ r on r.conv_id is not distinct from x.conv_id and r.n = x.rn where e <> 'D'),
rep as (select conv_id, string_agg(line, chr(10) order by o) as repaired from outs group by conv_id)
select c.conv_id, coalesce(d.gaps, 0)::bigint as gaps, coalesce(d.blank, 0)::bigint as blank, coalesce(d.duplicate, 0)::bigint as duplicate, coalesce(d.truncated, 0)::bigint as truncated,
  coalesce(d.illegal, 0)::bigint as illegal, coalesce(d.best.c, 0)::bigint as cost, coalesce(d.best.s, '') as audit, sha256(coalesce(rep.repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join done d on d.conv_id is not distinct from c.conv_id left join rep on rep.conv_id is not distinct from c.conv_id
"""
