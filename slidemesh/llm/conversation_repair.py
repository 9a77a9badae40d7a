"""Conversation structure repair by secondary-sorted streaming.

Rows are partitioned by conversation and sorted by turn within the partition. mapInPandas walks them once: a dynamic program over the
grammar of role initials, (s?(ua)+)?, keeps one cost, one rank and one running hash for each of its four states across Arrow batches, so
memory does not grow with a conversation but for two bytes a row, the back-pointers, which giant conversations spill in blocks below
spark.checkpoint.dir. At a conversation's end the pointers are followed backwards to the audit string of its cheapest edits."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.llm.common import query, table
from slidemesh.runtime import ensure_checkpoint_dir, ship

WHITE = r"\x20\x09-\x0D"
START, SYSTEM, USER, ASSISTANT = range(4)                   # what stands last in the repaired conversation
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1     # costs
FINE, BLANK, DUPLICATE, CUT = range(4)                      # faults
SPILL_ROWS = 4_000_000                                      # rows of one conversation whose back-pointers stay in memory
SORTED = ["known", "conv", "present", "dated", "turn", "role", "text", "nth"]      # of equal rows the first is no duplicate
TURNS = "known boolean, conv string, present boolean, dated boolean, turn long, role string, text string, fault int"


def _wanted(state: int) -> str:
    """The only initial that may be inserted or given to a row after `state`."""
    return "a" if state == USER else "u"


def _moves(initial: str, fault: int) -> list[tuple[int, int, int, str, str]]:
    """(from, to, cost, edits, roles put in) of the cheapest way from state to state over one row, edits being inserts and then what befalls the
    row; of equally cheap ways the ASCII-least. No two ways with the same edits lead from one state to different ones."""
    best: dict[tuple[int, int], tuple[int, str, str]] = {}
    for state, inserts in product(range(4), range(3)):
        at, put = state, ""
        for _ in range(inserts):
            put += _wanted(at)
            at = NEXT[at, _wanted(at)]
        ways = [(at, DELETE, "D", put)]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            if (at, initial) in NEXT:
                ways.append((NEXT[at, initial], KEEP + extra, "K", put))
            ways.append((NEXT[at, _wanted(at)], REROLE + extra, "R", put + _wanted(at)))
        for to, cost, letter, roles in ways:
            way = (cost + INSERT * inserts, "I" * inserts + letter, roles)
            best[state, to] = min(best.get((state, to), way), way)
    return [(a, b, *w) for (a, b), w in best.items()]


# row kinds: initial and fault; what an initial other than s, u, a is does not matter
KINDS = {(i, f): k for k, (i, f) in enumerate(product("sua-", range(4)))}
MOVES = [_moves(i, f) for i, f in KINDS]
EDITS = [{(a, b): edits for a, b, _, edits, _ in moves} for moves in MOVES]
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}   # inserts that end a conversation after each state


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    """Rows as TURNS, partitioned by conversation and sorted by turn, role and text in it, with the fault of each."""
    ship(rows.sparkSession)
    conv, turn = F.col(conv_col), F.col(turn_col).cast("long")
    out = rows.select(conv.isNotNull().alias("known"), F.coalesce(conv.cast("string"), F.lit("")).alias("conv"),
                      (F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)).alias("present"), turn.isNotNull().alias("dated"), F.coalesce(turn, F.lit(0)).alias("turn"),
                      F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    out = out.repartition("known", "conv")
    # the numbering sorts within the partitions made above; nothing is shuffled again and no group is held in memory
    nth = F.expr("row_number() over (partition by known, conv, present, role, text order by dated, turn)")
    blank, ended = ~F.rlike("text", F.lit(f"[^{WHITE}]")), F.rlike("text", F.lit(rf"[.!?][{WHITE}]*\z"))
    fault = F.when(blank, BLANK).when(F.col("nth") > 1, DUPLICATE).when(~ended, CUT).otherwise(FINE)
    return out.withColumn("nth", nth).withColumn("fault", fault).sortWithinPartitions(*SORTED).drop("nth")


class _Pointers:
    """Back-pointers of one conversation, two bytes a row: the state before each of the four states, and the row's kind."""

    def __init__(self, folder: str):
        self.folder, self.rows, self.files = folder, bytearray(), []

    def add(self, before: int, kind: int) -> None:
        self.rows.append(before)
        self.rows.append(kind)
        if len(self.rows) >= 2 * SPILL_ROWS:
            store, root = pafs.FileSystem.from_uri(self.folder)
            store.create_dir(root)
            path = f"{root}/{uuid.uuid4().hex}"
            with store.open_output_stream(path) as out:
                out.write(self.rows)
            self.files.append(path)
            self.rows = bytearray()

    def backwards(self) -> Iterator[bytes]:
        yield bytes(self.rows)
        if self.files:
            store = pafs.FileSystem.from_uri(self.folder)[0]
            while self.files:
                with store.open_input_stream(self.files[-1]) as f:
                    block = f.read()
                yield block
                store.delete_file(self.files.pop())


class _Walk:
    """The dynamic program over one conversation."""

    def __init__(self, folder: str):
        self.cost, self.rank = [0, None, None, None], [0, 0, 0, 0]
        self.sums = [hashlib.sha256(), None, None, None]
        self.pointers = _Pointers(folder)
        self.faults, self.illegal, self.last, self.rows = [0, 0, 0, 0], 0, None, 0
        self.low = self.high = self.turn = None
        self.turns = 0

    def row(self, dated: bool, turn: int, role: str, text: str, fault: int) -> None:
        if dated:
            if self.low is None:
                self.low = turn
            if self.turn != turn or not self.turns:
                self.turns += 1
            self.high = self.turn = turn
        initial = role[:1]
        if self.rows and (self.last + initial) not in ("su", "ua", "au"):
            self.illegal += 1
        self.last, self.rows = initial, self.rows + 1
        self.faults[fault] += 1
        kind = KINDS[initial if initial in ("s", "u", "a") else "-", fault]
        best: list[tuple | None] = [None] * 4
        for a, b, c, edits, roles in MOVES[kind]:
            if self.cost[a] is not None:
                way = (self.cost[a] + c, self.rank[a], edits, a, roles)
                if best[b] is None or way < best[b]:
                    best[b] = way
        order = sorted((x[1:3], b) for b, x in enumerate(best) if x)
        line, sums, before = f"{role}:{text}".encode(errors="surrogatepass"), [None] * 4, 0
        for rank, (_, b) in enumerate(order):
            _, _, edits, a, roles = best[b]
            s = self.sums[a].copy()
            empty = a == START
            put = roles[:-1] if edits[-1] == "R" else roles
            for r in put:
                s.update(f"{'' if empty else chr(10)}{NAMES[r]}:".encode())
                empty = False
            if edits[-1] != "D":
                s.update(b"" if empty else b"\n")
                s.update(line if edits[-1] == "K" else f"{NAMES[roles[-1]]}:{text}".encode(errors="surrogatepass"))
            sums[b] = s
            self.rank[b] = rank
            before |= a << (2 * b)
        self.cost = [x[0] if x else None for x in best]
        self.sums = sums
        self.pointers.add(before, kind)

    def done(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        total, _, state = min((c + INSERT * len(TAILS[q]), self.rank[q], q) for q, c in enumerate(self.cost) if c is not None)
        s, tail = self.sums[state], TAILS[state]
        at = state
        for _ in tail:
            s.update(f"{chr(10) if at != START else ''}{NAMES[_wanted(at)]}:".encode())
            at = NEXT[at, _wanted(at)]
        pieces = [tail]
        for block in self.pointers.backwards():
            edits = []
            for k in range(len(block) - 2, -1, -2):
                a = block[k] >> (2 * state) & 3
                edits.append(EDITS[block[k + 1]][a, state])
                state = a
            pieces.append("".join(reversed(edits)))
        return gaps, *self.faults[1:], self.illegal, total, "".join(reversed(pieces)), s.hexdigest()


SUMMARY = "known boolean, conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summaries(turns: DataFrame, folder: str) -> DataFrame:
    names = [x.split()[0] for x in SUMMARY.split(", ")]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for frame in frames:
            for known, conv, present, dated, turn, role, text, fault in zip(*(frame[c].tolist() for c in frame.columns)):
                if (known, conv) != key:
                    if key is not None:
                        out.append((*key, *state.done()))
                    key, state = (known, conv), _Walk(folder)
                if present:
                    state.row(dated, turn, role, text, fault)
            if len(out) >= 1000 or sum(len(x[8]) for x in out) > 1 << 24:
                yield pd.DataFrame(out, columns=names)
                out = []
        if key is not None:
            out.append((*key, *state.done()))
        if out:
            yield pd.DataFrame(out, columns=names)

    return turns.mapInPandas(walk, SUMMARY)


def _folder(rows: DataFrame) -> str:
    spark = rows.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/repair-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    return root if ":/" in root else f"file://{root}"


def repair_summary(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    Rows are taken by turn, null turns first; rows of one turn by role and text. Each row's first fault counts: blank (nothing but white space),
    duplicate (role and text stand in an earlier row), truncated (the last character that isn't white space is none of . ! ?). Edits make the role
    initials match (s?(ua)+)?: Keep costs 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate rows must go), Insert of an empty
    user or assistant turn 2; a truncated row that stays adds 1. `audit` holds the initials of the cheapest edits in order, of equally cheap ones the
    ASCII-least. `gaps` is the number of turn numbers missing between the smallest and the largest, `illegal` that of neighbours whose
    initials are not su, ua or au. `repaired_sha256` is that of the repaired `role:text` lines, joined by line feeds.

    A null role or text is one space; an unknown or empty role is never kept. A null conv_id is a conversation of its own. Rows whose
    `present_col` is false or null only announce their conversation; one without other rows has zeros, an empty audit and the hash of nothing. An
    empty table gives an empty table. Other columns are not looked at. One conversation is walked by one task, in constant memory."""
    found = _summaries(_turns(rows, conv_col, turn_col, role_col, text_col, present_col), _folder(rows))
    kind = rows.schema[conv_col].dataType
    return found.select(F.when(F.col("known"), F.col("conv").cast(kind)).alias("conv_id"), *found.columns[2:])


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """(conv_id, position, role, text, edit, turn): the rows of every repaired conversation in order, position from 0; edit is Keep, Rerole or
    Insert, and inserted rows have no turn. Rows and their handling are those of `repair_summary`, whose audits are streamed ahead of the rows they edit."""
    turns = _turns(rows, conv_col, turn_col, role_col, text_col, present_col)
    audits = _summaries(turns, _folder(rows)).select("known", "conv", F.lit(False).alias("present"), F.lit(False).alias("dated"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("fault"))
    # of equal rows the duplicates come last, as in the audit
    both = turns.where("present").unionByName(audits).repartition("known", "conv").withColumn("again", F.col("fault") == DUPLICATE)
    both = both.sortWithinPartitions(*SORTED[:-1], "again").drop("again")
    schema = "known boolean, conv string, position long, role string, text string, edit string, dated boolean, turn long"
    names = [x.split()[0] for x in schema.split(", ")]

    def edit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, audit, tail, at, position, last = None, "", 0, 0, 0, START
        for frame in frames:
            out = []

            def put(role: str, text: str, name: str, dated: bool, turn: int) -> None:
                out.append((*key, position, role, text, name, dated, turn))

            def inserts() -> None:
                nonlocal at, position, last
                while at < len(audit) and audit[at] == "I":
                    put(NAMES[_wanted(last)], "", "Insert", False, 0)
                    last = NEXT[last, _wanted(last)]
                    at, position = at + 1, position + 1

            for known, conv, present, dated, turn, role, text, _ in zip(*(frame[c].tolist() for c in frame.columns)):
                if not present:
                    key, audit, tail, at, position, last = (known, conv), text, len(text.rstrip("I")), 0, 0, START
                    continue
                inserts()
                letter, at = audit[at], at + 1
                if letter != "D":
                    initial = role[:1] if letter == "K" else _wanted(last)
                    put(role if letter == "K" else NAMES[initial], text, "Keep" if letter == "K" else "Rerole", dated, turn)
                    last, position = NEXT[last, initial], position + 1
                if at == tail:      # the last row has been edited
                    inserts()
            if out:
                yield pd.DataFrame(out, columns=names)

    kind = rows.schema[conv_col].dataType
    found = both.mapInPandas(edit, schema)
    return found.select(F.when(F.col("known"), F.col("conv").cast(kind)).alias("conv_id"), "position", "role", "text", "edit", F.when(F.col("dated"), F.col("turn")).alias("turn"))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) harmed as crc32(`conv_id:turn`) % 20 says: 0 drops the row (`present` false), 1 empties its text, 2 takes out
    . ! ?, 3 repeats it, 4 makes its role user. Nulls count as one space, but a null turn stays one."""
    one = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"),
                       (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one)).cast("binary")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "harm")
    return rows.withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))) \
        .select("conv_id", "turn", "role", "text", (F.col("harm") != 0).alias("present"))


@query("op13_conversation_repair", r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS b FROM conversations),
harm AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b)[2 * i - 1:2 * i])::BIGINT)),
           lambda c, x: list_reduce(list_concat([xor(c, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 20 AS harm FROM k),
d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
        CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM harm, range(0, CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) r(copy)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d) d),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS back FROM n),
ins(q, put, p, line) AS MATERIALIZED (VALUES ('0', 0, '0', ''), ('0', 1, 'u', E'user:\n'), ('0', 2, 'a', E'user:\nassistant:\n'), ('s', 0, 's', ''), ('s', 1, 'u', E'user:\n'), ('s', 2, 'a', E'user:\nassistant:\n'),
  ('u', 0, 'u', ''), ('u', 1, 'a', E'assistant:\n'), ('u', 2, 'u', E'assistant:\nuser:\n'), ('a', 0, 'a', ''), ('a', 1, 'u', E'user:\n'), ('a', 2, 'a', E'user:\nassistant:\n')),
legal(p, r) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS q, 0::BIGINT AS cost, '' AS audit, '' AS body FROM (SELECT DISTINCT conv_id FROM f) t
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit, best.body FROM (
    SELECT conv_id, i, q, min(struct_pack(cost := cost, audit := audit, body := body)) AS best FROM (
      SELECT dp.conv_id, f.i, e.q2 AS q, dp.cost + 2 * ins.put + e.c AS cost, dp.audit || repeat('I', ins.put) || e.letter AS audit,
             dp.body || ins.line || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || E'\n' ELSE CASE e.q2 WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text || E'\n' END AS body
      FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.q = dp.q,
        LATERAL (SELECT ins.p AS q2, 3 AS c, 'D' AS letter
                 UNION ALL SELECT f.r, CASE f.fault WHEN 'truncated' THEN 1 ELSE 0 END, 'K' FROM legal WHERE legal.p = ins.p AND legal.r = f.r AND f.fault IN ('fine', 'truncated')
                 UNION ALL SELECT legal.r, CASE f.fault WHEN 'truncated' THEN 3 ELSE 2 END, 'R' FROM legal WHERE legal.p = ins.p AND legal.r <> 's' AND f.fault IN ('fine', 'truncated')) e) t
    GROUP BY conv_id, i, q) t),
ends AS (SELECT dp.conv_id, min(struct_pack(cost := dp.cost + 2 * ins.put, audit := dp.audit || repeat('I', ins.put), body := dp.body || ins.line)) AS best
         FROM dp JOIN (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.i = dp.i JOIN ins ON ins.q = dp.q WHERE ins.p IN ('0', 'a') GROUP BY dp.conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND back || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.body, greatest(length(best.body) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id""")
def op13_conversation_repair(spark, sf):
    """Every conversation, damaged as its keys say, and its cheapest repair."""
    return repair_summary(damaged(table(spark, sf, "conversations")), present_col="present")
