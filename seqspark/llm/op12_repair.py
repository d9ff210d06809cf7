"""Conversation structure repair: the cheapest edits that give every conversation the shape ``(s?(ua)+)?``.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for a blank or duplicate row), Insert an
empty user or assistant row 5; a truncated row that is not deleted adds 5.  Among the cheapest edits the one
whose letters are ASCII-least wins.

The choice is an ordinary shortest path over the DAG of (rows done, state), with one integer per path: the cost
in the high digits, below it one fixed-width digit per audit letter in reading order, zero where the audit has
ended.  Smaller integers are cheaper, then ASCII-less.  Two paths of equal cost to one node never have audits
of which one begins the other (the rest would be inserts, which cost), so the minimum at a node is right for
every continuation.  After ``CHUNK`` rows the digits are moved to a chain of letters and replaced by the path's
rank among the survivors (at most one per state), so the integers stay small in a conversation of any length.

Spark numbers the rows and finds the faults; rows of a conversation then pass one task in order, as Arrow
batches, twice: for the edits (without texts) and, behind a header row with the audit, for the repaired rows.
A conversation of any length needs memory for its audit alone.  It is not split over tasks, because its digest
is one SHA-256 over the repaired text, which can only be taken in sequence.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from seqspark.llm.common import save, sliced

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5      # costs
LETTERS = "DIKR"                                            # digits 1 .. 4, in ASCII order
BITS = 3
CHUNK = 32
DIGITS = 3 * CHUNK + 2                                      # a row has one letter after at most two inserts; two at the end
TOP = BITS * DIGITS                                         # rank of the earlier letters, 2 bits, then the cost
START, SYSTEM, USER, ASSISTANT = range(4)                   # what the last row is
NEXT_USER = (START, SYSTEM, ASSISTANT)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SPACE = " \t\n\x0b\x0c\r"


def damage(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by crc32(``conv_id:turn``) % 20; nulls there and in role and text: a space.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets role user.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(conv_col).cast("string"), blank), F.coalesce(F.col(turn_col).cast("string"), blank))
    rows = convs.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, blank).alias("role"),
                        F.coalesce(text_col, blank).alias("text"), (F.crc32(F.encode(key, "utf-8")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_c")).drop("_c")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, seq, turn, role, text, fault): seq from 0 by turn (nulls first), role, text; fault is the row's first one.

    Null role and text count as one space.  ``duplicate``: role and text occur earlier in the conversation.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))
    at = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("seq")
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = (F.when(end == "", "blank").when(F.col("_again") > 1, "duplicate")
             .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated"))
    return (rows.withColumn("seq", (F.row_number().over(at) - 1).cast("long")).withColumn("_again", F.row_number().over(same))
            .select("conv_id", "seq", "turn", "role", "text", fault.alias("fault")))


class Repair:
    """Shortest path over the rows of one conversation, given one by one."""

    def __init__(self):
        self.at = {START: (0, 0)}                           # state: (scalar, letters since the chunk began)
        self.chain = {START: None}                          # state at the chunk's begin: (chain before, letters)
        self.origin = {START: START}                        # state: where its path stood when the chunk began
        self.rows = 0

    @staticmethod
    def _step(path, cost, letter):
        v, p = path
        return v + (cost << (TOP + 2)) + ((LETTERS.index(letter) + 1) << BITS * (DIGITS - 1 - p)), p + 1

    def _inserted(self, at, origin):
        """Best path and its survivor of origin per state, with up to two inserts behind it (a third comes back to a state)."""
        best = {s: (path, origin[s]) for s, path in at.items()}
        layer = best
        for _ in range(2):
            new: dict = {}
            for s, (path, o) in layer.items():
                to = ASSISTANT if s == USER else USER
                got = (self._step(path, INSERT, "I"), o)
                if to not in new or got < new[to]:
                    new[to] = got
            for s, got in new.items():
                if s not in best or got < best[s]:
                    best = {**best, s: got}
            layer = new
        return best

    def row(self, initial: str, fault: str | None):
        before = self._inserted(self.at, self.origin)
        new: dict = {}

        def offer(state, path, o):
            if state not in new or (path, o) < new[state]:
                new[state] = (path, o)

        extra = TRUNCATED if fault == "truncated" else 0
        for s, (path, o) in before.items():
            offer(s, self._step(path, DELETE, "D"), o)
            if fault in ("blank", "duplicate"):
                continue
            if s == START and initial == "s":
                offer(SYSTEM, self._step(path, KEEP + extra, "K"), o)
            if s == USER:
                offer(ASSISTANT, self._step(path, extra + (KEEP if initial == "a" else REROLE), "K" if initial == "a" else "R"), o)
            else:
                offer(USER, self._step(path, extra + (KEEP if initial == "u" else REROLE), "K" if initial == "u" else "R"), o)
        self.at = {s: path for s, (path, _) in new.items()}
        self.origin = {s: o for s, (_, o) in new.items()}
        self.rows += 1
        if self.rows % CHUNK == 0:
            self._fold()

    @staticmethod
    def _letters(path) -> str:
        v, p = path
        return "".join(LETTERS[(v >> BITS * (DIGITS - 1 - i) & 7) - 1] for i in range(p))

    def _fold(self):
        """Letters go to the chains; their order among the survivors is kept as a rank."""
        low = lambda s: self.at[s][0] & ((1 << (TOP + 2)) - 1)
        rank = {s: k for k, s in enumerate(sorted(self.at, key=low))}
        self.chain = {s: (self.chain[self.origin[s]], self._letters(self.at[s])) for s in self.at}
        self.at = {s: ((v >> (TOP + 2) << (TOP + 2)) + (rank[s] << TOP), 0) for s, (v, _) in self.at.items()}
        self.origin = {s: s for s in self.at}

    def result(self) -> tuple[int, str]:
        ends = self._inserted(self.at, self.origin)
        path, o = min(ends[s] for s in (START, ASSISTANT) if s in ends)
        parts, chain = [self._letters(path)], self.chain[o]
        while chain:
            parts.append(chain[1])
            chain = chain[0]
        return path[0] >> (TOP + 2), "".join(reversed(parts))


class Replay:
    """Repaired (edit, role, text) triples from an audit and the conversation's rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _go(self, edit, role, text):
        initial = role[:1]
        self.state = SYSTEM if initial == "s" else USER if self.state != USER else ASSISTANT
        return edit, role, text

    def _wanted(self):
        return "assistant" if self.state == USER else "user"

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._go("I", self._wanted(), "")

    def row(self, role: str, text: str):
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._go("K", role, text)
        elif edit == "R":
            yield self._go("R", self._wanted(), text)


def plan_repairs(faulty: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): one row per conversation that has rows."""
    conv = faulty.schema["conv_id"]
    schema = StructType([conv, *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType())])
    narrow = faulty.select("conv_id", "seq", "turn", F.left("role", F.lit(1)).alias("initial"), "fault")

    def run(batches):
        key, open_, done, kind = None, None, [], None

        def close():
            r = open_["repair"].result()
            lo, hi, distinct = open_["turns"]
            done.append((key, hi - lo + 1 - distinct if distinct else 0, *[open_[c] for c in ("blank", "duplicate", "truncated", "illegal")], *r))

        def out():
            cols = list(zip(*done)) if done else [[] for _ in schema.fields]
            types = [kind, *[pa.int64()] * len(COUNTS), pa.string()]
            done_now = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=schema.names)
            done.clear()
            return done_now

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv_id, _, turn, initial, fault in zip(*[c.to_pylist() for c in b.columns]):
                if open_ is None or conv_id != key:
                    if open_:
                        close()
                    key, open_ = conv_id, {"repair": Repair(), "turns": (None, None, 0), "blank": 0, "duplicate": 0,
                                           "truncated": 0, "illegal": 0, "last": None}
                lo, hi, distinct = open_["turns"]
                if turn is not None and turn != hi:
                    open_["turns"] = (turn if lo is None else lo, turn, distinct + 1)
                if fault:
                    open_[fault] += 1
                if open_["last"] is not None and open_["last"] + initial not in ("su", "ua", "au"):
                    open_["illegal"] += 1
                open_["last"] = initial
                open_["repair"].row(initial, fault)
            if done:
                yield out()
        if open_:
            close()
            yield out()

    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, schema)


def _replayed(faulty: DataFrame, plans: DataFrame, schema: StructType, make) -> DataFrame:
    """Rows of ``make()`` objects fed with every conversation's header (its plan) and rows in order."""
    head = plans.select("conv_id", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("role"),
                        F.lit(None).cast("string").alias("text"), F.struct(*COUNTS, "audit").alias("plan"))
    rows = faulty.select("conv_id", "seq", "role", "text", F.lit(None).cast(head.schema["plan"].dataType).alias("plan"))

    def run(batches):
        sink = None
        for b in sliced(batches):
            for conv_id, seq, role, text, plan in zip(*[c.to_pylist() for c in b.columns]):
                if seq < 0:
                    if sink:
                        sink.end()
                    sink = sink or make(b.schema.field("conv_id").type)
                    sink.begin(conv_id, plan)
                else:
                    sink.row(role, text)
            if out := sink.flush() if sink else None:
                yield out
        if sink:
            sink.end()
            if out := sink.flush():
                yield out

    return head.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, schema)


class _Sink:
    """Collects finished tuples into record batches."""

    def __init__(self, kind, schema: StructType):
        self.out, self.names = [], schema.names
        self.types = [kind, *[pa.int64() if isinstance(f.dataType, LongType) else pa.string() for f in schema.fields[1:]]]

    def begin(self, conv_id, plan):
        self.conv_id, self.plan, self.replay = conv_id, plan, Replay(plan["audit"])

    def row(self, role, text):
        for made in self.replay.row(role, text):
            self.take(*made)

    def flush(self):
        if not self.out:
            return None
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*self.out), self.types)], names=self.names)
        self.out.clear()
        return batch


def repaired_rows(faulty: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired conversations, position from 0."""
    schema = StructType([faulty.schema["conv_id"], StructField("position", LongType()), StructField("edit", StringType()),
                         StructField("role", StringType()), StructField("text", StringType())])

    class Rows(_Sink):
        def begin(self, conv_id, plan):
            super().begin(conv_id, plan)
            self.n = 0

        def take(self, edit, role, text):
            self.out.append((self.conv_id, self.n, edit, role, text))
            self.n += 1

        def end(self):
            for made in self.replay.inserts():
                self.take(*made)

    return _replayed(faulty, plans, schema, lambda kind: Rows(kind, schema))


def repair_digests(faulty: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, counts, cost, audit, repaired_sha256): SHA-256 of the repaired ``role:text`` lines."""
    schema = StructType([faulty.schema["conv_id"], *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType()),
                         StructField("repaired_sha256", StringType())])

    class Digest(_Sink):
        def begin(self, conv_id, plan):
            super().begin(conv_id, plan)
            self.sha, self.sep = hashlib.sha256(), ""

        def take(self, edit, role, text):
            self.sha.update(f"{self.sep}{role}:{text}".encode())
            self.sep = "\n"

        def end(self):
            for made in self.replay.inserts():
                self.take(*made)
            self.out.append((self.conv_id, *[self.plan[c] for c in COUNTS], self.plan["audit"], self.sha.hexdigest()))

    return _replayed(faulty, plans, schema, lambda kind: Digest(kind, schema))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with faults, plans) of ``rows(conv_id, turn, role, text)``, both written tables.

    A null conv_id is a conversation of its own; rows of one turn stand in the order of role and text; repeated
    rows are duplicates of the first; other columns are ignored; an empty table gives empty tables.
    """
    faulty = save(with_faults(rows), "repair-rows")
    return faulty, save(plan_repairs(faulty), "repair-plans")


def repair_report(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``convs``, from the repair of ``rows``; without rows: zeros and empty strings' values."""
    ids = convs.select(F.col("conv_id").alias("_id")).distinct()
    found = repair_digests(*repair(rows))
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_scalar_dag(spark, sf_dir):
    from seqspark.llm.common import table
    convs = table(spark, sf_dir, "conversations")
    return repair_report(convs, damage(convs))


_CRC = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({k}, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))")


def _moved(path: str, cost: str, letter: str) -> str:
    return f"(CASE WHEN {path} IS NOT NULL THEN {{'c': {path}.c + {cost}, 'a': {path}.a || {letter}}} END)"


def _best(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


_T = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
_OK = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"


def _to(path: str, initial: str) -> str:
    how = f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END"
    return f"(CASE WHEN {_OK} THEN {_moved(path, f'(CASE WHEN initial = {initial!r} THEN 0 ELSE 1 END + {_T})', how)} END)"


_INSERTED = f"""v0 AS i0, v1 AS i1,
    {_best('v2', *[_moved(v, '5', "'I'") for v in ('v0', 'v1', 'v3')])} AS i2,
    {_best('v3', _moved('v2', '5', "'I'"), *[_moved(v, '10', "'II'") for v in ('v0', 'v1')])} AS i3"""

OP12_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format(k="concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS d FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed WHERE d <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY seq) AS again
  FROM (SELECT conv_id, turn, role, text, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq FROM damaged)),
faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
                 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         count(*) OVER (PARTITION BY conv_id) AS n,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY seq) AS before FROM numbered),
paths AS (
  SELECT conv_id, 0::BIGINT AS seq, n, {{'c': 0, 'a': ''}} AS v0, NULL::STRUCT(c INTEGER, a VARCHAR) AS v1,
         NULL::STRUCT(c INTEGER, a VARCHAR) AS v2, NULL::STRUCT(c INTEGER, a VARCHAR) AS v3
  FROM faulty WHERE seq = 1
  UNION ALL
  SELECT conv_id, seq, n, {_moved('i0', '2', "'D'")},
         {_best(_moved('i1', '2', "'D'"), f"(CASE WHEN initial = 's' AND {_OK} THEN {_moved('i0', _T, chr(39) + 'K' + chr(39))} END)")},
         {_best(_moved('i2', '2', "'D'"), *[_to(v, 'u') for v in ('i0', 'i1', 'i3')])},
         {_best(_moved('i3', '2', "'D'"), _to('i2', 'a'))}
  FROM (SELECT f.conv_id, f.seq, p.n, initial, fault, {_INSERTED}
        FROM paths p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.seq = p.seq + 1)),
audits AS (
  SELECT conv_id, {_best('i0', 'i3')} AS best FROM (SELECT conv_id, {_INSERTED} FROM paths WHERE seq = n)),
letters AS (SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS p FROM audits),
placed AS (
  SELECT conv_id, p, audit[p] AS letter, length(replace(audit[1:p], 'I', '')) AS seq,
         length(replace(audit[1:p], 'D', '')) AS q FROM letters),
joined AS (
  SELECT l.*, f.role, f.text, f.initial,
         bool_or(q = 1 AND letter = 'K' AND initial = 's') OVER (PARTITION BY l.conv_id) AS has_s
  FROM placed l LEFT JOIN faulty f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.seq = f.seq AND letter <> 'I'
  WHERE letter <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role
           WHEN (q - CASE WHEN has_s THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM joined GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE seq > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counted c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON i.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON i.conv_id IS NOT DISTINCT FROM r.conv_id
"""
