"""Conversation structure repair: the cheapest edits that make the roles of a conversation read system?, (user, assistant)+.

Rows in order become a string of one letter each, for role and fault. Conversations share few such signatures, so each
distinct one is solved once, by memoised recursion; the audits are joined back and the edits replayed on the texts. Long
conversations are cut into blocks, whose signatures are solved for every state that the roles may be in before and after
them; what links a conversation's blocks are the costs of those solutions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.llm.common import BLANKS, col, stash, table

#: Rows and bytes of text of a block.
BLOCK, BLOCK_BYTES = 200, 4_000_000
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States of the roles so far: nothing yet, a system row, a user row, an assistant row; which state a role leads to.
STATES = "-sua"
_TO = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: The role that a state needs next, where the row itself doesn't have it.
_NEXT = {"-": "u", "s": "u", "u": "a", "a": "u"}
_ROLES = {"u": "user", "a": "assistant"}
_ENDS = {"-": "", "a": "", "u": "I", "s": "II"}  # inserts that end a conversation
_LEGAL = ("su", "ua", "au")
_NO_TURN = -(2**63)


def solve(signature: str) -> dict[tuple[str, str], tuple[int, str]]:
    """(state before, state after) -> cost and edits of a block: the cheapest, of equals the least in ASCII order.

    Letters: s, u, a or o (any other role), in upper case if the row is truncated; x for rows that must go. Inserts stand
    before a row, so no edits of a block are the start of others that use up the same rows.
    """

    @cache
    def best(i: int, state: str, goal: str) -> tuple[int, str] | None:
        if i == len(signature):
            return (0, "") if state == goal else None
        found = []
        for inserts in range(3):  # a third one would come back to a state
            for cost, edit, to in _moves(signature[i], state):
                if (rest := best(i + 1, to, goal)) is not None:
                    found.append((inserts * INSERT + cost + rest[0], "I" * inserts + edit + rest[1]))
            state = _NEXT[state]
        return min(found, default=None)

    return {(x, y): found for x in STATES for y in STATES if (found := best(0, x, y)) is not None}


def _moves(letter: str, state: str) -> Iterator[tuple[int, str, str]]:
    yield DELETE, "D", state
    if letter != "x":
        cut = CUT if letter.isupper() else 0
        if to := _TO.get((state, letter.lower())):
            yield KEEP + cut, "K", to
        yield REROLE + cut, "R", _NEXT[state]


def replay(roles: list[str], texts: list[str], audit: str, state: str) -> list[str]:
    """The repaired rows of a block, as role:text."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            out.append(f"{_ROLES[state]}:")
            continue
        role, text = roles[at], texts[at]
        at += 1
        if edit == "K":
            state = _TO[state, role[0]]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = _NEXT[state]
            out.append(f"{_ROLES[state]}:{text}")
    return out


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: each row damaged, or not, by crc32 of "conv_id:turn" modulo 20.

    0 drops it (copies is 0), 1 empties its text, 2 takes its . ! ? away, 3 repeats it (copies is 2), 4 makes it a user's.
    Null roles and texts are one blank, and so are null ids and turns in the key.
    """
    key = F.concat_ws(":", *[F.coalesce(col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn)])
    by = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    body = F.coalesce(col(text), F.lit(" "))
    return rows.select(
        col(conv_id).alias("conv_id"), col(turn).cast("long").alias("turn"),
        F.when(by == 4, F.lit("user")).when(by == 0, F.lit("")).otherwise(F.coalesce(col(role), F.lit(" "))).alias("role"),
        F.when(by.isin(0, 1), F.lit("")).when(by == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"),
        F.when(by == 0, 0).when(by == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


_BLOCK_FIELDS = ["block long", "signature string", "roles array<string>", "texts array<string>", "blank long", "duplicate long", "truncated long", "illegal long", "first_role string", "last_role string", "first_turn long", "last_turn long", "turns long"]
_STRINGS = pa.list_(pa.string())


class _Block:
    """What a block has gathered so far."""

    def __init__(self, conv) -> None:
        self.conv, self.letters, self.roles, self.texts, self.size = conv, [], [], [], 0
        self.counts, self.illegal, self.turns = dict.fromkeys("bdt", 0), 0, []
        self.first = self.last = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, letter: str, fault: str | None) -> None:
        if turn is not None:
            if not self.turns or self.turns[-1] != turn:
                self.distinct += 1
            self.turns = [*self.turns[:1], turn]
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in _LEGAL
        self.last = initial
        if fault:
            self.counts[fault] += 1
        self.letters.append(letter)
        gone = letter == "x"
        self.roles.append("" if gone else role)
        self.texts.append("" if gone else text)
        self.size += 0 if gone else len(text)

    def values(self, number: int) -> list:
        ends = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return [self.conv, number, "".join(self.letters), self.roles, self.texts, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.first, self.last, *ends, self.distinct]


def _blocks(faulty: DataFrame) -> DataFrame:
    """Rows in order, cut into blocks of one conversation each; a block's number grows along its conversation.

    Rows are dealt out in ranges of id, turn, role and text, so a long conversation spreads over tasks.
    """
    names = ["conv_id", *[f.split()[0] for f in _BLOCK_FIELDS]]
    kind = faulty.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, out, held = None, TaskContext.get().partitionId() << 40, [], 0
        schema = None

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [schema, pa.int64(), pa.string(), _STRINGS, _STRINGS, *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            schema = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                start = 0
                while True:  # once for each copy, and once for a row that was dropped
                    if block is None or block.conv != r["conv_id"] or len(block.letters) >= BLOCK or block.size >= BLOCK_BYTES:
                        if block is not None:
                            out.append(block.values(number))
                            number, held = number + 1, held + 20 + len(block.letters)
                        block = _Block(r["conv_id"])
                    if held > 5_000:
                        yield batch_of(out)
                        out, held = [], 0
                    if start >= r["copies"]:
                        break
                    # only the first of equal rows can be anything but a duplicate
                    fault = r["fault"] if start == 0 or r["fault"] == "b" else "d"
                    letter = r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "o"
                    block.add(r["turn"], r["role"], r["text"], "x" if fault in ("b", "d") else letter.upper() if fault == "t" else letter, fault)
                    start += 1
        if block is not None:
            out.append(block.values(number))
        if out:
            yield batch_of(out)

    order = ["conv_id", "turn", "role", "text"]
    return faulty.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind.simpleString()}, " + ", ".join(_BLOCK_FIELDS))


def _solved(signatures: DataFrame) -> DataFrame:
    """signature, found: for each way through it the states before and after, cost and edits."""
    ways = pa.list_(pa.struct([("a", pa.string()), ("z", pa.string()), ("cost", pa.int64()), ("edits", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            found = [[{"a": a, "z": z, "cost": cost, "edits": edits} for (a, z), (cost, edits) in sorted(solve(s).items(), key=lambda x: (x[0][0], x[1][1]))] for s in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ways)], names=["signature", "found"])

    return signatures.mapInArrow(run, "signature string, found array<struct<a:string,z:string,cost:long,edits:string>>")


def _paths(links: DataFrame, conv: str) -> DataFrame:
    """For each conversation its sums, and for each of its blocks the states before and after, from the blocks' costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, picks = [], []
            for blocks in batch.column(1).to_pylist():
                to_go = [{s: INSERT * len(e) for s, e in _ENDS.items()}]  # from the end back: costs from each state on
                for b in reversed(blocks):
                    last, here = to_go[-1], {}
                    for w in b["ways"]:
                        cost = w["cost"] + last[w["z"]]
                        here[w["a"]] = min(cost, here.get(w["a"], cost))
                    to_go.append(here)
                to_go.reverse()
                state, path = "-", []
                for b, now, then in zip(blocks, to_go, to_go[1:]):  # ways come in the order of their edits
                    way = next(w for w in b["ways"] if w["a"] == state and w["cost"] + then[w["z"]] == now[state])
                    path.append({"block": b["block"], "a": state, "z": way["z"]})
                    state = way["z"]
                illegal, distinct, seen, low, role = 0, 0, None, None, None
                for b in blocks:
                    illegal += b["illegal"]
                    if b["first_role"] is not None:
                        illegal += role is not None and role + b["first_role"] not in _LEGAL
                        role = b["last_role"]
                    if b["first_turn"] is not None:
                        distinct += b["turns"] - (seen == b["first_turn"])
                        low, seen = b["first_turn"] if low is None else low, b["last_turn"]
                gaps = 0 if low is None else min(seen - low + 1 - distinct, 2**63 - 1)
                rows.append([gaps, illegal, to_go[0]["-"], _ENDS[state]])
                picks.append(path)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.string()])]
            path_type = pa.list_(pa.struct([("block", pa.int64()), ("a", pa.string()), ("z", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(picks, path_type)], names=["conv_id", "gaps", "illegal", "cost", "tail", "path"])

    return links.mapInArrow(run, f"conv_id {conv}, gaps long, illegal long, cost long, tail string, path array<struct<block:long,a:string,z:string>>")


def _replayed(picked: DataFrame, conv: str, lone: bool) -> DataFrame:
    """conv_id, audit, repaired_sha256 from blocks with their edits; lone blocks stand alone, others come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, size, out = None, [], None, 0, []
        kind = None

        def result() -> list:
            return [now[0], "".join(audit), digest.hexdigest()]

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [kind, pa.string(), pa.string()])], names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if lone or now is None or now[0] != r["conv_id"]:
                    if now is not None:
                        out.append(result())
                    now, audit, digest, size = (r["conv_id"],), [], hashlib.sha256(), 0
                edits = r["edits"] + (r["tail"] if r["last"] else "")
                for line in replay(r["roles"], r["texts"], edits, r["a"]):
                    digest.update(("\n" if size else "").encode() + line.encode())
                    size += 1
                audit.append(edits)
            if len(out) >= 1:
                yield batch_of(out)
                out = []
        if now is not None:
            yield batch_of([*out, result()])

    ordered = picked if lone else picked.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return ordered.mapInArrow(run, f"conv_id {conv}, audit string, repaired_sha256 string")


def blank(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS)) == ""


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows (conv_id, turn, role, text, copies).

    A conversation's rows are taken by turn, nulls first; ties by role, then text, in UTF-8 order; copies is how often a row
    stands there (0: not at all, though its conversation is returned). A row's first fault counts: blank, duplicate (role
    and text were there before), truncated (the last character that is no blank isn't . ! or ?). gaps are turns missing
    between the least and the largest (2**63 - 1 at most); illegal are neighbours whose roles' initials aren't su, ua or au.

    The edits, K(eep) for 0, R(erole) to user or assistant for 1, D(elete) for 2, I(nsert) of an empty row of either for 5,
    leave initials that match (s?(ua)+)?; blank and duplicate rows must go, a truncated one that stays costs 5 more. Of
    the cheapest ways the audit is the least in ASCII order. repaired_sha256 is that of the repaired rows as role:text,
    joined by line feeds.

    Rows of a null conv_id are one conversation. Roles and texts mustn't be null. A conversation without rows has zeros, an
    empty audit and the hash of nothing; an empty table gives none. Texts and conversations may be of any length: a block
    has at most BLOCK rows; of a conversation one task at a time holds the costs of its blocks, and its own result. Only
    the digest, which can't be split, reads the blocks of a long conversation one after the other.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    conv = rows.schema["conv_id"].dataType.simpleString()
    equal = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    equal = stash(equal.withColumn("mark", F.md5(F.concat_ws("\n", F.octet_length("role").cast("string"), "role", "text").cast("binary"))), "conversations-rows")
    # the first turn of what a conversation says more than once; written, so that a hot one can be split in the join
    turn = F.coalesce("turn", F.lit(_NO_TURN))
    often = equal.where(~blank(F.col("text")) & (F.col("copies") > 0)).groupBy("conv_id", "mark").agg(F.count("*").alias("times"), F.min(turn).alias("first"), F.max(F.col("turn").isNull().cast("int")).alias("none"))
    often = stash(often.where(F.col("times") > 1).select(F.col("conv_id").alias("conv"), F.col("mark").alias("said"), "first", "none"), "conversations-often")
    joined = equal.join(often, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("mark") == F.col("said")), "left")
    later = F.col("said").isNotNull() & F.when(F.col("none") == 1, F.col("turn").isNotNull()).otherwise(turn > F.col("first"))
    ends = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1).isin(".", "!", "?")
    fault = F.when(blank(F.col("text")), "b").when(later, "d").when(~ends, "t")
    blocks = stash(_blocks(joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))), "conversations-blocks")
    solved = stash(_solved(blocks.select("signature").distinct()), "conversations-solved")
    slim = blocks.drop("roles", "texts").join(solved, "signature")
    ways = F.transform("found", lambda w: F.struct(w["a"].alias("a"), w["z"].alias("z"), w["cost"].alias("cost"))).alias("ways")
    link = F.struct("block", "illegal", "first_role", "last_role", "first_turn", "last_turn", "turns", ways)
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    chains = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", link.alias("link")))).alias("links"), *sums)
    chains = stash(chains.withColumn("links", F.transform("links", lambda x: x["link"])), "conversations-chains")
    paths = stash(_paths(chains.select("conv_id", "links"), conv), "conversations-paths")
    # a block's number is its own, so it finds its states by that
    picks = paths.select("tail", F.size("path").alias("of"), F.posexplode("path").alias("nth", "p")).select("tail", "of", (F.col("nth") == F.col("of") - 1).alias("last"), "p.*")
    edits = solved.select("signature", F.explode("found").alias("w")).select("signature", F.col("w.a").alias("a"), F.col("w.z").alias("z"), F.col("w.edits").alias("edits"))
    picked = blocks.select("conv_id", "block", "signature", "roles", "texts").join(picks, "block").join(edits, ["signature", "a", "z"])
    picked = stash(picked.select("conv_id", "block", "roles", "texts", "a", "edits", "tail", "last", "of"), "conversations-edits")
    done = _replayed(picked.where(F.col("of") == 1), conv, True).unionByName(_replayed(picked.where(F.col("of") > 1), conv, False))
    keyed = lambda df, name: df.withColumnRenamed("conv_id", name)
    out = keyed(paths.drop("path", "tail"), "c1").join(keyed(chains.drop("links"), "c2"), F.col("c1").eqNullSafe(F.col("c2"))).join(done, F.col("c1").eqNullSafe(F.col("conv_id")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP11_SQL = r"""
WITH RECURSIVE crcs AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) x(n)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 20 AS h
  FROM conversations, crcs),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
damaged AS (SELECT c, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth
  FROM raw JOIN convs ON raw.conv_id IS NOT DISTINCT FROM convs.conv_id),
placed AS (SELECT c, turn, role, text, left(role, 1) AS letter, trim(text, b) = '' AS blank, right(rtrim(text, b), 1) NOT IN ('.', '!', '?') AS cut,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, nth) AS pos
  FROM damaged, (SELECT chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13) AS b)),
told AS (SELECT *, CASE WHEN blank THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'd' WHEN cut THEN 't' ELSE '' END AS fault,
    lag(letter) OVER (PARTITION BY c ORDER BY pos) || letter AS two FROM placed),
sums AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM told GROUP BY c),
nxt(a, z, said) AS (VALUES ('-', 'u', 'user:'), ('s', 'u', 'user:'), ('u', 'a', 'assistant:'), ('a', 'u', 'user:')),
ins AS (SELECT a, 0 AS cost, '' AS edits, '' AS lines, a AS z FROM nxt UNION ALL SELECT a, 5, 'I', said || chr(10), z FROM nxt
  UNION ALL SELECT x.a, 10, 'II', x.said || chr(10) || y.said || chr(10), y.z FROM nxt x JOIN nxt y ON x.z = y.a),
keep(a, letter, z) AS (VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
moves AS (SELECT a, cost + 2 AS cost, edits || 'D' AS edits, lines, 'D' AS edit, '' AS letter, '' AS said, z FROM ins
  UNION ALL SELECT i.a, i.cost, i.edits || 'K', i.lines, 'K', k.letter, '', k.z FROM ins i JOIN keep k ON i.z = k.a
  UNION ALL SELECT i.a, i.cost + 1, i.edits || 'R', i.lines, 'R', '', n.said, n.z FROM ins i JOIN nxt n ON i.z = n.a),
walk AS (
  SELECT c, 0::BIGINT AS i, '-' AS st, struct_pack(cost := 0::BIGINT, audit := '', lines := '') AS b FROM convs
  UNION ALL
  SELECT c, i, st, min(b) AS b FROM (
    SELECT w.c, w.i + 1 AS i, m.z AS st, struct_pack(cost := w.b.cost + m.cost + CASE WHEN m.edit <> 'D' AND r.fault = 't' THEN 5 ELSE 0 END, audit := w.b.audit || m.edits,
      lines := w.b.lines || m.lines || CASE m.edit WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10) ELSE m.said || r.text || chr(10) END) AS b
    FROM walk w JOIN told r ON r.c = w.c AND r.pos = w.i + 1
    JOIN moves m ON m.a = w.st AND (m.edit = 'D' OR (r.fault NOT IN ('b', 'd') AND (m.edit = 'R' OR m.letter = r.letter)))) GROUP BY ALL),
done AS (SELECT w.c, min(struct_pack(cost := w.b.cost + i.cost, audit := w.b.audit || i.edits, lines := w.b.lines || i.lines)) AS b
  FROM walk w LEFT JOIN sums s ON s.c = w.c JOIN ins i ON i.a = w.st
  WHERE w.i = coalesce(s.n, 0) AND ((i.a = '-' AND i.edits = '') OR i.z = 'a') GROUP BY w.c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.cost AS cost, b.audit AS audit, sha256(left(b.lines, greatest(length(b.lines) - 1, 0))) AS repaired_sha256
FROM convs JOIN done USING (c) LEFT JOIN sums USING (c)
"""
