"""Conversation structure repair by a suffix-shared automaton of role and fault signatures.

Every conversation is a string of one letter per row: the role's initial and the row's first fault. Conversations with one
signature share all decisions, and signatures with one ending share the nodes of that ending: distinct signatures are sorted
from their last letter on, and each task walks them in that order, keeping the nodes of the current ending. A node holds, for
each of the four grammar states, the cost to go and the first letter of the best audit. Nodes with the same costs but for a
constant are one state of the minimal automaton, whose steps are computed once and remembered.

Edits: keep 0, rerole to user or assistant 3, delete 4 (the only choice for blank and duplicate rows), insert an empty user or
assistant row 3; a truncated row that stays costs 3 more. The roles left must read ``(s?(ua)+)?``. At a node and state each edit
letter leads to one place only, so the least letter of the least cost gives the least audit.

No group meets in one task until its digest is taken: rows are numbered in pieces of a range partitioning, equal rows of a
conversation are found by a combined minimum, signatures are joined from pieces, and a signature that many conversations
share is looked up apart. A conversation's SHA-256 must read its rows in order, so they stream through one task, one at a time.

Defined cases: rows of one turn come in order of role, the first 256 characters of the text, and a hash of it; a null turn comes
first and counts for no gap; a null role or text is one space; a null ``conv_id`` is a conversation of its own; a role is known by
its first letter, and an empty role or another letter fits nowhere; repeated rows are duplicates; a very long text is one row
like any other; an empty table gives an empty table. Only the four columns are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import look_up, small_batches, write_table
from framewise.operators.ordered import PIECE, POSITION, pieces_of

RULES = 20
ROLES = "sua"
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled row leads: user is awaited everywhere but after user.
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = {"su", "ua", "au"}
RESULT = "sig string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with the damage that the CRC of ``conv_id:turn`` names: dropped, emptied, unpunctuated, repeated or made a user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    df = conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], F.pmod(F.crc32(name), F.lit(RULES)).alias("rule")
    ).where("rule != 0")
    text = F.when(F.col("rule") == 1, F.lit("")).when(F.col("rule") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("rule") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("time")
    return df.select("conv_id", "turn", F.when(F.col("rule") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("time")


def _key() -> Column:
    """A name of the conversation that is never null."""
    return F.coalesce(F.concat(F.lit("id "), F.col("conv_id").cast("string")), F.lit("null"))


def _letter(duplicate: Column) -> Column:
    """One of sixteen letters: four for each role initial (s, u, a, other), by the row's first fault."""
    role = F.coalesce(*[F.when(F.col("initial") == r, F.lit(i)) for i, r in enumerate(ROLES)], F.lit(3))
    fault = F.when(F.col("fault") == BLANK, F.lit(BLANK)).when(duplicate, F.lit(DUPLICATE)).otherwise(F.col("fault"))
    return F.char(F.lit(ord("A")) + role * 4 + fault)


class Automaton:
    """Nodes along one ending, shared by all signatures that end so; ``steps`` are those of the minimal automaton."""

    def __init__(self) -> None:
        self.steps: dict[tuple, tuple] = {}
        self.word = ""
        #: For each length of ending: cost above ``base`` and edit letter by grammar state.
        self.costs, self.letters, self.base = [(0, 6, 3, 0)], [("", "I", "I", "")], [0]
        self.made = 0

    def _step(self, letter: str, after: tuple) -> tuple:
        role, fault = divmod(ord(letter) - ord("A"), 4)
        late = STAYS_TRUNCATED if fault == TRUNCATED else 0
        best = []
        for state in range(4):
            options = [(DELETE + after[state], "D")]
            if fault < BLANK:
                to = kept(state, ROLES[role] if role < 3 else "")
                options += [(late + after[to], "K")] if to is not None else []
                options += [(REROLE + late + after[NEXT[state]], "R")]
            best.append(min(options))
        plain = list(best)
        for state in (USER, ASSISTANT):
            best[state] = min(plain[state], (INSERT + plain[NEXT[state]][0], "I"))
        for state in (START, SYSTEM):
            best[state] = min(plain[state], (INSERT + best[USER][0], "I"))
        least = min(c for c, _ in best)
        return tuple(c - least for c, _ in best), tuple(x for _, x in best), least

    def read(self, word: str) -> tuple[int, str]:
        """Cost and audit of a signature given from its last letter on; words in sorted order share most nodes."""
        same = 0
        for a, b in zip(word, self.word):
            if a != b:
                break
            same += 1
        del self.costs[same + 1 :], self.letters[same + 1 :], self.base[same + 1 :]
        for letter in word[same:]:
            at = (letter, self.costs[-1])
            if at not in self.steps:
                self.steps[at] = self._step(*at)
            costs, letters, more = self.steps[at]
            self.costs.append(costs)
            self.letters.append(letters)
            self.base.append(self.base[-1] + more)
            self.made += 1
        self.word = word
        depth, state, audit = len(word), START, []
        while edit := self.letters[depth][state]:
            audit.append(edit)
            if edit == "K":
                state = kept(state, ROLES[(ord(word[depth - 1]) - ord("A")) // 4])
            elif edit != "D":
                state = NEXT[state]
            depth -= edit != "I"
        return self.base[-1] + self.costs[-1][START], "".join(audit)


def kept(state: int, initial: str) -> int | None:
    """The state after a row that stays as it is; None where the grammar forbids it."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _counts(word: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows and illegal neighbours of a signature."""
    codes = [ord(x) - ord("A") for x in word]
    roles = "".join("sua-"[c >> 2] for c in codes)
    return *(sum(c & 3 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)), sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in small_batches(batches):
        out = []
        for word in batch.column("reversed").to_pylist():
            cost, audit = automaton.read(word)
            out.append((word[::-1], *_counts(word[::-1]), cost, audit))
        names = [x.split(" ")[0] for x in RESULT.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], pa.schema([(n, pa.string() if n in ("sig", "audit") else pa.int64()) for n in names]))


def solved(signatures: DataFrame) -> DataFrame:
    """Counts, cost and audit for each distinct ``sig``; sorted from the last letter on, so each task shares endings."""
    words = signatures.select(F.reverse("sig").alias("reversed"))
    return words.repartitionByRange("reversed").sortWithinPartitions("reversed").mapInArrow(_solve, RESULT)


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows in pieces that follow conversation and turn, with hashes of role and text and what is wrong with the text."""
    text, role = F.col("text"), F.col("role")
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    fault = F.when(bare == "", F.lit(BLANK)).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), F.lit(TRUNCATED)).otherwise(F.lit(OK))
    df = rows.select(
        _key().alias("k"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    ).select(
        "*", F.substring(role, 1, 1).alias("initial"), fault.alias("fault"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2")
    )
    return pieces_of(df, ["k"], [F.col("turn").asc_nulls_first(), role, F.substring(text, 1, 256), F.col("h1"), F.col("h2")])


def _joined(df: DataFrame, by: list[str], order: str, part: str) -> DataFrame:
    """``part`` of the rows of each group as one string in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, part))), lambda x: x[part])
    return df.groupBy(*by).agg(F.array_join(parts, "").alias("sig"))


def _signatures(rows: DataFrame) -> DataFrame:
    """``k`` and ``sig``: a row repeats another if the first with its role and text is not itself."""
    first = rows.groupBy("k", "h1", "h2").agg(F.min(F.struct(PIECE, POSITION)).alias("at")).select("at.*", F.lit(True).alias("first"))
    marked = rows.select("k", PIECE, POSITION, "initial", "fault").join(first, [PIECE, POSITION], "left")
    letters = marked.select("k", PIECE, POSITION, _letter(F.col("first").isNull()).alias("letter"))
    return _joined(_joined(letters, ["k", PIECE], POSITION, "letter"), ["k"], PIECE, "sig")


def _audits(rows: DataFrame) -> DataFrame:
    """For each ``k`` with rows: the counts, the cost and the audit of its signature."""
    sigs, _ = write_table(_signatures(rows))
    counts, _ = write_table(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n")))
    results, _ = write_table(solved(counts))
    return write_table(look_up(sigs, results, ["sig"], counts).drop("sig"))[0]


def _edited(rows: Iterator[tuple]) -> Iterator[tuple[str, int, str, str]]:
    """``k``, number, role and text of each repaired row; ``rows`` are k, audit, role, text, the audit before the rows of its k."""
    edits, state, number, k, edit = iter(()), START, 0, None, ""

    def inserts() -> Iterator[tuple]:
        nonlocal state, number, edit
        while (edit := next(edits, "")) == "I":
            state = NEXT[state]
            yield k, number, "user" if state == USER else "assistant", ""
            number += 1

    for new, audit, role, text in rows:
        if audit is not None:
            if k is not None:
                yield from inserts()
            edits, state, number, k = iter(audit), START, 0, new
            continue
        yield from inserts()
        if edit == "D":
            continue
        if edit == "R":
            state = NEXT[state]
            role = "user" if state == USER else "assistant"
        else:
            state = kept(state, role[:1])
        yield k, number, role, text
        number += 1
    if k is not None:
        yield from inserts()


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of each conversation in order behind a row with its audit."""
    head = audits.select("k", F.lit(-1).cast("long").alias(PIECE), F.lit(-1).cast("long").alias(POSITION), "audit", *[F.lit(None).cast("string").alias(c) for c in ("role", "text")])
    body = rows.select("k", PIECE, F.col(POSITION).cast("long").alias(POSITION), F.lit(None).cast("string").alias("audit"), "role", "text")
    return head.unionByName(body).repartition("k").sortWithinPartitions("k", PIECE, POSITION).select("k", "audit", "role", "text")


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in small_batches(batches):
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0
    schema = pa.schema([("k", pa.string()), ("number", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    for row in _edited(_tuples(batches)):
        out.append(row)
        size += len(row[3])
        if len(out) >= 1000 or size > 1 << 22:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(k: str, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"k": [k], "repaired_sha256": [digest.hexdigest()]})

    digest, last = None, None
    for k, number, role, text in _edited(_tuples(batches)):
        if k != last:
            if last is not None:
                yield one(last, digest)
            digest, last = hashlib.sha256(), k
        digest.update(f"{'' if number == 0 else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
    if last is not None:
        yield one(last, digest)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``k`` (the name of the conversation: "id " and its ``conv_id``, or "null"), ``number``, ``role`` and ``text`` of the rows after repair."""
    ordered = _ordered(rows)
    return _stream(ordered, _audits(ordered)).mapInArrow(_turns, "k string, number long, role string, text string")


def repairs(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: gaps, faults, cost, audit and digest of the repaired rows.

    ``conversations`` (default ``rows``) names in ``conv_id`` all conversations that get a row; those without rows get zeros, an empty audit
    and the digest of nothing.
    """
    ordered = _ordered(rows)
    audits = _audits(ordered)
    digests = _stream(ordered, audits).mapInArrow(_digests, "k string, repaired_sha256 string")
    wide = "decimal(20,0)"
    gaps = ordered.groupBy("k").agg(
        (F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count_distinct("turn")).cast("long").alias("gaps")
    )
    everyone = (rows if conversations is None else conversations).select("conv_id").distinct().withColumn("k", _key())
    out = everyone.join(gaps, "k", "left").join(audits, "k", "left").join(digests, "k", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
