"""Repair of conversations by a Viterbi search that converges in parallel.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant.
Rows are kept (0), given the role that fits (3), deleted (4), or turns without text are inserted (3);
blank rows and duplicates must go, truncated ones cost 3 more where they stay. The cheapest edits are
those of a shortest path over four states: nothing yet, after system, after user, after assistant.

1. Rows are numbered within their conversation and become one letter each; a chunk is a string of up to
   ``CHUNK`` letters.
2. Backward costs: each chunk starts from the end of the conversation or, where another chunk follows, from
   a guessed cost vector. In fix-up passes a chunk starts anew from its neighbour's vector, and stops as
   soon as its vector differs from the one before by a constant only, for then all before does too. Passes
   go on until no vector changes; after ``PASSES`` of them the rest is settled by products of the chunks'
   cost matrices in a logarithmic number of joins.
3. Each chunk is traced from each state, least letter first; the states it ends in compose to the state in
   which every chunk really begins, and that trace counts.

Costs are known up to a constant in a chunk; the constants add up to the total. A long conversation is
thus spread over many tasks. Only the digest of its repaired text needs all of it in order, and streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.functions.ranks import row_numbers
from shelflot.llm.common import ship, table
from shelflot.session import partitions, run_dir

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows that one task searches at a time, and fix-up passes before matrices are multiplied.
CHUNK, PASSES = 4096, 6
NOT_BLANK = r"[^\x20\x09-\x0D]"
#: Cost of what can't be; sums of real costs in a chunk stay below.
NEVER = 1 << 40
#: States: nothing yet, after system, after user, after assistant. What may be put next without a row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "suao"


def _insert(costs: list[int]) -> list[int]:
    """Costs where turns may be inserted first; more than two in a row never pay."""
    once = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return [min(c, INSERT + once[NEXT[s]]) for s, c in enumerate(once)]


def _follow(state: int, initial: str) -> int | None:
    """The state after keeping a row of this initial, None where it doesn't fit."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _choices(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row. Its letter: s, u, a or o, upper case when truncated, digit when it must go."""
    out = [("D", DELETE, state)]
    if letter.isalpha():
        more, after = (TRUNCATED if letter.isupper() else 0), _follow(state, letter.lower())
        out += [("K", KEEP + more, after)] if after is not None else []
        out.append(("R", REROLE + more, NEXT[state]))
    return out


TABLE = {x: [_choices(x, s) for s in range(4)] for x in INITIALS + INITIALS.upper() + "0123"}
END = _insert([0, NEVER, NEVER, 0])


def _before(letter: str, after: list[int]) -> list[int]:
    return _insert([min(cost + after[to] for _, cost, to in TABLE[letter][s]) for s in range(4)])


def _level(costs: list[int]) -> tuple[list[int], int]:
    """Costs less their least, and that least."""
    low = min(costs)
    return [min(c - low, NEVER) for c in costs], low


def backward(letters: str, after: list[int]) -> list[int]:
    """Costs before the first row from the costs after the last one."""
    for x in reversed(letters):
        after = _before(x, after)
    return after


def fix_up(letters: str, old: list[int], new: list[int], first: list[int]) -> list[int]:
    """Costs before the first row from ``new`` costs, given those, ``first``, that ``old`` ones led to."""
    for x in reversed(letters):
        shift = new[0] - old[0]
        if all(n - o == shift for n, o in zip(new, old)):
            return [c + shift for c in first]
        old, new = _before(x, old), _before(x, new)
    return new


def trace(letters: str, after: list[int], state: int, last: bool) -> tuple[list[int], int, list[tuple[int, str, int]]]:
    """Costs before the first row, the end state and the least cheapest edits as (row, edit, state after it).

    Turns inserted after the chunk's last row belong to the next chunk, if there is one.
    """
    levels = [after]
    for x in reversed(letters):
        levels.append(_before(x, levels[-1]))
    levels.reverse()
    out, i = [], 0
    while i < len(letters) or (last and levels[i][state]):
        steps = [("I", INSERT, NEXT[state])]
        if i < len(letters):
            steps += TABLE[letters[i]][state]
        for edit, cost, to in sorted(steps):
            j = i + (edit != "I")
            if cost + levels[j][to] == levels[i][state]:
                break
        out.append((i, edit, to))
        state, i = to, j
    return levels[0], state, out


def damaged(df: DataFrame) -> DataFrame:
    """The conversations with faults planted by crc32 of ``conv_id:turn``; NULL values count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    step = df.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    step = step.where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )
    return step.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def _conv(column: str) -> Column:
    """A key that is never NULL; the conversation without an id has one too."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))


def _per_row(df: DataFrame, inputs: list[str], schema: T.StructType, compute) -> DataFrame:
    """Columns __c and chunk, and those that ``compute`` gives for the inputs of each row."""
    ship(df.sparkSession)
    full = T.StructType([T.StructField("__c", T.StringType()), T.StructField("chunk", T.LongType()), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = full.names
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256).to_pylist()
                found = [{"__c": r["__c"], "chunk": r["chunk"], **compute(*[r[c] for c in inputs])} for r in rows]
                arrays = [pa.array([r[n] for r in found], to_arrow[n]) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = {f.name: to_arrow_type(f.dataType) for f in full.fields}
    return df.select("__c", "chunk", *inputs).mapInArrow(run, full)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _composed(df: DataFrame, column: str, other: str, together: Column, sign: int, count: int) -> DataFrame:
    """``column`` of each chunk put together with those of all chunks after (sign 1) or before it (-1).

    Doubling: each join brings what twice as many neighbours come to.
    """
    step = 1
    while step < count:
        shifted = df.select("__c", (F.col("chunk") - sign * step).alias("chunk"), F.col(column).alias(other))
        df = df.join(shifted, ["__c", "chunk"], "left").withColumn(column, F.when(F.col(other).isNull(), F.col(column)).otherwise(together)).drop(other)
        step *= 2
    return df


VECTOR = T.ArrayType(T.LongType())


def _start(letters: str, last: bool) -> dict:
    after = END if last else [0, 0, 0, 0]  # a guess that the passes mend
    return {"letters": letters, "last": last, "after": after, "before": _level(backward(letters, after))[0]}


def _again(letters: str, last: bool, after: list[int], before: list[int], neighbour: list[int] | None) -> dict:
    if neighbour is not None and neighbour != after:
        before, after = _level(fix_up(letters, after, neighbour, before))[0], neighbour
    return {"letters": letters, "last": last, "after": after, "before": before}


def _matrix(letters: str) -> dict:
    columns = [backward(letters, [0 if j == k else NEVER for k in range(4)]) for j in range(4)]
    return {"m": [[min(columns[j][s], NEVER) for j in range(4)] for s in range(4)]}


def _ends(letters: str, last: bool, after: list[int]) -> dict:
    return {"ends": [trace(letters, after, s, last)[1] for s in range(4)]}


def _edits(letters: str, last: bool, after: list[int], state: int, prior: str | None) -> dict:
    costs, _, edits = trace(letters, after, state, last)
    plain = [INITIALS[int(x)] if x.isdigit() else x.lower() for x in (prior or "") + letters]
    turns = [
        {"row": row, "seq": k, "edit": edit, "role": None if edit == "K" else ROLE[to]}
        for k, (row, edit, to) in enumerate(edits)
        if edit != "D"
    ]
    return {
        "audit": "".join(e for _, e, _ in edits),
        "zero": costs[START],
        "low": min(costs),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(plain, plain[1:])),
        "turns": turns,
    }


CHUNKS = T.StructType([T.StructField("letters", T.StringType()), T.StructField("last", T.BooleanType()), T.StructField("after", VECTOR), T.StructField("before", VECTOR)])
TURN = T.StructType([T.StructField("row", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType())])
EDITS = T.StructType([
    T.StructField("audit", T.StringType()), T.StructField("zero", T.LongType()), T.StructField("low", T.LongType()),
    T.StructField("illegal", T.LongType()), T.StructField("turns", T.ArrayType(TURN)),
])


def _settled(chunks: DataFrame, path: str, count: int, passes: int) -> DataFrame:
    """``after`` of every chunk of conversations of several chunks, and the ``state`` in which it begins."""
    state = _stored(_per_row(chunks, ["letters", "last"], CHUNKS, _start), f"{path}/pass0")
    for k in range(1, passes + 2):
        near = state.select("__c", (F.col("chunk") - 1).alias("chunk"), F.col("before").alias("neighbour"))
        joined = state.join(near, ["__c", "chunk"], "left")
        if joined.where("neighbour IS NOT NULL AND neighbour <> after").isEmpty():
            break
        if k <= passes:
            state = _stored(_per_row(joined, [*CHUNKS.names, "neighbour"], CHUNKS, _again), f"{path}/pass{k}")
        else:
            field = T.StructType([T.StructField("m", T.ArrayType(VECTOR))])
            matrices = _stored(_per_row(state, ["letters"], field, _matrix), f"{path}/matrices")
            four = F.array(*[F.lit(i) for i in range(4)])
            product = F.transform("m", lambda row: F.transform(four, lambda j: F.array_min(
                F.transform(four, lambda i: F.least(F.get(row, i) + F.get(F.get(F.col("__next"), i), j), F.lit(NEVER))))))
            whole = _composed(matrices, "m", "__next", product, 1, count)
            costs = F.transform("m", lambda row: F.array_min(F.transform(four, lambda j: F.get(row, j) + F.get(F.array(*map(F.lit, END)), j))))
            level = F.transform(costs, lambda c: (c - F.array_min(costs)).cast("long"))
            near = whole.select("__c", (F.col("chunk") - 1).alias("chunk"), level.alias("neighbour"))
            final = state.join(near, ["__c", "chunk"], "left").withColumn("after", F.coalesce("neighbour", "after")).drop("neighbour")
            state = _stored(final, f"{path}/final")
    field = T.StructType([T.StructField("ends", T.ArrayType(T.LongType()))])
    ends = _stored(_per_row(state, ["letters", "last", "after"], field, _ends), f"{path}/ends")
    maps = _composed(ends, "ends", "__prior", F.transform("__prior", lambda s: F.get(F.col("ends"), s.cast("int"))), -1, count)
    begins = maps.select("__c", (F.col("chunk") + 1).alias("chunk"), F.get("ends", F.lit(START)).alias("state"))
    return state.join(begins, ["__c", "chunk"], "left").select("__c", "chunk", "after", F.coalesce("state", F.lit(START).cast("long")).alias("state"))


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK, passes: int = PASSES
) -> tuple[DataFrame, DataFrame]:
    """One row per conversation, and the repaired rows of all.

    The first has the conversation's key ``__c`` (see :func:`_conv`), gaps, blank, duplicate, truncated, illegal,
    cost and audit; the second ``__c``, ``pos``, ``seq`` (their order), role and text. Rows are taken by turn, NULL
    first, and within a turn by role and text, so repeated rows follow each other. NULL roles and texts count as one
    space, rows without a conversation's id as one conversation. Other columns are left out. An empty table gives none.
    """
    spark, path = df.sparkSession, run_dir(df.sparkSession, "turns")
    given = df.select(
        _conv(conv).alias("__c"), F.col(f"`{turn}`").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    ).withColumn("__same", F.monotonically_increasing_id())
    numbered = row_numbers(given, ["__c"], [F.col("turn").asc_nulls_first(), "role", "text", "__same"], "pos")
    mark = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = _stored(
        numbered.select(
            "__c", "turn", "role", "text", "pos", mark.alias("mark"),
            (~F.col("text").rlike(NOT_BLANK)).alias("blank"),
            (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
            F.when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise(F.lit("o")).alias("initial"),
        ),
        f"{path}/rows",
    )
    firsts = rows.groupBy("__c", "mark").agg(F.min("pos").alias("first"))
    seen = rows.select("__c", "pos", "mark", "blank", "open", "initial").join(firsts, ["__c", "mark"])
    seen = seen.withColumn("again", ~F.col("blank") & (F.col("pos") > F.col("first"))).withColumn("open", F.col("open") & ~F.col("blank") & ~F.col("again"))
    digit = (F.instr(F.lit(INITIALS), F.col("initial")) - 1).cast("string")
    letter = F.when(F.col("blank") | F.col("again"), digit).when(F.col("open"), F.upper("initial")).otherwise(F.col("initial"))
    chunks = seen.groupBy("__c", F.floor((F.col("pos") - 1) / chunk).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("letter")))), lambda x: x["letter"]), "").alias("letters"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "again", "open")],
    )
    chunks = _stored(chunks, f"{path}/chunks")
    sizes = chunks.groupBy("__c").agg((F.max("chunk") + 1).alias("n"))
    before = chunks.select("__c", (F.col("chunk") + 1).alias("chunk"), F.substring("letters", -1, 1).alias("prior"))
    chunks = chunks.join(sizes, "__c").join(before, ["__c", "chunk"], "left").withColumn("last", F.col("chunk") == F.col("n") - 1)
    whole = chunks.where("n = 1").select("*", F.array(*[F.lit(c).cast("long") for c in END]).alias("after"), F.lit(START).cast("long").alias("state"))
    count = sizes.agg(F.max("n")).first()[0] or 0
    if count > 1:
        many = chunks.where("n > 1")
        whole = whole.unionByName(many.join(_settled(many, path, count, passes), ["__c", "chunk"]))
    edits = _stored(_per_row(whole, ["letters", "last", "after", "state", "prior"], EDITS, _edits), f"{path}/edits")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"])
    found = edits.groupBy("__c").agg(
        F.sum("illegal").alias("illegal"),
        F.sum(F.when(F.col("chunk") == 0, F.col("zero")).otherwise(F.col("low"))).alias("cost"),
        F.array_join(pieces, "").alias("audit"),
    )
    counts = chunks.groupBy("__c").agg(F.sum("blank").alias("blank"), F.sum("again").alias("duplicate"), F.sum("open").alias("truncated"))
    turns = rows.where("turn IS NOT NULL").groupBy("__c", "turn").agg(F.count("*")).groupBy("__c")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    summary = counts.join(found, "__c").join(gaps, "__c", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))
    flat = edits.select("__c", "chunk", F.explode("turns").alias("t")).select(
        "__c", (F.col("chunk") * chunk + F.col("t.row") + 1).alias("pos"), F.col("t.seq").alias("seq"), F.col("t.edit").alias("edit"), F.col("t.role").alias("new")
    )
    joined = flat.join(rows.select("__c", "pos", "role", "text"), ["__c", "pos"], "left")
    inserted = F.col("edit") == "I"
    repaired = joined.select(
        "__c", "pos", "seq", F.coalesce("new", "role").alias("role"), F.when(inserted, F.lit("")).otherwise(F.col("text")).alias("text")
    )
    return summary, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines; rows stream through in order, none are gathered."""
    ship(repaired.sparkSession)
    line = repaired.select("__c", "pos", "seq", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = line.repartition(partitions(repaired.sparkSession), "__c").sortWithinPartitions("__c", "pos", "seq").select("__c", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, digest, done = ["__c", "repaired_sha256"], None, None, []
        for batch in batches:
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=names)
            done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (now, digest.hexdigest())], names=names)

    return ordered.mapInArrow(run, "__c string, repaired_sha256 string")


def op12_turn_repair(spark: SparkSession, directory: str) -> DataFrame:
    """Faults, cost and edits of every conversation after the planted damage, and the digest of its repaired turns.

    A conversation that the damage leaves without rows has zeros, an empty audit and the digest of nothing.
    """
    given = table(spark, directory, "conversations", "conv_id", "turn", "role", "text")
    summary, repaired = repair(damaged(given))
    ids = given.select("conv_id").distinct().withColumn("__c", _conv("conv_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return ids.join(summary, "__c", "left").join(digests(repaired), "__c", "left").select(
        "conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
