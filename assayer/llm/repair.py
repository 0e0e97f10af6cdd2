"""Repair of conversations: the cheapest edits that give a legal order of roles, by iterative-deepening A*.

A conversation is legal if its roles' initials read `(s?(ua)+)?`. A depth-first search tries the edits of each
row in ASCII order under a bound on the cost; a state (rows read, place in the pattern) that failed keeps the least
cost that it still needs, so it isn't searched again under a bound that can't do, and the bound rises to what the
start then needs. Below the least bound that has an answer there is none, so the first accepting path is the
cheapest and, among those, the least in ASCII order.

Conversations that lie in one task are searched there. Those at a task's edge or too long to hold are searched in
pieces, once for each place of the pattern at which a piece can begin and end; the pieces' costs, a few numbers each,
then choose the places at the borders. A cheapest edit of equal rows that must go deletes them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, task
from .turns import PIECE_ROWS, in_order, pieces, streamed, turns_of

# White space of the contract, how a sentence ends, the edits' costs, the legal pairs of roles.
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL_PAIRS = {"su", "ua", "au"}
# Places in the pattern: nothing yet, after a system, a user, an assistant row; DONE is any that may end it.
START, SYSTEM, USER, ASSISTANT, DONE = range(5)
ROLE = {USER: "user", ASSISTANT: "assistant"}
# What may be inserted at a place, and what a kept row's initial leads to.
WANTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDINGS = {START, ASSISTANT}

# A row to edit: its role's initial (None: it must go), whether it is truncated, how many equal rows it stands for.
Row = tuple[str | None, bool, int]


def search(rows: list[Row], start: int = START, end: int = DONE) -> tuple[int, str] | None:
    """Cost and edits of the cheapest way through the rows, None if none ends there.

    A way to DONE may end with insertions; a way to any other place ends with its last row.
    """
    if end in (START, SYSTEM):
        return _deleted(rows, start, end)
    size = len(rows)
    least = [0] * (size + 1)
    for i in range(size - 1, -1, -1):
        initial, truncated, n = rows[i]
        least[i] = least[i + 1] + (DELETE * n if initial is None else min(DELETE, TRUNCATED * truncated))
    if not size and (start in ENDINGS if end == DONE else start == end):
        return 0, ""
    needs: dict[tuple[int, int], int | float] = {}

    def edits(i: int, place: int) -> Iterator[tuple[str, int, int, int]]:
        if i < size:
            initial, truncated, n = rows[i]
            yield "D" * n, DELETE * n, i + 1, place
        if i < size or end == DONE:
            yield "I", INSERT, i, WANTED[place]
        if i < size and initial is not None:
            onward = KEPT.get((place, initial))
            if onward is not None:
                yield "K", TRUNCATED * truncated, i + 1, onward
            yield "R", REROLE + TRUNCATED * truncated, i + 1, WANTED[place]

    bound = least[0]
    while bound != float("inf"):
        # Frames: state, cost so far, edits to try, what the state needs by what was tried, the edit that led here.
        stack = [[(0, start), 0, edits(0, start), float("inf"), ""]]
        while stack:
            frame = stack[-1]
            state, cost, untried, need, _ = frame
            step = next(untried, None)
            if step is None:
                needs[state] = max(needs.get(state, 0), need)
                stack.pop()
                if stack:
                    stack[-1][3] = min(stack[-1][3], cost - stack[-1][1] + needs[state])
                continue
            name, price, i, place = step
            onward = price + needs.get((i, place), least[i])
            if cost + onward > bound:
                frame[3] = min(need, onward)
            elif i == size and (place in ENDINGS if end == DONE else place == end):
                return cost + price, "".join(f[4] for f in stack) + name
            else:
                stack.append([(i, place), cost + price, edits(i, place), float("inf"), name])
        bound = needs[(0, start)]
    return None


def _deleted(rows: list[Row], start: int, end: int) -> tuple[int, str] | None:
    """The only ways to where nothing or just a system row was: all rows go, or all but one system row, the last of the cheapest."""
    sizes = [n for _, _, n in rows]
    if start == end:
        return DELETE * sum(sizes), "D" * sum(sizes)
    kept_rows = [(TRUNCATED * truncated, -i) for i, (initial, truncated, _) in enumerate(rows) if initial == "s"]
    if start != START or end != SYSTEM or not kept_rows:
        return None
    extra, i = min(kept_rows)
    return DELETE * (sum(sizes) - 1) + extra, "D" * sum(sizes[:-i]) + "K" + "D" * sum(sizes[1 - i :])


def apply(rows: list[dict], audit: str, start: int = START) -> list[tuple[str, str]]:
    """Role and text of what the edits leave."""
    left, place, at = [], start, 0
    todo = [row for row in rows for _ in range(row["n"])]
    for edit in audit:
        if edit == "I":
            place = WANTED[place]
            left.append((ROLE[place], ""))
            continue
        row, at = todo[at], at + 1
        if edit == "D":
            continue
        place = KEPT[place, row["role"][:1]] if edit == "K" else WANTED[place]
        left.append((row["role"] if edit == "K" else ROLE[place], row["text"]))
    return left


FAULTS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
PIECE = f"conv_id long, part int, piece int, whole boolean, {FAULTS}, cost long, audit string, roles array<string>, texts array<string>"


def examine(rows: list[dict]) -> tuple[list[dict], list[Row], tuple]:
    """A piece's rows with equal ones parted by what must become of them, what is to be edited, and its faults."""
    parted, todo = [], []
    blank = duplicate = truncated = illegal = 0
    before = None
    seen = []
    for row in rows:
        last = row["text"].rstrip(WHITE)[-1:]
        initial, n = row["role"][:1], row["n"]
        cut = bool(last) and last not in ENDS
        stays = 0 if not last or row["repeated"] else 1
        if stays:
            parted.append(row | {"n": 1})
            todo.append((initial, cut, 1))
        if n > stays:
            parted.append(row | {"n": n - stays})
            todo.append((None, cut, n - stays))
        blank += 0 if last else n
        duplicate += n - stays if last else 0
        truncated += stays and cut
        illegal += (n - 1) * (initial + initial not in LEGAL_PAIRS)
        illegal += before is not None and before + initial not in LEGAL_PAIRS
        before = initial
        if row["turn"] is not None and (not seen or seen[-1] != row["turn"]):
            seen.append(row["turn"])
    low, high = (seen[0], seen[-1]) if seen else (None, None)
    return parted, todo, (low, high, len(seen), blank, duplicate, truncated, illegal, rows[0]["role"][:1], before)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_STRINGS = pa.list_(pa.string())
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": _STRINGS, "array<boolean>": pa.list_(pa.bool_()), "array<bigint>": pa.list_(pa.int64())}


def schema_of(text: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(", "))])


def _costs(rows: list[dict]) -> list[list[tuple[int, str] | None]]:
    todo = examine(rows)[1]
    return [[search(todo, start, end) for end in range(5)] for start in range(4)]


BORDERS = "conv_id long, part int, piece int, costs array<bigint>, ranks array<bigint>"


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's costs from every place to every place, and how the ways from one place rank in ASCII order."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            table = _costs(row["rows"])
            costs, ranks = [], []
            for line in table:
                order = sorted(way[1] for way in line[:DONE] if way)
                costs += [None if way is None else way[0] for way in line]
                ranks += [None if way is None or end == DONE else order.index(way[1]) for end, way in enumerate(line)]
            out.append((row["conv_id"], row["part"], row["piece"], costs, ranks))
        yield _table(out, schema_of(BORDERS))


CHOSEN = "part int, piece int, start int, end int"


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places at which each conversation's pieces begin and end, its pieces coming in order."""
    schema = schema_of(CHOSEN)

    def ways(held: list[dict]) -> list[tuple]:
        # Cost and rank of the best way to each place, and for each piece from where it came.
        best, came = {START: (0, 0)}, []
        for row in held[:-1]:
            found: dict[int, tuple] = {}
            for start, (cost, rank) in best.items():
                for end in range(DONE):
                    price = row["costs"][5 * start + end]
                    if price is not None:
                        option = cost + price, rank, row["ranks"][5 * start + end], start
                        if end not in found or option < found[end]:
                            found[end] = option
            order = sorted(option[1:3] for option in found.values())
            came.append({end: option[3] for end, option in found.items()})
            best = {end: (option[0], order.index(option[1:3])) for end, option in found.items()}
        last = held[-1]["costs"]
        start = min(best, key=lambda place: (best[place][0] + last[5 * place + DONE], best[place][1]))
        out, end = [(held[-1]["part"], held[-1]["piece"], start, DONE)], start
        for row, back in zip(held[-2::-1], came[::-1], strict=True):
            out.append((row["part"], row["piece"], back[end], end))
            end = back[end]
        return out

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["conv_id"] != row["conv_id"]:
                yield _table(ways(held), schema)
                held = []
            held.append(row)
    if held:
        yield _table(ways(held), schema)


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of repaired conversations from (conv_id, turn, role, text), most of them whole conversations.

    A row has conv_id, its order (part, piece), `whole`, the piece's faults, the cost and the initials of its edits
    and what they leave (roles, texts). Rows come by turn, nulls first, ties by role, then text; a null conv_id is a
    conversation of its own; null role and text are one space; equal rows are duplicates; an empty role begins
    with nothing and can't be kept; other columns are left out; an empty table gives an empty result. A row's text
    must fit in memory, a conversation needn't.
    """
    given = turns_of(rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]))
    # Where a text was seen first: only texts seen at several turns matter, and those by a hash of 128 bits.
    marks = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    marked = given.select("*", *marks)
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    again = given.select("conv_id", "turn", *marks).groupBy("conv_id", "h1", "h2").agg(F.min(turn).alias("low"), F.max(turn).alias("high"))
    again = again.filter("low <> high").select(F.col("conv_id").alias("c"), F.col("h1").alias("x"), F.col("h2").alias("y"), "low")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y"))
    seen = marked.join(again, same, "left").select("conv_id", "turn", "role", "text", "n", F.coalesce(turn != F.col("low"), F.lit(False)).alias("repeated"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, part, schema = [], 0, task(), schema_of(PIECE + ", turn_of array<bigint>, n_of array<bigint>, repeated array<boolean>")
        for conv, piece, whole, found in pieces(streamed(batches), piece_rows):
            parted, todo, faults = examine(found)
            if whole:
                cost, audit = search(todo)
                left = apply(parted, audit)
                out.append((conv, part, piece, True, *faults, cost, audit, [r for r, _ in left], [t for _, t in left], None, None, None))
            else:
                columns = [[row[c] for row in found] for c in ("role", "text", "turn", "n", "repeated")]
                out.append((conv, part, piece, False, *faults, None, None, *columns))
            held += sum(len(row["text"]) for row in found)
            if len(out) >= 1000 or held > 1 << 22:
                yield _table(out, schema)
                out, held = [], 0
        if out:
            yield _table(out, schema)

    cut = kept(in_order(seen).mapInArrow(run, PIECE + ", turn_of array<bigint>, n_of array<bigint>, repeated array<boolean>"))
    names = [part.split()[0] for part in PIECE.split(", ")]
    zipped = F.arrays_zip("roles", "texts", "turn_of", "n_of", "repeated").cast("array<struct<role:string,text:string,turn:bigint,n:bigint,repeated:boolean>>")
    edges = cut.filter("NOT whole").withColumn("rows", zipped)
    borders = edges.select("conv_id", "part", "piece", "rows").mapInArrow(_borders, BORDERS)
    chosen = borders.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_chosen, CHOSEN)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(PIECE)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parted, todo, _ = examine(row["rows"])
                cost, audit = search(todo, row["start"], row["end"])
                left = apply(parted, audit, row["start"])
                whole = row["start"] == START and row["end"] == DONE and row["alone"]
                out.append((row["conv_id"], row["part"], row["piece"], whole, *[row[c] for c in names[4:13]], cost, audit, [r for r, _ in left], [t for _, t in left]))
            yield _table(out, schema)

    alone = edges.groupBy("conv_id").count().select(F.col("conv_id").alias("c"), (F.col("count") == 1).alias("alone"))
    solved = edges.select(*names, "rows").join(kept(chosen), ["part", "piece"]).join(alone, F.col("conv_id").eqNullSafe(F.col("c")))
    finished = kept(solved.select(*names, "rows", "start", "end", "alone").mapInArrow(finish, PIECE))
    return cut.filter("whole").select(*names).unionByName(finished)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its pieces in order; texts go through the digest as they come."""
    schema, last, total, audits = schema_of(SUMMARY), None, None, []

    def row() -> tuple:
        gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
        return (last["conv_id"], gaps, *[total[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")], "".join(audits), digest.hexdigest())

    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            if last is None or piece["conv_id"] != last["conv_id"]:
                if last is not None:
                    out.append(row())
                digest, begun, audits = hashlib.sha256(), False, []
                total = {c: 0 for c in ("turns", "blank", "duplicate", "truncated", "illegal", "cost")} | {"low": None, "high": None}
            else:
                total["illegal"] += last["last"] + piece["first"] not in LEGAL_PAIRS
            for c in ("turns", "blank", "duplicate", "truncated", "illegal", "cost"):
                total[c] += piece[c]
            if piece["low"] is not None:
                total["turns"] -= total["high"] == piece["low"]
                total["low"] = piece["low"] if total["low"] is None else total["low"]
                total["high"] = piece["high"]
            for role, text in zip(piece["roles"], piece["texts"], strict=True):
                digest.update(("\n" if begun else "").encode() + f"{role}:{text}".encode())
                begun = True
            audits.append(piece["audit"])
            last = piece
        yield _table(out, schema)
    if last is not None:
        yield _table([row()], schema)


def summarise(repaired: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the edits' cost and initials, the digest of what they leave.

    Whole conversations are digested where they are. Pieces of longer ones follow each other through one task as a
    stream, since a digest is a chain; nothing of them is held but the initials.
    """
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    columns = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = repaired.filter("whole").select("conv_id", gaps.alias("gaps"), *columns, F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    rest = repaired.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return whole.unionByName(rest.mapInArrow(_summed, SUMMARY))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults drawn from crc32 of conversation and turn: dropped, emptied, cut, repeated, reroled."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    drawn = F.crc32(key.cast("binary")) % 20
    read = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), drawn.alias("drawn"))
    times = F.when(F.col("drawn") == 0, 0).when(F.col("drawn") == 3, 2).otherwise(1)
    text = F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("drawn") == 4, "user").otherwise(F.col("role"))
    return read.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = summarise(repair(damaged(rows))).withColumnRenamed("conv_id", "found_id")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
