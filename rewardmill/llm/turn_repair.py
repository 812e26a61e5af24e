"""Conversation structure repair: the cheapest edits that make turns alternate.

A lattice has a node for every place between two rows and every state of the
grammar ``(s?(ua)+)?`` over role initials; edits are its edges. A block of rows is
solved by bidirectional Dijkstra: a forward and a reverse heap meet, every
crossing of least cost is finished, and the least joined edit string is picked.

Rows are sorted in ranges, so a conversation of any size is spread over tasks.
A task solves a conversation that lies whole in one of its blocks at once.
Blocks of longer ones are solved between all pairs of states; the small tables
of costs are then joined, first within a range and then over ranges, and each
block takes its own edits from the states chosen for its ends. Inside a block
an insertion always stands before a row. No edit string of the same rows
is then the beginning of another, so strings compare block by block, by rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardmill.llm.common import map_batches, ship, stored

#: Rows, and characters of text, of one block (a longer text is a block of its own).
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 22
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
# Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Completing a conversation from each state: cost and edits.
TAILS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
_SPACES = " \t\n\x0b\x0c\r"

_PLACE = "conv string, part int, block int"
_MATRIX = "costs array<long>, ranks array<int>"
BLOCKS = (
    f"{_PLACE}, conv_id long, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, "
    f"first string, last string, cost long, audit string, {_MATRIX}, audits array<string>"
)


def made(state: int) -> int:
    """The state after an inserted or re-roled turn: the turn whose place it is."""
    return ASSISTANT if state == USER else USER


@cache
def steps(sign: str, state: int) -> tuple[tuple[int, str, int], ...]:
    """Edits of one row from a state: cost, initial, next state.

    A sign is the row's initial (``o``: none of s, u, a), upper case if truncated; ``x`` must be deleted.
    """
    out = [(DELETE, "D", state)]
    if sign != "x":
        more = TRUNCATED if sign.isupper() else 0
        out.append((REROLE + more, "R", made(state)))
        if (state, sign.lower()) in _KEPT:
            out.append((more, "K", _KEPT[state, sign.lower()]))
    return tuple(out)


@cache
def _steps_back(sign: str, state: int) -> tuple[tuple[int, str, int], ...]:
    return tuple((cost, letter, before) for before in STATES for cost, letter, after in steps(sign, before) if after == state)


@lru_cache(1 << 15)
def cheapest(signs: str, entry: int, exits: tuple[tuple[int, int, str], ...]) -> tuple[int, str] | None:
    """Least cost and, among equal ones, the least edit string from ``entry`` to one of ``exits`` (state, cost, edits after it).

    Nodes leave the forward heap by cost and place, the reverse one by cost and place from
    the end: edges without cost lead one row on, so a node's string is final when it leaves.
    """
    n = len(signs)
    ahead, behind = {(0, entry): (0, "")}, {(n, state): (cost, edits) for state, cost, edits in exits}
    front, back = [(0, 0, entry)], [(cost, 0, state) for state, cost, _ in exits]
    heapq.heapify(back)
    done_ahead, done_behind = set(), set()
    best = float("inf")
    # Beyond this bound no path as cheap as the best has a node that neither heap has let go.
    while front and back and front[0][0] + back[0][0] <= best:
        if front[0][0] <= back[0][0]:
            cost, i, state = heapq.heappop(front)
            if (i, state) in done_ahead:
                continue
            done_ahead.add((i, state))
            said = ahead[i, state][1]
            best = min(best, cost + behind.get((i, state), (best,))[0])
            if i == n:
                continue
            edges = [(c, letter, (i + 1, after)) for c, letter, after in steps(signs[i], state)]
            for c, letter, node in [*edges, (INSERT, "I", (i, made(state)))]:
                label = (cost + c, said + letter)
                if node not in ahead or label < ahead[node]:
                    ahead[node] = label
                    heapq.heappush(front, (label[0], *node))
                best = min(best, label[0] + behind.get(node, (best,))[0])
        else:
            cost, from_end, state = heapq.heappop(back)
            i = n - from_end
            if (i, state) in done_behind:
                continue
            done_behind.add((i, state))
            said = behind[i, state][1]
            best = min(best, cost + ahead.get((i, state), (best,))[0])
            edges = [(c, letter, (i - 1, before)) for c, letter, before in _steps_back(signs[i - 1], state)] if i else []
            if i < n:
                edges += [(INSERT, "I", (i, before)) for before in STATES if made(before) == state]
            for c, letter, node in edges:
                label = (cost + c, letter + said)
                if node not in behind or label < behind[node]:
                    behind[node] = label
                    heapq.heappush(back, (label[0], n - node[0], node[1]))
                best = min(best, label[0] + ahead.get(node, (best,))[0])
    met = [(ahead[node][0] + behind[node][0], ahead[node][1] + behind[node][1]) for node in ahead.keys() & behind.keys()]
    return min(met, default=None)


ENDS = tuple((state, *tail) for state, tail in TAILS.items())


def matrix(signs: str) -> tuple[list[int | None], list[int | None], list[str | None]]:
    """Costs, ranks of the edit strings and the strings themselves for all pairs of entry and exit (entry * 4 + exit)."""
    found = [cheapest(signs, entry, ((exit_, 0, ""),)) for entry in STATES for exit_ in STATES]
    order = {s: at for at, s in enumerate(sorted({x[1] for x in found if x}))}
    return [x and x[0] for x in found], [order[x[1]] if x else None for x in found], [x and x[1] for x in found]


def joined(matrices: Iterable[tuple[Sequence[int | None], Sequence[int | None]]]) -> tuple[list[int | None], list[int | None]]:
    """The matrix of consecutive stretches of rows: cheapest by cost, then by the ranks of both strings."""
    whole = None
    for costs, ranks in matrices:
        if whole is None:
            whole = list(costs), list(ranks)
            continue
        best = []
        for entry in STATES:
            for exit_ in STATES:
                ways = [
                    (whole[0][entry * 4 + mid] + costs[mid * 4 + exit_], whole[1][entry * 4 + mid], ranks[mid * 4 + exit_])
                    for mid in STATES
                    if whole[0][entry * 4 + mid] is not None and costs[mid * 4 + exit_] is not None
                ]
                best.append(min(ways, default=None))
        order = {pair: at for at, pair in enumerate(sorted({x[1:] for x in best if x}))}
        whole = [x and x[0] for x in best], [order[x[1:]] if x else None for x in best]
    return whole


def chosen_states(matrices: Sequence[tuple], entry: int, exits: dict[int, int]) -> list[int]:
    """The states at the ends of all stretches on the cheapest way from ``entry`` to one of ``exits`` (state: cost after it)."""
    labels, before = {entry: (0, 0)}, []
    for costs, ranks in matrices:
        ways: dict[int, tuple] = {}
        for state, (cost, rank) in labels.items():
            for exit_ in STATES:
                if (more := costs[state * 4 + exit_]) is not None:
                    way = (cost + more, rank, ranks[state * 4 + exit_], state)
                    ways[exit_] = min(ways.get(exit_, way), way)
        order = {pair: at for at, pair in enumerate(sorted({w[1:3] for w in ways.values()}))}
        labels = {state: (w[0], order[w[1:3]]) for state, w in ways.items()}
        before.append({state: w[3] for state, w in ways.items()})
    state = min((s for s in labels if s in exits), key=lambda s: (labels[s][0] + exits[s], labels[s][1]))
    out = [state]
    for step in reversed(before):
        out.append(step[out[-1]])
    return out[::-1]


def edited(roles: Sequence[str], texts: Sequence[str], audit: str, state: int = START) -> tuple[list[str], list[str]]:
    """The rows after the edits named by ``audit``."""
    names = {USER: "user", ASSISTANT: "assistant"}
    out_roles, out_texts, at = [], [], 0
    for letter in audit:
        if letter in "RI":
            state = made(state)
            out_roles.append(names[state])
            out_texts.append(texts[at] if letter == "R" else "")
        elif letter == "K":
            state = _KEPT[state, roles[at][0]]
            out_roles.append(roles[at])
            out_texts.append(texts[at])
        at += letter != "I"
    return out_roles, out_texts


def conversation_key(conv_id: Column) -> Column:
    """A conversation's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def with_faults(turns: DataFrame) -> DataFrame:
    """Rows with ``conv`` (a name that is never null) and ``fault``: null, blank, duplicate or truncated, the first that holds.

    Only a digest of each text is grouped to find repeats, and groups are aggregated before the shuffle.
    """
    conv = conversation_key(F.col("conv_id"))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(conv.alias("conv"), "conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(text).alias("digest"))
    # Tells copies of a row apart, so that many of them are spread over ranges; their order says nothing.
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    groups = rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "copy")).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = groups.filter("n > 1").drop("n")
    rows = rows.join(repeated, ["conv", "role", "digest"], "left")
    shown = F.rtrim("text", F.lit(_SPACES))
    fault = (
        F.when(shown == "", "blank")
        .when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("turn", "copy")), "duplicate")
        .when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return rows.withColumn("fault", fault).drop("first")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Blocks of the rows of one sorted range; those of conversations that end inside their first block are solved."""
    names = BLOCKS.replace(",", " ").split()[::2]
    out: list[dict] = []

    def flushed() -> pa.RecordBatch:
        columns = {name: [row.get(name) for row in out] for name in names}
        types = {"part": pa.int32(), "block": pa.int32(), "ranks": pa.list_(pa.int32()), "costs": pa.list_(pa.int64())}
        types |= {k: pa.list_(pa.string()) for k in ("roles", "texts", "audits")} | {k: pa.string() for k in ("conv", "first", "last", "audit")}
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[n], types.get(n, pa.int64())) for n in names], names)

    def close(block: dict, whole: bool) -> None:
        signs = "".join(block.pop("signs"))
        block.pop("chars")
        if whole:
            block["cost"], block["audit"] = cheapest(signs, START, ENDS)
        else:
            block["costs"], block["ranks"], block["audits"] = matrix(signs)
        out.append(block)

    block, leading, size = None, True, 0
    for batch in batches:
        for row in batch.to_pylist():
            same = block is not None and row["conv"] == block["conv"]
            if not same or len(block["signs"]) >= BLOCK_ROWS or block["chars"] + len(row["text"]) > BLOCK_CHARS:
                at, last = (block["block"] + 1, block["last"]) if same else (0, None)
                if block is not None:
                    size += block["chars"]
                    # Only the first and the last conversation of a range can go on in another one.
                    close(block, whole=not same and not leading and block["block"] == 0)
                    leading &= same
                    if size > BLOCK_CHARS or len(out) >= 1024:
                        size = 0
                        yield flushed()
                block = {k: row[k] for k in ("conv", "conv_id", "part")} | {"block": at, "signs": [], "chars": 0, "roles": [], "texts": []}
                block |= {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": last}
            initial, fault = row["role"][:1], row["fault"]
            known = initial if initial and initial in "sua" else "o"
            block["illegal"] += block["last"] is not None and block["last"] + initial not in ("su", "ua", "au")
            block.setdefault("first", initial)
            block["last"] = initial
            if fault:
                block[fault] += 1
            block["signs"].append("x" if fault in ("blank", "duplicate") else known.upper() if fault else known)
            block["chars"] += len(row["text"])
            block["roles"].append(row["role"])
            block["texts"].append(row["text"])
    if block is not None:
        close(block, whole=False)
        yield flushed()


def _sorted(rows: pa.Table, *keys: str) -> list[dict]:
    return rows.sort_by([(k, "ascending") for k in keys]).to_pylist()


def _piece(rows: pa.Table) -> pa.Table:
    """The blocks of one conversation in one range as one matrix."""
    blocks = _sorted(rows, "block")
    costs, ranks = joined((b["costs"], b["ranks"]) for b in blocks)
    return pa.table(
        {
            "conv": [blocks[0]["conv"]], "part": pa.array([blocks[0]["part"]], pa.int32()), "first": [blocks[0]["first"]], "last": [blocks[-1]["last"]],
            "costs": pa.array([costs], pa.list_(pa.int64())), "ranks": pa.array([ranks], pa.list_(pa.int32())),
        }
    )


def _over_ranges(rows: pa.Table) -> pa.Table:
    """States at both ends of each range of a conversation, and whether roles are illegal where ranges meet."""
    pieces = _sorted(rows, "part")
    states = chosen_states([(p["costs"], p["ranks"]) for p in pieces], START, {s: c for s, (c, _) in TAILS.items()})
    meets = [0] + [int(a["last"] + b["first"] not in ("su", "ua", "au")) for a, b in zip(pieces, pieces[1:])]
    return pa.table(
        {
            "conv": [p["conv"] for p in pieces], "part": pa.array([p["part"] for p in pieces], pa.int32()),
            "entry": pa.array(states[:-1], pa.int32()), "exit": pa.array(states[1:], pa.int32()),
            "meets": pa.array(meets, pa.int64()), "ends": [p is pieces[-1] for p in pieces],
        }
    )


def _in_range(rows: pa.Table) -> pa.Table:
    """States at both ends of each block of one conversation in one range."""
    blocks = _sorted(rows, "block")
    first = blocks[0]
    states = chosen_states([(b["costs"], b["ranks"]) for b in blocks], first["entry"], {first["exit"]: 0})
    return pa.table(
        {
            "conv": [b["conv"] for b in blocks], "part": pa.array([b["part"] for b in blocks], pa.int32()), "block": pa.array([b["block"] for b in blocks], pa.int32()),
            "entry": pa.array(states[:-1], pa.int32()), "exit": pa.array(states[1:], pa.int32()),
            "meets": pa.array([b["meets"] if b is first else 0 for b in blocks], pa.int64()), "ends": [b["ends"] and b is blocks[-1] for b in blocks],
        }
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("roles", "texts", "audit", "entry")]
        done = [edited(*row) for row in zip(*columns)]
        for name, at in (("roles", 0), ("texts", 1)):
            place = batch.schema.get_field_index(name)
            batch = batch.set_column(place, name, pa.array([d[at] for d in done], pa.list_(pa.string())))
        yield batch.drop_columns(["entry"])


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The repaired conversations of ``turns`` (conv_id, turn, role, text), in blocks of rows.

    Columns: conv (name of the conversation, never null), part and block (order within it),
    conv_id, roles and texts (repaired rows), audit (edits in order: K, R, D, I), cost, and the numbers of
    blank, duplicate, truncated and illegal rows among those given. Sums over a conversation's blocks are its own.

    A null role or text is one space (so the row is blank or has no legal role); a null conv_id is
    a conversation of its own. Rows go by turn, nulls first; rows of one turn by role, then by digest of the text, so
    equal rows stand together and all but the first are duplicates. A conversation with no rows has no
    block. Texts stay whole. Other columns are not read.
    """
    order = ["conv", "turn", "role", "digest", "copy"]
    rows = with_faults(turns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    blocks = stored(map_batches(rows.select("conv", "conv_id", "part", "role", "text", "fault"), _solve, BLOCKS), "turn-blocks")
    ship(turns.sparkSession)
    kept = ["conv", "part", "block", "conv_id", "roles", "texts", "audit", "cost", "blank", "duplicate", "truncated", "illegal"]
    solved = blocks.filter("audit IS NOT NULL").select(*kept, F.lit(START).alias("entry"))
    open_ = blocks.filter("audit IS NULL")
    narrow = open_.select("conv", "part", "block", "first", "last", "costs", "ranks")
    pieces = narrow.groupBy("conv", "part").applyInArrow(_piece, f"conv string, part int, first string, last string, {_MATRIX}")
    ends = "entry int, exit int, meets long, ends boolean"
    of_range = pieces.groupBy("conv").applyInArrow(_over_ranges, f"conv string, part int, {ends}")
    of_block = narrow.join(of_range, ["conv", "part"]).groupBy("conv", "part").applyInArrow(_in_range, f"{_PLACE}, {ends}")
    at = F.col("entry") * 4 + F.col("exit") + 1
    tails = F.create_map(*[F.lit(x) for state, (_, edits) in TAILS.items() for x in (state, edits)])
    tail = F.when(F.col("ends"), tails[F.col("exit")]).otherwise("")
    placed = open_.drop("cost", "audit").join(of_block, ["conv", "part", "block"]).withColumns(
        {
            "audit": F.concat(F.element_at("audits", at), tail),
            "cost": F.element_at("costs", at) + F.length(tail) * INSERT,
            "illegal": F.col("illegal") + F.col("meets"),
        }
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in solved.drop("entry").schema.fields)
    return map_batches(solved.unionByName(placed.select(*kept, "entry")), _apply, schema)
