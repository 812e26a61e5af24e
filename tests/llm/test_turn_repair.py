import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rewardmill.llm import repair_queries, turn_repair

SPACE = " \t\n\x0b\x0c\r"
LEGAL = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def brute_repair(rows):
    """Every edit of every row in turn; the cheapest and then least string for each role that could be last."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    counts, seen, illegal = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), 0
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(4):
            for last, (cost, audit, out) in list(best.items()):
                new = "a" if last == "u" else "u"
                way = (cost + 2, audit + "I", (*out, {"a": "assistant:", "u": "user:"}[new]))
                best[new] = min(best.get(new, way), way)
        return best

    for n, (_, _, role, text) in enumerate(rows):
        shown = text.rstrip(SPACE)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        illegal += n > 0 and rows[n - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        new = {}
        for last, (cost, audit, out) in insert(best).items():
            ways = [(last, (cost + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                to = "a" if last == "u" else "u"
                ways.append((to, (cost + 2 + more, audit + "R", (*out, {"a": "assistant:", "u": "user:"}[to] + text))))
                if (last, role[:1]) in LEGAL:
                    ways.append((LEGAL[last, role[:1]], (cost + more, audit + "K", (*out, f"{role}:{text}"))))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best = new
    cost, audit, out = min(way for last, way in insert(best).items() if last in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute(rows):
    by = {}
    for r in brute_damage(rows):
        by.setdefault(r[0], []).append(r)
    return {c: brute_repair(by.get(c, [])) for c in {r[0] for r in rows}}


def invented(seed, conversations, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "s", "User"])
            text = r.choice(["Yes.", "No!", "cut off", "Why? \n", "", " \t", None, "é ü.", f"t{turn}."])
            rows.append((conv, r.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows + [(None, 0, "user", "Hm?"), (None, 1, "assistant", "So."), (None, None, None, None)]


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run(spark, rows, tmp_path, n=3):
    path = str(tmp_path)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("clash"))
    df.repartition(n).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    got = repair_queries.op13_conversation_repair(spark, path).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


@pytest.mark.parametrize("size", [1, 3, 256])
def test_invented_conversations(spark, tmp_path, monkeypatch, size):
    # Small blocks: every conversation is put together from blocks and ranges.
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", size)
    rows = invented(size, 150, 14)
    assert run(spark, rows, tmp_path) == brute(rows)


def test_one_conversation_holds_most_rows(spark, tmp_path):
    rows = [r for r in invented(7, 1, 3) if r[0] is None]
    rows += [(5, t, "user" if t % 2 else "assistant", f"{t % 300}." if t % 7 else "gone") for t in range(3000)]
    rows += [(6, 1, "user", "Same.")] * 2000
    assert run(spark, rows, tmp_path) == brute(rows)


def test_blocks_by_bytes_and_long_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK_CHARS", 50)
    rows = [(1, t, ("user", "assistant")[t % 2], "long " * (t * 40) + ".") for t in range(20)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_and_wholly_dropped(spark, tmp_path):
    assert run(spark, [], tmp_path) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = run(spark, [(gone, 0, "user", "Hi.")], tmp_path)
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("seed", range(3))
def test_meeting_heaps_equal_one_pass(seed):
    r = random.Random(seed)
    for _ in range(300):
        signs = "".join(r.choice("suaoSUAOx") for _ in range(r.randrange(0, 12)))
        best = {turn_repair.START: (0, "")}
        for sign in signs:
            for _ in range(4):
                for state, (cost, edits) in list(best.items()):
                    way = (cost + 2, edits + "I")
                    to = turn_repair.made(state)
                    best[to] = min(best.get(to, way), way)
            new = {}
            for state, (cost, edits) in best.items():
                for c, letter, to in turn_repair.steps(sign, state):
                    way = (cost + c, edits + letter)
                    new[to] = min(new.get(to, way), way)
            best = new
        want = min((c + turn_repair.TAILS[s][0], e + turn_repair.TAILS[s][1]) for s, (c, e) in best.items())
        assert turn_repair.cheapest(signs, turn_repair.START, turn_repair.ENDS) == want


def test_whole_small_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repair_queries.op13_conversation_repair(spark, small).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == brute(rows)
