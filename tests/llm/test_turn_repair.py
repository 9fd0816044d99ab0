"""Structure repair against plain searches over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from weftline.llm import turn_repair

KIND = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")
NAME = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_faults(turns):
    seen, out = set(), []
    for role, text in turns:
        found = SOLID.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, faults):
    """(cost, audit, repaired) by the best continuation from each (turn, state), inserts being steps of their own."""
    nxt = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(turns) and state in ("", "a") else []

        def put(price, letter, role, line, j, n):
            to = nxt.get((state, role))
            if to is not None:
                rest = best(j, to, n)
                if rest:
                    options.append((price + rest[0], letter + rest[1], (line, *rest[2])))

        if inserted < 3:
            for r in "ua":
                put(3, "I", r, f"{NAME[r]}:", i, inserted + 1)
        if i < len(turns):
            role, text = turns[i]
            rest = best(i + 1, state, 0)
            if rest:
                options.append((4 + rest[0], "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                if role[:1] in ("s", "u", "a"):
                    put(more, "K", role[:1], f"{role}:{text}", i + 1, 0)
                for r in "ua":
                    put(3 + more, "R", r, f"{NAME[r]}:{text}", i + 1, 0)
        return min(options, key=lambda x: x[:2]) if options else None

    for i in range(len(turns), -1, -1):
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def enumerated(turns, faults):
    """(cost, audit) by trying every choice for every turn and every number of inserts, for a few turns."""
    best = None
    gaps = ["", "I:u", "I:a", "I:u I:a", "I:a I:u"]
    choices = []
    for (role, _), fault in zip(turns, faults, strict=True):
        more = 3 if fault == "truncated" else 0
        own = [(4, "D", "")]
        if fault not in ("blank", "duplicate"):
            own += [(more, "K", role[:1])] if role[:1] in ("s", "u", "a") else []
            own += [(3 + more, "R", r) for r in "ua"]
        choices.append(own)
    for picked in product(*choices):
        for put in product(gaps, repeat=len(turns) + 1):
            audit, roles, cost = "", "", 0
            for k, g in enumerate(put):
                n = g.count("I")
                audit, roles, cost = audit + "I" * n, roles + "".join(x[-1] for x in g.split()), cost + 3 * n
                if k < len(picked):
                    price, letter, r = picked[k]
                    audit, roles, cost = audit + letter, roles + r, cost + price
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def plain(rows):
    groups = {}
    bad = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = [r for r in bad if r[0] == conv]
        mark = lambda r: hashlib.md5(f"{'' if conv is None else conv}:{len(r[2].encode())}:{r[2]}:{r[3]}".encode()).hexdigest()
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], mark(r)))
        turns = [(r[2], r[3]) for r in mine]
        faults = plain_faults(turns)
        known = [r[1] for r in mine if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [t[0][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(tuple(turns), tuple(faults))
        groups[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return groups


def chats(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        t = r.choice([0, 0, 5])
        for _ in range(r.choice([1, 2, 3, 4, 6, 9])):
            role = r.choices(["user", "assistant", "system", "tool", "", None], [8, 8, 2, 1, 1, 1])[0]
            text = r.choice([f"Said {r.randrange(4)}.", "So what?", "cut off", "  \n", "", None, "é!", "Wow! \x0b", "\xa0"])
            rows.append((c, None if r.random() < 0.05 else t, role, text))
            t += r.choice([1, 1, 1, 2, 0])
    return rows + [(None, 0, "user", "Who?"), (None, None, "assistant", "Me."), (10**12, None, None, None)]


def test_plain_search_is_right():
    r = random.Random(3)
    for _ in range(60):
        turns = tuple((r.choice(["user", "assistant", "system", "tool"]), r.choice(["A.", "B.", "C", ""])) for _ in range(r.randrange(4)))
        faults = tuple(plain_faults(turns))
        assert cheapest(turns, faults)[:2] == enumerated(turns, faults)


@pytest.mark.parametrize("seed, block", [(1, 20_000), (2, 3), (3, 1), (4, 7)])
def test_repair(spark, monkeypatch, tmp_path, seed, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = chats(seed)
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {x[0]: tuple(x)[1:] for x in turn_repair.op13_turn_repair(spark, f"file://{tmp_path}").collect()}
    assert got == plain(rows)


def test_steps_of_edits(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes."), (1, 2, "user", "And?"), (2, 0, "system", "Be good."), (3, 0, "user", " ")]
    got = sorted(map(tuple, turn_repair.repair(spark.createDataFrame(rows, KIND)).select("conv_id", "place", "step", "edit", "role", "text", "was").collect()))
    assert [(g[0], *g[3:]) for g in got] == [
        (1, "I", "user", "", None),
        (1, "K", "assistant", "Hi.", "assistant"),
        (1, "K", "user", "Yes.", "user"),
        (1, "R", "assistant", "And?", "user"),
        (2, "D", "system", "Be good.", "system"),
        (3, "D", "user", " ", "user"),
    ]


def test_empty_tables_names_and_long_conversation(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(turn_repair, "BLOCK", 130)
    spark.createDataFrame([], KIND).write.parquet(f"file://{tmp_path}/a/conversations.parquet")
    assert turn_repair.op13_turn_repair(spark, f"file://{tmp_path}/a").collect() == []
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice([f"T {t}.", "same.", "cut"])) for t in range(900)] + [(2, 0, "user", "long " * 300_000 + "end.")]
    names = {k: F.lit("z") for k in ("_place", "_block", "state", "fault", "h", "edits", "_k", "place", "step")}
    spark.createDataFrame(rows, KIND).withColumns(names).write.parquet(f"file://{tmp_path}/b/conversations.parquet")
    got = {x[0]: tuple(x)[1:] for x in turn_repair.op13_turn_repair(spark, f"file://{tmp_path}/b").collect()}
    assert got == plain(rows)
