"""Conversation repair against enumeration of edits and a plain rendering of the whole query."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pyarrow.parquet as pq

from cartolith.llm import conversations, queries

LEGAL = re.compile(r"(s?(ua)+)?")


def every_repair(letters, inserts):
    """(cost, audit, initials) of all edit sequences with up to so many insertions."""
    def go(i, left, cost, audit, roles):
        if i == len(letters):
            yield cost, audit, roles
        else:
            c = letters[i]
            yield from go(i + 1, left, cost + 4, audit + "D", roles)
            if c not in "bd":
                more = 3 if c.isupper() else 0
                yield from go(i + 1, left, cost + more, audit + "K", roles + c.lower())
                for to in "ua":
                    yield from go(i + 1, left, cost + more + 3, audit + "R", roles + to)
        if left:
            for to in "ua":
                yield from go(i, left - 1, cost + 3, audit + "I", roles + to)

    return go(0, inserts, 0, "", "")


@lru_cache(None)
def best(letters):
    return min((c, a) for c, a, r in every_repair(letters, 3) if LEGAL.fullmatch(r))


def search(letters):
    """The same by cheapest-first search over (rows done, roles so far as far as they matter), for long signatures."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    table = [{s: None for s in ("", "s", "u", "a")} for _ in range(len(letters) + 1)]
    for i in range(len(letters), -1, -1):
        row = table[i]
        for s in row:
            ways = []
            if i == len(letters):
                ways += [(0, "")] if s in ("", "a") else []
            else:
                c = letters[i]
                ways.append((4 + table[i + 1][s][0], "D" + table[i + 1][s][1]))
                if c not in "bd":
                    more = 3 if c.isupper() else 0
                    for to, price, name in ((c.lower(), 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                        if (s, to) in after:
                            x = table[i + 1][after[s, to]]
                            ways.append((more + price + x[0], name + x[1]))
            row[s] = min(ways, default=None)
        for _ in range(4):
            for s in row:
                for to in "ua":
                    if (s, to) in after and row[after[s, to]]:
                        x = row[after[s, to]]
                        way = (3 + x[0], "I" + x[1])
                        row[s] = way if row[s] is None else min(row[s], way)
    return table[0][""]


def plain(rows):
    """The contract, row by row: {conv_id: result}."""
    after, convs = {}, {r["conv_id"] for r in rows}
    for r in rows:
        show = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{show(r['conv_id'])}:{show(r['turn'])}".encode()) % 20
        role, text = show(r["role"]), show(r["text"])
        role = "user" if code == 4 else role
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        after.setdefault(r["conv_id"], []).extend([(r["turn"], role, text)] * {0: 0, 3: 2}.get(code, 1))
    out = {}
    for conv in convs:
        mine = sorted(after.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        letters, seen = "", set()
        for _, role, text in mine:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            if not body:
                c = "b"
            elif (role, text) in seen:
                c = "d"
            else:
                c = role[:1] if role[:1] in ("s", "u", "a") else "o"
                c = c if body[-1] in ".!?" else c.upper()
            seen.add((role, text))
            letters += c
        cost, audit = search(letters)
        kept, i = [], 0
        last = "a"
        for edit in audit:
            want = "a" if last == "u" else "u"
            if edit == "D":
                i += 1
                continue
            role, text = (mine[i][1], mine[i][2]) if edit != "I" else ("", "")
            role = {"u": "user", "a": "assistant"}[want] if edit in "IR" else role
            i += edit != "I"
            last = role[0]
            kept.append(f"{role}:{text}")
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, letters.count("b"), letters.count("d"), sum(c.isupper() for c in letters),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_path_against_enumeration():
    rng = random.Random(3)
    some = sorted({"".join(rng.choice("suaoSUAObd") for _ in range(rng.randint(0, 4))) for _ in range(150)} | {"", "s", "a", "ss", "sa", "bbbb", "uaua", "SSSS"}, key=lambda x: x[::-1].translate({98: "x", 100: "x"}))
    path = conversations.Path()
    for letters in some:
        path.go(letters[::-1].translate({98: "x", 100: "x"}))
        assert path.best() == best(letters) == search(letters), letters
    assert path.made < sum(map(len, some)) / 1.5          # shared rests are worked out once


def test_long_signature():
    rng = random.Random(4)
    path = conversations.Path()
    for n in (3000, 3001):
        letters = "".join(rng.choice("suaoSUAObd") for _ in range(n))
        path.go(letters[::-1].translate({98: "x", 100: "x"}))
        assert path.best()[0] == len_cost(letters)
    assert len(path.steps.known) < 2000


def len_cost(letters):
    """Cost alone, without audits."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    cost = {0: 0, 3: 0, 2: 3, 1: 6}
    for c in reversed(letters):
        new = {}
        for s in range(4):
            ways = [4 + cost[s]]
            if c not in "bd":
                ways += [(3 if c.isupper() else 0) + price + cost[after[s, to]] for to, price in ((c.lower(), 0), ("u", 3), ("a", 3)) if (s, to) in after]
            new[s] = min(ways)
        for _ in range(4):
            new = {s: min([new[s]] + [3 + new[after[s, to]] for to in "ua" if (s, to) in after]) for s in new}
        cost = new
    return cost[0]


def test_query_against_plain_form(spark, sf):
    rows = pq.read_table(f"{sf}/conversations.parquet").to_pylist()
    assert found(queries.op12_conversation_repair(spark, sf)) == plain(rows)


def table(spark, rows, parts=3):
    schema = "conv_id long, turn long, role string, text string, conv string, copies string, h string, part string, side string, cost string"
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], schema).repartition(parts) if rows else spark.createDataFrame([], schema)


def test_odd_rows(spark):
    rng = random.Random(7)
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 2, None, "b."), (5, None, "user", "hm."), (5, 3, "", "x."), (5, 3, "unicorn", "x!"), (5, 9, "tool", "y?"), (5, 9, "tool", "y?"), (6, 0, "system", "only."), (-1, -5, "assistant", " . \t\x0b"), (-1, 70, "user", "\n\n")]
    rows += [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["yes.", "no", "", "what?\n", "é😀."])) for t in range(400)]      # a long one
    rows += [(8 + i, t, "user" if t % 2 == 0 else "assistant", f"word {i}." if i % 3 else "hi.") for i in range(60) for t in range(3)]
    rows += [(200 + i, 0, "user", "gone.") for i in range(80)]              # some lose their only row
    want = plain([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows])
    assert any(w[-2] == "" for w in want.values())
    assert found(conversations.digests(table(spark, rows))) == want
    assert found(conversations.digests(table(spark, rows, 23))) == want
    assert conversations.digests(table(spark, [])).collect() == []


def test_one_conversation_over_many_tasks(spark):
    """Repeats, turn gaps and role pairs across the edges of tasks; AQE would put so few rows into one task."""
    rng = random.Random(11)
    rows = [(1, t // 2 * 2 + (t > 300), rng.choice(["user", "assistant"]), f"say {rng.randint(0, 150)}.") for t in range(600)] + [(0, 1, "user", "a."), (2, 1, "user", "b.")]
    rows = [r for i, r in enumerate(rows) if r not in rows[:i]]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = table(spark, rows, 7)
        got = {r.conv_id: r for r in conversations.digests(data).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = plain([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows])
    for conv in (0, 2):
        assert tuple(got[conv][c] for c in COLUMNS) == want[conv]
    # ties of a turn go by hash of the text, so counts that do not hang on that order are compared
    assert (got[1].gaps, got[1].blank, got[1].duplicate) == want[1][:3]
    assert len(got[1].signature) == len([1 for r in rows if r[0] == 1 for _ in range({0: 0, 3: 2}.get(zlib.crc32(f"1:{r[1]}".encode()) % 20, 1))])


def test_repair_without_damage(spark):
    rows = [(1, 0, "system", "be nice."), (1, 1, "assistant", "hello."), (1, 2, "user", "and"), (2, 0, "user", "a."), (2, 1, "assistant", "b."), (3, 0, "user", " ")]
    report, messages = conversations.repair(table(spark, rows))
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {1: best("saU"), 2: (0, "KK"), 3: (4, "D")}
    assert best("saU") == (7, "KIKD")
    assert sorted((r.conv, r.place, r.role, r.text) for r in messages.collect()) == [(1, 0, "system", "be nice."), (1, 1, "user", ""), (1, 2, "assistant", "hello."), (2, 0, "user", "a."), (2, 1, "assistant", "b.")]
