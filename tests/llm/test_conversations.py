import hashlib
import random
import zlib
from itertools import product as every

import numpy as np

from docquarry.llm import conversations as cv
from docquarry.llm.conversations import Grammar, damaged, digests, learn_grammar, letters, op12_conversations, product, repair_conversations

SPACE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    """(role, text, fault) by turn."""
    seen, out = set(), []
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\x00{r[2]}".encode()).hexdigest())):
        fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "" if text.rstrip(SPACE)[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """Row by row: for what has been said (its initials as far as they matter), the cheapest edits, least letters, and the text."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def put(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def with_inserts(table):
        for _ in range(3):
            for state, (cost, audit, made) in list(table.items()):
                nxt = follow[state]
                put(table, nxt, (cost + 2, audit + "I", (*made, f"{full[nxt]}:")))
        return table

    table = with_inserts({"": (0, "", ())})
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, made) in table.items():
            put(after, state, (cost + 3, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            nxt = follow[state]
            put(after, nxt, (cost + 2 + more, audit + "R", (*made, f"{full[nxt]}:{text}")))
            if role[:1] == nxt or (role[:1] == "s" and state == ""):
                put(after, role[:1], (cost + more, audit + "K", (*made, f"{role}:{text}")))
        table = with_inserts(after)
    return min(table[s] for s in ("", "a") if s in table)


def plain(rows):
    found = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        found[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in found.items():
        turns = {t for t, *_ in own if t is not None}
        listed = faults_of(own)
        cost, audit, made = cheapest(listed)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(listed, listed[1:], strict=False)]
        counts = [sum(f == x for *_, f in listed) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return out


def table(seed=3, n=150):
    rng = random.Random(seed)
    texts = ["Yes.", "Why?", "No end", " ", "", None, "Ok! ", "Grüße.\n", "a.b", "..."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys", "User"]
    rows = []
    for conv in range(n):
        turn = 0
        for i in range(rng.randrange(1, 9)):
            turn += rng.choice([1, 1, 1, 2, 5])
            role = ("user", "assistant")[i % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, None if rng.random() < 0.05 else turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(10**6)}."))
    rows += [(None, i % 40 or None, rng.choice(roles), rng.choice(texts)) for i in range(120)]
    rows += [(7, 3, "user", "Same."), (7, 3, "user", "Same."), (7, 3, "user", "Same.")]
    return rows


def test_query_equals_plain_repair(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in op12_conversations(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_segments_of_a_long_conversation(spark):
    rows = [r for r in table(5, 12) if r[0] is not None] + [(99, i, *r[2:]) for i, r in enumerate(table(6, 60))]
    frame = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    report, repaired = repair_conversations(frame, segment=5)
    want = {f"v{r[0]}": r[1:] for r in plain(rows)}
    sha = {r["_c"]: r["repaired_sha256"] for r in digests(repaired).collect()}
    for r in report.collect():
        assert (*r[1:], sha.get(r["_c"], hashlib.sha256(b"").hexdigest())) == want[r["_c"]]


def test_least_audit_of_all_edits():
    def audits(symbols, state):
        if not symbols:
            yield from ((0, ""), (2, "I"), (4, "II")) if state in (cv.START, cv.AFTER_ASSISTANT) else ()
        for n in range(3):
            at = state
            for _ in range(n):
                at = cv._said(at)
            if symbols:
                for q in cv.STATES:
                    if step := cv._edited(symbols[0])[at][q]:
                        for cost, rest in audits(symbols[1:], q):
                            yield 2 * n + step[0] + cost, "I" * n + step[1] + rest
            elif at in (cv.START, cv.AFTER_ASSISTANT):
                yield 2 * n, "I" * n

    for symbols in every((0, 4, 5, 8, 12, 6), repeat=3):
        total = product(product(cv.SYMBOLS[symbols[0]], cv.SYMBOLS[symbols[1]]), cv.SYMBOLS[symbols[2]])
        ways = [(x[0] + cv.ENDS[q][0], letters(x[1]) + cv.ENDS[q][1]) for q in cv.STATES if (x := total[cv.START][q])]
        assert min(ways) == min(audits(symbols, cv.START))


def test_rules_expand_to_what_they_replaced(spark):
    rng = random.Random(1)
    sequences = [bytes(rng.choice(([4, 8] * 3, [0, 4, 8], [5, 9], [12] * 9))) + bytes(rng.choices(range(16), k=rng.randrange(6))) for _ in range(200)]
    grammar = learn_grammar(spark.createDataFrame([(s,) for s in sequences], "symbols binary"))
    flat = grammar.compressed(sequences)
    rules = [pair for pairs in grammar.rounds for pair in pairs]

    def expanded(x):
        return [x] if x < 16 else [y for part in rules[x - 16] for y in expanded(part)]

    parts = [[y for x in part[:-1].tolist() for y in expanded(x)] for part in np.split(flat, np.flatnonzero(flat < 0) + 1)[:-1]]
    assert parts == [list(s) for s in sequences] and len(flat) < 0.5 * sum(map(len, sequences))
    assert Grammar([]).compressed([b"", b"\x04"]).tolist() == [-1, 4, -1]


def test_no_rows_and_other_columns(spark):
    frame = spark.createDataFrame([(1, 1, "user", "Hi.", "x"), (1, 1, "user", "Hi.", "y")], "conv_id long, turn long, role string, text string, symbols string")
    report, repaired = repair_conversations(frame)
    assert tuple(report.first())[1:] == (0, 0, 1, 0, 1, 5, "KDI")
    assert [tuple(r)[3:] for r in repaired.orderBy("seg", "pos").collect()] == [("user", "Hi."), ("assistant", "")]
    report, repaired = repair_conversations(frame.where("false"))
    assert report.count() == 0 and repaired.count() == 0 and digests(repaired).count() == 0
