import hashlib
import itertools
import random
import re
import zlib

from tasteframe.llm import repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
NAMES = {"u": "user", "a": "assistant"}


def faulty(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(SPACE)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, most=3):
    """(cost, audit, repaired rows): every sequence of edits, none merged; inserts beyond `most` in a row never pay."""
    best = None
    faults = faulty(rows)

    def walk(i, cost, audit, made):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
            best = min(filter(None, (best, (cost, audit, made))), key=lambda x: x[:2])
        if audit[-most:] != "I" * most:
            for x in NAMES.values():
                walk(i, cost + 5, audit + "I", [*made, (x, "")]) if cost + 5 <= 2 * len(rows) + 5 else None
        if i < len(rows):
            (role, text), extra = rows[i], 5 * (faults[i] == "truncated")
            walk(i + 1, cost + 2, audit + "D", made)
            if faults[i] in ("", "truncated"):
                walk(i + 1, cost + extra, audit + "K", [*made, (role, text)])
                for x in NAMES.values():
                    walk(i + 1, cost + extra + 1, audit + "R", [*made, (x, text)])

    walk(0, 0, "", [])
    return best


def automaton(rows):
    """The same for long conversations: least (cost, audit) per number of kept roles' state."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    faults = faulty(rows)

    def widened(live):
        for _ in range(3):
            for (x, (cost, audit, made)), y in itertools.product(list(live.items()), NAMES):
                to = moves.get((x, y))
                if to and (to not in live or (cost + 5, audit + "I") < live[to][:2]):
                    live[to] = (cost + 5, audit + "I", (made, (NAMES[y], "")))
        return live

    live = {"": (0, "", None)}
    for (role, text), fault in zip(rows, faults):
        after, extra = {}, 5 * (fault == "truncated")
        for x, (cost, audit, made) in widened(live).items():
            ways = [(x, cost + 2, audit + "D", made)]
            if fault in ("", "truncated"):
                ways += [(moves.get((x, y)), cost + extra + c, audit + e, (made, (name, text))) for y, c, e, name in ((role[:1], 0, "K", role), ("u", 1, "R", "user"), ("a", 1, "R", "assistant"))]
            for to, *value in ways:
                if to is not None and (to not in after or tuple(value[:2]) < after[to][:2]):
                    after[to] = tuple(value)
        live = after
    cost, audit, made = min((v for x, v in widened(live).items() if x in ("", "a")), key=lambda v: v[:2])
    out = []
    while made:
        made, row = made
        out.append(row)
    return cost, audit, out[::-1]


def expected(rows, solve=cheapest):
    """rows: (turn, role, text) as they stand after the damage."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [(r[1], r[2]) for r in rows]
    faults = faulty(pairs)
    cost, audit, made = solve(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def damage(conv, turn, role, text):
    luck = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = (" " if x is None else x for x in (role, text))
    row = (turn, "user" if luck == 4 else role, "" if luck == 1 else re.sub("[.!?]", "", text) if luck == 2 else text)
    return [] if luck == 0 else [row, row] if luck == 3 else [row]


def collected(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_automaton_of_the_test_equals_all_sequences():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b!", "cut", " ", "d."])) for _ in range(rng.randint(0, 4))]
        assert automaton(rows) == cheapest(rows)


def test_repair_equals_brute_force(spark):
    rng = random.Random(2)
    texts, roles = ["a.", "b!", "cut", "", " \t", "d?", "e. ", "ends, "], ["user", "assistant", "system", "user", "assistant", "tool", "admin", "", " "]
    damaged = {c: [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(0, 12))] for c in range(150)}
    damaged[500] = [(i, ("user", "assistant")[i % 2] if rng.random() < 0.8 else "system", rng.choice(texts) + str(rng.random())) for i in range(600)]
    damaged[501] = [(None, "user", "same.")] * 300
    rows = [(str(c), *r) for c, rs in damaged.items() for r in rs]
    rng.shuffle(rows)
    t = spark.createDataFrame(rows, "conv string, turn long, role string, text string").repartition(3)
    all_ = spark.createDataFrame([(c, "x") for c in damaged], "conv_id long, part string")
    want = {c: expected(rs, automaton) for c, rs in damaged.items()}
    assert collected(repair.repair(all_, t, ranges=7)) == want
    assert collected(repair.repair(all_, t)) == want


def test_damage_and_nulls(spark):
    rows = [(c, t, r, x, 1) for c in (None, 1, 2, 3) for t in (None, *range(12)) for r, x in [(("user", "assistant")[(t or 0) % 2], f"Text {t}. And!"), (None, "n.")][: 1 + (c == 2)]]
    rows += [(4, None, None, None, 1), (5, None, "assistant", "long " * 100000 + "end.", 1), (5, None, "user", "q?", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    want = {c: expected([d for r in rows if r[0] == c for d in damage(*r[:4])], automaton) for c in {r[0] for r in rows}}
    assert collected(repair.repair(df, repair.damaged(df))) == want
    empty = df.where("false")
    assert collected(repair.repair(empty, repair.damaged(empty))) == {}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: expected([d for r in rows if r[0] == c for d in damage(*r)], automaton) for c in {r[0] for r in rows}}
    got = repair.op13_role_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert collected(got) == want
