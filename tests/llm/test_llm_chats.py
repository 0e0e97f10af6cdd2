import hashlib
import itertools
import random

import pytest

from assayer.llm.chat import Template, format_chats, read_back
from assayer.llm.repair import ASSISTANT, DONE, START, SYSTEM, USER, repair, search, summarise

ROW = "conv_id long, turn long, role string, text string, part int, piece int, whole int, n int, rows int, fault int"
WHITE = " \t\n\x0b\x0c\r"
# Every initial with the places it may follow, and the place it leads to.
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """All edits, one row after the other: the least (cost, initials, what is left) to each place."""
    best = {"": (0, "", ())}

    def put(to, place, way):
        if place not in to or way < to[place]:
            to[place] = way

    def insert(ways):
        for _ in range(3):
            for place, (cost, audit, left) in list(ways.items()):
                place = "a" if place == "u" else "u"
                put(ways, place, (cost + 3, audit + "I", (*left, ("assistant" if place == "a" else "user", ""))))
        return ways

    for role, text, fault in rows:
        onward = {}
        for place, (cost, audit, left) in insert(best).items():
            put(onward, place, (cost + 4, audit + "D", left))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if (place, role[:1]) in GRAMMAR:
                put(onward, GRAMMAR[place, role[:1]], (cost + extra, audit + "K", (*left, (role, text))))
            other = "a" if place == "u" else "u"
            put(onward, other, (cost + 3 + extra, audit + "R", (*left, ("assistant" if other == "a" else "user", text))))
        best = onward
    return min(way for place, way in insert(best).items() if place in ("", "a"))


def expected(rows):
    """One conversation's summary by reading it from front to end."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, judged = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, left = cheapest(judged)
    faults = [sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(5)
    texts = ["One.", "Two!", "three", "Four?", " ", "", None, "é ü.", "</turn>\n<turn:user>\n", "a\\b\\", "x>y."]
    rows = []
    for conv in [*range(25), None, -7]:
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.85:
                role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "us>\n"])
                rows += [(conv, None if rng.random() < 0.1 else turn, role, rng.choice(texts))] * rng.choice([1, 1, 1, 2, 5])
    # A conversation with a third of all rows, one text of which is most of it.
    for turn in range(150):
        rows.append((100, turn, "user" if turn % 2 == 0 else "assistant", "Again." if rng.random() < 0.5 else f"Turn {turn}" + rng.choice([".", "", "!"])))
    rows += [(101, None, "user", "Hot.")] * 40 + [(102, 0, "user", "long " * 40_000 + "end.")]
    return rows


def frame(spark, rows, partitions=5):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], ROW).repartition(partitions)


@pytest.mark.parametrize("piece_rows", [3, 256])
def test_repairs_are_the_cheapest(spark, chats, piece_rows, partitions):
    by = {}
    for conv, *row in chats:
        by.setdefault(conv, []).append(row)
    got = {r.conv_id: tuple(r)[1:] for r in summarise(repair(frame(spark, chats), piece_rows)).collect()}
    assert got == {conv: expected(rows) for conv, rows in by.items()}


def test_search_between_any_two_places():
    """Against all strings of edits of short conversations."""
    rows = [[("u", False, 1), ("s", True, 1)], [("a", True, 1), (None, False, 2), ("u", False, 1)], [("t", False, 1)], []]
    steps = {"": START, "s": SYSTEM, "u": USER, "a": ASSISTANT}
    for todo in rows:
        for start, end in itertools.product(["", "s", "u", "a"], ["", "s", "u", "a", None]):
            found = []
            length = sum(n for _, _, n in todo)
            for size in range(length, length + 5):
                for audit in itertools.product("DIKR", repeat=size):
                    place, left, cost, ok = start, [x for i, c, n in todo for x in [(i, c)] * n], 0, True
                    for edit in audit:
                        if edit == "I":
                            place, cost = "a" if place == "u" else "u", cost + 3
                            continue
                        if not left or edit != "D" and left[0][0] is None:
                            ok = False
                            break
                        initial, cut = left.pop(0)
                        cost += 4 if edit == "D" else 3 * cut + 3 * (edit == "R")
                        if edit == "K":
                            if (place, initial) not in GRAMMAR:
                                ok = False
                                break
                            place = GRAMMAR[place, initial]
                        elif edit == "R":
                            place = "a" if place == "u" else "u"
                    closed = place in ("", "a") if end is None else place == end and (not audit or audit[-1] != "I")
                    if ok and not left and closed:
                        found.append((cost, "".join(audit)))
            got = search(todo, steps[start], DONE if end is None else steps[end])
            assert got == min(found, default=None), (todo, start, end)


@pytest.mark.parametrize("piece_rows", [2, 256])
def test_chats_are_read_back(spark, chats, piece_rows, partitions):
    chats = [r for r in chats if r[0] is None or r[0] < 101] + [(102, 0, "user", "long " * 40_000)]
    want = {}
    for conv, turn, role, text in chats:
        want.setdefault(conv, []).append((turn, role or "", text or ""))
    got = {r.conv_id: r for r in read_back(format_chats(frame(spark, chats), piece_rows=piece_rows)).collect()}
    assert set(got) == set(want)
    follows = Template().follows
    for conv, rows in want.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        row = got[conv]
        assert row.n_turns == len(rows)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        assert row.loss_chars == len(loss) and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        roles = ["", *(r for _, r, _ in rows)]
        fault = next((i for i, (a, b) in enumerate(zip(roles, roles[1:])) if b not in follows.get(a, ())), None)
        assert row.fault == (len(rows) if fault is None and roles[-1] != "assistant" else fault)


def test_other_templates():
    rng = random.Random(2)
    template = Template(open="[[", named="]]", close="[/]", escape="~", loss=("b", "c"))
    for _ in range(300):
        turns = [("".join(rng.choice("ab[]~/\n") for _ in range(rng.randint(0, 6))), "".join(rng.choice("xy[]~/\n\\") for _ in range(rng.randint(0, 12)))) for _ in range(4)]
        text = "".join(part for turn in turns for part, _ in template.segments(*turn))
        assert template.turns(text) == turns
    assert [loss for _, loss in template.segments("b", "x")] == [False, True, False]
    for bad in ({"escape": ""}, {"open": ""}, {"close": "~"}):
        with pytest.raises(ValueError):
            Template(**({"escape": "~"} | bad))
    with pytest.raises(ValueError):
        template.turns("[[a]]b[/]c")


def test_no_rows(spark):
    nothing = frame(spark, [(1, 1, "user", "x")]).limit(0)
    assert summarise(repair(nothing)).count() == 0
    assert read_back(format_chats(nothing)).count() == 0
