"""Balanced JSON and tables in text against plain readers."""

import json
import random
import re
import time

from ledgerloom.operators import brackets, grids


def plain_json(text):
    """The definition, character by character; strings are told apart from the first bracket on."""
    start = re.search(r"[\[{]", text or "")
    if not start:
        return None
    open_at, pairs, quoted, skip = [], [], False, False
    for i in range(start.start(), len(text)):
        ch = text[i]
        if skip:
            skip = False
        elif quoted and ch == "\\":
            skip = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{[":
            open_at.append(i)
        elif not quoted and ch in "}]" and open_at:
            pairs.append((open_at.pop(), i + 1))
    for a, b in sorted(pairs):
        try:
            json.loads(text[a:b])
        except ValueError:
            continue
        return text[a:b]
    return None


def test_balanced_json(spark):
    draw = random.Random(4)
    parts = ["{", "}", "[", "]", '"', '\\"', "\\", '"k":', "1", ",", " ", '"a}"', '{"x":[1]}', "[]", "é", "\n", "null"]
    texts = [None, "", "no", '{"a": "}"} x', "{bad} [1, 2]", '{"a": {"b": 1}', "}]{}", ']]][1,[2]]}', '{"a\\"}": "\\\\"}', '"{" {"q": 1}'] + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 18))) for _ in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.body for r in brackets.balanced(frame).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == plain_json(text), text
    assert sum(b is not None for b in got.values()) > 100


def test_long_json_takes_linear_time(spark):
    whole = json.dumps([{"k": f'v{i} "}}', "l": [i, {"m": "[["}]} for i in range(22000)])
    assert len(whole) > 1_000_000
    frame = spark.createDataFrame([(1, "see " + whole + " end }")], "id long, text string")
    began = time.time()
    assert brackets.balanced(frame).first().body == whole
    assert time.time() - began < 30


def plain_tables(text):
    out, rows, number = [], [], 0
    for line in [x.strip() for x in (text or "").split("\n")] + [None]:
        if line == "":
            continue
        if line is not None and re.search(grids.HEADER, line):
            cells = re.split(grids.PARTS, line)
            rows = [cells] if len(cells) > 2 else rows
        elif line is not None and re.search(grids.WIDE, line):
            cells = re.split(grids.PARTS, line)
            rows = [*rows, cells] if len(cells) > 2 else rows
        elif len(rows) > 1:
            number += 1
            out += [(number, i, rows[0], r) for i, r in enumerate(rows[1:], 1)]
            rows = []
    return out


def test_tables(spark):
    draw = random.Random(7)
    lines = ["Creditor   Balance   Date", "Status", "a    b    c", "d\te\tf", "g   h", "stray", "", "  x    1    2  ", "two  words", "Limit\tx\ty", "q    r    s"]
    texts = [None, "", "Account   Balance   Status\nA    1    Open\nB    2    Closed\n\nend\nC    3    x"] + ["\n".join(draw.choice(lines) for _ in range(draw.randint(1, 16))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    got = {}
    for r in grids.tables(frame).orderBy("ord", "table_no", "row_no").collect():
        got.setdefault(r["ord"], []).append((r.table_no, r.row_no, r.headers, r.cells))
    for i, text in enumerate(texts):
        assert got.get(i, []) == plain_tables(text), text
