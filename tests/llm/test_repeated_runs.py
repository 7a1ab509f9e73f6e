"""Runs of neighbouring repeats, against brute force and on odd rows."""

import random
import re

from airtoll.llm import line_dedup


def kept_by_brute_force(rows, least):
    """(doc_id, units removed, kept text) of rows with ids of their own."""
    first, cut = {}, {}
    for i, text in sorted(rows):
        cut[i] = [u for u in re.findall(r"(?s).*?(?:[.!?][ \t\r\x0b\x0c]+|\n|\Z)", text or "") if u]
        for k, u in enumerate(cut[i]):
            first.setdefault(" ".join(u.lower().split()), (i, k))
    out = set()
    for i, units in cut.items():
        worded = [k for k, u in enumerate(units) if u.split()]
        repeat = [first[" ".join(units[k].lower().split())] != (i, k) for k in worded]
        gone, removed, at = set(), 0, 0
        while at < len(worded):
            to = at
            while to < len(worded) and repeat[to]:
                to += 1
            if sum(len(units[k].split()) for k in worded[at:to]) >= least:
                gone |= set(range(worded[at], worded[to - 1] + 1))
                removed += to - at
            at = max(to, at + 1)
        out.add((i, removed, "".join(u for k, u in enumerate(units) if k not in gone)))
    return out


def test_runs_by_brute_force(spark):
    r = random.Random(8)
    sentences = [" ".join(r.choice(["Aa", "b", "c,", "é", "dd"]) for _ in range(r.randint(1, 12))) + r.choice([".", "!", "", "?"]) for _ in range(60)]
    rows = []
    for i in range(150):
        text, at = "", 0
        for _ in range(r.randint(0, 14)):
            at = (at + 1) % 60 if r.random() < 0.6 else r.randrange(60)
            text += sentences[at] + r.choice([" ", "\n", "\n\n", "  \t", " \n "])
        rows.append((i, text))
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, words int, place int")
    for least in (1, 8, 20):
        got = {(x["doc_id"], x["n_removed"], x["kept_text"]) for x in line_dedup.line_dedup(table, by="sentence", min_words=least).collect()}
        assert got == kept_by_brute_force(rows, least)


def test_a_passage_inside_a_line_and_a_heading_alone(spark):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen seventeen eighteen nineteen twenty! "
    rows = [(1, "Start here. " + passage + "The end."), (2, "Another start of a line. " + passage + "Another end.\nWith best regards"),
            (3, "With best regards\nSomething else"), (4, None), (5, ""), (6, " \n\n"), (2, "Another start of a line. " + passage + "Another end.\nWith best regards")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"], r["kept_text"], tuple(map(tuple, r["spans"])))
           for r in line_dedup.line_dedup(table, by="sentence", min_words=20).collect()}
    assert got == {(1, 0, rows[0][1], ()), (2, 3, "Another start of a line. Another end.\nWith best regards", ((25, 25 + len(passage)),)),
                   (3, 0, rows[2][1], ()), (4, 0, "", ()), (5, 0, "", ()), (6, 0, " \n\n", ())}


def test_a_very_long_text(spark):
    """A text of 400,000 characters that repeats as a whole, with a line of its own in the middle."""
    lines = [f"line number {i} of a long text with some words." for i in range(8000)]
    other = lines[:4000] + ["only here."] + lines[4000:]
    table = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in line_dedup.line_dedup(table, by="sentence", min_words=20).collect()}
    assert got == {1: (0, "\n".join(lines)), 2: (8000, "only here.\n")}
