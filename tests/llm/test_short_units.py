"""Passages of short lines and of short clauses go too."""

from test_dedup import frame

from quire.llm import substring_dedup

VERSE = "\n".join(f"the {w} came home\nand no {w} left" for w in ("ant", "bee", "cow", "dog", "elk", "fox"))
CLAUSES = " ".join(f"a {w} sat, the {w} ate, no {w} saw;" for w in ("owl", "pig", "rat", "yak", "hen", "gnu", "emu", "cod", "eel", "koi", "ram", "sow"))


def test_short_lines_and_clauses(spark):
    rows = [(1, f"A first line of its own, long enough.\n{VERSE}\n"), (2, f"Another line that opens this one here.\n{VERSE}\nAn end."), (3, f"Own words, these, {CLAUSES} and more"), (4, f"Other words, those here, {CLAUSES} or less")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_passages(frame(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "Another line that opens this one here.\nAn end."
    assert len(got[4].split()) < len(rows[3][1].split()) / 2
    few = [(1, "one line\nand two"), (2, "one line\nand two\nbut three")]
    assert {r["doc_id"]: r["text"] for r in substring_dedup.dedup_passages(frame(spark, few)).collect()} == dict(few)
