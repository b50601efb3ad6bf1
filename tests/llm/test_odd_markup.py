"""Pages without </head>, self-closed drawings, formulas."""

from quire.llm.html_extract import main_text

P = "The first sentence of this story is long enough to be taken for content. "


def test_head_without_end():
    for end in ("<body>", "", "</head><body>"):
        page = f"<html><head><title>Not this</title><meta charset=utf-8><style>p {{}}</style>{end}<article><p>{P}</p></article>"
        assert main_text(page) == P.strip()
    assert main_text(f"<html><head><title>Not this</title>{P}<p>{P}</p>") == " ".join([P.strip()] * 2)


def test_self_closed_drawing_and_formula():
    assert main_text(f'<article><p>{P}</p><svg class="a/b" width=1 /><p>{P}</p><svg><text>not this</text></svg></article>') == " ".join([P.strip()] * 2)
    assert main_text(f"<article><p>{P}If <math><mi>x</mi><mspace width='1'/><mo>=</mo><mn>2</mn></math> holds, {P}<math/></p><p>{P}</p></article>") == f"{P}If x=2 holds, {P}{P}".strip()
