import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import documents, empty, plain
from trailmetrics.llm import fill_in_middle as fim


def brute(doc_id, text, seed=7, rate=100, spm=50):
    """(form, n, prefix, middle, output) straight from the rule, with regular expressions and strings."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return "plain", n, None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return "spm", n, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", n, len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(rows, want, seed=7, rate=100, spm=50):
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0,
                    r["output"], r["output_sha256"], r["restored_sha256"]) for r in rows)
    expected = []
    for doc_id, text in want:
        form, n, prefix, middle, output = brute(doc_id, text, seed, rate, spm)
        expected.append((doc_id is None, doc_id or 0, n, form, prefix or 0, middle or 0, output,
                         hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(expected)


def test_awkward_rows(spark):
    docs = documents(spark)
    check(fim.fill_in_middle(docs).collect(), plain(docs))
    rows = fim.fill_in_middle(docs).filter("form = 'plain'").collect()
    assert all(r["prefix_chars"] is None and r["middle_chars"] is None for r in rows)


def test_texts_of_many_lines(spark):
    texts = [(i, "".join(f"ligne {k} é\n" * (k % 3) + "\n" * (k % 2) for k in range(i))) for i in range(60)]
    texts += [(100, "a<P>b\nc"), (101, "x\n<M>"), (102, "<\nS>\n<P\n>"), (103, "\r\n\r\n"), (104, "last\nno end"), (105, "\n\n\n")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    check(fim.fill_in_middle(frame).collect(), texts)
    check(fim.fill_in_middle(frame, seed=3, rate=40, spm_share=10).collect(), texts, 3, 40, 10)
    forms = {r["form"] for r in fim.fill_in_middle(frame).collect()}
    assert forms == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.fill_in_middle(empty(spark)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM\nab é日"), st.integers(0, 10_000))
def test_round_trip(text, doc_id):
    form, _, table = fim.transformed(text.encode(), doc_id, 7, 100, 50)
    output = table.content()
    assert output.decode() == brute(doc_id, text)[4]
    assert fim.restored(output, form).content() == text.encode()
    assert table.sha256() == hashlib.sha256(output).hexdigest()


@pytest.mark.parametrize("order", list(fim.ARRANGEMENTS.values()))
def test_inverse(order):
    back = fim.inverse(order)
    assert [order[back[i]] for i in range(6)] == list(range(6))


def test_cut_keeps_the_content():
    table = fim.PieceTable.over(b"0123456789").cut(0, 4, 4, 10)
    assert [bytes(p) for p in table.stream()] == [b"", b"0123", b"", b"456789", b""]
    assert table.cut(2).content() == b"0123456789"
