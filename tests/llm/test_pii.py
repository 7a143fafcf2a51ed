import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.pii import base_spans, find_pii, luhn, mask_pii, masked


def plain(text):
    """The contract's patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text("a.@+- 0123456789()%é\n", max_size=60))
def test_base_is_the_contract(text):
    assert base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "x@y.z.", "1.2.3.4.5.6.7.8", "001.2.3.999", "4111 1111-1111 1111", "+1 (555) 555-1234.", "9" * 5000, "a" * 3000 + "@", "1." * 2000, "@@a@b.co"])
def test_base_cases(text):
    assert base_spans(text) == plain(text)


def test_table(spark):
    rows = [(1, "call +1 (555) 555-1234 or bob@mail.example.com"), (2, None), (3, ""), (1, "call +1 (555) 555-1234 or bob@mail.example.com"), (4, "mail: ann (at) example (dot) com now"), (5, "token=4111111111111111 x"), (None, "ip 10.0.0.7")]
    rows += [(k, f"write to u{k}@ex.org from 10.0.0.{k % 200}") for k in range(10, 60)]
    df = spark.createDataFrame([(k, t, "q") for k, t in rows], "doc_id long, text string, spans string")
    got = find_pii(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].base == "email:26:46,phone:5:22" and by[1].n_email == 1 and by[1].n_phone == 1
    assert by[2].spans == by[3].spans == "" and by[None].base == "ip:3:11"
    assert by[4].base == "" and by[4].spans == "email:6:32"
    for r in got:
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    out = {r.doc_id: r.text for r in mask_pii(df).collect()}
    assert out[1] == "call <phone> or <email>" and out[2] is None and out[4] == "mail: <email> now"
    assert mask_pii(df).columns == df.columns and mask_pii(df).count() == len(rows)
    assert find_pii(df.limit(0)).collect() == []


def test_masked_overlaps():
    assert masked("abcdef", [("phone", 2, 5), ("card", 1, 3)]) == "a<card>f"
