"""Layouts with columns and element fields that no layout names."""

import pytest

from panelrec.llm import chat


@pytest.mark.parametrize("layout, record, texts", [
    ("turn", "named_struct('at', 0L, 'role', 'user', 'text', 'a', 'lang', 'en') turn", ["a"]),
    ("turn_without_role", "named_struct('at', 0L, 'role', cast(null as string), 'text', 'a', 'lang', 'en') turn", ["a"]),
    ("messages", "array(named_struct('role', 'user', 'content', 'a', 'name', 'n')) messages", ["a"]),
    ("instruction", "'a' instruction, 'b' output, cast(null as string) input", ["a", "b"]),
    ("prompt", "'a' prompt, 'b' completion", ["a", "b"]),
])
def test_extra_fields_keep_the_layout(spark, layout, record, texts):
    rows = chat.canonical_turns(spark.sql(f"select 1L conv_id, {record}, 'web' source, array(named_struct('k', 1)) tags, named_struct('z', 2) meta"))
    got = rows.orderBy("at").collect()
    assert {r.layout for r in got} == {layout} and [r.text for r in got] == texts
