import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from likeness.llm import chat
from likeness.llm.catalog import CONTROL_TEXT
from likeness.llm.template import Template, TemplateError


@pytest.mark.parametrize(
    ("source", "names", "want"),
    [
        ("a{{ x }}b", {"x": 1}, "a1b"),
        ("{{ 'a' ~ 1 ~ none ~ true }}", {}, "a1true"),
        ("{% if x == 'y' and not z %}1{% elif x in ['z'] or z %}2{% else %}3{% endif %}".replace("['z']", "'zz'"), {"x": "z", "z": None}, "2"),
        ("{% for t in ts %}{{ loop.index }}{{ t.a|upper }}{% if not loop.last %},{% endif %}{% endfor %}", {"ts": iter([{"a": "x"}, {"a": "y"}])}, "1X,2Y"),
        ("{% set n = 1 + 2 - 1 %}{{ n }}{# gone #}", {}, "2"),
        (" {%- if true -%} x {%- endif -%} ", {}, "x"),
        ("{{ a['b'].c | default('d') }}", {"a": {"b": {}}}, "d"),
        ("{{ 'yes' if x > 1 else 'no' }}{{ '\\n\\'' }}", {"x": 2}, "yes\n'"),
        ("{% for t in none %}x{% endfor %}", {}, ""),
    ],
)
def test_language(source, names, want):
    assert Template(source).text(**names) == want


@pytest.mark.parametrize("source", ["{{ x() }}", "{{ x.__class__ }}", "{{ x|eval }}", "{% import os %}", "{% if x %}", "{{ 'a' 'b' }}", "{% for loop in x %}{% endfor %}", "{{ }}", "{{ 1 + }}"])
def test_what_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_attributes_are_keys_of_mappings_only():
    assert Template("{{ x.real }}{{ x['__class__'] }}").text(x=3) == ""


def test_constants_are_folded():
    assert Template("a{{ 'b' ~ 1 }}{% if 1 == 2 %}c{% elif true %}{{ 'd'|upper }}{% endif %}").tree == [("text", "ab1D")]
    assert [n[0] for n in Template("{% if false %}a{% elif x %}b{% else %}c{% endif %}").tree] == ["if"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, chat.ESCAPE, "<", "|", "[", "end|>", "é", "\n", "text"]), max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)


def _want(turns):
    own = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), own.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_read_back(spark):
    rows = [(1, 0, "user", CONTROL_TEXT), (1, 1, "assistant", CONTROL_TEXT), (2, 1, "assistant", "b\\<|end|>"), (2, 0, "system", ""), (2, 2, "assistant", None), (3, 0, None, "<|turn|>"), (3, 0, "a\nb", "x"), (3, None, "user", "first"), (None, 0, "user", "🙂"), (4, 0, "assistant", "z" * 100_000), (5, 0, "user", "same"), (5, 0, "user", "same")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.format_conversations(frame, with_text=True).collect()}
    want = {
        1: [("user", CONTROL_TEXT), ("assistant", CONTROL_TEXT)], 2: [("system", ""), ("assistant", "b\\<|end|>"), ("assistant", "")], 3: [("user", "first"), ("", "<|turn|>"), ("a\nb", "x")],
        None: [("user", "🙂")], 4: [("assistant", "z" * 100_000)], 5: [("user", "same"), ("user", "same")],
    }
    assert got.keys() == want.keys()
    for i, turns in want.items():
        assert tuple(got[i])[1:5] == _want(turns)
        assert got[i].formatted_chars == len(got[i].formatted)
        assert [chat.unescape(got[i].formatted[a:b]) for a, b in got[i].learned] == [t for r, t in turns if r == "assistant"]
        assert got[i].formatted.count(chat.END) == len(turns)


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
