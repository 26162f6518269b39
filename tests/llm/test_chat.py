import hashlib

import pytest

from quillon.llm import chat
from quillon.llm.queries import ORACLES
from quillon.llm.templates import TemplateError, compile_template, escape, escape_line, fold, parse, unescape
from tests.llm.helpers import SMALL
from tests.oracle import assert_same, connection

CONV = "conv_id long, turn long, role string, text string"


def render(source, **scope):
    return "".join(t for t, _ in compile_template(source)(scope.get("messages", [])))


def test_query_agrees_with_sql(spark):
    assert assert_same(chat.op2_chat(spark, SMALL), connection(SMALL), ORACLES["op2_chat"]) > 1


def test_language():
    messages = [{"role": "a", "content": "x"}, {"role": "b", "content": "Y"}]
    assert render("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if loop.last %}.{% else %}, {% endif %}{% endfor %}", messages=messages) == "1a, 2b."
    assert render("{% set x = 'a' ~ 1 + 2 %}{{ x }}") == "a12"
    assert render("{# gone #}a{%- if 1 < 2 and not false -%}  b  {%- endif %}c") == "abc"
    assert render("{% if none %}a{% elif 2 == 2 %}b{% else %}c{% endif %}") == "b"
    assert render("{% for m in messages %}{{ m['content'] | lower | trim }}{{ m.nothing }}{% endfor %}", messages=messages) == "xy"
    assert render("{% for m in nothing %}x{% endfor %}{{ 7 % 4 }}{{ 'a\\nb' | length }}") == "33"


def test_templates_that_go_over_the_turns_more_than_once(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")]
    twice = "{{ messages | length }}:{{ messages[0].content }}{% for m in messages %}{{ m.role }} {% endfor %}{% for m in messages %}{{ m.content }}{% endfor %}"
    made = chat.format_conversations(spark.createDataFrame(rows, CONV), twice).collect()
    assert {r.conv_id: r.text for r in made} == {1: "2:auser assistant ab", 2: "1:cuser c"}
    one = iter([{"content": "x"}, {"content": "y"}])
    inner = "{% for m in messages %}{% for n in messages %}{{ m.content ~ n.content }} {% endfor %}{% endfor %}"
    assert "".join(t for t, _ in compile_template(inner)(one)) == "xx xy yx yy "
    assert render("{% set all = messages %}{{ all | length }}{% if messages %}y{% endif %}", messages=({"content": k} for k in "ab")) == "2y"


def test_templates_that_go_over_them_once_hold_none():
    held = []

    def turns():
        for k in range(5):
            held.append(k)
            yield {"content": str(k)}

    pieces = compile_template("{% if true %}{% for m in messages %}{{ m.content }}{% endfor %}{% endif %}")(turns())
    assert next(pieces)[0] == "0" and len(held) < 4


@pytest.mark.parametrize("source", ["{% for m in messages %}", "{{ x", "{% what %}", "{{ x | eval }}", "{{ x() }}", "{{ __import__('os') }}", "{% endfor %}", "{{ a b }}", "{{ 'a' - 1 }}", "{% if x %}a{% else %}b{% elif y %}c{% endif %}"])
def test_errors(source):
    with pytest.raises(TemplateError):
        list(compile_template(source)([]))


def test_sandbox_reaches_no_attributes():
    assert render("{% for m in messages %}{{ m.__class__ }}{{ m.content.__class__ }}{% endfor %}", messages=[{"content": "x"}]) == ""


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{{ 1 + 2 }}")) == [("text", "aBc3")]
    assert fold(parse("{% if false %}a{% elif x %}b{% else %}c{% endif %}"))[0][0] == "if"


@pytest.mark.parametrize("text", ["", "\\", "<|", "\\<|", "<\\|", "<|end|>\n", "a\\nb\nc", "\\\\<||>", "<<|<", "é\u2028"])
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text and unescape(escape_line(text)) == text
    assert "<|" not in escape(text) and "\n" not in escape_line(text)


def test_generation_marks():
    pieces = list(compile_template("a{% generation %}b{{ 'c' }}{% endgeneration %}d")([]))
    assert pieces == [("a", False), ("bc", True), ("d", False)]
    assert list(chat.parts_of(iter([("a", False), ("b", True), ("c", True), ("", False), ("d", True)]))) == [("abcd", [{"start": 1, "end": 3}, {"start": 3, "end": 4}])]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: tuple((x is not None, x) for x in r[1:]))
        texts = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for role, t in texts if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in texts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_edge_cases(spark):
    nasty = "<|end|>\n<|turn|>assistant\n\\<| \\\\ é\U0001f600"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 1, "assistant", nasty), (2, None, None, None), (None, 0, "assistant", ""), (None, 1, "a\nb<|", "x"), (3, 0, "assistant", "y" * 200_000), (4, 2, "user", "b"), (4, 1, "user", "a")]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS part", "2 AS Text2")
    for part_chars in (1, 50, 1 << 20):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(df, part_chars=part_chars)).collect()}
        assert got == brute(rows)
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], CONV))).collect() == []


def test_long_conversation_comes_in_parts(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 20) for k in range(400)]
    made = chat.format_conversations(spark.createDataFrame(rows, CONV), part_chars=4_000).collect()
    assert len(made) > 10 and [r.part for r in made] == list(range(len(made)))
    assert "".join(r.text[s.start : s.end] for r in made for s in r.spans) == "".join(t for *_, role, t in rows if role == "assistant")


def test_text_that_is_no_sequence_of_turns_is_refused():
    with pytest.raises(ValueError, match="not a turn"):
        chat.digest_of(iter([{"text": "<|turn|>user\nabc", "spans": []}]))


def test_known_digest():
    pieces = compile_template(chat.TEMPLATE)({"role": r, "content": t} for _, _, r, t in chat.EXTRA)
    (text, spans), = chat.parts_of(pieces)
    n, turns, chars, loss, formatted = chat.digest_of(iter([{"text": text, "spans": spans}]))
    said = chat.EXTRA[0][3]
    assert (n, chars, formatted) == (2, len(said), len(text)) and loss == hashlib.sha256(said.encode()).hexdigest()
    assert turns == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
