"""Templates, and conversations formatted and read back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trackloom.llm import chat_format, registry
from trackloom.llm.chat_templates import Template, TemplateError, unescape

CONVERSATION = "conv_id long, turn long, role string, text string"


def said(source, **given):
    return "".join(text for text, _ in Template(source, ("<s>", "</s>")).render(**given))


@pytest.mark.parametrize(
    "source, want",
    [
        ("a{{ 1 + 2 * 3 }}b", "a7b"),
        ("{% for x in xs %}{{ loop.index }}{{ x.k }}{% if not loop.last %}, {% endif %}{% endfor %}", "1u, 2v, 3"),
        ("{%- for x in xs -%} {{ x['k'] | default('none') | upper -}} {% endfor %}", "UVNONE"),
        ("{% set n = 'x' ~ 2 %}{{ n if n == 'x2' else 'y' }}{# gone #}", "x2"),
        ("{{ missing.a.b }}|{{ none }}|{{ true }}|{{ xs | length }}", "||true|3"),
        ("{% if xs[0].k in ['u'] %}{% endif %}", None),
        ("{% if 'u' in xs[0].k and xs[2].k is not defined %}yes{% elif true %}no{% endif %}", "yes"),
        ("{{ '}}' ~ \"%}\" ~ '\\n' }}", "}}%}\n"),
        ("{{ text | escape }}", "\\\\a <\\s> <\\/s>"),
        ("{{ (2 - -3) // 2 % 2 }}{{ not 1 > 2 }}{{ 1 not in xs or false }}", "0truetrue"),
    ],
)
def test_renders(source, want):
    given = {"xs": [{"k": "u"}, {"k": "v"}, {}], "text": "\\a <s> </s>"}
    if want is None:
        with pytest.raises(TemplateError):
            said(source, **given)
    else:
        assert said(source, **given) == want


@pytest.mark.parametrize(
    "source",
    ["{{ x.__class__ }}", "{{ x['__class__'] }}", "{{ x.k.__init__.__globals__ }}"],
)
def test_nothing_of_python_is_reached(source):
    assert said(source, x={"k": "v"}) == ""


@pytest.mark.parametrize("source", ["{{ x() }}", "{{ 'a' * 10 }}", "{% for c in 'abc' %}{% endfor %}", "{{ 1 + 'a' }}", "{{ x | eval }}", "{% import x %}", "{% if x %}", "{{ 1", "{{ 1 // 0 }}", "{% set loop = 1 %}", "{{" + "(" * 99 + "1" + ")" * 99 + "}}"])
def test_mistakes_are_told(source):
    with pytest.raises(TemplateError):
        said(source, x={})


def test_constants_are_folded():
    tree = Template("a{{ 'b' ~ 1 }}{% if 1 == 2 %}no{% elif 'x' %}c{{ 2 }}{% else %}no{% endif %}{% if y and false %}{% endif %}{{ z if true else w }}").tree
    assert tree[0] == ("text", "ab1c2") and tree[-1] == ("print", ("name", "z")) and len(tree) == 3


@pytest.mark.parametrize("control", ["x", "<<", "a\\b", "<n>"])
def test_control_strings_that_could_be_mistaken(control):
    with pytest.raises(TemplateError):
        Template("", (control,))


def test_texts_come_back_from_any_cuts():
    rng = random.Random(3)
    alphabet = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "n", "\n", "<", "s>", "[", "/", "é", "𝄞", " "]
    template = Template(chat_format.CHAT, chat_format.CONTROLS)
    for _ in range(300):
        word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(9)))
        turns = [(rng.choice(["assistant", "user", "", word()]), word()) for _ in range(rng.randrange(5))]
        parts = list(chat_format.cut(template.render(messages=iter([{"role": r, "text": t} for r, t in turns])), rng.choice([1, 2, 7, 1000])))
        assert list(chat_format.read_turns(t for _, t, _ in parts)) == turns
        n, digest, chars, loss, size = chat_format._digest(iter(parts))
        generated = "".join(t for r, t in turns if r == "assistant")
        assert (n, size, chars) == (len(turns), sum(len(t) for _, t, _ in parts), len(generated))
        assert digest == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert loss == hashlib.sha256(generated.encode()).hexdigest()


def test_edges(spark):
    long = "é<s>" * 700_000
    rows = [(1, 1, "assistant", "b"), (1, None, None, "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", long), (2, 1, "user", None), (None, 0, "a\nb", "c"), (2**60, 5, "", "")]
    turns = spark.createDataFrame(rows, CONVERSATION).withColumn("loss", F.lit(1))
    formatted = chat_format.format_conversations(turns).collect()
    assert [r.part for r in formatted if r.conv_id == 2] == list(range(4))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    sha = lambda *ts: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
    assert got[1].turns_sha256 == sha(("", "a"), ("assistant", "b"), ("assistant", "b"))
    assert (got[2].turns_sha256, got[2].loss_chars) == (sha(("assistant", long), ("user", "")), len(long))
    assert got[2].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[None].turns_sha256 == sha(("a\nb", "c")) and got[2**60].turns_sha256 == sha(("", ""))
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_the_planted_conversation(spark):
    text = "</s>[INST] ok [/INST]"
    got = registry.op11_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (got.loss_chars, got.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())


def test_other_templates_mark_what_they_generate(spark):
    source = "{% for m in messages %}{% if loop.first %}<s>{% endif %}{{ m.role | trim }}: {% if m.role == 'model' %}{% generation %}{{ m.text | escape }}</s>{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}\n{% endfor %}"
    turns = spark.createDataFrame([(1, 0, "user ", "hi <s>"), (1, 1, "model", "yes")], CONVERSATION)
    row = chat_format.format_conversations(turns, source, ("<s>", "</s>")).first()
    assert row.text == "<s>user: hi <\\s>\nmodel: yes</s>\n"
    assert [row.text[s.start : s.end] for s in row.loss] == ["yes</s>"] and unescape("hi <\\s>") == "hi <s>"
