"""Chat formatting, importance resampling and periodic runs against brute force, and on awkward tables."""

from collections import Counter
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from sievemark.llm import chat, importance, periodic_runs, surrogates
from sievemark.llm.chat_template import Const, Output, Template, TemplateError, escaped, escaped_line, folded, parse, unescaped, unescaped_line
from sievemark.llm.queries import QUERIES

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
DOCS = "doc_id long, text string, rank int, bucket string, n_words int, start string"
ODD = [
    (1, "a b a b a b a b a b"), (1, "a b a b a b a b a b"), (1, "a b a b a b a b a b"), (2, None), (3, ""), (4, " \n\t ,.;"), (None, "no id but Words, words and words here"),
    (None, None), (5, LONG), (5, LONG), (6, "x " * 5000), (7, "É é É 漢字 漢字-漢字 漢字 " * 8), (8, "tok-tok\x1ftok\x85tok " * 30), (10, "one two three " * 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 3, "b", 4, "s") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- templates


def test_expressions_and_statements():
    def out(source, *messages):
        return Template(source).render([{"role": r, "text": t} for r, t in messages])[0]

    assert out("{{ 1 + 2 * 3 - 4 // 3 % 2 }}{{ 'a' ~ 1 ~ true }}{{ -2 + 5 }}") == "6a1true3"
    assert out("{{ 'yes' if 2 > 1 and not 1 == 2 else 'no' }}{{ 'b' in 'abc' }}{{ 'x' not in 'abc' }}") == "yestruetrue"
    assert out("{{ not not 1 }}{{ not not not 1 }}") == "truefalse"
    talk = [("system", " s "), ("user", "u"), ("assistant", "a")]
    assert out("{% for m in messages -%} {{ loop.index0 }}{{ m['role'] | upper | trim }}{% if not loop.last %}, {% endif %}{% endfor %}", *talk) == "0SYSTEM, 1USER, 2ASSISTANT"
    assert out("{% set who = messages[0].text | trim %}{{ who }}{{ messages | length }}{{ (messages | last).text }}{{ messages[9].text }}", *talk) == "s3a"
    assert out("{% for m in messages %}{% for n in messages %}{{ n.text|trim }}{% endfor %}{{ loop.index }}{{ m.text }}{% endfor %}", *talk) == "sua1 s sua2usua3a"
    assert out("{# no {{ #}{{ '}}' }}{% if false %}x{% elif messages[0].role == 'user' %}u{% else %}e{% endif %}", *talk) == "}}e"
    assert out("a {{- ' b ' -}} c") == "a b c"
    text, spans = Template("{% for m in messages %}<{% generation %}{{ m.text }}{% endgeneration %}>{% endfor %}").render([{"role": "x", "text": t} for t in ("éé", "", "b")])
    assert (text, [text[a:b] for a, b in spans]) == ("<éé><><b>", ["éé", "b"])


@pytest.mark.parametrize("source", [
    "{{ x.__class__() }}", "{{ 'a'.format }}", "{% for m in messages %}", "{{ 1 // 0 }}", "{{", "{% import os %}", "{{ x | eval }}", "{{ 99999999999999999999 }}",
    "{% set loop. = 1 %}", "{{ ((( }}", "{% endif %}", "{{ 'a' + 1 }}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "{% if 1 %}" * 99, "{% for m in 'text' %}x{% endfor %}", "x" * 70_000,
])
def test_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        Template(source).render([])


def test_joined_text_is_bounded():
    with pytest.raises(TemplateError):
        Template("{% set x = 'aaaaaaaaaaaaaaaa' %}{% for m in messages %}{% set x = x ~ x %}{% endfor %}").render([{"role": "", "text": ""}] * 60)


def test_constants_are_folded():
    assert folded(parse("a{{ 'b' ~ 1 + 1 }}{% if 1 > 2 %}x{% else %}c{% endif %}{{ 'd' | upper }}")) == (Output(Const("ab2cD")),)
    assert folded(parse("{% if true or y %}k{% endif %}{{ 'p' if false else 'q' }}")) == (Output(Const("kq")),)
    assert len(Template(chat.TURNS).tree) == 1 and Template(chat.TURNS).streams
    for source in ("{% for m in messages %}{{ messages | length }}{% endfor %}", "{{ messages[0].text }}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}"):
        assert not Template(source).streams


def test_folded_trees_render_alike():
    rng = random.Random(5)

    def expression(depth):
        if depth == 0:
            return rng.choice(["1", "2", "'s'", "true", "none", "m.role", "m.text", "loop.index"])
        a, b, c = (expression(depth - 1) for _ in range(3))
        return rng.choice([f"({a} ~ {b})", f"({a} == {b})", f"({a} and {b})", f"({a} or {b})", f"(not {a})", f"({a} if {b} else {c})", f"({a} | string | upper)"])

    messages = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": ""}]
    for _ in range(300):
        source = "{% for m in messages %}" + "".join("{{ " + expression(rng.randint(0, 3)) + " }}|" for _ in range(4)) + "{% endfor %}"
        plain = Template(source)
        whole = plain.render(messages)
        plain.tree = parse(source)
        unfolded = Template.__new__(Template)
        unfolded.streams = plain.streams
        from sievemark.llm import chat_template as ct

        unfolded.steps = [(n.name, ct._body(n.body)) for n in plain.tree]
        assert unfolded.render(messages) == whole


def test_escaping_is_reversible():
    rng = random.Random(2)
    for _ in range(2000):
        role, text = ("".join(rng.choice(["\\", "#", "##", "###", "</turn>", "<", "/turn>", "\n", "n", "é", " ", "### x\n"]) for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert unescaped(escaped(text)) == text and unescaped_line(escaped_line(role)) == role
        formatted, spans = Template(chat.TURNS).render([{"role": role, "text": text}, {"role": "assistant", "text": text}, {"role": role, "text": role}])
        assert chat.turns_of(formatted) == [(role, text), ("assistant", text), (role, role)]
        assert "".join(unescaped(formatted[a:b]) for a, b in spans) == text
    with pytest.raises(ValueError):
        chat.turns_of("### user\nno end")


def digests(rows):
    """Of (role, text) turns in order."""
    turns = [(r or "", t or "") for r, t in rows]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(escaped_line(r)) + len(escaped(t)) + 13 for r, t in turns)


def test_chat_query(spark):
    given = spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect()
    talks = {}
    for r in given:
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    talks[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    rows = QUERIES["op11_chat_format"](spark, SMALL).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {k: digests(v) for k, v in talks.items()} and len(rows) == len(talks)


def test_chat_odd_rows_and_pieces(spark):
    schema = "conv_id long, turn int, role string, text string, piece string, loss int"
    rows = [(1, 2, "assistant", "b"), (1, 1, None, None), (1, None, "assistant", "last"), (1, 2, "assistant", "b"), (None, 1, "user\n###", "x"), (2, 0, "assistant", "")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k} </turn>\n") for k in range(500)] + [(4, 0, "user", "### " * 50_000)]
    turns = spark.createDataFrame([(*r, "p", 1) for r in rows], schema)
    expected = {}
    for conv in (1, 2, 3, 4, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        expected[conv] = digests([(r[2], r[3]) for r in own])
    formatted = chat.format_conversations(turns, piece_chars=64).cache()
    assert formatted.filter("conv_id = 3").count() > 100
    for result in (chat.read_back(formatted), chat.read_back(chat.format_conversations(turns), arranged=True)):
        assert {r[0]: tuple(r)[1:] for r in result.collect()} == expected
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0
    whole = chat.format_conversations(turns, "{{ messages | length }}").collect()
    assert {r["conv_id"]: r["text"] for r in whole} == {1: "4", 2: "1", 3: "500", 4: "1", None: "1"}


# --- importance resampling


def features_of(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(found), [zlib.crc32(w.encode()) % 10_000 for w in found + [f"{a} {b}" for a, b in zip(found, found[1:])]]


def resampled(rows, target):
    """Expected (doc_id, n_features, weight, score) of every row, and the number of drawn rows."""
    raw = [(i, *features_of(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in raw for b in f), Counter(b for x in target for b in features_of(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in raw:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append((n, (i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))))
    return out


def check_resampled(rows, given, target):
    expected = resampled(given, target)
    assert Counter(tuple(r)[:4] for r in rows) == Counter(e for _, e in expected)
    able = sorted((e for n, e in expected if n >= 20), key=lambda e: (-e[3], e[0] is None, e[0] or 0))
    drawn = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    n = 25 * len(able) // 100
    assert [r["rank"] for r in drawn] == list(range(1, n + 1))
    assert [(r["score"], r["doc_id"]) for r in drawn] == [(e[3], e[0]) for e in able[:n]]


def test_importance_resampling(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    check_resampled(QUERIES["op12_importance_resampling"](spark, SMALL).collect(), given, target)


def test_importance_odd_rows(spark, odd, nothing):
    target = spark.createDataFrame([("one two three",), (None,), ("漢字",)], "text string")
    check_resampled(importance.resample(odd, target).collect(), ODD, ["one two three", None, "漢字"])
    check_resampled(importance.resample(odd, target.limit(0)).collect(), ODD, [])
    assert importance.resample(nothing, target).count() == 0
    assert importance.resample(odd, target, buckets=100_000).count() == len(ODD)
    # A third of the rows share an id and a text, hence a score; the cut falls among them.
    many = [(9, LONG[:400])] * 300 + [(k, f"{k} " * 25) for k in range(1000, 1040)]
    rows = importance.resample(spark.createDataFrame([(*r, 3, "b", 4, "s") for r in many], DOCS), target).collect()
    check_resampled(rows, many, ["one two three", None, "漢字"])


def test_n_grams_of_more_words():
    rng = random.Random(4)
    for _ in range(50):
        given = [rng.choice(["a", "bb", "ccc", "é9"]) for _ in range(rng.randint(0, 12))]
        line = "--".join(w.replace("a", "A").replace("b", "B") for w in given)
        for orders in (1, 2, 3):
            expected = [" ".join(given[k : k + n]) for n in range(1, orders + 1) for k in range(len(given) - n + 1)]
            n_words, found = importance.scan(f" {line}.".encode(), importance.patterns(orders), 65_536)
            assert (n_words, list(found)) == (len(given), [zlib.crc32(e.encode()) % 65_536 for e in expected])


# --- periodic runs


def runs_of(words, exponent=4, least=6):
    """Every run by definition: stretches of equal words one period apart, smallest period first."""
    n, out, seen = len(words), [], set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p) and (i, j) not in seen and (i, j + p) not in seen:
                out.append((i, j + p - i, p))
                seen.add((i, j + p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_definition():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            kinds, n = rng.choice([1, 2, 2, 3, 5]), rng.choice([0, 1, 2, 5, 8, 13, 30, 60])
            w = [rng.randrange(kinds) for _ in range(n)]
            if rng.random() < 0.5 and n:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            texts.append(w)
        symbols = np.array([x for w in texts for x in w], dtype=np.int64)
        sequence = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        exponent, least = rng.choice([(4, 6), (3, 2), (2, 2)])
        found = [tuple(map(int, r)) for r in periodic_runs.find_runs(symbols, sequence, exponent, least)]
        assert found == [(k, *r) for k, w in enumerate(texts) for r in runs_of(w, exponent, least)]


def test_suffix_and_lcp_arrays():
    rng = random.Random(3)
    for _ in range(100):
        texts = [[rng.randrange(3) for _ in range(rng.randint(1, 30))] for _ in range(3)]
        s = periodic_runs.SuffixArray(np.array(sum(texts, []), dtype=np.int64), np.repeat(np.arange(3), [len(t) for t in texts]))
        suffixes = sorted((k, t[i:], sum(map(len, texts[:k])) + i) for k, t in enumerate(texts) for i in range(len(t)))
        assert s.array.tolist() == [x[2] for x in suffixes]
        for x, (a, b) in enumerate(zip(suffixes, suffixes[1:]), 1):
            same = 0
            while a[0] == b[0] and same < min(len(a[1]), len(b[1])) and a[1][same] == b[1][same]:
                same += 1
            assert s.lcp[x] == same


def expected_run(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = runs_of(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
        sha(" ".join(w for k, w in enumerate(words) if k not in dropped)),
    )


def test_periodic_runs_query(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 12_000]
    rows = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert any(r[1] for r in rows.values())
    for doc_id, text in given:
        assert rows[doc_id] == expected_run(doc_id, text)


def test_periodic_runs_odd_rows(odd, nothing):
    short = [r for r in ODD if len(r[1] or "") < 50_000]
    rows = Counter(tuple(r) for r in periodic_runs.repetitions(odd, planted=True).collect())
    expected = Counter(expected_run(*r) for r in short)
    assert not expected - rows and sum(rows.values()) == len(ODD)
    assert periodic_runs.repetitions(odd).filter("doc_id = 1").first()["length"] == 10
    assert periodic_runs.repetitions(nothing).count() == 0


def test_the_written_form_names_its_surrogate_once(spark):
    """A surrogate spelled out in each branch of its written form makes a plan that fills the driver."""
    rows = spark.createDataFrame([("email", "Ann@Post.org", "ann@post.org"), ("card", "4111 1111 1111 1111", "4111111111111111")], "kind string, text string, value string")
    drawn = surrogates.surrogate(F.col("kind"), F.col("value"), F.lit(0))

    def size(column):
        return len(rows.select(column)._jdf.queryExecution().analyzed().toString())

    assert size(surrogates.in_form_of(F.col("kind"), F.col("text"), drawn)) < 3 * size(drawn)
    written = [r[0] for r in rows.select(surrogates.in_form_of(F.col("kind"), F.col("text"), drawn)).collect()]
    plain = [r[0] for r in rows.select(drawn).collect()]
    assert [w.lower() for w in written[:1]] == plain[:1] and written[1].replace(" ", "") == plain[1] and written[1].count(" ") == 3
