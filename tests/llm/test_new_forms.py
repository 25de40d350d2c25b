"""Fill-in-middle, collocations and chat formatting on odd tables, against plain versions and round trips."""

import hashlib
import itertools
import json
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archsieve.llm import chat, fim, phrases

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_cut(i, text):
    t, h = text or "", sha(f"1:{'' if i is None else i}")
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    x, y = sorted((a % (len(t) + 1), b % (len(t) + 1)))
    if not t or re.search("<[PSM]>", t) or c % 100 >= 90:
        return (i, len(t), "plain", None, None, t)
    one, two, three = t[:x], t[x:y], t[y:]
    return (i, len(t), "spm", x, y - x, f"<S>{three}<P>{one}<M>{two}") if d % 100 < 20 else (i, len(t), "psm", x, y - x, f"<P>{one}<S>{three}<M>{two}")


def test_fill_in_middle(spark, odd, none, rows):
    marked = [(900 + i, t) for i, t in enumerate(["a<P>b", "<S>", "x<M>", "<", "P>", "<<P", "end <S", "퟿\n\U0001f600"])]
    table = odd.select("doc_id", "text").unionByName(spark.createDataFrame(marked, "doc_id long, text string"))
    got = fim.restore(fim.transform(table)).collect()
    want = [plain_cut(i, t) for i, t in [(r[0], r[1]) for r in rows] + marked]
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(repr, want))
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert all(r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(r.restored) for r in got)
    assert sorted(r.restored for r in got) == sorted((t or "") for t in [r[1] for r in rows] + [m[1] for m in marked])
    assert fim.transform(odd).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    assert fim.restore(fim.transform(none)).count() == 0


def test_fill_in_middle_of_words_and_other_markers(spark):
    markers = fim.Markers("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(i, "one  two\nthree four five " * 3) for i in range(60)], "doc_id long, text string")
    got = fim.restore(fim.transform(docs, seed="s", unit=fim.WORD, plain_percent=0, spm_percent=50, markers=markers), markers).collect()
    assert {r.form for r in got} == {"psm", "spm"} and {r.n for r in got} == {15}
    for r in got:
        assert r.restored == "one  two\nthree four five " * 3
        assert re.search(r"(^|\s)$", r.restored[: r.prefix_chars]) and re.search(r"(^|\s)$", r.restored[: r.prefix_chars + r.middle_chars])


@pytest.mark.parametrize("bad", [("", "b", "c"), ("a", "a", "c"), ("<P>", "<P>x", "c"), ("aba", "x", "y"), ("ab", "bc", "z")])
def test_markers_that_cannot_be_told_apart(bad):
    with pytest.raises(ValueError):
        fim.Markers(*bad)


@given(st.text("<PSM>a", max_size=30), st.integers(0, 400))
def test_restored_for_any_text(text, i):
    _, _, form, _, _, out = plain_cut(i, text)
    assert fim.restored(form, out, fim.Markers()) == text


def plain_phrases(rows, least, words, top, percent=80):
    folded = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(folded)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, words + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        kept = {p: a for p, a in count.items() if a >= least}
        inner = Counter()
        for p, a in kept.items():
            for x, y in itertools.combinations(range(len(p) + 1), 2):
                if 1 < y - x < len(p):
                    inner[p[x:y]] = max(inner[p[x:y]], a)
        found = []
        for p, a in kept.items():
            if len(p) > 1 and 100 * inner[p] < percent * a:
                score, cut = min((2000000 * a // (kept[p[:c]] + kept[p[c:]]), c) for c in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), kept[p[:cut]], kept[p[cut:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -score) for i, (score, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_words,places,least,words,top", [(2_000_000, 28, 3, 4, 2000), (900, 6, 2, 5, 7), (300, 12, 2, 2, 2000)])
def test_collocations(spark, odd, none, rows, slice_words, places, least, words, top):
    """Slices of any size, and a map so small that most of its bits are set by chance, give the same."""
    extra = [("en", "Big Apple pie. big apple PIE, the big apple pie\tbig  apple"), ("fr", "à la Carte à la carte; à LA carte\x0bà la carte"), (None, "no lang no lang no lang"), ("und", "no lang! İstanbul ΑΣ istanbul İstanbul ΑΣ")]
    table = odd.select("lang", "text").unionByName(spark.createDataFrame(extra, "lang string, text string"))
    got = sorted(tuple(r) for r in phrases.mine(table, least, words, top, slice_words=slice_words, map_bits=places).collect())
    assert got == plain_phrases([(r[2], r[1]) for r in rows] + extra, least, words, top) and got
    assert phrases.mine(none).count() == 0


def test_collocations_score_beyond_64_bits(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    big = 6 * 10**12
    every = spark.createDataFrame([("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big)], "lang string, k int, phrase string, f long")
    monkeypatch.setattr(phrases, "levels", lambda *_: (spark.createDataFrame([("en", 10**14)], "lang string, n long"), every))
    assert [tuple(r) for r in phrases.mine(spark.createDataFrame([], "lang string, text string")).collect()] == [("en", 1, "a b", big, big + 1, big + 3, 10**14, 2000000 * big // (2 * big + 4))]


RECORDS = [
    ({"role": "user", "text": "x"}, "turn", [("user", "x")]),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None, "name": "n"}], "id": 3, "meta": {"a b": [1, "x"]}}, "messages", [("user", "q"), ("assistant", "")]),
    ({"messages": []}, "messages", []),
    ([{"content": "q", "role": "user"}], "message list", [("user", "q")]),
    ([], "message list", []),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message parts", [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, "from and value", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ({"prompt": "q", "completion": "a"}, "prompt and completion", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": 7}, "prompt and response", [("user", "q"), ("assistant", "7")]),
    ({"system": "s", "prompt": "q", "response": "a"}, "system, prompt and response", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"system": "", "prompt": "q", "response": "a"}, "system, prompt and response", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "output": "o"}, "instruction and output", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction, input and output", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"instruction": "i", "input": None, "output": "o"}, "instruction, input and output", [("user", "i"), ("assistant", "o")]),
    ({"question": "q", "answer": "a"}, "question and answer", [("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": ["b"]}]}, None, None),
    ({"prompt": "q", "answer": "a"}, None, None),
    ({"unknown": 1}, None, None),
    (3, None, None),
]


def test_layouts_of_json(spark):
    rows = [(i, json.dumps(r), "clash") for i, (r, _, _) in enumerate(RECORDS)] + [(100, "{broken", None), (101, None, None), (102, "", None)]
    table = spark.createDataFrame(rows, "id long, record string, turns string")
    got = {r.id: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.from_json(table, "record", ("id",)).collect()}
    assert got == {i: (name, turns) for i, (_, name, turns) in enumerate(RECORDS)} | dict.fromkeys((100, 101, 102), (None, None))
    assert chat.from_json(table.where("false"), "record", ("id",)).count() == 0


def test_layouts_of_tables(spark):
    table = spark.createDataFrame([(1, "q", "a", "x"), (2, None, "a", "x")], "id long, prompt string, completion string, role string")
    got = chat.from_table(table, ("prompt", "completion"), ("id",)).collect()
    assert [(r.id, r.layout, [tuple(t) for t in r.turns]) for r in got] == [(1, "prompt and completion", [("user", "q"), ("assistant", "a")]), (2, "prompt and completion", [("user", ""), ("assistant", "a")])]
    with pytest.raises(ValueError):
        chat.from_table(table, ("prompt", "role"))
    with pytest.raises(ValueError):
        chat.from_table(table, ())


def test_fingerprints_of_types_and_variants_are_equal(spark):
    for layout in chat.LAYOUTS:
        empty = {"string": '"x"'}

        def example(kind):
            if kind.typeName() == "struct":
                return "{" + ",".join(f'"{f.name}":{example(f.dataType)}' for f in kind) + "}"
            return f"[{example(kind.elementType)}]" if kind.typeName() == "array" else empty["string"]

        schema = spark.range(1).select(F.schema_of_variant(F.parse_json(F.lit(example(layout.type))))).first()[0]
        assert chat.paths_of_schema(schema) == chat.paths_of_type(layout.type)
    assert chat.paths_of_schema("OBJECT<`a``: OBJECT<`: ARRAY<ARRAY<VARIANT>>, b: DECIMAL(2,1), c: OBJECT<>>") == {"a`: OBJECT<[][]*", "b"}


pieces = st.lists(st.sampled_from(["<", "|", "\\", "<|", "<|im_end|>", "<|im_start|>", "\n", "a", "<\\|", "n"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.just("assistant"), pieces), pieces), max_size=6))
def test_formatted_turns_come_back(turns):
    text, spans = chat.formatted(turns)
    assert chat.turns_of(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count("<|") == 2 * len(turns)


def test_chat_of_odd_rows(spark):
    body = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, None, None, "first"), (None, 3, "user", "lost"), (None, 2, "tool\nx\\n", "<|im_end|>"), (2, 0, "assistant", "y" * 300_000), (3, 0, "user", "")]
    table = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in body], "conv_id long, turn long, role string, text string, turns string, formatted string, layout string")
    made = chat.format(chat.assemble(chat.from_table(table, ("role", "text"), ("conv_id", "turn")), "conv_id", "turn"))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read(made).collect()}
    assert got == {
        1: ([("", "first"), ("user", "q"), ("assistant", ""), ("assistant", "b"), ("assistant", "b")], "bb"), None: ([("tool\nx\\n", "<|im_end|>"), ("user", "lost")], ""),
        2: ([("assistant", "y" * 300_000)], "y" * 300_000), 3: ([("user", "")], ""),
    }
    empty = chat.assemble(chat.from_table(table.where("false"), ("role", "text"), ("conv_id", "turn")), "conv_id", "turn")
    assert chat.read(chat.format(empty)).count() == 0
    unmapped = chat.from_json(spark.createDataFrame([(1, "{}")], "id long, record string"), "record", ("id",))
    assert [(r.formatted, r.turns, r.loss_text) for r in chat.read(chat.format(unmapped)).collect()] == [(None, None, None)]


def test_words_of_bytes_are_those_of_the_rule():
    """Texts split as bytes: each break alone, A-Z lower, no other blank or letter touched."""
    import re

    rule = re.compile("[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+")
    texts = [None, "", " \t ", "a.b,,C d\x0be\x0cf\r\ng", "ÀÉ\xa0x\x85y z　w\x1cv\x1f", "...", "\x00 ẞ Ⅷ \U0001f600;ﬁn", "".join(map(chr, range(0x3000))), "a" * 5 + ". " * 9]
    for text in texts:
        want = ["." if w in ".,;:!?\n\v\f\r" else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in rule.findall(text or "")]
        assert [w.decode() for w in phrases.folded_words((text or "").encode())] == want
