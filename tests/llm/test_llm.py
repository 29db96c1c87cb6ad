"""Text and source operators against brute force, exact round trips and the languages' own parsers."""

import ast
import base64
import json
import os
import random
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshline.llm import leakage, lookalike, source_kind, syntax, tokenizer
from meshline.llm.lookalike import one_form

DOCS = "doc_id bigint, text string, lang string, form string, ids string"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary file")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "clash", "clash") for i, t in enumerate(texts)], DOCS)


# --- tokenizer ---


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    with open(tokenizer.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80) | st.text(alphabet="aeihnrst \n<|>_0123é🚀", max_size=120))
def test_ids_equal_the_reference_encoder(reference_encoding, text):
    text = text.encode("utf-8", "replace").decode()
    enc = tokenizer.encoder(tokenizer.VOCABULARY)
    assert enc.encode(text) == reference_encoding.encode_ordinary(text)
    assert reference_encoding.decode(enc.encode(text)) == text


@needs_vocabulary
def test_token_table_cases(spark, reference_encoding):
    texts = [None, "", "  ", "<|endoftext|>", "hello world", "x" * 50_000, "hello world"]
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode_table(docs(spark, texts)).collect()}
    assert len(got) == len(texts) and got[0] == got[1] == []
    assert all(got[i] == reference_encoding.encode_ordinary(t) for i, t in enumerate(texts) if t)
    assert tokenizer.encode_table(docs(spark, [])).count() == 0


@needs_vocabulary
def test_one_long_piece_takes_linear_time(reference_encoding):
    import time

    enc, rng = tokenizer.encoder(tokenizer.VOCABULARY), random.Random(3)
    took = {}
    for n in (20_000, 160_000):
        s = "".join(rng.choice("abcdefghij") for _ in range(n))
        start = time.perf_counter()
        ids = enc.piece(s)
        took[n] = time.perf_counter() - start
        assert "".join(enc.token[i] for i in ids) == s
    assert took[160_000] < 24 * took[20_000]  # 8 times the letters; quadratic time would be 64 times


# --- look-alikes ---


def test_one_form():
    assert one_form("Ｈｅｌｌｏ\u00a0w\u200borld") == "Hello world"
    assert one_form("cafe\u0301") == one_form("café") == "café" != "cafe"
    assert one_form("ѕсоре") == "scope" and one_form("Τοken") == "Token" and one_form("ﬁx") == "fix"
    assert one_form("ёж") == one_form("е\u0308ж") and one_form("a  b") != one_form("a b") and one_form("A") != one_form("a")
    assert one_form("a\nb") != one_form("a b") and one_form(None) is None and one_form("") == ""


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_one_form_is_stable(text):
    assert one_form(one_form(text)) == one_form(text)


def test_agreeing_pairs(spark):
    texts = ["Hello world", "Hello\u00a0world", "Hello world", "Ｈello world", "hello world", "", None, " ", "\u00a0", "é", "e\u0301", "e", "x\x07", "x", "y" * 40_000, "y" * 40_000 + "\u200b"]
    got = {tuple(r) for r in lookalike.agreeing_pairs(docs(spark, texts)).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i) if texts[i] is not None and texts[j] is not None and texts[i] != texts[j] and one_form(texts[i]).strip() and one_form(texts[i]) == one_form(texts[j])}
    assert got == {(j, i) for i, j in want} and (0, 3) in got and (12, 13) not in got
    assert lookalike.agreeing_pairs(docs(spark, [])).count() == 0
    canon = {r["doc_id"]: r["canonical_id"] for r in lookalike.canonical(docs(spark, texts)).collect()}
    assert canon[3] == 0 and canon[10] == 9 and canon[4] == 4 and len(canon) == len(texts)


def test_collation_classes_hold_every_agreeing_pair(spark):
    """Each character that the form changes, in a text of its own, meets the text's form; case apart, nothing else."""
    import sys
    import unicodedata

    texts = []
    for code in range(128, sys.maxunicode + 1):
        text = f"w{code}a{chr(code)} b"
        if unicodedata.category(chr(code)) not in ("Cn", "Co", "Cs", "Cc") and one_form(text) != text:
            texts += [text, one_form(text)]
    texts += ["q a\u0323\u0301", "q a\u0301\u0323", "Q a\u0323\u0301", "q \u1ea1\u0301"]
    got = {tuple(r) for r in lookalike.agreeing_pairs(docs(spark, texts)).collect()}
    n = len(texts) - 4
    assert len(texts) > 10_000 and {(i, i + 1) for i in range(0, n, 2)} <= got
    assert {p for p in got if p[1] >= n} == {(n, n + 1), (n, n + 3), (n + 1, n + 3)}


def test_candidates_are_few_and_hold_case_variants(spark):
    found = {r["doc_id"] for r in lookalike.candidates(docs(spark, ["Same Text", "same text", "Ｓame text", "other", None, "", "other"])).collect()}
    assert found == {0, 1, 2} and {tuple(r) for r in lookalike.agreeing_pairs(docs(spark, ["Same Text", "same text", "ｓame text"])).collect()} == {(1, 2)}


def test_letters_are_mapped_before_and_after_compatibility_forms():
    assert one_form("\u03f2\u03f9\u043a\u0261\u0251\u04af\u04cf") == "cCkgayl" and one_form("\u0457") == "\u00ef"


# --- leakage ---


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, suite string, prompt string, text string, answer string")


def test_exact_leaks(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    texts = [[rng.choice(vocab) for _ in range(40)] for _ in range(12)]
    its = [(i, "s", "p", " ".join(t), "w1 w2") for i, t in enumerate(texts)] + [(0, "s", "p", " ".join(texts[0]), "w1 w2"), (90, "s", "p", None, None), (91, "s", "p", "too short", "x")]
    made = [None, "", "short", " ".join(vocab) * 3]
    for k in (11, 12, 13, 25):
        for i in (0, 5):
            at = rng.randrange(0, 40 - k)
            run = texts[i][at : at + k]
            made.append("Before, " + " - ".join(run).upper() + "! after")
            made.append("x " * rng.randrange(1, 6) + "\u200b ".join(run) + " y" * 30)
    made += made[-1:]

    def grams(w):
        return {tuple(w[j : j + 12]) for j in range(len(w) - 11)}

    want = {(d, i) for d, t in enumerate(made) for i, x in enumerate(texts) if t and grams(leakage.words(t)) & grams(x)}
    got = [tuple(r) for r in leakage.exact_leaks(docs(spark, made), items(spark, its)).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) >= 10
    near = {(r["doc_id"], r["item_id"]): r["lcs_share"] for r in leakage.paraphrases(docs(spark, made), items(spark, its)).collect()}
    assert want <= set(near) and all(near[p] == 1 for p in want)


def test_needed_edits_bound_the_cost_from_below():
    """No valid sequence needs an edit, and no repaired one fewer than its places tell."""
    js = syntax.parser("javascript")
    for text in ("f(a);\n", "const x = {a: 1, b: [2, 3]};\nclass A { m() { return 1; } }\n"):
        assert js.check(text).cost == 0
        seq = js.seqs[-1]
        assert js._needed(seq, js.g.ids["Start"])[1][0] == 0
    wrong = "from a import b\ndef f(x):\n    return x\n\nclass A:\n    y = 1\n"
    assert js.check(wrong).cost == syntax.CAP + 1 and syntax.parser("python").check(wrong).cost == 0


def test_merge_markers_cost_one_edit_each():
    py = syntax.parser("python")
    text = "def f(x):\n    a = 1\n<<<<<<< ours\n    b = 2\n=======\n    b = 3\n>>>>>>> theirs\n    return a\n"
    got = py.check(text)
    assert (got.cost, got.reason, got.at) == (3, "conflict", text.index("<<<"))
    go = syntax.parser("go").check("package a\n\nfunc F() int {\n<<<<<<< a\n\treturn 1\n=======\n\treturn 2\n>>>>>>> b\n}\n")
    assert (go.cost, go.reason) == (3, "conflict")


def test_deep_nesting_is_no_trouble():
    deep = "[" * 30_000 + "1" + "]" * 30_000
    assert syntax.verdict("a.json", deep).cost == 0 and syntax.verdict("a.json", deep[:-1] + ",]").cost > 0


def test_one_missing_comma_in_a_long_list():
    text = "{" + ", ".join(f'"k{i}": {i}' for i in range(400)) + "}"
    assert syntax.verdict("a.json", text).cost == 0
    assert syntax.verdict("a.json", text.replace('"k200": 200,', '"k200": 200')).cost == 1


def test_planted_rewordings(spark):
    """Item passages with a sixth of the words replaced and one dropped, inside other text: nearly all come out, and little else."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(1500)]
    its = [[rng.choice(vocab) for _ in range(40)] for _ in range(40)]
    made, planted = [], set()
    for d in range(240):
        text = [rng.choice(vocab) for _ in range(rng.randrange(30, 90))]
        if d % 2:
            i = rng.randrange(40)
            part = [rng.choice(vocab) if k % 6 == d % 6 else w for k, w in enumerate(its[i][5:35])]
            del part[rng.randrange(len(part))]
            at = rng.randrange(len(text))
            text[at:at] = part
            planted.add((d, i))
        made.append(" ".join(text))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.paraphrases(docs(spark, made), items(spark, [(i, "s", "p", " ".join(t), "no such answer") for i, t in enumerate(its)])).collect()}
    assert len(got & planted) >= 0.9 * len(planted) and len(got & planted) >= 0.95 * len(got)


def test_index_joined_with_salt_gives_the_same_rows(spark, monkeypatch):
    rng = random.Random(9)
    its = [(i, "s", "p", " ".join(rng.choice("abcdefghijklmnopq") * 2 for _ in range(20)), "a") for i in range(5)]
    made = [f"x y {t[3]} z" for t in its] * 3 + ["x " + " ".join(its[0][3].split()[2:15])]
    one = sorted(tuple(r) for r in leakage.exact_leaks(docs(spark, made), items(spark, its)).collect())
    monkeypatch.setattr(leakage, "INDEX_BYTES", 0)
    assert sorted(tuple(r) for r in leakage.exact_leaks(docs(spark, made), items(spark, its)).collect()) == one and len(one) == 16


def test_long_document_with_late_answer(spark):
    text = " ".join(f"w{i}" for i in range(14))
    made = [" ".join(f"f{i % 900}" for i in range(30_000)) + " " + text + " filler" * 5_000 + " the answer: forty two"]
    got = leakage.paraphrases(docs(spark, made), items(spark, [(1, "s", "p", text, "Forty-two"), (2, "s", "p", text + " w0", "none")])).collect()
    assert {(r["item_id"], r["lcs_share"], r["has_answer"]) for r in got} == {(1, 1.0, True), (2, 1.0, False)}


def test_answer_words_need_not_occur_in_item_texts(spark):
    text = " ".join(f"w{i}" for i in range(14))
    its = [(1, "s", "p", text, "Forty two"), (2, "s", "p", " ".join(f"v{i}" for i in range(14)), "w3"), (3, "s", "p", " ".join(f"u{i}" for i in range(14)), None)]
    made = [f"{text} so the answer is forty and two", f"{text} no", " ".join(f"v{i}" for i in range(14)) + " it is w3", " ".join(f"u{i}" for i in range(14)), f"{text} two forty"]
    got = {(r["doc_id"], r["item_id"]): r["has_answer"] for r in leakage.paraphrases(docs(spark, made), items(spark, its)).collect()}
    first = min(d for d, _ in got)
    assert {(d - first, i): a for (d, i), a in got.items()} == {(0, 1): True, (1, 1): False, (2, 2): True, (3, 3): False, (4, 1): False}


def test_leaks_of_nothing(spark):
    none = items(spark, [])
    assert leakage.exact_leaks(docs(spark, ["a b c"]), none).count() == 0
    assert leakage.exact_leaks(docs(spark, []), items(spark, [(1, "s", "p", " ".join("abcdefghijklmno"), "a")])).count() == 0


# --- syntax ---

VALID = {
    "python": ["x = 1\n", "", "def f(a, *b, c=1, **d) -> int:\n    return [i for i in a if i]\n", "try:\n  pass\nexcept* A as e:\n  raise X from e\nfinally:\n  del a[0], b.c\n", "f(a)[1:2, ...] += lambda x, /: x\n", "match x:\n  case [1, *r] if r: pass\n  case {'a': b, **c}: pass\n", "@d\nasync def g():\n  async with a as b, c: await x\n", "x = (1,\n2)\n"],
    "json": ['{"a": [1, 2.5e3, null, "\\u00e9"]}', "[]", "1"],
    "javascript": ["export default class A { #x = 1; get y() { return this.#x } }\n", "const f = async ({a, b = 1}, ...c) => { for (const x of c) await x }\n", "a = b\nc = /[({]x/.test(`t ${a}`)\n", "!function(){var a=1;return a}()"],
    "typescript": ["type A<T> = { [K in keyof T]?: T[K] };\n", "export function f(x: any): x is string { return x! as string }\n", "interface A extends B { (a: number): void; [k: string]: T | undefined }\n"],
    "java": ["package a;\nimport b.*;\nclass A<T> { int[] x = {1}; void f(List<? super T> y) throws E { for (T t : y) { g(t -> 1); } } }\n"],
    "go": ["package a\n\nfunc (s *T) F(x ...int) (int, error) {\n\tif v, ok := m[x]; !ok {\n\t\treturn 0, nil\n\t}\n\tgo f()\n\treturn v, nil\n}\n"],
    "rust": ["pub fn f<'a, T: X + 'a>(x: &'a [T]) -> Result<(), E> { let y = x.iter().map(|z| z + 1).collect::<Vec<_>>(); match y { Some(0..=9) => {} _ => return Err(E {}) } Ok(()) }\n"],
}
BROKEN = {
    "python": ["def f(x)\n    return x\n", "if a:\nb = 1\n", 'print "x"\n', "x = [1, 2\ny = 3\n", "a = 'b\n", "x = (1]\n", "  a = 1\n b = 2\n", "<<<<<<< a\nx = 1\n=======\nx = 2\n>>>>>>> b\n"],
    "json": ["", '{"a": 1,}', "{'a': 1}", '{"a": NaN}', '{"a": 1} x', '{"a": 01}'],
    "javascript": ["function f(a: number) { }\n", "if (a { b(); }\n", "x = 'a\n", "/* never", "{\"a\": 1, \"b\": 2}\n", "def f(x):\n    return x\n", "<html>\n"],
    "typescript": ["export function f(a: any): number {\n", "class A { int f(x) { } }\n"],
    "java": ["class A { void f() { }\n", "x = 1;\n", "class A { int f( { } }\n"],
    "go": ["package a\nx = 1\n", "func f() {}\n", "package a\nfunc f( {\n}\n"],
    "rust": ["fn f() { let x = 1\n", "import {a} from 'b';\n", "x = 1;\n"],
}


@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid_and_broken_sources(lang):
    p = syntax.parser(lang)
    assert [p.check(t).cost for t in VALID[lang]] == [0] * len(VALID[lang])
    assert all(p.check(t).cost > 0 for t in BROKEN[lang]), [t for t in BROKEN[lang] if not p.check(t).cost]


def test_python_charts_agree_with_the_parser():
    p = syntax.parser("python")
    for module in (textwrap, json, random, base64):
        with open(module.__file__) as f:
            text = f.read()
        assert p.check(text).cost == 0
        rng = random.Random(3)
        lines = text.split("\n")
        for _ in range(25):
            k = rng.randrange(len(lines))
            cut = "\n".join(lines[:k] + [lines[k][: rng.randrange(len(lines[k]) + 1)]]) + "\n"
            try:
                ast.parse(cut)
                fine = True
            except SyntaxError:
                fine = False
            assert (p.check(cut).cost == 0) == fine, cut[-200:]


def test_repair_costs_and_reasons():
    js = syntax.parser("javascript")
    assert js.check("f(a;\n").cost == 1 and syntax.dyck_cost(["(", "]", "{"]) == 2
    assert js.check("a = 1;\nfunction f() {\n  g(1\n").reason == "truncation"
    assert js.check("a = 1;\nif (x { y(); }\nb = 2;\n").reason == "local"
    assert js.check("/* <<<<<<< a\n=======\n>>>>>>> b */\nx = 1;\n").cost == 0
    assert js.check("a = 1;\nvar = 2;\nb = 3;\n").cost == 1


def test_bracket_costs_of_any_length():
    assert syntax.dyck_cost([")"] * 31 + ["("] * 31) == 32
    assert syntax.dyck_cost(["(", "]"] * 40) == 40 and syntax.dyck_cost(["("] * 100_001) == 50_001
    assert syntax.dyck_cost(["(", "[", "("] * 30 + [")", "]", "]"] * 30) == 30
    assert syntax.parser("javascript").check("f([)];\n").cost == 2


def test_language_by_path():
    assert syntax.language_of("a/B.PY", "") == "python" and syntax.language_of("x", "#!/usr/bin/env python3\n") == "python"
    assert syntax.language_of("x", "#!/usr/bin/node\n") == "javascript" and syntax.language_of("x", None) is None and syntax.language_of("a.zzz", "") is None


FILES = "path string, repo string, hash string, content string, generation bigint, lang string, cost int"
DIAGS = "file string, code string, message string, hash string"


def test_broken_files(spark):
    files = [("a.py", "r", "h1", "x = (", 1, None, 0), ("a.py", "r", "h2", "x = 1\n", 2, None, 0), ("b.js", "r", "h", "f(", 1, "py", 0), ("b.js", "r", "h", "f(", 1, "py", 0), ("c.go", None, "h9", None, 1, None, 0), ("d.go", None, "h8", None, 1, None, 0), ("e.go", None, "h7", None, 1, None, 0), ("f.xyz", "r", "h", "((", 1, None, 0), ("g.py", "r", "h", "", 1, None, 0), (None, "r", "h", "(", 1, None, 0)]
    diags = [("c.go", "Syntax-Error ", "m", "h9"), ("d.go", "syntax-error", "m", "old"), ("e.go", "oversize", "unexpected token", "h7"), ("a.py", "syntax-error", "m", "h2"), (None, None, None, None)]
    got = {r["path"] for r in syntax.broken(spark.createDataFrame(files, FILES), spark.createDataFrame(diags, DIAGS)).collect()}
    assert got == {"b.js", "c.go"}
    assert syntax.broken(spark.createDataFrame([], FILES), spark.createDataFrame([], DIAGS)).count() == 0
    rates = {(r["repo"], r["lang"]): (r["n_files"], r["n_broken"]) for r in syntax.rates(spark.createDataFrame(files, FILES), spark.createDataFrame(diags, DIAGS)).collect()}
    assert rates[("r", "python")] == (2, 0) and rates[("r", "javascript")] == (1, 1)


# --- families of sources ---

HAND = 'import os\n\ndef walk(a, b):\n    """Walk it."""\n    for x in a:\n        if x > b:\n            return x\n    return None\n'


def test_source_kinds(spark):
    blob = 'DATA = "' + "Ab9+/x" * 60 + '"\n'
    mini = "!function(){" + "".join(f"function a{i}(b){{return b.c>{i}?b:b.d({i})}}" for i in range(30)) + "}();\n"
    rows = [
        ("r/src/a.py", "r", HAND), ("q/src/b.py", "q", HAND.replace("walk", "run")), ("r/src/g.py", "r", "# Code generated by tool; DO NOT EDIT.\n" + HAND), ("r/src/same.py", "r", HAND.replace("walk", "zip")),
        ("r/src/copy.py", "r", "# Code generated by other. DO NOT EDIT.\n" + HAND.replace("walk", "zip")), ("r/Vendor/lib/x.py", "r", HAND.replace("walk", "vend")), ("q/own/x.py", "q", HAND.replace("walk", "vend")),
        ("r/vendor_portal/a.py", "r", HAND.replace("walk", "mine")), ("r/x.pb.go", "r", None), ("r/y.go", "r", None), ("r/t/d.py", "r", blob), ("r/m.js", "r", mini), ("r/e.py", "r", ""),
        ("r/gen_tool.py", "r", HAND.replace("walk", "w2") + '\nHEAD = "// Code generated by x. DO NOT EDIT."\n# The ids are generated by x\n'),
    ]
    files = spark.createDataFrame([(p, r, c, 1, "x") for p, r, c in rows] + [(None, "r", "a", 1, "x")], "path string, repo string, content string, generation bigint, family string")
    got = {r["path"]: set(r["kinds"]) for r in source_kind.judged(files).collect()}
    assert got["r/src/g.py"] == {"generated"} and got["r/src/copy.py"] == got["r/src/same.py"] == {"generated"}
    assert got["r/Vendor/lib/x.py"] == got["q/own/x.py"] == {"vendored"} and got["r/x.pb.go"] == {"generated"} and got["r/t/d.py"] == {"blob"} and got["r/m.js"] == {"minified"}
    assert all(got[p] == set() for p in ("q/src/b.py", "r/vendor_portal/a.py", "r/y.go", "r/e.py", "r/gen_tool.py"))
    assert len(got) == len(rows)
    assert source_kind.not_hand_written(files.limit(0)).count() == 0


def test_family_evidence_reaches_near_members(spark, monkeypatch):
    """Where most token streams of a family are marked, members whose tokens differ follow; a lone mark among look-alikes does not spread."""
    monkeypatch.setattr(source_kind, "CHANCE", 0.9)
    other = "def add(a, b):\n    total = 0\n    while a < b:\n        total += a\n        a += 1\n    return [total, a, b]\n"
    lone = "class A:\n    def get(self):\n        return {self.x: 1, self.y: 2}\n\n    def put(self, v):\n        self.x, self.y = v, v\n"
    rows = [(f"r/g{i}.py", "r", "# Code generated by tool; DO NOT EDIT.\n" + HAND.replace("walk", f"g{i}")) for i in range(3)] + [("r/bare.py", "r", HAND.replace("walk", "bare")), ("q/bare.py", "q", HAND.replace("walk", "hand"))]
    rows += [(f"{r}/vendor/{r}.py", r, other.replace("add", f"add_{r}")) for r in "qrs"] + [("t/own.py", "t", other.replace("add", "plus"))]
    rows += [("r/lone.py", "r", "# Code generated by tool; DO NOT EDIT.\n" + lone), ("r/hand.py", "r", lone.replace("get", "read"))]
    files = spark.createDataFrame([(p, r, c, 1) for p, r, c in rows], "path string, repo string, content string, generation bigint")
    got = {r["path"]: set(r["kinds"]) for r in source_kind.judged(files).collect()}
    assert got["r/bare.py"] == {"generated"} and got["t/own.py"] == {"vendored"}
    assert got["q/bare.py"] == got["r/hand.py"] == set() and got["r/lone.py"] == {"generated"}


def test_marks_spread_beyond_chance_only(spark):
    """Two marked of three by chance do not spread, ten of eleven do."""
    n = spark.createDataFrame([(2, 3), (10, 11), (5, 5), (6, 12), (0, 4)], "marked long, n long")
    got = [r[0] for r in n.select(source_kind._beyond_chance(F.col("marked"), F.col("n"), 0.05)).collect()]
    assert got == [False, True, True, False, False]


def test_family_links_join_all_similar_sets(spark, monkeypatch):
    monkeypatch.setattr(source_kind, "BLOCK", 4)
    rng = random.Random(6)
    base = [[rng.randrange(2**40) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(60):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(0, 9)):
            s.discard(rng.choice(sorted(s)))
        rows.append((f"s{i:02d}", sorted(s)))
    links = source_kind.family_links(spark.createDataFrame(rows, "set_id string, shingles array<bigint>")).collect()
    sets = {k: set(v) for k, v in rows}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)

    def parts(pairs):
        root = {k: k for k in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(k for k in sets if find(k) == find(x)) for x in sets}

    true = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert parts(links) == parts(true)
