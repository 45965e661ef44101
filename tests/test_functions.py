import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import grading, hashing, text


def one(spark, expr, **cols):
    d = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return d.select(expr.alias("x")).first()["x"]


def test_stem_and_tokens(spark):
    words = {"organization": "organ", "annotations": "annot", "stories": "stories", "categories": "category", "running": "running", "measured": "measur", "boxes": "boxes", "settings": "setting", "glass": "glass"}

    def stem(t):
        for s in text.SUFFIXES:
            if len(t) > len(s) + 4 and t.endswith(s):
                return t[:-3] + "y" if s == "ies" else t[: -len(s)]
        return t

    for w in words:
        assert one(spark, text.stem(F.lit(w))) == stem(w)
    assert one(spark, text.content_tokens(F.lit("The  categories, and the Running of it"))) == sorted({stem("categories"), stem("running")})
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_space_is_unicode(spark):
    assert one(spark, text.compact(F.lit(" a　b \x1c"))) == "a b"
    assert one(spark, text.compact(F.lit(None).cast("string"))) == ""
    assert one(spark, text.word_count(F.lit(" "))) == 0
    assert one(spark, text.word_count(F.lit("a b"))) == 2


def test_predicates(spark):
    assert one(spark, text.too_short(F.lit("a b c d e f g h i j"))) is True
    assert one(spark, text.too_short(F.lit(None).cast("string"))) is True
    assert one(spark, text.symbol_noise(F.lit("#$%" * 12))) is True
    assert one(spark, text.symbol_noise(F.lit("abc" * 12))) is False
    assert one(spark, text.truncate(F.lit("x" * 50), 40)) == "x" * 20 + " ... [truncated]"
    assert one(spark, text.render(F.lit("{a} {b}"), {"a": F.lit("1")})) == "1 {b}"
    assert one(spark, text.cjk_bigrams(F.lit("温度阀a门温度"))) == ["温度", "度阀", "门温"]
    assert one(spark, text.jaccard(F.array(), F.array())) == 0.0
    assert one(spark, text.first_filled(a=F.lit(" "), b=F.lit("x"))["field"]) == "b"


def test_json_parts(spark):
    assert one(spark, text.fenced_json(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert one(spark, text.fenced_json(F.lit('say [1, {"a": 2}] end'))) == '[1, {"a": 2}]'
    assert one(spark, text.fenced_json(F.lit("none"))) is None
    got = one(spark, text.tool_calls(F.lit('<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call><tool_call>bad</tool_call>')))
    assert [(t["name"], t["arguments"]) for t in got] == [("f", '{"x":1}')]


def test_surfaces(spark):
    got = one(spark, text.answer_surfaces(F.lit(" Ada  Lovelace ")))
    assert got[:6] == ["Ada Lovelace.", "Ada Lovelace,", "Ada Lovelace;", "Ada Lovelace:", "Ada Lovelace!", "Ada Lovelace?"] and len(got) == 8
    assert one(spark, text.answer_surfaces(F.lit(" "))) is None


def test_hashes(spark):
    row = {"title": 'T "x"\n\\', "category": "Ü", "subcategory": None, "context": "\x01", "question": "q", "answer": "a/b"}
    d = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    want = hashlib.sha256(json.dumps({k: str(v) for k, v in row.items()}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert d.select(hashing.sample_hash({k: F.col(k) for k in row})).first()[0] == want
    assert one(spark, hashing.sample_hash({})) == hashlib.sha256(json.dumps({k: "" for k in sorted(row)}, separators=(",", ":")).encode()).hexdigest()
    b = hashlib.sha256(json.dumps({"canonical_behavior": "the model x", "category": "C", "subcategory": "a/b"}, sort_keys=True).encode()).hexdigest()
    assert one(spark, hashing.behavior_id(F.lit("C"), F.lit(" A/b "), F.lit("The  model X"))) == b
    for key in ("kn-1", "", "ü"):
        want = int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big") % 10_000
        assert one(spark, hashing.stable_bucket(F.lit(key), 10_000)) == want


def test_arrays(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.0, 1.0], [0.5, 0.5, 0.5])], ["v", "m", "w"])
    g = lambda e: d.select(e).first()[0]
    assert g(A.masked_sum(F.col("v"), F.col("m"))) == 4.0
    assert math.isclose(g(A.masked_mean(F.col("v"), F.col("m"))), 4 / (2 + 1e-8))
    assert g(A.suffix_sums(F.col("v"), 0.5)) == [2.75, 3.5, 3.0]
    assert g(A.suffix_sums(F.col("v"), 0.5, F.col("m"))) == [1.0, 3.5, 3.0]
    assert g(A.prefix_sums(F.col("v"))) == [1.0, 3.0, 6.0]

    def gae(r, v, m, gamma, lam):
        nextv = last = 0.0
        out = []
        for t in reversed(range(len(r))):
            now = r[t] + gamma * nextv - v[t] + gamma * lam * last
            nextv = v[t] * m[t] + (1 - m[t]) * nextv
            last = now * m[t] + (1 - m[t]) * last
            out.append(last)
        return out[::-1]

    assert g(A.gae(F.col("v"), F.col("w"), F.col("m"), 0.9, 0.8)) == pytest.approx(gae([1, 2, 3], [0.5] * 3, [1, 0, 1], 0.9, 0.8))
    ids = F.array(*[F.lit(x) for x in (5, 7, 2, 9)])
    assert one(spark, A.mask_to_end(ids, 2)) == [1, 1, 1, 0]
    assert one(spark, A.mask_to_end(ids, 3)) == [1, 1, 1, 1]
    assert one(spark, A.fit(ids, 6, 0)) == [0, 0, 5, 7, 2, 9]
    assert one(spark, A.fit(ids, 3, truncation="left")) == [7, 2, 9]
    assert one(spark, A.fit(ids, 3, truncation="right")) == [5, 7, 2]
    assert one(spark, A.fit(ids, 3, truncation="middle")) == [5, 2, 9]
    with pytest.raises(Exception):
        one(spark, A.fit(ids, 3))
    assert one(spark, A.at_last(F.lit(2.5), F.array(*[F.lit(x) for x in (1, 1, 0)]))) == [0.0, 2.5, 0.0]
    assert [one(spark, A.linear_ramp(F.lit(s), 0, 1, 10, 20)) for s in (5, 15, 25)] == [0.0, 0.5, 1.0]
    assert one(spark, A.ceil_div(F.lit(7), 3)) == 3 and one(spark, A.round_up(F.lit(7), 3)) == 9
    assert one(spark, A.workload(F.lit(10))) == 24576 * 10 + 100


def test_answers(spark):
    assert one(spark, grading.normalize_answer(F.lit("The  Cat, a dog!"))) == "cat dog"
    assert one(spark, grading.last_tag(F.lit("<answer>a</answer> <answer> b\n</answer>"))) == "b"
    assert one(spark, grading.tagged_em(F.lit("<answer>The Cat</answer>"), F.array(F.lit("cat")))) == 1.0
    assert one(spark, grading.tagged_em(F.lit("<answer>x</answer>" * 11 + "<answer>cat</answer>"), F.array(F.lit("cat")))) == 0.25
    assert one(spark, grading.tagged_em(F.lit("cat"), F.array(F.lit("cat")))) == 0.0
    assert one(spark, grading.numeric_score(F.lit("so #### 1,234"), F.lit("1234"))) == 1.0
    assert one(spark, grading.numeric_answer(F.lit("a 12 . b"), strict=False)) == "12"
    assert one(spark, grading.multiset_match(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "abc")))) == 0.5
    assert one(spark, grading.response_format(F.lit("<think>a</think>\n<response>b</response>"), F.lit("<response>"))) == 1.0
    assert one(spark, grading.response_format(F.lit("<think>a</think>"), F.lit("<response>"))) == 0.0
    r = one(spark, grading.composed_reward(F.lit(0.5), F.lit(2.0), F.lit(float("nan")), F.lit("no_op"), "all_components"))
    assert (r["existence"], r["process"], r["evaluation"], r["score"], r["parts"]) == (0.5, 1.0, 0.0, 0.5, 2.0)
    assert one(spark, grading.overlong_penalty(F.lit(850), 800, 200, 1.0)) == -1.25


def test_latex():
    assert grading.last_box(r"x \boxed{a{b}c} y \boxed{\frac{1}{2}}") == r"\frac{1}{2}"
    assert grading.last_box("none") is None and grading.last_box(None) is None
    for a, b in ((r"\frac12", r"\frac{1}{2}"), ("1/2", r"\frac{1}{2}"), ("0.5", r"\frac{1}{2}"), (r"\sqrt3", r"\sqrt{3}"), (r"x=5", "5"), (r"5\%", "5"), (r"\dfrac{3}{4}", r"\frac{3}{4}"), (".5", "0.5"), (r"90^\circ", "90")):
        assert grading.plain_latex(a) == grading.plain_latex(b), (a, b)
    assert grading.final_form("x = 1,234 dollars") == "1234"
    assert grading.final_form(r"$\text{yes}$") == "yes"
    assert grading.equal_value("0.25", r"\frac14") and grading.equal_value("(1, 2)", "(1,2)") and not grading.equal_value("(1,2)", "[1,2]")
    assert not grading.equal_value("3", "4")


def test_latex_pairs():
    same = [("2\\sqrt{2}", "\\sqrt{8}"), ("x+1", "1+x"), ("(x+1)^2", "x^2+2x+1"), ("\\frac{1}{3}", "\\dfrac{2}{6}"), ("50\\%", "0.5"), ("\\{1,2\\}", "\\{2, 1\\}"), ("(-\\infty,2]\\cup[3,4)", "[3,4)\\cup(-\\infty,2]"), ("\\frac{\\pi}{2}", "0.5\\pi"),
            ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1 & 2 \\\\ 3 & \\frac{8}{2}\\end{pmatrix}"), ("1,234", "1234"), ("\\sin^2 x+\\cos^2 x", "1"), ("2^{10}", "1024"), ("-\\frac12", "-0.5"), ("5 \\text{ cm}", "5"), ("3 \\cdot 4", "12"), ("|{-3}|", "3")]
    other = [("x+1", "x-1"), ("\\sqrt{2}", "\\sqrt{3}"), ("(1,2)", "(2,1)"), ("(1,2)", "[1,2]"), ("[1,2]", "[1,3]"), ("xy", "x+y"), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1\\\\2\\end{pmatrix}"), ("1,2", "1,3"), ("", "0"), ("cat", "dog"), ("7", "\\text{seven}")]
    for a, b in same:
        assert grading.equal_value(a, b) and grading.equal_value(b, a), (a, b)
    for a, b in other:
        assert not grading.equal_value(a, b), (a, b)
    finals = {"x = 12 \\text{ cm}": "12", "the \\$18": "the18", "$3$ apples": "3", "\\boxed{7}": "7", "2\\frac12": "2\\frac{1}{2}", "\\sqrt2": "\\sqrt{2}", "a dog": "dog", "45^{\\circ}": "45", "3{,}000": "3000", "1,2": "12", "\\textbf{(B)}": "(B)", "5 \\mbox{ and } 6": "5and6", "10\\text{}^2": "10", "$5.$": "5"}
    for a, b in finals.items():
        assert grading.final_form(a) == b, (a, grading.final_form(a))
    plains = {"\\left( 1, 2 \\right)": "(1,2)", "x = 3": "3", "\\frac{a}b": "\\frac{a}{b}", "\\tfrac12": "\\frac{1}{2}", "3/4": "\\frac{3}{4}", "03/4": "03/4", "y=x=2": "y=x=2", "abc=2": "abc=2", "\\sqrt[3]8": "\\sqrt[3]{8}", "{.5}": "{0.5}", "\\frac{1": "\\frac{1}{}"}
    for a, b in plains.items():
        assert grading.plain_latex(a) == b, (a, grading.plain_latex(a))
    assert grading.plain_latex("{" * 300 + "x") is not None and not grading.equal_value("(" * 500, ")" * 500)


def test_routes(spark):
    rows = [("openai/gsm8k", "so #### 12", "12"), ("aime_2024", "Answer: 7", "7"), ("numina_cn_k12", "\\boxed{1+x}", "x+1"), ("searchR1_nq", "<answer>The cat</answer>", "cat"), ("hiyouga/geometry3k", "<think>t</think> \\boxed{2}", "2"), ("none", "1", "1")]
    d = spark.createDataFrame(rows, "s string, sol string, t string")
    got = [r.x for r in d.select(grading.routed_score(F.col("s"), F.col("sol"), F.col("t")).alias("x")).collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, 1.0, None]
    with pytest.raises(Exception):
        d.select(grading.routed_score(F.col("s"), F.col("sol"), F.col("t"), strict=True)).collect()


def test_router(spark):
    d = spark.createDataFrame([("a", r"\boxed{2}", "2"), ("b1", "Answer: 3", "3"), ("c", "x", "x")], ["s", "sol", "t"])
    got = d.select(grading.routed_score(F.col("s"), F.col("sol"), F.col("t"), {"a": "boxed", "b*": "final"}).alias("x")).collect()
    assert [r["x"] for r in got] == [1.0, 1.0, None]
